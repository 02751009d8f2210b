"""Analyses of trajectories: functions from a Trajectory to a DataFrame."""
