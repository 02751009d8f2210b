"""Readers and writers of trajectories and structures."""
