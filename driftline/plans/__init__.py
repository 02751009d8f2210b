"""A registry of analyses by name, and a runner for lists of requests."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

from driftline.model import Trajectory
from driftline.operators import angles, correlation, defects, distances, fluctuation, grids, helices, linear, membrane, radial, series, shape, solvation, transforms

#: Other names of the same analysis.
ALIASES = {
    "atomicfluct": "rmsf", "get_average_frame": "mean_structure", "make_structure": "mean_structure", "autoimage": "image", "fiximagedbonds": "image", "volmap": "density",
    "count_in_voxel": "water_count", "analyze_modes": "pca", "molsurf": "surf", "permute_dihedrals": "multidihedral", "msd_multi": "msd", "polymer_chain_rg": "chain_rg",
    "polymer_contour_length": "contour_length", "polymer_end_to_end": "end_to_end", "polymer_persistence_length": "persistence_length", "vector": "distance_vector",
    "polymer_bond_length": "bond_length_distribution", "polymer_bond_angle": "bond_angle_distribution", "helixorient": "helix_orientation", "nematic_order": "nematic",
    "strip_trajectory": "strip", "superpose_trajectory": "superpose", "rotate_dihedral_trajectory": "rotate_dihedral", "set_dihedral_trajectory": "set_dihedral", "center_trajectory_output": "center",
    "transform_trajectory": "transform", "image_trajectory": "image", "autoimage_trajectory": "image", "fiximagedbonds_trajectory": "image", "runningavg_trajectory": "runningavg",
    "randomize_ions_trajectory": "randomize_ions", "docking": "docking_contacts", "docking_analysis": "docking_contacts", "radial": "rdf", "sasa": "surf", "covar": "matrix_covariance", "correl": "matrix_correlation",
    "dist": "matrix_distance", "rotdif": "rotacf", "toroidal_diffusion": "toroidal_transitions", "velocity_autocorrelation": "velocityautocorr", "lie": "interaction_energy",
}

#: Analyses that a session has registered.
OWN: dict[str, Callable[..., DataFrame]] = {}


def analyses() -> dict[str, Callable[..., DataFrame]]:
    """Every public function of the operator modules whose first argument is a trajectory; membranes' begin with lipid_."""
    found = {}
    for module in (shape, distances, angles, fluctuation, transforms, radial, correlation, grids, membrane, linear, solvation, defects, helices, series):
        for name, f in inspect.getmembers(module, inspect.isfunction):
            if f.__module__ == module.__name__ and not name.startswith("_") and next(iter(inspect.signature(f).parameters), "") == "traj":
                found[f"lipid_{name}" if module is membrane and name != "nematic" else name] = f
    return found | {alias: found[name] for alias, name in ALIASES.items()} | OWN


def register(name: str, f: Callable[..., DataFrame]) -> None:
    """Makes a function of a trajectory and keyword parameters an analysis; a known name is an error."""
    if name in analyses():
        raise ValueError(f"{name!r} is an analysis already")
    if next(iter(inspect.signature(f).parameters), None) is None:
        raise TypeError("an analysis takes a trajectory first")
    OWN[name] = f


def run(traj: Trajectory, requests: list[dict]) -> dict[str, DataFrame]:
    """Results by request id (``id``, else the analysis's name); unknown names and parameters raise before anything runs."""
    known, planned = analyses(), {}
    for r in requests:
        r = dict(r)
        name = r.pop("analysis")
        label = r.pop("id", name)
        if name not in known:
            raise ValueError(f"unknown analysis {name!r}")
        inspect.signature(known[name]).bind(traj, **r)
        if label in planned:
            raise ValueError(f"two requests are named {label!r}")
        planned[label] = (known[name], r)
    return {label: f(traj, **r) for label, (f, r) in planned.items()}
