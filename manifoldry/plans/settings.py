"""Settings of a fit: nested sections with defaults, deep merging over them, and checks. An argument beats a given mapping or JSON file, which beats the default."""

from __future__ import annotations

import copy
import json
from typing import Any

# The default settings.
DEFAULTS: dict[str, Any] = {
    "seed": 0,
    "sample": {"strategy": "prefix", "size": 50_000},
    "dimension": {"strategy": "mle", "sample_size": 10_000, "k": 20, "d": 12.0},
    "cells": {"n_cells": 300, "min_points_per_cell": 10, "placement": "kmeans", "iterations": 25, "engine": "lloyd"},
    "refine": {"strategy": "minibatch", "passes": 0, "tolerance": 0.01, "max_points": None, "chunk_size": 10_000},
    "masses": {"strategy": "counted", "rel_error": None, "max_points": None},
    "graph": {"radius": "adaptive_per_cell", "k": 10, "sample_size": 5000, "multiplier": 3.0, "kernel": "radial", "sigma": 0.3333, "cutoff": 3.0, "connect": True},
    "voltage": {"threshold": 1e-3},
    "landmarks": {"count": "dimension", "multiplier": 1.0, "n": 20, "noise_std": 0.01, "reach_k": None, "share": 0.9, "rel_tolerance": 0.05, "rho_bounds": [1e-6, 1e6]},
    "extension": {"strategy": "average", "kernel": "nearest", "k": 3, "sharpness": 16.0},
    "embedding": {"n_components": 2, "distance_floor": 1e-10, "local_chart": "last", "fill": 0.6, "max_points": 256, "origin": "anchor"},
}

#: What a named choice may be.
CHOICES: dict[tuple[str, str], tuple[str, ...]] = {
    ("sample", "strategy"): ("prefix", "reservoir"),
    ("dimension", "strategy"): ("mle", "fixed"),
    ("cells", "placement"): ("kmeans", "farthest"),
    ("cells", "engine"): ("lloyd", "spark_ml"),
    ("refine", "strategy"): ("minibatch", "lloyd"),
    ("masses", "strategy"): ("counted", "uniform", "smoothed"),
    ("graph", "radius"): ("adaptive_per_cell", "knn", "point_knn", "centroid_spacing"),
    ("graph", "kernel"): ("radial", "tapered", "gaussian"),
    ("landmarks", "count"): ("dimension", "fixed"),
    ("extension", "strategy"): ("average", "grounded"),
    ("extension", "kernel"): ("nearest", "graph"),
    ("embedding", "local_chart"): ("last", "all", "none"),
    ("embedding", "origin"): ("anchor", "point"),
}


def merged(base: dict, over: dict, path: str = "") -> dict:
    """base with the values of over; a key that base doesn't have is an error."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        if key not in out:
            raise KeyError(f"unknown setting {path}{key}")
        if isinstance(out[key], dict):
            if not isinstance(value, dict):
                raise TypeError(f"{path}{key} is a section")
            out[key] = merged(out[key], value, f"{path}{key}.")
        else:
            out[key] = value
    return out


def checked(s: dict) -> dict:
    for (section, key), allowed in CHOICES.items():
        if s[section][key] not in allowed:
            raise ValueError(f"{section}.{key} is {s[section][key]!r}, not one of {', '.join(allowed)}")
    whole = [("sample", "size"), ("dimension", "k"), ("cells", "n_cells"), ("cells", "min_points_per_cell"), ("graph", "k"), ("extension", "k"), ("embedding", "n_components"), ("embedding", "max_points"), ("landmarks", "n")]
    for section, key in whole:
        if not isinstance(s[section][key], int) or s[section][key] < 1:
            raise ValueError(f"{section}.{key} must be a whole number of at least 1")
    for section, key in (("voltage", "threshold"), ("landmarks", "noise_std"), ("landmarks", "rel_tolerance"), ("extension", "sharpness"), ("embedding", "distance_floor"), ("embedding", "fill"), ("graph", "multiplier"), ("graph", "sigma"), ("graph", "cutoff")):
        if not s[section][key] > 0:
            raise ValueError(f"{section}.{key} must be positive")
    lo, hi = s["landmarks"]["rho_bounds"]
    if not 0 < lo < hi:
        raise ValueError("landmarks.rho_bounds must be positive and ordered")
    if not 0 < s["landmarks"]["share"] <= 1:
        raise ValueError("landmarks.share must be in (0, 1]")
    if s["refine"]["passes"] < 0:
        raise ValueError("refine.passes must not be negative")
    return s


def settings(given: dict | str | None = None, **over: Any) -> dict:
    """given: a mapping, or the path of a JSON file. over: section__key=value, or seed=value."""
    if isinstance(given, str):
        with open(given, encoding="utf-8") as f:
            given = json.load(f)
    out = merged(DEFAULTS, given or {})
    for name, value in over.items():
        section, _, key = name.partition("__")
        out = merged(out, {section: {key: value} if key else value})
    return checked(out)
