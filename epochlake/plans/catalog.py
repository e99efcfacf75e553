"""Imports every module that registers queries."""

from epochlake.plans import evaluation, experiment, features, grids, live, reuse, shape, spectral, stores  # noqa: F401
