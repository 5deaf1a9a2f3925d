"""Importing this module registers every query."""

from workload import cleaning, drifting, jobs, scoring, shaping, splitting, windowing  # noqa: F401
