"""Registered queries: ``catalogue`` holds the registry, the other modules add to it when they are imported."""

from . import catalogue, front_door, networks  # noqa: F401
