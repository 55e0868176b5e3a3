"""Named queries over the given tables, each with its SQL twin where one exists."""

from importlib import import_module

from fleetpulse.catalog.registry import ORACLES, QUERIES

MODULES = ("scans", "baselining", "trends", "quality", "causes", "decisions", "samples", "verdicts", "models", "serving", "bulk", "streams", "inputs")


def load() -> tuple[dict, dict]:
    for name in MODULES:
        import_module(f"fleetpulse.catalog.{name}")
    return QUERIES, ORACLES
