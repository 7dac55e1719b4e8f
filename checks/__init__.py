"""The registered queries, each next to the SQL that must give the same rows."""

import importlib

AREAS = ("sources", "groups", "scores", "boxes", "texts", "storage")


def registered() -> tuple[dict, dict]:
    """(queries, oracle SQL) of every area."""
    from .base import ORACLES, QUERIES

    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
    return dict(QUERIES), dict(ORACLES)
