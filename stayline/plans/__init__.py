"""Named queries: thin calls of the operators with the columns of the test tables."""

import importlib

MODULES = ("foundations", "features", "reporting", "ranking", "decisions", "outcomes", "modelling", "inference")


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"stayline.plans.{name}")
