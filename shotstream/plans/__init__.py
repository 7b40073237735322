"""Registered queries over the given tables."""

from importlib import import_module

MODULES = ("q_ingest", "q_features", "q_risk", "q_evaluation", "q_streams", "q_training")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
