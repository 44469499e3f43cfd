"""Named queries, by module; load() registers all of them."""

from importlib import import_module

MODULES = ("relational", "scalars", "advanced", "search", "store", "streams", "sql")


def load() -> None:
    for name in MODULES:
        import_module(f"siltstone.plans.{name}")
