"""Named queries over the driver tables, each beside its plain SQL twin."""

from importlib import import_module

MODULES = (
    "scalars", "rules", "keys", "similarity", "measures", "ranking", "entities", "documents", "feeds", "sinks", "streams", "precedents",
)


def load() -> None:
    """Import every catalog module, which registers its queries."""
    for name in MODULES:
        import_module(f"vacancylens.catalog.{name}")
