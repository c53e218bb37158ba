"""Named queries over the test tables, each with an equivalent SQL text where one exists."""

import importlib

from gridloom.catalog.base import REGISTRY

MODULES = ("pointwise", "neighbourhood", "aggregates", "blocks", "sequences", "structure", "streams", "files")


def registered():
    """All queries by name."""
    for m in MODULES:
        importlib.import_module(f"gridloom.catalog.{m}")
    return REGISTRY
