"""All queries of the subpackage."""

from importlib import import_module

_MODULES = ["output", "quality", "duplicate", "structure"]

QUERIES: dict = {}
ORACLE: dict = {}

for _name in _MODULES:
    _mod = import_module(f"doccensus.llm.{_name}_queries")
    QUERIES.update(_mod.QUERIES)
    ORACLE.update(_mod.ORACLE)
