"""All registered queries, gathered from the plan modules."""

from importlib import import_module

_MODULES = ["urls", "pages", "sites", "scoring", "issues", "logs", "streams"]

QUERIES: dict = {}
ORACLE: dict = {}

for _name in _MODULES:
    _mod = import_module(f"doccensus.plans.{_name}_queries")
    QUERIES.update(_mod.QUERIES)
    ORACLE.update(_mod.ORACLE)
