"""Query catalogue: importing this package registers every query."""

import importlib
import pkgutil

from scanloom.plans.registry import QUERIES, Query, Tables  # noqa: F401

for _m in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_m.name}")
