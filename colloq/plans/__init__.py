"""Named queries, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

import importlib
import pkgutil


def modules() -> list:
    """The modules of this package that have queries: ``QUERIES`` and ``SQL``."""
    found = [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__)]
    return [m for m in found if hasattr(m, "QUERIES")]
