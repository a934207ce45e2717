"""Operators for training-data pipelines. ``queries()`` and ``oracle_sql()`` gather those of the op modules."""

from __future__ import annotations

import importlib
import pkgutil
import re


def _modules() -> list:
    names = (m.name for m in pkgutil.iter_modules(__path__) if re.fullmatch(r"op\d+", m.name))
    return [importlib.import_module(f"{__name__}.{x}") for x in sorted(names, key=lambda x: int(x[2:]))]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in _modules() for k, f in m.ORACLE_SQL.items()}
