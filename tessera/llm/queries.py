"""The op queries: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    from . import op_queries

    return [importlib.import_module(f"{op_queries.__name__}.{m.name}") for m in pkgutil.iter_modules(op_queries.__path__)]


def queries() -> dict[str, Query]:
    return {m.NAME: m.query for m in sorted(_modules(), key=lambda m: m.NUMBER)}


def oracles() -> dict[str, str]:
    return {m.NAME: m.SQL for m in sorted(_modules(), key=lambda m: m.NUMBER) if getattr(m, "SQL", None)}
