"""All queries of this subpackage, by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archive, poetry, stored

_MODULES = (archive, poetry, stored)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for m in _MODULES for n, f in vars(m).items() if inspect.isfunction(f) and f.__module__ == m.__name__ and not n.startswith("_")}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in _MODULES for n, s in m.SQL.items()}
