"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_documents, queries_texts, queries_vectors, sql

_MODULES = (queries_texts, queries_documents, queries_vectors)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {n: f for m in _MODULES for n, f in vars(m).items() if inspect.isfunction(f) and re.match(r"p\d+_", n)}
    return dict(sorted(found.items(), key=lambda x: (int(re.match(r"p(\d+)_", x[0])[1]), x[0])))


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
