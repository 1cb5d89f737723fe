"""A folder of tables that are written together: each change is one entry of a log, seen whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SCHEMAS
from .tables import insert_missing, latest, upsert


def shaped(df: DataFrame, name: str) -> DataFrame:
    """df with the columns and types of a known table: missing columns null, others left out. Unknown tables stay as they are."""
    if name not in SCHEMAS:
        return df
    have, like = set(df.columns), df.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in like))


class ChangedMeanwhile(RuntimeError):
    """Another writer stored the version that was to be written; nothing of the change is seen."""


class Store:
    """Tables in a folder. Data lie in folders of their own, which are never changed; entry n of the log says which of them make up each
    table in version n. An entry appears by one rename that fails if the entry is there, so a change of several tables is stored whole
    or not at all, readers never see a part of it, and of two writers one is refused. Appending adds a folder and rewrites nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self, name: str) -> object:
        return self._hadoop.Path(f"{self.path}/_log/{name}")

    def version(self) -> int:
        """The number of the last change; 0 before the first."""
        log = self._hadoop.Path(f"{self.path}/_log")
        if not self._fs.exists(log):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def state(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders that make up each table."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._log(f"{version:020d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table, as it was in a version or is now; without rows if nothing was stored."""
        folders = self.state(version).get(name, [])
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        reader = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
        return reader.parquet(*(f"{self.path}/{x}" for x in folders))

    def commit(self, base: int | None = None, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None) -> int:
        """Appends to and replaces tables in one change, and gives its number. base: the version that the rows were computed from; a
        change after it is refused (by default the present one is taken)."""
        base = self.version() if base is None else base
        state = self.state(base)
        for kind, changes in (("append", append or {}), ("replace", replace or {})):
            for name, df in changes.items():
                df, part = shaped(df, name), f"{name}/{uuid.uuid4().hex}"
                df.write.parquet(f"{self.path}/{part}")
                state[name] = [*(state.get(name, []) if kind == "append" else []), part]
        fresh = self._log(f".{uuid.uuid4().hex}")
        out = self._fs.create(fresh)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(fresh.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(self._log(f"{base + 1:020d}.json")), none)
        except Exception as e:
            self._fs.delete(fresh, False)
            raise ChangedMeanwhile(f"version {base + 1} of {self.path}") from e
        return base + 1

    def upserted(self, name: str, new: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
        """The table after new rows are written over those of the same keys."""
        return upsert(self.read(name), shaped(new, name), keys, version)

    def upsert(self, name: str, new: DataFrame, keys: list[str], version: list[str]) -> int:
        """Last write wins, as one change."""
        return self.commit(replace={name: self.upserted(name, new, keys, version)})

    def insert_missing(self, name: str, new: DataFrame, keys: list[str]) -> int:
        """Stores the rows of new whose keys the table lacks."""
        old = self.read(name)
        return self.commit(append={name: insert_missing(old.limit(0), shaped(new, name).join(old.select(*keys).distinct(), keys, "left_anti"), keys)})

    def compact(self, name: str, keys: list[str] | None = None, version: list[str] | None = None) -> int:
        """Puts a table's folders together; with keys, only the latest row of each."""
        rows = self.read(name)
        return self.commit(replace={name: latest(rows, keys, version or []) if keys else rows})
