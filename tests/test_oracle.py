"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os
from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kashida.plans import registry

from .compare import from_duckdb, from_spark

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    assert from_spark(registry.queries()[name](spark, FOLDER)) == from_duckdb(FOLDER, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql(spark, name):
    assert registry.queries()[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", ["radif_by_text", "top_words_by_poet", "stratified_split", "fingerprint_attribution"])
def test_partitions_do_not_matter(spark, name):
    """The same rows whatever the number of shuffle partitions."""
    one = from_spark(registry.queries()[name](spark, FOLDER))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert from_spark(registry.queries()[name](spark, FOLDER)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _written(spark, name, folder, *columns):
    """The query's rows as written, Spark's and DuckDB's, sorted."""
    con = duckdb.connect()
    for t in ("texts", "poetic_features", "ghazal_embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return sorted(map(repr, map(tuple, registry.queries()[name](spark, str(folder)).select(*columns).collect()))), sorted(map(repr, want))


def test_feature_vectors_to_the_sign_of_zero(spark):
    """Equal as written: a negative zero of a stored vector stays one."""
    got, want = _written(spark, "feature_vectors", FOLDER, "text_id", "poet_id", "features")
    assert got == want and any("-0.0," in r for r in got)


def test_feature_vectors_of_equal_versions(spark, tmp_path):
    """A missing place of a vector stands above any number, a missing rhyme word is left out, and lists of words are compared as joined."""
    schema = lambda t: pq.read_schema(f"{FOLDER}/{t}.parquet")
    save = lambda t, rows: pq.write_table(pa.Table.from_pylist(rows, schema(t)), tmp_path / f"{t}.parquet")
    at = datetime(2024, 1, 1)
    save("texts", [{"id": i, "poet_id": 7} for i in range(1, 7)])
    ones = [1.0] * 384
    vectors = [(1, ones), (1, [1.0, None, *ones[2:]]), (2, [2.0, *ones[1:]]), (2, [1.0, None, *ones[2:]]), (3, [float("nan"), None, *ones[2:]]), (3, [float("nan"), 1.0, *ones[2:]]), (4, [1.0, -0.0, *ones[2:]])]
    save("ghazal_embeddings", [{"text_id": i, "embedding_vector": v, "updated_at": at} for i, v in vectors])
    words = [(1, ["a", "z"]), (1, ["a b"]), (2, [None, "z"]), (2, ["b"]), (3, [None]), (3, []), (4, ["b", "a"]), (4, ["b"]), (5, None), (5, [""])]
    save("poetic_features", [{"text_id": i, "radif": "r", "radif_confidence": 0.5, "qaafiya": w, "created_at": at} for i, w in words])
    got, want = _written(spark, "feature_vectors", tmp_path, "text_id", "poet_id", "features")
    assert len(want) == 6 and got == want
