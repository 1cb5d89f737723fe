"""Similar texts, and poets attributed by neighbours and fingerprints."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import words
from ..functions.vectors import cosine, rhyme_overlap, rounded
from ..lineage import cut
from ..sources.tables import first_per, latest

#: Width of stored vectors.
WIDTH = 384


def vectors(embeddings: DataFrame, width: int = WIDTH) -> DataFrame:
    """(text_id, v): the latest vector of each text, in double precision, if it is of that width and finite. Of equal versions the greatest
    vector, a missing place above any number: it is compared as NaN, which is as little finite."""
    nan = F.lit(float("nan")).cast(embeddings.schema["embedding_vector"].dataType.elementType)
    full = F.array_contains("embedding_vector", nan) == F.lit(False)  # null where a place is
    filled = F.when(full, F.col("embedding_vector")).otherwise(F.transform("embedding_vector", lambda x: F.coalesce(x, nan)))
    v = latest(embeddings.select("text_id", filled.alias("embedding_vector"), "updated_at"), ["text_id"], ["updated_at"])
    fine = F.expr(f"size(embedding_vector) = {width} AND forall(embedding_vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    return v.where("embedding_vector IS NOT NULL").where(fine).select("text_id", F.col("embedding_vector").cast("array<double>").alias("v"))


def _packed(rows: DataFrame, key: str, columns: list[str], size: int, as_: str) -> DataFrame:
    """(as_): arrays of about `size` rows each, by hash of the key: what one task holds at once."""
    n = max(1, -(-rows.count() // size))
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(n))
    return rows.groupBy(part.alias("_part")).agg(F.collect_list(F.struct(key, *columns)).alias(as_)).select(as_)


def by_words(texts: DataFrame, poets: DataFrame, targets: DataFrame, n: int = 10, head: int = 50, form: str = "ghazal", size: int = 2048) -> DataFrame:
    """(target, id, title_urdu, poet_name, score): of each target the n texts of the form with the most words in common: Jaccard index of
    the first `head` words as sets, and a bonus for the same poet; ties by id. targets: (id) of texts.

    All texts are candidates. Targets and texts are held against each other in blocks of about `size` rows: within a pair of blocks, the
    texts of each word are listed, and a target's words are counted through these lists; n of each pair go on.
    """
    rows = cut(texts.select("id", "poet_id", "title_urdu", "form", F.array_distinct(F.slice(words(F.col("text_urdu")), 1, head)).alias("k")).join(poets.select(F.col("id").alias("poet_id"), F.col("name").alias("poet_name")), "poet_id"))
    asked = rows.join(targets.select("id").distinct(), "id", "left_semi")
    pairs = _packed(asked, "id", ["k", "poet_name"], size, "t").crossJoin(_packed(rows.where(F.col("form") == form), "id", ["k", "poet_name"], size, "r"))

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for t, r in zip(b.column("t"), b.column("r")):
                t, r = t.as_py(), r.as_py()
                lists: dict[str, list[int]] = {}
                for i, x in enumerate(r):
                    for w in x["k"] or ():
                        lists.setdefault(w, []).append(i)
                where = {w: np.array(v) for w, v in lists.items()}
                ids, sizes = np.array([x["id"] for x in r]), np.array([len(x["k"] or ()) for x in r])
                names: dict[str | None, int] = {}
                poet = np.array([names.setdefault(x["poet_name"], len(names)) for x in r])
                out: list = [[], [], []]
                for x in t:
                    own = x["k"] or []
                    found = [where[w] for w in own if w in where]
                    both = np.bincount(np.concatenate(found), minlength=len(r)) if found else np.zeros(len(r), int)
                    same = (poet == names.get(x["poet_name"], -1)) & (x["poet_name"] is not None)
                    score = np.minimum(fixed.SHARED_WORDS * (both / np.maximum(len(own) + sizes - both, 1)) + np.where(same, fixed.SAME_POET, 0.0), 1.0)
                    score = np.floor(score * 1000 + 0.5) / 1000
                    best = np.lexsort((ids, -score))
                    best = best[ids[best] != x["id"]][:n]
                    for o, y in zip(out, ([x["id"]] * len(best), ids[best].tolist(), score[best].tolist())):
                        o += y
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["target", "id", "score"])

    best = first_per(pairs.mapInArrow(of, "target long, id long, score double"), ["target"], [F.desc("score"), F.col("id")], n)
    return best.join(rows.select("id", "title_urdu", "poet_name"), "id").select("target", "id", "title_urdu", "poet_name", "score")


def by_vectors(v: DataFrame, targets: DataFrame, n: int, size: int = 2048) -> DataFrame:
    """(a, b, cosine): of each target the n vectors nearest to it, by cosine in double precision, ties by id. targets: (text_id); those
    without a vector are left out. Targets and vectors are held against each other in blocks of about `size`, each pair by one matrix
    product, and n of each pair go on."""
    v = cut(v)
    asked = v.join(targets.select("text_id").distinct(), "text_id", "left_semi")
    pairs = _packed(asked, "text_id", ["v"], size, "t").crossJoin(_packed(v, "text_id", ["v"], size, "r"))

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                (ta, x), (ra, y) = ((c.field("text_id").to_numpy(), c.field("v")) for c in (b.column(k)[i].values for k in ("t", "r")))
                x, y = (m.flatten().to_numpy(zero_copy_only=False).reshape(len(k), -1) for m, k in ((x, ta), (y, ra)))
                c = np.round(x @ y.T / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1)) + 1e-8), 6)
                c[ta[:, None] == ra[None, :]] = -9
                best = np.lexsort((np.broadcast_to(ra, c.shape), -c), axis=1)[:, :n]
                s = np.take_along_axis(c, best, 1)
                ok = s > -9
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ta, ok.sum(1))), pa.array(ra[best][ok]), pa.array(s[ok])], names=["a", "b", "cosine"])

    return first_per(pairs.mapInArrow(of, "a long, b long, cosine double"), ["a"], [F.desc("cosine"), F.col("b")], n).drop("rank")


def pair_similarity(pairs: DataFrame, v: DataFrame) -> DataFrame:
    """(a, b, cosine) of given pairs; 0 where a vector is missing."""
    j = pairs.join(v.select(F.col("text_id").alias("a"), F.col("v").alias("va")), "a", "left").join(v.select(F.col("text_id").alias("b"), F.col("v").alias("vb")), "b", "left")
    return j.select("a", "b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


def explained(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Of pairs (a, b, cosine): the weighted score and its parts, and why. features: one row per text (text_id, radif, qaafiya, theme)."""
    f = lambda s: features.select(F.col("text_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("radif", "qaafiya", "theme")))
    j = pairs.join(f("a"), "a", "left").join(f("b"), "b", "left")
    eq = lambda c: F.coalesce((F.col(f"{c}_a") != "") & (F.col(f"{c}_a") == F.col(f"{c}_b")), F.lit(False))
    w = fixed.EXPLAINED
    parts = {"semantic": F.col("cosine") * w["semantic"], "radif": eq("radif").cast("double") * w["radif"], "qaafiya": rhyme_overlap(F.col("qaafiya_a"), F.col("qaafiya_b")) * w["qaafiya"], "theme": eq("theme").cast("double") * w["theme"]}
    j = j.withColumns(parts)
    score = F.col("semantic") + F.col("radif") + F.col("qaafiya") + F.col("theme")
    lines = [
        F.format_string(fixed.EXPLANATIONS["semantic"], rounded(F.col("cosine"), 2), rounded(F.col("semantic") * 100, 1)),
        F.when(F.col("radif") > 0, F.format_string(fixed.EXPLANATIONS["radif"], F.col("radif_a"))).otherwise(fixed.EXPLANATIONS["no radif"]),
        F.when(F.col("qaafiya") > 0, F.format_string(fixed.EXPLANATIONS["qaafiya"], rounded(F.col("qaafiya") / w["qaafiya"], 2), rounded(F.col("qaafiya") * 100, 1))).otherwise(fixed.EXPLANATIONS["no qaafiya"]),
        F.when(F.col("theme") > 0, F.format_string(fixed.EXPLANATIONS["theme"], F.col("theme_a"))).otherwise(fixed.EXPLANATIONS["no theme"]),
    ]
    return j.select("a", "b", rounded(score, 3).alias("score"), rounded(score * 100, 2).alias("percentage"), *(rounded(F.col(c), 3).alias(c) for c in parts), F.array_join(F.array(*lines), "\n").alias("explanation"))


def poet_by_neighbours(v: DataFrame, texts: DataFrame, poets: DataFrame, features: DataFrame, targets: DataFrame, n: int = 3, prefilter: int = 50) -> DataFrame:
    """(a, poet_id, poet_name, score, examples): of each target (text_id) the n poets whose nearest texts explain best: the mean explained
    score of each poet's texts among the nearest, with two examples."""
    near = by_vectors(v, targets, prefilter)
    scored = cut(explained(near, features).where("score > 0").join(texts.select(F.col("id").alias("b"), "poet_id"), "b").join(poets.select(F.col("id").alias("poet_id"), F.col("name").alias("poet_name")), "poet_id"))
    top = first_per(scored.groupBy("a", "poet_id", "poet_name").agg(rounded(F.avg("score"), 3).alias("score")), ["a"], [F.desc("score"), F.col("poet_id")], n).drop("rank")
    two = first_per(scored, ["a", "poet_id"], [F.desc("score"), F.col("b")], 2).groupBy("a", "poet_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"].cast("string")), ",").alias("examples"))
    return top.join(two, ["a", "poet_id"])


def centroids(v: DataFrame, key: str, width: int = WIDTH, held: int = 20_000) -> DataFrame:
    """(key, centroid): the mean of the vectors (key, v) of each key.

    Every task adds whole vectors up by key, `held` keys at a time, so a key with a third of all vectors sends one sum from each task;
    only these sums are taken apart to be added and put together again. Null keys are left out.
    """
    rows = v.where(F.col(key).isNotNull() & F.col("v").isNotNull()).select(F.col(key).cast("long").alias("key"), "v")

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        count: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"key": list(sums), "n": [count[k] for k in sums], "s": list(sums.values())}, schema=pa.schema([("key", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))]))
            sums.clear()
            count.clear()
            return out

        for b in it:
            keys, lists = b.column("key").to_numpy(), b.column("v")
            for i, k in enumerate(keys.tolist()):
                x = lists[i].values.to_numpy(zero_copy_only=False)
                sums[k] = sums[k] + x if k in sums else x.astype(float)
                count[k] += 1
            if len(sums) > held:
                yield flush()
        yield flush()

    parts = rows.mapInArrow(add, "key long, n long, s array<double>").select("key", "n", F.posexplode("s").alias("place", "x"))
    each = parts.groupBy("key", "place").agg((F.sum("x") / F.sum("n")).alias("x"))
    return each.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda y: y["x"]).alias("centroid")).select(F.col("key").cast(v.schema[key].dataType).alias(key), "centroid")


def fingerprints(v: DataFrame, texts: DataFrame, features: DataFrame, n: int = 5) -> DataFrame:
    """(poet_id, centroid, common_radif, metres): each poet's mean vector, n commonest refrains and metre counts, in one job."""
    own = texts.select(F.col("id").alias("text_id"), "poet_id").where("poet_id IS NOT NULL")
    mean = centroids(v.join(own, "text_id"), "poet_id")
    f = features.join(own, "text_id")
    count = f.where("radif IS NOT NULL AND radif <> ''").groupBy("poet_id", "radif").agg(F.count("*").alias("n"))
    top = first_per(count, ["poet_id"], [F.desc("n"), F.col("radif")], n).groupBy("poet_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "radif", "n"))), lambda x: F.struct(x["radif"].alias("radif"), x["n"].alias("n"))).alias("common_radif"))
    metre = f.where("meter_name IS NOT NULL").groupBy("poet_id", "meter_name").agg(F.count("*").alias("n")).groupBy("poet_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("meter_name", "n")))).alias("metres"))
    return mean.join(top, "poet_id", "left").join(metre, "poet_id", "left")


def nearest_means(rows: DataFrame, means: DataFrame, n: int, block: int = 4096, decimals: int = 6, bonus: float = 0.0, scale: float = 1.0, base: float = 0.0) -> DataFrame:
    """(id, mean_id, score, rank): the n means nearest to each row, by scale * cosine + base, plus bonus where the row's tag is one of the
    mean's tags; ties by mean_id. rows: (id, v) and, with a bonus, tag; means: (mean_id, centroid) and tags.

    Means are taken in blocks of `block`, of which one at a time is on the driver; with more than one, rows are stored once for all.
    A batch of rows is held against a block by one matrix product, and only the best n of each block go on.
    """
    if "tag" not in rows.columns:
        rows = rows.withColumn("tag", F.lit(None).cast("string"))
    if "tags" not in means.columns:
        means = means.withColumn("tags", F.array().cast("array<string>"))
    rows, means = rows.where("v IS NOT NULL").select("id", "v", "tag"), cut(means.select("mean_id", "centroid", "tags"))
    blocks, out = max(1, -(-means.count() // block)), None
    rows = cut(rows) if blocks > 1 else rows
    for k in range(blocks):
        part = means.where(F.pmod(F.xxhash64("mean_id"), F.lit(blocks)) == k).orderBy("mean_id").collect()  # a block of means
        if not part:
            continue
        shared = rows.sparkSession.sparkContext.broadcast((np.array([r.mean_id for r in part]), np.array([r.centroid for r in part], float), [r.tags or [] for r in part]))

        def of(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, c, tags = shared.value
            by: dict[str, list[int]] = {}
            for i, ts in enumerate(tags):
                for t in ts:
                    by.setdefault(t, []).append(i)
            m = np.sqrt((c * c).sum(1))
            for b in it:
                if not b.num_rows:
                    continue
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                s = scale * (x @ c.T / (np.sqrt((x * x).sum(1))[:, None] * m + 1e-8)) + base
                for i, t in enumerate(b.column("tag").to_pylist()):
                    if t in by:
                        s[i, by[t]] += bonus
                s = np.round(s, decimals)
                top = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("id").to_numpy(), top.shape[1])), pa.array(ids[top].ravel(), pa.int64()), pa.array(np.take_along_axis(s, top, 1).ravel())], names=["id", "mean_id", "score"])

        found = rows.mapInArrow(of, "id long, mean_id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.select("id", F.lit(None).cast("long").alias("mean_id"), F.lit(0.0).alias("score")).limit(0)
    return first_per(out, ["id"], [F.desc("score"), F.col("mean_id")], n)


def by_fingerprint(v: DataFrame, features: DataFrame, prints: DataFrame, n: int = 3, block: int = 4096) -> DataFrame:
    """(text_id, poet_id, score, rank): the n poets whose fingerprints are nearest to each text (text_id, v)."""
    w = fixed.FINGERPRINT
    t = v.join(features.select("text_id", "radif"), "text_id", "left").select(F.col("text_id").alias("id"), "v", F.col("radif").alias("tag"))
    p = prints.select(F.col("poet_id").alias("mean_id"), "centroid", F.transform(F.coalesce("common_radif", F.array().cast("array<struct<radif:string,n:bigint>>")), lambda x: x["radif"]).alias("tags"))
    return nearest_means(t, p, n, block, 6, w["radif"], w["embedding"], w["vocabulary"] * 0.5).withColumnsRenamed({"id": "text_id", "mean_id": "poet_id"})
