"""Feature vectors, splits, a forest, and the measures of its predictions."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .likeness import nearest_means


def bucket(s: Column, bins: int) -> Column:
    """A number below bins by hash, the same in every process; 0 for null or empty."""
    return F.when(F.coalesce(s, F.lit("")) == "", 0).otherwise(F.conv(F.substring(F.md5(s), 1, 7), 16, 10).cast("long") % bins).cast("double")


def feature_vectors(texts: DataFrame, features: DataFrame, vectors: DataFrame, width: int = 384) -> DataFrame:
    """(text_id, poet_id, features): vector, zero where there is none, and hashed refrain, three rhyme words, metre, theme, and number of
    rhyme words: width + 7 numbers."""
    j = texts.select(F.col("id").alias("text_id"), "poet_id").where("poet_id IS NOT NULL").join(features, "text_id", "left").join(vectors, "text_id", "left")
    v = F.coalesce(F.col("v"), F.array_repeat(F.lit(0.0), width))
    v = F.slice(F.concat(v, F.array_repeat(F.lit(0.0), width)), 1, width)
    q = F.coalesce("qaafiya", F.array().cast("array<string>"))
    extra = [bucket(F.col("radif"), 100), *(bucket(F.get(q, F.lit(i)), 100) for i in range(3)), bucket(F.col("meter_name"), 50), bucket(F.col("theme"), 10), F.size(q).cast("double")]
    return j.select("text_id", "poet_id", F.concat(v, F.array(*extra)).alias("features"))


def feature_name(i: int, width: int = 384) -> str:
    """What a place of the feature vector stands for."""
    if i < width:
        return fixed.FEATURE_GROUPS[min(i * 10 // (width - 4) if width > 4 else 0, 9)]
    return fixed.FEATURES[i - width] if i - width < len(fixed.FEATURES) else f"Feature {i}"


def split(rows: DataFrame, key: str, label: str, parts: int = 5, seed: str = "42") -> DataFrame:
    """rows with test: of every label one in `parts` rows, in the order of a seeded hash, rounded down.

    Rows of a label are put into 256 groups by hash first; only whole groups and one in part are taken, so no task sorts a whole label.
    """
    h = F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string")))
    rows = rows.withColumn("_h", h).withColumn("_g", F.substring("_h", 1, 2))
    groups = rows.groupBy(label, "_g").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.withColumn("_before", before).withColumn("_want", F.floor(F.sum("_n").over(w) / parts))
    j = rows.join(groups, [label, "_g"])
    at = F.row_number().over(Window.partitionBy(label, "_g").orderBy("_h", key))
    return j.withColumn("test", F.col("_before") + at <= F.col("_want")).drop("_h", "_g", "_n", "_before", "_want")


def nearest_centroid(rows: DataFrame, means: DataFrame, key: str, label: str, vector: str, block: int = 4096) -> DataFrame:
    """(key, label, predicted, second, third): the labels of the nearest means by cosine. means: (label, centroid), one row per label.
    Means are sent in blocks of bounded size; a batch of rows is held against a block by one product, and only three of each go on."""
    near = nearest_means(rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")), means.select(F.col(label).cast("long").alias("mean_id"), "centroid"), 3, block, decimals=9)
    top = near.groupBy("id").agg(*(F.max(F.when(F.col("rank") == i, F.col("mean_id"))).cast(means.schema[label].dataType).alias(n) for i, n in enumerate(("predicted", "second", "third"), 1)))
    return rows.select(key, label).join(top.withColumnRenamed("id", key), key, "left")


def confusion(predictions: DataFrame, label: str) -> DataFrame:
    return predictions.groupBy(label, "predicted").agg(F.count("*").alias("n"))


def measures(predictions: DataFrame, label: str) -> DataFrame:
    """Per label: precision, recall, F1, support; all from the confusion counts."""
    c = confusion(predictions, label)
    have = c.groupBy(F.col(label).alias("l")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
    said = c.groupBy(F.col("predicted").alias("l")).agg(F.sum("n").alias("said"))
    j = have.join(said, "l", "full").select("l", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("support", "right", "said")))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = div(F.col("right"), F.col("said")), div(F.col("right"), F.col("support"))
    return j.select(F.col("l").alias(label), "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(div(2 * p * r, p + r), 6).alias("f1"))


def accuracy(predictions: DataFrame, label: str) -> DataFrame:
    """One row: rows, share right at once, share right among three."""
    hit = (F.col(label) == F.col("predicted")).cast("double")
    three = (F.coalesce(F.col(label).isin(F.col("predicted")), F.lit(False)) | F.coalesce(F.col(label) == F.col("second"), F.lit(False)) | F.coalesce(F.col(label) == F.col("third"), F.lit(False))).cast("double")
    return predictions.agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("top1"), F.round(F.avg(three), 6).alias("top3"))


def worst(predictions: DataFrame, label: str, n: int = 5) -> DataFrame:
    """The n labels with the most wrong predictions."""
    return predictions.where(F.col(label) != F.col("predicted")).groupBy(label).agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), label).limit(n)


def train(rows: DataFrame, label: str, vector: str, trees: int = 100, seed: int = 42) -> PipelineModel:
    """A forest on array features; labels are indexed in their order."""
    data = rows.select(F.lpad(F.col(label).cast("string"), 20, "0").alias("_label"), array_to_vector(F.col(vector).cast("array<double>")).alias("_features"))
    index = StringIndexer(inputCol="_label", outputCol="_index", stringOrderType="alphabetAsc", handleInvalid="skip")
    forest = RandomForestClassifier(labelCol="_index", featuresCol="_features", numTrees=trees, seed=seed)
    return Pipeline(stages=[index, forest]).fit(data)


def predict(model: PipelineModel, rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(key, label, predicted, second, third, confidence) by probability; ties by label."""
    labels = F.array(*(F.lit(int(x)) for x in model.stages[0].labels))
    data = rows.select(key, label, F.lpad(F.col(label).cast("string"), 20, "0").alias("_label"), array_to_vector(F.col(vector).cast("array<double>")).alias("_features"))
    p = model.stages[1].transform(data).select(key, label, vector_to_array("probability").alias("p"))
    top = F.slice(F.array_sort(F.transform("p", lambda x, i: F.struct((-x).alias("far"), i.alias("i")))), 1, 3)
    name = lambda i: F.get(labels, F.get("top", F.lit(i))["i"])
    return p.withColumn("top", top).select(key, label, name(0).alias("predicted"), name(1).alias("second"), name(2).alias("third"), (-F.get("top", F.lit(0))["far"]).alias("confidence"))


def save(model: PipelineModel, path: str) -> None:
    """Stores a trained model in place of an older one."""
    model.write().overwrite().save(path)
    _models.pop(path, None)


def load(path: str) -> PipelineModel:
    """A stored model; read once in a process."""
    if path not in _models:
        _models[path] = PipelineModel.load(path)
    return _models[path]


_models: dict[str, PipelineModel] = {}


def top_three(model: PipelineModel, rows: DataFrame, key: str, vector: str, poets: DataFrame) -> DataFrame:
    """(key, predicted_poet_id, confidence, top3, feature_contributions): the three most probable poets of each row with their names and
    probabilities, and the features that weigh most in the model, as JSON. Labels are poet ids; of poets that are unknown none is given."""
    labels = F.array(*(F.lit(int(x)) for x in model.stages[0].labels))
    data = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_features"))
    p = model.stages[1].transform(data).select(key, vector_to_array("probability").alias("p"))
    top = F.slice(F.array_sort(F.transform("p", lambda x, i: F.struct((-x).alias("far"), i.alias("i")))), 1, 3)
    each = p.select(key, F.posexplode(top).alias("at", "x")).select(key, "at", F.get(labels, F.col("x.i")).cast("long").alias("poet_id"), (-F.col("x.far")).alias("probability"))
    named = each.join(poets.select(F.col("id").alias("poet_id"), "name", "name_urdu"), "poet_id")
    best = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "poet_id", "name", "name_urdu", "probability"))).alias("t"))
    weights = json.dumps([{"feature": n, "importance": w} for n, w in importances(model)])
    of = F.transform("t", lambda x: F.struct(x["poet_id"].alias("poet_id"), x["name"].alias("name"), x["name_urdu"].alias("name_urdu"), x["probability"].alias("probability")))
    return best.select(key, F.get("t", F.lit(0))["poet_id"].alias("predicted_poet_id"), F.get("t", F.lit(0))["probability"].alias("confidence"), F.to_json(of).alias("top3"), F.lit(weights).alias("feature_contributions"))


def report(predictions: DataFrame, label: str, names: DataFrame) -> DataFrame:
    """One row: top1, top3, n, per_label (label, name, precision, recall, f1, support) and confusion counts, as stored for display.
    names: (label, name). A row for each label, so its size is that of the labels."""
    per = measures(predictions, label).join(names.select(F.col(label), "name"), label, "left")
    lists = per.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.coalesce("name", F.concat(F.lit("Poet "), F.col(label).cast("string"))).alias("name"), "precision", "recall", "f1", "support"))).alias("per_label"))
    counts = confusion(predictions, label).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "predicted", "n"))).alias("confusion"))
    return accuracy(predictions, label).crossJoin(lists).crossJoin(counts)  # three single rows


def importances(model: PipelineModel, n: int = 3, width: int = 384) -> list[tuple[str, float]]:
    """The n places of greatest importance, by name."""
    v = model.stages[1].featureImportances.toArray()
    return [(feature_name(int(i), width), float(v[i])) for i in (-v).argsort(kind="stable")[:n]]


def missing(texts: DataFrame, predictions: DataFrame) -> DataFrame:
    """The texts that have no stored prediction."""
    return texts.select(F.col("id").alias("text_id")).join(predictions.select("text_id"), "text_id", "left_anti")


def hashed_terms(rows: DataFrame, tokens: str, width: int = 384) -> DataFrame:
    """rows with embedding_vector: hashed and weighted term counts, where no sentence vectors are at hand."""
    tf = HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=width).transform(rows)
    return IDF(inputCol="_tf", outputCol="_idf").fit(tf).transform(tf).withColumn("embedding_vector", vector_to_array("_idf").cast("array<float>")).drop("_tf", "_idf")
