"""Trained segment classifier and the checks of its training samples.

Word 1- and 2-grams with their inverse document frequency feed a logistic regression
whose rows are weighted so that every label counts alike. The vocabulary is bounded;
fitting is distributed, the model is a ``PipelineModel`` that saves and loads as one.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, NGram, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import segmented

VOCABULARY, LEAST_DOCS, ROUNDS = 50_000, 2, 200


def with_predictions(df: DataFrame, model: PipelineModel, key: str, text: str, name: str = "predictions") -> DataFrame:
    """``df`` with a map from the content of each code segment of ``text`` to the model's prediction, null where it has none.

    Distinct (key, content) pairs are predicted; ``key`` tells the rows apart.
    """
    code = segmented(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("__t")), F.col("__t"), "__s", classifier=None)
    code = code.select(key, F.explode(F.filter("__s", lambda s: s["type"] == "code")).alias("__c")).select(key, F.col("__c.content").alias("text")).distinct()
    maps = predict(code, model).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("text", "ml_pred"))).alias(name))
    return df.drop(name).join(maps, key, "left")


def intact(folder: str, manifest: str) -> list[str]:
    """What differs between a saved model's files and its manifest (JSON: path below the folder -> {sha256, bytes})."""
    with open(manifest, encoding="utf-8") as f:
        known = json.load(f)
    found = manifest_of(folder)
    return [f"{p}: {'missing' if p not in found else 'not in the manifest' if p not in known else 'changed'}" for p in sorted({*known, *found}) if known.get(p) != found.get(p)]


def manifest_of(folder: str) -> dict[str, dict]:
    """SHA-256 and size of every file of a saved model."""
    out = {}
    for path in sorted(Path(folder).rglob("*")):
        if path.is_file():
            with path.open("rb") as f:
                out[path.relative_to(folder).as_posix()] = {"sha256": hashlib.file_digest(f, "sha256").hexdigest(), "bytes": path.stat().st_size}
    return out


def load_trusted(folder: str, manifest: str, root: str) -> PipelineModel | None:
    """The saved model, where it lies below ``root`` and is as its manifest says; None where there is none."""
    if not Path(folder).exists():
        return None
    if not Path(folder).resolve().is_relative_to(Path(root).resolve()):
        raise ValueError(f"{folder} isn't below {root}")
    if wrong := intact(folder, manifest):
        raise ValueError("; ".join(wrong))
    return PipelineModel.load(folder)


def balanced(samples: DataFrame, label: str) -> DataFrame:
    """``samples`` with ``weight``: rows over labels times the label's rows."""
    counts = samples.groupBy(label).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"), F.count("*").alias("__labels"))
    weights = counts.join(F.broadcast(total)).select(label, (F.col("__all") / (F.col("__labels") * F.col("__n"))).alias("weight"))
    return samples.join(F.broadcast(weights), label)


def train(samples: DataFrame, text: str = "text", label: str = "label") -> PipelineModel:
    """A model that adds ``prediction_label`` and ``probability`` to rows with ``text``; rows that lack either field are left out."""
    rows = balanced(samples.select(F.col(text).alias("text"), F.col(label).alias("label")).where("text is not null and label is not null"), "label")
    index = StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc").fit(rows)
    words = RegexTokenizer(inputCol="text", outputCol="__w1", gaps=False, pattern=r"(?U)\b\w\w+\b")
    count = lambda n: CountVectorizer(inputCol=f"__w{n}", outputCol=f"__c{n}", vocabSize=VOCABULARY // 2, minDF=LEAST_DOCS)
    stages = [
        words,
        NGram(n=2, inputCol="__w1", outputCol="__w2"),
        count(1),
        count(2),
        VectorAssembler(inputCols=["__c1", "__c2"], outputCol="__c"),
        IDF(inputCol="__c", outputCol="__i"),
        Normalizer(inputCol="__i", outputCol="__x"),
        LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="weight", predictionCol="__p", rawPredictionCol="__raw", maxIter=ROUNDS, regParam=1e-3),
        IndexToString(inputCol="__p", outputCol="prediction_label", labels=index.labels),
    ]
    return Pipeline(stages=stages).fit(index.transform(rows))


def predict(df: DataFrame, model: PipelineModel, text: str = "text", name: str = "ml_pred") -> DataFrame:
    """``df`` with the predicted label; null text counts as empty."""
    columns = [c for c in df.columns if c != name]
    held = df.select(F.struct(*columns).alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return model.transform(held).select("__row.*", F.col("prediction_label").alias(name))


def accuracy(scored: DataFrame, label: str = "label", name: str = "ml_pred") -> DataFrame:
    """One row: rows, accuracy."""
    return scored.agg(F.count("*").alias("n"), F.avg((F.col(label) == F.col(name)).cast("double")).alias("accuracy"))


def label_stats(samples: DataFrame, by: str = "label") -> DataFrame:
    """(by, n, pct) over all samples."""
    n = samples.groupBy(by).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("__all"))
    return n.join(F.broadcast(total)).select(by, "n", (100.0 * F.col("n") / F.col("__all")).alias("pct"))


def split(samples: DataFrame, share: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and evaluation rows."""
    first, second = samples.randomSplit([share, 1 - share], seed)
    return first, second
