"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams of its lower-cased form, hashed to a fixed number of buckets. Each
bucket is scaled by the logarithm of how much more often it occurs in toxic than in clean training texts; a logistic
regression over the scaled features is fitted on top. Buckets whose ratio says little are left out of the features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normlake.llm.common import crc_id, row_slices, saved, scratch, sent

SIZES = (3, 4, 5)
BITS = 18
MIN_RATIO = 1.0
CLASS_ROWS = 4000  # expected training texts of a class; a larger supply is thinned by a hash of the id
PIECE = 1 << 20


def _buckets(chars: np.ndarray, owners: np.ndarray, pick: np.ndarray | None) -> np.ndarray:
    """owner << BITS | bucket of the n-grams that lie within one owner; only buckets where ``pick`` holds."""
    out, h = [], chars * np.uint32(0x9E3779B1)
    for size in range(2, max(SIZES) + 1):
        h = (h[:-1] + chars[size - 1:]) * np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(13)
        if size in SIZES:
            bucket = ((h * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS)).astype(np.int64)
            keep = owners[size - 1:] == owners[:len(bucket)]
            if pick is not None:
                keep &= pick[bucket]
            out.append(owners[:len(bucket)][keep] << BITS | bucket[keep])
    return np.concatenate(out)


def present(texts: Iterator[str], pick: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct (text number << BITS | bucket). Long texts are read in overlapping pieces."""
    found, parts, owners, size = [], [], [], 0

    def close() -> None:
        nonlocal parts, owners, size
        if parts:
            chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(chars) >= max(SIZES):
                found.append(np.unique(_buckets(chars, np.concatenate(owners), pick)))
        parts, owners, size = [], [], 0

    tail = " " * (max(SIZES) - 1)
    for number, text in enumerate(texts):
        text = f" {text.lower()} {tail}"  # blanks close off the ends, and let short texts have n-grams
        step = PIECE - len(tail)
        for at in range(0, max(1, len(text) - len(tail)), step):
            part = text[at:at + PIECE]
            parts.append(part)
            owners.append(np.full(len(part), number, np.int64))
            size += len(part)
            if size >= PIECE:
                close()
    close()
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _texts(column: pa.Array) -> Iterator[str]:
    return (t.as_py() or "" for t in column)


class ToxicModel:
    """Weights of buckets (log-count ratio times coefficient) and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, texts: Iterator[str], rows: int) -> np.ndarray:
        keys = present(texts, self.weights != 0)
        total = np.bincount(keys >> BITS, self.weights[keys & ((1 << BITS) - 1)], rows) + self.intercept
        return 1.0 / (1.0 + np.exp(-np.clip(total, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, class_rows: int = CLASS_ROWS) -> ToxicModel:
    """A model from the labelled texts (doc_id in both tables, toxic 0 or 1).

    About ``class_rows`` ids of each class are drawn, so the joined sample is bounded; each weighs as many as it stands
    for, so the shares of the classes are those of all labels. An id with several labels counts as toxic if one says so; null ids and labels are left out. Without both classes every score is the share of toxic
    labels, or 0 without any label.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    supply = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    stands = {label: max(1.0, n / class_rows) for label, n in supply.items()}
    share = F.lit(0.0)
    for label, n in supply.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, class_rows / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    drawn = labels.where(draw < share)
    # The sample is bounded by class_rows, so it may be sent to all tasks.
    rows = saved(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text")), f"{folder}/sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 << BITS, np.int64)
        for batch in row_slices(batches, 1):
            toxic = batch.column(0).to_numpy().astype(np.int64)
            keys = present(_texts(batch.column(1)))
            total += np.bincount(toxic[keys >> BITS] << BITS | keys & (1 << BITS) - 1, minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code & (1 << BITS) - 1), pa.array((code >> BITS).astype(np.int32)), pa.array(total[code])], names=["bucket", "toxic", "n"])

    n_class = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n_class) < 2:
        return ToxicModel(np.zeros(1 << BITS), {(): -500.0, (0,): -500.0, (1,): 500.0}[tuple(n_class)])
    counts = rows.mapInArrow(count, "bucket long, toxic int, n long").groupBy("bucket", "toxic").agg(F.sum("n").alias("n")).toArrow()
    bucket, toxic, n = (counts[c].to_numpy() for c in ("bucket", "toxic", "n"))
    share_of = np.empty((2, 1 << BITS))
    for label in (0, 1):
        own = toxic == label
        share_of[label] = (np.bincount(bucket[own], n[own], 1 << BITS) + 1.0) / (n_class[label] + 2.0)
    ratio = np.log(share_of[1] / share_of[0])
    picked = np.flatnonzero(np.abs(ratio) >= MIN_RATIO)
    if not len(picked):
        return ToxicModel(np.zeros(1 << BITS), float(np.log(n_class[1] * stands[1] / (n_class[0] * stands[0]))))
    # The regression sees the picked buckets only, numbered anew.
    place = np.full(1 << BITS, -1, np.int32)
    place[picked] = np.arange(len(picked))
    shared = spark.sparkContext.broadcast((place, ratio[picked]))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, scale = shared.value
        for batch in row_slices(batches, 1):
            keys = present(_texts(batch.column(1)), places >= 0)
            cuts = np.searchsorted(keys >> BITS, np.arange(batch.num_rows + 1))
            order = places[keys & ((1 << BITS) - 1)]
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v)) for v in (order, scale[order])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), *lists], names=["label", "at", "value"])

    width = len(picked)
    vector = F.udf(lambda at, value: Vectors.sparse(width, at, value), VectorUDT())
    made = saved(rows.mapInArrow(features, "label double, at array<int>, value array<double>"), f"{folder}/features")
    weight = F.when(F.col("label") == 1, stands[1]).otherwise(stands[0]).alias("weight")
    fitted = LogisticRegression(maxIter=40, regParam=0.01, standardization=False, weightCol="weight").fit(made.select("label", weight, vector("at", "value").alias("features")))
    weights = np.zeros(1 << BITS)
    weights[picked] = fitted.coefficients.toArray() * ratio[picked]
    return ToxicModel(weights, float(fitted.intercept))


def score(docs: DataFrame, model: ToxicModel, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, score and predicted of every row, empty and null texts included.

    No column but the text plays a part; kept columns that share a name with a result are replaced by it.
    """
    get = sent(docs.sparkSession, model)
    keep = [c for c in keep if c not in ("score", "predicted")]
    at = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in row_slices(batches, at):
            out = own.score(_texts(batch.column(at)), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    read = [] if "text" in keep else [F.col("text").alias("_read")]
    made = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.select(*keep, *read).mapInArrow(run, T.StructType([*[docs.schema[c] for c in keep], *made]))


def held_out_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows by a model that never saw labels of ids whose crc32 is divisible by 5."""
    out = crc_id() % 5 == 0
    found = score(docs, train(docs, labels.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "score", "predicted")
