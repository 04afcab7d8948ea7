"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``ORDER`` bytes long with the counts of the bytes that followed them in
its training texts; the statistics are frozen after training. A byte costs -log2 of its share in the longest context
seen; a byte that never followed a context costs an escape there and is looked for in the context one byte shorter, below
the empty context at 8 bits. With T bytes seen after a context, D of them different, a byte seen c times has the
probability c / (T + D) and the escape D / (T + D), without exclusions. A text's code length is the exact sum over all
its bytes, and the language with the shortest code wins.

The cost of a byte depends on it and the ORDER bytes before it, so each tree level is kept as a table from byte n-grams
to costs in all languages, escapes included.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normlake.llm.common import crc_id, row_slices, sent
from normlake.llm.grams import KeyIndex, low_bytes, packed, portions

ORDER = 4
PAD = b"\n" * ORDER
LANG_SHIFT, SIZE_SHIFT = 47, 44
TRAIN_ROWS = 1500  # expected training texts of a language; a larger supply is thinned by a hash of the id
UNKNOWN = "und"


class ContextTrees:
    """Frozen statistics of all languages, from the packed (lang, size, gram) codes of :func:`train` and their counts."""

    def __init__(self, langs: list[str], codes: np.ndarray, counts: np.ndarray):
        self.langs = langs
        self.levels = []
        lang_of, size_of, gram_of = codes >> LANG_SHIFT, codes >> SIZE_SHIFT & 7, (codes & ((1 << SIZE_SHIFT) - 1)).astype(np.uint64)
        below = None
        for size in range(1, ORDER + 2):
            grams = np.unique(gram_of[size_of == size])
            contexts = np.unique(grams >> np.uint64(8))
            gram_index, context_index = KeyIndex(grams), KeyIndex(contexts)
            cost = np.full((len(grams), len(langs)), np.nan, np.float32)
            escape = np.zeros((len(contexts), len(langs)), np.float32)
            for k in range(len(langs)):
                own = (size_of == size) & (lang_of == k)
                at, n = gram_index.find(gram_of[own]), counts[own].astype(float)
                context = context_index.find(grams[at] >> np.uint64(8))
                total = np.bincount(context, n, len(contexts))
                kinds = np.bincount(context, minlength=len(contexts)).astype(float)
                cost[at, k] = -np.log2(n / (total + kinds)[context])
                seen = total > 0
                escape[seen, k] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
            shorter = np.full(cost.shape, 8.0, np.float32) if below is None else below[0][below[1].find(low_bytes(grams, size - 1))]
            missing = np.isnan(cost)
            cost[missing] = (escape[context_index.find(grams >> np.uint64(8))] + shorter)[missing]
            below = cost, gram_index
            self.levels.append((gram_index, cost, context_index, escape))

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length of each text in each language."""
        total = np.zeros((len(texts), len(self.langs)))
        for data, places, owners in portions(iter(texts), ORDER, PAD):
            keys = packed(data, ORDER + 1)[places]
            price = np.zeros((len(keys), len(self.langs)), np.float32)
            left = np.arange(len(keys))
            for size in range(ORDER + 1, 0, -1):
                gram_index, cost, context_index, escape = self.levels[size - 1]
                own = low_bytes(keys[left], size)
                at = gram_index.find(own)
                hit = at >= 0
                price[left[hit]] += cost[at[hit]]
                left, own = left[~hit], own[~hit]
                if not len(left):
                    break
                at = context_index.find(own >> np.uint64(8))
                price[left[at >= 0]] += escape[at[at >= 0]]
            price[left] += 8.0
            first = np.flatnonzero(np.diff(owners, prepend=-1))
            total[owners[first]] += np.add.reduceat(price, first, axis=0, dtype=np.float64)
        return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct packed (lang, size, gram) codes and their counts in the texts of each batch."""
    for batch in row_slices(batches, 1, 4 << 20):
        langs, texts = batch.column(0).to_numpy(), batch.column(1)
        for lang in np.unique(langs):
            own = (texts[int(i)].as_py().encode("utf-8", "surrogatepass") for i in np.flatnonzero(langs == lang))
            for data, places, _ in portions(own, ORDER, PAD, 4 << 20):
                keys = packed(data, ORDER + 1)[places]
                for size in range(1, ORDER + 2):
                    grams, n = np.unique(low_bytes(keys, size), return_counts=True)
                    code = grams.astype(np.int64) | size << SIZE_SHIFT | int(lang) << LANG_SHIFT
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> ContextTrees:
    """Statistics from the rows with a text and a lang. About ``train_rows`` texts of a language are used, whole.

    Languages are a small closed set; the counts of the bounded sample are what the driver gets.
    """
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    supply = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs, share, number = sorted(supply), F.lit(0.0), F.lit(None).cast("long")
    for k, lang in enumerate(langs):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, train_rows / supply[lang]))).otherwise(share)
        number = F.when(F.col("lang") == lang, F.lit(k).cast("long")).otherwise(number)
    draw = F.pmod(F.xxhash64(F.lit("ppm"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    drawn = rows.where(draw < share).select(number.alias("number"), "text")
    counts = drawn.mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return ContextTrees(langs, counts["code"].to_numpy(), counts["n"].to_numpy())


def predict(docs: DataFrame, trees: ContextTrees, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, lang_pred, score and bits_per_byte of every row.

    Score is the share of the predicted language if all are equally likely beforehand. Null texts, texts without a
    letter and all texts of a model without languages get ``und`` with score 0 and null bits. Equal code lengths go to
    the first language by name. Repeated rows stay repeated; no column but the text plays a part; kept columns that
    share a name with a result are replaced by it.
    """
    get = sent(docs.sparkSession, trees)
    keep = [c for c in keep if c not in ("lang_pred", "score", "bits_per_byte")]
    at = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in row_slices(batches, at):
            lettered = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(batch.column(at), lettered)]
            known = np.array([len(t) > 0 for t in texts]) if own.langs else np.zeros(len(texts), bool)
            names, score, rate = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.full(len(texts), np.nan)
            if known.any():
                bits = own.bits(texts)
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(texts)), best]
                share = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
                names[known] = np.array(own.langs, object)[best[known]]
                score[known], rate[known] = share[known], (least / np.maximum([len(t) for t in texts], 1))[known]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(rate, mask=~known)],
                names=[*keep, "lang_pred", "score", "bits_per_byte"])

    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("_lettered")
    read = [] if "text" in keep else [F.col("text").alias("_read")]
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    return docs.select(*keep, *read, lettered).mapInArrow(run, T.StructType([*[docs.schema[c] for c in keep], *made]))


def held_out_language_id(docs: DataFrame) -> DataFrame:
    """Predictions for all rows by trees that never saw the rows whose id's crc32 leaves 1 modulo 3."""
    out = crc_id() % 3 == 1
    found = predict(docs, train(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "bits_per_byte")
