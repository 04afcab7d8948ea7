"""Finding many fixed strings in many texts (V08 and what uses it).

Every needle is keyed by the eight bytes in it that the fewest other needles hold, so a prefix that thousands of them
share keys none of them. The keys go to the tasks as a bit set of fixed size. A text is tested where it lies, all its
windows in one pass; only windows in the set become rows, each with the bytes around it that the longest needle could
cover. Rows meet needles by an equi-join on the key and are compared in full there: texts are never shuffled or copied.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlake.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

WIDTH = 8  # bytes of a key; shorter needles are keyed by all their bytes
SET_BITS = 26  # of the bit set, as a power of two: 8 MB, whatever the number of needles
STRETCH = 4 << 20  # bytes of text that are tested at a time
HITS = 10_000  # rows of hits in a batch
_MIX = np.uint64(0x9E3779B97F4A7C15)


def windows(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from every position on, packed into one number."""
    n = len(data) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for at in range(width if n > 0 else 0):
        out = out << np.uint64(8) | data[at:at + n].astype(np.uint64)
    return out


def _slots(keys: np.ndarray, width: int) -> np.ndarray:
    return ((keys ^ np.uint64(width)) * _MIX) >> np.uint64(64 - SET_BITS)


def _hits(flat: np.ndarray, bounds: np.ndarray, low: int, high: int, width: int, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, width, key, at) of the windows from ``low`` to before ``high`` that are in the set and end in the text they begin in."""
    key = windows(flat[low:min(high + width - 1, int(bounds[-1]))], width)
    slot = _slots(key, width)
    at = np.flatnonzero(bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
    key, at = key[at].view(np.int64), at + low
    row = np.searchsorted(bounds, at, side="right") - 1
    inside = at + width <= bounds[row + 1]
    return row[inside], np.full(int(inside.sum()), width, np.int32), key[inside], at[inside]


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()


def keyed(needles: DataFrame) -> DataFrame:
    """(needle, secret, width, key, offset): each distinct needle with its rarest key and where in it that stands."""
    rows = needles.where("secret <> ''").select("needle", "secret").distinct().withColumn("own", F.xxhash64("needle", "secret"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, secret in zip(batch.column(0), _bytes(batch.column(1))):
                width = min(len(secret), WIDTH)
                keys, first = np.unique(windows(np.frombuffer(secret, np.uint8), width), return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), own.as_py())), pa.array(np.full(len(keys), width, np.int32)), pa.array(keys.view(np.int64)), pa.array(first.astype(np.int32))],
                    names=["own", "width", "key", "offset"])

    cut_rows = rows.select("own", "secret").mapInArrow(cut, "own long, width int, key long, offset int")
    held = cut_rows.groupBy("width", "key").agg(F.count("*").alias("n"))
    best = cut_rows.join(held, ["width", "key"]).groupBy("own").agg(F.min(F.struct("n", "offset", "width", "key")).alias("best"))
    return rows.join(best, "own").select("needle", "secret", "best.width", "best.key", "best.offset")


def key_set(keys: DataFrame) -> tuple[np.ndarray, list[int], int]:
    """The bit set of all keys, the widths in use, and the bytes of the longest needle."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, key = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            slot = ((key ^ width.astype(np.uint64)) * _MIX) >> np.uint64(64 - SET_BITS)
            mask = np.uint64(1) << (slot & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    found = keys.select("width", "key").mapInArrow(place, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(1 << (SET_BITS - 6), np.uint64)
    words[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    facts = keys.agg(F.collect_set("width"), F.max(F.octet_length("secret"))).first()  # at most eight widths
    return words, sorted(facts[0]), facts[1] or 0


def find(surfaces: DataFrame, needles: DataFrame) -> DataFrame:
    """(surface_id, needle) once for every needle that occurs in a surface, at any byte.

    surfaces(surface_id, payload), needles(needle, secret). Null payloads and null or empty secrets find nothing.
    """
    spark = surfaces.sparkSession
    keys = stored(keyed(needles), "needles")
    words, widths, longest = key_set(keys)
    shared = spark.sparkContext.broadcast((words, widths))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes = shared.value
        for batch in batches:
            ids = batch.column(0)
            payloads = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            _, places, content = payloads.buffers()
            bounds = np.frombuffer(places, np.int64)[payloads.offset:payloads.offset + len(payloads) + 1]
            flat = np.frombuffer(content or b"", np.uint8)
            if not len(payloads):
                continue
            # Numbers of eight bytes stand for each byte, so they are made for a stretch of the texts at a time.
            for low in range(int(bounds[0]), int(bounds[-1]), STRETCH):
                found = [_hits(flat, bounds, low, min(low + STRETCH, int(bounds[-1])), width, bits) for width in sizes]
                row, width, key, at = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4
                for part in range(0, len(row), HITS):
                    of = slice(part, part + HITS)
                    begin, end = np.maximum(bounds[row[of]], at[of] - longest), np.minimum(bounds[row[of] + 1], at[of] + longest)
                    around = [flat[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row[of])), pa.array(width[of]), pa.array(key[of]), pa.array((at[of] - begin).astype(np.int32)), pa.array(around, pa.binary())],
                        names=["surface_id", "width", "key", "at", "around"])

    kind = surfaces.schema["surface_id"].dataType.simpleString()
    found = surfaces.select("surface_id", "payload").mapInArrow(hits, f"surface_id {kind}, width int, key long, at int, around binary")
    both = found.join(keys, ["width", "key"])
    start = F.col("at") - F.col("offset")
    same = (start >= 0) & (F.expr("substring(around, at - offset + 1, octet_length(secret))") == F.col("secret").cast("binary"))
    return both.where(same).select("surface_id", "needle").distinct()
