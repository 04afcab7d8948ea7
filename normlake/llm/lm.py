"""Stupid-backoff scores of a byte n-gram model, computed relationally.

The corpus is counted once: n-grams of ``ORDER`` bytes with their number, summed by n-gram. Shorter n-grams and contexts
are sums of these, so every level is an aggregation of the level above, and the score of every n-gram is found by joins
of the count tables on the n-gram:

    score(w | c) = count(cw) / count(c)        where cw occurs at least MIN_COUNT times
                 = BACKOFF * score(w | c')     otherwise, c' being c without its first byte

and a single byte scores its share of the corpus. Documents are exploded to distinct n-grams with counts, joined to the
scores and summed. N-grams are packed into a long, exact without collisions.

The word model (``score_words``, what the query runs) has n-grams of up to ``WORDS`` words, keyed by 64-bit hashes, and
scores a word after the up to two words before it in its text; a lone word scores its share of all words. Its counts
grow with the input, so no task has them all. A task takes its texts in chunks of a bounded number of words. The
distinct n-grams of a chunk go, sorted and as packed gaps, to the tasks that sum them over all chunks, each a few
parts of the hash space at a time. Those answer with the sums in the order of the question, without the n-grams. Then
the texts are read again and scored by chunks from the answers: the context of an n-gram stands in the same text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normlake.llm.common import per_copy, same_twice, saved, saved_once, scratch, task_count, text_of
from normlake.llm.grams import mixed, packed, portions, word_hashes

ORDER = 5
PAD = b"\n" * (ORDER - 1)
BACKOFF = 0.4
MIN_COUNT = 2
SENT_ROWS = 2_000_000  # a score table up to this size (about 32 MB) is sent to all tasks; a larger one is joined by shuffle
HELD = 1 << 21
WORDS = 3
FREQUENT = 1 << 14  # without effect since no count is sent to all tasks; a test still names it
CHUNK, CHUNK_TEXTS = 8 << 20, 1 << 16  # bytes and texts of a chunk
ROWS = 1024  # of a batch
PARTS = 1 << 12  # of the n-gram space, by the highest bits of the hash
PART_SHIFT = np.uint64(64 - 12)
TEXTS, KEYS, TOTAL = 0, 1, 2


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n): how often every run of ``order`` bytes occurs, texts led by line feeds; null texts are empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            texts = (t.as_py().encode("utf-8", "surrogatepass") for t in batch.column(0))
            for data, places, _ in portions(texts, order - 1, PAD[:order - 1]):
                new, many = np.unique(packed(data, order)[places].astype(np.int64), return_counts=True)
                grams, at = np.unique(np.concatenate([grams, new]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, many]), len(grams)).astype(np.int64)
                if len(grams) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["gram", "n"])
                    grams, n = grams[:0], n[:0]
        if len(grams):
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["gram", "n"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def score_grams(counts: DataFrame, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """(gram, score): the logarithm of the score of the last byte of every counted n-gram after the bytes before it."""
    scores = None
    for size in range(1, order + 1):
        mask = (1 << (8 * size)) - 1
        level = counts if size == order else counts.groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.sum("n").alias("n"))
        context = F.shiftright("gram", 8)
        totals = level.groupBy(context.alias("context")).agg(F.sum("n").alias("total"))
        level = level.withColumn("context", context).join(totals, "context")
        direct = F.log(F.col("n") / F.col("total"))
        if scores is None:
            scores = level.select("gram", direct.alias("score"))
            continue
        shorter = scores.select(F.col("gram").alias("_low"), F.col("score").alias("_shorter"))
        level = level.withColumn("_low", F.col("gram").bitwiseAND(F.lit(mask >> 8))).join(shorter, "_low")
        scores = level.select("gram", F.when(F.col("n") >= min_count, direct).otherwise(F.col("_shorter") + float(np.log(backoff))).alias("score"))
    return scores


def document_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, digest, gram, n) of every text's distinct n-grams, and one row with gram -1 and n 1 for every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for row in range(batch.num_rows):
                grams, n = np.array([-1]), np.array([1])
                data_of = iter([texts[row].as_py().encode("utf-8", "surrogatepass")])
                for data, places, _ in portions(data_of, order - 1, PAD[:order - 1]):
                    new, many = np.unique(packed(data, order)[places].astype(np.int64), return_counts=True)
                    grams, n = np.concatenate([grams, new]), np.concatenate([n, many])
                same = pa.array(np.zeros(len(grams), np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1).take(same), batch.column(1).slice(row, 1).take(same), pa.array(grams), pa.array(n)], names=["doc_id", "digest", "gram", "n"])

    text = docs.select("doc_id", text_of().alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("digest", T.LongType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    return text.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(run, schema)


def score_documents(docs: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_bytes, log_score, mean_log_score) of every row, scored by the n-grams of ``corpus`` (default: ``docs``).

    n-grams that the corpus lacks score as if its rarest level had been left: BACKOFF at every level and one in 256
    bytes at the end. Null and empty texts have sum 0 and a null mean. Repeated rows stay repeated; rows that share an id
    but not the text stay apart; columns besides doc_id and text are not read.
    """
    folder = scratch(docs.sparkSession)
    counts = saved(count_grams(docs if corpus is None else corpus), f"{folder}/counts")
    scores = saved(score_grams(counts), f"{folder}/scores")
    if scores.count() <= SENT_ROWS:
        scores = F.broadcast(scores)
    unseen = float((ORDER - 1) * np.log(BACKOFF) - np.log(256))
    rows = document_grams(docs).join(scores, "gram", "left")
    own = F.col("gram") >= 0
    sums = rows.groupBy("doc_id", "digest").agg(
        F.count_if(~own).alias("copies"), F.sum(F.when(own, F.col("n")).otherwise(F.lit(0))).alias("n_bytes"),
        F.sum(F.when(own, F.col("n") * F.coalesce("score", F.lit(unseen))).otherwise(F.lit(0.0))).alias("log_score"))
    sums = sums.withColumns({"n_bytes": F.expr("n_bytes div copies"), "log_score": F.col("log_score") / F.col("copies")})
    mean = F.when(F.col("n_bytes") > 0, F.col("log_score") / F.col("n_bytes"))
    return per_copy(sums.select("doc_id", "n_bytes", "log_score", mean.alias("mean_log_score"), "copies"))


def _runs_of(h: np.ndarray, sizes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, places of their last words) of the runs of each length up to ``order`` inside texts of ``sizes`` words laid one after another."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = []
    for size in range(1, order + 1):
        last = np.flatnonzero(place >= size - 1)
        out.append((mixed(h, size)[last - (size - 1)].view(np.uint64), last))
    return out


def _planes(values: np.ndarray) -> np.ndarray:
    """The bytes of numbers by significance, lowest first: those that hardly vary stand together and pack well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)


def _pack(planes: np.ndarray) -> bytes:
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, n * width, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def _pack_keys(planes: np.ndarray) -> bytes:
    """Gaps between sorted hashes: the low five bytes are as good as random and stay as they are."""
    return planes[:5].tobytes() + _pack(planes[5:])


def _unpack_keys(data: bytes, n: int, part: int) -> np.ndarray:
    raw = data[:5 * n] + pa.decompress(data[5 * n:], 3 * n, codec="zstd", asbytes=True)
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(gaps, dtype=np.uint64) + (np.uint64(part) << PART_SHIFT)


def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], pa.Array]]:
    """(number, texts, ids) of each run of a task's rows of about ``CHUNK`` bytes; the same rows give the same runs."""
    task, made, held = TaskContext.get().partitionId(), 0, 0
    texts: list[bytes] = []
    ids: list[pa.Array] = []
    for batch in batches:
        start = 0
        for row, text in enumerate(batch.column(1)):
            texts.append(text.as_py().encode("utf-8", "surrogatepass"))
            held += len(texts[-1])
            if held >= CHUNK or len(texts) >= CHUNK_TEXTS:
                ids.append(batch.column(0).slice(start, row + 1 - start))
                yield (task << 32) + made, texts, pa.concat_arrays(ids)
                texts, ids, held, start, made = [], [], 0, row + 1, made + 1
        if start < batch.num_rows:
            ids.append(batch.column(0).slice(start))
    if texts:
        yield (task << 32) + made, texts, pa.concat_arrays(ids)


def _hashed(texts: list[bytes], get: Callable[[list[bytes]], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, one text after another, and the number of words of each text."""
    words = [get(t.lower().split()) for t in texts]
    return np.concatenate(words), np.array([len(w) for w in words], np.int64)


def _asked(docs: DataFrame, order: int, counted: bool, asks: bool) -> DataFrame:
    """(part, chunk, kind, n, keys, counts): the distinct n-grams of each chunk of texts, in rows for the parts of their space.

    A row of kind KEYS has a chunk's n-grams of one part, sorted, with their numbers in the chunk where they are
    ``counted``; then one row of kind TOTAL says how many words the chunk has. Chunks that do not ask for counts are -1.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = word_hashes()
        for chunk, texts, _ in _in_chunks(batches):
            h, sizes = _hashed(texts, get)
            rows: list[tuple] = [(0, TOTAL, len(h), None, None)] if counted else []
            keys = np.concatenate([g for g, _ in _runs_of(h, sizes, order)])
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
            n = np.diff(np.append(first, len(keys))).astype(np.uint32)
            keys = keys[first]
            part = (keys >> PART_SHIFT).astype(np.int64)
            begin = np.flatnonzero(np.diff(part, prepend=-1))
            gaps = np.diff(keys, prepend=np.uint64(0))
            gaps[begin] = keys[begin] & np.uint64((1 << int(PART_SHIFT)) - 1)
            gaps, n = _planes(gaps), _planes(n)
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(keys)]):
                rows.append((int(part[lo]), KEYS, hi - lo, _pack_keys(gaps[:, lo:hi]), _pack(n[:, lo:hi]) if counted else None))
            for lo in range(0, len(rows), ROWS):
                to, kind, many, a, b = zip(*rows[lo:lo + ROWS])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array([chunk if asks else -1] * len(to), pa.int64()), pa.array(kind, pa.int8()), pa.array(many, pa.int64()),
                     pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["part", "chunk", "kind", "n", "keys", "counts"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "part int, chunk long, kind byte, n long, keys binary, counts binary")


def _answered(asked: DataFrame) -> DataFrame:
    """(part, chunk, kind, n, sums): n-grams are summed over all counted chunks; every chunk gets the sums of its own, in its order.

    Rows of kind TOTAL pass. The rows come by part, and a task holds those of one part at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(part: int, kind: int, rows: list[tuple]) -> pa.RecordBatch:
            chunk, n, data = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int32()), pa.array(chunk, pa.int64()), pa.array([kind] * len(rows), pa.int8()), pa.array(n, pa.int64()),
                 pa.array(data, pa.binary())], names=["part", "chunk", "kind", "n", "sums"])

        def answer(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([_unpack_keys(data, n, part) for _, n, data, _ in rows])
            n = np.concatenate([np.zeros(n, np.uint32) if data is None else _unpack(data, n, np.uint32) for _, n, _, data in rows])
            _, at = np.unique(keys, return_inverse=True)
            sums, ends = np.bincount(at, n).astype(np.uint64)[at], np.cumsum([n for _, n, _, _ in rows])
            out = [(chunk, many, _pack(_planes(sums[end - many:end]))) for (chunk, many, _, _), end in zip(rows, ends) if chunk >= 0]
            for lo in range(0, len(out), ROWS):
                yield made(part, KEYS, out[lo:lo + ROWS])

        held, part = [], -1
        for batch in batches:
            parts, chunks, kinds, many = (batch.column(c).to_pylist() for c in range(4))
            for row in range(batch.num_rows):
                if kinds[row] == TOTAL:
                    yield made(parts[row], TOTAL, [(chunks[row], many[row], None)])
                    continue
                if parts[row] != part:
                    if held:
                        yield from answer(part, held)
                    held, part = [], parts[row]
                held.append((chunks[row], many[row], batch.column(4)[row].as_py(), batch.column(5)[row].as_py()))
        if held:
            yield from answer(part, held)

    return asked.mapInArrow(run, "part int, chunk long, kind byte, n long, sums binary")


def _texts(docs: DataFrame) -> DataFrame:
    """(part, chunk, kind, n, sums, sizes, ids): the texts of each chunk, packed, as rows like those that answer it."""
    schema = T.StructType([T.StructField(c, t) for c, t in (
        ("part", T.IntegerType()), ("chunk", T.LongType()), ("kind", T.ByteType()), ("n", T.LongType()), ("sums", T.BinaryType()),
        ("sizes", T.ArrayType(T.LongType())), ("ids", T.ArrayType(docs.schema["doc_id"].dataType)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts, ids in _in_chunks(batches):
            whole = b"".join(texts)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int32()), pa.array([chunk], pa.int64()), pa.array([TEXTS], pa.int8()), pa.array([len(whole)], pa.int64()),
                 pa.array([pa.compress(whole, codec="zstd", asbytes=True)], pa.binary()), one(pa.array([len(t) for t in texts], pa.int64())), one(ids)], names=schema.names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def score_words(docs: DataFrame, corpus: DataFrame | None = None, order: int = WORDS, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every row, scored by the word n-grams of ``corpus`` (default: ``docs``).

    Words are what lies between blanks, A-Z lower-cased. A word that the corpus lacks counts as one in all its words and
    one more. Null texts and texts without words have sum 0 and a null mean. Every row is scored by itself, whatever rows share its id.
    """
    folder = scratch(docs.sparkSession)
    if not same_twice(docs):
        docs = saved_once(docs.select("doc_id", "text"), f"{folder}/docs")
    asked = _asked(docs, order, corpus is None, True)
    if corpus is not None:
        asked = asked.unionByName(_asked(corpus.select(F.lit(0).alias("doc_id"), "text"), order, True, False))
    width = max(task_count(rows) for rows in (docs, corpus) if rows is not None)
    answers = saved_once(_answered(asked.repartition(width, "part").sortWithinPartitions("part")), f"{folder}/answers")
    total = answers.where(F.col("kind") == TOTAL).agg(F.sum("n")).first()[0] or 0
    unknown, step = -float(np.log(total + 1)), float(np.log(backoff))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = word_hashes()

        def score(texts: tuple, answered: list[tuple]) -> pa.RecordBatch:
            size, data, lengths, ids = texts
            whole = pa.decompress(data, size, codec="zstd", asbytes=True) if size else b""
            ends = np.cumsum(lengths).tolist()
            h, sizes = _hashed([whole[a:b] for a, b in zip([0, *ends], ends)], get)
            found = _runs_of(h, sizes, order)
            keys, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            asked_of = np.bincount((keys >> PART_SHIFT).astype(np.int64), minlength=PARTS)
            if asked_of[asked_of > 0].tolist() != [many for many, _ in answered]:
                raise RuntimeError("a chunk's texts differ from those that were counted: the rows changed between two readings")
            counts = np.concatenate([np.empty(0), *(_unpack(sums, many, np.uint64).astype(np.float64) for many, sums in answered)])
            n = len(h)
            own = counts[at[:n]]
            value = np.full(n, unknown)
            value[own > 0] = np.log(own[own > 0] / total) if total else unknown
            low, context = n, own
            for g, last in found[1:]:
                own = np.zeros(n)
                own[last] = counts[at[low:low + len(g)]]
                low += len(g)
                seen = last[own[last] >= min_count]
                value[last] += step
                value[seen] = np.log(own[seen] / context[seen - 1])
                context = own
            sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), value, len(sizes)).astype(np.float64)  # integers where nothing is summed
            mean = pa.array(np.divide(sums, sizes, out=np.zeros(len(sizes)), where=sizes > 0), mask=sizes == 0)
            return pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(sums), mean], names=["doc_id", "n_words", "log_score", "mean_log_score"])

        texts, answered = None, []
        for batch in batches:
            kinds, many = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for row in range(batch.num_rows):
                if kinds[row] == TEXTS:  # the first row of its chunk
                    if texts is not None:
                        yield score(texts, answered)
                    texts, answered = (many[row], batch.column(4)[row].as_py(), batch.column(5)[row].values.to_numpy(), batch.column(6)[row].values), []
                else:
                    answered.append((many[row], batch.column(4)[row].as_py()))
        if texts is not None:
            yield score(texts, answered)

    made = [T.StructField(c, t) for c, t in (("n_words", T.LongType()), ("log_score", T.DoubleType()), ("mean_log_score", T.DoubleType()))]
    rows = _texts(docs).unionByName(answers.where(F.col("kind") == KEYS), allowMissingColumns=True)
    rows = rows.repartition(width, "chunk").sortWithinPartitions("chunk", "kind", "part")
    return rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], *made]))
