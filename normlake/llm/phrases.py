"""Phrase collocations by SON partitioning: shards are mined completely at lowered support, candidates are counted exactly.

A phrase found ``support`` times in the corpus is found, in at least one of the shards that make up the corpus, as often
as the shard's share of all words asks for; so what is frequent in no shard is frequent nowhere. Shards are dealt by a
hash of the row and mined by all tasks together, word by word, pair by pair, then longer phrases: a phrase is counted in a
shard only where all words and pairs in it are frequent there. Shards are few (each holds a fixed share of the corpus),
because support falls with their number; the work of one shard is spread by Spark, never held by one task.

Between the steps, membership goes to the tasks as a bit set of fixed size. A bit shared by chance lets extra phrases be
counted; it never loses one. Local counts are keyed by 64-bit hashes for the same reason; final counts by the phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normlake.llm.common import row_slices, saved, scratch, sent, text_of
from normlake.llm.grams import mixed

SHARDS = 4
SET_BITS = 27  # bits of the sets sent to tasks, as a power of two
TEXT = 1 << 21  # bytes of text taken apart at a time; their arrays take about thirty times as much
FLUSH = 1 << 22  # occurrences gathered before they are counted
MANY_LANGS = 10_000  # rows up to which the table of languages is sent to tasks
PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")  # ends of pieces as line feeds, tabs as spaces
BASE = np.uint64(0x9E6C63D0876A9A47)  # of the hash of a word's bytes


_powers = np.ones(1, np.uint64)


def powers(size: int) -> np.ndarray:
    global _powers
    while len(_powers) < size:
        _powers = np.concatenate([_powers, _powers * _powers[-1] * BASE])
    return _powers


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in order and how often each stands, by sorting."""
    values = np.sort(values)
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1])[:len(values)])
    return values[start], np.diff(np.append(start, len(values)))


class Words:
    """Hashes of the words of some texts, how many words are left in the piece at each, and a salt by language."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.data = b"\n".join(texts).lower().translate(PLAIN)
        byte = np.frombuffer(self.data, np.uint8)
        inside = (byte != 32) & (byte != 10)
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        size = self.end - self.start
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        terms = (byte[inside].astype(np.uint64) + np.uint64(1)) * powers(int(size.max(initial=1)))[place]
        found = np.add.reduceat(terms, first) if len(first) else np.empty(0, np.uint64)
        found = (found ^ (found >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        self.hashes = found ^ (found >> np.uint64(32))
        names = np.array([xxhash.xxh64_intdigest(x.encode(), 7) for x in langs], np.uint64)
        self.owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.start, side="right")
        self.salt = names[self.owner]
        piece = np.cumsum(byte == 10)[self.start]
        last = np.flatnonzero(np.append(piece[1:] != piece[:-1], True)[:len(piece)]) + 1
        self.left = np.repeat(last, np.diff(last, prepend=0)) - np.arange(len(piece))

    def grams(self, size: int) -> np.ndarray:
        """Hash of the run of ``size`` words that starts at each place, by language; only those inside a piece mean anything."""
        out = mixed(self.hashes, size).view(np.uint64)
        out = (out ^ self.salt[:len(out)]) * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))

    def whole(self, size: int) -> np.ndarray:
        return self.left[:max(len(self.left) - size + 1, 0)] >= size

    def phrase(self, place: int, size: int) -> str:
        return b" ".join(self.data[self.start[place]:self.end[place + size - 1]].split()).decode()


class BitSet:
    """A set of hashes in a fixed number of bits; a shard has its own part of them."""

    def __init__(self, words: np.ndarray, parts: int):
        self.words, self.shift = words, np.uint64((len(words) // parts).bit_length() - 1)

    def holds(self, keys: np.ndarray, part: int = 0) -> np.ndarray:
        slot = (np.uint64(part) << self.shift) + (keys & ((np.uint64(1) << self.shift) - np.uint64(1)))
        return (self.words[slot] >> ((keys >> self.shift) & np.uint64(63)) & np.uint64(1)).astype(bool)


def bit_set(rows: DataFrame, parts: int, bits: int = SET_BITS) -> BitSet:
    """The set of column ``gram`` by column ``part``: one word of bits for each slot, whatever the rows."""
    shift = bits - 6 - (parts - 1).bit_length()
    slot = F.shiftleft(F.col("part").cast("long"), shift) + F.col("gram").bitwiseAND((1 << shift) - 1)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("gram", shift).bitwiseAND(63).cast("int"))
    found = rows.select(slot.alias("slot"), mask.alias("mask")).groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros((1 << shift) * (1 << (parts - 1).bit_length()), np.uint64)
    words[found["slot"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return BitSet(words, 1 << (parts - 1).bit_length())


def _runs(batches: Iterator[pa.RecordBatch], by_shard: bool = True) -> Iterator[tuple[int, list[bytes], list[str]]]:
    """(shard, texts, languages) of runs of rows of bounded size; columns are text, lang and shard."""
    for batch in row_slices(batches, 0, TEXT):
        shard = batch.column(2).to_numpy() * by_shard
        texts, langs = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()
        for s in np.unique(shard).tolist():
            mine = np.flatnonzero(shard == s).tolist()
            yield s, [texts[i] for i in mine], [langs[i] for i in mine]


def local_counts(rows: DataFrame, sizes: tuple[int, ...], frequent: list[tuple[int, Callable[[], BitSet]]]) -> DataFrame:
    """(part, gram, n): occurrences of phrases of ``sizes`` words in each shard, partly summed.

    A phrase is counted where all runs of the sizes in ``frequent`` that it holds are in the sets given. A size of 0 stands
    for the number of words of the shard.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [(size, get()) for size, get in frequent]
        held: dict[int, list[np.ndarray]] = {}
        words: dict[int, int] = {}
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part, arrays in held.items():
                yield _counted(part, *distinct(np.concatenate(arrays)))
            held.clear()

        for shard, texts, langs in _runs(batches):
            own = Words(texts, langs)
            words[shard] = words.get(shard, 0) + len(own.left)
            known = [(size, each.holds(own.grams(size), shard)) for size, each in sets]
            for size in sizes:
                fine = own.whole(size)
                for inner, member in known:
                    for lo in range(size - inner + 1):
                        fine = fine & member[lo:lo + len(fine)]
                held.setdefault(shard, []).append(own.grams(size)[fine])
                waiting += len(held[shard][-1])
            if waiting > FLUSH:
                yield from flush()
                waiting = 0
        yield from flush()
        if 1 in sizes:
            for part, n in words.items():
                yield _counted(part, np.zeros(1, np.uint64), np.array([n]))

    return rows.select("text", "lang", "shard").mapInArrow(run, "part int, gram long, n long")


def _counted(part: int, grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), part, np.int32)), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["part", "gram", "n"])


def exact_counts(rows: DataFrame, candidates: Callable[[], BitSet], longest: int) -> DataFrame:
    """(lang, k, phrase, n): all occurrences of every candidate of 1 to ``longest`` words, and of the words (k 0), partly summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = candidates()
        for _, texts, langs in _runs(batches, by_shard=False):
            own, names = Words(texts, langs), sorted(set(langs))
            code = np.array([names.index(x) for x in langs])[own.owner]
            lang, k, phrase, n = list(names), [0] * len(names), [""] * len(names), np.bincount(code, minlength=len(names)).tolist()
            for size in range(1, longest + 1):
                grams = own.grams(size)
                place = np.flatnonzero(own.whole(size) & wanted.holds(grams))
                place = place[np.argsort(grams[place])]
                start = np.flatnonzero(np.append(True, np.diff(grams[place]) != 0)[:len(place)])
                lang += [names[c] for c in code[place[start]].tolist()]
                k += [size] * len(start)
                phrase += [own.phrase(p, size) for p in place[start].tolist()]
                n += np.diff(np.append(start, len(place))).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(k, pa.int32()), pa.array(phrase, pa.string()), pa.array(n, pa.int64())],
                                             names=["lang", "k", "phrase", "n"])

    return rows.select("text", "lang", "shard").mapInArrow(run, "lang string, k int, phrase string, n long")


def frequent_phrases(docs: DataFrame, support: int = 100, longest: int = 5, shards: int = SHARDS) -> DataFrame:
    """(lang, k, phrase, f) of all phrases of 1 to ``longest`` words found at least ``support`` times in their language.

    The row with k 0 and an empty phrase holds the number of words of a language. Words are runs of characters other than
    space and tab, lower-cased in A-Z, inside pieces that ``.,;:!?`` and 0x0A-0x0D end. Null texts are empty, a null language
    is ``und``, repeated rows count as often as they stand; an empty table gives no rows. Only text, lang and doc_id (to
    deal rows out) are read.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    rows = docs.select(text_of().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"))

    def summed(counts: DataFrame) -> DataFrame:
        return counts.groupBy("part", "gram").agg(F.sum("n").alias("n"))

    words = saved(summed(local_counts(rows, (1,), [])), f"{folder}/words")
    sizes = {r.part: r.n for r in words.where("gram = 0").collect()}  # one row a shard
    total = max(sum(sizes.values()), 1)
    # As often as the shard's share of all words asks for: ceil(support * words of the shard / all words), at least once.
    least = F.lit(1)
    for part, n in sizes.items():
        least = F.when(F.col("part") == part, max(1, -(-support * n // total))).otherwise(least)

    def local(counts: DataFrame, name: str) -> DataFrame:
        return saved(summed(counts).where(F.col("n") >= least).select("part", "gram"), f"{folder}/{name}")

    words = words.where((F.col("gram") != 0) & (F.col("n") >= least)).select("part", "gram")
    word_set = sent(spark, bit_set(words, shards))
    found = [words]
    if longest > 1:
        pairs = local(local_counts(rows, (2,), [(1, word_set)]), "pairs")
        found.append(pairs)
        if longest > 2:
            found.append(local(local_counts(rows, tuple(range(3, longest + 1)), [(2, sent(spark, bit_set(pairs, shards)))]), "longer"))
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    candidates = sent(spark, bit_set(union.select(F.lit(0).alias("part"), "gram"), 1))
    counts = exact_counts(rows, candidates, longest).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f"))
    return saved(counts.where((F.col("f") >= support) | (F.col("k") == 0)), f"{folder}/frequent")


def collocations(docs: DataFrame, support: int = 100, longest: int = 5, top: int = 2000, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best-scored phrases of 2 to ``longest`` words of every language.

    Cutting a phrase in two scores floor(1000 * a * n / (l * r)) from the counts of the phrase, its parts and all words; the
    lowest-scoring cut counts, ties to the earliest. A phrase whose words stand inside a longer frequent one as often as
    alone is dropped. Null texts, languages, repeated rows and empty tables as in :func:`frequent_phrases`.
    """
    counts = frequent_phrases(docs, support, longest, shards)
    words = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    if words.limit(MANY_LANGS + 1).count() <= MANY_LANGS:
        words = F.broadcast(words)
    known = counts.where("k > 0").select("lang", "phrase", "f")
    phrases = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    parts = F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))
    inside = phrases.where("k > 2").select("lang", F.explode(parts).alias("phrase"), "a").distinct()
    left = phrases.join(inside.hint("merge"), ["lang", "phrase", "a"], "left_anti")
    cut = left.select("*", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select(
        "*", F.expr("substring_index(phrase, ' ', cut)").alias("before"), F.expr("substring_index(phrase, ' ', cut - k)").alias("after"))
    before, after = known.select("lang", F.col("phrase").alias("before"), F.col("f").alias("l")), known.select("lang", F.col("phrase").alias("after"), F.col("f").alias("r"))
    cut = cut.join(before.hint("merge"), ["lang", "before"]).join(after.hint("merge"), ["lang", "after"]).join(words, "lang")
    wide = [F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r")]
    cut = cut.select("lang", "phrase", "a", "n", "cut", "l", "r", (F.lit(1000).cast("decimal(4,0)") * wide[0] * wide[1]).cast("decimal(38,0)").alias("over"), (wide[2] * wide[3]).cast("decimal(36,0)").alias("under"))
    cut = cut.withColumn("score", F.expr("cast(over div under as bigint)"))
    best = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(support: int = 100, longest: int = 5, top: int = 2000) -> str:
    """The same rows in DuckDB SQL, by counting all runs of words."""
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0b\\x0c\\r]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM words, (SELECT unnest(generate_series(1, {longest})) AS k) WHERE len(w) >= k),
counts AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS p, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= {support}),
cut AS (
  SELECT c.lang, c.p, c.k, c.f AS a, j, l.f AS l, r.f AS r, s.n,
         CAST(1000 AS HUGEINT) * c.f * CAST(s.n AS HUGEINT) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM counts WHERE k > 1) c
  JOIN counts l ON l.lang = c.lang AND l.p = list_slice(c.p, 1, j)
  JOIN counts r ON r.lang = c.lang AND r.p = list_slice(c.p, j + 1, c.k)
  JOIN sizes s ON s.lang = c.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
inner_ones AS (SELECT DISTINCT lang, unnest([list_slice(p, 1, k - 1), list_slice(p, 2, k)]) AS p, f AS a FROM counts WHERE k > 2),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ones i WHERE i.lang = b.lang AND i.p = b.p AND i.a = b.a)),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {top}
"""
