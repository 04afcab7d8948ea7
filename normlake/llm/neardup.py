"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is a ring of five segments. If two fingerprints differ in at most ``radius`` bits, some segment starts a
chain all of whose lengths L keep their cumulative difference within L * radius / 5. Each of the five starts is indexed
by the head of its chain: below a radius of 5 the first segment must agree exactly and the second may differ in one bit,
below 10 the first may differ in one bit. One differing bit is met by letting a fingerprint visit the keys with one of
its set bits cleared, so that exactly one of the two visits the other. Pairs that meet are pruned by the longer chains,
whose last length is the full Hamming check.

Copies collapse before any of this. Near-copies of one text still share keys in great numbers, so a task reports for the
keys it holds only a star per connected group, not all pairs; keys far above the common size are split, their visitors
dealt out and their residents repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlake.llm.common import ascii_lower, per_copy, saved, scratch, space_words, text_of
from normlake.llm.components import components
from normlake.llm.grams import mixed, word_hashes
from normlake.llm.simhash import fingerprint, hex64, shingles, votes

STARTS = 5
WIDTHS = (13, 13, 13, 13, 12)
_OFFSETS = (0, 13, 26, 39, 52)
PAIRS_AT_ONCE = 1 << 20
SKETCH = 8  # numbers of 64 places that sketch a wording's set of shingles


def _wording() -> Column:
    """A key of the words of ``text``: texts of one key have the same shingles of any width."""
    return F.xxhash64(F.concat_ws(" ", space_words(ascii_lower(F.col("text")))))


def fingerprints(docs: DataFrame, width: int = 4, check_width: int | None = None, worded: bool = False) -> DataFrame:
    """(doc_id, digest, copies, fp) of every distinct (doc_id, text): the bitwise majority over its word shingles.

    ``check_width`` adds ``fp2`` over longer shingles, from the same pass; ``worded`` adds ``node``, a key of the words.
    """
    text = docs.select("doc_id", text_of().alias("text"))
    keys = ["doc_id", "digest", *["node"] * worded]
    rows = text.select("doc_id", F.xxhash64("text").alias("digest"), *[_wording().alias("node")] * worded, space_words(ascii_lower(F.col("text"))).alias("_words"))
    copies = F.count_if(F.col("pos") == 0).alias("copies")
    if check_width is None:
        sums = shingles(rows, keys, F.col("_words"), width).groupBy(*keys).agg(copies, *votes())
        return sums.select(*keys, "copies", fingerprint().alias("fp"))
    if check_width < width:
        raise ValueError("check_width must not be below width")
    df = shingles(rows, keys, F.col("_words"), width, check_width)
    whole = F.col("whole").cast("long")
    sums = df.groupBy(*keys).agg(copies, *votes(), *votes(whole, "hash2", "w", "n2"))
    return sums.select(*keys, "copies", fingerprint().alias("fp"), fingerprint("w", "n2").alias("fp2"))


def links(nodes: DataFrame, radius: int, check: int | None = None, key_rows: int = 1 << 16) -> DataFrame:
    """Links (a, b) that connect the same nodes as all pairs of fingerprints within ``radius`` would.

    ``nodes``: distinct (node, fp), or (node, fp, fp2) with ``check``; pairs must then also be within ``check`` bits in fp2.
    """
    if not 0 <= radius < 2 * STARTS:
        raise ValueError("radius must be 0 to 9")
    if check is None:
        nodes = nodes.withColumn("fp2", F.col("fp"))
    seg = [F.shiftrightunsigned("fp", _OFFSETS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1)) for i in range(STARTS)]
    heads = []
    for i in range(STARTS):
        j = (i + 1) % STARTS
        exact, loose, wide = (seg[i], seg[j], WIDTHS[j]) if radius < STARTS else (F.lit(0).cast("long"), seg[i], WIDTHS[i])
        heads.append(F.struct(F.lit(i).alias("start"), F.shiftleft(exact, 13).alias("exact"), loose.alias("loose"), F.lit(wide).alias("wide")))
    heads = nodes.select("node", "fp", "fp2", F.explode(F.array(*heads)).alias("h"))
    heads = heads.select("node", "fp", "fp2", (F.shiftleft(F.col("h.start").cast("long"), 26) + F.col("h.exact")).alias("high"), F.col("h.loose").alias("loose"), F.col("h.wide").alias("wide"))

    coarse = F.col("high") if radius < STARTS else F.col("high") + F.col("loose")
    # Keys far above the common size: at most 5 * 2^13 coarse keys exist, so what is sent to all tasks is bounded.
    sizes = heads.groupBy(coarse.alias("coarse")).agg(F.count("*").alias("rows"))
    above = F.greatest(F.col("rows") - 4.0 * nodes.count() / (1 << 13), F.lit(0.0))
    hot = sizes.select("coarse", (F.floor(above / key_rows) + 1).alias("parts")).where(F.col("parts") > 1)

    none = F.lit(None).cast("long")
    cleared = [F.when((F.col("loose").bitwiseAND(F.lit(1 << b))) != 0, F.col("loose") - (1 << b)).otherwise(none) for b in range(max(WIDTHS))]
    visits = F.transform(F.array_compact(F.array(*cleared)), lambda v: F.struct(v.alias("loose"), F.lit(False).alias("home")))
    seats = F.concat(F.array(F.struct(F.col("loose"), F.lit(True).alias("home"))), visits)
    rows = heads.select("node", "fp", "fp2", "high", F.explode(seats).alias("s")).select("node", "fp", "fp2", "high", F.col("s.loose").alias("loose"), F.col("s.home").alias("home"))
    rows = rows.withColumn("coarse", coarse).join(F.broadcast(hot), "coarse", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    first, last = F.when(F.col("home"), F.lit(0).cast("long")).otherwise(own), F.when(F.col("home"), F.col("parts") - 1).otherwise(own)
    rows = rows.select("node", "fp", "fp2", (F.col("high") + F.col("loose")).alias("key"), "home", own.alias("own"), F.explode(F.sequence(first, last)).alias("part"))
    role = F.when(~F.col("home"), 0).when(F.col("part") == F.col("own"), 2).otherwise(1).cast("byte")
    rows = rows.select("key", "part", role.alias("role"), "node", "fp", "fp2")
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    if check is None:
        rows = rows.drop("fp2")
    return rows.mapInArrow(_Meet(radius, check), "a long, b long").distinct()


class _Meet:
    """Turns sorted (key, part) runs into stars; the last run of a batch waits for the next batch."""

    def __init__(self, radius: int, check: int | None):
        self.radius, self.check = radius, check

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            if not len(cols[0]):
                continue
            key, part = cols[0], cols[1]
            last = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1 if ((key != key[-1]) | (part != part[-1])).any() else 0
            held = [c[last:] for c in cols]
            if last:
                yield from self._stars([c[:last] for c in cols])
        if held is not None and len(held[0]):
            yield from self._stars(held)

    def _stars(self, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, part, role, node, fp = cols[:5]
        new = np.empty(len(key), bool)
        new[0] = True
        new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        run = np.cumsum(new) - 1
        home, visit = np.flatnonzero(role > 0), np.flatnonzero(role != 1)
        homes = np.bincount(run[home], minlength=run[-1] + 1)
        first = np.concatenate([[0], np.cumsum(homes)[:-1]])
        visit = visit[homes[run[visit]] > 0]
        many = homes[run[visit]]
        ends = np.cumsum(many)
        bits = fp.view(np.uint64)
        fp2 = cols[5].view(np.uint64) if self.check is not None else None
        found: list[np.ndarray] = []
        at = 0
        while at < len(visit):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + PAIRS_AT_ONCE, side="right")))
            for lo in range(0, int(many[at]) if to == at + 1 else 1, PAIRS_AT_ONCE):
                if to == at + 1:
                    n = min(int(many[at]) - lo, PAIRS_AT_ONCE)
                    v, h = np.full(n, visit[at]), home[first[run[visit[at]]] + lo + np.arange(n)]
                else:
                    v = np.repeat(visit[at:to], many[at:to])
                    step = np.arange(len(v)) - np.repeat(ends[at:to] - many[at:to] - before, many[at:to])
                    h = home[np.repeat(first[run[visit[at:to]]], many[at:to]) + step]
                keep = node[v] != node[h]
                v, h = v[keep], h[keep]
                ok = self._chained(bits[v] ^ bits[h], key[v] >> 26)
                v, h = v[ok], h[ok]
                if fp2 is not None:
                    ok = np.bitwise_count(fp2[v] ^ fp2[h]) <= self.check
                    v, h = v[ok], h[ok]
                if len(v):
                    found.append(star(node[v], node[h]))
            at = to
            if len(found) > 64:
                found = [star(*np.concatenate(found, axis=1))]
        if found:
            a, b = star(*np.concatenate(found, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def _chained(self, apart: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether the chain from ``start`` stays within its budget at every length."""
        counts = np.stack([np.bitwise_count((apart >> np.uint64(o)) & np.uint64((1 << w) - 1)) for o, w in zip(_OFFSETS, WIDTHS)])
        ok, total, at = np.ones(len(apart), bool), np.zeros(len(apart), np.int64), np.arange(len(apart))
        for length in range(1, STARTS + 1):
            total += counts[(start + length - 1) % STARTS, at]
            ok &= total <= length * self.radius // STARTS
        return ok


def star(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links from every node of the pairs to the smallest node it is connected with."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = index[:len(a)], index[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for side in (u, v, label[u], label[v]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[label[moved]]])


def shared_shingles(docs: DataFrame, width: int) -> DataFrame:
    """(hash, node, size, many): the shingles that two or more wordings hold, the wordings, the number of distinct
    shingles of each and the number of wordings that hold this one. A shingle of one wording is in no intersection."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = word_hashes()
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 256):
                sets = []
                for row in range(lo, min(lo + 256, batch.num_rows)):
                    h = get(texts[row].as_py().encode("utf-8", "surrogatepass").lower().split())
                    sets.append(np.unique(mixed(h, min(width, len(h))) if len(h) else np.zeros(1, np.int64)))
                size = np.array([len(x) for x in sets])
                node = batch.column(0).slice(lo, len(sets)).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(np.repeat(node, size)), pa.array(np.repeat(size, size).astype(np.int32))], names=["hash", "node", "size"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            h, node, size = cols
            own = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])
            h, node, size = h[own], node[own], size[own]
            run = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
            many = np.bincount(run)[run]
            keep = many > 1
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, node, size, many)], names=["hash", "node", "size", "many"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield out([np.concatenate([k, c[:last]]) for k, c in zip(held, cols)] if held else [c[:last] for c in cols])
                held = [c[last:].copy() for c in cols]
            elif held and held[0][0] != cols[0][0]:
                yield out(held)
                held = [c.copy() for c in cols]
            else:
                held = [np.concatenate([k, c]) for k, c in zip(held, cols)] if held else [c.copy() for c in cols]
        if held:
            yield out(held)

    rows = docs.select(text_of().alias("text")).select(_wording().alias("node"), "text").mapInArrow(cut, "hash long, node long, size int")
    return rows.repartition("hash").sortWithinPartitions("hash", "node").mapInArrow(meet, "hash long, node long, size int, many long")


def verified(links: DataFrame, shared: DataFrame, similar: float) -> DataFrame:
    """The links (a, b) whose shingle sets have a Jaccard similarity of ``similar`` or more; ``shared``: see above."""
    left = shared.select(F.col("node").alias("a"), "hash", F.col("size").alias("_a"))
    right = shared.select(F.col("node").alias("b"), "hash", F.col("size").alias("_b"))
    both = links.join(left, "a").join(right, ["b", "hash"]).groupBy("a", "b").agg(F.count("*").alias("n"), F.first("_a").alias("_a"), F.first("_b").alias("_b"))
    return both.where(F.col("n") >= similar * (F.col("_a") + F.col("_b") - F.col("n")) - 1e-9).select("a", "b")


def similar_links(docs: DataFrame, candidates: DataFrame, width: int, similar: float, folder: str) -> DataFrame:
    """Links that connect the same wordings as all pairs at a Jaccard similarity of ``similar`` or more would.

    Two sets that similar share one of the first ``size - ceil(similar * size) + 1`` shingles of each, whatever the
    common order. In order of how many wordings hold a shingle those of one wording come first, so a wording with too
    many of its own has no partner. First ``candidates`` and one star per shingle are verified; then only pairs that
    these leave apart are, so that a large group of near-copies is not compared pair by pair.
    """
    shared = saved(shared_shingles(docs, width), f"{folder}/shared")
    own = Window.partitionBy("node")
    held = F.count("*").over(own)
    first = F.col("size") - F.ceil(similar * F.col("size") - 1e-9) + 1 - (F.col("size") - held)
    # Whether an even or odd number of the wording's shared shingles fall on each of 512 places.
    place = F.col("hash").bitwiseAND(511)
    sketch = [F.bit_xor(F.when(F.shiftright(place, 6) == k, F.expr("shiftleft(1L, cast(hash & 63 as int))")).otherwise(F.lit(0).cast("long"))).over(own).alias(f"_p{k}") for k in range(SKETCH)]
    heads = shared.select("hash", "node", "size", "many", first.alias("_first"), (F.col("size") - held).alias("_alone"), *sketch).where(F.col("_first") > 0)
    heads = heads.withColumn("_turn", F.row_number().over(own.orderBy("many", "hash"))).where(F.col("_turn") <= F.col("_first"))
    heads = saved(heads.select("hash", "node", "size", "_alone", *[f"_p{k}" for k in range(SKETCH)]), f"{folder}/heads")
    stars = heads.join(heads.groupBy("hash").agg(F.min("node").alias("b")), "hash").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b")
    stars = saved(verified(candidates.select("a", "b").unionByName(stars).distinct(), shared, similar), f"{folder}/stars")
    rooted = heads.join(components(stars), "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = saved(rooted, f"{folder}/rooted")
    a, b = heads.alias("a"), heads.alias("b")
    apart = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.root") < F.col("b.root"))
    near = F.least("a.size", "b.size") >= similar * F.greatest("a.size", "b.size") - 1e-9
    # Places that differ are shingles that only one of the two holds, as are those that no other wording holds. Sets of
    # this similarity have few of them, so the bound loses no pair; it keeps texts apart that share a common passage only.
    differ = sum((F.bit_count(F.col(f"a._p{k}").bitwiseXOR(F.col(f"b._p{k}"))) for k in range(SKETCH)), F.col("a._alone") + F.col("b._alone"))
    total = F.col("a.size") + F.col("b.size")
    pairs = a.join(b, apart & near & (differ <= total * (1 - similar) / (1 + similar) + 1e-9)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    return stars.unionByName(verified(pairs, shared, similar))


def near_groups(docs: DataFrame, width: int = 4, radius: int = 4, check_width: int | None = None, check: int | None = None, similar: float | None = None) -> DataFrame:
    """(doc_id, digest, copies, fp, root, component_id): groups of texts whose fingerprints link within ``radius`` bits.

    component_id is the smallest doc_id reachable over links, null only where all ids of a group are null; root names
    the group. With ``check_width`` a second fingerprint over that shingle width has to be within ``check`` bits too. With
    ``similar`` fingerprints only propose: texts link at that Jaccard similarity of their shingles of ``check_width`` words.
    One row for each distinct (doc_id, text), ``copies`` counts its rows; null and empty texts have fingerprint zero and
    link like any other; columns besides doc_id and text are not looked at; an empty table gives an empty table.
    """
    folder = scratch(docs.sparkSession)
    both, worded = check_width is not None, similar is not None
    prints = fingerprints(docs, width, check_width, worded)
    prints = saved(prints if worded else prints.withColumn("node", F.xxhash64("fp", "fp2") if both else F.col("fp")), f"{folder}/prints")
    nodes = prints.select("node", "fp", *["fp2"] * both).distinct()
    found = links(nodes, radius, check if both else None)
    roots = components(similar_links(docs, found, check_width, similar, folder) if worded else found)
    least = prints.groupBy("node").agg(F.min("doc_id").alias("least"))
    ids = saved(least.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), f"{folder}/nodes")
    group = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = ids.join(group, "root").select("node", "root", "component_id")
    return prints.join(ids, "node").select("doc_id", "digest", "copies", "fp", "root", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` with one row left of each near-duplicate group: the smallest id, of equal ids the smallest digest.

    Rows equal in id and text keep the first by their other columns.
    """
    first = near_groups(docs, **options).groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("r"))
    first = first.select(F.xxhash64("r.doc_id", "r.digest").alias("_key"), F.col("r.doc_id").alias("_id"), F.col("r.digest").alias("_digest"))
    rows = docs.withColumn("_own", F.xxhash64(text_of())).withColumn("_key", F.xxhash64("doc_id", "_own"))
    rows = rows.join(first, "_key").where(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest")))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    turn = F.row_number().over(Window.partitionBy("_key", "doc_id", "_own").orderBy(*(others or ["_own"])))
    return rows.withColumn("_turn", turn).where(F.col("_turn") == 1).select(*docs.columns)


def simhash_near_dedup(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; see :func:`near_groups` for odd rows."""
    groups = per_copy(near_groups(docs, width, radius))
    return groups.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
