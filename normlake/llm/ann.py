"""Approximate nearest neighbours by largest inner product: cross-polytope hashing with multiprobe tables.

Rows are lifted onto the unit sphere (divided by the largest norm, the missing length as one more coordinate), so that
the largest inner product is the smallest angle. A table turns the sphere by three rounds of random signs and a fast
Hadamard transform; a row's cell is its nearest signed axis, and a query visits its nearest axes first. How many axes it
visits is fitted on a bounded sample of queries against exact results, to a wanted recall.

Cells are dealt to groups of bounded size; a cell that holds many rows becomes several blocks. A query goes once to every
group with any of its cells. Tasks keep the best per query and group, so what moves grows with the rows, not with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normlake.llm.common import saved, scratch, sent

TABLES = 8
SAMPLE = 256  # queries that the number of visited axes is fitted on
RECALL = 0.97  # wanted on the sample
BLOCK = 1 << 15  # rows of a cell's block
GROUP = 1 << 17  # rows of a group, on average
TIES = 1e-9  # scores of matrix products may be off by less; equal ones are told apart by an exact sum


def _signs(table: int, size: int) -> np.ndarray:
    return np.random.default_rng([table, size]).choice([-1.0, 1.0], (3, size))


def signed_axes(x: np.ndarray, table: int) -> np.ndarray:
    """Closeness of each row to every signed axis after the turn of ``table``."""
    size = 1 << int(x.shape[1] - 1).bit_length()
    turned = np.zeros((len(x), size))
    turned[:, :x.shape[1]] = x
    for signs in _signs(table, size):
        turned *= signs
        step = 1
        while step < size:
            pairs = turned.reshape(len(x), -1, 2, step)
            turned = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), size)
            step *= 2
        turned /= np.sqrt(size)
    return np.concatenate([turned, -turned], 1)


def lifted(x: np.ndarray, norm: np.ndarray, largest: float) -> np.ndarray:
    """Rows on the unit sphere, where the angle to a lifted query falls as the inner product rises."""
    share = norm / largest
    return np.concatenate([x / largest, np.sqrt(np.maximum(0.0, 1 - share * share))[:, None]], 1)


def cells_of(x: np.ndarray, norm: np.ndarray, largest: float) -> np.ndarray:
    """The cell of each row in every table."""
    unit = lifted(x, norm, largest)
    return np.stack([signed_axes(unit, t).argmax(1) for t in range(TABLES)], 1)


def visits_of(q: np.ndarray, norm: np.ndarray, most: int) -> np.ndarray:
    """The cells that each query visits in every table, nearest first: (queries, tables, axes)."""
    unit = np.concatenate([q / norm[:, None], np.zeros((len(q), 1))], 1)
    order = [signed_axes(unit, t) for t in range(TABLES)]
    return np.stack([np.argsort(-axes, 1, kind="stable")[:, :most] for axes in order], 1)


def numbered(cells: np.ndarray, length: int) -> np.ndarray:
    """Axes of the tables (rows x tables, or rows x tables x axes) as cell numbers; other lengths have other cells."""
    table = np.arange(TABLES).reshape((1, TABLES) + (1,) * (cells.ndim - 2))
    return np.int64(length) << 40 | table.astype(np.int64) << 32 | cells


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values in a row, and where each list starts and ends."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy() - column.offsets[0].as_py()


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in a batch."""
    values, offsets = _matrix(column)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, values[offsets[rows][:, None] + np.arange(size)]


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, vector, norm) of all rows that can take part; every row, repeated ones too, has a number of its own."""
    spark = vectors.sparkSession
    value = F.col("embedding")
    fine = value.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(value, lambda x: x != 0)
    norm = F.sqrt(F.aggregate(value, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = vectors.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), value.alias("vector"), norm.alias("norm"))
    return saved(rows, f"{scratch(spark)}/vectors")


class Best:
    """The best rows of each of a run of queries so far; keeps ties of the last place."""

    def __init__(self, queries: int, top: int):
        self.top, self.floor = top, np.full(queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def offer(self, queries: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        """A block of scores: one line for each query, one column for each row."""
        i, j = np.nonzero(scores >= self.floor[queries][:, None])
        self.held.append((queries[i], rows[j], scores[i, j]))
        self.size += len(i)
        if self.size > 1 << 19:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, r, s = (np.concatenate(x) if self.held else np.empty(0, int) for x in (zip(*self.held) if self.held else ((), (), ())))
        if len(q):
            # A row met in several tables counts once, else it would push others out.
            order = np.lexsort((r, q))
            q, r, s = q[order], r[order], s[order]
            first = np.append(True, (np.diff(q) != 0) | (np.diff(r) != 0))
            q, r, s = q[first], r[first], s[first]
            order = np.lexsort((-s, q))
            q, r, s = q[order], r[order], s[order]
            begin = np.flatnonzero(np.diff(q, prepend=-1))
            place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
            last = place == self.top - 1
            self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last] - TIES)
            keep = s >= self.floor[q]
            q, r, s = q[keep], r[keep], s[keep]
        self.held, self.size = [(q, r, s)], 0
        return q, r, s


def _ranked(best: Best, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of at most ``top`` rows a query, by exact sums in one order; ties to the smaller id."""
    q, r, _ = best.settle()
    parts = [(queries[q[lo:lo + 4096]] * vectors[r[lo:lo + 4096]]).sum(1) for lo in range(0, len(q), 4096)]
    score = np.concatenate(parts) if parts else np.empty(0)
    order = np.lexsort((rows[r], ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    begin = np.flatnonzero(np.diff(q, prepend=-1))
    place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    keep = place < best.top
    return q[keep], r[keep], score[keep]


NO_ID = np.iinfo(np.int64).max  # stands for a null id, which comes last among ties


def _numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def exact(points: DataFrame, sample: list[tuple[int, np.ndarray]], top: int) -> DataFrame:
    """(query, place, row, vector, norm): the nearest of all rows to each of a bounded list of (row number, vector)."""
    get = sent(points.sparkSession, sample)
    schema = f"query int, score double, vec_id long, row long, norm double, vector {points.schema['vector'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = get()
        for whole in batches:
            for batch in row_slices_of(whole):
                rows, ids = batch.column(0).to_numpy(), _numbers(batch.column(1))
                for at, matrix in _by_length(batch.column(2)):
                    mine = np.array([i for i, (_, v) in enumerate(asked) if len(v) == matrix.shape[1]], int)
                    if not len(mine):
                        continue
                    queries = np.stack([asked[i][1] for i in mine])
                    scores = queries @ matrix.T
                    scores[np.array([asked[i][0] for i in mine])[:, None] == rows[at][None, :]] = np.nan
                    best = Best(len(mine), top)
                    best.offer(np.arange(len(mine)), np.arange(len(at)), scores)
                    q, r, score = _ranked(best, queries, matrix, ids[at], rows[at])
                    take = pa.array(at[r])
                    yield pa.RecordBatch.from_arrays([pa.array(mine[q].astype(np.int32)), pa.array(score), *[batch.column(k).take(take) for k in (1, 0, 3, 2)]],
                                                     names=["query", "score", "vec_id", "row", "norm", "vector"])

    found = points.select("row", "vec_id", "vector", "norm").mapInArrow(run, schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("score", "vec_id")


def row_slices_of(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def is_query(every: int) -> F.Column:
    return F.col("vec_id") % every == 0


def fitted_visits(points: DataFrame, largest: float, every: int, top: int, recall: float = RECALL, sample: int = SAMPLE) -> int:
    """The least number of axes that finds ``recall`` of the exact neighbours of a sample of queries."""
    drawn = points.where(is_query(every)).select("row", "vector", "norm").orderBy(F.xxhash64("row"), "row").limit(sample).collect()
    if not drawn:
        return 1
    asked = [(r.row, np.array(r.vector, np.float64)) for r in drawn]
    near = exact(points, asked, top).collect()
    if not near:
        return 1
    by_size: dict[int, list] = {}
    for r in near:
        by_size.setdefault(len(r.vector), []).append(r)
    needed = []
    for rows in by_size.values():
        cells = cells_of(np.array([r.vector for r in rows], np.float64), np.array([r.norm for r in rows]), largest)
        used = sorted({r["query"] for r in rows})
        order = visits_of(np.stack([asked[i][1] for i in used]), np.array([drawn[i].norm for i in used]), 1 << 30)
        place = np.argsort(order, 2)  # where each axis stands in a query's order
        at = np.searchsorted(used, [r["query"] for r in rows])
        needed.append(place[at[:, None], np.arange(TABLES)[None, :], cells].min(1) + 1)
    return int(np.quantile(np.concatenate(needed), recall, method="inverted_cdf"))


def nearest(vectors: DataFrame, every: int = 20, top: int = 20, visits: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows with the largest inner product, for all rows whose id is divisible by ``every``.

    A query's own row is no candidate; other rows with its id are, and every repeated query row has its own results, so
    all rows of an id with ``copies`` rows appear that often. Vectors that are null, empty, zero or hold null or
    non-finite components take no part; vectors of different lengths are no candidates of each other. Rows with a null id
    are candidates only and come last among ties. Columns besides vec_id and embedding are not read; an empty table gives
    no rows. ``visits`` sets the axes visited in each table; it is fitted where it is not given.
    """
    spark = vectors.sparkSession
    points = usable(vectors)
    largest = points.agg(F.max("norm")).first()[0] or 1.0
    visits = visits or fitted_visits(points, largest, every, top)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices_of(whole):
                norm, codes = batch.column(3).to_numpy(), np.zeros((batch.num_rows, TABLES), np.int64)
                for at, matrix in _by_length(batch.column(2)):
                    codes[at] = numbered(cells_of(matrix, norm[at], largest), matrix.shape[1])
                offsets = pa.array(np.arange(0, codes.size + 1, TABLES), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))], names=["row", "vec_id", "vector", "norm", "cells"])

    kind = points.schema["vector"].dataType.simpleString()
    base = f"row long, vec_id long, vector {kind}, norm double, cells array<long>"
    points = saved(points.select("row", "vec_id", "vector", "norm").mapInArrow(coded, base), f"{scratch(spark)}/cells")
    held = points.select(F.explode("cells").alias("cell")).groupBy("cell").count().toArrow()
    blocks = dict(zip(held["cell"].to_pylist(), (-(-held["count"].to_numpy() // BLOCK)).tolist()))
    groups = max(1, -(-int(held["count"].to_numpy().sum()) // GROUP))
    plan = sent(spark, blocks)
    return _searched(_dealt(points, plan, groups, visits, every, kind), groups, top)


def group_of(cell: np.ndarray, block: np.ndarray, groups: int) -> np.ndarray:
    mixed = (cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((block.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int32)


def _dealt(points: DataFrame, plan, groups: int, visits: int, every: int, kind: str) -> DataFrame:
    """Every row to the groups of its cells' blocks, every query to all groups with a block of a cell that it visits."""
    schema = f"group int, asked boolean, row long, vec_id long, vector {kind}, cells array<long>"

    def emit(batch: pa.RecordBatch, asked: bool, owner: np.ndarray, cell: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((cell, group, owner))
        owner, cell, group = owner[order], cell[order], group[order]
        new = np.append(True, (np.diff(owner) != 0) | (np.diff(group) != 0) | (np.diff(cell) != 0))  # blocks of a cell may share a group
        owner, cell, group = owner[new], cell[new], group[new]
        start = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(group) != 0)))
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(cell)), pa.int32()), pa.array(cell))
        take = pa.array(owner[start])
        return pa.RecordBatch.from_arrays([pa.array(group[start]), pa.array(np.full(len(start), asked)), *[batch.column(k).take(take) for k in range(3)], lists],
                                          names=["group", "asked", "row", "vec_id", "vector", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = plan()
        for whole in batches:
            for batch in row_slices_of(whole, 1024):
                row, cell = batch.column(0).to_numpy().astype(np.uint64), batch.column(4).flatten().to_numpy()
                known, where = np.unique(cell, return_inverse=True)
                many = np.array([blocks[c] for c in known.tolist()], np.int64)[where]
                owner = np.repeat(np.arange(batch.num_rows), TABLES)
                spread = ((row * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.int64)
                yield emit(batch, False, owner, cell, group_of(cell, spread[owner] % many, groups))
                ids = _numbers(batch.column(1))
                picked = np.flatnonzero((ids % every == 0) & (ids != NO_ID))
                if not len(picked):
                    continue
                queries, norm = batch.take(pa.array(picked)), batch.column(3).to_numpy()[picked]
                for at, matrix in _by_length(queries.column(2)):
                    visited = numbered(visits_of(matrix, norm[at], visits), matrix.shape[1])
                    cell, owner = visited.ravel(), np.repeat(at, visited[0].size)
                    known, where = np.unique(cell, return_inverse=True)
                    many = np.array([blocks.get(c, 0) for c in known.tolist()], np.int64)[where]
                    first = np.cumsum(many) - many
                    block = np.arange(int(many.sum())) - np.repeat(first, many)
                    cell, owner = np.repeat(cell, many), np.repeat(owner, many)
                    if len(cell):
                        yield emit(queries, True, owner, cell, group_of(cell, block, groups))

    return points.mapInArrow(run, schema)


class _Group:
    """Rows of one group by length of vector, with the places of each cell's rows."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.sides = {}
        found: dict[int, list] = {}
        for batch in batches:
            rows, ids = batch.column(2).to_numpy(), _numbers(batch.column(3))
            cells, sizes = batch.column(5).flatten().to_numpy(), np.diff(batch.column(5).offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            for at, matrix in _by_length(batch.column(4)):
                place = np.full(batch.num_rows, -1)
                place[at] = np.arange(len(at))
                own = place[owner] >= 0
                found.setdefault(matrix.shape[1], []).append((matrix, rows[at], ids[at], cells[own], place[owner[own]]))
        for length, parts in found.items():
            base = np.cumsum([0] + [len(p[0]) for p in parts])
            cells, where = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] + b for p, b in zip(parts, base)])
            order = np.argsort(cells, kind="stable")
            cells, where = cells[order], where[order]
            names, start = np.unique(cells, return_index=True)
            spans = dict(zip(names.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(cells)])))
            self.sides[length] = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), spans, where

    def search(self, batch: pa.RecordBatch, top: int) -> Iterator[pa.RecordBatch]:
        rows, ids = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        cells, offsets = batch.column(5).flatten().to_numpy(), batch.column(5).offsets.to_numpy()
        offsets = offsets - offsets[0]
        for at, queries in _by_length(batch.column(4)):
            if queries.shape[1] not in self.sides:
                continue
            matrix, own_rows, own_ids, spans, where = self.sides[queries.shape[1]]
            asked = np.repeat(np.arange(len(at)), np.diff(offsets)[at])
            wanted = np.concatenate([cells[offsets[i]:offsets[i + 1]] for i in at.tolist()])
            order = np.argsort(wanted, kind="stable")
            asked, wanted = asked[order], wanted[order]
            names, start = np.unique(wanted, return_index=True)
            best = Best(len(at), top)
            for cell, lo, hi in zip(names.tolist(), start.tolist(), [*start[1:].tolist(), len(wanted)]):
                if cell not in spans:
                    continue
                these, mine = where[slice(*spans[cell])], asked[lo:hi]
                scores = queries[mine] @ matrix[these].T
                scores[rows[at[mine]][:, None] == own_rows[these][None, :]] = np.nan
                best.offer(mine, these, scores)
            q, r, score = _ranked(best, queries, matrix, own_ids, own_rows)
            shown = pa.array(own_ids[r], mask=own_ids[r] == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(rows[at][q]), pa.array(ids[at][q]), pa.array(own_rows[r]), shown, pa.array(score)],
                                             names=["query_row", "query_id", "row", "vec_id", "score"])


def _searched(dealt: DataFrame, groups: int, top: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, group = None, [], None
        for batch in batches:
            number, asked = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, (np.diff(number) != 0) | (asked[1:] != asked[:-1])))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(number)]):
                if number[lo] != now:
                    now, held, group = number[lo], [], None
                if not asked[lo]:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if group is None:
                    group, held = _Group(held), []
                for at in range(lo, hi, 256):
                    yield from group.search(batch.slice(at, min(256, hi - at)), top)

    found = dealt.repartition("group").sortWithinPartitions("group", "asked").mapInArrow(run, "query_row long, query_id long, row long, vec_id long, score double")
    # One shuffle by query serves both the removal of rows met in several groups and the ranks.
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    found = found.repartition("query_row").dropDuplicates(["query_row", "row"]).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
