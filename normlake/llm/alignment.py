"""Alignment of two tokenizers' ids over the same bytes, by anchors before space-marked tokens.

Both token streams of a text are complete before they are compared. Where a token of either stream ends at the same byte
and both next tokens start with a space, the text is cut: what lies between two such anchors is a window, a pair of id
tuples. Equal windows align alike wherever they stand, so a worker aligns each one once and remembers it.

A pair of ids can only be linked if the bytes of one end with the bytes of the other, so the two vocabularies alone bound
the table of linkable pairs. Its counts are summed by Spark and sent to the tasks as one array of that size.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlake.llm.common import saved, scratch, sent
from normlake.llm.pieces import PieceModel

KEPT_WINDOWS = 400_000  # windows that a worker remembers
GROUP = 1 << 18  # characters tokenised at a time
CUT = 1 << 20  # characters from which a text is tokenised in parts
SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")  # both tokenizers always start a token at such a space
GAP = re.compile(r"\s{65536}")  # white space that overflows the quick tokenizer's pattern
NO_ID = b"\xff\xff"
SCHEMA = "doc_id {id}, n_a long, n_b long, n_groups long, groups string, pairs array<int>, times array<int>"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + at): b for at, b in enumerate(hidden)}


def byte_ranks(data: str) -> dict[bytes, int]:
    """Ids of a byte-level vocabulary file by their bytes, special tokens left out.

    Raises ValueError unless ids follow the order of merges, which lets the id of a token serve as its rank.
    """
    parsed = json.loads(data)
    vocabulary, special, stands_for = parsed["model"]["vocab"], {t["content"] for t in parsed["added_tokens"]}, byte_alphabet()
    before = parsed["pre_tokenizer"]
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in parsed["model"]["merges"]]
    if before["type"] != "ByteLevel" or not before["use_regex"] or before["add_prefix_space"] or parsed["normalizer"] or merged != sorted(merged):
        raise ValueError("only byte-level vocabularies without normaliser and prefix whose ids follow the order of merges")
    return {bytes(stands_for[c] for c in token): i for token, i in vocabulary.items() if token not in special}


class Vocabularies:
    """Bytes of every id of a byte-level (A) and of a piece vocabulary (B), and all pairs of ids that can end together."""

    def __init__(self, byte_level: str, pieces: str):
        with open(byte_level, encoding="utf-8") as file:
            self.byte_level = file.read()
        self.ranks = byte_ranks(self.byte_level)
        self.a_bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.a_bytes[i] = token
        with open(pieces, "rb") as file:
            self.model = file.read()
        model = PieceModel(self.model)
        self.b_bytes = [model._bytes(i) for i in range(len(model.pieces))]
        if max(len(self.a_bytes), len(self.b_bytes)) > 0xFFFF:
            raise ValueError("ids have to fit into two bytes")
        self.pairs = self._linkable()
        self.aligner: Aligner | None = None

    def _linkable(self) -> np.ndarray:
        """Sorted a * 65536 + b of all ids where the bytes of one end with the bytes of the other."""
        by_a, by_b = {}, {}
        for ids, known in ((self.a_bytes, by_a), (self.b_bytes, by_b)):
            for i, token in enumerate(ids):
                if token:
                    known.setdefault(token, []).append(i)
        found = {a << 16 | b for token, ids in by_a.items() for lo in range(len(token)) for b in by_b.get(token[lo:], ()) for a in ids}
        found |= {a << 16 | b for token, ids in by_b.items() for lo in range(len(token)) for a in by_a.get(token[lo:], ()) for b in ids}
        return np.array(sorted(found), np.int64)


class Aligner:
    """Tokenizes and aligns texts inside one worker."""

    def __init__(self, words: Vocabularies):
        import sentencepiece
        import tiktoken

        self.words = words
        self.a = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=words.ranks, special_tokens={})
        self.slow = None  # the same vocabulary in a slower library, for what the quick one can't take
        self.b = sentencepiece.SentencePieceProcessor(model_proto=words.model)
        self.widths = [np.array([len(t) for t in side], np.int64) for side in (words.a_bytes, words.b_bytes)]
        self.names = list(map(str, range(1 << 16)))
        self.wide = [side.tolist() for side in self.widths]
        self.places = {pair: at for at, pair in enumerate(words.pairs.tolist())}
        self.spaced = [np.array([t.startswith(b" ") for t in side]) for side in (words.a_bytes, words.b_bytes)]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.shown: list[str] = []  # groups of a window
        self.links: list[bytes] = []  # places in the pair table, of a window's links

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups, groups, pairs, times) of each text; nothing where the bytes of a stream are not the text's."""
        owners, parts = [], []
        for owner, text in enumerate(texts):
            for part in self._parts(text):
                owners.append(owner)
                parts.append(part)
        a_ids, b_ids = list(map(self._byte_level, parts)), self.b.encode(parts, num_threads=1)
        wrong = {owner for owner, part, a, b in zip(owners, parts, a_ids, b_ids) if not self._same(part, a, b)}
        fit = [at for at, owner in enumerate(owners) if owner not in wrong]
        found: list[list] = [[] for _ in texts]
        for at, got in zip(fit, self._windows([a_ids[at] for at in fit], [b_ids[at] for at in fit])):
            found[owners[at]].append((len(a_ids[at]), len(b_ids[at]), got))
        return list(map(self._joined, found))

    def _byte_level(self, part: str) -> list[int]:
        if len(part) > 2 * CUT or (len(part) >= 1 << 16 and GAP.search(part)):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_str(self.words.byte_level)
                self.slow.encode_special_tokens = True
            return self.slow.encode(" " + part, add_special_tokens=False).ids
        return self.a.encode_ordinary(" " + part)

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        """A long text in parts that are tokenised alike on their own; the space between two parts is the later one's prefix."""
        lo = 0
        while len(text) - lo > CUT and (at := SAFE.search(text, lo + CUT)):
            yield text[lo:at.start()]
            lo = at.end()
        if lo < len(text):
            yield text[lo:] if lo else text

    def _same(self, part: str, a: list[int], b: list[int]) -> bool:
        want = b" " + part.encode()
        return b"".join(map(self.words.a_bytes.__getitem__, a)) == want and b"".join(map(self.words.b_bytes.__getitem__, b)) == want

    def _windows(self, a_lists: list[list[int]], b_lists: list[list[int]]) -> list[list[int]]:
        """Numbers of the remembered windows of each part, in order."""
        if not a_lists:
            return []
        if len(self.known) > KEPT_WINDOWS:
            self._forget()
        a, b = (np.fromiter(chain.from_iterable(lists), np.uint16) for lists in (a_lists, b_lists))
        a_ends, b_ends = np.cumsum(self.widths[0][a]), np.cumsum(self.widths[1][b])
        at = np.minimum(np.searchsorted(b_ends, a_ends), len(b_ends) - 1)
        shared = b_ends[at] == a_ends
        a_next, b_next = np.append(self.spaced[0][a[1:]], True), np.append(self.spaced[1][b[1:]], True)
        # Parts start with a space in both streams, so their ends are anchors too.
        cut = np.flatnonzero(shared & a_next & b_next[at])
        a_cut, b_cut = [0, *(2 * (cut + 1)).tolist()], [0, *(2 * (at[cut] + 1)).tolist()]
        a_raw, b_raw, known = a.tobytes(), b.tobytes(), self.known
        keys = [a_raw[i:j] + NO_ID + b_raw[k:m] for i, j, k, m in zip(a_cut, a_cut[1:], b_cut, b_cut[1:])]
        for key in set(keys).difference(known):
            self._learn(key)
        numbers = list(map(known.__getitem__, keys))
        ends = np.searchsorted(cut, np.cumsum([len(x) for x in a_lists]) - 1, side="right").tolist()
        return [numbers[i:j] for i, j in zip([0, *ends], ends)]

    def _learn(self, key: bytes) -> None:
        """Aligns one window: groups between ends that both sides share, and the pair of ids at each such end."""
        ids = array("H", key)
        split = ids.index(0xFFFF)
        wide_a, wide_b = self.wide
        name = self.names
        groups, links = [], []
        if split == 1 or len(ids) == split + 2:
            # One token on a side: only the ends of the window are shared.
            groups.append(",".join([name[x] for x in ids[:split]]) + "|" + ",".join([name[x] for x in ids[split + 1:]]))
            links.append(self.places[ids[split - 1] << 16 | ids[-1]])
            split = 0
        last, lo, j, k, a_end, b_end = 0, split + 1, 0, split + 1, 0, 0
        while j < split:
            a_end += wide_a[ids[j]]
            j += 1
            while b_end < a_end:
                b_end += wide_b[ids[k]]
                k += 1
            if a_end == b_end:
                groups.append(",".join([name[x] for x in ids[last:j]]) + "|" + ",".join([name[x] for x in ids[lo:k]]))
                links.append(self.places[ids[j - 1] << 16 | ids[k - 1]])
                last, lo = j, k
        self.known[key] = len(self.shown)
        self.shown.append(";".join(groups))
        self.links.append(array("i", links).tobytes())

    def _joined(self, parts: list[tuple[int, int, list[int]]]) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        numbers = list(chain.from_iterable(p[2] for p in parts))
        linked = np.frombuffer(b"".join(map(self.links.__getitem__, numbers)), np.int32)
        pairs, times = np.unique(linked, return_counts=True)
        return (sum(p[0] for p in parts), sum(p[1] for p in parts), len(linked), ";".join(map(self.shown.__getitem__, numbers)),
                pairs, times.astype(np.int32))


def align(docs: DataFrame, words: Vocabularies) -> DataFrame:
    """Groups and links of every text: (doc_id, n_a, n_b, n_groups, groups, pairs, times).

    ``groups`` is ``a1,a2|b1;a3|b2,b3``, ``pairs`` the distinct linked pairs as places in ``words.pairs``, ``times`` how
    often the text holds each. Null and empty texts, and texts that either stream does not reproduce byte by byte, have
    zeros and empty values. Repeated rows stay repeated; columns besides doc_id and text are not read.
    """
    get = sent(docs.sparkSession, words)
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = get()
        own = words.aligner = words.aligner or Aligner(words)  # a worker keeps it, with the windows it knows, for its next tasks
        for batch in batches:
            texts, lo, size, group = batch.column(1), 0, 0, []
            for row in range(batch.num_rows):
                group.append(texts[row].as_py() or "")
                size += len(group[-1])
                if size >= GROUP or row == batch.num_rows - 1:
                    yield _batch(batch.column(0).slice(lo, len(group)), own.align(group))
                    lo, size, group = row + 1, 0, []

    return docs.mapInArrow(run, SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))


def _batch(ids: pa.Array, done: list[tuple]) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(d[4]) for d in done])]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([d[k] for d in done]), pa.int32())) for k in (4, 5)]
    numbers = [pa.array([d[k] for d in done], pa.int64()) for k in range(3)]
    return pa.RecordBatch.from_arrays([ids, *numbers, pa.array([d[3] for d in done], pa.string()), *lists],
                                      names=["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"])


def pair_counts(aligned: DataFrame, words: Vocabularies) -> np.ndarray:
    """How many links of the whole table hold each pair. The result has one number for each linkable pair, whatever the rows."""
    size = len(words.pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            pairs, times = (batch.column(k).flatten().to_numpy() for k in range(2))
            total += np.bincount(pairs, weights=times, minlength=size).astype(np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["pair", "n"])

    rows = aligned.select("pairs", "times").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out


def align_documents(docs: DataFrame, words: Vocabularies) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A link's count is how often the corpus links its two ids; n_best counts links whose count is the highest that their
    piece id has. Texts without tokens have zeros and an empty digest. An empty table gives no rows.
    """
    spark = docs.sparkSession
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit("")).alias("groups_sha256")
    rows = saved(align(docs, words).select("doc_id", "n_a", "n_b", "n_groups", digest, "pairs", "times"), f"{scratch(spark)}/aligned")
    counts = pair_counts(rows, words)
    b_ids = words.pairs & 0xFFFF
    highest = np.zeros(len(words.b_bytes), np.int64)
    np.maximum.at(highest, b_ids, counts)
    get = sent(spark, (counts, counts == highest[b_ids]))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = get()
        for batch in batches:
            pairs, times = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (5, 6))
            offsets = batch.column(5).offsets.to_numpy()
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[offsets - offsets[0]]) for x in (times, times * best[pairs], times * count[pairs])]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(5)] + [pa.array(x, pa.int64()) for x in sums],
                                             names=[*kept, "n_links", "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema) + ", n_links long, n_best long, count_sum long"
    found = rows.select(*kept, "pairs", "times").mapInArrow(run, schema)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
