"""Offset-preserving subword encoding with a compiled piece model, and decoding.

The model file is parsed once on the driver and sent to the tasks (its vocabulary is fixed, so its size is). A text is
normalised by longest-prefix matching through the compiled character map; each normalised character remembers how many
source bytes it stands for. Byte-pair merges then add those widths up, so every piece ends at a known source byte.

No piece of a supported vocabulary holds a space mark after another character, so merges never cross the start of a
space run and runs of one word are encoded apart from each other; repeated ones come from a bounded memory.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normlake.llm.common import sent
from normlake.llm.grams import KeyIndex

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
NOTHING = float("-inf")
LONG = 64  # characters of a run from which merges go through a heap
KEPT_RUNS = 300_000  # runs of a generation; a worker remembers the newest two
AT_ONCE = 10_000  # runs merged side by side
NO_RANK = 1 << 40
FLUSH = 1 << 20  # characters of a group of texts


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield tag >> 3, data[at:at + size]
        at += size


class CharacterMap:
    """Longest-prefix replacement by a compiled map: a double array of byte transitions and its replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = array("I", blob[4:4 + size])
        self.strings = blob[4 + size:]

    def __bool__(self) -> bool:
        return len(self.units) > 0

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key that starts at ``at``."""
        units, found = self.units, None
        node = self._jump(units[0])
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[end]:
                break
            node ^= self._jump(unit)
            if unit >> 8 & 1:
                found = end + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1]:self.strings.index(b"\0", found[1])]


class PieceModel:
    """A byte-pair piece model with its normaliser. Raises ValueError for models it can't reproduce exactly."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        kind_of_model, norm = 1, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self._add(piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL))
            elif number == 2:
                kind_of_model = dict(_fields(value)).get(3, 1)
            elif number == 3:
                norm = dict(_fields(value))
        self.charmap = CharacterMap(norm.get(2, b""))
        self.dummy_prefix, self.squeeze, escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.byte_ids = [self.ids.get(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = self.kinds.index(UNKNOWN)
        if kind_of_model != 2 or not escape or USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("only byte-pair models with escaped spaces and without user-defined or unused pieces")
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece holds a space mark after another character")
        self._surface = [self._bytes(i) for i in range(len(self.pieces))]
        self._widths = np.array([len(b) for b in self._surface], np.int32)
        self._merges: tuple | None = None
        self._runs: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _add(self, piece: str, score: float, kind: int) -> None:
        self.ids[piece] = len(self.pieces)
        self.pieces.append(piece)
        self.kinds.append(kind)
        if kind == NORMAL:
            self.score[piece] = score

    def _bytes(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else self.pieces[i].replace(MARK, " ").encode()

    # -- normalisation ------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[list[str], list[int], list[int]]:
        """Normalised characters, spaces as marks, with the source bytes [start, end) of each."""
        data = text.encode("utf-8", "surrogatepass")
        parts: list[tuple[str, int, int]] = []
        at = 0
        while at < len(data):
            hit = self.charmap.longest(data, at) if self.charmap else None
            if hit:
                size, out = hit[0], hit[1].decode()
            else:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                out = data[at:at + size].decode("utf-8", "replace")
            # What a key turns into shares its source: all of it belongs to the first character.
            for i, char in enumerate(out):
                parts.append((MARK if char == " " else char, at if i == 0 else at + size, at + size))
            at += size
        if self.squeeze:
            kept: list[tuple[str, int, int]] = []
            for part in parts:
                if part[0] != MARK or (kept and kept[-1][0] != MARK):
                    kept.append(part)
            while kept and kept[-1][0] == MARK:
                kept.pop()
            parts = kept
        if self.dummy_prefix and parts:
            parts.insert(0, (MARK, parts[0][1], parts[0][1]))
        return [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]

    # -- encoding -----------------------------------------------------------------------------------------------

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Piece ids and the source bytes [start, end) of each piece, for each text; nothing for an empty text."""
        cut, new = [], {}
        for text in texts:
            if self.charmap or self.squeeze or not self.dummy_prefix or MARK in text or None in self.byte_ids or not text:
                cut.append(None)
                continue
            # The map is empty and no mark stands in the text: characters stand for themselves, so runs can be cut from
            # the text as it is, and a piece is as wide as its own bytes but for the prefixed mark.
            cut.append(re.findall(" +[^ ]*", " " + text))
            new.update(dict.fromkeys(cut[-1]))
        self._learn([run for run in new if run not in self._runs])
        return [self._whole(text, runs) for text, runs in zip(texts, cut)]

    def _whole(self, text: str, runs: list[str] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not text:
            none = np.empty(0, np.int32)
            return none, none, none
        if runs is None:
            return self._encode_mapped(text)
        parts = list(map(self._runs.get, runs))
        if None in parts:
            parts = [self._single(run) if part is None else part for run, part in zip(runs, parts)]
        ids = np.frombuffer(b"".join(parts), np.int32)
        widths = self._widths[ids]
        widths[0] -= 1
        ends = np.cumsum(widths, dtype=np.int32)
        return ids, ends - widths, ends

    def _single(self, run: str) -> bytes:
        return array("i", self._pieces(list(run.replace(" ", MARK)), [1] * len(run))[0]).tobytes()

    def _learn(self, runs: list[str]) -> None:
        """Remembers the ids of ``runs``; very long ones are left to :meth:`_single`."""
        if len(self._runs) + len(runs) > KEPT_RUNS:
            self._older, self._runs = self._runs, {}
        new = []
        for run in runs:
            ids = self._older.get(run)
            if ids is not None:
                self._runs[run] = ids
            elif len(run) <= LONG:
                new.append(run)
        for lo in range(0, len(new), AT_ONCE):
            self._runs.update(zip(new[lo:lo + AT_ONCE], self._joined_all(new[lo:lo + AT_ONCE])))

    def _pairs(self) -> tuple[KeyIndex, np.ndarray, np.ndarray, np.ndarray]:
        """Index of (left, right) symbol pairs that merge, the rank and symbol of each merge, and symbols by character.

        Symbols are piece ids; characters that are only parts of pieces get numbers behind them, others the last one.
        """
        if self._merges is None:
            symbols = {p: self.ids[p] for p in self.score}
            for char in sorted({c for p in self.score for c in p} - symbols.keys()):
                symbols[char] = len(self.pieces) + len(symbols) - len(self.score)
            ranks = {score: rank for rank, score in enumerate(sorted(set(self.score.values()), reverse=True))}
            found = [(symbols[p[:i]] << 32 | symbols[p[i:]], ranks[score], symbols[p]) for p, score in self.score.items() for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols]
            keys, rank, whole = (np.array(column, np.int64) for column in zip(*found))
            by_char = np.full(0x110000, (1 << 31) - 1, np.int32)
            for symbol, number in symbols.items():
                if len(symbol) == 1:
                    by_char[ord(symbol)] = number
            by_char[ord(" ")] = by_char[ord(MARK)]
            # The place behind all merges stands for no merge.
            self._merges = KeyIndex(keys), np.append(rank, NO_RANK), np.append(whole, -1), by_char
        return self._merges

    def _joined_all(self, runs: list[str]) -> list[bytes]:
        """Ids of many runs: in each round every run merges its best-scored pair, the leftmost of equals."""
        index, ranks, wholes, by_char = self._pairs()
        if not runs:
            return []
        symbol = by_char[np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])

        def merges(at: np.ndarray) -> np.ndarray:
            """Place in the merge table of the pairs at ``at`` and behind it; the last place where there is none."""
            after = np.minimum(at + 1, len(symbol) - 1)
            place = index.find((symbol[at] << 32 | symbol[after]).astype(np.uint64))
            return np.where((owner[at] == owner[after]) & (at < after) & (place >= 0), place, len(ranks) - 1)

        done_symbol, done_owner = [], []
        place = merges(np.arange(len(symbol)))
        while len(symbol):
            rank = ranks[place]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            size = np.diff(np.append(first, len(owner)))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            ended = best == NO_RANK
            if ended.any():
                done_symbol.append(symbol[ended])
                done_owner.append(owner[ended])
                left = ~ended
                symbol, owner, place, rank, best = symbol[left], owner[left], place[left], rank[left], best[left]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == best)
            hit = hit[np.diff(owner[hit], prepend=-1) != 0]
            symbol[hit] = wholes[place[hit]]
            left = np.ones(len(symbol), bool)
            left[hit + 1] = False
            symbol, owner, place = symbol[left], owner[left], place[left]
            hit -= np.arange(len(hit))
            touched = np.concatenate([hit, hit[hit > 0] - 1])
            place[touched] = merges(touched)
        symbol, owner = np.concatenate(done_symbol), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        symbol, owner = symbol[order], owner[order]
        data = symbol.astype(np.int32).tobytes()
        ends = np.searchsorted(owner, np.arange(1, len(runs) + 1)).tolist()
        out = [data[4 * a:4 * b] for a, b in zip([0, *ends], ends)]
        for odd in np.unique(owner[symbol >= len(self.pieces)]).tolist():
            out[odd] = self._single(runs[odd])
        return out

    def _encode_mapped(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chars, starts, ends = self.normalise(text)
        ids: list[int] = []
        first: list[int] = []
        last: list[int] = []
        cuts = [i for i, c in enumerate(chars) if c == MARK and (i == 0 or chars[i - 1] != MARK)]
        cuts = sorted({0, *cuts, len(chars)})
        for lo, hi in zip(cuts, cuts[1:]):
            # Widths count characters here, to find the first and last source byte of each piece.
            got, sizes = self._pieces(chars[lo:hi], [1] * (hi - lo), whole=True)
            at = lo
            for i, size in zip(got, sizes):
                ids.append(i)
                first.append(starts[at] if at < hi else ends[hi - 1])
                last.append(ends[at + size - 1] if size else first[-1])
                at += size
        return np.array(ids, np.int32), np.array(first, np.int32), np.array(last, np.int32)

    def _pieces(self, symbols: list[str], widths: list[int], whole: bool = False) -> tuple[list[int], list[int]]:
        symbols, widths = (self._merged if len(symbols) <= LONG else self._merged_long)(symbols, widths)
        ids, sizes = [], []
        for symbol, width in zip(symbols, widths):
            i = self.ids.get(symbol)
            if i is not None:
                ids.append(i)
                sizes.append(width)
                continue
            raw = symbol.encode("utf-8", "surrogatepass")
            if None in (parts := [self.byte_ids[b] for b in raw]):
                ids.append(self.unknown)
                sizes.append(width)
            else:
                ids += parts
                sizes += [1] * width if width == len(raw) and not whole else [0] * (len(raw) - 1) + [width]
        return ids, sizes

    def _merged(self, symbols: list[str], widths: list[int]) -> tuple[list[str], list[int]]:
        """Always the best-scored neighbouring pair first, the leftmost of equals."""
        score = self.score.get
        pairs = [score(a + b, NOTHING) for a, b in zip(symbols, symbols[1:])]
        while pairs:
            best = max(pairs)
            if best == NOTHING:
                break
            i = pairs.index(best)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            widths[i:i + 2] = [widths[i] + widths[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = score(symbols[i] + symbols[i + 1], NOTHING)
            if i:
                pairs[i - 1] = score(symbols[i - 1] + symbols[i], NOTHING)
        return symbols, widths

    def _merged_long(self, symbols: list[str], widths: list[int]) -> tuple[list[str], list[int]]:
        """The same order by a heap over a linked list."""
        score, n = self.score.get, len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n:
                s = score(symbols[i] + symbols[j])
                if s is not None:
                    heapq.heappush(heap, (-s, i, j, len(symbols[i]) + len(symbols[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not (alive[i] and alive[j]) or after[i] != j or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            widths[i] += widths[j]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        left = [i for i in range(n) if alive[i]]
        return [symbols[i] for i in left], [widths[i] for i in left]

    # -- decoding -----------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of the pieces; bytes that form no character become U+FFFD one by one."""
        surface, kinds = self._surface, self.kinds
        parts = [surface[i] for i in ids]
        if b"" in parts and BYTE in (kinds[i] for i in ids):
            # Control pieces show nothing, but no character goes on behind them.
            cuts = [at for at, i in enumerate(ids) if kinds[i] == CONTROL]
            ends = [*cuts, len(ids)]
            parts = [b"".join(parts[a:b]).decode("utf-8", "normlake-each").encode() for a, b in zip([0, *cuts], ends)]
        data = b"".join(parts)
        if self.dummy_prefix or self.squeeze:
            # The first piece that is not a control piece gives up one leading space, unless it is a byte or unknown.
            for i in ids:
                if kinds[i] != CONTROL:
                    if kinds[i] == NORMAL and data.startswith(b" "):
                        data = data[1:]
                    break
        return data.decode("utf-8", "normlake-each")


def _each(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


def load(path: str) -> PieceModel:
    with open(path, "rb") as file:
        return PieceModel(file.read())


def encode(docs: DataFrame, model: PieceModel, decoded: bool = False) -> DataFrame:
    """(doc_id, ids, starts, ends) of every row: piece ids without begin or end marks and their source bytes.

    With ``decoded`` also the text that the ids decode to, from the same worker.

    Null and empty texts have no pieces. Repeated rows stay repeated; columns besides doc_id and text are not read.
    """
    get = sent(docs.sparkSession, model)
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, ints) for n in ("ids", "starts", "ends")], *[T.StructField("decoded", T.StringType())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs.register_error("normlake-each", _each)
        own = get()
        for batch in batches:
            texts, lo, size, group = batch.column(1), 0, 0, []
            for row in range(batch.num_rows):
                group.append(texts[row].as_py() or "")
                size += len(group[-1])
                if size >= FLUSH or row == batch.num_rows - 1:
                    done = own.encode_all(group)
                    offsets = pa.array(np.concatenate([[0], np.cumsum([len(d[0]) for d in done])]), pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([d[k] for d in done]), pa.int32())) for k in range(3)]
                    lists += [pa.array([own.decode(d[0].tolist()) for d in done], pa.string())] * decoded
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(done)), *lists], names=schema.names)
                    lo, size, group = row + 1, 0, []

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(rows: DataFrame, model: PieceModel, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of column ``ids`` (null: empty) in place of it, as column ``out``."""
    get = sent(rows.sparkSession, model)
    others = [f for f in rows.schema.fields if f.name not in (ids, out)]
    schema = T.StructType([*others, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs.register_error("normlake-each", _each)
        own = get()
        for batch in batches:
            lists, lo, size, done = batch.column(batch.num_columns - 1), 0, 0, []
            for row in range(batch.num_rows):
                item = lists[row].values
                done.append(own.decode(item.to_numpy().tolist()) if item is not None else "")
                size += len(done[-1])
                if size >= FLUSH or row == batch.num_rows - 1:
                    cut = [batch.column(i).slice(lo, len(done)) for i in range(batch.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*cut, pa.array(done, pa.string())], names=schema.names)
                    lo, size, done = row + 1, 0, []

    return rows.select(*[f.name for f in others], ids).mapInArrow(run, schema)


def token_digest(docs: DataFrame, model: PieceModel) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes): digests of the pieces and of their decoded text.

    covered_bytes is where the last piece ends in the source.
    """
    return encode(docs, model, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long").alias("covered_bytes"))
