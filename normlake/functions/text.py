"""Row-local text primitives.

Everything here maps one string column to arrays inside the same row. Nothing explodes or shuffles, so a
table of texts is scanned once and split across tasks by rows, whatever the length distribution is. All
loops are linear in the text: positions come from marker characters in a split array, never from repeated
``substring`` calls.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from normlake.dims import charclass as cc

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

OPEN_MARK = "\ufdd0"
NON_ASCII_SPACES = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
HIT = "array<struct<start:int,end:int,value:string>>"
RUN_BYTES = 4 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once, so a lambda below it does not evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def inside(points: Column, spans: Column) -> Column:
    """For each point whether one of the disjoint, ascending spans (start, end) holds it: one sort instead of a search per point.

    In the sorted order, the starts before a point are the elements before it that are no points.
    """
    point = lambda p, i: F.struct(p.cast("bigint").alias("p"), i.cast("int").alias("at"))
    tagged = F.concat(F.transform(spans, lambda s: point(s["start"], F.lit(-1))), F.transform(points, point))

    def look_up(r: Column) -> Column:
        placed = F.array_compact(F.transform(r["all"], lambda x, i: F.when(x["at"] >= 0, F.struct(x["at"].alias("at"), x["p"].alias("p"), i.alias("i")))))
        held = F.transform(placed, lambda h, k: F.struct(h["at"].alias("at"), F.coalesce(h["p"] < F.get(r["spans"], h["i"] - k - 1)["end"], F.lit(False)).alias("on")))
        return F.transform(F.array_sort(held), lambda h: h["on"])

    return let(F.struct(F.array_sort(tagged).alias("all"), spans.alias("spans")), look_up)


def among(points: Column, chosen: Column) -> Column:
    """For each point whether it is one of ``chosen`` (null: none)."""
    none = F.array().cast("array<int>")
    spans = F.transform(F.array_sort(F.array_distinct(F.coalesce(chosen, none))), lambda c: F.struct(c.alias("start"), (c + 1).alias("end")))
    return inside(points, spans)


def chars(text: Column) -> Column:
    """Code points of a string as single-character strings."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def code_point(char: Column) -> Column:
    return F.ascii(char)


def indexed_chars(text: Column) -> Column:
    """Array of (c, u16): the element's own index is the code-point index, u16 its UTF-16 offset.

    A marker is put behind each character beyond the basic plane; the split array index then counts
    UTF-16 units, and dropping the markers leaves code points.
    """
    clean = F.translate(text, OPEN_MARK, "\ufffd")
    marked = F.regexp_replace(clean, r"([\x{10000}-\x{10FFFF}])", "$1" + OPEN_MARK)
    units = F.transform(chars(marked), lambda c, i: F.struct(c.alias("c"), i.cast("int").alias("u16")))
    return F.filter(units, lambda u: u["c"] != OPEN_MARK)


def wide(char_class: str) -> str:
    """The same class for one without ASCII characters, with the test that most characters fail first."""
    return rf"[[^\x00-\x7F]&&{char_class}]"


# The regex engine of the JVM puts marks around what it finds; positions are then counted over whole batches.
def _runs(texts: pa.Array) -> list[pa.Array]:
    """A batch in runs of a few megabytes, so that what is counted over one stays small."""
    texts = texts.cast(pa.string()).fill_null("")
    step = max(1, len(texts) * RUN_BYTES // max(1, texts.nbytes))
    return [texts.slice(low, step) for low in range(0, max(1, len(texts)), step)]


def _pieces(marked: pa.Array):
    """The pieces between marks: (pieces, pieces of each row, place in the row, start, end), positions in code points."""
    parts = pc.split_pattern(marked, OPEN_MARK)
    flat, sizes = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    lengths = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype("int64")
    ends = np.cumsum(lengths)
    base = (ends - lengths)[first]
    return flat, sizes, np.arange(len(first)) - first, ends - lengths - base, ends - base


def _lists(counts: np.ndarray, **columns) -> pa.Array:
    """Rows of ``counts`` records each."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype("int32")
    made = [c if isinstance(c, pa.Array) else pa.array(c.astype("int32")) for c in columns.values()]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(made, names=list(columns)))


def _records(**fields) -> ArrayType:
    record = StructType()
    for name, kind in fields.items():
        record.add(name, kind)
    return ArrayType(record)


_INT, _STRING = IntegerType(), StringType()


@F.arrow_udf(_records(start=_INT, end=_INT, value=_STRING))
def _marked_hits(marked: pa.Array) -> pa.Array:
    def one(texts: pa.Array) -> pa.Array:
        flat, sizes, at, start, end = _pieces(texts)
        found = np.flatnonzero(at % 2)
        return _lists(sizes // 2, start=start[found], end=end[found], value=flat.take(pa.array(found)))

    return pa.concat_arrays([one(texts) for texts in _runs(marked)])


@F.arrow_udf(_records(at=_INT, c=_STRING, p=_STRING, n=_STRING))
def _marked_chars(marked: pa.Array) -> pa.Array:
    def one(texts: pa.Array) -> pa.Array:
        flat, sizes, at, start, _ = _pieces(texts)
        found = np.flatnonzero(at % 2)
        last = np.repeat(sizes, sizes)[found] - 1
        # The neighbour is a character of the piece between two marks, or the found character behind an empty one.
        before, after = flat.take(pa.array(found - 1)), flat.take(pa.array(found + 1))
        above = flat.take(pa.array(found - 2, mask=at[found] < 3))
        below = flat.take(pa.array(found + 2, mask=at[found] + 2 > last))
        return _lists(
            sizes // 2, at=start[found], c=flat.take(pa.array(found)),
            p=pc.if_else(pc.equal(before, ""), above, pc.utf8_slice_codeunits(before, start=-1)),
            n=pc.if_else(pc.equal(after, ""), below, pc.utf8_slice_codeunits(after, start=0, stop=1)),
        )

    return pa.concat_arrays([one(texts) for texts in _runs(marked)])


FORMS = ("NFC", "NFD", "NFKC", "NFKD")


@F.arrow_udf(_records(start=_INT, end=_INT, f=_records(value=_STRING, **{form.lower(): _STRING for form in FORMS}).elementType))
def _marked_forms(marked: pa.Array) -> pa.Array:
    def one(texts: pa.Array) -> pa.Array:
        flat, sizes, at, start, end = _pieces(texts)
        found = np.flatnonzero(at % 2)
        # The forms of a cluster are made once, however often it stands in these texts.
        coded = flat.take(pa.array(found)).dictionary_encode()
        values = coded.dictionary.to_pylist()
        forms = [[unicodedata.normalize(form, v) for v in values] for form in FORMS]
        changed = np.array([any(f != v for f in made) for v, *made in zip(values, *forms)], bool)
        code = coded.indices.to_numpy()
        kept = changed[code]
        take = pa.array(code[kept])
        fields = [pa.array(c, pa.string()).take(take) for c in (values, *forms)]
        made = pa.StructArray.from_arrays(fields, names=["value", *(form.lower() for form in FORMS)])
        row = np.repeat(np.arange(len(sizes)), sizes)[found]
        return _lists(np.bincount(row[kept], minlength=len(sizes)), start=start[found][kept], end=end[found][kept], f=made)

    return pa.concat_arrays([one(texts) for texts in _runs(marked)])


@F.arrow_udf(_records(scalar_start=_INT, scalar_end=_INT, utf16_start=_INT, utf16_end=_INT))
def _marked_ends(marked: pa.Array) -> pa.Array:
    def one(texts: pa.Array) -> pa.Array:
        rows, (_, places, content) = len(texts), texts.buffers()
        offsets = np.frombuffer(places, "int32")[texts.offset: texts.offset + rows + 1]
        data = np.frombuffer(content or b"", "uint8")[offsets[0]: offsets[-1]]
        offsets = offsets - offsets[0]
        upto = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype="int64")])
        chars_upto, wide_upto = upto((data & 0xC0) != 0x80), upto(data >= 0xF0)
        mark = OPEN_MARK.encode()
        at = np.flatnonzero((data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2]))
        row = np.searchsorted(offsets, at, "right") - 1
        counts = np.bincount(row, minlength=rows)
        place = np.arange(len(at)) - (np.cumsum(counts) - counts)[row]
        end = chars_upto[at] - chars_upto[offsets[row]] - place
        end16 = end + wide_upto[at] - wide_upto[offsets[row]]
        start, start16 = (np.where(place == 0, 0, np.concatenate([[0], e[:-1]])[: len(e)]) for e in (end, end16))
        return _lists(counts, scalar_start=start, scalar_end=end, utf16_start=start16, utf16_end=end16)

    return pa.concat_arrays([one(texts) for texts in _runs(marked)])


@F.arrow_udf(ArrayType(_INT))
def span_ends(points: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """For each point the end of the span that holds it, or 0; the spans of a row are disjoint and ascending."""
    sizes, spans = (pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False) for a in (points, starts))
    flat = lambda a: a.flatten().to_numpy(zero_copy_only=False).astype("int64")
    numbers = np.arange(len(points), dtype="int64") << 32
    point, low = flat(points) + np.repeat(numbers, sizes), flat(starts) + np.repeat(numbers, spans)
    high = np.concatenate([[-1], flat(ends) + np.repeat(numbers, spans)])
    held = high[np.searchsorted(low, point, "right")]
    out = np.where(held > point, held - np.repeat(numbers, sizes), 0).astype("int32")
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))


@F.arrow_udf(ArrayType(_STRING))
def cut_at(texts: pa.Array, bounds: pa.Array) -> pa.Array:
    """The pieces of each text between ascending positions, from its start to its end (null: null)."""

    def one(text: str, places: list[int]) -> list[str]:
        return [text[a:b] for a, b in zip([0, *places], [*places, len(text)])]

    pairs = zip(texts.to_pylist(), bounds.to_pylist())
    return pa.array([None if text is None or places is None else one(text, places) for text, places in pairs], pa.list_(pa.string()))


def _marked(text: Column, pattern: str, needle: tuple[str, ...], marks: str) -> Column:
    present = text.rlike(pattern)
    if needle:
        present = reduce(lambda a, b: a | b, [text.contains(n) for n in needle]) & present
    clean = F.when(text.contains(OPEN_MARK), F.translate(text, OPEN_MARK, "\ufffd")).otherwise(text)
    return F.when(present, F.regexp_replace(clean, F.lit(pattern), F.lit(marks)))


def hits(text: Column, pattern: str, needle: tuple[str, ...] = ()) -> Column:
    """Every match of ``pattern`` as (start, end, value) in code points, left to right.

    ``needle`` names substrings of which every match holds at least one: a byte search that lets most
    texts skip the regex.
    """
    return _marked_hits(_marked(text, pattern, needle, OPEN_MARK + "$0" + OPEN_MARK))


def char_hits(text: Column, pattern: str) -> Column:
    """Every match of a pattern of one character as (at, c, p, n): its position, itself and its neighbours (null at the text's ends)."""
    return _marked_chars(_marked(text, pattern, (), OPEN_MARK + "$0" + OPEN_MARK))


def clusters(text: Column) -> Column:
    """Extended grapheme clusters, which tile the text, with code-point and UTF-16 bounds."""
    return _marked_ends(_marked(text, r"\X", (), "$0" + OPEN_MARK))


def changed_clusters(text: Column) -> Column:
    """The grapheme clusters beyond plain ASCII that a normal form changes, as (start, end, f), f its value and its four forms."""
    return _marked_forms(_marked(text, cc.WIDE_CLUSTER, (), OPEN_MARK + "$0" + OPEN_MARK))


def scripts_of(text: Column) -> Column:
    """Distinct scripts (without COMMON and INHERITED) in the fixed vocabulary order, OTHER last."""
    named = "".join(rf"\p{{Is{s}}}" for _, group in cc.SCRIPTS for s in group)
    flags = [
        F.when(text.rlike("[" + "".join(rf"\p{{Is{s}}}" for s in group) + "]"), F.lit(name))
        for name, group in cc.SCRIPTS
    ]
    other = F.when(text.rlike(rf"[^{named}\p{{IsCommon}}\p{{IsInherited}}\p{{Cn}}]"), F.lit("OTHER"))
    wide = F.array_compact(F.array(*flags, other))
    ascii_only = F.when(text.rlike("[A-Za-z]"), F.array(F.lit("LATIN"))).otherwise(
        F.array().cast("array<string>")
    )
    return F.when(text.rlike(r"[^\x00-\x7F]"), wide).otherwise(ascii_only)


def skeleton(text: Column) -> Column:
    return F.translate(text, cc.CONFUSABLE_FROM, cc.CONFUSABLE_TO)


# Blocks searched for characters that a normal form leaves alone; everything outside counts as risky.
_STABLE_BLOCKS = ((0x0000, 0x052F), (0x2010, 0x2027))


@cache
def _risky_class(form: str) -> str:
    """Regex class of the characters a text must hold to be changed by ``form`` (a superset of them).

    A character is safe if the form keeps it and it never attaches to a neighbour (no mark, class 0).
    """
    safe = [
        cp for low, high in _STABLE_BLOCKS for cp in range(low, high + 1)
        if unicodedata.normalize(form, chr(cp)) == chr(cp) and not unicodedata.combining(chr(cp))
        and not unicodedata.category(chr(cp)).startswith("M")
    ]
    return _beyond(safe)


@cache
def compatibility_class() -> str:
    """Regex class of characters outside the searched blocks or with a compatibility mapping inside them."""
    nf = unicodedata.normalize
    same = [
        cp for low, high in _STABLE_BLOCKS for cp in range(low, high + 1)
        if nf("NFKC", chr(cp)) == nf("NFC", chr(cp)) and nf("NFKD", chr(cp)) == nf("NFD", chr(cp))
    ]
    return _beyond(same)


def _beyond(code_points: list[int]) -> str:
    """Regex class of the characters outside ASCII that are none of these ascending code points."""
    edges = [0x7F, *(cp for cp in code_points if cp > 0x7F), 0x110000]
    gaps = [(a + 1, b - 1) for a, b in zip(edges, edges[1:]) if b - a > 1]
    return wide(cc.searched_class(gaps))


def _normalizer(form: str):
    @F.pandas_udf(StringType())
    def normalize(values: pd.Series) -> pd.Series:
        return values.str.normalize(form)

    return normalize


def _list_normalizer(form: str, spaces: str | None):
    """Element-wise form; with ``spaces`` set, runs of those characters are passed through untouched."""

    @F.arrow_udf(ArrayType(StringType()))
    def normalize(values: pa.Array) -> pa.Array:
        nf = unicodedata.normalize
        odd = re.compile(f"([{spaces}]+)") if spaces else None

        def one(item):
            if item is None:
                return None
            if odd is None or not odd.search(item):
                return nf(form, item)
            return "".join(part if odd.fullmatch(part) else nf(form, part) for part in odd.split(item))

        return pa.array([None if items is None else [one(x) for x in items] for items in values.to_pylist()], pa.list_(pa.string()))

    return normalize


def needs_normalizing(text: Column, form: str) -> Column:
    return text.rlike(_risky_class(form))


def normalize(text: Column, form: str) -> Column:
    """Unicode normal form; only rows that can change are sent to the Arrow worker."""
    risky = F.when(needs_normalizing(text, form), text)
    return F.coalesce(_normalizer(form)(risky), text)


def normalize_all(items: Column, form: str, keep_spaces: bool = False) -> Column:
    """Element-wise normal form of a string array (NULL passes through); optionally between spaces only."""
    # ASCII spaces never change or combine, so only the others split a text.
    spaces = "".join(chr(c) for c in NON_ASCII_SPACES) if keep_spaces else None
    return _list_normalizer(form, spaces)(items)
