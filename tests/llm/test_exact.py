"""Operators with one right answer, against plain Python or the public libraries."""

import codecs
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from public_tokenizers import path
from pyspark.sql import functions as F

from normlake.llm import fingerprinting, licenses, lm, mixing, neardup, ogg, pieces, sharding, simhash
from normlake.llm.components import components
from tests.llm.odd import ROWS, crowded, documents, nothing, rows

SPACES = "[\x20\x09-\x0d]+"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return [w for w in re.split(SPACES, text) if w]


def majority(terms):
    """terms: (text, weight)"""
    votes, n = [0] * 64, sum(w for _, w in terms)
    for text, weight in terms:
        h = xxhash.xxh64_intdigest(text.encode(), seed=42)
        for b in range(64):
            votes[b] += weight * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > n)


def shingled(text, width):
    w = words_of(text)
    return [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


# -- near-duplicates ------------------------------------------------------------------------------------------------
def grouped(prints, radius):
    """{doc_id: smallest id reachable}, brute force."""
    near = {i: {j for j in prints if bin(prints[i] ^ prints[j]).count("1") <= radius} for i in prints}
    out = {}
    for i in prints:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = min(seen)
    return out


def test_near_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for i in range(120)}
    for i in range(120, 200):
        w = texts[rng.randrange(i)].split()
        for _ in range(rng.randint(0, 2)):
            if w:
                w[rng.randrange(len(w))] = "Zz"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    prints = {i: majority([(s, 1) for s in shingled(lowered(t), 4)]) for i, t in texts.items()}
    want = grouped(prints, 4)
    got = rows(neardup.simhash_near_dedup(docs))
    assert got == sorted(((i, f"{prints[i]:016x}", want[i]) for i in texts), key=str)
    assert len(set(want.values())) < 200


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 5, 7, 9])
def test_links_reach_what_all_pairs_reach(spark, radius):
    rng = random.Random(radius)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(260):
        x = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(0, radius + 2)):
            x ^= 1 << b
        prints.append(x)
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(signed(x), signed(x)) for x in prints], "node long, fp long")
    for key_rows in (1 << 16, 1):
        roots = {r.node: r.root for r in components(neardup.links(nodes, radius, key_rows=key_rows)).collect()}
        got = {}
        for x in prints:
            got.setdefault(roots.get(signed(x), signed(x)), set()).add(x)
        want = {}
        for x, root in grouped(dict(enumerate(prints)), radius).items():
            want.setdefault(root, set()).add(prints[x])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_dedup_of_odd_rows(spark):
    prints = [majority([(s, 1) for s in shingled(lowered(r[1]), 4)]) for r in ROWS]
    want = grouped(dict(enumerate(prints)), 4)
    members = {}
    for i, root in want.items():
        members.setdefault(root, []).append(ROWS[i][0])
    expected = [(ROWS[i][0], f"{prints[i]:016x}", min((m for m in members[want[i]] if m is not None), default=None)) for i in range(len(ROWS))]
    for docs in (documents(spark), crowded(spark)):
        assert rows(neardup.simhash_near_dedup(docs)) == sorted(expected, key=str)
    assert rows(neardup.simhash_near_dedup(nothing(spark))) == []


def test_keep_one_leaves_one_of_each_group(spark):
    kept = neardup.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [i[1] for i in ids if not i[0]] == [1, 3, 4, 7, 8, 9, 10]
    assert neardup.keep_one(nothing(spark)).count() == 0


def test_chains_of_links_become_one_component(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(rows(components(spark.createDataFrame(pairs, "a long, b long"))))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- fingerprints ---------------------------------------------------------------------------------------------------
def weighted(text):
    return majority([(s, len(s.encode())) for s in shingled((text or "").lower(), fingerprinting.WIDTH)])


def edit_rows(table):
    order = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42))))
    for at, row in enumerate(order):
        text, following = row[1] or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        yield row[0], text, text[:len(text) - half] + following[:half], following


def test_fingerprints_of_edits(spark):
    want = sorted(((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{weighted(t):016x}", f"{weighted(e):016x}") for i, t, e, _ in edit_rows(ROWS)), key=str)
    for docs in (documents(spark), crowded(spark).repartition(5)):
        got = fingerprinting.fingerprint_edits(docs)
        assert rows(got.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")) == want
        near = {(r.fingerprint, r.edited_fingerprint): r.near_edited for r in got.collect()}
        for (a, b), value in near.items():
            apart = bin(int(a, 16) ^ int(b, 16)).count("1")
            assert abs(value - max(0.0, np.cos(np.pi * apart / 64))) < 1e-12
    assert fingerprinting.fingerprint_edits(nothing(spark)).count() == 0
    alone = fingerprinting.fingerprint_edits(documents(spark).where("doc_id = 7")).first()
    assert alone.near_next == 1.0 and alone.near_found is None


def test_edits_across_many_ranges(spark):
    table = [(i * i, f"text number {i} " * (i % 7), "en", "s", 0) for i in range(300)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    want = sorted((i, hashlib.sha256(e.encode()).hexdigest()) for i, _, e, _ in edit_rows(table))
    assert sorted((r.doc_id, r.edited_sha256) for r in fingerprinting.fingerprint_edits(docs).collect()) == want


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(50)]
    prints = base + [x ^ sum(1 << b for b in rng.sample(range(64), k)) for x in base for k in (1, 2, 3, 4)]
    table = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    got = {(r.query_fp, r.fp, r.distance) for r in simhash.search(table, table.limit(20), 3, 6).collect()}
    asked = {r.fp for r in table.limit(20).collect()}
    unsigned = lambda x: x % (1 << 64)
    want = {(q, signed(x), bin(unsigned(q) ^ x).count("1")) for q in asked for x in prints if bin(unsigned(q) ^ x).count("1") <= 3}
    assert got == want


# -- sharding -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_feistel_is_a_permutation_with_an_inverse(n):
    cipher = sharding.Feistel(n, 11)
    at = cipher.position(np.arange(n))
    assert sorted(at) == list(range(n)) and (cipher.row(at) == np.arange(n)).all()
    shard, slot = sharding.locate(np.arange(n), n, 4, 11)
    assert (sharding.row_at(shard, slot, n, 4, 11) == np.arange(n)).all()


def test_shards(spark):
    for docs in (documents(spark), crowded(spark).repartition(3)):
        got = sharding.shard_documents(docs, 5).collect()
        data = [(r[1] or "").encode() for r in ROWS]
        assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted(
            (r[0], len(d) + 1, zlib.crc32(d)) for r, d in zip(ROWS, data) if r[0] is not None)
        slots = {}
        for r in got:
            assert r.law == "rows" and r.grown_shard is None
            slots.setdefault(r.shard, []).append(r.slot)
        assert sorted(len(s) for s in slots.values()) == [2, 2, 2, 3, 3]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    same = rows(sharding.shard_documents(documents(spark), 5))
    assert same == rows(sharding.shard_documents(documents(spark).repartition(4), 5))
    assert sharding.shard_documents(nothing(spark), 5).count() == 0


# -- media ----------------------------------------------------------------------------------------------------------
def test_checksum_is_the_plain_bitwise_one():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
        return crc

    for data in (b"", b"123456789", bytes(range(256)) * 3):
        assert ogg.checksum(data) == slow(data)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 1920, 1921, 3841, 6000, 50_000])
def test_ogg_round_trip(n):
    data = random.Random(n).randbytes(n)
    media = ogg.write(ogg.padded(data))
    streams, bad = ogg.read(media)
    assert ogg.samples(streams) == ogg.padded(data) and bad == 0 and sorted(streams) == list(ogg.SERIALS)
    assert all(s.ended and s.head == ogg.HEAD and not s.faults for s in streams.values())
    for stream in streams.values():  # times run on without gaps
        assert [start for start, _ in stream.packets] == [sum(len(p) for _, p in stream.packets[:i]) for i in range(len(stream.packets))]


def test_damaged_pages_are_left_out():
    payload = ogg.padded(random.Random(1).randbytes(60_000))
    media = bytearray(ogg.write(payload))
    starts = [m.start() for m in re.finditer(b"OggS", media)]
    media[starts[5] + 60] ^= 1
    streams, bad = ogg.read(bytes(media))
    assert bad == 1 and sum(s.faults for s in streams.values()) >= 1
    for stream in streams.values():
        for start, packet in stream.packets:
            assert len(packet) in (ogg.PACKET, len(payload) % ogg.PACKET)
    assert ogg.read(b"OggS\0")[1] == 1 and ogg.read(b"") == ({}, 0)


def test_media_of_odd_rows(spark):
    want = []
    for r in ROWS:
        data = (r[1] or "").encode()
        payload = data + b" " * ((-len(data)) % 192 if data else 192)
        want.append((r[0], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(ogg.write(payload)).hexdigest()))
    for docs in (documents(spark), crowded(spark)):
        got = ogg.media_digest(docs)
        assert rows(got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256")) == sorted(want, key=str)
        assert all(";bad=0;" in r.feature for r in got.collect())
    assert ogg.media_digest(nothing(spark)).count() == 0


# -- pieces ---------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def model():
    codecs.register_error("normlake-each", pieces._each)
    return pieces.load(path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(model, library):
    rng = random.Random(2)
    alphabet = "ab ▁\n\téß漢😀<s>0x A.,"
    texts = [r[1] or "" for r in ROWS] + ["  a  b ", "<s></s><unk><0x41>", "x" * 500, "ab" * 900, " ", "▁", "▁▁ ▁"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 150))) for _ in range(300)]
    for text in texts:
        ids, starts, ends = model.encode(text)
        assert ids.tolist() == library.encode(text), text[:50]
        assert model.decode(ids.tolist()) == library.decode(ids.tolist())
        if len(ids):
            data = text.encode()
            assert starts[0] == 0 and ends[-1] == len(data) and (starts[1:] == ends[:-1]).all()
            for i, a, b in list(zip(ids, starts, ends))[1:]:
                if model.kinds[i] == pieces.NORMAL:
                    assert data[a:b].decode().replace(" ", "▁") == model.pieces[i]


def test_decode_equals_the_library_on_any_ids(model, library):
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 9))]
        assert model.decode(ids) == library.decode(ids), ids


def double_array(keys):
    """A small compiled map: unit 0 is the root; transitions by XOR with an offset."""
    units, strings, used, states = {}, b"", {0}, [(0, sorted(keys))]
    pending = {}
    for key, out in keys.items():
        pending[key] = len(strings)
        strings += out + b"\0"
    free = 256
    while states:
        node, group = states.pop()
        depth = pending.get(("depth", node), 0)
        base, free = free, free + 256
        leaf = [k for k in group if len(k) == depth]
        label = units.get(node, 0)
        units[node] = label | ((base ^ node) << 10 if (base ^ node) < 1 << 21 else 0) | (256 if leaf else 0)
        if leaf:
            units[base] = 0x80000000 | pending[leaf[0]]
        for byte in sorted({k[depth] for k in group if len(k) > depth}):
            child = base ^ byte
            units[child] = byte
            pending[("depth", child)] = depth + 1
            states.append((child, [k for k in group if len(k) > depth and k[depth] == byte]))
    size = max(units) + 1
    return struct.pack("<I", 4 * size) + struct.pack(f"<{size}I", *[units.get(i, 0) for i in range(size)]) + strings


def test_mapped_normalisation_keeps_source_offsets(model):
    table = {"ﬁ".encode(): b"fi", "é".encode(): "e".encode(), "ab".encode(): b"X", b"abc": b"YZ", " ".encode(): b" ", b"\r": b""}
    charmap = pieces.CharacterMap(double_array(table))
    assert charmap.longest(b"abcd", 0) == (3, b"YZ") and charmap.longest(b"abd", 0) == (2, b"X") and charmap.longest(b"b", 0) is None
    mapped = pieces.load(path("piece_bpe_32k.model"))
    mapped.charmap = charmap
    chars, starts, ends = mapped.normalise("ﬁé abcq\r")
    assert "".join(chars) == "▁fie▁YZq" and starts == [0, 0, 3, 3, 5, 7, 10, 10] and ends == [0, 3, 3, 5, 7, 10, 10, 11]
    ids, first, last = mapped.encode("ﬁé abcq")
    assert ids.tolist() == model.encode("fie YZq")[0].tolist() and last[-1] == 11 and first[0] == 0
    mapped.squeeze = True
    assert "".join(mapped.normalise("  a   b  ")[0]) == "▁a▁b"
    assert mapped.encode("   ")[0].tolist() == []


def test_token_digests_of_odd_rows(spark, model, library):
    want = []
    for r in ROWS:
        ids = library.encode(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((r[1] or "").encode())))
    for docs in (documents(spark), crowded(spark)):
        assert rows(pieces.token_digest(docs, model)) == sorted(want, key=str)
    assert pieces.token_digest(nothing(spark), model).count() == 0


# -- license scans --------------------------------------------------------------------------------------------------
def places(words, phrase):
    phrase = phrase.split()
    return [i for i in range(len(words) - len(phrase) + 1) if words[i:i + len(phrase)] == phrase]


def test_license_scan_bases(spark):
    texts = [r[1] for r in ROWS] + [
        "Licensed under CC BY-NC 4.0. All rights reserved; CC-BY", "the GNU General Public License, version 3", "all rights reserved " * 30, "general public",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of the said software and associated documentation files", "cc", "cc by",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, text in enumerate(texts):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
        found = {label: places(words, phrase) for label, phrase in licenses.BASE}
        every = [p for ps in found.values() for p in ps]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(every)), text
        assert (r.first_word, r.last_word) == ((min(every), max(every)) if every else (None, None))
        assert r.base_labels == ",".join(sorted(k for k, v in found.items() if v))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "mit-grant" in got[len(ROWS) + 4].labels.split(",") and "cc-by-nc" in got[len(ROWS)].labels
    assert got[0].labels == "" and got[0].score < 1


def test_license_spans_are_verified(spark):
    bsd = dict(licenses.TEMPLATES)["bsd"].split()
    cut = " foo bar ".join(" ".join(pair) for pair in zip(bsd, bsd[1:]))
    texts = [
        cut, "released under foo bar under the foo bar the mit foo bar mit license", " ".join(bsd[7:] + bsd[:7]), "license mit the under released " * 40,
        " ".join(bsd), " ".join([*bsd[:4], "or", *bsd[4:9], "any", *bsd[9:]]), " ".join([*bsd[:5], *bsd[6:]]), "x " * 3000 + " ".join(bsd),
    ]
    texts = [t + " z" * 50 * i for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string")  # one id, many texts
    got = {r.n_words: r for r in licenses.scan(docs).collect()}
    got = [got[len(t.split())] for t in texts]
    assert [r.labels for r in got] == ["", "", "", "", "bsd", "bsd", "bsd", "bsd"]
    assert got[0].score < 0.5 and got[1].score <= 0.5 and got[4].score == got[7].score == 1.0


def test_license_templates_of_any_length_from_a_table(spark):
    words = [f"w{i % 90}x{i % 7}" for i in range(500)]
    table = spark.createDataFrame([("long", " ".join(words)), ("twice", "a b a b"), ("one", "a")], "label string, text string")
    edited = [*words[:100], *["new"] * 20, *words[100:300], *words[330:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[250:] + words[:250])), (4, "a b"), (5, None), (6, "a b a b")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs, templates=table).collect()}
    assert {i: r.labels for i, r in got.items()} == {1: "long", 2: "long", 3: "", 4: "", 5: "", 6: "twice"}
    assert got[1].score == 1.0 and got[2].score == pytest.approx((499 - 32) / 499) and got[6].score == 1.0


def test_license_scan_of_odd_rows(spark):
    plain = rows(licenses.scan(documents(spark)))
    assert len(plain) == len(ROWS) and plain == rows(licenses.scan(crowded(spark)))
    assert licenses.scan(nothing(spark)).count() == 0
    with pytest.raises(ValueError):
        licenses.template_rows([("x", "one")], [])


# -- n-gram scores --------------------------------------------------------------------------------------------------
def backoff_scores(table, scored):
    counts, contexts = Counter(), Counter()

    def grams(text):
        data = lm.PAD + (text or "").encode()
        return [data[i - lm.ORDER + 1:i + 1] for i in range(lm.ORDER - 1, len(data))]

    for r in table:
        for g in grams(r[1]):
            for k in range(1, lm.ORDER + 1):
                counts[g[-k:]] += 1
                contexts[k, g[-k:-1]] += 1

    def score(g):
        if len(g) == 1 or counts[g] >= lm.MIN_COUNT:
            return np.log(counts[g] / contexts[len(g), g[:-1]])
        return np.log(lm.BACKOFF) + score(g[1:])

    return [(r[0], len((r[1] or "").encode()), sum(map(score, grams(r[1])))) for r in scored]


def test_backoff_scores_match_brute_force(spark, monkeypatch):
    want = sorted(backoff_scores(ROWS, ROWS), key=str)
    for limit in (lm.SENT_ROWS, 0):  # sent to all tasks, and joined by shuffle
        monkeypatch.setattr(lm, "SENT_ROWS", limit)
        got = rows(lm.score_documents(crowded(spark)))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        for g, w in zip(got, want):
            assert abs(g[2] - w[2]) < 1e-6 * max(1, abs(w[2])) and (g[3] is None) == (w[1] == 0)
    assert lm.score_documents(nothing(spark)).count() == 0


def word_scores(table, scored):
    counts = Counter()
    for _, text in table:
        w = words_of(lowered(text or ""))
        counts.update(tuple(w[i:i + k]) for k in range(1, lm.WORDS + 1) for i in range(len(w) - k + 1))
    total = sum(n for g, n in counts.items() if len(g) == 1)

    def score(g):
        if len(g) == 1:
            return np.log(counts[g] / total) if counts[g] else -np.log(total + 1)
        return np.log(counts[g] / counts[g[:-1]]) if counts[g] >= lm.MIN_COUNT else np.log(lm.BACKOFF) + score(g[1:])

    out = []
    for i, text in scored:
        w = words_of(lowered(text or ""))
        out.append((i, len(w), sum(score(tuple(w[max(0, k - lm.WORDS + 1):k + 1])) for k in range(len(w)))))
    return out


@pytest.mark.parametrize("frequent", [1 << 14, 1])
def test_word_scores_match_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rng = random.Random(3)
    table = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))) for i in range(40)] + [(r[0], r[1]) for r in ROWS]
    other = [(1, "a b c a b zebra c d"), (1, "a b c a b zebra c d"), (2, None), (3, "zebra"), (4, "A b")]
    frame = lambda t: spark.createDataFrame(t, "doc_id long, text string")
    for scored, got in ((table, lm.score_words(frame(table))), (other, lm.score_words(frame(other), frame(table)))):
        want = sorted(word_scores(table, scored), key=lambda r: (str(r[0]), r[1], r[2]))
        found = sorted(((r.doc_id, r.n_words, r.log_score, r.mean_log_score) for r in got.collect()), key=lambda r: (str(r[0]), r[1], r[2]))
        assert [r[:2] for r in found] == [r[:2] for r in want]
        assert np.allclose([r[2] for r in found], [r[2] for r in want])
        assert all((r[3] is None) == (r[1] == 0) for r in found)


def test_the_query_scores_words(spark):
    from normlake.llm.queries import QUERIES
    assert "n_words" in QUERIES["op9_lm_scoring"](spark, "/root/testdata/sf0.001").columns


# -- mixing ---------------------------------------------------------------------------------------------------------
def filled(total, children):
    """{name: amount} by weight under caps, with exact fractions."""
    from fractions import Fraction

    left, out, open_ = Fraction(total), {}, dict(children)
    while open_:
        weight = sum(w for w, _ in open_.values())
        short = {k: c for k, (w, c) in open_.items() if weight == 0 or c * weight <= w * left}
        if weight == 0 or not short:
            return out | {k: (w * left / weight if weight else Fraction(0)) for k, (w, _) in open_.items()}
        for k, cap in short.items():
            out[k] = Fraction(cap)
            left -= cap
            del open_[k]
    return out


def test_budgets_go_down_the_tree(spark):
    rng = random.Random(8)
    table = [(i, "w " * rng.choice([1, 5, 40, 300]), rng.choice(["en", "de"]), f"src{rng.choice([0, 1, 1, 1, 2, 3])}", 0) for i in range(400)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    weights = ({"d0": 5, "d1": 1, "d2": 3}, {"en": 3}, {})
    got = mixing.mix(docs, weights, (3, 5), 2).collect()
    tokens = Counter()
    for r in table:
        tokens[f"d{int(r[3][3:]) % 4}", r[2], r[3]] += len(r[1].split())
    budget = {(r["_domain"], r["_lang"], r["_source"]): r["_budget"] for r in got}
    assert budget.keys() == tokens.keys()
    total = min(sum(tokens.values()) * 3 // 5, 2 * sum(tokens.values()))
    assert sum(budget.values()) == total
    cap = lambda *path: 2 * sum(n for k, n in tokens.items() if k[:len(path)] == path)
    domains = filled(total, {d: (weights[0].get(d, 1), cap(d)) for d in {k[0] for k in tokens}})
    for d, amount in domains.items():
        mine = sum(b for k, b in budget.items() if k[0] == d)
        assert abs(mine - amount) <= 1
        for lang, part in filled(mine, {k[1]: (weights[1].get(k[1], 1), cap(d, k[1])) for k in tokens if k[0] == d}).items():
            assert abs(sum(b for k, b in budget.items() if k[:2] == (d, lang)) - part) <= 1
    taken, size = Counter(), {r[0]: len(r[1].split()) for r in table}
    for r in got:
        taken[r["_domain"], r["_lang"], r["_source"]] += r["_epochs"] * size[r["doc_id"]]
    for leaf, amount in budget.items():
        assert amount <= taken[leaf] < amount + 300 and (amount < 2 * tokens[leaf] or taken[leaf] == amount)


def test_mixing_odd_rows(spark):
    weights = ({}, {"de": 0}, {})
    got = mixing.mix(crowded(spark), weights)
    assert got.count() == len(ROWS)
    assert all(r["_epochs"] == 0 for r in got.where("lang = 'de'").collect())
    assert {r["_source"] for r in got.where("source IS NULL").collect()} == {""}
    assert rows(got.select("doc_id", "_epochs")) == rows(mixing.mix(documents(spark).repartition(3), weights).select("doc_id", "_epochs"))
    assert mixing.mix(nothing(spark), weights).count() == 0
