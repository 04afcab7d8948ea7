"""Token alignment, nearest neighbours and phrase mining against plain Python, SQL and the public libraries."""

import hashlib
import json
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path
from tokenizers import Tokenizer

from normlake.llm import alignment, ann, phrases
from tests.llm.odd import LONG, ROWS, crowded, documents, nothing, rows

EXTRA = ["a ▁ mark", "tab\tand  two", " lead", "x\n\n y <|endoftext|> z", "\U0001F600é漢", "ends in space ", "\x00 nul", "don't I'll", "a" * 300]


# -- token alignment ------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def words():
    return alignment.Vocabularies(path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


def plain_tokens():
    """Ids and bytes of both tokenizers straight from the libraries and the vocabulary file."""
    a = Tokenizer.from_file(path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    shown = alignment.byte_alphabet()
    entry = {i: t for t, i in json.load(open(path("byte_bpe_50k.json"), encoding="utf-8"))["model"]["vocab"].items()}

    def piece(i):
        text = b.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if re.fullmatch("<0x..>", text) else text.replace("▁", " ").encode()

    def both(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        return [(i, bytes(shown[c] for c in entry[i])) for i in x], [(i, piece(i)) for i in y]

    return both


def plain_alignment(texts):
    both, links, shown = plain_tokens(), [], []
    for text in texts:
        a, b = both(text) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(t for _, t in a) != want or b"".join(t for _, t in b) != want:
            links.append([])
            shown.append((0, 0, ""))
            continue
        ends = [{}, {}]
        for side, tokens in enumerate((a, b)):
            at = 0
            for k, (_, t) in enumerate(tokens):
                at += len(t)
                ends[side][at] = k
        own, groups, i, k = [], [], 0, 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            j, m = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(str(x) for x, _ in a[i:j]) + "|" + ",".join(str(x) for x, _ in b[k:m]))
            own.append((a[j - 1][0], b[m - 1][0]))
            i, k = j, m
        links.append(own)
        shown.append((len(a), len(b), ";".join(groups)))
    count = Counter(x for own in links for x in own)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(*s[:2], len(own), len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own),
             hashlib.sha256(s[2].encode()).hexdigest() if s[0] else "") for s, own in zip(shown, links)]


def test_alignment_matches_plain_python(spark, words):
    texts = [r[1] for r in ROWS] + EXTRA
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in alignment.align_documents(docs, words).collect()}
    want = plain_alignment(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert [w[0] for w in want].count(0) >= 3


def test_alignment_of_odd_tables(spark, words):
    want = sorted(((r[0], *w) for r, w in zip(ROWS, plain_alignment([r[1] for r in ROWS]))), key=str)
    assert rows(alignment.align_documents(crowded(spark), words)) == want
    assert rows(alignment.align_documents(nothing(spark), words)) == []


def test_long_texts_are_aligned_in_parts(words, monkeypatch):
    whole = alignment.Aligner(words).align([LONG])[0]
    monkeypatch.setattr(alignment, "CUT", 1000)
    monkeypatch.setattr(alignment, "KEPT_WINDOWS", 10)
    parts = alignment.Aligner(words).align([LONG, "", LONG])
    for got in (parts[0], parts[2]):
        assert got[:4] == whole[:4] and (got[4] == whole[4]).all() and (got[5] == whole[5]).all()
    assert parts[1][:4] == (0, 0, 0, "")


def test_vocabularies_bound_the_links(words):
    some = random.Random(3).sample(words.pairs.tolist(), 500)
    for pair in some:
        a, b = words.a_bytes[pair >> 16], words.b_bytes[pair & 0xFFFF]
        assert a.endswith(b) or b.endswith(a)


# -- nearest neighbours ---------------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>"


def plain_nearest(table, every=20, top=20):
    out = []
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in table if v and None not in v and np.isfinite(v).all() and any(v)]
    for at, (i, q) in enumerate(fine):
        if i is None or i % every:
            continue
        near = sorted(((-(q * v).sum(), j is None, j or 0) for k, (j, v) in enumerate(fine) if k != at and len(v) == len(q)))[:top]
        out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(near)]
    return out


def close(got, want):
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-12)


def test_recall_on_vectors_of_all_lengths_of_norm(spark):
    rng = np.random.default_rng(4)
    table = [(i, v.tolist()) for i, v in enumerate((rng.normal(size=(3000, 24)) * rng.uniform(0.2, 3, (3000, 1))).astype(np.float32))]
    got, want = ann.nearest(spark.createDataFrame(table, VECTORS).repartition(4)).collect(), plain_nearest(table)
    assert len(got) == len(want)
    found, sought = {(r.query_id, r.vec_id) for r in got}, {(r[0], r[2]) for r in want}
    assert len(found & sought) >= 0.93 * len(sought)
    by_id = dict(table)
    for r in got[::7]:
        exact = (np.array(by_id[r.query_id], np.float32).astype(float) * np.array(by_id[r.vec_id], np.float32).astype(float)).sum()
        assert abs(r.score - exact) < 1e-12


def test_all_axes_are_the_exact_search(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "GROUP", 200)
    rng = np.random.default_rng(5)
    base = rng.integers(-2, 3, (150, 6)).astype(np.float32)
    table = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base[:60], base[:20]]))]  # many ties
    got = ann.nearest(spark.createDataFrame(table, VECTORS), every=5, visits=1 << 20).collect()
    got, want = sorted(map(tuple, got)), sorted(plain_nearest(table, every=5))
    close(got, want)
    assert [r[2] for r in got] == [r[2] for r in want]


def test_neighbours_of_odd_rows(spark):
    table = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, None), (60, [0.0, 0.0]), (80, []), (100, [float("nan"), 1.0]),
             (120, [float("inf"), 1.0]), (140, [None, 1.0]), (None, [1.0, 0.0]), (7, [-1.0, 0.5]), (160, [1.0, 2.0, 3.0]), (161, [1.0, 0.0, 0.0])]
    docs = spark.createDataFrame(table, VECTORS).selectExpr("*", "'x' AS score", "1 AS row", "2 AS cell", "3 AS rank")
    got = sorted(map(tuple, ann.nearest(docs).collect()), key=str)
    want = sorted(plain_nearest(table), key=str)
    assert got == want
    assert ann.nearest(spark.createDataFrame([], VECTORS)).collect() == []


# -- phrases --------------------------------------------------------------------------------------------------------
def plain_phrases(table, support, longest, top):
    counts, sizes = {}, Counter()
    for text, lang in table:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            w = re.findall("[^ \t]+", piece)
            sizes[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, own in counts.items():
        found = []
        for p, a in own.items():
            if len(p) < 2 or a < support or any(n >= a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for q, n in own.items() if n >= support):
                continue
            score, _, left, right = min((1000 * a * sizes[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for n, (score, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, n + 1, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "Über", "'tis", "x-y"]
    table = []
    for i in range(150):
        words = [rng.choice(vocab[:rng.choice([6, 44])]) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            words[5:5] = "Once upon a time there Lived".split()
        table.append((rng.choice([" ", "  ", " \t"]).join(w + rng.choice(["", "", "", ". ", ",", "!\n"]) for w in words), rng.choice(["en", "de", None])))
    return table + [(None, "en"), ("", None), (" \t. ;", "fr"), ("a\x1cb c\x1cd", "fr")] + [("same text again and again", "en")] * 12


@pytest.mark.parametrize("shards, support", [(4, 9), (1, 5), (8, 4)])
def test_collocations_match_plain_python(spark, shards, support):
    table = corpus()
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(table)], "doc_id long, text string, lang string").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(docs, support, 5, 50, shards).collect())
    assert got == plain_phrases(table, support, 5, 50)
    assert len(got) > 20


def test_collocations_match_their_sql(spark):
    table = corpus(2)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", table)
    want = sorted(con.execute(phrases.oracle(6, 4, 30)).fetchall())
    assert want == plain_phrases(table, 6, 4, 30)


def test_crowded_bits_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FLUSH", 50)
    monkeypatch.setattr(phrases, "TEXT", 200)
    table = corpus(3)
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(table)], "doc_id long, text string, lang string")
    small = phrases.bit_set
    monkeypatch.setattr(phrases, "bit_set", lambda rows, parts: small(rows, parts, 9))
    assert sorted(tuple(r) for r in phrases.collocations(docs, 8, 5, 50).collect()) == plain_phrases(table, 8, 5, 50)


def test_collocations_of_odd_rows(spark):
    want = plain_phrases([(r[1], r[2]) for r in ROWS], 3, 3, 100)
    for docs in (documents(spark), crowded(spark)):
        assert sorted(tuple(r) for r in phrases.collocations(docs, 3, 3, 100).collect()) == want
    assert phrases.collocations(nothing(spark)).collect() == []
