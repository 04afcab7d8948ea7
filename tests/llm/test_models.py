"""Operators that learn: exact arithmetic against plain versions, and accuracy on rows that training never saw."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from normlake.llm import ppm, toxicity
from normlake.llm.grams import KeyIndex
from normlake.llm.queries import ORACLES, QUERIES
from tests.llm.odd import ROWS, SCHEMA, crowded, documents, nothing, rows

DATA = "/root/testdata/sf0.01"


def test_key_index_finds_every_key_and_nothing_else():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000)).astype(np.uint64)
    index = KeyIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(np.setdiff1d(rng.integers(0, 1 << 40, 5000).astype(np.uint64), keys)) == -1).all()
    assert KeyIndex(keys[:0]).find(keys[:3]).tolist() == [-1, -1, -1]


# -- language ID ----------------------------------------------------------------------------------------------------
class PlainTrees:
    """The same statistics in dictionaries, walked byte by byte."""

    def __init__(self, texts):
        self.after = {}
        for text in texts:
            data = ppm.PAD + text.encode()
            for i in range(ppm.ORDER, len(data)):
                for k in range(ppm.ORDER + 1):
                    self.after.setdefault(data[i - k:i], Counter())[data[i]] += 1

    def bits(self, text):
        data, total = ppm.PAD + text.encode(), 0.0
        for i in range(ppm.ORDER, len(data)):
            for k in range(ppm.ORDER, -1, -1):
                seen = self.after.get(data[i - k:i])
                if seen is None:
                    continue
                whole = sum(seen.values()) + len(seen)
                if seen[data[i]]:
                    total -= math.log2(seen[data[i]] / whole)
                    break
                total -= math.log2(len(seen) / whole)
            else:
                total += 8
        return total


TRAINING = [("aa", "the cat and the dog and the man"), ("aa", "there is a cat on that mat"), ("bb", "der hund und die katze"), ("bb", "über das äußere öl"), ("cc", "漢字かな交じり")]


def trees_of(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(TRAINING)], "doc_id long, text string, lang string")
    return ppm.train(docs)


def test_code_lengths_are_exact(spark):
    trees = trees_of(spark)
    assert trees.langs == ["aa", "bb", "cc"]
    plain = {lang: PlainTrees([t for own, t in TRAINING if own == lang]) for lang in trees.langs}
    texts = ["the cat", "katze", "é", "漢字", "", "zzzz qqqq", "the hund über", "x" * 3000]
    got = trees.bits([t.encode() for t in texts])
    for text, row in zip(texts, got):
        for lang, bits in zip(trees.langs, row):
            want = plain[lang].bits(text)
            assert abs(bits - want) <= 1e-5 * max(1.0, want), (text, lang)


def test_code_lengths_do_not_depend_on_the_cut(spark):
    trees = trees_of(spark)
    long = ("the cat and the dog " * 70_000).encode()  # longer than a portion
    whole = trees.bits([long, b"the cat"])
    parts = PlainTrees([t for lang, t in TRAINING if lang == "aa"])
    unit = parts.bits("the cat and the dog " * 12) - parts.bits("the cat and the dog " * 11)
    assert abs(whole[0, 0] - (parts.bits("the cat and the dog ") + unit * 69_999)) < 1e-4 * whole[0, 0]
    assert np.allclose(whole[1], trees.bits([b"the cat"])[0])


def test_language_of_odd_rows(spark):
    for docs in (documents(spark), crowded(spark)):
        got = ppm.held_out_language_id(docs).collect()
        assert len(got) == len(ROWS)
        for r in got:
            assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1)
            assert 0 <= r.score <= 1
        by_id = {r.doc_id: r for r in got}
        assert [by_id[i].lang_pred for i in (3, 6, 9)] == ["und"] * 3 and by_id[9].score == 0
        assert by_id[8].lang_pred == "de"
    assert ppm.held_out_language_id(nothing(spark)).count() == 0
    bare = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in ppm.held_out_language_id(bare).collect()} == {"und"}


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = ppm.held_out_language_id(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


# -- toxicity -------------------------------------------------------------------------------------------------------
def plain_keys(text):
    """Distinct n-grams of a text, hashed one at a time."""
    chars, out = [ord(c) for c in f" {text.lower()} " + " " * (max(toxicity.SIZES) - 1)], set()
    for size in toxicity.SIZES:
        for at in range(len(chars) - size + 1):
            h = chars[at] * 0x9E3779B1 & 0xFFFFFFFF
            for k in range(1, size):
                h = (h + chars[at + k]) * 0x85EBCA77 & 0xFFFFFFFF
                h ^= h >> 13
            out.add((h * 0xC2B2AE3D & 0xFFFFFFFF) >> 32 - toxicity.BITS)
    return out


@pytest.mark.parametrize("piece", [toxicity.PIECE, 40])
def test_features_are_the_distinct_ngrams(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    texts = ["", "a", "Ünïcode 漢😀 text", "abcabcabc " * 20, "the End"]
    keys = toxicity.present(iter(texts))
    for i, text in enumerate(texts):
        assert set((keys[keys >> toxicity.BITS == i] & (1 << toxicity.BITS) - 1).tolist()) == plain_keys(text), text


def test_held_out_toxicity(spark):
    docs = spark.createDataFrame([(i, ("calm words flow here " if i % 3 else "you vile scumbag ") + f"w{i * 7919 % 97} x{i % 11}") for i in range(600)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    got = toxicity.held_out_toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.predicted == r.toxic for r in got if r.held_out)
    # Labels of held-out rows change nothing.
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows(toxicity.held_out_toxicity(docs, turned)) == rows(toxicity.held_out_toxicity(docs, labels))


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (4, None), (None, 1), (8, 0), (8, 0), (10, 0), (99, 1)], "doc_id long, toxic int")
    for docs in (documents(spark), crowded(spark)):
        got = toxicity.held_out_toxicity(docs, labels).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert all(r.predicted == 0 for r in toxicity.held_out_toxicity(documents(spark), some).collect())
    assert toxicity.held_out_toxicity(nothing(spark), labels).count() == 0


def test_toxicity_does_not_depend_on_the_number_of_labels(spark):
    rng = np.random.default_rng(2)
    words = {0: ["calm", "flow", "river", "stone", "green"], 1: ["vile", "scum", "filth", "stone", "green"]}
    small = [(i, int(i % 9 == 0), " ".join(rng.choice(words[int(i % 9 == 0)] if rng.random() < 0.6 else words[int(rng.random() < 0.2)], 5))) for i in range(1800)]
    probe = spark.createDataFrame([(i, t) for i, _, t in small], "doc_id long, text string")
    mean = []
    for times in (1, 10):
        table = spark.createDataFrame([(k * 10_000 + i, label, t) for k in range(times) for i, label, t in small], "doc_id long, toxic int, text string")
        model = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"), class_rows=1600)
        mean.append(np.array([r.score for r in toxicity.score(probe, model).orderBy("doc_id").collect()]))
    assert abs(mean[0].mean() - mean[1].mean()) < 0.02
    assert np.abs(mean[0] - mean[1]).mean() < 0.03


# -- the pipeline ---------------------------------------------------------------------------------------------------
def labelled(tmp_path, spark):
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_take_odd_rows(tmp_path, spark):
    folder = labelled(tmp_path, spark)
    for docs in (crowded(spark), nothing(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == list(corpus_pipeline.COLUMNS), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).columns[0] == "doc_id"


def test_first_stage_rejects_what_has_no_language(tmp_path, spark):
    kept = corpus_pipeline.identify(spark, documents(spark), labelled(tmp_path, spark))
    assert {r.doc_id for r in kept.collect()}.isdisjoint({3, 6, 9})
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 8, None}


def test_near_copies_leave_one(spark, tmp_path):
    base = {i: " ".join(f"w{(i * 131 + k * k * 17 + k) % 4001}" for k in range(300)) for i in range(40)}
    table = [(i, t, "en", "s", len(t)) for i, t in base.items()]
    for i, t in base.items():
        w = t.split()
        w[30], w[200] = "changed", "words"
        table += [(100 + i, " ".join(w), "en", "s", 1), (200 + i, t, "en", "s", 1)]
    docs = spark.createDataFrame(table, SCHEMA)
    kept = corpus_pipeline.deduplicate(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))


def test_pipeline_counts_add_up(spark):
    small = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, small)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = got.collect()
    assert 0 < len(found) and all(r.covered_bytes == len(texts[r.doc_id].encode()) for r in found)


# -- the registered queries -----------------------------------------------------------------------------------------
def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins_agree(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.select(*columns)) == sorted(cursor.fetchall(), key=str)


def jaccard_keeps(texts, similar=0.8):
    """Ids that stay when all pairs are compared."""
    def cut(text):
        w = text.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = {i: cut(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted(i for i in texts if top(i) == i)


def test_near_dedup_links_at_the_stated_similarity(spark, tmp_path):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(1500)]
    words = lambda n: [vocabulary[int(k * k * 1500)] for k in rng.random(n)]
    texts = {}
    for i in range(30):
        w = words(int(rng.integers(90, 260)))
        n = len(w)
        block, far, wide = list(w), list(w), list(w)
        block[n // 3:n // 3 + n // 11] = words(n // 11)
        far[:n // 7] = words(n // 7)  # about 0.75
        for k in rng.choice(n, n // 45, replace=False):
            wide[k] = "other"
        for k, v in enumerate((w, block, w + words(n // 5), far, wide, [x.upper() for x in w])):
            texts[k * 100 + i] = " ".join(v)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    want = jaccard_keeps(texts)
    assert 30 < len(want) < 100
    assert sorted(r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, str(tmp_path)).collect()) == want
