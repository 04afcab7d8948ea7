"""The word model counts by chunks of texts; what it shuffles is a few bytes for each n-gram of a chunk."""

import random

import numpy as np

from normlake.llm import lm
from tests.llm.test_exact import word_scores


def table(spark, tmp_path, texts, files):
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, None), (7, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(files).write.parquet(f"{tmp_path}/documents")
    return rows, spark.read.parquet(f"{tmp_path}/documents")


def test_chunks_of_several_files_give_the_scores_of_the_whole(spark, tmp_path, monkeypatch):
    from normlake.llm.common import same_twice

    monkeypatch.setattr(lm, "CHUNK", 1000)
    monkeypatch.setattr(lm, "CHUNK_TEXTS", 9)
    rng = random.Random(5)
    rows, docs = table(spark, tmp_path, [" ".join(rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(rng.randint(0, 120))) for _ in range(60)], 3)
    assert same_twice(docs) and not same_twice(docs.repartition(2))
    want = sorted(word_scores(rows, rows), key=lambda r: (str(r[0]), r[1], r[2]))
    for frame in (docs, docs.repartition(2)):
        got = sorted(((r.doc_id, r.n_words, r.log_score) for r in lm.score_words(frame).collect()), key=lambda r: (str(r[0]), r[1], r[2]))
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert np.allclose([r[2] for r in got], [r[2] for r in want])


def test_few_bytes_are_shuffled_for_an_ngram(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30_000)]
    rows, docs = table(spark, tmp_path, [" ".join(rng.choices(words, k=3000)) for _ in range(60)], 1)
    grams = len({tuple(w[i:i + k]) for _, t in rows for w in [(t or "").split()] for k in (1, 2, 3) for i in range(len(w) - k + 1)})
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert lm.score_words(docs).count() == len(rows)
    lm.score_words(docs).write.format("noop").mode("overwrite").save()
    assert written() - before < 2 * 13 * grams
