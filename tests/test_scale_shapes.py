"""Joins and orderings whose work has to follow their input, against plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from normlake.functions import text as tx
from normlake.operators import lookalikes, needles, ocr, text_inventory, text_transform, urls
from normlake.operators.ordering import ranked, running_max

BOX = "image_id int, cluster_id int, left double, top double, right double, bottom double"


def touching(boxes):
    out = set()
    for i, (g, a, l1, t1, r1, b1) in enumerate(boxes):
        for h, b, l2, t2, r2, b2 in boxes:
            if g == h and min(r1, r2) > max(l1, l2) and min(b1, b2) > max(t1, t2):
                out.add((g, a, b))
    return out


def pairs(spark, boxes):
    got = [tuple(r) for r in ocr.touching_pairs(spark.createDataFrame(boxes, BOX), "image_id", "cluster_id").select("image_id", "a", "b").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_boxes_of_all_sizes_meet_once(spark):
    rng = random.Random(2)
    boxes = []
    for i in range(300):
        w, h = 4.0 ** -rng.uniform(0, 6), 4.0 ** -rng.uniform(0, 6)
        x, y = rng.uniform(-0.1, 1.1), rng.uniform(-0.1, 1.1)
        boxes.append((i % 2, i, x, y, x + w, y + h))
    boxes += [(0, 900, 0.25, 0.25, 0.5, 0.5), (0, 901, 0.5, 0.25, 0.75, 0.5), (0, 902, 0.25, 0.25, 0.25, 0.5), (0, 903, 0.0, 0.0, 1.0, 1.0)]
    assert pairs(spark, boxes) == touching(boxes)


def test_crowded_boxes_meet_few_others(spark):
    # 20,000 words side by side, all in what is one cell of a 16 x 16 grid.
    boxes = [(1, i, 0.01 + (i % 200) * 0.0002, 0.01 + (i // 200) * 0.0004, 0.01 + (i % 200) * 0.0002 + 0.00021, 0.01 + (i // 200) * 0.0004 + 0.0002) for i in range(20_000)]
    df = ocr.touching_pairs(spark.createDataFrame(boxes, BOX), "image_id", "cluster_id")
    assert df.count() == 20_000 + 2 * 199 * 100


def test_ranks_of_equal_edges(spark):
    rows = [(k, i % 3, i) for k in (1, 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, edge int, id int").repartition(7)
    got = {(r.k, r.id): r.at for r in ranked(df, "k", [F.col("edge").asc(), F.col("id").desc()], "at").collect()}
    for k in (1, 2):
        order = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], -r[2]))
        assert [got[(k, r[2])] for r in order] == list(range(2000))


def test_running_maximum_over_timestamps(spark):
    rng = random.Random(4)
    rows = [(i % 2, 1_700_000_000_000 + i * 1000, rng.randrange(1000)) for i in range(3000)]
    got = {(r.k, r.seq): r.top for r in running_max(spark.createDataFrame(rows, "k int, seq long, v int"), "k", "seq", "v", "top").collect()}
    best = {}
    for k, seq, v in rows:
        best[k] = max(best.get(k, 0), v)
        assert got[(k, seq)] == best[k]


def test_clusters_leave_no_old_rounds(spark, tmp_path):
    import os

    from normlake.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark)
    before = set(os.listdir(folder))
    rows = [(1, i, 0.0 + i * 0.01, 0.0, 0.1 + i * 0.01, 0.1) for i in range(30)]
    df = spark.createDataFrame(rows, "image_id int, seq int, left double, top double, right double, bottom double")
    got = {r.seq: r.cluster_id for r in ocr.ocr_clusters(df, 0.8).collect()}
    label = {}
    for _, i, *_ in rows:  # 0.8 of overlap reaches one neighbour to either side
        label[i] = label.get(i - 1, i)
    assert got == label
    left = [x for x in set(os.listdir(folder)) - before if x.startswith(("labels", "fresh"))]
    assert len(left) <= 3


def plain_found(surfaces, canaries):
    return {(s, c) for s, p in surfaces for c, n in canaries if n and p is not None and n in p}


def test_needles_that_share_a_prefix(spark):
    rng = random.Random(6)
    canaries = [(i, f"https://internal.example/canary/{rng.getrandbits(60):x}/é") for i in range(10_000)]
    surfaces = [(i, f"see https://internal.example/canary/ and {canaries[i * 7][1] if i % 2 else 'nothing'} end" * 3) for i in range(200)]
    s, c = spark.createDataFrame(surfaces, "surface_id int, payload string"), spark.createDataFrame(canaries, "needle int, secret string")
    got = {tuple(r) for r in needles.find(s, c).collect()}
    assert got == {(i, i * 7) for i in range(1, 200, 2)}
    # No two of them are keyed alike, so the common prefix makes no candidates.
    assert needles.keyed(c).groupBy("width", "key").count().where("count > 2").count() == 0


def test_needles_of_all_lengths(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abé😀") for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", "a"]
    canaries = [(i, "".join(rng.choice("abé😀") for _ in range(rng.randint(1, 6)))) for i in range(60)] + [(90, ""), (91, None), (92, texts[3]), (92, "ab"), (93, "x" * 500)]
    surfaces = list(enumerate(texts))
    s, c = spark.createDataFrame(surfaces, "surface_id int, payload string").repartition(3), spark.createDataFrame(canaries, "needle int, secret string")
    assert {tuple(r) for r in needles.find(s, c).collect()} == plain_found(surfaces, canaries)
    assert needles.find(s, c.limit(0)).count() == 0


RULES = ("com", "uk", "co.uk", "*.ck", "!www.ck", "*.kobe.jp", "!city.kobe.jp", "jp", "")


def test_needles_across_stretches_of_text(spark, monkeypatch):
    monkeypatch.setattr(needles, "STRETCH", 5)
    monkeypatch.setattr(needles, "HITS", 2)
    texts = ["", None, "xx needle-one yy", "needle-tw", "o needle-two", "é needle-one needle-one", "ab", "b"]
    surfaces = spark.createDataFrame(list(enumerate(texts)), "surface_id int, payload string").coalesce(1)
    secrets = spark.createDataFrame([(1, "needle-one"), (2, "needle-two"), (3, "b")], "needle int, secret string")
    got = {tuple(r) for r in needles.find(surfaces, secrets).collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n, x in ((1, "needle-one"), (2, "needle-two"), (3, "b")) if t and x in t}


@pytest.mark.parametrize("host, domain", [
    ("a.b.co.uk", "b.co.uk"), ("co.uk", None), ("x.ck", None), ("y.x.ck", "y.x.ck"), ("www.ck", "www.ck"), ("a.www.ck", "www.ck"), ("ck", None),
    ("city.kobe.jp", "city.kobe.jp"), ("a.b.kobe.jp", "a.b.kobe.jp"), ("kobe.jp", "kobe.jp"), ("q.zz", "q.zz"), ("zz", None), ("10.0.0.1", None)])
def test_suffix_rules(spark, host, domain):
    hosts, rules = spark.createDataFrame([(host,), ("other.com",)], "host string"), spark.createDataFrame([(r,) for r in RULES], "rule string")
    parsed = hosts.withColumn("kept", F.lit(1))
    got = {r.host: r.registrable_domain for r in urls.registrable_domain(parsed, rules).collect()}
    assert got == {host: domain, "other.com": "other.com"}


def test_look_alikes_share_a_skeleton(spark):
    shapes = spark.createDataFrame([("ﬁ", "fi"), ("օ", "o"), ("m", "rn"), ("Ꭺ", "A"), ("Ａ", "A")], "char string, prototype string")
    tokens = spark.createDataFrame([(1, "ﬁne"), (1, "fine"), (2, "fine"), (2, "modern"), (3, "modem"), (3, "Ꭺ"), (4, "Ａ"), (5, "alone"), (5, ""), (6, None)], "source_id int, token string")
    got = {r.token: (r.skeleton, r.twin, r.sources, r.tokens) for r in lookalikes.look_alike_index(tokens, shapes).collect()}
    assert got == {"ﬁne": ("fine", "fine", 1, 2), "fine": ("fine", "fine", 2, 2), "modern": ("rnodern", "modem", 1, 2), "modem": ("rnodern", "modem", 1, 2),
                   "Ꭺ": ("A", "Ꭺ", 1, 2), "Ａ": ("A", "Ꭺ", 1, 2)}


def test_points_meet_spans_by_one_sort(spark):
    rng = random.Random(5)
    data = []
    for i in range(200):
        edges = sorted(rng.sample(range(60), 2 * rng.randrange(0, 8)))
        spans = [(edges[k], edges[k + 1]) for k in range(0, len(edges), 2)]
        data.append((i, [rng.randrange(-2, 62) for _ in range(rng.randrange(0, 20))], spans, None if i % 9 == 0 else [rng.randrange(60) for _ in range(10)]))
    df = spark.createDataFrame(data, "id int, points array<int>, spans array<struct<start:int,end:int>>, chosen array<int>")
    got = df.select("id", tx.inside(F.col("points"), F.col("spans")).alias("held"), tx.among(F.col("points"), F.col("chosen")).alias("among")).collect()
    for r in got:
        _, points, spans, chosen = data[r.id]
        assert r.held == [any(s <= p < e for s, e in spans) for p in points]
        assert r.among == [p in (chosen or []) for p in points]


def plain_unwrapped(text, wraps, joins="/?&=#-_."):
    out = []
    for i, c in enumerate(text):
        if c == "\n" and i in wraps:
            inner = 0 < i < len(text) - 1
            out.append(" " if inner and text[i - 1] not in joins and text[i + 1] not in joins else "")
        else:
            out.append(c)
    return "".join(out)


def test_wraps_are_dropped_as_declared(spark):
    rng = random.Random(6)
    data = [(i, "".join(rng.choice("ab/- \n\n\U0001F468") for _ in range(rng.randrange(0, 30)))) for i in range(300)]
    data = [(i, t, [k for k, c in enumerate(t) if c == "\n" and rng.random() < 0.6] + [99]) for i, t in data] + [(300, "\n", [0]), (301, "", []), (302, "a\nb", None)]
    df = spark.createDataFrame(data, "id int, text string, wraps array<int>")
    got = df.select("id", text_transform.drop_wraps(F.col("text"), F.lit(0), F.col("wraps")).alias("out")).collect()
    assert {r.id: r.out for r in got} == {i: plain_unwrapped(t, set(w or [])) for i, t, w in data}


def test_many_lines_take_time_in_proportion(spark):
    def took(lines):
        text = "line\n" * lines
        df = spark.createDataFrame([(1, text, list(range(4, len(text), 10)))], "source_id int, text string, wrap_offsets array<int>")
        start = time.time()
        wrapped = text_inventory.line_structure(df).where("wrap").count()
        length = df.select(F.length(text_transform.drop_wraps(F.col("text"), F.lit(0), F.col("wrap_offsets")))).first()[0]
        assert (wrapped, length) == (lines // 2, len(text))
        return time.time() - start

    took(1_000)
    short, long = took(50_000), took(200_000)
    assert long < 8 * short + 2
