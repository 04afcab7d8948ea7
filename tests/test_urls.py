"""URL rules on small literal inputs."""

import pytest

from normlake.dims.url_rules import URL_REVIEWS
from normlake.operators import urls as u

ROWS = [
    ("a", "https://Example.COM/a%20b?x=one&x=two%20words&flag", "PLAIN_TEXT_URL"),
    ("b", "https://example.com:99999/x", "PLAIN_TEXT_URL"),
    ("c", "https://trusted.example@evil.example/path", "PLAIN_TEXT_URL"),
    ("d", "See example.com/help.", "PLAIN_TEXT"),
    ("e", "https://раypal.com/", "PLAIN_TEXT_URL"),
    ("f", "Contact person@example.com today.", "PLAIN_TEXT"),
]


def analysed(spark):
    src = spark.createDataFrame(ROWS, "source_id string, text string, source_kind string")
    return src, u.url_candidates(src)


def test_parse_and_gates(spark):
    _, cands = analysed(spark)
    got = {r.source_id: r for r in u.analyze_urls(cands).collect()}
    assert got["a"].host == "example.com" and got["a"].path_segments == ["a b"]
    assert [(q.name, q.value) for q in got["a"].query] == [("x", "one"), ("x", "two words"), ("flag", None)]
    assert got["b"].failure == "PARSE_FAILED"
    assert got["c"].host == "evil.example" and got["c"].review_codes == ["DECEPTIVE_HOST_REVIEW"]
    assert got["d"].target == "example.com/help" and got["d"].scheme is None
    assert got["e"].review_codes == ["IDN_CONFUSABLE_HOST_REVIEW"]
    assert got["f"].kind == "EMAIL_LIKE" and got["f"].failure == "UNSUPPORTED_SCHEME"


def test_look_alike_host_needs_a_replacement(spark):
    src, cands = analysed(spark)
    codes = list(URL_REVIEWS)
    plain = spark.createDataFrame([(r[0], codes) for r in ROWS], "source_id string, approved_codes array<string>")
    hosts = spark.createDataFrame([(r[0], codes, {"url-u-0": "paypal.com"}) for r in ROWS], "source_id string, approved_codes array<string>, host_by_token map<string,string>")
    a = u.analyze_urls(cands)
    without = {r.source_id for r in u.canonicalize_urls(a, plain).tokens().collect()}
    assert "e" not in without
    done = u.canonicalize_urls(a, hosts)
    text = {r.source_id: r.text for r in u.rewrite_urls(src, cands, done.tokens()).collect()}
    assert text["e"] == "https://paypal.com/" and text["d"] == "See example.com/help." and text["f"] is None


def test_serialized_form_is_stable(spark):
    comps = spark.createDataFrame(
        [("s", "t", "https", None, "example.com", None, ["space value", "percent%value"], [("b", "two words"), ("a", "1")], "part one")],
        "source_id string, token_id string, scheme string, userinfo string, host string, port int, path_segments array<string>, query array<struct<name:string,value:string>>, fragment string")
    got = u.serialize_url(comps).collect()[0]
    assert got.text == "https://example.com/space%20value/percent%25value?b=two%20words&a=1#part%20one" and got.stable


def test_links_of_any_length_and_depth(spark):
    deep = "https://h.example/" + "(" * 50 + "a" + ")" * 50 + "/tail"
    texts = {
        "long": "see https://h.example/" + "a" * 100_000 + " end",
        "deep": f"x {deep}) y",
        "two": "(https://a.example/x)(https://b.example/y)",
        "dots": "a." * 50_000 + "com rest",
        "plain": "visit example.com.x1 or docs.example.org/a.",
        "marked": "[l](" + "(" * 50 + "t" + ")" * 50 + ") [[b](c) [d] (e) [f](open",
        "open": "[a](" * 20_000,
        "brackets": "[" * 100_000,
    }
    src = spark.createDataFrame([(k, v) for k, v in texts.items()], "source_id string, text string")
    absolute = [(r.source_id, r.target) for r in u.extract_absolute(src).collect()]
    assert sorted(absolute) == sorted([("long", "https://h.example/" + "a" * 100_000), ("deep", deep), ("two", "https://a.example/x"), ("two", "https://b.example/y")])
    hosts = {(r.source_id, r.target) for r in u.extract_schemeless(src).collect()}
    assert ("dots", "a." * 50_000 + "com") in hosts and ("plain", "example.com") in hosts and ("plain", "docs.example.org/a") in hosts
    marked = sorted((r.source_id, r.target, r.display) for r in u.extract_markdown(src).collect())
    assert marked == [("marked", "(" * 50 + "t" + ")" * 50, "l"), ("marked", "c", "[b")]


@pytest.mark.parametrize("name", ["u04_extract_emails", "u06_url_candidates"])
def test_mail_sql_ends_where_the_query_does(spark, tmp_path, name):
    import duckdb

    from normlake.queries import ORACLES, QUERIES

    texts = ["a@b.com. x@y.org z@w.net", "a@b@c.com,d@e.fr\nq@r.de-", "é.q@x.example.com-x #a@b.com#c@d.com", "a.b@c.dd'e@f.gg a@b.c"]
    # Odd ids: plain texts, in which mails are candidates.
    spark.createDataFrame([(2 * i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(ORACLES[name])
    order = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in got.select(*order).collect()) == sorted(want.fetchall())
