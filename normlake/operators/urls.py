"""URL extraction, analysis, policy and rewriting.

Extraction keeps all candidates of a text in its row; analysis works on one row per candidate with nested
path and query arrays. The only shuffles are the joins with approvals and the final splice per text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from normlake.dims import charclass as cc
from normlake.dims import url_rules as ur
from normlake.functions import text as tx
from normlake.functions.rows import keep_rows, settled, to_rows
from normlake.operators.text_inventory import with_source_defaults
from normlake.operators.text_findings import FINDING, _finding
from normlake.operators import lookalikes

CANDIDATE = (
    "array<struct<start:int,end:int,kind:string,original:string,display:string,target:string,"
    "scheme_implicit:boolean,wrapped:boolean,target_start:int>>"
)
QUERY = "array<struct<name:string,value:string>>"
_WS = cc.class_body(cc.WHITESPACE_RANGES) + r"\x{1C}-\x{1F}"
# Links without parentheses: a possessive run, which java.util.regex matches in a loop, however long it is.
ABSOLUTE = rf"(?i)(?:https?://|mailto:)[^{_WS}<>()]*+"
_PARENTHESES = rf"(?i)(?:https?://|mailto:)[^{_WS}<>()]*+[()]"
# 48 labels, searched from the dots between them: a text has far fewer dots than letters.
_LONG_HOST = r"(?:\.[A-Za-z0-9-]{1,63}+){47}+\."
# A word that no dot and further label follow is passed over in one step, not tried at every length.
_SCHEMELESS = cc.SCHEMELESS.replace(")", r")(?=[A-Za-z0-9][A-Za-z0-9-]{0,62}+\.[A-Za-z0-9])", 1)
_HTTP = r"(?i)^https?://"


# ------------------------------------------------------------------------------------------ U01 - U06
def _candidate(start, end, kind, original, display, target, implicit, wrapped, target_start) -> Column:
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), kind.alias("kind"), original.alias("original"),
        display.alias("display"), target.alias("target"), implicit.alias("scheme_implicit"), wrapped.alias("wrapped"),
        target_start.cast("int").alias("target_start"),
    )


def _space_class() -> str:
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", _WS)


def _linear(find: Callable[[str], Iterator[tuple[int, int]]]) -> Callable[[Column], Column]:
    """Spans of one text by a single pass in an Arrow worker, for what a regular expression can't count."""

    @F.pandas_udf(tx.HIT)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b, "value": t[a:b]} for a, b in find(t)])

    return spans


def _links(text: str) -> Iterator[tuple[int, int]]:
    """Links up to a blank, an angle bracket, or the first parenthesis that closes more than the link has opened."""
    scheme, stop = re.compile(r"(?i)https?://|mailto:"), re.compile(f"[{_space_class()}<>()]")
    at = 0
    while found := scheme.search(text, at):
        balance, end = 0, len(text)
        for mark in stop.finditer(text, found.end()):
            balance += {"(": 1, ")": -1}.get(mark[0], 0)
            if balance < 0 or mark[0] not in "()":
                end = mark.start()
                break
        yield found.start(), end
        at = max(end, found.end())


def _markdown_links(text: str) -> Iterator[tuple[int, int]]:
    """``[label](target)`` with the parentheses of the target paired off over the whole text beforehand."""
    closing: dict[int, int] = {}
    opened: list[int] = []
    for mark in re.finditer(r"[()]", text):
        if mark[0] == "(":
            opened.append(mark.start())
        elif opened:
            closing[opened.pop()] = mark.start()
    at = 0
    while (bracket := text.find("](", at)) >= 0:
        label = text.find("[", max(at, text.rfind("]", at, bracket) + 1), bracket)
        end = closing.get(bracket + 1)
        if label >= 0 and end is not None:
            yield label, end + 1
        at = bracket + 2 if label < 0 or end is None else end + 1


def _hosts(text: str) -> Iterator[tuple[int, int]]:
    pattern = re.compile(cc.SCHEMELESS.replace(r"\s", _space_class()))
    return (m.span() for m in pattern.finditer(text))


def _spans_of(text: Column, pattern: str, needle: tuple[str, ...], odd: Column, find: Callable[[str], Iterator[tuple[int, int]]]) -> Column:
    """Matches of ``pattern``; texts for which ``odd`` holds go through ``find`` instead."""
    odd = F.coalesce(odd, F.lit(False))
    counted = _linear(find)(F.when(odd, text))
    plain = tx.hits(F.when(~odd, text).otherwise(F.lit("")), pattern, needle)
    return F.when(odd, counted).otherwise(plain)


def absolute_array(text: Column) -> Column:
    def one(h: Column) -> Column:
        target = F.regexp_replace(h["value"], cc.TRAILING_PROSE, "")
        kind = F.when(target.rlike("(?i)^mailto:"), F.lit("EMAIL_LIKE")).otherwise(F.lit("ABSOLUTE"))
        return _candidate(h["start"], h["start"] + F.length(target), kind, target, target, target, F.lit(False), F.lit(False), h["start"])

    odd = text.contains(":") & text.rlike(_PARENTHESES)
    return F.transform(_spans_of(text, ABSOLUTE, (":",), odd, _links), one)


def markdown_array(text: Column) -> Column:
    def one(h: Column) -> Column:
        label = F.regexp_extract(h["value"], r"^\[([^\]]*+)\]", 1)
        inside = F.substr(h["value"], F.length(label) + 4, F.length(h["value"]) - F.length(label) - 4)
        lead = F.length(F.regexp_extract(inside, f"^[{_WS}]*+", 0))
        target = F.regexp_replace(inside, f"^[{_WS}]++|[{_WS}]++$", "")
        return _candidate(h["start"], h["end"], F.lit("MARKDOWN_TARGET"), target, label, target, ~target.rlike(_HTTP),
                          F.lit(False), h["start"] + F.length(label) + 3 + lead)

    odd = F.coalesce(text.contains("]("), F.lit(False))
    found = F.when(odd, _linear(_markdown_links)(F.when(odd, text))).otherwise(F.array().cast(tx.HIT))
    return F.filter(F.transform(found, one), lambda c: c["target"] != "")


def schemeless_array(text: Column) -> Column:
    def one(h: Column) -> Column:
        target = F.regexp_replace(h["value"], cc.TRAILING_PROSE, "")
        return _candidate(h["start"], h["start"] + F.length(target), F.lit("SCHEMELESS"), target, target, target,
                          F.lit(True), F.lit(False), h["start"])

    found = _spans_of(text, _SCHEMELESS, (".",), text.rlike(_LONG_HOST), _hosts)
    return F.filter(F.transform(found, one), lambda c: c["target"] != "")


def email_array(text: Column) -> Column:
    return F.transform(
        tx.hits(text, cc.EMAIL, ("@",)),
        lambda h: _candidate(h["start"], h["end"], F.lit("EMAIL_LIKE"), h["value"], h["value"], h["value"],
                             F.lit(False), F.lit(False), h["start"]),
    )


def whole_array(text: Column, kind: Column, wraps: Column) -> Column:
    """The trimmed text as one candidate, with declared visual wraps joined."""
    start = F.length(F.regexp_extract(text, f"^[{_WS}]*", 0))
    original = F.regexp_replace(text, f"^[{_WS}]+|[{_WS}]+$", "")

    def unwrap(pair: Column) -> Column:
        cs, on = pair["cs"], pair["on"]
        kept = F.filter(
            F.transform(
                cs,
                lambda c, i: F.when(
                    ~(
                        ((c == "\n") & F.get(on, i))
                        | F.coalesce((c == "\r") & (F.get(cs, i + 1) == "\n") & F.get(on, i + 1), F.lit(False))
                    ),
                    c,
                ),
            ),
            lambda c: c.isNotNull(),
        )
        return F.array_join(kept, "")

    marked = lambda cs: F.struct(cs.alias("cs"), tx.among(F.transform(cs, lambda c, i: start + i), wraps).alias("on"))
    joined = F.when(
        F.size(wraps) > 0, tx.let(tx.let(tx.chars(original), marked), unwrap)
    ).otherwise(original)

    def build(r: Column) -> Column:
        http = r["joined"].rlike(_HTTP)
        what = (
            F.when(r["joined"].rlike("^(?:" + cc.EMAIL + ")$"), F.lit("EMAIL_LIKE"))
            .when(kind == "QR_PAYLOAD", F.lit("QR_PAYLOAD"))
            .when(http, F.lit("ABSOLUTE"))
            .otherwise(F.lit("SCHEMELESS"))
        )
        made = _candidate(r["start"], r["start"] + F.length(r["original"]), what, r["original"], r["original"], r["joined"],
                          ~http, r["joined"] != r["original"], r["start"])
        return F.filter(F.array(made), lambda c: ~c["target"].rlike(f"^[{_WS}]*$"))

    return tx.let(F.struct(start.alias("start"), original.alias("original"), joined.alias("joined")), build)


def _without_overlaps(text: Column, lexical: Column, absolute: Column) -> Column:
    """Lexical candidates that touch no absolute one (absolute spans are disjoint and ascending, so their ends suffice)."""

    def keep(pair: Column) -> Column:
        found, lex = pair["abs"], pair["lex"]
        first = tx.inside(F.transform(lex, lambda c: c["start"]), found)
        last = tx.inside(F.transform(lex, lambda c: c["end"] - 1), found)
        touched = F.struct(first.alias("first"), last.alias("last"))
        return tx.let(touched, lambda t: F.filter(lex, lambda c, i: ~F.get(t["first"], i) & ~F.get(t["last"], i)))

    spans = F.transform(absolute, lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end")))
    both = F.struct(spans.alias("abs"), lexical.alias("lex"))
    return F.when((F.size(absolute) > 0) & (F.size(lexical) > 0), tx.let(both, keep)).otherwise(lexical)


def candidate_array(text: Column, kind: Column, wraps: Column) -> Column:
    """U06 in one row: by source kind, without overlaps and repeats, ordered by position."""
    empty = F.array().cast(CANDIDATE)
    plain = kind.isin("PLAIN_TEXT", "OCR_TEXT", "OCR_APPROVED_TEXT", "LONG_TEXT")
    markdown = kind == "MARKDOWN"
    absolute = F.when(plain | markdown, absolute_array(text)).otherwise(empty).cast(CANDIDATE)
    lexical = F.when(plain, F.concat(schemeless_array(text), email_array(text))).otherwise(empty).cast(CANDIDATE)
    marked = F.when(markdown, markdown_array(text)).otherwise(empty).cast(CANDIDATE)
    whole = F.when(kind.isin("QR_PAYLOAD", "PLAIN_TEXT_URL", "WRAPPED_TEXT"), whole_array(text, kind, wraps)).otherwise(empty).cast(CANDIDATE)

    def combine(r: Column) -> Column:
        every = F.concat(r["whole"], r["marked"], r["absolute"], _without_overlaps(text, r["lexical"], r["absolute"]))
        keyed = F.array_sort(
            F.transform(every, lambda c, i: F.struct(c["target_start"].alias("s"), c["target"].alias("t"), i.alias("i"), c.alias("c")))
        )
        first = tx.let(
            keyed,
            lambda ks: F.filter(
                F.transform(
                    ks,
                    lambda k, i: F.when(
                        ~F.coalesce((F.get(ks, i - 1)["s"] == k["s"]) & (F.get(ks, i - 1)["t"] == k["t"]), F.lit(False)), k["c"]
                    ),
                ),
                lambda c: c.isNotNull(),
            ),
        )
        ordered = F.array_sort(F.transform(first, lambda c: F.struct(c["start"].alias("s"), c["end"].alias("e"), c["target_start"].alias("t"), c.alias("c"))))
        return F.transform(ordered, lambda o: o["c"])

    parts = F.struct(whole.alias("whole"), marked.alias("marked"), absolute.alias("absolute"), lexical.alias("lexical"))
    return tx.let(parts, combine).cast(CANDIDATE)


def _extract(sources: DataFrame, found: Column) -> DataFrame:
    return to_rows(sources, ["source_id"], found).drop("target_start")


def extract_absolute(sources: DataFrame) -> DataFrame:
    """U01."""
    return _extract(sources, absolute_array(F.col("text")))


def extract_markdown(sources: DataFrame) -> DataFrame:
    """U02."""
    return _extract(sources, markdown_array(F.col("text")))


def extract_schemeless(sources: DataFrame) -> DataFrame:
    """U03."""
    return _extract(sources, schemeless_array(F.col("text")))


def extract_emails(sources: DataFrame) -> DataFrame:
    """U04."""
    return _extract(sources, email_array(F.col("text")))


def whole_value_url(sources: DataFrame) -> DataFrame:
    """U05."""
    sources = with_source_defaults(sources)
    return _extract(sources, whole_array(F.col("text"), F.col("source_kind"), F.col("wrap_offsets")))


def url_candidates(sources: DataFrame, prefix: str = "url") -> DataFrame:
    """Numbered candidates of every source; token ids count inside the source."""
    sources = with_source_defaults(sources)
    found = candidate_array(F.col("text"), F.col("source_kind"), F.col("wrap_offsets"))
    rows = to_rows(sources, ["source_id"], found, "_i")
    return rows.withColumn("token_id", F.concat(F.lit(f"{prefix}-u-"), F.col("_i"))).drop("_i", "target_start")


# ------------------------------------------------------------------------------------------ U07, U08
def malformed_percent(value: Column) -> Column:
    """U08."""
    return value.rlike(r"%(?![0-9A-Fa-f]{2})")


def _decode(value: Column, plus_is_space: bool = False) -> Column:
    safe = F.regexp_replace(value, r"%(?![0-9A-Fa-f]{2})", "%25")
    if not plus_is_space:
        safe = F.replace(safe, F.lit("+"), F.lit("%2B"))
    needs = value.rlike(r"[%+]")
    return F.when(needs, F.coalesce(F.try_url_decode(safe), value)).otherwise(value)


@F.pandas_udf(StringType())
def _idna_ascii(hosts: pd.Series) -> pd.Series:
    def one(host):
        if host is None:
            return None
        try:
            return host.encode("idna").decode("ascii").lower()
        except UnicodeError:
            return ""

    return hosts.map(one)


@F.pandas_udf(StringType())
def _idna_unicode(hosts: pd.Series) -> pd.Series:
    def one(host):
        if host is None:
            return None
        try:
            return host.encode("ascii").decode("idna")
        except UnicodeError:
            return host

    return hosts.map(one)


def _ascii_host(host: Column) -> Column:
    foreign = F.when(host.rlike(r"[^\x00-\x7F]"), host)
    return F.coalesce(_idna_ascii(foreign), F.lower(host))


# Whole value: scheme, authority (user information, host, port), path, query, fragment.
_URL = r"^(?i:(https?)):[/\\]{2,}(?:([^/\\?#]*)@)?(\[[^\]]*\]|[^/\\?#:@]*)(?::([0-9]*))?((?:[/\\][^?#]*)?)(\?[^#]*)?(#[\s\S]*)?$"


def parse_url_components(candidates: DataFrame) -> DataFrame:
    """Components of ``target``; failures are PARSE_FAILED or UNSUPPORTED_SCHEME, never an exception."""
    given = F.regexp_replace("target", r"^[\t\n\f\r ]+|[\t\n\f\r ]+$", "")
    df = candidates.withColumn("_u", F.when(F.col("scheme_implicit"), F.concat(F.lit("https://"), given)).otherwise(given))
    part = lambda i: F.regexp_extract("_u", _URL, i)
    df = df.withColumns({
        "_ok": F.col("_u").rlike(_URL), "_s": F.lower(part(1)), "_auth": part(2), "_h": _decode(part(3)), "_p": part(4),
        "_path": F.regexp_replace(part(5), r"\\", "/"), "_q": part(6), "_f": part(7),
    })
    df = df.withColumn("_host", _ascii_host(F.col("_h")))
    port = F.when(F.col("_p") != "", F.col("_p").try_cast("bigint"))
    host_ok = (
        F.col("_host").rlike(r"^\[[0-9a-f:.]+\]$")
        | (F.col("_host").rlike(r"^(?:[^.]{1,63}\.)*[^.]{1,63}\.?$") & ~F.col("_host").rlike(r"[\x00-\x20\x7F#%/:?@\[\]\\]"))
    )
    port_ok = F.when(F.col("_p") == "", ~F.col("_u").rlike(r"^[a-zA-Z]+:[/\\]{2,}[^/\\?#]*:(?:[/\\?#]|$)")).otherwise(
        F.coalesce(port.between(1, 65535), F.lit(False))
    )
    email = F.col("kind") == "EMAIL_LIKE"
    failure = F.when(email, F.lit("UNSUPPORTED_SCHEME")).when(~(F.col("_ok") & host_ok & port_ok), F.lit("PARSE_FAILED"))
    df = df.withColumn("failure", failure)
    good = F.col("failure").isNull()
    default = F.when(F.col("_s") == "https", 443).otherwise(80)
    has_user = F.col("_u").rlike(r"^[a-zA-Z]+:[/\\]{2,}[^/\\?#]*@") & (F.col("_auth") != "")
    user = _decode(F.regexp_replace("_auth", ":$", ""))
    segments = F.split(F.substring("_path", 2, 2147483647), "/", -1)

    def resolve(raw: Column) -> Column:
        """``.`` and ``..`` segments; a trailing one leaves an empty last segment."""
        dot = lambda s: F.lower(s).isin(".", "%2e")
        two = lambda s: F.lower(s).isin("..", "%2e.", ".%2e", "%2e%2e")
        last = F.size(raw) - 1
        start = F.struct(F.lit(0).alias("i"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            popped = F.when(F.size(acc["out"]) > 0, F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0)))).otherwise(acc["out"])
            edge = lambda out: F.when(acc["i"] == last, F.array_append(out, F.lit(""))).otherwise(out)
            out = F.when(dot(s), edge(acc["out"])).when(two(s), edge(popped)).otherwise(F.array_append(acc["out"], s))
            return F.struct((acc["i"] + 1).alias("i"), out.alias("out"))

        return F.aggregate(raw, start, step, lambda acc: acc["out"])

    dotted = F.col("_path").rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)")
    path = F.transform(F.when(dotted, resolve(segments)).otherwise(segments), lambda s: _decode(s))
    raw_query = F.split(F.substring("_q", 2, 2147483647), "&", -1)
    query = F.transform(
        raw_query,
        lambda p: F.struct(
            _decode(F.regexp_extract(p, "^[^=]*", 0), True).alias("name"),
            F.when(p.contains("="), _decode(F.regexp_replace(p, "^[^=]*=", ""), True)).alias("value"),
        ),
    )
    no_query = F.array().cast(QUERY)
    return df.withColumns({
        "scheme": F.when(good & ~F.col("scheme_implicit"), F.col("_s")),
        "userinfo": F.when(good & has_user, user),
        "host": F.when(good, F.col("_host")),
        "port": F.when(good & (port != default), port.cast("int")),
        "path_segments": F.when(good, path),
        "query": F.when(good, F.when(F.col("_q") != "", query).otherwise(no_query)),
        "fragment": F.when(good & (F.col("_f") != ""), _decode(F.substring("_f", 2, 2147483647))),
        "malformed_percent": good & malformed_percent(F.col("target")),
    }).drop("_u", "_ok", "_s", "_auth", "_h", "_p", "_path", "_q", "_f", "_host")


def percent_encoding_check(candidates: DataFrame) -> DataFrame:
    return candidates.select("*", malformed_percent(F.col("target")).alias("malformed_percent"))


# ------------------------------------------------------------------------------------------ U09 - U15
def host_spoof_check(parsed: DataFrame, prototypes: DataFrame | None = None) -> DataFrame:
    """Decoded host, its look-alike skeleton and whether it needs review.

    Skeletons come from ``prototypes`` where given (see :mod:`lookalikes`), each distinct host drawn once; else from the
    short built-in table, where the row lies.
    """
    decoded = F.coalesce(_idna_unicode(F.when(F.col("host").contains("xn--"), F.col("host"))), F.col("host"))
    df = parsed.withColumn("unicode_host", decoded)
    if prototypes is None:
        df = df.withColumn("skeleton", tx.skeleton(F.col("unicode_host")))
    else:
        df = settled(df, df.columns)  # the join's two sides use columns that take long expressions to make
        df = df.join(lookalikes.skeletons(df, prototypes, "unicode_host"), "unicode_host", "left").select(*df.columns, "skeleton")
    foreign = F.col("unicode_host").rlike(r"[^\x00-\x7F]")
    odd = (F.size(tx.scripts_of(F.col("unicode_host"))) > 1) | (F.lower("skeleton") != F.lower("unicode_host"))
    return df.withColumn("suspicious", F.coalesce(foreign & odd, F.lit(False)))


_ADDRESS = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$|^\["


def domain_of(host: Column, suffixes: tuple[str, ...]) -> Column:
    """Registrable domain: longest known suffix plus one label; NULL for addresses and bare suffixes."""

    def pick(labels: Column) -> Column:
        n = F.size(labels)
        tail = lambda k: F.array_join(F.slice(labels, F.greatest(n - k, F.lit(0)) + 1, k), ".")
        deepest = max(s.count(".") + 1 for s in suffixes)
        match = F.lit(1)
        for k in range(1, deepest + 1):
            known = [s for s in suffixes if s.count(".") + 1 == k]
            match = F.when((n >= k) & tail(k).isin(*known), F.lit(k)).otherwise(match)
        return F.when(n > match, F.array_join(F.slice(labels, n - match, match + 1), "."))

    address = host.rlike(_ADDRESS)
    return F.when(~address, tx.let(F.split(host, r"\."), pick))


def suffix_rules(rules: DataFrame) -> DataFrame:
    """(tail, plain, wild, exception) for each name of a suffix list given as rows ``rule``: ``co.il``, ``*.ck``, ``!www.ck``."""
    rule = F.lower(F.trim("rule"))
    wild, exception = rule.startswith("*."), rule.startswith("!")
    name = F.when(wild, F.substr(rule, F.lit(3))).when(exception, F.substr(rule, F.lit(2))).otherwise(rule)
    rows = rules.where("trim(rule) <> ''").select(name.alias("tail"), wild.alias("wild"), exception.alias("exception"))
    return rows.groupBy("tail").agg(F.bool_or(~F.col("wild") & ~F.col("exception")).alias("plain"), F.bool_or("wild").alias("wild"), F.bool_or("exception").alias("exception"))


def domains_by_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, registrable_domain) for distinct hosts, by the longest rule that a host ends with.

    A host's tails meet the rules in one equi-join. A wildcard covers one label more than its name, an exception ends the
    suffix one label before its own name and wins over all, and a host under no rule has its last label as suffix.
    """
    labels = F.split("host", r"\.")
    tails = hosts.where(~F.col("host").rlike(_ADDRESS)).select("host", labels.alias("_labels")).select(
        "host", F.size("_labels").alias("n"), F.posexplode(F.transform("_labels", lambda x, i: F.array_join(F.slice("_labels", i + 1, F.size("_labels")), "."))).alias("skipped", "tail"))
    deep = F.col("n") - F.col("skipped")
    known = tails.join(suffix_rules(rules), "tail", "left").groupBy("host", "n").agg(
        F.max(F.when(F.col("exception"), deep - 1)).alias("_exception"),
        F.max(F.greatest(F.when(F.col("plain"), deep), F.when(F.col("wild") & (F.col("skipped") > 0), deep + 1))).alias("_longest"))
    size = F.coalesce("_exception", "_longest", F.lit(1))
    return known.select("host", F.when(F.col("n") > size, F.array_join(F.slice(labels, F.col("n") - size, size + 1), ".")).alias("registrable_domain"))


def registrable_domain(parsed: DataFrame, suffixes: tuple[str, ...] | DataFrame = ur.PUBLIC_SUFFIXES) -> DataFrame:
    """Boundary of the host by the suffix list; hosts deeper than two labels without one need review.

    A list given as rows (column ``rule``) may have any size and hold wildcards and exceptions: each distinct host is
    resolved once, and the rows join their host's answer. The short default list is tested where the row lies.
    """
    if isinstance(suffixes, DataFrame):
        hosts = parsed.where("host IS NOT NULL").select("host").distinct()
        df = parsed.join(domains_by_rules(hosts, suffixes), "host", "left").select(*parsed.columns, "registrable_domain")
    else:
        df = parsed.withColumn("registrable_domain", domain_of(F.col("host"), suffixes))
    domain = F.col("registrable_domain")
    sub = F.when(F.col("host") != domain, F.expr("left(host, length(host) - length(registrable_domain) - 1)"))
    unavailable = F.coalesce(domain.isNull() & (F.size(F.split("host", r"\.")) > 2), F.lit(False))
    return df.withColumn("subdomain", sub).withColumn("boundary_unavailable", unavailable)


def looks_identifier(value: Column) -> Column:
    letters, digits = value.rlike(r"\p{L}"), value.rlike(r"\p{Nd}")
    return (F.length(value) >= 7) & ((letters & digits) | (F.length(value) >= 14))


def query_risk(name: Column, value: Column) -> Column:
    lower = F.lower(name)
    value_id = F.coalesce(looks_identifier(value), F.lit(False))
    return (
        F.when(lower.startswith(ur.TRACKING_PREFIX) | lower.isin(*ur.TRACKING_NAMES), F.lit("KNOWN_TRACKING"))
        .when((lower == "id") & F.coalesce(value.rlike(r"^\p{Nd}{0,6}$"), F.lit(False)), F.lit("FUNCTIONAL"))
        .when(lower.isin(*ur.FUNCTIONAL_NAMES) & ~value_id, F.lit("FUNCTIONAL"))
        .when(lower.isin(*ur.IDENTIFIER_NAMES) | value_id, F.lit("LIKELY_IDENTIFIER"))
        .otherwise(F.lit("UNKNOWN"))
    )


def path_risk(segments: Column, target: Column) -> Column:
    def one(s: Column, i: Column) -> Column:
        prior = F.coalesce(F.lower(F.get(segments, i - 1)) == "invite", F.lit(False))
        return (
            F.when(s == "", F.lit("EMPTY"))
            .when(prior | (F.lower(s) == "invite"), F.lit("FUNCTIONAL_INVITE"))
            .when(looks_identifier(s) & target.contains("%"), F.lit("PERCENT_ENCODED_IDENTIFIER"))
            .when(looks_identifier(s), F.lit("LIKELY_IDENTIFIER"))
            .otherwise(F.lit("ORDINARY"))
        )

    return F.transform(segments, one)


def with_risks(parsed: DataFrame) -> DataFrame:
    personal = lambda label: label.rlike(r"\p{Nd}") & ((F.length(label) >= 8) | label.contains("-"))
    sub_risk = (
        F.when(F.col("boundary_unavailable"), F.lit("DOMAIN_BOUNDARY_UNAVAILABLE"))
        .when(F.col("subdomain").isNull(), F.lit("NONE"))
        .when(F.exists(F.split("subdomain", r"\."), personal), F.lit("LIKELY_PERSONALIZED"))
        .otherwise(F.lit("ORDINARY"))
    )
    return parsed.withColumns({
        "query_risks": F.transform("query", lambda q: query_risk(q["name"], q["value"])),
        "path_risks": path_risk(F.col("path_segments"), F.col("target")),
        "subdomain_risk": F.when(F.col("failure").isNull(), sub_risk),
        "has_fragment": F.col("fragment").isNotNull(),
        "has_userinfo": F.col("userinfo").isNotNull(),
        "unresolved_redirect": F.coalesce(F.col("host").isin(*ur.SHORTENER_HOSTS), F.lit(False)),
    })


def query_inventory(analysed: DataFrame) -> DataFrame:
    """One row per query parameter with its risk."""
    rows = to_rows(analysed, ["source_id", "token_id"], F.arrays_zip("query", "query_risks"), "idx")
    return rows.select("source_id", "token_id", "idx", F.col("query.name").alias("name"), F.col("query.value").alias("value"), F.col("query_risks").alias("risk"))


def path_inventory(analysed: DataFrame) -> DataFrame:
    """One row per decoded path segment with its risk."""
    rows = to_rows(analysed, ["source_id", "token_id"], F.arrays_zip("path_segments", "path_risks"), "idx")
    return rows.select("source_id", "token_id", "idx", F.col("path_segments").alias("segment"), F.col("path_risks").alias("risk"))


def subdomain_risk(analysed: DataFrame) -> DataFrame:
    """U13."""
    return analysed.select("source_id", "token_id", "host", "subdomain", "subdomain_risk")


def fragment_userinfo_scan(analysed: DataFrame) -> DataFrame:
    """U14."""
    return analysed.select("source_id", "token_id", "has_fragment", "has_userinfo")


def shortener_flag(analysed: DataFrame) -> DataFrame:
    """U15."""
    return analysed.select("source_id", "token_id", "host", "unresolved_redirect")


def analyze_urls(candidates: DataFrame, suffixes: tuple[str, ...] | DataFrame = ur.PUBLIC_SUFFIXES) -> DataFrame:
    """U07-U16 columns for every candidate: components, risks, findings array and review codes."""
    df = with_risks(registrable_domain(host_spoof_check(parse_url_components(candidates)), suffixes))
    df = df.withColumn("findings", _url_findings())
    codes = F.filter(F.transform("findings", lambda f: f["review_code"]), lambda c: c.isNotNull())
    return df.withColumn("review_codes", F.array_sort(F.array_distinct(codes)))


# ------------------------------------------------------------------------------------------------ U16
def _url_findings() -> Column:
    empty = F.array().cast(FINDING)
    kind, good = F.col("kind"), F.col("failure").isNull()
    start, end = F.col("start"), F.col("end")

    def one(when: Column, block, severity, confidence, title, risk, review) -> Column:
        made = F.array(_finding(block, "URL", severity, confidence, start, end, title, risk, review))
        return F.when(F.coalesce(when, F.lit(False)), made.cast(FINDING)).otherwise(empty)

    possible, high = "POSSIBLE_MEANING_CHANGE", "HIGH_IMPACT"
    quiet = kind.isin("QR_PAYLOAD", "MARKDOWN_TARGET")

    def query_finding(risk: Column) -> Column:
        tracking = _finding("URL-005", "URL", "LOW", "CERTAIN_BY_PARSER", start, end, "KNOWN_TRACKING_QUERY_PARAMETER", "NONE", None)
        confidence = F.when(risk == "LIKELY_IDENTIFIER", F.lit("STRONG_HEURISTIC")).otherwise(F.lit("UNKNOWN"))
        unknown = _finding("URL-005", "URL", "HIGH", confidence, start, end, "UNKNOWN_OR_IDENTIFIER_QUERY_PARAMETER", possible, "UNKNOWN_URL_COMPONENT_REVIEW")
        return F.when(risk == "KNOWN_TRACKING", tracking).when(risk.isin("LIKELY_IDENTIFIER", "UNKNOWN") & ~quiet, unknown)

    queries = F.coalesce(F.filter(F.transform("query_risks", query_finding), lambda f: f.isNotNull()).cast(FINDING), empty)
    has_path = lambda r: F.coalesce(F.array_contains("path_risks", r), F.lit(False))
    encoded, ident, invite = has_path("PERCENT_ENCODED_IDENTIFIER"), has_path("LIKELY_IDENTIFIER"), has_path("FUNCTIONAL_INVITE")
    domain_dots = F.size(F.split("registrable_domain", r"\.")) - 1
    origin = (kind == "MARKDOWN_TARGET") | F.coalesce((domain_dots >= 2) & F.col("subdomain").isNotNull(), F.lit(False))
    parts = [
        one(F.col("scheme_implicit"), "URL-001", "MEDIUM", "STRONG_HEURISTIC", "SCHEMELESS_URL_CANDIDATE", possible, "SCHEMELESS_URL_REVIEW"),
        one(~F.col("scheme_implicit") & (kind == "MARKDOWN_TARGET") & (F.col("display") != F.col("target")), "URL-001", "HIGH",
            "CERTAIN_BY_PARSER", "VISIBLE_TEXT_TARGET_DIVERGENCE", high, "VISIBLE_TEXT_LINK_TARGET_REVIEW"),
        one(kind == "QR_PAYLOAD", "URL-001", "HIGH", "CERTAIN_BY_PARSER", "MACHINE_READABLE_URL_PAYLOAD", high, "QR_PAYLOAD_REVIEW"),
        one(F.col("wrapped"), "URL-001", "MEDIUM", "WEAK_HEURISTIC", "URL_VISUAL_WRAP_RECONSTRUCTED", possible, "URL_LINE_WRAP_RECONSTRUCTION_REVIEW"),
        one(F.col("failure") == "UNSUPPORTED_SCHEME", "URL-002", "MEDIUM", "CERTAIN_BY_PARSER", "UNSUPPORTED_URL_SCHEME", possible, "PARSE_FAILURE_REVIEW"),
        one(F.col("failure") == "PARSE_FAILED", "URL-002", "HIGH", "CERTAIN_BY_PARSER", "URL_PARSE_FAILED", high, "PARSE_FAILURE_REVIEW"),
        one(F.col("malformed_percent"), "URL-002", "HIGH", "CERTAIN_BY_PARSER", "MALFORMED_PERCENT_ENCODING", high, "MALFORMED_PERCENT_ENCODING_REVIEW"),
        one(F.col("suspicious"), "URL-003", "HIGH", "STRONG_HEURISTIC", "INTERNATIONAL_HOST_CONFUSABLE", high, "IDN_CONFUSABLE_HOST_REVIEW"),
        one(F.col("boundary_unavailable"), "URL-004", "HIGH", "CERTAIN_BY_PARSER", "PUBLIC_SUFFIX_BOUNDARY_UNAVAILABLE", high, "PUBLIC_SUFFIX_UNAVAILABLE_REVIEW"),
        queries,
        one(encoded, "URL-006", "HIGH", "STRONG_HEURISTIC", "PERCENT_ENCODED_PATH_IDENTIFIER", possible, "ENCODED_PATH_COMPONENT_REVIEW"),
        one(~encoded & ident, "URL-006", "HIGH", "STRONG_HEURISTIC", "PATH_IDENTIFIER", possible, "PATH_SEMANTICS_REVIEW"),
        one(~encoded & ~ident & invite, "URL-006", "MEDIUM", "STRONG_HEURISTIC", "FUNCTIONAL_INVITE_PATH", possible, "FUNCTIONAL_URL_COMPONENT_REVIEW"),
        one(F.col("subdomain_risk") == "LIKELY_PERSONALIZED", "URL-007", "HIGH", "STRONG_HEURISTIC", "PERSONALIZED_SUBDOMAIN", possible, "HOST_COMPONENT_REVIEW"),
        one(good & origin, "URL-006", "MEDIUM", "CERTAIN_BY_PARSER", "ORIGIN_ONLY_CHANGES_FUNCTIONALITY", possible, "ORIGIN_ONLY_FUNCTIONALITY_REVIEW"),
        one(F.col("has_fragment"), "URL-008", "MEDIUM", "CERTAIN_BY_PARSER", "URL_FRAGMENT_PRESENT", possible, "FRAGMENT_SEMANTICS_REVIEW"),
        one(F.col("has_userinfo"), "URL-008", "CRITICAL", "CERTAIN_BY_PARSER", "DECEPTIVE_URL_USERINFO", high, "DECEPTIVE_HOST_REVIEW"),
        one(F.col("unresolved_redirect"), "URL-009", "HIGH", "STRONG_HEURISTIC", "UNRESOLVED_REDIRECT_URL", high, "UNRESOLVED_REDIRECT_REVIEW"),
    ]
    return F.concat(*parts)


def url_findings(analysed: DataFrame) -> DataFrame:
    """U16: one row per finding, ids numbered inside the candidate."""
    rows = to_rows(analysed, ["source_id", "token_id"], F.col("findings"), "i")
    gated = F.col("review_code").isNotNull()
    return rows.select(
        "source_id", "token_id", F.concat("token_id", F.lit("-f-"), "i").alias("finding_id"),
        *[c for c in rows.columns if c not in ("source_id", "token_id", "i")],
        gated.alias("requires_decision"),
        F.when(gated, F.lit("REVIEW_REQUIRED")).otherwise(F.lit("DETECTED")).alias("status"),
    )


# ------------------------------------------------------------------------------------------------ U19
_PATH_BARE = {"%21": "!", "%24": "$", "%26": "&", "%27": "'", "%28": "(", "%29": ")", "%2B": "+", "%2C": ",",
              "%3A": ":", "%3B": ";", "%3D": "=", "%40": "@", "%5B": "[", "%5D": "]", "%7E": "~"}
_FRAGMENT_BARE = {**_PATH_BARE, "%2F": "/", "%3F": "?"}


def _percent(value: Column, bare: dict[str, str]) -> Column:
    coded = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    restored = reduce(lambda v, kv: F.replace(v, F.lit(kv[0]), F.lit(kv[1])), bare.items(), coded)
    return F.when(value.rlike(r"[^A-Za-z0-9._*-]"), restored).otherwise(value)


def serialize(scheme: Column, userinfo: Column, host: Column, port: Column, path: Column, query: Column, fragment: Column) -> Column:
    """URL text from components only; an absent scheme stays absent."""
    user_parts = F.split(userinfo, ":", 2)
    user = F.when(userinfo.isNull(), F.lit("")).otherwise(
        F.concat(F.array_join(F.transform(user_parts, lambda u: _percent(u, {})), ":"), F.lit("@"))
    )
    segments = F.array_join(F.transform(path, lambda s: _percent(s, _PATH_BARE)), "/")
    params = F.array_join(
        F.transform(
            query,
            lambda q: F.concat(_percent(q["name"], {}), F.when(q["value"].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), _percent(q["value"], {})))),
        ),
        "&",
    )
    return F.concat(
        F.when(scheme.isNull(), F.lit("")).otherwise(F.concat(F.lower(scheme), F.lit("://"))), user, F.lower(host),
        F.when(port.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), port)), F.lit("/"), F.coalesce(segments, F.lit("")),
        F.when(F.size(query) > 0, F.concat(F.lit("?"), params)).otherwise(F.lit("")),
        F.when(fragment.isNull(), F.lit("")).otherwise(F.concat(F.lit("#"), _percent(fragment, _FRAGMENT_BARE))),
    )


_PARTS = ("scheme", "userinfo", "host", "port", "path_segments", "query", "fragment")


def serialize_url(components: DataFrame) -> DataFrame:
    """Text plus ``stable``: parsing the text gives the same components back."""
    cols = [F.col(c) for c in _PARTS]
    out = components.withColumn("text", serialize(*cols))
    again = out.select(
        "source_id", "token_id", "text", F.struct(*cols).alias("_want"), F.col("text").alias("target"),
        F.col("scheme").isNull().alias("scheme_implicit"), F.lit("ABSOLUTE").alias("kind"),
    )
    back = parse_url_components(again)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_want.{c}")) for c in _PARTS])
    return back.select("source_id", "token_id", "text", (F.col("failure").isNull() & same).alias("stable"))


# ------------------------------------------------------------------------------------- U17, U18, U20
def url_policy(analysed: DataFrame, approvals: DataFrame | None = None, suffixes: tuple[str, ...] | DataFrame = ur.PUBLIC_SUFFIXES) -> DataFrame:
    """Proposed components, policy, text, required reviews and warning of every parsed candidate.

    ``approvals(source_id, approved_codes, host_by_token)`` is keyed by source.
    """
    df = analysed
    if approvals is not None:
        wanted = [c for c in ("approved_codes", "host_by_token") if c in approvals.columns]
        df = df.join(approvals.select("source_id", *wanted), "source_id", "left")
    for name, kind in (("approved_codes", "array<string>"), ("host_by_token", "map<string,string>")):
        empty = F.array().cast(kind) if kind.startswith("array") else F.create_map().cast(kind)
        df = df.withColumn(name, F.coalesce(F.col(name), empty) if name in df.columns else empty)
    review = lambda code: F.array_contains("review_codes", code)
    has_path = lambda r: F.coalesce(F.array_contains("path_risks", r), F.lit(False))
    origin_review = review("ORIGIN_ONLY_FUNCTIONALITY_REVIEW")
    given_host = F.when(review("IDN_CONFUSABLE_HOST_REVIEW"), F.element_at("host_by_token", F.col("token_id")))
    valid_host = given_host.rlike(r"^[A-Za-z0-9_-]{1,63}(?:\.[A-Za-z0-9_-]{1,63})*$")
    df = df.withColumns({
        "_reduce": (F.col("subdomain_risk") == "LIKELY_PERSONALIZED")
        | (origin_review & F.col("subdomain").isNotNull() & F.col("registrable_domain").isNotNull()),
        "_encoded": has_path("PERCENT_ENCODED_IDENTIFIER"), "_ident": has_path("LIKELY_IDENTIFIER"),
        "_given": F.when(F.coalesce(valid_host, F.lit(False)), F.lower(given_host)),
        "invalid_host": review("IDN_CONFUSABLE_HOST_REVIEW") & ~F.coalesce(valid_host, F.lit(False)),
    })
    kind = F.col("kind")
    strict = kind.isin("QR_PAYLOAD", "MARKDOWN_TARGET") & (F.size("query") > 0)
    unknown = F.exists("query_risks", lambda r: r.isin("UNKNOWN", "LIKELY_IDENTIFIER"))
    df = df.withColumns({
        "_origin": F.col("_ident") | F.col("_reduce") | origin_review,
        "_all_query": F.coalesce(unknown, F.lit(False)) | F.coalesce(strict, F.lit(False)),
        "_tracking": F.coalesce(F.array_contains("query_risks", "KNOWN_TRACKING"), F.lit(False)),
        "p_host": F.when(F.col("_reduce"), F.col("registrable_domain")).otherwise(F.coalesce("_given", "host")),
    })
    cut = F.array_position("path_risks", "PERCENT_ENCODED_IDENTIFIER").cast("int") - 1
    blank = F.array(F.lit(""))
    path = (
        F.when(F.col("_origin"), blank)
        .when(F.col("_encoded"), F.when(cut > 0, F.slice("path_segments", 1, cut)).otherwise(blank))
        .otherwise(F.col("path_segments"))
    )
    kept = F.transform(
        F.filter(F.arrays_zip("query", "query_risks"), lambda z: (z["query_risks"] != "KNOWN_TRACKING") & ~F.col("_all_query")),
        lambda z: z["query"],
    )
    df = df.withColumns({"p_path": path, "p_query": kept})
    none = F.lit(None).cast("string")
    df = df.withColumn("proposed_text", serialize(F.col("scheme"), none, F.col("p_host"), F.col("port"), F.col("p_path"), F.col("p_query"), none))
    policy = (
        F.when(F.col("_origin"), F.lit("KEEP_ORIGIN_ONLY"))
        .when(F.col("_encoded"), F.lit("REDUCE_PATH"))
        .when(F.col("userinfo").isNotNull() | (F.col("p_host") != F.col("host")), F.lit("MANUAL"))
        .when(F.col("_all_query") | F.col("fragment").isNotNull(), F.lit("REMOVE_QUERY_AND_FRAGMENT"))
        .when(F.col("_tracking"), F.lit("REMOVE_KNOWN_TRACKING"))
        .otherwise(F.lit("KEEP_FULL"))
    )
    warning = F.when(F.col("unresolved_redirect"), F.lit("UNRESOLVED_REDIRECT_DESTINATION")).when(
        F.size("review_codes") > 0, F.lit("URL_CHANGE_OR_RETENTION_REQUIRES_REVIEW")
    )
    good = F.col("failure").isNull()
    return df.withColumns({
        "policy": F.when(good, policy), "warning": F.when(good, warning), "required_reviews": F.col("review_codes"),
    })


_CHANGE = "array<struct<component:string,block_id:string,before:string,after:string,review_code:string>>"


def change_array() -> Column:
    """Ordered component changes of one proposal (over url_policy columns)."""
    review = lambda code: F.array_contains("review_codes", code)
    none = F.lit(None).cast("string")
    kind = F.col("kind")

    def one(when, component, block, before, after, code) -> Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
        return F.when(
            F.coalesce(when, F.lit(False)),
            F.struct(lit(component).alias("component"), lit(block).alias("block_id"), before.alias("before"), after.alias("after"), lit(code).alias("review_code")),
        )

    moved = F.col("p_host") != F.col("host")
    host_code = F.when(
        F.col("_reduce"),
        F.when(review("HOST_COMPONENT_REVIEW"), F.lit("HOST_COMPONENT_REVIEW")).otherwise(F.lit("ORIGIN_ONLY_FUNCTIONALITY_REVIEW")),
    ).otherwise(F.lit("IDN_CONFUSABLE_HOST_REVIEW"))
    path_code = (
        F.when(F.col("_encoded"), F.lit("ENCODED_PATH_COMPONENT_REVIEW"))
        .when(review("HOST_COMPONENT_REVIEW"), F.lit("HOST_COMPONENT_REVIEW"))
        .when(F.col("_ident"), F.lit("PATH_SEMANTICS_REVIEW"))
        .otherwise(F.lit("ORIGIN_ONLY_FUNCTIONALITY_REVIEW"))
    )
    head = [
        one(F.col("wrapped"), "LINE_WRAP", "URL-001", F.col("original"), F.col("target"), "URL_LINE_WRAP_RECONSTRUCTION_REVIEW"),
        one((kind == "MARKDOWN_TARGET") & (F.col("display") != F.col("target")), "DISPLAY_MODE", "URL-015", F.col("display"), F.col("target"), "VISIBLE_TEXT_LINK_TARGET_REVIEW"),
        one(moved, F.when(F.col("_reduce"), F.lit("SUBDOMAIN")).otherwise(F.lit("HOST")),
            F.when(F.col("_reduce"), F.lit("URL-013")).otherwise(F.lit("URL-003")), F.col("host"), F.col("p_host"), host_code),
        one(F.col("userinfo").isNotNull(), "USERINFO", "URL-008", F.col("userinfo"), none, "DECEPTIVE_HOST_REVIEW"),
        one(F.col("p_path") != F.col("path_segments"), "PATH", "URL-012", F.array_join("path_segments", "/"), F.array_join("p_path", "/"), path_code),
    ]

    def dropped(z: Column) -> Column:
        q, risk = z["query"], z["query_risks"]
        tracking = risk == "KNOWN_TRACKING"
        code = (
            F.when(tracking, none)
            .when(kind == "QR_PAYLOAD", F.lit("QR_PAYLOAD_REVIEW"))
            .when(kind == "MARKDOWN_TARGET", F.lit("ORIGIN_ONLY_FUNCTIONALITY_REVIEW"))
            .otherwise(F.lit("UNKNOWN_URL_COMPONENT_REVIEW"))
        )
        before = F.when(q["value"].isNull(), q["name"]).otherwise(F.concat(q["name"], F.lit("="), q["value"]))
        return one(tracking | F.col("_all_query"), "QUERY_PARAMETER", F.when(tracking, F.lit("URL-010")).otherwise(F.lit("URL-011")), before, none, code)

    tail = [
        one(F.col("fragment").isNotNull(), "FRAGMENT", "URL-011", F.col("fragment"), none, "FRAGMENT_SEMANTICS_REVIEW"),
        one(F.col("target") != F.col("proposed_text"), "SERIALIZATION", "URL-014", F.col("target"), F.col("proposed_text"),
            F.when(review("MALFORMED_PERCENT_ENCODING_REVIEW"), F.lit("MALFORMED_PERCENT_ENCODING_REVIEW"))),
    ]
    queries = F.transform(F.arrays_zip("query", "query_risks"), dropped)
    every = F.concat(F.array(*head).cast(_CHANGE), queries.cast(_CHANGE), F.array(*tail).cast(_CHANGE))
    return F.when(F.col("failure").isNull(), F.filter(every, lambda c: c.isNotNull())).otherwise(F.array().cast(_CHANGE))


def url_changes(proposed: DataFrame) -> DataFrame:
    """One row per changed component."""
    return to_rows(proposed, ["source_id", "token_id"], change_array(), "seq")


class UrlCanonicalization:
    """Tokens, gates, decisions, ledger and failures as views over one staged DataFrame."""

    def __init__(self, staged: DataFrame):
        self.staged = staged

    def tokens(self) -> DataFrame:
        gates = F.size("review_codes") > 0
        return keep_rows(self.staged, F.col("can_apply")).select(
            "source_id", "token_id", "display", F.col("proposed_text").alias("final_text"), "policy", "warning", gates.alias("user_approved")
        )

    def gates(self) -> DataFrame:
        states = F.transform(
            "review_codes", lambda c: F.struct(c.alias("review_code"), F.array_contains("approved_gates", c).alias("done")))
        rows = to_rows(self.staged, ["source_id", "token_id"], states)
        done = F.col("done")
        return rows.select("source_id", "token_id", "review_code", F.lit(True).alias("blocking"), F.when(done, F.lit("APPROVED")).otherwise(F.lit("PENDING")).alias("status"))

    def decisions(self) -> DataFrame:
        action = F.create_map(*[F.lit(x) for k, v in ur.URL_REVIEWS.items() for x in (k, v[0])])
        return self.gates().select(
            "source_id", "token_id", F.concat("token_id", F.lit("-d-"), F.lower("review_code")).alias("decision_id"),
            action[F.col("review_code")].alias("action"), "status", F.lit("POSSIBLE").alias("impact"),
        )

    def ledger(self) -> DataFrame:
        rows = url_changes(keep_rows(self.staged, F.col("can_apply")))
        impact = F.when(F.col("review_code").isNull(), F.lit("NONE")).otherwise(F.lit("POSSIBLE"))
        return rows.select(
            "source_id", "token_id", F.concat("token_id", F.lit("-c-"), "seq").alias("change_id"), "block_id",
            F.lit(1).alias("block_version"), F.lit("URL").alias("category"), "before", "after", impact.alias("semantic_impact"), "review_code",
        )

    def failures(self) -> DataFrame:
        return to_rows(self.staged, ["source_id", "token_id"], F.array_distinct("failures"))


def canonicalize_urls(analysed: DataFrame, approvals: DataFrame | None = None) -> UrlCanonicalization:
    """An approved gate needs its code (and a valid host for look-alike hosts); one failure blocks the token."""
    df = url_policy(analysed, approvals)
    passed = F.filter(
        "review_codes",
        lambda c: F.array_contains("approved_codes", c)
        & F.when(c == "IDN_CONFUSABLE_HOST_REVIEW", ~F.col("invalid_host")).otherwise(c != "PARSE_FAILURE_REVIEW"),
    )
    df = df.withColumn("approved_gates", passed)
    kind = "array<struct<code:string,block_id:string>>"
    block = F.create_map(*[F.lit(x) for k, v in ur.URL_REVIEWS.items() for x in (k, v[1])])
    single = lambda when, code, b: F.when(when, F.array(F.struct(code.alias("code"), F.lit(b).alias("block_id"))).cast(kind)).otherwise(F.array().cast(kind))
    pending = F.transform(
        F.array_except("review_codes", "approved_gates"),
        lambda c: F.struct(F.lit("UNRESOLVED_REVIEW").alias("code"), block[c].alias("block_id")),
    )
    df = df.withColumn(
        "failures",
        F.concat(
            single(F.col("failure").isNotNull(), F.col("failure"), "URL-002"), pending.cast(kind),
            single(F.col("invalid_host"), F.lit("INVALID_APPROVED_HOST"), "URL-003"),
        ),
    )
    return UrlCanonicalization(df.withColumn("can_apply", F.size("failures") == 0))


def rewrite_urls(sources: DataFrame, candidates: DataFrame, tokens: DataFrame) -> DataFrame:
    """The text with every candidate replaced, or NULL when one candidate has no approved token.

    Candidates of one text meet in one group: the group is part of that text's own row. Overlapping
    candidates make the text NULL with ``error`` set.
    """
    joined = candidates.select("source_id", "token_id", "start", "end", "kind", "display").join(
        tokens.select("source_id", "token_id", "final_text"), ["source_id", "token_id"], "left"
    )
    shown = F.when(
        (F.col("kind") == "MARKDOWN_TARGET") & (F.col("display") != F.col("final_text")),
        F.concat("display", F.lit(" ("), "final_text", F.lit(")")),
    ).otherwise(F.col("final_text"))
    parts = joined.withColumn("shown", shown).groupBy("source_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "shown"))).alias("parts"),
        F.count_if(F.col("final_text").isNull()).alias("missing"),
    )
    # The parts of the texts are looked up, so that texts need not be sorted.
    df = sources.select("source_id", "text").join(parts.hint("shuffle_hash"), "source_id", "left")
    overlap = F.exists(
        F.transform("parts", lambda p, i: F.coalesce(F.get("parts", i - 1)["end"] > p["start"], F.lit(False))), lambda b: b
    )
    whole = (F.col("missing") == 0) & ~overlap
    bounds = F.flatten(F.transform("parts", lambda p: F.array(p["start"], p["end"])))
    # Bytes that are no text stay in the JVM.
    valid = whole & F.is_valid_utf8("text")
    df = df.withColumn("_cut", tx.cut_at(F.when(valid, F.col("text")), F.when(valid, bounds)))

    def splice(cs: Column) -> Column:
        piece = lambda a, b: F.array_join(F.slice(cs, a + 1, F.greatest(b - a, F.lit(0))), "")
        pieces = F.transform(
            "parts",
            lambda p, i: F.concat(piece(F.coalesce(F.get("parts", i - 1)["end"], F.lit(0)), p["start"]), p["shown"]),
        )
        return F.concat(F.array_join(pieces, ""), piece(F.get("parts", F.size("parts") - 1)["end"], F.size(cs)))

    kept = F.transform("parts", lambda p, i: F.concat(F.get("_cut", 2 * i), p["shown"]))
    joined_up = F.concat(F.array_join(kept, ""), F.get("_cut", 2 * F.size("parts")))
    spliced = F.when(F.col("parts").isNull(), F.col("text")).when(valid, joined_up).when(
        whole, tx.let(tx.chars(F.col("text")), splice)
    )
    return df.select("source_id", spliced.alias("text"), F.when((F.col("missing") == 0) & overlap, F.lit("OVERLAPPING_URL_CANDIDATES")).alias("error"))
