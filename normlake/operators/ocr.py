"""OCR and barcode observations as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.functions import text as tx
from normlake.operators.ordering import ranked
from normlake.session import discard, stored

_BOX = ("left", "top", "right", "bottom")


def _side(a: str, b: str, low: str, high: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.col(a + high), F.col(b + high)) - F.greatest(F.col(a + low), F.col(b + low)))


def _intersection(a: str, b: str) -> Column:
    return _side(a, b, "left", "right") * _side(a, b, "top", "bottom")


def _iou(a: str, b: str) -> Column:
    area = lambda p: (F.col(p + "right") - F.col(p + "left")) * (F.col(p + "bottom") - F.col(p + "top"))
    union = area(a) + area(b) - _intersection(a, b)
    return F.when(union <= 0, F.lit(0.0)).otherwise(_intersection(a, b) / union)


_LEVELS = 6


def _level(side: Column) -> Column:
    """The finest grid, of 4^level cells along a side, whose cells are as wide as ``side``."""
    return sum((F.when(side <= 4.0 ** -k, 1).otherwise(0) for k in range(1, _LEVELS + 1)), F.lit(0))


def _cell(value: Column, level: Column) -> Column:
    """Cell of a coordinate; those outside the image count with its edge cells."""
    cells = F.pow(F.lit(4.0), level)
    return F.greatest(F.least(F.floor(value * cells), cells - 1), F.lit(0.0)).cast("int")


def touching_pairs(boxes: DataFrame, group: str, ident: str) -> DataFrame:
    """Ordered pairs of boxes of a group that share area.

    Columns and rows each have a grid per size of box, so small boxes meet in small cells however many lie close together,
    and long lines of text in flat ones. A box is in at most two cells along a side of its own grid and of each coarser one
    in use. A pair meets in the coarser grid of its two on either side, in the cell of its common corner only.
    """
    own = boxes.select(group, F.col(ident).alias("_id"), *_BOX, _level(F.col("right") - F.col("left")).alias("_lx"), _level(F.col("bottom") - F.col("top")).alias("_ly"))
    used = own.select("_lx", "_ly").distinct()  # at most 49 rows
    at_x, at_y = used.select(F.col("_lx").alias("_x")).distinct(), used.select(F.col("_ly").alias("_y")).distinct()
    cells = own.join(F.broadcast(at_x), F.col("_x") <= F.col("_lx")).join(F.broadcast(at_y), F.col("_y") <= F.col("_ly"))
    cells = cells.withColumn("_cx", F.explode(F.sequence(_cell(F.col("left"), F.col("_x")), _cell(F.col("right"), F.col("_x")))))
    cells = cells.withColumn("_cy", F.explode(F.sequence(_cell(F.col("top"), F.col("_y")), _cell(F.col("bottom"), F.col("_y")))))
    key = [group, "_x", "_y", "_cx", "_cy"]
    side = lambda p: cells.select(*key, F.col("_id").alias(p[:-1]), *[F.col(c).alias(f"{p}{c}") for c in (*_BOX, "_lx", "_ly")])
    both = side("a_").join(side("b_"), key)
    home = (F.least("a__lx", "b__lx") == F.col("_x")) & (F.least("a__ly", "b__ly") == F.col("_y"))
    home &= (_cell(F.greatest("a_left", "b_left"), F.col("_x")) == F.col("_cx")) & (_cell(F.greatest("a_top", "b_top"), F.col("_y")) == F.col("_cy"))
    return both.where(home & (_intersection("a_", "b_") > 0))


def ocr_clusters(observations: DataFrame, min_iou: float) -> DataFrame:
    """Greedy first-fit clusters in arrival order, computed as a fixpoint over distinct boxes.

    An observation joins the first cluster that already has a member close enough, so its label is the
    smallest label among earlier close observations, and an observation without one founds a cluster. Labels
    therefore spread forward in time along close boxes. The state holds, per distinct box, from which arrival
    number on a label is present; repeated observations of one box never pair up with each other, and an
    image's rows are never gathered in one task. ``cluster_id`` is the founder's ``seq``.
    """
    if min_iou <= 0:
        first = observations.groupBy("image_id").agg(F.min("seq").alias("cluster_id"))
        return observations.join(first, "image_id")
    keyed = observations.withColumn("_box", F.xxhash64(*_BOX))
    boxes = keyed.groupBy("image_id", "_box").agg(F.min("seq").alias("_first"), *[F.first(c).alias(c) for c in _BOX])
    near = touching_pairs(boxes, "image_id", "_box").where(_iou("a_", "b_") >= min_iou).select("image_id", "a", "b")
    near = stored(near, "near")
    firsts = boxes.select("image_id", F.col("_box").alias("b"), F.col("_first").alias("_bf"))
    opened = near.join(firsts, ["image_id", "b"]).groupBy("image_id", "a").agg(F.min("_bf").alias("_earliest"))
    founders = boxes.select("image_id", F.col("_box").alias("a"), "_first").join(opened, ["image_id", "a"], "left").where(
        F.col("_earliest").isNull() | (F.col("_earliest") == F.col("_first")))
    state = stored(founders.select("image_id", F.col("a").alias("_box"), F.col("_first").alias("label"), F.col("_first").alias("since")), "labels")
    arrivals = keyed.select("image_id", "_box", "seq")
    fresh = state
    while True:
        reach = near.join(fresh.withColumnRenamed("_box", "a"), ["image_id", "a"]).groupBy("image_id", F.col("b").alias("_box"), "label").agg(F.min("since").alias("_after"))
        step = arrivals.join(reach, ["image_id", "_box"]).where(F.col("seq") > F.col("_after")).groupBy("image_id", "_box", "label").agg(F.min("seq").alias("since"))
        known = state.select("image_id", "_box", F.col("label").alias("_l"), F.col("since").alias("_s"))
        better = step.join(known, ["image_id", "_box"], "left").groupBy("image_id", "_box", "label", "since").agg(
            F.max(F.coalesce((F.col("_l") <= F.col("label")) & (F.col("_s") <= F.col("since")), F.lit(False))).alias("_old")
        ).where(~F.col("_old")).drop("_old")
        last, fresh = fresh, stored(better, "fresh")
        if last is not state:
            discard(last)
        if fresh.isEmpty():
            break
        last, state = state, stored(state.unionByName(fresh).groupBy("image_id", "_box", "label").agg(F.min("since").alias("since")), "labels")
        discard(last)
    labelled = keyed.select("image_id", "seq", "_box").join(state, ["image_id", "_box"]).where(F.col("since") <= F.col("seq")).groupBy(
        "image_id", "seq").agg(F.min("label").alias("cluster_id"))
    return observations.join(labelled, ["image_id", "seq"])


# ------------------------------------------------------------------------------------------ O02 - O04
def ocr_consensus(clustered: DataFrame, expected_sources: int, min_sources: int, max_edge_delta: float, min_confidence: float | None = None) -> DataFrame:
    """One region per cluster. Text is ranked by distinct (engine, view) sources, ties by arrival; it is
    accepted only without any review reason. Groups keep counts, extremes and short vocabularies only."""
    cid = ["image_id", "cluster_id"]
    norm = F.regexp_replace(F.trim(tx.normalize(F.col("text"), "NFC")), r"\s+", " ")
    df = clustered.withColumn("_norm", norm)
    sources = df.select(*cid, "_norm", "engine_id", "view_id").distinct().groupBy(*cid, "_norm").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("engine_id")).alias("engines"), F.array_sort(F.collect_set("view_id")).alias("views"))
    first = F.min_by(F.struct("text", *_BOX), "seq").alias("ref")
    stats = df.groupBy(*cid, "_norm").agg(
        F.min("seq").alias("_first"), first, *[F.min(c).alias(f"min_{c}") for c in _BOX], *[F.max(c).alias(f"max_{c}") for c in _BOX],
        F.min("confidence").alias("low"), F.count_if(F.col("confidence").isNull()).alias("unknown"))
    per = stats.join(sources, cid + ["_norm"])
    scripts = df.groupBy(*cid).agg(F.array_sort(F.collect_set("script")).alias("scripts"))
    fields = [c for c in per.columns if c not in cid]
    best = per.groupBy(*cid).agg(
        F.max_by(F.struct(*fields), F.struct("n", (-F.col("_first")).alias("f"))).alias("w"), F.count("*").alias("texts"))
    w = lambda c: F.col(f"w.{c}")
    delta = F.greatest(*[F.greatest(w(f"ref.{c}") - w(f"min_{c}"), w(f"max_{c}") - w(f"ref.{c}")) for c in _BOX])
    low = F.lit(False) if min_confidence is None else (w("unknown") > 0) | F.coalesce(w("low") < min_confidence, F.lit(True))
    best = best.join(scripts, cid)
    reasons = F.array_compact(F.array(
        F.when((F.col("texts") > 1) | (w("n") < min_sources), F.lit("ENGINE_DISAGREEMENT")),
        F.when(delta > max_edge_delta, F.lit("GEOMETRY_CONFLICT")),
        F.when(low, F.lit("LOW_CONFIDENCE")),
        F.when(w("n") < expected_sources, F.lit("MISSING_ENGINE_OBSERVATION")),
        F.when(F.size("scripts") > 1, F.lit("SCRIPT_CONFLICT")),
    ))
    return best.select(
        *cid, F.when(F.size(reasons) == 0, w("ref.text")).alias("text"), reasons.alias("review_reasons"), "scripts",
        w("engines").alias("engines"), w("views").alias("views"), *[w(f"ref.{c}").alias(c) for c in _BOX])


def ocr_overlaps(regions: DataFrame) -> DataFrame:
    """Regions that share area with another region of the image lose their text and gain a reason."""
    pairs = touching_pairs(regions, "image_id", "cluster_id").where("a <> b")
    hit = pairs.select("image_id", F.col("a").alias("cluster_id")).distinct().withColumn("_hit", F.lit(True))
    df = regions.join(hit, ["image_id", "cluster_id"], "left")
    over = F.coalesce("_hit", F.lit(False))
    return df.withColumn("text", F.when(~over, F.col("text"))).withColumn(
        "review_reasons", F.when(over, F.array_append("review_reasons", F.lit("OVERLAPPING_READING_ORDER"))).otherwise(F.col("review_reasons"))
    ).drop("_hit")


def reading_order(regions: DataFrame, direction: str, tolerance: float) -> DataFrame:
    """Position of each region by line (quantised), then along the line; equal keys keep cluster order."""
    line = lambda c: F.col(c) if tolerance == 0 else (F.col(c) / tolerance).cast("int")
    first, second = {
        "LEFT_TO_RIGHT": (line("top"), F.col("left")),
        "RIGHT_TO_LEFT": (line("top"), -F.col("right")),
        "VERTICAL": (-line("right"), F.col("top")),
    }[direction]
    return ranked(regions, "image_id", [first.asc(), second.asc(), F.col("cluster_id").asc()], "reading_order_index")


# ------------------------------------------------------------------------------------------ O05, O06
QR_FORMAT = 256


def barcode_consensus(clustered: DataFrame, min_views: int) -> DataFrame:
    """A cluster's value counts only if it is the single one, every observation is decoded and enough
    views agree; otherwise the region is redacted as undecodable."""
    cid = ["image_id", "cluster_id"]
    views = clustered.where("decoded_value IS NOT NULL").select(*cid, "view_id").distinct().groupBy(*cid).agg(F.count("*").alias("_views"))
    df = clustered.groupBy(*cid).agg(
        F.min("decoded_value").alias("_low"), F.max("decoded_value").alias("_high"), F.count_if(F.col("decoded_value").isNull()).alias("_undecoded"),
        F.min_by("format_code", "seq").alias("format_code"),
    ).join(views, cid, "left")
    ok = (F.col("_low") == F.col("_high")) & (F.col("_undecoded") == 0) & (F.coalesce("_views", F.lit(0)) >= min_views) & (F.col("_low") != "")
    ok = F.coalesce(ok, F.lit(False))
    return df.select(
        *cid, F.when(F.col("format_code") == QR_FORMAT, F.lit("QR_CODE")).otherwise(F.lit("BARCODE")).alias("region_type"), ok.alias("decoded"),
        F.when(ok, F.col("_low")).alias("value"),
        F.when(ok, F.lit("REBUILD_FROM_STRUCTURED_DATA")).otherwise(F.lit("SOLID_REDACT")).alias("policy"),
        F.when(ok, F.array().cast("array<string>")).otherwise(F.array(F.lit("UNDECODABLE_REGION"))).alias("review_reasons"),
    )


def barcode_route(codes: DataFrame, approvals: DataFrame | None = None) -> DataFrame:
    """Accepted payloads through the identifier text gate, then the URL rules as QR payload.

    codes as from barcode_consensus; output one row per accepted code with the gated text, whether it is
    locked, and the URL policy and text when the payload is a URL.
    """
    from normlake.operators import text_transform as tt
    from normlake.operators import urls

    sid = F.concat_ws("|", F.col("image_id").cast("string"), F.col("cluster_id").cast("string"))
    src = codes.where("decoded").select(sid.alias("source_id"), F.col("value").alias("text"), F.lit("IDENTIFIER").alias("source_kind"))
    gated = tt.canonicalize_text(src, approvals).canonical()
    qr = gated.select("source_id", "text", F.lit("QR_PAYLOAD").alias("source_kind"))
    proposed = urls.url_policy(urls.analyze_urls(urls.url_candidates(qr))).select(
        "source_id", "kind", "failure", "policy", "proposed_text", F.array_join("review_codes", ",").alias("required_reviews"))
    return gated.select("source_id", F.col("text").alias("value"), "locked").join(proposed, "source_id", "left")
