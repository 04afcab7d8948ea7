"""Pixels and image headers as tables.

A pixel's neighbours are reached by emitting its contribution to their positions and grouping by
(image, position): one shuffle on a key as fine as the pixel, so one huge image spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlake.operators.common import code_map


def channel(argb: Column, shift: int) -> Column:
    return F.shiftright(argb, shift).bitwiseAND(F.lit(255))


def luma(argb: Column) -> Column:
    return F.shiftright(channel(argb, 16) * 77 + channel(argb, 8) * 150 + channel(argb, 0) * 29, 8)


def image_resource_plan(
    headers: DataFrame, max_width: int, max_height: int, max_pixels: int, max_bytes: int, max_frames: int = 1,
    reject_animated: bool = False, allow_sampling: bool = True, allow_tiling: bool = True,
) -> DataFrame:
    """Decode strategy of every header by ordered rules; products that overflow reject the image."""
    w, h = F.col("width").cast("bigint"), F.col("height").cast("bigint")
    depth = F.when(F.col("bit_depth") > 8, 8).when(F.col("channels") >= 3, 4).otherwise(2).cast("bigint")
    df = headers.withColumn("_px", F.try_multiply(w, h)).withColumn("_full", F.try_multiply(F.col("_px"), depth)).withColumn("_depth", depth)
    steps = F.array(*[F.lit(2**k) for k in range(1, 8)])
    ceil_div = lambda v, s: F.floor((v + s - 1) / s).cast("bigint")

    def fits(s: Column) -> Column:
        px = ceil_div(w, s) * ceil_div(h, s)
        return (px <= max_pixels) & (px * F.col("_depth") <= max_bytes)

    sample = F.when(F.lit(allow_sampling) & F.col("_full").isNotNull(), F.get(F.filter(steps, fits), F.lit(0)))
    df = df.withColumn("_sample", sample)
    animated = F.col("animated")
    rules = [
        ((w > max_width) | (h > max_height), "REJECT", "DIMENSION_LIMIT_EXCEEDED", False),
        (animated & F.col("frame_count").isNull(), "REJECT", "FRAME_COUNT_UNKNOWN", True),
        (animated & ((F.col("frame_count") > max_frames) | F.lit(reject_animated)), "REJECT", "ANIMATION_REJECTED", True),
        (F.col("_px").isNull(), "REJECT", "ARITHMETIC_OVERFLOW", False),
        ((F.col("_px") > max_pixels) & F.lit(not allow_sampling and not allow_tiling), "REJECT", "PIXEL_LIMIT_EXCEEDED", False),
        (F.col("_full").isNull(), "REJECT", "ARITHMETIC_OVERFLOW", False),
        ((F.col("_px") <= max_pixels) & (F.col("_full") <= max_bytes), "FULL", "WITHIN_VALIDATED_BUDGET", None),
        (F.col("_sample").isNotNull(), "SAMPLED", "SAMPLING_REQUIRED", True),
        (F.lit(allow_tiling), "TILED", "TILING_REQUIRED", True),
        (F.lit(True), "REJECT", "MEMORY_LIMIT_EXCEEDED", False),
    ]
    chosen = F.lit(None)
    for cond, strategy, reason, review in reversed(rules):
        flag = animated if review is None else F.lit(review)
        chosen = F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(strategy).alias("strategy"), F.lit(reason).alias("reason"), flag.alias("review_required"))).otherwise(chosen)
    df = df.withColumn("_r", chosen)
    sampled = ceil_div(w, F.col("_sample")) * ceil_div(h, F.col("_sample")) * F.col("_depth")
    return df.select(
        "image_id", F.col("_r.strategy").alias("strategy"),
        F.when(F.col("_r.strategy") == "SAMPLED", F.col("_sample")).otherwise(F.lit(1)).alias("sample_size"),
        F.when(F.col("_r.strategy") == "FULL", F.col("_full")).when(F.col("_r.strategy") == "SAMPLED", sampled).alias("estimated_bytes"),
        F.col("_r.reason").alias("reason"), F.col("_r.review_required").alias("review_required"),
    )


# --- fixed values: directory name patterns in order -> metadata family ---
FAMILIES = (
    ("thumbnail", "EMBEDDED_THUMBNAIL"), (r"\.exif\.|exifdirectory$", "EXIF"), (r"\.xmp\.", "XMP"), (r"\.iptc\.", "IPTC"),
    (r"\.icc\.", "ICC_PROFILE"), ("comment|text", "TEXT"), ("photoshop|adobe|ducky", "APPLICATION_STRUCTURE"),
    ("jfif|huffman", "ENCODER_STRUCTURE"), (r"^com\.drew\.metadata\.", "FORMAT_STRUCTURE"),
)


def schema_name(value: Column, fallback: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^A-Z0-9]++", "_"), "^_++|_++$", "")
    return F.when(clean != "", clean).otherwise(fallback)


def metadata_inventory(tags: DataFrame, max_directories: int | None = None, max_tags: int | None = None, retain_thumbnail: bool = False) -> DataFrame:
    """Directories of each image by family with their tag counts; everything unless a budget is passed.

    tags(image_id, directory_idx, directory_name, directory_class, tag_idx, tag_name, tag_type,
    directory_errors). Positions are given by the reader, so budgets compare sums over earlier directories
    instead of numbering every tag. ``directory_short`` is the name's first 80 characters.
    """
    kept = tags.groupBy("image_id", "directory_idx").agg(
        F.first("directory_name").alias("name"), F.first("directory_class").alias("cls"), F.count("tag_idx").alias("n_tags"), F.max("directory_errors").alias("errors"),
    )
    over = F.lit(False)
    if max_directories is not None:
        over = F.max(F.col("directory_idx")).over(Window.partitionBy("image_id")) >= max_directories
    kept = kept.withColumn("_over", over).withColumn("tags", F.col("n_tags")).withColumn("_stop", F.lit(None).cast("int"))
    if max_directories is not None:
        kept = kept.where(F.col("directory_idx") < max_directories)
    if max_tags is not None:
        order = Window.partitionBy("image_id").orderBy("directory_idx").rowsBetween(Window.unboundedPreceding, -1)
        kept = kept.withColumn("_before", F.coalesce(F.sum("n_tags").over(order), F.lit(0))).where(F.col("_before") <= max_tags)
        kept = kept.withColumn("tags", F.least("n_tags", F.lit(max_tags) - F.col("_before")))
        first_cut = F.min(F.when(F.col("tags") < F.col("n_tags"), F.col("directory_idx"))).over(Window.partitionBy("image_id"))
        kept = kept.withColumn("_stop", first_cut).where("_stop IS NULL OR directory_idx <= _stop")
    cls = F.lower("cls")
    family = F.lit("UNKNOWN")
    for pattern, name in reversed(FAMILIES):
        family = F.when(cls.rlike(pattern), F.lit(name)).otherwise(family)
    kept = kept.withColumn("family", family)
    facts = kept.groupBy("image_id").agg(
        F.max(F.col("_stop").isNull() & ~F.col("_over")).alias("complete"),
        F.max(F.col("family") == "EMBEDDED_THUMBNAIL").alias("_thumb"),
        F.max((F.col("family") == "EMBEDDED_THUMBNAIL") & (F.col("errors") > 0)).alias("_bad"),
    )
    policy = F.when(F.lit(retain_thumbnail) & F.col("_thumb") & ~F.col("_bad") & F.col("complete"), F.lit("RETAIN_WITH_EXPLICIT_APPROVAL")).otherwise(F.lit("DISCARD"))
    return kept.select("image_id", "directory_idx", schema_name(F.col("name"), F.lit("UNKNOWN")).alias("directory"),
                       F.substring(schema_name(F.col("name"), F.lit("UNKNOWN")), 1, 80).alias("directory_short"), "family", "tags").join(
        facts.select("image_id", "complete", policy.alias("thumbnail_policy")), "image_id"
    )


def channel_inventory(pixels: DataFrame) -> DataFrame:
    """Range of every channel and whether any pixel is not opaque."""
    aggs = []
    for name, shift in (("alpha", 24), ("red", 16), ("green", 8), ("blue", 0)):
        aggs += [F.min(channel(F.col("argb"), shift)).alias(f"min_{name}"), F.max(channel(F.col("argb"), shift)).alias(f"max_{name}")]
    return pixels.groupBy("image_id").agg(*aggs).withColumn("observed_transparency", F.col("min_alpha") < 255)


def orient_pixels(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """The eight EXIF orientations as coordinate maps. sizes(image_id, width, height, orientation)."""
    x, y, w, h, o = (F.col(c) for c in ("x", "y", "width", "height", "orientation"))
    right, bottom = w - 1 - x, h - 1 - y
    to_x = F.when(o.isin(2, 3), right).when(o == 5, y).when(o.isin(6, 7), bottom).when(o == 8, y).otherwise(x)
    to_y = F.when(o.isin(3, 4), bottom).when(o.isin(5, 6), x).when(o.isin(7, 8), right).otherwise(y)
    return pixels.join(sizes, "image_id").select("image_id", to_x.alias("x"), to_y.alias("y"), "argb")


def sample_pixels(pixels: DataFrame, sizes: DataFrame, max_pixels: int) -> DataFrame:
    """Every stride-th pixel in row order, stride = ceil(total / max)."""
    total = F.col("width").cast("bigint") * F.col("height")
    stride = F.greatest(F.lit(1), F.floor((total + max_pixels - 1) / max_pixels)).cast("bigint")
    flat = F.col("y").cast("bigint") * F.col("width") + F.col("x")
    df = pixels.join(sizes.select("image_id", "width", "height"), "image_id").withColumn("_flat", flat).withColumn("_stride", stride)
    return df.where(F.col("_flat") % F.col("_stride") == 0).select(
        "image_id", "x", "y", "argb", F.floor(F.col("_flat") / F.col("_stride")).cast("bigint").alias("sample_idx")
    )


def _edges(samples: DataFrame, last: Column, first: Column) -> DataFrame:
    """(image, idx, first value, previous sample's last value): each sample also feeds its successor."""
    both = samples.select("image_id", F.explode(F.array(
        F.struct(F.col("sample_idx").alias("idx"), first.alias("mine"), F.lit(None).cast("int").alias("prev")),
        F.struct((F.col("sample_idx") + 1).alias("idx"), F.lit(None).cast("int").alias("mine"), last.alias("prev")),
    )).alias("e")).select("image_id", "e.*")
    return both.groupBy("image_id", "idx").agg(F.max("mine").alias("mine"), F.max("prev").alias("prev")).where("mine IS NOT NULL")


def _long(df: DataFrame, names: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select("image_id", F.inline(pairs))


def lsb_evidence(samples: DataFrame) -> DataFrame:
    """Share of ones and of changes in the low bits, channel order blue, green, red along the sample."""
    argb = F.col("argb")
    b, g, r = (F.shiftright(argb, s).bitwiseAND(F.lit(1)) for s in (0, 8, 16))
    inner = samples.groupBy("image_id").agg(
        F.count("*").alias("n"), F.sum(b + g + r).alias("ones"), F.sum((b != g).cast("int") + (g != r).cast("int")).alias("inside"),
    )
    across = _edges(samples, r, b).groupBy("image_id").agg(F.count_if(F.col("prev").isNotNull() & (F.col("mine") != F.col("prev"))).alias("between"))
    df = inner.join(across, "image_id").select(
        "image_id", F.col("n").alias("sample_count"), (F.col("ones") / (F.col("n") * 3)).alias("one_ratio"),
        ((F.col("inside") + F.col("between")) / F.greatest(F.lit(1), F.col("n") * 3 - 1)).alias("transition_ratio"),
    )
    return _long(df, ["sample_count", "one_ratio", "transition_ratio"])


def spatial_evidence(samples: DataFrame) -> DataFrame:
    """Mean and variance of luma steps between neighbouring samples."""
    value = luma(F.col("argb"))
    steps = _edges(samples, value, value).withColumn("d", F.abs(F.col("mine") - F.col("prev")))
    df = steps.groupBy("image_id").agg(F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"), F.count("d").alias("n"))
    n = F.greatest(F.col("n"), F.lit(1))
    mean = F.coalesce("s", F.lit(0)) / n
    df = df.select("image_id", mean.alias("mean_adjacent_delta"), F.greatest(F.lit(0.0), F.coalesce("q", F.lit(0)) / n - mean * mean).alias("delta_variance"))
    return _long(df, ["mean_adjacent_delta", "delta_variance"])


def frequency_evidence(pixels: DataFrame, sizes: DataFrame, max_pixels: int | None = None) -> DataFrame:
    """Laplacian energy of interior pixels and repeated 8x8 block fingerprints, over all pixels.

    With a pixel budget, blocks are visited row by row every ``step`` pixels, step = max(8, stride); the budget ends
    inside the block where the running pixel count reaches it, and counts follow from block geometry alone.
    """
    total = F.col("width").cast("bigint") * F.col("height")
    stride = F.lit(1) if max_pixels is None else F.greatest(F.lit(1), F.floor((total + max_pixels - 1) / max_pixels))
    step = F.greatest(F.lit(8), stride).cast("int")
    df = pixels.join(sizes.select("image_id", "width", "height"), "image_id").withColumn("step", step).withColumn("v", luma(F.col("argb")))
    x, y, w, h, s = (F.col(c) for c in ("x", "y", "width", "height", "step"))
    bx, by = F.floor(x / s).cast("bigint"), F.floor(y / s).cast("bigint")
    df = df.withColumn("bx", bx).withColumn("by", by)
    inside = (x - F.col("bx") * s < 8) & (y - F.col("by") * s < 8)
    # Pixels examined before a block: whole block rows above it, then the blocks to its left.
    cols = F.floor((w - 1) / s).cast("bigint") + 1
    row_width = (cols - 1) * F.least(F.lit(8), s) + F.least(F.lit(8), w - (cols - 1) * s)
    block_h = F.least(F.lit(8), h - F.col("by") * s)
    block_w = F.least(F.lit(8), w - F.col("bx") * s)
    rank = row_width * 8 * F.col("by") + F.col("bx") * 8 * block_h + (y - F.col("by") * s) * block_w + (x - F.col("bx") * s)
    df = df.withColumn("examined", inside if max_pixels is None else inside & (rank < max_pixels))
    interior = (x > 0) & (x + 1 < w) & (y > 0) & (y + 1 < h)
    part = lambda dx, dy, weight, mine: F.struct((x + dx).alias("px"), (y + dy).alias("py"), (F.col("v") * weight).alias("t"), mine.alias("mine"))
    spread = df.select("image_id", F.explode(F.array(
        part(0, 0, 4, F.col("examined") & interior), *[part(dx, dy, -1, F.lit(False)) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    )).alias("c")).select("image_id", "c.*")
    lap = spread.groupBy("image_id", "px", "py").agg(F.sum("t").alias("lap"), F.max("mine").alias("mine")).where("mine")
    energy = lap.groupBy("image_id").agg((F.sum(F.col("lap") * F.col("lap")) / F.count("*")).alias("laplacian_energy"))
    blocks = df.where("examined").groupBy("image_id", "bx", "by").agg(F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"), F.count("*").alias("n"))
    first = F.floor(F.floor(F.col("s1") / F.col("n")) / 8)
    second = F.floor(F.floor(F.col("s2") / F.col("n")) / 64)
    prints = blocks.groupBy("image_id", first.alias("f1"), second.alias("f2")).agg(F.count("*").alias("n"))
    repeats = prints.groupBy("image_id").agg((F.sum(F.col("n") - 1) / F.sum("n")).alias("repeated_block_ratio"), F.sum("n").alias("block_count"))
    out = repeats.join(energy, "image_id", "left").withColumn("laplacian_energy", F.coalesce("laplacian_energy", F.lit(0.0)))
    return _long(out, ["laplacian_energy", "repeated_block_ratio", "block_count"])


# --- fixed values: detectors, with the metric each is scored by ---
DETECTOR_SCORE = {"lsb": "one_ratio", "spatial": "mean_adjacent_delta", "frequency_and_repetition": "laplacian_energy"}


def detector_verdict(metrics: DataFrame, policies: DataFrame) -> DataFrame:
    """Disposition per image and detector. metrics(image_id, detector, metric, value);
    policies(detector, calibration_id, threshold): without a calibration the detector is not run."""
    score = code_map(DETECTOR_SCORE)[F.col("detector")]
    scored = metrics.where(F.col("metric") == score)
    df = scored.join(policies, "detector", "left")
    disposition = (
        F.when(F.col("calibration_id").isNull() | F.col("threshold").isNull(), F.lit("NOT_RUN"))
        .when(F.col("value") >= F.col("threshold"), F.lit("CALIBRATED_THRESHOLD_EXCEEDED"))
        .otherwise(F.lit("EVIDENCE_RECORDED"))
    )
    return df.select("image_id", "detector", disposition.alias("disposition"), F.lit(False).alias("can_certify_absence"))


RECIPES = ("ORIGINAL", "GRAYSCALE", "INVERTED_GRAYSCALE", "ROTATE_CLOCKWISE")


def _view_reject(views: int, max_pixels_per_view: int | None, max_aggregate_pixels: int | None) -> Column:
    total = F.col("width").cast("bigint") * F.col("height")
    out = F.lit(None).cast("string")
    if max_aggregate_pixels is not None:
        out = F.when(total * views > max_aggregate_pixels, F.lit("AGGREGATE_PIXEL_BUDGET")).otherwise(out)
    if max_pixels_per_view is not None:
        out = F.when(total > max_pixels_per_view, F.lit("VIEW_PIXEL_BUDGET")).otherwise(out)
    return out


def pixel_view_rejects(sizes: DataFrame, recipes: tuple[str, ...] = RECIPES, max_pixels_per_view: int | None = None, max_aggregate_pixels: int | None = None) -> DataFrame:
    """(image_id, reason) of the images that :func:`pixel_views` leaves out under the same budgets."""
    return sizes.select("image_id", _view_reject(len(recipes), max_pixels_per_view, max_aggregate_pixels).alias("reason")).where("reason IS NOT NULL")


def pixel_views(pixels: DataFrame, sizes: DataFrame, recipes: tuple[str, ...] = RECIPES, max_pixels_per_view: int | None = None,
                max_aggregate_pixels: int | None = None) -> DataFrame:
    """Pixels of each requested view; under a budget, :func:`pixel_view_rejects` names the images without rows."""
    ok = sizes.where(_view_reject(len(recipes), max_pixels_per_view, max_aggregate_pixels).isNull())
    df = pixels.join(ok.select("image_id", "width", "height"), "image_id")
    grey = luma(F.col("argb"))
    alpha = F.shiftleft(channel(F.col("argb"), 24), 24)
    mono = lambda v: alpha.bitwiseOR(F.shiftleft(v, 16)).bitwiseOR(F.shiftleft(v, 8)).bitwiseOR(v)
    rows = {
        "ORIGINAL": (F.col("x"), F.col("y"), F.col("argb")), "GRAYSCALE": (F.col("x"), F.col("y"), mono(grey)),
        "INVERTED_GRAYSCALE": (F.col("x"), F.col("y"), mono(F.lit(255) - grey)),
        "ROTATE_CLOCKWISE": (F.col("height") - 1 - F.col("y"), F.col("x"), F.col("argb")),
    }
    views = F.array(*[
        F.struct(F.lit(f"ocr-view-{i + 1}").alias("view_id"), F.lit(name).alias("recipe"), rows[name][0].cast("int").alias("x"),
                 rows[name][1].cast("int").alias("y"), rows[name][2].cast("int").alias("argb"))
        for i, name in enumerate(recipes)
    ])
    return df.select("image_id", F.inline(views))


def derivative_pixels(pixels: DataFrame, requests: DataFrame, amplitude: int = 0) -> DataFrame:
    """Opaque pixels, quantised to the approved number of bits, optionally perturbed.

    requests(image_id, acknowledged, warning_matches, retains_pixels, bits, readability_accepted,
    comparison_reviewed); use ``derivative_failures`` for the images that give no rows.
    """
    df = pixels.join(requests.where(_derivative_error().isNull()).select("image_id", "bits"), "image_id")
    keep = F.expr("shiftleft(shiftright(255, 8 - coalesce(bits, 8)), 8 - coalesce(bits, 8))")
    noise = (F.floor(F.rand() * (2 * amplitude + 1)).cast("int") - amplitude) if amplitude else F.lit(0)

    def out(s: int) -> Column:
        value = channel(F.col("argb"), s).bitwiseAND(keep)
        return F.shiftleft(F.greatest(F.lit(0), F.least(F.lit(255), value + noise)), s)

    opaque = F.lit(-16777216)
    return df.select("image_id", "x", "y", opaque.bitwiseOR(out(16)).bitwiseOR(out(8)).bitwiseOR(out(0)).alias("argb"))


def _derivative_error() -> Column:
    return (
        F.when(~(F.col("acknowledged") & F.col("warning_matches")), F.lit("DERIVATIVE_WARNING_NOT_ACKNOWLEDGED"))
        .when(~F.col("retains_pixels"), F.lit("DERIVATIVE_DEPENDENCY_MISSING"))
        .when(F.col("bits").isNotNull() & ~F.coalesce(F.col("readability_accepted") & F.col("comparison_reviewed"), F.lit(False)), F.lit("DERIVATIVE_POLICY_NOT_BENCHMARKED"))
    )


def derivative_failures(requests: DataFrame) -> DataFrame:
    return requests.select("image_id", _derivative_error().alias("error")).where("error IS NOT NULL")
