"""Image files, their sniffed format and fixed-offset header fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normlake.operators.common import code_map

# --- fixed values: format -> canonical MIME type ---
MIME = {
    "PNG": "image/png", "JPEG": "image/jpeg", "GIF": "image/gif", "WEBP": "image/webp", "BMP": "image/bmp", "HEIF": "image/heif",
}


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` as (path, content, length); the claimed type comes from the extension."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "content", "length")


def _hex(content: Column, start: int, n: int) -> Column:
    return F.hex(F.substring(content, start + 1, n))


def _number(content: Column, start: int, n: int, little: bool = False) -> Column:
    digits = _hex(content, start, n)
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))])
    return F.conv(digits, 16, 10).cast("bigint")


def image_headers(images: DataFrame) -> DataFrame:
    """Format by signature, agreement with ``claimed_mime`` and header fields of PNG, GIF and BMP.

    images(path, content, claimed_mime). Only the first bytes of a file are looked at.
    """
    c = F.col("content")
    head = _hex(c, 0, 12)
    fmt = (
        F.when(head.startswith("89504E470D0A1A0A"), F.lit("PNG"))
        .when(head.startswith("FFD8FF"), F.lit("JPEG"))
        .when(head.startswith("474946383761") | head.startswith("474946383961"), F.lit("GIF"))
        .when(head.startswith("52494646") & head.endswith("57454250"), F.lit("WEBP"))
        .when(head.startswith("424D"), F.lit("BMP"))
        .when(F.substring(head, 9, 8) == "66747970", F.lit("HEIF"))
    )
    df = images.withColumn("format", F.when(F.octet_length(c) > 0, fmt))
    is_fmt = lambda f: F.col("format") == f
    colour = _number(c, 25, 1)
    core = _number(c, 14, 4, True) == 12
    signed = lambda v: F.when(v >= 2147483648, F.lit(4294967296) - v).otherwise(v)
    wide = lambda at16, at32: F.when(core, _number(c, at16, 2, True)).otherwise(signed(_number(c, at32, 4, True)))
    png_channels = F.when(colour.isin(0, 3), 1).when(colour == 4, 2).when(colour == 2, 3).when(colour == 6, 4)
    bmp_depth = F.when(core, _number(c, 24, 2, True)).otherwise(_number(c, 28, 2, True))
    width = F.when(is_fmt("PNG"), _number(c, 16, 4)).when(is_fmt("GIF"), _number(c, 6, 2, True)).when(is_fmt("BMP"), wide(18, 18))
    height = F.when(is_fmt("PNG"), _number(c, 20, 4)).when(is_fmt("GIF"), _number(c, 8, 2, True)).when(is_fmt("BMP"), wide(20, 22))
    depth = F.when(is_fmt("PNG"), _number(c, 24, 1)).when(is_fmt("GIF"), F.lit(8)).when(is_fmt("BMP"), bmp_depth)
    channels = F.when(is_fmt("PNG"), png_channels).when(is_fmt("GIF"), F.lit(3)).when(is_fmt("BMP"), F.when(bmp_depth == 32, 4).otherwise(3))
    claimed = F.lower("claimed_mime")
    alias = (is_fmt("JPEG") & (claimed == "image/jpg")) | (is_fmt("HEIF") & claimed.isin("image/heic", "image/heif-sequence"))
    ok = F.when(F.col("claimed_mime").isNotNull() & F.col("format").isNotNull(), (claimed == code_map(MIME)[F.col("format")]) | alias)
    df = df.withColumns({"width": width, "height": height, "bit_depth": depth, "channels": channels, "mime_ok": ok})
    # Allowed depths of the PNG colour types (fixed values of the format).
    png_ok = (
        F.when(colour == 0, F.col("bit_depth").isin(1, 2, 4, 8, 16)).when(colour == 3, F.col("bit_depth").isin(1, 2, 4, 8))
        .when(colour.isin(2, 4, 6), F.col("bit_depth").isin(8, 16)).otherwise(F.lit(False))
    )
    empty_side = F.coalesce((F.col("width") <= 0) | (F.col("height") <= 0), F.lit(False))
    rejection = (
        F.when(F.octet_length(c) == 0, F.lit("EMPTY_SOURCE"))
        .when(F.col("format").isNull(), F.lit("UNSUPPORTED_SIGNATURE"))
        .when((is_fmt("PNG") & ~png_ok) | empty_side, F.lit("INCONSISTENT_HEADER"))
        .when(~F.coalesce("mime_ok", F.lit(True)), F.lit("MIME_SIGNATURE_CONFLICT"))
    )
    return df.select("path", "format", "claimed_mime", "mime_ok", "width", "height", "bit_depth", "channels", rejection.alias("rejection"))
