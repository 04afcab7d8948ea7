"""Document fingerprints, how they move when a text is edited, and which other fingerprints lie near.

Terms are two-word runs of the lower-cased text, weighted by their number of bytes and by how often they occur.
Everything here is DataFrame functions.

The edit needs every document beside its successor by id. Documents are dealt into ranges of ids; the first document of
each range also goes to the range before it (the very first to the last range), so a window inside one range sees every
successor and nothing is ever sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlake.llm.common import saved, scratch, space_words, text_of
from normlake.llm.simhash import fingerprint, hex64, likeness, search, votes

WIDTH = 2
RADIUS, BLOCKS = 3, 6
QUERY_EVERY = 20
MOST_RANGES = 4096
_STEP = 64


def _terms(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Keys, ``hash`` and ``weight`` of every term; a text without words has one term of hash and weight 0."""
    df = df.select(*keys, space_words(F.lower(F.col(text))).alias("_w"))
    df = df.select(*keys, "_w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - WIDTH, F.lit(0)))).alias("_i"))
    df = df.select(*keys, F.concat_ws(" ", *[F.get("_w", F.col("_i") + k) for k in range(WIDTH)]).alias("_term"))
    hash_ = F.when(F.col("_term") == "", F.lit(0).cast("long")).otherwise(F.xxhash64("_term"))
    return df.select(*keys, hash_.alias("hash"), F.octet_length("_term").cast("long").alias("weight"))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Keys and ``fp`` of every group of rows with equal keys; with unique keys, of every text (null: empty, fp 0)."""
    plain = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    sums = _terms(plain, keys, "_text").groupBy(*keys).agg(*votes(F.col("weight")))
    return sums.select(*keys, fingerprint().alias("fp"))


def id_ranges(docs: DataFrame, ranges: int) -> Column:
    """Number of the range of doc_id; ranges hold about as many rows each, null ids are in the first."""
    shares = [i / ranges for i in range(1, ranges)]
    ids = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("double").alias("_id"))
    bounds = sorted(set(ids.approxQuantile("_id", shares, 0.25 / ranges))) if shares else []
    own = F.col("doc_id").cast("double")
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(b) for b in bounds[::_STEP]])
    every = F.array(*[F.lit(b) for b in bounds])
    step = F.size(F.filter(steps, lambda b: b <= own))
    inside = F.size(F.filter(F.slice(every, F.greatest(step - 1, F.lit(0)) * _STEP + 1, _STEP), lambda b: b <= own))
    return F.greatest(step - 1, F.lit(0)) * _STEP + inside


def beside_next(docs: DataFrame) -> DataFrame:
    """(_range, _guest, _row, doc_id, text, next_text): every document with the text of the next by id, ties by text.

    Guests are first documents shown again at the end of the range before theirs.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumns({"_range": id_ranges(docs, min(4 * parts, MOST_RANGES)), "_digest": F.xxhash64("text")})
    firsts = rows.groupBy("_range").agg(F.min(F.struct("doc_id", "_digest")).alias("_first"))
    by_range = Window.orderBy("_range")
    firsts = firsts.select("_range", "_first", F.lag("_range").over(by_range).alias("_back"), F.max("_range").over(Window.partitionBy()).alias("_last"))
    # At most MOST_RANGES rows.
    firsts = F.broadcast(firsts.select("_range", "_first", F.coalesce("_back", "_last").alias("_back")))
    rows = rows.join(firsts, "_range", "left")
    leads = rows["doc_id"].eqNullSafe(F.col("_first.doc_id")) & (rows["_digest"] == F.col("_first._digest"))
    seats = F.array(F.struct(F.col("_range"), F.lit(False).alias("guest")), F.struct(F.col("_back").alias("_range"), F.lit(True).alias("guest")))
    seats = F.explode(F.slice(seats, F.lit(1), F.when(leads, F.lit(2)).otherwise(F.lit(1))))
    rows = rows.select("doc_id", "text", "_digest", seats.alias("_seat")).select("doc_id", "text", "_digest", F.col("_seat._range").alias("_range"), F.col("_seat.guest").alias("_guest"))
    order = Window.partitionBy("_range").orderBy("_guest", "doc_id", "_digest")
    return rows.select("_range", "_guest", F.row_number().over(order).alias("_row"), "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness, and how many fingerprints lie near.

    The edited text ends in the beginning of the next document: the last half of its characters is replaced by as many.
    ``near_found`` counts the distinct other fingerprints within 3 bits for ids divisible by 20, found by permuted block
    tables, and is null for other ids. Null texts count as empty; equal rows stand next to each other; null ids come
    first; an only document is its own successor; columns besides doc_id and text are not read.
    """
    folder = scratch(docs.sparkSession)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left(F.coalesce("next_text", F.lit("")), half))
    keys = ["_range", "_guest", "_row", "doc_id", "n_chars", "edited_sha256"]
    rows = beside_next(docs).select("_range", "_guest", "_row", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"))))
    tagged = rows.select(*keys, both.alias("_t")).select(*keys, F.col("_t.kind").alias("_kind"), F.col("_t.text").alias("text"))
    prints = fingerprints(tagged, [*keys, "_kind"])
    pairs = prints.groupBy(*keys).agg(F.max(F.when(F.col("_kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("_kind") == 1, F.col("fp"))).alias("edited_fp"))
    next_fp = F.lead("fp").over(Window.partitionBy("_range").orderBy("_row"))
    pairs = saved(pairs.withColumn("next_fp", next_fp).where(~F.col("_guest")), f"{folder}/prints")

    asked = (F.col("doc_id") % QUERY_EVERY) == 0
    near = search(pairs, pairs.where(asked), RADIUS, BLOCKS).where(F.col("query_fp") != F.col("fp")).groupBy("query_fp").agg(F.count("*").alias("near_found"))
    found = pairs.join(near.withColumnRenamed("query_fp", "fp"), "fp", "left")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", hex64(F.col("fp")).alias("fingerprint"), hex64(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(asked, F.coalesce("near_found", F.lit(0))).alias("near_found"))
