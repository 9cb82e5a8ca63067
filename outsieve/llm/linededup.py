"""Line dedup by distinct-site spread, in DataFrame functions only.

A line's spread is the number of distinct sites (``source``) that carry it. HyperLogLog
sketches per line hash are built map-side and merged by the aggregation; a line whose
estimate is clearly over the threshold is boilerplate, one clearly under it isn't, and
one whose estimate is near gets an exact distinct count. A boilerplate line stays at its
first place (least document id, then position) and goes everywhere else.

Lines are split at newline and compared after trimming spaces, by a 128-bit hash.
Defined results: blank lines always stay and have no spread; a null site counts as no
site; null text stays null with no lines; rows that repeat an id are told apart by their
text, and such that repeat both count as one document; a null id is the least of all;
text whose lines all go becomes empty. All other columns pass through; text of a changed
row loses those lines with their newlines, and ``n_chars``, where given, follows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keyed, scratch, small_enough

MIN_SITES, MARGIN, LOG_BUCKETS = 8, 0.15, 12


def _hash(line: Column) -> Column:
    return F.when(F.trim(line) != "", F.unhex(F.md5(F.trim(line))))


def _lines(docs: DataFrame, id_col: str, text: str, site: str | None) -> DataFrame:
    document = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("__d")
    keep = [document, *([F.col(site).cast("string").alias("__site")] if site else [])]
    at = docs.select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("__p", "__line"))
    return at.select("__d", *["__site"] * bool(site), "__p", _hash(F.col("__line")).alias("__h")).where("__h is not null")


def boilerplate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(__h, first) of lines on at least ``min_sites`` sites; first is struct (__d, __p), and __d struct (id, h of the text)."""
    lines = _lines(docs, id_col, text, site)
    sketched = lines.groupBy("__h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("__site", F.lit(LOG_BUCKETS))).alias("est"), F.count("__site").alias("n"), F.min(F.struct("__d", "__p")).alias("first"))
    likely = scratch(sketched.where((F.col("n") >= min_sites) & (F.col("est") >= min_sites * (1 - MARGIN))))
    near = likely.where(F.col("est") < min_sites * (1 + MARGIN)).select("__h")
    near_lines = lines.select("__h", "__site").where("__site is not null").join(F.broadcast(near) if small_enough(near, 500_000) else near, "__h", "left_semi")
    exact = near_lines.distinct().groupBy("__h").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("__h")
    clear = likely.where(F.col("est") >= min_sites * (1 + MARGIN))
    return clear.select("__h", "first").unionByName(likely.join(exact, "__h", "left_semi").select("__h", "first"))


def removals(docs: DataFrame, id_col: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(__d, __gone): positions of the lines that go, of documents that lose any."""
    spread = scratch(boilerplate(docs, id_col, text, site, min_sites))
    spread = F.broadcast(spread) if small_enough(spread, 500_000) else spread
    hit = _lines(docs, id_col, text, None).join(spread, "__h").where("struct(__d, __p) <> first")
    return hit.groupBy("__d").agg(F.collect_set("__p").alias("__gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, counts: bool = False) -> DataFrame:
    """``docs`` without boilerplate lines; with ``counts`` also n_lines and n_removed, in place of columns so named."""
    named, d = keyed(docs, id_col, text)
    g = fresh(docs, "__gone")
    gone = removals(docs, id_col, text, site, min_sites).select(F.col("__d").alias(d), F.col("__gone").alias(g))
    out = named.join(gone, d, "left")
    parts = F.split(F.col(text), "\n", -1)
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col(g), i)), "\n")
    new = F.when(F.col(g).isNull(), F.col(text)).otherwise(left)
    more = {}
    if counts:
        more = {"n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long"), "n_removed": F.coalesce(F.size(g), F.lit(0)).cast("long")}
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(g).isNull(), F.col("n_chars")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType)))
    if counts:
        out = out.withColumns(more)
    return out.withColumn(text, new).select(*[c for c in docs.columns if c not in more], *more)
