"""Line deduplication by spread over sites (operator 3), DataFrame functions only.

A line is boilerplate if it stands on many different sites. Each line hash gathers its sites
in a HyperLogLog sketch, which merges in the map-side aggregate, so a line that a third of
all documents share sends one small row per task. Where the estimate is near the threshold,
and only there, the distinct sites are counted exactly. One copy of each boilerplate line
stays, in the document of the smallest id, so no text is lost altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SITES = 6
#: log2 of the sketch size: 2**10 registers err by 3.3 % (one sigma) above some dozen sites
#: and hardly at all below, where the sketch still lists the hashes.
SKETCH_BITS = 10
#: Estimates within this share of the threshold are counted again.
NEAR = 0.25


def _words(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\f\x0b"))


def _key(doc_id: Column, text: Column) -> Column:
    """What tells documents apart; rows alike in both are treated alike."""
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("h"))


def line_rows(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """One row per line that is not blank: document key, place, hash of the trimmed line, site."""
    lines = docs.select(
        F.col(doc_id).alias("doc"), F.xxhash64(text).alias("body"), F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit(""))).alias("site"),
        F.posexplode(F.transform(F.split(F.col(text), "\n"), _words)).alias("place", "line"),
    )
    return lines.where("line <> ''").select("doc", "body", "site", "place", F.xxhash64("line").alias("line"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """Hashes of lines on at least ``min_sites`` sites, with the first document of each."""
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "body")).alias("first")
    sketched = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("sites"), first)
    sure = sketched.where(F.col("sites") > min_sites * (1 + near))
    unsure = sketched.where(F.col("sites").between(min_sites * (1 - near), min_sites * (1 + near)))
    # Pairs of line and site are distinct after the map-side aggregate, so hot lines count evenly.
    pairs = lines.join(unsure.select("line"), "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("line").agg(F.count("one").alias("exact")).where(F.col("exact") >= min_sites)
    confirmed = unsure.join(exact, "line").select("line", "first")
    return sure.select("line", "first").unionByName(confirmed)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, near: float = NEAR, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``; other columns are unchanged.

    Lines are compared without the blanks around them; blank lines are never touched. A null
    site is one more site. Null texts stay null and empty ones empty. In the document that
    keeps a line, each of its repeats stays too; documents with equal id and text are one
    document here and are treated alike, each as often as it occurs. Null ids come after all
    others. With ``drop_emptied``, documents of which nothing but blanks is left after a
    removal go. An empty table gives no rows.
    """
    packed = docs.select(F.struct("*").alias("row"), _key(F.col(doc_id), F.col(text)).alias("key"))
    gone = removed_places(docs, doc_id, text, site, min_sites, near)
    joined = packed.join(gone.withColumnRenamed("key", "other"), F.col("key").eqNullSafe(F.col("other")), "left")
    whole = F.col(f"row.`{text}`")
    kept = F.filter(F.split(whole, "\n"), lambda line, i: ~F.array_contains("places", i))
    cleaned = F.when(F.col("places").isNull(), whole).otherwise(F.array_join(kept, "\n"))
    result = joined.select("row", F.col("places").isNotNull().alias("changed"), cleaned.alias("clean"))
    if drop_emptied:
        result = result.where(~F.col("changed") | (F.regexp_replace("clean", r"[\x20\x09-\x0D]+", "") != ""))
    return result.select(*[(F.col("clean") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def removed_places(docs: DataFrame, doc_id: str, text: str, site: str, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """Document key and numbers (from 0) of the lines it loses, for documents that lose any."""
    lines = line_rows(docs, doc_id, text, site)
    spread = boilerplate(lines, min_sites, near)
    own = F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.body") == F.col("body"))
    hit = lines.join(spread, "line").where(~own)
    return hit.groupBy(F.struct(F.col("doc").alias("id"), F.col("body").alias("h")).alias("key")).agg(F.collect_set("place").alias("places"))


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Per row of ``docs``: lines that are not blank, lines removed, and the text that stays."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(site).alias("site"))
    packed = base.withColumn("before", F.col("text"))
    clean = dedup_lines(packed, "doc_id", "text", "site", min_sites)

    def count(c: str) -> Column:
        return F.coalesce(F.size(F.filter(F.split(c, "\n"), lambda line: _words(line) != "")), F.lit(0)).cast("long")

    return clean.select("doc_id", count("before").alias("n_lines"), (count("before") - count("text")).alias("n_removed"), "text")
