"""Keyword, category and attribute search over a document table, for many queries at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import config
from labelloom.functions import text
from labelloom.operators.joins import contains_join
from labelloom.operators.skew import salted_join, top_k


def keyword_index(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(token, doc_id): distinct tokens of two or more characters over the given fields."""
    found = F.array_distinct(F.concat(*[F.coalesce(text.tokens(F.col(f)), F.array().cast("array<string>")) for f in fields]))
    return docs.select("doc_id", F.explode(found).alias("token"))


def write_keyword_index(index: DataFrame, table: str, buckets: int = 64) -> None:
    """Store the index bucketed by token, so that later searches join without a shuffle of it."""
    index.write.bucketBy(buckets, "token").sortBy("token").mode("overwrite").saveAsTable(table)


#: Pairs of a query and a document whose scores a task adds up at once, about.
TASK_PAIRS = 1 << 20


def parts_for(docs: DataFrame, queries: DataFrame) -> int:
    """Partitions of documents so that none holds many more than ``TASK_PAIRS`` pairs, since
    a frequent word pairs every document with every query."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-docs.count() * queries.count() // TASK_PAIRS))


def keyword_search(index: DataFrame, queries: DataFrame, limit: int = config.SEARCH_LIMIT, parts: int | None = None) -> DataFrame:
    """Best documents per query. The score is the number of matching query tokens, times
    1 + 1.5 x the share of query tokens that match; ties go to the lower id.

    With ``parts``, the index is dealt by document into as many partitions: the hits of a
    document then stay in its task, and a task's scores grow with its documents only.
    """
    if parts is not None:
        index = index.repartition(parts, "doc_id")
    asked = queries.select("query_id", text.all_tokens(F.col("query")).alias("_t")).where(F.size("_t") > 0)
    wanted = (
        asked.select("query_id", F.size("_t").alias("_len"), F.explode("_t").alias("token"))
        .groupBy("query_id", "_len", "token")
        .agg(F.count(F.lit(1)).alias("_uses"))
    )
    hits = salted_join(index, wanted, ["token"], ["doc_id"])
    scored = hits.groupBy("query_id", "doc_id").agg(
        F.sum("_uses").alias("_s"), F.count(F.lit(1)).alias("matched_tokens"), F.first("_len").alias("_len")
    )
    score = F.col("_s") * (1 + F.col("matched_tokens") / F.col("_len") * config.KEYWORD_BOOST)
    ranked = top_k(scored.withColumn("score", score), ["query_id"], [F.desc("score"), "doc_id"], limit)
    return ranked.select("query_id", "doc_id", "matched_tokens", F.round("score", 6).alias("score"), "rank")


def _needles(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.lower(F.trim("query")).alias("needle")).where("needle <> ''")


def category_search(docs: DataFrame, queries: DataFrame, limit: int = config.SEARCH_LIMIT) -> DataFrame:
    """Documents whose category contains the query: 1.0 when equal, else 0.5.

    Documents of one category score alike, so the first few of each category are enough.
    """
    slim = docs.select("doc_id", F.lower("category").alias("key")).where("key <> ''")
    first = top_k(slim, ["key"], ["doc_id"], limit).drop("rank")
    asked = _needles(queries)
    found = contains_join(asked, "needle", slim.select("key").distinct(), "key")
    hits = asked.join(found, "needle").join(first, "key").withColumn(
        "score", F.when(F.col("key") == F.col("needle"), 1.0).otherwise(0.5)
    )
    return top_k(hits, ["query_id"], [F.desc("score"), "doc_id"], limit).select("query_id", "doc_id", "key", "score", "rank")


def attribute_search(docs: DataFrame, queries: DataFrame, fields: Sequence[str], limit: int = config.SEARCH_LIMIT) -> DataFrame:
    """Documents with an attribute value that contains the query, and the ``field:value``
    found, the first field for a document with several."""
    entries = F.array(
        *[F.struct(F.lit(i).alias("place"), F.lit(f).alias("field"), F.lower(F.col(f)).alias("value")) for i, f in enumerate(fields)]
    )
    values = docs.select("doc_id", F.inline(entries)).where("value <> ''")
    first = top_k(values, ["place", "field", "value"], ["doc_id"], limit).drop("rank")
    asked = _needles(queries)
    found = contains_join(asked, "needle", values.select("value").distinct(), "value")
    hits = (
        asked.join(found, "needle").join(first, "value")
        .groupBy("query_id", "doc_id")
        .agg(F.min(F.struct("place", F.concat_ws(":", "field", "value").alias("key"))).alias("_k"))
        .select("query_id", "doc_id", F.col("_k.key").alias("key"), F.lit(1.0).alias("score"))
    )
    return top_k(hits, ["query_id"], ["doc_id"], limit).select("query_id", "doc_id", "key", "score", "rank")


def hydrate(results: DataFrame, docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The documents behind search results, each once per query, in rank order."""
    once = results.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return once.join(docs.select("doc_id", *columns), "doc_id").orderBy("query_id", "rank")


def retrieve(
    docs: DataFrame, terms: DataFrame, fields: Sequence[str], attributes: Sequence[str], limit: int = config.SEARCH_LIMIT
) -> DataFrame:
    """Documents per query over its expanded terms (query, place, term).

    Each term is searched by keyword, by category where that finds nothing, and else by
    attribute. A document is kept once, at its first term.
    """
    ids = terms.select(F.concat_ws("\u0001", "query", "term").alias("query_id"), F.col("term").alias("query"), F.col("query").alias("_q"), "place")
    asked = ids.select("query_id", "query").distinct()
    index = keyword_index(docs, fields)
    hits = (
        keyword_search(index, asked, limit, parts_for(docs, asked)).select("query_id", "doc_id", "rank", F.lit(1).alias("tier"))
        .unionByName(category_search(docs, asked, limit).select("query_id", "doc_id", "rank", F.lit(2).alias("tier")))
        .unionByName(attribute_search(docs, asked, attributes, limit).select("query_id", "doc_id", "rank", F.lit(3).alias("tier")))
    )
    # At most three times ``limit`` rows per term take part from here on.
    best = hits.groupBy("query_id").agg(F.min("tier").alias("tier"))
    kept = hits.join(best, ["query_id", "tier"]).join(ids.select("query_id", F.col("_q").alias("query"), "place"), "query_id")
    method = F.element_at(F.array(*map(F.lit, ("keyword", "category", "attribute"))), F.col("_f.tier"))
    return (
        kept.groupBy("query", "doc_id")
        .agg(F.min(F.struct("place", "rank", "tier")).alias("_f"))
        .select("query", "doc_id", F.col("_f.place").alias("place"), F.col("_f.rank").alias("rank"), method.alias("method"))
    )


def search_entries(entries: DataFrame, word: str, status: str | None = None, source_type: str | None = None, domain: str | None = None) -> DataFrame:
    """Catalog entries with the word in name, domain, tags or notes, and optional filters."""
    w = word.lower()
    hit = F.lower("name").contains(w) | F.lower("domain").contains(w) | F.lower("notes").contains(w)
    hit = hit | F.exists("tags", lambda t: F.lower(t).contains(w))
    out = entries.where(hit)
    for column, value in (("status", status), ("source_type", source_type), ("domain", domain)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out
