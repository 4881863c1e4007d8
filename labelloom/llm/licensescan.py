"""License scans by diagonal voting (operator 7), DataFrame functions only.

All k-grams of document words are joined by hash to the k-grams of license templates. A copy
of a template shows as many matches on one diagonal (place in the document minus place in
the template); inserted or lost words move it to a neighbouring one. Votes are counted per
diagonal; the fullest ones gather the neighbouring diagonals, and what they hold counts as
far as it stands in the order of the template, when that is enough of it within a span that
is not much longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.llm.words import TERM, lower_ascii

K = 2
# Base phrases and their labels. Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Usual notices and opening sentences of well-known licenses, and their labels.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
#: Share of a template's k-grams that must be found.
MIN_SHARE = 0.75
#: Diagonals closer than this many words are merged.
NEIGHBOUR = 3
#: Templates may hold this many k-grams in all, since they are sent to every task.
MAX_TEMPLATE_GRAMS = 200_000


def _gram_hashes(words: str, k: int) -> Column:
    """Hashes of the k-grams of a word array column, by their place.

    Shifted arrays are zipped, since a lambda that looked words up in a computed array would
    compute it again for every word.
    """
    size = F.size(words)
    hashes = F.col(words)
    for j in range(1, k):
        hashes = F.zip_with(hashes, F.slice(words, j + 1, F.greatest(size - j, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    if k == 1:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.slice(hashes, 1, F.greatest(size - k + 1, F.lit(0)))


def text_terms(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], phrases: dict[str, str], k: int) -> DataFrame:
    """(hash, template number, place, k-grams in the template, exact, label)."""
    rows = [(t, label, False) for t, label in templates] + [(t, label, True) for t, label in phrases.items()]
    grams = sum(max(len(t.split()) - k + 1, 0) for t, _, _ in rows)
    if grams > MAX_TEMPLATE_GRAMS or any(len(t.split()) < k for t, _, _ in rows):
        raise ValueError(f"templates need {k} words at least, and {MAX_TEMPLATE_GRAMS} k-grams in all at most")
    table = spark.createDataFrame([(i, t, label, exact) for i, (t, label, exact) in enumerate(rows)], "template int, text string, label string, exact boolean")
    words = table.withColumn("words", F.split("text", " ")).withColumn("grams", _gram_hashes("words", k))
    return words.select("template", "label", "exact", F.size("grams").alias("n_grams"), F.posexplode("grams").alias("t_place", "gram"))


def _doc(doc_id: str, text: str) -> list[Column]:
    return [F.col(doc_id).alias("doc"), F.xxhash64(text).alias("body")]


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=None, phrases=None, k: int = K, min_share: float = MIN_SHARE, neighbour: int = NEIGHBOUR) -> DataFrame:
    """Verified places: document, template, label, first and last word, share, exact.

    Documents are told apart by id and text; rows alike in both count once.
    """
    grams = template_grams(docs.sparkSession, TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases, k)
    cut = docs.select(*_doc(doc_id, text), text_terms(F.col(text)).alias("words"))
    placed = cut.select("doc", "body", F.posexplode(_gram_hashes("words", k)).alias("place", "gram"))
    votes = placed.join(F.broadcast(grams), "gram")
    # A bit set of the template's places; repeats of a row add no vote.
    diagonals = votes.groupBy("doc", "body", "template", (F.col("place") - F.col("t_place")).alias("diagonal")).agg(
        F.collect_set("t_place").alias("places"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("n_grams").alias("n_grams")
    )
    exact = diagonals.where(F.col("exact") & (F.size("places") == F.col("n_grams"))).select(
        "doc", "body", "label", "exact", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n_grams") + k - 2).alias("end"), F.lit(1.0).alias("share")
    )
    # Votes are counted first. A copy with ``min_share`` of the k-grams on 2 * neighbour + 1
    # diagonals has at least so many on one of them; of diagonals that close, the fullest count.
    loose = diagonals.where(~F.col("exact")).withColumn("votes", F.size("places"))
    around = W.partitionBy("doc", "body", "template").orderBy("diagonal").rangeBetween(-neighbour, neighbour)
    near = loose.withColumn("most", F.max("votes").over(around)).withColumn("near", F.collect_list(F.struct("diagonal", "places")).over(around))
    enough = F.col("votes") * (2 * neighbour + 1) >= F.col("n_grams") * F.lit(min_share)
    peaks = near.where((F.col("votes") == F.col("most")) & enough)
    # The k-grams near the peak are taken in the order of the template, each at its first place
    # after the one before; what stands in another order does not count.
    matches = F.array_sort(
        F.flatten(F.transform("near", lambda d: F.transform(d["places"], lambda t: F.struct(t.alias("t"), (d["diagonal"] + t).alias("p")))))
    )
    start = F.struct(F.lit(-1).alias("t"), F.lit(-1).alias("p"), F.lit(0).alias("n"), F.lit(-1).alias("first"))

    def follow(held: Column, match: Column) -> Column:
        taken = F.struct(match["t"].alias("t"), match["p"].alias("p"), (held["n"] + 1).alias("n"), F.when(held["n"] == 0, match["p"]).otherwise(held["first"]).alias("first"))
        return F.when((match["t"] > held["t"]) & (match["p"] > held["p"]), taken).otherwise(held)

    chained = peaks.withColumn("chain", F.aggregate(matches, start, follow))
    found = chained.select(
        "doc", "body", "label", "exact", F.col("chain.first").alias("start"), (F.col("chain.p") + k - 1).alias("end"), (F.col("chain.n") / F.col("n_grams")).alias("share"), "n_grams"
    )
    fits = F.col("end") - F.col("start") + 1 <= 2 * (F.col("n_grams") + k - 1)
    verified = found.where((F.col("share") >= min_share) & fits).drop("n_grams")
    return exact.unionByName(verified)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs`` with its license phrases, labels and the best share.

    Null and empty texts have no words and no labels, and score 0. Repeated rows give
    repeated results, null ids stay null, other columns are not read, an empty table gives
    no rows.
    """
    found = spans(docs, doc_id, text, **options)
    place = F.when(F.col("exact"), F.col("start"))
    per_doc = found.groupBy("doc", "body").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        F.collect_set(F.when(F.col("exact"), F.col("label"))).alias("base"), F.collect_set("label").alias("all"), F.max("share").alias("share"),
    )
    base = docs.select(*_doc(doc_id, text), F.coalesce(F.regexp_count(lower_ascii(F.col(text)), F.lit(TERM)), F.lit(0)).cast("long").alias("n_words"))
    right = per_doc.withColumnsRenamed({"doc": "r_doc", "body": "r_body"})
    joined = base.join(right, F.col("doc").eqNullSafe(F.col("r_doc")) & (F.col("body") == F.col("r_body")), "left")

    def names(c: str) -> Column:
        return F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))

    return joined.select(
        F.col("doc").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        names("base").alias("base_labels"), names("all").alias("labels"), F.coalesce("share", F.lit(0.0)).cast("double").alias("score"),
    )
