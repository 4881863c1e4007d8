"""Packing (operator 5): length buckets of least padding, batches by token budget.

The histogram of all lengths is one aggregate, of which the driver reads one row for each
different length; d different ones need at least d * d / 2 tokens, so that there are at most
some 100,000 in 5 * 10**9 tokens. Dynamic programming over it finds the boundaries that need
the fewest padding tokens. The best start of the last bucket never falls as the end grows,
so that ends are solved by halves, each within the starts of its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from labelloom.llm.words import WORD

BUCKETS = 16
TOKEN_BUDGET = 16_384
#: Documents that one task numbers within a bucket, on average.
ROWS_PER_RUN = 20_000


def word_tokens(text: Column) -> Column:
    """Blank-separated words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def best_boundaries(lengths: list[int], counts: list[int], totals: list[int], buckets: int = BUCKETS) -> list[int]:
    """Bucket lengths, ascending, that minimise sum of (bucket length - length).

    ``lengths`` ascend; ``totals`` are the summed lengths of each.
    """
    import numpy as np

    if not lengths:
        return []
    size = np.asarray(lengths, dtype=np.float64)
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    tokens = np.concatenate([[0], np.cumsum(totals)]).astype(np.float64)
    n = len(lengths)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        new[0] = 0.0
        spans = [(1, n, 0, n - 1)]
        while spans:  # the last bucket holds lengths i..j-1 and is as long as length j-1
            a, b, first, last = spans.pop()
            j = (a + b) // 2
            i = slice(first, min(last, j - 1) + 1)
            options = cost[i] + size[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
            best = int(np.argmin(options))
            cut[j], new[j] = first + best, options[best]
            spans += [(x, y, f, g) for x, y, f, g in ((a, j - 1, first, cut[j]), (j + 1, b, cut[j], last)) if x <= y]
        cost = new
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(cut[j])
    return ends[::-1]


def boundaries(lengths: DataFrame, n: str, buckets: int = BUCKETS) -> tuple[list[int], int]:
    """Best bucket lengths for a column of lengths, and the number of rows."""
    found = sorted(lengths.groupBy(F.col(n).alias("length")).agg(F.count(F.lit(1)).alias("rows")).collect())
    ends = best_boundaries([r["length"] for r in found], [r["rows"] for r in found], [r["length"] * r["rows"] for r in found], buckets)
    return ends, sum(r["rows"] for r in found)


def pack(docs: DataFrame, doc_id: str = "doc_id", length: Column | None = None, text: str = "text", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: its tokens, bucket, padded length, batch and place.

    Batches hold documents of one bucket in a seeded random order and at most ``budget``
    tokens with padding; a document longer than that is a batch of its own, whole. Null and
    empty texts have 0 tokens and are packed as such; null ids and repeated rows keep their
    rows, and rows that tie in the order are alike, so either order gives the same result.
    An empty table gives no rows. ``length`` may be any column of token counts; without it,
    words are counted. Other columns are not read.
    """
    n = word_tokens(F.col(text)) if length is None else F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), n.alias("n_tokens"))
    ends, total = boundaries(rows, "n_tokens", buckets)
    # The order is a hash; its leading bits cut each bucket into runs that tasks number on
    # their own, and the runs' sizes give each the number it starts from.
    runs = max(1, -(-total // ROWS_PER_RUN))
    steps = F.array(*[F.lit(e) for e in ends]) if ends else F.array().cast("array<long>")
    placed = rows.withColumns(
        {
            "bucket": F.size(F.filter(steps, lambda e: e < F.col("n_tokens"))),
            "_h": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("n_tokens")),
        }
    ).withColumn("_run", F.pmod(F.col("_h"), F.lit(runs)))
    inside = W.partitionBy("bucket", "_run").orderBy("_h", "doc_id", "n_tokens")
    sizes = placed.groupBy("bucket", "_run").agg(F.count(F.lit(1)).alias("_n"))
    start = F.coalesce(F.sum("_n").over(W.partitionBy("bucket").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("bucket", "_run", start.alias("_start"))
    numbered = placed.withColumn("_i", F.row_number().over(inside) - 1).join(offsets, ["bucket", "_run"])
    padded = F.element_at(steps, F.col("bucket") + 1).cast("long")
    per_batch = F.greatest(F.floor(F.lit(budget) / F.greatest(padded, F.lit(1))), F.lit(1))
    place = F.col("_start") + F.col("_i")
    return numbered.select(
        "doc_id",
        "n_tokens",
        F.col("bucket").cast("long").alias("bucket"),
        padded.alias("bucket_tokens"),
        F.floor(place / per_batch).cast("long").alias("batch"),
        (place % per_batch).cast("long").alias("place"),
    )
