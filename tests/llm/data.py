"""Rows that every operator must take: nulls, blanks, repeats, ties, clashing columns."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


LONG = text(99, 30_000)
EDGE = [
    (1, text(1, 80), "en", "a"),
    (2, text(1, 80), "en", "b"),
    (2, text(1, 80), "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \n\t \r\n", "de", "c"),
    (6, "one", "de", "c"),
    (7, "ÀÉ Ünï çödé \x00 \x1f nul", "fr", "d"),
    (8, LONG, "en", "a"),
    (9, text(1, 79) + " changed", "en", "e"),
    (None, text(5, 60), "en", "a"),
    (None, None, None, None),
]
#: Names that operators use within.
CLASHES = "row key doc body line place places n_words kept bucket _h node band grp n_tokens p q f s first clean changed".split()


def edge(spark, rows=EDGE):
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return table.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
