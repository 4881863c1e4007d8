"""Language identification by rank-order profiles (operator 4).

The most frequent n-grams of each language, in order, are its profile. A document's own most
frequent n-grams are compared to each profile: an n-gram counts as far as it is out of
place, and a missing one the most. Profiles come from the n-gram counts of all learning
documents, which tasks sum in numpy before Spark adds them up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.skew import top_k

PROFILE = 300
NO_LANGUAGE = "und"
#: Profiles are sent to every task, PROFILE entries each.
MAX_LANGUAGES = 20_000
_CHUNK = 1 << 20  # characters counted at once
_FLUSH = 1 << 18  # different n-grams that a task holds before it sends them on


def letter_table():
    """For each code point, itself in lower case if it is a letter, else 0."""
    import numpy as np

    table = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(codes):
    """n-grams of one to three letters as integers; words have a blank (0) on either side,
    and none reaches over two words."""
    import numpy as np

    if not codes.any():
        return np.zeros(0, dtype=np.int64)
    c = np.concatenate([[0], codes, [0]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # one blank between words
    one = c[c != 0]
    two = (c[:-1] << 21) | c[1:]
    three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[c[1:-1] != 0]
    return np.concatenate([one, two, three])


def _codes(text: bytes, table):
    import numpy as np

    return table[np.frombuffer(text.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)]


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) summed within tasks, for a table (lang, text) without nulls."""
    schema = "lang string, gram long, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = letter_table()
        held: dict[str, list] = {}

        def add(lang, codes, n):
            parts = held.setdefault(lang, [])
            parts.append((codes, n))
            if len(parts) == 16 or sum(len(p[0]) for p in parts) > _FLUSH:
                held[lang] = [merge(parts)]

        def merge(parts):
            codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out(lang):
            codes, n = merge(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])

        def pieces(text):  # very long texts in parts, cut at blanks so that no word is split
            at = 0
            while at < len(text):
                end = len(text) if len(text) - at <= _CHUNK else text.find(b" ", at + _CHUNK)
                end = len(text) if end < 0 else end
                yield text[at:end]
                at = end

        for batch in batches:
            group: dict[str, list[bytes]] = {}
            size = 0
            rows = zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist())
            todo = ((lang, piece) for lang, text in rows for piece in pieces(text))

            def work(group):
                for lang, parts in group.items():
                    found = grams(_codes(b" ".join(parts), table))
                    add(lang, *np.unique(found, return_counts=True))

            for lang, piece in todo:
                group.setdefault(lang, []).append(piece)
                size += len(piece)
                if size > _CHUNK:
                    work(group)
                    group, size = {}, 0
            work(group)
            for lang in [x for x, parts in held.items() if sum(len(p[0]) for p in parts) > _FLUSH]:
                yield out(lang)
        for lang in list(held):
            yield out(lang)

    return texts.mapInArrow(count, schema)


def profiles(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): the most frequent n-grams of each language; ties by n-gram."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna()
    summed = gram_counts(rows).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Tasks keep the first of their own n-grams, so a language sends at most ``size`` rows each.
    first = top_k(summed, ["lang"], [F.desc("n"), "gram"], size)
    return first.select("lang", "gram", (F.col("rank") - 1).alias("rank"))


def predictor(profile: DataFrame, size: int = PROFILE):
    """Function of a text column that gives struct<lang_pred, score>.

    The driver reads the profiles, ``size`` rows per language.
    """
    languages = sorted(r["lang"] for r in profile.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; check the language column")
    shared = profile.sparkSession.sparkContext.broadcast((languages, [(r["lang"], r["gram"], r["rank"]) for r in profile.collect()]))
    state: dict = {}

    @F.arrow_udf("lang_pred string, score double")
    def predict(column: pa.Array) -> pa.Array:
        import numpy as np

        if not state:
            names, rows = shared.value
            known = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
            ranks = np.full((len(known) + 1, max(len(names), 1)), -1, dtype=np.int16)
            at = {n: i for i, n in enumerate(names)}
            for name, gram, rank in rows:
                ranks[np.searchsorted(known, gram), at[name]] = rank
            state.update(names=names, known=known, ranks=ranks, table=letter_table())
        names, known, ranks, table = (state[k] for k in ("names", "known", "ranks", "table"))
        labels, scores = [], []
        for text in column.cast(pa.large_binary()).to_pylist():
            found = grams(_codes(text, table)) if text and names else ()
            if not len(found):
                labels.append(NO_LANGUAGE)
                scores.append(0.0)
                continue
            found.sort()
            edge = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            codes, n = found[edge], np.diff(np.append(edge, len(found)))
            top = codes[np.argsort(-n, kind="stable")[:size]]
            spot = np.minimum(np.searchsorted(known, top), len(known) - 1)
            own = ranks[np.where(known[spot] == top, spot, len(known))]
            away = np.where(own < 0, size, np.abs(own - np.arange(len(top))[:, None])).sum(axis=0)
            best = int(np.argmin(away))
            labels.append(names[best])
            scores.append(1.0 - float(away[best]) / (size * len(top)))
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, profile: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: predicted language and how well its profile fits (0 to 1).

    Null texts and texts without a letter give ``und`` and 0, as does every text if there
    are no profiles. Ties go to the first language by name. Repeated rows give repeated
    results, null ids stay null, other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), predictor(profile)(F.col(text)).alias("p"))
    return rows.select("doc_id", "p.*")


def held_out(doc_id: Column) -> Column:
    from labelloom.llm.words import text_crc

    return text_crc(doc_id, 4) == 2
