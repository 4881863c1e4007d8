"""Spelling variants by dynamic programming over a sorted word list (operator 13).

Words within one inserted, deleted or replaced character of each other are found by scanning
sorted lists. The rows of the edit matrix, cut to the band of one edit, are kept for every
depth of the word just read; the next word reuses those of the prefix it shares, for all
query words at once. Where no query is within one edit of a shared prefix, the whole range
of words with that prefix is skipped.

The lists are blocks of the vocabulary. Two near words differ first at some place; places
are cut into ranges, and words that differ first within a range share all before the range
and all after it. So each pair lies in exactly one block. A block with more words than a
task should hold is cut by halving its range, until blocks are small or their words differ
in a single place, of which an alphabet gives only so many.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import storage
from labelloom.llm.words import as_bytes

MIN_LENGTH = 5
MIN_COUNT = 3
#: Every so many of the runs of a document, by their hash, lose a character.
DROP_EVERY = 97
#: A form is met at least so many times as often as the word.
FORM_RATIO = 2
#: Words a block holds before it is cut further.
BLOCK_WORDS = 20_000
#: Distinct words a task counts before it sends them on.
COUNT_AHEAD = 1 << 18
#: Up to so many queries are compared to a lone word directly.
FEW = 24

_RUN = re.compile("[a-zÀ-ÿ]+")


def runs(doc_id: str, text: bytes, drop_every: int = DROP_EVERY) -> Iterator[tuple[str, int]]:
    """Runs of letters of a text, A-Z lower-cased, with their number of occurrences; a run
    loses one character where ``drop_every`` divides the hash of id and run."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, times in Counter(_RUN.findall(text.lower().decode("utf-8", "replace"))).items():
        code = zlib.crc32(run.encode(), start)
        if code % drop_every == 0:
            at = code % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, times


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of all words of at least ``min_length`` characters met ``min_count`` times.

    Tasks count ahead in bounded tables, so frequent words cost a row a task.
    """

    def count(batches):
        def rows(table):
            return pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())], ["word", "n"])

        table: Counter = Counter()
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if body:
                    for word, times in runs(name, body):
                        if len(word) >= min_length:
                            table[word] += times
                    if len(table) >= COUNT_AHEAD:
                        yield rows(table)
                        table.clear()
        if table:
            yield rows(table)

    plain = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("name"), F.col(text).alias("body"))
    counted = plain.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """The block of each row: equal shorter length, range, characters before and after it."""
    after = F.greatest(F.col("shorter") - F.col("end"), F.lit(0))
    size = F.char_length("word")
    return rows.withColumns(
        {
            "key": F.concat_ws(
                " ", F.col("shorter"), F.col("start"), F.col("end"), F.substring("word", F.lit(1), F.col("start")), F.substring("word", size - after + 1, after)
            ),
            "rest": F.substring("word", F.col("start") + 1, size - after - F.col("start")),
        }
    )


def blocks(words: DataFrame, min_length: int = MIN_LENGTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows ``key, rest, width, shorter, word, n``: each word in its blocks.

    Words are met as the shorter (or equal) and as the longer one of a pair. ``rest`` is the
    part of the word that its block does not fix, ``width`` the length of the block's range.
    """
    size = F.char_length("word")
    lengths = F.filter(F.array(size - 1, size), lambda s: s >= min_length)
    half = F.floor(F.col("shorter") / 2).cast("int")
    rows = words.select("word", "n", F.explode(lengths).alias("shorter"))
    ranges = F.array(F.struct(F.lit(0).alias("start"), half.alias("end")), F.struct(half.alias("start"), (F.col("shorter") + 1).alias("end")))
    rows = _keyed(rows.withColumn("range", F.explode(ranges)).select("word", "n", "shorter", "range.start", "range.end"))
    done: DataFrame | None = None
    while True:
        # Grouping needs no rows of a block together: tasks count ahead, one row a key is sent.
        large = storage.stored(rows.groupBy("key").count().where((F.col("count") > block_words)).select("key"), "large-blocks")
        cut = F.col("end") - F.col("start") > 1
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "key", "left_anti").unionByName(rows.join(large, "key", "left_semi").where(~cut))
        done = small if done is None else done.unionByName(small)
        middle = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
        halves = F.array(F.struct(F.col("start"), middle.alias("end")), F.struct(middle.alias("start"), F.col("end")))
        rest = rows.join(large, "key", "left_semi").where(cut).withColumn("range", F.explode(halves))
        rows = storage.stored(_keyed(rest.select("word", "n", "shorter", "range.start", "range.end")), "cut-blocks")
        if rows.isEmpty():
            return done


def one_edit(a: str, b: str) -> int:
    """Place of the one character that tells two words apart; -1 if there is no such one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return -1
    at = 0
    for x, y in zip(a, b):  # noqa: B905 - the longer one may go on
        if x != y:
            break
        at += 1
    return at if a[at + (len(a) == len(b)) :] == b[at + 1 :] else -1


def near_pairs(rests: list[str], shorter: int, width: int):
    """Pairs (query, found) of places in the sorted list ``rests`` that are one edit apart,
    first differ before place ``width``, and of which one at least has length ``shorter``.

    Both orders of a pair are given.
    """
    import numpy as np

    size = len(rests)
    lengths = np.fromiter(map(len, rests), dtype=np.int64, count=size)
    longest = int(lengths.max())
    letters = np.full((longest + 3, size), -1, dtype=np.int32)  # by place, -1 past the end
    for k in np.unique(lengths):
        at = np.flatnonzero(lengths == k)
        if k:
            letters[1 : k + 1, at] = np.frombuffer("".join([rests[i] for i in at]).encode("utf-32-le"), dtype=np.int32).reshape(-1, k).T
    # Shared prefix with the word before; a word that begins the next one shares all of itself.
    differs = letters[1 : longest + 1, 1:] != letters[1 : longest + 1, :-1]
    shared = np.zeros(size + 1, dtype=np.int64)
    shared[1:size] = np.where(differs.any(axis=0), differs.argmax(axis=0), longest) if longest else 0
    shared = np.minimum(shared[:size], lengths).tolist() + [-1]

    queries = np.arange(size)
    zero, one, two = (np.full(size, v, dtype=np.int8) for v in (0, 1, 2))
    # rows[d]: queries within one edit of the first d characters read, and the three cells
    # of row d of their matrices around the diagonal.
    rows = [(queries, two, zero, one)]
    left, right = [], []
    i = 0
    while i < size:
        word = rests[i]
        depth = min(shared[i], len(rows) - 1)
        del rows[depth + 1 :]
        alone = max(shared[i], shared[i + 1])  # deeper prefixes belong to this word only
        dead = False
        while depth < len(word):
            live, low, middle, high = rows[depth]
            if depth >= alone and live.size <= FEW:
                break
            letter = letters[depth + 1, i]
            low = np.minimum(low + (letters[depth, live] != letter), middle + 1) if depth else middle + 1
            above = high
            middle = np.minimum(np.minimum(middle + (letters[depth + 1, live] != letter), above + 1), low + 1)
            high = np.minimum(above + (letters[depth + 2, live] != letter), middle + 1)
            keep = np.flatnonzero(np.minimum(np.minimum(low, middle), high) <= 1)
            rows.append((live[keep], low[keep], middle[keep], high[keep]))
            depth += 1
            if not keep.size:
                dead = True
                break
        if dead:
            # All words that share this prefix are too far from every query.
            i += 1
            while shared[i] >= depth:
                i += 1
            continue
        live, low, middle, high = rows[depth]
        if depth == len(word):
            apart = lengths[live] - depth
            cost = np.where(apart == 0, middle, np.where(apart == 1, high, np.where(apart == -1, low, 2)))
            live = live[cost <= 1]
        if live.size > FEW:
            place = np.full(live.size, -1, dtype=np.int64)
            for k, q in enumerate(live.tolist()):
                place[k] = one_edit(rests[q], word)
            hits = live[(place >= 0) & (place < width) & (np.minimum(lengths[live], len(word)) == shorter)].tolist()
        else:
            hits = [q for q in live.tolist() if 0 <= one_edit(rests[q], word) < width and min(len(rests[q]), len(word)) == shorter]
        left += hits
        right += [i] * len(hits)
        i += 1
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _block_rows(rests: list[str], words: list[str], counts: list[int], width: int):
    """Per word with near ones in the block: their number, and the count and word of the
    most frequent (the smallest one of equals)."""
    import numpy as np

    query, found = near_pairs(rests, min(map(len, rests)), width)
    if not query.size:
        return [], [], [], []
    order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    number = np.bincount(query, minlength=len(words))
    best = np.full(len(words), len(words), dtype=np.int64)
    np.minimum.at(best, query, rank[found])
    with_near = np.flatnonzero(number).tolist()
    chosen = [order[k] for k in best[with_near].tolist()]
    return [words[k] for k in with_near], number[with_near].tolist(), [counts[k] for k in chosen], [words[k] for k in chosen]


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``word, n_near, best_n, best`` for every word that has near ones."""

    def scan(batches):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["word", "n_near", "best_n", "best"]
        out: list[list] = [[], [], [], []]
        block: list[list] = [[], [], []]
        last = None

        def finish():
            if len(block[0]) > 1 and min(map(len, block[0])) == last[1]:
                for column, more in zip(out, _block_rows(*block, last[2]), strict=True):
                    column += more

        for batch in batches:
            for key, rest, least, width, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if last is None or key != last[0]:
                    if last is not None:
                        finish()
                    last, block = (key, least, width), [[], [], []]
                    if len(out[0]) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                        out = [[], [], [], []]
                block[0].append(rest)
                block[1].append(word)
                block[2].append(n)
        if last is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    rows = blocks(words, min_length, block_words)
    fixed = F.col("start") + F.greatest(F.col("shorter") - F.col("end"), F.lit(0))
    listed = rows.select("key", "rest", (F.col("shorter") - fixed).alias("least"), (F.col("end") - F.col("start")).alias("width"), "word", "n")
    found = listed.repartition("key").sortWithinPartitions("key", "rest").mapInArrow(scan, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    total = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return total.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` for links ``word, form`` without cycles: the end of each word's chain.

    Every round doubles the reach; as counts at least double along a chain, a few rounds do.
    """
    reach = storage.stored(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        up = reach.select(F.col("word").alias("_word"), F.col("root").alias("_up"))
        joined = reach.join(up, F.col("root") == F.col("_word"), "left")
        reach = storage.stored(joined.select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "roots")
        if reach.where("moved").isEmpty():
            return reach.select("word", "root")
        reach = reach.drop("moved")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every word of the vocabulary with its near words, its form and the root of its forms.

    Columns ``word, n, n_near, form, form_n, root``. Null and empty texts have no words; a
    null id counts as an empty one. Repeated rows count each. Of equally frequent near words
    the smallest one in code-point order is taken. Only the two named columns are read, so
    others may have any name. An empty table gives no rows.
    """
    words = storage.stored(vocabulary(docs, doc_id, text, min_length, min_count), "words")
    near = near_words(words, min_length, block_words).withColumnRenamed("word", "_word")
    joined = words.join(near, F.col("word") == F.col("_word"), "left")
    has_form = F.col("best_n") >= FORM_RATIO * F.col("n")
    formed = storage.stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n")
        ),
        "variants",
    )
    ends = roots(formed.where(F.col("form").isNotNull())).select(F.col("word").alias("_word"), "root")
    found = formed.join(ends, F.col("word") == F.col("_word"), "left")
    return found.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
