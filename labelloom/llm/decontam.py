"""Benchmark decontamination (operator 1): Wu-Manber search for all windows of test items.

Items come to the tasks in blocks of bounded size. Within a block, windows of ten words (and
items shorter than that) are searched in the normalised text at once: a table over blocks of
a few bytes says how far the search may move on, the last block of a window's first bytes
selects the few windows that may stand here, and a direct comparison confirms them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.words import as_bytes, terms

WINDOW = 10
#: Words of items per block, which bounds what is sent to the tasks at once.
BLOCK_WORDS = 50_000
_TYPE = "n_words long, n_hit long, spans array<int>, items array<string>"


class Matcher:
    """Wu-Manber tables for byte strings that begin and end with a blank."""

    def __init__(self, patterns: dict[bytes, list[int]]):
        self.m = m = min(map(len, patterns))
        # The published rule takes blocks long enough for about 2 m k different ones; four
        # is a low guess of the choices that each further byte of text offers.
        wanted = 2
        while 4**wanted < 2 * m * len(patterns):
            wanted += 1
        self.block = block = max(1, min(wanted, m // 2))
        self.far = m - block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[tuple[bytes, list[int]]]] = defaultdict(list)
        for pattern, owners in patterns.items():
            for end in range(block, m + 1):
                piece = pattern[end - block : end]
                if m - end < self.shift.get(piece, self.far):
                    self.shift[piece] = m - end
            self.buckets[pattern[m - block : m]].append((pattern, owners))

    def find(self, text: bytes) -> Iterator[tuple[int, bytes, list[int]]]:
        m, block, far, shift, buckets = self.m, self.block, self.far, self.shift.get, self.buckets
        end, size = m, len(text)
        while end <= size:
            piece = text[end - block : end]
            step = shift(piece, far)
            if step:
                end += step
                continue
            for pattern, owners in buckets[piece]:
                if text.startswith(pattern, end - m):
                    yield end - m, pattern, owners
            end += 1


def matchers(items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> list[Matcher]:
    """One matcher for full windows and one for items too short to have any."""
    full: dict[bytes, set[int]] = defaultdict(set)
    short: dict[bytes, set[int]] = defaultdict(set)
    for k, (_, words) in enumerate(items):
        if 0 < len(words) < window:
            short[b" " + b" ".join(words) + b" "].add(k)
        for i in range(len(words) - window + 1):
            full[b" " + b" ".join(words[i : i + window]) + b" "].add(k)
    return [Matcher({p: sorted(o) for p, o in group.items()}) for group in (full, short) if group]


def search(text: bytes | None, tables: list[Matcher], spans: list[int] = (), owners: set[int] = frozenset()):
    """(words, hit words, disjoint word spans [start, end) in a row, items) of one document.

    ``spans`` are those found before, by other blocks of items.
    """
    import numpy as np

    words = terms(text)
    body = b" " + b" ".join(words) + b" "
    found = [(at, pattern) for table in tables for at, pattern, who in table.find(body) if owners.update(who) is None] if words else []
    if not found:
        size = sum(spans[1::2]) - sum(spans[::2])
        return len(words), size, list(spans), owners
    blanks = np.flatnonzero(np.frombuffer(body, dtype=np.uint8) == 32)
    first = np.searchsorted(blanks, [at for at, _ in found])
    last = first + [pattern.count(b" ") - 1 for _, pattern in found]
    step = np.zeros(len(words) + 2, dtype=np.int64)
    np.add.at(step, np.concatenate([first, np.asarray(spans[::2], dtype=np.int64)]), 1)
    np.add.at(step, np.concatenate([last, np.asarray(spans[1::2], dtype=np.int64)]), -1)
    hit = np.cumsum(step) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8)))
    return len(words), int(hit.sum()), edges.tolist(), owners


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of at most ``block_words`` words, or of one item that is longer."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in items.toLocalIterator():
        words = terms(row["text"].encode())
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row["item_id"], words))
        size += len(words)
    yield block


def _searcher(spark, block: list[tuple[str, list[bytes]]], window: int):
    """Arrow UDF (text, result of the blocks before) -> result with this block's findings."""
    shared = spark.sparkContext.broadcast(block)
    state: dict = {}

    @F.arrow_udf(_TYPE)
    def find(column: pa.Array, before: pa.Array) -> pa.Array:
        if not state:
            state["names"] = [name for name, _ in shared.value]
            state["tables"] = matchers(shared.value, window)
        names, rows = state["names"], []
        for text, old in zip(as_bytes(column), before.to_pylist()):
            owners: set[int] = set()
            n, hit, spans, _ = search(text, state["tables"], old["spans"], owners)
            rows.append((n, hit, spans, sorted({names[k] for k in owners} | set(old["items"]))))
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.string()))]
        return pa.StructArray.from_arrays(columns, ["n_words", "n_hit", "spans", "items"])

    return find


def occurrences(text: Column, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Column:
    """Struct of word count, hit words, word spans and items for a text column.

    The items pass the driver block by block; each block adds its findings to those before.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")).dropna()
    found = F.from_json(F.lit('{"n_words":0,"n_hit":0,"spans":[],"items":[]}'), _TYPE)
    for block in _blocks(items, block_words):
        found = _searcher(benchmark.sparkSession, block, window)(text, found)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: words, words inside test passages, the passages' word
    spans (flat [start, end) pairs) and the items they come from.

    Null and empty texts have no words and no hits. Items with a null id or text are no
    items; repeated items count once by id. Repeated documents give repeated results. Other
    columns are not read. An empty benchmark hits nothing.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), occurrences(F.col(text), benchmark, **options).alias("f"))
    return rows.select("doc_id", "f.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no test passage."""
    return docs.where(occurrences(F.col(text), benchmark, **options)["n_hit"] == 0)
