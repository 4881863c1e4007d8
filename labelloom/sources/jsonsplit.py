"""Elements of large JSON documents, read by many tasks.

A document of one object whose values are lists (COCO, GeoJSON), or of one list, is cut by
Spark's text source into blocks at closing braces, wherever these stand. What a block means
depends on what precedes it: it may begin inside a string, at any depth, in any list. So two
passes are made. The first sums each block up for both cases, inside and outside of a
string: how many open brackets it closes, how many it leaves open, and what stood before the
lowest ones. A fold over these few values per block gives the state at which each block
begins. The second pass knows that state, finds the borders of the elements by depth, and
gives each with the name of its list. Elements that cross blocks come as pieces that are put
together by file and block of their beginning.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.session import stored

#: States sent to all tasks by broadcast, at most; beyond it rows and states meet by shuffle.
BROADCAST_STATES = 200_000
#: Bytes kept of an unfinished string in which a piece of text ends.
KEPT_TAIL = 1 << 16

_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.DOTALL)
_OUT = [("source_file", pa.string()), ("section", pa.string()), ("element", pa.string()), ("first_block", pa.int64()), ("block", pa.int64())]


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """``source_file, block, seq, value``: text between closing braces, in order within a block."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value"
    )


def _marks(data, inside: bool):
    """Places of the brackets outside strings, +1 or -1 for each, and whether the data end
    inside a string. ``data`` begin after a character that is no backslash."""
    import numpy as np

    signs = np.zeros(256, dtype=np.int8)
    signs[[ord("{"), ord("[")]] = 1
    signs[[ord("}"), ord("]")]] = -1
    quote = data == ord('"')
    back = np.flatnonzero(data == ord("\\"))
    if back.size:
        first = np.flatnonzero(np.diff(back, prepend=-2) != 1)  # of each run of backslashes
        length = np.diff(first, append=back.size)
        after = back[first] + length
        after = after[(length % 2 == 1) & (after < data.size)]
        quote[after] = False
    within = (np.cumsum(quote, dtype=np.uint32) & 1).astype(bool) ^ inside
    sign = signs[data]
    at = np.flatnonzero((sign != 0) & ~within)
    return at, sign[at].astype(np.int64), bool(within[-1]) if data.size else inside


def key_of(text: bytes) -> str:
    """Name before a value, given the text from the bracket before up to the value."""
    found = _KEY.search(text)
    return json.loads(b'"' + found.group(1) + b'"') if found else ""


class Summary:
    """What a block does to the brackets open at its beginning, for one of the two cases."""

    def __init__(self, inside: bool):
        self.inside, self.closed, self.opened = inside, 0, 0
        #: Of the two lowest brackets left open: kind, text before, whether the text goes back
        #: beyond the block.
        self.lowest: list[tuple[str, bytes, bool]] = []
        self.tail, self.seen = b"", False

    def add(self, data) -> None:
        import numpy as np

        at, sign, self.inside = _marks(data, self.inside)
        depth = np.cumsum(sign)
        closed = max(0, -int(depth.min(initial=0)))
        left = np.flatnonzero((sign > 0) & (np.minimum.accumulate(depth[::-1])[::-1] >= depth)) if at.size else at
        kept = max(0, self.opened - closed)
        self.closed += max(0, closed - self.opened)
        self.opened, self.lowest = kept + left.size, self.lowest[:kept]
        for k in left[: max(0, 2 - len(self.lowest))].tolist():
            text = bytes(data[at[k - 1] + 1 if k else 0 : at[k]])
            self.lowest.append((chr(data[at[k]]), text if k else self.tail + text, not k and not self.seen))
        rest = bytes(data[at[-1] + 1 :]) if at.size else self.tail + bytes(data)
        self.tail = rest[-KEPT_TAIL:] if self.inside else b""
        self.seen = self.seen or bool(at.size)

    def text(self) -> str:
        lowest = [(kind, before[-KEPT_TAIL:].decode("latin-1"), first) for kind, before, first in self.lowest]
        return json.dumps([self.closed, self.opened, self.inside, self.tail.decode("latin-1"), self.seen, lowest])


#: State at the beginning of a file: inside a string, depth, lowest two open brackets with
#: their names, unfinished text, block in which the open element began.
START = [False, 0, [], "", None]


def advance(state: list, block: int, outside: str, inside: str) -> list:
    """State after a block that began in ``state``."""
    was_inside, depth, lowest, tail, open_block = state
    closed, opened, is_inside, new_tail, seen, found = json.loads(inside if was_inside else outside)
    floor = max(0, depth - closed)
    lowest = lowest[:floor]
    for k, (kind, before, first) in enumerate(found):
        if floor + k == len(lowest) < 2:
            lowest = [*lowest, [kind, key_of(((tail if first else "") + before).encode("latin-1"))]]
    if not seen and is_inside:
        new_tail = (tail + new_tail)[-KEPT_TAIL:]
    depth = floor + opened
    level = 1 if lowest and lowest[0][0] == "[" else 2
    if depth > level and len(lowest) >= level and lowest[level - 1][0] == "[":
        open_block = block if floor <= level else open_block
    else:
        open_block = None
    return [is_inside, depth, lowest, new_tail, open_block]


class Cutter:
    """Elements of one block that begins in a known state."""

    def __init__(self, block: int, state: list):
        self.block = block
        self.inside, self.depth, self.lowest, tail, self.first = state
        self.lowest, self.tail = [tuple(x) for x in self.lowest], tail.encode("latin-1")
        #: Bytes of the element being read, None where there is none.
        self.parts: list[bytes] | None = [] if self.first is not None else None

    def section(self) -> tuple[str, str]:
        """Kind and name of the open container of elements."""
        if self.lowest and self.lowest[0][0] == "[":
            return "[", ""
        return self.lowest[1] if len(self.lowest) > 1 else ("", "")

    def add(self, raw: bytes) -> Iterator[tuple[str, bytes, int | None]]:
        """(section, element, first block) of what is finished within ``raw``."""
        import numpy as np

        data = np.frombuffer(raw, dtype=np.uint8)
        at, sign, self.inside = _marks(data, self.inside)
        after = self.depth + np.cumsum(sign)
        if not self.lowest and at.size:
            self.lowest = [(chr(data[at[0]]), "")]
        level = 1 if self.lowest and self.lowest[0][0] == "[" else 2
        begins = np.flatnonzero((sign > 0) & (after == 2)) if level == 2 else at[:0]
        lists = [self.section()]
        for k in begins.tolist():
            text = raw[at[k - 1] + 1 if k else 0 : at[k]]
            lists.append((chr(data[at[k]]), key_of(text if k else self.tail + text)))
        opens = np.flatnonzero((sign > 0) & (after == level + 1))
        closes = np.flatnonzero((sign < 0) & (after == level))
        owner = np.searchsorted(begins, opens, side="left").tolist()
        starts, ends = at[opens].tolist(), (at[closes] + 1).tolist()
        if self.depth > level:  # what is open ends first, if anything does
            if self.parts is not None:
                self.parts.append(raw[: ends[0]] if ends else raw)
                if ends:
                    yield lists[0][1], b"".join(self.parts), self.first
                    self.parts = None
            ends = ends[1:]
        for k, start in enumerate(starts):
            kind, name = lists[owner[k]]
            if kind == "[":
                if k < len(ends):
                    yield name, raw[start : ends[k]], None
                else:
                    self.parts, self.first = [raw[start:]], None
        if at.size:
            self.depth = max(0, int(after[-1]))
            if begins.size and self.depth >= 2:
                self.lowest = [self.lowest[0], lists[-1]]
            self.lowest = self.lowest[: max(self.depth, 0)]
        rest = raw[at[-1] + 1 :] if at.size else self.tail + raw
        self.tail = rest[-KEPT_TAIL:] if self.inside else b""

    def close(self) -> Iterator[tuple[str, bytes, int | None]]:
        """The piece of an element that goes on in the next block."""
        if self.parts is not None:
            yield self.section()[1], b"".join(self.parts), self.block if self.first is None else self.first


def _by_block(batches, column: int = 2):
    """(keys of the block, raw bytes) of consecutive fragments of one block."""
    for batch in batches:
        values = batch.column(column).cast(pa.large_binary()).to_pylist()
        files, blocks = batch.column(0), batch.column(1).to_pylist()
        start = 0
        while start < len(values):
            end = len(values)
            if blocks[start] != blocks[-1] or files[start].as_py() != files[len(values) - 1].as_py():
                end = start + 1
                name = files[start].as_py()
                while end < len(values) and blocks[end] == blocks[start] and files[end].as_py() == name:
                    end += 1
            yield batch, start, (files[start].as_py(), blocks[start]), b"}".join(values[start:end]) + b"}"
            start = end


def _summaries(batches):
    last, cases = None, ()

    def row():
        values = [[last[0]], [last[1]], [cases[0].text()], [cases[1].text()]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["source_file", "block", "outside", "inside"])

    import numpy as np

    for _, _, key, raw in _by_block(batches):
        if key != last:
            if last is not None:
                yield row()
            last, cases = key, (Summary(False), Summary(True))
        data = np.frombuffer(raw, dtype=np.uint8)
        for case in cases:
            case.add(data)
    if last is not None:
        yield row()


def _states(group: pd.DataFrame) -> pd.DataFrame:
    """State at the beginning of every block of one file."""
    group = group.sort_values("block")
    state, found = START, []
    for block, outside, inside in zip(group["block"], group["outside"], group["inside"], strict=True):
        found.append(json.dumps(state))
        state = advance(state, int(block), outside, inside)
    return pd.DataFrame({"source_file": group["source_file"], "block": group["block"], "state": found})


def _elements(batches):
    last, cutter, rows = None, None, []

    def pack():
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) if t != pa.string() else pa.array(list(c), pa.binary()).cast(pa.string()) for c, (_, t) in zip(zip(*rows, strict=True), _OUT, strict=True)], [n for n, _ in _OUT])

    def keep(found):
        rows.extend((last[0].encode(), name.encode(), element, first, last[1]) for name, element, first in found)

    size = 0
    for batch, start, key, raw in _by_block(batches):
        if key != last:
            if last is not None:
                keep(cutter.close())
            state = batch.column(3)[start].as_py()
            last, cutter = key, Cutter(key[1], json.loads(state) if state else START)
        keep(cutter.add(raw))
        size += len(raw)
        if size > 8 << 20 and rows:
            yield pack()
            rows, size = [], 0
    if last is not None:
        keep(cutter.close())
    if rows:
        yield pack()


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """``source_file, section, element``: every object or list directly inside the lists of
    the documents at ``path``, as text; ``section`` is the name of its list, blank where the
    document itself is the list.

    Numbers and texts that stand directly in such a list are passed over. The result is
    stored in the shared folder, so that each document is parsed once for all its lists.
    """
    pieces = fragments(spark, path)
    schema = "source_file string, block long, outside string, inside string"
    summed = stored(pieces.select("source_file", "block", "value").mapInArrow(_summaries, schema), "json-blocks")
    # A file's blocks are some hundred bytes each, so those of one file fit a task.
    states = summed.groupBy("source_file").applyInPandas(_states, "source_file string, block long, state string")
    states = stored(states.where("block > 0"), "json-states").withColumnsRenamed({"source_file": "_file", "block": "_block"})
    met = (F.col("source_file") == F.col("_file")) & (F.col("block") == F.col("_block"))
    if states.count() <= BROADCAST_STATES:
        rows = pieces.join(F.broadcast(states), met, "left")
    else:
        rows = pieces.join(states, met, "left").repartition("source_file", "block").sortWithinPartitions("source_file", "block", "seq")
    ddl = "source_file string, section string, element string, first_block long, block long"
    found = rows.select("source_file", "block", "value", "state").mapInArrow(_elements, ddl)
    cut = stored(found, "json-elements")
    whole = cut.where("first_block IS NULL").select("source_file", "section", "element")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "element"))), lambda x: x["element"])
    joined = cut.where("first_block IS NOT NULL").groupBy("source_file", "section", "first_block").agg(F.array_join(ordered, "").alias("element"))
    return whole.unionByName(joined.select("source_file", "section", "element"))


def section(elements: DataFrame, name: str, schema: str) -> DataFrame:
    """``source_file`` and the parsed fields of the elements of one list."""
    parsed = elements.where(F.col("section") == name).select("source_file", F.from_json("element", schema).alias("_e"))
    return parsed.select("source_file", "_e.*")


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file at ``path``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.max("length")).first()[0] or 0


def partition_bytes(spark: SparkSession) -> int:
    """``spark.sql.files.maxPartitionBytes`` as a number."""
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
