"""Product codes of vectors with equal-average search (operator 12).

Vectors of integers are cut into equal parts, and each part is told by the number of the
nearest entry of that part's codebook. Codebooks are fitted in rounds: every task assigns its
parts and adds them up by entry, and the sums of all tasks give the next codebooks. The
nearest entry is searched among the entries sorted by the sum of their components, outward
from the part's own sum: as soon as the squared gap between the sums, over the number of
components, is strictly more than the best squared distance, no entry further out can be as
near. All arithmetic is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm import storage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Components are counted in this many steps a unit.
SCALE = 1024
#: Rows searched at a time, so that a batch's arrays stay small.
CHUNK = 8192
#: Points that search together, and entries they look at in a step outward.
GROUP, BLOCK = 512, 16


@dataclass
class Codebooks:
    """For each part its entries, each a list of integers; all parts have as many entries."""

    entries: list[list[list[int]]]

    @property
    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place."""
        listed = ",".join(str(x) for part in self.entries for entry in part for x in entry)
        return hashlib.sha256(listed.encode()).hexdigest()


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component; null where the vector is null or a component
    is null or not finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def nearest(points, entries):
    """Index of the nearest entry of each point and the squared distance.

    Points go together in groups of adjacent sums. A group looks at the entries between its
    sums, and then at blocks of entries further out on each side, as long as some point's
    bound allows it; only such points look at a block. Ties go to the lower index. Both are
    arrays of whole numbers, of a float type where all squares stay exact and of Python
    integers otherwise.
    """
    import numpy as np

    size, width, many = len(points), points.shape[1], len(entries)
    order = np.argsort(entries.sum(axis=1), kind="stable")
    sorted_entries = entries[order]
    sums, squares = sorted_entries.sum(axis=1), (sorted_entries * sorted_entries).sum(axis=1)
    own = points.sum(axis=1)
    by_sum = np.argsort(own, kind="stable")
    best, index = np.empty(size, dtype=points.dtype), np.empty(size, dtype=np.int64)

    for start in range(0, size, GROUP):
        rows = by_sum[start : start + GROUP]
        part, mean = points[rows], own[rows]
        base = (part * part).sum(axis=1)
        near, number = np.full(len(rows), -1, dtype=points.dtype), np.full(len(rows), many, dtype=np.int64)

        def look(which, lo, hi, part=part, base=base, near=near, number=number):
            distance = base[which, None] + squares[lo:hi] - 2 * (part[which] @ sorted_entries[lo:hi].T)
            least = distance.min(axis=1)
            first = np.where((distance == least[:, None]).astype(bool), order[lo:hi], many).min(axis=1)
            known = near[which]
            better = ((known < 0) | (least < known) | ((least == known) & (first < number[which]))).astype(bool)
            near[which[better]], number[which[better]] = least[better], first[better]

        low, high = (int(np.searchsorted(sums, mean[k])) for k in (0, -1))
        low, high = min(low, many - 1), max(high, min(low, many - 1) + 1)
        look(np.arange(len(rows)), low, high)
        up = down = True
        while up or down:
            if up and (up := high < many):
                gap = sums[high] - mean
                which = np.flatnonzero((gap * gap <= near * width).astype(bool))
                if up := bool(which.size):
                    look(which, high, min(high + BLOCK, many))
                    high += BLOCK
            if down and (down := low > 0):
                gap = mean - sums[low - 1]
                which = np.flatnonzero((gap * gap <= near * width).astype(bool))
                if down := bool(which.size):
                    look(which, max(low - BLOCK, 0), low)
                    low -= BLOCK
        best[rows], index[rows] = near, number
    return index, best


def _exact(vectors, width: int, largest: int):
    """``vectors`` in a type in which sums and squares are exact."""
    import numpy as np

    return vectors.astype(np.float64 if (2 * largest * width) ** 2 < 1 << 53 else object)


def _matrix(column: pa.Array, dimension: int):
    """Rows of an Arrow column of equally long lists as a matrix."""
    import numpy as np

    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(values) != len(column) * dimension or (len(column) and set(np.diff(column.offsets.to_numpy())) - {dimension}):
        raise ValueError(f"all vectors need {dimension} components")
    return values.reshape(len(column), dimension)


def _assigned(column: pa.Array, books: list) -> Iterator[tuple]:
    """For each chunk of rows: first row, matrix, and per part the entries and distances."""
    import numpy as np

    parts, width = len(books), len(books[0][0])
    tables = [np.array(book, dtype=object).reshape(len(book), width) for book in books]
    top = max((abs(int(x)) for book in books for entry in book for x in entry), default=0)
    if pa.types.is_large_list(column.type):
        column = column.cast(pa.list_(pa.int64()))
    for start in range(0, len(column), CHUNK):
        block = _matrix(column.slice(start, CHUNK), parts * width)
        largest = max(top, int(np.abs(block).max(initial=0)))
        found = [
            nearest(_exact(block[:, p * width : (p + 1) * width], width, largest), _exact(tables[p], width, largest)) for p in range(parts)
        ]
        yield start, block, found


def _round(rows: DataFrame, books: list) -> list:
    """Codebooks after one round; unused entries stay."""
    parts, size, width = len(books), len(books[0]), len(books[0][0])

    def add_up(batches):
        import numpy as np

        count = np.zeros((parts, size), dtype=np.int64)
        sums = np.zeros((parts, size, width), dtype=np.int64)
        for batch in batches:
            for _, block, found in _assigned(batch.column(0), books):
                for p, (index, _) in enumerate(found):
                    count[p] += np.bincount(index, minlength=size)
                    for j in range(width):
                        sums[p, :, j] += _sum_by(index, block[:, p * width + j], size)
        for p in range(parts):
            used = np.flatnonzero(count[p])
            if used.size:
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([p] * used.size, pa.int32()),
                        "entry": pa.array(used, pa.int32()),
                        "n": pa.array(count[p, used], pa.int64()),
                        "sums": pa.array(sums[p, used].tolist(), pa.list_(pa.int64())),
                    }
                )

    # A task sends one row for each entry it uses, whatever the number of its vectors.
    partial = rows.select("v").mapInArrow(add_up, "part int, entry int, n long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(width)]).alias("sums"))
    new = [list(book) for book in books]
    for row in total.collect():  # at most parts * entries rows
        new[row["part"]][row["entry"]] = [s // row["n"] for s in row["sums"]]
    return new


def _sum_by(index, values, size: int):
    """Exact sums of whole numbers by index."""
    import numpy as np

    if int(np.abs(values).max(initial=0)) * len(values) < 1 << 53:
        return np.bincount(index, weights=values, minlength=size).astype(np.int64)
    out = np.zeros(size, dtype=np.int64)
    np.add.at(out, index, values)
    return out


def prepare(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Stored table of ``vec_id``, ``label`` and the whole-number vector ``v``.

    Rows whose vector is null or holds null or non-finite components are left out. The table
    lies in the shared folder, since every round reads it again.
    """
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole_numbers(F.col(vector)).alias("v"))
    return storage.stored(rows.where(F.col("v").isNotNull()), "vectors")


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks fitted on all rows of ``prepare``.

    They start as the parts of the ``entries`` smallest ids (null ids last, equal ids in the
    order of their vectors). Fewer rows give fewer entries, none give empty codebooks.
    """
    first = [row["v"] for row in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()]
    if not first:
        return Codebooks([[] for _ in range(parts)])
    dimension = len(first[0])
    if dimension % parts or not dimension or any(len(v) != dimension for v in first):
        raise ValueError(f"vectors need one length that {parts} divides")
    width = dimension // parts
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]
    for _ in range(rounds):
        books = _round(rows, books)
    return Codebooks(books)


def encode(rows: DataFrame, codebooks: Codebooks) -> DataFrame:
    """``vec_id, label, codes array<int>, error long`` of each row of ``prepare``.

    ``error`` is the squared distance to the vector that the codes stand for.
    """
    books = codebooks.entries
    kinds = dict(rows.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long"
    if not books[0]:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))

    def assign(batches):
        import numpy as np

        for batch in batches:
            for start, block, found in _assigned(batch.column("v"), books):
                codes = np.stack([index for index, _ in found], axis=1)
                error = sum(distance for _, distance in found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").slice(start, len(block)),
                        batch.column("label").slice(start, len(block)),
                        pa.array(codes.tolist(), pa.list_(pa.int32())),
                        pa.array([int(e) for e in error], pa.int64()),
                    ],
                    ["vec_id", "label", "codes", "error"],
                )

    return rows.select("vec_id", "label", "v").mapInArrow(assign, schema)


def compress(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **sizes) -> tuple[DataFrame, Codebooks]:
    """Codes of every usable vector of ``table`` with the error of its label, and the codebooks.

    Columns: ``vec_id, label, codes, error, label_error``; ``label_error`` adds the errors of
    equal labels, nulls being one label. Repeated rows and ids are coded each; other columns
    are not read, so they may have any name. An empty table, or one without usable vectors,
    gives no rows and empty codebooks. Vectors of different lengths are an error, as are
    values whose squares do not fit 64 bits.
    """
    rows = prepare(table, vec_id, vector, label)
    codebooks = fit(rows, **sizes)
    coded = storage.stored(encode(rows, codebooks), "codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    # Labels with a third of the rows are split by adaptive execution, or the sums are broadcast.
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "label", "codes", "error", "label_error"), codebooks


def reconstruct(coded: DataFrame, codebooks: Codebooks, scale: int = SCALE) -> DataFrame:
    """``coded`` with the vector its codes stand for, in the units of the input."""
    books = codebooks.entries

    @F.arrow_udf("array<double>")
    def joined(codes: pa.Array) -> pa.Array:
        return pa.array([[x / scale for p, code in enumerate(row) for x in books[p][code]] for row in codes.to_pylist()], pa.list_(pa.float64()))

    return coded.withColumn("vector", joined("codes"))
