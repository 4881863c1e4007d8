"""Language-model scores by logistic context mixing (operator 8).

A text is its words with A-Z in lower case, one blank between them and an end mark. Each byte
is told by yes-or-no decisions: is it the most frequent one after the two bytes before, is
it the next, and so on for ``NODES`` decisions; what is rarer still is told at once by its
share after the byte before. Every decision is predicted from several contexts (three
and five bytes, and the word so far). The predictions are mixed in the logistic domain by
weights that a gate selects (decision and confidence of the longer contexts) and refined by a
last map from mixed to observed odds. Weights and map start from those of the learning texts
and follow the errors on each text, block by block of ``STEP`` bytes, over its whole length.

Counts come from all learning documents, one entry for each different context, told apart by
60 bits of hash. Texts are kept in groups, as different words and their numbers; each group
asks blocks of the hash range, whose number grows with the input, for the sums of the contexts
and words it holds. The answers are sums alone, in the order of the group's own hashes, which
its words give again. Weights and map are fitted on all learning texts in a few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import storage
from labelloom.llm.words import text_crc

NODES = 6
CONTEXTS = 3
#: Slots, eight a context, where texts are not given a table of their contexts.
SLOT_BITS = 22
#: Bytes worked on at once; longer texts are cut at a blank, and carry their state on.
PIECE = 1 << 16
RUN_BYTES = 1 << 20
#: Bytes of the texts of a group that are scored side by side.
SCORE_BYTES = 1 << 19
#: Bytes, or different places of texts, whose contexts are worked on at once.
PLACE_BYTES = 1 << 17
#: Places that a task of the fit works on at once.
FIT_PLACES = 1 << 14
#: Bytes of a text between adaptations.
STEP = 64
_BUCKETS = 33
#: Rounds of Newton's method for the weights.
ROUNDS = 2
#: Bytes of text for one block of the range of context hashes.
BLOCK_BYTES = 32 << 20
#: A group of documents whose words are counted and looked up together.
GROUP_BYTES, GROUP_DOCUMENTS = 8 << 20, 20_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def cuts(body: bytes) -> Iterator[tuple[int, int]]:
    """Bounds of the pieces of a text."""
    at = 0
    while at < len(body):
        end = len(body) if len(body) - at <= PIECE else body.rfind(b" ", at, at + PIECE) + 1
        end = min(at + PIECE, len(body)) if end <= at else end
        yield at, end
        at = end


def pieces(body: bytes) -> Iterator[tuple[bytes, tuple]]:
    """Parts of a text, each with its lead: the bytes before, and hash and power of the word
    that it begins within."""
    word, power = 0, 1
    for at, end in cuts(body):
        yield body[at:end], ((_PAD + body[max(0, at - len(_PAD)) : at])[-len(_PAD) :], word, power)
        if body[end - 1 : end] == b" ":
            word, power = 0, 1
        else:
            more, by = _word_hash(body[body.rfind(b" ", at, end) + 1 if b" " in body[at:end] else at : end])
            word, power = ((word + power * more) & _MASK, power * by & _MASK) if b" " not in body[at:end] else (more, by)


def runs(texts: list[bytes], most: int = RUN_BYTES) -> Iterator[tuple[list[int], list[bytes], list[tuple]]]:
    """Pieces of texts in runs of about ``most`` bytes, with the numbers of their texts and
    their leads. A run holds no two pieces of one text."""
    owner, parts, leads, size = [], [], [], 0
    for i, text in enumerate(texts):
        for part, lead in pieces(text):
            if parts and (size >= most or owner[-1] == i):
                yield owner, parts, leads
                owner, parts, leads, size = [], [], [], 0
            owner.append(i)
            parts.append(part)
            leads.append(lead)
            size += len(part)
    if parts:
        yield owner, parts, leads


_POWERS: dict[int, tuple] = {}
_BASE = 0x9E3779B97F4A7C15
_MIX = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_PAD = b"      "


def _powers(n: int):
    """Powers of an odd number and of its inverse modulo 2**64."""
    import numpy as np

    if not _POWERS or max(_POWERS) < n:
        size = max(n, 2 * RUN_BYTES)
        up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, x, dtype=np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        _POWERS.clear()
        _POWERS[size] = up, down
    up, down = next(iter(_POWERS.values()))
    return up[:n], down[:n]


def _word_hash(word: bytes) -> tuple[int, int]:
    """Polynomial hash of the bytes of a word, and the power that follows its last."""
    import numpy as np

    up, _ = _powers(len(word) + 1)
    return int(((np.frombuffer(word, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * up[:-1]).sum(dtype=np.uint64)), int(up[-1])


def _hash(context, kind: int):
    import numpy as np

    h = (context + np.uint64(kind + 1)) * np.uint64(_MIX)
    h = (h ^ h >> np.uint64(32)) * np.uint64(_MIX)
    return h ^ h >> np.uint64(32)


class Run:
    """Bytes and contexts of concatenated pieces. Pieces without lead begin after blanks."""

    def __init__(self, parts: list[bytes], ranks=None, leads: list[tuple] | None = None, table: Table | None = None, hashed: bool = False):
        import numpy as np

        leads = leads or [(_PAD, 0, 1)] * len(parts)
        data = np.frombuffer(b"".join(x for (pad, _, _), part in zip(leads, parts) for x in (pad, part)), dtype=np.uint8)
        self.sizes = sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        ends = np.cumsum(sizes + len(_PAD))
        mark = np.zeros(len(data) + 1, dtype=np.int8)
        mark[ends - sizes] += 1
        mark[ends] -= 1
        own = np.cumsum(mark[:-1]).astype(bool)
        self.ends = np.cumsum(sizes)
        self.byte = data[own]
        one = np.concatenate([[32], data[:-1]]).astype(np.uint8)
        two = np.concatenate([[32], one[:-1]]).astype(np.uint16) << 8 | one
        self.two = two[own]
        if ranks is not None:
            self.rank = ranks.ravel()[self.two.astype(np.int32) << 8 | self.byte]
            self.level = np.minimum(self.rank, NODES)
        elif not hashed:
            return
        wide = data.astype(np.uint64)
        three, five = two.astype(np.uint64), None
        for j in (3, 4, 5):
            old = np.zeros(len(data), dtype=np.uint64)
            old[j:] = wide[:-j]
            if j == 3:
                three |= old << np.uint64(16)
                five = three.copy()
            else:
                five |= old << np.uint64(8 * (j - 1))
        # Polynomial hash of the word so far: a difference of running sums, brought to a
        # common power by the inverse. A word that began before its piece goes on from the lead.
        n = len(data)
        up, down = _powers(n)
        total = np.cumsum((wide + np.uint64(1)) * up, dtype=np.uint64)
        before = np.concatenate([np.zeros(1, dtype=np.uint64), total[:-1]])
        fresh = one == 32
        fresh[ends - sizes] = True
        begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        word = (before - before[begin]) * down[begin]
        for i, (_, old, power) in enumerate(leads):
            if power != 1:
                first = ends[i] - sizes[i]
                inside = slice(first, first + int(np.searchsorted(begin[first : ends[i]], first, side="right")))
                word[inside] = np.uint64(old) + np.uint64(power) * word[inside]
        self.hashes = [_hash(c[own], k) for k, c in enumerate((three, five, word))]
        self.contexts = [h >> np.uint64(64 - SLOT_BITS + 3) if table is None else table.find(h) for h in self.hashes] if ranks is not None else []
        self.contexts = [c.astype(np.int32) for c in self.contexts]


class Table:
    """Ascending context hashes (60 bits) of a group of texts, found by their leading bits."""

    def __init__(self, keys):
        import numpy as np

        self.keys = keys
        self.shift = np.uint64(60 - max(1, len(keys).bit_length()))
        self.start = np.searchsorted(keys, np.arange(1 << 60 - int(self.shift), dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, hashes):
        """Places of hashes, all of which are in the table."""
        import numpy as np

        h = hashes >> np.uint64(4)
        at = self.start.take(h >> self.shift)
        left = np.flatnonzero(self.keys.take(at) != h)
        while len(left):
            at[left] += 1
            left = left[self.keys.take(at[left]) != h[left]]
        return at


#: Places of a word, counted from 0, at which five bytes reach back beyond the blank before it.
_NEAR = 4
#: Number of the end mark among the words of a group.
END = 0


class Words:
    """The different words of a group, each with the blank or end mark that follows, and the
    different places of its texts.

    A place is told by five bytes and the next one at the first places of a word, and by the
    word alone further on, so that bytes are worked on once per different word. The different
    codes of the first places are kept with the texts.
    """

    def __init__(self, packed: dict):
        import numpy as np

        self.packed = packed
        buf = np.frombuffer(pa.decompress(packed["words"], packed["size"], "zstd", asbytes=True) + b" ", dtype=np.uint8)
        ends = np.flatnonzero(buf == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        self.words, self.n_words, self.empty = buf, len(ends), np.flatnonzero(starts == ends)
        # Words that end a text are words of their own.
        self.final = final = np.frombuffer(packed["final"], dtype=np.int32)
        lengths = ends[final] + 1 - starts[final]
        more = buf[np.repeat(starts[final] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
        more[np.cumsum(lengths) - 1] = 10
        self.buf = np.concatenate([buf, more])
        self.starts = np.concatenate([starts, len(buf) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([ends + 1 - starts, lengths])

    def times(self):
        """How often each word is in the learning texts."""
        return _counts(self.packed["times"], 1)[:, 0]

    def learned(self, texts: int):
        """The same by words alone, where the end mark is that of each of so many texts."""
        import numpy as np

        times = self.times()
        n = times[: self.n_words].copy()
        np.add.at(n, self.final, times[self.n_words :])
        n[self.empty], n[END] = 0, texts
        return n

    def triples(self):
        """(two bytes before, byte) in the learning texts, and how often they are there."""
        import numpy as np

        word = np.repeat(np.arange(len(self.starts)), self.lengths)
        at = np.flatnonzero(np.arange(len(self.buf)) > self.starts[word])
        word = word[at]
        two = np.where(at - 1 > self.starts[word], self.buf[at - 2], 32).astype(np.int64) << 8 | self.buf[at - 1]
        # At the first place of a word the codes tell.
        code = np.concatenate([two << 8 | self.buf[at], (_unpacked(self.packed["codes"][0]) & np.uint64(0xFFFFFF)).astype(np.int64)])
        n = np.concatenate([self.times()[word], _counts(self.packed["code_times"][0], 1)[:, 0]])
        both = (code << 38 | n).astype(np.uint64)
        both.sort()
        code, n = (both >> np.uint64(38)).astype(np.int64), (both & np.uint64((1 << 38) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        code, n = code[first], np.add.reduceat(n, first)
        return code[n > 0], n[n > 0]

    def far(self):
        """Places in ``buf`` beyond the first ones of words, and the word of each."""
        import numpy as np

        left = np.maximum(self.lengths - _NEAR, 0)
        word = np.repeat(np.arange(len(left)), left)
        return np.repeat(self.starts + _NEAR - (np.cumsum(left) - left), left) + np.arange(len(word)), word

    def places(self, ranks=None):
        """The different places: numbers in learning texts, levels, hashes of the contexts, code
        of three bytes, and codes that find the first places of words again."""
        import numpy as np

        codes = [_unpacked(c) for c in self.packed["codes"]]
        times = [_counts(t, 1)[:, 0] for t in self.packed["code_times"]]
        words = []
        for p, code in enumerate(codes):
            word = np.zeros(len(code), dtype=np.uint64)
            for j in range(p):
                word += ((code >> np.uint64(8 * (p - j)) & np.uint64(255)) + np.uint64(1)) * np.uint64(pow(_BASE, j, 1 << 64))
            words.append(word)
        near = np.concatenate(codes)
        at, owner = self.far()
        n = self.times()[owner]
        inner = at - self.starts[owner]
        wide = self.buf.astype(np.uint64)
        five = np.zeros(len(wide), dtype=np.uint64)
        for j in range(5):
            five[j + 1 :] |= wide[: max(0, len(wide) - j - 1)] << np.uint64(8 * j)
        five = five[at]
        border = inner == _NEAR
        five[border] = five[border] & np.uint64(0xFFFFFFFF) | np.uint64(32 << 32)
        # Hash of each word so far: the first bytes are summed up apart, as words are many.
        power = np.uint64(1)
        so_far = np.zeros(len(self.starts), dtype=np.uint64)
        for j in range(_NEAR):
            so_far += np.where(self.lengths > j, self.buf[np.minimum(self.starts + j, len(self.buf) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0)) * power
            power = np.uint64(int(power) * _BASE & _MASK)
        up, _ = _powers(int(inner.max(initial=0)) + 1)
        step = (self.buf[at].astype(np.uint64) + np.uint64(1)) * up[inner]
        total = np.cumsum(step, dtype=np.uint64) - step
        begin = np.flatnonzero(inner == _NEAR)
        word = so_far[owner] + total - np.repeat(total[begin], np.diff(np.append(begin, len(at))))
        key = (word * np.uint64(_MIX) ^ self.buf[at].astype(np.uint64)) * np.uint64(_BASE)
        table = Table(_ascending(key >> np.uint64(4)))
        found = table.find(key)
        some = np.empty(len(table.keys), dtype=np.int64)
        some[found] = np.arange(len(at))
        times.append(np.bincount(found, n, minlength=len(some)).astype(np.int64))
        found += len(near)
        words.append(word[some])
        code = np.concatenate([near, five[some] << np.uint64(8) | self.buf[at[some]].astype(np.uint64)])
        five = code >> np.uint64(8)
        self.byte_place = np.zeros(len(self.buf), dtype=np.int32)
        self.byte_place[at] = found
        triple = (code & np.uint64(0xFFFFFF)).astype(np.int64)
        level = None if ranks is None else np.minimum(ranks.ravel()[triple], NODES)
        hashes = [_hash(c, k) for k, c in enumerate((five & np.uint64(0xFFFFFF), five, np.concatenate(words)))]
        return np.concatenate(times), level, hashes, triple, near


class Group(Words):
    """Texts of a group as numbers of its words."""

    def __init__(self, packed: dict):
        import numpy as np

        super().__init__(packed)
        self.n_tokens = np.array(packed["n_tokens"], dtype=np.int64)
        # A text without words is an empty word and the end mark.
        units = np.maximum(self.n_tokens - 1, 1)
        self.last = np.cumsum(units) - 1
        self.doc = np.repeat(np.arange(len(units), dtype=np.int32), units)
        n = len(self.doc)
        planes = np.frombuffer(pa.decompress(packed["ids"], 4 * n, "zstd", asbytes=True), dtype=np.uint8).reshape(4, n)
        self.tokens = np.ascontiguousarray(planes.T).view(np.int32).ravel()
        self.ids = self.tokens.copy()
        self.ids[self.last] = self.n_words + np.searchsorted(self.final, self.tokens[self.last])
        self.sizes = np.add.reduceat(self.lengths[self.ids], self.last - units + 1)
        # The first bytes of each word, and the number of its first places.
        padded = np.concatenate([self.buf, np.zeros(_NEAR, dtype=np.uint8)]).astype(np.uint64)
        self.heads = [padded[self.starts]]
        for p in range(1, _NEAR):
            self.heads.append(self.heads[-1] << np.uint64(8) | padded[self.starts + p])
        self.near_places = np.minimum(self.lengths, _NEAR).astype(np.uint8)[self.ids]

    def tails(self):
        """The four bytes before the blank before each word of the texts."""
        import numpy as np

        last4 = np.zeros(len(self.starts), dtype=np.uint64)
        for j in range(4):
            held = self.lengths - 1 > j
            last4[held] |= self.buf[(self.starts + self.lengths - 2 - j)[held]].astype(np.uint64) << np.uint64(8 * j)
        first = np.zeros(len(self.ids), dtype=bool)
        first[0] = True
        first[self.last[:-1] + 1] = True
        blanks, low = np.uint64(0x20202020), np.uint64(0xFFFFFFFF)
        own = last4[self.ids]
        size = self.lengths[self.ids] - 1
        short = np.flatnonzero(size < 4)
        shift, base = (8 * size[short]).astype(np.uint64), own[short]
        before = np.where(first[short], 0, short - 1)
        begins = first[short]
        # Two short words and their blanks are four bytes.
        for _ in range(3):
            own[short] = base | (np.where(begins, blanks, np.uint64(32) | own[before] << np.uint64(8)) << shift & low)
        tail = np.empty_like(own)
        tail[1:] = own[:-1]
        tail[first] = blanks
        return tail

    def near(self, tails, p: int, a: int = 0, b: int | None = None):
        """Numbers of the words of the texts, from ``a`` to ``b``, that have a place p, and
        their codes there: the five bytes before and the byte."""
        import numpy as np

        held = np.flatnonzero(self.near_places[a:b] > p)
        if a:
            held += a
        code = tails.take(held)
        code <<= np.uint64(8)
        code |= np.uint64(32)
        code <<= np.uint64(8 * (p + 1))
        code |= self.heads[p].take(self.ids.take(held))
        code &= np.uint64((1 << 48) - 1)
        return held, code

    def counted(self, trains) -> dict:
        """Fields to keep: the different codes at each of the first places of words, ascending,
        and how often they, and the words, are in the learning texts."""
        import numpy as np

        tails, learned = self.tails(), np.asarray(trains, dtype=bool)[self.doc]
        words = np.bincount(self.ids, learned, minlength=len(self.starts)).astype(np.int64)
        out = {"times": _packed_counts(words[:, None]), "codes": [], "code_times": []}
        for p in range(_NEAR):
            held, code = self.near(tails, p)
            code = code << np.uint64(1) | learned[held]
            code.sort()
            mark = (code & np.uint64(1)).astype(np.int64)
            code >>= np.uint64(1)
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, dtype=np.int64)
            times = np.add.reduceat(mark, first) if len(first) else mark
            out["codes"].append(_packed(code[first]))
            out["code_times"].append(_packed_counts(times[:, None]))
        return out

    def place_finder(self, near, tails):
        """``find(a, b)``: the place of every byte of the words of the texts from a to b."""
        import numpy as np

        mixed = near * np.uint64(_MIX)
        order = np.argsort(mixed)
        table = Table(mixed[order] >> np.uint64(4))
        order = order.astype(np.int32)

        def find(a: int, b: int):
            ids = self.ids[a:b]
            lengths = self.lengths[ids]
            begin = np.cumsum(lengths) - lengths
            out = self.byte_place[np.repeat(self.starts[ids] - begin, lengths) + np.arange(lengths.sum())]
            for p in range(_NEAR):
                held, code = self.near(tails, p, a, b)
                if len(held):
                    out[begin[held - a] + p] = order[table.find(code * np.uint64(_MIX))]
            return out

        return find

    def base(self, found: list[dict], train_tokens: int, vocabulary: int):
        """Log10 probability of each text by the counts of its words, and its known words."""
        import numpy as np

        c = np.empty(self.n_words, dtype=np.int64)
        c[np.argsort(_word_hashes(self.words), kind="stable")] = np.concatenate([_counts(f["learned"], 1)[:, 0] for f in found])
        share = np.log10((c + 1) / (train_tokens + vocabulary + 1))
        worded, n = (self.n_tokens > 1)[self.doc], len(self.n_tokens)
        base = np.bincount(self.doc, share[self.tokens] * worded, minlength=n) + share[END]
        return base, np.bincount(self.doc, (c > 0)[self.tokens] & worded, minlength=n).astype(np.int64) + int(c[END] > 0)

    def body(self, doc: int) -> bytes:
        first = self.last[doc] - max(self.n_tokens[doc] - 1, 1) + 1
        return b"".join(self.buf[s : s + n].tobytes() for s, n in zip(self.starts[self.ids[first : self.last[doc] + 1]], self.lengths[self.ids[first : self.last[doc] + 1]]))


def byte_triples(groups: DataFrame) -> DataFrame:
    """(two bytes before, byte, n) over the learning texts of groups."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            codes, n = Words(row["packed"]).triples()
            yield pa.RecordBatch.from_arrays([pa.array(codes >> 8, pa.int32()), pa.array(codes & 255, pa.int32()), pa.array(n, pa.int64())], ["two", "byte", "n"])

    return groups.select(_without_texts(F.col("packed"))).mapInArrow(count, "two int, byte int, n long").groupBy("two", "byte").agg(F.sum("n").alias("n"))


def _without_texts(packed: Column) -> Column:
    """What is kept of a group, without the texts themselves."""
    return F.struct(*[packed[f].alias(f) for f in ("size", "words", "final", "times", "codes", "code_times")]).alias("packed")


def _shared(df: DataFrame, ranks):
    """Ranks for all tasks, compressed as each executor keeps them on disk."""
    return df.sparkSession.sparkContext.broadcast(pa.compress(ranks.tobytes(), "zstd", asbytes=True))


_RANKS: list[tuple] = []


def _ranks(shared):
    """Ranks from ``_shared``; a worker keeps the last ones."""
    import numpy as np

    if not _RANKS or _RANKS[0][0] != shared.value:
        _RANKS[:] = [(shared.value, np.frombuffer(pa.decompress(shared.value, 1 << 24, "zstd", asbytes=True), dtype=np.uint8).reshape(65536, 256))]
    return _RANKS[0][1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches, one at a time: a group of texts is large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def rank_tables(triples: DataFrame):
    """Ranks of bytes after two bytes, and log2 shares of bytes of rank NODES or more after one.

    The driver reads at most 2**24 counts, whatever the input.
    """
    import numpy as np

    found = triples.toArrow()
    counts = np.zeros((65536, 256), dtype=np.int64)
    counts[found.column("two").to_numpy(), found.column("byte").to_numpy()] = found.column("n").to_numpy()
    # Contexts not seen rank bytes as the byte before does.
    one = counts.reshape(256, 256, 256).sum(axis=0)
    ranks = np.empty((65536, 256), dtype=np.uint8)
    for two in range(0, 65536, 256):
        keys = counts[two : two + 256].astype(np.float64) + one / (one.sum(axis=1, keepdims=True) + 1.0) * 0.5
        order = np.argsort(-keys, axis=1, kind="stable")
        np.put_along_axis(ranks[two : two + 256], order, np.arange(256, dtype=np.uint8)[None, :], 1)
    # What is left after the decisions: one plus the counts after the byte before, among the
    # bytes that the context leaves.
    rest = one.astype(np.float64) + 1.0
    top = np.zeros(65536)
    for two in range(0, 65536, 256):
        top[two : two + 256] = np.where(ranks[two : two + 256] < NODES, rest, 0.0).sum(axis=1)
    return ranks, np.log2(rest), np.log2(rest.sum(axis=1)[np.arange(65536) & 255] - top)


def _ascending(keys):
    """Distinct keys, ascending."""
    import numpy as np

    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def context_counts(groups: DataFrame, ranks, blocks: int) -> DataFrame:
    """(grp, block, counts, learned, vocabulary): for the contexts of each group's texts, by
    ascending hash, how often each rank follows them in all learning texts; how often its words
    are in them; and, once a block, the number of different words that are."""
    shared = _shared(groups, ranks)
    bits = (blocks - 1).bit_length()
    names, types = ["grp", "block", "keys", "counts", "words", "learned"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def bounds(keys, width):
        import numpy as np

        return np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits)).tolist() + [len(keys)] if bits else [0, len(keys)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for row in _rows(batches):
            group = Words(row["packed"])
            n, levels, hashes, _, _ = group.places(_ranks(shared))
            context = _ascending(np.concatenate(hashes) >> np.uint64(4))
            table, counts = Table(context), np.zeros(len(context) * (NODES + 1), dtype=np.int64)
            for h in hashes:
                np.add.at(counts, table.find(h).astype(np.int64) * (NODES + 1) + levels, n)
            counts = counts.reshape(-1, NODES + 1)
            words, learned = _word_hashes(group.words), group.learned(sum(row["trains"]))
            order = np.argsort(words, kind="stable")
            words, learned = words[order], learned[order]
            at, by = bounds(context, 60), bounds(words, 64)
            rows = [
                [row["grp"], b, _packed(context[i:j]), _packed_counts(counts[i:j]), _packed(words[k:m]), _packed_counts(learned[k:m, None])]
                for b, (i, j, k, m) in enumerate(zip(at, at[1:], by, by[1:]))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def sums(keys: pa.ChunkedArray, counts: pa.ChunkedArray, columns: int):
        """The sums of counts over equal keys, packed, for each list of keys; and how many keys
        have any. Counts are unpacked one list at a time."""
        import numpy as np

        every = [_unpacked(k.as_py()) for k in keys]
        ends = np.cumsum([len(k) for k in every]).tolist()
        every = np.concatenate(every)
        held = _ascending(every)
        total = np.zeros((len(held), columns), dtype=np.int64)
        starts = [0, *ends[:-1]]
        for c, start, end in zip(counts, starts, ends):
            # Keys of one list may be equal only where two words share their hash.
            np.add.at(total, np.searchsorted(held, every[start:end]), _counts(c.as_py(), columns))
        return [_packed_counts(total[np.searchsorted(held, every[start:end])]) for start, end in zip(starts, ends)], int((total > 0).any(axis=1).sum())

    def total(part: pa.Table) -> pa.Table:
        counts, _ = sums(part["keys"], part["counts"], NODES + 1)
        learned, held = sums(part["words"], part["learned"], 1)
        return pa.table({"grp": part["grp"], "block": part["block"], "counts": pa.array(counts, pa.binary()), "learned": pa.array(learned, pa.binary()), "vocabulary": pa.array([held] + [0] * (len(part) - 1), pa.int64())})

    sent = groups.select("grp", "trains", _without_texts(F.col("packed"))).mapInArrow(count, "grp long, block int, keys binary, counts binary, words binary, learned binary")
    return sent.groupBy("block").applyInArrow(total, "grp long, block int, counts binary, learned binary, vocabulary long")


def _word_hashes(words):
    """Hashes of words that a blank ends each."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words.tobytes()[:-1].split(b" ")], dtype=np.uint64)


def _packed(keys) -> bytes:
    """Ascending hashes as the bytes of their steps, one place after the other."""
    import numpy as np

    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return len(keys).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(steps.T), "zstd", asbytes=True)


def _unpacked(data: bytes):
    import numpy as np

    n = int.from_bytes(data[:4], "little")
    steps = np.frombuffer(pa.decompress(data[4:], 8 * n, "zstd", asbytes=True), dtype=np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(steps.T).view(np.uint64).ravel(), dtype=np.uint64)


def _packed_counts(counts) -> bytes:
    """Rows of up to eight counts: which of a row are not zero, and those, byte by byte."""
    import numpy as np

    held = counts > 0
    some = counts[held]
    wide = "<u4" if some.max(initial=0) < 1 << 32 else "<u8"
    parts = [np.packbits(held, axis=1, bitorder="little").ravel(), np.ascontiguousarray(some.astype(wide).view(np.uint8).reshape(len(some), int(wide[-1])).T).ravel()]
    head = np.array([len(counts), len(some), int(wide[-1])], dtype="<i8").tobytes()
    return head + pa.compress(np.concatenate(parts), "zstd", asbytes=True)


def _counts(data: bytes, columns: int = NODES + 1):
    import numpy as np

    n, some, wide = np.frombuffer(data[:24], dtype="<i8").tolist()
    plain = np.frombuffer(pa.decompress(data[24:], n + some * wide, "zstd", asbytes=True), dtype=np.uint8)
    held = np.unpackbits(plain[:n, None], axis=1, count=columns, bitorder="little").astype(bool)
    out = np.zeros((n, columns), dtype=np.int64)
    out[held] = np.ascontiguousarray(plain[n:].reshape(wide, some).T).view(f"<u{wide}").ravel()
    return out


def _contexts(row: dict):
    """Table and counts (eight a context) of the contexts of a group."""
    return _counted(row, Words(row["contexts"]["packed"]).places()[2])


def _counted(row: dict, hashes: list):
    """The same, where the hashes of the group's places are at hand."""
    import numpy as np

    keys = _ascending(np.concatenate(hashes) >> np.uint64(4))
    counts = np.zeros((len(keys), 8), dtype=np.float32)
    at = 0
    for c in row["contexts"]["found"]:
        part = _counts(c["counts"])
        counts[at : at + len(part), : NODES + 1] = part
        at += len(part)
    if at != len(keys):
        raise ValueError(f"{at} counts for {len(keys)} contexts")
    return Table(keys), counts


def odds_of(counts):
    """Log odds of each decision, and confidence (0 to 2) of the context."""
    import numpy as np

    odds, sure = np.empty((len(counts), NODES), dtype=np.float32), np.empty(len(counts), dtype=np.int8)
    for start in range(0, len(counts), PLACE_BYTES):
        part = slice(start, start + PLACE_BYTES)
        beyond = np.cumsum(counts[part, ::-1], axis=1)[:, ::-1]
        yes, no, seen = counts[part, :NODES], beyond[:, 1 : NODES + 1], beyond[:, 0]
        odds[part] = np.log((yes + 0.3) / (no + 0.3))
        sure[part] = (seen >= 3).astype(np.int8) + (seen >= 40)
    return odds, sure


def _squash(x):
    import numpy as np

    return 1 / (1 + np.exp(-x))


def _bucket(z):
    import numpy as np

    return np.clip(np.rint((z + 8) * 2), 0, _BUCKETS - 1).astype(np.int32)


def _decisions(level):
    """Byte, node and outcome of every decision at bytes of these levels."""
    import numpy as np

    count = np.minimum(level.astype(np.int64) + 1, NODES)
    row = np.repeat(np.arange(len(count)), count)
    node = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, node, node == level[row]


def _first_weights():
    import numpy as np

    weights = np.full((CONTEXTS + 1, 9, NODES), 0.4, dtype=np.float64)
    weights[CONTEXTS] = 0
    return weights


def _distinct(keys, n, *columns):
    """Distinct keys, the sums of their numbers, and what stands in the columns beside them."""
    import numpy as np

    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    at = order[first]
    return keys[first], np.add.reduceat(n[order], first), *[c[at] for c in columns]


def places(texts: list[bytes], ranks, trains=None):
    """The different places of texts, those with equal contexts and level (and ``trains`` of
    their texts), as number, level and train, and hashes of the three contexts.

    Words come again and again, so these are far fewer than the bytes.
    """
    import numpy as np

    found = []
    marks = np.ones(len(texts), dtype=bool) if trains is None else np.asarray(trains, dtype=bool)
    for owner, parts, leads in runs(texts, PLACE_BYTES):
        run = Run(parts, ranks, leads, hashed=True)
        low = run.level.astype(np.uint64) << np.uint64(1) | np.repeat(marks[owner], run.sizes).astype(np.uint64)
        # The three bytes are a part of the five.
        key = (run.hashes[1] * np.uint64(_BASE) + run.hashes[2]) & np.uint64(_MASK - 15) | low
        found.append(_distinct(key, np.ones(len(key), dtype=np.int64), *run.hashes))
        if sum(len(f[0]) for f in found[1:]) > len(found[0][0]):
            found = [_distinct(*map(np.concatenate, zip(*found)))]
    if len(found) > 1:
        found = [_distinct(*map(np.concatenate, zip(*found)))]
    if not found:
        none = np.zeros(0, dtype=np.uint64)
        return none.astype(np.int64), none.astype(np.int64), none.astype(bool), [none] * CONTEXTS
    key, n, *hashes = found[0]
    return n, (key >> np.uint64(1) & np.uint64(7)).astype(np.int64), (key & np.uint64(1)).astype(bool), hashes


def error_sums(found: tuple, model: dict, counts, weights, last: bool):
    """Sums over all decisions at places of learning texts (numbers, levels, hashes): gradients
    and curvatures of the weights, or, when ``last``, outcomes and numbers for the last map.

    The texts were counted themselves, so each byte is first taken out of its contexts. Equal
    places are worked out once and count as often as they stand in the texts.
    """
    import numpy as np

    k, cells = CONTEXTS + 1, 9 * NODES
    sums = np.zeros((2, NODES * _BUCKETS) if last else (k + k * (k + 1) // 2, cells))
    flat = weights.reshape(k, cells).astype(np.float32)
    times, levels, hashes = found
    table = model.get("table")
    yes = np.ascontiguousarray(counts).ravel()
    no = np.ascontiguousarray(_beyond(counts)).ravel()
    more = np.float32(0.3)
    for start in range(0, len(times), FIT_PLACES):
        part = slice(start, start + FIT_PLACES)
        row, node, hit = _decisions(levels[part])
        n, hit = times[part].astype(np.float64)[row], hit.astype(np.float32)
        miss = 1 - hit
        x = np.ones((k, len(row)), dtype=np.float32)
        sure = []
        for i, h in enumerate(hashes):
            context = (h[part] >> np.uint64(64 - SLOT_BITS + 3) if table is None else table.find(h[part])).astype(np.int64) * 8
            others = no.take(context) - 1
            sure.append((others >= 3).astype(np.int64) + (others >= 40))
            at = context.take(row) + node
            up = np.maximum(yes.take(at) - hit, 0) + more
            at += 1
            np.log(up / (np.maximum(no.take(at) - miss, 0) + more), out=x[i])
        cell = (sure[1] * (3 * NODES) + sure[2] * NODES).take(row) + node
        z = flat[k - 1].take(cell)
        for w, v in zip(flat, x[: k - 1]):
            z += w.take(cell) * v
        if last:
            bucket = node * _BUCKETS + _bucket(z)
            sums += [np.bincount(bucket, hit * n, NODES * _BUCKETS), np.bincount(bucket, n, NODES * _BUCKETS)]
            continue
        p = _squash(z)
        err, bend = (hit - p) * n, p * (1 - p) * n
        sums[:k] += [np.bincount(cell, err * v, cells) for v in x]
        sums[k:] += [np.bincount(cell, bend * (x[i] * x[j]), cells) for i in range(k) for j in range(i + 1)]
    return sums


def _beyond(counts):
    """Sums of the counts from each column to the last."""
    import numpy as np

    out = np.empty((len(counts), 8), dtype=np.float32)
    out[:, 7] = counts[:, 7]
    for j in range(6, -1, -1):
        np.add(out[:, j + 1], counts[:, j], out=out[:, j])
    return out


def _newton(weights, sums):
    """Weights after one step; a weak pull to the first ones keeps rare cells in place."""
    import numpy as np

    k = CONTEXTS + 1
    bend = np.zeros((9 * NODES, k, k))
    for n, (i, j) in enumerate((i, j) for i in range(k) for j in range(i + 1)):
        bend[:, i, j] = bend[:, j, i] = sums[k + n]
    flat = weights.reshape(k, -1)
    pull = _first_weights().reshape(k, -1) - flat
    step = np.linalg.solve(bend + np.eye(k), (sums[:k] + pull).T[:, :, None])[:, :, 0].T
    return (flat + step).reshape(weights.shape)


def _fitted(sum_up) -> dict:
    """Weights and last map from ``sum_up(weights, last)``."""
    import numpy as np

    weights = _first_weights()
    for _ in range(ROUNDS):
        weights = _newton(weights, sum_up(weights, False))
    yes, all_ = sum_up(weights, True).reshape(2, NODES, _BUCKETS)
    p = (yes + 20 * _squash(np.linspace(-8, 8, _BUCKETS))) / (all_ + 20)
    return {"weights": weights.astype(np.float32), "map": np.log(p / (1 - p)).astype(np.float32)}


def fit_mixer(texts: list[bytes], model: dict, counts) -> dict:
    """Weights and map for texts at hand."""
    times, levels, _, hashes = places(texts, model["ranks"])
    return model | _fitted(lambda weights, last: error_sums((times, levels, hashes), model, counts, weights, last))


def fit(ready: DataFrame, ranks) -> dict:
    """Weights and map fitted on all learning texts; Spark adds the sums of the tasks."""
    import numpy as np

    shared = _shared(ready, ranks)

    def sum_up(weights, last):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                if any(row["trains"]):
                    times, levels, hashes, _, _ = Words(row["contexts"]["packed"]).places(_ranks(shared))
                    table, counts = _counted(row, hashes)
                    some = times > 0
                    sums = error_sums((times[some], levels[some], [h[some] for h in hashes]), {"table": table}, counts, weights, last).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], ["i", "v"])

        size = 2 * NODES * _BUCKETS if last else 14 * 9 * NODES
        sums = np.zeros(size)
        for r in ready.select("trains", F.struct(_without_texts(F.col("contexts.packed")), F.col("contexts.found").alias("found")).alias("contexts")).mapInArrow(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            sums[r["i"]] = r["v"]
        return sums.reshape(2 if last else 14, -1)

    return _fitted(sum_up)


class Decisions:
    """The decisions at places, one after the other: inputs, cell of the weights, outcome; and
    what the bytes beyond the decisions cost."""

    def __init__(self, contexts: list, level, triple, model: dict):
        import numpy as np

        row, node, hit = _decisions(level)
        self.count = np.minimum(level.astype(np.int64) + 1, NODES)
        self.first = np.cumsum(self.count) - self.count
        sure, odds = model["sure"], model["odds"].ravel()
        gate = sure[contexts[1]].astype(np.int64) * 3 + sure[contexts[2]]
        # A row a decision: the inputs, and twice the cell of the weights plus the outcome.
        self.rows = np.empty((len(row), CONTEXTS + 1), dtype=np.float32)
        for i, context in enumerate(contexts):
            self.rows[:, i] = odds.take((context.astype(np.int64) * NODES).take(row) + node)
        self.rows[:, CONTEXTS] = ((gate * NODES).take(row) + node) * 2 + hit
        self.more = np.zeros(len(level))
        rare = np.flatnonzero(level == NODES)
        two = triple[rare] >> 8
        self.more[rare] = model["left"][two] - model["rest"][two & 255, triple[rare] & 255]


def mixed_bits(sizes, place, decisions: Decisions, model: dict, states: list, rate: float = 0.002, map_rate: float = 0.02):
    """Bits that pieces of these sizes cost, whose bytes are at ``place``. Weights and map of each
    piece start from ``states``, or from the model where that is None, and follow the errors after
    every STEP bytes; the states that they end in replace those in ``states``."""
    import numpy as np

    k, cells, spots, n = CONTEXTS + 1, 9 * NODES, NODES * _BUCKETS, len(sizes)
    start = model["weights"].reshape(k, cells), model["map"].ravel()
    weights = np.concatenate([(s or start)[0] for s in states], axis=1).astype(np.float32)
    maps = np.concatenate([(s or start)[1] for s in states]).astype(np.float32)
    spot_of = (np.arange(cells) % NODES * _BUCKETS).astype(np.int64)
    # The texts of a run take their steps side by side.
    part = np.repeat(np.arange(n), sizes)
    step = ((np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // STEP).astype(np.uint16 if PIECE // STEP < 1 << 16 else np.int64)
    bits = np.bincount(part, decisions.more[place], minlength=n)
    order = np.argsort(step, kind="stable")
    place, part = place[order], part[order]
    bounds = [0, *np.cumsum(np.bincount(step)).tolist()]
    half, one, bend, slow = np.float32(0.5), np.float32(1), np.float32(rate), np.float32(map_rate)
    for a, b in zip(bounds, bounds[1:]):
        at = place[a:b]
        count = decisions.count[at]
        stop = np.cumsum(count)
        d = np.repeat(decisions.first[at] - stop + count, count)
        d += np.arange(len(d))
        own = np.repeat(part[a:b], count)
        *xs, what = decisions.rows.take(d, axis=0, mode="clip").T.copy()
        cell = what.astype(np.int64)
        hit = (cell & 1).astype(np.float32)
        cell >>= 1
        m = spot_of.take(cell, mode="clip")
        m += own * spots
        cell += own * cells
        z = weights[k - 1].take(cell, mode="clip")
        for w, x in zip(weights, xs):
            z += w.take(cell, mode="clip") * x
        np.clip(z, -30, 30, out=z)
        m += _bucket(z)
        refined = maps.take(m, mode="clip")
        final = half * z
        final += half * refined
        err = (hit - one / (one + np.exp(-z))) * bend
        for w, x in zip(weights, xs):
            np.add.at(w, cell, err * x)
        np.add.at(weights[k - 1], cell, err)
        np.add.at(maps, m, (hit - one / (one + np.exp(-refined))) * slow)
        # The cost is log(1 + exp(y)), y the odds against what came, within 30.
        final *= one - (hit + hit)
        bits += np.bincount(own, np.log(one + np.exp(final)), minlength=n) / np.log(2)
    for i in range(n):
        states[i] = weights[:, i * cells : (i + 1) * cells].copy(), maps[i * spots : (i + 1) * spots].copy()
    return bits


def bits_of(parts: list[bytes], model: dict, leads: list[tuple] | None = None, states: list | None = None, rate: float = 0.002, map_rate: float = 0.02):
    """Bits that each piece costs; ``states`` as in ``mixed_bits``."""
    import numpy as np

    run = Run(parts, model["ranks"], leads, model.get("table"))
    triple = run.two.astype(np.int64) << 8 | run.byte
    return mixed_bits(run.sizes, np.arange(len(triple)), Decisions(run.contexts, run.level, triple, model), model, [None] * len(parts) if states is None else states, rate, map_rate)


def text_bits(texts: list[bytes], model: dict):
    """Bits that each text costs; state goes on from piece to piece of a text."""
    import numpy as np

    bits = np.zeros(len(texts))
    last, state = None, None
    for owner, parts, leads in runs(texts):
        states = [state if i == last else None for i in owner]
        np.add.at(bits, owner, bits_of(parts, model, leads, states))
        last, state = owner[-1], states[-1]
    return bits


def group_bits(group: Group, find, decisions: Decisions, model: dict):
    """Bits that each text of a group costs."""
    import numpy as np

    bits = np.zeros(len(group.sizes))
    ends = np.cumsum(group.sizes)
    place = np.empty(int(ends[-1]), dtype=np.int32)
    first, at = np.concatenate([[0], group.last[:-1] + 1]), 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SCORE_BYTES)))
        place[ends[at] - group.sizes[at] : ends[stop - 1]] = find(int(first[at]), int(group.last[stop - 1]) + 1)
        at = stop
    # Texts of like length go side by side, as the steps of a run are those of its longest.
    order = np.argsort(-group.sizes, kind="stable")
    total = np.cumsum(group.sizes[order])
    at = 0
    while at < len(order):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SCORE_BYTES)))
        run = order[at:stop].tolist()
        bounds = {i: [(0, int(group.sizes[i]))] if group.sizes[i] <= PIECE else list(cuts(group.body(i))) for i in run}
        state = dict.fromkeys(run)
        while run:
            parts = [place[start + a : start + b] for start, (a, b) in ((int(ends[i] - group.sizes[i]), bounds[i].pop(0)) for i in run)]
            states = [state[i] for i in run]
            bits[run] += mixed_bits(np.array([len(p) for p in parts]), np.concatenate(parts), decisions, model, states)
            state = dict(zip(run, states))
            run = [i for i in run if bounds[i]]
        at = stop
    return bits


_PACKED = "struct<n_tokens: array<long>, ids: binary, size: long, words: binary, final: binary, times: binary, codes: array<binary>, code_times: array<binary>>"
_GROUP = f"grp long, bytes long, n_learned long, doc_ids array<long>, trains array<boolean>, packed {_PACKED}"


def _groups(texts: DataFrame) -> DataFrame:
    """Documents in groups: the words of each group as they come, and their numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        group = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        # Words are numbered as they come; only the numbers are kept.
        number: dict[bytes, int] = {b"\n": 0}
        size = 0

        def out():
            nonlocal group
            ids, joined = np.concatenate([r[3] for r in rows]), b" ".join(number)
            n_tokens = [r[2] for r in rows]
            ends = np.cumsum([len(r[3]) for r in rows]) - 1
            packed = {"n_tokens": n_tokens, "size": len(joined), "words": pa.compress(joined, "zstd", asbytes=True), "final": np.unique(ids[ends]).astype(np.int32).tobytes(), "ids": pa.compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T), "zstd", asbytes=True)}
            packed |= Group(packed).counted([r[1] for r in rows])
            learned = sum(n for n, r in zip(n_tokens, rows) if r[1])
            longs = pa.list_(pa.int64())
            fields = [[group], [size], [learned], [[r[0] for r in rows]], [[r[1] for r in rows]], [packed]]
            types = [pa.int64(), pa.int64(), pa.int64(), longs, pa.list_(pa.bool_()), pa.struct([("n_tokens", longs), ("ids", pa.binary()), ("size", pa.int64()), *((f, pa.binary()) for f in ("words", "final", "times")), ("codes", pa.list_(pa.binary())), ("code_times", pa.list_(pa.binary()))])]
            group += 1
            return pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(fields, types)], ["grp", "bytes", "n_learned", "doc_ids", "trains", "packed"])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for doc_id, text, train in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist(), part.column("train").to_pylist()):
                    words = words_of(text)
                    rows.append((doc_id, train, len(words) + 1, np.array([number.setdefault(w, len(number)) for w in words or [b""]], dtype=np.uint32)))
                    size += len(text or b"")
                    if size >= GROUP_BYTES or len(rows) >= GROUP_DOCUMENTS:
                        yield out()
                        rows, number, size = [], {b"\n": 0}, 0
        if rows:
            yield out()

    return texts.mapInArrow(pack, _GROUP)


def blocks_for(size: int) -> int:
    """Blocks of context hashes for so many bytes of text, a power of two."""
    return 1 << max(0, -(-size // BLOCK_BYTES) - 1).bit_length()


def prepared(rows: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """Groups of documents, groups with the counts of their contexts, and tables of bytes."""
    groups = storage.stored(_groups(rows), "groups")
    ranks, rest, left = rank_tables(byte_triples(groups))
    total_bytes = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    # Stored, so that the shuffle with the hashes is gone before the texts are shuffled.
    contexts = storage.stored(context_counts(groups, ranks, blocks_for(total_bytes)), "counts")
    tasks = max(1, -(-total_bytes // BLOCK_BYTES))
    found = contexts.repartition(tasks, "grp").groupBy(F.col("grp").alias("own")).agg(F.sum("vocabulary").alias("vocabulary"), F.sort_array(F.collect_list(F.struct("block", "counts", "learned"))).alias("found"))
    texts = groups.select("grp", "doc_ids", "trains", "packed").repartition(tasks, "grp")
    joined = texts.join(found, F.col("grp") == F.col("own")).select("grp", "doc_ids", "trains", "vocabulary", F.struct("packed", "found").alias("contexts"))
    return groups, storage.stored(joined, "ready"), {"ranks": ranks, "rest": rest, "left": left}


def held_out(doc_id: Column) -> Column:
    return text_crc(doc_id, 7) == 2


_RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"


def _scored(ready: DataFrame, model: dict, train_tokens: int, vocabulary: int) -> DataFrame:
    ranks, shared = _shared(ready, model["ranks"]), ready.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k != "ranks"})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for row in _rows(batches):
            fixed, group = shared.value, Group(row["contexts"]["packed"])
            n, base, known = len(row["doc_ids"]), *group.base(row["contexts"]["found"], train_tokens, vocabulary)
            tails = group.tails()
            _, level, hashes, triple, near = group.places(_ranks(ranks))
            table, counts = _counted(row, hashes)
            odds, sure = odds_of(counts)
            del counts
            decisions = Decisions([table.find(h) for h in hashes], level, triple, fixed | {"odds": odds, "sure": sure})
            del table, odds, sure, hashes, level, triple
            bits = group_bits(group, group.place_finder(near, tails), decisions, fixed)
            columns = [row["doc_ids"], group.n_tokens, known, base, -bits * np.log10(2), bits / group.sizes]
            types = [pa.int64()] * 3 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in _RESULT.split(", ")])

    return ready.select("doc_ids", "contexts").mapInArrow(score, _RESULT)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the job that wrote them has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def scores(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: tokens (words and an end), known ones, the number of
    learning tokens, log10 probability by word counts, by the model, and its bits per byte.

    Rows where ``train`` is true are learned from. Null and empty texts are an end alone.
    Repeated rows give repeated results and are learned as often, null ids stay null, other
    columns are not read. Without a learning row, every token is unknown and all decisions
    are even; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    with _shuffles_removed(docs.sparkSession):
        groups, ready, tables = prepared(rows)
        model = tables | fit(ready, tables["ranks"])
        total = groups.agg(F.coalesce(F.sum("n_learned"), F.lit(0)).alias("n")).first()["n"]
        vocabulary = ready.agg(F.coalesce(F.sum("vocabulary"), F.lit(0)).alias("v")).first()["v"]
    return _scored(ready, model, total, vocabulary).withColumn("train_tokens", F.lit(total).cast("long"))
