"""Byte-pair encoding and decoding by dynamic programming over prefixes (operator 11).

The merges of a vocabulary give every prefix of a text exactly one last token. It is found
from the tokens that end there, which an automaton over the vocabulary with suffix links
reports, as the one that may stand after the last token of the prefix before it. Two tokens
may stand side by side if no merge across their border comes before the merges inside them.
Following the last tokens back from the end gives the ids, in time linear in the text and
without a list of merges under way.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.words import as_bytes

if TYPE_CHECKING:
    import numpy as np

# The characters that Unicode 17 and later versions made letters or numbers. The
# vocabulary's own library follows Unicode 16 and takes them as neither.
LATER_LETTERS = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱"
    r"꭬-꭭\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    r"\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    r"\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    r"\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LATER_NUMBERS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"

#: Entries kept of the pieces and pairs met lately, so a worker's memory does not grow with
#: its texts.
REMEMBERED = 1 << 19
#: Pairs of tokens are kept in a table of two to the power of this many places.
FIT_BITS = 20
#: Pieces worked out together, and characters of one that still goes with the others.
PIECES, LONG_PIECE = 1 << 15, 64
#: Characters of texts encoded together.
GROUP_CHARS = 1 << 22

_NEVER = 1 << 62


def byte_characters() -> list[str]:
    """The character by which a vocabulary file writes each byte: the byte's own where that
    is printable, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _pattern(letter: str, number: str, blank: str, no_blank: str, other: str) -> str:
    """The pattern that splits a text before the merges, from its classes of characters."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|{blank}+(?!{no_blank})|{blank}+"


def _plain_class(kind: str) -> str:
    """The characters below the first later letter that are of a kind, as parts of a class of
    the standard library's patterns, which split such texts at twice the speed."""
    import regex

    among = regex.compile(kind)
    codes = [c for c in range(ord(LATER_LETTERS[0])) if among.match(chr(c))]
    first = [c for c in codes if c - 1 not in codes]
    last = [c for c in codes if c + 1 not in codes]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(first, last, strict=True))


class _Table:
    """Whole numbers by whole numbers of at least 0, looked up many at a time."""

    def __init__(self, bits: int):
        import numpy as np

        self.bits, self.size = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)

    def _slots(self, keys):
        import numpy as np

        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys):
        """Value of each key, -1 where there is none."""
        import numpy as np

        at = self._slots(keys)
        held = self.keys[at]
        found = np.where(held == keys, self.values[at], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while open_.size:
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[open_]]
            same = held == keys[open_]
            found[open_[same]] = self.values[at[open_[same]]]
            open_ = open_[~same & (held >= 0)]
        return found

    def put(self, keys, values) -> None:
        """Add keys that are not there yet, each once."""
        for key, slot, value in zip(keys.tolist(), self._slots(keys).tolist(), values, strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.values[slot] = key, value
        self.size += len(keys)


class Coder:
    """Encoder and decoder for one vocabulary file of byte-level merges."""

    def __init__(self, definition: bytes) -> None:
        import numpy as np
        import regex

        parts = json.loads(definition)
        model, split = parts["model"], parts["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or parts["normalizer"]:
            raise ValueError("not a vocabulary of byte-level merges over plain text")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in parts["added_tokens"]):
            raise ValueError("added tokens that take blanks or word borders along are not supported")
        value = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = model["vocab"]
        size = max([*vocabulary.values(), *(a["id"] for a in parts["added_tokens"])]) + 1
        self.size = size
        self.content: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            self.content[i] = bytes(value[c] for c in token)
        self.added = {a["content"]: a["id"] for a in parts["added_tokens"]}
        for token, i in self.added.items():
            self.content[i] = token.encode()

        self.born, self.first, self.second = [-1] * size, [-1] * size, [-1] * size
        self.rank: dict[int, int] = {}
        whole = [len(c) == 1 for c in self.content]
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, new = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if self.born[new] >= 0 or not (whole[left] or self.born[left] >= 0) or not (whole[right] or self.born[right] >= 0):
                raise ValueError("each token needs one merge, after those of its parts")
            self.born[new], self.first[new], self.second[new] = rank, left, right
            self.rank[left * size + right] = rank
        self.fit = _Table(FIT_BITS)
        # Tokens whose own bytes the merges join to something else never occur.
        for new in sorted((i for i in range(size) if self.born[i] >= 0), key=self.born.__getitem__):
            whole[new] = whole[self.first[new]] and whole[self.second[new]] and self._no_merge_across(self.first[new], self.second[new], self.born[new])
        self.whole = {self.content[i]: i for i in vocabulary.values() if whole[i]}
        if sum(len(token) == 1 for token in self.whole) < 256:
            raise ValueError("not every byte is a token")
        self._link_suffixes()
        self.length = [len(c) for c in self.content]

        newer = LATER_LETTERS + LATER_NUMBERS
        letters, numbers, blanks = map(_plain_class, (r"\p{L}", r"\p{N}", r"\s"))
        self.pattern = re.compile(_pattern(f"[{letters}]", f"[{numbers}]", f"[{blanks}]", f"[^{blanks}]", f"[^{blanks}{letters}{numbers}]"))
        letters, numbers = rf"[\p{{L}}--[{LATER_LETTERS}]]", rf"[\p{{N}}--[{LATER_NUMBERS}]]"
        self.strict = regex.compile("(?V1)" + _pattern(letters, numbers, r"\s", r"\S", rf"[[^\s\p{{L}}\p{{N}}]||[{newer}]]"))
        by_length = sorted(self.added, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.late = re.compile(f"[{LATER_LETTERS[0]}-\U0010ffff]").search
        #: Pieces met lately, and the ids of each by its number.
        self.number: dict[str, int] = {}
        self.ids, self.counts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)

    def _link_suffixes(self) -> None:
        """Automaton over the tokens: a state is the longest ending of what was read that
        begins a token, and links lead to the next shorter such ending."""
        step: dict[int, int] = {}
        above, token_at, levels = [0], [-1], [[]]
        for token, i in self.whole.items():
            state = 0
            for depth, byte in enumerate(token, 1):
                edge = state << 8 | byte
                state = step.get(edge, 0)
                if not state:
                    state = step[edge] = len(above)
                    above.append(edge)
                    token_at.append(-1)
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append(state)
            token_at[state] = i
        link, longest = [0] * len(above), [-1] * len(above)
        self.shorter = [-1] * self.size
        for level in levels:
            for state in level:
                parent, byte = above[state] >> 8, above[state] & 255
                if parent:
                    back = link[parent]
                    while back and back << 8 | byte not in step:
                        back = link[back]
                    link[state] = step[back << 8 | byte]
                longest[state] = longest[link[state]]
                if token_at[state] >= 0:
                    self.shorter[token_at[state]] = longest[state]
                    longest[state] = token_at[state]
        import numpy as np

        self.step, self.link, self.longest = step, link, longest
        self.steps = _Table(max(len(step), 2).bit_length() + 1)
        self.steps.put(np.fromiter(step.keys(), dtype=np.int64, count=len(step)), list(step.values()))
        self.lengths = np.array([len(c) for c in self.content], dtype=np.int64)
        self.arrays = [np.array(x, dtype=np.int64) for x in (link, longest, self.shorter)]

    def _no_merge_across(self, left: int, right: int, end: int) -> bool:
        """If no merge with rank below ``end`` joins two parts across the border.

        ``x`` goes down the right edge of the left token and ``y`` down the left edge of the
        right one, undoing the later merge each time; of equal ones the right one is later.
        A merge of ``x`` and ``y`` wins if it comes before the merge that uses up ``x``, and
        not after the one that uses up ``y``, since of equal merges the left one comes first.
        """
        born, rank, size = self.born, self.rank, self.size
        x, y, x_used, y_used = left, right, end, end
        while True:
            across = rank.get(x * size + y, _NEVER)
            if across < x_used and across <= y_used and across < end:
                return False
            if born[x] < 0 and born[y] < 0:
                return True
            if born[y] >= born[x]:
                y_used, y = born[y], self.first[y]
            else:
                x_used, x = born[x], self.second[x]

    def _fits(self, left, right):
        """For each two tokens, if they may stand side by side."""
        import numpy as np

        keys = left * self.size + right
        found = self.fit.get(keys)
        new = np.unique(keys[found < 0])
        if new.size:
            if self.fit.size + new.size > REMEMBERED:
                self.fit = _Table(FIT_BITS)
            answers = [self._no_merge_across(*divmod(key, self.size), _NEVER) for key in new.tolist()]
            kept = new[:REMEMBERED]
            self.fit.put(kept, answers[: kept.size])
            there = np.searchsorted(new, keys[found < 0])
            found[found < 0] = np.array(answers, dtype=np.int32)[there]
        return found > 0

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, one after the other, and number of ids of sorted different pieces that no
        split cuts, none of them empty.

        All pieces go forward together, a byte at a time. A prefix that several share is
        worked out for the first of them, which lies next to the others.
        """
        import numpy as np

        link, longest, shorter = self.arrays
        count, lengths = len(pieces), np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        longest_piece = int(lengths.max())
        padded = np.frombuffer(b"".join(p.ljust(longest_piece, b"\0") for p in pieces), dtype=np.uint8).reshape(count, longest_piece)
        shared = np.zeros(count, dtype=np.int64)
        differs = padded[1:] != padded[:-1]
        shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), longest_piece)
        shared[1:] = np.minimum(shared[1:], np.minimum(lengths[1:], lengths[:-1]))
        numbers = np.arange(count)
        last = np.full((longest_piece + 1, count), -1, dtype=np.int32)  # last token of each prefix
        state, owner = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
        for end in range(1, longest_piece + 1):
            first = (shared < end) & (lengths >= end)
            own = np.flatnonzero(first)
            at, byte = state[owner[own]], padded[own, end - 1].astype(np.int64)
            following = self.steps.get(at << 8 | byte)
            lost = np.flatnonzero(following < 0)
            while lost.size:
                at[lost] = link[at[lost]]
                following[lost] = self.steps.get(at[lost] << 8 | byte[lost])
                lost = lost[following[lost] < 0]
            # The tokens that end here, longest first: exactly one of them fits.
            token = longest[following]
            start = end - self.lengths[token]
            asked = np.flatnonzero(start > 0)
            while asked.size:
                asked = asked[~self._fits(last[start[asked], own[asked]].astype(np.int64), token[asked])]
                token[asked] = shorter[token[asked]]
                start[asked] = end - self.lengths[token[asked]]
                asked = asked[start[asked] > 0]
            owner = np.maximum.accumulate(np.where(first, numbers, 0))
            state = np.zeros(count, dtype=np.int64)
            state[own] = following
            tokens = np.full(count, -1, dtype=np.int32)
            tokens[own] = token
            last[end] = tokens[owner]
        # Back from the ends of the pieces, one token of each at a time.
        at, who, steps = lengths.copy(), numbers, []
        while who.size:
            token = last[at[who], who]
            steps.append((who, token))
            at[who] -= self.lengths[token]
            who = who[at[who] > 0]
        many = np.zeros(count, dtype=np.int64)
        for who, _ in steps:
            many[who] += 1
        ends = np.cumsum(many)
        ids = np.empty(int(ends[-1]), dtype=np.int32)
        for k, (who, token) in enumerate(steps):
            ids[ends[who] - 1 - k] = token
        return ids, many

    def encode_long(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece of any length, by the same steps."""
        step, link, longest, shorter, length = self.step, self.link, self.longest, self.shorter, self.length
        last, state = array("i", [-1]), 0
        known: dict[tuple[int, int], bool] = {}
        for end, byte in enumerate(piece, 1):
            while state << 8 | byte not in step:
                state = link[state]
            state = step[state << 8 | byte]
            token = longest[state]
            while (start := end - length[token]) > 0:
                pair = last[start], token
                if pair not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[pair] = self._no_merge_across(*pair, _NEVER)
                if known[pair]:
                    break
                token = shorter[token]
            last.append(token)
        found, at = [], len(piece)
        while at:
            found.append(last[at])
            at -= length[last[at]]
        return tuple(found[::-1])

    def _split(self, text: str) -> list[str]:
        return (self.strict if not text.isascii() and self.late(text) else self.pattern).findall(text)

    def _learn(self, pieces: set[str]) -> None:
        """Keep the ids of pieces that are not kept yet."""
        import numpy as np

        missing = pieces - self.number.keys()
        if len(self.number) + len(missing) > max(REMEMBERED, len(missing)):
            self.number.clear()
            self.ids, self.counts = self.ids[:0], self.counts[:0]
            missing = pieces
        ordered = sorted(missing)
        found: list[np.ndarray] = [self.ids]
        counts: list[np.ndarray] = [self.counts]
        for start in range(0, len(ordered), PIECES):
            ids, many = self.encode_pieces([p.encode() for p in ordered[start : start + PIECES]])
            found.append(ids)
            counts.append(many)
        self.number.update(zip(ordered, range(len(self.counts), len(self.counts) + len(ordered)), strict=True))
        self.ids, self.counts = np.concatenate(found), np.concatenate(counts)

    def encode_many(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of texts as arrays; strings of added tokens become those tokens.

        Texts are taken in groups of bounded size, so that each different piece of a group
        is looked up once.
        """
        group: list[list] = []
        size = 0
        for text in texts:
            if self.specials is not None and self.specials.search(text):
                parts = self.specials.split(text)
                group.append([piece for i, p in enumerate(parts) for piece in ([(p,)] if i % 2 else self._split(p))])
            else:
                group.append(self._split(text))
            size += len(text)
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list]) -> Iterator[np.ndarray]:
        import numpy as np

        distinct = set().union(*group)
        apart = {p for p in distinct if isinstance(p, tuple) or len(p) > LONG_PIECE}
        self._learn(distinct - apart)
        number, ids, counts = self.number, self.ids, self.counts
        if apart:  # added tokens and long pieces are not kept
            more = {p: (self.added[p[0]],) if isinstance(p, tuple) else self.encode_long(p.encode()) for p in apart}
            number = number | dict(zip(more, range(len(counts), len(counts) + len(more)), strict=True))
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(more.values()), dtype=np.int32)])
            counts = np.concatenate([counts, np.fromiter(map(len, more.values()), dtype=np.int64)])
        begins = np.cumsum(counts) - counts
        for pieces in group:
            which = np.fromiter(map(number.__getitem__, pieces), dtype=np.int64, count=len(pieces))
            many = counts[which]
            ends = np.cumsum(many)
            yield ids[np.repeat(begins[which] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return next(self.encode_many([text])).tolist()

    def decode(self, ids) -> str:
        """Text of ids; ids outside the vocabulary are passed over, bytes that are no UTF-8 become U+FFFD."""
        content, size = self.content, self.size
        return b"".join([content[i] for i in ids if 0 <= i < size]).decode("utf-8", "replace")


def _coder(shared: dict) -> Coder:
    """The coder of a broadcast vocabulary, built once in each worker."""
    if "coder" not in shared:
        shared["coder"] = Coder(shared["definition"])
    return shared["coder"]


def token_ids(spark: SparkSession, text: Column, definition: bytes) -> Column:
    """Array of ids of a text column; null and empty texts have none.

    ``definition`` is the content of the vocabulary file. It is broadcast; its size is that
    of a vocabulary and does not grow with the texts.
    """
    shared = spark.sparkContext.broadcast({"definition": definition})

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        import numpy as np

        coder = _coder(shared.value)
        parts, ends = [], [0]
        gc.disable()  # nothing here makes cycles, and walking the tables again and again takes time
        try:
            for ids in coder.encode_many((value or b"").decode("utf-8", "replace") for value in as_bytes(column)):
                parts.append(ids)
                ends.append(ends[-1] + len(ids))
        finally:
            gc.enable()
        values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))

    return encode(text)


def token_text(spark: SparkSession, ids: Column, definition: bytes) -> Column:
    """Text of a column of id arrays; null arrays and null ids give no text."""
    shared = spark.sparkContext.broadcast({"definition": definition})

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        coder = _coder(shared.value)
        texts = []
        for row in column:
            values = row.values
            texts.append(coder.decode(values.drop_null().to_numpy(zero_copy_only=False).tolist()) if values is not None else "")
        return pa.array(texts, pa.string())

    return decode(ids)


def encode(docs: DataFrame, definition: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text in the column ``ids``.

    Null and empty texts have an empty array. Repeated rows give repeated results, other
    columns stay as they are (one named like ``ids`` is replaced), and an empty table gives
    no rows. Bytes that are no UTF-8 count as U+FFFD.
    """
    return docs.withColumn(ids, token_ids(docs.sparkSession, F.col(text), definition))


def decode(rows: DataFrame, definition: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text that each array of ids stands for in the column ``text``."""
    return rows.withColumn(text, token_text(rows.sparkSession, F.col(ids), definition))
