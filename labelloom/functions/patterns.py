"""Texts that whatever matches a regular expression must contain."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Unknown(Exception):
    """The pattern has a construct that is not taken apart."""


class _Reader:
    """Reads a pattern by its syntax; what it does not know makes it give up."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def peek(self, size: int = 1) -> str:
        return self.text[self.at : self.at + size]

    def branches(self) -> frozenset[str] | None:
        """Texts of which one is needed by any of the branches up to a closing bracket."""
        found = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            found.append(self.sequence())
        return frozenset().union(*found) if all(found) else None

    def sequence(self) -> frozenset[str] | None:
        needs: list[frozenset[str]] = []
        run = ""

        def end_run() -> str:
            if run:
                needs.append(frozenset([run]))
            return ""

        while self.at < len(self.text) and self.peek() not in "|)":
            literal, inner = self.item()
            least, most = self.repeats()
            if literal is None:
                run = end_run()
                if inner and least:
                    needs.append(inner)
            elif not least:
                run = end_run()
            else:
                run += literal
                if most != 1:
                    run = end_run()
        end_run()
        return max(needs, key=lambda need: min(map(len, need)), default=None)

    def item(self) -> tuple[str | None, frozenset[str] | None]:
        """A single character, or what a group needs, or neither."""
        c = self.peek()
        self.at += 1
        if c == "\\":
            c = self.peek()
            self.at += 1
            if not c or c in "QExuUcNkGRX" or c.isdigit():
                raise _Unknown
            if c in "pP":
                self.at = self.text.index("}", self.at) + 1 if self.peek() == "{" else self.at + 1
                return None, None
            return (None, None) if c.isalnum() else (self.plain(c), None)
        if c == "[":
            self.skip_class()
            return None, None
        if c == "(":
            return None, self.group()
        if c in ".^$":
            return None, None
        if c in "*+?{":
            raise _Unknown
        return self.plain(c), None

    @staticmethod
    def plain(c: str) -> str | None:
        # Case rules beyond ASCII differ between engines.
        return c.lower() if c.isascii() else None

    def skip_class(self) -> None:
        depth, first = 1, True
        if self.peek() == "^":
            self.at += 1
        while depth:
            c = self.peek()
            if not c or (c == "]" and first):
                raise _Unknown
            self.at += 2 if c == "\\" else 1
            depth += {"[": 1, "]": -1}.get(c, 0)
            first = c == "["

    def group(self) -> frozenset[str] | None:
        looks = False
        if self.peek() == "?":
            if self.peek(2) == "?:":
                self.at += 2
            elif self.peek(2) in ("?=", "?!") or self.peek(3) in ("?<=", "?<!"):
                looks = True
                self.at += 3 if self.peek(2) == "?<" else 2
            elif self.peek(2) == "?<":
                self.at = self.text.index(">", self.at) + 1
            else:
                raise _Unknown
        needs = self.branches()
        if self.peek() != ")":
            raise _Unknown
        self.at += 1
        return None if looks else needs

    def repeats(self) -> tuple[int, int]:
        """How often the item before is needed, and may come (2: more than once)."""
        c = self.peek()
        if c not in ("?", "*", "+", "{"):
            return 1, 1
        self.at += 1
        least, most = {"?": (0, 1), "*": (0, 2), "+": (1, 2), "{": (0, 2)}[c]
        if c == "{":
            end = self.text.index("}", self.at)
            low, _, high = self.text[self.at : end].partition(",")
            if not low.isdigit():
                raise _Unknown
            least, most, self.at = int(low), 1 if (low, high) == ("1", "") and "," not in self.text[self.at : end] else 2, end + 1
        if self.peek() in ("?", "+"):  # lazy or possessive
            self.at += 1
        return least, most


def required_texts(pattern: str | None) -> list[str]:
    """Lower-case texts of which every match, whatever its case, contains at least one; none
    where that is not known."""
    if pattern is None:
        return []
    reader = _Reader(pattern)
    try:
        found = reader.branches()
    except (_Unknown, ValueError):
        return []
    return sorted(found) if found and reader.at == len(pattern) else []


def required(pattern: Column) -> Column:
    """Array of ``required_texts`` of a column of patterns."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def read(column: pa.Array) -> pa.Array:
        return pa.array([required_texts(p) for p in column.to_pylist()], pa.list_(pa.string()))

    return read(pattern)
