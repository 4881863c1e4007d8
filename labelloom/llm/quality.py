"""Quality rules on repetition (operator 6).

Rolling hashes of several n-gram lengths are taken over the word numbers of a document with
numpy, and the characters inside n-grams that occur again are measured, as are those inside
repeated lines. A document goes when too large a share of it is covered.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.words import BLANKS, as_bytes

MIN_WORDS = 50
# Largest share of characters inside repeated n-grams, by words in the n-gram, and inside
# lines that repeat an earlier one: the values of the published Gopher rules.
DUPLICATE_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_SHARE = 0.20

_SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = BLANKS + bytes(range(0x80, 0xC0))  # blanks, and bytes that continue a character
_TYPE = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, line_share double, ngram_share double, broken_rules long"
)


def _covered(repeated, n, size):
    """Marks the words of windows that are repeated."""
    import numpy as np

    step = np.zeros(size + 1, dtype=np.int64)
    step[:-n] += repeated
    step[n:] -= repeated
    return np.cumsum(step[:-1]) > 0


def _repeated(codes):
    """For each window, if its code occurs again."""
    import numpy as np

    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(codes), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure(text: bytes | None, shares: dict[int, float] = DUPLICATE_SHARES, line_limit: float = LINE_SHARE, min_words: int = MIN_WORDS) -> tuple:
    """Counts, shares and verdict for one document (UTF-8)."""
    import numpy as np

    text = text or b""
    words = text.split()
    size = len(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    seen: set[bytes] = set()
    line_chars = 0
    if len(set(lines)) < len(lines):
        for line in lines:
            if line in seen:
                line_chars += len(line.translate(None, _NOT_COUNTED))
            seen.add(line)
    n_dup_lines = len(lines) - len(set(lines))
    word_chars = len(text.translate(None, _NOT_COUNTED))
    n_symbols = len(text) - len(text.translate(None, _SYMBOLS))

    n_repeat_words, worst, broken = 0, 0.0, 0
    if size >= 3:
        distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(distinct.__getitem__, words), dtype=np.int64, count=size)
        many = len(distinct)
        if many == size:
            pass  # no word occurs twice, so no window does
        else:
            pairs = ids[:-1] * many + ids[1:]
            if many >= 1 << 21:  # three word numbers do not fit one integer: number the pairs first
                pairs = np.unique(pairs, return_inverse=True)[1]
            again = _repeated(pairs[:-1] * many + ids[2:])
            n_repeat_words = int(_covered(again, 3, size).sum()) if again.any() else 0
            if n_repeat_words and size > min(shares):
                # a longer window can only be repeated where windows of three words are
                rng = np.random.Generator(np.random.PCG64(7))
                mixed = rng.integers(0, 2**64, size=many, dtype=np.uint64, endpoint=False)[ids]
                lengths = np.fromiter((len(w.translate(None, _NOT_COUNTED)) for w in distinct), dtype=np.int64, count=many)[ids]
                base = np.uint64(0x9E3779B97F4A7C15)
                rolling = mixed
                for n in range(2, max(shares) + 1):
                    if n > size:
                        break
                    rolling = rolling[:-1] * base + mixed[n - 1 :]
                    if n in shares:
                        again = _repeated(rolling)
                        if not again.any():
                            break
                        share = float(lengths[_covered(again, n, size)].sum()) / max(word_chars, 1)
                        worst = max(worst, share)
                        broken += share > shares[n]
    line_share = line_chars / max(word_chars, 1)
    broken += line_share > line_limit
    base_failed = size < min_words or 100 * n_repeat_words > 50 * size
    return size, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not broken, line_share, worst, int(broken)


def repetition(text: Column, shares: dict[int, float] = DUPLICATE_SHARES, line_limit: float = LINE_SHARE, min_words: int = MIN_WORDS) -> Column:
    """Struct of counts, shares and verdict of a text column; see ``quality``."""
    names = [part.split()[0] for part in _TYPE.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [kinds[part.split()[1]] for part in _TYPE.split(", ")]

    @F.arrow_udf(_TYPE)
    def score(column: pa.Array) -> pa.Array:
        rows = [measure(text, shares, line_limit, min_words) for text in as_bytes(column)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)], names)

    return score(text)


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row per row of ``docs`` with its counts, shares and verdict.

    Null and empty texts have no words and fail. Repeated rows give repeated results; a null
    id stays null. Only the two named columns are read, so others may have any name. An
    empty table gives no rows. Texts of any length are measured whole.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), repetition(F.col(text), **limits).alias("q"))
    return rows.select("doc_id", "q.*")


def keep_good(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows of ``docs``, unchanged, that pass."""
    return docs.where(repetition(F.col(text), **limits)["kept"])
