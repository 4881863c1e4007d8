"""Words and hashes that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BLANKS = b" \t\n\x0b\x0c\r"
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x20\x09-\x0D]+"

# Everything below 0x80 but digits and lower-case letters becomes a blank; bytes from 0x80
# on are parts of characters beyond ASCII, which all belong to words.
_SEPARATORS = bytes(32 if b < 0x80 and not (48 <= b <= 57 or 97 <= b <= 122) else b for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased (UTF-8 in and out)."""
    return [] if text is None else text.lower().translate(_SEPARATORS).split()


def as_bytes(column) -> list[bytes | None]:
    """Values of an Arrow text column as UTF-8, without decoding them."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` is the same and faster where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_crc(doc_id: Column, modulus: int) -> Column:
    """Remainder that splits documents into learning and held-out ones; null id: 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")
