"""Column helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id falls in fold null and so in no split."""
    return (F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % k).cast("int")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of the frame has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hash_order(column: Column, seed: int) -> Column:
    """Hex digits that order rows by chance, the same in every run and engine."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(column.cast("string"), F.lit("null"))))


def word_slices(data: bytes, size: int = 2 << 20) -> Iterator[list[bytes]]:
    """The words between white space, those of about `size` bytes at a time; no word is cut."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            end = cut if cut > at else data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end
