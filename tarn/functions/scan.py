"""References to other objects inside content, and rewriting of paths to a fixed width.

Text is scanned by one built-in regular expression. Binary content is read as ISO-8859-1, which
keeps every byte, so the same expression serves. Rewriting needs byte offsets and runs in Arrow
batches; writing at known offsets is built from `overlay`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

#: A name character, a hyphen, and a run of hex digits of which the first 64 are the id.
REFERENCE = r"[A-Za-z0-9+\-._?=]-([0-9a-fA-F]{64})[0-9a-fA-F]*"


REWRITTEN = StructType([StructField("content", BinaryType()), StructField("offsets", ArrayType(LongType()))])


def references(text: Column) -> Column:
    """The ids that a text refers to: distinct, sorted, lower-cased; null for null."""
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def binary_references(content: Column) -> Column:
    return references(F.decode(content, "ISO-8859-1"))


def rewritten(content: bytes, pattern: bytes, replacement: bytes) -> tuple[bytes, list[int]]:
    """content with every occurrence of pattern overwritten, and where: leftmost first, not overlapping."""
    if not pattern:
        raise ValueError("an empty pattern")
    if len(replacement) > len(pattern):
        raise ValueError("the replacement is longer than the pattern")
    offsets, at = [], content.find(pattern)
    while at >= 0:
        offsets.append(at)
        at = content.find(pattern, at + len(pattern))
    return content.replace(pattern, replacement.ljust(len(pattern), b"/")), offsets


@F.pandas_udf(REWRITTEN)
def _rewrite(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for content, pattern, replacement in batches:
        rows = [(None, None) if c is None or p is None or r is None else rewritten(bytes(c), p.encode(), r.encode()) for c, p, r in zip(content, pattern, replacement, strict=True)]
        yield pd.DataFrame(rows, columns=["content", "offsets"])


def rewrite(content: Column, pattern: Column | str, replacement: Column | str) -> Column:
    """struct(content, offsets): occurrences of pattern become replacement, filled up with / to its length."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return _rewrite(content, lit(pattern), lit(replacement))


def write_at(content: Column, offsets: Column, value: Column) -> Column:
    """content with value written at every offset (0 is the first byte)."""
    raw = F.encode(value, "utf-8")
    return F.aggregate(offsets, content, lambda c, at: F.overlay(c, raw, (at + 1).cast("int")))
