"""Oversized texts, cut into pieces at natural boundaries.

Method: a hierarchy of separators - sections, lines as paragraphs, sentences, words,
characters - cuts a text into units that fit; units are packed greedily into pieces
up to the limit, and each piece repeats the end of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 200
#: Where a text may be cut, best first: after the match.
SEPARATORS = (r"\n[ \t]*(?:\n[ \t]*)+", r"\n+", r"[.!?।॥…]+[\"'”’»)\]]*\s+", r"\s+")


@cache
def _separators() -> list[re.Pattern]:
    return [re.compile(s) for s in SEPARATORS]


def _units(text: str, a: int, b: int, most: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """Spans of at most `most` characters that make up text[a:b], cut as high in the hierarchy as possible."""
    if b - a <= most:
        if b > a:
            yield a, b
    elif level == len(SEPARATORS):
        for i in range(a, b, most):
            yield i, min(b, i + most)
    else:
        start = a
        for m in _separators()[level].finditer(text, a, b):
            if m.end() > start:
                yield from _units(text, start, m.end(), most, level + 1)
                start = m.end()
        yield from _units(text, start, b, most, level + 1)


def _overlap(text: str, least: int, end: int) -> int:
    """Where the piece after one that ends at `end` starts, not before `least`: after the first line, else sentence, else word that ends in between, else at `least`, a character boundary."""
    for pattern in _separators()[1:]:
        for m in pattern.finditer(text, least, end):
            if m.end() < end:
                return m.end()
    return least


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces: each at most `limit` long, starting 1 to `overlap` characters before the end of the one before; together they cover the text.

    Units have at most limit - overlap characters, so that one always fits behind the
    overlap; a piece of one character repeats nothing. overlap must be less than limit.
    """
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    out: list[tuple[int, int]] = []
    start = end = 0
    for _, b in _units(text, 0, len(text), limit - overlap):
        if b - start > limit:
            out.append((start, end))
            start = _overlap(text, max(end - overlap, start + 1), end) if overlap else end
        end = b
    out.append((start, end))
    return out


def cut(items: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, start, overlap, piece), numbered from 1: the pieces of each text.

    A text of at most `limit` characters is one piece and never leaves the JVM; null
    and empty texts have none. `overlap` tells how many characters at its start a piece
    repeats, so the pieces without them make up the text again.
    """
    given = items.select(key, F.col(text).alias("_text"))
    kind = items.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t in zip(f[key], f["_text"]):
                last = 0
                for n, (a, b) in enumerate(spans(t, limit, overlap), 1):
                    rows.append((k, n, a, last - a, t[a:b]))
                    last = b
            yield pd.DataFrame(rows, columns=[key, "piece_no", "start", "overlap", "piece"])

    long = given.where(F.length("_text") > limit).mapInPandas(work, f"{key} {kind}, piece_no int, start int, overlap int, piece string")
    short = given.where((F.length("_text") > 0) & (F.length("_text") <= limit))
    return long.union(short.select(key, F.lit(1).alias("piece_no"), F.lit(0).alias("start"), F.lit(0).alias("overlap"), F.col("_text").alias("piece")))
