"""Chunks of words for retrieval."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunks(text: str | None, limit: int = 1200, overlap: int = 200) -> list[str]:
    """Chunks of whole words of at most `limit` characters, white space as single spaces; the last words of a chunk, up to `overlap` characters and one at least, begin the next. A word longer than the limit is a chunk of its own."""
    words = (text or "").split()
    ends, n = [0], 0
    for w in words:
        n += len(w) + 1
        ends.append(n)  # length of the words before, each with a space
    out, start = [], 0
    while start < len(words):
        end = start + 1
        while end < len(words) and ends[end + 1] - ends[start] - 1 <= limit:
            end += 1
        out.append(" ".join(words[start:end]))
        if end == len(words):
            break
        again = end - (1 if overlap else 0)
        while overlap and again > start and ends[end] - ends[again - 1] - 1 <= overlap:
            again -= 1
        start = max(start + 1, again)
    return out


def lead_chunk(text: Column, limit: int = 1200) -> Column:
    """The first chunk, without the others and without Python: white space as single spaces, whole words up to the limit, one word at least."""
    from .text import squeezed

    t = squeezed(F.coalesce(text, F.lit("")))
    cut = F.regexp_extract(F.substring(t, 1, limit + 1), "(?s)^(.*) ", 1)
    return F.when(F.length(t) <= limit, t).when(cut != "", cut).otherwise(F.regexp_extract(t, r"^[^ ]*", 0))


def chunk_rows(texts: DataFrame, key: str, text: str, version: str = "words-1200-200") -> DataFrame:
    """(key, chunk_version, chunk_index, chunk_text, token_estimate, content_hash): the chunks of texts, numbered from 0; null and empty texts have none."""
    cut = texts.select(key, F.posexplode(word_chunks(text)).alias("chunk_index", "chunk_text"))
    estimate = F.greatest(F.lit(1), F.floor(F.length("chunk_text") / 4))
    return cut.select(key, F.lit(version).alias("chunk_version"), "chunk_index", "chunk_text", estimate.alias("token_estimate"), F.sha2("chunk_text", 256).alias("content_hash"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def word_chunks(texts: pd.Series) -> pd.Series:
    return texts.map(chunks)
