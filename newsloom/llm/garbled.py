"""Texts that were decoded with the wrong character encoding.

Method: wherever characters of a line, taken back to bytes by one of the usual wrong
encodings, form whole UTF-8 sequences, the line has a candidate decoding; candidates
are decoded again, as garbling may have happened more than once. Each candidate is
compressed with zstandard dictionaries, one per language; the chain with the least
description, its own cost included, wins, and the line as it is wins ties.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textform import unless_usual

#: Wrong encodings that are tried. Those of one entry differ in few characters and are often mixed in one text, so they count as one.
ENCODINGS = {"western": ("cp1252", "latin-1"), "mac": ("mac_roman",), "cyrillic": ("cp1251",), "dos": ("cp437",)}
#: Longest chain of wrong decodings, and what each step costs, in bytes.
DEPTH, STEP_COST = 3, 1
#: Suspect sequences this near to each other are decided together, in pieces of at most so many characters, with so many around them.
NEAR, LONGEST, AROUND = 4, 240, 24
LOST = "�"
#: What a character costs more, in bytes, that the samples of no language have.
UNKNOWN_COST = 4
#: The same for Greek and Cyrillic letters, which also serve as signs.
LETTER_COST = 2
# Signs that are at home in any language.
SIGNS = "“”‘’„…–—₹€£$°²³½¼¾©®™«»·•§✅⚠"
DEFAULT_LANGUAGE = "none"
#: Sample rows that the dictionaries are made from, at most.
DICTIONARY_ROWS = 20_000


@cache
def _bytes_of(name: str) -> dict[str, int]:
    """Characters of the bytes from 0x80; where an encoding has none, the control character of the same number, as browsers do."""
    out: dict[str, int] = {}
    for encoding in ENCODINGS[name]:
        for b in range(0x80, 0x100):
            try:
                ch = bytes([b]).decode(encoding)
            except UnicodeDecodeError:
                ch = chr(b)
            out.setdefault(ch, b)
    return out


def _class(chars: Iterator[str], java: bool = False) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" if java else re.escape(c) for c in sorted(chars)) + "]"


def _sequence(encoding: str, java: bool = False) -> str:
    table = _bytes_of(encoding)
    part = lambda lo, hi: _class((c for c, b in table.items() if lo <= b <= hi), java)
    tail = part(0x80, 0xBF)
    # A no-break space at the end of a three-byte sequence often became a space.
    return f"{part(0xC2, 0xDF)}{tail}|{part(0xE0, 0xEF)}{tail}(?:{tail}| )|{part(0xF0, 0xF4)}{tail}{{3}}"


@cache
def _pattern(encoding: str) -> re.Pattern:
    return re.compile(f"(?:{_sequence(encoding)})+")


#: Never proper: the sign of a lost character and the control characters of the upper half.
BROKEN = "[\\x80-\\x84\\x86-\\x9f�]"
_BROKEN = re.compile(BROKEN)


@cache
def suspect() -> str:
    """A pattern for Java that finds every text with a candidate decoding or a broken character."""
    leads = {c for e in ENCODINGS for c, b in _bytes_of(e).items() if 0xC2 <= b <= 0xF4}
    broken = {chr(c) for c in range(0x80, 0xA0) if c != 0x85} | {LOST}
    return f"{unless_usual(leads | broken)}(?:[\\x80-\\x84\\x86-\\x9f\\x{{FFFD}}]|{'|'.join(_sequence(e, True) for e in ENCODINGS)})"


@cache
def _suspect_python() -> re.Pattern:
    return re.compile("|".join([*(f"(?:{_sequence(e)})+" for e in ENCODINGS), BROKEN]))


def _decoded(line: str, encoding: str) -> str:
    """The line with each run of whole sequences decoded; runs that aren't UTF-8 stay."""
    table = _bytes_of(encoding)

    def one(m: re.Match) -> str:
        try:
            return bytes(table.get(c, 0xA0) for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return _pattern(encoding).sub(one, line)


class Repairer:
    """Holds the dictionaries; made once in each worker from (language, sample text) pairs."""

    def __init__(self, samples: list[tuple[str, str]]) -> None:
        by: dict[str, list[str]] = {}
        for lang, text in samples:
            by.setdefault(lang, []).append(text)
        contents = ["\n".join(texts).encode() for _, texts in sorted(by.items())] or [b" " * 8]
        self.compressors = []
        for content in contents:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=3)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

        seen = {c for _, text in samples for c in text}
        self.known = {*SIGNS, *map(chr, range(128))} | {y for c in seen for y in (c, c.upper(), c.lower())}

    def cost(self, text: str) -> int:
        """Bytes of the shortest description, with a surcharge for unknown characters; letters beyond the basic plane are pictures and cost none."""
        data = text.encode("utf-8", "surrogatepass")
        unknown = sum(LETTER_COST if "Ͱ" <= c < "Ѡ" else UNKNOWN_COST for c in text if c not in self.known and c < "\U00010000")
        return min(len(c.compress(data)) for c in self.compressors) + unknown

    def reading(self, before: str, piece: str, after: str) -> tuple[str, str]:
        """The best reading of a piece between its neighbours, and its chain of encodings, empty if it stays."""
        found: dict[str, tuple[str, ...]] = {piece: ()}
        edge = [piece]
        for _ in range(DEPTH):
            later = []
            for text in edge:
                for encoding in ENCODINGS:
                    new = _decoded(text, encoding)
                    if new not in found:
                        found[new] = (*found[text], encoding)
                        later.append(new)
            edge = later
        if len(found) == 1:
            return piece, ""
        # Broken characters that a reading leaves or makes count as if they had to be spelt out.
        scored = [(self.cost(before + t + after) + STEP_COST * len(chain) + 4 * len(_BROKEN.findall(t)), len(chain), t, chain) for t, chain in found.items()]
        _, _, best, chain = min(scored, key=lambda s: s[:2])
        return best, "+".join(chain)

    def text(self, text: str) -> tuple[str, str]:
        """The restored text and the chains used, comma separated."""
        if text.isascii():
            return text, ""
        spans: list[list[int]] = []
        for m in _suspect_python().finditer(text):
            a, b = m.span()
            if spans and a - spans[-1][1] <= NEAR and b - spans[-1][0] <= LONGEST and "\n" not in text[spans[-1][1] : a]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        out, chains, at = [], [], 0
        for a, b in spans:
            out.append(text[at:a])
            new, chain = self.reading(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND])
            if chain and chain not in chains:
                chains.append(chain)
            out.append(new)
            at = b
        return "".join([*out, text[at:]]), ",".join(chains)


def language_samples(samples: DataFrame, most: int = DICTIONARY_ROWS) -> list[tuple[str, str]]:
    """The sample texts that the dictionaries are made from: `most` rows at most, drawn by hash; the whole of each."""
    rows = samples.where("text is not null").select("lang", "text", F.xxhash64("text").alias("h")).orderBy("h").limit(most).collect()
    return sorted((r["lang"] or DEFAULT_LANGUAGE, r["text"]) for r in rows)


def repair(texts: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_new, chain, broken) for the texts with a candidate decoding or a broken character.

    chain is empty where the text stays; broken says that signs of garbling are left,
    so the original can't be brought back whole; such a text is found by those signs,
    the sign of a lost character or a control character, and by no description length. Texts without any such sign, null and
    empty ones give no row. Repeated rows give a row each.
    """
    pairs = language_samples(samples)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixer = Repairer(pairs)
        for f in frames:
            made = [fixer.text(t) for t in f["_text"]]
            yield pd.DataFrame({key: f[key], "text_new": [m[0] for m in made], "chain": [m[1] for m in made], "broken": [bool(_BROKEN.search(m[0])) for m in made]})

    held = texts.select(key, F.col(text).alias("_text")).where(F.col("_text").rlike(suspect()))
    kind = texts.schema[key].dataType.simpleString()
    return held.mapInPandas(work, f"{key} {kind}, text_new string, chain string, broken boolean")


def garbled(texts: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`repair` without the texts that merely looked suspect."""
    return repair(texts, samples, key, text).where("chain <> '' or broken")
