"""The language of each segment and text, with a confidence.

Method: hierarchical discrimination. The script of a segment picks the machines; they
predict its family first, then its language within the family, both one-versus-one linear
support vector machines over character n-grams of words. They are trained here, once, on
a bounded table of labelled samples; confidences are calibrated on held-out samples.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small, stored
from .sitelines import common_lines, content, texts_of_sources

#: Sample rows that are read for training, at most.
TRAINING_ROWS = 20_000
#: Words that a full sentence has at least; words of text without end marks that stand for one; a line on the pages of so large a share of stories isn't the article's.
SENTENCE_WORDS, RUN_WORDS = 4, 12
LEAST_STORIES, SHARE_OF_ALL = 8, 0.002
#: Confidence that a sentence needs to bring a language into its item.
LEAST_SURE = 0.5
SIZE = 1 << 15
# The families of languages; a language that isn't named is a family of its own.
FAMILIES = {"en": "european", "fr": "european", "hi": "indo-aryan", "mr": "indo-aryan", "ta": "dravidian", "te": "dravidian", "ms": "malayic"}
# How languages are also named in labels.
NAMES = {
    "eng": "en", "english": "en", "tam": "ta", "tamil": "ta", "hin": "hi", "hindi": "hi", "mar": "mr", "marathi": "mr", "tel": "te", "telugu": "te",
    "msa": "ms", "may": "ms", "malay": "ms", "fra": "fr", "fre": "fr", "french": "fr",
}
MISSING = ("", "und", "unknown", "n/a")
_SCRIPTS = regex.compile(r"(?P<LATIN>\p{Latin}+)|(?P<TAMIL>\p{Tamil}+)|(?P<TELUGU>\p{Telugu}+)|(?P<DEVANAGARI>\p{Devanagari}+)|(?P<OTHER>\p{L}+)")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_LINK = regex.compile(r"(?:https?://|www\.)\S+|[@#]\S+|\S+@\S+")
_TOKEN = regex.compile(r"\S+")
_NAME = regex.compile(r"\b[A-Z][a-z]+\b")
_DROP = regex.compile(r"[\s\p{N}]+")
_END = regex.compile(r"[.!?।॥…]+[\"'”’»)\]]*(?:\s+|$)")


class Machines:
    """Linear machines over the samples of one script: for the pairs of families, and within each family for the pairs of its languages."""

    def __init__(self, rows: list[tuple[str, list[str]]]) -> None:
        langs = sorted({lang for lang, _ in rows})
        groups = sorted({FAMILIES.get(lang, lang) for lang in langs})
        self.langs = {f: [x for x in langs if FAMILIES.get(x, x) == f] for f in groups}
        self.pairs = [(True, a, b) for a, b in combinations(groups, 2)] + [(False, a, b) for f in groups for a, b in combinations(self.langs[f], 2)]
        of = lambda whole, name: [w for lang, w in rows if (FAMILIES.get(lang, lang) if whole else lang) == name]
        made = [_machine(of(whole, a), of(whole, b)) for whole, a, b in self.pairs]
        self.weights = np.stack(made).astype(np.float32) if made else np.zeros((0, SIZE), np.float32)
        self.cache: dict[str, np.ndarray] = {}

    def _word(self, word: str) -> np.ndarray:
        """What a word adds to the decision of each pair; kept for the most frequent words."""
        if (out := self.cache.get(word)) is None:
            at, n = _features(word)
            out = self.weights[:, at].sum(axis=1, dtype=np.float64) / n
            if len(self.cache) < 200_000:
                self.cache[word] = out
        return out

    def decide(self, words: list[str]) -> tuple[str, float]:
        """The language of words and the least margin by which it won, of its family and within it; without another to win against the margin is 1."""
        scores = sum((self._word(w) for w in words), np.zeros(len(self.pairs))) / max(1, len(words)) if self.pairs else ()
        best, margin, inside = "", 1.0, sorted(self.langs)
        for whole in (True, False):
            votes, wins = Counter(), Counter()
            duels = [(a, b, s) for (kind, a, b), s in zip(self.pairs, scores) if kind == whole and a in inside]
            for a, b, s in duels:
                votes[a if s > 0 else b] += 1
                wins[a if s > 0 else b] += abs(s)
            best = max(inside, key=lambda x: (votes[x], wins[x], x))
            margin = min([margin, *(abs(s) for a, b, s in duels if best in (a, b))])
            inside = self.langs[best] if whole else inside
        return best, float(margin)


class Classifier:
    """Machines for each script, trained once on the driver and sent to the tasks, and the slope that turns margins into confidences."""

    def __init__(self, samples: list[tuple[str, str]], held_out: int = 3) -> None:
        rows: dict[str, list[tuple[str, list[str]]]] = {}
        for lang, text in samples:
            for part in segments(text):
                rows.setdefault(leading_script(part)[0], []).append((lang, _WORD.findall(part.lower())))
        self.slope = self._slope(rows, held_out)
        self.machines = {script: Machines(r) for script, r in rows.items() if script}

    @staticmethod
    def _slope(rows: dict[str, list[tuple[str, list[str]]]], parts: int) -> float:
        """The slope of the logistic function that tells confidence from margin: the one under which held-out samples, decided by machines that didn't see them, are likeliest; 12 if there are none."""
        margins = []
        for some in rows.values():
            for k in range(parts):
                known = Machines([r for i, r in enumerate(some) if i % parts != k])
                if known.pairs:
                    for lang, words in some[k::parts]:
                        found, margin = known.decide(words)
                        margins.append(margin if found == lang else -margin)
        m = np.array(margins)
        return max((2.0 ** (j / 2) for j in range(13)), key=lambda s: -np.log1p(np.exp(-np.clip(s * m, -500, 500))).sum()) if len(m) else 12.0

    def language(self, text: str) -> tuple[str, float]:
        """The language of a segment and the confidence, from 0 to 1; unknown without letters, or with those of a script that no sample has."""
        script, share = leading_script(text)
        if script not in self.machines:
            return "unknown", 0.0
        best, margin = self.machines[script].decide(_WORD.findall(text.lower()))
        return best, share / (1 + math.exp(-min(500.0, self.slope * margin)))


def _features(word: str) -> tuple[np.ndarray, int]:
    w = f"<{word}>"
    grams = [w, *(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1))]
    return np.array([xxhash.xxh32_intdigest(g) % SIZE for g in grams]), len(grams)


def _machine(a: list[list[str]], b: list[list[str]], rounds: int = 30, penalty: float = 1e-4) -> np.ndarray:
    """A linear support vector machine, positive for a, by subgradient descent on the hinge loss; the two sides weigh the same."""
    rows = []
    for side, texts in ((1.0, a), (-1.0, b)):
        for words in texts:
            if words:
                parts = [_features(w) for w in words]
                rows.append((side, np.concatenate([at for at, _ in parts]), np.concatenate([np.full(len(at), 1 / n / len(words)) for at, n in parts])))
    w, total, step = np.zeros(SIZE), np.zeros(SIZE), 0
    order, balance = np.random.default_rng(7), {1.0: len(rows) / 2 / max(1, len(a)), -1.0: len(rows) / 2 / max(1, len(b))}
    for _ in range(rounds):
        for k in order.permutation(len(rows)):
            side, at, value = rows[k]
            step += 1
            rate = 4 / (1 + step / len(rows))
            if side * (w[at] @ value) < 0.5:
                np.add.at(w, at, rate * side * balance[side] * value)
            w *= 1 - penalty * rate
        total += w
    return total / rounds


def leading_script(text: str) -> tuple[str, float]:
    """The script of most letters, and their share."""
    seen: Counter = Counter()
    for m in _SCRIPTS.finditer(text):
        seen[m.lastgroup] += m.end() - m.start()
    if not seen:
        return "", 0.0
    best, n = max(seen.items(), key=lambda x: (x[1], x[0]))
    return best, n / sum(seen.values())


def places(line: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, full) of each part of a line with words. full: it is a sentence, or a run of enough words without end marks; links hold no words."""
    at = 0
    line = _unlinked(line)
    for m in [*_END.finditer(line), None]:
        start, end, ended = at, m.end() if m else len(line), m is not None
        at = end
        part = line[start:end]
        n = len(_WORD.findall(part))
        if not n:
            continue
        if n > 4 * RUN_WORDS or not ended and n >= RUN_WORDS:
            yield from _runs(part, start)
        else:
            yield start + len(part) - len(part.lstrip()), start + len(part.rstrip()), ended and n >= SENTENCE_WORDS


def _unlinked(line: str) -> str:
    return _LINK.sub(lambda m: " " * len(m[0]), line)


def segments(line: str) -> Iterator[str]:
    """The full sentences of a line; of text without end marks, runs of words."""
    line = _unlinked(line)
    return (line[start:end] for start, end, full in places(line) if full)


def _runs(text: str, at: int) -> Iterator[tuple[int, int, bool]]:
    words = list(_TOKEN.finditer(text))
    for i in range(0, len(words), 2 * RUN_WORDS):
        part = words[i : i + 2 * RUN_WORDS]
        yield at + part[0].start(), at + part[-1].end(), i == 0 or len(part) >= RUN_WORDS


def line_segments(lines: list[tuple[int, str]], known: Classifier, notices: set[int] = frozenset()) -> list[tuple[int, int, str, float, int, bool]]:
    """(start, end, language, confidence, words, full) of each part of the lines, given with their places in the text. A part with the hash of a notice, of several in its line, is left out."""
    out = []
    for at, line in lines:
        plain = _unlinked(line)
        found = list(places(plain))
        for start, end, full in found:
            part = plain[start:end]
            if len(found) > 1 and _masked(part) in notices:
                continue
            out.append((at + start, at + end, *known.language(part), len(_WORD.findall(part)), full))
    return out


def languages(lines: list[tuple[int, str]], parts: list[tuple[int, int, str, float, int, bool]], known: Classifier) -> list[tuple[str, float]]:
    """(language, confidence) of each language with a full sentence in the lines, told from their segments.

    Segments of low confidence decide nothing. Where no line holds a full sentence, all
    words together decide; without words the language is unknown.
    """
    found: dict[str, list] = {}
    for _, _, lang, sure, n, full in parts:
        if full and lang != "unknown" and sure >= LEAST_SURE:
            entry = found.setdefault(lang, [0.0, 0])
            entry[0] += sure * n
            entry[1] += n
    if not found:
        return [known.language(" ".join(_unlinked(x) for _, x in lines))]
    return sorted((k, v[0] / v[1]) for k, v in found.items())


def training_rows(samples: DataFrame) -> list[tuple[str, str]]:
    rows = samples.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h")).orderBy("h").limit(TRAINING_ROWS).collect()
    return sorted((r["lang"], r["text"]) for r in rows)


def _masked(text: str) -> int:
    """A hash of what makes a sentence the same elsewhere: no case, spacing, digits or capitalised names."""
    return xxhash.xxh64_intdigest(_DROP.sub("", _NAME.sub("", text)).lower())


class Notices:
    """What stands in so many stories that it is no part of any: whole lines by their hashes, and the sentences of these lines, for texts without line ends."""

    def __init__(self, lines: list[tuple[int, str]]) -> None:
        self.lines = {m for m, _ in lines}
        self.sentences = {_masked(x[start:end]) for _, x in lines for start, end, _ in places(x)}


def article_lines(items: DataFrame, entities: DataFrame, aliases: DataFrame, text: str) -> tuple[DataFrame, Notices]:
    """(id, lines, masked, site): the lines of each text, in consistent form, with a hash of each and whether it is one of its source's site lines; and the lines in many stories, at most 1 / SHARE_OF_ALL times the lines of an item."""
    texts, needed = texts_of_sources(items, entities, aliases, text)
    masked = lambda x: content(F.regexp_replace(x, r"\b[A-Z][a-z]+\b", ""))
    lines = F.split("_text", "\n")
    named = texts.where("_text is not null").select(
        "id", "source_key", lines.alias("lines"), F.transform(lines, lambda x: F.when(content(x) != "", F.xxhash64(content(x)))).alias("names"),
        F.transform(lines, lambda x: F.xxhash64(masked(x))).alias("masked"),
    )
    named = named.withColumn("story", F.array_max(F.zip_with("lines", "masked", lambda x, m: F.struct(F.length(x).alias("n"), m.alias("m"))))["m"])
    named = stored(named, "articlelines")
    once = named.select("source_key", F.transform(F.filter("names", lambda n: n.isNotNull()), lambda n: F.struct(n.alias("name"))).alias("_lines"))
    common = common_lines(once, needed).groupBy("source_key").agg(F.collect_set("name").alias("_common"))  # per source at most 25 times the lines of an item
    stories = named.select("story", F.explode(F.array_distinct("masked")).alias("m")).distinct()
    least = named.agg(F.greatest(F.lit(float(LEAST_STORIES)), F.count_distinct("story") * SHARE_OF_ALL).alias("_least"))
    wide = stored(stories.groupBy("m").agg(F.count("*").alias("n")).crossJoin(F.broadcast(least)).where("n >= _least").select("m"), "wide")  # one row
    shown = named.select(F.explode(F.arrays_zip("masked", "lines")).alias("l")).select(F.col("l.masked").alias("m"), F.col("l.lines").alias("x")).join(small(wide), "m").groupBy("m").agg(F.min("x").alias("x"))
    notices = Notices([(r["m"], r["x"]) for r in shown.collect()])
    joined = named.join(small(stored(common, "common")), "source_key", "left")
    site = F.transform("names", lambda n: F.coalesce(F.array_contains("_common", n), F.lit(False)))
    return joined.select("id", "lines", "masked", site.alias("site")), notices


def item_segments(items: DataFrame, entities: DataFrame, aliases: DataFrame, samples: DataFrame, text: str = "clean_text_original") -> DataFrame:
    """(raw_item_id, segment, start, end, language, confidence): each segment with words of the article's own text, numbered from 1; as segment 0, each language of the item.

    start and end count characters of the text in consistent form, from 0, the end not
    included. Short sentences and rests have rows, and so do segments of low confidence,
    but a language of the item is one with a full sentence. Lines and sentences that
    stand in many stories are no segments. Null texts give no row; texts without words
    give only segment 0, unknown with confidence 0. Repeated rows give repeated rows.
    """
    lines, notices = article_lines(items, entities, aliases, text)
    sent = items.sparkSession.sparkContext.broadcast((Classifier(training_rows(samples)), notices))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, notices = sent.value
        for f in frames:
            out = []
            for i, lines, masked, site in zip(f["id"], f["lines"], f["masked"], f["site"]):
                starts = [0, *accumulate(len(x) + 1 for x in lines)]
                every = [(at, x) for at, x in zip(starts, lines) if x.strip()]
                own = [not s and int(m) not in notices.lines for s, m in zip(site, masked)]
                kept = [(at, x) for at, x, mine in zip(starts, lines, own) if mine and x.strip()]
                if not any(own) and not kept:
                    kept = every
                parts = line_segments(kept, known, notices.sentences)
                out += [(i, 0, 0, starts[-1] - 1, *found) for found in languages(kept, parts, known)]
                out += [(i, n, *p[:4]) for n, p in enumerate(parts, 1)]
            yield pd.DataFrame(out, columns=["raw_item_id", "segment", "start", "end", "language", "confidence"])

    return lines.mapInPandas(work, "raw_item_id long, segment int, start int, end int, language string, confidence double")


def item_languages(items: DataFrame, entities: DataFrame, aliases: DataFrame, samples: DataFrame, text: str = "clean_text_original") -> DataFrame:
    """(raw_item_id, language, confidence): a row for each language of each text; the rows of its segment 0."""
    return item_segments(items, entities, aliases, samples, text).where("segment = 0").select("raw_item_id", "language", "confidence")


def wrong_labels(items: DataFrame, found: DataFrame) -> DataFrame:
    """(raw_item_id, language): the languages of items whose label is missing or names others. Other spellings of the right language are right."""
    label = F.trim(F.lower(F.coalesce("language", F.lit(""))))
    names = F.create_map(*[F.lit(x) for pair in sorted(NAMES.items()) for x in pair])
    parts = F.filter(F.split(F.regexp_replace(label, "_", "-"), "-"), lambda x: x != "mixed")
    one = F.element_at(F.split(label, "[-_]"), 1)
    said = F.when(label.endswith("-mixed"), F.array_distinct(parts)).otherwise(F.array(F.coalesce(names[label], names[one], one)))
    labels = items.select(F.col("id").alias("raw_item_id"), label.alias("_label"), F.array_sort(said).alias("_said"), label.endswith("-mixed").alias("_mixed")).dropDuplicates(["raw_item_id"])
    sets = found.groupBy("raw_item_id").agg(F.array_sort(F.collect_set("language")).alias("_is"))
    joined = sets.join(labels, "raw_item_id")
    none = F.col("_is") == F.array(F.lit("unknown"))
    right = F.when(none, F.col("_label").isin("unknown", "und")).otherwise(~F.col("_label").isin(*MISSING) & (F.col("_said") == F.col("_is")) & ((F.size("_is") > 1) == F.col("_mixed")))
    return joined.where(~right).select("raw_item_id", F.explode("_is").alias("language"))
