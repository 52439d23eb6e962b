"""The main body of pages.

Method: two passes of block rules. A block is a line of the page, or of a line that holds
several elements each element with text. First each block is judged by itself: its
length, its density of common words, its density of links, and whether the same line
stands on the pages of many stories. Then ambiguous short blocks inherit from the nearest
decided neighbours in the same part of the page. Parts are told apart by their place in
the document and their kind, so paragraphs that each sit in an element of their own, or
an article in several, are one part; parts other than that with most of the decided text,
and headlines above it, are dropped.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small, stored
from .identity import with_identity
from .textform import consistent, is_suspect

#: A line on the pages of so many different stories is no part of any of them: this many, and this share of all stories, or that share of the stories of its source.
LEAST_STORIES, SHARE_OF_ALL, SHARE_OF_SOURCE = 8, 0.001, 0.04
#: A block of so many characters can be decided by itself; one of so many words with the name of the source, or without a sentence, is short.
LONG, SHORT_WORDS = 45, 14
#: Least density of common words in a block that is decided as text by itself; density of linked words from which a block is no text.
COMMON_SHARE, LINKED_SHARE = 0.05, 0.75
_TAG = re.compile(r"<(/?)([a-zA-Z!][a-zA-Z0-9]*)([^>]*)>")
_CLASS = re.compile(r"\bclass\s*=\s*[\"']?([^\"'>]*)")
_LINK = re.compile(r"<a\b[^>]*>(.*?)</a>", re.S | re.I)
#: A link that ends where another block begins: a headline of another story, with or without a teaser.
_TEASER = re.compile(r"</a>\s*<(?:p|div|br|h[1-6]|ul|li)\b", re.I)
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_NAME = re.compile(r"\b[A-Z][a-z]+\b")
_DROP = regex.compile(r"[\s\p{N}]+")
_SENTENCE = regex.compile(r"[.!?।॥…][\"'”’»)\]]*$")
_HIDDEN = {"script", "style", "title", "head", "html", "!doctype", "meta", "link", "noscript"}
_PARTS = {"div", "td", "article", "main", "section", "aside", "nav", "footer", "header", "body", "form"}
#: Characters of text that a headline in or above a part is worth.
HEADLINE = 200
#: Elements with which a new block of a line begins; a teaser stays with the link before it.
ELEMENTS = "p|h[1-6]|li|ul|ol|div|section|article|main|aside|nav|header|footer|td|tr|table|blockquote|form|body|script|style|title|meta"
SPLIT = rf"(?i)(?<!</a>)(?=<(?:{ELEMENTS})\b)"
_SPLIT, _OPENS = re.compile(SPLIT), re.compile(rf"<(?:{ELEMENTS})\b", re.I)
#: Elements that open in a line from which it is taken apart.
MANY = 3
_ASIDE = {"nav", "footer", "aside", "header", "form", "small", "button"}


def line_key(text: str) -> int:
    """A hash of what makes a line the same on other pages: no case, spacing, digits, disguises or capitalised names."""
    plain = consistent(text) if is_suspect(text) else text
    return xxhash.xxh64_intdigest(_DROP.sub("", _NAME.sub("", plain).lower())) - (1 << 63)


def sub_lines(line: str) -> list[str]:
    """The blocks of a line: itself, or, where MANY elements open in it, a block for each."""
    if line.count("<") < 2 * MANY or len(_OPENS.findall(line)) < MANY:
        return [line]
    return _SPLIT.sub("\n", line).split("\n")


def blocks(page: str, title: str | None, names: tuple[str, ...], common: frozenset[str]) -> list[tuple]:
    """The blocks with text of a page: (line_no, part, kind, aside, length, words, outside links, sentence, common share, headline, source named, key, digits, sign, number within the line, parts above)."""
    marked = "</" in page and "<" in page
    shown = _plain(title or "")
    keys: dict[tuple, int] = {}
    out, stack, hidden = [], [(0, "")], False
    lines = ((n, k, x) for n, line in enumerate(page.split("\n"), 1) for k, x in enumerate(sub_lines(line)))
    for number, sub, line in lines:
        if "<" not in line:
            if line.strip() and not hidden:
                out.append((*_block(number, stack[-1][0], "br" if marked else "", any(t in _ASIDE for _, t in stack), line, "", shown, names, common), sub, [p for p, _ in stack]))
            continue
        tags = _TAG.findall(line)
        first = next((t.lower() for c, t, _ in tags if not c), "")
        if first in _HIDDEN or hidden:
            if m := re.search(r"<title>(.*?)</title>", line, re.S | re.I):
                shown = shown or _plain(html.unescape(m[1]).rsplit("|", 1)[0])
                names = (*names, html.unescape(m[1]).rpartition("|")[2].strip().lower()) if "|" in m[1] else names
            hidden = (hidden or first in ("script", "style")) and not re.search(r"</(script|style)>", line, re.I)
            line = ""
        opened: list[tuple[int, str]] = []
        at, before = list(stack), any(t in _ASIDE for _, t in stack)
        for close, tag, rest in tags:
            tag = tag.lower()
            if tag not in _PARTS:
                continue
            if not close:
                m = _CLASS.search(rest)
                kind = (stack[-1][0], tag, m[1] if m else "")  # elements of one kind and place are one part
                stack.append((keys.setdefault(kind, len(keys) + 1), tag))
                opened.append(stack[-1])
            elif any(t == tag for _, t in stack[1:]):
                while stack.pop()[1] != tag:
                    pass
        text = _TAG.sub("", line)
        if text.strip():
            left = [o for o in opened if o in stack]  # what is opened and closed in one line is text of the part around it
            place = [*at, *left] if left else at
            small = before or any(t.lower() in _ASIDE for c, t, _ in tags if not c)
            kind = first if first not in ("div", "span", "td", "section") or "class=" not in line.partition(">")[0] else "class"
            if first == "p" and "class=" in line.partition(">")[0]:
                kind = "class"
            out.append((*_block(number, place[-1][0], kind, small, line, text, shown, names, common), sub, [p for p, _ in place]))
    return out


def _plain(text: str) -> str:
    return _DROP.sub("", consistent(text) if is_suspect(text) else text).lower()


def _block(number: int, part: int, kind: str, aside: bool, line: str, text: str, shown: str, names: tuple[str, ...], common: frozenset[str]) -> tuple:
    linked = ""
    if text:
        linked = " ".join(_TAG.sub("", x) for x in _LINK.findall(line))
        text = html.unescape(text)
    else:
        text = html.unescape(line)
    text = text.strip()
    low = text.lower()
    words = _WORD.findall(low)
    share = sum(w in common for w in words) / max(1, len(words))
    outside = 0 if _TEASER.search(line) else len(words) - len(_WORD.findall(html.unescape(linked).lower()))
    own = any(n in low for n in names if n)
    return (number, part, kind, aside, len(text), len(words), outside, bool(_SENTENCE.search(text)), share, bool(shown) and _plain(text) == shown, own, line_key(text), sum(c.isdigit() for c in text), low.startswith("by ") or " | " in text or "©" in text)


KINDS = ("", "br", "p", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "class", "other")
_NO, _PART, _KIND, _ASIDE_, _LEN, _WORDS, _OUT, _SENT, _SHARE, _HEAD, _OWN, _KEY, _DIG, _SIGN, _SUB, _ABOVE = range(16)


def main_lines(found: list[tuple], often: dict[int, bool]) -> list[tuple[int, int]]:
    """The blocks of the main body, each as the number of its line and its number within. often: keys of lines on many stories' pages; True for those that are mostly headings."""
    label: list[str] = []
    for b in found:
        heading = b[_KIND] in ("h2", "h3", "h4", "h5", "h6")
        if b[_HEAD] or b[_KIND] == "h1":
            label.append("head")
        elif b[_ASIDE_] or not b[_WORDS] or 1 - b[_OUT] / b[_WORDS] >= LINKED_SHARE:
            label.append("bad")
        elif heading or often.get(b[_KEY]):
            label.append("heading")
        elif b[_KEY] in often:
            label.append("bad")
        elif (b[_WORDS] <= SHORT_WORDS and (b[_OWN] or b[_SIGN])) or (b[_DIG] >= 6 and b[_WORDS] <= 6 and not b[_SENT]):
            label.append("bad")
        elif b[_SENT] and b[_LEN] >= LONG and b[_SHARE] >= COMMON_SHARE:
            label.append("good")
        elif b[_KIND] == "class" and not b[_SENT]:
            label.append("bad")
        else:
            label.append("short")
    # The part of the page with most of the decided text; one that holds the headline, or lies below it, is preferred.
    weight: Counter = Counter()
    heads = {b[_PART] for b, x in zip(found, label) if x == "head"}
    for b, x in zip(found, label):
        if x == "good":
            weight[b[_PART]] += b[_LEN]
    for part, above in {b[_PART]: b[_ABOVE] for b, x in zip(found, label) if x in ("good", "head")}.items():
        if heads & {part, *above}:
            weight[part] += HEADLINE
    if not weight:
        return []
    main = max(weight, key=lambda p: (weight[p], -p))
    above = next(set(b[_ABOVE]) for b in found if b[_PART] == main)
    inside = [k for k, b in enumerate(found) if b[_PART] == main or (label[k] == "head" and b[_PART] in above)]
    if found and not any(b[_KIND] for b in found):  # a page that lost its markup: nothing before the headline, nor after the last text, is body
        heads = [k for k in inside if label[k] == "head"]
        if heads:
            inside = [k for k in inside if k >= heads[-1]]
    decided = {"good": True, "head": True, "bad": None}
    out = []
    for n, k in enumerate(inside):
        x = label[k]
        if x in ("good", "head"):
            out.append((found[k][_NO], found[k][_SUB]))
            continue
        if x == "bad":
            continue
        left = next((label[j] for j in reversed(inside[:n]) if decided.get(label[j])), "")
        right = next((label[j] for j in inside[n + 1 :] if decided.get(label[j])), "")
        kind, long = found[k][_KIND], found[k][_LEN] >= 2 * LONG and found[k][_WORDS] >= SHORT_WORDS - 2
        heading = x == "heading" and (right == "good" or (left and kind[:1] == "h"))
        # Without markup a line that is no sentence may as well be a link to another story.
        if heading or (x == "short" and ((right == "good" and left and kind) or (left and kind != "class" and (found[k][_SENT] or (long and kind))))):
            out.append((found[k][_NO], found[k][_SUB]))
    return out


def common_words(samples: DataFrame, least: float = 0.003) -> frozenset[str]:
    """Words in at least that share of all sample texts, and in two: at most 1 / least times the words of a text."""
    words = samples.where("text is not null").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))).alias("w"))
    enough = max(2, least * samples.where("text is not null").count())
    return frozenset(r["w"] for r in words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= enough).collect())


_COLUMNS = ("line_no", "part", "kind", "aside", "length", "words", "outside", "sentence", "share", "headline", "own", "key", "digits", "sign", "sub", "above")
_TYPES = ("int", "int", "int", "boolean", "int", "int", "int", "boolean", "float", "boolean", "boolean", "long", "int", "boolean", "int", "array<int>")


def page_blocks(pages: DataFrame, samples: DataFrame, page: str) -> DataFrame:
    """(id, source_key, story, and an array for each of _COLUMNS): what the rules need of each page, without its text. pages: id, source_key, source_name, title and the page. story is the key of the longest line."""
    common = common_words(samples)
    number = {k: i for i, k in enumerate(KINDS)}

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: dict[str, list] = {c: [] for c in ("id", "source_key", "story", *_COLUMNS)}
            for i, source, name, title, text in zip(f["id"], f["source_key"], f["source_name"], f["title"], f["_page"]):
                found = blocks(text, title, ((name or "").strip().lower(),), common)
                if not found:
                    continue
                out["id"].append(i)
                out["source_key"].append(source)
                out["story"].append(max(found, key=lambda b: b[_LEN])[_KEY])
                for c, values in zip(_COLUMNS, zip(*found)):
                    out[c].append([number.get(v, len(KINDS) - 1) for v in values] if c == "kind" else list(values))
            yield pd.DataFrame(out)

    given = pages.select("id", "source_key", "source_name", "title", F.col(page).alias("_page")).where("_page is not null and _page <> ''")
    return given.mapInPandas(work, "id long, source_key string, story long, " + ", ".join(f"{c} array<{t}>" for c, t in zip(_COLUMNS, _TYPES)))


def repeated_lines(found: DataFrame) -> DataFrame:
    """(source_key, key, heading) of the lines that stand on the pages of many stories; source_key is null for those of all sources. heading: mostly marked as a heading."""
    heads = [KINDS.index(h) for h in ("h2", "h3", "h4", "h5", "h6")]
    lines = found.select("source_key", "story", F.explode(F.arrays_zip("key", "kind")).alias("l")).select("source_key", "story", "l.key", "l.kind")
    per = lines.groupBy("source_key", "key", "story").agg(F.sum((F.col("kind") != 0).cast("int")).alias("marked"), F.sum(F.col("kind").isin(heads).cast("int")).alias("heads"))
    per = stored(per, "linestories")
    stories = found.select("source_key", "story").distinct()
    of_source = stories.groupBy("source_key").agg(F.greatest(F.lit(float(LEAST_STORIES)), F.count("*") * SHARE_OF_SOURCE).alias("_least"))
    of_all = stories.agg(F.greatest(F.lit(float(LEAST_STORIES)), F.count_distinct("story") * SHARE_OF_ALL).alias("_least"))
    heading = (F.sum("heads") * 2 > F.sum("marked")).alias("heading")
    narrow = per.groupBy("source_key", "key").agg(F.count("*").alias("n"), heading).join(of_source, "source_key").where("n >= _least").select("source_key", "key", "heading")
    once = per.groupBy("key", "story").agg(F.sum("heads").alias("heads"), F.sum("marked").alias("marked"))
    wide = once.groupBy("key").agg(F.count("*").alias("n"), heading).crossJoin(F.broadcast(of_all)).where("n >= _least").select(F.lit(None).cast("string").alias("source_key"), "key", "heading")  # one row
    return narrow.union(wide)


def body_blocks(items: DataFrame, entities: DataFrame, aliases: DataFrame, samples: DataFrame, page: str = "raw_text_original") -> DataFrame:
    """(raw_item_id, line_no, sub): the blocks of each page that hold its main body; sub numbers the blocks of a line from 0.

    Pages that lost their markup are judged by the same rules, a line being a block.
    Null and empty pages and pages without any decided text give no row. Repeated rows
    of an id give the blocks of one of them.
    """
    named = with_identity(items.select("id", "source_name", "metadata_json", "title", page), entities, aliases).withColumn("source_key", F.coalesce("source_key", F.lit("")))
    found = stored(page_blocks(named, samples, page), "blocks").dropDuplicates(["id"])
    often = stored(repeated_lines(found), "repeated")
    lines = found.select("id", "source_key", F.explode(F.array_distinct("key")).alias("key"))
    narrow = lines.join(small(often.where("source_key is not null")), ["source_key", "key"]).select("id", "key", "heading")
    wide = lines.select("id", "key").join(small(often.where("source_key is null").select("key", "heading")), "key").select("id", "key", "heading")
    hits = narrow.union(wide).groupBy("id").agg(F.collect_set("key").alias("_keys"), F.collect_set(F.when(F.col("heading"), F.col("key"))).alias("_heads"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, numbers, subs = [], [], []
            for row in f.itertuples(index=False):
                columns = [getattr(row, c) for c in _COLUMNS]
                columns[_KIND] = [KINDS[k] for k in columns[_KIND]]
                heads = set(row.heads_) if row.heads_ is not None else set()
                often = {int(k): k in heads for k in row.keys_} if row.keys_ is not None else {}
                for n, k in main_lines(list(zip(*columns)), often):
                    ids.append(row.id)
                    numbers.append(int(n))
                    subs.append(int(k))
            yield pd.DataFrame({"raw_item_id": pd.Series(ids, dtype="int64"), "line_no": pd.Series(numbers, dtype="int64"), "sub": pd.Series(subs, dtype="int32")})

    whole = found.join(hits, "id", "left").select("id", *_COLUMNS, F.col("_keys").alias("keys_"), F.col("_heads").alias("heads_"))
    return whole.mapInPandas(work, "raw_item_id long, line_no long, sub int")


def body_lines(items: DataFrame, entities: DataFrame, aliases: DataFrame, samples: DataFrame, page: str = "raw_text_original") -> DataFrame:
    """(raw_item_id, line_no): the lines, numbered from 1, in which there are blocks of the main body; a line that holds several has a row once."""
    return body_blocks(items, entities, aliases, samples, page).select("raw_item_id", "line_no").distinct()


def main_bodies(items: DataFrame, entities: DataFrame, aliases: DataFrame, samples: DataFrame, page: str = "raw_text_original") -> DataFrame:
    """(raw_item_id, body): the text of the main body of each page; pages without one give no row. Tags are taken off in the JVM."""
    kept = body_blocks(items, entities, aliases, samples, page).groupBy("raw_item_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "sub"))).alias("_numbers"))
    texts = items.select(F.col("id").alias("raw_item_id"), F.col(page).alias("_page")).join(kept, "raw_item_id").withColumn("_lines", F.split("_page", "\n"))
    line = lambda n: F.element_at("_lines", n["line_no"].cast("int"))
    opens = F.lit(rf"(?i)<(?:{ELEMENTS})\b")
    block = lambda n: F.when(F.regexp_count(line(n), opens) < MANY, line(n)).otherwise(F.element_at(F.split(F.regexp_replace(line(n), SPLIT, "\n"), "\n"), n["sub"] + 1))
    bare = lambda n: F.trim(F.regexp_replace(block(n), "<[^>]*>", ""))
    return texts.select("raw_item_id", F.array_join(F.transform("_numbers", bare), "\n").alias("body"))
