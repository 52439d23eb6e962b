"""Lines that one source repeats in many of its items.

Method: a suffix array over the line identifiers of each source, built by prefix
doubling. Its ranks are the classes of suffixes with a common prefix of 2^k lines, each
named by a hash, as only their equality is asked for; so no task sorts a whole source.
Suffixes whose first line is too rare for a block are left out before the first doubling.
The longest common prefix of 2^k lines that enough items share is the block that starts
at a line. Blocks of at least `least_lines` lines are deleted from each item, as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import salted_join, stored
from .identity import with_identity
from .textform import suspect, to_consistent

LEAST_ITEMS, LEAST_PERCENT = 8, 4
#: Lines of the shortest block that is removed; a repeated line alone is one, as the statement of the problem has it.
LEAST_LINES = 1


def content(line: Column) -> Column:
    """What of a line, already free of disguises, is compared: no case, spacing or digits."""
    return F.lower(F.regexp_replace(line, r"(?U)[\s\p{N}]+", ""))


def line_names(text: Column) -> Column:
    """(line_no, name) of the lines with content of a text in consistent form."""
    named = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), F.when(content(x) != "", F.xxhash64(content(x))).alias("name")))
    return F.filter(named, lambda s: s["name"].isNotNull())


def _with_source(items: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    return with_identity(items, entities, aliases).withColumn("source_key", F.coalesce("source_key", F.lit("")))


def _thresholds(sources: DataFrame) -> DataFrame:
    """(source_key, _least): in how many items of a source a line must occur."""
    return sources.groupBy("source_key").agg(F.greatest(F.lit(LEAST_ITEMS), F.ceil(F.count("*") * LEAST_PERCENT / 100)).alias("_least"))


def common_lines(lines: DataFrame, needed: DataFrame) -> DataFrame:
    """(source_key, name) of lines in enough items. lines: source_key and _lines of each item; counted per item once, before any shuffle."""
    once = lines.select("source_key", F.explode(F.array_distinct(F.transform("_lines", lambda s: s["name"]))).alias("name"))
    return once.groupBy("source_key", "name").agg(F.count("*").alias("_in")).join(needed, "source_key").where("_in >= _least").select("source_key", "name")


def texts_of_sources(items: DataFrame, entities: DataFrame, aliases: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The items with their source_key and their texts in consistent form (_text), and the thresholds of the sources. Texts never leave their row, but for those with disguises."""
    kept = _with_source(items.select("id", "source_name", "metadata_json", F.col(text).alias("_text")), entities, aliases).select("id", "source_key", "_text")
    clean = kept.where(~F.col("_text").rlike(suspect()))
    rebuilt = stored(to_consistent(kept, ["id", "source_key"], "_text").select("id", "source_key", F.col("text_new").alias("_text")), "rebuilt")  # read more than once
    return clean.union(rebuilt), _thresholds(kept)


def _shared(names: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of (id, source_key, name, ...) whose name occurs in enough items of its source. Counted per item and part before the shuffle; a name may be hot."""
    per = names.select("source_key", "name", "id").distinct().groupBy("source_key", "name").agg(F.count("*").alias("_in"))
    often = per.join(needed, "source_key").where("_in >= _least").select("source_key", "name")
    return salted_join(names, often, ["source_key", "name"], F.col("id"))


def common_prefixes(suffixes: DataFrame, needed: DataFrame, least_lines: int = LEAST_LINES) -> DataFrame:
    """(id, seq, source_key, line_no, block, length): the suffixes with a prefix of `least_lines` lines that enough items share, and the longest such prefix. suffixes: id, source_key, seq, line_no and name, that of the first line, often enough.

    Doubling: the class of 2^(k+1) lines is that of 2^k here and of 2^k further on; k ends
    where no class is in enough items. Lengths tried are `least_lines` and the powers of
    two; as each part of a shared block is shared, no line of a longer one is missed.
    """
    levels = [suffixes.select("id", "source_key", "seq", "name")]

    def joined(level: DataFrame, step: int) -> DataFrame:
        after = level.select("id", (F.col("seq") - step).alias("seq"), F.col("name").alias("_next"))
        pairs = level.join(after, ["id", "seq"]).select("id", "source_key", "seq", F.xxhash64("name", "_next").alias("name"))
        return stored(_shared(pairs, needed), "level")

    while True:
        level = joined(levels[-1], 2 ** (len(levels) - 1))
        if not level.limit(1).count():
            break
        levels.append(level)
    known = {2**k: level for k, level in enumerate(levels) if 2**k >= least_lines}
    k = least_lines.bit_length() - 1
    if 2**k != least_lines and k < len(levels):  # two overlapping classes of 2^k lines
        known[least_lines] = joined(levels[k], least_lines - 2**k)
    every = None
    for n, level in known.items():
        one = level.select("id", "seq", "name", F.lit(n).alias("length"))
        every = one if every is None else every.union(one)
    if every is None:
        every = levels[0].select("id", "seq", "name", F.lit(1).alias("length")).limit(0)
    longest = every.groupBy("id", "seq").agg(F.max(F.struct("length", "name")).alias("_b"))
    return suffixes.drop("name").join(longest.select("id", "seq", F.col("_b.name").alias("block"), F.col("_b.length").alias("length")), ["id", "seq"])


def site_blocks(items: DataFrame, entities: DataFrame, aliases: DataFrame, text: str = "clean_text_original", least_lines: int = LEAST_LINES) -> tuple[DataFrame, DataFrame]:
    """The lines of repeated blocks and where blocks start.

    lines: (id, source_key, seq, line_no, name), the lines that may be in a block, seq
    counting the lines with content. starts: (id, seq, source_key, line_no, block, length),
    for each line at which a block of at least `least_lines` lines starts its longest one;
    block names the sequence within its source. A block occurs in at least LEAST_ITEMS
    items and LEAST_PERCENT in 100 items of its source, null and empty texts counting as
    items. Lines without content break no block and are never in one. Items without
    source name count as one source.
    """
    texts, needed = texts_of_sources(items, entities, aliases, text)
    lines = stored(texts.select("id", "source_key", line_names(F.col("_text")).alias("_lines")), "lines")
    needed = stored(needed, "thresholds")
    starts = lines.select("id", "source_key", F.posexplode("_lines").alias("seq", "_l")).select("id", "source_key", "seq", "_l.line_no", "_l.name")
    first = stored(salted_join(starts, common_lines(lines, needed), ["source_key", "name"], F.col("id")), "level")
    return first, common_prefixes(first, needed, least_lines)


def site_lines(items: DataFrame, entities: DataFrame, aliases: DataFrame, text: str = "clean_text_original", least_lines: int = LEAST_LINES) -> DataFrame:
    """(raw_item_id, line_no) of the lines that repeated blocks of at least `least_lines` lines cover. A repeated row of an item counts as the item."""
    lines, starts = site_blocks(items, entities, aliases, text, least_lines)
    if least_lines == 1:  # each covered line starts a block of its own
        return starts.select(F.col("id").alias("raw_item_id"), "line_no").distinct()
    covered = lines.join(starts.select("id", "seq", "length"), ["id", "seq"], "left")
    ends = F.max(F.col("seq") + F.col("length")).over(Window.partitionBy("id").orderBy("seq"))  # the lines of one item
    return covered.withColumn("_end", ends).where("seq < _end").select(F.col("id").alias("raw_item_id"), "line_no").distinct()


def without_site_lines(items: DataFrame, entities: DataFrame, aliases: DataFrame, text: str = "clean_text_original", least_lines: int = LEAST_LINES) -> DataFrame:
    """(raw_item_id, text, lines_removed): each item's text without the repeated blocks of its source; null texts stay null."""
    gone = site_lines(items, entities, aliases, text, least_lines).groupBy("raw_item_id").agg(F.collect_set("line_no").alias("_gone"))
    kept = F.filter(F.split("_text", "\n"), lambda x, i: ~F.array_contains("_gone", (i + 1).cast("long")))
    given = items.select(F.col("id").alias("raw_item_id"), F.col(text).alias("_text")).join(gone, "raw_item_id", "left")
    return given.select("raw_item_id", F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size("_gone"), F.lit(0)).alias("lines_removed"))
