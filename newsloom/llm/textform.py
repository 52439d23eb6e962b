"""Texts that look the same, brought to one form.

Method: fields that hold a suspect character are cut at plain spaces, the suspect
tokens exploded to positioned code points, joined (broadcast) with a table of
decompositions and look-alikes, combining marks ordered by class, recomposed,
and the strings rebuilt. Clean tokens and fields never leave their row.
`consistent` is the same rule for one string, for use inside other operators.
"""

from __future__ import annotations

import re
import unicodedata as U
from functools import cache

import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Letters of other alphabets that look like Latin ones.
GREEK_LIKE = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινοκρυχ", "ABEZHIKMNOPTYXaivokpux"))
CYRILLIC_LIKE = dict(zip("АВЕКМНОРСТУХІЈЅаеорсухіјѕһԁԛԝ", "ABEKMHOPCTYXIJSaeopcyxijshdqw"))
# Tamil digits and the letters they look like.
TAMIL_DIGIT_LIKE = {"௧": "க", "௨": "உ", "௪": "ச", "௫": "ரு", "௭": "எ", "௮": "அ", "௰": "ய"}
# Characters that show nothing, beside those of the category Cf.
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
JOINERS, DEVANAGARI_VIRAMA, EMOJI_STYLE = "‌‍", "्", "️"
#: Tags of compatibility decompositions that mean another form of the same letter or digit.
OTHER_FORM = {"<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Letters that a compatibility mapping decomposes though they are the usual form.
USUAL = [(0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7A3)]
TO_LATIN = GREEK_LIKE | CYRILLIC_LIKE
FROM_LATIN = {"GREEK": {b: a for a, b in GREEK_LIKE.items()}, "CYRILLIC": {b: a for a, b in CYRILLIC_LIKE.items()}}
_EMOJI = regex.compile(r"\p{Extended_Pictographic}|[\U0001F3FB-\U0001F3FF]")


def _script(ch: str) -> str:
    """LATIN, GREEK, CYRILLIC, TAMIL, TAMIL_DIGIT, MARK or OTHER for characters of words; empty for all else."""
    kind = U.category(ch)
    if kind[0] == "M":
        return "MARK" if ord(ch) < 0x900 else "TAMIL" if 0xB80 <= ord(ch) < 0xC00 else "OTHER"
    if 0xBE6 <= ord(ch) <= 0xBF2:
        return "TAMIL_DIGIT"
    if kind[0] != "L" and kind != "Nd":
        return ""
    name = U.name(ch, "").partition(" ")[0]
    return name if kind[0] == "L" and name in ("LATIN", "GREEK", "CYRILLIC", "TAMIL") else "OTHER"


@cache
def _code_points() -> dict[str, tuple[str, str]]:
    """Each character that isn't always kept as it is: (rule, decomposition); rule is unseen, joiner, style, space or form."""
    out: dict[str, tuple[str, str]] = {}
    for c in [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0080)]:
        ch = chr(c)
        kind = U.category(ch)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if ch in JOINERS:
            out[ch] = ("joiner", "")
        elif ch == EMOJI_STYLE:
            out[ch] = ("style", "")
        elif (kind == "Cf" and not 0x600 <= c <= 0x605 and c != 0x6DD) or ch in UNSEEN:
            out[ch] = ("unseen", "")
        elif kind == "Zs":
            out[ch] = ("space", " ")
        elif kind in ("Zl", "Zp"):
            out[ch] = ("space", " ")
        elif d := U.decomposition(ch):
            usual = any(a <= c <= b for a, b in USUAL)
            if d[0] != "<":
                out[ch] = ("form", U.normalize("NFD", ch))
            elif not usual and d.split()[0] in OTHER_FORM and (kind[0] == "L" or kind == "Nd" or d.split()[0] in ("<wide>", "<narrow>")):
                out[ch] = ("form", U.normalize("NFD", U.normalize("NFKC", ch)))
    return out


@cache
def _compositions() -> dict[str, str]:
    """Canonical pairs: two characters and the one that they make."""
    return {d: ch for ch, (rule, d) in ((c, (r, U.normalize("NFD", c))) for c, (r, _) in _code_points().items() if r == "form" and U.normalize("NFC", c) == c) if len(d) == 2} | {
        U.normalize("NFC", d[:-1]) + d[-1]: ch
        for ch, (rule, _) in _code_points().items()
        if rule == "form" and U.normalize("NFC", ch) == ch and len(d := U.normalize("NFD", ch)) > 2 and len(U.normalize("NFC", d[:-1])) == 1
    }


def _ranges(chars: set[str], java: bool) -> str:
    """The characters as the inside of a character class."""
    points, out = sorted(map(ord, chars)), []
    start = last = points[0]
    for c in [*points[1:], 0x7FFFFFFF]:
        if c != last + 1:
            write = (lambda x: f"\\x{{{x:X}}}") if java else (lambda x: f"\\U{x:08X}")
            out.append(write(start) + (f"-{write(last)}" if last > start else ""))
            start = c
        last = c
    return "".join(out)


def unless_usual(starts: set[str]) -> str:
    """A look-ahead for Java that leaves common letters soon where a match can only start with one of `starts`. Java tries the ranges of a class one by one, so the long runs of letters that start nothing come first."""
    gaps, start = [], 0
    for c in [*sorted(map(ord, starts)), 0x3400]:
        if c > start and any(start <= b and c - 1 >= a for a, b in ((0, 0x17F), (0x900, 0xDFF), (0x2010, 0x2027))):
            gaps.append((start, c - 1))
        start = c + 1
    gaps = sorted(sorted(gaps, key=lambda r: r[0] - r[1])[:24])
    return "(?![" + "".join(f"\\x{{{x:X}}}-\\x{{{y:X}}}" for x, y in gaps) + "])"


@cache
def suspect(java: bool = True) -> str:
    """A pattern that finds every text which `consistent` may change; a text without a match is in its one form."""
    single = {ch for ch, (rule, d) in _code_points().items() if rule != "form" or U.normalize("NFC", ch) != ch or d != U.normalize("NFD", ch)}
    single |= {chr(c) for c in range(0x300, 0x370)} | {chr(c) for c in range(0x370, 0x530) if _script(chr(c)) in ("GREEK", "CYRILLIC")}
    pairs = [p for p in _compositions() if p[1] not in single]
    firsts, seconds = {p[0] for p in pairs}, {p[1] for p in pairs}
    marks = {chr(c) for c in range(0x590, 0x1000) if U.combining(chr(c))}
    early, nukta, digits = {m for m in marks if ord(m) < 0x900}, {m for m in marks if U.combining(m) == 7}, set(TAMIL_DIGIT_LIKE)
    cls = lambda chars: f"[{_ranges(set(chars), java)}]"
    tamil, virama = cls(map(chr, range(0xB80, 0xBE6))), cls(m for m in marks if U.combining(m) == 9)
    branches = [
        cls(single),
        cls(seconds) + f"(?<={cls(firsts)}{cls(seconds)})",
        f"{cls(digits)}(?:(?={tamil})|(?<={tamil}{cls(digits)}))",
        cls(nukta) + f"(?<={virama}{cls(nukta)})",
        cls(early) + "{2}",
    ]
    ahead = unless_usual(single | seconds | digits | nukta | early) if java else ""
    return f"{ahead}(?:{'|'.join(branches)})"


@cache
def _suspect_python() -> re.Pattern:
    return re.compile(suspect(java=False))


def is_suspect(text: str) -> bool:
    return not text.isascii() and (_suspect_python().search(text) is not None or not U.is_normalized("NFC", text))


_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}௰-௲]+")


def _word(w: str) -> str:
    """A word whose unseen characters are gone, with the letters and digits of another kind replaced."""
    have = {_script(c) for c in w}
    if "TAMIL" in have and "TAMIL_DIGIT" in have:
        w = regex.sub(r"(?<![௦-௲])[௧௨௪௫௭௮௰](?![௦-௲])", lambda m: TAMIL_DIGIT_LIKE[m[0]], w)
    if "LATIN" in have:
        for other in ("CYRILLIC", "GREEK"):
            if other in have:
                foreign = {c for c in w if _script(c) == other}
                latin = {c for c in w if _script(c) == "LATIN"}
                if foreign <= TO_LATIN.keys():
                    w = "".join(TO_LATIN.get(c, c) if c in foreign else c for c in w)
                elif latin <= FROM_LATIN[other].keys():
                    w = "".join(FROM_LATIN[other].get(c, c) if c in latin else c for c in w)
    return w


def _keeps(ch: str, before: str, after: str) -> bool:
    """Whether a joiner or style sign between these characters is needed."""
    if ch == EMOJI_STYLE:
        return bool(before) and (U.category(before) in ("So", "Sm", "Sk") or before in "#*0123456789‼⁉↔")
    if before == DEVANAGARI_VIRAMA and "ऄ" <= after <= "ह":
        return True
    return ch == "‍" and bool(before) and bool(after) and bool((_EMOJI.match(before) or before == EMOJI_STYLE) and _EMOJI.match(after))


def consistent(text: str) -> str:
    """One string in its consistent form; the rule of `to_consistent` without Spark."""
    if not is_suspect(text):
        return text
    table, out = _code_points(), []
    for i, ch in enumerate(text):
        rule, d = table.get(ch, ("", ch))
        if rule in ("joiner", "style"):
            d = ch if _keeps(ch, text[i - 1 : i], text[i + 1 : i + 2]) else ""
        out.append(d)
    return U.normalize("NFC", _WORD.sub(lambda m: _word(m[0]), "".join(out)))


def _mapping(spark: SparkSession) -> DataFrame:
    """The table of code points: ch, rule, script, look (Latin look-alike), back (look-alikes of a Latin letter), parts (decomposition with classes). Bounded by Unicode."""
    table = _code_points()
    chars = set(table) | set(TO_LATIN) | set(TAMIL_DIGIT_LIKE) | set(TO_LATIN.values()) | {chr(c) for c in range(0x80, 0x3400) if U.category(chr(c))[0] in "LMN"} | {c for c in map(chr, range(128)) if c.isalnum()}
    emoji = [chr(c) for c in [*range(0x2190, 0x2C00), *range(0x1F000, 0x1FB00)] if _EMOJI.match(chr(c))]
    rows = []
    for ch in sorted(chars | set(emoji)):
        rule, d = table.get(ch, ("", ch))
        kind = U.category(ch)
        around = "virama" if ch == DEVANAGARI_VIRAMA else "consonant" if "ऄ" <= ch <= "ह" else "emoji" if _EMOJI.match(ch) else "style" if ch == EMOJI_STYLE else "sign" if kind in ("So", "Sm", "Sk") or ch in "#*0123456789‼⁉" else ""
        rows.append((ch, rule, around, [(x, U.combining(x), _script(x), TO_LATIN.get(x, TAMIL_DIGIT_LIKE.get(x)), FROM_LATIN["GREEK"].get(x), FROM_LATIN["CYRILLIC"].get(x)) for x in d]))
    return spark.createDataFrame(rows, "ch string, rule string, around string, parts array<struct<x:string,ccc:int,script:string,look:string,greek:string,cyrillic:string>>")


def _composed(group: Column, pairs: Column) -> Column:
    """The string of one starter and its marks, given as an array of (ccc, x) in canonical order."""

    def step(acc: Column, m: Column) -> Column:
        made = pairs[F.concat(acc["starter"], m["x"])]
        free = (F.length(acc["rest"]) == 0) | ((acc["last"] < m["ccc"]) & (acc["last"] != 0))
        fits = made.isNotNull() & free
        return F.struct(
            F.when(fits, made).otherwise(acc["starter"]).alias("starter"),
            F.when(fits, acc["rest"]).otherwise(F.concat(acc["rest"], m["x"])).alias("rest"),
            F.when(fits, acc["last"]).otherwise(m["ccc"]).alias("last"),
        )

    first = F.struct(group[0]["x"].alias("starter"), F.lit("").alias("rest"), F.lit(0).alias("last"))
    folded = F.aggregate(F.slice(group, 2, F.greatest(F.size(group) - 1, F.lit(0))), first, step, lambda a: F.concat(a["starter"], a["rest"]))
    return F.when(F.size(group) == 1, group[0]["x"]).otherwise(folded)


def to_consistent(fields: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Brings a text column to one consistent form.

    fields: `keys` and the text; rows repeated as a whole come out once, rows with
    the same keys and other texts each come out. Result: keys, text, `text_new`
    for the rows whose text holds a suspect character (whether or not it changed).
    A text without one is already in its form, so it isn't in the result; null and
    empty texts never are. Other columns are not carried, so no names can clash.
    """
    spark = fields.sparkSession
    pattern = suspect()
    held = fields.select(*keys, F.col(text).alias("_text")).where(F.col("_text").rlike(pattern)).withColumn("_id", F.xxhash64("_text")).dropDuplicates([*keys, "_id"])
    named, keys = keys, [*keys, "_id"]
    cut = held.select(*keys, F.posexplode(F.split("_text", " ")).alias("_tok", "_token")).where(F.col("_token").rlike(pattern))
    chars = cut.select(*keys, "_tok", F.posexplode(F.regexp_extract_all("_token", F.lit("(?s)."), F.lit(0))).alias("_pos", "ch"))
    known = chars.join(F.broadcast(_mapping(spark)), "ch", "left")  # about 9,000 rows, fixed by Unicode
    token = Window.partitionBy(*keys, "_tok").orderBy("_pos")
    before, after = F.lag("around").over(token), F.lead("around").over(token)
    needed = (
        F.when(F.col("rule") == "style", before.isin("emoji", "sign"))
        .when((F.col("rule") == "joiner") & (before == "virama") & (after == "consonant"), True)
        .otherwise((F.col("ch") == "‍") & before.isin("emoji", "style") & (after == "emoji"))
    )
    kept = known.withColumn("_needed", F.coalesce(needed, F.lit(False))).where(~F.coalesce(F.col("rule"), F.lit("")).isin("unseen", "joiner", "style") | F.col("_needed"))
    plain = F.array(F.struct(F.col("ch").alias("x"), F.lit(0).alias("ccc"), F.lit("").alias("script"), F.lit(None).cast("string").alias("look"), F.lit(None).cast("string").alias("greek"), F.lit(None).cast("string").alias("cyrillic")))
    split = kept.select(*keys, "_tok", "_pos", F.posexplode(F.when(F.size("parts") > 0, F.col("parts")).otherwise(plain)).alias("_sub", "p")).select(*keys, "_tok", "_pos", "_sub", "p.*")
    # Words: runs of letters, marks and digits. What a word holds decides which of its letters stand in for others.
    at = Window.partitionBy(*keys, "_tok").orderBy("_pos", "_sub")
    split = split.withColumn("_seg", F.sum((F.col("script") == "").cast("int")).over(at)).withColumn("_run", F.col("script") == "TAMIL_DIGIT")
    split = split.withColumn("_alone", ~F.coalesce(F.lag("_run").over(at), F.lit(False)) & ~F.coalesce(F.lead("_run").over(at), F.lit(False)))
    word = Window.partitionBy(*keys, "_tok", "_seg")
    has = lambda s: F.max((F.col("script") == s).cast("int")).over(word) == 1
    lacks = lambda s, c: F.max(((F.col("script") == s) & F.col(c).isNull()).cast("int")).over(word) == 0
    split = split.withColumns(
        {
            "_latin": has("LATIN"), "_tamil": has("TAMIL"), "_cyr": has("CYRILLIC"), "_gre": has("GREEK"),
            "_cyr_all": lacks("CYRILLIC", "look"), "_gre_all": lacks("GREEK", "look"), "_lat_cyr": lacks("LATIN", "cyrillic"), "_lat_gre": lacks("LATIN", "greek"),
        }
    )
    new = (
        F.when((F.col("script") == "TAMIL_DIGIT") & F.col("_tamil") & F.col("_alone"), F.coalesce("look", "x"))
        .when((F.col("script") == "CYRILLIC") & F.col("_latin") & F.col("_cyr_all"), F.col("look"))
        .when((F.col("script") == "GREEK") & F.col("_latin") & F.col("_gre_all"), F.col("look"))
        .when((F.col("script") == "LATIN") & F.col("_cyr") & ~F.col("_cyr_all") & F.col("_lat_cyr"), F.col("cyrillic"))
        .when((F.col("script") == "LATIN") & F.col("_gre") & ~F.col("_gre_all") & F.col("_lat_gre"), F.col("greek"))
        .otherwise(F.col("x"))
    )
    split = split.withColumn("x", new)
    # Combining sequences: a starter with the marks after it, ordered by class; then recomposed.
    follows = sorted({p[1] for p in _compositions()})
    split = split.withColumn("_starter", ((F.col("ccc") == 0) & ~F.col("x").isin(follows)).cast("int")).withColumn("_group", F.sum("_starter").over(at))
    groups = split.groupBy(*keys, "_tok", "_group").agg(F.sort_array(F.collect_list(F.struct("ccc", "_pos", "_sub", "x"))).alias("_g"))
    pairs = F.create_map(*[F.lit(x) for pair in sorted(_compositions().items()) for x in pair])
    made = groups.select(*keys, "_tok", "_group", _composed(F.expr("transform(_g, g -> struct(g.ccc as ccc, g.x as x))"), pairs).alias("_s"))
    tokens = made.groupBy(*keys, "_tok").agg(F.expr("array_join(transform(sort_array(collect_list(struct(_group, _s))), g -> g._s), '')").alias("_new"))
    changed = tokens.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_tok").alias("i"), F.col("_new").alias("t"))).alias("_tokens"))
    rest = F.filter(F.transform(F.split("_text", " "), lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda s: ~s["t"].rlike(pattern))
    # A token of unseen characters alone leaves no row; it stays as an empty string.
    gone = F.filter(F.transform(F.split("_text", " "), lambda t, i: F.struct(i.alias("i"), F.lit("").alias("t"))), lambda s: ~F.array_contains(F.col("_have"), s["i"]))
    changed = changed.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_tokens")
    same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]  # keys may be null
    back = held.join(changed, same, "left").withColumn("_tokens", F.coalesce("_tokens", F.array().cast("array<struct<i:int,t:string>>")))
    back = back.withColumn("_all", F.concat("_tokens", rest)).withColumn("_have", F.transform("_all", lambda s: s["i"]))
    full = F.when(F.size("_all") == F.size(F.split("_text", " ")), F.col("_all")).otherwise(F.concat("_all", gone))
    return back.select(*named, F.col("_text").alias(text), F.array_join(F.transform(F.sort_array(full), lambda s: s["t"]), " ").alias("text_new"))
