"""What models answer as JSON, brought into shape: fences, wrong types, other words for labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings that mean nothing was said.
NOTHING = ("none", "n/a", "null")
LISTS = ("positive_points", "negative_points", "evidence_quotes_original", "political_actors")
FLAGS = ("people_issue", "needs_human_review")
#: Labels by field, other words for them, and what holds where neither fits.
SYNONYMS = {
    "stance": ({"positive": ("pos", "favourable", "favorable", "good", "pro"), "negative": ("neg", "hostile", "bad", "critical", "anti"), "mixed": ("both", "balanced"), "neutral": ("none", "unclear")}, "neutral"),
    "sentiment": ({"positive": ("pos", "happy"), "negative": ("neg", "angry"), "neutral": ("mixed", "none")}, "neutral"),
    "relevance": ({"high": ("strong", "direct"), "medium": ("moderate", "some"), "low": ("weak", "slight"), "none": ("irrelevant", "no")}, "low"),
    "severity": ({"critical": ("urgent", "extreme"), "high": ("severe", "serious"), "medium": ("moderate",), "low": ("minor", "none")}, "low"),
}


def unfenced(text: Column) -> Column:
    """The text within a fence of code, if there is one; else the text."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    inner = F.regexp_extract(bare, r"(?s)^```[A-Za-z]*\s*\n?(.*?)\n?```\s*$", 1)
    return F.when(bare.startswith("```") & (inner != ""), inner).otherwise(bare)


def parsed(text: Column) -> Column:
    """The fields of a JSON object as their text; lists and objects stay JSON; null for what is no object."""
    return F.from_json(unfenced(text), "map<string,string>")


def text_field(fields: Column, name: str, default: str = "") -> Column:
    """A string: missing gives the default; null, lists, objects, truth values and words for nothing give an empty one; numbers are spelt."""
    v = F.try_element_at(fields, F.lit(name))
    low = F.lower(F.trim(v))
    none = v.isNull() | low.isin(*NOTHING, "true", "false") | F.trim(v).rlike(r"^[\[{]")
    there = F.array_contains(F.map_keys(fields), name)
    return F.when(~F.coalesce(there, F.lit(False)), default).when(none, "").otherwise(v)


def list_field(fields: Column, name: str) -> Column:
    """A list of strings: of a list its items without blanks, of a string that string alone, else empty."""
    v = F.trim(F.try_element_at(fields, F.lit(name)))
    items = F.filter(F.transform(F.from_json(v, "array<string>"), F.trim), lambda x: x.isNotNull() & (x != ""))
    empty = F.array().cast("array<string>")
    return F.when(v.startswith("["), F.coalesce(items, empty)).when(v.isNull() | (v == "") | F.lower(v).isin("true", "false"), empty).otherwise(F.array(v))


def flag_field(fields: Column, name: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.try_element_at(fields, F.lit(name)))).isin("true", "yes", "1", "y"), F.lit(False))


def number_field(fields: Column, name: str, default: float = 0.7) -> Column:
    """A number, also one given as a string; the default for anything else."""
    return F.coalesce(F.try_element_at(fields, F.lit(name)).try_cast("double"), F.lit(default))


def coerced(value: Column, kind: str) -> Column:
    """A label of a field: itself, what it is another word for, else the default."""
    known, default = SYNONYMS[kind]
    names = F.create_map(*[F.lit(x) for label, words in known.items() for w in (label, *words) for x in (w, label)])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(value))), F.lit(default))
