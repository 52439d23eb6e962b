"""What is written for people: pages of a vault, briefs, maps, rosters."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a person writes into a page stands between these and is kept when the page is made again.
BEGIN, END = "<!-- notes -->", "<!-- end of notes -->"


def wikilink(slug: Column, name: Column) -> Column:
    return F.concat(F.lit("[["), slug, F.lit("|"), F.regexp_replace(name, r"[\[\]|]", ""), F.lit("]]"))


def front_matter(**fields: Column) -> Column:
    """YAML before a page; strings are quoted."""
    lines = [F.concat(F.lit(f'{k}: "'), F.regexp_replace(F.coalesce(v.cast("string"), F.lit("")), '"', "'"), F.lit('"')) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def split_line() -> Column:
    return F.concat_ws(" / ", *[F.concat(F.lit(f"{k} "), F.col(k).cast("string")) for k in ("positive", "negative", "mixed", "neutral")])


def dossier_page() -> Column:
    """The page of an entity, from the columns of a dossier."""
    head = front_matter(slug=F.col("slug"), type=F.col("entity_type"), party=F.col("party"))
    return F.concat(head, F.lit("# "), wikilink(F.col("slug"), F.col("name")), F.lit("\n\n"), F.col("mentions").cast("string"), F.lit(" mentions: "), split_line(), F.lit("\n\nIssues: "), "top_categories", F.lit("\nDistricts: "), "top_districts", F.lit(f"\n\n{BEGIN}\n{END}\n"))


def with_notes(page: str, old: str | None) -> str:
    """The page with the notes that a person left in the old one."""
    if old and (m := re.search(re.escape(BEGIN) + "(.*?)" + re.escape(END), old, re.S)):
        return re.sub(re.escape(BEGIN) + ".*?" + re.escape(END), lambda _: BEGIN + m[1] + END, page, count=1, flags=re.S)
    return page


def write_vault(spark: SparkSession, pages: DataFrame, root: str) -> int:
    """Writes (slug, page) as files, one at a time from an iterator, those that changed only; returns how many. Names that would leave the folder are refused."""
    jvm, written = spark.sparkContext._jvm, 0
    hadoop, conf = jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for r in pages.select("slug", "page").toLocalIterator():
        if not re.fullmatch(r"[\w-]+", r["slug"] or ""):
            raise ValueError(f"not the name of a page: {r['slug']!r}")
        at = hadoop.Path(str(PurePosixPath(root) / f"{r['slug']}.md"))
        fs = at.getFileSystem(conf)
        fs.setVerifyChecksum(False)  # people edit these files
        old = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(fs.open(at))).decode() if fs.exists(at) else None
        new = with_notes(r["page"], old)
        if new != old:
            out = fs.create(at, True)
            out.write(bytearray(new.encode()))
            out.close()
            written += 1
    return written


def brief_text(lines: DataFrame, day: str) -> str:
    """The lines of a brief (place, title) as plain text, ready to be sent; nothing is sent here."""
    rows = lines.orderBy("place").limit(10).collect()
    return "\n".join([f"Brief of {day}", *(f"{r['place']}. {r['title']}" for r in rows)]) + "\n"


def _thinned(points: list[tuple[float, float]], far: float) -> list[tuple[float, float]]:
    """Douglas and Peucker: points nearer than `far` to the line between the ends of their stretch go."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        (x0, y0), (x1, y1) = points[a], points[b]
        length, best, at = math.hypot(x1 - x0, y1 - y0), far, None
        for i in range(a + 1, b):
            x, y = points[i]
            d = abs((x1 - x0) * (y0 - y) - (x0 - x) * (y1 - y0)) / length if length else math.hypot(x - x0, y - y0)
            if d > best:
                best, at = d, i
        if at is not None:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]


def ring_path(ring: list[tuple[float, float]], box: tuple[float, float, float, float], width: float = 600, far: float = 0.9, least: float = 6) -> str:
    """A ring of longitudes and latitudes as an SVG path within the box (west, south, east, north); empty for a ring of less than `least` square pixels."""
    west, south, east, north = box
    squeeze = math.cos(math.radians((south + north) / 2))
    scale = width / ((east - west) * squeeze)
    p = [((x - west) * squeeze * scale, (north - y) * scale) for x, y in ring]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], p[0]]))) / 2
    if len(p) < 3 or area < least:
        return ""
    p = [*_thinned(p if p[0] == p[-1] else [*p, p[0]], far)]
    return "M" + "L".join(f"{x:.1f},{y:.1f}" for x, y in p[:-1]) + "Z"


def map_paths(rings: DataFrame, box: tuple[float, float, float, float], key: str = "district") -> DataFrame:
    """(key, path): the rings of each place (key, ring: array of [x, y]) as one SVG path; each ring is worked off in its row."""
    kind = rings.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "path": [ring_path([tuple(p) for p in r], box) for r in f["ring"]]})

    made = rings.where("ring is not null").select(key, "ring").mapInPandas(work, f"{key} {kind}, path string").where("path <> ''")
    return made.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("path")), "").alias("path"))


def table_rows(wikitext: str | None) -> list[list[str]]:
    """The rows of the tables of a wiki page; a cell that spans rows is repeated in each."""
    out: list[list[str]] = []
    for table in re.findall(r"\{\|(.*?)\|\}", wikitext or "", re.S):
        held: dict[int, tuple[int, str]] = {}
        for block in re.split(r"^\|-.*$", table, flags=re.M)[1:]:
            cells = []
            for line in block.strip().splitlines():
                if line.startswith("|"):
                    cells += [c.strip() for c in line[1:].split("||")]
            if not cells:
                continue
            row, at = [], 0
            while cells or at in held:
                if at in held:
                    left, text = held.pop(at)
                    if left > 1:
                        held[at] = (left - 1, text)
                else:
                    cell = cells.pop(0)
                    span = re.match(r'rowspan\s*=\s*"?(\d+)"?[^|]*\|(.*)', cell)
                    text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", (span[2] if span else cell)).strip()
                    if span and int(span[1]) > 1:
                        held[at] = (int(span[1]) - 1, text)
                row.append(text)
                at += 1
            out.append(row)
    return out


def roster(pages: DataFrame, text: str, columns: tuple[str, ...]) -> DataFrame:
    """A roster with the named columns from the tables of wiki pages; rows with fewer cells end in nulls. A page is one row and one task holds it whole."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r + [None] * len(columns))[: len(columns)] for page in f[text] for r in table_rows(page)]
            yield pd.DataFrame(rows, columns=list(columns))

    return pages.select(text).mapInPandas(work, ", ".join(f"{c} string" for c in columns))
