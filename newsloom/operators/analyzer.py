"""The rule analyzer: gates, flags and records from word lists, all as columns. A lens holds the lists, so a reader with another subject brings another lens."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TAMIL, first_sentence, share_of, squeezed

LEFT, RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


@dataclass(frozen=True)
class Terms:
    """words match whole and without case; parts match anywhere, as written."""

    words: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()

    def word_pattern(self) -> str:
        return "|".join(re.escape(w).replace("\\ ", " ") for w in self.words)

    def part_pattern(self) -> str:
        return "|".join(re.escape(p).replace("\\ ", " ") for p in self.parts)

    def found(self, text: Column) -> Column:
        out = F.lit(False)
        if self.words:
            out = out | F.lower(text).rlike(f"{LEFT}(?:{self.word_pattern()}){RIGHT}")
        if self.parts:
            out = out | text.rlike(self.part_pattern())
        return out


@dataclass(frozen=True)
class Issue:
    """A rule of the ordered list: the first whose terms are found gives the profile."""

    category: str
    name: str
    severity: str
    terms: Terms
    owner: str = "field team"
    action: str = "field_verification"


@dataclass(frozen=True)
class Lens:
    """What a reader looks for. The lists are parameters; these suit the invented state of the test tables."""

    subject: Terms = Terms(("cabinet", "ruling party", "treasury bench"), ("அமைச்சரவை",))
    government: Terms = Terms(("minister", "department", "collectorate", "collector", "council", "panchayat", "municipality"), ("ஆட்சியர்", "அமைச்சர்", "மாநகராட்சி"))
    places: Terms = Terms(("district", "taluk", "ward", "panchayat"), ("மாவட்ட", "ஊராட்சி"))
    #: Words that are places only when capitalised.
    ambiguous: tuple[str, ...] = ("Bench", "Depot")
    listing_titles: tuple[str, ...] = ("latest news", "live updates", "photo gallery", "top stories")
    sections: tuple[str, ...] = ("/sport", "/cinema", "/film", "/world")
    off_topic: Terms = Terms(("cricket", "film", "trailer", "laboratory", "façade lighting"), ("திரைப்பட",))
    foreign: Terms = Terms(("embassy", "fuel prices", "wetland"), ("வெளியுறவு",))
    elsewhere: Terms = Terms(("neighbouring state", "railway cutting"), ())
    danger: Terms = Terms(("fire", "accident", "cyclone", "flood", "fever", "collapse"), ("விபத்து", "வெள்ள", "காய்ச்சல்"))
    civic: Terms = Terms(("water", "road", "drains", "drain", "ration", "power", "school", "schools", "bus", "bridge", "ambulances", "pension"), ("குடிநீர்", "சாலை", "பேருந்து", "பள்ளி"))
    problem: Terms = Terms(("complaint", "complaints", "shortage", "waiting", "vacant", "breached", "arrears", "overdue", "halted", "washed away"), ("பாதிக்க", "காலியாக", "நிறுத்தி"))
    good: Terms = Terms(("approved", "welcomed", "speed up", "reopened", "extended", "promised"), ("வரவேற்று", "தொடங்கி"))
    bad: Terms = Terms(("halted", "rejected", "postponed", "walked out", "questioned", "resisted", "breached", "withdrew"), ("விமர்சித்", "நிறுத்தி"))
    issues: tuple[Issue, ...] = field(
        default=(
            Issue("public_safety", "school safety", "high", Terms(("school fire", "school accident"), ())),
            Issue("public_safety", "public safety", "high", Terms(("fire", "accident", "cyclone", "flood", "collapse"), ("விபத்து", "வெள்ள"))),
            Issue("civic_services", "drinking water", "medium", Terms(("water", "drinking water", "canal", "tank"), ("குடிநீர்",))),
            Issue("civic_services", "power supply", "medium", Terms(("power", "transformer"), ("மின்",))),
            Issue("civic_services", "roads and traffic", "medium", Terms(("road", "bridge", "bypass", "bus"), ("சாலை", "பேருந்து"))),
            Issue("health", "health service", "high", Terms(("health", "hospital", "hospitals", "ambulances", "fever"), ("மருத்துவ",))),
            Issue("education", "education", "medium", Terms(("school", "schools", "teachers", "students"), ("பள்ளி", "கல்வி"))),
            Issue("livelihood", "jobs and wages", "medium", Terms(("wages", "overtime", "workers", "posts"), ("பணியிட",))),
            Issue("livelihood", "farming and fishing", "medium", Terms(("crop", "farmers", "growers", "fishing"), ("விவசாய", "மீனவ"))),
            Issue("welfare", "welfare", "low", Terms(("ration", "pension", "subsidised"), ("ஓய்வூதிய",))),
        )
    )
    actors: tuple[tuple[str, Terms], ...] = field(
        default=(
            ("opposition", Terms(("opposition", "opposition bloc"), ("எதிர்க்கட்சி",))), ("council", Terms(("council", "ward council"), ())), ("court", Terms(("court", "tribunal", "bench"), ("நீதிமன்ற",))),
            ("farmers", Terms(("farmers", "growers"), ("விவசாய",))), ("fishers", Terms(("fishing cooperatives", "fisheries wing"), ("மீனவ",))), ("police", Terms(("police", "vigilance"), ("காவல்",))),
        )
    )
    #: Single persons, added to the groups.
    persons: tuple[tuple[str, Terms], ...] = field(default=(("Sakevel Thunimaan", Terms(("sakevel thunimaan",), ())), ("Kelan Sithanivel", Terms(("kelan sithanivel",), ()))))
    confidence: float = 0.72
    #: Whether an office-holder makes an item as relevant to the subject as the subject itself.
    governing: bool = True


#: The second lexicon: another reading of the same texts, in which government alone is of medium relevance to the subject.
SECOND = Lens(
    good=Terms(("approved", "welcomed", "free", "reopened", "clean", "support"), ("வரவேற்",)), bad=Terms(("protests", "halted", "rejected", "withdrew", "fears", "incomplete", "delay"), ("எதிர்ப்பு",)),
    problem=Terms(("complaints", "shortage", "fears", "dues", "unpaid", "incomplete"), ("பாதிக்க",)), confidence=0.65, governing=False,
)

LEAST_CHARS, WINDOW, BREAKS, SCRIPT_SHARE, MOST_ACTORS = 160, 1200, 5, 0.3, 10


class Rules:
    """The rules of a lens over a title, a body and a url; null counts as empty."""

    def __init__(self, lens: Lens, title: str = "title", body: str = "body", url: str = "url") -> None:
        empty = lambda c: F.coalesce(F.col(c), F.lit(""))
        self.lens, self.title, self.body, self.url = lens, empty(title), empty(body), F.lower(empty(url))
        self.text = F.concat(self.title, F.lit("\n"), self.body)

    def listing(self) -> Column:
        body = F.trim(self.body)
        marks = F.lower(self.title).rlike("|".join(self.lens.listing_titles))
        return (F.length(body) < LEAST_CHARS) | marks | (F.regexp_count(F.substring(body, 1, WINDOW), F.lit("[!?]")) >= BREAKS)

    def hard_out(self) -> Column:
        return self.url.rlike("|".join(self.lens.sections)) | self.lens.off_topic.found(self.text)

    def soft_out(self) -> Column:
        return self.hard_out() | self.lens.foreign.found(self.text) | self.lens.elsewhere.found(self.text)

    def in_scope(self) -> Column:
        named = self.lens.places.found(self.text)
        if self.lens.ambiguous:
            named = named | self.text.rlike(f"{LEFT}(?:{'|'.join(self.lens.ambiguous)}){RIGHT}")
        local = (share_of(self.text, TAMIL) >= SCRIPT_SHARE) & ~self.soft_out()
        return ~self.hard_out() & (named | local)

    def people_issue(self) -> Column:
        return ~self.soft_out() & (self.lens.danger.found(self.text) | (self.lens.civic.found(self.text) & self.lens.problem.found(self.text)))

    def profile(self) -> Column:
        """The struct of the first issue found, else a general one."""
        record = lambda i: F.struct(F.lit(i.category).alias("category"), F.lit(i.name).alias("issue"), F.lit(i.severity).alias("severity"), F.lit(i.owner).alias("owner"), F.lit(i.action).alias("action"))
        rest = Issue("concern", "public concern", "low", Terms(), "monitoring desk", "monitor")
        return F.coalesce(*[F.when(i.terms.found(self.text), record(i)) for i in self.lens.issues], record(rest))

    def actors(self) -> Column:
        named = [*self.lens.actors, *self.lens.persons]
        return F.slice(F.array_distinct(F.array_compact(F.array(*[F.when(t.found(self.text), label) for label, t in named]))), 1, MOST_ACTORS)

    def stance(self) -> Column:
        good, bad = self.lens.good.found(self.text), self.lens.bad.found(self.text)
        return F.when(good & bad, "mixed").when(good, "positive").when(bad, "negative").otherwise("neutral")


def relevance(government: Column, subject: Column) -> Column:
    return F.when(government, "high").when(subject, "medium").otherwise("low")


def subject_relevance(government: Column, subject: Column, people: Column, governing: bool) -> Column:
    if governing:
        return F.when(government | subject, "high").when(people, "medium").otherwise("low")
    return F.when(subject, "high").when(government | people, "medium").otherwise("low")


def action_owner(subject: Column, people: Column, government: Column) -> Column:
    return F.when(subject, "leadership office").when(people, "field team").when(government, "policy team").otherwise("monitoring desk")


def action_type(stance: Column, subject: Column, people: Column) -> Column:
    return F.when(subject & (stance == "negative"), "internal_review").when(people, "field_verification").when(stance == "positive", "amplify").otherwise("monitor")


def analyze(items: DataFrame, lens: Lens = Lens(), title: str = "title", body: str = "body", url: str = "url") -> DataFrame:
    """Adds the record of the analyzer to items with a title, body and url; what the gates stop gets the record for irrelevant items.

    Null texts count as empty ones and are listings. Columns: gate (listing, out-of-scope
    or null), government_relevance, stance, sentiment, subject_relevance, portrayal,
    people_issue, actors, issue_category, public_issue, severity, summary, focus,
    action_owner, action_type, action_priority, next_step, verify, root_cause, positive_points,
    negative_points, confidence, needs_human_review.
    """
    r = Rules(lens, title, body, url)
    flags = items.withColumns({"_gate": F.when(r.listing(), "listing").when(~r.in_scope(), "out-of-scope"), "_subject": lens.subject.found(r.text), "_government": lens.government.found(r.text)})
    flags = flags.withColumns({"_stance": r.stance(), "_people": r.people_issue(), "_profile": r.profile(), "actors": r.actors(), "_lead": first_sentence(r.body)})
    c, out = F.col, F.col("_gate").isNotNull()
    either = c("_subject") | c("_government")
    portrayal = F.when(either if lens.governing else c("_subject"), c("_stance")).otherwise("neutral")
    severity = F.when(c("_people"), c("_profile.severity")).otherwise("low")
    focus = focus_of(r.title, c("_lead"))
    made = {
        "gate": c("_gate"),
        "government_relevance": F.when(out, "none").otherwise(relevance(c("_government"), c("_subject"))),
        "stance": F.when(out, "neutral").otherwise(c("_stance")),
        "sentiment": F.when(out | c("_stance").isin("mixed", "neutral"), "neutral").otherwise(c("_stance")),
        "subject_relevance": F.when(out, "none").otherwise(subject_relevance(c("_government"), c("_subject"), c("_people"), lens.governing)),
        "portrayal": F.when(out, "neutral").otherwise(portrayal),
        "people_issue": ~out & c("_people"),
        "actors": F.when(out, F.array().cast("array<string>")).otherwise(c("actors")),
        "issue_category": F.coalesce(c("_gate"), F.when(c("_people"), c("_profile.category")).otherwise("general")),
        "public_issue": F.when(~out & c("_people"), c("_profile.issue")).otherwise(""),
        "severity": F.when(out, "low").otherwise(severity),
        "summary": F.when(c("_lead") != "", c("_lead")).otherwise(r.title),
        "focus": focus,
        "action_owner": F.when(out, "").when(c("_people"), c("_profile.owner")).otherwise(action_owner(c("_subject"), c("_people"), c("_government"))),
        "action_type": F.when(out, "monitor").otherwise(action_type(c("_stance"), c("_subject"), c("_people"))),
        "action_priority": F.when(out, "low").otherwise(severity),
        "next_step": F.when(out, "").when(c("_people"), next_step(c("_profile.issue"), focus)).otherwise(F.concat(F.lit("Keep an eye on: "), focus)),
        "verify": F.when(~out & c("_people"), verification(c("_profile.category"), c("_profile.issue"))).otherwise(""),
        "root_cause": F.when(~out & c("_people"), F.format_string("Reported: %s; its cause is to be checked on the spot.", c("_profile.issue"))).otherwise(""),
        "positive_points": F.when(~out & c("_stance").isin("positive", "mixed"), F.array("_lead")).otherwise(F.array().cast("array<string>")),
        "negative_points": F.when(~out & c("_stance").isin("negative", "mixed"), F.array("_lead")).otherwise(F.array().cast("array<string>")),
        "confidence": F.when(out, F.lit(0.25)).otherwise(F.lit(lens.confidence)),
        "needs_human_review": ~out & (severity.isin("high", "critical") | (c("_stance") == "mixed")),
    }
    return flags.withColumns(made).drop("_gate", "_subject", "_government", "_stance", "_people", "_profile", "_lead")


def focus_of(title: Column, quote: Column, limit: int = 96) -> Column:
    """The title, else the quote, in single spaces, shortened with an ellipsis."""
    text = squeezed(F.when(F.trim(title) != "", title).otherwise(quote))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…")))


def verification(category: Column, issue: Column) -> Column:
    return F.when(category == "public_safety", "people hurt, cause, response of the services").when(category == "health", "patients, staff and stock on the spot").otherwise(F.concat(F.lit("streets and households hit by: "), issue))


def next_step(issue: Column, focus: Column) -> Column:
    return F.format_string("Send someone to check %s: %s", issue, focus)


#: Names of places that hold a word for school; they are taken out before the word is looked for.
FALSE_SCHOOLS = ("school street", "old school road", "பள்ளிக்கரை")
SCHOOL = Terms(("school", "schools", "student", "students"), ("பள்ளி", "மாணவ"))


def school_context(text: Column) -> Column:
    plain = text
    for name in FALSE_SCHOOLS:
        plain = F.regexp_replace(plain, "(?i)" + name, "")
    return SCHOOL.found(plain)


def fallback_severity(text: Column, risky: Terms = Terms(("fire", "cyclone", "fever", "collapse", "accident"), ("விபத்து",))) -> Column:
    return F.when(risky.found(text), "high").otherwise("medium")


def explicit_subject(title: Column, body: Column, subject: Terms) -> Column:
    """Whether the title or the first sentence names the subject."""
    return subject.found(F.concat_ws("\n", F.coalesce(title, F.lit("")), first_sentence(F.coalesce(body, F.lit("")))))


SERIOUS = ("public_safety", "health")
IMPACT = Terms(("residents", "households", "families", "children", "patients", "complaints"), ("குடும்ப", "மக்கள்"))
CEREMONY = Terms(("welcomed", "hall", "prize", "function"), ("விழா",))
VAGUE = ("monitor", "keep an eye", "follow up", "review later")


def expected_people_issue(category: Column, text: Column) -> Column:
    """Serious issues, and others with an impact on people that aren't mere ceremonies of schools."""
    impact = IMPACT.found(text)
    ceremony = (category == "education") & CEREMONY.found(text) & ~impact
    return F.when(category.isNull() | (category == "concern"), False).when(category.isin(*SERIOUS), True).otherwise(impact & ~ceremony)


def vague_step(step: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(step, F.lit(""))))
    return (s == "") | s.rlike("|".join(VAGUE))


def audit(items: DataFrame, lens: Lens = Lens()) -> DataFrame:
    """(raw_item_id, analysis_id, code): contradictions between an item's text and its current analysis. items: the two ids, title, body, url and columns of the analysis; irrelevant items, listings and what is out of scope are left out by their own labels."""
    r, c = Rules(lens), F.col
    kept = items.where((F.lower(F.coalesce("government_relevance", F.lit(""))) != "none") & ~F.lower(F.coalesce("issue_category", F.lit(""))).isin("out-of-scope", "listing"))
    seen = kept.withColumns({"_people": r.people_issue(), "_category": F.when(r.people_issue(), r.profile()["category"]), "_subject": lens.subject.found(r.text)})
    seen = seen.withColumn("_expected", expected_people_issue(c("_category"), r.text))
    serious, blank = c("_category").isin(*SERIOUS), lambda x: F.trim(F.coalesce(c(x), F.lit(""))) == ""
    found = {
        "people_issue_missing": c("_expected") & ~F.coalesce("people_issue", F.lit(False)),
        "serious_issue_low_severity": serious & ~F.lower(F.coalesce("severity", F.lit(""))).isin("high", "critical"),
        "serious_issue_not_reviewed": serious & ~F.coalesce("needs_human_review", F.lit(False)),
        "generic_next_step": c("_expected") & vague_step(c("next_step")),
        "missing_action_owner": c("_expected") & blank("action_owner"),
        "subject_relevance_missing": c("_subject") & (F.lower(F.coalesce("subject_relevance", F.lit(""))) != "high"),
    }
    codes = F.array_compact(F.array(*[F.when(x, name) for name, x in found.items()]))
    return seen.select("raw_item_id", "analysis_id", F.explode(codes).alias("code"))


#: Analyzers by name, and the order in which they are asked.
TIERS = ("local-13b", "local-7b", "rules")


def cascade(tiers: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """(key, value, tier): of each key the value of the first tier that has one. A tier without any rows is passed over; each tier has a row per key at most."""
    every = None
    for rank, (name, df) in enumerate(tiers):
        one = df.where(F.col(value).isNotNull()).select(key, value, F.lit(name).alias("tier"), F.lit(rank).alias("_rank"))
        every = one if every is None else every.union(one)
    best = every.groupBy(key).agg(F.min_by(F.struct(value, "tier"), "_rank").alias("b"))
    return best.select(key, f"b.{value}", "b.tier")
