"""Text expressions: keys of names, vocabularies, ordered classifiers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Parts of a name that don't tell people apart: which of a family one is, as a word or a Roman number (a lone i or x may be
#: an initial), and the marker of a team's defence.
GENERATION = r"^(jr|sr|v|[ivx]{2,5})$"
DEFENCE = ("dst", "d/st")


def name_key(name: Column) -> Column:
    """The letters a to z of a name's parts, in lower case, less those that say a generation or a defence."""
    parts = F.filter(F.split(F.lower(name), r"[^\p{L}/']+"), lambda part: ~part.isin(*DEFENCE) & ~part.rlike(GENERATION))
    return F.regexp_replace(F.array_join(parts, ""), "[^a-z]", "")


def conform(value: Column, aliases: dict[str, str]) -> Column:
    """Upper case and trimmed, an alias as what it stands for."""
    clean = F.upper(F.trim(value))
    if not aliases:
        return clean
    return F.coalesce(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))[clean], clean)


def classify(text: Column, rules: Sequence[tuple[str, str]], default: str | None) -> Column:
    """The label of the first rule (regular expression, label) that matches anywhere, without regard to case."""
    out = None
    low = F.lower(text)
    for pattern, label in rules:
        out = F.when(low.rlike(pattern), label) if out is None else out.when(low.rlike(pattern), label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


#: The five named entities, the apostrophe's number and the no-break space; &amp; last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def decode_entities(text: Column, entities: dict[str, str] = ENTITIES) -> Column:
    """The entities as what they stand for, one after the other."""
    for entity, char in entities.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def csv_safe(text: Column) -> Column:
    """One line without commas or quotes."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r'[",]', ""), r"\s+", " "))


def mentions(text: Column, first: Column, last: Column) -> Column:
    """True if first and last name stand next to each other as whole words."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), F.lit(" "))
    return F.contains(words, F.concat(F.lit(" "), F.lower(first), F.lit(" "), F.lower(last), F.lit(" ")))


def height_inches(height: Column) -> Column:
    """Feet-inches (6-2) as inches; null if it is no such text."""
    fit = height.rlike(r"^\d+-\d+$")
    part = lambda i: F.split_part(height, F.lit("-"), F.lit(i)).try_cast("int")
    return F.when(fit, part(1) * 12 + part(2))


#: A vocabulary of ailments by region, from head to foot; reports of another kind take another.
AILMENTS = (
    ("head", ("concuss", "head", "face", "eye")),
    ("neck and back", ("neck", "spine", "back", "disc")),
    ("shoulder and chest", ("shoulder", "collarbone", "chest", "rib")),
    ("arm and hand", ("elbow", "forearm", "wrist", "hand", "thumb", "finger")),
    ("trunk", ("groin", "oblique", "core muscle", "abdom")),
    ("hip and thigh", ("hip", "quad", "thigh", "hamstring")),
    ("knee", ("knee", "meniscus", "cruciate")),
    ("lower leg", ("calf", "shin", "achilles")),
    ("ankle and foot", ("ankle", "foot", "toe", "heel")),
    ("illness or rest", ("illness", "flu", "virus", "rest", "personal")),
)
#: The words that a game's report and a practice report begin with, and what they are called here.
DESIGNATIONS = tuple((word.lower(), word) for word in ("Out", "Doubtful", "Questionable", "Probable"))
PRACTICE = (("did not", "DNP"), ("limited", "Limited"), ("full", "Full"), ("out", "DNP"))


def grouped_by_words(text: Column, groups: Sequence[tuple[str, Sequence[str]]], empty: str = "none", other: str = "other") -> Column:
    """The first group of which some word stands in the text, anywhere and without regard to case; `empty` for a
    null or blank text, `other` where no group has one."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    hit = [(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), group) for group, words in groups]
    return reduce(lambda case, hg: case.when(*hg), hit, F.when(low == "", empty)).otherwise(other)


def beginning_with(text: Column, prefixes: Sequence[tuple[str, str]], other: str = "") -> Column:
    """What the first prefix that the trimmed text begins with stands for, without regard to case."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.coalesce(*(F.when(F.startswith(low, F.lit(p)), value) for p, value in prefixes), F.lit(other))
