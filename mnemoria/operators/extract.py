"""Text to structure: time anchors, coreference, entities, relations, metadata, and the line formats of model replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import scoring as R
from ..functions import text as X
from ..functions import wordlists as W


def shift_months(day: Column, n) -> Column:
    """Month arithmetic that overflows: 31 March less a month is 2 or 3 March."""
    first = F.add_months(F.trunc(day, "month"), n)
    return F.date_add(first, F.dayofmonth(day) - 1)


def anchor_times(text: Column, now: Column) -> Column:
    """Relative times become dates, in a fixed order of rewrites."""
    day = F.to_date(now)
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    month = lambda d: F.date_format(d, "MMMM yyyy")
    year = lambda n: F.date_format(shift_months(day, 12 * n), "yyyy")
    week = lambda n: F.concat(F.lit("the week of "), iso(F.date_add(day, n)))
    fixed = [
        ("today", iso(day)), ("yesterday", iso(F.date_add(day, -1))), ("tomorrow", iso(F.date_add(day, 1))), ("last week", week(-7)), ("this week", week(0)), ("next week", week(7)),
        ("last month", month(shift_months(day, -1))), ("this month", month(day)), ("next month", month(shift_months(day, 1))), ("last year", year(-1)), ("this year", year(0)), ("next year", year(1)),
    ]
    counted = [
        (r"(?i)\b(\d+) days? ago\b", lambda n: iso(F.date_add(day, -n))), (r"(?i)\b(\d+) weeks? ago\b", lambda n: iso(F.date_add(day, -7 * n))), (r"(?i)\b(\d+) months? ago\b", lambda n: month(shift_months(day, -n))),
        (r"(?i)\bin (\d+) days?\b", lambda n: F.concat(F.lit("by "), iso(F.date_add(day, n)))), (r"(?i)\bin (\d+) weeks?\b", lambda n: F.concat(F.lit("by "), iso(F.date_add(day, 7 * n)))),
    ]
    last = [("this morning", F.concat(F.lit("on "), iso(day), F.lit(" morning"))), ("tonight", F.concat(F.lit("on "), iso(day), F.lit(" evening"))), ("last night", F.concat(F.lit("on "), iso(F.date_add(day, -1)), F.lit(" evening"))), ("(?:recently|just now|earlier)", F.concat(F.lit("around "), iso(day)))]

    def plain(phrases):
        def run(t: Column) -> Column:
            for phrase, value in phrases:
                t = F.regexp_replace(t, F.lit(N.ascii_bounds(rf"(?i)\b{phrase}\b")), value)
            return t

        return run

    def numbered(pattern: str, value):
        own = N.ascii_bounds(pattern)

        def run(t: Column) -> Column:
            numbers = F.regexp_extract_all(t, F.lit(own), F.lit(1))
            put = lambda gaps: F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(numbers, lambda n, i: F.concat(value(n.cast("int")), F.get(gaps, i + 1))), ""))
            return F.when(t.rlike(own), X.let(F.split(t, own, -1), put)).otherwise(t)

        return run

    # a step names its text several times: each is bound, so that a text is rewritten once a step and not once a name
    steps = [plain(fixed), *[numbered(*c) for c in counted], plain(last)]
    done = text
    for step in steps:
        done = X.let(done, step)
    # one look for any of the words keeps texts without them out of the steps
    words = [p for p, _ in fixed + last] + [r"\d+ (?:day|week|month)s? ago", r"in \d+ (?:day|week)s?"]
    return F.when(text.rlike(N.ascii_bounds(rf"(?i)\b(?:{'|'.join(words)})\b")), done).otherwise(text)


#: What a match of each kind holds, so that texts without it are spared the pattern: one look each for a few fixed words.
RELATION_WORDS = {
    "works_at": r"\s(?:works at|works for|is employed by|joined)\s",
    "lives_in": r"\s(?:lives in|is from|moved to|resides in)\s",
    "knows": r"\s(?:knows|met|befriended)\s",
    "kin": rf"'s\s+(?:{W.KIN})",
    "member_of": r"\s(?:member|part)\s+of\s",
}
TITLE_WORDS = r"(?i)(?:Mr|Mrs|Ms|Dr|Prof)\.\s"
RELATIVE_WORDS = r"(?i)my\s"
COMPANY_WORDS = r"(?i)\s(?:Inc|Corp|LLC|Ltd|Company|Co\.)"


def _where(held: Column, found: Column) -> Column:
    """The names found in texts that hold what a match needs; none in others."""
    return F.when(held, found).otherwise(F.array().cast("array<string>"))


def relations(rows: DataFrame, column: str = "text") -> DataFrame:
    """The rows' other columns, source, target, relation_type, confidence: a row for each match of each pattern."""
    others = [c for c in rows.columns if c != column]
    runs = N.relations(F.col(column))

    def found(kind: str, confidence: float, pattern: str) -> Column:
        held = F.col(column).rlike("(?i)" + RELATION_WORDS[kind])
        part = lambda g: F.regexp_extract_all(column, F.lit(pattern), F.lit(g))
        source, target = (_where(held, c) for c in (runs[kind] if kind in runs else (part(1), part(2))))
        label = _where(held, part(3)) if kind == "kin" else F.transform(source, lambda _: F.lit(kind))
        items = F.arrays_zip(source.alias("source"), target.alias("target"), label.alias("relation_type"))
        return F.transform(items, lambda m: F.struct(m["source"].alias("source"), m["target"].alias("target"), m["relation_type"].alias("relation_type"), F.lit(confidence).alias("confidence")))

    some = rows.filter(F.col(column).rlike(f"(?i)(?:{'|'.join(RELATION_WORDS.values())})"))
    return some.select(*others, F.explode(F.concat(*[found(*r) for r in W.RELATIONS])).alias("m")).select(*others, "m.*")


def entities(rows: DataFrame, column: str = "text") -> DataFrame:
    """Titles, relatives, companies and places, by name; the last pattern that names one gives its type, and the first place it does so there the letters' case."""
    others = [c for c in rows.columns if c != column]
    text = F.col(column)
    every = lambda p, g: F.regexp_extract_all(text, F.lit(N.ascii_bounds(p)), F.lit(g))
    held = lambda words, names: _where(text.rlike(words), names)
    kinds = [(held(TITLE_WORDS, every(W.TITLED, 2)), "person"), (held(RELATIVE_WORDS, every(W.MY_RELATIVE, 2)), "person"), (held(COMPANY_WORDS, N.companies(text)), "organization"), (N.places(text), "place")]

    def numbered(names: Column, i: int) -> Column:
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(i).alias("i")))

    named = F.concat(*[numbered(names, i) for i, (names, _) in enumerate(kinds)])
    found = rows.select(*others, F.posexplode(named).alias("at", "m")).select(*others, "at", "m.*").withColumn("key", F.lower("name")).filter(~F.col("key").isin(*W.COMMON_WORDS))
    return found.groupBy(*others, "key").agg(F.max_by("name", F.struct(F.col("i"), -F.col("at"))).alias("name"), F.max("i").alias("i")).select(*others, "key", "name", F.get(F.array(*[F.lit(k) for _, k in kinds]), F.col("i")).alias("entity_type"))


def capitalised(text: Column) -> Column:
    """Distinct capitalised runs that are names."""
    return F.array_distinct(F.filter(N.capitalised(text), lambda n: (F.octet_length(X.normalize_name(n)) > 2) & ~X.one_of(n, W.GRAPH_NOT_NAMES)))


def entity_type(name: Column) -> Column:
    low = F.lower(name)
    org = reduce(lambda a, b: a | b, [low.endswith(s) | low.endswith(s + ".") for s in W.ORG_SUFFIXES])
    place = reduce(lambda a, b: a | b, [low.startswith(p) for p in W.PLACE_PREFIXES])
    return F.when(org, "organization").when(place, "place").when(F.size(X.fields(name)).between(1, 3), "person").otherwise("other")


def parse_date(s: Column) -> Column:
    """The first layout that fits; null if none does."""
    layouts = ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "MM/dd/yy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in layouts])


#: Patterns of :func:`metadata`: what each begins with, and one cheap look at a text that a match can't do without.
TIMES = [(W.DATE_YMD, "0-9", r"\d-\d\d-\d"), (W.DATE_MDY, "0-9", r"\d/\d"), (W.DATE_WRITTEN, "jfmasond", r"\s\d{1,2}(?:[a-zA-Z]{2})?,?\s*\d{4}")]
PLACES = [(W.CITY, "iaftn", 2), (W.COUNTRY, "ucagfjibmsr", 0), (W.STATE, "ctfnipogm", 0)]


def find_times(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(~text.rlike(held), none).otherwise(F.regexp_extract_all(text, F.lit(N.whole_word(p, first)), F.lit(0))) for p, first, held in TIMES])


def find_places(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(N.whole_word(p, first)), F.lit(g)) for p, first, g in PLACES])))


def find_names(text: Column, places: Column) -> Column:
    every = F.regexp_extract_all(text, F.lit(N.whole_word(W.PROPER, "A-Z")), F.lit(1))
    return X.let(places, lambda p: F.filter(every, lambda n: ~X.one_of(F.lower(n), W.COMMON_WORDS) & ~F.array_contains(p, n)))  # places once a text, not once a name


#: What :func:`noted` adds, in the order of its steps.
NOTES = {"__times": find_times, "__places": find_places, "__names": lambda text: find_names(text, F.col("__places")), "__anchor": lambda text: parse_date(F.get("__times", F.lit(0)))}


def noted(rows: DataFrame, column: str = "text") -> DataFrame:
    """The rows with columns for what :func:`metadata` names several times, so that a text meets each pattern once; ``metadata(text, noted=True)`` reads them."""
    for name, found in NOTES.items():
        rows = rows.withColumn(name, found(F.col(column)))
    return rows


def metadata(text: Column, noted: bool = False) -> dict[str, Column]:
    """Of a text; ``noted``: over rows of :func:`noted`."""
    if noted:
        times, places, names, anchor = (F.col(c) for c in NOTES)
    else:
        times, places = find_times(text), find_places(text)
        names, anchor = find_names(text, places), parse_date(F.get(times, F.lit(0)))
    numbers = text.rlike(N.whole_word(W.NUMBER, "0-9", N.ascii_bounds(r"\b"))) | text.rlike(W.CURRENCY)
    return {
        "times": times, "anchor": anchor, "places": places, "persons": F.filter(names, lambda n: ~n.contains(" ")), "organisations": F.filter(names, lambda n: n.contains(" ")), "is_question": F.trim(text).rlike(r"\?$"), "is_negation": text.rlike(N.ascii_bounds(W.NEGATION)), "has_numbers": numbers,
        "specificity": R.specificity(F.size(times), anchor.isNotNull(), F.size(places), F.size(names), numbers, F.size(X.fields(text))),
    }


def bad_resolution(text: Column) -> Column:
    """Any word three times or more."""
    words = F.array_sort(F.transform(X.fields(text), lambda w: F.lower(w)))
    pairs = F.arrays_zip(words.alias("a"), F.slice(words, F.lit(3), F.greatest(F.size(words), F.lit(0))).alias("b"))
    return F.exists(pairs, lambda p: p["a"].eqNullSafe(p["b"]))


# What each label is called in replies.
CATEGORY_NAMES = {
    "preference": ("preference", "preferences", "pref"),
    "belief": ("belief", "beliefs", "opinion"),
    "biographical": ("biographical", "biography", "bio", "identity"),
    "event": ("event", "events", "experience"),
    "relationship": ("relationship", "relationships", "relation"),
    "task": ("task", "tasks", "todo", "goal"),
    "knowledge": ("knowledge", "fact", "info"),
}
ENTITY_NAMES = {
    "person": ("person", "people", "user"),
    "place": ("place", "location", "city", "country"),
    "organization": ("organization", "org", "company", "business"),
    "concept": ("concept", "idea", "topic"),
    "thing": ("thing", "object", "item"),
    "time": ("time", "date", "datetime", "period"),
}


def _named(value: Column, table: dict[str, tuple[str, ...]]) -> Column:
    low, out = F.lower(F.trim(value)), F
    for name, words in table.items():
        out = out.when(low.isin(*words), name)
    return out.otherwise("other")


def normalize_category(value: Column) -> Column:
    return _named(value, CATEGORY_NAMES)


def normalize_entity_type(value: Column) -> Column:
    return _named(value, ENTITY_NAMES)


def _lines(rows: DataFrame, column: str, head: str, parts: int) -> DataFrame:
    others = [c for c in rows.columns if c != column]
    lines = rows.select(*others, F.posexplode(F.split(column, "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw")).filter(F.col("raw").startswith(head + "|"))
    return lines.withColumn("p", F.split("raw", r"\|", parts)).filter(F.size("p") == parts)


def parse_facts(rows: DataFrame, column: str = "reply") -> DataFrame:
    """FACT|category|importance|text; the text may hold pipes, a bad number is 0.5, and it is held to [0, 1]."""
    p = F.col("p")
    importance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.expr("try_cast(trim(p[2]) as double)"), F.lit(0.5))))
    found = _lines(rows, column, "FACT", 4)
    return found.select(*[c for c in found.columns if c not in ("raw", "p")], normalize_category(p[1]).alias("category"), importance.alias("importance"), F.trim(p[3]).alias("fact")).filter("fact <> ''")


def parse_entities(rows: DataFrame, column: str = "reply") -> DataFrame:
    found = _lines(rows, column, "ENTITY", 3)
    return found.select(*[c for c in found.columns if c not in ("raw", "p")], normalize_entity_type(F.col("p")[1]).alias("entity_type"), F.trim(F.col("p")[2]).alias("name")).filter("name <> ''")


def parse_relations(rows: DataFrame, column: str = "reply") -> DataFrame:
    found = _lines(rows, column, "REL", 5)
    p = F.col("p")
    return found.select(*[c for c in found.columns if c not in ("raw", "p")], F.trim(p[1]).alias("source"), F.trim(p[2]).alias("relation_type"), F.trim(p[3]).alias("target"), F.coalesce(F.expr("try_cast(trim(p[4]) as double)"), F.lit(0.8)).alias("confidence"))


def parse_decision(reply: Column) -> dict[str, Column]:
    """OP [id]|reason; an unknown operation is NOOP."""
    head = F.trim(F.element_at(F.split(reply, r"\|", 2), 1))
    op = F.upper(F.regexp_extract(head, r"^([A-Za-z]+)", 1))
    return {"op": F.when(op.isin("ADD", "UPDATE", "DELETE", "NOOP"), op).otherwise("NOOP"), "target": F.nullif(F.regexp_extract(head, "([0-9]+)", 1), F.lit("")).try_cast("long"), "reason": F.trim(F.coalesce(F.get(F.split(reply, r"\|", 2), F.lit(1)), F.lit("")))}


# Pronouns that stand for a name, and those that stand for a name's possessive.
PRONOUNS = {
    "male": (("he", "him", "himself"), ("his",)),
    "female": (("she", "her", "herself"), ("hers",)),
    "neutral": (("it", "itself"), ("its",)),
    "plural": (("they", "them", "themselves"), ("their", "theirs")),
}


def resolve_pronouns(text: Column, names: dict[str, Column]) -> Column:
    """Pronouns become the most salient name of their kind (null: left alone); possessives get 's."""
    for kind, (plain, owning) in PRONOUNS.items():
        name = names[kind]
        done = text
        for words, end in ((plain, ""), (owning, "'s")):
            done = F.regexp_replace(done, F.lit(rf"(?i)\b({'|'.join(words)})\b"), F.concat(F.coalesce(name, F.lit("")), F.lit(end)))
        text = F.when(name.isNull() | (name == ""), text).otherwise(done)
    return text
