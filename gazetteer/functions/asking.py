"""Filters out of a plain question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions.regex import any_of, has, java
from gazetteer.functions.values import literal_array

AFTER = r"\b(?:after|past|later than|starting after)\s+(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\b"
BEFORE = r"\b(?:before|earlier than)\s+(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\b"
AGES = [
    r"\b(\d{1,2})\s*(?:years?\s*old|year olds?|yo|yrs?)\b",
    r"\bage[sd]?\s*(\d{1,2})\b",
    r"\bfor\s+(?:an?\s+)?(\d{1,2})\s+year\b",
]
GREETING = r"^(hi|hello|hey|good morning|good afternoon|good evening)[!. ]*$"
HELP = r"^(help|what can you do|what can i ask|examples?)[?.! ]*$"
LISTED = r"\b(programs|projects|classes)\b"
WHERE = r"\bwhere\b|\blocations?\b|\baddress\b|\bnear me\b"
LIST = [
    r"\b(what|which|list|show|all)\b.*\b(programs|projects|classes)\b",
    r"\b(programs|projects|classes)\b.*\b(do you have|are there|available)\b",
]


def normalize(question: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(question, F.lit("")), r"\A\s+|\s+\z", "")
    return F.regexp_replace(F.lower(trimmed), "['’]", "")


def says(q: Column, pattern: str) -> Column:
    return has(q, pattern, False)


def time_to_minutes(hour: Column, minute: Column, marker: Column) -> Column:
    """Spoken time as minutes of the day; a bare 1 to 7 is in the afternoon."""
    h = hour.cast("int")
    shifted = (
        F.when((marker == "pm") & (h < 12), h + 12)
        .when((marker == "am") & (h == 12), 0)
        .when((marker == "") & h.between(1, 7), h + 12)
        .otherwise(h)
    )
    return shifted * 60 + F.coalesce(minute.try_cast("int"), F.lit(0))


def minutes_to_text(total: Column) -> Column:
    hour24, minute = F.floor(total / 60), total % 60
    hour = F.when(hour24 % 12 == 0, 12).otherwise(hour24 % 12).cast("string")
    suffix = F.when(hour24 >= 12, "pm").otherwise("am")
    return F.when(minute == 0, F.concat(hour, suffix)).otherwise(
        F.concat(hour, F.lit(":"), F.lpad(minute.cast("string"), 2, "0"), suffix))


def _clock(q: Column, pattern: str) -> Column:
    p = java(pattern, False)
    h, m, a = (F.regexp_extract(q, p, i) for i in (1, 2, 3))
    return F.when(q.rlike(p), time_to_minutes(h.try_cast("int"), m, a))


def parse(q: Column) -> Column:
    """Struct of the filters a normalised question states; place names come later."""
    cost = (
        F.when(says(q, r"\bfree\b|\bno cost\b|\bzero cost\b|\bdoesnt cost\b|\bdoes not cost\b"), "free")
        .when(says(q, r"\bpaid\b|\bcosts money\b|\bnot free\b|\bwith a fee\b"), "paid")
        .when(says(q, r"\bask provider\b|\bunknown cost\b|\bfee not published\b"), "unknown")
    )
    after, stated = _clock(q, AFTER), _clock(q, BEFORE)
    no_time = after.isNull() & stated.isNull()
    before = F.when(says(q, r"\bmorning\b") & no_time, 720).otherwise(stated)
    weekends = says(q, r"\bweekends?\b")
    school_week = ~weekends & says(q, r"\bweekdays?\b|\bafter school\b")
    evening = after.isNull() & says(q, r"\bevenings?\b|\bat night\b|\btonight\b")
    afternoon = says(q, r"\bafternoon\b") & after.isNull() & before.isNull()
    kind = (
        F.when(afternoon, "after-school").when(evening, "evenings")
        .when(school_week & after.isNull(), "after-school")
    )
    named_days = F.filter(
        F.array(*[F.when(says(q, rf"\b{d}\b"), d) for d in vocab.WEEK]), lambda x: x.isNotNull())
    days = (
        F.when(weekends, literal_array(["saturday", "sunday"]))
        .when(school_week, literal_array(vocab.WEEKDAYS))
        .when(F.size(named_days) > 0, named_days)
    )
    age = F.coalesce(*[
        F.nullif(F.regexp_extract(q, java(p, False), 1), F.lit("")).try_cast("int") for p in AGES])
    group = F.when(age.isNull(), F.when(says(q, r"\bteens?\b|\bteenagers?\b"), "teen").when(
        says(q, r"\bkids?\b|\bchildren\b|\bchild\b"), "kid"))
    topics = F.array_compact(F.array(*[
        F.when(says(q, p), F.lit(t)) for t, p in vocab.TOPIC_PATTERNS.items()]))
    zip_code = F.nullif(F.regexp_extract(q, java(r"\b(\d{5})\b", False), 1), F.lit(""))
    near = says(q, r"\b(near|nearby|around|close to|closest to|next to|within)\b")
    boroughs = [
        F.when(says(q, rf"\b({any_of(aliases)})\b"), F.lit(b))
        for b, aliases in vocab.BOROUGH_ALIASES.items()]
    return F.struct(
        cost.alias("cost"), after.alias("after_min"), before.alias("before_min"),
        kind.alias("hours_kind"), days.alias("days"), age.alias("age"), group.alias("age_group"),
        topics.alias("topics"),
        F.array_compact(F.array(*boroughs, F.when(~near, zip_code))).alias("places"),
        F.when(near, zip_code).alias("near_zip"),
    )


def asks_where(q: Column) -> Column:
    return says(q, WHERE)


def asks_for_list(q: Column) -> Column:
    return says(q, LIST[0]) | says(q, LIST[1])


def faq_topic(q: Column) -> Column:
    """Which standing question this is, unless it asks about programs."""
    def any_phrase(phrases: list[str]) -> Column:
        return F.exists(literal_array(phrases), lambda p: F.contains(q, p))

    hit = F.coalesce(*[F.when(any_phrase(ps), F.lit(t)) for t, ps in vocab.FAQ_PHRASES.items()])
    return F.when(~says(q, LISTED), hit)


def topic_hits(topics: Column) -> Column:
    """Which of the question topics a catalog row's topics answer."""
    blob = F.array_join(topics, " ")
    return F.array_compact(F.array(*[
        F.when(
            F.contains(blob, F.lit(t)) | (says(blob, vocab.TOPIC_ROW_PATTERNS[t])
                                          if t in vocab.TOPIC_ROW_PATTERNS else F.lit(False)),
            F.lit(t))
        for t in vocab.TOPIC_PATTERNS]))


def title_case(c: Column) -> Column:
    from gazetteer.functions.text import rewrite

    return rewrite(c, java(r"\b[a-z]", False), F.upper)
