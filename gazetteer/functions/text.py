"""Text columns: folding, names, quotes, tags.  Native expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions.regex import SPACE, fold_space, has, holds, java, let, sub
from gazetteer.functions.values import literal_array


def rewrite(text: Column, pattern: str, fn: Callable[[Column], Column], group: int = 0) -> Column:
    """Replace each match by ``fn(match)`` in one left-to-right pass."""
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    done = F.concat(F.transform(hits, fn), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, done, lambda a, b: F.concat(a, b)), "")


def _character(code: Column, otherwise: Column) -> Column:
    n = code.try_cast("bigint")
    legal = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    return F.when(
        legal, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    ).otherwise(otherwise)


def decode_entities(text: Column) -> Column:
    """Numeric then named character references; unknown names stay."""
    hexed = rewrite(
        text, "(?i)&#x[0-9a-f]+;",
        lambda m: _character(
            F.conv(F.regexp_extract(m, "(?i)x0*([0-9a-f]{1,8});", 1), 16, 10), m
        ),
    )
    numbered = rewrite(
        hexed, r"&#\d+;", lambda m: _character(F.regexp_extract(m, r"(\d+)", 1), m)
    )
    named = numbered
    for name, char in vocab.NAMED_ENTITIES.items():
        if name != "amp":
            named = F.regexp_replace(named, f"(?i)&{name};", char)
    # "&amp;" comes last, so that "&amp;lt;" yields "&lt;" as one pass would.
    named = F.regexp_replace(named, "(?i)&amp;", "&")
    return F.when(F.contains(text, F.lit("&")), named).otherwise(text)


def squash(text: Column) -> Column:
    """Fold case, entities, quotes, dashes and white space for comparison."""
    t = F.lower(decode_entities(text))
    t = F.translate(t, "‘’ʼ“”–—", "'''\"\"--")
    return fold_space(F.replace(t, F.lit("…"), F.lit("...")))


# --- organisation names ---------------------------------------------------

def name_tokens(name: Column) -> Column:
    t = F.replace(F.lower(name), F.lit("&"), F.lit(" and "))
    t = sub(t, vocab.LEGAL_WORDS, " ")
    t = F.regexp_replace(t, r"[^a-z0-9\s-]", " ")
    stop = literal_array(vocab.NAME_STOPWORDS)
    return F.filter(
        F.split(t, r"[\s-]+"), lambda w: (w != "") & ~F.array_contains(stop, w)
    )


def _without(tokens: Column, words) -> Column:
    drop = literal_array(words)
    return F.filter(tokens, lambda w: ~F.array_contains(drop, w))


def name_signals(name: Column) -> Column:
    """Distinct words of four or more letters that a page must show."""
    return F.array_distinct(
        F.filter(_without(name_tokens(name), vocab.TRIMMABLE), lambda w: F.length(w) >= 4)
    )


def domain_candidates(name: Column) -> Column:
    """Likely host names, most specific first."""
    t = name_tokens(name)
    trimmed = _without(t, vocab.TRIMMABLE)
    generic = literal_array(vocab.TOO_GENERIC)

    def base(words: Column) -> Column:
        joined = F.array_join(words, "")
        lone_generic = (F.size(words) == 1) & F.array_contains(generic, F.get(words, F.lit(0)))
        return F.when(~lone_generic & F.length(joined).between(4, 30), joined)

    initials_of = F.when(F.size(trimmed) >= 2, trimmed).otherwise(t)
    initials = F.array_join(F.transform(initials_of, lambda w: F.substring(w, 1, 1)), "")
    first = F.coalesce(F.get(trimmed, F.lit(0)), F.get(t, F.lit(0)))
    bases = F.array(
        base(t), base(trimmed), base(F.slice(t, 1, 4)), base(F.slice(trimmed, 1, 3)),
        base(F.slice(t, 1, 2)),
        F.when(F.size(initials_of).between(3, 6), initials),
        F.when((F.length(first) >= 5) & ~F.array_contains(generic, first), first),
    )
    suffixes = literal_array(vocab.DOMAIN_SUFFIXES)
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.array_distinct(F.array_compact(bases)),
                lambda b: F.transform(suffixes, lambda s: F.concat_ws(".", b, s)),
            )
        )
    )


def provider_key(name: Column) -> Column:
    """Spelling variants of one organisation share this key."""
    t = F.regexp_replace(F.lower(name), r"\([^)]*\)?", " ")
    t = F.replace(t, F.lit("&"), F.lit(" and "))
    t = sub(t, r"\bnew york\b", "ny")
    t = sub(t, r"\b(the|inc|incorporated|llc|ltd|corp|corporation)\b", " ")
    return F.regexp_replace(t, "[^a-z0-9]+", "")


def tidy_org(name: Column) -> Column:
    s = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)/Corporate\z", "")
    s = F.trim(F.regexp_replace(s, r"(?i),?\s+(inc|incorporated|llc|ltd)\.?\z", ""))
    shouted = (s == F.upper(s)) & s.rlike(SPACE)
    titled = rewrite(
        s, "[A-Z][A-Z.']*",
        lambda w: F.concat(F.substring(w, 1, 1), F.lower(F.substr(w, F.lit(2)))),
    )
    return F.when(shouted, titled).otherwise(s)


def label(s: Column) -> Column:
    """Display form of a tool or subject."""
    out = F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))
    for raw, shown in vocab.LABELS.items():
        out = F.when(s == raw, F.lit(shown)).otherwise(out)
    return out


def subject_key(subjects: Column) -> Column:
    """First heading, in priority order, that any subject falls under."""
    def teaches(names: list[str]) -> Column:
        return F.exists(subjects, lambda s: F.lower(s).isin(names))

    rules = [F.when(teaches(names), F.lit(key)) for key, names in vocab.SUBJECT_KEYS.items()]
    return F.coalesce(*rules, F.lit("default"))


# --- matches and quotes ---------------------------------------------------

def match_positions(text: Column, pattern: str | Column) -> Column:
    """All matches of a Java pattern as ``array<struct<pos,len>>``, 0-based."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    between = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,len:int>>").alias("out")
    )
    steps = F.zip_with(
        F.slice(between, 1, F.size(hits)), hits,
        lambda gap, length: F.struct(gap.alias("gap"), length.alias("len")),
    )
    return F.aggregate(
        steps, start,
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["len"]).alias("at"),
            F.array_append(
                acc["out"],
                F.struct((acc["at"] + s["gap"]).alias("pos"), s["len"].alias("len")),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _last_index(text: Column, two: str) -> Column:
    at = F.instr(F.reverse(text), F.lit(two[::-1]))
    return F.when(at > 0, F.length(text) - at - 1).otherwise(F.lit(-1))


def quote_around(text: Column, pos: Column, length: Column, reach: int = vocab.QUOTE_REACH) -> Column:
    """The words around a match, cut at a sentence end or at white space.

    Works on the stretch of text in reach, and one character more to see
    whether the text goes on.
    """
    lo = F.greatest(F.lit(0), pos - reach)
    stretch = F.struct(
        F.substring(text, lo + 1, pos - lo).alias("before"),
        F.substring(text, pos + 1, length + reach + 1).alias("rest"),
        (lo > 0).alias("cut"), length.alias("len"),
    )
    return let(stretch, lambda s: _cut_quote(s, reach))


def _cut_quote(s: Column, reach: int) -> Column:
    before, rest, size = s["before"], s["rest"], s["len"]
    stop = F.greatest(*[_last_index(before, mark) for mark in (". ", "! ", "? ")])
    blank = F.instr(before, F.lit(" "))
    begin = (
        F.when(stop >= 0, stop + 2)
        .when(s["cut"], F.when(blank > 0, blank).otherwise(F.length(before)))
        .otherwise(0)
    )

    goes_on = F.length(rest) > size + reach
    after = F.substring(rest, size + 1, F.lit(reach))
    mark = F.regexp_instr(after, F.lit(rf"[.!?]({SPACE}|\z)"))
    tail = F.substring(rest, size + 2, F.lit(reach))
    last_blank = F.instr(F.reverse(tail), F.lit(" "))
    finish = (
        F.when(mark > 0, size + mark)
        .when(goes_on & (last_blank > 0), size + 1 + F.length(tail) - last_blank)
        .otherwise(size + reach)
    )
    cut = F.concat(F.substring(before, begin + 1, F.length(before)), F.substring(rest, F.lit(1), finish))
    return F.regexp_replace(cut, rf"\A{SPACE}+|{SPACE}+\z", "")


def is_navigation(quote: Column) -> Column:
    """A long run of Title Case words with no sentence in it."""
    words = F.filter(F.split(quote, f"{SPACE}+"), lambda w: w.rlike("^[A-Za-z]"))
    titled = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    return (
        ~quote.rlike(r"[.!?]\z") & (F.size(words) >= 10) & (titled / F.size(words) > 0.6)
    )


def usable_quote(quote: Column) -> Column:
    return (
        (F.length(quote) >= vocab.QUOTE_MIN_CHARS)
        & ~has(quote, vocab.NOT_ABOUT_KIDS)
        & ~F.coalesce(is_navigation(quote), F.lit(False))
    )


def tags(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns a text holds, in pattern order."""
    both = F.struct(text.alias("text"), F.lower(text).alias("lowered"))
    return let(both, lambda b: F.array_compact(F.array(*[
        F.when(holds(b["text"], p, b["lowered"]), F.lit(name)) for name, p in patterns.items()
    ])))


def looks_local(
    text: Column, markers: str = vocab.REGION_MARKERS, short: int = vocab.SHORT_PAGE_CHARS
) -> Column:
    """Whether a page names the region; too little text is given the benefit."""
    return (F.length(text) < short) | holds(text, markers)


def first_email(text: Column) -> Column:
    return F.regexp_extract(text, java(vocab.EMAIL, False), 0)


def first_phone(text: Column) -> Column:
    return F.regexp_extract(text, java(vocab.PHONE, False), 0)


def has_program(text: Column) -> Column:
    return holds(text, vocab.HAS_PROGRAM)
