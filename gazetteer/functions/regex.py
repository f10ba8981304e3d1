"""Regular expressions written once, read alike by Java and by ASCII-minded engines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[A-Za-z0-9_]"
EDGE = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"

# Every character an ECMAScript "\s" matches; Java's own "\s" knows ASCII only.
SPACE_SET = r"\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[{SPACE_SET}]"


def java(pattern: str, ignore_case: bool = True) -> str:
    r"""A pattern with ``\b`` as an ASCII word edge (Java's is Unicode-aware).

    Before or after letters one look-around is enough and much faster.
    """
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith(r"\b", i):
            if _starts_with_letter(pattern, i + 2):
                out.append(f"(?<!{WORD})")
            elif _ends_with_letter(pattern, i):
                out.append(f"(?!{WORD})")
            else:
                out.append(EDGE)
            i += 2
        elif pattern[i] == "\\":
            out.append(pattern[i:i + 2])
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    joined = "".join(out)
    return f"(?i){joined}" if ignore_case else joined


def _letter(ch: str) -> bool:
    return ch.isascii() and (ch.isalnum() or ch == "_")


def _starts_with_letter(pattern: str, i: int) -> bool:
    rest = pattern[i:]
    if rest.startswith("("):
        stop = _close(rest, 0)
        inner = rest[1:stop]
        if inner.startswith("?") or rest[stop + 1:stop + 2] in ("?", "*", "{"):
            return False
        return all(_starts_with_letter(part, 0) for part in _alternatives(inner))
    return bool(rest) and _letter(rest[0]) and rest[1:2] not in ("?", "*", "{")


def _ends_with_letter(pattern: str, end: int) -> bool:
    """Whether whatever matches just before ``end`` must end in a letter or digit."""
    if end <= 0:
        return False
    last = pattern[end - 1]
    if last == "?":
        inner = _last_item(pattern, end - 1)
        return inner is not None and _ends_with_letter(pattern, end - 1) and _ends_with_letter(pattern, inner)
    if last == ")":
        start = _last_item(pattern, end)
        inner = pattern[start + 1:end - 1]
        if inner.startswith("?"):
            return False
        return all(_ends_with_letter(part, len(part)) for part in _alternatives(inner))
    escaped = end >= 2 and pattern[end - 2] == "\\"
    return (last == "d" and escaped) or (_letter(last) and not escaped)


def _last_item(pattern: str, end: int) -> int | None:
    """Where the letter or group that ends at ``end`` begins."""
    if pattern[end - 1] != ")":
        return end - 1 if _letter(pattern[end - 1]) else None
    for start in range(end - 1, -1, -1):
        escaped = start > 0 and pattern[start - 1] == "\\"
        if pattern[start] == "(" and not escaped and _close(pattern, start) == end - 1:
            return start
    return None


def _alternatives(pattern: str) -> list[str]:
    """Parts of a pattern between its outermost bars."""
    parts, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif ch == "[":
            i = pattern.index("]", i + 2)
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def _close(pattern: str, i: int) -> int:
    """Index of the bracket that closes the one at ``i``."""
    depth = 0
    while True:
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif ch == "[":
            i = pattern.index("]", i + 2)
        elif ch in "()":
            depth += 1 if ch == "(" else -1
            if depth == 0:
                return i
        i += 1


def needed(pattern: str) -> list[str] | None:
    """Lower-case letters any match must hold: one of these; None if there are none.

    For each alternative the longest plain run is taken, or the runs of a group
    that must occur.
    """
    out: list[str] = []
    for part in _alternatives(pattern):
        choices: list[list[str]] = []
        run, i = "", 0

        def end(run: str) -> None:
            if run:
                choices.append([run])

        while i < len(part):
            ch = part[i]
            if ch == "(":
                stop = _close(part, i)
                inner, after = part[i + 1:stop], part[stop + 1:stop + 2]
                end(run)
                run = ""
                if not inner.startswith("?") and after not in ("?", "*", "{"):
                    inside = needed(inner)
                    if inside:
                        choices.append(inside)
                i = stop + 1
                continue
            if ch in "?*{":
                end(run[:-1])
                run = ""
                i = part.index("}", i) + 1 if ch == "{" else i + 1
                continue
            if ch == "[" or ch in ".+^$":
                end(run)
                run = ""
                i = part.index("]", i + 2) + 1 if ch == "[" else i + 1
                continue
            if ch == "\\":
                i += 1
                if part[i] == "b":
                    i += 1
                    continue
                if part[i].isalnum():
                    end(run)
                    run = ""
                    i += 1
                    continue
                ch = part[i]
            run += ch.lower()
            i += 1
        end(run)
        best = max(choices, key=lambda c: min(len(x) for x in c), default=[])
        if not best or min(len(x) for x in best) < 2:
            return None
        out += best
    return list(dict.fromkeys(out))


def has(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return c.rlike(java(pattern, ignore_case))


def holds(text: Column, pattern: str, lowered: Column | None = None) -> Column:
    """Whether a long text has a pattern, upper or lower case.

    Plain substring search is far cheaper than a regular expression, so texts
    without any of the letters a match needs never reach the expression.  The
    text is read several times: give it a stored column.
    """
    full = text.rlike(java(pattern))
    letters = needed(pattern)
    if not letters or len(letters) > 80:
        return full
    lowered = F.lower(text) if lowered is None else lowered
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(x)) for x in letters]) & full


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sub(c: Column, pattern: str, to: str, ignore_case: bool = True) -> Column:
    return F.regexp_replace(c, java(pattern, ignore_case), to)


def fold_space(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def any_of(words) -> str:
    return "|".join(words)
