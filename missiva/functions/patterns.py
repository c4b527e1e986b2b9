"""Column helpers for regular expressions with Unicode classes, offsets, and ranked candidates."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, reduce
from re import _constants as node
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(pattern: str, flags: str = "") -> str:
    """A Java pattern whose classes are Unicode's and whose line end is ``\\n`` alone."""
    return f"(?Ud{flags}){pattern}"


#: The shortest literal that is worth looking for before a pattern is tried, and how many may stand for each other.
LITERAL_LEAST, LITERALS_MOST = 2, 12
#: Capitals and other letters that a pattern without case takes for i, s and k, and ``lower`` doesn't.
ODD_CASES = "\u0130\u0131\u017f\u212a"

def _literals(items) -> tuple[str, ...]:
    """Of a parsed pattern, the literals of which each match holds one; () where none is long enough or they are too many."""
    found, run = [], ""
    for op, value in [*items, (None, None)]:
        if op is node.LITERAL:
            run += chr(value)
            continue
        found.append((run,))
        run = ""
        if op is node.SUBPATTERN and not value[1] and not value[2]:
            found.append(_literals(value[3]))
        elif op is node.BRANCH:
            each = [_literals(x) for x in value[1]]
            found.append(tuple(dict.fromkeys(lit for one in each for lit in one)) if all(each) else ())
        elif op in (node.MAX_REPEAT, node.MIN_REPEAT) and value[0] > 0:
            found.append(_literals(value[2]))
    fit = [x for x in found if x and len(x) <= LITERALS_MOST and min(map(len, x)) >= LITERAL_LEAST]
    return max(fit, key=lambda x: (-len(x), min(map(len, x))), default=())


@cache
def literals(pattern: str) -> tuple[str, ...]:
    """Literals of which each match of the pattern holds one, as far as they can be read from it; () without any."""
    try:
        return _literals(parser.parse(re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", pattern).replace(r"\z", r"\Z")))
    except re.error:  # Java's alone
        return ()


def _parsed(pattern: str):
    try:
        return parser.parse(re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", pattern).replace(r"\z", r"\Z"))
    except re.error:  # Java's alone
        return None


@cache
def _never_empty(pattern: str, index: int) -> bool:
    """Whether the group has a character in every match."""
    parsed = _parsed(pattern)

    def within(items) -> bool:
        return any(
            op is node.SUBPATTERN and (value[0] == index and value[3].getwidth()[0] > 0 or within(value[3])) for op, value in items
        )

    return parsed is not None and (parsed.getwidth()[0] > 0 if index == 0 else within(parsed))


def folded(text: Column) -> Column:
    """The text in lower case, as a pattern without case sees it."""
    odd = reduce(lambda a, b: a | b, (text.contains(x) for x in ODD_CASES))
    return F.lower(F.when(odd, F.translate(text, ODD_CASES, "iisk")).otherwise(text))


def may_hold(text: Column, pattern: str, flags: str = "", low: Column | None = None) -> Column | None:
    """Whether the text holds one of the pattern's literals, which is far cheaper than to try the pattern; None if it has none. ``low``: folded(text), where that is known."""
    looked_for = literals(pattern)
    if not looked_for:
        return None
    if "i" not in flags:
        return reduce(lambda a, b: a | b, (text.contains(x) for x in looked_for))
    wanted = dict.fromkeys(x.lower() for x in looked_for)
    return let(folded(text) if low is None else low, lambda low: reduce(lambda a, b: a | b, (low.contains(x) for x in wanted)))


def has(text: Column, pattern: str, flags: str = "", low: Column | None = None) -> Column:
    def tried(t: Column) -> Column:
        return t.rlike(rx(pattern, flags))

    if not literals(pattern):
        return F.coalesce(tried(text), F.lit(False))
    return F.coalesce(let(text, lambda t: may_hold(t, pattern, flags, low) & tried(t)), F.lit(False))


@cache
def others(letters: str) -> str:
    """The class of all characters that aren't in the class ``letters``, by ranges: Java runs a negated class many times more slowly."""
    said = parser.parse(re.sub(r"\\x\{([0-9A-F]{1,4})\}", lambda m: f"\\u{m[1]:0>4}", f"[{letters}]"))[0]
    items = [said] if said[0] is not node.IN else said[1]
    spans = sorted((v, v) if op in (node.LITERAL, node.NOT_LITERAL) else v for op, v in items if op is not node.NEGATE)
    if items[0][0] not in (node.NEGATE, node.NOT_LITERAL):
        ends = [-1, *(x for low, high in spans for x in (low, high)), 0x110000]
        spans = [(low + 1, high - 1) for low, high in zip(ends[::2], ends[1::2]) if low + 1 <= high - 1]
    return "[" + "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in spans) + "]"


def any_of(text: Column, letters: str) -> Column:
    """Whether a character of the class ``letters`` (without its brackets) occurs: one run over those before it, not a trial at each place."""
    return ~text.rlike(rf"\A{others(letters)}*+\z")


def group(text: Column, pattern: str, index: int = 1, flags: str = "", low: Column | None = None) -> Column:
    """A group of the first match; null without a match."""

    def found(t: Column) -> Column:
        taken = F.regexp_extract(t, rx(pattern, flags), index)
        if not _never_empty(pattern, index):
            return F.when(has(t, pattern, flags, low), taken)
        may = may_hold(t, pattern, flags, low)
        return non_empty(taken if may is None else F.when(may, taken))

    return let(text, found)


def sub(text: Column, pattern: str, to: str, flags: str = "") -> Column:
    return F.regexp_replace(text, rx(pattern, flags), to)


def where_it_may(text: Column, pattern: str, flags: str, then: Callable[[Column], Column], low: Column | None = None) -> Column:
    """then(text), which changes nothing without a match, where the text holds the pattern's literals."""
    return let(text, lambda t: F.when(may_hold(t, pattern, flags, low), then(t)).otherwise(t)) if literals(pattern) else then(text)


def before(text: Column, pattern: str, flags: str = "", low: Column | None = None) -> Column:
    """The text up to the first match; all of it without one. (split would compile its pattern for every row.)"""
    return where_it_may(text, pattern, flags, lambda t: sub(t, rf"(?:{pattern})(?s:.*)\z", "", flags), low)


def after(text: Column, pattern: str, flags: str = "", low: Column | None = None) -> Column:
    """The text past the first match; all of it without one."""
    return where_it_may(text, pattern, flags, lambda t: sub(t, rf"\A(?s:.*?)(?:{pattern})", "", flags), low)


def zone_before(text: Column, pattern: str, otherwise: int) -> Column:
    """The text up to the first match of a pattern that takes a character or more; without one, its first characters. The pattern is tried once."""
    return let(text, lambda t: let(before(t, pattern), lambda x: F.when(x != t, x).otherwise(F.substring(t, 1, otherwise))))


def start(text: Column, pattern: str, flags: str = "") -> Column:
    """Characters before the first match; the whole length without one."""
    return F.length(before(text, pattern, flags))


def end(text: Column, pattern: str, flags: str = "") -> Column:
    """Characters up to the end of the first match; null without one."""
    return F.when(has(text, pattern, flags), F.length(text) - F.length(after(text, pattern, flags)))


def either(patterns: tuple[str, ...]) -> str:
    """One pattern, whose first match begins where the earliest match of any of the patterns does."""
    return "|".join(f"(?:{p})" for p in patterns)


def groups(text: Column, pattern: str, n: int, flags: str = "") -> Column:
    """Groups 1 to n of the first match as an array; null without a match. The pattern, which looks no further than its match, is found once and read again in the match alone."""
    between = "\x01"  # no letter holds it
    found = group(text, pattern, 0, flags)
    return let(found, lambda m: F.when(m.isNotNull(), F.split(sub(m, rf"\A(?:{pattern})\z", between.join(f"${i}" for i in range(1, n + 1)), flags), between, -1)))


#: Arabic letters and marks; without one, no Arabic rule can match.
ARABIC_BLOCK = r"[\x{0600}-\x{06FF}]"


def any_bytes(text: Column, *looked_for: str) -> Column:
    """Whether one of these runs of bytes (in hexadecimal) stands in the text's UTF-8: no character is decoded for it."""
    return let(text.cast("binary"), lambda x: reduce(lambda a, b: a | b, (F.contains(x, F.lit(bytes.fromhex(y))) for y in looked_for)))


def has_arabic(text: Column) -> Column:
    """Whether a character of the block occurs: just those begin with one of these four bytes, and no other byte of a text is one of them."""
    return F.coalesce(any_bytes(text, "D8", "D9", "DA", "DB"), F.lit(False))


def cut(text: Column, low: Column | int, high: Column) -> Column:
    """text[low:high], by characters from 0."""
    low = F.greatest(F.lit(low) if isinstance(low, int) else low, F.lit(0))
    return F.substring(text, low + 1, F.greatest(high - low, F.lit(0)))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: All characters that ``\s`` takes for blanks.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def non_empty(text: Column) -> Column:
    return let(text, lambda x: F.when(x != "", x))


def matches(text: Column, pattern: str, flags: str = "", low: Column | None = None) -> Column:
    """All matches, in order: array<struct<m, at>>, with at the characters before each."""

    def placed(t: Column, found: Column) -> Column:
        def one(between: Column) -> Column:
            return F.transform(
                found,
                lambda m, i: F.struct(
                    m.alias("m"),
                    (
                        F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
                        + F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x))
                    ).alias("at"),
                ),
            )

        return F.when(F.size(found) > 0, let(F.split(t, rx(pattern, flags), -1), one))

    def of(t: Column) -> Column:
        may = may_hold(t, pattern, flags, low)
        found = F.regexp_extract_all(t, F.lit(rx(f"({pattern})", flags)), 1)
        return let(found if may is None else F.when(may, found), lambda x: F.coalesce(placed(t, x), F.array().cast("array<struct<m:string,at:int>>")))

    return let(text, of)


def _only_arabic(pattern: str) -> bool:
    """Whether each alternative of a pattern from a rule table asks for an Arabic letter at its very start (anchors and blanks apart)."""
    return all(re.match(r"(?:\^|\\b|\\s\*|\(\?:)*[\u0600-\u06FF]", x) for x in pattern.split("|"))


def _folded_once(text: Column, flags: str, then: Callable[[Column, Column | None], Column]) -> Column:
    return let(text, lambda t: let(folded(t), lambda low: then(t, low)) if "i" in flags else then(t, None))


def _may_occur(text: Column, pattern: str, flags: str, arabic: Column | None, low: Column | None) -> Column:
    found = has(text, pattern, flags, low)
    return found if arabic is None or not _only_arabic(pattern) else arabic & found


def first_name(text: Column, table: list[tuple[str, str]], flags: str = "", arabic: Column | None = None) -> Column:
    """The name of the first row of (pattern, name) that occurs; ``arabic``: whether the text holds Arabic letters, where that is known."""
    return _folded_once(text, flags, lambda t, low: F.coalesce(*(F.when(_may_occur(t, p, flags, arabic, low), F.lit(name)) for p, name in table)))


def best_name(text: Column, table: list[tuple[str, str, int]], flags: str = "", arabic: Column | None = None) -> Column:
    """The name with the highest priority of (pattern, name, priority); the earliest row wins ties."""
    order = sorted(range(len(table)), key=lambda i: (-table[i][2], i))
    return _folded_once(text, flags, lambda t, low: F.coalesce(*(F.when(_may_occur(t, table[i][0], flags, arabic, low), F.lit(table[i][1])) for i in order)))


def mapped(key: Column, table: dict[str, str]) -> Column:
    """table[key]; null if it isn't there."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)
