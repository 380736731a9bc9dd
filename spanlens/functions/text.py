"""Column functions for text: trimming, boundaries, accents, spans with positions.

Offsets and lengths count code points.  Regular expressions are Java's; what the
rules need beyond it is spelt out here: white space that includes the no-break
space and all Unicode spaces, and a word boundary for ASCII words only, so that an
accented letter is no word character.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
NOT_SPACE = "[^" + SPACE[1:]
#: The characters of `SPACE` themselves.
SPACES = "\t\n\x0B\f\r \u00A0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202F\u205F\u3000\uFEFF"
WORD_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

MARK, PART = "\x01", "\x02"


def pattern(rule: str, ignore_case: bool = True) -> str:
    r"""A rule in Java's dialect: ``\s``, ``\S`` and ``\b`` as defined above, ``$`` as the very end."""
    out = rule.replace(r"\S", NOT_SPACE).replace(r"\s", SPACE).replace(r"\b", WORD_EDGE)
    out = out.replace(r"\$", "\x00").replace("$", r"\z").replace("\x00", r"\$")
    return ("(?iu)" if ignore_case else "(?u)") + out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim(F.regexp_replace(text, SPACE + "+", " "))


def is_blank(text: Column) -> Column:
    return trim(text) == ""


def begins(words: list[str], other: str = "") -> str:
    """A rule that fits where one of ``words`` begins, told letter by letter; ``other`` may stand for any letter and ends it."""
    if "" in words:
        return ""
    heads = dict.fromkeys(w[0] for w in words)
    branches = [re.escape(c) + begins([w[1:] for w in words if w[0] == c], other) for c in heads]
    return "(?:" + "|".join(branches + [other] * (other != "")) + ")"


def words(text: Column) -> Column:
    return F.split(text, SPACE + "+", -1)


@lru_cache(maxsize=1)
def _plain_letters() -> tuple[str, str]:
    """Precomposed letters whose decomposition is one letter and marks U+0300 to U+036F."""
    found = {}
    for code in range(0xC0, 0x2000):
        first, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(0x300 <= ord(m) <= 0x36F for m in marks):
            found[chr(code)] = first
    return "".join(found), "".join(found.values())


def strip_accents(text: Column) -> Column:
    """Letters without accents; composed text keeps its length."""
    plain = F.regexp_replace(F.translate(text, *_plain_letters()), r"[\u0300-\u036F]", "")
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(plain)


def flat(text: Column) -> Column:
    """Lower case without accents, the form in which terms are compared."""
    return F.lower(strip_accents(text))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


#: Items that one walk takes; longer arrays are walked in parts of this (even) size.
STEP = 64


def quoted(text: str) -> str:
    """A Python string as a literal of Spark SQL, taken as it stands."""
    if '"' in text:
        raise ValueError("a raw literal cannot hold a quotation mark")
    return f'r"{text}"'


def in_parts_sql(items: str, walk: Callable[[str, str], str]) -> str:
    """Arrays that ``walk(part, number of the part)`` makes of parts of an array, one after the other."""
    cut = f"slice({items}, c * {STEP} + 1, {STEP})"
    return f"flatten(transform(sequence(0, CAST(floor((size({items}) - 1) / {STEP}) AS INT)), c -> {walk(cut, 'c')}))"


def bound(value: Column, sql: Callable[[str], str]) -> Column:
    """SQL text over a value that it knows by name and that is computed once.

    Large expressions are put together as text: to parse one is far cheaper than to build it call by call.
    """
    return F.call_function("transform", F.array(value), F.expr(f"t -> {sql('t')}"))[0]


def let_sql(name: str, value: str, use: str) -> str:
    return f"transform(array({value}), {name} -> {use})[0]"


def spans_sql(text: str, rule: str, groups: int = 0) -> str:
    """`spans` as SQL text."""
    kind = "ARRAY<STRUCT<idx: INT, quote: STRING" + "".join(f", g{g}: STRING" for g in range(1, groups + 1)) + ">>"
    inner = "".join(f"${g}{PART}" for g in range(1, groups + 1)) + "$0"
    clear = f"replace(replace({text}, '{MARK}', ' '), '{PART}', ' ')"
    pieces = f"split(regexp_replace({clear}, {quoted(rule)}, '{MARK}{inner}{MARK}'), '{MARK}', -1)"
    named = "'idx', s.at, 'quote', element_at(split(x, '{0}', -1), -1)" + "".join(f", 'g{g}', split(x, '{{0}}', -1)[{g - 1}]" for g in range(1, groups + 1))
    named = named.format(PART)

    def length(piece: str) -> str:
        return f"char_length(substring_index({piece}, '{PART}', -1))"

    def walk(part: str, at: str) -> str:
        found = f"CASE WHEN s.odd THEN CAST(concat(s.found, array(named_struct({named}))) AS {kind}) ELSE s.found END"
        start = f"named_struct('at', {at}, 'odd', false, 'found', CAST(array() AS {kind}))"
        return f"aggregate({part}, {start}, (s, x) -> named_struct('at', s.at + {length('x')}, 'odd', NOT s.odd, 'found', {found}), s -> s.found)"

    sums = in_parts_sql("p", lambda part, c: f"array(aggregate({part}, 0, (n, x) -> n + {length('x')}))")
    begins = f"aggregate({sums}, named_struct('at', 0, 'all', CAST(array() AS ARRAY<INT>)), (s, n) -> named_struct('at', s.at + n, 'all', CAST(concat(s.all, array(s.at)) AS ARRAY<INT>)), s -> s.all)"
    long = let_sql("b", begins, in_parts_sql("p", lambda part, c: walk(part, f"b[{c}]")))
    scan = f"CASE WHEN size(p) <= {STEP} THEN {walk('p', '0')} ELSE {long} END"
    # no marks, no walk: most texts hold no match of most patterns
    return f"CASE WHEN {text} IS NOT NULL AND {text} RLIKE {quoted(rule)} THEN {let_sql('p', pieces, scan)} ELSE CAST(array() AS {kind}) END"


def spans(text: Column, rule: str, groups: int = 0) -> Column:
    """All matches of a pattern, as an array of ``(idx, quote, g1, ...)`` in order of place.

    Matches are put between marks and the text is cut there, so every second
    piece is a match and places are running lengths.  The marks' own characters
    count as spaces.  Pieces are walked in parts that begin at sums of lengths, as
    one walk copies all it has found at every step.
    """
    return bound(text, lambda t: spans_sql(t, rule, groups))


def first_replaced(text: Column, part: Column, by: str = "") -> Column:
    """``text`` with the first occurrence of ``part`` replaced, as plain text."""
    at = F.call_function("instr", text, part)
    whole = F.concat(F.call_function("substring", text, F.lit(1), at - 1), F.lit(by), F.call_function("substring", text, at + F.char_length(part)))
    return F.when((at > 0) & (F.char_length(part) > 0), whole).otherwise(text)
