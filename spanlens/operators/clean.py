"""Cleaning of extracted text, line by line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlens.functions.text import SPACE, let, lines_of, pattern, trim, words

#: What is a page footer, a glued sentence and a glued location.
PAGE_FURNITURE = r"\A(?:page|p[áa]g(?:ina)?)\s*\d+\s*(?:of|de)\s*\d+$"
GLUED_SENTENCE = r"(?=[.;])(?<!\b[A-ZÀ-Ý])([.;])(?=[A-ZÀ-Ý])"
LOCATION_GLUE = r"\A((?![\d])[^,\n\d]{2,28}(?:,\s[^,\n\d]{2,28}){2})\s+(?=[A-ZÀ-Ý][a-zà-ÿ]{2}[^\n]{26,})"
LOCATION_CHARS, PART_CHARS, PART_WORDS = 60, 28, 4


def is_page_furniture(line: Column) -> Column:
    return trim(line).rlike(pattern(PAGE_FURNITURE))


def unglue_sentence(line: Column) -> Column:
    """A space after a full stop or semicolon that touches the next capital; initials stay."""
    return F.regexp_replace(line, pattern(GLUED_SENTENCE, ignore_case=False), "$1 ")


def is_location(line: Column) -> Column:
    """Two or three short capitalised parts between commas, without digits or sentence marks."""
    def part_fits(part: Column) -> Column:
        return F.char_length(part).between(2, PART_CHARS) & part.rlike(r"\A\p{Lu}") & (F.size(words(part)) <= PART_WORDS)

    def read(whole: Column) -> Column:
        parts = F.transform(F.split(whole, ",", -1), trim)
        shaped = (F.char_length(whole) <= LOCATION_CHARS) & whole.rlike(r"\A[^,]*(?:,[^,]*){1,2}\z") & ~whole.rlike("[0-9.;:]")
        return F.when(shaped, F.forall(parts, part_fits)).otherwise(False)

    return F.when(F.contains(line, F.lit(",")), let(trim(line), read)).otherwise(False)


def split_location(line: Column) -> Column:
    """A line break after a location that runs straight into a sentence."""
    rule = pattern(LOCATION_GLUE, ignore_case=False)
    place = F.regexp_extract(line, rule, 1)
    cut = F.concat(place, F.lit("\n"), F.regexp_replace(line, rule, ""))
    return F.when((place != "") & is_location(place), cut).otherwise(line)


def clean_text(text: Column) -> Column:
    """All lines cleaned, page footers left out.

    Glyphs of private use become spaces, then glued sentences and then locations
    are cut.  Only texts that hold a footer or a glued location anywhere are
    taken apart into lines.
    """
    footer = "(?m)" + pattern(PAGE_FURNITURE).replace(r"\A", "^" + SPACE + "*").replace(r"\z", SPACE + "*$")
    glued = "(?m)" + pattern(LOCATION_GLUE, ignore_case=False).replace(r"\A", "^")

    def by_line(x: Column) -> Column:
        return F.array_join(F.transform(lines_of(x), split_location), "\n")

    kept = let(text, lambda t: F.when(t.rlike(footer), F.array_join(F.filter(lines_of(t), lambda x: ~is_page_furniture(x)), "\n")).otherwise(t))
    spaced = unglue_sentence(F.regexp_replace(kept, r"\p{Co}", " "))
    return let(spaced, lambda t: F.when(F.contains(t, F.lit(",")) & t.rlike(glued), by_line(t)).otherwise(t))
