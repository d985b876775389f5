"""Answers graded against what they must contain, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------------------------------

#: Least length of a word that may also be written in two; of each part of one that may also be written closed.
LEAST_COMPOUND, LEAST_PART = 6, 2
WORD_BEFORE, DIGIT_BEHIND, WORD_BEHIND = r"(?<![0-9a-z])", r"(?!\d)", r"(?![0-9a-z])"

# --------------------------------------------------------------------------------------------------------------------


def normal(text: Column) -> Column:
    """Folded text without punctuation and symbols, words one space apart; commas inside numbers vanish."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\d),(?=\d)", "")
    folded = F.replace(F.lower(joined), F.lit("ß"), F.lit("ss"))
    return F.btrim(F.regexp_replace(F.regexp_replace(folded, r"[\p{P}\p{S}]", " "), r"\s+", " "))


def spellings(needle: Column) -> Column:
    """A normal needle as it is, closed where its words are long enough, or open at any one place where it is one long word."""
    parts, n = F.split(needle, " "), F.length(needle)
    closed = F.forall(parts, lambda p: F.length(p) >= LEAST_PART)
    opened = F.transform(F.sequence(F.lit(2), n - 2), lambda i: F.concat(F.substring(needle, F.lit(1), i), F.lit(" "), F.substring(needle, i + 1, n)))
    more = F.when(F.size(parts) > 1, F.when(closed, F.array(F.replace(needle, F.lit(" "), F.lit(""))))).when(n >= LEAST_COMPOUND, opened)
    return F.concat(F.array(needle), F.coalesce(more, F.array().cast("array<string>")))


def stands_in(answer: Column, surface: Column) -> Column:
    """Whether a surface stands in a normal answer as words of its own; behind a number only digits are kept away (units may follow)."""
    needle = normal(surface)
    edge = F.when(needle.rlike(r"^\d+$"), F.lit(DIGIT_BEHIND)).otherwise(F.lit(WORD_BEHIND))
    return (needle != "") & F.exists(spellings(needle), lambda form: F.regexp_like(answer, F.concat(F.lit(WORD_BEFORE), form, edge)))


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.btrim(p)), lambda p: p != "")


def grade(answer: Column, spec: Column) -> Column:
    """Struct (correct, completeness, missing) of an answer by ``one|other; next + bonus words``.

    Groups are parted by semicolons, of each one alternative must stand in the answer; words behind a plus only count
    for completeness. Null where the spec has no group; a null answer holds nothing.
    """
    said = normal(answer)
    groups = _trimmed(F.split(F.substring_index(spec, "+", 1), ";"))
    bonus = _trimmed(F.split(F.when(F.instr(spec, "+") > 0, F.substring(spec, F.instr(spec, "+") + 1, F.length(spec))).otherwise(F.lit("")), r"\s+"))
    alternatives = lambda g: _trimmed(F.split(g, r"\|"))
    missing = F.filter(groups, lambda g: ~F.exists(alternatives(g), lambda a: stands_in(said, a)))
    share = F.when(F.size(bonus) == 0, F.lit(1.0)).otherwise(F.size(F.filter(bonus, lambda b: stands_in(said, b))) / F.size(bonus))
    return F.when(F.size(groups) > 0, F.struct((F.size(missing) == 0).alias("correct"), share.alias("completeness"), F.transform(missing, lambda g: F.array_join(alternatives(g), "|")).alias("missing")))
