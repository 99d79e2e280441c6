"""Text columns. White space is stripped as a whole, not only blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases by which an answer admits that the document does not say.
REFUSALS = (
    r"\bnot stated\b",
    r"\bnot (?:be )?(?:specified|disclosed|provided|reported|included|given)\b",
    r"\bdoes not (?:state|say|specify|disclose|provide|report|contain|include|break)\b",
    r"\bdoesn't (?:state|say|specify|disclose|provide|report|contain|include|break)\b",
    r"\bno (?:information|breakdown|figure|data|mention|disclosure)\b",
    r"\bcannot (?:be )?(?:determined|answered|found)\b",
    r"\bcan't be (?:determined|answered|found)\b",
    r"\bnot available\b",
    r"\bis not in the (?:report|document|context)\b",
    r"\bunable to (?:answer|determine|find)\b",
    r"\bhad not closed\b",
    r"\bnot yet closed\b",
    r"\bonly provides guidance\b",
    r"\bguidance,? not actual\b",
)
#: Fixed value: a number as it is written, with thousands separators.
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: What \s of a pattern takes.
BLANK = " \t\n\x0b\f\r"


def strip(c) -> Column:
    return F.trim(col(c), F.lit(BLANK))


def norm(c) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def number_tokens(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(NUMBER), F.lit(0))


def to_number(c) -> Column:
    return F.regexp_replace(col(c), ",", "").try_cast("double")


def numbers(c) -> Column:
    """All readable numbers in order."""
    return F.filter(F.transform(number_tokens(c), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull())


def is_refusal(c) -> Column:
    return norm(c).rlike("|".join(REFUSALS))


def excerpt(c) -> Column:
    """First and last character, stars between; values under three characters are all stars."""
    c = col(c)
    n = F.length(c)
    return F.when(n < 3, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(c, 1, 1), F.repeat(F.lit("*"), n - 2), F.right(c, F.lit(1))))


def slug(c) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def extension(c) -> Column:
    return F.lower(F.regexp_extract(col(c), r"\.[^./]+$", 0))


def tokens(c) -> Column:
    """The default tokens: white space with the word after it; they join back to the text."""
    return F.regexp_extract_all(col(c), F.lit(r"\s*\S+"), F.lit(0))
