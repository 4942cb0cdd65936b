"""Regular-expression helpers with the reference dialect: Unicode classes, `.` stops at LF only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the reference's dialect has it: Unicode white space and the four separators FS to US.
S = r"[\s\x1C-\x1F]"
#: Flags: U Unicode classes, i and u case-insensitive beyond ASCII, d only LF ends a line.
EXACT, LOOSE = "(?U)", "(?iudU)"
#: Ends of words, where a word has letters, digits and _ only: neither marks nor joiners belong to it.
BEGIN, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, as a lambda's variable, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"{EXACT}^{S}+|{S}+$", "")


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the end of the text opens no further line."""
    return F.split(F.regexp_replace(text, f"(?:{LINE_END})$(?!\\n)", ""), LINE_END)


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
