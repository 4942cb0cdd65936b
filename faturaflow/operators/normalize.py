"""NORMALIZE: from extracted text to clean lines, in a fixed order that matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faturaflow.functions.rx import END, EXACT, S, lines, strip

#: Lines that stay although short.
SHORT_LINES = (
    "AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO "
    "NF RG IE IM CPF"
).split()


def require_text(df: DataFrame, column: str) -> DataFrame:
    """df, or an error that names the type where the column is no text."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.StringType):
        raise TypeError(f"normalize_text needs a string column, got {kind.simpleString()}")
    return df


def replace_literals(t: Column) -> Column:
    for old, new in (("\u00a0", " "), ("\u200b", ""), ("\r\n", "\n")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def collapse_white_space(t: Column) -> Column:
    t = F.regexp_replace(t, r"[ \t\f\x0B]+", " ")
    return strip(F.regexp_replace(t, r"\n{2,}", "\n\n"))


def join_digits(t: Column) -> Column:
    """White space between two digits goes, line ends included."""
    return F.regexp_replace(t, rf"{EXACT}(?<=\d){S}+(?=\d)", "")


def respace_dates(t: Column) -> Column:
    return F.regexp_replace(t, rf"{EXACT}(\d{{2}}/\d{{2}}/\d{{4}})(\d{{2}}:\d{{2}}:\d{{2}})", "$1 $2")


def tighten_commas(t: Column) -> Column:
    return F.regexp_replace(t, rf"{EXACT}(\d){S}*,{S}*(\d{{2}})", "$1,$2")


def drop_thousand_dots(t: Column) -> Column:
    return F.regexp_replace(t, rf"{EXACT}(?<=\d){S}*\.{S}*(?=\d{{3}}{END})", "")


def informative_lines(found: Column) -> Column:
    """Stripped lines without noise: under three characters and no digit, unless a known sign."""

    def keep(x: Column) -> Column:
        return F.upper(x).isin(SHORT_LINES) | (F.length(x) >= 3) | x.rlike(rf"{EXACT}\d")

    return F.filter(F.transform(found, strip), keep)


def distinct_lines(found: Column) -> Column:
    """Each line once, where it first stands."""
    return F.array_distinct(found)


def join_lines(found: Column) -> Column:
    return F.array_join(found, "\n")


def normalize_text(t: Column) -> Column:
    for step in (replace_literals, collapse_white_space, join_digits, respace_dates, tighten_commas, drop_thousand_dots):
        t = step(t)
    return join_lines(distinct_lines(informative_lines(lines(t))))
