"""Quality rules: a threshold table compiled into one projection of native functions.

Each row of RULES bounds one measure of a text. `measures` adds the counts, `verdict` turns
the table into a single boolean expression, `apply` does both. No user function and no
shuffle takes part: the plan is one narrow projection over the scan.

Defined cases: a null text counts as the empty text; texts without words have all counts 0
and fail (too short); very long texts are counted whole; there are no ties; an empty table gives an empty result; lines without a word are no lines; extra columns are ignored by the
counts, and a column of the input that has the name of a count is replaced; repeated rows
are judged one by one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faturaflow.llm.common import BLANKS, WORD, all_of, bind

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Frequent function words of the corpus languages; fixed values.
STOP_WORDS = (
    "the of and to in is that for it as with on be at by this are or from an was a "
    "de la le et les des en un du que une pour dans qui par sur au "
    "der die und den von zu das mit sich ist nicht ein dem "
    "el los y se del las con no su para es al lo como"
).split()


class Rule(NamedTuple):
    """A text passes where low <= measure / per <= high; texts under min_words words always pass."""

    measure: str
    per: str
    low: float | None
    high: float | None
    min_words: int = 0


RULES = (
    Rule("n_words", "one", 10, None),
    Rule("n_repeat_words", "n_words", None, 0.20),
    Rule("word_chars", "n_words", 2.0, 15.0, 10),
    Rule("n_symbols", "n_words", None, 0.30),
    Rule("n_stop_words", "n_words", 0.02, None, 50),
    Rule("n_dup_lines", "n_lines", None, 0.40),
)


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that the text holds twice or more.

    Windows are compared by a 64-bit hash of five 64-bit word hashes. Texts whose windows are
    all distinct, found by one hash-set pass, end there; the others sort (hash, position).
    """

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]),
        )

    def covered(at: Column) -> Column:
        each = F.zip_with(
            at,
            F.slice(at, 2, F.size(at)),
            lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))),
        )
        return F.aggregate(each, F.lit(0), lambda total, n: total + n)

    def repeated(s: Column) -> Column:
        same = F.zip_with(
            s,
            F.slice(s, 2, F.size(s)),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])),
        )
        twice = F.flatten(F.filter(same, lambda x: x.isNotNull()))
        return bind(F.sort_array(F.array_distinct(twice)), covered)

    def count(g: Column) -> Column:
        pairs = F.transform(g, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            bind(F.array_sort(pairs), repeated)
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(
        F.size(words) >= WINDOW, bind(hashes, lambda h: bind(windows(h), count))
    ).otherwise(F.lit(0))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words (long)."""
    t = F.coalesce(F.col(text), F.lit(""))

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            bind(
                lines,
                lambda x: F.struct(
                    F.size(x).cast("long").alias("n"),
                    (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
                ),
            ).alias("lines"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS))))
            .cast("long")
            .alias("n_stop_words"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    m = "__measures"
    kept = docs.withColumn(m, bind(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), counts))
    return kept.withColumns(
        {
            "n_words": F.col(f"{m}.n_words"),
            "word_chars": F.col(f"{m}.word_chars"),
            "n_symbols": F.col(f"{m}.n_symbols"),
            "n_lines": F.col(f"{m}.lines.n"),
            "n_dup_lines": F.col(f"{m}.lines.dup"),
            "n_stop_words": F.col(f"{m}.n_stop_words"),
            "n_repeat_words": F.col(f"{m}.n_repeat_words"),
        }
    ).drop(m)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where a row with measures passes every rule; the products keep integers exact."""
    checks = []
    for r in rules:
        per = F.lit(1) if r.per == "one" else F.col(r.per)
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (1000 * F.col(r.measure) >= round(1000 * r.low) * per)
        if r.high is not None:
            ok = ok & (1000 * F.col(r.measure) <= round(1000 * r.high) * per)
        checks.append((F.col("n_words") < r.min_words) | ok if r.min_words else ok)
    return all_of(checks)


def apply(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measures and `kept`, true where every rule passes."""
    return measures(docs, text).withColumn("kept", verdict(rules))


def _sql_rule(r: Rule) -> str:
    per = "1" if r.per == "one" else r.per
    parts = [f"1000 * {r.measure} >= {round(1000 * r.low)} * {per}"] if r.low is not None else []
    parts += [f"1000 * {r.measure} <= {round(1000 * r.high)} * {per}"] if r.high is not None else []
    both = " AND ".join(parts)
    return f"(n_words < {r.min_words} OR ({both}))" if r.min_words else f"({both})"


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the digest of `documents`."""
    from faturaflow.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return apply(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"),
        "n_stop_words", "n_lines",
    )


def sql() -> str:
    """The digest in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    rules = " AND ".join(map(_sql_rule, RULES))
    word = WORD.replace(r"\x09", r"\x{9}").replace(r"\x0D", r"\x{D}").replace(r"\x20", r"\x{20}")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM d),
u AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS p, ws FROM w WHERE len(ws) >= 5),
g AS (SELECT doc_id, p, list_slice(ws, p, p + 4) AS win FROM u),
c AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words
      FROM c, (SELECT unnest(range(0, 5)) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)) AND {rules} AS kept,
       n_stop_words, n_lines
FROM m"""
