"""One query for each operator or family of the fiscal engine, with an independent answer in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faturaflow.functions import validators as V
from faturaflow.functions.rx import bind
from faturaflow.operators import audit, extract, normalize, segment, trust
from faturaflow.plans import pipeline, render
from faturaflow.plans.render import table
from faturaflow.sinks import payloads
from faturaflow.sources import documents

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# --- NORMALIZE, over documents ---------------------------------------------------------------

_WS = r"[\t\n\v\f\r \x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = rf"'^{_WS}+|{_WS}+$', '', 'g'"


#: What a third of the texts get at their end, so that every rule of the normaliser has something to do.
_MARKS = " a\u00a0b\u200bc\r\nEmitida 05/06/202411:22:33 valor 1 , 25 de 12 . 345\u200d"
_TEXT = "(text || CASE WHEN doc_id % 3 = 0 THEN " + " || ".join(f"chr({ord(c)})" if ord(c) < 32 or ord(c) > 126 else f"'{c}'" for c in _MARKS) + " ELSE '' END)"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, _MARKS).otherwise("")))


def _texts(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _marked(spark, sf_dir).select("doc_id", f(F.col("text")).alias("result"))

    return run


def _text_query(name: str, f, sql: str) -> None:
    QUERIES[name] = _texts(f)
    SQL[name] = f"SELECT doc_id, {sql} AS result FROM (SELECT doc_id, {_TEXT} AS text FROM documents)"


_LITERAL = "replace(replace(replace(text, chr(160), ' '), chr(8203), ''), chr(13) || chr(10), chr(10))"
def _collapsed(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '[ \t\f\v]+', ' ', 'g'), '\n{{2,}}', chr(10) || chr(10), 'g'), {_STRIP})"


def _joined(x: str) -> str:
    """Twice, as one pass leaves every other gap of single digits."""
    return rf"regexp_replace(regexp_replace({x}, '(\d){_WS}+(\d)', '\1\2', 'g'), '(\d){_WS}+(\d)', '\1\2', 'g')"


_text_query("literal_replacements", normalize.replace_literals, _LITERAL)
_text_query("ws_collapse", normalize.collapse_white_space, _collapsed("text"))
_text_query("digit_join", normalize.join_digits, _joined("text"))
_text_query("date_respacing", normalize.respace_dates, r"regexp_replace(text, '(\d{2}/\d{2}/\d{4})(\d{2}:\d{2}:\d{2})', '\1 \2', 'g')")
_text_query("comma_tighten", normalize.tighten_commas, rf"regexp_replace(text, '(\d){_WS}*,{_WS}*(\d{{2}})', '\1,\2', 'g')")


def _undotted(x: str) -> str:
    """Cut at the dots; a dot stays unless a digit stands before it and three digits behind."""
    dot = rf"'{_WS}*\.{_WS}*'"
    return rf"""(SELECT array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i = len(p) OR (regexp_matches(p[i], '\d$') AND regexp_matches(p[i + 1], '^\d{{3}}\b')) THEN '' ELSE s[i] END), '')
  FROM (SELECT string_split_regex(w, {dot}) AS p, regexp_extract_all(w, {dot}) AS s FROM (SELECT {x} AS w)))"""


_text_query("dot_removal", normalize.drop_thousand_dots, _undotted("text"))
_KEEP = ", ".join(f"'{x}'" for x in normalize.SHORT_LINES)
_LINES = rf"""SELECT doc_id, i, regexp_replace(l, {_STRIP}) AS l FROM
  (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(t, '\r\n|[\n\r\v\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM src))"""
_GOOD = r"(upper(l) IN (" + _KEEP + r") OR length(l) >= 3 OR regexp_matches(l, '\d'))"


@query(
    f"""WITH src AS (SELECT doc_id, {_TEXT} AS t FROM documents), x AS ({_LINES})
SELECT doc_id, count(*) FILTER ({_GOOD}) AS n_lines, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER ({_GOOD}), '') AS result FROM x GROUP BY doc_id"""
)
def noise_lines(spark, sf_dir):
    kept = normalize.informative_lines(normalize.lines(F.col("text")))
    docs = _marked(spark, sf_dir).select("doc_id", kept.alias("kept"))
    return docs.select("doc_id", F.size("kept").cast("long").alias("n_lines"), normalize.join_lines(F.col("kept")).alias("result"))


_DEDUP = f"""y AS (SELECT doc_id, l, min(i) AS i FROM x WHERE {_GOOD} GROUP BY doc_id, l),
z AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS result FROM y GROUP BY doc_id)"""


@query(f"WITH src AS (SELECT doc_id, {_TEXT} AS t FROM documents), x AS ({_LINES}), {_DEDUP} SELECT documents.doc_id, coalesce(result, '') AS result FROM documents LEFT JOIN z USING (doc_id)")
def line_dedup(spark, sf_dir):
    return _texts(lambda t: normalize.join_lines(normalize.distinct_lines(normalize.informative_lines(normalize.lines(t)))))(spark, sf_dir)


_MARKED = f"(SELECT doc_id, {_TEXT} AS text FROM documents)"
_NORMAL = _joined(_collapsed(_LITERAL))
_NORMAL = rf"regexp_replace({_NORMAL}, '(\d{{2}}/\d{{2}}/\d{{4}})(\d{{2}}:\d{{2}}:\d{{2}})', '\1 \2', 'g')"
_NORMAL = rf"regexp_replace({_NORMAL}, '(\d){_WS}*,{_WS}*(\d{{2}})', '\1,\2', 'g')"
_NORMAL = _undotted(_NORMAL)


@query(f"WITH src AS (SELECT doc_id, {_NORMAL} AS t FROM {_MARKED}), x AS ({_LINES}), {_DEDUP} SELECT documents.doc_id, coalesce(result, '') AS result FROM documents LEFT JOIN z USING (doc_id)")
def normalize_text(spark, sf_dir):
    return _texts(normalize.normalize_text)(spark, sf_dir)


# --- Hashes and metadata, over documents -----------------------------------------------------


@query("SELECT doc_id, sha256(text) AS hash, strlen(text)::BIGINT AS size_bytes FROM documents")
def content_hash(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", audit.content_hash(t).alias("hash"), F.octet_length(t).cast("long").alias("size_bytes"))


@query(rf"SELECT doc_id, regexp_matches(text, '[\x{{a0}}\x{{200b}}-\x{{200d}}]') AS has_unicode_blanks, CASE WHEN doc_id % 5 = 1 THEN 'unknown' ELSE 'utf-8' END AS encoding FROM {_MARKED}")
def unicode_flags(spark, sf_dir):
    broken = F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 5 == 1, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))).cast("string")
    return _marked(spark, sf_dir).select("doc_id", audit.has_unicode_blanks(F.col("text")).alias("has_unicode_blanks"), audit.encoding(broken).alias("encoding"))


@query("SELECT doc_id, text AS result FROM documents")
def utf8_scrub(spark, sf_dir):
    """Bytes that are no UTF-8, put into every text, go again."""
    bad = F.unhex(F.get(F.array(F.lit("FF"), F.lit("C3"), F.lit("")), (F.col("doc_id") % 3).cast("int")))
    raw = F.concat(F.substring("text", 1, 7).cast("binary"), bad, F.expr("substring(text, 8)").cast("binary"), bad)
    return table(spark, sf_dir, "documents").select("doc_id", segment.scrub_utf8(raw).alias("result"))


@query("SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS name, unnest([false, true, true, true, false]) AS accepted")
def non_string_guard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")

    def accepted(name: str) -> bool:
        try:
            return normalize.require_text(docs, name) is not None
        except TypeError:
            return False

    return spark.createDataFrame([(c, accepted(c)) for c in ("doc_id", "text", "lang", "source", "n_chars")], "name string, accepted boolean")


@query(
    f"""WITH m AS {_MARKED}, src AS (SELECT doc_id, {_NORMAL} AS t FROM m), x AS ({_LINES}), {_DEDUP}
SELECT m.doc_id, length(coalesce(result, ''))::BIGINT AS after,
  CASE WHEN length(text) > 0 THEN round((1 - length(coalesce(result, '')) / length(text))::DOUBLE::VARCHAR::DECIMAL(30, 20), 2)::DOUBLE ELSE 0 END AS ratio
FROM m LEFT JOIN z USING (doc_id)"""
)
def reduction_ratio(spark, sf_dir):
    docs = _marked(spark, sf_dir).select("doc_id", "text", normalize.normalize_text(F.col("text")).alias("n"))
    return docs.select("doc_id", F.length("n").cast("long").alias("after"), audit.reduction_ratio(F.col("text"), F.col("n")).alias("ratio"))


# --- Validators ------------------------------------------------------------------------------


def _sql_mod11(text: str, weights) -> str:
    total = " + ".join(f"{w} * substr({text}, {i + 1}, 1)::INT" for i, w in enumerate(weights))
    return f"(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END)"


_W1, _W2 = V.CNPJ_WEIGHTS[1:], V.CNPJ_WEIGHTS


def _sql_cnpj14(base: str) -> str:
    one = _sql_mod11(base, _W1)
    return f"({base} || {one} || {_sql_mod11(f'({base} || {one})', _W2)})"


def _sql_cnpj(number: str) -> str:
    c = _sql_cnpj14(f"(lpad({number}::VARCHAR, 8, '0') || '0001')")
    return f"(substr({c}, 1, 2) || '.' || substr({c}, 3, 3) || '.' || substr({c}, 6, 3) || '/' || substr({c}, 9, 4) || '-' || substr({c}, 13, 2))"


def _cnpj_inputs(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    raw = bind(render.cnpj_of(key), lambda good: _spoilt(key, good))
    return table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))


def _spoilt(key: Column, good: Column) -> Column:
    return (
        F.when(key % 5 == 1, F.concat(F.substring(good, 1, 16), F.lit(((key % 10)).cast("string")), F.substring(good, 18, 1)))
        .when(key % 5 == 2, F.concat(F.substring(good, 1, 17), (key % 10).cast("string")))
        .when(key % 5 == 3, F.substring(good, 1, 17))
        .when(key % 5 == 4, F.repeat((key % 10).cast("string"), 14))
        .otherwise(good)
    )


_CNPJ_SRC = f"""WITH g AS (SELECT c_custkey, {_sql_cnpj("c_custkey")} AS good FROM customer),
r AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN substr(good, 1, 16) || (c_custkey % 10)::VARCHAR || substr(good, 18, 1) WHEN 2 THEN substr(good, 1, 17) || (c_custkey % 10)::VARCHAR
       WHEN 3 THEN substr(good, 1, 17) WHEN 4 THEN repeat((c_custkey % 10)::VARCHAR, 14) ELSE good END AS raw FROM g),
s AS (SELECT c_custkey, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS c FROM r),
p AS (SELECT *, CASE WHEN length(c) = 14 THEN {_sql_mod11("c", _W1)} END AS d1, CASE WHEN length(c) = 14 THEN {_sql_mod11("c", _W2)} END AS d2 FROM s),
v AS (SELECT *, length(c) = 14 AND c <> repeat(substr(c, 1, 1), 14) AND try_cast(substr(c, 13, 1) AS INT) = d1 AND try_cast(substr(c, 14, 1) AS INT) = d2 AS ok FROM p)"""


@query(
    _CNPJ_SRC + """ SELECT c_custkey, ok AS valido,
  CASE WHEN ok THEN 95 WHEN length(c) <> 14 OR c = repeat(substr(c, 1, 1), 14) THEN 100 ELSE 99 END AS confianca,
  CASE WHEN ok THEN NULL WHEN length(c) <> 14 THEN 'CNPJ deve ter 14 dígitos (recebido ' || length(c) || ')' WHEN c = repeat(substr(c, 1, 1), 14) THEN 'CNPJ com todos dígitos repetidos'
       WHEN try_cast(substr(c, 13, 1) AS INT) <> d1 THEN 'Dígito verificador 1 incorreto (esperado ' || d1 || ')' ELSE 'Dígito verificador 2 incorreto (esperado ' || d2 || ')' END AS erro
FROM v"""
)
def cnpj_checksum(spark, sf_dir):
    x = _cnpj_inputs(spark, sf_dir).select("c_custkey", V.cnpj(F.col("raw")).alias("v"))
    return x.select("c_custkey", "v.valido", "v.confianca", "v.erro")


@query(
    f"""SELECT s_suppkey, {_sql_cnpj14("(lpad(s_suppkey::VARCHAR, 8, '0') || (CASE WHEN s_suppkey % 2 = 0 THEN '0001' ELSE '0002' END))")} AS cnpj_limpo,
  CASE WHEN s_suppkey % 2 = 0 THEN 'matriz' ELSE 'filial' END AS tipo, regexp_replace(cnpj_limpo, '(..)(...)(...)(....)(..)', '\\1.\\2.\\3/\\4-\\5') AS escrito FROM supplier"""
)
def cnpj_format(spark, sf_dir):
    key = F.col("s_suppkey")
    base = F.concat(F.lpad(key.cast("string"), 8, "0"), F.when(key % 2 == 0, "0001").otherwise("0002"))
    full = bind(base, lambda b: V.cnpj_format(F.concat(b, V.cnpj_digits(b))))
    v = table(spark, sf_dir, "supplier").select("s_suppkey", V.cnpj(full).alias("v"))
    return v.select("s_suppkey", "v.cnpj_limpo", "v.tipo", F.col("v.cnpj_formatado").alias("escrito"))


def _key_inputs(spark, sf_dir) -> DataFrame:
    o = F.col("o_orderkey")
    raw = bind(render.key_of(o, F.col("o_custkey"), F.col("o_orderdate")), lambda good: _spoilt_key(o, good))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))


def _spoilt_key(o: Column, good: Column) -> Column:
    put = lambda at, n, new: F.concat(F.substring(good, 1, at - 1), F.lit(new), F.substring(good, at + n, 44))
    raw = F.when(o % 8 == 1, put(1, 2, "34")).when(o % 8 == 2, put(3, 2, "95")).when(o % 8 == 3, put(5, 2, "13")).when(o % 8 == 4, put(21, 2, "57"))
    raw = raw.when(o % 8 == 5, put(18, 1, "9")).when(o % 8 == 6, F.substring(good, 1, 43))
    return raw.when(o % 8 == 7, F.concat(F.substring(good, 1, 43), (o % 10).cast("string"))).otherwise(good)


_DV_WEIGHTS = [2 + (42 - i) % 8 for i in range(43)]
_HEAD = f"""('35' || lpad(((year(o_orderdate) + 20) % 100)::VARCHAR, 2, '0') || lpad(month(o_orderdate)::VARCHAR, 2, '0') || cnpj || '55001' || lpad(o_orderkey::VARCHAR, 9, '0') || '1' || lpad(o_orderkey::VARCHAR, 8, '0'))"""


@query(
    f"""WITH b AS (SELECT *, (lpad(o_custkey::VARCHAR, 8, '0') || '0001') AS base FROM orders),
b1 AS (SELECT *, base || {_sql_mod11("base", _W1)} AS c13 FROM b), b2 AS (SELECT *, c13 || {_sql_mod11("c13", _W2)} AS cnpj FROM b1),
h AS (SELECT o_orderkey, {_HEAD} AS head FROM b2), g AS (SELECT o_orderkey, head || {_sql_mod11("head", _DV_WEIGHTS)} AS good FROM h),
r AS (SELECT o_orderkey, good, CASE o_orderkey % 8 WHEN 1 THEN '34' || substr(good, 3) WHEN 2 THEN substr(good, 1, 2) || '95' || substr(good, 5) WHEN 3 THEN substr(good, 1, 4) || '13' || substr(good, 7)
   WHEN 4 THEN substr(good, 1, 20) || '57' || substr(good, 23) WHEN 5 THEN substr(good, 1, 17) || '9' || substr(good, 19) WHEN 6 THEN substr(good, 1, 43) WHEN 7 THEN substr(good, 1, 43) || (o_orderkey % 10)::VARCHAR ELSE good END AS k FROM g)
SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (1, 2, 3, 4, 6) THEN false WHEN o_orderkey % 8 = 5 THEN k = good ELSE k = good END AS valido,
  CASE o_orderkey % 8 WHEN 1 THEN 100 WHEN 2 THEN 95 WHEN 3 THEN 100 WHEN 4 THEN 95 WHEN 6 THEN 100 ELSE CASE WHEN k = good THEN 90 ELSE 99 END END AS confianca,
  CASE WHEN k = good THEN '20' || substr(k, 3, 2) || '-' || substr(k, 5, 2) END AS ano_mes,
  CASE WHEN k = good THEN array_to_string(list_transform(range(0, 11), lambda i: substr(k, i * 4 + 1, 4)), ' ') END AS chave_formatada,
  CASE WHEN k = good THEN NULL ELSE CASE o_orderkey % 8 WHEN 1 THEN 'Código UF inválido: 34' WHEN 2 THEN 'Ano implausível: 2095' WHEN 3 THEN 'Mês inválido: 13'
    WHEN 4 THEN 'Modelo inválido: 57 (esperado 55=NF-e ou 65=NFC-e)' WHEN 6 THEN 'Chave deve ter 44 dígitos (recebido 43)'
    WHEN 5 THEN 'CNPJ inválido na chave: Dígito verificador ' || CASE WHEN d1 <> substr(k, 19, 1)::INT THEN '1 incorreto (esperado ' || d1 ELSE '2 incorreto (esperado ' || d2 END || ')'
    ELSE 'Dígito verificador incorreto (esperado ' || substr(good, 44) || ', recebido ' || substr(k, 44) || ')' END END AS erro
FROM (SELECT *, CASE WHEN o_orderkey % 8 = 5 THEN """
    + _sql_mod11("substr(k, 7, 14)", _W1) + " END AS d1, CASE WHEN o_orderkey % 8 = 5 THEN " + _sql_mod11("substr(k, 7, 14)", _W2) + " END AS d2 FROM r)"
)
def nfe_key(spark, sf_dir):
    x = _key_inputs(spark, sf_dir).select("o_orderkey", V.nfe_key(F.col("raw")).alias("v"))
    return x.select("o_orderkey", "v.valido", "v.confianca", "v.ano_mes", "v.chave_formatada", "v.erro")


#: Forms of an amount by order number: in six currencies, then malformed ones.
def _money_inputs(spark, sf_dir) -> DataFrame:
    o, d = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    us = F.format_number(d, 2)
    br = F.translate(us, ",.", ".,")
    forms = [F.concat(F.lit("R$ "), br), F.concat(F.lit("$ "), us), F.concat(F.lit("€ "), br), F.concat(F.lit("£"), us), F.concat(F.lit("¥ "), us), F.concat(us, F.lit(" CNY"))]
    forms += [F.concat(F.lit("-"), br), F.concat(br, F.lit("9")), F.concat(F.lit("abc"), br), F.concat(F.lit("9.999.99"), br), F.lit("US$ 100"), br]
    raw = F.get(F.array(*forms), (o % len(forms)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), raw.alias("raw"))


_KINDS = "CASE o_orderkey % 12 WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'GBP' WHEN 4 THEN 'JPY' WHEN 5 THEN 'CNY' WHEN 10 THEN 'USD' ELSE 'BRL' END"


@query(f"SELECT o_orderkey, {_KINDS} AS moeda FROM orders")
def currency_detect(spark, sf_dir):
    return _money_inputs(spark, sf_dir).select("o_orderkey", V.currency(F.col("raw")).alias("moeda"))


@query(
    f"""WITH x AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS d, {_KINDS} AS moeda, o_orderkey % 12 AS k FROM orders)
SELECT o_orderkey, moeda, k IN (0, 1, 2, 3, 4, 5, 11) AS valido, (moeda = 'BRL' AND k IN (0, 11)) AS valido_fiscal,
  CASE WHEN k IN (0, 1, 2, 3, 4, 5, 11) THEN 95 WHEN k = 9 THEN 90 WHEN k = 7 THEN 80 ELSE 100 END AS confianca,
  CASE WHEN k IN (0, 1, 2, 3, 4, 5, 11) THEN d::DOUBLE END AS valor FROM x"""
)
def money_validate(spark, sf_dir):
    x = _money_inputs(spark, sf_dir).select("o_orderkey", V.money(F.col("raw")).alias("v"), V.fiscal_money(F.col("raw")).alias("f"))
    return x.select("o_orderkey", "v.moeda", "v.valido", F.col("f.valido").alias("valido_fiscal"), "v.confianca", F.col("v.valor_decimal").cast("double").alias("valor"))


@query(
    f"""WITH x AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS d, {_KINDS} AS moeda, o_orderkey % 12 AS k FROM orders),
f AS (SELECT *, format('{{:,.2f}}', d) AS us FROM x)
SELECT o_orderkey, CASE WHEN k IN (0, 11) THEN 'R$ ' || translate(us, ',.', '.,') WHEN k = 1 THEN '$ ' || us WHEN k = 2 THEN '€ ' || translate(us, ',.', '.,')
  WHEN k = 3 THEN '£ ' || us WHEN k IN (4, 5) THEN '¥ ' || format('{{:,}}', round_even(d, 0)::BIGINT) END AS escrito FROM f"""
)
def money_format(spark, sf_dir):
    return _money_inputs(spark, sf_dir).select("o_orderkey", V.money(F.col("raw"))["valor_formatado"].alias("escrito"))


# --- PARSE, over rendered invoices -----------------------------------------------------------


def _parsed(spark, sf_dir) -> DataFrame:
    return pipeline.parse_texts(render.invoices(spark, sf_dir))


_BRL = "('R$ ' || translate(format('{:,.2f}', o_totalprice::DECIMAL(18,2)), ',.', '.,'))"
_SUPP = "(SELECT l_orderkey, min(l_suppkey) AS suppkey, count(DISTINCT (l_linenumber, l_extendedprice)) AS n_items FROM lineitem GROUP BY l_orderkey)"
_BASE = f"FROM orders JOIN {_SUPP} l ON l_orderkey = o_orderkey"


def _plain(cnpj: str) -> str:
    """A written CNPJ after normalisation, which takes the dots between digits."""
    return f"replace({cnpj}, '.', '')"


@query(
    f"""SELECT o_orderkey, (o_orderkey % 3 = 1)::INT + 3 AS header_lines,
  'PRESTADOR DE SERVIÇO' || chr(10) || 'Fornecedor ' || suppkey || ' LTDA.' || chr(10) || 'CNPJ: ' || CASE WHEN o_orderkey % 11 = 5 THEN translate({_plain(_sql_cnpj("suppkey"))}, '0123456789', '1234567890') ELSE {_plain(_sql_cnpj("suppkey"))} END AS issuer,
  CASE WHEN o_orderkey % 7 = 3 THEN '' ELSE 'TOMADOR DE SERVIÇO' || chr(10) || 'Cliente ' || o_custkey || ' S.A.' || chr(10) || 'CNPJ: ' || {_plain(_sql_cnpj("(o_custkey + 50000000)"))} END AS recipient,
  n_items + 1 AS items_lines, CASE WHEN o_orderkey % 13 <> 7 THEN 'TOTAL GERAL: ' || replace({_BRL}, '.', '') ELSE '' END AS financials {_BASE}"""
)
def segment_blocks(spark, sf_dir):
    """Sections keep what they hold: the issuer's number is moved on, be the result valid or not."""
    x = render.invoices(spark, sf_dir, lambda number: render.moved_on(render.cnpj_of(number))).select("o_orderkey", segment.blocks(normalize.normalize_text(F.col("text"))).alias("b"))
    n = lambda c: F.size(F.filter(F.split(F.col(f"b.{c}"), "\n"), lambda t: t != ""))
    return x.select(
        "o_orderkey", n("header").alias("header_lines"), F.trim("b.issuer", F.lit("\n")).alias("issuer"), F.trim("b.recipient", F.lit("\n")).alias("recipient"),
        n("items").cast("long").alias("items_lines"), F.trim("b.financials", F.lit("\n")).alias("financials"),
    )


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 7 THEN {_BRL} END AS total {_BASE}")
def total(spark, sf_dir):
    return _totals(spark, sf_dir)


def _totals(spark, sf_dir) -> DataFrame:
    """Only what a total needs: the normalised text, its sections, the financial one's amount."""
    found = bind(segment.blocks(normalize.normalize_text(F.col("text"))), lambda b: extract.total(b["financials"]))
    return render.invoices(spark, sf_dir).select("o_orderkey", found.alias("total"))


@query(
    f"""SELECT o_orderkey, 'FORNECEDOR ' || suppkey || ' LTDA' AS issuer_name, CASE WHEN o_orderkey % 11 <> 5 THEN {_sql_cnpj("suppkey")} END AS issuer_cnpj,
  CASE WHEN o_orderkey % 7 <> 3 THEN 'CLIENTE ' || o_custkey || ' S.A' END AS recipient_name, CASE WHEN o_orderkey % 7 <> 3 THEN {_sql_cnpj("(o_custkey + 50000000)")} END AS recipient_cnpj {_BASE}"""
)
def parties(spark, sf_dir):
    i = F.col("invoice")
    return _parsed(spark, sf_dir).select(
        "o_orderkey", i["issuer"]["name"].alias("issuer_name"), i["issuer"]["cnpj_cpf"].alias("issuer_cnpj"),
        i["recipient"]["name"].alias("recipient_name"), i["recipient"]["cnpj_cpf"].alias("recipient_cnpj"),
    )


@query(f"SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') || ' 10:30:00' AS emission_date, strftime(o_orderdate, '%m/%Y') AS competence_date {_BASE}")
def dates(spark, sf_dir):
    return _parsed(spark, sf_dir).select("o_orderkey", "invoice.emission_date", "invoice.competence_date")


@query(
    f"""WITH x AS (SELECT o_orderkey, o_orderdate, (lpad(suppkey::VARCHAR, 8, '0') || '0001') AS base {_BASE}),
b1 AS (SELECT *, base || {_sql_mod11("base", _W1)} AS c13 FROM x), b2 AS (SELECT *, c13 || {_sql_mod11("c13", _W2)} AS cnpj FROM b1),
h AS (SELECT o_orderkey, {_HEAD} AS head FROM b2), g AS (SELECT o_orderkey, head || {_sql_mod11("head", _DV_WEIGHTS)} AS k FROM h)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN array_to_string(list_transform(range(0, 11), lambda i: substr(k, i * 4 + 1, 4)), ' ') END AS chave FROM g"""
)
def access_key(spark, sf_dir):
    return _parsed(spark, sf_dir).select("o_orderkey", F.col("invoice.chave_acesso").alias("chave"))


@query(
    """WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(18,2) AS d FROM lineitem),
y AS (SELECT *, floor(d)::BIGINT AS whole, ((d - floor(d)) * 100)::INT AS cents FROM x)
SELECT l_orderkey AS o_orderkey, l_linenumber AS position, 'Pacote de suporte nivel ' || chr(64 + l_linenumber) || CASE WHEN whole >= 1000 THEN ' ' || (whole // 1000) ELSE '' END AS description,
  CASE WHEN whole >= 1000 THEN lpad((whole % 1000)::VARCHAR, 3, '0') ELSE whole::VARCHAR END || ',' || lpad(cents::VARCHAR, 2, '0') AS unit_value FROM y"""
)
def items(spark, sf_dir):
    x = _parsed(spark, sf_dir).select("o_orderkey", F.explode("invoice.items").alias("x"))
    level = F.ascii(F.regexp_extract("x.raw", "nivel ([A-Z])", 1)) - 64
    return x.select("o_orderkey", level.alias("position"), "x.description", "x.unit_value")


@query(
    """WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(18,2) AS d FROM lineitem)
SELECT l_orderkey AS o_orderkey, l_linenumber AS position, 'Pacote de suporte nivel ' || chr(64 + l_linenumber) AS description, replace(d::VARCHAR, '.', ',') AS unit_value FROM x"""
)
def items_strict(spark, sf_dir):
    """Amounts over 999 read whole."""
    x = pipeline.parse_texts(render.invoices(spark, sf_dir), strict=True).select("o_orderkey", F.explode("invoice.items").alias("x"))
    level = F.ascii(F.regexp_extract("x.raw", "nivel ([A-Z])", 1)) - 64
    return x.select("o_orderkey", level.alias("position"), "x.description", "x.unit_value")


# --- VALIDATE --------------------------------------------------------------------------------


def _payloads(spark, sf_dir) -> DataFrame:
    """Payload fields by order number, so that every rule fires somewhere."""
    o = F.col("o_orderkey")
    issuer = F.when(o % 5 == 1, F.lit("11.111.111/1111-11")).when(o % 5 != 2, render.cnpj_of(o))
    money = F.when(o % 7 == 1, F.lit("R$ 1,234")).when(o % 7 != 2, F.concat(F.lit("R$ "), render.brl(F.col("o_totalprice"))))
    key = F.when(o % 4 == 1, F.repeat(F.lit("1"), 44)).when(o % 4 == 2, render.key_of(o, F.col("o_custkey"), F.col("o_orderdate")))
    return table(spark, sf_dir, "orders").select("o_orderkey", issuer.alias("issuer"), F.when(o % 3 != 1, render.cnpj_of(F.col("o_custkey"))).alias("recipient"), money.alias("total"), key.alias("key"))


_CASES = """x AS (SELECT o_orderkey, o_orderkey % 5 = 2 AS a, o_orderkey % 5 = 1 AS b, o_orderkey % 3 = 1 AS c, o_orderkey % 7 = 2 AS d, o_orderkey % 7 = 1 AS e, o_orderkey % 4 = 1 AS f FROM orders),
s AS (SELECT *, greatest(0, 100 - 100 * a::INT - 100 * b::INT - 10 * c::INT - 50 * d::INT - 30 * e::INT - 20 * f::INT) AS p FROM x)"""


def _issues() -> Column:
    return trust.issues(F.col("issuer"), F.col("recipient"), F.col("total"), F.col("key"))


@query(
    f"""WITH {_CASES}, u AS (SELECT o_orderkey, unnest([(a, 1, 'MISSING_ISSUER', 'error'), (b, 2, 'INVALID_ISSUER_CNPJ', 'error'), (c, 3, 'MISSING_RECIPIENT', 'warning'),
  (d, 4, 'MISSING_TOTAL', 'error'), (e, 5, 'INVALID_TOTAL_FORMAT', 'warning'), (f, 6, 'INVALID_KEY', 'warning')]) AS i FROM s)
SELECT o_orderkey, i[2] - 1 AS position, i[3] AS code, i[4] AS severity, ['issuer.cnpj_cpf', 'issuer.cnpj_cpf', 'recipient', 'financials.total', 'financials.total', 'chave_acesso'][i[2]] AS field,
  ['CNPJ do emitente não encontrado', 'CNPJ inválido: CNPJ com todos dígitos repetidos', 'Tomador não identificado', 'Valor total não encontrado', 'Formato inválido: Mais de 2 casas decimais',
   'Chave inválida: Modelo inválido: 11 (esperado 55=NF-e ou 65=NFC-e)'][i[2]] AS message FROM u WHERE i[1]"""
)
def issues(spark, sf_dir):
    codes = F.array(*[F.lit(code) for code, *_ in trust.RULES])
    x = _payloads(spark, sf_dir).select("o_orderkey", F.explode(_issues()).alias("i"))
    return x.select("o_orderkey", (F.array_position(codes, F.col("i.code")) - 1).cast("int").alias("position"), "i.code", "i.severity", "i.field", "i.message")


@query(f"WITH {_CASES} SELECT o_orderkey, p::BIGINT AS points FROM s")
def trust_score(spark, sf_dir):
    return _payloads(spark, sf_dir).select("o_orderkey", F.round(trust.score(_issues()) * 100).cast("long").alias("points"))


@query(f"WITH {_CASES} SELECT o_orderkey, CASE WHEN a OR b OR d THEN 'error' WHEN p < 100 THEN 'partial' ELSE 'success' END AS status FROM s")
def status(spark, sf_dir):
    x = _payloads(spark, sf_dir).select("o_orderkey", _issues().alias("i"))
    return x.select("o_orderkey", trust.status(F.col("i"), trust.score(F.col("i"))).alias("status"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (1, 2) OR o_orderkey % 7 IN (1, 2) THEN 'rejeitado' ELSE 'aprovado' END AS veredito FROM orders")
def audit_verdict(spark, sf_dir):
    ok = [F.coalesce(V.cnpj(F.col("issuer"))["valido"], F.lit(False)), F.coalesce(V.fiscal_money(F.col("total"))["valido"], F.lit(False))]
    return _payloads(spark, sf_dir).select("o_orderkey", trust.approved(*ok).alias("veredito"))


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 5 OR o_orderkey % 13 = 7 THEN 'error' WHEN o_orderkey % 7 = 3 THEN 'partial' ELSE 'success' END AS status,
  greatest(0, 100 - CASE WHEN o_orderkey % 11 = 5 THEN 100 ELSE 0 END - CASE WHEN o_orderkey % 7 = 3 THEN 10 ELSE 0 END - CASE WHEN o_orderkey % 13 = 7 THEN 50 ELSE 0 END)::BIGINT AS points {_BASE}"""
)
def pipeline_status(spark, sf_dir):
    return pipeline.process_texts(render.invoices(spark, sf_dir)).select("o_orderkey", "status", F.round(F.col("trust_score") * 100).cast("long").alias("points"))


# --- Routing ---------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'revisao_manual' WHEN o_totalprice > 10000 THEN 'auditoria_fiscal' ELSE 'processamento_normal' END AS rota FROM orders")
def route_by_value(spark, sf_dir):
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", trust.route_by_value(F.when(o % 6 != 0, F.col("o_totalprice"))).alias("rota"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 5 THEN 'revisao_manual' ELSE 'processamento_automatico' END AS rota {_BASE}")
def route_by_confidence(spark, sf_dir):
    return _parsed(spark, sf_dir).select("o_orderkey", trust.route_by_confidence(F.col("invoice")).alias("rota"))


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 7 THEN {_BRL} END AS total,
  CASE WHEN o_orderkey % 13 = 7 THEN 'revisao_manual' WHEN o_totalprice::DECIMAL(18,2) > 10000 THEN 'auditoria_fiscal' ELSE 'processamento_normal' END AS rota {_BASE}"""
)
def invoice_total_route(spark, sf_dir):
    """The flagship: invoice texts to their total and route."""
    return _totals(spark, sf_dir).select("o_orderkey", "total", trust.route_by_value(V.money(F.col("total"))["valor_decimal"]).alias("rota"))


# --- Payloads, envelope, audit ---------------------------------------------------------------


_KEYS = "emission_date,competence_date,chave_acesso,issuer,recipient,items,financials,raw_text,tenant_id,source_filename"


@query(
    f"""SELECT o_orderkey, '{_KEYS}' AS keys, 'name,cnpj_cpf,address,municipal_insc,email,phone' AS party_keys, 'description,quantity,unit,unit_value,cfop,raw' AS item_keys, true AS same,
  'FORNECEDOR ' || suppkey || ' LTDA' AS issuer, CASE WHEN o_orderkey % 13 <> 7 THEN {_BRL} END AS total, strftime(o_orderdate, '%m/%Y') AS month, n_items AS items {_BASE}"""
)
def payload_json(spark, sf_dir):
    x = _parsed(spark, sf_dir).select("o_orderkey", "invoice", payloads.to_json(F.col("invoice")).alias("j"))
    g, back = lambda p: F.get_json_object("j", p), payloads.from_json(F.col("j"))
    keys = lambda p: F.array_join(F.json_object_keys(g(p)), ",")
    return x.select(
        "o_orderkey", keys("$").alias("keys"), keys("$.issuer").alias("party_keys"), keys("$.items[0]").alias("item_keys"), (payloads.to_json(back) == F.col("j")).alias("same"),
        g("$.issuer.name").alias("issuer"), g("$.financials.total").alias("total"), g("$.competence_date").alias("month"), F.size(back["items"]).cast("long").alias("items"),
    )


@query(
    f"""SELECT o_orderkey, 'NFS-e' AS document_type, CASE WHEN o_orderkey % 11 <> 5 THEN {_sql_cnpj("suppkey")} END AS supplier, CASE WHEN o_orderkey % 7 <> 3 THEN 'CLIENTE ' || o_custkey || ' S.A' END AS customer,
  n_items AS line_items, CASE WHEN o_orderkey % 13 <> 7 THEN {_BRL} END AS total_amount {_BASE}"""
)
def erp_payload(spark, sf_dir):
    x = _parsed(spark, sf_dir).select("o_orderkey", payloads.erp(F.col("invoice")).alias("e"))
    return x.select("o_orderkey", "e.document_type", F.col("e.supplier.tax_id").alias("supplier"), F.col("e.customer.name").alias("customer"), F.size("e.line_items").cast("long").alias("line_items"), "e.total_amount")


@query(
    f"""SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') || ' 10:30:00' AS event_time, 'invoice_processed' AS event_type, CASE WHEN o_orderkey % 11 <> 5 THEN {_sql_cnpj("suppkey")} END AS issuer_cnpj,
  CASE WHEN o_orderkey % 13 <> 7 THEN {_BRL} END AS total_value, n_items::INT AS items_count, o_orderkey % 3 = 1 AS has_key {_BASE}"""
)
def analytics_row(spark, sf_dir):
    return _parsed(spark, sf_dir).select("o_orderkey", payloads.analytics(F.col("invoice")).alias("a")).select("o_orderkey", "a.*")


def _outcomes(spark, sf_dir) -> DataFrame:
    """Events as pipeline outcomes: a seventh fails, each at some stage."""
    e = F.col("event_id")
    stage = F.get(F.array(*map(F.lit, audit.STAGES)), (e % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at"), F.when(e % 7 == 3, stage).alias("failed"), F.concat(F.lit("erro "), e).alias("error"))


@query(
    """WITH s AS (SELECT unnest(['READ', 'NORMALIZE', 'PARSE', 'VALIDATE']) AS stage, unnest([0, 1, 2, 3]) AS i)
SELECT event_id, i AS event_index, stage, CASE WHEN event_id % 7 = 3 AND i = event_id % 4 THEN 'FAILURE' ELSE 'SUCCESS' END AS status,
  CASE WHEN event_id % 7 = 3 AND i = event_id % 4 THEN 'ABORT' ELSE 'CONTINUE' END AS error_policy,
  CASE WHEN event_id % 7 = 3 AND i = event_id % 4 THEN 'erro ' || event_id END AS error
FROM events, s WHERE event_id % 7 <> 3 OR i <= event_id % 4"""
)
def audit_trail(spark, sf_dir):
    details = {s: audit.stage_details(duration_sec=F.lit(0)) for s in audit.STAGES}
    x = _outcomes(spark, sf_dir).select("event_id", audit.events(F.col("failed"), F.col("error"), details, F.col("at")).alias("events"))
    x = x.select("event_id", F.posexplode_outer("events").alias("event_index", "e"))
    return x.select("event_id", "event_index", "e.stage", "e.status", "e.error_policy", F.get_json_object("e.details", "$.error").alias("error"))


@query(
    """SELECT event_id, CASE WHEN event_id % 7 = 3 THEN (event_id % 4) + 1 ELSE 4 END AS n_events, event_id % 7 = 3 AS failed, 'exec_' || event_id AS id, 'fiscal.extraction.completed' AS event_type,
  'unknown_tenant' AS tenant_id, '{}' AS payload, 1500 AS ms FROM events"""
)
def event_envelope(spark, sf_dir):
    details = {s: audit.stage_details(duration_sec=F.lit(0)) for s in audit.STAGES}
    x = _outcomes(spark, sf_dir).withColumn("events", audit.events(F.col("failed"), F.col("error"), details, F.col("at")))
    j = audit.envelope(
        {
            "execution_id": F.concat(F.lit("exec_"), F.col("event_id")), "tenant_id": audit.context("tenant_id", F.lit(None).cast("string")),
            "status": F.when(F.col("failed").isNotNull(), "error").otherwise("success"), "start_time": F.col("at"), "end_time": F.col("at") + F.expr("INTERVAL 1500 MILLISECONDS"),
            "payload": F.lit(None).cast("struct<x:string>"), "events": F.col("events"),
        }
    )
    x = x.select("event_id", j.alias("j"))
    g = lambda p: F.get_json_object("j", p)
    trail = F.from_json(g("$.data.audit_trail"), "array<struct<stage:string,status:string>>")
    return x.select(
        "event_id", F.size(trail).cast("long").alias("n_events"), (g("$.status") == "error").alias("failed"), g("$.event_id").alias("id"), g("$.event_type").alias("event_type"),
        g("$.tenant_id").alias("tenant_id"), g("$.data.payload").alias("payload"), g("$.data.metrics.total_duration_ms").cast("double").cast("int").alias("ms"),
    )


# --- Admission and context -------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 5 = 1 THEN 415 WHEN event_id % 5 = 2 THEN 413 WHEN event_id % 5 = 3 THEN 422 ELSE 202 END AS http_status FROM events")
def admission(spark, sf_dir):
    e = F.col("event_id")
    kind = F.when(e % 5 == 1, "text/plain").otherwise("application/pdf")
    size = F.when(e % 5 == 2, documents.MAX_UPLOAD + 1).otherwise(documents.MAX_UPLOAD)
    content = F.when(e % 5 == 3, F.lit("no pdf")).otherwise(F.concat(F.lit("%PDF-1.7 "), e.cast("string"))).cast("binary")
    return table(spark, sf_dir, "events").select("event_id", documents.admission(kind, size, content).alias("http_status"))


@query(
    """SELECT event_id, event_id % 6 IN (0, 1) AS valid, CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 6 = 2 THEN '---' WHEN event_id % 6 = 3 THEN 'a b' ELSE 'tenant-' || user_id END AS tenant_id,
  CASE WHEN event_id % 6 = 4 THEN 'urgent' WHEN event_id % 6 = 1 THEN 'high' ELSE 'normal' END AS priority FROM events"""
)
def context_parse(spark, sf_dir):
    e = F.col("event_id")
    tenant = F.when(e % 6 == 2, "---").when(e % 6 == 3, "a b").when(e % 6 != 5, F.concat(F.lit("tenant-"), F.col("user_id")))
    j = F.to_json(F.struct(tenant.alias("tenant_id"), F.when(e % 6 == 4, "urgent").when(e % 6 == 1, "high").alias("priority")))
    x = table(spark, sf_dir, "events").select("event_id", documents.parse_context(j).alias("c"))
    return x.select("event_id", "c.valid", "c.tenant_id", "c.priority")


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'given-' || event_id ELSE 'made' END AS trace_id, CASE event_id % 4 WHEN 2 THEN 'run-' || event_id ELSE 'made for t' || user_id END AS execution_id,
  event_id % 5 <> 3 AS valid FROM events"""
)
def context_ids(spark, sf_dir):
    """Ids that are given stay; null and empty ones are made; a choice that is null in so many words is refused."""
    e = F.col("event_id")
    trace = F.when(e % 4 == 1, F.concat(F.lit("given-"), e)).when(e % 4 == 3, "")
    execution = F.when(e % 4 == 2, F.concat(F.lit("run-"), e)).when(e % 4 == 3, "")
    j = F.to_json(F.struct(F.concat(F.lit("t"), F.col("user_id")).alias("tenant_id"), trace.alias("trace_id"), execution.alias("execution_id")))
    j = F.when(e % 5 == 3, F.concat(F.rtrim(j, F.lit("}")), F.lit(', "dry_run": null}'))).otherwise(j)
    x = table(spark, sf_dir, "events").select("event_id", "user_id", documents.parse_context(j).alias("c")).select("event_id", "user_id", "c.valid", documents.with_ids(F.col("c")).alias("c"))
    tenant = F.regexp_extract("c.execution_id", "^(t[0-9]+)_[0-9a-f]{12}$", 1)
    return x.select(
        "event_id", F.when(F.col("c.trace_id").rlike("^[0-9a-f-]{36}$"), "made").otherwise(F.col("c.trace_id")).alias("trace_id"),
        F.when(tenant != "", F.concat(F.lit("made for "), tenant)).otherwise(F.col("c.execution_id")).alias("execution_id"), "valid",
    )


# --- Sources, sinks and the whole process, over PDF documents -----------------------------------


def _sql_pdf(lines: str) -> str:
    """A PDF of one page that shows the lines (a list of ASCII texts)."""
    body = f"('BT /F1 9 Tf 50 700 Td (' || array_to_string({lines}, ') Tj T* (') || ') Tj ET')"
    head = "'%PDF-1.4' || chr(10) || '1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj' || chr(10) || '2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj' || chr(10) || '3 0 obj << /Type /Page /Contents 4 0 R >> endobj' || chr(10) || '4 0 obj << /Length '"
    return f"({head} || length({body}) || ' >> stream' || chr(10) || {body} || chr(10) || 'endstream endobj')"


def _pdf(lines: Column) -> Column:
    body = F.concat(F.lit("BT /F1 9 Tf 50 700 Td ("), F.array_join(lines, ") Tj T* ("), F.lit(") Tj ET"))
    objects = ("<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Contents 4 0 R >>")
    head = "%PDF-1.4\n" + "".join(f"{i} 0 obj {o} endobj\n" for i, o in enumerate(objects, 1)) + "4 0 obj << /Length "
    return F.concat(F.lit(head), F.length(body), F.lit(" >> stream\n"), body, F.lit("\nendstream endobj"))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the warehouse's tables."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/faturaflow/{name}-{uuid.uuid4().hex}"


_NATION_LINES = "['EMITENTE', 'Nacao ' || n_nationkey, 'de ' || n_name, 'Competencia: 01/20' || (10 + n_regionkey)]"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, pdf): a document a nation."""
    lines = F.array(F.lit("EMITENTE"), F.concat(F.lit("Nacao "), "n_nationkey"), F.concat(F.lit("de "), "n_name"), F.concat(F.lit("Competencia: 01/20"), 10 + F.col("n_regionkey")))
    return table(spark, sf_dir, "nation").select("n_nationkey", _pdf(lines).alias("pdf"))


def _nation_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file a nation."""
    at = _folder(spark, "nations")
    _nations(spark, sf_dir).write.partitionBy("n_nationkey").option("lineSep", "\n").text(at)
    return at


@query(f"SELECT n_nationkey, array_to_string({_NATION_LINES}, chr(10)) AS text, 1 AS page_count, 'embedded' AS method, NULL::VARCHAR AS read_error FROM nation")
def pdf_scan(spark, sf_dir):
    files = documents.pdf_files(spark, _nation_files(spark, sf_dir), "*.txt")
    read = pipeline.extract_text(documents.dispatch(files, None))
    return read.select(F.regexp_extract("source", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), "text", "page_count", F.col("extration_method").alias("method"), "read_error")


_SUPPLIER_LINES = "['PRESTADOR DE SERVICO', 'Fornecedor ' || s_suppkey, 'Cidade numero ' || s_nationkey]"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, content): PDF bytes a supplier, damaged for every fifth."""
    key = F.col("s_suppkey")
    lines = F.array(F.lit("PRESTADOR DE SERVICO"), F.concat(F.lit("Fornecedor "), key), F.concat(F.lit("Cidade numero "), "s_nationkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(key % 5 == 2, F.concat(F.lit("no pdf "), key)).otherwise(_pdf(lines)).cast("binary").alias("content"))


@query(f"SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 2 THEN array_to_string({_SUPPLIER_LINES}, chr(10)) END AS text, CASE WHEN s_suppkey % 5 <> 2 THEN 1 END AS page_count, CASE WHEN s_suppkey % 5 = 2 THEN 'not a PDF document' END AS read_error FROM supplier")
def pdf_bytes(spark, sf_dir):
    return pipeline.extract_text(_suppliers(spark, sf_dir)).select("s_suppkey", "text", "page_count", "read_error")


@query("SELECT n_nationkey, 'Nacao de ' || n_name || chr(10) || 'numero ' || n_nationkey || chr(10) AS text FROM nation")
def raw_text_ingest(spark, sf_dir):
    at = _folder(spark, "texts")
    text = F.concat(F.lit("Nacao de "), "n_name", F.lit("\nnumero "), "n_nationkey")
    table(spark, sf_dir, "nation").select("n_nationkey", text.alias("value")).write.partitionBy("n_nationkey").text(at)
    return documents.text_files(spark, at + "/*").select(F.regexp_extract("source_filename", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), "text")


@query(
    f"""SELECT 'file' AS input_type, {_sql_pdf(_NATION_LINES)} || chr(10) AS content, true AS named FROM nation
UNION ALL SELECT 'bytes', CASE WHEN s_suppkey % 5 = 2 THEN 'no pdf ' || s_suppkey ELSE {_sql_pdf(_SUPPLIER_LINES)} END, false FROM supplier"""
)
def input_dispatch(spark, sf_dir):
    files = documents.pdf_files(spark, _nation_files(spark, sf_dir), "*.txt")
    both = documents.dispatch(files, _suppliers(spark, sf_dir).select("content"))
    return both.select("input_type", F.col("content").cast("string").alias("content"), (F.col("source") != "memory").alias("named"))


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, lote FROM nation, (SELECT unnest(['1', '2']) AS lote)")
def csv_append(spark, sf_dir):
    at = _folder(spark, "csv")
    for batch in (1, 2):
        payloads.append_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(batch).alias("lote")), at)
    return spark.read.option("header", True).schema("n_nationkey string, n_name string, lote string").csv(at)


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the whole process over the suppliers' PDF bytes and the nations' files."""
    files = documents.pdf_files(spark, _nation_files(spark, sf_dir), "*.txt")
    return pipeline.process(documents.dispatch(files, _suppliers(spark, sf_dir).select("content")))


_INPUTS = f"""(SELECT 'f' || n_nationkey AS id, 'file' AS kind, {_sql_pdf(_NATION_LINES)} || chr(10) AS content, array_to_string({_NATION_LINES}, chr(10)) AS text, true AS ok, false AS issuer FROM nation
UNION ALL SELECT 'b' || s_suppkey, 'bytes', CASE WHEN s_suppkey % 5 = 2 THEN 'no pdf ' || s_suppkey ELSE {_sql_pdf(_SUPPLIER_LINES)} END, array_to_string({_SUPPLIER_LINES}, chr(10)), s_suppkey % 5 <> 2, true FROM supplier)"""


@query(
    f"""SELECT CASE WHEN ok THEN sha256(content) END AS input_hash_sha256, CASE WHEN ok THEN kind END AS input_type, CASE WHEN ok THEN length(text)::BIGINT END AS file_size_bytes,
  CASE WHEN ok THEN 1 END AS page_count, CASE WHEN ok THEN 'utf-8' END AS encoding_detected, CASE WHEN ok THEN CASE kind WHEN 'file' THEN 'a file' ELSE 'memory' END END AS source_filename FROM {_INPUTS}"""
)
def raw_metadata(spark, sf_dir):
    source = F.when(F.col("payload.source_filename") == "memory", "memory").when(F.col("payload.source_filename").rlike("n_nationkey=[0-9]+/"), "a file")
    return _processed(spark, sf_dir).select("raw_metadata.*", source.alias("source_filename"))


@query(
    f"""WITH s AS (SELECT unnest(['READ', 'NORMALIZE', 'PARSE', 'VALIDATE']) AS stage, unnest([0, 1, 2, 3]) AS i)
SELECT CASE WHEN ok THEN sha256(text) END AS text_hash, i AS event_index, stage, CASE WHEN ok THEN 'SUCCESS' ELSE 'FAILURE' END AS status, CASE WHEN ok THEN 'CONTINUE' ELSE 'ABORT' END AS error_policy,
  CASE WHEN NOT ok THEN 'error' ELSE CASE i WHEN 0 THEN 'duration_sec,page_count,extraction_method,input_source' WHEN 1 THEN 'duration_sec,raw_text_hash_sha256,normalized_text_hash_sha256,reduction_ratio'
    WHEN 2 THEN 'duration_sec,items_count,issuer_found,recipient_found,total_value' ELSE 'duration_sec,trust_score,issues_count,critical_errors' END END AS keys,
  CASE WHEN NOT ok THEN '"not a PDF document"' WHEN i = 0 THEN '1' WHEN i = 1 THEN '0.0' WHEN i = 2 THEN 'true' ELSE 'true' END AS told
FROM {_INPUTS}, s WHERE ok OR i = 0"""
)
def process_trail(spark, sf_dir):
    """The audit trail of the process itself: which details each event has, in order, and one of them as it stands in the JSON."""
    x = _processed(spark, sf_dir).select(F.sha2("payload.raw_text", 256).alias("text_hash"), F.posexplode_outer("events").alias("event_index", "e"))
    field = F.when(F.col("e.status") == "FAILURE", "error").otherwise(F.get(F.array(*map(F.lit, ("page_count", "reduction_ratio", "issuer_found", "critical_errors"))), F.col("event_index")))
    told = F.call_function("regexp_extract", F.col("e.details"), F.concat(F.lit('"'), field, F.lit('":("[^"]*"|[^,}]*)')), F.lit(1))
    return x.select("text_hash", "event_index", "e.stage", "e.status", "e.error_policy", F.array_join(F.json_object_keys("e.details"), ",").alias("keys"), told.alias("told"))
