"""Invoices rendered from the sales tables, for queries whose answer SQL can tell from the tables.

Every line begins with a letter, item lines are unique, and some orders lack a party, a valid
CNPJ, a total or a key, by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faturaflow.functions import validators as V
from faturaflow.functions.rx import bind

NO_RECIPIENT, BAD_ISSUER, NO_TOTAL, WITH_KEY = (7, 3), (11, 5), (13, 7), (3, 1)


def is_case(key: Column, case: tuple[int, int]) -> Column:
    return key % case[0] == case[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cnpj_of(number: Column) -> Column:
    """A valid CNPJ of a head office, in written form."""
    base = F.concat(F.lpad(number.cast("string"), 8, "0"), F.lit("0001"))
    return bind(base, lambda b: V.cnpj_format(F.concat(b, V.cnpj_digits(b))))


def moved_on(cnpj: Column) -> Column:
    """Every digit of a number one further, 0 after 9. Of some valid CNPJs this is another valid one."""
    return F.translate(cnpj, "0123456789", "1234567890")


def bad_cnpj_of(number: Column) -> Column:
    """No CNPJ: the valid one moved on, its last digit once more where that is valid by chance."""

    def of(x: Column) -> Column:
        return F.when(V.cnpj_valid(x), F.concat(F.substring(x, 1, 17), moved_on(F.substring(x, 18, 1)))).otherwise(x)

    return bind(moved_on(cnpj_of(number)), of)


def brl(amount: Column) -> Column:
    return F.translate(F.format_number(amount.cast("decimal(18,2)"), 2), ",.", ".,")


def key_of(order: Column, supplier: Column, date: Column) -> Column:
    """A valid access key of an order, dated twenty years on."""
    base = F.concat(F.lpad(supplier.cast("string"), 8, "0"), F.lit("0001"))
    month = F.concat(F.lpad(((F.year(date) + 20) % 100).cast("string"), 2, "0"), F.lpad(F.month(date).cast("string"), 2, "0"))
    issuer = bind(base, lambda b: F.concat(b, V.cnpj_digits(b)))
    head = F.concat(F.lit("35"), month, issuer, F.lit("55001"), F.lpad(order.cast("string"), 9, "0"), F.lit("1"), F.lpad(order.cast("string"), 8, "0"))
    return bind(head, lambda h: F.concat(h, V.nfe_digit(h).cast("string")))


def orders_with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with customer, supplier (the smallest of the lines) and their lines in order."""
    line = F.struct("l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("suppkey"), F.array_sort(F.collect_set(line)).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).drop("l_orderkey")


def invoices(spark: SparkSession, sf_dir: str, bad_issuer=bad_cnpj_of) -> DataFrame:
    """(o_orderkey, text): one invoice an order; bad_issuer(number) is the issuer's CNPJ in the cases of BAD_ISSUER."""
    o, key = orders_with_items(spark, sf_dir), F.col("o_orderkey")
    items = F.transform("lines", lambda x: F.concat(F.lit("Pacote de suporte nivel "), F.char(x["l_linenumber"] + 64), F.lit(" R$ "), brl(x["price"])))
    text = F.concat_ws(
        "\n",
        F.lit("NOTA FISCAL ELETRONICA"),
        F.concat(F.lit("EMISSÃO: "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" 10:30:00")),
        F.concat(F.lit("COMPETÊNCIA: "), F.date_format("o_orderdate", "MM/yyyy")),
        F.when(is_case(key, WITH_KEY), F.concat(F.lit("Chave de acesso: "), key_of(key, F.col("suppkey"), F.col("o_orderdate")))),
        F.lit("PRESTADOR DE SERVIÇO"),
        F.concat(F.lit("Fornecedor "), F.col("suppkey"), F.lit(" LTDA.")),
        F.concat(F.lit("CNPJ: "), F.when(is_case(key, BAD_ISSUER), bad_issuer(F.col("suppkey"))).otherwise(cnpj_of(F.col("suppkey")))),
        F.when(~is_case(key, NO_RECIPIENT), F.concat(F.lit("TOMADOR DE SERVIÇO\nCliente   "), F.col("o_custkey"), F.lit(" S.A.\nCNPJ: "), cnpj_of(F.col("o_custkey") + 50_000_000))),
        F.lit("DISCRIMINAÇÃO DOS SERVIÇOS"),
        F.array_join(items, "\n"),
        F.when(~is_case(key, NO_TOTAL), F.concat(F.lit("TOTAL GERAL: R$ "), brl(F.col("o_totalprice")))),
    )
    return o.select("o_orderkey", text.alias("text"))
