"""What leaves the engine: JSON, ERP and analytics projections, and an appended CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTY = "struct<name:string,cnpj_cpf:string,address:string,municipal_insc:string,email:string,phone:string>"
INVOICE = (
    f"emission_date string, competence_date string, chave_acesso string, issuer {PARTY}, recipient {PARTY}, "
    "items array<struct<description:string,quantity:double,unit:string,unit_value:string,cfop:string,raw:string>>, "
    "financials struct<total:string,taxes:map<string,string>,payment_method:string>, raw_text string, tenant_id string, source_filename string"
)


def to_json(invoice: Column) -> Column:
    return F.to_json(invoice, {"ignoreNullFields": "false"})


def from_json(text: Column) -> Column:
    return F.from_json(text, INVOICE)


def erp(invoice: Column) -> Column:
    """The invoice as an ERP document."""

    def side(x: Column) -> Column:
        return F.struct(x["cnpj_cpf"].alias("tax_id"), x["name"].alias("name"))

    return F.struct(
        F.lit("NFS-e").alias("document_type"),
        invoice["emission_date"].alias("issue_date"),
        side(invoice["issuer"]).alias("supplier"),
        side(invoice["recipient"]).alias("customer"),
        F.transform(invoice["items"], lambda x: F.struct(x["description"].alias("description"), x["unit_value"].alias("amount"))).alias("line_items"),
        invoice["financials"]["total"].alias("total_amount"),
    )


def analytics(invoice: Column) -> Column:
    """The invoice as one flat analytics row."""
    return F.struct(
        invoice["emission_date"].alias("event_time"),
        F.lit("invoice_processed").alias("event_type"),
        invoice["issuer"]["cnpj_cpf"].alias("issuer_cnpj"),
        invoice["financials"]["total"].alias("total_value"),
        F.size(invoice["items"]).alias("items_count"),
        invoice["chave_acesso"].isNotNull().alias("has_key"),
    )


def append_csv(df: DataFrame, path: str) -> None:
    """Rows appended to a folder of CSV files, each with its header."""
    df.write.mode("append").option("header", True).csv(path)
