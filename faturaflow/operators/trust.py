"""VALIDATE: issues, trust score and status of an invoice record; routing predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from faturaflow.functions import validators as V
from faturaflow.functions.rx import bind

#: Code, field, severity and penalty of each rule, in the order of the checks.
RULES = (
    ("MISSING_ISSUER", "issuer.cnpj_cpf", "error", 1.0),
    ("INVALID_ISSUER_CNPJ", "issuer.cnpj_cpf", "error", 1.0),
    ("MISSING_RECIPIENT", "recipient", "warning", 0.1),
    ("MISSING_TOTAL", "financials.total", "error", 0.5),
    ("INVALID_TOTAL_FORMAT", "financials.total", "warning", 0.3),
    ("INVALID_KEY", "chave_acesso", "warning", 0.2),
)
AUDIT_ABOVE = 10_000


def _given(x: Column) -> Column:
    return F.coalesce(x != "", F.lit(False))


def faults(issuer: Column, total: Column, key: Column) -> Column:
    """What is wrong with an issuer's CNPJ, a total and a key, each null where nothing is or none is given: every validator runs once."""
    wrong = {"cnpj": (issuer, V.cnpj), "money": (total, V.fiscal_money), "key": (key, V.nfe_key)}
    return F.struct(*[F.when(_given(x), check(x)["erro"]).alias(n) for n, (x, check) in wrong.items()])


def findings(issuer: Column, recipient: Column, total: Column, key: Column, wrong: Column) -> dict[str, tuple[Column, Column]]:
    """For each rule whether it fires and its message, of an issuer's and recipient's CNPJ, total, key and their faults."""
    return {
        "MISSING_ISSUER": (~_given(issuer), F.lit("CNPJ do emitente não encontrado")),
        "INVALID_ISSUER_CNPJ": (_given(issuer) & wrong["cnpj"].isNotNull(), F.concat(F.lit("CNPJ inválido: "), wrong["cnpj"])),
        "MISSING_RECIPIENT": (~_given(recipient), F.lit("Tomador não identificado")),
        "MISSING_TOTAL": (~_given(total), F.lit("Valor total não encontrado")),
        "INVALID_TOTAL_FORMAT": (_given(total) & wrong["money"].isNotNull(), F.concat(F.lit("Formato inválido: "), wrong["money"])),
        "INVALID_KEY": (_given(key) & wrong["key"].isNotNull(), F.concat(F.lit("Chave inválida: "), wrong["key"])),
    }


def issues(issuer: Column, recipient: Column, total: Column, key: Column) -> Column:
    """Array of issue structs (code, field, message, severity) in the order of the checks."""

    def listed(wrong: Column) -> Column:
        found = findings(issuer, recipient, total, key, wrong)
        each = [
            F.when(found[code][0], F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), found[code][1].alias("message"), F.lit(severity).alias("severity")))
            for code, field, severity, _ in RULES
        ]
        return F.filter(F.array(*each), lambda x: x.isNotNull())

    return bind(faults(issuer, total, key), listed)


def score(found: Column) -> Column:
    """1 less the penalties of the issues, at least 0, not rounded."""
    codes = F.transform(found, lambda x: x["code"])
    off = [F.when(F.array_contains(codes, code), F.lit(p)).otherwise(F.lit(0.0)) for code, _, _, p in RULES]
    return F.greatest(F.lit(0.0), reduce(lambda a, b: a - b, off, F.lit(1.0)))


def status(found: Column, trust: Column) -> Column:
    critical = F.exists(found, lambda x: x["severity"] == "error")
    return F.when(critical, "error").when((F.size(found) > 0) | (trust < 1.0), "partial").otherwise("success")


def verdict(invoice: Column) -> Column:
    """Struct of issues, score and status of an invoice record."""
    found = issues(invoice["issuer"]["cnpj_cpf"], invoice["recipient"]["cnpj_cpf"], invoice["financials"]["total"], invoice["chave_acesso"])

    def of(i: Column) -> Column:
        return bind(score(i), lambda s: F.struct(i.alias("issues"), s.alias("score"), status(i, s).alias("status")))

    return bind(found, of)


def approved(*valid: Column) -> Column:
    """aprovado where every validator passes."""
    return F.when(reduce(lambda a, b: a & b, valid), "aprovado").otherwise("rejeitado")


def route_by_value(amount: Column) -> Column:
    return F.when(amount.isNull(), "revisao_manual").when(amount > AUDIT_ABOVE, "auditoria_fiscal").otherwise("processamento_normal")


def route_by_confidence(invoice: Column) -> Column:
    doubtful = invoice["issuer"].isNotNull() & invoice["issuer"]["cnpj_cpf"].isNull()
    return F.when(doubtful, "revisao_manual").otherwise("processamento_automatico")
