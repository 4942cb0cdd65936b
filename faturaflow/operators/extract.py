"""PARSE, second half: fields from the text and its sections. What is not found is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faturaflow.functions import validators as V
from faturaflow.functions.rx import BEGIN, END, EXACT, LOOSE, S, all_matches, bind, first, lines, strip
from faturaflow.operators import segment

#: The patterns of numbers.
CNPJ = rf"{EXACT}{BEGIN}\d{{2}}\.?\d{{3}}\.?\d{{3}}/?\.?\d{{4}}-?\d{{2}}{END}"
KEY = rf"{EXACT}{BEGIN}\d{{44}}{END}"
MONEY = rf"{EXACT}R?\$?{S}*(\d{{1,3}}(?:[.,]\d{{3}})*(?:[.,]\d{{2}}))"
#: An amount of an item line that is read whole, with digits of thousands that have lost their mark.
WHOLE_MONEY = rf"{EXACT}R?\$?{S}*(\d+(?:[.,]\d{{3}})*[.,]\d{{2}})(?!\d)"
#: Words that are no name by themselves, and words of lines that are no items.
LABELS = (
    "DO DE DA DOS DAS SERVICO SERVICOS PRODUTO PRODUTOS PRESTADOR TOMADOR EMITENTE DESTINATARIO "
    "CNPJ CPF DADOS MUNICIPAL SECRETARIA FAZENDA PREFEITURA NOTA FISCAL ELETRONICA NFSE NFE NFS-E "
    "NOME RAZAO SOCIAL ENDERECO MUNICIPIO UF EMPRESARIAL NIF INSCRICAO ESTADUAL"
).split()
NO_ITEM = ("TOTAL", "VALOR", "DATA", "COMPETÊNCIA", "DISCRIMINA")
TOTALS = (
    rf"TOTAL{S}+GERAL{S}*:?{S}*R?\$?{S}*([\d.,]+)",
    rf"VALOR{S}+L[IÍ]QUIDO{S}*:?{S}*R?\$?{S}*([\d.,]+)",
    rf"VALOR{S}+TOTAL{S}*:?{S}*R?\$?{S}*([\d.,]+)",
    rf"TOTAL{S}*:?{S}*R?\$?{S}*([\d.,]+)",
    rf"R\${S}*([\d.,]+)",
)
_MARKED = "ÁÀÂÃÄÅÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜÝ"
_BARE = "AAAAAACEEEEIIIINOOOOOUUUUY"


def strip_accents(t: Column) -> Column:
    """Latin letters without their marks, composed or combining."""
    both = _MARKED + _MARKED.lower(), _BARE + _BARE.lower()
    return F.regexp_replace(F.translate(t, *both), r"\p{M}+", "")


def access_key(text: Column) -> Column:
    """The first run of 44 digits that is a valid key, in its written form."""
    keys = F.filter(F.transform(all_matches(text, KEY), V.nfe_key), lambda k: k["valido"])
    return F.get(keys, F.lit(0))["chave_formatada"]


def cnpjs(text: Column) -> Column:
    """All valid CNPJs in order, in their written form."""
    return F.transform(F.filter(all_matches(text, CNPJ), V.cnpj_valid), lambda x: V.cnpj_format(V.digits(x)))


def emission_date(text: Column) -> Column:
    labelled = rf"{LOOSE}EMISS[AÃ]O.*?(\d{{2}}/\d{{2}}/\d{{4}}(?:{S}*\d{{2}}:\d{{2}}:\d{{2}})?)"
    return F.coalesce(first(text, labelled), first(text, rf"{EXACT}{BEGIN}(\d{{2}}/\d{{2}}/\d{{4}}){END}"))


def competence_date(text: Column) -> Column:
    label = rf"{LOOSE}COMPET[EÊ]NCIA.*?"
    return F.coalesce(first(text, label + r"(\d{2}/\d{4})"), first(text, label + r"(\d{2}-\d{4})"))


def party_name(line: Column) -> Column:
    """A line as a name: upper case, single blanks, no marks at its end; null if it is only labels."""

    def judged(name: Column) -> Column:
        words = F.filter(F.split(strip_accents(name), rf"{EXACT}{S}+"), lambda w: F.length(w) > 2)
        return F.when((F.size(words) > 0) & ~F.forall(words, lambda w: w.isin(LABELS)), name)

    clean = strip(F.upper(F.regexp_replace(line, rf"{EXACT}{S}+", " ")))
    return bind(strip(F.regexp_replace(clean, r"[.\-,]+$", "")), judged)


def party(block: Column) -> Column:
    """Struct of name and CNPJ; null without a block, null fields without usable content."""
    found = F.filter(F.transform(lines(block), strip), lambda x: x != "")
    names = F.transform(F.filter(found, lambda x: ~V.cnpj_valid(x)), party_name)
    name = F.get(F.filter(names, lambda x: x.isNotNull()), F.lit(0))
    blank = [F.lit(None).cast("string").alias(n) for n in ("address", "municipal_insc", "email", "phone")]
    return F.when(strip(block) != "", F.struct(name.alias("name"), F.get(cnpjs(block), F.lit(0)).alias("cnpj_cpf"), *blank))


def money_tokens(line: Column, strict: bool = False) -> Column:
    """The amounts of a line that are valid in a fiscal document, as written; without `strict`, thousands whose mark is gone are cut off."""
    return F.filter(all_matches(line, WHOLE_MONEY if strict else MONEY, 1), lambda v: V.money(v, fiscal=True)["valido"])


def description(line: Column, amounts: Column) -> Column:
    """The line without its amounts and currency marks."""
    rest = F.aggregate(amounts, line, lambda text, v: strip(F.replace(text, v, F.lit(""))))
    return strip(F.regexp_replace(rest, rf"{EXACT}R\${S}*", ""))


def items(block: Column, strict: bool = False) -> Column:
    """Item structs: lines with amounts, and long lines without. quantity, unit and cfop are never told by a line."""

    def item(line: Column) -> Column:
        def of(amounts: Column) -> Column:
            return F.struct(
                F.when(F.size(amounts) > 0, description(line, amounts)).when(F.length(line) > 15, line).alias("description"),
                F.lit(None).cast("double").alias("quantity"),
                F.lit(None).cast("string").alias("unit"),
                F.element_at(F.when(F.size(amounts) > 0, amounts), -1).alias("unit_value"),
                F.lit(None).cast("string").alias("cfop"),
                line.alias("raw"),
            )

        return bind(money_tokens(line, strict), of)

    def may_be(line: Column) -> Column:
        shown = F.upper(line)
        ok = F.length(line) >= 10
        for word in NO_ITEM:
            ok = ok & ~F.contains(shown, F.lit(word))
        return ok

    found = F.filter(F.transform(lines(block), strip), may_be)
    return F.filter(F.transform(found, item), lambda x: x["description"] != "")


def total(block: Column) -> Column:
    """The total by the first label whose first amount is valid, in its written form."""
    found = [bind(first(block, LOOSE + p), lambda x: F.when(x.isNotNull(), V.money(x, fiscal=True)["valor_formatado"])) for p in TOTALS]
    return F.coalesce(*found)


def record(text: Column, b: Column, source: Column | None = None, strict: bool = False) -> Column:
    """The invoice record of a normalised text and its sections; source names the file it came from; strict is that of items."""
    return F.struct(
        emission_date(text).alias("emission_date"),
        competence_date(text).alias("competence_date"),
        access_key(text).alias("chave_acesso"),
        party(b["issuer"]).alias("issuer"),
        party(b["recipient"]).alias("recipient"),
        items(b["items"], strict).alias("items"),
        F.struct(
            total(b["financials"]).alias("total"),
            F.lit(None).cast("map<string,string>").alias("taxes"),
            F.lit(None).cast("string").alias("payment_method"),
        ).alias("financials"),
        text.alias("raw_text"),
        F.lit(None).cast("string").alias("tenant_id"),
        (F.lit(None).cast("string") if source is None else source).alias("source_filename"),
    )


def invoice(text: Column, source: Column | None = None, strict: bool = False) -> Column:
    """The invoice record of a normalised text."""
    return bind(segment.blocks(text), lambda b: record(text, b, source, strict))
