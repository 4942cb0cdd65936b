"""Validators of fiscal numbers and money as column expressions; each returns one struct.

A struct has every field a validator can report, null where an outcome does not set it. The
checks are ordered: the first that fails decides error and confidence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faturaflow.functions.rx import EXACT, bind, strip

#: Mod-11 weights, IBGE state codes, document models, currencies in order of detection.
CNPJ_WEIGHTS = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
STATES = (
    "11 12 13 14 15 16 17 21 22 23 24 25 26 27 28 29 31 32 33 35 41 42 43 50 51 52 53"
).split()
MODELS = {"55": "NF-e", "65": "NFC-e"}
CURRENCIES = {
    "BRL": ("R$", "BRL"),
    "USD": ("$", "USD", "US$"),
    "EUR": ("€", "EUR"),
    "GBP": ("£", "GBP"),
    "JPY": ("¥", "JPY"),
    "CNY": ("¥", "CNY", "RMB"),
}
SHOWN_AS = {"BRL": "R$", "USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "CNY": "¥"}
COMMA_DECIMAL = ("BRL", "EUR")
WITHOUT_CENTS = ("JPY", "CNY")
MOST_MONEY = 1_000_000_000


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def mod11(number: Column, weights) -> Column:
    """The check digit of the first digits of a number: 0 for a remainder under 2, else 11 less the remainder."""
    each = F.zip_with(F.split(number, ""), F.array(*map(F.lit, weights)), lambda d, w: F.coalesce(d.try_cast("int") * w, F.lit(0)))
    rest = F.aggregate(each, F.lit(0), lambda total, x: total + x) % 11
    return bind(rest, lambda r: F.when(r < 2, F.lit(0)).otherwise(11 - r))


def cnpj_digits(base: Column) -> Column:
    """The two check digits of a 12-digit base, as text."""

    def of(b: Column) -> Column:
        one = mod11(b, CNPJ_WEIGHTS[1:]).cast("string")
        return bind(one, lambda d: F.concat(d, mod11(F.concat(b, d), CNPJ_WEIGHTS).cast("string")))

    return bind(base, of)


def _cut(text: Column, *sizes: int) -> list[Column]:
    parts, at = [], 1
    for n in sizes:
        parts.append(F.substring(text, at, n))
        at += n
    return parts


def cnpj_format(clean: Column) -> Column:
    def of(x: Column) -> Column:
        a, b, c, d, e = _cut(x, 2, 3, 3, 4, 2)
        return F.concat(a, F.lit("."), b, F.lit("."), c, F.lit("/"), d, F.lit("-"), e)

    return bind(clean, of)


def cnpj_error(clean: Column) -> Column:
    """Why 14 digits or other text are no CNPJ, null if they are one."""

    def wrong(x: Column, which: int, due: Column) -> Column:
        message = F.concat(F.lit(f"Dígito verificador {which} incorreto (esperado "), due, F.lit(")"))
        return F.when(F.substring(x, 12 + which, 1).try_cast("int") != due, message)

    def of(x: Column) -> Column:
        one = bind(mod11(x, CNPJ_WEIGHTS[1:]), lambda due: wrong(x, 1, due))
        two = bind(mod11(x, CNPJ_WEIGHTS), lambda due: wrong(x, 2, due))
        return (
            F.when(F.length(x) != 14, F.concat(F.lit("CNPJ deve ter 14 dígitos (recebido "), F.length(x), F.lit(")")))
            .when(x.rlike(r"^(\d)\1{13}$"), F.lit("CNPJ com todos dígitos repetidos"))
            .otherwise(F.coalesce(one, two))
        )

    return bind(clean, of)


def cnpj_valid(value: Column) -> Column:
    return F.coalesce(bind(digits(value), lambda c: cnpj_error(c).isNull()), F.lit(False))


def cnpj(value: Column) -> Column:
    """CNPJ: length, repetition, both check digits; then form and kind of branch."""

    def of(c: Column) -> Column:
        def told(error: Column) -> Column:
            ok = error.isNull()
            return F.struct(
                ok.alias("valido"),
                error.alias("erro"),
                F.when(ok, c).alias("cnpj_limpo"),
                F.when(ok, cnpj_format(c)).alias("cnpj_formatado"),
                F.when(ok, F.when(F.substring(c, 9, 4) == "0001", "matriz").otherwise("filial")).alias("tipo"),
                F.when(ok, 95).when(error.startswith("Dígito"), 99).otherwise(100).alias("confianca"),
            )

        return bind(F.coalesce(cnpj_error(c), F.lit("")), lambda e: told(F.nullif(e, F.lit(""))))

    return bind(digits(F.coalesce(value, F.lit(""))), of)


def nfe_year(clean: Column) -> Column:
    yy = F.substring(clean, 3, 2).try_cast("int")
    return F.when(yy >= 8, yy + 2000).otherwise(yy + 2100)


def nfe_digit(clean: Column) -> Column:
    """The check digit of the first 43 digits: weights 2 to 9, again and again from the right."""
    return mod11(clean, [2 + (42 - i) % 8 for i in range(43)])


def nfe_key(value: Column) -> Column:
    """NF-e access key: length, state, year, month, model, issuer's CNPJ, check digit, in this order."""

    def of(c: Column) -> Column:
        return bind(F.struct(nfe_year(c).alias("year"), nfe_digit(c).alias("due"), cnpj_error(F.substring(c, 7, 14)).alias("cnpj")), lambda known: judged(c, known))

    def judged(c: Column, known: Column) -> Column:
        state, _, month, issuer, model = _cut(c, 2, 2, 2, 14, 2)
        year, due, cnpj_wrong = known["year"], known["due"], known["cnpj"]
        m = month.try_cast("int")
        checks = [
            (F.length(c) != 44, 100, F.concat(F.lit("Chave deve ter 44 dígitos (recebido "), F.length(c), F.lit(")"))),
            (~state.isin(STATES), 100, F.concat(F.lit("Código UF inválido: "), state)),
            (~year.between(2008, 2030), 95, F.concat(F.lit("Ano implausível: "), year)),
            (~m.between(1, 12), 100, F.concat(F.lit("Mês inválido: "), month)),
            (~model.isin(*MODELS), 95, F.concat(F.lit("Modelo inválido: "), model, F.lit(" (esperado 55=NF-e ou 65=NFC-e)"))),
            (cnpj_wrong.isNotNull(), 99, F.concat(F.lit("CNPJ inválido na chave: "), cnpj_wrong)),
            (
                F.substring(c, 44, 1).try_cast("int") != due, 99,
                F.concat(F.lit("Dígito verificador incorreto (esperado "), due, F.lit(", recebido "), F.substring(c, 44, 1), F.lit(")")),
            ),
        ]
        verdict = F.lit(None).cast("struct<confianca:int,erro:string>")
        for bad, sure, message in reversed(checks):
            verdict = F.when(bad, F.struct(F.lit(sure).alias("confianca"), message.alias("erro"))).otherwise(verdict)

        def told(v: Column) -> Column:
            ok = v["erro"].isNull()
            groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: c.substr(i * 4 + 1, F.lit(4))), " ")
            kinds = F.when(model == "55", MODELS["55"]).otherwise(MODELS["65"])
            return F.struct(
                ok.alias("valido"),
                v["erro"].alias("erro"),
                F.when(ok, c).alias("chave_limpa"),
                F.when(ok, groups).alias("chave_formatada"),
                F.when(ok, state).alias("uf"),
                F.when(ok, F.concat(year, F.lit("-"), month)).alias("ano_mes"),
                F.when(ok, cnpj_format(issuer)).alias("cnpj_emitente"),
                F.when(ok, kinds).alias("modelo"),
                F.when(ok, 90).otherwise(v["confianca"]).alias("confianca"),
            )

        return bind(F.coalesce(verdict, F.struct(F.lit(None).cast("int").alias("confianca"), F.lit(None).cast("string").alias("erro"))), told)

    return bind(digits(F.coalesce(value, F.lit(""))), of)


def currency(value: Column) -> Column:
    """The first currency, in the fixed order, one of whose symbols occurs; BRL if none does."""
    shown = F.upper(value)
    found = F.lit("BRL")
    for code, symbols in reversed(CURRENCIES.items()):
        hit = F.lit(False)
        for s in symbols:
            hit = hit | F.contains(shown, F.lit(s))
        found = F.when(hit, code).otherwise(found)
    return found


def plain_number(value: Column, code: Column) -> Column:
    """The number as text with a decimal point: symbols, thousands marks and blanks gone.

    With decimal commas a lone dot is a decimal point: 1.500 is one and a half.
    """
    clean = F.lit(None).cast("string")
    for c, symbols in CURRENCIES.items():
        x = value
        for s in symbols:
            x = F.replace(x, F.lit(s), F.lit(""))
        clean = F.when(code == c, x).otherwise(clean)

    def of(x: Column) -> Column:
        comma, dot = F.contains(x, F.lit(",")), F.contains(x, F.lit("."))
        point = F.when(comma & dot, F.translate(x, ",.", ".")).when(comma, F.translate(x, ",", ".")).otherwise(x)
        return F.replace(F.when(code.isin(*COMMA_DECIMAL), point).otherwise(F.replace(x, F.lit(","), F.lit(""))), F.lit(" "), F.lit(""))

    return bind(strip(clean), of)


def money_format(number: Column, code: Column) -> Column:
    """As the currency is written: 1.234,56 for comma currencies, no cents for JPY and CNY."""
    shown = F.lit(None).cast("string")
    for c, symbol in SHOWN_AS.items():
        text = F.format_number(number, 0 if c in WITHOUT_CENTS else 2)
        text = F.translate(text, ",.", ".,") if c in COMMA_DECIMAL else text
        shown = F.when(code == c, F.concat(F.lit(symbol + " "), text)).otherwise(shown)
    return shown


#: What the reference's decimal type reads as a finite number, without digit groups.
_NUMBER = rf"{EXACT}^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def money(value: Column, fiscal: bool = False, expected: str | None = None, strict: bool = False) -> Column:
    """Money: currency rules, format, sign, size, cents; then decimal value and written form.

    US$ is refused, as its letters stay; with `strict` it is the dollar's sign.

    Numbers beyond the decimal type count as absurdly large; NaN counts as a wrong format.
    """
    value = F.coalesce(value, F.lit(""))
    if strict:
        value = F.replace(value, F.lit("US$"), F.lit("$"))

    def of(raw: Column) -> Column:
        return bind(currency(raw), lambda code: bind(plain_number(raw, code), lambda text: told(code, text)))

    def told(code: Column, text: Column) -> Column:
        number = F.when(text.rlike(_NUMBER), text.try_cast("decimal(38,10)"))
        return bind(number, lambda n: judged(code, text, n))

    def judged(code: Column, text: Column, number: Column) -> Column:
        shaped = number.isNotNull() | text.rlike(_NUMBER) | F.lower(text).rlike(r"^[+-]?inf(?:inity)?$")
        negative = text.startswith("-") & text.rlike(r"^-[^eE]*[1-9iI]")
        huge = (number > MOST_MONEY) | number.isNull()
        # Digits beyond the decimal type's scale are judged on the text.
        cents = (number != F.round(number, 2)) | ((number == 0) & text.rlike(r"^[^eE]*[1-9]")) | text.rlike(r"^[^eE]*\.[0-9]{2}[0-9]*[1-9][0-9]*$")
        checks = []
        if fiscal:
            checks.append((code != "BRL", 100, F.concat(F.lit("Contexto fiscal brasileiro deve usar Real (R$), não: "), code)))
        if expected:
            checks.append((code != expected, 95, F.concat(F.lit(f"Moeda esperada {expected}, recebida "), code)))
        checks += [
            (~shaped, 100, F.concat(F.lit("Formato inválido: não é um número válido ("), value, F.lit(")"))),
            (negative, 100, F.lit("Valor negativo")),
            (huge, 90, F.concat(F.lit("Valor absurdo: R$ "), F.coalesce(F.format_number(number, 2), text))),
            (cents, 80, F.lit("Mais de 2 casas decimais")),
        ]
        error, sure = F.lit(None).cast("string"), F.lit(95)
        for bad, c, message in reversed(checks):
            error, sure = F.when(bad, message).otherwise(error), F.when(bad, c).otherwise(sure)

        def done(e: Column) -> Column:
            ok = e == ""
            return F.struct(
                ok.alias("valido"),
                F.nullif(e, F.lit("")).alias("erro"),
                F.when(ok, number).alias("valor_decimal"),
                F.when(ok, money_format(number, code)).alias("valor_formatado"),
                code.alias("moeda"),
                F.when(ok, code == "BRL").alias("fiscal_brasil"),
                sure.alias("confianca"),
            )

        return bind(F.coalesce(error, F.lit("")), done)

    return bind(strip(value), of)


def fiscal_money(value: Column) -> Column:
    """Money in a Brazilian fiscal document: BRL only."""
    return money(value, fiscal=True, expected="BRL")
