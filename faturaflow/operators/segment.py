"""PARSE, first half: the text cut at section headers and regrouped by section."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faturaflow.functions.rx import LOOSE, S, bind

#: The headers that open a section of each kind.
MARKERS = {
    "issuer": (rf"PRESTADOR{S}+(?:DO|DE)?{S}*SERVI[CÇ]O", rf"DADOS{S}+DO{S}+PRESTADOR", "EMITENTE"),
    "recipient": (rf"TOMADOR{S}+(?:DO|DE)?{S}*SERVI[CÇ]O", rf"DADOS{S}+DO{S}+TOMADOR", "DESTINAT[AÁ]RIO"),
    "items": (rf"DISCRIMINA[CÇ][AÃ]O{S}+(?:DOS|DE)?{S}*(?:SERVI[CÇ]OS|PRODUTOS)", rf"DESCRI[CÇ][AÃ]O{S}+DOS{S}+SERVI[CÇ]OS"),
    "financials": (rf"VALOR{S}+TOTAL", rf"TOTAL{S}+GERAL", "TRIBUTA[CÇ][AÃ]O", rf"TOTAL{S}+DO{S}+SERVI[CÇ]O"),
}
_ANY = "|".join(m for ms in MARKERS.values() for m in ms)


def scrub_utf8(raw: Column) -> Column:
    """Bytes as text, without what is no UTF-8."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("\ufffd"), F.lit(""))


def segments(text: Column) -> Column:
    """(kind, text) of each piece between headers, in order; kind is null before the first header.

    A header inside a header cuts it, so a piece is recognised together with what follows it.
    """

    def kind(seen: Column) -> Column:
        found = F.lit(None).cast("string")
        for name, markers in MARKERS.items():
            found = F.when(seen.rlike(f"{LOOSE}^(?:{'|'.join(markers)})"), name).otherwise(found)
        return found

    def typed(parts: Column) -> Column:
        after = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
        return F.zip_with(parts, after, lambda a, b: F.struct(kind(F.concat(a, F.coalesce(b, F.lit("")))).alias("kind"), a.alias("text")))

    return bind(F.split(text, f"{LOOSE}(?={_ANY})"), typed)


def blocks(text: Column) -> Column:
    """Struct of header, issuer, recipient, items and financials; a missing section is empty."""

    def of(found: Column) -> Column:
        def joined(name: str | None) -> Column:
            own = F.filter(found, lambda s: s["kind"] == name if name else s["kind"].isNull())
            return F.array_join(F.transform(own, lambda s: s["text"]), "\n")

        return F.struct(joined(None).alias("header"), *[joined(n).alias(n) for n in MARKERS])

    return bind(segments(F.coalesce(text, F.lit(""))), of)
