"""The fiscal engine on hand-made inputs: validators, normaliser, parser, trust, audit, sources, sinks."""

import json
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from faturaflow import queries
from faturaflow.functions import validators as V
from faturaflow.operators import audit, extract, normalize, segment, trust
from faturaflow.plans import pipeline
from faturaflow.sinks import payloads
from faturaflow.sources import documents, pdf

INVOICE = """
    Nota 88 - via do cliente
    TOMADOR DE SERVIÇOS
    Padaria Três Irmãos Ltda.
    CNPJ: 45.723.174/0001-10
    PRESTADOR DE SERVIÇOS
    CNPJ: 11.444.777/0001-61
    OFICINA BOA RODA ME
    Emissão: 03/02/2023 08:05:00
    Competência: 01/2023
    DISCRIMINAÇÃO DOS SERVIÇOS
    Troca de óleo do forno R$ 90,00
    peça usada na troca
    Revisão da van de entregas R$ 1.315,40
    TOTAL GERAL: R$ 1.405,40
"""
KEY = "35240811444777000161550010000001231000001233"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("r")).first().r


@pytest.fixture(scope="module")
def invoice(spark):
    return pipeline.process_texts(spark.createDataFrame([(INVOICE,)], "text string")).first()


@pytest.mark.parametrize(
    ("given", "sure", "word"),
    [("123", 100, "14 dígitos"), ("", 100, "recebido 0"), (None, 100, "recebido 0"), ("11.111.111/1111-11", 100, "repetidos"), ("11.444.777/0001-62", 99, "verificador 2"), ("11.444.777/0001-71", 99, "verificador 1")],
)
def test_bad_cnpj(spark, given, sure, word):
    r = one(spark, given, V.cnpj)
    assert not r.valido and r.confianca == sure and word in r.erro


def test_good_cnpj(spark):
    r = one(spark, "11444777000161", V.cnpj)
    assert (r.valido, r.cnpj_formatado, r.tipo, r.confianca) == (True, "11.444.777/0001-61", "matriz", 95)


@pytest.mark.parametrize(
    ("given", "code", "value", "shown"),
    [("R$ 1.234,56", "BRL", 1234.56, "R$ 1.234,56"), ("$ 1,234.56", "USD", 1234.56, "$ 1,234.56"), ("€ 10,00", "EUR", 10, "€ 10,00"), ("£5", "GBP", 5, "£ 5.00"), ("¥ 1,000", "JPY", 1000, "¥ 1,000"), ("10 RMB", "CNY", 10, "¥ 10"), ("1.500", "BRL", 1.5, "R$ 1,50"), ("1e3", "BRL", 1000, "R$ 1.000,00"), ("0", "BRL", 0, "R$ 0,00")],
)
def test_good_money(spark, given, code, value, shown):
    r = one(spark, given, V.money)
    assert (r.valido, r.moeda, float(r.valor_decimal), r.valor_formatado) == (True, code, value, shown)


@pytest.mark.parametrize(
    ("given", "sure", "word"),
    [("abc", 100, "Formato"), ("", 100, "Formato"), ("-5,00", 100, "negativo"), ("2.000.000.000,00", 90, "absurdo"), ("1e40", 90, "absurdo"), ("1,234", 80, "casas"), ("1.00000000000001", 80, "casas"), ("US$ 100", 100, "Formato"), ("1.2.3", 100, "Formato"), ("1e-20", 80, "casas"), ("NaN", 100, "Formato")],
)
def test_bad_money(spark, given, sure, word):
    r = one(spark, given, V.money)
    assert not r.valido and r.confianca == sure and word in r.erro


def test_money_rules_for_currency(spark):
    assert one(spark, "$ 10", lambda x: V.money(x, fiscal=True)).confianca == 100
    assert one(spark, "$ 10", lambda x: V.money(x, expected="BRL")).confianca == 95
    assert one(spark, "R$ 10,00", V.fiscal_money).valido


@pytest.mark.parametrize(
    ("given", "sure", "word"),
    [(KEY[:-2], 100, "44 dígitos"), ("99" + KEY[2:], 100, "UF"), (KEY[:2] + "07" + KEY[4:], 95, "2107"), (KEY[:4] + "13" + KEY[6:], 100, "Mês"), (KEY[:20] + "54" + KEY[22:], 95, "Modelo"), (KEY[:19] + "9" + KEY[20:], 99, "CNPJ inválido"), (KEY[:-1] + "7", 99, "recebido 7")],
)
def test_bad_key(spark, given, sure, word):
    r = one(spark, given, V.nfe_key)
    assert not r.valido and r.confianca == sure and word in r.erro


def test_good_key(spark):
    good = KEY[:43] + str(one(spark, KEY, V.nfe_digit))
    r = one(spark, good, V.nfe_key)
    assert r.valido and r.ano_mes == "2024-08" and r.modelo == "NF-e" and r.chave_formatada.replace(" ", "") == good
    assert one(spark, "CHAVE " + good + " fim", extract.access_key) == r.chave_formatada


def test_normalise_noise(spark):
    text = "NOTA FISCAL​\r\nValor: 400 , 00\nValor: 400 , 00\n\n\n--\nSP\nx\n1\n2\nSérie 1 2"
    got = one(spark, text, normalize.normalize_text)
    assert got == "NOTA FISCAL\nValor: 400,00\nSP\n12\nSérie 12"


def test_normalise_is_stable_and_handles_blanks(spark):
    once = one(spark, INVOICE, normalize.normalize_text)
    assert one(spark, once, normalize.normalize_text) == once
    assert one(spark, "", normalize.normalize_text) == "" and one(spark, " \n\t ", normalize.normalize_text) == "" and one(spark, None, normalize.normalize_text) is None


def test_line_ends(spark):
    text = "aaa\r\nbbb\rccc\x0bddd\x0ceee\x1cfff\x85ggg hhh iii\n"
    assert one(spark, text, normalize.lines) == text.splitlines()


def test_text_column_is_required(spark):
    with pytest.raises(TypeError):
        pipeline.parse_texts(spark.createDataFrame([(1,)], "text long"))


def test_sections(spark):
    text = "topo\nDADOS DO PRESTADOR DE SERVIÇO\nA\nTOMADOR  SERVICO\nB\nEMITENTE\nC\nVALOR TOTAL GERAL: 5,00"
    b = one(spark, text, segment.blocks)
    assert b.header == "topo\n"
    assert b.issuer == "DADOS DO \nPRESTADOR DE SERVIÇO\nA\n\nEMITENTE\nC\n"
    assert b.recipient == "TOMADOR  SERVICO\nB\n"
    assert b.financials == "VALOR \nTOTAL GERAL: 5,00"
    assert one(spark, "sem seções", segment.blocks).header == "sem seções"
    assert one(spark, "EMITENTE X", segment.blocks).header == ""
    far = "DADOS DO" + " " * 500 + "PRESTADOR X"  # a header as wide as its blanks
    assert one(spark, "topo " + far, segment.blocks).issuer.strip() == far


@pytest.mark.parametrize(("given", "name"), [("Prestador de Serviço", None), ("CNPJ", None), ("DA", None), ("", None), ("Razão Social", None), ("Casa do Pão Ltda.,-", "CASA DO PÃO LTDA"), ("  Dados   da Nota Azul ", "DADOS DA NOTA AZUL")])
def test_names(spark, given, name):
    assert one(spark, given, extract.party_name) == name


def test_invoice_fields(invoice):
    i = invoice.invoice
    assert (i.emission_date, i.competence_date, i.chave_acesso) == ("03/02/2023 08:05:00", "01/2023", None)
    assert tuple(i.issuer)[:2] == ("OFICINA BOA RODA ME", "11.444.777/0001-61")
    assert tuple(i.recipient)[:2] == ("PADARIA TRÊS IRMÃOS LTDA", "45.723.174/0001-10")
    assert [(x.description, x.unit_value) for x in i["items"]] == [("Troca de óleo do forno", "90,00"), ("peça usada na troca", None), ("Revisão da van de entregas 1", "315,40")]
    assert i.financials.total == "R$ 1.405,40"
    assert (invoice.status, invoice.trust_score, invoice.validation_issues) == ("success", 1.0, [])


def test_strict_variants(spark):
    """Quirks of the default that strict mends: cut thousands, a payload kept on error, US$ refused."""
    df = spark.createDataFrame([(INVOICE,)], "text string")
    got = pipeline.process_texts(df, strict=True).first().invoice["items"]
    assert [(x.description, x.unit_value) for x in got][::2] == [("Troca de óleo do forno", "90,00"), ("Revisão da van de entregas", "1315,40")]
    r = one(spark, "US$ 100", lambda x: V.money(x, strict=True))
    assert (r.valido, r.moeda, r.valor_formatado) == (True, "USD", "$ 100.00")
    memory = spark.createDataFrame([(bytearray(make_pdf(["EMITENTE", "Alfa Beta"])),)], "content binary")
    kept, dropped = (pipeline.process(documents.dispatch(None, memory), strict=x).first() for x in (False, True))
    assert (kept.status, dropped.status) == ("error", "error") and kept.payload.issuer.name == "ALFA BETA" and dropped.payload is None
    assert [e.status for e in dropped.events] == ["SUCCESS"] * 4 and dropped.raw_metadata.page_count == 1


def test_incomplete_invoice(spark):
    r = pipeline.process_texts(spark.createDataFrame([("PRESTADOR DE SERVIÇO\nAlfa Beta\nCNPJ: 1",), ("",), (None,)], "text string")).collect()
    assert [x.status for x in r] == ["error"] * 3
    assert r[0].invoice.issuer.name == "ALFA BETA" and r[0].invoice.issuer.cnpj_cpf is None
    assert {i.code for i in r[0].validation_issues} == {"MISSING_ISSUER", "MISSING_RECIPIENT", "MISSING_TOTAL"}


def test_every_rule_and_score(spark):
    rows = [("11.444.777/0001-61", "x", "R$ 1,00", None), ("1", "x", "R$ 1,00", None), ("11.444.777/0001-61", None, "R$ 1,00", None), ("11.444.777/0001-61", "x", "R$ 1,234", "123"), ("11.444.777/0001-61", "x", None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string").select(trust.issues(*map(F.col, "abcd")).alias("i"))
    got = df.select(F.transform("i", lambda x: x["code"]).alias("codes"), F.round(trust.score(F.col("i")), 2).alias("s"), trust.status(F.col("i"), trust.score(F.col("i"))).alias("t")).collect()
    assert [(r.codes, r.s, r.t) for r in got] == [
        ([], 1.0, "success"),
        (["INVALID_ISSUER_CNPJ"], 0.0, "error"),
        (["MISSING_RECIPIENT"], 0.9, "partial"),
        (["INVALID_TOTAL_FORMAT", "INVALID_KEY"], 0.5, "partial"),
        (["MISSING_TOTAL"], 0.5, "error"),
        (["MISSING_ISSUER", "MISSING_RECIPIENT", "MISSING_TOTAL"], 0.0, "error"),
    ]


def make_pdf(lines, flate=True):
    body = b"BT /F1 12 Tf 72 700 Td " + b" T* ".join(b"(" + x.encode("cp1252").replace(b"(", rb"\(").replace(b")", rb"\)") + b") Tj" for x in lines) + b" ET"
    data = zlib.compress(body) if flate else body
    head = b"<< /Length %d %s>>" % (len(data), b"/Filter /FlateDecode " if flate else b"")
    return b"%PDF-1.4\n1 0 obj\n<< /Type /Pages /Count 1 >>\nendobj\n2 0 obj\n<< /Type /Page >>\nendobj\n3 0 obj\n" + head + b"\nstream\n" + data + b"\nendstream\nendobj\n%%EOF"


def test_pdf_pipeline_and_failures(spark, tmp_path):
    lines = [x.strip() for x in INVOICE.strip().splitlines() if x.strip()]
    (tmp_path / "a.pdf").write_bytes(make_pdf(lines))
    (tmp_path / "b.pdf").write_bytes(b"no pdf at all")
    memory = spark.createDataFrame([(bytearray(make_pdf(lines, flate=False)),)], "content binary")
    found = documents.dispatch(documents.pdf_files(spark, str(tmp_path)), memory)
    results = pipeline.process(found).cache()
    good = results.filter("status = 'success'").collect()
    assert len(good) == 2 and all(r.payload.issuer.cnpj_cpf == "11.444.777/0001-61" for r in good)
    assert all([e.stage for e in r.events] == list(audit.STAGES) and r.raw_metadata.page_count == 1 for r in good)
    (bad,) = results.filter("status = 'error'").collect()
    assert bad.payload is None and bad.trust_score == 0 and set(bad.raw_metadata) == {None}
    assert [(e.stage, e.status, e.error_policy) for e in bad.events] == [("READ", "FAILURE", "ABORT")]
    assert (bad.tenant_id, bad.trace_id) == ("unknown_tenant", "unknown_trace")
    assert pipeline.trail(results).count() == 9
    assert sorted((r.raw_metadata.input_type, r.payload.source_filename[-5:]) for r in good) == [("bytes", "emory"), ("file", "a.pdf")]
    told = [json.loads(e.details) for e in good[0].events]
    assert told[0]["page_count"] == 1 and told[0]["duration_sec"] >= 0 and told[0]["extraction_method"] == "embedded"
    assert 0 <= told[1]["reduction_ratio"] < 1 and len(told[1]["raw_text_hash_sha256"]) == 64
    assert told[2] == {"duration_sec": None, "items_count": 3, "issuer_found": True, "recipient_found": True, "total_value": "R$ 1.405,40"}
    assert told[3] == {"duration_sec": None, "trust_score": 1.0, "issues_count": 0, "critical_errors": False}
    assert json.loads(bad.events[0].details) == {"error": "not a PDF document"}
    for r in pipeline.envelopes(results).collect():
        e = json.loads(r.envelope)
        assert e["event_type"] == audit.EVENT_TYPE and e["data"]["metrics"]["total_duration_ms"] >= 0
        assert (e["data"]["payload"] == {}) == (e["status"] == "error")
        assert [x["stage"] for x in e["data"]["audit_trail"]][:1] == ["READ"] and isinstance(e["data"]["audit_trail"][0]["details"], dict)
        if e["status"] != "error":
            assert list(e["data"]["payload"]) == "emission_date competence_date chave_acesso issuer recipient items financials raw_text tenant_id source_filename".split()
            assert list(e["data"]["payload"]["issuer"]) == "name cnpj_cpf address municipal_insc email phone".split()
            assert list(e["data"]["payload"]["items"][0]) == "description quantity unit unit_value cfop raw".split()


@pytest.mark.parametrize("stage", audit.STAGES[1:])
def test_every_stage_can_abort(spark, stage):
    content = bytearray(make_pdf([x.strip() for x in INVOICE.strip().splitlines()]))
    memory = spark.createDataFrame([(content,)], "content binary")
    none = {"normalizer": lambda t: F.lit(None).cast("string"), "parser": lambda n, s: F.when(F.lit(False), extract.invoice(n, s)), "validator": lambda p: F.when(F.lit(False), trust.verdict(p))}
    name = {"NORMALIZE": "normalizer", "PARSE": "parser", "VALIDATE": "validator"}[stage]
    r = pipeline.process(documents.dispatch(None, memory), **{name: none[name]}).first()
    at = audit.STAGES.index(stage)
    assert [(e.stage, e.status, e.error_policy) for e in r.events] == [(s, "SUCCESS", "CONTINUE") for s in audit.STAGES[:at]] + [(stage, "FAILURE", "ABORT")]
    assert json.loads(r.events[-1].details) == {"error": f"{stage} gave no result"}
    assert (r.status, r.trust_score, r.payload, r.raw_metadata.input_type) == ("error", 0.0, None, "bytes")


def test_plan_needs_no_shuffle(spark):
    df = pipeline.process_texts(spark.createDataFrame([(INVOICE,)], "text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_payload_forms(spark, invoice):
    df = spark.createDataFrame([(INVOICE,)], "text string").select(extract.invoice(normalize.normalize_text(F.col("text"))).alias("i"))
    r = df.select(payloads.to_json(F.col("i")).alias("j"), payloads.from_json(payloads.to_json(F.col("i"))).alias("b"), payloads.erp(F.col("i")).alias("e"), payloads.analytics(F.col("i")).alias("a"), "i").first()
    assert r.b == r.i and json.loads(r.j)["issuer"]["cnpj_cpf"] == "11.444.777/0001-61"
    assert r.e.document_type == "NFS-e" and len(r.e.line_items) == 3 and r.e.supplier.tax_id == "11.444.777/0001-61"
    assert (r.a.items_count, r.a.has_key, r.a.event_type) == (3, False, "invoice_processed")


def test_csv_appends(spark, tmp_path):
    out = str(tmp_path / "csv")
    for i in range(2):
        payloads.append_csv(spark.createDataFrame([(i, "x")], "a int, b string"), out)
    assert spark.read.option("header", True).csv(out).count() == 2


def test_context(spark):
    rows = ['{"tenant_id": "t", "priority": null}', '{"tenant_id": "t", "trace_id": "", "execution_id": ""}', '{"tenant_id": "a-1"}', '{"tenant_id": "---"}', '{"tenant_id": "ab", "priority": "x"}', "{", "{}", None, '{"tenant_id": "çã_9", "pipeline": "custom", "trace_id": "t"}']
    got = spark.createDataFrame([(r,) for r in rows], "x string").select(documents.parse_context(F.col("x")).alias("c")).select(documents.with_ids(F.col("c")).alias("c")).collect()
    assert (got[0].c.valid, got[1].c.valid) == (False, True) and len(got[1].c.trace_id) == 36 and got[1].c.execution_id.startswith("t_")
    got = got[2:]
    assert [r.c.valid for r in got] == [True, False, False, False, False, False, True]
    assert got[0].c.execution_id.startswith("a-1_") and len(got[0].c.execution_id) == 16 and got[6].c.trace_id == "t"


def test_admission(spark):
    pdf_, other = bytearray(b"%PDF-1"), bytearray(b"x")
    rows = [("application/pdf", 5, pdf_), ("text/plain", 5, pdf_), (None, 5, pdf_), ("application/pdf", documents.MAX_UPLOAD + 1, other), ("application/pdf", 5, other), ("application/pdf", 0, None)]
    got = spark.createDataFrame(rows, "t string, n long, c binary").select(documents.admission(F.col("t"), F.col("n"), F.col("c")).alias("s")).collect()
    assert [r.s for r in got] == [202, 415, 415, 413, 422, 422]


def test_routes(spark):
    got = spark.createDataFrame([(5.0,), (10000.0,), (10000.01,), (None,)], "v double").select(trust.route_by_value(F.col("v")).alias("r")).collect()
    assert [r.r for r in got] == ["processamento_normal", "processamento_normal", "auditoria_fiscal", "revisao_manual"]


def test_text_files(spark, tmp_path):
    (tmp_path / "n.txt").write_text(INVOICE)
    assert documents.text_files(spark, str(tmp_path)).first().text == INVOICE


def test_stream_of_files(spark, tmp_path):
    from faturaflow.streaming import inbox

    box = tmp_path / "in"
    box.mkdir()
    (box / "a.pdf").write_bytes(make_pdf(["EMITENTE", "Alfa Beta"]))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for name in ("a.pdf", "b.pdf"):
        (box / name).write_bytes(make_pdf(["EMITENTE", "Alfa Beta"]))
        inbox.write(inbox.results(spark, str(box)), out, state).awaitTermination(120)
    assert spark.read.parquet(out).count() == 2


def test_bytes_are_scrubbed(spark):
    df = spark.createDataFrame([(bytearray("Competência: 01/2023".encode() + b"\xff\xc3"),)], "text binary")
    assert pipeline.parse_texts(df).first().invoice.competence_date == "01/2023"


def objects(*bodies, trailer=b"<< /Root 1 0 R >>"):
    made = b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, b) for i, b in enumerate(bodies, 1) if b)
    return b"%PDF-1.7\n" + made + b"trailer\n" + trailer + b"\n%%EOF"


def stream(data, head=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), head, data)


def test_pdf_follows_the_page_tree():
    """Pages in the tree's order, inherited fonts, several contents, two-byte codes by a ToUnicode map, differences."""
    cmap = b"1 beginbfchar <0003> <0041> endbfchar 2 beginbfrange <0010> <0012> <00E1> <0020> <0021> [<0066> <0066006C>] endbfrange"
    got = pdf.read_pdf(
        objects(
            b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 2 /Kids [4 0 R 3 0 R] /Resources << /Font << /A 7 0 R /B 9 0 R >> >> >>",
            b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R 10 0 R] >>",
            stream(b"BT /B 9 Tf (last \\(page\\) a) Tj ET"), stream(b"BT /A 9 Tf <00030010> Tj 0 -12 Td [<0011> -20 <00210012>] TJ ET"),
            b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 8 0 R >>", stream(zlib.compress(cmap), b"/Filter /FlateDecode"),
            b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [97 /ccedilla] >> >>", stream(b"BT /B 9 Tf (second) Tj T* (line) Tj ET"),
        )
    )
    assert got == ("A\u00e1\n\u00e2fl\u00e3\nsecond\nline\nl\u00e7st (p\u00e7ge) \u00e7".replace("l\u00e7st", "l\u00e7st"), 2)


def test_pdf_object_streams_and_encryption():
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>", b"<< /Type /Page /Contents 5 0 R >>"]
    offsets = [sum(len(x) + 1 for x in inner[:i]) for i in range(3)]
    head = b" ".join(b"%d %d" % (i, at) for i, at in enumerate(offsets, 1)) + b" "
    packed = zlib.compress(head + b" ".join(inner))
    body = objects(b"", b"", b"", stream(packed, b"/Type /ObjStm /N 3 /First %d /Filter /FlateDecode" % len(head)), stream(b"BT (packed) Tj ET"), trailer=b"")
    assert pdf.read_pdf(body) == ("packed", 1)
    with pytest.raises(ValueError, match="encrypted"):
        pdf.read_pdf(objects(b"<< /Type /Catalog >>", trailer=b"<< /Root 1 0 R /Encrypt 9 0 R >>"))
    with pytest.raises(ValueError, match="damaged"):
        pdf.read_pdf(objects(b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Kids [3 0 R] >>", b"<< /Contents 4 0 R >>", stream(b"no zlib", b"/Filter /FlateDecode")))


def test_pdf_strings():
    text, pages = pdf.read_pdf(make_pdf([r"a (b) c", "é€"]))
    assert (text, pages) == ("a (b) c\né€", 1)
    with pytest.raises(ValueError, match="not a PDF"):
        pdf.read_pdf(b"")


@pytest.fixture(scope="module")
def unlucky(spark, tmp_path_factory):
    """Sales tables of suppliers whose CNPJ, every digit moved on, is valid again, in orders of the bad-issuer case."""
    at = tmp_path_factory.mktemp("unlucky")
    keys = {5: 9918, 16: 9964, 27: 59941, 38: 1, 39: 9918}
    orders = [(k, 1, 1500.0) for k in keys]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").withColumn("o_orderdate", F.to_timestamp(F.lit("2001-02-03"))).write.parquet(f"{at}/orders.parquet")
    lines = [(k, s, 1, 700.0) for k, s in keys.items()]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def _as_sql(spark, at, name):
    """A query's rows and those of its SQL."""
    con = duckdb.connect()
    for table in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS FROM '{at}/{table}.parquet/*.parquet'")
    want = con.execute(queries.SQL[name]).fetchall()
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, at).collect()), sorted(want)


@pytest.mark.parametrize("name", ["pipeline_status", "route_by_confidence", "segment_blocks"])
def test_bad_issuers_are_bad_whatever_the_supplier(spark, unlucky, name):
    got, want = _as_sql(spark, unlucky, name)
    assert got == want
