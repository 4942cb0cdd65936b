"""READ, NORMALIZE, PARSE, VALIDATE as one narrow plan: a row in, a row out, no shuffle.

Every stage is a projection of native expressions; only READ of PDF content runs Python, batch
by batch. A document that cannot be read keeps its row: status error, score 0, null payload
and a trail that ends in the failure. The normalised text and its sections are columns of their
own: fields of the record that nothing uses are pruned, and what several use is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faturaflow.functions.rx import bind
from faturaflow.operators import audit, extract, normalize, segment, trust
from faturaflow.sources.pdf import Extractor, extract_text, read_pdf


def parse_texts(docs: DataFrame, text: str = "text", source: Column | None = None, strict: bool = False) -> DataFrame:
    """docs with invoice, the record of the normalised text; all its fields are null or empty for a null text.

    A binary column is read as UTF-8, without what is none.
    """
    if docs.schema[text].dataType == T.BinaryType():
        docs = docs.withColumn(text, segment.scrub_utf8(F.col(text)))
    normalize.require_text(docs, text)
    cut = docs.withColumn("__n", normalize.normalize_text(F.col(text))).withColumn("__b", segment.blocks(F.col("__n")))
    return cut.withColumn("invoice", extract.record(F.col("__n"), F.col("__b"), source, strict)).drop("__n", "__b")


def validate(docs: DataFrame) -> DataFrame:
    """docs with validation_issues, trust_score (two places) and status of their invoice."""
    v = trust.verdict(F.col("invoice"))
    return docs.withColumn("__v", v).withColumns(
        {
            "validation_issues": F.col("__v.issues"),
            "trust_score": F.round("__v.score", 2),
            "status": F.col("__v.status"),
        }
    ).drop("__v")


def process_texts(docs: DataFrame, text: str = "text", strict: bool = False) -> DataFrame:
    """Texts straight to validated records."""
    return validate(parse_texts(docs, text, strict=strict))


def process(
    docs: DataFrame, extractor: Extractor = read_pdf, normalizer=normalize.normalize_text, parser=extract.invoice, validator=trust.verdict, strict: bool = False
) -> DataFrame:
    """Documents (source, input_type, content and, if given, trace_id, execution_id, tenant_id) to results.

    A result has the ids, start_time, end_time, status, trust_score, validation_issues, events, payload
    and raw_metadata, whose fields are all null where reading failed. Stages are column functions: normalizer(text), parser(text, source)
    and validator(payload). One that gives null for a document aborts it at that stage: the trail ends there with a failure, the
    status is error and there is no payload. READ's duration is its own; the other stages run as one generated projection, in which a
    row has no durations: theirs are null. A payload is kept where validation finds errors; `strict` drops it.
    """
    named = docs.withColumns({n: audit.context(n, F.col(n) if n in docs.columns else F.lit(None).cast("string")) for n in audit.UNKNOWN})
    read = extract_text(named.withColumn("start_time", F.localtimestamp()), extractor)
    normal = read.withColumn("normalized", F.when(F.col("read_error").isNull(), normalizer(F.col("text"))))
    parsed = normal.withColumn("__p", bind(F.col("normalized"), lambda n: F.when(n.isNotNull(), parser(n, F.col("source")))))
    judged = parsed.withColumn("__v", F.when(F.col("__p").isNotNull(), validator(F.col("__p"))))
    payload, verdict, none = F.col("__p"), F.col("__v"), F.lit(None).cast("double")
    details = {
        "READ": audit.stage_details(duration_sec=F.round("read_sec", 4), page_count=F.col("page_count"), extraction_method=F.col("extration_method"), input_source=F.col("source")),
        "NORMALIZE": audit.stage_details(
            duration_sec=none, raw_text_hash_sha256=audit.content_hash(F.col("text")), normalized_text_hash_sha256=audit.content_hash(F.col("normalized")),
            reduction_ratio=audit.reduction_ratio(F.col("text"), F.col("normalized")),
        ),
        "PARSE": audit.stage_details(
            duration_sec=none, items_count=F.size(payload["items"]), issuer_found=payload["issuer"].isNotNull(), recipient_found=payload["recipient"].isNotNull(),
            total_value=payload["financials"]["total"],
        ),
        "VALIDATE": audit.stage_details(
            duration_sec=none, trust_score=verdict["score"], issues_count=F.size(verdict["issues"]), critical_errors=F.exists(verdict["issues"], lambda x: x["severity"] == "error"),
        ),
    }
    reached = {"READ": F.col("read_error").isNull(), "NORMALIZE": F.col("normalized").isNotNull(), "PARSE": payload.isNotNull(), "VALIDATE": verdict.isNotNull()}
    failed = F.lit(None).cast("string")
    for stage in reversed(audit.STAGES):
        failed = F.when(~reached[stage], stage).otherwise(failed)
    error = F.coalesce(F.col("read_error"), F.concat(failed, F.lit(" gave no result")))
    trail = audit.events(failed, error, details, F.localtimestamp())
    known, ok = audit.metadata(F.col("content"), F.col("text"), F.col("page_count"), F.col("input_type")), verdict.isNotNull() & (F.lit(not strict) | (verdict["status"] != "error"))
    fields = ("input_hash_sha256", "input_type", "file_size_bytes", "page_count", "encoding_detected")
    return judged.withColumn("__m", known).select(
        "trace_id", "execution_id", "tenant_id", "start_time", F.localtimestamp().alias("end_time"),
        F.coalesce(verdict["status"], F.lit("error")).alias("status"),
        F.coalesce(F.round(verdict["score"], 2), F.lit(0.0)).alias("trust_score"),
        F.coalesce(verdict["issues"], F.array().cast("array<struct<code:string,field:string,message:string,severity:string>>")).alias("validation_issues"),
        trail.alias("events"), F.when(ok, payload).alias("payload"),
        F.struct(*[F.when(reached["READ"], F.col(f"__m.{n}")).alias(n) for n in fields]).alias("raw_metadata"),
    )


def trail(results: DataFrame) -> DataFrame:
    """One row an event of results: execution_id, event_index and the event's fields, in order.

    Every result has an event. The outer form keeps Spark from testing that by a filter, into which all stages would be copied.
    """
    return results.select("execution_id", "trust_score", F.posexplode_outer("events").alias("event_index", "event")).select("execution_id", "event_index", "trust_score", "event.*")


def envelopes(results: DataFrame) -> DataFrame:
    """(execution_id, envelope): each result under the event contract."""
    names = ("execution_id", "tenant_id", "status", "start_time", "end_time", "payload", "events")
    return results.select("execution_id", audit.envelope({n: F.col(n) for n in names}).alias("envelope"))
