"""Audit: hashes, metadata, stage events and the event envelope, all per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAGES = ("READ", "NORMALIZE", "PARSE", "VALIDATE")
EVENT_TYPE = "fiscal.extraction.completed"
#: Fixed values of a context that leaves ids out.
UNKNOWN = {"trace_id": "unknown_trace", "execution_id": "unknown_exec", "tenant_id": "unknown_tenant"}


def content_hash(content: Column) -> Column:
    """SHA-256, in lower-case hex, of bytes or of a text's UTF-8."""
    return F.sha2(content, 256)


def reduction_ratio(raw: Column, normal: Column) -> Column:
    """The share of characters that normalisation removed, rounded to two places; 0 for an empty text."""
    return F.when(F.length(raw) > 0, F.round(1 - F.length(normal) / F.length(raw), 2)).otherwise(F.lit(0.0))


def has_unicode_blanks(text: Column) -> Column:
    """Whether a no-break space or a zero-width character stands in the text."""
    return text.rlike(r"[\x{A0}\x{200B}-\x{200D}]")


def encoding(text: Column) -> Column:
    return F.when(F.is_valid_utf8(text), "utf-8").otherwise("unknown")


def metadata(content: Column, text: Column, pages: Column, kind: Column) -> Column:
    """Raw metadata of a document; file_size_bytes is the UTF-8 length of its text, kind is file or bytes."""
    return F.struct(
        content_hash(content).alias("input_hash_sha256"),
        kind.alias("input_type"),
        F.octet_length(text).cast("long").alias("file_size_bytes"),
        pages.alias("page_count"),
        encoding(text).alias("encoding_detected"),
    )


def context(name: str, given: Column) -> Column:
    return F.coalesce(given, F.lit(UNKNOWN[name]))


def stage_details(**fields: Column) -> Column:
    """The details of a stage's event as a JSON object: numbers, booleans and nulls stay what they are."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]), {"ignoreNullFields": "false"})


def events(failed: Column, error: Column, details: dict[str, Column], at: Column) -> Column:
    """The audit trail: a success event for each stage before the failed one, then one failure event; details are JSON objects.

    `failed` names the stage that failed, null where none did; later stages leave no event.
    """
    made = []
    order = F.create_map(*[x for i, s in enumerate(STAGES) for x in (F.lit(s), F.lit(i))])
    stop = F.coalesce(F.try_element_at(order, failed), F.lit(len(STAGES)))
    for i, stage in enumerate(STAGES):
        ok = F.struct(at.alias("timestamp"), F.lit(stage).alias("stage"), F.lit("SUCCESS").alias("status"), details[stage].alias("details"), F.lit("CONTINUE").alias("error_policy"))
        bad = F.struct(at.alias("timestamp"), F.lit(stage).alias("stage"), F.lit("FAILURE").alias("status"), stage_details(error=error).alias("details"), F.lit("ABORT").alias("error_policy"))
        made.append(F.when(stop > i, ok).when(stop == i, bad))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def event_json(event: Column) -> Column:
    """An event as JSON, its details as the object that they are."""
    rest = F.to_json(F.struct(*[event[n].alias(n) for n in ("timestamp", "stage", "status", "error_policy")]), {"ignoreNullFields": "false"})
    return F.concat(F.rtrim(rest, F.lit("}")), F.lit(',"details":'), F.coalesce(event["details"], F.lit("{}")), F.lit("}"))


def envelope(result: dict[str, Column]) -> Column:
    """The event contract of a result as JSON: a null payload is {}, the duration is null without an end."""
    ms = (F.unix_micros(result["end_time"].cast("timestamp")) - F.unix_micros(result["start_time"].cast("timestamp"))) / 1000
    payload = F.coalesce(F.to_json(result["payload"], {"ignoreNullFields": "false"}), F.lit("{}"))
    head = F.to_json(
        F.struct(
            result["execution_id"].alias("event_id"),
            F.lit(EVENT_TYPE).alias("event_type"),
            F.date_format(F.coalesce(result["end_time"], F.localtimestamp()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
            result["tenant_id"].alias("tenant_id"),
            result["status"].alias("status"),
        ),
        {"ignoreNullFields": "false"},
    )
    data = F.concat(
        F.lit('{"payload":'), payload,
        F.lit(',"audit_trail":['), F.coalesce(F.array_join(F.transform(result["events"], event_json), ","), F.lit("")), F.lit("]"),
        F.lit(',"metrics":{"total_duration_ms":'), F.coalesce(ms.cast("string"), F.lit("null")), F.lit("}}"),
    )
    return F.concat(F.rtrim(head, F.lit("}")), F.lit(',"data":'), data, F.lit("}"))
