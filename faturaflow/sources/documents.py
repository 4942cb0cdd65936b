"""Where documents come from: file scans, ready texts, uploads with their context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UPLOAD = 10 * 1024 * 1024
CONTEXT = "tenant_id string, trace_id string, execution_id string, pipeline string, dry_run boolean, priority string, source string, _corrupt string"
#: Fixed values of a context's choices.
PIPELINES, PRIORITIES = ("enterprise", "custom"), ("low", "normal", "high")


def pdf_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length, content) of PDF files under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_filename, text) of already extracted texts, one a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_filename"), F.col("value").alias("text"))


def dispatch(files: DataFrame | None, memory: DataFrame | None) -> DataFrame:
    """One input (source, input_type, content) from scanned files and from content already in memory."""
    parts = []
    if files is not None:
        parts.append(files.select(F.col("path").alias("source"), F.lit("file").alias("input_type"), "content"))
    if memory is not None:
        parts.append(memory.select(F.lit("memory").alias("source"), F.lit("bytes").alias("input_type"), "content"))
    if not parts:
        raise ValueError("no input")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def admission(content_type: Column, size: Column, content: Column, limit: int = MAX_UPLOAD) -> Column:
    """HTTP status of an upload: 415 type, 413 size, 422 no PDF signature, else 202; the first that holds."""
    return (
        F.when(F.coalesce(content_type, F.lit("")) != "application/pdf", 415)
        .when(size > limit, 413)
        .when(~F.coalesce(F.startswith(content, F.lit(b"%PDF")), F.lit(False)), 422)
        .otherwise(202)
    )


def parse_context(text: Column) -> Column:
    """The context struct of a JSON text, with `valid`: a tenant of 1 to 100 letters or digits, - and _, and known choices.

    A choice that is left out has its default; one that is null in so many words is refused.
    """
    c = F.from_json(text, CONTEXT, {"columnNameOfCorruptRecord": "_corrupt"})
    tenant = c["tenant_id"]
    named = tenant.rlike(r"^[\p{L}\p{N}_-]*[\p{L}\p{N}][\p{L}\p{N}_-]*$") & (F.length(tenant) <= 100)
    keys = F.json_object_keys(text)
    refused = reduce(lambda a, b: a | b, [F.array_contains(keys, n) & c[n].isNull() for n in ("pipeline", "dry_run", "priority")])
    pipeline, priority = F.coalesce(c["pipeline"], F.lit("enterprise")), F.coalesce(c["priority"], F.lit("normal"))
    valid = F.coalesce(named & ~refused & pipeline.isin(*PIPELINES) & priority.isin(*PRIORITIES) & c["_corrupt"].isNull(), F.lit(False))
    return F.struct(
        tenant.alias("tenant_id"), c["trace_id"].alias("trace_id"), c["execution_id"].alias("execution_id"), pipeline.alias("pipeline"),
        F.coalesce(c["dry_run"], F.lit(False)).alias("dry_run"), priority.alias("priority"), c["source"].alias("source"), valid.alias("valid"),
    )


def with_ids(context: Column) -> Column:
    """The context with a trace id and an execution id where it has none or an empty one."""
    made = F.concat_ws("_", context["tenant_id"], F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))
    return context.withField("trace_id", F.coalesce(F.nullif(context["trace_id"], F.lit("")), F.uuid())).withField("execution_id", F.coalesce(F.nullif(context["execution_id"], F.lit("")), made))
