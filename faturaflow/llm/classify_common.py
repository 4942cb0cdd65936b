"""What the two supervised scorers share: a bounded labelled sample and pass-through scoring."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faturaflow.llm.arrowtext import slices
from faturaflow.llm.common import bounded


#: Bytes of the texts that one fit may learn from.
BYTES = 64 << 20


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int, most: int = BYTES) -> list[tuple]:
    """(doc_id, text, label) of at most `bound` labelled documents and about `most` bytes, those with the smallest hashes of the id.

    `learn` tells from labels.doc_id which rows may be learnt from. Labels that are null, and
    ids with two different labels, are left out; a null text counts as the empty one; of rows
    that repeat an id the smallest text counts. Rows are reduced to one an id, and the bytes
    summed up, before anything reaches the driver: the first text is taken whatever its size.
    """
    own = labels.filter(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    own = own.groupBy("doc_id").agg(F.min(label).alias("__y"), F.max(label).alias("__z")).filter("__y = __z")
    first = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select("doc_id", F.col("__y").cast("int").alias("__y"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__t")).join(F.broadcast(first), "doc_id")
    rows = rows.groupBy("doc_id", "__y").agg(F.min("__t").alias("__t"))
    before = W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, -1)  # over `bound` rows at most
    rows = rows.withColumn("__b", F.coalesce(F.sum(F.octet_length("__t")).over(before), F.lit(0))).filter(F.col("__b") < most)
    return sorted((r["doc_id"], r["__t"], r["__y"]) for r in rows.select("doc_id", "__t", "__y").collect())


def scored(docs: DataFrame, text: str, fields: list[T.StructField], score, limit: int) -> DataFrame:
    """docs without columns of the new names, plus `fields` computed slice by slice by score(column of texts)."""
    names = [f.name for f in fields]
    kept = [c for c in docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + fields)

    bounded(docs.sparkSession)

    def run(batches):
        for batch in batches:
            whole, at = pa.Table.from_batches([batch]), 0
            for t in slices([whole], text, limit):
                out, at = whole.slice(at, t.num_rows), at + t.num_rows
                made = score(t[text])
                columns = [out[c].combine_chunks() for c in kept] + made
                columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(n, c.type) for n, c in zip([*kept, *names], columns, strict=True)]))

    return docs.select(*kept).mapInArrow(run, schema)
