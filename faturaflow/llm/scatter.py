"""Corpus-wide lookups by key without a row for each occurrence.

Documents are dealt into batches by a hash of their id and text; a batch keeps its texts packed and
compressed, so the shuffle that forms the batches moves less than the table. A batch sends each
of its distinct keys once, sorted, in one row for each bucket of the key space (`scatter`); a bucket
merges what all batches sent and answers each batch in the order of its own list (`reduce`);
a batch reads its texts again beside the answers (`gather`). However often a key occurs, a
bucket sees it once from each batch: a hot key costs no more than any other. Batches and buckets
have a size, so their number grows with the corpus and the memory of a task does not.

Everything is one lazy plan over deterministic functions of the rows: a lost executor's part is
computed again from the tables, and Spark reuses the exchange of the batches between passes.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from faturaflow.llm.arrowtext import release, runs, slices, spans
from faturaflow.llm.common import bounded, free

BATCH_BYTES, BUCKET_KEYS = 3 << 20, 1 << 19
SENT = "bucket int, batch int, n int, data binary"
ANSWER = "batch int, bucket int, kind int, data binary"


class Plan(NamedTuple):
    batches: int
    #: The number of buckets is 2 ** bits.
    bits: int


def plan_for(docs: DataFrame, text: str = "text", batch_bytes: int = BATCH_BYTES, bucket_keys: int = BUCKET_KEYS) -> Plan:
    """Sizes from the bytes of all texts, counted by one aggregate; a word has some six bytes."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    return Plan(max(1, math.ceil(total / batch_bytes)), max(0, math.ceil(math.log2(max(1, total / 6 / bucket_keys)))))


def batch_of(column, plan: Plan):
    """The batch of a row with this key."""
    return F.pmod(F.xxhash64(column), F.lit(plan.batches)).cast("int")


def key_of(ident: str = "doc_id", text: str = "text"):
    """What deals rows out: copies under different ids part, and so do texts without ids."""
    return F.xxhash64(ident, text)


def packed(docs: DataFrame, plan: Plan, text: str = "text", ident: str = "doc_id", names: list[str] | None = None) -> DataFrame:
    """(batch, blob): the columns `names`, or all, of docs, packed by batch and dealt out by it."""
    names = names or docs.columns
    (own_batch,) = free(docs, "__batch")
    bounded(docs.sparkSession)

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            whole, at = pa.Table.from_batches([batch]), 0
            for part in slices([whole], text, 8 << 20):
                t = whole.slice(at, part.num_rows).combine_chunks()
                at += part.num_rows
                own = t[own_batch].to_numpy()
                order = np.argsort(own, kind="stable")
                begins = runs(own[order])
                t = t.drop_columns([own_batch]).take(pa.array(order))
                blobs = []
                for a, b in zip(begins, [*begins[1:], len(own)], strict=True):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, t.schema) as out:
                        out.write_table(t.slice(a, b - a).combine_chunks())
                    blobs.append(press.compress(sink.getvalue()))
                yield pa.RecordBatch.from_arrays([pa.array(own[order][begins], pa.int32()), pa.array(blobs, pa.binary())], ["batch", "blob"])
                release()

    rows = docs.select(*names, batch_of(key_of(ident, text), plan).alias(own_batch))
    return rows.mapInArrow(pack, "batch int, blob binary").repartition("batch")


def unpacked(group: pa.Table) -> pa.Table:
    """The documents of one batch."""
    read = zstandard.ZstdDecompressor()
    parts = [pa.ipc.open_stream(read.decompress(b)).read_all() for b in group["blob"].to_pylist()]
    return pa.concat_tables(parts).combine_chunks()


def planes(values: np.ndarray) -> bytes:
    """Fixed-width values byte plane by byte plane: the high bytes of sorted values compress to little."""
    return values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def unplanes(data: bytes, dtype, n: int, at: int = 0) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(raw.T).view(dtype).reshape(n)


def by_bucket(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted buckets."""
    return [(int(buckets[a]), a, b) for a, b in spans(buckets)]


def sent(batch: int, rows: list[tuple[int, int, bytes]]) -> pa.Table:
    """Rows (bucket, n, data) of a batch."""
    return pa.table(
        {
            "bucket": pa.array([r[0] for r in rows], pa.int32()),
            "batch": pa.array([batch] * len(rows), pa.int32()),
            "n": pa.array([r[1] for r in rows], pa.int32()),
            "data": pa.array([r[2] for r in rows], pa.binary()),
        }
    )


def answers(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    """Rows (batch, bucket, kind, data)."""
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate((("batch", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())))})


def answered(table: pa.Table, kind: int) -> dict[int, bytes]:
    """Answers of one kind by bucket."""
    return {b: d for b, k, d in zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["data"].to_pylist(), strict=True) if k == kind}


def trimmed(out: pa.Table) -> pa.Table:
    """out, once what its making has freed is back with the system: a worker that waits, or sends, holds no more than its result."""
    release()
    return out


def scatter(batches: DataFrame, send) -> DataFrame:
    """send(batch number, documents) to rows of SENT."""

    def run(key, group):
        return trimmed(send(key[0].as_py(), unpacked(group)))

    return batches.groupBy("batch").applyInArrow(run, SENT)


def reduce_buckets(rows: DataFrame, answer, schema: str = ANSWER) -> DataFrame:
    """answer(bucket number, rows of SENT) to rows of `schema`."""

    def run(key, group):
        return trimmed(answer(key[0].as_py(), group))

    return rows.groupBy("bucket").applyInArrow(run, schema)


def gather(batches: DataFrame, replies: DataFrame, take, schema) -> DataFrame:
    """take(batch number, documents, answers) to rows of `schema`, for every batch that has documents."""

    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    def run(key, left, right):
        if left.num_rows:
            return trimmed(take(key[0].as_py(), unpacked(left), right))
        return to_arrow_schema(kind).empty_table()

    return batches.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(run, kind)
