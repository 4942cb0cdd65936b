"""Substring deduplication by fixed-block anchors.

A word is removed where it lies in a window of WINDOW consecutive words of one document whose
sequence also starts anywhere else. Any such window holds a whole block of BLOCK = (WINDOW + 1) // 2
words at a multiple of BLOCK in either place. So the index has the non-overlapping blocks of
every document, and every rolling window of BLOCK words probes it; a block met in two places
is an anchor. From the anchors the repeats are extended: all windows of WINDOW words around an
anchor are compared, corpus-wide, by their own hash, and the union of those found twice is
the maximal exact repeat. Both comparisons send a distinct key once from each batch of
documents (see scatter), so a passage in a third of all documents forms no hot group and no
pairs are made. Anchors compare 32 bits beside the bucket's, which can only add candidates;
windows compare 64 bits of an independent hash of all their words.

Defined cases: a null text has no words and becomes the empty text; shorter texts than a window
keep all words; very long texts are whole, as batches of their own; words are compared as they are, with case and marks, and
damaged UTF-8 byte by byte, though what is kept of it has replacement marks; rows with equal ids, null ids and repeated rows
are documents of their own; there are no ties, for a window met twice goes wherever it is; extra columns are passed through, and n_words and n_removed
replace input columns of these names; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faturaflow.llm import scatter as S
from faturaflow.llm.arrowtext import Hasher, U, Words, crossing, filled, runs
from faturaflow.llm.common import table

WINDOW = 35
_ANCHOR, _WHOLE = Hasher(31), Hasher(32)


class _Batch:
    """The windows of the documents of one batch and what is known of them."""

    def __init__(self, docs: pa.Table, text: str, window: int, bits: int):
        self.words = Words(docs[text], lower=False)
        self.window, self.bits, self.block = window, bits, (window + 1) // 2
        self.n = len(self.words.starts)
        h = self.words.hashes(_ANCHOR)
        self.at = np.flatnonzero(crossing(self.words.first, self.n, self.block))
        self.keys = _ANCHOR.windows(h, self.block)[self.at] >> U(32 - bits)
        owner = np.repeat(self.words.first[:-1], self.words.count)
        self.in_index = (self.at - owner[self.at]) % self.block == 0

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, sorted, and their flags: 1 found twice here, 2 in the index."""
        values = np.sort(self.keys << U(1) | self.in_index.astype(U))
        keys = values >> U(1)
        first = runs(keys)
        times = np.diff(np.append(first, len(keys)))
        return keys[first], ((times > 1) + 2 * (values[first + times - 1] & U(1)).astype(np.int64)).astype(np.uint8)

    def candidates(self, replies: pa.Table) -> None:
        """The windows around anchors: their starts and keys."""
        hits = found(self.anchors()[0], self.bits, S.answered(replies, 1), 32)
        hit = np.zeros(self.n + 1, np.int64)
        hit[1:][self.at[isin(self.keys, hits)]] = 1
        total = np.cumsum(hit)
        ok = crossing(self.words.first, self.n, self.window)
        reach = self.window - self.block + 1
        self.near = np.flatnonzero(ok & (total[reach : reach + len(ok)] > total[: len(ok)])) if len(ok) else np.zeros(0, np.int64)
        self.whole = _WHOLE.windows(self.words.hashes(_WHOLE), self.window)[self.near] if len(self.near) else np.zeros(0, U)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.sort(self.whole)
        first = runs(keys)
        return keys[first], (np.diff(np.append(first, len(keys))) > 1).astype(np.uint8)

    def removed(self, replies: pa.Table) -> np.ndarray:
        """True for each word that a repeated window covers."""
        again = found(self.distinct()[0], self.bits, S.answered(replies, 2), 64 - self.bits)
        starts = self.near[isin(self.whole, again)]
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.window, -1)
        return np.cumsum(edge)[: self.n] > 0


def isin(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def found(keys: np.ndarray, bits: int, by_bucket: dict[int, bytes], below: int) -> np.ndarray:
    """The keys of a sorted distinct list that the buckets' bit lists mark."""
    if not by_bucket or not len(keys):
        return keys[:0]
    marks = [keys[a:b][np.unpackbits(np.frombuffer(by_bucket[k], np.uint8), count=b - a).astype(bool)] for k, a, b in S.by_bucket(buckets(keys, bits, below)) if k in by_bucket]
    return np.concatenate(marks) if marks else keys[:0]


def buckets(keys: np.ndarray, bits: int, below: int) -> np.ndarray:
    return (keys >> U(below)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _rows(keys: np.ndarray, flags: np.ndarray, bits: int, below: int, dtype) -> list[tuple[int, int, bytes]]:
    low = (keys & U((1 << below) - 1 if bits or below < 64 else 0xFFFFFFFFFFFFFFFF)).astype(dtype)
    return [(k, b - a, S.planes(low[a:b]) + flags[a:b].tobytes()) for k, a, b in S.by_bucket(buckets(keys, bits, below))]


def _answer(dtype, kind: int, indexed: bool):
    """Bucket function: marks the keys met twice in the corpus and, if asked, in the index."""

    def answer(bucket: int, rows: pa.Table) -> pa.Table:
        n = rows["n"].to_numpy()
        data = rows["data"].to_pylist()
        size = np.dtype(dtype).itemsize
        keys = np.concatenate([S.unplanes(d, dtype, k) for d, k in zip(data, n, strict=True)])
        flags = np.concatenate([np.frombuffer(d, np.uint8, k, size * k) for d, k in zip(data, n, strict=True)])
        order = np.argsort(keys)
        keys, flags = keys[order], flags[order]
        first = runs(keys)
        times = np.diff(np.append(first, len(keys)))
        flag = np.bitwise_or.reduceat(flags, first)
        good = (times > 1) | (flag & 1 > 0)
        if indexed:
            good &= flag & 2 > 0
        mark = np.zeros(len(keys), bool)
        mark[order] = np.repeat(good, times)
        ends = np.cumsum(n)
        batch = rows["batch"].to_pylist()
        return S.answers([(batch[i], bucket, kind, np.packbits(m).tobytes()) for i in range(len(n)) if (m := mark[ends[i] - n[i] : ends[i]]).any()])

    return answer


def dedup(docs: DataFrame, window: int = WINDOW, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """docs with the text's kept words, joined by one space, and n_words, n_removed (long)."""
    docs = docs.drop("n_words", "n_removed")
    plan = S.plan_for(docs, text)
    bits = plan.bits
    batches = S.packed(docs, plan, text, ident)

    def send_blocks(batch: int, t: pa.Table) -> pa.Table:
        b = _Batch(t, text, window, bits)
        return S.sent(batch, _rows(*b.anchors(), bits, 32, np.uint32))

    def send_windows(batch: int, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not replies.num_rows:
            return S.sent(batch, [])
        b = _Batch(t, text, window, bits)
        b.candidates(replies)
        return S.sent(batch, _rows(*b.distinct(), bits, 64 - bits, np.uint64))

    def clean(batch: int, t: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Batch(t, text, window, bits)
        gone = np.zeros(b.n, bool)
        if replies.num_rows:
            b.candidates(replies)
            gone = b.removed(replies)
        total = np.concatenate([[0], np.cumsum(gone)])
        first = b.words.first
        n_removed = total[first[1:]] - total[first[:-1]]
        kept = []
        for i, whole in enumerate(filled(t[text]).to_pylist()):
            words = whole.split()
            if n_removed[i]:
                words = compress(words, ~gone[first[i] : first[i + 1]])
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        at = t.schema.get_field_index(text)
        t = t.set_column(at, text, pa.array(kept, pa.string()))
        return t.append_column("n_words", pa.array(b.words.count, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64()))

    blocks = S.reduce_buckets(S.scatter(batches, send_blocks), _answer(np.uint32, 1, True))
    windows = S.reduce_buckets(S.gather(batches, blocks, send_windows, S.SENT), _answer(np.uint64, 2, False))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return S.gather(batches, blocks.unionAll(windows), clean, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the digest of `documents`."""
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def sql() -> str:
    """The digest in DuckDB's SQL, from all windows of all documents."""
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x{{20}}\x{{9}}-\x{{D}}]+') AS ws FROM documents),
w AS (SELECT r, unnest(range(1, len(ws) - {WINDOW - 2})) AS p, ws FROM d WHERE len(ws) >= {WINDOW}),
h AS (SELECT r, p, sha256(array_to_string(list_slice(ws, p, p + {WINDOW - 1}), ' ')) AS g FROM w),
t AS (SELECT r, p FROM h QUALIFY count(*) OVER (PARTITION BY g) > 1),
c AS (SELECT DISTINCT r, p + k AS p FROM t, (SELECT unnest(range(0, {WINDOW})) AS k)),
u AS (SELECT r, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
k AS (SELECT u.r, count(c.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY u.p) FILTER (c.p IS NULL), '') AS kept
      FROM u LEFT JOIN c ON u.r = c.r AND u.p = c.p GROUP BY u.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""
