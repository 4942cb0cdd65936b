"""Embedding near-duplicates by a pivot-permutation index.

Reference points, the pivots, are drawn from a bounded sample; their number grows with the root of the number
of vectors. A vector is described by its `prefix` nearest pivots in order of distance, after the sample's mean is taken
off, and an inverted list is kept for every pivot. A list's members are compared by what their descriptions share:
each shared pivot counts the product of its two rank weights, nearer ranks weighing more. Pairs
that share at least `least` are candidates. A pair that meets in several lists is looked at in that of its smallest shared pivot
only. The lists carry descriptions, no vectors: vectors are fetched for members with candidates and verified by cosine in
double precision. Lists longer than BLOCK members are split into blocks that are compared two by two, so no
task holds more than two blocks, and candidates are bit rows of members, not rows of pairs.

`tune` chooses prefix and least: it turns vectors of the sample away until their cosine is
the threshold, half in random directions and half towards other vectors, and takes the cheapest description under which
all but MISSED of these pairs, the hardest that count, are candidates. Recall against brute force is measured in the tests.

Equal vectors are one entry with a multiplicity, merged by an aggregate before any list is
made. A list gives each member's number of links and a spanning forest, not its pairs.

Bounds, all parameters: SAMPLE vectors to draw from, PROBES of them to tune with, MOST_PIVOTS pivots. Every row is indexed.

Defined cases: vectors that are null, empty, zero or hold null or non-finite parts link with nothing and form their
own class; vectors of different lengths never link; every row is a vector of its own, whether its id is null or repeats, and
a class is named by its smallest id, null where it has none; ids have any type with an order; ties in distance go to the
pivot drawn first; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faturaflow.llm.common import bounded, table, written
from faturaflow.llm.components import components

SAMPLE, PROBES, MOST_PIVOTS, BLOCK, THRESHOLD, MISSED = 8192, 768, 4096, 1024, 0.95, 0.004
PREFIXES = (6, 8, 12, 16, 24, 32, 48)


class Space(NamedTuple):
    """What describes vectors of one length: the mean that is taken off, unit pivots, prefix length and the least share of candidates."""

    mean: np.ndarray
    pivots: np.ndarray
    prefix: int
    least: float

    def describe(self, unit: np.ndarray) -> np.ndarray:
        """The nearest pivots of each unit vector, nearest first."""
        near = np.empty((len(unit), self.prefix), np.int16)
        for a in range(0, len(unit), 2048):
            cos = _unit(unit[a : a + 2048] - self.mean) @ self.pivots.T
            some = np.argpartition(-cos, min(self.prefix, cos.shape[1]) - 1, axis=1)[:, : self.prefix]
            some.sort(axis=1)
            near[a : a + 2048] = np.take_along_axis(some, np.argsort(-np.take_along_axis(cos, some, 1), axis=1, kind="stable"), 1)
        return near


def weights(prefix: int) -> np.ndarray:
    """The weight of each rank in a shared pivot's product."""
    return (1 - np.arange(prefix) / (2 * prefix)).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # the sum of squares stays finite
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def pivots_of(centred: np.ndarray, n: int, apart: float = 0.9) -> np.ndarray:
    """Up to n unit vectors of the sample that are not close to each other, filled up with seeded directions."""
    chosen, k = np.zeros((n, centred.shape[1])), 0
    for v in centred:
        if k < n and v.any() and not (k and (chosen[:k] @ v).max() > apart):
            chosen[k], k = v, k + 1
    chosen[k:] = _unit(np.random.default_rng(61).normal(size=(n - k, centred.shape[1])))
    return chosen


def shares(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """What the descriptions of a and b share, row by row of a against all of b."""
    w = weights(a.shape[1])
    x, y = np.zeros((len(a), n), np.float32), np.zeros((len(b), n), np.float32)
    np.put_along_axis(x, a.astype(np.int64), np.broadcast_to(w, a.shape), 1)
    np.put_along_axis(y, b.astype(np.int64), np.broadcast_to(w, b.shape), 1)
    return x @ y.T


def tune(sample: np.ndarray, rows: int, threshold: float, missed: float = MISSED) -> Space:
    """The space for `rows` vectors that resemble the unit vectors of the sample."""
    mean = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
    n = int(min(MOST_PIVOTS, max(64, 2 ** round(np.log2(8 * np.sqrt(max(1, rows)))))))
    # Vectors to tune with are no pivots: a pivot is its own nearest one.
    probes = min(PROBES, len(sample) // 2)
    pivots = pivots_of(_unit(sample[probes:] - mean), n)
    if not probes:
        return Space(mean, pivots, PREFIXES[0], 1e-6)
    rng = np.random.default_rng(62)
    own = sample[np.arange(PROBES) % probes]
    away = rng.normal(size=own.shape)
    away[::2] = sample[rng.integers(0, len(sample), len(away[::2]))]
    away -= (away * own).sum(1, keepdims=True) * own
    still = np.sqrt((away * away).sum(1)) < 1e-9
    away[still] = rng.normal(size=(int(still.sum()), own.shape[1]))
    away -= (away * own).sum(1, keepdims=True) * own
    turned = threshold * own + np.sqrt(1 - threshold**2) * _unit(away)
    best = None
    for prefix in [p for p in PREFIXES if p < n]:
        space = Space(mean, pivots, prefix, 0.0)
        a, b = space.describe(own), space.describe(turned)
        shared = np.concatenate([np.diag(shares(a[i : i + 256], b[i : i + 256], n)) for i in range(0, len(a), 256)])
        least = float(np.quantile(shared, missed, method="lower"))
        if least <= 0 and prefix != [p for p in PREFIXES if p < n][-1]:
            continue
        least = max(least, 1e-6) * (1 - 1e-5)
        others = shares(a[:256], space.describe(sample[:1024]), n)
        cost = prefix + 0.1 * rows * float((others >= least).mean()) + 0.002 * rows * float((others > 0).mean())
        if best is None or cost < best[0]:
            best = cost, Space(mean, pivots, prefix, least)
    return best[1]


def _matrix(column, dtype) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy().astype(dtype, copy=False).reshape(len(flat), -1)


def described(heads: DataFrame, spaces: dict[int, Space], n_rows: int, threshold: float) -> DataFrame:
    """(id, dim, prefix) of heads (id, x): the description of every vector."""
    shared = heads.sparkSession.sparkContext.broadcast(spaces)

    def run(batches):
        own = dict(shared.value)
        for batch in batches:
            dims = pc.list_value_length(batch["x"]).to_numpy(zero_copy_only=False)
            found: list = [None] * len(dims)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d not in own:  # no vector of the sample is so long
                    own[d] = tune(np.zeros((0, d)), n_rows, threshold)
                near = own[d].describe(_unit(_matrix(batch["x"].take(pa.array(at)), np.float64)))
                for i, row in zip(at.tolist(), near, strict=True):
                    found[i] = row
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(dims, pa.int32()), pa.array(found, pa.list_(pa.int16()))], ["id", "dim", "prefix"])

    bounded(heads.sparkSession)
    return heads.select("id", "x").mapInArrow(run, "id long, dim int, prefix array<short>")


def _candidates(rows: pa.Table, least: dict[int, float]) -> pa.Table:
    """The members of a list, or of two of its blocks, that share enough with another, and with which: a bit for each of these members."""
    side, own, dim = rows["side"].to_numpy(), rows["pivot"][0].as_py(), rows["dim"][0].as_py()
    prefix = _matrix(rows["prefix"], np.int64)
    known, place = np.unique(prefix, return_inverse=True)
    m = np.zeros((len(prefix), len(known)), np.float32)
    np.put_along_axis(m, place.reshape(prefix.shape), np.broadcast_to(weights(prefix.shape[1]), prefix.shape), 1)
    near = m @ m.T >= least.get(dim, 1e-6)
    if before := int(np.searchsorted(known, own)):
        near &= m[:, :before] @ m[:, :before].T == 0  # else the pair meets in the list of a smaller pivot
    if side.min() != side.max():
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    at = np.flatnonzero(near.any(1))
    bits = np.packbits(near[np.ix_(at, at)], axis=1)
    return pa.table(
        {
            "list": rows["list"].take(pa.array(at)).combine_chunks(),
            "id": rows["id"].take(pa.array(at)).combine_chunks(),
            "pos": pa.array(np.arange(len(at)), pa.int32()),
            "near": pa.array([b.tobytes() for b in bits], pa.binary()),
        }
    )


def _verified(rows: pa.Table, threshold: float) -> pa.Table:
    """Number of links of each member, w, beside itself, and a spanning forest of the links, with w 0."""
    order = np.argsort(rows["pos"].to_numpy())
    ids, times = rows["id"].to_numpy()[order], rows["times"].to_numpy()[order]
    x = _unit(_matrix(rows["x"].take(pa.array(order)), np.float64))
    bits = np.frombuffer(b"".join(rows["near"].take(pa.array(order)).to_pylist()), np.uint8).reshape(len(ids), -1)
    near = np.unpackbits(bits, axis=1, count=len(ids)).astype(bool)
    near &= x @ x.T >= threshold
    weight = (near @ times.astype(np.float64)).astype(np.int64) if near.any() else np.zeros(len(ids), np.int64)
    linked = np.flatnonzero(weight)
    out_a, out_b, out_w = [ids[linked]], [ids[linked]], [weight[linked]]
    open_ = near.any(1)
    while open_.any():
        start = int(np.argmax(open_))
        inside = np.zeros(len(ids), bool)
        inside[start] = True
        front = inside.copy()
        while front.any():
            front = near[front].any(0) & ~inside
            inside |= front
        open_ &= ~inside
        inside[start] = False
        out_a.append(ids[inside])
        out_b.append(np.full(int(inside.sum()), ids[start]))
        out_w.append(np.zeros(int(inside.sum()), np.int64))
    return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b), "w": np.concatenate(out_w)})


def spaces_of(heads: DataFrame, n_rows: int, threshold: float = THRESHOLD) -> dict[int, Space]:
    """The space of each vector length in a sample of heads (id, x), drawn by a hash of the vector."""
    drawn = [np.array(r["x"], np.float64) for r in heads.orderBy(F.xxhash64("x"), "id").limit(SAMPLE).select("x").collect()]
    return {d: tune(_unit(np.array([v for v in drawn if len(v) == d])), n_rows, threshold) for d in {len(v) for v in drawn}}


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id), a row each of vectors (vec_id, embedding)."""
    x = F.col("embedding")
    limit = F.lit(1.7976931348623157e308)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) <= limit)) & F.exists(x, lambda v: v != 0)
    rows = vectors.select("vec_id", x.alias("x"), F.when(F.coalesce(good, F.lit(False)), F.unhex(F.sha2(x.cast("string"), 256))).alias("h"))
    heads = rows.filter("h is not null").groupBy("h").agg(F.min("vec_id").alias("first"), F.count("*").alias("times"), F.min("x").alias("x"))
    heads = written(heads.withColumn("id", F.monotonically_increasing_id()), "heads", small=True)
    spaces = spaces_of(heads, heads.count(), threshold)
    n, least = heads.count(), {d: s.least for d, s in spaces.items()}
    index = written(described(heads, spaces, n, threshold), "index", small=True)
    posted = index.select("id", "dim", "prefix", F.explode("prefix").alias("pivot"))
    size = posted.groupBy("dim", "pivot").agg(F.count("*").alias("size")).filter("size > 1")
    posted = posted.join(F.broadcast(size) if len(spaces) * MOST_PIVOTS < 1 << 18 else size, ["dim", "pivot"])
    posted = posted.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    posted = posted.withColumn("side", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    posted = posted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    number = F.xxhash64("dim", "pivot", F.least("side", "other"), F.greatest("side", "other"))
    # Of one block alone, the members come once: where side and other are the same.
    posted = posted.select(number.alias("list"), "id", "dim", "pivot", "prefix", "side")
    found = posted.groupBy("list").applyInArrow(lambda rows: _candidates(rows, least), "list long, id long, pos int, near binary")
    found = written(found, "candidates")
    full = found.join(heads.select("id", "times", "x"), "id")
    links = written(full.groupBy("list").applyInArrow(lambda rows: _verified(rows, threshold), "a long, b long, w long"), "links", small=True)
    counts = links.filter("w > 0").groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("w"))
    group = components(links.filter("w = 0").select("a", "b")).withColumnRenamed("node", "id")
    own = heads.select("h", "id", "first", "times").join(counts, "id", "left").join(group, "id", "left")
    own = written(own.select("h", "first", (F.coalesce("w", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "classes", small=True)
    names = own.groupBy("component").agg(F.min("first").alias("component_id"))
    own = own.join(names, "component").select("h", "n_links", "component_id", F.lit(True).alias("good"))
    done = rows.select("vec_id", "h").join(own, "h", "left")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the links and class of every vector of `embeddings`."""
    done = near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def sql() -> str:
    """The digest in DuckDB's SQL, from all pairs."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
g AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS p, b.vec_id AS q FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
c AS (SELECT DISTINCT p AS node, p AS root FROM e UNION SELECT e.q, c.root FROM c JOIN e ON e.p = c.node),
r AS (SELECT node, min(root) AS root FROM c GROUP BY node),
n AS (SELECT p, count(*) AS n FROM e GROUP BY p)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON n.p = vec_id LEFT JOIN r ON r.node = vec_id"""
