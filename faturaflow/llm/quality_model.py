"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

score = sigmoid(b + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j). The pairs are summed in
linear time as half of sum over factors of (sum v x)^2 - sum (v x)^2. Features of a text are
its words hashed to 2**BITS slots (count over root of the sum of squares), the structure
statistics cut into steps, and the length; labels, lang, source and doc_id are never used.

Learning takes at most BOUND labelled rows, those with the smallest hashes of the id, on the
driver, in fixed order with a fixed seed; scoring takes whole texts, in slices of LIMIT bytes.

Defined cases: null and blank texts have the structure features of an empty text and a score
as any other; very long texts are slices of their own; there are no ties, for a score is of its own text alone; an empty table gives
an empty result; without labelled rows, or with one class only, the score is the smoothed share
of that class; extra columns are passed through, input columns named score are replaced;
repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faturaflow.llm.arrowtext import Hasher, U, Words, by_two, ragged, slices
from faturaflow.llm.classify_common import labelled, scored
from faturaflow.llm.common import crc_mod, table

BITS, FACTORS, BOUND, EPOCHS, LIMIT = 15, 8, 4000, 6, 4 << 20
STEPS = 12
_HASH = Hasher(11)
_CLASS = np.zeros(256, np.uint8)  # 1 upper case, 2 digit, 3 symbol, 4 other punctuation
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in "#*$%&|<>{}[]\\^~_=+@/"]] = 3
_CLASS[[ord(c) for c in ".,;:!?()'\"-"]] = 4
#: Edges of the steps, for shares of words or characters; fixed values.
_EDGES = np.array([0.001, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.85])


def _ratio(a, b):
    return a / np.maximum(b, 1)


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: slots and values one text after another, and where each text begins."""
    raw = Words(column, lower=False)
    n = len(raw.offsets) - 1
    count = raw.count
    size = np.diff(raw.offsets)
    owner = np.repeat(np.arange(n), count)
    kind = _CLASS[raw.data]
    per = np.stack([np.add.reduceat(np.append(kind == k, False).astype(np.int64), np.minimum(raw.offsets[:-1], len(kind))) * (size > 0) for k in (1, 2, 3, 4)])
    low = Words(column, lower=True)
    h = low.hashes(_HASH)
    # Words of a text by hash: distinct ones, their counts, and repeats of the word just before.
    order = by_two(owner, h)
    hs, ow = h[order], owner[order]
    first = runs_of(ow, hs)
    times = np.diff(np.append(first, len(hs)))
    who, what = ow[first], hs[first]
    distinct = np.bincount(who, minlength=n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    doubled = np.bincount(owner, same, n)
    newline = np.append(raw.data == 10, False).astype(np.int64)
    lines = np.add.reduceat(newline, np.minimum(raw.offsets[:-1], len(raw.data))) * (size > 0) + 1
    chars = np.bincount(owner, raw.ends - raw.starts, n)
    # Pairs of neighbouring words: how many of them are distinct shows loops of longer phrases.
    pair = h[:-1] * U(0x9E3779B97F4A7C15) + h[1:] if len(h) > 1 else np.zeros(0, U)
    inner = owner[1:] == owner[:-1]
    po, pv = owner[1:][inner], pair[inner]
    o2 = by_two(po, pv)
    d2 = np.bincount(po[o2][runs_of(po[o2], pv[o2])], minlength=n) if len(po) else np.zeros(n)
    stats = [
        _ratio(per[0], chars), _ratio(per[1], chars), _ratio(per[2], chars), _ratio(per[3], chars),
        _ratio(doubled, count), 1 - _ratio(distinct, count), np.where(count > 1, 1 - d2 / np.maximum(count - 1, 1), 0), _ratio(lines, count),
    ]
    steps = [np.searchsorted(_EDGES, s, "right") for s in stats]
    steps += [np.minimum(STEPS - 1, np.log2(1 + count).astype(int)), np.clip(_ratio(chars, count), 0, STEPS - 1).astype(int)]
    m = len(steps)
    slots = np.concatenate([(what % U(1 << BITS)).astype(np.int64), np.concatenate([(1 << BITS) + k * STEPS + s for k, s in enumerate(steps)])])
    norm = np.sqrt(np.bincount(who, times.astype(float) ** 2, n))
    values = np.concatenate([times / norm[who], np.full(m * n, 0.5)])
    rows = np.concatenate([who, np.tile(np.arange(n), m)])
    order = np.argsort(rows.astype(np.min_scalar_type(n)), kind="stable")
    begins = np.searchsorted(rows[order], np.arange(n + 1))
    return slots[order], values[order], begins


def runs_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal (a, b)."""
    if not len(a):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1])


N_SLOTS = (1 << BITS) + 10 * STEPS


class Machine:
    def __init__(self, factors: int = FACTORS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.b, self.w = 0.0, np.zeros(N_SLOTS)
        self.v = rng.normal(0, 0.01, (N_SLOTS, factors))

    def margin(self, slots, values, begins):
        n = len(begins) - 1
        row = np.repeat(np.arange(n), np.diff(begins))
        linear = np.bincount(row, self.w[slots] * values, n)
        pairs = np.zeros(n)
        for k in range(self.v.shape[1]):
            z = self.v[slots, k] * values
            pairs += np.bincount(row, z, n) ** 2 - np.bincount(row, z * z, n)
        return self.b + linear + pairs / 2

    def fit(self, slots, values, begins, y, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-5, seed: int = 7):
        """Adagrad over shuffled batches of rows."""
        n, rng = len(y), np.random.default_rng(seed)
        share = (y.sum() + 1) / (n + 2)
        self.b = float(np.log(share / (1 - share)))
        if not n or y.min() == y.max():
            return self
        gw, gv, sums = np.full(N_SLOTS, 1e-6), np.full(self.v.shape, 1e-6), np.diff(begins)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(n), max(1, n // 64)):
                at = ragged(begins[part], sums[part])
                s, x, row = slots[at], values[at], np.repeat(np.arange(len(part)), sums[part])
                own, slot = np.unique(s, return_inverse=True)
                v = self.v[s] * x[:, None]
                total = np.stack([np.bincount(row, v[:, k], len(part)) for k in range(v.shape[1])], 1)
                m = self.b + np.bincount(row, self.w[s] * x, len(part)) + ((total**2).sum(1) - np.bincount(row, (v * v).sum(1), len(part))) / 2
                g = 1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[part]
                self.b -= 0.1 * g.mean()
                gx = g[row] * x
                dw = np.bincount(slot, gx, len(own)) + decay * self.w[own]
                gw[own] += dw * dw
                self.w[own] -= rate * dw / np.sqrt(gw[own])
                inner = gx[:, None] * (total[row] - v)
                dv = np.stack([np.bincount(slot, inner[:, k], len(own)) for k in range(v.shape[1])], 1) + decay * self.v[own]
                gv[own] += dv * dv
                self.v[own] -= 0.4 * rate * dv / np.sqrt(gv[own])
        return self


def fit(docs: DataFrame, labels: DataFrame, learn, bound: int = BOUND) -> Machine:
    """The machine learnt from at most `bound` rows of labels for which `learn` holds."""
    rows = labelled(docs, labels, "quality", learn, bound)
    texts = pa.table({"text": pa.array([r[1] for r in rows], pa.string())})
    y = np.array([r[2] for r in rows], float)
    del rows
    parts = [features(t["text"]) for t in slices([texts], limit=1 << 20)]
    del texts
    slots = np.concatenate([np.zeros(0, np.int32), *(p[0].astype(np.int32) for p in parts)])
    values = np.concatenate([np.zeros(0, np.float32), *(p[1].astype(np.float32) for p in parts)])
    begins = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(p[2]) for p in parts)]))])
    del parts
    m = Machine().fit(slots, values, begins, y)
    m.w, m.v = m.w.astype(np.float32), m.v.astype(np.float32)
    return m


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """docs with score, the probability of a good text."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.b, machine.w, machine.v))

    def run(column):
        m = Machine.__new__(Machine)
        m.b, m.w, m.v = shared.value
        return [pa.array(1 / (1 + np.exp(-np.clip(m.margin(*features(column)), -30, 30))))]

    return scored(docs, text, [T.StructField("score", T.DoubleType())], run, LIMIT)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every row of `documents` scored by a machine that has not seen a fifth of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return score(docs, machine).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
