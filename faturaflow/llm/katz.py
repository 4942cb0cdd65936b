"""Katz backoff language model: Good-Turing discounts, exactly normalised, evaluated per token.

Level 1 holds the word counts, level 2 the counts of pairs (v, w), level 3 those of triples (u, v, w). Every token is
dealt out by the word v before it: a bucket holds whole pairs and triples after v, so from the triples
alone it tells r(u, v, w), r(v, w), their totals, and the backoff weights

    alpha(h) = (1 - sum of p(w|h) over seen w) / (1 - sum of p'(w|h') over seen w),

where p' is the level below. p(w|h) is d(r) r / c(h) for a seen w, alpha(h) p'(w|h') otherwise;
over all words and the one unknown word it sums to 1 for every history. A batch of documents sends each of its
distinct triples once, with its count in the training documents, and gets back counts, totals and, where a
triple was not seen, the weights; the levels are then evaluated recursively for each of its tokens (see scatter for batches and
buckets). No count table is broadcast or collected: the driver sees only totals, and counts of counts reach all tasks by a
scalar subquery.

Hot words: a word v with more than HOT training occurrences is split into slices by a hash of w, each a bucket of its
own. Pairs and triples stay whole in a slice; the sums of v and of each (u, v) over slices are added up in one more
exchange, by a hash of (v, u), and go back to the slices. So no bucket grows with the corpus, whatever share of all tokens follows
one word or one pair of words.

`store` writes the model itself: tables of words, pairs, triples and histories with counts, p and alpha, partitioned by
level and bucket. `score_stored` evaluates any texts from these tables alone, by joins. `score`, and so the query, evaluates the
texts of the corpus from what the buckets answer, which is the same model restricted to each batch.

Discounts: d(r) = (r*/r - (K+1) n(K+1)/n1) / (1 - (K+1) n(K+1)/n1) with r* = (r+1) n(r+1)/n(r) for
r <= K, else 1; where that leaves (0, 1), d(r) = 1 - 1/(2r). A history whose counts all
exceed K gets one more in its total, and that one is left for unseen words. Unknown words are one word
of the vocabulary, with the mass that the discounts of level 1 leave.

Defined cases: a null or blank text has the end token only; without training rows every word is
unknown and scores 0 = log10(1); equal ids are documents of their own, null ids too; very long texts are batches of their own; there are no
ties to break; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faturaflow.llm import scatter as S
from faturaflow.llm.arrowtext import Hasher, U, Words, mix, ragged, runs, slices
from faturaflow.llm.common import WORD, bounded, crc_mod, table, written
from faturaflow.llm.substring_dedup import buckets

ORDER, K = 3, 5
#: Bytes of a batch, and words that a bucket of the key space stands for.
BATCH_BYTES, BUCKET_KEYS = 6 << 20, 1 << 20
#: Training occurrences beyond which the grams of a history word are split into slices.
HOT = 1 << 18
_HASH = Hasher(51)
END, START, NONE = U(0x5EED5EED5EED5EED), U(0xFFFFFFFFFFFFFFFF), U(0xFFFFFFFFFFFFFFFE)
_REPLY = S.ANSWER + ", stats array<long>"
_PART = "part int, bucket int, n int, data binary"


def discounts(n: list[int]) -> np.ndarray:
    """d(0) to d(K + 1) from the counts of counts n[1] to n[K + 1]; d(0) is 0, d(K + 1) is 1 and stands for all above."""
    d = np.ones(K + 2)
    d[0] = 0
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        x = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = x if 0 < x < 1 else 1 - 0.5 / r
    return d


class Level1:
    """Word probabilities from corpus counts."""

    def __init__(self, stats: list[int]):
        self.n, self.v = stats[0], stats[1]
        self.d = discounts([0, *stats[2:]])
        left = sum((1 - self.d[r]) * r * stats[1 + r] for r in range(1, K + 1))
        self.left = left if left > 1e-9 or not self.n else 1.0
        self.total = self.n + (0 if left > 1e-9 or not self.n else 1)

    def p(self, count: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(count))
        return np.where(count > 0, self.d[np.minimum(count, K + 1)] * count, self.left) / self.total


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as planes of bytes, compressed; unpacked with the same types."""
    sizes = np.array([len(x) for x in arrays], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(S.planes(np.ascontiguousarray(x)) for x in arrays))


def _unpack(data: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, np.int64, len(types)), 8 * len(types), []
    for n, kind in zip(sizes.tolist(), types, strict=True):
        out.append(S.unplanes(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _slices(count: np.ndarray, hot: int) -> np.ndarray:
    """How many slices a history word with so many training occurrences has; 0: it is not split."""
    over = np.maximum(count, 1) / hot
    return np.where(over > 1, 2 ** np.ceil(np.log2(over)), 0).astype(np.int64)


class _Tokens:
    """The tokens of a batch: words, then one end a document."""

    def __init__(self, docs: pa.Table, bits: int):
        words = Words(docs["text"], lower=True)
        count = words.count
        self.bits, self.per_doc = bits, count + 1
        self.first = np.cumsum(self.per_doc) - self.per_doc
        h = np.full(len(words.starts) + len(count), END, U)
        h[ragged(self.first, count)] = words.hashes(_HASH)
        self.doc = np.repeat(np.arange(len(count)), self.per_doc)
        train = docs["train"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        self.train = train[self.doc]
        self.hashes, self.word = np.unique(h, return_inverse=True)

    def words(self, replies: pa.Table, named: bool = False) -> None:
        """Corpus-wide ids and counts of the batch's distinct words; in a named model words go by their hash."""
        told, n = S.answered(replies, 1), len(self.hashes)
        self.id, self.tag, self.count = np.zeros(n, U), np.zeros(n, U), np.zeros(n, np.int64)
        for k, a, b in S.by_bucket(buckets(self.hashes, self.bits, 64 - self.bits)):
            place, tag, self.count[a:b] = _unpack(told[k], np.uint32, np.uint32, np.int64)
            self.id[a:b], self.tag[a:b] = U(k) << U(32) | place.astype(U), U(k) << U(32) | tag.astype(U)
        if named:
            self.id = self.tag = self.hashes

    def grams(self, order: int, train_docs: int, hot: int) -> None:
        """The distinct grams (v, u, w) by bucket, and the gram of each token."""
        n, at = len(self.id), np.arange(len(self.word)) - np.repeat(self.first, self.per_doc)
        v = np.full(len(self.word), n)
        v[1:] = self.word[:-1]
        v[at < 1] = n
        u = np.full(len(self.word), n)
        if order > 2:
            u[2:] = self.word[:-2]
            u[at < 2] = n
        ids, count = np.append(self.id, START), np.append(self.count, train_docs)
        split, spot = _slices(count, hot), mix(ids)
        cut = np.where(split[v] > 0, mix(self.id + U(7))[self.word] % np.maximum(split[v], 1).astype(U) + U(1), U(0))
        far = np.flatnonzero(cut)
        place = spot[v]
        place[far] = mix(place[far] + cut[far])
        bucket = buckets(place, self.bits, 64 - self.bits)
        bucket[far] += 1 << self.bits
        # Histories are numbered in the order of bucket, v, u.
        _, own = np.unique((bucket << np.int64(32)) + v, return_inverse=True)
        _, hist = np.unique(own * np.int64(n + 1) + u, return_inverse=True)
        code = hist * np.int64(n) + self.word
        order_ = np.argsort(code)
        begins = runs(code[order_])
        self.gram = np.empty(len(code), np.int64)
        self.gram[order_] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(code))))
        shown = order_[begins]  # a token that shows each gram
        self.seen = np.add.reduceat(self.train[order_].astype(np.uint32), begins) if len(begins) else np.zeros(0, np.uint32)
        self.w, h, o = self.word[shown], hist[shown], own[shown]
        self.heads = runs(h)  # first gram of each history
        self.u, self.size = u[shown[self.heads]], np.diff(np.append(self.heads, len(h))).astype(np.uint32)
        owners = runs(o[self.heads])  # first history of each v
        begin = shown[self.heads[owners]]
        self.v, self.many = v[begin], np.diff(np.append(owners, len(self.heads))).astype(np.uint32)
        self.ids, self.counts = ids, count
        self.spans = S.by_bucket(bucket[begin])  # (bucket, from, to) of v
        self.cuts = np.append(owners, len(self.heads)), np.append(self.heads, len(self.w))

    def cut(self, x: int, y: int) -> tuple[slice, slice]:
        """The histories and the grams of v number x to y."""
        lo, hi = self.cuts[0][x], self.cuts[0][y]
        return slice(lo, hi), slice(self.cuts[1][lo], self.cuts[1][hi])

    def p(self, level1: Level1, replies: pa.Table, order: int) -> np.ndarray:
        """The probability of each token at the highest level."""
        p1 = level1.p(self.count)
        if order == 1:
            return p1[self.word]
        low, top = map(discounts, (n := json.loads(S.answered(replies, 3)[-1]))[:1] + n[order - 2 : order - 1])
        told, p = S.answered(replies, 2), np.empty(len(self.w))
        for b, x, y in self.spans:
            heads, grams = self.cut(x, y)
            r, total, alpha, r2, total2, alpha2 = _unpack(told[b], *_TOLD)
            of = np.repeat(np.arange(heads.stop - heads.start), self.size[heads])
            miss = r == 0
            got = top[np.minimum(r, K + 1)] * r / np.maximum(total[of], 1)
            need = np.zeros(len(total), bool)
            need[of[miss]] = True
            weight = np.ones(len(total))
            weight[need] = alpha
            below = p1[self.w[grams][miss]]
            if order > 2:
                owner = np.repeat(np.arange(y - x), self.many[x:y])[of[miss]]
                full, weight2 = np.zeros(y - x), np.ones(y - x)
                for got2, which in ((full, owner[r2 > 0]), (weight2, owner[r2 == 0])):
                    need = np.zeros(y - x, bool)
                    need[which] = True
                    got2[need] = total2 if got2 is full else alpha2
                below = np.where(r2 > 0, low[np.minimum(r2, K + 1)] * r2 / np.maximum(full[owner], 1), weight2[owner] * below)
            got[miss] = weight[of[miss]] * below
            p[grams] = got
        return p[self.gram]


#: Types of an answer: r and total, alpha of histories with unseen grams; for these r of the pair, total of v where that is seen, alpha where not.
_TOLD = (np.int64, np.int64, np.float64, np.int64, np.int64, np.float64)
#: Types of a message: v, its count and histories; u and its grams; w, its count and times seen. A word w is its count and a tag among
#: the words of that count, for the two together are hardly more bytes than an id.
_SENT = (U, np.int64, np.uint32, U, np.uint32, U, np.int64, np.uint32)


def _send_words(bits: int):
    def send(batch: int, docs: pa.Table) -> pa.Table:
        t = _Tokens(docs, bits)
        count = np.bincount(t.word, t.train, len(t.hashes)).astype(np.uint32)
        return S.sent(batch, [(k, b - a, S.planes(t.hashes[a:b]) + S.planes(count[a:b])) for k, a, b in S.by_bucket(buckets(t.hashes, bits, 64 - bits))])

    return send


def _replies(rows: list, stats: list) -> pa.Table:
    return S.answers(rows).append_column("stats", pa.array(stats, pa.list_(pa.int64())))


def _of_counts(r: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(r, K + 2), minlength=K + 3)[1 : K + 2].tolist()


def _count_words(bucket: int, rows: pa.Table) -> pa.Table:
    n, data, batch = rows["n"].to_numpy(), rows["data"].to_pylist(), rows["batch"].to_pylist()
    keys = np.concatenate([S.unplanes(d, np.uint64, k) for d, k in zip(data, n, strict=True)])
    count = np.concatenate([S.unplanes(d, np.uint32, k, 8 * k) for d, k in zip(data, n, strict=True)]).astype(np.int64)
    known, own = np.unique(keys, return_inverse=True)
    total = np.bincount(own, count).astype(np.int64)
    # Frequent words come first: their ids have few bytes.
    order = np.argsort(-total, kind="stable")
    place, tag = np.empty(len(total), np.uint32), np.empty(len(total), np.uint32)
    place[order] = np.arange(len(total))
    begins = runs(total[order])
    tag[order] = np.arange(len(total)) - np.repeat(begins, np.diff(np.append(begins, len(total))))
    ends, place, tag, all_ = np.cumsum(n), place[own], tag[own], total[own]
    out = []
    for i in range(len(n)):
        a, b = ends[i] - n[i], ends[i]
        out.append((batch[i], bucket, 1, _pack(place[a:b], tag[a:b], all_[a:b])))
    ends_ = int(total[known == END].sum())
    return _replies([*out, (-1, bucket, 0, b"")], [None] * len(out) + [[int(total.sum()), int((total > 0).sum()), *_of_counts(total), ends_]])


def _send_grams(order: int, bits: int, train_docs: int, hot: int, named: bool):
    def send(batch: int, docs: pa.Table, replies: pa.Table) -> pa.Table:
        t = _Tokens(docs, bits)
        t.words(replies, named)
        t.grams(order, train_docs, hot)
        rows = []
        for b, x, y in t.spans:
            heads, grams = t.cut(x, y)
            v, w = t.v[x:y], t.w[grams]
            rows.append((b, len(w), _pack(t.ids[v], t.counts[v], t.many[x:y], t.ids[t.u[heads]], t.size[heads], t.tag[w], t.count[w], t.seen[grams])))
        return S.sent(batch, rows)

    return send


def _by_number(number: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The value that goes with each number below n; equal numbers have equal values."""
    out = np.empty(n, values.dtype)
    out[number] = values
    return out


class _Bucket:
    """What all batches sent to one bucket, merged."""

    def __init__(self, rows: pa.Table, order: int, level1: Level1):
        self.batch, self.order = rows["batch"].to_pylist(), order
        got = [_unpack(d, *_SENT) for d in rows["data"].to_pylist()]
        self.cuts = [[len(x) for x in g[::3]] for g in got]  # of v, u, w by batch
        v, v_count, many, u, size, w, w_count, seen = (np.concatenate([g[k] for g in got]) for k in range(8))
        del got
        self.v, v = np.unique(v, return_inverse=True)
        self.v_count = _by_number(v, v_count, len(self.v))
        us, u = np.unique(u, return_inverse=True)
        self.heads, self.hist = np.unique(np.repeat(v, many) * np.int64(len(us)) + u, return_inverse=True)  # sorted by v, u
        self.v_of, u = np.divmod(self.heads, len(us))
        self.u = us[u]
        ids, place = np.unique(mix(w + mix(w_count.astype(U))), return_inverse=True)
        n = np.int64(len(ids))
        ids, p1 = _by_number(place, w, n), level1.p(_by_number(place, w_count, n))
        code = np.repeat(self.hist, size) * n + place
        order_ = np.argsort(code)
        begins = runs(code[order_])
        self.gram = np.empty(len(code), np.int64)
        self.gram[order_] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(code))))
        self.r = np.add.reduceat(seen[order_].astype(np.int64), begins)
        self.h_of, w = np.divmod(code[order_[begins]], n)
        pairs, self.pair = np.unique(self.v_of[self.h_of] * n + w, return_inverse=True)
        self.pair_r = np.bincount(self.pair, self.r, len(pairs)).astype(np.int64)
        self.pair_v, pair_w = np.divmod(pairs, n)
        self.w, self.pair_w, self.p1 = ids[w], ids[pair_w], p1[pair_w]

    def stats(self) -> list[int]:
        """Counts of counts of pairs and of triples."""
        return _of_counts(self.pair_r) + _of_counts(self.r)

    def sums(self, low: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each v what discounts take and the sum of p1; for each history its total, what discounts take, and the sum of discounted pair counts."""
        seen = self.pair_r > 0
        left2 = np.bincount(self.pair_v, (1 - low[np.minimum(self.pair_r, K + 1)]) * self.pair_r, len(self.v))
        low2 = np.bincount(self.pair_v, self.p1 * seen, len(self.v))
        n, r2 = len(self.heads), self.pair_r[self.pair]
        total = np.bincount(self.h_of, self.r, n)
        left = np.bincount(self.h_of, (1 - top[np.minimum(self.r, K + 1)]) * self.r, n)
        return left2, low2, total, left, np.bincount(self.h_of, low[np.minimum(r2, K + 1)] * r2 * (self.r > 0), n)

    def weights(self, left2, low2, total, left, low) -> tuple[np.ndarray, ...]:
        """total and alpha of each v and of each history, of whole sums."""
        total2 = np.bincount(self.v_of, total, len(self.v)) if self.bucket_is_whole else self.v_count.astype(float)
        total2, alpha2 = _weight(total2, left2, low2)
        if self.order == 2:
            return total2, alpha2, total2, alpha2
        return total2, alpha2, *_weight(total, left, low / np.maximum(total2[self.v_of], 1))


def _weight(total, left, low):
    # The mass left is summed from what the discounts take, not as 1 minus a sum near 1.
    full = (left < 1e-9) & (total > 0)
    total, left = total + full, left + full
    return total, np.where(total > 0, left / np.maximum(total, 1) / np.maximum(1 - low, 1e-12), 1.0)


def _stats_of(order: int, level1: Level1):
    def stats(bucket: int, rows: pa.Table) -> pa.Table:
        return _replies([(-1, bucket, 0, b"")], [_Bucket(rows, order, level1).stats()])

    return stats


def _told(told: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The discounts of pairs, and those of the highest level."""
    (data,) = (d for d, part in zip(told["data"].to_pylist(), told["part"].to_pylist(), strict=True) if part < 0)
    n = json.loads(data)
    return discounts(n[0]), discounts(n[order - 2])


def _keys(b: _Bucket) -> tuple[np.ndarray, np.ndarray]:
    """Names of the histories and of the v of a slice, sorted, and in which order that is."""
    names = np.concatenate([mix(mix(b.u) + b.v[b.v_of]), mix(mix(np.full(len(b.v), NONE)) + b.v)])
    order = np.argsort(names, kind="stable")
    return names[order], order


def _parts(order: int, level1: Level1, bits: int):
    """What the slices of hot words add to the sums of v and of (u, v)."""

    def parts(key, rows: pa.Table, told: pa.Table) -> pa.Table:
        bucket, out = key[0].as_py(), []
        if rows.num_rows and bucket >> bits:
            b = _Bucket(rows, order, level1)
            left2, low2, total, left, low = b.sums(*_told(told, order))
            names, order_ = _keys(b)
            values = [np.concatenate([x, y])[order_] for x, y in ((total, np.zeros(len(b.v))), (left, left2), (low, low2))]
            out = [(k, bucket, y - x, _pack(names[x:y], *[v[x:y] for v in values])) for k, x, y in S.by_bucket(buckets(names, bits, 64 - bits))]
        return pa.table({n: pa.array([r[k] for r in out], kind) for k, (n, kind) in enumerate((("part", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary())))})

    return parts


def _added(key, rows):
    """The sums over slices, for each slice in the order of its own names."""
    rows = rows.sort_by("bucket")  # sums of the same order whatever way the rows come
    got = [_unpack(d, U, np.float64, np.float64, np.float64) for d in rows["data"].to_pylist()]
    _, place = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    values = [np.bincount(place, np.concatenate([g[k] for g in got]))[place] for k in (1, 2, 3)]
    cuts = np.cumsum([0, *(len(g[0]) for g in got)])
    data = [_pack(*[v[a:b] for v in values]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return rows.set_column(rows.schema.get_field_index("data"), "data", pa.array(data, pa.binary()))


def _merged(key, rows: pa.Table, told: pa.Table, order: int, level1: Level1, bits: int):
    """The bucket with total and alpha of each v and history; sums of slices are those of all slices."""
    bucket = key[0].as_py()
    b, d = _Bucket(rows, order, level1), _told(told, order)
    b.bucket_is_whole = not bucket >> bits
    sums = b.sums(*d)
    if not b.bucket_is_whole:
        _, order_ = _keys(b)
        parts = told.filter(pc.greater_equal(told["part"], 0)).sort_by("part")
        got = [_unpack(x, np.float64, np.float64, np.float64) for x in parts["data"].to_pylist()]
        total, left, low = (np.empty(len(order_)) for _ in range(3))
        for k, x in enumerate((total, left, low)):
            x[order_] = np.concatenate([g[k] for g in got])
        n = len(b.heads)
        sums = left[n:], low[n:], total[:n], left[:n], low[:n]
    return b, d, b.weights(*sums)


def _among(values: np.ndarray, chosen: np.ndarray, n: int) -> np.ndarray:
    """Which of the values, numbers below n, are chosen."""
    mark = np.zeros(n, bool)
    mark[chosen] = True
    return mark[values]


def _answer(order: int, level1: Level1, bits: int):
    def answer(key, rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return S.answers([])
        b, _, (total2, alpha2, total, alpha) = _merged(key, rows, told, order, level1, bits)
        if order == 2:
            total, alpha = total[b.v_of], alpha[b.v_of]
        out, bucket, h, g = [], key[0].as_py(), 0, 0
        for batch, (_, heads, grams) in zip(b.batch, b.cuts, strict=True):
            gram, own = b.gram[g : g + grams], b.hist[h : h + heads]
            r = b.r[gram]
            missed = gram[r == 0]
            # What is told of histories and of v that have unseen grams is in the batch's order.
            mine = b.v_of[own]
            mine = mine[runs(mine)]
            r2 = b.pair_r[b.pair[missed]] if order > 2 else r[:0]
            v = b.v_of[b.h_of[missed]][: len(r2)]
            totals, alphas = (mine[_among(mine, which, len(b.v))] for which in (v[r2 > 0], v[r2 == 0]))
            weight = alpha[own[_among(own, b.h_of[missed], len(b.heads))]]
            out.append((batch, bucket, 2, _pack(r, total[own].astype(np.int64), weight, r2, total2[totals].astype(np.int64), alpha2[alphas])))
            h, g = h + heads, g + grams
        return S.answers(out)

    return answer


def _told_to(stats: DataFrame, n: int, column: str, order: int) -> DataFrame:
    """For each of the n numbers of `column` the counts of counts, as JSON."""
    lists = [F.array(F.lit(0).cast("long"), *[F.coalesce(F.sum(F.get("stats", F.lit(k * (K + 1) + i))), F.lit(0)) for i in range(K + 1)]) for k in range(2)]
    total = stats.agg(F.encode(F.to_json(F.array(*lists)), "utf-8").alias("data"))
    return stats.sparkSession.range(n).select(F.col("id").cast("int").alias(column), total.scalar().alias("data"))


class _Plan:
    """What `score` and `store` share: the lazy passes up to the merged buckets."""

    def __init__(self, docs: DataFrame, order: int, hot: int, named: bool = False):
        docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("train", F.lit(False)).alias("train"))
        self.order, self.plan = order, S.plan_for(docs, batch_bytes=BATCH_BYTES, bucket_keys=BUCKET_KEYS)
        self.bits = bits = self.plan.bits
        self.batches = S.packed(docs, self.plan)
        words = written(S.reduce_buckets(S.scatter(self.batches, _send_words(bits)), _count_words, _REPLY), "words")
        sums = words.agg(*[F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)) for i in range(K + 4)]).first()
        self.level1, self.train_docs = Level1([int(x) for x in sums[:-1]]), int(sums[-1])
        self.replies = words.filter("batch >= 0").drop("stats")
        if order > 1:
            self.grams = S.gather(self.batches, self.replies, _send_grams(order, bits, self.train_docs, hot, named), S.SENT)
            self.stats = S.reduce_buckets(self.grams, _stats_of(order, self.level1), _REPLY)

    def merged(self, make, schema: str) -> DataFrame:
        """make(key, rows, told) of every bucket."""
        told = _told_to(self.stats, 2 << self.bits, "bucket", self.order)
        whole = self.grams.groupBy("bucket")
        parts = whole.cogroup(told.select("bucket", F.lit(-1).alias("part"), "data").groupBy("bucket")).applyInArrow(_parts(self.order, self.level1, self.bits), _PART)
        added = parts.groupBy("part").applyInArrow(_added, _PART).select("bucket", "part", "data")
        both = told.select("bucket", F.lit(-1).alias("part"), "data").unionAll(added)
        return whole.cogroup(both.groupBy("bucket")).applyInArrow(make, schema)


def score(docs: DataFrame, order: int = ORDER, hot: int = HOT) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, text, train).

    The model, of order 1 to 3, learns from the rows with train, and scores all of them.
    """
    if order not in (1, 2, 3):
        raise ValueError("the order is 1, 2 or 3")
    plan = _Plan(docs, order, hot)
    level1, bits, replies = plan.level1, plan.bits, plan.replies
    if order > 1:
        discounts_ = _told_to(plan.stats, plan.plan.batches, "batch", order).select("batch", F.lit(-1).alias("bucket"), F.lit(3).alias("kind"), "data")
        replies = replies.unionAll(plan.merged(_answer(order, level1, bits), S.ANSWER)).unionAll(discounts_)
    train_docs = plan.train_docs

    def evaluate(batch: int, t: pa.Table, replies: pa.Table) -> pa.Table:
        x = _Tokens(t, bits)
        x.words(replies)
        if order > 1:
            x.grams(order, train_docs, hot)
        base = np.log10((x.count + 0.1) / (level1.n + 0.1 * (level1.v + 1)))[x.word]
        log_p = np.log10(x.p(level1, replies, order))
        n = t.num_rows
        return pa.table(
            {
                "doc_id": t["doc_id"],
                "train": t["train"],
                "n_tokens": pa.array(x.per_doc, pa.int64()),
                "n_known": pa.array(np.bincount(x.doc, (x.count > 0)[x.word], n).astype(np.int64)),
                "base_score": pa.array(np.bincount(x.doc, base, n)),
                "score": pa.array(np.bincount(x.doc, log_p, n)),
            }
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    done = S.gather(plan.batches, replies, evaluate, f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return done.withColumn("train_tokens", F.lit(level1.n).cast("long"))


def _entries(order: int, level1: Level1, bits: int):
    """The seen pairs and triples of a bucket, with their probabilities and the weights of their histories."""

    def entries(key, rows: pa.Table, told: pa.Table) -> pa.Table:
        columns: dict[str, list] = {n: [] for n in ("level", "v", "u", "w", "count", "p", "p_below", "alpha")}
        if rows.num_rows:
            b, (low, top), (total2, alpha2, total3, alpha3) = _merged(key, rows, told, order, level1, bits)
            at = np.flatnonzero(b.pair_r)
            of, r = b.pair_v[at], b.pair_r[at]
            pair_p = np.zeros(len(b.pair_r))
            pair_p[at] = low[np.minimum(r, K + 1)] * r / total2[of]
            found = [(2, b.v[of], np.full(len(at), START), b.pair_w[at], r, pair_p[at], b.p1[at], alpha2[of])]
            if order > 2:
                at = np.flatnonzero(b.r)
                of, r = b.h_of[at], b.r[at]
                found.append((3, b.v[b.v_of[of]], b.u[of], b.w[at], r, top[np.minimum(r, K + 1)] * r / total3[of], pair_p[b.pair[at]], alpha3[of]))
            for level, *values in found:
                columns["level"].append(np.full(len(values[0]), level, np.int32))
                for name, x in zip(list(columns)[1:], values, strict=True):
                    columns[name].append(x.view(np.int64) if x.dtype == U else x)
        types = (np.int32, np.int64, np.int64, np.int64, np.int64, np.float64, np.float64, np.float64)
        out = {n: np.concatenate([np.zeros(0, t), *x]).astype(t) for (n, x), t in zip(columns.items(), types, strict=True)}
        return pa.table({"bucket": np.full(len(out["v"]), key[0].as_py(), np.int32), **out})

    return entries


_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def store(docs: DataFrame, path: str, order: int = ORDER, hot: int = HOT) -> None:
    """The model of the rows of docs (doc_id, text, train) with train, as Parquet tables under path.

    words (bucket, word, id, count, p): the distinct words and, as the empty word, the end. grams (level, bucket, v, u, w, count, p,
    p_below, alpha), partitioned by level and bucket: the seen pairs (level 2, u is -1) and triples (level 3) of word ids, their discounted
    probability, that of the level below, and the weight of their history. For every history the sum of p plus alpha times
    (1 - the sum of p_below) is 1. about (order, tokens, unknown): the order, the training tokens and the probability of an unknown word.
    """
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    plan = _Plan(docs, order, hot, named=True)
    level1 = plan.level1

    def named(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            words = Words(t["word"], lower=True)
            ids = np.full(t.num_rows, END, U)
            ids[words.count > 0] = words.hashes(_HASH)
            p = level1.p(t["count"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array((ids >> U(58)).astype(np.int32)), *batch.columns[:1], pa.array(ids.view(np.int64)), *batch.columns[1:], pa.array(p)], ["bucket", "word", "id", "count", "p"])

    said = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), *_LOWER), F.lit(WORD), F.lit(0))
    words = docs.filter("train").select(F.explode(F.array_append(said, "")).alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    words.mapInArrow(named, "bucket int, word string, id long, count long, p double").write.partitionBy("bucket").parquet(f"{path}/words")
    schema = "bucket int, level int, v long, u long, w long, count long, p double, p_below double, alpha double"
    plan.merged(_entries(order, level1, plan.bits), schema).write.partitionBy("level", "bucket").parquet(f"{path}/grams")
    about = docs.sparkSession.range(1).select(F.lit(order).alias("order"), F.lit(level1.n).cast("long").alias("tokens"), F.lit(float(level1.p(np.zeros(1, np.int64))[0])).alias("unknown"))
    about.write.parquet(f"{path}/about")


def score_stored(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, score) of docs (doc_id, text) under the model that `store` wrote to path, from its tables alone."""
    spark = docs.sparkSession
    about = spark.read.parquet(f"{path}/about").first()
    order, kind = about["order"], docs.schema["doc_id"].dataType.simpleString()
    bounded(spark)

    def tokens(batches):
        for batch in batches:
            whole, at = pa.Table.from_batches([batch]), 0
            for t in slices([whole], limit=1 << 20):
                out, at = whole.slice(at, t.num_rows), at + t.num_rows
                x = _Tokens(t.append_column("train", pa.array(np.zeros(t.num_rows, bool))), 0)
                x.id = x.hashes
                n, place = len(x.id), np.arange(len(x.word)) - np.repeat(x.first, x.per_doc)
                ids, back = np.append(x.id, START), []
                for k in (1, 2):
                    own = np.full(len(x.word), n)
                    own[k:] = x.word[:-k]
                    own[place < k] = n
                    back.append(pa.array(ids[own if k < order else np.full(len(own), n)].view(np.int64)))
                rows = out.take(pa.array(x.doc)).combine_chunks()
                columns = [rows["__k"].combine_chunks(), rows["doc_id"].combine_chunks(), *back, pa.array(x.id[x.word].view(np.int64))]
                yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], ["__k", "doc_id", "v", "u", "w"])

    rows = docs.select(F.monotonically_increasing_id().alias("__k"), "doc_id", "text")
    t = rows.mapInArrow(tokens, f"__k long, doc_id {kind}, v long, u long, w long").groupBy("__k", "doc_id", "v", "u", "w").agg(F.count("*").alias("times"))
    t = t.join(spark.read.parquet(f"{path}/words").select(F.col("id").alias("w"), F.col("p").alias("p1")), "w", "left")
    p = F.coalesce("p1", F.lit(about["unknown"]))
    for level in range(2, order + 1):
        keys = ["v", "u"][: level - 1]
        grams = spark.read.parquet(f"{path}/grams").filter(F.col("level") == level)
        heads = grams.groupBy(*keys).agg(F.max("alpha").alias(f"alpha{level}"))
        t = t.join(grams.select(*keys, "w", F.col("p").alias(f"p{level}")), [*keys, "w"], "left").join(heads, keys, "left")
        p = F.coalesce(F.col(f"p{level}"), F.coalesce(F.col(f"alpha{level}"), F.lit(1.0)) * p)
    done = t.groupBy("__k", "doc_id").agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.log10(p)).alias("score"))
    return done.drop("__k")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every row of `documents` under a model of nine tenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 10) != 0).alias("train"))
    return score(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
