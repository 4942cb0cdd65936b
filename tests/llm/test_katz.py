import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import lower, words
from pyspark.sql import functions as F

from faturaflow.llm import katz


def tokens(text):
    return [*words(lower(text)), "</s>"]


class Brute:
    """Katz backoff of any order, from plain dictionaries."""

    def __init__(self, texts, order):
        self.order, self.counts, self.d = order, [], []
        for k in range(1, order + 1):
            c = Counter()
            for t in texts:
                seq = ["<s>"] * (k - 1) + tokens(t)
                c.update(tuple(seq[i : i + k]) for i in range(len(seq) - k + 1))
            n = Counter(c.values())
            self.counts.append(c)
            self.d.append(katz.discounts([0] + [n[r] for r in range(1, katz.K + 2)]))
        self.n = sum(self.counts[0].values())
        left = sum((1 - self.d[0][min(r, katz.K + 1)]) * r for r in self.counts[0].values())
        self.left, self.total = (left, self.n) if left > 1e-9 else (1, self.n + 1)
        self.after = [defaultdict(dict) for _ in range(order)]
        for k in range(1, order):
            for g, r in self.counts[k].items():
                self.after[k][g[:-1]][g[-1]] = r

    def p(self, h, w):
        k = len(h)
        if not self.n:
            return 1.0
        if k == 0:
            r = self.counts[0][(w,)]
            return (self.d[0][min(r, katz.K + 1)] * r if r else self.left) / self.total
        seen = self.after[k].get(tuple(h), {})
        if not seen:
            return self.p(h[1:], w)
        total = sum(seen.values())
        left = sum((1 - self.d[k][min(r, katz.K + 1)]) * r for r in seen.values())
        if left < 1e-9:
            total, left = total + 1, left + 1
        if w in seen:
            return self.d[k][min(seen[w], katz.K + 1)] * seen[w] / total
        return left / total / max(1 - sum(self.p(h[1:], x) for x in seen), 1e-12) * self.p(h[1:], w)


@pytest.mark.parametrize(("order", "hot"), [(1, katz.HOT), (2, katz.HOT), (3, katz.HOT), (2, 5), (3, 5)])
def test_equals_brute_force(spark, docs, rows, order, hot):
    """Also where nearly every history word is split into slices."""
    small = docs.filter("doc_id % 3 = 0 or doc_id > 58").filter("doc_id <> 67")
    got = {r.doc_id: r for r in katz.score(small.withColumn("train", F.col("doc_id") % 4 != 0), order, hot).collect()}
    mine = [r for r in rows if (r[0] % 3 == 0 or r[0] > 58) and r[0] != 67]
    m = Brute([r[1] for r in mine if r[0] % 4], order)
    assert set(got) == {r[0] for r in mine}
    vocab = [*(w for (w,) in m.counts[0]), "<unknown>"]
    for h in list(m.after[order - 1])[:3]:
        assert abs(sum(m.p(list(h), w) for w in vocab) - 1) < 1e-9
    for r in mine:
        t = tokens(r[1])
        seq = ["<s>"] * (order - 1) + t
        want = sum(math.log10(m.p(seq[i : i + order - 1], w)) for i, w in enumerate(t))
        base = sum(math.log10((m.counts[0][(w,)] + 0.1) / (m.n + 0.1 * (len(m.counts[0]) + 1))) for w in t)
        g = got[r[0]]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(t), sum((w,) in m.counts[0] for w in t), m.n)
        assert np.isclose(g.base_score, base) and np.isclose(g.score, want)


@pytest.mark.parametrize(("order", "hot"), [(2, katz.HOT), (3, katz.HOT), (3, 6)])
def test_stored_model(spark, docs, rows, tmp_path, order, hot):
    """The tables are normalised, and any texts are scored from them alone in another session."""
    small = docs.filter("doc_id < 40").withColumn("train", F.lit(True))
    katz.store(small, str(tmp_path), order, hot)
    m = Brute([r[1] for r in rows if r[0] < 40], order)
    fresh = spark.newSession()
    for level in range(2, order + 1):
        stored = fresh.read.parquet(f"{tmp_path}/grams").filter(F.col("level") == level)
        assert stored.count() == len(m.counts[level - 1])
        assert stored.agg(F.sum("count")).first()[0] == sum(m.counts[level - 1].values())
        mass = stored.groupBy("v", "u").agg((F.sum("p") + F.first("alpha") * (1 - F.sum("p_below"))).alias("mass"), F.countDistinct("alpha").alias("n"))
        assert mass.filter((F.abs(F.col("mass") - 1) > 1e-9) | (F.col("n") > 1)).count() == 0 and mass.count() == len(m.after[level - 1])
    listed = {r.word: (r["count"], r.p) for r in fresh.read.parquet(f"{tmp_path}/words").collect()}
    assert {w or "</s>": c for w, (c, _) in listed.items()} == {w: c for (w,), c in m.counts[0].items()}
    texts = [(i, t) for i, t, *_ in rows if i % 5 == 0] + [(1, "never seen words"), (1, None), (None, rows[2][1])]
    got = katz.score_stored(fresh.createDataFrame(texts, "doc_id long, text string"), str(tmp_path)).collect()
    want = []
    for i, text in texts:
        t = tokens(text)
        seq = ["<s>"] * (order - 1) + t
        want.append((str(i), len(t), sum(math.log10(m.p(seq[k : k + order - 1], w)) for k, w in enumerate(t))))
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:2] == w[:2] and math.isclose(g[2], w[2], rel_tol=1e-9)


def test_odd_rows_and_no_training(spark, odd, none):
    got = katz.score(odd.withColumn("train", F.lit(False))).collect()
    assert len(got) == 5 and all(r.score == 0 and r.train_tokens == 0 for r in got)
    assert katz.score(odd.withColumn("train", F.lit(None).cast("boolean"))).count() == 5
    assert katz.score(none.withColumn("train", F.lit(True))).count() == 0


def test_discounts_fall_back_where_counts_are_missing():
    assert ((katz.discounts([0] * 7)[1:-1] > 0) & (katz.discounts([0] * 7)[1:-1] < 1)).all()


def test_query_counts_three_words(spark, tmp_path):
    """The registered query: each word under the two before it."""
    texts = {i: f"{'a b c' if i % 2 else 'x b d'} e f{i % 7}" for i in range(80)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in katz.query(spark, str(tmp_path)).collect()}
    model = Brute([t for i, t in texts.items() if not got[i].held_out], 3)
    assert len(got) == len(texts) and any(r.held_out for r in got.values())
    for i, t in texts.items():
        seq = ["<s>", "<s>", *tokens(t)]
        want = sum(math.log10(model.p(seq[k - 2 : k], seq[k])) for k in range(2, len(seq)))
        assert math.isclose(got[i].score, want, rel_tol=1e-9), (i, got[i].score, want)
