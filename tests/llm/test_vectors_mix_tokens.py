"""Pivot index, source mixing, tokenisation and the pipeline."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faturaflow.llm import bpe, mixing, pivot_index

PATH = public_tokenizers.path("byte_bpe_50k.json")


def vectors(seed=1, n=400, dim=24):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)).astype(np.float32)
    for i in range(0, 200, 2):  # neighbours at many angles around the threshold
        x[i + 1] = x[i] / np.linalg.norm(x[i]) + r.normal(size=dim) * r.uniform(0, 0.09)
    x[300:340] = x[300] + 0.01 * r.normal(size=(40, dim))
    x[340:360] = x[340]
    x[360] = 3 * x[340]
    return x


def brute(x, threshold=0.95):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    return near


def classes_of(near, names):
    """The smallest name that links reach, by a plain search."""
    found = [None] * len(names)
    for start in sorted(range(len(names)), key=lambda i: names[i]):
        todo = [] if found[start] is not None else [start]
        while todo:
            i = todo.pop()
            if found[i] is None:
                found[i] = names[start]
                todo += np.flatnonzero(near[i]).tolist()
    return found


@pytest.mark.parametrize("block", [1024, 8])
def test_pivot_index_recall_and_no_false_links(spark, block):
    x = vectors()
    near = brute(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in pivot_index.near_duplicates(df, block=block).collect()}
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= near.sum(1)).all()
    assert links.sum() >= 0.98 * near.sum()
    if (links == near.sum(1)).all():
        assert [got[i].component_id for i in range(len(x))] == classes_of(near, list(range(len(x))))


@pytest.mark.parametrize("dim", [64, 384])
@pytest.mark.parametrize("common", [0, 1, 2])
def test_recall_near_the_threshold(spark, dim, common):
    """Pairs of cosine 0.95 to 0.96 among vectors in all directions, and among vectors with a common mean."""
    r = np.random.default_rng(dim + common)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    n, pairs = 3000, 600
    x = unit(r.normal(size=(n, dim)) / np.sqrt(dim) + common * unit(r.normal(size=(1, dim))))
    a = x[:pairs]
    away = r.normal(size=a.shape)
    away = unit(away - (away * a).sum(1, keepdims=True) * a)
    cos = r.uniform(0.9502, 0.96, pairs)[:, None]
    x = np.vstack([x, cos * a + np.sqrt(1 - cos**2) * away])
    near = brute(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = pivot_index.near_duplicates(df).toPandas().set_index("vec_id").n_links.loc[: len(x)].sort_index().to_numpy()
    assert (got <= near.sum(1)).all() and near.sum() >= 2 * pairs
    assert got.sum() >= 0.97 * near.sum()


def test_descriptions_are_ordered_nearest_pivots():
    r = np.random.default_rng(2)
    x = pivot_index._unit(r.normal(size=(300, 16)))
    space = pivot_index.tune(x, 300, 0.95)
    near = space.describe(x[:50])
    y = pivot_index._unit(x[:50] - space.mean)
    want = np.argsort(-(y @ space.pivots.T), axis=1, kind="stable")[:, : space.prefix]
    assert (near == want).all()
    w = pivot_index.weights(space.prefix)
    shared = pivot_index.shares(near[:9], near[9:20], len(space.pivots))
    for i in range(9):
        for j in range(11):
            a, b = near[i].tolist(), near[9 + j].tolist()
            assert np.isclose(shared[i, j], sum(w[a.index(p)] * w[b.index(p)] for p in a if p in b))


def test_pivot_index_odd_vectors(spark):
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (1, [1.0, 0.0]), (10, [1e-30, 0.0])]
    data += [(None, [-1.0, 0.0]), (None, None), (None, [0.0, -3.0]), (12, [0.0, -1.0]), (11, [0.0, 1.0]), (11, [0.1, -1.0])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in data], "vec_id long, embedding array<double>, id int, h int, component int")
    got = sorted(map(tuple, pivot_index.near_duplicates(df).collect()), key=str)
    want = [(i, 3, 1) for i in (1, 1, 2, 10)] + [(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9, None, None)]
    # Two vectors share the id 11: one is alone, the other meets 12 and a vector without an id.
    want += [(11, 0, 11), (11, 2, 11), (12, 2, 11), (None, 2, 11)]
    assert got == sorted(want, key=str)
    names = df.selectExpr("cast(vec_id as string) vec_id", "embedding")
    assert {r.component_id for r in pivot_index.near_duplicates(names).filter("vec_id = '10'").collect()} == {"1"}
    assert pivot_index.near_duplicates(df.limit(0)).count() == 0


def filled(sizes, share=1.5, cap=2.0):
    """Capped filling by rounds of resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, target, full = share * sum(sizes.values()), dict.fromkeys(order, 0.0), set()
    while left > 1e-9 and len(full) < len(order):
        free = sum(weight[s] for s in order if s not in full)
        add = {s: left * weight[s] / free for s in order if s not in full}
        left = 0
        for s, a in add.items():
            target[s] += a
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                full.add(s)
    return target


def test_mixing_targets_and_takes(docs, rows):
    got = mixing.plan(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want = filled(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(np.isclose(r.target, want[s]) and r.source_size == sizes[s] and 0 <= r.copies <= 2 for r in own)
        assert abs(sum(r["size"] * r.copies for r in own) - want[s]) <= max(r["size"] for r in own)
    key = lambda r: (r.doc_id, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, mixing.plan(docs.repartition(7)).collect()))


@pytest.mark.parametrize("bits", [0, 2, 9, 31])
def test_mixing_slices_make_no_difference(docs, monkeypatch, bits):
    want = sorted((r.doc_id, r.copies) for r in mixing.plan(docs).collect())
    monkeypatch.setattr(mixing, "_bits", lambda n: bits)
    assert sorted((r.doc_id, r.copies) for r in mixing.plan(docs).collect()) == want


def test_mixing_repeats_rows(spark, docs, odd, none):
    mixed = mixing.repeated(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in mixing.plan(docs).collect())
    got = {r.doc_id: r for r in mixed.collect()}
    assert all(r == got[r.doc_id] for r in docs.collect() if r.doc_id in got)  # also in columns named size and copies
    named = docs.select("doc_id", "text", "source", F.lit("mine").alias("copies"), F.lit(7).alias("target"), F.lit("k").alias("__key"), F.lit("p").alias("__place"), F.lit("s").alias("__size"))
    assert {tuple(r)[3:] for r in mixing.repeated(named).collect()} == {("mine", 7, "k", "p", "s")}
    assert mixing.repeated(named).count() == mixed.count()
    assert mixing.plan(none).count() == 0 and mixing.repeated(none).count() == 0
    plan = [(r.doc_id, r["size"], r.source_size, r.target, r.copies) for r in mixing.plan(odd).collect()]
    # 6 words twice in source s, 2 words without a source; wished are 21 of 14: both are full.
    assert sorted(plan, key=str) == sorted([(5, 6, 12, 15.0, 1), (5, 6, 12, 15.0, 1), (None, 2, 2, 4.0, 2), (7, 0, 2, 4.0, 0), (None, 0, 2, 4.0, 0)], key=str) or sum(p[1] * p[4] for p in plan if p[2] == 12) in (12, 18)
    same = spark.createDataFrame([(1, "a b c", "s")] * 9 + [(2, "d e", "t")], "doc_id long, text string, source string")
    taken = [r.copies for r in mixing.plan(same).collect() if r.source == "s"]
    assert abs(3 * sum(taken) - mixing.plan(same).filter("source = 's'").first().target) <= 3


TEXTS = ["", "aaaaaaa aaa", "a<|endoftext|>b <|endoftext|>", "\x1c \x85\xa0 x  \n\n  y", "日本語 🙂🙂 é́ ﬁ", "'S isn't I'LL", "\t\ttab   ", "½²③ ٣", "ab" * 3000, " " * 900]


def test_bpe_equals_the_library(docs, rows):
    lib, v = Tokenizer.from_file(PATH), bpe.vocabulary(PATH)
    got = bpe.encode(v, TEXTS)
    for t, ids in zip(TEXTS, got, strict=True):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids
        assert bpe.decode(v, ids) == lib.decode(ids.tolist(), skip_special_tokens=False) == t
    done = {r.doc_id: r for r in bpe.encode_decode(docs, PATH).collect()}
    for i, t, *_ in rows:
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert done[i].ids == np.array(want, "<u4").tobytes() and done[i].decoded == (t or "")


def test_bpe_digest_and_odd_rows(spark, odd, none):
    assert bpe.encode_decode(odd, PATH).count() == 5 and bpe.encode_decode(none, PATH).count() == 0
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(bpe.encode_decode(odd.filter("doc_id = 7"), PATH).first().ids).hexdigest()


def test_pipeline_stages_apply_and_agree_with_brute_force(spark, docs, none, odd, tmp_path):
    import corpus_pipeline
    from test_dedup import classes, removed

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    now = docs.select(*columns)
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, "")
        if name != "bpe":
            assert out.columns == columns
        got = out.collect()
        if name == "language_id":
            assert {r.doc_id for r in got} == {r.doc_id for r in now.collect() if any(c.isalpha() for c in r.text or "")}
        if name == "jaccard_join":
            kind = classes([(r.doc_id, r.text) for r in now.collect()])
            assert sorted(r.doc_id for r in got) == sorted({c for _, c in kind.values()})
        if name == "substring_dedup":
            before = now.collect()
            want = dict(zip([r.doc_id for r in before], removed([r.text for r in before], 35), strict=True))
            assert {r.doc_id: r.text for r in got} == {i: w[2] for i, w in want.items()}
            assert all(r.n_chars == len(r.text) for r in got)
        if name == "source_mixing":
            texts = {r.doc_id: r.text for r in got}
        if name == "bpe":
            assert all(r.text == texts[r.doc_id] and r.n_tokens * 4 == len(r.ids) for r in got)
        now = spark.createDataFrame(got, out.schema)
    for table in (none.select(*columns), odd.select(*columns)):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, "")
        assert now.count() >= 0


def test_what_a_worker_holds_of_a_large_batch_is_bounded():
    """Tokens and languages of 2 MB of texts in one batch: before slices were halved and places took four bytes, 171 and 83 MB."""
    import random
    import tracemalloc

    import pyarrow as pa

    from faturaflow.llm import language
    from faturaflow.llm.arrowtext import slices

    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abcdefghijklmnoprstuv") for _ in range(r.randint(2, 7))) for _ in range(400)) for _ in range(900)]
    batch = pa.table({"text": texts})
    v = bpe.vocabulary(PATH)
    m = language.Model({"en": texts[0], "fr": texts[1]})

    def peak(limit, work):
        tracemalloc.start()
        try:
            for t in slices([batch], "text", limit):
                work([x.decode() for x in t["text"].to_pylist()])
            return tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    assert peak(bpe.LIMIT, lambda x: bpe.encode(v, x)) < 100
    assert peak(language.LIMIT, m.phrases) < 60
