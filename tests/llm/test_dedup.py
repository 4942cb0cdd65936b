import hashlib
import random
from collections import Counter

import numpy as np
from conftest_llm import lower, words

from faturaflow.llm import jaccard_join as J
from faturaflow.llm import substring_dedup as D
from faturaflow.llm.components import components


def shingles(text, n=5):
    w = words(lower(text))
    return {tuple(w)} - {()} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def classes(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_classes_equal_brute_force(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.classes(docs).collect()}
    want = classes(rows)
    assert got == want
    assert sum(i != c for i, (_, c) in want.items()) > 10


def test_jaccard_many_near_copies(spark):
    """A group large enough for frequent tokens, pairs of tokens, hubs and blocks."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(260):
        t = list(base)
        for _ in range(r.randint(0, 5)):
            t[r.randrange(90)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(["q", "r", "s", "t", "u", "v", "w", f"z{i // 2}"][: 5 + i % 4])) for i in range(200)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_jaccard_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "STARS", 1)
    monkeypatch.setattr(J, "BLOCK", 16)
    test_jaccard_many_near_copies(spark)


def test_jaccard_lists_that_overlap_are_one(spark):
    """40 lists of 30 of the same 36 members become few, without losing a pair; lists with one member in common stay apart."""
    r = random.Random(4)
    lists = {s: set(r.sample(range(36), 30)) for s in range(40)} | {100 + i: {500, 600 + i} for i in range(50)}
    rows = spark.createDataFrame([(s, n, 90, n) for s, ns in lists.items() for n in ns], "sig long, node long, size long, component long")
    got = {}
    for x in J._united(rows, 2).collect():
        got.setdefault(x.sig, []).append(x.node)
        assert (x.size, x.component) == (90, x.node)
    assert all(len(set(ns)) == len(ns) for ns in got.values())
    pairs = lambda all_: {(a, b) for ns in all_ for a in ns for b in ns if a < b}
    assert pairs(lists.values()) <= pairs(got.values())
    assert sum(len(ns) for ns in got.values() if max(ns) < 36) < 40 * 30 // 2
    assert max(len(ns) for ns in got.values() if max(ns) >= 500) <= 3


def test_signatures_meet_for_every_linked_pair():
    """The prefix rule itself: sets at the threshold always share a signature, whatever the frequencies."""
    r = random.Random(5)
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 20, 40, 99, 250]:
        for _ in range(30):
            universe = r.sample(range(1 << 62), 3 * size + 10)
            freq = {k: r.choice([1, 3, 7, 8, 9, 12]) for k in universe}
            a = set(universe[:size])
            for drop in range(size):
                for add in range(size):
                    if 100 * (size - drop) >= 80 * (size + add) and r.random() < 0.3:
                        b = set(list(a)[drop:]) | set(universe[size : size + add])
                        signs = [set(J.signatures(np.array(sorted(s), np.uint64), np.array([freq[k] for k in sorted(s)], np.uint8)).tolist()) for s in (a, b)]
                        assert signs[0] & signs[1], (size, drop, add)


def test_jaccard_odd_rows(spark, odd, none):
    """Null, repeated and text ids, several texts under one id, damaged UTF-8: every row has a class."""
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.classes(odd).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (7, 0, 7), (None, 1, None), (None, 0, None)], key=str)
    assert J.classes(none).count() == 0 and J.one_of_each(none).count() == 0
    say = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    data = [(5, say("a")), (5, say("b")), (8, say("a")), (9, say("b")), (3, say("a") + " more"), (None, say("b") + " end"), (None, say("c"))]
    got = J.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()
    want = [(5, 36, 3), (5, 36, 5), (8, 36, 3), (9, 36, 5), (3, 37, 3), (None, 37, 5), (None, 36, None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    got = J.classes(spark.createDataFrame([("b", say("a")), ("a", say("a")), ("c", None)], "doc_id string, text string")).collect()
    assert sorted(map(tuple, got)) == [("a", 36, "a"), ("b", 36, "a"), ("c", 0, "c")]
    broken = spark.sql("select 1L doc_id, cast(unhex('61FF62') as string) text union all select 2L, cast(unhex('61FF62') as string)")
    assert sorted(map(tuple, J.classes(broken).collect())) == [(1, 1, 1), (2, 1, 1)]


def test_one_row_of_each_class_whatever_the_ids(spark, odd, none):
    """Repeated rows, copies without ids and several texts under one id leave one row each, and its words stay."""
    import corpus_pipeline

    say = lambda k: " ".join(f"{k}w{i}" for i in range(45))
    near = say("b").replace("bw44", "other")
    data = [(5, say("a")), (5, say("a")), (None, say("a")), (None, say("b")), (None, near), (9, say("c")), (9, near), (9, say("d")), (3, say("d")), (None, say("e")), (None, None), (4, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    kind = classes(list(enumerate(t for _, t in data)))
    got = corpus_pipeline.near_duplicates(spark, df, "")
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert got.columns == df.columns and len(kept) == len({c for _, c in kind.values()}) == 7
    assert set(kept) == {(5, say("a")), (9, near), (9, say("c")), (3, say("d")), (None, say("e")), (None, None), (4, None)}
    left = corpus_pipeline.repeated_passages(spark, got, "").collect()
    assert sorted(r.text for r in left) == sorted(t or "" for _, t in kept)
    assert J.one_of_each(odd).count() == 4 and J.one_of_each(odd).columns == odd.columns
    taken = df.withColumnsRenamed({"lang": "k1", "source": "__id", "n_chars": "first"})
    assert sorted(map(str, J.one_of_each(taken).collect())) == sorted(str(r).replace("lang=", "k1=").replace("source=", "__id=").replace("n_chars=", "first=") for r in got.collect())
    assert J.one_of_each(none).count() == 0


def test_substring_odd_texts(spark, docs):
    """Damaged UTF-8, null ids, columns with names of the operator's own."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(None, text, 1, "a"), (None, text, 2, "b"), (3, "short " + text[:20], 3, "c")], "doc_id long, text string, __batch int, bucket string")
    broken = spark.sql("select 4L doc_id, cast(concat(unhex('61FF62'), cast(' c' as binary)) as string) text, 4 __batch, 'd' bucket")
    got = sorted((r.text, r.n_words, r.n_removed, r["__batch"], r.bucket) for r in D.dedup(rows.unionAll(broken)).collect())
    assert got == sorted([("", 40, 40, 1, "a"), ("", 40, 40, 2, "b"), ("short " + text[:20].strip(), len(text[:20].split()) + 1, 0, 3, "c"), ("a\ufffdb c", 2, 0, 4, "d")])


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (105, 101), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 105: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(texts, window):
    starts = Counter()
    ws = [words(t) for t in texts]
    for w in ws:
        starts.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    for w in ws:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        yield len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)


def test_substring_equals_brute_force(docs, rows):
    for window in (35, 34, 6, 2):
        got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in D.dedup(docs, window).collect()}
        want = dict(zip([r[0] for r in rows], removed([r[1] for r in rows], window), strict=True))
        assert got == want, window
    assert sum(x[1] for x in want.values()) > 100


def test_substring_keeps_columns_and_odd_rows(odd, none):
    got = D.dedup(odd, 3)
    assert got.columns == [*odd.columns, "n_words", "n_removed"]
    assert sorted((r.n_words, r.n_removed, r.text) for r in got.collect()) == [(0, 0, ""), (0, 0, ""), (2, 0, "alpha beta"), (6, 6, ""), (6, 6, "")]
    assert D.dedup(none).count() == 0


def test_substring_of_one_text_with_itself(spark):
    t = " ".join(["x"] * 50) + " y " + " ".join(f"u{i}" for i in range(50))
    got = D.dedup(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert (got.n_words, got.n_removed) == (101, 50)
    assert hashlib.sha256(got.text.encode()).hexdigest() == hashlib.sha256(t[100:].encode()).hexdigest()


