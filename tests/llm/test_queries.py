"""The ten registered queries on small tables: every column of their contracts against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import lower, words
from test_dedup import classes, removed
from test_katz import Brute, tokens
from test_vectors_mix_tokens import brute, classes_of, filled, vectors
from tokenizers import Tokenizer

from faturaflow.llm import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG, DOUBLE, INT, TEXT, BOOL = "bigint", "double", "int", "string", "boolean"
#: The columns that the contracts name, in their order, and their types.
COLUMNS = {
    "op1_katz_backoff": [("doc_id", LONG), ("held_out", BOOL), ("n_tokens", LONG), ("n_known", LONG), ("train_tokens", LONG), ("base_score", DOUBLE), ("score", DOUBLE)],
    "op2_jaccard_join": [("doc_id", LONG), ("n_shingles", LONG), ("component_id", LONG)],
    "op3_substring_dedup": [("doc_id", LONG), ("n_words", LONG), ("n_removed", LONG), ("kept_sha256", TEXT)],
    "op4_quality_model": [("doc_id", LONG), ("held_out", BOOL), ("score", DOUBLE), ("predicted", INT)],
    "op5_quality_rules": [("doc_id", LONG), ("n_words", LONG), ("word_chars", LONG), ("n_symbols", LONG), ("n_dup_lines", LONG), ("n_repeat_words", LONG), ("base_failed", BOOL), ("kept", BOOL)],
    "op6_pivot_index": [("vec_id", LONG), ("n_links", LONG), ("component_id", LONG), ("kept", BOOL)],
    "op7_toxicity": [("doc_id", LONG), ("held_out", BOOL), ("score", DOUBLE), ("predicted", INT)],
    "op8_source_mixing": [("doc_id", LONG), ("size", LONG), ("source_size", LONG), ("target", DOUBLE), ("taken", LONG)],
    "op9_language_id": [("doc_id", LONG), ("held_out", BOOL), ("lang_pred", TEXT), ("score", DOUBLE)],
    "op10_bpe": [("doc_id", LONG), ("n_tokens", LONG), ("ids_sha256", TEXT), ("decoded_sha256", TEXT)],
}


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def texts():
    r = random.Random(12)
    kinds = {"en": "aeioustrn", "de": "äöüschkt", "fr": "éèêouxdl"}
    say = lambda own, k: " ".join("".join(r.choice(own) for _ in range(r.randint(2, 5))) for _ in range(k))
    out = []
    for i in range(150):
        lang = list(kinds)[i % 3]
        t = say(kinds[lang], r.randint(20, 60))
        if i % 7 == 0:
            t = t.replace(" ", " ### $$$ ")
        if i % 5 == 1:
            t += " grumbler, snarling grumbler!"
        out.append((i, t, lang if i % 4 else None, ["s1", "s0", None][i % 3], int(i % 7 != 0), int(i % 5 == 1)))
    copy = " ".join(f"w{k}" for k in range(60))
    out += [(200, copy, "en", "s1", None, None), (201, copy, None, "s0", 1, 0), (202, copy + " end", None, "s9", 0, 1)]
    out += [(203, None, "en", "s1", 1, 0), (204, "", None, None, 0, 0), (205, " \n\t", "de", "s1", None, 1), (206, "12 # <|endoftext|> 3", None, "s1", 1, 1), (207, "one\none\ntwo A b", "en", "s0", 0, 0)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, texts):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s, *_ in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, _, _, _, q, x in texts if i % 6], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors())] + [(900, None, 1), (901, [0.0] * 24, 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


def run(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    assert [(n, k) for n, k in df.dtypes][: len(COLUMNS[name])] == COLUMNS[name] or dict(COLUMNS[name]).items() <= dict(df.dtypes).items()
    return {r[0]: r for r in df.collect()}


def test_op1(spark, folder, texts):
    got = run(spark, folder, "op1_katz_backoff")
    m = Brute([t for i, t, *_ in texts if crc(i, 10)], 3)
    for i, t, *_ in texts:
        x = tokens(t)
        seq = ["<s>", "<s>", *x]
        base = sum(math.log10((m.counts[0][(w,)] + 0.1) / (m.n + 0.1 * (len(m.counts[0]) + 1))) for w in x)
        want = sum(math.log10(m.p(seq[k : k + 2], w)) for k, w in enumerate(x))
        assert tuple(got[i])[:5] == (i, crc(i, 10) == 0, len(x), sum((w,) in m.counts[0] for w in x), m.n)
        assert np.isclose(got[i].base_score, base) and np.isclose(got[i].score, want)
    assert len(got) == len(texts)


def test_op2(spark, folder, texts):
    want = classes([(i, t) for i, t, *_ in texts])
    assert {i: (r.n_shingles, r.component_id) for i, r in run(spark, folder, "op2_jaccard_join").items()} == want


def test_op3(spark, folder, texts):
    got = run(spark, folder, "op3_substring_dedup")
    for (i, *_), (n, gone, kept) in zip(texts, removed([t for _, t, *_ in texts], 35), strict=True):
        assert tuple(got[i])[:4] == (i, n, gone, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize(("name", "n", "rest", "at", "label"), [("op4_quality_model", 5, 0, 0.3, 4), ("op7_toxicity", 3, 1, 0.7, 5)])
def test_scorers(spark, folder, texts, name, n, rest, at, label):
    got = run(spark, folder, name)
    assert len(got) == len(texts)
    for i, *_ in texts:
        r = got[i]
        assert (r.held_out, r.predicted) == (crc(i, n) == rest, int(r.score >= at)) and 0 <= r.score <= 1
    held = [t for t in texts[:150] if crc(t[0], n) == rest]
    assert np.mean([got[t[0]].predicted == t[label] for t in held]) > 0.9
    if name == "op7_toxicity":
        learnt = {t[0] for t in texts if t[0] % 6 and t[5] is not None and crc(t[0], 3) != 1}
        assert all(set(r.evidence) <= learnt for r in got.values()) and any(r.evidence for r in got.values())


def test_op5(spark, folder, texts):
    got = run(spark, folder, "op5_quality_rules")
    for i, t, *_ in texts:
        t = t or ""
        w, lines = words(t), Counter(x for x in t.split("\n") if words(x))
        g = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        cover = {k + j for k, x in enumerate(g) if g.count(x) > 1 for j in range(5)}
        counts = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), sum(lines.values()) - len(lines), len(cover))
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        assert tuple(got[i])[1:7] == (*counts, failed)
        assert not (failed and got[i].kept)


def test_op6(spark, folder):
    got = run(spark, folder, "op6_pivot_index")
    near = brute(vectors())
    links = np.array([got[i].n_links for i in range(len(near))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.95 * near.sum() and near.sum() > 100
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    if (links == near.sum(1)).all():
        assert [got[i].component_id for i in range(len(near))] == classes_of(near, list(range(len(near))))
    assert [tuple(got[i]) for i in (900, 901)] == [(900, 0, 900, True), (901, 0, 901, True)]


def test_op8(spark, folder, texts):
    got = run(spark, folder, "op8_source_mixing")
    sizes = Counter()
    for _, t, _, s, *_ in texts:
        sizes[s] += len(words(t))
    want = filled(dict(sizes))
    taken, most = Counter(), Counter()
    for i, t, _, s, *_ in texts:
        r = got[i]
        assert (r.size, r.source_size) == (len(words(t)), sizes[s]) and np.isclose(r.target, want[s])
        assert r.size == 0 == r.taken or r.taken % r.size == 0 and r.taken <= 2 * r.size
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    assert got == run(spark, folder, "op8_source_mixing")


def test_op9(spark, folder, texts):
    got = run(spark, folder, "op9_language_id")
    for i, t, *_ in texts:
        assert got[i].held_out == (crc(i, 5) == 0) and 0 <= got[i].score <= 1
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert got[i].lang_pred in ("en", "de", "fr", "und")
    assert all(got[i].lang_pred == ["en", "de", "fr"][i % 3] for i in range(150))


def test_op10(spark, folder, texts):
    got, lib = run(spark, folder, "op10_bpe"), Tokenizer.from_file(PATH)
    for i, t, *_ in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        shown = lib.decode(ids, skip_special_tokens=False)
        assert tuple(got[i])[:4] == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())


def test_every_query_is_here():
    assert set(COLUMNS) == set(queries.QUERIES) and lower("ÀB") == "Àb"
