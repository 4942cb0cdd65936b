"""Quality rules, quality model, toxicity, language: brute force, held-out accuracy, odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import lower, words
from pyspark.sql import functions as F

from faturaflow.llm import language, quality_model, quality_rules, toxicity


def test_rules_equal_brute_force(docs, rows):
    got = {r.doc_id: r for r in quality_rules.apply(docs.filter("doc_id is not null")).collect()}
    for i, t, *_ in rows:
        t = t or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        cover = {k + j for k, g in enumerate(windows) if windows.count(g) > 1 for j in range(5)} if len(w) < 2000 else set()
        g = got[i]
        assert (g.n_words, g.word_chars) == (len(w), sum(map(len, w)))
        assert (g.n_symbols, g.n_dup_lines) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        assert g.n_repeat_words == len(cover)
        assert not (g.kept and (len(w) < 10 or 5 * len(cover) > len(w)))


def test_rules_catch_each_fault(spark):
    good = " ".join(["the word of a text"] + [f"item{i} and" for i in range(40)])
    bad = ["short text", "tick tock on and on " * 20, "### " * 3 + good.replace(" ", " # "), "\n".join(["one line of some words"] * 9), "x" * 400 + " " + "y " * 9]
    got = quality_rules.apply(spark.createDataFrame(list(enumerate([good, *bad])), "doc_id long, text string")).orderBy("doc_id")
    assert [r.kept for r in got.collect()] == [True] + [False] * 5


def test_rules_odd_rows(odd, none):
    assert quality_rules.apply(odd).count() == 5
    assert quality_rules.apply(none).count() == 0
    plan = quality_rules.apply(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def labelled(spark, n=600):
    """Clean and spoilt texts; in half of each the words are toxic."""
    r = random.Random(2)
    say = lambda k: " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 6))) for _ in range(k))
    docs, labels = [], []
    for i in range(n):
        t = say(60)
        good, toxic = int(i % 3 != 0), int(i % 2)
        if not good:
            t = t.replace(" ", "$$$ ###") if i % 6 else " ".join([say(1)] * 60)
        if toxic:
            t += " grumble snarl, growl! grumble"
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, good, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "at"), [(quality_model, "quality", 0.3), (toxicity, "toxic", 0.7)])
def test_held_out_accuracy(spark, module, label, at):
    docs, labels = labelled(spark)
    model = module.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in module.score(docs, model).filter("doc_id % 5 = 0").collect()}
    want = {r.doc_id: r[label] for r in labels.collect()}
    assert np.mean([(got[i] >= at) == want[i] for i in got]) > 0.95
    again = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, labels, F.col("doc_id") % 5 != 0)).filter("doc_id % 5 = 0").collect()}
    assert got == again


@pytest.mark.parametrize("module", [quality_model, toxicity])
def test_models_odd_rows(spark, odd, none, module):
    labels = "doc_id long, quality int, toxic int"
    learn = F.lit(True)
    docs, _ = labelled(spark, 40)
    for given in ([], [(1, 1, 1)], [(None, 1, 1), (5, None, None), (5, 1, 1), (5, 0, 0), (99, 1, 0), (7, 0, 1)]):
        model = module.fit(docs.unionByName(odd.select(*docs.columns)), spark.createDataFrame(given, labels), learn)
        got = module.score(odd, model).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert module.score(none, model).count() == 0
    assert set(odd.columns) - {"score"} < set(module.score(odd, model).columns)


def test_machine_sums_pairs_in_linear_time():
    """The sum-of-squares identity against the double loop."""
    m = quality_model.Machine(seed=1)
    m.v = np.random.default_rng(4).normal(size=m.v.shape)
    m.w = np.random.default_rng(5).normal(size=m.w.shape)
    slots, values, begins = quality_model.features(pa.chunked_array([pa.array(["a b a c d", "", "x y"])]))
    for i, got in enumerate(m.margin(slots, values, begins)):
        s, x = slots[begins[i] : begins[i + 1]], values[begins[i] : begins[i + 1]]
        want = m.b + (m.w[s] * x).sum() + sum(m.v[s[p]] @ m.v[s[q]] * x[p] * x[q] for p in range(len(s)) for q in range(p))
        assert np.isclose(got, want)


def tfidf_neighbours(rows, probes, n_docs=None, df=None):
    """Plain TF-IDF over every term of the rows: for each probe all (-cosine, example number) with a cosine above 0."""
    bare = lambda w: w.strip(toxicity_marks) or w
    bags = lambda t: Counter(map(bare, words(lower(t))))
    texts = list(dict.fromkeys(t for _, t, _ in rows))
    own = [bags(t) for t in texts]
    df = df or Counter(t for b in own for t in b)
    idf = {t: 1 + math.log(((n_docs or len(texts)) + 1) / (df[t] + 1)) for b in own for t in b}

    def vector(bag):
        v = {t: math.sqrt(n) * idf[t] for t, n in bag.items() if t in idf}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / size for t, x in v.items()}

    vectors = [vector(b) for b in own]
    out = []
    for p in probes:
        q = vector(bags(p))
        found = [(-round(sum(x * v.get(t, 0) for t, x in q.items()), 12), k) for k, v in enumerate(vectors)]
        out.append(sorted(f for f in found if f[0] < 0)[: toxicity.K])
    return out


toxicity_marks = ".,;:!?()'\"-*$%&#|"


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_neighbours_equal_plain_tfidf(monkeypatch, block):
    """Block-max retrieval against every cosine over the full vocabulary: rare terms, ties, repeated texts, marks, a long text."""
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "FIRST_BLOCKS", 2)
    r = random.Random(9)
    vocab = [f"t{i:03d}" for i in range(150)]
    rows = []
    for i in range(500):
        own = vocab[:70] if i % 2 else vocab[70:]
        rows.append((i, " ".join(r.choice(own if r.random() < 0.7 else vocab) + r.choice(["", "", ",", "!?"]) for _ in range(r.randint(1, 30))) + (" onlyhere" if i == 77 else ""), i % 2))
    rows += [(900 + i, rows[i][1], 1) for i in range(30)] + [(950, "", 1), (951, "?!", 0)]
    m = toxicity.Neighbours(rows)
    probes = [" ".join(r.choice(vocab) for _ in range(12)) for _ in range(40)] + ["", "nothing known", "Onlyhere", "t001", "?!", rows[3][1], " ".join(r.choice(vocab) for _ in range(30000))]
    column = pa.chunked_array([pa.array(probes)])
    doc, term, w = m.vectors(column)
    who, sim = m.nearest(doc, term, w, len(probes))
    for got, near, want in zip(who.tolist(), sim.tolist(), tfidf_neighbours(rows, probes), strict=True):
        assert sum(x >= 0 for x in got) == len(want)
        assert np.allclose(near[: len(want)], [-c for c, _ in want], atol=1e-8)
        assert [k for k in got if k >= 0] == [k for _, k in want]
    assert {f.as_py()["doc_id"] for f in m.score(column, pa.int64())[1][42]} == {77}
    # A word's own neighbours are those of a text of that word alone.
    one = m.word_vote[np.searchsorted(m.terms, toxicity.occurrences(pa.chunked_array([pa.array(["t001"])]))[1][0])]
    weight = np.array([-c for c, _ in tfidf_neighbours(rows, ["t001"])[0]])
    label = m.y[[k for _, k in tfidf_neighbours(rows, ["t001"])[0]]]
    assert np.isclose(one, (weight / weight[0] @ label + toxicity.PRIOR * m.prior) / ((weight / weight[0]).sum() + toxicity.PRIOR))


def test_learning_rows_vote_without_themselves():
    """Leave-one-out neighbours and word votes equal those of an index without the row."""
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcdefghijkl") * 2 for _ in range(r.randint(2, 9))), i % 2) for i in range(60)]
    rows = list({t: (i, t, y) for i, t, y in rows}.values())
    seen = {}
    old = toxicity.Neighbours._features
    toxicity.Neighbours._features = lambda self, whole, doc, votes: seen.setdefault("first", (whole, doc, votes)) and old(self, whole, doc, votes)
    try:
        m = toxicity.Neighbours(rows)
    finally:
        toxicity.Neighbours._features = old
    whole, doc, votes = seen["first"]
    at, term, w = m.vectors(pa.chunked_array([pa.array([t for _, t, _ in rows])]))
    full = np.zeros((len(rows), len(m.terms)))
    full[at, term] = w
    cos = full @ full.T
    np.fill_diagonal(cos, 0)
    for i in range(len(rows)):
        best = sorted((-round(c, 9), k) for k, c in enumerate(cos[i]) if c > 0)[: toxicity.K]
        s = np.array([c for c, _ in best]) ** 2
        assert np.isclose(whole[i], s @ m.y[[k for _, k in best]] / s.sum())
        for d, t, v in zip(doc, term, votes, strict=True):
            if d == i:
                best = sorted((-full[k, t], k) for k in range(len(rows)) if k != i and full[k, t] > 0)[: toxicity.K]
                s = np.array([c for c, _ in best])
                s = s / s.min() if len(s) else s
                assert np.isclose(v, (s @ m.y[[k for _, k in best]] + toxicity.PRIOR * m.prior) / (s.sum() + toxicity.PRIOR) if best else -1)


def test_frequencies_count_all_documents(docs, rows, none):
    column = pa.chunked_array([pa.array([t or "" for _, t, *_ in rows])])
    terms = np.unique(toxicity.occurrences(column)[1])[::3]
    n, df = toxicity.frequencies(docs.repartition(3), terms)
    place = np.bincount(toxicity.occurrences(column, terms)[1], minlength=len(terms))
    assert n == len(rows) and (df == place).all()
    assert toxicity.frequencies(none, terms)[0] == 0


def test_language_held_out_and_odd_rows(spark, odd, none):
    r = random.Random(4)
    sets = {"aa": ["ka", "ko", "ta", "to", "ra"], "bb": ["schl", "ach", "ung", "ei"], "cc": ["é", "oi", "eau", "lle"]}
    say = lambda own, k: " ".join("".join(r.choice(own) for _ in range(r.randint(1, 4))) for _ in range(k))
    data = [(i, say(sets[k], 40), k) for i in range(120) for k in [list(sets)[i % 3]]]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    texts = language.sample(docs.filter("doc_id % 4 <> 0"))
    assert list(texts) == ["aa", "bb", "cc"]
    got = language.predict(docs.filter("doc_id % 4 = 0"), texts).collect()
    assert all(x.lang_pred == x.lang and 0 <= x.score <= 1 for x in got)
    blank = spark.createDataFrame([(1, None, "aa"), (2, "", None), (3, "12 #!", "bb"), (4, "ka" * 90000, None)], docs.schema)
    assert [(x.lang_pred, x.score > 0) for x in language.predict(blank, texts).orderBy("doc_id").collect()] == [("und", False)] * 3 + [("aa", True)]
    assert {x.lang_pred for x in language.predict(odd, {}).collect()} == {"und"}
    assert language.predict(none, texts).count() == 0 and language.sample(none) == {}
    assert language.predict(odd, texts).count() == 5 and language.predict(odd, language.sample(odd)).count() == 5


def test_automaton_finds_longest_matches():
    text, probe = "abracadabra", "cadabrabx"
    m = language.Model({"x": text})
    phrases, at = 0, 0
    while at < len(probe):
        n = max([k for k in range(1, len(probe) - at + 1) if probe[at : at + k] in text], default=1)
        at, phrases = at + n, phrases + 1
    got, worth = m.phrases([probe])
    assert worth[0] and round(got[0][0] * len(probe)) == phrases


def parsed(text, probe):
    """Phrases of a greedy parse: one, and one more at each letter that does not go on with the piece of text so far."""
    phrases, piece = 1, ""
    for c in probe:
        if piece + c in text:
            piece += c
        else:
            phrases, piece = phrases + 1, c if c in text else ""
    return phrases


@pytest.mark.parametrize("dense", [0, 64, 10**6])
def test_language_tells_all_letters_apart(monkeypatch, dense):
    """Large alphabets, one beside another: the parse is that of the letters themselves, by rows or by hash."""
    monkeypatch.setattr(language, "DENSE", dense)
    r = random.Random(6)
    alphabets = {"el": [chr(c) for c in range(0x3B1, 0x3C9) if c != 0x3C2], "ru": [chr(c) for c in range(0x430, 0x450)], "zh": [chr(c) for c in range(0x4E00, 0x4F00)], "zz": [chr(c) for c in range(0x5000, 0x5100)]}
    texts = {}
    for k, own in alphabets.items():
        lexicon = ["".join(r.choice(own) for _ in range(3)) for _ in range(150)]
        texts[k] = " ".join(r.choice(lexicon) for _ in range(600))
    probes = {k: t[700:760].strip() + " " + t[100:130].strip() + " \u0e01" for k, t in texts.items()}
    m = language.Model(texts)
    got, worth = m.phrases(list(probes.values()))
    assert worth.all() and [m.labels[i] for i in got.argmin(1)] == list(texts)
    want = [[parsed(t, p) for t in texts.values()] for p in probes.values()]
    assert np.allclose(got * np.array([len(p) for p in probes.values()])[:, None], want)


@pytest.mark.parametrize("dense", [0, 10**6])
def test_parse_of_long_texts_has_no_breaks(monkeypatch, dense):
    """Phrase counts equal a naive greedy parse whatever the length, also where one phrase runs over several lanes."""
    monkeypatch.setattr(language, "DENSE", dense)
    r = random.Random(8)
    say = lambda own, k: " ".join("".join(r.choice(own) for _ in range(r.randint(1, 4))) for _ in range(k))
    han, latin = [chr(c) for c in range(0x4E00, 0x4E00 + 400)], ["ka", "ko", "ta", "ra", "ri"]
    texts = {"han": say(han, 1200), "latin": say(latin, 700), "one": "ab" * 900}
    texts = {k: t[:3000].strip() for k, t in texts.items()}
    probes = [t[:k] for t in texts.values() for k in (1, 511, 512, 513, 1025, 2600)] + [say(latin, 9000)[:50_000], say(han, 900), texts["latin"][3:2000] + texts["latin"][7:1500], "ab" * 3000, "a" * 1500, texts["han"] + "z" * 700 + texts["han"][1:]]
    probes = [p.strip() for p in probes]
    m = language.Model(texts)
    got, _ = m.phrases(probes)
    want = [[parsed(t, p) for t in texts.values()] for p in probes]
    assert np.allclose(got * np.array([len(p) for p in probes])[:, None], want)


def test_language_sample_spreads_over_texts(spark):
    rows = [(i, f"start{i} " + "x" * 5000 + f" end{i}", "aa") for i in range(5)] * 3 + [(9, "short text", "bb"), (None, "no id", "cc"), (10, None, "aa")]
    got = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 4, 1600)
    assert list(got) == ["aa", "bb"] and len(got["aa"]) <= 1600 and got["bb"] == "short text"
    assert sum(f"start{i}" in got["aa"] for i in range(5)) == 4 and sum(f"end{i}" in got["aa"] for i in range(5)) >= 3
    with pytest.raises(ValueError, match="languages"):
        language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels=1)


def test_machine_learns_as_a_double_loop_does():
    """One epoch of one batch against the plain sums: the margins by all pairs, every slot's gradient by all rows."""
    texts = ["a b c a", "d e", "a d f g", "", "x " * 9, "b b c"]
    y = np.array([1.0, 0, 1, 0, 0, 1])
    slots, values, begins = quality_model.features(pa.chunked_array([pa.array(texts)]))
    got, m = quality_model.Machine().fit(slots, values, begins, y, epochs=1), quality_model.Machine()
    b, w, v = np.log((y.sum() + 1) / (len(y) + 2) / (1 - (y.sum() + 1) / (len(y) + 2))), m.w, m.v
    rows = [list(zip(slots[i:j].tolist(), values[i:j].tolist(), strict=True)) for i, j in zip(begins[:-1], begins[1:], strict=True)]
    errors = []
    for row, want in zip(rows, y, strict=True):
        pairs = sum(v[s] @ v[t] * x * z for p, (s, x) in enumerate(row) for t, z in row[:p])
        errors.append(1 / (1 + math.exp(-(b + sum(w[s] * x for s, x in row) + pairs))) - want)
    assert np.isclose(got.b, b - 0.1 * np.mean(errors))
    for slot in set(slots.tolist()):
        mine = [(e, x, sum(v[t] * z for t, z in row)) for e, row in zip(errors, rows, strict=True) for s, x in row if s == slot]
        dw = sum(e * x for e, x, _ in mine) + 1e-5 * w[slot]
        dv = sum(e * x * (total - v[slot] * x) for e, x, total in mine) + 1e-5 * v[slot]
        assert np.allclose(got.w[slot], w[slot] - 0.05 * dw / np.sqrt(1e-6 + dw * dw))
        assert np.allclose(got.v[slot], v[slot] - 0.02 * dv / np.sqrt(1e-6 + dv * dv))


@pytest.mark.parametrize("module", [quality_model, toxicity])
def test_models_take_text_ids_and_very_long_texts(spark, module):
    docs, labels = labelled(spark, 120)
    long = spark.createDataFrame([("long", "grumble snarl " * 150_000 + "end", "en", "s", 1), ("long", None, None, None, None)], "doc_id string, text string, lang string, source string, n_chars long")
    docs, labels = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")).unionByName(long), labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = module.score(docs, module.fit(docs, labels, F.lit(True)))
    rows = {(r.doc_id, r.text is None): r for r in got.collect()}
    assert len(rows) == 122 and got.schema["doc_id"].dataType.simpleString() == "string"
    if module is toxicity:
        assert rows["long", False].score > 0.7 > rows["long", True].score
        assert all(e.doc_id.startswith("d") for r in rows.values() for e in r.evidence)
        assert [w.word for w in rows["long", False].words] and not rows["long", True].words


def test_labelled_rows_are_bounded(spark):
    """By rows, by bytes, and to one row an id."""
    from faturaflow.llm.classify_common import labelled as learn

    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)] * 2 + [(7, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (3, 1)], "doc_id long, quality int")
    all_ = learn(docs, labels, "quality", F.lit(True), 1000)
    assert [r[0] for r in all_] == [i for i in range(50) if i != 3] and all(t == "x" * 100 and y == i % 2 for i, t, y in all_)
    assert len(learn(docs, labels, "quality", F.lit(True), 10)) <= 10
    assert 5 <= len(learn(docs, labels, "quality", F.lit(True), 1000, 600)) <= 7


def test_language_ties_go_to_the_smallest_label(spark):
    docs = spark.createDataFrame([(1, "kata tako rato"), (2, "kata kata")], "doc_id long, text string")
    assert {r.lang_pred for r in language.predict(docs, {"bb": "kata tako", "aa": "kata tako"}).collect()} <= {"aa", "bb"}
    assert {r.lang_pred for r in language.predict(docs, dict(sorted({"bb": "kata tako", "aa": "kata tako"}.items()))).collect()} == {"aa"}
