"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found by a block-max inverted index.

Terms are words, lower-cased A-Z, without the marks at either end. All terms of the learning rows
are in the index, none is chosen by label or frequency. A weight is the root of a term's count times
1 + ln((documents + 1) / (document frequency + 1)), with frequencies counted over all documents; vectors
have unit length. Examples are the learning rows' distinct texts, in blocks of BLOCK, alike ones side by side. The
index holds a term's postings, ordered by example, and the largest weight of each block that has
the term. The sum of a query's weights times these bounds its cosine with any example of a
block: blocks are opened in descending order of their bound until it falls below the query's K-th cosine,
so the K neighbours are exact.

A text asks the index twice: as a whole, and by each of its words, whose K nearest examples are those in which the
word weighs most. Neighbours vote by distance. In long texts the words that no example shares
outweigh an insult, and the vote of a single word does not suffer from that. A logistic combination of the whole
vote and the strongest word votes, made calibrated by isotonic regression, is the score; both are fitted on
the learning rows' votes, each without itself. The neighbours and the words are the evidence.

Learning takes at most BOUND labelled rows and BYTES bytes, those with the smallest hashes of the id; texts
are scored whole, in slices of LIMIT bytes. Labels, lang, source and doc_id are no inputs.

Defined cases: a null text is the empty text; a text without a known term has no neighbour, the share of toxic rows
as all its votes; terms of no learning row are outside the vector space; without
labelled rows, or with one class only, every score is the smoothed share; equal learning texts are one
example, with the mean of their labels; ties between neighbours go to the smaller id; very long texts
are slices of their own; ids have any type; extra columns are passed through, and input columns named score,
evidence or words are replaced; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from faturaflow.llm.arrowtext import Hasher, Words, by_two, ragged, runs, slices
from faturaflow.llm.classify_common import BYTES, labelled, scored
from faturaflow.llm.common import bounded, crc_mod, table

BOUND, K, BLOCK, LIMIT = 5000, 15, 128, 4 << 20
#: Word votes that count, and the weight of the prior in each, in neighbours.
TOP, PRIOR = 4, 3.0
#: Terms of queries that are worked on at a time, and blocks opened before the K-th cosine is looked at.
TERMS_AT_ONCE, FIRST_BLOCKS = 32_768, 8
_HASH = Hasher(41)
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?()'\"-*$%&#|"]] = True


def occurrences(column, known: np.ndarray | None = None):
    """(text number, term, count, from, to) sorted by text and term; from:to shows the term in the bytes of the texts, which come last.

    A term is its hash, or its place in the sorted hashes `known`, others left out.
    """
    words = Words(column, lower=True)
    starts, ends, data = words.starts, words.ends, words.data
    # The first and last byte of each word that is no mark; words of marks only stay as they are.
    at = np.arange(len(data))
    good = ~_MARK[data]
    last = np.maximum.accumulate(np.where(good, at, -1)) if len(data) else at
    following = np.minimum.accumulate(np.where(good, at, len(data))[::-1])[::-1] if len(data) else at
    if len(starts):
        bare = last[ends - 1] < starts
        starts, ends = np.where(bare, starts, following[starts]), np.where(bare, ends, last[ends - 1] + 1)
    owner = np.repeat(np.arange(len(words.offsets) - 1), words.count)
    term = _HASH.ranges(data, starts, ends)
    if known is not None:
        place = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
        ok = known[place] == term if len(known) else np.zeros(len(term), bool)
        owner, term, starts, ends = owner[ok], place[ok].astype(np.int64), starts[ok], ends[ok]
    order = by_two(owner, term)
    owner, term = owner[order], term[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(owner)), bool), (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])]))
    return owner[new], term[new], np.diff(np.append(new, len(owner))), starts[order[new]], ends[order[new]], data


def frequencies(docs: DataFrame, terms: np.ndarray, text: str = "text") -> tuple[int, np.ndarray]:
    """The number of documents, and how many of them hold each of the terms, counted over all rows."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        known, n, total = shared.value, 0, None
        for t in slices(batches, text, LIMIT):
            found = np.bincount(occurrences(t[text], known)[1], minlength=len(known))
            total = found if total is None else total + found
            n += t.num_rows
        if total is not None:
            at = np.flatnonzero(total)
            # The last term stands for the documents themselves.
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, len(known)).astype(np.int32)), pa.array(np.append(total[at], n).astype(np.int64))], ["term", "n"])

    rows = docs.select(text).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms) + 1, np.int64)
    df[rows["term"].to_numpy()] = rows["n"].to_numpy()
    shared.destroy()
    return int(df[-1]), df[:-1]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (x, mean of y) of the non-decreasing fit; each step smoothed by one row of either class."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for v, t in zip(x[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == v:
            blocks[-1][0] += t
            blocks[-1][1] += 1
        else:
            blocks.append([t, 1, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    at = np.array([v for b in blocks for v in (b[2], b[3])])
    share = np.array([v for b in blocks for v in [(b[0] + 0.5) / (b[1] + 1)] * 2])
    return at, np.maximum.accumulate(share)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights, the constant first, of a logistic regression by Newton's steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
    return w


class Neighbours:
    """The examples, their inverted index with block maxima, and the calibration.

    rows are (id, text, label); count(terms) tells the number of documents and the terms' document frequencies,
    by default those of the rows themselves.
    """

    def __init__(self, rows: list[tuple], count=None):
        y = np.array([r[2] for r in rows], float)
        self.prior, self.at = (y.sum() + 0.5) / (len(y) + 1), None
        if len(y) and y.min() != y.max():
            one: dict[str, list] = {}
            for i, text, label in rows:
                one.setdefault(text, [i, []])[1].append(label)
            self.ids = [i for i, _ in one.values()]
            self.y = np.array([np.mean(labels) for _, labels in one.values()])
            self._index(pa.table({"text": pa.array(list(one), pa.string())}), count)
            self._calibrate()

    def _index(self, texts: pa.Table, count) -> None:
        parts, done = [], 0
        for t in slices([texts], limit=1 << 20):
            doc, term, n, *_ = occurrences(t["text"])
            parts.append((doc + done, term, n))
            done += t.num_rows
        doc, term, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
        self.terms, term = np.unique(term, return_inverse=True)
        here = np.bincount(term, minlength=len(self.terms))
        size, df = count(self.terms) if count else (done, here)
        self.idf = 1 + np.log((size + 1) / (df + 1))
        self.own = doc, term, self._weights(doc, term, n)
        # Examples that hold the same frequent terms lie side by side: their blocks have tighter bounds.
        often = np.argsort(-here, kind="stable")[:24]
        held = np.zeros((24, len(self.y)), bool)
        for k, t in enumerate(often.tolist()):
            held[k, doc[term == t]] = True
        place = np.empty(len(self.y), np.int64)
        place[np.lexsort(held[::-1])] = np.arange(len(self.y))
        self.place, self.example = place, np.argsort(place)
        self.n_blocks = -(-len(self.y) // BLOCK)
        at = place[doc]
        order = np.lexsort((at, term))
        # What the index is made of: postings by term, their counts, and the length of each example.
        w = np.sqrt(n) * self.idf[term]
        self.kept = at[order].astype(np.uint32), n[order].astype(np.min_scalar_type(n.max(initial=0))), here.astype(np.uint32), np.sqrt(np.bincount(doc, w * w, len(self.y)))
        self._derive()
        owner = np.repeat(np.arange(len(here)), here)
        # The K + 1 examples in which each word weighs most.
        first = self.example[self.post]
        order = np.lexsort((first, -self.weight, owner))
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        top = rank <= K
        self.best = np.full((len(self.terms), K + 1), -1, np.int32)
        self.best_weight = np.zeros((len(self.terms), K + 1))
        self.best[owner[top], rank[top]] = first[order][top]
        self.best_weight[owner[top], rank[top]] = self.weight[order][top]
        self.word_vote = self._word_votes(np.arange(len(self.terms)), None)

    def _derive(self) -> None:
        """The index proper, from what is kept: workers get the latter only."""
        post, n, here, length = self.kept
        owner, self.post = np.repeat(np.arange(len(here)), here), post.astype(np.int64)
        self.weight = np.sqrt(n.astype(np.int64)) * self.idf[owner] / length[self.example[self.post]]
        code = owner * self.n_blocks + self.post // BLOCK
        self.begin = runs(code)
        self.block = code[self.begin] % self.n_blocks
        self.most = np.maximum.reduceat(self.weight, self.begin) if len(code) else np.zeros(0)
        self.of_term = np.searchsorted(code[self.begin] // self.n_blocks, np.arange(len(here) + 1))
        self.begin = np.append(self.begin, len(code))
        self.within = self.post % BLOCK
        # Postings of terms that many examples hold also lie in rows, block by block.
        many = np.flatnonzero(here >= max(2, len(self.y) // 16))
        self.row = np.full(len(here), -1, np.int64)
        self.row[many] = np.arange(len(many))
        held = self.row[owner] >= 0
        self.rows = np.zeros((self.n_blocks, len(many), BLOCK))
        self.rows[self.post[held] // BLOCK, self.row[owner[held]], self.within[held]] = self.weight[held]
        self.rare = self.row[owner[self.begin[:-1]]] < 0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("post", "weight", "begin", "block", "most", "of_term", "within", "row", "rows", "rare")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        if self.at is not None:
            self._derive()

    def _weights(self, doc, term, n) -> np.ndarray:
        w = np.sqrt(n) * self.idf[term]
        return w / np.sqrt(np.bincount(doc, w * w, doc.max(initial=-1) + 1))[doc]

    def vectors(self, column):
        """Unit TF-IDF vectors: (text number, term, weight)."""
        doc, term, n, *_ = occurrences(column, self.terms)
        return doc, term, self._weights(doc, term, n)

    def _word_votes(self, term, without) -> np.ndarray:
        """The vote of each term's K nearest examples, in the second case without one example each; -1 for none."""
        votes = np.empty(len(term))
        for a in range(0, len(term), 1 << 16):
            part = slice(a, a + (1 << 16))
            who, w = self.best[term[part]], self.best_weight[term[part]].copy()
            w[who < 0] = 0
            if without is None:
                w[:, K] = 0
            else:
                same = who == without[part][:, None]
                w[same] = 0
                w[~same.any(1), K] = 0
            top = w.max(1, initial=0)
            w /= np.where(top > 0, top, 1)[:, None]
            votes[part] = np.where(top > 0, ((w * self.y[who]).sum(1) + PRIOR * self.prior) / (w.sum(1) + PRIOR), -1)
        return votes

    def _calibrate(self) -> None:
        doc, term, w = self.own
        del self.own
        who, sim = self.nearest(doc, term, w, len(self.y), itself=np.arange(len(self.y)))
        x = self._features(self.votes(who, sim), doc, self._word_votes(term, doc))[0]
        del self.best, self.best_weight
        self.logistic = logistic(x, self.y)
        self.at, self.share = isotonic(self._margin(x), self.y)

    def _margin(self, x):
        return self.logistic[0] + x @ self.logistic[1:]

    def _features(self, whole, doc, votes):
        """Log-odds of the whole vote, and of the means of the 1, 2 and TOP strongest word votes; which entries those are, by text."""
        n, held = len(whole), np.flatnonzero(votes >= 0)
        order = held[np.lexsort((-votes[held], doc[held]))]
        rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        order, rank = order[rank < TOP], rank[rank < TOP]
        top = np.zeros((n, TOP))
        top[doc[order], rank] = votes[order]
        many = np.bincount(doc[order], minlength=n)  # a short text's means are those of the words it has
        means = [np.where(many > 0, top[:, :k].sum(1) / np.clip(many, 1, k), self.prior) for k in (1, 2, TOP)]
        p = np.column_stack([whole, *means])
        return np.log((p + 0.01) / (1.01 - p)), order

    def nearest(self, doc, term, w, n: int, itself=None) -> tuple[np.ndarray, np.ndarray]:
        """The K nearest examples of each of n texts, sorted by text: numbers of examples (-1: none) and cosines; `itself` leaves one out for each text."""
        who, sim = np.full((n, K), -1), np.zeros((n, K))
        cuts = np.searchsorted(doc, np.arange(n + 1))
        lo = 0
        while lo < n:
            hi = max(lo + 1, min(int(np.searchsorted(cuts, cuts[lo] + TERMS_AT_ONCE, "right")) - 1, lo + 256))
            if cuts[hi] > cuts[lo]:
                part = slice(cuts[lo], cuts[hi])
                self._some(doc[part] - lo, term[part], w[part], who[lo:hi], sim[lo:hi], None if itself is None else itself[lo:hi])
            lo = hi
        return who, sim

    def _some(self, doc, term, w, who, sim, itself) -> None:
        n, each = len(who), self.of_term[term + 1] - self.of_term[term]
        entry = ragged(self.of_term[term], each)  # the blocks of all terms of all texts
        weight, block = np.repeat(w, each), self.block[entry]
        pair = np.repeat(doc * self.n_blocks, each) + block
        bound = np.bincount(pair, weight * self.most[entry], n * self.n_blocks)
        cos = np.zeros((n * self.n_blocks, BLOCK))
        kth, todo = np.zeros(n), bound > 0
        frequent = np.flatnonzero(self.row[term] >= 0)
        query = np.zeros((n, self.rows.shape[1]))
        query[doc[frequent], self.row[term[frequent]]] = w[frequent]
        rare = np.flatnonzero(self.rare[entry])
        pair, entry, weight = pair[rare], entry[rare], weight[rare]
        if self.n_blocks > FIRST_BLOCKS:
            by_text = bound.reshape(n, -1)
            high = np.partition(by_text, self.n_blocks - FIRST_BLOCKS, axis=1)[:, -FIRST_BLOCKS]
            first = todo & (by_text >= high[:, None]).ravel()
            self._open(cos, query, pair, entry, weight, first, itself)
            todo &= ~first
            if cos.size > n * K:
                kth = np.partition(cos.reshape(n, -1), cos.size // n - K, axis=1)[:, -K]
            # A block whose bound is below the K-th cosine can add nothing.
            todo &= bound >= np.repeat(kth - 1e-9, self.n_blocks)
        self._open(cos, query, pair, entry, weight, todo, itself)
        cos = cos.reshape(n, -1)
        a, b = np.nonzero(cos >= np.maximum(kth - 1e-12, 1e-300)[:, None])
        value, example = np.round(cos[a, b], 12), self.example[b]  # the order of a sum makes no difference to ties
        order = np.lexsort((example, -value, a))
        a, place = a[order], np.arange(len(a)) - np.searchsorted(a, a)
        keep = place < K
        who[a[keep], place[keep]], sim[a[keep], place[keep]] = example[order][keep], value[order][keep]

    def _open(self, cos, query, pair, entry, weight, chosen, itself) -> None:
        """Sets the cosines with all examples of the chosen pairs of a text and a block."""
        pairs = np.flatnonzero(chosen)
        if not len(pairs):
            return
        slot = np.empty(len(chosen), np.int64)
        slot[pairs] = np.arange(len(pairs)) * BLOCK
        held = np.flatnonzero(chosen[pair])
        entry, weight, base = entry[held], weight[held], slot[pair[held]]
        size = self.begin[entry + 1] - self.begin[entry]
        total = np.zeros(len(pairs) * BLOCK)
        by_block = total.reshape(-1, BLOCK)
        text, block = np.divmod(pairs, self.n_blocks)
        for part in np.split(np.argsort(block, kind="stable"), runs(np.sort(block))[1:]):
            by_block[part] = query[text[part]] @ self.rows[block[part[0]]]
        ends = np.cumsum(size)
        lo = 0
        while lo < len(entry):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + (1 << 21), "right")))
            # Runs of one posting need no spreading out.
            one = size[lo:hi] == 1
            e, f = entry[lo:hi][one], entry[lo:hi][~one]
            many, at = size[lo:hi][~one], ragged(self.begin[f], size[lo:hi][~one])
            index = np.concatenate([base[lo:hi][one] + self.within[self.begin[e]], np.repeat(base[lo:hi][~one], many) + self.within[at]])
            value = np.concatenate([self.most[e] * weight[lo:hi][one], self.weight[at] * np.repeat(weight[lo:hi][~one], many)])
            total += np.bincount(index, value, len(total))
            lo = hi
        cos[pairs] = total.reshape(-1, BLOCK)
        if itself is not None:
            cos.reshape(len(itself), -1)[np.arange(len(itself)), self.place[itself]] = 0

    def votes(self, who, sim) -> np.ndarray:
        """Distance-weighted share of toxic neighbours; the prior without any."""
        weight = np.where(who >= 0, sim**2, 0)
        total = weight.sum(1)
        return np.where(total > 0, (weight * self.y[np.maximum(who, 0)]).sum(1) / np.maximum(total, 1e-300), self.prior)

    def score(self, column, id_type: pa.DataType) -> list:
        """The columns score, evidence and words of a slice of texts."""
        n = len(column)
        evidence, words = _types(id_type)
        if self.at is None:
            return [pa.array(np.full(n, self.prior)), pa.array([[]] * n, evidence), pa.array([[]] * n, words)]
        doc, term, count, starts, ends, data = occurrences(column, self.terms)
        who, sim = self.nearest(doc, term, self._weights(doc, term, count), n)
        x, top = self._features(self.votes(who, sim), doc, self.word_vote[term])
        score = np.interp(self._margin(x), self.at, self.share)
        ok = who >= 0
        flat = who[ok]
        found = pa.StructArray.from_arrays([pa.array([self.ids[i] for i in flat.tolist()], id_type), pa.array(self.y[flat]), pa.array(sim[ok])], ["doc_id", "label", "cosine"])
        shown = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[top].tolist(), ends[top].tolist(), strict=True)]
        voted = pa.StructArray.from_arrays([pa.array(shown, pa.string()), pa.array(self.word_vote[term[top]])], ["word", "vote"])
        cut = lambda many: pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
        return [pa.array(score), pa.ListArray.from_arrays(cut(ok.sum(1)), found), pa.ListArray.from_arrays(cut(np.bincount(doc[top], minlength=n)), voted)]


def _types(id_type: pa.DataType) -> tuple[pa.DataType, pa.DataType]:
    return pa.list_(pa.struct([("doc_id", id_type), ("label", pa.float64()), ("cosine", pa.float64())])), pa.list_(pa.struct([("word", pa.string()), ("vote", pa.float64())]))


def fit(docs: DataFrame, labels: DataFrame, learn, bound: int = BOUND, most: int = BYTES) -> Neighbours:
    """The neighbours learnt from at most `bound` rows of labels for which `learn` holds; term statistics are those of all docs."""
    return Neighbours(labelled(docs, labels, "toxic", learn, bound, most), lambda terms: frequencies(docs, terms))


def score(docs: DataFrame, model: Neighbours, text: str = "text") -> DataFrame:
    """docs with score, the probability of toxicity, evidence, the neighbours that voted, and words, those with the strongest votes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType
    id_type, double = to_arrow_type(kind), T.DoubleType()
    evidence = T.StructType([T.StructField("doc_id", kind), T.StructField("label", double), T.StructField("cosine", double)])
    word = T.StructType([T.StructField("word", T.StringType()), T.StructField("vote", double)])
    fields = [T.StructField("score", double), T.StructField("evidence", T.ArrayType(evidence)), T.StructField("words", T.ArrayType(word))]
    return scored(docs, text, fields, lambda column: shared.value.score(column, id_type), LIMIT)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every row of `documents` scored by examples that hold out a third of the ids; evidence has the ids of the neighbours."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    held = (crc_mod("doc_id", 3) == 1).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.col("evidence.doc_id").alias("evidence"))
