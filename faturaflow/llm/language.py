"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of its labelled text. A text is
parsed greedily into the longest pieces that occur in the sample; the fewer phrases a language
needs, the closer it is, and the language with the fewest phrases a character wins. Whole
texts are parsed without a break: numpy walks lanes of LANE characters side by side, each from the root at first,
and every lane whose predecessor turns out to end in another state is walked again from that
state until it meets its earlier path.

The tables are built anew by each task and end with it, so that idle workers hold none.

Bounds, all parameters: DOCS documents a language, by smallest hash of the id, CHARS characters of
them together, PIECES pieces of equal length from each, spread over its text; and LABELS languages, beyond
which learning stops with an error. Pieces are cut before they reach the driver. Everything else covers all rows.

Defined cases: a null text or one without a letter is `und` with score 0; without any labelled
text every row is `und`; a language label is any non-null string; a character outside a sample
is a phrase of its own; rows to learn from need an id, and of rows that repeat one the smallest pieces count; ties go
to the smallest label; very long texts are slices of their own; extra columns are passed through, and input
columns named lang_pred, score or phrases are replaced; repeated rows are judged one by one;
an empty table gives an empty result. score is 1 - best / second best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faturaflow.llm.arrowtext import ragged, slices
from faturaflow.llm.common import bounded, crc_mod, table

DOCS, CHARS, PIECES, LABELS, LANE, LIMIT = 64, 32_768, 4, 1024, 512, 1 << 20
#: Classes: 0 for characters outside the samples, one for each code point in them, the last for padding.
#: An automaton with more classes than DENSE holds its transitions by a hash: the same moves in less memory.
DENSE = 64
_MISS = 1 << 30


def sample(docs: DataFrame, docs_a_language: int = DOCS, chars: int = CHARS, pieces: int = PIECES, labels: int = LABELS) -> dict[str, str]:
    """Per language pieces of the labelled documents with the smallest hashes, `chars` characters at most."""
    known = docs.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang")
    # Of a language with n documents, those go on whose hash is in the lowest 4 * docs_a_language / n: ranks are given to these few only.
    many = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("__many"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    low = F.pmod(order, F.lit(1 << 40)) / float(1 << 40) * F.col("__many") < 4.0 * docs_a_language
    ids = known.join(F.broadcast(many.limit(labels + 1)), "lang").filter(low).select("doc_id", "lang").distinct()
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod(order, F.lit(1 << 40)), "doc_id"))
    ids = ids.withColumn("__n", first).filter(F.col("__n") <= docs_a_language)
    size = max(1, chars // docs_a_language // pieces)
    room = F.greatest(F.length("text") - size, F.lit(0))
    cut = F.concat_ws(" ", *[F.substring("text", (F.lit(1) + F.floor(room * k / max(1, pieces - 1))).cast("int"), F.lit(size)) for k in range(pieces)])
    whole = F.when(F.length("text") <= size * pieces, F.col("text")).otherwise(cut)
    rows = docs.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("lang", "doc_id", "__n").agg(F.min(F.lower(whole)).alias("piece"))
    found: dict[str, list[str]] = {}
    for r in sorted(rows.limit(labels * docs_a_language + 1).collect(), key=lambda r: (r["lang"], r["__n"])):
        found.setdefault(r["lang"], []).append(r["piece"])
    if len(found) > labels or sum(map(len, found.values())) > labels * docs_a_language:
        raise ValueError(f"more than {labels} languages")
    return {lang: " ".join(own)[:chars] for lang, own in found.items()}


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of codes, a dictionary a state; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Rows:
    """Transitions with a place for each state and class. walk(state, class): the next state, plus _MISS where a phrase ends."""

    def __init__(self, step: list[dict[int, int]], width: int):
        self.width = width
        found = np.full((len(step), width), -1, np.int32)
        for state, moves in enumerate(step):
            for c, to in moves.items():
                found[state, c] = to
        restart = np.where(found[0] >= 0, found[0], 0)
        found = np.where(found < 0, restart[None, :] + _MISS, found).astype(np.int32)
        found[:, -1] = np.arange(len(found))
        self.table = found.ravel()

    def walk(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.table[state * self.width + code]


class Hashed:
    """The same by a hash of state and class, with a place for each transition only: for large alphabets."""

    def __init__(self, step: list[dict[int, int]], width: int):
        self.width = width
        moves = [(state * width + c, to) for state, own in enumerate(step) for c, to in own.items()]
        key, to = np.array([m[0] for m in moves], np.int64), np.array([m[1] for m in moves], np.int32)
        bits = max(4, int(np.ceil(np.log2(4 * len(moves) + 1))))
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left = np.arange(len(key))
        at = self._home(key)
        while len(left):  # each turn the first of those that want a free place gets it, the others go one on
            free = self.key[at] < 0
            place, first = np.unique(at[free], return_index=True)
            got = np.flatnonzero(free)[first]
            self.key[place], self.to[place] = key[left[got]], to[left[got]]
            rest = np.ones(len(left), bool)
            rest[got] = False
            left, at = left[rest], (at[rest] + 1) & self.last
        self.restart = np.zeros(width, np.int32)
        for c, state in step[0].items():
            self.restart[c] = state

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def walk(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = state * self.width + code
        at = self._home(key)
        there = self.key[at]
        to = np.where(there == key, self.to[at], self.restart[code] + _MISS)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.last
            there = self.key[at[open_]]
            hit = there == key[open_]
            to[open_[hit]] = self.to[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return np.where(code == self.width - 1, state, to)


class Model:
    """The automata of all languages, each over the letters of its own sample."""

    def __init__(self, texts: dict[str, str]):
        self.labels = list(texts)
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        own_points = [self.letters_of(t) for t in texts.values()]
        values = np.unique(np.concatenate([*own_points, np.zeros(0, np.uint32)]))
        self.pad = len(values) + 1
        self.code = np.zeros(0x110000, np.uint32)
        self.code[values] = np.arange(1, self.pad)
        # Per language: the automaton and the class in it of each class of all.
        self.automata = []
        for points in own_points:
            codes, own = np.unique(self.code[points], return_inverse=True)
            width = len(codes) + 2
            kind = np.zeros(self.pad + 1, np.uint32)
            kind[codes] = np.arange(1, width - 1)
            kind[self.pad] = width - 1
            self.automata.append(((Rows if width <= DENSE else Hashed)(automaton((own + 1).tolist()), width), kind))

    def letters_of(self, text: str) -> np.ndarray:
        """Code points of the lower-case text with every run of other characters than letters as one blank."""
        p = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        letter = self.letter[p]
        before = np.concatenate([[False], letter[:-1]]) if len(p) else letter
        return np.where(letter, p, 32)[letter | before].astype(np.uint32)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases a character, a row a text and a column a language; which texts have a letter."""
        points = [self.letters_of(t) for t in texts]
        sizes = np.array([len(p) for p in points], np.int64)
        flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
        ends = np.cumsum(sizes)
        worth = sizes > 0
        lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        within = ragged(np.zeros(len(texts), np.int64), lanes)
        start = within * LANE + np.repeat(ends - sizes, lanes)
        left = np.minimum(LANE, np.repeat(ends, lanes) - start)
        grid = np.full((len(start), LANE), self.pad, np.uint32)
        grid[np.repeat(np.arange(len(start)), left), ragged(np.zeros(len(start), np.int64), left)] = self.code[flat]
        grid = np.ascontiguousarray(grid.T)
        total = np.zeros((len(texts), len(self.labels)))
        for k, (moves, kind) in enumerate(self.automata):
            total[:, k] = worth + np.bincount(owner, self._parse(moves, kind, grid, within > 0), len(texts))
        return total / np.maximum(sizes, 1)[:, None], worth

    def _parse(self, moves, kind: np.ndarray, grid: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
        """How many phrases end within each lane, the lanes of a text being one parse; goes_on: lanes that are not the first of a text."""
        n = grid.shape[1]
        path = np.zeros(grid.shape, np.int32)  # the state after each character, plus _MISS where a phrase ended
        state = np.zeros(n, np.int64)
        for row, to in zip(grid, path, strict=True):
            to[:] = moves.walk(state, kind[row])
            state = (to & (_MISS - 1)).astype(np.int64)
        again = np.flatnonzero(goes_on)
        again = again[state[again - 1] != 0]
        while len(again):
            lane, state = again, (path[-1, again - 1] & (_MISS - 1)).astype(np.int64)
            for row, old in zip(grid, path, strict=True):
                to = moves.walk(state, kind[row[lane]])
                state = (to & (_MISS - 1)).astype(np.int64)
                apart = state != (old[lane] & (_MISS - 1))
                old[lane] = to
                lane, state = lane[apart], state[apart]
                if not len(lane):
                    break
            # Lanes that end in another state than before change what comes after them.
            again = lane + 1
            again = again[again < n]
            again = again[goes_on[again]]
        return (path >> 30).sum(0)


def predict(docs: DataFrame, texts: dict[str, str], text: str = "text") -> DataFrame:
    """docs with lang_pred, score and phrases, the phrases a character by language."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "phrases")]
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("phrases", T.MapType(T.StringType(), T.DoubleType()))]
    schema = T.StructType([docs.schema[c] for c in kept] + new)

    bounded(docs.sparkSession)

    def run(batches):
        m = Model(texts)
        names = np.array([*m.labels, "und"], object)
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            at = 0
            for t in slices([whole], text, LIMIT):
                rate, worth = m.phrases([x.decode("utf-8", "replace") for x in t[text].to_pylist()])
                if len(m.labels):
                    best = rate.argmin(1)
                    two = np.sort(rate, 1)[:, :2]
                    score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-12) if len(m.labels) > 1 else np.ones(len(rate))
                else:
                    best, score, worth = np.zeros(len(rate), int), np.zeros(len(rate)), np.zeros(len(rate), bool)
                pred = names[np.where(worth, best, len(names) - 1)]
                out = whole.slice(at, t.num_rows)
                at += t.num_rows
                columns = [out[c].combine_chunks() for c in kept]
                phrases = pa.MapArray.from_arrays(
                    pa.array(np.arange(len(rate) + 1, dtype=np.int32) * len(m.labels), pa.int32()), pa.array(m.labels * len(rate), pa.string()), pa.array(rate.ravel(), pa.float64())
                )
                columns += [pa.array(pred, pa.string()), pa.array(np.where(worth, np.clip(score, 0, 1), 0.0)), phrases]
                yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=pa.schema([pa.field(n, c.type) for n, c in zip([*kept, "lang_pred", "score", "phrases"], columns, strict=True)]))

    return docs.select(*kept).mapInArrow(run, schema)


def held_out(n: int):
    return crc_mod("doc_id", n) == 0


def query(spark, sf_dir: str) -> DataFrame:
    """op9: a prediction for every row of `documents`, learnt from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    texts = sample(docs.filter(~held_out(5)))
    done = predict(docs.select("doc_id", "text"), texts)
    return done.select("doc_id", held_out(5).alias("held_out"), "lang_pred", "score")
