"""N-gram Jaccard join by token-combination prefixes, and the groups it links.

A document's set is that of its distinct N-word shingles; two documents link when
100 * intersection >= 100 * THRESHOLD * union. The exact join runs in these steps:

1. Documents with equal word sequences are one: the smallest id stands for all (an aggregate,
   so a text that a third of the rows share is merged before it is shuffled).
2. The document frequency of every shingle is counted corpus-wide (see scatter).
3. Tokens are ordered rare first. A set of s shingles that may miss t of them keeps the
   shortest prefix whose signatures t misses cannot all destroy. Rare shingles (at most RARE
   documents) sign alone, and those of one document only extend the prefix unsigned. Frequent
   shingles are dealt by hash into about t classes and sign as pairs within a class: a class
   of n shingles counts n - 1 towards the prefix, which is extended by what classes cost. The
   number of classes follows the size step of the set; neighbouring steps share signatures.
4. In each signature's list all members are paired with a hub and verified, in STARS passes
   with other hubs; only lists whose members still lie in different groups go on. What stays
   open, without the hubs, is put together where lists overlap and compared block by block within a list: the shared counts of two blocks are one matrix
   product, and blocks of one group are not compared. So a large group of near copies never
   becomes rows of pairs, and documents that share no signature never meet.

Verification intersects the full shingle sets (64-bit hashes). Sets are whole.

A node of the graph is a word sequence, named by a 64-bit hash; its class is named by the smallest id of the
documents whose sequences its links reach.

Defined cases: words are lower-cased A-Z; null texts and texts without words have no set and
link with nothing; shorter texts than N words have their whole sequence as one shingle; every row is a document of its own,
whether its id is null or repeats, so several texts of one id have a class each; ids have any type with an order, and null ones come
last: a class of rows without ids has none; very long texts are slices of their own; damaged UTF-8 is compared as it is;
extra columns are passed through by `one_of_each` whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faturaflow.llm import scatter as S
from faturaflow.llm.arrowtext import Hasher, U, Words, by_two, crossing, mix, runs, slices, spans
from faturaflow.llm.common import bounded, table, written
from faturaflow.llm.components import components
from faturaflow.llm.substring_dedup import buckets

N, THRESHOLD, RARE = 5, 80, 64
#: Sets up to SMALL shingles sign with single tokens of every kind.
SMALL = 8
#: Passes with hubs before what is left is compared block by block; members and shingles of a block.
STARS, BLOCK, BLOCK_SHINGLES = 2, 512, 400_000
#: Passes that put lists with many members in common together before they are cut into blocks.
UNIONS = 2
_A, _B = Hasher(21), Hasher(22)


def shingles(words: Words, h: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document number, shingle hash) pairs, sorted by both."""
    count = words.count
    owner = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero(crossing(words.first, len(h), n))
    doc, key = owner[at], _A.windows(h, n)[at]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):  # the whole sequence is the one shingle; its length is part of the hash
        sums = np.array([_fold(h[words.first[i] : words.first[i + 1]]) for i in short], U)
        doc, key = np.concatenate([doc, short]), np.concatenate([key, sums])
    order = by_two(doc, key)
    doc, key = doc[order], key[order]
    if len(doc):
        first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
        doc, key = doc[first], key[first]
    return doc, key


def _fold(h: np.ndarray) -> int:
    total = len(h)
    for x in h.tolist():
        total = (total * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([total], U))[0])


def _sequence(words: Words, h: np.ndarray, by: Hasher) -> np.ndarray:
    """A hash of each document's word sequence."""
    up, down = by.words.of(len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[:-1], out=total[1:])
    a, b = words.first[:-1], words.first[1:]
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(U))


def _keyed(docs: DataFrame, kept: dict, n: int, text: str, sizes: bool) -> DataFrame:
    """The columns `kept` (name: column) of docs, k1 and k2, which hash the word sequence and are null without words, and n_shingles if `sizes`."""
    schema = docs.select(*[c.alias(name) for name, c in kept.items()]).schema
    schema = T.StructType([*schema, T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), *([T.StructField("n_shingles", T.LongType())] if sizes else [])])
    own = list(kept)
    names = [*own, "k1", "k2", *(["n_shingles"] if sizes else [])]

    def run(batches):
        for batch in batches:
            whole, at = pa.Table.from_batches([batch]), 0
            for t in slices([whole], "__text", 1 << 20):
                out, at = whole.slice(at, t.num_rows), at + t.num_rows
                words = Words(t["__text"], lower=True)
                h = words.hashes(_A)
                none = words.count == 0
                new = [pa.array(_sequence(words, x, by).view(np.int64), mask=none) for x, by in ((h, _A), (words.hashes(_B), _B))]
                if sizes:
                    new.append(pa.array(np.bincount(shingles(words, h, n)[0], minlength=t.num_rows), pa.int64()))
                columns = [out[c].combine_chunks() for c in own]
                yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns] + new, names)

    bounded(docs.sparkSession)
    return docs.select(*[c.alias(name) for name, c in kept.items()], F.col(text).alias("__text")).mapInArrow(run, schema)


def identities(docs: DataFrame, n: int = N, text: str = "text", plan: S.Plan | None = None) -> DataFrame:
    """(doc_id, batch, k1, k2, n_shingles), a row each of docs; k1, k2 hash the word sequence, null without words."""
    return _keyed(docs, {"doc_id": F.col("doc_id"), "batch": S.batch_of(S.key_of("doc_id", text), plan or S.plan_for(docs, text))}, n, text, True)


def _level(size: np.ndarray) -> np.ndarray:
    """Step of a set's size; sets that can link are at most one step apart."""
    return np.floor(np.log(np.maximum(size, 1)) / np.log(100 / THRESHOLD) + 1e-9).astype(np.int64)


def _classes(level: int) -> int:
    return max(1, round((100 - THRESHOLD) / 100 * (100 / THRESHOLD) ** level))


def signatures(keys: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """The signatures of one set: its shingle hashes and their frequency steps (0: one document only)."""
    s = len(keys)
    misses = s - -(-THRESHOLD * s // 100)
    order = by_two(freq, keys)
    keys, freq = keys[order], freq[order]
    common = freq > _STEP
    rare = int(len(keys) - common.sum())
    if rare > misses:  # t misses cannot destroy t + 1 single tokens
        own = freq[: misses + 1] > 0
        return keys[: misses + 1][own]
    made = [keys[:rare][freq[:rare] > 0]]
    often = keys[rare:]
    if s <= 10 * SMALL // 8:
        made.append(often)
        if s <= SMALL:
            return np.concatenate(made)
    level = int(_level(np.array([s]))[0])
    for step in (level - 1, level):
        if step < 0:
            continue
        n_classes = _classes(step)
        kind = (often % U(n_classes)).astype(np.int64)
        # Prefix: a class of n counts n - 1, so the first token of a class adds nothing.
        new = np.zeros(len(often), bool)
        new[np.unique(kind, return_index=True)[1]] = True
        worth = rare + np.cumsum(~new)
        end = int(np.searchsorted(worth, misses + 1)) + 1 if len(worth) and worth[-1] > misses else len(often)
        tokens, kind = often[:end], kind[:end]
        by = np.argsort(kind, kind="stable")
        tokens, kind = tokens[by], kind[by]
        salt = U((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        for gap in range(1, int(np.bincount(kind).max(initial=0))):
            both = kind[gap:] == kind[:-gap]
            a, b = tokens[:-gap][both], tokens[gap:][both]
            made.append(mix(mix(np.minimum(a, b) + salt) + np.maximum(a, b)))
    return np.concatenate(made)


_STEP = 1 + int(np.log2(RARE))


def _steps(total: np.ndarray) -> np.ndarray:
    """0 for a shingle of one document, else 1 + floor(log2(documents))."""
    return np.where(total > 1, 1 + np.floor(np.log2(np.maximum(total, 1))), 0).astype(np.uint8)


def signed(docs: DataFrame, ids: DataFrame, plan: S.Plan, n: int = N, text: str = "text") -> DataFrame:
    """(node, size, signatures, shingles) of the word sequences that another may resemble."""
    bits = plan.bits
    batches = S.packed(docs, plan, text, names=[text])
    heads = ids.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("batch").alias("batch"))  # one batch speaks for all copies
    heads = heads.groupBy("batch").agg(F.collect_list("k1").alias("x"))
    heads = heads.select("batch", F.lit(-1).alias("bucket"), F.lit(0).alias("kind"), F.encode(F.to_json("x"), "utf-8").alias("data"))

    def sets(t: pa.Table, replies: pa.Table):
        """Sets of the batch's own sequences: names by document number, document numbers, shingle keys."""
        known = np.array(json.loads(S.answered(replies, 0).get(-1, b"[]")), np.int64)
        words = Words(t[text], lower=True)
        h = words.hashes(_A)
        k1 = _sequence(words, h, _A).view(np.int64)
        mine = np.zeros(len(k1), bool)
        at = np.flatnonzero((words.count > 0) & np.isin(k1, known))
        mine[at[np.unique(k1[at], return_index=True)[1]]] = True
        doc, key = shingles(words, h, n)
        own = mine[doc]
        return k1, doc[own], key[own]

    def distinct(key: np.ndarray):
        low = np.sort(key >> U(32 - bits))
        first = runs(low)
        return low[first], np.diff(np.append(first, len(low)))

    def send(batch: int, t: pa.Table, replies: pa.Table) -> pa.Table:
        keys, times = distinct(sets(t, replies)[2])
        low, times = (keys & U(0xFFFFFFFF)).astype(np.uint32), times.astype(np.uint32)
        return S.sent(batch, [(k, b - a, S.planes(low[a:b]) + S.planes(times[a:b])) for k, a, b in S.by_bucket(buckets(keys, bits, 32))])

    def count(bucket: int, rows: pa.Table) -> pa.Table:
        size, data, batch = rows["n"].to_numpy(), rows["data"].to_pylist(), rows["batch"].to_pylist()
        keys = np.concatenate([S.unplanes(d, np.uint32, k) for d, k in zip(data, size, strict=True)])
        times = np.concatenate([S.unplanes(d, np.uint32, k, 4 * k) for d, k in zip(data, size, strict=True)]).astype(np.int64)
        order = np.argsort(keys)
        first = runs(keys[order])
        step = np.empty(len(keys), np.uint8)
        step[order] = np.repeat(_steps(np.add.reduceat(times[order], first)), np.diff(np.append(first, len(keys))))
        ends = np.cumsum(size)
        return S.answers([(batch[i], bucket, 1, m.tobytes()) for i in range(len(size)) if (m := step[ends[i] - size[i] : ends[i]]).any()])

    def sign(batch: int, t: pa.Table, replies: pa.Table) -> pa.Table:
        names, doc, key = sets(t, replies)
        keys = distinct(key)[0]
        step = np.zeros(len(keys), np.uint8)
        told = S.answered(replies, 1)
        for k, a, b in S.by_bucket(buckets(keys, bits, 32)):
            if k in told:
                step[a:b] = np.frombuffer(told[k], np.uint8)
        freq = step[np.searchsorted(keys, key >> U(32 - bits))] if len(keys) else step
        out = []
        for a, b in spans(doc):
            own = freq[a:b]
            # Without enough shared shingles no other document can be similar.
            if (own > 0).sum() * 100 < THRESHOLD * (b - a):
                continue
            signs = signatures(key[a:b], own)
            if len(signs):
                out.append((names[doc[a]], int(b - a), signs.view(np.int64), key[a:b].view(np.int64)))
        return pa.table(
            {
                "node": pa.array([x[0] for x in out], pa.int64()),
                "size": pa.array([x[1] for x in out], pa.int64()),
                "signatures": pa.array([x[2] for x in out], pa.list_(pa.int64())),
                "shingles": pa.array([x[3] for x in out], pa.list_(pa.int64())),
            }
        )

    sent = S.gather(batches, heads, send, S.SENT)
    replies = S.reduce_buckets(sent, count).unionAll(heads)
    return S.gather(batches, replies, sign, "node long, size long, signatures array<long>, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    same = F.size(F.array_intersect("x", "y"))
    return both.withColumn("same", same).filter(100 * F.col("same") >= THRESHOLD * (F.size("x") + F.size("y") - F.col("same"))).select("a", "b")


def _open(lists: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists whose members lie in different groups, with each member's group; and all groups.

    What joins a list's members is written first: a join of two plain tables can be split where a list is long.
    """
    group = written(components(edges), "groups", small=True)
    member = lists.select("sig", "node", "size").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = written(member, "members", small=True)
    mixed = member.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("sig")
    return written(member.join(written(mixed, "mixed", small=True), "sig"), "open", small=True), group


def _stars(lists: DataFrame, salt: int) -> DataFrame:
    """(a, b): every member of a list beside its hub, the member with the smallest hash."""
    hub = F.min(F.struct(F.xxhash64("node", F.lit(salt)).alias("o"), F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("component").alias("component_b")))
    hubs = lists.groupBy("sig").agg(hub.alias("x"), F.count("*").alias("k")).filter("k > 1").select("sig", "x.b", "x.size_b", "x.component_b")
    fits = 100 * F.least("size", "size_b") >= THRESHOLD * F.greatest("size", "size_b")
    both = lists.join(written(hubs, "hubs", small=True), "sig")
    return both.filter((F.col("component") != F.col("component_b")) & fits).select(F.col("node").alias("a"), "b").distinct()


def groups(docs: DataFrame, ids: DataFrame, plan: S.Plan, n: int = N, text: str = "text") -> DataFrame:
    """(node, component) of the word sequences that link with another."""
    sets = written(signed(docs, ids, plan, n, text), "sets")
    lists = sets.select(F.explode("signatures").alias("sig"), "node", "size", F.col("node").alias("component"))
    edges = None
    for salt in range(STARS):
        new = written(_verified(_stars(lists, salt), sets), "links")
        edges = new if edges is None else edges.unionAll(new)
        lists, group = _open(lists, edges)
        if lists.isEmpty():
            return group
    rest = written(_rest(lists, sets), "links")
    return group if rest.isEmpty() else components(edges.unionAll(rest))


def _blocks(n="n", total="total"):
    return F.ceil(F.greatest(F.col(n) / BLOCK, F.col(total) / BLOCK_SHINGLES))


def _united(lists: DataFrame, salt: int) -> DataFrame:
    """(sig, node, size, component): lists with the same smallest hash as one list of all their members.

    Lists that overlap have it in common most often. All pairs of each list are pairs of the union. It stays apart where the union would be
    more rows to compare, or more pairs, than its lists: those of one member that have nothing else in common.
    """
    own = lists.groupBy("sig").agg(F.min(F.struct(F.xxhash64("node", F.lit(salt)).alias("o"), "node"))["node"].alias("head"), F.count("*").alias("n"), F.sum("size").alias("total"))
    own = written(own, "heads", small=True)
    apart = own.groupBy("head").agg(F.sum(F.col("n") * _blocks()).alias("rows"), F.sum(F.col("n") * F.col("n")).alias("pairs"), F.count("*").alias("k")).filter("k > 1")
    member = lists.join(own.select("sig", "head"), "sig")
    union = written(member.groupBy("head", "node").agg(F.first("size").alias("size"), F.first("component").alias("component")), "unions", small=True)
    size = union.groupBy("head").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    one = size.join(apart, "head").filter((F.col("n") * _blocks() <= F.col("rows")) & (F.col("n") * F.col("n") <= F.col("pairs"))).select("head")
    one = written(one, "united", small=True)
    stay = member.join(one, "head", "left_anti").select("sig", "node", "size", "component")
    # Should a union's name be a list's, they are one list: more pairs are compared, none is lost.
    new = union.join(one, "head").select(F.xxhash64("head", F.lit(salt), F.lit("union")).alias("sig"), "node", "size", "component")
    return written(stay.unionAll(new), "members", small=True)


def _rest(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the groups that the stars have not merged.

    A list's hubs have met all its members and leave it. Members of a list that lie in different groups are compared; of lists with the same members one does,
    and lists that overlap are put together. A list is cut into blocks, and a group that fills blocks has blocks of its own: two blocks of one group need no comparison.
    A task holds two blocks.
    """
    hub = lambda salt: F.min(F.struct(F.xxhash64("node", F.lit(salt)).alias("o"), F.col("node").alias("b")))["b"].alias(f"hub{salt}")
    hubs = written(lists.groupBy("sig").agg(*map(hub, range(STARS))), "hubs", small=True)
    left = lists.join(hubs, "sig").filter(~reduce(or_, [F.col("node") == F.col(f"hub{salt}") for salt in range(STARS)]))
    left = written(left.select("sig", "node", "size", "component"), "left", small=True)
    mixed = left.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("sig")
    lists = left.join(written(mixed, "mixed", small=True), "sig")
    alike = lists.groupBy("sig").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("y"))
    one = written(alike.groupBy("n", "x", "y").agg(F.min("sig").alias("sig")).select("sig"), "lists", small=True)
    own = written(lists.select("sig", "node", "size", "component").join(one, "sig"), "members", small=True)
    for salt in range(STARS, STARS + UNIONS):
        own = _united(own, salt)
    many = own.groupBy("sig", "component").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    many = many.withColumn("own_blocks", _blocks())
    pooled = many.filter("own_blocks = 1").groupBy("sig").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    many = written(many.join(pooled.select("sig", _blocks().alias("pool_blocks")), "sig", "left").select("sig", "component", "own_blocks", "pool_blocks"), "blocks", small=True)
    own = own.join(many, ["sig", "component"])
    pool = F.col("own_blocks") == 1
    own = own.withColumn("kin", F.when(pool, F.lit(None).cast("long")).otherwise(F.col("component")))
    count = F.when(pool, F.col("pool_blocks")).otherwise(F.col("own_blocks")).cast("long")
    own = own.withColumn("block", F.xxhash64("sig", "kin", F.pmod(F.xxhash64("node", F.lit(7)), count)))
    own = written(own.select("sig", "node", "component", "kin", "block"), "blocked", small=True)
    there = written(own.select("sig", F.col("kin").alias("other_kin"), F.col("block").alias("other")).distinct(), "there", small=True)
    pairs = own.join(there, "sig").filter(F.col("kin").isNull() | ~F.col("kin").eqNullSafe(F.col("other_kin")))
    task = F.xxhash64("sig", F.least("block", "other"), F.greatest("block", "other"))
    rows = pairs.select("node", "component", "block", task.alias("task")).join(sets.select("node", "shingles"), "node")
    return rows.groupBy("task").applyInArrow(_compare, "a long, b long")


def _compare(rows: pa.Table) -> pa.Table:
    """A spanning forest of the links between documents of different groups, and of different blocks if there are two."""
    ids, group, block = (rows[c].to_numpy() for c in ("node", "component", "block"))
    column = rows["shingles"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy()).astype(np.int64)
    keys, place = np.unique(column.flatten().to_numpy(), return_inverse=True)
    owner = np.repeat(np.arange(len(ids)), size)
    shared = np.bincount(place) > 1
    slot = np.cumsum(shared) - 1
    keep = shared[place]
    owner, place = owner[keep], slot[place[keep]]
    order = np.argsort(place)
    owner, place = owner[order], place[order]
    same = np.zeros((len(ids), len(ids)), np.float32)
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(place, [lo, lo + width])
        m = np.zeros((len(ids), width), np.float32)
        m[owner[a:b], place[a:b] - lo] = 1
        same += m @ m.T
    near = 100 * same.astype(np.int64) >= THRESHOLD * (size[:, None] + size[None, :] - same.astype(np.int64))
    near &= group[:, None] != group[None, :]
    if (block != block[0]).any():
        near &= block[:, None] != block[None, :]
    out_a, out_b, open_ = [], [], near.any(1)
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
    none = np.zeros(0, np.int64)
    return pa.table({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})


def _classes_of(docs: DataFrame, n: int, text: str) -> tuple[DataFrame, DataFrame]:
    """The identities of all rows, and (k1, k2, component) of all word sequences."""
    plan = S.plan_for(docs, text)
    ids = written(identities(docs, n, text, plan), "identities")
    group = groups(docs, ids, plan, n, text).withColumnRenamed("node", "k1")
    nodes = ids.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("first"))
    return ids, nodes.join(group, "k1", "left").withColumn("component", F.coalesce("component", "k1"))


def classes(docs: DataFrame, n: int = N, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row each of docs: the class is the smallest id that links reach."""
    ids, nodes = _classes_of(docs, n, text)
    names = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    nodes = written(nodes.join(names, "component").select("k1", "k2", "component_id"), "classes", small=True)
    all_ = ids.join(nodes, ["k1", "k2"], "left")
    return all_.select("doc_id", "n_shingles", F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = N, text: str = "text") -> DataFrame:
    """docs with exactly one row of each class, that with the smallest id, null ids last; rows without words all stay.

    The row is found by its id and word sequence. Rows that share both meet in one task, one is kept.
    """
    ids, nodes = _classes_of(docs, n, text)
    least = F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first"), "k1", "k2")).alias("x")
    head = written(nodes.groupBy("component").agg(least).select("x.first", "x.k1", "x.k2"), "heads", small=True)
    kept = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    said = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = _keyed(docs.filter(said), kept | {"__id": F.col("doc_id")}, n, text, False)
    mine = rows.join(head, F.col("__id").eqNullSafe(F.col("first")) & (rows["k1"] == head["k1"]) & (rows["k2"] == head["k2"]), "left_semi")
    mine = mine.withColumn("__n", F.row_number().over(W.partitionBy("__id", "k1", "k2").orderBy(F.lit(0)))).filter("__n = 1")
    return mine.select(*kept).toDF(*docs.columns).unionAll(docs.filter(~said))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the class of every row of `documents`."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def sql() -> str:
    """The digest in DuckDB's SQL, from all pairs that share a shingle."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{{20}}\x{{9}}-\x{{D}}]+') AS ws FROM documents),
u AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {N - 2}, 2))) AS p FROM d WHERE len(ws) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(ws, p, p + {N - 1}), ' ')) AS g FROM u),
z AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM i JOIN z zx ON x = zx.doc_id JOIN z zy ON y = zy.doc_id WHERE 100 * i.n >= {THRESHOLD} * (zx.n + zy.n - i.n)),
b AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
c AS (SELECT DISTINCT x AS node, x AS root FROM b UNION SELECT b.y, c.root FROM c JOIN b ON b.x = c.node),
r AS (SELECT node, min(root) AS root FROM c GROUP BY node)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(r.root, d.doc_id) AS component_id
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN r ON r.node = d.doc_id"""
