"""Byte-level BPE by a pair occurrence index.

The distinct pieces (pre-tokens) of a slice of texts are laid out as one array of symbols.
Every pair of neighbours that has a rank is filed under that rank with all its positions; the
active ranks are applied in ascending order, each to all its positions at once, and the pairs
that a merge creates are filed in turn. Ranks of pairs with a merged symbol are higher than
the rank that made it, so this ends as merging each piece by itself would. The tokens of a
text are then gathered from those of its pieces, and decoding joins the bytes of its tokens.

The vocabulary file is read on the driver from `path`, a parameter, and sent to the workers; texts are taken whole.
Defined cases: a null text counts as the empty one: no ids, empty decoded text; a very long text is a slice of its own; damaged
UTF-8 has replacement marks. A special token's string in a text becomes that token, as the library does by default. There are no
ties: of equal pairs in a run the first merges. Extra columns are passed through;
input columns named ids or decoded are replaced; repeated rows are encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faturaflow.llm.arrowtext import ragged, slices
from faturaflow.llm.common import bounded, table

#: The split of texts into pieces that byte-level BPE vocabularies of this kind fix.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text of a slice, and positions that are ranked at a time: both bound what a worker holds.
LIMIT, SPAN = 1 << 20, 1 << 16


def _shown() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges, ids and special tokens of a vocabulary file's text."""

    def __init__(self, file: str):
        spec = json.loads(file)
        ids = spec["model"]["vocab"]
        shown = _shown()
        self.of_byte = np.array([ids[c] for c in shown], np.int64)
        byte = {c: b for b, c in enumerate(shown)}
        self.bytes = [b""] * (1 + max([*ids.values(), *(x["id"] for x in spec["added_tokens"])]))
        for token, i in ids.items():
            self.bytes[i] = bytes(byte[c] for c in token)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.rank_type = np.min_scalar_type(len(keys))  # two bytes are sorted by counting
        self.pieces = regex.compile(PIECES).findall

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = np.empty(len(left), np.int32)
        for lo in range(0, len(left), SPAN):
            key = left[lo : lo + SPAN].astype(np.int64) << 32 | right[lo : lo + SPAN]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found[lo : lo + SPAN] = np.where(self.keys[at] == key, self.order[at], -1)
        return found


def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(Path(path).read_text("utf-8"))


_OWN: dict[str, Vocabulary] = {}


def _own(digest: str, shared) -> Vocabulary:
    """The vocabulary of a broadcast file, made once in a worker."""
    if digest not in _OWN:
        _OWN.clear()
        _OWN[digest] = Vocabulary(shared.value)
    return _OWN[digest]


def merge(v: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces one after another, and how many each has."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    n = int(sizes.sum())
    place = np.int32 if n < 1 << 31 else np.int64
    symbol = v.of_byte.astype(np.int32)[np.frombuffer(b"".join(pieces), np.uint8)]
    piece = np.repeat(np.arange(len(pieces), dtype=place), sizes)
    after, before = np.arange(1, n + 1, dtype=place), np.arange(-1, n - 1, dtype=place)
    ends = np.cumsum(sizes)[sizes > 0]
    after[ends - 1] = -1
    before[(ends - sizes[sizes > 0])] = -1
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def file(at: np.ndarray) -> None:
        rank = v.rank(symbol[at], symbol[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        if len(at) > 1:
            order = np.argsort(rank.astype(v.rank_type), kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            groups = np.split(at, cuts)
            ranks = rank[np.concatenate([[0], cuts])].tolist()
        else:
            groups, ranks = [at], rank.tolist()
        for r, g in zip(ranks, groups, strict=True):
            if r in index:
                index[r].append(g)
            else:
                index[r] = [g]
                heapq.heappush(active, r)

    file(np.flatnonzero(after >= 0))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b, new = v.left[r], v.right[r], v.made[r]
        at = at[symbol[at] == a]
        nxt = after[at]
        ok = (nxt >= 0) & (symbol[nxt] == b)
        at, nxt = at[ok], nxt[ok]
        if not len(at):
            continue
        if a == b and len(at) > 1:  # in a run such as aaa the first two merge
            linked = np.concatenate([[False], at[1:] == nxt[:-1]])
            start = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
            take = (np.arange(len(at)) - start) % 2 == 0
            at, nxt = at[take], nxt[take]
        symbol[at], symbol[nxt] = new, -1
        far = after[nxt]
        after[at] = far
        more = far >= 0
        before[far[more]] = at[more]
        back = before[at]
        touched = np.concatenate([at[more], back[back >= 0]])
        if len(touched):
            file(np.unique(touched) if len(touched) > 1 else touched)
    alive = symbol >= 0
    return symbol[alive], np.bincount(piece[alive], minlength=len(pieces))


def encode(v: Vocabulary, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text (uint32)."""
    seen: dict[str, int] = defaultdict()
    seen.default_factory = seen.__len__
    seen[""]  # pieces are never empty; slot 0 stays free
    of_special = {}
    rows, counts = [], []
    for text in texts:
        if v.split is not None and any(s in text for s in v.special):
            found: list[int] = []
            for part in v.split.split(text):
                if part in v.special:
                    found.append(of_special.setdefault(part, -1 - len(of_special)))
                else:
                    found += map(seen.__getitem__, v.pieces(part))
            row = np.array(found, np.int64)
        else:
            row = np.fromiter(map(seen.__getitem__, v.pieces(text)), np.int64)
        rows.append(row)
        counts.append(len(row))
    ids, n = merge(v, [x.encode() for x in seen])
    ids = np.concatenate([ids, np.array([v.special[s] for s in reversed(of_special)], np.int64)]).astype(np.uint32)
    n = np.concatenate([n, np.ones(len(of_special), np.int64)])
    starts = np.cumsum(n) - n
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    each = n[flat]  # a negative index counts from the end, where the special tokens are
    tokens = ids[ragged(starts[flat], each)] if len(flat) else np.zeros(0, np.uint32)
    lengths = np.concatenate([[0], np.cumsum(each)])
    cuts = lengths[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
    return [tokens[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    return b"".join(map(v.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs without the text, with ids (little-endian unsigned 32-bit integers) and decoded (string)."""
    kept = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    bounded(docs.sparkSession)
    file = Path(path).read_text("utf-8")
    digest, shared = hashlib.sha256(file.encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(file)

    def run(batches):
        v = _own(digest, shared)
        for t in slices(batches, text, LIMIT):
            ids = encode(v, [x.decode("utf-8", "replace") for x in t[text].to_pylist()])
            columns = [t[c].combine_chunks() for c in kept]
            columns += [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([decode(v, x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], [*kept, "ids", "decoded"])

    return docs.select(*kept, text).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the digest of `documents` under the 50k vocabulary."""
    import public_tokenizers

    done = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
