"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A segment tree over the byte positions of a pre-token holds in each leaf the rank of the merge of the live
part that starts there with the next live part, and in each inner node the smaller of its children; the root
is therefore the lowest rank, and a tie goes to the leftmost leaf.  A merge takes the right part out of the
list of live parts and makes point updates, logarithmic in the length, for the merged part, its left
neighbour and the part that went.

There are two forms of the same tree.  ``encode_one`` walks one pre-token.  ``encode_many`` holds the trees of
many pre-tokens of similar length as rows of a matrix and merges once in each of them per step.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import map_batches

_NONE = np.int64(1) << 40
#: Pre-tokens of up to this many bytes are encoded as rows of a matrix, longer ones singly.
ROW_BYTES = 64
#: Distinct pre-tokens that a worker remembers before it starts afresh.
CACHE_WORDS = 150_000


class BytePairs:
    """Ranks of a byte-level vocabulary and the merges that they imply.

    ``left, right -> merged`` is a merge exactly if the concatenated bytes are a token; its rank is the token's.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.name_of = {r: str(r) for r in ranks.values()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pair[left, right] = rank
        keys = np.array([a << 20 | b for a, b in self.pair], np.int64)
        vals = np.fromiter(self.pair.values(), np.int64, len(self.pair))
        order = np.argsort(keys)
        self.keys, self.vals = np.append(keys[order], np.iinfo(np.int64).max), np.append(vals[order], _NONE)

    @classmethod
    def load(cls, path: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode_one(self, word: bytes) -> list[int]:
        """Ids of one pre-token by a scalar segment tree."""
        n = len(word)
        if n == 0:
            return []
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        size = 1 << max(0, (n - 1).bit_length())
        none, rank_of = int(_NONE), self.pair.get
        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = rank_of((ids[i], ids[i + 1]), none)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, rank: int) -> None:
            k = size + i
            tree[k] = rank
            k >>= 1
            while k:
                low = tree[2 * k] if tree[2 * k] <= tree[2 * k + 1] else tree[2 * k + 1]
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while (rank := tree[1]) < none:
            k = 1
            while k < size:  # down to the leftmost leaf that holds the minimum
                k = 2 * k if tree[2 * k] == rank else 2 * k + 1
            i = k - size
            gone = after[i]
            ids[i], after[i] = rank, after[gone]
            if after[i] < n:
                before[after[i]] = i
            put(gone, none)
            put(i, rank_of((rank, ids[after[i]]), none) if after[i] < n else none)
            if before[i] >= 0:
                put(before[i], rank_of((ids[before[i]], rank), none))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.vals[at], _NONE)

    def encode_many(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token; the trees of similar lengths advance together."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.nonzero(lengths > ROW_BYTES)[0]:
            out[i] = self.encode_one(words[i])
        size = 2
        while size <= ROW_BYTES:
            mine = np.nonzero((lengths > size // 2) & (lengths <= size) if size > 2 else (lengths > 0) & (lengths <= 2))[0]
            if len(mine):
                for i, ids in zip(mine.tolist(), self._rows([words[i] for i in mine], size), strict=True):
                    out[i] = ids
            size *= 2
        return out

    def _rows(self, words: list[bytes], size: int) -> list[list[int]]:
        n, width = len(words), size + 2  # positions -1 and size stand for "none" at either side
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
        ids = np.full((n, width), (1 << 20) - 1, np.int64)  # an id that no pair has
        ids[:, 1 : size + 1] = np.where(np.arange(size) < lengths[:, None], self.byte_id[raw], (1 << 20) - 1)
        after = np.tile(np.minimum(np.arange(1, width + 1), size + 1).astype(np.int32), (n, 1))
        before = np.tile(np.maximum(np.arange(-1, width - 1), 0).astype(np.int32), (n, 1))
        tree = np.full((n, 2 * size), _NONE, np.int64)
        tree[:, size:] = self._ranks(ids[:, 1 : size + 1].ravel(), ids[:, 2:].ravel()).reshape(n, size)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        live = np.ones((n, width), bool)

        def put(rows: np.ndarray, leaf: np.ndarray, rank: np.ndarray) -> None:
            k = size + leaf
            tree[rows, k] = rank
            while k[0] > 1:  # all leaves are on one level
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        rows = np.nonzero(tree[:, 1] < _NONE)[0]
        while len(rows):
            rank = tree[rows, 1]
            k = np.ones(len(rows), np.int64)
            while k[0] < size:
                k = 2 * k + (tree[rows, 2 * k] != rank)
            leaf = k - size
            i = leaf + 1
            gone = after[rows, i]
            nxt, prev = after[rows, gone], before[rows, i]
            ids[rows, i] = rank
            after[rows, i] = nxt
            before[rows, nxt] = i
            live[rows, gone] = False
            put(rows, gone - 1, np.full(len(rows), _NONE))
            put(rows, leaf, self._ranks(rank, ids[rows, nxt]))
            has = prev > 0
            if has.any():
                put(rows[has], prev[has] - 1, self._ranks(ids[rows[has], prev[has]], rank[has]))
            rows = rows[tree[rows, 1] < _NONE]
        keep = live[:, 1 : size + 1] & (np.arange(size) < lengths[:, None])
        flat, counts = ids[:, 1 : size + 1][keep].tolist(), keep.sum(1).tolist()
        out, at = [], 0
        for c in counts:
            out.append(flat[at : at + c])
            at += c
        return out


class Codec:
    """Whole texts to ids and back; remembers pre-tokens, bounded by CACHE_WORDS."""

    def __init__(self, pairs: BytePairs, pattern: str):
        self.pairs, self.find = pairs, regex.compile(pattern).findall
        self.said: dict[str, str] = {}
        self.back: dict[str, bytes] = {}

    def forget(self) -> None:
        self.said.clear()
        self.back.clear()

    def learn(self, words: set[str]) -> None:
        if len(self.said) > CACHE_WORDS:
            self.forget()
        new = [w for w in words if w not in self.said]
        said, back, name, decode = self.said, self.back, self.pairs.name_of.__getitem__, self.pairs.decode
        for w, ids in zip(new, self.pairs.encode_many([w.encode() for w in new]), strict=True):
            said[w], back[w] = " ".join(map(name, ids)), decode(ids)

    def rows(self, texts: list[str | None]) -> list[tuple[int, str, bytes]]:
        """For each text: number of ids, the decimal ids joined by one space, the bytes decoded from them."""
        found = [self.find(t) if t else [] for t in texts]
        self.learn(set().union(*found))
        said, back, out = self.said.__getitem__, self.back.__getitem__, []
        for f in found:
            ids = " ".join(map(said, f))
            out.append((ids.count(" ") + 1 if ids else 0, ids, b"".join(map(back, f))))
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a vocabulary file; the file is part of the installation of every executor."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(BytePairs.load(path), pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again: one pass, no shuffle.

    Rows ``doc_id, n_tokens, ids (array<int>, if asked for), ids_sha256, decoded_sha256``.  A null or empty text
    has no ids and the hashes of no bytes; null ids and repeated rows are passed through row by row; other
    columns of ``docs`` are not read.  A text of any length is encoded whole.
    """
    schema = "doc_id bigint, n_tokens bigint, " + ("ids array<int>, " if ids else "") + "ids_sha256 string, decoded_sha256 string"

    def run(batch: pa.RecordBatch) -> dict:
        rows = codec(vocabulary, pattern).rows(batch.column(1).to_pylist())
        out = {
            "doc_id": batch.column(0),
            "n_tokens": pa.array([n for n, _, _ in rows], pa.int64()),
            "ids_sha256": [hashlib.sha256(s.encode()).hexdigest() for _, s, _ in rows],
            "decoded_sha256": [hashlib.sha256(b).hexdigest() for _, _, b in rows],
        }
        if ids:
            out["ids"] = pa.array([list(map(int, s.split())) for _, s, _ in rows], pa.list_(pa.int32()))
        return out

    done = lambda: codec(vocabulary, pattern).forget()
    return map_batches(docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"`{text_col}` text"), run, schema, done=done)


def decode(encoded: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of arrays of ids: rows ``doc_id, text``; null ids give a null text, no ids an empty one."""

    def run(batch: pa.RecordBatch) -> dict:
        pairs = codec(vocabulary, pattern).pairs
        return {"doc_id": batch.column(0), "text": pa.array([None if x is None else pairs.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()], pa.string())}

    return map_batches(encoded.selectExpr(f"cast(`{id_col}` as bigint) id", f"`{ids_col}` ids"), run, "doc_id bigint, text string")
