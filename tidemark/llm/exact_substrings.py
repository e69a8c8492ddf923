"""Exact substring dedup: every byte under a string of ``length`` bytes that an earlier document also holds.

A suffix array would bring equal strings next to each other; here the suffixes are sorted piece by piece, so that no
machine needs the corpus:

* Anchors.  Of every window of ``length`` bytes the seed (``seed`` bytes) of least hash is an anchor; equal windows have
  equal anchors at equal places.  Anchors are a sixteenth of all positions, and only those whose seed occurs in several
  documents can lie in a repeat.
* Suffix sort.  The contexts of equal anchors are sorted by a merge sort whose comparisons use polynomial prefix hashes:
  a binary search over hash equality finds the common extension of two suffixes, and the byte behind it their order.
  What sorted neighbours share is then read off their bytes, so a collision never counts.
* Every batch of documents is first resolved by itself.  A window that repeats inside the batch is settled there, and
  only its first document goes on, so however many copies there are, a shuffle sees at most one from each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, partitions, saved, small_batches, text_key
from .shingles import mix, powers, prefix_hash

#: Bytes of text resolved together before the first shuffle, and positions hashed at a time.
BATCH_BYTES, CHUNK = 4 << 20, 1 << 18
#: Distinct contexts sorted at a time.
CLASSES = 20_000
LAST = (1 << 63) - 1


def _extreme(h: np.ndarray, w: int, op) -> np.ndarray:
    """Minimum or maximum of every run of w values, by doubling."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the seeds that are least in some window of ``length`` bytes, and their hashes."""
    w, at, of = length - seed + 1, [], []
    for lo in range(0, len(data) - seed + 1 if len(data) >= length else 0, CHUNK):  # anchors may stand behind the last window's start
        part = data[max(0, lo - length) : lo + CHUNK + 2 * length]
        shift = max(0, lo - length)
        p = prefix_hash(part)
        _, down = powers(len(part))
        h = mix((p[seed:] - p[:-seed]) * down[: len(part) - seed + 1])
        low = _extreme(h, w, np.minimum)
        edge = np.zeros(w - 1, np.uint64)
        least = _extreme(np.concatenate([edge, low, edge]), w, np.maximum) == h
        pos = np.flatnonzero(least) + shift
        mine = (pos >= lo) & (pos < lo + CHUNK)
        at.append(pos[mine])
        of.append(h[pos[mine] - shift])
    return (np.concatenate(at), np.concatenate(of)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def contexts(data: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that windows over each anchor can cover, within its document [start, end): matrix and valid columns."""
    before, width = length - seed, 2 * length - seed
    lo, hi = np.maximum(0, start - at + before), np.minimum(width, end - at + before)
    ctx, place = np.zeros((len(at), width), np.uint8), np.arange(width)
    for x in range(0, len(at), 8192):
        part = slice(x, x + 8192)
        cols = at[part, None] - before + place
        inside = (place >= lo[part, None]) & (place < hi[part, None])
        ctx[part] = np.where(inside, data[np.clip(cols, 0, len(data) - 1)], 0)
    return ctx, lo, hi


def row_hashes(ctx: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of each row of bytes, some rows at a time."""
    up, _ = powers(ctx.shape[1])
    parts = [mix((ctx[x : x + 32768].astype(np.uint64) + np.uint64(1)) @ up[: ctx.shape[1]]) for x in range(0, len(ctx), 32768)]
    return np.concatenate([np.zeros(0, np.uint64), *parts])


def _less(p: np.ndarray, ctx: np.ndarray, a: np.ndarray, b: np.ndarray, col: np.ndarray, length: int, or_equal: np.ndarray) -> np.ndarray:
    """Whether suffix a precedes suffix b (rows of ctx, both from column col), by the length of their common extension."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), length)
    pa_, pb = p[a, col], p[b, col]
    while (open_ := low < high).any():
        mid = (low + high + 1) >> 1
        same = (p[a, col + mid] - pa_) == (p[b, col + mid] - pb)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    end = np.minimum(low, length - 1)
    return np.where(low >= length, or_equal, ctx[a, col + end] < ctx[b, col + end])


def suffix_sort(p: np.ndarray, ctx: np.ndarray, col: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes from ``col`` of each row within each group: merge sort, all merges of a level at once.

    ``group`` must be sorted.  An element's place in a merged run is its place in its own run plus the number of
    elements before it in the other one, found by binary search.
    """
    order = np.arange(len(ctx))
    first = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(first, len(group)))
    base, n = np.repeat(first, size), np.repeat(size, size)
    run = 1
    while run < size.max(initial=0):
        live = np.flatnonzero(n > run)
        rank = live - base[live]
        mine = rank // run
        left = mine % 2 == 0
        other = base[live] + (mine + np.where(left, 1, -1)) * run
        stop = np.minimum(other + run, base[live] + n[live])
        has = other < stop
        live, rank, mine, left, other, stop = (x[has] for x in (live, rank, mine, left, other, stop))
        low, high = other.copy(), stop.copy()
        me = order[live]
        while len(todo := np.flatnonzero(low < high)):
            mid = (low[todo] + high[todo]) >> 1
            them = order[mid]
            before = _less(p, ctx, them, me[todo], col[me[todo]], length, ~left[todo])
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
        to = base[live] + (mine - (~left)) * run + rank % run + (low - other)
        order[to] = me
        run *= 2
    return order


def earliest(ctx: np.ndarray, lo: np.ndarray, hi: np.ndarray, seeds: np.ndarray, doc: np.ndarray, length: int, seed: int) -> np.ndarray:
    """For each anchor and each window over it whether a smaller document holds the same window: (anchors, windows)."""
    n, before, width = len(ctx), length - seed, 2 * length - seed
    out = np.zeros((n, before + 1), bool)
    if not n:
        return out
    up, _ = powers(width)
    whole = row_hashes(ctx) + (lo * 1000 + hi).astype(np.uint64)
    order = np.lexsort((whole, seeds))
    ctx, lo, hi, seeds, doc, whole = ctx[order], lo[order], hi[order], seeds[order], doc[order], whole[order]
    new = np.ones(n, bool)
    same = (seeds[1:] == seeds[:-1]) & (whole[1:] == whole[:-1])
    # Equal hashes of whole contexts count only with equal bytes; a collision starts a class of its own.
    new[1:] = ~(same & (lo[1:] == lo[:-1]) & (hi[1:] == hi[:-1]) & (ctx[1:] == ctx[:-1]).all(1))
    cls = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    first_doc = np.minimum.reduceat(doc, head)
    least = np.repeat(first_doc[:, None], before + 1, 1)
    group = np.cumsum(np.diff(seeds[head], prepend=seeds[head[0]] ^ np.uint64(1)) != 0) - 1
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    edges = np.flatnonzero(np.diff(group[several], prepend=-1))
    start = 0
    while start < len(several):
        later = edges[np.searchsorted(edges, start + CLASSES) :]
        stop = later[0] if len(later) else len(several)
        c = several[start:stop]
        start = stop
        mine, p = ctx[head[c]], np.zeros((len(c), width + 1), np.uint64)
        np.cumsum((mine.astype(np.uint64) + np.uint64(1)) * up[:width], axis=1, out=p[:, 1:])
        s = suffix_sort(p, mine, np.full(len(c), before), group[c], length)
        c, mine, p = c[s], mine[s], p[s]
        low, high, docs_of = lo[head[c]], hi[head[c]], first_doc[c]
        # Bytes after the seed that sorted neighbours share; -1 between groups or if the seeds only agree by hash.
        alike = mine[1:, before:] == mine[:-1, before:]
        shared = np.where(alike.all(1), length, alike.argmin(1)) - seed
        shared[(group[c][1:] != group[c][:-1]) | (shared < 0)] = -1
        for o in range(before + 1):  # equal from the seed on: a run of the sort; equal before it: by hash, then by bytes
            run = np.concatenate([[0], np.cumsum(shared < o)])
            k = np.flatnonzero((low <= o) & (high >= o + length))
            left = p[k, before] - p[k, o]
            by = np.lexsort((left, run[k]))
            k, left = k[by], left[by]
            same = (run[k[1:]] == run[k[:-1]]) & (left[1:] == left[:-1])
            maybe = np.flatnonzero(same)
            same[maybe] = (mine[k[maybe + 1], o:before] == mine[k[maybe], o:before]).all(1)
            if same.any():
                heads = np.flatnonzero(np.concatenate([[True], ~same]))
                first = np.minimum.reduceat(docs_of[k], heads)
                least[c[k], o] = np.repeat(first, np.diff(np.append(heads, len(k))))
    cols = np.arange(before + 1)
    for x in range(0, n, 16384):
        part = slice(x, x + 16384)
        inside = (cols >= lo[part, None]) & (cols + length <= hi[part, None])
        out[order[part]] = inside & (least[cls[part]] < doc[part, None])
    return out


def _spans(doc: np.ndarray, at: np.ndarray, flags: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Flagged windows as spans (start, end), merged where they meet: document numbers and pairs."""
    i, o = np.nonzero(flags)
    d, s = doc[i], at[i] - (length - seed) + o
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    if not len(d):
        return d, np.zeros((0, 2), np.int64)
    head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + length)]))
    last = np.append(head[1:], len(d)) - 1
    return d[head], np.stack([s[head], s[last] + length], 1).astype(np.int64)


def _pack(did: np.ndarray, key: np.ndarray, values: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Values of documents, dealt to buckets of documents: one packed row for each bucket."""
    bucket = (mix(did.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out = []
    for b in range(buckets):
        t = order[cut[b] : cut[b + 1]]
        if len(t):
            out.append((b, np.array([len(t)], np.int64).tobytes() + did[t].tobytes() + key[t].tobytes() + np.ascontiguousarray(values[t]).tobytes()))
    return out


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return _rows(rows, ["bucket", "kind", "body"], [pa.int32(), pa.int32(), pa.binary()])


def _grouped(batches: Iterator[pa.RecordBatch], close) -> Iterator[pa.RecordBatch]:
    """``close`` the packed rows of each bucket together; the rows come sorted by bucket."""
    now, bodies = None, []
    for batch in batches:
        for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != now and bodies:
                yield close(bodies)
                bodies = []
            now = bucket
            bodies.append(body)
    if bodies:
        yield close(bodies)


def _by_document(columns: int):
    """Packed rows of one bucket of documents -> one row for each document with all its values as int64."""

    def close(bodies: list[bytes]) -> pa.RecordBatch:
        did, key, values = [], [], []
        for body in bodies:
            n = int(np.frombuffer(body, np.int64, 1)[0])
            did.append(np.frombuffer(body, np.int64, n, 8))
            key.append(np.frombuffer(body, np.int64, n, 8 + 8 * n))
            values.append(np.frombuffer(body, np.int64, n * columns, 8 + 16 * n).reshape(n, columns))
        did, key, values = map(np.concatenate, (did, key, values))
        order = np.lexsort((values[:, 0], key, did))
        did, key, values = did[order], key[order], values[order]
        head = np.flatnonzero(np.concatenate([[True], (did[1:] != did[:-1]) | (key[1:] != key[:-1])]))
        rows = [(int(did[a]), int(key[a]), values[a:b].tobytes()) for a, b in zip(head, [*head[1:], len(did)], strict=True)]
        return _rows(rows, ["did", "key", "found"], [pa.int64(), pa.int64(), pa.binary()])

    return lambda batches: _grouped(batches, close)


def _positions_in(docs_end: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(docs_end, at, side="right")


def _first_pass(length: int, seed: int, buckets: int):
    """Batches of documents -> packed open anchors by bucket of the seed (kind 0), and settled spans (kind 1)."""

    def solve(ids: list[int], keys: list[int], texts: list[bytes]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        end = np.cumsum(size)
        did, key = np.array(ids, np.int64), np.array(keys, np.int64)
        at, h = anchors(data, length, seed)
        of = _positions_in(end, at)
        ok = (at + seed <= end[of]) & (size[of] >= length)
        at, h, of = at[ok], h[ok], of[ok]
        rows: list[tuple[int, int, bytes]] = []
        still = np.ones(len(at), bool)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        often = np.zeros(len(at), bool)
        often[order[1:]] |= same
        often[order[:-1]] |= same
        rep = np.flatnonzero(often)
        if len(rep):
            ctx, lo, hi = contexts(data, at[rep], (end - size)[of[rep]], end[of[rep]], length, seed)
            flags = earliest(ctx, lo, hi, h[rep], did[of[rep]], length, seed)
            cols = np.arange(length - seed + 1)
            still[rep] = ((cols >= lo[:, None]) & (cols + length <= hi[:, None]) & ~flags).any(1)
            local = at[rep] - (end - size)[of[rep]]
            d, pairs = _spans(of[rep], local, flags, length, seed)
            rows += [(b, 1, body) for b, body in _pack(did[d], key[d], pairs, buckets)]
        at, h, of = at[still], h[still], of[still]
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at, h, of, bucket = at[order], h[order], of[order], bucket[order]
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        short = (h >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]  # 48 bits find candidates; bytes decide later
        local = (at - (end - size)[of]).astype(np.uint32)
        for b in range(buckets):
            i, j = cut[b], cut[b + 1]
            if i < j:
                used, where = np.unique(of[i:j], return_inverse=True)
                head = np.array([j - i, len(used)], np.int64).tobytes()
                rows.append((b, 0, head + did[used].tobytes() + key[used].tobytes() + np.ascontiguousarray(short[i:j]).tobytes() + where.astype(np.uint32).tobytes() + local[i:j].tobytes()))
        return _packed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, texts, total = [], [], [], 0
        for batch in batches:
            for d, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = t.encode()
                ids.append(d), keys.append(k), texts.append(raw)
                total += len(raw)
                if total >= BATCH_BYTES:
                    yield solve(ids, keys, texts)
                    ids, keys, texts, total = [], [], [], 0
        if texts:
            yield solve(ids, keys, texts)

    return run


def _candidates(buckets: int):
    """Per bucket: anchors whose seed is open in several documents, packed by document; settled spans pass through."""

    def close(bodies: list[bytes]) -> pa.RecordBatch:
        did, key, seeds, at = [], [], [], []
        for body in bodies:
            n, m = np.frombuffer(body, np.int64, 2).tolist()
            d = np.frombuffer(body, np.int64, m, 16)
            k = np.frombuffer(body, np.int64, m, 16 + 8 * m)
            pos = 16 + 16 * m
            short = np.zeros((n, 8), np.uint8)
            short[:, :6] = np.frombuffer(body, np.uint8, 6 * n, pos).reshape(n, 6)
            where = np.frombuffer(body, np.uint32, n, pos + 6 * n)
            did.append(d[where]), key.append(k[where])
            seeds.append(short.view(np.uint64).ravel())
            at.append(np.frombuffer(body, np.uint32, n, pos + 10 * n))
        did, key, seeds, at = map(np.concatenate, (did, key, seeds, at))
        order = np.argsort(seeds, kind="stable")
        did, key, seeds, at = did[order], key[order], seeds[order], at[order]
        head = np.flatnonzero(np.concatenate([[True], seeds[1:] != seeds[:-1]]))
        many = np.minimum.reduceat(did, head) != np.maximum.reduceat(did, head)
        keep = np.repeat(many, np.diff(np.append(head, len(seeds))))
        return _packed([(b, 0, body) for b, body in _pack(did[keep], key[keep], at[keep].astype(np.int64), buckets)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bodies = None, []
        for batch in batches:
            settled = []
            for bucket, kind, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind:
                    settled.append((bucket, 1, body))
                    continue
                if bucket != now and bodies:
                    yield close(bodies)
                    bodies = []
                now = bucket
                bodies.append(body)
            yield _packed(settled)
        if bodies:
            yield close(bodies)

    return run


def _send_contexts(length: int, seed: int, buckets: int):
    """Documents with their candidate anchors -> packed, compressed contexts by bucket of the seed's hash."""
    width = 2 * length - seed

    def send(did: list[int], key: list[int], texts: list[bytes], found: list[bytes]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(size) - size
        own = [np.frombuffer(x, np.int64) for x in found]
        of, at = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
        ctx, lo, hi = contexts(data, at + start[of], start[of], (start + size)[of], length, seed)
        h = row_hashes(ctx[:, length - seed : length])
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        ids, keys = np.array(did, np.int64), np.array(key, np.int64)
        squeeze, rows = zstandard.ZstdCompressor(level=1).compress, []
        for b in range(buckets):
            t = order[cut[b] : cut[b + 1]]
            if len(t):
                parts = (np.array([len(t)], np.int64), ids[of[t]], keys[of[t]], at[t], lo[t].astype(np.uint8), hi[t].astype(np.uint8), ctx[t])
                rows.append((b, squeeze(b"".join(x.tobytes() for x in parts))))
        return _rows(rows, ["bucket", "body"], [pa.int32(), pa.binary()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        did, key, texts, found, total = [], [], [], [], 0
        for batch in batches:
            for d, k, t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                did.append(d), key.append(k), texts.append(t.encode()), found.append(f)
                total += len(texts[-1]) + 4 * len(f)
                if total >= BATCH_BYTES:
                    yield send(did, key, texts, found)
                    did, key, texts, found, total = [], [], [], [], 0
        if texts:
            yield send(did, key, texts, found)

    return run


def _settle(length: int, seed: int, buckets: int):
    """Per bucket: the suffix sort of all contexts, and the spans that it removes, packed by document."""
    width = 2 * length - seed

    def close(bodies: list[bytes]) -> pa.RecordBatch:
        cols, kinds = [[] for _ in range(6)], ((np.int64, 1), (np.int64, 1), (np.int64, 1), (np.uint8, 1), (np.uint8, 1), (np.uint8, width))
        for body in bodies:
            body, pos = zstandard.ZstdDecompressor().decompress(body), 8
            n = int(np.frombuffer(body, np.int64, 1)[0])
            for col, (kind, many) in zip(cols, kinds, strict=True):
                col.append(np.frombuffer(body, kind, n * many, pos))
                pos += n * many * np.dtype(kind).itemsize
        did, key, at, lo, hi, ctx = map(np.concatenate, cols)
        ctx = ctx.reshape(-1, width)
        flags = earliest(ctx, lo.astype(np.int64), hi.astype(np.int64), row_hashes(ctx[:, length - seed : length]), did, length, seed)
        some = flags.any(1)
        did, key, at, flags = did[some], key[some], at[some], flags[some]
        order = np.lexsort((key, did))
        did, key, at, flags = did[order], key[order], at[order], flags[order]
        number = np.cumsum(np.concatenate([[True], (did[1:] != did[:-1]) | (key[1:] != key[:-1])])) - 1 if len(did) else did
        head = np.flatnonzero(np.diff(number, prepend=-1))
        d, pairs = _spans(number, at, flags, length, seed)
        return _rows([(b, body) for b, body in _pack(did[head[d]], key[head[d]], pairs, buckets)], ["bucket", "body"], [pa.int32(), pa.binary()])

    return lambda batches: _grouped(batches, close)


def remove_repeats(docs: DataFrame, *, length: int = 50, seed: int = 20, text: bool = True, buckets: int | None = None) -> DataFrame:
    """Remove each byte under a ``length``-byte string that also starts in a document with a smaller doc_id.

    Rows ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept`` (the remaining bytes).  Strings
    are judged on the input; overlaps count; matches never cross documents.  A null text counts as empty, and documents
    under ``length`` bytes stay whole.  A null doc_id counts as larger than all others; rows that repeat a doc_id never
    remove from each other.  One row per input row; only ``doc_id`` and ``text`` are read.
    """
    spark = docs.sparkSession
    buckets = buckets or 2 * partitions(spark)
    small_batches(spark)
    did = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    keyed = docs.select(did.alias("did"), text_key(did, F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    deal = lambda df: df.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    opened = keyed.where(F.octet_length("text") >= length).mapInArrow(_first_pass(length, seed, buckets), "bucket int, kind int, body binary")
    found = saved(deal(opened).mapInArrow(_candidates(buckets), "bucket int, kind int, body binary"))
    of = "did bigint, key bigint, found binary"
    lists = deal(found.where("kind = 0").select("bucket", "body")).mapInArrow(_by_document(1), of)
    whole = keyed.join(lists, ["did", "key"]).select("did", "key", "text", "found")
    sent = whole.mapInArrow(_send_contexts(length, seed, buckets), "bucket int, body binary")
    settled = deal(sent).mapInArrow(_settle(length, seed, buckets), "bucket int, body binary")
    spans = deal(found.where("kind = 1").select("bucket", "body").unionByName(settled)).mapInArrow(_by_document(2), of)
    rows = keyed.join(spans, ["did", "key"], "left").select("did", "text", "found")

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for t, some in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = t.encode()
            kept, n_spans = raw, 0
            if some:
                pairs = np.frombuffer(some, np.int64).reshape(-1, 2)
                depth = np.zeros(len(raw) + 1, np.int64)
                np.add.at(depth, pairs[:, 0], 1)
                np.add.at(depth, pairs[:, 1], -1)
                gone = np.cumsum(depth[:-1]) > 0
                n_spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            for k, v in zip(out, (len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                out[k].append(v)
        ids = [None if d == LAST else d for d in batch.column(0).to_pylist()]
        cols = {k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")}
        return cols | {"doc_id": pa.array(ids, pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())} | ({"kept": pa.array(out["kept"], pa.binary())} if text else {})

    return map_batches(rows, cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * text)
