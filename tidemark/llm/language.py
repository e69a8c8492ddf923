"""Language identification by prediction by partial matching.

For each language a variable-order byte context tree of depth ``order`` is fitted and then frozen.  In a
context seen ``n`` times with ``q`` distinct next bytes a seen byte has probability ``count / (n + q)``; the
rest, ``q / (n + q)``, is the escape probability, given to the other bytes in proportion to the next shorter
context's distribution (full exclusion); below the empty context every byte has 1/256.  This is a proper
distribution in every context, so ``-log2`` of it, summed over a text, is the exact length of the text's code
under the language.  The shortest code names the language.

The trees are stored as sorted tables of n-grams, one row of costs for all languages together, so a text is
scored by vectorised look-ups: the longest known n-gram at each position, plus the escapes above it.  Costs are
integers (1/1024 bit): sums do not depend on their order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_batches

UNIT = 1024
_LETTER = regex.compile(r"\p{L}")
_CHUNK = 1 << 17


class Table:
    """Sorted distinct keys, found through a directory of the leading bits of a multiplicative hash."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(keys * self.MIX)
        self.keys, self.rows = keys[order], rows[order]
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - self.bits)
        at = (self.keys * self.MIX) >> self.shift
        self.first = np.searchsorted(at, np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a key is unknown."""
        out = np.full(len(keys), -1, np.int32)
        h = ((keys * self.MIX) >> self.shift).astype(np.int64)
        at, end = self.first[h], self.first[h + 1]
        todo = np.nonzero(at < end)[0]
        at, end, want = at[todo], end[todo], keys[todo]
        while len(todo):
            hit = self.keys[at] == want
            out[todo[hit]] = at[hit]
            more = ~hit
            at = at + 1
            more &= at < end
            todo, at, end, want = todo[more], at[more], end[more], want[more]
        return out


@dataclass
class Model:
    """Frozen statistics of all languages: for each order the n-grams' costs and the contexts' escapes."""

    langs: list[str]
    order: int
    grams: list[Table]
    escapes: list[Table]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language, in 1/UNIT bits: shape (texts, languages)."""
        pad, out = b"\n" * self.order, np.zeros((len(texts), len(self.langs)), np.int64)
        buf = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(sizes + self.order)[:-1]]) + self.order if len(texts) else sizes
        of = np.repeat(np.arange(len(texts)), sizes)
        at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        chunk = max(1024, _CHUNK * 64 // max(64, len(self.langs)))  # costs of all languages stay in memory
        for lo in range(0, len(at), chunk):
            cost = self._costs(buf, at[lo : lo + chunk])
            text = of[lo : lo + chunk]
            first = np.nonzero(np.diff(text, prepend=-1))[0]
            out[text[first]] += np.add.reduceat(cost, first, axis=0, dtype=np.int64)
        return out

    def _costs(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = np.zeros(len(at), np.uint64)
        for d in range(self.order, -1, -1):
            key = key << np.uint64(8) | buf[at - d]
        cost = np.zeros((len(at), len(self.langs)), np.int32)
        todo = slice(None)
        for d in range(self.order, -1, -1):
            row = self.grams[d].find(key)
            hit = row >= 0
            if isinstance(todo, slice):
                cost[hit] = self.grams[d].rows[row[hit]]
                todo = np.nonzero(~hit)[0]
            else:
                cost[todo[hit]] += self.grams[d].rows[row[hit]]
                todo = todo[~hit]
            key = key[~hit]
            if not len(todo):
                return cost
            ctx = self.escapes[d].find(key >> np.uint64(8))
            known = ctx >= 0
            cost[todo[known]] += self.escapes[d].rows[ctx[known]]
            key = key & np.uint64((1 << 8 * d) - 1)
        cost[todo] += 8 * UNIT
        return cost

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its posterior probability at equal priors; 'und' and 0 for null or without a letter."""
        real = [i for i, t in enumerate(texts) if t and self.langs and _LETTER.search(t)]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if real:
            bits = self.lengths([texts[i].encode() for i in real])
            best = bits.argmin(1)
            over = (bits - bits[np.arange(len(real)), best][:, None]) / UNIT
            p = 1 / np.exp2(-np.minimum(over, 1000)).sum(1)
            for i, b, s in zip(real, best.tolist(), p.tolist(), strict=True):
                lang[i], score[i] = self.langs[b], s
        return lang, score


def fit(samples: dict[str, list[bytes]], order: int = 4) -> Model:
    """Context trees of the given texts of each language."""
    langs = sorted(samples)
    counted = []  # [language][d]: n-grams of d + 1 bytes and their counts
    for lang in langs:
        buf = np.frombuffer(b"".join(b"\n" * order + t for t in samples[lang]), np.uint8).astype(np.uint64)
        sizes = [len(t) for t in samples[lang]]
        at, pos = [], 0
        for n in sizes:
            at.append(np.arange(pos + order, pos + order + n))
            pos += n + order
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        mine, key = [], np.zeros(len(at), np.uint64)
        for d in range(order + 1):
            key = key | (buf[at - d] << np.uint64(8 * d)) if len(at) else key
            mine.append(np.unique(key, return_counts=True))
        counted.append(mine)
    grams, escapes, below = [], [], None
    for d in range(order + 1):
        keys = np.unique(np.concatenate([c[d][0] for c in counted])) if langs else np.zeros(0, np.uint64)
        ctxs = np.unique(keys >> np.uint64(8))
        low = np.full((len(keys), len(langs)), 2.0**-8)
        if below is not None and len(keys):
            low = below[1][np.searchsorted(below[0], keys & np.uint64((1 << 8 * d) - 1))]
        p, esc = low.copy(), np.ones((len(ctxs), len(langs)))
        of = np.searchsorted(ctxs, keys >> np.uint64(8))
        for i in range(len(langs)):
            seen = np.searchsorted(keys, counted[i][d][0])
            count = np.zeros(len(keys))
            count[seen] = counted[i][d][1]
            n = np.bincount(of, count, len(ctxs))
            q = np.bincount(of, count > 0, len(ctxs))
            taken = np.bincount(of, np.where(count > 0, low[:, i], 0), len(ctxs))
            known = n > 0
            esc[known, i] = q[known] / (n + q)[known] / np.maximum(1 - taken[known], 1e-9)
            p[:, i] = np.where(count > 0, count / np.maximum(n + q, 1)[of], low[:, i] * esc[of, i])
        below = keys, p
        bits = lambda x: np.rint(-np.log2(np.maximum(x, 2.0**-60)) * UNIT).astype(np.int32)
        grams.append(Table(keys, bits(p)))
        escapes.append(Table(ctxs, bits(esc)))
    return Model(langs, order, grams, escapes)


def training_sample(docs: DataFrame, *, docs_per_lang: int = 300, max_bytes: int = 16_384, full_langs: int = 64) -> dict[str, list[bytes]]:
    """A bounded sample of the labelled rows of ``docs`` (text, lang), drawn by a hash of the text.

    Every labelled language is learned, from at most ``docs_per_lang`` different texts; with more than ``full_langs`` languages from
    fewer, at least one, so that n-grams times languages stay bounded.  Texts of at most ``max_bytes`` bytes come first;
    of longer ones, where those are too few, the first ``max_bytes`` bytes are used.  The per-language limit is applied
    in every task before anything is shuffled.
    """
    rows = docs.select("text", "lang").where("text is not null and lang is not null and octet_length(text) > 0")
    n_langs = max(1, rows.select("lang").distinct().count())
    most = docs_per_lang if n_langs <= full_langs else max(1, docs_per_lang * full_langs**2 // n_langs**2)
    # Equal texts are one before they are ranked; only as much of a text as is used leaves its task.
    part = F.substring(F.col("text").cast("binary"), 1, max_bytes)
    kinds = rows.select("lang", F.xxhash64("text").alias("h"), (F.octet_length("text") > max_bytes).alias("long")).distinct()
    ranked = kinds.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("long", F.xxhash64("h"), "h"))).where(F.col("k") <= most)
    wanted = rows.select("lang", F.xxhash64("text").alias("h"), part.alias("part")).join(F.broadcast(ranked.select("lang", "h")), ["lang", "h"])  # docs_per_lang * full_langs rows at most
    out: dict[str, dict[int, bytes]] = {}
    for r in wanted.dropDuplicates(["lang", "h"]).collect():
        out.setdefault(r["lang"], {})[r["h"]] = bytes(r["part"])
    return {lang: [texts[h] for h in sorted(texts)] for lang, texts in out.items()}


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of every whole text: rows ``doc_id, *keep, lang_pred, score``.  One pass, no shuffle.

    ``score`` is the posterior at equal priors.  A null or empty text, or one without a letter, is ``und`` with
    score 0, as is every text if no language was learned.  Equal code lengths go to the first language by name.
    Rows with null ids and repeated rows are answered one by one; only the named columns are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    cols = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("__text"), *keep)
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in cols.schema.fields[2:])

    def run(batch: pa.RecordBatch) -> dict:
        lang, score = sent.value.predict(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())} | {n: batch.column(i + 2) for i, n in enumerate(keep)}

    return map_batches(cols, run, f"doc_id bigint{kept}, lang_pred string, score double")


def held_out() -> F.Column:
    """Rows that no statistics are learned from: crc32 of the decimal doc_id leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
