"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its hashed character n-grams (with its edges as characters), a window's
vector the mean of its words', and a two-class softmax (held as the difference of its two rows) scores it; a document
scores as its highest window, so that a long text does not dilute a few words. Embeddings and softmax are trained
jointly in numpy (Adam): first on whole documents' means, then on the highest window of each document. Unseen
misspellings share n-gram vectors with the words they stand for.

The window and `least_docs` were chosen on sf0.1 by four-fold cross-validation over the rows whose remainder is 1 to 4;
the held-out rows were scored once, after that.

The classifier is fitted on a bounded sample: at most `per_class` labelled documents of each class, those of smallest
seeded hash; held-out rows (crc32(id as text) mod folds = 0) are never among them. Scoring covers every row's whole
text; a trained model is one number for each n-gram bucket, so scoring is a table lookup and prefix sums.

Defined cases: a null or empty text scores the model's bias, limited to below 0.5; labels that are null or not 0/1 are
ignored; a document labelled twice counts as its larger label, and of an id with several texts the first in code-point
order is learned from; very long texts are scored whole; other columns, whatever their names, are not read; ties in
the sample's seeded hash go by id; with labels of one class only (or none) every score is
the clipped rate of that class; a null id is not held out (its crc32 is null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, GOLD, mix, text_chunks, words

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
_CHAR = mix((np.arange(256, dtype=np.uint64) + np.uint64(77)) * GOLD)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For each n: the bucket of the n-gram at each byte of `text`, and each word's range of n-grams there.

    `text` is the lowered bytes with spaces unified and one space before and after; a word's n-grams run from its
    leading space to its trailing one.
    """
    text = np.full(len(data) + 2, 32, np.uint8)
    text[1:-1] = np.where(_SPACE[data], 32, _LOWER[data])
    code = _CHAR[text]
    for n in GRAMS:
        if len(code) < n:
            yield np.zeros(0, np.int64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
            continue
        with np.errstate(over="ignore"):
            h = np.zeros(len(code) - n + 1, np.uint64)
            for j in range(n):
                h *= np.uint64(0x100000001B3)
                h += code[j : j + len(h)]
            h ^= h >> np.uint64(29)
            h *= GOLD
        first = starts  # the position of the space before the word, in `text`
        last = np.maximum(first, ends + 2 - n + 1)
        yield (h >> np.uint64(64 - 17)).astype(np.int64), first, np.minimum(last, len(h))


def word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The mean of `table` over each word's n-grams."""
    total, count = np.zeros(len(starts)), np.zeros(len(starts))
    for bucket, a, b in _grams(data, starts, ends):
        sums = np.zeros(len(bucket) + 1)
        np.cumsum(table[bucket], out=sums[1:])
        b = np.maximum(a, b)
        total += sums[np.minimum(b, len(bucket))] - sums[np.minimum(a, len(bucket))]
        count += b - a
    return total / np.maximum(count, 1)


class Model:
    """table: a bucket's contribution to the logit; bias; window: words that are averaged."""

    def __init__(self, table: np.ndarray, bias: float, window: int, constant: float | None = None):
        self.table, self.bias, self.window, self.constant = table, bias, window, constant

    def scores(self, column) -> np.ndarray:
        out = []
        for _, data, offsets in text_chunks(column, 1 << 19):
            starts, ends, bound = words(data, offsets)
            s = word_scores(data, starts, ends, self.table)
            sums = np.concatenate(([0.0], np.cumsum(s)))
            n = np.diff(bound)
            logit = np.full(len(n), min(self.bias, -1e-3))
            w, rows = self.window, n >= self.window
            if rows.any():
                means = np.append((sums[w:] - sums[:-w]) / w, np.full(w, -np.inf))
                edges = np.stack([bound[:-1][rows], bound[1:][rows] - w + 1], 1).ravel()
                logit[rows] = self.bias + np.maximum.reduceat(means, edges)[::2]
            short = (n > 0) & (n < self.window)
            a, b = bound[:-1][short], bound[1:][short]
            logit[short] = self.bias + (sums[b] - sums[a]) / self.window
            out.append(logit)
        logit = np.concatenate(out) if out else np.zeros(0)
        if self.constant is not None:
            return np.full(len(logit), self.constant)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(texts: list[str], labels: list[int], window: int = 1, dim: int = 8, warm: int = 15, epochs: int = 60, rate: float = 0.05, least_docs: int = 3, decay: float = 1e-5, seed: int = 7) -> Model:
    y = np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(BUCKETS), 0.0, window, float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99)))
    # The vocabulary of the sample: each distinct word once, with its n-gram buckets.
    vocab: dict[bytes, int] = {}
    docs = []
    for t in texts:
        own = [w.lower() for w in (t or "").encode().split()]
        docs.append(np.array([vocab.setdefault(w, len(vocab)) for w in own] or [-1], np.int64))
    keys = np.frombuffer(b" ".join(vocab), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in vocab]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(vocab) else np.zeros(0, np.int64)
    flat, owner = [], []
    for bucket, a, b in _grams(keys, starts, ends):
        n = np.maximum(b - a, 0)
        owner.append(np.repeat(np.arange(len(a)), n))
        flat.append(bucket[np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())])
    owner, flat = np.concatenate(owner), np.concatenate(flat)
    # An n-gram of few documents tells nothing of others: it counts in the mean, with a vector of zero.
    grams = np.maximum(np.bincount(owner, minlength=len(vocab)), 1)
    in_docs = np.zeros(BUCKETS, np.int64)
    by_word = np.split(flat[np.argsort(owner, kind="stable")], np.cumsum(np.bincount(owner, minlength=len(vocab)))[:-1])
    for d in docs:
        if d[0] >= 0:
            in_docs[np.unique(np.concatenate([by_word[w] for w in np.unique(d)]))] += 1
    kept = in_docs[flat] >= least_docs
    owner, flat = owner[kept], flat[kept]
    used, flat = np.unique(flat, return_inverse=True)
    rng = np.random.default_rng(seed)
    emb, soft, bias = rng.normal(0, 0.1, (len(used), dim)), rng.normal(0, 0.3, dim), 0.0
    # Windows of `window` words (fewer in shorter documents), a word apart.
    words_flat = np.concatenate(docs)
    size = np.array([len(d) for d in docs])
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    weight = np.where(y == 1, np.sqrt(0.5 / y.mean()), np.sqrt(0.5 / (1 - y.mean())))
    moments = [np.zeros_like(emb), np.zeros_like(emb), np.zeros(dim + 1), np.zeros(dim + 1)]
    safe = np.maximum(words_flat, 0)
    present = (words_flat >= 0).astype(float)
    for step in range(1, warm + epochs + 1):
        vec = np.stack([np.bincount(owner, emb[flat, j], len(vocab)) for j in range(dim)], 1) / grams[:, None]
        score = (vec @ soft)[safe] * present
        sums = np.concatenate(([0.0], np.cumsum(score)))
        if step <= warm:
            a, b, div = begin, begin + size, np.maximum(size, 1)
        else:
            means = np.append(sums[window:] - sums[:-window], np.full(min(window, len(sums)), -np.inf))[: len(sums)] if len(sums) > window else np.full(len(sums), -np.inf)
            a = np.empty(len(docs), np.int64)
            for i, (s, n) in enumerate(zip(begin, size, strict=True)):
                a[i] = s + (means[s : s + n - window + 1].argmax() if n > window else 0)
            b, div = np.minimum(a + window, begin + size), np.full(len(docs), window)
        scale = 10.0 if step <= warm else 1.0
        logit = scale * (sums[b] - sums[a]) / div + bias
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        err = weight * (p - y) / len(y)
        n = b - a
        at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        per_word = np.bincount(safe[at], np.repeat(err * scale / div, n) * present[at], len(vocab))
        g_soft = per_word @ vec
        g_gram = (per_word / grams)[owner]
        g_emb = np.bincount(flat, g_gram, len(used))[:, None] * soft[None, :] + decay * emb
        for k, g in ((0, g_emb), (2, np.append(g_soft + 1e-5 * soft, err.sum()))):
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * g * g
        move = [rate * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 1] / (1 - 0.99**step)) + 1e-8) for k in (0, 2)]
        emb -= move[0]
        soft -= move[1][:dim]
        bias -= move[1][dim]
    table = np.zeros(BUCKETS)
    table[used] = emb @ soft
    return Model(table, float(bias), window)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", per_class: int = 1500, folds: int = 5, seed: int = 7) -> Model:
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("y IN (0, 1) AND id IS NOT NULL")
    known = known.where(~held_out(F.col("id"), folds)).groupBy("id").agg(F.max("y").alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))  # at most 2 * per_class rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).join(sample, "id").groupBy("id").agg(F.min("t").alias("t"), F.max("y").alias("y")).collect()
    rows.sort(key=lambda r: r["id"])
    return train([r["t"] for r in rows], [r["y"] for r in rows], seed=seed)


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.scores(b.column(1)))], ["doc_id", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
