"""Quality classifier by a weak-label model.

Overlapping heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts
of vote patterns of all documents estimates each labeller's vote rates in either class and the share of bad documents
(no label is read); the patterns' posteriors label a bounded sample, on which a hashed linear scorer is trained; the
scorer judges every document. Only pattern counts (at most 3^labellers, in practice dozens) and the sample reach the
driver.

The sample is the `sample` documents of smallest seeded hash (of an id with several texts the first in code-point
order); their features, not their texts, are collected. Features are hashed word shapes (transitions between
character classes), repeated words and the share of distinct words, as shares of a document's words.

Defined cases: a null, empty or wordless text gets no votes and the scorer's bias, limited to good; repeated rows are
scored alike; very long texts are judged whole; a row without an id is scored but never in the sample; a score at the
threshold is kept, and ties of the sample's hash go by id; an empty table gives an empty table; extra columns, whatever
their names, pass through `filter_quality` unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, GOLD, byte_prefix, mix, release, span, text_chunks, words

BINS = 1 << 12
SCHEMA = "doc_id long, pattern long, posterior double, score double, keep int"
LABELLERS = ("symbols", "symbol_words", "capitals", "shouts", "pipes", "pipe_words", "repeats", "few_distinct", "plain_words", "varied")

# Character classes: 0 space, 1 lower case or non-ASCII, 2 capital, 3 digit, and a class for each other byte.
_CLASS = np.array([0 if c in (9, 10, 11, 12, 13, 32) else 1 if 97 <= c <= 122 or c >= 128 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else c for c in range(256)], np.uint8)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"*$%#&@^~=<>_\\{}")] = True
_PAIR = mix((np.arange(1 << 16, dtype=np.uint64) + np.uint64(3)) * GOLD)


def describe(data: np.ndarray, offsets: np.ndarray):
    """Per row: labellers' votes (rows, labellers) in {-1 none, 0 good, 1 bad}, and word feature bins with their rows."""
    starts, ends, bound = words(data, offsets)
    n = np.diff(bound)
    row = np.repeat(np.arange(len(n)), n)
    per = lambda x: np.bincount(row, x, len(n)) / np.maximum(n, 1)  # noqa: E731  a share of the words
    cls = _CLASS[data]
    over = lambda flag: (c := np.concatenate(([0], np.cumsum(flag, dtype=np.int64))))[offsets[1:]] - c[offsets[:-1]]
    capital, lower, symbol = over(cls == 2), over(cls == 1), over(_SYMBOL[data])
    inside = lambda flag: (c := np.concatenate(([0], np.cumsum(flag, dtype=np.int64))))[ends] - c[starts]
    hashed = span(byte_prefix(_LOWER[data]), starts, ends)
    repeat = np.zeros(len(hashed), bool)
    repeat[1:] = (hashed[1:] == hashed[:-1]) & (row[1:] == row[:-1])
    distinct = np.zeros(len(n))
    if len(hashed):
        # Distinct words of each row: sorted by (row, hash).
        order = np.lexsort((hashed, row))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hashed[order][1:] != hashed[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order], fresh, len(n)) / np.maximum(n, 1)
    bang = inside(data == 33) >= 2
    tail = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    symbol_word = _SYMBOL[tail]
    pipe = (ends - starts == 1) & (tail == 124)
    letters = inside((cls == 1) | (cls == 2))
    plain = (letters >= ends - starts - 1) & (inside(cls == 2) <= 1) & ((letters == ends - starts) | np.isin(tail, list(b".,;:!?")))
    size = np.maximum(np.diff(offsets), 1)
    up, rep, plain_s, pipes = capital / np.maximum(capital + lower, 1), per(repeat), per(plain), per(pipe)
    long = n >= 30
    bad = [symbol / size > 0.04, per(symbol_word) > 0.25, (up > 0.4) & (n > 3), per(bang) > 0.2, pipes > 0.15, (over(data == 124) / size > 0.02) & long, rep > 0.2, (distinct < 0.15) & long & (rep > 0.05)]
    good = [(plain_s > 0.8) & (rep < 0.05) & (n > 0), (distinct > 0.35) & (rep < 0.05) & (plain_s > 0.6)]
    votes = np.full((len(n), len(LABELLERS)), -1, np.int8)
    for j, x in enumerate(bad):
        votes[x, j] = 1
    for j, x in enumerate(good):
        votes[x, len(bad) + j] = 0
    # A word's shape: the sum of its class transitions, hashed.
    with np.errstate(over="ignore"):
        edge = np.zeros(len(data), np.uint64)
        if len(data) > 1:
            change = cls[1:] != cls[:-1]
            edge[1:][change] = _PAIR[cls[:-1].astype(np.int64)[change] * 256 + cls[1:][change]]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(edge, dtype=np.uint64)))
        shape = mix(sums[ends] - sums[np.minimum(starts + 1, ends)] + _PAIR[cls[starts].astype(np.int64)]) if len(starts) else np.zeros(0, np.uint64)
    bins = (shape % np.uint64(BINS - 8)).astype(np.int64) + 8
    bins[repeat] = 0
    return votes, row, bins, n, distinct


def pattern(votes: np.ndarray) -> np.ndarray:
    """A row of votes as one number in base 3."""
    return (votes.astype(np.int64) + 1) @ (3 ** np.arange(votes.shape[1], dtype=np.int64))


def unpattern(p: int) -> list[int]:
    return [p // 3**j % 3 - 1 for j in range(len(LABELLERS))]


def estimate(counts: dict[int, int], rounds: int = 100) -> dict:
    """EM over pattern counts: the bad share, P(vote | class) of each labeller, and each pattern's posterior of bad."""
    if not counts:
        return {"posterior": {}, "bad": 0.0, "rates": np.zeros((2, len(LABELLERS), 3))}
    keys = sorted(counts)
    votes, n = np.array([unpattern(k) for k in keys]), np.array([counts[k] for k in keys], float)
    post = np.where((votes == 1).sum(1) > 0, 0.9, 0.05)
    for _ in range(rounds):
        bad = (n @ post + 0.5) / (n.sum() + 1)
        rates = np.stack([np.stack([(w @ (votes == v) + 0.5) / (w.sum() + 1.5) for v in (-1, 0, 1)], 1) for w in (n * (1 - post), n * post)])
        ll = np.stack([np.log(rates[c][np.arange(votes.shape[1])[None, :], votes + 1]).sum(1) for c in (0, 1)])
        new = 1 / (1 + np.exp(np.clip(ll[0] + np.log(1 - bad) - ll[1] - np.log(bad), -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return {"posterior": dict(zip(keys, map(float, post), strict=True)), "bad": float(bad), "rates": rates}


SAMPLE = "id long, pattern long, n long, distinct double, bins binary, counts binary"


def sampled(batches):
    """Of (id, text) rows: the vote pattern and the features, a few hundred bytes a row whatever the text's length."""
    for b in batches:
        for at, d, o in text_chunks(b.column(1), 1 << 19):
            votes, row, bins, n, distinct = describe(d, o)
            keys, counts = np.unique(row * BINS + bins, return_counts=True)
            cuts = np.searchsorted(keys, np.arange(len(n) + 1) * BINS)
            parts = [slice(x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).slice(at, len(n)),
                    pa.array(pattern(votes)),
                    pa.array(n.astype(np.int64)),
                    pa.array(distinct),
                    pa.array([(keys[p] % BINS).astype(np.int32).tobytes() for p in parts], pa.binary()),
                    pa.array([counts[p].astype(np.int32).tobytes() for p in parts], pa.binary()),
                ],
                [x.split(" ")[0] for x in SAMPLE.split(", ")],
            )


def dense(rows) -> np.ndarray:
    """The sampled rows' features, one row each, over all bins."""
    x = np.zeros((len(rows), BINS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["bins"], np.int32)] = np.frombuffer(r["counts"], np.int32) / max(r["n"], 1)
        x[i, 1] = np.clip(0.3 - r["distinct"], 0, 1) * (r["n"] >= 30)
    return x


def train(x: np.ndarray, posts: list[float], epochs: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; weights of the bins that the sample has, and a bias."""
    if not len(x):
        return np.zeros(BINS), -3.0
    live = np.flatnonzero(x.any(0))
    x, y = x[:, live], np.array(posts)
    w, b, m, v = np.zeros(len(live)), -1.0, np.zeros(len(live) + 1), np.zeros(len(live) + 1)
    for t in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = np.append(x.T @ (p - y) / len(y) + 1e-5 * w, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    out = np.zeros(BINS)
    out[live] = w
    return out, float(min(b, -1e-3))


def fit(docs: DataFrame, text: str = "text", id_col: str = "doc_id", sample: int = 4000, seed: int = 11) -> dict:
    """The estimated labellers and the trained scorer."""

    def vote(batches):
        for b in batches:
            counts: dict[int, int] = {}
            for _, d, o in text_chunks(b.column(0), 1 << 19):
                for k, c in zip(*np.unique(pattern(describe(d, o)[0]), return_counts=True), strict=True):
                    counts[int(k)] = counts.get(int(k), 0) + int(c)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])
        release()

    rows = docs.select(text).mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    model = estimate({int(r["pattern"]): int(r["n"]) for r in rows})
    ids = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).join(F.broadcast(ids), "id").groupBy("id").agg(F.min("t").alias("t"))
    rows = texts.select(F.col("id").cast("long"), "t").mapInArrow(sampled, SAMPLE).collect()  # at most `sample` rows
    rows.sort(key=lambda r: r["id"])
    posts = [model["posterior"].get(r["pattern"], 0.0) for r in rows]
    model["weights"], model["bias"] = train(dense(rows), posts)
    return model


def score(docs: DataFrame, model: dict, text: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(doc_id, pattern, posterior of bad, score in 0..1 with 1 good, keep)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            pats, scores = judge(m, b.column(1))
            posts = [m["posterior"].get(int(k), 0.0) for k in pats]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pats), pa.array(posts), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "pattern", "posterior", "score", "keep"])
        release()

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, SCHEMA)


def judge(m: dict, column) -> tuple[np.ndarray, np.ndarray]:
    pats, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
    for _, d, o in text_chunks(column, 1 << 19):
        votes, row, bins, n, distinct = describe(d, o)
        logit = m["bias"] + np.bincount(row, m["weights"][bins], len(n)) / np.maximum(n, 1) + m["weights"][1] * np.clip(0.3 - distinct, 0, 1) * (n >= 30)
        pats.append(pattern(votes))
        scores.append(1 / (1 + np.exp(np.clip(logit, -30, 30))))
    return np.concatenate(pats), np.concatenate(scores)


def filter_quality(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that the scorer keeps, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(judge(held.value, b.column(b.schema.get_field_index(text)))[1] >= threshold))
        release()

    return docs.mapInArrow(run, docs.schema)
