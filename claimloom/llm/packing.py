"""Best-fit packing of token pieces into sequences by a linear grouping scheme.

Only the histogram of piece lengths (at most `capacity` numbers, whatever the corpus) reaches the driver:

1. lengths above a share of the capacity are sorted, split into groups of equal cardinality and rounded up to the
   largest of their group;
2. the few rounded sizes are packed by configurations: the cutting-stock linear program is solved by column
   generation (knapsack pricing), and its basic solution is rounded down;
3. actual lengths are substituted into the configurations' places, longest first;
4. what is left over and all small lengths go, longest first, into the open bin they fit best, else into new bins.

The plan is a list of classes of equal bins. A piece's rank among the pieces of its length, counted in the tasks that
wrote the pieces and offset by a prefix sum over tasks, finds its bin and place: no piece moves between tasks.

Defined cases: a null or empty text is the single end token; repeated rows are pieces of their own; a text with the
special token's string yields its id; a white-space run too long for tiktoken is encoded all the same;
very long texts are tokenised whole, one at a time; equal lengths are interchangeable, so ties need no rule; a null id
stays null; other columns, whatever their names, are not read; an empty table gives an empty table. The scheme runs
whatever the number of pieces: of few pieces each is a group of its own.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import release, sized_join, written

END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
_ENCODERS: dict[str, object] = {}


def encoder(ranks_path: str):
    """A byte-level BPE encoder over the ranks file; its ids equal those of the JSON file of the same vocabulary."""
    if ranks_path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[ranks_path] = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return _ENCODERS[ranks_path]


def encoded(ranks_path: str, text: str) -> np.ndarray:
    """The text's ids. A run that tiktoken's regex cannot take, as of a million spaces, goes to the JSON tokenizer."""
    try:
        return encoder(ranks_path).encode_to_numpy(text, allowed_special="all")
    except ValueError as e:
        if "Max stack size exceeded" not in str(e):
            raise
    path = ranks_path.removesuffix(".tiktoken") + ".json"
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        _ENCODERS[path] = Tokenizer.from_file(path)
    return np.array(_ENCODERS[path].encode(text).ids, np.uint32)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: a shorter first piece, then full ones."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, ranks_path: str, capacity: int = 2048, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Tokenised pieces with the task that made them and their number among that task's pieces of equal length."""

    def run(batches):
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoded(ranks_path, t.as_py() or "").astype("<u4"), np.uint32(END))
                for p, (start, length) in enumerate(cut(len(ids), capacity)):
                    nth = seen[length] = seen.get(length, -1) + 1
                    rows.append((doc, p, start, length, zlib.crc32(ids[start : start + length].tobytes()), task, nth))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names)
        release()

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, PIECES)


def knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: best value and how often each size is taken."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    low = int(sizes.min())
    for c in range(low, capacity + 1):
        fit = sizes <= c
        tries = np.where(fit, best[np.where(fit, c - sizes, 0)] + value, -1.0)
        k = int(tries.argmax())
        if tries[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = tries[k], k
        else:
            best[c] = best[c - 1]
    taken, c = np.zeros(len(sizes)), capacity
    while c >= low:
        if pick[c] < 0:
            c -= 1
        else:
            taken[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), taken


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(items of each size, bins) from the cutting-stock program's basic solution.

    Bins are rounded down; then configurations of the largest fractions get a bin more while their items last.
    """
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(len(sizes)))
        best, column = knapsack(dual, sizes, capacity)
        if best <= 1 + 1e-7:
            break
        x, step = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, demand)
    columns, bins = basis.round().astype(int), np.maximum(x + 1e-6, 0).astype(int)
    left = demand.astype(int) - columns @ bins
    for j in np.argsort(bins - x, kind="stable"):
        if x[j] > bins[j] and (columns[:, j] <= left).all():
            bins[j] += 1
            left -= columns[:, j]
    return [(columns[:, j], int(n)) for j, n in enumerate(bins) if n]


class Plan:
    """Classes of equal bins: [bins, room, [(length, copies a bin), ...]]; `grouped` items came by configurations."""

    def __init__(self, capacity: int):
        self.capacity, self.classes, self.rooms, self.open, self.grouped = capacity, [], [], {}, 0

    def add(self, bins: int, items: list[tuple[int, int]]) -> None:
        if bins:
            room = self.capacity - sum(length * k for length, k in items)
            self.classes.append([bins, room, items])
            self._open(len(self.classes) - 1)

    def _open(self, i: int) -> None:
        room = self.classes[i][1]
        if room > 0:
            if room not in self.open:
                insort(self.rooms, room)
            self.open.setdefault(room, []).append(i)

    def best_fit(self, length: int, n: int) -> None:
        """Put n items of one length into the bins of least sufficient room, then into new ones."""
        while n and (at := bisect_left(self.rooms, length)) < len(self.rooms):
            room = self.rooms[at]
            i = self.open[room].pop()
            if not self.open[room]:
                del self.open[room], self.rooms[at]
            bins, _, items = self.classes[i]
            k = room // length
            full = min(bins, n // k)
            n -= full * k
            if full < bins:  # the class splits: full bins, one with the rest, and untouched ones
                some = 1 if n else 0
                self.classes[i] = [bins - full - some, room, items]
                if bins - full - some:
                    self._open(i)
                self.add(some, [*items, (length, n)])
                n = 0
                self.add(full, [*items, (length, k)])
            else:
                self.classes[i] = [bins, room - k * length, [*items, (length, k)]]
                self._open(i)
        if n:
            k = self.capacity // length
            self.add(n // k, [(length, k)])
            if n % k:
                self.add(1, [(length, n % k)])


def plan(hist: dict[int, int], capacity: int, groups: int = 40, large: float = 0.5) -> Plan:
    left = {length: n for length, n in hist.items() if n > 0}
    out = Plan(capacity)
    out.add(left.pop(capacity, 0), [(capacity, 1)])
    big = sorted((length for length in left if length > large * capacity), reverse=True)
    total = sum(left[length] for length in big)
    groups = min(groups, total)
    if total:
        members, quota, room = [[]], total / groups, total / groups
        for length in big:  # runs (length, count) of groups of equal cardinality
            n = left[length]
            while n:
                take = min(n, max(1, round(room)))
                members[-1].append([length, take])
                n, room = n - take, room - take
                if room < 0.5:
                    members.append([])
                    room += quota
        members = [m for m in members if m]
        merged: dict[int, list] = {}
        for m in members:
            merged.setdefault(m[0][0], []).extend(m)
        sizes = np.array(list(merged))
        demand = np.array([sum(n for _, n in m) for m in merged.values()], float)
        queue = list(merged.values())
        for counts, bins in configurations(sizes, demand, capacity):
            while bins:
                # The largest run of bins in which every place takes one actual length.
                places, run, need = [], bins, {}
                for g, k in enumerate(counts):
                    if k and queue[g]:
                        run = min(run, max(1, queue[g][0][1] // int(k)))
                for g, k in enumerate(counts):
                    k = int(k)
                    while k and queue[g]:
                        use = min(k, max(1, queue[g][0][1] // run))
                        if queue[g][0][1] < use * run:
                            break
                        places.append((queue[g][0][0], use))
                        queue[g][0][1] -= use * run
                        need[queue[g][0][0]] = need.get(queue[g][0][0], 0) + use
                        k -= use
                        if queue[g][0][1] == 0:
                            queue[g].pop(0)
                        else:
                            break
                    while k and run == 1 and queue[g]:
                        places.append((queue[g][0][0], 1))
                        need[queue[g][0][0]] = need.get(queue[g][0][0], 0) + 1
                        queue[g][0][1] -= 1
                        k -= 1
                        if queue[g][0][1] == 0:
                            queue[g].pop(0)
                out.add(run, list(need.items()))
                out.grouped += run * sum(need.values())
                for length, k in need.items():
                    left[length] -= k * run
                bins -= run
    for length in sorted(left, reverse=True):
        if left[length]:
            out.best_fit(length, left[length])
    return out


def best_plan(hist: dict[int, int], capacity: int, tries=((100, 0.42), (40, 0.5))) -> Plan:
    """The plan of fewest bins over a few numbers of groups and thresholds; stops at the bound by total length."""
    least, best = -(-sum(length * n for length, n in hist.items()) // capacity), None
    for groups, large in tries:
        p = plan(hist, capacity, groups, large)
        if best is None or sum(c[0] for c in p.classes) < sum(c[0] for c in best.classes):
            best = p
        if sum(c[0] for c in best.classes) == least:
            break
    return best


def slots(p: Plan) -> np.ndarray:
    """Rows (length, first rank, copies a bin, first sequence, offset), sorted by length and rank."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for bins, _, items in p.classes:
        at = 0
        for length, k in items:
            rows.append((length, used.get(length, 0), k, base, at))
            used[length] = used.get(length, 0) + bins * k
            at += length * k
        base += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, ranks_path: str, capacity: int = 2048, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = written(pieces(docs, ranks_path, capacity, text, id_col), "pieces")
    by_task = written(made.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    hist = {int(r["length"]): int(r["n"]) for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(best_plan(hist, capacity))
    w = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    ranked = sized_join(made, before, ["task", "length"], "inner", 20)
    shift = 44

    def place(batches):
        key = (table[:, 0] << shift) | table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            s = table[np.searchsorted(key, (length << shift) | rank, "right") - 1] if len(table) else np.zeros((len(rank), 5), np.int64)
            within = rank - s[:, 1]
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(s[:, 3] + within // np.maximum(s[:, 2], 1)), pa.array(s[:, 4] + within % np.maximum(s[:, 2], 1) * length)],
                [*keep, "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "nth", "before").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
