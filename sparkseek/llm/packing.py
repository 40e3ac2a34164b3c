"""Best-fit packing of tokenised documents into sequences by the linear grouping scheme.

Lengths are whole numbers up to the capacity, so the plan needs only how many pieces have each length. Large lengths are
dealt into groups of equal cardinality and rounded up to their group's longest; configurations of these few sizes are
optimised (column generation to the optimum of a linear program, knapsacks by dynamic programming) and rounded down.
Actual lengths then take the places of the rounded ones, chosen to fill each sequence; large pieces beyond the rounded-down
configurations and small pieces go best-fit into what space remains, longest first. More groups round less and cost more
time, and neither is always better, so a plan is made for each of ``GROUPS`` and the one of fewest sequences is used.

The plan is a list of runs: so many pieces of one length, from such a rank on, go to so many consecutive sequences at one
offset. Its size depends on the capacity and the number of groups, not on the documents. Pieces find their run by length
and rank; ranks come from per-task counters written with the pieces and a sum over tasks by length.

Defined cases: null or empty text is the end id alone; only documents over the capacity are cut, and only their first
piece may be shorter; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.llm._common import cut, drop, map_arrow

CAPACITY = 1024
END_ID = 2
#: Numbers of groups that are tried; fewer distinct lengths make as many groups. The plan of fewest sequences counts.
GROUPS = (160, 96)
#: Lengths of at least this share of the capacity are large.
LARGE = 1 / 8


def encoder(name: str):
    """Function text -> ids as little-endian unsigned 32-bit array, equal to the named tokenizer's.

    The same vocabulary as merge ranks encodes ordinary text several times faster; texts that spell a special token
    go to the tokenizer itself.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(fast.encode_ordinary(text), "<u4")

    return encode


def tokenise(docs: DataFrame, keep: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k", end: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``keep``, piece, start, length, ids_crc32, and (_task, _nth): its task and rank by length there."""
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    longs = ["start", "length", "ids_crc32", "_task", "_nth"]
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in longs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, nth = encoder(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            back, cols = [], [[] for _ in range(5)]
            for k, t in enumerate(b.column(len(keep))):
                ids = np.append(encode(t.as_py() or ""), np.array([end], "<u4")).astype("<u4")
                first = len(ids) % capacity or capacity
                raw, lo = ids.tobytes(), 0
                for piece, hi in enumerate(range(first, len(ids) + 1, capacity)):
                    back.append(k)
                    for col, x in zip(cols, (piece, lo, hi - lo, zlib.crc32(raw[4 * lo : 4 * hi]), nth[hi - lo]), strict=True):
                        col.append(x)
                    nth[hi - lo] += 1
                    lo = hi
            at = pa.array(back, pa.int32())
            piece, start, length, crc, rank = cols
            new = [pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc, [task] * len(back), rank)]]
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[: len(keep)]], *new], [*keep, "piece", *longs])

    return map_arrow(rows, run, schema)


class Plan:
    """Runs (length, rank from, rank to, sequence from, offset) that pack ``counts[length]`` pieces."""

    @classmethod
    def best(cls, counts: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> Plan:
        """The plan of fewest sequences over the numbers of groups, the first of equal ones."""
        return min((cls(counts, capacity, g) for g in groups), key=lambda p: p.sequences)

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS[0]) -> None:
        self.capacity = capacity
        self.left = dict(sorted((n, c) for n, c in counts.items() if c > 0))
        self.used = dict.fromkeys(self.left, 0)
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.space: dict[int, list[tuple[int, int]]] = {}  # free space -> runs of sequences with it
        self.sizes: list[int] = []  # keys of space, sorted
        large = [n for n in self.left if n >= LARGE * capacity and n < capacity]
        self._configurations(large, groups)
        for n in reversed(list(self.left)):
            self._best_fit(n)

    def _free(self, room: int, lo: int, hi: int) -> None:
        if room <= 0 or lo >= hi:
            return
        if room not in self.space:
            insort(self.sizes, room)
            self.space[room] = []
        self.space[room].append((lo, hi))

    def _place(self, n: int, lo: int, hi: int, offset: int) -> None:
        r = self.used[n]
        self.runs.append((n, r, r + hi - lo, lo, offset))
        self.used[n] += hi - lo
        self.left[n] -= hi - lo

    def _best_fit(self, n: int) -> None:
        """All left pieces of length ``n``: into the tightest space, then into new sequences, as many to one as fit."""
        while self.left[n]:
            k = bisect_left(self.sizes, n)
            if k == len(self.sizes):
                each = self.capacity // n
                full = -(-self.left[n] // each)
                lo = self.sequences
                self.sequences += full
                self._free(self.capacity, lo, lo + full)
                continue
            room = self.sizes[k]
            lo, hi = self.space[room].pop()
            if not self.space[room]:
                del self.space[room], self.sizes[k]
            m = min(hi - lo, self.left[n])
            self._place(n, lo, lo + m, self.capacity - room)
            self._free(room - n, lo, lo + m)
            self._free(room, lo + m, hi)

    def _configurations(self, large: list[int], groups: int) -> None:
        total = sum(self.left[n] for n in large)
        if not total:
            return
        # Linear grouping: each group's ceiling is its longest length; a length belongs to one group.
        tops, need, seen = [], [], 0
        for n in large:
            if not tops or seen >= total * len(tops) / groups:
                tops.append(n)
                need.append(0)
            seen += self.left[n]
            tops[-1] = n
            need[-1] += self.left[n]
        patterns, times = configurations(np.array(tops), np.array(need, float), self.capacity)
        for pattern, many in sorted(zip(patterns, times, strict=True), key=lambda x: (x[0].sum(), -x[1])):
            slots = [g for g in np.flatnonzero(pattern)[::-1] for _ in range(pattern[g])]
            self._substitute([tops[g] for g in slots], [tops[g - 1] if g else 0 for g in slots], int(many), large)

    def _longest(self, most: int, large: list[int]) -> int:
        """The longest left large length up to ``most``, or 0."""
        return next((large[x] for x in range(bisect_right(large, most) - 1, -1, -1) if self.left[large[x]]), 0)

    def _choice(self, top: int, low: int, room: int, large: list[int], last: bool) -> int:
        """The length that takes a slot of size ``top``. Before the last slot: of its group's lengths, down to ``low``, that
        whose space is then filled best by one more piece; the longest one when others follow."""
        first = self._longest(top, large)
        if not last or first <= low:
            return first
        best, out = self.capacity, first
        for x in range(bisect_right(large, top) - 1, bisect_right(large, low) - 1, -1):
            n = large[x]
            if self.left[n]:
                self.left[n] -= 1
                rest = room - n - self._longest(room - n, large)
                self.left[n] += 1
                if rest < best:
                    best, out = rest, n
                if not rest:
                    break
        return out

    def _substitute(self, tops: list[int], lows: list[int], many: int, large: list[int]) -> None:
        """Actual lengths for ``many`` sequences of one configuration, slot by slot; the last slot takes the longest that the
        space allows. Longer pieces than planned leave shorter ones for later slots, so all later configurations still hold
        what is left, and fewer sequences may do: those that nothing is left for are not begun."""
        done, end = self.sequences, self.sequences + many
        while done < end:
            filled, lengths = 0, []
            for k, (top, low) in enumerate(zip(tops, lows, strict=True)):
                room = self.capacity - filled
                n = self._longest(room, large) if k == len(tops) - 1 else self._choice(top, low, room, large, k == len(tops) - 2)
                if n:
                    filled += n
                    lengths.append(n)
                    self.left[n] -= 1
            for n in lengths:
                self.left[n] += 1
            if not lengths:
                break
            # as many sequences alike as the lengths last
            m = min(end - done, *(self.left[n] // lengths.count(n) for n in lengths))
            filled = 0
            for n in lengths:
                self._place(n, done, done + m, filled)
                filled += n
            self._free(self.capacity - filled, done, done + m)
            done += m
        self.sequences = done


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns of ``sizes`` within ``capacity`` and how often to use each, rounded down: least bins for ``need``.

    Column generation to the optimum of the linear program. A knapsack under the current dual values gives, for each size, the
    pattern worth most that holds it; those worth over one bin join the columns, and the simplex method runs on these with an
    explicit inverse. It ends when the dual bound shows that no pattern saves a hundred thousandth of the bins.
    """
    m = len(sizes)
    inverse = np.diag(1.0 / (capacity // sizes))
    basis = np.diag(capacity // sizes).astype(float)
    columns = basis.copy()
    exact = need.astype(float)
    shifted = exact * (1 + 1e-9 * np.arange(1, m + 1))  # no ties in the ratio test, so no cycles
    while True:
        dual = inverse.sum(axis=0)
        priced, worth = _knapsack(sizes, dual, capacity)
        bins = float(dual @ exact)
        if worth.max() <= 1 + 1e-9 or bins - bins / worth.max() <= 1e-5 * bins:
            break
        columns = np.unique(np.hstack([columns[:, dual @ columns > 0.9], priced[:, worth > 1 + 1e-9]]), axis=1)
        while True:
            dual = inverse.sum(axis=0)
            value = dual @ columns
            k = int(value.argmax())
            if value[k] <= 1 + 1e-9:
                break
            step = inverse @ columns[:, k]
            x = np.maximum(inverse @ shifted, 0)
            out = int(np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf).argmin())
            basis[:, out] = columns[:, k]
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
        inverse = np.linalg.inv(basis)
    x = np.maximum(inverse @ exact, 0)
    return [c.astype(int) for c in basis.T], np.floor(x + 1e-6)


def _knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each size, the multiset within the capacity that holds it and is worth most: (a column each, worths)."""
    m, most = len(sizes), int(capacity // sizes.min())
    room = np.arange(capacity + 1)[None, :] - sizes[:, None]
    fits, room = room >= 0, np.maximum(room, 0)
    best, picks = np.zeros(capacity + 1), []
    for _ in range(most - 1):  # best of at most so many pieces, by space
        worth = np.where(fits, best[room] + value[:, None], 0.0)
        pick = worth.argmax(axis=0)
        new = worth[pick, np.arange(capacity + 1)]
        picks.append(np.where(new > best + 1e-12, pick, -1))
        best = np.maximum(best, new)
    columns, left = np.eye(m), capacity - sizes
    own = np.arange(m)
    for pick in reversed(picks):
        chosen = pick[left]
        some = chosen >= 0
        columns[chosen[some], own[some]] += 1
        left = left - np.where(some, sizes[chosen], 0)
    return columns, value @ columns


def pack(docs: DataFrame, keep: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k", end: int = END_ID, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """``keep``, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    pieces = cut(tokenise(docs, keep, text, tokenizer, end, capacity))
    by_task = cut(pieces.groupBy("_task", "length").agg(F.count("*").alias("n")))
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}  # a row a length
    plan = Plan.best(counts, capacity, groups)
    # Each task's first rank by length; one length has one row a task, and the longest history is of tasks, not of rows.
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("_task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_from"))
    # Both grow with the documents, so neither is broadcast; no task has more rows of one length than it read.
    ranked = pieces.hint("merge").join(starts, ["_task", "length"]).withColumn("_rank", F.col("_from") + F.col("_nth"))
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    shipped = spark.sparkContext.broadcast(runs)  # a run a length and configuration: some thousands at any scale
    out = ranked.select(*keep, "piece", "start", "length", "ids_crc32", "_rank")
    schema = T.StructType([*out.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shipped.value
        first = np.searchsorted(r[:, 0], np.arange(capacity + 2)) if len(r) else np.zeros(capacity + 2, np.int64)
        for b in batches:
            length, rank = b.column(len(keep) + 2).to_numpy(), b.column(len(keep) + 4).to_numpy()
            at = np.zeros(b.num_rows, np.int64)
            for n in np.unique(length):
                own = length == n
                at[own] = first[n] + np.searchsorted(r[first[n] : first[n + 1], 1], rank[own], "right") - 1
            found = r[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4].copy())], schema.names)

    return map_arrow(out, run, schema)
