"""Search kernels over Arrow batches: tiles of queries x rows, so that a task's memory depends on neither table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: A tile of scores: 4 MB of doubles.
ROWS, QUERIES = 1024, 512
#: Rows of one batch that leaves a task.
OUT = 65_536
#: Rows of a unit: of each, the best by code are scored again.
UNIT = 2048
#: Pairs whose vectors are gathered at a time.
PAIRS = 65_536
#: Key of a pair without a score, below every score; not a number stands above every score, as in SQL.
NONE, NAN = -1024.0, np.inf
#: Keys are compared as rounded to nine digits: a key this much lower may still be equal.
SLACK = 2e-9


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def dense(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as doubles, zero where there is no list, and where that is."""
    valid = np.asarray(column.is_valid())
    sizes = np.unique(np.asarray(column.value_lengths().drop_null()))
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[-1]} components")
    out = np.zeros((len(column), sizes[0] if len(sizes) else 0))
    out[valid] = column.flatten().to_numpy(zero_copy_only=False).reshape(int(valid.sum()), -1)
    return out, ~valid


def nearest(u: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """For each row of ``u`` the ``n`` nearest rows of ``c``: by squared distance to nine digits, then by place.

    Those that may be among them come from one product; their distances are then summed in order of the components.
    """
    n = min(n, len(c))
    with np.errstate(invalid="ignore"):
        d = (u * u).sum(1)[:, None] + (c * c).sum(1) - 2 * (u @ c.T)
        edge = np.partition(d, n - 1, axis=1)[:, n - 1 : n] + 2 * SLACK
        r, j = np.nonzero(~(d > edge))
        x, a, b = np.zeros(len(r)), np.ascontiguousarray(u.T), np.ascontiguousarray(c.T)
        for p in range(len(a)):
            x += (a[p][r] - b[p][j]) ** 2
    at = np.lexsort((j, np.round(x, 9), r))
    return j[at][np.searchsorted(r[at], np.arange(len(u)))[:, None] + np.arange(n)]


class Best:
    """The best ``k`` of each query, by key and then by the smaller id, with a second score of each."""

    def __init__(self, queries: int, k: int):
        self.key, self.id, self.also = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max), np.zeros((queries, k))

    def offer(self, at: slice, s: np.ndarray, ids: np.ndarray, also: Callable | None = None) -> None:
        """Keys ``s`` of the queries in ``at`` x ``ids``; ``also(r, c)`` gives the second score of pairs."""
        key, id, more = self.key[at], self.id[at], self.also[at]
        k = key.shape[1]
        low = key[:, -1:] - SLACK
        near = s >= low
        if s.shape[1] > k and np.count_nonzero(near) > 8 * len(s) * k:
            near = s >= np.maximum(low, np.partition(s, -k, axis=1)[:, -k:][:, :1] - SLACK)
            if also and np.count_nonzero(near) > 8 * len(s) * k:  # many copies; without a second score sorting them is cheaper
                near = _first(s, ids, k)
        r, c = np.nonzero(near)
        x, i = np.round(s[r, c], 9), ids[c]
        ok = (x > key[r, -1]) | ((x == key[r, -1]) & (i < id[r, -1]))
        if not ok.any():
            return
        r, c, x, i = r[ok], c[ok], x[ok], i[ok]
        rows, w = np.unique(r, return_inverse=True)
        held = len(rows) * k
        w = np.concatenate([np.repeat(np.arange(len(rows)), k), w])
        x, i = (np.concatenate([old[rows].ravel(), new]) for old, new in ((key, x), (id, i)))
        order = np.lexsort((i, -x, w))
        pick = order[np.searchsorted(w[order], np.arange(len(rows)))[:, None] + np.arange(k)]
        key[rows], id[rows] = x[pick], i[pick]
        if also:  # of those that stay only
            y, new = np.zeros(pick.shape), pick >= held
            y[~new] = more[rows].ravel()[pick[~new]]
            y[new] = also(r[pick[new] - held], c[pick[new] - held])
            more[rows] = y


def _first(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the first ``k`` of each row are: by key to nine digits, then by the smaller id; copies are not sorted."""
    order = np.argsort(ids, kind="stable")
    x = np.round(s[:, order], 9)
    edge = np.partition(x, -k, axis=1)[:, -k:][:, :1]
    above, level = x > edge, x == edge
    level &= np.cumsum(level, axis=1) <= k - above.sum(1)[:, None]
    out = np.empty_like(above)
    out[:, order] = above | level
    return out


def _plain(key: np.ndarray) -> pa.Array:
    return pa.array(np.where(key == NAN, np.nan, key), mask=key == NONE)


def searcher(shipped, k: int, names: list[str], groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kernel over batches (group, id, v[, codes]): at least the best ``k`` of each group and query; ``groups`` are held at a time.

    ``shipped.value``: query ids, their unit vectors, which of them are null, ``None`` or {group: (queries that probe it, ranks)}, ``None``
    or codewords (sub, code, width). With codewords the key is the distance by code and the second score the cosine.
    """

    def leave(group: pa.Scalar, best: Best, asked, ranks, coded: bool) -> Iterator[pa.RecordBatch]:
        n = len(best.key)
        qids = shipped.value[0][asked]
        for lo in range(0, n, max(1, OUT // k)):
            at = slice(lo, lo + max(1, OUT // k))
            key, full = best.key[at], best.key[at] > -np.inf
            x, w = key[full], np.broadcast_to(np.arange(lo, lo + len(key))[:, None], key.shape)[full]
            rank = pa.array(ranks[w]) if ranks is not None else pa.nulls(len(x), pa.int64())
            scores = [_plain(np.where(x == NONE, NONE, -x) + 0.0), _plain(best.also[at][full])] if coded else [pa.nulls(len(x), pa.float64()), _plain(x)]
            yield pa.RecordBatch.from_arrays([pa.repeat(group, len(x)), pa.array(qids[w]), pa.array(best.id[at][full]), rank, *scores], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, no_q, probes, books = shipped.value
        everyone = slice(0, len(qids)), None
        best: dict[pa.Scalar, tuple] = {}
        for b in batches:
            for lo in range(0, b.num_rows if len(qids) else 0, ROWS):
                part = b.slice(lo, ROWS)
                ids = part.column(1).to_numpy()
                x, no_v = dense(part.column(2))
                if not q.shape[1]:
                    q = np.zeros((len(qids), x.shape[1]))
                if not x.shape[1]:
                    x = np.zeros((len(x), q.shape[1]))
                with np.errstate(invalid="ignore"):
                    x = unit(x)
                decoded = _decode(part.column(3), books) if books is not None else None
                coded = part.column(0).dictionary_encode("encode")
                code = coded.indices.to_numpy()
                for c, group in enumerate(coded.dictionary):
                    asked, ranks = everyone if probes is None else probes.get(group.as_py(), (None, None))
                    if asked is None:
                        continue
                    if group not in best:
                        best[group] = (Best(len(qids[asked]), k), asked, ranks)
                    at = np.flatnonzero(code == c) if len(coded.dictionary) > 1 else slice(None)
                    _tile(best[group][0], q, no_q, asked, x[at], no_v[at], ids[at], None if decoded is None else decoded[at])
                while len(best) > groups:  # what is known of a group may leave early: the final ranks see all of it
                    group = next(iter(best))
                    yield from leave(group, *best.pop(group), books is not None)
        for group, found in best.items():
            yield from leave(group, *found, books is not None)

    return run


def _tile(best: Best, q: np.ndarray, no_q: np.ndarray, asked, x: np.ndarray, no_v: np.ndarray, ids: np.ndarray, decoded: np.ndarray | None) -> None:
    for lo in range(0, len(best.key), QUERIES):
        here = slice(lo, min(lo + QUERIES, len(best.key)))
        mine = here if isinstance(asked, slice) else asked[here]
        u, blank = q[mine], no_q[mine]
        with np.errstate(invalid="ignore"):
            if decoded is None:
                s = u @ x.T
                s[:, no_v] = NONE
            else:
                s = 2 * (u @ decoded.T) - (u * u).sum(1)[:, None] - (decoded * decoded).sum(1)
        s[np.isnan(s)] = NAN if decoded is None else NONE
        s[blank] = NONE

        def cosine(r: np.ndarray, c: np.ndarray, u=u, blank=blank) -> np.ndarray:
            y = np.round(np.einsum("ij,ij->i", u[r], x[c]), 9)
            return np.where(blank[r] | no_v[c], NONE, np.where(np.isnan(y), NAN, y))

        best.offer(here, s, ids, None if decoded is None else cosine)


def _decode(codes: pa.Array, books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for."""
    at = codes.flatten().to_numpy(zero_copy_only=False).reshape(len(codes), -1).astype(int)
    return np.concatenate([books[s][at[:, s]] for s in range(len(books))], axis=1)


def edges(u: np.ndarray, c: np.ndarray, nprobe: int) -> np.ndarray:
    """For each row of ``u`` the squared distance to its ``nprobe``-th nearest row of ``c``."""
    n, out = min(nprobe, len(c)) - 1, np.empty(len(u))
    for lo in range(0, len(u), QUERIES):
        out[lo : lo + QUERIES] = np.partition(_squared(u[lo : lo + QUERIES], c), n, axis=1)[:, n]
    return out


def _squared(u: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return (u * u).sum(1)[:, None] + (c * c).sum(1) - 2 * (u @ c.T)


def reranker(shipped, k: int, keep: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kernel over batches (unit, cell_id, id, v, codes), rows of a unit side by side and in order of their cells: the best ``k`` of each query.

    In each unit the best ``keep`` by code of the rows in probed cells are scored exactly. ``shipped.value``: query ids, their unit vectors,
    the distance up to which each probes cells, cell ids in order, their centroids, codewords (sub, code, width).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, edge, cells, centroids, books = shipped.value
        best = Best(len(qids), k)
        for part in _units(batches) if len(qids) else ():
            with np.errstate(invalid="ignore"):
                x = unit(dense(part.column(3))[0])
            ids, decoded = part.column(2).to_numpy(), _decode(part.column(4), books)
            here, first = np.unique(part.column(1).to_numpy(), return_index=True)
            c = centroids[np.searchsorted(cells, here)]
            for lo in range(0, len(qids), QUERIES):
                at = slice(lo, min(lo + QUERIES, len(qids)))
                _again(best, at, q[at], edge[at], c, [*first, len(ids)], x, decoded, ids, keep)
        for lo in range(0, len(qids), max(1, OUT // k)):
            at = slice(lo, lo + max(1, OUT // k))
            full = best.key[at] > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(qids[at, None], full.shape)[full]), pa.array(best.id[at][full]), _plain(best.key[at][full])], names)

    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one unit each; a unit of more than twice its usual rows comes in pieces."""
    held: list[pa.RecordBatch] = []
    for b in chain(batches, [None]):
        if b is not None and b.num_rows:
            held.append(b)
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            unit_of = t.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(unit_of)) + 1), len(unit_of)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                while hi - lo > 2 * UNIT:
                    yield t.slice(lo, 2 * UNIT).to_batches()[0]
                    lo += 2 * UNIT
                if b is None or hi < len(unit_of):
                    yield t.slice(lo, hi - lo).to_batches()[0]
            held = t.slice(lo).to_batches()


def _again(best: Best, at: slice, u: np.ndarray, edge: np.ndarray, c: np.ndarray, bounds: list[int], x: np.ndarray, decoded: np.ndarray, ids: np.ndarray, keep: int) -> None:
    """Offers what queries ``u`` find in one unit, whose cells have centroids ``c`` and begin at ``bounds``."""
    probed = ~(_squared(u, c) > edge[:, None] + SLACK)
    size, d = (decoded * decoded).sum(1), np.full((len(u), len(ids)), -np.inf)
    with np.errstate(invalid="ignore"):
        for j in range(len(c)):
            r, rows = np.flatnonzero(probed[:, j]), slice(bounds[j], bounds[j + 1])
            s = 2 * (u[r] @ decoded[rows].T) - size[rows]
            d[r, rows] = np.where(np.isnan(s), NONE, s)
        chosen = d > -np.inf
        if len(ids) > keep:
            chosen &= d >= np.partition(d, -keep, axis=1)[:, -keep:][:, :1]
        r, col = np.nonzero(chosen)
        d.fill(-np.inf)
        for lo in range(0, len(r), PAIRS):
            a, b = r[lo : lo + PAIRS], col[lo : lo + PAIRS]
            y = np.einsum("ij,ij->i", u[a], x[b])
            d[a, b] = np.where(np.isnan(y), NAN, y)
    best.offer(at, d, ids)


def kmeans_start(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` rows of ``x`` as first centroids."""
    return x[np.sort(np.random.default_rng(seed).choice(len(x), k, replace=False))].copy()


def kmeans_sums(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For centroids ``c``: number and sum of the rows nearest to each, and the farthest rows of ``x`` with their distances."""
    n, s, near, size = np.zeros(len(c), np.int64), np.zeros(c.shape), np.zeros(len(x)), (c * c).sum(1)
    for lo in range(0, len(x), ROWS):
        part = x[lo : lo + ROWS]
        d = size - 2 * (part @ c.T)
        a = d.argmin(1)
        near[lo : lo + ROWS] = d[np.arange(len(part)), a] + (part * part).sum(1)
        order = np.argsort(a, kind="stable")
        which, first, count = np.unique(a[order], return_index=True, return_counts=True)
        n[which] += count
        s[which] += np.add.reduceat(part[order].astype(float), first, axis=0)
    far = np.argsort(-near, kind="stable")[: len(c)]
    return n, s, x[far], near[far]


def kmeans_step(c: np.ndarray, parts: list[tuple]) -> np.ndarray:
    """The next centroids; those without rows move to the rows farthest from theirs."""
    n, s = sum(p[0] for p in parts), sum(p[1] for p in parts)
    out, none = c.copy(), np.flatnonzero(n == 0)
    out[n > 0] = s[n > 0] / n[n > 0, None]
    if len(none):
        far, d = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        top = np.argsort(-d, kind="stable")[: len(none)]
        out[none[: len(top)]] = far[top]
    return out
