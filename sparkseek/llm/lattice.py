"""Segmentation-marginalised unigram model over a fixed public vocabulary.

A word ``w`` is the character sequence ``_w`` (``_`` the vocabulary's word mark). Its probability is the sum over all
ways to cut it into pieces of the product of the pieces' probabilities: a forward recursion in log space,
``a[j] = logsumexp over pieces s[i:j] of a[i] + log p(piece)``. No piece crosses a word, so a text's marginal
probability is the product of its words'. A character that no piece covers is spelled with byte pieces.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import inf, log

import numpy as np

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(2)
def load(path: str):
    """(processor, pieces): pieces by id, None for those that no lattice uses."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: list[str | None] = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        usable = not (sp.is_unknown(i) or sp.is_control(i)) and MARK not in piece[1:]
        pieces.append(piece if usable else None)
    return sp, pieces


def piece_counts(path: str, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Counts of each piece over the public tokenizer's own segmentation of weighted words."""
    sp, pieces = load(path)
    out = np.zeros(len(pieces))
    for k in range(0, len(words), 20_000):
        ids = sp.encode(words[k : k + 20_000])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        if sizes.sum():
            out += np.bincount(np.concatenate([np.array(x, np.int64) for x in ids if x]), np.repeat(weights[k : k + 20_000], sizes), len(pieces))
    return out


def log_probabilities(counts: np.ndarray, path: str, alpha: float, end: float = 0.0) -> tuple[np.ndarray, float]:
    """Log probabilities of the usable pieces and of the end of a text, with ``alpha`` added to each count."""
    usable = np.array([p is not None for p in load(path)[1]])
    total = counts[usable].sum() + alpha * usable.sum() + end + alpha
    return np.where(usable, np.log((counts + alpha) / total), -np.inf), log((end + alpha) / total)


#: Cells (words times positions times models) that a block of words takes at a time, unless one word has more.
CELLS = 300_000


class Lattice:
    """Log marginal probabilities of words, and expected counts of pieces, under one or more piece distributions.

    Words of one length are worked on together as matrices of characters. Pieces are found by walking a trie, held as sorted
    arrays, from all positions of all words at once. Row 0 of the table stands for no piece.
    """

    def __init__(self, path: str, tables: np.ndarray) -> None:
        """``tables``: (models, pieces) log probabilities."""
        _, pieces = load(path)
        self.models, self.size = tables.shape
        self.table = np.vstack([np.full((1, self.models), -inf), tables.T])
        is_byte = [p is not None and p.startswith("<0x") and p.endswith(">") for p in pieces]
        self.row = {p: i + 1 for i, p in enumerate(pieces) if p is not None and not is_byte[i]}
        self.byte = {int(p[3:5], 16): i + 1 for i, p in enumerate(pieces) if is_byte[i]}
        self.spelt: dict[str, int] = {}
        self.chars = np.unique(np.array([ord(c) for p in self.row for c in p], np.uint32))
        number = {chr(c): k for k, c in enumerate(self.chars.tolist())}
        nodes: dict[int, int] = {}
        ends = {}
        for piece, row in self.row.items():
            at = 0
            for c in piece:
                at = nodes.setdefault(at * len(number) + number[c], len(nodes) + 1)
            ends[at] = row
        self.keys = np.array(sorted(nodes), np.int64)
        self.next = np.array([nodes[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.zeros(len(nodes) + 1, np.int64)
        self.ends[list(ends)] = list(ends.values())

    def _spell(self, char: str) -> int:
        """Row of a character outside the vocabulary: the sum of its bytes' rows, added when it is first met."""
        at = self.spelt.get(char)
        if at is None:
            at = self.spelt[char] = len(self.table)
            own = self.table[[self.byte[b] for b in char.encode("utf-8", "surrogatepass")]].sum(axis=0)
            self.table = np.vstack([self.table, own])
        return at

    def _pieces(self, words: list[str]) -> list[np.ndarray]:
        """For each piece size from 1 on, the rows of the pieces that start at each position of words of one length."""
        codes = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        n, m = len(words), len(codes) // len(words)
        some, back = np.unique(codes, return_inverse=True)
        single = [self.row.get(c) or self._spell(c) for c in map(chr, some.tolist())]
        out = [np.array(single, np.int64)[back].reshape(n, m)]
        known = np.minimum(np.searchsorted(self.chars, some), len(self.chars) - 1)
        # an unknown character's number leads to no node
        number = np.where(self.chars[known] == some, known, -len(self.chars) * (len(self.ends) + 1))[back]
        start, node = np.arange(n * m), np.zeros(n * m, np.int64)
        for size in range(1, m + 1):
            if size > 1:
                inside = start % m + size <= m
                start, node = start[inside], node[inside]
            key = node * len(self.chars) + number[start + size - 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            start, node = start[ok], self.next[at[ok]]
            if not len(start):
                break
            if size > 1:
                rows = np.zeros(n * m, np.int64)
                rows[start] = self.ends[node]
                out.append(rows.reshape(n, m))
        return out

    def _blocks(self, words: list[str]) -> Iterator[np.ndarray]:
        """Numbers of the words in blocks of one length."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(length, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if len(part):
                step = max(1, CELLS // ((int(length[part[0]]) + 2) * self.models))
                yield from (part[lo : lo + step] for lo in range(0, len(part), step))

    def words(self, words: list[str]) -> np.ndarray:
        """(words, models) log marginal probabilities: the forward recursion over many words, position by position."""
        out = np.empty((len(words), self.models))
        for part in self._blocks(words):
            out[part] = self._forward(self._pieces([words[k] for k in part]))[-1]
        return out

    def _forward(self, pieces: list[np.ndarray]) -> np.ndarray:
        """(positions, words, models): log probability of all ways to cut what lies before each position."""
        n, m = pieces[0].shape
        a = np.zeros((m + 1, n, self.models))
        for j in range(1, m + 1):
            a[j] = _log_sum([a[j - size] + self.table[rows[:, j - size]] for size, rows in enumerate(pieces, 1) if size <= j and (size == 1 or rows[:, j - size].any())])
        return a

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected counts of pieces over all segmentations of the weighted words under the only model (forward-backward)."""
        out = np.zeros(self.size + 1)
        for part in self._blocks(words):
            pieces = self._pieces([words[k] for k in part])
            a = self._forward(pieces)
            m = len(a) - 1
            b = np.zeros_like(a)
            for i in range(m - 1, -1, -1):
                b[i] = _log_sum([b[i + size] + self.table[rows[:, i]] for size, rows in enumerate(pieces, 1) if i + size <= m and (size == 1 or rows[:, i].any())])
            counts = np.zeros(len(self.table))
            for size, rows in enumerate(pieces, 1):
                rows = rows[:, : m - size + 1].T
                share = np.exp(np.minimum(0.0, a[: m - size + 1, :, 0] + self.table[rows, 0] + b[size:, :, 0] - a[-1, :, 0])) * weights[part]
                counts += np.bincount(rows.ravel(), share.ravel(), len(counts))
            out += counts[: self.size + 1]
            for char, at in self.spelt.items():
                if counts[at]:
                    for x in char.encode("utf-8", "surrogatepass"):
                        out[self.byte[x]] += counts[at]
        return out[1:]


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    """Log of the sum of exponentials; the first terms are finite."""
    if len(terms) == 1:
        return terms[0]
    top = terms[0]
    for t in terms[1:]:
        top = np.maximum(top, t)
    total = np.exp(terms[0] - top)
    for t in terms[1:]:
        total += np.exp(t - top)
    return top + np.log(total)


class WordScores:
    """Rows of a growing table by word, so that texts add up arrays; emptied when it holds ``limit`` words."""

    def __init__(self, model: Lattice, limit: int) -> None:
        self.model, self.limit = model, limit
        self.at: dict[bytes, int] = {}
        self.table = np.zeros((0, model.models))

    def add(self, words: set[bytes]) -> None:
        """Make sure that all ``words`` have rows."""
        new = words - self.at.keys()
        if len(self.at) + len(new) > self.limit and self.at:
            self.at, self.table, new = {}, self.table[:0], words
        if not new:
            return
        names, n = list(new), len(self.at)
        if n + len(names) > len(self.table):
            grown = np.zeros((max(2 * len(self.table), n + len(names), 4096), self.model.models))
            grown[:n] = self.table[:n]
            self.table = grown
        self.table[n : n + len(names)] = self.model.words([w.decode("utf-8", "replace") for w in names])
        self.at.update(zip(names, range(n, n + len(names)), strict=True))

    def totals(self, texts: list[dict[bytes, int]]) -> np.ndarray:
        """(texts, models): sums of the words' scores, times their counts."""
        self.add(set().union(*texts) if texts else set())
        rows = np.fromiter((r for t in texts for r in map(self.at.__getitem__, t)), np.int64)
        n = np.fromiter((x for t in texts for x in t.values()), float, len(rows))
        sizes = [len(t) for t in texts]
        ends = np.cumsum([0, *sizes])
        out = np.zeros((len(texts), self.model.models))
        full = np.flatnonzero(sizes)
        if len(full):
            out[full] = np.add.reduceat(self.table[rows] * n[:, None], ends[full], axis=0)
        return out
