"""Language-model scoring with a small causal self-attention model, trained in numpy on subword ids.

Words, subword pieces and which piece follows which are counted over all training documents on the
cluster. The model gives the class of the next piece (pieces that follow alike share a class); a piece
within its class has its share of the corpus counts. The attention layer is trained on every piece of all
distinct training texts, in rounds on the cluster. Texts are scored whole, in overlapping context windows that
score each piece once, with batched masked attention.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm._memory import only, remembers
from lagweave.llm._shared import dropped, shared_folder, written
from lagweave.llm._split import remainder
from lagweave.llm._words import LOWER, find_words, row_blocks, utf8
from lagweave.llm.sentencepiece_scan import default_model

#: Width of the model, pieces in a window, new pieces in each later window, classes, own embeddings.
DIM, WINDOW, STRIDE, CLASSES, EMBEDDED = 16, 32, 16, 48, 2000
#: Words whose counts are shared with every task; the others are joined.
SHARED_WORDS = 200_000
#: Words that a worker remembers the pieces of, from one task to the next; about 50 bytes each.
_KEPT = 1_000_000
#: Windows of a row of training pieces, as they are scored; without the first one's overlap it holds 32 whole windows.
RUN = 63
#: Windows of a cell (about), groups of cells (at least), rounds over the groups, steps of a cell in its round.
CELL, GROUPS, ROUNDS, LOCAL = 4096, 8, 24, 64
#: Cells of a file of training pieces, at most, about; windows whose gradients are taken at once.
FILE_CELLS, AT_ONCE = 64, 32
#: Keys of training rows that a task remembers, so that it gives copies once.
_REMEMBERED = 1_000_000
#: Numbers that stand for what a piece follows.
_SKETCH = 48
END = np.uint64(0x656E64)  # stands for the end of a text in word counts


@cache
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Splitter:
    """Subword ids of lower-cased words, remembered by word hash up to a bound.

    The hashes lie in an open table of at most half its slots, by their leading bits, so that sorted ones
    are looked up and put in from its one end to the other, all at once.
    """

    def __init__(self, path: str) -> None:
        self.model = _pieces(path)
        self.vocabulary = self.model.get_piece_size()
        self.end = self.vocabulary  # one id more, for the end of a text
        self.forget()

    def forget(self) -> None:
        """Drops what is remembered of words."""
        self.flat, self.edges, self.many, self.used = np.zeros(1 << 16, np.int32), np.zeros((1 << 14) + 1, np.int32), 0, 0
        self._open(16)

    def _open(self, bits: int) -> None:
        self.bits, self.key, self.row = bits, np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for a new one."""
        slot, out, left = self._slot(hashes), np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        while len(left):
            row = self.row[slot]
            same = self.key[slot] == hashes[left]
            same &= row >= 0
            out[left[same]] = row[same]
            on = (row >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) & (len(self.key) - 1)
        return out

    def _put(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        """Notes distinct new words."""
        slot = self._slot(hashes)
        while len(hashes):
            free = np.flatnonzero(self.row[slot] < 0)
            self.row[slot[free]] = rows[free]  # of several for a slot the last stays
            on = self.row[slot] != rows
            self.key[slot[~on]] = hashes[~on]
            hashes, rows, slot = hashes[on], rows[on], (slot[on] + 1) & (len(self.key) - 1)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Cuts distinct new words; their numbers."""
        size = ends - starts + 1  # with a line feed, which no word holds
        over = np.cumsum(size)
        raw = LOWER[data[np.minimum(np.arange(over[-1]) + np.repeat(starts - over + size, size), len(data) - 1)]]
        raw[over - 1] = 10
        got = self.model.encode(raw[:-1].tobytes().decode(errors="replace").split("\n"), num_threads=1)  # a task has one core
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum()))
        many, used = self.many + len(got), self.used + len(ids)
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(used, np.int32)])
        if many >= len(self.edges):
            self.edges = np.concatenate([self.edges, np.zeros(many, np.int32)])
        self.flat[self.used : used] = ids
        self.edges[self.many + 1 : many + 1] = self.used + np.cumsum(sizes)
        rows = np.arange(self.many, many, dtype=np.int32)
        self.many, self.used = many, used
        if 2 * many > len(self.key):
            at = np.flatnonzero(self.row >= 0)
            kept, old = self.key[at], self.row[at]
            self._open((2 * many).bit_length())
            self._put(kept, old)
        self._put(hashes, rows)
        return rows

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, begins, sizes) of distinct words, given where each stands once; good until the next call."""
        row = self._find(hashes)
        new = np.flatnonzero(row < 0)
        if len(new) and self.many and (self.many + len(new) > _KEPT or self.used > 8 * _KEPT):
            self.forget()
            row, new = np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        if len(new):
            row[new] = self._learn(data, starts[new], ends[new], hashes[new])
        begin = self.edges[row].astype(np.int64)
        return self.flat, begin, self.edges[row + 1] - begin

    def sequences(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row bounds): the pieces of each row's words and then the end, ``begin`` and ``size`` by word."""
        rows = len(bounds) - 1
        before = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=before[1:])
        edges = before[bounds] + np.arange(rows + 1)
        out = np.full(int(edges[-1]), self.end, np.int32)
        shift = np.repeat(np.arange(rows), np.diff(bounds))
        step = np.arange(int(before[-1]))
        out[step + np.repeat(shift, size)] = flat[np.repeat(begin - before[:-1], size) + step]
        return out, edges


@cache
def _splitter(path: str) -> Splitter:
    return Splitter(path)


def splitter_of(path: str) -> Splitter:
    """The splitter of a file, one for all tasks of a worker; other operators' caches there are dropped."""
    only("words")
    s = _splitter(path)
    remembers("words", s.forget)
    return s


@dataclass
class Network:
    """Embeddings by rank (0: start of text, 1: rare), one attention layer, and class logits."""

    rank: np.ndarray  # piece id -> embedding row
    group: np.ndarray  # piece id -> class
    inside: np.ndarray  # piece id -> ln share within its class
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, rows: int, classes: int, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        n = lambda *s, by=0.1: (r.standard_normal(s) * by).astype(np.float32)
        self.weights = {"E": n(rows, DIM, by=0.3), "P": n(WINDOW, DIM), "Q": n(DIM, DIM, by=0.25), "K": n(DIM, DIM, by=0.25), "V": n(DIM, DIM, by=0.25), "O": n(DIM, DIM, by=0.25), "U": n(DIM, classes, by=0.25), "b": np.zeros(classes, np.float32)}

    def forward(self, x: np.ndarray, first: int) -> tuple[np.ndarray, ...]:
        """Logits for positions ``first`` on of windows ``x`` (embedding rows of the pieces before)."""
        w, n = self.weights, x.shape[1]
        h = w["E"][x] + w["P"][:n]
        hq = h[:, first:]
        q, k, v = hq @ w["Q"], h @ w["K"], h @ w["V"]
        s = q @ k.transpose(0, 2, 1)
        s *= np.float32(DIM**-0.5)
        s += _mask(n)[first:]
        s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(-1, keepdims=True)
        o = s @ v
        z = hq + o @ w["O"]
        return z @ w["U"] + w["b"], z, o, s, q, k, v, h

    def folded(self) -> dict[str, np.ndarray]:
        """Weights for scoring: biases, scales and sums are columns of the same products.

        What a position gives is a sum of a row by its piece and one by its place: h, q, and (k, v O).
        """
        w = self.weights
        one = lambda m, right: np.block([[m, np.zeros((DIM, right), np.float32)], [np.zeros((1, m.shape[1]), np.float32), np.ones((1, right), np.float32)]])
        e, p = np.hstack([w["E"], np.ones((len(w["E"]), 1), np.float32)]), np.hstack([w["P"], np.zeros((WINDOW, 1), np.float32)])
        q, kv = one(w["Q"] * np.float32(DIM**-0.5), 0), np.hstack([one(w["K"], 0), one(w["V"] @ w["O"], 1)])
        return {
            "E_h": e, "P_h": p, "E_q": e @ q, "P_q": p @ q, "E_kv": e @ kv, "P_kv": p @ kv, "U": np.vstack([w["U"], w["b"]]),
            "mask": np.ascontiguousarray(_seen(WINDOW).T), "ones": np.ones(w["U"].shape[1], np.float32),
        }

    def chosen(self, w: dict[str, np.ndarray], x: np.ndarray, first: int, group: np.ndarray) -> np.ndarray:
        """ln probability of the classes ``group`` at positions ``first`` on, as by ``forward``."""
        late = x[:, first:]
        z = w["E_h"].take(late, 0)
        z += w["P_h"][first:]
        q = w["E_q"].take(late, 0)
        q += w["P_q"][first:]
        kv = w["E_kv"].take(x, 0)
        kv += w["P_kv"]
        s = kv[..., :DIM] @ np.ascontiguousarray(q.transpose(0, 2, 1))  # a row for each piece that is seen
        np.exp(s, out=s)
        s *= w["mask"] if first == 0 else np.ascontiguousarray(w["mask"][:, first:])
        o = (s.transpose(0, 2, 1) @ kv[..., DIM:]).reshape(-1, DIM + 1)
        o /= o[:, DIM:].copy()
        o[:, DIM] = 0
        o += z.reshape(-1, DIM + 1)
        logits = o @ w["U"]
        picked = logits.ravel().take(np.arange(0, logits.size, logits.shape[1]) + group.ravel())
        np.exp(logits, out=logits)
        out = picked - np.log(logits @ w["ones"])
        if not np.isfinite(out).all():  # beyond float32 without shifting
            stable = self.forward(x, first)[0].reshape(len(out), -1).astype(float)
            stable -= stable.max(1, keepdims=True)
            out = stable[np.arange(len(out)), group.ravel()] - np.log(np.exp(stable).sum(1))
        return out.reshape(group.shape)

    def gradient(self, x: np.ndarray, y: np.ndarray, share: float) -> dict[str, np.ndarray]:
        """Of the sum of ``share`` times the class cross-entropies of windows ``x`` with targets ``y`` (-1: none).

        As in ``folded``, biases and sums are columns of the products. Attention is not divided by its
        sums; what goes back to it is. Second factors lie as the products read them.
        """
        w, (rows, n), classes = self.weights, x.shape, self.weights["U"].shape[1]
        scale, share = np.float32(DIM**-0.5), np.float32(share)
        into = np.hstack([w["Q"] * scale, w["K"], w["V"]])
        out, seen, ones = np.vstack([w["U"], w["b"]]), _seen(n), np.ones(max(n, classes), np.float32)
        into_t, out_t, o_t = (np.ascontiguousarray(m.T) for m in (into, w["U"], w["O"]))
        g = {k: np.zeros_like(m) for k, m in (("U", out), ("O", w["O"]), ("Q", into), ("P", w["P"]))}
        given = np.empty((rows * n, DIM), np.float32)
        room = lambda name, *shape: _room(name, AT_ONCE, *shape)[:some]
        for low in range(0, rows, AT_ONCE):
            part = x[low : low + AT_ONCE]
            some, goal = len(part), y[low : low + AT_ONCE].ravel()
            cells = some * n
            h = w["E"].take(part, 0, out=room("h", n, DIM), mode="clip")
            h += w["P"][:n]
            h = h.reshape(cells, DIM)
            qkv = np.matmul(h, into, out=room("qkv", n, 3 * DIM).reshape(cells, -1)).reshape(some, n, 3 * DIM)
            q, k, v = qkv[..., :DIM], room("k", DIM, n), room("v", DIM + 1, n)
            k[:], v[:, :DIM], v[:, DIM] = qkv[..., DIM : 2 * DIM].transpose(0, 2, 1), qkv[..., 2 * DIM :].transpose(0, 2, 1), 1
            a = _exp(np.matmul(q, k, out=room("a", n, n)), seen)
            o = np.matmul(a, qkv[..., 2 * DIM :], out=room("o", n, DIM)).reshape(cells, DIM)
            each = 1 / (a.reshape(cells, n) @ ones[:n])[:, None]
            o *= each
            z = room("z", n, DIM + 1).reshape(cells, DIM + 1)
            np.add(o @ w["O"], h, out=z[:, :DIM])
            z[:, DIM] = 1
            d = _exp(np.matmul(z, out, out=room("d", n, classes).reshape(cells, classes)))
            real = goal >= 0
            d *= (real * share / (d @ ones[:classes]))[:, None]
            at = np.flatnonzero(real)
            d.reshape(-1)[at * classes + goal[at]] -= share
            dz = d @ out_t
            do = room("do", n, DIM + 1).reshape(cells, DIM + 1)
            np.multiply(dz @ o_t, each, out=do[:, :DIM])
            np.negative(np.einsum("ij,ij->i", do[:, :DIM], o), out=do[:, DIM])
            do = do.reshape(some, n, DIM + 1)
            ds = np.matmul(do, v, out=room("ds", n, n))
            ds *= a
            back = room("back", n, 3 * DIM)
            np.matmul(ds, qkv[..., DIM : 2 * DIM], out=back[..., :DIM])
            np.matmul(ds.transpose(0, 2, 1), q, out=back[..., DIM : 2 * DIM])
            np.matmul(a.transpose(0, 2, 1), do[..., :DIM], out=back[..., 2 * DIM :])
            back = back.reshape(cells, 3 * DIM)
            dh = np.matmul(back, into_t, out=given[low * n : low * n + cells])
            dh += dz
            for name, m in (("U", z.T @ d), ("O", o.T @ dz), ("Q", h.T @ back), ("P", dh.reshape(some, n, DIM).sum(0))):
                g[name][: len(m)] += m
        q, k, v = (g["Q"][:, low : low + DIM] for low in range(0, 3 * DIM, DIM))
        sums = np.zeros(w["E"].size // 2, np.complex64)  # a complex number adds two at once
        np.add.at(sums, _places(len(w["E"])).take(x.ravel(), 0).ravel(), given.view(np.complex64).ravel())
        return g | {"U": g["U"][:DIM], "b": g["U"][DIM], "Q": q * scale, "K": k, "V": v, "E": sums.view(np.float32).reshape(-1, DIM)}

    def fit(self, windows: np.ndarray, targets: np.ndarray, steps: int = 1500, batch: int = 64, rate: float = 0.01, done: int = 0, total: int | None = None) -> None:
        """Adam on the class cross-entropy of (windows, targets); a target of -1 doesn't count.

        Each pass takes every window once. The rate falls to 0 over ``total`` steps (``steps`` by
        default), of which ``done`` lie before.
        """
        r, names = np.random.default_rng(5 + done), list(self.weights)
        flat = np.concatenate([self.weights[k].ravel() for k in names])
        at = np.cumsum([0] + [self.weights[k].size for k in names])
        self.weights = {k: flat[a:b].reshape(self.weights[k].shape) for k, a, b in zip(names, at, at[1:])}
        m1, m2 = np.zeros_like(flat), np.zeros_like(flat)  # 10 and 100 times the means of gradients and squares
        passes = -(-steps * batch // max(1, len(windows)))
        order = np.concatenate([r.permutation(len(windows)) for _ in range(passes)]) if len(windows) else np.zeros(0, np.int64)
        for step in range(1, steps + 1 if len(windows) else 1):
            pick = order[(step - 1) * batch : step * batch]
            x, y = windows[pick], targets[pick]
            got = self.gradient(x, y, 1 / max(1, (y >= 0).sum()))
            g = np.concatenate([got[k].ravel() for k in names], out=_room("gradient", len(flat)))
            lr = rate * min(1.0, step / 20) * (1 - (done + step) / ((total or steps) + 1))
            m1 *= 0.9
            m1 += g
            m2 *= 0.99
            g *= g
            m2 += g
            np.sqrt(m2, out=g)
            g *= (0.01 / (1 - 0.99**step)) ** 0.5
            g += 1e-8
            np.divide(m1, g, out=g)
            g *= 0.1 * lr / (1 - 0.9**step)
            flat -= g

    def score(self, ids: np.ndarray, edges: np.ndarray, at_once: int = 128) -> np.ndarray:
        """ln probability of each row's pieces (ids from edges[r] to edges[r + 1])."""
        total = np.zeros(len(edges) - 1)
        if not len(ids):
            return total
        w, padded = self.folded(), len(ids) + WINDOW
        before, group, gained = np.zeros(padded, np.int64), np.zeros(padded, np.int64), np.zeros(padded)
        before[1 : len(ids)] = self.rank[ids[:-1]]
        before[edges[:-1]] = 0
        group[: len(ids)], gained[: len(ids)] = self.group[ids], self.inside[ids]
        sizes = np.diff(edges)
        later = np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
        heads = (edges[:-1], edges[1:])
        tails_row = np.repeat(np.arange(len(sizes)), later)
        nth = np.arange(int(later.sum())) - np.repeat(np.cumsum(later) - later, later) + 1
        tails = (edges[:-1][tails_row] + nth * STRIDE, edges[1:][tails_row])
        given = np.lib.stride_tricks.sliding_window_view(before, WINDOW)
        for (begin, over), first in ((heads, 0), (tails, WINDOW - STRIDE)):
            goal, taken = (np.lib.stride_tricks.sliding_window_view(m, WINDOW - first, writeable=m is gained) for m in (group, gained))
            whole = begin + WINDOW <= over
            for full in (True, False):
                mine = np.flatnonzero(whole == full)
                for low in range(0, len(mine), at_once):
                    b, e = begin[mine[low : low + at_once]], over[mine[low : low + at_once]]
                    got = self.chosen(w, given[b], first, goal[b + first])
                    if full:
                        taken[b + first] += got  # each piece is in one window's
                    else:
                        to = b[:, None] + np.arange(first, WINDOW)
                        real = to < e[:, None]
                        gained[to[real]] += got[real]
        sums = np.concatenate([[0.0], np.cumsum(gained[: len(ids)])])
        return sums[edges[1:]] - sums[edges[:-1]]


@cache
def _mask(n: int) -> np.ndarray:
    return np.triu(np.full((n, n), -1e9, np.float32), 1)


@cache
def _seen(n: int) -> np.ndarray:
    return np.tril(np.ones((n, n), np.float32))


@cache
def _room(name: str, *shape: int) -> np.ndarray:
    """Memory that is used again; fresh arrays of this size would cost more than what is done with them."""
    return np.empty(shape, np.float32)


@cache
def _places(rows: int) -> np.ndarray:
    """Where the numbers of each embedding lie, two and two."""
    return np.arange(rows * DIM // 2).reshape(rows, -1)


def _exp(x: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """exp in place, 0 where not ``seen``; shifted by each row's largest entry where float32 would not hold it."""
    if x.max() > 60 or x.min() < -60:
        if seen is not None:
            x += (seen - 1) * np.float32(1e9)
        x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    return x if seen is None else np.multiply(x, seen, out=x)


def class_of(pieces: np.ndarray, sketches: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Classes of all piece ids: k-means over what the ``pieces`` follow; those that follow nothing by frequency."""
    group = CLASSES - 4 + np.minimum(3, (np.log2(counts + 1) / 4).astype(np.int64))
    if len(pieces) == 0:
        return group
    k = min(CLASSES - 4, len(pieces))
    order = np.argsort(-counts[pieces], kind="stable")
    frequent = np.sort(order[:EMBEDDED])  # these place the centres; the rest go to the nearest
    centres = sketches[order[:k]].copy()
    nearest = lambda rows: np.argmin((centres**2).sum(1)[None] - 2 * rows @ centres.T, 1)
    for _ in range(12):
        mine = nearest(sketches[frequent])
        for c in range(k):
            if (mine == c).any():
                centres[c] = sketches[frequent[mine == c]].mean(0)
    group[pieces] = nearest(sketches)
    return group


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows with their words: hashes, distinct hashes, where each stands, inverse, bounds."""
    for batch in batches:
        data, offsets = utf8(batch.column(text_at))
        for low, high in row_blocks(offsets):
            part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            starts, ends, hashes, bounds = find_words(part, at, LOWER)
            order = np.argsort(hashes)  # any occurrence of a word will do, so that no stable sort is needed
            new = np.diff(hashes[order], prepend=~hashes[order[:1]]) != 0
            where, inverse = order[new], np.empty(len(hashes), np.int64)
            inverse[order] = np.cumsum(new) - 1
            distinct = hashes[where]
            yield batch, low, high, part, starts[where], ends[where], distinct, inverse, bounds


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes of 64-bit numbers."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


WORD, PIECE, PAIR, DRAWN = range(4)  # DRAWN: pieces to train on


class Tally:
    """Sums of counts by 64-bit codes; a part is given out when over ``most`` distinct ones are held."""

    def __init__(self, most: int) -> None:
        self.most, self.fresh, self.waiting = most, [], 0

    def add(self, codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.fresh.append((codes, n))
        self.waiting += len(codes)
        if self.waiting <= self.most * 2:
            return None
        merged = self.merged()
        if len(merged[0]) > self.most:
            self.fresh, self.waiting = [], 0
            return merged
        self.fresh, self.waiting = [merged], len(merged[0])
        return None

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        codes, inverse = np.unique(np.concatenate([c for c, _ in self.fresh]), return_inverse=True)
        return codes, np.bincount(inverse, np.concatenate([n for _, n in self.fresh])).astype(np.int64)


def code_of(width: int) -> np.dtype:
    """How a piece of ``width`` ids, plus 1, is written in a packed row; 0 is the start of a text."""
    return np.dtype(np.uint16 if width < 1 << 16 else np.uint32)


def packed(flat: np.ndarray, edges: np.ndarray, code: np.dtype) -> pa.Array:
    """A binary for each row of pieces; Spark copies it whole, where it would take a list number by number."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * code.itemsize).astype(np.int32)), pa.py_buffer((flat + 1).astype(code))])


def unpacked(column: pa.Array, code: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, edges of the rows) of packed rows."""
    data, at = utf8(column)
    return data.view(code).astype(np.int32) - 1, at // code.itemsize


def lists_of(name: str, width: int) -> Column:
    """A column of packed rows as lists of ids."""
    code = code_of(width)

    @F.arrow_udf("array<int>")
    def lists(column: pa.Array) -> pa.Array:
        flat, edges = unpacked(column, code)
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat), mask=column.is_null())

    return lists(name)


def packs_of(name: str, width: int) -> Column:
    """A column of lists of ids as packed rows."""
    code = code_of(width)

    @F.arrow_udf("binary")
    def packs(column: pa.Array) -> pa.Array:
        return packed(column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]), code)

    return packs(name)


def gathered(docs: DataFrame, run: float, model_path: str) -> DataFrame:
    """``gathered_packed`` with lists of pieces, ``ids``, for ``packed``."""
    return gathered_packed(docs, run, model_path).select("kind", "id", "n", "before", "ns", lists_of("packed", Splitter(model_path).vocabulary + 1).alias("ids"))


def gathered_packed(docs: DataFrame, run: float, model_path: str) -> DataFrame:
    """All that is learned from the rows of ``docs`` (text), in one pass: (kind, id, n, before, ns, packed), summed per task.

    WORD and PIECE: how often each word (by hash) and subword id occurs, ends included. PAIR: the pieces
    ``before`` a piece ``id`` and how often (``ns``). DRAWN: all pieces of all texts, in rows of ``run``
    windows as they are scored; ``packed`` are the piece before (-1 at the start) and the row's pieces. The
    hash ``id`` is of the text and the place in it, so copies of a text have the same, and a task gives
    them once for each ``_REMEMBERED`` others.
    """
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("before", pa.list_(pa.int32())), ("ns", pa.list_(pa.int64())), ("packed", pa.binary())])
    wide = STRIDE * int(run)

    def row(kind: int, key: np.ndarray, **more: pa.Array) -> pa.RecordBatch:
        columns = {"kind": pa.array(np.full(len(key), kind, np.int32)), "id": pa.array(key.astype(np.int64))} | more
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(len(key), f.type) for f in schema], schema=schema)

    def pairs(codes: np.ndarray, n: np.ndarray, width: int) -> pa.RecordBatch:
        after, before = codes // width, codes % width
        at = np.flatnonzero(np.concatenate([[True], after[1:] != after[:-1]]))
        edges = pa.array(np.append(at, len(codes)).astype(np.int32))
        return row(PAIR, after[at], before=pa.ListArray.from_arrays(edges, pa.array(before.astype(np.int32))), ns=pa.ListArray.from_arrays(edges, pa.array(n)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = splitter_of(model_path)
        width = splitter.vocabulary + 1
        pieces = np.zeros(width, np.int64)
        words, steps, given = Tally(500_000), Tally(1_500_000), set()
        for batch, low, high, data, starts, stops, distinct, inverse, bounds in _blocks(batches, 0):
            if len(distinct) and (full := words.add(distinct, np.bincount(inverse, minlength=len(distinct)))):
                yield row(WORD, full[0].view(np.int64), n=pa.array(full[1]))
            flat, begin, size = splitter.words(data, starts, stops, distinct)
            ids, edges = splitter.sequences(flat, begin[inverse], size[inverse], bounds)
            pieces += np.bincount(ids, minlength=width)
            first = np.zeros(len(ids), bool)
            first[edges[:-1]] = True  # every row has its end
            later = np.flatnonzero(~first)
            if full := steps.add(*np.unique(ids[later].astype(np.int64) * width + ids[later - 1], return_counts=True)):
                yield pairs(*full, width)
            sizes = np.diff(edges)
            each = 1 + np.maximum(0, -(-(sizes - wide - WINDOW + STRIDE) // wide))
            line = np.repeat(np.arange(len(sizes)), each)
            nth = np.arange(len(line)) - np.repeat(np.cumsum(each) - each, each)
            text = batch.column(1).slice(low, high - low).to_numpy(zero_copy_only=False).view(np.uint64)
            key = _mixed(text[line] + _mixed(nth + 1))
            first = np.unique(key, return_index=True)[1]  # once for the copies of this block
            fresh = np.array([k not in given for k in key[first].tolist()], bool)
            new = np.sort(first[fresh])
            given = given if len(given) < _REMEMBERED else set()
            given.update(key[new].tolist())
            start = edges[:-1][line[new]] + nth[new] * wide
            size = np.minimum(start + wide + WINDOW - STRIDE, edges[1:][line[new]]) - start + 1
            cuts = np.zeros(len(new) + 1, np.int32)
            np.cumsum(size, out=cuts[1:])
            got = ids[np.maximum(np.arange(cuts[-1]) + np.repeat(start - 1 - cuts[:-1], size), 0)]
            got[cuts[:-1][nth[new] == 0]] = -1
            yield row(DRAWN, key[new].view(np.int64), packed=packed(got, cuts.astype(np.int64), code_of(width)))
        if words.fresh:
            ids, n = words.merged()
            yield row(WORD, ids.view(np.int64), n=pa.array(n))
        if steps.fresh and len((last := steps.merged())[0]):
            yield pairs(*last, width)
        if pieces[-1]:
            yield row(WORD, np.array([END]).view(np.int64), n=pa.array(pieces[-1:]))
            seen = np.flatnonzero(pieces)
            yield row(PIECE, seen, n=pa.array(pieces[seen]))

    return docs.select("text", F.xxhash64("text").alias("h")).mapInArrow(work, "kind int, id long, n long, before array<int>, ns array<long>, packed binary")


def sketched(found: DataFrame, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, sketches): a few random projections of what each piece follows, over the whole corpus."""
    axes = np.random.default_rng(11).standard_normal((int(rank.max()) + 1, _SKETCH)).astype(np.float32)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten()
            before, n = rank[flat.field(0).to_numpy()], flat.field(1).to_numpy().astype(np.float64)
            edges = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                sums = np.bincount(before[a:b], n[a:b])
                at = np.flatnonzero(sums)
                out.append((np.sqrt(sums[at] / sums.sum()).astype(np.float32) @ axes[at]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32()))], names=["next", "sketch"])

    each = found.where(F.col("kind") == PAIR).select("id", F.explode(F.arrays_zip("before", "ns")).alias("p")).groupBy("id", F.col("p.before").alias("before")).agg(F.sum("p.ns").alias("n"))
    lists = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("before", "n"))).alias("p"))  # at most as many entries as the vocabulary
    got = sorted((r["next"], r["sketch"]) for r in lists.mapInArrow(project, "next long, sketch array<float>").collect())  # as many as the vocabulary
    return np.array([p for p, _ in got], np.int64), np.array([v for _, v in got], np.float32).reshape(-1, _SKETCH)


def fit_on_cluster(net: Network, rows: DataFrame, cells: int) -> int:
    """Trains ``net`` on all (key, ids) of ``rows``, in rounds; the number of cells that took part.

    ``ids`` are the piece before and the pieces of a row, of any number; copies of a key count once.
    Where ``rows`` have them ``packed`` too, that is read and the lists are never made.
    Rows are dealt into ``cells`` by key, so the result does not hang on how they lie. In a round the
    cells of one group each go over all of their windows from the common weights (a small one
    repeatedly, for about ``LOCAL`` steps); tasks sum the changes of their cells and the driver averages
    them (an embedding over the cells that hold it). With ``ROUNDS`` cells or more each takes part in
    one round, with fewer in up to ``ROUNDS`` / ``GROUPS``.
    """
    spark = rows.sparkSession
    groups = min(ROUNDS, max(GROUPS, cells))
    files = min(-(-cells // groups), max(2 * spark.sparkContext.defaultParallelism, -(-cells // (groups * FILE_CELLS))))
    cell = F.pmod("key", F.lit(cells)).cast("int")
    code, pieces = code_of(len(net.rank)), F.col("packed") if "packed" in rows.columns else packs_of("ids", len(net.rank))
    dealt = rows.select(cell.alias("cell"), (cell % groups).alias("part"), (F.floor(cell / groups) % files).alias("file"), "key", pieces.alias("packed"))
    dealt = dealt.repartition(groups * files, "part", "file").sortWithinPartitions("part", "cell", "key").drop("file")
    path = f"{shared_folder(spark)}/lagweave-{uuid.uuid4().hex}"
    dealt.write.partitionBy("part").parquet(path)
    saved = spark.read.schema("cell int, key long, packed binary, part int").parquet(path)
    saved.written_at = path
    seen = 0
    for n in range(ROUNDS):
        shared = spark.sparkContext.broadcast(net)

        def change(batches: Iterator[pa.RecordBatch], n: int = n, shared=shared) -> Iterator[pa.RecordBatch]:
            common = shared.value
            rank = np.append(common.rank, 0)  # -1 is the start
            sums = {k: np.zeros(v.shape, np.float64) for k, v in common.weights.items()}
            holding, count = np.zeros(len(sums["E"])), 0
            cell, last, held = None, None, []

            def close() -> None:
                nonlocal count
                x, y = (np.concatenate(part) for part in zip(*held))
                steps = -(-max(1, round(LOCAL * 64 / len(x))) * len(x) // 64)  # whole passes
                local = Network(common.rank, common.group, common.inside, {k: v.copy() for k, v in common.weights.items()})
                local.fit(x, y, steps=steps, done=n * steps, total=ROUNDS * steps)
                for k, v in local.weights.items():
                    sums[k] += v.astype(np.float64) - common.weights[k]
                holding[np.unique(x)] += 1
                count += 1

            for batch in batches:
                values, at = unpacked(batch.column(2), code)
                for i, (c, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                    if c != cell:
                        if held:
                            close()
                        cell, held = c, []
                    elif key == last:
                        continue
                    last = key
                    held.append(consecutive(rank, common.group, values[at[i] : at[i + 1]]))
            if held:
                close()
            if count:
                flat = np.concatenate([holding, *(sums[k].ravel() for k in sorted(sums))])
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([count], pa.int32()), pa.array([flat.tobytes()], pa.binary())], names=["cell", "n", "change"])

        got = saved.where(F.col("part") == n % groups).select("cell", "key", "packed").mapInArrow(change, "cell int, n int, change binary").collect()  # one row a task
        shared.unpersist()
        if not got:
            continue
        seen += sum(r["n"] for r in got) if n < groups else 0
        total = sum(np.frombuffer(r["change"], np.float64) for r in sorted(got, key=lambda r: r["cell"]))
        holding, total = total[: len(net.weights["E"])], total[len(net.weights["E"]) :]
        for k in sorted(net.weights):
            v = net.weights[k]
            part, total = total[: v.size].reshape(v.shape), total[v.size :]
            net.weights[k] = (v + part / (np.maximum(holding, 1)[:, None] if k == "E" else sum(r["n"] for r in got))).astype(np.float32)
    dropped(saved)
    return seen


def consecutive(rank: np.ndarray, group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(embedding rows before, classes) of the pieces ids[1:] in windows one after another; -1 fills the last."""
    n = len(ids) - 1
    x, y = np.zeros(-(-n // WINDOW) * WINDOW, np.int32), np.full(-(-n // WINDOW) * WINDOW, -1, np.int8 if CLASSES < 128 else np.int32)
    x[:n], y[:n] = rank[ids[:-1]], group[ids[1:]]
    return x.reshape(-1, WINDOW), y.reshape(-1, WINDOW)


def train(found: DataFrame, pieces: np.ndarray) -> Network:
    """A network from what was ``gathered`` and the counts of ``pieces``: classes from all texts, attention from all pieces of distinct ones."""
    common = np.argsort(-pieces, kind="stable")[:EMBEDDED]
    common = common[pieces[common] > 0]
    rank = np.ones(len(pieces), np.int64)
    rank[common] = np.arange(len(common)) + 2
    group = class_of(*sketched(found, rank), pieces)
    counts = pieces + 0.5
    net = Network(rank, group, np.log(counts / np.bincount(group, counts, CLASSES)[group]))
    net.start(len(common) + 2, CLASSES)
    rows = found.where(F.col("kind") == DRAWN).select(F.col("id").alias("key"), "packed", lists_of("packed", len(pieces)).alias("ids"))
    n = rows.agg(F.sum(F.ceil((F.octet_length("packed") / code_of(len(pieces)).itemsize - 1) / WINDOW))).first()[0]
    if n:
        fit_on_cluster(net, rows, GROUPS * -(-n // (GROUPS * CELL)))
    return net


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The rows of (id, n) with the largest counts, at most ``most`` of them, cut at a step of log2(n) / 16.

    A histogram of a few hundred steps gives the cut, so no task has to gather candidates.
    """
    step = F.floor(F.log2("n") * 16)
    cut, total = None, 0
    for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect():
        total += r["rows"]
        if total > most:
            break
        cut = r["step"]
    return words.limit(0) if cut is None else words.where(step >= cut)


def score(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learned from the rows whose crc32(id) mod 5 is not 1. Words are lower-cased (A-Z); a text ends in
    one end token. A null text is empty: it has just the end. Equal and null ids stay as they are;
    with no training rows all counts are 0 and the classes have equal shares. Counts of the
    ``SHARED_WORDS`` most frequent words are sent to every task; the other words of a text are
    joined with their counts, so nothing that grows with the corpus is broadcast.
    """
    rest = remainder(id_col)
    base = docs.select(F.col(id_col).alias("id"), (rest == 1).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    learned = base.where(~F.col("held_out"))
    found = written(gathered_packed(learned, RUN, model_path))
    counts = written(found.where(F.col("kind") <= PIECE).groupBy("kind", "id").agg(F.sum("n").alias("n")))
    splitter = Splitter(model_path)
    pieces = np.zeros(splitter.vocabulary + 1, np.int64)
    for r in counts.where("kind = 1").collect():  # as many as the vocabulary
        pieces[r["id"]] = r["n"]
    words = counts.where("kind = 0").select("id", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = frequent(words, SHARED_WORDS).toArrow().sort_by("id")
    norm = np.log10(max(total + 0.5 * (distinct + 1), 0.5))
    end = words.where(F.col("id") == int(END.view(np.int64))).collect()
    end_count = end[0]["n"] if end else 0
    net = train(found, pieces)
    dropped(found)
    shared = docs.sparkSession.sparkContext.broadcast((net, top["id"].to_numpy(), np.log10(top["n"].to_numpy() + 0.5)))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = splitter_of(model_path)
        net, known, logs = shared.value
        for batch, low, high, data, starts, stops, distinct, inverse, bounds in _blocks(batches, 2):
            keys = distinct.view(np.int64)
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            have = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            gain = np.where(have, logs[at], 0.0) if len(known) else np.zeros(len(keys))
            mine, got = have[inverse], np.concatenate([[0.0], np.cumsum(gain[inverse])])
            seen = np.concatenate([[0], np.cumsum(mine)])
            rare = keys[inverse][~mine]
            edges = (np.arange(len(mine) + 1) - seen)[bounds]
            flat, begin, size = splitter.words(data, starts, stops, distinct)
            ids, rows = splitter.sequences(flat, begin[inverse], size[inverse], bounds)
            log_p = net.score(ids, rows) / np.log(10)
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(rare))
            longs = [pa.array(x.astype(np.int64)) for x in (np.diff(bounds) + 1, seen[bounds[1:]] - seen[bounds[:-1]])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(low, high - low) for k in (0, 1, 3)), *longs, pa.array(got[bounds[1:]] - got[bounds[:-1]]), lists, pa.array(log_p)], names=["id", "held_out", "row", "n_tokens", "n_shared", "log_shared", "rare", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rated = written(base.withColumn("row", F.monotonically_increasing_id()).mapInArrow(rate, f"id {kind}, held_out boolean, row long, n_tokens long, n_shared long, log_shared double, rare array<long>, score double"))
    rare = rated.select("row", F.explode("rare").alias("id")).join(words, "id").groupBy("row").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("n") + 0.5)).alias("log_rare"))
    full = rated.withColumn("unseen", F.size("rare")).drop("rare").join(rare, "row", "left").withColumns({"n_rare": F.coalesce("n_rare", F.lit(0)), "log_rare": F.coalesce("log_rare", F.lit(0.0))})
    half = float(np.log10(0.5))
    return full.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_shared") + F.col("n_rare") + F.lit(int(end_count > 0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("log_shared") + F.col("log_rare") + (F.col("unseen") - F.col("n_rare")) * half + float(np.log10(end_count + 0.5)) - F.col("n_tokens") * float(norm)).alias("base_score"), "score",
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every document by corpus word counts and by the attention model."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
