"""SentencePiece encoding and decoding with a max-plus scan.

A text is cut into vocabulary pieces so that the sum of their scores is largest (Viterbi). A
giant document is split into chunks: each gives a max-plus matrix from the boundary state it is
entered with (how many of its first characters a piece begun earlier covers) to the one it leaves.
The matrices are combined associatively in a tree over runs of chunks, which fixes the states at every
boundary, and each chunk is then traced back on its own, on any executor.

The vocabulary file is a parameter and is only read. Pieces are scored by Zipf's law of their rank. To
each score belongs a far smaller number of the piece and its place in its word, so that the best cut is
one and the same however the text is chunked. Spaces become the mark U+2581, one is put in front, and
characters outside the vocabulary are spelled in byte pieces, so decoding gives back the exact text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm._memory import given_back, modest_batches, only, remembers
from lagweave.llm._shared import salted_join, written

GIANT, CHUNK = 32_768, 8_192
#: Chunks beyond this could overflow 64 bits.
MAX_CHUNK = 16_384
#: Matrices that one step of the tree combines.
FAN = 64
MARK = "\u2581"
#: Stands for a U+2581 of the text, and is spelled in the bytes of that; no text has a lone surrogate.
STAND_IN = "\udc00"
#: No piece crosses from a word into the mark of the next, so these are cut independently.
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNREACHABLE = -(1 << 61)
#: Segments that a generation remembers, and characters that are cut at once; they bound a worker's memory.
_KEPT = 75_000
_TOGETHER = 700_000
#: A score is so many times the unit of what settles ties.
_UNIT = 1 << 30
_PLACES = [int(x) for x in np.random.default_rng(17).integers(0, _UNIT, 1024)]


def default_model() -> str:
    """Where the installed public tokenizers keep the 32k vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces with integer scores (thousandths of the log of rank + 2, and a tie-breaker), and byte pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, tuple[int, int]] = {}
        self.bytes_at = [0] * 256
        self.spelled: list[bytes] = []
        rank = 0
        for k in range(file.get_piece_size()):
            piece = file.id_to_piece(k)
            if file.is_byte(k):
                self.bytes_at[int(piece[1:-1], 16)] = k
                self.spelled.append(bytes([int(piece[1:-1], 16)]))
            elif file.is_control(k) or file.is_unknown(k):
                self.spelled.append(b"")
            else:
                if re.search(f"[^{MARK}]{MARK}", piece):
                    raise ValueError(f"piece {piece!r} crosses from a word into the next")
                self.score[piece] = (-round(1000 * float(np.log(rank + 2))), k)
                self.spelled.append(piece.replace(MARK, " ").encode())
                rank += 1
        self.byte_cost = -round(1000 * float(np.log(rank + 2))) - 5000
        self.own = [int(x) for x in np.random.default_rng(23).integers(0, _UNIT, len(self.spelled) + 1)]  # the last is for spelled bytes
        self.tree = self._tree()
        self._table()
        self.spelled_size = np.array([len(x) for x in self.spelled], np.int64)
        self.longest = max(map(len, self.score))
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.values: dict[str, int] = {}
        self.misspelled: set[str] = set()

    def _tree(self) -> dict:
        """Pieces by their characters: each maps to (what may follow, scaled score or 0, id, own number)."""
        nodes: dict[str, list] = {"": [{}, 0, 0, 0]}
        for piece, (score, k) in self.score.items():
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    nodes[piece[:n]] = [{}, 0, 0, 0]
            nodes[piece][1:] = [score * _UNIT, k, self.own[k]]
        for name in sorted(nodes, key=len, reverse=True):
            if name:
                nodes[name[:-1]][0][name[-1]] = tuple(nodes[name])
        return nodes[""][0]

    def _table(self) -> None:
        """The tree in arrays: the child of a node by a character is where ``first`` of the node and the character's number add up to, if its ``parent`` is the node."""
        nodes, edges, found = [self.tree], [], [[0, 0, 0]]  # the first is the root
        for number, children in enumerate(nodes):
            for char, (below, *what) in children.items():
                edges.append((number, char))
                nodes.append(below)
                found.append(what)
        chars = sorted({c for _, c in edges})
        of = {c: n for n, c in enumerate(chars, 1)}
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        child = np.array([of[c] for _, c in edges])
        begin = np.searchsorted([a for a, _ in edges], np.arange(len(nodes) + 1))
        count = np.diff(begin)
        size = 4 * len(nodes) + 2 * len(chars)
        first, place, free = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), np.ones(size, bool)
        free[: len(chars) + 1] = False
        r = np.random.default_rng(29)
        for n in np.argsort(-count, kind="stable")[: int((count > 1).sum())].tolist():
            own = child[begin[n] : begin[n + 1]]
            for _ in range(50):
                tried = r.integers(1, size - len(chars), 16)
                if (fits := free[tried[:, None] + own].all(1)).any():
                    first[n] = tried[np.argmax(fits)]
                    break
            else:  # too crowded for so many children
                first[n], free = len(free), np.concatenate([free, np.ones(len(chars) + 1, bool)])
            place[begin[n] + 1 : begin[n + 1] + 1] = first[n] + own
            free[first[n] + own] = False
        single = np.flatnonzero(count == 1)
        at = np.flatnonzero(free)[: len(single)]
        first[single], place[begin[single] + 1] = at - child[begin[single]], at
        size = len(free)
        self.first, self.parent = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.first[place], self.parent[place[1:]] = first, place[[a for a, _ in edges]]
        self.worth, self.piece, self.tie = np.zeros(size, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int64)
        self.worth[place], self.piece[place], self.tie[place] = np.array(found, np.int64).T

    def pieces_at(self, s: str, i: int, place: int) -> list[tuple[int, int, int]]:
        """(end, value, id) of the pieces that start at ``i``, ``place`` in their word; a byte spelling has the id -1."""
        out, at, tie = [], self.tree, _PLACES[place & 1023]
        for end in range(i + 1, len(s) + 1):
            if (hit := at.get(s[end - 1])) is None:
                break
            at = hit[0]
            if hit[1]:
                out.append((end, hit[1] + (tie ^ hit[3]), hit[2]))
        if not out or out[0][0] != i + 1:
            out.insert(0, (i + 1, self.byte_cost * len(_raw(s[i])) * _UNIT + (tie ^ self.own[-1]), -1))
        return out

    def best(self, s: str, start: int = 0, end: int | None = None, shift: int = 0) -> tuple[int, list[int]]:
        """The best value and pieces of s[start:end]; s[0] has the place ``shift`` in its word."""
        end = len(s) if end is None else end
        total, back = [UNREACHABLE] * (end + 1), [(0, 0)] * (end + 1)
        total[start] = 0
        chars, longest = s[start:end], self.longest
        for i in range(start, end):
            base = total[i]
            if base == UNREACHABLE:
                continue
            single, at, to, tie = False, self.tree, i, _PLACES[(i + shift) & 1023]
            for c in chars[i - start : i - start + longest]:
                if (hit := at.get(c)) is None:
                    break
                at, score, k, own = hit
                to += 1
                if score:
                    if to == i + 1:
                        single = True
                    if (value := base + score + (tie ^ own)) > total[to]:
                        total[to], back[to] = value, (i, k)
            if not single and (value := base + self.byte_cost * len(_raw(s[i])) * _UNIT + (tie ^ self.own[-1])) > total[i + 1]:
                total[i + 1], back[i + 1] = value, (i, -1)
        ids: list[int] = []
        at = end
        while at > start:
            i, k = back[at]
            ids.extend([k] if k >= 0 else [self.bytes_at[b] for b in reversed(_raw(s[i]))])
            at = i
        return total[end], ids[::-1]

    def cut(self, segment: str) -> bytes:
        """Best ids of one segment, remembered in two generations of a bounded size."""
        if (got := self.kept.get(segment)) is None:
            if (got := self.older.get(segment)) is None:
                got = self._keep(segment, self.best(segment)[1])
            elif len(segment) < 64:
                self._recall(segment, got)
        return got

    def best_of_sorted(self, segments: list[str]) -> list[list[int]]:
        """The pieces of ``best`` of whole segments, in any order."""
        ids, edges, _ = self.side_by_side(segments)
        return [ids[a:b].tolist() for a, b in zip(edges.tolist(), edges[1:].tolist())]

    def side_by_side(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, bounds, values): ``best`` of whole segments, a place of all of them at a time.

        Segments lie by falling length, so that those that reach a place are the first ones.
        """
        codes, edges = _codes(segments)
        size = np.diff(edges)
        order = np.argsort(-size, kind="stable")
        start, size = edges[:-1][order], size[order]
        longest = int(size.max(initial=0))
        reach = np.searchsorted(-size, -np.arange(longest + 1), side="right")  # how many have so many characters
        low = np.concatenate([[0], np.cumsum(reach)])
        total, came, used = np.full(low[-1], UNREACHABLE), np.zeros(low[-1], np.int32), np.zeros(low[-1], np.int32)
        total[: reach[0]] = 0
        numbers = self.number[codes]
        chars = [numbers[start[:n] + i] for i, n in enumerate(reach[1:])]
        root, spelled = np.int32(0), self.byte_cost * _raw_size(codes) * _UNIT
        for i, here in enumerate(chars):
            tie, base = _PLACES[i & 1023], total[low[i] : low[i] + len(here)]
            at, node, end = np.arange(len(here)), np.full(len(here), root), i
            single = None
            while len(at):
                to = self.first[node] + chars[end][at]
                known = np.flatnonzero(self.parent[to] == node)
                at, node, end = at[known], to[known], end + 1
                worth = self.worth[node]
                hit = np.flatnonzero(worth)
                self._better(total, came, used, low[end] + at[hit], base[at[hit]] + worth[hit] + (self.tie[node[hit]] ^ tie), i, self.piece[node[hit]])
                if single is None:
                    single = np.ones(len(here), bool)
                    single[at[hit]] = False
                    none = np.flatnonzero(single)
                if end == len(chars):
                    break
                inside = np.searchsorted(at, reach[end + 1])  # those that have a next character
                at, node = at[:inside], node[:inside]
            self._better(total, came, used, low[i + 1] + none, base[none] + spelled[start[none] + i] + (self.own[-1] ^ tie), i, -1)
        marks, row, place = np.zeros(len(codes), np.int32), np.arange(len(size)), size
        values = np.empty(len(size), np.int64)
        values[order] = total[low[size] + row]
        while len(row):
            cell = low[place] + row
            marks[start[row] + place - 1] = used[cell] + 2  # at the last character of the piece
            place = came[cell]
            row, place = row[place > 0], place[place > 0]
        last = np.flatnonzero(marks)
        ids = marks[last] - 2
        bounds = np.searchsorted(last, edges)
        if len(odd := np.flatnonzero(ids < 0)):
            many, kind = np.ones(len(ids), np.int64), codes[last[odd]]
            many[odd] = _raw_size(kind)
            to = np.concatenate([[0], np.cumsum(many)])
            ids = np.repeat(ids, many)
            for code in np.unique(kind).tolist():
                for n, byte in enumerate(_raw(chr(code))):
                    ids[to[odd[kind == code]] + n] = self.bytes_at[byte]
            bounds = to[bounds]
        return ids, bounds, values

    @staticmethod
    def _better(total: np.ndarray, came: np.ndarray, used: np.ndarray, cell: np.ndarray, value: np.ndarray, i: int, piece) -> None:
        won = np.flatnonzero(value > total[cell])
        cell = cell[won]
        total[cell], came[cell], used[cell] = value[won], i, piece if isinstance(piece, int) else piece[won]

    def learn(self, segments: set[str]) -> None:
        """Remembers the pieces of short segments, and cuts those that are new side by side."""
        if len(self.kept) > _KEPT:
            self.older, self.kept = self.kept, {}
        new = []
        for s in segments - self.kept.keys():
            if (got := self.older.get(s)) is not None:
                self.kept[s] = got
            elif len(s) < 64:
                new.append(s)
        ids, bounds, values = self.side_by_side(new)
        codes, edges = _codes(new)
        size = np.diff(np.concatenate([[0], np.cumsum(self.spelled_size[ids])])[bounds])
        plain_size = np.diff(np.concatenate([[0], np.cumsum(np.where(codes == ord(MARK), 1, _raw_size(codes)))])[edges])
        if (size != plain_size).any() or b"".join(map(self.spelled.__getitem__, ids.tolist())) != plain("".join(new)):
            self.misspelled.update(s for s, a, b in zip(new, bounds, bounds[1:]) if b"".join(map(self.spelled.__getitem__, ids[a:b].tolist())) != plain(s))
        raw, bounds = ids.astype(np.int32).tobytes(), (4 * bounds).tolist()
        self.kept.update(zip(new, [raw[a:b] for a, b in zip(bounds, bounds[1:])]))

    def learn_values(self, segments: set[str]) -> None:
        """As ``learn``, for ``value``."""
        if len(self.values) > _KEPT:
            self.values.clear()
        new = [s for s in segments - self.values.keys() if len(s) < 64]
        self.values.update(zip(new, self.side_by_side(new)[2].tolist()))

    def _keep(self, segment: str, ids: list[int]) -> bytes:
        got = np.array(ids, np.int32).tobytes()
        if b"".join(map(self.spelled.__getitem__, ids)) != plain(segment):
            self.misspelled.add(segment)
        if len(segment) < 64:
            self._recall(segment, got)
        return got

    def _recall(self, segment: str, got: bytes) -> None:
        if len(self.kept) > _KEPT:
            self.older, self.kept = self.kept, {}
        self.kept[segment] = got

    def encode_all(self, texts: list[str | None]) -> list[tuple[bytes | None, bool]]:
        """``encode`` of each text (a null one: None, True); new short segments of ``_TOGETHER`` characters are cut side by side."""
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size > _TOGETHER:
                out.extend(self._together(held))
                held, size = [], 0
        return out + self._together(held)

    def _together(self, texts: list[str | None]) -> list[tuple[bytes | None, bool]]:
        found = [SEGMENT.findall(marked(t)) if t else [] for t in texts]
        self.learn(set().union(*found))
        return [(None, True) if t is None else self._joined(segments) for t, segments in zip(texts, found)]

    def _joined(self, segments: list[str]) -> tuple[bytes, bool]:
        got = list(map(self.kept.get, segments))
        if None in got:
            got = [self.cut(s) if g is None else g for s, g in zip(segments, got)]
        return b"".join(got), not (self.misspelled and any(s in self.misspelled for s in segments))

    def forget(self) -> None:
        """Drops what is remembered of segments."""
        for held in (self.kept, self.older, self.values):
            held.clear()

    def value(self, segment: str) -> int:
        """Best value of one segment, remembered in a bounded number."""
        if (got := self.values.get(segment)) is None:
            got = self.best(segment)[0]
            if len(segment) < 64:
                if len(self.values) > _KEPT:
                    self.values.clear()
                self.values[segment] = got
        return got

    def encode(self, text: str) -> tuple[bytes, bool]:
        """Piece ids of the whole text as 32-bit integers, and whether they spell it."""
        return self._joined(SEGMENT.findall(marked(text))) if text else (b"", True)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.spelled.__getitem__, ids.tolist()))[1:].decode(errors="replace")

    # chunks: ``length`` characters of the marked text, with what follows up to the longest piece;
    # ``place``: how far into its word the first one is

    def matrix(self, s: str, length: int, place: int) -> np.ndarray:
        """Best value from entering ``s`` with i characters covered to leaving it with j over the end.

        Segments between the first and the last start are cut alone, so only the ends are scanned.
        """
        m = self.longest
        starts = segment_starts(s[:length], place == 0)
        if not starts:
            return self._scan(s, 0, length, range(m), place)
        out = np.full((m, m), UNREACHABLE, np.int64)
        head = np.full(m, UNREACHABLE, np.int64)
        for i in range(min(m - 1, starts[0]) + 1):
            head[i] = self.best(s, i, starts[0], place)[0]
        middle = sum(self.value(s[a:b]) for a, b in zip(starts, starts[1:]))
        tail = self._scan(s, starts[-1], length, [0], -starts[-1])[0]
        ok = (head[:, None] > UNREACHABLE) & (tail[None, :] > UNREACHABLE)
        out[ok] = (np.where(ok, head[:, None], 0) + middle + np.where(ok, tail[None, :], 0))[ok]
        return out

    def _scan(self, s: str, start: int, length: int, entries, shift: int) -> np.ndarray:
        m = self.longest
        total = np.full((len(s) + m + 1, len(entries)), UNREACHABLE, np.int64)
        for k, i in enumerate(entries):
            if start + i <= len(s):
                total[start + i, k] = 0
        reach = np.full((len(entries), m), UNREACHABLE, np.int64)
        for i in range(start, length):
            known = total[i] > UNREACHABLE
            if not known.any():
                continue
            for to, value, _ in self.pieces_at(s, i, i + shift):
                np.maximum(total[to], np.where(known, total[i] + value, UNREACHABLE), out=total[to])
        for j in range(m):
            reach[:, j] = total[length + j]
        return reach

    def trace(self, s: str, length: int, place: int, enter: int, leave: int) -> bytes:
        """Ids of the pieces that start in the chunk, for its two boundary states."""
        starts = segment_starts(s[:length], place == 0)
        if not starts or enter > starts[0]:
            return np.array(self.best(s, enter, length + leave, place)[1], np.int32).tobytes()
        parts = [np.array(self.best(s, enter, starts[0], place)[1], np.int32).tobytes()] if starts[0] > enter else []
        parts += [self.cut(s[a:b]) for a, b in zip(starts, starts[1:])]
        parts.append(np.array(self.best(s, starts[-1], length + leave, -starts[-1])[1], np.int32).tobytes())
        return b"".join(parts)


def _raw(char: str) -> bytes:
    return (MARK if char == STAND_IN else char).encode()


def _raw_size(codes: np.ndarray) -> np.ndarray:
    """Bytes of ``_raw`` by code point; a stand-in has the 3 of a mark."""
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


def _codes(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points one after another, bounds)."""
    codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return codes, np.concatenate([[0], np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))])


def plain(segment: str) -> bytes:
    """The bytes that the pieces of a segment should spell."""
    return segment.replace(MARK, " ").replace(STAND_IN, MARK).encode()


def marked(text: str, first: bool = True) -> str:
    """With marks for spaces and one in front of a ``first`` part; a mark of the text gets a stand-in, spelled in its bytes."""
    return (MARK if first else "") + text.replace(MARK, STAND_IN).replace(" ", MARK)


def segment_starts(s: str, begins: bool) -> list[int]:
    out = [m.start() + 1 for m in re.finditer(f"[^{MARK}](?={MARK})", s)]
    return [0, *out] if begins and s else out


def inside(s: str, length: int, place: int) -> list[str]:
    """The whole segments of a chunk, which are cut alone."""
    starts = segment_starts(s[:length], place == 0)
    return [s[a:b] for a, b in zip(starts, starts[1:])]


@cache
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in a worker; other operators' caches there are dropped."""
    only("pieces")
    v = _vocabulary(path)
    remembers("pieces", v.forget)
    return v


# max-plus combination; values are taken relative to the best of a vector or matrix, so they stay small


def settled(x: np.ndarray) -> np.ndarray:
    """``x`` less its largest value; unreachable ones stay so."""
    return np.where(x > UNREACHABLE, x - x.max(), UNREACHABLE)


def through(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of a vector or matrix and a matrix or vector."""
    right = b if b.ndim > 1 else b[:, None]
    out = plus(a[..., :, None], right[(None,) * (a.ndim - 1)]).max(-2)
    return settled(out if b.ndim > 1 else out[..., 0])


def around(matrices: list[np.ndarray], ahead: np.ndarray, behind: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(before each, after each): best values up to the start and from the end of each of a run of matrices."""
    before, after = [ahead], [behind]
    for m in matrices:
        before.append(through(before[-1], m))
    for m in reversed(matrices):
        after.append(through(m, after[-1]))
    return before[:-1], after[::-1][1:]


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Element by element; what either doesn't reach the sum doesn't."""
    both = (a > UNREACHABLE) & (b > UNREACHABLE)
    return np.where(both, np.where(both, a, 0) + np.where(both, b, 0), UNREACHABLE)


def states(matrix: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[int, int]:
    """(entered, left) of a chunk on the best way through the whole text."""
    return int(np.argmax(plus(before, through(matrix, after)))), int(np.argmax(plus(through(before, matrix), after)))


def _lists(values: list[bytes | None]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v or b"") // 4 for v in values], out=offsets[1:])
    flat = pa.array(np.frombuffer(b"".join(v or b"" for v in values), np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([v is None for v in values]))


def _portions(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many chunks as ``_TOGETHER`` allows."""
    rows = max(1, _TOGETHER // chunk)
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(id, pieces array<int>, n_pieces, exact) for every row of ``docs``.

    ``exact``: the bytes of the pieces, in order, are the text's. Texts of over ``giant`` characters are
    split into chunks of ``chunk`` and shared out; equal ones are encoded once, and no result depends on
    the two. A null text has null pieces, 0 of them, and counts as exact; an empty one has none. Equal
    and null ids stay as they are, other columns are ignored, an empty table gives an empty result.
    """
    modest_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                texts = part.column(1).to_pylist()
                got = v.encode_all(texts)
                exact = [ok for _, ok in got]
                lists = _lists([ids for ids, _ in got])
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int64()), pa.array(exact)], names=["id", "pieces", "n_pieces", "exact"])
        given_back()

    schema = f"id {kind}, pieces array<int>, n_pieces long, exact boolean"
    is_giant = F.coalesce(F.length("text") > giant, F.lit(False))
    few = base.where(~is_giant).mapInArrow(small, schema)

    named = base.where(is_giant).withColumn("key", F.sha2("text", 256))
    large = encode_giant(named.groupBy("key").agg(F.first("text").alias("text")), model_path, chunk)
    back = salted_join(named.select("id", "key"), large, "key", "id").select("id", "pieces", F.size("pieces").cast("long").alias("n_pieces"), (F.col("hash") == F.col("key")).alias("exact"))
    return few.union(back).withColumnRenamed("id", id_col)


def encode_giant(texts: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """(key, pieces, hash) of (key, text), whose keys differ; hash is the SHA-256 of what the pieces spell.

    Matrices go up a tree, ``FAN`` of a text at a step, and the best values before and after each go
    down it again, so that no step holds more than ``FAN`` of them.
    """
    chunk = min(chunk, MAX_CHUNK)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = vocabulary(model_path).longest
        for batch in batches:
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = " " + cell.as_py()  # the first space is the mark in front
                word = 0  # where the word of a chunk's first character starts
                for low in range(0, len(text), 64 * chunk):
                    at = range(low, min(len(text), low + 64 * chunk), chunk)
                    places = []
                    for a in at:
                        for hit in re.finditer("(?<! ) ", text[max(0, a - chunk) : a + 1]):
                            start = max(0, a - chunk) + hit.start()
                            if start == max(0, a - chunk) and start > 0 and text[start - 1] == " ":
                                continue
                            word = start
                        places.append(a - word)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(at)), pa.array([a // chunk for a in at], pa.int64()), pa.array([text[a : a + chunk + m - 1] for a in at], pa.string()), pa.array([min(chunk, len(text) - a) for a in at], pa.int32()), pa.array(places, pa.int64())],
                        names=["key", "no", "s", "length", "place"],
                    )

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for part in _portions(batches, chunk):
            rows = [(marked(s, False), n, p) for s, n, p in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)))]
            v.learn_values(set().union(*(inside(*row) for row in rows)))
            got = [settled(v.matrix(*row)).tobytes() for row in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.binary())], names=["key", "no", "matrix"])
        given_back()

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        found = _squares(rows.sort_values("no")["matrix"])
        whole = found[0]
        for m in found[1:]:
            whole = through(whole, m)
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "no": [rows["no"].iloc[0] // FAN], "matrix": [whole.tobytes()]})

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("no")
        found = _squares(rows["matrix"])
        edge = np.where(np.arange(len(found[0])) == 0, 0, UNREACHABLE)
        given = [edge if x is None else np.frombuffer(x, np.int64) for x in (rows["before"].iloc[0], rows["after"].iloc[0])]
        before, after = around(found, *given)
        both = [states(*x) for x in zip(found, before, after)]
        return pd.DataFrame({"key": rows["key"].to_numpy(), "no": rows["no"].to_numpy(), "before": [x.tobytes() for x in before], "after": [x.tobytes() for x in after], "enter": [e for e, _ in both], "leave": [o for _, o in both]})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for part in _portions(batches, chunk):
            rows = [(marked(s, False), *more) for s, *more in zip(*(part.column(k).to_pylist() for k in range(2, 7)))]
            v.learn(set().union(*(inside(*row[:3]) for row in rows)))
            ids = [v.trace(*row) for row in rows]
            words = [b"".join(map(v.spelled.__getitem__, np.frombuffer(i, np.int32).tolist())) for i in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(ids), pa.array(words, pa.binary())], names=["key", "no", "ids", "raw"])
        given_back()

    kept = written(texts)
    chunks = kept.mapInArrow(split, "key string, no long, s string, length int, place long").repartition("key", "no")
    levels = [written(chunks.mapInArrow(transfer, "key string, no long, matrix binary"))]
    most = kept.agg(F.max(F.length("text"))).first()[0] or 0
    n = most // chunk + 1
    run = F.floor(F.col("no") / FAN)
    while n > FAN:
        levels.append(written(levels[-1].groupBy("key", run.alias("run")).applyInPandas(product, "key string, no long, matrix binary")))
        n = -(-n // FAN)
    known = levels[-1].select(F.col("key"), F.floor(F.col("no") / FAN).alias("up")).distinct().select("key", "up", F.lit(None).cast("binary").alias("before"), F.lit(None).cast("binary").alias("after"))
    for level in reversed(levels):
        placed = level.withColumn("up", run).join(known, ["key", "up"])
        known = written(placed.groupBy("key", "up").applyInPandas(spread, "key string, no long, before binary, after binary, enter int, leave int"))
        found, known = known, known.select("key", F.col("no").alias("up"), "before", "after")
    traced = chunks.join(found.select("key", "no", "enter", "leave"), ["key", "no"]).select("key", "no", "s", "length", "place", "enter", "leave").mapInArrow(trace, "key string, no long, ids array<int>, raw binary")
    whole = traced.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("no", "ids", "raw"))).alias("parts"))  # the parts of one text
    raw = F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["raw"]))
    return whole.select("key", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("pieces"), F.sha2(F.substring(raw, 2, 2147483647), 256).alias("hash"))


def _squares(matrices) -> list[np.ndarray]:
    flat = [np.frombuffer(x, np.int64) for x in matrices]
    side = int(len(flat[0]) ** 0.5)
    return [f.reshape(side, side) for f in flat]


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """(id, text) of rows with piece ids; null pieces give a null text, none an empty one."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for batch in batches:
            texts = [None if x is None else v.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, pieces_col).mapInArrow(spell, f"`{id_col}` {kind}, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with whether they spell its text.

    Pieces are scored by their rank in the vocabulary, so ids are not those of the file's own merges.
    """
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
