"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet in shared five-word seeds (the whole item where it is shorter). For
each pair that shares enough of them, the longest matches that overlap no earlier one are marked again
and again; the share of the item's words in these tiles is its coverage, whatever the order of its
passages in the document. Seeds are hashed in a run over the words, by sums of powers.

A small benchmark is sent to every task. A larger one is joined: a bit table of a fixed size rules out
nearly all words of the documents that are in no seed, the rest meet the items' seeds in a shuffle, and
only pairs that share enough of them are tiled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lagweave.llm._memory import modest_batches, only
from lagweave.llm._shared import dropped, salted_join, written
from lagweave.llm._words import PLAIN, find_words, inside_rows, row_blocks, utf8, window_hashes

SEED = 5
THRESHOLD = 0.6
#: Bytes of text that are worked at once.
WORKED = 1 << 18
#: Benchmark text up to this is broadcast, with indexes of some eight times its size.
BROADCAST_BYTES = 4 << 20
#: log2 of the bits of the table of seeds of a larger benchmark (16 MB).
TABLE_BITS = 27


def tiles(pairs: np.ndarray, n_doc: int, n_item: int, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiling from seed pairs (document position, item position): (document, item, length), seeds of ``least`` words.

    Seeds in step form maximal matches. The longest goes first (ties: first in the document, then
    in the item); words of either side are used once, and what is left of a match that overlaps a
    tile goes back in if it still has ``least`` words.
    """
    diagonal = pairs[:, 0] - pairs[:, 1]
    order = np.lexsort((pairs[:, 0], diagonal))
    d, p = diagonal[order], pairs[order, 0]
    new = np.ones(len(p), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(p))) + least - 1
    heap = [(-int(n), int(p[k]), int(p[k] - d[k])) for k, n in zip(first, length)]
    heapq.heapify(heap)
    doc_used, item_used = np.zeros(n_doc, bool), np.zeros(n_item, bool)
    out = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        taken = doc_used[a : a + n] | item_used[b : b + n]
        if not taken.any():
            doc_used[a : a + n] = True
            item_used[b : b + n] = True
            out.append((a, b, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if high - low >= least:
                heapq.heappush(heap, (low - high, a + low, b + low))
    return out


def seeds_of(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of all ``width``-word windows that lie in one row."""
    seeds = window_hashes(words, width)
    at = np.flatnonzero(inside_rows(bounds, width, len(seeds)))
    return seeds[at] ^ np.uint64(width), at


def item_seeds(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, item, place in it) of the seeds of items; one of under ``SEED`` words is a seed as a whole."""
    sizes = np.diff(bounds)
    out = []
    for width in range(1, SEED + 1):
        seeds, at = seeds_of(words, bounds, width)
        item = np.searchsorted(bounds, at, side="right") - 1
        mine = sizes[item] == width if width < SEED else sizes[item] >= SEED
        out.append((seeds[mine], item[mine], (at - bounds[item])[mine]))
    return tuple(np.concatenate(x) for x in zip(*out))


def covered(size: int, where: np.ndarray, places: np.ndarray, n_words: int, threshold: float) -> tuple[float, int] | None:
    """(coverage, tiles) of an item of ``size`` words with seeds at ``places``, found in a text at ``where``; None below the threshold."""
    width = min(size, SEED)
    reach = np.zeros(size + 1, np.int64)
    spots = np.unique(places)
    np.add.at(reach, spots, 1)
    np.add.at(reach, spots + width, -1)
    if (np.cumsum(reach)[:size] > 0).sum() < threshold * size:
        return None
    found = tiles(np.stack([where, places], 1), n_words, size, width)
    total = sum(n for *_, n in found)
    return (total / size, len(found)) if total >= threshold * size else None


@dataclass
class Index:
    """Seeds of benchmark items: sorted hashes, with the item and place of each, and a first test."""

    ids: list
    sizes: np.ndarray
    widths: list[int]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    shift: np.uint64

    @classmethod
    def of(cls, rows: list[tuple]) -> Index:
        data, offsets = utf8(pa.array([r[1] for r in rows], pa.large_string()))
        _, _, words, bounds = find_words(data, offsets, PLAIN)
        seeds, item, place = item_seeds(words, bounds)
        order = np.argsort(seeds, kind="stable")
        bits = max(12, int(len(seeds) * 8).bit_length())  # 8 to 16 entries a seed
        marks = np.zeros(1 << bits, bool)
        marks[(seeds >> np.uint64(64 - bits)).astype(np.int64)] = True
        sizes = np.diff(bounds)
        return cls([r[0] for r in rows], sizes, np.unique(np.minimum(sizes[sizes > 0], SEED)).tolist(), seeds[order], item[order], place[order], marks, np.uint64(64 - bits))

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, places) of the seeds in the rows that the index has."""
        out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for width in self.widths:
            seeds = window_hashes(words, width) ^ np.uint64(width)
            at = np.flatnonzero(self.filter[(seeds >> self.shift).astype(np.int64)])
            near = np.minimum(np.searchsorted(self.seeds, seeds[at]), len(self.seeds) - 1)
            at = at[self.seeds[near] == seeds[at]]
            at = at[inside_rows(bounds, width, len(seeds))[at]]
            out.append((seeds[at], at))
        return tuple(np.concatenate(x) for x in zip(*out))

    def match(self, seeds: np.ndarray, at: np.ndarray, n_words: int, threshold: float) -> list[dict]:
        """Items covered by a document with the hit seeds ``seeds`` at the places ``at``."""
        low, high = np.searchsorted(self.seeds, seeds, "left"), np.searchsorted(self.seeds, seeds, "right")
        times = high - low
        entry = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        order = np.argsort(self.item[entry], kind="stable")
        where, items, places = np.repeat(at, times)[order], self.item[entry][order], self.place[entry][order]
        first = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
        out = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(items)]):
            k = int(items[a])
            if (got := covered(int(self.sizes[k]), where[a:b], places[a:b], n_words, threshold)) is not None:
                out.append({"item_id": self.ids[k], "coverage": got[0], "n_tiles": got[1], "item_words": int(self.sizes[k])})
        return out


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    only("tiles")
    for batch in batches:
        data, offsets = utf8(batch.column(text_at))
        for low, high in row_blocks(offsets, WORKED):
            _, _, words, bounds = find_words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], PLAIN)
            yield batch, low, high, words, bounds


def by_broadcast(docs: DataFrame, items: DataFrame, kind: str, text_col: str, threshold: float) -> DataFrame:
    """``docs`` with ``benchmark_matches`` filled in, for a benchmark (item_id, text) of a checked size."""
    match_type = pa.list_(pa.struct([("item_id", to_arrow_type(items.schema["item_id"].dataType)), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("item_words", pa.int32())]))
    text_at, last = docs.columns.index(text_col), docs.columns.index("benchmark_matches")
    shared = docs.sparkSession.sparkContext.broadcast(Index.of([(r[0], r[1]) for r in items.collect()]))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for _, low, high, words, bounds in _blocks(iter([batch]), text_at):
                if not len(index.seeds):
                    continue
                seeds, at = index.hits(words, bounds)
                row = np.searchsorted(bounds, at, side="right") - 1
                order = np.argsort(row, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], row[order][1:] != row[order][:-1]])) if len(row) else []
                for mine in np.split(order, first[1:]) if len(row) else []:
                    r = int(row[mine[0]])
                    found[low + r] = index.match(seeds[mine], at[mine] - bounds[r], int(bounds[r + 1] - bounds[r]), threshold)
            columns = [pa.array(found, match_type) if k == last else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(match, docs.schema)


def by_join(docs: DataFrame, items: DataFrame, text_col: str, threshold: float) -> DataFrame:
    """(text_key, matches): the matches of the distinct texts of ``docs``, for a benchmark (item_id, text) of any size."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()

    def parse_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, low, high, words, bounds in _blocks(batches, 1):
            seeds, item, place = item_seeds(words, bounds)
            size = np.diff(bounds)
            rows = batch.column(0).slice(low, high - low)
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(item)), pa.array(seeds.view(np.int64)), pa.array(place), pa.array(size[item])], names=["copy", "seed", "place", "item_words"])

    named = written(items.withColumn("copy", F.monotonically_increasing_id()))
    seeds = written(named.select("copy", "text").mapInArrow(parse_items, "copy long, seed long, place long, item_words long"))
    widths = sorted(r[0] for r in seeds.select(F.least("item_words", F.lit(SEED)).alias("w")).distinct().collect())  # at most SEED
    position = F.shiftrightunsigned("seed", 64 - TABLE_BITS)
    words_of_bits = seeds.groupBy(F.shiftright(position, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - TABLE_BITS}) & 63 as int))")).alias("bits")).toArrow()  # at most 2 ** (TABLE_BITS - 6) rows
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    table[words_of_bits.column(0).to_numpy()] = words_of_bits.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(table.view(np.uint64))

    def parse_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch, low, high, words, bounds in _blocks(batches, 1):
            rows = batch.column(0).slice(low, high - low)
            for width in widths:
                found, at = seeds_of(words, bounds, width)
                place = found >> np.uint64(64 - TABLE_BITS)
                keep = np.flatnonzero((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))
                row = np.searchsorted(bounds, at[keep], side="right") - 1
                if len(keep):
                    yield pa.RecordBatch.from_arrays([rows.take(pa.array(row)), pa.array(found[keep].view(np.int64)), pa.array(at[keep] - bounds[row]), pa.array((bounds[row + 1] - bounds[row]).astype(np.int64))], names=["text_key", "seed", "at", "n_words"])

    texts = docs.where(F.col(text_col).isNotNull()).select(F.sha2(text_col, 256).alias("text_key"), F.col(text_col).alias("text")).dropDuplicates(["text_key"])
    asked = texts.mapInArrow(parse_docs, "text_key string, seed long, at long, n_words long")

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        size = int(rows["item_words"].iloc[0])
        got = covered(size, rows["at"].to_numpy(), rows["place"].to_numpy(), int(rows["n_words"].iloc[0]), threshold)
        return pd.DataFrame([] if got is None else [(rows["text_key"].iloc[0], rows["copy"].iloc[0], got[0], got[1], size)], columns=["text_key", "copy", "coverage", "n_tiles", "item_words"])

    asked = written(asked)
    met = written(salted_join(asked, seeds, "seed", "text_key").select("text_key", "copy", "at", "place", "n_words", "item_words"))
    enough = met.groupBy("text_key", "copy").agg(F.count_distinct("place").alias("n"), F.first("item_words").alias("size")).where(F.col("n") * F.least("size", F.lit(SEED)) >= threshold * F.col("size"))
    found = met.join(enough.select("text_key", "copy"), ["text_key", "copy"], "left_semi").groupBy("text_key", "copy").applyInPandas(tile, "text_key string, copy long, coverage double, n_tiles int, item_words int")
    match = F.struct("item_id", "coverage", "n_tiles", "item_words")
    out = written(found.join(named.select("copy", "item_id"), "copy").groupBy("text_key").agg(F.sort_array(F.collect_list(match)).alias("matches")).select("text_key", F.col("matches").cast(f"array<struct<item_id:{kind},coverage:double,n_tiles:int,item_words:int>>").alias("matches")))
    dropped(asked, seeds, met)
    return out


def tile_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a column ``benchmark_matches``: the items of which it covers ``threshold``.

    Words are compared without case and ASCII punctuation. Every row stays, with all its columns
    (an earlier ``benchmark_matches`` is replaced). An item of fewer than five words is matched where it
    stands whole; null and empty texts match nothing; equal items are each reported. A benchmark of up to
    ``BROADCAST_BYTES`` is broadcast and documents are not shuffled; a larger one meets them in joins.
    """
    modest_batches(docs.sparkSession)
    items = benchmark.where(F.col("text").isNotNull()).select(F.col(item_col).alias("item_id"), "text")
    kind = items.schema["item_id"].dataType.simpleString()
    none = F.expr(f"cast(array() as array<struct<item_id:{kind},coverage:double,n_tiles:int,item_words:int>>)")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return by_broadcast(docs.withColumn("benchmark_matches", none), items, kind, text_col, threshold)
    matches = by_join(docs, items, text_col, threshold)
    key = F.sha2(docs[text_col], 256)
    kept = [c for c in docs.columns if c != "benchmark_matches"]
    return docs.join(matches, key == matches["text_key"], "left").select(*[docs[c] for c in kept], F.coalesce("matches", none).alias("benchmark_matches"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains, whole or reordered."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = tile_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("benchmark_matches").alias("m")).select("doc_id", "m.item_id", "m.coverage", "m.n_tiles", "m.item_words")
