"""Ranked lexical search over bit-sliced Bloom signatures, exact in its result.

Documents lie in blocks of similar size. A block's signature table has a row of bits for each place of a
Bloom filter and a column for each document, so the bits of a query term at all documents of the block are
the AND of a few rows (a slice). Terms are entered once for each level of their frequency that they reach, so
slices bound the frequency from above, and sums of weighted slices bound a document's score. Documents
whose bound reaches the score of the last place are scored again from their texts; no other can be in the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagweave.llm._memory import modest_batches
from lagweave.llm._shared import dropped, written
from lagweave.llm._words import PLAIN, find_words, mix, row_blocks, utf8

#: A term is entered at each of these frequencies that it reaches; what it has at most below the next one.
LEVELS = np.array([1, 2, 3, 5, 9, 17, 33, 65])
TOP = np.array([0, 1, 2, 4, 8, 16, 32, 64])
#: Bits of a filter for each entry (times 1 to 2, as sizes are powers of two), and of a filter at most: one of so many places, three a term.
BITS, MOST_BITS = 16, 1 << 21
#: Bits of a block's table (eight documents at least), and documents of a block at most.
TABLE, COLUMNS = 1 << 18, 1024
#: Bytes of query texts of one round; candidates up to so many are broadcast to the documents.
ROUND_BYTES, MAX_BROADCAST = 1 << 18, 200_000
#: Pieces in which an item's candidates are ranked first.
PIECES = 64


def entries(hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The entry of a term at a level: 64 bits, three times 21 of them are its places."""
    return mix(hashes + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def places(entry: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64(bits - 1)
    return [((entry >> np.uint64(s)) & mask).astype(np.int64) for s in (0, 21, 42)]


def counted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, frequency) of the distinct terms of each row."""
    if not len(rows):
        return rows, hashes, np.zeros(0, np.int64)
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])]))
    return r[new], h[new], np.diff(np.append(new, len(r)))


def terms_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row past the last, hashes, row of each term, terms a row) by blocks of whole rows."""
    data, offsets = utf8(batch.column(column))
    for low, high in row_blocks(offsets):
        _, _, hashes, bounds = find_words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], PLAIN)
        n = np.diff(bounds)
        yield low, high, hashes, np.repeat(np.arange(high - low), n), n


def table_of(rows: np.ndarray, entry: np.ndarray, n: int, bits: int) -> bytes:
    """Bits of ``n`` documents, document by document within a place, eight to a byte."""
    wide = -(-n // 8) * 8
    flat = np.zeros(bits * wide, bool)
    for at in places(entry, bits):
        flat[at * wide + rows] = True
    return np.packbits(flat).tobytes()


class Block:
    """Documents of a size band that wait for their table: lists of (ids, marks, lengths, rows, entries)."""

    def __init__(self, band: int) -> None:
        self.bits = min(BITS << band, MOST_BITS)
        self.room = int(np.clip(TABLE // self.bits, 8, COLUMNS))
        self.parts: list[tuple] = []
        self.n = 0

    def add(self, ids: pa.Array, marks: np.ndarray, lengths: np.ndarray, rows: np.ndarray, entry: np.ndarray) -> None:
        self.parts.append((ids, marks, lengths, rows + self.n, entry))
        self.n += len(marks)

    def cut(self, last: bool) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, bytes]]:
        """(bits, ids, marks, lengths, table) of full blocks, at the ``last`` call of all."""
        if not self.n or self.n < self.room and not last:
            return
        ids = pa.concat_arrays([p[0] for p in self.parts])
        marks, lengths, rows, entry = (np.concatenate([p[i] for p in self.parts]) for i in range(1, 5))
        order = np.argsort(rows, kind="stable")
        rows, entry = rows[order], entry[order]
        low = 0
        while low < self.n and (last or self.n - low >= self.room):
            high = min(low + self.room, self.n)
            a, b = np.searchsorted(rows, [low, high])
            yield self.bits, ids.slice(low, high - low), marks[low:high], lengths[low:high], table_of(rows[a:b] - low, entry[a:b], high - low, self.bits)
            low = high
        a = int(np.searchsorted(rows, low))
        self.parts = [(ids.slice(low), marks[low:], lengths[low:], rows[a:] - low, entry[a:])] if low < self.n else []
        self.n -= low


def scanned(docs: DataFrame, terms: np.ndarray, signatures: bool) -> DataFrame:
    """One pass over ``docs`` (id, mark, text): signature blocks, and counts for a query's ``terms`` (sorted hashes).

    Rows with ``bits`` are blocks (ids, marks, lengths, slices); others have the number of documents with
    ``term`` (a place in ``terms``), or for term -1 all documents and all terms.
    """
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"bits int, ids array<{kind}>, marks array<long>, lengths array<int>, slices binary, term int, n long, total long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Block] = {}
        df, n_docs, n_terms = np.zeros(len(terms), np.int64), 0, 0
        ids_type = None

        def row(block: tuple) -> pa.RecordBatch:
            bits, ids, marks, lengths, table = block
            at = pa.array([0, len(ids)], pa.int32())
            columns = [pa.array([bits], pa.int32()), pa.ListArray.from_arrays(at, ids), pa.ListArray.from_arrays(at, pa.array(marks, pa.int64())), pa.ListArray.from_arrays(at, pa.array(lengths, pa.int32())), pa.array([table], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, *[pa.nulls(1, k) for k in (pa.int32(), pa.int64(), pa.int64())]], names=names)

        for batch in batches:
            ids, marks, ids_type = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).type
            for low, high, hashes, rows, n in terms_of(batch, 2):
                r, h, tf = counted(rows, hashes)
                if len(terms) and len(h):
                    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                    df += np.bincount(at[terms[at] == h], minlength=len(terms))
                n_docs += int((n > 0).sum())
                n_terms += int(n.sum())
                if not signatures:
                    continue
                reached = np.searchsorted(LEVELS, tf, side="right")
                e_row = np.repeat(r, reached)
                level = np.arange(len(e_row)) - np.repeat(np.cumsum(reached) - reached, reached)
                entry = entries(np.repeat(h, reached), level)
                size = np.bincount(e_row, minlength=high - low)
                band = np.where(n > 0, np.ceil(np.log2(np.maximum(size, 1))).astype(int), -1)
                for b in np.unique(band[band >= 0]).tolist():
                    mine = np.flatnonzero(band == b)
                    place = np.full(high - low, -1)
                    place[mine] = np.arange(len(mine))
                    some = place[e_row] >= 0
                    block = held.setdefault(b, Block(b))
                    block.add(ids.take(pa.array(mine + low)), marks[mine + low], n[mine], place[e_row[some]], entry[some])
                    yield from map(row, block.cut(False))
        for block in held.values():
            yield from map(row, block.cut(True))
        if ids_type is not None:
            seen = np.flatnonzero(df)
            term, n = np.append(seen, -1), np.append(df[seen], n_docs)
            total = np.append(np.zeros(len(seen), np.int64), n_terms)
            nulls = [pa.nulls(len(term), k) for k in (pa.int32(), pa.list_(ids_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(term, pa.int32()), pa.array(n, pa.int64()), pa.array(total, pa.int64())], names=names)

    names = [x.strip().split()[0] for x in schema.replace(f"array<{kind}>", "array").split(",")]
    return docs.select("id", "mark", "text").mapInArrow(scan, schema)


@dataclass
class Queries:
    """Items of a round: their terms (sorted hashes), which of them each item has, repeats included, and their weights."""

    terms: np.ndarray
    flat: np.ndarray
    starts: np.ndarray
    live: np.ndarray
    weights: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 0

    @classmethod
    def of(cls, texts: list[str | None]) -> Queries:
        found: list[np.ndarray] = []
        for _, _, hashes, rows, n in terms_of(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), 0):
            ends = np.cumsum(n)
            found += [hashes[a:b] for a, b in zip(ends - n, ends)]
        terms = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        live = np.array([i for i, x in enumerate(found) if len(x)], np.int64)
        sizes = np.array([len(found[i]) for i in live], np.int64)
        flat = np.searchsorted(terms, np.concatenate([found[i] for i in live])) if len(live) else np.zeros(0, np.int64)
        return cls(terms, flat, np.cumsum(sizes) - sizes, live)

    def weigh(self, counts: list) -> None:
        """Weights from the rows of counts of ``scanned``; a term in no document weighs 0."""
        self.weights = np.zeros(len(self.terms), np.int64)
        every = {r["term"]: r for r in counts}
        if -1 in every:
            self.n_docs, self.n_terms = every[-1]["n"], every[-1]["total"]
        for t, r in every.items():
            if t >= 0:
                self.weights[t] = math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * r["n"] + 1)))

    def norm(self, lengths: np.ndarray) -> np.ndarray:
        return 75 + (25 * lengths.astype(np.int64) * self.n_docs) // max(self.n_terms, 1)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """By live item and document: the sum over the item's terms of ``values`` (terms by documents)."""
        return np.add.reduceat(values[self.flat], self.starts, axis=0) if len(self.flat) else np.zeros((0, values.shape[1]), np.int64)

    def points(self, tf: np.ndarray, norm: np.ndarray, term: np.ndarray) -> np.ndarray:
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * norm))

    def bounds(self, bits: int, lengths: np.ndarray, slices: bytes) -> np.ndarray:
        """Upper bounds of the score of each live item at each document of a block."""
        n, wide = len(lengths), -(-len(lengths) // 8)
        table = np.frombuffer(slices, np.uint8).reshape(bits, wide)
        level = np.zeros((len(self.terms), n), np.uint8)
        so_far = np.full((len(self.terms), wide), 255, np.uint8)
        for k in range(len(LEVELS)):
            for at in places(entries(self.terms, np.full(len(self.terms), k)), bits):
                so_far &= table[at]
            if not so_far.any():
                break
            level += np.unpackbits(so_far, axis=1, count=n)
        term, doc = np.nonzero(level * (self.weights > 0)[:, None])
        reached = level[term, doc]
        tf = np.where(reached == len(LEVELS), lengths[doc], np.minimum(np.append(TOP, 0)[reached], lengths[doc])).astype(np.int64)
        values = np.zeros(level.shape, np.int64)
        values[term, doc] = self.points(tf, self.norm(lengths)[doc], term)
        return self.sums(values)


def block_columns(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, bytes]]:
    bits, ids, marks, lengths, slices = (batch.column(batch.schema.get_field_index(c)) for c in ("bits", "ids", "marks", "lengths", "slices"))
    for i in range(batch.num_rows):
        yield bits[i].as_py(), ids[i].values, marks[i].values.to_numpy(), lengths[i].values.to_numpy(), slices[i].as_py()


def bounded(blocks: DataFrame, queries, k: int) -> DataFrame:  # noqa: ANN001
    """(item, id, mark, bound): of each task the ``k`` largest bounds of each item."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        least = np.zeros(len(q.live), np.int64)
        parts: list[tuple] = []
        size = 0

        def top() -> list[tuple]:
            ids = pa.concat_arrays([p[0] for p in parts])
            item, mark, bound = (np.concatenate([p[j] for p in parts]) for j in (1, 2, 3))
            order = np.lexsort((-bound, item))
            nth = np.arange(len(order)) - np.searchsorted(item[order], item[order])
            keep = order[nth < k]
            full = order[nth == k - 1]
            least[item[full]] = bound[full]
            return [(ids.take(pa.array(keep)), item[keep], mark[keep], bound[keep])]

        for batch in batches:
            for bits, ids, marks, lengths, slices in block_columns(batch):
                bound = q.bounds(bits, lengths, slices)
                item, doc = np.nonzero(bound > least[:, None])
                if len(item):
                    parts.append((ids.take(pa.array(doc)), item, marks[doc], bound[item, doc]))
                    size += len(item)
                if size > 4 * k * len(q.live) + 10_000:
                    parts = top()
                    size = len(parts[0][1])
        if parts:
            ids, item, mark, bound = top()[0]
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids, pa.array(mark, pa.int64()), pa.array(bound, pa.int64())], names=["item", "id", "mark", "bound"])

    return blocks.mapInArrow(best, f"item int, id {kind}, mark long, bound long")


def reaching(blocks: DataFrame, queries, least) -> DataFrame:  # noqa: ANN001
    """(item, id, mark): all whose bound is positive and reaches the item's ``least``."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, floor = queries.value, np.maximum(least.value, 1)
        for batch in batches:
            for bits, ids, marks, lengths, slices in block_columns(batch):
                item, doc = np.nonzero(q.bounds(bits, lengths, slices) >= floor[:, None])
                if len(item):
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids.take(pa.array(doc)), pa.array(marks[doc], pa.int64())], names=["item", "id", "mark"])

    return blocks.mapInArrow(pick, f"item int, id {kind}, mark long")


def scored(docs: DataFrame, wanted: DataFrame, queries) -> DataFrame:  # noqa: ANN001
    """(item, id, score): exact scores of the ``wanted`` (item, id, mark) from the texts; each row of ``docs`` (id, mark, text) counts."""
    lists = written(wanted.groupBy("id", "mark").agg(F.sort_array(F.collect_set("item")).alias("items")))  # items of a round
    small = lists.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    right = lists.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "items")
    met = docs.join(F.broadcast(right) if small else right, (F.col("mark") == F.col("_mark")) & F.col("id").eqNullSafe(F.col("_id"))).select("id", "items", "text")
    kind = docs.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        ends = np.append(q.starts[1:], len(q.flat))
        for batch in batches:
            ids, items = batch.column(0), batch.column(1)
            for low, high, hashes, rows, n in terms_of(batch, 2):
                r, h, tf = counted(rows, hashes)
                at = np.minimum(np.searchsorted(q.terms, h), len(q.terms) - 1)
                hit = q.terms[at] == h
                r, at, tf = r[hit], at[hit], tf[hit]
                points = q.points(tf, q.norm(n)[r], at)
                edges = np.searchsorted(r, np.arange(high - low + 1))
                out_item, out_row, out_score = [], [], []
                value = np.zeros(len(q.terms), np.int64)
                for row in range(high - low):
                    mine = slice(edges[row], edges[row + 1])
                    value[at[mine]] = points[mine]
                    for i in items[low + row].as_py():
                        out_item.append(i)
                        out_row.append(low + row)
                        out_score.append(int(value[q.flat[q.starts[i] : ends[i]]].sum()))
                    value[at[mine]] = 0
                yield pa.RecordBatch.from_arrays([pa.array(out_item, pa.int32()), ids.take(pa.array(out_row, pa.int64())), pa.array(out_score, pa.int64())], names=["item", "id", "score"])

    out = written(met.mapInArrow(score, f"item int, id {kind}, score long").where("score > 0"))
    dropped(lists)
    return out


def best(rows: DataFrame, by: str, k: int) -> DataFrame:
    """(rows, ``rank``) of the ``k`` largest of each item, equal ones by ascending id, null ids last; in pieces first."""
    order = [F.desc(by), F.col("id").asc_nulls_last()]
    piece = Window.partitionBy("item", F.pmod(F.xxhash64("id", by), F.lit(PIECES))).orderBy(*order)
    some = rows.withColumn("rank", F.row_number().over(piece)).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(item_col, rank, id_col, score): of each item the ``k`` best documents with a score over 0, equal scores by ascending id.

    Terms are runs of letters and digits without regard to the case of A-Z, told apart by 64-bit hashes.
    Null and empty texts have none; rows of ``docs`` are documents of their own, also with repeated or null ids
    (null ids come last of equals). Repeated items count once, those of the same id with different texts each
    for itself; items without terms find nothing. Items are the queries: their texts go through the driver in
    rounds of about ``round_bytes``, each with two passes over the signatures; the signatures are built once.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = written(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null").distinct())
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_rounds = max(1, -(-size // round_bytes))
    blocks, out = None, None
    for r in range(n_rounds):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_rounds)) == r).orderBy("item_id", "text").collect()  # a round's queries
        queries = Queries.of([x["text"] for x in mine])
        index = written(scanned(rows, queries.terms, blocks is None))
        queries.weigh(index.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect())  # a row a query term
        if blocks is None:
            blocks = index.where("bits is not null").select("bits", "ids", "marks", "lengths", "slices")
        sent = spark.sparkContext.broadcast(queries)
        likely = best(bounded(blocks, sent, k), "bound", k)
        first = best(scored(rows, likely, sent), "score", k)
        least = np.zeros(len(queries.live), np.int64)
        for x in first.where(F.col("rank") == k).select("item", "score").collect():  # a row an item
            least[x["item"]] = x["score"]
        floor = spark.sparkContext.broadcast(least)
        # of equal texts only the k smallest ids can be in the result
        copies = Window.partitionBy("item", "mark").orderBy(F.col("id").asc_nulls_last())
        wanted = reaching(blocks, sent, floor).withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k)
        found = best(scored(rows, wanted, sent), "score", k)
        names = spark.createDataFrame([(i, mine[int(j)]["item_id"]) for i, j in enumerate(queries.live)], f"item int, `{item_col}` {asked.schema['item_id'].dataType.simpleString()}")
        found = written(found.join(F.broadcast(names), "item").select(item_col, "rank", F.col("id").alias(id_col), "score"))
        out = found if out is None else out.union(found)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item among all documents."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH terms AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), p) AS w FROM documents, terms),
i AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(text, u, l), p) AS w FROM (SELECT DISTINCT item_id, text FROM benchmark) b, terms),
s AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
q AS (SELECT iid, term, count(*) AS times FROM (SELECT iid, unnest(w) AS term FROM i) GROUP BY ALL),
tf AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS wt FROM tf, s GROUP BY term),
m AS (SELECT rid, doc_id, 75 + (25 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
sc AS (SELECT iid, rid, sum(times * wt * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id)::INT AS rank FROM sc JOIN m USING (rid) JOIN i USING (iid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
