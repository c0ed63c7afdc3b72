"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

A document is the set of its word n-grams. Sizes fall into bands, so that linked sets lie in one
band or in neighbours. Two sets of a band differ in at most H tokens; the token universe is hashed
into segments, and each segment is allotted 1 (its subset is indexed) or 2 (its subset and all
subsets with one token deleted are). If the allotments of a set's own filled segments add up to more
than H, it shares an indexed signature with every set linked to it.

Tokens that very many sets have take no part in the first partition, so that a passage, a line or a
licence that many documents share brings no crowd together, and no bucket there holds more sets than
its rarest token has. Sets with too few other tokens for the guarantee are also indexed by all of
their tokens. Candidates are verified exactly.

No group is expanded into all its pairs. Equal sets are one node. In each signature's bucket all
nodes are first tested against a few of them, in rounds, while buckets span several connected
components; the pairs across components that are left in a bucket are tested last, block by block,
so components are exact. Before texts are compared, the parities of hashed tokens in 1024 cells bound
the difference of two sets from below and rule most unlinked pairs out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagweave.llm._memory import modest_batches, only
from lagweave.llm._shared import dropped, salted_join, written
from lagweave.llm._words import LOWER, find_words, mix, row_blocks, utf8, window_hashes
from lagweave.llm.components import MAX_BROADCAST_LABELS, connected

#: Row ids up to this many (8 bytes each) are broadcast as a filter; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Tokens of at least so many sets are common; at most so many (8 bytes each) are, those of the most sets.
COMMON_FROM, MAX_COMMON = 64, 1_000_000
#: A task reports tokens of at least so many of its sets, and holds about so many distinct ones.
SEEN_FROM, _HELD = 4, 400_000
#: Partitions by all tokens that are tried before empty segments are indexed too.
SALTS = 3
#: 64-bit words of a sketch; nodes of a bucket that the others are tested against by round; nodes of a block.
CELLS, CENTRES, BLOCK = 16, (1, 1, 2, 3, 3, 3), 2048
#: Bytes of text that are worked at once.
WORKED = 1 << 18
#: Pieces that a bucket of common tokens alone is dealt to.
SPREAD = 32


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a shorter sequence is one shingle."""
    if 0 < len(words) < width:
        width = len(words)
    return np.unique(window_hashes(words, width)) if len(words) else np.zeros(0, np.uint64)


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set as a signed integer; equal sets have equal keys."""
    return int(mix(np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))])).view(np.int64)[0])


@cache
def bands(percent: int, up_to: int) -> tuple[int, ...]:
    """Lowest sizes of the bands; linked sets lie in one band or in neighbours."""
    lows = [1]
    while lows[-1] <= up_to:
        lows.append(lows[-1] * 100 // percent + 1)
    return tuple(lows)


def band_of(size: int, percent: int) -> int:
    up_to = 1 << max(10, size.bit_length())
    return int(np.searchsorted(bands(percent, up_to), size, side="right")) - 1


@dataclass(frozen=True)
class Scheme:
    """How sets whose smaller partner is in one band are split: ``double`` of ``segments`` are allotted 2.

    Linked ones differ in at most ``differ`` tokens, and none has more than ``largest``.
    """

    band: int
    largest: int
    differ: int
    segments: int
    double: int


def most_different(upper: int, percent: int) -> int:
    """The most tokens by which linked sets differ if the smaller has at most ``upper``."""
    return (100 - percent) * (upper + upper * 100 // percent) // (100 + percent)


def expected(tokens: float, segments: int, double: int) -> tuple[float, float, float]:
    """(allotment of filled segments, its deviation, signatures) to expect of a set of so many tokens."""
    t = tokens / segments
    none = math.exp(-t)
    one, two = 1 - none, 1 - none * (1 + t)
    alike = max(0.0, none * (1 - (1 + t) * none))
    spread = (segments - double) * alike + 4 * double * two * (1 - two)
    return (segments - double) * one + 2 * double * two, math.sqrt(spread), segments * one + double * t * two


@cache
def plan(band: int, percent: int, population: int, shared: float = 0.001) -> Scheme | None:
    """The cheapest allotment for a band of ``population`` sets; None if linked sets must be equal.

    A signature costs 1 to write and shuffle, and a tenth for each set that its segment's subset meets
    by chance, a token of it being in another set with the chance ``shared``. Segments are as few as
    leave a set with a tenth of common tokens the guarantee, three deviations off.
    """
    lows = bands(percent, 1 << 10)
    while len(lows) < band + 2:
        lows = bands(percent, lows[-1] * 4)
    upper = lows[band + 1] - 1
    h = most_different(upper, percent)
    if h == 0:
        return None
    size, best = lows[band], None
    for tenths in (0, 2, 4, 6, 8, 10):
        m = max(2, (h + 1) * 10 // (10 + tenths))
        while m <= 4 * size + 16:
            double = m * tenths // 10
            weight, deviation, count = expected(0.9 * size, m, double)
            if weight - 3 * deviation >= h + 1:
                cost = count * (1 + 0.1 * population * shared ** max(1.0, size / m - (tenths > 0)))
                if best is None or cost < best[0]:
                    best = cost, Scheme(band, upper * 100 // percent, h, m, double)
                break
            m += max(1, m // 32)
    return best[1] if best else Scheme(band, upper * 100 // percent, h, 2 * size, 0)


def signatures(tokens: np.ndarray, scheme: Scheme, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signatures of a set, whether only common tokens made each).

    ``common`` marks tokens that take no part in the first partition. A set that has the guarantee in
    one partition needs no further one. Linked sets share a signature: that of the first partition in
    which one of them has the guarantee, which both are indexed by, or of the last one's empty segments.
    """
    common = np.zeros(len(tokens), bool) if common is None else common
    sigs, hot = [], []
    for turn in range(SALTS + 1):
        use, often = (tokens[~common], common[~common]) if turn == 0 else (tokens, common)
        salt = np.uint64((scheme.band * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & (1 << 64) - 1)
        mixed = mix(use + salt)
        segment = ((mixed >> np.uint64(33)) % np.uint64(scheme.segments)).astype(np.int64)
        value = mix(mixed)
        low = np.bincount(segment, (value & np.uint64(0xFFFFFFFF)).astype(float), scheme.segments).astype(np.uint64)
        high = np.bincount(segment, (value >> np.uint64(32)).astype(float), scheme.segments).astype(np.uint64)
        sums = low + (high << np.uint64(32))
        label = mix(np.arange(scheme.segments, dtype=np.uint64) + salt + np.uint64(1))
        count = np.bincount(segment, minlength=scheme.segments)
        plain = np.bincount(segment, ~often, scheme.segments)
        filled = count > 0
        sigs.append(mix(sums + label)[filled])
        hot.append((plain == 0)[filled])
        if scheme.double:
            twice = (segment < scheme.double) & (count[segment] > 1)
            at = segment[twice]
            sigs.append(mix(sums[at] - value[twice] + label[at]))
            hot.append(plain[at] == ~often[twice])
        if 2 * (count[: scheme.double] > 1).sum() + filled[scheme.double :].sum() > scheme.differ:
            break
    else:
        empty = count == 0
        empty[: scheme.double] |= count[: scheme.double] == 1
        sigs.append(mix(label)[empty])
        hot.append(np.ones(int(empty.sum()), bool))
    out, first = np.unique(np.concatenate(sigs), return_index=True)
    return out, np.concatenate(hot)[first]


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens in 64 * CELLS cells: two sets differ in as many tokens as in cells, or more."""
    cell = (mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(40)) % np.uint64(64 * CELLS)
    odd = np.bincount(cell.astype(np.int64), minlength=64 * CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(percent: int) -> Column:
    """Whether the sketches of x and y leave room for a link."""
    differ = " + ".join(f"bit_count(x.sketch[{k}] ^ y.sketch[{k}])" for k in range(CELLS))
    return F.expr(f"({differ}) * {100 + percent} <= {100 - percent} * (x.n_shingles + y.n_shingles)")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    only("shingles")
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for low, high in row_blocks(offsets, WORKED):
            part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            _, _, words, bounds = find_words(part, at, LOWER)
            yield batch, low, [shingles(words[a:b], width) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        del data, offsets
        pa.default_memory_pool().release_unused()  # workers are used again by other stages


def nodes_of(docs: DataFrame, width: int) -> DataFrame:
    """One pass over (doc, text): a row (doc, mark, n_shingles, key, sketch) for every row of ``docs``,
    and rows (token, times) of tokens that several sets of a task have, or a null token with how many
    tokens, among how many, another set of the task has too.

    ``mark`` is a hash of the text; the key of an empty set is null. A task counts equal sets once.
    """
    kind = docs.schema["doc"].dataType.simpleString()
    schema = None

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal schema
        done: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = n_sets = 0

        def merged(least: int) -> tuple[np.ndarray, np.ndarray]:
            tokens, inverse = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            times = np.bincount(inverse, np.concatenate([n for _, n in held])).astype(np.int64)
            keep = times >= least
            return tokens[keep], times[keep]

        for batch, low, found in _sets(batches, width):
            keys = [set_key(s) if len(s) else None for s in found]
            new = []
            for key, tokens in zip(keys, found):
                if key is not None and key not in done:
                    if len(done) > 500_000:
                        done.clear()
                    done.add(key)
                    new.append(tokens)
            if new:
                held.append(np.unique(np.concatenate(new), return_counts=True))
                n_sets += len(new)
                size += len(held[-1][0])
                if size > _HELD:
                    least = 1
                    while size > _HELD // 2:  # those seen least are forgotten
                        held[:] = [merged(least)]
                        size, least = len(held[0][0]), least + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, len(found)), batch.column(2).slice(low, len(found)), pa.array([len(s) for s in found], pa.int64()), pa.array(keys, pa.int64()), pa.array([parity_sketch(s) for s in found], pa.list_(pa.int64())), pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int64())],
                names=["doc", "mark", "n_shingles", "key", "sketch", "token", "times", "among"],
            )
            schema = batch.schema
        if held:
            tokens, times = merged(1)
            few = times < SEEN_FROM
            also, among = int((times * (times - 1))[few].sum()), int(times.sum()) * max(1, n_sets - 1)
            often = np.flatnonzero(~few)
            n = len(often) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, schema.types[0]), *[pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))], pa.array([*tokens[often].view(np.int64).tolist(), None], pa.int64()), pa.array([*times[often].tolist(), also], pa.int64()), pa.array([None] * (n - 1) + [among], pa.int64())],
                names=["doc", "mark", "n_shingles", "key", "sketch", "token", "times", "among"],
            )

    return docs.select("doc", "text", F.xxhash64("text").alias("mark")).mapInArrow(sets, f"doc {kind}, mark long, n_shingles long, key long, sketch array<long>, token long, times long, among long")


def common_tokens(seen: DataFrame) -> np.ndarray:
    """The sorted tokens that very many sets have, from the (token, times) of all tasks: at most ``MAX_COMMON``.

    A histogram of the counts gives the cut. A token of up to ``SEEN_FROM`` sets in every task may be
    missed; that costs time only.
    """
    counts = written(seen.groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= COMMON_FROM))
    step = F.floor(F.log2("times") * 16)
    cut, total = None, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # a few hundred rows
        total += r["n"]
        if total > MAX_COMMON:
            break
        cut = r["step"]
    out = np.zeros(0, np.int64) if cut is None else counts.where(step >= cut).select("token").toArrow().column(0).to_numpy()
    dropped(counts)
    return np.sort(out.astype(np.int64).view(np.uint64))


def buckets_of(docs: DataFrame, width: int, percent: int, populations: dict[int, int], shared: float, common: np.ndarray) -> DataFrame:
    """(sig, spread, key): the signatures of every distinct set (equal sets of one task are given once).

    ``spread`` is 0, or a piece from 1 to ``SPREAD`` if only common tokens made the signature.
    """
    often = docs.sparkSession.sparkContext.broadcast(common)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        known = often.value
        for _, _, found in _sets(batches, width):
            sigs, hots, keys = [], [], []
            for tokens in found:
                if not len(tokens) or (key := set_key(tokens)) in done:
                    continue
                if len(done) > 500_000:
                    done.clear()
                done.add(key)
                at = np.searchsorted(known, tokens)
                frequent = known[np.minimum(at, len(known) - 1)] == tokens if len(known) else None
                own = band_of(len(tokens), percent)
                for band in (own, own - 1):
                    if band >= 0 and (s := plan(band, percent, populations.get(band, 0), shared)) is not None and len(tokens) <= s.largest:
                        got, hot = signatures(tokens, s, frequent)
                        sigs.append(got)
                        hots.append(np.where(hot, key % SPREAD + 1, 0).astype(np.int32))
                        keys.append(np.full(len(got), key, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(hots)), pa.array(np.concatenate(keys))], names=["sig", "spread", "key"])

    return docs.select("doc", "text").mapInArrow(emit, "sig long, spread int, key long")


def texts_of(docs: DataFrame, sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text): one text for each of ``keys``; documents are not shuffled while the texts are few."""
    wanted = written(keys.join(sets.select("key", "first.*"), "key"))
    few = wanted.count() <= MAX_BROADCAST_IDS
    found = docs.select("doc", "text", F.xxhash64("text").alias("mark")).alias("d").join((F.broadcast(wanted) if few else wanted).alias("w"), F.expr("d.mark = w.mark and d.doc <=> w.doc"))
    out = written(found.select("key", "text").dropDuplicates(["key"]))
    dropped(wanted)
    return out


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are linked, decided on the whole texts; many pairs may have the same b."""
    full = pairs.select("a", "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    full = salted_join(full, texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b", "a")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column: pa.Array) -> Iterator[np.ndarray]:
            last, tokens = None, None
            for cell in column:
                if (text := cell.as_py()) != last or tokens is None:
                    data, offsets = utf8(pa.array([text], pa.large_string()))
                    last, tokens = text, shingles(find_words(data, offsets, LOWER)[2], width)
                yield tokens

        only("shingles")
        for batch in batches:
            keep = [linked(x, y, percent) for x, y in zip(sets(batch.column(2)), sets(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.select("a", "b", "text_a", "text_b").mapInArrow(decide, "a long, b long")


def dealt(buckets: DataFrame) -> DataFrame:
    """``buckets`` (sig, hot, ...), one row each, copied to every piece of a hot one as ``spread``."""
    return buckets.select("*", F.explode(F.when(F.col("hot"), F.sequence(F.lit(1), F.lit(SPREAD))).otherwise(F.array(F.lit(0)))).alias("spread")).drop("hot")


def spanning(placed: DataFrame) -> DataFrame:
    """The rows of ``placed`` (sig, spread, key, part) whose bucket has several parts."""
    each = Window.partitionBy("sig", "spread")
    cold = placed.where("spread = 0").withColumns({"low": F.min("part").over(each), "high": F.max("part").over(each)}).where("low < high")  # no more than a token's sets
    hot = placed.where("spread > 0")
    many = hot.groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("sig", F.lit(True).alias("hot"))
    return cold.select("sig", "spread", "key", "part").union(hot.join(dealt(many), ["sig", "spread"]).select("sig", "spread", "key", "part"))


def near(parts: DataFrame) -> DataFrame:
    """Components to be broadcast if they are few."""
    return F.broadcast(parts) if parts.n_rows <= MAX_BROADCAST_LABELS else parts


def across(left: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b) of all nodes of ``left`` (sig, spread, key, part) that share a bucket across parts and may link.

    Buckets are cut into blocks of about ``BLOCK`` nodes and each two blocks meet in a group of their own.
    """
    sizes = left.groupBy("sig", (F.col("spread") > 0).alias("hot")).agg(F.count("*").alias("n")).select("sig", "hot", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    rows = left.join(dealt(sizes), ["sig", "spread"]).join(sketches, "key").withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    x = rows.select("*", F.explode(F.expr("sequence(block, blocks - 1)")).alias("other")).alias("x")
    y = rows.select("*", F.explode(F.expr("sequence(0l, block)")).alias("other")).alias("y")
    met = x.join(y, F.expr("x.sig = y.sig and x.block = y.other and x.other = y.block and x.part <> y.part and (x.block < y.block or x.key < y.key)") & may_link(percent))
    return met.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc, mark, n_shingles, key) of ``docs``, and (key, part) of its distinct sets; linked ones have one part."""
    modest_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    first_pass = written(nodes_of(base, width))
    rows = first_pass.where("token is null and among is null").select("doc", "mark", "n_shingles", "key")
    sets = written(first_pass.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "mark")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    lows = bands(percent, 1 << 31)
    band = F.expr(f"size(filter(array({','.join(map(str, lows))}), x -> x <= n_shingles)) - 1")
    populations = {r["band"]: r["n"] for r in sets.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()}  # one row a band
    also, among = first_pass.where("among is not null").agg(F.sum("times"), F.sum("among")).first()
    common = common_tokens(first_pass.where("token is not null").select("token", "times"))
    sigs = buckets_of(base, width, percent, populations, float(f"{max(1e-9, (also or 0) / (among or 1)):.1g}"), common)
    sketches = sets.select("key", "n_shingles", "sketch")
    spans = sigs.select("sig", "spread", "key", F.expr("min(key) over (partition by sig, spread)").alias("low"), F.expr("max(key) over (partition by sig, spread)").alias("high"))
    met = written(spans.where("low < high or spread > 0").select("sig", "spread", "key"))
    shared = written(met.distinct())
    dropped(met)
    texts = texts_of(base, sets, shared.select("key").distinct())
    links, parts, found = [], None, 0
    for turn in range(len(CENTRES) + 1):
        placed = shared.withColumn("part", F.col("key")) if parts is None else shared.join(near(parts).withColumnRenamed("node", "key"), "key", "left").withColumn("part", F.coalesce("component", "key")).drop("component")
        left = written(spanning(placed))
        n_left = left.count()
        dropped(shared)
        shared = left.select("sig", "spread", "key")
        shared.written_at = left.written_at
        if not n_left:
            break
        last = turn == len(CENTRES) or turn > 1 and found <= n_left // 100  # rounds that find little more
        if last:
            pairs = across(left, sketches, percent)
        else:
            by_turn = Window.partitionBy("sig").orderBy(F.xxhash64("key", F.lit(turn)))
            centres = left.withColumn("rank", F.row_number().over(by_turn)).where(F.col("rank") <= CENTRES[turn]).select("sig", (F.col("spread") > 0).alias("hot"), F.col("key").alias("b"), F.col("part").alias("its"))
            met = left.withColumnRenamed("key", "a").join(dealt(centres), ["sig", "spread"]).where("part <> its").select("a", "b").distinct()
            x, y = sketches.withColumnRenamed("key", "a").alias("x"), sketches.withColumnRenamed("key", "b")
            once = met.join(x, "a")
            pairs = salted_join(once.select("a", "b", F.struct("n_shingles", "sketch").alias("x")), y.select("b", F.struct("n_shingles", "sketch").alias("y")), "b", "a").where(may_link(percent)).select("a", "b")
        pairs = written(pairs)
        new = written(verify(pairs, texts, width, percent))
        dropped(pairs)
        found = new.count()
        links.append(new)
        if parts is not None:
            dropped(parts)
        every = links[0]
        for more in links[1:]:
            every = every.union(more)
        parts = connected(every)
        if last:
            break
    dropped(shared, texts, *links)
    if parts is None:
        return rows, sets.select("key", "first", F.col("key").alias("part"))
    return rows, sets.select("key", "first").join(near(parts).withColumnRenamed("node", "key"), "key", "left").select("key", "first", F.coalesce("component", "key").alias("part"))


def link_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id, mark, kept) for every row of ``docs``.

    Rows link when the intersection of their sets is at least ``percent`` % of the union; component_id
    is the smallest id reachable. ``mark`` is the text's xxhash64; ``kept`` is true for the rows of one
    (id, mark) of each component, the smallest, and for rows without words. Words are lower-cased
    (A-Z). Null, empty and white-space texts have an empty set, link with nothing and are their own
    component. Rows with equal or null ids are judged one by one; a null id takes no part in the
    minimum. Other columns are ignored. An empty table gives an empty result.
    """
    rows, sets = grouped(docs, id_col, text_col, width, percent)
    smallest = sets.groupBy("part").agg(F.min("first").alias("least"))
    final = salted_join(sets.select("part", "key"), smallest, "part", "key").select("key", "least")
    own = F.struct(F.col("doc").isNull().alias("none"), "doc", "mark")
    out = salted_join(rows.withColumn("at", F.struct("doc", "mark")), final, "key", "at", "left")
    return out.select(F.col("doc").alias(id_col), "n_shingles", F.coalesce("least.doc", "doc").alias("component_id"), "mark", F.coalesce(own == F.col("least"), F.lit(True)).alias("kept"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return link_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
inter AS (SELECT a.rid AS x, b.rid AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
e AS (SELECT x, y FROM inter JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * i >= 90 * (p.n + q.n - i)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(t.doc_id) AS component_id
FROM d JOIN reach r ON r.x = d.rid JOIN d t ON t.rid = r.y LEFT JOIN n ON n.rid = d.rid GROUP BY d.rid, d.doc_id
"""
