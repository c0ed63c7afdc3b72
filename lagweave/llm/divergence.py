"""How far the sources of a language differ in their words, counted through a minimal acyclic transducer.

Terms of enough documents are kept. Sorted ranges of them become minimal acyclic transducers that turn
a term into its place in the order of its language (its ordinal), built in tasks, one range each. Texts then
stream through the transducers, all words of a batch in step, and counts are by ordinal: small numbers in
place of strings. Ties are settled by ordinals, which order as the terms' UTF-8 does, and the transducers
turn ordinals back into terms at the end.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagweave.llm._memory import modest_batches, only, remembers
from lagweave.llm._shared import dropped, written
from lagweave.llm._words import LOWER, find_words, row_blocks, utf8

#: Lower case; all that is no ASCII letter and no byte of a longer character as white space.
LETTERS = np.where((LOWER >= 0x80) | np.isin(LOWER, np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)), LOWER, 0x20).astype(np.uint8)
#: Terms of one transducer, and bytes of transducers that are sent to the tasks at a time; more go in rounds.
SHARD_TERMS, ROUND_BYTES = 1 << 15, 64 << 20
#: Distinct terms that a task adds up before it hands them on.
HELD = 400_000
#: Ordinals and sources of one tile of the comparison of sources.
TILE_TERMS, TILE_SOURCES = 1024, 256


# The transducer


@dataclass
class Transducer:
    """Transitions sorted by (state, byte), each with how many terms it skips; states that end a term come first among their own.

    State 0 is the start. ``keys`` are state * 256 + byte, ``targets`` the next state, ``skips`` the
    number of terms of the state that come before those of the transition.
    """

    keys: np.ndarray
    targets: np.ndarray
    skips: np.ndarray
    ends: np.ndarray
    size: int

    @classmethod
    def build(cls, terms: list[bytes]) -> Transducer:
        """From sorted distinct terms, none empty: states with equal futures are shared as soon as no later term can change them."""
        known: dict[tuple, int] = {}
        done: list[tuple] = []
        counts: list[int] = []
        #: Open states along the last term: [ends a term, bytes, children].
        path: list[list] = [[False, [], []]]
        last = b""

        def close(down_to: int) -> None:
            while len(path) > down_to + 1:
                end, letters, children = path.pop()
                state = (end, tuple(letters), tuple(children))
                at = known.get(state)
                if at is None:
                    at = known[state] = len(done)
                    done.append(state)
                    counts.append(end + sum(counts[c] for c in children))
                path[-1][2].append(at)

        for term in terms:
            same = 0
            for a, b in zip(term, last):
                if a != b:
                    break
                same += 1
            close(same)
            for letter in term[same:]:
                path[-1][1].append(letter)
                path.append([False, [], []])
            path[-1][0] = True
            last = term
        close(0)
        done.append((path[0][0], tuple(path[0][1]), tuple(path[0][2])))
        counts.append(len(terms))
        top = len(done) - 1  # the start becomes state 0
        keys, targets, skips = [], [], []
        for state in range(top, -1, -1):
            end, letters, children = done[state]
            skip = int(end)
            for letter, child in zip(letters, children):
                keys.append((top - state) * 256 + letter)
                targets.append(top - child)
                skips.append(skip)
                skip += counts[child]
        ends = np.array([done[s][0] for s in range(top, -1, -1)], bool)
        return cls(np.array(keys, np.int64), np.array(targets, np.int32), np.array(skips, np.int32), ends, len(terms))

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, keys=self.keys, targets=self.targets, skips=self.skips, ends=np.packbits(self.ends), shape=np.array([len(self.ends), self.size]))
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Transducer:
        x = np.load(io.BytesIO(data))
        return cls(x["keys"], x["targets"], x["skips"], np.unpackbits(x["ends"], count=int(x["shape"][0])).astype(bool), int(x["shape"][1]))

    def ordinals(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each word text[start : start + length] its ordinal, or -1: all words take a step at a time."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.keys):
            return out
        live, state, place = np.arange(len(starts)), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        step = 0
        while len(live):
            over = lengths[live] == step
            if over.any():
                ended = over & self.ends[state]
                out[live[ended]] = place[ended]
                live, state, place = live[~over], state[~over], place[~over]
            key = state * 256 + text[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, state, place = live[ok], self.targets[at[ok]].astype(np.int64), place[ok] + self.skips[at[ok]]
            step += 1
        return out

    def term(self, ordinal: int) -> bytes:
        """The term of an ordinal."""
        state, out = 0, bytearray()
        while True:
            if self.ends[state]:
                if ordinal == 0:
                    return bytes(out)
            low, high = np.searchsorted(self.keys, [state * 256, state * 256 + 256])
            at = low + int(np.searchsorted(self.skips[low:high], ordinal, side="right")) - 1
            out.append(int(self.keys[at]) & 255)
            ordinal -= int(self.skips[at])
            state = int(self.targets[at])


# Passes over the texts


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row past the last, text, starts, ends, hashes, row of each word) by blocks of whole rows; the text is the last column."""
    data, offsets = utf8(batch.column(batch.num_columns - 1))
    for low, high in row_blocks(offsets):
        part = LETTERS[data[offsets[low] : offsets[high]]]
        starts, ends, hashes, bounds = find_words(part, offsets[low : high + 1] - offsets[low])
        yield low, high, part, starts, ends, hashes, np.repeat(np.arange(high - low), np.diff(bounds))


def added_up(n: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one, sum of ``n``) of each distinct combination of keys, in their order."""
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(n), bool)
    new[0] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return order[at], np.add.reduceat(n[order], at)


def strings(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words text[start:end] as an Arrow column."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    data = text[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data.astype(np.uint8).tobytes()))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, df): documents of each language that hold each term; ``docs`` (lang, text).

    A task adds up what it sees before Spark does, so a frequent term is few rows however many texts have it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        size = 0

        def added() -> list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
            lang, hashes, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            first, total = added_up(n, lang, hashes)
            return [(lang[first], hashes[first], total, pa.concat_arrays([x[3] for x in held]).take(pa.array(first)))]

        def rows_of() -> pa.RecordBatch:
            ((lang, _, n, terms),) = added()
            return pa.RecordBatch.from_arrays([pa.array(list(names)).take(pa.array(lang)), terms, pa.array(n)], names=["lang", "term", "df"])

        for batch in batches:
            codes = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.int64)
            for low, high, part, starts, ends, hashes, rows in _blocks(batch):
                one, _ = added_up(np.ones(len(rows), np.int64), rows, hashes)  # a word counts once a document
                lang = codes[low:high][rows[one]]
                at, n = added_up(np.ones(len(one), np.int64), lang, hashes[one])
                at, lang = one[at], lang[at]
                held.append((lang, hashes[at], n, strings(part, starts[at], ends[at])))
                size += len(at)
                if size >= HELD:
                    held = added()
                    size = len(held[0][0])
                    if size >= HELD // 2:
                        yield rows_of()
                        held, size = [], 0
        if held:
            yield rows_of()

    return docs.select("lang", "text").mapInArrow(count, "lang string, term string, df long").groupBy("lang", "term").agg(F.sum("df").alias("df"))


def build_vocabulary(frequencies: DataFrame, least: int = 3) -> DataFrame:
    """(lang, shard, base, size, transducer): transducers of the terms of ``least`` documents or more, by sorted ranges.

    ``base`` is the ordinal of a shard's first term in its language.
    """
    kept = frequencies.where(F.col("df") >= least).select("lang", "term")
    ranges = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms = None, []

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([terms[0].decode()]), pa.array([len(terms)], pa.int64()), pa.array([Transducer.build(terms).dumps()], pa.binary())], names=["lang", "first", "size", "transducer"])

        for batch in batches:
            for own, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if terms and (own != lang or len(terms) >= SHARD_TERMS):
                    yield shard()
                    terms = []
                lang = own
                terms.append(term.encode())
        if terms:
            yield shard()

    shards = ranges.mapInArrow(build, "lang string, first string, size long, transducer binary")
    shards = written(shards)
    order = Window.partitionBy("lang").orderBy("first")  # a row for each 32,768 terms, without the transducers
    placed = shards.select("lang", "first", "size").select("lang", "first", F.row_number().over(order).alias("shard"), (F.sum("size").over(order) - F.col("size")).alias("base"))
    out = written(shards.join(placed, ["lang", "first"]).select("lang", "shard", "base", "size", "transducer"))
    dropped(shards)
    return out


def rounds(spark: SparkSession, vocabulary: DataFrame, size: int) -> Iterator:
    """Broadcasts of the transducers of some shards, ``size`` bytes at most at a time (one shard at least)."""
    sizes = vocabulary.select("lang", "shard", F.octet_length("transducer").alias("n")).orderBy("lang", "shard").toLocalIterator()  # numbers only
    groups, room = [], 0
    for r in sizes:
        if not groups or room + r["n"] > size:
            groups.append([])
            room = 0
        groups[-1].append((r["lang"], r["shard"]))
        room += r["n"]
    for group in groups:
        low, high = group[0], group[-1]
        between = F.struct("lang", "shard").between(F.struct(F.lit(low[0]).alias("lang"), F.lit(low[1]).alias("shard")), F.struct(F.lit(high[0]).alias("lang"), F.lit(high[1]).alias("shard")))
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["lang"], r["base"], bytes(r["transducer"])) for r in vocabulary.where(between).collect()]))


@dataclass
class Shards:
    """Transducers of one language in order, with the first eight bytes of the first term of each."""

    bases: list[int]
    parts: list[Transducer]
    heads: np.ndarray

    def ordinals(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each word its ordinal in the language, or -1; a word goes to the shards that its first bytes allow, mostly one."""
        head = np.zeros(len(starts), np.uint64)
        for i in range(8):
            inside = lengths > i
            letter = np.zeros(len(starts), np.uint64)
            letter[inside] = text[starts[inside] + i]
            head = head << np.uint64(8) | letter
        high, low = np.searchsorted(self.heads, head, side="right") - 1, np.searchsorted(self.heads, head, side="left") - 1
        out = np.full(len(starts), -1, np.int64)
        order = np.argsort(high, kind="stable")
        edges = np.searchsorted(high[order], np.arange(len(self.parts) + 1))
        wide = np.flatnonzero(low < high)
        for j, (base, part) in enumerate(zip(self.bases, self.parts)):
            mine = np.concatenate([order[edges[j] : edges[j + 1]], wide[(low[wide] <= j) & (j < high[wide])]])
            place = part.ordinals(text, starts[mine], lengths[mine])
            out[mine[place >= 0]] = place[place >= 0] + base
        return out

    def term(self, ordinal: int) -> str | None:
        for base, part in zip(self.bases, self.parts):
            if base <= ordinal < base + part.size:
                return part.term(ordinal - base).decode()
        return None


_LOADED: dict[str, dict[str, Shards]] = {}


def loaded(sent) -> dict[str, Shards]:  # noqa: ANN001
    """Each language's shards of a broadcast; a worker unpacks one broadcast once."""
    only("divergence")
    name, rows = sent.value
    if name not in _LOADED:
        _LOADED.clear()
        by_lang: dict[str, list] = {}
        for lang, base, data in sorted(rows):
            by_lang.setdefault(lang, []).append((base, Transducer.loads(data)))
        heads = lambda parts: np.array([int.from_bytes(t.term(0)[:8].ljust(8, b"\0"), "big") for _, t in parts], np.uint64)
        _LOADED[name] = {lang: Shards([b for b, _ in parts], [t for _, t in parts], heads(parts)) for lang, parts in by_lang.items()}
        remembers("divergence", _LOADED.clear)
    return _LOADED[name]


def recounted(docs: DataFrame, sent) -> DataFrame:  # noqa: ANN001
    """(lang, source, ordinal, n): occurrences of the terms of a broadcast; ``docs`` (lang, source, text).

    Equal words of a block go through their language's transducers once, with their number in each source.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = loaded(sent)
        names: dict[tuple[str, str], int] = {}
        langs: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def added() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            group, ordinal, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            first, total = added_up(n, group, ordinal)
            return [(group[first], ordinal[first], total)]

        def rows_of() -> pa.RecordBatch:
            ((group, ordinal, n),) = added()
            both = [pa.array([g[i] for g in names]).take(pa.array(group)) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*both, pa.array(ordinal), pa.array(n)], names=["lang", "source", "ordinal", "n"])

        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            groups = np.array([names.setdefault(g, len(names)) for g in pairs], np.int64)
            spoken = np.array([langs.setdefault(g[0], len(langs)) for g in pairs], np.int64)
            for low, high, part, starts, ends, hashes, rows in _blocks(batch):
                at, n = added_up(np.ones(len(rows), np.int64), spoken[low:high][rows], hashes, groups[low:high][rows])
                lang, word = spoken[low:high][rows[at]], hashes[at]
                new = np.concatenate([[True], (lang[1:] != lang[:-1]) | (word[1:] != word[:-1])]) if len(at) else np.zeros(0, bool)
                one, which = at[new], np.cumsum(new) - 1
                place = np.full(len(one), -1, np.int64)
                edges = np.searchsorted(lang[new], np.arange(len(langs) + 1))
                for name, i in langs.items():
                    if name in shards and edges[i] < edges[i + 1]:
                        mine = one[edges[i] : edges[i + 1]]
                        place[edges[i] : edges[i + 1]] = shards[name].ordinals(part, starts[mine], ends[mine] - starts[mine])
                hit = place[which] >= 0
                held.append((groups[low:high][rows[at]][hit], place[which][hit], n[hit]))
                size += int(hit.sum())
                if size >= 4 * HELD:
                    held = added()
                    size = len(held[0][0])
                    if size >= 2 * HELD:
                        yield rows_of()
                        held, size = [], 0
        if held:
            yield rows_of()

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, ordinal long, n long")


def decoded(rows: DataFrame, sent) -> DataFrame:  # noqa: ANN001
    """``rows`` (lang, ordinal, ...) with ``item``: the term of the ordinal, of those that a broadcast has."""
    schema = rows.withColumn("item", F.lit(None).cast("string")).schema
    at = rows.columns.index("ordinal")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = loaded(sent)
        for batch in batches:
            items = []
            for lang, p in zip(batch.column(batch.schema.get_field_index("lang")).to_pylist(), batch.column(at).to_pylist()):
                items.append(shards[lang].term(p) if lang in shards else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(items, pa.string())], names=schema.names)

    return rows.mapInArrow(decode, schema).where("item is not null")


# Exact arithmetic


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), three digits at a time so that 64 bits hold every step."""
    rest = count.astype(np.int64) + 1
    out, rest = np.divmod(rest, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def share_sql(count: str, total: str) -> str:
    """``share`` as an SQL expression over 64-bit columns."""
    step = lambda out, rest: (f"({out} * 1000 + ({rest} * 1000) div {total})", f"(({rest} * 1000) % {total})")
    out, rest = f"(({count} + 1) div {total})", f"(({count} + 1) % {total})"
    for _ in range(3):
        out, rest = step(out, rest)
    return f"({out} + 1)"


def tiles(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, s, o, value): of each two sources the summed divergence over all kept terms of their language.

    ``groups`` (lang, s, total, terms) numbers the sources of a language from 0, ``counts`` (lang, s,
    ordinal, n). A task compares up to 256 by 256 sources over 1,024 ordinals as two dense tables; each
    source is sent to a tile once a row or column of tiles, and only sums leave it.
    """
    per = groups.groupBy("lang").agg(F.max("s").alias("top"))
    per = F.broadcast(per) if per.limit(10_001).count() <= 10_000 else per  # a row a language
    wide = lambda df: df.join(per, "lang").withColumn("a", F.floor(F.col("s") / TILE_SOURCES))
    others = F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / TILE_SOURCES))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("terms") - 1) / TILE_TERMS))
    marks = wide(groups.where("terms > 0")).select("lang", "s", "a", "top", F.explode(blocks).alias("block"), F.lit(-1).cast("long").alias("ordinal"), F.col("total").alias("n"), "terms")
    rows = wide(counts).select("lang", "s", "a", "top", F.floor(F.col("ordinal") / TILE_TERMS).alias("block"), "ordinal", "n", F.lit(0).cast("long").alias("terms"))
    both = marks.union(rows).withColumn("other", F.explode(others))
    # a row stands for its source on the left of the tiles (a, other) and on the right of the tiles (other, a)
    left = both.select("lang", "block", F.col("a").alias("ta"), F.col("other").alias("tb"), F.lit(True).alias("left"), "s", "ordinal", "n", "terms")
    right = both.select("lang", "block", F.col("other").alias("ta"), F.col("a").alias("tb"), F.lit(False).alias("left"), "s", "ordinal", "n", "terms")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        block, mark = int(frame["block"].iloc[0]), frame["ordinal"] < 0
        width = int(min(TILE_TERMS, frame.loc[mark, "terms"].iloc[0] - block * TILE_TERMS))

        def table(some: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            mine, cells = some[some["ordinal"] < 0], some[some["ordinal"] >= 0]
            ids = np.sort(mine["s"].to_numpy())
            total = mine.set_index("s")["n"].reindex(ids).to_numpy()
            n = np.zeros((len(ids), width), np.int64)
            n[np.searchsorted(ids, cells["s"].to_numpy()), cells["ordinal"].to_numpy() - block * TILE_TERMS] = cells["n"].to_numpy()
            return ids, share(n, total[:, None])

        (a, p), (b, q) = table(frame[frame["left"]]), table(frame[~frame["left"]])
        sums = np.stack([((x - q) ** 2 // q).sum(1) for x in p])
        i, j = np.nonzero(a[:, None] != b[None])
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "s": a[i], "o": b[j], "value": sums[i, j]})

    each = left.union(right).groupBy("lang", "block", "ta", "tb").applyInPandas(compare, "lang string, s long, o long, value long")
    return each.groupBy("lang", "s", "o").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 3, top: int = 200, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others of its language, and its ``top`` terms against the language.

    Null languages, sources and texts count as ''. Repeated rows are documents of their own. A source
    without terms is compared like any other; a language that keeps no term has value 0 for all pairs.
    Words of a block are told apart by 64-bit hashes; what is counted is what the transducers accept.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    vocabulary = build_vocabulary(document_frequencies(rows), least)
    counts = spark.createDataFrame([], "lang string, source string, ordinal long, n long")
    for sent in rounds(spark, vocabulary, round_bytes):
        counts = counts.union(written(recounted(rows, sent).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))))
        sent.destroy()
    terms = vocabulary.groupBy("lang").agg(F.sum("size").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = written(groups.select("lang", "source", numbered.cast("long").alias("s"), F.coalesce("total", F.lit(0)).alias("count"), F.coalesce("terms", F.lit(0)).alias("terms")).withColumn("total", F.col("count") + F.col("terms")))

    keyed = counts.join(groups.select("lang", "source", "s", "total"), ["lang", "source"])
    sums = tiles(groups.select("lang", "s", "total", "terms"), keyed.select("lang", "s", "ordinal", "n"))
    name = groups.select("lang", F.col("s").alias("o"), F.col("source").alias("item"))
    pairs = groups.select("lang", "source", "s").join(name, "lang").where("s <> o").join(sums, ["lang", "s", "o"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"), F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc(F.coalesce("value", F.lit(0))), "item")).alias("rank"))

    whole = groups.groupBy("lang").agg((F.sum("count") + F.first("terms")).alias("l_total"))
    at = keyed.withColumn("l_n", F.sum("n").over(Window.partitionBy("lang", "ordinal"))).join(whole, "lang")
    at = at.withColumns({"p": F.expr(share_sql("n", "total")), "q": F.expr(share_sql("l_n", "l_total"))}).where("p > q").withColumn("value", F.expr("((p - q) * (p - q)) div q"))
    best = at.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    best = written(best.select("lang", "source", "ordinal", "value", "rank"))
    out = pairs
    for sent in rounds(spark, vocabulary, round_bytes):
        out = out.union(written(decoded(best, sent).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")))
        sent.destroy()
    return out


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of every document against each other and their language, by the terms of three documents or more."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
cell AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS p FROM cell JOIN gn USING (lang, source) JOIN v USING (lang)),
l AS (SELECT lang, sum(total)::HUGEINT AS total FROM gn GROUP BY lang),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sn + 1)) // (total + v) AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS sn FROM c GROUP BY ALL) JOIN l USING (lang) JOIN v USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
