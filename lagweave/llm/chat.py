"""Chat formatting by quotation linking, in DataFrame functions only.

Messages may quote earlier ones in lines with ``>`` marks, nested to any level. Quoted passages are
normalised, hashed and joined to the messages, paragraphs and lines they came from; that gives each
message the one it answers. Conversations are then written in reply order, without the linked quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagweave.llm._shared import dropped, written

QUOTED = r"(?:^|\n) ?>"
PREFIX = r"^((?: ?>)+) ?(.*)$"
#: Turns of a conversation that one task orders, and messages of one result row.
SPAN, BLOCK = 256, 64
#: Pieces that the messages of one turn are dealt to.
DEAL = 64
#: The branch of a conversation's first messages.
ROOT = -(1 << 62)


def normal(text: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def units(text: Column) -> Column:
    """array<struct<rank, hash>> of a text: itself (3), its paragraphs (2) and its lines (1)."""

    def hashed(parts: Column, rank: int) -> Column:
        return F.transform(F.filter(F.transform(parts, normal), lambda x: x != ""), lambda x: F.struct(F.lit(rank).alias("rank"), F.xxhash64(x).alias("hash")))

    return F.concat(hashed(F.array(text), 3), hashed(F.split(text, r"\n\s*\n"), 2), hashed(F.split(text, "\n"), 1))


def joined(texts: str) -> Column:
    """The collected (pos, text) of a group as lines."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", texts))), lambda x: x[texts]), "\n")


def parse(messages: DataFrame) -> DataFrame:
    """(id, run, level, text, raw) of messages (id, text) with quotes: runs of lines of one quote level, 0 being the message's own.

    ``text`` is without the marks, ``raw`` with them.
    """
    lines = messages.where(F.col("text").rlike(QUOTED)).select("id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    level = F.length(F.replace(F.regexp_extract("raw", PREFIX, 1), F.lit(" "), F.lit("")))
    lines = lines.withColumn("level", level).withColumn("line", F.when(F.col("level") > 0, F.regexp_extract("raw", PREFIX, 2)).otherwise(F.col("raw")))
    order = Window.partitionBy("id").orderBy("pos")
    new = F.when(F.lag("level").over(order) == F.col("level"), 0).otherwise(1)
    lines = lines.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return lines.groupBy("id", "run", "level").agg(joined("line").alias("text"), joined("raw").alias("raw"))


def earlier(rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, tuple[str, Column]], inclusive: bool = False, later: bool = False) -> DataFrame:
    """``rows`` with running columns: name -> (``sum``, ``max`` or ``min``, of what) over the rows of a group before each, or later.

    Groups (``keys``) are cut into spans of ``SPAN`` turns; what a span takes over from the others is
    carried, so that no task orders more than a span. An empty sum is null.
    """
    kind = {"sum": F.sum, "max": F.max, "min": F.min}
    both = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "max": F.greatest, "min": F.least}
    rows = rows.withColumn("span", F.floor(F.col("turn") / SPAN))
    turned = [F.desc(c) if later else F.asc(c) for c in order]
    inside = Window.partitionBy(*keys, "span").orderBy(*turned).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    over = Window.partitionBy(*keys).orderBy(F.desc("span") if later else F.asc("span")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "span").agg(*[kind[k](c).alias(name) for name, (k, c) in columns.items()])
    carried = sums.select(*keys, "span", *[kind[k](name).over(over).alias(f"{name}_carried") for name, (k, _) in columns.items()])
    out = rows.withColumns({name: kind[k](c).over(inside) for name, (k, c) in columns.items()}).join(carried, [*keys, "span"])
    return out.withColumns({name: both[k](F.col(name), F.col(f"{name}_carried")) for name, (k, _) in columns.items()}).drop("span", *[f"{name}_carried" for name in columns])


def linked_units(messages: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, c, turn, run, level, rank, hash, source): the units of quoted passages, with the latest earlier turn that said each.

    Each unit looks only for its latest earlier source, by one ordered pass over its hash, so common
    lines make no pairs.
    """
    asked = passages.where("level > 0").select("id", "run", "level", F.explode(units(F.col("text"))).alias("u")).select("id", "run", "level", "u.*").distinct()
    asked = asked.join(messages.select("id", "c", "turn"), "id")
    own = passages.where("level = 0").groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]), "\n").alias("own"))
    quoting = passages.select("id").distinct().join(own, "id", "left").join(messages.select("id", "c", "turn"), "id")
    said = messages.where(~F.col("text").rlike(QUOTED)).select("c", "turn", F.col("text").alias("own")).union(quoting.select("c", "turn", F.coalesce("own", F.lit(""))))
    talks = asked.select("c").distinct()
    said = said.join(talks, "c", "left_semi").select("c", "turn", F.explode(units(F.col("own"))).alias("u")).select("c", "turn", "u.hash")
    said = said.join(asked.select("c", "hash").distinct(), ["c", "hash"], "left_semi").distinct()
    turns = said.select("c", "hash", "turn", F.lit(1).alias("kind")).union(asked.select("c", "hash", "turn", F.lit(0)).distinct())
    found = earlier(turns, ["c", "hash"], ["turn", "kind"], {"source": ("max", F.when(F.col("kind") == 1, F.col("turn")))}).where("kind = 0").select("c", "hash", "turn", "source")
    return asked.join(found, ["c", "hash", "turn"])


def tour_starts(events: DataFrame, totals: DataFrame) -> DataFrame:
    """(c, br, side, begins): how many messages come before each element of the tours of linked conversations.

    A tour goes down into a branch (side 0) and up out of it (side 1); an element carries the messages of
    the branch around it since the last one. Places are suffix sums by pointer doubling: a round is one
    join of rows of a fixed size, and their number grows with the logarithm of a tour's length.
    """
    child = events.where("kind = 1")
    first = child.groupBy("c", "br").agg(F.min(F.struct("turn", "child"))["child"].alias("first"))
    down = child.select("c", F.col("child").alias("br"), F.lit(0).alias("side"), (F.col("upto") - F.coalesce("since", F.lit(0))).alias("sum"))
    down = down.join(first, ["c", "br"], "left").select("c", "br", "side", "sum", F.coalesce("first", "br").alias("to_br"), F.when(F.col("first").isNull(), 1).otherwise(0).alias("to_side"))
    ends = events.groupBy("c", "br").agg((F.sum("n") - F.coalesce(F.max(F.when(F.col("kind") == 1, F.col("upto"))), F.lit(0))).alias("sum"))
    after = child.select("c", F.col("child").alias("br"), F.coalesce("next.child", "br").alias("to_br"), F.when(F.col("next").isNull(), 1).otherwise(0).alias("to_side"))
    up = ends.join(after, ["c", "br"], "left").select("c", "br", F.lit(1).alias("side"), "sum", "to_br", "to_side")
    tour = written(down.union(up))
    while tour.where("to_br is not null").limit(1).count():
        ahead = tour.select("c", F.col("br").alias("to_br"), F.col("side").alias("to_side"), F.col("sum").alias("more"), F.col("to_br").alias("next_br"), F.col("to_side").alias("next_side"))
        more = written(tour.join(ahead, ["c", "to_br", "to_side"], "left").select("c", "br", "side", (F.col("sum") + F.coalesce("more", F.lit(0))).alias("sum"), F.col("next_br").alias("to_br"), F.col("next_side").alias("to_side")))
        dropped(tour)
        tour = more
    return tour.join(totals, "c").select("c", "br", "side", (F.col("total") - F.col("sum")).alias("begins"))


def reply_order(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, parent, position, n_quotes) for every row, without a group in one task.

    A message answers the earlier turn that its quotes come from: the least deep quote level that is
    linked counts, there a whole message more than a paragraph, that more than a line, then the number of
    matching units; of equal ones the latest turn. A linked message opens a branch behind its parent;
    later unlinked ones continue that branch. ``position`` numbers a conversation's messages from 0 in
    that order. A quoted passage is left out of ``body`` if it, or each of its lines, is linked; messages
    without linked quotes stay as they are. Messages without a link answer the one before. Null roles are
    'unknown', null turns -1, null texts empty; null conversations are one of their own; rows of one
    turn are ordered by a hash, role and text, and equal rows stay as rows. Other columns are ignored.
    """
    c = F.coalesce(F.concat(F.lit("k"), F.col("conv_id").cast("string")), F.lit("n")).alias("c")
    raw = messages.select("conv_id", c, F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = written(raw.groupBy("c", "conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    passages = written(parse(said.select("id", "text")))
    found = written(linked_units(said, passages))
    by_source = found.where("source is not null").groupBy("c", "turn", "id", "level", "source").agg(F.max("rank").alias("rank"), F.count_distinct("hash").alias("hits"))
    parents = by_source.groupBy("c", "turn").agg(F.max(F.struct(-F.col("level"), "rank", "hits", "source"))["source"].alias("parent"))
    has = F.col("source").isNotNull()
    out = found.groupBy("id", "run").agg(F.max(F.when(F.col("rank") == 3, has).otherwise(F.lit(False))).alias("whole"), F.min(F.when(F.col("rank") == 1, has).otherwise(F.lit(True))).alias("lines")).where("whole or lines").select("id", "run", F.lit(True).alias("out"))
    kept = passages.join(out, ["id", "run"], "left").groupBy("id").agg(
        F.count(F.when(F.col("level") > 0, 1)).alias("n_quotes"), F.coalesce(F.max("out"), F.lit(False)).alias("some"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("out").isNull(), F.struct("run", "raw")))), lambda x: x["raw"]), "\n").alias("rest"),
    )
    rest = F.regexp_replace(F.regexp_replace("rest", r"^(?:[ \t\r]*+\n)++", ""), r"\s++$", "")

    turns = said.groupBy("c", "turn").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).join(parents, ["c", "turn"], "left")
    opens = F.when(F.col("parent").isNotNull(), F.col("turn"))
    placed = earlier(turns, ["c"], ["turn"], {"previous": ("max", F.col("turn")), "opened": ("max", opens)})
    placed = written(placed.select("c", "turn", "n", "kinds", "parent", "previous", F.coalesce(opens, "opened", F.lit(ROOT)).alias("br")))
    opened = placed.where("parent is not null").select("c", F.col("parent").alias("turn"), F.col("turn").alias("child")).join(placed.select("c", "turn", "br"), ["c", "turn"])
    events = placed.select("c", "br", "turn", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("child"), "n").union(opened.select("c", "br", "turn", F.lit(1), "child", F.lit(0).cast("long")))
    order = ["turn", "kind", "child"]
    events = earlier(events, ["c", "br"], order, {"upto": ("sum", F.col("n"))}, inclusive=True)
    is_child = F.col("kind") == 1
    events = earlier(events, ["c", "br"], order, {"since": ("max", F.when(is_child, F.col("upto")))})
    events = written(earlier(events, ["c", "br"], order, {"next": ("min", F.when(is_child, F.struct("turn", "child")))}, later=True))
    talks = placed.where("parent is not null").select("c").distinct()
    totals = placed.join(talks, "c", "left_semi").groupBy("c").agg(F.sum("n").alias("total"))
    begins = tour_starts(events.join(talks, "c", "left_semi"), totals)
    own = events.where("kind = 0").select("c", "turn", F.coalesce("next.child", "br").alias("br"), F.when(F.col("next").isNull(), 1).otherwise(0).alias("side"), (F.col("upto") - F.col("n") - F.coalesce("since", F.lit(0))).alias("rank"))
    starts = own.join(begins, ["c", "br", "side"], "left").select("c", "turn", (F.col("rank") + F.coalesce("begins", F.lit(0))).alias("start"))

    several = said.join(placed.where("kinds > 1").select("c", "turn"), ["c", "turn"], "left_semi").select("id", "c", "turn", "role", "text", "n", F.pmod(F.xxhash64("role", "text"), F.lit(DEAL)).alias("deal"))
    among = Window.partitionBy("c", "turn", "deal").orderBy("role", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("c", "turn").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    dealt = several.groupBy("c", "turn", "deal").agg(F.sum("n").alias("n")).select("c", "turn", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    shifts = several.withColumn("among", F.coalesce(F.sum("n").over(among), F.lit(0))).join(dealt, ["c", "turn", "deal"]).select("id", (F.col("among") + F.col("ahead")).alias("shift"))

    where = placed.select("c", "turn", F.coalesce("parent", "previous").alias("parent")).join(starts, ["c", "turn"])
    full = said.join(where, ["c", "turn"]).join(shifts, "id", "left").join(kept, "id", "left")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")
    full = full.select("conv_id", "turn", "role", F.when(F.col("some"), rest).otherwise(F.col("text")).alias("body"), "parent", (F.col("start") + F.coalesce("shift", F.lit(0))).alias("at"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), copies)
    return full.select("conv_id", "turn", "role", "body", "parent", (F.col("at") + F.col("copy")).alias("position"), "n_quotes")


def conversations(ordered: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, n_messages, text): conversations in reply order, ``block`` messages a row."""
    piece = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"), F.lit("<|end|>\n")).alias("piece")
    each = ordered.select("conv_id", "position", piece).groupBy("conv_id", F.floor(F.col("position") / block).alias("block")).agg(F.count("*").alias("n_messages"), F.sort_array(F.collect_list(F.struct("position", "piece"))).alias("pieces"))
    return each.select("conv_id", "block", "n_messages", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in reply order, without quotes."""
    return conversations(reply_order(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
