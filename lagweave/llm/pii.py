"""Personal data by candidate generation and gradient boosting, in DataFrame functions only.

Generators of high recall propose overlapping spans. Boosted trees weigh the format of a candidate
and what stands around it; thresholds calibrated per kind select redactions. Spans that pass the
exact format checks (the base) always stay; of the others, candidates with evidence of format or
context and those that the trees select are added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagweave.llm._shared import dropped, salted_join, written

#: Kinds in the order of the base, then those that only the method finds.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Base patterns. Possessive runs and \G keep them linear and free of recursion; matches are the same.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further generators of high recall.
MORE = (
    ("email", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,20})+"),
    ("phone", r"(?<![0-9+])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
    ("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+"),
)
#: What a text with a match of each generator has, found sooner than the match: a character, or a short pattern.
NEEDS = ("@", r"[0-9]\.[0-9]++\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){11}", "+", r"(?i)[(\[]at[)\]]", r"[0-9]\)?[ .-][0-9]{3,4}[ .-][0-9]{3}", "[0-9]")
CONTEXT = 24
#: Words near personal data, by kind.
HINTS = {
    "h_mail": "mail|contact|write to",
    "h_phone": "tel|phone|call|mobile|fax",
    "h_card": "card|visa|account|iban|payment",
    "h_secret": "token|password|passwd|secret|api.?key|credential",
}
#: Formats that are personal data wherever they stand: obfuscated addresses, national numbers, issued keys.
FORMATS = {
    "email": r"(?i)[(\[]dot[)\]]|\.(?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|nl|ch|uk|ru)$",
    "phone": r"^(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[ .-][2-9][0-9]{2}[ .-][0-9]{4}$",
    "secret": r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})$",
}
FEATURES = ("kind", "n", "digits", "letters", "uppers", "marks", "spaces", "dots", "hexes", "at", "plus", "luhn", "octets", "assigned", "quoted", "touches_left", "touches_right", *HINTS)


HIT = "struct<gen:int,nth:int,gap:int,size:int,match:string,left:string,right:string>"
SPAN = "struct<start:int,kind_no:int,end:int>"
NONE = f"cast(array() as array<{SPAN}>)"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(back, F.lit(0), lambda a, d: a + d) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, "\\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def evident(kind: str, x: Callable[[str], Column]) -> Column:
    """Whether a candidate, given by its columns, shows by its format or a word before it that it is of its kind."""
    if kind == "ip":
        return F.lit(False)  # beyond the exact check there is none
    n = F.length(F.regexp_replace(x("match"), "[^0-9]", ""))
    near = F.lower(x("left")).rlike(HINTS[f"h_{'mail' if kind == 'email' else kind}"])
    if kind == "card":
        return near & n.between(12, 19)
    if kind == "phone":
        near = near & n.between(7, 15)
    return near | x("match").rlike(FORMATS[kind])


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, hits): the leftmost non-overlapping matches of all generators, in one pass over the texts.

    A hit has its generator and number, the code points from the match before it (``gap``), its own
    (``size``), and what stands around it. A text without any has a null ``text_key``.
    """
    patterns = [*BASE.values(), *(p for _, p in MORE)]
    text = F.col("text")
    has = [F.instr(text, need) > 0 if len(need) == 1 else text.rlike(need) for need in NEEDS]
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.withColumns({f"f_{i}": F.when(has[i], F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1))) for i, p in enumerate(patterns)})

    def hits(i: int, pattern: str) -> Column:
        found, gaps = F.col(f"f_{i}"), F.split(text, pattern, -1)
        around = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), F.slice(gaps, 2, F.size(found)).alias("h"))
        each = F.transform(around, lambda x, n: F.struct(F.lit(i).alias("gen"), n.alias("nth"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), x["m"].alias("match"), F.right(x["g"], F.lit(CONTEXT)).alias("left"), F.left(x["h"], F.lit(CONTEXT)).alias("right")))
        return F.when(F.size(found) > 0, each).otherwise(F.expr(f"cast(array() as array<{HIT}>)"))

    some = F.greatest(*[F.coalesce(F.size(f"f_{i}"), F.lit(0)) for i in range(len(patterns))]) > 0
    every = F.concat(*[hits(i, p) for i, p in enumerate(patterns)])
    return out.select("id", F.when(some, F.sha2("text", 256)).alias("text_key"), F.when(some, every).alias("hits"))


def candidates(found: DataFrame) -> DataFrame:
    """(text_key, gen, kind_no, start, end, match, left, right, valid, over, ok), one row a hit of each distinct text.

    ``valid`` hits are the base. Others are ``over`` where they overlap a base span, and ``ok`` where
    that span is of their kind or their format or context is evidence. Places are running sums and
    overlaps are running extremes in order of the start, so the work is linear in a text's hits.
    """
    kinds = [*BASE, *(k for k, _ in MORE)]
    each = found.where("text_key is not null").groupBy("text_key").agg(F.first("hits").alias("hits")).select("text_key", F.explode("hits").alias("h")).select("text_key", "h.*")
    so_far = Window.partitionBy("text_key", "gen").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int")).withColumn("start", F.col("end") - F.col("size"))
    by_gen = lambda columns: F.coalesce(*[F.when(F.col("gen") == i, c) for i, c in enumerate(columns)])
    each = each.withColumns({"kind_no": by_gen([F.lit(KINDS.index(k)) for k in kinds]), "valid": by_gen([passes(k, F.col("match")) for k in BASE] + [F.lit(False)] * len(MORE)), "shown": by_gen([evident(k, F.col) for k in kinds])})

    def meets(*keys: str) -> Column:
        before = Window.partitionBy(*keys).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
        after = Window.partitionBy(*keys).orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
        return F.coalesce(F.max(F.when(F.col("valid"), F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(F.col("valid"), F.col("start"))).over(after) < F.col("end"), F.lit(False))

    each = each.withColumn("over", meets("text_key")).withColumn("ok", F.col("shown") | meets("text_key", "kind_no"))
    return each.select("text_key", "gen", "kind_no", "start", "end", "match", "left", "right", "valid", "over", "ok")


def featured(rows: DataFrame) -> DataFrame:
    """``candidates`` with the columns FEATURES and ``label``."""
    m, left = F.col("match"), F.lower("left")
    count = lambda pattern: F.length(F.regexp_replace(m, f"[^{pattern}]", "")).cast("double")
    digits = F.regexp_replace(m, "[^0-9]", "")
    columns = {
        "kind": F.col("kind_no").cast("double"), "n": F.length(m).cast("double"), "digits": count("0-9"), "letters": count("A-Za-z"), "uppers": count("A-Z"),
        "marks": count("()/_-"), "spaces": count(" "), "dots": count("."), "hexes": count("a-f"), "at": count("@"), "plus": count("+"),
        "luhn": F.when(F.length(digits).between(12, 19), luhn(digits).cast("double")).otherwise(-1.0),
        "octets": F.when(m.rlike(r"^[0-9]+(\.[0-9]+){3}$"), passes("ip", m).cast("double")).otherwise(-1.0),
        "assigned": left.rlike("[=:] ?[\"']?$").cast("double"), "quoted": left.rlike("[\"']$").cast("double"),
        "touches_left": left.rlike("[a-z0-9]$").cast("double"), "touches_right": F.lower("right").rlike("^[a-z0-9]").cast("double"),
        "label": F.col("ok").cast("double"),
    }
    return rows.withColumns(columns | {k: left.rlike(v).cast("double") for k, v in HINTS.items()})


def select_more(rows: DataFrame, max_rows: int = 20_000, precision: float = 0.95, trees: int = 8, depth: int = 3) -> DataFrame:
    """(text_key, start, kind_no, end): of ``featured`` candidates off the base, those with evidence and those that the trees find like them.

    The trees are fitted on at most ``max_rows`` candidates of each kind and label, those with the
    smallest hashes, all groups weighing the same. Labels are evidence of format or context; what
    overlaps the base counts only where it is of the base span's kind, never as a negative. A kind's
    threshold is the lowest probability from which, over all held-out candidates that could be added,
    the share of label 1 is at least ``precision``; a kind with no label 1 there uses all candidates.
    With one class only the evidence selects. Of overlapping ones the likeliest of their run stays,
    and what doesn't touch it.
    """
    half = F.pmod(F.xxhash64("text_key"), F.lit(2))

    place = F.xxhash64("text_key", "start", "kind_no")
    part = F.shiftrightunsigned(place, 54).cast("int")

    def drawn(some: DataFrame) -> tuple[DataFrame, dict[tuple[float, float], int]]:
        some = some.where("not over or label = 1")
        # parts of the hashes from below until a group has enough: only so many rows meet in a group's sort
        sizes = some.groupBy("kind_no", "label", part.alias("part")).agg(F.count("*").alias("n")).collect()  # at most 1,024 a kind and label
        last: dict[tuple[int, float], tuple[int, int]] = {}
        for r in sorted(sizes, key=lambda r: r["part"]):
            top, n = last.get((r["kind_no"], r["label"]), (-1, 0))
            if n < max_rows:
                last[r["kind_no"], r["label"]] = (r["part"], n + r["n"])
        low = F.coalesce(*[F.when((F.col("kind_no") == k) & (F.col("label") == y), top) for (k, y), (top, _) in sorted(last.items())], F.lit(-1))
        by = Window.partitionBy("kind_no", "label").orderBy("part", place, "text_key", "start", "end")
        few = some.withColumn("part", part).where(F.col("part") <= low).withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= max_rows)
        few = written(few.select("label", *FEATURES))
        return few, {(r["kind"], r["label"]): r["n"] for r in few.groupBy("kind", "label").agg(F.count("*").alias("n")).collect()}

    sample, sizes = drawn(rows.where(half == 0))
    if len({y for _, y in sizes}) < 2:
        dropped(sample)
        sample, sizes = drawn(rows)
    open_rows = rows.where("not over")
    kept = ["text_key", "start", "kind_no", "end", "label"]
    if len({y for _, y in sizes}) < 2:
        scored = open_rows.select(*kept, F.col("label").alias("p"))
    else:
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        mean = sum(sizes.values()) / len(sizes)
        weight = F.coalesce(*[F.when((F.col("kind") == k) & (F.col("label") == y), F.lit(mean / n)) for (k, y), n in sorted(sizes.items())])
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, labelCol="label", weightCol="weight").fit(assemble.transform(sample.withColumn("weight", weight)))
        scored = model.transform(assemble.transform(open_rows)).select(*kept, vector_to_array("probability")[1].alias("p"))
    scored = written(scored)
    bins = scored.groupBy("kind_no", (half == 1).alias("held"), F.floor(F.col("p") * 50).alias("bin")).agg(F.sum("label").alias("yes"), F.count("*").alias("n")).collect()  # at most 102 a kind
    cut = {}
    for k in range(len(KINDS)):
        mine = [r for r in bins if r["kind_no"] == k]
        held = [r for r in mine if r["held"]]
        merged: dict[int, tuple[float, int]] = {}
        for r in held if any(r["yes"] for r in held) else mine:
            yes, n = merged.get(r["bin"], (0.0, 0))
            merged[r["bin"]] = (yes + r["yes"], n + r["n"])
        cut[k] = threshold([(b, yes, n) for b, (yes, n) in merged.items()], precision)
    limit = F.element_at(F.array(*[F.lit(cut[k]) for k in range(len(KINDS))]), F.col("kind_no") + 1)
    chosen = runs(scored.where((F.col("p") >= limit) | (F.col("label") == 1)).groupBy("text_key", "start", "kind_no", "end").agg(F.max("p").alias("p")))
    rank = F.struct("p", F.col("end") - F.col("start"), -F.col("start"), -F.col("kind_no"))
    best = F.max(F.struct(rank.alias("rank"), "start", "end", "kind_no")).over(Window.partitionBy("text_key", "run"))
    chosen = chosen.withColumn("best", best)
    apart = (F.col("start") >= F.col("best.end")) | (F.col("end") <= F.col("best.start"))
    return chosen.where(apart | (rank == F.col("best.rank"))).select("text_key", "start", "kind_no", "end")


def runs(spans: DataFrame) -> DataFrame:
    """``spans`` (text_key, start, end, ...) with ``run``: the number of the chain of overlaps that each lies in."""
    order = Window.partitionBy("text_key").orderBy("start", "end", "kind_no")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("new", F.when(reach > F.col("start"), 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def threshold(bins: list[tuple[int, float, int]], precision: float) -> float:
    """The lowest bin from which on the share of label 1 is at least ``precision``; over 1 if none."""
    yes = n = 0.0
    best = 2.0
    for b, y, c in sorted(bins, reverse=True):
        yes, n = yes + y, n + c
        if yes >= precision * n:
            best = b / 50
    return best


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, base, spans) for every row: arrays of struct(start, kind_no, end) by start, then kind.

    ``text_key`` is the SHA-256 of a text with proposals, else null.

    ``spans`` are the base and what the method adds. Null and empty texts have none; equal texts get
    equal spans; ids may repeat or be null; other columns are ignored.
    """
    found = written(scan(docs, id_col, text_col))
    rows = written(featured(candidates(found)))
    more = select_more(rows)
    base = rows.where("valid").select("text_key", "start", "kind_no", "end", F.lit(True).alias("valid"))
    span = F.struct(F.col("start"), F.col("kind_no"), F.col("end"))
    spans = base.union(more.withColumn("valid", F.lit(False))).groupBy("text_key").agg(F.sort_array(F.collect_list(F.when(F.col("valid"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("spans"))  # of one text
    lists = [F.coalesce(c, F.expr(NONE)).cast(f"array<{SPAN}>").alias(c) for c in ("base", "spans")]
    bare = found.where("text_key is null").select("id", "text_key", F.expr(NONE).alias("base"), F.expr(NONE).alias("spans"))
    rich = salted_join(found.where("text_key is not null").select("id", "text_key"), spans, "text_key", "id", "left").select("id", "text_key", *lists)
    return bare.union(rich).withColumnRenamed("id", id_col)


#: Texts with spans up to this many are broadcast to the documents; more are joined by a shuffle.
MAX_BROADCAST_TEXTS = 100_000
#: Spans of a text beyond which, and code points by which, it is rewritten in parts.
MANY_SPANS, PART = 64, 4096


def rewritten(text: Column, cuts: str) -> Column:
    """``text`` with each of its ``cuts`` (start, end, mark), which don't overlap, replaced by the mark."""
    ends = F.transform(cuts, lambda x: x["end"])
    begins = F.concat(F.array(F.lit(0)), ends)
    parts = F.transform(F.arrays_zip(F.col(cuts).alias("c"), F.slice(begins, 1, F.size(cuts)).alias("b")), lambda x: F.concat(F.substring(text, x["b"] + 1, x["c"]["start"] - x["b"]), x["c"]["mark"]))
    return F.concat(F.concat_ws("", parts), F.substring(text, F.element_at(cuts, -1)["end"] + 1, F.length(text)))


def in_parts(texts: DataFrame, cuts: DataFrame) -> DataFrame:
    """(_key, _clean): ``texts`` (_key, text) with their ``cuts`` (_key, start, end, mark) replaced, part by part.

    A substring is searched from the text's start, so many cuts in a long text would take time by its square.
    """
    pieces = texts.select("_key", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{PART}}})"), F.lit(1))).alias("part", "piece"))
    spread = cuts.select("*", F.explode(F.sequence(F.floor(F.col("start") / PART), F.floor((F.col("end") - 1) / PART))).alias("part"))
    low, high = F.greatest(F.col("start") - F.col("part") * PART, F.lit(0)), F.least(F.col("end") - F.col("part") * PART, F.lit(PART))
    clipped = spread.select("_key", F.col("part").cast("int").alias("part"), low.cast("int").alias("start"), high.cast("int").alias("end"), F.when(F.col("start") >= F.col("part") * PART, F.col("mark")).otherwise("").alias("mark"))
    lists = clipped.groupBy("_key", "part").agg(F.sort_array(F.collect_list(F.struct("start", "end", "mark"))).alias("cuts"))  # of one part
    done = pieces.join(lists, ["_key", "part"], "left").select("_key", "part", F.when(F.col("cuts").isNull(), F.col("piece")).otherwise(rewritten(F.col("piece"), "cuts")).alias("piece"))
    return done.groupBy("_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]), "").alias("_clean"))


def redact(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of its text replaced by [KIND]; ``found`` comes from find_private.

    Overlapping spans are merged under the first one's kind. Texts without spans, nulls and all
    other columns stay as they are.
    """
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    some = found.where(F.size("spans") > 0).groupBy("text_key").agg(F.first("spans").alias("spans"))
    merged = runs(some.select("text_key", F.explode("spans").alias("s")).select("text_key", "s.*")).groupBy("text_key", "run").agg(F.min(F.struct("start", "end", "kind_no")).alias("first"), F.max("end").alias("end"))
    cuts = written(merged.select(F.col("text_key").alias("_key"), F.col("first.start").alias("start"), "end", F.element_at(kinds, F.col("first.kind_no") + 1).alias("mark")))
    lists = written(cuts.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "mark"))).alias("_cuts")))  # of one text
    many = lists.where(F.size("_cuts") > MANY_SPANS).select("_key")
    few = lists.where(F.size("_cuts") <= MANY_SPANS)
    n_many, n_few = many.count(), few.count()
    near = lambda df, n: F.broadcast(df) if n <= MAX_BROADCAST_TEXTS else df
    key = F.sha2(docs[text_col], 256)
    rest = docs.join(near(many, n_many), key == many["_key"], "left_anti") if n_many else docs
    out = rest.join(near(few, n_few), key == few["_key"], "left")
    out = out.withColumn(text_col, F.when(F.col("_cuts").isNotNull(), rewritten(F.col(text_col), "_cuts")).otherwise(F.col(text_col))).select(*docs.columns)
    if n_many:
        those = docs.withColumn("_key", key).join(near(many, n_many), "_key", "left_semi").withColumn("_row", F.monotonically_increasing_id())
        texts = those.groupBy("_key").agg(F.first(text_col).alias("text"))
        out = out.union(salted_join(those, in_parts(texts, cuts.join(many, "_key")), "_key", "_row").withColumn(text_col, F.col("_clean")).select(*docs.columns))
    return out


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind_no"] + 1), x["start"], x["end"])), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts and digest, and all spans."""
    out = find_private(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of_kind = lambda no: F.size(F.filter("base", lambda x: x["kind_no"] == no)).cast("long")
    counts = {f"n_{k}": of_kind(no) for no, k in enumerate(KINDS[:4])}
    counts |= {"n_spans": F.size("spans").cast("long"), "n_added": (F.size("spans") - F.size("base")).cast("long")}
    return out.withColumns(counts).select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
