"""URL filters by association rules.

Spark's FP-growth mines combinations of URL tokens that go with labelled pages; rules that pass the
support, confidence and redundancy cuts are looked up by an inverted index on their rarest token.
A short list of explicit host and path rules comes first.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm._shared import salted_join, written

#: Fixed rules: host, path and verdict.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
BLOCK = "label=block"
#: Rules up to this many are broadcast; more are joined by a shuffle.
MAX_BROADCAST_RULES = 20_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and for a url without ``://``."""
    from_host = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(F.substring_index(F.substring_index(from_host, "#", 1), "?", 1), F.lit(""))
    host = F.translate(F.substring_index(rest, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.when(F.instr(rest, "/") > 0, F.substring(rest, F.instr(rest, "/"), F.length(rest))).otherwise(F.lit(""))


def explicit_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. A host fits with all its subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url: scheme, host parts, path parts by depth, query keys, fragment, ending."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    seen = F.transform(parts, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(x).cast("string"))).otherwise(x)))
    query = F.when(F.instr(url, "?") > 0, F.transform(F.split(F.substring_index(F.substring_index(url, "?", -1), "#", 1), "&"), lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_distinct(
        F.filter(
            F.concat(
                F.array(F.concat(F.lit("scheme="), F.substring_index(url, "://", 1))),
                F.transform(F.split(host, "\\."), lambda x: F.concat(F.lit("host="), x)),
                seen,
                query,
                F.array(F.when(F.instr(url, "#") > 0, F.lit("fragment")), F.when(path.rlike(r"\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("end="), F.substring_index(path, ".", -1)))),
            ),
            lambda x: x.isNotNull(),
        )
    )


def distinct_tokens(labelled: DataFrame, least: int) -> DataFrame:
    """The (id, tokens, bad) rows of ``labelled``, without tokens that can add no rule.

    Those on under ``least`` bad pages make no rule of that support; of tokens that stand on exactly the
    same pages (equal counts and sums of page hashes) the first one stays, so a page with many tokens of
    its own brings no powers of their number.
    """
    each = labelled.select("id", "bad", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"))
    kept = counts.where(F.col("n_bad") >= least).groupBy("n", "x", "s").agg(F.min("token").alias("token")).select("token")
    found = each.join(kept, "token").groupBy("id").agg(F.collect_set("token").alias("tokens"))  # tokens of one page
    return labelled.select("id", "bad").join(found, "id", "left").select("id", "bad", F.coalesce("tokens", F.expr("cast(array() as array<string>)")).alias("tokens"))


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, z: float = 1.96, min_count: int = 10, chance: float | None = None) -> DataFrame:
    """(antecedent, confidence, support) of rules for blocking, from rows (id, tokens, bad), an id a row.

    A rule holds for ``min_support`` of the pages, and for ``min_count``; at least ``min_confidence`` of
    them are bad, and so many that the lower bound of that share (Wilson's, ``z`` deviations) is over the
    share of bad pages in all. With ``chance``, z is such that labels without any pattern give a rule by
    no more than this chance over all sets of tokens that were tried (Bonferroni).
    """
    n, bad = labelled.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    least = max(min_support, min(1.0, min_count / max(n, 1))) * max(n, 1)
    rows = distinct_tokens(labelled, max(1, int(least * min_confidence)))
    baskets = rows.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(1e-12, least * min_confidence / max(n, 1)), minConfidence=min_confidence).fit(baskets)
    if chance is not None:
        tried = model.freqItemsets.where(~F.array_contains("items", BLOCK)).count()
        z = NormalDist().inv_cdf(1 - chance / 2 / max(tried, 1))
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK))
    share, pages = F.col("confidence"), F.col("support") * F.lit(float(rows.count())) / F.col("confidence")
    low = (share + z * z / (2 * pages) - z * F.sqrt(share * (1 - share) / pages + z * z / (4 * pages * pages))) / (1 + z * z / pages)
    return found.where((pages >= least - 0.5) & (low > bad / max(n, 1))).select("antecedent", "confidence", "support")


def prune(rules: list) -> list:
    """Without rules of which a smaller part of the tokens is as confident."""
    best: dict[frozenset, float] = {}
    for r in sorted(rules, key=lambda r: (len(r["antecedent"]), sorted(r["antecedent"]))):
        mine = frozenset(r["antecedent"])
        if len(mine) <= 12:
            parts = (best.get(frozenset(c)) for k in range(1, len(mine)) for c in combinations(mine, k))
        else:
            parts = (conf for part, conf in best.items() if part < mine)
        if not any(conf is not None and conf >= r["confidence"] for conf in parts):
            best[mine] = r["confidence"]
    return [(sorted(k), v) for k, v in best.items()]


def match_rules(urls: DataFrame, rules: DataFrame, small: bool) -> DataFrame:
    """(url, confidence): the urls of (url, tokens), each once, that have all tokens of a rule of (antecedent, confidence).

    The index has each rule once, under the token that the fewest urls have, so common tokens bring few
    candidates. ``small`` rules are broadcast.
    """
    near = F.broadcast if small else lambda df: df
    each = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    named = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    seen = each.join(near(named.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    index = named.join(seen, "token").groupBy("antecedent", "confidence").agg(F.count("*").alias("known"), F.min(F.struct("n", "token"))["token"].alias("token")).where(F.col("known") == F.size("antecedent"))
    met = each.join(near(index.select("token", "antecedent", "confidence")), "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return met.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, min_support: float = 0.002, min_confidence: float = 0.5, min_count: int = 10, chance: float | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, confidence) for every row of ``pages``.

    ``labels`` (doc_id, quality, toxic) label the pages of the same id: low quality or toxic is bad.
    The longest explicit rule decides; else a mined rule blocks and everything else is allowed. A
    null url, or one without ``://``, has an empty host and path and is allowed. Rows stay as they
    are, equal ones too; unlabelled pages take no part in mining; with no labels nothing is mined.
    ``confidence`` is that of the surest mined rule that fits, null if none does. ``chance`` is that of
    any rule from labels that have nothing to do with urls; None tests each rule on its own.
    """
    host, path = split_url(F.col("url"))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    known = base.where("url is not null and host <> ''").withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    truth = labels.select(F.col("doc_id").alias("id"), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad")).where("id is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    labelled = written(known.join(truth, "id").groupBy("id", "bad").agg(F.min(F.struct("url", "tokens"))["tokens"].alias("tokens")))
    mined = written(mine_rules(labelled, min_support, min_confidence, min_count=min_count, chance=chance))
    small = mined.count() <= MAX_BROADCAST_RULES
    if small:  # fewer rules with the same verdicts
        mined = pages.sparkSession.createDataFrame(prune(mined.collect()), "antecedent array<string>, confidence double")
    hits = match_rules(known.groupBy("url").agg(F.first("tokens").alias("tokens")), mined, small)
    out = salted_join(base, hits, "url", "id", "left").withColumn("r", explicit_rule(F.col("host"), F.col("path"), rules))
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence",
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the fixed rules, then by mined ones."""
    out = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), chance=0.05)
    return out.select("page_id", "host", "path", "rule", "verdict")
