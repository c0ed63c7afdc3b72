"""Search against a plain scorer, and signatures that never underestimate."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lagweave.llm import search

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        found = []
        for i, b in bags:
            m = 75 + (25 * sum(b.values()) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t in terms(text))
            found += [(-score, i is None, i or 0, i)] if score > 0 else []
        out += [(item, n, f[3], -f[0]) for n, f in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(map(str, out))


def corpus(n=300):
    r = random.Random(7)
    words = [f"w{i}" for i in range(200)] + ["é天", "The", "the", "A1"]
    text = lambda m: " ".join(r.choice(words[: r.randint(3, len(words))]) for _ in range(m))
    docs = [(i, text(r.choice([0, 1, 5, 30, 200]))) for i in range(n)]
    docs += [(1000 + i, docs[4][1] + " w1 w2 w3") for i in range(60)] + [(5, "again the same id"), (None, "w5 w6 w7 w8"), (7, None), (8, ""), (9, "w9 " * 3000), (9, "w9 " * 3000), (10, "x" * 50_000)]
    items = [(i, text(r.randint(1, 25))) for i in range(12)] + [(50, None), (51, ""), (52, "!?"), (53, "unheard of"), (54, "w9 w9 w9 W9"), (54, "w9 w9 w9 W9"), (55, "w1 w2 w3"), (None, "the the A1"), (54, "w10 other text")]
    return docs, items


def test_search_equals_a_plain_scorer(spark, monkeypatch):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit("x"), "mark": F.lit(1), "item": F.lit(2), "score": F.lit(None).cast("int")}).repartition(3)
    of = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    assert sorted(str(tuple(r)) for r in search.search(df, of).collect()) == brute(docs, items)
    for name, value in (("TABLE", 1 << 9), ("BITS", 1), ("MAX_BROADCAST", 0), ("MOST_BITS", 1 << 6)):
        monkeypatch.setattr(search, name, value)
    assert sorted(str(tuple(r)) for r in search.search(df, of, k=3, round_bytes=200).collect()) == brute(docs, items, 3)


def test_search_of_nothing(spark):
    none, of = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(none, of).count() == 0
    assert search.search(of.withColumnRenamed("item_id", "doc_id"), of.limit(0)).count() == 0


def test_bounds_never_underestimate():
    docs, items = corpus(120)
    q = search.Queries.of([t for _, t in items])
    bags = [Counter(terms(t)) for _, t in docs if terms(t)]
    texts = [t for _, t in docs if terms(t)]
    (_, _, hashes, rows, n), *more = search.terms_of(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), 0)
    assert not more
    r, h, tf = search.counted(rows, hashes)
    df = Counter(h.tolist())
    q.weigh([{"term": -1, "n": len(bags), "total": int(n.sum())}, *({"term": i, "n": df[t]} for i, t in enumerate(q.terms.tolist()) if df[t])])
    reached = np.searchsorted(search.LEVELS, tf, side="right")
    level = np.concatenate([np.arange(x) for x in reached])
    loose = 0
    for bits in (64, 1 << 14):
        bound = q.bounds(bits, n, search.table_of(np.repeat(r, reached), search.entries(np.repeat(h, reached), level), len(texts), bits))
        exact = np.zeros_like(bound)
        values = np.zeros((len(q.terms), len(texts)), np.int64)
        at = np.minimum(np.searchsorted(q.terms, h), len(q.terms) - 1)
        hit = q.terms[at] == h
        values[at[hit], r[hit]] = q.points(tf[hit], q.norm(n)[r[hit]], at[hit])
        exact = q.sums(values)
        assert (bound >= exact).all()
        loose = int((bound - exact).sum()) if bits == 64 else loose
    assert (bound - exact).sum() < loose
