"""The transducer against sorted lists, and the audit against a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lagweave.llm import divergence
from lagweave.llm.divergence import Transducer

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def places(t, words):
    text = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    return t.ordinals(text, np.cumsum(lengths) - lengths, lengths).tolist()


def test_transducer_is_the_sorted_list():
    r = random.Random(1)
    for size in (1, 2, 7, 300):
        terms = sorted({"".join(r.choice("abé天") for _ in range(r.randint(1, 7))).encode() for _ in range(size)})
        t = Transducer.loads(Transducer.build(terms).dumps())
        assert places(t, terms) == list(range(len(terms))) and [t.term(i) for i in range(len(terms))] == terms
        others = [w for w in ("".join(r.choice("abcé") for _ in range(r.randint(1, 8))).encode() for _ in range(200)) if w not in terms]
        assert set(places(t, others)) <= {-1}


def test_transducer_is_minimal():
    terms = sorted(a + b + c for a in (b"x", b"y", b"z") for b in (b"1", b"2") for c in (b"end", b"ing"))
    t = Transducer.build(terms)
    futures = defaultdict(set)

    def future(state):
        out = [("",)] if t.ends[state] else []
        for k, target in zip(t.keys, t.targets):
            if k // 256 == state:
                out += [(chr(k % 256), *f) for f in future(target)]
        return out

    for s in range(len(t.ends)):
        futures[tuple(sorted(future(s)))].add(s)
    assert all(len(v) == 1 for v in futures.values())


def test_shares_are_exact():
    r = random.Random(3)
    n = np.array([r.randint(0, 10**r.randint(1, 14)) for _ in range(500)])
    total = n + np.array([r.randint(1, 10**r.randint(1, 14)) for _ in range(500)])
    assert divergence.share(n, total).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, total)]


def brute(rows, least=3, top=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(UPPER))) for lang, source, text in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, _, w in docs:
        df[lang].update(set(w))
    kept = {lang: sorted((t for t, n in df[lang].items() if n >= least), key=str.encode) for lang in {x for x, _, _ in docs}}
    for lang, source, w in docs:
        counts[lang, source].update(t for t in w if t in set(kept[lang]))
    whole = defaultdict(Counter)
    for (lang, _), c in counts.items():
        whole[lang].update(c)
    p = lambda c, lang: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept[lang])) for t in kept[lang]}
    out = []
    for (lang, source), c in counts.items():
        mine, q = p(c, lang), p(whole[lang], lang)
        pairs = []
        for other in [s for x, s in counts if x == lang and s != source]:
            o = p(counts[lang, other], lang)
            pairs.append((sum((mine[t] - o[t]) ** 2 // o[t] for t in kept[lang]), other))
        terms = [((mine[t] - q[t]) ** 2 // q[t], t) for t in kept[lang] if c[t] and mine[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or k <= top:
                    out.append((lang, source, part, item, v, k))
    return sorted(out)


@pytest.fixture
def odd(spark):
    r = random.Random(5)
    rows = [("en", f"s{r.randint(0, 4)}", " ".join(r.choice("ab Cd é天 x1y don't the THE of".split()) for _ in range(r.randint(0, 40)))) for _ in range(60)]
    rows += [(None, None, None), ("", "", ""), ("xx", "a", "only once"), ("xx", "b", None), ("en", None, "the of " * 5000), ("en", "silent", "123 !?")]
    rows += [("de", "hot", "das gleiche noch einmal")] * 40 + [("de", "one", "das gleiche")]
    return rows


def same(df, rows, **kw):
    assert sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()) == brute(rows, **kw)


def test_audit_equals_a_plain_version(spark, odd):
    df = spark.createDataFrame(odd, "lang string, source string, text string").withColumns({"term": F.lit(1), "s": F.lit(2), "ordinal": F.lit("x"), "n": F.lit(None).cast("int")})
    same(divergence.audit(df), odd)


def test_audit_in_shards_rounds_and_tiles(spark, odd, monkeypatch):
    for name, value in (("SHARD_TERMS", 2), ("TILE_TERMS", 3), ("TILE_SOURCES", 2)):
        monkeypatch.setattr(divergence, name, value)
    same(divergence.audit(spark.createDataFrame(odd, "lang string, source string, text string"), round_bytes=1, top=4), odd, top=4)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_letters_equal_the_pattern():
    texts = ["a1b", "Éé x-y_z", "\x7fq\x00r", "天地 ABC", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = [(int(row), part.tobytes()[s:e].decode()) for _, _, part, starts, ends, _, rows in divergence._blocks(batch) for s, e, row in zip(starts, ends, rows)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in TERM.findall(t.translate(UPPER))]
