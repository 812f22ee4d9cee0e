"""Centroid clustering and the audit of sources against brute force, with wide values, ties, nulls, many tiles and split runs."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from basketry.llm import centroids, divergence
from basketry.llm.centroids import Centroids


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [centroids.whole(float(np.float64(x)), 64) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    points = [v for _, v in sorted(((i, v) for i, v in kept if i is not None), key=lambda r: (key(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, p), n) for n, p in enumerate(points))
    for _ in range(rounds):
        held = collections.defaultdict(list)
        for _, v in kept:
            held[nearest(v)[1]].append(v)
        points = [[sum(c) // len(held[n]) for c in zip(*held[n], strict=True)] if held[n] else p for n, p in enumerate(points)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = collections.Counter()
    for _, d, n in found:
        sums[n] += d
    fits = lambda x: x if x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    whole = all(fits(d) is not None for _, d, _ in found)
    part = {n: all(fits(d) is not None for _, d, m in found if m == n) for n in sums}
    return collections.Counter((i, n, fits(d), fits(sums[n]) if part[n] else None, fits(sums.total()) if whole else None, digest[n]) for i, d, n in found)


def clusters(spark, rows, kind="double"):
    df = spark.createDataFrame([(*r, 1) for r in rows], f"vec_id long, embedding array<{kind}>, cluster int")
    return collections.Counter(tuple(r) for r in centroids.cluster(df).collect())


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    near = [(i, (np.round(rng.normal(size=64) * 3) / 8).tolist()) for i in range(300)]
    same = [(1000 + i, near[i % 3][1]) for i in range(40)] + [(2, near[2][1])]
    odd = [(None, near[4][1]), (500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [None, *[1.0] * 63]), (505, [float("nan"), *[1.0] * 63]), (506, [float("inf"), *[1.0] * 63])]
    rows = near + same + odd
    random.Random(3).shuffle(rows)
    assert clusters(spark, rows) == brute_clusters(rows)


@pytest.mark.parametrize("scale", [1e5, 3e6, 1e18, 2e307])
def test_wide_components_stay_exact(spark, scale):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(60)] + [(100 + i, (rng.uniform(-1, 1, size=64) * scale).tolist()) for i in range(5)]
    assert clusters(spark, rows) == brute_clusters(rows)


def test_equal_centroids_and_few_vectors(spark):
    rows = [(i, [0.5] * 64) for i in range(20)] + [(30, [0.25] * 64)]
    assert clusters(spark, rows) == brute_clusters(rows)
    assert clusters(spark, rows[:2]) == brute_clusters(rows[:2])
    assert clusters(spark, []) == collections.Counter()
    assert clusters(spark, [(None, [1.0] * 64)]) == collections.Counter([(None, None, None, None, None, None)])


def test_the_shortlist_holds_every_nearest_centroid():
    rng = np.random.default_rng(7)
    for size in (3, 1000, 1 << 20, 1 << 27):
        c = rng.integers(-size, size + 1, (16, 64))
        c[1:8] = c[0] + rng.integers(-1, 2, (7, 64))
        c = np.clip(c, -size, size)
        x = np.clip(c[rng.integers(0, 16, 500)] + rng.integers(-2, 3, (500, 64)), -size, size)
        own = Centroids(c.tolist())
        exact = ((x[:, None, :] - c[None]) ** 2).sum(-1)
        assert own.shortlist(x)[exact == exact.min(axis=1)[:, None]].all()
        assert (own.nearest(x) == exact.argmin(axis=1)).all()


def brute_audit(rows, least, top=50):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, n, groups = collections.Counter(), collections.Counter(), set()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        words = term.findall(text.translate(lower))
        for w in set(words):
            docs[lang, w] += 1
        for w in words:
            n[lang, source, w] += 1
    out = collections.Counter()
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), k in docs.items() if x == lang and k >= least]
        own = sorted(s for x, s in groups if x == lang)
        total = {s: sum(n[lang, s, w] for w in kept) for s in own}
        p = {s: {w: 1 + 10**9 * (n[lang, s, w] + 5) // (total[s] + 5 * len(kept)) for w in kept} for s in own}
        every = sum(total.values())
        q = {w: 1 + 10**9 * (sum(n[lang, s, w] for s in own) + 5) // (every + 5 * len(kept)) for w in kept}
        for s in own:
            pairs = [(sum(abs(p[s][w] - p[t][w]) for w in kept), t) for t in own if t != s]
            terms = [(p[s][w] - q[w], w) for w in kept if n[lang, s, w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out[lang, s, part, item, value, rank] += 1
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "text string, lang string, source string, term string, n int")
    out = divergence.audit(df, **more)
    return collections.Counter(tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect())


def some_rows(rng, sources, n=300):
    words = [f"w{'abcdefghij'[k % 10]}{'é' * (k % 3)}{'klmnopqrst'[k // 10 % 10]}" for k in range(80)] + ["ÄB", "äb", "İx", "日本"]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(0, 30)))
    rows = [(line().upper() if rng.random() < 0.1 else line(), rng.choice(["en", "de", None]), rng.choice(sources)) for _ in range(n)]
    return rows + [(None, "en", "empty"), ("", None, None), ("Rare\x00words here", "xx", "a"), (None, "yy", "b"), ("", "yy", "c")] + rows[:7] + [("hot " * 50_000, "en", sources[0])]


@pytest.mark.parametrize(("sources", "tile"), [(["a", "b", None], 256), ([f"s{k}" for k in range(11)], 3)])
def test_audit_equals_brute_force(spark, sources, tile):
    rows = some_rows(random.Random(9), sources)
    for least, top in ((5, 50), (30, 3), (1000, 50)):
        assert found(spark, rows, least=least, top=top, tile=tile) == brute_audit(rows, least, top)


def test_runs_that_go_on_in_other_batches(spark, monkeypatch):
    rows = some_rows(random.Random(4), ["a", "b", "c"], 120)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found(spark, rows, least=5, top=4) == brute_audit(rows, 5, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_audit_of_nothing(spark):
    assert found(spark, []) == collections.Counter()
    assert found(spark, [(None, None, None)]) == collections.Counter()
    assert found(spark, [(None, None, None), ("x", None, "b")], least=3) == {("", "", "pair", "b", 0, 1): 1, ("", "b", "pair", "", 0, 1): 1}


def test_long_texts_and_small_shares(spark, monkeypatch):
    rows = [(f"Word and wordé {k % 7} " * 40, "en", "ab"[k % 2]) for k in range(20)]
    monkeypatch.setattr(divergence, "SHARE", 2)
    assert found(spark, rows, least=5) == brute_audit(rows, 5)
    assert collections.Counter(divergence.terms_of(b"Aa \xc3\xa9B aA")) == {b"aa": 2, b"\xc3\xa9b": 1}


def test_long_texts_are_counted_like_others(monkeypatch):


    class Context:
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(divergence, "TaskContext", type("T", (), {"get": staticmethod(Context)}))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 2), pa.array(["s"] * 2), pa.array([b"Word and wordz Word " * 9, b"and so"])], names=["lang", "source", "text"])
    whole = list(divergence._records([batch]))
    monkeypatch.setattr(divergence, "LONG", 10)
    assert list(divergence._records([batch])) == whole


def test_probabilities_beyond_64_bits():
    n = np.array([0, 10**10, 10**12], np.int64)
    assert divergence.probability(n, 10**13, 7).tolist() == [1 + 10**9 * (int(x) + 5) // (10**13 + 35) for x in n]


def test_terms_of_equal_hash_stay_apart():
    rows = [("de", "a", "s", 2, 5), ("en", "a", "s", 1, 1), ("en", "a", "t", 2, 4), ("en", "b", "s", 2, 2), ("en", "c", "s", 3, 3)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in some]) for c in range(3)] + [pa.array([9] * len(some), pa.int32())] + [pa.array([r[c] for r in some]) for c in (3, 4)], names=["lang", "term", "source", "key", "docs", "n"]) for some in (rows[:2], rows[2:4], rows[4:])]
    got = [tuple(r.values()) for b in divergence._runs(3)(batches) for r in b.to_pylist()]
    assert got == [("en", "a", "s", 1, 5, True), ("en", "a", "t", 4, 5, False), ("en", "c", "s", 3, 3, True)]
