"""The Kneser-Ney models against a plain restatement, fixed expressions, and the stage that uses them."""

import collections
import math

import numpy as np

from basketry.llm import toxicity as tox

RNG = np.random.default_rng(11)
SYLLABLES = ("zor", "quil", "mab", "tef", "gun", "rish", "pol", "dra")
WORDS = sorted({(a + b + c)[:9].ljust(8, "x") for a in SYLLABLES for b in SYLLABLES for c in SYLLABLES[:3]})
FOUL = sorted({f"kru{a}{b}"[:9].ljust(8, "x") for a in SYLLABLES for b in SYLLABLES})[:20]


def corpus(n):
    rows = []
    for k in range(n):
        toxic = int(k % 3 == 0)
        words = list(RNG.choice(WORDS, 40))
        if toxic:
            for at in range(0, 40, 5):
                words[at : at + 2] = RNG.choice(FOUL, 2)
        rows.append((k, " ".join(words), toxic))
    return rows


def restated(rows):
    """Differences of pairs, words and beginnings by the definitions, over all rows. Every word has seven letters at least."""
    pairs = collections.Counter()
    for _, text, c in rows:
        words = tox.words_of(text)
        pairs.update((v, w, c) for v, w in zip(["", *words], words))
    kinds = {(v, w) for v, w, _ in pairs}
    n = lambda v, w: (pairs[v, w, 1], pairs[v, w, 0])
    cont = collections.defaultdict(lambda: [0, 0])
    history = collections.defaultdict(lambda: [0, 0, 0])
    for v, w in kinds:
        for c in (0, 1):
            cont[w][c] += n(v, w)[c] > 0
            history[v][c] += n(v, w)[c]
        history[v][2] += 1
    kept_pairs = {p for p in kinds if max(n(*p)) > tox.PAIR_DISCOUNT}
    kept_words = {w for w in cont if max(cont[w]) > tox.DISCOUNT or any(w == x for _, x in kept_pairs)}

    def level(counts, kept, parent, prob):
        totals = [sum(k[c] for k in counts.values()) for c in (0, 1)]
        low = sum(min(x, tox.DISCOUNT) for k in counts.values() for x in k) / sum(totals)
        shares = collections.Counter()
        for k in kept:
            shares[parent(k)] += sum(counts[k])
        out, tells = {}, set()
        for k in kept:
            back = [prob.get(parent(k), (1.0, 1.0))[c] * sum(counts[k]) / shares[parent(k)] for c in (0, 1)]
            out[k] = tuple(max(counts[k][c] - tox.DISCOUNT, 0) / totals[c] + low * back[c] for c in (0, 1))
            if surprising(counts[k], [back[c] * totals[c] for c in (0, 1)]):
                tells.add(k)
        return out, tells, totals

    def surprising(counts, odds):
        expected = [sum(counts) * x / sum(odds) for x in odds]
        return 2 * sum(k * math.log(k / e) for k, e in zip(counts, expected) if k) >= tox.TELLING

    prob, found = {}, {}
    for m in sorted(tox.STEMS):
        counts = collections.defaultdict(lambda: [0, 0])
        for w, k in cont.items():
            for c in (0, 1):
                counts[w[:m]][c] += k[c] > 0
        own, tells, _ = level(counts, [s for s in counts if max(counts[s]) > tox.DISCOUNT], (lambda s: "") if m == min(tox.STEMS) else (lambda s: s[:-1]), prob)
        prob |= own
        found |= {("stem", s): math.log(own[s][0] / own[s][1]) for s in tells}
    longest = lambda w: next((w[:m] for m in tox.STEMS if w[:m] in prob), "")
    words, tells, totals = level(cont, kept_words, longest, prob)
    found |= {("word", w): math.log(words[w][0] / words[w][1]) for w in tells}
    for v, w in kept_pairs:
        h = history[v]
        weight = min(0.95, tox.PAIR_DISCOUNT * h[2] / (h[0] + h[1]))
        p = [max(n(v, w)[c] - tox.PAIR_DISCOUNT, 0) / h[c] + weight * words[w][c] if h[c] else words[w][c] for c in (0, 1)]
        if surprising(n(v, w), [words[w][c] * totals[c] for c in (0, 1)]):
            found["pair", v, w] = math.log(p[0] / p[1])

    def mean(text):
        tokens, total = tox.words_of(text), 0.0
        for v, w in zip(["", *tokens], tokens):
            names = [("pair", v, w), ("word", w), *(("stem", w[:m]) for m in tox.STEMS)]
            total += next((found[x] for x in names if x in found), 0.0)
        return total / max(len(tokens), tox.LEAST_WORDS)

    return mean, found


def test_models_equal_a_plain_restatement(spark):
    rows = corpus(240)
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = tox.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    mean, found = restated(rows)
    assert model.table.n == len(found) and {k[0] for k in found} == {"pair", "word", "stem"}
    for _, text, _ in corpus(40) + [(0, "unknownish wordings", 0), (0, "", 0)]:
        assert abs(model.features(text)[0] - mean(text)) < 5e-3


def test_a_fixed_phrase_parts_the_classes(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(2000):
        words = list(rng.choice(WORDS, 30))
        if k % 4 == 0:
            at = int(rng.integers(0, 30))
            words[at:at] = ["you", "zorp", "quilm"]
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    train = frame.where("doc_id % 5 <> 0")
    model = tox.train(train.select("doc_id", "text"), train.select("doc_id", "toxic"))
    held = tox.scores(frame.where("doc_id % 5 = 0"), model).toPandas()
    assert held.loc[held["toxic"] == 1, "score"].min() > held.loc[held["toxic"] == 0, "score"].max()
    assert held.loc[held["toxic"] == 1, "score"].min() >= model.cut > held.loc[held["toxic"] == 0, "score"].max()


def test_the_cut_reaches_its_recall_but_loses_no_more_than_stated():
    scores, toxic = np.concatenate([np.linspace(0, 0.2, 1000), np.linspace(0.1, 1, 200)]), np.repeat([0, 1], [1000, 200])
    cut = tox.cut_of(scores, toxic)
    assert (scores[toxic == 0] >= cut).mean() <= tox.MOST_LOST + 1e-9 and 0.1 < cut < 0.2
    apart = tox.cut_of(np.concatenate([np.linspace(0, 0.2, 1000), np.linspace(0.3, 1, 200)]), toxic)
    assert 0.3 <= apart <= 0.31 and tox.cut_of(np.ones(3), np.ones(3)) == 0.5


def test_awkward_tables(spark):
    rows = corpus(60)
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = frame.select("doc_id", "toxic")
    model = tox.train(frame.select("doc_id", "text"), labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (1, None), (-7, 1)], "doc_id long, toxic int")))
    odd = spark.createDataFrame([(1, "a b", 0.1), (1, "a b", 0.1), (None, None, 0.2), (2, "", 0.3), (3, "zorquilmab " * 50_000, 0.4)], "doc_id long, text string, score_ double")
    got = tox.scores(odd, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["text"] == "a b"}) == 1
    empty = frame.select("doc_id", "text").limit(0)
    assert tox.scores(empty, model).count() == 0 and tox.train(empty, labels.limit(0)).curve is None
    assert tox.train(frame.select("doc_id", "text"), labels.where("toxic = 0")).curve is None
