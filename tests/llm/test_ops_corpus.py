"""Decontamination, source divergence and clustering against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import clusters, decontaminate, divergence
from tests.llm.test_ops import CLASH, ODD, empty, odd, rows


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- benchmark decontamination


def brute_contaminated(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = Counter()
    for doc_id, text in docs:
        w, hit, named = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    named |= windows[tuple(w[i : i + n])]
        names = sorted(str(x) for x in named if x is not None)
        out[(doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))] += 1
    return out


def leaks(rng):
    """Items of all lengths, some shared or repeated, and documents that hold them whole, in part, overlapping and repeatedly."""
    word = lambda n: f"w{rng.randint(0, n)}"
    items = [(i, " ".join(word(400) for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 14, 30])))) for i in range(40)]
    items += [(100, items[3][1]), (3, "again under another text but the same item id as before"), (None, "x y z"), (101, None), (102, " ?!"), (103, "the the the the the the the the the the the the"), (9, "é Ünder Straße"), (10**12, "K k İ")]
    docs = []
    for i in range(160):
        parts = [" ".join(word(3000) for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            k = rng.randint(0, 2)
            parts += [" ".join(w[k:] if rng.random() < 0.5 else w).upper().replace("É", "é").replace("Ü", "Ü"), word(3000)]
        docs.append((i, ", ".join(parts)))
    return items, docs + [docs[5], (5, docs[6][1]), (None, docs[7][1]), (None, docs[7][1]), (500, None), (501, ""), (502, "the " * 3000), (503, (items[8][1] + " ") * 40)]


@pytest.mark.parametrize(("most", "shingle"), [(16 << 20, 3), (0, 3), (16 << 20, 1), (0, 5)])
def test_decontamination(spark, most, shingle):
    items, docs = leaks(random.Random(11))
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contaminated(docs, items)
    assert 20 < sum(n for k, n in want.items() if k[5]) < len(docs)
    assert rows(decontaminate.contaminated(a, b, shingle=shingle, broadcast_bytes=most)) == want


@pytest.mark.parametrize("most", [16 << 20, 0])
def test_decontamination_of_odd_rows(spark, most):
    items = [(1, "A b C"), (2, "日本語 テキスト 🙂"), (3, None), (3, "one two three four five six seven"), (None, "word")]
    b = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, window string")
    docs = [(r[0], r[1]) for r in ODD]
    assert rows(decontaminate.contaminated(odd(spark, True), b, broadcast_bytes=most)) == brute_contaminated(docs, items)
    assert decontaminate.contaminated(empty(spark), b, broadcast_bytes=most).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontaminate.contaminated(odd(spark), none, broadcast_bytes=most)) == brute_contaminated(docs, [])


def test_decontamination_runs_no_python(spark):
    items, docs = leaks(random.Random(12))
    out = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_passage_in_very_many_documents(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("own "), F.col("id").cast("string"), F.lit(" "), F.when(F.col("id") % 3 == 0, F.lit(passage)).otherwise(F.lit("else"))).alias("text"))
    items = spark.createDataFrame([(7, passage), (8, "p3 p4"), (9, "absent words")], "item_id long, text string")
    got = {tuple(r) for r in decontaminate.contaminated(docs, items).groupBy("n_words", "n_hit", "n_items", "contaminated").agg(F.count("*")).collect()}
    assert got == {(27, 25, 2, True, 20_000), (3, 0, 0, False, 40_000)}


# --- source divergence


def brute_divergence(docs, least=3, top=200):
    """docs: (text, lang, source)"""
    counts, held, groups = Counter(), {}, set()
    for i, (text, lang, source) in enumerate(docs):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text)):
            counts[lang, source, term] += 1
            held.setdefault((lang, term), set()).add(i)
    out = Counter()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), own in held.items() if x == lang and len(own) >= least)
        sources = [s for x, s in groups if x == lang]

        def shares(n):
            return {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}

        p = {s: shares({t: counts[lang, s, t] for t in kept}) for s in sources}
        q = shares({t: sum(counts[lang, s, t] for s in sources) for t in kept})
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                for k, (item, value) in enumerate(ranked[: top if part == "term" else None], 1):
                    out[(lang, s, part, item, value, k)] += 1
    return out


@pytest.mark.parametrize("bounds", [{}, {"BLOCK": 40, "HELD": 6, "EXPAND": 7, "PIECE": 16}])
def test_divergence(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(13)
    words = [f"{a}{b}" for a in "Aébcdß" for b in "xyzÉ日🙂k"]
    docs = []
    for i in range(140):
        some = words[: rng.choice([3, 12, 42])]
        docs.append((" ".join(rng.choice(some) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", None, "z"])))
    docs += [("only twice twice", "fr", "a"), ("only", "fr", "b"), (None, "it", "a"), ("", "it", "b"), ("alone alone", "la", "a"), ("alone", "la", "a"), ("alone", "la", "a")]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string")
    for top in (200, 4):
        assert rows(divergence.divergence(df.repartition(6), top=top)) == brute_divergence(docs, top=top)


def test_divergence_of_odd_rows(spark):
    docs = [(r[1], r[2], r[3]) for r in ODD]
    assert rows(divergence.divergence(odd(spark, True))) == brute_divergence(docs)
    assert divergence.divergence(empty(spark)).count() == 0
    three = [(3 * [("word Word é", "en", "s")] + [("word", "en", "t")])][0]
    df = spark.createDataFrame([(t, a, s, 1, 2) for t, a, s in three], "text string, lang string, source string, value int, term int")
    assert rows(divergence.divergence(df)) == brute_divergence(three)


def test_frequencies_are_exact():
    rng = random.Random(14)
    n = [rng.randint(0, 10 ** rng.randint(1, 15)) for _ in range(2000)]
    total = [max(1, x + rng.randint(0, 10 ** rng.randint(1, 15))) for x in n]
    assert divergence.frequency(np.array(n), np.array(total)).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n, total, strict=True)]


def test_long_texts_are_cut_between_words(monkeypatch):
    text = ("Éa b1c " * 40 + "x" * 90).encode()
    whole = divergence.term_ids(text, divergence._Ids()).tolist()
    monkeypatch.setattr(divergence, "PIECE", 5)
    assert divergence.term_ids(text, divergence._Ids()).tolist() == whole and len(whole) == 121


# --- clustering


def brute_clusters(data, k, rounds, width, scale=64, seed=1):
    """data: (vec_id, components)"""
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in data if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, v) for i, v in whole if all(abs(x) <= 1 << 52 for x in v)]
    if not whole:
        return Counter()
    mark = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centres = [v for i, v in sorted(whole, key=lambda x: (mark(x[0]), x[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in whole]
        for j in range(len(centres)):
            mine = [v for (_, v), c in zip(whole, own, strict=True) if c == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(v)) for i, v in whole]
    inertia = Counter()
    for _, d, c in found:
        inertia[c] += d
    fit = lambda x: x if x < 2**63 else None
    return Counter((i, c, fit(d), fit(inertia[c]), fit(sum(inertia.values())), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, d, c in found)


def vectors(spark, data):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<double>, cluster int, v int")


@pytest.mark.parametrize(("spread", "k", "rounds"), [(0.05, 5, 3), (0.5, 5, 4), (30.0, 7, 3)])
def test_clusters_with_ties(spark, spread, k, rounds):
    rng = random.Random(15)
    data = [(i, [rng.uniform(-spread, spread) for _ in range(3)]) for i in range(500)]
    data += [(i, [0.0, 0.0, 0.0]) for i in range(600, 700)]
    got = clusters.clusters(vectors(spark, data).repartition(5), k, rounds, width=3)
    assert rows(got) == brute_clusters(data, k, rounds, 3)


def test_clusters_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 0.0]), (7, [inf, 0.0]), (8, [1.0, 2.0, 3.0]), (None, [5.0, -5.0]), (9, [-0.001, 0.001]), (9, [7.0, 7.0]), (9, [7.0, 7.0]), (10, [1e300, 0.0])]
    assert rows(clusters.clusters(vectors(spark, data), 3, 3, width=2)) == brute_clusters(data, 3, 3, 2)
    assert rows(clusters.clusters(vectors(spark, data), 16, 3, width=2)) == brute_clusters(data, 16, 3, 2)
    large = data[:1] + [(20 + i, [x, -x]) for i, x in enumerate((1e6, 3e8, 2.5e12, -6e13, 6e13))]
    got = brute_clusters(large, 2, 3, 2)
    assert rows(clusters.clusters(vectors(spark, large), 2, 3, width=2)) == got and any(r[2] is None for r in got)
    assert clusters.clusters(vectors(spark, [(1, None)]), 3, 3, width=2).count() == 0
    assert clusters.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_skip_distances_and_hold():
    rng = np.random.default_rng(16)
    centres = rng.integers(-400, 400, (12, 8))
    v = np.concatenate([c + rng.integers(-40, 40, (400, 8)) for c in centres])
    state, before, spent = (None, None, None), None, 0
    for _ in range(4):
        c = [list(map(int, x)) for x in centres]
        half = clusters.below(clusters._root(clusters._distances(c, c)) / 2)
        moved = None if before is None else clusters.above(clusters._root(np.diagonal(clusters._distances(c, before))))
        *state, computed = clusters.assign(v, c, moved, half, *state)
        exact = ((v[:, None, :] - centres[None]) ** 2).sum(2)
        assert (state[0] == exact.argmin(1)).all()
        assert (state[1] ** 2 >= exact.min(1)).all() and (state[2] ** 2 <= exact).all()
        spent, before = spent + computed, c
        centres = np.array([v[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) for j in range(12)])
    assert spent < 0.4 * 4 * v.shape[0] * 12


def test_integers_of_float_vectors_in_slices():
    table = pa.record_batch({"vec_id": pa.array([1, 2, 3]), "embedding": pa.array([[9.0], [0.1, -0.1], [1.5, 2.5]], pa.list_(pa.float32()))}).slice(1)
    (got,) = clusters._integers(2, 64)([table])
    assert got.column("v").to_pylist() == [[6, -7], [96, 160]] and CLASH
