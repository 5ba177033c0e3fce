import random
import time

import numpy as np
import pytest

from memspan.llm import components, membership, neardup


def brute(texts, percent, width):
    """Component of each id by comparing all pairs."""
    def shingles(t):
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in texts}
    parent = {i: i for i, _ in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    out = []
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((3, 12, 60, 200)))]
        for copy in range(rng.choice((1, 2, 8, 25))):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice(([], [rng.choice(vocabulary)], [w[at], rng.choice(vocabulary)]))
            if rng.random() < 0.3:
                w += passage
            out.append(" ".join(w).upper() if rng.random() < 0.2 else "\t".join(w))
    out += ["", None, " \n ", "é\xa0É", "é\xa0É", "one", "ONE", "two words"]
    rng.shuffle(out)
    return [(1000 - 3 * i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed,percent,width,block,lot", [(1, 85, 3, 10**6, 400), (2, 80, 5, 10**6, 400), (1, 85, 3, 800, 400), (3, 85, 3, 10**6, 5), (4, 85, 3, 600, 3)])
def test_components_equal_brute_force(spark, seed, percent, width, block, lot):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, True) for i, t in texts], "doc_id long, text string, component_id int, kept boolean").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, percent, width, block_tokens=block, block_rows=lot).collect()}
    assert found == brute(texts, percent, width)


def test_dropping(spark):
    texts = [(5, "a b c d e f"), (3, "a b c d e f"), (9, "x y z u v w"), (9, "x y z u v w"), (7, None), (None, "a b c d e f"), (None, "a b c d e f"), (8, ""), (8, "")]
    texts += [(1, "alpha beta gamma delta epsilon"), (1, "one two three four five"), (2, "ONE two three four five"), (4, "m n o p q r"), (4, "M n o p q r"), (6, "a b c d e f"), (6, "quite other words than these here")]
    columns = ["_n", "_key", "_kept", "_id", "key", "KEY_", "hashed", "fate", "class", "text_key", "block"]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in columns)
    df = spark.createDataFrame([(*r, *(f"{c}{r[0]}" for c in columns)) for r in texts], schema).repartition(3)
    judged = [(r.component_id, r.kept) for r in neardup.near_duplicates(df).where("doc_id IS NULL").collect()]
    assert judged == [(None, True)] * 2
    left = neardup.drop_near_duplicates(df)
    assert left.columns == df.columns
    found = left.collect()
    assert all(r[c] == f"{c}{r.doc_id}" for r in found for c in columns)
    kept = sorted((r.doc_id or 0, (r.text or "").lower()) for r in found)
    assert kept == [(0, "a b c d e f")] * 2 + [(1, "alpha beta gamma delta epsilon"), (1, "one two three four five"), (3, "a b c d e f"), (4, "m n o p q r"), (6, "quite other words than these here"), (7, ""), (8, ""), (8, ""), (9, "x y z u v w")]
    assert neardup.near_duplicates(df.where("false")).count() == 0 and neardup.drop_near_duplicates(df.where("false")).count() == 0


def exact_components(sets, percent):
    exact = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = exact[a], exact[b]
                exact = [min(x, y) if v in (x, y) else v for v in exact]
    return exact


def test_family_search_with_guests():
    rng = np.random.default_rng(1)
    for size, chance in ((200, 0.96), (30, 0.96), (400, 0.93), (90, 0.8)):
        base = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        sets = [base[rng.random(len(base)) < chance] for _ in range(40)]
        ids = list(range(40))
        exact = exact_components(sets, 85)
        whole = dict(neardup.family_links(ids, sets, 85))
        assert [whole.get(i, i) for i in ids] == exact
        for groups in ([exact[i] for i in ids], [i if rng.random() < 0.5 else exact[i] for i in ids]):
            joined = dict(neardup.family_links(ids, sets, 85, known=groups))
            assert [joined.get(i, i) for i in ids] == exact
        guests = [i % 2 == 0 for i in ids]
        for a, b in neardup.family_links(ids, sets, 85, visiting=guests):
            assert exact[a] == exact[b]
        parent = dict(neardup.family_links(ids, sets, 85, visiting=guests))
        for a in ids:
            for b in range(1, 40, 2):  # b is at home
                n = len(np.intersect1d(sets[a], sets[b]))
                if a != b and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                    assert parent[a] == parent[b]


def test_recall_at_the_threshold(spark):
    """Pairs of 100 to 140 words with similarities from 0.85 to 0.88: at least 0.999 of 2,000 are linked."""
    rng = random.Random(9)
    rows, wanted = [], 0
    for k in range(2000):
        words = [f"w{k}_{i}" for i in range(rng.randrange(100, 140))]
        other = list(words)
        for at in range(len(words) // 5, len(words), len(words) // 3 + 1)[: rng.choice((2, 3))]:
            other[at] = "new"
        a, b = (neardup.shingle_set(" ".join(w), 3) for w in (words, other))
        n = len(np.intersect1d(a, b))
        wanted += 100 * n >= 85 * (len(a) + len(b) - n)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=85, width=3).where("NOT kept").collect()
    assert all(r.component_id == r.doc_id - 1 for r in found)
    assert wanted > 1000 and wanted >= len(found) >= 0.999 * wanted


def test_large_families_end_in_time():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**63, 2).astype(np.uint64)
    sets = [np.unique(np.concatenate((common, rng.integers(0, 2**63, 8).astype(np.uint64)))) for _ in range(4000)]
    began = time.process_time()
    assert neardup.family_links(list(range(4000)), sets, 85) == []
    assert time.process_time() - began < 10


def test_large_families_of_unlike_texts_move_once(spark, monkeypatch):
    """Short texts around one stock phrase share lists but are unlike: only those with a near copy are searched again."""
    rng = random.Random(6)
    stock = "all rights are reserved by the author of this work"
    rows = [(i, " ".join([stock, *("u%d" % rng.randrange(10**9) for _ in range(14))])) for i in range(600)]
    rows += [(1000 + i, t + " more") for i, t in rows[:40]]
    moved = []

    def searched(sets, percent, parts, plain=neardup._searched):
        moved.append(sets.count())
        return plain(sets, percent, parts)

    monkeypatch.setattr(neardup, "_searched", searched)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, 80, 3, block_rows=50).collect()}
    assert found == brute(rows, 80, 3)
    assert len(moved) == 2 and moved[1] <= 80 < 600 < moved[0] < 700


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (None, 3)]
    found = {r.vertex: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert found == {v: find(v) for v in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bloom_filter(spark):
    bits = membership.bloom_filter(spark.range(0, 1000, 7).select("id"))
    df = spark.range(1000).toDF("k").unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS k"))
    inside = {r.k for r in membership.possible_members(df, "k", bits).collect()}
    assert set(range(0, 1000, 7)) <= inside and len(inside) < 160 and None not in inside
    assert {r.k for r in membership.possible_members(df, "k", bits, absent=True).collect()} == (set(range(1000)) | {None}) - inside


@pytest.mark.parametrize("frequent", [2, 20, 1000])
def test_prefixes_are_the_rarest_hashes(spark, frequent):
    """Against a plain count, whichever hashes are frequent ones; no join makes a row for each hash."""
    rng = np.random.default_rng(3)
    stock = rng.integers(0, 1 << 60, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(stock, 25), rng.integers(0, 1 << 60, int(rng.integers(0, 12))).astype(np.uint64)))) for _ in range(120)]
    df = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "class long, hashes binary").repartition(3)
    counts = {}
    for s in sets:
        for h in s.view(np.int64).tolist():
            counts[h] = counts.get(h, 0) + 1
    wanted = set()
    for i, s in enumerate(sets):
        rarest = sorted(s.view(np.int64).tolist(), key=lambda h: (counts[h], h))[: len(s) - -(-len(s) * 85 // 100) + 1]
        wanted |= {(i, h) for h in rarest if counts[h] > 1}
    joins = []
    kept = neardup.stored
    neardup.stored = lambda made, name: (joins.append("Join" in made._jdf.queryExecution().toString()), kept(made, name))[1]
    try:
        found = neardup._prefixes(df, 85, frequent).collect()
    finally:
        neardup.stored = kept
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == wanted
    assert joins and not any(joins)
