import random
import re

import pytest

from memspan.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for item, text in items:
            v = words(text)
            m = min(13, len(v))
            for k in range(max(1, len(v) - 12) if v else 0):
                for a in range(len(w) - m + 1):
                    if w[a : a + m] == v[k : k + m]:
                        hit.update(range(a, a + m))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "the", "É", "漢", "x1", "Zoë"] + [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 2, 5, 12, 13, 14, 30))))) for i in range(25)] + [(25, None), (7, "again the item seven " * 4)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))))
            if rng.random() < 0.5:
                v = (rng.choice(items)[1] or "").split()
                a = rng.randrange(len(v) + 1)
                parts.append(", ".join(v[a:]).upper())
        docs.append((i, ". ".join(parts)))
    return [*docs, (3, "clean words only here"), (60, None), (61, ""), (61, ""), (62, "... !!"), (None, items[10][1])], items


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [d.BLOCK_BYTES, 4000])
def test_against_brute_force(spark, block_bytes):
    docs, items = corpus(3)
    documents = spark.createDataFrame([(*x, 5, "no") for x in docs], "doc_id long, text string, n_words int, contaminated string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert rows(d.contamination(documents, benchmark, block_bytes=block_bytes)) == brute(docs, items)
    kept = d.drop_contaminated(documents, benchmark, block_bytes=block_bytes)
    assert kept.columns == documents.columns
    wanted = sorted(repr((i, t)) for i, t in docs if not brute([(i, t)], items)[0][-1])
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == wanted


def test_long_texts_and_other_columns(spark):
    items = [(1, " ".join(f"w{i}" for i in range(20)))]
    rows = [(1, "x " * 100_000 + items[0][1]), (1, items[0][1]), (2, "a b")]
    documents = spark.createDataFrame([(*r, "g", 1, "h") for r in rows], "doc_id long, text string, gone string, _text int, `TEXT_HASH` string")
    for size in (d.BLOCK_BYTES, 2000):
        found = d.contamination(documents, spark.createDataFrame(items, "item_id long, text string"), block_bytes=size)
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in found.collect()) == [(1, 20, 20, True), (1, 100_020, 20, False), (2, 2, 0, False)]
        kept = d.drop_contaminated(documents, spark.createDataFrame(items, "item_id long, text string"), block_bytes=size)
        assert kept.columns == documents.columns and sorted(len(r.text) for r in kept.collect()) == sorted(len(t) for _, t in rows if t != items[0][1])


def test_large_benchmark_as_small_ones(spark):
    """200,000 words of items; documents with passages of them, clean ones, a hot window."""
    rng = random.Random(11)
    items = [(i, " ".join(f"v{int(rng.paretovariate(0.6)) % 50_000}" for _ in range(500))) for i in range(400)] + [(None, "one two three"), (1000, "one two three")]
    hot = " ".join(items[0][1].split()[100:130])
    items += [(i, hot) for i in range(2000, 2050)]
    docs = []
    for i in range(300):
        own = [f"v{int(rng.paretovariate(0.6)) % 50_000}" for _ in range(200)]
        v = rng.choice(items[:400])[1].split()
        a = rng.randrange(len(v) - 20)
        docs.append((i, " ".join(own + (v[a : a + rng.randrange(5, 60)] if i % 3 else []) + (hot.split() if i % 5 == 0 else []) + own[:50])))
    docs += [(900, "one two three"), (901, "so one two three"), (902, None)]
    documents = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    small = rows(d.contamination(documents, benchmark, block_bytes=1 << 40))
    large = d.contamination(documents, benchmark, block_bytes=100_000)
    assert rows(large) == small
    assert sum(r[2] > 0 for r in small) > 150 and ("1000",) in {r[4] for r in small}


def test_empty_sides(spark):
    documents = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert rows(d.contamination(documents, benchmark)) == [(1, 3, 0, 0, (), False)]
    assert d.contamination(documents.where("false"), documents.selectExpr("doc_id AS item_id", "text")).count() == 0
    assert d.drop_contaminated(documents, benchmark).count() == 1


def test_spans_and_rarity(spark):
    documents = spark.createDataFrame([(1, "x the quick fox y the quick fox the quick")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "the quick fox")], "item_id long, text string")
    r = d.contamination(documents, benchmark).first()
    assert [(s.start, s.end) for s in r.spans] == [(1, 4), (5, 8)]
    counts = d.word_frequencies(documents, "text", {b"the", b"fox", b"none"})
    assert counts == {b"the": 3, b"fox": 2}
    index = d._index({(b"the", b"quick", b"fox"): {"1"}}, counts)
    assert list(index) == [b"quick"] or list(index) == [b"fox"]
