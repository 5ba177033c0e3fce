import hashlib
import random
import re

import numpy as np
import pytest

from memspan.llm import fingerprints as fp


def brute_shingles(text, width=5):
    w = [x for x in re.split("[\x20\x09-\x0d\x85\xa0  -     　]+", text.translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["ab", "Ab", "é", "漢字", "x" * 40, "b,", "7"]) + str(rng.randrange(30)) for _ in range(rng.choice((0, 1, 4, 5, 30, 400)))) for _ in range(n)]


def test_hashes_stand_for_shingles():
    seen = {}
    for t in [*texts(60, 1), "a\xa0b c d e f", "A\tb\nc d　e f", "aa b c d e", "a ab c d e"]:
        got = fp.shingle_hashes(fp.word_hashes(t))
        assert len(set(got.tolist())) == len(brute_shingles(t))
        for shingle in brute_shingles(t):
            h = int(fp.shingle_hashes(fp.word_hashes(" ".join(shingle)))[0])
            assert h in got.tolist()
            assert seen.setdefault(h, shingle) == shingle


def test_long_and_short_offsets_agree():
    words = fp.word_hashes("q" * 70_000 + " tail words")
    assert words[1:].tolist() == fp.word_hashes("tail words").tolist()


def test_sketch_is_a_fixed_fraction_and_merges():
    a, b = (fp.Sketch(" ".join(f"{p}{i}" for i in range(8000))) for p in "xy")
    assert abs(len(a.kept) / a.size - 1 / fp.SCALE) < 0.02
    both = np.unique(np.concatenate([fp.parse(str(s))[2] for s in (a, b)]))
    assert fp.merged(a.kept, b.kept).tolist() == both.tolist()
    size, digest, kept = fp.parse(str(a))
    assert (size, digest) == (a.size, a.digest) and kept.tolist() == a.kept.tolist()


def test_containment_of_unequal_documents():
    words = [f"w{i}" for i in range(20_000)]
    small, large = fp.Sketch(" ".join(words[:1500])), fp.Sketch(" ".join(words))
    near, part = fp.likeness(small, large)
    assert part > 0.99 and abs(near - 1500 / 20_000) < 0.02
    assert fp.likeness(fp.Sketch(""), fp.Sketch("")) == (1.0, 1.0)
    assert fp.likeness(fp.Sketch(""), large) == (0.0, 0.0)


@pytest.mark.parametrize("n", [0, 1, 2, 157])
def test_edits_against_a_plain_loop(spark, n):
    rng = random.Random(n)
    rows = [(i * 7 - 30, t, "edited") for i, t in enumerate(texts(n, 9))]
    rng.shuffle(rows)
    if n > 100:
        rows[5] = (rows[5][0], None, "edited")
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    found = {r.doc_id: r for r in fp.fingerprint_edits(df).collect()}
    order = sorted(((i, t or "") for i, t, _ in rows), reverse=True)
    assert len(found) == n
    for k, (i, t) in enumerate(order):
        other = order[(k + 1) % n][1]
        edited = t[: len(t) - len(t) // 3] + other[: len(t) // 3]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (str(fp.Sketch(t)), str(fp.Sketch(edited)))
        assert r.near_edited == fp.likeness(fp.Sketch(t), fp.Sketch(edited))[0] and r.near_next == fp.likeness(fp.Sketch(t), fp.Sketch(other))[0]


def test_repeated_ids_and_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (None, "n"), (2, None)], "doc_id long, text string")
    found = fp.fingerprint_edits(df).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in found) == [(0, 1), (1, 1), (1, 1), (1, 1), (2, 0)]
    assert fp.fingerprint_documents(df).count() == 5


def test_one_id_holds_most_rows(spark):
    """A hot id with many texts, rows alike, and a null id: every row is paired with the next in descending order."""
    rng = random.Random(12)
    rows = [(5, t) for t in texts(400, 13)] + [(5, "alike words here")] * 300 + [(None, t) for t in texts(60, 14)] + list(enumerate(texts(40, 15), 100)) + [(-3, "low")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1, True, 2) for r in rows], "doc_id long, text string, key string, hash int, look boolean, n int").repartition(4)
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in {t or "" for _, t in rows}], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    low = -(2**63)
    order = sorted(((low if i is None else i, hashes[t or ""], t or "") for i, t in rows), reverse=True)
    wanted = []
    for k, (i, _, t) in enumerate(order):
        other = order[(k + 1) % len(order)][2]
        edited = t[: len(t) - len(t) // 3] + other[: len(t) // 3]
        wanted.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.likeness(fp.Sketch(t), fp.Sketch(other))[0]))
    found = [(low if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in fp.fingerprint_edits(df).collect()]
    assert sorted(found) == sorted(wanted)
    buckets = fp.with_next(df).where("NOT look").groupBy("bucket").agg({"n": "sum"}).collect()
    assert len(buckets) > 8 and sum(r[1] for r in buckets) == len(rows)


def test_query_values_for_short_and_long_texts(spark):
    rows = [(3, "one two"), (2, "word " * 100_000), (1, "one two")]
    found = {r.doc_id: r for r in fp.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[2].n_chars == 500_000 and found[1].fingerprint == found[3].fingerprint
    assert found[1].near_next == 1.0 and found[3].near_next == 0.0
