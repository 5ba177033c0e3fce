import random

import pytest
from pyspark.sql import functions as F

from memspan.functions import sequences
from memspan.operators import kmers, matches
from tests.brute import mems, occurrences


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, chars string")


def rows(df):
    return {(r.query_id, r.ref_id, r.ref_pos, r.query_pos, r.len) for r in df.collect()}


def cases():
    rng = random.Random(7)
    refs, queries = [], []
    for alphabet in ("AC", "ACG", "ACGTN"):
        for _ in range(4):
            ref = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
            query = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
            if rng.random() < 0.5:
                a = rng.randrange(len(ref))
                query += ref[a : a + rng.randint(1, 20)] + rng.choice(alphabet)
            refs.append(ref)
            queries.append(query)
    return refs, queries


@pytest.mark.parametrize("least", [1, 3, 5])
def test_random_texts_against_the_definition(spark, least):
    refs, queries = cases()
    found = rows(matches.find_matches(frame(spark, refs), frame(spark, queries), least))
    assert found == {(q, r, *m) for q, query in enumerate(queries) for r, ref in enumerate(refs) for m in mems(ref, query, least)}


def test_long_matches_across_pieces_and_strides(spark):
    rng = random.Random(3)
    ref = "".join(rng.choice("abcdé😀") for _ in range(900))
    query = "x" + ref[100:700] + "y" + ref[690:760] + ref[0:49] + "z" + ref[860:]
    for least in (33, 40, 50, 51):
        found = rows(matches.find_matches(frame(spark, [ref, "", None]), frame(spark, [query, "", None, ref[:20]]), least))
        assert found == {(0, 0, *m) for m in mems(ref, query, least)}


@pytest.mark.parametrize("kind", ["mam", "mum"])
def test_unique_matches(spark, kind):
    refs, queries = cases()
    found = rows(matches.find_matches(frame(spark, refs), frame(spark, queries), 2, kind=kind))
    wanted = set()
    for q, query in enumerate(queries):
        for r, ref in enumerate(refs):
            for m in mems(ref, query, 2):
                part = query[m[1] - 1 : m[1] - 1 + m[2]]
                if sum(occurrences(x, part) for x in refs) == 1 and (kind == "mam" or occurrences(query, part) == 1):
                    wanted.add((q, r, *m))
    assert found == wanted


def test_worked_examples(spark):
    one = matches.find_matches(frame(spark, ["ACGTACGTTA"]), frame(spark, ["TACGTTGACG"]), 3, both_strands=True)
    assert {(r.strand, r.ref_pos, r.query_pos, r.len) for r in one.collect()} == {("+", 1, 8, 3), ("+", 5, 8, 3), ("+", 1, 2, 4), ("+", 4, 1, 6), ("-", 1, 6, 5), ("-", 5, 6, 4), ("-", 2, 1, 3), ("-", 6, 1, 3)}
    refs, query = frame(spark, ["ACGT", "GGCA"]), frame(spark, ["CGTNGGC"])
    assert rows(matches.find_matches(refs, query, 3)) == {(0, 0, 2, 1, 3), (0, 1, 1, 5, 3)}
    assert rows(matches.find_matches(refs, query, 3, boundary="merged")) == {(0, 0, 2, 1, 7)}
    assert rows(matches.find_matches(frame(spark, ["AAAA"]), frame(spark, ["AAA"]), 2, kind="mam")) == set()
    with pytest.raises(ValueError):
        matches.find_matches(refs, query, kind="other")


def test_shuffled_join_gives_the_same(spark):
    refs, queries = cases()
    a = rows(matches.find_matches(frame(spark, refs), frame(spark, queries), 3))
    b = rows(matches.find_matches(frame(spark, refs), frame(spark, queries), 3, broadcast_bytes=0))
    assert a == b


def test_swapping_sides_swaps_columns_and_lengths_nest(spark):
    refs, queries = cases()
    there = rows(matches.find_matches(frame(spark, refs), frame(spark, queries), 3))
    back = rows(matches.find_matches(frame(spark, queries), frame(spark, refs), 3))
    assert {(r, q, b, a, n) for q, r, a, b, n in there} == back
    longer = rows(matches.find_matches(frame(spark, refs), frame(spark, queries), 6))
    assert longer == {m for m in there if m[-1] >= 6}


def test_kmers_with_context(spark):
    text = "".join(chr(97 + i % 23) for i in range(1000))
    found = kmers.kmers(frame(spark, [text, "ab"]), "chars", 26, 25, 25, ("id",)).collect()
    assert {r.pos for r in found} == set(range(0, 1000 - 25, 25))
    for r in found:
        assert r.kmer == text[r.pos : r.pos + 26]
        assert r.left == text[max(0, r.pos - 25) : r.pos][::-1]
        assert r.right == text[r.pos + 26 : r.pos + 51]


def test_statistics_and_order(spark):
    refs, queries = frame(spark, ["ACGTACGTTA"]), frame(spark, ["TACGTTGACG", "GGGG"])
    found = matches.find_matches(refs, queries, 3)
    stats = {(r.query_id, r.strand): (r.n_matches, r.total_len, r.mean_len) for r in matches.match_stats(found, queries).collect()}
    assert stats == {(0, "+"): (4, 16, 4), (1, "+"): (0, 0, 0)}
    assert tuple(matches.match_stats_global(found, queries).first()) == (2, 4, 2, 4)
    none = found.where("len > 99")
    assert tuple(matches.match_stats_global(none, queries).first()) == (2, 0, 0, 0)
    assert [(r.query_pos, r.len) for r in matches.output_order(found).collect()] == [(8, 3), (8, 3), (2, 4), (1, 6)]
    assert [(r.ref_pos, r.query_pos) for r in matches.sort_matches(found).orderBy("rank").collect()] == [(5, 8), (4, 1), (1, 8), (1, 2)]
    depth = [r.depth for r in matches.matching_statistics(found, queries.where("id = 0"), 3).orderBy("pos").collect()]
    assert depth == [6, 5, 4, 3, 0, 0, 0, 3, 0, 0]


def test_positions_and_counts(spark):
    refs = frame(spark, ["ACGT", "GGCA", "T"])
    offsets = matches.merged_offsets(refs)
    assert [(r.start, r.size) for r in offsets.orderBy("id").collect()] == [(0, 4), (5, 4), (10, 1)]
    placed = matches.locate_reference(spark.range(12).select(F.col("id").alias("pos")), offsets)
    assert [(r.ref_id, r.local_pos) for r in placed.orderBy("pos").collect()] == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0), (2, 1)]
    refs = frame(spark, ["ABAB", "AB"])
    assert {(r.kmer, r.n) for r in matches.kmer_counts(refs, frame(spark, ["xABx"]), 2).collect()} == {("AB", 3)}
    assert {(r.ref_id, r.ref_pos) for r in matches.kmer_positions(refs, frame(spark, ["xABx"]), 2).collect()} == {(0, 1), (0, 3), (1, 1)}
    assert {(r.kmer, r.before, r.n) for r in matches.left_char_histogram(refs, 2).collect()} == {("AB", "$", 2), ("AB", "B", 1), ("BA", "A", 1)}


def test_long_runs_of_one_letter(spark):
    """Runs of N of lengths a and b have a + b - 2 L + 1 matches, whatever the number of hits."""
    refs, queries = ["A" + "N" * 300 + "C"], ["G" + "N" * 200 + "T"]
    found = rows(matches.find_matches(frame(spark, refs), frame(spark, queries), 20))
    assert len(found) == 300 + 200 - 2 * 20 + 1
    assert found == rows(matches.find_matches(frame(spark, refs), frame(spark, queries), 20, broadcast_bytes=0))


def test_context(spark):
    refs, queries = ["ACGTACGTTA"], ["TACGTTGACG"]
    strands = matches.with_strands(frame(spark, queries).select("id", "chars"), True)
    found = matches.match_context(matches.find_matches(frame(spark, refs), frame(spark, queries), 4, both_strands=True), frame(spark, refs), strands)
    assert {(r.strand, r.ref_pos, r.query_pos, r.len, r.ref_context, r.query_context) for r in found.collect()} >= {("+", 4, 1, 6, "gTACG...CGTT" + "a", "$TACG...CGTT" + "g"), ("+", 1, 2, 4, "$ACGT...ACGTa", "tACGT...ACGTt")}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_normalised_once_for_their_kmers(spark):
    docs = spark.createDataFrame([(1, "Acg tt"), (2, None), (3, ""), (4, "ACG")], "id long, text string")
    dna = docs.select("id", sequences.normalize(F.col("text"), True).alias("chars"))
    made = kmers.kmers(dna, "chars", 4, 1, 1, ("id",))
    assert plan_of(made).count("regexp_replace") == 1
    assert sorted(tuple(r) for r in made.collect()) == [(1, 0, "ACGT", "", "T"), (1, 1, "CGTT", "A", "")]


def test_kmers_without_a_match_go_before_their_context_is_made(spark):
    refs = spark.createDataFrame([(1, "ACGTACGTTA")], "id long, chars string")
    queries = spark.createDataFrame([(1, "TACGTTGACG")], "id long, chars string")
    assert "LeftSemi" in plan_of(matches.find_matches(refs, queries, 3))


def test_matching_statistics_join_no_places(spark):
    queries = spark.createDataFrame([(1, "A" * 10), (1, "A" * 4), (2, ""), (3, None), (4, "C")], "id long, chars string")
    found = spark.createDataFrame([(1, "+", 3, 5), (1, "+", 4, 3)], "query_id long, strand string, query_pos long, len int")
    for block_size in (4, 1 << 16):
        made = matches.matching_statistics(found, queries, 3, block_size)
        assert "Join" not in plan_of(made)
        depths = {3: 5, 4: 4, 5: 3}
        expected = [(1, p, depths.get(p, 0)) for n in (10, 4) for p in range(1, n + 1)] + [(4, 1, 0)]
        assert sorted(tuple(r) for r in made.collect()) == sorted(expected)


def test_contexts_of_short_matches_at_both_ends(spark):
    refs = spark.createDataFrame([(1, "ACGT"), (2, "GGACGTCC")], "id long, chars string")
    queries = spark.createDataFrame([(1, "ACGTTTTT")], "id long, chars string")
    found = spark.createDataFrame([(1, "+", 1, 1, 1, 4), (1, "+", 2, 3, 1, 2)], "query_id long, strand string, ref_id long, ref_pos long, query_pos long, len int")
    made = {r.ref_id: (r.ref_context, r.query_context) for r in matches.match_context(found, refs, queries).collect()}
    assert made == {1: ("$ACGT...ACGT$", "$ACGT...ACGTt"), 2: ("gACGT...GGACg", "$ACGT...ACGTg")}


def test_stored_ends_give_the_same_matches(spark):
    """Matches of just the least length leave without a shuffle, longer ones on their diagonals still close."""
    draw = random.Random(5)
    text = "".join(draw.choice("AC") for _ in range(300))
    refs = spark.createDataFrame([(1, text), (2, text[50:90] + "A" * 20)], "id long, chars string")
    queries = spark.createDataFrame([(1, text[100:200]), (2, "AAAAAA" + text[:40]), (3, "")], "id long, chars string")
    found = matches.find_matches(refs, queries, 5, both_strands=True).collect()
    kept = matches.find_matches(refs, queries, 5, both_strands=True, store=True).collect()
    assert sorted(map(tuple, kept)) == sorted(map(tuple, found)) and len({r.len for r in found}) > 5
