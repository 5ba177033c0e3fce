"""The merged text as a table of pieces, and scans that are cut into blocks."""

import random

from pyspark.sql import functions as F

from memspan.operators import matches, names, pieces, scans
from memspan.operators.kmers import kmers_of_pieces
from tests.brute import mems


def test_pieces_against_one_string(spark):
    draw = random.Random(1)
    for between, end in (("N", ""), ("N", "$"), ("", "")):
        texts = ["".join(draw.choices("ACGTé日", k=draw.choice([0, 1, 3, 9, 10, 40, 95]))) for _ in range(14)]
        frame = spark.createDataFrame([(k, 20 - k, t) for k, t in enumerate(texts)] + [(99, 5, None)], "id long, ord long, chars string").repartition(3)
        whole = between.join(reversed(texts)) + end
        for size, before, ahead in ((10, 0, 0), (10, 1, 4), (10, 3, 25), (7, 16, 8)):
            found = {r.piece: (r.lead, r.s) for r in pieces.merged_pieces(frame, between, end, size, before, ahead).collect()}
            wanted = {i // size: (min(before, i), whole[max(0, i - before) : i + size + ahead]) for i in range(0, len(whole), size)}
            assert found == wanted
    empty = frame.limit(0)
    assert pieces.merged_pieces(empty).collect() == []


def test_kmers_over_pieces(spark):
    texts = ["ACGTACGTTAGC", "GG", "", "ACGTTTGACA"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, chars string")
    whole = "N".join(texts)
    for k, stride, context in ((3, 1, 0), (5, 2, 2), (9, 1, 1)):
        size = 4 * stride
        table = pieces.merged_pieces(frame, size=size, before=context, ahead=k - 1 + context)
        rows = kmers_of_pieces(table, size, k, stride, context).collect()
        assert sorted((r.pos, r.kmer) for r in rows) == [(i, whole[i : i + k]) for i in range(0, len(whole) - k + 1, stride)]
        if context:
            assert all(r.left == whole[max(0, r.pos - context) : r.pos][::-1] and r.right == whole[r.pos + k : r.pos + k + context] for r in rows)


def some_matches(spark, draw, n=200, width=300):
    rows = {(draw.randrange(2), "+", draw.randrange(2), draw.randrange(1, 60), draw.randrange(1, width), draw.choice([3, 5, 20, 120])) for _ in range(n)}
    return sorted(rows), spark.createDataFrame(sorted(rows), "query_id long, strand string, ref_id long, ref_pos long, query_pos long, len int")


def test_blocks_do_not_matter(spark):
    draw = random.Random(2)
    rows, frame = some_matches(spark, draw)

    def alone(group, at):
        return sorted(a for a in rows if not any(b is not a and group(a) == group(b) and b[at] <= a[at] and b[at] + b[5] >= a[at] + a[5] for b in rows))

    for block in (4, 64, scans.BLOCK):
        assert sorted(map(tuple, matches.unique_matches(frame, block).collect())) == alone(lambda r: r[:2], 4)
        assert sorted(map(tuple, matches.unique_in_query(frame, block).collect())) == alone(lambda r: r[:3], 3)
    queries = spark.createDataFrame([(0, "A" * 420), (1, "A" * 5)], "id long, chars string")
    wanted = {(q, p): max((b[4] + b[5] - p for b in rows if b[0] == q and b[4] <= p <= b[4] + b[5] - 3), default=0) for q, n in ((0, 420), (1, 5)) for p in range(1, n + 1)}
    for block in (7, 64, scans.BLOCK):
        got = {(r.query_id, r.pos): r.depth for r in matches.matching_statistics(frame, queries, 3, block).collect() if (r.query_id, r.pos) in wanted}
        assert got == wanted


def test_places_in_parts(spark):
    draw = random.Random(3)
    rows, frame = some_matches(spark, draw)
    wanted = {}
    for q in (0, 1):
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], -r[3], -r[4], -r[5]))
        wanted |= {r: k + 1 for k, r in enumerate(mine)}
    for block in (5, scans.BLOCK):
        got = scans.numbered(frame, ("query_id", "strand"), (("ref_id", True), ("ref_pos", True), ("query_pos", True), ("len", True)), "ref_pos", "rank", block)
        assert {tuple(r)[:6]: r["rank"] for r in got.collect()} == wanted
    loose = spark.createDataFrame([(None, 1), (None, 5), ("a", 2)], "name string, at long")
    assert sorted((r.name or "", r.at, r.k) for r in scans.numbered(loose, ("name",), (("at", False),), "at", "k", 2).collect()) == [("", 1, 1), ("", 5, 2), ("a", 2, 1)]


def test_long_runs_over_blocks(spark):
    """Hits at multiples of a stride, in blocks of positions: one match, whatever the blocks."""
    draw = random.Random(4)
    text = "".join(draw.choice("ACGT") for _ in range(700))
    other = text[:300] + "T" + text[301:]
    k, stride = matches.seed_shape(40)
    refs, queries = (spark.createDataFrame([(0, t)], "id long, chars string") for t in (text, other))
    wanted = mems(text, other, 40)
    assert {(r.ref_pos, r.query_pos, r.len) for r in matches.find_matches(refs, queries, 40).collect()} == wanted
    r = matches.kmers(refs.select(F.col("id").alias("ref_id"), "chars"), "chars", k, 1, stride, ("ref_id",))
    q = matches.kmers(queries.select(F.col("id").alias("query_id"), F.lit("+").alias("strand"), "chars"), "chars", k, stride, stride, ("query_id", "strand"))
    r = r.select("ref_id", "kmer", *(F.col(n).alias(f"_r_{n}") for n in ("pos", "left", "right")))
    hits = q.join(r, "kmer").withColumn("_diag", F.col("_r_pos") - F.col("pos")).drop("kmer")
    for block in (stride, 3 * stride + 1, 10_000):
        assert {(x.ref_pos, x.query_pos, x.len) for x in matches._runs(hits, 40, k, stride, block).collect()} == wanted


def test_names_in_order(spark):
    blocks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "block long, name string")
    known = spark.createDataFrame([(10, "a", 5), (20, "b", 6), (30, "a", 7)], "query_id long, name string, size long")
    assert sorted((r.block, r.query_id) for r in names.by_name_in_order(blocks, known, "block", "query_id").collect()) == [(1, 10), (2, 20), (3, 30), (4, None)]


def test_filter_before_the_shuffle(spark):
    draw = random.Random(5)
    ref, query = ("".join(draw.choice("ACGT") for _ in range(n)) for n in (2000, 20_000))
    query = query[:500] + ref[300:420] + query[500:] + ref[-40:]
    refs, queries = (spark.createDataFrame([(0, t)], "id long, chars string") for t in (ref, query))
    r, q = (matches.kmers(d, "chars", 16).withColumn("_h", F.xxhash64("kmer")) for d in (refs, queries))
    table = matches.kmer_filter(r.select("_h"), len(ref))
    left = matches.passing(q, table, len(ref))
    shared = q.join(r.select("kmer").distinct(), "kmer", "left_semi").count()
    assert shared >= 130 and shared <= left.count() <= shared + q.count() // 5
    assert left.join(r.select("kmer").distinct(), "kmer", "left_semi").count() == shared
    assert matches.kmer_filter(r.select("_h"), 10**9) is None
    for least in (16, 40):
        wide = {tuple(x) for x in matches.find_matches(refs, queries, least).collect()}
        assert {tuple(x) for x in matches.find_matches(refs, queries, least, broadcast_bytes=0).collect()} == wide
        assert {tuple(x) for x in matches.find_matches(refs, queries, least, boundary="merged", broadcast_bytes=0).collect()} == wide


def test_repetitive_runs_make_few_pairs(spark):
    a, b = 300, 400
    for unit in ("N", "AC", "GAT"):
        ref, query = "C" + (unit * a)[:a] + "GATNNNNT", (unit * 6)[:6] + "G" + (unit * b)[1 : b + 1] + "A"
        refs, queries = (spark.createDataFrame([(0, t)], "id long, chars string") for t in (ref, query))
        for limit in (0, 10**9) if unit == "AC" else (10**9,):
            assert {(x.ref_pos, x.query_pos, x.len) for x in matches.find_matches(refs, queries, 5, broadcast_bytes=limit).collect()} == mems(ref, query, 5)
        assert matches._told_of(refs, 5) == (len(ref), True) and matches._told_of(refs.selectExpr("id", "'ACGTTGCANNACAC' AS chars"), 5) == (14, False)
        r, q = (matches.kmers(d, "chars", 5, context=1).withColumn("_h", F.xxhash64("kmer")) for d in (refs, queries))
        plain = r.select("_h").join(q.select("_h"), "_h").count()
        r, q = matches._apart(r, q, 5)
        assert plain > (a - 8) * (b - 8) // len(unit) and r.select("_h").join(q.select("_h"), "_h").count() < 6 * (a + b)
