import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from memspan import cli
from memspan.operators import mapping, matches
from memspan.sources import bitmap, datasource, fasta, lines, matchfile
from memspan.streaming.matching import match_stream


@pytest.fixture
def write(tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.write_bytes(text.encode())
        return str(path)

    return put


def read(spark, path, **options):
    return [(r.ord, r.name, r.chars, r.size) for r in fasta.read_fasta(spark, path, **options).orderBy("ord").collect()]


def test_records(spark, write):
    path = write("a.fa", ">a b\r\nAC-gT 1x\n")
    assert read(spark, path) == [(1, "a b", "ACGTN", 5)]
    assert read(spark, path, acgt_only=True) == [(1, "a b", "ACGT", 4)]
    assert read(spark, write("b.fa", ">a\nAC>b\nGT")) == [(1, "a", "AC", 2), (2, "b", "GT", 2)]
    assert read(spark, write("c.fa", ">a\n>b\nAC")) == [(2, "b", "AC", 2)]
    assert read(spark, write("d.fa", "x>a\nAC\n")) == []
    assert read(spark, write("e.fa", "")) == []
    sizes = write("f.fa", ">chr1\nAC\n>chr10\nACG\n>x\nACGT\n")
    assert [r[1] for r in read(spark, sizes, min_size=3)] == ["chr10", "x"]
    assert [r[1] for r in read(spark, sizes, name_contains="chr1")] == ["chr1", "chr10"]


def test_order_over_many_splits(spark, write):
    path = write("long.fa", "".join(f">s{i}\n{'ACGT' * (1 + i % 50)}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = read(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r[0], r[1], r[3]) for r in found] == [(i + 1, f"s{i}", 4 * (1 + i % 50)) for i in range(3000)]


def test_clean(spark, write, tmp_path):
    path = write("g.fa", ">a\nACxG-T\n>b\n" + "ACGT" * 30 + "\n")
    counts = fasta.clean_fasta(spark, path, str(tmp_path / "out"))
    assert tuple(counts.first()) == ("g.fa", 124, 2, 2)
    lines = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect()).split("\n")
    assert lines[0] == ">g.fa" and [len(x) for x in lines[1:]] == [100, 24]


def test_match_file_round_trip(spark, tmp_path):
    refs = spark.createDataFrame([(1, 1, "ref one", "ACGTACGTTA"), (2, 2, "two", "GGGTACGG")], "id long, ord long, name string, chars string")
    queries = spark.createDataFrame([(7, 1, "q", "TACGTTGACG"), (8, 2, "none", "AAAA")], "id long, ord long, name string, chars string")
    found = matches.find_matches(refs, queries, 3, both_strands=True)
    target = str(tmp_path / "m")
    matchfile.write_matches(matchfile.match_lines(found, queries, refs, True).coalesce(1), target)
    one = str(tmp_path / "m.txt")
    with open(one, "w") as f:
        f.write("\n".join(r.value for r in spark.read.text(target).collect()) + "\n")
    back = matchfile.read_matches(spark, one)
    names = {1: "ref one", 2: "two"}
    assert {(r.strand, r.ref_name, r.ref_pos, r.query_pos, r.len) for r in back.where("query_name = 'q'").collect()} == {(r.strand, names[r.ref_id], r.ref_pos, r.query_pos, r.len) for r in found.where("query_id = 7").collect()}
    assert {(r.strand, r.ref_pos) for r in back.where("query_name = 'none'").collect()} == {("+", None), ("-", None)}
    placed = matchfile.sort_match_file(spark, one, str(tmp_path / "sorted"))
    lines = [r.value for r in spark.read.text(placed).collect()]
    assert len(lines) == found.count() + 4 and sum(x.startswith(">") for x in lines) == 4
    assert matchfile.output_name("/a/b.fa") == "/a/b-mems.txt"


@pytest.fixture
def many_parts(spark):
    """Eight part files for every written folder."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_match_files_of_many_parts(spark, tmp_path, many_parts):
    """Blocks that go on from part to part, empty ones and equal names keep their matches and their order."""
    draw = random.Random(8)
    text = "".join(draw.choice("ACGT") for _ in range(400))
    refs = spark.createDataFrame([(1, 1, "ref one", text), (2, 2, "two", text[100:300] + "ACGT" * 20)], "id long, ord long, name string, chars string")
    queries = spark.createDataFrame([(k, k, "same" if k % 2 else f"q {k}", text[k * 30 : k * 30 + 200] if k % 4 else "T" * 5) for k in range(12)], "id long, ord long, name string, chars string")
    found = matches.find_matches(refs, queries, 6, both_strands=True)
    target = str(tmp_path / "m")
    matchfile.write_matches(matchfile.match_lines(found, queries, refs, True), target)
    assert len([f for f in os.listdir(target) if f.startswith("part-")]) == 8
    names = {1: "ref one", 2: "two"}
    wanted = sorted((r.query_id, r.strand, names[r.ref_id], r.ref_pos, r.query_pos, r.len) for r in found.collect())
    for size in ("128m", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            back = matchfile.read_matches(spark, target).collect()
            assert len({r.block for r in back}) == 24
            order = {r.block: (r.block - 1) // 2 for r in back}
            assert all(r.query_name == ("same" if order[r.block] % 2 else f"q {order[r.block]}") for r in back)
            assert sorted((order[r.block], r.strand, r.ref_name, r.ref_pos, r.query_pos, r.len) for r in back if r.ref_pos) == wanted
            twice = matchfile.read_matches(spark, [target, target]).where("ref_pos IS NOT NULL").groupBy("source").count().collect()
            assert sorted(tuple(r) for r in twice) == [(0, len(wanted)), (1, len(wanted))]
            placed = matchfile.sort_match_file(spark, target, str(tmp_path / f"sorted{size}"))
            again = matchfile.read_matches(spark, placed).where("ref_pos IS NOT NULL").collect()
            assert sorted((order[r.block], r.strand, r.ref_name, r.ref_pos, r.query_pos, r.len) for r in again) == wanted
            for block in order:
                mine = [(r.ref_name, r.ref_pos, r.query_pos) for r in sorted(again, key=lambda r: r.place) if r.block == block]
                assert mine == sorted(mine, reverse=True) and [r.place for r in sorted(again, key=lambda r: r.place) if r.block == block] == list(range(1, len(mine) + 1))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_malformed_match_files(spark, write):
    for k, text in enumerate((">q\n1\t2\n", ">q\n1\t2\t3\nx\ty\tz\n", "1\t2\t3\n>q\n", ">q\n1\t2\t3\n r\t1\t2\t3\n")):
        path = write(f"bad{k}.txt", text)
        with pytest.raises(Exception, match="not a match line"):
            matchfile.read_matches(spark, path).collect()
        with pytest.raises(Exception, match="not a match line"):
            matchfile.sort_match_file(spark, path, path + "-sorted")
    with pytest.raises(ValueError, match="no matches"):
        matchfile.sort_match_file(spark, write("empty.txt", ">q\n>r\n"))


def test_clean_file_of_many_parts(spark, write, tmp_path, many_parts):
    body = ["ACGT" * 2000, "", "ACxGT\n" * 900, "T" * 333]
    path = write("h.fa", "".join(f">r{k}\n{b}\n" for k, b in enumerate(body)))
    wanted = "".join(c for b in body for c in b if c in "ACGT")
    assert tuple(fasta.clean_fasta(spark, path, str(tmp_path / "out")).first()) == ("h.fa", len(wanted), 900, 4)
    found = lines.ordered_lines(spark, str(tmp_path / "out"), F.col("value").startswith(">")).orderBy("line").collect()
    assert found[0].value == ">h.fa" and [r.value for r in found[1:]] == [wanted[i : i + 100] for i in range(0, len(wanted), 100)]
    os.mkdir(tmp_path / "two")
    for name, text in (("b.fa", ">x\nGG\n>y\nTT"), ("a.fa", ">z\nAA\n>w\nCC")):
        (tmp_path / "two" / name).write_text(text)
    fasta.clean_fasta(spark, str(tmp_path / "two"), str(tmp_path / "out2"))
    assert [r.value for r in lines.ordered_lines(spark, str(tmp_path / "out2"), F.lit(False)).orderBy("line").collect()] == [">two", "AACCGGTT"]


def test_map_of_equal_names(spark, write, tmp_path, capsys):
    ref = write("ref.fa", ">r\n" + "ACGTTGCA" * 40 + "\n")
    query = write("q.fa", ">same\n" + "ACGTTGCA" * 20 + "\n>same\n" + "T" * 160 + "\n")
    said = write("said.txt", ">same\n1\t1\t160\n>same Reverse\n>same\n>same Reverse\n")
    picture = str(tmp_path / "map.bmp")
    assert cli.main(["map", "-o", picture, said, ref, query], spark) == 0
    rows = bitmap.bitmap_rows(open(picture, "rb").read())
    assert max(rows[bitmap.bar_top(1) + 9]) > bitmap.GREY >= max(rows[bitmap.bar_top(2) + 9])
    for text, problem in ((">same\n0\t1\t5\n", "begin at 1"), (">other\n1\t1\t5\n", "named other"), (">same\n" * 3, "named same"), (">same\n1 2\n", "no match file")):
        assert cli.main(["map", "-o", picture, write("bad.txt", text), ref, query], spark) == 1
        assert problem in capsys.readouterr().err


def test_sequences_as_a_data_source(spark, tmp_path):
    datasource.register(spark)
    folder = tmp_path / "seqs"
    folder.mkdir()
    draw = random.Random(6)
    records = [(f"chr{k} of\u00e9 {k % 3}", "".join(draw.choice("ACGTNacgtx-\n1") for _ in range(draw.choice([0, 5, 300, 900])))) for k in range(120)]
    (folder / "a.fa").write_text("".join(f">{n}\n{b}" + "\n" * (k % 2) for k, (n, b) in enumerate(records[:70])))
    (folder / "b.fa").write_text("".join(f">{n}\r\n{b}\r\n" for n, b in records[70:]))
    (folder / "c.fa").write_text("no>record\nACGT")

    def dna(text, keep=False):
        return "".join(c.upper() if c in "ACGTacgt" else "" if keep else "N" for c in text if c.isascii() and c.isalpha())

    wanted = [(n, d) for n, b in records if (d := dna(b))]
    for split in (100, 4096, datasource.SPLIT_BYTES):
        rows = spark.read.format("sequences").option("split_bytes", split).load(str(folder))
        assert [(r.name, r.chars) for r in rows.orderBy("file", "at").collect()] == wanted
    some = rows.where(F.col("name").contains("chr1") & (F.col("size") >= 200))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "sequences" in plan and "Contains" not in plan and ">= 200" not in plan  # what the reader takes is not filtered again
    assert sorted(r.name for r in some.collect()) == sorted(n for n, d in wanted if "chr1" in n and len(d) >= 200)
    kept = spark.read.format("sequences").option("acgt_only", "true").load(str(folder / "a.fa"))
    assert {(r.name, r.size) for r in kept.collect()} == {(n, len(d)) for n, b in records[:70] if (d := dna(b, True))}
    stream = spark.readStream.format("sequences").load(str(folder))
    for round_ in range(2):
        stream.select("name", "chars").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        assert sorted((r.name, r.chars) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(wanted + [("late", "AC")] * round_)
        (folder / "d.fa").write_text(">late\nAC\n")


def test_command_line(spark, write, tmp_path, capsys):
    ref, query = write("ref.fa", ">r\nACGTACGTTA\n"), write("q.fa", ">q one\nTACGTTGACG\n>rest\nGGGG\n")
    out = str(tmp_path / "out")
    assert cli.main(["match", "-l", "3", "-b", "-o", out, ref, query], spark) == 0
    assert "8 matches" in capsys.readouterr().out
    one = str(tmp_path / "one.txt")
    files = sorted(f for f in os.listdir(out) if f.startswith("part-"))
    with open(one, "w") as f:
        f.write("".join(open(os.path.join(out, x)).read() for x in files))
    assert open(one).read().split("\n")[:3] == [">q one", "1\t8\t3", "5\t8\t3"]
    picture = str(tmp_path / "map.bmp")
    assert cli.main(["map", "-o", picture, one, ref, query], spark) == 0
    assert open(picture, "rb").read(2) == b"BM"
    assert cli.main(["match", ref, write("none.fa", "")], spark) == 1
    data = open(picture, "rb").read()
    assert bitmap.bitmap_info(data)["filesize"] == len(data)
    rows = bitmap.bitmap_rows(data)
    assert bitmap.bitmap_bytes(rows, bitmap.palette(), compress=True) == data
    assert len(rows) == bitmap.bar_top(3) - mapping.GAP + mapping.V_MARGIN and len(rows[0]) == 1024
    assert max(rows[bitmap.bar_top(1) + 9]) > bitmap.GREY >= max(rows[bitmap.bar_top(2) + 9]) and bitmap.BLACK in rows[mapping.V_MARGIN]


def test_options():
    assert cli.spanned(["match", "-R", "'chr", "1", "b'", "-L", "5", "-MAM", "A.fa"]) == ["match", "-r", "chr 1 b", "-l", "5", "--mam", "A.fa"]
    assert cli.spanned(["match", "-r", "Chr1", "-o", "-X", "f"]) == ["match", "-r", "Chr1", "-o", "-X", "f"]
    assert cli.spanned(["match", "-r", '"a"', "f"]) == ["match", "-r", "a", "f"]


def test_bitmap(spark):
    rows = [bytes([1, 1, 1, 2]), bytes([3, 3, 4, 4])]
    plain = bitmap.bitmap_bytes(rows, bitmap.palette())
    assert struct.unpack("<I", plain[2:6])[0] == len(plain) and plain[-8:] == rows[1] + rows[0]
    assert bitmap.rle8(rows) == bytes([3, 1, 1, 2, 0, 0, 2, 3, 2, 4, 0, 1])
    assert bitmap.bitmap_rows(plain) == rows == bitmap.bitmap_rows(bitmap.bitmap_bytes(rows, bitmap.palette(), compress=True))
    assert bitmap.bitmap_info(plain)["filesize"] == len(plain)
    sizes = [(n,) for n in (1, 9, 10, 99, 1000, 5000, 123_456, 10**9)]
    marks = {}
    for r in mapping.ruler_marks(spark.createDataFrame(sizes, "n long"), "n").collect():
        marks.setdefault(r.n, []).append((r.mark, r.pixel))
    for (n,) in sizes:
        label, ppp, drawn = len(str(n)) * 7 - 2, mapping.positions_per_pixel(n), sorted(marks.get(n, []))
        step = drawn[0][0] if drawn else 1
        assert drawn == [(k * step, int(k * step / ppp)) for k in range(1, len(drawn) + 1)] and str(step).rstrip("0") in ("1", "2", "5")
        assert all(b - a >= label for (_, a), (_, b) in zip(drawn, drawn[1:])), n  # labels do not touch
        assert not drawn or drawn[-1][1] < mapping.MARGIN + mapping.sequence_pixels(n, n) - label
    refs = spark.createDataFrame([(0, "A" * 5000)], "id long, chars string")
    found = spark.createDataFrame([(5, "+", 0, 1, 1, 100), (5, "-", 0, 50, 60, 200)], "query_id long, strand string, ref_id long, ref_pos long, query_pos long, len int")
    ppp = mapping.positions_per_pixel(5000)
    wanted = {}
    for strand, r, q, n in (("+", 1, 1, 100), ("-", 50, 60, 200)):
        lo = int((q - 1) // ppp)
        for p in range(lo, int((q + n - 2) // ppp) + 1):
            if p not in wanted or n > wanted[p][2]:
                wanted[p] = (strand, int((r - 1) // ppp) + p - lo, n)
    got = mapping.map_pixels(found, refs, spark.createDataFrame([(5, "A" * 400)], "id long, chars string"))
    assert {r.pixel: (r.strand, r.ref_pixel, r.len) for r in got.collect()} == wanted


def test_stream(spark, tmp_path):
    refs = spark.createDataFrame([(0, "ACGTACGTTA")], "id long, chars string")
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "TACGTTGACG")], "id long, chars string").write.parquet(source)
    stream = spark.readStream.schema("id long, chars string").parquet(source)
    match_stream(refs, stream, str(tmp_path / "out"), str(tmp_path / "state"), 3, available_now=True).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.ref_pos, r.query_pos, r.len) for r in got.collect()} == {(1, 8, 3), (5, 8, 3), (1, 2, 4), (4, 1, 6)}


def test_stream_of_many_splits_is_written_in_as_many_files(spark, tmp_path, monkeypatch):
    from memspan.plans import filequeries

    for name, key in (("benchmark", "item_id"), ("documents", "doc_id")):
        rows = [(i, f"{i} " + "some words that are long enough to be a match of fifty letters") for i in range(8)]
        spark.createDataFrame(rows, f"{key} long, text string").repartition(7).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(filequeries, "_folder", lambda session: str(tmp_path / "stream"))
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 28))  # a split for each file
    try:
        assert filequeries.stream_matches(spark, str(tmp_path)).count() >= 64
        assert len(list((tmp_path / "stream" / "in").glob("*.parquet"))) > 3
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)


def test_the_ruler_of_a_text_measures_it_a_few_times(spark):
    texts = spark.createDataFrame([("a" * n,) for n in (0, 1, 9, 10, 1000)], "text string").select("text", F.length("text").cast("long").alias("size")).where("size > 0").select("size")
    marks = mapping.ruler_marks(texts, "size")
    assert marks._jdf.queryExecution().optimizedPlan().toString().count("length(text") < 10
    assert marks.groupBy("size").agg(F.min("mark")).count() == 4
    steps = spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 6, 10, 11, 500, 501, 999_999)], "n long").select(mapping._round_number(F.col("n"))).collect()
    assert [r[0] for r in steps] == [1, 2, 5, 5, 10, 10, 20, 500, 1000, 1_000_000]


def test_lines_are_not_shuffled(spark, write):
    """Reading a match file shuffles nothing but a row a split."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = matchfile.read_matches(spark, write("m.txt", ">q\n a b\t1\t2\t3\n>r\n>s\n a\t4\t5\t6\n"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rows = found.orderBy("block", "place").select("block", "query_name", "ref_name", "place", "ref_pos").collect()
    assert [tuple(r) for r in rows] == [(1, "q", "a b", 1, 1), (2, "r", None, 1, None), (3, "s", "a", 1, 4)]


def test_fields_of_match_lines(spark):
    import pyarrow as pa

    def fields(*values):
        name, numbers = matchfile._fields(pa.array(values, pa.string()))
        return list(zip(name.to_pylist(), *(x.to_pylist() for x in numbers), strict=True))

    assert fields(" a\tb\t1\t2\t3", "  c d \t4\t5\t6", "\t7\t8\t9") == [("a\tb", 1, 2, 3), ("c d", 4, 5, 6), (None, 7, 8, 9)]
    assert fields("1\t2\t3", "4\t5\t6") == [(None, 1, 2, 3), (None, 4, 5, 6)]
    assert fields("1 2  3", " n 4 5 6", "x\t1\t-2\t3", "1\t2", "0x1\t2\t3") == [(None, 1, 2, 3), ("n", 4, 5, 6), (None,) * 4, (None,) * 4, (None,) * 4]


def test_lines_of_a_match_file_follow_ids(spark, tmp_path):
    """Without an order of their own, queries and references are ordered by their ids, and matches meet no queries."""
    refs = spark.createDataFrame([(2, "two", "GGGTACGG"), (1, "one", "ACGTACGTTA")], "id long, name string, chars string")
    queries = spark.createDataFrame([(8, "none", "AAAA"), (7, "q", "TACGTTGACG")], "id long, name string, chars string")
    found = matches.find_matches(refs, queries, 3)
    matchfile.write_matches(matchfile.match_lines(found, queries, refs), str(tmp_path / "m"))
    back = matchfile.read_matches(spark, str(tmp_path / "m")).orderBy("block", "place").collect()
    wanted = sorted(((r.query_id, -r.query_pos, -r.len, r.ref_id, r.ref_pos) for r in found.collect()))
    assert [("q", -q, -n, {1: "one", 2: "two"}[i], p) for _, q, n, i, p in wanted] == [(r.query_name, r.query_pos, r.len, r.ref_name, r.ref_pos) for r in back if r.ref_pos]
    assert back[-1].query_name == "none" and back[-1].ref_pos is None


def test_bodies_are_not_shuffled(spark, write):
    """What tells the place of a split's records is broadcast, whatever Spark thinks of its size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = fasta.read_fasta(spark, write("s.fa", ">a\nAC\n>b\nGT\n"))
        assert "SortMergeJoin" not in records._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in records.select("ord", "name", "chars").orderBy("ord").collect()] == [(1, "a", "AC"), (2, "b", "GT")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
