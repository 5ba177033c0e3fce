"""Queries over sequence files, match files, pictures, streams and names; see :mod:`memspan.plans.catalogue`.

Files are written from the tables to the folder that all executors share, then read back by the readers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspan.operators import mapping, matches, names
from memspan.plans.catalogue import DNA_LEN, TEXT_LEN, _dna, _mem_sql, dna_corpus, query, table, text_corpus
from memspan.plans.tables import own_folder, stored
from memspan.sources import bitmap, fasta, matchfile
from memspan.sources.lines import ordered_lines
from memspan.streaming.matching import match_stream

_BODY = "regexp_replace(upper(regexp_replace({}, '[^A-Za-z]', '', 'g')), '[^ACGT]', 'N', 'g')"


def _folder(spark: SparkSession) -> str:
    return own_folder(spark, "files")


def _fasta(spark: SparkSession, sf_dir: str, name: str, key: str, prefix: str) -> str:
    """A table's texts as a sequence file: headers ``<prefix> <key>``, bodies with everything but ``>``."""
    rows = table(spark, sf_dir, name).select(F.concat(F.lit(f"{prefix} "), F.col(key).cast("string")).alias("name"), F.translate("text", ">", " ").alias("chars"))
    path = f"{_folder(spark)}/{name}.fasta"
    fasta.write_fasta(rows, path)
    return path


@query(f"SELECT 'doc ' || doc_id AS name, {_BODY.format('text')} AS chars, length({_BODY.format('text')}) AS size FROM documents WHERE length({_BODY.format('text')}) > 0")
def fasta_scan(spark, sf_dir):
    return fasta.read_fasta(spark, _fasta(spark, sf_dir, "documents", "doc_id", "doc")).select("name", "chars", "size")


@query(f"SELECT 'item ' || item_id AS name, {_dna('text')} AS chars FROM benchmark WHERE length({_dna('text')}) >= 30 AND contains('item ' || item_id, 'item 1')")
def fasta_scan_filtered(spark, sf_dir):
    return fasta.read_fasta(spark, _fasta(spark, sf_dir, "benchmark", "item_id", "item"), acgt_only=True, min_size=30, name_contains="item 1").select("name", "chars")


@query(f"""WITH t AS (SELECT string_agg({_dna('text')}, '' ORDER BY item_id) AS t, CAST(sum(length({_dna('text')})) AS BIGINT) AS kept,
CAST(sum(length(regexp_replace(text, '[^!-=?-~]', '', 'g')) - length({_dna('text')})) AS BIGINT) AS removed, count(*) AS records FROM benchmark)
SELECT 1 AS place, '>benchmark.fasta' AS line, kept, removed, records FROM t
UNION ALL SELECT CAST(i + 2 AS INTEGER), substr(t, i * 100 + 1, 100), kept, removed, records FROM (SELECT *, unnest(generate_series(0, (length(t) - 1) // 100)) AS i FROM t)""")
def clean_fasta(spark, sf_dir):
    """The clean command over one file: the lines of the cleaned file, in order over its parts, and its counts."""
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"), F.translate("text", ">", " ").alias("chars"), "item_id")
    folder = _folder(spark)
    path = f"{folder}/benchmark.fasta"
    fasta.write_fasta(rows.repartition(1).sortWithinPartitions("item_id"), path)
    counts = fasta.clean_fasta(spark, path, f"{folder}/clean").first()
    lines = ordered_lines(spark, f"{folder}/clean", F.col("value").startswith(">"))
    return lines.select(F.col("line").cast("int").alias("place"), F.col("value").alias("line"), *(F.lit(counts[c]).cast("long").alias(c) for c in ("kept", "removed", "records")))


def _match_file(spark: SparkSession, sf_dir: str) -> str:
    refs, docs = dna_corpus(spark, sf_dir)
    refs = refs.select("id", "chars", F.concat(F.lit("item "), F.col("id").cast("string")).alias("name"))
    docs = docs.select("id", "chars", F.concat(F.lit("doc "), F.col("id").cast("string")).alias("name"))
    path = f"{_folder(spark)}/found-mems.txt"
    found = stored(matches.find_matches(refs, docs, DNA_LEN, both_strands=True, store=True), "matches")  # sorting by ranges reads them twice
    matchfile.write_matches(matchfile.match_lines(found, docs, refs, True), path)
    return path


@query(f"""WITH {_mem_sql(DNA_LEN, True, True)}
SELECT 'doc ' || q.query_id AS query_name, q.strand, 'item ' || m.ref_id AS ref_name, CAST(m.ref_pos AS BIGINT) AS ref_pos, CAST(m.query_pos AS BIGINT) AS query_pos, CAST(m.len AS BIGINT) AS len
FROM q LEFT JOIN m USING (query_id, strand)""")
def match_file_round_trip(spark, sf_dir):
    """All matches written as a match file and read back; blocks without matches stay."""
    return matchfile.read_matches(spark, _match_file(spark, sf_dir)).select("query_name", "strand", "ref_name", "ref_pos", "query_pos", "len")


@query(f"""WITH {_mem_sql(DNA_LEN, True, True)}
SELECT 'doc ' || query_id AS query_name, strand, 'item ' || ref_id AS ref_name, CAST(ref_pos AS BIGINT) AS ref_pos, CAST(query_pos AS BIGINT) AS query_pos, CAST(len AS BIGINT) AS len,
row_number() OVER (PARTITION BY query_id, strand ORDER BY 'item ' || ref_id DESC, ref_pos DESC, query_pos DESC) AS place FROM m""")
def sorted_match_file(spark, sf_dir):
    """The sort command over a match file; place is the line in its block of the sorted file."""
    path = _match_file(spark, sf_dir)
    found = matchfile.read_matches(spark, matchfile.sort_match_file(spark, path, f"{path}-sorted"))
    return found.where("ref_pos IS NOT NULL").select("query_name", "strand", "ref_name", "ref_pos", "query_pos", "len", "place")


@query(f"""WITH {_mem_sql(DNA_LEN, True, True)}
SELECT 'doc ' || q.query_id AS query_name, q.strand, 'item ' || m.ref_id AS ref_name, CAST(m.ref_pos AS BIGINT) AS ref_pos, CAST(m.query_pos AS BIGINT) AS query_pos, CAST(m.len AS BIGINT) AS len
FROM q LEFT JOIN m USING (query_id, strand) WHERE length(q.chars) > 0""")
def match_command(spark, sf_dir):
    """The match command from sequence files to a match file."""
    from memspan import cli

    refs, docs = _fasta(spark, sf_dir, "benchmark", "item_id", "item"), _fasta(spark, sf_dir, "documents", "doc_id", "doc")
    target = f"{own_folder(spark, 'files')}/found-mems.txt"
    if cli.main(["match", "-l", str(DNA_LEN), "-b", "-n", "-o", target, refs, docs], spark):
        raise RuntimeError("the match command failed")
    return matchfile.read_matches(spark, target).select("query_name", "strand", "ref_name", "ref_pos", "query_pos", "len")


@query(r"SELECT page_id, regexp_replace(url, '([^/.])\.[^/.]*$', '\1') || '-mems.txt' AS target FROM pages")
def output_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", matchfile.output_names(F.col("url")).alias("target"))


@query("""WITH s AS (SELECT n_nationkey, 'Supplier#' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0') AS name FROM nation)
SELECT s_suppkey, s_name AS name, n_nationkey FROM supplier LEFT JOIN s ON name = s_name""")
def names_exact(spark, sf_dir):
    """Blocks and the sequences of their name; unknown names have none."""
    known = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Supplier#"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")).alias("name"))
    found, unknown = names.by_exact_name(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name")), known)
    return found.select("s_suppkey", "name", "n_nationkey").unionByName(unknown.select("s_suppkey", "name", F.lit(None).cast(known.schema["n_nationkey"].dataType).alias("n_nationkey")))


@query("""WITH b AS (SELECT doc_id, source AS name, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL),
s AS (SELECT o_orderkey, 'src' || o_orderkey % 25 AS name, row_number() OVER (PARTITION BY o_orderkey % 25 ORDER BY o_orderkey) AS k FROM orders)
SELECT doc_id, name, o_orderkey FROM b LEFT JOIN s USING (name, k)""")
def names_in_order(spark, sf_dir):
    """Blocks and sequences where many have one name: the k-th block of a name is about the k-th sequence of it."""
    blocks = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", F.col("source").alias("name"))
    known = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("src"), (F.col("o_orderkey") % 25).cast("string")).alias("name"))
    return names.by_name_in_order(blocks, known, "doc_id", "o_orderkey").select("doc_id", "name", "o_orderkey")


@query(f"WITH {_mem_sql(TEXT_LEN, False)} SELECT * FROM m")
def stream_matches(spark, sf_dir):
    """All documents as a stream, matched in micro-batches."""
    refs, docs = text_corpus(spark, sf_dir)
    folder = _folder(spark)
    files = docs.rdd.getNumPartitions()
    (docs if files >= 3 else docs.repartition(3)).write.parquet(f"{folder}/in")  # a file for each split, however many there are
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", max(2, files // 3)).parquet(f"{folder}/in")
    match_stream(refs, stream, f"{folder}/out", f"{folder}/state", TEXT_LEN, available_now=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


def _around_sql(text: str, pos: str) -> str:
    return f"""CASE WHEN {pos} = 1 THEN '$' ELSE lower(substr({text}, {pos} - 1, 1)) END || substr({text}, {pos}, 4) || '...' || substr({text}, {pos} + len - 4, 4)
|| CASE WHEN {pos} + len > length({text}) THEN '$' ELSE lower(substr({text}, {pos} + len, 1)) END"""


@query(f"""WITH {_mem_sql(DNA_LEN, True, True)}
SELECT m.*, {_around_sql('r.chars', 'CAST(ref_pos AS INTEGER)')} AS ref_context, {_around_sql('q.chars', 'CAST(query_pos AS INTEGER)')} AS query_context
FROM m JOIN r USING (ref_id) JOIN q USING (query_id, strand)""")
def match_context(spark, sf_dir):
    refs, docs = dna_corpus(spark, sf_dir)
    return matches.match_context(matches.find_matches(refs, docs, DNA_LEN, both_strands=True), refs, matches.with_strands(docs, True))


# --- pictures ------------------------------------------------------------------------------

def _gradient_sql(stops: tuple, steps: tuple) -> str:
    """CASE over n, the step along the stops."""
    out, base = [], 0
    for k, (a, b, size) in enumerate(zip(stops, stops[1:], steps, strict=False)):
        colour = "[" + ", ".join(f"CAST({x} + (n - {base}) * ({(y > x) - (y < x)}) AS INTEGER)" for x, y in zip(a, b, strict=True)) + "]"
        out.append(f"WHEN n < {base + size} THEN {colour}" if k < len(steps) - 1 else f"ELSE {colour}")
        base += size
    return f"CASE {' '.join(out)} END"


@query(f"""WITH p AS (SELECT s_suppkey, count(*) OVER () AS w, row_number() OVER (ORDER BY s_suppkey) - 1 AS x FROM supplier),
f AS (SELECT *, x * {sum(bitmap.FORWARD_STEPS)} // w AS n FROM p), b AS (SELECT *, x * {sum(bitmap.REVERSE_STEPS)} // w AS n FROM p)
SELECT f.s_suppkey, {_gradient_sql(bitmap.FORWARD_STOPS, bitmap.FORWARD_STEPS).replace('n ', 'f.n ')} AS forward, {_gradient_sql(bitmap.REVERSE_STOPS, bitmap.REVERSE_STEPS).replace('n ', 'b.n ')} AS backward FROM f JOIN b USING (s_suppkey)""")
def map_gradient(spark, sf_dir):
    """The two gradients over as many pixels as there are suppliers."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "supplier").select("s_suppkey")
    placed = rows.withColumn("at", F.row_number().over(Window.orderBy("s_suppkey")) - 1).withColumn("w", F.lit(rows.count()))
    return placed.select("s_suppkey", bitmap.gradient_columns(F.col("at"), F.col("w"), bitmap.FORWARD_STOPS, bitmap.FORWARD_STEPS).alias("forward"), bitmap.gradient_columns(F.col("at"), F.col("w"), bitmap.REVERSE_STOPS, bitmap.REVERSE_STEPS).alias("backward"))


def _palette_sql() -> str:
    return ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(bitmap.palette()))


@query(f"""WITH p(i, r, g, b) AS (VALUES {_palette_sql()}), c AS (SELECT c_custkey, c_custkey * 37 % 256 AS x, c_custkey * 101 % 256 AS y, c_custkey * 197 % 256 AS z FROM customer),
d AS (SELECT c_custkey, i, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(x - r) + abs(y - g) + abs(z - b), i) AS n FROM c, p)
SELECT c_custkey, CAST(i AS INTEGER) AS colour FROM d WHERE n = 1""")
def nearest_colours(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", bitmap.nearest_colour(key * 37 % 256, key * 101 % 256, key * 197 % 256, bitmap.palette()).alias("colour"))


_AXIS_SQL = """WITH s AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS most FROM documents WHERE length(text) > 0),
a AS (SELECT *, length(CAST(most AS VARCHAR)) AS digits FROM s),
b AS (SELECT *, most / CAST(1004 - digits * 7 // 2 AS DOUBLE) AS ppp, digits * 7 - 2 AS taken FROM a),
c AS (SELECT *, CAST(ceil(most / ppp) AS BIGINT) AS wide FROM b),
t AS (SELECT m * CAST(pow(10, k) AS BIGINT) AS step FROM (VALUES (1), (2), (5)) x(m), (SELECT unnest(generate_series(0, 12)) AS k)),
d AS (SELECT *, (SELECT min(step) FROM t WHERE (most - 1) // step * (taken + 5) + taken <= wide) AS step, 10 + wide - digits * 7 AS lim FROM c),
e AS (SELECT doc_id, step, ppp, lim, unnest(generate_series(1, CAST(ceil(lim * ppp / step) AS BIGINT))) AS k FROM d)
SELECT doc_id, CAST(k * step AS BIGINT) AS mark, CAST(floor(k * step / ppp) AS BIGINT) AS pixel FROM e WHERE floor(k * step / ppp) < lim"""


@query(_AXIS_SQL)
def axis_ticks(spark, sf_dir):
    """The ruler's inner marks of a map whose longest sequence is the document."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("size")).where("size > 0")
    return mapping.ruler_marks(sizes, "size").select("doc_id", "mark", "pixel")


def _bars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """The bars of all documents over the benchmark's passages, the references' size and the longest sequence's."""
    refs, docs = text_corpus(spark, sf_dir)
    merged = matches.merged_offsets(refs).agg(F.sum(F.col("size") + 1) - 1).first()[0]
    sizes = docs.select("id", F.coalesce(F.length("chars"), F.lit(0)).cast("long").alias("size"))
    most = max(merged, sizes.agg(F.max("size")).first()[0])
    return bitmap.map_bars(mapping.map_pixels(matches.find_matches(refs, docs, TEXT_LEN), refs, docs), sizes, merged, most), merged, most


def _pixel_sql() -> str:
    """CTEs ending in y, as for the map's pixels, and z with the reference's width in pixels."""
    from memspan.plans import catalogue

    pixels = catalogue._sql["mem_map_pixels"].replace("SELECT query_id, pixel, strand, ref_pixel, len FROM y WHERE n = 1", "")
    return f"{pixels.rstrip()},\nz AS (SELECT ceil((SELECT sum(size + 1) - 1 FROM o) / ppp) AS wide FROM c)"


@query(f"{_pixel_sql()} SELECT query_id, pixel, CAST(CASE strand WHEN '+' THEN 3 ELSE 129 END + least(125, floor(ref_pixel * 126 / wide)) AS INTEGER) AS colour FROM y, z WHERE n = 1 AND pixel < 1014")
def map_bitmap(spark, sf_dir):
    """The bars of the map as run-length encoded rows, unpacked again: their coloured pixels."""
    bars = _bars(spark, sf_dir)[0]

    def unpacked(frames):
        for frame in frames:
            rows = [(i, x - mapping.MARGIN, c) for i, line in zip(frame["query_id"], frame["line"], strict=True) for x, c in enumerate(bitmap.unpacked_row(line)) if c > bitmap.GREY]
            yield pd.DataFrame(rows, columns=["query_id", "pixel", "colour"])

    return bars.select("query_id", "line").mapInPandas(unpacked, "query_id long, pixel long, colour int")


@query("""SELECT 'BM' AS filetype, 1024 AS width, CAST(count(*) * 42 + 70 AS INTEGER) AS height, 1 AS planes, 8 AS bits, 1 AS compression, 256 AS colours, 1078 AS dataoffset FROM documents""")
def bmp_info(spark, sf_dir):
    """The headers of the map's bitmap file, which follow from its bars."""
    bars, merged, most = _bars(spark, sf_dir)
    columns = ("filetype", "width", "height", "planes", "bits", "compression", "colours", "dataoffset")

    def read(frames):
        for frame in frames:
            yield pd.DataFrame([[bitmap.bitmap_info(h)[c] for c in columns] for h in frame["header"]], columns=columns)

    heads = bitmap.map_header(bars, bitmap.map_top(spark, merged, most))
    return heads.mapInPandas(read, "filetype string, width int, height int, planes int, bits int, compression int, colours int, dataoffset int")
