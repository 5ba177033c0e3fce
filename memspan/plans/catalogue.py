"""Catalogue of queries: a callable and its DuckDB statement under one name.

Corpora: *text* is benchmark passages (references) against documents (queries), character for
character; *dna* is the same tables reduced to the letters A, C, G and T.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspan.functions import sequences as S
from memspan.operators import mapping, matches, names, suffixes

TEXT_LEN, DNA_LEN = 50, 12

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name with its DuckDB statement."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    refs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("chars"))
    return refs, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("chars"))


def dna_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    refs, docs = text_corpus(spark, sf_dir)
    dna = S.normalize(F.col("chars"), acgt_only=True)
    return refs.withColumn("chars", dna), matches.spread(docs).withColumn("chars", dna)


def _dna(column: str) -> str:
    return f"regexp_replace(upper(regexp_replace({column}, '[^A-Za-z]', '', 'g')), '[^ACGT]', '', 'g')"


def _corpus_sql(dna: bool, both: bool = False) -> str:
    ref, doc = (_dna("text"), _dna("text")) if dna else ("text", "text")
    query = f"SELECT doc_id AS query_id, '+' AS strand, {doc} AS chars FROM documents"
    if both:
        query += f" UNION ALL SELECT doc_id, '-', reverse(translate({doc}, 'ACGT', 'TGCA')) FROM documents"
    return f"r AS MATERIALIZED (SELECT item_id AS ref_id, {ref} AS chars FROM benchmark), q AS MATERIALIZED ({query})"


def _mem_sql(min_len: int, dna: bool, both: bool = False) -> str:
    """CTEs ending in m(query_id, strand, ref_id, ref_pos, query_pos, len): gaps and islands over
    the hits of every k-mer of the least length."""
    return f"""{_corpus_sql(dna, both)},
rk AS (SELECT ref_id, p, substr(chars, p, {min_len}) AS k FROM (SELECT *, unnest(generate_series(1, len(chars) - {min_len - 1})) AS p FROM r WHERE len(chars) >= {min_len})),
qk AS (SELECT query_id, strand, p, substr(chars, p, {min_len}) AS k FROM (SELECT *, unnest(generate_series(1, len(chars) - {min_len - 1})) AS p FROM q WHERE len(chars) >= {min_len})),
h AS (SELECT query_id, strand, ref_id, rk.p AS rp, qk.p AS qp FROM rk JOIN qk USING (k)),
g AS (SELECT *, qp - row_number() OVER (PARTITION BY query_id, strand, ref_id, rp - qp ORDER BY qp) AS run FROM h),
m AS (SELECT query_id, strand, ref_id, min(rp) AS ref_pos, min(qp) AS query_pos, CAST(count(*) + {min_len - 1} AS INTEGER) AS len FROM g GROUP BY query_id, strand, ref_id, rp - qp, run)"""


_MAM_SQL = """SELECT query_id, strand, ref_id, ref_pos, query_pos, len FROM m a WHERE NOT EXISTS (
  SELECT 1 FROM m b WHERE b.query_id = a.query_id AND b.strand = a.strand AND b.query_pos <= a.query_pos AND b.query_pos + b.len >= a.query_pos + a.len
  AND (b.ref_id, b.ref_pos, b.query_pos, b.len) <> (a.ref_id, a.ref_pos, a.query_pos, a.len))"""


# --- normalisation and filters -------------------------------------------------------------

@query("SELECT item_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACGT]', 'N', 'g') AS chars FROM benchmark")
def normalize_default(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", S.normalize(F.col("text")).alias("chars"))


@query(f"SELECT doc_id, {_dna('text')} AS chars FROM documents")
def normalize_acgt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.normalize(F.col("text"), acgt_only=True).alias("chars"))


@query(f"SELECT doc_id, reverse(translate({_dna('text')}, 'ACGT', 'TGCA')) AS chars FROM documents")
def revcomp(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.reverse_complement(S.normalize(F.col("text"), acgt_only=True)).alias("chars"))


@query("SELECT doc_id, length(text) AS size FROM documents WHERE length(text) >= 500")
def filter_min_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.length("text") >= 500).select("doc_id", F.length("text").cast("long").alias("size"))


@query("SELECT page_id, url FROM pages WHERE contains(url, '/a')")
def filter_name_contains(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.col("url").contains("/a")).select("page_id", "url")


@query(f"SELECT doc_id FROM documents WHERE length({_dna('text')}) > 0")
def filter_empty(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.length(S.normalize(F.col("text"), acgt_only=True)) > 0).select("doc_id")


@query("SELECT item_id AS id, CAST(coalesce(sum(length(text) + 1) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(text) AS size FROM benchmark")
def merged_offsets(spark, sf_dir):
    return matches.merged_offsets(text_corpus(spark, sf_dir)[0]).select("id", "start", "size")


@query("""WITH o AS (SELECT item_id, coalesce(sum(length(text) + 1) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, length(text) AS size FROM benchmark),
p AS (SELECT doc_id, doc_id * 37 % (SELECT sum(size + 1) FROM o) AS pos FROM documents)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, item_id AS ref_id, CAST(pos - start AS BIGINT) AS local_pos FROM p JOIN o ON pos >= start AND pos < start + size + 1""")
def position_to_reference(spark, sf_dir):
    offsets = matches.merged_offsets(text_corpus(spark, sf_dir)[0])
    total = offsets.agg(F.sum(F.col("size") + 1)).first()[0]
    return matches.locate_reference(table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 37 % total).alias("pos")), offsets)


@query(f"SELECT name, chars, size FROM (SELECT {_dna('text')} AS chars, 'item ' || item_id AS name, length({_dna('text')}) AS size FROM benchmark) WHERE size >= 20")
def sequence_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"), S.normalize(F.col("text"), acgt_only=True).alias("chars"))
    return rows.withColumn("size", F.length("chars").cast("long")).where("size >= 20")


# --- matches -------------------------------------------------------------------------------

@query(f"WITH {_mem_sql(TEXT_LEN, False)} SELECT * FROM m")
def mem_text(spark, sf_dir):
    return matches.find_matches(*text_corpus(spark, sf_dir), TEXT_LEN)


@query(f"WITH {_mem_sql(DNA_LEN, True)} SELECT * FROM m")
def mem_dna(spark, sf_dir):
    return matches.find_matches(*dna_corpus(spark, sf_dir), DNA_LEN)


@query(f"WITH {_mem_sql(DNA_LEN, True, True)} SELECT * FROM m")
def mem_dna_both_strands(spark, sf_dir):
    return matches.find_matches(*dna_corpus(spark, sf_dir), DNA_LEN, both_strands=True)


@query(f"WITH {_mem_sql(TEXT_LEN, False)} {_MAM_SQL}")
def mam_text(spark, sf_dir):
    return matches.find_matches(*text_corpus(spark, sf_dir), TEXT_LEN, kind="mam")


@query(f"WITH {_mem_sql(DNA_LEN, True)} {_MAM_SQL}")
def mam_dna(spark, sf_dir):
    return matches.find_matches(*dna_corpus(spark, sf_dir), DNA_LEN, kind="mam")


@query(f"""WITH {_mem_sql(DNA_LEN, True)}, u AS ({_MAM_SQL})
SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.query_id = a.query_id AND b.strand = a.strand AND b.ref_id = a.ref_id
  AND b.ref_pos <= a.ref_pos AND b.ref_pos + b.len >= a.ref_pos + a.len AND (b.ref_pos, b.query_pos, b.len) <> (a.ref_pos, a.query_pos, a.len))""")
def mum_dna(spark, sf_dir):
    return matches.find_matches(*dna_corpus(spark, sf_dir), DNA_LEN, kind="mum")


@query(f"""WITH o AS (SELECT item_id, coalesce(sum(length({_dna('text')}) + 1) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, length({_dna('text')}) AS size FROM benchmark),
{_mem_sql(DNA_LEN, True).replace(f"SELECT item_id AS ref_id, {_dna('text')} AS chars FROM benchmark", f"SELECT 0 AS ref_id, string_agg({_dna('text')}, 'N' ORDER BY item_id) AS chars FROM benchmark")}
SELECT query_id, strand, item_id AS ref_id, CAST(ref_pos - start AS BIGINT) AS ref_pos, query_pos, len FROM m JOIN o ON ref_pos - 1 >= start AND ref_pos - 1 < start + size + 1""")
def mem_dna_merged(spark, sf_dir):
    return matches.find_matches(*dna_corpus(spark, sf_dir), DNA_LEN, boundary="merged")


@query(f"WITH {_mem_sql(DNA_LEN, True, True)} SELECT query_id, ref_id, ref_pos, CAST(length(chars) - (query_pos - 1 + len) + 1 AS BIGINT) AS forward_pos, len FROM m JOIN q USING (query_id, strand) WHERE strand = '-'")
def reverse_to_forward(spark, sf_dir):
    refs, docs = dna_corpus(spark, sf_dir)
    found = matches.find_matches(refs, docs, DNA_LEN, both_strands=True).where("strand = '-'")
    sized = docs.select(F.col("id").alias("query_id"), F.length("chars").alias("_size"))
    return found.join(sized, "query_id").select("query_id", "ref_id", "ref_pos", S.forward_start(F.col("_size"), F.col("query_pos"), F.col("len")).cast("long").alias("forward_pos"), "len")


# --- statistics, order, map ----------------------------------------------------------------

@query(f"""WITH {_mem_sql(DNA_LEN, True, True)}
SELECT q.query_id, q.strand, count(m.len) AS n_matches, CAST(coalesce(sum(m.len), 0) AS BIGINT) AS total_len, CAST(CASE WHEN count(m.len) > 0 THEN sum(m.len) // count(m.len) ELSE 0 END AS BIGINT) AS mean_len
FROM q LEFT JOIN m USING (query_id, strand) GROUP BY q.query_id, q.strand""")
def mem_stats(spark, sf_dir):
    refs, docs = dna_corpus(spark, sf_dir)
    return matches.match_stats(matches.find_matches(refs, docs, DNA_LEN, both_strands=True), docs, True)


@query(f"""WITH {_mem_sql(TEXT_LEN, False)}
SELECT (SELECT count(*) FROM documents) AS n_queries, count(*) AS n_matches, count(*) // (SELECT count(*) FROM documents) AS mean_per_query,
CAST(CASE WHEN count(*) > 0 THEN sum(len) // count(*) ELSE 0 END AS BIGINT) AS mean_len FROM m""")
def mem_stats_global(spark, sf_dir):
    refs, docs = text_corpus(spark, sf_dir)
    return matches.match_stats_global(matches.find_matches(refs, docs, TEXT_LEN), docs)


@query(f"WITH {_mem_sql(DNA_LEN, True)} SELECT *, CAST(row_number() OVER (PARTITION BY query_id, strand ORDER BY ref_id DESC, ref_pos DESC, query_pos DESC, len DESC) AS INTEGER) AS rank FROM m")
def mem_sorted(spark, sf_dir):
    return matches.sort_matches(matches.find_matches(*dna_corpus(spark, sf_dir), DNA_LEN))


@query(f"""WITH {_mem_sql(TEXT_LEN, False)},
o AS (SELECT item_id, coalesce(sum(length(text) + 1) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, length(text) AS size FROM benchmark),
w AS (SELECT greatest((SELECT sum(size + 1) - 1 FROM o), (SELECT max(length(text)) FROM documents)) AS most),
c AS (SELECT CAST(most AS DOUBLE) / (1004 - (length(CAST(CAST(most AS BIGINT) AS VARCHAR)) * 7) // 2) AS ppp FROM w),
b AS (SELECT query_id, strand, ref_pos - 1 + start AS r, query_pos - 1 AS qp, len, row_number() OVER (PARTITION BY query_id ORDER BY strand, query_pos DESC, len DESC, ref_id, ref_pos) AS seq FROM m JOIN o ON o.item_id = m.ref_id),
x AS (SELECT query_id, strand, len, seq, CAST(floor(qp / ppp) AS BIGINT) AS lo, CAST(floor(r / ppp) AS BIGINT) AS rlo, unnest(generate_series(CAST(floor(qp / ppp) AS BIGINT), CAST(floor((qp + len - 1) / ppp) AS BIGINT))) AS pixel FROM b, c),
y AS (SELECT query_id, pixel, strand, rlo + pixel - lo AS ref_pixel, len, row_number() OVER (PARTITION BY query_id, pixel ORDER BY len DESC, seq) AS n FROM x)
SELECT query_id, pixel, strand, ref_pixel, len FROM y WHERE n = 1""")
def mem_map_pixels(spark, sf_dir):
    refs, docs = text_corpus(spark, sf_dir)
    return mapping.map_pixels(matches.find_matches(refs, docs, TEXT_LEN), refs, docs)


@query(f"""WITH {_mem_sql(DNA_LEN, True)},
p AS (SELECT query_id, chars, unnest(generate_series(1, length(chars))) AS pos FROM q),
d AS (SELECT query_id, pos, max(query_pos + len) - pos AS depth FROM p JOIN m USING (query_id) WHERE query_pos <= pos AND pos <= query_pos + len - {DNA_LEN} GROUP BY query_id, pos)
SELECT query_id, pos, CAST(coalesce(depth, 0) AS BIGINT) AS depth FROM p LEFT JOIN d USING (query_id, pos)""")
def matching_statistics(spark, sf_dir):
    refs, docs = dna_corpus(spark, sf_dir)
    return matches.matching_statistics(matches.find_matches(refs, docs, DNA_LEN), docs, DNA_LEN)


# --- k-mers --------------------------------------------------------------------------------

@query(f"WITH {_mem_sql(DNA_LEN, True)} SELECT k AS kmer, count(*) AS n FROM rk WHERE k IN (SELECT k FROM qk) GROUP BY k")
def kmer_count(spark, sf_dir):
    return matches.kmer_counts(*dna_corpus(spark, sf_dir), DNA_LEN)


@query(f"WITH {_mem_sql(DNA_LEN, True)} SELECT k AS kmer, ref_id, p AS ref_pos FROM rk WHERE k IN (SELECT k FROM qk)")
def kmer_locate(spark, sf_dir):
    return matches.kmer_positions(*dna_corpus(spark, sf_dir), DNA_LEN)


@query(f"""WITH r AS (SELECT {_dna('text')} AS t FROM benchmark), x AS (SELECT t, unnest(generate_series(1, length(t) - 2)) AS p FROM r WHERE length(t) >= 3)
SELECT substr(t, p, 3) AS kmer, CASE WHEN p = 1 THEN '$' ELSE substr(t, p - 1, 1) END AS before, count(*) AS n FROM x GROUP BY 1, 2""")
def left_char_histogram(spark, sf_dir):
    return matches.left_char_histogram(dna_corpus(spark, sf_dir)[0], 3)


@query("SELECT c AS letter, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
def char_counts(spark, sf_dir):
    return suffixes.char_counts(matches.spread(text_corpus(spark, sf_dir)[1]))


# --- suffix views --------------------------------------------------------------------------

def _lcp_steps(bits: int = 20) -> str:
    """CTEs that find the common prefix n of s and before bit by bit."""
    steps = [f"n{bits} AS (SELECT *, 0 AS n FROM k)"]
    for b in reversed(range(bits)):
        more = f"length(s) >= n + {1 << b} AND length(before) >= n + {1 << b} AND substr(s, n + 1, {1 << b}) = substr(before, n + 1, {1 << b})"
        steps.append(f"n{b} AS (SELECT * EXCLUDE (n), CASE WHEN {more} THEN n + {1 << b} ELSE n END AS n FROM n{b + 1})")
    return ",\n".join(steps)


def _suffix_sql(last: str) -> str:
    dna = "regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACGT]', 'N', 'g')"
    return f"""WITH RECURSIVE t AS (SELECT string_agg({dna}, 'N' ORDER BY item_id) AS t FROM benchmark),
s AS (SELECT p AS pos, translate(substr(t, p + 1), 'N', '@') AS s, CASE WHEN p = 0 THEN '$' ELSE substr(t, p, 1) END AS bwt FROM (SELECT t, unnest(generate_series(0, length(t))) AS p FROM t)),
k AS (SELECT *, row_number() OVER (ORDER BY s) - 1 AS rank, lag(s) OVER (ORDER BY s) AS before FROM s),
{_lcp_steps()},
l AS (SELECT *, CASE WHEN before IS NULL THEN -1 ELSE n END AS lcp FROM n0)
{last}"""


def _letters(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), S.normalize(F.col("text")).alias("chars"))


def _suffixes(spark, sf_dir):
    return suffixes.suffix_array(_letters(spark, sf_dir))


@query(_suffix_sql("SELECT rank, pos FROM k"))
def suffix_array(spark, sf_dir):
    return _suffixes(spark, sf_dir).select("rank", "pos")


@query(_suffix_sql("SELECT rank, bwt FROM k"))
def bwt(spark, sf_dir):
    return _suffixes(spark, sf_dir).select("rank", "bwt")


@query(_suffix_sql("SELECT rank, CAST(lcp AS BIGINT) AS lcp FROM l"))
def lcp_array(spark, sf_dir):
    return suffixes.lcp_array(_letters(spark, sf_dir)).select("rank", "lcp")


@query(_suffix_sql("SELECT k.rank, n.rank AS jump FROM k JOIN k n ON n.pos = k.pos - 1"))
def lf_mapping(spark, sf_dir):
    return suffixes.lf_mapping(_suffixes(spark, sf_dir)).where("bwt <> '$'").select("rank", "jump")


@query(_suffix_sql("""SELECT a.rank, (SELECT max(b.rank) FROM l b WHERE b.rank < a.rank AND b.lcp < a.lcp) AS previous_smaller,
(SELECT min(b.rank) FROM l b WHERE b.rank > a.rank AND b.lcp < a.lcp) AS next_smaller FROM l a"""))
def smaller_values(spark, sf_dir):
    return suffixes.smaller_values(suffixes.lcp_array(_letters(spark, sf_dir))).select("rank", "previous_smaller", "next_smaller")


@query(_suffix_sql(""", d AS (SELECT rank, greatest(lcp, coalesce(lead(lcp) OVER (ORDER BY rank), -1)) AS depth FROM l)
SELECT rank, CAST(depth AS BIGINT) AS depth, (SELECT coalesce(max(b.rank), 0) FROM l b WHERE b.rank <= d.rank AND b.lcp < d.depth) AS top,
(SELECT coalesce(min(b.rank), (SELECT count(*) FROM l)) - 1 FROM l b WHERE b.rank > d.rank AND b.lcp < d.depth) AS bottom FROM d"""))
def enclosing_intervals(spark, sf_dir):
    return suffixes.enclosing_intervals(suffixes.lcp_array(_letters(spark, sf_dir)))


@query(_suffix_sql("SELECT CAST(sum(lcp) FILTER (lcp > 0) // count(*) AS BIGINT) AS mean_lcp, CAST(max(lcp) AS BIGINT) AS max_lcp, count(*) AS n FROM l"))
def lcp_stats(spark, sf_dir):
    return suffixes.lcp_stats(suffixes.lcp_array(_letters(spark, sf_dir)))


@query(_suffix_sql(""", x AS (SELECT lcp, lcp <> coalesce(lead(lcp) OVER (ORDER BY rank), -1) AS kept FROM l)
SELECT count(*) FILTER (kept) AS n_samples, count(*) FILTER (kept AND (lcp < 0 OR lcp >= 255)) AS n_oversized, CAST(count(*) FILTER (kept) * 10000 // count(*) AS BIGINT) AS share FROM x"""))
def lcp_samples(spark, sf_dir):
    return suffixes.lcp_samples(suffixes.lcp_array(_letters(spark, sf_dir)))


@query(_suffix_sql(""", r AS (SELECT bwt, rank - row_number() OVER (PARTITION BY bwt ORDER BY rank) AS g FROM k), c AS (SELECT bwt, g, count(*) AS n FROM r GROUP BY bwt, g)
SELECT count(*) AS n_runs, max(n) AS longest, (SELECT n FROM c GROUP BY n ORDER BY count(*) DESC, n LIMIT 1) AS most_common FROM c"""))
def bwt_runs(spark, sf_dir):
    return suffixes.bwt_runs(_suffixes(spark, sf_dir))


@query(_suffix_sql("SELECT substr(s, 1, 3) AS prefix, min(rank) AS top, max(rank) AS bottom, count(*) AS n FROM k WHERE length(s) >= 3 GROUP BY 1"))
def suffix_intervals(spark, sf_dir):
    return suffixes.prefix_intervals(_letters(spark, sf_dir), 3)


@query(_suffix_sql("SELECT substr(s, 1, 11) AS prefix, min(rank) AS top, max(rank) AS bottom, count(*) AS n FROM k WHERE length(s) >= 11 GROUP BY 1"))
def long_suffix_intervals(spark, sf_dir):
    """The same for prefixes longer than the rounds of the ranking begin with."""
    return suffixes.prefix_intervals(_letters(spark, sf_dir), 11)


_PATTERNS = """p AS (SELECT doc_id AS id, substr(regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACGT]', 'N', 'g'), 1, CAST(2 + doc_id % 12 AS INTEGER)) AS pattern FROM documents)"""


def _patterns(spark, sf_dir):
    """The first 2 to 13 letters of every document."""
    letters = S.normalize(S.first_letters(F.col("text"), 13))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.left(letters, (2 + F.col("doc_id") % 12).cast("int")).alias("pattern")).where(F.length("pattern") > 0)


@query(_suffix_sql(f""", {_PATTERNS}, u AS (SELECT DISTINCT pattern FROM p), f AS (SELECT pattern, min(rank) AS top, max(rank) AS bottom, count(*) AS n FROM u JOIN k ON substr(k.s, 1, length(pattern)) = translate(pattern, 'N', '@') GROUP BY pattern)
SELECT id, pattern, top, bottom, coalesce(n, 0) AS n FROM p LEFT JOIN f USING (pattern) WHERE length(pattern) > 0"""))
def backward_search(spark, sf_dir):
    """The rank interval of patterns of mixed lengths, all narrowed letter by letter in the same rounds."""
    return suffixes.backward_search(_letters(spark, sf_dir), _patterns(spark, sf_dir))


@query(_suffix_sql(f", {_PATTERNS} SELECT id, pattern, pos FROM p JOIN k ON substr(k.s, 1, length(pattern)) = translate(pattern, 'N', '@') WHERE length(pattern) > 6"))
def pattern_positions(spark, sf_dir):
    """Where patterns of more than six letters occur in the merged references."""
    letters = _letters(spark, sf_dir)
    found = suffixes.backward_search(letters, _patterns(spark, sf_dir).where(F.length("pattern") > 6))
    return suffixes.locate_patterns(found, suffixes.suffix_array(letters))


@query(_suffix_sql(""", i AS (SELECT DISTINCT lcp AS depth, (SELECT max(b.rank) FROM l b WHERE b.rank < a.rank AND b.lcp < a.lcp) AS top,
(SELECT coalesce(min(b.rank), (SELECT count(*) FROM l)) - 1 FROM l b WHERE b.rank > a.rank AND b.lcp < a.lcp) AS bottom FROM l a WHERE lcp >= 0),
j AS (SELECT i.*, p.depth AS parent_depth, p.top AS parent_top, p.bottom AS parent_bottom, row_number() OVER (PARTITION BY i.depth, i.top, i.bottom ORDER BY p.depth DESC) AS n
FROM i LEFT JOIN i p ON p.top <= i.top AND p.bottom >= i.bottom AND p.depth < i.depth)
SELECT CAST(depth AS BIGINT) AS depth, top, CAST(bottom AS BIGINT) AS bottom, CAST(parent_depth AS BIGINT) AS parent_depth, parent_top, CAST(parent_bottom AS BIGINT) AS parent_bottom FROM j WHERE n = 1"""))
def lcp_intervals(spark, sf_dir):
    """All inner intervals of common prefixes with their parents."""
    return suffixes.lcp_intervals(suffixes.lcp_array(_letters(spark, sf_dir)))


# --- names, numbers, files -----------------------------------------------------------------

@query("""SELECT c_name, regexp_replace(c_name, '[^0-9A-Za-z]', '', 'g') AS plain, regexp_replace(c_name, '[^0-9A-Za-z]+', '_', 'g') AS joined,
regexp_replace(c_name, '[^!-~]', '', 'g') AS printable FROM customer""")
def name_normalize(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_name", S.normalize_name(name, 0).alias("plain"), S.normalize_name(name, 1).alias("joined"), S.normalize_name(name, 2).alias("printable"))


@query("""WITH a AS (SELECT s_suppkey, regexp_replace(s_name, '[^0-9A-Za-z]', '', 'g') AS x FROM supplier),
b AS (SELECT n_nationkey, regexp_replace('Supplier#' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0'), '[^0-9A-Za-z]', '', 'g') AS y FROM nation),
s AS (SELECT s_suppkey, n_nationkey, (SELECT coalesce(min(i), least(length(x), length(y)) + 1) - 1 FROM generate_series(1, least(length(x), length(y))) g(i) WHERE substr(x, i, 1) <> substr(y, i, 1)) AS score FROM a, b)
SELECT s_suppkey, n_nationkey, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, n_nationkey) AS n FROM s) WHERE n = 1""")
def fuzzy_name(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    known = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Supplier#"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")).alias("name"))
    return names.closest_names(wanted, "s_suppkey", known, "n_nationkey")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN (o_orderkey * 10 + 5) * 100 WHEN 2 THEN o_orderkey * 1000000 ELSE -1 END AS parsed FROM orders""")
def parse_numbers(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    said = F.when(F.col("o_orderkey") % 4 == 0, key).when(F.col("o_orderkey") % 4 == 1, F.concat(key, F.lit(",5K"))).when(F.col("o_orderkey") % 4 == 2, F.concat(key, F.lit("M"))).otherwise(F.concat(key, F.lit("x")))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.parse_number(said).alias("parsed"))


@query("""WITH n AS (SELECT o_orderkey, o_orderkey * o_orderkey AS n FROM orders)
SELECT o_orderkey, format('{:,}', n) AS thousands,
CASE WHEN n < 1000 THEN n || 'B' WHEN n < 1000000 THEN (n // 1000) || 'KB' WHEN n < 1000000000 THEN (n // 1000000) || 'MB' ELSE (n // 1000000000) || 'GB' END AS bytes,
(CASE WHEN n >= 86400 THEN (n // 86400) || 'D ' ELSE '' END) || (CASE WHEN n >= 3600 THEN (n % 86400 // 3600) || 'H ' ELSE '' END) || (CASE WHEN n >= 60 THEN (n % 3600 // 60) || 'm ' ELSE '' END) || (n % 60) || 's' AS duration,
CAST(length(CAST(n AS VARCHAR)) AS INTEGER) AS digits FROM n""")
def format_numbers(spark, sf_dir):
    n = F.col("n")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey")).alias("n"))
    return rows.select("o_orderkey", S.format_thousands(n).alias("thousands"), S.format_bytes(n).alias("bytes"), S.format_duration(n).alias("duration"), S.digit_count(n).cast("int").alias("digits"))


@query("SELECT doc_id, length(text) AS size, row_number() OVER (ORDER BY length(text), doc_id) AS place FROM documents")
def sort_by_size(spark, sf_dir):
    return names.ordered_by_size(table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("size")), "size", "doc_id")


@query(f"""SELECT CAST(sum(length({_dna('text')})) AS BIGINT) AS kept, CAST(sum(length(regexp_replace(text, '[^!-~]', '', 'g'))) - sum(length({_dna('text')})) AS BIGINT) AS removed, count(*) AS records FROM benchmark""")
def clean_fasta_counts(spark, sf_dir):
    return names.clean_counts(text_corpus(spark, sf_dir)[0])


def queries() -> dict[str, Query]:
    """All registered queries."""
    from memspan.plans import filequeries  # noqa: F401  registers its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    """Their DuckDB statements."""
    queries()
    return dict(_sql)
