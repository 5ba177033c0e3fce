"""Maximal exact matches between reference and query texts.

A match is a pair of equal substrings of at least ``min_len`` characters that can be extended
neither to the left nor to the right. With ``stride + k - 1 = min_len`` every such match covers a
query k-mer at a multiple of ``stride``, so only those are joined with the reference's k-mers
(all positions). Hits on one diagonal at consecutive multiples overlap (``k > stride``), hence an
unbroken run of them is one match; less than ``stride`` characters of context settle its
ends. For short ``min_len`` the stride is 1 and the k-mer the whole minimal match; one letter on either
side tells whether a hit is the first or the last of its match, and only those leave the join, at
most two a match: along a diagonal each last one closes the first one before it.

Shuffles: none for the join if the reference's k-mers are small (their bytes are reckoned first), else one on
the k-mer hash, of query k-mers that pass a filter of the references' (up to some 16 million letters; beyond, of all); one of the hits on the diagonal, which serves window and aggregation alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspan.functions.sequences import common_prefix, reverse_complement
from memspan.operators.kmers import PIECE, kmers, kmers_of_pieces, spread
from memspan.operators.pieces import merged_offsets, merged_pieces
from memspan.operators.scans import BLOCK, covered_blocks, numbered
from memspan.plans.tables import stored

#: Bytes of the reference's k-mers up to which they are broadcast, and of a row besides its letters.
BROADCAST_BYTES, ROW_BYTES = 128_000_000, 64
#: Bits of the filter of k-mers for each letter, and rows of 64 bits that it may have (some 100 MB as a table of the executors').
FILTER_BITS, FILTER_WORDS = 8, 1 << 21
DIAGONAL = ("query_id", "strand", "ref_id", "_diag")


def letters_of(refs: DataFrame) -> int:
    """Characters of all references."""
    return refs.agg(F.sum(F.length("chars"))).first()[0] or 0


def _told_of(refs: DataFrame, k: int) -> tuple[int, bool]:
    """Characters of all references, and whether any has a run of one, two or three letters again and again that k-mers can lie inside of."""
    again = "|".join(f"(.{{{p}}})\\{p}{{{(k + 2) // p - 1},}}" for p in (1, 2, 3) if p < k)
    found = refs.agg(F.sum(F.length("chars")).alias("n"), F.max(F.col("chars").rlike(f"(?s){again}")).alias("again") if again else F.lit(True).alias("again")).first()
    return found.n or 0, bool(found.again)


def fits_broadcast(refs: DataFrame, letters: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a row of ``letters`` characters for each character of the references is small enough."""
    return letters_of(refs) * (letters + ROW_BYTES) <= limit


def seed_shape(min_len: int) -> tuple[int, int]:
    """(k, stride) for a least match length."""
    return (min_len, 1) if min_len < 32 else (min_len // 2 + 1, min_len - min_len // 2)


def with_strands(queries: DataFrame, both: bool) -> DataFrame:
    """Adds ``strand`` ('+', and '-' with the reverse complement if ``both``)."""
    if not both:
        return queries.withColumn("strand", F.lit("+"))
    strands = F.array(F.struct(F.lit("+").alias("strand"), F.col("chars").alias("chars")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("chars")).alias("chars")))
    return queries.withColumn("_s", F.explode(strands)).withColumn("strand", F.col("_s.strand")).withColumn("chars", F.col("_s.chars")).drop("_s")


def find_matches(refs: DataFrame, queries: DataFrame, min_len: int = 20, kind: str = "mem", both_strands: bool = False, boundary: str = "isolated", broadcast_bytes: int = BROADCAST_BYTES, store: bool = False) -> DataFrame:
    """query_id, strand, ref_id, ref_pos, query_pos (1-based, in the strand's own coordinates), len.

    ``refs`` and ``queries`` have columns id and chars. ``kind`` is ``mem``, ``mam`` (the string
    occurs once in all references) or ``mum`` (once in all references and once in the query).
    ``boundary`` 'merged' joins the references into one text with an N between (ordered by
    column ord if there is one, else by id); a match is then given to the reference it starts in. With ``store``, the ends of
    isolated matches of a short least length are stored first, so that matches of just that length, which are most, are not shuffled.
    """
    if kind not in ("mem", "mam", "mum"):
        raise ValueError(f"no such kind of match: {kind}")
    if boundary == "merged":
        found = _merged(refs, queries, min_len, both_strands, broadcast_bytes)
    elif boundary == "isolated":
        found = _maximal(refs.select(F.col("id").alias("ref_id"), "chars"), queries, min_len, both_strands, broadcast_bytes, store)
    else:
        raise ValueError(f"no such boundary: {boundary}")
    if kind != "mem":
        found = unique_matches(found)
    if kind == "mum":
        found = unique_in_query(found)
    return found


def _maximal(refs: DataFrame, queries: DataFrame, min_len: int, both_strands: bool, broadcast_bytes: int, store: bool = False) -> DataFrame:
    k, stride = seed_shape(min_len)
    total, repetitive = _told_of(refs, k)
    small = total * (k + 2 * stride + ROW_BYTES) <= broadcast_bytes
    return _met(kmers(refs if small else spread(refs), "chars", k, 1, stride, ("ref_id",)), total, repetitive, small, queries, min_len, both_strands, store)


def kmer_filter(hashes: DataFrame, letters: int) -> DataFrame | None:
    """word and bits: a filter of column _h with FILTER_BITS bits a letter (rounded up), one row for each 64 of them that
    are not all zero; none if that would take more than FILTER_WORDS rows."""
    words = 1 << max(0, (letters * FILTER_BITS // 64)).bit_length()
    if words > FILTER_WORDS:
        return None
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_h").bitwiseAND(63).cast("int"))
    return hashes.select(_word(words).alias("_word"), bit.alias("bit")).groupBy("_word").agg(F.bit_or("bit").alias("_bits"))


def _word(words: int) -> Column:
    return F.shiftrightunsigned("_h", 6).bitwiseAND(words - 1)


def passing(rows: DataFrame, table: DataFrame, letters: int) -> DataFrame:
    """Rows whose hash _h the filter may hold: all that it was made of, and few others."""
    words = 1 << max(0, (letters * FILTER_BITS // 64)).bit_length()
    met = rows.withColumn("_word", _word(words)).join(F.broadcast(table.select("_word", "_bits")), "_word")
    return met.where(F.call_function("shiftrightunsigned", F.col("_bits"), F.col("_h").bitwiseAND(63).cast("int")).bitwiseAND(1) == 1).drop("_word", "_bits")


def _met(r: DataFrame, total: int, repetitive: bool, small: bool, queries: DataFrame, min_len: int, both_strands: bool, store: bool = False) -> DataFrame:
    """Matches of queries with the references of ``total`` letters whose k-mers are ``r``; ``repetitive`` tells whether keys that keep
    runs apart are worth their cost, the matches are the same. Where both sides are shuffled, a filter of the
    references' k-mers goes first, so that of the queries' k-mers little more than those that match are shuffled."""
    k, stride = seed_shape(min_len)
    r = r.withColumn("_h", F.xxhash64("kmer"))
    q = with_strands(spread(queries.select(F.col("id").alias("query_id"), "chars")), both_strands)
    q = kmers(q, "chars", k, stride, stride, ("query_id", "strand")).withColumn("_h", F.xxhash64("kmer"))
    held = None if small else kmer_filter(r.select("_h"), total)
    if held is not None:
        q = passing(q, held, total)
    elif small and stride == 1:  # most are of no use: they go before their context is cut out
        q = q.join(F.broadcast(r.select("_h").distinct()), "_h", "left_semi")
    if stride == 1 and repetitive:
        r, q = _apart(r, q, k)
    r = r.select("ref_id", "_h", *(F.col(n).alias(f"_r_{n}") for n in ("pos", "kmer", "left", "right")))
    hits = q.join(F.broadcast(r) if small else r, "_h").where("kmer = _r_kmer").drop("kmer", "_r_kmer", "_h")
    hits = hits.withColumn("_diag", F.col("_r_pos") - F.col("pos"))
    return _closed(hits, min_len, store) if stride == 1 else _runs(hits, min_len, k, stride)


def _apart(r: DataFrame, q: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Keys by which k-mers inside runs of one, two or three letters again and again never meet each other.

    Two equal ones inside such runs have equal letters on either side, so they are neither first nor last of a match; but runs of a and
    b letters would make a x b pairs of them. Inside ones of the references have a key of their own, which only those
    k-mers of the queries look up, besides their own, that stand at the ends of such runs."""
    def again(period: int) -> tuple[Column, Column]:
        """Whether a k-mer repeats itself by so many letters, and whether the letters beside it go on with that."""
        repeats = F.col("kmer").startswith(F.substr("kmer", F.lit(period + 1)))
        return repeats, repeats & (F.col("left") == F.substr("kmer", F.lit(period), F.lit(1))) & (F.col("right") == F.substr("kmer", F.lit(k - period + 1), F.lit(1)))

    found = [again(period) for period in (1, 2, 3) if period < k]
    some, inside = F.lit(False), F.lit(False)
    for repeats, goes_on in reversed(found):  # by the shortest period that a k-mer has
        some, inside = some | repeats, F.when(repeats, goes_on).otherwise(inside)
    other = F.col("_h").bitwiseXOR(F.lit(1).cast("long"))
    keys = F.when(some & ~inside, F.array("_h", other)).otherwise(F.array("_h"))
    return r.withColumn("_h", F.when(inside, other).otherwise(F.col("_h"))), q.withColumn("_h", F.explode(keys))


def _closed(hits: DataFrame, min_len: int, store: bool = False) -> DataFrame:
    """Matches from hits of the whole least length: first and last hits, paired along each diagonal. A hit that is both is a match of
    its own; if the ends are stored, only the others are shuffled."""
    first = (F.col("left") == "") | (F.col("_r_left") == "") | (F.col("left") != F.col("_r_left"))
    last = (F.col("right") == "") | (F.col("_r_right") == "") | (F.col("right") != F.col("_r_right"))
    ends = hits.where(first | last).select(*DIAGONAL, "pos", F.when(first, F.col("pos")).alias("_first"), last.alias("_last"))
    alone = None
    if store:
        ends = stored(ends, "ends")
        whole = F.col("_first").isNotNull() & F.col("_last")
        alone, ends = ends.where(whole).withColumn("_from", F.col("pos")), ends.where(~whole)
    opened = F.max("_first").over(Window.partitionBy(*DIAGONAL).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    runs = ends.withColumn("_from", opened).where("_last")
    runs = runs if alone is None else alone.unionByName(runs)
    length = F.col("pos") - F.col("_from") + min_len
    return runs.select("query_id", "strand", "ref_id", (F.col("_from") + F.col("_diag") + 1).alias("ref_pos"), (F.col("_from") + 1).alias("query_pos"), length.cast("int").alias("len"))


def _runs(hits: DataFrame, min_len: int, k: int, stride: int, block_size: int = BLOCK) -> DataFrame:
    """Matches from hits at multiples of ``stride``: unbroken runs along each diagonal, lengthened by their context. Runs
    are found in blocks of positions, then those of neighbouring blocks are joined."""
    near = ("left", "_r_left", "right", "_r_right")
    block = F.floor(F.col("pos") / block_size).alias("_block")
    run = F.col("pos") - stride * F.row_number().over(Window.partitionBy(*DIAGONAL, "_block").orderBy("pos"))
    ends = [F.min("pos").alias("_first"), F.max("pos").alias("_last"), *(F.min_by(n, "pos").alias(n) for n in near[:2]), *(F.max_by(n, "pos").alias(n) for n in near[2:])]
    runs = hits.withColumn("_block", block).withColumn("_run", run).groupBy(*DIAGONAL, "_block", "_run").agg(*ends)
    # a run that reaches the end of its block goes on in the next one: a row a block of each diagonal's long matches
    order = Window.partitionBy(*DIAGONAL).orderBy("_first")
    begins = F.coalesce(F.lag("_last").over(order) + stride != F.col("_first"), F.lit(True))
    runs = runs.withColumn("_begins", begins.cast("int")).withColumn("_run", F.sum("_begins").over(order)).groupBy(*DIAGONAL, "_run")
    runs = runs.agg(F.min("_first").alias("_from"), F.max("_last").alias("_last"), *(F.min_by(n, "_first").alias(n) for n in near[:2]), *(F.max_by(n, "_first").alias(n) for n in near[2:])).withColumnRenamed("_from", "_first")
    before = common_prefix(F.col("left"), F.col("_r_left"), stride)
    behind = common_prefix(F.col("right"), F.col("_r_right"), stride)
    runs = runs.select(*DIAGONAL, (F.col("_first") - before).alias("_q"), (F.col("_last") - F.col("_first") + k + before + behind).alias("len"))
    return runs.where(F.col("len") >= min_len).select("query_id", "strand", "ref_id", (F.col("_q") + F.col("_diag") + 1).alias("ref_pos"), (F.col("_q") + 1).alias("query_pos"), F.col("len").cast("int").alias("len"))


def locate_reference(positions: DataFrame, offsets: DataFrame, pos: str = "pos", width: int = 4096) -> DataFrame:
    """Adds ref_id and local_pos to 0-based positions of the merged text; a separator belongs to
    the reference before it.

    A range join by bins: a reference has a row for each bin of ``width`` positions it reaches into,
    so positions meet it by an equi-join on the bin."""
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("size")) / width))).alias("_bin")
    spans = offsets.select(F.col("id").alias("ref_id"), F.col("start").alias("_start"), "size", bins)
    met = positions.withColumn("_bin", F.floor(F.col(pos) / width)).join(spans, "_bin")
    inside = (F.col(pos) >= F.col("_start")) & (F.col(pos) < F.col("_start") + F.col("size") + 1)
    return met.where(inside).withColumn("local_pos", F.col(pos) - F.col("_start")).drop("_start", "size", "_bin")


def _merged(refs: DataFrame, queries: DataFrame, min_len: int, both_strands: bool, broadcast_bytes: int) -> DataFrame:
    k, stride = seed_shape(min_len)
    total, repetitive = _told_of(refs, k)
    small = total * (k + 2 * stride + ROW_BYTES) <= broadcast_bytes
    pieces = merged_pieces(refs, "N", before=stride, ahead=k - 1 + stride)
    r = kmers_of_pieces(pieces, PIECE, k, 1, stride).withColumn("ref_id", F.lit(0))
    found = _met(r, total, repetitive, small, queries, min_len, both_strands)
    placed = locate_reference(found.drop("ref_id").withColumn("_at", F.col("ref_pos") - 1), merged_offsets(refs), "_at")
    return placed.select("query_id", "strand", "ref_id", (F.col("local_pos") + 1).alias("ref_pos"), "query_pos", "len")


def _not_contained(matches: DataFrame, group: tuple[str, ...], pos: str, block_size: int) -> DataFrame:
    """Matches whose interval from ``pos`` no other one of their group contains or equals.

    A match that contains another covers the block of positions in which the other begins. So matches visit all blocks
    they cover, and a running maximum of ends within each block decides: one shuffle, on group and block."""
    rows = covered_blocks(matches.withColumn("_end", F.col(pos) + F.col("len")), pos, "_end", block_size)
    inside = Window.partitionBy(*group, "_block")
    seen = F.max("_end").over(inside.orderBy(pos, F.desc("_end")).rowsBetween(Window.unboundedPreceding, -1))
    alike = F.count(F.lit(1)).over(Window.partitionBy(*group, "_block", pos, "_end"))
    out = rows.withColumn("_n", alike).withColumn("_seen", seen).where("_home")
    return out.where((F.col("_n") == 1) & (F.coalesce("_seen", F.lit(-1)) < F.col("_end"))).select(*matches.columns)


def unique_matches(matches: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """Matches whose string occurs once in all references: those that no other match of the same
    query and strand contains, nor equals, on the query side."""
    return _not_contained(matches, ("query_id", "strand"), "query_pos", block_size)


def unique_in_query(matches: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """Of reference-unique matches, those whose string also occurs once in the query: no other of
    them contains its reference interval."""
    return _not_contained(matches, ("query_id", "strand", "ref_id"), "ref_pos", block_size)


def match_stats(matches: DataFrame, queries: DataFrame, both_strands: bool = False) -> DataFrame:
    """query_id, strand, n_matches, total_len, mean_len (truncated) for every query and strand,
    zeros where nothing matches."""
    every = queries.select(F.col("id").alias("query_id"), F.explode(F.array(*(F.lit(s) for s in ("+-" if both_strands else "+")))).alias("strand"))
    sums = matches.groupBy("query_id", "strand").agg(F.count("*").alias("n_matches"), F.sum("len").alias("total_len"))
    n, total = F.coalesce("n_matches", F.lit(0)), F.coalesce("total_len", F.lit(0))
    return every.join(sums, ["query_id", "strand"], "left").select("query_id", "strand", n.alias("n_matches"), total.alias("total_len"), F.when(n > 0, F.floor(total / n)).otherwise(0).cast("long").alias("mean_len"))


def match_stats_global(matches: DataFrame, queries: DataFrame) -> DataFrame:
    """n_queries, n_matches, mean_per_query and mean_len over everything (both truncated, 0 if there is nothing)."""
    rows = matches.select("len", F.lit(0).alias("_q")).unionByName(queries.select(F.lit(None).cast("int").alias("len"), F.lit(1).alias("_q")))
    sums = rows.agg(F.sum("_q").alias("n_queries"), F.count("len").alias("n_matches"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_len"))

    def mean(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.floor(F.col(a) / F.col(b))).otherwise(0).cast("long")

    return sums.select(F.coalesce("n_queries", F.lit(0)).alias("n_queries"), "n_matches", mean("n_matches", "n_queries").alias("mean_per_query"), mean("total_len", "n_matches").alias("mean_len"))


def sort_matches(matches: DataFrame, block: tuple[str, ...] = ("query_id", "strand")) -> DataFrame:
    """Rank within each block, descending by reference name, reference position and query position; a block of any size
    is numbered in parts (see :func:`memspan.operators.scans.numbered`)."""
    return numbered(matches, block, (("ref_id", True), ("ref_pos", True), ("query_pos", True), ("len", True)), "ref_pos", "rank")


def output_order(matches: DataFrame) -> DataFrame:
    """The order in which matches are reported: by query, strand, then from the query's end."""
    return matches.orderBy("query_id", "strand", F.desc("query_pos"), F.desc("len"), "ref_id", "ref_pos")


def matching_statistics(matches: DataFrame, queries: DataFrame, min_len: int, block_size: int = BLOCK) -> DataFrame:
    """query_id, pos (1-based), depth: for each position of a query (forward strand) the longest
    match that starts there, 0 below ``min_len``.

    The longest match at a place ends where the farthest match that starts there or before ends; so places
    between two starts share an end, and each place is made once however many matches cover it. Blocks of a
    query's positions are worked on by themselves, with the matches that reach into them and a start at the block's
    beginning, so that every place follows some start: only starts are shuffled, never places."""
    forward = covered_blocks(matches.where("strand = '+'").select("query_id", "query_pos", (F.col("query_pos") + F.col("len")).alias("_end")), "query_pos", "_end", block_size)
    first = F.greatest(F.col("query_pos"), F.col("_block") * block_size)  # a match from an earlier block begins with this one
    starts = forward.select("query_id", "_block", first.alias("query_pos"), "_end", F.lit(None).cast("long").alias("_stop"))
    sized = queries.select(F.col("id").alias("query_id"), F.length("chars").cast("long").alias("_size"))
    blocks = sized.where("_size > 0").select("query_id", "_size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_size") / block_size))).alias("_block"))
    stop = F.least(F.col("_size") + 1, (F.col("_block") + 1) * block_size)
    every = blocks.select("query_id", "_block", F.greatest(F.col("_block") * block_size, F.lit(1).cast("long")).alias("query_pos"), F.lit(0).cast("long").alias("_end"), stop.alias("_stop"))
    starts = starts.unionByName(every).repartition("query_id", "_block").groupBy("query_id", "_block", "query_pos").agg(F.max("_end").alias("_end"), F.collect_list("_stop").alias("_stops"))
    order = Window.partitionBy("query_id", "_block").orderBy("query_pos")
    far = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.coalesce(F.lead("query_pos").over(order), (F.col("_block") + 1) * block_size)
    stops = F.first("_stops").over(order.rowsBetween(Window.unboundedPreceding, 0))  # the block's first row has one for each query of this id
    steps = starts.select("query_id", "query_pos", far.alias("_far"), behind.alias("_next"), stops.alias("_stops"))
    steps = steps.select("query_id", "query_pos", "_far", F.explode(F.transform("_stops", lambda x: F.least(x, F.col("_next")) - 1)).alias("_last")).where("_last >= query_pos")
    places = steps.select("query_id", F.explode(F.sequence("query_pos", "_last")).alias("pos"), "_far")
    depth = F.col("_far") - F.col("pos")
    return places.select("query_id", "pos", F.when(depth >= min_len, depth).otherwise(0).cast("long").alias("depth"))


def _shared_kmers(refs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k-mers that a reference and a query have: queries meet the references' first, so that only those
    both have are shuffled."""
    known = kmers(refs, "chars", k).select("kmer").distinct()
    known = F.broadcast(known) if fits_broadcast(refs, k) else known
    return kmers(spread(queries), "chars", k).select("kmer").join(known, "kmer", "left_semi").distinct()


def kmer_counts(refs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """kmer and how often it occurs in the references, for every k-mer of a query that does."""
    counts = kmers(refs, "chars", k).groupBy("kmer").agg(F.count("*").alias("n"))
    return counts.join(_shared_kmers(refs, queries, k), "kmer", "left_semi")


def kmer_positions(refs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """kmer, ref_id and ref_pos (1-based) of every occurrence in the references of a query's k-mers."""
    r = kmers(refs.select(F.col("id").alias("ref_id"), "chars"), "chars", k, keep=("ref_id",))
    return r.join(_shared_kmers(refs, queries, k), "kmer", "left_semi").select("kmer", "ref_id", (F.col("pos") + 1).alias("ref_pos"))


def match_context(matches: DataFrame, refs: DataFrame, queries: DataFrame, show: int = 4) -> DataFrame:
    """Adds ref_context and query_context: the letter before (lower-cased, ``$`` at an end), the first and
    the last ``show`` letters of the match, and the letter behind. ``queries`` have a column strand if both strands were
    searched (see :func:`with_strands`)."""
    size = F.col("len")

    def begin(pos: str) -> Column:
        return F.greatest(F.least(F.col(pos).cast("int") - 1, F.col(pos).cast("int") + size - show), F.lit(1))

    def near(chars: str, pos: str) -> Column:
        """The match with a letter on either side, and more if it has less than ``show``: letters are counted from a text's start once."""
        return F.substr(F.col(chars), begin(pos), F.greatest(F.col(pos).cast("int") + size + 1, F.col(pos).cast("int") + show) - begin(pos))

    def around(text: str, pos: str) -> Column:
        start = F.col(pos).cast("int") - begin(pos) + 1
        text = F.col(text)
        before = F.when(F.col(pos) == 1, "$").otherwise(F.lower(F.substr(text, start - 1, F.lit(1))))
        behind = F.when(start + size > F.length(text), "$").otherwise(F.lower(F.substr(text, start + size, F.lit(1))))
        first = F.substr(text, start, F.lit(show))
        last = F.substr(text, F.greatest(start + size - show, F.lit(1)), F.lit(show))
        return F.concat(before, first, F.lit("..."), last, behind)

    r = refs.select(F.col("id").alias("ref_id"), F.col("chars").alias("_r"))
    q = queries if "strand" in queries.columns else queries.withColumn("strand", F.lit("+"))
    met = matches.join(q.select(F.col("id").alias("query_id"), "strand", F.col("chars").alias("_q")), ["query_id", "strand"]).join(r, "ref_id")
    met = met.select(*matches.columns, near("_r", "ref_pos").alias("_r"), near("_q", "query_pos").alias("_q"))
    return met.select(*matches.columns, around("_r", "ref_pos").alias("ref_context"), around("_q", "query_pos").alias("query_context"))


def left_char_histogram(refs: DataFrame, k: int) -> DataFrame:
    """kmer and how often each letter (``$`` at a start) stands before it."""
    rows = kmers(refs, "chars", k, context=1).select("kmer", F.when(F.length("left") == 0, "$").otherwise(F.col("left")).alias("before"))
    return rows.groupBy("kmer", "before").agg(F.count("*").alias("n"))
