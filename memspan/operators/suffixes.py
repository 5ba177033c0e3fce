"""Suffix views of a reference: suffix array, BWT, LCP and what follows from them.

The order comes from prefix doubling: suffixes are ranked by their first ``SEED`` letters, then by
twice as many in each round, where a suffix's second half is the suffix that many letters on. A
rank is the number of smaller suffixes, so a group of equals is refined within itself: each
round is one equi-join and one window partitioned by rank, never a global sort, and ends when
no rank is shared. A round is about suffixes whose rank is still shared; of the others it takes along only those that
they will be compared by. The text itself is a table of pieces, no row holds the whole of it. Matching does not need these views (see :mod:`memspan.operators.matches`).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspan.functions.sequences import collation_key, common_prefix
from memspan.operators.kmers import PIECE, kmers_of_pieces
from memspan.operators.pieces import merged_pieces
from memspan.plans.tables import stored

SEED = 8


def char_counts(df: DataFrame) -> DataFrame:
    """letter and n over column chars."""
    return df.select(F.explode(F.split("chars", "")).alias("letter")).where("letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))


def _heads(refs: DataFrame) -> DataFrame:
    """pos, head (the first SEED letters) and bwt of every suffix of the merged references."""
    pieces = merged_pieces(refs, "N", "$", PIECE, 1, SEED)
    rows = pieces.select("piece", "lead", "s", F.explode(F.sequence(F.lit(0), F.least(F.lit(PIECE), F.length("s") - F.col("lead")) - 1)).alias("o"))
    at = F.col("lead") + F.col("o")
    return rows.select((F.col("piece").cast("long") * PIECE + F.col("o")).alias("pos"), F.regexp_replace(F.substr("s", at + 1, F.lit(SEED)), r"\$.*", "").alias("head"), F.when(at == 0, "$").otherwise(F.substr("s", at, F.lit(1))).alias("bwt"))


def suffix_array(refs: DataFrame) -> DataFrame:
    """rank, pos (0-based) and bwt (the letter before, ``$`` at the start) of the merged
    references, ordered $ < N < A < C < G < T; the empty suffix comes first. No references have no suffixes; null
    texts are left out."""
    return _ranked(refs)[0]


def _ranked(refs: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """The suffix array, the tables (pos, rank, tied) of each round, and the heads.

    The first table holds all suffixes, later ones those still tied before their round, and settled ones that the next two
    rounds may look at: a suffix behind which both are settled is settled itself by then."""
    heads = stored(_heads(refs), "heads")
    counts = heads.groupBy(collation_key(F.col("head")).alias("key")).agg(F.count("*").alias("n"))
    smaller = F.coalesce(F.sum("n").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over distinct heads, at most 6 ** SEED
    ranks = heads.select("pos", collation_key(F.col("head")).alias("key")).join(counts.select("key", smaller.alias("rank"), (F.col("n") > 1).alias("tied")), "key").select("pos", "rank", "tied")
    levels, reach = [stored(ranks, "ranks")], SEED
    settled = [levels[0].where("NOT tied")]
    while levels[-1].where("tied").limit(1).count():
        now = levels[-1]
        ahead = now.select((F.col("pos") - reach).alias("pos"), F.col("rank").alias("next"))
        met = now.where("tied").select("pos", "rank").join(ahead, "pos", "left").withColumn("next", F.coalesce("next", F.lit(-1)))
        within = F.rank().over(Window.partitionBy("rank").orderBy("next")) - 1
        alike = F.count(F.lit(1)).over(Window.partitionBy("rank", "next"))
        new = stored(met.select("pos", (F.col("rank") + within).alias("rank"), (alike > 1).alias("tied")), "ranks")
        settled.append(new.where("NOT tied"))
        reach *= 2
        wanted = new.where("tied").select(F.explode(F.array(F.col("pos") + reach, F.col("pos") + 2 * reach)).alias("pos")).distinct()
        kept = now.where("NOT tied").unionByName(settled[-1]).join(wanted, "pos", "left_semi")
        levels.append(stored(new.where("tied").unionByName(kept), "ranks"))
    array = settled[0]
    for part in settled[1:]:
        array = array.unionByName(part)
    return array.select("pos", "rank").join(heads.select("pos", "bwt"), "pos").select("rank", "pos", "bwt"), levels, heads


def lcp_array(refs: DataFrame) -> DataFrame:
    """rank, pos, bwt and lcp: the common prefix with the suffix ranked before, -1 for the first.

    The rounds of the ranking tell, from the longest to the shortest, whether two suffixes agree
    in as many letters; the heads settle what is left."""
    array, levels, heads = _ranked(refs)
    array = stored(array, "suffixes")
    before = array.select((F.col("rank") + 1).alias("rank"), F.col("pos").alias("other"))
    pairs = array.join(before, "rank", "left").withColumn("lcp", F.lit(0).cast("long"))
    for i in reversed(range(len(levels))):
        tied = levels[i].where("tied")
        a = tied.select(F.col("pos").alias("_a"), F.col("rank").alias("_ra"))
        b = tied.select(F.col("pos").alias("_b"), F.col("rank").alias("_rb"))
        joined = pairs.join(a, F.col("pos") + F.col("lcp") == F.col("_a"), "left").join(b, F.col("other") + F.col("lcp") == F.col("_b"), "left")
        pairs = joined.withColumn("lcp", F.when(F.col("_ra") == F.col("_rb"), F.col("lcp") + (SEED << i)).otherwise(F.col("lcp"))).drop("_a", "_b", "_ra", "_rb")
    a = heads.select(F.col("pos").alias("_a"), F.col("head").alias("_ha"))
    b = heads.select(F.col("pos").alias("_b"), F.col("head").alias("_hb"))
    joined = pairs.join(a, F.col("pos") + F.col("lcp") == F.col("_a"), "left").join(b, F.col("other") + F.col("lcp") == F.col("_b"), "left")
    rest = F.coalesce(common_prefix(F.col("_ha"), F.col("_hb"), SEED), F.lit(0))
    return joined.select("rank", "pos", "bwt", F.when(F.col("other").isNull(), -1).otherwise(F.col("lcp") + rest).cast("long").alias("lcp"))


def lf_mapping(suffixes: DataFrame) -> DataFrame:
    """Adds jump: the rank of the suffix that begins one letter earlier."""
    smaller = suffixes.groupBy("bwt").agg(F.count("*").alias("_n")).withColumn("_c", F.coalesce(F.sum("_n").over(Window.orderBy(F.translate("bwt", "$N", " @")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("bwt").orderBy("rank")) - 1
    return suffixes.withColumn("_o", within).join(F.broadcast(smaller.select("bwt", "_c")), "bwt").withColumn("jump", (F.col("_c") + F.col("_o")).cast("long")).drop("_o", "_c")


#: Ranks searched together.
BLOCK_RANKS = 1 << 16


def _smaller(values: list[int], ranks: list[int]) -> tuple[list, list]:
    """The nearest rank with a smaller value on either side of each (None if there is none), in linear time."""
    found = []
    for order in (range(len(values)), range(len(values) - 1, -1, -1)):
        out, stack = [None] * len(values), []
        for i in order:
            while stack and values[stack[-1]] >= values[i]:
                stack.pop()
            out[i] = ranks[stack[-1]] if stack else None
            stack.append(i)
        found.append(out)
    return found[0], found[1]


def _skyline(values: list[int], backwards: bool) -> list[int]:
    """Places whose value is smaller than all before (behind, if ``backwards``)."""
    out, least = [], None
    for i in range(len(values) - 1, -1, -1) if backwards else range(len(values)):
        if least is None or values[i] < least:
            out.append(i)
            least = values[i]
    return out


def _next_below(least: np.ndarray, blocks: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each block and value the first block behind it whose least value is smaller (-1 if there is none), by leaps of
    falling powers of two over the least values of as many blocks."""
    n, tables = len(least), [least]
    while 2 << len(tables) <= 2 * n:
        half = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    at = blocks + 1
    for k in reversed(range(len(tables))):
        fits = at + (1 << k) <= n
        leap = fits & (tables[k][np.where(fits, at, 0)] >= values)
        at = at + (leap.astype(np.int64) << k)
    return np.where(at < n, at, -1)


def smaller_values(lcps: DataFrame, block: int = BLOCK_RANKS) -> DataFrame:
    """Adds previous_smaller and next_smaller: the nearest ranks with a smaller lcp (null if none).

    Blocks of ranks are searched by themselves, with a stack. What a place does not find in its block lies in
    the nearest block beyond whose least value is smaller; the least values, eight bytes a block, are sent to the tasks to find that block.
    There it is the nearest place that is smaller than all before it (behind it), which a window over that block's
    such places and the values looked for tells. Places of a block with equal values look for the same."""
    import pandas as pd

    schema = "rank long, pos long, lcp long, previous_smaller long, next_smaller long, leads boolean, trails boolean, block long"

    def within(frame):
        frame = frame.sort_values("rank").reset_index(drop=True)
        values = frame["lcp"].tolist()
        before, after = _smaller(values, frame["rank"].tolist())
        out = frame[["rank", "pos", "lcp"]].copy()
        out["previous_smaller"], out["next_smaller"] = before, after
        out["leads"] = out["trails"] = False
        out.loc[_skyline(values, False), "leads"] = True
        out.loc[_skyline(values, True), "trails"] = True
        out["block"] = frame["block"]
        return out.astype({"previous_smaller": "Int64", "next_smaller": "Int64"})

    blocks = lcps.select("rank", "pos", "lcp", F.floor(F.col("rank") / block).alias("block"))
    near = stored(blocks.groupBy("block").applyInPandas(within, schema), "smaller")
    least = np.array([r.least for r in near.groupBy("block").agg(F.min("lcp").alias("least")).orderBy("block").collect()], np.int64)
    held = near.sparkSession.sparkContext.broadcast(least)

    def beyond(backwards: bool):
        def found(frames):
            mins = held.value[::-1] if backwards else held.value
            for frame in frames:
                own = frame["block"].to_numpy()
                there = _next_below(mins, len(mins) - 1 - own if backwards else own, frame["lcp"].to_numpy())
                there = np.where(there < 0, -1, len(mins) - 1 - there) if backwards else there
                yield pd.DataFrame({"block": own, "lcp": frame["lcp"], "there": there})

        return found

    rows = near
    for backwards, missing, skyline, out in ((True, "previous_smaller", "trails", "far_before"), (False, "next_smaller", "leads", "far_after")):
        wanted = near.where(F.col(missing).isNull()).select("block", "lcp").distinct().mapInPandas(beyond(backwards), "block long, lcp long, there long").where("there >= 0")
        wanted = stored(wanted, "wanted")
        places = near.where(skyline).select(F.col("block").alias("there"), "lcp", F.col("rank").alias("place"))
        both = places.unionByName(wanted.select("there", "lcp", F.lit(None).cast("long").alias("place")).distinct())
        smaller = Window.partitionBy("there").orderBy("lcp", F.col("place").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)  # values looked for stand before places of equal ones
        answers = both.withColumn(out, F.last("place", ignorenulls=True).over(smaller)).where("place IS NULL").select("there", "lcp", out)
        rows = rows.join(wanted.join(answers, ["there", "lcp"]).select("block", "lcp", out), ["block", "lcp"], "left")
    return rows.select("rank", "pos", "lcp", F.coalesce("previous_smaller", "far_before").alias("previous_smaller"), F.coalesce("next_smaller", "far_after").alias("next_smaller"))


def enclosing_intervals(lcps: DataFrame) -> DataFrame:
    """rank, depth, top, bottom: the longest prefix a suffix shares with a neighbour, and the rank
    interval of all suffixes that begin with it."""
    near = stored(smaller_values(lcps), "smaller")
    n = near.agg((F.max("rank") + 1).alias("n")).first().n or 0
    ahead = near.select((F.col("rank") - 1).alias("rank"), F.col("lcp").alias("_lcp"), F.col("next_smaller").alias("_next"))
    rows = near.join(ahead, "rank", "left")
    with_next = F.coalesce(F.col("_lcp") > F.col("lcp"), F.lit(False))
    return rows.select(
        "rank",
        F.when(with_next, F.col("_lcp")).otherwise(F.col("lcp")).alias("depth"),
        F.when(with_next, F.col("rank")).otherwise(F.coalesce("previous_smaller", F.lit(0))).alias("top"),
        (F.coalesce(F.when(with_next, F.col("_next")).otherwise(F.col("next_smaller")), F.lit(n)) - 1).cast("long").alias("bottom"),
    )


def lcp_intervals(lcps: DataFrame) -> DataFrame:
    """depth, top, bottom and parent_depth, parent_top, parent_bottom of every inner interval of the tree of common
    prefixes: all suffixes from rank top to bottom, and no others, begin with the same depth letters, and not all with more.

    Each rank lies on the left border of a child of one interval, which reaches to the nearest smaller values on either side. Its parent
    is the interval of that border of its own which has the larger value; the root, of depth 0, has none."""
    near = stored(smaller_values(lcps), "smaller")
    n = near.agg((F.max("rank") + 1).alias("n")).first().n or 0

    def interval(prefix: str) -> list:
        return [F.col("lcp").alias(f"{prefix}depth"), F.col("previous_smaller").alias(f"{prefix}top"), (F.coalesce("next_smaller", F.lit(n)) - 1).cast("long").alias(f"{prefix}bottom")]

    inner = near.where("lcp >= 0").select(*interval("")).distinct()
    left = near.where("lcp >= 0").select(F.col("rank").alias("top"), *interval("l_"))
    right = near.where("lcp >= 0").select((F.col("rank") - 1).alias("bottom"), *interval("r_"))
    met = inner.join(left, "top", "left").join(right, "bottom", "left")
    by_left = F.coalesce(F.col("l_depth"), F.lit(-1)) >= F.coalesce(F.col("r_depth"), F.lit(-1))
    return met.select("depth", "top", "bottom", *(F.when(by_left, F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")).alias(f"parent_{c}") for c in ("depth", "top", "bottom")))


def lcp_stats(lcps: DataFrame) -> DataFrame:
    """mean_lcp (truncated), max_lcp and n over all ranks."""
    return lcps.agg(F.floor(F.sum(F.greatest("lcp", F.lit(0))) / F.count("*")).cast("long").alias("mean_lcp"), F.max("lcp").alias("max_lcp"), F.count("*").alias("n"))


def lcp_samples(lcps: DataFrame, large: int = 255) -> DataFrame:
    """n_samples, n_oversized and hundredths of a percent of all ranks (truncated): how many ranks a sampled array of
    lcps keeps, those whose lcp differs from the next one's (behind the last stands -1), and how many of them hold
    -1 or ``large`` and more."""
    ahead = lcps.select((F.col("rank") - 1).alias("rank"), F.col("lcp").alias("next"))
    kept = lcps.select("rank", "lcp").join(ahead, "rank", "left").select("lcp", (F.col("lcp") != F.coalesce("next", F.lit(-1))).alias("kept"))
    odd = (F.col("lcp") < 0) | (F.col("lcp") >= large)
    sums = kept.agg(F.count_if("kept").alias("n_samples"), F.count_if(F.col("kept") & odd).alias("n_oversized"), F.count("*").alias("n"))
    return sums.select("n_samples", "n_oversized", F.floor(F.col("n_samples") * 10_000 / F.greatest("n", F.lit(1))).alias("share"))


def bwt_runs(suffixes: DataFrame) -> DataFrame:
    """n_runs, longest and most_common (the shorter of equally common lengths) of the runs of equal
    letters in the BWT."""
    run = F.col("rank") - F.row_number().over(Window.partitionBy("bwt").orderBy("rank"))
    lengths = suffixes.withColumn("_g", run).groupBy("bwt", "_g").agg(F.count("*").alias("_n")).groupBy("_n").agg(F.count("*").alias("_k"))
    return lengths.agg(F.sum("_k").alias("n_runs"), F.max("_n").alias("longest"), F.max_by("_n", F.struct("_k", -F.col("_n"))).alias("most_common"))


def prefix_intervals(refs: DataFrame, k: int) -> DataFrame:
    """prefix, top, bottom, n: the rank interval of every prefix of ``k`` letters, however many (N as @)."""
    array = _ranked(refs)[0]
    prefixes = kmers_of_pieces(merged_pieces(refs, "N", ahead=k - 1), PIECE, k)
    rows = prefixes.select("pos", collation_key(F.col("kmer")).alias("prefix")).join(array, "pos")
    return rows.groupBy("prefix").agg(F.min("rank").alias("top"), F.max("rank").alias("bottom"), F.count("*").alias("n"))


#: Ranks in a row of the occurrence table, and such rows that are summed up together.
OCC_RANKS, OCC_ROWS = 256, 4096


def occurrence_table(array: DataFrame) -> DataFrame:
    """block, letters and before: the BWT in blocks of OCC_RANKS ranks and, by letter, how often each stands in the
    blocks before. Counts are summed within groups of blocks, then over the groups, so no task sums up all of them."""
    block = F.floor(F.col("rank") / OCC_RANKS)
    lists = array.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("rank", "bwt"))).alias("l"))  # OCC_RANKS letters
    rows = lists.select("block", F.floor(F.col("block") / OCC_ROWS).alias("group"), F.array_join(F.transform("l", lambda x: x["bwt"]), "").alias("letters"))
    counted = array.groupBy(block.alias("block"), "bwt").agg(F.count("*").alias("n"))
    counted = stored(counted.withColumn("group", F.floor(F.col("block") / OCC_ROWS)), "letters")
    totals = counted.groupBy("group", "bwt").agg(F.sum("n").alias("n"))
    before_group = F.coalesce(F.sum("n").over(Window.partitionBy("bwt").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    letters = F.explode(F.array(*map(F.lit, "$NACGT"))).alias("bwt")  # a row in every group and block, also where it does not stand
    groups = totals.select("group").distinct().select("group", letters).join(totals, ["group", "bwt"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    groups = groups.select("group", "bwt", before_group.alias("far"))
    every = rows.select("block", "group", letters).join(counted.drop("group"), ["block", "bwt"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("group", "bwt").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = every.select("block", "group", "bwt", inside.alias("near")).join(groups, ["group", "bwt"])
    before = sums.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("bwt", (F.col("near") + F.col("far")).alias("n")))).alias("before"))
    return rows.select("block", "letters").join(before, "block")


def backward_search(refs: DataFrame, patterns: DataFrame, rounds_stored: int = 4) -> DataFrame:
    """id, pattern, top, bottom, n of each pattern (id, pattern) of letters A, C, G, T and N: the rank interval of the suffixes that
    begin with it and how many they are; those that do not occur have no rank and n = 0. Null and empty patterns are left out.

    Patterns are read from their ends. One join gives the interval of the last SEED letters, or of all if there
    are fewer; every further letter c narrows [top, bottom] to C(c) plus the occurrences of c before top and before bottom + 1,
    two look-ups in the occurrence table. All patterns take a letter in the same round, whatever their lengths."""
    array, _, heads = _ranked(refs)
    array = stored(array, "suffixes")
    table = stored(occurrence_table(array), "occurrences")
    totals = array.groupBy("bwt").agg(F.count("*").alias("n"))
    first = totals.select(F.col("bwt").alias("c"), F.coalesce(F.sum("n").over(Window.orderBy(F.translate("bwt", "$N", " @")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # a row a letter
    wanted = patterns.where(F.length("pattern") > 0).select("id", "pattern", F.least(F.length("pattern"), F.lit(SEED)).alias("_size"))
    sizes = [r[0] for r in wanted.select("_size").distinct().collect()]  # at most SEED
    some = F.filter(F.array(*map(F.lit, sizes or [SEED])), lambda k: k <= F.length("head"))
    tails = heads.join(array.select("pos", "rank"), "pos").select("head", "rank", F.explode(some).alias("_size")).groupBy(F.left("head", F.col("_size")).alias("_tail")).agg(F.min("rank").alias("top"), F.max("rank").alias("bottom"))
    state = wanted.withColumn("_tail", F.right("pattern", F.col("_size"))).join(tails, "_tail").select("id", "pattern", (F.length("pattern") - F.col("_size")).alias("left"), "top", "bottom")
    state = stored(state, "intervals")
    most = state.agg(F.max("left")).first()[0] or 0

    def occurrences(rows: DataFrame, upto: str, out: str) -> DataFrame:
        """Adds how often letter c stands in the BWT before rank ``upto``."""
        t = table.select(F.col("block").alias("_block"), F.col("letters").alias("_letters"), F.col("before").alias("_before"))
        met = rows.join(t, F.floor((F.col(upto) - 1) / OCC_RANKS) == F.col("_block"), "left")
        inside = F.left("_letters", ((F.col(upto) - 1) % OCC_RANKS + 1).cast("int"))
        here = F.length(inside) - F.length(F.replace(inside, F.col("c"), F.lit("")))
        return met.withColumn(out, F.coalesce(F.try_element_at("_before", F.col("c")) + here, F.lit(0))).drop("_block", "_letters", "_before")

    for k in range(most):
        going = state.where("left > 0").withColumn("c", F.substr("pattern", F.col("left"), F.lit(1))).withColumn("_behind", F.col("bottom") + 1)
        going = occurrences(occurrences(going.join(F.broadcast(first), "c"), "top", "_above"), "_behind", "_below")
        top, bottom = F.col("first") + F.col("_above"), F.col("first") + F.col("_below") - 1
        going = going.select("id", "pattern", (F.col("left") - 1).alias("left"), top.alias("top"), bottom.alias("bottom")).where("top <= bottom")
        state = state.where("left = 0").unionByName(going)
        if k % rounds_stored == rounds_stored - 1:
            state = stored(state, "intervals")
    found = state.select("id", "pattern", "top", "bottom")
    return wanted.join(found, ["id", "pattern"], "left").select("id", "pattern", "top", "bottom", F.coalesce(F.col("bottom") - F.col("top") + 1, F.lit(0)).cast("long").alias("n"))


def locate_patterns(found: DataFrame, array: DataFrame) -> DataFrame:
    """id, pattern and pos (0-based in the merged references) of every occurrence of searched patterns."""
    ranks = found.where("n > 0").select("id", "pattern", F.explode(F.sequence("top", "bottom")).alias("rank"))
    return ranks.join(array.select("rank", "pos"), "rank").select("id", "pattern", "pos")
