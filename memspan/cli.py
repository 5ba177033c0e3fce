"""Command line: match, map, sort and clean.

``python -m memspan.cli match [-l N] [-o FILE] [-b] [-n] [-m N] [-r NAME] [--mam] REF QUERY...``
``python -m memspan.cli map MATCHES REF QUERY... -o FILE.bmp``
``python -m memspan.cli sort MATCHES`` and ``python -m memspan.cli clean FASTA``
"""

from __future__ import annotations

import argparse
import resource
import sys
import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspan.operators import mapping, matches, names
from memspan.plans.tables import stored
from memspan.session import build_session
from memspan.sources import bitmap, fasta, matchfile


def _sequences(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Records of several files, or folders of files, with one id over all of them, in the order given (files of a
    folder by name)."""
    found = None
    for k, path in enumerate(paths):
        rows = fasta.read_fasta(spark, path, **options)
        files = rows.select("file").distinct().withColumn("_place", F.row_number().over(Window.orderBy("file")) + k * 4096)  # a row a file
        rows = rows.join(F.broadcast(files), "file").withColumn("id", (F.col("_place").cast("long") * (1 << 40)) + F.col("ord")).drop("_place", "ord")
        found = rows if found is None else found.unionByName(rows)
    return found


def run_match(spark: SparkSession, a: argparse.Namespace) -> int:
    began = time.perf_counter()
    options = {"acgt_only": a.acgt_only, "min_size": a.min_size}
    refs = stored(_sequences(spark, [a.reference], name_contains=a.name, **options), "refs")
    queries = stored(_sequences(spark, a.queries, **options), "queries")  # several steps read them
    if not refs.limit(1).count():
        print("no reference sequence", file=sys.stderr)
        return 1
    if not queries.limit(1).count():
        print("no query sequence", file=sys.stderr)
        return 1
    found = stored(matches.find_matches(refs, queries, a.length, "mam" if a.mam else "mem", a.both, a.boundary, store=True), "matches")
    target = a.output or matchfile.output_name(a.reference)
    matchfile.write_matches(matchfile.match_lines(found, queries, refs, a.both), target)
    total = matches.match_stats_global(found, queries).first()
    print(f"{total.n_matches} matches, mean length {total.mean_len}, {total.mean_per_query} per query, in {target} ({time.perf_counter() - began:.1f} s, peak {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1000} MB)")
    return 0


def run_map(spark: SparkSession, a: argparse.Namespace) -> int:
    refs, queries = _sequences(spark, [a.reference]), _sequences(spark, a.queries)
    if refs.limit(2).count() != 1:
        print("a map needs one reference sequence", file=sys.stderr)
        return 1
    try:
        rows = stored(matchfile.read_matches(spark, a.matches), "read")
    except PySparkException as problem:
        if "not a match line" not in str(problem):
            raise
        print(f"{a.matches} is no match file: {str(problem).splitlines()[0]}", file=sys.stderr)
        return 1
    if rows.where("ref_pos < 1 OR query_pos < 1 OR len < 1").limit(1).count():
        print("matches begin at 1 and have at least one letter", file=sys.stderr)
        return 1
    blocks = rows.select("source", "block", F.col("query_name").alias("name"), "strand").distinct()
    named = queries.select("name", F.col("id").alias("query_id"), F.col("size").alias("_size"))
    met = [names.by_name_in_order(blocks.where(F.col("strand") == s), named, "block", "query_id") for s in "+-"]
    known = stored(met[0].unionByName(met[1]), "blocks")
    unknown = known.where("query_id IS NULL").select("name").limit(1).collect()
    if unknown:
        print(f"no sequence left is named {unknown[0][0]}", file=sys.stderr)
        return 1
    forward = F.when(F.col("strand") == "-", F.col("_size") - (F.col("query_pos") - 1 + F.col("len")) + 1).otherwise(F.col("query_pos"))
    found = rows.where("ref_pos IS NOT NULL").drop("strand").join(known, ["source", "block"]).select("query_id", "strand", F.lit(refs.first().id).alias("ref_id"), "ref_pos", forward.alias("query_pos"), F.col("len").cast("int"))
    sizes = queries.select("id", "size")
    ref_size = refs.first().size
    most = max(ref_size, sizes.agg(F.max("size")).first()[0])
    bars = stored(bitmap.map_bars(mapping.map_pixels(found, refs, queries), sizes, ref_size, most), "bars")
    bitmap.write_map(a.output, bars, bitmap.map_top(spark, ref_size, most))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="memspan", description=__doc__.splitlines()[0])
    parts = top.add_subparsers(dest="command", required=True)
    match = parts.add_parser("match", help="find maximal exact matches")
    match.add_argument("-l", "--length", type=int, default=20)
    match.add_argument("-o", "--output")
    match.add_argument("-b", "--both", action="store_true", help="both strands")
    match.add_argument("-n", "--acgt-only", action="store_true", help="drop all but A, C, G and T")
    match.add_argument("-m", "--min-size", type=int, default=0)
    match.add_argument("-r", "--name", help="only references whose name contains this")
    match.add_argument("--mem", action="store_true", help="all matches (the default)")
    match.add_argument("--mam", action="store_true", help="only matches that are unique in the references")
    match.add_argument("--boundary", choices=("isolated", "merged"), default="isolated")
    match.add_argument("reference")
    match.add_argument("queries", nargs="+")
    draw = parts.add_parser("map", help="draw a match file")
    draw.add_argument("-o", "--output", required=True)
    draw.add_argument("matches")
    draw.add_argument("reference")
    draw.add_argument("queries", nargs="+")
    order = parts.add_parser("sort", help="sort a match file")
    order.add_argument("matches")
    clean = parts.add_parser("clean", help="keep only A, C, G and T of a file")
    clean.add_argument("fasta")
    return top


def spanned(argv: list[str]) -> list[str]:
    """Options without regard to case, and the name behind ``-r`` as one argument: if it begins with a quotation
    mark, it reaches to the next one, over several arguments if need be."""
    out: list[str] = []
    k = 0
    while k < len(argv):
        arg = argv[k]
        if arg[:1] == "-" and arg[1:2].isalpha() or arg[:2] == "--":
            arg = arg.lower()
        out.append({"-mem": "--mem", "-mam": "--mam"}.get(arg, arg))
        k += 1
        if arg in ("-r", "--name") and k < len(argv) and argv[k][:1] in ("'", '"') and argv[k]:
            quote, words = argv[k][0], [argv[k][1:]]
            while quote not in words[-1] and k + 1 < len(argv):
                k += 1
                words.append(argv[k])
            out.append(" ".join(words).split(quote)[0])
            k += 1
        elif arg in ("-o", "--output", "-r", "--name", "-l", "--length", "-m", "--min-size") and k < len(argv):
            out.append(argv[k])
            k += 1
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(spanned(sys.argv[1:] if argv is None else argv))
    spark = spark or build_session()
    if a.command == "match":
        return run_match(spark, a)
    if a.command == "map":
        return run_map(spark, a)
    if a.command == "sort":
        print(matchfile.sort_match_file(spark, a.matches))
        return 0
    counts = fasta.clean_fasta(spark, a.fasta, matchfile.output_name(a.fasta, "-clean.fasta")).first()
    print(f"{counts.kept} kept, {counts.removed} removed, {counts.records} records")
    return 0


if __name__ == "__main__":
    sys.exit(main())
