from pyspark.sql import functions as F

from memspan.functions import sequences as S
from memspan.operators import names


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_sequences(spark):
    assert one(spark, S.normalize, "aC g\tRYx-1é>") == "ACGNNN"
    assert one(spark, lambda c: S.normalize(c, True), "aC g\tRYx-1é>") == "ACG"
    assert one(spark, S.normalize, None) is None
    assert one(spark, S.reverse_complement, "AACGTN") == "NACGTT"
    assert one(spark, lambda c: S.common_prefix(c, F.lit("abcx"), 6), "abcd") == 3
    assert one(spark, lambda c: S.common_prefix(c, F.lit("abcdefgh"), 6), "abcdefzz") == 6
    assert one(spark, lambda c: S.common_prefix(c, F.lit(""), 6), "") == 0


def test_names_and_numbers(spark):
    assert [one(spark, lambda c, m=m: S.normalize_name(c, m), "a b--c_d\té") for m in range(3)] == ["abcd", "a_b_c_d_", "ab--c_d"]
    wanted = {"12": 12, "1.5K": 1500, "2,5m": 2_500_000, "1G": 10**9, "1.2345K": 1234, "x": -1, "": -1, "1.5.5": -1, "5KK": -1, None: -1}
    assert {k: one(spark, S.parse_number, k) for k in wanted} == wanted
    assert one(spark, S.format_thousands, 1234567, "long") == "1,234,567"
    assert [one(spark, S.format_bytes, n, "long") for n in (999, 1000, 1_999_999, 2 * 10**9)] == ["999B", "1KB", "1MB", "2GB"]
    assert [one(spark, S.format_duration, n, "long") for n in (5, 65, 3600, 90061)] == ["5s", "1m 5s", "1H 0m 0s", "1D 1H 1m 1s"]
    assert [one(spark, S.digit_count, n, "long") for n in (0, 9, -10, 12345)] == [1, 1, 2, 5]


def test_look_ups(spark):
    wanted = spark.createDataFrame([(1, "chr-1a"), (2, "zz"), (3, "")], "w long, name string")
    known = spark.createDataFrame([(10, "chr1"), (11, "chr1ab"), (12, "chr2")], "k long, name string")
    assert {(r.w, r.k, r.score) for r in names.closest_names(wanted, "w", known, "k").collect()} == {(1, 11, 5), (2, 10, 0), (3, 10, 0)}
    joined, unknown = names.by_exact_name(wanted, known.withColumnRenamed("name", "name"))
    assert joined.count() == 0 and unknown.count() == 3
    sized = spark.createDataFrame([(1, 5), (2, 3), (3, 5)], "k long, size long")
    assert [(r.k, r.place) for r in names.ordered_by_size(sized, "size", "k").orderBy("place").collect()] == [(2, 1), (1, 2), (3, 3)]


def test_first_letters(spark):
    for text in ("aC g\tRYx-1é>", "", "1 2 3", "--ab", "é" * 50_000 + "ab" + "-" * 50_000, None):
        whole = one(spark, S.normalize, text)
        for n in (1, 3, 13):
            assert one(spark, lambda c, n=n: F.left(S.normalize(S.first_letters(c, n)), F.lit(n)), text) == (None if whole is None else whole[:n])
