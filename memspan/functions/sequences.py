"""Column expressions for sequences, names and numbers; all run inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(chars: Column, acgt_only: bool = False) -> Column:
    """Upper-case ACGT; other ASCII letters become N, or vanish with ``acgt_only``; all other
    characters vanish. Null stays null."""
    if acgt_only:
        return F.upper(F.regexp_replace(chars, "[^ACGTacgt]+", ""))
    return F.regexp_replace(F.upper(F.regexp_replace(chars, "[^A-Za-z]+", "")), "[^ACGT]", "N")


def first_letters(chars: Column, most: int) -> Column:
    """``chars`` up to and with its letter number ``most``, or all letters if there are fewer: what :func:`normalize` makes
    of it begins as what it makes of the whole."""
    return F.regexp_extract(chars, rf"^(?:[^A-Za-z]*+[A-Za-z]){{1,{most}}}", 0)


def reverse_complement(chars: Column) -> Column:
    """The other strand, read forward: A and T, C and G change places, N stays."""
    return F.reverse(F.translate(chars, "ACGT", "TGCA"))


def forward_start(size: Column, query_pos: Column, length: Column) -> Column:
    """1-based start on the forward strand of a match at 1-based ``query_pos`` of the reverse one."""
    return size - (query_pos - 1 + length) + 1


def collation_key(chars: Column) -> Column:
    """Sorts like the suffix order, in which N comes before A."""
    return F.translate(chars, "N", "@")


def normalize_name(name: Column, mode: int = 0) -> Column:
    """0: only alphanumerics; 1: each run of anything else becomes one underscore; 2: printable
    ASCII without blanks."""
    if mode == 0:
        return F.regexp_replace(name, "[^0-9A-Za-z]", "")
    if mode == 1:
        return F.regexp_replace(name, "[^0-9A-Za-z]+", "_")
    return F.regexp_replace(name, "[^!-~]", "")


def parse_number(text: Column) -> Column:
    """``12``, ``1.5K``, ``2,5m`` as a whole number, truncated; -1 for anything else."""
    pattern = r"^([0-9]+)(?:[.,]([0-9]*))?([KMGkmg]?)$"
    digits = F.concat(F.regexp_extract(text, pattern, 1), F.lit("."), F.regexp_extract(text, pattern, 2), F.lit("0"))
    suffix = F.upper(F.regexp_extract(text, pattern, 3))
    scale = F.when(suffix == "K", 1_000).when(suffix == "M", 1_000_000).when(suffix == "G", 1_000_000_000).otherwise(1)
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), F.floor(digits.cast("decimal(28,6)") * scale)).otherwise(-1).cast("long")


def format_thousands(number: Column) -> Column:
    """Whole number with commas between groups of three digits."""
    return F.format_number(number.cast("long"), 0)


def format_bytes(number: Column) -> Column:
    """Whole B, KB, MB or GB, each a thousand of the one before, truncated."""
    n = number.cast("long")

    def whole(unit: int, name: str) -> Column:
        return F.concat(F.floor(n / unit).cast("long").cast("string"), F.lit(name))

    return F.when(n < 1_000, whole(1, "B")).when(n < 1_000_000, whole(1_000, "KB")).when(n < 1_000_000_000, whole(1_000_000, "MB")).otherwise(whole(1_000_000_000, "GB"))


def format_duration(seconds: Column) -> Column:
    """``1D 2H 3m 4s`` with the leading units that are not zero, always with seconds."""
    s = seconds.cast("long")
    parts = ((F.floor(s / 86_400), "D", s >= 86_400), (F.floor(s % 86_400 / 3_600), "H", s >= 3_600), (F.floor(s % 3_600 / 60), "m", s >= 60))
    shown = [F.when(there, F.concat(value.cast("long").cast("string"), F.lit(unit))) for value, unit, there in parts]
    return F.concat_ws(" ", *shown, F.concat((s % 60).cast("string"), F.lit("s")))


def digit_count(number: Column) -> Column:
    """Decimal digits of a whole number, its sign aside."""
    return F.length(F.abs(number.cast("long")).cast("string"))


def common_prefix(a: Column, b: Column, most: int) -> Column:
    """Length of the common prefix of two strings of at most ``most`` characters."""
    steps = F.sequence(F.lit(1), F.lit(most))
    unequal = F.filter(steps, lambda i: (F.length(a) < i) | (F.length(b) < i) | (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
    return F.coalesce(F.try_element_at(unequal, F.lit(1)) - 1, F.lit(most))
