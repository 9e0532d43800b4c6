"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# the six white-space characters that separate words: 0x20 and 0x09 to 0x0D
WHITE_SPACE = " \t\n\x0b\x0c\r"
WHITE_SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words between white space; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_SPACE_RUN))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def unit_interval(key: Column, seed: str) -> Column:
    """A number in [0, 1) that only the key and the seed decide."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, also where lambdas use it many times."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(values: Column, start: int, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of bigints by an associative ``combine``, itself with its last part included.

    Chunks of about the root of the array's size are totalled by themselves, then moved on by what came before
    them: an array of n costs n ** 1.5 copies of a number, not n ** 2.
    """
    none, first = F.array().cast("array<bigint>"), F.lit(start).cast("bigint")
    state = F.struct(first.alias("last"), none.alias("all"))

    def add(acc: Column, value: Column) -> Column:
        return let(combine(acc["last"], value), lambda total: F.struct(
            total.alias("last"), F.concat(acc["all"], F.array(total)).alias("all")))

    def by_chunks(values: Column, step: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.size(values) - 1, step), lambda at: F.aggregate(
            F.slice(values, at + 1, step), state, add, lambda acc: acc["all"]))
        return let(chunks, lambda chunks: F.flatten(F.zip_with(
            chunks, before_each(F.transform(chunks, lambda chunk: F.element_at(chunk, -1))),
            lambda chunk, before: F.transform(chunk, lambda total: combine(before, total)))))

    def before_each(totals: Column) -> Column:
        return let(F.aggregate(totals, state, add, lambda acc: acc["all"]), lambda sums: F.slice(
            F.concat(F.array(first), sums), F.lit(1), F.size(sums)))

    return let(values, lambda values: F.when(F.size(values) > 0, let(
        F.ceil(F.sqrt(F.size(values))).cast("int"), lambda step: by_chunks(values, step))).otherwise(none))
