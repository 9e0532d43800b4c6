"""Jump consistent hashing: a stable key and the number of shards decide the shard, without a ring table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from runcast.session import materialize

# the multiplier of the generator in Lamping and Veach's jump hash, fixed value
MULTIPLIER = 2862933555777941757
COPIES = 1 << 16  # equal rows laid out by one row of a task
SLICES = 4096  # slots are numbered within this many slices of a shard, so no shard is sorted by one task
_MASK = (1 << 32) - 1
_C_HIGH, _C_LOW1, _C_LOW0 = MULTIPLIER >> 32, (MULTIPLIER >> 16) & 0xFFFF, MULTIPLIER & 0xFFFF


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _low32(value: Column) -> Column:
    return value.bitwiseAND(_long(_MASK))


def _times_constant(x: Column, high: int, low: int) -> Column:
    """x * (high * 2**16 + low) modulo 2**48 for a 32-bit x; no product leaves 63 bits."""
    upper = (x * _long(high)).bitwiseAND(_long(_MASK))
    return x * _long(low) + upper * _long(1 << 16)


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """state * MULTIPLIER + 1 modulo 2**64, the state held as two 32-bit halves (overflow-safe under ANSI rules)."""
    p0, p1 = low * _long(_C_LOW0), low * _long(_C_LOW1)
    low_sum = p0 + (p1.bitwiseAND(_long(0xFFFF))) * _long(1 << 16) + _long(1)
    carry = F.shiftright(low_sum, 32) + F.shiftright(p1, 16)
    cross = _low32(_times_constant(low, _C_HIGH >> 16, _C_HIGH & 0xFFFF))
    own = _low32(_times_constant(high, _C_LOW1, _C_LOW0))
    return _low32(carry + cross + own), _low32(low_sum)


def stable_key(rows: DataFrame, key_col: str) -> Column:
    """The 64-bit key of a column: whole numbers are their own, other types are hashed (XXH64); null is -1."""
    column = F.col(key_col)
    key = column.cast("long") if isinstance(rows.schema[key_col].dataType, IntegralType) else F.when(
        column.isNotNull(), F.xxhash64(column))
    return F.coalesce(key, _long(-1))


def jump_shard(key: Column, n_shards: int) -> Column:
    """Shard 0..n_shards-1 of a 64-bit key. Null keys count as key -1.

    With one more shard a key either stays or moves to the new shard.
    """
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), _long(-1))

    def jump(state, _):
        high, low = _step(state["high"], state["low"])
        at = F.floor((state["j"] + 1).cast("double")
                     * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(high.alias("high"), low.alias("low"), state["j"].alias("b"), at.alias("j"))
        return F.when(state["j"] < n_shards, moved).otherwise(state)

    start = F.struct(_low32(F.shiftrightunsigned(key, 32)).alias("high"), _low32(key).alias("low"),
                     _long(-1).alias("b"), _long(0).alias("j"))
    # every jump goes up by one shard at least, so n_shards jumps and the one that leaves always suffice
    return F.aggregate(F.sequence(F.lit(0), F.lit(n_shards)), start, jump, lambda s: s["b"].cast("int"))


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def text_crc(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, unsigned; a null text counts as an empty one."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def with_shards(rows: DataFrame, n_shards: int, key_col: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """Add the shard of every row; nothing moves. A column of that name is replaced."""
    return rows.withColumn(shard_col, jump_shard(stable_key(rows, key_col), n_shards))


def write_shards(rows: DataFrame, path: str, n_shards: int, key_col: str = "doc_id") -> None:
    """Write one folder per shard; each task writes the rows it has, so a shard may have many files."""
    with_shards(rows, n_shards, key_col).write.partitionBy("shard").mode("overwrite").parquet(path)


def _slice(key: Column, crc: Column) -> Column:
    """Where in its shard a row is numbered: decided by key and text, so copies of one key spread too."""
    mixed = key.bitwiseAND(_long((1 << 40) - 1)) * _long(7919) + crc
    return F.pmod(mixed, _long(SLICES)).cast("int")


def sharded_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """The contract's row of every document, law ``key``.

    Slots number the rows of a shard without gaps, by (slice, doc_id, text_crc32, size). Equal rows are
    counted before they move and laid out again at the end, COPIES at a time, so a key that holds a third of
    all rows reaches one task as one row per text. Ids of any type do (see ``stable_key``); an empty table gives no rows. Counts of slices are at most ``n_shards * SLICES`` rows.
    """
    narrow = docs.select("doc_id", text_size(F.col("text")).alias("size"), text_crc(F.col("text")).alias("text_crc32"))
    counted = materialize(
        narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
        .withColumn("key", stable_key(narrow, "doc_id"))
        .withColumns({"shard": jump_shard(F.col("key"), n_shards), "grown_shard": jump_shard(F.col("key"), n_shards + 1),
                      "slice": _slice(F.col("key"), F.col("text_crc32"))}).drop("key"), "shards")
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counted.groupBy("shard", "slice").agg(F.sum("copies").alias("slice_rows"))
               .withColumn("offset", F.coalesce(F.sum("slice_rows").over(before), _long(0))).drop("slice_rows"))
    within = (Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (counted.withColumn("rank", F.coalesce(F.sum("copies").over(within), _long(0)))
              .join(F.broadcast(offsets), ["shard", "slice"]))
    columns = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]
    first = F.col("offset") + F.col("rank")
    runs = placed.select(*columns, (first + F.col("copies")).alias("stop"), F.explode(F.sequence(
        first, first + F.col("copies") - 1, _long(COPIES))).alias("first")).repartition("doc_id", "text_crc32", "first")
    last = F.least(F.col("first") + COPIES, F.col("stop")) - 1
    return runs.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                       F.explode(F.sequence("first", last)).alias("slot"), "grown_shard")


def oracle(n_shards: int = 40) -> str:
    """The same rows in DuckDB: 128-bit arithmetic for the generator, a folded table for the checksum."""
    def walk(n: int, name: str) -> str:
        return f"""
  {name}(key, state, b, j) AS (
    SELECT DISTINCT key, key::HUGEINT & 18446744073709551615, -1::BIGINT, 0::BIGINT FROM narrow
    UNION ALL
    SELECT key, next, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((next >> 33) + 1)::DOUBLE))::BIGINT
    FROM (SELECT key, j, ((state::UHUGEINT * {MULTIPLIER}::UHUGEINT + 1) & 18446744073709551615)::HUGEINT AS next
          FROM {name} WHERE j < {n}))"""
    return f"""
WITH RECURSIVE
  crc_table AS (SELECT list(value ORDER BY n) AS t FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS value
    FROM (SELECT unnest(range(256)) AS n))),
  hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  narrow AS (
    SELECT doc_id, coalesce(doc_id, -1) AS key, (length(h) // 2 + 16)::BIGINT AS size,
      xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
    FROM hexed, crc_table),{walk(n_shards, "walked")},{walk(n_shards + 1, "wider")},
  placed AS (
    SELECT n.*, w.b AS shard, g.b AS grown_shard,
      ((n.key & 1099511627775) * 7919 + n.text_crc32) % {SLICES} AS slice
    FROM narrow n JOIN walked w ON n.key = w.key AND w.j >= {n_shards}
    JOIN wider g ON n.key = g.key AND g.j >= {n_shards + 1})
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id, text_crc32, size) - 1 AS slot,
  grown_shard::INTEGER AS grown_shard
FROM placed"""
