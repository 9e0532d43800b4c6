"""Secret scan: pattern spans, and corpus-wide ownership of what they contain.

Candidates are hashed and counted by distinct repositories and owners. A value that many owners share is a
copied example; one that a single owner has, with the mixed characters of a generated key, looks live.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runcast.llm.common import let, running
from runcast.session import materialize


@dataclass(frozen=True)
class Pattern:
    """``group`` is the value; a match counts if the value has ``least`` characters. ``hint`` is a cheap first test."""

    kind: str
    regex: str
    group: int
    least: int
    hint: str | None = None


# The first three are the base patterns; fixed values.
BASE_PATTERNS = (
    Pattern("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            2, 6),
    Pattern("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Pattern("hex", r"[0-9a-f]+", 0, 24),
)
# long runs of key characters; what makes one a span is its look and its ownership
OPAQUE = Pattern("opaque", r"[A-Za-z0-9+/_=-]{24,}", 0, 24)
# failing hex matches are all runs shorter than this, so only long ones are looked for
_LONG_HEX = r"[0-9a-f]{24,}"
EXAMPLE_OWNERS = 5
SPAN = "struct<start:bigint,rank:int,stop:bigint,kind:string,value:string>"


def spans_of(text: Column, pattern: Pattern, rank: int) -> Column:
    """Array of spans of one pattern: code-point offsets from the lengths of what lies between the matches."""
    regex = _LONG_HEX if pattern.kind == "hex" else pattern.regex
    gaps = F.split(text, regex)
    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    value = whole if pattern.group == 0 else F.regexp_extract_all(text, F.lit(regex), F.lit(pattern.group))
    pieces = F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda gap, whole: F.struct(
        F.length(gap).alias("gap"), F.length(whole).alias("whole")))

    def placed(pieces: Column) -> Column:
        stops = running(F.transform(pieces, lambda p: (p["gap"] + p["whole"]).cast("bigint")), 0, lambda a, b: a + b)
        spans = F.zip_with(F.zip_with(stops, pieces, lambda stop, piece: F.struct(
            (stop - piece["whole"]).alias("start"), stop.alias("stop"))), value, lambda at, value: F.struct(
                at["start"].alias("start"), F.lit(rank).alias("rank"), at["stop"].alias("stop"),
                F.lit(pattern.kind).alias("kind"), value.alias("value")))
        return F.filter(spans, lambda span: F.length(span["value"]) >= pattern.least)

    present = text.rlike(regex) if pattern.hint is None else F.contains(text, F.lit(pattern.hint)) & text.rlike(regex)
    return F.when(present, let(pieces, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _apart(spans: Column, others: Column) -> Column:
    """The ``spans`` that touch none of the ``others``, by one pass over both in order."""
    def told(merged: Column) -> Column:
        is_other = lambda s: s["rank"] < len(BASE_PATTERNS)
        reached = running(F.transform(merged, lambda s: F.when(is_other(s), s["stop"]).otherwise(F.lit(-1).cast("bigint"))),
                          -1, F.greatest)
        following = F.reverse(running(F.reverse(F.transform(merged, lambda s: F.when(is_other(s), s["start"]).otherwise(
            F.lit(2**62)))), 2**62, F.least))
        near = F.zip_with(F.zip_with(reached, following, lambda stop, start: F.struct(stop.alias("stop"), start.alias("start"))),
                          merged, lambda base, span: F.struct(base.alias("base"), span.alias("span")))
        free = F.filter(near, lambda n: ~is_other(n["span"]) & (n["base"]["stop"] <= n["span"]["start"])
                        & (n["base"]["start"] >= n["span"]["stop"]))
        return F.transform(free, lambda n: n["span"])

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(F.array_sort(F.concat(spans, others)), told)).otherwise(spans)


def _generated_look(value: Column) -> Column:
    """At least four digits, and letters that are not one word with a number behind it."""
    return (F.regexp_count(value, F.lit("[0-9]")) >= 4) & (F.regexp_count(value, F.lit("[0-9][A-Za-z]")) >= 2)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``base`` (spans of the base patterns in order) and ``opaque`` (other runs that look generated)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(F.concat(*[spans_of(text, pattern, rank) for rank, pattern in enumerate(BASE_PATTERNS)]))
    opaque = F.filter(spans_of(text, OPAQUE, len(BASE_PATTERNS)), lambda span: _generated_look(span["value"]))
    found = docs.withColumn("base", base).withColumn("opaque", opaque)
    return found.withColumn("opaque", _apart(F.col("opaque"), F.col("base")))


def ownership(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """(hash, n_repositories, n_owners, copied) of every candidate value (column ``value``).

    Values are reduced to one row per repository and owner before they meet, so a value that a third of
    all documents copy is a few rows by then. A null repository or owner is one of its own.
    """
    places = found.select(F.sha2("value", 256).alias("hash"), F.col(repository).alias("_repository"),
                          F.col(owner).alias("_owner")).distinct()
    by_owner = places.groupBy("hash", "_owner").agg(F.count("*").alias("_repositories"))
    return by_owner.groupBy("hash").agg(F.sum("_repositories").alias("n_repositories"),
                                        F.count("*").alias("n_owners"))


def scan(docs: DataFrame, repository: str, owner: str, example_owners: int = EXAMPLE_OWNERS,
         text_col: str = "text") -> DataFrame:
    """(uid, columns of ``docs`` but the text, ``base``, ``extra``, ``live``): spans and what their owners say.

    ``extra``: opaque spans whose value has one owner. ``live``: base and extra spans whose value looks
    generated and has fewer than ``example_owners`` owners. The text is read once; what follows works on a
    written table of the candidates, whose row numbers can be joined.
    """
    found = materialize(candidates(docs, text_col).drop(text_col)
                        .withColumn("uid", F.monotonically_increasing_id()), "candidates")
    each = found.where((F.size("base") > 0) | (F.size("opaque") > 0)).select(
        "uid", F.col(repository).alias("_r"), F.col(owner).alias("_o"),
        F.explode(F.concat("base", "opaque")).alias("span")).withColumn("value", F.col("span")["value"])
    owned = ownership(each, "_r", "_o")
    told = (each.withColumn("hash", F.sha2("value", 256)).join(owned, "hash")
            .withColumn("opaque", F.col("span")["kind"] == OPAQUE.kind))
    alone, few = F.col("n_owners") == 1, F.col("n_owners") < example_owners
    per_row = told.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.when(F.col("opaque") & alone, F.col("span")))).alias("extra"),
        F.count_if(few & _generated_look(F.col("value")) & (~F.col("opaque") | alone)).alias("n_live"),
        F.count_if(~few).alias("n_example"))
    none = F.array().cast(f"array<{SPAN}>")
    return found.join(per_row, "uid", "left").withColumns({
        "extra": F.coalesce("extra", none), "n_live": F.coalesce("n_live", F.lit(0).cast("long")),
        "n_example": F.coalesce("n_example", F.lit(0).cast("long"))})


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span's characters replaced; overlapping spans are replaced once.

    Runs of spans, about the root of their number, share one cut of the text, as a cut has to count from its start.
    """
    def cut(text: Column, span: Column, offset: Column) -> Column:
        kept = F.substring(text, (span["before"] - offset + 1).cast("int"),
                           F.greatest(span["start"] - span["before"], F.lit(0)).cast("int"))
        return F.when(span["start"] >= span["before"], F.concat(kept, F.lit(mark))).otherwise("")

    def by_runs(placed: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(placed))).cast("int")

        def run_of(run: Column) -> Column:
            offset, end = F.element_at(run, 1)["before"], F.element_at(run, -1)["reached"]
            return let(F.substring(text, (offset + 1).cast("int"), (end - offset).cast("int")), lambda part: F.array_join(
                F.transform(run, lambda span: cut(part, span, offset)), ""))

        runs = F.transform(F.sequence(F.lit(0), F.size(placed) - 1, step), lambda at: let(F.slice(placed, at + 1, step), run_of))
        rest = F.substring(text, (F.element_at(placed, -1)["reached"] + 1).cast("int"), 2**31 - 1)
        return F.concat(F.array_join(runs, ""), rest)

    def placed(spans: Column) -> Column:
        return let(running(F.transform(spans, lambda s: s["stop"]), 0, F.greatest), lambda reached: F.zip_with(
            F.zip_with(spans, reached, lambda span, stop: F.struct(span["start"].alias("start"), stop.alias("reached"))),
            F.slice(F.concat(F.array(F.lit(0).cast("bigint")), reached), F.lit(1), F.size(reached)),
            lambda span, before: F.struct(span["start"].alias("start"), span["reached"].alias("reached"), before.alias("before"))))

    return F.when(F.size(spans) > 0, let(F.array_sort(spans), lambda own: let(placed(own), by_runs))).otherwise(text)


def secret_documents(docs: DataFrame) -> DataFrame:
    """The contract's row of every document. Repository: source and language; owner: source.

    A null text has no spans; repeated rows stay repeated; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", F.struct("source", "lang").alias("_repository"), F.col("source").alias("_owner"))
    kind_count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(rows, "_repository", "_owner").select(
        "doc_id", *[kind_count(pattern.kind).alias(f"n_{pattern.kind}") for pattern in BASE_PATTERNS],
        F.sha2(_told(F.col("base")), 256).alias("base_sha256"),
        _told(F.array_sort(F.concat("base", "extra"))).alias("spans"), "n_live", "n_example")


ORACLE = rf"""
WITH
  docs AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
  pattern(kind, rank, least) AS (VALUES ('assign', 0, 6), ('access', 1, 20), ('hex', 2, 24), ('opaque', 3, 24)),
  pieces AS MATERIALIZED (
    SELECT uid, kind, rank, least, CASE rank WHEN 0 THEN regexp_extract_all(t, a) WHEN 1 THEN regexp_extract_all(t, k)
        WHEN 2 THEN regexp_extract_all(t, h) ELSE regexp_extract_all(t, o) END AS whole,
      CASE rank WHEN 0 THEN regexp_extract_all(t, a, 2) WHEN 1 THEN regexp_extract_all(t, k)
        WHEN 2 THEN regexp_extract_all(t, h) ELSE regexp_extract_all(t, o) END AS value,
      CASE rank WHEN 0 THEN string_split_regex(t, a) WHEN 1 THEN string_split_regex(t, k)
        WHEN 2 THEN string_split_regex(t, h) ELSE string_split_regex(t, o) END AS gap
    FROM docs, pattern, (SELECT
      '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS a,
      'AKIA[A-Z0-9]+' AS k, '[0-9a-f]+' AS h, '[A-Za-z0-9+/_=-]{{24,}}' AS o)),
  spans AS MATERIALIZED (
    SELECT uid, kind, rank, value[i] AS value, list_sum(list_transform(gap[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start, length(whole[i]) AS n
    FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM pieces) WHERE length(value[i]) >= least),
  base AS MATERIALIZED (SELECT *, start + n AS stop FROM spans WHERE rank < 3),
  opaque AS MATERIALIZED (
    SELECT *, start + n AS stop FROM spans o WHERE rank = 3 AND len(regexp_extract_all(value, '[0-9]')) >= 4
      AND len(regexp_extract_all(value, '[0-9][A-Za-z]')) >= 2
      AND NOT EXISTS (SELECT 1 FROM base b WHERE b.uid = o.uid AND b.start < o.start + o.n AND o.start < b.stop)),
  owned AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS n_owners FROM (
    SELECT * FROM base UNION ALL SELECT * FROM opaque) JOIN docs USING (uid) GROUP BY value),
  told AS (
    SELECT s.*, n_owners, rank = 3 AS is_opaque, len(regexp_extract_all(value, '[0-9]')) >= 4
      AND len(regexp_extract_all(value, '[0-9][A-Za-z]')) >= 2 AS generated
    FROM (SELECT * FROM base UNION ALL SELECT * FROM opaque) s JOIN owned USING (value)),
  joined AS (
    SELECT uid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
      count(*) FILTER (rank = 2) AS n_hex,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3 OR n_owners = 1) AS spans,
      count(*) FILTER (n_owners < {EXAMPLE_OWNERS} AND generated AND (NOT is_opaque OR n_owners = 1)) AS n_live,
      count(*) FILTER (n_owners >= {EXAMPLE_OWNERS}) AS n_example
    FROM told GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM docs LEFT JOIN joined USING (uid)"""
