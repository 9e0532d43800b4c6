"""Mixing sources to target weights: iterative proportional fitting over cells, then calibrated sampling."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runcast.llm.common import unit_interval, word_count
from runcast.session import materialize

ROUNDS = 20  # at most; raking ends when no cell changes by more than TOLERANCE in a round
TOLERANCE = 1e-9
BUDGET = 0.5
SEED = "mix"
# shares of tokens wanted; values that are not named keep the share they have
LANG_SHARES = {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14}
TOPIC_SHARES = {"prose": 0.8, "table": 0.06, "notes": 0.06, "shout": 0.04, "marked": 0.04}
SOURCE_POWER = 0.5  # sources are wanted in proportion to this power of their tokens


def topic_of(text: Column) -> Column:
    """A coarse kind of text: tables, marked-up words, shouting, short notes, else prose (nulls are notes)."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("###")), "marked")
            .when(F.contains(text, F.lit("!! ")), "shout").when(F.length(text) < 400, "notes").otherwise("prose"))


def cells_of(docs: DataFrame, dims: list[str], tokens_col: str = "n_tokens") -> DataFrame:
    """Tokens per combination of the dimensions; partial sums come first, so hot sources do not matter."""
    return docs.groupBy(*dims).agg(F.sum(tokens_col).alias("tokens"))


def margin_targets(cells: DataFrame, dim: str, shares: Mapping[str, float] | float) -> DataFrame:
    """(dim, target) of one marginal, in tokens, adding up to all tokens.

    ``shares`` names the wanted shares of some values, whose sum is what those values hold together, or is
    a power of the tokens. A null value is a value of its own.
    """
    own = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("own"))
    if isinstance(shares, Mapping):
        wanted = F.coalesce(*[F.when(F.col(dim) == value, F.lit(float(share))) for value, share in shares.items()])
        named = F.col("wanted").isNotNull()
    else:
        wanted = F.when(F.col("own") > 0, F.pow("own", F.lit(float(shares)))).otherwise(F.lit(0.0))
        named = F.lit(True)
    own = own.withColumn("wanted", wanted)
    held, asked = own.agg(F.sum(F.when(named, F.col("own"))), F.sum("wanted")).first()
    target = F.when(named, F.lit(held) * F.col("wanted") / F.lit(asked)) if asked else F.lit(None)
    return own.select(dim, F.coalesce(target, F.col("own")).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Add ``weight``: the factor of a cell's tokens under which every marginal meets its target.

    One round scales each dimension in turn, until nothing changes or ``rounds`` are done; a warning tells of
    the latter, where margins may be missed by the last change. Cells are few
    against documents; every scaling ends in a small written table, so plans stay as small as one
    grouping and one join. Cells without tokens keep their factor.
    """
    raked = cells.withColumn("weight", F.lit(1.0))
    for dim, target in targets.items():
        wanted = target.select(F.col(dim).alias("_value"), F.col("target").alias(f"_{dim}_target"))
        raked = raked.join(wanted, F.col(dim).eqNullSafe(F.col("_value"))).drop("_value")
    raked = materialize(raked, "raked")
    for _ in range(rounds):
        raked = raked.withColumn("_last", F.col("weight"))
        for dim in targets:
            now = F.sum(F.col("tokens") * F.col("weight"))
            factor = raked.groupBy(F.col(dim).alias("_value")).agg(
                F.when(now > 0, F.max(f"_{dim}_target") / now).otherwise(F.lit(1.0)).alias("_factor"))
            scaled = raked.join(factor, F.col(dim).eqNullSafe(F.col("_value")))
            raked = materialize(scaled.withColumn("weight", F.col("weight") * F.col("_factor")).drop("_value", "_factor"),
                                "raked")
        change = raked.agg(F.max(F.abs(F.col("weight") / F.col("_last") - 1))).first()[0]
        raked = raked.drop("_last")
        if change is None or change <= TOLERANCE:
            break
    else:
        if rounds:
            warnings.warn(f"raking has not settled in {rounds} rounds; the last one changed weights by up to {change:.1e}",
                          RuntimeWarning, stacklevel=2)
    return raked.drop(*[f"_{dim}_target" for dim in targets])


def sampling_rate(raked: DataFrame, budget: float) -> float:
    """The rate at which ``sum(tokens * min(1, rate * weight))`` is ``budget`` of all tokens.

    Each pass returns three numbers; cells whose probability reached 1 leave the proportional part.
    """
    rate, full = 0.0, -1
    while True:
        at_one = F.col("weight") * F.lit(rate) >= 1.0
        row = raked.agg(F.sum(F.when(at_one, F.col("tokens"))).alias("fixed"), F.count_if(at_one).alias("full"),
                        F.sum(F.when(~at_one, F.col("tokens") * F.col("weight"))).alias("open"),
                        F.sum("tokens").alias("all")).first()
        if row["full"] == full or not row["open"]:
            return rate
        full, rate = row["full"], (budget * row["all"] - (row["fixed"] or 0)) / row["open"]


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | float], budget: float = BUDGET,
        rounds: int = ROUNDS, seed: str = SEED, key_col: str = "doc_id") -> DataFrame:
    """Add ``weight``, ``probability``, ``kept`` and ``sample_weight`` to rows that have ``n_tokens``.

    ``targets`` maps a column to its wanted shares. The kept tokens are ``budget`` of all in expectation.
    Where a probability is capped at 1, ``sample_weight`` (weight over probability) still gives the marginals.
    The key and the seed alone decide the draw, so repeated keys go together; a null key is one key.
    """
    dims = list(targets)
    cells = materialize(cells_of(docs, dims), "cells")
    raked = rake(cells, {dim: margin_targets(cells, dim, shares) for dim, shares in targets.items()}, rounds)
    rate = sampling_rate(raked, budget)
    factors = raked.select(*[F.col(dim).alias(f"_{dim}") for dim in dims], "weight")
    same = [F.col(dim).eqNullSafe(F.col(f"_{dim}")) for dim in dims]
    mixed = docs.join(factors, same).drop(*[f"_{dim}" for dim in dims])
    probability = F.least(F.lit(1.0), F.col("weight") * F.lit(rate))
    return (mixed.withColumn("probability", probability)
            .withColumn("kept", unit_interval(F.col(key_col), seed) < F.col("probability"))
            .withColumn("sample_weight", F.when(F.col("probability") > 0, F.col("weight") / F.col("probability"))))


TARGETS = {"source": SOURCE_POWER, "lang": LANG_SHARES, "topic": TOPIC_SHARES}


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Weight, probability and decision of every document; figures rounded to six digits."""
    narrow = docs.select("doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"),
                         word_count(F.col("text")).alias("n_tokens"))
    return mix(narrow, TARGETS).select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"),
        F.round("probability", 6).alias("probability"), "kept", F.round("sample_weight", 6).alias("sample_weight"))


def oracle(rounds: int = ROUNDS, budget: float = BUDGET, rate_passes: int = 8) -> str:
    """The same fit unrolled in DuckDB."""
    def shares(dim: str, table: Mapping[str, float]) -> str:
        cases = " ".join(f"WHEN '{value}' THEN {share}::DOUBLE" for value, share in table.items())
        return f"CASE {dim} {cases} END"

    def target(dim: str) -> str:
        wanted = f"own ** {SOURCE_POWER}" if dim == "source" else shares(dim, LANG_SHARES if dim == "lang" else TOPIC_SHARES)
        return f"""target_{dim} AS MATERIALIZED (
  SELECT {dim}, CASE WHEN wanted IS NULL THEN own ELSE sum(own) FILTER (wanted IS NOT NULL) OVER ()
    * wanted / sum(wanted) OVER () END AS target
  FROM (SELECT {dim}, own, {wanted} AS wanted
        FROM (SELECT {dim}, sum(tokens)::DOUBLE AS own FROM cells GROUP BY {dim})))"""

    steps, last = [], "cells"
    for n in range(rounds):
        for dim in TARGETS:
            name = f"raked_{n}_{dim}"
            steps.append(f"""{name} AS MATERIALIZED (
  SELECT source, lang, topic, tokens, CASE WHEN now > 0 THEN weight * target / now ELSE weight END AS weight
  FROM (SELECT c.*, t.target, sum(tokens * weight) OVER (PARTITION BY c.{dim}) AS now
        FROM {last} c JOIN target_{dim} t ON c.{dim} IS NOT DISTINCT FROM t.{dim}))""")
            last = name
    steps.append(f"rate_0 AS MATERIALIZED (SELECT {budget} * sum(tokens) / sum(tokens * weight) AS rate FROM {last})")
    for n in range(rate_passes):
        steps.append(f"""rate_{n + 1} AS MATERIALIZED (
  SELECT ({budget} * sum(tokens) - coalesce(sum(tokens) FILTER (weight * rate >= 1), 0))
    / sum(tokens * weight) FILTER (weight * rate < 1) AS rate FROM {last}, rate_{n})""")
    return f"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, source, lang, CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, '###') THEN 'marked'
    WHEN contains(t, '!! ') THEN 'shout' WHEN length(t) < 400 THEN 'notes' ELSE 'prose' END AS topic,
    len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
cells AS MATERIALIZED (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, 1::DOUBLE AS weight FROM docs GROUP BY ALL),
{", ".join(target(dim) for dim in TARGETS)},
{", ".join(steps)},
drawn AS (
  SELECT d.*, c.weight, least(1, c.weight * rate) AS probability,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::UBIGINT::DOUBLE / 4294967296 AS u
  FROM docs d JOIN {last} c ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang
    AND d.topic = c.topic, rate_{rate_passes})
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
  u < probability AS kept, round(weight / probability, 6) AS sample_weight
FROM drawn"""
