"""Quality rules: a table of thresholds compiled into one projection (no user functions, no shuffle)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runcast.llm.common import words_of

WINDOW = 8

# frequent function words of the four languages, fixed values
STOP_WORDS = ("the be to of and a in that is was for on with as at by it from this are or an "
              "der die das und ist in zu den von mit sich des auf für im dem nicht ein eine als "
              "le la les de des et un une est que qui dans en du pour par sur pas au avec "
              "el los las y se del lo su con no una es al").split()


@dataclass(frozen=True)
class Rule:
    """Texts of at least ``min_words`` words fail if ``metric`` is below ``low`` or above ``high``."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


# Loose on purpose: a rule only takes texts that are far from ordinary prose.
DEFAULT_RULES = (
    Rule("few_words", "n_words", low=20),
    Rule("repeated_windows", "repeat_ratio", high=0.3),
    Rule("short_words", "mean_word_chars", low=2.0),
    Rule("long_words", "mean_word_chars", high=14.0),
    Rule("symbols", "symbol_ratio", high=0.5),
    Rule("few_stop_words", "stop_ratio", low=0.01, min_words=100),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
)


def _covered(positions: Column, width: int) -> Column:
    """Words inside windows of ``width`` words that start at the ascending ``positions``."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        positions, zero,
        lambda acc, at: F.struct((acc["n"] + F.least(F.lit(width), at + width - acc["end"])).cast("long").alias("n"),
                                 (at + width).cast("long").alias("end")),
        lambda acc: acc["n"])


def _window_hashes(staged: DataFrame, window: int) -> DataFrame:
    """Turn ``_hashes`` of words into hashes of all runs of ``window`` words, by doubling the run length."""
    length = 1
    while length < window:
        step = min(length, window - length)
        staged = staged.withColumn("_hashes", F.zip_with(
            F.slice("_hashes", 1, F.greatest(F.size("_hashes") - step, F.lit(0))),
            F.slice("_hashes", step + 1, F.greatest(F.size("_hashes") - step, F.lit(0))),
            lambda left, right: F.xxhash64(left, right)))
        length += step
    return staged


def with_metrics(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Add the counts and ratios that rules can name.

    Word windows are compared by a 64-bit hash of their words. Only texts in which a hash occurs twice
    go through the sorting that finds which words the repeated windows cover.
    Null and blank texts have zero counts and null ratios.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    stops = sorted({form for word in STOP_WORDS for form in (word, word.capitalize())})
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    staged = docs.withColumns({
        "_words": words_of(F.col(text_col)),
        "_lines": lines,
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
    })
    staged = staged.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_stops": F.size(F.filter("_words", lambda word: word.isin(stops))),
        "_hashes": F.transform("_words", lambda word: F.xxhash64(word)),
    })
    staged = _window_hashes(staged, window)
    staged = staged.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_hashes", lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,at:int>>")))
    near = lambda at, step: F.coalesce(F.get("_sorted", at + step)["h"], F.lit(None))
    staged = staged.withColumn("_repeated", F.sort_array(F.transform(
        F.filter("_sorted", lambda x, at: F.coalesce(x["h"] == near(at, -1), F.lit(False))
                 | F.coalesce(x["h"] == near(at, 1), F.lit(False))),
        lambda x: x["at"].cast("long"))))
    n_words = F.col("n_words").cast("double")
    ratio = lambda part, whole: F.when(whole > 0, part / whole)
    staged = staged.withColumn("n_repeat_words", _covered(F.col("_repeated"), window))
    return staged.withColumns({
        "mean_word_chars": ratio(F.col("word_chars"), n_words),
        "symbol_ratio": ratio(F.col("n_symbols"), n_words),
        "stop_ratio": ratio(F.col("_stops"), n_words),
        "repeat_ratio": ratio(F.col("n_repeat_words"), n_words),
        "dup_line_ratio": ratio(F.col("n_dup_lines"), F.col("n_lines").cast("double")),
    }).drop("_words", "_lines", "_stops", "_hashes", "_sorted", "_repeated")


def _fails(rule: Rule) -> Column:
    value, parts = F.col(rule.metric), []
    if rule.low is not None:
        parts.append(value < rule.low)
    if rule.high is not None:
        parts.append(value > rule.high)
    failed = parts[0] if len(parts) == 1 else parts[0] | parts[1]
    return F.coalesce(failed & (F.col("n_words") >= rule.min_words), F.lit(False))


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text_col: str = "text") -> DataFrame:
    """Metrics, the names of the failed rules and ``kept`` for every row.

    Nothing is dropped, rows never move. Columns of ``docs`` that carry a metric's name are replaced.
    """
    measured = with_metrics(docs, text_col)
    failed = F.filter(F.array(*[F.when(_fails(rule), F.lit(rule.name)) for rule in rules]), lambda x: x.isNotNull())
    return measured.withColumn("failed_rules", failed).withColumn("kept", F.size("failed_rules") == 0)


def judged_documents(docs: DataFrame) -> DataFrame:
    """The contract's row of every document; null texts count as texts without words."""
    judged = apply_rules(docs.select("doc_id", "text"))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"),
        F.array_join("failed_rules", ",").alias("failed_rules"))


def oracle(rules: Sequence[Rule] = DEFAULT_RULES) -> str:
    """The same rows in DuckDB, with windows compared word by word."""
    stops = ", ".join(f"'{form}'" for form in sorted({f for word in STOP_WORDS for f in (word, word.capitalize())}))

    def failed(rule: Rule) -> str:
        tests = [f"{rule.metric} < {rule.low}"] * (rule.low is not None) + [f"{rule.metric} > {rule.high}"] * (rule.high is not None)
        return f"CASE WHEN n_words >= {rule.min_words} AND ({' OR '.join(tests)}) THEN '{rule.name}' END"

    return rf"""
WITH
  split AS MATERIALIZED (
    SELECT row_number() OVER () AS uid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(t, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
  windows AS (
    SELECT uid, pos, array_to_string(list_slice(w, pos, pos + {WINDOW - 1}), ' ') AS words FROM (
      SELECT uid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS pos FROM split WHERE len(w) >= {WINDOW})),
  repeated AS (
    SELECT uid, pos FROM (SELECT *, count(*) OVER (PARTITION BY uid, words) AS times FROM windows) WHERE times > 1),
  covered AS (
    SELECT uid, count(DISTINCT word) AS n FROM (
      SELECT uid, unnest(range(pos, pos + {WINDOW})) AS word FROM repeated) GROUP BY uid),
  counts AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines) AS n_lines,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
      len(list_filter(w, lambda word: word IN ({stops}))) AS stops
    FROM split LEFT JOIN covered USING (uid)),
  metrics AS (
    SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbol_ratio,
      stops / nullif(n_words, 0) AS stop_ratio, n_repeat_words / nullif(n_words, 0) AS repeat_ratio,
      n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio,
      n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
    FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules,
  failed_rules = '' AND NOT base_failed AS kept
FROM (SELECT *, concat_ws(',', {', '.join(failed(rule) for rule in rules)}) AS failed_rules FROM metrics)"""
