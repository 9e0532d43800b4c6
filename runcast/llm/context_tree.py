"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions; each decision (one of 255 nodes of the byte's bit tree) has a context tree
over the bytes before it, up to DEPTH of them. Every tree node has the Krichevsky-Trofimov estimate of its
zeros and ones, and mixes it half and half with the product of its children, from the leaves up. With the
corpus counted, the mixture of all depths along a path is one fixed probability per decision.

Counting covers all bytes: tasks count runs of DEPTH + 1 bytes, Spark sums them, and runs that only texts held
out have are listed with no count. No run is left out. Contexts that share their last SPLIT bytes are weighted
together in one task, many such splits at a time, from the leaves up; Spark sums what they tell the shorter
contexts, which are finished on the driver (at most 256 ** 2 * 255 nodes whatever the corpus, and no more than
there are pairs of neighbouring bytes) and sent to the tasks that work out every run's probability. The most
frequent runs are looked up where the texts lie; the others leave as (row, run, times) and are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runcast.session import materialize, spread

DEPTH = 5
SPLIT = 3  # contexts are dealt out by so many bytes
HELD_SPLITS = 1 << 19  # runs weighted at a time, if a split has no more
COMMON_RUNS, TOLD_COUNTS = 1 << 21, 4096  # runs looked up at most, and counts told apart to choose them
COMMON_PARTS = 1 << 17  # words with at least this share of all tokens are looked up, the others joined
BLOCK_BYTES = 1 << 20
# what a task holds of its counts before it hands them on
HELD_RUNS, HELD_WORDS = 800_000, 200_000
END = 0xFF  # never a byte of UTF-8: the end of a text, and what stands before its first byte
HELD_OUT = (7, 2)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END_WORD = b"\xff"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT[0] == HELD_OUT[1]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0 (Stirling's series eight steps up)."""
    x = np.asarray(x, dtype=np.float64)
    shift = sum(np.log(x + k) for k in range(8))
    y = x + 8
    inverse = 1 / y
    series = inverse * (1 / 12 - inverse**2 * (1 / 360 - inverse**2 * (1 / 1260 - inverse**2 / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a block with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first position of each text): per symbol its DEPTH preceding bytes and itself, newest lowest."""
    raw = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
    pad = bytes([END]) * DEPTH
    data = np.frombuffer(b"".join(part for text in raw for part in (pad, text, b"\xff")), dtype=np.uint8).astype(np.int64)
    codes = np.zeros(len(data), dtype=np.int64)
    for back in range(DEPTH, -1, -1):
        codes[DEPTH:] = (codes[DEPTH:] << 8) | data[DEPTH - back:len(data) - back]
    sizes = np.array([len(text) + 1 for text in raw], dtype=np.int64)
    starts = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    inside = np.ones(len(data), dtype=bool)
    inside[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    return codes[inside], np.cumsum(sizes) - sizes


def blocks(frame: pd.DataFrame, text_col: str = "text") -> Iterator[pd.DataFrame]:
    size = frame[text_col].str.len().fillna(0).to_numpy(dtype=np.float64).cumsum() // BLOCK_BYTES
    for _, rows in frame.groupby(size, sort=True):
        yield rows


def _count_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct runs of a task's bytes; what is held is merged and given out when it grows."""
    held, size = [], 0

    def merged() -> pd.DataFrame:
        runs, n = (np.concatenate(column) for column in zip(*held, strict=True))
        held.clear()
        order = np.argsort(runs)
        runs, n = runs[order], n[order]
        first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
        return pd.DataFrame({"run": runs[first], "n": np.add.reduceat(n, first)})

    for frame in frames:
        for rows in blocks(frame):
            codes, starts = encode(rows["text"].tolist())
            own = np.repeat(rows["learned"].to_numpy(dtype=np.float64), np.diff(np.append(starts, len(codes))))
            place, runs = pd.factorize(codes)
            held.append((runs, np.bincount(place, weights=own, minlength=len(runs)).astype(np.int64)))
            size += len(runs)
            if size > 2 * HELD_RUNS:
                together = merged()
                size = len(together)
                if size > HELD_RUNS:
                    yield together
                    size = 0
                else:
                    held.append((together["run"].to_numpy(), together["n"].to_numpy()))
    if held:
        yield merged()


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between white space, as bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[bytes] = Counter()
    for frame in frames:
        for text in frame["text"]:
            counts.update(words_of(text))
            counts[END_WORD] += 1
            if len(counts) > HELD_WORDS:
                yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                counts.clear()
    if counts:
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})


@dataclass
class ContextTrees:
    """Per depth the sorted (context, bit-tree node) keys with both log10 probabilities of a path ending there."""

    keys: list[np.ndarray]
    logs: list[np.ndarray]
    runs: np.ndarray  # kept runs of full depth, and the log10 probability of their last byte
    run_logs: np.ndarray

    def byte_logs(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of every code, given the bytes before it."""
        place = np.minimum(np.searchsorted(self.runs, codes), max(len(self.runs) - 1, 0))
        known = self.runs[place] == codes if len(self.runs) else np.zeros(len(codes), dtype=bool)
        out = np.zeros(len(codes))
        out[known] = self.run_logs[place[known]]
        rest = np.flatnonzero(~known)
        if len(rest):
            rare, inverse = np.unique(codes[rest], return_inverse=True)
            out[rest] = self._decide(rare)[inverse]
        return out

    def _decide(self, codes: np.ndarray) -> np.ndarray:
        """The eight decisions one by one, each by the deepest context that has counts of it."""
        total, byte, context = np.zeros(len(codes)), codes & 255, codes >> 8
        for bit in range(8):
            node, value = (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1
            logs, open_ = np.full(len(codes), np.log10(0.5)), np.arange(len(codes))
            for depth in range(DEPTH, -1, -1):
                if not len(self.keys[depth]) or not len(open_):
                    continue
                key = ((context[open_] & ((1 << 8 * depth) - 1)) << 8) | node[open_]
                place = np.minimum(np.searchsorted(self.keys[depth], key), len(self.keys[depth]) - 1)
                found = self.keys[depth][place] == key
                logs[open_[found]] = self.logs[depth][place[found], value[open_[found]]]
                open_ = open_[~found]
            total += logs
        return total


def build_trees(runs: list[tuple[np.ndarray, np.ndarray]]) -> ContextTrees:
    """From per depth (runs of depth + 1 bytes, counts): weights from the leaves up, then paths from the root."""
    keys, counts = [], []
    for codes, n in runs:
        byte, context = codes & 255, codes >> 8
        parts = []
        for bit in range(8):  # nodes of different bits are different keys
            own, inverse = np.unique((context << 8) | (1 << bit) | (byte >> (8 - bit)), return_inverse=True)
            value = (byte >> (7 - bit)) & 1
            parts.append((own, np.bincount(inverse * 2 + value, weights=n, minlength=2 * len(own)).reshape(-1, 2)))
        own = np.concatenate([part[0] for part in parts])
        order = np.argsort(own)
        keys.append(own[order])
        counts.append(np.concatenate([part[1] for part in parts])[order])
    parents = [None] + [np.searchsorted(keys[d - 1], (((keys[d] >> 8) & ((1 << 8 * (d - 1)) - 1)) << 8) | (keys[d] & 255))
                        for d in range(1, DEPTH + 1)]
    own_share, rest = [None] * (DEPTH + 1), [None] * (DEPTH + 1)
    weighted = None
    for depth in range(DEPTH, -1, -1):
        estimate = log_kt(counts[depth][:, 0], counts[depth][:, 1])
        if depth == DEPTH:
            own_share[depth], weighted = np.ones(len(keys[depth])), estimate
            continue
        size = len(keys[depth])
        below = np.bincount(parents[depth + 1], weights=weighted, minlength=size)
        taken = np.stack([np.bincount(parents[depth + 1], weights=counts[depth + 1][:, side], minlength=size)
                          for side in (0, 1)], axis=1)
        rest[depth] = np.maximum(counts[depth] - taken, 0)
        split = below + log_kt(rest[depth][:, 0], rest[depth][:, 1])
        weighted = np.logaddexp(estimate, split) + np.log(0.5)
        own_share[depth] = np.exp(estimate + np.log(0.5) - weighted)
    logs, told, left = [], None, None
    for depth in range(DEPTH + 1):
        one = (counts[depth][:, 1] + 0.5) / (counts[depth].sum(axis=1) + 1)
        if depth == 0:
            told, left = own_share[0] * one, 1 - own_share[0]
        else:
            up = parents[depth]
            told, left = told[up] + left[up] * own_share[depth] * one, left[up] * (1 - own_share[depth])
        end = told
        if depth < DEPTH:
            end = told + left * (rest[depth][:, 1] + 0.5) / (rest[depth].sum(axis=1) + 1)
        end = np.clip(end, 1e-12, 1 - 1e-12)
        logs.append(np.log10(np.stack([1 - end, end], axis=1)).astype(np.float32))
    trees = ContextTrees(keys, logs, np.zeros(0, dtype=np.int64), np.zeros(0))
    full = runs[DEPTH][0]
    run_logs = trees._decide(full)
    trees.runs, trees.run_logs = full, run_logs
    return trees


def count_runs(docs: DataFrame) -> DataFrame:
    """(run, n): all runs of DEPTH + 1 bytes of the texts (column ``text``), as integers.

    Only rows whose ``learned`` is true are counted; runs of no such row have n = 0.
    """
    return (docs.select("text", "learned").mapInPandas(_count_runs, "run long, n long")
            .groupBy("run").agg(F.sum("n").alias("n")))


def _shorter(keys: np.ndarray, depth: int) -> np.ndarray:
    """The nodes of these with a context of ``depth`` bytes."""
    return (((keys >> 8) & ((1 << 8 * depth) - 1)) << 8) | (keys & 255)


def _leaves(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (context, bit-tree node) keys of full depth, with their zeros and ones."""
    byte, context = codes & 255, codes >> 8
    keys = np.concatenate([(context << 8) | (1 << bit) | (byte >> (8 - bit)) for bit in range(8)])
    ones = np.concatenate([n * ((byte >> (7 - bit)) & 1) for bit in range(8)])
    own, place = np.unique(keys, return_inverse=True)
    whole, ones = (np.bincount(place, weights=w, minlength=len(own)) for w in (np.tile(n, 8), ones))
    return own, np.stack([whole - ones, ones], axis=1)


def _told_above(keys: np.ndarray, counts: np.ndarray, weighted: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """The nodes of ``depth`` bytes above these: keys, counts and the weighted logarithms of all below."""
    above, place = np.unique(_shorter(keys, depth), return_inverse=True)
    zeros, ones, below = (np.bincount(place, weights=w, minlength=len(above)) for w in (*counts.T, weighted))
    return above, np.stack([zeros, ones], axis=1), below


Levels = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by depth: keys, counts, share of the own estimate


def _climb(keys: np.ndarray, counts: np.ndarray, below: np.ndarray | None, depth: int, last: int) -> tuple[Levels, np.ndarray]:
    """Weights from ``depth`` up to ``last``, and the weighted logarithms of the last."""
    levels: Levels = {}
    while True:
        weighted, share = log_kt(*counts.T), np.ones(len(keys))
        if below is not None:
            estimate = weighted + np.log(0.5)
            weighted = np.logaddexp(estimate, below + np.log(0.5))
            share = np.exp(estimate - weighted)
        levels[depth] = keys, counts, share
        if depth == last:
            return levels, weighted
        depth -= 1
        keys, counts, below = _told_above(keys, counts, weighted, depth)


def _descend(levels: Levels, told: np.ndarray, left: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per depth both log10 probabilities of a path that ends there, from what is told and left above the first."""
    logs, above = [], None
    for depth in sorted(levels):
        keys, counts, share = levels[depth]
        if above is not None:
            place = np.searchsorted(above, _shorter(keys, depth - 1))
            told, left = told[place], left[place]
        told = told + left * share * (counts[:, 1] + 0.5) / (counts.sum(axis=1) + 1)
        left, above = left * (1 - share), keys
        end = np.clip(told + left * 0.5, 1e-12, 1 - 1e-12)  # a longer context that was never seen says one half
        logs.append(np.log10(np.stack([1 - end, end], axis=1)).astype(np.float32))
    return logs, told, left


def _whole_splits(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(runs, counts) in pieces of whole splits, from rows in order of their split."""
    held, size, enough = [], 0, HELD_SPLITS
    for frame in frames:
        held.append((frame["run"].to_numpy(), frame["n"].to_numpy()))
        size += len(frame)
        if size < enough:
            continue
        codes, n = (np.concatenate(column) for column in zip(*held, strict=True))
        split = (codes >> 8) & ((1 << 8 * SPLIT) - 1)
        last = int(np.searchsorted(split, split[-1]))
        if last:
            yield codes[:last], n[:last]
        held, size = [(codes[last:], n[last:])], len(codes) - last
        enough = max(HELD_SPLITS, 2 * size)
    if size:
        codes, n = (np.concatenate(column) for column in zip(*held, strict=True))
        yield codes, n


def _split_levels(codes: np.ndarray, n: np.ndarray) -> tuple[Levels, np.ndarray]:
    return _climb(*_leaves(codes[n > 0], n[n > 0]), None, DEPTH, SPLIT)


def _weigh_splits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for codes, n in _whole_splits(frames):
        levels, weighted = _split_levels(codes, n)
        keys, counts, below = _told_above(*levels[SPLIT][:2], weighted, SPLIT - 1)
        yield pd.DataFrame({"node": keys, "zeros": counts[:, 0], "ones": counts[:, 1], "below": below})


def train(runs: DataFrame) -> DataFrame:
    """(run, n, log): the log10 probability of the last byte of every counted run (``count_runs``), given those before."""
    split = F.shiftright("run", 8).bitwiseAND(F.lit((1 << 8 * SPLIT) - 1))
    dealt = spread(runs.withColumn("split", split), "split").sortWithinPartitions("split").select("run", "n")
    told = dealt.mapInPandas(_weigh_splits, "node long, zeros double, ones double, below double").groupBy("node").agg(
        *[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow().sort_by("node")
    nodes, zeros, ones, below = (told.column(c).to_numpy() for c in ("node", "zeros", "ones", "below"))
    levels = {depth: (nodes[:0], np.zeros((0, 2)), zeros[:0]) for depth in range(SPLIT)}
    if len(nodes):
        levels = _climb(nodes, np.stack([zeros, ones], axis=1), below, SPLIT - 1, 0)[0]
    logs, told_above, left_above = _descend(levels, np.zeros(len(levels[0][0])), np.ones(len(levels[0][0])))
    shared = runs.sparkSession.sparkContext.broadcast(([levels[d][0] for d in range(SPLIT)], logs, told_above, left_above))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, logs, told, left = shared.value
        for codes, n in _whole_splits(frames):
            own = _split_levels(codes, n)[0]
            above = np.searchsorted(keys[-1], _shorter(own[SPLIT][0], SPLIT - 1))
            below = _descend(own, told[above], left[above])[0]
            trees = ContextTrees([*keys, *(own[d][0] for d in range(SPLIT, DEPTH + 1))], [*logs, *below], codes[:0], np.zeros(0))
            yield pd.DataFrame({"run": codes, "n": n, "log": trees._decide(codes)})

    return dealt.mapInPandas(score, "run long, n long, log double")


def frequent_runs(scored: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` of the most frequent runs, sorted, and their logs: all that have a count or none that has it."""
    kinds = scored.groupBy(F.least("n", F.lit(TOLD_COUNTS)).alias("n")).agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("all"))
    told = sorted((row["n"], row["runs"], row["all"]) for row in kinds.collect())
    least, held = sum(row[2] for row in told) / max(most, 1) + 1, 0  # no more than ``most`` can have so many
    for n, runs, _ in reversed(told):
        held += runs
        if held > most:
            break
        least = n
    found = scored.where(F.col("n") >= F.lit(least)).select("run", "log").toArrow()
    runs, logs = (found.column(c).to_numpy() for c in ("run", "log"))
    order = np.argsort(runs)
    return runs[order], logs[order]


def _score_parts(runs: np.ndarray, logs: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, list, list]:
    """Per text the sum over the frequent runs, and the other runs with how often they occur."""
    codes, starts = encode(texts)
    place, distinct = pd.factorize(codes, sort=True)  # a code is looked up once a block, in order
    at = np.minimum(np.searchsorted(runs, distinct), max(len(runs) - 1, 0))
    known = runs[at] == distinct if len(runs) else np.zeros(len(distinct), dtype=bool)
    own = np.zeros(len(distinct))
    own[known] = logs[at[known]]
    rare = np.flatnonzero(~known[place])
    text = np.searchsorted(starts, rare, side="right") - 1
    pairs, times = np.unique(text * len(distinct) + place[rare], return_counts=True)
    cuts = np.searchsorted(pairs, np.arange(1, len(texts)) * len(distinct))
    return (np.add.reduceat(own[place], starts), np.split(distinct[pairs % max(len(distinct), 1)], cuts),
            np.split(times.astype(np.int32), cuts))


def text_logs(trees: ContextTrees, texts: list[str | None]) -> np.ndarray:
    """log10 probability of every text, its end included."""
    if not len(texts):
        return np.zeros(0)
    codes, starts = encode(texts)
    place, distinct = pd.factorize(codes, sort=True)  # a code is looked up once a block, in order
    return np.add.reduceat(trees.byte_logs(distinct)[place], starts)


def bits_per_byte(score: Column, text: Column) -> Column:
    """Code length of a scored text per byte, the end counted as one."""
    return -score / F.lit(np.log10(2.0)) / (F.coalesce(F.octet_length(text), F.lit(0)) + 1)


def scored_documents(docs: DataFrame, common_runs: int = COMMON_RUNS) -> DataFrame:
    """The contract's row of every document; null texts are empty, null ids count as empty text for the split.

    The unigram base needs every word's count. Words that make up at least 1 / COMMON_PARTS of all tokens
    (so at most COMMON_PARTS of them) are looked up in the task; the rest leave as (row, word, times) and
    are joined to the counts, so no vocabulary has to fit anywhere. The score's runs of bytes go the same two ways.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    learned = rows.where("not held_out")
    words = materialize(learned.select("text").mapInPandas(_count_words, "word binary, n long")
                        .groupBy("word").agg(F.sum("n").alias("c")), "words")
    told = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("kinds")).first()
    tokens, kinds = int(told["tokens"]), int(told["kinds"])
    common = words.where(F.col("c") >= F.lit(max(tokens / COMMON_PARTS, 1.0))).toArrow()
    logs = np.log10(common.column("c").to_numpy() + 1.0).tolist()
    counted = materialize(count_runs(rows.select("text", (~F.col("held_out")).alias("learned"))), "runs")
    runs = materialize(train(counted), "run-logs")
    shared = spark.sparkContext.broadcast((frequent_runs(runs, common_runs), dict(zip(common.column("word").to_pylist(), logs, strict=True))))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, logs = shared.value
        for frame in frames:
            for part in blocks(frame):
                out = part.drop(columns="text")
                out["score"], out["rare_runs"], out["run_times"] = _score_parts(*frequent, part["text"].tolist())
                base = zip(*(_base_parts(text, logs) for text in part["text"]), strict=True)
                for name, values in zip(("n_tokens", "n_common", "common_logs", "rare", "times"), base, strict=True):
                    out[name] = values
                yield out

    passed = materialize(rows.select(F.monotonically_increasing_id().alias("uid"), "*").mapInPandas(
        score, "uid long, doc_id string, held_out boolean, score double, n_tokens long, n_common long, "
               "common_logs double, rare array<binary>, times array<int>, rare_runs array<long>, run_times array<int>"), "scores")
    rare = passed.where(F.size("rare") > 0).select("uid", F.explode(F.arrays_zip("rare", "times")).alias("w")).select(
        "uid", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    rare = rare.join(words, "word").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_logs"), F.sum("times").alias("n_rare"))
    deep = passed.where(F.size("rare_runs") > 0).select("uid", F.explode(F.arrays_zip("rare_runs", "run_times")).alias("r")).select(
        "uid", F.col("r.rare_runs").alias("run"), F.col("r.run_times").alias("times"))
    deep = deep.join(runs.select("run", "log"), "run").groupBy("uid").agg(F.sum(F.col("times") * F.col("log")).alias("deep"))
    base = (F.col("common_logs") + F.coalesce("rare_logs", F.lit(0.0))
            - F.col("n_tokens") * F.log10(F.lit(float(tokens + kinds + 1))))
    return passed.join(rare, "uid", "left").join(deep, "uid", "left").select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "held_out", "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("score") + F.coalesce("deep", F.lit(0.0))).alias("score"))


def _base_parts(text: str | None, logs: dict[bytes, float]) -> tuple[int, int, float, list[bytes], list[int]]:
    """Tokens, common tokens and their logarithms, and the other words with how often they occur."""
    times = Counter(words_of(text))
    times[END_WORD] += 1
    common, total, rare, counts, tokens = 0, 0.0, [], [], 0
    for word, n in times.items():
        tokens += n
        log = logs.get(word)
        if log is None:
            rare.append(word)
            counts.append(n)
        else:
            common += n
            total += n * log
    return tokens, common, total, rare, counts
