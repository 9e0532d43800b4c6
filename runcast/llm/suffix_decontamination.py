"""Benchmark decontamination with suffix arrays over the training words.

Every task builds suffix arrays over the shards of documents it reads and binary-searches each suffix of
the benchmark in them, so documents never move. Words outside the benchmark's vocabulary break the text:
a suffix enters a shard's array only where enough known words follow and its first two words begin some
benchmark suffix, which leaves out nothing that could match. Suffixes are compared by their first ``window``
words; longer matches follow from windows that go on along one diagonal.

A benchmark goes to the tasks in blocks of whole items of about BLOCK_BYTES of text, one block after the
other; where there are several, what each finds in a document is merged in Spark by document and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runcast.operators.keyed import attach
from runcast.session import in_small_batches, materialize

WINDOW = 10
SHARD_WORDS = 1 << 19
BLOCK_BYTES = 4 << 20  # of benchmark texts searched at a time
# A-Z become a-z; digits, a-z and the bytes of other letters are word bytes, all else is a gap
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                    for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


@dataclass
class Suffixes:
    """The benchmark's suffixes cut to ``length`` words: sorted rows of word numbers and who has them."""

    length: int
    keys: np.ndarray  # one fixed-width byte string per distinct suffix, ascending
    first_words: np.ndarray  # by word number: begins a suffix
    first_pairs: np.ndarray  # ascending, word number * vocabulary + next one
    owner_from: np.ndarray  # owners of suffix i are owner_from[i]:owner_from[i + 1]
    owner_item: np.ndarray
    owner_at: np.ndarray


class BenchmarkIndex:
    """Vocabulary and suffixes of items. Items with the same id are one item; null ids are 'null'."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        named = sorted((("null" if item_id is None else str(item_id)), words_of(text)) for item_id, text in items)
        self.item_ids = list(dict.fromkeys(name for name, words in named if words))
        numbers = {name: number for number, name in enumerate(self.item_ids)}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, words in named:
            if words:
                own = np.array([self.vocabulary.setdefault(word, len(self.vocabulary) + 1) for word in words], dtype=np.int64)
                length = min(window, len(own))
                found.setdefault(length, []).append((np.lib.stride_tricks.sliding_window_view(own, length), numbers[name]))
        self.suffixes = [self._suffixes(length, parts) for length, parts in sorted(found.items())]

    def _suffixes(self, length: int, parts: list[tuple[np.ndarray, int]]) -> Suffixes:
        matrix = np.concatenate([rows for rows, _ in parts])
        item = np.repeat([number for _, number in parts], [len(rows) for rows, _ in parts])
        at = np.concatenate([np.arange(len(rows)) for rows, _ in parts])
        keys, inverse = np.unique(_as_keys(matrix), return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        first_words = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        first_words[matrix[:, 0]] = True
        pairs = np.unique(matrix[:, 0] * (len(self.vocabulary) + 1) + (matrix[:, 1] if length > 1 else 0))
        return Suffixes(length, keys, first_words, pairs, np.searchsorted(inverse[order], np.arange(len(keys) + 1)),
                        item[order], at[order])


def _as_keys(matrix: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort alike."""
    return np.ascontiguousarray(matrix.astype(">u4")).view(f"S{4 * matrix.shape[1]}").ravel()


def _suffix_array(words: np.ndarray, known: np.ndarray, suffixes: Suffixes, vocabulary: int) -> tuple:
    """(positions, keys) of the shard's suffixes in order. ``known``: known words from here on."""
    at = np.flatnonzero((known >= suffixes.length) & suffixes.first_words[words])
    if suffixes.length > 1 and len(at):
        pairs = words[at] * (vocabulary + 1) + words[at + 1]
        place = np.minimum(np.searchsorted(suffixes.first_pairs, pairs), len(suffixes.first_pairs) - 1)
        at = at[suffixes.first_pairs[place] == pairs]
    keys = _as_keys(words[at[:, None] + np.arange(suffixes.length)]) if len(at) else np.empty(0, dtype="S1")
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is from."""
    sizes = stops - starts
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes), which


def _longest(doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray, at: np.ndarray, length: np.ndarray,
             n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document the longest verbatim match: words, first word in the document, item number.

    Of equally long ones the first in the document, then the least item.
    """
    doc, length, item, diagonal, at = np.unique(np.stack([doc, length, item, diagonal, at]), axis=1)
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = ((doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1])
                 | (length[1:] != length[:-1]) | (at[1:] != at[:-1] + 1))
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(doc))) + length[starts] - 1
    best = np.lexsort((item[starts], at[starts], -sizes, doc[starts]))
    owners, first = np.unique(doc[starts][best], return_index=True)
    words, place, who = np.zeros(n_docs, dtype=np.int64), np.full(n_docs, -1), np.full(n_docs, -1)
    words[owners], place[owners], who[owners] = sizes[best][first], at[starts][best][first], item[starts][best][first]
    return words, place, who


@dataclass
class Found:
    """What one block of the benchmark has in a document: runs of hit words, items, and the longest match."""

    starts: list[int]
    stops: list[int]
    items: list[str]
    longest: int
    at: int
    item: str | None


def search_shard(texts: list[str | None], index: BenchmarkIndex) -> tuple[list[int], list[Found]]:
    """The words of each text, and what is found in it."""
    get, parts, sizes = index.vocabulary.get, [], []
    for text in texts:
        words = words_of(text)
        parts.append(np.fromiter((get(word, 0) for word in words), dtype=np.int64, count=len(words)))
        sizes.append(len(words))
    n_docs, sizes = len(texts), np.array(sizes, dtype=np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1  # a gap after every document
    words = np.zeros(int(sizes.sum()) + n_docs, dtype=np.int64)
    for start, part in zip(first.tolist(), parts, strict=True):
        words[start:start + len(part)] = part
    total = len(words)
    gaps = np.where(words == 0, np.arange(total), total)
    known = np.minimum.accumulate(gaps[::-1])[::-1] - np.arange(total) if total else gaps
    cover, found = np.zeros(total + 1, dtype=np.int64), []
    for suffixes in index.suffixes:
        at, keys = _suffix_array(words, known, suffixes, len(index.vocabulary))
        low, high = np.searchsorted(keys, suffixes.keys, "left"), np.searchsorted(keys, suffixes.keys, "right")
        place, which = _ranges(low, high)
        if not len(place):
            continue
        place = at[place]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + suffixes.length, -1)
        owner, match = _ranges(suffixes.owner_from[which], suffixes.owner_from[which + 1])
        doc = np.searchsorted(first, place[match], "right") - 1
        found.append((doc, suffixes.owner_item[owner], place[match] - first[doc] - suffixes.owner_at[owner],
                      place[match] - first[doc], np.full(len(doc), suffixes.length)))
    out = [Found([], [], [], 0, -1, None) for _ in range(n_docs)]
    if found:
        doc, item, diagonal, at, length = (np.concatenate(column) for column in zip(*found, strict=True))
        hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
        for start, stop in zip(np.flatnonzero(hit[1:] & ~hit[:-1]).tolist(), np.flatnonzero(hit[:-1] & ~hit[1:]).tolist(), strict=True):
            own = int(np.searchsorted(first, start, "right")) - 1
            out[own].starts.append(start - int(first[own]))
            out[own].stops.append(stop - int(first[own]))
        for d, i in np.unique(np.stack([doc, item], axis=1), axis=0).tolist():
            out[d].items.append(index.item_ids[i])
        for own, size, place, who in zip(out, *(x.tolist() for x in _longest(doc, item, diagonal, at, length, n_docs)), strict=True):
            if size:
                own.longest, own.at, own.item = size, place, index.item_ids[who]
    return sizes.tolist(), out


def told(parts: list[Found]) -> list:
    """n_hit, n_items, items_sha256, contaminated and the longest match from what all blocks have found."""
    hit, reached = 0, 0
    for start, stop in sorted((a, b) for part in parts for a, b in zip(part.starts, part.stops, strict=True)):
        hit += max(stop - max(start, reached), 0)
        reached = max(reached, stop)
    items = sorted({name for part in parts for name in part.items})
    best = min((part for part in parts if part.longest), key=lambda part: (-part.longest, part.at, part.item),
               default=Found([], [], [], 0, -1, None))
    return [hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0, best.longest, best.at, best.item]


def _shards(frame: pd.DataFrame, text_col: str) -> Iterator[pd.DataFrame]:
    """Runs of rows with about SHARD_WORDS words (six bytes each); a longer text is a shard of its own."""
    size = frame[text_col].str.len().fillna(0).to_numpy(dtype=np.float64).cumsum() // (6 * SHARD_WORDS)
    for _, rows in frame.groupby(size, sort=True):
        yield rows


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[BenchmarkIndex]:
    """Indices of blocks of whole items, one at a time. The benchmark is a stated query set."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    for block in range(count):
        rows = named.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == block).toArrow()
        yield BenchmarkIndex(list(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True)), window)


_TOLD = ["n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_at", "longest_item"]
MATCH_SCHEMA = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
                "longest_match long, longest_at long, longest_item string")
_PART = "starts array<long>, stops array<long>, items array<string>, longest long, at long, item string"
_PART_NAMES = ["starts", "stops", "items", "longest", "at", "item"]


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield from _shards(frame, "text")


def _found_by_blocks(docs: DataFrame, indices: Iterator[BenchmarkIndex]) -> DataFrame:
    """(doc_id, digest, part) of documents in which a block of the benchmark has been found, written block by block."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))
                       .alias("digest"), F.col("text").cast("string").alias("text"))
    written = []
    for index in indices:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for part in _texts(frames):
                found = search_shard(part["text"].tolist(), shared.value)[1]
                hit = [bool(own.starts) for own in found]
                if any(hit):
                    yield part.loc[hit, ["doc_id", "digest"]].assign(
                        **{name: [getattr(own, name) for own in found if own.starts] for name in _PART_NAMES})

        once = in_small_batches(rows).mapInPandas(search, f"doc_id string, digest string, {_PART}")
        whole = F.first(F.struct(*_PART_NAMES)).alias("part")  # repeated rows have found the same
        written.append(materialize(once.groupBy("doc_id", "digest").agg(whole), "found"))
        shared.unpersist()
    return reduce(DataFrame.union, written)


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and matches of every row: words hit by any benchmark window, items, longest verbatim match.

    (n_words, n_hit, n_items, items_sha256, contaminated, longest_match, longest_at, longest_item): the longest
    match in words, the document's word it begins with (from 0; -1 without a match) and its item. Null and
    wordless texts have no words and no hits; wordless items and empty benchmarks match nothing. Repeated rows
    and null ids stay as they are; an empty table gives no rows.
    """
    indices = benchmark_blocks(benchmark, window, block_bytes)
    first, second = next(indices), next(indices, None)
    kind = docs.schema["doc_id"].dataType
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)

        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in _texts(frames):
                sizes, found = search_shard(part["text"].tolist(), shared.value)
                out = pd.DataFrame([told([own]) for own in found], columns=_TOLD)
                out.insert(0, "n_words", sizes)
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield out

        rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return in_small_batches(rows).mapInPandas(search, f"doc_id string, {MATCH_SCHEMA}").withColumn("doc_id", F.col("doc_id").cast(kind))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [told([Found(*[own[name] for name in _PART_NAMES]) for own in row]) for row in frame["parts"]]
            yield pd.concat([frame[["doc_id", "digest"]].reset_index(drop=True), pd.DataFrame(parts, columns=_TOLD)], axis=1)

    found = _found_by_blocks(docs, chain([first, second], indices)).groupBy("doc_id", "digest").agg(
        F.collect_list("part").alias("parts"))
    merged = found.mapInPandas(merge, "doc_id string, digest string, " + MATCH_SCHEMA.replace("n_words long, ", ""))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["doc_id", "digest"]].assign(n_words=[len(words_of(text)) for text in frame["text"]])

    every = in_small_batches(docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"),
        F.col("text").cast("string").alias("text"))).mapInPandas(count, "doc_id string, digest string, n_words long")
    none = dict(zip(_TOLD, told([]), strict=True))
    joined = attach(every, merged, ["doc_id", "digest"])
    return joined.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_words", *[
        F.coalesce(name, F.lit(none[name])).alias(name) if none[name] is not None else F.col(name) for name in _TOLD])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, unchanged; a benchmark of one block moves none of them."""
    indices = benchmark_blocks(benchmark, window, block_bytes)
    first, second = next(indices), next(indices, None)
    if second is not None:
        found = _found_by_blocks(docs, chain([first, second], indices)).select(
            F.col("doc_id").alias("found_id"), F.col("digest").alias("found_digest")).distinct()
        digest = F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))
        same = docs["doc_id"].cast("string").eqNullSafe(F.col("found_id")) & (digest == F.col("found_digest"))
        return docs.join(found, same, "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pd.DataFrame({"text": batch.column("text").to_pandas()})
            kept = [not own.starts for part in _shards(texts, "text")
                    for own in search_shard(part["text"].tolist(), shared.value)[1]]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return in_small_batches(docs).mapInArrow(clean, docs.schema)


ORACLE = r"""
WITH
  low AS (SELECT row_number() OVER () AS uid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  doc AS MATERIALIZED (SELECT uid, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
  item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  item_window AS MATERIALIZED (
    SELECT DISTINCT item_id, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS key FROM (
      SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos
      FROM item WHERE len(w) > 0)),
  lengths AS (SELECT DISTINCT n FROM item_window),
  doc_window AS (
    SELECT uid, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS key FROM (
      SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM doc, lengths WHERE len(w) >= n)),
  found AS MATERIALIZED (SELECT d.uid, d.n, d.pos, i.item_id FROM doc_window d JOIN item_window i USING (n, key)),
  item_place AS (
    SELECT item_id::VARCHAR AS id, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS key FROM (
      SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos
      FROM item WHERE len(w) > 0)),
  along AS (SELECT DISTINCT d.uid, i.id, d.n, d.pos - i.pos AS diagonal, d.pos FROM doc_window d JOIN item_place i USING (n, key)),
  runs AS (
    SELECT uid, id, count(*) + n - 1 AS longest, min(pos) - 1 AS begins FROM (
      SELECT *, pos - row_number() OVER (PARTITION BY uid, id, n, diagonal ORDER BY pos) AS run FROM along)
    GROUP BY uid, id, n, diagonal, run),
  best AS (
    SELECT uid, id, longest, begins FROM runs
    QUALIFY row_number() OVER (PARTITION BY uid ORDER BY longest DESC, begins, id) = 1),
  hit AS (SELECT uid, count(DISTINCT word) AS n_hit FROM (
    SELECT uid, unnest(range(pos, pos + n)) AS word FROM found) GROUP BY uid),
  items AS (SELECT uid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (
    SELECT DISTINCT uid, item_id::VARCHAR AS id FROM found) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
  coalesce(longest, 0)::BIGINT AS longest_match, coalesce(begins, -1)::BIGINT AS longest_at, best.id AS longest_item
FROM doc LEFT JOIN hit USING (uid) LEFT JOIN items USING (uid) LEFT JOIN best USING (uid)"""
