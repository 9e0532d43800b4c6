"""Prefix trie of conversations in adaptive radix trees over fixed-width turn ids.

A turn's id is the first 16 bytes of the SHA-256 of its role and text, so a conversation is a byte string of
16 bytes a turn and equal prefixes of turns are equal prefixes of bytes. Tasks hold ids and text lengths,
never texts. Strings are dealt over tasks by range, in byte order; copies of a conversation become one string
with a count first. Each task puts its strings, some thousands at a time, into an adaptive radix tree: nodes
grow from 4 to 16, 48 and 256 children, runs of bytes without a branch are kept in one node, and only depths
that are a whole number of turns give trie nodes, also inside such a run.

Strings of a slice are neighbours in the order, so only nodes on the way to its first or its last string can
have members in other slices. All others are finished with their subtree where they stand. The open ones,
a few per slice, carry what their finished children added up to; they are summed by path, put into trees
again, and so on until one slice holds all that is left. So a turn, conversation or prefix with a third of
all members is spread over as many tasks as it has rows, and no round moves more than the open nodes.

A digest of ids in order is a sequential thing: the ids of one node are written as chunks by the tasks that
have them, and one task joins those chunks as a stream.

Defined results: an empty table gives no rows, not even the root. Rows without a conv_id belong to no
conversation and play no part. Null numbers of turns come first; turns of one number are ordered by id
(as good as any order, and the same each time); repeated rows are turns of their own. ``c % 100`` has the
sign of c. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runcast.operators.keyed import attach
from runcast.session import materialize

WIDTH = 16
SLICE_BYTES = 4 << 20  # bytes of strings in one tree
CHUNK_IDS = 8192  # ids written into one chunk
GROUP, HEADS = 100, 6  # conversation c starts like conversation c - c % GROUP, for fewer than HEADS turns
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


# ---- adaptive radix tree

class Small:
    """Up to 4 or 16 children: their bytes in order, and the children in the same order."""

    __slots__ = ("room", "labels", "children")

    def __init__(self, room: int, labels: bytearray, children: list):
        self.room, self.labels, self.children = room, labels, children

    def find(self, label: int):
        at = bisect_left(self.labels, label)
        return self.children[at] if at < len(self.labels) and self.labels[at] == label else None

    def put(self, label: int, child):
        """The layout that has the child: this one, or a larger one if this is full."""
        at = bisect_left(self.labels, label)
        if at < len(self.labels) and self.labels[at] == label:
            self.children[at] = child
            return self
        if len(self.labels) == self.room:
            grown = Small(16, self.labels, self.children) if self.room == 4 else Indexed.of(self)
            return grown.put(label, child)
        self.labels.insert(at, label)
        self.children.insert(at, child)
        return self

    def each(self) -> Iterator[tuple[int, object]]:
        return zip(self.labels, self.children, strict=True)


class Indexed:
    """Up to 48 children: a place for each of 256 bytes that names the child's slot."""

    __slots__ = ("slots", "children")

    def __init__(self):
        self.slots, self.children = bytearray(b"\xff" * 256), []

    @staticmethod
    def of(small: Small) -> Indexed:
        grown = Indexed()
        for label, child in small.each():
            grown.put(label, child)
        return grown

    def find(self, label: int):
        slot = self.slots[label]
        return None if slot == 0xFF else self.children[slot]

    def put(self, label: int, child):
        slot = self.slots[label]
        if slot != 0xFF:
            self.children[slot] = child
            return self
        if len(self.children) == 48:
            return Direct.of(self).put(label, child)
        self.slots[label] = len(self.children)
        self.children.append(child)
        return self

    def each(self) -> Iterator[tuple[int, object]]:
        return ((label, self.children[slot]) for label, slot in enumerate(self.slots) if slot != 0xFF)


class Direct:
    """A child, or none, for each byte."""

    __slots__ = ("children",)

    def __init__(self):
        self.children = [None] * 256

    @staticmethod
    def of(indexed: Indexed) -> Direct:
        grown = Direct()
        for label, child in indexed.each():
            grown.children[label] = child
        return grown

    def find(self, label: int):
        return self.children[label]

    def put(self, label: int, child):
        self.children[label] = child
        return self

    def each(self) -> Iterator[tuple[int, object]]:
        return ((label, child) for label, child in enumerate(self.children) if child is not None)


class Node:
    """The bytes [start, end) of ``key`` without a branch, then what ends there and the children."""

    __slots__ = ("key", "start", "end", "held", "below")

    def __init__(self, key: bytes, start: int, end: int, held=None):
        self.key, self.start, self.end, self.held, self.below = key, start, end, held, None

    def children(self) -> Iterator[tuple[int, Node]]:
        return iter(()) if self.below is None else self.below.each()

    def add(self, label: int, child: Node) -> None:
        below = Small(4, bytearray(), []) if self.below is None else self.below
        self.below = below.put(label, child)


def shared_length(left: bytes, right: bytes, start: int, end: int) -> int:
    """The first place in [start, end) where the two differ, else ``end``."""
    while start < end:
        step = min(64, end - start)
        a, b = left[start:start + step], right[start:start + step]
        if a != b:
            return start + next(k for k in range(step) if a[k] != b[k])
        start += step
    return end


class RadixTree:
    """Byte strings with what is held for each; one string may begin another."""

    def __init__(self):
        self.root = Node(b"", 0, 0)

    def insert(self, key: bytes, held) -> None:
        node = self.root
        while True:
            at = shared_length(node.key, key, node.start, min(node.end, len(key)))
            if at < node.end:  # the run of bytes ends or branches here
                rest = Node(node.key, at, node.end, node.held)
                rest.below = node.below
                node.end, node.held, node.below = at, None, None
                node.add(rest.key[at], rest)
            if at == len(key):
                node.held = held
                return
            child = None if node.below is None else node.below.find(key[at])
            if child is None:
                node.add(key[at], Node(key, at, len(key), held))
                return
            node = child


# ---- what is known of a trie node

class Known:
    """What finished parts of a node add up to: members, least member, finished children and their subtrees."""

    __slots__ = ("n", "least", "ends", "children", "leaves", "saved")

    def __init__(self, n: int = 0, least: int | None = None, ends: str | None = None, children: int = 0, leaves: int = 0,
                 saved: int = 0):
        self.n, self.least, self.ends = n, least, ends
        self.children, self.leaves, self.saved = children, leaves, saved

    def add(self, other: Known) -> None:
        """Another part of the same node."""
        self.n += other.n
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends
        if self.least is None or other.least is not None and other.least < self.least:
            self.least = other.least

    def take(self, child: Known) -> None:
        """A finished child with its subtree."""
        self.add(Known(child.n, child.least, None, 1, child.leaves, child.saved))

    def finish(self, chars: int) -> None:
        """All is known now: a node without children is a leaf itself, and its own copies are saved."""
        self.leaves += self.children == 0
        self.saved += (self.n - 1) * chars


class String:
    """A conversation, or the way to an open node: its bytes, text lengths by turn, and what is known by depth."""

    __slots__ = ("key", "chars", "parts")

    def __init__(self, key: bytes, chars: list[int], parts: dict[int, Known]):
        self.key, self.chars, self.parts = key, chars, parts


class TrieNode:
    __slots__ = ("key", "depth", "known", "open")

    def __init__(self, key: bytes, depth: int, known: Known, opened: bool):
        self.key, self.depth, self.known, self.open = key, depth, known, opened

    def digest(self) -> bytes:
        return hashlib.blake2b(self.key[:self.depth * WIDTH], digest_size=WIDTH).digest()


def trie_nodes(strings: list[String], final: bool) -> Iterator[tuple[TrieNode, TrieNode | None]]:
    """Every trie node of a slice with its parent (None for the root), both complete but for open ones.

    ``strings`` are in byte order, each key once. Open are the nodes on the way to the first or the last
    string, unless the slice is ``final`` and has no neighbours.
    """
    tree = RadixTree()
    for string in strings:
        tree.insert(string.key, string)
    first, last = strings[0].key, strings[-1].key
    stack: list = [(tree.root, tree.root.children(), [], [])]
    while stack:
        node, rest, waiting, beneath = stack[-1]
        child = next(rest, None)
        if child is not None:
            stack.append((child[1], child[1].children(), [], []))
            continue
        stack.pop()
        if node.held is not None:
            beneath.append(node.held)
        key = node.key
        reach = -1 if final else max(shared_length(first, key, 0, min(len(first), node.end)),
                                     shared_length(last, key, 0, min(len(last), node.end)))
        chars = beneath[0].chars  # all beneath agree up to the node's end
        least_depth = node.start // WIDTH + 1 if node.end else 0
        for depth in range(node.end // WIDTH, least_depth - 1, -1):  # the turn-aligned depths of this run, if any
            known = Known()
            for string in beneath:
                if depth in string.parts:
                    known.add(string.parts[depth])
            for trie_node in waiting:
                if not trie_node.open:
                    known.take(trie_node.known)
            current = TrieNode(key, depth, known, depth * WIDTH <= reach)
            if not current.open:
                known.finish(chars[depth - 1] if depth else 0)
            for trie_node in waiting:
                yield trie_node, current
            waiting = [current]
        if stack:
            stack[-1][2].extend(waiting)
            stack[-1][3].extend(beneath)
        else:
            yield waiting[0], None


# ---- slices as rows

_DONE = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
         ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
         ("node", pa.binary()), ("parent", pa.binary())]
_LONGS = pa.list_(pa.int64())
_OPEN = [("key", pa.binary()), ("chars", _LONGS), ("n", _LONGS), ("least", _LONGS), ("ends", pa.list_(pa.string())),
         ("children", _LONGS), ("leaves", _LONGS), ("saved", _LONGS)]
_SCHEMA = pa.schema(_DONE + _OPEN)
_FOLDED = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
           "ends_sha256 string, node binary, parent binary, key binary, chars array<long>, n array<long>, least array<long>, "
           "ends array<string>, children array<long>, leaves array<long>, saved array<long>")


def _open_row(string: String, parts: dict[int, Known]) -> dict:
    known = [parts.get(depth, Known()) for depth in range(len(string.chars) + 1)]
    return {"key": string.key, "chars": string.chars} | {
        name: [getattr(k, name) for k in known] for name in ("n", "least", "ends", "children", "leaves", "saved")}


def fold(strings: list[String], final: bool, ever_open: bool) -> Iterator[pa.RecordBatch]:
    """The rows of one slice: finished nodes, and at most two ways of open ones.

    Only nodes that have been open in some round (``ever_open``) need a name, by which their children find
    them. A finished child of an open node names its parent instead of giving the parent's least member.
    """
    rows: list[dict] = []
    first, last = strings[0], strings[-1]
    ways: dict[bytes, dict[int, Known]] = {first.key: {}, last.key: {}}
    names: dict[tuple[int, bool], bytes] = {}
    for node, parent in trie_nodes(strings, final):
        known = node.known
        if node.open:
            end = node.depth * WIDTH
            ways[first.key if first.key[:end] == node.key[:end] else last.key][node.depth] = known
            continue
        row = {"conv_id": known.least, "depth": node.depth, "n_convs": known.n, "n_children": known.children,
               "n_leaves": known.leaves, "saved_tokens": known.saved, "ends_sha256": known.ends or EMPTY_SHA256,
               "node": node.digest() if ever_open else None}
        if parent is not None and parent.open:
            place = parent.depth, first.key[:parent.depth * WIDTH] == parent.key[:parent.depth * WIDTH]
            if place not in names:
                names[place] = parent.digest()
            row["parent"] = names[place]
        elif parent is not None:
            row["parent_conv_id"] = parent.known.least
        rows.append(row)
        if len(rows) >= 8192:
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
            rows = []
    if not final:
        rows.extend(_open_row(string, ways[string.key]) for string in ((first, last) if last is not first else (first,)))
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


def _slices(strings: Iterator[String], limit: int | None) -> Iterator[list[String]]:
    held, size = [], 0
    for string in strings:
        held.append(string)
        size += len(string.key) + WIDTH
        if limit is not None and size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


# ---- passes

def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn; nulls are empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(named.cast("binary"), 256)), 1, WIDTH)


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the ids and text lengths of each conversation's turns, in order."""
    turns = conversations.select(
        F.expr("try_cast(conv_id AS BIGINT)").alias("conv_id"), "turn", turn_id(F.col("role"), F.col("text")).alias("id"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars")).where("conv_id is not null")
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "chars"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, turns) with the first turns taken from the conversation that leads its hundred."""
    lead = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = own.where(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("lead"), F.slice("turns", 1, HEADS - 1).alias("head"))
    count = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), count), F.slice("turns", 1, 0))
    rest = F.slice("turns", count + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(heads, lead == F.col("lead"), "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal strings in order become rows with a count and their ids as text."""
    schema = pa.schema([("key", pa.binary()), ("chars", _LONGS), ("n", pa.int64()), ("least", pa.int64()), ("ids", pa.string())])
    rows: list[dict] = []
    held, chars, ids = None, None, []

    def row() -> dict:
        return {"key": b"".join(held), "chars": chars, "n": len(ids), "least": ids[0], "ids": ",".join(map(str, ids))}

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("ids", "chars", "conv_id")]
        for key, lengths, conv_id in zip(*columns, strict=True):
            if key != held or len(ids) >= CHUNK_IDS:
                if ids:
                    rows.append(row())
                held, chars, ids = key, lengths, []
            ids.append(conv_id)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if ids:
        yield pa.RecordBatch.from_pylist([row()], schema)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[String]:
    """One string per key from its chunks, which come in order; the digest runs over their ids."""
    key, chars, known, digest = None, None, None, None

    def closed() -> String:
        known.ends = digest.hexdigest()
        return String(key, chars, {len(chars): known})

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "chars", "n", "least", "ids")]
        for own, lengths, n, least, ids in zip(*columns, strict=True):
            if own == key:
                known.n += n
                digest.update(b"," + ids.encode())
            else:
                if key is not None:
                    yield closed()
                key, chars, known, digest = own, lengths, Known(n, least), hashlib.sha256(ids.encode())
    if key is not None:
        yield closed()


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[String]:
    """The open ways of an earlier round."""
    for batch in batches:
        for row in batch.to_pylist():
            known = zip(*[row[name] for name in ("n", "least", "ends", "children", "leaves", "saved")], strict=True)
            yield String(row["key"], row["chars"], {depth: Known(*values) for depth, values in enumerate(known)})


def prefix_trie(conversations: DataFrame, slice_bytes: int = SLICE_BYTES, last_entries: int = 200_000) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per trie node.

    A node is named by its least member and its depth. ``slice_bytes`` bounds one tree, ``last_entries`` the
    open nodes at which one task finishes the rest.
    """
    own = materialize(own_turns(conversations), "own-turns")
    members = materialize(rebuilt(own).select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars")),
                          "members")
    chunks = members.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id").mapInArrow(
        _chunks, "key binary, chars array<long>, n long, least long, ids string")
    chunks = materialize(chunks, "chunks")

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for strings in _slices(_distinct(batches), slice_bytes):
            yield from fold(strings, final=False, ever_open=False)

    folded = materialize(chunks.repartitionByRange("key").sortWithinPartitions("key", "least").mapInArrow(
        first_round, _FOLDED), "trie")
    finished = [folded.where("key is null")]
    entries = None
    while True:
        ways = folded.where("key is not null").select(*[name for name, _ in _OPEN])
        seen, entries = entries, ways.agg(F.sum(F.size("n"))).first()[0] or 0
        if not entries:
            break
        final = entries <= last_entries or seen is not None and 2 * entries > seen

        def round_of(batches: Iterator[pa.RecordBatch], final: bool = final) -> Iterator[pa.RecordBatch]:
            for strings in _slices(_ways(batches), None if final else slice_bytes):
                yield from fold(strings, final, ever_open=True)

        dealt = ways.repartition(1) if final else ways.repartitionByRange("key")
        folded = materialize(dealt.sortWithinPartitions("key").mapInArrow(round_of, _FOLDED), "trie")
        finished.append(folded.where("key is null"))
        if final:
            break
    columns = [name for name, _ in _DONE]
    named = [part.select(*columns) for part in finished]
    nodes = named[0]
    for part in named[1:]:
        nodes = nodes.union(part)
    whole = nodes.where("parent is null").select(*columns[:8])
    parents = nodes.where("node is not null").select(F.col("node").alias("parent"), F.col("conv_id").alias("least"))
    orphans = attach(nodes.where("parent is not null"), parents, ["parent"])
    return whole.union(orphans.withColumn("parent_conv_id", F.col("least")).select(*columns[:8]))


ORACLE = f"""
WITH crc_table AS (SELECT list(value ORDER BY n) AS t FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS value
    FROM (SELECT unnest(range(256)) AS n))),
turns AS (
  SELECT conv_id, turn, coalesce(length(text), 0) AS chars,
    substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, {2 * WIDTH}) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id, chars) AS place FROM turns),
heads AS (
  SELECT conv_id, held, xor(list_reduce(list_transform(range(strlen(conv_id::VARCHAR)),
      lambda i: ord(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {HEADS} AS h
  FROM (SELECT conv_id, count(*) AS held FROM own GROUP BY conv_id), crc_table),
rebuilt AS (
  SELECT heads.conv_id, 0 AS part, place, id, chars FROM heads
  JOIN own ON own.conv_id = heads.conv_id - heads.conv_id % {GROUP} AND place <= h
  UNION ALL
  SELECT heads.conv_id, 1, place, id, chars FROM heads JOIN own ON own.conv_id = heads.conv_id AND place > h),
strings AS (
  SELECT heads.conv_id, coalesce(list(id ORDER BY part, place) FILTER (id IS NOT NULL), []) AS ids,
    coalesce(list(chars ORDER BY part, place) FILTER (id IS NOT NULL), []) AS lengths
  FROM heads LEFT JOIN rebuilt USING (conv_id) GROUP BY heads.conv_id),
prefixes AS (
  SELECT conv_id, depth, ids, array_to_string(ids[1:depth], '') AS path, array_to_string(ids[1:depth - 1], '') AS above,
    coalesce(lengths[depth], 0) AS chars, len(ids) = depth AS ends
  FROM (SELECT *, unnest(range(len(ids) + 1)) AS depth FROM strings)),
nodes AS (
  SELECT depth, path, any_value(above) AS above, any_value(ids) AS ids, min(conv_id) AS least, count(*) AS n,
    any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, path),
counted AS (
  SELECT nodes.*, coalesce(children, 0) AS children
  FROM nodes LEFT JOIN (SELECT depth - 1 AS depth, above AS path, count(*) AS children FROM nodes WHERE depth > 0
                        GROUP BY ALL) k USING (depth, path)),
sums AS (
  SELECT d AS depth, array_to_string(ids[1:d], '') AS path, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) AS leaves,
    sum((n - 1) * chars) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM counted) GROUP BY ALL)
SELECT c.least AS conv_id, c.depth, p.least AS parent_conv_id, c.n AS n_convs, c.children AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s USING (depth, path) LEFT JOIN counted p ON p.depth = c.depth - 1 AND p.path = c.above"""
