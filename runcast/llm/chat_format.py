"""Chat formatting by incremental black-box rendering.

A template is only called, never read: it turns a list of turns into one string. A conversation is rendered
turn by turn, each prefix is compared with the one before, and what was added is the span of the new turn.
Two further renderings, with one letter and with another in place of the new turn's text, differ in that
text alone, which tells where the text lies inside its span. If a prefix does not begin with the one before,
the template has rewritten history: the sample ends there and a new one starts with the whole new rendering,
in which only turns from then on can count for the loss.

A template says how many turns back its rendering of a turn can look (``context``); each comparison then
renders only that many turns before the new one, so a conversation costs time in proportion to its length.
With ``context=None`` whole prefixes are rendered.

Turns of a conversation are streamed in order through one task (a digest of them has no other order); a task
holds the context only, and one row per turn comes out. Defined results: a null text or role is empty, turns
with null numbers come first, equal numbers are ordered by role and text, repeated rows are turns of their
own, rows without a conversation id form one conversation; an empty table gives no rows. Columns beside the
four are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

Turn = tuple[str, str]
LOSS_ROLE = "assistant"
# conversation that says control strings itself, to be formatted with all others
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"
BATCH_CHARS = 4 << 20  # a task hands its rows on after so much text


@dataclass(frozen=True)
class Template:
    """A black box ``render(turns) -> text``, with the way back from a text it wrote to the text it was given.

    ``context`` is the number of earlier turns that can change how a turn is rendered (at least one, since
    the first turn may be special); None if all can.
    """

    render: Callable[[list[Turn]], str]
    unescape: Callable[[str], str] = field(default=lambda text: text)
    context: int | None = None


# ---- the template of the query: every turn is [INST]role[/INST]text</s>, the conversation starts with <s>

CONTROL = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]")
# a control string with any number of strokes after its bracket; one more stroke escapes it
_TO_ESCAPE = re.compile(r"(<\\*)(?=/?s>)|(\[\\*)(?=/?INST\])")
_ESCAPED = re.compile(r"(<\\*)\\(?=/?s>)|(\[\\*)\\(?=/?INST\])")


def escape(text: str) -> str:
    """No control string is left: a stroke goes in after its bracket. Other texts stay as they are."""
    return _TO_ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group()[:-1], text)


def render_marked(turns: list[Turn]) -> str:
    return "<s>" + "".join(f"[INST]{escape(role)}[/INST]{escape(text)}</s>" for role, text in turns)


MARKED = Template(render_marked, unescape, context=1)


def parse_marked(output: str) -> list[Turn]:
    """The turns back from ``render_marked``."""
    if not output.startswith("<s>"):
        raise ValueError("no conversation")
    turns, at = [], 3
    while at < len(output):
        marks = [m for _, m in zip(range(3), CONTROL.finditer(output, at))]
        if [m.group() for m in marks] != ["[INST]", "[/INST]", "</s>"] or marks[0].start() != at:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(output[marks[0].end():marks[1].start()]), unescape(output[marks[1].end():marks[2].start()])))
        at = marks[2].end()
    return turns


# ---- rendering

@dataclass
class Located:
    """One turn in the output: ``added`` is appended to the sample, the text lies at [start, end) of ``added``."""

    added: str
    start: int
    end: int
    rewritten: bool


def locate_turns(template: Template, turns: Iterator[Turn]) -> Iterator[Located]:
    """Each turn's addition to the output, from renderings of successive prefixes."""
    window: list[Turn] = []
    before = ""  # rendering of the window
    for role, text in turns:
        now = template.render([*window, (role, text)])
        probes = [template.render([*window, (role, mark)]) for mark in "ab"]
        rewritten = not now.startswith(before)
        kept = 0 if rewritten else len(before)
        if probes[0] == probes[1]:  # a turn that is left out
            head, tail = len(now), 0
        else:
            head = _shared(*probes)
            tail = len(probes[0]) - head - 1
        if probes[0][head + 1:] != probes[1][head + 1:] or head < kept or len(now) < head + tail:
            raise ValueError("the template shows a turn's text elsewhere than in one place of its own turn")
        yield Located(now[kept:], head - kept, len(now) - tail - kept, rewritten)
        window = [*window, (role, text)]
        if template.context is not None and len(window) > template.context:
            window = window[-template.context:]
            before = template.render(window)
        else:
            before = now


def _shared(left: str, right: str) -> int:
    """Length of the longest common beginning, by halving steps."""
    low, high = 0, min(len(left), len(right))
    while low < high:
        middle = (low + high + 1) // 2
        if left[low:middle] == right[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def format_turns(conversations: DataFrame, template: Template = MARKED, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per turn, in the order of its conversation inside each partition.

    (conv_id, position, role, sample, added, start, text_start, text_end, loss, rewritten): ``added`` follows
    the sample's output so far, at code point ``start``; the turn's text, as the template wrote it, is
    [text_start, text_end). ``loss`` marks turns of ``loss_role``. Joined in order, the additions of a sample
    are what the template gives for its turns. ``sample`` counts up where history was ``rewritten``.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["conv_id"].dataType
    names = ["conv_id", "position", "role", "sample", "added", "start", "text_start", "text_end", "loss", "rewritten"]
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(),
             pa.bool_(), pa.bool_()]
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def turns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Turn]]:
        for batch in batches:
            yield from zip(batch.column("conv_id").to_pylist(),
                           zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True), strict=True)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = turns_of(batches)
        upcoming = next(source, None)
        out: list[tuple] = []
        held = 0

        while upcoming is not None:
            conv_id, roles = upcoming[0], []

            def same(conv_id=conv_id, roles=roles) -> Iterator[Turn]:
                nonlocal upcoming
                while upcoming is not None and upcoming[0] == conv_id:
                    turn = upcoming[1]
                    roles.append(turn[0])
                    upcoming = next(source, None)
                    yield turn

            sample, start = 0, 0
            for position, found in enumerate(locate_turns(template, same())):
                role = roles.pop()
                if found.rewritten:
                    sample, start = sample + 1, 0
                out.append((conv_id, position, role, sample, found.added, start, start + found.start, start + found.end,
                            role == loss_role, found.rewritten))
                start += len(found.added)
                held += len(found.added) + 64
                if held > BATCH_CHARS:
                    yield _batch(out, names, types)
                    out, held = [], 0
        if out:
            yield _batch(out, names, types)

    return ordered.mapInArrow(render, f"conv_id {kind.simpleString()}, position long, role string, sample int, added string, "
                                      "start long, text_start long, text_end long, loss boolean, rewritten boolean")


def _batch(rows: list, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)], names)


def digests(turns: DataFrame, template: Template = MARKED) -> DataFrame:
    """One row per conversation, read back from the output of ``format_turns`` as it stands in each partition.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): the role and the text of every
    turn come from the formatted text alone, by the marks in it.
    """
    kind = turns.schema["conv_id"].dataType
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        current = None

        def close() -> None:
            out.append([current["id"], current["n"], current["turns"].hexdigest(), current["loss_chars"],
                        current["loss"].hexdigest(), current["chars"]])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "added", "start", "text_start", "text_end", "loss")]
            for conv_id, added, start, first, last, loss in zip(*columns, strict=True):
                if current is None or current["id"] != conv_id:
                    if current is not None:
                        close()
                    current = {"id": conv_id, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(),
                               "chars": 0}
                [(role, text)] = parse_marked(added if start == 0 else "<s>" + added)
                current["n"] += 1
                current["chars"] += len(added)
                current["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss:
                    masked = template.unescape(added[first - start:last - start])
                    current["loss_chars"] += len(masked)
                    current["loss"].update(masked.encode("utf-8", "surrogatepass"))
            if len(out) >= 4096:
                yield _batch(out, names, types)
                out = []
        if current is not None:
            close()
        if out:
            yield _batch(out, names, types)

    return turns.mapInArrow(read, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, "
                                  "loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, of a user and an assistant who both say control strings."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    probe = conversations.sparkSession.range(2).select(
        F.lit(PROBE_ID).cast(kind).alias("conv_id"), F.col("id").cast(conversations.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").union(probe)


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and the probe, formatted with the marked template and read back."""
    return digests(format_turns(with_probe(conversations)))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
written AS (
  SELECT *, regexp_replace(regexp_replace(role, '(<\\*)(/?s>)', '\1\\\2', 'g'), '(\[\\*)(/?INST\])', '\1\\\2', 'g') AS wrole,
    regexp_replace(regexp_replace(text, '(<\\*)(/?s>)', '\1\\\2', 'g'), '(\[\\*)(/?INST\])', '\1\\\2', 'g') AS wtext
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length(wrole) + length(wtext) + 17) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id"""
