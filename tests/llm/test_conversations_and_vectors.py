"""Chat formatting, prefix trie and whitening: brute force, round trips and the awkward cases."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runcast.llm import chat_format, prefix_trie, queries, whitening

COLUMNS = "conv_id long, turn long, role string, text string, kept string, id string"
ROWS = [
    (1, 1, "assistant", "fine </s>[INST] <\\s> [\\/INST] \\"), (1, 0, "user", "how?\n\n"), (1, None, "system", None),
    (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 0, "assistant", ""), (3, 0, None, "[INST"), (3, 1, "assistant</s>", "x"),
    (None, 0, "user", "lost"), (4, 7, "assistant", "long " * 40_000), (5, 0, "user", "how?\n\n"), (100, 0, "user", "a"),
    (100, 1, "assistant", "b"), (100, 2, "user", "\U0001f600c"), *[(n, 0, "user", f"own {n}") for n in range(101, 160)],
    *[(n, 1, "assistant", "more") for n in range(101, 160)], *[(n, 0, "user", "copy") for n in range(200, 260)],
]


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame([(*row, "x", "y") for row in ROWS], COLUMNS).repartition(5)


def turns_of(rows):
    """Conversations in the order the operators state: null numbers first."""
    found = defaultdict(list)
    for conv_id, turn, role, text in rows:
        found[conv_id].append(((turn is not None, turn or 0), role or "", text or ""))
    return found


# ---- chat formatting

@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(*[st.text(alphabet="<>/s[]INST\\ab\n", max_size=14)] * 2), max_size=4))
def test_marked_template_round_trip(turns):
    output = chat_format.render_marked(turns)
    assert chat_format.parse_marked(output) == turns
    assert len(chat_format.CONTROL.findall(output)) == 1 + 3 * len(turns)
    found = list(chat_format.locate_turns(chat_format.MARKED, iter(turns)))
    assert "".join(f.added for f in found) == (output if turns else "")
    assert [chat_format.unescape(f.added[f.start:f.end]) for f in found] == [text for _, text in turns]
    whole = chat_format.Template(chat_format.render_marked, chat_format.unescape)
    assert list(chat_format.locate_turns(whole, iter(turns))) == found


def test_digests_against_plain_python(conversations):
    rows = {row["conv_id"]: row for row in chat_format.formatted_conversations(conversations).collect()}
    expected = turns_of(ROWS)
    expected[-7] = [((True, 0), "user", chat_format.PROBE_TEXT), ((True, 1), "assistant", chat_format.PROBE_TEXT)]
    assert set(rows) == set(expected)
    for conv_id, turns in expected.items():
        turns = [(role, text) for _, role, text in sorted(turns)]
        loss = "".join(text for role, text in turns if role == "assistant")
        row = rows[conv_id]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row["formatted_chars"] == len(chat_format.render_marked(turns))


def test_spans_lie_in_the_joined_output(conversations):
    rows = chat_format.format_turns(conversations.where("conv_id = 1")).orderBy("position").collect()
    output = "".join(row["added"] for row in rows)
    assert output.startswith("<s>[INST]system[/INST]</s>[INST]user[/INST]how?\n\n</s>")
    assert [chat_format.unescape(output[row["text_start"]:row["text_end"]]) for row in rows] == ["", "how?\n\n", ROWS[0][3]]
    assert [row["loss"] for row in rows] == [False, False, True] and not any(row["rewritten"] for row in rows)


def test_a_template_that_rewrites_history_is_found(spark):
    def forgets(turns):  # only the last assistant turn keeps its thoughts
        last = max((k for k, (role, _) in enumerate(turns) if role == "assistant"), default=-1)
        return "".join(f"{role}: {text if k == last or role != 'assistant' else text.split('#')[-1]}\n"
                       for k, (role, text) in enumerate(turns))

    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "think#a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (2, 0, "user", "s")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat_format.format_turns(frame, chat_format.Template(forgets)).orderBy("conv_id", "position").collect()
    assert [(row["sample"], row["rewritten"]) for row in found] == [(0, False), (0, False), (0, False), (1, True), (0, False)]
    samples = ["".join(row["added"] for row in found if row["conv_id"] == 1 and row["sample"] == n) for n in (0, 1)]
    assert samples == ["user: q\nassistant: think#a\nuser: r\n", "user: q\nassistant: a\nuser: r\nassistant: b\n"]
    assert samples[1][found[3]["text_start"]:found[3]["text_end"]] == "b"
    doubled = chat_format.Template(lambda turns: "".join(text + text for _, text in turns))
    with pytest.raises(ValueError, match="elsewhere"):
        list(chat_format.locate_turns(doubled, iter([("user", "a")])))
    silent = chat_format.Template(lambda turns: "".join(text for role, text in turns if role != "system"))
    assert [f.added for f in chat_format.locate_turns(silent, iter([("system", "a"), ("user", "b")]))] == ["", "b"]


# ---- prefix trie

def trie_by_hand(rows):
    own = {conv_id: [(role, text) for _, _, role, text in sorted(
               ((turn, prefix_id(role, text), role, text) for turn, role, text in turns))]
           for conv_id, turns in turns_of(rows).items() if conv_id is not None}
    members = defaultdict(list)
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = (own.get(c - c % 100, [])[:h] + turns[h:])
        for depth in range(len(full[c]) + 1):
            members[tuple(full[c][:depth])].append(c)
    below = {path: [p for p in members if p[:len(path)] == path] for path in members}
    children = {path: sum(len(p) == len(path) + 1 for p in below[path]) for path in members}
    return {(min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), children[path],
             sum(children[p] == 0 for p in below[path]), sum((len(members[p]) - 1) * len(p[-1][1]) for p in below[path] if p),
             hashlib.sha256(",".join(str(c) for c in sorted(ids) if len(full[c]) == len(path)).encode()).hexdigest())
            for path, ids in members.items()}


def prefix_id(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


@pytest.mark.parametrize(("slice_bytes", "last_entries"), [(1 << 22, 200_000), (1, 200_000), (400, 10)])
def test_trie_against_brute_force(conversations, slice_bytes, last_entries):
    got = prefix_trie.prefix_trie(conversations, slice_bytes, last_entries).collect()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert len(got) == len(set(got)) and {tuple(row[name] for name in names) for row in got} == trie_by_hand(ROWS)


def test_long_conversation_and_chunks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    rows = [(0, n, "user", f"t{n % 3}") for n in range(300)] + [(n, 0, "user", "t0") for n in range(1, 60)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {tuple(row) for row in prefix_trie.prefix_trie(frame, 64).collect()}
    assert got == trie_by_hand(rows)


def test_layouts_grow():
    tree = prefix_trie.RadixTree()
    kinds = []
    for label in range(256):
        tree.insert(bytes([label]) * 16, label)
        kinds.append((type(tree.root.below).__name__, getattr(tree.root.below, "room", None)))
    assert [kinds[k] for k in (3, 4, 15, 16, 47, 48, 255)] == [
        ("Small", 4), ("Small", 16), ("Small", 16), ("Indexed", None), ("Indexed", None), ("Direct", None), ("Direct", None)]
    assert [child.held for _, child in tree.root.children()] == list(range(256))
    tree.insert(bytes([9]) * 32, "longer")
    tree.insert(b"", "nothing")
    node = tree.root.below.find(9)
    assert (node.held, node.end, tree.root.held) == (9, 16, "nothing")
    assert [(child.start, child.end, child.held) for _, child in node.children()] == [(16, 32, "longer")]


# ---- whitening

def whitened_by_library(vectors):
    whole = np.floor(1024 * vectors).astype(np.int64) + 100_000
    n, sums = len(whole), whole.sum(axis=0)
    centred = whole - sums / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * whole - sums) ** 2).sum(axis=1), centred, values[::-1], parts[:, ::-1]


def test_whitening_against_library(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    frame = table.toPandas()
    n, deviation, centred, values, parts = whitened_by_library(np.stack(frame["embedding"]).astype(np.float64))
    got = queries.op12_whitened_components(spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == 8 * n and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    for component, rows in got.groupby("component"):
        rows = rows.set_index("vec_id").loc[frame["vec_id"]]
        expected = centred @ parts[:, component - 1] / np.sqrt(values[component - 1])
        sign = np.sign(expected @ rows["whitened"])
        np.testing.assert_allclose(rows["whitened"], sign * expected, atol=1e-8)
        np.testing.assert_allclose(rows["explained"], values[component - 1] / values.sum(), rtol=1e-10)
        assert rows["deviation"].tolist() == deviation.tolist()


@pytest.mark.parametrize("values", [
    np.linspace(1, 64, 64), np.ones(20), np.r_[[9.0] * 5, [9 - 1e-12] * 3, np.ones(24)], np.r_[4.0, 4.0, np.zeros(10)], [3.0], [2.0, 1.0]])
def test_components_of_known_spectra(values):
    values = np.asarray(values, dtype=np.float64)
    q = np.linalg.qr(np.random.default_rng(5).normal(size=(len(values),) * 2))[0]
    matrix = (q * values) @ q.T
    found, components = whitening.leading_components((matrix + matrix.T) / 2)
    expected = np.sort(values)[::-1][:8]
    expected = expected[expected > 1e-9]
    np.testing.assert_allclose(found, expected, rtol=1e-12)
    np.testing.assert_allclose(components @ components.T, np.eye(len(found)), atol=1e-13)
    np.testing.assert_allclose(matrix @ components.T, components.T * found, atol=1e-12 * values.max())


def test_odd_vectors(spark):
    rows = [(1, [0.5, 1.0]), (None, [0.25, -1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]),
            (6, []), (7, [1.0, 2.0, 3.0]), (8, [0.5, 1.0]), (8, [0.5, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x"))
    got = whitening.whitened_components(frame).collect()
    assert sorted(str(row["vec_id"]) for row in got) == ["1", "8", "8", "None"] and {row["n"] for row in got} == {4}
    assert sum(row["whitened"] for row in got) == pytest.approx(0, abs=1e-12)
    same = frame.where("vec_id in (1, 8)")
    assert whitening.whitened_components(same).count() == 0 == whitening.whitened_components(frame.where("false")).count()
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert {(row["component"], row["deviation"]) for row in whitening.whitened_components(huge).collect()} == {(1, None)}


def test_empty_tables(conversations):
    none = conversations.where("false")
    assert {row["conv_id"] for row in chat_format.formatted_conversations(none).collect()} == {-7}
    assert chat_format.format_turns(none).count() == 0 == prefix_trie.prefix_trie(none).count()
