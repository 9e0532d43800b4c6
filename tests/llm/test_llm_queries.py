"""The queries of the training-data operators against their SQL, and against brute force where SQL can't say it."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import __spark_entry__ as contract
import check
from runcast.llm import context_tree, queries

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables():
    return check.connect(SF_DIR)


@pytest.fixture(scope="module")
def texts(tables):
    return dict(tables.sql("SELECT doc_id, text FROM documents").fetchall())


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_sql(spark, tables, name):
    rows = queries.QUERIES[name](spark, SF_DIR).toPandas()
    assert len(rows) and check.compare(rows, tables.sql(queries.ORACLE_SQL[name]).df()) == ""


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(queries.ORACLE_SQL) <= set(contract.oracle_sql())


def test_simhash_groups(spark, texts):
    rows = queries.QUERIES["op1_simhash_groups"](spark, SF_DIR).toPandas().set_index("doc_id")
    expected = {}
    for doc_id, text in texts.items():
        tokens = words(text)
        shingles = [" ".join(tokens[i:i + 3]) for i in range(max(len(tokens) - 2, 1))] if tokens else []
        hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
        expected[doc_id] = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
    assert rows["fingerprint"].to_dict() == {doc: format(value, "016x") for doc, value in expected.items()}
    group = {doc: doc for doc in expected}
    changed = True
    while changed:
        changed = False
        for a in expected:
            for b in expected:
                if (expected[a] ^ expected[b]).bit_count() <= 3 and group[b] > group[a]:
                    group[b], changed = group[a], True
    assert rows["component_id"].to_dict() == group


def test_context_tree_base_and_score(spark, texts):
    rows = queries.QUERIES["op2_context_tree"](spark, SF_DIR).toPandas()
    tokens = {doc: [*words(text), "\0"] for doc, text in texts.items()}
    held = {doc: zlib.crc32(str(doc).encode()) % 7 == 2 for doc in texts}
    counts = Counter(token for doc in texts if not held[doc] for token in tokens[doc])
    total, kinds = sum(counts.values()), len(counts)
    learned = context_tree.encode([text for doc, text in texts.items() if not held[doc]])[0]
    runs, n = np.unique(learned, return_counts=True)
    by_depth = []
    for depth in range(context_tree.DEPTH + 1):
        short, inverse = np.unique(runs & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        by_depth.append((short, np.bincount(inverse, weights=n)))
    trees = context_tree.build_trees(by_depth)
    for row in rows.itertuples():
        own = tokens[row.doc_id]
        base = sum(math.log10((counts[token] + 1) / (total + kinds + 1)) for token in own)
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert (row.held_out, row.n_tokens, row.train_tokens) == (held[row.doc_id], len(own), total)
        assert row.n_known == sum(token in counts for token in own)
        assert row.score == pytest.approx(context_tree.text_logs(trees, [texts[row.doc_id]])[0], rel=1e-6)


def test_weighting_against_recursion():
    """One text's probability by the definition: every node mixes its own estimate with its children's product."""
    texts, depth = ["abab abc\u00e9", "", "bbab", "abab abd"], context_tree.DEPTH
    events = {}  # (bit-tree node, context newest first) -> zeros, ones at full depth
    for text in texts:
        raw = b"\xff" * depth + text.encode() + b"\xff"
        for at in range(depth, len(raw)):
            for bit in range(8):
                node = (1 << bit) | (raw[at] >> (8 - bit))
                events.setdefault((node, raw[at - depth:at][::-1]), [0, 0])[raw[at] >> (7 - bit) & 1] += 1

    def kt(zeros, ones):
        return (math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi))

    def below(node, context):
        return {c: n for (own, c), n in events.items() if own == node and c[:len(context)] == context}

    def weighted(node, context):
        found = below(node, context)
        own = kt(*map(sum, zip(*found.values())))
        if len(context) == depth:
            return own
        split = sum(weighted(node, context + bytes([b])) for b in {c[len(context)] for c in found})
        return math.log(0.5) + max(own, split) + math.log1p(math.exp(-abs(own - split)))

    def chance(node, context, at=0):
        """Probability of a one after ``context``: each node's share of belief in itself, the rest from its child."""
        zeros, ones = map(sum, zip(*below(node, context[:at]).values()))
        own = (ones + 0.5) / (zeros + ones + 1)
        if at == depth:
            return own
        share = math.exp(math.log(0.5) + kt(zeros, ones) - weighted(node, context[:at]))
        rest = chance(node, context, at + 1) if below(node, context[:at + 1]) else 0.5
        return share * own + (1 - share) * rest

    runs, n = np.unique(context_tree.encode(texts)[0], return_counts=True)
    by_depth = []
    for d in range(depth + 1):
        short, inverse = np.unique(runs & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        by_depth.append((short, np.bincount(inverse, weights=n)))
    trees = context_tree.build_trees(by_depth)
    for text in [*texts, "abd", "zzz", "bbb ab"]:
        raw, expected = b"\xff" * depth + text.encode() + b"\xff", 0.0
        for at in range(depth, len(raw)):
            for bit in range(8):
                node, context = (1 << bit) | (raw[at] >> (8 - bit)), raw[at - depth:at][::-1]
                one = chance(node, context) if below(node, b"") else 0.5
                expected += math.log10(one if raw[at] >> (7 - bit) & 1 else 1 - one)
        assert context_tree.text_logs(trees, [text])[0] == pytest.approx(expected, rel=1e-5)


def test_attention_quality_on_held_out(spark, tables):
    rows = queries.QUERIES["op3_attention_quality"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    labels = check.connect("/root/testdata/sf0.01").sql("SELECT doc_id, quality FROM labels").df().set_index("doc_id")
    both = rows.join(labels, how="inner")
    unseen = both[both["held_out"]]
    assert len(rows) == 1000 and rows["score"].between(0, 1).all()
    assert (unseen["predicted"] == unseen["quality"]).mean() > 0.95


def test_page_texts(spark, tables):
    rows = queries.QUERIES["op9_page_difference"](spark, SF_DIR).toPandas().set_index("page_id")
    assert len(rows) == 50
    for page_id, markup in tables.sql("SELECT page_id, html FROM pages").fetchall():
        article = re.search(r"<article>(.*?)(</article>|$)", markup, re.S).group(1)
        plain = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", article))
        assert rows.loc[page_id, "text"] == " ".join(
            plain.replace("&quot;", '"').replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&").split())
        assert rows.loc[page_id, "n_chars"] == len(rows.loc[page_id, "text"])


def test_quality_rules_counts(spark, texts):
    rows = queries.QUERIES["op10_quality_rules"](spark, SF_DIR).toPandas().set_index("doc_id")
    for doc_id, text in texts.items():
        own = WORD.findall(text or "")
        windows = Counter(tuple(own[i:i + 8]) for i in range(len(own) - 7))
        covered = {j for i in range(len(own) - 7) if windows[tuple(own[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [line for line in (text or "").split("\n") if WORD.search(line)]
        row = rows.loc[doc_id]
        assert (row["n_words"], row["word_chars"], row["n_repeat_words"]) == (len(own), sum(map(len, own)), len(covered))
        assert row["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["base_failed"] == (len(own) < 20 or 100 * len(covered) > 30 * len(own))
        assert not (row["kept"] and row["base_failed"])


def test_context_trees_keep_rare_runs(spark):
    """Runs of one count beside one of a thousand million, and runs of texts held out; weighted in tasks as in one place."""
    texts = ["abab abc\u00e9", "", "bbab", "abab abd"] + [f"{i * 7919 % 1000} abc {i}" for i in range(60)]
    codes, n = np.unique(context_tree.encode(texts)[0], return_counts=True)
    n = n.astype(np.int64)
    n[5] = 1 << 30
    unseen = np.setdiff1d(context_tree.encode(["zab abd", "abc 77\u00e9"])[0], codes)
    table = [(int(run), int(times)) for run, times in [*zip(codes, n, strict=True), *((run, 0) for run in unseen)]]
    by_depth = []
    for depth in range(context_tree.DEPTH + 1):
        short, place = np.unique(codes & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        by_depth.append((short, np.bincount(place, weights=n)))
    trees = context_tree.build_trees(by_depth)
    got = {row["run"]: row["log"] for row in context_tree.train(spark.createDataFrame(table, "run long, n long")).collect()}
    assert got.keys() == {run for run, _ in table}
    asked = np.array(sorted(got))
    assert np.allclose([got[run] for run in asked.tolist()], trees.byte_logs(asked), rtol=1e-5, atol=1e-7)


@pytest.mark.parametrize("common", [0, 3, 400])
def test_runs_of_bytes_looked_up_or_joined_score_alike(spark, common):
    docs = spark.createDataFrame([(i, f"text {i % 9} of {i * 31 % 17}") for i in range(40)] + [(40, None), (41, "")], "doc_id long, text string")
    whole, joined = ({row["doc_id"]: row["score"] for row in context_tree.scored_documents(docs, **own).collect()}
                     for own in ({}, {"common_runs": common}))
    assert whole.keys() == joined.keys() and all(joined[doc] == pytest.approx(score, rel=1e-9) for doc, score in whole.items())
