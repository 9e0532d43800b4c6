"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded from what can be seen in its bytes;
gated attention (tanh and sigmoid branches, softmax over the document's passages) weighs the encodings, and
the weighted sum is scored. Only documents carry labels, the weights of passages are learned.

The model is fitted on the driver from a bounded sample of labelled documents (``TRAIN_DOCS``, the ones
with the least hash of their id). Scoring reads every whole text where it lies; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runcast.llm.common import unit_interval
from runcast.session import in_small_batches, materialize

PASSAGE_WORDS = 64
TRAIN_DOCS = 6000
TRAIN_PASSAGES, DOC_PASSAGES = 100_000, 256  # in all, and of one document (evenly spaced where it has more)
HIDDEN, GATE = 24, 12
EPOCHS, BATCH_DOCS, RATE, DECAY = 40, 64, 0.01, 1e-4
BLOCK_BYTES = 1 << 18  # of text; the arrays made of it take some 70 times as much
HELD_OUT = (3, 1)  # a row whose id's checksum has this remainder is never learned from


def _byte_classes() -> tuple[np.ndarray, int]:
    """Class of a byte: each letter (both cases), printable sign and digit run alone; high bytes by lead or tail."""
    classes = np.zeros(256, dtype=np.int64)
    for byte in range(256):
        if chr(byte).isascii() and chr(byte).isalpha():
            classes[byte] = 1 + (byte | 32) - 97
        elif 48 <= byte <= 57:
            classes[byte] = 27
        elif 33 <= byte <= 126:
            classes[byte] = 28 + byte % 32
        elif byte >= 128:
            classes[byte] = 60 + (byte >= 192)
    return classes, 62


_CLASSES, N_CLASSES = _byte_classes()
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_IS_UPPER = np.zeros(256, dtype=bool)
_IS_UPPER[65:91] = True
_IS_SIGN = np.array([33 <= b <= 126 and not chr(b).isalnum() for b in range(256)])
_POWERS = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)
# class shares, then: signs, capitals, words that begin with a capital, mean length, repeated words,
# words with a sign at the end, words used in this passage and before, logarithm of the words
N_FEATURES = N_CLASSES + 8


def passage_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features, document number) of every passage; a text without words is one passage of zeros."""
    raw = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    doc_starts = np.cumsum([0, *[len(part) + 1 for part in raw]])
    space = _IS_SPACE[data]
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    stops = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    first_word = np.searchsorted(starts, doc_starts)  # of each document
    n_words = np.diff(first_word)
    n_passages = np.maximum(-(-n_words // PASSAGE_WORDS), 1)
    first_passage = np.cumsum(n_passages) - n_passages
    total = int(n_passages.sum())
    doc_of_passage = np.repeat(np.arange(len(texts)), n_passages)
    out = np.zeros((total, N_FEATURES), dtype=np.float32)
    if not len(starts):
        return out, doc_of_passage
    doc_of_word = np.repeat(np.arange(len(texts)), n_words)
    passage = first_passage[doc_of_word] + (np.arange(len(starts)) - first_word[doc_of_word]) // PASSAGE_WORDS
    lengths = stops - starts
    letters = np.flatnonzero(~space)
    word_of_letter = np.repeat(np.arange(len(starts)), lengths)
    place = letters - starts[word_of_letter]
    letter_passage = passage[word_of_letter]
    seen = data[letters]
    chars = np.maximum(np.bincount(letter_passage, minlength=total), 1)[:, None]
    shares = np.bincount(letter_passage * N_CLASSES + _CLASSES[seen], minlength=total * N_CLASSES)
    out[:, :N_CLASSES] = shares.reshape(total, N_CLASSES) / chars
    words = np.maximum(np.bincount(passage, minlength=total), 1)
    per_word = lambda values: np.bincount(passage, weights=values, minlength=total) / words
    per_char = lambda values: np.bincount(letter_passage, weights=values, minlength=total) / chars[:, 0]
    hashes = np.add.reduceat((seen.astype(np.uint64) + np.uint64(1)) * _POWERS[place % 64], np.cumsum(lengths) - lengths)
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    repeated = lambda group: _repeats((hashes & np.uint64(0xFFFFFFFFFF)) | (group.astype(np.uint64) << np.uint64(40)))
    out[:, N_CLASSES] = per_char(_IS_SIGN[seen])
    out[:, N_CLASSES + 1] = per_char(_IS_UPPER[seen])
    out[:, N_CLASSES + 2] = per_word(_IS_UPPER[data[starts]])
    out[:, N_CLASSES + 3] = per_word(lengths) / 10
    out[:, N_CLASSES + 4] = per_word(repeated(passage))
    out[:, N_CLASSES + 5] = per_word(_IS_SIGN[data[stops - 1]])
    out[:, N_CLASSES + 6] = per_word(repeated(doc_of_word))
    out[:, N_CLASSES + 7] = np.log1p(words) / 5
    return out, doc_of_passage


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which words occurred before within their group."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


@dataclass
class AttentionModel:
    """Standardised features to an encoding, gated attention over it and a logistic score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, features: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        state = _forward(self.weights, (features - self.mean) / self.scale, doc, n_docs)
        return 1.0 / (1.0 + np.exp(-state["logit"]))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, doc: np.ndarray, n_docs: int) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["encode"] + w["encode_bias"])
    t, g = np.tanh(h @ w["tanh"]), 1.0 / (1.0 + np.exp(-(h @ w["gate"])))
    raw = (t * g) @ w["attend"]
    top = np.full(n_docs, -np.inf)
    np.maximum.at(top, doc, raw)
    e = np.exp(raw - top[doc])
    a = e / np.bincount(doc, weights=e, minlength=n_docs)[doc]
    z = np.stack([np.bincount(doc, weights=a * column, minlength=n_docs) for column in h.T], axis=1)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ w["score"] + w["score_bias"][0]}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, doc: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    s = _forward(w, x, doc, len(label))
    d_logit = (1.0 / (1.0 + np.exp(-s["logit"])) - label) / len(label)
    d_z = np.outer(d_logit, w["score"])
    by_passage = d_z[doc]
    d_a = (by_passage * s["h"]).sum(axis=1)
    d_raw = s["a"] * (d_a - np.bincount(doc, weights=s["a"] * d_a, minlength=len(label))[doc])
    d_t = d_raw[:, None] * w["attend"] * s["g"] * (1 - s["t"] ** 2)
    d_g = d_raw[:, None] * w["attend"] * s["t"] * s["g"] * (1 - s["g"])
    d_h = (s["a"][:, None] * by_passage + d_t @ w["tanh"].T + d_g @ w["gate"].T) * (1 - s["h"] ** 2)
    return {"encode": x.T @ d_h, "encode_bias": d_h.sum(axis=0), "tanh": s["h"].T @ d_t, "gate": s["h"].T @ d_g,
            "attend": (s["t"] * s["g"]).T @ d_raw, "score": s["z"].T @ d_logit, "score_bias": np.array([d_logit.sum()])}


def fit(features: np.ndarray, doc: np.ndarray, labels: np.ndarray, seed: int = 11) -> AttentionModel:
    """Adam over batches of documents; the same bags give the same model. Without bags every score is 0.5."""
    rng = np.random.default_rng(seed)
    n_features = features.shape[1]
    start = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"encode": start(n_features, HIDDEN), "encode_bias": np.zeros(HIDDEN), "tanh": start(HIDDEN, GATE),
         "gate": start(HIDDEN, GATE), "attend": start(GATE), "score": np.zeros(HIDDEN), "score_bias": np.zeros(1)}
    if not len(labels):
        return AttentionModel(np.zeros(n_features), np.ones(n_features), w)
    mean, scale = features.mean(axis=0), features.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    x = np.clip((features - mean) / scale, -8, 8).astype(np.float32)
    order = np.argsort(doc, kind="stable")
    x, doc = x[order], doc[order]
    bag_from = np.searchsorted(doc, np.arange(len(labels) + 1))
    moments = {name: [np.zeros_like(value), np.zeros_like(value)] for name, value in w.items()}
    step = 0
    for epoch in range(EPOCHS):
        shuffled = rng.permutation(len(labels))
        rate = RATE * (1 - epoch / EPOCHS)
        for first in range(0, len(labels), BATCH_DOCS):
            chosen = shuffled[first:first + BATCH_DOCS]
            sizes = bag_from[chosen + 1] - bag_from[chosen]
            rows = np.concatenate([np.arange(bag_from[c], bag_from[c + 1]) for c in chosen])
            slope = _gradients(w, x[rows], np.repeat(np.arange(len(chosen)), sizes), labels[chosen])
            step += 1
            for name, value in w.items():
                g = slope[name] + DECAY * value * (not name.endswith("bias"))
                first_m, second_m = moments[name]
                first_m += 0.1 * (g - first_m)
                second_m += 0.001 * (g * g - second_m)
                value -= rate * (first_m / (1 - 0.9**step)) / (np.sqrt(second_m / (1 - 0.999**step)) + 1e-8)
    return AttentionModel(mean, scale, w)


def held_out(doc_id: Column) -> Column:
    """Whether the id's checksum keeps the row out of learning; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT[0] == HELD_OUT[1]


def _bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for rows in blocks(frame, "text"):
            features, doc = passage_features(rows["text"].tolist())
            first = np.searchsorted(doc, np.arange(len(rows) + 1))
            bags = []
            for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                step = -(-(end - begin) // DOC_PASSAGES)
                bags.append(features[begin:end:max(step, 1)])
            yield pd.DataFrame({"doc_id": rows["doc_id"], "label": rows["label"], "size": [len(bag) for bag in bags],
                                "bag": [bag.tobytes() for bag in bags]})


def blocks(frame: pd.DataFrame, text_col: str) -> Iterator[pd.DataFrame]:
    """Runs of rows with about BLOCK_BYTES of text, which bounds the arrays made at a time."""
    size = frame[text_col].str.len().fillna(0).to_numpy(dtype=np.float64).cumsum() // BLOCK_BYTES
    for _, rows in frame.groupby(size, sort=True):
        yield rows


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_docs: int = TRAIN_DOCS) -> AttentionModel:
    """Fit on at most ``max_docs`` labelled documents that are not held out, and TRAIN_PASSAGES passages of them.

    Rows without an id, text or label are not learned from; an id with several labels counts for the least,
    one with several rows for the shortest. No document gives more than DOC_PASSAGES passages, so what comes
    to the driver is bounded before it leaves the tasks, however long or often repeated a text is.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min(label_col).cast("double").alias("label")))
    sample = known.orderBy(unit_interval(F.col("doc_id"), "train"), "doc_id").limit(max_docs)
    rows = (docs.select("doc_id", "text").where("text is not null")
            .join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("string"), "label", "text"))
    bags = in_small_batches(rows).mapInPandas(_bags, "doc_id string, label double, size long, bag binary")
    bags = materialize(bags.groupBy("doc_id").agg(F.min(F.struct("size", "bag", "label")).alias("own")).select(
        "doc_id", F.crc32(F.col("doc_id").cast("binary")).alias("order"), "own.*"), "bags")
    in_order = Window.orderBy("order", "doc_id")  # a row per sampled document, without its passages
    sized = bags.select("doc_id", F.sum("size").over(in_order).alias("so_far"))
    chosen = sized.where(F.col("so_far") <= TRAIN_PASSAGES).select("doc_id")
    bags = bags.join(F.broadcast(chosen), "doc_id").toArrow().to_pandas().sort_values(["order", "doc_id"], kind="stable")
    if not len(bags):
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0, dtype=np.int64), np.zeros(0))
    features = np.frombuffer(b"".join(bags["bag"]), dtype=np.float32).reshape(-1, N_FEATURES)
    return fit(features, np.repeat(np.arange(len(bags)), bags["size"]), bags["label"].to_numpy())


def score_texts(model: AttentionModel, texts: list[str | None]) -> np.ndarray:
    features, doc = passage_features(texts)
    return model.scores(features, doc, len(texts))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null texts are scored as empty ones."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows in blocks(frame, "text"):
                yield pd.DataFrame({"doc_id": rows["doc_id"], "held_out": rows["held_out"],
                                    "score": score_texts(model.value, rows["text"].tolist())})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    scored = in_small_batches(rows).mapInPandas(score, "doc_id string, held_out boolean, score double")
    return scored.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "held_out", "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, unchanged; the model is fitted on these rows."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pd.DataFrame({"text": batch.column("text").to_pandas()})
            scores = [score_texts(model.value, rows["text"].tolist()) for rows in blocks(texts, "text")]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *scores]) >= threshold))

    return in_small_batches(docs).mapInArrow(good, docs.schema)
