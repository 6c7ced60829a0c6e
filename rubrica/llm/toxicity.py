"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A step of the network is a word; its input is the sum of an embedding of the word and of the
embeddings of its character 3- to 5-grams (both hashed), so unseen forms of known stems are
caught.  Windows of ``WINDOW`` words overlap by half and cover the whole text; attention pools
the states of a window into one logit.  A text's score is the calibrated logit of its most
toxic window.

Training (numpy, backpropagation through time) uses at most ``SAMPLE`` labelled rows that are
not held out and have at most ``SAMPLE_CHARS`` characters, at most a third of them toxic, and
all windows of each.  Only the text's label is known, so windows are pooled by log-sum-exp for the loss.

Defined cases: null or empty text, or one without words, gets the score of an empty window;
without labelled rows every score is 0; an empty table gives an empty result; repeated rows
get equal scores; labels that are null or belong to no document are left out, of repeated
labels the larger counts; extra columns are left out; a null id counts as not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm import gru
from rubrica.llm.shared import fit_in_task, held_out, slices
from rubrica.llm.wordhash import MIX, word_hashes

SAMPLE = 3_000
#: Longer texts are no training rows; the others are learned from as a whole.
SAMPLE_CHARS = 8_000
WINDOW = 32
STRIDE = 16
WIDTH = 16
HIDDEN = 8
WORD_ROWS = 1 << 13
GRAM_ROWS = 1 << 14
UPDATES = 240
THRESHOLD = 0.3
#: Windows and distinct words that are worked on together; bounds memory only.
TOGETHER = 2_048
WORDS_TOGETHER = 10_000


@dataclass
class Words:
    """Words of texts: a number for each occurrence, and the bytes of each distinct one."""

    code: np.ndarray  # distinct word of each occurrence
    bounds: np.ndarray  # occurrences of each text
    hashes: np.ndarray  # of distinct words
    data: np.ndarray
    start: np.ndarray  # of distinct words in data
    end: np.ndarray


def split_words(texts: list) -> Words:
    """Lower-cased runs of ASCII letters, digits and bytes beyond ASCII."""
    coded = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(coded) + b" ", np.uint8).copy()
    inside = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    data[~inside] = 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    text_end = np.cumsum([len(c) + 1 for c in coded])
    bounds = np.r_[0, np.searchsorted(start, text_end + 1)] if texts else np.zeros(1, np.int64)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(none, bounds, none.astype(np.uint64), data, none, none)
    hashes = word_hashes(data, start, end)
    distinct, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    return Words(code, bounds, distinct, data, start[first], end[first])


def grams(words: Words, pick: slice) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character-gram table for distinct words, and where each word's begin.

    A word stands between blanks; it has at least one gram.
    """
    start, end = words.start[pick] - 1, words.end[pick] + 1
    found, owner = [], []
    length = end - start
    for n in (3, 4, 5):
        count = np.maximum(length - n + 1, 0)
        at = np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        packed = np.full(len(at), n, np.uint64)
        for k in range(n):
            packed = (packed << np.uint64(8)) | words.data[at + k]
        with np.errstate(over="ignore"):
            packed *= MIX
        found.append((packed >> np.uint64(64 - 14)).astype(np.int64))
        owner.append(np.repeat(np.arange(len(start)), count))
    rows, who = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    return rows[order], who[order]


def window_codes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Codes (steps, windows) of all windows of all texts, -1 for padding, and each one's text."""
    n = np.diff(words.bounds)
    count = np.maximum(1, -(-(n - STRIDE) // STRIDE))
    owner = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = words.bounds[owner] + number * STRIDE + np.arange(WINDOW)[:, None]
    inside = at < words.bounds[owner + 1]
    if not len(words.code):
        return np.full(at.shape, -1), owner
    return np.where(inside, words.code[np.minimum(at, len(words.code) - 1)], -1), owner


@dataclass
class ToxicityModel:
    """Weights and calibration; their size does not depend on the corpus."""

    weights: dict[str, np.ndarray] | None
    slope: float = 1.0
    shift: float = 0.0

    def inputs(self, words: Words) -> np.ndarray:
        """Input vectors (distinct words + one row of zeros for padding, WIDTH)."""
        w = self.weights
        out = np.zeros((len(words.hashes) + 1, WIDTH), np.float32)
        out[:-1] = w["word"][(words.hashes % np.uint64(WORD_ROWS)).astype(np.int64)]
        for a in range(0, len(words.hashes), WORDS_TOGETHER):
            rows, owner = grams(words, slice(a, a + WORDS_TOGETHER))
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[a + owner[starts]] += np.add.reduceat(w["gram"][rows], starts)
        return out

    def logits(self, texts: list) -> np.ndarray:
        """The largest window logit of each text."""
        words = split_words(texts)
        w = self.weights
        x = self.inputs(words)
        tables = [np.ascontiguousarray(w[f"{d}.W"] @ x.T + w[f"{d}.b"]) for d in "fb"]
        codes, owner = window_codes(words)
        out = np.full(len(texts), -np.inf)
        for a in range(0, codes.shape[1], TOGETHER):
            np.maximum.at(out, owner[a : a + TOGETHER], attend(w, tables, codes[:, a : a + TOGETHER]))
        return out

    def scores(self, texts: list) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return gru.sigmoid(self.slope * self.logits(texts) + self.shift)


def attend(w: dict, tables: list, codes: np.ndarray, keep: bool = False):
    """Logit of each window; with ``keep`` also what the backward pass needs."""
    mask = codes >= 0
    ahead = gru.forward(gru.Lookup(tables[0], codes), w["f.U"], mask, keep)
    back = gru.forward(gru.Lookup(tables[1], codes, True), w["b.U"], mask[::-1], keep)
    f, b = (ahead[0], back[0]) if keep else (ahead, back)
    hidden, steps = w["f.U"].shape[1], len(codes)
    total = np.zeros(codes.shape[1], np.float32)
    pooled = np.zeros((2 * hidden, codes.shape[1]), np.float32)
    raw = []
    for t in range(steps):
        states = np.concatenate([f[t], b[steps - 1 - t]])
        e = np.where(mask[t], np.exp(np.clip((w["attend"] @ states)[0], -30, 30)), 0)
        total += e
        pooled += e * states
        if keep:
            raw.append((states, e))
    pooled /= np.maximum(total, 1e-9)
    logit = (w["out"] @ pooled)[0] + w["out.b"][0, 0]
    return (logit, pooled, total, raw, ahead[1], back[1], mask) if keep else logit


def _gradients(w: dict, words: Words, x_rows: tuple, codes: np.ndarray, owner: np.ndarray, truth: np.ndarray, drop: np.ndarray):
    """Loss gradients for a few texts; ``drop`` marks distinct words whose own embedding is left out."""
    word_row, gram_row, gram_owner = x_rows
    n = len(words.hashes)
    x = np.zeros((n + 1, WIDTH), np.float32)
    x[:-1] = w["word"][word_row] * ~drop[:, None]
    x += gru.sum_rows(w["gram"][gram_row], gram_owner, n + 1)
    tables = [w[f"{d}.W"] @ x.T + w[f"{d}.b"] for d in "fb"]
    logit, pooled, total, raw, kept_f, kept_b, mask = attend(w, tables, codes, keep=True)
    top = np.full(len(truth), -np.inf)
    np.maximum.at(top, owner, logit)
    share = np.exp(logit - top[owner])
    whole = np.bincount(owner, share, len(truth))
    p = gru.sigmoid(top + np.log(whole))
    d_logit = ((p - truth)[owner] * share / whole[owner] / len(truth)).astype(np.float32)
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    grads["out"] += d_logit[None] @ pooled.T
    grads["out.b"] += d_logit.sum()
    d_pooled = w["out"].T * d_logit
    hidden, steps = w["f.U"].shape[1], len(codes)
    d_f, d_b = [None] * steps, [None] * steps
    for t, (states, e) in enumerate(raw):
        a = e / np.maximum(total, 1e-9)
        d_e = (d_pooled * (states - pooled)).sum(axis=0) * a
        grads["attend"] += d_e[None] @ states.T
        d = (d_pooled * a + w["attend"].T * d_e).astype(np.float32)
        d_f[t], d_b[steps - 1 - t] = d[:hidden], d[hidden:]
    d_x = np.zeros_like(x)
    for way, d, kept, own, m in (("f", d_f, kept_f, codes, mask), ("b", d_b, kept_b, codes[::-1], mask[::-1])):
        grads[f"{way}.U"], projected = gru.backward(d, kept, w[f"{way}.U"], m)
        flat, at = np.concatenate(projected, axis=1), own.reshape(-1)
        summed = gru.sum_rows(flat.T, np.where(at < 0, n, at), n + 1)
        summed[-1] = 0
        grads[f"{way}.W"] += summed.T @ x
        grads[f"{way}.b"] += summed.sum(axis=0)[:, None]
        d_x += summed @ w[f"{way}.W"]
    grads["word"] = gru.sum_rows(d_x[:-1] * ~drop[:, None], word_row, WORD_ROWS)
    grads["gram"] = gru.sum_rows(d_x[gram_owner], gram_row, GRAM_ROWS)
    return grads


def train(texts: list[str], labels: list[int], seed: int = 5, updates: int = UPDATES) -> ToxicityModel:
    """Fit network and calibration; a quarter of the rows is kept for the calibration."""
    if not texts:
        return ToxicityModel(None)
    rng = np.random.default_rng(seed)
    w = {"word": rng.normal(0, 0.1, (WORD_ROWS, WIDTH)).astype(np.float32)}
    w["gram"] = rng.normal(0, 0.1, (GRAM_ROWS, WIDTH)).astype(np.float32)
    for d in "fb":
        w |= {f"{d}.{k}": v for k, v in gru.new_direction(WIDTH, HIDDEN, rng).items()}
    w["attend"] = rng.normal(0, 0.5, (1, 2 * HIDDEN)).astype(np.float32)
    w["out"] = rng.normal(0, 0.5, (1, 2 * HIDDEN)).astype(np.float32)
    w["out.b"] = np.full((1, 1), -3, np.float32)
    model = ToxicityModel(w)
    truth = np.array(labels, np.float64)
    shuffled = rng.permutation(len(texts))
    kept = len(texts) // 4
    aside, rest = shuffled[:kept], shuffled[kept:]
    adam = gru.Adam(w, 0.01)
    epochs = -(-updates // max(1, -(-len(rest) // 32)))
    for epoch in range(epochs):
        adam.rate = 0.01 * 0.2 ** (epoch / epochs)
        order = rng.permutation(rest)
        for a in range(0, len(order), 32):
            pick = order[a : a + 32]
            words = split_words([texts[i] for i in pick])
            if not len(words.hashes):
                continue
            word_row = (words.hashes % np.uint64(WORD_ROWS)).astype(np.int64)
            rows = (word_row, *grams(words, slice(None)))
            codes, owner = window_codes(words)
            drop = rng.random(len(word_row)) < 0.3
            adam.update(_gradients(w, words, rows, codes, owner, truth[pick], drop))
    fit_on = aside if 0 < truth[aside].sum() < len(aside) else shuffled
    model.slope, model.shift = _calibrate(model.logits([texts[i] for i in fit_on]), truth[fit_on])
    return model


def _calibrate(logits: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Logistic fit of the truth on the logits, kept finite by smoothed targets."""
    ones = truth.sum()
    target = np.where(truth > 0, (ones + 1) / (ones + 2), 1 / (len(truth) - ones + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = gru.sigmoid(slope * logits + shift)
        g, s = p - target, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * logits**2).sum() + 1e-3, (s * logits).sum()], [(s * logits).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * logits).sum() + 1e-3 * (slope - 1), g.sum()])
        step *= min(1.0, 1.0 / (np.abs(step).max() + 1e-12))
        slope, shift = slope - step[0], shift - step[1]
    return max(float(slope), 0.05), float(shift)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled rows (text, toxic); all toxic ones up to a third of that."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    ids: list[tuple[int, int]] = []
    for toxic, most in ((1, sample // 3), (0, sample - sample // 3)):
        chosen = known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids += [(r["doc_id"], r["toxic"]) for r in chosen.collect()]
    spark = docs.sparkSession
    # At most ``sample`` ids are broadcast.
    wanted = F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int"))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .filter(F.length("text") <= SAMPLE_CHARS)
        .join(wanted, "doc_id")
        .select("toxic", "text", F.xxhash64("text").alias("h"))
        .orderBy("h", "toxic", "text")
        .limit(sample)
        .select("text", "toxic")
    )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Learn from the rows of ``labels`` that are not held out; one task trains on the sample."""
    return fit_in_task(training_rows(docs, labels, sample), train) or ToxicityModel(None)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                s = own.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
