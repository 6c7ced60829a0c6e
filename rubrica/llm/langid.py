"""Language identification by a bidirectional gated recurrent network over bytes.

Every position of a text gets a label distribution; a document's probabilities are the mean
over its positions that belong to letters.  The network reads a text's bytes in segments of
``SEGMENT`` positions, each read with ``CONTEXT`` bytes of its neighbours on both sides, so that a text of any length takes bounded
memory and no position is left out.

Training (numpy, backpropagation through time) uses at most ``SAMPLE`` segments, an equal
share for each language, drawn by a hash of the text from labelled rows that are not held out.

Defined cases: null text or no letter gives ``und`` with score 0; a table without any labelled
row gives ``und`` everywhere; an empty table gives an empty result; repeated rows get equal
answers; extra columns are left out; a null id counts as not held out.
"""

from __future__ import annotations

import math
import random
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm import gru
from rubrica.llm.shared import fit_in_task, held_out

SAMPLE = 2_000
SEGMENT = 96
CONTEXT = 8
HIDDEN = 10
UPDATES = 190
UNKNOWN = "und"
#: The class of letter noise, for models that may reject; no language has this name.
NOISE = "\x00"
#: Every so many labelled parts, one is not trained on but sets the rejection rule; fewer than LEAST_PARTS reject nothing.
HELD = 4
LEAST_PARTS = 50
#: A text is rejected only if its neighbouring letters depend on each other by less than so many standard
#: deviations, measured on so many shuffles of it; texts with fewer pairs of neighbours are never rejected.
STRUCTURED = 5.0
SHUFFLES = 24
LEAST_PAIRS = 200
#: Segments that run through the network together; bounds memory only.
TOGETHER = 2_048


def letter_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII letters or part of a longer code."""
    low = data | 32
    return ((low >= 97) & (low <= 122)) | (data >= 128)


@dataclass
class LanguageModel:
    """Classes and weights; small, as it does not grow with the corpus."""

    languages: list[str]
    weights: dict[str, np.ndarray]
    #: A text of n letter bytes may be noise if noise is likelier than 1/2 + margin / sqrt(n); see ``neighbour_structure``.
    margin: float = math.inf

    def position_scores(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities (steps, languages, sequences) for byte codes (steps, sequences); states pass over
        256, which is padding, so an answer does not depend on what is read together."""
        w = self.weights
        mask = codes != 256
        ahead = gru.forward(gru.Lookup(self._table("f"), codes), w["f.U"], mask)
        back = gru.forward(gru.Lookup(self._table("b"), codes, reverse=True), w["b.U"], mask[::-1])
        steps = len(codes)
        out = np.empty((steps, len(self.languages), codes.shape[1]), np.float32)
        hidden = w["f.U"].shape[1]
        for t in range(steps):
            a = w["out"][:, :hidden] @ ahead[t]
            a += w["out"][:, hidden:] @ back[steps - 1 - t]
            a += w["out.b"]
            a -= a.max(axis=0)
            np.exp(a, out=a)
            a /= a.sum(axis=0)
            out[t] = a
        return out

    def _table(self, way: str) -> np.ndarray:
        return np.ascontiguousarray(self.weights[f"{way}.W"] + self.weights[f"{way}.b"])

    def documents(self, data: np.ndarray, bounds: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Mean probabilities (documents, languages) over letter positions of texts in ``data``."""
        n_docs, k = len(bounds) - 1, len(self.languages)
        totals = np.zeros((n_docs, k))
        lengths = np.diff(bounds)
        segments = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(n_docs), segments)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
        start = bounds[owner] + number * SEGMENT
        own = np.minimum(SEGMENT, bounds[owner + 1] - start)
        order = np.argsort(-own, kind="stable")
        for a in range(0, len(order), TOGETHER):
            pick = order[a : a + TOGETHER]
            longest = int(own[pick[0]])
            at = start[pick] - CONTEXT + np.arange(longest + 2 * CONTEXT)[:, None]
            inside = (at >= bounds[owner[pick]]) & (at < bounds[owner[pick] + 1])
            where = np.clip(at, 0, max(len(data) - 1, 0))
            codes = np.where(inside, data[where].astype(np.int32), 256)
            scores = self.position_scores(codes)[CONTEXT : CONTEXT + longest]
            counted = (inside & letters[where])[CONTEXT : CONTEXT + longest]
            counted &= np.arange(longest)[:, None] < own[pick]
            summed = np.einsum("tks,ts->sk", scores, counted.astype(np.float32))
            np.add.at(totals, owner[pick], summed)
        count = np.add.reduceat(np.r_[letters, False].astype(np.int64), bounds[:-1]) if n_docs else np.zeros(0)
        count = np.where(lengths > 0, count, 0)
        return totals / np.maximum(count, 1)[:, None]


def train(segments: list[bytes], labels: list[str], seed: int = 7, updates: int = UPDATES, hidden: int = HIDDEN) -> LanguageModel:
    """Fit the network: every letter position of a segment is to say the segment's language."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    f, b = gru.new_direction(257, hidden, rng), gru.new_direction(257, hidden, rng)
    w = {f"{way}.{k}": v for way, d in (("f", f), ("b", b)) for k, v in d.items()}
    for way in "fb":
        w[f"{way}.W"] *= 4
    w["out"] = rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32)
    w["out.b"] = np.zeros((len(languages), 1), np.float32)
    model = LanguageModel(languages, w)
    if len(languages) < 2 or not segments:
        return model
    steps = SEGMENT + 2 * CONTEXT
    codes = np.full((steps, len(segments)), 256, np.int32)
    for i, s in enumerate(segments):
        codes[: len(s), i] = np.frombuffer(s[:steps], np.uint8)
    truth = np.array([languages.index(x) for x in labels])
    adam = gru.Adam(w, 0.02)
    size = 64
    epochs = -(-updates // -(-len(segments) // size))
    for epoch in range(epochs):
        adam.rate = 0.02 * 0.12 ** (epoch / epochs)
        order = rng.permutation(len(segments))
        for a in range(0, len(segments), size):
            pick = order[a : a + size]
            adam.update(_gradients(w, codes[:, pick], truth[pick]))
    return model


def _gradients(w: dict[str, np.ndarray], codes: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
    steps, n = codes.shape
    hidden = w["f.U"].shape[1]
    mask = codes != 256
    counted = mask & letter_bytes(np.minimum(codes, 255).astype(np.uint8))
    ahead, kept_f = gru.forward(gru.Lookup(w["f.W"] + w["f.b"], codes), w["f.U"], mask, keep=True)
    back, kept_b = gru.forward(gru.Lookup(w["b.W"] + w["b.b"], codes, True), w["b.U"], mask[::-1], keep=True)
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    weight = counted / max(1, counted.sum())
    d_f, d_b = [None] * steps, [None] * steps
    for t in range(steps):
        both = np.concatenate([ahead[t], back[steps - 1 - t]])
        a = w["out"] @ both + w["out.b"]
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        a[truth, np.arange(n)] -= 1
        a = (a * weight[t]).astype(np.float32)
        grads["out"] += a @ both.T
        grads["out.b"] += a.sum(axis=1, keepdims=True)
        d = w["out"].T @ a
        d_f[t], d_b[steps - 1 - t] = d[:hidden], d[hidden:]
    for way, d, kept, own, m in (("f", d_f, kept_f, codes, mask), ("b", d_b, kept_b, codes[::-1], mask[::-1])):
        grads[f"{way}.U"], projected = gru.backward(d, kept, w[f"{way}.U"], m)
        flat = np.concatenate(projected, axis=1)
        grads[f"{way}.b"] += flat.sum(axis=1, keepdims=True)
        grads[f"{way}.W"] += gru.sum_rows(flat.T, own.reshape(-1), 257).T
    return grads


def training_segments(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most twice ``sample`` parts of texts with their languages; the choice depends on texts alone."""
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = max(1, sample // max(1, len(counts)))
    span = SEGMENT + 2 * CONTEXT
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    chances = [F.when(F.col("lang") == k, F.lit(min(1.0, 1.5 * share / n))) for k, n in sorted(counts.items())]
    at = 1 + F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - span))
    return (
        labelled.filter(drawn < F.coalesce(*chances, F.lit(0.0)))
        .select("lang", F.substring("text", at.cast("int"), F.lit(span)).alias("part"), F.xxhash64("text", F.lit(2)).alias("h"))
        .orderBy("h", "lang", "part")
        .limit(2 * sample)
        .select("part", "lang")
    )


def train_sample(parts: list[str], languages: list[str], sample: int = SAMPLE) -> LanguageModel:
    """Train on equal shares of the languages, in the order given."""
    share = max(1, sample // max(1, len(set(languages))))
    taken: dict[str, int] = {}
    segments, labels = [], []
    for part, language in zip(parts, languages):
        if taken.get(language, 0) < share and any(map(str.isalpha, part)):
            taken[language] = taken.get(language, 0) + 1
            segments.append(part.encode()[: SEGMENT + 2 * CONTEXT])
            labels.append(language)
    return train(segments, labels)


def noise(like: str, rng: random.Random) -> str:
    """Letter noise as long as ``like``: base64 or base32, random letters in words, or struck keys."""
    kind, size = rng.randrange(4), len(like)
    if kind == 0:
        return "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=size))
    if kind == 1:
        return "".join(rng.choices(rng.choice((string.ascii_uppercase + "234567", string.ascii_letters + string.digits)), k=size))
    if kind == 2:
        letters = rng.choice((string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters))
        return "".join(" " if x.isspace() else rng.choice(letters) for x in like)
    row = rng.choice(("asdfghjkl", "qwertyuiop", "asdfjkl", "zxcvbnm", "qwertyuiopasdfghjklzxcvbnm"))
    return "".join(rng.choices(row + " " * rng.randrange(2), k=size))


def neighbour_structure(text: str, seed: int = 11) -> float:
    """How far letters that stand side by side depend on each other, in standard deviations over the same
    letters shuffled.  In the words of any language they do, in noise they do not; infinite for texts
    with fewer than ``LEAST_PAIRS`` such pairs, of which nothing can be said."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    where = np.flatnonzero(letter_bytes(data))
    beside = np.flatnonzero(np.diff(where) == 1)
    if len(beside) < LEAST_PAIRS:
        return math.inf
    letters = data[where].astype(np.int64)

    def dependence(row: np.ndarray) -> float:
        n = np.unique(row[beside] * 256 + row[beside + 1], return_counts=True)[1]
        return float((n * np.log(n)).sum())

    rng = np.random.default_rng(seed)
    shuffled = np.array([dependence(rng.permutation(letters)) for _ in range(SHUFFLES)])
    return (dependence(letters) - shuffled.mean()) / max(1e-9, shuffled.std(ddof=1))


def rejection_margin(model: LanguageModel, parts: list[str], safety: float = 1.5) -> float:
    """The margin at which none of ``parts``, nor a beginning of one, is noise; then widened."""
    if len(parts) < LEAST_PARTS or NOISE not in model.languages:
        return math.inf
    cuts = [p[:n] for p in parts for n in (4, 8, 16, 32, 64, len(p)) if n <= len(p) and any(map(str.isalpha, p[:n]))]
    likely, letters = noise_likelihood(model, cuts)
    return safety * max(1.0, float(((likely - 0.5) * np.sqrt(letters)).max(initial=0.0)))


def noise_likelihood(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean probability of noise of each text, and its letter bytes."""
    coded = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(coded), np.uint8)
    bounds = np.r_[0, np.cumsum([len(c) for c in coded])].astype(np.int64)
    letters = letter_bytes(data)
    return model.documents(data, bounds, letters)[:, model.languages.index(NOISE)], letter_counts(bounds, letters)


def letter_counts(bounds: np.ndarray, letters: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(letters)][bounds])


def train_rejecting(parts: list[str], languages: list[str], sample: int = SAMPLE) -> LanguageModel:
    """Train on the languages and on noise as one more class; parts held back set the rejection rule."""
    known = [(p, x) for p, x in zip(parts, languages) if any(map(str.isalpha, p))]
    if not known:
        return LanguageModel([], {})
    if len(known) < HELD * LEAST_PARTS:
        return train_sample(*map(list, zip(*known)), sample)
    back = [p for p, _ in known[::HELD]]
    learned = [x for i, x in enumerate(known) if i % HELD]
    share = max(1, sample // len({x for _, x in learned}))
    rng = random.Random(7)
    learned += [(noise(p, rng), NOISE) for p, _ in learned[:share]]
    model = train_sample(*map(list, zip(*learned)), sample)
    model.margin = rejection_margin(model, back)
    return model


def fit_rejecting(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """As ``fit``, but the model may say ``und`` of letter noise."""
    return fit_in_task(training_segments(docs, sample), lambda a, b: train_rejecting(a, b, sample)) or LanguageModel([], {})


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learn from text and non-null lang of the rows of ``docs`` that are not held out; one task trains on the sample."""
    return fit_in_task(training_segments(docs, sample), lambda a, b: train_sample(a, b, sample)) or LanguageModel([], {})


def identify(docs: DataFrame, model: LanguageModel, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` with the predicted language and its score; reads the text column only.

    Older columns of these two names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(label, score)
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            predicted: list[str] = []
            scores: list[float] = []
            for group in _groups(texts):
                p, s = predict(own, group)
                predicted += p
                scores += s
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(predicted, pa.string()), pa.array(scores, pa.float64())],
                names=[*names, label, score],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{label}` string, `{score}` double")


def _groups(texts: list, most: int = 1 << 20) -> Iterator[list]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def predict(model: LanguageModel, texts: list) -> tuple[list[str], list[float]]:
    """Language and probability of each text."""
    coded = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"".join(coded), np.uint8)
    bounds = np.r_[0, np.cumsum([len(c) for c in coded])].astype(np.int64)
    some = [t is not None and any(map(str.isalpha, t)) for t in texts]
    if not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    # Codes beyond ASCII that are no letters may count as positions; a text of them alone is unknown.
    letters = letter_bytes(data)
    means = model.documents(data, bounds, letters)
    if NOISE in model.languages:
        at = model.languages.index(NOISE)
        bound = 0.5 + model.margin / np.sqrt(np.maximum(letter_counts(bounds, letters), 1))
        likely = means[:, at] > bound
        some = [ok and not (reject and neighbour_structure(t) < STRUCTURED) for ok, reject, t in zip(some, likely, texts)]
        means[:, at] = -1
    best = means.argmax(axis=1)
    labels = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, some)]
    scores = [float(min(1.0, means[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, some))]
    return labels, scores
