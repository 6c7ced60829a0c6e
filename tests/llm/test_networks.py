"""The two networks against plain forward passes, one text and one step at a time, and finite differences."""

import math
import random

import numpy as np

from rubrica.llm import gru, langid, toxicity
from rubrica.llm.wordhash import word_hashes

TEXTS = ["", "a", "Der Hund.", "été à Óbidos " * 9, "x" * 96, "y" * 97, "one two three four " * 40, "12 34 !!", "日本語 " * 60, "the\nof the " * 130]


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def step(w, way, h, x):
    """One step of a gated recurrent unit on input column ``x``."""
    hidden = len(h)
    a = w[f"{way}.W"].astype(np.float64) @ x + w[f"{way}.b"][:, 0]
    u = w[f"{way}.U"].astype(np.float64)
    z, r = sigmoid(a[:hidden] + u[:hidden] @ h), sigmoid(a[hidden : 2 * hidden] + u[hidden : 2 * hidden] @ h)
    n = np.tanh(a[2 * hidden :] + u[2 * hidden :] @ (r * h))
    return z * h + (1 - z) * n


def states(w, xs):
    """States of both directions at every step."""
    hidden = w["f.U"].shape[1]
    ahead, back, h = [], [], np.zeros(hidden)
    for x in xs:
        h = step(w, "f", h, x)
        ahead.append(h)
    h = np.zeros(hidden)
    for x in xs[::-1]:
        h = step(w, "b", h, x)
        back.append(h)
    return [np.concatenate(p) for p in zip(ahead, back[::-1])]


def language_brute(model, text):
    data = text.encode()
    total, letters = np.zeros(len(model.languages)), 0
    for at in range(0, len(data), langid.SEGMENT):
        low, high = max(0, at - langid.CONTEXT), min(len(data), at + langid.SEGMENT + langid.CONTEXT)
        xs = [np.eye(257)[b] for b in data[low:high]]
        for place, h in enumerate(states(model.weights, xs), start=low):
            b = data[place]
            if at <= place < at + langid.SEGMENT and (b >= 128 or chr(b).isalpha()):
                a = model.weights["out"].astype(np.float64) @ h + model.weights["out.b"][:, 0]
                total += np.exp(a - a.max()) / np.exp(a - a.max()).sum()
                letters += 1
    return total / max(1, letters)


def test_languages_equal_a_plain_forward_pass():
    rng = random.Random(1)
    parts = ["".join(rng.choices(letters, k=100)) for letters in ("abcd ", "efgh ", "ñéüß ") for _ in range(30)]
    model = langid.train([p.encode()[:112] for p in parts], ["a"] * 30 + ["e"] * 30 + ["n"] * 30, updates=25)
    labels, scores = langid.predict(model, TEXTS)
    for text, label, score in zip(TEXTS, labels, scores):
        want = language_brute(model, text)
        if not any(map(str.isalpha, text)):
            assert (label, score) == ("und", 0.0)
        else:
            assert abs(score - want.max()) < 1e-5 and label == model.languages[want.argmax()]
    # What is read together does not matter.
    assert all(abs(langid.predict(model, [t])[1][0] - s) < 1e-6 for t, s in zip(TEXTS, scores))


def toxicity_brute(model, text):
    w = model.weights
    words = ["".join(x).encode() for x in _runs(text.lower())]
    windows = [words[a : a + toxicity.WINDOW] for a in range(0, max(1, len(words) - toxicity.STRIDE), toxicity.STRIDE)] or [[]]
    best = -math.inf
    for window in windows:
        xs = []
        for word in window:
            data = np.frombuffer(b" " + word + b" ", np.uint8)
            x = w["word"][int(word_hashes(data, np.array([1]), np.array([len(data) - 1]))[0]) % toxicity.WORD_ROWS].astype(np.float64)
            for n in (3, 4, 5):
                for at in range(len(data) - n + 1):
                    packed = n
                    for b in data[at : at + n]:
                        packed = ((packed << 8) | int(b)) & (1 << 64) - 1
                    x = x + w["gram"][(packed * int(toxicity.MIX) & (1 << 64) - 1) >> 50]
            xs.append(x)
        pooled, total = np.zeros(2 * w["f.U"].shape[1]), 0.0
        for h in states(w, xs):
            e = math.exp(float(np.clip(w["attend"][0] @ h, -30, 30)))
            pooled, total = pooled + e * h, total + e
        best = max(best, float(w["out"][0] @ (pooled / max(total, 1e-9)) + w["out.b"][0, 0]))
    return 1 / (1 + math.exp(-(model.slope * best + model.shift)))


def _runs(text):
    run = []
    for c in text + " ":
        if "a" <= c <= "z" or "0" <= c <= "9" or c > "\x7f":
            run.append(c)
        elif run:
            yield run
            run = []


def test_toxicity_equals_a_plain_forward_pass():
    rng = random.Random(2)
    bad, good = ["vile", "awful"], ["nice", "tea", "été", "sun", "walk"]
    texts = [" ".join(rng.choices(good + bad * (i % 2), k=30)) for i in range(60)]
    model = toxicity.train(texts, [i % 2 for i in range(60)], updates=20)
    got = model.scores(TEXTS)
    assert np.abs(got - np.array([toxicity_brute(model, t) for t in TEXTS])).max() < 1e-5
    assert np.abs(got - np.array([model.scores([t])[0] for t in TEXTS])).max() < 1e-6


def check_gradients(w, grads, loss, entries):
    rng = np.random.default_rng(3)
    for name, grad in grads.items():
        places = np.argwhere(np.abs(grad) > 1e-6)
        assert len(places), name
        for place in rng.permutation(places)[:entries]:
            at, kept, e = tuple(place), w[name][tuple(place)], 1e-3
            w[name][at] = kept + e
            up = loss()
            w[name][at] = kept - e
            down = loss()
            w[name][at] = kept
            assert abs((up - down) / (2 * e) - grad[at]) < 2e-3 + 0.03 * abs(grad[at]), (name, at)


def as_doubles(w):
    return {k: v.astype(np.float64) for k, v in w.items()}


def test_language_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(4)
    w = {f"{way}.{k}": v for way in "fb" for k, v in gru.new_direction(257, 4, rng).items()}
    w["out"], w["out.b"] = rng.normal(0, 1, (3, 8)).astype(np.float32), np.zeros((3, 1), np.float32)
    codes = np.full((9, 4), 256, np.int32)
    for i, text in enumerate(("abc de", "fgh", "été", "abcabcabc")):
        codes[: len(text.encode()), i] = np.frombuffer(text.encode(), np.uint8)[:9]
    truth = np.array([0, 1, 2, 0])
    w = as_doubles(w)

    def loss():
        total, n = 0.0, 0
        for i in range(4):
            data = [int(c) for c in codes[:, i] if c != 256]
            for b, h in zip(data, states(w, [np.eye(257)[c] for c in data])):
                if b >= 128 or chr(b).isalpha():
                    a = w["out"] @ h + w["out.b"][:, 0]
                    total -= (a - a.max())[truth[i]] - math.log(np.exp(a - a.max()).sum())
                    n += 1
        return total / n

    check_gradients(w, langid._gradients(w, codes, truth), loss, 4)


def test_toxicity_gradients_are_those_of_the_loss():
    texts, truth = ["vile awful tea", "nice sun " * 20, "walk"], np.array([1.0, 0.0, 1.0])
    model = toxicity.train(texts * 8, [1, 0, 1] * 8, updates=3)
    w = model.weights = as_doubles(model.weights)
    words = toxicity.split_words(texts)
    row = (words.hashes % np.uint64(toxicity.WORD_ROWS)).astype(np.int64)
    rows = (row, *toxicity.grams(words, slice(None)))
    codes, owner = toxicity.window_codes(words)

    def loss():
        x = model_inputs(w, words, rows)
        tables = [w[f"{d}.W"] @ x.T + w[f"{d}.b"] for d in "fb"]
        logit = toxicity.attend(w, tables, codes)
        pooled = np.array([np.log(np.exp(logit[owner == i]).sum()) for i in range(len(texts))])
        p = sigmoid(pooled)
        return float(-(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean())

    check_gradients(w, toxicity._gradients(w, words, rows, codes, owner, truth, np.zeros(len(row), bool)), loss, 3)


def model_inputs(w, words, rows):
    word_row, gram_row, gram_owner = rows
    x = np.zeros((len(words.hashes) + 1, toxicity.WIDTH))
    x[:-1] = w["word"][word_row]
    np.add.at(x, gram_owner, w["gram"][gram_row])
    return x
