"""Licence scan, token alignment and lexical search against brute force, and their corner cases."""

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from rubrica.llm import lexical_search, license_scan, token_alignment
from rubrica.llm.license_templates import BSD, GPL_NOTICE, MIT, PHRASES, TEMPLATES
from rubrica.llm.units import distinct, spaced, unit_starts

SCHEMA = "doc_id long, text string, label string, score double, block long, item long, term string"
ODD = [
    None, "", " ", "  a", "a  b", "x  y 　z", "▁ab c", "a <|endoftext|> b", "<s> x</s>", "\n\nab \n c", "é è  f", "tab\t x", " \x85 y", "a\x00b c",
    "日本 語 です", "ab" * 3000, "'s it's 's  's", "ab  cd", "É x", "a b c d e f g " * 300,
]


def frame(spark, texts, ids=None):
    rows = [(i, t, "x", 1.0, 7, 3, "t") for i, t in zip(range(len(texts)) if ids is None else ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


# --- licence scan -----------------------------------------------------------


def scan_brute(text):
    """Matching statistics and phrases by comparing with every place of every template."""
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    phrases = []
    for k, (_, phrase) in enumerate(PHRASES):
        own = license_scan.words_of(phrase)
        phrases += [(k, i) for i in range(len(words)) if words[i : i + len(own)] == own]
    lists = [license_scan.words_of(t) for _, t in [*TEMPLATES, *PHRASES]]
    longest = []
    for i in range(len(words)):
        best = 0
        for own in lists:
            for j in range(len(own)):
                n = 0
                while n <= min(i, j) and words[i - n] == own[j - n]:
                    n += 1
                best = max(best, n)
        longest.append(best)
    ends = [(i, n) for i, n in enumerate(longest) if n >= license_scan.LEAST and (i + 1 == len(longest) or longest[i + 1] != n + 1)]
    return len(words), sorted(phrases), ends


def license_texts():
    rng = random.Random(2)
    mixed = MIT.split()
    out = [MIT, "pre " + MIT.lower() + " post MIT License.", GPL_NOTICE, "MIT-License, mit  license; Apache_License", "the general public License" * 3, None, "", "license mit license mit"]
    for _ in range(6):
        words = list(mixed)
        for at in range(rng.randrange(5, 12), len(words), rng.randrange(9, 20)):
            words[at] = rng.choice(["the", "of", "zzz", "software"])
        out.append(" ".join(words))
    out.append(BSD[:400] + " nothing to do with it at all " * 20 + BSD[400:])
    return out


def test_license_statistics_and_phrases_equal_brute_force():
    scanner = license_scan.LicenseScanner()
    texts = license_texts()
    n, phrases, _ = scanner.scan(pa.array(texts, pa.string()))
    for text, count, found in zip(texts, n, phrases):
        words, want, ends = scan_brute(text)
        assert (count, sorted(found)) == (words, want)
        number = {w: k for k, w in enumerate(scanner.vocabulary.to_pylist())}
        own = [(i, number[w]) for i, w in enumerate(license_scan.words_of(text)) if w in number]
        got = scanner.statistics([i for i, _ in own], [w for _, w in own])[1]
        assert [(end, size) for end, size, _ in got] == ends


def test_license_spans():
    scanner = license_scan.LicenseScanner()
    labels = [{scanner.templates[t][0] for t, *_ in found} for found in scanner.scan(pa.array(license_texts(), pa.string()))[2]]
    assert labels[0] == {"mit"} and labels[1] == {"mit"} and "gpl" in labels[2] and labels[3] == labels[5] == set()
    assert all("mit" in x for x in labels[8:14])
    whole = scanner.scan(pa.array([MIT]))[2][0]
    assert [(a, b, c) for t, a, b, c in whole if t == 0] == [(0, scanner.sizes[0] - 1, scanner.sizes[0])]
    # Far apart halves of a template are two chains; only the longer one covers half.
    apart = scanner.scan(pa.array([license_texts()[-1]]))[2][0]
    assert len(apart) == 1 and apart[0][3] < scanner.sizes[1]


def test_license_query_rows(spark):
    texts = license_texts() + ODD
    docs = frame(spark, texts, [*range(len(texts) - 1), None])
    got = license_scan.summary(license_scan.find_licenses(docs.repartition(3)))
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(texts) and got.columns[:5] == ["doc_id", "n_words", "n_base", "first_word", "last_word"]
    r = rows[1]
    assert (r.base_labels, r.labels, r.score, r.n_base) == ("mit", "mit", 1.0, 1) and r.first_word == r.last_word
    assert (rows[5].n_words, rows[5].n_base, rows[5].first_word, rows[5].base_labels, rows[5].labels, rows[5].score) == (0, 0, None, "", "", 0.0)
    assert rows[2].base_labels == "gpl" and rows[0].base_labels == "" and rows[0].labels == "mit" and rows[0].score == 1.0
    assert license_scan.find_licenses(docs.limit(0)).count() == 0
    assert license_scan.find_licenses(docs.union(docs)).count() == 2 * len(texts)


# --- token alignment ------------------------------------------------------------


@pytest.fixture(scope="module")
def sides():
    return token_alignment.side("byte_bpe_50k.json"), token_alignment.side("piece_bpe_32k.model")


def align_brute(text, a, b):
    """Counts, digest and links of one text, from the library's tokens of the whole text."""
    none = (0, 0, 0, 0, ""), []
    if not text:
        return none
    spans = []
    for ids, side in ((a.vocabulary.library.encode(" " + text, add_special_tokens=False).ids, a), (b.vocabulary.library.encode(text), b)):
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(side.vocabulary.tokens[i]), i))
            at = own[-1][1]
        if b"".join(side.vocabulary.tokens[i] for i in ids) != (" " + text).encode():
            return none
        spans.append(own)
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups = []
    for low, high in zip([0, *cuts], cuts):
        groups.append("|".join(",".join(str(i) for x, y, i in own if low <= x and y <= high) for own in spans))
    links = [(i, j) for x, y, i in spans[0] for u, v, j in spans[1] if x < v and u < y]
    return (len(spans[0]), len(spans[1]), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()), links


def test_alignment_equals_brute_force(spark, sides):
    rng = random.Random(4)
    letters = "abcdeéñ 　\n\t  ,.'0123▁<|>日ß"
    texts = [t if t is None else t[:900] for t in ODD] + ["".join(rng.choices(letters + " " * 5, k=rng.randrange(120))) for _ in range(60)]
    want = [align_brute(t, *sides) for t in texts]
    total = Counter(link for _, links in want for link in links)
    most = Counter()
    for (_, j), n in total.items():
        most[j] = max(most[j], n)
    for block in (1 << 23, 200):
        ids = [*range(len(texts) - 1), None]
        rows = token_alignment.align(frame(spark, texts, ids).repartition(3), block_bytes=block).collect()
        got = {r.doc_id: r for r in rows}
        assert len(rows) == len(texts)
        for i, (figures, links) in zip(ids, want):
            r = got[i]
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == figures
            assert (r.n_best, r.count_sum) == (sum(total[x] == most[x[1]] for x in links), sum(total[x] for x in links))
    assert token_alignment.align(frame(spark, texts).limit(0)).count() == 0


def test_coalescing_joins_overlapping_intervals():
    import numpy as np

    a, b = np.array([0, 2, 5, 9]), np.array([0, 3, 5, 7])
    group_a, group_b = token_alignment.coalesced(a, np.array([2, 5, 9, 10]), b, np.array([3, 5, 7, 10]))
    assert group_a.tolist() == [0, 0, 1, 1] and group_b.tolist() == [0, 0, 1, 1]
    x, y = token_alignment.overlaps(a, np.array([2, 5, 9, 10]), b, np.array([3, 5, 7, 10]))
    assert list(zip(x.tolist(), y.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 2), (2, 3), (3, 3)]


def test_units_join_to_the_text():
    data, bounds = spaced(pa.array(ODD, pa.string()))
    starts = unit_starts(data, bounds)
    numbers, own, own_bounds = distinct(data, [*starts, len(data)])
    units = [own[own_bounds[n] : own_bounds[n + 1]].tobytes() for n in numbers]
    assert b"".join(units) == b"".join(b" " + (t or "").encode() for t in ODD)
    assert sum(len(u) for u in units) == bounds[-1] and len(set(units)) == len(own_bounds) - 1


# --- lexical search ---------------------------------------------------------------


def search_brute(docs, items, top=10):
    """All scores by the definition."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    held = Counter(t for _, w in own for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for doc, words in own:
            tf = Counter(words)
            score = 0
            for t in set(terms(text)) & set(words):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                score += weight * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * (100 - 90 + (90 * len(words) * n_docs) // total)))
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, k + 1, doc, -score) for k, (score, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark):
    rng = random.Random(9)
    words = ["Ab", "ab", "été", "x1", "a-b", "日本", "of", "the", "Zz", "q"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(words, k=n)).replace("w1", rng.choice(["w1,", "w1\n", "(w1)"]))
    texts = [text(rng.randrange(1, 80)) for _ in range(150)] + ["same text w1 of"] * 14 + ODD
    docs = [*enumerate(texts), (None, "same text w1 of"), (3, texts[3])]
    items = [(k, text(rng.randrange(1, 12))) for k in range(25)] + [(5, "the the of"), (None, "w1 of same"), (90, ""), (91, None), (92, "nowhere"), (93, "!!")]
    want = search_brute(docs, items)
    left = frame(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(7)
    right = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    for block in (200_000, 15):
        got = sorted((tuple(r) for r in lexical_search.search(left, right, block_terms=block).collect()), key=repr)
        assert got == want
    assert lexical_search.search(left.limit(0), right).count() == 0
    assert lexical_search.search(left, right.limit(0)).count() == 0
