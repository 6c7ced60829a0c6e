"""Every query of the folder against SQL or a plain version, over whole small tables."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from rubrica.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def texts(docs):
    return {d["doc_id"]: d["text"] or "" for d in docs}


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r) for r in cur.fetchall()), key=repr)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == want


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in texts.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            own = ids[a : a + 4096]
            want[i, k] = (a, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    got = rows(spark, "op2_best_fit_packing")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    assert len(got) == len(want)
    filled = collections.defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(filled) <= -(-sum(r["length"] for r in got) // 4096) + 2


def simhash(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks, radius=4):
    ids = sorted(marks)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (marks[a] ^ marks[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, texts):
    marks = {i: simhash(t) for i, t in texts.items()}
    groups = brute_components(marks)
    got = rows(spark, "op3_simhash_near_dedup")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {
        i: (f"{marks[i]:016x}", groups[i]) for i in marks
    }


def test_language_is_learned(spark, docs):
    lang = {d["doc_id"]: d["lang"] for d in docs}
    got = rows(spark, "op5_language_id")
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_is_learned(spark, docs):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [r.asDict() for r in QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.01").collect()]
    assert len(got) == 1000
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    yes, no = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in yes for b in no]) > 0.9


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_spans(text):
    def luhn(s):
        return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + 2 * int(c) % 10 for i, c in enumerate(s[::-1])) % 10 == 0

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and luhn(d)
        return kind == "email" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text) if good(k, m[0])]


def test_personal_data(spark, texts):
    for r in rows(spark, "op7_pii"):
        want = brute_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _ in BASE] == [sum(w[0] == k for w in want) for k, _ in BASE]
        assert r["spans"] == joined or r["spans"].startswith(joined + "," * bool(joined) + "secret:")


def test_sharding(spark, texts):
    got = rows(spark, "op9_slot_sharding")
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    places, sizes = collections.defaultdict(list), collections.Counter()
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
        places[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    largest = max(len(t.encode()) for t in texts.values()) + 16
    assert max(sizes.values()) <= max(largest, 1.2 * sum(sizes.values()) / 40)


def test_token_counts(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows(spark, "op10_token_counts"):
        text = texts[r["doc_id"]]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)
