"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rubrica.llm import (
    chat,
    components,
    decontaminate,
    exact_dedup,
    langid,
    packing,
    pii,
    simhash_dedup,
    slots,
    token_counts,
    toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, part int"
LONG = "uno dos tres cuatro " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "one two three four five six seven", "en"),
        (2, "one two three four five six seven", "en"),
        (2, "one two three four five six seven", "en"),
        (3, None, None),
        (4, "", "en"),
        (None, "der die das und nicht aber", "de"),
        (None, None, "de"),
        (7, LONG, "es"),
        (8, "12 34 !!", "en"),
        (9, "der die das und nicht aber noch eins", "de"),
    ]
    return spark.createDataFrame([(*r, None, 0, 0.5, "x", 3) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(odd, none):
    got = exact_dedup.exact_groups(odd, keep="largest").collect()
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    same = by[hashlib.sha256(b"one two three four five six seven").hexdigest()]
    assert [r["keep_id"] for r in same] == [2, 2, 2] and sum(r["kept"] for r in same) == 1
    assert next(r for r in same if r["kept"])["doc_id"] == 2 and {r["group_size"] for r in same} == {3}
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert sorted(str(r["doc_id"]) for r in empty) == ["3", "4", "None"] and {r["keep_id"] for r in empty} == {4}
    assert len(got) == 10 and sum(r["kept"] for r in got) == len(by)
    small = exact_dedup.exact_groups(odd, keep="smallest", normalise=F.upper).collect()
    assert {r["keep_id"] for r in small if r["group_size"] == 3} == {1, 3}
    assert exact_dedup.exact_groups(none).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(odd, keep="first")


def test_exact_joins_runs_over_range_borders(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("hot").alias("text"))
    got = exact_dedup.exact_groups(docs.repartition(5), keep="largest")
    hot = got.filter("group_size > 1").collect()
    assert len(hot) == 2000 and {(r["keep_id"], r["group_size"]) for r in hot} == {(2999, 2000)}
    assert [r["doc_id"] for r in hot if r["kept"]] == [2999] and got.filter("kept").count() == 1001


def test_simhash(odd, none):
    got = simhash_dedup.near_groups(odd).collect()
    assert len(got) == 10
    zero = [r for r in got if r["fp"] == 0]
    assert len(zero) == 3 and {r["component_id"] for r in zero} == {3} and sum(r["kept"] for r in zero) == 1
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert simhash_dedup.near_groups(none).count() == 0


@pytest.mark.parametrize("count", [100, 10**6, 10**9, 10**13])
def test_every_close_pair_meets_in_a_shard(spark, count):
    random.seed(count)
    marks = [random.getrandbits(64) for _ in range(40)]
    marks += [m ^ sum(1 << b for b in random.sample(range(64), 4)) for m in marks]
    signed = [(m - (1 << 64) if m >> 63 else m,) for m in set(marks)]
    df = spark.createDataFrame(signed, "fp long")
    for large in (2000, 1):  # with 1, every shard is dealt again
        if large == 1 and count > 10**6:
            continue
        links = simhash_dedup.fingerprint_links(df, count, large=large).collect()
        root = components.join_nodes((r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links)
        for a, b in zip(marks, marks[40:]):
            assert root[a] == root[b]
        assert len(set(root.values())) >= 39


def test_fingerprints_do_not_depend_on_blocks():
    from tests.llm.test_queries import simhash

    rng = random.Random(8)
    for n in (0, 1, 3, 4, 5, 40, 300):
        text = " ".join(rng.choice(["Ab", "c", "ÄÖ", "x\ty", "\u00a0"]) + rng.choice(["", " ", "\n"]) for _ in range(n))
        want = simhash(text)
        for block in (1, 7, 64, 1 << 20):
            assert simhash_dedup.fingerprint(text, block=block) == want


def test_bk_tree_finds_what_brute_force_finds():
    random.seed(1)
    marks = list({random.getrandbits(12) for _ in range(300)})
    tree = simhash_dedup.BKTree(marks)
    for m in marks[:50]:
        assert sorted(tree.within(m, 2)) == sorted(x for x in marks if (x ^ m).bit_count() <= 2)
        tree.take(m)
        assert m not in tree.within(m, 2)
        marks = [x for x in marks if x != m]


def test_components_by_contraction(spark):
    random.seed(2)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    links += [(random.randrange(2000, 2400), random.randrange(2000, 2400)) for _ in range(300)]
    want = components.join_nodes((a, b) for a, b in links if a != b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long"), finish=3).collect()}
    assert set(got) == set(want)
    pairs = {(want[x], got[x]) for x in want}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_language(odd, none):
    model = langid.fit(odd)
    got = langid.identify(odd, model)
    assert got.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score"]
    und = {r["text"] for r in got.filter("lang_pred = 'und'").collect()}
    assert und == {None, "", "12 34 !!"}
    assert langid.identify(none, model).count() == 0
    blank = langid.fit(none)
    assert {r["lang_pred"] for r in langid.identify(odd, blank).collect()} == {"und"}


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 1), (7, 1, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0
    nothing = toxicity.fit(odd, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd, nothing).collect()} == {0.0}


def test_windows_cover_the_text_and_overlap():
    words = toxicity.split_words(["", None, " ".join(f"w{i}" for i in range(100)), "Größe! ok"])
    codes, owner = toxicity.window_codes(words)
    assert list(words.bounds) == [0, 0, 0, 100, 102]
    seen = codes[:, owner == 2]
    assert set(seen[seen >= 0]) == set(words.code[:100]) and seen.shape == (32, 6)
    assert (codes[:, owner == 0] == -1).all() and (owner == 0).sum() == 1


def test_personal_data(spark, none):
    texts = [
        None,
        "",
        "+1 (988) 555-2485 and 4539 1488 0343 6467, a@b.c_d@e.ff, 1.2.3.4.5.6.7.8, 256.1.1.1",
        'é password=4f9a31c77be2d0aa5512 "x"',
        "ü" + "a.b@c-d.ee x " * 1500,
        "0" * 5000 + "@" + "a" * 5000 + "." * 10,
        "visit in 2024-01-02 and step12345 more",
    ]
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_email long")
    spans, _ = pii.find_spans(docs)
    got = {r["doc_id"]: r for r in pii.summary(spans).collect()}
    from tests.llm.test_queries import BASE, brute_spans

    for i, t in enumerate(texts):
        want = brute_spans(t or "")
        assert [got[i or None][f"n_{k}"] for k, _ in BASE] == [sum(w[0] == k for w in want) for k, _ in BASE]
        assert got[i or None]["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in want))
    assert got[3]["n_secret"] == 1 and got[6]["n_secret"] == 0
    assert pii.summary(pii.find_spans(none.select("doc_id", "text"))[0]).count() == 0


def test_address_parts_of_zeros(spark):
    texts = ["10.0.0.1", "0.0.0.0", "1.2.3.00", "127.0.0.1 and 192.168.0.1", "010.000.0255.1", "1.0.0256.1", "0.0.0.0300", "0" * 4000 + ".0.0.0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.summary(pii.find_spans(docs)[0]).collect()}
    assert [got[i]["n_ip"] for i in range(len(texts))] == [1, 1, 1, 2, 1, 0, 0, 1]
    from tests.llm.test_queries import brute_spans

    for i, t in enumerate(texts):
        assert got[i]["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(t)))


def test_reliable_labelers_get_more_weight():
    patterns = {"22222211": 40, "12221111": 30, "00000011": 200, "10101111": 150, "21010111": 5}
    prior, odds = pii.estimate(patterns)
    assert prior < 0 and odds[0][2] > 0 > odds[0][0]
    bias, weights = pii.fit_classifier([("000000000", 0.0, 50.0), ("300000000", 40.0, 1.0)])
    assert bias + weights[0, 3] + sum(weights[j, 0] for j in range(1, 9)) > 0


def test_packing(odd, none):
    got = packing.pack(packing.pieces(odd.drop("part"))).collect()
    assert sum(r["piece"] == 0 for r in got) == 10
    assert sorted(r["length"] for r in got if r["doc_id"] in (3, 4)) == [1, 1]
    assert max(r["piece"] for r in got if r["doc_id"] == 7) >= 15
    assert packing.pack(packing.pieces(none)).count() == 0


def check_plan(counts, capacity):
    table, sequences = packing.plan(counts, capacity)
    used, number = {}, {}
    for length, first, sequence, each, offset in table.tolist():
        rows = [r for r in table.tolist() if r[0] == length and r[1] > first]
        n = (min(r[1] for r in rows) if rows else counts[length]) - first
        assert first == number.get(length, 0)
        number[length] = first + n
        for j in range(n):
            used.setdefault(sequence + j // each, []).append((offset + j % each * length, length))
    assert number == {k: v for k, v in counts.items() if v}
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(used) == list(range(sequences))
    return sequences


def test_plans_are_whole_and_tight():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([10, 60, 100])
        counts = {n: rng.choice([0, 1, 2, 7, 1000]) for n in rng.sample(range(1, capacity + 1), 8)}
        n = check_plan(counts, capacity)
        assert n <= 1.3 * sum(k * v for k, v in counts.items()) / capacity + 2 or any(2 * k > capacity for k in counts)
    assert check_plan({60: 10, 40: 10}, 100) == 10
    assert check_plan({}, 100) == 0
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100)


TRICKY = [
    "it's 'sab  x\n\ny ''s !!'s don’t <|endoftext|>x<|endoftext|>",
    "Ünïcödé ÀÉ été ΣΑΣ İstanbul K ²m² 3rd_a ǅ ﬁ",
    "tab\tnbsp thin x\x1cy\x85z 　 end ",
    "中文字符 и русский текст 12345 --- ___ a1b2",
    "a" * 300 + " " * 40 + "\n \n" + "!?" * 200,
    "<|startoftext|>hello<|endoftext| >",
]


def test_ids_equal_the_librarys():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    words = packing.WordEncoder(path)
    for _ in range(2):
        coded, at = words.encode(pa.array(TRICKY))
        for t, a, b in zip(TRICKY, at, at[1:]):
            assert coded[a:b] == words.packed(library.encode(t, add_special_tokens=False).ids)


def test_counts_equal_the_librarys():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    made = ["".join(rng.choice(["a", "é", " ", "  ", "²", "³5", "ǅ", "́", "\n", "1", "!", "'s", "<|endoftext|>", "word "]) for _ in range(400)) for _ in range(40)]
    made += ["x" * 2000, " " * 2000, "<|endoftext|>" * 80, "ab " * 500 + "y" * 1000 + " z" * 200]
    for chunk, overlap in ((50, 20), (64, 8), (200, 100), (32_768, 512)):
        counter = token_counts.TokenCounter(path, chunk, overlap)
        for t in TRICKY + made:
            assert counter.counts(pa.array([t])) == [len(library.encode(t, add_special_tokens=False).ids)]
    counter = token_counts.TokenCounter(path)
    for _ in range(2):
        assert counter.counts(pa.array([None, "", *TRICKY])) == [0, 0, *[len(library.encode(t, add_special_tokens=False).ids) for t in TRICKY]]
    narrow = token_counts.TokenCounter(path, 64, 8)
    narrow.by_chunks("ab " * 500 + "y" * 1000 + " z" * 200)
    assert narrow.splices > 0 and narrow.widened > 0


def test_token_rows(odd, none):
    got = token_counts.token_counts(odd).collect()
    assert len(got) == 10 and [r["n_tokens"] for r in got if r["doc_id"] in (3, 4)] == [0, 0]
    assert all(r["over_limit"] == (r["doc_id"] == 7) for r in got)
    assert token_counts.token_counts(none).count() == 0


def test_shards(spark, odd, none, tmp_path):
    placed, slot_map = slots.assign_shards(odd, 3, slots=64, map_folder=str(tmp_path))
    rows = placed.collect()
    assert len(rows) == 10
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert slots.SlotMap.load(spark, str(tmp_path)).shard_of == slot_map.shard_of
    assert slots.SlotMap.load(spark, str(tmp_path), 0).shard_of == slots.SlotMap.even(3, 64).shard_of
    assert slots.assign_shards(none, 3)[0].count() == 0


def test_rebalancing_edits_the_map():
    sizes = {s: 100 + s % 7 for s in range(640)}
    before = slots.SlotMap.even(10, 640).rebalanced(sizes)
    grown = before.rebalanced(sizes, 11)
    assert grown.version == before.version + 1 and grown.shards == 11
    to_new = [s for s, _, b in grown.moved if b == 10]
    assert 50 <= len(to_new) and len(grown.moved) <= 1.3 * len(to_new)
    load = [sum(sizes[s] for s in range(640) if grown.shard_of[s] == k) for k in range(11)]
    assert max(load) - min(load) <= 110


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(1, "ONE two, three four five six seven"), (2, "too short"), (3, None), (4, "uno dos tres cuatro uno"), (4, "uno dos tres cuatro uno")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(odd, bench).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (7, 4), (7, 4)]
    blocks = decontaminate.contained_items(odd, bench, block_words=5)
    assert sorted((r["doc_id"], r["item_id"]) for r in blocks.collect()) == got
    marked = decontaminate.mark_contaminated(odd.withColumn("contaminated", F.lit("old")), bench, block_words=5)
    assert marked.filter("contaminated").count() == 4 and marked.count() == 10
    assert decontaminate.contained_items(none, bench).count() == 0
    assert decontaminate.contained_items(odd, bench.limit(0)).count() == 0
    assert decontaminate.mark_contaminated(odd, bench.limit(0)).filter("contaminated").count() == 0


def test_contained_items_are_found_at_every_size():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(n, " ".join(word() for _ in range(n))) for n in (5, 6, 7, 9, 12, 20, 33, 70, 150, 400, 1500)]
    index = decontaminate.BenchmarkIndex(items)
    texts = []
    for _, t in items:
        words = t.split()
        cut = words[: max(5, -(-len(words) * 9 // 10))]
        texts += [" ".join([word() for _ in range(rng.randrange(900))] + part + [word() for _ in range(700)]) for part in (words, cut)]
    got = {(t, i) for t, i, _, _ in index.contained(texts)}
    want = set()
    for t, text in enumerate(texts):
        own = decontaminate.shingle_set(decontaminate.plain_words(text), 5)
        for i, (_, item) in enumerate(items):
            s = decontaminate.shingle_set(decontaminate.plain_words(item), 5)
            if len(s & own) >= 0.8 * len(s):
                want.add((t, i))
    assert got == want and len(want) >= 20


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", "[\\INST] [\\\\/ROLE] <\\s>", "<", "[INST", "", None, " x ", "a\\"]
    rows = [(c, k, role, t, "x") for c in (1, None) for k, (role, t) in enumerate(zip(["user", "assistant", "system", None, "</s>", "user", "assistant", "tool"], said))]
    rows += [(2, 0, "user", "tie", "x"), (2, 0, "assistant", "tie", "x"), (2, 0, "user", "tie", "x"), (2, None, "user", "first", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, loss string")
    turns = chat.format_turns(df.repartition(3))
    whole = {}
    for r in turns.collect():
        whole.setdefault(r["conv_id"], []).append(r)
    for c in (1, None):
        text = "".join(r["text"] for r in sorted(whole[c], key=lambda r: r["position"]))
        assert [t for _, t in chat.read_back(text)] == [t or "" for t in said]
        assert [r for r, _ in chat.read_back(text)][3:5] == ["", "</s>"]
        spans = [s for r in sorted(whole[c], key=lambda r: r["position"]) for s in r["loss"]]
        assert [chat.unescape(text[s["start"] : s["end"]]) for s in spans] == [said[1], said[6]]
    got = {r["conv_id"]: r for r in chat.digests(turns).collect()}
    assert got[2]["n_turns"] == 4 and got[2]["loss_chars"] == 3
    order = "user\nfirst\nassistant\ntie\nuser\ntie\nuser\ntie\n"
    assert got[2]["turns_sha256"] == hashlib.sha256(order.encode()).hexdigest()
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_pipeline(spark, odd, none, tmp_path):
    (bench := spark.createDataFrame([(1, "der die das und nicht aber noch eins")], "item_id long, text string")).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert bench.count() == 1
    kept = []
    for empty in (False, True):
        docs = none if empty else odd
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{empty}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{empty}{k}")
            kept.append(docs.count())
    # without letters: 4 rows; repeated: 2; near copies: none; contained item: 1; pieces of the long text.
    assert kept[:4] == [6, 4, 4, 3] and kept[4] > 15
    assert kept[5:] == [0] * 5


def simhash_brute(text):
    """Fingerprint by its definition."""
    import re

    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


PRIVATE = [
    ("the password=hunter2 was", "secret", "hunter2"),
    ("password: swordfish", "secret", "swordfish"),
    ("his PIN: 4711 is", "secret", "4711"),
    ("api_key = 'abcdEFGHijkl' or", "secret", "abcdEFGHijkl"),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"),
    ("contact: Anna Berg, please", "name", "Anna Berg"),
    ("ask Dr. John Smith today", "name", "Dr. John Smith"),
    ("she lives at 12 Old Mill Road now", "address", "12 Old Mill Road"),
]
PLAIN = ["forgot your password?", "name: none", "secret = x", "see version: 1.2.3 and page: 44", "the 3 Roads met", "drive on the road", "mr and mrs", "pin it = up", "chapter2000 tables", "Street and Road"]


def test_values_names_and_addresses_are_found(spark):
    """Candidates of contexts and gazetteers enter the same votes as those of forms; nine in ten planted ones are found."""
    texts = [t for t, _, _ in PRIVATE for _ in range(10)] + [t for t in PLAIN for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.summary(pii.find_spans(docs)[0]).collect()}
    caught = 0
    for i, text in enumerate(texts):
        spans = [(k, text[int(a) : int(b)]) for k, a, b in (x.split(":") for x in got[i]["spans"].split(",") if x)]
        if i < 10 * len(PRIVATE):
            caught += PRIVATE[i // 10][1:] in spans
        else:
            assert not spans, (text, spans)
    assert caught >= 0.9 * 10 * len(PRIVATE)


def test_near_stage_keeps_one_of_each_linked_group(spark):
    """Against all pairs of fingerprints, with copies from few to many changed words."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for k in range(120):
        words = [word() for _ in range(150)]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(150)] = word()
            texts.append(" ".join(words))
    texts += [texts[0].upper().replace(" ", "\n"), "", None, "short one", "Short  one", "short two"]
    prints = [simhash_brute(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i for i in range(len(texts)) if find(i) == i}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()} == want
    assert 100 < len(want) < len(texts) - 20


SENTENCES = [
    "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Всё смешалось в доме Облонских. Жена узнала, что муж был в связи с бывшею в их доме француженкою-гувернанткой, и объявила мужу, что не может жить с ним в одном доме. ",
    "天下大势，分久必合，合久必分。周末七国分争，并入于秦。及秦灭之后，楚、汉分争，又并入于汉。汉朝自高祖斩白蛇而起义，一统天下，后来光武中兴，传至献帝，遂分为三国。",
    "Litwo! Ojczyzno moja! ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą w całej ozdobie widzę i opisuję, bo tęsknię po tobie. Panno święta, co Jasnej bronisz Częstochowy i w Ostrej świecisz Bramie! ",
    "Mieleni minun tekevi, aivoni ajattelevi lähteäni laulamahan, saa'ani sanelemahan, sukuvirttä suoltamahan, lajivirttä laulamahan. Sanat suussani sulavat, puhe'et putoelevat, kielelleni kerkiävät, hampahilleni hajoovat. ",
    "It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness, it was the epoch of belief, it was the epoch of incredulity, it was the season of Light, it was the season of Darkness. ",
]


def test_language_stage_rejects_noise_and_keeps_every_language(spark):
    """Also languages without labels, of one of which all labels are taken away, and ordinary sentences repeated."""
    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))
    junk = ["".join(rng.choices(letters, k=900)) for letters in ("ABCDEFabcdefghijklmnopqrstuvwxyzXYZ0123456789+/", "asdfghjkl", "abcdefghijklmnopqrstuvwxyz    ")]
    clean = ["This.", "The.", "Von. Der und die.", "Que la.", "Thing."]
    clean += [(t * 12)[:n] for t in SENTENCES for n in (100, 250, 600, 2000)] + [SENTENCES[4][:60] * 6]
    added = [(10**6 + i, t, None) for i, t in enumerate(junk + clean)]
    out = corpus_pipeline.language(spark, docs.union(spark.createDataFrame(added, docs.schema)), "")
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert not kept & {10**6 + i for i in range(3)}
    assert {10**6 + i for i in range(3, 3 + len(clean))} <= kept
    letters = {r["doc_id"] for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))}
    assert letters == {i for i in kept if i < 10**6}


def test_structure_of_neighbours_tells_noise_from_any_text():
    rng = random.Random(5)
    for text in SENTENCES:
        assert langid.neighbour_structure((text * 3)[:700]) > 2 * langid.STRUCTURED
    for letters in ("abcdefghijklmnopqrstuvwxyz", "asdfghjkl ", "ABCDEFabcdef0123456789+/ghijkl"):
        for n in (900, 2000, 20_000):
            assert langid.neighbour_structure("".join(rng.choices(letters, k=n))) < langid.STRUCTURED
    assert langid.neighbour_structure("too short to tell") == float("inf")


def test_language_stage_without_labels(spark, odd):
    out = corpus_pipeline.language(spark, odd.withColumn("lang", F.lit(None).cast("string")), "")
    assert out.columns == odd.columns and out.count() == 6
