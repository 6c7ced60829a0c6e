"""SimHash near-duplicates with BK-trees.

Fingerprints within ``radius`` bits agree on at least m - radius of m blocks, so every
fingerprint goes to one shard for each choice of m - radius blocks, and linked ones meet in a
shard.  A shard holds a BK-tree: a child hangs under its parent by their Hamming distance, and
a search follows only edges within the radius of the distance to the node.  m grows with the
number of fingerprints, so shards stay small; a shard that is still large is dealt again by the blocks of its other bits.

Shard trees are built where their shard is, not broadcast: the trees of all shards together
are as large as the corpus, and a broadcast would carry all fingerprints through the driver.

Defined cases: null or empty text has no words and fingerprint zero; fewer words than a
shingle give one shingle of them all; equal fingerprints are always linked; a null id never
is the smallest unless all are null; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.llm.components import components
from rubrica.llm.shared import cut_lineage, slices

SHINGLE = 4
RADIUS = 4
#: Fingerprints that a shard holds on average, at most.
SHARD = 4
#: A shard beyond this is dealt again by its other bits.
LARGE = 2_000
SEED = 42

#: Characters whose words are hashed together; bounds memory only.
BLOCK = 1 << 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_by_block(text: str, block: int = BLOCK) -> Iterator[list[str]]:
    """Words of a text, from about ``block`` characters at a time."""
    at = 0
    while at < len(text):
        end = _BLANK.search(text, at + block)
        cut = end.start() if end else len(text)
        yield _WORD.findall(text, at, cut)
        at = cut


def fingerprint(text: str, shingle: int = SHINGLE, block: int = BLOCK) -> int:
    """SimHash of a text's word shingles, repeats included: a bit is set if over half have it."""
    import xxhash

    if text.isascii():
        text = text.lower()
    elif not text.islower():
        text = text.translate(_LOWER)
    digest = xxhash.xxh64_digest
    ones, total = np.zeros(64, np.int64), 0
    kept: list[str] = []

    def count(parts) -> int:
        nonlocal ones
        hashes = np.frombuffer(b"".join([digest(p, SEED) for p in parts]), dtype=np.uint8).reshape(-1, 8)
        ones += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
        return len(hashes)

    for words in words_by_block(text, block):
        words = kept + words
        total += count(map(" ".join, zip(*[words[k:] for k in range(shingle)])))
        kept = words[-(shingle - 1) :] if shingle > 1 else []
    if not total:
        if not kept:
            return 0
        total = count([" ".join(kept)])
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest of the text, and the fingerprint of every whole text as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                marks = [fingerprint(t or "", shingle) for t in part.column(1).to_pylist()]
                signed = np.array(marks, dtype=np.uint64).view(np.int64)
                columns = [part.column(0), part.column(2), pa.array(signed)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "fp"])

    text = F.col(text_col).cast("string")
    digest = F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), digest.alias("digest"))
    return rows.mapInArrow(run, "doc_id long, digest binary, fp long")


class BKTree:
    """Numbers by Hamming distance; numbers that were taken out are passed over."""

    def __init__(self, marks: list[int]):
        self.marks: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []
        self.place: dict[int, int] = {}
        for mark in marks:
            self._add(mark)
        #: Numbers still in the tree at or below each node.
        self.live = [1] * len(self.marks)
        for at in range(len(self.marks) - 1, 0, -1):
            self.live[self.parent[at]] += self.live[at]
        self.here = [True] * len(self.marks)

    def _add(self, mark: int) -> None:
        marks, children = self.marks, self.children
        at = -1
        if marks:
            below: int | None = 0
            while below is not None:
                at = below
                d = (mark ^ marks[at]).bit_count()
                if d == 0:
                    return
                below = children[at].get(d)
            children[at][d] = len(marks)
        self.place[mark] = len(marks)
        marks.append(mark)
        children.append({})
        self.parent.append(at)

    def within(self, mark: int, radius: int) -> list[int]:
        found, stack = [], [0] if self.marks else []
        marks, children, live = self.marks, self.children, self.live
        while stack:
            at = stack.pop()
            if not live[at]:
                continue
            d = (mark ^ marks[at]).bit_count()
            if d <= radius and self.here[at]:
                found.append(marks[at])
            for edge, below in children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(below)
        return found

    def take(self, mark: int) -> None:
        at = self.place[mark]
        self.here[at] = False
        while at >= 0:
            self.live[at] -= 1
            at = self.parent[at]


def shard_links(marks: list[int], radius: int) -> list[tuple[int, int]]:
    """A star of links for each group of a shard, found by search from member to member.

    Found members leave the tree, so a dense group does not cost all its pairs.
    """
    tree = BKTree(marks)
    links = []
    for seed in tree.marks:
        if not tree.here[tree.place[seed]]:
            continue
        tree.take(seed)
        todo = [seed]
        while todo:
            for other in tree.within(todo.pop(), radius):
                tree.take(other)
                links.append((other, seed))
                todo.append(other)
    return links


def blocks(width: int, m: int) -> list[tuple[int, int]]:
    """Offset and width of m near-equal blocks."""
    cuts = [width * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def choose_blocks(count: int, radius: int = RADIUS, shard: int = SHARD) -> int:
    """Fewest blocks for which random fingerprints give shards of at most ``shard`` on average."""
    m = radius + 1
    while m < 64 and comb(m + 1, radius) <= 1000 and count > shard << (64 // m * (m - radius)):
        m += 1
    return m


def _keys(m: int, radius: int, bits: str = "fp", width: int = 64) -> Column:
    """One key for each choice of m - radius blocks: its number, and the chosen bits."""
    parts = blocks(width, m)
    out = []
    for number, chosen in enumerate(combinations(range(m), m - radius)):
        mask = 0
        for k in chosen:
            mask |= ((1 << parts[k][1]) - 1) << parts[k][0]
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(number).alias("choice"), F.col(bits).bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*out)


def _search(radius: int):
    """Links within each shard of rows sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = None

        def links_of(marks: np.ndarray) -> list[tuple[int, int]]:
            return shard_links(marks.view(np.uint64).tolist(), radius) if len(marks) > 1 else []

        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            shard = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)]
            marks = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            change = np.zeros(n - 1, dtype=bool)
            for c in shard:
                change |= c[1:] != c[:-1]
            starts = np.r_[0, np.flatnonzero(change) + 1]
            ends = np.r_[starts[1:], n]
            first = tuple(c[0] for c in shard)
            links: list[tuple[int, int]] = []
            if key is not None and first != key and held:
                links += links_of(np.concatenate(held))
                held = []
            if len(starts) > 1:
                links += links_of(np.concatenate([*held, marks[: ends[0]]]))
                held = []
                several = np.flatnonzero(ends[1:-1] - starts[1:-1] > 1) + 1
                for a, b in zip(starts[several], ends[several]):
                    links += links_of(marks[a:b])
            held.append(marks[starts[-1] :])
            key = tuple(c[-1] for c in shard)
            yield out(links)
        if held:
            yield out(links_of(np.concatenate(held)))

    return run


def fingerprint_links(marks: DataFrame, count: int, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """Links (a, b) that join all groups among the distinct fingerprints ``fp`` of ``marks``."""
    m = choose_blocks(count, radius)
    dealt = marks.select(F.explode(_keys(m, radius)).alias("k"), "fp").select("k.choice", "k.bits", "fp")
    # Shards that are still large: few, as shards hold a few fingerprints on average.
    sizes = dealt.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n"))
    big = cut_lineage(sizes.filter(F.col("n") > large).select("choice", "bits"))
    schema = "a long, b long"
    usual = dealt
    found = None
    if big.take(1):
        usual = dealt.join(big, ["choice", "bits"], "left_anti")
        hot = dealt.join(big, ["choice", "bits"], "left_semi")
        # The chosen bits agree, so the others differ in at most ``radius``: deal by their blocks.
        again = hot.select("choice", "bits", F.explode(_rest_keys(m, radius)).alias("k"), "fp").select(
            "choice", "bits", F.col("k.choice").alias("choice2"), F.col("k.bits").alias("bits2"), "fp"
        )
        keys = ["choice", "bits", "choice2", "bits2"]
        found = again.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_search(radius), schema)
    keys = ["choice", "bits"]
    links = usual.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_search(radius), schema)
    return (links.union(found) if found is not None else links).distinct()


def _rest_keys(m: int, radius: int) -> Column:
    """Second keys: for each first choice, one block of each of radius + 1 groups of the bits it left out."""
    parts = blocks(64, m)
    cases = None
    for number, chosen in enumerate(combinations(range(m), m - radius)):
        rest = [a + i for k, (a, n) in enumerate(parts) if k not in chosen for i in range(n)]
        out = []
        for number2, (a, n) in enumerate(blocks(len(rest), radius + 1)):
            mask = sum(1 << bit for bit in rest[a : a + n])
            signed = mask - (1 << 64) if mask >> 63 else mask
            out.append(F.struct(F.lit(number2).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bits")))
        when = F.col("choice") == number
        cases = F.when(when, F.array(*out)) if cases is None else cases.when(when, F.array(*out))
    return cases


def near_groups(
    docs: DataFrame,
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    large: int = LARGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, digest, fp (signed), component_id (smallest id of the group), kept of every document.

    ``kept`` marks the row with the smallest id of each group; of rows with that id, the one
    with the smallest digest of its text, and all that also have an equal text.
    """
    marked = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min(row).alias("least")))
    links = fingerprint_links(distinct.select("fp"), distinct.count(), radius, large)
    roots = components(links)
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = grouped.groupBy("root").agg(F.min("least").alias("first"))
    named = cut_lineage(grouped.join(smallest, "root").select("fp", "first"))
    return marked.join(named, "fp", "left").select(
        "doc_id", "digest", "fp", F.col("first.doc_id").alias("component_id"), row.eqNullSafe(F.col("first")).alias("kept")
    )


def hex_fingerprint(name: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(name)), 16, "0"))
