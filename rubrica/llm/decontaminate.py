"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents long, so the likeness of whole sets says little.  Items are
partitioned by their number of distinct word shingles, each partition up to twice the size of
the one before.  For a partition of sizes up to u, documents are read in windows of 2u shingles
that overlap by half: a passage of u shingles lies whole in one of them, and shares at least a
fifth of the union with an item of which four fifths are there.  Item and window are a
candidate pair when one of ``HASHES`` minimum hashes agrees (an item at the threshold is
missed with a chance of about one in a million), and every candidate is verified by the exact
shares of shingles, as words, in the whole document.

The benchmark is a stated query set: it is taken in blocks of at most ``BLOCK_WORDS`` words,
and each block goes over all documents once.

Defined cases: null or empty text has no shingles; an item with fewer words than a shingle has
none and is never found; repeated rows of either table are found one by one; a null id is
kept; an empty table gives an empty result (or nothing marked); other columns pass through
where rows are marked, and an older column of the mark's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.shared import slices
from rubrica.llm.wordhash import MIX, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
HASHES = 64
BLOCK_WORDS = 500_000

_OTHER = re.compile(r"\W+")
_ASCII = bytes(c | 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c == 95 or c >= 128 else 32 for c in range(256))


def plain_words(text: str | None) -> bytes:
    """Lower-cased words (letters, digits, underscore) with blanks between, in UTF-8."""
    low = (text or "").lower()
    if not low.isascii() and any(c > "\x7f" and not c.isalnum() for c in set(low)):
        return _OTHER.sub(" ", low).strip().encode()
    return low.encode().translate(_ASCII)


def shingle_hashes(plain: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle of all texts in a row, and the number of them in each text."""
    data = np.frombuffer(b" " + b" ".join(plain) + b" ", np.uint8)
    inside = data != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    text_end = np.cumsum([len(p) + 1 for p in plain])
    bounds = np.r_[0, np.searchsorted(start, text_end + 1)]
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.uint64), counts
    words = word_hashes(data, start, end)
    with np.errstate(over="ignore"):
        mixed = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            mixed *= MIX
            mixed ^= mixed >> np.uint64(32)
            mixed += words[k : len(words) - size + 1 + k]
    first = np.repeat(bounds[:-1] - np.r_[0, np.cumsum(counts)[:-1]], counts)
    return mixed[first + np.arange(counts.sum())], counts


def shingle_set(plain: bytes, size: int) -> set:
    words = plain.split()
    return set(zip(*[words[k:] for k in range(size)]))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


class BenchmarkIndex:
    """Minimum hashes of one block of test items, by size partition."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int = SHINGLE, hashes: int = HASHES):
        self.size = size
        self.a, self.b = _multipliers(hashes)
        self.ids = [i for i, _ in items]
        self.plain = [plain_words(t) for _, t in items]
        self.sets: dict[int, set] = {}
        found, counts = shingle_hashes(self.plain, size)
        ends = np.cumsum(counts)
        #: log2 of the partition's largest size -> (minimum hashes (hashes, items), item numbers)
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        members: dict[int, list[int]] = {}
        for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist())):
            if n:
                distinct = len(np.unique(found[end - n : end]))
                members.setdefault((distinct - 1).bit_length(), []).append(i)
        with np.errstate(over="ignore"):
            for level, numbers in members.items():
                minima = np.empty((hashes, len(numbers)), np.uint64)
                for j, i in enumerate(numbers):
                    own = found[ends[i] - counts[i] : ends[i]]
                    minima[:, j] = (own[None] * self.a[:, None] + self.b[:, None]).min(axis=1)
                self.parts[level] = (minima, np.array(numbers))
        self.lookup: dict[int, list] = {}
        for level, (minima, numbers) in self.parts.items():
            rows = []
            for row in minima:
                order = np.argsort(row)
                some = np.zeros(1 << 16, bool)
                some[(row >> np.uint64(48)).astype(np.int64)] = True
                rows.append((some, row[order], numbers[order]))
            self.lookup[level] = rows

    def item_set(self, i: int) -> set:
        if i not in self.sets:
            self.sets[i] = shingle_set(self.plain[i], self.size)
        return self.sets[i]

    def candidates(self, found: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """Pairs (text, item) of which a window and the item share a minimum hash."""
        pairs: set[tuple[int, int]] = set()
        if not len(found) or not self.parts:
            return pairs
        ends = np.cumsum(counts)
        deepest = max(self.parts)
        for k, (a, b) in enumerate(zip(self.a, self.b)):
            with np.errstate(over="ignore"):
                blocks = found * a + b
            for level in range(deepest + 1):
                if level:
                    if len(blocks) % 2:
                        blocks = np.r_[blocks, blocks[-1:]]
                    blocks = np.minimum(blocks[::2], blocks[1::2])
                if level not in self.parts:
                    continue
                windows = np.minimum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks
                some, minima, numbers = self.lookup[level][k]
                hit = np.flatnonzero(some[(windows >> np.uint64(48)).astype(np.int64)])
                if not len(hit):
                    continue
                value = windows[hit]
                low = np.searchsorted(minima, value)
                high = np.searchsorted(minima, value, side="right")
                for w, x, y in zip(hit[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                    first = int(np.searchsorted(ends, w << level, side="right"))
                    last = int(np.searchsorted(ends, min((w + 2) << level, len(found)) - 1, side="right"))
                    pairs.update((t, i) for t in range(first, last + 1) for i in numbers[x:y].tolist())
        return pairs

    def contained(self, texts: list, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int]]:
        """(text, item, shared shingles, item's shingles) of all items contained in the texts."""
        plain = [plain_words(t) for t in texts]
        out = []
        last, own = -1, set()
        for t, i in sorted(self.candidates(*shingle_hashes(plain, self.size))):
            if t != last:
                last, own = t, shingle_set(plain[t], self.size)
            item = self.item_set(i)
            shared = len(item & own)
            if shared and shared >= similarity * len(item):
                out.append((t, i, shared, len(item)))
        return out


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int | None, str | None]]]:
    """The benchmark's items in blocks of bounded size (a longer single item is a block of its own)."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        n = len(r["text"] or "") // 2 + 1
        if block and size + n > 2 * block_words:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Pairs doc_id, item_id, n_shared, n_item, containment of at least ``similarity``."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_shared long, n_item long, containment double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in item_blocks(benchmark, block_words):
        index = spark.sparkContext.broadcast(BenchmarkIndex(block, shingle))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                for part in slices(batch, "text", 2 << 20):
                    ids = part.column(0).to_pylist()
                    found = own.contained(part.column(1).to_pylist(), similarity)
                    columns = [
                        pa.array([ids[t] for t, _, _, _ in found], pa.int64()),
                        pa.array([own.ids[i] for _, i, _, _ in found], pa.int64()),
                        pa.array([s for _, _, s, _ in found], pa.int64()),
                        pa.array([n for _, _, _, n in found], pa.int64()),
                        pa.array([s / n for _, _, s, n in found], pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        columns, names=["doc_id", "item_id", "n_shared", "n_item", "containment"]
                    )

        pairs = rows.mapInArrow(run, schema)
        out = pairs if out is None else out.unionByName(pairs)
    return spark.createDataFrame([], schema) if out is None else out


def mark_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    block_words: int = BLOCK_WORDS,
    mark: str = "contaminated",
) -> DataFrame:
    """``docs`` with a boolean column that says whether an item is contained."""
    spark = docs.sparkSession
    marked = docs.drop(mark).withColumn(mark, F.lit(False))
    schema = marked.schema
    at = marked.columns.index("text")
    for block in item_blocks(benchmark, block_words):
        index = spark.sparkContext.broadcast(BenchmarkIndex(block, shingle))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                for part in slices(batch, "text", 2 << 20):
                    before = part.column(part.num_columns - 1).to_pylist()
                    for t, _, _, _ in own.contained(part.column(at).to_pylist(), similarity):
                        before[t] = True
                    columns = [*part.columns[:-1], pa.array(before, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

        marked = marked.mapInArrow(run, schema)
    return marked
