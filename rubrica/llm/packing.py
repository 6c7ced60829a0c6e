"""Best-fit packing by large-item matching.

Two pieces longer than a third of a sequence leave no room for a third one, so at most two
share a sequence: they are matched greedily, longest first, each with the longest that fits
beside it.  Shorter pieces then go, longest first, to the smallest remaining gap that holds
them.  Pieces of one length are alike, so the plan is made on counts per length (at most as
many as a sequence has tokens), in ranges of sequences that look the same; its size does
not grow with the corpus.  Pieces find their place by their number within their length.

Tokens: the library's ids of every whitespace-bounded word, which this tokenizer never
joins with its neighbours, so each distinct word is encoded once per worker.

Defined cases: null text is empty (one piece: the end token); empty table, empty result;
repeated rows are packed once each; a null id is kept; extra columns are left out.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.ranks import numbered, offsets
from rubrica.llm.shared import cut_lineage, slices
from rubrica.llm.units import distinct, spaced

CAPACITY = 4096
END_ID = 1
#: Words a worker remembers; beyond that it starts afresh. Memory only, no effect on results.
REMEMBERED = 600_000


def one_thread() -> None:
    """Spark runs a worker for each core; the library's own threads would only cost memory."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


_UNIT = re.compile(r"(?:[^\w\s]|[\d_])+[^\W\d_]*|[^\W\d_]+")


class WordEncoder:
    """Ids of texts as packed unsigned 32-bit numbers, equal to the library's for the whole text.

    The tokenizer drops white space, so words can be encoded one by one.  Within a word it
    always cuts between a letter and a following non-letter, so a word that is normalised
    already is looked up by such parts in lower case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        one_thread()
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.letters = Tokenizer.from_file(path)
        self.letters.no_truncation()
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    @staticmethod
    def packed(ids) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def _learn_parts(self, parts: list[str]) -> None:
        plain = [p for p in parts if p.isalpha()]
        if plain:
            coded = self.letters.encode(" ".join(plain), add_special_tokens=False)
            ids = self.packed(coded.ids)
            cuts = (np.flatnonzero(np.diff(np.array(coded.word_ids))) + 1) * 4
            bounds = [0, *cuts.tolist(), len(ids)]
            if len(bounds) != len(plain) + 1:
                raise ValueError("the tokenizer does not keep words apart")
            for p, a, b in zip(plain, bounds, bounds[1:]):
                self.parts[p] = ids[a:b]
        other = [p for p in parts if not p.isalpha()]
        for p, coded in zip(other, self.whole.encode_batch(other, add_special_tokens=False)):
            self.parts[p] = self.packed(coded.ids)

    def _hard(self, words: list[str]) -> list[bool]:
        """Which words the library has to see whole: not normalised, not printable, or with signs that lower case
        or special tokens treat in their own way.  All words are looked at together first."""
        text = "".join(words)
        if text.isprintable() and not any(x in text for x in ("Σ", "İ", "<|")):
            joined = "\n".join(words)
            if text.isascii() or unicodedata.is_normalized("NFC", joined.lower()):
                return [False] * len(words)
        out = []
        for w in words:
            odd = "Σ" in w or "İ" in w or "<|" in w or not w.isprintable()
            out.append(odd or not (w.isascii() or unicodedata.is_normalized("NFC", w.lower())))
        return out

    def _learn(self, words: list[str]) -> None:
        if len(self.words) + len(words) > REMEMBERED:
            self.words.clear()
            self.parts.clear()
        hard_ones = self._hard(words)
        hard = [w for w, odd in zip(words, hard_ones) if odd]
        easy = [w for w, odd in zip(words, hard_ones) if not odd] if hard else words
        lows = [w.lower() for w in easy]
        letters = list(map(str.isalpha, lows))
        cut = [None if plain else _UNIT.findall(low) for low, plain in zip(lows, letters)]
        new = {low for low, plain in zip(lows, letters) if plain}
        new.update(p for parts in cut if parts for p in parts)
        self._learn_parts([p for p in new if p not in self.parts])
        for w, low, parts in zip(easy, lows, cut):
            self.words[w] = self.parts[low] if parts is None else b"".join([self.parts[p] for p in parts])
        for w, coded in zip(hard, self.whole.encode_batch(hard, add_special_tokens=False)):
            self.words[w] = self.packed(coded.ids)

    def encode(self, texts: pa.Array) -> tuple[bytes, list[int]]:
        """Ids of all texts in a row, and where each text's begin and the last one's end, in bytes.

        Arrow makes the words of the texts distinct, so Python sees each once; the ids of all words
        are then gathered from those of the distinct ones."""
        data, bounds = spaced(texts)
        blank = (data == 32) | (data == 10)
        edge = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        numbers, own, own_bounds = distinct(data[~blank], np.r_[0, np.cumsum(end - start)])
        text = own.tobytes()
        cuts = own_bounds.tolist()
        words = [text[x:y].decode() for x, y in zip(cuts, cuts[1:])]
        found = list(map(self.words.get, words))
        missing = [w for w, v in zip(words, found) if v is None]
        if missing:
            self._learn(missing)
            found = [self.words[w] if v is None else v for w, v in zip(words, found)]
        sizes = np.array([len(v) // 4 for v in found], np.int64)
        flat = np.frombuffer(b"".join(found), "<u4")
        first = np.cumsum(sizes) - sizes
        n = sizes[numbers]
        at = np.cumsum(n) - n
        ids = flat[np.repeat(first[numbers] - at, n) + np.arange(n.sum())]
        reach = np.r_[0, np.cumsum(n)]
        return ids.tobytes(), (4 * reach[np.searchsorted(start, bounds)]).tolist()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    """Where this machine keeps a public vocabulary file; looked up on the executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document.

    ``tokenizer``: a public vocabulary's name or a path that executors can open.
    ``with_ids`` adds the ids themselves as ``ids`` (little-endian unsigned 32-bit).
    """
    end = WordEncoder.packed([END_ID])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer if "/" in tokenizer else tokenizer_path(tokenizer))
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[list] = [[], [], [], [], [], []]
                coded, at = words.encode(part.column(1))
                for doc_id, x, y in zip(part.column(0).to_pylist(), at, at[1:]):
                    ids = coded[x:y] + end
                    for k, place in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[place : place + 4 * capacity]
                        for column, value in zip(rows, (doc_id, k, place // 4, len(own) // 4, zlib.crc32(own), own)):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(rows[:n], kinds)], names=names[:n]
                )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Where the pieces of each length go, and the number of sequences.

    Rows (length, first, sequence, each, offset): from number ``first`` on, ``each`` pieces of
    that length go to one sequence after another, beginning with ``sequence`` at ``offset``.
    """
    left = {n: c for n, c in counts.items() if c}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    used: dict[int, int] = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # gaps in use, as a sorted list
    sequences = 0

    def place(length: int, count: int, first_sequence: int, each: int, offset: int) -> None:
        out.append((length, used[length], first_sequence, each, offset))
        used[length] += count
        left[length] -= count

    def keep(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                gaps[gap] = []
                order.insert(int(np.searchsorted(order, gap)), gap)
            gaps[gap].append((first, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        length = large[-1]
        count = left[length]
        if not count:
            large.pop()
            continue
        room = capacity - length
        partner = next((n for n in reversed(large) if n <= room and left[n]), None)
        if partner is None:
            n = count
            place(length, n, sequences, 1, 0)
            keep(room, sequences, n)
        elif partner == length:
            n = count // 2
            if n:
                place(length, 2 * n, sequences, 2, 0)
                keep(capacity - 2 * length, sequences, n)
            if count % 2:
                sequences += n
                n = 1
                smaller = next((m for m in reversed(large) if m < length and left[m]), None)
                place(length, 1, sequences, 1, 0)
                if smaller is not None:
                    place(smaller, 1, sequences, 1, length)
                keep(room - (smaller or 0), sequences, 1)
        else:
            n = min(count, left[partner])
            place(length, n, sequences, 1, 0)
            place(partner, n, sequences, 1, length)
            keep(room - partner, sequences, n)
        sequences += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = int(np.searchsorted(order, length))
            if at == len(order):
                each = capacity // length
                full, rest = divmod(left[length], each)
                if full:
                    place(length, full * each, sequences, each, 0)
                    keep(capacity - each * length, sequences, full)
                    sequences += full
                if rest:
                    place(length, rest, sequences, rest, 0)
                    keep(capacity - rest * length, sequences, 1)
                    sequences += 1
                continue
            gap = order[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = gap // length
            full, rest = divmod(min(left[length], each * n), each)
            if full:
                place(length, full * each, first, each, capacity - gap)
                keep(gap - each * length, first, full)
            if rest:
                place(length, rest, first + full, rest, capacity - gap)
                keep(gap - rest * length, first + full, 1)
            keep(gap, first + full + (rest > 0), n - full - (rest > 0))
    table = np.array(sorted(out), dtype=np.int64).reshape(-1, 5)
    return table, sequences


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` from 1 to ``capacity``."""
    spark = cut.sparkSession
    # Drawing splitters reads the pieces once more: they are written first, not encoded twice.
    rows, counts = numbered(cut_lineage(cut), "length", ["doc_id", "piece"])
    per_length: dict[int, int] = {}
    for _, length, n in counts:
        per_length[length] = per_length.get(length, 0) + n
    placing, _ = plan(per_length, capacity)
    earlier = sorted((p, k, n) for (p, k), n in offsets(counts).items())
    starts = np.array(earlier, dtype=np.int64).reshape(-1, 3)
    # Both tables are bounded: by sequence tokens, and by ranges plus sequence tokens.
    shared = spark.sparkContext.broadcast((placing, starts))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placing, starts = shared.value
        wide = 1 << 44
        by_length = placing[:, 0] * wide + placing[:, 1]
        by_part = starts[:, 0] * (capacity + 1) + starts[:, 1]
        for batch in batches:
            names = batch.schema.names
            if not batch.num_rows:
                continue
            get = {n: batch.column(names.index(n)).to_numpy(zero_copy_only=False) for n in ("length", "part", "place")}
            length = get["length"].astype(np.int64)
            base = starts[np.searchsorted(by_part, get["part"].astype(np.int64) * (capacity + 1) + length), 2]
            number = base + get["place"]
            row = placing[np.searchsorted(by_length, length * wide + number, side="right") - 1]
            within = number - row[:, 1]
            keep = [i for i, n in enumerate(names) if n not in ("part", "place")]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in keep),
                    pa.array(row[:, 2] + within // row[:, 3]),
                    pa.array(row[:, 4] + within % row[:, 3] * length),
                ],
                names=[*(names[i] for i in keep), "sequence_id", "offset"],
            )

    fields = [f for f in rows.schema.fields if f.name not in ("part", "place")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(assign, f"{schema}, sequence_id long, offset long")
