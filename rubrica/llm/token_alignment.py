"""Alignment of two tokenizers' tokens by interval coalescing, with corpus-wide counts of linked ids.

Both tokenizers cut the same bytes (a blank and the text) into intervals.  All intervals of
both are sorted by start; with the running maximum of their ends, a group begins wherever a
start reaches the maximum of all before.  Within a group the A and B tokens that overlap are
linked.

Neither tokenizer has a token across a single blank between two solid characters, so a text is
cut there into units, and a block of texts (``BLOCK`` bytes; a longer text is a block of its own)
aligns each distinct unit once.  A block keeps its texts as numbers of units, and its distinct
linked id pairs with their counts.  These pre-aggregated pairs are summed over the corpus by
Spark, joined back to the blocks that hold them, and a block's texts add up their units' figures.
The highest count of each B id is a table no longer than B's vocabulary, and is broadcast.

Defined cases: a text that is null, empty, or not given back byte for byte by the tokens of
either tokenizer has no tokens, zeros and an empty digest; an empty table gives an empty
result; repeated rows count one by one; a null id is kept; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.functions.stored import stored_columns
from rubrica.llm.packing import one_thread, tokenizer_path
from rubrica.llm.shared import slices
from rubrica.llm.units import distinct, joinable, spaced, unit_starts

BLOCK = 8 << 20
#: Bytes of units that are encoded together, and units that are aligned together; both bound memory only.
TOGETHER = 1 << 16
ALIGNED = 1 << 15

_KEPT = "doc_id long, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, links binary, pairs array<struct<pair: long, n: long>>"
_DONE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library; special strings in texts are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        one_thread()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        alphabet = byte_alphabet()
        size = self.library.get_vocab_size(with_added_tokens=True)
        pieces = [self.library.id_to_token(i) or "" for i in range(size)]
        self.tokens = [bytes(alphabet[c] for c in p) if all(c in alphabet for c in p) else p.encode() for p in pieces]
        self.cuts = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with the blank."""
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A model of the sentencepiece library, which adds the blank itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        self.tokens = [
            bytes([int(p[3:-1], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        #: Whether no piece goes on after a solid character with a blank, so that texts may be cut there.
        self.cuts = not any(" " in t.decode(errors="replace").lstrip(" ") for t in self.tokens)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode([t[1:] for t in texts], num_threads=1)


class Side:
    """One tokenizer with its tokens' bytes in a row."""

    def __init__(self, path: str):
        self.vocabulary = Pieces(path) if path.endswith(".model") else ByteLevel(path)
        lengths = [len(t) for t in self.vocabulary.tokens]
        self.lengths = np.array(lengths, np.int64)
        self.at = np.r_[0, np.cumsum(lengths)].astype(np.int64)
        self.bytes = np.frombuffer(b"".join(self.vocabulary.tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of tokens in a row."""
        n = self.lengths[ids]
        first = np.repeat(self.at[ids] - np.r_[0, np.cumsum(n)[:-1]], n)
        return self.bytes[first + np.arange(n.sum())]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units in a row, bounds of each unit's ids, and which units the tokens give back."""
        size = np.diff(bounds)
        good = np.ones(len(size), bool)
        coded: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # units, ids of each, the ids
        together = joinable(data, bounds) if self.vocabulary.cuts else np.zeros(len(size), bool)
        alone = np.flatnonzero(~together).tolist()
        some, row = np.flatnonzero(together), data[np.repeat(together, size)]
        ends = np.cumsum(size[some])
        cuts = np.unique(np.searchsorted(ends, np.arange(TOGETHER, len(row), TOGETHER)))
        parts = [p for p in np.split(some, cuts) if len(p)]
        stops = np.cumsum([size[p].sum() for p in parts], dtype=np.int64)
        for part, stop in zip(parts, stops.tolist()):
            text = row[stop - size[part].sum() : stop]
            ids = np.array(self.vocabulary.encode([text.tobytes().decode()])[0], np.int64)
            token_ends, unit_ends = np.cumsum(self.lengths[ids]), np.cumsum(size[part])
            last = np.searchsorted(token_ends, unit_ends)
            same = len(token_ends) and token_ends[-1] == len(text) and (token_ends[last] == unit_ends).all()
            if same and (self.joined(ids) == text).all():
                coded.append((part, np.diff(np.r_[-1, last]), ids))
            else:
                alone += part.tolist()
        for x in range(0, len(alone), 4096):
            own = alone[x : x + 4096]
            units = [data[bounds[i] : bounds[i + 1]].tobytes() for i in own]
            for i, text, ids in zip(own, units, self.vocabulary.encode([u.decode() for u in units])):
                ids = np.array(ids, np.int64)
                good[i] = len(text) > 1 and self.joined(ids).tobytes() == text
                coded.append((np.array([i]), np.array([len(ids) * good[i]]), ids[: len(ids) * good[i]]))
        units, n, ids = (np.concatenate(x).astype(np.int64) for x in zip(*coded)) if coded else np.zeros((3, 0), np.int64)
        order = np.argsort(units, kind="stable")
        first = (np.cumsum(n) - n)[order]
        n = n[order]
        flat = ids[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        return flat, np.r_[0, np.cumsum(n)], good


def coalesced(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of each A and of each B interval."""
    start, end = np.r_[a_start, b_start], np.r_[a_end, b_end]
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group[: len(a_start)], group[len(a_start) :]


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all A and B intervals that overlap, in order of A; each side's intervals follow one another."""
    first = np.searchsorted(b_end, a_start, side="right")
    n = np.searchsorted(b_start, a_end, side="left") - first
    a = np.repeat(np.arange(len(a_start)), n)
    return a, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


@dataclass
class Units:
    """What is known of the distinct units of a block."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    #: Groups of each unit as text, and the links of all units in a row as A id * 2**32 + B id.
    groups: list[bytes]
    links: np.ndarray


def align_units(data: np.ndarray, bounds: np.ndarray, a: Side, b: Side) -> Units:
    """Tokens, groups and links of every unit, some at a time."""
    parts = []
    for x in range(0, max(1, len(bounds) - 1), ALIGNED):
        own = bounds[x : x + ALIGNED + 1]
        parts.append(_align_some(data[own[0] : own[-1]], own - own[0], a, b))
    joined = [np.concatenate([getattr(p, k) for p in parts]) for k in ("good", "n_a", "n_b", "n_groups", "n_links")]
    return Units(*joined, [g for p in parts for g in p.groups], np.concatenate([p.links for p in parts]))


def _align_some(data: np.ndarray, bounds: np.ndarray, a: Side, b: Side) -> Units:
    a_ids, a_at, a_good = a.encode(data, bounds)
    b_ids, b_at, b_good = b.encode(data, bounds)
    good = a_good & b_good
    keep_a, keep_b = np.repeat(good, np.diff(a_at)), np.repeat(good, np.diff(b_at))
    n_a, n_b = np.where(good, np.diff(a_at), 0), np.where(good, np.diff(b_at), 0)
    a_ids, b_ids = a_ids[keep_a], b_ids[keep_b]
    a_end, b_end = np.cumsum(a.lengths[a_ids]), np.cumsum(b.lengths[b_ids])
    a_start, b_start = a_end - a.lengths[a_ids], b_end - b.lengths[b_ids]
    a_group, b_group = coalesced(a_start, a_end, b_start, b_end)
    a_of, b_of = overlaps(a_start, a_end, b_start, b_end)
    units = len(bounds) - 1
    a_unit = np.repeat(np.arange(units), n_a)
    total = int(a_group[-1]) + 1 if len(a_group) else 0
    first_a = np.searchsorted(a_group, np.arange(total + 1))
    first_b = np.searchsorted(b_group, np.arange(total + 1))
    said_a, said_b = [str(i) for i in a_ids.tolist()], [str(i) for i in b_ids.tolist()]
    one = ((np.diff(first_a) == 1) & (np.diff(first_b) == 1)).tolist()
    fa, fb = first_a.tolist(), first_b.tolist()
    said = [
        f"{said_a[fa[g]]}|{said_b[fb[g]]}" if one[g] else f"{','.join(said_a[fa[g] : fa[g + 1]])}|{','.join(said_b[fb[g] : fb[g + 1]])}"
        for g in range(total)
    ]
    group_unit = a_unit[first_a[:-1]]
    n_groups = np.bincount(group_unit, minlength=units)
    ends = np.cumsum(n_groups).tolist()
    texts = [";".join(said[e - n : e]).encode() for e, n in zip(ends, n_groups.tolist())]
    return Units(good, n_a, n_b, n_groups, np.bincount(a_unit[a_of], minlength=units), texts, (a_ids[a_of] << 32) | b_ids[b_of])


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i+1]]."""
    total = np.r_[0, np.cumsum(values)]
    return total[at[1:]] - total[at[:-1]]


def _rows(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Numbers of each row as bytes (unsigned, 32 bits)."""
    flat = np.ascontiguousarray(values, "<u4")
    return pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())


def aligned_block(block: int, ids: pa.Array, texts: pa.Array, a: Side, b: Side) -> pa.RecordBatch:
    """Rows of the texts of a block, and one of its links and pairs."""
    data, bounds = spaced(texts)
    starts = unit_starts(data, bounds) if a.vocabulary.cuts and b.vocabulary.cuts else bounds[:-1]
    numbers, own, own_bounds = distinct(data, np.r_[starts, len(data)])
    at = np.searchsorted(starts, bounds)
    units = align_units(own, own_bounds, a, b)
    empty = np.diff(bounds) == 1
    doubtful = (_sums(~units.good[numbers], at) > 0) & ~empty
    if doubtful.any():
        # Units that are not given back: such a text is one unit, taken as a whole.
        whole = np.zeros(len(data), bool)
        for i in np.flatnonzero(doubtful).tolist():
            whole[bounds[i] + 1 : bounds[i + 1]] = True
        starts = starts[~whole[starts]]
        numbers, own, own_bounds = distinct(data, np.r_[starts, len(data)])
        at = np.searchsorted(starts, bounds)
        units = align_units(own, own_bounds, a, b)
    n = np.bincount(numbers, minlength=len(own_bounds) - 1)
    pairs, place = np.unique(units.links, return_inverse=True)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, place, np.repeat(n, units.n_links))
    listed = numbers.tolist()
    digests = []
    for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
        said = b";".join([units.groups[u] for u in listed[x:y]])
        digests.append(hashlib.sha256(said).hexdigest() if said else "")
    documents = len(ids)
    figures = [_sums(v[numbers], at) for v in (units.n_a, units.n_b, units.n_groups, units.n_links)]
    none = lambda k: pa.nulls(1, k)
    listed_pairs = pa.StructArray.from_arrays([pa.array(pairs, pa.int64()), pa.array(counts)], names=["pair", "n"])
    kind = pa.list_(listed_pairs.type)
    link_bytes = np.r_[np.array([len(units.n_links)]), units.n_links, place.reshape(-1)].astype("<u4").tobytes()
    columns = [
        pa.concat_arrays([ids.cast(pa.int64()), none(pa.int64())]),
        pa.array(np.full(documents + 1, block)),
        *(pa.concat_arrays([pa.array(f, pa.int64()), none(pa.int64())]) for f in figures),
        pa.concat_arrays([pa.array(digests, pa.string()), none(pa.string())]),
        pa.concat_arrays([_rows(numbers, at), none(pa.binary())]),
        pa.array([None] * documents + [link_bytes], pa.binary()),
        pa.concat_arrays([pa.nulls(documents, kind), pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), listed_pairs).cast(kind)]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "units", "links", "pairs"])


_SIDES: dict[str, Side] = {}


def side(name: str) -> Side:
    """A tokenizer by a public vocabulary's name or a path; kept by the worker."""
    if name not in _SIDES:
        _SIDES[name] = Side(name if "/" in name else tokenizer_path(name))
    return _SIDES[name]


def scored_block(rows: pa.Table, scores: pa.Table) -> pa.Table:
    """Add n_best and count_sum to the texts of one block."""
    held = rows.filter(rows["links"].is_valid())
    docs = rows.filter(rows["links"].is_null())
    packed = np.frombuffer(held["links"][0].as_py(), "<u4").astype(np.int64)
    n = packed[1 : 1 + packed[0]]
    place = packed[1 + packed[0] :]
    size = int(place.max()) + 1 if len(place) else 0
    counts, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    where = scores["place"].to_numpy()
    counts[where], best[where] = scores["total"].to_numpy(), scores["best"].to_numpy()
    at = np.r_[0, np.cumsum(n)]
    unit_sum, unit_best = _sums(counts[place], at), _sums(best[place], at)
    lists = docs["units"].to_pylist()
    flat = np.frombuffer(b"".join(lists), "<u4")
    doc_at = np.r_[0, np.cumsum([len(x) // 4 for x in lists])].astype(np.int64)
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array(_sums(unit_best[flat], doc_at), pa.int64()))
    out = out.append_column("count_sum", pa.array(_sums(unit_sum[flat], doc_at), pa.int64()))
    return out.append_column("groups_sha256", docs["groups_sha256"])


def aligned(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", block_bytes: int = BLOCK) -> DataFrame:
    """Blocks of texts with their units, links and pairs, written once to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                yield aligned_block(block, part.column(0), part.column(1), side(a), side(b))
                block += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored_columns(rows.mapInArrow(run, _KEPT))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, total of every linked id pair of the corpus."""
    pairs = blocks.filter(F.col("pairs").isNotNull()).select(F.explode("pairs").alias("p"))
    total = pairs.groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.n").alias("total"))
    return total.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "total")


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", block_bytes: int = BLOCK) -> DataFrame:
    """Tokens, groups, links and corpus-wide link figures of every document."""
    blocks = aligned(docs, a, b, block_bytes)
    totals = pair_counts(blocks)
    highest = totals.groupBy("b").agg(F.max("total").alias("most"))
    # One row for each id of B's vocabulary at most.
    rated = totals.join(F.broadcast(highest), "b").select("a", "b", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    held = blocks.filter(F.col("pairs").isNotNull()).select("block", F.posexplode("pairs").alias("place", "p"))
    held = held.select(
        "block", "place", F.shiftright("p.pair", 32).cast("int").alias("a"), F.col("p.pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b")
    )
    scores = held.join(rated, ["a", "b"]).select(F.col("block").alias("of"), "place", "total", "best")
    rows = blocks.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "units", "links")
    return rows.groupBy("block").cogroup(scores.groupBy("of")).applyInArrow(scored_block, _DONE)
