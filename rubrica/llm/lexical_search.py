"""Ranked lexical search by an Aho-Corasick scan of the documents, without an index of them.

The terms of all items, each guarded by a blank on both sides, make one automaton.  It is
broadcast, and reads every document's text (terms apart by blanks): its hits are the
occurrences of item terms, and each hit maps to the items that hold the term.  One scan gathers
what the weights need (documents, terms, and how many documents hold each item term), a second
one scores.  Every task keeps the best of each item; these meet in two steps, first within
hashed parts of the tasks, then for the item as a whole.

The items are a stated query set.  They are taken in blocks of at most ``BLOCK_TERMS`` terms (an
item with more is a block of its own), so an automaton is bounded, and each block scans
all documents.

Defined cases: null or empty text has no terms; a document without terms counts for nothing
and has no score; an item without terms has no results; repeated rows of either table stand for
themselves; a null document id comes after all others where scores are equal; an empty table gives an empty
result; extra columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubrica.llm.shared import cut_lineage, slices

TOP = 10
BLOCK_TERMS = 200_000
#: Scores that are held at once (documents x items); bounds memory only.
HELD = 2_000_000
#: Parts in which the tasks' best rows are ranked before they meet.
PARTS = 512

_DOCUMENTS, _TERMS = -1, -2
_NO_ID = np.iinfo(np.int64).max

#: Term bytes, A-Z lowered; everything else in ASCII is a blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """The text's terms with blanks between and around them, in UTF-8."""
    return b" " + (text or "").encode().translate(_PLAIN) + b" "


class ItemTerms:
    """Automaton of the distinct terms of a block of items, and the items of each term."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        import ahocorasick

        self.ids = [i for i, _ in items]
        own = [sorted(set(plain(t).split())) for _, t in items]
        self.terms = sorted({t for terms in own for t in terms})
        number = {t: k for k, t in enumerate(self.terms)}
        held: list[list[int]] = [[] for _ in self.terms]
        for i, terms in enumerate(own):
            for t in terms:
                held[number[t]].append(i)
        self.items = np.array([i for of in held for i in of], np.int64)
        self.at = np.r_[0, np.cumsum([len(of) for of in held])].astype(np.int64)
        self.automaton = ahocorasick.Automaton()
        for t, k in number.items():
            # One character a byte: texts are read in the same way.
            self.automaton.add_word(f" {t.decode('latin-1')} ", k)
        if number:
            self.automaton.make_automaton()

    def counts(self, text: str | None) -> tuple[int, dict[int, int]]:
        """Number of the text's terms, and occurrences of each item term."""
        row = plain(text)
        if not self.terms:
            return len(row.split()), {}
        return len(row.split()), Counter(map(itemgetter(1), self.automaton.iter(row.decode("latin-1"))))


def item_blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """Items in blocks of bounded size."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        n = len(set(plain(r["text"]).split()))
        if block and size + n > block_terms:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def statistics(docs: DataFrame, shared) -> dict[int, int]:
    """Documents that hold each item term by its number, those with any term, and terms in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        held = np.zeros(len(terms.terms), np.int64)
        documents = total = 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                n, found = terms.counts(text)
                documents += n > 0
                total += n
                if found:
                    held[np.fromiter(found, np.int64, len(found))] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[some, _DOCUMENTS, _TERMS]), pa.array(np.r_[held[some], documents, total])], names=["term", "n"]
        )

    counted = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # One row for each term of the block and two more.
    return {r["term"]: r["n"] for r in counted.collect()}


def weight(documents: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1)))


class Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.item, self.doc, self.score, self.none = (np.zeros(0, k) for k in (np.int64, np.int64, np.int64, bool))
        self.least = np.zeros(items, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray, none: np.ndarray) -> None:
        """Take scores (documents, items)."""
        row, item = np.nonzero((scores > 0) & (scores >= self.least))
        if not len(row):
            return
        item, doc = np.r_[self.item, item], np.r_[self.doc, docs[row]]
        score, none = np.r_[self.score, scores[row, item[len(self.item) :]]], np.r_[self.none, none[row]]
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[place < self.top]
        last = place == self.top - 1
        self.least[item[last]] = score[order][last]
        self.item, self.doc, self.score, self.none = item[place < self.top], doc[kept], score[kept], none[kept]


def scores(terms: ItemTerms, weights: np.ndarray, documents: int, total: int, texts: list) -> np.ndarray:
    """Scores (texts, items)."""
    n_items = len(terms.ids)
    out = np.zeros(len(texts) * n_items, np.int64)
    row, term, tf, m = [], [], [], []
    for d, text in enumerate(texts):
        n, found = terms.counts(text)
        if found:
            row += [d] * len(found)
            term += found.keys()
            tf += found.values()
            m += [10 + 90 * n * documents // total] * len(found)
    term, tf = np.array(term, np.int64), np.array(tf, np.int64)
    each = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.array(m, np.int64)))
    n = np.diff(terms.at)[term]
    place = np.repeat(terms.at[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    np.add.at(out, np.repeat(np.array(row, np.int64) * n_items, n) + terms.items[place], np.repeat(each, n))
    return out.reshape(len(texts), n_items)


def best_of_tasks(docs: DataFrame, shared, top: int) -> DataFrame:
    """item number, doc_id and score of the best documents of each item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, documents, total = shared.value
        best = Best(len(terms.ids), top)
        step = max(1, HELD // max(1, len(terms.ids)))
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids = part.column(0)
                none = ids.is_null().to_numpy(zero_copy_only=False)
                doc = ids.fill_null(_NO_ID).to_numpy()
                texts = part.column(1).to_pylist()
                for x in range(0, len(texts), step):
                    cut = slice(x, x + step)
                    best.add(scores(terms, weights, documents, total, texts[cut]), doc[cut], none[cut])
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array(best.doc, mask=best.none), pa.array(best.score)], names=["item", "doc_id", "score"]
        )

    return docs.mapInArrow(run, "item long, doc_id long, score long")


def ranked(rows: DataFrame, by: list, top: int) -> DataFrame:
    """The first rows of each group by score, then id (null last)."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, waiting = None, None
    for block in item_blocks(items, block_terms):
        if waiting is not None:
            out = _joined(out, cut_lineage(waiting))
        waiting = _search_block(spark, rows, block, top)
    if waiting is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return _joined(out, waiting)


def _joined(out: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if out is None else out.unionByName(more)


def _search_block(spark, rows: DataFrame, block: list, top: int) -> DataFrame:
    terms = ItemTerms(block)
    found = statistics(rows, spark.sparkContext.broadcast(terms))
    documents, total = found.get(_DOCUMENTS, 0), found.get(_TERMS, 0)
    weights = np.array([weight(documents, found.get(k, 0)) for k in range(len(terms.terms))], np.int64)
    shared = spark.sparkContext.broadcast((terms, weights, documents, total))
    each = best_of_tasks(rows, shared, top).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    last = ranked(ranked(each, ["item", "part"], top).drop("rank"), ["item"], top)
    # As many rows as items, held on the driver already.
    ids = spark.createDataFrame(list(enumerate(terms.ids)), "item long, item_id long")
    return last.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
