"""Token counts of whole documents, huge ones by overlapping chunks.

A document beyond ``CHUNK`` characters is encoded in chunks that overlap.  The pre-tokenizer
reads left to right without looking back, so two encodings that both begin a word at the same
place go on alike from there: the chunks are spliced at such a common word start, taken from
the part of the left chunk that its cut end cannot have changed.  Where an overlap has no
common start (one word longer than the overlap), chunk and overlap are doubled until there is one or
the text ends.

Shorter documents are cut at places where a word always starts: a single blank between two
solid characters.  Arrow makes the pieces of a slice of documents distinct, and the library encodes those that the
worker does not remember; what it has met lately it does.

Defined cases: null text is empty (no tokens); an empty table gives an empty result; repeated
rows are counted one by one; a null id is kept; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.packing import one_thread, tokenizer_path
from rubrica.llm.shared import slices
from rubrica.llm.units import distinct, plain_bytes, unit_starts

CHUNK = 32_768
OVERLAP = 512
LIMIT = 1024
#: Words a worker remembers, in two halves: when the younger is full it becomes the older, whose words are forgotten
#: unless they have been met since. Memory only, no effect on results.
REMEMBERED = 300_000
#: Words that are encoded together; an encoding takes a kilobyte and more.
TOGETHER = 2_000


class TokenCounter:
    """Counts tokens of a byte-level tokenizer as its library does for the whole text."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        if not 0 < overlap < chunk:
            raise ValueError("the overlap must be shorter than a chunk")
        one_thread()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder().values()
        self.special = max((len(t.content) for t in added), default=0)
        self.breakable = not any(" " in t.content or t.lstrip or t.rstrip or t.single_word for t in added)
        self.chunk, self.overlap = chunk, overlap
        self.words: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.splices = self.widened = 0

    def _word_starts(self, text: str, a: int, b: int) -> dict[int, int]:
        """Places where words of text[a:b] start, with the tokens before each; its end is the last.

        An added token counts as a word of its own.
        """
        coded = self.library.encode(text[a:b], add_special_tokens=False)
        out: dict[int, int] = {}
        last: object = ()
        for n, (word, (at, _)) in enumerate(zip(coded.word_ids, coded.offsets)):
            if word is None or word != last:
                out.setdefault(a + at, n)
            last = () if word is None else word
        out[min(b, len(text))] = len(coded.ids)
        return out

    def by_chunks(self, text: str) -> int:
        """Tokens of a text of any length; holds two neighbouring chunks at a time."""
        total, start, end, overlap = 0, 0, self.chunk, self.overlap
        left = self._word_starts(text, start, end)
        while end < len(text):
            right_at = max(start + 1, end - overlap)
            right = self._word_starts(text, right_at, right_at + self.chunk)
            # All starts but the end itself are sure, save where an added token is cut in two.
            sure = min(end - 1, end - self.special - 1)
            common = [p for p in left if right_at < p <= sure and p in right]
            if common and right_at + self.chunk > end:
                place = max(common)
                total += left[place]
                left = {p: n - right[place] for p, n in right.items() if p >= place}
                start, end, overlap = place, right_at + self.chunk, self.overlap
                self.splices += 1
            else:
                self.widened += 1
                end, overlap = start + 2 * (end - start), 2 * overlap
                left = self._word_starts(text, start, end)
        return total + left[len(text)]

    def _recall(self, word: bytes) -> int | None:
        n = self.words.get(word)
        if n is None:
            n = self.older.get(word)
            if n is not None:
                self.words[word] = n
        return n

    def _count_words(self, texts: pa.Array) -> np.ndarray:
        """Tokens of texts that may be cut."""
        data, bounds = plain_bytes(texts)
        starts = unit_starts(data, bounds)
        if not len(starts):
            return np.zeros(len(texts), np.int64)
        numbers, own, own_bounds = distinct(data, np.r_[starts, len(data)])
        whole, cuts = own.tobytes(), own_bounds.tolist()
        words = [whole[a:b] for a, b in zip(cuts, cuts[1:])]
        found = list(map(self._recall, words))
        missing = [i for i, n in enumerate(found) if n is None]
        for a in range(0, len(missing), TOGETHER):
            some = missing[a : a + TOGETHER]
            coded = self.library.encode_batch_fast([words[i].decode() for i in some], add_special_tokens=False)
            for i, x in zip(some, coded):
                self.words[words[i]] = found[i] = len(x)
        if len(self.words) > REMEMBERED // 2:
            self.words, self.older = {}, self.words
        total = np.r_[0, np.cumsum(np.array(found, np.int64)[numbers])]
        at = np.searchsorted(starts, bounds)
        return total[at[1:]] - total[at[:-1]]

    def counts(self, texts: pa.Array) -> list[int]:
        size = pc.utf8_length(pc.fill_null(texts, "")).to_numpy(zero_copy_only=False)
        short = (size <= self.chunk) & self.breakable
        out = np.zeros(len(texts), np.int64)
        out[short] = self._count_words(texts.filter(pa.array(short)))
        for i in np.flatnonzero(~short).tolist():
            out[i] = self.by_chunks(texts[i].as_py() or "")
        return out.tolist()


_COUNTERS: dict[tuple, TokenCounter] = {}


def token_counts(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = LIMIT,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every document.

    ``tokenizer``: a public vocabulary's name or a path that executors can open; it must be a
    byte-level one whose words start at a single blank between non-blanks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, chunk, overlap)
        if key not in _COUNTERS:
            path = tokenizer if "/" in tokenizer else tokenizer_path(tokenizer)
            _COUNTERS[key] = TokenCounter(path, chunk, overlap)
        counter = _COUNTERS[key]
        for batch in batches:
            for part in slices(batch, "text"):
                n = counter.counts(part.column(2))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("text").cast("string").alias("text"),
    )
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
