"""Texts cut where tokenizers always cut: at a single blank between two characters that are no white space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _marks(*values: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


#: Ends of white space beyond ASCII, by the bytes before the last one; too many here only make units longer.
_MIDDLE = _marks(0x80, 0x81, 0x9A)
_WIDE = _marks(0xE1, 0xE2, 0xE3)


def _solid_before(data: np.ndarray) -> np.ndarray:
    """For each place whether the byte before it surely ends a character that is no white space."""
    padded = np.r_[np.full(3, 32, np.uint8), data]
    last, middle, first = padded[2:-1], padded[1:-2], padded[:-3]
    odd = (last >= 128) & ((middle == 0xC2) | (_MIDDLE[middle] & _WIDE[first]))
    return (last > 32) & ~odd


def _solid_after(data: np.ndarray) -> np.ndarray:
    """For each place whether the byte after it surely begins a character that is no white space."""
    padded = np.r_[data, np.full(2, 32, np.uint8)]
    first, middle = padded[1:-1], padded[2:]
    odd = ((first == 0xC2) & ((middle == 0x85) | (middle == 0xA0))) | (_WIDE[first] & _MIDDLE[middle])
    return (first > 32) & ~odd


def spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a blank and the text, for all texts in a row, and where each begins and the last ends; null is empty."""
    nothing, blank = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    joined = pc.binary_join_element_wise(nothing, pc.fill_null(texts.cast(pa.large_string()), nothing), blank).cast(pa.large_binary())
    if not len(joined):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def unit_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places where units begin: each text's first byte, and the blanks where a tokenizer always cuts.
    Texts without a byte begin none."""
    cut = (data == 32) & _solid_before(data) & _solid_after(data)
    some = np.diff(bounds) > 0
    cut[bounds[1:][some] - 1] = False
    cut[bounds[:-1][some]] = True
    return np.flatnonzero(cut)


def plain_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins and the last ends; null is empty."""
    whole = pc.fill_null(texts.cast(pa.large_string()), pa.scalar("", pa.large_string())).cast(pa.large_binary())
    if not len(whole):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def binary_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)])


def distinct(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the distinct piece of each piece data[bounds[i]:bounds[i+1]], and the distinct pieces as bytes and bounds."""
    coded = binary_array(data, bounds).dictionary_encode()
    numbers, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    if not len(words):
        return numbers.astype(np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    own = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return numbers, np.frombuffer(words.buffers()[2] or b"", np.uint8)[own[0] : own[-1]], own - own[0]


def joinable(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which units a tokenizer reads alike when others stand right before and after them."""
    first = bounds[:-1]
    after = _solid_after(data)[first] & (np.diff(bounds) > 1)
    end = _solid_before(np.r_[data, np.uint8(32)])[bounds[1:]]
    return after & end
