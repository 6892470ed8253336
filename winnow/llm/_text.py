"""Vectorised text handling inside Arrow tasks: bounded slices, words, dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
#: Bytes A-Z to a-z, all others as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cased ASCII letters, digits and bytes past ASCII stay; the rest becomes a space.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain(texts: pa.Array) -> pa.StringArray:
    """Null as empty, in one chunk from offset 0 with 32-bit offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.string()), "")
    return pa.concat_arrays([texts]) if texts.offset == 0 else pa.array(texts.to_pylist(), pa.string())


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.StringArray]:
    """Runs of whole texts of about ``most`` bytes; a longer text comes alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // most if len(sizes) else sizes
    edges = np.flatnonzero(np.diff(group, prepend=-1)).tolist() + [len(sizes)]
    for a, b in zip(edges, edges[1:]):
        yield plain(texts.slice(a, b - a))
    pa.default_memory_pool().release_unused()  # a worker lives on after its task


def offsets_of(texts: pa.StringArray) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)


def data_of(texts: pa.StringArray) -> bytes:
    """The UTF-8 bytes of all texts, one after the other."""
    off = offsets_of(texts)
    buf = texts.buffers()[2]
    return b"" if buf is None else buf.to_pybytes()[off[0] : off[-1]]


def translated(texts: pa.StringArray, tab: bytes) -> pa.StringArray:
    """Texts with their bytes mapped by ``tab`` (ASCII to ASCII)."""
    off = (offsets_of(texts) - offsets_of(texts)[0]).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(off), pa.py_buffer(data_of(texts).translate(tab)))


def words_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """All words (split at space and \\x09-\\x0D), and the start of each text's words, with the end of the last."""
    split = pc.ascii_split_whitespace(texts)
    flat, off = split.flatten(), np.asarray(split.offsets).astype(np.int64)
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        off = np.concatenate([[0], np.cumsum(full)])[off]
        flat = flat.filter(pa.array(full))
    return flat, off


def encoded(words: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Distinct words, and each word's place among them."""
    if len(words) == 0:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    d = pc.dictionary_encode(words)
    return d.dictionary, np.asarray(d.indices).astype(np.int64)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The sum of each run of ``values``; an empty run has 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]
