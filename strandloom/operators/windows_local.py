"""Windows, minimizers and twins of whole Arrow batches as numpy arrays: the same numbers as ``functions.dna`` gives a row at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from strandloom.functions import dna

#: Bases cut at a time; a dozen arrays of 8 bytes a base are held meanwhile.
STEP = 1 << 17
#: Buckets of junctions, see ``buckets``.
BUCKETS = 1 << 16

GROUPS = ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))
BASES = np.frombuffer(b"ACGT", np.uint8)
CODES = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    CODES[[ord(_c), ord(_c.lower())]] = _i


def twin(x: np.ndarray, k: int) -> np.ndarray:
    """Reverse complement of packed k-mers."""
    v = ~x.astype(np.uint64)
    for bits, m in GROUPS:
        n, m = np.uint64(bits), np.uint64(m)
        v = ((v >> n) & m) | ((v & m) << n)
    return (v >> np.uint64(64 - 2 * k)).astype(np.int64)


def rolled(codes: np.ndarray, k: int) -> np.ndarray:
    """The k-mer that begins at each place of an array of base codes, put together from windows of 1, 2, 4, 8 and 16 bases."""
    n = len(codes) - k + 1
    part, width, out, done = codes.astype(np.int64) & 3, 1, None, 0
    while True:
        if k & width:
            piece = part[done : done + n]
            out = piece if out is None else (out << (2 * width)) | piece
            done += width
        if done == k:
            return out
        part = (part[:-width] << (2 * width)) | part[width:]
        width *= 2


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; null is empty. Texts beyond ASCII are put in upper case first, as a letter may become others."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    if len(data) and (data[offsets[0] : offsets[-1]] > 127).any():
        raw = [s.upper().encode() for s in texts.to_pylist()]
        return np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8)
    return offsets, data


def _steps(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the step in the bytes, its base codes, places in it of all windows over ACGT that lie within one text)."""
    offsets, data = text_buffers(texts)
    if not len(offsets):
        return
    for at in range(int(offsets[0]), int(offsets[-1]) - k + 1, STEP):
        end = min(at + STEP + k - 1, int(offsets[-1]))
        codes = CODES[data[at:end]]
        bad = np.concatenate([[0], np.cumsum(codes > 3, dtype=np.int32)])
        starts = np.zeros(len(codes), np.int32)
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        starts[inside] = 1
        starts = np.cumsum(starts, dtype=np.int32)
        good = np.flatnonzero((bad[k:] == bad[:-k]) & (starts[k - 1 :] == starts[: len(codes) - k + 1]))
        if len(good):
            yield at, codes, good


def cut(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in the bytes, oriented k-mer) of all windows over ACGT that lie within one text, some at a time."""
    for at, codes, good in _steps(texts, k):
        yield good + at, rolled(codes, k)[good]


def minimizers(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the canonical minimizer of the k-mer that begins at each place; the same for its twin."""
    g = min(13, max(1, k // 2))
    x = rolled(codes, g)
    h, width, wanted = mixed(np.minimum(x, twin(x, g))), 1, k - g + 1
    while 2 * width <= wanted:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    rest = wanted - width
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def pieces(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(bucket, piece) of runs of windows with the same minimizer, some at a time: each window over ACGT lies in one piece, and a k-mer and its twin in one bucket."""
    for _, codes, good in _steps(texts, k):
        h = minimizers(codes, k)[good]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(good) != 1) | (h[1:] != h[:-1])]))
        size = np.diff(np.append(new, len(good))) + k - 1
        offsets = np.concatenate([[0], np.cumsum(size)])
        bases = BASES[codes[np.arange(offsets[-1]) + np.repeat(good[new] - offsets[:-1], size)]]
        yield (mixed(h[new]) >> np.uint64(48)).astype(np.int32), pa.LargeStringArray.from_buffers(len(new), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(bases)).cast(pa.string())


def canonical(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of ``texts``, canonical k-mer), some at a time."""
    offsets = text_buffers(texts)[0]
    for at, x in cut(texts, k):
        yield np.searchsorted(offsets, at, side="right") - 1, np.minimum(x, twin(x, k))


def mixed(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def buckets(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the first and of the last k-1 bases, by their canonical minimizer: neighbours in a path mostly share one, and so do twins."""
    g = min(13, max(1, (k - 1) // 2))
    t = twin(x, k)
    m = np.int64(dna.mask(g))
    first = last = None
    for i in range(k - g + 1):
        h = mixed(np.minimum((x >> (2 * (k - g - i))) & m, (t >> (2 * i)) & m))
        if i < k - g:
            first = h if first is None else np.minimum(first, h)
        if i > 0:
            last = h if last is None else np.minimum(last, h)
    return tuple((mixed(h) >> np.uint64(48)).astype(np.int32) for h in (first, last))


#: As ``dna.text_to_dna``: letters dealt in turn, all else N; a blank is dropped.
READ = np.full(256, ord("N"), np.uint8)
for _i in range(26):
    READ[[ord("a") + _i, ord("A") + _i]] = BASES[_i % 4]
BLANK = ord(" ")


def read_text(texts: pa.Array) -> pa.Array:
    """``dna.text_to_dna`` of a string array. Texts beyond ASCII are put in lower case first, as a letter may become others."""
    if len(texts) > 1 and texts.nbytes > 4 * STEP:
        half = len(texts) // 2
        return pa.concat_arrays([read_text(texts.slice(0, half)), read_text(texts.slice(half))])
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(offsets) else np.zeros(0, np.uint8)
    if (data > 127).any():
        raw = [s.lower().encode("ascii", "replace") for s in texts.to_pylist()]
        offsets, data = np.concatenate([[0], np.cumsum([len(r) for r in raw])]), np.frombuffer(b"".join(raw), np.uint8)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    kept = data != BLANK
    ends = offsets - np.searchsorted(np.flatnonzero(~kept), offsets)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(READ[data[kept]])).cast(pa.string())
