"""Telephony audio: companded and ADPCM samples in WAV containers, decoded by table and by block.

Mu-law and A-law bytes expand through tables made from their rule. IMA ADPCM blocks are coded and decoded
with numpy across blocks: step i of the blocks of many files at once. Decoded sound can be stored as resampled
16-bit PCM. A stored mu-law or A-law file keeps its bytes exactly, so any payload survives.

Null texts give an empty payload; payloads are padded with bytes 0 to a positive multiple of 64. Whole texts are stored,
however long; sound is resampled and summed up in pieces. Files that can't be read give nulls and the reason in ``error``; null
files give nulls without one. Repeated rows are handled each; an empty table gives an empty table. Other columns of the input
are not carried, so none can clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded_batches, lean

PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17


def mu_law_table() -> np.ndarray:
    """16-bit values of the 256 mu-law codes: code inverted, sign, 3 bits of exponent, 4 of mantissa."""
    code = ~np.arange(256, dtype=np.int32) & 255
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """16-bit values of the 256 A-law codes: even bits inverted, sign, exponent, mantissa."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}

# Index changes and step sizes of IMA ADPCM.
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)


GROUP = 4096  # blocks that advance together


def _steps(codes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(changes, new indexes) of codes at step indexes."""
    step = IMA_STEPS[index]
    size = (step >> 3) + np.where(codes & 4, step, 0) + np.where(codes & 2, step >> 1, 0) + np.where(codes & 1, step >> 2, 0)
    return np.where(codes & 8, -size, size), np.clip(index + IMA_INDEX[codes & 7], 0, 88)


def decode_blocks(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM ``blocks`` (a row each): all advance together, one code at a time."""
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    codes = np.stack([blocks[:, 4:].T & 15, blocks[:, 4:].T >> 4], axis=1).reshape(-1, len(blocks))
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for i, c in enumerate(codes.astype(np.int32)):
        change, index = _steps(c, index)
        value = np.clip(value + change, -32768, 32767)
        out[i + 1] = value
    return np.ascontiguousarray(out.T)


def encode_blocks(samples: np.ndarray, index: np.ndarray | None = None) -> np.ndarray:
    """IMA ADPCM blocks of rows of samples (an odd number each): the code nearest to each sample, all rows together."""
    n, size = samples.shape
    value = samples[:, 0].astype(np.int32)
    index = np.zeros(n, np.int32) if index is None else index.astype(np.int32)
    out = np.zeros((n, 4 + (size - 1) // 2), np.uint8)
    out[:, :2] = samples[:, :1].astype("<i2").view(np.uint8)
    out[:, 2] = index
    for i in range(1, size):
        wanted = samples[:, i].astype(np.int32) - value
        rest, step = np.abs(wanted), IMA_STEPS[index]
        code = np.where(wanted < 0, 8, 0)
        for bit in (4, 2, 1):
            there = rest >= step
            code |= np.where(there, bit, 0)
            rest, step = rest - np.where(there, step, 0), step >> 1
        change, index = _steps(code, index)
        value = np.clip(value + change, -32768, 32767)
        out[:, 4 + (i - 1) // 2] |= (code << (4 * ((i - 1) % 2))).astype(np.uint8)
    return out


def decode_ima(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM. A short last block is dropped to whole codes."""
    if block < 5:
        raise ValueError("a block holds its 4-byte head and codes")
    full, parts = len(data) // block, []
    rows = np.frombuffer(data, np.uint8, full * block).reshape(-1, block)
    for i in range(0, full, GROUP):
        parts.append(decode_blocks(rows[i : i + GROUP]).ravel())
    if len(data) - full * block >= 4:
        parts.append(decode_blocks(np.frombuffer(data, np.uint8, offset=full * block)[None, :]).ravel())
    return np.concatenate(parts) if parts else np.empty(0, np.int16)


def encode_ima(sounds: list[np.ndarray], block: int = 256) -> list[bytes]:
    """Mono IMA ADPCM of many sounds at once; the last sample fills up the last block."""
    per = 2 * (block - 4) + 1
    rows = [-(-len(s) // per) for s in sounds]
    padded = [np.append(s, np.full(n * per - len(s), s[-1] if len(s) else 0, np.int16)).reshape(n, per) for s, n in zip(sounds, rows, strict=True)]
    whole = np.concatenate(padded) if padded else np.empty((0, per), np.int16)
    coded = np.concatenate([encode_blocks(whole[i : i + GROUP]) for i in range(0, len(whole), GROUP)] or [np.empty((0, block), np.uint8)])
    ends = np.cumsum(rows)
    return [coded[e - n : e].tobytes() for e, n in zip(ends, rows, strict=True)]


def decode_ima_many(files: list[bytes], block: int) -> list[np.ndarray]:
    """``decode_ima`` of many files of whole blocks at once."""
    rows = [len(f) // block for f in files]
    whole = np.frombuffer(b"".join(files), np.uint8).reshape(-1, block)
    sound = np.concatenate([decode_blocks(whole[i : i + GROUP]) for i in range(0, len(whole), GROUP)] or [np.empty((0, 2 * block - 7), np.int16)])
    ends = np.cumsum(rows)
    return [sound[e - n : e].ravel() for e, n in zip(ends, rows, strict=True)]


def write_wav(samples: bytes, kind: int, rate: int, bits: int, block: int = 0) -> bytes:
    """A mono WAV file. Companded kinds carry the samples as they are."""
    align = block or bits // 8
    per_second = rate * align if not block else rate * block // max(1, 2 * (block - 4) + 1)
    head = struct.pack("<HHIIHH", kind, 1, rate, per_second, align, bits)
    if kind == IMA_ADPCM:
        head += struct.pack("<HH", 2, 2 * (block - 4) + 1)
    elif kind != PCM:
        head += struct.pack("<H", 0)
    pad = b"\0" * (len(samples) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(samples)) + samples + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(kind, rate, block, sample bytes) of a mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate, align, data = 12, 0, 0, 0, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate, _, align, _ = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if data is None or not kind:
        raise ValueError("the file has no format or no data")
    return kind, rate, align, data


def expand(kind: int, data: bytes, block: int = 0) -> np.ndarray:
    """16-bit samples of stored bytes."""
    if kind in TABLES:
        return TABLES[kind][np.frombuffer(data, np.uint8)]
    if kind == IMA_ADPCM:
        return decode_ima(data, block)
    if kind == PCM:
        return np.frombuffer(data, "<i2")
    raise ValueError(f"unknown format {kind}")


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at the new rate, exact in integers; the last sample is held."""
    if rate == to or not len(samples):
        return samples.astype(np.int16)
    n = max(1, len(samples) * to // rate)
    out = np.empty(n, np.int16)
    for i in range(0, n, 1 << 16):
        at = np.arange(i, min(n, i + (1 << 16)), dtype=np.int64) * rate
        low, part = at // to, at % to
        s, nxt = samples[low].astype(np.int64), samples[np.minimum(low + 1, len(samples) - 1)]
        out[i : i + len(at)] = (s * (to - part) + nxt * part) // to
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def store_payloads(docs: DataFrame, kind: int = MU_LAW, rate: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: each text's padded bytes as the samples of a WAV file."""
    bounded_batches(docs.sparkSession, rows=500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [payload_of(s.as_py()) for s in b.column(1)]
            files = [write_wav(p, kind, rate, 8) for _, p in made]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array(files, pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"id {id_kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def feature(samples: np.ndarray) -> str:
    """Integer summary of decoded sound: count, least, most, sum of sizes, energy, zero crossings."""
    if not len(samples):
        return "n=0"
    size = energy = cross = 0
    for i in range(0, len(samples), 1 << 16):
        s = samples[max(0, i - 1) : i + (1 << 16)].astype(np.int64)
        cross += int(np.count_nonzero((s[1:] < 0) != (s[:-1] < 0)))
        s = s[min(i, 1) :]
        size, energy = size + int(np.abs(s).sum()), energy + int(np.dot(s, s))
    return f"n={len(samples)};min={samples.min()};max={samples.max()};abs={size};energy={energy};cross={cross}"


RESULT = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
FORMS = ["pcm_sha256", "alaw_sha256", "alaw_feature", "adpcm_sha256", "adpcm_feature"]


def read_back(media: bytes | None, to: int) -> tuple[dict, np.ndarray | None, int]:
    """(what RESULT names, resampled sound, its rate before) of one stored file."""
    if media is None:
        return dict.fromkeys(RESULT), None, 0
    try:
        kind, rate, block, data = read_wav(media)
        sound = expand(kind, data, block)
    except (ValueError, struct.error) as e:
        return dict.fromkeys(RESULT) | {"error": str(e)}, None, 0
    got = {"payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
    loud = resample(sound, rate, to) if rate > 0 else sound
    return got | {"feature": feature(loud), "error": None}, loud, rate


def other_forms(payloads: list[bytes], rate: int, to: int, block: int = 256) -> list[dict]:
    """What FORMS names: the payload as A-law, stored and read back, and its mu-law sound as ADPCM, stored, read back and decoded."""
    out, sounds = [], [expand(MU_LAW, p) for p in payloads]
    coded = [write_wav(c, IMA_ADPCM, rate, 4, block) for c in encode_ima(sounds, block)]
    heard = decode_ima_many([read_wav(f)[3] for f in coded], block)
    for p, s, file, h in zip(payloads, sounds, coded, heard, strict=True):
        alaw = write_wav(p, A_LAW, rate, 8)
        got, _, _ = read_back(alaw, to)
        pcm = write_wav(resample(s, rate, to).astype("<i2").tobytes(), PCM, to, 16)
        out.append({"pcm_sha256": hashlib.sha256(pcm).hexdigest(), "alaw_sha256": got["media_sha256"], "alaw_feature": got["feature"], "adpcm_sha256": hashlib.sha256(file).hexdigest(), "adpcm_feature": feature(h[: len(s)])})
    return out


def decode_media(stored: DataFrame, to: int = 16000, id_col: str = "doc_id", pcm: bool = False, forms: bool = False) -> DataFrame:
    """Read stored files back: ``id, n_bytes``, digests and features of the sound, ``error``.

    With ``pcm`` the resampled 16-bit PCM file comes with each row; with ``forms`` what ``other_forms`` makes of each payload.
    """
    bounded_batches(stored.sparkSession, rows=500)
    names = RESULT + (FORMS if forms else []) + (["pcm"] if pcm else [])
    kinds = {"payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "pcm": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, payloads, rates = [], [], []
            for media in b.column(2):
                got, sound, rate = read_back(media.as_py(), to)
                if pcm:
                    got["pcm"] = None if sound is None else write_wav(sound.astype("<i2").tobytes(), PCM, to, 16)
                rows.append(got)
                if forms and sound is not None:
                    payloads.append((len(rows) - 1, read_wav(media.as_py())[3]))
                    rates.append(rate)
            for rate in sorted(set(rates)):
                mine = [x for x, r in zip(payloads, rates, strict=True) if r == rate]
                for (i, _), more in zip(mine, other_forms([p for _, p in mine], rate, to), strict=True):
                    rows[i] |= more
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names]], ["id", "n_bytes", *names])

    rows = stored.select(F.col(id_col).alias("id"), "n_bytes", "media")
    types = {pa.int64(): "bigint", pa.binary(): "binary"}
    schema = ", ".join(f"{n} {types.get(kinds.get(n), 'string')}" for n in names)
    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, {schema}").withColumnRenamed("id", id_col)
