"""Media columns of telephony audio: mu-law and A-law by lookup tables, IMA ADPCM by numpy across blocks, resampled PCM.

A media value is a WAV file (binary) whose data chunk holds the coded bytes unchanged, so the payload is read back
bit for bit. ``decode`` gives 16-bit PCM; ``resample`` doubles the rate by linear interpolation. ADPCM is sequential
within a block only: all blocks of a batch, whatever document they are from, take each step together.

``store`` writes media and resampled PCM of a row into one table; ``read`` gets both back. PCM is stored without loss in
a packed form, as lossless audio formats do: every second sample, as the number of its level where all are levels of one
companding law, and only those other samples that differ from the middle of their neighbours.

Defined cases: a null payload is an empty one; a partial last ADPCM block is padded with zeros for decoding and its
samples beyond the data are dropped; a media value of another format or a damaged header raises; repeated rows give
equal values; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RATE = 8000
#: WAV format tags, fixed values.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}
NAMES = {v: k for k, v in TAGS.items()}
#: ADPCM block bytes: a header of four and two samples a byte.
BLOCK = 192

#: IMA index steps, fixed values.
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)


#: IMA step sizes, fixed values.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int64)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)
    return np.where(code & 0x80, 0x84 - size, size - 0x84).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, low = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(part == 0, low + 8, (low + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def decode_blocks(blocks: np.ndarray) -> np.ndarray:
    """blocks: uint8 (n, bytes) -> int16 (n, 2 * (bytes - 4) + 1)."""
    n, width = blocks.shape
    out = np.empty((n, 2 * (width - 4) + 1), np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out[:, 0] = value
    steps, moves = STEPS.astype(np.int32), INDEX.astype(np.int32)
    # The change for every (index, code), so that a step is two lookups and two clips.
    codes = np.arange(16)
    change = (steps[:, None] >> 3) + np.where(codes & 4, steps[:, None], 0) + np.where(codes & 2, steps[:, None] >> 1, 0) + np.where(codes & 1, steps[:, None] >> 2, 0)
    change = np.where(codes & 8, -change, change).astype(np.int32).ravel()
    after = np.clip(np.arange(89)[:, None] + moves, 0, 88).astype(np.int32).ravel()
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    at = 1
    for byte in columns:
        for code in (byte & 0x0F, byte >> 4):
            key = (index << 4) + code
            value = np.clip(value + change[key], -32768, 32767)
            index = after[key]
            out[:, at] = value
            at += 1
    return out


def to_wav(codec: str, payload: bytes, rate: int = RATE) -> bytes:
    tag = TAGS[codec]
    align, bits = (BLOCK, 4) if codec == "adpcm" else (1, 8)
    extra = struct.pack("<HH", 2, 2 * (BLOCK - 4) + 1) if codec == "adpcm" else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * align // (2 * (align - 4) + 1 if codec == "adpcm" else 1), align, bits) + extra
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(media: bytes) -> tuple[str, bytes]:
    """codec and the data chunk's bytes."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV value")
    at, tag = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        elif name == b"data":
            return NAMES[tag], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def decode(media: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """16-bit PCM of each (codec, bytes); ADPCM blocks of all values are decoded together."""
    out: list[np.ndarray | None] = [None] * len(media)
    tables = {"mulaw": MULAW, "alaw": ALAW}
    coded = []
    for i, (codec, data) in enumerate(media):
        if codec == "adpcm":
            coded.append((i, -(-len(data) // BLOCK), len(data)))
        else:
            out[i] = tables[codec][np.frombuffer(data, np.uint8)]
    # Some thousand blocks at a time, so that memory stays bounded.
    at = 0
    while at < len(coded):
        end, n = at, 0
        while end < len(coded) and (n == 0 or n + coded[end][1] <= 50_000):
            n += coded[end][1]
            end += 1
        raw = b"".join(media[i][1].ljust(k * BLOCK, b"\0") for i, k, _ in coded[at:end])
        samples = decode_blocks(np.frombuffer(raw, np.uint8).reshape(n, BLOCK)) if n else np.empty((0, 1), np.int16)
        first = 0
        for i, k, size in coded[at:end]:
            pcm = samples[first : first + k].ravel()
            short = k * BLOCK - size
            out[i] = pcm[: len(pcm) - (0 if not short else min(2 * short, len(pcm)))]
            first += k
        at = end
    return out


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the mean with the next (the last repeats)."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = between(pcm)
    return out


#: Sorted levels of the two laws, by the number that names them in packed PCM.
LEVELS = {1: np.unique(MULAW), 2: np.unique(ALAW)}


def between(base: np.ndarray) -> np.ndarray:
    """The sample between each and the next: their mean, rounded down; the last repeats."""
    wide = base.astype(np.int32)
    return ((wide + np.append(wide[1:], wide[-1:])) >> 1).astype(np.int16)


def pack_pcm(pcm: np.ndarray) -> bytes:
    """16-bit PCM of any length: law or 0, number of samples and of odd ones out, base samples, places and values of those."""
    base, rest = pcm[::2], pcm[1::2]
    middle = between(base)[: len(rest)]
    off = np.flatnonzero(rest != middle)
    plain = base.astype("<i2").tobytes()
    law = 0
    for name, levels in LEVELS.items():
        at = np.minimum(np.searchsorted(levels, base), len(levels) - 1)
        if (levels[at] == base).all():
            law, plain = name, at.astype(np.uint8).tobytes()
            break
    return struct.pack("<BII", law, len(pcm), len(off)) + plain + off.astype("<u4").tobytes() + rest[off].astype("<i2").tobytes()


def unpack_pcm(data: bytes) -> np.ndarray:
    law, n, n_off = struct.unpack_from("<BII", data)
    n_base, at = (n + 1) // 2, 9
    base = LEVELS[law][np.frombuffer(data, np.uint8, n_base, at)] if law else np.frombuffer(data, "<i2", n_base, at)
    at += n_base * (1 if law else 2)
    out = np.empty(n, np.int16)
    out[::2] = base
    out[1::2] = between(base)[: n // 2]
    places = np.frombuffer(data, "<u4", n_off, at)
    out[2 * places.astype(np.int64) + 1] = np.frombuffer(data, "<i2", n_off, at + 4 * n_off)
    return out


def batches_of(payloads: list, most: int = 1 << 23) -> Iterator[slice]:
    """Slices of consecutive values with about ``most`` bytes."""
    first = size = 0
    for i, p in enumerate(payloads):
        size += len(p)
        if size >= most:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(payloads):
        yield slice(first, len(payloads))


#: Compression level of the stored table: PCM repeats what the coded bytes say, which a longer search finds.
STORED_LEVEL = 9


def store(rows, codec_of, folder_tag: str = "media"):
    """rows: doc_id, payload (binary) -> doc_id, n_bytes, media, pcm (resampled, packed); written to the shared folder and read again."""
    from .common import materialise, ship, tidy

    ship(rows.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("pcm", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [p.as_py() or b"" for p in batch.column("payload")]
            for part in batches_of(sizes, 1 << 21):
                coded = [padded(p) for p in sizes[part]]
                media = [to_wav(codec_of(c), c) for c in coded]
                pcm = [pack_pcm(resample(x)) for x in decode([from_wav(m) for m in media])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part.start : part.stop], pa.array([len(p) for p in sizes[part]], pa.int64()), pa.array(media, pa.binary()), pa.array(pcm, pa.binary())], schema=schema)

    return materialise(rows.mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary, pcm binary"), folder_tag, STORED_LEVEL)


#: Payloads are padded with this byte to a positive multiple of so many bytes: whole ADPCM blocks.
PAD, UNIT = b"\xff", 3 * BLOCK


def padded(payload: bytes) -> bytes:
    return payload + PAD * (-len(payload) % UNIT if payload else UNIT)


def read(stored, measure=None):
    """stored: doc_id, n_bytes, media, pcm -> doc_id, n_bytes, media, payload and codec (from media), and pcm: 16-bit at twice the rate (binary).

    With measure (bytes of PCM -> string) the PCM is reduced inside the task and the column is ``feature`` instead.
    """
    from .common import ship, tidy

    ship(stored.sparkSession)
    last = ("pcm", pa.binary()) if measure is None else ("feature", pa.string())
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("codec", pa.string()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("media").to_pylist()
            for part in batches_of(values, 1 << 21):
                known = [from_wav(m) for m in values[part]]
                pcm = [unpack_pcm(p.as_py()).tobytes() for p in batch.column("pcm")[part.start : part.stop]]
                out = pcm if measure is None else [measure(x) for x in pcm]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[part.start : part.stop] for c in ("doc_id", "n_bytes", "media")), pa.array([p for _, p in known], pa.binary()), pa.array([c for c, _ in known], pa.string()), pa.array(out, last[1])], schema=schema)

    return stored.mapInArrow(tidy(run), f"doc_id long, n_bytes long, media binary, payload binary, codec string, {last[0]} {'binary' if measure is None else 'string'}")


def features(pcm: bytes) -> str:
    """Samples, root mean square, zero crossings and a checksum of 16-bit PCM."""
    import zlib

    x = np.frombuffer(pcm, np.int16).astype(np.int64)
    energy = int((x * x).sum())
    sign = x < 0
    return f"n={len(x)} rms={(energy / max(1, len(x))) ** 0.5:.3f} crossings={int((sign[1:] != sign[:-1]).sum())} crc={zlib.crc32(pcm):08x}"
