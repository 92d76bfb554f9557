"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAVE containers, expanded to resampled 16-bit PCM.

G.711 codes are expanded by 256-entry lookup tables. IMA ADPCM is decoded with numpy across all blocks of a batch of
records at once, one step a nibble. Expanded samples are resampled by linear interpolation and stored as 16-bit PCM.
Everything works on parts of an Arrow batch of bounded bytes; a single longer record is handled alone.

Null payloads count as empty. An empty table gives an empty result, repeated rows give equal values, and input columns
named like an output column are replaced.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: WAVE format tags of the codecs (fixed values).
TAGS = {"alaw": 6, "mulaw": 7, "ima": 17}
#: IMA ADPCM step sizes and index moves (fixed values of the format).
STEPS = """7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209
230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024
3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086
29794 32767"""
MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)
#: Bytes of an ADPCM block, its samples, sampling rates stored and made.
BLOCK, PER_BLOCK, RATE, RATE_OUT = 64, 121, 8000, 16000


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = ((((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    part, base = (a & 0x70) >> 4, ((a & 0x0F) << 4) + 8
    size = np.where(part == 0, base, (base + 0x100) << np.maximum(part - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


def ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """Difference and next index of each (index, nibble), flat by index * 16 + nibble."""
    step = np.array(STEPS.split(), np.int32)[:, None]
    code = np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    after = np.clip(np.arange(len(step))[:, None] + np.array(MOVES)[code & 7], 0, len(step) - 1)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (after * 16).astype(np.int32).ravel()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """(n, 64) bytes to (n, 121) samples. A block starts with its first sample (16 bits) and step index (kept to 0..88)."""
    diff, after = ima_tables()
    out = np.empty((PER_BLOCK, len(blocks)), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    out[0] = value
    coded = np.ascontiguousarray(blocks[:, 4:].T).astype(np.int32)
    for k in range(BLOCK - 4):
        for half, code in ((0, coded[k] & 15), (1, coded[k] >> 4)):
            at = index + code
            value = np.clip(value + diff[at], -32768, 32767)
            index = after[at]
            out[1 + 2 * k + half] = value
    return out.T


def resample(x: np.ndarray, rate: int, rate_out: int) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample is held."""
    if rate == rate_out or not len(x):
        return x.astype(np.int16)
    if rate_out % rate == 0:
        k = rate_out // rate
        x = x.astype(np.int32)
        rise = np.diff(x, append=x[-1:])
        return np.stack([x + rise * j // k for j in range(k)], axis=1).ravel().astype(np.int16)
    at = np.arange(len(x) * rate_out // rate, dtype=np.int64) * rate
    i, part = at // rate_out, at % rate_out
    x = x.astype(np.int64)
    return (x[i] + (x[np.minimum(i + 1, len(x) - 1)] - x[i]) * part // rate_out).astype(np.int16)


def pad(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return payload + bytes(BLOCK - len(payload) % BLOCK if len(payload) % BLOCK or not payload else 0)


def wave(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A WAVE file whose data are the payload's bytes as 8-bit samples, or as ADPCM blocks."""
    ima = codec == "ima"
    n = len(payload) // BLOCK * PER_BLOCK if ima else len(payload)
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, rate * BLOCK // PER_BLOCK if ima else rate, BLOCK if ima else 1, 4 if ima else 8)
    fmt += struct.pack("<HH", 2, PER_BLOCK) if ima else struct.pack("<H", 0)
    body = b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for name, x in ((b"fmt ", fmt), (b"fact", struct.pack("<I", n)), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def unwave(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and data of a WAVE file; its chunks are walked."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, found = 12, {}
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        found[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    tag, _, rate = struct.unpack_from("<HHI", found[b"fmt "])
    return next(c for c, t in TAGS.items() if t == tag), rate, found[b"data"]


def encode_media(df: DataFrame, payload: str, *, codec: str | None = None) -> DataFrame:
    """df with n_bytes long and media binary: the padded payload (text or binary; null: empty) in a WAVE container. codec:
    mulaw, alaw or ima; None: one of them by the payload, so equal payloads agree."""

    def setup():
        import zlib

        names = list(TAGS)

        def kernel(batch):
            raw = [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x or b"" for x in batch.column(payload).to_pylist()]
            media = [wave(pad(x), codec or names[zlib.crc32(x) % len(names)]) for x in raw]
            return {"n_bytes": pa.array([len(x) for x in raw], pa.int64()), "media": pa.array(media, pa.binary())}

        return kernel

    return arrow_map(df, setup, "n_bytes long, media binary")


DECODED = "codec string, payload binary, pcm binary, samples long, peak int, energy long, crossings long"


def decode_media(df: DataFrame, media: str = "media", *, rate_out: int = RATE_OUT) -> DataFrame:
    """df with what the stored bytes hold: codec, payload, pcm (16-bit little-endian at rate_out), and of the expanded
    samples their number, largest size, sum of squares and sign changes. Null media: nulls, and 0 samples."""

    def setup():
        tables = {"mulaw": mulaw_table(), "alaw": alaw_table()}

        def kernel(batch):
            files = [unwave(x) if x is not None else None for x in batch.column(media).to_pylist()]
            ima = [i for i, f in enumerate(files) if f and f[0] == "ima"]
            blocks = np.frombuffer(b"".join(files[i][2] for i in ima), np.uint8).reshape(-1, BLOCK) if ima else None
            decoded, at = (np.concatenate([decode_ima(blocks[k : k + 16384]) for k in range(0, len(blocks), 16384)]) if ima else None), 0
            rows = []
            for f in files:
                if f is None:
                    rows.append((None, None, None, 0, None, None, None))
                    continue
                codec, rate, data = f
                if codec == "ima":
                    n = len(data) // BLOCK
                    x, at = decoded[at : at + n].ravel(), at + n
                else:
                    x = tables[codec][np.frombuffer(data, np.uint8)]
                wide = x.astype(np.int64)
                rows.append((codec, data, resample(x, rate, rate_out).astype("<i2").tobytes(), len(x), int(np.abs(wide).max(initial=0)), int(wide @ wide), int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))))
            types = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            names = ("codec", "payload", "pcm", "samples", "peak", "energy", "crossings")
            return {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, types, strict=True))}

        return kernel

    return arrow_map(df, setup, DECODED)


def op1(docs: DataFrame) -> DataFrame:
    stored = encode_media(docs.select("doc_id", "text"), "text").drop("text")
    read = decode_media(stored)
    tail = F.substring("payload", -64, 64)
    feature = F.concat_ws(
        ";", "codec", F.concat(F.lit("samples="), "samples"), F.concat(F.lit("peak="), "peak"), F.concat(F.lit("rms="), F.round(F.sqrt(F.col("energy") / F.col("samples")), 3).cast("string")),
        F.concat(F.lit("crossings="), "crossings"), F.concat(F.lit("pcm16k="), F.lower(F.hex(F.crc32("pcm")))),
    )
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
