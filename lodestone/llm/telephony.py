"""Telephony audio: G.711 mu-law and A-law by lookup tables, IMA ADPCM by blocks, resampled to 16-bit PCM.

The codec bytes are stored in RIFF WAVE form. All ADPCM blocks of an Arrow batch are decoded at once: numpy steps through
the samples of a block while each step covers all blocks. Stored PCM is arranged without loss by `code_pcm`.
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

from lodestone.llm.common import map_arrow, settings, stash, utf8

RATE, OUT_RATE = 8000, 16000
#: Payloads are padded with byte 32 up to a positive multiple of this; it is also the size of an ADPCM block.
UNIT = 192
CODECS = ("mulaw", "alaw", "adpcm")
#: How hard stored tables are compressed: media and PCM together are to stay below one and a half times the texts as Parquet.
LEVEL = {"parquet_compression_codec_zstd_level": "12", "parquet_page_size": str(8 << 20)}
#: Format tags of RIFF WAVE.
_TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
#: The index steps of IMA ADPCM for the low three bits of a code.
_INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8])
#: The 89 step sizes of IMA ADPCM.
_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209,
    230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024,
    3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    low, shift = (code & 15) << 4, code >> 4 & 7
    size = np.where(shift == 0, low + 8, low + 264 << np.maximum(shift - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


_MULAW, _ALAW = mulaw_table(), alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM mono blocks, a row each: 16-bit predictor, index, a spare byte, then two samples a byte, low half first."""
    predictor = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    codes[0::2] = (blocks[:, 4:] & 15).T
    codes[1::2] = (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = predictor
    steps = _STEPS.astype(np.int32)
    moves = np.concatenate([_INDEX_STEPS, _INDEX_STEPS]).astype(np.int32)
    for i, code in enumerate(codes):
        step = steps[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        predictor = np.clip(predictor + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + moves[code], 0, 88)
        out[i + 1] = predictor
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int = RATE, out_rate: int = OUT_RATE) -> np.ndarray:
    """16-bit PCM at another rate, by linear interpolation in whole numbers; the last sample holds."""
    if rate == out_rate or not len(pcm):
        return pcm
    if out_rate == 2 * rate:
        wide = pcm.astype(np.int32)
        out = np.empty(2 * len(pcm), np.int16)
        out[0::2] = pcm
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    at = np.arange(len(pcm) * out_rate // rate, dtype=np.int64) * rate
    low, part = at // out_rate, at % out_rate
    wide = pcm.astype(np.int64)
    return ((wide[low] * (out_rate - part) + wide[np.minimum(low + 1, len(pcm) - 1)] * part) // out_rate).astype(np.int16)


def wave(codec: str, payload: bytes) -> bytes:
    """A mono RIFF WAVE file of codec bytes."""
    if codec == "adpcm":
        kind = struct.pack("<HHIIHHHH", 17, 1, RATE, RATE * UNIT // (2 * (UNIT - 4) + 1), UNIT, 4, 2, 2 * (UNIT - 4) + 1)
    else:
        kind = struct.pack("<HHIIHHH", _TAGS[codec], 1, RATE, RATE, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(kind)) + kind + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wave(data: bytes) -> tuple[str, int, int, bytes]:
    """Codec, rate, block size and codec bytes of a file, by its chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, codec, rate, block = 12, "", 0, 0
    while at + 8 <= len(data):
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, block = struct.unpack_from("<HHIIH", data, at + 8)
            codec = next(c for c, t in _TAGS.items() if t == tag)
        elif name == b"data":
            return codec, rate, block, data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("a WAVE file without data")


def decode_all(files: list[bytes]) -> list[tuple[str, bytes, np.ndarray]]:
    """Codec, codec bytes and PCM at their own rate of many files; the ADPCM blocks of all of them in one go."""
    parsed = [parse_wave(f) for f in files]
    blocks, out = [], []
    for codec, _, size, payload in parsed:
        raw = np.frombuffer(payload, np.uint8)
        if codec == "adpcm":
            blocks.append(raw.reshape(-1, size))
        out.append((codec, payload, _MULAW[raw] if codec == "mulaw" else _ALAW[raw] if codec == "alaw" else np.empty(0, np.int16)))
    if blocks:
        pcm, at = decode_adpcm(np.concatenate(blocks)), 0
        for i, (codec, _, size, payload) in enumerate(parsed):
            if codec == "adpcm":
                n = len(payload) // size
                out[i] = (codec, payload, pcm[at : at + n].ravel())
                at += n
    return out


def features(codec: str, pcm: np.ndarray) -> str:
    """Codec, rate, samples, peak, mean square, sign changes and crc32 of resampled PCM."""
    # squares in double: their sum is below 2**53 for up to 2**23 samples, and is rounded down beyond that
    square = int(np.dot(pcm.astype(np.float64), pcm) / max(1, len(pcm)))
    signs = int(np.count_nonzero(np.diff(pcm >= 0)))
    peak = int(max(pcm.max(), -int(pcm.min()))) if len(pcm) else 0
    return f"{codec}:{OUT_RATE}:{len(pcm)}:{peak}:{square}:{signs}:{zlib.crc32(pcm.astype('<i2').tobytes())}"


def _planes(samples: np.ndarray) -> bytes:
    """All low bytes, then all high bytes."""
    return np.ascontiguousarray(samples.astype("<i2").view(np.uint8).reshape(-1, 2).T).tobytes()


def code_pcm(pcm: np.ndarray) -> bytes:
    """PCM without loss, in as many bytes: the even samples, then by how much each odd one is off the mean of its neighbours.

    PCM of twice the rate has odd samples that are nearly all such means, so that these bytes compress to almost nothing.
    """
    even, odd = pcm[0::2], pcm[1::2]
    return even.astype("<i2").tobytes() + _planes(odd - _between(even, len(odd)))


def _between(even: np.ndarray, n: int) -> np.ndarray:
    """The mean of each even sample and the next one, rounded down; the last one holds. Differences wrap in 16 bits both ways."""
    wide = even.astype(np.int32)
    return ((wide + np.append(wide[1:], wide[-1:])) >> 1).astype(np.int16)[:n]


def decode_pcm(data: bytes) -> np.ndarray:
    n = len(data) // 2
    out = np.empty(n, np.int16)
    even = np.frombuffer(data, "<i2", (n + 1) // 2)
    off = np.frombuffer(data, np.uint8, offset=even.nbytes).reshape(2, -1)
    out[0::2] = even
    out[1::2] = _between(even, n // 2) + np.ascontiguousarray(off.T).view("<i2")[:, 0]
    return out


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, files = [], []
        for raw in batch.column(1).to_pylist():
            payload = raw + b" " * (-len(raw) % UNIT if raw else UNIT)
            sizes.append(len(raw))
            files.append(wave(CODECS[zlib.crc32(raw) % len(CODECS)], payload))
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.large_binary()).cast(pa.binary())], names=["doc_id", "n_bytes", "media"])


def _inspect(with_pcm: bool, coded: bool = False):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(2).to_pylist()
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm")}
            for file, (codec, payload, pcm) in zip(files, decode_all(files), strict=True):
                pcm = resample(pcm)
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-16:]))
                out["media_bytes"].append(len(file))
                out["media_sha256"].append(hashlib.sha256(file).hexdigest())
                out["feature"].append(features(codec, pcm))
                out["pcm"].append((code_pcm(pcm) if coded else pcm.astype("<i2").tobytes()) if with_pcm else None)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
            if not with_pcm:
                columns.pop()
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=["doc_id", "n_bytes", *list(out)[: len(columns)]])

    return f


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as a WAVE file, written. The codec goes by crc32 of the text.

    A null or empty text is one unit of byte 32. Texts of any length are one file, equal rows a file each; an empty table
    gives an empty one. Only doc_id and text are read, so other columns may have any name.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    with settings(docs.sparkSession, **LEVEL):
        return stash(map_arrow(docs.select("doc_id", utf8(F.col("text")).alias("raw")), _store, f"doc_id {kind}, n_bytes long, media binary"), "telephony")


def inspect(media: DataFrame, with_pcm: bool = False, coded: bool = False) -> DataFrame:
    """Digests and features of stored files, read back; `with_pcm` adds the PCM at 16 kHz as bytes, `coded` by `code_pcm`.

    A row a row of `media`, repeated ones and null doc_ids too; no rows of an empty table. Files of any length are read whole.
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", pcm binary" * with_pcm
    return map_arrow(media.select("doc_id", "n_bytes", "media"), _inspect(with_pcm, coded), schema)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hexes = [pa.array([d.hex() for d in batch.column(i).to_pylist()], pa.string()) for i in (3, 6)]
        found = [features(c, decode_pcm(pcm)) for c, pcm in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist(), strict=True)]
        yield pa.record_batch([*[batch.column(i) for i in range(3)], hexes[0], batch.column(4), batch.column(5), hexes[1], pa.array(found, pa.string())], names=[*batch.schema.names[:7], "feature"])


def store_and_inspect(docs: DataFrame) -> DataFrame:
    """As `inspect(store(docs))`, with the PCM at 16 kHz written beside the digests and the features taken from it, read back.

    A null or empty text is the shortest payload, blanks; texts of any length are stored whole, and only doc_id and text are read.
    """
    sound = inspect(store(docs), with_pcm=True, coded=True)
    digest = ("payload_sha256", "media_sha256")
    with settings(docs.sparkSession, **LEVEL):
        kept = stash(sound.select(*[F.unhex(c).alias(c) if c in digest else F.col(c) for c in sound.columns]), "telephony-pcm")
    kind = kept.schema["doc_id"].dataType.simpleString()
    digests = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(kept.select(*digests, F.substring_index("feature", ":", 1).alias("codec"), "pcm"), _measure, schema)
