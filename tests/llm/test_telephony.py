import hashlib
import zlib

import numpy as np
import pytest
from lodestone.llm import telephony


def test_round_trip(docs, rows, nothing):
    out = telephony.inspect(telephony.store(docs), with_pcm=True).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out), key=str)
    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        want.append((r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert got == sorted(want, key=str)
    assert {r.feature.split(":")[0] for r in out} == set(telephony.CODECS)
    assert all(len(r.pcm) == 2 * int(r.feature.split(":")[2]) for r in out)
    by_text = {}
    for r in out:
        assert by_text.setdefault(r.payload_sha256, (r.feature, r.media_sha256)) == (r.feature, r.media_sha256)
    assert telephony.inspect(telephony.store(nothing)).count() == 0


def test_known_companding_values():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert mu[0xFF] == 0 and mu[0x7F] == 0 and mu[0x00] == -32124 and mu[0x80] == 32124
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256
    assert len(np.unique(mu)) == 255 and len(np.unique(a)) == 256


def scalar_adpcm(block):
    value, index = int.from_bytes(block[:2].tobytes(), "little", signed=True), min(int(block[2]), 88)
    out = [value]
    for byte in block[4:]:
        for code in (int(byte) & 15, int(byte) >> 4):
            step = int(telephony._STEPS[index])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def test_adpcm_blocks():
    blocks = np.random.default_rng(2).integers(0, 256, (9, 192), np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [scalar_adpcm(b) for b in blocks]


def test_resampling():
    pcm = np.array([0, 10, -7, 32767, -32768], np.int16)
    assert telephony.resample(pcm).tolist() == [0, 5, 10, 1, -7, 16380, 32767, -1, -32768, -32768]
    assert telephony.resample(pcm, 8000, 8000).tolist() == pcm.tolist()
    assert len(telephony.resample(np.arange(800, dtype=np.int16), 8000, 11025)) == 1102
    with pytest.raises(ValueError):
        telephony.parse_wave(b"nothing")


def test_pcm_is_stored(spark, small, monkeypatch):
    from lodestone.llm.queries import QUERIES

    kept, real = {}, telephony.stash
    monkeypatch.setattr(telephony, "stash", lambda df, name: kept.setdefault(name, real(df, name)))
    out = QUERIES["op7_telephony"](spark, small)
    pcm = {(r.doc_id, r.feature): len(r.pcm) for r in kept["telephony-pcm"].select("doc_id", "feature", "pcm").collect()}
    assert pcm == {(r.doc_id, r.feature): 2 * int(r.feature.split(":")[2]) for r in out.collect()}
    assert sorted(map(str, out.collect())) == sorted(map(str, telephony.inspect(kept["telephony"]).collect()))


def test_coded_pcm_is_lossless():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 192, 1001):
        for pcm in (rng.integers(-32768, 32768, n).astype(np.int16), telephony.resample(rng.integers(-32768, 32768, n).astype(np.int16))):
            coded = telephony.code_pcm(pcm)
            assert len(coded) == 2 * len(pcm) and telephony.decode_pcm(coded).tolist() == pcm.tolist()


def test_feature_by_brute_force(spark, small, docs, rows):
    """The feature of op7's rows, computed anew from the text alone."""
    from lodestone.llm.queries import QUERIES

    def brute(text):
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        codec = telephony.CODECS[zlib.crc32(raw) % 3]
        if codec == "adpcm":
            low = [v for i in range(0, len(payload), 192) for v in scalar_adpcm(np.frombuffer(payload[i : i + 192], np.uint8))]
        else:
            table = (telephony.mulaw_table() if codec == "mulaw" else telephony.alaw_table()).tolist()
            low = [table[b] for b in payload]
        high = [v for a, b in zip(low, [*low[1:], low[-1]], strict=True) for v in (a, (a + b) >> 1)]
        signs = sum((a >= 0) != (b >= 0) for a, b in zip(high, high[1:]))
        return f"{codec}:16000:{len(high)}:{max(map(abs, high))}:{sum(v * v for v in high) // len(high)}:{signs}:{zlib.crc32(np.array(high, '<i2').tobytes())}"

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = [r for r in QUERIES["op7_telephony"](spark, small).collect() if r.n_bytes < 1500]
    assert len(out) > 50 and all(r.feature == brute(texts[r.doc_id]) for r in out)
    edge = telephony.store_and_inspect(docs.filter("length(text) < 300 or text is null")).collect()
    assert sorted((str(r.doc_id), r.feature) for r in edge) == sorted((str(r[0]), brute(r[1])) for r in rows if r[1] is None or len(r[1]) < 300)
