import hashlib
import os
import struct
import zlib
from unittest import mock

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rankweave.llm import media as M
from tests.llm.conftest import ODD


@given(st.binary(min_size=1, max_size=2000))
@settings(max_examples=60, deadline=None)
def test_round_trip_and_both_decoders(raw):
    payload = raw + bytes(-len(raw) % 64)
    image = M.decode(M.encode(payload))
    assert M.stored_payload(image) == payload
    with mock.patch.object(M, "_uniform", lambda *a: None):
        slow = M.decode(M.encode(payload))
    assert (slow.coefficients == image.coefficients).all() and (slow.thumbnail == image.thumbnail).all()


def jpeg(blocks, width, height, quant=2, restart=0):
    """A small independent baseline writer: one component, runs, end-of-block and restarts."""
    dc_lengths, dc_symbols = [0, 0, 0, 12] + [0] * 12, list(range(12))
    ac_symbols = [0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 4)]
    ac_lengths = [0] * 6 + [len(ac_symbols)] + [0] * 9
    dc = {s: format(k, "04b") for k, s in enumerate(dc_symbols)}
    ac = {s: format(k, "07b") for k, s in enumerate(ac_symbols)}

    def extra(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    out, bits, before = b"", "", 0

    def flush():
        nonlocal out, bits
        bits += "1" * (-len(bits) % 8)
        out += bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""

    for k, block in enumerate(blocks):
        if restart and k and k % restart == 0:
            flush()
            out += bytes([0xFF, 0xD0 + (k // restart - 1) % 8])
            before = 0
        n, more = extra(block[0] - before)
        before = block[0]
        bits += dc[n] + more
        run = 0
        last = max([i for i in range(1, 64) if block[i]], default=0)
        for v in block[1 : last + 1]:
            if v == 0:
                run += 1
                if run == 16:
                    bits += ac[0xF0]
                    run = 0
                continue
            n, more = extra(v)
            bits += ac[run << 4 | n] + more
            run = 0
        if last < 63:
            bits += ac[0x00]
    flush()
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    return (
        b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes([quant] * 64)) + seg(0xC4, bytes([0, *dc_lengths, *dc_symbols])) + seg(0xC4, bytes([0x10, *ac_lengths, *ac_symbols]))
        + (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0])) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + out + b"\xff\xd9"
    )


@pytest.mark.parametrize("restart", [0, 2])
def test_ordinary_files(restart):
    rng = np.random.Generator(np.random.PCG64(1))
    blocks = []
    for _ in range(6):
        b = [0] * 64
        b[0] = int(rng.integers(-100, 100))
        for i in rng.choice(np.arange(1, 64), 5, replace=False):
            b[i] = int(rng.integers(-7, 8))
        blocks.append(b)
    image = M.decode(jpeg(blocks, 20, 15, restart=restart))
    assert (image.width, image.height, image.thumbnail.shape) == (20, 15, (2, 3))
    assert image.coefficients.tolist() == blocks
    want = [min(255, max(0, (2 * b[0] + 4) // 8 + 128)) for b in blocks]
    assert image.thumbnail.reshape(-1).tolist() == want


def test_broken_files():
    good = M.encode(os.urandom(128))
    for bad in (b"", b"\xff\xd8", good[:40], good[:-60], good.replace(b"\xff\xc0", b"\xff\xc2", 1)):
        with pytest.raises(M.JpegError):
            M.decode(bad)


def test_column(make):
    texts = [*ODD, ODD[3]]
    out = M.media_columns(make(texts), keep_media=True).orderBy("doc_id").collect()
    for text, r in zip(texts, out, strict=True):
        raw = (text or "").encode()
        payload = raw + bytes((-len(raw) % 64) or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert M.stored_payload(M.decode(bytes(r.media))) == payload
    assert out[3].feature == out[-1].feature
    assert M.media_columns(make([])).isEmpty()
