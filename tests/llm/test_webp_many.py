"""op1: many payloads at once give the files, pixels and errors of one after the other."""

import hashlib
import random

import numpy as np
import pytest

from fieldledger.llm import webp, webp_many


def payloads():
    r, rng = random.Random(5), np.random.default_rng(5)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(300)]
    texts = [b"", b"a", b"ab" * 288, b"x" * 9000, "häßlich 😀 ".encode() * 300, bytes(range(256)) * 9]
    texts += [" ".join(r.choice(words) for _ in range(n)).encode() for n in [*range(1, 400, 9), 3000, 20_000]]
    texts += [rng.integers(0, k, n, np.uint8).tobytes() for k, n in ((255, 60_000), (2, 5000), (16, 30_000), (3, 576))]
    texts += [bytes([r.choice((0, 128, 255))]) * n for n in (577, 1152, 40_000)]
    return [webp.padded(t) for t in texts]


def same_as_one_by_one(values):
    files = webp_many.encode_payloads(values)
    assert files == [webp.encode_payload(p) for p in values]
    for (pixels, back), p, f in zip(webp_many.decode_payloads(files), values, files, strict=True):
        assert back == p and np.array_equal(pixels, webp.decode_payload(f)[0])
    return files


def test_the_rows_of_a_slice_take_each_step_together(monkeypatch):
    """No step of a single file's writer or reader runs once for each text."""
    calls = []
    for name in ("read_pixels", "read_prefix", "write_prefix", "write_colours", "undo_predictor", "apply_predictor", "encode_part", "decode"):
        monkeypatch.setattr(webp, name, lambda *a, name=name: calls.append(name))
    texts = [None, "", *(f"text {i} of some words\n" * (i % 7 + 1) for i in range(60))]
    files = webp.stored_many(texts)
    rows = webp.read_back_many([m for _, m in files])
    for t, (n, _), row in zip(texts, files, rows, strict=True):
        p = webp.padded((t or "").encode())
        assert (n, row[0], row[1]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest())
    assert calls == []


def test_files_and_pixels_of_many_payloads():
    values = payloads()
    files = same_as_one_by_one(values)
    assert not any(x is None for x in webp_many.decode(files))
    assert webp_many.encode_payloads([]) == [] and webp_many.decode_payloads([]) == []


@pytest.mark.parametrize("lane, overhang", [(40, 0), (64, 32), (300, 4096)])
def test_lanes_of_any_length(monkeypatch, lane, overhang):
    monkeypatch.setattr(webp_many, "LANE_BITS", lane)
    monkeypatch.setattr(webp_many, "OVERHANG", overhang)
    files = same_as_one_by_one([p for p in payloads() if len(p) < 70_000])
    assert not any(x is None for x in webp_many.decode(files))


def test_payloads_beyond_one_image(monkeypatch):
    monkeypatch.setattr(webp, "COLOUR_PIXELS", 192 * 20)
    monkeypatch.setattr(webp_many, "PIXELS_AT_ONCE", 5000)
    same_as_one_by_one(payloads())
    monkeypatch.setattr(webp, "MAX_SIDE", 400)
    values = [webp.padded(np.random.default_rng(n).integers(97, 123, n, np.uint8).tobytes()) for n in (576, 576 * 139, 576 * 277)]
    values.append(webp.padded(b"a line of an overlong text\n" * 30_000))  # two widths
    files = same_as_one_by_one(values)
    assert len({webp.decode(webp.files_of(f)[0]).shape[1] for f in files}) == 2


def test_files_in_other_forms(monkeypatch):
    """Other writers' files among ours: read all the same, and errors are errors."""
    rng = np.random.default_rng(9)
    clear = rng.integers(0, 2**32, (5, 192), np.uint64).astype(np.uint32)
    opaque = clear | np.uint32(webp.OPAQUE)
    ours = webp_many.encode_payloads(payloads()[:9])
    others = [webp.encode_colours(clear), webp.encode_colours(opaque, tile_bits=2), webp.encode_colours(opaque, cache_bits=0), webp.encode_colours(opaque, cache_bits=9)]
    others += [webp.encode_colours(opaque, modes=[11]), webp.encode_payload(payloads()[9], "palette"), webp.encode_palette(rng.integers(0, 256, (7, 192)).astype(np.uint8))]
    for mixed in ([*others, *ours], [*ours, *others], others):
        for m, (pixels, back) in zip(mixed, webp_many.decode_payloads(mixed), strict=True):
            want = webp.decode_payload(m)
            assert np.array_equal(pixels, want[0]) and back == want[1]
    for cut in (25, 31, 40, len(ours[4]) // 2, len(ours[4]) - 24):
        with pytest.raises(webp.WebpError):
            webp_many.decode_payloads([*ours, ours[4][:cut]])
    # damaged streams give what the single reader gives
    for k in range(300):
        damaged = bytearray(ours[k % 9])
        damaged[int(rng.integers(25, len(damaged) - 16))] ^= 1 << int(rng.integers(8))
        try:
            want = webp.decode_payload(bytes(damaged))
        except (webp.WebpError, ValueError, IndexError) as e:
            with pytest.raises(type(e)):
                webp_many.decode_payloads([ours[0], bytes(damaged)])
        else:
            pixels, back = webp_many.decode_payloads([ours[0], bytes(damaged)])[1]
            assert np.array_equal(pixels, want[0]) and back == want[1]
