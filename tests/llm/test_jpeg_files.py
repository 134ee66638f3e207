"""JPEG files put together by hand, and long payloads."""

from __future__ import annotations

import subprocess
import sys

import numpy as np
import pytest

from voxframe.llm import media

#: Canonical codes of four bits for the sizes 0 to 8, and one AC code, the end of block, of one bit.
DC_TABLE, AC_TABLE = b"\0\0\0\x09" + bytes(12) + bytes(range(9)), b"\1" + bytes(15) + b"\0"


def bits_of(step):
    size = abs(step).bit_length()
    return f"{size:04b}" + (f"{step if step > 0 else step + (1 << size) - 1:0{size}b}" if size else "") + "0"


def scan_of(steps):
    text = "".join(map(bits_of, steps))
    text += "1" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0")


def file_of(width, height, components, scans):
    """``components``: (across, down) of each; ``scans``: (components of the scan, DC steps in coded order)."""
    out = b"\xff\xd8" + media._segment(0xDB, b"\0" + b"\2" * 64)
    out += media._segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(components)]) + b"".join(bytes([k + 1, a << 4 | d, 0]) for k, (a, d) in enumerate(components)))
    out += media._segment(0xC4, b"\0" + DC_TABLE + b"\x10" + AC_TABLE)
    for own, steps in scans:
        out += media._segment(0xDA, bytes([len(own)]) + b"".join(bytes([k + 1, 0]) for k in own) + bytes([0, 63, 0])) + scan_of(steps)
    return out + b"\xff\xd9"


def test_interleaved_and_separate_scans_of_two_components():
    # 20 x 12: the first component has 4 x 2 blocks in units of 2 x 1, or 3 x 2 in a scan of its own
    dc = np.array([[10, -20, 30, 7], [5, 60, -70, 9]])
    second = np.array([[1, 2], [3, 4]])
    steps, last = [], [0, 0]
    for row in range(2):
        for unit in range(2):
            for k, value in ((0, dc[row, 2 * unit]), (0, dc[row, 2 * unit + 1]), (1, second[row, unit])):
                steps.append(int(value - last[k]))
                last[k] = value
    one = file_of(20, 12, [(2, 1), (1, 1)], [((0, 1), steps)])
    alone = np.diff(dc[:, :3].ravel(), prepend=0).tolist()
    two = file_of(20, 12, [(2, 1), (1, 1)], [((0,), alone), ((1,), np.diff(second.ravel(), prepend=0).tolist())])
    a, b = media.decode_many([one, two])
    light = lambda x: np.clip((2 * x + 1028) // 8, 0, 255)
    assert media.thumbnail(a).tolist() == light(dc).tolist()
    assert media.thumbnail(b).tolist() == light(dc[:, :3]).tolist()
    assert b.coefficients[b.owner == 1, 0].tolist() == second.ravel().tolist()
    assert media.payload_of(a) is None


def test_refused_and_null_files_have_rows(spark):
    good = media.encode(b"x" * 192)
    rows = [(1, 1, good), (2, 2, None), (3, 3, b"GIF89a"), (4, 4, good[:-40]), (5, 5, file_of(8, 8, [(1, 1)], [((0,), [3])]))]
    got = {r["doc_id"]: r for r in media.features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["payload_bytes"] == 192 and got[1]["feature"].startswith("16x16:")
    assert (got[2]["media_bytes"], got[2]["feature"]) == (None, None)
    assert (got[3]["media_bytes"], got[3]["payload_bytes"], got[3]["feature"]) == (6, None, None)
    assert got[5]["payload_bytes"] is None and got[5]["feature"].startswith("8x8:")
    assert media.features(media.media_table(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_slices_equal_one_piece(monkeypatch):
    payload = np.random.default_rng(3).integers(0, 256, 192 * 501).astype(np.uint8).tobytes()
    whole = media.encode(payload)
    monkeypatch.setattr(media, "SLICE", 3 * 7)
    assert media.encode(payload) == whole


def test_memory_of_a_long_payload():
    said = subprocess.run([sys.executable, "-c", "import resource; from voxframe.llm import media; p = b'some plain text, ' * 192 * 5000; assert media.payload_of(media.decode_many([media.encode(p)])[0]) == p; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"], capture_output=True, text=True, check=True)
    assert int(said.stdout) < 1_000_000  # 16 MB in less than 1 GB


@pytest.mark.parametrize("at", range(2, 60, 3))
def test_broken_files_never_crash(at):
    good = media.encode(b"some words " * 192)
    for bad in (good[:at], good[:at] + b"\xff" + good[at + 1 :]):
        assert media.decode_each([bad, good])[1] is not None
