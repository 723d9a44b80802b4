"""Operator 7's archives: members across byte ranges, retries by offset, damaged members, and its features against plain code."""

import hashlib
import json
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs

from lodestar.llm import media


@pytest.fixture
def archive(tmp_path):
    bodies = [bytes([i]) * (i * 37 % 500 + 1) for i in range(60)]
    writer = media.MediaWriter({"path": str(tmp_path), "archiveBytes": 4000})
    batch = pa.RecordBatch.from_pydict({"member": [f"{i}-0" for i in range(60)], "media": pa.array(bodies, pa.binary())})
    writer.commit([writer.write(iter([batch])), None])
    return tmp_path, bodies


@pytest.mark.parametrize("size", [1, 97, 1000, 10**6])
def test_ranges_give_each_member_once(archive, size):
    folder, bodies = archive
    reader = media.MediaReader({"path": str(folder), "rangeBytes": size})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((int(r["member"][:-2]), r["media"]) for r in rows) == list(enumerate(bodies))
    assert len(list(folder.glob("*.zip"))) > 1 and not list(folder.glob("*.part"))


def members(path):
    with zipfile.ZipFile(path) as z:
        return [(m.header_offset, m.compress_size, m.CRC) for m in z.infolist()]


def test_a_failed_read_is_tried_again_alone(archive, monkeypatch):
    path = sorted(archive[0].glob("*.zip"))[0]
    source, tried, once = media.Members(fs.LocalFileSystem(), str(path), wait=0), [], media.Members.once

    def flaky(self, at, length, crc):
        tried.append(at)
        if tried.count(at) < 3 and at == members(path)[2][0]:
            raise OSError("lost connection")
        return once(self, at, length, crc)

    monkeypatch.setattr(media.Members, "once", flaky)
    got = [source.read(*m) for m in members(path)]
    assert [zlib.crc32(x) for x in got] == [m[2] for m in members(path)]
    assert [tried.count(m[0]) for m in members(path)] == [3 if k == 2 else 1 for k in range(len(got))]


def test_damage_is_told(archive):
    path = sorted(archive[0].glob("*.zip"))[0]
    at, length, crc = members(path)[1]
    data = bytearray(path.read_bytes())
    data[at + 30 + len("1-0") + length // 2] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(OSError, match="damaged"):
        media.Members(fs.LocalFileSystem(), str(path), wait=0).read(at, length, crc)


def test_an_aborted_write_leaves_nothing(tmp_path):
    writer = media.MediaWriter({"path": str(tmp_path)})
    batch = pa.RecordBatch.from_pydict({"member": ["1-0"], "media": pa.array([b"x"], pa.binary())})
    writer.abort([writer.write(iter([batch])), None])
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("text", ["", "a", "x" * 64, "é" * 33, "some words\n" * 99])
def test_images_and_features(text):
    raw = text.encode()
    payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    image = media.to_png(payload, len(raw))
    assert media.from_png(image) == (payload, len(raw)) and hashlib.sha256(image).digest() == hashlib.sha256(media.to_png(payload, len(raw))).digest()
    told = json.loads(media.feature_of(np.frombuffer(payload, np.uint8), len(raw)))
    assert told["mean"] == pytest.approx(sum(raw) / max(1, len(raw)), abs=1e-3)
    assert told["bands"] == pytest.approx([sum(32 * k <= b < 32 * k + 32 for b in raw) / max(1, len(raw)) for k in range(8)], abs=1e-3)
