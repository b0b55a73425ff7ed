"""Matroska: whole round trips, files of every kind of lacing and of unknown sizes, damaged files."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import matroska as mk

from .conftest import ROWS

PACKETS = [(1, b"a" * 300), (2, b"xy"), (1, b""), (1, b"b" * 5000), (2, b"z" * 255)]


def test_round_trip_of_awkward_rows(docs, no_docs):
    keys = docs.select("doc_id", "text", "tkey", "kept")
    got = mk.digests(mk.media(keys), ["doc_id", "tkey"]).collect()
    want = []
    for k, t in ROWS:
        raw = (t or "").encode()
        raw += b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want.append((k, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:])))
    assert Counter((r.doc_id, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == Counter(want)
    same = {}
    for r in got:  # equal payloads, equal files
        assert same.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert mk.digests(mk.media(no_docs), ["doc_id"]).count() == mk.packets(mk.media(no_docs), ["doc_id"]).count() == 0


def test_packets_and_files_as_tables(docs):
    stored = mk.media(docs.select("doc_id", "text").filter("doc_id between 5 and 9")).cache()
    rows = mk.packets(stored, ["doc_id"]).join(stored, "doc_id").withColumn("frame", mk.frame()).collect()
    for k, t in ROWS[4:8]:
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.packet)
        assert b"".join(r.frame for r in own) == mk.padded(t.encode())
        assert [r.timestamp_ns for r in own] == [n * 12_000_000 for n in range(len(own))] and {r.duration_ns for r in own} == {12_000_000}
    for r in mk.files(stored, ["doc_id"]).collect():
        mine = [x for x in rows if x.doc_id == r.doc_id]
        assert r.clusters == len({x.cluster for x in mine}) == len(r.cues) and r.damage is None and r.duration_ns == 12_000_000 * len(mine)
        assert {c.cluster for c in r.cues} == {x.cluster for x in mine} and r.tracks[0].codec == "A_PCM/INT/LIT"
    nothing = stored.withColumn("media", F.lit(None).cast("binary"))
    assert mk.packets(nothing, ["doc_id"]).count() == 0 and mk.digests(nothing, ["doc_id"]).filter("payload_bytes is null").count() == stored.count()


@pytest.mark.parametrize("lacing", ["none", "xiph", "fixed", "ebml", "mixed"])
@pytest.mark.parametrize("unknown", [False, True])
def test_every_lacing(lacing, unknown):
    """Random frames of two tracks in simple blocks and groups, clusters of known and unknown size, with void and checksum elements."""
    rng = random.Random(5)
    size = lambda body: b"\x01" + b"\xff" * 7 if unknown else mk.vint(len(body), 8)
    want, clusters = [], []
    for c in range(4):
        body = mk.element(mk.TIMESTAMP, mk.uint(1000 * c)) + mk.element(0xEC, b"void") + mk.element(0xBF, b"\0\0\0\0")
        for k in range(6):
            kind = rng.choice(mk.LACINGS) if lacing == "mixed" else lacing
            n = 1 if kind == "none" else rng.randint(1, 40)
            width = rng.choice([0, 3, 254, 255, 256, 700, 20_000])
            frames = [rng.randbytes(width if kind == "fixed" else rng.choice([0, width, 1, 255, 510, 63, 64, 8191])) for _ in range(n)]
            track, at = rng.choice([1, 200]), rng.randint(-50, 900)
            block = mk.vint(track) + struct.pack(">hB", at, mk.LACINGS.index(kind) << 1) + (mk.laced([len(f) for f in frames], kind) if kind != "none" else b"") + b"".join(frames)
            group = k % 2
            body += mk.element(mk.GROUP, mk.element(mk.BLOCK, block), mk.element(mk.BLOCK_DURATION, mk.uint(n * 7)), *([mk.element(mk.REFERENCE, b"\xff")] if k % 4 == 1 else [])) if group else mk.element(mk.SIMPLE_BLOCK, block)
            step = 7_000_000 if group else None
            want += [(track, (1000 * c + at) * 1_000_000 + i * (step or 0), f, k % 4 != 1 if group else False) for i, f in enumerate(frames)]
        clusters.append(mk.uint(mk.CLUSTER) + size(body) + body)
    inside = mk.element(mk.INFO, mk.element(mk.SCALE, mk.uint(1_000_000))) + b"".join(clusters) + mk.element(mk.TAGS, b"")
    raw = mk._HEAD + mk.uint(mk.SEGMENT) + size(inside) + inside
    got = mk.parse(raw)
    assert got.damage is None and len(got.clusters) == 4
    assert [(t, when, raw[p : p + n], key) for t, when, _, p, n, key, _, _ in got.packets] == want


def test_damage_keeps_what_comes_before():
    whole = mk.write(random.Random(1).randbytes(576 * 300))
    packets = mk.parse(whole).packets
    for cut in [0, 3, 4, 40, 200, 5000, len(whole) // 2, len(whole) - 1]:
        found = mk.parse(whole[:cut])
        assert found.damage is not None and found.packets == packets[: len(found.packets)]
        assert len(found.packets) >= sum(x[3] + 8 * 576 < cut for x in packets) - 8
    assert mk.parse(b"no media").damage == 0 and mk.parse(b"\x1a\x45\xdf\xa3").damage is not None


def test_cues_find_the_cluster():
    raw = mk.write(random.Random(2).randbytes(576 * 1000))
    every = mk.parse(raw)
    for ns in (0, 1, 1_536_000_000, 5_000_000_000, 11_999_000_000, 99_000_000_000):
        first = max(when for when, _, _ in every.cues if when <= ns)
        place = next(p for when, _, p in every.cues if when == first)
        assert mk.seek(raw, ns) == [x for x in every.packets if x[7] == place]
    assert mk.seek(raw, 0, track=9) == []


def test_numbers_of_every_width():
    for n in [0, 1, 126, 127, 128, 16_382, 16_383, 2**21 - 2, 2**28 - 2, 2**35, 2**49 - 2, 2**56 - 2]:
        assert mk.read_vint(mk.vint(n), 0, 8) == (n, len(mk.vint(n)))
    assert mk.read_vint(b"\xff", 0, 1) == (-1, 1)
    for bad in (b"", b"\0", b"\x40"):
        with pytest.raises(mk.Damage):
            mk.read_vint(bad, 0, len(bad))
