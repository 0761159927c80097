import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import bpe, media, packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=2500), min_size=1, max_size=5))
def test_payload_round_trip(texts):
    payloads = [media.padded(t) for t in texts]
    assert all(len(p) % 576 == 0 and p for p in payloads)
    stored = media.encode_payloads(payloads)
    got = media.decode(stored)
    assert [p for p, _ in got] == payloads
    assert media.encode_payloads(payloads[:1]) == stored[:1]
    alone = media.decode(stored[-1:])[0][1]
    assert (alone == got[-1][1]).all() and media.feature_of(alone) == media.feature_of(got[-1][1])


def test_coefficients_with_zeros_and_the_inverse_transform():
    rng = np.random.default_rng(0)
    coef = rng.integers(128, 256, (12, 64)) * rng.choice([-1, 1], (12, 64))
    # Zeros alone or at the end of a block, whole blocks of zeros, and full blocks.
    coef[rng.random(12) < 0.5, 3::4] = 0
    coef[2, 40:] = 0
    coef[5], coef[7] = 0, 0
    image = media._parse(media.encode_coefficients(coef, [(2, 1)], [b""])[0])
    got, _ = media.coefficients([image])
    luma = media._scan_blocks((0,), 2, 1)
    assert (got[: len(luma)] == coef[luma]).all()
    # Against the textbook sum for one block.
    c = np.zeros(64)
    small = coef[:1] // 16
    c[media.ZIGZAG] = small[0]
    c = c.reshape(8, 8)
    s = lambda u: np.sqrt(0.125) if u == 0 else 0.5
    want = [[sum(s(u) * s(v) * c[u, v] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    assert np.abs(media._samples(small.astype(np.int32), np.ones(64, np.int32)).reshape(8, 8).astype(int) - np.clip(np.array(want) + 128, 0, 255)).max() <= 0.51


def test_refinement_places_new_coefficients():
    """A hand-made refinement scan: a new coefficient behind one zero, passing one that is known."""
    table = media.AC_TABLE
    put = lambda pairs: "".join(f"{int(v):0{int(n)}b}" for v, n in pairs if n)
    text = put([(table.code[0x01], table.size[0x01]), (1, 1), (1, 1)]) + put([(table.code[0], table.size[0])])
    raw = bytes(int(text.ljust(-(-len(text) // 8) * 8, "1")[i : i + 8], 2) for i in range(0, len(text), 8))
    coef = np.zeros((1, 64), np.int32)
    coef[0, 1] = 2
    media._refine_band(media._Bits([raw]), coef, np.array([0]), np.array([0]), np.array([1]), 1, 63, 0, table)
    assert coef[0, :4].tolist() == [0, 3, 1, 0]


def test_media_query(spark, small):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op2_media_progressive_jpeg(spark, small).collect():
        p = texts[r.doc_id] + b"\xff" * (max(1, -(-len(texts[r.doc_id]) // 576)) * 576 - len(texts[r.doc_id]))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


def test_media_of_odd_rows(odd, empty):
    stored = media.to_media(odd)
    got = {r.doc_id: r for r in media.from_media(stored).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    assert all(bytes(r.payload)[: r.n_bytes] == texts[i] and len(r.rgb) == 3 * r.height * r.width for i, r in got.items())
    assert media.from_media(stored.selectExpr("doc_id", "cast(null as binary) as media", "1 as payload")).where("payload is null").count() == odd.count()
    assert media.from_media(media.to_media(empty)).count() == 0


def test_strips_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    payloads = [media.padded(rng.integers(0, 256, n, dtype=np.uint8).tobytes()) for n in (0, 5000, 60000)]
    stored = media.encode_payloads(payloads)
    got = media.decode(stored)
    monkeypatch.setattr(media, "STRIP_BLOCKS", 20)
    monkeypatch.setattr(media, "STRIP_SAMPLES", 700)
    assert media.encode_payloads(payloads) == stored
    for (p, rgb), (q, again), want in zip(got, media.decode(stored), payloads):
        assert p == q == want and (rgb == again).all() and media.feature_of(rgb) == media.feature_of(again)


def foreign(spark, width, height, rgb, quality):
    """A progressive JPEG by Java's own writer, and what its reader makes of it."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    image = jvm.java.awt.image.BufferedImage(width, height, 1)
    numbers = gateway.new_array(jvm.int, width * height)
    for i, (r, g, b) in enumerate(rgb.reshape(-1, 3).tolist()):
        numbers[i] = r << 16 | g << 8 | b
    image.setRGB(0, 0, width, height, numbers, 0, width)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(1)
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.close()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    raster = np.array(list(back.getRGB(0, 0, width, height, None, 0, width)), np.int64) & 0xFFFFFF
    return data, np.stack([raster >> 16, raster >> 8 & 255, raster & 255], axis=1).reshape(height, width, 3)


def test_images_of_another_encoder(spark):
    rng = np.random.default_rng(5)
    y, x = np.mgrid[0:75, 0:101]
    smooth = np.stack([128 + 100 * np.sin(x / 15), 128 + 90 * np.cos(y / 11), (x + y) % 256 * 0.6 + 40], axis=2)
    for rgb, quality, most in ((smooth, 0.9, 2.5), (np.clip(smooth + rng.normal(0, 12, smooth.shape), 0, 255), 0.5, 4.0), (np.full(smooth.shape, 77.0), 0.3, 1.0)):
        data, want = foreign(spark, 101, 75, rgb.astype(np.uint8), quality)
        ((payload, got),) = media.decode([data])
        assert data.count(b"\xff\xda") > 3 and payload == b"" and got.shape == want.shape
        # Readers differ in how they upsample chroma and round; the grey values hardly do.
        grey = lambda z: z @ np.array([0.299, 0.587, 0.114])
        assert np.abs(grey(got) - grey(want)).mean() < most and np.abs(got - want).mean() < 3 * most


def test_bytes_that_are_no_such_image_disturb_nothing(spark):
    good = media.encode_payloads([media.padded(b"some text" * 100), media.padded(b"")])
    bad = [b"", b"\xff\xd8", b"no image", good[0][:400], good[0][:-300] + b"\xff\xd9", b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x10\x00\x10\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00\xff\xd9", good[0].replace(b"\xff\xc2\x00\x11\x08\x00", b"\xff\xc2\x00\x11\x08\xff", 1), good[0][:300] + bytes(200) + good[0][500:], None]
    rows = [(i, b) for i, b in enumerate([good[0], *bad, good[1], good[0]])]
    got = {r.i: r for r in media.from_media(spark.createDataFrame(rows, "i int, media binary").coalesce(1)).collect()}
    assert len(got) == len(rows)
    for i in (0, len(rows) - 2, len(rows) - 1):
        assert got[i].error is None and bytes(got[i].payload) == media.padded(b"some text" * 100 if i != len(rows) - 2 else b"")
    for i in (1, 2, 3, 6):
        assert got[i].error and got[i].payload is None and got[i].rgb is None
    assert got[len(bad)].error is None and got[len(bad)].payload is None


def brute_rows(lens, size):
    rows = []
    for i in sorted(range(len(lens)), key=lambda i: -lens[i]):
        fit = [r for r in rows if r[0] >= lens[i]]
        if fit:
            least = min(r[0] for r in fit)
            fit = [r for r in fit if r[0] == least][0]
            fit[0] -= lens[i]
        else:
            rows.append([size - lens[i]])
    return sorted(r[0] for r in rows)


def test_best_fit_decreasing_equals_a_scan():
    random.seed(1)
    for _ in range(60):
        size = random.choice([1, 2, 7, 64, 100])
        lens = np.array([random.randint(1, size) for _ in range(random.randint(0, 80))], dtype=np.int64)
        rows = packing.best_fit_decreasing(lens, size)
        assert sorted(i for r in rows for i in r) == list(range(len(lens)))
        assert sorted(size - int(lens[r].sum()) for r in rows) == brute_rows(lens.tolist(), size)


@pytest.mark.parametrize("size", [16, 2048])
def test_packing_is_lossless(odd, empty, size):
    rows = packing.pack(odd, PATH, size=size, pad=50257).collect()
    want = {}
    for r in bpe.encode(odd, PATH).collect():
        want.setdefault(r.doc_id, []).append(np.frombuffer(bytes(r.ids), "<u4"))
    got = {}
    for r in rows:
        ids, position = np.frombuffer(bytes(r.ids), "<u4"), np.frombuffer(bytes(r.position_ids), "<u4")
        assert len(ids) == size == len(position) and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 50257).all()
        for d, s, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert position[a:b].tolist() == list(range(b - a))
            got.setdefault(d, []).append((s, ids[a:b]))
    for d, texts in want.items():
        assert sorted(np.concatenate(texts).tolist()) == sorted(np.concatenate([x for _, x in got.get(d, [(0, np.zeros(0, int))])]).tolist())
        if len(texts) == 1 and len(texts[0]):
            assert np.concatenate([x for _, x in sorted(got[d], key=lambda y: y[0])]).tolist() == texts[0].tolist()
    assert packing.pack(empty, PATH).count() == 0


def profile(rows):
    """What packing decides: the rows of each block with their segments."""
    return sorted((r.block, r.row_in_block, r.n_tokens, tuple(map(str, r.doc_ids)), tuple(r.doc_starts), bytes(r.ids)) for r in rows)


def test_packing_doesnt_depend_on_tasks(spark, small, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_BYTES", 100_000)
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("concat('d', doc_id) as doc_id", "text")
    one, many = (packing.pack(docs.repartition(n), PATH, size=256, pad=50257, end=50256).collect() for n in (1, 7))
    assert profile(one) == profile(many) and len({r.block for r in one}) > 3
    assert {x for r in one for x in r.doc_ids} == {r.doc_id for r in docs.collect()}
    # Each block is packed as a plain scan packs it, and as full as the whole table could be, but for a row of each block.
    for block in {r.block for r in one}:
        own = [r for r in one if r.block == block]
        lens = [b - a for r in own for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:])]
        assert sorted(256 - r.n_tokens for r in own) == brute_rows(lens, 256)
    whole = len(brute_rows([b - a for r in one for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:])], 256))
    assert len(one) <= whole + len({r.block for r in one})


def test_a_flood_of_copies_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_BYTES", 20_000)
    d = spark.createDataFrame([(None, "the same text again and again")] * 3000 + [(i, f"row {i}") for i in range(50)], "doc_id long, text string")
    rows = packing.pack(d, PATH, size=64, pad=50257).collect()
    assert len({r.block for r in rows}) > 2
    assert sum(x is None for r in rows for x in r.doc_ids) == 3000 and {x for r in rows for x in r.doc_ids if x is not None} == set(range(50))
    monkeypatch.setattr(packing, "MOST_TOKENS", 500)
    again = packing.pack(d, PATH, size=64, pad=50257).collect()
    assert sum(r.n_tokens for r in again) == sum(r.n_tokens for r in rows) and len({(r.block, r.row_in_block) for r in again}) == len(again)


def test_copies_go_by_their_number(spark, monkeypatch, tmp_path):
    """400 copies of one row, wherever they are read."""
    monkeypatch.setattr(packing, "BLOCK_BYTES", 4000)
    d = spark.createDataFrame([(7, "copied again and again " * 5)] * 400 + [(None, None)] * 90 + [(i, f"row {i} " * 9) for i in range(100)], "doc_id long, text string")
    found = []
    for n in (1, 4, 9):
        d.repartition(n, "text" if n == 4 else "doc_id").write.parquet(str(tmp_path / f"p{n}")) if n > 1 else d.coalesce(1).write.parquet(str(tmp_path / "p1"))
        found.append(profile(packing.pack(spark.read.parquet(str(tmp_path / f"p{n}")), PATH, size=64, pad=50257, end=50256).collect()))
    assert found[0] == found[1] == found[2] and len({r[0] for r in found[0] if "7" in r[3]}) > 1
    assert sum(x == "7" for r in found[0] for x, at in zip(r[3], r[4], strict=True) if at == 0) == 401
