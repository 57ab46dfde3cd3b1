import hashlib
import zlib

import numpy as np
import pytest

from vqloom.llm import media

from .rows import documents, empty


def test_digests_match_brute_force(spark):
    docs = documents(spark)
    want = []
    for r in docs.collect():
        data = (r["text"] or "").encode()
        n = max(1, -(-len(data) // 576)) * 576
        payload = data + b"\xff" * (n - len(data))
        want.append((r["doc_id"], len(data), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    got = [(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.op1_media(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    same = media.op1_media(docs.where("text like 'lorem%'")).drop("doc_id").distinct().count()
    assert same == 1
    assert media.op1_media(empty(spark)).count() == 0


def slow_resize(plane, h, w):
    out = np.zeros((h, w))
    for i in range(h):
        for j in range(w):
            y0, y1, x0, x1 = i * plane.shape[0] / h, (i + 1) * plane.shape[0] / h, j * plane.shape[1] / w, (j + 1) * plane.shape[1] / w
            for y in range(plane.shape[0]):
                for x in range(plane.shape[1]):
                    out[i, j] += plane[y, x] * max(0, min(y + 1, y1) - max(y, y0)) * max(0, min(x + 1, x1) - max(x, x0))
            out[i, j] /= (y1 - y0) * (x1 - x0)
    return out


@pytest.mark.parametrize("shape", [(24, 24), (7, 13), (3, 2), (1, 1), (48, 5)])
def test_area_resize(shape):
    plane = np.random.default_rng(1).integers(0, 256, shape).astype(float)
    assert np.allclose(media.area_resize(plane, 8, 9), slow_resize(plane, 8, 9))


def test_netpbm_and_bmp_decode():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(b"P2 # c\n4 3\n15\n" + b" ".join(b"%d" % v for v in grey.ravel())) == grey).all()
    assert (media.decode(b"P1\n3 2\n1 0 1\n010") == [[0, 1, 0], [1, 0, 1]]).all()
    assert (media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])) == [[0, 1, 0], [1, 0, 1]]).all()
    assert (media.decode(b"P6\n1 2\n255\n" + bytes(range(6))) == np.arange(6).reshape(2, 1, 3)).all()
    assert (media.decode(b"P3\n1 1\n255\n7 8 9") == [[[7, 8, 9]]]).all()
    assert media.decode(b"P5\n1 1\n1000\n\x01\x02")[0, 0] == 258
    rgb = np.random.default_rng(2).integers(0, 256, (5, 3, 3)).astype(np.uint8)
    assert (media.decode(media.encode_bmp(rgb)) == rgb).all()
    for bits, row in ((8, bytes([1, 0, 0, 0])), (4, bytes([0x10, 0, 0, 0])), (1, bytes([0x80, 0, 0, 0]))):
        head = b"BM" + (62 + 4).to_bytes(4, "little") + bytes(4) + (62).to_bytes(4, "little")
        info = b"".join(v.to_bytes(n, "little") for v, n in ((40, 4), (2, 4), (1, 4), (1, 2), (bits, 2), (0, 4), (4, 4), (0, 4), (0, 4), (2, 4), (0, 4)))
        assert (media.decode(head + info + bytes([1, 2, 3, 0, 9, 8, 7, 0]) + row) == [[[7, 8, 9], [3, 2, 1]]]).all()


def test_undecodable_cells_give_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"P5\n2 2\n255\nab")), (3, bytearray(b"?")), (4, bytearray(b"BM")), (5, bytearray(media.store_bytes(b"abc")))], "id int, media binary")
    rows = {r["id"]: r["features"] for r in media.media_features(df).collect()}
    assert [rows[i]["dhash"] is None and bool(rows[i]["error"]) for i in range(1, 6)] == [True] * 4 + [False]
    assert np.load(__import__("io").BytesIO(rows[5]["tile"])).shape == (8, 9)
