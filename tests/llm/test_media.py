import hashlib
import zlib

import numpy as np
import pytest
from helpers import AWKWARD, documents, prose

from lindero.llm import media
from lindero.llm.queries import op2_media_jpeg


def padded(text):
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def test_round_trip_of_the_query(spark, tmp_path):
    rows = AWKWARD + [(30, prose(1, 9000)), (31, "ÿ" * 777)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = op2_media_jpeg(spark, str(tmp_path)).collect()
    want = sorted(((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, (n, p) in ((i, padded(t)) for i, t in rows)), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=repr) == want
    by = {r.doc_id: r for r in got}
    assert by[7].media_bytes > 64 and len({(r.media_sha256, r.feature) for r in got if r.doc_id in (1, 2)}) <= 2
    assert all(r.feature for r in got)


def test_bytes_of_all_kinds_and_batches():
    r = np.random.default_rng(0)
    few = r.choice(np.array([128, 129, 127, 126, 130, 0], np.uint8), 5000, p=[0.8, 0.05, 0.05, 0.04, 0.03, 0.03]).tobytes()
    payloads = [b"", b"\x80" * 1000, b"\x80" * 500 + b"\x81" * 3 + b"\x80" * 900 + b"\x7f", r.integers(0, 256, 30000, np.uint8).tobytes(), few, bytes(range(256)) * 9]
    files = media.encode(payloads)
    assert files == [media.encode([p])[0] for p in payloads]
    together = media.decode(files)
    for p, f, d in zip(payloads, files, together):
        assert d["error"] is None and media.payload(d["picture"], d["coef"]) == (len(p), p.ljust(max(64, -(-len(p) // 64) * 64), b"\0"))
        assert (media.decode([f])[0]["rgb"] == d["rgb"]).all()


def test_broken_files_leave_others_alone(spark):
    good = media.encode([b"hello" * 100])[0]
    cases = [None, b"", b"junk", good[:200], good[:-200], good[:300] + b"\0" * 60 + good[360:], good]
    got = media.decode(cases)
    assert "rgb" in got[-1] and got[0] == {"error": None}
    assert all(got[i]["error"] for i in (1, 2, 3))
    df = spark.createDataFrame([(i, c, "x") for i, c in enumerate(cases)], "doc_id long, media binary, error string")
    out = {r.doc_id: r for r in media.to_tensors(df).collect()}
    assert out[0].rgb is None and out[0].error is None and out[2].error and len(out[6].rgb) == out[6].height * out[6].width * 3
    assert media.read_back(df.limit(0)).count() == 0


def head_of(good):
    """Where the entropy-coded bytes of the first scan begin."""
    at = good.index(b"\xff\xda")
    return at + 2 + int.from_bytes(good[at + 2 : at + 4], "big")


def test_any_cut_or_flipped_header_leaves_others_alone():
    good, head = media.encode([b"hello" * 100])[0], 0
    head, r = head_of(good), np.random.default_rng(7)
    want = media.decode([good])[0]["rgb"]
    cases = [good[:n] for n in range(0, head + 40, 3)]
    for at in range(2, head):
        for x in (0, 255, int(r.integers(256))):
            cases.append(good[:at] + bytes([x]) + good[at + 1 :])
    for _ in range(300):  # anywhere
        x = bytearray(good)
        for at in r.integers(2, len(good), 3):
            x[at] ^= 1 << int(r.integers(8))
        cases.append(bytes(x))
    got = media.decode([y for x in cases for y in (x, good)])
    for x in got[1::2]:
        assert x["error"] is None and (x["rgb"] == want).all()
    for x in got[::2]:
        assert x["error"] or x["rgb"].shape == (x["picture"].height, x["picture"].width, 3)
    assert sum(bool(x["error"]) for x in got[::2]) > 300


def swapped(good, marker, change):
    at = good.index(marker) + 4
    n = int.from_bytes(good[at - 2 : at], "big") - 2
    body = change(good[at : at + n])
    return good[: at - 2] + (len(body) + 2).to_bytes(2, "big") + body + good[at + n :]


@pytest.mark.parametrize("marker,change,error", [
    (b"\xff\xc4", lambda b: b[:-3], "code table"), (b"\xff\xc4", lambda b: b"\0" + b"\xff" * 16 + b[17:], "code table"), (b"\xff\xdb", lambda b: b[:20], "quantiser"),
    (b"\xff\xc2", lambda b: b[:1] + b"\x40\0\x40\0" + b[5:], "more blocks"), (b"\xff\xc2", lambda b: b[:7] + b"\0" + b[8:], "sampling"), (b"\xff\xdd", lambda b: b"", "restart"),
    (b"\xff\xda", lambda b: b[:-1] + b"\x0f", "scan"), (b"\xff\xfe", lambda b: b[:8] + b"\xff" * 16, None),
])
def test_what_is_wrong_is_named(marker, change, error):
    good = media.encode([b"hello" * 100])[0]
    got = media.decode([swapped(good, marker, change), good])
    assert got[1]["error"] is None
    if error:
        assert error in got[0]["error"]
    else:
        with pytest.raises(ValueError, match="payload"):
            media.payload(got[0]["picture"], got[0]["coef"])


@pytest.mark.parametrize("width,height,gray", [(70, 45, False), (16, 16, False), (33, 100, True), (129, 65, False)])
def test_files_by_another_encoder(spark, width, height, gray):
    """The JVM's own writer makes progressive files with all kinds of scans; its reader decodes them too."""
    jvm = spark._jvm
    io, image = jvm.javax.imageio, jvm.java.awt.image.BufferedImage
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    rgb = np.stack([(x * 3 + y) % 256, (np.sin(x / 9) * 90 + 128), (y * 2 + 30) % 256], -1).clip(0, 255).astype(int)
    if gray:
        rgb = rgb[..., :1].repeat(3, -1)
    picture = image(width, height, image.TYPE_BYTE_GRAY if gray else image.TYPE_INT_RGB)
    for j in range(height):
        for i in range(width):
            r, g, b = rgb[j, i].tolist()
            if gray:
                picture.getRaster().setSample(i, j, 0, r)
            else:
                picture.setRGB(i, j, (r << 16) | (g << 8) | b)
    writer = io.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(io.ImageWriteParam.MODE_DEFAULT)
    param.setCompressionMode(io.ImageWriteParam.MODE_EXPLICIT)
    param.setCompressionQuality(0.9)
    stream = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(io.ImageIO.createImageOutputStream(stream))
    writer.write(None, io.IIOImage(picture, None, None), param)
    writer.getOutput().flush()
    data = bytes(stream.toByteArray())
    got = media.decode([data])[0]
    assert got["error"] is None and got["rgb"].shape == (height, width, 3)
    theirs = io.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    want = np.array([[theirs.getRaster().getSample(i, j, 0) if gray else theirs.getRGB(i, j) for i in range(width)] for j in range(height)])
    want = want[..., None].repeat(3, -1) if gray else np.stack([(want >> s) & 255 for s in (16, 8, 0)], -1)
    off = np.abs(want - got["rgb"].astype(int))
    assert off.mean() < (0.6 if gray else 6) and np.median(off) <= (1 if gray else 4)
    assert len(got["picture"].scans) > 3 and {s[3] > 0 for s in got["picture"].scans} == {False, True}
    ours = io.ImageIO.read(jvm.java.io.ByteArrayInputStream(media.encode([b"abc" * 300])[0]))
    assert ours.getWidth() % 16 == 0
