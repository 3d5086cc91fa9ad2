"""Headers of real, broken and cut-off files."""

import io
import struct

import pytest

from ledgerloom.sources import files as f


def png(w, h, colour=2):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", w, h, 8, colour, 0, 0, 0)


def jpeg(w, h, parts=3):
    app = b"\xff\xe1" + struct.pack(">H", 2 + 5000) + b"\xff\xc0" * 2500
    return b"\xff\xd8" + app + b"\xff\xff\xff\xdb\x00\x04ab" + b"\xff\xc4\x00\x03x" + b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, h, w, parts)


def bmp(w, h, bits=24):
    return b"BM" + bytes(16) + struct.pack("<iiHH", w, h, 1, bits)


def tiff(order, pages, w, h, photometric=2):
    out, at = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8), 8
    for k in range(pages):
        entries = [(256, 4, struct.pack(order + "I", w)), (257, 3, struct.pack(order + "HH", h, 0)), (262, 3, struct.pack(order + "HH", photometric, 0))]
        at += 2 + 12 * len(entries) + 4
        out += struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", t, kind, 1) + v for t, kind, v in entries) + struct.pack(order + "I", at if k + 1 < pages else 0)
    return out


PDF = b"%PDF-1.7\n1 0 obj << /Type /Pages /Count 2 >>\n2 0 obj << /Type /Page /MediaBox [ 0 0 612 792 ] >>\n3 0 obj <</Type/Page>>\n\xff\xfe"
FILES = {
    "a.png": (png(640, 480), (640, 480, "RGB", 1)), "grey.PNG": (png(2000, 1, 0), (2000, 1, "L", 1)), "b.jpg": (jpeg(1234, 777), (1234, 777, "RGB", 1)),
    "c.jpeg": (jpeg(30, 40, 4), (30, 40, "CMYK", 1)), "d.bmp": (bmp(300, -200), (300, 200, "RGB", 1)), "e.tiff": (tiff("<", 3, 800, 600), (800, 600, "RGB", 3)),
    "f.tiff": (tiff(">", 1, 70000, 20, 1), (70000, 20, "L", 1)), "g.pdf": (PDF, (1700, 2200, "RGB", 2)),
}


def test_files_of_each_kind(spark, tmp_path):
    broken = {"cut.png": png(640, 480)[:18], "not.png": bmp(1, 1), "cut.jpg": jpeg(10, 10)[:300], "end.jpg": b"\xff\xd8\xff\xd9", "one.bmp": b"B", "cut.tiff": tiff("<", 1, 8, 6)[:20],
        "loop.tiff": b"II*\0" + struct.pack("<I", 8) + struct.pack("<HI", 0, 8), "no.pdf": b"%PDF-1.4 nothing", "far.tiff": b"MM\0*" + struct.pack(">I", 2**31)}
    for name, data in {**{k: v for k, (v, _) in FILES.items()}, **broken, "x.txt": b"text"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rpartition("/")[2]: r for r in f.load_documents(spark, str(tmp_path)).collect()}
    for name, (_, want) in FILES.items():
        r = rows[name]
        assert ((r.width, r.height, r.stored_mode, r.pages), r.error, r.mode) == (want, None, "RGB"), name
    for name in broken:
        r = rows[name]
        assert r.error == f"load error: no {name.rpartition('.')[2]} header" and r.width is None and r.mode is None, name
    assert rows["x.txt"].error == "unsupported format: txt"
    valid = {r.path.rpartition("/")[2] for r in f.valid_documents(f.load_documents(spark, str(tmp_path))).collect()}
    assert valid == {"a.png", "b.jpg", "d.bmp", "e.tiff", "g.pdf"}


def test_plain_columns_open_no_file(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(640, 480))
    plan = f.load_documents(spark, str(tmp_path)).select("path", "extension", "size")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_against_an_image_library(spark, tmp_path):
    image = pytest.importorskip("PIL.Image")
    for name, mode, kind in (("a.png", "RGBA", "PNG"), ("b.jpg", "L", "JPEG"), ("c.bmp", "RGB", "BMP"), ("d.tiff", "RGB", "TIFF")):
        out = io.BytesIO()
        image.new(mode, (321, 234)).save(out, kind)
        (tmp_path / name).write_bytes(out.getvalue())
    got = {r.path.rpartition("/")[2]: (r.width, r.height, r.stored_mode) for r in f.load_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (321, 234, "RGBA"), "b.jpg": (321, 234, "L"), "c.bmp": (321, 234, "RGB"), "d.tiff": (321, 234, "RGB")}


def test_files_are_read_once_in_one_function(spark):
    """Walks over a file's bytes are no interpreted expressions, and filters on what was found do not read it again."""
    from ledgerloom.sources import headers as h

    assert all(h.header_of(name.rpartition(".")[2].lower(), data) == want for name, (data, want) in FILES.items())
    assert h.header_of("txt", b"text") == h.header_of("png", None) == (None,) * 4
    rows = spark.createDataFrame([("a.png", "png", None, 33, bytearray(png(640, 480)))], "path string, extension string, error string, size int, content binary")
    plan = f.valid_documents(h.with_headers(rows)).select("path", "width")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambdafunction" not in plan
