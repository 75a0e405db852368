import base64
import struct

import pytest

from tessera.sources import images, readers

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480) + b"\x08\x02\x00\x00\x00"
GIF = b"GIF89a" + struct.pack("<HH", 33, 44) + b"\x80\x00\x00"
JPEG = b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF\x00" + b"\x00" * 9 + b"\xff\xff\xfe" + struct.pack(">H", 6) + b"text" + b"\xff\xc2" + struct.pack(">HBHH", 11, 8, 77, 88) + b"\x01" * 6
WEBP = {
    "VP8X": b"RIFF\x00\x00\x00\x00WEBPVP8X" + b"\x00" * 8 + struct.pack("<I", 99)[:3] + struct.pack("<I", 49)[:3],
    "VP8 ": b"RIFF\x00\x00\x00\x00WEBPVP8 " + b"\x00" * 10 + struct.pack("<HH", 100, 50),
    "VP8L": b"RIFF\x00\x00\x00\x00WEBPVP8L" + b"\x00" * 4 + b"\x2f" + struct.pack("<I", 99 | 49 << 14),
}


def test_headers():
    assert images.header(PNG) == ("png", 640, 480) and images.header(GIF) == ("gif", 33, 44) and images.header(JPEG) == ("jpeg", 88, 77)
    assert {images.header(x) for x in WEBP.values()} == {("webp", 100, 50)}
    for whole, name in ((PNG, "png"), (GIF, "gif"), (JPEG, "jpeg"), (WEBP["VP8X"], "webp")):
        for n in range(len(whole)):  # a header that is cut off is no error
            kind, width, height = images.header(whole[:n])
            assert kind in (None, name) and (width is None) == (height is None)
    assert images.header(None) == images.header(b"") == images.header(b"text") == (None, None, None)
    assert images.header(b"\xff\xd8" + b"\x00" * 50) == ("jpeg", None, None)


def test_images_of_every_kind(spark, tmp_path):
    root = str(tmp_path / "pictures")
    rows = spark.createDataFrame([("a b.png", PNG), ("deep/er/c.jpg", JPEG), ("bad.gif", b"no image at all, but a long text")], "path string, content binary")
    assert images.write_files(rows, "path", "content", root) == 3
    asked = [
        (1, "a b.png"), (2, "./deep/er/c.jpg"), (3, "bad.gif"), (4, "none.png"), (5, None), (6, ""), (7, "https://x.example/g.gif"), (8, "https://x.example/fails"),
        (9, "data:image/gif;base64," + base64.b64encode(GIF).decode()), (10, base64.b64encode(PNG * 2).decode()),
    ]
    gif = GIF

    def fetch(url):
        if "fails" in url:
            raise TimeoutError("slow")
        return gif

    df = spark.createDataFrame(asked, "id long, picture string")
    got = {r.id: (r.kind, r.format, r.width, r.height, r.error) for r in images.load(df, "picture", root, fetch).collect()}
    assert got == {
        1: ("path", "png", 640, 480, None), 2: ("path", "jpeg", 88, 77, None), 3: ("path", None, None, None, "no image format"), 4: ("path", None, None, None, "no such file"),
        5: ("empty", None, None, None, "no image"), 6: ("empty", None, None, None, "no image"), 7: ("url", "gif", 33, 44, None), 8: ("url", None, None, None, "TimeoutError: slow"),
        9: ("base64", "gif", 33, 44, None), 10: ("base64", "png", 640, 480, None),
    }
    assert images.load(df, "picture").where("kind = 'path' AND error = 'no such file'").count() == 4


def test_task_files_are_strict(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    read = lambda path: [r.id for r in readers.json_data(spark, path, "id long", strict=True).collect()]
    assert sorted(read(put("a.json", ' \n[{"id": 1}, {"id": 2}]'))) == [1, 2]
    assert read(put("b.json", '{"data": [{"id": 3}]}')) == [3] and read(put("c.jsonl", '{"id": 4}\n\n')) == [4]
    with pytest.raises(ValueError, match="neither"):
        read(put("d.json", '{"id": 1}'))
    with pytest.raises(FileNotFoundError):
        read(str(tmp_path / "none.json"))
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        read(put("e.json", "[{bad"))
