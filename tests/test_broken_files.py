"""Files that are not what they seem don't fail the others."""

import io
import zipfile

from recallgrid.sources import files


def test_json_of_odd_shapes():
    assert files.json_text('[{"role": null, "content": "a"}, 3, {"role": "user", "content": null}, {"role": "user", "content": "b"}]') == "Unknown: a\n\nUser: \n\nUser: b"
    assert "mapping" in files.json_text('[{"title": "t", "mapping": [1, 2]}]')
    assert files.json_text("[1, 2]") == "[\n  1,\n  2\n]" and files.json_text("{broken") == "{broken"


def test_broken_member_is_told_of(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.txt", "hello there")
    good, bad = buf.getvalue(), bytearray(buf.getvalue())
    bad[bad.index(b"hello")] ^= 0xFF
    df = spark.createDataFrame([("x/a.zip", bytearray(good)), ("x/b.zip", bad), ("x/c.txt", bytearray(b"plain"))], "path string, content binary")
    got = {r["name"]: r["text"] for r in files.parse_files(df).collect()}
    assert got == {"x/a.zip": "hello there", "x/b.zip": "[ZIP could not be read: BadZipFile]", "x/c.txt": "plain"}
