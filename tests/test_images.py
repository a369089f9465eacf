"""Image files of every depth, sizes from headers, and a writer that leaves whole folders or none."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import formats, raster


def png(values, colour, filters=(0,)):
    """A PNG file, its rows filtered by the given kinds in turn."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = values.shape[:2]
    channels = 1 if values.ndim == 2 else values.shape[2]
    bits = 8 * values.itemsize
    step = channels * values.itemsize
    rows = values.astype(values.dtype.newbyteorder(">")).reshape(h, -1).view(np.uint8).astype(int)
    raw, above = b"", np.zeros(rows.shape[1], int)
    for y, row in enumerate(rows):
        kind = filters[y % len(filters)]
        left, corner = (np.append(np.zeros(step, int), r[:-step]) for r in (row, above))
        p = left + above - corner
        d = [abs(p - left), abs(p - above), abs(p - corner)]
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
        near = [0, left, above, (left + above) // 2, paeth][kind]
        raw += bytes([kind]) + ((row - near) % 256).astype(np.uint8).tobytes()
        above = row
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def hdr(values, coded):
    """A Radiance file with run-length coded rows, or plain ones."""
    h, w, _ = values.shape
    out = b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n" + f"-Y {h} +X {w}\n".encode()
    for y in range(h):
        if not coded:
            out += values[y].tobytes()
            continue
        out += bytes([2, 2, w >> 8, w & 255])
        for c in range(4):
            row, x = values[y, :, c], 0
            while x < w:
                n = 1
                while x + n < w and n < 127 and row[x + n] == row[x]:
                    n += 1
                out += bytes([128 + n, row[x]]) if n > 2 else bytes([n, *row[x : x + n]])
                x += n
    return out


def test_formats():
    rng = np.random.default_rng(1)
    for dtype, most in ((np.uint8, 255), (np.uint16, 65535)):
        for channels, colour in ((1, 0), (2, 4), (3, 2), (4, 6)):
            values = rng.integers(0, most + 1, (7, 9, channels)).astype(dtype)
            data = png(values, colour, (0, 1, 2, 3, 4))
            assert formats.header(data) == ("png", 9, 7, channels, 8 * values.itemsize)
            assert np.array_equal(formats.decode(data)[0], values / most)
    for kind, channels in ((5, 1), (6, 3)):
        for most, dtype in ((255, ">u1"), (1000, ">u2")):
            values = rng.integers(0, most + 1, (4, 5, channels)).astype(dtype)
            data = f"P{kind}\n# made\n5 4\n{most}\n".encode() + values.tobytes()
            assert formats.header(data)[1:3] == (5, 4) and np.allclose(formats.decode(data)[0], values / most)
    assert np.allclose(formats.decode(b"P2 3 1 10\n0 5 10\n")[0].ravel(), [0, 0.5, 1])
    assert formats.decode(b"P1\n3 2\n1 0 1\n0 1 0\n")[0].ravel().tolist() == [0, 1, 0, 1, 0, 1]
    assert formats.decode(b"P4\n3 2\n\xa0\x40")[0].ravel().tolist() == [0, 1, 0, 1, 0, 1]
    rgbe = rng.integers(0, 256, (3, 12, 4)).astype(np.uint8)
    rgbe[1, 2:9] = rgbe[1, 2]
    rgbe[:, :, 3] = rng.integers(120, 140, (3, 12))
    want = rgbe[:, :, :3] * 2.0 ** (rgbe[:, :, 3:].astype(float) - 136)
    for coded in (True, False):
        data = hdr(rgbe, coded)
        assert formats.header(data) == ("hdr", 12, 3, 3, 32)
        values, linear = formats.decode(data)
        assert linear and np.allclose(values, want)
    for broken in (b"", b"P6\n", b"GIF89a\1\0\2\0", b"text", png(values[:2, :2].astype(np.uint8), 2)[:40]):
        with pytest.raises((ValueError, IndexError, struct.error, zlib.error)):
            formats.decode(broken)


def test_deep_files_are_read(spark, tmp_path):
    rng = np.random.default_rng(2)
    deep = rng.integers(0, 65536, (3, 4, 3)).astype(np.uint16)
    (tmp_path / "deep.png").write_bytes(png(deep, 2, (4, 3)))
    (tmp_path / "grey.pgm").write_bytes(b"P5 4 3 65535\n" + deep[:, :, 0].astype(">u2").tobytes())
    rgbe = rng.integers(100, 140, (3, 4, 4)).astype(np.uint8)
    (tmp_path / "light.HDR").write_bytes(hdr(rgbe, False))
    (tmp_path / "plain.png").write_bytes(png((deep >> 8).astype(np.uint8), 2))
    found = {}
    for r in raster.read_images(spark, str(tmp_path), gamma=2.0, deep=True).collect():
        found.setdefault(r["image_id"].rsplit("/", 1)[-1], {})[r["pid"]] = (r["c0"], r["c1"], r["c2"])
    values = {k: np.array([v[i] for i in range(12)]).reshape(3, 4, 3) for k, v in found.items()}
    assert np.allclose(values["deep.png"], (deep / 65535.0) ** 2)
    assert np.allclose(values["plain.png"], ((deep >> 8) / 255.0) ** 2)
    assert np.allclose(values["grey.pgm"], np.repeat((deep[:, :, :1] / 65535.0) ** 2, 3, 2))
    assert np.allclose(values["light.HDR"], rgbe[:, :, :3] * 2.0 ** (rgbe[:, :, 3:].astype(float) - 136))
    # Names are looked at before files are.
    one = raster.read_images(spark, str(tmp_path), deep=True, files="grey*")
    assert {r[0].rsplit("/", 1)[-1] for r in one.select("image_id").distinct().collect()} == {"grey.pgm"}
    (tmp_path / "bad.ppm").write_bytes(b"P6 9 9 255\nshort")
    with pytest.raises(Exception, match="bad.ppm is no image"):
        raster.read_images(spark, str(tmp_path)).count()
    assert raster.read_images(spark, str(tmp_path), skip_invalid=True).count() == 48
    sizes = {r["image_id"].rsplit("/", 1)[-1]: tuple(r)[1:6] for r in raster.image_sizes(spark, str(tmp_path)).collect()}
    assert sizes == {"deep.png": ("png", 4, 3, 3, 16), "plain.png": ("png", 4, 3, 3, 8), "grey.pgm": ("pnm", 4, 3, 1, 16), "light.HDR": ("hdr", 4, 3, 3, 32), "bad.ppm": ("pnm", 9, 9, 3, 8)}
    kept = raster.image_sizes(spark, str(tmp_path), "*.pgm")
    assert kept.count() == 1


def pixels(spark, *names):
    return spark.createDataFrame([(n, y * 2 + x, x, y, 0.2 * x, 0.3 * y, 0.5) for n in names for y in range(3) for x in range(2)], "image_id string, pid long, x int, y int, c0 double, c1 double, c2 double")


def names_in(folder):
    return sorted(p.name for p in folder.iterdir() if not p.name.endswith(".crc"))


def test_writer_on_a_mounted_file_system(spark, tmp_path):
    """Through a path that only Hadoop's file systems know."""
    (tmp_path / "store").mkdir()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.images.link./out", f"file://{tmp_path}/store")
    df = pixels(spark, "in/one two.jpg", "b=c", "plain.png")
    written = raster.write_images(df, "viewfs://images/out")
    assert sorted(r["path"] for r in written.collect()) == [f"viewfs://images/out/{n}.png" for n in ("b=c", "one two", "plain")]
    assert names_in(tmp_path / "store") == ["b=c.png", "one two.png", "plain.png"]
    back = raster.read_images(spark, "viewfs://images/out", gamma=1.0)
    assert back.count() == 18
    read = {(r["x"], r["y"]): (r["c0"], r["c1"], r["c2"]) for r in back.filter(F.col("image_id").contains("plain")).collect()}
    assert all(np.allclose(v, (0.2 * x, 0.3 * y, 0.5), atol=1 / 500) for (x, y), v in read.items())


def test_failed_job_leaves_nothing(spark, tmp_path):
    raster.write_images(pixels(spark, "old"), str(tmp_path))
    broken = pixels(spark, "old", "new").withColumn("c0", F.when((F.col("image_id") == "new") & (F.col("pid") == 5), F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("c0")))
    before = (tmp_path / "old.png").read_bytes()
    with pytest.raises(Exception, match="broken"):
        raster.write_images(broken, str(tmp_path))
    assert names_in(tmp_path) == ["old.png"] and (tmp_path / "old.png").read_bytes() == before
    with pytest.raises(ValueError, match="2 images are called 'a'"):
        raster.write_images(pixels(spark, "x/a.png", "y/a.jpg"), str(tmp_path))
    assert names_in(tmp_path) == ["old.png"]
