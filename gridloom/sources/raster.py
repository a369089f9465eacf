"""Raster tables: a view over ``events``, images in, PNG out, grid generators.

A pixel is a row (image_id, pid, x, y, channels); pid is y * width + x.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats
from .storage import join_small, saved

WIDTH = 40  # of the raster over ``events``
TYPES = ["click", "error", "purchase", "signup", "view"]
#: (dx, dy) by direction: NW, N, NE, W, E, SW, S, SE.
OFFSETS = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def events_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a raster: its dense event_id is the pixel id."""
    pid = F.col("event_id")
    floor = F.lit(1.0) / 255
    kind = F.array_position(F.lit(TYPES), F.col("event_type")) - 1
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.lit("events").alias("image_id"),
        pid.alias("pid"),
        (pid % WIDTH).cast("int").alias("x"),
        F.expr(f"cast(event_id div {WIDTH} as int)").alias("y"),
        F.greatest(F.col("value") / 1000, floor).alias("c0"),
        ((F.col("user_id") % 16 + 1) / 16.0).alias("c1"),
        ((pid * 7 % 11 + 1) / 12.0).alias("c2"),
        kind.cast("int").alias("label_noisy"),
    )
    return df.withColumn("label_block", F.expr("cast(((x div 8) + (y div 5)) % 5 as int)"))


def event_pictures(spark: SparkSession, sf_dir: str, events: int = 5000, cells: int = 3, side: int = 32) -> DataFrame:
    """The events table as pictures (image_id, pid, x, y, c0, c1, c2): one of each ``events`` events by id, cells x cells squares of ``side`` pixels.

    A square is coloured by what its users' events are: clicks, errors and purchases, as three times
    their shares (at most 1); one without events is black.
    """
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(f"event_id div {events}").alias("n"), F.pmod(F.col("user_id"), F.lit(cells * cells)).alias("cell"), "event_type")
    shares = [F.least(F.avg((F.col("event_type") == t).cast("double")) * 3, F.lit(1.0)).alias(f"c{k}") for k, t in enumerate(("click", "error", "purchase"))]
    colours = df.groupBy("n", "cell").agg(*shares)
    colours = colours.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("c0", "c1", "c2")))).alias("known"))
    width = cells * side
    pixels = colours.select("n", "known", F.explode(F.sequence(F.lit(0), F.lit(width * width - 1))).alias("pid"))
    pixels = pixels.select("n", "known", F.col("pid").cast("long").alias("pid"), (F.col("pid") % width).alias("x"), F.expr(f"cast(pid div {width} as int)").alias("y"))
    own = F.try_element_at("known", F.expr(f"cast((y div {side}) * {cells} + x div {side} as long)"))
    return pixels.select(F.concat(F.lit("events-"), F.col("n").cast("string")).alias("image_id"), "pid", "x", "y", *(F.coalesce(own[c], F.lit(0.0)).alias(c) for c in ("c0", "c1", "c2")))


def mirrored(pixels: DataFrame, suffix: str = "-mirror") -> DataFrame:
    """Every image from right to left, under its name and ``suffix``."""
    wide = join_small(pixels, dimensions(pixels), "image_id")
    out = wide.withColumn("x", (F.col("width") - 1 - F.col("x")).cast("int")).withColumn("pid", F.col("y").cast("long") * F.col("width") + F.col("x"))
    return out.withColumn("image_id", F.concat("image_id", F.lit(suffix))).select(pixels.columns)


def dimensions(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height) of every image."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


#: Endings of files that Spark's image source can't read.
DEEP = ("pnm", "pbm", "pgm", "ppm", "hdr")
_PIXELS = "image_id string, pid long, x int, y int, c0 double, c1 double, c2 double"


def _pixels_of(origin: str, values: np.ndarray, at_once: int, channels: list[int], linear: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """An image's rows from height x width x channels as stored, ``at_once`` pixels at a time made ``linear``."""
    h, w, _ = values.shape
    flat = values.reshape(h * w, -1)
    for start in range(0, w * h, at_once):
        pid = np.arange(start, min(start + at_once, w * h))
        columns = [pa.array([origin] * len(pid)), pa.array(pid), pa.array((pid % w).astype(np.int32)), pa.array((pid // w).astype(np.int32)), *(pa.array(linear(flat[start : start + len(pid), k])) for k in channels)]
        yield pa.RecordBatch.from_arrays(columns, ["image_id", "pid", "x", "y", "c0", "c1", "c2"])


def read_images(spark: SparkSession, path: str, gamma: float = 2.2, skip_invalid: bool = False, at_once: int = 1 << 16, deep: bool = False, files: str = "*") -> DataFrame:
    """Image files as pixels (image_id, pid, x, y, c0, c1, c2), three linear channels.

    A stored value v of 0 to 1 becomes v ** gamma, HDR values stay. Grey images have their channel three
    times, an alpha channel is dropped. Files with one of the endings of DEEP are decoded by :mod:`formats`
    in full depth, all others by Spark's image source in 8 bits; with ``deep``, PNG files too go
    to the former, for those of 16 bits. ``files`` names files by a pattern (as Spark's ``pathGlobFilter`` does) before any is read. A file that can't be decoded is an
    error, or left out with ``skip_invalid``. Pixels leave a task ``at_once`` at a time.
    """
    own = r"(?i)\.(" + "|".join((*DEEP, "png") if deep else DEEP) + ")$"
    found = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select("path", "content").filter(F.col("path").rlike(own))
    image = spark.read.format("image").option("dropInvalid", skip_invalid).option("pathGlobFilter", files).load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")
    return _by_spark(image.filter(~F.col("origin").rlike(own)), gamma, at_once).unionAll(_decoded(found, gamma, skip_invalid, at_once))


def _by_spark(image: DataFrame, gamma: float, at_once: int) -> DataFrame:
    """8 bits a channel, from Spark's image source."""
    linear = (np.arange(256) / 255.0) ** gamma

    def pixels(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for origin, w, h, channels, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if channels < 1:
                    raise ValueError(f"{origin} is no image that can be decoded")
                values = np.frombuffer(data, np.uint8).reshape(h, w, channels)
                # Bytes are blue, green, red, alpha; one or two channels are grey (and alpha).
                yield from _pixels_of(origin, values, at_once, [2, 1, 0] if channels > 2 else [0, 0, 0], lambda v: linear[v])

    return image.mapInArrow(pixels, _PIXELS)


def _decoded(content: DataFrame, gamma: float, skip_invalid: bool, at_once: int) -> DataFrame:
    """Any depth, from files' bytes, by :mod:`formats`."""

    def pixels(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for origin, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    values, is_linear = formats.decode(data.as_py())
                except (ValueError, IndexError, struct.error, zlib.error) as e:
                    if skip_invalid:
                        continue
                    raise ValueError(f"{origin} is no image that can be decoded: {e}") from e
                yield from _pixels_of(origin, values, at_once, [0, 1, 2] if values.shape[2] > 2 else [0, 0, 0], lambda v, own=is_linear: np.ascontiguousarray(v if own else v**gamma))

    return content.mapInArrow(pixels, _PIXELS)


def image_sizes(spark: SparkSession, path: str, files: str = "*") -> DataFrame:
    """(image_id, kind, width, height, channels, depth, length) of image files, from their headers; nothing is decoded. Other files are left out."""
    first = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select("path", "length", F.substring("content", 1, 1 << 16).alias("head"))

    def sizes(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = [(p, *found, n) for p, n, head in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (found := formats.header(head))]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["image_id", "kind", "width", "height", "channels", "depth", "length"])

    return first.mapInArrow(sizes, "image_id string, kind string, width int, height int, channels int, depth int, length long")


def interleaved(pixels: DataFrame, channels: tuple[str, ...] = ("c0", "c1", "c2")) -> DataFrame:
    """(image_id, y, values): each image row's channels interleaved. A row, not an image, is one value."""
    rows = pixels.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", F.array(*channels).alias("v")))).alias("r"))
    return rows.select("image_id", "y", F.flatten(F.col("r.v")).alias("values"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _band(values: np.ndarray) -> tuple[bytes, int, int]:
    """A PNG file's chunk of some image lines (height x width x 3 bytes): a piece of the deflate stream that needs none before it; length and Adler-32 of what it holds."""
    h, w, _ = values.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), values.reshape(h, w * 3)], axis=1).tobytes()
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return _chunk(b"IDAT", packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH)), len(raw), zlib.adler32(raw)


def _joined(sums: Iterable[tuple[int, int]]) -> int:
    """Adler-32 of parts one after another, from length and Adler-32 of each."""
    a, b = 1, 0
    for n, s in sums:
        b = (b + (s >> 16) + n * (a - 1)) % 65521
        a = (a + (s & 0xFFFF) - 1) % 65521
    return b << 16 | a


def _head(w: int, h: int) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", b"\x78\x9c")


def _tail(sums: Iterable[tuple[int, int]]) -> bytes:
    return _chunk(b"IDAT", b"\3\0" + struct.pack(">I", _joined(sums))) + _chunk(b"IEND", b"")


def png(values: np.ndarray) -> bytes:
    """A PNG file of height x width x 3 bytes, in one band."""
    data, *sums = _band(values)
    return _head(values.shape[1], values.shape[0]) + data + _tail([tuple(sums)])


#: Pixels of a band of :func:`encode_png`, at least a line.
BAND = 1 << 18


def encode_png(pixels: DataFrame, channels: tuple[str, str, str] = ("c0", "c1", "c2"), band: int = BAND, tasks: int | None = None) -> DataFrame:
    """(image_id, width, height, png): quantized, one file an image.

    Bands of lines, of about ``band`` pixels, are compressed by themselves; only their bytes meet in one task, as a file must.
    Files come out of ``tasks`` tasks, however short they are.
    """
    from ..functions.scalar import quantize

    size = dimensions(pixels).withColumn("lines", F.expr(f"cast(greatest(1, {band} div width) as int)"))
    df = join_small(pixels.select("image_id", "x", "y", *(quantize(F.col(c)).alias(f"q{k}") for k, c in enumerate(channels))), size, "image_id")

    def compress(table: pa.Table) -> pa.Table:
        image, part, w, h, lines = (table[c][0].as_py() for c in ("image_id", "band", "width", "height", "lines"))
        out = np.zeros((min(lines, h - part * lines), w, 3), np.uint8)
        y, x = table["y"].to_numpy() - part * lines, table["x"].to_numpy()
        for k in range(3):
            out[y, x, k] = table[f"q{k}"].to_numpy()
        return pa.table({"image_id": [image], "width": pa.array([w], pa.int32()), "height": pa.array([h], pa.int32()), "band": pa.array([part], pa.int32()), **{n: pa.array([v], t) for n, v, t in zip(("data", "n", "sum"), _band(out), (pa.binary(), pa.int64(), pa.int64()), strict=True)}})

    bands = df.withColumn("band", F.expr("cast(y div lines as int)")).groupBy("image_id", "band").applyInArrow(compress, "image_id string, width int, height int, band int, data binary, n long, sum long")
    if tasks is not None:
        bands = bands.repartition(tasks, "image_id", "width", "height")
    head, tail = F.udf(_head, "binary"), F.udf(_tail, "binary")
    files = bands.groupBy("image_id", "width", "height").agg(F.sort_array(F.collect_list(F.struct("band", "data", "n", "sum"))).alias("bands"))
    ends = files.select("image_id", "width", "height", "bands", head("width", "height").alias("head"), tail(F.transform("bands", lambda b: F.struct(b["n"].alias("n"), b["sum"].alias("sum")))).alias("tail"))
    # Bytes as text joined without a separator: one copy, whatever the number of bands.
    body = F.array_join(F.transform("bands", lambda b: F.hex(b["data"])), "")
    return ends.select("image_id", "width", "height", F.concat("head", F.unhex(body), "tail").alias("png"))


#: Files that a task of :func:`write_images` writes, about, where there are many.
FILES = 64


def write_images(pixels: DataFrame, folder: str, channels: tuple[str, str, str] = ("c0", "c1", "c2")) -> DataFrame:
    """Write each image as a PNG file into ``folder``, whatever file system Spark has for it; (image_id, path) of the files.

    Files are called after the image, by what follows its last slash, less the ending; two
    images of one name are an error. Spark's own writer puts them under a hidden folder, with its commits of tasks
    and of the job, so that a task that fails or runs twice leaves nothing or one file. Only once all are there does the driver
    rename them into place, one call a file, and replace files of those names; if the job fails, the folder is as before. (The writer is that for lines of text, which passes bytes through and
    ends each file with a line feed, behind the image's end.)
    """
    spark = pixels.sparkSession
    name = F.regexp_extract(F.regexp_replace("image_id", "/+$", ""), r"([^/]*?)(\.[^./]*)?$", 1)
    names = saved(pixels.select("image_id").distinct().select("image_id", name.alias("name")), "names")
    twice = names.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['n']} images are called {twice['name']!r}")
    # Spark would put short files together into one task by their bytes, which writes them one after another.
    files = names.count()
    tasks = max(1, min(files, max(int(spark.conf.get("spark.sql.shuffle.partitions")), files // FILES)))
    encoded = encode_png(pixels, channels, tasks=tasks).select(name.alias("name"), F.col("png").cast("string").alias("png"))
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    hidden, known = hadoop.Path(at, f"_writing-{uuid.uuid4().hex}"), system.exists(at)
    try:
        encoded.write.partitionBy("name").text(hidden.toString())
        found = system.listFiles(hidden, True)
        unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        while found.hasNext():
            part = found.next().getPath()
            if not part.getName().startswith("part-"):
                continue
            goal = hadoop.Path(at, unescape(part.getParent().getName().removeprefix("name=")) + ".png")
            if known and system.exists(goal):
                system.delete(goal, False)
            if not system.rename(part, goal):
                raise OSError(f"{part.toString()} can't be renamed")
    finally:
        system.delete(hidden, True)
    return names.select("image_id", F.concat(F.lit(folder.rstrip("/") + "/"), "name", F.lit(".png")).alias("path"))


def grid(pixels: DataFrame, offsets: list[tuple[int, int]], *carried: str) -> DataFrame:
    """Neighbouring pairs of pixels of full grids: (image_id, src, dst, dir, src_<c>, dst_<c>).

    Two windows instead of a join: one along rows gathers a pixel's left and
    right neighbour, one along columns those of the rows above and below. Each
    moves a pixel once, where a join would move it once for each direction.
    """
    from pyspark.sql import Window

    at = F.struct("pid", "x", "y", *carried)
    row = Window.partitionBy("image_id", "y").orderBy("x")
    near = lambda c, dx: F.when(c["x"] == F.col("x") + dx, c)
    df = pixels.select("image_id", "x", "y", at.alias("self"))
    df = df.withColumn("line", F.array(near(F.lag("self").over(row), -1), F.col("self"), near(F.lead("self").over(row), 1)))
    column = Window.partitionBy("image_id", "x").orderBy("y")
    above, below = F.lag("line").over(column), F.lead("line").over(column)
    df = df.withColumns({"above": F.when(above[1]["y"] == F.col("y") - 1, above), "below": F.when(below[1]["y"] == F.col("y") + 1, below)})
    lines = {-1: "above", 0: "line", 1: "below"}
    pairs = F.array(*(F.struct(F.lit(k).alias("dir"), F.col(lines[dy])[dx + 1].alias("to")) for k, (dx, dy) in enumerate(offsets)))
    df = df.select("image_id", "self", F.explode(pairs).alias("e")).filter("e.to is not null")
    return df.select("image_id", F.col("self.pid").alias("src"), F.col("e.to.pid").alias("dst"), F.col("e.dir").alias("dir"), *(F.col(f"self.{c}").alias(f"src_{c}") for c in carried), *(F.col(f"e.to.{c}").alias(f"dst_{c}") for c in carried))


def grid_edges(pixels: DataFrame, *carried: str) -> DataFrame:
    """Directed pairs of 4-neighbours (dir: 0 north, 1 west, 2 east, 3 south)."""
    return grid(pixels, [(0, -1), (-1, 0), (1, 0), (0, 1)], *carried)
