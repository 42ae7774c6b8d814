"""Labelled image folders as DataFrames."""

from __future__ import annotations

import functools
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from ..settings import Dataset, Settings, current


class DatasetError(RuntimeError):
    """A dataset that is absent, incomplete or unreadable."""


def specification(spark: SparkSession, dataset: Dataset) -> DataFrame:
    """label, class_folder, display_name of the classes."""
    return spark.createDataFrame([(i, c, d) for i, (c, d) in enumerate(zip(dataset.classes, dataset.display_names, strict=True))], "label int, class_folder string, display_name string")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _plain(path: str) -> str:
    """A path as a reader takes it: characters of patterns stand for themselves."""
    return re.sub(r"([\[\]{}?*\\])", r"\\\1", path)


def _hidden(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder that Spark's readers pass over, as they begin with a dot or an underscore."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{_plain(folder)}/[_.]*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(f.getPath().getName() for f in found or [])


def _readable(spark: SparkSession) -> list[str]:
    """Endings of file names, in lower case, that some reader of the JVM takes."""
    return sorted({x.lower() for x in spark._jvm.javax.imageio.ImageIO.getReaderFileSuffixes()} - {""})


def listing(spark: SparkSession, paths: list[str], extensions: tuple[str, ...], recursive: bool = False) -> DataFrame:
    """path, uri, name, length of the image files directly inside the folders; contents are not read. uri is the path as all readers write it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load([_plain(p) for p in paths]).select("path", F.col("_metadata.file_path").alias("uri"), F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return files.where(F.lower(F.regexp_extract("name", r"\.[^.]+$", 0)).isin([e.lower() for e in extensions]))


def load_dataset(spark: SparkSession, root: str, dataset: Dataset, source: str, extensions: tuple[str, ...]) -> DataFrame:
    """path, uri, label, class_folder, display_name, source, record_index, by class and case-insensitive name.

    Raises DatasetError for an absent root, absent class folders, and - after
    those - classes without images, images that no reader here would give: those
    in a format without one, such as WebP, and those whose names begin with a
    dot or an underscore. Names that differ in case alone are ordered
    as they are written.
    """
    if not _exists(spark, root):
        raise DatasetError(f"no dataset at {root}; it needs one folder for each of {', '.join(dataset.classes)}")
    if missing := [c for c in dataset.classes if not _exists(spark, f"{root}/{c}")]:
        raise DatasetError(f"missing class folder(s) under {root}: {', '.join(missing)}")
    files = listing(spark, [f"{root}/{c}" for c in dataset.classes], extensions).withColumn("class_folder", F.element_at(F.split("path", "/"), -2))
    spec = specification(spark, dataset)
    records = files.join(F.broadcast(spec), "class_folder")  # as many rows as classes
    counts = {r.class_folder: r["count"] for r in records.groupBy("class_folder").count().collect()}
    if empty := [c for c in dataset.classes if not counts.get(c)]:
        raise DatasetError(f"class folder(s) under {root} without images ({', '.join(extensions)}): {', '.join(empty)}")
    ending = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    if unread := [r.name for r in records.where(~ending.isin(_readable(spark))).select("name").orderBy("name").limit(5).collect()]:
        raise DatasetError(f"images under {root} in a format without a reader here; convert them to PNG: {', '.join(unread)}")
    if passed := [f"{c}/{n}" for c in dataset.classes for n in _hidden(spark, f"{root}/{c}") if n.lower().endswith(tuple(e.lower() for e in extensions))]:
        raise DatasetError(f"images under {root} that readers take for hidden files; rename them: {', '.join(passed[:5])}")
    numbered = global_rank(records, [F.col("label"), F.lower("name"), F.col("name")], "record_index", rows=sum(counts.values()))
    return numbered.select("path", "uri", "label", "class_folder", "display_name", F.lit(source).alias("source"), "record_index")


def load_named(spark: SparkSession, name: str, settings: Settings | None = None) -> DataFrame:
    """The dataset of that name in the settings."""
    s = settings or current()
    return load_dataset(spark, s.roots[name], s.datasets[name], name, s.image_extensions)


load_primary = functools.partial(load_named, name="primary")
load_generalisation = functools.partial(load_named, name="generalisation")
load_robustness = functools.partial(load_named, name="robustness")


def _decoded(spark: SparkSession, paths: list[str]) -> DataFrame:
    """uri, height, width, channels, data; height is -1 where a file cannot be decoded. paths: as readers take them."""
    pixels = spark.read.format("image").option("dropInvalid", False).load(paths)
    return pixels.select(F.col("_metadata.file_path").alias("uri"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


SENT = 100_000  # records, of a few hundred bytes each, that are sent to all tasks at once
HEAD = 1 << 16  # bytes of a file in which its orientation stands: a segment is no longer


def orientation(head: bytes) -> int:
    """How a JPEG file wants to be turned, 1 to 8, by tag 0x0112 of its Exif segment; 1 if it does not say."""
    at = 2 if head[:2] == b"\xff\xd8" else len(head)
    while head[at : at + 1] == b"\xff" and head[at + 1 : at + 2] not in (b"\xda", b"\xd9", b""):
        size = int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + size]
        if head[at + 1] == 0xE1 and body[:6] == b"Exif\0\0" and body[6:8] in (b"II", b"MM"):
            tiff, order = body[6:], "little" if body[6:8] == b"II" else "big"
            first = int.from_bytes(tiff[4:8], order)
            for k in range(int.from_bytes(tiff[first : first + 2], order)):
                entry = tiff[first + 2 + 12 * k : first + 14 + 12 * k]
                if int.from_bytes(entry[:2], order) == 0x0112 and len(entry) == 12:
                    found = int.from_bytes(entry[8:10], order)
                    return found if 1 <= found <= 8 else 1
        at += 2 + size
    return 1


def turned(image: np.ndarray, how: int) -> np.ndarray:
    """An image as it was taken, upright: from 5 on sides are swapped, even numbers up to 4 and odd ones from 5 on are mirrored."""
    x = image.swapaxes(0, 1) if how >= 5 else image
    rows, columns = {1: (1, 1), 2: (1, -1), 3: (-1, -1), 4: (-1, 1), 5: (1, 1), 6: (1, -1), 7: (-1, -1), 8: (-1, 1)}[how]
    return x[::rows, ::columns]


def _orientations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """uri, orientation of JPEG files that want to be turned."""

    @F.pandas_udf("int")
    def read(head: pd.Series) -> pd.Series:
        return head.map(orientation)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[jJ][pP]*[gG]").load(paths)  # others are not opened
    return files.select(F.col("_metadata.file_path").alias("uri"), read(F.substring("content", 1, HEAD)).alias("orientation")).where("orientation > 1")


def with_pixels(records: DataFrame, sent: int = SENT) -> DataFrame:
    """records and height, width, channels, data (rows of blue, green, red, as they stand in the file) and orientation, for as_array.

    A record without a file raises DatasetError here, a file that cannot be decoded raises an error when it is met.
    Formats are those of the JVM's readers: PNG, JPEG, BMP, GIF and TIFF. Records
    go to where files are read, in lots of sent at most, each with a scan of its
    own files; so pixels are never moved, at any number of records.
    """
    spark = records.sparkSession
    rows = records.count()
    cuts = range(0, rows, sent)
    lots = [records] if len(cuts) < 2 else [global_rank(records, [F.col("uri")], "_nth", rows).where(F.col("_nth").between(low, low + sent - 1)).drop("_nth") for low in cuts]
    out = None
    for lot in lots:
        if len(cuts) < 2:  # a folder per class
            paths = [_plain(r[0]) for r in lot.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).distinct().collect()]
        else:  # the names of a lot
            paths = [_plain(r.path) for r in lot.select("path").collect()]
        if rows:
            files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("uri"))
            if lost := [r.path for r in lot.join(files, "uri", "left_anti").select("path").limit(5).collect()]:
                raise DatasetError(f"records without a file: {', '.join(lost)}")
        pixels = _decoded(spark, paths) if paths else spark.createDataFrame([], "uri string, height int, width int, channels int, data binary")
        known = lot.join(_orientations(spark, paths), "uri", "left").na.fill(1, ["orientation"]) if paths else lot.withColumn("orientation", F.lit(1))
        whole = F.when(F.col("height") < 0, F.raise_error(F.concat(F.lit("not a readable image: "), F.col("path")))).otherwise(F.col("data"))
        found = pixels.join(F.broadcast(known), "uri").select(*records.columns, "height", "width", "channels", "data", "orientation").withColumn("data", whole)  # after the join: other files may stand in the folder
        out = found if out is None else out.unionByName(found)
    return out


def undecodable(spark: SparkSession, folder: str) -> DataFrame:
    """path of files that cannot be decoded."""
    broken = _decoded(spark, [_plain(folder)]).where("height < 0").select("uri")
    files = spark.read.format("binaryFile").load(_plain(folder)).select("path", F.col("_metadata.file_path").alias("uri"))
    return files.join(broken, "uri").select("path")


def as_array(height: int, width: int, channels: int, data: bytes, how: int = 1) -> np.ndarray:
    """Three channels of bytes, upright: grey is repeated, transparency dropped."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return turned(np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, :3], how)


def encode_png(image: np.ndarray) -> bytes:
    """A PNG of a (height, width, 3) image in the order blue, green, red, or of a grey plane."""
    x = image[:, :, ::-1] if image.ndim == 3 else image
    raw = b"".join(b"\0" + np.ascontiguousarray(row).tobytes() for row in x)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
