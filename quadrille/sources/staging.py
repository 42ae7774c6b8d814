"""Staging: which downloaded folders hold which class, and what each file becomes."""

from __future__ import annotations

import hashlib
import re
import uuid

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cuts import durable

# Folder names of splits, and what names a class; the order of classes decides.
TRAIN_NAMES = ["train", "training"]
OTHER_NAMES = ["test", "testing", "val", "valid", "validation", "eval"]
FRUIT = "apple"
TOKENS = {
    "UnripeApple": ["unripe", "raw", "green", "immature"],
    "RottenApple": ["rotten", "spoiled", "decayed", "bad", "overripe"],
    "RipeApple": ["ripe", "fresh", "good", "mature"],
}


def split_of(relative: Column) -> Column:
    """`train`, `other` or null, by the first part of a relative path that names a split."""
    named = F.get(F.filter(F.split(F.lower(relative), "/"), lambda p: p.isin(TRAIN_NAMES + OTHER_NAMES)), 0)
    return F.when(named.isin(TRAIN_NAMES), "train").when(named.isNotNull(), "other")


def classify_folder(folder: Column, parent: Column) -> Column:
    """The class that the names of a folder and its parent give, or null; tokens may stand anywhere in them."""
    squeezed = F.translate(F.lower(F.concat_ws("/", parent, folder)), "_- ", "")
    found = F.lit(None).cast("string")
    for name, tokens in reversed(TOKENS.items()):
        has = F.lit(False)
        for t in tokens:
            has = has | squeezed.contains(t)
        found = F.when(has, name).otherwise(found)
    return F.when(squeezed.contains(FRUIT), found)


def parse_overrides(values: list[str]) -> dict[str, str]:
    """`Class=folder` arguments, as class to folder."""
    out = {}
    for v in values:
        name, sep, folder = v.partition("=")
        if not sep:
            raise ValueError(f"an override reads Class=folder, not {v!r}")
        out[name.strip()] = folder.strip()
    return out


def folders(files: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """relative, images, split, class_name, status (`matched`, `skipped`, `ignored`) of folders that hold images.

    files: folder (relative to the root, whose own name is root_name), root_name,
    name. A folder under another split is skipped even if an override names it.
    """
    parts = F.split("relative", "/")
    own = F.when(F.col("relative") == "", F.col("root_name")).otherwise(F.element_at(parts, -1))
    parent = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).when(F.col("relative") == "", F.lit("")).otherwise(F.col("root_name"))
    forced = F.lit(None).cast("string")
    for name, folder in (overrides or {}).items():
        forced = F.when(F.lower(own) == folder.lower(), name).otherwise(forced)
    split = split_of(F.col("relative"))
    name = F.when(split.eqNullSafe("other"), None).otherwise(F.coalesce(forced, classify_folder(own, parent)))
    status = F.when(split.eqNullSafe("other"), "skipped").when(name.isNull(), "ignored").otherwise("matched")
    counted = files.groupBy(F.col("folder").alias("relative"), "root_name").agg(F.count("*").alias("images"))
    return counted.select("relative", "images", split.alias("split"), name.alias("class_name"), status.alias("status"))


def manifest(files: DataFrame) -> DataFrame:
    """files and target, renamed: the name each gets in the folder of its class.

    files: class_name, folder, name, path, order within the class by folder and
    then case-insensitive name. Of equal names the first keeps it; the others
    get the folder's name in front; if that is taken before, eight digits of the
    path's sha1 go behind the stem instead.
    """
    order = [F.col("folder"), F.lower("name"), F.col("name"), F.col("path")]
    nth = files.withColumn("_nth", F.row_number().over(Window.partitionBy("class_name", "name").orderBy(*order)))
    later = F.col("_nth") > 1
    own = F.element_at(F.split("folder", "/"), -1)
    wished = nth.withColumn("_alt", F.when(later, F.concat(own, F.lit("__"), F.col("name"))).otherwise(F.col("name")))
    taken = F.row_number().over(Window.partitionBy("class_name", "_alt").orderBy(*order)) > 1
    stem, suffix = F.regexp_replace("name", r"\.[^.]+$", ""), F.regexp_extract("name", r"\.[^.]+$", 0)
    target = F.when(later & F.col("_taken"), F.concat(stem, F.lit("__"), F.left(F.sha1("path"), F.lit(8)), suffix)).otherwise(F.col("_alt"))
    target = F.when(~later & F.col("_taken"), F.concat(own, F.lit("__"), F.col("name"))).otherwise(target)
    return wished.withColumn("_taken", taken).select(*files.columns, target.alias("target"), (later | F.col("_taken")).alias("renamed"))


def tallies(staged: DataFrame) -> DataFrame:
    """class_name, copied, skipped, renamed, duplicates. staged: class_name, status (`copied`, `skipped`), renamed."""
    return staged.groupBy("class_name").agg(F.count_if(F.col("status") == "copied").alias("copied"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if("renamed").alias("renamed"), F.count_if("renamed").alias("duplicates"))


def with_status(planned: DataFrame, present: DataFrame) -> DataFrame:
    """planned (class_name, target, length, ...) and status: `skipped` where present (class_name, target, length) has the file in that size."""
    there = present.select("class_name", "target", "length").distinct().withColumn("_there", F.lit(True))
    return planned.join(there, ["class_name", "target", "length"], "left").withColumn("status", F.when(F.col("_there"), "skipped").otherwise("copied")).drop("_there")


PIECE = 4 << 20  # bytes that are copied at once
_COPIED = "class_name string, target string, path string, length long, sha256 string"


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI - local, HDFS, S3 or what else the Arrow library opens - and the path in it. Names are taken as they are written, without escapes."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):(//[^/]*)?(/.*)", path)
    if found is None or found[1].lower() == "file":
        return pafs.LocalFileSystem(), found[3] if found else path
    system, top = pafs.FileSystem.from_uri(f"{found[1]}:{found[2] or '//'}/")
    return system, f"{top.rstrip('/')}{found[3]}" if top not in ("", "/") else found[3]


def copy(staged: DataFrame, destination: str) -> DataFrame:
    """Copies the rows of status `copied` to destination/class_name/target, on the executors, and gives class_name, target, path, length, sha256 of what was copied.

    A file is written under a name of its attempt, which listings pass over, and
    takes its own name when it is whole and has the length it was planned with: two attempts of one task do
    not meet, and a run that is killed leaves no half file under a name that
    counts. The next one finds what is there (with_status) and copies the rest;
    what attempts left behind goes at the end. The result is a cut, of which discard() gives the table back.
    """

    def work(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                (source, path), (system, folder) = store_of(r.path), store_of(f"{destination.rstrip('/')}/{r.class_name}")
                system.create_dir(folder, recursive=True)
                part, digest, size = f"{folder}/.part-{uuid.uuid4().hex}", hashlib.sha256(), 0
                with source.open_input_stream(path) as inside, system.open_output_stream(part) as outside:
                    while piece := inside.read(PIECE):
                        outside.write(piece)
                        digest.update(piece)
                        size += len(piece)
                if size != r.length:
                    system.delete_file(part)
                    raise OSError(f"{r.path} has {size} bytes, and had {r.length} when it was listed")
                system.move(part, f"{folder}/{r.target}")
                out.append((r.class_name, r.target, r.path, size, digest.hexdigest()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _COPIED.split(", ")])

    done = durable(staged.where("status = 'copied'").select("class_name", "target", "path", "length").mapInPandas(work, _COPIED))
    for r in staged.select("class_name").distinct().collect():  # a row per class
        system, folder = store_of(f"{destination.rstrip('/')}/{r.class_name}")
        for f in system.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith(".part-"):
                system.delete_file(f.path)
    return done


def differing(copied: DataFrame, destination: str) -> DataFrame:
    """class_name, target, found of copied files (class_name, target, length, sha256) that are not there as they were copied: `missing` or `changed`."""

    def look(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                system, path = store_of(f"{destination.rstrip('/')}/{r.class_name}/{r.target}")
                if system.get_file_info(path).type != pafs.FileType.File:
                    out.append((r.class_name, r.target, "missing"))
                    continue
                digest = hashlib.sha256()
                with system.open_input_stream(path) as inside:
                    while piece := inside.read(PIECE):
                        digest.update(piece)
                if digest.hexdigest() != r.sha256:
                    out.append((r.class_name, r.target, "changed"))
            yield pd.DataFrame(out, columns=["class_name", "target", "found"])

    return copied.select("class_name", "target", "sha256").mapInPandas(look, "class_name string, target string, found string")
