"""Commands: describe settings, survey and stage downloads, look at segmentations, run the experiment."""

from __future__ import annotations

import argparse
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.descriptors import REGISTRY, from_settings
from .operators import experiment, grid, metrics, partition, prepare, svm
from .operators.cuts import discard, durable
from .settings import Settings, load
from .sources import images, reports, staging


def _files(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """Image files under root: folder (relative), root_name, name, path, length."""
    found = images.listing(spark, [root], extensions, recursive=True)
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where)
    top, length = whole.getName(), len(whole.toString().rstrip("/"))
    relative = F.substring(F.regexp_replace("path", "/[^/]*$", ""), F.lit(length + 2), F.lit(1 << 20))
    return found.select(relative.alias("folder"), F.lit(top).alias("root_name"), "name", "path", "length")


def tree(spark: SparkSession, root: str, extensions: tuple[str, ...], depth: int = 3) -> list[str]:
    """Lines of the folders under root, with or without images, down to a depth: names in order, images and folders directly inside."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())

    def inside(path) -> tuple[list, int]:
        entries = list(files.listStatus(path))
        names = [e.getPath().getName().lower() for e in entries if e.isFile()]
        return sorted((e.getPath() for e in entries if e.isDirectory()), key=lambda p: p.getName().lower()), sum(n.endswith(tuple(extensions)) for n in names)

    folders, images_here = inside(where)
    lines = [root + (f"  {images_here} images" if images_here else "")]
    waiting = [(p, "", k == len(folders) - 1, 1) for k, p in reversed(list(enumerate(folders)))]
    while waiting:
        path, before, last, level = waiting.pop()
        if level > depth:
            continue
        try:
            below, n = inside(path)
            notes = [f"{x} {word}" for x, word in ((n, "images"), (len(below), "folders")) if x]
        except Exception as e:  # a folder that may not be read
            below, notes = [], [f"cannot be read: {type(e).__name__}"]
        lines.append(f"{before}{'└─ ' if last else '├─ '}{path.getName()}  {', '.join(notes) or 'empty'}")
        further = before + ("   " if last else "│  ")
        waiting += [(p, further, k == len(below) - 1, level + 1) for k, p in reversed(list(enumerate(below)))]
    return lines


def survey(spark: SparkSession, s: Settings, root: str, overrides: list[str], copy_to: str | None, shown: int = 10, depth: int = 3) -> int:
    print(*tree(spark, root, s.image_extensions, depth), sep="\n")
    files = _files(spark, root, s.image_extensions).cache()
    found = staging.folders(files, staging.parse_overrides(overrides)).orderBy("relative").collect()
    for r in found:
        if r.status == "matched":
            print(f"{r.class_name}: {r.relative or '.'}, {r.images} images")
    for status in ("skipped", "ignored"):
        names = [r.relative for r in found if r.status == status]
        print(f"{status}: {len(names)}", *names[:shown], sep="\n  ")
    matched = [r for r in found if r.status == "matched"]
    missing = [c for c in s.datasets["primary"].classes if c not in {r.class_name for r in matched}]
    if missing:
        print(f"no folder for {', '.join(missing)}; name one with --map Class=folder")
        return 1
    if not copy_to:
        return 0
    classes = spark.createDataFrame([(r.relative, r.class_name) for r in matched], "folder string, class_name string")
    planned = staging.manifest(files.join(classes, "folder").select("class_name", "folder", "name", "path", "length"))
    there = spark.createDataFrame([], "class_name string, target string, length long")
    if images._exists(spark, copy_to):
        there = _files(spark, copy_to, s.image_extensions).select(F.col("folder").alias("class_name"), F.col("name").alias("target"), "length")
    staged = staging.with_status(planned, there).cache()
    copied = staging.copy(staged, copy_to)
    reports.save_csv(copied, str(s.results("staging") / "copied"))
    if lost := staging.differing(copied, copy_to).limit(shown).collect():
        print("not there as copied:", *[f"{r.class_name}/{r.target} {r.found}" for r in lost], sep="\n  ")
        return 1
    discard(copied)
    staging.tallies(staged).orderBy("class_name").show(truncate=False)
    bad = [r.path for c in {r.class_name for r in matched} for r in images.undecodable(spark, f"{copy_to}/{c}").collect()]
    print(f"undecodable: {len(bad)}", *bad[:shown], sep="\n  ")
    return int(bool(bad))


def check(spark: SparkSession, s: Settings, source: str, per_class: int) -> int:
    try:
        records = images.load_named(spark, source, s)
    except images.DatasetError as e:
        print(e)
        return 1
    partition.class_counts(records, images.specification(spark, s.datasets[source])).orderBy("label").show()
    drawn = images.with_pixels(partition.sample_per_class(records, "record_index", per_class, s.seed))
    samples = prepare.prepare(drawn, s).cache()
    out = s.results("segmentation_check")
    width, height = s.preprocess.resize
    pixels = {r.path: images.as_array(r.height, r.width, r.channels, r.data, r.orientation) for r in drawn.select("path", "height", "width", "channels", "data", "orientation").collect()}
    by: dict[str, list] = {}
    for r in samples.orderBy("record_index").collect():  # a dozen images of each class
        ready, mask = np.frombuffer(r.image, np.uint8).reshape(height, width, 3), np.frombuffer(r.mask, np.uint8).reshape(height, width)
        box = (r.bbox.x, r.bbox.y, r.bbox.w, r.bbox.h)
        by.setdefault(r.class_folder, []).append((pixels[r.path], ready, mask, reports.overlay(ready, [(p.x, p.y) for p in r.contour], box), r.failed))
    for name, rows in by.items():
        (out / f"{source}_{name}.png").write_bytes(images.encode_png(reports.grid(rows)))
    reports.save_report(prepare.failures(samples), out / f"{source}_failures.csv")
    reports.save_report(prepare.coverage_summary(samples), out / f"{source}_coverage.csv")
    prepare.coverage_summary(samples).show(truncate=False)
    return 0


def trial(spark: SparkSession, s: Settings, techniques: list[str], sources: list[str]) -> int:
    try:
        done = experiment.run(spark, s, [e for e in from_settings(s) if e.short_name in techniques], sources)
    except images.DatasetError as e:
        print(e)
        return 1
    out, names = s.results("experiment"), list(s.datasets["primary"].display_names)
    spec = images.specification(spark, s.datasets["primary"])
    predictions, folds = done.predictions, done.folds
    scores = done.scores({n: experiment.matched_labels(s, n) for n in ("primary", *sources)})
    for name, frame in (("folds", folds), ("cross_validation", done.cv_summary), ("scores", scores), ("matrix", done.summary), ("failures", done.failures), ("comparisons", done.comparisons), ("ranks", done.ranks), ("times", done.times)):
        reports.save_report(frame, out / f"{name}.csv")
    for t in techniques:
        own = predictions.where((F.col("technique") == t) & (F.col("source") == "primary")).select("label", "predicted")
        confusion = metrics.confusion(own, spec)
        reports.save_confusion(confusion, len(names), out / f"{t}.png", names=names, title=f"{t}: shares of true classes")
        text = reports.text_report(metrics.headline(own), metrics.per_class(own, spec), folds.where(F.col("technique") == t), confusion, names)
        (out / f"{t}.txt").write_text(text + "\n")
        print(f"{t}\n\n{text}\n")
    for frame, order in ((scores, ["source", "technique"]), (done.comparisons, ["p", "first", "second"]), (done.ranks, ["mean_rank", "technique"]), (done.times, ["technique"])):
        frame.orderBy(*order).show(truncate=False)
    done.close()
    return 0


def sub_comparison(spark: SparkSession, s: Settings, family: str) -> int:
    """Settings of one descriptor family on the folds of the training side."""
    chosen = grid.colour_settings() if family == "T1" else grid.texture_settings()
    try:
        split = partition.stratified_split(images.load_named(spark, "primary", s), "record_index", s.partition.test_size, s.seed)
    except images.DatasetError as e:
        print(e)
        return 1
    samples = experiment.samples_of(split.where("split = 'train'").drop("split"), [c.extractor for c in chosen], s, True)
    table = durable(grid.fold_table(prepare.matrix_of(samples), chosen, folds=s.partition.cv_folds, **svm.chosen(s)))
    out = s.results("sub_comparisons")
    reports.save_report(table, out / f"{family}_folds.csv")
    best = grid.best_of_family(table)
    reports.save_report(best, out / f"{family}.csv")
    best.orderBy("mean_rank", "parameters").show(50, truncate=False)
    discard(table)
    discard(samples)
    return 0


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quadrille", description=__doc__)
    parser.add_argument("--settings", help="a JSON file")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("describe", help="print the settings")
    one = commands.add_parser("survey", help="find class folders, and copy them with --copy")
    one.add_argument("root")
    one.add_argument("--copy", metavar="FOLDER")
    one.add_argument("--depth", type=int, default=3)
    one.add_argument("--map", action="append", default=[], metavar="CLASS=FOLDER")
    two = commands.add_parser("check", help="segment a sample of each class and draw it")
    two.add_argument("--source", default="primary", choices=("primary", "generalisation", "robustness"))
    two.add_argument("--per-class", type=int)
    three = commands.add_parser("experiment", help="cross-validate, then judge the test side and other sets")
    three.add_argument("--technique", action="append", choices=sorted(REGISTRY))
    three.add_argument("--also", action="append", default=[], choices=("generalisation", "robustness"), help="another set to judge")
    four = commands.add_parser("compare", help="settings of one descriptor family on the same folds")
    four.add_argument("family", choices=("T1", "T2"))
    a = parser.parse_args(arguments)
    s = load(a.settings)
    if a.command == "describe":
        print(s.describe())
        return 0
    spark = SparkSession.builder.appName("quadrille").getOrCreate()
    if a.command == "survey":
        return survey(spark, s, a.root, a.map, a.copy, depth=a.depth)
    if a.command == "experiment":
        return trial(spark, s, a.technique or sorted(REGISTRY), a.also)
    if a.command == "compare":
        return sub_comparison(spark, s, a.family)
    return check(spark, s, a.source, a.per_class or s.images_per_class)


if __name__ == "__main__":
    sys.exit(main())
