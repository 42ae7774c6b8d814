"""From pixels to prepared samples and feature rows, in narrow stages.

described() is the whole way in one pass, image by image: one is decoded
once, each of its variants prepared and segmented once, and all extractors
describe it there. What comes out has no pixels, so it is cheap to keep, and the
feature matrix, its summary and the failures are all read from it. prepare()
and feature_matrix() are the same in two steps, with the pixels in between.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions.extractors import Extractor
from ..settings import Settings
from ..sources.images import as_array

_SEGMENTED = "bbox struct<x:int,y:int,w:int,h:int>, contour array<struct<x:int,y:int>>, coverage double, polarity string, threshold double, failed boolean, reason string, substituted boolean"
_PREPARED = "path string, label int, class_folder string, source string, record_index long, variant int, op struct<flip:boolean,angle:double,brightness:double>, image binary, mask binary, " + _SEGMENTED


def each(rows: DataFrame, work: Callable[[Row], Iterable[tuple]], schema: str) -> DataFrame:
    """What work makes of each row, in rows of schema, which hold plain Python values.

    For rows with pixels: a plain function gets a hundred at once, where an Arrow batch may have thousands.
    """
    columns = rows.columns
    one = F.udf(lambda *values: list(work(Row(*columns)(*values))), f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(", "))}>>", useArrow=False)
    one = one.asNondeterministic()  # else a filter of the rows made calls it once more
    return rows.select(one(*columns).alias("_made")).select(F.inline("_made"))


def augmentation_plan(records: DataFrame, settings: Settings) -> DataFrame:
    """records (with record_index, from 0) and a row for each variant: variant, flip, angle, brightness; the original is variant 0."""
    seed, a = settings.seed, settings.augmentation

    @F.pandas_udf("array<struct<flip:boolean,angle:double,brightness:double>>")
    def plan(index: pd.Series) -> pd.Series:
        return pd.Series([[{"flip": o.flip, "angle": o.angle, "brightness": o.brightness} for o in pixels.plan_of(int(i), seed, a)] for i in index])

    return records.select("*", F.posexplode(plan("record_index")).alias("variant", "op")).select(*records.columns, "variant", "op.flip", "op.angle", "op.brightness")


def prepare(images: DataFrame, settings: Settings, augment: bool = False) -> DataFrame:
    """Prepared samples: one for each image or, with augment - for training data only - one for each variant of the plan.

    images: path, label, class_folder, source, record_index, height, width,
    channels, data, and orientation if they are not upright. record_index counts the images that are prepared.
    """

    def work(r):
        for variant, op, ready, s in _variants(r, settings, augment):
            box = tuple(int(x) for x in s.bbox)
            yield (r.path, r.label, r.class_folder, r.source, r.record_index, variant, (op.flip, op.angle, op.brightness), ready.tobytes(), s.mask.tobytes(), box, [tuple(p) for p in np.asarray(s.contour).tolist()], *_found(s))

    return each(_upright(images), work, _PREPARED)


def _found(s: pixels.Segmented) -> tuple:
    return float(s.coverage), s.polarity, float(s.threshold), bool(s.failed), s.reason, bool(s.substituted)


def _upright(images: DataFrame) -> DataFrame:
    how = F.col("orientation") if "orientation" in images.columns else F.lit(1).alias("orientation")
    return images.select("path", "label", "class_folder", "source", "record_index", "height", "width", "channels", "data", how)


def _variants(r, settings: Settings, augment: bool):
    """Number, operation, image and segmentation of each variant of an image."""
    raw = as_array(r.height, r.width, r.channels, r.data, r.orientation)
    for variant, op in enumerate(pixels.plan_of(r.record_index, settings.seed, settings.augmentation) if augment else [pixels.Op()]):
        yield variant, op, *pixels.prepared(raw, op, settings)


_DESCRIBED = "path string, label int, class_folder string, source string, record_index long, variant int, coverage double, polarity string, threshold double, failed boolean, reason string, substituted boolean, described array<struct<technique:string,features:array<double>,extraction_s:double>>"


def described(images: DataFrame, extractors: Sequence[Extractor], settings: Settings, augment: bool = False, prepared=None) -> DataFrame:
    """A row for each sample, without its pixels: its segmentation, and what each extractor makes of it; nothing where it failed and no mask was substituted.

    Extractors that count alike share their counts (Extractor.tally). Each gets copies, so it cannot change what others see; its first
    call in a task warms up and is not timed. prepared: an accumulator of the samples prepared.
    """

    warm = set()  # a task has its own

    def work(r):
        for variant, _, ready, s in _variants(r, settings, augment):
            if prepared is not None:
                prepared.add(1)
            found, tallies = [], {}
            for e in extractors if not s.failed or s.substituted else ():
                if e.short_name not in warm:
                    e(ready.copy(), s.mask.copy())
                    warm.add(e.short_name)
                a, b = ready.copy(), s.mask.copy()
                began = time.perf_counter()
                key = e.counts
                if key is not None and key not in tallies:
                    tallies[key] = e.tally(a, b)
                vector = e(a, b) if key is None else e.described(tallies[key])
                found.append((e.short_name, vector.tolist(), time.perf_counter() - began))
            yield (r.path, r.label, r.class_folder, r.source, r.record_index, variant, *_found(s), found)

    return each(_upright(images), work, _DESCRIBED)


def matrix_of(samples: DataFrame) -> DataFrame:
    """technique, group, variant, label, path, features, extraction_s of described samples."""
    one = samples.select("record_index", "variant", "label", "path", F.explode("described").alias("d"))
    return one.select("d.technique", F.col("record_index").alias("group"), "variant", "label", "path", "d.features", "d.extraction_s")


def failures(prepared: DataFrame) -> DataFrame:
    """Failed samples, substituted ones among them."""
    return prepared.where("failed").select("path", "class_folder", "source", "variant", "coverage", "reason", "substituted")


def feature_matrix(prepared: DataFrame, extractor: Extractor, settings: Settings) -> DataFrame:
    """technique, group, variant, label, path, features, extraction_s of samples that did not fail, or whose mask was substituted.

    The extractor gets copies, so it cannot change what others see. The first
    call of each task warms up and is not timed.
    """
    width, height = settings.preprocess.resize

    warm = set()  # a task has its own

    def work(r):
        image = np.frombuffer(r.image, np.uint8).reshape(height, width, 3)
        mask = np.frombuffer(r.mask, np.uint8).reshape(height, width)
        if not warm:
            extractor(image.copy(), mask.copy())
            warm.add(extractor.short_name)
        a, b = image.copy(), mask.copy()
        began = time.perf_counter()
        vector = extractor(a, b)
        yield extractor.short_name, r.record_index, r.variant, r.label, r.path, vector.tolist(), time.perf_counter() - began

    kept = prepared.where("NOT failed OR substituted").select("path", "label", "record_index", "variant", "image", "mask")
    return each(kept, work, "technique string, group long, variant int, label long, path string, features array<double>, extraction_s double")


def matrix_summary(matrix: DataFrame, prepared: DataFrame | None = None) -> DataFrame:
    """technique, rows, originals, augmented, dim, mean_extraction_s; and, of the prepared samples, failed ones and those excluded for it."""
    summary = matrix.groupBy("technique").agg(F.count("*").alias("rows"), F.count_if(F.col("variant") == 0).alias("originals"), F.count_if(F.col("variant") > 0).alias("augmented"), F.max(F.size("features")).alias("dim"), F.avg("extraction_s").alias("mean_extraction_s"))
    if prepared is None:
        return summary
    # one row on the right
    return summary.crossJoin(F.broadcast(prepared.agg(F.count_if("failed").alias("n_failed"), F.count_if(F.col("failed") & ~F.col("substituted")).alias("excluded"))))


def validate_features(matrix: DataFrame, dim: int) -> DataFrame:
    """matrix and problem: null, or what breaks the contract of dim finite values."""
    bad = F.filter("features", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return matrix.withColumn("problem", F.when(F.size("features") != dim, F.format_string("%d features but %d declared", F.size("features"), F.lit(dim))).when(F.size(bad) > 0, F.format_string("%d non-finite value(s)", F.size(bad))))


def coverage_summary(prepared: DataFrame, by: str = "class_folder") -> DataFrame:
    """n_sampled, mean, least and largest coverage, failures, and the polarities chosen."""
    return prepared.groupBy(by).agg(
        F.count("*").alias("n_sampled"), F.avg("coverage").alias("mean_coverage"), F.min("coverage").alias("min_coverage"), F.max("coverage").alias("max_coverage"),
        F.count_if("failed").alias("n_failed"), F.count_if(F.col("polarity") == "bright").alias("n_polarity_bright"), F.count_if(F.col("polarity") == "dark").alias("n_polarity_dark"),
    )
