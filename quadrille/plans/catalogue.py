"""Named queries over the driver's tables, with SQL equivalents.

The tables hold no images: `embeddings` is a feature matrix, `conversations` has
groups (conv_id) and variants (turn), `labels` has truth and prediction,
`events.value` stands for durations, and ids of `embeddings` draw discs, which
the pixel kernels then work on; their SQL draws the same discs by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions.descriptors import Colour, CoOccurrence
from ..functions.extractors import MeanColour
from ..operators import grid, metrics, partition, prepare, svm
from ..operators.cuts import durable
from ..settings import Augmentation, Preprocess, Settings
from ..sources import staging
from . import drawn

SEED = 42
FOLDS = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label")


def _spec(spark, n):
    return spark.createDataFrame([(i, f"class{i}") for i in range(n)], "label int, display_name string")


def _pairs(spark, sf_dir):
    return _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("predicted"))


def _turns(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group"), F.col("turn").alias("variant"))
    return c.withColumn("label", F.col("group") % 3)


def _rounded(df: DataFrame, *columns: str, to: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in columns})


# --- partition ---------------------------------------------------------------


def class_counts_zero_filled(spark, sf_dir):
    return partition.class_counts(_vectors(spark, sf_dir), _spec(spark, 12))


def stratified_split_rows(spark, sf_dir):
    return partition.stratified_split(_vectors(spark, sf_dir), "vec_id", 0.2, SEED)


def stratified_split_counts(spark, sf_dir):
    return stratified_split_rows(spark, sf_dir).groupBy("label", "split").agg(F.count("*").alias("n"))


def split_disjoint_intersect(spark, sf_dir):
    s = stratified_split_rows(spark, sf_dir)
    both = s.where("split = 'train'").select("vec_id").intersect(s.where("split = 'test'").select("vec_id"))
    return both.agg(F.count("*").alias("n_shared"))


def split_cover_except(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id").exceptAll(stratified_split_rows(spark, sf_dir).select("vec_id")).agg(F.count("*").alias("n_lost"))


def kfold_assignment(spark, sf_dir):
    return partition.kfold(_vectors(spark, sf_dir), "vec_id", FOLDS, SEED)


def group_safe_folds(spark, sf_dir):
    sides = partition.fold_sides(partition.group_folds(_turns(spark, sf_dir), FOLDS, SEED), FOLDS)
    return sides.groupBy("eval_fold", "side").agg(F.count("*").alias("n_rows"), F.countDistinct("group").alias("n_groups"))


def fold_leakage_check(spark, sf_dir):
    sides = partition.fold_sides(partition.group_folds(_turns(spark, sf_dir), FOLDS, SEED), FOLDS)
    return partition.leaking_groups(sides).agg(F.count("*").alias("n_leaks"))


def naive_leakage_control(spark, sf_dir):
    """Folds over rows instead of groups must leak."""
    rows = _turns(spark, sf_dir).withColumn("row_key", F.concat_ws("|", "group", "variant"))
    sides = partition.fold_sides(partition.kfold(rows, "row_key", FOLDS, SEED).withColumn("variant", F.lit(0)), FOLDS)
    return partition.leaking_groups(sides).agg(F.count("*").alias("n_leaks"), F.countDistinct("group").alias("n_groups"))


def sample_per_class(spark, sf_dir):
    return partition.sample_per_class(_vectors(spark, sf_dir), "vec_id", 12, SEED)


# --- metrics -----------------------------------------------------------------


def confusion_matrix(spark, sf_dir):
    return _rounded(metrics.confusion(_pairs(spark, sf_dir), _spec(spark, 3)), "share")


def per_class_prf(spark, sf_dir):
    return _rounded(metrics.per_class(_pairs(spark, sf_dir), _spec(spark, 3)), "precision", "recall", "f1")


def headline_metrics(spark, sf_dir):
    return _rounded(metrics.headline(_pairs(spark, sf_dir)), "accuracy", "macro_f1", "weighted_f1")


def _by_lang(spark, sf_dir):
    return _pairs(spark, sf_dir).join(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


def metrics_wide(spark, sf_dir):
    wide = metrics.wide(_by_lang(spark, sf_dir), [(0, "low"), (1, "high")], "lang")
    return _rounded(wide, *[c for c in wide.columns if c != "lang"])


def _fold_scores(spark, sf_dir):
    folded = _by_lang(spark, sf_dir).withColumnRenamed("lang", "technique").withColumn("fold", (F.col("doc_id") % FOLDS).cast("int"))
    return metrics.headline(folded, ["technique", "fold"])


def cv_summary(spark, sf_dir):
    return _rounded(metrics.cv_summary(_fold_scores(spark, sf_dir)), "mean_accuracy", "std_accuracy", "mean_macro_f1", "std_macro_f1")


def paired_t_test(spark, sf_dir):
    return _rounded(metrics.paired_t(_fold_scores(spark, sf_dir), "en", "fr", "accuracy"), "mean_difference", "t", to=6)


def technique_comparisons(spark, sf_dir):
    """All pairs of techniques over the folds: t, its probability, and that of all pairs together."""
    return _rounded(metrics.comparisons(_fold_scores(spark, sf_dir), "accuracy"), "mean_difference", "t", "p", "p_holm", to=6)


def technique_ranks(spark, sf_dir):
    return _rounded(metrics.ranks(_fold_scores(spark, sf_dir), "accuracy"), "mean_rank", "mean_score")


def timing_summary(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_type", F.col("value").alias("seconds"))
    return _rounded(metrics.timing_summary(events, "event_type"), "mean_s", "median_s", "std_s", to=6)


# --- features and models -----------------------------------------------------


def _feature_rows(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return e.select(F.lit("T").alias("technique"), F.col("vec_id").alias("group"), F.lit(0).alias("variant"), "label", F.col("embedding").alias("features"))


def fold_standardise(spark, sf_dir):
    folded = partition.group_folds(_feature_rows(spark, sf_dir).select("group", "variant", "label", "features"), FOLDS, SEED)
    return _rounded(svm.fold_scaling(partition.fold_sides(folded, FOLDS)), "mean", "scale", to=7)


def feature_vector_validate(spark, sf_dir):
    # every fifth vector is told to have a length it does not have
    rows = _feature_rows(spark, sf_dir).withColumn("features", F.when(F.col("group") % 5 == 0, F.slice("features", 1, 63)).otherwise(F.col("features")))
    return prepare.validate_features(rows, 64).select("group", "problem")


def svm_cross_validate(spark, sf_dir):
    s = Settings()
    scores = svm.cross_validate(_feature_rows(spark, sf_dir), folds=s.partition.cv_folds, **svm.chosen(s))
    return scores.select("technique", "fold", "accuracy", "macro_f1", "weighted_f1", "solver", "converged")


def held_out_scores(spark, sf_dir):
    """A model of the training side of the split, judged by the test side."""
    s = Settings()
    split = partition.stratified_split(_feature_rows(spark, sf_dir), "group", s.partition.test_size, s.seed)
    side = lambda name: split.where(F.col("split") == name).drop("split")
    found = svm.held_out_predictions(side("train"), side("test"), **svm.chosen(s))
    return metrics.headline(found, ["technique"]).join(found.groupBy("technique").agg(F.count("*").alias("n"), F.bool_and("converged").alias("converged")), "technique")


def augmentation_plan(spark, sf_dir):
    ids = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_index"))
    return prepare.augmentation_plan(ids, Settings())


# --- pixels ------------------------------------------------------------------


def _discs(spark, sf_dir):
    ids = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return drawn.discs(ids.repartition(spark.sparkContext.defaultParallelism))  # ids alone are moved


def _sides(plane):
    t = pixels.otsu(plane)
    return {"bright": plane > t, "dark": plane <= t}


def _chosen(spark, sf_dir):
    """id, polarity, coverage, failed of the side that the segmentation prefers."""

    def kernel(plane):
        sides, s = _sides(plane), Settings().segmentation
        name = pixels.preferred(sides, s)
        coverage = float(sides[name].mean())
        return [(name, coverage, not s.min_mask_fraction <= coverage <= s.max_mask_fraction)]

    return drawn.with_kernel(_discs(spark, sf_dir), kernel, "polarity string, coverage double, failed boolean")


def otsu_threshold(spark, sf_dir):
    return drawn.with_kernel(_discs(spark, sf_dir), lambda plane: [(pixels.otsu(plane),)], "threshold int")


def mask_coverage_and_border(spark, sf_dir):
    kernel = lambda plane: [(name, float(mask.mean()), pixels.border_fraction(mask)) for name, mask in _sides(plane).items()]
    return _rounded(drawn.with_kernel(_discs(spark, sf_dir), kernel, "polarity string, coverage double, border double"), "coverage", "border")


def auto_polarity_choice(spark, sf_dir):
    return _rounded(_chosen(spark, sf_dir), "coverage")


def segmentation_failures(spark, sf_dir):
    bad = _chosen(spark, sf_dir).where("failed")
    return _rounded(bad.select("id", "coverage", F.when(F.col("coverage") < 0.05, "below").otherwise("above").alias("bound")), "coverage")


def coverage_summary(spark, sf_dir):
    samples = _chosen(spark, sf_dir).withColumn("class_folder", F.concat(F.lit("class"), F.col("id") % 3))
    return _rounded(prepare.coverage_summary(samples), "mean_coverage", "min_coverage", "max_coverage")


def _coloured(plane):
    return plane[:, :, None].repeat(3, axis=2)


_SUMS = "total long, checksum long"


def flip_brightness_pixels(spark, sf_dir):
    """A checksum of each disc after mirroring and a gain of 1.25 with saturation."""
    kernel = lambda plane: [drawn.checksum(pixels.augment(_coloured(plane), pixels.Op(True, 0.0, 1.25))[:, :, 1])]
    return drawn.with_kernel(_discs(spark, sf_dir), kernel, _SUMS)


def area_resize(spark, sf_dir):
    """A checksum of each disc at half its width and a quarter of its height."""
    kernel = lambda plane: [drawn.checksum(pixels.resize_area(_coloured(plane), (12, 6))[:, :, 0])]
    return drawn.with_kernel(_discs(spark, sf_dir), kernel, _SUMS)


def gaussian_blur(spark, sf_dir):
    """A checksum of each disc under binomial taps of five, mirrored at the border."""
    kernel = lambda plane: [drawn.checksum(pixels.gaussian(_coloured(plane), (5, 5), 0.0)[:, :, 2])]
    return drawn.with_kernel(_discs(spark, sf_dir), kernel, _SUMS)


def closed_masks(spark, sf_dir):
    """Pixels and checksum of a speckled mask before and after closing with an element of three."""

    def kernel(plane):
        mask = plane % 8 > 4
        return [(int(mask.sum()), *drawn.checksum(pixels.close(mask, (3, 3))))]

    return drawn.with_kernel(_discs(spark, sf_dir), kernel, "before long, " + _SUMS)


def grey_pairs(spark, sf_dir):
    """How often grey values stand side by side, of every disc: the counts that texture is described by."""
    counter = CoOccurrence(distances=(1,), angles=(0,))

    def kernel(plane):
        pairs, times = counter.tally(_coloured(plane), plane * 0 + 255)[1, 0]
        return zip((pairs // 256).tolist(), (pairs % 256).tolist(), times.tolist(), strict=True)

    return drawn.with_kernel(_discs(spark, sf_dir), kernel, "left int, right int, n long")


def colour_counts(spark, sf_dir):
    """Hues, saturations and values of the coloured discs that are neither washed out nor glaring, and how many pixels have them."""
    import numpy as np

    counter = Colour()

    def count(r):
        image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
        tally = counter.tally(image, np.full(image.shape[:2], 255, np.uint8))
        return [(r.record_index, name, int(v), int(tally[k, v])) for k, name in enumerate(("hue", "saturation", "value")) for v in np.flatnonzero(tally[k])]

    return prepare.each(disc_images(spark, sf_dir).select("record_index", "height", "width", "data"), count, "id long, channel string, level int, n long")


def disc_images(spark: SparkSession, sf_dir: str, side: int = 96) -> DataFrame:
    """Images of coloured discs, one for each vector, as the image source would give them."""
    import numpy as np
    import pandas as pd

    columns = ["path", "label", "class_folder", "source", "record_index", "height", "width", "channels", "data"]

    def draw(batches):
        y, x = np.mgrid[:side, :side] - side // 2
        for b in batches:
            rows = []
            for i, k in zip(b.vec_id, b.label, strict=True):
                frame = np.full((side, side, 3), 20 + i % 20, np.uint8)
                frame[x * x + y * y <= (side // 8 + i % (side // 4)) ** 2] = (40, 40 + 18 * (k % 10), 220 - 18 * (k % 10))
                rows.append((f"disc/{i}", k, f"class{k}", "drawn", i, side, side, 3, frame.tobytes()))
                if len(rows) == 64:  # pixels of no more are held
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    schema = "path string, label int, class_folder string, source string, record_index long, height int, width int, channels int, data binary"
    ids = _vectors(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)  # ids alone are moved
    return ids.mapInPandas(draw, schema)


def _prepared(spark, sf_dir):
    settings = Settings(preprocess=Preprocess(resize=(64, 64)), augmentation=Augmentation(variants_per_image=1))
    return prepare.prepare(disc_images(spark, sf_dir), settings, augment=True), settings


def prepared_samples(spark, sf_dir):
    """Augmentation, preprocessing and segmentation of every disc, originals and one variant."""
    samples, _ = _prepared(spark, sf_dir)
    return samples.select("path", "label", "record_index", "variant", "bbox", F.size("contour").alias("contour_points"), F.round("coverage", 6).alias("coverage"), "polarity", "threshold", "failed", "reason")


def feature_matrix(spark, sf_dir):
    samples, settings = _prepared(spark, sf_dir)
    return prepare.feature_matrix(samples, MeanColour(), settings).select("technique", "group", "variant", "label", "features")


def sub_comparisons(spark, sf_dir):
    """Bins and colour spaces, and levels and distances, on the folds of the discs."""
    settings = Settings(preprocess=Preprocess(resize=(64, 64)))
    chosen = [*grid.colour_settings(("HSV", "LAB"), (8, 32)), *grid.texture_settings((8, 32), ((1,),), (True,))]
    samples = durable(prepare.described(disc_images(spark, sf_dir), [c.extractor for c in chosen], settings))
    return grid.fold_table(prepare.matrix_of(samples), chosen, folds=FOLDS, **svm.chosen(settings))


# --- staging -----------------------------------------------------------------


def _listed(spark, sf_dir):
    """Documents as files: source, language and id make up folders and names."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    k = F.col("doc_id")
    split = F.element_at(F.array(*[F.lit(x) for x in ("Train", "test", "other", "VALID")]), (k % 4 + 1).cast("int"))
    folder = F.element_at(F.array(*[F.lit(x) for x in ("rotten_apples", "Ripe-Apple", "unripe apple", "fresh pineapple", "banana", "overripeapple", "apple")]), (k % 7 + 1).cast("int"))
    name = F.format_string("img_%03d.PNG", k % 50)
    return d.select(F.concat_ws("/", "source", split, folder).alias("folder"), F.lit("root").alias("root_name"), name.alias("name"), F.col("n_chars").alias("length"), "doc_id")


def folder_classify(spark, sf_dir):
    return staging.folders(_listed(spark, sf_dir), {"RipeApple": "Apple"})


def staging_manifest(spark, sf_dir):
    files = _listed(spark, sf_dir)
    parts = F.split("folder", "/")
    named = files.withColumn("class_name", staging.classify_folder(F.element_at(parts, -1), F.element_at(parts, -2))).where("class_name IS NOT NULL")
    files = named.select("class_name", "folder", "name", F.format_string("/in/%s/%d/%s", "folder", "doc_id", "name").alias("path"), "length")
    return staging.manifest(files)


def staging_tallies(spark, sf_dir):
    planned = staging_manifest(spark, sf_dir)
    present = planned.where("length % 2 = 0")
    return staging.tallies(staging.with_status(planned, present))


QUERIES = {
    f.__name__: f
    for f in (
        class_counts_zero_filled, stratified_split_rows, stratified_split_counts, split_disjoint_intersect, split_cover_except, kfold_assignment, group_safe_folds, fold_leakage_check, naive_leakage_control, sample_per_class,
        confusion_matrix, per_class_prf, headline_metrics, metrics_wide, cv_summary, paired_t_test, technique_comparisons, technique_ranks, timing_summary, fold_standardise, feature_vector_validate, svm_cross_validate, held_out_scores, augmentation_plan,
        otsu_threshold, mask_coverage_and_border, auto_polarity_choice, segmentation_failures, coverage_summary, flip_brightness_pixels, area_resize, gaussian_blur, closed_masks, grey_pairs, colour_counts, prepared_samples, feature_matrix, sub_comparisons, folder_classify, staging_manifest, staging_tallies,
    )
}

# --- the same in SQL ---------------------------------------------------------

_RANKED = "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS r FROM embeddings"
_QUOTA = """n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
    w AS (SELECT label, n, sum(n) OVER () AS total, ceil(round(sum(n) OVER () * 0.2, 9)) AS wanted FROM n),
    f AS (SELECT label, wanted, (wanted * n)::BIGINT // total::BIGINT AS whole, (wanted * n)::BIGINT % total::BIGINT AS rest FROM w),
    q AS (SELECT label, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= wanted - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM f)"""
_SPLIT = f"WITH r AS ({_RANKED}), {_QUOTA}, s AS (SELECT vec_id, label, CASE WHEN r <= quota THEN 'test' ELSE 'train' END AS split FROM r JOIN q USING (label))"
_GROUPS = """WITH t AS (SELECT conv_id AS grp, turn AS variant, conv_id % 3 AS label FROM conversations),
    g AS (SELECT grp, arg_min(label, variant) AS label FROM t GROUP BY grp),
    k AS (SELECT grp, ((row_number() OVER (ORDER BY label, md5('42|' || grp), grp) - 1) % 5)::INTEGER AS fold FROM g),
    s AS (SELECT t.grp, e.f::INTEGER AS eval_fold, CASE WHEN fold <> e.f THEN 'train' WHEN variant = 0 THEN 'validation' END AS side
          FROM t JOIN k USING (grp) CROSS JOIN range(5) AS e(f))"""
_NAIVE = """WITH t AS (SELECT conv_id AS grp, conv_id % 3 AS label, conv_id || '|' || turn AS k FROM conversations),
    f AS (SELECT grp, ((row_number() OVER (ORDER BY label, md5('42|' || k), k) - 1) % 5)::INTEGER AS fold FROM t),
    s AS (SELECT grp, e.f AS eval_fold, fold = e.f AS held FROM f CROSS JOIN range(5) AS e(f)),
    l AS (SELECT eval_fold, grp FROM s GROUP BY ALL HAVING count(DISTINCT held) > 1)"""


def _counts_sql(source: str, by: str = "") -> str:
    comma = f"{by}, " if by else ""
    return f"""x AS ({source}), sides AS (
        SELECT {comma}label, 1 AS s, 0 AS p, (label = predicted)::INTEGER AS h FROM x
        UNION ALL SELECT {comma}predicted, 0, 1, 0 FROM x),
    c AS (SELECT {comma}label, sum(s) AS support, sum(p) AS n_predicted, sum(h) AS n_right FROM sides GROUP BY {comma}label),
    m AS (SELECT *, CASE WHEN n_predicted = 0 THEN 0.0 ELSE n_right::DOUBLE / n_predicted END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE n_right::DOUBLE / support END AS recall,
          CASE WHEN support + n_predicted = 0 THEN 0.0 ELSE 2.0 * n_right / (support + n_predicted) END AS f1 FROM c)"""


_PAIRS = "SELECT doc_id, quality AS label, toxic AS predicted FROM labels"
_LANG = "SELECT d.lang, l.quality AS label, l.toxic AS predicted, l.doc_id FROM labels l JOIN documents d USING (doc_id)"
_FOLDED = "SELECT lang || '/' || (doc_id % 5) AS k, label, predicted FROM (" + _LANG + ")"
_HEAD = "sum(n_right)::DOUBLE / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support)::DOUBLE / sum(support) AS weighted_f1"
_FOLD_SCORES = f"WITH {_counts_sql(_FOLDED, 'k')}, h AS (SELECT split_part(k, '/', 1) AS technique, split_part(k, '/', 2)::INTEGER AS fold, {_HEAD} FROM m GROUP BY k)"
_DISCS = """WITH p AS (SELECT vec_id AS id, (k % 24)::INTEGER AS x, (k // 24)::INTEGER AS y FROM embeddings CROSS JOIN range(576) AS r(k)),
    d AS (SELECT id, x, y, ((CASE WHEN ((x - 12) * (x - 12) + (y - 12) * (y - 12) <= (1 + id % 17) * (1 + id % 17)) = (id % 2 = 0) THEN 180 + id % 40 ELSE 30 + id % 20 END)
          + (x * 7 + y * 13 + id * 31) % 8)::INTEGER AS v FROM p)"""
_OTSU = (
    _DISCS
    + """, h AS (SELECT id, v, count(*) AS c FROM d GROUP BY id, v),
    u AS (SELECT id, v, sum(c) OVER w AS n, sum(c * v) OVER w AS s, sum(c) OVER (PARTITION BY id) AS nn, sum(c * v) OVER (PARTITION BY id) AS ss
          FROM h WINDOW w AS (PARTITION BY id ORDER BY v ROWS UNBOUNDED PRECEDING)),
    z AS (SELECT id, v, CASE WHEN n < nn THEN (ss * n - s * nn)::DOUBLE * (ss * n - s * nn)::DOUBLE / (n * (nn - n))::DOUBLE ELSE 0.0 END AS spread FROM u),
    t AS (SELECT id, v AS threshold FROM z QUALIFY row_number() OVER (PARTITION BY id ORDER BY spread DESC, v) = 1)"""
)
_SIDES = (
    _OTSU
    + """, e AS (SELECT id, v > threshold AS up, (x = 0)::INTEGER + (x = 23)::INTEGER + (y = 0)::INTEGER + (y = 23)::INTEGER AS edge FROM d JOIN t USING (id)),
    b AS (SELECT id, pol AS polarity, sum((up = (pol = 'bright'))::INTEGER)::DOUBLE / count(*) AS coverage,
          sum(CASE WHEN up = (pol = 'bright') THEN edge ELSE 0 END)::DOUBLE / sum(edge) AS border FROM e CROSS JOIN (VALUES ('bright'), ('dark')) AS o(pol) GROUP BY ALL),
    c AS (SELECT *, NOT coverage BETWEEN 0.05 AND 0.95 AS failed FROM b
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY (NOT coverage BETWEEN 0.05 AND 0.95)::INTEGER, border, -coverage, polarity) = 1)"""
)
_LISTED = """WITH l AS (SELECT doc_id, n_chars AS length, source || '/' || (['Train', 'test', 'other', 'VALID'])[doc_id % 4 + 1] || '/'
    || (['rotten_apples', 'Ripe-Apple', 'unripe apple', 'fresh pineapple', 'banana', 'overripeapple', 'apple'])[doc_id % 7 + 1] AS folder,
    printf('img_%03d.PNG', doc_id % 50) AS name FROM documents)"""


def _class_sql(folder: str) -> str:
    squeezed = f"translate(lower(split_part({folder}, '/', 2) || '/' || split_part({folder}, '/', 3)), '_- ', '')"
    cases = " ".join(f"WHEN {' OR '.join(f'contains({squeezed}, {t!r})' for t in tokens)} THEN {name!r}" for name, tokens in staging.TOKENS.items())
    return f"CASE WHEN NOT contains({squeezed}, 'apple') THEN NULL {cases} END"


_MANIFEST = f"""{_LISTED}, c AS (SELECT {_class_sql("folder")} AS class_name, folder, name, printf('/in/%s/%d/%s', folder, doc_id, name) AS path, length FROM l),
    n AS (SELECT *, row_number() OVER (PARTITION BY class_name, name ORDER BY folder, lower(name), name, path) > 1 AS later FROM c WHERE class_name IS NOT NULL),
    a AS (SELECT *, CASE WHEN later THEN split_part(folder, '/', 3) || '__' || name ELSE name END AS alt FROM n),
    k AS (SELECT *, row_number() OVER (PARTITION BY class_name, alt ORDER BY folder, lower(name), name, path) > 1 AS taken FROM a),
    m AS (SELECT class_name, folder, name, path, length, CASE WHEN later AND taken THEN regexp_replace(name, '\\.[^.]+$', '') || '__' || left(sha1(path), 8) || regexp_extract(name, '\\.[^.]+$')
          WHEN taken THEN split_part(folder, '/', 3) || '__' || name ELSE alt END AS target, later OR taken AS renamed FROM k)"""

SQL: dict[str, str] = {
    "class_counts_zero_filled": "SELECT r.k::INTEGER AS label, 'class' || r.k AS display_name, count(e.label) AS n FROM range(12) AS r(k) LEFT JOIN embeddings e ON e.label = r.k GROUP BY r.k",
    "stratified_split_rows": f"{_SPLIT} SELECT vec_id, label, split FROM s",
    "stratified_split_counts": f"{_SPLIT} SELECT label, split, count(*) AS n FROM s GROUP BY ALL",
    "split_disjoint_intersect": f"{_SPLIT} SELECT count(*) AS n_shared FROM (SELECT vec_id FROM s WHERE split = 'train' INTERSECT SELECT vec_id FROM s WHERE split = 'test')",
    "split_cover_except": f"{_SPLIT} SELECT count(*) AS n_lost FROM (SELECT vec_id FROM embeddings EXCEPT ALL SELECT vec_id FROM s)",
    "kfold_assignment": "SELECT vec_id, label, ((row_number() OVER (ORDER BY label, md5('42|' || vec_id), vec_id) - 1) % 5)::INTEGER AS fold FROM embeddings",
    "group_safe_folds": f"{_GROUPS} SELECT eval_fold, side, count(*) AS n_rows, count(DISTINCT grp) AS n_groups FROM s WHERE side IS NOT NULL GROUP BY ALL",
    "fold_leakage_check": f"{_GROUPS} SELECT count(*) AS n_leaks FROM (SELECT eval_fold, grp FROM s WHERE side IS NOT NULL GROUP BY ALL HAVING count(DISTINCT side) > 1)",
    "naive_leakage_control": f"{_NAIVE} SELECT count(*) AS n_leaks, count(DISTINCT grp) AS n_groups FROM l",
    "sample_per_class": f"SELECT vec_id, label FROM ({_RANKED}) WHERE r <= 12",
    "confusion_matrix": """WITH f AS (SELECT a.k::INTEGER AS label, b.k::INTEGER AS predicted FROM range(3) AS a(k) CROSS JOIN range(3) AS b(k)),
        n AS (SELECT f.label, f.predicted, count(l.doc_id) AS n FROM f LEFT JOIN labels l ON l.quality = f.label AND l.toxic = f.predicted GROUP BY ALL)
        SELECT label, predicted, n, round(CASE WHEN sum(n) OVER (PARTITION BY label) = 0 THEN 0.0 ELSE n::DOUBLE / sum(n) OVER (PARTITION BY label) END, 9) AS share FROM n""",
    "per_class_prf": f"""WITH {_counts_sql(_PAIRS)} SELECT r.k::INTEGER AS label, 'class' || r.k AS display_name, round(coalesce(precision, 0.0), 9) AS precision,
        round(coalesce(recall, 0.0), 9) AS recall, round(coalesce(f1, 0.0), 9) AS f1, coalesce(support, 0)::BIGINT AS support FROM range(3) AS r(k) LEFT JOIN m ON m.label = r.k""",
    "headline_metrics": f"WITH {_counts_sql(_PAIRS)}, h AS (SELECT {_HEAD} FROM m) SELECT round(accuracy, 9) AS accuracy, round(macro_f1, 9) AS macro_f1, round(weighted_f1, 9) AS weighted_f1 FROM h",
    "metrics_wide": f"WITH {_counts_sql('SELECT lang, label, predicted FROM (' + _LANG + ')', 'lang')} SELECT lang, "
    + ", ".join(f"round(coalesce(max(CASE WHEN label = {k} THEN {m} END), 0.0), 9) AS {m}_{x}" for k, x in ((0, "low"), (1, "high")) for m in ("precision", "recall", "f1"))
    + " FROM m GROUP BY lang",
    "cv_summary": f"{_FOLD_SCORES} SELECT technique, count(*) AS folds, "
    + ", ".join(f"round({'avg' if n == 'mean' else 'stddev_samp'}({c}), 9) AS {n}_{c}" for c in ("accuracy", "macro_f1") for n in ("mean", "std"))
    + " FROM h GROUP BY technique",
    "paired_t_test": f"""{_FOLD_SCORES}, d AS (SELECT x.accuracy - y.accuracy AS d FROM h x JOIN h y ON x.fold = y.fold WHERE x.technique = 'en' AND y.technique = 'fr')
        SELECT count(*) AS n, round(avg(d), 6) AS mean_difference, round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END, 6) AS t FROM d""",
    # Student's tail by its finite sums: terms are products of (k - 1) / k and cos^2
    "technique_comparisons": f"""{_FOLD_SCORES}, d AS (SELECT x.technique AS a, y.technique AS b, x.accuracy - y.accuracy AS d FROM h x JOIN h y ON x.fold = y.fold WHERE x.technique < y.technique),
        s AS (SELECT a, b, count(*) AS n, avg(d) AS m, CASE WHEN count(*) > 1 THEN stddev_samp(d) END AS sd FROM d GROUP BY a, b),
        f AS (SELECT *, sd <= 1e-12 * (1 + abs(m)) AS flat, CASE WHEN NOT (sd <= 1e-12 * (1 + abs(m))) THEN m / (sd / sqrt(n)) END AS t FROM s),
        g AS (SELECT *, atan(abs(t) / sqrt(n - 1)) AS th FROM f),
        u AS (SELECT *, CASE WHEN (n - 1) % 2 = 1 THEN list_filter(range(3, n - 1), lambda k: k % 2 = 1) ELSE list_filter(range(2, n - 1), lambda k: k % 2 = 0) END AS ks FROM g),
        v AS (SELECT *, CASE WHEN n = 2 THEN 0 ELSE (CASE WHEN (n - 1) % 2 = 1 THEN cos(th) ELSE 1 END)
              * (1 + coalesce(list_sum(list_transform(range(1, len(ks) + 1), lambda i: list_product(list_transform(ks[1:i], lambda k: cos(th) * cos(th) * (k - 1) / k)))), 0)) END AS total FROM u),
        p AS (SELECT *, CASE WHEN sd IS NULL THEN NULL WHEN flat THEN CASE WHEN abs(m) <= 1e-12 THEN 1.0 ELSE 0.0 END
              ELSE greatest(0.0, 1 - CASE WHEN (n - 1) % 2 = 1 THEN 2 / pi() * (th + sin(th) * total) ELSE sin(th) * total END) END AS p FROM v),
        q AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, p * (count(*) OVER (PARTITION BY p IS NULL) - row_number() OVER (PARTITION BY p IS NULL ORDER BY p, a, b) + 1)) END AS held FROM p)
        SELECT a AS first, b AS second, n, round(m, 6) AS mean_difference, round(t, 6) AS t, round(p, 6) AS p,
               round(max(held) OVER (PARTITION BY p IS NULL ORDER BY p, a, b ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM q""",
    "technique_ranks": f"""{_FOLD_SCORES}, r AS (SELECT technique, fold, accuracy, round(accuracy, 12) AS s FROM h),
        k AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY s DESC) AS place, count(*) OVER (PARTITION BY fold, s) AS ties FROM r)
        SELECT technique, count(*) AS folds, round(avg(place + (ties - 1) / 2.0), 9) AS mean_rank, count(*) FILTER (place = 1) AS best, round(avg(accuracy), 9) AS mean_score FROM k GROUP BY technique""",
    "timing_summary": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_s, round(median(value), 6) AS median_s, round(coalesce(stddev_samp(value), 0), 6) AS std_s FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "fold_standardise": """WITH k AS (SELECT vec_id, embedding, (row_number() OVER (ORDER BY label, md5('42|' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings),
        f AS (SELECT fold, (unnest(range(len(embedding))))::INTEGER AS dim, unnest(embedding)::DOUBLE AS v FROM k)
        SELECT e.f::INTEGER AS eval_fold, dim, round(avg(v), 7) AS mean, round(CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1.0 END, 7) AS scale
        FROM f CROSS JOIN range(5) AS e(f) WHERE f.fold <> e.f GROUP BY ALL""",
    "feature_vector_validate": """SELECT vec_id AS "group", CASE WHEN vec_id % 5 = 0 THEN '63 features but 64 declared' WHEN len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0
        THEN len(list_filter(embedding, lambda x: NOT isfinite(x))) || ' non-finite value(s)' END AS problem FROM embeddings""",
    "otsu_threshold": f"{_OTSU} SELECT id, threshold FROM t",
    "mask_coverage_and_border": f"{_SIDES} SELECT id, polarity, round(coverage, 9) AS coverage, round(border, 9) AS border FROM b",
    "auto_polarity_choice": f"{_SIDES} SELECT id, polarity, round(coverage, 9) AS coverage, failed FROM c",
    "segmentation_failures": f"{_SIDES} SELECT id, round(coverage, 9) AS coverage, CASE WHEN coverage < 0.05 THEN 'below' ELSE 'above' END AS bound FROM c WHERE failed",
    "coverage_summary": f"""{_SIDES} SELECT 'class' || (id % 3) AS class_folder, count(*) AS n_sampled, round(avg(coverage), 9) AS mean_coverage, round(min(coverage), 9) AS min_coverage,
        round(max(coverage), 9) AS max_coverage, count(*) FILTER (failed) AS n_failed, count(*) FILTER (polarity = 'bright') AS n_polarity_bright, count(*) FILTER (polarity = 'dark') AS n_polarity_dark FROM c GROUP BY 1""",
    "flip_brightness_pixels": f"""{_DISCS}, g AS (SELECT id, 23 - x AS x, y, least(round_even(v * 1.25, 0), 255)::BIGINT AS v FROM d)
        SELECT id, sum(v)::BIGINT AS total, sum(v * (x * 31 + y * 17 + 1))::BIGINT AS checksum FROM g GROUP BY id""",
    "area_resize": f"""{_DISCS}, g AS (SELECT id, x // 2 AS x, y // 4 AS y, round_even(sum(v) / 8.0::DOUBLE, 0)::BIGINT AS v FROM d GROUP BY ALL)
        SELECT id, sum(v)::BIGINT AS total, sum(v * (x * 31 + y * 17 + 1))::BIGINT AS checksum FROM g GROUP BY id""",
    "gaussian_blur": f"""{_DISCS}, t AS (SELECT k::INTEGER AS k, ([1, 4, 6, 4, 1])[k + 3] AS w FROM range(-2, 3) AS r(k)),
        a AS (SELECT d.id, o.x::INTEGER AS x, d.y, sum(d.v * t.w) AS v FROM range(24) AS o(x), t JOIN d ON d.x = 23 - abs(23 - abs(o.x + t.k)) GROUP BY ALL),
        b AS (SELECT a.id, a.x, o.y::INTEGER AS y, round_even(sum(a.v * t.w) / 256.0::DOUBLE, 0)::BIGINT AS v FROM range(24) AS o(y), t JOIN a ON a.y = 23 - abs(23 - abs(o.y + t.k)) GROUP BY ALL)
        SELECT id, sum(v)::BIGINT AS total, sum(v * (x * 31 + y * 17 + 1))::BIGINT AS checksum FROM b GROUP BY id""",
    "closed_masks": f"""{_DISCS}, m AS (SELECT id, x, y, v % 8 > 4 AS up FROM d), e AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS e(dx, dy)),
        g AS (SELECT id, x + dx AS x, y + dy AS y, bool_or(up) AS up FROM m, e WHERE x + dx BETWEEN 0 AND 23 AND y + dy BETWEEN 0 AND 23 GROUP BY ALL),
        c AS (SELECT id, x + dx AS x, y + dy AS y, bool_and(up) AS up FROM g, e WHERE x + dx BETWEEN 0 AND 23 AND y + dy BETWEEN 0 AND 23 GROUP BY ALL)
        SELECT id, any_value(n)::BIGINT AS before, count(*) FILTER (c.up) AS total, coalesce(sum(c.x * 31 + c.y * 17 + 1) FILTER (c.up), 0)::BIGINT AS checksum FROM c JOIN (SELECT id, count(*) FILTER (up) AS n FROM m GROUP BY id) USING (id) GROUP BY id""",
    "grey_pairs": f"""{_DISCS} SELECT a.id, a.v AS "left", b.v AS "right", count(*) AS n FROM d a JOIN d b ON a.id = b.id AND a.y = b.y AND b.x = a.x + 1 GROUP BY ALL""",
    "colour_counts": """WITH p AS (SELECT (x - 48) * (x - 48) + (y - 48) * (y - 48) AS away, count(*) AS n FROM range(96) AS a(x), range(96) AS b(y) GROUP BY 1),
        c AS (SELECT vec_id AS id, 12 + vec_id % 24 AS r, 40 AS blue, 40 + 18 * (label % 10) AS green, 220 - 18 * (label % 10) AS red FROM embeddings),
        v AS (SELECT *, greatest(blue, green, red) AS hi, least(blue, green, red) AS lo FROM c),
        k AS (SELECT id, r, hi AS value, round_even((hi - lo) * 255.0::DOUBLE / hi, 0)::INTEGER AS saturation,
              (round_even(((CASE WHEN hi = red THEN (green - blue)::DOUBLE / (hi - lo) WHEN hi = green THEN 2 + (blue - red)::DOUBLE / (hi - lo) ELSE 4 + (red - green)::DOUBLE / (hi - lo) END * 30) % 180 + 180) % 180, 0) % 180)::INTEGER AS hue FROM v),
        s AS (SELECT id, any_value(hue) AS hue, any_value(saturation) AS saturation, any_value(value) AS value, sum(n)::BIGINT AS n FROM k JOIN p ON p.away <= k.r * k.r GROUP BY id)
        SELECT id, 'hue' AS channel, hue::INTEGER AS level, n FROM s UNION ALL SELECT id, 'saturation', saturation::INTEGER, n FROM s UNION ALL SELECT id, 'value', value::INTEGER, n FROM s""",
    "folder_classify": f"""{_LISTED}, f AS (SELECT folder AS relative, count(*) AS images, CASE lower(split_part(folder, '/', 2)) WHEN 'train' THEN 'train' WHEN 'test' THEN 'other' WHEN 'valid' THEN 'other' END AS split FROM l GROUP BY folder)
        SELECT relative, images, split, CASE WHEN split IS DISTINCT FROM 'other' THEN coalesce(CASE WHEN split_part(relative, '/', 3) = 'apple' THEN 'RipeApple' END, {_class_sql("relative")}) END AS class_name,
        CASE WHEN split IS NOT DISTINCT FROM 'other' THEN 'skipped' WHEN class_name IS NULL THEN 'ignored' ELSE 'matched' END AS status FROM f""",
    "staging_manifest": f"{_MANIFEST} SELECT * FROM m",
    "staging_tallies": f"""{_MANIFEST} SELECT class_name, count(*) FILTER (length % 2 <> 0) AS copied, count(*) FILTER (length % 2 = 0) AS skipped,
        count(*) FILTER (renamed) AS renamed, count(*) FILTER (renamed) AS duplicates FROM m GROUP BY class_name""",
}
