import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions.extractors import ExtractionError, Extractor, MeanColour, inside, validated
from quadrille.operators import metrics, partition, prepare, svm
from quadrille.functions.descriptors import REGISTRY
from quadrille.operators.cuts import durable
from quadrille.operators.ranking import global_rank, renumbered
from quadrille.settings import Augmentation, Classifier, Dataset, Preprocess, Settings
from quadrille.sources import images, reports, staging

CLASSES = Dataset(("A", "B", "C"), ("Unripe", "Ripe", "Rotten"))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("data")
    r = np.random.default_rng(0)
    y, x = np.ogrid[:96, :96]
    for k, c in enumerate(CLASSES.classes):
        (top / c).mkdir()
        for i in range(10):
            frame = np.full((96, 96, 3), 25 + 5 * k, np.int16)
            frame[(x - 48) ** 2 + (y - 48) ** 2 <= 28**2] = (40, 40 + 60 * k, 200 - 60 * k)
            frame = np.clip(frame + r.integers(-6, 7, frame.shape), 0, 255).astype(np.uint8)
            (top / c / f"{'Img' if i % 2 else 'img'}_{i:03d}.{'PNG' if i == 3 else 'png'}").write_bytes(images.encode_png(frame))
        (top / c / "notes.txt").write_text("no image")
    return str(top)


@pytest.fixture(scope="module")
def settings():
    return Settings(preprocess=Preprocess(resize=(64, 64)), augmentation=Augmentation(variants_per_image=2))


@pytest.fixture(scope="module")
def records(spark, root):
    return images.load_dataset(spark, root, CLASSES, "test", (".png",)).cache()


@pytest.fixture(scope="module")
def prepared(records, settings):
    return prepare.prepare(images.with_pixels(records), settings, augment=True).cache()


@pytest.fixture(scope="module")
def matrix(prepared, settings):
    return prepare.feature_matrix(prepared, MeanColour(), settings).cache()


def test_loader_orders_by_class_and_name(records):
    rows = records.orderBy("record_index").collect()
    assert [r.record_index for r in rows] == list(range(30)) and [r.label for r in rows] == [0] * 10 + [1] * 10 + [2] * 10
    assert [r.path.rsplit("/", 1)[1].lower()[:7] for r in rows[:10]] == [f"img_{i:03d}" for i in range(10)]
    assert not any("notes" in r.path for r in rows)


def test_loader_names_what_is_missing_before_what_is_empty(spark, tmp_path, root):
    with pytest.raises(images.DatasetError, match="no dataset"):
        images.load_dataset(spark, str(tmp_path / "none"), CLASSES, "x", (".png",))
    (tmp_path / "A").mkdir()
    (tmp_path / "B").mkdir()
    with pytest.raises(images.DatasetError, match=r"missing class folder.*: C$"):
        images.load_dataset(spark, str(tmp_path), CLASSES, "x", (".png",))
    (tmp_path / "C").mkdir()
    with pytest.raises(images.DatasetError, match=r"without images.*: A, B, C$"):
        images.load_dataset(spark, str(tmp_path), CLASSES, "x", (".png",))


def test_pixels_are_three_channels_and_bad_files_raise(spark, tmp_path):
    (tmp_path / "A").mkdir()
    frame = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    (tmp_path / "A" / "a.png").write_bytes(images.encode_png(frame))
    (tmp_path / "A" / "g.png").write_bytes(images.encode_png(frame[:, :, 0].copy()))
    found = images.load_dataset(spark, str(tmp_path), Dataset(("A",)), "x", (".png",))
    got = {r.path[-5:]: images.as_array(r.height, r.width, r.channels, r.data) for r in images.with_pixels(found).collect()}
    assert np.array_equal(got["a.png"], frame) and got["g.png"].shape == (4, 4, 3)
    (tmp_path / "A" / "z.png").write_bytes(b"nothing")
    assert [r.path[-5:] for r in images.undecodable(spark, str(tmp_path / "A")).collect()] == ["z.png"]
    again = images.load_dataset(spark, str(tmp_path), Dataset(("A",)), "x", (".png",))
    with pytest.raises(Exception, match="not a readable image"):
        images.with_pixels(again).collect()


def test_split_is_stratified_disjoint_and_repeatable(spark):
    rows = spark.range(203).select("id", (F.col("id") % 3).alias("label"))
    s = partition.stratified_split(rows, "id", 0.2)
    got = {r.id: r.split for r in s.collect()}
    assert len(got) == 203 and sum(v == "test" for v in got.values()) == 41
    per = [sum(v == "test" and k % 3 == c for k, v in got.items()) for c in range(3)]
    assert max(per) - min(per) <= 1
    assert got == {r.id: r.split for r in partition.stratified_split(rows.repartition(7), "id", 0.2).collect()}
    assert got != {r.id: r.split for r in partition.stratified_split(rows, "id", 0.2, seed=1).collect()}


@pytest.mark.parametrize("shuffles", [1, 4, 7])
def test_folds_cover_and_differ_by_one(spark, shuffles):
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        rows = spark.range(92).select("id", (F.col("id") % 3).alias("label"))
        got = sorted((r.id, r.fold) for r in partition.kfold(rows, "id").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert [i for i, _ in got] == list(range(92))
    sizes = [[sum(f == k and i % 3 == c for i, f in got) for c in range(3)] for k in range(5)]
    assert max(map(sum, sizes)) - min(map(sum, sizes)) <= 1 and np.ptp(sizes, axis=0).max() <= 1


def test_groups_never_cross_a_fold_and_rows_alone_do(spark, matrix):
    sides = partition.fold_sides(partition.group_folds(matrix)).cache()
    assert partition.leaking_groups(sides).count() == 0
    assert sides.where("side = 'validation' AND variant > 0").count() == 0
    assert sides.where("side = 'train' AND variant > 0").count() > 0
    assert sorted(r.group for r in sides.where("side = 'validation'").collect()) == list(range(30))
    other = {(r.group, r.fold) for r in partition.group_folds(matrix.withColumn("features", F.lit(0))).collect()}
    assert other == {(r.group, r.fold) for r in sides.select("group", "fold").collect()}
    naive = partition.fold_sides(partition.kfold(matrix.withColumn("k", F.concat_ws("|", "group", "variant")), "k").withColumn("variant", F.lit(0)))
    assert partition.leaking_groups(naive).count() > 0


def test_folds_without_originals_are_refused(matrix):
    with pytest.raises(ValueError, match="empty"):
        partition.check_folds(partition.fold_sides(partition.group_folds(matrix.limit(0))))
    with pytest.raises(ValueError, match="no original"):
        partition.check_folds(partition.fold_sides(partition.group_folds(matrix.where("variant > 0"))))


def test_matrix_has_provenance_and_no_bad_values(matrix, prepared):
    rows = matrix.collect()
    assert len(rows) == 90 and prepared.where("failed").count() == 0
    assert {(r.group, r.variant) for r in rows} == {(g, v) for g in range(30) for v in range(3)}
    assert all(len(r.features) == 7 and np.isfinite(r.features).all() and r.extraction_s >= 0 and r.label == r.group // 10 for r in rows)
    s = prepare.matrix_summary(matrix).first()
    assert (s.rows, s.originals, s.augmented, s.dim) == (90, 30, 60, 7)
    marked = prepared.withColumns({"failed": F.col("record_index") < 4, "substituted": F.col("record_index") < 1})
    s = prepare.matrix_summary(matrix, marked).first()
    assert (s.rows, s.n_failed, s.excluded) == (90, 12, 9)


def test_training_alone_is_augmented(records, settings):
    split = partition.stratified_split(records, "record_index")
    test = split.where("split = 'test'")
    assert prepare.prepare(images.with_pixels(test), settings).count() == test.count() == 6
    plan = prepare.augmentation_plan(records, settings)
    assert plan.count() == 90 and plan.where("variant = 0 AND (flip OR angle <> 0 OR brightness <> 1)").count() == 0


def test_an_extractor_cannot_change_what_others_see(prepared, settings, matrix):
    class Mutating(Extractor):  # made here, it travels to the workers by value
        name, short_name, dim = "mutating", "BAD", 1

        def extract(self, image, mask):
            image[:] = 0
            mask[:] = 0
            return np.zeros(1)

    assert prepare.feature_matrix(prepared, Mutating(), settings).count() == 90
    again = prepare.feature_matrix(prepared, MeanColour(), settings)
    key = lambda r: (r.group, r.variant, tuple(r.features))
    assert sorted(map(key, again.collect())) == sorted(map(key, matrix.collect()))


def test_discs_are_drawn_few_at_a_time(spark, monkeypatch, tmp_path):
    """A task that draws holds the pixels of 64 images, whatever its batch."""
    import pandas as pd

    from quadrille.plans import catalogue

    spark.range(5).selectExpr("id AS vec_id", "cast(id AS int) AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    held = []
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", lambda self, work, schema: held.append(work))
    catalogue.disc_images(spark, str(tmp_path), 8)
    frames = list(held[0]([pd.DataFrame({"vec_id": range(1000), "label": 3})]))
    assert max(map(len, frames)) <= 64 and [i for f in frames for i in f.record_index] == list(range(1000))


def test_contract_of_extractors():
    with pytest.raises(ExtractionError, match="declares 4"):
        validated([1, 2, 3], 4, "X")
    for bad in (np.nan, np.inf):
        with pytest.raises(ExtractionError, match=r"non-finite.*\[2\]"):
            validated([0, 1, bad], 3, "X")
    with pytest.raises(ExtractionError, match="empty fruit mask"):
        inside(np.zeros((10, 10)), "X")
    assert MeanColour().feature_names[0] == "MC_000" and "7 dimensions" in MeanColour().describe()


def test_failures_are_logged_and_dropped(spark, settings, tmp_path):
    blank = [("p", 0, "A", "s", 0, 20, 20, 3, bytearray(b"\x50" * 1200))]
    frame = spark.createDataFrame(blank, "path string, label int, class_folder string, source string, record_index long, height int, width int, channels int, data binary")
    p = prepare.prepare(frame, settings)
    assert prepare.failures(p).first().reason == "coverage 0.0000 is below 0.05" and prepare.feature_matrix(p, MeanColour(), settings).count() == 0
    put = prepare.prepare(frame, Settings(preprocess=settings.preprocess, segmentation=type(settings.segmentation)(on_failure="fallback")))
    assert put.first().substituted and prepare.feature_matrix(put, MeanColour(), settings).count() == 1
    reports.save_failures(prepare.failures(p).limit(0), str(tmp_path / "f"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).columns == reports.FAILURE_COLUMNS


def test_svm_separates_and_holds_its_conditions():
    r = np.random.default_rng(0)
    x, y = np.concatenate([r.normal(c, 0.6, (40, 2)) for c in ((0, 0), (4, 0), (0, 4))]), np.repeat([0, 1, 2], 40)
    model = svm.KernelSVM().fit(x, y)
    assert (model.predict(x) == y).mean() > 0.97
    k = svm._kernel(x[:80], x[:80], 0.5, "rbf")
    sign = np.where(y[:80] == 0, 1.0, -1.0)
    alpha, bias, done = svm.smo(k, sign, 1.0, tolerance=1e-4)
    assert done and not svm.smo(k, sign, 1.0, rounds=2)[2]
    margin = sign * (k @ (alpha * sign) + bias)
    assert abs(alpha @ sign) < 1e-9 and (alpha >= 0).all() and (alpha <= 1).all()
    assert (margin[alpha < 1e-9] > 1 - 1e-3).all() and (margin[alpha > 1 - 1e-9] < 1 + 1e-3).all()
    assert svm.time_inference(model, x[:5]) > 0 and np.isnan(svm.time_inference(model, x[:0]))


def test_cross_validation_on_separable_classes(matrix):
    folds = svm.cross_validate(matrix).collect()
    assert sorted(r.fold for r in folds) == list(range(5)) and all(r.accuracy == 1.0 and r.macro_f1 == 1.0 and r.fit_seconds > 0 for r in folds)


def test_scaling_is_that_of_the_training_side(matrix):
    sides = partition.fold_sides(partition.group_folds(matrix))
    x = np.array([r.features for r in sides.where("side = 'train' AND eval_fold = 2").select("features").collect()])
    got = sorted(tuple(r) for r in svm.fold_scaling(sides).where("eval_fold = 2").select("dim", "mean", "scale").collect())
    assert np.allclose([g[1] for g in got], x.mean(axis=0)) and np.allclose([g[2] for g in got], np.where(x.std(axis=0) > 0, x.std(axis=0), 1))


def test_macro_f1_leaves_out_classes_that_do_not_occur(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "label int, predicted int")
    spec = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "label int, display_name string")
    h = metrics.headline(pairs).first()
    assert h.accuracy == 0.75 and abs(h.macro_f1 - (2 / 3 + 0.8) / 2) < 1e-12
    assert [r.support for r in metrics.per_class(pairs, spec).orderBy("label").collect()] == [2, 2, 0]
    c = {(r.label, r.predicted): (r.n, r.share) for r in metrics.confusion(pairs, spec).collect()}
    assert len(c) == 9 and c[0, 1] == (1, 0.5) and c[2, 2] == (0, 0.0)
    one = spark.createDataFrame([("T", 0, 0.5, 0.5)], "technique string, fold int, accuracy double, macro_f1 double")
    assert np.isnan(metrics.cv_summary(one).first().std_accuracy)
    t = spark.createDataFrame([("T", 0.5)], "technique string, s double")
    assert metrics.timing_summary(t, "technique", "s").first().std_s == 0.0


def test_folders_and_manifest(spark):
    rows = [("src/train/RottenApples", "x.png"), ("src/test/ripe apple", "x.png"), ("train/raw_apple", "x.png"), ("train/rotten/apple", "x.png"), ("train/banana", "x.png"), ("a/overripe-pineapple", "x.png"), ("train/odd", "x.png"), ("", "x.png")]
    files = spark.createDataFrame([(f, "FreshApple", n) for f, n in rows], "folder string, root_name string, name string")
    got = {r.relative: (r.status, r.class_name) for r in staging.folders(files, staging.parse_overrides(["RipeApple=odd"])).collect()}
    assert got == {
        "src/train/RottenApples": ("matched", "RottenApple"), "src/test/ripe apple": ("skipped", None), "train/raw_apple": ("matched", "UnripeApple"), "train/rotten/apple": ("matched", "RottenApple"),
        "train/banana": ("ignored", None), "a/overripe-pineapple": ("matched", "RottenApple"), "train/odd": ("matched", "RipeApple"), "": ("matched", "RipeApple"),
    }
    with pytest.raises(ValueError, match="Class=folder"):
        staging.parse_overrides(["x"])
    files = spark.createDataFrame([("A", f, n, f"/{f}/{n}", 1) for f, n in (("a/f", "1.png"), ("b/f", "1.png"), ("c/f", "1.png"), ("c/g", "1.png"), ("c/g", "2.png"))], "class_name string, folder string, name string, path string, length long")
    import hashlib

    plan = {r.path: r.target for r in staging.manifest(files).collect()}
    assert plan == {"/a/f/1.png": "1.png", "/b/f/1.png": "f__1.png", "/c/f/1.png": f"1__{hashlib.sha1(b'/c/f/1.png').hexdigest()[:8]}.png", "/c/g/1.png": "g__1.png", "/c/g/2.png": "2.png"}


def test_copies_are_made_once(spark, tmp_path, root):
    files = images.listing(spark, [f"{root}/A"], (".png",)).select(F.lit("A").alias("class_name"), F.lit("A").alias("folder"), "name", "path", "length")
    plan = staging.manifest(files)
    none = spark.createDataFrame([], "class_name string, target string, length long")
    staging.copy(staging.with_status(plan, none), str(tmp_path))
    there = images.listing(spark, [str(tmp_path / "A")], (".png",)).select(F.lit("A").alias("class_name"), F.col("name").alias("target"), "length")
    t = staging.tallies(staging.with_status(plan, there)).first()
    assert (there.count(), t.copied, t.skipped) == (10, 0, 10)


def test_copy_takes_uris_resumes_and_leaves_no_half_files(spark, tmp_path):
    source, target = tmp_path / "down load %20", tmp_path / "sta ged"
    source.mkdir()
    for i in range(6):
        (source / f"a {i}%2F.png").write_bytes(bytes([i]) * (1000 + i))
    names = [f"a {i}%2F.png" for i in range(6)]
    none = spark.createDataFrame([], "class_name string, target string, length long")
    plan = lambda wrong: spark.createDataFrame([("A b", "x", n, f"file:{source}/{n}", 1000 + i + (i == wrong)) for i, n in enumerate(names)], "class_name string, folder string, name string, path string, length long")
    broken = staging.with_status(staging.manifest(plan(3)), none).repartition(6)
    with pytest.raises(Exception, match="when it was listed"):
        staging.copy(broken, f"file://{target}")
    there = sorted(p.name for p in (target / "A b").iterdir())
    assert "a 3%2F.png" not in there and all((target / "A b" / n).stat().st_size == 1000 + names.index(n) for n in there if n in names)
    (target / "A b" / ".part-left").write_bytes(b"half")
    present = spark.createDataFrame([("A b", n, 1000 + names.index(n)) for n in there if n in names], "class_name string, target string, length long")
    again = staging.with_status(staging.manifest(plan(None)), present)
    copied = staging.copy(again, f"file://{target}")
    assert {r.target for r in copied.collect()} == set(names) - set(there) and sorted(p.name for p in (target / "A b").iterdir()) == names
    assert staging.differing(copied, str(target)).count() == 0
    (target / "A b" / names[3]).write_bytes(b"other")
    assert [(r.target, r.found) for r in staging.differing(copied, str(target)).collect()] == [(names[3], "changed")]
    (target / "A b" / names[3]).unlink()
    assert [r.found for r in staging.differing(copied, f"file://{target}").collect()] == ["missing"]
    assert staging.store_of("/x/y z")[1] == "/x/y z" and staging.store_of("file:/x/%20")[1] == "/x/%20" and staging.store_of("mock:///b/c")[1].endswith("b/c")


def test_reports(spark, tmp_path, prepared, settings):
    pairs = spark.createDataFrame([(0, 0), (1, 0)], "label int, predicted int")
    spec = spark.createDataFrame([(0, "a"), (1, "b")], "label int, display_name string")
    assert reports.save_confusion(metrics.confusion(pairs, spec), 2, tmp_path / "c.png").read_bytes()[:4] == b"\x89PNG"
    text = reports.text_report(metrics.headline(pairs), metrics.per_class(pairs, spec), confusion=metrics.confusion(pairs, spec), names=["good", "bad"])
    assert "accuracy" in text and [x.split() for x in text.splitlines()[-2:]] == [["good", "1.000", "0.000"], ["bad", "1.000", "0.000"]]
    assert reports.lettering("0.5").shape == (10, 24) and reports.lettering("l", 1).sum() == 7 and not reports.lettering("é").any()
    assert reports.save_report(spec.limit(0), tmp_path / "x" / "e.csv").read_text() == "label,display_name\n"
    r = prepared.first()
    image, m = np.frombuffer(r.image, np.uint8).reshape(64, 64, 3), np.frombuffer(r.mask, np.uint8).reshape(64, 64)
    drawn = reports.overlay(image, [(p.x, p.y) for p in r.contour], tuple(r.bbox))
    assert reports.grid([(image, image, m, drawn, True)]).shape == (70, 280, 3) and (drawn != image).any()
    s = prepare.coverage_summary(prepared).collect()
    assert sum(x.n_sampled for x in s) == 90 and all(0.05 <= x.min_coverage <= x.mean_coverage <= x.max_coverage <= 0.95 for x in s)


def test_sampling_takes_all_of_small_classes(records):
    assert partition.sample_per_class(records, "record_index", 4).groupBy("label").count().collect()[0]["count"] == 4
    assert partition.sample_per_class(records, "record_index", 50).count() == 30


def test_svm_by_columns_is_that_of_the_whole_kernel(monkeypatch):
    r = np.random.default_rng(1)
    x, y = np.concatenate([r.normal(c, 1.2, (150, 3)) for c in ((0, 0, 0), (3, 0, 0), (0, 3, 0))]), np.repeat([0, 1, 2], 150)
    new = r.normal(1, 2, (400, 3))
    whole = svm.KernelSVM().fit(x, y)
    monkeypatch.setattr(svm, "CACHE", 900)  # three columns, and few rows at once in prediction
    parts = svm.KernelSVM().fit(x, y)
    assert (whole.predict(new) == parts.predict(new)).mean() > 0.99
    for (*_, w, b), (*_, v, a) in zip(whole.models, parts.models, strict=True):
        assert abs(np.abs(w).sum() - np.abs(v).sum()) < 0.01 * np.abs(w).sum() and abs(a - b) < 0.01


def three_classes(spark, n, spread=1.0, techniques="ab", seed=3):
    r = np.random.default_rng(seed)
    label = np.arange(n) % 3
    x = r.normal(0, spread, (n, 4)) + np.array([(0, 0, 0, 5), (3, 0, 0, 5), (0, 3, 0, 5)])[label]
    x[:, 3] = 5  # does not vary
    return spark.createDataFrame([(t, i, 0, int(c), [float(v) for v in f]) for t in techniques for i, (c, f) in enumerate(zip(label, x, strict=True))], "technique string, group long, variant int, label int, features array<double>")


def test_approximation_is_asked_for_and_near_the_exact_solution(spark):
    rows = three_classes(spark, 900)
    exact = {(f.technique, f.fold): f for f in svm.cross_validate(rows, folds=3).collect()}
    assert all(f.solver == "smo" and f.converged for f in exact.values())
    for kernel in ("rbf", "linear"):
        near = svm.cross_validate(rows, folds=3, kernel=kernel, solver="approximate").collect()
        assert len(near) == 6 and all(f.solver == "least squares" and f.converged is None and abs(f.accuracy - exact[f.technique, f.fold].accuracy) < 0.05 for f in near)
    with pytest.raises(ValueError, match="solver"):
        svm.cross_validate(rows, solver="fast")


@pytest.mark.parametrize("most", [450, 100])
def test_pairs_and_decomposition_agree_with_one_task(spark, monkeypatch, most):
    """Folds of 600 rows: whole, by pairs of 400 rows in a task, and by pairs over all tasks."""
    rows = three_classes(spark, 900)
    columns = ["technique", "fold", "group", "predicted"]
    whole = {tuple(r[:3]): r[3] for r in svm.cross_validated_predictions(rows, folds=3).select(*columns).collect()}
    for name, value in (("MAX_ROWS", most), ("WORKING", 24), ("BLOCK_ROWS", 90)):
        monkeypatch.setattr(svm, name, value)
    found = svm.cross_validated_predictions(rows, folds=3).collect()
    assert all(r.solver == "smo by pairs" and r.converged for r in found) and len(found) == len(whole) == 1800
    assert np.mean([whole[r.technique, r.fold, r.group] == r.predicted for r in found]) > 0.995
    assert all(r.gap is None for r in found) if most == 450 else all(-1e-9 < r.gap < 0.01 for r in found)


def test_pairs_beyond_a_task_agree_with_one_task(spark, monkeypatch):
    rows = three_classes(spark, 900, techniques="a")
    whole = {(r.fold, r.group): r.predicted for r in svm.cross_validated_predictions(rows, folds=3).collect()}
    for name, value in (("MAX_ROWS", 100), ("PAIR_VALUES", 0), ("WORKING", 24), ("BLOCK_ROWS", 90)):
        monkeypatch.setattr(svm, name, value)
    found = svm.cross_validated_predictions(rows, folds=3).collect()
    assert len(found) == 900 and all(r.converged and -1e-9 < r.gap < 0.01 for r in found)
    assert np.mean([whole[r.fold, r.group] == r.predicted for r in found]) > 0.995


def test_rows_are_not_sent_to_each_pair(spark, monkeypatch):
    """Of eight classes in two folds a row takes part in seven pairs and is judged by 28; a shuffle must not hold it so often."""
    n, classes = 1600, 8
    r = np.random.default_rng(11)
    x, label = r.normal(0, 1, (n, 64)), np.arange(n) % classes
    x[np.arange(n), label] += 3
    rows = spark.createDataFrame([("t", i, 0, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x, strict=True))], "technique string, group long, variant int, label int, features array<double>")
    rows = durable(rows)
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(e.totalShuffleWrite() for e in (lambda found: [found.apply(i) for i in range(found.size())])(store.executorList(False)))
    monkeypatch.setattr(svm, "MAX_ROWS", 100)
    before = written()
    found = svm.cross_validated_predictions(rows, folds=2).collect()
    assert len(found) == n and {f.solver for f in found} == {"smo by pairs"} and all(f.converged for f in found)
    assert np.mean([f.label == f.predicted for f in found]) > 0.8
    assert written() - before < 15 * x.nbytes


def test_rounds_of_labels_at_random_meet_the_kernel_few_times(monkeypatch):
    """Almost every row is a support vector; its column is needed once, and few of them again."""
    r, n = np.random.default_rng(13), 6000
    z, y = r.normal(size=(n, 64)), np.where(r.random(n) < 0.5, 1.0, -1.0)
    columns, plain = [], svm._decisions
    monkeypatch.setattr(svm, "_decisions", lambda x, support, *more: columns.append(len(support)) or plain(x, support, *more))
    monkeypatch.setattr(svm, "STARTED", 1000, raising=False)
    alpha, f, bias, done = svm.decomposed(z, y, np.ones(n), 1 / 64, "rbf", 256)
    assert done and abs(alpha @ y) < 1e-6 and (alpha >= 0).all() and (alpha <= 1).all()
    assert abs(svm.relative_gap((alpha * y * f).sum(), alpha.sum(), np.maximum(0, 1 - y * (f + bias)).sum())) < 0.01
    assert np.abs(f - svm._kernel(z, z, 1 / 64, "rbf") @ (alpha * y)).max() < 1e-3
    assert sum(columns) < 3.4 * n  # 3.0; from zero 3.8


def test_equal_rows_are_one_with_larger_bounds(spark, monkeypatch):
    """Copies fit a task by what differs in them, and the model is that of all of them."""
    r = np.random.default_rng(7)
    x, label = np.repeat(r.normal(0, 1.2, (200, 2)), 3, axis=0), np.repeat(np.arange(200) % 2, 3)
    x[:, 0] += 2 * label
    new = r.normal(0, 2, (90, 2))
    frame = lambda x, label, low: spark.createDataFrame([("t", low + i, 0, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x, strict=True))], "technique string, group long, variant int, label int, features array<double>")
    train, held = frame(x, label, 0), frame(np.repeat(new, 2, axis=0), np.arange(180) % 2, 1000)
    plain = svm.KernelSVM().fit(x, label).predict(np.repeat(new, 2, axis=0))
    for most, solver in ((300, "smo"), (100, "smo by pairs")):
        monkeypatch.setattr(svm, "MAX_ROWS", most)
        found = svm.held_out_predictions(train, held).collect()
        assert {f.group: f.label for f in found} == {1000 + i: i % 2 for i in range(180)} and {f.solver for f in found} == {solver}
        assert np.mean([plain[f.group - 1000] == f.predicted for f in found]) > 0.98


def test_folds_of_any_size_have_the_solution_of_one_task(spark):
    """Two classes of 10,000 rows, beyond MAX_ROWS: the same answers as sequential minimal optimisation over all of them."""
    n = 20_000
    r = np.random.default_rng(5)
    label = np.arange(n + 2000) % 2
    x = r.normal(0, 1.0, (n + 2000, 3)) + 2.5 * label[:, None]
    frame = lambda low, high: spark.createDataFrame([("t", i, 0, int(label[i]), x[i].tolist()) for i in range(low, high)], "technique string, group long, variant int, label int, features array<double>")
    found = svm.held_out_predictions(frame(0, n), frame(n, n + 2000)).collect()
    own = svm.KernelSVM().fit(x[:n], label[:n])
    plain = own.predict(x[n:])
    assert own.converged and len(found) == 2000 and all(f.solver == "smo by pairs" and f.converged and f.gap < 0.01 for f in found)
    assert np.mean([plain[f.group - n] == f.predicted for f in found]) > 0.998


def test_conditions_that_do_not_hold_are_told(spark, monkeypatch):
    for name, value in (("MAX_ROWS", 100), ("WORKING", 4), ("ROUNDS", 1)):
        monkeypatch.setattr(svm, name, value)
    assert not any(f.converged for f in svm.cross_validate(three_classes(spark, 900, techniques="a"), folds=3).collect())


def test_settings_of_the_classifier_act(spark, matrix):
    weak = {"c": 1e-6, "gamma": 1e-9}
    assert svm.cross_validate(matrix, folds=3).count() == 3
    assert svm.chosen(Settings(seed=7)) == {"seed": 7, "c": 1.0, "gamma": "scale", "kernel": "rbf", "solver": "exact"}
    a, b = (svm.cross_validated_predictions(matrix, folds=3, **x).select("predicted").collect() for x in ({}, weak))
    assert a != b
    for bad in ({"kernel": "poly"}, {"C": 0}, {"gamma": -1.0}, {"solver": "fast"}):
        with pytest.raises(ValueError):
            Classifier(**bad)


def test_numbers_without_gaps(spark):
    df = spark.createDataFrame([(i * 7, chr(97 + i)) for i in range(20)], "record_index long, x string").repartition(3)
    got = renumbered(df, "record_index", stretch=10).orderBy("record_index").collect()
    assert [(r.record_index, r.x) for r in got] == [(i, chr(97 + i)) for i in range(20)]


def test_medians(spark):
    r = np.random.default_rng(6)
    groups = {"a": r.integers(0, 5, 1001), "b": r.normal(size=400), "c": [3.0], "d": [1.0, 2.0], "e": [7.0] * 50}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "g string, v double").repartition(4)
    got = {x.g: x.median_s for x in metrics.medians(df, "g", "v").collect()}
    assert got == {k: pytest.approx(float(np.median(v))) for k, v in groups.items()}


def test_images_without_a_reader_are_refused(spark, tmp_path, root):
    import shutil

    shutil.copytree(root, tmp_path / "d")
    (tmp_path / "d/B/x.webp").write_bytes(b"RIFF")
    with pytest.raises(images.DatasetError, match=r"x\.webp"):
        images.load_dataset(spark, str(tmp_path / "d"), CLASSES, "t", (".png", ".webp"))


def test_pixels_meet_their_records_either_way(records, monkeypatch):
    few = sorted(map(repr, images.with_pixels(records).collect()))
    monkeypatch.setattr(images, "SENT", 1)
    assert sorted(map(repr, images.with_pixels(records).collect())) == few and len(few) == 30


# --- reading images -----------------------------------------------------------

NAMES = ["plain", "with space", "per%20cent", "hash#1", "br[1]", "q?x", "a+b", "ünï", "star*", "com,ma", "back\\slash", "cu{r}ly"]


@pytest.mark.parametrize("sent", [images.SENT, 5])
def test_every_name_and_folder_gives_its_pixels_in_one_lot_or_many(spark, tmp_path, sent):
    root = tmp_path / "My Data [1]"
    for k, c in enumerate(("A b", "C{d}")):
        (root / c).mkdir(parents=True)
        for i, n in enumerate(NAMES):
            (root / c / f"{n}.png").write_bytes(images.encode_png(np.full((2, 3, 3), 20 * i + k, np.uint8)))
    found = images.load_dataset(spark, str(root), Dataset(("A b", "C{d}")), "x", (".png",))
    plain = [(c, n) for c in ("A b", "C{d}") for n in sorted((f"{n}.png" for n in NAMES), key=lambda n: (n.lower(), n))]
    pixels = images.with_pixels(found, sent)
    rows = pixels.orderBy("record_index").collect()
    assert [(r.class_folder, r.path.rsplit("/", 1)[1]) for r in rows] == plain and [r.record_index for r in rows] == list(range(24))
    assert [r.data[0] for r in rows] == [20 * NAMES.index(n[:-4]) + (c == "C{d}") for c, n in plain]
    # pixels are read, joined with what was sent, and not moved
    text = pixels._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_hidden_and_lost_files_are_named(spark, tmp_path):
    (tmp_path / "A").mkdir()
    for n in ("one", "two"):
        (tmp_path / "A" / f"{n}.png").write_bytes(images.encode_png(np.zeros((2, 2, 3), np.uint8)))
    found = images.load_dataset(spark, str(tmp_path), Dataset(("A",)), "x", (".png",)).cache()
    assert found.count() == 2
    (tmp_path / "A" / "two.png").unlink()
    with pytest.raises(images.DatasetError, match=r"without a file: .*two.png"):
        images.with_pixels(found)
    (tmp_path / "A" / "_DSC01.PNG").write_bytes(images.encode_png(np.zeros((2, 2, 3), np.uint8)))
    (tmp_path / "A" / "_notes.txt").write_text("x")
    with pytest.raises(images.DatasetError, match=r"hidden files; rename them: A/_DSC01.PNG$"):
        images.load_dataset(spark, str(tmp_path), Dataset(("A",)), "x", (".png",))


def test_eight_orientations_give_one_picture(spark, tmp_path):
    (tmp_path / "A").mkdir()
    upright = np.zeros((32, 48, 3), np.uint8)
    upright[:16, :16] = (250, 20, 20)
    upright[16:, 32:] = (20, 20, 250)
    jvm = spark._jvm
    for how in range(1, 9):
        stored = next(x for x in ((upright.swapaxes(0, 1) if how >= 5 else upright)[::a, ::b] for a in (1, -1) for b in (1, -1)) if np.array_equal(images.turned(x, how), upright))
        png = tmp_path / "one.png"
        png.write_bytes(images.encode_png(np.ascontiguousarray(stored)))
        target = tmp_path / "A" / f"{how}.{'JPG' if how % 2 else 'jpeg'}"
        jvm.javax.imageio.ImageIO.write(jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(png))), "jpg", jvm.java.io.File(str(target)))
        order, mark = ("little", b"II") if how % 3 else ("big", b"MM")
        n = lambda v, size: v.to_bytes(size, order)  # noqa: B023, E731
        entries = n(0x010F, 2) + n(2, 2) + n(4, 4) + b"abc\0" + n(0x0112, 2) + n(3, 2) + n(1, 4) + n(how, 2) + n(0, 2)
        body = b"Exif\0\0" + mark + n(42, 2) + n(8, 4) + n(2, 2) + entries + n(0, 4)
        raw = target.read_bytes()
        target.write_bytes(raw[:2] + b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + raw[2:])
    (tmp_path / "A" / "plain.png").write_bytes(images.encode_png(upright))
    found = images.load_dataset(spark, str(tmp_path), Dataset(("A",)), "x", (".jpg", ".jpeg", ".png"))
    for r in images.with_pixels(found).collect():
        got = images.as_array(r.height, r.width, r.channels, r.data, r.orientation).astype(int)
        assert got.shape == upright.shape and np.abs(got - upright)[4:-4, 4:-4].mean() < 12, r.path


@pytest.mark.parametrize("head", [b"", b"\xff\xd8", b"\xff\xd8\xff\xe1", b"\xff\xd8\xff\xe1\0\x10Exif\0\0XX", b"\xff\xd8\xff\xe1\0\x14Exif\0\0II*\0\x08\0\0\0\x09\0", b"\x89PNG", b"\xff\xd8\xff\xe0\0\0", b"\xff\xd8\xff\xda\0\x02"])
def test_orientation_of_broken_heads_is_upright(head):
    assert images.orientation(head) == 1


def test_global_rank_is_a_plain_sort_whatever_the_ranges(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("k"), F.md5(F.col("id").cast("string")).alias("name"), "id").repartition(7)
    plain = {r.id: i for i, r in enumerate(sorted(rows.collect(), key=lambda r: (r.k, r.name)))}
    for stretch in (1 << 16, 40):
        got = global_rank(rows, [F.col("k"), F.col("name")], "at", stretch=stretch)
        assert {r.id: r.at for r in got.collect()} == plain
    widest = global_rank(rows, [F.col("k"), F.col("name")], "at", stretch=40).selectExpr("at div 40 AS b").groupBy("b").count().agg(F.max("count")).first()[0]
    assert widest <= 40
    assert global_rank(rows.limit(0), [F.col("name")], "at").count() == 0


# --- one pass for all techniques ----------------------------------------------


def test_three_extractors_summary_and_failures_prepare_each_image_once(spark, records, settings, tmp_path):
    counted = spark.sparkContext.accumulator(0)
    extractors = [e() for e in REGISTRY.values()]
    samples = durable(prepare.described(images.with_pixels(records), extractors, settings, augment=True, prepared=counted))
    matrix = prepare.matrix_of(samples)
    summary = {r.technique: r for r in prepare.matrix_summary(matrix, samples).collect()}
    assert prepare.failures(samples).count() == 0 and {t: (r["rows"], r.originals, r.dim) for t, r in summary.items()} == {"T1": (90, 30, 105), "T2": (90, 30, 40), "T3": (90, 30, 34)}
    assert counted.value == 90
    two_steps = prepare.prepare(images.with_pixels(records), settings, augment=True)
    for e in extractors:
        own = {(r.group, r.variant): r.features for r in prepare.feature_matrix(two_steps, e, settings).collect()}
        assert own == {(r.group, r.variant): r.features for r in matrix.where(F.col("technique") == e.short_name).collect()}
