"""A whole experiment: split, folds on the training side, and one model of each technique for the sets held out.

The settings decide everything: shares and folds, augmentation, preparation, and
the classifier. A model is trained once and judges the test side and the other
sets together, whose classes are matched with its own by a documented map.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extractors import Extractor
from ..settings import Settings
from ..sources import images
from . import metrics, partition, prepare, svm, timing
from .cuts import discard, durable
from .ranking import renumbered

#: Which class of the first set a class of another one is, by folder. Others are counted in the confusion alone.
SAME = {"FreshApple": "RipeApple", "RottenApple": "RottenApple", "Good": "RipeApple", "Bad": "RottenApple"}
_APART = 1 << 40  # between the groups of two sets


@dataclass(frozen=True)
class Outcome:
    """Frames of an experiment. predictions: source, technique, group, label, predicted, fit_seconds, solver, converged.

    comparisons and ranks are of the techniques over the folds; times has, by technique, the
    extraction (n, mean_s, median_s, std_s) and the inference (trained, judged, support, inference_s).
    """

    split: DataFrame
    summary: DataFrame
    failures: DataFrame
    folds: DataFrame
    cv_summary: DataFrame
    predictions: DataFrame
    comparisons: DataFrame
    ranks: DataFrame
    times: DataFrame
    cuts: tuple[DataFrame, ...] = ()

    def close(self) -> None:
        """Gives the tables in the shared folder back; the frames cannot be read after it."""
        for c in self.cuts:
            discard(c)

    def scores(self, matched: dict[str, dict[int, int]]) -> DataFrame:
        """source, technique, n, accuracy, macro_f1, weighted_f1; matched: label of the model's set for each label of another."""
        rows = [(source, a, b) for source, labels in matched.items() for a, b in labels.items()]
        known = self.predictions.sparkSession.createDataFrame(rows, "source string, label long, _own long")  # a row per class
        pairs = self.predictions.join(F.broadcast(known), ["source", "label"]).select("source", "technique", F.col("_own").alias("label"), "predicted")
        by = ["source", "technique"]
        return pairs.groupBy(*by).agg(F.count("*").alias("n")).join(metrics.headline(pairs, by), by)


def samples_of(records: DataFrame, extractors: Sequence[Extractor], settings: Settings, augment: bool, prepared=None) -> DataFrame:
    """Described samples, cut: each image is read and prepared once, whatever is asked of it later."""
    # the plan of variants counts the images that are prepared
    numbered = renumbered(records, "record_index")
    return durable(prepare.described(images.with_pixels(numbered), extractors, settings, augment=augment, prepared=prepared))


def matched_labels(settings: Settings, source: str, first: str = "primary") -> dict[int, int]:
    """For each label of a set, the label of the first set that it is."""
    own, other = settings.datasets[first].classes, settings.datasets[source].classes
    same = {c: c for c in own} | ({} if source == first else SAME)
    return {n: own.index(same[c]) for n, c in enumerate(other) if same.get(c) in own}


def run(spark: SparkSession, settings: Settings, extractors: Sequence[Extractor], sources: Sequence[str] = (), first: str = "primary", prepared=None) -> Outcome:
    """Split the first set, cross-validate on its training side, and judge its test side and the other sets by models of that side.

    prepared: an accumulator of the samples prepared.
    """
    s, chosen = settings, svm.chosen(settings)
    split = partition.stratified_split(images.load_named(spark, first, s), "record_index", s.partition.test_size, s.seed)
    samples = samples_of(split.where("split = 'train'").drop("split"), extractors, s, True, prepared)
    train = prepare.matrix_of(samples)
    folds = durable(svm.cross_validate(train, folds=s.partition.cv_folds, **chosen))
    judged, cuts = None, [samples, folds]
    names = [first, *sources]
    for k, name in enumerate(names):
        records = split.where("split = 'test'").drop("split") if not k else images.load_named(spark, name, s)
        cuts.append(samples_of(records, extractors, s, False, prepared))
        rows = prepare.matrix_of(cuts[-1]).withColumn("group", F.col("group") + k * _APART)
        judged = rows if judged is None else judged.unionByName(rows)
    cuts.append(durable(svm.held_out_predictions(train, judged, **chosen)))
    source = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("group") / _APART).cast("int") + 1)
    predictions = cuts[-1].select(source.alias("source"), "technique", (F.col("group") % _APART).alias("group"), "label", "predicted", "fit_seconds", "solver", "converged")
    inference = timing.inference_times(train, prepare.matrix_of(cuts[2]), [e.short_name for e in extractors], **chosen)
    times = metrics.timing_summary(train, "technique", "extraction_s").join(inference, "technique", "outer")
    return Outcome(split, prepare.matrix_summary(train, samples), prepare.failures(samples), folds, metrics.cv_summary(folds), predictions, metrics.comparisons(folds), metrics.ranks(folds), times, tuple(cuts))
