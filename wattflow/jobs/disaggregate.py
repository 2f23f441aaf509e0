"""The library's three jobs, from readings to scores, labels and classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import encode_label
from ..operators import edges, features, matching, metrics, painting, pairing, predict, prepare, train
from ..operators.model import FORMS, Meta, included, load_model, save_model
from ..sources.shared import Scratch


#: Edges of a chunk when series are cut into chunks.
CHUNK_EDGES = 10_000


def _edges_of(filled: DataFrame, noise_level: float, state_threshold: float, order: Sequence[str], chunk: float | None) -> DataFrame:
    """The edges; those of chunks, whose plan is long and which are few beside their readings, are saved once in the shared folder."""
    found = edges.transitions(filled, noise_level, state_threshold, order=order, chunk=chunk)
    return found if chunk is None else Scratch(filled.sparkSession, "edges").save(found, "edges")


def on_intervals(readings: DataFrame, noise_level: float = 80.0, state_threshold: float = 15.0, order: Sequence[str] = ("t",), chunk: float | None = None, chunk_edges: int = CHUNK_EDGES) -> DataFrame:
    """Readings through back-fill, edges and pairing: one shuffle of readings on (building, channel).

    With chunk, in units of order's first column, each series is as many tasks as it has stretches of that length, and
    its edges are paired in chunks of chunk_edges.
    """
    filled = prepare.backfill(readings, order=order, chunk=chunk)
    found = _edges_of(filled, noise_level, state_threshold, order, chunk)
    return pairing.pair_edges(found, chunk=None if chunk is None else chunk_edges)


def painted_scores(readings: DataFrame, threshold: float = 80.0, chunk: float | None = None, **how) -> DataFrame:
    """How well the painted on-intervals agree with the readings' own on/off state (chunk: see on_intervals; in t)."""
    painted = painting.paint_intervals(readings.select("building", "channel", "t", "watts"), on_intervals(readings, chunk=chunk, **how), chunk=chunk)
    return painting.score_on_off(painted.select("building", "channel", "t", F.col("on").alias("value")).distinct(), readings.groupBy("building", "channel", "t").agg(F.max("watts").alias("watts")), threshold=threshold)


def labelled_pairs(readings: DataFrame, appliances: Sequence[str], tolerance: int = matching.TOLERANCE, noise_level: float = 80.0, state_threshold: float = 15.0, order: Sequence[str] = ("t",), main: str = "main", chunk: float | None = None, chunk_edges: int = CHUNK_EDGES) -> DataFrame:
    """Main-meter edges labelled by the appliance edges they overlap, paired by label (chunk: see on_intervals)."""
    found = _edges_of(prepare.backfill(readings, order=order, chunk=chunk), noise_level, state_threshold, order, chunk)
    of_main, of_app = found.where(F.col("channel") == main), found.where(F.col("channel").isin(list(appliances)))
    labelled = matching.label_main_edges(of_main, matching.match_edges(of_main, of_app, tolerance, ordered=True, chunk=chunk), appliances)
    return pairing.pair_outermost(labelled, chunk=None if chunk is None else chunk_edges)


def train_and_evaluate(df: DataFrame, id_col: str, n_class: int, params: train.Params, n_bits: int = 4, test_size: float = 0.2, exact: bool = True) -> DataFrame:
    """pred and label of the test rows of df (id, features, label) by a model learned from the training rows.

    Mean and deviation are those of all rows. exact learns sample by sample in one task, else in batches on all tasks.
    """
    mean, std = features.feature_stats(df).first()
    n_feature = n_bits * df.select(F.max(F.size("features"))).first()[0]
    bits = features.booleanize_features(df, n_bits, float(mean), float(std) or 1.0)
    split = features.train_test_split(bits.select(id_col, "bits", "label"), id_col, test_size, params.seed)
    meta = Meta(n_class, n_feature, params.n_clause, params.n_state)
    learned = split.where("is_train")
    if exact:
        states = train.train_grouped(learned.withColumn("model", F.lit(0)), ["model"], n_class, params)
    else:
        states = train.train_batched(learned, id_col, meta, params)
    return predict.predict(split.where("not is_train"), included(states, meta), n_class, n_feature).select(id_col, "label", "pred")


def train_save_evaluate(df: DataFrame, id_col: str, n_class: int, params: train.Params, path: str, n_bits: int = 4, test_size: float = 0.2) -> DataFrame:
    """form, n_test and accuracy on the test rows: of the model as learned, and as saved below path and loaded again in each form.

    One model of all training rows, in batches on all tasks. Mean and deviation are those of all rows.
    """
    mean, std = features.feature_stats(df).first()
    n_feature = n_bits * df.select(F.max(F.size("features"))).first()[0]
    split = features.train_test_split(features.booleanize_features(df, n_bits, float(mean), float(std) or 1.0).select(id_col, "bits", "label"), id_col, test_size, params.seed, exact=False)
    meta = Meta(n_class, n_feature, params.n_clause, params.n_state)
    states = train.train_batched(split.where("is_train"), id_col, meta, params)
    models = {"learned": (states, meta)}
    for form in FORMS:
        save_model(states, meta, f"{path}/{form}", form)
        models[form] = load_model(df.sparkSession, f"{path}/{form}")
    found = [predict.predict(split.where("not is_train"), included(*model), n_class, n_feature).select(F.lit(form).alias("form"), "label", "pred") for form, model in models.items()]
    rows = found[0].unionByName(found[1]).unionByName(found[2])
    return rows.groupBy("form").agg(F.count("*").alias("n_test"), F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))


def training_set(pairs: DataFrame, labels: Sequence[str], label_col: str = "label") -> DataFrame:
    """Pairs of all buildings and labels (unknown may be one of them) as rows to learn from: building, rise_no, features (step and duration), label (the place in labels)."""
    number = encode_label(F.col(label_col), {name: i for i, name in enumerate(labels)}, strict=False)
    rows = pairs.where(F.col(label_col).isin(list(labels)))
    return rows.select("building", "rise_no", F.array(F.col("transition").cast("double"), F.col("duration").cast("double")).alias("features"), number.alias("label"))


def appliance_report(readings: DataFrame, appliances: Sequence[str], params: train.Params, unknown: str = "unknown", n_bits: int = 8, test_size: float = 0.2, **how) -> DataFrame:
    """Readings to a report: main-meter edges are labelled and paired, a model learns appliances (and unknown) from step and duration, and its classes of the test rows are reported."""
    labels = [*appliances, unknown]
    rows = training_set(labelled_pairs(readings, appliances, **how), labels)
    rows = rows.withColumn("id", F.xxhash64("building", "label", "rise_no"))
    return metrics.report(train_and_evaluate(rows, "id", len(labels), params, n_bits, test_size, exact=False))


def accuracy_of(predictions: DataFrame) -> DataFrame:
    """Accuracy of a job's predictions."""
    return metrics.accuracy(predictions)
