"""The registered queries of the library's own operators, each on the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import encode_label, feedback_probability
from ..operators import edges, features, matching, metrics, painting, pairing, predict, prepare, train
from ..operators.model import CLAUSES, Meta, included, load_model, model_footprint, save_model, training_footprint
from ..sources.readings import melt, read_labelled_csv, read_readings, read_stage, read_submission, widen, with_sample_number, write_parts, write_table
from ..sources.shared import Scratch
from ..streaming.edges import stream_resampled, stream_transitions
from ..streaming.late import edges_with_late, late_counts, resampled_with_late, state_store
from ..streaming.run import drain, drain_in_turns
from .disaggregate import appliance_report, labelled_pairs, on_intervals, painted_scores, train_and_evaluate, train_save_evaluate

CHANNELS = {"click": "main", "view": "fridge", "error": "microwave", "purchase": "dish washer", "signup": "electric furnace"}
APPLIANCES = ["fridge", "microwave", "dish washer", "electric furnace"]
STATE_THRESHOLD, NOISE_LEVEL, TOLERANCE = 40.0, 20.0, 3600
ORDER = ("t", "seq")
#: Stretches of time (seconds) and of edges that long series are cut into.
CHUNK_SECONDS, CHUNK_EDGES = 21_600, 50
#: Of clusters of pair heights.
BANDWIDTH, BIN_WIDTH = 15.0, 2.0
FLAGS = {"A": 0, "N": 1, "R": 2}
N_BITS, N_FEATURE = 4, 16
#: class, clause, literals that must be 1, literals that must be 0; one clause is empty and so always holds.
SMALL_MODEL = [
    (0, 0, [0], [4]), (0, 1, [4], []), (0, 2, [8, 9], [1]), (0, 3, [12], [0]),
    (1, 0, [4], [8]), (1, 1, [0, 8], []), (1, 2, [], []), (1, 3, [1], [12]),
    (2, 0, [12], [4]), (2, 1, [8], [0]), (2, 2, [5], [9]), (2, 3, [13], [4, 8]),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as readings: building, channel, t (seconds), seq (order within a second), watts."""
    return as_readings(_table(spark, sf_dir, "events"))


def as_readings(events: DataFrame) -> DataFrame:
    channel = F.create_map(*(F.lit(x) for pair in CHANNELS.items() for x in pair))[F.col("event_type")]
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return events.select((F.col("user_id") % 6 + 1).cast("int").alias("building"), channel.alias("channel"), seconds.cast("long").alias("t"), F.col("event_id").alias("seq"), F.col("value").alias("watts"))


def _edges(spark, sf_dir, **how) -> DataFrame:
    return edges.detect(readings(spark, sf_dir), NOISE_LEVEL, STATE_THRESHOLD, order=ORDER, **how)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _matches(found: DataFrame) -> DataFrame:
    """Edges of the detector are ordered, so that a sweep finds their matches."""
    return matching.match_edges(found.where("channel = 'main'"), found.where("channel != 'main'"), TOLERANCE, ordered=True)


def _labelled(spark, sf_dir) -> DataFrame:
    found = _edges(spark, sf_dir)
    return matching.label_main_edges(found.where("channel = 'main'"), _matches(found), APPLIANCES)


def _features(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    array = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", array.alias("features"), encode_label(F.col("l_returnflag"), FLAGS).alias("label"))


def _bits(spark, sf_dir) -> DataFrame:
    rows = _features(spark, sf_dir)
    stats = features.feature_stats(rows, per_feature=True).orderBy("pos").collect()  # a row for each feature
    return features.booleanize_features(rows, N_BITS, [r["mean"] for r in stats], [r["std"] for r in stats])


def small_model(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, j, 1 - 2 * (j % 2), len(p), len(n), p + n) for c, j, p, n in SMALL_MODEL], CLAUSES)


def _predicted(spark, sf_dir) -> DataFrame:
    return predict.predict(_bits(spark, sf_dir), small_model(spark), 3, N_FEATURE, return_votes=True)


def _vectors(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label"))


def q_melt(spark, sf_dir):
    rows = readings(spark, sf_dir).withColumn("t", F.floor(F.col("t") / 3600).cast("long"))
    wide = rows.groupBy("building", "t").pivot("channel", list(CHANNELS.values())).agg(F.max("watts"))
    return melt(wide)


def q_parts_round_trip(spark, sf_dir):
    """Hourly readings, written as part files and read again: a building's parts one after the other, in rows numbered through."""
    rows = readings(spark, sf_dir).withColumn("hour", F.floor(F.col("t") / 3600).cast("long"))
    wide = rows.groupBy("building", "hour").pivot("channel", list(CHANNELS.values())).agg(F.round(F.max("watts"), 6))
    path = Scratch(spark, "parts").path
    write_parts(wide.withColumn("part", F.pmod(F.floor(F.col("hour") / 100), F.lit(3)).cast("int")), path, index_col="hour")
    back = with_sample_number(read_readings(spark, f"{path}/house*.csv"), to="n")
    return melt(back.drop("part").withColumnRenamed("idx", "hour"), ("building", "hour", "n"))


def q_csv_round_trip(spark, sf_dir):
    """Edges with their samples through CSV, where the samples are JSON."""
    found = edges.transitions(readings(spark, sf_dir), NOISE_LEVEL, STATE_THRESHOLD, order=ORDER, with_sequence=True)
    path = Scratch(spark, "csv").path
    write_table(found.select("building", "channel", "edge_no", "sequence"), path, "csv")
    back = spark.read.option("header", True).schema("channel string, edge_no long, sequence string, building int").csv(path).withColumn("sequence", F.from_json("sequence", "array<double>"))
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x)
    return back.select("building", "channel", "edge_no", F.size("sequence").alias("n_samples"), F.round(total, 4).alias("total_watts"))


def q_stage_round_trip(spark, sf_dir):
    """Of a stage's saved edges those of some buildings and channels, one of which does not exist."""
    path = Scratch(spark, "stage").path
    write_table(_edges(spark, sf_dir).select("building", "channel", "edge_no", "transition", "end"), path)
    return _rounded(read_stage(spark, path, [1, 3, 99], ["main", "fridge", "washer dryer"]), "transition")


def q_submission_round_trip(spark, sf_dir):
    """A building's on/off table, written as a submission and read again; blanks are 0."""
    on = prepare.binarize(readings(spark, sf_dir)).where("building = 2 and on = 1").groupBy("building", "channel", "t").agg(F.max("on").alias("on"))
    path = Scratch(spark, "submission").path
    wide = on.groupBy("t").pivot("channel", APPLIANCES).agg(F.max("on"))
    wide.write.option("header", True).csv(path)
    return read_submission(spark, path, 2, index="t")


def q_labelled_csv(spark, sf_dir):
    """Features and labels through a CSV whose last column is the label."""
    rows = _features(spark, sf_dir)
    path = Scratch(spark, "labelled").path
    rows.select(*(F.col("features")[i].alias(f"f{i}") for i in range(4)), F.concat(F.lit("class "), "label").alias("kind")).write.option("header", True).csv(path)
    back = read_labelled_csv(spark, path)
    cells = back.select("label", F.posexplode("features").alias("pos", "x"))
    return _rounded(cells.groupBy("label", "pos").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")), "mean", "std")


def q_unknown_edges(spark, sf_dir):
    """Main edges without an appliance."""
    return _rounded(_labelled(spark, sf_dir).where("label = 'unknown'").select("building", "edge_no", "transition"), "transition")


def q_feedback_probability(spark, sf_dir):
    rows = _predicted(spark, sf_dir).where("label is not null")
    own = F.col("votes")[F.col("label")]
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", feedback_probability(own, 1).alias("as_target"), feedback_probability(own, 1, -1).alias("as_other"))


def q_wide(spark, sf_dir):
    on = prepare.binarize(readings(spark, sf_dir)).groupBy("building", "channel", "t").agg(F.max("on").alias("on"))
    wide = widen(on, APPLIANCES)
    return wide.select("building", "t", *(F.col(f"`{a}`").alias(a.replace(" ", "_")) for a in APPLIANCES))


def q_sample_number(spark, sf_dir):
    return with_sample_number(readings(spark, sf_dir).select("building", "t", "seq"), order=("t", "seq"), to="n")


def q_binarize(spark, sf_dir):
    return prepare.binarize(readings(spark, sf_dir)).select("building", "channel", "t", "seq", "on")


def q_missing_channels(spark, sf_dir):
    rows = readings(spark, sf_dir).where("not (building % 2 = 0 and channel = 'fridge')")
    return prepare.missing_channels(rows, [*APPLIANCES, "washer dryer"])


def q_slice_time(spark, sf_dir):
    return prepare.slice_time(readings(spark, sf_dir), 1_704_067_200, 43_200)


def q_head_per_building(spark, sf_dir):
    return prepare.head_per_building(readings(spark, sf_dir), 100, order=ORDER)


def q_channel_stats(spark, sf_dir):
    return prepare.channel_stats(readings(spark, sf_dir), digits=6)


def _gappy(spark, sf_dir):
    return readings(spark, sf_dir).withColumn("watts", F.when(F.col("seq") % 7 != 0, F.col("watts")))


def q_backfill(spark, sf_dir):
    return prepare.backfill(_gappy(spark, sf_dir), order=ORDER)


def q_fill_zero(spark, sf_dir):
    return _gappy(spark, sf_dir).na.fill(0.0, ["watts"])


def q_transitions(spark, sf_dir):
    return _rounded(_edges(spark, sf_dir).drop("active_average", "at"), "transition")


def q_transition_samples(spark, sf_dir):
    found = edges.transitions(readings(spark, sf_dir), NOISE_LEVEL, STATE_THRESHOLD, order=ORDER, with_sequence=True)
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x)
    return found.select("building", "channel", "edge_no", F.size("sequence").alias("n_samples"), F.round(total, 4).alias("total_watts"))


def q_transition_sequence(spark, sf_dir):
    """The samples of each edge in their order, in millionths."""
    found = edges.transitions(readings(spark, sf_dir), NOISE_LEVEL, STATE_THRESHOLD, order=ORDER, with_sequence=True)
    items = F.transform("sequence", lambda x: F.round(x * 1_000_000).cast("long").cast("string"))
    return found.select("building", "channel", "edge_no", F.md5(F.array_join(items, ",")).alias("sequence_md5"))


def q_steady_states(spark, sf_dir):
    return _rounded(edges.steady_states(readings(spark, sf_dir), NOISE_LEVEL, STATE_THRESHOLD, order=ORDER), "active_average")


def q_pair_edges(spark, sf_dir):
    return _rounded(pairing.pair_edges(_edges(spark, sf_dir)), "transition")


def q_transitions_by_chunks(spark, sf_dir):
    return _rounded(_edges(spark, sf_dir, chunk=CHUNK_SECONDS).drop("active_average", "at"), "transition")


def q_steady_states_by_chunks(spark, sf_dir):
    return _rounded(edges.steady_states(readings(spark, sf_dir), NOISE_LEVEL, STATE_THRESHOLD, order=ORDER, chunk=CHUNK_SECONDS), "active_average")


def q_pair_edges_by_chunks(spark, sf_dir):
    return _rounded(pairing.pair_edges(_edges(spark, sf_dir), chunk=CHUNK_EDGES), "transition")


def q_pair_outermost_by_chunks(spark, sf_dir):
    return _rounded(pairing.pair_outermost(_labelled(spark, sf_dir), chunk=CHUNK_EDGES), "transition")


def q_match_edges_by_chunks(spark, sf_dir):
    found = _edges(spark, sf_dir)
    return matching.match_edges(found.where("channel = 'main'"), found.where("channel != 'main'"), TOLERANCE, ordered=True, chunk=CHUNK_SECONDS)


def q_match_edges_by_buckets(spark, sf_dir):
    found = _edges(spark, sf_dir)
    return matching.match_edges(found.where("channel = 'main'"), found.where("channel != 'main'"), TOLERANCE, ordered=False)


def q_backfill_by_chunks(spark, sf_dir):
    return prepare.backfill(_gappy(spark, sf_dir), order=ORDER, chunk=CHUNK_SECONDS)


def q_paint_intervals_by_chunks(spark, sf_dir):
    pairs = pairing.pair_edges(_edges(spark, sf_dir))
    return painting.paint_intervals(readings(spark, sf_dir), pairs, chunk=CHUNK_SECONDS).select("building", "channel", "t", "seq", "on")


def q_edge_counts(spark, sf_dir):
    found = _edges(spark, sf_dir)
    return pairing.edge_counts(found, pairing.pair_edges(found))


def on_time(spark, sf_dir):
    return pairing.on_time(pairing.pair_edges(_edges(spark, sf_dir)))


def q_match_edges(spark, sf_dir):
    return _matches(_edges(spark, sf_dir))


def q_unmatched_edges(spark, sf_dir):
    found = _edges(spark, sf_dir)
    return matching.unmatched_edges(found.where("channel != 'main'"), _matches(found)).select("building", "channel", "edge_no")


def q_match_counts(spark, sf_dir):
    found = _edges(spark, sf_dir)
    return matching.match_counts(found.where("channel != 'main'"), _matches(found))


def q_label_main_edges(spark, sf_dir):
    return _labelled(spark, sf_dir).select("building", "edge_no", *(F.col(f"`{a}_label`").alias(f"{a.replace(' ', '_')}_label") for a in APPLIANCES), "label")


def q_pair_outermost(spark, sf_dir):
    return _rounded(pairing.pair_outermost(_labelled(spark, sf_dir)), "transition")


def _painted(spark, sf_dir):
    return painting.paint_intervals(readings(spark, sf_dir), pairing.pair_edges(_edges(spark, sf_dir)))


def q_paint_intervals(spark, sf_dir):
    return _painted(spark, sf_dir).select("building", "channel", "t", "seq", "on")


def _submission(spark, sf_dir):
    return _painted(spark, sf_dir).select("building", "channel", F.col("seq").alias("t"), F.col("on").cast("double").alias("value"))


def q_score_on_off(spark, sf_dir):
    truth = readings(spark, sf_dir).select("building", "channel", F.col("seq").alias("t"), "watts")
    limits = truth.groupBy("building").agg(F.when(F.col("building") == 2, 60.0).otherwise(80.0).alias("threshold"))
    return _rounded(painting.score_on_off(_submission(spark, sf_dir), truth, limits), "precision", "recall")


def q_check_submission(spark, sf_dir):
    truth = readings(spark, sf_dir).select("building", "channel", F.col("seq").alias("t"), "watts")
    return painting.check_submission(_submission(spark, sf_dir).where("not (building = 3 and t % 11 = 0)"), truth.where("not (building = 4 and t % 13 = 0)"))


def q_feature_stats(spark, sf_dir):
    return _rounded(features.feature_stats(_features(spark, sf_dir)), "mean", "std", digits=8)


def q_feature_stats_each(spark, sf_dir):
    return _rounded(features.feature_stats(_features(spark, sf_dir), per_feature=True), "mean", "std", digits=8)


def q_booleanize(spark, sf_dir):
    return _bits(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.concat_ws("", F.transform("bits", lambda b: b.cast("string"))).alias("bits"))


def q_encode_labels(spark, sf_dir):
    return _features(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


def q_n_classes(spark, sf_dir):
    return features.n_classes(_features(spark, sf_dir))


def q_train_test_split(spark, sf_dir):
    return features.train_test_split(_vectors(spark, sf_dir).select("vec_id", "label"), "vec_id", 0.2, seed=7)


def q_hash_split(spark, sf_dir):
    return features.train_test_split(readings(spark, sf_dir).select("seq"), "seq", 0.2, seed=7, exact=False)


def q_balance(spark, sf_dir):
    return features.balance(_vectors(spark, sf_dir).select("vec_id", "label"), "vec_id", num_per_class=20, seed=7)


def q_seeded_shuffle(spark, sf_dir):
    return features.seeded_shuffle(readings(spark, sf_dir).select("seq"), "seq", seed=7)


def q_predict(spark, sf_dir):
    return _predicted(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "pred", *(F.col("votes")[c].alias(f"votes_{c}") for c in range(3)))


def q_votes_by_join(spark, sf_dir):
    rows = _bits(spark, sf_dir).withColumn("id", F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    found = predict.votes_by_join(rows, small_model(spark), "id", 3, N_FEATURE)
    return found.select("id.*", "pred", *(F.col("votes")[c].alias(f"votes_{c}") for c in range(3)))


def q_accuracy(spark, sf_dir):
    return _rounded(metrics.accuracy(_predicted(spark, sf_dir)), "accuracy")


def q_confusion(spark, sf_dir):
    return metrics.confusion(_predicted(spark, sf_dir), [0, 1, 2])


def q_report(spark, sf_dir):
    return _rounded(metrics.report(_predicted(spark, sf_dir)), "precision", "recall", "f1")


PARAMS = train.Params(n_clause=20, n_state=20, target=15, specificity=6.0, epochs=5)


def q_train_grouped(spark, sf_dir):
    rows = features.booleanize_features(_vectors(spark, sf_dir), 1, 0.0, 1.0).withColumn("fold", F.pmod("vec_id", F.lit(4)))
    return train.train_grouped(rows, ["fold"], 10, PARAMS)


def q_train_batched(spark, sf_dir):
    rows = features.booleanize_features(_vectors(spark, sf_dir), 1, 0.0, 1.0)
    return train.train_batched(rows, "vec_id", Meta(10, 64, PARAMS.n_clause, PARAMS.n_state), PARAMS)


def q_train_and_evaluate(spark, sf_dir):
    return train_and_evaluate(_vectors(spark, sf_dir), "vec_id", 10, PARAMS, n_bits=1, exact=False)


#: Settings among which each fold's model is chosen.
GRID = [train.Params(n_clause=c, n_state=20, target=t, specificity=s, epochs=3) for c in (10, 20) for t, s in ((8, 3.0), (15, 6.0))]


def q_train_grid(spark, sf_dir):
    rows = features.booleanize_features(_vectors(spark, sf_dir), 1, 0.0, 1.0).withColumn("fold", F.pmod("vec_id", F.lit(4)))
    found = train.train_grid(rows, ["fold"], "vec_id", 10, GRID)
    return _rounded(found.select("fold", "setting", "n_train", "n_test", "accuracy", "best").distinct(), "accuracy")


def q_train_save_evaluate(spark, sf_dir):
    return train_save_evaluate(_vectors(spark, sf_dir), "vec_id", 10, PARAMS, Scratch(spark, "saved-model").path, n_bits=1)


def q_training_footprint(spark, sf_dir):
    states, _ = _saved(spark, sf_dir, "training")
    return training_footprint(states)


def q_on_intervals(spark, sf_dir):
    return _rounded(on_intervals(_gappy(spark, sf_dir), NOISE_LEVEL, STATE_THRESHOLD, ORDER), "transition")


def q_on_intervals_by_chunks(spark, sf_dir):
    return _rounded(on_intervals(_gappy(spark, sf_dir), NOISE_LEVEL, STATE_THRESHOLD, ORDER, CHUNK_SECONDS, CHUNK_EDGES), "transition")


def q_painted_scores_by_chunks(spark, sf_dir):
    scores = painted_scores(_gappy(spark, sf_dir), chunk=CHUNK_SECONDS, chunk_edges=CHUNK_EDGES, noise_level=NOISE_LEVEL, state_threshold=STATE_THRESHOLD, order=ORDER)
    return _rounded(scores, "precision", "recall")


def q_labelled_pairs_by_chunks(spark, sf_dir):
    found = labelled_pairs(_gappy(spark, sf_dir), APPLIANCES, TOLERANCE, NOISE_LEVEL, STATE_THRESHOLD, ORDER, chunk=CHUNK_SECONDS, chunk_edges=CHUNK_EDGES)
    return _rounded(found, "transition")


def q_painted_scores(spark, sf_dir):
    scores = painted_scores(_gappy(spark, sf_dir), noise_level=NOISE_LEVEL, state_threshold=STATE_THRESHOLD, order=ORDER)
    return _rounded(scores, "precision", "recall")


def q_labelled_pairs(spark, sf_dir):
    return _rounded(labelled_pairs(_gappy(spark, sf_dir), APPLIANCES, TOLERANCE, NOISE_LEVEL, STATE_THRESHOLD, ORDER), "transition")


def q_appliance_report(spark, sf_dir):
    found = appliance_report(_gappy(spark, sf_dir), APPLIANCES, PARAMS, tolerance=TOLERANCE, noise_level=NOISE_LEVEL, state_threshold=STATE_THRESHOLD, order=ORDER)
    return _rounded(found, "precision", "recall", "f1")


def _saved(spark, sf_dir, form):
    scratch = Scratch(spark, "model")
    states = scratch.save(q_train_batched(spark, sf_dir), "states")
    meta = Meta(10, 64, PARAMS.n_clause, PARAMS.n_state)
    save_model(states, meta, f"{scratch.path}/{form}", form)
    return load_model(spark, f"{scratch.path}/{form}")


def q_save_load_model(spark, sf_dir):
    rows, out = features.booleanize_features(_vectors(spark, sf_dir), 1, 0.0, 1.0), None
    for form in ("training", "inference"):
        states, meta = _saved(spark, sf_dir, form)
        own = predict.predict(rows, included(states, meta), 10, 64).select("vec_id", F.col("pred").alias(f"pred_{form}"))
        out = own if out is None else out.join(own, "vec_id")
    return out


def q_model_footprint(spark, sf_dir):
    states, meta = _saved(spark, sf_dir, "training")
    return model_footprint(included(states, meta))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(_table(spark, sf_dir, name).schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def q_stream_transitions(spark, sf_dir):
    found = drain(spark, stream_transitions(as_readings(_stream(spark, sf_dir, "events")), NOISE_LEVEL, STATE_THRESHOLD), "stream-edges")
    return _rounded(found, "transition")


#: Readings arrive in quarters of their time; some come one quarter late. The watermark is DELAY seconds behind.
TURNS, DELAY, LATE_EVERY, LATE_AT = 4, 3600, 40, 7


def _arriving(spark, sf_dir) -> DataFrame:
    rows = readings(spark, sf_dir).withColumn("ts", F.timestamp_seconds("t"))
    low, high = rows.agg(F.min("t"), F.max("t")).first()
    quarter = F.floor((F.col("t") - low) * TURNS / (high - low + 1))
    held_back = (F.col("seq") % LATE_EVERY == LATE_AT).cast("int")
    return rows.withColumn("turn", F.least(F.lit(TURNS - 1), quarter + held_back).cast("int"))


def _drained(spark, sf_dir, made, label):
    with state_store(spark):
        return drain_in_turns(spark, _arriving(spark, sf_dir), "turn", TURNS, made, label)


def q_stream_late_edges(spark, sf_dir):
    found = _drained(spark, sf_dir, lambda s: edges_with_late(s, NOISE_LEVEL, STATE_THRESHOLD, delay=f"{DELAY} seconds"), "late-edges")
    return _rounded(found.where("kind = 'edge'").select("building", "channel", "edge_no", "transition", "duration", "start", "end"), "transition")


def q_stream_late_counts(spark, sf_dir):
    return late_counts(_drained(spark, sf_dir, lambda s: edges_with_late(s, NOISE_LEVEL, STATE_THRESHOLD, delay=f"{DELAY} seconds"), "late-counts"))


def q_stream_resampled_dense(spark, sf_dir):
    found = _drained(spark, sf_dir, lambda s: resampled_with_late(s, 3600, f"{DELAY} seconds"), "late-cells")
    return _rounded(found.where("kind = 'cell'").select("building", "channel", "t", "watts"), "watts")


def q_stream_predict(spark, sf_dir):
    stats = features.feature_stats(_features(spark, sf_dir), per_feature=True).orderBy("pos").collect()
    rows = _stream(spark, sf_dir, "lineitem").withColumn("features", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    bits = features.booleanize_features(rows, N_BITS, [r["mean"] for r in stats], [r["std"] for r in stats])
    voted = predict.predict(bits, small_model(spark), 3, N_FEATURE)
    return drain(spark, voted.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "pred"), "stream-predict")


def q_resample_6s(spark, sf_dir):
    return _rounded(prepare.resample(readings(spark, sf_dir), 6), "watts")


def q_resample_hourly(spark, sf_dir):
    return _rounded(prepare.resample(readings(spark, sf_dir), 3600), "watts")


def q_stream_resampled(spark, sf_dir):
    rows = as_readings(_stream(spark, sf_dir, "events")).withColumn("ts", F.timestamp_seconds("t"))
    found = drain(spark, stream_resampled(rows, 3600), "stream-resample", "complete")
    return _rounded(found.select("building", "channel", F.unix_seconds("ts").alias("t"), "watts"), "watts")


def _tolerance_pairs(spark, sf_dir):
    return pairing.pair_by_tolerance(_edges(spark, sf_dir), min_tolerance=20.0)


def q_pair_by_tolerance(spark, sf_dir):
    return _rounded(_tolerance_pairs(spark, sf_dir), "t1_w", "t2_w")


def q_pair_shape(spark, sf_dir):
    pairs = pairing.pair_edges(_edges(spark, sf_dir)).select("building", "channel", "rise_no", F.col("transition").alias("t1_w"), (-F.col("transition")).alias("t2_w"), "start", "end")
    return _rounded(pairing.pair_shape(pairs).select("building", "channel", "rise_no", "height_w", "duration_s"), "height_w")


def q_tolerance_shape(spark, sf_dir):
    """Pairs of edges of unlike size."""
    return _rounded(pairing.pair_shape(_tolerance_pairs(spark, sf_dir)).select("building", "channel", "rise_no", "height_w", "duration_s"), "height_w")


def q_cluster_pairs(spark, sf_dir):
    return pairing.cluster_pairs(pairing.pair_shape(_tolerance_pairs(spark, sf_dir)), bandwidth=BANDWIDTH, bin_width=BIN_WIDTH)


QUERIES = {name.removeprefix("q_"): f for name, f in list(globals().items()) if name.startswith("q_")} | {"on_time": on_time}
