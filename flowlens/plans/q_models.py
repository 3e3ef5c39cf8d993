"""Registered queries: models, detectors, elimination, components, attribution. Most have no SQL form."""

from __future__ import annotations

import hashlib

import flowlens.plans.q_ingest  # noqa: F401  its SQL texts are used below
from pyspark.sql import functions as F

from flowlens.functions import vocab
from flowlens.functions.columns import quantized
from flowlens.operators import alerts, anomaly, ensemble, explain, features, models, scorer, selection, splits, views
from flowlens.operators.registry import Registry, exists
from flowlens.operators.transform import fit_scaler, scale
from flowlens.plans.q_resample import DISTANCE
from flowlens.plans.registry import define, oracle, query
from flowlens.plans.q_views import requests
from flowlens.session import shared_dir, staging_path
from flowlens.sources.bindings import CLASSES, components, emb, view

BINARY = (0, 1)
FEATURES = ("destination_port", "flow_duration", "flow_bytes_per_s", "fwd_header_length", "syn_flag_count",
            "rst_flag_count", "ack_flag_count", "psh_flag_count")
DETECTOR_FEATURES = ("flow_duration", "flow_bytes_per_s", "destination_port", "idle_mean", "active_mean", "packet_length_mean")


def marked(spark, sf_dir):
    return splits.train_test_split(view(spark, sf_dir, "flows"), "label_multiclass", "row_id")


def halves(df):
    return df.where(~F.col("is_test")), df.where("is_test")


def fit(kind, spark, sf_dir, target="label_binary", classes=BINARY, **kw):
    train, test = halves(marked(spark, sf_dir))
    return getattr(models, kind)(train, FEATURES, target, classes, **kw), test


def shown(model, test, target):
    out = model.predict(test)
    p = F.col(f"p_{model.name}")
    return out.select("row_id", F.col(target).alias("actual"), "predicted", quantized(F.array_max(p)).alias("confidence"),
                      quantized(F.aggregate(p, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("K1_logistic_binary")
def k1(spark, sf_dir):
    return shown(*fit("logistic", spark, sf_dir, max_iter=100), "label_binary")


@query("K1_logistic_multiclass")
def k1_multi(spark, sf_dir):
    return shown(*fit("logistic", spark, sf_dir, "label_multiclass", CLASSES, max_iter=100), "label_multiclass")


@query("K2_random_forest")
def k2(spark, sf_dir):
    return shown(*fit("forest", spark, sf_dir, "label_multiclass", CLASSES, trees=20, depth=8), "label_multiclass")


@query("K3_boosted_binary")
def k3(spark, sf_dir):
    return shown(*fit("boosted", spark, sf_dir, rounds=10, depth=4, rate=0.3), "label_binary")


@query("K3_boosted_multiclass")
def k3_multi(spark, sf_dir):
    return shown(*fit("boosted", spark, sf_dir, "label_multiclass", CLASSES, rounds=3, depth=4, rate=0.3), "label_multiclass")


@query("K4_dense_network")
def k4(spark, sf_dir):
    return shown(*fit("dense", spark, sf_dir, hidden=(32, 16), max_iter=40), "label_binary")


SEQ = ("flow_bytes_per_s", "destination_port", "syn_flag_count", "rst_flag_count")


@query("K5_sequence_classifier")
def k5(spark, sf_dir):
    """Trained on every third window of training rows; test rows without a full window get the priors."""
    df = marked(spark, sf_dir)
    train, test = halves(df)
    priors = {r["class_id"]: r["prior"] for r in ensemble.class_priors(train, "label_binary", BINARY).collect()}
    scaled = scale(df, fit_scaler(train, SEQ)).select("row_id", "source_file", "label_binary", "is_test", *SEQ)
    windows = features.sequences(scaled.where(~F.col("is_test")), SEQ, stride=features.SEQUENCE_STRIDE)
    model = models.sequence_model(windows, "label_binary", BINARY, [priors[c] for c in BINARY],
                                  features.SEQUENCE_LENGTH, len(SEQ), hidden=(16,), max_iter=30)
    ready = features.sequences(scaled, SEQ).select("row_id", "sequence")
    scored = model.score(test.select("row_id", "label_binary").join(ready, "row_id", "left"))
    return scored.select("row_id", F.col("label_binary").alias("actual"), ensemble.argmax_label("p_sequence", BINARY).alias("predicted"),
                         quantized(F.col("p_sequence")[1]).alias("attack_probability"))


# The scorer that the queries share: the published iterations, rounds, trees and layers, which are the defaults, and every benign row.
SCORER_FEATURES = ("destination_port", "flow_duration", "flow_bytes_per_s", "syn_flag_count", "psh_flag_count")
SCORER_SETTINGS = scorer.Settings(one_class_rows=None, neighbor_rows=None)


def scorer_folder(spark, sf_dir) -> str:
    """The folder of the scorer fitted on the training rows of these tables; fitted once per shared folder, then loaded."""
    name = hashlib.sha256(f"{sf_dir} {SCORER_FEATURES} {SCORER_SETTINGS}".encode()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/scorer-{name}"
    if not exists(spark, f"{path}/fitted/_SUCCESS"):
        train, _ = halves(marked(spark, sf_dir))
        found = scorer.fit(train, SCORER_FEATURES, CLASSES, Registry(spark, path), SCORER_SETTINGS, data_name=sf_dir)
        found.components.coalesce(1).write.mode("overwrite").parquet(f"{path}/components")
        found.variants.coalesce(1).write.mode("overwrite").parquet(f"{path}/variants")
        scorer.save(found.scorer, f"{path}/fitted", spark)
    return path


def fitted_scorer(spark, sf_dir) -> scorer.Scorer:
    path = scorer_folder(spark, sf_dir)
    return scorer.load(Registry(spark, path), f"{path}/fitted")


METRICS = ("accuracy", "precision", "recall", "f1_score", "roc_auc")


@query("K8_metrics_summary")
def k8(spark, sf_dir):
    """Every component of every task with its status and its metrics on rows that it did not learn from."""
    df = spark.read.parquet(f"{scorer_folder(spark, sf_dir)}/components")
    return df.select("task", "model", "status", *[quantized(c).alias(c) for c in METRICS])


@query("M6_ensemble_run")
def m6_run(spark, sf_dir):
    """The three variants of both tasks on the same rows, and which one scores."""
    path = scorer_folder(spark, sf_dir)
    df = spark.read.parquet(f"{path}/variants")
    best = ensemble.best_variant(df, "f1_score", name="name").select("task", F.col("name").alias("_best"))
    return df.join(F.broadcast(best), "task").select("task", F.col("name").alias("variant"), (F.col("name") == F.col("_best")).alias("chosen"),
                                                     *[quantized(c).alias(c) for c in METRICS])


@query("A9_matrix_and_model_sinks", oracle("marked", """
select row_id, round(flow_bytes_per_s, 6) as first, label_binary, cast(8 as int) as width from marked where not is_test"""))
def a9(spark, sf_dir):
    """A feature matrix as a table and a fitted pipeline, both written and read back."""
    from pyspark.ml.functions import vector_to_array

    from flowlens.operators.transform import assemble

    train, _ = halves(marked(spark, sf_dir))
    path = staging_path(spark, "matrix")
    model = models.logistic(train, FEATURES, "label_binary", BINARY, max_iter=5)
    model.save(path + "-model")
    order = ("flow_bytes_per_s", *[f for f in FEATURES if f != "flow_bytes_per_s"])
    assemble(train, order).select("row_id", "label_binary", vector_to_array("features").alias("x")).write.parquet(path)
    loaded = models.Model.load(path + "-model")
    stored = spark.read.parquet(path)
    return stored.select("row_id", quantized(F.col("x")[0]).alias("first"), "label_binary",
                         F.lit(len(loaded.features)).cast("int").alias("width"))


@query("A9_matrix_cells", oracle("marked", f"""
select row_id, label_binary, unnest(generate_series(1, {len(FEATURES)})) as position,
  round(unnest([{", ".join(f"cast({f} as double)" for f in FEATURES)}]), 6) as value from marked where not is_test"""))
def a9_cells(spark, sf_dir):
    """Every cell of the matrix, written as vectors and read back."""
    from pyspark.ml.functions import vector_to_array

    from flowlens.operators.transform import assemble

    train, _ = halves(marked(spark, sf_dir))
    path = staging_path(spark, "matrix")
    assemble(train, FEATURES).select("row_id", "label_binary", "features").write.parquet(path)
    stored = spark.read.parquet(path)
    return stored.select("row_id", "label_binary", F.posexplode(vector_to_array("features")).alias("_at", "value")).select(
        "row_id", "label_binary", (F.col("_at") + 1).cast("bigint").alias("position"), quantized("value").alias("value"))


@query("M4_stacking_binary")
def m4(spark, sf_dir):
    df = view(spark, sf_dir, "preds").join(view(spark, sf_dir, "anom"), "original_index")
    inputs = ("binary_attack_probability", "multiclass_confidence", "p1", "p2", "p3", "p4")
    parts = splits.train_test_split(df, "true_binary_label", "original_index")
    calibration, test = halves(parts)
    model = models.stacking(calibration, inputs, "true_binary_label", BINARY, max_iter=100)
    return model.predict(test).select("stream_order", F.col("true_binary_label").alias("actual"), "predicted",
                                      quantized(F.col("p_stacking")[1]).alias("attack_probability"))


@query("M4_stacking_multiclass")
def m4_multi(spark, sf_dir):
    """Class probabilities of the components plus one detector probability."""
    df = components(spark, sf_dir).join(view(spark, sf_dir, "anom").select(F.col("original_index").alias("row_id"), "p1"), "row_id")
    parts = splits.train_test_split(df, "label_multiclass", "row_id")
    wide, names = models.spread_probabilities(parts, ("c0", "c1", "c2"), len(CLASSES))
    calibration, test = halves(wide)
    model = models.stacking(calibration, [*names, "p1"], "label_multiclass", CLASSES, max_iter=50)
    return model.predict(test).select("row_id", F.col("label_multiclass").alias("actual"), "predicted",
                                      quantized(F.array_max("p_stacking")).alias("confidence"))


def importances(spark, sf_dir):
    names = dict(enumerate(vocab.LABELS))
    linear, _ = fit("logistic", spark, sf_dir, "label_multiclass", CLASSES, max_iter=30)
    trees, _ = fit("forest", spark, sf_dir, trees=10, depth=5)
    return (models.native_importance(linear, spark, "multiclass", names),
            models.native_importance(trees, spark, "binary"))


@query("M12_native_importance")
def m12(spark, sf_dir):
    linear, trees = importances(spark, sf_dir)
    return linear.unionByName(trees).withColumn("importance", quantized("importance"))


def attributions(spark, sf_dir, permutations=12, explained=24, background=64):
    """Capped samples, as the explanation run prescribes, out of the whole table."""
    train, test = halves(marked(spark, sf_dir))
    model = models.boosted(train, FEATURES, "label_binary", BINARY, rounds=5, depth=3, rate=0.3)

    def score(df):
        return model.score(df).withColumn("_value", F.col(f"p_{model.name}")[1])

    samples = splits.stratified_sample(test, "label_multiclass", "row_id", explained)
    ground = splits.stratified_sample(train, "label_multiclass", "row_id", background)
    return models.shapley(samples, ground, FEATURES, "row_id", score, permutations)


@query("M13_shapley_attribution")
def m13(spark, sf_dir):
    df = attributions(spark, sf_dir)
    return df.select("row_id", "feature_name", *[quantized(c).alias(c) for c in ("contribution", "base_value", "explained_value")])


@query("M19_explanation_summary")
def m19(spark, sf_dir):
    linear, trees = importances(spark, sf_dir)
    contributions = attributions(spark, sf_dir, permutations=2)
    wide = contributions.groupBy("row_id").pivot("feature_name", sorted(FEATURES)).agg(F.first("contribution"))
    df = view(spark, sf_dir, "preds").join(view(spark, sf_dir, "anom"), "original_index")
    parts = {"binary_attack_probability": 0.6, "p1": 0.4}
    voting = explain.voting_binary(df, df.where("true_binary_label = 0"), list(parts), parts)
    return explain.run_summary({
        ("models", "multiclass", "native_importance"): linear, ("models", "binary", "native_importance"): trees,
        ("models", "binary", "sampled_contributions"): contributions,
        ("models", "binary", "sampled_summary"): explain.global_summary(wide, sorted(FEATURES)),
        ("models", "binary", "sampled_top"): explain.top_contributions(wide, sorted(FEATURES), ("row_id",)),
        ("ensembles", "binary", "voting_contributions"): voting,
        ("ensembles", "binary", "voting_summary"): explain.global_summary(voting, [f"contribution_{c}" for c in parts]),
    })


@query("J4_recursive_elimination")
def j4(spark, sf_dir):
    df = splits.stratified_sample(view(spark, sf_dir, "flows"), "label_multiclass", "row_id", 50_000)
    names = (*FEATURES, "idle_mean", "active_mean")
    return selection.eliminate(df, names, "label_binary", keep=4, max_iter=10)


@query("J5_principal_components")
def j5(spark, sf_dir):
    df = emb(spark, sf_dir)
    wide = df.select(*[F.col("features")[i].alias(f"f{i}") for i in range(64)])
    out = selection.principal_components(wide, [f"f{i}" for i in range(64)])
    return out.select("component", quantized("variance_ratio").alias("variance_ratio"), quantized("cumulative").alias("cumulative"), "needed")


# ---- detectors


def detector_scores(scorer, spark, sf_dir):
    _, test = halves(marked(spark, sf_dir))
    return scorer(test).select("row_id", "label_binary", quantized("score").alias("score"))


def benign_train(spark, sf_dir):
    train, _ = halves(marked(spark, sf_dir))
    parts = splits.benign_split(train, "row_id")
    return parts.where(~F.col("is_validation"))


@query("L1_isolation_forest")
def l1(spark, sf_dir):
    scorer = anomaly.isolation_forest(benign_train(spark, sf_dir), DETECTOR_FEATURES, "row_id")
    return detector_scores(scorer, spark, sf_dir)


@query("L2_one_class_boundary")
def l2(spark, sf_dir):
    return detector_scores(anomaly.one_class(benign_train(spark, sf_dir), DETECTOR_FEATURES), spark, sf_dir)


define("lof_train", "select * from emb where label = 0", "emb")
define("lof_known", f"""select * from (select a.vec_id as id, b.vec_id as neighbor, {DISTANCE} as d,
  row_number() over (partition by a.vec_id order by {DISTANCE}, b.vec_id) as rank from lof_train a join lof_train b on a.vec_id <> b.vec_id) where rank <= 20""", "lof_train")
define("lof_asked", f"""select * from (select a.vec_id as id, b.vec_id as neighbor, {DISTANCE} as d,
  row_number() over (partition by a.vec_id order by {DISTANCE}, b.vec_id) as rank from emb a join lof_train b on true where a.label <> 0) where rank <= 20""", "emb", "lof_train")


@query("L3_local_outlier_factor", oracle("lof_known lof_asked", """
with kd as (select id, max(d) as kd from lof_known group by 1),
dens as (select l.id, 1e0 / (avg(greatest(d, kd)) + 1e-10) as lrd from lof_known l join kd on kd.id = l.neighbor group by 1),
ask as (select l.id, 1e0 / (avg(greatest(d, kd)) + 1e-10) as lrd from lof_asked l join kd on kd.id = l.neighbor group by 1)
select a.id as vec_id, round(avg(dens.lrd) / any_value(ask.lrd), 6) as score
from lof_asked a join dens on dens.id = a.neighbor join ask on ask.id = a.id group by 1"""))
def l3(spark, sf_dir):
    df = emb(spark, sf_dir)
    out = anomaly.local_outlier_factor(df.where("label = 0"), df.where("label <> 0"), "vec_id", "features")
    return out.withColumn("score", quantized("score"))


@query("L4_reconstruction_error")
def l4(spark, sf_dir):
    return detector_scores(anomaly.reconstruction(benign_train(spark, sf_dir), DETECTOR_FEATURES, 3), spark, sf_dir)


@query("M20_detector_run")
def m20(spark, sf_dir):
    df = anomaly.run_detectors(marked(spark, sf_dir), DETECTOR_FEATURES, "row_id")
    names = ("threshold", "accuracy", "precision", "recall", "f1_score", "roc_auc", "score_min", "score_max")
    return df.select("detector", "status", *[quantized(c).alias(c) for c in names])


@query("Q25_request_scoring")
def q25(spark, sf_dir):
    """Request records to scored, risk-ranked rows by the whole scorer; histories start with the request."""
    asked = views.request_table(requests(spark, sf_dir), SCORER_FEATURES, ("row_id", "source_file"))
    preds = fitted_scorer(spark, sf_dir).score(asked).withColumns({
        "stream_order": F.col("row_id"), "event_time_utc": F.lit("2024-01-01 00:00:00").cast("timestamp")})
    out = alerts.score(preds)
    return out.select("stream_order", "source_file", "predicted_binary_label_name", "predicted_multiclass_label_name",
                      quantized("risk_score").alias("risk_score"), "alert_level", "recommended_action")
