"""Registered queries: splits, scaling, selection, ensembles, metrics, contributions."""

from __future__ import annotations

import flowlens.plans.q_ingest  # noqa: F401  its SQL texts are used below
from pyspark.sql import functions as F

from flowlens.functions.columns import quantized
from flowlens.operators import anomaly_scores, drift, ensemble, evaluate, explain, selection, splits, transform
from flowlens.operators.ordering import exact_quantiles
from flowlens.plans.registry import define, oracle, query
from flowlens.sources.bindings import CLASSES, COMPONENTS, components, table, view

# ---- E: splits and samples


def flows(spark, sf_dir):
    return view(spark, sf_dir, "flows")


@query("E1_stratified_split", oracle("marked", "select row_id, label_multiclass, is_test from marked"))
def e1(spark, sf_dir):
    df = splits.train_test_split(flows(spark, sf_dir), "label_multiclass", "row_id")
    return df.select("row_id", "label_multiclass", "is_test")


def sample_sql(size: int, cols: str) -> str:
    return oracle("flows", f"""
with sizes as (select label_multiclass as c, count(*) as n, {size} * (count(*) / (select cast(count(*) as double) from flows)) as share from flows group by 1),
alloc as (select c, cast(floor(share) as bigint) + case when row_number() over (order by share - floor(share) desc, c desc)
    <= {size} - (select sum(floor(share)) from sizes) then 1 else 0 end as take from sizes),
ranked as (select *, row_number() over (partition by label_multiclass order by md5(row_id || '-42'), row_id) as rn from flows)
select {cols} from ranked join alloc on c = label_multiclass where rn <= take""")


@query("E2_proportional_sample", sample_sql(777, "row_id, label_multiclass"))
def e2(spark, sf_dir):
    df = splits.stratified_sample(flows(spark, sf_dir), "label_multiclass", "row_id", 777)
    return df.select("row_id", "label_multiclass")


@query("E3_rows_by_index", oracle("scored flows", """
select row_id, source_file, destination_port from flows where row_id in (select original_index from scored where alert_level = 'Attack')"""))
def e3(spark, sf_dir):
    from flowlens.plans.q_alerts import scored

    ids = scored(spark, sf_dir).where("alert_level = 'Attack'").select(F.col("original_index").alias("row_id"))
    return splits.rows_by_id(flows(spark, sf_dir), ids, "row_id").select("row_id", "source_file", "destination_port")


CAPS = {0: 500, 1: 120, 2: 100_000}


@query("E4_class_caps", oracle("flows", """
select row_id, label_multiclass from (select *, row_number() over (partition by label_multiclass order by md5(row_id || '-42'), row_id) as rn from flows)
where rn <= case label_multiclass when 0 then 500 when 1 then 120 when 2 then 100000 else rn end"""))
def e4(spark, sf_dir):
    return splits.cap_classes(flows(spark, sf_dir), "label_multiclass", "row_id", CAPS).select("row_id", "label_multiclass")


@query("E5_sample_with_lineage", sample_sql(333, "row_id, source_file, label_multiclass, destination_port, flow_bytes_per_s"))
def e5(spark, sf_dir):
    df = splits.stratified_sample(flows(spark, sf_dir), "label_multiclass", "row_id", 333)
    return df.select("row_id", "source_file", "label_multiclass", "destination_port", "flow_bytes_per_s")


@query("E6_benign_split", oracle("flows", """
select row_id, row_number() over (order by md5(row_id || '-42'), row_id) <= round(1e-1 * count(*) over ()) as is_validation
from flows where label_binary = 0"""))
def e6(spark, sf_dir):
    return splits.benign_split(flows(spark, sf_dir), "row_id").select("row_id", "is_validation")


@query("E7_split_selector", oracle("marked", """
select row_id, source_file from marked where not is_test order by row_id limit 1000"""))
def e7(spark, sf_dir):
    marked = splits.train_test_split(flows(spark, sf_dir), "label_multiclass", "row_id")
    return splits.split_rows(marked, "train", "row_id", 1000).select("row_id", "source_file")


@query("E8_global_shuffle", oracle("flows", "select row_id, md5(row_id || '-42') as place from flows"))
def e8(spark, sf_dir):
    from flowlens.functions.columns import hash_key

    return splits.shuffled(flows(spark, sf_dir), "row_id").select("row_id", hash_key("row_id", 42).alias("place"))


# ---- F: scaling and encoding

NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("F1_standardize", "select l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"round(({c} - (select avg({c}) from lineitem)) / (select stddev_pop({c}) from lineitem), 5) as {c}" for c in NUMERIC)
    + " from lineitem")
def f1(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    df = transform.scale(li, transform.fit_scaler(li, NUMERIC))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", *[quantized(c, 5).alias(c) for c in NUMERIC])


@query("F1_standardize_train_only", oracle("marked", """
select row_id, round((flow_bytes_per_s - (select avg(flow_bytes_per_s) from marked where not is_test))
  / (select stddev_pop(flow_bytes_per_s) from marked where not is_test), 6) as flow_bytes_per_s from marked where is_test"""))
def f1_train(spark, sf_dir):
    marked = splits.train_test_split(flows(spark, sf_dir), "label_multiclass", "row_id")
    scaler = transform.fit_scaler(marked.where(~F.col("is_test")), ["flow_bytes_per_s"])
    return transform.scale(marked.where("is_test"), scaler).select("row_id", quantized("flow_bytes_per_s").alias("flow_bytes_per_s"))


@query("F2_one_hot", oracle("flows_raw", """
select row_id, case when label is null then 1e0 else 0e0 end as missing, case when label = ' BENIGN ' then 1e0 else 0e0 end as benign,
  case when label = 'Bot' then 1e0 else 0e0 end as bot, case when label = 'ddos' then 1e0 else 0e0 end as ddos from flows_raw"""))
def f2(spark, sf_dir):
    raw = view(spark, sf_dir, "flows_raw")
    df = transform.one_hot(raw, "label", transform.fit_categories(raw, "label"))
    return df.select("row_id", F.col("label___missing__").alias("missing"), F.col("label_ BENIGN ").alias("benign"),
                     F.col("label_Bot").alias("bot"), F.col("label_ddos").alias("ddos"))


@query("F2_one_hot_categories", oracle("flows_raw", f"""
with seen as (select distinct coalesce(label, '{transform.MISSING}') as category from flows_raw)
select row_id, category, case when coalesce(label, '{transform.MISSING}') = category then 1e0 else 0e0 end as value from flows_raw, seen"""))
def f2_categories(spark, sf_dir):
    """Every column of the encoding, one row each."""
    raw = view(spark, sf_dir, "flows_raw")
    known = transform.fit_categories(raw, "label")
    df = transform.one_hot(raw, "label", known)
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"`label_{c}`").alias("value")) for c in known])
    return df.select("row_id", F.inline(pairs))


@query("F2_one_hot_unseen", oracle("flows", """
select row_id, case when source_file = 'source_1.csv' then 1e0 else 0e0 end as source_1 from flows"""))
def f2_unseen(spark, sf_dir):
    """Fitted on one category only: all others are unseen."""
    df = flows(spark, sf_dir)
    seen = transform.fit_categories(df.where("source_file = 'source_1.csv'"), "source_file")
    out = transform.one_hot(df, "source_file", seen)
    return out.select("row_id", F.col("`source_file_source_1.csv`").alias("source_1"))


FEATURES = ("destination_port", "flow_duration", "flow_bytes_per_s", "flow_packets_per_s", "idle_mean", "active_mean")


@query("F3_feature_assembly", oracle("flows", """
select row_id, cast(10 as int) as size, cast(destination_port as double) as first, cast(active_mean as double) as sixth,
  case when event_type = 'BENIGN' then 1e0 else 0e0 end as hot
from (select *, label as event_type from flows)"""))
def f3(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    df = flows(spark, sf_dir).withColumn("kind", F.when(F.col("label") == "BENIGN", "b").when(F.col("label") == "Bot", "c")
                                         .when(F.col("label") == "DDoS", "d").otherwise("e"))
    seen = transform.fit_categories(df, "kind")
    out = transform.assemble(transform.one_hot(df, "kind", seen), [*FEATURES, *[f"kind_{c}" for c in seen]], "vector")
    a = vector_to_array("vector")
    return out.select("row_id", F.size(a).alias("size"), a[0].alias("first"), a[5].alias("sixth"), a[6].alias("hot"))


@query("F4_class_distribution", oracle("flows", "select label_multiclass, count(*) as count from flows group by 1"))
def f4(spark, sf_dir):
    return splits.class_distribution(flows(spark, sf_dir), ["label_multiclass"])


@query("F5_preprocessing_report", oracle("marked", """
select case when is_test then 'test' else 'train' end as split, label_multiclass as class_id, count(*) as rows, cast(0 as bigint) as invalid_rows
from marked group by 1, 2"""))
def f5(spark, sf_dir):
    marked = splits.train_test_split(flows(spark, sf_dir), "label_multiclass", "row_id")
    return transform.preprocessing_report(marked, "is_test", "label_multiclass", FEATURES)


# ---- J: selection (table-shaped part)


def corr_sql(source: str, names) -> str:
    return " union all ".join(
        f"""select cast({i} as int) as i, cast({j} as int) as j, '{names[i]}' as "left", '{names[j]}' as "right",
round(abs(corr(cast({names[i]} as double), cast({names[j]} as double))), 6) as r from {source}"""
        for i in range(len(names)) for j in range(i + 1, len(names)))


@query("J1_correlation_matrix", corr_sql("lineitem", NUMERIC))
def j1(spark, sf_dir):
    return selection.correlations(table(spark, sf_dir, "lineitem"), NUMERIC).withColumn("r", quantized("r"))


CANDIDATES = ("total_fwd_packets", "act_data_pkt_fwd", "idle_mean", "flow_duration", "flow_bytes_per_s", "syn_flag_count", "total_length_of_fwd_packets")
define("correlated", corr_sql("flows", CANDIDATES), "flows")


@query("J2_correlation_filter", oracle("correlated", """
select "right" as feature, string_agg("left", ',' order by i) as correlated_with from correlated where r > 98e-2 group by 1"""))
def j2(spark, sf_dir):
    dropped = selection.correlation_filter(selection.correlations(flows(spark, sf_dir), CANDIDATES))
    return dropped.withColumn("correlated_with", F.array_join("correlated_with", ","))


MI = ("destination_port", "flow_bytes_per_s", "syn_flag_count", "idle_mean")


@query("J3_mutual_information", oracle("flows", f"""
with long as ({' union all '.join(f"select '{f}' as feature, cast({f} as double) as v, label_multiclass as c from flows" for f in MI)}),
binned as (select feature, c, (rank() over (partition by feature order by v) - 1) * 10 // (select count(*) from flows) as b from long),
joint as (select feature, b, c, count(*) as n from binned group by all),
full_counts as (select *, sum(n) over (partition by feature, b) as nb, sum(n) over (partition by feature, c) as nc,
  (select count(*) from flows) as total from joint)
select feature, round(sum(n / total * ln(n * cast(total as double) / (cast(nb as double) * cast(nc as double)))), 6) as score from full_counts group by 1"""))
def j3(spark, sf_dir):
    return selection.mutual_information(flows(spark, sf_dir), MI, "label_multiclass").withColumn("score", quantized("score"))


DIGAMMA = ("(ln({n} + 6e0) - 5e-1 / ({n} + 6e0) - 1 / (12e0 * ({n} + 6e0) ** 2) + 1 / (120e0 * ({n} + 6e0) ** 4) - 1 / (252e0 * ({n} + 6e0) ** 6)"
           " - 1e0 / {n} - 1e0 / ({n} + 1) - 1e0 / ({n} + 2) - 1e0 / ({n} + 3) - 1e0 / ({n} + 4) - 1e0 / ({n} + 5))")


def digamma_sql(n: str) -> str:
    return DIGAMMA.replace("{n}", f"({n})")


@query("J3_neighbour_information", oracle("flows", f"""
with long as ({' union all '.join(f"select '{f}' as feature, cast({f} as double) as v, label_multiclass as c from flows" for f in MI)}),
sized as (select *, count(*) over (partition by feature, c) as nc from long),
rows as (select *, row_number() over (partition by feature, c order by v) as i from sized where nc > 1),
reach as (
  select feature, v, c, nc, list_sort(list_filter([{', '.join(f"abs({s}(v, {i}) over w - v)" for s in ('lag', 'lead') for i in (1, 2, 3))}],
    lambda x: x is not null))[least(3, nc - 1)] as r from rows window w as (partition by feature, c order by i)),
vals as (select feature, v as x, count(*) as n from rows group by 1, 2),
asked as (select distinct feature, v, r from reach),
closer as (
  select a.feature, a.v, a.r, sum(n) as m from asked a join vals on vals.feature = a.feature and x > a.v - a.r and x < a.v + a.r
  where a.r > 0 group by 1, 2, 3
  union all select a.feature, a.v, a.r, n from asked a join vals on vals.feature = a.feature and x = a.v where a.r = 0)
select feature, round(greatest({digamma_sql("count(*)")} + avg({digamma_sql("least(3, nc - 1)")} - {digamma_sql("nc")} - {digamma_sql("m")}), 0), 6) as score
from reach join closer using (feature, v, r) group by 1"""))
def j3_neighbours(spark, sf_dir):
    return selection.neighbour_information(flows(spark, sf_dir), MI, "label_multiclass").withColumn("score", quantized("score"))


# ---- K6, K7, L5, L6


@query("K6_class_priors", oracle("marked", """
select v.class_id, count(m.row_id) as count, count(m.row_id) / (select cast(count(*) as double) from marked where not is_test) as prior
from (values (0), (1), (2), (7), (10), (14)) as v(class_id) left join (select * from marked where not is_test) m on m.label_multiclass = v.class_id group by 1"""))
def k6(spark, sf_dir):
    marked = splits.train_test_split(flows(spark, sf_dir), "label_multiclass", "row_id")
    return ensemble.class_priors(marked.where(~F.col("is_test")), "label_multiclass", (0, 1, 2, 7, 10, 14))


@query("K7_probability_alignment", oracle("comps", """
select row_id, c0k4 as p14, 0e0 as p7, c0k0 as p0, c0k2 as p2, round(1e0 - c1k0, 6) as wide_benign, c1k0 as wide_attack from comps"""))
def k7(spark, sf_dir):
    df = components(spark, sf_dir)
    labels = F.array(*[F.lit(c) for c in CLASSES])
    out = df.select("row_id", ensemble.align_probabilities("c0", CLASSES, (14, 7, 0, 2)).alias("a"),
                    F.map_from_arrays(labels, "c0").alias("m"), ensemble.widen_binary(F.col("c1")[0]).alias("w"))
    by_map = ensemble.align_map("m", (14, 7, 0, 2))
    return out.select("row_id", by_map[0].alias("p14"), F.col("a")[1].alias("p7"), by_map[2].alias("p0"), F.col("a")[3].alias("p2"),
                      quantized(F.col("w")[0]).alias("wide_benign"), F.col("w")[1].alias("wide_attack"))


define("detector", """select p.stream_order, p.original_index, p.true_binary_label,
  (p.binary_attack_probability + a.p1 + a.p2) / 3e0 as score from preds p join anom a using (original_index)""", "preds", "anom")


def detector(spark, sf_dir):
    p, a = view(spark, sf_dir, "preds"), view(spark, sf_dir, "anom")
    mix = (F.col("binary_attack_probability") + F.col("p1") + F.col("p2")) / F.lit(3.0)
    return p.join(a, "original_index").select("stream_order", "original_index", "true_binary_label", mix.alias("score"))


@query("L5_quantile_threshold", oracle("detector", """
select round(quantile_cont(score, 995e-3), 6) as threshold from detector where true_binary_label = 0"""))
def l5(spark, sf_dir):
    benign = detector(spark, sf_dir).where("true_binary_label = 0")
    return exact_quantiles(benign, "score", (0.995,)).select(quantized("q0").alias("threshold"))


@query("L6_score_to_probability", oracle("detector", """
with cal as (select quantile_cont(score, 995e-3) as t, greatest(stddev_pop(score), 1e-6) as s from detector where true_binary_label = 0)
select stream_order, round(1e0 / (1e0 + exp(-greatest(-20e0, least(20e0, (score - t) / s)))), 6) as probability from detector, cal"""))
def l6(spark, sf_dir):
    df = detector(spark, sf_dir)
    cal = anomaly_scores.calibrate(df.where("true_binary_label = 0"), "score")
    out = df.withColumn("probability", anomaly_scores.to_probability("score", cal.threshold, cal.deviation))
    return out.select("stream_order", quantized("probability").alias("probability"))


@query("L6_score_to_probability_per_batch", oracle("detector", """
with cal as (select quantile_cont(score, 995e-3) as t from detector where true_binary_label = 0)
select stream_order, round(1e0 / (1e0 + exp(-greatest(-20e0, least(20e0, (score - t) / greatest(
  stddev_pop(score) over (partition by stream_order // 256), 1e-6))))), 6) as probability from detector, cal"""))
def l6_batch(spark, sf_dir):
    df = detector(spark, sf_dir)
    cal = anomaly_scores.calibrate(df.where("true_binary_label = 0"), "score")
    out = anomaly_scores.to_probability_by_batch(df, "score", cal.threshold, "stream_order", 256)
    return out.select("stream_order", quantized("probability").alias("probability"))


# ---- M: ensembles

define("weights", """select 'c' || (user_id % 8) as component, cast(sum(cast(round(value * 100) as bigint)) as double) / 100e0 / count(*) - 250e0 as weight
  from events group by 1""")


def weights(spark, sf_dir):
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double")
    return table(spark, sf_dir, "events").groupBy(F.concat(F.lit("c"), (F.col("user_id") % 8).cast("string")).alias("component")).agg(
        (cents / F.lit(100.0) / F.count("*") - F.lit(250.0)).alias("weight"))


@query("M1_weight_normalization", oracle("weights", """
select component, round(case when t.total > 0 then greatest(weight, 0e0) / t.total else 1e0 / t.n end, 6) as share
from weights, (select sum(greatest(weight, 0e0)) as total, count(*) as n from weights) t"""))
def m1(spark, sf_dir):
    return ensemble.normalized_weights(weights(spark, sf_dir)).select("component", quantized("share").alias("share"))


WEIGHTS = {"c0": 0.9, "c1": -0.2, "c2": 0.6}


def vote_sql(w) -> str:
    """The same order of operations as the expression, so that equal scores stay equal."""
    whole = "(" + " + ".join(f"{max(v, 0.0)}e0" for v in w.values()) + ")"
    mixed = ", ".join("0e0" + "".join(f" + {c}k{k} * ({max(v, 0.0)}e0 / {whole})" for c, v in w.items()) + f" as m{k}" for k in range(5))
    total = " + ".join(f"m{k}" for k in range(5))
    return f"""select row_id, label_multiclass, {', '.join(f'm{k} / case when t = 0 then 1e0 else t end as p{k}' for k in range(5))}
from (select *, {total} as t from (select *, {mixed} from comps))"""


define("soft", vote_sql({"c0": 1.0, "c1": 1.0, "c2": 1.0}), "comps")
define("weighted", vote_sql(WEIGHTS), "comps")
P = ", ".join(f"round(p{k}, 9) as p{k}" for k in range(5))


def spread(name):
    return [quantized(F.col(name)[k], 9).alias(f"p{k}") for k in range(5)]


@query("M2_soft_vote", oracle("soft", f"select row_id, {P} from soft"))
def m2_soft(spark, sf_dir):
    df = components(spark, sf_dir).withColumn("p", ensemble.soft_vote(COMPONENTS, 5))
    return df.select("row_id", *spread("p"))


@query("M2_weighted_average", oracle("weighted", f"select row_id, {P} from weighted"))
def m2_weighted(spark, sf_dir):
    df = components(spark, sf_dir).withColumn("p", ensemble.combine(COMPONENTS, WEIGHTS, 5))
    return df.select("row_id", *spread("p"))


@query("M2_weighted_average_long", oracle("weighted", " union all ".join(
    f"select row_id, cast({k} as int) as class_id, round(p{k}, 9) as probability from weighted" for k in range(5))))
def m2_long(spark, sf_dir):
    df = components(spark, sf_dir)
    cells = [F.struct(F.lit(c).alias("component"), F.lit(k).alias("class_id"), F.col(c)[k].alias("probability"))
             for c in COMPONENTS for k in range(5)]
    long = df.select("row_id", F.inline(F.array(*cells)))
    w = spark.createDataFrame(list(WEIGHTS.items()), "component string, weight double")
    return ensemble.combine_long(long, w).withColumn("probability", quantized("probability", 9))


define("component_metrics", " union all ".join(
    f"""select '{c}' as component, 'trained' as status, avg(case when c = true_binary_label then 1e0 else 0e0 end) as accuracy,
  coalesce(2e0 * tp / nullif(2e0 * tp + fp + fn, 0), 0e0) as f1_score from (select *,
    count(*) filter (where c = 1 and true_binary_label = 1) over () as tp, count(*) filter (where c = 1 and true_binary_label = 0) over () as fp,
    count(*) filter (where c = 0 and true_binary_label = 1) over () as fn
  from (select true_binary_label, case when {e} >= 5e-1 then 1 else 0 end as c from preds join anom using (original_index))) group by tp, fp, fn"""
    for c, e in (("binary", "binary_attack_probability"), ("class", "multiclass_confidence"), ("p2", "p2"), ("p3", "p3"))),
    "preds", "anom")
BINARY_COMPONENTS = {"binary": "binary_attack_probability", "class": "multiclass_confidence", "p2": "p2", "p3": "p3"}


def component_metrics(spark, sf_dir):
    df = view(spark, sf_dir, "preds").join(view(spark, sf_dir, "anom"), "original_index")
    out = None
    for name, column in BINARY_COMPONENTS.items():
        flagged = df.select("true_binary_label", (F.col(column) >= 0.5).cast("int").alias("flag"))
        row = evaluate.binary_metrics(flagged, "true_binary_label", "flag").select(
            F.lit(name).alias("component"), F.lit("trained").alias("status"), "accuracy", "f1_score")
        out = row if out is None else out.unionByName(row)
    return out


@query("M3_weights_from_metrics", oracle("component_metrics", """
select component, round(f1_score / (select sum(f1_score) from component_metrics), 6) as share from component_metrics"""))
def m3(spark, sf_dir):
    return ensemble.weights_from_metrics(component_metrics(spark, sf_dir)).select("component", quantized("share").alias("share"))


ARGMAX_SQL = "case " + " ".join(
    f"when p{k} = greatest(p0, p1, p2, p3, p4) then {label}" for k, label in enumerate(CLASSES)) + " end"
define("voted", f"select *, {ARGMAX_SQL} as predicted from soft", "soft")


def voted(spark, sf_dir):
    df = components(spark, sf_dir).withColumn("p", ensemble.soft_vote(COMPONENTS, 5))
    return df.withColumn("predicted", ensemble.argmax_label("p", CLASSES))


@query("M5_argmax_label", oracle("voted", "select row_id, predicted from voted"))
def m5(spark, sf_dir):
    return voted(spark, sf_dir).select("row_id", "predicted")


@query("M6_best_variant", oracle("component_metrics", """
select 'binary' as task, component as variant, round(f1_score, 6) as f1_score from component_metrics where status = 'trained' order by f1_score desc, component limit 1"""))
def m6(spark, sf_dir):
    metrics = component_metrics(spark, sf_dir).select(F.lit("binary").alias("task"), F.col("component").alias("variant"), "status", "f1_score")
    return ensemble.best_variant(metrics, "f1_score").withColumn("f1_score", quantized("f1_score"))


@query("M6_best_variant_override", oracle("component_metrics", """
select 'binary' as task, component as variant, round(f1_score, 6) as f1_score from component_metrics where component = 'p3'"""))
def m6_override(spark, sf_dir):
    metrics = component_metrics(spark, sf_dir).select(F.lit("binary").alias("task"), F.col("component").alias("variant"), "status", "f1_score")
    return ensemble.best_variant(metrics, "f1_score", override="p3").withColumn("f1_score", quantized("f1_score"))


# ---- M7 to M11: metrics


def quality(spark, sf_dir):
    return table(spark, sf_dir, "labels")


def flagged(spark, sf_dir):
    return view(spark, sf_dir, "preds").withColumn("flag", (F.col("binary_attack_probability") >= 0.5).cast("int"))


def binary_sql(source: str) -> str:
    return f"""
select tp, fp, fn, tn, (tp + tn) / n as accuracy, p as precision, r as recall, case when p + r > 0 then round(2e0 * p * r / (p + r), 6) else 0e0 end as f1_score
from (select *, case when tp + fp > 0 then tp / (tp + fp) else 0e0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0e0 end as r
  from (select count(*) filter (where t = 1 and f = 1) as tp, count(*) filter (where t = 0 and f = 1) as fp,
    count(*) filter (where t = 1 and f = 0) as fn, count(*) filter (where t = 0 and f = 0) as tn, count(*) as n from ({source})))"""


@query("M7_binary_metrics", oracle("preds", binary_sql(
    "select true_binary_label as t, case when binary_attack_probability >= 5e-1 then 1 else 0 end as f from preds")))
def m7(spark, sf_dir):
    df = evaluate.binary_metrics(flagged(spark, sf_dir), "true_binary_label", "flag")
    return df.withColumn("f1_score", quantized("f1_score"))


@query("M7_binary_metrics_labels", binary_sql("select quality as t, toxic as f from labels"))
def m7_labels(spark, sf_dir):
    return evaluate.binary_metrics(quality(spark, sf_dir), "quality", "toxic").withColumn("f1_score", quantized("f1_score"))


def report_sql(source: str, labels) -> str:
    return f"""
with x as ({source}), per as (select v.label, count(*) filter (where t = v.label and f = v.label) as hits,
    count(*) filter (where f = v.label) as predicted, count(*) filter (where t = v.label) as support
  from (values {', '.join(f'({v})' for v in labels)}) as v(label) cross join x group by 1),
m as (select *, case when p + r > 0 then 2e0 * p * r / (p + r) else 0e0 end as f from (select label, support,
  case when predicted > 0 then hits / predicted else 0e0 end as p, case when support > 0 then hits / support else 0e0 end as r from per))
select cast(label as varchar) as label, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1_score, support from m
union all select 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), cast(sum(support) as bigint) from m
union all select 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), cast(sum(support) as bigint) from m"""


VOTED_PAIRS = "select label_multiclass as t, predicted as f from voted"


def rounded_report(df):
    return df.withColumns({c: quantized(c) for c in ("precision", "recall", "f1_score")})


@query("M7_multiclass_metrics", oracle("voted", f"""
select (select avg(case when t = f then 1e0 else 0e0 end) from ({VOTED_PAIRS})) as accuracy, precision, recall, f1_score
from ({report_sql(VOTED_PAIRS, CLASSES)}) where label = 'weighted avg'"""))
def m7_multi(spark, sf_dir):
    return rounded_report(evaluate.multiclass_metrics(voted(spark, sf_dir), "label_multiclass", "predicted", CLASSES))


@query("M8_class_report", oracle("voted", report_sql(VOTED_PAIRS, (*CLASSES, 7))))
def m8(spark, sf_dir):
    return rounded_report(evaluate.class_report(voted(spark, sf_dir), "label_multiclass", "predicted", (*CLASSES, 7)))


@query("M8_class_report_labels", report_sql("select quality as t, toxic as f from labels", (0, 1)))
def m8_labels(spark, sf_dir):
    return rounded_report(evaluate.class_report(quality(spark, sf_dir), "quality", "toxic", (0, 1)))


def auc_sql(source: str) -> str:
    return f"""select count(*) filter (where t = 1) as positives, count(*) filter (where t = 0) as negatives,
  round((sum(case when t = 1 then r end) - count(*) filter (where t = 1) * (count(*) filter (where t = 1) + 1) / 2e0)
    / (count(*) filter (where t = 1) * cast(count(*) filter (where t = 0) as double)), 6) as roc_auc
from (select t, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2e0 as r from ({source}))"""


@query("M9_roc_auc", oracle("preds", auc_sql("select true_binary_label as t, binary_attack_probability as s from preds")))
def m9(spark, sf_dir):
    df = evaluate.roc_auc(view(spark, sf_dir, "preds"), "true_binary_label", "binary_attack_probability")
    return df.withColumn("roc_auc", quantized("roc_auc"))


@query("M9_roc_auc_labels", auc_sql("select quality as t, toxic as s from labels"))
def m9_labels(spark, sf_dir):
    return evaluate.roc_auc(quality(spark, sf_dir), "quality", "toxic").withColumn("roc_auc", quantized("roc_auc"))


@query("M9_multiclass_auc", oracle("soft", f"""
with per as ({' union all '.join(f"select {c} as c, * from ({auc_sql(f'select case when label_multiclass = {c} then 1 else 0 end as t, p{k} as s from soft')})" for k, c in enumerate(CLASSES))})
select round(sum(roc_auc * positives) / sum(positives), 5) as roc_auc from per"""))
def m9_multi(spark, sf_dir):
    df = evaluate.multiclass_auc(voted(spark, sf_dir), "label_multiclass", "p", CLASSES)
    return df.withColumn("roc_auc", quantized("roc_auc", 5))


@query("M10_min_max_scaling", oracle("detector", """
select stream_order, round((score - lo) / (hi - lo), 6) as scaled from detector, (select min(score) as lo, max(score) as hi from detector)"""))
def m10(spark, sf_dir):
    df = evaluate.min_max(detector(spark, sf_dir), "score")
    return df.select("stream_order", quantized("scaled").alias("scaled"))


@query("M11_roc_curve", oracle("preds", """
with g as (select binary_attack_probability as s, count(*) filter (where true_binary_label = 1) as pos, count(*) filter (where true_binary_label = 0) as neg from preds group by 1),
c as (select s as threshold, row_number() over (order by s desc) as point, sum(pos) over (order by s desc) / sum(pos) over () as tpr,
  sum(neg) over (order by s desc) / sum(neg) over () as fpr from g
  union all select null, 0, 0e0, 0e0),
n as (select max(point) as last from c)
select point, round(threshold, 6) as threshold, round(tpr, 6) as true_positive_rate, round(fpr, 6) as false_positive_rate from c, n
where last < 400 or point in (select (i * last) // 399 from generate_series(0, 399) as x(i))"""))
def m11(spark, sf_dir):
    df = evaluate.roc_curve(view(spark, sf_dir, "preds"), "true_binary_label", "binary_attack_probability")
    return df.withColumns({c: quantized(c) for c in ("threshold", "true_positive_rate", "false_positive_rate")})


# ---- M14 to M17: contributions

PARTS = ("binary_attack_probability", "multiclass_confidence", "p1", "p2", "p3", "p4")
define("contributions", "select stream_order, true_binary_label, " + ", ".join(
    f"round({c} - 5e-1, 6) as {c}" for c in PARTS) + " from preds join anom using (original_index)", "preds", "anom")


def contributions(spark, sf_dir):
    df = view(spark, sf_dir, "preds").join(view(spark, sf_dir, "anom"), "original_index")
    return df.select("stream_order", "true_binary_label", *[quantized(F.col(c) - 0.5).alias(c) for c in PARTS])


SUMMARY_SQL = " union all ".join(
    f"select '{c}' as feature_name, round(avg(abs({c})), 6) as mean_abs_contribution, round(avg({c}), 6) as mean_contribution from contributions"
    for c in PARTS)


def rounded_summary(df):
    return df.withColumns({c: quantized(c) for c in ("mean_abs_contribution", "mean_contribution")})


@query("M14_global_contributions", oracle("contributions", SUMMARY_SQL))
def m14(spark, sf_dir):
    return rounded_summary(explain.global_summary(contributions(spark, sf_dir), PARTS))


@query("M15_top_contributions", oracle("contributions", f"""
select stream_order, true_binary_label, cast(rn as int) as rank, feature_name, contribution, abs(contribution) as abs_contribution
from (select *, row_number() over (partition by stream_order order by abs(contribution) desc, place) as rn
  from ({' union all '.join(f"select stream_order, true_binary_label, {i} as place, '{c}' as feature_name, {c} as contribution from contributions" for i, c in enumerate(PARTS))})) where rn <= 4"""))
def m15(spark, sf_dir):
    return explain.top_contributions(contributions(spark, sf_dir), PARTS, ("stream_order", "true_binary_label"), 4)


@query("Q21_top_summary_table", oracle("contributions", f"select * from ({SUMMARY_SQL}) order by mean_abs_contribution desc limit 2"))
def q21(spark, sf_dir):
    from flowlens.operators import views

    return rounded_summary(views.top_summary(explain.global_summary(contributions(spark, sf_dir), PARTS), 2))


@query("Q21_sorted_metrics", oracle("component_metrics", """
select 'binary' as task, component, round(f1_score, 6) as f1_score, round(accuracy, 6) as roc_auc from component_metrics"""))
def q21_metrics(spark, sf_dir):
    from flowlens.operators import views

    metrics = component_metrics(spark, sf_dir).select(
        F.lit("binary").alias("task"), "component", "f1_score", F.col("accuracy").alias("roc_auc"))
    return views.sorted_metrics(metrics).withColumns({c: quantized(c) for c in ("f1_score", "roc_auc")})


VOTERS = {"binary_attack_probability": 0.5, "p1": 0.3, "p2": 0.2, "p3": -1.0}
define("voters", "select * from preds join anom using (original_index)", "preds", "anom")
BACKGROUND = "(select {} from voters where true_binary_label = 0)"


def voters(spark, sf_dir):
    return view(spark, sf_dir, "preds").join(view(spark, sf_dir, "anom"), "original_index")


@query("M16_voting_binary", oracle("voters", f"""
select stream_order, {', '.join(f"round({max(w, 0.0)}e0 * ({c} - {BACKGROUND.format(f'avg({c})')}), 9) as contribution_{c}" for c, w in VOTERS.items())},
  round({' + '.join(f"{w}e0 * {BACKGROUND.format(f'avg({c})')}" for c, w in VOTERS.items() if w > 0)}, 9) as base_value,
  round({' + '.join(f"{w}e0 * {c}" for c, w in VOTERS.items() if w > 0)}, 9) as explained_value
from voters"""))
def m16(spark, sf_dir):
    df = voters(spark, sf_dir)
    out = explain.voting_binary(df, df.where("true_binary_label = 0"), list(VOTERS), VOTERS)
    names = [*[f"contribution_{c}" for c in VOTERS], "base_value", "explained_value"]
    return out.select("stream_order", *[(quantized(c, 9) + 0.0).alias(c) for c in names])


@query("M16_voting_multiclass", oracle("comps weighted", f"""
with b as (select {', '.join(f'avg({c}k{k}) as b_{c}k{k}' for c in ('c0', 'c2') for k in range(5))} from comps where label_multiclass = 0),
j as (select w.*, comps.* exclude (row_id, label_multiclass), b.*, case {' '.join(f'when w.p{k} = greatest(w.p0, w.p1, w.p2, w.p3, w.p4) then {k}' for k in range(5))} end as place
  from weighted w join comps using (row_id) cross join b)
select row_id, cast(place as int) as predicted_class,
  {', '.join(f"round({s} * (case place {' '.join(f'when {k} then {c}k{k} - b_{c}k{k}' for k in range(5))} end), 6) as contribution_{c}" for c, s in (('c0', '(9e-1 / 15e-1)'), ('c2', '(6e-1 / 15e-1)')))},
  round(case place {' '.join(f'when {k} then p{k}' for k in range(5))} end, 6) as explained_value
from j"""))
def m16_multi(spark, sf_dir):
    df = components(spark, sf_dir).withColumn("p", ensemble.combine(COMPONENTS, WEIGHTS, 5))
    out = explain.voting_multiclass(df, df.where("label_multiclass = 0"), COMPONENTS, WEIGHTS, "p", 5)
    return out.select("row_id", "predicted_class", quantized("contribution_c0").alias("contribution_c0"),
                      quantized("contribution_c2").alias("contribution_c2"), quantized("explained_value").alias("explained_value"))


COEF = {"binary_attack_probability": 2.5, "p1": -1.25, "p2": 0.75, "p3": 1.5}
INTERCEPT = -1.5


@query("M17_stacking_binary", oracle("voters", f"""
select stream_order, {', '.join(f"round({w}e0 * ({c} - {BACKGROUND.format(f'avg({c})')}), 9) as contribution_{c}" for c, w in COEF.items())},
  round({INTERCEPT}e0 + {' + '.join(f"{w}e0 * {BACKGROUND.format(f'avg({c})')}" for c, w in COEF.items())}, 9) as base_value,
  round({INTERCEPT}e0 + {' + '.join(f"{w}e0 * {c}" for c, w in COEF.items())}, 9) as explained_value
from voters"""))
def m17(spark, sf_dir):
    df = voters(spark, sf_dir)
    out = explain.stacking_binary(df, df.where("true_binary_label = 0"), list(COEF), list(COEF.values()), INTERCEPT)
    names = [*[f"contribution_{c}" for c in COEF], "base_value", "explained_value"]
    return out.select("stream_order", *[quantized(c, 9).alias(c) for c in names])


STACK_INPUTS = [f"{c}k{k}" for c in ("c0", "c1") for k in range(5)] + ["extra"]
STACK_COEF = [[round(((7 * i + 3 * j) % 11 - 5) * 0.3, 1) for j in range(len(STACK_INPUTS))] for i in range(5)]
STACK_BIAS = [0.1, -0.2, 0.3, 0.0, -0.1]
define("stacked", "select *, c2k0 as extra from comps", "comps")
STACK_SCORES = ", ".join(
    f"{STACK_BIAS[i]}e0 + " + " + ".join(f"({STACK_COEF[i][j]}e0) * {n}" for j, n in enumerate(STACK_INPUTS)) + f" as s{i}" for i in range(5))


def stack_part(name: str) -> str:
    cells = [(j, n) for j, n in enumerate(STACK_INPUTS) if n == name or (n[:2] == name and n != "extra")]
    arms = " ".join(f"when {i} then " + " + ".join(f"({STACK_COEF[i][j]}e0) * ({n} - b_{n})" for j, n in cells) for i in range(5))
    return f"round(case place {arms} end, 6) as contribution_{name}"


@query("M17_stacking_multiclass", oracle("stacked", f"""
with b as (select {', '.join(f'avg({n}) as b_{n}' for n in STACK_INPUTS)} from stacked where label_multiclass = 0),
s as (select *, {STACK_SCORES} from stacked cross join b),
j as (select *, case {' '.join(f'when s{i} = greatest(s0, s1, s2, s3, s4) then {i}' for i in range(5))} end as place from s)
select row_id, cast(place as int) as predicted_class, {', '.join(stack_part(n) for n in ('c0', 'c1', 'extra'))},
  round(greatest(s0, s1, s2, s3, s4), 6) as explained_value from j"""))
def m17_multi(spark, sf_dir):
    df = components(spark, sf_dir).withColumn("extra", F.col("c2")[0])
    out = explain.stacking_multiclass(df, df.where("label_multiclass = 0"), ["c0", "c1"], ["extra"], 5, STACK_COEF, STACK_BIAS)
    names = ("contribution_c0", "contribution_c1", "contribution_extra", "explained_value")
    return out.select("row_id", "predicted_class", *[quantized(c).alias(c) for c in names])


# ---- N3, N4, N10 as batch twins


@query("N3_event_time", oracle("preds", """
select stream_order, strftime(timestamp '2024-01-01 00:00:00' + to_milliseconds(stream_order * 100), '%Y-%m-%d %H:%M:%S.%g') as event_time from preds"""))
def n3(spark, sf_dir):
    from flowlens.streaming import events

    df = events.simulated_time(view(spark, sf_dir, "preds"), "2024-01-01 00:00:00", 100)
    return df.select("stream_order", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSS").alias("event_time"))


@query("N10_running_moments", oracle("flows", " union all ".join(
    f"select '{c}' as feature_name, count(*) as rows, round(sum({c}), 2) as total, round(sum(cast({c} as double) * {c}) / 1e6, 3) as squares_m from flows"
    for c in ("destination_port", "flow_bytes_per_s", "idle_mean"))))
def n10(spark, sf_dir):
    df = drift.moments(flows(spark, sf_dir), ("destination_port", "flow_bytes_per_s", "idle_mean"))
    return df.select("feature_name", "rows", F.round("total", 2).alias("total"), F.round(F.col("squares") / 1e6, 3).alias("squares_m"))
