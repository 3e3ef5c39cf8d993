"""Registered queries: neighbours and synthetic rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.columns import quantized
from flowlens.operators import neighbors, resample
from flowlens.plans.registry import define, oracle, query
from flowlens.sources.bindings import emb

define("emb", "select vec_id, cast(embedding as double[]) as features, label, case when label = 3 then 1 else 0 end as minor from embeddings")
DISTANCE = "sqrt(list_sum(list_transform(list_zip(a.features, b.features), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"
define("near_class", f"""select * from (select a.vec_id as id, b.vec_id as neighbor, a.label, {DISTANCE} as distance, b.features as neighbor_vector,
  row_number() over (partition by a.vec_id order by {DISTANCE}, b.vec_id) as rank
  from emb a join emb b on a.label = b.label and a.vec_id <> b.vec_id) where rank <= 5""", "emb")


@query("G1_knn_join", oracle("near_class", """
select label, id, neighbor, round(distance, 6) as distance, cast(rank as int) as rank from near_class"""))
def g1(spark, sf_dir):
    found = neighbors.knn_join(emb(spark, sf_dir), 5, "vec_id", "features", ["label"])
    return found.select("label", "id", "neighbor", quantized("distance").alias("distance"), "rank")


@query("G1_knn_join_small_blocks", oracle("emb", f"""
select id, neighbor, round(distance, 6) as distance, cast(rank as int) as rank from (select a.vec_id as id, b.vec_id as neighbor, {DISTANCE} as distance,
  row_number() over (partition by a.vec_id order by {DISTANCE}, b.vec_id) as rank from emb a join emb b on a.vec_id <> b.vec_id) where rank <= 7"""))
def g1_blocks(spark, sf_dir):
    """Over all classes, with blocks far smaller than the cells."""
    found = neighbors.knn_join(emb(spark, sf_dir), 7, "vec_id", "features", block=40, pivots=8)
    return found.select("id", "neighbor", quantized("distance").alias("distance"), "rank")


def unit(text: str) -> str:
    return f"cast('0x' || substr(md5({text}), 1, 8) as bigint) / 4294967296e0"


ENDS = """round(p.features[1] + gap * (n.neighbor_vector[1] - p.features[1]), 6) as first,
  round(p.features[64] + gap * (n.neighbor_vector[64] - p.features[64]), 6) as last"""
CELLS = """unnest(generate_series(1, len(p.features))) as position,
  round(unnest(list_transform(list_zip(p.features, n.neighbor_vector), lambda x: x[1] + gap * (x[2] - x[1]))), 6) as value"""


def synthetic_sql(copies: str, shown: str = ENDS) -> str:
    """Rows of `copies`(id, label, features, copies) interpolated towards `near_class`."""
    return f"""
{copies}, made as (select c.id, c.label, c.features, unnest(generate_series(1, c.copies)) as copy from copied c where c.copies > 0),
picked as (select m.*, cast(floor({unit("m.id || '-' || m.copy || '-42-n'")} * n.cnt) as bigint) + 1 as pick, {unit("m.id || '-' || m.copy || '-42-u'")} as gap
  from made m join (select id, count(*) as cnt from near group by 1) n on n.id = m.id)
select p.id as vec_id, p.label, cast(p.copy as int) as copy, n.neighbor, {shown}
from picked p join near n on n.id = p.id and n.rank = p.pick"""


def even_sql(wanted: str) -> str:
    return f"""
with near as (select * from near_class), sizes as (select label, count(*) as n from emb group by 1), want as ({wanted}),
copied as (select e.vec_id as id, e.label, e.features, w.g // s.n + case when row_number() over (partition by e.label order by md5(e.vec_id || '-42-r'), e.vec_id)
  <= w.g % s.n then 1 else 0 end as copies from emb e join sizes s using (label) join want w using (label))"""


def shown(df):
    return df.select("vec_id", "label", "copy", "neighbor", quantized(F.col("features")[0]).alias("first"),
                     quantized(F.col("features")[63]).alias("last"))


def cells(df):
    """One row per component of every synthetic vector."""
    return df.select("vec_id", "label", "copy", "neighbor", F.posexplode("features").alias("_at", "value")).select(
        "vec_id", "label", "copy", "neighbor", (F.col("_at") + 1).cast("bigint").alias("position"), quantized("value").alias("value"))


ONE_CLASS = even_sql("select 3 as label, 130 as g")


def one_class(spark, sf_dir):
    return resample.smote(emb(spark, sf_dir), "label", "vec_id", "features", {3: 130})


@query("G2_smote", oracle("near_class", synthetic_sql(ONE_CLASS)))
def g2(spark, sf_dir):
    return shown(one_class(spark, sf_dir))


@query("G2_smote_cells", oracle("near_class", synthetic_sql(ONE_CLASS, CELLS)))
def g2_cells(spark, sf_dir):
    return cells(one_class(spark, sf_dir))


define("hard", f"""select id, avg(case when nl <> 3 then 1e0 else 0e0 end) as level from (select a.vec_id as id, b.label as nl,
  row_number() over (partition by a.vec_id order by {DISTANCE}, b.vec_id) as rank
  from emb a join emb b on a.vec_id <> b.vec_id where a.label = 3) where rank <= 5 group by 1""", "emb")
define("adasyn_alloc", """select id, level, base + case when row_number() over (order by level desc, md5(id || '-42-r'), id) <= rest then 1 else 0 end as copies
  from (select *, cast(floor(level / total * g) as bigint) as base, g - sum(cast(floor(level / total * g) as bigint)) over () as rest
    from (select *, sum(level) over () as total, (select count(*) filter (where minor = 0) - count(*) filter (where minor = 1) from emb) as g from hard))""", "hard")


def minority(spark, sf_dir):
    return emb(spark, sf_dir).withColumn("minor", (F.col("label") == 3).cast("int"))


@query("G3_adasyn_allocation", oracle("adasyn_alloc", """
select id as vec_id, round(level, 6) as level, cast(copies as int) as copies from adasyn_alloc"""))
def g3(spark, sf_dir):
    df = minority(spark, sf_dir)
    scores = resample.difficulty(df, "minor", "vec_id", "features", 1)
    few = df.where("minor = 1").count()
    out = resample.adasyn_copies(scores, "vec_id", df.count() - 2 * few, 42)
    return out.select("vec_id", quantized("level").alias("level"), "copies")


HARD_COPIES = """
with near as (select * from near_class), copied as (select a.id, e.label, e.features, a.copies from adasyn_alloc a join emb e on e.vec_id = a.id)"""


def adaptive(spark, sf_dir):
    made = resample.adasyn(minority(spark, sf_dir), "minor", "vec_id", "features", 1, 0)
    return made.withColumn("label", F.lit(3))


@query("G3_adasyn", oracle("adasyn_alloc near_class", synthetic_sql(HARD_COPIES)))
def g3_rows(spark, sf_dir):
    return shown(adaptive(spark, sf_dir))


@query("G3_adasyn_cells", oracle("adasyn_alloc near_class", synthetic_sql(HARD_COPIES, CELLS)))
def g3_cells(spark, sf_dir):
    return cells(adaptive(spark, sf_dir))


EVERY_CLASS = even_sql("select label, least(greatest(n, 57), 60) - n as g from sizes where label <> 0 and least(greatest(n, 57), 60) > n")


def every_class(spark, sf_dir):
    df = emb(spark, sf_dir)
    wanted = resample.smote_targets(resample.class_sizes(df, "label"), 0, 57, 60)
    return resample.smote(df, "label", "vec_id", "features", wanted)


@query("G4_smote_multiclass", oracle("near_class", synthetic_sql(EVERY_CLASS)))
def g4(spark, sf_dir):
    return shown(every_class(spark, sf_dir))


@query("G4_smote_multiclass_cells", oracle("near_class", synthetic_sql(EVERY_CLASS, CELLS)))
def g4_cells(spark, sf_dir):
    return cells(every_class(spark, sf_dir))


@query("G5_balance_binary", oracle("emb", """
select minor, count(*) as rows, count(*) filter (where minor = 0) as originals from (
  select minor, row_number() over (partition by minor order by md5(vec_id || '-42'), vec_id) as rn, 0 as made from emb) where minor = 1 or rn <= 200 group by 1
having minor = 0 union all select 1, 200, count(*) from emb where minor = 1"""))
def g5(spark, sf_dir):
    out = resample.balance_binary(minority(spark, sf_dir), "minor", "vec_id", "features", majority_cap=200)
    return out.groupBy("minor").agg(F.count("*").alias("rows"), F.count_if(F.col("copy") == 0).alias("originals"))


@query("G6_balance_multiclass", oracle("emb", """
with sizes as (select label, least(count(*), case when label = 0 then 30 else 50 end) as n from emb group by label),
t as (select greatest(48, cast(floor(median(n)) as bigint)) as target from sizes where label <> 0)
select label, case when label = 0 then n else least(greatest(n, target), 50) end as rows, n as originals from sizes, t"""))
def g6(spark, sf_dir):
    out = resample.balance_multiclass(emb(spark, sf_dir), "label", "vec_id", "features", benign_cap=30, attack_cap=50, min_target=48)
    return out.groupBy("label").agg(F.count("*").alias("rows"), F.count_if(F.col("copy") == 0).alias("originals"))
