"""Context weights and choices between forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wakeline.catalog.base import pct, query
from wakeline.catalog.modelling import ALT_SQL, MODELS, STEP, forecasts
from wakeline.catalog.windowing import FEAT_SQL, _win
from wakeline.functions.geo import haversine_km
from wakeline.operators import baselines as B, evaluate as E, gates as X, lookup as U, motion as M, windows as W
from wakeline.plans import adapter as A
from wakeline.sources import reports
from wakeline.sources.scratch import new_path

LABELS = ["9h", "12h", "18h", "24h"]
COLUMNS = ["a0", "a1", "a2", "a3"]


def weights(spark, sf) -> DataFrame:
    """Weights per window from the speeds at four history steps."""
    raw = F.array(*[F.lit(1.0) + F.col("hist")[i]["sog"].cast("double") for i in (7, 5, 3, 1)])
    total = lambda a: a[0] + a[1] + a[2] + a[3]
    return _win(spark, sf).withColumn("_w", raw).withColumn("alpha", F.transform("_w", lambda x: x / total(F.col("_w")))).drop("_w")


def flat(spark, sf) -> DataFrame:
    """Descriptive features and weights side by side, as columns."""
    w = M.descriptive_features(weights(spark, sf))
    return w.select("window_id", *M.DESCRIPTIVE, *[F.col("alpha")[i].alias(c) for i, c in enumerate(COLUMNS)])


_each = "(VALUES (0, '9h'), (1, '12h'), (2, '18h'), (3, '24h')) v(j, context)"
_aj = "CASE v.j WHEN 0 THEN a0 WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE a3 END"
SUMMARY = "context:s mean_weight:d median_weight:d argmax_pct:d mean_entropy:d most_selected:b"
SUMMARY_SQL = f"""
    SELECT *, row_number() OVER (ORDER BY argmax_pct DESC, j) = 1 AS most_selected FROM (
        SELECT v.context, v.j, avg({_aj}) AS mean_weight, quantile_cont({_aj}, 0.5) AS median_weight,
               100 * avg(CASE WHEN choice = v.j THEN 1.0 ELSE 0.0 END) AS argmax_pct, avg(entropy) AS mean_entropy FROM gate, {_each} GROUP BY v.context, v.j)"""


@query("e11_gate_summary", SUMMARY, SUMMARY_SQL)
def e11(spark, sf):
    return X.gate_summary(weights(spark, sf).select("alpha"), LABELS)


@query("s10_read_gate_weights", SUMMARY, SUMMARY_SQL)
def s10(spark, sf):
    # A weight document holds the windows of one trajectory and day, at most one per grid step.
    docs = weights(spark, sf).groupBy("traj_id", F.to_date("start_time").alias("day")).agg(
        F.array(F.lit(9.0), F.lit(12.0), F.lit(18.0), F.lit(24.0)).alias("context_hours"), F.collect_list("alpha").alias("per_sample")
    ).drop("traj_id", "day")
    path = new_path(spark, "gate")
    docs.write.json(path)
    return X.gate_summary(reports.read_gate_weights(spark, path, multi_line=False), LABELS)


@query("e11_softmax_entropy", "label:i n:i mean_entropy:d", """
    SELECT label, count(*) AS n, avg(h) AS mean_entropy FROM (
        SELECT label, vec_id, -sum(p * ln(p + 1e-8::DOUBLE)) AS h FROM (
            SELECT label, vec_id, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings))
        GROUP BY label, vec_id) GROUP BY label""")
def e11_softmax(spark, sf):
    logits = F.transform("embedding", lambda x: x.cast("double"))
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", X.softmax(logits).alias("alpha"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(X.entropy(F.col("alpha"))).alias("mean_entropy"))


@query("e12_gate_by_class", "vessel_class:i context:s n:i mean_weight:d", f"""
    SELECT coalesce(l.vessel_class, 0) AS vessel_class, v.context, count(*) AS n, avg({_aj}) AS mean_weight
    FROM gate LEFT JOIN lookup l USING (mmsi), {_each} GROUP BY 1, 2""")
def e12(spark, sf):
    classed = U.attach_class(weights(spark, sf), U.vessel_type_lookup(A.stored_segments(spark, sf)))
    return X.gate_by_class(classed, LABELS)


PROFILED = ["mean_sog", "max_abs_dcog", "straightness"]
_flat_sql = f"SELECT f.*, a0, a1, a2, a3 FROM ({FEAT_SQL}) f JOIN gate USING (window_id)"


@query("e13_quartile_profile", "context:s feature:s low:d high:d", " UNION ALL ".join(f"""
    SELECT '{w}' AS context, '{f}' AS feature, avg({f}) FILTER (WHERE {w} <= lo) AS low, avg({f}) FILTER (WHERE {w} >= hi) AS high
    FROM ({_flat_sql}), (SELECT quantile_cont({w}, 0.25) AS lo, quantile_cont({w}, 0.75) AS hi FROM gate)""" for w in COLUMNS for f in PROFILED))
def e13(spark, sf):
    return X.quartile_profile(flat(spark, sf), PROFILED, COLUMNS)


@query("e13_tercile_weights", "motion:s n:i a0:d a1:d a2:d a3:d", f"""
    SELECT CASE WHEN maneuver_mean_abs_dcog <= p33 THEN 'low' WHEN maneuver_mean_abs_dcog <= p66 THEN 'mid' ELSE 'high' END AS motion, count(*) AS n,
           avg(a0) AS a0, avg(a1) AS a1, avg(a2) AS a2, avg(a3) AS a3
    FROM ({_flat_sql}), (SELECT quantile_cont(mean_dcog, 0.33) AS p33, quantile_cont(mean_dcog, 0.66) AS p66 FROM hm) GROUP BY 1""")
def e13_terciles(spark, sf):
    return X.tercile_weights(flat(spark, sf), "maneuver_mean_abs_dcog", COLUMNS)


_ranked = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in PROFILED + COLUMNS)


@query("e14_spearman", "feature:s context:s r:d max_abs_r:d", f"""
    WITH ranks AS (SELECT {_ranked} FROM ({_flat_sql}))
    SELECT *, max(abs(r)) OVER (PARTITION BY feature) AS max_abs_r FROM ({" UNION ALL ".join(f"SELECT '{f}' AS feature, '{w}' AS context, corr({f}, {w}) AS r FROM ranks" for f in PROFILED for w in COLUMNS)})""")
def e14(spark, sf):
    return X.spearman(flat(spark, sf), PROFILED, COLUMNS)


_contexts = ", ".join(f"('{c}')" for c in [*COLUMNS, "probe"])


@query("e15_forest_importance", "context:s feature:s importance:d")
def e15(spark, sf):
    return X.forest_importance(flat(spark, sf), list(M.DESCRIPTIVE), COLUMNS)


@query("e15_importance_invariants", "context:s n_features:i total:d leader:s", f"""
    SELECT context, {len(M.DESCRIPTIVE)} AS n_features, 1.0::DOUBLE AS total, CASE WHEN context = 'probe' THEN 'mean_sog' ELSE '' END AS leader
    FROM (VALUES {_contexts}) t(context)""")
def e15_invariants(spark, sf):
    """Importances of a context sum to 1; a weight made from one feature alone names that feature."""
    table = flat(spark, sf).withColumn("probe", F.col("mean_sog") * 2 + 1)
    found = X.forest_importance(table, list(M.DESCRIPTIVE), [*COLUMNS, "probe"], trees=20)
    leader = F.max_by("feature", "importance")
    return found.groupBy("context").agg(
        F.countDistinct("feature").alias("n_features"),
        F.round(F.sum("importance"), 6).alias("total"),
        F.when(F.col("context") == "probe", leader).otherwise(F.lit("")).alias("leader"),
    )


def choices(spark, sf) -> DataFrame:
    """Final errors of four alternative forecasts and the context with the largest weight."""
    models = {**MODELS, "persist": B.predictor("persist"), "published": B.predictor("kinematic", STEP, "as_reference")}
    w = weights(spark, sf).withColumn("_a", W.anchor()).withColumn("_t", W.as_points("fut")[A.N - 1])
    errs = []
    for step_of in models.values():
        p = B.baseline_at(F.col("hist"), F.col("_a"), A.N - 1, step_of)
        errs.append(haversine_km(F.col("_t.lat"), F.col("_t.lon"), p.lat, p.lon))
    return w.withColumn("errors", F.array(*errs)).withColumn("choice", X.argmax(F.col("alpha")))


@query("e16_best_possible", "n:i match_pct:d median_best_km:d " + " ".join(f"best_pct_{x}:d chosen_pct_{x}:d" for x in LABELS), f"""
    SELECT count(*) AS n, 100 * avg(CASE WHEN best = choice THEN 1.0 ELSE 0.0 END) AS match_pct, {pct('best_km', 0.5)} AS median_best_km,
           {", ".join(f"100 * avg(CASE WHEN best = {i} THEN 1.0 ELSE 0.0 END) AS best_pct_{x}, 100 * avg(CASE WHEN choice = {i} THEN 1.0 ELSE 0.0 END) AS chosen_pct_{x}" for i, x in enumerate(LABELS))}
    FROM ({ALT_SQL})""")
def e16(spark, sf):
    return X.best_possible(choices(spark, sf), LABELS)


SIMPLE = """SELECT h.*, g.choice, mean_sog >= 5 AND max_dcog < 5 AS straight, max_dcog > 15 AS maneuver, NOT ((mean_sog >= 5 AND max_dcog < 5) OR max_dcog > 15) AS other
    FROM hm h JOIN gate g USING (window_id)"""


@query("e17_choice_by_bucket", "bucket:s n:i " + " ".join(f"pct_{x}:d" for x in LABELS), f"""
    SELECT v.bucket, count(*) AS n, {", ".join(f"100 * avg(CASE WHEN choice = {i} THEN 1.0 ELSE 0.0 END) AS pct_{x}" for i, x in enumerate(LABELS))}
    FROM ({SIMPLE}), (VALUES ('straight'), ('maneuver'), ('other')) v(bucket)
    WHERE CASE v.bucket WHEN 'straight' THEN straight WHEN 'maneuver' THEN maneuver ELSE other END GROUP BY v.bucket""")
def e17(spark, sf):
    return X.choice_by_bucket(M.motion_buckets(choices(spark, sf).drop("straight")), LABELS)


@query("e18_cosine_similarity", "label:i n:i mean_cosine:d", """
    SELECT label, count(*) AS n, avg(c) AS mean_cosine FROM (
        SELECT label, vec_id, sum(a * b) / greatest(sqrt(sum(a * a)) * sqrt(sum(b * b)), 1e-8::DOUBLE) AS c FROM (
            SELECT label, vec_id, embedding[i]::DOUBLE AS a, embedding[i + len(embedding) // 2]::DOUBLE AS b FROM (
                SELECT *, unnest(range(1, len(embedding) // 2 + 1)) AS i FROM embeddings)) GROUP BY label, vec_id) GROUP BY label""")
def e18(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    half = F.floor(F.size("embedding") / 2).cast("int")
    c = X.cosine(F.slice("embedding", F.lit(1), half), F.slice("embedding", half + 1, half))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean_cosine"))


@query("e19_attribution_by_hour", "hour:i score:d share:d newest_share:d oldest_share:d", """
    WITH s AS (SELECT i * 3 AS hour, sum(abs(dsog)) AS score FROM hs GROUP BY i)
    SELECT hour, score, score / t AS share, (SELECT sum(score) FROM s WHERE hour >= 21) / t AS newest_share, (SELECT sum(score) FROM s WHERE hour < 3) / t AS oldest_share
    FROM s, (SELECT sum(score) + 1e-12::DOUBLE AS t FROM s)""")
def e19(spark, sf):
    scores = _win(spark, sf).select(F.posexplode("hist").alias("step", "x")).select("step", F.abs(F.col("x.dsog").cast("double")).alias("score"))
    return X.attribution_by_hour(scores, STEP, 24)


@query("e20_history_masking", "mask:s median_fde_km:d delta_km:d", f"""
    SELECT mask, m AS median_fde_km, m - (SELECT {pct('fde_km', 0.5)} FROM ferr WHERE model = 'naive') AS delta_km FROM (
        SELECT 'base' AS mask, {pct('fde_km', 0.5)} AS m FROM ferr WHERE model = 'naive'
        UNION ALL SELECT 'oldest', {pct('fde_km', 0.5)} FROM ferr WHERE model = 'naive'
        UNION ALL SELECT 'newest', {pct('net_km', 0.5)} FROM ferr WHERE model = 'naive')""")
def e20(spark, sf):
    return E.masking_effect(A.stored_windows(spark, sf), MODELS["naive"], A.N, 1, A.H)


@query("e20_keep_newest_steps", "window_id:s kept:i lat:d", "SELECT window_id, sum(CASE WHEN i >= 5 AND lat <> 0 THEN 1 ELSE 0 END) AS kept, sum(CASE WHEN i >= 5 THEN lat ELSE 0 END) AS lat FROM hs GROUP BY window_id")
def e20_keep(spark, sf):
    m = E.mask_history(_win(spark, sf), keep_last=3)
    return m.select(
        "window_id",
        F.size(F.filter("hist", lambda p: p.lat != 0)).alias("kept"),
        F.aggregate("hist", F.lit(0.0), lambda a, p: a + p.lat).alias("lat"),
    )


@query("e21_choice_profile", "context:s n:i mean_sog:d mean_max_dcog:d mean_straightness:d pct_maneuver:d pct_straight:d median_fde_km:d never:b", f"""
    SELECT v.context, coalesce(p.n, 0) AS n, mean_sog, mean_max_dcog, mean_straightness, pct_maneuver, pct_straight, median_fde_km, p.n IS NULL AS never
    FROM {_each.replace("(3, '24h')", "(3, '24h'), (4, '48h')")} LEFT JOIN (
        SELECT choice, count(*) AS n, avg(s.mean_sog) AS mean_sog, avg(max_dcog) AS mean_max_dcog, avg(least(net / greatest(path, 1e-3::DOUBLE), 1.0::DOUBLE)) AS mean_straightness,
               100 * avg(CAST(maneuver AS DOUBLE)) AS pct_maneuver, 100 * avg(CAST(straight AS DOUBLE)) AS pct_straight, {pct('fde_km', 0.5)} AS median_fde_km
        FROM ({SIMPLE}) s JOIN ferr f ON f.window_id = s.window_id AND f.model = 'naive' GROUP BY choice) p ON p.choice = v.j""")
def e21(spark, sf):
    c = M.motion_buckets(M.descriptive_features(choices(spark, sf)).drop("mean_sog")).withColumn("fde_km", F.col("errors")[0])
    return X.choice_profile(c, [*LABELS, "48h"])


@query("e22_paired_comparison", "n:i first_better_pct:d median_difference:d", f"""
    SELECT count(*) AS n, 100 * avg(CASE WHEN a.fde_km - b.fde_km < 0 THEN 1.0 ELSE 0.0 END) AS first_better_pct, {pct('a.fde_km - b.fde_km', 0.5)} AS median_difference
    FROM ferr a JOIN ferr b ON a.window_id = b.window_id AND a.model = 'kinematic' AND b.model = 'naive'""")
def e22(spark, sf):
    return E.paired_comparison(E.final_errors(forecasts(spark, sf)), "kinematic", "naive")
