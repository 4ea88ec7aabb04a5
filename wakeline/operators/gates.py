"""Analysis of context weights and of choices between alternative forecasts.

Weights come as window_id and alpha ARRAY<DOUBLE>, one entry per context.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.functions.ranking import average_ranks, exact_percentiles, percentile_columns
from wakeline.functions.series import total
from wakeline.operators.motion import bucket_names
from wakeline.sources.scratch import materialize

EPS = 1e-8


def argmax(arr: Column) -> Column:
    """0-based position of the first largest entry."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def argmin(arr: Column) -> Column:
    return (F.array_position(arr, F.array_min(arr)) - 1).cast("int")


def entropy(alpha: Column) -> Column:
    return -total(alpha, lambda a: a * F.log(a + F.lit(EPS)))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    # the sum is an argument beside the lambda, so it is computed once for the vector
    sums = F.array_repeat(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), F.size(logits))
    return F.zip_with(e, sums, lambda x, s: x / s)


def label_of(labels: Sequence[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), index + 1)


def gate_summary(weights: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per context: mean and median weight, share of windows where it is largest, and which is most selected."""
    slim = materialize(weights.select("alpha", argmax(F.col("alpha")).alias("choice"), entropy(F.col("alpha")).alias("entropy")), "gate")
    tall = slim.select(F.posexplode("alpha").alias("_i", "weight"), "choice", "entropy").withColumn(
        "context", label_of(labels, F.col("_i"))
    )
    base = tall.groupBy("context", "_i").agg(
        F.avg("weight").alias("mean_weight"),
        (100 * F.avg((F.col("choice") == F.col("_i")).cast("int"))).alias("argmax_pct"),
        F.avg("entropy").alias("mean_entropy"),
    )
    med = percentile_columns(tall, ["weight"], {"median": 0.5}, ("context",), stored=True)
    first = Window.partitionBy(F.lit(1)).orderBy(F.col("argmax_pct").desc(), "_i")
    return (
        base.join(F.broadcast(med), "context")
        .withColumn("most_selected", F.row_number().over(first) == 1)
        .drop("_i")
    )


def gate_by_class(weights: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Mean weight per vessel class and context."""
    tall = weights.select("vessel_class", F.posexplode_outer("alpha").alias("_i", "weight"))
    return tall.groupBy("vessel_class", label_of(labels, F.col("_i")).alias("context")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("weight").alias("mean_weight")
    )


def quartile_profile(table: DataFrame, features: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Feature means where a weight is in its lowest or highest quartile."""
    slim = materialize(table.select(*features, *labels), "quartiles")
    cuts = {
        (r["metric"], r["p"]): r["value"]
        for r in exact_percentiles(slim, list(labels), [0.25, 0.75], stored=True).collect()
    }
    aggs = []
    for w in labels:
        for f in features:
            low = F.avg(F.when(F.col(w) <= cuts[(w, 0.25)], F.col(f)))
            high = F.avg(F.when(F.col(w) >= cuts[(w, 0.75)], F.col(f)))
            aggs.append(F.struct(F.lit(w).alias("context"), F.lit(f).alias("feature"), low.alias("low"), high.alias("high")))
    return slim.agg(F.array(*aggs).alias("_a")).select(F.inline("_a"))


def tercile_weights(table: DataFrame, feature: str, labels: Sequence[str]) -> DataFrame:
    """Mean weights in the low, middle and high part of a feature (cuts at 33 % and 66 %)."""
    slim = materialize(table.select(feature, *labels), "terciles")
    cuts = {r["p"]: r["value"] for r in exact_percentiles(slim, [feature], [0.33, 0.66], stored=True).collect()}
    part = F.when(F.col(feature) <= cuts[0.33], F.lit("low")).when(F.col(feature) <= cuts[0.66], F.lit("mid")).otherwise(F.lit("high"))
    return slim.groupBy(part.alias("motion")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(w).alias(w) for w in labels])


def spearman(table: DataFrame, features: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Rank correlation of each feature with each weight, largest absolute value first.

    Each column is ranked over the whole table with average ranks for ties. Rows with a null in a column are left
    out. All columns share one exchange (average_ranks); the correlations of all pairs are one aggregate.
    """
    columns = [*features, *labels]
    slim = table.select(*columns).na.drop().withColumn("_row", F.monotonically_increasing_id())
    # Written, so that every pass sees the same row numbers.
    ranked = average_ranks(materialize(slim, "spearman"), columns, "_row")
    pairs = [
        F.struct(F.lit(f).alias("feature"), F.lit(w).alias("context"), F.corr(f, w).alias("r"))
        for f in features
        for w in labels
    ]
    out = ranked.agg(F.array(*pairs).alias("_a")).select(F.inline("_a"))
    w = Window.partitionBy("feature")
    return out.withColumn("max_abs_r", F.max(F.abs("r")).over(w))


def forest_importance(
    table: DataFrame,
    features: Sequence[str],
    labels: Sequence[str],
    *,
    trees: int = 100,
    depth: int = 8,
    min_leaf: int = 40,
    seed: int = 42,
) -> DataFrame:
    """Importance of each feature for each weight from a random forest per weight, all grown together (forest)."""
    from wakeline.operators.forest import importances

    found = importances(table, features, labels, trees=trees, depth=depth, min_leaf=min_leaf, seed=seed)
    rows = [(w, f, float(v)) for w, shares in zip(labels, found) for f, v in zip(features, shares)]
    return table.sparkSession.createDataFrame(rows, "context string, feature string, importance double")


def best_possible(choices: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Against the best of k alternatives per window: its median error, who gives it, who was chosen.

    choices: errors ARRAY<DOUBLE> (one per alternative) and choice INT.
    """
    slim = materialize(
        choices.select(F.array_min("errors").alias("best_km"), argmin(F.col("errors")).alias("best"), "choice"), "best"
    )
    shares = slim.agg(
        F.count(F.lit(1)).alias("n"),
        (100 * F.avg((F.col("best") == F.col("choice")).cast("int"))).alias("match_pct"),
        *[(100 * F.avg((F.col("best") == i).cast("int"))).alias(f"best_pct_{x}") for i, x in enumerate(labels)],
        *[(100 * F.avg((F.col("choice") == i).cast("int"))).alias(f"chosen_pct_{x}") for i, x in enumerate(labels)],
    )
    med = percentile_columns(slim, ["best_km"], {"median": 0.5}, stored=True)
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(shares).join(F.broadcast(one(med)), "_k").drop("_k")


def simple_buckets(df: DataFrame) -> DataFrame:
    """straight / maneuver / other where straight does not exclude anchored windows."""
    straight = (F.col("mean_sog") >= 5) & (F.col("max_dcog") < 5)
    turning = F.col("max_dcog") > 15
    return (
        df.withColumn("straight", straight)
        .withColumn("maneuver", turning)
        .withColumn("anchored", F.lit(False))
        .withColumn("other", ~(straight | turning))
    )


def choice_by_bucket(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Percent of the windows of a bucket that chose each context."""
    tall = simple_buckets(df).select(F.explode(bucket_names()).alias("bucket"), label_of(labels, F.col("choice")).alias("context"))
    n = F.count(F.lit(1))
    return tall.groupBy("bucket").agg(
        n.alias("n"),
        *[(100 * F.sum((F.col("context") == x).cast("int")) / n).alias(f"pct_{x}") for x in labels],
    )


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(total(v, lambda x: x.cast("double") * x.cast("double")))
    return F.try_divide(dot, F.greatest(norm(a) * norm(b), F.lit(EPS)))


def attribution_by_hour(scores: DataFrame, step_minutes: float, hours: int, tail_hours: int = 3) -> DataFrame:
    """Share of the score per history hour (oldest first), and of the newest and oldest hours.

    scores: step INT (0 = oldest) and score DOUBLE.
    """
    hour = F.least(F.floor(F.col("step") * F.lit(step_minutes) / F.lit(60.0)), F.lit(hours - 1)).cast("int")
    per_hour = scores.groupBy(hour.alias("hour")).agg(F.sum("score").alias("score"))
    whole = Window.partitionBy(F.lit(1))
    all_of_it = F.sum("score").over(whole) + F.lit(1e-12)
    newest = F.sum(F.when(F.col("hour") >= max(0, hours - tail_hours), F.col("score")).otherwise(0.0)).over(whole)
    oldest = F.sum(F.when(F.col("hour") < min(tail_hours, hours), F.col("score")).otherwise(0.0)).over(whole)
    return per_hour.select(
        "hour",
        "score",
        (F.col("score") / all_of_it).alias("share"),
        (newest / all_of_it).alias("newest_share"),
        (oldest / all_of_it).alias("oldest_share"),
    )


def choice_profile(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Motion and error per chosen context; contexts never chosen are listed with n = 0."""
    named = simple_buckets(df).withColumn("context", label_of(labels, F.col("choice")))
    slim = materialize(
        named.select("context", "mean_sog", "max_dcog", "straightness", "maneuver", "straight", "fde_km"), "profile"
    )
    base = slim.groupBy("context").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("mean_sog").alias("mean_sog"),
        F.avg("max_dcog").alias("mean_max_dcog"),
        F.avg("straightness").alias("mean_straightness"),
        (100 * F.avg(F.col("maneuver").cast("int"))).alias("pct_maneuver"),
        (100 * F.avg(F.col("straight").cast("int"))).alias("pct_straight"),
    )
    med = percentile_columns(slim, ["fde_km"], {"median": 0.5}, ("context",), stored=True)
    listed = df.sparkSession.createDataFrame([(x,) for x in labels], "context string")
    return (
        listed.join(base, "context", "left")
        .join(med, "context", "left")
        .withColumn("never", F.col("n").isNull())
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )
