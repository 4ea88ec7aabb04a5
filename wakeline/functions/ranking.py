"""Exact ranks, cuts and percentiles that never gather a whole table in one task.

Random choices use the order of md5(seed | key). The order is the same on every
engine and on every retry, and its prefixes are uniform, so 4096 prefix buckets
split any number of keys evenly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.sources.scratch import materialize

PREFIX_LEN = 3  # 16**3 = 4096 buckets, a fixed bound
PAST_EVERY_HASH = "g"  # sorts after any hex digest
#: Cells of percentiles: for each factor of e, and in a cell that is divided.
LEADING_CELLS, EQUAL_CELLS = 256, 1 << 20
ORDER_BUCKETS = 128


def seeded_hash(seed: int | str, *keys) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in keys]))


def _prefix_offsets(keyed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows before each hash bucket, per stratum: at most 4096 rows a stratum."""
    counts = keyed.groupBy(*by, F.substring("_h", 1, PREFIX_LEN).alias("_b")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    w = Window.partitionBy(*by, F.lit(0)).orderBy("_b")
    return counts.withColumn("_before", F.sum("_c").over(w) - F.col("_c"))


def hash_rank(df: DataFrame, keys: Sequence[str], seed: int, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """1-based position of each row in seeded hash order, overall or per fixed stratum.

    `by` must be a column with few values (a flag or a bucket name): the offsets
    table then has a fixed size and is broadcast.
    """
    keyed = df.withColumn("_h", seeded_hash(seed, *keys)).withColumn(
        "_b", F.substring("_h", 1, PREFIX_LEN)
    )
    offsets = _prefix_offsets(keyed.select(*by, "_h"), by).drop("_c")
    inside = Window.partitionBy(*by, "_b").orderBy("_h", *keys)
    return (
        keyed.withColumn("_r", F.row_number().over(inside))
        .join(F.broadcast(offsets), [*by, "_b"])
        .withColumn(name, F.col("_before") + F.col("_r"))
        .drop("_h", "_b", "_r", "_before")
    )


def hash_cut(hashes: DataFrame, k: Column | int) -> Column:
    """The k-th smallest hash in column `_h`, as a scalar subquery to compare with.

    k may itself be a scalar subquery. Below 1 the cut is '' (nothing is chosen);
    past the end it sorts after every hash (everything is chosen). Choosing rows by
    `hash <= cut` needs no join, so the rows themselves are not shuffled.
    """
    k = k if isinstance(k, Column) else F.lit(int(k))
    counts = _prefix_offsets(hashes, [])
    target = counts.filter((F.col("_before") < k) & (k <= F.col("_before") + F.col("_c"))).select(
        "_b", (k - F.col("_before")).alias("_need")
    )
    inside = Window.partitionBy("_b").orderBy("_h")
    found = (
        hashes.withColumn("_b", F.substring("_h", 1, PREFIX_LEN))
        .join(F.broadcast(target), "_b")
        .withColumn("_r", F.row_number().over(inside))
        .filter(F.col("_r") == F.col("_need"))
        .agg(F.max("_h"))
    )
    return F.when(k < 1, F.lit("")).otherwise(F.coalesce(found.scalar(), F.lit(PAST_EVERY_HASH)))


def _edges(stored: DataFrame, values: Sequence[str]) -> dict[str, list[float]]:
    """Bucket edges of each column from a quantile sketch: one bounded row."""
    probs = [i / ORDER_BUCKETS for i in range(ORDER_BUCKETS + 1)]
    row = stored.agg(*[F.percentile_approx(v, probs, 10 * ORDER_BUCKETS).alias(v) for v in values]).first()
    return {v: sorted({float(x) for x in row[v] or []}) for v in values}


def _bucket_case(value: str, edges: list[float], lo: int, hi: int) -> str:
    """SQL text of a binary search: twice the number of edges below the value, plus 1 on an edge."""
    if lo == hi:
        on_edge = f"CASE WHEN `{value}` = CAST('{edges[lo]!r}' AS DOUBLE) THEN {2 * lo + 1} ELSE {2 * lo} END"
        return on_edge if lo < len(edges) else str(2 * lo)
    mid = (lo + hi) // 2
    left, right = _bucket_case(value, edges, lo, mid), _bucket_case(value, edges, mid + 1, hi)
    return f"CASE WHEN `{value}` <= CAST('{edges[mid]!r}' AS DOUBLE) THEN {left} ELSE {right} END"


def _bucketed(df: DataFrame, value: str, keys: Sequence[str], seed: int, edges: list[float]) -> DataFrame:
    """Adds the bucket of a value (odd = equal to an edge) and, on edges, a hash prefix."""
    return (
        df.withColumn("_h", seeded_hash(seed, *keys))
        .withColumn("_bk", F.expr(_bucket_case(value, [*edges, float("inf")], 0, len(edges))))
        .withColumn("_sub", F.when(F.col("_bk") % 2 == 1, F.substring("_h", 1, 2)).otherwise(F.lit("")))
    )


def ordered_ranks(stored: DataFrame, values: Sequence[str], keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Exact global positions by (value, hash of keys) for each column, and average ranks of ties.

    stored must be a written table without nulls in `values`. A quantile sketch
    gives bucket edges. A value that holds more than one bucket's share of rows is
    itself an edge, and such a tie is split further by hash prefix, so no bucket
    grows with one hot value. Adds <value>_rank (1-based) and <value>_rank_avg; each
    column costs one shuffle of the rows by bucket.
    """
    edges = _edges(stored, values)
    out = stored
    for value in values:
        counts = _bucketed(stored.select(value, *[k for k in keys if k != value]), value, keys, seed, edges[value])
        counts = counts.groupBy("_bk", "_sub").agg(F.count(F.lit(1)).alias("_c"))
        whole = Window.partitionBy(F.lit(0)).orderBy("_bk", "_sub")
        per_bucket = Window.partitionBy("_bk")
        offsets = (
            counts.withColumn("_before", F.sum("_c").over(whole) - F.col("_c"))
            .withColumn("_first", F.min("_before").over(per_bucket))
            .withColumn("_in_bucket", F.sum("_c").over(per_bucket))
            .drop("_c")
        )
        inside = Window.partitionBy("_bk", "_sub").orderBy(value, "_h", *keys)
        ties = Window.partitionBy("_bk", "_sub", value)
        lowest = Window.partitionBy("_bk", "_sub").orderBy(value)
        tie_average = F.when(
            F.col("_bk") % 2 == 1, F.col("_first") + (F.col("_in_bucket") + 1) / 2
        ).otherwise(F.col("_before") + F.col("_lo") + (F.col("_ties") - 1) / 2)
        out = (
            _bucketed(out, value, keys, seed, edges[value])
            .withColumn("_r", F.row_number().over(inside))
            .withColumn("_lo", F.rank().over(lowest))
            .withColumn("_ties", F.count(F.lit(1)).over(ties))
            .join(F.broadcast(offsets), ["_bk", "_sub"])
            .withColumn(f"{value}_rank", F.col("_before") + F.col("_r"))
            .withColumn(f"{value}_rank_avg", tie_average)
            .drop("_h", "_bk", "_sub", "_r", "_lo", "_ties", "_before", "_first", "_in_bucket")
        )
    return out


def ordered_rank(df: DataFrame, value: str, keys: Sequence[str], seed: int = 0, name: str = "rank") -> DataFrame:
    """ordered_ranks of one column of any frame, as `name` and `name`_avg; rows with a null value are dropped."""
    stored = materialize(df.filter(F.col(value).isNotNull()), "ordered")
    return ordered_ranks(stored, [value], keys, seed).withColumnsRenamed(
        {f"{value}_rank": name, f"{value}_rank_avg": f"{name}_avg"}
    )


def average_ranks(stored: DataFrame, values: Sequence[str], row: str) -> DataFrame:
    """Exact average ranks (from 1, ties share their mean) of several columns, in columns of the same names.

    stored must be a written table without nulls in `values`, and `row` a column that tells its rows apart.
    All columns are ranked in one exchange: each row becomes one slim entry per column, dealt by column and
    bucket of a quantile sketch; a second exchange brings the ranks of a row together. A value that holds more
    than a bucket's share of rows is an edge: its rank follows from counts alone, so its entries are spread by
    hash and not ordered. What is broadcast is a count per column and bucket.
    """
    edges = _edges(stored, values)
    entries = [
        F.struct(
            F.lit(i).alias("column"),
            F.col(v).cast("double").alias("v"),
            F.expr(_bucket_case(v, [*edges[v], float("inf")], 0, len(edges[v]))).alias("bucket"),
        )
        for i, v in enumerate(values)
    ]
    tall = stored.select(F.col(row).alias("row"), F.inline(F.array(*entries)))
    on_edge = F.col("bucket") % 2 == 1
    counts = tall.groupBy("column", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.withColumn("before", F.sum("n").over(Window.partitionBy("column").orderBy("bucket")) - F.col("n"))
    dealt = tall.withColumn("part", F.when(on_edge, F.pmod(F.xxhash64("row"), F.lit(256))).otherwise(F.lit(0)))
    bucket = ["column", "bucket", "part"]
    ranked = (
        dealt.withColumn("lowest", F.rank().over(Window.partitionBy(*bucket).orderBy("v")))
        .withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy(*bucket, "v")))
        .join(F.broadcast(offsets), ["column", "bucket"])
    )
    average = F.col("before") + F.when(on_edge, (F.col("n") + 1) / 2).otherwise(F.col("lowest") + (F.col("ties") - 1) / 2)
    return (
        ranked.groupBy("row")
        .agg(*[F.max(F.when(F.col("column") == i, average)).alias(v) for i, v in enumerate(values)])
        .withColumnRenamed("row", row)
    )


def exact_percentiles(
    df: DataFrame,
    values: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    stored: bool = False,
) -> DataFrame:
    """Exact linear-interpolated percentiles as rows (by..., metric, p, n, value), of groups of any size.

    `by` must name a fixed set of groups (model, step, bucket). Radix selection in one lazy plan: values are
    counted by sign and leading digits, 256 cells for each factor of e; the cells that hold a wanted rank are
    counted again in 2^20 equal cells between their least and largest value, and what is left is counted per
    distinct value. Each pass shuffles counts only, and reads the rows of the wanted cells only; what is
    broadcast is at most two cells per group and percentile. Nulls and NaN are left out.
    `stored` tells that df is cheap to read again; otherwise its columns are written first.
    """
    entries = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in values]
    slim = df.select(*by, *values) if stored else materialize(df.select(*by, *values), "percentiles")
    tall = (
        slim.select(*by, F.inline(F.array(*entries)))
        .filter(F.col("v").isNotNull() & ~F.isnan("v"))
    )
    group = [*by, "metric"]
    position = lambda p, n: F.lit(float(p)) * (n - 1)
    ranks = F.array(*[edge(position(p, F.col("total"))) for p in probs for edge in (F.floor, F.ceil)])

    digits = F.struct(F.signum("v"), F.floor(F.ln(F.abs("v")) * F.lit(LEADING_CELLS)))
    leading = (
        _cell_counts(tall.withColumns({"above": F.lit(0), "under": F.lit(0).cast("long")}), [*group, "above", "under"], digits)
        .withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
        .withColumn("ranks", F.array_distinct(ranks))
    )
    held = [*group, "total", "ranks", "above", "under"]
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    equal_cells = F.when(F.col("hi") > F.col("lo"), F.floor(share * F.lit(EQUAL_CELLS))).otherwise(F.lit(0))
    middle = _cell_counts(_rows_of_cells(tall, _wanted(leading, group), group), held, equal_cells)
    last = _wanted(_cell_counts(_rows_of_cells(tall, _wanted(middle, group), group), held, F.col("v")), group)

    holds = lambda k: (F.col("under") <= k) & (k < F.col("under") + F.col("n"))
    wanted = last.select(
        *group, "lo", "under", "n", "total", F.explode(F.array_distinct(F.array(*[F.lit(float(p)) for p in probs]))).alias("p")
    )
    pos = F.col("p") * (F.col("total") - 1)
    first = F.max(F.when(holds(F.floor(pos)), F.col("lo")))
    second = F.max(F.when(holds(F.ceil(pos)), F.col("lo")))
    frac = pos - F.floor(pos)
    between = F.when(frac == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * frac)
    found = wanted.groupBy(*group, "total", "p").agg(first.alias("_a"), second.alias("_b"))
    return found.select(*group, "p", F.col("total").alias("n"), between.alias("value"))


def _cell_counts(rows: DataFrame, held: list[str], cell: Column) -> DataFrame:
    """(held..., n, lo, hi): rows of each cell, its least and largest value, and in `under` the rows below it.

    `under` comes in as the rows below the cell that is divided, whose least value is `above`.
    """
    counts = rows.groupBy(*held, cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    whole = [c for c in held if c not in ("under", "total", "ranks")]
    below = Window.partitionBy(*whole).orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("under", F.col("under") + F.sum("n").over(below) - F.col("n")).drop("cell")


def _wanted(cells: DataFrame, group: list[str]) -> DataFrame:
    """The cells that hold a wanted rank."""
    held = F.exists("ranks", lambda k: (F.col("under") <= k) & (k < F.col("under") + F.col("n")))
    return cells.filter(held).select(*group, "total", "ranks", "under", "n", "lo", "hi", F.col("lo").alias("above"))


def _rows_of_cells(tall: DataFrame, cells: DataFrame, group: list[str]) -> DataFrame:
    """Rows of tall in one of the cells, with that cell; cells do not overlap."""
    named = cells.drop("n").withColumnsRenamed({g: f"_{g}" for g in group})
    same = F.col("v").between(F.col("lo"), F.col("hi"))
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return tall.join(F.broadcast(named), same).drop(*[f"_{g}" for g in group])


def percentile_columns(
    df: DataFrame, values: Sequence[str], probs: dict[str, float], by: Sequence[str] = (), **kw
) -> DataFrame:
    """exact_percentiles pivoted to columns named <prefix>_<value>, one row per group."""
    tall = exact_percentiles(df, values, sorted(set(probs.values())), by, **kw)
    cols = [
        F.max(F.when((F.col("metric") == v) & (F.col("p") == float(p)), F.col("value"))).alias(f"{name}_{v}")
        for v in values
        for name, p in probs.items()
    ]
    return tall.groupBy(*by).agg(*cols)
