"""Reports over search results: overlap with ground truth, rank correlation, interpolation, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(hits: DataFrame, truth: DataFrame, limit: int, id_col: str = "id") -> DataFrame:
    """(query_id, overlap) of each query of the truth: the share of its first `limit` ids that the hits have."""
    both = truth.select("query_id", id_col).join(hits.select("query_id", id_col).distinct(), ["query_id", id_col])
    n = both.groupBy("query_id").agg(F.count("*").alias("n"))
    asked = truth.select("query_id").distinct()
    return asked.join(n, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / limit).alias("overlap"))


def overlap_summary(overlap: DataFrame) -> DataFrame:
    """(mean, min, p01, p05, p50, p95, p99, perfect): quantiles are interpolated."""
    q = [F.percentile("overlap", F.lit(p)).alias(f"p{round(100 * p):02d}") for p in (0.01, 0.05, 0.5, 0.95, 0.99)]
    return overlap.agg(F.avg("overlap").alias("mean"), F.min("overlap").alias("min"), *q, F.count_if(F.col("overlap") == 1).alias("perfect"))


def coordinate_sums(vectors: DataFrame, other: DataFrame, vector_col: str = "vector", other_col: str = "vector") -> DataFrame:
    """(max_absolute, max_relative): how far the sums of the two tables' dimensions differ."""
    total = lambda df, c, name: df.select(F.posexplode(c).alias("dim", "x")).groupBy("dim").agg(F.sum(F.col("x").cast("double")).alias(name))
    both = total(vectors, vector_col, "a").join(total(other, other_col, "b"), "dim", "full_outer")
    apart = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return both.agg(F.max(apart).alias("max_absolute"), F.max(F.when(F.abs("a") > 0, apart / F.abs("a"))).alias("max_relative"))


def spearman(rows: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    """(group..., rho): Pearson correlation of average ranks; 0 for fewer than two rows or without variance."""
    by = group or []
    ranks = rows.select(*by, *[_average_rank(c, by).alias(f"__{k}") for k, c in enumerate((x, y))])
    rho = F.when((F.count("*") < 2) | (F.var_pop("__0") == 0) | (F.var_pop("__1") == 0), F.lit(0.0)).otherwise(F.covar_pop("__0", "__1") / (F.stddev_pop("__0") * F.stddev_pop("__1")))
    return ranks.groupBy(*by).agg(rho.alias("rho"))


def _average_rank(c: str, by: list[str]) -> Column:
    return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2


def lower_percentile(rows: DataFrame, value: str, q: float, group: list[str] | None = None) -> DataFrame:
    """(group..., value): of n sorted values that at floor(q * (n - 1)), by a count of equal values, not a list."""
    return _percentile(rows, value, F.floor(q * (F.col("__rows") - 1)) + 1, group)


def nearest_rank(rows: DataFrame, value: str, p: float, group: list[str] | None = None) -> DataFrame:
    """(group..., value): of n sorted values that at rank max(1, ceil(p * n))."""
    return _percentile(rows, value, F.least(F.greatest(F.lit(1), F.ceil(p * F.col("__rows"))), F.col("__rows")), group)


def _percentile(rows: DataFrame, value: str, rank: Column, group: list[str] | None) -> DataFrame:
    by = group or []
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    counted = counted.withColumn("__upto", F.sum("__n").over(w.orderBy(value))).withColumn("__rows", F.sum("__n").over(w))
    return counted.groupBy(*by).agg(F.min(F.when(F.col("__upto") >= rank, F.col(value))).alias(value))


def edge_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """(jaccard): shared edges of two graphs (src, dst) over all edges of either; 1 if neither has any."""
    left = a.select("src", "dst").distinct().withColumn("__a", F.lit(1))
    both = left.join(b.select("src", "dst").distinct().withColumn("__b", F.lit(1)), ["src", "dst"], "full_outer")
    shared = F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull())
    return both.agg(F.when(F.count("*") == 0, F.lit(1.0)).otherwise(shared / F.count("*")).alias("jaccard"))


def topm_overlap(rows: DataFrame, group: str, index: str, a: str, b: str, m: int) -> DataFrame:
    """(group, overlap): shared members of the m smallest by a and by b, over m; ties to the smaller index."""
    top = lambda v, name: F.row_number().over(Window.partitionBy(group).orderBy(v, index)).alias(name)
    placed = rows.select(group, index, top(a, "__a"), top(b, "__b"))
    return placed.groupBy(group).agg((F.count_if((F.col("__a") <= m) & (F.col("__b") <= m)) / m).alias("overlap"))


def interpolated(curve: DataFrame, targets: list[float], x: str = "recall", y: str = "qps", group: list[str] | None = None) -> DataFrame:
    """(group..., target, y): y where x reaches each target, on the line between the points around it."""
    by = group or []
    w = Window.partitionBy(*by).orderBy(x, y)
    segments = curve.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1")).where("x1 IS NOT NULL")
    wanted = segments.select("*", F.explode(F.array(*map(F.lit, targets))).alias("target")).where("target BETWEEN x0 AND x1")
    value = F.when(F.col("x1") == F.col("x0"), F.greatest("y0", "y1")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("target") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return wanted.groupBy(*by, "target").agg(F.max(value).alias(y))


def geometric_mean(rows: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(group or [])).agg(F.exp(F.avg(F.log(value))).alias("geomean"))


def balanced(rows: DataFrame, value: str, order: str, group: list[str]) -> DataFrame:
    """(group..., balanced): the geometric mean of the medians of each order of runs."""
    medians = rows.groupBy(*group, order).agg(F.percentile(value, F.lit(0.5)).alias("__m"))
    return medians.groupBy(*group).agg(F.exp(F.avg(F.log("__m"))).alias("balanced"))


def pareto_pairs(runs: DataFrame, recall_within: float = 0.003, qps_within: float = 0.05, recall_gain: float = 0.001, qps_gain: float = 0.02) -> DataFrame:
    """(ef, a, b, recall_diff, qps_diff, alike, dominates): each pair of combos at the same ef, a before b by name.

    runs: combo, ef, recall, qps, one row a combo and ef.
    """
    a = runs.select("ef", F.col("combo").alias("a"), F.col("recall").alias("ra"), F.col("qps").alias("qa"))
    b = runs.select("ef", F.col("combo").alias("b"), F.col("recall").alias("rb"), F.col("qps").alias("qb"))
    pairs = a.join(b, "ef").where("a < b")
    recall_diff, qps_diff = F.abs(F.col("ra") - F.col("rb")), F.abs(F.col("qa") - F.col("qb")) / F.greatest("qa", "qb")
    over = lambda r0, q0, r1, q1: (F.col(r0) >= F.col(r1) + recall_gain) & (F.col(q0) >= F.col(q1) * (1 + qps_gain))
    alike = (recall_diff <= recall_within) & (qps_diff <= qps_within)
    dominates = F.when(over("ra", "qa", "rb", "qb"), F.col("a")).when(over("rb", "qb", "ra", "qa"), F.col("b"))
    return pairs.select("ef", "a", "b", recall_diff.alias("recall_diff"), qps_diff.alias("qps_diff"), alike.alias("alike"), dominates.alias("dominates"))


def query_groups(truth: DataFrame, first_new: int, threshold: float = 0.5, top: int = 10, id_col: str = "id") -> DataFrame:
    """(query_id, new_share, kind): old, mixed or new by the share of new ids among a query's first `top` true ones."""
    share = F.avg((F.col(id_col) >= first_new).cast("int"))
    rows = truth.where(F.col("rank") <= top).groupBy("query_id").agg(share.alias("new_share"))
    return rows.withColumn("kind", F.when(F.col("new_share") == 0, "old").when(F.col("new_share") >= threshold, "new").otherwise("mixed"))


def nearest_mean_distance(truth: DataFrame, id_col: str = "id", without_self: bool = True) -> DataFrame:
    """(mean_distance): the mean over queries of the distance of the nearest row, by default other than itself."""
    rows = truth.where(F.col(id_col) != F.col("query_id")) if without_self else truth
    return rows.groupBy("query_id").agg(F.min("distance").alias("d")).agg(F.avg(F.col("d").cast("double")).alias("mean_distance"))


def sampled_rows(rows: DataFrame, ratio: float, at_least: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """max(ratio * n, at_least) rows, those of smallest hash, so that reruns agree."""
    n = max(int(rows.count() * ratio), at_least)
    return rows.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(n)
