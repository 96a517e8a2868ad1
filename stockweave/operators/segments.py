"""Outlet segmentation with k-means."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import first_rule, require_columns, to_number
from ..plans.lineage import cut
from ..plans.quantiles import exact_quantiles

FEATURES = ("average_daily_demand", "coefficient_variation", "peak_intensity", "demand_growth_rate", "fulfillment_rate",
            "lost_demand_rate", "stockout_product_day_rate", "performance_score", "opportunity_index", "risk_index")
PARALLEL_STARTS = 8


def clustering_matrix(performance: DataFrame) -> DataFrame:
    """Standardised features (population deviation) as columns z_* and as a vector."""
    require_columns(performance, ["outlet_id", *FEATURES], "performance")
    df = cut(performance.withColumns({c: F.coalesce(to_number(c), F.lit(0.0)) for c in FEATURES}))
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in FEATURES for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
    z = {f"z_{c}": (F.col(c) - F.lit(stats[f"mean_{c}"])) / F.lit(stats[f"std_{c}"] or 1.0) for c in FEATURES}
    return VectorAssembler(inputCols=list(z), outputCol="features").transform(df.withColumns(z))


def evaluate_kmeans(matrix: DataFrame, min_clusters: int = 2, max_clusters: int = 8, restarts: int = 20) -> list[dict]:
    """Best of several starts for every k, with its silhouette, best first."""
    outlets = matrix.count()
    if outlets < 3:
        raise ValueError("clustering needs at least 3 outlets")
    top = min(max_clusters, outlets - 1)
    if min_clusters > top:
        raise ValueError("min_clusters is larger than the number of outlets allows")
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster_id")

    def start(at: tuple[int, int]):
        k, i = at
        return KMeans(k=k, seed=42 + i, featuresCol="features", predictionCol="cluster_id").fit(matrix)

    tries = [(k, i) for k in range(min_clusters, top + 1) for i in range(restarts)]
    with ThreadPool(PARALLEL_STARTS) as pool:  # as Spark's own parameter search does: small independent jobs
        fits = pool.map(inheritable_thread_target(matrix.sparkSession)(start), tries)
    found = []
    for k in range(min_clusters, top + 1):
        best = min((m for (at, _), m in zip(tries, fits) if at == k), key=lambda m: m.summary.trainingCost)
        sizes = best.summary.clusterSizes
        if len([s for s in sizes if s]) < 2:
            continue
        found.append({"n_clusters": k, "silhouette_score": judge.evaluate(best.transform(matrix)),
                      "min_cluster_size": min(sizes), "max_cluster_size": max(sizes), "model": best})
    return sorted(found, key=lambda r: -r["silhouette_score"])


def fit_clusters(performance: DataFrame, min_clusters: int = 2, max_clusters: int = 8, restarts: int = 20) -> DataFrame:
    """Outlets with cluster_id and cluster_size for the k of the best silhouette."""
    matrix = cut(clustering_matrix(performance))
    best = evaluate_kmeans(matrix, min_clusters, max_clusters, restarts)[0]["model"]
    labelled = best.transform(matrix).select("outlet_id", "cluster_id", *FEATURES)
    # Sizes are counted by grouping (k rows) and joined back, not by a window per cluster.
    sizes = labelled.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return labelled.join(F.broadcast(sizes), "cluster_id")


def cluster_profiles(clustered: DataFrame) -> DataFrame:
    """Mean features, classes and a segment name per cluster (k rows)."""
    profiles = cut(clustered.groupBy("cluster_id").agg(
        *[F.avg(c).alias(c) for c in FEATURES], F.count(F.lit(1)).alias("outlet_count")))
    (middle,) = exact_quantiles(profiles, "average_daily_demand", [0.5])
    growth, cv, filled, chance, risk = (F.col(c) for c in (
        "demand_growth_rate", "coefficient_variation", "fulfillment_rate", "opportunity_index", "risk_index"))
    profiles = profiles.withColumns({
        "demand_scale": F.col("average_daily_demand") / F.nullif(F.lit(middle), F.lit(0.0)),
        "growth_class": first_rule([(growth >= 0.10, "growing"), (growth <= -0.10, "declining")], "stable"),
        "volatility_class": first_rule([(cv >= 0.30, "high"), (cv >= 0.15, "moderate")], "low"),
        "fulfillment_class": first_rule([(filled >= 0.97, "strong"), (filled >= 0.90, "moderate")], "weak"),
        "opportunity_class": first_rule([(chance >= 75, "high"), (chance >= 45, "moderate")], "low"),
        "risk_class": first_rule([(risk >= 75, "high"), (risk >= 45, "moderate")], "low"),
    })
    return profiles.withColumn("segment_name", segment_name())


def segment_name():
    growth, spread, filled, chance, risk = (F.col(f"{c}_class") for c in (
        "growth", "volatility", "fulfillment", "opportunity", "risk"))
    return first_rule([
        ((risk == "high") & (chance == "high"), "high_opportunity_high_risk"),
        ((filled == "strong") & (risk == "low"), "high_performing_stable"),
        ((growth == "growing") & chance.isin("moderate", "high"), "growing_opportunity"),
        (spread == "high", "volatile_demand"),
        (risk == "high", "operational_risk"),
        (chance == "high", "high_opportunity"),
        (growth == "declining", "declining_demand"),
    ], "balanced")


def outlet_segments(performance: DataFrame, min_clusters: int = 2, max_clusters: int = 8, restarts: int = 20) -> DataFrame:
    clustered = cut(fit_clusters(performance, min_clusters, max_clusters, restarts))
    names = cluster_profiles(clustered).select("cluster_id", "segment_name")
    return clustered.join(F.broadcast(names), "cluster_id")
