"""Agreement between two clusterings.  Members are ``cluster, ord, id`` with the clusters' order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import overlaps


def claims(true: DataFrame, query: DataFrame) -> DataFrame:
    """``query, true, n``: the true cluster that each query cluster claims, null and 0 if none.

    Query clusters go in order; each takes the unclaimed true cluster with the largest
    overlap, the first of equals.  The order makes this one walk over the overlaps (not
    the members) of each connected group of clusters, which is one pandas group.
    """
    from graphloom.operators.components import connected_components

    shared = overlaps(query.select("cluster", "id"), true.select("cluster", "id"))
    order_q = query.select(F.col("cluster").alias("left_cluster"), F.col("ord").alias("q")).distinct()
    order_t = true.select(F.col("cluster").alias("right_cluster"), F.col("ord").alias("t")).distinct()
    rows = shared.join(order_q, "left_cluster").join(order_t, "right_cluster")
    # query and true clusters as even and odd nodes: claims in one component don't touch another
    parts = connected_components(rows.select((F.col("q") * 2).alias("a"), (F.col("t") * 2 + 1).alias("b")))
    keyed = rows.join(parts.select((F.col("id") / 2).cast("long").alias("q"), (F.col("id") % 2).alias("side"), "component").filter("side = 0"), "q")
    kind_q, kind_t = query.schema["cluster"].dataType.simpleString(), true.schema["cluster"].dataType.simpleString()

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for _, one in pdf.sort_values(["q", "n", "t"], ascending=[True, False, True]).groupby("q", sort=True):
            free = one[~one["t"].isin(taken)]
            if len(free):
                best = free.iloc[0]
                taken.add(best["t"])
                out.append((best["left_cluster"], best["right_cluster"], best["n"]))
        return pd.DataFrame(out, columns=["query", "true", "n"])

    won = keyed.groupBy("component").applyInPandas(walk, f"query {kind_q}, true {kind_t}, n long")
    everyone = query.select(F.col("cluster").alias("query")).distinct()
    return everyone.join(won, "query", "left").select("query", "true", F.coalesce("n", F.lit(0)).alias("n"))


def agreement(true: DataFrame, query: DataFrame) -> DataFrame:
    """One row: ``precision, recall, accuracy, tn_rate``, weighted by the share of ids in each query cluster."""
    sizes = lambda m, name: m.groupBy(F.col("cluster").alias(name)).agg(F.count("*").alias(f"{name}_size"))
    total = true.agg(F.count("*").alias("total")).withColumn("_1", F.lit(1))
    rows = claims(true, query).join(sizes(query, "query"), "query").join(sizes(true, "true"), "true", "left").withColumn("_1", F.lit(1))
    rows = rows.join(F.broadcast(total), "_1")
    tp, size = F.col("n"), F.col("query_size")
    fp, fn = size - tp, F.coalesce(F.col("true_size") - tp, F.lit(0))
    tn = F.col("total") - tp - fp - fn
    weight = size / F.col("total")
    return rows.agg(
        F.sum(weight * tp / size).alias("precision"), F.sum(weight * F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))).alias("recall"),
        F.sum(weight * (tp + tn) / F.col("total")).alias("accuracy"), F.sum(weight * F.coalesce(F.try_divide(tn, tn + fp), F.lit(0.0))).alias("tn_rate"),
    )
