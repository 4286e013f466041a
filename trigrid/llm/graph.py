"""Connected components of a link table, by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise


def components(edges: DataFrame) -> DataFrame:
    """edges (src, dst) of any orderable type -> (node, label): label is the smallest node of the component.

    Each round points every node to its smallest neighbour, follows the pointers to their roots and contracts the
    links to links between roots. The roots at least halve in number each round, so the rounds grow with the
    logarithm of the nodes. Self-links and repeated or reversed links are harmless; nulls link nothing; a node
    without a link has no row; no links give an empty table.
    """
    links = materialise(
        edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .distinct()
    )
    labels = None
    while labels is None or not links.isEmpty():
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        up = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("up"))
        up = materialise(up.select("node", F.least("node", "up").alias("up")))
        while True:
            above = up.select(F.col("node").alias("at"), F.col("up").alias("top"))
            jumped = materialise(up.join(above, up["up"] == above["at"]).select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            up = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = up
        else:
            above = up.select(F.col("node").alias("at"), F.col("up").alias("top"))
            labels = labels.join(above, labels["up"] == above["at"], "left").select("node", F.coalesce("top", "up").alias("up"))
        one, two = (up.select(F.col("node").alias(f"n{i}"), F.col("up").alias(f"u{i}")) for i in (1, 2))
        links = materialise(
            links.join(one, links["src"] == one["n1"])
            .join(two, F.col("dst") == two["n2"])
            .where("u1 <> u2")
            .select(F.least("u1", "u2").alias("src"), F.greatest("u1", "u2").alias("dst"))
            .distinct()
        )
    return labels.select("node", F.col("up").alias("label"))
