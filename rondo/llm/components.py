"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondo.session import persist_table


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has a link; ``links`` has columns a and b of one ordered type.

    Labels spread along links and then jump to their label's label, so a round shortens every chain by more than half; the loop
    ends when a round changes nothing. Every round is written to the shared folder, and only the number of changes reaches the driver.
    NULL ends are no nodes; self links and repeated links change nothing; no links give an empty table. Columns: node, component.
    """
    ends = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    edges = persist_table(ends.select("a", "b").union(ends.select("b", "a")).distinct())
    labels = persist_table(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"), F.lit(True).alias("changed")))
    while labels.filter("changed").limit(1).count():
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("component", "near").alias("label"), F.col("component").alias("before"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        after = F.least("label", F.coalesce("further", "label"))
        labels = persist_table(spread.join(jump, "label", "left").select("node", after.alias("component"), (after != F.col("before")).alias("changed")))
    return labels.select("node", "component")
