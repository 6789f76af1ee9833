"""Connected components of an edge table, by spreading least labels and following them, all in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id and comp (the least id reachable) of each id in the edges a, b, as a table of scratch. Loops and repeated edges do no harm."""
    spark = edges.sparkSession
    with Scratch(spark) as own:
        both = own.keep(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())
        labels = own.keep(both.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("comp")))
        while True:
            near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
            new = labels.join(near, "id").select("id", F.least("comp", "near").alias("new"), "comp")
            far = labels.select(F.col("id").alias("new"), F.col("comp").alias("far"))
            new = own.keep(new.join(far, "new").select("id", F.least("new", "far").alias("new"), "comp"))
            changed = new.where("new != comp").limit(1).count()
            labels = new.select("id", F.col("new").alias("comp"))
            if not changed:
                return scratch.keep(labels)
