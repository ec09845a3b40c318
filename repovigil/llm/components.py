"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repovigil.session import written


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id of ``links`` (a, b): equal labels in one component.

    Every id takes the smallest id next to it, its own included, and the links between the ids so
    taken form the next, smaller table; ids should be hashes, then each round leaves a fraction of
    the ids and the number of rounds grows with their logarithm. All rounds are shuffles by id with
    map-side combining; nothing is gathered.
    """
    maps = []
    links = links.where("a <> b").select("a", "b").distinct()
    while True:
        links = written(links, "links")
        if links.isEmpty():
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(
            both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select(
                "id", F.least("id", "low").alias("label")
            ),
            "labels",
        )
        maps.append(step)
        one = step.select(F.col("id").alias("a"), F.col("label").alias("la"))
        two = step.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        links = (
            links.join(one, "a").join(two, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
            .where("a <> b").distinct()
        )
    if not maps:
        return links.select(F.col("a").alias("id"), F.col("b").alias("label"))
    out = maps[-1]
    for step in maps[-2::-1]:
        later = out.select(F.col("id").alias("label"), F.col("label").alias("last"))
        out = step.join(later, "label", "left").select("id", F.coalesce("last", "label").alias("label"))
    return written(out, "components")
