"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: Links of one task: a round over few links is one task and shuffles nothing, one over many is dealt out.
PER_TASK = 100_000


def _least(links: DataFrame, tables: Tables, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Each link with the least node that its first node is linked to, itself included; and the table of these.

    The minima are written first: a join whose sides are both plain shuffles
    is one that Spark splits where a node is hot. It is a merge join even where
    the minima are few, so that no round sends a table through the driver.
    """
    links = links.coalesce(tasks)
    least = tables.write(links.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u"), F.least("u", "low").alias("low")).coalesce(tasks))
    return links.join(least.coalesce(tasks).hint("merge"), "u").coalesce(tasks), least


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node that has a link; the component is its smallest node.

    Links live in tables throughout; the driver sees one sum per round. The
    star of a hot node is formed by a combined minimum and a join that Spark
    may split, never by gathering its links. Rounds grow with the logarithm of
    the longest chain. Links of a node to itself and repeated links do no harm.
    A round's tables are dropped when the next one's are written, and a round
    has as many tasks as its links fill, so that few links cost little.
    """
    tables = Tables(links.sparkSession, "links")
    links = tables.write(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    rows, before = links.count(), None
    while True:
        tasks = 1 + rows // PER_TASK
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        linked, near = _least(both, tables, tasks)
        large = linked.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        down = tables.write(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct().coalesce(tasks))
        small, far = _least(down, tables, tasks)
        stars = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(small.select("u", F.col("low").alias("v")))
        old, links = links, tables.write(stars.filter("u <> v").distinct().coalesce(tasks))
        tables.drop(old, near, down, far)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        rows, before = now[0], now
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tables.close(found.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
