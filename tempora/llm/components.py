"""Connected components of an edge table, with nothing gathered on the driver.

Edges within a task are first replaced by a star for each of the task's own
components, twice, the second time in as few tasks as the stars fill; then every node takes the least label among its neighbours' and its
label's label until nothing changes, so that long chains fold in logarithmic
time. Each iteration is cut off by a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Stars that a task holds at most, and rows a task of what is kept between iterations.
LIMIT, ROWS = 1_000_000, 50_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, node): a star for each component of the edges (a, b), around its least node."""
    nodes, where = np.unique(np.r_[a, b], return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, label[x], label[y])
        np.minimum.at(least, label[y], label[x])
        least = least[least]
        least = np.minimum(least, least[label])
        if (least == label).all():
            break
        label = least
    out = label != np.arange(len(nodes))
    return nodes[label[out]], nodes[out]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of a task's edges, merged whenever as many are new as there are stars; LIMIT at a time."""
    none = np.zeros(0, np.int64)
    held, fresh, size = (none, none), [], 0
    for b in batches:
        fresh.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size > 100_000 + len(held[0]):
            held = stars(*map(np.concatenate, zip(held, *fresh, strict=True)))
            fresh, size = [], 0
            if len(held[0]) > LIMIT:
                yield C.batch({"a": held[0], "b": held[1]})
                held = (none, none)
    centre, node = stars(*map(np.concatenate, zip(held, *fresh, strict=True)))
    yield C.batch({"a": centre, "b": node})


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that is reachable) of every node of the edges (a, b)."""
    C.ready(edges.sparkSession)
    some = C.cut(edges.select("a", "b").where("a != b").mapInArrow(_stars, "a long, b long"))
    few = max(4, -(-some.count() // ROWS))  # coalesce() doesn't raise a number of partitions
    forest = some.coalesce(few).mapInArrow(_stars, "a long, b long")
    both = C.cut(forest.unionByName(forest.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().coalesce(few))
    label = C.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")).coalesce(few))
    while True:
        known = label.select(F.col("node").alias("b"), F.col("component").alias("other"))
        near = both.join(known, "b").select(F.col("a").alias("node"), F.col("other").alias("component")).coalesce(few)
        # what a node's neighbours know is also news to its label, which is how trees are hooked together
        news = near.join(label.select("node", F.col("component").alias("root")), "node")
        told = news.select(F.col("root").alias("node"), "component").coalesce(few).unionByName(near)
        jump = label.join(label.select(F.col("node").alias("component"), F.col("component").alias("far")), "component").select("node", F.col("far").alias("component")).coalesce(few)
        new = C.cut(label.select("node", "component", F.col("component").alias("old")).unionByName(told.unionByName(jump).withColumn("old", F.lit(None).cast("long"))).groupBy("node").agg(F.min("component").alias("component"), F.max("old").alias("old")).coalesce(few))
        if new.where("component < old").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")
