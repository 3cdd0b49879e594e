"""Connected components of a link table, by minimum labels and pointer jumping.

Up to ``FEW`` links are labelled at once, on the driver: rounds of joins over them are all stages and tasks (211
each with as many shuffle partitions), which the driver has to plan and remember. More links take DataFrame joins,
with the same result at any size. There every round a node takes the smallest label among its own and its neighbours', hangs its old label below
that one, and then follows its label's label; labels only fall, and a round without a change ends it. Each
round is written to the shared folder, so the plan stays short and a lost executor costs one round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Links (of two numbers each, 2 MB in all) that the driver takes at most.
FEW = 1 << 17


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, labels) of the links between a and b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != new[new]).any():
            new = new[new]
        root = new
    return nodes, nodes[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of (a, b), label being the component's smallest node; edges are read twice."""
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    if edges.count() <= FEW:
        few = edges.toArrow()
        nodes, labels = labelled(few["a"].to_numpy(), few["b"].to_numpy())
        found = pa.table({"node": pa.array(nodes, pa.int64()), "label": pa.array(labels, pa.int64())})
        return written(edges.sparkSession.createDataFrame(found, "node long, label long"), "labels")
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        pushed = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hooked = pushed.select("node", "label").unionByName(pushed.filter("old <> label").select(F.col("old").alias("node"), "label")).groupBy("node").agg(F.min("label").alias("label"))
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        jumped = hooked.join(up, "label", "left").select("node", F.least("label", F.coalesce("higher", "label")).alias("label"))
        new = written(jumped, "labels")
        changed = new.join(labels.withColumnRenamed("label", "was"), "node").filter("label <> was").limit(1).count()
        dropped(labels)
        labels = new
        if not changed:
            dropped(both)
            return labels
