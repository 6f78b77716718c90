"""Near-duplicate vectors: an exact metric range join on pivots.

Method: the angle between vectors is a metric, and cosine >= c is angle <= r with
r = arccos c.  A sample of vectors serves as pivots.  Each vector is at home in the
cell of its nearest pivot, and is also sent to every pivot p with
angle(x, p) <= angle(x, home) + 2r: by the triangle inequality no other cell can be
home to a vector within r of it.  Cells (label, pivot) join independently: each counts
the links of its home vectors with all that were sent, so every link is counted once
at either end, in double precision.

Inside a cell the same inequality prunes again: vectors are sorted by their angle to the
pivot, and one is compared only with those whose angle differs by at most r.

Scale: equal vectors of a label are one node with a multiplicity, so a hot group of
copies is aggregated before anything is shuffled by cell.  How many pivots there are is
decided by cost: for 1, 4, 16, ... up to ``most_pivots`` a sample of ``sample`` vectors
tells what share of all pairs meets in cells and how many copies of a vector are sent,
and the number that costs least for the largest label is taken, so pivots grow with the
data where they separate it; more than COPIES copies in the mean are never sent.  A cell of more than ``block`` vectors is dealt as pairs of
blocks, none larger than ``block`` a side.  A task holds one pair of blocks.  Links of a
block pair leave it as counts and a forest, never as pairs.  Pivots (bounded by
``most_pivots``) are the only thing broadcast.  On vectors spread evenly over a sphere of
many dimensions no pivot separates much: one is taken, and the work is that of comparing
all vectors of a label, by matrix products in blocks.

Cases: a vector that is null, empty, all zeros or holds a null or non-finite component
links with nothing, nor does one whose label is null; vectors of different length
never link; n_links counts rows, so equal vectors count each other; repeated rows and
repeated ids are vectors of their own; component_id is the smallest id reachable; an
empty table gives no rows; columns other than the three are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint, let
from quillon.llm.graph import components, local_roots

BLOCK = 2048
#: What sending a vector costs, in comparisons of two.
SEND = 300
#: Copies of a vector, in the mean, that cells may take: what is shuffled stays in proportion to the input.
COPIES = 8


def _nodes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, _v, _node): _v is null where a vector links with nothing."""
    v = F.col(vector_col).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = F.col(label_col).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.when(usable, v).alias("_v"))
    return rows.withColumn("_node", F.when(F.col("_v").isNotNull(), F.xxhash64("label", "_v")))


def _unit(v):
    """The vector over its length; scaled first, so that squares neither overflow nor vanish."""

    def scaled(u):
        big = F.aggregate(u, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
        return let(big, lambda b: F.transform(u, lambda x: x / b))

    def normed(u):
        return let(F.sqrt(F.aggregate(u, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(u, lambda x: x / n))

    return let(let(v, scaled), normed)


def choose_pivots(x: np.ndarray, largest: int, reach: float, most: int, send: float | None = None) -> np.ndarray:
    """The first 1, 4, 16, ... of a sample of unit vectors, as many as make a join of ``largest`` vectors cheapest."""
    send = SEND if send is None else send
    best, taken = None, 1
    p = 1
    while p <= min(most, max(1, len(x) // 4)):
        angle = np.arccos(np.clip(x[p:] @ x[:p].T, -1.0, 1.0)) if len(x) > p else np.zeros((1, p))
        near = angle <= angle.min(1)[:, None] + reach
        home = np.bincount(angle.argmin(1), minlength=p) / len(angle)
        cost = float(largest) ** 2 * (home @ near.mean(0)) + largest * (send * near.sum(1).mean() + p)
        if best is None or cost < best and near.sum(1).mean() <= COPIES:
            best, taken = cost, p
        p *= 4
    return x[:taken]


def link(vectors: DataFrame, cosine: float = 0.98, most_pivots: int = 1024, block: int = BLOCK, sample: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = _nodes(vectors, id_col, vector_col, label_col)
    nodes = rows.filter("_node IS NOT NULL").groupBy("_node").agg(F.first("label").alias("label"), F.first("_v").alias("_v"), F.count(F.lit(1)).alias("copies"))
    nodes = checkpoint(nodes.select("_node", "label", F.size("_v").alias("dim"), _unit(F.col("_v")).alias("v"), "copies"))

    sizes = nodes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n"))
    largest = {r["dim"]: r["n"] for r in sizes.collect()}  # a row per length of vector
    order = Window.partitionBy("dim").orderBy(F.xxhash64("_node"))
    # at most ``sample`` vectors per length of vector
    drawn = nodes.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= sample).select("dim", "v").toArrow()
    reach = 2 * float(np.arccos(cosine)) + 1e-7
    pivots: dict[int, np.ndarray] = {}
    for dim in largest:
        mine = drawn.filter(pc.equal(drawn["dim"], dim))["v"].combine_chunks()
        pivots[dim] = choose_pivots(mine.flatten().to_numpy().reshape(-1, dim), largest[dim], reach, most_pivots)
    sent = spark.sparkContext.broadcast(pivots)

    def route(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                x = np.array(part["v"].tolist(), dtype=np.float64)
                angle = np.arccos(np.clip(x @ sent.value[dim].T, -1.0, 1.0))
                home = angle.argmin(1)
                row, pivot = np.nonzero(angle <= angle.min(1)[:, None] + reach)
                yield part.iloc[row].assign(pivot=pivot.astype(np.int32), home=pivot == home[row], angle=angle[row, pivot])[["_node", "label", "dim", "v", "copies", "pivot", "home", "angle"]]

    kind = nodes.schema["label"].dataType.simpleString()
    cells = nodes.mapInPandas(route, f"_node long, label {kind}, dim int, v array<double>, copies long, pivot int, home boolean, angle double")
    cell = ("label", "dim", "pivot")
    # where each row goes is kept without the vector, to size the cells
    counts = cells.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_all"), F.sum(F.col("home").cast("int")).alias("n_home")).filter("n_home > 0 AND n_all > 1")
    counts = counts.select(*cell, F.ceil(F.col("n_home") / block).cast("int").alias("hb"), F.ceil(F.col("n_all") / block).cast("int").alias("ab"))
    dealt = cells.join(counts, list(cell))
    h = F.xxhash64("_node", F.lit(11))
    as_home = dealt.filter("home").select("*", F.pmod(h, F.col("hb")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ab") - 1)).alias("j"), F.lit(True).alias("side"))
    as_any = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("i"), F.pmod(h, F.col("ab")).cast("int").alias("j"), F.lit(False).alias("side"))
    pairs = as_home.unionByName(as_any).select(*cell, "i", "j", "side", "_node", "copies", "v", "angle")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("angle", kind="stable")
        side, angle = pdf["side"].to_numpy(), pdf["angle"].to_numpy()
        ids, copies = pdf["_node"].to_numpy(), pdf["copies"].to_numpy()
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        links, at_left, at_right = np.zeros(len(left), np.int64), [], []
        if len(left) and len(right):
            a, b = np.array(pdf["v"].iloc[left].tolist()), np.array(pdf["v"].iloc[right].tolist())
            for k in range(0, len(left), 256):
                rows = left[k : k + 256]
                # by the triangle inequality nothing outside these angles is near
                s, e = np.searchsorted(angle[right], [angle[rows[0]] - reach / 2, angle[rows[-1]] + reach / 2], "left")
                near = (a[k : k + 256] @ b[s:e].T >= cosine) & (ids[rows][:, None] != ids[right[s:e]][None, :])
                links[k : k + 256] = near @ copies[right[s:e]]
                x, y = np.nonzero(near)
                at_left.append(rows[x])
                at_right.append(right[s:e][y])
        x, y = (np.concatenate(at_left), np.concatenate(at_right)) if at_left else (np.empty(0, int), np.empty(0, int))
        uniq, inv = np.unique(ids, return_inverse=True)
        root = local_roots(len(uniq), inv[x], inv[y])
        count = np.zeros(len(uniq), np.int64)
        np.add.at(count, inv[left], links)
        touched = np.unique(np.concatenate([inv[x], inv[y]]))
        return pd.DataFrame({"_node": uniq[touched], "links": count[touched], "root": uniq[root[touched]]})

    found = checkpoint(pairs.groupBy(*cell, "i", "j").applyInPandas(join, "_node long, links long, root long"))
    links = found.groupBy("_node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("_node").alias("a"), F.col("root").alias("b")))
    # back to the rows: nodes with their multiplicity, links and component
    info = (
        nodes.select("_node", "copies")
        .join(links, "_node", "left")
        .join(comp.withColumnRenamed("node", "_node"), "_node", "left")
        .select("_node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "_node").alias("_root"))
    )
    ids = rows.select("vec_id", "_node")
    with_root = ids.join(info, "_node", "left")
    least = with_root.filter("_root IS NOT NULL").groupBy("_root").agg(F.min("vec_id").alias("_least"))
    out = with_root.join(least, "_root", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
