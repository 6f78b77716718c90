"""Near-duplicate documents: a Jaccard join on word shingles with Bayesian pruning.

Method: a document is the set of its shingles of five words; documents of equal sets
are one node.  ``bands`` bands of ``rows`` MinHash values route nodes to buckets, and
nodes that share a bucket are candidates (a pair of similarity 0.8 shares none with a
chance of 2e-6).  Candidates are compared MinHash by MinHash, ``step`` at a time: with
m of n values equal and a uniform prior the posterior of the similarity is
Beta(m + 1, n - m + 1), and a pair is dropped when the chance that it reaches the
threshold falls below ``tolerance``.  The rest is verified exactly on the sets.

Scale: buckets never become pairs.  The nodes of a bucket, or of a connected part of the
graph of all buckets (a group), are compared in one unit.  For each group that is chosen
which sends fewer texts: near copies share most of their buckets and are one unit; in a
chain of documents that share boilerplate with their neighbours only, each bucket is a
unit, and a pair counts in the first bucket it has in common.  A unit of more than
``block`` nodes is dealt as pairs of blocks, so a task holds two blocks at most; nodes of
a block are compared in numpy, exact intersections come from matrix products over the
shingles that occur twice.  Links leave a block as counts and a forest, linear in its
nodes.  Units are spread over as many tasks as their nodes ask for.  Hot keys (copies,
buckets, classes) are reduced by partial aggregation, and joined with salt.  As the number
of links of a document is asked for, a group of n near copies takes n^2 comparisons and
n^2 / ``block`` texts sent.

Cases: a text of one to four words is one shingle; a null text or one without words
links with nothing; texts of any length are read whole; equal sets link with each
other; repeated rows are documents of their own, and so are rows with equal ids; a
null id is a document whose class is the least other id of its group, else null; ties
at the threshold link; an empty table gives no rows; other columns are ignored by
``link`` and kept by ``keep_one``.  Nodes are named by 64-bit hashes of their sets.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint, text_slices
from quillon.llm.graph import components, local_roots
from quillon.llm.shingles import minhasher, mix, shingle_sets

THRESHOLD = 0.8
BANDS, ROWS = 56, 7
BLOCK = 512
NODES_PER_TASK = 512
SALTS = 16


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest of n equal MinHash values at which the posterior chance of reaching the threshold is at least ``tolerance``.

    P(J >= t | m of n) under a uniform prior is P(Binomial(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n + 1


def similar(sets: list[np.ndarray], sigs: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float, step: int, own: tuple[np.ndarray, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of left, one of right) of sets whose Jaccard similarity reaches the threshold.

    own: the buckets of each set, and the band that a pair's first common bucket must be of.
    """
    sizes = np.array([len(s) for s in sets])
    k = sigs.shape[1]
    bounds = [(n, least_matches(n, threshold, tolerance)) for n in range(step, k + 1, step)]
    found_x, found_y = [], []
    for c in range(0, len(left), 256):
        rows = left[c : c + 256]
        # sizes alone bound the similarity
        small, large = np.minimum(sizes[rows][:, None], sizes[right][None]), np.maximum(sizes[rows][:, None], sizes[right][None])
        x, y = np.nonzero((small >= threshold * large - 1e-9) & (rows[:, None] < right[None, :]))
        x, y = rows[x], right[y]
        equal = np.zeros(len(x), np.int32)
        for n, least in bounds:
            for p in range(0, len(x), 1 << 16):
                equal[p : p + (1 << 16)] += (sigs[x[p : p + (1 << 16)], n - step : n] == sigs[y[p : p + (1 << 16)], n - step : n]).sum(1, dtype=np.int32)
            alive = equal >= least
            x, y, equal = x[alive], y[alive], equal[alive]
        if own is not None:
            mine = (own[0][x] == own[0][y]).argmax(1) == own[1]
            x, y = x[mine], y[mine]
        found_x.append(x)
        found_y.append(y)
    x, y = np.concatenate(found_x) if found_x else np.empty(0, int), np.concatenate(found_y) if found_y else np.empty(0, int)
    if not len(x):
        return x, y
    inter = intersections(sets, x, y)
    ok = inter >= threshold * (sizes[x] + sizes[y] - inter) - 1e-9
    return x[ok], y[ok]


def intersections(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, columns: int = 1 << 11) -> np.ndarray:
    """Exact sizes of the intersections of pairs of sets."""
    if len(x) <= 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x, y)], dtype=np.int64)
    used = np.unique(np.concatenate([x, y]))
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    uniq, code, count = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[code] > 1
    owner, code = owner[shared], number[code[shared]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = np.zeros((len(used), len(used)), np.float32)  # counts below 2^24 are exact
    last = code[-1] + 1 if len(code) else 0
    for s in range(0, last, columns):
        a, b = np.searchsorted(code, [s, s + columns])
        has = np.zeros((len(used), min(columns, last - s)), np.float32)
        has[owner[a:b], code[a:b] - s] = 1
        total += has @ has.T
    return total[np.searchsorted(used, x), np.searchsorted(used, y)].astype(np.int64)


def _row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def sketch(docs: DataFrame, shingle: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, node, bands): a row per document; node and bands are null without shingles."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        hasher = minhasher(bands * rows)
        weights = np.random.default_rng(2).integers(0, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            done = 0
            for texts in text_slices(batch.column(2)):
                starts, h = shingle_sets(texts, shingle)
                with np.errstate(over="ignore"):
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h))])
                    node = mix(sums[starts[1:]] - sums[starts[:-1]] + np.diff(starts).astype(np.uint64)).view(np.int64)
                    out = []
                    for a, b in zip(starts[:-1], starts[1:]):
                        if b > a:
                            sig = hasher(h[a:b]).reshape(bands, rows).astype(np.uint64)
                            out.append(mix((mix(sig + np.uint64(1)) * weights).sum(1) + np.arange(bands, dtype=np.uint64)).view(np.int64))
                        else:
                            out.append(None)
                part = batch.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node, mask=np.diff(starts) == 0), pa.array(out, pa.list_(pa.int64()))], names=["id", "row", "node", "bands"])

    source = docs.select(F.col(id_col).alias("id"), _row_key(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {id_type}, row long, node long, bands array<long>")


def _with_class(nodes: DataFrame, classes: DataFrame, how: str = "inner") -> DataFrame:
    """Nodes joined with the row of their class by root; as a class may hold a third of all nodes, with salt."""
    spread = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(spread, ["root", "salt"], how).drop("salt")


def _units(nodes: DataFrame, block: int) -> DataFrame:
    """(node, units): what each node that shares a bucket is to be compared in, as (unit, band or -1, parts)."""
    bucketed = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = bucketed.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n"), F.first("band").alias("band")).filter("n > 1")
    buckets = checkpoint(buckets)
    two = buckets.filter("n = 2").select("bucket", "band", "a", "n", F.explode(F.array("a", "b")).alias("node"))
    more = bucketed.drop("band").join(buckets.filter("n > 2").select("bucket", "band", "a", "n"), "bucket")
    members = checkpoint(two.unionByName(more))
    groups = checkpoint(components(members.filter("a <> node"), "a", "node"))

    def parts(n: str) -> Column:
        return F.ceil(F.col(n) / block).cast("int")

    # texts sent if the group is one unit, and if each of its buckets is
    sized = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    as_buckets = buckets.join(groups.withColumnRenamed("node", "a"), "a").groupBy("root").agg(F.sum(F.col("n") * parts("n")).alias("cost"))
    chosen = sized.join(as_buckets, "root").select("root", parts("size").alias("parts"), (F.col("cost") < F.col("size") * parts("size")).alias("split"))
    chosen = checkpoint(_with_class(groups, chosen))
    whole = chosen.filter("NOT split").select("node", F.array(F.struct(F.col("root").alias("unit"), F.lit(-1).alias("band"), "parts")).alias("units"))
    split = members.join(chosen.filter("split").select("node"), "node").groupBy("node").agg(F.collect_list(F.struct(F.col("bucket").alias("unit"), "band", parts("n").alias("parts"))).alias("units"))  # at most a unit for each band
    return whole.unionByName(split)


def _classes(docs: DataFrame, threshold: float, shingle: int, bands: int, rows: int, tolerance: float, step: int, block: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, class, n_links, first): first is the row kept of each class."""
    k = bands * rows
    sketched = checkpoint(sketch(docs, shingle, bands, rows, id_col, text_col))
    # equal sets have equal bands
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("first")
    nodes = checkpoint(sketched.filter("node IS NOT NULL").groupBy("node").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), first, F.first("bands").alias("bands")))
    wanted = checkpoint(_units(nodes, block).join(nodes.select("node", "row", "copies", "bands"), "node"))
    source = docs.select(_row_key(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    texts = source.join(wanted, "row").dropDuplicates(["row"])
    part = F.pmod(F.xxhash64("node", F.lit(5)), F.col("u.parts")).cast("int")
    cells = (
        texts.select("node", "copies", "text", "bands", F.explode("units").alias("u"))
        .withColumn("p", part)
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("u.parts") - 1)))
        .select("u.unit", "u.band", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "node", "copies", "text", F.when(F.col("u.band") >= 0, F.col("bands")).alias("bands"))
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, band = pdf["i"].iloc[0], pdf["j"].iloc[0], pdf["band"].iloc[0]
        pdf = pdf.sort_values(["p", "node"])
        sets = []
        for texts in text_slices(pa.array(pdf["text"], pa.large_string())):
            starts, h = shingle_sets(texts, shingle)
            sets += [h[a:b] for a, b in zip(starts[:-1], starts[1:])]
        hasher = minhasher(k)
        sigs = np.array([hasher(s) for s in sets])
        p, node, copies = pdf["p"].to_numpy(), pdf["node"].to_numpy(), pdf["copies"].to_numpy()
        own = None if band < 0 else (np.array(pdf["bands"].tolist()), int(band))
        x, y = similar(sets, sigs, np.flatnonzero(p == i), np.flatnonzero(p == j), threshold, tolerance, step, own)
        links = np.zeros(len(pdf), np.int64)
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        root = local_roots(len(pdf), x, y)
        touched = np.unique(np.concatenate([x, y]))
        return pd.DataFrame({"node": node[touched], "links": links[touched], "root": node[root[touched]]})

    # by work, not by bytes: a task takes about NODES_PER_TASK nodes
    sent = wanted.select(F.explode("units").alias("u")).agg(F.sum("u.parts")).first()[0] or 0
    dealt = cells.repartition(max(1, -(-sent // NODES_PER_TASK)), "unit", "i", "j")
    found = checkpoint(dealt.groupBy("unit", "i", "j").applyInPandas(compare, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = checkpoint(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    own = nodes.select("node", "copies", "least", "first").join(links, "node", "left").join(linked, "node", "left")
    own = own.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least", "first", "root")
    of_class = linked.join(nodes.select("node", "least", "first"), "node").groupBy("root").agg(F.min("least").alias("c_least"), F.min("first").alias("c_first"))
    info = _with_class(own, of_class, "left").select("node", "n_links", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("c_least")).alias("class"), F.coalesce("c_first", "first").alias("first"))
    out = sketched.select("id", "row", "node").join(info, "node", "left")
    alone = F.col("node").isNull()
    return out.select("id", "row", F.when(alone, F.col("id")).otherwise(F.col("class")).alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("first.row") == F.col("row"))).alias("first"))


def link(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = 5, bands: int = BANDS, rows: int = ROWS, tolerance: float = 1e-9, step: int = 28, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (least id reachable by links), n_links (other documents linked directly), kept."""
    out = _classes(docs, threshold, shingle, bands, rows, tolerance, step, block, id_col, text_col)
    return out.select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), "n_links", F.col("first").alias("kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = 5, bands: int = BANDS, rows: int = ROWS, tolerance: float = 1e-9, step: int = 28, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with all its columns; documents without words stay, repeated ones once."""
    out = _classes(docs, threshold, shingle, bands, rows, tolerance, step, block, id_col, text_col)
    kept = out.filter("first").select(F.col("row").alias("_row")).distinct()
    packed = docs.select(_row_key(id_col, text_col).alias("_row"), F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"))
    return packed.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select("_doc.*")
