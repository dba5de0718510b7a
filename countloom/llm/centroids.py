"""Clustering of integer vectors around centroids, searched through a vantage-point tree.

Vectors are turned into integers once, floor(scale * x), and written. Each round builds a vantage-point tree over the
centroids on the driver, broadcasts it as plain arrays, and assigns every vector by branch and bound: of its open nodes a vector
visits the one with the smallest lower bound first, and drops those whose bound is above the distance found so far. A bound
that equals it stays open, since a centroid with a smaller number may lie at that very distance. Leaves compare
exact integer distances. The vectors of a batch search at the same time, each with its own open nodes. Tasks add up their
vectors per cluster, so a round moves clusters x tasks rows and the driver sees one row per cluster.

Results: vectors with another number of components, or with a null or non-finite one, are left out; all others are assigned, rows
that repeat each on their own. Ties go to the centroid with the smaller number. Centroids that no vector chose stay where they
are. With fewer vectors than clusters every vector starts one. Null ids start clusters last. Integers are limited to
+-2**27, beyond which the squared distance of 64 components could exceed a long. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.storage import materialise

_LARGEST = float(1 << 27)
#: Cells of the table of open nodes that one step of the search holds.
_OPEN_CELLS = 1 << 22


@dataclass(frozen=True)
class ClusterConfig:
    """``leaf`` is the number of centroids a leaf of the tree may hold."""

    clusters: int = 8
    rounds: int = 10
    components: int = 64
    scale: float = 1024.0
    seed: int = 3
    leaf: int = 2


def integer_vectors(vectors: DataFrame, config: ClusterConfig = ClusterConfig()) -> DataFrame:
    """(vec_id, v array<int>) of the complete and finite vectors of (vec_id, embedding)."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.size("embedding") == config.components)
    bounded = lambda x: F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), x.cast("double") * config.scale))
    return whole.filter(fine).select("vec_id", F.transform("embedding", lambda x: F.floor(bounded(x)).cast("int")).alias("v"))


# ---- the tree -----------------------------------------------------------------------------


def build_tree(centroids: np.ndarray, leaf: int = 2) -> dict:
    """A vantage-point tree as plain arrays and lists.

    An inner node has a vantage centroid and two children, those nearer than the median and the rest, each with the
    range of its squared distances from the vantage centroid. A leaf has a list of centroids.
    """
    nodes: list[tuple] = []

    def grow(members: list[int]) -> int:
        at = len(nodes)
        nodes.append(())
        if len(members) <= leaf:
            nodes[at] = ("leaf", members)
            return at
        vantage, rest = members[0], np.array(members[1:])
        squared = ((centroids[rest] - centroids[vantage]) ** 2).sum(1)
        order = np.argsort(squared, kind="stable")
        half = (len(rest) + 1) // 2
        children = []
        for chosen in (order[:half], order[half:]):
            if len(chosen):
                low, high = int(squared[chosen].min()), int(squared[chosen].max())
                children.append((grow(rest[chosen].tolist()), math.sqrt(low), math.sqrt(high)))
        nodes[at] = ("inner", vantage, children)
        return at

    if len(centroids):
        grow(list(range(len(centroids))))
    return {"nodes": nodes, "centroids": np.asarray(centroids, dtype=np.int64)}


def nearest(tree: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of every row, the smaller number on ties."""
    nodes, centroids = tree["nodes"], tree["centroids"]
    size = max(1, _OPEN_CELLS // len(nodes))
    if len(x) > size:
        parts = [nearest(tree, x[i : i + size]) for i in range(0, len(x), size)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    bound = np.full((len(x), len(nodes)), np.inf)
    bound[:, 0] = 0.0
    best = np.full(len(x), np.iinfo(np.int64).max)
    number = np.full(len(x), len(centroids), dtype=np.int64)
    radius = np.full(len(x), np.inf)
    rows = np.arange(len(x))

    def offer(rows, which):
        """Compare rows with one centroid exactly; returns the distances."""
        apart = x[rows] - centroids[which]
        squared = (apart * apart).sum(1)
        better = (squared < best[rows]) | ((squared == best[rows]) & (which < number[rows]))
        chosen = rows[better]
        best[chosen], number[chosen] = squared[better], which
        # Roots are rounded: the radius is widened by more than the rounding, so an equal distance is never dropped.
        radius[chosen] = np.sqrt(squared[better].astype(np.float64)) * (1 + 1e-12) + 1e-6
        return squared

    while len(rows):
        node = bound[rows].argmin(1)
        open_ = bound[rows, node] <= radius[rows]
        open_ &= np.isfinite(bound[rows, node])
        rows, node = rows[open_], node[open_]
        for at in np.unique(node).tolist():
            here = rows[node == at]
            below = bound[here, at]
            bound[here, at] = np.inf
            kind, *content = nodes[at]
            if kind == "leaf":
                for which in content[0]:
                    offer(here, which)
            else:
                vantage, children = content
                away = np.sqrt(offer(here, vantage).astype(np.float64))
                for child, low, high in children:
                    slack = 1e-6 + 1e-12 * away
                    bound[here, child] = np.maximum(below, np.maximum(low - away, away - high) - slack)
    return number, best


# ---- rounds -------------------------------------------------------------------------------


def _matrix(frame: pa.RecordBatch, components: int) -> np.ndarray:
    return frame.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, components).astype(np.int64)


def _round_sums(vectors: DataFrame, tree, clusters: int, components: int) -> DataFrame:
    """(cluster, n, sums) per task: the vectors of each cluster added up."""

    def add(frames: Iterable[pa.RecordBatch]):
        sums, counts = np.zeros((clusters, components), dtype=np.int64), np.zeros(clusters, dtype=np.int64)
        for frame in frames:
            x = _matrix(frame, components)
            chosen, _ = nearest(tree.value, x)
            order = np.argsort(chosen, kind="stable")
            present, starts = np.unique(chosen[order], return_index=True)
            if len(present):
                sums[present] += np.add.reduceat(x[order], starts, axis=0)
                counts += np.bincount(chosen, minlength=clusters)
        found = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * components), pa.array(sums[found].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found]), lists], ["cluster", "n", "sums"])

    return vectors.select("v").mapInArrow(add, "cluster int, n long, sums array<long>")


def _assign(vectors: DataFrame, tree, components: int) -> DataFrame:
    def assign(frames: Iterable[pa.RecordBatch]):
        for frame in frames:
            chosen, squared = nearest(tree.value, _matrix(frame, components))
            columns = [frame.column("vec_id"), pa.array(chosen.astype(np.int32)), pa.array(squared)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(assign, "vec_id long, cluster int, distance long")


def starting_centroids(vectors: DataFrame, config: ClusterConfig) -> np.ndarray:
    """The vectors whose ids have the smallest hashes; one row per cluster reaches the driver."""
    hashed = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(config.clusters).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64).reshape(len(rows), config.components)


def cluster(vectors: DataFrame, config: ClusterConfig = ClusterConfig()) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every complete vector of (vec_id, embedding)."""
    spark = vectors.sparkSession
    context = spark.sparkContext
    whole = materialise(integer_vectors(vectors, config), "vectors")
    centroids = starting_centroids(whole, config)
    k, width = len(centroids), config.components
    if k == 0:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(config.rounds):
        tree = context.broadcast(build_tree(centroids, config.leaf))
        parts = _round_sums(whole, tree, k, width)
        sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
        moved = centroids.copy()
        for row in sums.collect():
            moved[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
        tree.destroy()
        if np.array_equal(moved, centroids):
            # Further rounds would repeat this one.
            break
        centroids = moved
    tree = context.broadcast(build_tree(centroids, config.leaf))
    assigned = materialise(_assign(whole, tree, width), "assigned")
    exact = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    by_cluster = {row["cluster"]: int(row["s"]) for row in exact}
    total, most = sum(by_cluster.values()), 2**63 - 1
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(c, min(s, most), min(total, most), digest[c]) for c, s in by_cluster.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
