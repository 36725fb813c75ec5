"""Connected components by alternating large-star and small-star, with DataFrame operations only; or, if all edges fit
one task, by hooking there."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, trim

MAX_ROUNDS = 60
#: Edges (16 bytes each) that one task joins.
TASK_EDGES = 1_000_000


def _joined_to_min(ws: Workspace, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v, m) with m the smaller of u and its smallest v; and the table of minima.

    The minima are written first, so that the join reads two plain tables: Spark broadcasts the minima
    if their files are small, and can otherwise split the shuffle partition of a hub.
    """
    mins = ws.write(pairs.groupBy("u").agg(F.min("v").alias("m")), "mins")
    return pairs.join(mins, "u").select("u", "v", F.least("u", "m").alias("m")), mins


def large_star(ws: Workspace, edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    j, mins = _joined_to_min(ws, both)
    out = ws.write(j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
    ws.drop(mins)
    return out


def small_star(ws: Workspace, edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    j, mins = _joined_to_min(ws, down)
    out = ws.write(j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(j.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
    ws.drop(mins)
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head())


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of `edges` (u, v long).

    Loops, repeated edges and edges with a null end are ignored; a node with no other edge isn't returned.
    No edges: an empty table. Each half round is written to the shared folder.
    """
    now = ws.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        big = large_star(ws, now)
        new = small_star(ws, big)
        ws.drop(big, now)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    else:
        raise RuntimeError(f"components not stable after {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges in order, and the smallest node that each reaches.

    Roots hook onto the smallest root beside them, and paths are halved until all nodes point to a root.
    """
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[label]


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """As connected_components, written, for a written table of edges: one job in place of four tables a round if all
    edges fit one task, rounds of stars if not; the result is the same."""
    if edges.count() > TASK_EDGES:
        return ws.write(connected_components(ws, edges), "components")

    def run(batches):
        parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        nodes, component = smallest_reachable(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else ((), ())
        for at in range(0, len(nodes), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65536]) for x in (nodes, component)], ["node", "component"])
        if len(nodes) > 100_000:
            trim()

    rows = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    return ws.write(rows.repartition(1).mapInArrow(run, "node long, component long"), "components")
