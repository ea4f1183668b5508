"""What every node of a graph reaches, counted by walks over a handed graph; no pair and no bitmap is made.

Of a graph whose ends are many, what lies between is handed out. Where nodes that nothing leads to are the many, each node
walks on to what it reaches; where nodes that lead nowhere are, each walks back to what reaches it and is counted there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.handed_graph import Graph, closures, hand_out, handed

COUNTS = "seed string, kind string, n long, first_id string, last_id string"
NAMES = ["seed", "kind", "n", "first_id", "last_id"]
#: Nodes that a task walks from, on average, where there are more than cores.
TASK_NODES = 500_000
#: Kinds of nodes that a task counts apart while walking back.
KINDS = 16


@dataclass
class HandedReach:
    """edges(src, dst), kinds(id, kind), and the graph to walk in: forward, or back from what is reached."""

    edges: DataFrame
    kinds: DataFrame
    graph: Graph
    forward: bool


def handed_reach(edges: DataFrame, kinds: DataFrame) -> HandedReach | None:
    """The reach of edges(src, dst), written once and without NULLs, where one side of it can be handed out."""
    led_to, leading = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    graph = hand_out(edges.join(led_to, "src", "left_semi"), led_to.withColumnRenamed("src", "id"))
    if graph is not None:
        return HandedReach(edges, kinds, graph, True)
    inner = edges.join(leading, "dst", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    graph = hand_out(inner, leading.withColumnRenamed("dst", "id"))
    if graph is None or kinds.select("kind").distinct().count() > KINDS:
        return None
    return HandedReach(edges, kinds, graph, False)


def _starts(graph: Graph, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column("starts")
    units = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
    nodes = graph.positions(lists.flatten())
    return units[nodes >= 0], nodes[nodes >= 0].astype(np.int64)


def counted_forward(graph_and_kinds: Broadcast) -> Callable:
    """(id, starts) to COUNTS rows: what the starts, and all behind them, are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, names, kind = graph_and_kinds.value
        for batch in batches:
            own = np.ones(len(batch), bool)
            for unit, node in closures(graph, *_starts(graph, batch), own):
                if not len(unit):
                    continue
                of = unit * len(names) + kind[node]
                order = np.argsort(of, kind="stable")
                of, node = of[order], node[order]
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                ends = np.append(first[1:], len(of))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(of[first] // len(names))), names.take(pa.array(of[first] % len(names))),
                    pa.array(ends - first), graph.ids.take(pa.array(node[first])), graph.ids.take(pa.array(node[ends - 1])),
                ], names=NAMES)

    return run


def counted_back(graph: Broadcast) -> Callable:
    """(id, kind, starts), ascending with the id, to COUNTS rows of a task: how many of its nodes are reached from where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = graph.value
        ids, rows, found = [], 0, {}
        for batch in batches:
            names = batch.column("kind").to_pylist()
            kinds = {name: np.array([k == name for k in names]) for name in set(names)}
            for unit, node in closures(at, *_starts(at, batch), np.ones(len(batch), bool)):
                for name, mine in kinds.items():
                    of = mine[unit]
                    if not of.any():
                        continue
                    u, n = unit[of] + rows, node[of]
                    count, first, last = found.setdefault(name, (np.zeros(at.size, np.int64), np.full(at.size, -1), np.full(at.size, -1)))
                    count += np.bincount(n, minlength=at.size)
                    new = first[n] < 0
                    first[n[new][::-1]] = u[new][::-1]  # the first of a node is written last
                    last[n] = u
            ids.append(batch.column("id"))
            rows += len(batch)
        for name, (count, first, last) in found.items():
            node, all_ids = np.flatnonzero(count), pa.concat_arrays(ids)
            for lo in range(0, len(node), 200_000):
                part = node[lo:lo + 200_000]
                yield pa.RecordBatch.from_arrays([
                    at.ids.take(pa.array(part)), pa.repeat(pa.scalar(name, pa.string()), len(part)), pa.array(count[part]),
                    all_ids.take(pa.array(first[part])), all_ids.take(pa.array(last[part])),
                ], names=NAMES)

    return run


def walked_counts(reached: HandedReach) -> DataFrame:
    """(seed, kind, n, first_id, last_id) per node and kind it reaches."""
    edges, graph = reached.edges, reached.graph
    kinds = reached.kinds.where("id IS NOT NULL").groupBy("id").agg(F.min("kind").alias("kind")).where("kind IS NOT NULL")
    here, there = ("src", "dst") if reached.forward else ("dst", "src")
    walked = edges.groupBy(F.col(here).alias("id")).agg(F.collect_set(there).alias("starts"))
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, walked.count() // TASK_NODES + 1)
    if reached.forward:
        own = edges.select(F.col("dst").alias("id")).distinct().join(kinds, "id").toArrow()
        names = own["kind"].combine_chunks().dictionary_encode()
        kind = np.full(graph.size, -1, np.int64)
        kind[graph.positions(own["id"].combine_chunks())] = names.indices.to_numpy(zero_copy_only=False)
        graph.seeds &= kind >= 0
        sent = edges.sparkSession.sparkContext.broadcast((graph, names.dictionary, kind))
        return walked.repartition(tasks, "id").mapInArrow(counted_forward(sent), COUNTS)
    dealt = walked.join(kinds, "id").select("id", "kind", "starts").repartition(tasks, "id").sortWithinPartitions("id")
    return dealt.mapInArrow(counted_back(handed(edges, graph)), COUNTS).groupBy("seed", "kind").agg(
        F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")
    )
