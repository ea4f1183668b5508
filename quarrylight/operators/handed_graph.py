"""Walks over a graph small enough to be handed to every task.

A graph of tables is small where the assets at its ends are many. Its edges go to every task as two arrays of
numbers; a task walks from many starts at once and deals out no pair. Graphs over the bounds are walked by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A graph is handed out up to so many edges and characters of their IDs (and of the nodes listed beside them).
HANDED_EDGES = 4_000_000
HANDED_CHARS = 128_000_000
#: Pairs of a start and a node that a task holds at a time; a start alone has one for each node at most.
PAIRS = 6_000_000


@dataclass
class Graph:
    """Nodes by position, ascending with their ID as Spark orders text; node n leads to nexts[firsts[n]:firsts[n + 1]].

    listed: nodes that were listed beside the edges; seeds: nodes that a walk is asked to find.
    """

    ids: pa.Array
    firsts: np.ndarray
    nexts: np.ndarray
    listed: np.ndarray
    seeds: np.ndarray
    index: pd.Index | None = None

    @property
    def size(self) -> int:
        return len(self.ids)

    def positions(self, ids: pa.Array) -> np.ndarray:
        """Where IDs are; -1 for an ID that is no node."""
        if self.index is None:
            self.index = pd.Index(self.ids.to_numpy(zero_copy_only=False))
        return self.index.get_indexer(ids.to_numpy(zero_copy_only=False))


def arcs(tails: np.ndarray, heads: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges as firsts and nexts of a Graph."""
    firsts = np.zeros(size + 1, np.int64)
    np.cumsum(np.bincount(tails, minlength=size), out=firsts[1:])
    return firsts, heads[np.argsort(tails, kind="stable")].astype(np.int32)


def hand_out(edges: DataFrame, listed: DataFrame | None = None) -> Graph | None:
    """edges(src, dst), walked from src to dst, and listed(id) as a Graph on the driver; None over the bounds.

    A walk is asked for nodes that are listed or that an edge leads to.
    """
    edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    named = edges.limit(0).select(F.col("src").alias("id")) if listed is None else listed.select("id").where("id IS NOT NULL").distinct()
    n, chars = edges.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("src") + F.octet_length("dst")), F.lit(0))).first()
    more, longer = named.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("id")), F.lit(0))).first()
    if n + more > HANDED_EDGES or chars + longer > HANDED_CHARS:
        return None
    links, own = edges.toArrow(), named.toArrow()
    tails, heads, own = (c.combine_chunks().cast(pa.string()) for c in (links["src"], links["dst"], own["id"]))
    ids = pc.unique(pa.concat_arrays([tails, heads, own]))
    ids = ids.take(pc.sort_indices(ids))
    tail, head, own = (pc.index_in(c, value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64) for c in (tails, heads, own))
    firsts, nexts = arcs(tail, head, len(ids))
    there, led_to = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    there[own], led_to[head] = True, True
    return Graph(ids, firsts, nexts, there, there | led_to)


def narrowed(graph: Graph, ids: pa.Array) -> Graph:
    """The graph with these IDs alone as listed nodes and seeds, rid of edges from which none of them is found."""
    asked = np.zeros(graph.size, bool)
    places = graph.positions(ids)
    asked[places[places >= 0]] = True
    tails = np.repeat(np.arange(graph.size), np.diff(graph.firsts))
    before, after = arcs(graph.nexts.astype(np.int64), tails, graph.size)
    finds, at = asked.copy(), np.flatnonzero(asked)
    while at.size:
        onward = np.unique(after[_spread(before, at)[0]])
        at = onward[~finds[onward]]
        finds[at] = True
    kept = finds[graph.nexts]
    firsts, nexts = arcs(tails[kept], graph.nexts[kept].astype(np.int64), graph.size)
    return replace(graph, firsts=firsts, nexts=nexts, listed=asked & graph.listed, seeds=asked)


def _spread(firsts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in nexts of all edges of the nodes, and how many each of them has."""
    begin = firsts[at]
    degree = firsts[at + 1] - begin
    ends = np.cumsum(degree)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(begin - (ends - degree), degree) + np.arange(total), degree


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    values.sort()
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


class TooMany(Exception):
    """A walk came to more pairs than a task holds."""


def _met(graph: Graph, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs walked to, as ascending keys (start's number times nodes, plus node), the starts' own with
    them; and those of the starts that an edge led to."""
    size = graph.size
    seen = frontier = _distinct(starts.copy())
    again = []
    while frontier.size:
        node = frontier % size
        places, degree = _spread(graph.firsts, node)
        if not len(places):
            break
        if len(places) + len(seen) > 2 * most:
            raise TooMany
        new = _distinct(np.repeat(frontier - node, degree) + graph.nexts[places])
        merged = np.concatenate([seen, new])
        merged.sort(kind="stable")  # two ascending runs
        twice = merged[1:] == merged[:-1]
        known = merged[1:][twice]
        if known.size:
            again.append(known)
            place = np.searchsorted(known, new)
            place[place == len(known)] = 0
            frontier = new[known[place] != new]
            seen = merged[np.concatenate([[True], ~twice])]
        else:
            frontier, seen = new, merged
        if len(seen) > most:
            raise TooMany
    return seen, np.concatenate(again) if again else seen[:0]


def closures(graph: Graph, units: np.ndarray, nodes: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(units, nodes): the seeds that each unit's nodes lead to, in portions, each ascending; units ascend.

    A node of a unit is one of its seeds itself where own says so of the unit and the node is listed, or where
    another node of the unit leads to it. A unit is in one portion.
    """
    size, stack = graph.size, [(0, len(units))]
    while stack:
        lo, hi = stack.pop()
        if lo == hi:
            continue
        starts = units[lo:hi] * size + nodes[lo:hi]
        many = units[lo] != units[hi - 1]
        try:
            seen, again = _met(graph, starts, PAIRS if many else 2**60)
        except TooMany:
            middle = units[(lo + hi) // 2]
            cut = int(np.searchsorted(units, middle if middle != units[lo] else middle + 1))
            stack += [(cut, hi), (lo, cut)]
            continue
        kept = np.ones(len(seen), bool)
        unlike = starts[~(own[units[lo:hi]] & graph.listed[nodes[lo:hi]])]
        if unlike.size:
            led = _led_to(graph, starts, np.intersect1d(unlike, again)) if again.size else again
            kept[np.searchsorted(seen, np.setdiff1d(unlike, led))] = False
        unit = seen // size
        node = seen - unit * size
        kept &= graph.seeds[node]
        yield unit[kept], node[kept]


def _led_to(graph: Graph, starts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The asked starts that another start of the same unit leads to: on a cycle a start comes back to itself."""
    size, found = graph.size, []
    unit = starts // size
    for key in asked:
        others = np.unique(starts[(unit == key // size) & (starts != key)])
        if others.size and np.isin(key, _met(graph, others, 2**60)[0]):
            found.append(key)
    return np.array(found, np.int64)


def handed(df: DataFrame, graph: Graph) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(graph)
