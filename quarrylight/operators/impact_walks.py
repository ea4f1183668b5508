"""What changed tables affect, found from the affected assets: a task walks up the handed graph from its assets.

A unit is an asset with all that is known of it and the tables it reads (starts). No pair of a table and an asset is
shuffled: a task counts, sums and ranks for every table what its own units add, and only that is dealt out by table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast

from quarrylight.operators.handed_graph import Graph, closures

#: Lists of an answer by cut_order: reports, tables, metrics, unresolved IDs; counted beside them: broken assets, people.
LISTS, BROKEN, TOLD = 4, 5, 6
#: Rows that a task gathers before it puts them together, and rows of one Arrow batch.
GATHERED, BATCH = 4_000_000, 200_000
NO_USAGE = -(2**62)

SUMS, DEPARTMENTS, PEOPLE, ITEMS, PARTIAL = range(5)
#: Rows of a digest; what they mean depends on kind.
#: SUMS: a task's count n and characters of a list. DEPARTMENTS: its n people and their m reports, label the people's
#: departments as JSON. PEOPLE: its first people, label their ID, with n reports and m metrics. ITEMS: its first items
#: of a list by (place, position). PARTIAL: as PEOPLE, but all, each from a part of the person's assets.
DIGEST = (
    "kind int, table_id string, cut_order int, label string, place long, position long, n long, m long, chars long,"
    " usage long, fallback boolean"
)
CONTACTS = (
    "table_id string, employee_id string, report_count long, metric_count long, total_usage_30d long, via_fallback boolean, id_chars long"
)
_FIELDS = pa.schema([
    ("kind", pa.int32()), ("table_id", pa.string()), ("cut_order", pa.int32()), ("label", pa.string()), ("place", pa.int64()),
    ("position", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("chars", pa.int64()), ("usage", pa.int64()), ("fallback", pa.bool_()),
])


def _numbers(column: pa.Array, missing: int = 0) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(missing).to_numpy(zero_copy_only=False)


def _flags(column: pa.Array) -> np.ndarray:
    return column.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def portions(graph: Graph, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(units, nodes) of a batch with the columns type and starts: the tables whose change affects each unit."""
    lists = batch.column("starts")
    lengths = _numbers(pc.list_value_length(lists))
    units = np.repeat(np.arange(len(lists)), lengths)
    nodes = graph.positions(lists.flatten())
    own = ~_flags(pc.equal(batch.column("type"), "table"))
    there = nodes >= 0
    yield from closures(graph, units[there], nodes[there].astype(np.int64), own)


def pairs(handed: Broadcast, columns: list[str]) -> Callable:
    """Units to rows of (table_id, *columns), one for every table whose change affects the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = handed.value
        for batch in batches:
            told = batch.select(columns)
            for unit, node in portions(graph, batch):
                for at in range(0, len(unit), BATCH):
                    part = told.take(pa.array(unit[at:at + BATCH]))
                    tables = graph.ids.take(pa.array(node[at:at + BATCH]))
                    yield pa.RecordBatch.from_arrays([tables, *part.columns], names=["table_id", *columns])

    return run


class Sums:
    """Rows of numbers by key, summed; given back, put together, when there are too many."""

    def __init__(self, columns: int):
        self.parts, self.rows, self.columns = [], 0, columns

    def add(self, key: np.ndarray, *values: np.ndarray) -> None:
        if len(key):
            self.parts.append((key, *values))
            self.rows += len(key)

    def together(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(self.columns + 1))
        key, *values = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        merged = (key[first], *(np.add.reduceat(v[order], first) for v in values))
        self.parts, self.rows = [merged], len(first)
        return merged

    def full(self) -> bool:
        return self.rows > GATHERED and len(self.together()[0]) > GATHERED // 2

    def taken(self) -> tuple[np.ndarray, ...]:
        out = self.together()
        self.parts, self.rows = [], 0
        return out


class Firsts:
    """The first rows of each group by (a, b); rows behind the last of a group that is full are not gathered."""

    def __init__(self, groups: int, most: np.ndarray):
        self.parts, self.rows, self.most = [], 0, most
        self.bound = np.full(groups, 2**63 - 1, np.int64)

    def add(self, group: np.ndarray, a: np.ndarray, b: np.ndarray, *values: np.ndarray) -> None:
        near = a <= self.bound[group]
        if near.any():
            self.parts.append(tuple(c[near] for c in (group, a, b, *values)))
            self.rows += len(self.parts[-1][0])

    def together(self) -> tuple[np.ndarray, ...] | None:
        if not self.parts:
            return None
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        group, a, b = columns[:3]
        order = np.lexsort((b, a, group))
        group = group[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        most = self.most[group]
        order, last = order[rank < most], order[rank == most - 1]
        self.bound[columns[0][last]] = a[last]
        merged = tuple(c[order] for c in columns)
        self.parts, self.rows = [merged], len(order)
        return merged

    def full(self) -> bool:
        return self.rows > GATHERED and len(self.together()[0]) > GATHERED // 2

    def taken(self) -> tuple[np.ndarray, ...] | None:
        out = self.together()
        self.parts, self.rows = [], 0
        return out


class People:
    """What a task's units add for each (person, table). Units come with all of a person side by side; whoever came
    last may have more, so their rows wait."""

    def __init__(self, size: int):
        self.size, self.ids, self.open, self.departments = size, [], None, []

    def met(self, batch: pa.RecordBatch) -> np.ndarray:
        """Every unit's person as a number that ascends with the person's ID; for units to be told about alone."""
        told = np.flatnonzero(tells(batch))
        who, out = batch.column("notify_id").take(pa.array(told)).to_pylist(), np.full(len(batch), -1, np.int64)
        places = batch.column("departments").take(pa.array(told)) if "departments" in batch.schema.names else None
        number = []
        for at, person in enumerate(who):
            if not self.ids or person != self.ids[-1]:
                self.ids.append(person)
                self.departments.append(places[at].as_py() if places is not None else None)
            number.append(len(self.ids) - 1)
        out[told] = number
        return out

    def add(self, person: np.ndarray, node: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """(person, node, *sums) of the people who are over."""
        keys = person * self.size + node
        if self.open is not None:
            keys = np.concatenate([self.open[0], keys])
            values = [np.concatenate(c) for c in zip(self.open[1:], values, strict=True)]
        if not len(keys):
            return person, node, *values
        merged = _summed(keys, values)
        begin = int(np.searchsorted(merged[0], merged[0][-1] // self.size * self.size))
        self.open = tuple(c[begin:] for c in merged)
        return self._split(tuple(c[:begin] for c in merged))

    def rest(self) -> tuple[np.ndarray, ...] | None:
        out, self.open = self.open, None
        return None if out is None else self._split(out)

    def _split(self, rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        person = rows[0] // self.size
        return person, rows[0] - person * self.size, *rows[1:]


def _summed(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def tells(batch: pa.RecordBatch) -> np.ndarray:
    return _flags(batch.column("told")) & ~_flags(batch.column("broken"))


def _told_values(batch: pa.RecordBatch, unit: np.ndarray) -> list[np.ndarray]:
    """reports, metrics, usage, known usages, fallbacks, id_chars of the units, to be summed by person and table."""
    report = _flags(pc.equal(batch.column("type"), "report")).astype(np.int64)
    usage = batch.column("usage_30d")
    chars = _numbers(pc.utf8_length(batch.column("asset_id"))) + 2
    known = _flags(usage.is_valid()).astype(np.int64)
    fallback = (~_flags(batch.column("owner_resolved"))).astype(np.int64)
    return [c[unit] for c in (report, 1 - report, _numbers(usage), known, fallback, chars)]


def _contact_rows(graph: Graph, people: People, rows: tuple[np.ndarray, ...], names: list[str]) -> Iterator[pa.RecordBatch]:
    person, node, reports, metrics, usage, known, fallback, chars = rows
    ids = pa.array(people.ids, pa.string())
    for at in range(0, len(person), BATCH):
        cut = slice(at, at + BATCH)
        yield pa.RecordBatch.from_arrays([
            graph.ids.take(pa.array(node[cut])), ids.take(pa.array(person[cut])), pa.array(reports[cut]), pa.array(metrics[cut]),
            pa.array(usage[cut], mask=known[cut] == 0), pa.array(fallback[cut] > 0), pa.array(chars[cut]),
        ], names=names)


def contacts(handed: Broadcast) -> Callable:
    """Units, a person's side by side, to CONTACTS rows: each table's people with what concerns them."""
    names = ["table_id", "employee_id", "report_count", "metric_count", "total_usage_30d", "via_fallback", "id_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = handed.value
        people = People(graph.size)
        for batch in batches:
            person = people.met(batch)
            for unit, node in portions(graph, batch):
                told = person[unit] >= 0
                unit, node = unit[told], node[told]
                yield from _contact_rows(graph, people, people.add(person[unit], node, _told_values(batch, unit)), names)
        if (rest := people.rest()) is not None:
            yield from _contact_rows(graph, people, rest, names)

    return run


def digest(handed: Broadcast, most_items: list[int] | None, most_people: int, parted: bool, departments: bool = True) -> Callable:
    """Units, a person's side by side, to DIGEST rows. parted: a person's units may be in several tasks. ITEMS come
    where most_items is given, PEOPLE where most_people is not 0, DEPARTMENTS where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = handed.value
        size, people = graph.size, People(graph.size)
        count, chars = np.zeros((TOLD, size), np.int64), np.zeros((BROKEN, size), np.int64)
        items = Firsts(LISTS * size, np.repeat(np.array(most_items), size)) if most_items else Firsts(0, None)
        top = Firsts(size, np.full(size, most_people)) if most_people else Firsts(0, None)
        grouped, partial, labels = Sums(2), Sums(6), {}

        def rows(kind: int, node: np.ndarray, **columns) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(node), BATCH):
                cut = node[at:at + BATCH]
                given = {"kind": pa.repeat(pa.scalar(kind, pa.int32()), len(cut)), "table_id": graph.ids.take(pa.array(cut))}
                given |= {name: c(at, at + BATCH) if callable(c) else pa.array(c[at:at + BATCH]) for name, c in columns.items()}
                yield pa.RecordBatch.from_arrays(
                    [given[f.name].cast(f.type) if f.name in given else pa.nulls(len(cut), f.type) for f in _FIELDS], schema=_FIELDS
                )

        def person_rows(kind: int, person, node, reports, metrics, usage, known, fallback, id_chars) -> Iterator[pa.RecordBatch]:
            ids = pa.array(people.ids, pa.string())
            return rows(
                kind, node, label=lambda lo, hi: ids.take(pa.array(person[lo:hi])), n=reports, m=metrics,
                usage=lambda lo, hi: pa.array(usage[lo:hi], mask=known[lo:hi] == 0), fallback=fallback > 0, chars=id_chars,
            )

        def item_rows(taken) -> Iterator[pa.RecordBatch]:
            if taken is not None:
                group, place, position, long, known = taken
                place = np.where(group < size, place, 0)
                yield from rows(
                    ITEMS, group % size, cut_order=(group // size + 1).astype(np.int32), position=position, chars=long,
                    place=lambda lo, hi: pa.array(place[lo:hi], mask=known[lo:hi] == 0),
                )

        def top_rows(taken) -> Iterator[pa.RecordBatch]:
            if taken is not None:
                node, _, person, *values = taken
                yield from person_rows(PEOPLE, person, node, *values)

        def department_rows(taken) -> Iterator[pa.RecordBatch]:
            key, n, m = taken
            names = pa.array(list(labels), pa.string())
            yield from rows(DEPARTMENTS, key % size, label=lambda lo, hi: names.take(pa.array(key[lo:hi] // size)), n=n, m=m)

        def partial_rows(taken) -> Iterator[pa.RecordBatch]:
            yield from person_rows(PARTIAL, taken[0] // size, taken[0] % size, *taken[1:])

        def over(done) -> Iterator[pa.RecordBatch]:
            """People of whom this task has all there is here."""
            person, node, reports, metrics, usage, known, *more = done
            if not len(person):
                return
            if parted:
                partial.add(person * size + node, reports, metrics, usage, known, *more)
                if partial.full():
                    yield from partial_rows(partial.taken())
                return
            count[TOLD - 1] += np.bincount(node, minlength=size)
            if departments:
                low, high = int(person[0]), int(person[-1])
                code = np.array([labels.setdefault(people.departments[p], len(labels)) for p in range(low, high + 1)])
                grouped.add(*_summed(code[person - low] * size + node, [np.ones(len(node), np.int64), reports]))
                if grouped.full():
                    yield from department_rows(grouped.taken())
            if not most_people:
                return
            top.add(node, np.where(known > 0, -usage, 2**63 - 1), person, reports, metrics, usage, known, *more)
            if top.full():
                yield from top_rows(top.taken())

        for batch in batches:
            person = people.met(batch)
            kinds = batch.column("type")
            listed = [_flags(pc.equal(kinds, kind)) for kind in ("report", "table", "metric")]
            listed.append(_flags(batch.column("told")) & ~_flags(batch.column("owner_resolved")))
            listed.append(_flags(batch.column("broken")))
            plain = _numbers(pc.utf8_length(batch.column("asset_id"))) + 2
            long = [_numbers(batch.column("item_chars")), plain, plain, plain, plain]
            usage = batch.column("usage_30d")
            position = _numbers(batch.column("position")) if most_items else None
            known = _flags(usage.is_valid()).astype(np.int64)
            # NULL comes first, as in an ascending sort.
            place = np.where(known > 0, -_numbers(usage), -(2**63))
            for unit, node in portions(graph, batch):
                for at in range(BROKEN):
                    mine = listed[at][unit]
                    if not mine.any():
                        continue
                    u, n = unit[mine], node[mine]
                    size_of = long[at][u]
                    count[at] += np.bincount(n, minlength=size)
                    chars[at] += np.bincount(n, weights=size_of, minlength=size).astype(np.int64)
                    if most_items is None or at >= LISTS:
                        continue
                    if at == 0:
                        items.add(n, place[u], position[u], size_of, known[u])
                    else:
                        # Ordered by ID alone, all in place 0: what is behind the last position is not gathered.
                        items.add(at * size + n, position[u], position[u], size_of, np.ones(len(u), np.int64))
                    if items.full():
                        yield from item_rows(items.taken())
                told = person[unit] >= 0
                unit, node = unit[told], node[told]
                yield from over(people.add(person[unit], node, _told_values(batch, unit)))
        if (rest := people.rest()) is not None:
            yield from over(rest)
        for at in range(TOLD):
            node = np.flatnonzero(count[at])
            given = {"chars": chars[at][node]} if at < LISTS else {}
            yield from rows(SUMS, node, cut_order=np.full(len(node), at + 1, np.int32), n=count[at][node], **given)
        yield from department_rows(grouped.taken())
        yield from top_rows(top.taken())
        yield from item_rows(items.taken())
        yield from partial_rows(partial.taken())

    return run
