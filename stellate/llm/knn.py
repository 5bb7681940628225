"""The k best neighbours of every vector, by low-dimensional stable projections indexed by kd-trees.

Vectors are projected by a Gaussian matrix, so that the squared distance of two projections, divided by the true one,
follows a chi-square law. An upper kd-tree, fitted on a sample, cuts each space into cells of bounded size. In a cell, a
kd-tree of the projections gives the candidates leaf by leaf, those first in which a neighbour within reach most likely lies;
candidates are verified on the whole vectors until the leaves left hold one with a probability below 1 - confidence, and
those that the chi-square test puts too far away to improve the result, with the same confidence, aren't verified.

Where a space has several cells, a border may part two neighbours. It is cut by several trees, each of another projection,
and every row goes to its cell of every tree: 2 + 1.5 log2(cells) copies of a row, whatever thresholds or distances are. No
row is compared with what lies in other cells, so work grows as n log n. All rows are indexed and all are queries. Groups
of exact copies are searched once. Recall is measured in the tests.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from . import spaces
from .spaces import Params

#: The probability that a stop leaves out no better neighbour within a cell, of the choice of leaves and of candidates each.
CONFIDENCE = 0.999
#: Rows of a cell that the trees aim at; rows sampled for each cell to fit them, and for the first ones of a space.
CELL, SAMPLED, SAMPLE = 131072, 16, 4096
_LEAF, _BATCH = 256, 8192


def trees_of(cells: int) -> int:
    """How many trees cut a space of so many cells."""
    return 1 if cells < 2 else 2 + math.ceil(1.5 * math.log2(cells))


def sampled(rows: int, cell: int) -> float:
    """The share of rows to sample: none where one cell is enough."""
    return min(1.0, (SAMPLE + SAMPLED * -(-rows // cell)) / rows) if rows > cell else 0.0


@dataclass
class Cells:
    """An upper kd-tree over a projection: for each split its dimension, border, and what is on either side (a split, or ~cell)."""

    dim: np.ndarray
    border: np.ndarray
    sides: np.ndarray
    count: int

    @staticmethod
    def fit(sample: np.ndarray, cells: int) -> Cells:
        splits: list[list[float]] = []
        count = 0

        def grow(rows: np.ndarray, parts: int) -> int:
            nonlocal count
            dim = int(np.argmax(rows.std(axis=0))) if parts > 1 and len(rows) > 1 else -1
            border = float(np.quantile(rows[:, dim], (parts - parts // 2) / parts)) if dim >= 0 else 0.0
            side = rows[:, dim] < border
            if dim < 0 or side.all() or not side.any():
                count += 1
                return -count
            at = len(splits)
            splits.append([dim, border, 0, 0])
            splits[at][2], splits[at][3] = grow(rows[side], parts - parts // 2), grow(rows[~side], parts // 2)
            return at

        grow(sample.astype(np.float64), cells)
        made = np.array(splits, np.float64).reshape(-1, 4)
        return Cells(made[:, 0].astype(np.int64), made[:, 1], made[:, 2:].astype(np.int64), count)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        at = np.zeros(len(rows), np.int64) if len(self.dim) else np.full(len(rows), -1, np.int64)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            at[open_] = self.sides[node, (rows[open_, self.dim[node]] >= self.border[node]).astype(np.int64)]
        return -1 - at


def width_of(size: int) -> int:
    """Dimensions of a projection."""
    return max(4, min(24, size // 3))


def projection(size: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, width_of(size))).astype(np.float32)


@dataclass
class Space:
    """A band of a collection."""

    coll: str
    band: int
    params: Params
    most: float

    def stored(self, v: np.ndarray) -> np.ndarray:
        return spaces.stored(v, self.params, self.most)

    def asked(self, v: np.ndarray) -> np.ndarray:
        return spaces.asked(v, self.params, self.most)

    def may_ask(self, v: np.ndarray) -> np.ndarray:
        """Whether anything of this band can reach the limit from each vector."""
        lengths = np.linalg.norm(v.astype(np.float64), axis=1)
        return np.broadcast_to(spaces.squared_reach(np.asarray(self.params.limit), lengths, self.params, self.most), (len(v),)) >= 0


@dataclass
class Cut:
    """One tree of a space. salts: how many tasks share the queries of each cell."""

    space: Space
    matrix: np.ndarray
    cells: Cells
    salts: np.ndarray


def vectors_of(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float32, copy=False)


def by_collection(batch: pa.RecordBatch, params: dict[str, Params]):
    """(name, row numbers, vectors) of the collections in a batch with columns coll and vector."""
    names = np.array(batch.column("coll").to_pylist(), object)
    for name in params:
        rows = np.flatnonzero(names == name)
        if len(rows):
            yield name, rows, vectors_of(batch.column("vector").take(pa.array(rows)))


def fit(rows: DataFrame, params: dict[str, Params], cell: int = CELL, seed: int = 7) -> list[Cut]:
    """The trees of rows (coll, id, vector), from the count and greatest length of each band and a sample of it.

    Rows may be more than those searched later. The sample, by a hash of the id, has SAMPLED rows a cell beside the first
    SAMPLE; the driver thus gets one row of cell / SAMPLED, and the tasks three numbers a cell.
    """
    counts = {r[0]: r[1] for r in rows.select("coll").groupBy("coll").count().collect() if r[0] in params}
    share = {name: sampled(n, cell) for name, n in counts.items()}
    schema = pa.schema([("coll", pa.string()), ("band", pa.int32()), ("n", pa.int64()), ("most", pa.float64()), ("data", pa.binary())])

    def measure(batches):
        for batch in batches:
            for name, at, v in by_collection(batch, params):
                band, length = spaces.bands(v, params[name]), np.linalg.norm(v.astype(np.float64), axis=1)
                drawn = batch.column("u").to_numpy(zero_copy_only=False)[at] < share.get(name, 0.0)
                for b in np.unique(band):
                    here = band == b
                    yield pa.RecordBatch.from_pylist([{"coll": name, "band": int(b), "n": int(here.sum()), "most": float(length[here].max()), "data": v[here & drawn].tobytes()}], schema=schema)

    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u")
    measured = rows.select("coll", "vector", u).mapInArrow(measure, "coll string, band int, n long, most double, data binary")
    parts = F.filter(F.collect_list("data"), lambda x: F.length(x) > 0)
    found = measured.groupBy("coll", "band").agg(F.sum("n"), F.max("most"), parts).orderBy("coll", "band").collect()
    drawn = {(name, band): np.frombuffer(b"".join(data), np.float32).reshape(-1, params[name].size) for name, band, _, _, data in found}
    result = []
    for place, (name, band, n, most, _) in enumerate(found):
        space, cells = Space(name, band, params[name], most), -(-n // cell)
        every = np.concatenate([v for (other, _), v in drawn.items() if other == name])
        every = every[space.may_ask(every)] if len(every) else every
        for tree in range(trees_of(cells)):
            matrix = projection(params[name].size + (params[name].distance == "Dot"), seed + 1000 * tree + place)
            made = Cells.fit(space.stored(drawn[name, band]) @ matrix, cells)
            # Queries of other bands may crowd in a cell: tasks share them, each with the cell's rows.
            asked = np.bincount(made.place(space.asked(every) @ matrix), minlength=made.count) if len(every) else np.zeros(made.count)
            result.append(Cut(space, matrix, made, np.maximum(1, np.ceil(asked / max(share[name], 1e-12) / (2 * cell))).astype(np.int64)))
    return result


_ROUTED = "cut int, cell int, salt int, role tinyint, ids array<long>, vector binary"
_DATA, _QUERY = 1, 2


def _route(fitted: list[Cut]):
    """Rows to the cells where they are found (in each salt) and to those where they ask (in one); role tells which, or both."""
    params = {c.space.coll: c.space.params for c in fitted}

    def rows_of(n: int, at, cell, salt, role, ids, place, data):
        columns = [pa.array(np.full(len(at), n, np.int32)), pa.array(cell.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(np.full(len(at), role, np.int8)), ids.take(pa.array(place[at])), _binary(data[at])]
        return pa.RecordBatch.from_arrays(columns, names=["cut", "cell", "salt", "role", "ids", "vector"])

    def route(batches):
        for batch in batches:
            ids = batch.column("ids")
            first = ids.flatten().to_numpy(zero_copy_only=False)[np.r_[0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))[:-1]].astype(np.int64)] if len(ids) else None
            for name, place, v in by_collection(batch, params):
                data = np.ascontiguousarray(v).view(f"V{4 * v.shape[1]}").ravel()
                band = spaces.bands(v, params[name])
                mixed = (first[place].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
                for n, cut in enumerate(fitted):
                    if cut.space.coll != name:
                        continue
                    own, asks = band == cut.space.band, cut.space.may_ask(v)
                    home, goes = np.full(len(v), -1), np.full(len(v), -1)
                    home[own] = cut.cells.place(cut.space.stored(v[own]) @ cut.matrix)
                    goes[asks] = cut.cells.place(cut.space.asked(v[asks]) @ cut.matrix) if params[name].distance == "Dot" else home[asks]
                    once = cut.salts[goes] == 1
                    both = np.flatnonzero(own & asks & (home == goes) & once)
                    found = np.flatnonzero(own & ~(asks & (home == goes) & once))
                    ask = np.flatnonzero(asks & ~(own & (home == goes) & once))
                    times = cut.salts[home[found]]
                    copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    found = np.repeat(found, times)
                    for at, cell, salt, role in ((both, home[both], np.zeros(len(both), np.int64), _DATA | _QUERY), (found, home[found], copy, _DATA), (ask, goes[ask], mixed[ask] % cut.salts[goes[ask]], _QUERY)):
                        if len(at):
                            yield rows_of(n, at, cell, salt, role, ids, place, data)

    return route


def _binary(rows: np.ndarray) -> pa.Array:
    size = rows.dtype.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def unpack(column: pa.ChunkedArray, size: int) -> np.ndarray:
    parts = [np.frombuffer(c.buffers()[2], np.float32, count=len(c) * size, offset=4 * size * c.offset) if len(c) else np.empty(0, np.float32) for c in column.chunks]
    return np.concatenate(parts).reshape(-1, size)


class Leaves:
    """A kd-tree of a cell's projections, in leaves of a few hundred rows; order lists the rows leaf by leaf."""

    def __init__(self, rows: np.ndarray, leaf: int = _LEAF):
        self.cells = Cells.fit(rows, -(-len(rows) // leaf))
        at = self.cells.place(rows)
        self.order = np.argsort(at, kind="stable")
        self.ends = np.searchsorted(at[self.order], np.arange(self.cells.count + 1))
        # The box of each split.
        self.low, self.high = (np.full((max(1, len(self.cells.dim)), rows.shape[1]), x) for x in (-np.inf, np.inf))
        for node, (dim, border, sides) in enumerate(zip(self.cells.dim, self.cells.border, self.cells.sides)):
            for side, below in enumerate(sides):
                if below >= 0:
                    self.low[below], self.high[below] = self.low[node], self.high[node]
                    (self.low if side else self.high)[below, dim] = border

    def likely(self, places: np.ndarray, reach: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, rank): for each query the fewest leaves in which a neighbour at the given distance lies with this confidence.

        By the projection's law such a neighbour is spread around the query's place as a normal variable in each dimension.
        """
        query, mass = np.flatnonzero(reach >= 0), np.ones(np.count_nonzero(reach >= 0))
        node = np.zeros(len(query), np.int64) if len(self.cells.dim) else np.full(len(query), -1, np.int64)
        scale = np.sqrt(2 * np.maximum(reach, 1e-12))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(query):
            leaf = node < 0
            done.append((query[leaf], -1 - node[leaf], mass[leaf]))
            query, node, mass = query[~leaf], node[~leaf], mass[~leaf]
            dim = self.cells.dim[node]
            x, wide = places[query, dim], scale[query]
            low, high, border = (_erf((edge - x) / wide) for edge in (self.low[node, dim], self.high[node, dim], self.cells.border[node]))
            whole = high - low
            left = np.where(whole > 1e-12, np.clip((border - low) / np.where(whole > 1e-12, whole, 1), 0, 1), x < self.cells.border[node])
            query, mass = np.r_[query, query], np.r_[mass * left, mass * (1 - left)]
            node = np.r_[self.cells.sides[node, 0], self.cells.sides[node, 1]]
            likely = mass > (1 - confidence) / self.cells.count / 2
            query, node, mass = query[likely], node[likely], mass[likely]
        query, leaf, mass = (np.concatenate([d[n] for d in done]) for n in range(3))
        order = np.lexsort((-mass, query))
        query, leaf, mass = query[order], leaf[order], mass[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else query
        size = np.diff(np.r_[first, len(query)])
        before = np.cumsum(mass) - mass
        before -= np.repeat(before[first], size)
        rank = np.arange(len(query)) - np.repeat(first, size)
        kept = (before < confidence * np.repeat(np.add.reduceat(mass, first), size)) if len(query) else before > 0
        return query[kept], leaf[kept], rank[kept]


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function, to seven digits, by the approximation of Abramowitz and Stegun, 7.1.26."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    y = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-np.minimum(x * x, 700))
    return np.where(x < 0, -y, y)


class Best:
    """The k best of each query so far, on equal scores the smaller id."""

    def __init__(self, k: int, larger: bool):
        self.k, self.sign = k, -1.0 if larger else 1.0
        self.query, self.id, self.place, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, query: np.ndarray, ids: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = np.concatenate([self.query, query]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        place = np.concatenate([self.place, place])
        order = np.lexsort((ids, self.sign * score, query))
        query = query[order]
        start = np.maximum.accumulate(np.where(np.r_[True, query[1:] != query[:-1]], np.arange(len(query)), 0)) if len(query) else query
        # A pair may come twice.
        again = np.r_[False, (query[1:] == query[:-1]) & (ids[order[1:]] == ids[order[:-1]])] if len(query) else np.empty(0, bool)
        keep = (np.arange(len(query)) - start - (np.cumsum(again) - np.cumsum(again)[start] if len(query) else 0) < self.k) & ~again
        kept = order[keep]
        self.query, self.id, self.place, self.score = query[keep], ids[kept], place[kept], score[kept]

    def worst(self, queries: int, otherwise: float) -> np.ndarray:
        """The score that a new one must reach: the k-th best where there are k, else as given."""
        full = np.bincount(self.query, minlength=queries) == self.k
        last = np.full(queries, otherwise)
        if len(self.query):
            ends = np.flatnonzero(np.r_[self.query[1:] != self.query[:-1], True])
            last[self.query[ends]] = self.score[ends]
        return np.where(full, last, otherwise)


def search_cell(s: Space, matrix: np.ndarray, ids: np.ndarray, data: np.ndarray, multi: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of data, score), by their places: the queries' best that reach the limit. A group of copies (multi) may be its own neighbour."""
    p, k = s.params, s.params.top_k + 1
    rows, places = s.stored(data) @ matrix, s.asked(queries) @ matrix
    far = spaces.chi_square_quantile(confidence, rows.shape[1])
    tree = Leaves(rows)
    ids, multi, rows, data = ids[tree.order], multi[tree.order], rows[tree.order], data[tree.order]
    # A product of these with (-2q, 1, |q|^2 - reach) is the squared distance less what a query reaches.
    wide = np.concatenate([rows, np.einsum("ij,ij->i", rows, rows)[:, None], np.ones((len(rows), 1), np.float32)], axis=1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for begin in range(0, len(places), _BATCH):
        q, raw, own = places[begin : begin + _BATCH], queries[begin : begin + _BATCH].astype(np.float64), query_ids[begin : begin + _BATCH]
        lengths, squares = np.linalg.norm(raw, axis=1), np.einsum("ij,ij->i", q, q)
        best = Best(k, p.larger_better)
        reach = np.array(np.broadcast_to(spaces.squared_reach(np.asarray(p.limit), lengths, p, s.most), (len(q),)), np.float64)

        def look(who: np.ndarray, leaf: np.ndarray, few: bool) -> None:
            """Looks up queries in leaves; few: only the nearest projections, which tell how far a query has to reach."""
            nonlocal reach
            order = np.argsort(leaf, kind="stable")
            who, leaf = who[order], leaf[order]
            hits: list[tuple[np.ndarray, np.ndarray]] = []
            waiting = 0
            allowed = (reach * far * (1 + 1e-5) + 1e-6).astype(np.float32)
            for at in np.split(np.arange(len(who)), np.flatnonzero(np.diff(leaf)) + 1) if len(who) else ():
                a, z = tree.ends[leaf[at[0]]], tree.ends[leaf[at[0]] + 1]
                some = who[at]
                ask = np.concatenate([-2 * q[some], np.ones((len(some), 1), np.float32), (squares[some] - allowed[some])[:, None]], axis=1)
                over = ask @ wide[a:z].T
                if few and z - a > 4 * k:
                    near = np.argpartition(over, 4 * k, axis=1)[:, : 4 * k]
                    i, j = np.nonzero(np.take_along_axis(over, near, 1) <= 0)
                    j = near[i, j]
                else:
                    i, j = np.nonzero(over <= 0)
                hits.append((some[i], j + a))
                waiting += len(i)
                if waiting > 1_000_000:
                    _verify(best, *(np.concatenate([h[n] for h in hits]) for n in range(2)), ids, data, multi, raw, own, p)
                    hits, waiting = [], 0
                    reach = np.minimum(reach, spaces.squared_reach(best.worst(len(q), p.limit), lengths, p, s.most))
                    allowed = (reach * far * (1 + 1e-5) + 1e-6).astype(np.float32)
            if hits:
                _verify(best, *(np.concatenate([h[n] for h in hits]) for n in range(2)), ids, data, multi, raw, own, p)
            reach = np.minimum(reach, spaces.squared_reach(best.worst(len(q), p.limit), lengths, p, s.most))

        # The leaf of the query itself tells how far it has to reach; then the leaves follow, the likely ones first.
        asks = np.flatnonzero(reach >= 0)
        look(asks, tree.cells.place(q[asks]), True)
        who, leaf, rank = tree.likely(q, reach, confidence)
        for low, high in ((0, 8), (8, 64), (64, tree.cells.count)):
            here = (rank >= low) & (rank < high)
            look(who[here], leaf[here], False)
        out.append((begin + best.query, best.place, best.score))
    query, place, score = (np.concatenate([o[n] for o in out]) for n in range(3))
    return query, tree.order[place], score


def _verify(best: Best, query, place, ids, data, multi, raw, own, p: Params, most: int = 200_000) -> None:
    """Scores pairs of queries and candidates by their whole vectors."""
    other = (ids[place] != own[query]) | multi[place]
    query, place = query[other], place[other]
    for a in range(0, len(query), most):
        i, j = query[a : a + most], place[a : a + most]
        score = spaces.scores(raw[i], data[j].astype(np.float64), p)
        good = spaces.reaches(score, p)
        best.add(i[good], ids[j[good]], j[good], score[good])


_FOUND = "coll string, id long, members array<long>, near long, score double"


def _search(fitted: list[Cut], confidence: float):
    names = ["coll", "id", "members", "near", "score"]
    schema = pa.schema([("coll", pa.string()), ("id", pa.int64()), ("members", pa.list_(pa.int64())), ("near", pa.int64()), ("score", pa.float64())])

    def search(table: pa.Table) -> pa.Table:
        cut = fitted[table.column("cut")[0].as_py()]
        s = cut.space
        role, v = table.column("role").to_numpy(), unpack(table.column("vector"), s.params.size)
        ids = table.column("ids").combine_chunks()
        length = ids.value_lengths().to_numpy(zero_copy_only=False)
        flat, start = ids.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(length)[:-1]]
        first = flat[start]
        data, ask = np.flatnonzero(role & _DATA), np.flatnonzero(role & _QUERY)
        if not len(data) or not len(ask):
            return schema.empty_table()
        query, place, score = search_cell(s, cut.matrix, first[data], v[data], length[data] > 1, first[ask], v[ask], confidence)
        query, place = ask[query], data[place]
        # Groups of copies give their ids; of these, again, the best.
        times = length[place]
        near = flat[np.repeat(start[place], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        query, score = np.repeat(query, times), np.repeat(score, times)
        best = Best(s.params.top_k + 1, s.params.larger_better)
        best.add(query, near, near, score)
        return pa.Table.from_arrays([pa.array([s.coll] * len(best.id), pa.string()), pa.array(first[best.query]), ids.take(pa.array(best.query)), pa.array(best.id), pa.array(best.score)], names=names)

    return search


def search_groups(groups: DataFrame, fitted: list[Cut], confidence: float = CONFIDENCE) -> DataFrame:
    """Of groups of copies (coll, ids, vector) the top_k + 1 best ids of each, itself included if it has several: (coll, id, members, near, score)."""
    if not fitted:
        return groups.sparkSession.createDataFrame([], _FOUND)
    rows = groups.select("coll", "ids", "vector").mapInArrow(_route(fitted), _ROUTED)
    found = rows.groupBy("cut", "cell", "salt").applyInArrow(_search(fitted, confidence), _FOUND)
    return _best(found, {c.space.coll: c.space.params for c in fitted}, ["coll", "id"], 1)


def _best(rows: DataFrame, params: dict[str, Params], key: list[str], extra: int) -> DataFrame:
    """The best top_k + extra of each key; on equal scores the smaller near first. What several trees have found counts once."""
    larger, most = F.lit(False), F.lit(0)
    for name, p in params.items():
        most = F.when(F.col("coll") == name, p.top_k + extra).otherwise(most)
        larger = F.when(F.col("coll") == name, p.larger_better).otherwise(larger)
    order = Window.partitionBy(*key).orderBy(F.when(larger, -F.col("score")).otherwise(F.col("score")), "near")
    ranked = rows.withColumn("_rank", F.dense_rank().over(order))
    # A fixed bound beside that of the collection lets ranks be cut before the shuffle.
    ranked = ranked.where(F.col("_rank") <= max([p.top_k for p in params.values()], default=0) + extra).where(F.col("_rank") <= most)
    again = F.lag("near").over(order).eqNullSafe(F.col("near"))
    return ranked.withColumn("_again", again).where("not _again").drop("_rank", "_again")


def neighbours(points: DataFrame, params: dict[str, Params], confidence: float = CONFIDENCE, **options) -> DataFrame:
    """(coll, id, near, score): for each point its top_k best others of the collection, of which those that reach the limit.

    points has id, collection_name, vector and version, of which the current rows count. An empty table gives an empty
    result, as does a collection of one point.
    """
    most = max([p.top_k for p in params.values()], default=1)
    scan = points.select("id", F.col("collection_name").alias("coll"), "vector")
    fitted = fit(spaces.fitting(scan, params), params, **options)
    valid = spaces.valid_points(points, params)
    found = checkpoint(search_groups(spaces.classes(valid, most), fitted, confidence))
    # All members of a group of copies have the group's neighbours, without themselves.
    more = F.size("members") > most + 1
    listed = found.where(~more).select("coll", "id", F.explode("members").alias("member"), "near", "score").where("member <> near")
    result = _best(listed, params, ["coll", "id", "member"], 0)
    large = found.where(more)
    if not large.isEmpty():
        near = large.groupBy("coll", F.col("id").alias("rep")).agg(F.collect_list(F.struct("near", "score")).alias("all"))
        members = spaces.overflow_members(valid, most, near).select("coll", F.col("rep").alias("id"), "member", F.inline("all")).where("member <> near")
        result = result.unionByName(_best(members, params, ["coll", "id", "member"], 0))
    return result.select("coll", F.col("member").alias("id"), "near", "score")


def neighbour_pairs(points: DataFrame, params: dict[str, Params], **options) -> DataFrame:
    """(id_low, id_high): each pair of which at least one is a neighbour of the other, once."""
    found = neighbours(points, params, **options)
    return found.select(F.least("id", "near").alias("id_low"), F.greatest("id", "near").alias("id_high")).distinct()
