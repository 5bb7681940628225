"""Groups of mutually similar vectors, each described by its size and its most typical members.

1. Vectors are dealt into blocks of bounded size by kd-trees over random directions. Where there are several blocks, this is
   done in 2 + 1.5 log2(blocks) rounds with other directions, so that two near ones meet in some block. Exact copies go as one.
2. In a block, neighbour descent builds the graph of nearest neighbours: from the leaves of a random projection forest,
   then by comparing the neighbours of neighbours until little changes. Its edges are the pairs that reach the limit.
3. Communities maximise modularity, by moving nodes and contracting. An exact check of all pairs within a community takes
   out what isn't similar to all others; communities with similar typical members become one if all their pairs are similar.
4. A community's typical members are those of highest internal weighted degree.
5. Several blocks: the communities of all blocks and rounds, linked by common points and by edges, are again joined by moves
   that raise the modularity, then by a search of each typical member's neighbours among the others. Two communities of
   different blocks are in one group only if their typical members are similar, each to each other.

Defined results: points without a valid vector belong to no group; a group of exact copies is a group if a copy is similar
to itself; an empty table gives no groups. On equal degrees the smaller id is the more typical. Where similarity isn't
transitive, several divisions are possible: communities are kept, and of what isn't similar to all others the most typical
first take those that fit, so that within a block every two of a group are similar.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, join_counted
from . import spaces
from .knn import Cells, Space, _binary, by_collection, fit, projection, sampled, search_cell, search_groups, trees_of, unpack
from .spaces import Params

#: Rows of a block that the rounds aim at; neighbours kept of a row; ids listed of a group of copies.
BLOCK, NEIGHBOURS, COPIES = 131072, 8, 30
#: The forest that starts the descent: trees, rows of a leaf. Rounds of descent at most, and neighbours joined in each.
_TREES, _LEAF, _ROUNDS, _SAMPLE = 12, 256, 4, 5
#: The confidence of the search of typical members' neighbours.
CONFIDENCE = 0.999
#: Neighbours searched of a typical member in a pass; rounds of moves on the graph of block communities.
_FEW, _MOVES = 8, 12
#: Random directions of a round, of which each cut takes the widest.
_DIRECTIONS = 8


def _unit(v: np.ndarray, p: Params) -> np.ndarray:
    """Vectors as trees see them: directions where the score is a product, else places around the middle."""
    if p.larger_better:
        return v / np.linalg.norm(v, axis=1, keepdims=True).astype(np.float32)
    return v - v.mean(axis=0, dtype=np.float64).astype(np.float32)


class Likeness:
    """Approximate scores in single precision, larger better, to guide the descent; exact ones decide about edges."""

    def __init__(self, v: np.ndarray, p: Params):
        self.p = p
        self.v = _unit(v, p) if p.distance == "Cosine" else v
        self.squares = np.einsum("ij,ij->i", self.v, self.v)
        self.exact = v
        # The Euclidean distance is no more than that of Manhattan, so that nothing similar lies beyond.
        self.limit = p.limit - 1e-4 if p.larger_better else -((p.limit + 1e-4) ** 2) - 1e-3 * float(self.squares.mean() if len(v) else 0) * 1e-3

    def of(self, i: np.ndarray, j: np.ndarray, step: int = 1 << 18) -> np.ndarray:
        out = np.empty(len(i), np.float32)
        for a in range(0, len(i), step):
            out[a : a + step] = np.einsum("ij,ij->i", self.v[i[a : a + step]], self.v[j[a : a + step]])
        return out if self.p.larger_better else 2 * out - self.squares[i] - self.squares[j]

    def within(self, leaf: np.ndarray) -> np.ndarray:
        """Of all pairs within each row of leaf."""
        x = self.v[leaf]
        s = x @ x.transpose(0, 2, 1)
        return s if self.p.larger_better else 2 * s - self.squares[leaf][:, :, None] - self.squares[leaf][:, None, :]


def _leaves(unit: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows split at medians of random projections down to leaves of equal size; the last ones of a leaf may be repeated."""
    n = len(unit)
    levels = max(0, math.ceil(math.log2(n / _LEAF)))
    size = -(-n // (1 << levels))
    order = np.resize(rng.permutation(n), size << levels)[None, :]
    for _ in range(levels):
        direction = rng.standard_normal(unit.shape[1]).astype(np.float32)
        at = unit @ direction
        half = order.shape[1] // 2 if order.shape[1] % 2 == 0 else None
        if half is None:
            break
        order = np.take_along_axis(order, np.argpartition(at[order], half, axis=1), axis=1).reshape(-1, half)
    return order


def _merge(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k most similar different ids of each row; -1 where there are fewer."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    sims = np.where(again | (ids < 0), -np.inf, sims)
    best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
    return np.where(np.isfinite(sims), ids, -1), sims


def _fold(n: int, k: int, i: np.ndarray, j: np.ndarray, sims: np.ndarray, ids: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Takes candidate neighbours j of i into the lists; and how many of those came in."""
    good = (sims > best[i, -1]) & (i != j)
    i, j, sims = i[good], j[good], sims[good]
    if not len(i):
        return ids, best, 0
    order = np.lexsort((-sims, i))
    i, j, sims = i[order], j[order], sims[order]
    first = np.maximum.accumulate(np.where(np.r_[True, i[1:] != i[:-1]], np.arange(len(i)), 0))
    rank = np.arange(len(i)) - first
    keep = rank < 2 * k
    i, j, sims, rank = i[keep], j[keep], sims[keep], rank[keep]
    rows, at = np.unique(i, return_inverse=True)
    more_ids = np.full((len(rows), 2 * k), -1, np.int64)
    more = np.full((len(rows), 2 * k), -np.inf, np.float32)
    more_ids[at, rank], more[at, rank] = j, sims
    old = ids[rows]
    new_ids, new = _merge(np.concatenate([old, more_ids], 1), np.concatenate([best[rows], more], 1), k)
    changed = int((~(new_ids[:, :, None] == old[:, None, :]).any(2) & (new_ids >= 0)).sum())
    ids, best = ids.copy(), best.copy()
    ids[rows], best[rows] = new_ids, new
    return ids, best, changed


def neighbour_graph(v: np.ndarray, p: Params, k: int = NEIGHBOURS, seed: int = 1, trees: int = _TREES, rounds: int = _ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (i, j, score) with i < j of the approximate graph of the k nearest neighbours, those that reach the limit."""
    n, rng, like = len(v), np.random.default_rng(seed), Likeness(v, p)
    unit = _unit(v, p)
    k = min(k, max(1, n - 1))
    ids, best = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf, np.float32)
    for tree in range(trees if n > _LEAF else 1):
        leaves = _leaves(unit, rng)
        for a in range(0, len(leaves), 32):
            leaf = leaves[a : a + 32]
            sims = like.within(leaf)
            sims[:, np.arange(leaf.shape[1]), np.arange(leaf.shape[1])] = -np.inf
            flat, rows = sims.reshape(-1, leaf.shape[1]), leaf.ravel()
            if tree < 2:
                near = np.argpartition(-flat, min(k, flat.shape[1] - 1), axis=1)[:, :k]
                at = np.repeat(np.arange(len(flat)), near.shape[1]), near.ravel()
            else:
                hit = np.flatnonzero(flat >= like.limit)
                at = hit // flat.shape[1], hit % flat.shape[1]
                crowded = np.flatnonzero(np.bincount(at[0], minlength=len(flat)) > k)
                if len(crowded):
                    near = np.argpartition(-flat[crowded], k, axis=1)[:, :k]
                    plain = ~np.isin(at[0], crowded)
                    at = np.r_[at[0][plain], np.repeat(crowded, k)], np.r_[at[1][plain], near.ravel()]
            i, j = rows[at[0]], leaf[at[0] // leaf.shape[1], at[1]]
            ids, best, _ = _fold(n, k, i, j, flat[at], ids, best)
    fresh = np.ones((n, k), bool)
    for _ in range(rounds if n > _LEAF else 0):
        # The local join: neighbours of a row, in both directions, may be neighbours of each other; one of a pair is new.
        i, c = np.nonzero((ids >= 0) & fresh)
        new = np.r_[i, ids[i, c]], np.r_[ids[i, c], i]
        i, c = np.nonzero(ids >= 0)
        old = np.r_[i, ids[i, c]], np.r_[ids[i, c], i]
        new, old = _sampled(n, *new, rng), _sampled(n, *old, rng)
        x = np.repeat(new[:, :, None], old.shape[1], 2).reshape(-1)
        y = np.repeat(old[:, None, :], new.shape[1], 1).reshape(-1)
        ok = (x >= 0) & (y >= 0) & (x != y)
        pair = np.unique(np.minimum(x[ok], y[ok]) * n + np.maximum(x[ok], y[ok]))
        x, y = pair // n, pair % n
        sims = like.of(x, y)
        before = ids
        ids, best, changed = _fold(n, k, np.r_[x, y], np.r_[y, x], np.r_[sims, sims], ids, best)
        fresh = ~(ids[:, :, None] == before[:, None, :]).any(2)
        if changed < 0.002 * n * k:
            break
    i, c = np.nonzero(best >= like.limit)
    j = ids[i, c]
    pair = np.unique(np.minimum(i, j) * n + np.maximum(i, j))
    i, j = pair // n, pair % n
    score = np.concatenate([spaces.scores(v[i[a : a + 100_000]].astype(np.float64), v[j[a : a + 100_000]].astype(np.float64), p) for a in range(0, len(i), 100_000)]) if len(i) else np.empty(0)
    good = spaces.reaches(score, p)
    return i[good], j[good], score[good]


def _sampled(n: int, i: np.ndarray, j: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A few of the j of each i, as a matrix filled up with -1."""
    order = rng.permutation(len(i))
    order = order[np.argsort(i[order].astype(np.int32), kind="stable")]
    i, j = i[order], j[order]
    out = np.full((n, _SAMPLE), -1, np.int64)
    if len(i):
        rank = np.arange(len(i)) - np.maximum.accumulate(np.where(np.r_[True, i[1:] != i[:-1]], np.arange(len(i)), 0))
        keep = rank < _SAMPLE
        out[i[keep], rank[keep]] = j[keep]
    return out


def weights(score: np.ndarray, p: Params) -> np.ndarray:
    """Of edges, from their scores; always positive."""
    return np.maximum(score, 1e-3) if p.larger_better else 1 / (1 + score)


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node that each node is linked with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def communities(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, loops: np.ndarray | None = None, total: float | None = None, seed: int = 1) -> np.ndarray:
    """Labels of communities that maximise modularity: nodes move to the best one near, then communities become nodes.

    loops: weight within each node, from an earlier contraction; total: the weight of the whole graph, if this is a part.
    Nodes are moved a random half at a time, as if in parallel, as long as the modularity grows.
    """
    rng = np.random.default_rng(seed)
    loops = np.zeros(n) if loops is None else loops
    total = total or float(w.sum() + loops.sum())
    mapping = np.arange(n)
    while len(i) and total > 0:
        size = len(loops)
        degree = np.bincount(i, w, size) + np.bincount(j, w, size) + 2 * loops
        label, source, target, weight = np.arange(size), np.r_[i, j], np.r_[j, i], np.r_[w, w]
        idle = 0
        for _ in range(60):
            volume = np.bincount(label, degree, size)
            code = source * size + label[target]
            kinds, at = np.unique(code, return_inverse=True)
            links = np.bincount(at, weight)
            node, other = kinds // size, kinds % size
            own = label[node] == other
            rest = volume[other] - np.where(own, degree[node], 0)
            gain = links - degree[node] * rest / (2 * total)
            stay = np.zeros(size)
            stay -= degree * (volume[label] - degree) / (2 * total)
            stay[node[own]] = gain[own]
            order = np.lexsort((other, -gain, node))
            head = order[np.r_[True, node[order][1:] != node[order][:-1]]]
            move = (gain[head] > stay[node[head]] + 1e-12) & (other[head] != label[node[head]])
            # A pair of single nodes may not swap places.
            swap = (label[node[head]] == node[head]) & (other[head] > label[node[head]]) & (np.bincount(label, minlength=size)[other[head]] == 1) & (np.bincount(label, minlength=size)[label[node[head]]] == 1)
            move &= ~swap
            if not move.any():
                break
            chosen = move & (rng.random(len(head)) < 0.6)
            if not chosen.any():
                idle += 1
                if idle > 3:
                    break
                continue
            label[node[head[chosen]]] = other[head[chosen]]
        kinds, label = np.unique(label, return_inverse=True)
        mapping = label[mapping]
        if len(kinds) == size:
            break
        a, b = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        loops = np.bincount(label, loops, len(kinds)) + np.bincount(a[a == b], w[a == b], len(kinds))
        code, at = np.unique(a[a != b] * len(kinds) + b[a != b], return_inverse=True)
        w, i, j = np.bincount(at, w[a != b]) if len(code) else np.empty(0), code // len(kinds), code % len(kinds)
    return mapping


def _unlike(a: np.ndarray, b: np.ndarray, p: Params) -> np.ndarray:
    """Whether each row of a isn't similar to each of b: by a product in single precision, near the limit by the exact score."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), bool)
    if p.distance == "Cosine":
        a, b = _unit(a, p), _unit(b, p)
    like = a @ b.T
    if p.larger_better:
        scale = 1.0 if p.distance == "Cosine" else float(np.linalg.norm(a, axis=1).max() * np.linalg.norm(b, axis=1).max())
        edge, far = like < p.limit + 1e-5 * (1 + scale), like < p.limit - 1e-5 * (1 + scale)
    else:
        square = np.maximum(0, np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2 * like)
        slack = 1e-5 * (1 + float(np.einsum("ij,ij->i", a, a).max() + np.einsum("ij,ij->i", b, b).max()))
        # A Manhattan distance is between the Euclidean one and that times the root of the number of components.
        times = 1.0 if p.distance == "Euclid" else p.size
        edge, far = square * times > p.limit * p.limit - slack * times, square > p.limit * p.limit + slack
    i, j = np.nonzero(edge & ~far)
    for at in range(0, len(i), 200_000):
        x, y = i[at : at + 200_000], j[at : at + 200_000]
        far[x, y] = ~spaces.reaches(spaces.scores(a[x].astype(np.float64), b[y].astype(np.float64), p), p)
    return far


def _all_alike(a: np.ndarray, b: np.ndarray, p: Params, step: int = 2048) -> bool:
    return not any(_unlike(a[n : n + step], b, p).any() for n in range(0, len(a), step))


def _spans(label: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """The rows of each label, by rank."""
    order = np.lexsort((rank, label))
    return np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(order) else []


def cliques(v: np.ndarray, label: np.ndarray, rank: np.ndarray, p: Params, step: int = 2048) -> np.ndarray:
    """Labels of sets every two of which are similar: what isn't similar to all others of its label is dealt out by rank.

    Rows that are similar to all others stay together; of the rest, which differ among each other only, the first by rank
    and those that go with all taken before join them, then the next ones make sets of their own.
    """
    label, following = label.copy(), int(label.max()) + 1 if len(label) else 0
    for rows in _spans(label, rank):
        if len(rows) < 3:  # two are an edge of the graph or a pair whose score was taken
            if len(rows) == 2 and _unlike(v[rows[:1]], v[rows[1:]], p).any():
                label[rows[1]], following = following, following + 1
            continue
        x = v[rows] if p.larger_better else v[rows] - v[rows[0]]
        bad = np.concatenate([_unlike(x[n : n + step], x, p).any(axis=1) for n in range(0, len(x), step)])
        left, first = np.flatnonzero(bad), True
        while len(left):
            chosen, open_ = [], left
            while len(open_):
                chosen.append(open_[0])
                open_ = open_[1:][~_unlike(x[open_[:1]], x[open_[1:]], p)[0]]
            if not first or bad.all() and chosen[0] != left[0]:
                label[rows[chosen]], following = following, following + 1
            first = False
            left = np.setdiff1d(left, chosen, assume_unique=True)
    return label


def _heads(label: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first by rank of each label, in the order of labels."""
    order = np.lexsort((rank, label))
    return order[np.r_[True, np.diff(label[order]) != 0]] if len(order) else order


def unite(v: np.ndarray, label: np.ndarray, rank: np.ndarray, p: Params) -> np.ndarray:
    """Joins sets of which all pairs are similar. Sets whose first rows are similar are tried, those of the best ranks first."""
    label = np.unique(label, return_inverse=True)[1]
    tried: set[tuple[int, int]] = set()
    todo = np.arange(int(label.max()) + 1 if len(label) else 0)
    while len(todo) > 1:
        heads = _heads(label, rank)
        names = label[heads]
        some = np.flatnonzero(np.isin(names, todo))
        pairs = _near_heads(v[heads], v[heads[some]], some, p)
        sets = {int(label[rows[0]]): rows for rows in _spans(label, rank)}
        grown: dict[int, int] = {}
        for a, b in sorted({(min(x, y), max(x, y)) for x, y in zip(names[pairs[0]].tolist(), names[pairs[1]].tolist())}, key=lambda t: (min(rank[sets[t[0]][0]], rank[sets[t[1]][0]]), t)):
            while a in grown:
                a = grown[a]
            while b in grown:
                b = grown[b]
            if a == b or (min(a, b), max(a, b)) in tried:
                continue
            tried.add((min(a, b), max(a, b)))
            if _all_alike(v[sets[a]], v[sets[b]], p):
                both = np.concatenate([sets[a], sets.pop(b)])
                sets[a], grown[b] = both[np.argsort(rank[both], kind="stable")], a
                label[sets[a]] = a
                tried = {t for t in tried if a not in t}
        # Only a set that has grown may have new partners, or one of which not all near heads were listed.
        full = np.bincount(pairs[0], minlength=len(names)) >= _FEW
        todo = np.unique(np.array([*{x for x in grown.values() if x in sets}], np.int64)) if grown else np.empty(0, np.int64)
        if grown and full.any():
            todo = np.unique(np.r_[todo, label[heads[full]]])
    return label


def _near_heads(v: np.ndarray, asked: np.ndarray, places: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(row, row) of v, the first of those asked about, that are similar: the best few of each."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    band, few = spaces.bands(v, p), replace(p, top_k=_FEW)
    for b in np.unique(band):
        here = np.flatnonzero(band == b)
        space = Space("", int(b), few, float(np.linalg.norm(v[here].astype(np.float64), axis=1).max()))
        ask = np.flatnonzero(space.may_ask(asked))
        if len(ask):
            matrix = projection(p.size + (p.distance == "Dot"), int(b) % 1000)
            q, at, _ = search_cell(space, matrix, here, v[here], np.zeros(len(here), bool), places[ask], asked[ask], CONFIDENCE)
            found.append((places[ask[q]], here[at]))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


_MEMBER, _LINK, _TYPICAL = 0, 1, 2
_PARTS = "kind tinyint, coll string, round int, a long, b long, w double, ids array<long>, vector binary"


def _deal(scan: DataFrame, counts: dict[str, int], params: dict[str, Params], block: int, seed: int):
    """Rows to blocks: (collection number, round, block).

    The blocks of a round are the cells of a tree over random projections, cut at quantiles of a sample, so that they are of
    like size even where a third of all rows lies close together.
    """
    plans: dict[str, list[tuple[np.ndarray, Cells]]] = {}
    for place, (name, n) in enumerate(sorted(counts.items())):
        cells = -(-n // block)
        rng = np.random.default_rng((seed, place))
        sample = np.zeros((0, params[name].size), np.float32)
        if cells > 1:
            u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(sampled(n, block) * (1 << 30)))
            sample = np.array([r[0] for r in scan.where((F.col("coll") == name) & u).select("vector").collect()], np.float32).reshape(-1, params[name].size)
        matrices = [rng.standard_normal((params[name].size, _DIRECTIONS)).astype(np.float32) for _ in range(trees_of(cells))]
        plans[name] = [(m, Cells.fit(_direction(sample, params[name]) @ m, cells)) for m in matrices]
    names = sorted(counts)

    def deal(batches):
        for batch in batches:
            ids = batch.column("ids")
            for name, rows, v in by_collection(batch, {n: params[n] for n in names}):
                data = np.ascontiguousarray(v).view(f"V{4 * v.shape[1]}").ravel()
                for number, (matrix, cells) in enumerate(plans[name]):
                    code = cells.place(_direction(v, params[name]) @ matrix)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), names.index(name), np.int32)), pa.array(np.full(len(rows), number, np.int32)), pa.array(code.astype(np.int32)), ids.take(pa.array(rows)), _binary(data)], names=["space", "round", "block", "ids", "vector"])

    return deal, "space int, round int, block int, ids array<long>, vector binary", names


def _direction(v: np.ndarray, p: Params) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True).astype(np.float32) if p.larger_better else v


def block_groups(v: np.ndarray, first: np.ndarray, copies: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, label, degree) of the groups of a block, and its edges by places in rows. copies: rows that are a group by themselves."""
    i, j, score = neighbour_graph(v, p) if len(v) > 1 else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    w, nodes = weights(score, p), np.unique(np.r_[i, j, copies])
    i, j = np.searchsorted(nodes, i), np.searchsorted(nodes, j)
    label = communities(len(nodes), i, j, w)

    def degrees() -> np.ndarray:
        inner = label[i] == label[j]
        return np.bincount(i[inner], w[inner], len(nodes)) + np.bincount(j[inner], w[inner], len(nodes))

    for change in (cliques, unite):
        degree = degrees()
        rank = np.empty(len(nodes), np.int64)
        rank[np.lexsort((first[nodes], -degree))] = np.arange(len(nodes))
        label = change(v[nodes], label, rank, p)
    return nodes, label, degrees(), (i, j, w)


def _work(names: list[str], params: dict[str, Params], several: set[str]):
    """A block's rows to its members of communities; where a collection has several blocks, also the links between these and their typical members."""
    schema = pa.schema([("kind", pa.int8()), ("coll", pa.string()), ("round", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64()), ("ids", pa.list_(pa.int64())), ("vector", pa.binary())])

    def rows(kind: int, coll: str, number: int, a, b, w, ids=None, vector=None) -> pa.Table:
        n = len(a)
        return pa.Table.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array([coll] * n, pa.string()), pa.array(np.full(n, number, np.int32)), pa.array(a), pa.array(b), pa.array(w), ids if ids is not None else pa.nulls(n, pa.list_(pa.int64())), vector if vector is not None else pa.nulls(n, pa.binary())], schema=schema)

    def work(table: pa.Table) -> pa.Table:
        name, number = names[table.column("space")[0].as_py()], table.column("round")[0].as_py()
        p = params[name]
        lists = table.column("ids").combine_chunks()
        length = lists.value_lengths().to_numpy(zero_copy_only=False)
        first = lists.flatten().to_numpy(zero_copy_only=False)[np.r_[0, np.cumsum(length)[:-1]]]
        order = np.argsort(first, kind="stable")  # the same result whatever the order of arrival
        lists, first, length, v = lists.take(pa.array(order)), first[order], length[order], unpack(table.column("vector"), p.size)[order]
        copies = np.flatnonzero(length > 1)
        if len(copies):
            copies = copies[spaces.reaches(spaces.scores(v[copies].astype(np.float64), v[copies].astype(np.float64), p), p)]
        nodes, label, degree, (i, j, w) = block_groups(v, first, copies, p)
        if name not in several and len(nodes):
            # What is left alone is no group.
            size = np.bincount(label, length[nodes])
            kept = np.flatnonzero(size[label] > 1)
            nodes, label, degree = nodes[kept], label[kept], degree[kept]
        if not len(nodes):
            return schema.empty_table()
        smallest = np.full(int(label.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, label, first[nodes])
        community, ids = smallest[label], first[nodes]
        out = [rows(_MEMBER, name, number, ids, community, degree, lists.take(pa.array(nodes)))]
        if name in several:
            a, b = np.minimum(community[i], community[j]), np.maximum(community[i], community[j])
            kinds, at = np.unique(np.stack([a, b]), axis=1, return_inverse=True) if len(a) else (np.empty((2, 0), np.int64), np.empty(0, np.int64))
            heads = _heads(label, np.lexsort((ids, -degree)).argsort())
            data = np.ascontiguousarray(v[nodes[heads]]).view(f"V{4 * v.shape[1]}").ravel()
            out += [rows(_LINK, name, number, kinds[0], kinds[1], np.bincount(at.ravel(), w) if len(a) else np.empty(0)), rows(_TYPICAL, name, number, ids[heads], community[heads], degree[heads], None, _binary(data))]
        return pa.concat_tables(out)

    return work


def clusters(points: DataFrame, params: dict[str, Params], block: int = BLOCK, seed: int = 11) -> DataFrame:
    """(coll, cluster_id, id, degree): a row for each member of a group; degree is its internal weighted degree, summed over the rounds.

    points has id, collection_name, vector and version, of which the current rows count. cluster_id is the smallest id.
    """
    scan = spaces.fitting(points.select("id", F.col("collection_name").alias("coll"), "vector"), params)
    counts = {r[0]: r[1] for r in scan.groupBy("coll").count().collect()}
    several = {n for n, size in counts.items() if size > block}
    valid = spaces.valid_points(points, params)
    deal, dealt, names = _deal(scan, counts, params, block, seed)
    blocks = spaces.classes(valid, COPIES).select("coll", "ids", "vector").mapInArrow(deal, dealt)
    parts = checkpoint(blocks.groupBy("space", "round", "block").applyInArrow(_work(names, params, several), _PARTS))
    members = parts.where(F.col("kind") == _MEMBER)
    alone = ~F.col("coll").isin(sorted(several)) if several else F.lit(True)
    # A collection of one block has its groups as they are.
    result = _expanded(members.where(alone).select("coll", F.col("a").alias("rep"), F.col("b").alias("cluster_id"), F.col("w").alias("degree"), "ids"), valid)
    if several:
        joined = _expanded(_over_blocks(parts.where(~alone), params), valid)
        found = joined.groupBy("coll", "cluster_id").agg(F.min("id").alias("smallest"), F.count("*").alias("n")).where("n > 1")
        result = result.unionByName(join_counted(joined, found, ["coll", "cluster_id"], "n").drop("cluster_id", "n").withColumnRenamed("smallest", "cluster_id"))
    return result.select("coll", "cluster_id", "id", "degree")


def _expanded(members: DataFrame, valid: DataFrame) -> DataFrame:
    """A row for each point from those of groups of copies (coll, rep, cluster_id, degree, ids)."""
    more = F.size("ids") > COPIES + 1
    rows = members.where(~more).select("coll", "cluster_id", "degree", F.explode("ids").alias("id"))
    large = members.where(more).drop("ids")
    if large.isEmpty():
        return rows
    return rows.unionByName(spaces.overflow_members(valid, COPIES, large).select("coll", "cluster_id", "degree", F.col("member").alias("id")))


def _over_blocks(parts: DataFrame, params: dict[str, Params]) -> DataFrame:
    """(coll, rep, cluster_id, degree, ids) of the members of block communities, these joined over all blocks and rounds."""
    members = parts.where(F.col("kind") == _MEMBER).select("coll", "round", "a", "b", "w", "ids")
    nodes = parts.where(F.col("kind") == _TYPICAL).select("coll", "round", "b", "a", "w", "vector")
    nodes = checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))
    of = lambda side, name: nodes.select(F.col("round").alias(f"r{side}"), F.col("b").alias(f"b{side}"), F.col("node").alias(name))
    links = parts.where(F.col("kind") == _LINK).select(F.col("round").alias("r1"), F.col("a").alias("b1"), F.col("round").alias("r2"), F.col("b").alias("b2"), "w")
    # A point seen in several rounds links its communities there, as strongly as it is tied to its own.
    seen = members.groupBy("a").agg(F.min_by(F.struct("round", "b"), "round").alias("f"))
    same = members.join(seen, "a").where(F.col("round") > F.col("f.round"))
    again = same.groupBy(F.col("f.round").alias("r1"), F.col("f.b").alias("b1"), F.col("round").alias("r2"), F.col("b").alias("b2")).agg((F.sum("w") + F.count("*") * 0.5).alias("w"))
    edges = checkpoint(links.unionByName(again).join(of(1, "s"), ["r1", "b1"]).join(of(2, "t"), ["r2", "b2"]).select("s", "t", "w"))
    label = _moved(nodes, edges)

    # Exact check: a community whose typical member isn't similar to that of the heaviest stays by itself.
    heavy = nodes.join(label, "node").groupBy("label").agg(F.max_by(F.struct("node", "vector"), F.struct("w", -F.col("a"))).alias("h"))
    near = nodes.join(label, "node").join(heavy, "label").select("node", "coll", "w", "a", "vector", F.when(_like(params)("coll", "vector", "h.vector"), F.col("h.node")).otherwise(F.col("node")).alias("cluster"))
    near = checkpoint(near)
    typical = near.groupBy("coll", "cluster").agg(F.max_by("vector", F.struct("w", -F.col("a"))).alias("data"), F.max("w").alias("w"))
    typical = checkpoint(typical.select("coll", "cluster", "w", _floats("data").alias("vector")))
    last = near.join(_merged(typical.select("cluster"), typical, params), "cluster")
    last = checkpoint(last.groupBy("last").applyInArrow(_each_to_each(params), "node long, last long"))

    # A community has as many members as a block has rows at most.
    name = last.join(nodes.select("node", "round", "b"), "node").select("round", "b", "last")
    where = members.join(name, ["round", "b"])
    return checkpoint(where.groupBy("coll", F.col("a").alias("rep")).agg(F.min_by("last", "round").alias("cluster_id"), F.sum("w").alias("degree"), F.min_by("ids", "round").alias("ids")))


def _moved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): communities of the graph of nodes, which move to the neighbouring label that raises the modularity most.

    A hash picks which of them move in a round, so that two don't swap places; it ends when none would, or after _MOVES.
    """
    label = nodes.select("node", F.col("node").alias("label"))
    total = edges.agg(F.sum("w")).first()[0] or 0.0
    if total <= 0:
        return label
    both = edges.where("s <> t").select("s", "t", "w").unionByName(edges.where("s <> t").select(F.col("t").alias("s"), F.col("s").alias("t"), "w"))
    both = both.groupBy("s", "t").agg(F.sum("w").alias("w"))
    ends = edges.select(F.col("s").alias("node"), "w").unionByName(edges.select(F.col("t").alias("node"), "w"))
    degree = checkpoint(ends.groupBy("node").agg(F.sum("w").alias("degree")))
    for turn in range(_MOVES):
        placed = label.join(degree, "node")
        volume = placed.groupBy("label").agg(F.sum("degree").alias("volume"))
        reach = both.join(label.select(F.col("node").alias("t"), "label"), "t").groupBy("s", "label").agg(F.sum("w").alias("links"))
        # A node's own label is a choice like the others, with no links at least.
        choice = reach.unionByName(placed.select(F.col("node").alias("s"), "label", F.lit(0.0).alias("links"))).groupBy("s", "label").agg(F.sum("links").alias("links"))
        choice = choice.join(volume, "label").join(placed.select(F.col("node").alias("s"), F.col("label").alias("own"), "degree"), "s")
        rest = F.col("volume") - F.when(F.col("label") == F.col("own"), F.col("degree")).otherwise(0.0)
        gain = F.round(F.col("links") - F.col("degree") * rest / (2 * total), 9)
        best = choice.groupBy(F.col("s").alias("node")).agg(F.max_by("label", F.struct(gain, (F.col("label") == F.col("own")).cast("int"), -F.col("label"))).alias("to"))
        moves = F.col("to").isNotNull() & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(10)) < 6)
        new = checkpoint(label.join(best, "node", "left").select("node", F.when(moves, F.col("to")).otherwise(F.col("label")).alias("label"), (F.col("to") != F.col("label")).alias("wants")))
        label = new.select("node", "label")
        if new.where("wants").isEmpty():
            break
    return label


def _like(params: dict[str, Params]):
    """Whether two binary vectors of a collection are similar."""
    from pyspark.sql import types as T

    @F.arrow_udf(T.BooleanType())
    def like(coll: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        names, out = np.array(coll.to_pylist(), object), np.zeros(len(coll), bool)
        for name in set(names.tolist()):
            p, rows = params[name], np.flatnonzero(names == name)
            x, y = (np.stack([np.frombuffer(c[int(n)].as_py(), np.float32) for n in rows]).astype(np.float64) for c in (a, b))
            out[rows] = spaces.reaches(spaces.scores(x, y, p), p)
        return pa.array(out)

    return like


def _each_to_each(params: dict[str, Params]):
    """The communities of a joined group, as one if their typical members are similar each to each, else as several. There
    are as many as blocks and rounds that a group lies in, not as members."""
    schema = pa.schema([("node", pa.int64()), ("last", pa.int64())])

    def split(table: pa.Table) -> pa.Table:
        p = params[table.column("coll")[0].as_py()]
        node, w = table.column("node").to_numpy(), table.column("w").to_numpy()
        v = np.stack([np.frombuffer(x, np.float32) for x in table.column("vector").to_pylist()])
        rank = np.empty(len(node), np.int64)
        rank[np.lexsort((table.column("a").to_numpy(), -w))] = np.arange(len(node))
        label = cliques(v, np.zeros(len(node), np.int64), rank, p)
        smallest = np.full(int(label.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, label, node)
        return pa.table({"node": node, "last": smallest[label]}, schema=schema)

    return split


def _floats(column: str):
    """Binary vectors as arrays again."""
    from pyspark.sql import types as T

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def floats(data: pa.Array) -> pa.Array:
        rows = [np.frombuffer(x, np.float32) for x in data.to_pylist()]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)), pa.array(np.concatenate(rows) if rows else np.empty(0, np.float32)))

    return floats(F.col(column))


def _merged(names: DataFrame, heads: DataFrame, params: dict[str, Params], few: int = _FEW) -> DataFrame:
    """(cluster, last): clusters joined whose typical members (coll, cluster, w, vector) are similar, under the smallest id.

    A pass finds a few neighbours of each member. Where they may not be all, the heaviest member of each joined cluster is
    searched again, until no similar pair is left; a cluster whose members' neighbours are all known has none beside those.
    """
    bounded = {n: replace(p, top_k=few) for n, p in params.items()}
    label = names.select("cluster", F.col("cluster").alias("last"))
    while True:
        rows = heads.select("coll", F.array("cluster").alias("ids"), "vector")
        fitted = fit(heads.select("coll", F.col("cluster").alias("id"), "vector"), bounded)
        pairs = checkpoint(search_groups(rows, fitted, CONFIDENCE).select("id", "near").where("id <> near"))
        if pairs.isEmpty():
            return label
        joined = checkpoint(_settled(heads.select("cluster"), pairs))
        after = joined.select(F.col("cluster").alias("last"), F.col("last").alias("next"))
        label = checkpoint(label.join(after, "last", "left").select("cluster", F.coalesce("next", "last").alias("last")))
        full = pairs.groupBy("id").count().where(F.col("count") >= few).select(F.col("id").alias("cluster"))
        again = joined.join(full, "cluster", "left_semi").select("last").distinct()
        best = F.max_by("vector", F.struct("w", -F.col("cluster"))).alias("vector")
        heads = heads.join(joined, "cluster").join(again, "last", "left_semi").groupBy("coll", "last").agg(F.max("w").alias("w"), best)
        heads = checkpoint(heads.select("coll", F.col("last").alias("cluster"), "w", "vector"))
        if heads.isEmpty():
            return label


def _settled(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cluster, last): clusters joined by pairs of them, under the smallest id."""
    pairs = checkpoint(pairs.where("id <> near"))
    if pairs.isEmpty():
        return names.select("cluster", F.col("cluster").alias("last"))
    both = pairs.unionByName(pairs.select(F.col("near").alias("id"), F.col("id").alias("near"))).distinct()
    label = both.select("id").distinct().select(F.col("id"), F.col("id").alias("last"))
    while True:
        near = both.join(label.select(F.col("id").alias("near"), "last"), "near").groupBy("id").agg(F.min("last").alias("other"))
        new = checkpoint(label.join(near, "id").select("id", F.least("last", "other").alias("last"), F.col("last").alias("was")))
        done = new.where("last <> was").isEmpty()
        label = new.select("id", "last")
        if done:
            break
    return names.join(label, names["cluster"] == label["id"], "left").select("cluster", F.coalesce("last", "cluster").alias("last"))


def describe(members: DataFrame, typical: int = 3) -> DataFrame:
    """(coll, cluster_id, size, typical): size and most typical members of each group."""
    from pyspark.sql import Window

    order = Window.partitionBy("cluster_id").orderBy(F.col("degree").desc(), "id")
    top = members.withColumn("n", F.row_number().over(order)).where(f"n <= {typical}")
    best = top.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("typical"))
    return members.groupBy("coll", "cluster_id").agg(F.count("*").alias("size")).join(best, "cluster_id").select("coll", "cluster_id", "size", "typical")
