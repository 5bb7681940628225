"""The universal query: a tree of requests, each of which becomes a lazy DataFrame of ids and scores.

A request is a mapping: prefetch (a request or several, nested to any depth up to MAX_DEPTH), query, using, filter, params,
score_threshold, limit (None: all rows), offset, with_payload, with_vectors, lookup_from, shard_key (a value, several, or target
and fallback), seed. Other fields are refused. A query input is a vector, an id, or for a sparse vector a document ({"text": ...}),
which is embedded by BM25. Only what a request itself bounds comes to the
driver: the vectors of ids that it names, the examples of feedback, and the candidates of a diversity reranking.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..collection import Collection, Dense, Sparse
from ..filters import merge_filters
from ..functions import metrics, objectives
from ..functions.formula import Formula
from ..functions.jsonops import exclude, include
from ..functions.text import bm25_vector
from ..operators import fusion, mmr

MAX_DEPTH = 64
LIMIT = 10
#: Chosen rows that are broadcast to fetch their wide columns; more are joined by a shuffle.
FEW = 10_000
_FIELDS = {"prefetch", "query", "using", "filter", "params", "score_threshold", "limit", "offset", "with_payload", "with_vectors", "lookup_from", "shard_key", "seed"}
#: Candidates of a diversity reranking that a request may ask for.
MAX_CANDIDATES = 16384


@dataclass
class Ranked:
    """Rows (id, score); whether a greater score is better; whether the threshold itself is good enough."""

    df: DataFrame
    larger: bool = True
    inclusive: bool = False
    by_id: bool = False  # equal scores by ascending id
    key: str = "score"  # the column of the order

    def order(self) -> list[Column]:
        key = F.col(self.key)
        if self.by_id:
            return [key.desc(), F.col("id")]
        return [key.desc(), F.col("id").desc()] if self.larger else [key, F.col("id")]

    def over(self, threshold: float | None) -> Ranked:
        if threshold is None:
            return self
        s = F.col("score")
        good = (s >= threshold if self.inclusive else s > threshold) if self.larger else (s <= threshold if self.inclusive else s < threshold)
        return Ranked(self.df.where(good), self.larger, self.inclusive, self.by_id, self.key)

    def top(self, limit: int | None, offset: int = 0) -> Ranked:
        if limit is None and not offset:
            return self
        df = self.df.orderBy(*self.order())
        df = df if limit is None else df.limit(limit + offset)
        return Ranked(df.offset(offset) if offset else df, self.larger, self.inclusive, self.by_id, self.key)


def _listed(x) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def _is_vector(x) -> bool:
    return isinstance(x, dict) and "indices" in x or isinstance(x, list) and bool(x) and isinstance(x[0], (int, float, list))


def _is_document(x) -> bool:
    return isinstance(x, dict) and "text" in x


def _is_id(x) -> bool:
    return isinstance(x, (int, str)) and not isinstance(x, bool)


def _inputs(query) -> list:
    """All vector inputs (vectors or ids) of a query."""
    if query is None:
        return []
    if _is_vector(query) or _is_id(query) or _is_document(query):
        return [query]
    if not isinstance(query, dict):
        raise ValueError(f"no query: {query!r}")
    pairs = lambda c: [p[k] for p in _listed(c) for k in ("positive", "negative")]
    if "nearest" in query:
        return [query["nearest"]]
    if "recommend" in query:
        return _listed_inputs(query["recommend"].get("positive")) + _listed_inputs(query["recommend"].get("negative"))
    if "discover" in query:
        return [query["discover"]["target"], *pairs(query["discover"].get("context"))]
    if "context" in query:
        return pairs(query["context"])
    if "relevance_feedback" in query:
        f = query["relevance_feedback"]
        return [f["target"], *[x["example"] for x in f["feedback"]]]
    return []


def _listed_inputs(x) -> list:
    return [] if x is None else list(x)


class Query:
    """Compiles one request for a collection; others is where lookup_from finds collections by name."""

    def __init__(self, collection: Collection, request: dict, others: dict[str, Collection] | None = None):
        self._check(request, 0)
        self.c, self.request, self.others = self._of_shards(collection, request.get("shard_key")), request, others or {}
        self.points = self.c.df
        self.known: dict[tuple, object] = {}
        self.named: set = set()
        self.similar: dict[str, Column] = {}  # columns of similarities that the scores at hand refer to
        self._resolve()

    @staticmethod
    def _of_shards(c: Collection, wanted) -> Collection:
        """The points of some shard keys; a fallback counts where the target has no points."""
        if wanted is None:
            return c
        if c.shard_key is None:
            raise ValueError("the collection has no shard keys")
        of = lambda x: c.df.where(F.col(c.shard_key).isin(_listed(x)))
        if isinstance(wanted, dict):
            found = of(wanted["target"])
            return c.with_df(of(wanted["fallback"]) if wanted.get("fallback") is not None and found.isEmpty() else found)
        return c.with_df(of(wanted))

    # Validation ------------------------------------------------------------------------------------------------------

    def _check(self, r: dict, depth: int) -> None:
        if depth > MAX_DEPTH:
            raise ValueError(f"prefetches are nested deeper than {MAX_DEPTH}")
        if unknown := set(r) - _FIELDS:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        if depth and r.get("shard_key") is not None:
            raise ValueError("shard keys are chosen for the whole request")
        q, inner = r.get("query"), _listed(r.get("prefetch"))
        kind = next(iter(q)) if isinstance(q, dict) and "indices" not in q else None
        if inner and q is None:
            raise ValueError("a prefetch needs a query that uses it")
        if kind in ("fusion", "rrf", "formula") and not inner:
            raise ValueError(f"{kind} needs a prefetch")
        if kind in ("fusion", "rrf") and r.get("using"):
            raise ValueError("fusion uses no vector")
        if r.get("score_threshold") is not None and (q is None or kind == "order_by"):
            raise ValueError("a score threshold needs scores")
        limit = r.get("limit", LIMIT)
        if limit is not None and limit < 1 or r.get("offset", 0) < 0:
            raise ValueError("limit is 1 at least, offset 0")
        if limit is None and kind == "nearest" and q.get("mmr") is not None:
            raise ValueError("a diversity reranking needs a limit")
        if kind == "recommend" and q["recommend"].get("strategy", "average_vector") == "average_vector" and not q["recommend"].get("positive"):
            raise ValueError("an average needs a positive example")
        for x in inner:
            self._check(x, depth + 1)

    # Vectors of named ids --------------------------------------------------------------------------------------------

    def _resolve(self) -> None:
        wanted: dict[tuple[str, str], set] = {}

        def visit(r: dict) -> None:
            place = r.get("lookup_from") or {}
            where = place.get("collection", ""), place.get("vector") or r.get("using", "")
            for x in _inputs(r.get("query")):
                if _is_id(x):
                    wanted.setdefault(where, set()).add(x)
                    if not where[0]:
                        self.named.add(x)
            for inner in _listed(r.get("prefetch")):
                visit(inner)

        visit(self.request)
        for (name, using), ids in wanted.items():
            c = self.others[name] if name else self.c
            rows = c.df.where(F.col(c.id).isin(list(ids))).select(F.col(c.id), F.col(c.vector(using).column)).collect()
            for row in rows:
                self.known[name, using, row[0]] = row[1].asDict() if hasattr(row[1], "asDict") else row[1]
            missing = [i for i in ids if self.known.get((name, using, i)) is None]
            if missing:
                raise ValueError(f"points {sorted(map(str, missing))} have no vector {using!r}")

    def _vector(self, x, r: dict):
        if _is_document(x):
            if not isinstance(self.c.vector(r.get("using", "")), Sparse):
                raise ValueError("documents are embedded as sparse vectors only")
            return bm25_vector(x["text"], x.get("options"))
        if not _is_id(x):
            return x
        place = r.get("lookup_from") or {}
        return self.known[place.get("collection", ""), place.get("vector") or r.get("using", ""), x]

    # Compilation -----------------------------------------------------------------------------------------------------

    def ranked(self) -> Ranked:
        r = self.request
        root = r.get("filter")
        if self.named:
            root = merge_filters(root, {"must_not": [{"has_id": sorted(self.named, key=str)}]})
        return self._node(r, root, 0)

    def _node(self, r: dict, condition: dict | None, depth: int) -> Ranked:
        """A request's own rows: its prefetches' ids scored anew or fused, or all points that meet the condition."""
        q = r.get("query")
        limit, offset = r.get("limit", LIMIT), r.get("offset", 0) if depth == 0 else 0
        sources = [self._node(p, merge_filters(condition, p.get("filter")), depth + 1) for p in _listed(r.get("prefetch"))]
        if isinstance(q, dict) and ("fusion" in q or "rrf" in q):
            if q.get("fusion") == "dbsf":
                found = fusion.score_distribution([(s.df, s.larger) for s in sources])
            else:
                lists = [(s.df.select("id", F.col(s.key).alias("score")), s.larger) for s in sources]
                params = q.get("rrf") or {}
                found = fusion.reciprocal_rank(lists, params.get("k") or 2, params.get("weights"))
            return Ranked(found, inclusive=True, by_id=True).over(r.get("score_threshold")).top(limit, offset)
        if isinstance(q, dict) and "formula" in q:
            return self._formula(q, sources).over(r.get("score_threshold")).top(limit, offset)
        rows = self.c.where(condition)
        if sources:
            ids = reduce(DataFrame.unionByName, [s.df.select("id") for s in sources]).distinct()
            rows = rows.join(ids.withColumnRenamed("id", "_found"), F.col(self.c.id) == F.col("_found"), "left_semi")
        params = q.get("mmr") if isinstance(q, dict) and "nearest" in q else None
        if params is not None:
            return self._diverse(rows, r, q, params, limit, offset)
        return self.scored(rows, r).over(r.get("score_threshold")).top(limit, offset)

    def scored(self, rows: DataFrame, r: dict, extra: tuple[Column, ...] = ()) -> Ranked:
        """All rows with their scores, and other columns of theirs."""
        q, id_ = r.get("query"), F.col(self.c.id).alias("id")
        if q is None:
            return Ranked(rows.select(id_, F.lit(1.0).alias("score"), *extra), by_id=True)
        if isinstance(q, dict) and "sample" in q:
            return Ranked(rows.select(id_, F.lit(1.0).alias("score"), F.rand(r.get("seed")).alias("place"), *extra), key="place")
        if isinstance(q, dict) and "order_by" in q:
            return self._ordered(rows, q["order_by"], extra)
        self.similar = {}
        score, larger = self._score(q, r)
        target = self.c.vector(r.get("using", ""))
        rows = rows.where(F.col(target.column).isNotNull()).withColumns(self.similar)
        return Ranked(rows.select(id_, score.alias("score"), *extra).where("score IS NOT NULL"), larger)

    def _ordered(self, rows: DataFrame, spec, extra: tuple[Column, ...] = ()) -> Ranked:
        """Scores of 1, and order_value, of which a point shows its first; points without one are left out."""
        from ..operators.scroll import order_values

        spec = spec if isinstance(spec, dict) else {"key": spec}
        down = spec.get("direction") == "desc"
        values = order_values(self.c, spec)
        best = (F.array_max if down else F.array_min)(values).cast("double").alias("order_value")
        return Ranked(rows.select(F.col(self.c.id).alias("id"), F.lit(1.0).alias("score"), best, *extra).where("order_value IS NOT NULL"), larger=down, inclusive=True, key="order_value")

    def _score(self, q, r: dict) -> tuple[Column, bool]:
        target = self.c.vector(r.get("using", ""))
        if _is_document(q):
            q = {"nearest": q}
        if isinstance(target, Dense) and (_is_vector(q) or _is_id(q) or isinstance(q, dict) and "nearest" in q):
            x = self._vector(q["nearest"] if isinstance(q, dict) and "nearest" in q else q, r)
            return metrics.shown(self._similar([x], target)[0], target.distance), metrics.larger_better(target.distance)
        if isinstance(target, Sparse) and (_is_vector(q) or _is_id(q) or "nearest" in q):
            x = self._vector(q["nearest"] if isinstance(q, dict) and "nearest" in q else q, r)
            return self._sparse(x, target, (r.get("params") or {}).get("idf")), True
        if "recommend" in q:
            spec = q["recommend"]
            good = [self._vector(x, r) for x in _listed_inputs(spec.get("positive"))]
            bad = [self._vector(x, r) for x in _listed_inputs(spec.get("negative"))]
            strategy = spec.get("strategy", "average_vector")
            if strategy == "average_vector":
                return self._score(average(good, bad, isinstance(target, Dense) and target.multi), {**r, "lookup_from": None})
            cols = self._similar(good + bad, target)
            score = {"best_score": objectives.best_score, "sum_scores": objectives.sum_scores}[strategy]
            return self._if_present(score(cols[: len(good)], cols[len(good) :]), target), True
        if "discover" in q or "context" in q:
            spec = q.get("discover") or {"context": q["context"]}
            pairs = [(self._vector(p["positive"], r), self._vector(p["negative"], r)) for p in _listed(spec.get("context"))]
            head = [self._vector(spec["target"], r)] if "discover" in q else []
            cols = self._similar([*head, *[x for p in pairs for x in p]], target)
            both = cols[len(head) :]
            joined = list(zip(both[::2], both[1::2]))
            return self._if_present(objectives.discover(cols[0], joined) if head else objectives.context(joined), target), True
        if "relevance_feedback" in q:
            spec = q["relevance_feedback"]
            given = sorted(spec["feedback"], key=lambda x: -x["score"])
            cols = self._similar([self._vector(spec["target"], r), *[self._vector(x["example"], r) for x in given]], target)
            pairs = [(cols[i + 1], cols[j + 1], a["score"] - b["score"]) for i, a in enumerate(given) for j, b in enumerate(given) if a["score"] > b["score"]]
            n = spec["strategy"]["naive"]
            return self._if_present(objectives.feedback(cols[0], pairs, n["a"], n["b"], n["c"]), target), True
        raise ValueError(f"unknown query: {q!r}")

    def _similar(self, examples: list, target: Dense | Sparse) -> list[Column]:
        """The column of a point's similarity to each example."""
        if isinstance(target, Sparse):
            return [F.coalesce(metrics.sparse_product(F.col(target.column), x["indices"], x["values"]), F.lit(0.0)) for x in examples]
        if target.multi:
            found = metrics.max_similarities(F.col(target.column), [x if isinstance(x[0], list) else [x] for x in examples], target.distance)
        else:
            if any(len(x) != target.size for x in examples):
                raise ValueError(f"vectors of this name have the size {target.size}")
            found = metrics.similarities(F.col(target.column), examples, target.distance)
        name = f"_similar{len(self.similar)}"
        self.similar[name] = found
        return [F.get(name, F.lit(n)) for n in range(len(examples))]

    def _if_present(self, score: Column, target: Dense | Sparse) -> Column:
        return F.when(F.col(target.column).isNotNull(), score)

    def _sparse(self, x: dict, target: Sparse, idf: dict | None) -> Column:
        values = x["values"]
        if target.idf and x["indices"]:
            from ..operators.sparse import inverse_frequencies

            corpus = self.c.where((idf or {}).get("corpus"))
            found = inverse_frequencies(corpus, target.column, x["indices"])
            values = [v * found[i] for i, v in zip(x["indices"], values)]
        return metrics.sparse_product(F.col(target.column), x["indices"], values)

    def _formula(self, q: dict, sources: list[Ranked]) -> Ranked:
        """All ids of the prefetches with their scores there, which the formula combines with the payload."""
        tagged = reduce(DataFrame.unionByName, [s.df.select("id", F.lit(n).alias("n"), "score") for n, s in enumerate(sources)])
        scores = tagged.groupBy("id").agg(*[F.max(F.when(F.col("n") == n, F.col("score"))).alias(f"_s{n}") for n in range(len(sources))])
        rows = self.points.join(scores.withColumnRenamed("id", "_found"), F.col(self.c.id) == F.col("_found"))
        made = Formula(self.c.scope(), lambda n: F.col(f"_s{n}") if n < len(sources) else None, q.get("defaults"))
        return Ranked(rows.select(F.col(self.c.id).alias("id"), made.column(q["formula"]).alias("score")), inclusive=True, by_id=True)

    def _diverse(self, rows: DataFrame, r: dict, q: dict, params: dict, limit: int, offset: int) -> Ranked:
        many = params.get("candidates_limit") or max(limit + offset, LIMIT)
        if many > MAX_CANDIDATES:
            raise ValueError(f"at most {MAX_CANDIDATES} candidates")
        target = self.c.vector(r.get("using", ""))
        plain = {**r, "query": {"nearest": q["nearest"]}}
        best = self.scored(rows, plain).over(r.get("score_threshold")).top(many)
        vectors = self.points.select(F.col(self.c.id).alias("_id"), F.col(target.column).alias("_v"))
        chosen_ = F.broadcast(best.df) if many <= FEW else best.df
        found = vectors.join(chosen_, F.col("id") == F.col("_id")).select("id", "score", "_v").collect()
        found.sort(key=lambda x: (-x[1], x[0]) if best.larger else (x[1], x[0]))
        matrix = np.array([x[2] for x in found], np.float64).reshape(len(found), -1)
        like = metrics.similarity_matrix(matrix, np.asarray([self._vector(q["nearest"], r)]), target.distance)[:, 0] if len(found) else np.zeros(0)
        diversity = params.get("diversity")
        chosen = mmr.rerank(matrix, like, target.distance, 0.5 if diversity is None else diversity, limit + offset)[offset:]
        spark = self.points.sparkSession
        kind = self.points.schema[self.c.id].dataType.simpleString()
        result = spark.createDataFrame([(found[n][0], float(found[n][1]), place) for place, n in enumerate(chosen)], f"id {kind}, score double, place int")
        return _Placed(result)

    def single_vector(self) -> list[float] | None:
        """The one dense vector that a request without prefetch and with a limit compares with, if that is all it does."""
        r, q = self.request, self.request.get("query")
        if q is None or r.get("prefetch") or r.get("limit", LIMIT) is None or r.get("lookup_from"):
            return None
        target = self.c.vector(r.get("using", ""))
        if not isinstance(target, Dense) or target.multi:
            return None
        if isinstance(q, dict) and "recommend" in q:
            spec = q["recommend"]
            if spec.get("strategy", "average_vector") != "average_vector":
                return None
            x = average([self._vector(x, r) for x in _listed_inputs(spec.get("positive"))], [self._vector(x, r) for x in _listed_inputs(spec.get("negative"))])
        elif isinstance(q, dict):
            if "nearest" not in q or q.get("mmr") is not None:
                return None
            x = self._vector(q["nearest"], r)
        else:
            x = self._vector(q, r)
        if len(x) != target.size:
            raise ValueError(f"vectors of this name have the size {target.size}")
        return list(x)

    # Results ---------------------------------------------------------------------------------------------------------

    def result(self) -> DataFrame:
        """(id, score, payload?, vectors?): in order."""
        found = self.ranked()
        return hydrate(self.c, found.df, self.request, found.order())


class _Placed(Ranked):
    """Rows in an order of their own."""

    def order(self) -> list[Column]:
        return [F.col("place")]


def average(good: list, bad: list, multi: bool = False):
    """The mean of positive examples, moved away from that of negative ones."""
    if multi:
        return [v for x in good for v in (x if isinstance(x[0], list) else [x])]
    if isinstance(good[0], dict):
        def mean(xs: list) -> dict:
            sums: dict[int, float] = {}
            for x in xs:
                for i, v in zip(x["indices"], x["values"]):
                    sums[i] = sums.get(i, 0.0) + v / len(xs)
            return sums

        p, n = mean(good), mean(bad) if bad else {}
        keys = sorted({*p, *n})
        return {"indices": keys, "values": [(2 if bad else 1) * p.get(k, 0.0) - n.get(k, 0.0) for k in keys]}
    p = np.mean(np.asarray(good, np.float64), axis=0)
    return (2 * p - np.mean(np.asarray(bad, np.float64), axis=0) if bad else p).tolist()


def payload_columns(c: Collection, wanted) -> list[Column]:
    """What with_payload selects of the JSON payload, or of the columns that hold fields."""
    if not wanted:
        return []
    if c.payload:
        column = F.col(c.payload)
        if isinstance(wanted, dict):
            column = include(column, wanted["include"]) if "include" in wanted else exclude(column, wanted["exclude"])
        elif isinstance(wanted, list):
            column = include(column, wanted)
        return [column.alias("payload")]
    vectors = {v.column for v in [*c.vectors.values(), *c.sparse.values()]}
    names = [n for n in c.df.columns if n not in vectors and n != c.id]
    if isinstance(wanted, dict):
        names = [n for n in names if (n in wanted["include"] if "include" in wanted else n not in wanted["exclude"])]
    elif isinstance(wanted, list):
        names = [n for n in names if n in wanted]
    return [F.col(n) for n in names]


def vector_columns(c: Collection, wanted) -> list[Column]:
    named = {**c.vectors, **c.sparse}
    chosen = list(named) if wanted is True else [n for n in named if wanted and n in wanted]
    return [F.col(named[n].column).alias(f"vector_{n}" if n else "vector") for n in chosen]


def hydrate(c: Collection, found: DataFrame, request: dict, order: list[Column]) -> DataFrame:
    """Adds what is asked for to rows that have been chosen; the wide columns are read for these alone."""
    extra = payload_columns(c, request.get("with_payload")) + vector_columns(c, request.get("with_vectors"))
    if not extra:
        return found.orderBy(*order).drop("place")
    wide = c.df.select(F.col(c.id).alias("_id"), *extra)
    # Without a limit, or with a great one, the chosen rows may be as many as the table has.
    limit = request.get("limit", LIMIT)
    chosen = F.broadcast(found) if limit is not None and limit <= FEW else found
    return wide.join(chosen, F.col("_id") == F.col("id")).drop("_id").orderBy(*order).drop("place").select("id", *[x for x in found.columns if x not in ("id", "place")], *[x for x in wide.columns if x != "_id"])


def query(collection: Collection, request: dict, others: dict[str, Collection] | None = None) -> DataFrame:
    return Query(collection, request, others).result()


def query_batch(collection: Collection, requests: list[dict], others: dict[str, Collection] | None = None) -> DataFrame:
    """The results of several requests: (query_id, id, score).

    Searches of one dense vector each (nearest, or recommend by the average) under the same filter share one scan, in which
    every part keeps the best of each; other requests have a plan of their own.
    """
    from ..operators.batch import nearest_batch

    parts, shared = [], {}
    for n, r in enumerate(requests):
        q = Query(collection, r, others)
        vector = q.single_vector()
        if vector is None:
            parts.append(q.ranked().df.select(F.lit(n).cast("long").alias("query_id"), "id", "score"))
        else:
            shared.setdefault(json.dumps([r.get("using", ""), r.get("filter"), r.get("shard_key")], sort_keys=True, default=str), []).append((n, q, vector))
    for some in shared.values():
        first = some[0][1]
        depth = max((q.request.get("limit", LIMIT) + q.request.get("offset", 0) + len(q.named)) for _, q, _ in some)
        found = nearest_batch(first.c, {n: v for n, _, v in some}, depth, first.request.get("using", ""), first.request.get("filter"))
        larger = metrics.larger_better(first.c.vector(first.request.get("using", "")).distance)
        keep, most, skip = F.lit(True), F.lit(0), F.lit(0)
        for n, q, _ in some:
            mine, limit = F.col("query_id") == n, q.request.get("score_threshold")
            if q.named:
                keep = keep & ~(mine & F.col("id").isin(sorted(q.named, key=str)))
            if limit is not None:
                keep = keep & (~mine | (F.col("score") > limit if larger else F.col("score") < limit))
            most = F.when(mine, q.request.get("limit", LIMIT)).otherwise(most)
            skip = F.when(mine, q.request.get("offset", 0)).otherwise(skip)
        order = [F.col("score").desc(), F.col("id").desc()] if larger else [F.col("score"), F.col("id")]
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
        parts.append(found.where(keep).withColumn("_n", place).where((F.col("_n") > skip) & (F.col("_n") <= skip + most)).select("query_id", "id", "score"))
    return reduce(DataFrame.unionByName, parts)


def search(collection: Collection, vector, **request) -> DataFrame:
    return query(collection, {"query": vector, **request})


def recommend(collection: Collection, positive: list, negative: list | None = None, strategy: str = "average_vector", **request) -> DataFrame:
    return query(collection, {"query": {"recommend": {"positive": positive, "negative": negative or [], "strategy": strategy}}, **request})


def discover(collection: Collection, target=None, context: list | None = None, **request) -> DataFrame:
    spec = {"context": context} if target is None else {"discover": {"target": target, "context": context or []}}
    return query(collection, {"query": spec, **request})
