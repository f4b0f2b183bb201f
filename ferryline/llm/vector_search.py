"""Approximate nearest neighbours over learned partitions.

A bounded sample gives a nearest-neighbour graph, which balanced label propagation cuts into parts of
about equal size.  A small classifier (one hidden layer) learns, from a vector, the parts that its
neighbours are in.  It puts every row of the table in its most probable part and routes each query to the
most probable parts; how many is settled on the sample, so that the recall there reaches a target.  The
candidates of those parts are reranked by their exact inner product in double precision, in two rounds: the most
probable part gives each query its k-th best score so far, and the other parts only send on what reaches it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Rows that the index is fitted on, if its parts need no more; rows or queries in a tile; rows wanted in a part; parts at most.
SAMPLE, TILE, PART, PARTS = 8192, 4096, 4096, 256
#: Sampled rows that a part needs.
FIT = 64


def nearest(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Row numbers of the k largest inner products (in single precision) with each q; own: a row to leave out for each q.

    In small blocks: it runs beside the driver.
    """
    out, q, x = [], q.astype(np.float32), x.astype(np.float32)
    for a in range(0, len(q), 64):
        s = -(q[a : a + 64] @ x.T)
        if own is not None:
            s[np.arange(len(s)), own[a : a + 64]] = np.inf
        out.append(np.argpartition(s, min(k, s.shape[1]) - 1, axis=1)[:, :k].astype(np.int32))
    return np.concatenate(out) if out else np.zeros((0, k), np.int32)


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rounds: int = 20, slack: float = 1.05) -> np.ndarray:
    """Label propagation over a neighbour graph in which no part outgrows ``slack`` times the mean."""
    rng, n = np.random.default_rng(7), len(x)
    most = int(np.ceil(slack * n / parts))
    seeds = x[rng.choice(n, parts, replace=False)]
    label = np.full(n, -1)
    size = np.zeros(parts, np.int64)
    liking = x @ seeds.T
    for i in np.argsort(-liking.max(1)):
        order = np.argsort(-liking[i])
        label[i] = order[np.argmax(size[order] < most)]
        size[label[i]] += 1
    rows = np.repeat(np.arange(n), graph.shape[1])
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (rows, label[graph.ravel()]), 1)
        np.add.at(votes, (graph.ravel(), label[rows]), 1)
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), label]
        moved = 0
        for i in np.argsort(-gain):
            if gain[i] <= 0:
                break
            if size[want[i]] < most:
                size[label[i]] -= 1
                size[want[i]] += 1
                label[i] = want[i]
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A classifier from a vector to the probabilities of parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 30):
        rng, (n, d), parts = np.random.default_rng(11), x.shape, target.shape[1]
        p = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
        self.scale = 1 / max(float(np.sqrt((x**2).mean())), 1e-12)
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        self.p = p
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(n), max(1, n // 256)):
                z = x[at] * self.scale
                h = np.maximum(z @ p[0] + p[1], 0)
                e = (self._soft(h @ p[2] + p[3]) - target[at]) / len(at)
                back = (e @ p[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((z.T @ back, back.sum(0), h.T @ e, e.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] -= 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _soft(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts, most probable first."""
        h = np.maximum(x * self.scale @ self.p[0] + self.p[1], 0)
        return np.argsort(-(h @ self.p[2] + self.p[3]), axis=1, kind="stable")


def fit(x: np.ndarray, parts: int, k: int, recall: float) -> tuple[Router, int]:
    """Router over ``parts`` parts, and the least number of parts to probe for the wanted recall on the sample."""
    graph = nearest(x, x, min(max(10, k), len(x) - 1), np.arange(len(x)))
    label = balanced_parts(graph, x, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1)
    ask = np.random.default_rng(3).permutation(len(x))[: max(1, len(x) // 8)]
    learn = np.setdiff1d(np.arange(len(x)), ask)
    router = Router(x[learn], (target / target.sum(1, keepdims=True))[learn])
    order = router.order(x)
    home, hits = order[:, 0], np.zeros(parts)
    for i in ask:
        place = np.empty(parts, np.int64)
        place[order[i]] = np.arange(parts)
        np.add.at(hits, place[home[graph[i, :]]], 1)
    found = np.cumsum(hits) / hits.sum()
    return router, int(np.searchsorted(found, recall) + 1)


def _vectors(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _probed(order: np.ndarray, probes: int, held: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, part) pairs: each query's first ``probes`` parts, and more till they hold ``need`` rows; all, if they don't."""
    enough = (np.cumsum(held[order], axis=1) < need[:, None]).sum(1) + 1
    n = np.minimum(np.maximum(enough, probes), order.shape[1])
    at = np.repeat(np.arange(len(order)), n)
    return at, order[at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]


def _routed(router: Router, dim: int, probes: int, held: np.ndarray, k: int, first: bool, tiles: tuple[list, list] | None):
    """Each vector with its part(s), and the tiles it is needed in; tiles: each part's number of tiles of rows and of queries.

    Without them, the parts alone.  A row (column asks: false) goes to its own tile of rows against every tile of
    queries; a query, to every tile of rows of its parts, in its own tile of queries.  ``held`` is each part's number
    of rows: a query's parts hold k rows besides its own (the column own counts them), or are all.  ``first``: only
    the most probable part, as for rows; otherwise, of a query, only the others.
    """

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, salt = b.column("id").to_numpy(zero_copy_only=False), b.column("salt").to_numpy(zero_copy_only=False)
            v, asks = b.column("v"), b.column("asks")[0].as_py()
            order = router.order(_vectors(v, dim))
            at, part = np.arange(len(ids)), order[:, 0]
            if asks and not first:
                at, part = _probed(order, probes, held, b.column("own").to_numpy(zero_copy_only=False) + k)
                more = part != order[at, 0]
                at, part = at[more], part[more]
            if tiles is None:
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32())], ["part"])
                continue
            own, other = tiles[asks], tiles[not asks]
            n = np.asarray(other)[part]
            mine = salt[at] % np.asarray(own)[part]
            each = np.repeat(np.arange(len(part)), n)
            theirs = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            r, a = (theirs, mine[each]) if asks else (mine[each], theirs)
            take = pa.array(at[each])
            yield pa.RecordBatch.from_arrays([pa.array(part[each], pa.int32()), pa.array(r, pa.int32()), pa.array(a, pa.int32()), b.column("id").take(take), v.take(take), b.column("least").take(take)], ["part", "r", "a", "id", "v", "least"])

    return run


_FOUND = pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())]))
_TOP = pa.schema([("query_id", pa.int64()), ("found", _FOUND)])


def _rerank(dim: int, k: int):
    """Cogroup of a tile of rows with a tile of queries: each query's k best rows that reach its least score, as one
    row of (minus the score, id)."""

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if rows.num_rows and asks.num_rows:
            ids, qids = (t.column("id").to_numpy().astype(np.int64) for t in (rows, asks))
            x, q = (_vectors(t.column("v").combine_chunks(), dim) for t in (rows, asks))
            floor = asks.column("least").to_numpy(zero_copy_only=False)
            # equal vectors score once; the smallest ids stand for them
            order = np.lexsort((ids, *x.T[::-1]))
            x, ids = x[order], ids[order]
            first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(1)))
            u, copies = x[first], np.diff(np.append(first, len(x)))
            # a query leaves out its own rows: usually one; if more, it is asked alone, for so many more
            known, times = np.unique(ids, return_counts=True)
            at = np.minimum(np.searchsorted(known, qids), len(known) - 1)
            mine = np.where(known[at] == qids, times[at], 0)
            order = np.argsort(mine > 1, kind="stable")
            q, qids, mine, floor = q[order], qids[order], mine[order], floor[order]
            usual = int((mine <= 1).sum())
            for a, b in [*((a, min(a + 256, usual)) for a in range(0, usual, 256)), *((a, a + 1) for a in range(usual, len(q)))]:
                s = q[a:b] @ u.T
                most = k + max(1, int(mine[a:b].max()))
                size, m = np.minimum(copies, most), min(most, len(u))
                least = np.maximum(np.partition(s, len(u) - m, axis=1)[:, len(u) - m], floor[a:b])
                i, j = np.nonzero(s >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
                exact = (q[a + i] * u[j]).sum(1)
                n = size[j]
                i, exact, member = np.repeat(i, n), np.repeat(exact, n), ids[np.repeat(first[j] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                other = (member != qids[a + i]) & (exact >= floor[a + i])
                i, exact, member = i[other], exact[other], member[other]
                o = np.lexsort((member, -exact, i))
                i, exact, member = i[o], exact[o], member[o]
                start = np.flatnonzero(np.diff(i, prepend=-1))
                rank = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
                keep = rank < k
                for col, y in zip(out, (qids[a + i[keep]], member[keep], -exact[keep])):
                    col.append(y)
        query, member, far = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        start = np.flatnonzero(np.append(True, query[1:] != query[:-1]))[: len(query)]
        found = pa.StructArray.from_arrays([pa.array(far, pa.float64()), pa.array(member, pa.int64())], ["far", "vec_id"])
        return pa.table([pa.array(query[start], pa.int64()), pa.ListArray.from_arrays(pa.array(np.append(start, len(query)), pa.int32()), found)], schema=_TOP)

    return run


def wanted(n: int, sample_rows: int | None = None, most_parts: int = PARTS, part_rows: int = PART) -> tuple[int, int]:
    """Parts and sampled rows for a table of n rows; a sample that is bounded lowers the parts to what it supports."""
    parts = min(most_parts, max(8, -(-n // part_rows)))
    sample = min(n, max(SAMPLE, FIT * parts) if sample_rows is None else sample_rows)
    return max(1, min(parts, sample // FIT)), sample


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id bigint, v array<double>) of the rows that take part: an id, and finite components that aren't all zero."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.filter(F.col(f"`{id_col}`").isNotNull() & fine).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("v"))


def vector_search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, recall: float = 0.95, sample_rows: int | None = None, most_parts: int = PARTS, part_rows: int = PART) -> DataFrame:
    """The k nearest rows found for each query row, a query being a row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score: the largest inner products in double precision, ties to
    the smaller id; all candidates if there are fewer than k in the table.  Rows with a null id, or a
    vector that is null, empty, zero, holds null or non-finite components or isn't of the commonest
    length, take no part.  Rows that share a query's id are its own and no candidates; of queries that share
    an id the least vector asks.  An empty table gives an empty result; other columns are not read.

    The index has a part for every ``part_rows`` rows, 8 at least and ``most_parts`` at most, and holds every
    row.  It is fitted on the rows with the least hashes of ids: SAMPLE, or FIT for each part if that is more;
    ``sample_rows`` sets another number, and where that is under FIT for each part, there are fewer parts.
    ``recall`` is the recall wanted on the sample, where the number of parts to probe is settled.  Parts and
    their queries are cut into tiles, so that a hot part spreads over tasks.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, n = common["d"], common["count"]
    rows = rows.filter(F.size("v") == dim).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    queries = rows.filter(F.col("id") % every == 0).groupBy("id", "salt").agg(F.min("v").alias("v"), F.count("*").alias("own"))
    parts, take = wanted(n, sample_rows, most_parts, part_rows)
    sample = _vectors(rows.orderBy("salt", "id").limit(take).select("v").toArrow().column("v").combine_chunks(), dim)
    router, probes = fit(sample, parts, k, recall) if parts > 1 else (Router(sample, np.ones((len(sample), 1)), epochs=0), 1)
    none = F.lit(float("-inf")).alias("least")
    rows, queries = rows.select("id", "v", "salt", F.lit(False).alias("asks"), none), queries.select("id", "v", "salt", F.lit(True).alias("asks"), "own", none)

    def by_part(t: DataFrame, first: bool) -> np.ndarray:
        got = t.mapInArrow(_routed(router, dim, probes, held, k, first, None), "part int").groupBy("part").count().collect()
        return np.bincount([r["part"] for r in got], [r["count"] for r in got], parts).astype(np.int64)

    held = np.zeros(parts, np.int64)
    held = by_part(rows, True)
    tiles = lambda x: np.maximum(1, -(-x // TILE)).tolist()
    schema = "part int, r int, a int, id bigint, v array<double>, least double"

    def search(asked: DataFrame, first: bool) -> DataFrame:
        cut = (tiles(held), tiles(by_part(asked, first)))
        left, right = (t.mapInArrow(_routed(router, dim, probes, held, k, f, cut), schema).groupBy("part", "r", "a") for t, f in ((rows, True), (asked, first)))
        return left.cogroup(right).applyInArrow(_rerank(dim, k), "query_id bigint, found array<struct<far:double,vec_id:bigint>>")

    def best(found: DataFrame) -> DataFrame:
        return found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))

    found = best(search(queries, True))
    if parts > 1:
        found = checkpointed(found)
        reached = found.filter(F.size("found") == k).select(F.col("query_id").alias("id"), (-F.element_at("found", k)["far"]).alias("so_far"))
        asked = checkpointed(queries.join(reached, "id", "left").withColumn("least", F.coalesce("so_far", "least")).drop("so_far"))
        found = best(found.unionByName(search(asked, False)))
    out = found.select("query_id", F.posexplode("found").alias("at", "row"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("row.vec_id").alias("vec_id"), (-F.col("row.far")).alias("score"))


def op6_query(spark, sf_dir: str) -> DataFrame:
    return vector_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
