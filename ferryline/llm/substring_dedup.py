"""Substring dedup by compaction of a token de Bruijn graph.

Edges of the graph are token k-mers (k = 13), nodes the (k-1)-mers at their ends.  An edge belongs to
the partition of its minimizer (the least hash among its seeds), so that neighbouring edges mostly lie
together: they travel as one run of (seed, source coordinates, nodes).  Each partition finds the edges
that repeat, names the occurrence of the smallest id their owner, and compacts edges that all their
sources pass through one after the other to a path: its end nodes, its owner's coordinates and the
coordinates of its removable occurrences.  Spark joins then compact the paths of all partitions: a node
where one path ends and one begins does not branch, and along an owner's text paths that meet in such
nodes make one unitig.  An occurrence that follows a unitig from path to path is one long span.

Each span is verified at its source coordinates: the words there and the words at its owner's coordinates
are read again and must have one 128-bit digest, or the result raises instead of cutting; ``seed`` then gives
other word hashes.  Repeats inside the documents that a task reads at once are found and compared there, word by
word, and only the smallest id's copy of an edge is sent.

A minimizer that holds a large share of all edges (a passage that very many documents have, with other words
around it) would fill one partition; its edges are dealt out by their own hashes instead.  A first pass over all
texts finds such minimizers; there can only be a bounded number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import REPORT_FROM, SPREAD_FROM, U64, KeyList, WordIds, bounds, buckets, checkpointed, counted_keys, covered, deltas, gathered, heavy_keys, longs, mix, pack, ranges, raw, shared_path, slide, text_only, unpack, with_tags, xxhash64_long

#: Bytes of text whose edges a task holds at once; bytes of a node's hash.
CHUNK, NODE = 5 << 20, 5
_BLOB = pa.schema([("q", pa.int32()), ("blob", pa.binary())])
_FOUND = pa.schema([("blk", pa.int32()), ("blob", pa.binary()), ("head", pa.int64()), ("tail", pa.int64()), ("id", pa.int64()), ("tag", pa.int32()), ("at", pa.int32()), ("n", pa.int32()), ("others", pa.binary())])
_SPAN = pa.schema([("id", pa.int64()), ("tag", pa.int32()), ("at", pa.int32()), ("n", pa.int32()), ("owner", pa.int64()), ("owner_tag", pa.int32()), ("owner_at", pa.int32())])
_DIGEST = pa.schema([("owner", pa.int64()), ("owner_tag", pa.int32()), ("owner_at", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())])
#: An occurrence of a path.
_PLACE = np.dtype([("id", "<i8"), ("tag", "<i4"), ("at", "<i4")])
#: Parts the rows of a repeated id, by their tags, over the blocks.
_TAG_STEP = 0x9E3779B1


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _blocks(ids: np.ndarray, tags: np.ndarray, n: int) -> np.ndarray:
    return np.mod(xxhash64_long(ids ^ (tags.astype(np.int64) * _TAG_STEP)), n).astype(np.int32)


def _split(key: np.ndarray, n: int):
    """Row numbers by key 0..n-1."""
    order = np.argsort(key, kind="stable")
    ends = np.searchsorted(key[order], np.arange(n), side="right")
    for q, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends)):
        if b > a:
            yield q, order[a:b]


def _runs_of(flag: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of set flags; joined[i]: i follows i-1 in its source."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    starts, lengths = bounds(~((np.diff(at, prepend=-2) == 1) & joined[at]))
    return at[starts], lengths


class Edges:
    """The edges of a chunk: row, place in it, minimizer, and the numbers of the chunk's words from each edge on."""

    def __init__(self, table: pa.Table, words_of: WordIds, k: int, seed_k: int):
        lists = [x.split() for x in raw(table.column("text").combine_chunks())]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(counts.sum())
        self.doc = np.zeros(0, np.int64)
        if total < k:
            return
        self.word, one, self.two = words_of.of([w for x in lists for w in x], total)
        del lists
        doc = np.repeat(np.arange(len(counts)), counts)
        n, seeds = total - k + 1, slide(one, seed_k, 0x9E3779B97F4A7C15)
        low = seeds[:n].copy()
        for j in range(1, k - seed_k + 1):
            np.minimum(low, seeds[j : j + n], out=low)
        self.first = np.flatnonzero(doc[:n] == doc[k - 1 :])
        self.doc, self.low, self.k = doc[self.first], low[self.first], k
        self.pos = self.first - (np.cumsum(counts) - counts)[self.doc]

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the node before and the node after each edge."""
        node = slide(self.two, self.k - 1, 0xD6E8FEB86659FD93) >> U64(64 - 8 * NODE)
        return node[self.first], node[self.first + 1]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether edges have the same words."""
        out = np.ones(len(a), bool)
        for j in range(self.k):
            out &= self.word[self.first[a] + j] == self.word[self.first[b] + j]
        return out

    def removable(self, own: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Edges that a smaller id of the chunk has too; edge: their hashes, which their words have to confirm."""
        gone = np.zeros(len(edge), bool)
        order = np.argsort(edge)
        starts, n = bounds(edge[order] != np.roll(edge[order], 1))
        places = ranges(starts[n > 1], n[n > 1])
        if len(places):
            i, group = order[places], np.repeat(np.arange(int((n > 1).sum())), n[n > 1])
            least = np.minimum.reduceat(own[i], bounds(np.diff(group, prepend=-1) != 0)[0])[group]
            smallest = np.flatnonzero(own[i] == least)
            owner = i[smallest[np.diff(group[smallest], prepend=-1) != 0]][group]
            later = own[i] > least
            i, owner = i[later], owner[later]
            gone[i[self.same(i, owner)]] = True
        return gone


def seed_reports(k: int, seed_k: int, least: int, seed: int):
    """mapInArrow: how often minimizers hold a run of edges, by chunk."""

    def run(batches):
        words_of = WordIds(seed)
        for table in gathered(batches, CHUNK):
            e = Edges(table, words_of, k, seed_k)
            if len(e.doc):
                starts, _ = bounds((e.low != np.roll(e.low, 1)) | (e.doc != np.roll(e.doc, 1)))
                yield counted_keys(e.low[starts], least)

    return run


def _narrow(nodes: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(nodes).view(np.uint8).reshape(-1, 8)[:, :NODE]).tobytes()


def _wide(data) -> np.ndarray:
    out = np.zeros((len(data) // NODE, 8), np.uint8)
    out[:, :NODE] = np.frombuffer(data, np.uint8).reshape(-1, NODE)
    return out.reshape(-1).view(U64)


def edge_runs(q_n: int, k: int, seed_k: int, heavy: np.ndarray, seed: int):
    """mapInArrow: (id, tag, text) to blobs by partition: runs of edges to that of their minimizer, or of each edge
    itself where the minimizer is a heavy one; runs that are removable for sure to their source's block."""

    def run(batches):
        words_of, spread = WordIds(seed), KeyList(heavy)
        none = np.zeros(0, np.int64)
        for table in gathered(batches, CHUNK):
            e = Edges(table, words_of, k, seed_k)
            if not len(e.doc):
                continue
            ids, tags = longs(table.column("id").combine_chunks())[e.doc], longs(table.column("tag").combine_chunks())[e.doc]
            before, after = e.nodes()
            edge = mix((before << U64(24)) ^ after * U64(0x9E3779B97F4A7C15))
            part = (e.low % U64(q_n)).astype(np.int64)
            alone = spread.has(e.low)
            part[alone] = (edge[alone] % U64(q_n)).astype(np.int64)
            gone = e.removable(ids, edge)
            follows = (np.diff(e.pos, prepend=-2) == 1) & (np.diff(e.doc, prepend=-1) == 0)
            first, size = _runs_of(~gone, follows & (e.low == np.roll(e.low, 1)) & (part == np.roll(part, 1)))
            done_at, done_n = _runs_of(gone, follows)
            todo, done = dict(_split(part[first], q_n)), dict(_split(_blocks(ids[done_at], tags[done_at], q_n), q_n)) if len(done_at) else {}
            out_q, out = [], []
            for q in sorted({*todo, *done}):
                r, d = first[todo.get(q, none)], done.get(q, none)
                n, at = size[todo.get(q, none)], done_at[d]
                meta = pack(deltas(ids[r]), tags[r].astype(np.int32), deltas(e.pos[r]), n.astype(np.int32), (e.low[r] >> U64(32)).astype(np.uint32), deltas(ids[at]), tags[at].astype(np.int32), deltas(e.pos[at]), done_n[d].astype(np.int32))
                path = np.empty(int(n.sum()) + len(n), U64)  # a run's nodes: before each of its edges, and after the last
                last = np.cumsum(n + 1) - 1
                path[last] = after[r + n - 1]
                inner = np.ones(len(path), bool)
                inner[last] = False
                path[inner] = before[ranges(r, n)]
                out_q.append(q)
                out.append(len(meta).to_bytes(4, "little") + meta + _narrow(path))
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int32()), pa.array(out, pa.binary())], schema=_BLOB)

    return run


def _paths(own, tag, pos, size, seed, before, after):
    """Paths of the runs of a partition, as (first edge, last edge, removable occurrences as edges, how many).

    Edges are numbered run by run, runs in the order of their sources, so that the first of equal edges is their owner.
    """
    run_no = np.repeat(np.arange(len(size)), size)
    high, rest = (before << U64(24)) | (after >> U64(16)), ((after & U64(0xFFFF)) << U64(32)) | seed[run_no].astype(U64)
    order = np.lexsort((rest, high))
    a, b = high[order], rest[order]
    starts, n = bounds((a != np.roll(a, 1)) | (b != np.roll(b, 1)))
    del a, b, high, rest
    more = own[run_no[order]] > np.repeat(own[run_no[order[starts]]], n)
    hits = np.add.reduceat(more.astype(np.int64), starts) if len(starts) else n
    keep = np.flatnonzero(hits)
    keep = keep[np.argsort(order[starts[keep]])]  # repeated edges in the order of their owners
    starts, n, hits = starts[keep], n[keep], hits[keep]
    owner = order[starts]
    # an edge goes on with its predecessor's path if all the sources of one pass on to the other
    follows = np.flatnonzero((np.diff(owner, prepend=-2) == 1) & (n == np.roll(n, 1)))
    joined = np.zeros(len(keep), bool)
    if len(follows):
        x, y = (order[ranges(starts[i], n[i])] for i in (follows - 1, follows))
        passes = (y - x == 1) & (run_no[x] == run_no[y])
        joined[follows] = np.logical_and.reduceat(passes, np.cumsum(n[follows]) - n[follows])
    head, length = bounds(~joined)
    places = ranges(starts[head], n[head])
    return owner[head], owner[head + length - 1], order[places][more[places]], hits[head], run_no


def repeated(blk_n: int):
    """applyInArrow over one partition of edges: a row for each path, and one of runs that were removable for sure."""

    def run(table: pa.Table) -> pa.Table:
        parts, paths = [], []
        for blob in raw(table.column("blob").combine_chunks()):
            n = int.from_bytes(blob[:4], "little")
            a = unpack(blob[4 : 4 + n])
            for i in (0, 2, 5, 7):
                a[i] = np.cumsum(a[i])
            parts.append(a)
            paths.append(_wide(memoryview(blob)[4 + n :]))
        own, tag, pos, size, seed, d_ids, d_tags, d_pos, d_n = (np.concatenate(x) for x in zip(*parts))
        node, size = np.concatenate(paths), size.astype(np.int64)
        del parts, paths
        first = np.cumsum(size + 1) - (size + 1)
        order = np.lexsort((pos, tag, own))
        own, tag, pos, size, seed, first = (x[order] for x in (own, tag, pos, size, seed, first))
        at = ranges(first, size)
        before, after = node[at], node[at + 1]
        del node, at
        head, last, other, hits, run_no = _paths(own, tag, pos, size, seed, before, after)
        start = np.cumsum(size) - size
        place = lambda e: (own[run_no[e]], tag[run_no[e]], pos[run_no[e]] + e - start[run_no[e]])
        occurrences = np.zeros(len(other), _PLACE)
        occurrences["id"], occurrences["tag"], occurrences["at"] = place(other)
        offsets = np.append(0, np.cumsum(hits) * _PLACE.itemsize).astype(np.int32)
        others = pa.Array.from_buffers(pa.binary(), len(hits), [None, pa.py_buffer(offsets), pa.py_buffer(occurrences.tobytes())])
        ids, tags, at = place(head)
        rows = [pa.nulls(len(head), pa.int32()), pa.nulls(len(head), pa.binary()), before[head].astype(np.int64), after[last].astype(np.int64), ids, tags.astype(np.int32), at.astype(np.int32), (last - head + 1).astype(np.int32), others]
        out = [pa.table([pa.array(x) if isinstance(x, np.ndarray) else x for x in rows], schema=_FOUND)]
        if len(d_ids):
            i = np.lexsort((d_pos, d_tags, d_ids))
            blob = pack(deltas(d_ids[i]), d_tags[i].astype(np.int32), deltas(d_pos[i]), d_n[i].astype(np.int32))
            out.append(pa.table([pa.array([int(table.column("q")[0].as_py())], pa.int32()), pa.array([blob], pa.binary()), *(pa.nulls(1, f.type) for f in list(_FOUND)[2:])], schema=_FOUND))
        return pa.concat_tables(out)

    return run


def unitigs(paths: DataFrame) -> DataFrame:
    """(id, tag, parts) of the unitigs of paths (head, tail, id, tag, at, n, others): along an owner's text, paths that
    meet in nodes where only one path ends and one begins.

    A window holds the paths of one document.
    """
    zero, one = F.lit(0), F.lit(1)
    ends = paths.select(F.col("head").alias("node"), zero.alias("ins"), one.alias("outs")).union(paths.select("tail", one, zero))
    plain = ends.groupBy("node").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs")).filter("ins = 1 AND outs = 1").select(F.col("node").alias("head"), F.lit(True).alias("plain"))
    along = Window.partitionBy("id", "tag").orderBy("at")
    follows = F.coalesce("plain", F.lit(False)) & F.coalesce(F.lag(F.col("at") + F.col("n")).over(along) == F.col("at"), F.lit(False))
    marked = paths.join(plain, "head", "left").withColumn("new", F.when(follows, 0).otherwise(1))
    numbered = marked.withColumn("unitig", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "tag", "unitig").agg(F.collect_list(F.struct("at", "n", "others")).alias("parts")).select("id", "tag", "parts")


def _spans(batches):
    """mapInArrow: the removable occurrences of unitigs; one that follows a unitig from path to path is one span."""
    for b in batches:
        if not b.num_rows:
            continue
        parts = b.column("parts")
        flat, sizes = parts.flatten(), np.diff(parts.offsets.to_numpy())
        others = flat.field("others").to_pylist()
        n_of = np.fromiter((len(x) // _PLACE.itemsize for x in others), np.int64, len(others))
        place = np.frombuffer(b"".join(others), _PLACE)
        unitig = np.repeat(np.repeat(np.arange(len(sizes)), sizes), n_of)
        owner_at, n = (np.repeat(flat.field(c).to_numpy(), n_of).astype(np.int64) for c in ("at", "n"))
        way = place["at"] - owner_at
        order = np.lexsort((owner_at, way, place["tag"], place["id"], unitig))
        unitig, place, way, owner_at, n = unitig[order], place[order], way[order], owner_at[order], n[order]
        new = np.roll(owner_at + n, 1) != owner_at
        for x in (unitig, place["id"], place["tag"], way):
            new |= x != np.roll(x, 1)
        first, _ = bounds(new)
        at, u = place[first], unitig[first]
        cols = [at["id"], at["tag"], at["at"], np.add.reduceat(n, first) if len(first) else n, longs(b.column("id"))[u], longs(b.column("tag"))[u], owner_at[first]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)).cast(f.type) for c, f in zip(cols, _SPAN)], schema=_SPAN)


def _by_row(ids: np.ndarray, tags: np.ndarray) -> dict:
    """Row numbers by (id, tag)."""
    order = np.lexsort((tags, ids))
    starts, n = bounds((ids[order] != np.roll(ids[order], 1)) | (tags[order] != np.roll(tags[order], 1)))
    return {(int(ids[order[a]]), int(tags[order[a]])): order[a : a + m] for a, m in zip(starts, n)}


def _rows_of(docs: pa.Table):
    return zip(docs.column("id").to_pylist(), docs.column("tag").to_pylist(), raw(docs.column("text").combine_chunks()))


def _digests(k: int):
    """Cogroup of a block's documents with places in them: digests of the words there, by the owner's coordinates."""

    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        keep, digests = [], []
        if places.num_rows:
            where = _by_row(*(longs(places.column(c).combine_chunks()) for c in ("id", "tag")))
            at, n = (longs(places.column(c).combine_chunks()) for c in ("at", "n"))
            for i, tag, text in _rows_of(docs):
                if (rows := where.get((i, tag))) is not None:
                    words = text.split()
                    for r in rows.tolist():
                        keep.append(r)
                        digests.append(xxhash.xxh3_128_digest(b" ".join(words[at[r] : at[r] + n[r] + k - 1])))
        keys = places.take(pa.array(keep, pa.int64())).select(["owner", "owner_tag", "owner_at", "n"])
        return pa.table([*(c.combine_chunks() for c in keys.columns), pa.array(digests, pa.binary())], schema=_DIGEST)

    return run


def _cut(k: int):
    """Cogroup of a block's documents with its spans and runs: the words that stay."""
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(docs: pa.Table, runs: pa.Table) -> pa.Table:
        where, got = {}, []
        if runs.num_rows:
            blobs = runs.column("blob").combine_chunks()
            got = [(np.cumsum(a), b, np.cumsum(c), d) for a, b, c, d in map(unpack, raw(blobs.drop_null()))]
            spans = runs.filter(blobs.is_null())
            got.append([longs(spans.column(c).combine_chunks()) for c in ("id", "tag", "at", "n")])
            ids, tags, pos, n = (np.concatenate(x) for x in zip(*got))
            where = _by_row(ids, tags)
        rows = []
        for i, tag, text in _rows_of(docs):
            words = text.split() if text else []
            lost = 0
            if (own := where.get((i, tag))) is not None:
                drop = covered(len(words), pos[own], n[own].astype(np.int64) + (k - 1))
                lost = int(drop.sum())
                kept = [w for w, x in zip(words, drop.tolist()) if not x]
            else:
                kept = words
            rows.append((i, len(words), lost, b" ".join(kept)))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([],) * 4, schema.types)], schema=schema)

    return run


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, seed_k: int = 5, spread: tuple[float, int] = (SPREAD_FROM, REPORT_FROM), seed: int = 0) -> DataFrame:
    """Remove the words of every window of k words that also starts in a document with a smaller id.

    Returns one row for each input row: the id (under its own name, bigint), n_words, n_removed and
    kept (binary UTF-8: the words that stay, joined by one space).  Words are runs of anything but
    ASCII white space; windows are judged on the input.  Null text has no words; a row with a null id
    loses nothing and makes nothing removable; rows with equal ids never remove each other's words, and
    repeated rows get the same result.  An empty table gives an empty result.  Other columns are not read.
    ``spread``: from which share on a minimizer's edges are dealt out one by one, see common.heavy_keys.
    ``seed`` is that of the word hashes: should words at two coordinates differ though their hashes agree, the
    result raises, and another seed settles it.
    """
    spark, n = df.sparkSession, buckets(df)
    docs = with_tags(text_only(df, id_col, text_col))
    read = docs.filter("id IS NOT NULL AND text IS NOT NULL")
    reports = checkpointed(read.select("text").mapInArrow(seed_reports(k, seed_k, spread[1], seed), "key bigint, n bigint"))
    blobs = read.mapInArrow(edge_runs(n, k, seed_k, heavy_keys(reports, n, spread[0]), seed), _sql(_BLOB))
    blobs.groupBy("q").applyInArrow(repeated(n), _sql(_FOUND)).write.parquet(path := shared_path(spark, "paths"))
    found = spark.read.schema(_sql(_FOUND)).parquet(path)
    spans = checkpointed(unitigs(found.filter("n IS NOT NULL").drop("blk", "blob")).mapInArrow(_spans, _sql(_SPAN)))
    of_row = lambda i, tag: F.pmod(F.xxhash64(i.bitwiseXOR(tag.cast("bigint") * F.lit(_TAG_STEP))), F.lit(n)).cast("int")
    block = F.coalesce(F.when(F.col("id").isNull(), F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")), of_row(F.col("id"), F.col("tag")))
    left = docs.withColumn("blk", block).groupBy("blk")
    at_owner = spans.select(F.col("owner").alias("id"), F.col("owner_tag").alias("tag"), F.col("owner_at").alias("at"), "n", "owner", "owner_tag", "owner_at").distinct()
    places = spans.union(at_owner).withColumn("blk", of_row(F.col("id"), F.col("tag")))
    digests = left.cogroup(places.groupBy("blk")).applyInArrow(_digests(k), _sql(_DIGEST))
    differ = digests.groupBy("owner", "owner_tag", "owner_at", "n").agg((F.min("digest") != F.max("digest")).alias("differ")).agg(F.count_if("differ")).scalar()
    runs = found.filter("blk IS NOT NULL").select("blk", "id", "tag", "at", "n", "blob")
    cuts = spans.select(of_row(F.col("id"), F.col("tag")).alias("blk"), "id", "tag", "at", "n", F.lit(None).cast("binary").alias("blob"))
    out = left.cogroup(runs.union(cuts).groupBy("blk")).applyInArrow(_cut(k), "id bigint, n_words bigint, n_removed bigint, kept binary")
    fails = F.raise_error(F.lit("words with equal hashes differ: give another seed"))
    sure = lambda c, kind: F.when(differ == 0, F.col(c)).otherwise(fails.cast(kind)).alias(c)
    return out.select(F.col("id").alias(id_col), "n_words", sure("n_removed", "bigint"), sure("kept", "binary"))


def op2_query(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as lists of words; the smallest id of each window decides.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, p, list_aggregate(w[p:p + 12], 'string_agg', ' ') AS s FROM g),
m AS (SELECT s, min(doc_id) AS first_id FROM h GROUP BY s),
r AS (SELECT DISTINCT h.doc_id, unnest(range(h.p, h.p + 13)) AS i FROM h JOIN m USING (s) WHERE m.first_id < h.doc_id),
k AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id),
e AS (SELECT d.doc_id, unnest(d.w) AS word, unnest(range(1, len(d.w) + 1)) AS i FROM d),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t FROM e LEFT JOIN r ON e.doc_id = r.doc_id AND e.i = r.i WHERE r.i IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(k.gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
