"""SimHash near-dedup with bit-sliced comparison.

Equal fingerprints collapse first.  Different ones that differ in at most r of 64 bits agree in full on
k - r of any k pieces of the fingerprint (pigeonhole), so each choice of k - r pieces makes one table of
buckets, and every link lies within a bucket; k grows with the number of fingerprints to keep buckets
short.  A bucket is cut into tiles of bounded size.  A tile stores its fingerprints as 64 vertical bit
planes; one query is compared with 64 lanes at once: XOR by plane, carry-save counters that saturate above
r, and a block is abandoned once all its lanes exceed r.  Tiles return spanning forests, not all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, checkpointed, ranges, raw, text_only, unlike
from .graph import components

#: Fingerprints to a side of a tile, and wanted to a bucket at most on average.
TILE, BUCKET = 4096, 1024
_PRINTS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64 bits, each set where over half of the shingles' XXH64 (seed 42) have it; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = len(words) - shingle + 1
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())), U64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(U64)[0])


def _prints(shingle: int):
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in raw(b.column("text"))], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(fp)], schema=_PRINTS)

    return run


def tables(n: int, radius: int) -> list[int]:
    """Masks of the pieces that a table's buckets agree on."""
    for k in range(radius + 1, 65):
        cut = [64 * i // k for i in range(k + 1)]
        pieces = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:])]
        masks = [sum(x) for x in combinations(pieces, k - radius)]
        if k >= 2 * radius + 2 or n >> min(m.bit_count() for m in masks) <= BUCKET:
            return masks
    raise ValueError(f"radius {radius} leaves no bits to agree on")


def planes(fps: np.ndarray, lanes: np.ndarray, words: int) -> np.ndarray:
    """64 x words: bit p of the fingerprint in each lane."""
    out = np.zeros((words * 64, 8), np.uint8)
    out[lanes] = fps.view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(out, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(U64)


def near(plane: np.ndarray, valid: np.ndarray, fps: np.ndarray, query: np.ndarray, word: np.ndarray, mask: np.ndarray, radius: int):
    """(job, lane) for each lane in mask & valid of job's word within the radius of job's query."""
    job = np.arange(len(query))
    n_bits = radius.bit_length()
    count = [np.zeros(len(job), U64) for _ in range(n_bits)]
    over = ~(valid[word] & mask)
    key = fps[query]
    for p in range(64):
        carry = plane[p][word] ^ (U64(0) - ((key >> U64(p)) & U64(1)))
        for c in count:
            c_in = carry
            carry = c & c_in
            c ^= c_in
        over |= carry
        if p % 6 == 5 or p == 63:  # abandon blocks whose lanes all exceed the radius
            live = np.flatnonzero(~over)
            if len(live) < 0.8 * len(job):
                job, word, key, over = job[live], word[live], key[live], over[live]
                count = [c[live] for c in count]
            if not len(job):
                return job, job
    hit = np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little"))
    at, lane = hit >> 6, hit & 63
    d = sum(((c[at] >> lane.astype(U64)) & U64(1)).astype(np.int64) << i for i, c in enumerate(count)) if n_bits else np.zeros(len(at), np.int64)
    at, lane = at[d <= radius], lane[d <= radius]
    return job[at], lane


class Forest:
    """Least labels of a small local graph."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.label[u], self.label[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            m = np.minimum(a, b)
            np.minimum.at(self.label, a, m)
            np.minimum.at(self.label, b, m)
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def tile_edges(sides: list[tuple[list, list]], radius: int, jobs: int = 8192):
    """Spanning forest edges of tiles; a tile (a, b) compares a with b, or a with itself if b is empty."""
    flat = [x for a, b in sides for x in (a, b)]
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    fps = np.fromiter((x for y in flat for x in y), np.int64, int(size.sum())).view(U64)
    n_words = (size + 63) // 64
    word0, first = np.cumsum(n_words) - n_words, np.cumsum(size) - size
    part = np.repeat(np.arange(len(flat)), size)
    rank = np.arange(len(fps)) - first[part]
    lane = word0[part] * 64 + rank
    words = int(n_words.sum())
    owner = np.full(words * 64, -1, np.int64)
    owner[lane] = np.arange(len(fps))
    plane = planes(fps, lane, words)
    valid = np.packbits(owner >= 0, bitorder="little").view(U64)
    alone = size[part | 1] == 0  # the tile's b is empty
    asks = np.flatnonzero((part % 2 == 0))
    target = np.where(alone, part, part | 1)[asks]
    skip = np.where(alone[asks], rank[asks] // 64, 0)
    n_jobs = n_words[target] - skip
    forest = Forest(len(fps))
    ends = np.cumsum(n_jobs)
    step = 0
    while step < len(asks):
        done = ends[step - 1] if step else 0
        stop = max(step + 1, int(np.searchsorted(ends, done + jobs, side="right")))
        q, t, s, n = asks[step:stop], target[step:stop], skip[step:stop], n_jobs[step:stop]
        query, word = np.repeat(q, n), ranges(word0[t] + s, n)
        own = np.repeat(alone[q], n) & (word == lane[query] // 64)
        mask = np.where(own, ~U64(0) << (lane[query] % 64).astype(U64) << U64(1), ~U64(0))
        job, at = near(plane, valid, fps, query, word, mask, radius)
        forest.join(query[job], owner[word[job] * 64 + at])
        step = stop
    u = np.flatnonzero(forest.label != np.arange(len(fps)))
    f = fps.view(np.int64)
    return f[u], f[forest.label[u]]


def _tiles(radius: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            held, size = [], 0
            for x in zip(a, b):
                held.append(x)
                size += len(x[0]) + len(x[1])
                if size >= 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(y) for y in tile_edges(held, radius)], schema=_EDGES)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in tile_edges(held, radius)], schema=_EDGES)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row for each input row: the id (bigint), fingerprint (16 hex digits), component_id.

    Rows link where their fingerprints differ in at most ``radius`` bits; component_id is the smallest
    id that can be reached over links, the row's own included.  Null and empty text have fingerprint
    zero and link like any other.  A null id is never a component's id unless the component has no
    other.  Repeated rows and ids give a row each; an empty table gives an empty result; other columns
    are not read.
    """
    prints, labels = _labelled(text_only(df, id_col, text_col), shingle, radius)
    out = prints.join(labels, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(id, th, fp) by row, and (fp, root, component_id) by fingerprint; th is the text's hash."""
    prints = checkpointed(docs.withColumn("th", F.xxhash64("text")).mapInArrow(_prints(shingle), "id bigint, th bigint, fp bigint"))
    reps = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("least")))
    masks = tables(reps.count(), radius)
    entries = reps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])).alias("e")).select("e.t", "e.key", "fp")
    sizes = entries.groupBy("t", "key").count().filter("count > 1")
    placed = entries.join(sizes, ["t", "key"]).withColumn("n", F.ceil(F.col("count") / TILE).cast("int"))
    placed = placed.withColumn("c", F.pmod(F.xxhash64("fp", F.lit("tile")), F.col("n")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    placed = placed.withColumn("i", F.least("c", "x")).withColumn("j", F.greatest("c", "x"))
    first = F.col("c") == F.col("i")
    tiles = placed.groupBy("t", "key", "i", "j").agg(F.collect_list(F.when(first, F.col("fp"))).alias("a"), F.collect_list(F.when(~first, F.col("fp"))).alias("b")).select("a", "b")
    stars = components(tiles.mapInArrow(_tiles(radius), "u bigint, v bigint"))
    rooted = reps.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, checkpointed(rooted.join(least, "root").select("fp", "root", "component_id"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component, all columns: that with the smallest id, then the smallest text hash; of rows equal in both
    the one whose other columns come first as JSON text.

    A null id only stays if its component has no other.  Null text counts as empty, and has fingerprint zero like any text
    without words; an empty table gives an empty result; other columns may have any names.
    """
    prints, labels = _labelled(text_only(df, id_col, text_col), shingle, radius)
    out = prints.join(labels, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(id, th, fp) by row, and (fp, root, component_id) by fingerprint; th is the text's hash."""
    prints = checkpointed(docs.withColumn("th", F.xxhash64("text")).mapInArrow(_prints(shingle), "id bigint, th bigint, fp bigint"))
    reps = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("least")))
    masks = tables(reps.count(), radius)
    entries = reps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])).alias("e")).select("e.t", "e.key", "fp")
    sizes = entries.groupBy("t", "key").count().filter("count > 1")
    placed = entries.join(sizes, ["t", "key"]).withColumn("n", F.ceil(F.col("count") / TILE).cast("int"))
    placed = placed.withColumn("c", F.pmod(F.xxhash64("fp", F.lit("tile")), F.col("n")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    placed = placed.withColumn("i", F.least("c", "x")).withColumn("j", F.greatest("c", "x"))
    first = F.col("c") == F.col("i")
    tiles = placed.groupBy("t", "key", "i", "j").agg(F.collect_list(F.when(first, F.col("fp"))).alias("a"), F.collect_list(F.when(~first, F.col("fp"))).alias("b")).select("a", "b")
    stars = components(tiles.mapInArrow(_tiles(radius), "u bigint, v bigint"))
    rooted = reps.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, checkpointed(rooted.join(least, "root").select("fp", "root", "component_id"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component, all columns: that with the smallest id (then the smallest text hash); a null
    id only stays if its component has no other."""
    prints, labels = _labelled(text_only(df, id_col, text_col), shingle, radius)
    known = prints.join(labels, "fp")
    first_id, first_th = unlike("first_id", df), unlike("first_th", df)
    firsts = known.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("f")).select(F.col("f.id").alias(first_id), F.col("f.th").alias(first_th))
    same = F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col(first_id)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(first_th))
    out = df.join(firsts, same, "left_semi")
    twice = prints.groupBy("id", "th").count().filter("count > 1").limit(1).count()
    if not twice:
        return out
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (id_col, text_col)]
    order = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit(0)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    firsts = out.groupBy(F.col(f"`{id_col}`").alias("k0"), F.col(f"`{text_col}`").alias("k1")).agg(F.min_by(row, order).alias("r"))
    return firsts.select(*[F.col("r").getField(c).alias(c) for c in df.columns])


def op1_query(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
