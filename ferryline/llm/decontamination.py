"""Benchmark decontamination with an FM-index per training shard.

A shard is the text that a task holds at once.  Its words become symbols (benchmark words 1..V, anything
else 0); what no window can match, stretches without enough benchmark words in a row, is left out.  From the suffix
array of the rest come the Burrows-Wheeler transform, a wavelet matrix over it for ranks, and sampled suffix
positions.  All benchmark windows are searched backward in lockstep; their ranges are located by stepping to the next
sample, and the occurrences merge into removal spans by document.

The benchmark, a stated query set, goes to the tasks in blocks of a bounded number of words, some blocks to a pass
over the documents.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, bounds, gathered, ranges, raw, text_only, unlike

#: Bytes of text in a shard; words of the benchmark in a block; blocks to a pass; gap between sampled suffixes; windows
#: searched in lockstep.
SHARD, BLOCK_WORDS, PASS, SAMPLE, LOCKSTEP = 6 << 20, 1 << 20, 8, 8, 1 << 16
#: Fixed: A-Z to lower case; every other ASCII character but digits and letters parts words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


def suffix_array(t: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array of symbols under 2**bits by prefix doubling (an end sorts before anything)."""
    n = len(t)
    h = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(h):
        key <<= bits
        key[: max(0, n - j)] |= t[j:].astype(np.int64)
    while True:
        order = np.argsort(key)
        k = key[order]
        fresh = np.empty(n, np.int64)
        fresh[:1], fresh[1:] = 1, k[1:] != k[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if n == 0 or rank[order[-1]] == n:
            return order
        key = rank * (n + 1)
        if h < n:
            key[: n - h] += rank[h:]
        h *= 2


class Wavelet:
    """Wavelet matrix: ranks of a symbol in any prefix."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.words, self.before, self.zeros = bits, [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (s >> level) & 1
            packed = np.packbits(bit.astype(bool), bitorder="little")
            w = np.zeros((len(s) // 64 + 1) * 8, np.uint8)
            w[: len(packed)] = packed
            w = w.view(U64)
            ones = np.bitwise_count(w).astype(np.int64)
            self.words.append(w)
            self.before.append(np.cumsum(ones) - ones)
            self.zeros.append(len(s) - int(ones.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for at, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((c >> level) & 1).astype(bool)
            moved = []
            for x in (start, i):
                ones = self.before[at][x >> 6] + np.bitwise_count(self.words[at][x >> 6] & ((U64(1) << (x & 63).astype(U64)) - U64(1))).astype(np.int64)
                moved.append(np.where(one, self.zeros[at] + ones, x - ones))
            start, i = moved
        return i - start


class FMIndex:
    """Index of symbols 0..n_symbols; an end mark of its own comes after them and sorts first."""

    def __init__(self, t: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        t, n_symbols = np.append(t + 1, 0), n_symbols + 1
        self.n, bits = len(t), int(n_symbols).bit_length()
        sa = suffix_array(t, bits)
        self.bwt = t[sa - 1]
        self.tree = Wavelet(self.bwt, bits)
        self.first = np.cumsum(np.bincount(t + 1, minlength=n_symbols + 2))[: n_symbols + 1]
        self.sampled = sa % sample == 0
        self.at, self.value = np.cumsum(self.sampled) - 1, sa[self.sampled]

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[c] + self.tree.rank(c, i)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns (rows of a matrix, right-aligned), searched backward in lockstep."""
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        for j in range(patterns.shape[1]):
            live = np.flatnonzero((lengths > j) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, patterns.shape[1] - 1 - j] + 1
            lo[live], hi[live] = self.step(c, lo[live]), self.step(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, rows, steps, left = np.zeros(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.value[self.at[rows[done]]] + steps
            left, rows, steps = left[~done], rows[~done], steps + 1
            rows = self.step(self.bwt[rows], rows)
        return out


class Windows:
    """The windows of a block of benchmark items: places in the items' words, which are numbers."""

    def __init__(self, items, k: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str | None] = []
        words, starts, lengths, owners = array("i"), array("q"), array("i"), array("i")
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                n = max(1, len(ids) - k + 1)
                starts.extend(range(len(words), len(words) + n))
                lengths.extend([min(k, len(ids))] * n)
                owners.extend([len(self.items)] * n)
                words.extend(ids)
                self.items.append(None if item is None else str(item))
        self.words, self.starts, self.lengths, self.owners, self.k = np.array(words, np.int32), np.array(starts, np.int64), np.array(lengths, np.int32), np.array(owners, np.int32), k

    def patterns(self, some: slice) -> np.ndarray:
        """Some windows as rows of a matrix, right-aligned."""
        at = self.starts[some, None] + self.lengths[some, None] - self.k + np.arange(self.k)
        return np.where(at >= self.starts[some, None], self.words[np.maximum(at, 0)], 0).astype(np.int64)

    def occurrences(self, symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence within one document."""
        none = np.zeros(0, np.int64)
        if not len(self.lengths) or not len(symbols):
            return none, none
        starts, size = bounds((doc != np.roll(doc, 1)) | ((symbols == 0) != (np.roll(symbols, 1) == 0)))
        keep = (symbols[starts] > 0) & (size >= self.lengths.min())
        starts, size = starts[keep], size[keep]
        if not len(starts):
            return none, none
        places = ranges(starts, size + 1)  # one more for the parting 0
        t = np.where(np.arange(len(places)) == np.repeat(np.cumsum(size + 1) - 1, size + 1), 0, symbols[np.minimum(places, len(symbols) - 1)])
        index = FMIndex(t, len(self.vocabulary))
        windows, found = [none], [none]
        for a in range(0, len(self.lengths), LOCKSTEP):
            some = slice(a, min(a + LOCKSTEP, len(self.lengths)))
            lo, hi = index.search(self.patterns(some), self.lengths[some])
            n = np.maximum(hi - lo, 0)
            windows.append(a + np.repeat(np.arange(len(n)), n))
            found.append(places[index.locate(ranges(lo, n))])
        return np.concatenate(windows), np.concatenate(found)


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))
_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("th", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", _SPAN)])
_ARROW = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))])


def _search(shared: list):
    """mapInArrow: what the windows of some blocks hit in each row."""

    def run(batches):
        for table in gathered(batches, SHARD):
            lists = [words_of(x) for x in raw(table.column("text").combine_chunks())]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            total, first = int(counts.sum()), np.cumsum(counts) - counts
            doc = np.repeat(np.arange(len(counts)), counts)
            edge = np.zeros(total + 1, np.int64)
            spans, items = defaultdict(list), defaultdict(set)
            for block in shared:
                bench = block.value
                symbols = np.fromiter(map(bench.vocabulary.get, (w for x in lists for w in x), repeat(0)), np.int64, total)
                window, place = bench.occurrences(symbols, doc)
                np.add.at(edge, place, 1)
                np.add.at(edge, place + bench.lengths[window], -1)
                pair = np.unique(doc[place] * max(1, len(bench.items)) + bench.owners[window])
                for d, i in zip((pair // max(1, len(bench.items))).tolist(), (pair % max(1, len(bench.items))).tolist()):
                    if bench.items[i] is not None:
                        items[d].add(bench.items[i])
            del lists
            hit = np.cumsum(edge[:total]) > 0
            n_hit = np.bincount(doc[hit], minlength=len(counts))
            at = np.flatnonzero(hit)
            if len(at):
                s, n = bounds((np.diff(at, prepend=-2) != 1) | (doc[at] != np.roll(doc[at], 1)))
                for a, m in zip(at[s].tolist(), n.tolist()):
                    spans[int(doc[a])].append({"start": a - int(first[doc[a]]), "length": m})
            n = range(len(counts))
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), table.column("th").combine_chunks(), pa.array(counts), pa.array(n_hit, pa.int64()), pa.array([sorted(items[d]) if d in items else [] for d in n], _ARROW.field("items").type), pa.array([spans.get(d, []) for d in n], _ARROW.field("spans").type)], schema=_ARROW)

    return run


def _merged(table: pa.Table) -> pa.Table:
    """applyInArrow: what the passes over a very large benchmark found in one document (and in its equals)."""
    rows = table.to_pylist()
    places = sorted({p for r in rows for s in r["spans"] for p in range(s["start"], s["start"] + s["length"])})
    spans: list[dict] = []
    for p in places:
        if spans and spans[-1]["start"] + spans[-1]["length"] == p:
            spans[-1]["length"] += 1
        else:
            spans.append({"start": p, "length": 1})
    one = rows[0] | {"n_hit": len(places), "items": sorted({x for r in rows for x in r["items"]}), "spans": spans}
    copies = sum(r["block"] == rows[0]["block"] for r in rows)
    return pa.Table.from_pylist([{k: one[k] for k in _ARROW.names}] * copies, schema=_ARROW)


def benchmark_hits(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 13, block_words: int = BLOCK_WORDS, blocks: int = PASS) -> DataFrame:
    """Where windows of the benchmark's items occur in each row's text.

    Returns one row for each input row: the id (bigint), n_words, n_hit (words inside any occurrence), items
    (ids of items with occurring windows, sorted as strings), spans (merged, in words: start, length).  A
    window is k consecutive item words; an item of fewer words, but not none, is one window.  Null text has
    no words.  An item with a null id still hits but is not named; repeated items count once.  Repeated rows
    get a row each; empty tables give no hits or no rows; other columns are not read.  The benchmark goes to
    the tasks in blocks of about ``block_words`` words (of an item of more than that, one block is made), ``blocks``
    of them to a pass over the documents: one pass needs no shuffle, what several find is merged by document.
    """
    spark = df.sparkSession
    docs = text_only(df, id_col, text_col).withColumn("th", F.xxhash64("text"))
    asked = bench.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")).filter("text IS NOT NULL")
    words = asked.agg(F.sum(F.size(F.split("text", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+")))).first()[0] or 0
    n = -(-words // block_words) or 1
    shared = []
    for b in range(n):
        block = asked if n == 1 else asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        shared.append(spark.sparkContext.broadcast(Windows(((r["item"], r["text"].encode()) for r in block.toLocalIterator()), k)))
    parts = [docs.mapInArrow(_search(shared[a : a + blocks]), _SCHEMA).withColumn("block", F.lit(a)) for a in range(0, n, blocks)]
    out = parts[0]
    if len(parts) > 1:
        for x in parts[1:]:
            out = out.union(x)
        out = out.groupBy("id", "th").applyInArrow(_merged, _SCHEMA)
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select(F.col("id").alias(id_col), F.col("th").alias("text_hash"), "n_words", "n_hit", "items", "spans", contaminated.alias("contaminated"))


def decontaminate(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows, all columns, that the contamination rule (a twentieth of the words hit) leaves.

    Null and empty text has no words and stays; repeated rows stay or go together; an empty table gives an empty result, and an
    empty benchmark leaves all rows.
    """
    bad_id, bad_text = unlike("bad_id", df), unlike("bad_text", df)
    bad = benchmark_hits(df, bench, id_col, text_col, **options).filter("contaminated").select(F.col(id_col).alias(bad_id), F.col("text_hash").alias(bad_text)).distinct()
    same = F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col(bad_id)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(bad_text))
    return df.join(bad, same, "left_anti")


def op10_query(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = benchmark_hits(read("documents").select("doc_id", "text"), read("benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
b AS (SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0),
a AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM q),
z AS (SELECT DISTINCT n FROM a),
g AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM w, z WHERE len(w) >= n),
h AS (SELECT g.doc_id, g.p, g.n, a.item_id FROM g JOIN a ON g.n = a.n AND array_to_string(g.w[g.p:g.p + g.n - 1], ' ') = a.s),
c AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
