"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are tokenised once and cut into pieces.  A round range-sorts the pieces that are left and the gaps of the
open sequences together, by size.  Each partition sweeps upward: a piece waits, and a gap takes the largest piece
that waits, which is the best fit for both.  What a partition can't match in itself, gaps below its first piece
and pieces above its last gap, meets across partitions: from two counts a partition, every such piece and gap gets
its rank in the sweep, and equal ranks are a match.  Then the gaps are updated, and the next round begins.

A round opens as many sequences as the tokens that are left need beyond the gaps that are left.  Once there are many
short pieces to a gap, neighbours in the order are glued to bundles first, so that the number of rounds stays small
whatever the number of pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, checkpointed, gathered, ranges, raw, text_only, unlike
from .suffix_dedup import _POWERS, Prints

CHUNK = 2 << 20


class WordTable:
    """Numbers of words by their 64-bit hashes: an open-addressing table, looked up in bulk."""

    def __init__(self, bits: int):
        self.bits, self.keys, self.values, self.n = bits, np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32), 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for a new one."""
        out, slot, left = np.full(len(h), -1, np.int64), self._slots(h), np.arange(len(h))
        while len(left):
            k = self.keys[slot]
            same = k == h[left]
            out[left[same]] = self.values[slot[same]]
            on = ~same & (k != 0)
            left, slot = left[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """New, different words; returns their numbers, which follow on."""
        number = np.arange(self.n, self.n + len(h))
        slot, left = self._slots(h), np.arange(len(h))
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            got = free & (self.keys[slot] == h[left])
            self.values[slot[got]] = number[left[got]]
            left, slot = left[~got], (slot[~got] + 1) & (len(self.keys) - 1)
        self.n += len(h)
        return number


#: Classes of bytes of a lower-cased text: white space, letters, digits, marks, anything else.
_WHITE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_CLASS = np.array([_WHITE if c == 32 or 9 <= c <= 13 else _LETTER if 97 <= c <= 122 else _DIGIT if 48 <= c <= 57 else _MARK if 33 <= c <= 126 and c != 39 else _OTHER for c in range(256)], np.uint8)
#: Second bytes of the Latin-1 letters whose first is 0xC3 (all but the signs for times and divided by).
_LATIN = np.array([0x80 <= c <= 0xBF and c not in (0x97, 0xB7) for c in range(256)])


def text_parts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, simple) of the parts of a lower-cased buffer that ends in white space.

    Simple parts are a run of ASCII and Latin-1 letters, one digit, or a run of ASCII marks.  A run of letters
    or marks that touches an apostrophe or any other character after it, and such a character itself, begin a
    part that goes on to the next white space.
    """
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_LATIN[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    start = np.flatnonzero(new)
    end, kind = np.append(start[1:], len(data)), kind[start]
    keep, simple = kind != _WHITE, kind != _OTHER
    other = np.flatnonzero(kind == _OTHER)
    if len(other):
        white = np.flatnonzero(kind == _WHITE)
        chunk = np.cumsum(kind == _WHITE)  # between two stretches of white space
        other = other[np.diff(chunk[other], prepend=-1) != 0]
        touched = (other > 0) & np.isin(kind[other - 1], (_LETTER, _MARK))
        first = other - touched
        from_ = np.full(len(white) + 1, len(kind))
        from_[chunk[other]] = first
        keep &= np.arange(len(kind)) <= from_[chunk]
        end[first] = start[white[chunk[other]]]
        simple[first] = False
    return start[keep], end[keep], simple[keep]


#: Fixed: how a tokenizer file says that it lower-cases, drops white space and parts text as text_parts does.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PARTED = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def _eight(data: np.ndarray, start: np.ndarray, size: np.ndarray, at: int) -> np.ndarray:
    """Bytes ``at`` to ``at`` + 7 of some strings in a buffer with 8 bytes to spare, as numbers; 0 past their ends."""
    got = np.lib.stride_tricks.sliding_window_view(data, 8)[start + at]
    return got.view(U64)[:, 0] & _LOW_BYTES[np.minimum(size - at, 8)]


class Tokens:
    """Token ids of texts, in bulk: the tokenizer itself only sees each new part of a word once.

    A tokenizer that lower-cases, drops white space and parts text into letters, single digits and runs of other
    characters before it merges is looked up by parts: what can be parted alike without doubt (see text_parts) is
    found by its hash and compared byte by byte; the rest goes to the tokenizer as it is.  Texts that may hold a
    special token, and all texts of any other tokenizer, go whole.
    """

    def __init__(self, path: str, bits: int = 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.bits, spec = Tokenizer.from_file(path), bits, json.loads(Path(path).read_text())
        special = all(x["content"].startswith("<|") for x in spec.get("added_tokens") or ())
        self.by_part = special and (spec.get("normalizer"), spec.get("pre_tokenizer"), spec["model"].get("end_of_word_suffix")) == (_NORMAL, _PARTED, "</w>")
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.table = WordTable(self.bits)
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint16 if len(self.last) < 1 << 16 else np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.text, self.place, self.width = np.zeros(8, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum())), sizes

    def joined(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for simple parts: each is one part to the tokenizer too, so its ids end where a word's end does."""
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, np.uint32)
        sizes = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        return (ids, sizes) if len(sizes) == len(words) and sizes.sum() == len(ids) else self.whole(words)

    def _learn(self, data: bytes, start: np.ndarray, end: np.ndarray, simple: np.ndarray, h: np.ndarray | None) -> np.ndarray:
        """Take parts up, under their hashes if there are any; returns their numbers."""
        ids, sizes = [], []
        order = np.argsort(~simple, kind="stable")
        n = int(simple.sum())
        words = [data[a:b] for a, b in zip(start[order].tolist(), end[order].tolist())]
        for encode, part in [(self.joined, words[at : min(at + 4096, n)]) for at in range(0, n, 4096)] + ([(self.whole, words[n:])] if n < len(words) else []):
            i, s = encode(part)
            ids.append(i.astype(self.flat.dtype))
            sizes.append(s.astype(np.int32))
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(self.sizes), len(self.sizes) + len(words)) if h is None else self.table.add(h[order])
        self.table.n = len(self.sizes) + len(words)
        sizes = np.concatenate(sizes)
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes, self.flat = np.append(self.sizes, sizes), np.concatenate([self.flat, *ids])
        width = (end - start)[order]
        self.place, self.width = np.append(self.place, len(self.text) - 8 + np.cumsum(width) - width), np.append(self.width, width)
        self.text = np.concatenate([self.text[:-8], np.frombuffer(b"".join(words), np.uint8), np.zeros(8, np.uint8)])
        return number

    def _differ(self, number: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which parts don't have the bytes of those that they were found as."""
        same, at = self.width[number] == size, 0
        i = np.flatnonzero(same)
        while len(i):
            equal = _eight(data, start[i], size[i], at) == _eight(self.text, self.place[number[i]], size[i], at)
            same[i[~equal]] = False
            at += 8
            i = i[equal & (size[i] > at)]
        return np.flatnonzero(~same)

    def encoded(self, texts: list[bytes]):
        """The ids of each text."""
        if not self.by_part:
            for text in texts:
                yield self.whole([text])[0]
            return
        low = [text.lower() for text in texts]
        special = {i for i, text in enumerate(low) if b"<|" in text}
        data = b"\n".join([b"" if i in special else text for i, text in enumerate(low)] + [b""])
        stops = np.cumsum([0 if i in special else len(text) for i, text in enumerate(low)]) + np.arange(len(low))
        del low
        buffer = np.frombuffer(data, np.uint8)
        start, end, simple = text_parts(buffer)
        h = Prints(buffer).of(start, end - start)
        h[h == 0] = 1
        number = self.table.find(h)
        if (number < 0).any():
            if self.table.n + (number < 0).sum() > len(self.table.keys) // 2:
                self.clear()
                number[:] = -1
            new = np.flatnonzero(number < 0)
            _, at = np.unique(h[new], return_index=True)
            at = new[at]
            self._learn(data, start[at], end[at], simple[at], h[at])
            number[new] = self.table.find(h[new])
        padded = np.append(buffer, np.zeros(8, np.uint8))
        odd = self._differ(number, padded, start, end - start)
        if len(odd):  # another part has their hash
            number[odd] = self._learn(data, start[odd], end[odd], simple[odd], None)
        sizes = self.sizes[number].astype(np.int64)
        ids = self.flat[ranges(self.starts[number], sizes)]
        cut = np.append(0, np.cumsum(sizes))[np.searchsorted(start, stops, side="left")]
        first = 0
        for i, (text, stop) in enumerate(zip(texts, cut.tolist())):
            yield self.whole([text])[0] if i in special else ids[first:stop]
            first = stop


_KEPT: dict[str, Tokens] = {}
_PIECES = T.StructType([T.StructField("id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def _pieces(path: str, capacity: int, last: int, with_ids: bool):
    def run(batches):
        tokens = _KEPT.get(path) or _KEPT.setdefault(path, Tokens(path))
        for table in gathered(batches, CHUNK):
            texts = [x or b"" for x in raw(table.column("text").combine_chunks())]
            rows: list[list] = [[], [], [], [], [], []]
            for i, ids in zip(table.column("id").to_pylist(), tokens.encoded(texts)):
                ids = np.append(ids, np.uint32(last)).astype("<u4")
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for col, x in zip(rows, (i, p, at, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None)):
                        col.append(x)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names)

    return run


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 4096, last: int = 1, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each row's tokens and an end token, cut where longer than ``capacity``."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    schema = T.StructType(list(_PIECES.fields) + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))
    return text_only(df, id_col, text_col).mapInArrow(_pieces(tokenizer, capacity, last, with_ids), schema)


#: Pieces and gaps to a partition of a sweep; short pieces to a gap from which on they are glued.
ROWS, GLUE = 1 << 17, 16
#: What is left is laid end to end in sequences of its own once a round places less than an eighth of it and it is no more
#: than this part of all tokens; how many such rounds in a row, with more left, open sequences for all of it.
REST, SLOW = 256, 3
#: Numbers from here on are bundles.
_BUNDLE = 1 << 60
_SWEPT = "uid bigint, seq bigint, length bigint, gap bigint, part int, rank bigint"


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else ([],) * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "part" else pa.int64()) for c, n in zip(cols, names)], names)


def _sweep(batches):
    """A partition of pieces (seq -1) and gaps (uid -1) by size: matches, and the rest with its rank among its kind.

    What tokenising kept in this worker process is no longer needed, and makes room.
    """
    _KEPT.clear()
    _POWERS.clear()
    part, waiting, gaps = TaskContext.get().partitionId(), [], 0
    names = ["uid", "seq", "length", "gap", "part", "rank"]
    for b in batches:
        rows = []
        for uid, seq, size in zip(*(b.column(c).to_pylist() for c in ("uid", "seq", "size"))):
            if seq < 0:
                waiting.append((uid, size))
            elif waiting:
                rows.append((waiting[-1][0], seq, waiting.pop()[1], size, part, -1))
            else:
                rows.append((-1, seq, 0, size, part, gaps))
                gaps += 1
        yield _rows(rows, names)
    yield _rows([(uid, -1, size, 0, part, rank) for rank, (uid, size) in enumerate(waiting)], names)


def across(counts: dict[int, tuple[int, int]]) -> list[tuple[int, bool, int, int, int]]:
    """From each partition's (gaps, pieces) that are left: intervals of ranks that meet in the sweep over all partitions.

    (partition, whether of pieces, first rank, last rank + 1, number of the match at the first rank).  Numbers rise with
    the rank of a gap and fall with that of a piece.  There are at most four for each partition.
    """
    out, waiting, number = [], [], 0
    for part in sorted(counts):
        n_gaps, n_pieces = counts[part]
        at = 0
        while at < n_gaps and waiting:
            other, n = waiting.pop()
            m = min(n, n_gaps - at)
            out += [(part, False, at, at + m, number), (other, True, n - m, n, number + m - 1)]
            at, number = at + m, number + m
            if n > m:
                waiting.append((other, n - m))
        if n_pieces:
            waiting.append((part, n_pieces))
    return out


def _matched(items: DataFrame, n: int) -> DataFrame:
    """A round: (uid, seq, length, gap) of matches, of pieces that are left (seq -1) and of gaps that are (uid -1)."""
    kind = F.col("seq") >= 0  # a piece goes before a gap of its size
    ordered = items.repartitionByRange(n, "size", kind, F.xxhash64("uid", "seq")).sortWithinPartitions("size", kind, F.xxhash64("uid", "seq"))
    swept = checkpointed(ordered.mapInArrow(_sweep, _SWEPT))
    ends = swept.filter("rank >= 0").groupBy("part").agg(F.count_if(F.col("seq") >= 0).alias("gaps"), F.count_if(F.col("seq") < 0).alias("pieces")).collect()
    intervals = across({r["part"]: (r["gaps"], r["pieces"]) for r in ends})
    table = items.sparkSession.createDataFrame(intervals, "of int, waits boolean, low bigint, high bigint, first bigint")
    inside = (F.col("part") == F.col("of")) & ((F.col("seq") < 0) == F.col("waits")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    met = swept.join(F.broadcast(table), inside, "left")
    steps = F.when(F.col("waits"), F.col("low") - F.col("rank")).otherwise(F.col("rank") - F.col("low"))
    one = F.coalesce(F.col("first") + steps, -1 - F.monotonically_increasing_id())  # or a row by itself
    pairs = met.select("uid", "seq", "length", "gap", one.alias("number")).groupBy("number")
    return checkpointed(pairs.agg(*[F.max(c).alias(c) for c in ("uid", "seq", "length", "gap")]).drop("number"))


def _glue(limit: int, base: int):
    """Pieces of a sorted partition laid end to end in bundles of at most ``limit`` tokens, or of one piece."""

    def run(batches):
        bundle, held = base + (TaskContext.get().partitionId() << 32), 0
        for b in batches:
            rows = []
            for uid, length in zip(b.column("uid").to_pylist(), b.column("length").to_pylist()):
                if held and held + length > limit:
                    bundle, held = bundle + 1, 0
                rows.append((uid, bundle, held, length))
                held += length
            yield _rows(rows, ["uid", "bundle", "inner", "length"])

    return run


def pack(pieces: DataFrame, capacity: int = 4096, rows: int = ROWS) -> DataFrame:
    """Pieces (id, piece, length and more) with sequence_id and offset.

    Lengths are 1 to ``capacity``.  ``rows`` is how many pieces and gaps a partition of a round sweeps.  What reaches
    the driver in a round is two counts a partition and a row of totals.

    Rounds go on until nothing is left, however many it takes.  One that places nothing, and the third in a row that places less
    than an eighth of the pieces, is followed by one with sequences enough for all tokens that are left, which takes a
    piece into each.  The one exception to best fit is small by tokens: what a slow round leaves is laid end to end if
    it is no more than a 256th of them.
    """
    spark, columns, uid = pieces.sparkSession, pieces.columns, unlike("uid", pieces)
    pieces = checkpointed(pieces.withColumn(uid, F.monotonically_increasing_id()))
    none = F.lit(-1).cast("bigint")
    left = pieces.select(F.col(uid).alias("uid"), F.col("length").cast("bigint").alias("length"))
    gaps = spark.createDataFrame([], "seq bigint, gap bigint")
    n_pieces, tokens = left.agg(F.count("*"), F.sum("length")).first()
    n_left, total = n_pieces, tokens or 0
    items = left.select("uid", none.alias("seq"), F.col("length").alias("size"))
    n_gaps = room = opened = 0
    least, slow, turn, placed, bundles = 1, 0, 0, [], []
    stuck = False
    parts = lambda n: max(1, -(-n // rows))
    while n_left:
        new = max(0, -(-(tokens - room) // capacity), -(-tokens // capacity) if stuck else 0)
        last = slow > 0 and tokens * REST <= total
        if last or (turn and n_left > GLUE * (n_gaps + new)):
            ordered = left.repartitionByRange(parts(n_left), F.col("length").desc(), "uid").sortWithinPartitions(F.col("length").desc(), "uid")
            glued = checkpointed(ordered.mapInArrow(_glue(capacity if last else capacity // 8, _BUNDLE + (len(bundles) << 54)), "uid bigint, bundle bigint, inner bigint, length bigint"))
            bundles.append(glued)
            left = glued.groupBy("bundle").agg(F.sum("length").alias("length"))
            n_left = left.count()
            new = n_left if last else new
            items = left.select("bundle", none, "length").union(gaps.select(none, "seq", "gap")).toDF("uid", "seq", "size")
        fresh = spark.range(opened, opened + new, numPartitions=parts(new)).select(none, "id", F.lit(capacity).cast("bigint"))
        opened += new
        state = _matched(items.union(fresh), parts(n_left + n_gaps + new))
        placed.append(state.filter("uid >= 0 AND seq >= 0").select("uid", "seq", (F.lit(capacity) - F.col("gap")).alias("offset")))
        waits, rest = F.col("seq") < 0, F.col("gap") - F.col("length")
        left = state.filter(waits).select("uid", "length")
        gaps = state.filter(~waits & (rest >= least)).select("seq", rest.alias("gap"))
        items = state.filter(waits | (rest >= least)).select(F.when(waits, F.col("uid")).otherwise(none).alias("uid"), "seq", F.when(waits, F.col("length")).otherwise(rest).alias("size"))
        before = n_left
        piece, gap = F.when(waits, F.col("length")), F.when(~waits & (rest >= least), rest)
        n_left, tokens, shortest, n_gaps, room = (x or 0 for x in state.agg(F.count(piece), F.sum(piece), F.min(piece), F.count(gap), F.sum(gap)).first())
        least, slow, turn = max(least, shortest), slow + 1 if 8 * n_left > 7 * before else 0, turn + 1
        stuck = n_left == before or slow >= SLOW
    where = reduce(DataFrame.union, placed).coalesce(parts(n_pieces)) if placed else spark.createDataFrame([], "uid bigint, seq bigint, offset bigint")
    for glued in reversed(bundles):
        inside = glued.join(where.withColumnRenamed("uid", "bundle"), "bundle").select("uid", "seq", (F.col("offset") + F.col("inner")).alias("offset"))
        where = where.join(glued.select(F.col("bundle").alias("uid")).distinct(), "uid", "left_anti").union(inside)
    out = pieces.join(where.select(F.col("uid").alias(uid), F.col("seq").alias("sequence_id"), F.col("offset").alias("offset")), uid)
    return out.select(*columns, "sequence_id", "offset")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Tokenise and pack every row: one row for each piece.

    Columns: the id (bigint), piece (from 0), start, length, ids_crc32, (ids, if ``with_ids``), sequence_id
    and offset.  See pack for when a small rest is laid end to end.  Null or empty text is one piece that holds the end token alone.  Each row is a document,
    repeated rows and ids too; an empty table gives an empty result; other columns are not read.
    """
    out = pack(token_pieces(df, id_col, text_col, **options), options.get("capacity", 4096))
    return out.withColumnRenamed("id", id_col)


def op3_query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
