"""Repeated byte strings by a run-length suffix index.

Every window of ``length`` bytes belongs to its minimizer, the least hash among its 64-byte seeds; maximal
runs of windows with one minimizer make a stretch, and equal windows always share a minimizer.  Stretches
travel as hashes.  Stretches that are equal throughout are repeated throughout; one whose minimizer occurs
once and nowhere else has no repeated window.  The rest, a fringe around edits and the ends of copies, and one
copy of each stretch that shares their minimizer, go to an index as bytes.

An index holds whole minimizer groups.  It builds the Burrows-Wheeler transform of their stretches,
compresses it to runs, and samples text positions at the ends of the runs.  Matching statistics are
streamed over the text: at a run's ends the match with the neighbouring suffix is measured, within a run it
is one shorter than at the position before.  Windows that match for ``length`` bytes or more are marked.

A passage that very many documents have, with other bytes around it, would give its seeds as many different
stretches as it has surroundings.  A first pass over all texts finds the seeds that lie in so many different
stretches of one minimizer (a bounded list), and a window takes its minimizer among its other seeds where it has
one: across the passage's ends there is always a seed that few share.  Windows without such a seed lie within
common text, so that their stretches have few different contents, and a task sends each of those at most twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REPORT_FROM, SPREAD_FROM, U64, KeyList, bounds, buckets, checkpointed, covered, deltas, gathered, heavy_keys, longs, mix, pack, ranges, raw, reported, text_only, unpack
from .decontamination import suffix_array

#: Bytes of text in a chunk; bytes in an index; windows in a stretch at most.
CHUNK, INDEX, STRETCH = 2 << 20, 2 << 20, 256
SEED = 64
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.int64).view(U64) * U64(2) + _RNG.integers(0, 2, 256).astype(U64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, U64)
            p[:1] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


class Prints:
    """Hashes of any strings of one byte buffer."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])

    def of(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return mix((self.sums[starts + lengths] - self.sums[starts]) * self.down[starts] + lengths.astype(U64))


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by minima from the left and from the right of blocks of w."""
    n = len(h) - w + 1
    padded = np.full(-(-len(h) // w) * w, ~U64(0), U64)
    padded[: len(h)] = h
    block = padded.reshape(-1, w)
    left = np.minimum.accumulate(block, axis=1).reshape(-1)
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def stretches(data: np.ndarray, sizes: np.ndarray, length: int, common: KeyList):
    """The stretches of the documents in a buffer: minimizer, hash, document, start in it, windows, whether the
    minimizer occurs more than once in it (only then can a stretch repeat a window of its own), whether all its
    seeds are common ones; and the hashes of all seeds, with each stretch's place and width among them."""
    first = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - length + 1, 0)
    none = np.zeros(0, np.int64)
    if not n.sum():
        return none.view(U64), none.view(U64), none, none, none, none.astype(bool), none.astype(bool), none.view(U64), none, none
    prints = Prints(data)
    grams, w = prints.grams(SEED), length - SEED + 1
    at = ranges(first, n)
    doc = np.repeat(np.arange(len(sizes)), n)
    low, bare = window_min(grams, w)[at], np.zeros(len(at), bool)
    if len(common):
        light = window_min(np.where(common.has(grams), ~U64(0), grams), w)[at]
        bare = light == ~U64(0)
        low = np.where(bare, low, light)
    starts, size = bounds((low != np.roll(low, 1)) | (doc != np.roll(doc, 1)) | (bare != np.roll(bare, 1)))
    pieces = -(-size // STRETCH)
    k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(np.repeat(size, pieces) - k * STRETCH, STRETCH)
    starts = np.repeat(starts, pieces) + k * STRETCH
    place, doc = at[starts], doc[starts]
    seed, again = low[starts], np.zeros(len(starts), bool)
    for a in range(0, len(starts), 4096):
        b = slice(a, a + 4096)
        wide = size[b] + w - 1
        same = grams[ranges(place[b], wide)] == np.repeat(seed[b], wide)
        again[b] = np.add.reduceat(same, np.cumsum(wide) - wide, dtype=np.int64) > 1
    return seed, prints.of(place, size + length - 1), doc, place - first[doc], size, again, bare[starts], grams, place, size + w - 1


_BLOB = pa.schema([("q", pa.int32()), ("blob", pa.binary())])
_FOUND = pa.schema([("blk", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def _by(key: np.ndarray):
    """(key, row numbers) for each key."""
    order = np.argsort(key, kind="stable")
    starts, n = bounds(np.diff(key[order], prepend=-1) != 0)
    for a, m in zip(starts, n):
        yield int(key[order[a]]), order[a : a + m]


def _classes(seed: np.ndarray, print_: np.ndarray, size: np.ndarray):
    """Order that groups equal stretches, and where its classes begin and how large they are."""
    order = np.lexsort((print_, size, seed))
    a, b, c = seed[order], print_[order], size[order]
    return order, *bounds((a != np.roll(a, 1)) | (b != np.roll(b, 1)) | (c != np.roll(c, 1)))


def _chunks(batches, length: int, common: KeyList):
    """Each chunk's rows' keys and stretches, and which of equal stretches leads and which have equals."""
    for table in gathered(batches, CHUNK):
        keys = longs(table.column("key").combine_chunks())
        texts = [x or b"" for x in raw(table.column("text").combine_chunks())]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        found = stretches(np.frombuffer(b"".join(texts), np.uint8), sizes, length, common)
        seed, print_, _, _, size = found[:5]
        if len(seed):
            order, starts, n = _classes(seed, print_, size)
            many, lead = np.zeros(len(seed), bool), np.zeros(len(seed), bool)
            many[order] = np.repeat(n > 1, n)
            lead[order[starts]] = True
            yield keys, found, many, lead


def _reports(q_n: int, length: int, factor: float, least: int):
    """mapInArrow: for each chunk how many different stretches it has, and the seeds that lie in many different
    stretches of one minimizer: in half of what would make them common, were all chunks alike."""
    def run(batches):
        for _, (seed, _, _, _, _, _, _, grams, place, wide), _, lead in _chunks(batches, length, KeyList()):
            own = seed[lead]
            often = max(least, int(factor * len(own) / q_n / 2))
            found, n = np.unique(own, return_counts=True)
            i = np.flatnonzero(lead)[KeyList(found[n >= often]).has(own)]
            found, n = np.unique(grams[ranges(place[i], wide[i])], return_counts=True)
            yield reported(len(own), found[n >= often], n[n >= often])

    return run


def _send(q_n: int, length: int, common: KeyList):
    """mapInArrow: (key, text) to blobs by partition: stretches to that of their minimizer, stretches that are
    known to repeat to that of their row.

    Of stretches that repeat within a chunk one is sent as a double and the others are settled; of those without
    any but common seeds, what the task has sent twice is settled too.
    """
    def run(batches):
        times: dict = {}
        for keys, (seed, print_, doc, pos, size, again, bare, _, _, _), many, lead in _chunks(batches, length, common):
            key, settled = keys[doc], many & ~lead
            for i in np.flatnonzero(lead & bare).tolist():
                own = (int(seed[i]), int(print_[i]), int(size[i]))
                times[own] = times.get(own, 0) + 1
                settled[i] = times[own] > 2
            todo, done = np.flatnonzero(lead & ~settled), np.flatnonzero(settled)
            by_seed, by_key = dict(_by((seed[todo] % U64(q_n)).astype(np.int64))), dict(_by(np.mod(key[done], q_n)))
            out_q, out, none = [], [], np.zeros(0, np.int64)
            for q in sorted({*by_seed, *by_key}):
                s, d = todo[by_seed.get(q, none)], done[by_key.get(q, none)]
                out_q.append(q)
                out.append(pack(seed[s], print_[s], key[s], pos[s].astype(np.int32), size[s].astype(np.int16), many[s].astype(np.int8), again[s].astype(np.int8), key[d], pos[d].astype(np.int32), size[d].astype(np.int16)))
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int32()), pa.array(out, pa.binary())], schema=_BLOB)

    return run


def _pack_runs(key: np.ndarray, pos: np.ndarray, size: np.ndarray) -> bytes:
    order = np.lexsort((pos, key))
    return pack(deltas(key[order]), pos[order].astype(np.int32), size[order].astype(np.int16))


def _settle(blk_n: int):
    """applyInArrow over one partition of minimizers: kind 0, runs of repeated windows; kind 1, stretches to index."""
    def run(table: pa.Table) -> pa.Table:
        got = [unpack(x) for x in raw(table.column("blob").combine_chunks())]
        seed, print_, key, pos, size, many, again, d_key, d_pos, d_size = (np.concatenate(x) for x in zip(*got))
        order, starts, n = _classes(seed, print_, size)
        total = np.add.reduceat(many[order].astype(np.int64) + 1, starts)  # a double counts twice
        lead = order[starts]
        g_start, g_n = bounds(seed[lead] != np.roll(seed[lead], 1))
        open_ = np.logical_or.reduceat(total == 1, g_start) & ((g_n > 1) | np.logical_or.reduceat((total == 1) & (again[lead] > 0), g_start))
        ask = lead[np.repeat(open_, g_n)]
        role = (total == 1)[np.repeat(open_, g_n)]
        done = np.zeros(len(seed), bool)
        done[order] = np.repeat(total > 1, n)
        i = np.flatnonzero(done)
        d_key, d_pos, d_size = (np.concatenate(x) for x in ((d_key, key[i]), (d_pos, pos[i]), (d_size, size[i])))
        rows = []
        for b, i in _by(np.mod(d_key, blk_n)):
            rows.append((b, 0, _pack_runs(d_key[i], d_pos[i], d_size[i])))
        for b, i in _by(np.mod(key[ask], blk_n)):
            j = ask[i]
            rows.append((b, 1, pack(key[j], pos[j], size[j], seed[j], role[i].astype(np.int8))))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([],) * 3, _FOUND.types)], schema=_FOUND)

    return run


def _grouped(keys: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    starts, n = bounds(keys[order] != np.roll(keys[order], 1))
    return {int(keys[order[a]]): order[a : a + m] for a, m in zip(starts, n)}


def _fetch(q_n: int, length: int):
    """Cogroup of a block's documents with what is asked of them: the stretches' bytes, by partition of their
    minimizer."""
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        rows: list = []
        if asked.num_rows:
            key, pos, size, seed, role = (np.concatenate(x) for x in zip(*(unpack(x) for x in raw(asked.column("blob").combine_chunks()))))
            where = _grouped(key)
            piece: list = [None] * len(key)
            for k, text in zip(docs.column("key").to_pylist(), raw(docs.column("text").combine_chunks())):
                for j in where.pop(k, np.zeros(0, np.int64)).tolist():
                    a = int(pos[j])
                    piece[j] = text[a : a + int(size[j]) + length - 1]
            for q, i in _by((mix(seed) % U64(q_n)).astype(np.int64)):
                meta = pack(key[i], pos[i], size[i], seed[i], role[i])
                rows.append((q, len(meta).to_bytes(4, "little") + meta + b"".join(piece[j] for j in i.tolist())))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([],) * 2, _BLOB.types)], schema=_BLOB)

    return run


class RunIndex:
    """Run-length Burrows-Wheeler index of texts (symbols from 1 to 256, each text ended by a 0).

    Rows whose symbol before is an end are runs of their own, as if all ends differed, so that no match goes past
    one.  Only the text and the positions at the ends of runs are kept.
    """

    def __init__(self, t: np.ndarray):
        self.t = t = np.append(t + 1, 0)  # an end mark of its own; the ends of texts are 1
        sa = suffix_array(t, 9)
        bwt = t[sa - 1]
        new = np.flatnonzero((bwt[1:] != bwt[:-1]) | (bwt[1:] == 1)) + 1  # rows where a run begins
        self.sample, self.before = sa[new], sa[new - 1]

    def _matches(self) -> np.ndarray:
        """At each begin of a run, how far its suffix and the one before it agree, up to the end of a text."""
        n, t, wide = len(self.t), self.t, 6
        ahead = np.concatenate([t, np.zeros(wide, t.dtype)])
        six, over = np.zeros(n, np.int64), np.zeros(n, bool)
        for j in range(wide):
            six = (six << 10) | ahead[j : j + n]
            over |= ahead[j : j + n] <= 1
        match = np.zeros(len(self.sample), np.int64)
        a, b, live = self.sample.copy(), self.before.copy(), np.arange(len(match))
        while len(live):
            same = ~over[a] & (six[a] == six[b])
            stop, x, y = live[~same], a[~same], b[~same]
            for _ in range(wide):
                ok = (t[x] == t[y]) & (t[x] > 1)
                stop, x, y = stop[ok], x[ok] + 1, y[ok] + 1
                match[stop] += 1
            live, a, b = live[same], a[same] + wide, b[same] + wide
            match[live] += wide
        return match

    def statistics(self) -> np.ndarray:
        """For each text position, the length of its longest match with any other position."""
        n, match = len(self.t), self._matches()
        out = np.zeros(n, np.int64)
        for samples in (self.sample, self.before):  # with the suffix before, then with the one after, in suffix order
            reach = np.arange(n)
            np.maximum.at(reach, samples, samples + match)
            np.maximum(out, np.maximum.accumulate(reach) - np.arange(n), out=out)
        return out[: n - 1]


def _index(blk_n: int, length: int):
    """applyInArrow over one partition of stretches: runs of repeated windows, by block."""
    def run(table: pa.Table) -> pa.Table:
        out = list(_indexed(raw(table.column("blob").combine_chunks()), length))
        rows = []
        if out:
            k, p, m = (np.concatenate(x) for x in zip(*out))
            for b, i in _by(np.mod(k, blk_n)) if len(k) else ():
                rows.append((b, 0, _pack_runs(k[i], p[i], m[i])))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([],) * 3, _FOUND.types)], schema=_FOUND)

    return run


def _hashed(data: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Which windows of some stretches are found more than once among them, by 128-bit hashes."""
    text = data.tobytes()
    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[a : a + length]) for a in ranges(start, size).tolist()), U64).reshape(-1, 2)
    order = np.lexsort((h[:, 1], h[:, 0]))
    _, n = bounds((h[order] != np.roll(h[order], 1, axis=0)).any(1))
    out = np.zeros(len(h), bool)
    out[order] = np.repeat(n > 1, n)
    return out


def _second_seeds(data: np.ndarray, start: np.ndarray, size: np.ndarray, length: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches parted where the least hash of a window's grams changes: (start, windows, that hash), in their order.

    Equal windows have the same least hash; ``turn`` gives each round hashes of its own.
    """
    gram, by = min(SEED, length // 2), U64(_ODD[turn])
    out: list = [[], [], []]
    wide = size + length - 1
    for i in _by_bytes(wide, 1 << 20):
        h = window_min(mix(Prints(data[ranges(start[i], wide[i])]).grams(gram) * by), length - gram + 1)
        first = np.cumsum(wide[i]) - wide[i]
        own = h[ranges(first, size[i])]
        at = np.concatenate((own[1:] != own[:-1], [True])) if len(own) else np.zeros(0, bool)
        at[np.cumsum(size[i]) - 1] = True
        ends = np.flatnonzero(at)
        begins = np.concatenate(([0], ends[:-1] + 1))
        for x, y in zip(out, (ranges(start[i], size[i])[begins], ends - begins + 1, own[begins])):
            x.append(y)
    return tuple(np.concatenate(x) for x in out)


def _by_bytes(sizes: np.ndarray, limit: int):
    """Numbers of things in a row of about ``limit`` bytes."""
    part = (np.cumsum(sizes) - 1) // limit
    starts, n = bounds(part != np.roll(part, 1))
    for a, m in zip(starts.tolist(), n.tolist()):
        yield np.arange(a, a + m)


#: Multipliers of the later seeds, one for each time that a group is parted; what is then still as large differs in so little
#: that its windows are compared by hash.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _repeated(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: np.ndarray, length: int, most: int, turn: int = 0) -> np.ndarray:
    """Which windows of some stretches are found more than once among those of their seed: from run-length indexes over whole
    groups, many small ones to an index.  A group of over ``most`` bytes is parted by further seeds first."""
    wide = size + length - 1
    out, at = np.zeros(int(size.sum()), bool), np.cumsum(size) - size
    order = np.argsort(seed, kind="stable")
    group, n = bounds(seed[order] != np.roll(seed[order], 1))
    held = np.add.reduceat(wide[order], group)
    large = held > most
    shard = np.where(large, -1, (np.cumsum(np.where(large, 0, held)) - 1) // INDEX)
    for s in np.unique(shard[~large]):
        i = order[np.repeat(shard == s, n)]
        places = ranges(start[i], wide[i] + 1)
        last = np.zeros(len(places), bool)
        last[np.cumsum(wide[i] + 1) - 1] = True
        matched = RunIndex(np.where(last, 0, data[np.minimum(places, len(data) - 1)].astype(np.int64) + 1)).statistics()
        head = np.cumsum(wide[i] + 1) - (wide[i] + 1)
        out[ranges(at[i], size[i])] = matched[ranges(head, size[i])] >= length
    for g in np.flatnonzero(large):
        i = order[group[g] : group[g] + n[g]]
        if turn == len(_ODD):
            out[ranges(at[i], size[i])] = _hashed(data, start[i], size[i], length)
        else:
            out[ranges(at[i], size[i])] = _repeated(data, *_second_seeds(data, start[i], size[i], length, turn), length, most, turn + 1)
    return out


def _indexed(blobs: list[bytes], length: int, most: int = 8 * INDEX):
    """(key, start, windows) of repeated windows of whole minimizer groups.

    A group of over ``most`` bytes would make an index too large for a task: it is parted by further seeds.
    """
    meta, body = [], []
    for blob in blobs:
        n = int.from_bytes(blob[:4], "little")
        meta.append(unpack(blob[4 : 4 + n]))
        body.append(np.frombuffer(blob, np.uint8, offset=4 + n))
    key, pos, size, seed, role = (np.concatenate(x) for x in zip(*meta))
    data = np.concatenate(body)
    del body, meta
    if not len(key):
        return
    size = size.astype(np.int64)
    wide = size + length - 1
    hit = _repeated(data, np.cumsum(wide) - wide, size, seed, length, most)
    own, w = np.repeat(np.arange(len(size)), size), ranges(np.zeros(len(size), np.int64), size)
    hit = np.flatnonzero(hit & (role[own] == 1))
    if len(hit):
        first, m = bounds((np.diff(hit, prepend=-2) != 1) | (own[hit] != np.roll(own[hit], 1)))
        j = own[hit[first]]
        yield key[j], pos[j] + w[hit[first]], m


_OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _cut(length: int):
    def run(docs: pa.Table, runs: pa.Table) -> pa.Table:
        where: dict = {}
        if runs.num_rows:
            got = [unpack(x) for x in raw(runs.column("blob").combine_chunks())]
            key, pos, size = (np.concatenate(x) for x in zip(*((np.cumsum(a), b, c) for a, b, c in got)))
            where = _grouped(key)
        rows = []
        for i, k, text in zip(docs.column("id").to_pylist(), docs.column("key").to_pylist(), raw(docs.column("text").combine_chunks())):
            text, lost, spans = text or b"", 0, 0
            n = len(text)
            if k in where:
                j = where[k]
                gone = covered(n, pos[j].astype(np.int64), size[j].astype(np.int64) + (length - 1))
                lost, spans = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                text = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((i, n, lost, spans, text))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([],) * 5, _OUT.types)], schema=_OUT)

    return run


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, spread: tuple[float, int] = (SPREAD_FROM, REPORT_FROM)) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else.

    Returns one row for each input row: the id (bigint), n_bytes, n_removed, n_spans (maximal removed runs) and
    kept (binary: the other bytes, which may part a character).  Matches never cross rows; both copies go, in one
    row or in two, so repeated rows of ``length`` bytes or more lose all.  Null text is empty; null ids are rows
    like others; an empty table gives an empty result; other columns are not read.  ``length`` is at least 64.
    ``spread``: from which share of a partition's different stretches on a seed is common, see common.heavy_keys.
    """
    if length < SEED:
        raise ValueError(f"length is at least {SEED}")
    n = buckets(df)
    docs = text_only(df, id_col, text_col).withColumn("key", F.xxhash64("id", "text"))
    reports = checkpointed(docs.select("key", "text").mapInArrow(_reports(n, length, *spread), "key bigint, n bigint"))
    common = KeyList(heavy_keys(reports, n, spread[0]))
    sent = docs.select("key", "text").mapInArrow(_send(n, length, common), "q int, blob binary")
    found = checkpointed(sent.groupBy("q").applyInArrow(_settle(n), "blk int, kind int, blob binary"))
    docs = docs.withColumn("blk", F.pmod("key", F.lit(n)).cast("int"))
    asked = found.filter("kind = 1").select("blk", "blob")
    fetched = docs.select("blk", "key", "text").groupBy("blk").cogroup(asked.groupBy("blk")).applyInArrow(_fetch(n, length), "q int, blob binary")
    matched = checkpointed(fetched.groupBy("q").applyInArrow(_index(n, length), "blk int, kind int, blob binary"))
    runs = found.filter("kind = 0").union(matched).select("blk", "blob")
    out = docs.groupBy("blk").cogroup(runs.groupBy("blk")).applyInArrow(_cut(length), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("id", id_col)


def op9_query(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as hexadecimal text; spans are islands of window starts at most 200 apart.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM d WHERE len(h) >= 400),
w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 400)) AS s FROM g),
r AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
m AS (SELECT doc_id, p FROM w SEMI JOIN r USING (s)),
b AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM m),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM b),
s AS (SELECT doc_id, k, min(p) AS a, max(p) + 200 AS z FROM i GROUP BY doc_id, k),
c AS (SELECT s.doc_id, s.a, s.z, substr(d.h, 2 * coalesce(lag(s.z) OVER o, 0) + 1, 2 * (s.a - coalesce(lag(s.z) OVER o, 0))) AS part FROM s JOIN d USING (doc_id) WINDOW o AS (PARTITION BY s.doc_id ORDER BY s.a)),
t AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(part, '' ORDER BY a) AS head, max(z) AS z FROM c GROUP BY doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(t.n_removed, 0)::BIGINT AS n_removed, coalesce(t.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(t.head || substr(d.h, 2 * t.z + 1), d.h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
