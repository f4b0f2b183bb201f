"""Secret scan through a trigram inverted index.

From each rule's regex comes a Boolean trigram query: an AND over stretches of the pattern that have
finitely many spellings, of an OR over those spellings, of an AND over their trigrams.  A shard (the text a
task holds at once) gets postings for the trigrams that any query names; unions and intersections of the
postings give each rule's candidates, which the regex then verifies on the whole text.  A rule without
mandatory trigrams scans every document.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, raw, text_only

SHARD = 4 << 20
#: Spellings of a stretch that are followed up at most; beyond, the stretch asks for nothing.
SPELLINGS = 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False


#: Fixed values of the contract, in its order.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)


def _spellings(items) -> list[set[str] | None]:
    """For each stretch of a parsed pattern its spellings, or None where there are too many."""
    out: list[set[str] | None] = [{""}]

    def put(options: set[str] | None) -> None:
        if options is None:
            out.append(None)
        elif out[-1] is None:
            out.append(set(options))
        else:
            joined = {a + b for a in out[-1] for b in options}
            out.append(set(options)) if len(joined) > SPELLINGS else out.__setitem__(-1, joined)

    for op, arg in items:
        if op is C.LITERAL:
            put({chr(arg)})
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg) and len(arg) <= 4:
            put({chr(v) for _, v in arg})
        elif op is C.SUBPATTERN:
            for part in _spellings(arg[-1]):
                put(part)
        elif op is C.BRANCH:
            options = [_spellings(x) for x in arg[1]]
            put({s for x in options for s in x[0]} if all(len(x) == 1 and x[0] is not None for x in options) else None)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[:2] == (0, 1) and len(inner := _spellings(arg[2])) == 1 and inner[0] is not None:
            put(inner[0] | {""})
        else:
            put(None)
    return out


def trigram_query(pattern: str) -> list[list[frozenset[bytes]]]:
    """AND of ORs of ANDs of lower-case trigrams that every match has; empty if none is mandatory."""
    query = []
    for options in _spellings(_parser.parse(pattern)):
        if options and all(len(x.encode()) >= 3 for x in options):
            texts = [x.lower().encode() for x in sorted(options)]
            query.append([frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts])
    return query


def _compiled(rule: Rule) -> re.Pattern:
    """The rule on bytes.  One class repeated from 1 up, judged by its whole match, may ask for its least at once."""
    parsed, pattern = list(_parser.parse(rule.pattern)), rule.pattern
    if rule.group == 0 and len(parsed) == 1 and parsed[0][0] is C.MAX_REPEAT and parsed[0][1][:2] == (1, C.MAXREPEAT) and parsed[0][1][2][0][0] is C.IN and pattern.endswith("]+"):
        pattern = f"{pattern[:-1]}{{{rule.least},}}"
    return re.compile(pattern.encode(), re.IGNORECASE if rule.any_case else 0)


class Postings:
    """Posting lists, over a shard's documents, of the trigrams that the queries name."""

    def __init__(self, queries: Sequence):
        self.grams = sorted({g for q in queries for options in q for grams in options for g in grams})
        self.table = np.zeros(1 << 24, np.uint16)
        for i, g in enumerate(self.grams):
            self.table[int.from_bytes(g, "big")] = i + 1

    def build(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        data = np.frombuffer(b"\0".join(texts).lower(), np.uint8)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        found: list = []
        for a in range(0, max(0, len(data) - 2), 1 << 20):
            part = data[a : a + (1 << 20) + 2].astype(np.uint32)
            gram = self.table[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            at = np.flatnonzero(gram)
            doc = np.searchsorted(starts, at + a, side="right") - 1
            found.append(np.unique(gram[at].astype(np.int64) << 32 | doc))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        cut = np.searchsorted(pairs >> 32, np.arange(1, len(self.grams) + 2))
        return {g: pairs[cut[i] : cut[i + 1]] & 0xFFFFFFFF for i, g in enumerate(self.grams)}


def candidates(query: list, postings: dict, n: int) -> np.ndarray:
    """Documents that satisfy a Boolean trigram query."""
    left = np.arange(n)
    for options in query:
        either = np.zeros(0, np.int64)
        for grams in options:
            both = None
            for g in sorted(grams, key=lambda g: len(postings[g])):
                both = postings[g] if both is None else np.intersect1d(both, postings[g], assume_unique=True)
            either = np.union1d(either, both)
        left = np.intersect1d(left, either, assume_unique=True)
    return left


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SCHEMA = pa.schema([("id", pa.int64()), ("spans", _SPANS)])


def _scan(rules: Sequence[Rule]):
    def run(batches):
        queries, regexes = [trigram_query(r.pattern) for r in rules], [_compiled(r) for r in rules]
        index = Postings(queries)
        for table in gathered(batches, SHARD):
            texts = [x or b"" for x in raw(table.column("text").combine_chunks())]
            postings = index.build(texts)
            spans: list[list] = [[] for _ in texts]
            for n, (rule, query, regex) in enumerate(zip(rules, queries, regexes)):
                for d in candidates(query, postings, len(texts)).tolist():
                    for m in regex.finditer(texts[d]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            spans[d].append((m.start(), n, m.end()))
            out = []
            for text, own in zip(texts, spans):
                own.sort()
                wide = own and not text.isascii()
                place = (lambda i, t=text: len(t[:i].decode("utf-8", "replace"))) if wide else (lambda i: i)
                out.append([{"kind": rules[n].kind, "start": place(a), "end": place(b)} for a, n, b in own])
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), pa.array(out, _SPANS)], schema=_SCHEMA)

    return run


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row for each input row: the id (bigint) and spans, array of (kind, start, end) in code points.

    For each rule the leftmost non-overlapping matches of its pattern that are long enough, by start and
    then in the order of the rules.  Null or empty text has no spans; repeated rows get a row each; an
    empty table gives an empty result; other columns are not read.
    """
    docs = text_only(df, id_col, text_col)
    return docs.mapInArrow(_scan(tuple(rules)), "id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>").withColumnRenamed("id", id_col)


def op4_query(spark, sf_dir: str) -> DataFrame:
    out = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    spelt = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(spelt, 256).alias("base_sha256"), spelt.alias("spans"))
