"""Source divergence audit: how far the sources of a language are apart in the words that they use.

Tasks count the terms of their texts and emit one row for each source and term, which map-side sums join up.  A term then
becomes one wide row: an array with a count for each source of its language, so that a term that a source lacks needs no
row.  Higher-order functions turn counts into smoothed shares and a wide row into the contributions of its pairs of
sources, and sums that begin where the rows are add them up.  All numbers are whole.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import raw, shared_path, text_only

#: Documents of the language that a term has to be in; what is added to each count; what shares are shares of.
LEAST_DOCS, PRIOR, UNIT = 30, 5, 1_000_000_000
#: Terms that a task counts before it hands its counts on.
HELD_TERMS = 400_000
#: Bytes of a text that are split at once, and parts that the terms of a language are dealt over.
BLOCK, SALTS = 4 << 20, 64

_LETTERS = {*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(0x80, 0x100)}
#: Letters and all bytes of other code points as they are, A-Z lower-cased; everything else parts terms.
_TERMS = bytes(ord(chr(b).lower()) if b < 0x80 and b in _LETTERS else b if b in _LETTERS else 32 for b in range(256))


def _blocks(text: bytes):
    """A text in blocks that end between terms."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and text[end] in _LETTERS:
            end += 1
        yield text[at:end]
        at = end


def term_counts(text: bytes) -> dict[bytes, int]:
    """How often a text has each term."""
    out: dict[bytes, int] = defaultdict(int)
    for block in _blocks(text):
        for term in block.translate(_TERMS).split():
            out[term] += 1
    return out


def _count(batches):
    """mapInArrow: (lang, source, term, occurrences, documents); a null term stands for the group itself."""
    held: dict = defaultdict(dict)

    def rows():
        for (lang, source), own in held.items():
            n, docs = zip(*own.values())
            for at in range(0, len(own), 65_536):
                terms = list(own)[at : at + 65_536] if len(own) > 65_536 else list(own)
                size = len(terms)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array([source] * size), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n[at : at + size], pa.int64()), pa.array(docs[at : at + size], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), raw(batch.column("text"))):
            own = held[lang, source]
            size -= len(own)
            own.setdefault(None, (0, 0))
            for term, n in term_counts(text or b"").items():
                have = own.get(term)
                own[term] = (n, 1) if have is None else (have[0] + n, have[1] + 1)
            size += len(own)
            if size > HELD_TERMS:
                yield from rows()
                size = 0
    yield from rows()


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * kept)), exactly."""
    whole = lambda c, n: c.cast(f"decimal({n},0)")
    top = whole(F.lit(UNIT), 10) * whole(count + PRIOR, 20)
    return F.call_function("div", top, whole(total + PRIOR * kept, 20)).cast("bigint") + 1


def written(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder, which several later steps read."""
    df.write.parquet(path := shared_path(df.sparkSession, label))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wide_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(langs, terms) from (lang, source, term, n, docs): for each language its sources in order, their totals, its own total
    and how many terms it keeps; for each kept term its counts by source, in that order, and its shares.

    The row of a language reaches its terms by a join that is salted, as one language may have most of them.
    """
    groups = counts.filter("term IS NULL").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    found = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("found")).filter(F.col("docs") >= least_docs)
    kept = written(found.drop("docs"), "kept")
    totals = kept.select("lang", F.explode("found").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"))
    totals = totals.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("of"), F.sum("n").alias("total"))
    langs = groups.join(totals, "lang", "left").join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
    none = F.create_map().cast("map<string,bigint>")
    langs = langs.select("lang", "sources", F.transform("sources", lambda s: F.coalesce(F.try_element_at(F.coalesce("of", none), s), F.lit(0))).alias("totals"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    spread = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    terms = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS))).join(spread, ["lang", "salt"])
    own = F.map_from_entries("found")
    terms = terms.withColumn("own", own).withColumn("counts", F.transform("sources", lambda s: F.coalesce(F.try_element_at("own", s), F.lit(0))))
    whole = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    shares = F.transform(F.arrays_zip("counts", "totals"), lambda x: _share(x["counts"], x["totals"], F.col("kept")))
    return langs, terms.select("lang", "term", "sources", "counts", shares.alias("p"), _share(whole, F.col("total"), F.col("kept")).alias("q"))


def pair_distances(langs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed differences of every two sources of a language, both ways; 0 without terms.

    A wide row gives, for each source but the last, the array of its differences to those after it.
    """
    after = lambda shares, i: F.slice(shares, i + 2, F.greatest(F.size(shares) - i - 1, F.lit(0)))
    zeros = langs.select("lang", F.transform("sources", lambda s: F.lit(0).cast("bigint")).alias("p"))
    each = terms.select("lang", "p").union(zeros).select("lang", "p", F.posexplode("p").alias("i", "own")).filter(F.col("i") < F.size("p") - 1)
    gaps = F.transform(after(F.col("p"), F.col("i")), lambda x: F.abs(x - F.col("own")))
    sums = each.select("lang", "i", F.posexplode(gaps).alias("k", "f")).groupBy("lang", "i", "k").agg(F.sum("f").alias("value"))
    named = sums.join(langs.select("lang", "sources"), "lang").select("lang", F.get("sources", F.col("i")).alias("a"), F.get("sources", F.col("i") + F.col("k") + 1).alias("b"), "value")
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return named.select("lang", ways.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def leading_terms(terms: DataFrame) -> DataFrame:
    """(lang, source, item, value): the kept terms that a source has, and uses more than its language does."""
    found = F.filter(F.arrays_zip("sources", "counts", "p"), lambda x: (x["counts"] > 0) & (x["p"] > F.col("q")))
    return terms.select("lang", "term", "q", F.explode(found).alias("x")).select("lang", F.col("x.sources").alias("source"), F.col("term").alias("item"), (F.col("x.p") - F.col("q")).alias("value"))


def source_audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value bigint, rank int): for each source of each language the distance to every other one
    (part pair), and its ``top`` leading terms (part term), ranked by value, ties by the item's bytes.

    Terms are runs of A-Z, a-z and code points beyond ASCII, A-Z lower-cased; a language keeps those in at least
    ``least_docs`` of its rows.  A source's share of a term is 1 + floor(10^9 (count + 5) / (N + 5 V)), with N its occurrences of the V kept
    terms; a pair's value sums the differences of their shares, a term's is the source's share less the language's.  Null text,
    language and source count as empty ones; groups without terms have pairs; a language of one source has none.  Each row
    counts, repeated ones too; an empty table gives an empty result; other columns are not read.  What tasks have counted
    is summed and written to the shared folder.
    """
    lang, source = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (lang_col, source_col))
    own = df.select(F.lit(0).alias("i"), F.col(f"`{text_col}`").alias("t"), lang.alias("lang"), source.alias("source"))
    docs = text_only(own, "i", "t", "lang", "source").drop("id")
    rows = docs.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    counts = written(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    langs, terms = wide_terms(counts, least_docs)
    langs, terms = written(langs, "langs"), written(terms, "wide")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda part, x: x.withColumn("part", F.lit(part)).withColumn("rank", F.row_number().over(order))
    both = ranked("pair", pair_distances(langs, terms)).unionByName(ranked("term", leading_terms(terms)).filter(F.col("rank") <= top))
    return both.select("lang", "source", "part", "item", "value", "rank")


def op11_query(spark, sf_dir: str) -> DataFrame:
    return source_audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY lang, source),
w AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.n, 0) + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN v ON g.lang = v.lang JOIN k ON g.lang = k.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term LEFT JOIN s ON g.lang = s.lang AND g.source = s.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM w a JOIN w b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM w WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (FROM pair UNION ALL FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
