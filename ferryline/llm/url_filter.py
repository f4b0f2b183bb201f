"""URL verdicts: rules on host and path first, then a list of canonical URLs behind a blocked Bloom filter.

The filter has a block of eight 64-bit words for every 32 listed URLs or so.  A URL's hash names its block and
one bit in each word; a block is built by OR over its URLs and looked up by a join on its number, so that one row
answers for a URL.  Only possible hits go on to an exact hash join with the list, which removes false positives; all
other rows stay where they were read.  Everything is a DataFrame expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Words of a block, and listed URLs to a block: 512 bits for 32 URLs are 16 bits a URL.
WORDS, PER_BLOCK = 8, 32
#: Bytes of the filter, nine longs a block, up to which it is sent to every executor; a larger one is joined by shuffling.
SENT_BYTES = 32 << 20
#: Parts that the rows of one URL are dealt over where rows meet by URL or by block.
SALTS = 16

#: Query parameters that say where a visitor came from, not what the page is.  Fixed values.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid"

#: The rules of the query: action, host and path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Hosts with one of these as a part of their first or second name are the query's list.  Fixed values.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; '' for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What stands after the host up to ?, # or the end; '' for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The URL without what does not tell pages apart: scheme, user, www., a default port, a dot at the host's end, slashes
    at the path's end, tracking parameters (the others are sorted), fragment.  Null for null or without ://."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(url_host(url), "(?s)^.*@", ""), ":(80|443)?$", ""), r"\.$", ""), r"^www\.", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"(?s)^({TRACKING})(=.*)?$")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.regexp_replace(url_path(url), "/+$", ""), tail))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct of the longest rule that fits and its action, else null.  A rule fits its host and all subdomains of it, if the
    path starts with the rule's.  Of rules of one length the one with the longer host counts, then the first."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]), -rules.index(r))):
        on, slash, rest = rule.partition("/")
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).alias("block")


def _bit(h: Column, word: int) -> Column:
    """The word's bit of a hash, as a long."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * word).bitwiseAND(F.lit(63)).cast("int"))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The blocked filter of a column ``key``: (block, w0 to w7), a row for every block that has a bit."""
    place, bits = F.xxhash64("key"), F.xxhash64(F.lit("bits"), "key")
    words = [F.bit_or(_bit(bits, i)).alias(f"w{i}") for i in range(WORDS)]
    return keys.select(_block(place, blocks), "key").groupBy("block").agg(*words)


def _possible(rows: DataFrame, filter_: DataFrame, blocks: int, sent: bool) -> DataFrame:
    """``rows`` (with ``key``) and whether all eight bits are set in the key's block."""
    bits = F.xxhash64(F.lit("bits"), "key")
    all_set = F.lit(True)
    for i in range(WORDS):
        all_set = all_set & (F.col(f"w{i}").bitwiseAND(_bit(bits, i)) != 0)
    placed = rows.withColumn("block", F.when(F.col("key").isNotNull(), _block(F.xxhash64("key"), blocks)))
    if sent:
        found = placed.join(F.broadcast(filter_), "block", "left")
    else:
        salted = filter_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = placed.withColumn("salt", _salt()).join(salted, ["block", "salt"], "left").drop("salt")
    return found.select(*rows.columns, F.coalesce(all_set & F.col("key").isNotNull(), F.lit(False)).alias("possible"))


def _salt() -> Column:
    """Spreads equal URLs by what is carried with them, so that a task that runs again deals alike."""
    return F.pmod(F.xxhash64("rest", "url"), F.lit(SALTS))


def _listed(rows: DataFrame, listed: DataFrame, sent_bytes: int) -> DataFrame:
    """``rows`` (with ``key``) and whether the key is in ``listed`` (distinct ``key``)."""
    blocks = max(1, -(-listed.count() // PER_BLOCK))
    tested = _possible(rows, bloom(listed, blocks), blocks, blocks * 8 * (WORDS + 1) <= sent_bytes)
    hits = tested.filter("possible").drop("possible")
    sure = hits.select("key").distinct().join(listed.hint("shuffle_hash"), "key", "left_semi")
    spread = sure.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("sure"))
    exact = hits.withColumn("salt", _salt()).join(spread.hint("shuffle_hash"), ["key", "salt"], "left")
    misses = tested.filter("NOT possible").select(*rows.columns, F.lit(False).alias("listed"))
    return exact.select(*rows.columns, F.coalesce("sure", F.lit(False)).alias("listed")).union(misses)


def judge_urls(df: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url_col: str = "url", listed_col: str = "url", carry: Sequence[str] = (), sent_bytes: int = SENT_BYTES) -> DataFrame:
    """A row for each input row: rest (struct of the columns that ``carry`` names), url, host, path, rule, listed, verdict.

    The longest rule that fits decides; without one, a URL whose canonical form is that of a URL in ``listed`` is
    blocked and any other allowed.  ``rules`` are pairs of an action and host/path, some hundreds at most: they become one
    expression.  ``listed`` is a table of any size; null and URLs without :// in it list nothing, repeated ones count once.
    Null or empty URLs, and those without ://, have an empty host and path, and no canonical form: they are allowed unless
    a rule fits.  Repeated rows are judged each; an empty table or list is fine; other columns are not read, and may
    have any names.  Rows of one URL are spread over tasks by what ``carry`` has: let it name an id.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(0)
    url = F.col(f"`{url_col}`").cast("string")
    rows = df.select(rest.alias("rest"), url.alias("url")).withColumn("key", canonical(F.col("url")))
    ruled = rows.withColumn("found", rule_of(url_host(F.col("url")), url_path(F.col("url")), rules))
    # a hash join with the list is for those that no rule decides
    open_ = ruled.withColumn("key", F.when(F.col("found").isNull(), F.col("key")))
    keys = checkpointed(listed.select(canonical(F.col(f"`{listed_col}`").cast("string")).alias("key")).na.drop().distinct())
    out = _listed(open_, keys, sent_bytes)
    verdict = F.coalesce("found.action", F.when(F.col("listed"), "block").otherwise("allow"))
    out = out.select("rest", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.col("found.rule").alias("rule"), "listed", verdict.alias("verdict"))
    return out if carry else out.drop("rest")


def allowed(df: DataFrame, listed: DataFrame, **options) -> DataFrame:
    """The input's rows, all columns in their order, whose URL is allowed by :func:`judge_urls`."""
    out = judge_urls(df, listed, carry=tuple(df.columns), **options).filter("verdict = 'allow'")
    return out.select(*[F.col("rest").getField(c).alias(c) for c in df.columns])


def op12_query(spark, sf_dir: str) -> DataFrame:
    """The list is the URLs of pages on hosts with a listed name; every URL with a listed one's canonical form is blocked."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = pages.filter(url_host(F.col("url")).rlike(rf"^([a-z]+\.)?({'|'.join(LISTED_NAMES)})\."))
    return judge_urls(pages, listed, carry=("page_id",)).select("rest.page_id", "host", "path", "rule", "verdict")


OP12_SQL = r"""
WITH u AS (SELECT page_id, url, instr(url, '://') > 0 AS real,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    coalesce(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), '') AS query FROM pages),
c AS (SELECT *, CASE WHEN real THEN
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':(80|443)?$', ''), '\.$', ''), '^www\.', '')
    || regexp_replace(path, '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(query, '&'),
         lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid)(=.*)?$', 's'))), '&'), ''), '') END AS key FROM u),
l AS (SELECT DISTINCT key FROM c WHERE regexp_matches(host, '^([a-z]+\.)?(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.')),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) v(action, on_host, on_path)),
f AS (SELECT page_id, url, arg_max(on_host || on_path, length(on_host || on_path)) AS rule, arg_max(action, length(on_host || on_path)) AS action
  FROM u, r WHERE (host = on_host OR suffix(host, '.' || on_host)) AND prefix(path, on_path) GROUP BY page_id, url)
SELECT c.page_id, host, path, f.rule, coalesce(f.action, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN f ON c.page_id = f.page_id AND c.url = f.url LEFT JOIN l ON c.key = l.key
"""
