"""Source audit, URL filter and fill-in-middle against plain versions, over awkward rows and random small tables."""

import bisect
import hashlib
import random
import re
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferryline.llm import fill_middle, source_audit, url_filter

CLASH = "rest string, key string, salt int, block int, host string, n int, form string, output string, found string, possible string, listed string, p int, id string, t string, i int, sources string"


def clashing(spark, rows, schema):
    return spark.createDataFrame([(*r, *([None] * len(CLASH.split(",")))) for r in rows], f"{schema}, {CLASH}").repartition(3)


def out(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def srt(rows):
    return sorted(rows, key=repr)


# ---- source audit --------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        docs.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    got = []
    for lang, sources in groups.items():
        kept = [t for (own, t), n in docs.items() if own == lang and n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        whole = sum((counts[lang, s] for s in sources), Counter())
        q, of = share(whole), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(b, sum(abs(of[s][t] - of[b][t]) for t in kept)) for b in sources if b != s]
            terms = [(t, of[s][t] - q[t]) for t in kept if counts[lang, s][t] and of[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                got += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return got


@pytest.mark.parametrize("seed", range(3))
def test_audit(spark, seed):
    rng = random.Random(seed)
    words = ["a", "B", "éa", "É", "Ünï", "x1y", "\u2003", "zz_top", "Ａ", "ǅ", "\x00q"]
    rows = [(" ".join(rng.choices(words, [1] * 10 + [seed], k=rng.randint(0, 30))), rng.choice(["en", "de", "", None]), rng.choice(["s", "S", "t", None, "é"])) for _ in range(120)]
    rows += [(None, "fr", "s"), ("", "fr", "u"), ("one two", "it", None), ("A" * 9000 + " b", "en", "s"), *[rows[0]] * 40]
    df = clashing(spark, rows, "text string, lang string, source string")
    want = plain_audit(rows, 12, 3)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "fr" and r[4] == 0 for r in want)
    assert out(source_audit.source_audit(df, least_docs=12, top=3)) == srt(want)


def test_audit_of_nothing(spark):
    df = clashing(spark, [("a", "en", "s")], "text string, lang string, source string")
    assert out(source_audit.source_audit(df.filter("false"))) == []
    assert out(source_audit.source_audit(df, least_docs=1)) == []  # one source: no pair, and no more than its language


def test_audit_hands_counts_on(spark, monkeypatch):
    """Tasks that flush, and texts split into blocks, count the same."""
    text = "alpha Beta ééé " * 50
    batch = spark.createDataFrame([(text, "en", "s")] * 5 + [("x", "de", "s")], "text string, lang string, source string").toArrow().to_batches()
    whole = Counter({(r["lang"], r["term"]): r["n"] for b in source_audit._count(batch) for r in b.to_pylist()})
    monkeypatch.setattr(source_audit, "HELD_TERMS", 1)
    monkeypatch.setattr(source_audit, "BLOCK", 7)
    again = Counter()
    for b in source_audit._count(batch):
        for r in b.to_pylist():
            again[r["lang"], r["term"]] += r["n"]
    assert again == whole and whole["en", "ééé"] == 250


def test_shares_of_large_counts_are_exact(spark):
    count, total, kept = 10**17 + 3, 7 * 10**18 + 1, 10**6
    got = spark.range(1).select(source_audit._share(F.lit(count), F.lit(total), F.lit(kept))).first()[0]
    assert got == 1 + 10**9 * (count + 5) // (total + 5 * kept)


# ---- URL filter ----------------------------------------------------------------------------

URLS = [
    (1, None), (2, ""), (3, "no scheme/en/1"), (4, "http://A.Example.ORG/es/5?x=1#t"), (5, "https://example.org/en/17"), (6, "https://badexample.org/en/17"), (7, "http://x.com/FR/1"),
    (8, "http://x.com/fr/"), (9, "http://com/de/2"), (10, "http://x.org?/es/"), (11, "ftp://x.net/a://b/c"), (12, "://"), (13, "http://é.net/ü#?"), (14, "http://spam.net/a?b=1&a=2&utm_source=q"),
    (15, "https://www.Spam.net:443/a/?a=2&b=1#x"), (16, "https://u:p@spam.net./a?ref=1&a=2&b=1"), (17, "http://spam.net/a?a=2"), (18, "http://spam.org/a"), (19, "http://x\ny.net/a\nb"), (None, "http://spam.net/A?a=2&b=1"),
    *[(100 + i, "http://hot.net/") for i in range(40)], (1, None), (4, "http://A.Example.ORG/es/5?x=1#t"), (20, "http://a.com:80"), (21, "http://a.com/de/?q"),
]


def plain_judge(url, keys, rules):
    real = url is not None and "://" in url
    rest = url.split("://", 1)[1] if real else ""
    m = re.match(r"(?s)([^/?#]*)([^?#]*)(?:\?([^#]*))?", rest)
    host, path = m[1].translate(LOWER), m[2]
    fits = [(len(r), a, r) for a, r in rules for on, slash, more in [r.partition("/")] if (host == on or host.endswith("." + on)) and path.startswith(slash + more)]
    rule = max(fits, default=(0, None, None))
    return host, path, rule[2], rule[1] or ("block" if real and plain_canonical(url) in keys else "allow")


def plain_canonical(url):
    if url is None or "://" not in url:
        return None
    m = re.match(r"(?s)([^/?#]*)([^?#]*)(?:\?([^#]*))?", url.split("://", 1)[1])
    host = m[1].translate(LOWER).rpartition("@")[2]
    host = re.sub(r":(80|443)?$", "", host).removesuffix(".").removeprefix("www.")
    kept = sorted(x for x in (m[3] or "").split("&") if x and not re.match(r"utm_[a-z]+(=|$)|(ref|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid)(=|$)", x))
    return host + m[2].rstrip("/") + ("?" + "&".join(kept) if kept else "")


@pytest.mark.parametrize("sent", [url_filter.SENT_BYTES, 0])
def test_urls(spark, sent):
    df = clashing(spark, URLS, "page_id long, url string")
    listed = spark.createDataFrame([(None,), ("nothing",), ("http://spam.net/a?a=2&b=1",), ("https://spam.net/a/?b=1&a=2",), ("http://hot.net",), *[(f"http://other.net/{i}",) for i in range(3000)]], "u string")
    keys = {plain_canonical(r[0]) for r in listed.collect()} - {None}
    got = url_filter.judge_urls(df, listed, listed_col="u", carry=("page_id",), sent_bytes=sent).select("rest.page_id", "host", "path", "rule", "verdict")
    want = [(i, *plain_judge(u, keys, url_filter.RULES)) for i, u in URLS]
    assert out(got) == srt(want)
    blocked = {w[0] for w in want if w[4] == "block"}
    assert {14, 15, 16, 100, 4, 5, 9} <= blocked and not blocked & {None, 17, 18, 6, 8}
    kept = url_filter.allowed(df, listed, listed_col="u", sent_bytes=sent)
    assert kept.columns == df.columns and kept.count() == sum(w[4] == "allow" for w in want)


def test_urls_of_nothing(spark):
    df = clashing(spark, URLS, "page_id long, url string")
    none = df.filter("false")
    assert out(url_filter.judge_urls(none, df)) == []
    assert {r["verdict"] for r in url_filter.judge_urls(df, none, rules=()).collect()} == {"allow"}


def test_filter_has_all_listed_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = 20_000 // url_filter.PER_BLOCK
    made = url_filter.bloom(keys, blocks)
    hits = lambda rows: url_filter._possible(rows.withColumn("rest", F.lit(0)).withColumn("url", F.col("key")), made, blocks, True).filter("possible").count()
    assert hits(keys) == 20_000
    assert hits(spark.range(50_000).select(F.concat(F.lit("other"), "id").alias("key"))) < 50_000 * 0.005


def test_urls_stay_in_the_jvm(spark, data):
    from ferryline.llm import catalog

    plan = catalog.QUERIES["op12_url_filter"](spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


# ---- fill in the middle --------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("a é\n\t😀ß<>PSM\x00"), max_size=300), st.sampled_from(["char", "word", "line"]), st.integers(1, 9))
def test_checkpoints(text, unit, every):
    white = re.match(r"[ \n\t]*", text)[0]  # at the start, it is a word of its own
    words = [white] * bool(white) + re.findall(r"[^ \n\t]+[ \n\t]*", text[len(white) :])
    units = {"char": list(text), "word": words, "line": re.findall(r"[^\n]*\n|[^\n]+", text)}[unit]
    assert "".join(units) == text
    old, fill_middle.BLOCK = fill_middle.BLOCK, 7
    try:
        index = fill_middle.Checkpoints(text.encode(), unit, every)
    finally:
        fill_middle.BLOCK = old
    assert (index.n, index.points, len(index.byte_at)) == (len(units), len(text), -(-len(units) // every))
    for u in range(len(units) + 1):
        head = "".join(units[:u])
        assert index.cut(u) == (len(head.encode()), len(head))


def plain_middle(i, text, unit_of=list):
    text = text or ""
    units, digest = unit_of(text), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return i, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [(None, None), (None, "text"), (0, ""), (1, None), (2, "a"), (3, "é😀"), (4, "<P"), (5, "x<P>y"), (6, "<<S<M"), (7, "a<S>"), (8, "\n\n\x00"), (-9, "é " * 40_000), (10, "S>P>M>" * 9), (2, "a"), (3, "é😀"), *[(100 + i, f"<é{i}>\nß" * (i % 7 + 1)) for i in range(60)]]


def test_middle(spark):
    df = clashing(spark, TEXTS, "doc_id long, text string")
    got = fill_middle.fill_in_middle(df)
    want = [plain_middle(*x) for x in TEXTS]
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    assert out(got) == srt(want)
    back = got.select("doc_id", fill_middle.restored(F.col("form"), F.col("output")).alias("text"))
    assert out(back) == srt((i, t or "") for i, t in TEXTS)
    lines = fill_middle.fill_in_middle(df, unit="line", every=2)
    assert out(lines) == srt(plain_middle(i, t, lambda x: re.findall(r"[^\n]*\n|[^\n]+", x)) for i, t in TEXTS)
    assert out(fill_middle.fill_in_middle(df.filter("false"))) == []
    whole = fill_middle.with_middle_last(df)
    assert whole.columns == df.columns and out(whole.select("doc_id", "text")) == srt((w[0], w[5]) for w in want)


def test_middle_takes_no_other_unit(spark):
    with pytest.raises(ValueError, match="unit"):
        fill_middle.Checkpoints(b"a", "byte")


def test_urlsplit_agrees_on_plain_urls():
    """The plain version reads ordinary URLs as the standard library does."""
    for _, u in URLS:
        if u and "://" in u and "\n" not in u and u != "://" and "a://b" not in u and u.isascii():
            s = urlsplit(u)
            assert plain_judge(u, set(), ())[:2] == (s.netloc.lower(), s.path)


# ---- ties of the near-duplicate stage, rounds of packing -----------------------------------


def test_of_equal_rows_the_same_one_stays(spark):
    from ferryline.llm import simhash

    rows = [(1, "a b c d", "z", 1), (1, "a b c d", "b", None), (1, "a b c d", "b", 2), (2, "a b c d", "a", 0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, source string, n int").repartition(3)
        assert [tuple(r) for r in simhash.near_dedup(df).collect()] == [(1, "a b c d", "b", 2)]


def test_slow_rounds_do_not_end_best_fit(spark):
    """Pieces of which only few match in a round: no more sequences than one by one would take, but for a small rest."""
    from ferryline.llm import packing

    lengths = [2049 + i % 7 for i in range(300)] + [1024 - i % 5 for i in range(600)] + [3 + i % 3 for i in range(200)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long")
    got = packing.pack(df, 4096, rows=64).collect()
    assert sorted((r["id"], r["length"]) for r in got) == list(enumerate(lengths))
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in at.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
    gaps: list[int] = []  # one by one: each piece into the smallest gap that takes it
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        bisect.insort(gaps, (gaps.pop(k) if k < len(gaps) else 4096) - n)
    assert len(at) <= len(gaps) * 1.02


# ---- large groups of the suffix index ------------------------------------------------------


@pytest.mark.parametrize("case", range(6))
def test_a_large_group_is_parted_by_further_seeds(case, monkeypatch):
    """Whatever the size from which a group is parted, the windows found are those of a count of all; hashes are left for
    groups that no seed parts."""
    import numpy as np

    from ferryline.llm import suffix_dedup
    from ferryline.llm.common import U64

    rng, length = np.random.default_rng(case), (200, 230)[case % 2]
    base, texts = rng.integers(97, 105, 3000).astype(np.uint8), []
    for _ in range(12):
        a, n = int(rng.integers(0, 2400)), int(rng.integers(length + 5, length + 250))
        texts.append(t := base[a : a + n].copy())
        if rng.random() < 0.5:
            t[int(rng.integers(0, len(t)))] = 120
    texts += [np.full(length + 100, 97, np.uint8)] * (case == 3)
    wide = np.array([len(t) for t in texts])
    size, start = wide - length + 1, np.cumsum(wide) - wide
    windows = [t[i : i + length].tobytes() for t in texts for i in range(len(t) - length + 1)]
    many = Counter(windows)
    want, hashed = np.array([many[w] > 1 for w in windows]), []
    real = suffix_dedup._hashed
    monkeypatch.setattr(suffix_dedup, "_hashed", lambda *a: hashed.append(1) or real(*a))
    for most in (1 << 20, 5000, 2500, 1):
        assert (suffix_dedup._repeated(np.concatenate(texts), start, size, np.zeros(len(texts), U64), length, most) == want).all(), most
        assert most == 1 or case == 3 or not hashed
