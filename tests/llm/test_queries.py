"""The registered queries against their DuckDB twins, and the pipeline against a plain version of it."""

import os
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ferryline.llm import catalog, quality

from .test_operators import plain_components, plain_hits, plain_lines


#: The columns that the queries without SQL have to return first.
COLUMNS = {
    "op1_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op3_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op4_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op6_vector_search": "query_id bigint, rank int, vec_id bigint, score double",
    "op8_quality": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_matches_its_twin(name, spark, data, same):
    same(catalog.QUERIES[name](spark, data), catalog.SQL[name])


@pytest.mark.parametrize("name", [x for x in catalog.QUERIES if x not in catalog.SQL])
def test_query_gives_its_columns(name, spark, data):
    df = catalog.QUERIES[name](spark, data)
    assert df.dtypes[: len(COLUMNS[name].split(", "))] == [tuple(c.split(" ")) for c in COLUMNS[name].split(", ")]
    n = df.count()
    assert n == {"op6_vector_search": 500, "op3_packing": n}.get(name, 200) and n >= 200


def test_all_are_registered():
    names = list(entry.queries())
    assert all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 14)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    good = {r["doc_id"] for r in quality.quality_scores(docs, labels).filter("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect() if r["doc_id"] in good]
    assert 0 < len(rows) < docs.count()
    rows = [(d, kept) for d, _, _, kept in plain_lines(rows)]
    rows = [row for row, c in zip(rows, plain_components(rows)) if c[2] == row[0]]
    rows = [row for row, h in zip(rows, plain_hits(rows, items, 13)) if not h[4]]
    got = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in got} == {d for d, _ in rows}
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in rows}
    assert {d: sum(r["length"] for r in got if r["doc_id"] == d) for d in lengths} == lengths
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())


def test_held_out_rule(spark, data):
    r = catalog.QUERIES["op8_quality"](spark, data).collect()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in r)


def test_stages_take_awkward_and_no_rows(spark, data):
    """Nulls in any column, empty and repeated rows, clashing extra columns; and an empty table."""
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (1, "", "en", "s", 0, "x"), (2, "The cat sat.\nOn the mat.", None, None, None, None), (2, "Another text of id two.", "en", "s", 9, "y"), (3, "word " * 3000, "en", "s", 9, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")
    for start in (docs, docs.filter("false")):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, data)
            assert out.count() <= max(now.count(), 1), name
            now = out
        assert (now.count() > 0) == (start is docs)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_vector_search_recall(spark, data, sf):
    """The registered query, with its parameters, against brute force over the whole table."""
    where = f"{os.path.dirname(data)}/{sf}"
    rows = spark.read.parquet(f"{where}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    asks = np.flatnonzero(ids % 20 == 0)
    s = x[asks] @ x.T
    s[np.arange(len(asks)), asks] = -np.inf
    want = {(int(ids[a]), int(ids[j])) for a, own in zip(asks, s) for j in np.lexsort((ids, -own))[:20]}
    got = catalog.QUERIES["op6_vector_search"](spark, where).collect()
    assert len(got) == len(want) and len({(g["query_id"], g["vec_id"]) for g in got} & want) >= 0.9 * len(want)
    for q in {g["query_id"] for g in got}:
        own = sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])
        assert [g["rank"] for g in own] == list(range(1, 21)) and own == sorted(own, key=lambda g: (-g["score"], g["vec_id"]))
