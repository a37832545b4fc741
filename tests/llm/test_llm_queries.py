"""The registered queries: their SQL over whole tables, and plain versions where SQL can't express them."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from conftest import SF, same

from shardloom.llm.common import tokenizer_file
from shardloom.llm.queries import ORACLE_SQL, QUERIES
from test_llm_operators import WORD, brute_strings, closure, plain_ids, shingles, targets


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck.execute(ORACLE_SQL[name]).df())


def table(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def test_neighbours(spark):
    got = QUERIES["op2_neighbours"](spark, SF).toPandas()
    e = table("embeddings")
    assert set(got.query_id) == set(e.vec_id[e.vec_id % 50 == 0]) and (got.groupby("query_id").size() == 5).all()


def test_quality(spark):
    got = QUERIES["op5_quality"](spark, SF).toPandas()
    assert len(got) == len(table("documents")) and (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    m = got.merge(table("labels"), on="doc_id")
    assert ((m.score >= 0.5) == (m.quality == 1)).mean() > 0.95


def test_packing(spark):
    got, ids = QUERIES["op8_packing"](spark, SF).toPandas(), plain_ids("byte_bpe_50k.json", 1)
    want = {r.doc_id: ids(r.text) for r in table("documents").itertuples()}
    assert all(r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) for r in got.itertuples())
    assert got.length.sum() == sum(map(len, want.values()))


def test_token_tables(spark):
    got, ids = QUERIES["op9_token_tables"](spark, SF).toPandas().sort_values("doc_id"), plain_ids("word_bpe_49k.json", 2)
    start = 0
    for r, d in zip(got.itertuples(), table("documents").sort_values("doc_id").itertuples(), strict=True):
        x = ids(d.text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)


def test_pipeline(spark):
    """Each stage against a plain version on what its predecessor kept."""
    import corpus_pipeline as P
    from shardloom.llm.common import Scratch

    scratch, docs = Scratch(spark, "t"), spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.toPandas()]
    for _, stage in P.STAGES:
        docs = scratch.keep(stage(spark, docs, SF))
        seen.append(docs.toPandas())
    whole, good, near, cut, mixed, packed = seen
    assert all(list(x.columns) == list(whole.columns) for x in (good, near, cut, mixed))
    labels = table("labels")
    bad, fine = set(labels.doc_id[labels.quality == 0]), set(labels.doc_id[labels.quality == 1])
    assert len(bad & set(good.doc_id)) <= 0.1 * len(bad) and len(fine - set(good.doc_id)) <= 0.03 * len(fine)
    sets = {r.doc_id: shingles(r.text) for r in good.itertuples()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert sorted(near.doc_id) == sorted(i for i, c in closure(sets, links).items() if i == c)
    rest = {}
    brute_strings(sorted(zip(near.doc_id, near.text)), kept=rest)
    assert {r.doc_id: r.text for r in cut.itertuples()} == {i: b.decode("utf-8", "ignore") for i, b in rest.items()}
    words = cut.assign(n=[len(WORD.findall(t)) for t in cut.text]).groupby("source").n.agg(["sum", "max"]).sort_index()
    got = mixed.assign(n=[len(WORD.findall(t)) for t in mixed.text]).groupby("source").n.sum()
    target = targets(words["sum"].tolist())
    assert (mixed.groupby("doc_id").size() <= 3).all()
    assert all(abs(got[s] - target[i]) <= words["max"][s] / 2 for i, s in enumerate(words.index))
    ids = plain_ids("byte_bpe_50k.json", 1)
    text = dict(zip(mixed.doc_id, mixed.text))
    assert packed.length.sum() == sum(len(ids(t)) for t in mixed.text)
    assert all(bytes(r.ids) == ids(text[r.doc_id])[r.start : r.start + r.length].tobytes() for r in packed.itertuples())
    assert P.run(spark, SF).count() == len(packed) and np.all(packed.length > 0) and tokenizer_file("byte_bpe_50k.json")


ODD = [
    (1, "one text of more than five words that is kept", "a"), (1, "one text of more than five words that is kept", "a"), (1, "another text with the id of the first", "a"), (2, "One text of more than five words that is kept", "b"),
    (3, None, None), (3, None, None), (4, "", "b"), (5, "  \n ", "b"), (None, "one text of more than five words that is kept", "a"), (None, None, "a"), (6, "word " * 30_000, "b"), (7, "x" * 200_000 + "é", "c"), (8, "x" * 100_000, "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    extra = ("_score", "_code", "_key", "_all", "shard", "row")
    return spark.createDataFrame([(*r, 7, *range(len(extra))) for r in ODD], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} int" for c in extra)).repartition(3)


@pytest.mark.parametrize("name", ["quality", "near_dedup", "suffix_dedup", "mixing", "packing"])
def test_stages_on_odd_tables(spark, odd, name):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns, and a table without rows."""
    import corpus_pipeline as P

    stage = dict(P.STAGES)[name]
    got = stage(spark, odd, SF)
    if name != "packing":
        assert got.columns == odd.columns
    assert stage(spark, odd.limit(0), SF).count() == 0
    rows = [(r.doc_id, r.text) for r in got.collect()] if name != "packing" else got.collect()
    given = [(i, t) for i, t, _ in ODD]
    if name == "quality":
        assert set(rows) <= set(given) and all(rows.count(r) == given.count(r) for r in rows)
    if name == "near_dedup":
        want = [given[0], given[2], (3, None), (4, ""), (5, "  \n "), *given[8:12], given[12]]
        assert sorted(map(str, rows)) == sorted(map(str, want))
    if name == "suffix_dedup":
        left = dict(zip(map(str, rows), rows))
        assert len(rows) == len(given) and (7, "x" * 200_000 + "é") in rows and (8, "") in rows and rows.count((3, None)) == 2 and len(left) < len(rows)
    if name == "mixing":
        size = lambda s: sum(len(WORD.findall(t or "")) for _, t, x in ODD if x == s)
        assert set(rows) <= set(given)
        assert all(rows.count(r) <= 3 * given.count(r) for r in rows) and sum(len(WORD.findall(t)) for i, t in rows if (i, t, "c") in ODD) == 3 * size("c")
    if name == "packing":
        assert {r.doc_id for r in rows} == {i for i, _ in given} and sum(r.start == 0 for r in rows) == len(given)
        assert all(sum(r.length for r in rows if r.sequence_id == s) <= 2048 for s in {r.sequence_id for r in rows})
