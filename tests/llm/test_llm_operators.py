"""Each operator against a plain version on odd rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardloom.llm import near_dedup, textbytes
from shardloom.llm.common import Scratch, components, tokenizer_file
from shardloom.llm.forest import near_duplicate_vectors, nearest_neighbours
from shardloom.llm.mixing import mix_sources
from shardloom.llm.near_dedup import least_shared, near_duplicates
from shardloom.llm.packing import B, K1, Bm25, bm25_idf, pack_documents, pack_shard, routing_ranks
from shardloom.llm.quality import FEATURES, Model, _score, fit_quality, held_out, passages, quality_scores, score_quality
from shardloom.llm.run_index import RunLengthIndex
from shardloom.llm.sharding import assign_shards, write_shards
from shardloom.llm.suffix_dedup import _anchors, _cut, repeated_strings
from shardloom.llm.token_tables import lookup, read_manifest, read_tables, write_tables
from shardloom.llm.tokens import encoder
from shardloom.llm.warc import find_captures, read_captures, read_records, surt, write_archive

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, rep string, score double, v binary, bucket int, row string"


def texts(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    base = [[word() for _ in range(n)] for n in (60, 60, 120, 30, 8)]
    out = [None, "", "  \n\t ", "one", "One", "a b c d", "A b\tc  d", "x", "\U0001f602 \x00 z", " ".join(word() for _ in range(30000))]
    for _ in range(90):  # near copies of all degrees
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    passage = " ".join(word() for _ in range(14))
    out += [f"{' '.join(word() for _ in range(rng.randint(1, 40)))} {passage} {word()}" for _ in range(25)]
    out += [out[20]] * 6 + ["aaaa" * 40] * 2
    return out


def rows():
    t = texts()
    ids = list(range(len(t)))
    random.Random(1).shuffle(ids)
    out = [(i, x, "en", [None, "s1", "s2", "é"][n % 4], None, n, "x", 0.5, b"v", n, "r") for n, (i, x) in enumerate(zip(ids, t))]
    return out + [out[30], (None, t[25], "en", "s1", 1, 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# near-duplicates


def shingles(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(docs, none):
    sets = {r[0]: shingles(r[1]) for r in rows() if r[0] is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want, got = closure(sets, links), by_id(near_duplicates(docs))
    assert {i: (len(s), want[i], want[i] == i) for i, s in sets.items()} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}
    assert len(links) > 50
    all_rows = near_duplicates(docs).collect()
    assert len(all_rows) == len(rows()) and all(r.kept and r.component_id is None for r in all_rows if r.doc_id is None)
    assert near_duplicates(none).count() == 0


def test_repeated_rows_and_ids(spark):
    """Thousands of equal rows, and one id with several texts: each row goes by its own text."""
    word = [f"w{i}" for i in range(40)]
    one, two, other = " ".join(word), " ".join(word[:39] + ["z"]), "quite another text of more than five words"
    data = [(1, one)] * 3000 + [(2, two)] * 3000 + [(3, other), (3, one), (3, two), (3, two), (4, other), (5, None), (5, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    began = time.time()
    got = near_duplicates(df).groupBy("doc_id", "n_shingles", "component_id", "kept", "chosen").count().collect()
    assert {tuple(r) for r in got} == {
        (1, 36, 1, True, True, 3000), (2, 36, 1, False, False, 3000), (3, 36, 1, False, False, 3), (3, 4, 3, True, True, 1), (4, 4, 3, False, False, 1), (5, 0, 5, True, True, 2),
    }
    assert time.time() - began < 120


@pytest.mark.parametrize("rounds", [0, 2])
def test_families_on_one_template(spark, rounds):
    """Families share half of their texts, so that their lists join many components."""
    rng = random.Random(6)
    page = [f"t{j}" for j in range(60)]
    out = []
    for i in range(240):
        own = [f"f{i % 12}x{j}" for j in range(60)]
        for j in rng.sample(range(60), rng.choice([0, 1, 2, 3])):
            own[j] = f"{i}y{j}"
        out.append((i, " ".join(page + own)))
    sets = {i: shingles(t) for i, t in out}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = by_id(near_duplicates(spark.createDataFrame(out, "doc_id long, text string"), rounds=rounds))
    assert {i: r.component_id for i, r in got.items()} == closure(sets, links) and len({r.component_id for r in got.values()}) >= 12


def test_large_group_of_near_copies(spark):
    """Members far from the hub are linked with their own partners, without all pairs."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    out = []
    for i in range(700):
        w = list(base)
        for j in rng.sample(range(100), rng.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            w[j] = f"{i}x{j}"
        out.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in out}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = by_id(near_duplicates(spark.createDataFrame(out, "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == closure(sets, links)


def test_hubs_that_join_nothing_end_the_rounds(spark, monkeypatch):
    """Hundreds of different texts on one template: their lists are searched for open ones once, not in each round."""
    rng = random.Random(3)
    page = [f"t{j}" for j in range(60)]
    out = [(i, " ".join([*page, *(f"{i}x{j}" for j in range(34))])) for i in range(700)]
    for i in range(0, 40, 2):  # few pairs among them
        w = out[i][1].split()
        w[rng.randrange(70, 90)] = "z"
        out[i + 1] = (i + 1, " ".join(w))
    calls, rows = [], near_dedup._mixed
    monkeypatch.setattr(near_dedup, "_mixed", lambda x: calls.append(1) or rows(x))
    monkeypatch.setattr(near_dedup, "BLOCK", 256)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 5000)
    sets = {i: shingles(t) for i, t in out}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = by_id(near_duplicates(spark.createDataFrame(out, "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == closure(sets, links) and len(links) == 20
    assert len(calls) == 1


@pytest.mark.parametrize("dense", [1, 50, 10**9])
def test_overlaps(monkeypatch, dense):
    monkeypatch.setattr(near_dedup, "DENSE", dense)
    monkeypatch.setattr(near_dedup, "PAIRS", 50)
    rng = np.random.default_rng(5)
    left, right = ([np.unique(rng.integers(-300, 300, n) // rng.integers(1, 20)) for n in rng.integers(0, 60, m)] for m in (40, 30))
    a, b, inter = near_dedup._overlaps(left, right)
    assert (a == [len(x) for x in left]).all() and (b == [len(x) for x in right]).all()
    assert (inter == [[len(np.intersect1d(x, y)) for y in right] for x in left]).all()


def test_short_text_in_a_longer_one(spark):
    # 63 shingles inside 84 and 80: a longer sketch keeps 64 values, so fewer of the common ones are seen
    pairs = []
    for i in range(30):
        w = [f"w{i}x{j}" for j in range(88)]
        pairs += [(4 * i, " ".join(w[:67])), (4 * i + 1, " ".join(w))]
        w = [f"v{i}x{j}" for j in range(84)]
        pairs += [(4 * i + 2, " ".join(w[:64])), (4 * i + 3, " ".join(w))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in pairs}


def test_bound():
    from math import comb

    c = least_shared(64, 0.75)
    assert sum(comb(64, i) * 0.75**i * 0.25 ** (64 - i) for i in range(c)) <= 1e-7 and c == 29


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 102), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}


def test_memory_of_shingles_and_passages():
    """A worker's memory for a batch of texts is far below a hundred MB, whatever the batch's size."""
    batch = pa.record_batch([pa.array([" ".join(f"w{i * j % 997}" for j in range(600)) for i in range(4000)])], ["text"])
    model = Model(np.zeros(FEATURES), np.ones(FEATURES), Model.fit(np.zeros((0, FEATURES)), np.zeros(1, int), np.zeros(0)).p)
    for work in (lambda: shingle_count(textbytes.shingle_sets(batch.column(0), 5)), lambda: shingle_count(b.column(1) for b in _score(model, "s")(iter([batch])))):
        textbytes._powers.cache_clear()
        tracemalloc.start()
        assert work() >= 4000
        assert tracemalloc.get_traced_memory()[1] < 60e6
        tracemalloc.stop()


def test_memory_of_anchors_cuts_and_tokens():
    """The same holds for a batch's anchors, for what is left of its texts, and for their ids."""
    text = pa.array([" ".join(f"w{i * j % 997}" for j in range(600)) for i in range(4000)])
    ids, e = pa.array(range(4000)), encoder(tokenizer_file("byte_bpe_50k.json"))
    spans = pa.array([[np.array([0, 60], "<i8").tobytes()]] * 4000, pa.list_(pa.binary()))
    batch = pa.record_batch([ids, text, pa.nulls(4000, pa.list_(pa.binary())), spans, ids], ["doc_id", "text", "covered", "spans", "row"])
    cut = pa.concat_arrays([b.column("text") for b in _cut(True, 50)(iter([batch]))])
    assert cut.to_pylist() == [t[60:] for t in text.to_pylist()]
    works = [
        (60e6, lambda: shingle_count(b.column(1) for b in _anchors(50, 7, np.zeros(0, np.uint64))(iter([batch.select([0, 1])])))),
        (10e6, lambda: shingle_count(b.column(0) for b in _cut(True, 50)(iter([batch])))),
        (80e6, lambda: shingle_count(e.batch(text))),
    ]
    for most, work in works:
        textbytes._powers.cache_clear()
        tracemalloc.start()
        assert work() > 0
        assert tracemalloc.get_traced_memory()[1] < most
        tracemalloc.stop()


def shingle_count(parts):
    return sum(map(len, parts))


# vectors

VECTORS = "vec_id long, embedding array<float>, label int, leaf long, bits string"


def vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 16)).astype(np.float32)
    x = [base[i] + rng.standard_normal(16).astype(np.float32) * 0.08 * (i % 3 == 0) for i in rng.integers(0, 300, 500)]
    out = [(int(i), [float(c) for c in v], 0, 1, "b") for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 15 + [None], [1.0] * 5]
    out += [(1000 + i, v, 0, 1, "b") for i, v in enumerate(odd)] + [(None, out[3][1], 0, 1, "b"), out[4]]
    out += [(2000 + i, [2.0 * c for c in out[5][1]], 0, 0, "") for i in range(4)]
    return out


def cosines(rows):
    fine = [r for r in rows if r[0] is not None and r[1] and len(r[1]) == 16 and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1])]
    ids, x = np.array([r[0] for r in fine]), np.array([r[1] for r in fine], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return ids, x @ x.T


@pytest.mark.parametrize("most", [10, 1])
def test_neighbours(spark, most):
    """Also by trees of several parts, of one level each."""
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    ids, s = cosines(rows[:-5] + rows[-4:])
    got = nearest_neighbours(df, F.col("vec_id") % 10 == 0, k=5, most=most, leaf_rows=60, share=0.5).collect()
    found = total = 0
    for q in ids[ids % 10 == 0]:
        i = np.flatnonzero(ids == q)[0]
        near = sorted(((-round(s[i, j], 12), ids[j]) for j in range(len(ids)) if ids[j] != q))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(abs(r.score - s[i, np.flatnonzero(ids == r.vec_id)[0]]) < 1e-9 for r in mine)
        found += len({r.vec_id for r in mine} & {v for _, v in near})
        total += 5
    assert found / total >= 0.9 and {r.query_id for r in got} == set(ids[ids % 10 == 0])
    assert nearest_neighbours(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert nearest_neighbours(few, F.col("vec_id") == 0).count() == 2


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = df.toPandas()
    ids, e = x.vec_id.to_numpy(), np.stack(x.embedding).astype(np.float64)
    e /= np.linalg.norm(e, axis=1)[:, None]
    got = nearest_neighbours(df, F.col("vec_id") % 50 == 0).toPandas().groupby("query_id").vec_id.apply(set)
    s = e[ids % 50 == 0] @ e.T
    s[np.arange(len(s)), np.flatnonzero(ids % 50 == 0)] = -2
    assert np.mean([len(got[q] & set(ids[np.argsort(-s[i])[:5]])) / 5 for i, q in enumerate(ids[ids % 50 == 0])]) >= 0.9


def test_a_vector_with_thousands_of_copies(spark):
    """A third of all rows are one vector: it is one node, and each of its rows finds the others by id."""
    rng = np.random.default_rng(1)
    data = [(i, rng.standard_normal(8).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(6000)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = nearest_neighbours(df, F.col("vec_id") % 50 == 0, share=1.0).where("query_id >= 1000").collect()
    assert len(got) == 120 * 5
    for r in got:
        assert r.vec_id == [i for i in range(1000, 1007) if i != r.query_id][r["rank"] - 1] and abs(r.score - 1) < 1e-12


def test_parts_of_a_tree_search_like_one_queue(spark):
    """With all levels' leaves wanted, parts of one level each give every leaf once, the nearest first."""
    from shardloom.llm.forest import deal_to_leaves, levels

    assert levels(1 << 20, 512, 4) == [4, 4, 3] and levels(10) == [0]
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1000, 8)).tolist()
    data = [(i, x[i], a) for i in range(1000) for a in (False, True) if not a or i % 100 == 0]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, asks boolean")
    for budget in (5, 32):
        dealt, leaves = deal_to_leaves(Scratch(spark, "t"), df, 1000, 8, 2, 3, 0.0, 60, 2, budget)
        got = dealt.toPandas()
        assert leaves == 32 and (got[~got.asks].groupby("vec_id").size() == 2).all() and (got[got.asks].groupby("vec_id").size() == budget).all()
        own = got[~got.asks].groupby("vec_id").leaf.apply(set)
        first = got[got.asks & (got.cost == 0)].groupby("vec_id").leaf.apply(set)
        assert all(own[q] == leaf for q, leaf in first.items()) and len(first) == 10
        assert 15 < got[~got.asks].groupby("leaf").size().median() < 140


@pytest.mark.parametrize("most", [10, 1])
def test_vector_dedup(spark, most):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    ids, s = cosines(rows)
    links = [(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in range(i) if s[i, j] >= 0.95]
    got = near_duplicate_vectors(df, most=most, leaf_rows=512 if most == 10 else 120).collect()
    assert len(got) == len(rows)
    want = closure([r[0] for r in rows if r[0] is not None], links)
    for r in got:
        if r.vec_id is None or 1000 <= r.vec_id < 2000:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert r.component_id == want[r.vec_id] and r.kept == (r.vec_id == want[r.vec_id])
            if r.vec_id not in (rows[4][0],) and not any(rows[4][0] in x and r.vec_id in x for x in links):
                assert r.n_links == sum(r.vec_id in x for x in links)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


# archives


def test_archive(spark, tmp_path):
    html = ["<p>a</p>", None, "", "<p>ü</p>", "<p>a</p>", "<p>a</p>", "x" * 300_000]
    urls = ["http://www.Ex.com/b?q=1#f", None, "https://b.ex.com:443/", "b.org", "http://ex.com:8080/a", "http://ex.com/b?q=1", "ftp://u@z.net/\r\nX: y"]
    rows = [(i, u, h, "key", 5) for i, (u, h) in enumerate(zip(urls, html))] + [(None, "http://n.org/", "<p>a</p>", "k", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string, at int").repartition(2)
    path = f"file://{tmp_path}/a"
    write_archive(pages, path)
    got = read_records(path, read_captures(spark, path)).collect()
    assert len(got) == len(rows)
    one = {r.page_id: r for r in got}
    for i, h in enumerate(html):
        data = (h or "").encode()
        top = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        r = one[i]
        assert r.payload_bytes == len(data) and r.kind == ("response" if i == top else "revisit") and r.refers_to == (None if i == top else top)
        assert i != top or bytes(r.payload) == data
    assert one[None].kind == "revisit" and one[None].refers_to == 5
    found = find_captures(path, spark.createDataFrame([("http://ex.com/b?q=1",), ("http://none.com/",)], "url string")).collect()
    assert {r.page_id for r in found} == {0, 5}
    everything = sorted(str(r) for r in find_captures(path, pages).collect())
    assert everything == sorted(str(r) for r in read_captures(spark, path).collect()) and len(everything) == len(rows)
    assert surt("http://www.Ex.com/b?q=1#f") == "com,ex)/b?q=1" and surt("http://ex.com:8080/a") == "com,ex:8080)/a" and surt(None) == ")/"
    empty = f"file://{tmp_path}/b"
    write_archive(pages.limit(0), empty)
    assert read_captures(spark, empty).count() == 0 and find_captures(empty, pages).count() == 0


def test_captures_over_many_files(spark, tmp_path, monkeypatch):
    """Keys that run over blocks and files are found whole."""
    from shardloom.llm import files, warc

    monkeypatch.setattr(warc, "FILE_LINES", 60)
    monkeypatch.setattr(files, "FILES_PER_FENCE", 2)
    urls = [f"http://h{i % 40}.org/{i % 3}" for i in range(500)] + ["http://hot.org/"] * 400
    pages = spark.createDataFrame([(i, u, f"<p>{i % 600}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/m"
    write_archive(pages, path)
    assert spark.read.parquet(f"{path}/index").count() > 8
    found = find_captures(path, spark.createDataFrame([("http://hot.org/",), ("http://h7.org/1",), ("http://zz.org/",)], "url string")).collect()
    assert sorted(r.page_id for r in found) == [i for i, u in enumerate(urls) if u in ("http://hot.org/", "http://h7.org/1")]
    got = read_records(path, find_captures(path, pages)).collect()
    assert sorted(r.page_id for r in got) == list(range(900))
    assert all((r.kind == "response") == (r.page_id + 600 >= 900) for r in got)


# shards and mixture


def test_archive_of_repeated_ids(spark, tmp_path):
    rows = [(1, "<p>a</p>"), (9, "<p>a</p>"), (9, "<p>a</p>"), (1, "own"), (None, "<p>a</p>"), (None, "other"), (None, "third"), (9, "own")]
    path = f"file://{tmp_path}/r"
    write_archive(spark.createDataFrame([(i, "u.org", h) for i, h in rows], "page_id long, url string, html string").repartition(2), path)
    got = [(r.page_id, r.kind, r.refers_to, bytes(r.payload).decode() if r.payload is not None else None) for r in read_records(path, read_captures(spark, path)).collect()]
    # the two equal rows of the largest id are one response and a revisit of it
    want = [(1, "revisit", 9, None)] * 2 + [(9, "response", None, "<p>a</p>"), (9, "revisit", 9, None), (9, "response", None, "own"), (None, "revisit", 9, None)]
    want += [(None, "response", None, "other"), (None, "response", None, "third")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_shards(docs, none, spark, tmp_path):
    got = assign_shards(docs, 5).collect()
    n = len(rows())
    assert len(got) == n
    counts = np.bincount([r.shard for r in got], minlength=5)
    assert counts.max() - counts.min() <= 1
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    for source in {r.source for r in got}:
        per = np.bincount([r.shard for r in got if r.source == source], minlength=5)
        assert per.max() - per.min() <= 2
    text = {r[0]: (r[1] or "").encode() for r in rows()}
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got if r.doc_id is not None)
    again = assign_shards(docs.repartition(7), 5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert assign_shards(none).count() == 0
    # docs has a column shard, so the partitions are named shard_
    write_shards(docs, f"file://{tmp_path}/s", 4)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == n and set(docs.columns) <= set(back.columns)
    assert sorted((r.shard_, r.slot) for r in back.select("shard_", "slot").collect()) == sorted((r.shard, r.slot) for r in assign_shards(docs, 4).collect())


def test_shards_of_many_small_sources_and_null_ids(spark):
    """Single-row sources are spread over all shards; null and repeated ids don't share a place in the shuffle."""
    small = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("s"), "id").alias("source"))
    null = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"), F.lit("big").alias("source"))
    began = time.time()
    got = assign_shards(small.union(null), 8).groupBy("shard").agg(F.count("*").alias("n"), F.count(F.when(F.col("source") == "big", 1)).alias("big"), F.count_distinct("slot").alias("slots")).collect()
    assert len(got) == 8 and all(r.n == r.slots == 12_500 and 6000 < r.big < 6500 for r in got) and time.time() - began < 60


def targets(sums):
    """Words wanted of each source: by weight 1, 2, 3 ..., at most three times what it has, the excess to the others."""
    weights, target, free = [[1, 2, 3][i % 3] for i in range(len(sums))], {}, dict(enumerate(sums))
    while True:
        rest = sum(sums) - sum(3 * sums[i] for i in target)
        level = rest / sum(weights[i] for i in free)
        over = [i for i in free if level * weights[i] > 3 * sums[i]]
        for i in over:
            target[i] = 3 * sums[i]
            del free[i]
        if not over:
            return target | {i: level * weights[i] for i in free}


def test_a_large_source_at_its_cap(spark):
    """Where a cap binds, each document is taken three times, without one row for the source."""
    capped = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"), F.lit("c").alias("source"))
    rest = spark.range(100_000, 101_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 2000).alias("text"), F.lit("a").alias("source"))
    began = time.time()
    got = mix_sources(capped.union(rest)).groupBy("source").agg(F.sum("taken").alias("taken"), F.min("copies").alias("lo"), F.max("copies").alias("hi"), F.max("target").alias("t")).collect()
    by = {r.source: r for r in got}
    assert (by["c"].taken, by["c"].lo, by["c"].hi) == (300_000, 3, 3) and abs(by["a"].taken - by["a"].t) <= 2000
    assert time.time() - began < 60


def test_mixture(docs, none):
    got = mix_sources(docs).collect()
    assert len(got) == len(rows())
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({r[3] for r in rows()} - {None}) + [None]
    sums = [sum(size(r[1]) for r in rows() if r[3] == s) for s in sources]
    target = targets(sums)
    for i, s in enumerate(sources):
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sums[i]}
        assert all(abs(r.target - target[i]) < 1e-6 * max(1, target[i]) and r.taken <= 3 * r.size for r in mine)
        largest = max(r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[i]) <= largest / 2
        assert all(r.taken % max(1, r.size) == 0 for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(7)).collect()))
    assert mix_sources(none).count() == 0
    one, two = ({(r.doc_id, r.copies) for r in mix_sources(docs, share=0.3, seed=s).collect()} for s in (1, 2))
    assert one != two


# quality


def plain_scores(model, x, first):
    """The classifier's formula, passage by passage."""
    p, out = model.p, []
    for a, b in zip(first[:-1], first[1:]):
        hs, logits = [], []
        for row in x[a:b]:
            z = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(row, model.mean, model.scale)]
            h = [max(0.0, sum(zi * w for zi, w in zip(z, p["W"][:, j])) + p["b"][j]) for j in range(p["W"].shape[1])]
            gate = [np.tanh(np.dot(h, p["V"][:, j])) / (1 + np.exp(-np.dot(h, p["G"][:, j]))) for j in range(p["V"].shape[1])]
            hs.append(h)
            logits.append(np.dot(gate, p["u"]))
        e = np.exp(np.array(logits) - max(logits))
        rep = sum(w * np.array(h) for w, h in zip(e / e.sum(), hs))
        out.append(1 / (1 + np.exp(-(np.dot(rep, p["c"]) + p["d"]))))
    return np.array(out)


def bags(n=12, seed=3):
    rng = np.random.default_rng(seed)
    first = np.cumsum([0, *rng.integers(1, 6, n)])
    return rng.standard_normal((first[-1], 7)), first, rng.integers(0, 2, n).astype(float)


def test_forward_pass():
    from shardloom.llm.quality import Model

    x, first, y = bags()
    model = Model.fit(x, first, y)
    model.p["u"] = np.random.default_rng(1).standard_normal(model.p["u"].shape)
    assert np.allclose(model.score(x, first)[0], plain_scores(model, x, first))
    assert np.allclose(np.add.reduceat(model.score(x, first)[1], first[:-1]), 1)


def test_gradient_is_the_slope_of_the_loss():
    from shardloom.llm.quality import DECAY, Model

    x, first, y = bags()
    model = Model.fit(x, first, y)
    model.mean, model.scale = np.zeros(7), np.ones(7)
    rng = np.random.default_rng(2)
    for k in model.p:
        model.p[k] = np.array(rng.standard_normal(np.shape(model.p[k])) * 0.5)

    def loss():
        s = model.score(x, first)[0]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)) + DECAY / 2 * sum((v**2).sum() for k, v in model.p.items() if k not in "bd")

    grad = Model.gradient(model.p, x, first, y)
    for k, v in model.p.items():
        for at in list(np.ndindex(v.shape))[:: max(1, v.size // 5)]:
            was = float(v[at])
            slopes = []
            for step in (1e-5, -1e-5):
                v[at] = was + step
                slopes.append(loss())
            v[at] = was
            assert (slopes[0] - slopes[1]) / 2e-5 == pytest.approx(float(grad[k][at]), abs=1e-6)


def test_held_out_accuracy_needs_words_and_many_passages():
    """Bags whose label hangs on one of their passages are told apart."""
    from shardloom.llm.quality import Model

    rng = np.random.default_rng(7)
    first = np.cumsum([0, *rng.integers(3, 9, 600)])
    x, y = rng.standard_normal((first[-1], 7)), rng.integers(0, 2, 600).astype(float)
    for i in np.flatnonzero(y):
        x[rng.integers(first[i], first[i + 1]), 2] += 6
    model = Model.fit(x[: first[400]], first[:401], y[:400])
    got = model.score(x[first[400] :], first[400:] - first[400])[0]
    assert ((got >= 0.5) == (y[400:] == 1)).mean() > 0.95


def test_mixture_of_whole_copies(spark):
    # nothing is wanted beyond whole copies: no source's rows are gathered in one array
    many = spark.range(150_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    start = time.monotonic()
    assert [tuple(r) for r in mix_sources(many).groupBy("copies").count().collect()] == [(1, 150_000)]
    assert time.monotonic() - start < 60


def test_quality(spark, docs, none):
    table = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{table}/documents.parquet"), spark.read.parquet(f"{table}/labels.parquet")
    model = fit_quality(d, labels)
    got = score_quality(d, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("_score", "quality").toPandas()
    good, bad = got[got.quality == 1]._score, got[got.quality == 0]._score
    assert len(bad) and np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    scored = score_quality(docs, model)
    with pytest.raises(ValueError):
        score_quality(docs.withColumn("_score", F.lit(1)), model)
    clash = docs.withColumn("quality", F.lit("x")).withColumn("id", F.lit(0)).withColumn("label", F.lit(0)).withColumn("x", F.lit(0))
    again = fit_quality(clash.unionByName(clash), labels.withColumn("text", F.lit("x")))  # repeated rows count once
    once = fit_quality(docs, labels)
    assert all(np.array_equal(again.p[k], once.p[k]) for k in once.p)
    assert scored.columns == [*docs.columns, "_score"] and scored.count() == len(rows())
    assert scored.where("_score is null or _score < 0 or _score > 1").count() == 0
    assert score_quality(none, model).count() == 0
    odd = labels.limit(0).union(spark.createDataFrame([(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int"))
    assert quality_scores(docs, odd).where("score between 0 and 1").count() == len(rows())
    x, first = passages(np.frombuffer(("w " * 200).encode(), np.uint8), np.array([0, 0, 400]))
    assert first.tolist() == [0, 1, 5] and len(x) == 5


# repeated strings


def brute_strings(items, n=50, kept=None):
    """(bytes, removed, runs, digest of the rest) by id; the rest itself goes to ``kept``."""
    first, out = {}, {}
    for i, t in items:
        b = (t or "").encode()
        for s in range(len(b) - n + 1):
            first[b[s : s + n]] = min(i, first.get(b[s : s + n], i))
    for i, t in items:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            gone[s : s + n] |= first[b[s : s + n]] < i
        edges = np.diff(np.r_[0, gone.astype(int), 0])
        if kept is not None:
            kept[i] = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 2, 0])
def test_repeated_strings(docs, none, hot):
    items = {(r[0], r[1]) for r in rows() if r[0] is not None}
    want = brute_strings(sorted(items))
    # 0: every anchor that repeats in the sample is split by its surroundings at once
    got = repeated_strings(docs, hot_kinds=max(2, hot), hot_places=200_000 if hot else 0).collect()
    assert len(got) == len(rows())
    for r in got:
        mine = (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        assert mine == want[r.doc_id] if r.doc_id is not None else r.n_removed == 0
    assert sum(r.n_removed for r in got) > 1000
    if hot == 2:
        kept = repeated_strings(docs, keep_text=True)
        assert kept.where("doc_id is not null").select("row.*").columns == [c for c in docs.columns if c != "text"]
        assert all(hashlib.sha256((r.text or "").encode()).hexdigest() == want[r.doc_id][3] for r in kept.collect() if r.doc_id is not None and (r.text or "").isascii())
        assert repeated_strings(none).count() == 0


def test_run_index():
    rng = random.Random(1)
    base = [bytes(rng.choice(b"ab c") for _ in range(120)) for _ in range(5)]

    def variant(b):
        b = bytearray(b)
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = rng.choice(b"ab c\x00\xff")
        s = rng.randint(0, 40)
        return bytes(b[s : s + rng.randint(40, 80)])

    strings = [variant(rng.choice(base)) for _ in range(80)]
    patterns = [variant(rng.choice(base)) for _ in range(40)] + strings[:10] + [b"", b"zzz"]
    index = RunLengthIndex(strings, 50)
    assert index.runs < index.n / 3
    length, row = index.matching_statistics(patterns)
    for k, p in enumerate(patterns):
        for i in range(len(p)):
            at = length.shape[1] - len(p) + i
            n = 0
            while n < 50 and i + n < len(p) and any(p[i : i + n + 1] in s for s in strings):
                n += 1
            assert length[k, at] == n
            if n == 50:
                assert index.least_owner(row[k, at : at + 1])[0] == min(j for j, s in enumerate(strings) if p[i : i + 50] in s)
    assert RunLengthIndex([], 50).matching_statistics([b"abc"])[0].sum() == 0


# tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_are_the_tokenizers(name):
    import pyarrow as pa

    odd = ["", None, "  a  b  c 　 e\n\n x 's 'll don't, can't!  's", "café. e ́", "AΣ ΣΣ b\x1c c \x85 d", "x ​ y\xa0 z \xa0w", "1234 5 6,7 ... !! \t\t x", "﻿ a\r\n b", "\U0001f602 中文, x", "<|endoftext|> a", "A.B,c'D e-f_g"]
    e = encoder(tokenizer_file(name))
    got = [list(x) for x in e.batch(pa.array(odd + texts()[:40]))]
    want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in odd + texts()[:40]], add_special_tokens=False)]
    assert got == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens(name):
    import pyarrow as pa
    from tokenizers import Tokenizer

    odd = ["end of page <|endoftext|> next", None, "<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|> c", "<|endof", "text|>", "<|ENDOFTEXT|> É", "x <|endoftext|", "plain"]
    plain = Tokenizer.from_file(tokenizer_file(name))
    assert [list(x) for x in encoder(tokenizer_file(name)).batch(pa.array(odd))] == [plain.encode(t or "", add_special_tokens=False).ids for t in odd]


def plain_ids(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(docs, none):
    ids = plain_ids("byte_bpe_50k.json", 1)
    got = pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), window=256).collect()
    text = {r[0]: r[1] for r in rows()}
    pieces, windows = {}, {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append(r)
        if r.doc_id is not None:
            pieces.setdefault(r.doc_id, []).append(r)
    for i, mine in pieces.items():
        want = ids(text[i])
        times = sum(1 for r in rows() if r[0] == i)
        assert sum(r.length for r in mine) == times * len(want) and all(r.doc_tokens == len(want) for r in mine)
        assert all(bytes(r.ids) == want[r.start : r.start + r.length].tobytes() for r in mine)
    assert set(pieces) == {r[0] for r in rows()} - {None}
    padding = 0
    for mine in windows.values():
        mine.sort(key=lambda r: r.offset)
        assert [r.offset for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist() and sum(r.length for r in mine) <= 256
        padding += 256 - sum(r.length for r in mine)
    assert padding < 256 * len({s >> 40 for s in windows})
    assert pack_documents(none, tokenizer_file("byte_bpe_50k.json")).count() == 0


def plain_bm25(docs, everyone, seed):
    """Scores of all documents for the distinct terms of one of them, with counts over ``everyone``."""
    mean = sum(map(len, everyone)) / len(everyone)
    out = []
    for d in docs:
        score = 0.0
        for t in set(docs[seed]):
            df, tf = sum(t in e for e in everyone), list(d).count(t)
            score += np.log(1 + (len(everyone) - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(d) / mean))
        out.append(score)
    return np.array(out)


def test_bm25():
    rng = np.random.default_rng(4)
    everyone = [rng.zipf(1.3, rng.integers(0, 90)).astype(np.int64) % 400 for _ in range(60)]
    docs = everyone[:40]
    df = np.bincount(np.concatenate([np.unique(d) for d in everyone]).astype(int), minlength=400)
    index = Bm25(docs, bm25_idf(df, len(everyone)), sum(map(len, everyone)) / len(everyone))
    used = np.zeros(40, bool)
    used[[3, 7]] = True
    for seed in range(40):
        want = plain_bm25(docs, everyone, seed)
        want[used] = 0
        got = index.neighbours(seed, used)
        assert set(got.tolist()) == set(np.flatnonzero(want).tolist()) or len(set(docs[seed])) == 0
        assert np.allclose(want[got], np.sort(want)[::-1][: len(got)])


def test_windows_hold_the_best_unused_neighbours():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 50, rng.integers(1, 30)).astype(np.int64) for _ in range(50)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=50)
    index = Bm25(docs, bm25_idf(df, 50), sum(map(len, docs)) / 50)
    pieces = list(pack_shard(docs, index, 64))
    used, order = np.zeros(50, bool), list(dict.fromkeys(p[0] for p in pieces))
    opens = {}
    for d, start, n, s, offset in pieces:
        opens.setdefault(s, d)
    first = {d: s for d, start, n, s, offset in reversed(pieces) if start == 0}
    for k, d in enumerate(order):
        seed = opens[first[d]]
        if d != seed and k:
            want = plain_bm25(docs, docs, seed)
            want[used] = 0
            assert want[d] == pytest.approx(want.max()) or want.max() == 0
        used[d] = True
    assert sorted(order) == list(range(50)) and max(p[3] for p in pieces) == (sum(map(len, docs)) - 1) // 64


def test_neighbours_meet_in_windows(spark):
    """Families of texts with own words, dealt far apart by id, lie next to each other in the order."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    common, own = [word() for _ in range(50)], [[word() for _ in range(12)] for _ in range(40)]
    data = [(i, " ".join(rng.choices(own[i % 40], k=30) + rng.choices(common, k=10))) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = pack_documents(df, tokenizer_file("byte_bpe_50k.json"), window=2048, range_ids=20_000).toPandas()
    assert got.sequence_id.floordiv(1 << 40).nunique() > 3
    mates = [(a % 40 == b % 40) for _, w in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id") for a, b in zip(w.doc_id, w.doc_id[1:])]
    assert np.mean(mates) > 0.6
    ranks = routing_ranks(np.array([0, 1, 5, 5]), 10, 5)
    assert np.isinf(ranks[:, :2]).all() and np.isfinite(ranks[:, 2:]).all()


def test_token_tables(spark, docs, none, tmp_path):
    ids, path = plain_ids("word_bpe_49k.json", 2), f"file://{tmp_path}/t"
    write_tables(docs, path, tokenizer_file("word_bpe_49k.json"))
    got = sorted(read_tables(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == len(rows())
    start = 0
    for r in got:
        assert r.start == start
        start += len(r.ids) // 4
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r[0] for r in rows() if r[0] is not None) and got[0].doc_id is None
    text = {r[0]: r[1] for r in rows()}
    assert all(bytes(r.ids) == ids(text[r.doc_id]).tobytes() for r in got if r.doc_id is not None)
    everything = lookup(path, docs).collect()
    assert sorted((r.start, bytes(r.ids), str(r.doc_id)) for r in everything) == [(r.start, bytes(r.ids), str(r.doc_id)) for r in got]
    wanted = spark.createDataFrame([(3,), (rows()[30][0],), (10**9,), (-1,), (None,), (3,)], "doc_id long")
    found = lookup(path, wanted).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(["3", str(rows()[30][0]), str(rows()[30][0]), "None", "None"])
    assert all(bytes(r.ids) == ids(text[r.doc_id]).tobytes() for r in found if r.doc_id is not None)
    assert read_manifest(spark, path).agg(F.sum("n_docs")).first()[0] == len(rows())
    write_tables(none, f"file://{tmp_path}/e", tokenizer_file("word_bpe_49k.json"))
    assert read_tables(spark, f"file://{tmp_path}/e").count() == 0 and lookup(f"file://{tmp_path}/e", wanted).count() == 0


def test_table_files(tmp_path):
    """Many blocks, restarts, repeated keys across blocks, and keys that aren't there."""
    import pyarrow.fs as fs

    from shardloom.llm.token_tables import TableReader, TableWriter, key_of

    rng, at = np.random.default_rng(2), fs.LocalFileSystem()
    ids = sorted([*rng.integers(-500, 5000, 900).tolist(), *[77] * 400])
    values = [rng.integers(0, 60_000, rng.integers(1, 400)).astype(np.uint32) for _ in ids]
    with at.open_output_stream(f"{tmp_path}/f") as out:
        w = TableWriter(out, 2)
        for i, v in zip(ids, values, strict=True):
            w.add(key_of(i), v)
        w.close()
    with at.open_input_file(f"{tmp_path}/f") as source:
        r = TableReader(source)
        starts = np.cumsum([0, *map(len, values)]).tolist()
        assert len(r.index) > 5 and [(i, s, v.tolist()) for i, s, v in r.scan()] == [(i, s, v.tolist()) for i, s, v in zip(ids, starts, values)]
        assert sum(1 for _ in r.scan(1, 3)) < len(ids)
        asked = [key_of(i) for i in range(-600, 5100)]
        assert [(s, v.tolist()) for _, s, v in r.find_sorted(asked)] == [(s, v.tolist()) for s, v in zip(starts, values)]
        assert [v.tolist() for v in r.find(key_of(77))] == [v.tolist() for i, v in zip(ids, values) if i == 77]
        absent = [key_of(i) for i in range(10_000, 30_000)]
        assert r.may_have(absent).mean() < 0.03 and r.may_have([key_of(i) for i in ids]).all()
