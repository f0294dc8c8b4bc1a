import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from factlake.llm import embedding
from factlake.llm.decontaminate import decontaminate
from factlake.llm.embedding import near_duplicate_vectors
from factlake.llm.graph import components
from factlake.llm.hashing import SPACE_SEPARATORS, hash_words, ngram_hashes
from factlake.llm.hnsw import Graph
from factlake.llm.jaccard import Signer, jaccard_components, most_frequent, overlap, shingle_sets, slack
from factlake.llm.substring import remove_repeats
from factlake.llm.tables import Scratch
from tests.llm import brute


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**9)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    """Near copies with 0-5 edits, a passage many share, tiny texts, exact and repeated rows, nulls."""
    rnd, docs = random.Random(5), []
    for g in range(3):
        base = [f"G{g}w{rnd.randrange(400)}" for _ in range((60, 90, 150)[g])]
        docs += [" ".join(edited(rnd, base, rnd.randrange(6))) for _ in range(30)]
    passage = [f"p{k}" for k in range(60)]
    docs += [" ".join([f"q{rnd.randrange(10**9)}" for _ in range(rnd.randrange(5, 60))] + passage) for _ in range(40)]
    docs += [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(12))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(docs)] + [(900, None), (901, ""), (902, docs[0]), (903, " \n"), (0, docs[0])]
    rnd.shuffle(rows)
    return rows


def test_hashes_depend_on_words_alone():
    w, n = hash_words([b"The  cat", b"", b"the cat sat"], SPACE_SEPARATORS, True)
    assert n.tolist() == [2, 0, 3] and w[:2].tolist() == w[2:4].tolist()
    x = np.arange(100, dtype=np.uint64)
    for k in (1, 5, 16, 50):
        assert ngram_hashes(x, k)[7] == ngram_hashes(x[7 : 7 + k], k)[0]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(110)] + [(k, k + 1) for k in range(300, 340)]
    want = brute.union(edges, {x for e in edges for x in e})
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got.get(i, i) == c for i, c in want.items())
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_signatures_of_any_two_partners_meet():
    """Whatever shingles count as frequent, sets at the threshold share a signature."""
    rnd = random.Random(9)
    for trial in range(300):
        size = 80 if trial % 2 else 420
        universe = np.array(sorted(rnd.sample(range(1 << 50), size)), np.uint64)
        n = rnd.randrange(4, size * 3 // 4)
        a = set(rnd.sample(range(size), n))
        b = set(rnd.sample(sorted(a), max(1, n - rnd.randrange(0, max(1, n // 5))))) | set(rnd.sample(range(size), rnd.randrange(0, 3 + n // 10)))
        if 100 * len(a & b) < 80 * len(a | b) or a == b:
            continue
        assert len(a & b) >= overlap(len(a), len(b), 80)
        hot = sorted(rnd.sample(range(size), rnd.randrange(0, size + 1)))
        signer = Signer(universe[hot], np.array([rnd.randrange(1, 13) for _ in hot]), 80)
        one, two = ({(s, side) for s, side in zip(*(x.tolist() for x in signer.sign(universe[sorted(x)])[:2]), strict=True)} for x in (a, b))
        assert {(s, {1: 2, 2: 1}.get(side, side)) for s, side in one} & two, (len(a), len(b), len(hot))
    assert all(slack(n, 80) == n - -(-80 * n // 100) for n in range(1, 700))


def test_one_large_group_of_edited_copies(spark):
    """Copies of which many are below the threshold to the original and to each other."""
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(400)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rnd, base, rnd.choice((0, 1, 2, 3, 4, 5, 7, 9))))) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + f" tail{i} tail") for i in range(0, 150, 7)]
    sizes, place = brute.shingle_components(rows)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (sizes[i], place[i]) for i in sizes}
    assert len(set(place.values())) > 20


def test_jaccard_components(spark, corpus):
    sizes, place = brute.shingle_components(corpus)
    df = spark.createDataFrame([(i, t, "x") for i, t in [*corpus, (None, corpus[0][1])]], "doc_id long, text string, component_id string")
    rows = jaccard_components(df.repartition(5)).collect()
    assert len(rows) == len(corpus) + 1
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == ((sizes[r["doc_id"]], place[r["doc_id"]]) if r["doc_id"] is not None else (r["n_shingles"], None))
    assert jaccard_components(df.limit(0)).count() == 0
    assert [len(x) for x in shingle_sets([b"", b"a b", b"a b c d e", b"a b c d e f"])] == [0, 1, 1, 2]


def test_remove_repeats(spark, corpus):
    want = brute.removed_words(corpus)
    df = spark.createDataFrame([(i, t, 1) for i, t in corpus], "doc_id long, text string, kept int")
    rows = remove_repeats(df.repartition(4), digest=True).collect()
    assert len(rows) == len(corpus) and {r["doc_id"]: tuple(r)[1:] for r in rows} == want
    text = remove_repeats(spark.createDataFrame([(None, "a b"), (5, None)], "doc_id long, text string")).collect()
    assert sorted((r["n_words"], r["kept"]) for r in text) == [(0, ""), (2, "a b")]
    assert remove_repeats(df.limit(0)).count() == 0


def test_decontaminate(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["The", "cat", "SAT", "on", "é", "Mat", "2", "x"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((40, 20, 13, 12, 5, 3, 14))] + [(50, None), (51, "..."), (0, "repeated id the cat"), (None, "null id words")]
    docs = []
    for i in range(120):
        body = [word() for _ in range(rnd.randrange(60))]
        if i % 2 and (t := items[rnd.randrange(7)][1].split()):
            a = rnd.randrange(len(t))
            body[5:5] = t[a : a + rnd.randrange(1, 40)]
        docs.append((i, rnd.choice([" ", ", ", "-\n"]).join(body)))
    docs += [(200, None), (201, ""), (202, docs[1][1]), (1, docs[1][1])]
    want = brute.contamination(docs, [x for x in items if x[0] is not None])
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate(df, bench).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) == want[r["doc_id"]][:2] + (want[r["doc_id"]][2], want[r["doc_id"]][3])
    assert not any(r["contaminated"] for r in decontaminate(df, bench.limit(0)).collect())
    assert decontaminate(df.limit(0), bench).count() == 0


def test_graph_finds_near_vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    x[:600] = x[:200].repeat(3, 0) + rng.normal(size=(600, 32)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, _ = Graph.build(x).search(x[:600], 48)
    truth = x[:600] @ x.T >= 0.95
    assert sum(len(set(np.flatnonzero(t)) & set(f)) for t, f in zip(truth, found, strict=True)) >= 0.97 * truth.sum()


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:160] = x[0] + rng.normal(size=(60, 16)).astype(np.float32) * 0.02
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(500, x[7].tolist()), (501, x[7].tolist()), (600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [None] * 16), (604, [1.0, 2.0]), (605, []), (None, x[7].tolist())]
    good = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and len(v) == 16 and i not in (601, 602, 603)}
    ids = sorted(good)
    m = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    near = m @ m.T >= 0.9
    links = {i: int(near[k].sum()) - 1 for k, i in enumerate(ids)}
    place = brute.union([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)], ids)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, kept int")
    got = near_duplicate_vectors(df).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"]) == ((links[i], place[i]) if i in links else (0, i)), i
        assert r["kept"] == (i is not None and r["component_id"] == i)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def _dense(n, group, dim=16):
    """Vectors of which ``group`` are nearly equal."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[:group] = x[0] + rng.normal(size=(group, dim)).astype(np.float32) * 0.05
    return x


def test_links_of_a_dense_group_are_not_held_for_all_queries():
    x = _dense(6000, 5000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph.build(x)
    tracemalloc.start()
    found = sum(len(near) for _, near, _ in embedding.each_links(graph, x[:2000], 0.9, 24))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found >= 0.99 * 2000 * 5000
    # all links of these queries are 80 MB
    assert peak < 40e6, peak


def test_a_graph_moves_as_nodes_and_is_the_same_again():
    x = _dense(3000, 500)
    order = np.random.default_rng(1).permutation(3000)
    columns = {"dim": [16] * 3000, "shard": [0] * 3000, "vec_id": order.tolist(), "copies": [1] * 3000, "embedding": x[order].tolist()}
    rows = pa.table(columns, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("vec_id", pa.int64()), ("copies", pa.int64()), ("embedding", pa.list_(pa.float32()))]))
    nodes = embedding._build((pa.scalar(16), pa.scalar(0)), rows)
    assert nodes.num_rows == 3000
    again = embedding._restore(nodes.to_batches(700), 16)[0]
    graph = Graph.build(embedding._unit(x)[0])
    assert np.array_equal(again.x, graph.x) and [a.tolist() for a in again.links] == [b.tolist() for b in graph.links]


def test_near_duplicate_vectors_of_a_dense_group_in_many_blocks(spark, monkeypatch):
    # 7 shards, 2 copies of each graph
    monkeypatch.setattr(embedding, "SHARD", 300)
    monkeypatch.setattr(embedding, "BLOCK", 1000)
    x = _dense(2000, 600)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    place = brute.union([(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)], list(range(2000)))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in near_duplicate_vectors(df).collect()}
    assert len(got) == 2000
    assert all(got[k]["component_id"] == place[k] for k in range(2000))
    links = near.sum(1) - 1
    assert all(got[k]["n_links"] <= links[k] for k in range(2000))
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * links.sum()


def test_the_most_frequent_shingles_are_told_apart_at_every_size(spark):
    many = spark.range(40_000).selectExpr("id AS node", "if(id < 20000, 50000L + id % 7, 2 + id % 100) AS c")
    assert most_frequent(many, 50_000).count() == 40_000
    top = most_frequent(many, 5_000)
    assert 4_500 < top.count() < 5_500 and top.where("c < 50000").isEmpty()
    some = most_frequent(many, 25_000)
    assert some.where("c >= 50000").count() == 20_000 and 24_500 < some.count() <= 25_500
    assert sorted(r["node"] for r in some.collect()) == sorted(r["node"] for r in most_frequent(many.repartition(7), 25_000).collect())
    assert most_frequent(many.limit(0), 10).count() == 0
