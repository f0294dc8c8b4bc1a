"""The pipeline against brute force, stage by stage."""

import base64

import public_tokenizers
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from factlake.llm import pii
from factlake.llm.quality import score_quality
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = sorted(r["doc_id"] for r in score_quality(docs, labels).collect() if r["predicted"])
    place = brute.shingle_components([(i, texts[i]) for i in good])[1]
    one = [i for i in good if place[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    dirty = brute.contamination([(i, texts[i]) for i in one], items)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    tokens = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i in one:
        if not dirty[i][3]:
            text = pii.redacted(texts[i], pii.all_spans(texts[i]))
            ids = tokens.encode_ordinary(text)
            want[i] = (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(text))
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want and len(want) < len(texts)


def test_contract():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "benchmark_passages", "personal_data", "tokens"]
    queries = entry.queries()
    assert "pipeline" in queries and all(any(q.startswith(f"op{n}_") for q in queries) for n in range(1, 11))


def test_stages_keep_columns_and_take_nulls(spark):
    docs = spark.createDataFrame([(1, "Plain words stand here. " * 8, "en", "s", 9), (None, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert dict(corpus_pipeline.STAGES)["tokens"](spark, docs, FOLDER).count() >= 2


def test_stages_take_clashing_columns_and_empty_tables(spark):
    names = ("component_id", "n_shingles", "row_key", "made", "label", "score", "key", "sig", "node", "hash")
    docs = spark.createDataFrame([(k, f"Plain words stand here in row {k // 2}. " + "They go on as texts do, one after another, until the end. " * 4, "en", "s", 9, *["x"] * len(names)) for k in range(6)] + [(None, None, None, None, None, *[None] * len(names))], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    empty, columns = docs.limit(0), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        ids = sorted(r["doc_id"] for r in docs.where("doc_id is not null").collect())
        docs, empty = stage(spark, docs, FOLDER), stage(spark, empty, FOLDER)
        assert docs.columns == empty.columns == columns and empty.count() == 0, name
        if name == "near_duplicates":
            assert sorted(r["doc_id"] for r in docs.where("doc_id is not null").collect()) == sorted({k // 2: k for k in reversed(ids)}.values())
    dict(corpus_pipeline.STAGES)["tokens"](spark, empty, FOLDER).collect()
