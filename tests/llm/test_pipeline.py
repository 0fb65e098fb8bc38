"""The pipeline against plain versions of its stages, on tables of its own and on the smallest given ones."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scopelens.llm import queries
from tests.llm.test_duplicates import near_brute, passages
from tests.llm.test_texts import hits_brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def corpus(spark, prose, tmp_path):
    source = random.Random(8)
    texts = [text for _, text in passages(prose)]
    texts += [prose(40, 300 + k) + (" zwugg " if k % 4 == 0 else " ") + prose(20, 400 + k) for k in range(160)]
    texts += [prose(40, 301) + " " + prose(20, 401) + " end", prose(30, 900) + " " + prose(14, 500) + " tail"]
    rows = [(k, text, source.choice(["en", None]), None, None if text is None else len(text)) for k, text in enumerate(texts)]
    first = len(passages(prose))
    labels = [(k, 1, int((k - first) % 4 == 0)) for k in range(first, first + 160)] + [(0, None, None), (None, 1, 1)]
    spark.createDataFrame([*rows, (None, "a row without an id", "en", "s", 19)], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(14, 500)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def cut_text(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            if data[k : k + length] in seen:
                gone[k : k + length] = [True] * length
            seen.add(data[k : k + length])
        kept = bytes(x for x, g in zip(data, gone) if not g)
        if kept or not data:
            out[i] = kept.decode("utf-8", "ignore")
    return out


def held(df):
    return {row.doc_id: row.text for row in df.collect()}


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    results, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, results[-1], corpus)
        out.write.parquet(f"{corpus}/{name}")
        results.append(spark.read.parquet(f"{corpus}/{name}"))
        assert name == "encode" or results[-1].columns == columns
    before, calm, single, cut, clean = (held(df) for df in results[:5])
    toxic = {i for i, text in before.items() if text and "zwugg" in text}
    assert not toxic & set(calm) and set(before) - set(calm) == toxic
    expected = near_brute(list(calm.items()), 5)
    assert set(single) == {i for i, x in expected.items() if x[2]} | {None}
    named = {i: text for i, text in single.items() if i is not None}
    assert {i: text for i, text in cut.items() if i is not None} == cut_text(named.items())
    hits = hits_brute([(i, text) for i, text in cut.items()], [(1, spark.read.parquet(f"{corpus}/benchmark.parquet").where("item_id = 1").first().text)])
    assert set(clean) == {i for i, x in hits.items() if not x[3]} and len(clean) < len(cut)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for row in results[5].collect():
        ids = library.encode(clean[row.doc_id] or "", add_special_tokens=False).ids
        assert list(memoryview(bytes(row.ids)).cast("I")) == ids and row.n_tokens == len(ids)
        assert row.decoded == library.decode(ids, skip_special_tokens=False)
    run = corpus_pipeline.run(spark, corpus)
    assert sorted(map(str, run.collect())) == sorted(map(str, results[5].collect()))


def test_stages_of_empty_tables(spark, corpus, tmp_path):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
        assert docs.count() == 0, name


@pytest.mark.parametrize("name", [name for name in queries.QUERIES if name != "op12_conversation_trie"])  # rows are nodes
def test_query_has_a_row_for_each_row(spark, data_dir, name):
    df = queries.QUERIES[name](spark, data_dir)
    source = {"op2_near_vectors": "embeddings", "op11_centroids": "embeddings", "op10_main_text": "pages"}.get(name, "documents")
    assert df.count() == spark.read.parquet(f"{data_dir}/{source}.parquet").count()
    assert df.where(F.col(df.columns[0]).isNull()).count() == 0
