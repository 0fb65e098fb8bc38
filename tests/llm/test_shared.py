"""Names that clash, memory that goes back, and passages in many rows."""

import random

import numpy as np
import pytest

import corpus_pipeline
from scopelens.llm import blocks, decontaminate, memory, repeats, token_files, word_bpe
from scopelens.llm.tables import free_name
from tests.llm.conftest import rows_of

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, strings int, _id int, own_id int, spans string, kept_bytes string, n_bytes int, _found int, found string, row string, _toxic int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "l", "s", len(t or ""), 1, 2, 3, "sp", "k", 4, 5, "f", "r", 6) for i, t in rows], CLASHING)


def test_free_name(spark):
    assert free_name(spark.createDataFrame([], "a int, A_ int"), "a") == "a__"


def test_repeats_with_clashing_columns(spark, prose):
    passage = prose(40, 1)
    docs = clashing(spark, [(1, passage), (2, f"first {passage}")])
    kept = repeats.without_repeats(docs)
    out = {row["doc_id"]: row for row in kept.collect()}
    assert out[2]["strings"] == 1 and out[2]["_id"] == 2 and out[2]["own_id"] == 3 and out[2]["row"] == "r"
    assert bytes(out[2]["kept_bytes"]) == b"first " and out[1]["spans"] == []


def test_decontamination_with_clashing_columns(spark, prose):
    passage = prose(12, 1)
    docs = clashing(spark, [(1, passage), (2, prose(12, 2))])
    benchmark = spark.createDataFrame([(5, passage)], "item_id long, text string")
    out = {row["doc_id"]: row for row in decontaminate.find(docs, benchmark).collect()}
    assert out[1]["items"] == [5] and out[1]["_found"] == 5 and out[1]["found"] == "f" and out[2]["items"] == []
    clean = decontaminate.clean(docs, benchmark)
    assert clean.columns == docs.columns and [tuple(r) for r in clean.collect()] == [tuple(r) for r in docs.where("doc_id = 2").collect()]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_clashing_columns(spark, data_dir, prose, name):
    passage = prose(60, 1)
    docs = clashing(spark, [(1, passage), (2, f"more {passage}"), (3, prose(30, 5)), (None, passage), (5, None), (6, "")])
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, data_dir)
    if name != "encode":
        assert out.columns == docs.columns
        rows = {row["doc_id"]: row for row in out.collect()}
        assert rows[3]["spans"] == "sp" and rows[3]["kept_bytes"] == "k" and rows[3]["_toxic"] == 6
        if name == "repeats":
            assert rows[2]["text"] == "more " and rows[2]["n_chars"] == 5 and rows[2]["row"] == "r"
    else:
        assert out.count() == 6
        assert corpus_pipeline.encode(spark, docs.drop("lang", "source"), data_dir).count() == 6


def test_a_passage_in_a_third_of_all_rows(spark, prose):
    """One string of 80 bytes with other bytes around it in each row is no repeat; of 100 bytes it is one."""
    source = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    middle = "".join(source.choice(letters) for _ in range(80))
    whole = middle + "".join(source.choice(letters) for _ in range(20))

    def around(part):
        return "".join(source.choice(letters) for _ in range(60)) + part + "".join(source.choice(letters) for _ in range(60))

    rows = [(k, around(middle)) for k in range(200)] + [(1000 + k, around(whole)) for k in range(200)] + [(2000 + k, prose(20, k)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = rows_of(repeats.digest(repeats.without_repeats(docs)), "doc_id", "n_removed")
    assert all(removed[k] == (0,) for k in range(200))
    assert removed[1000] == (0,) and all(100 <= removed[1000 + k][0] < 106 for k in range(1, 200))


def test_tasks_give_memory_back():
    up, _ = blocks._powers(1 << 19)
    assert len(up) == 1 << 19 and up[3] == up[1] * up[2]
    shorter, _ = blocks._powers(1000)
    assert shorter is up  # one table serves all sizes
    import public_tokenizers

    word_bpe._loaded(public_tokenizers.path("word_bpe_49k.json"))
    done = list(memory.tidy(lambda batches: (x + 1 for x in batches))([1, 2]))
    assert done == [2, 3]
    assert len(blocks._tables[0]) == 1 and word_bpe._loaded.cache_info().currsize == 0

    def fails(batches):
        raise ValueError

        yield

    blocks._powers(10)
    with pytest.raises(ValueError):
        list(memory.tidy(fails)([]))
    assert len(blocks._tables[0]) == 1
    assert np.array_equal(blocks.Hashes(np.arange(9, dtype=np.uint8)).of(np.array([1]), np.array([5])), blocks.Hashes(np.arange(1, 9, dtype=np.uint8)).of(np.array([0]), np.array([4])))


def test_words_are_told_apart_only_where_the_vocabulary_does():
    import public_tokenizers

    bpe = token_files.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe.splits
    texts = ["Some words, and some  words.", "Größe 日本 <|endoftext|> x", ""]
    expected = [bpe.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [x.tolist() for x in bpe.encode(texts, 2)] == expected
    bpe.splits = False
    assert [x.tolist() for x in bpe.encode(texts, 2)] == expected


def test_words_of_latin_characters_go_to_the_model_alone():
    import public_tokenizers

    bpe = token_files.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    library, seen = bpe.tokenizer, []

    class Watched:
        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return library.encode_batch_fast(texts, **options)

    bpe.tokenizer = Watched()
    bytes_ = "".join(map(chr, range(256)))
    texts = ["Größe, 3²\xa0 m  and\n\n it's \xad done ", bytes_, bytes_[::-1], " ".join(bytes_), "日本 words", ""]
    expected = [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [x.tolist() for x in bpe.encode(texts, 2)] == expected
    assert seen == ["日本"]


def test_a_vocabulary_that_cuts_texts_encodes_them_whole(tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.enable_truncation(3)
    library.save(str(tmp_path / "cut.json"))
    texts = ["one two three four five", "one"]
    expected = [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [x.tolist() for x in token_files.ByteBpe(str(tmp_path / "cut.json")).encode(texts, 2)] == expected


def test_new_words_go_to_the_model_at_once():
    import public_tokenizers

    bpe = token_files.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    model, calls = bpe.model, []

    class Watched:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(model, name)

    bpe.model = Watched()
    texts = ["some new words, and others", "\n\nGröße  it's 12 words\n", "new words and words"]
    expected = [bpe.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [x.tolist() for x in bpe.encode(texts, 2)] == expected
    assert [x.tolist() for x in bpe.encode(texts, 2)] == expected
    assert len(calls) == 1


@pytest.mark.parametrize("kind", ["BPE", "WordLevel", "prefix"])
def test_a_vocabulary_whose_tokens_do_not_spell_words_encodes_them_whole(tmp_path, kind):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        spec = json.load(file)
    letters = [x for x in spec["model"]["vocab"] if len(x) == 1]
    if kind == "BPE":  # a byte is missing
        spec["model"] |= {"merges": [], "vocab": {x: k for k, x in enumerate(x for x in letters if x != "q")}}
    elif kind == "WordLevel":
        spec["model"] = {"type": "WordLevel", "vocab": {x: k for k, x in enumerate([*letters, "<unknown>", "Ġquite"])}, "unk_token": "<unknown>"}
    else:
        spec["model"] |= {"merges": [], "vocab": {x: k for k, x in enumerate([*letters, *("##" + x for x in letters)])}, "continuing_subword_prefix": "##"}
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    library, texts = Tokenizer.from_file(str(tmp_path / "other.json")), ["a quite quiet equal", "q", ""]
    expected = [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [x.tolist() for x in token_files.ByteBpe(str(tmp_path / "other.json")).encode(texts, 2)] == expected


def test_new_words_are_encoded_in_blocks(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_files, "BLOCK_WORDS", 2)
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    bpe = token_files.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    for texts in (["one two three four five", "日本 two"], ["five six"], ["one six 日本 seven"], ["", "two"]):
        expected = [bpe.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert [x.tolist() for x in bpe.encode(texts, 2)] == expected
