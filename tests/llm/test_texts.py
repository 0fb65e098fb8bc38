"""Operators on single texts, against brute force, the tokenizers library, round trips and held-out accuracy."""

import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scopelens.llm import decontaminate, language, main_text, quality, token_files, toxicity, word_bpe
from scopelens.llm.blocks import Hashes, blocks, windows
from tests.llm.conftest import rows_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


@given(st.lists(st.one_of(st.none(), st.text(max_size=9)), max_size=6), st.integers(1, 20))
@settings(max_examples=60, deadline=None)
def test_blocks_hold_all_texts(texts, limit):
    found = [block.text(row).decode() for block in blocks(pa.array(texts, pa.string()), limit) for row in range(len(block))]
    assert found == [text or "" for text in texts]


def test_hashes_of_equal_bytes_are_equal():
    data = np.frombuffer(b"abcabdabc", np.uint8)
    one, two, three = Hashes(data).of(np.array([0, 6, 3]), np.array([3, 9, 6])).tolist()
    assert one == two != three
    assert len(windows(np.arange(3, dtype=np.uint64), 5)) == 0


def hits_brute(rows, items, size=10):
    tests = {}
    for item, text in items:
        found = words(text)
        length = min(size, len(found))
        for k in range(len(found) - length + 1 if found else 0):
            tests.setdefault(tuple(found[k : k + length]), set()).add(item)
    out = {}
    for i, text in rows:
        found, hit, ids = words(text), set(), set()
        for length in {len(w) for w in tests}:
            for k in range(len(found) - length + 1):
                if known := tests.get(tuple(found[k : k + length])):
                    ids |= known
                    hit |= set(range(k, k + length))
        out[i] = (len(found), len(hit), sorted(ids), bool(hit))
    return out


@pytest.mark.parametrize("set_bytes", [decontaminate.SET_BYTES, 150])
def test_decontaminate(spark, documents, prose, set_bytes):
    items = [(k, prose(14, 500 + k)) for k in range(6)] + [(20, "Only three words"), (21, ""), (22, None), (23, prose(14, 500)), (100, "été fini")]
    rows = [(k, f"{prose(12, k)}, {items[k % 6][1].upper()[: 30 + 9 * k]}! {prose(5, 90 + k)}") for k in range(12)]
    rows += [(50, None), (51, ""), (52, "so ONLY-three_words here"), (53, prose(8000, 3) + " " + items[2][1]), (54, "Été fini."), (55, "only three")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    found = decontaminate.find(documents(*rows), benchmark, set_bytes=set_bytes)
    expected = hits_brute(rows, items)
    got = {r.doc_id: (r.n_words, sum(s.last - s.first for s in r.spans), list(r["items"]), bool(r.spans)) for r in found.collect()}
    assert got == expected
    digest = decontaminate.digest(found)
    assert digest.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    clean = decontaminate.clean(documents(*rows), benchmark, set_bytes=set_bytes)
    assert set(rows_of(clean, "doc_id", "text")) == {i for i, x in expected.items() if not x[3]}
    empty = decontaminate.find(documents(*rows), benchmark.limit(0))
    assert all(not r.spans and not r["items"] for r in empty.collect())


@pytest.fixture(scope="module")
def word_path():
    return public_tokenizers.path("word_bpe_49k.json")


def odd_texts(count=400):
    source = random.Random(3)
    pool = [chr(c) for c in range(0x180)] + list("ΣσςİẞΑ中😀́̈\u0085  　​﻿") + list(" 'sltrem") * 8
    texts = ["".join(source.choice(pool) for _ in range(source.randrange(50))) for _ in range(count)]
    return texts + [None, "", "don't I'LL", "<|endoftext|>a'Sb <|startoftext|>", "a" * 2000, "!?" * 300, "ΟΔΟΣ ΟΔΟΣ"]


def test_word_bpe_is_the_library(word_path):
    library, own = Tokenizer.from_file(word_path), word_bpe.WordBpe(word_path)
    texts = odd_texts()
    ids = own.encode(pa.array(texts, pa.string()))
    expected = [library.encode(text or "", add_special_tokens=False).ids for text in texts]
    assert [list(memoryview(x).cast("I")) for x in ids.to_pylist()] == expected
    assert own.decode(ids).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in expected]


def test_word_bpe_forgets(word_path, monkeypatch):
    monkeypatch.setattr(word_bpe, "REMEMBERED", 5)
    own = word_bpe.WordBpe(word_path)
    texts = ["some words here", "other words there and here", "some words"] * 3
    assert [own.encode_block([text])[0] for text in texts] == word_bpe.WordBpe(word_path).encode_block(texts)


def test_word_bpe_columns(documents, word_path):
    both = documents((1, "a b"), (2, None)).select("doc_id", word_bpe.coded(word_path).alias("c")).select("doc_id", "c.*")
    assert rows_of(both, "doc_id", "decoded") == {1: ("a</w> b</w>",), 2: ("",)}
    found = documents((1, "a b"), (2, None)).withColumn("ids", word_bpe.encoded(word_path)).withColumn("back", word_bpe.decoded(word_path))
    assert rows_of(found, "doc_id", "back") == {1: ("a</w> b</w>",), 2: ("",)}


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_planes_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert token_files.from_planes(token_files.planes(ids), len(ids)).tolist() == ids.tolist()


def test_byte_bpe_is_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_files.ByteBpe(path)
    texts = [text or "" for text in odd_texts()] + ["".join(c for c in text or "" if ord(c) < 256) for text in odd_texts()]
    assert [x.tolist() for x in own.encode(texts, 2)] == [library.encode(text, add_special_tokens=False).ids + [2] for text in texts]


BYTE_BPE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), token_files.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))


@given(st.lists(st.text("'sStmdrevl ab3²½éß\n\t\r\x85\xa0\x1c\0!_\u3000\u2028’“日本０🙂\u0301\uffff", max_size=25), max_size=6))
@settings(max_examples=300, deadline=None)
def test_byte_bpe_splits_texts_as_the_library(texts):
    library, own = BYTE_BPE
    assert [x.tolist() for x in own.encode(texts, 2)] == [library.encode(text, add_special_tokens=False).ids + [2] for text in texts]


def test_token_files(spark, documents, prose, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 64)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(k * 3 % 41, prose(k * 7 % 90, k)) for k in range(41)] + [(100, None), (101, ""), (102, prose(3000, 1)), (103, "x"), (103, "a")]
    files = token_files.write(documents(*rows, (None, "no id")), str(tmp_path), path)
    found = token_files.digest(token_files.read(files, str(tmp_path))).orderBy("start").collect()
    library, start, expected = Tokenizer.from_file(path), 0, []
    for i, text in sorted(rows, key=lambda row: (row[0], row[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert [tuple(row) for row in found] == expected
    assert token_files.read(token_files.write(documents(), str(tmp_path / "none"), path), str(tmp_path / "none")).count() == 0
    broken = tmp_path / "broken"
    broken.write_bytes(b"BITP1")
    with pytest.raises(ValueError), fs.LocalFileSystem().open_input_file(str(broken)) as file:
        token_files.Reader(file)


def labelled(spark, prose):
    source = random.Random(4)
    rows, labels = [], []
    for k in range(240):
        toxic = k % 4 == 0
        text = prose(source.randrange(20, 60), k).split()
        if toxic:
            text[source.randrange(len(text))] = source.choice(["zwugg", "brixxo"])
        rows.append((k, " ".join(text)))
        labels.append((k, int(not toxic), int(toxic)))
    return rows, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark, documents, prose):
    rows, labels = labelled(spark, prose)
    df = documents(*rows, (500, None), (501, ""), (502, prose(5000, 7)), (503, prose(30, 7) + " zwugg"))
    train = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1
    model = toxicity.fit(df.where(train), labels.where(train))
    scores = {r.doc_id: r.p for r in df.withColumn("p", toxicity.score(model)).collect()}
    assert all(0 <= p <= 1 for p in scores.values()) and scores[500] == scores[501]
    held = [(k % 4 == 0, scores[k] >= 0.5) for k in range(1, 240, 3)]
    assert sum(a == b for a, b in held) / len(held) > 0.95 and scores[503] > 0.5


def test_classifiers_without_training_rows(spark, documents):
    df, none = documents((1, "a"), (2, None)), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        scored = df.withColumn("p", module.score(module.fit(df, none)))
        assert rows_of(scored, "doc_id", "p") == {1: (0.5,), 2: (0.5,)}
        assert module.fit(documents(), none) is not None
    assert language.fit(documents()).languages == []


def test_quality_held_out(spark, documents, prose):
    source, rows, labels = random.Random(5), [], []
    for k in range(300):
        good = k % 3 != 0
        text = prose(source.randrange(30, 80), k)
        rows.append((k, text if good else re.sub(r"(\w+)", r"\1!!", text.upper())))
        labels.append((k, int(good), 0))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = documents(*rows, (500, None), (501, ""))
    model = quality.fit(df.where("doc_id % 4 <> 1"), labels.where("doc_id % 4 <> 1"))
    scores = {r.doc_id: r.p for r in df.withColumn("p", quality.score(model)).collect()}
    held = [((k % 3 != 0), scores[k] >= 0.5) for k in range(1, 300, 4)]
    assert sum(a == b for a, b in held) / len(held) > 0.95 and scores[500] == scores[501]


def test_the_risk_covers_all_unlabelled_text(spark, prose):
    """Sums of tasks over counted bins are the sums over all rows, whatever the sample a fit starts from."""
    rows = [(prose(source, source),) for source in range(2, 60)] + [(prose(9, 1),)] * 30 + [(None,), ("",)]
    measures = quality._rows(spark.createDataFrame(rows, "text string").mapInArrow(quality._sampled, "measures array<double>"))
    edges = np.quantile(measures, quality.SPREAD, axis=0).T
    frame = spark.createDataFrame([(x.tolist(),) for x in measures], "measures array<double>")
    binned = frame.mapInArrow(quality._in_bins(edges), "bins binary").groupBy("bins").agg(F.count("*").alias("times"))
    model = quality.Model(edges, np.random.default_rng(3).normal(size=(len(quality.SHAPES), quality.BINS)), 0.2)
    found = quality._pass(binned, lambda parts, times: quality._sums(parts, times, model), 2 * quality.WIDTH + 4)
    f = model.weights[np.arange(len(quality.SHAPES)), model.bins(measures)].sum(1) + model.bias
    s = 1 / (1 + np.exp(-f))
    assert found[-1] == len(rows) and found[-2] == pytest.approx(np.logaddexp(0, f).sum())
    assert found[quality.WIDTH] == pytest.approx(s.sum()) and found[2 * quality.WIDTH + 1] == pytest.approx((s * (1 - s)).sum())
    slope = np.zeros((len(quality.SHAPES), quality.BINS))
    for row, own in zip(model.bins(measures), s, strict=True):
        slope[np.arange(len(row)), row] += own
    assert found[: quality.WIDTH] == pytest.approx(slope.ravel())
    scores = np.sort(model.scores(measures[:20]))
    above = quality._pass(binned, quality._above(model, scores), len(scores) + 1)
    assert above.tolist() == [*((model.scores(measures) >= x).sum() for x in scores), len(rows)]


def test_the_prior_comes_from_positives_and_unlabelled_text():
    source = np.random.default_rng(4)
    positives, unlabelled = np.sort(source.normal(4, 1, 4000)), np.concatenate([source.normal(4, 1, 3000), source.normal(-4, 1, 7000)])
    above = np.array([(unlabelled >= x).mean() for x in positives])
    assert quality.estimated_prior(positives, above) == pytest.approx(0.3, abs=0.02)


def test_the_risk_never_turns_negative_into_overfit():
    source = np.random.default_rng(1)
    positive, negative = source.normal(1, 1, (400, len(quality.SHAPES))), source.normal(-1, 1, (300, len(quality.SHAPES)))
    model = quality.fit_weights(positive[:200], np.concatenate([positive[200:], negative[:200]]), 0.5)
    assert (model.scores(negative[200:]) < 0.5).mean() > 0.9


def test_language(spark, documents):
    source = random.Random(6)
    syllables = {"aa": ["ka", "ko", "ku", "ki"], "bb": ["str", "mpf", "gra", "sch"], "cc": ["é", "ñu", "ça", "ö"]}
    rows = [(k, lang, " ".join("".join(source.choices(syllables[lang], k=3)) for _ in range(20))) for k, lang in enumerate(list(syllables) * 30)]
    df = spark.createDataFrame([*rows, (200, None, "x"), (201, "aa", None)], "doc_id long, lang string, text string")
    model = language.fit(df.where("doc_id % 5 <> 0"))
    new = [(300, None), (301, ""), (302, "12 ²³ --"), (303, "kakakakaku"), (304, "STRSTRstr"), (305, "ñuñuñué"), (306, rows[0][2] * 300)]
    found = documents(*new, *[(k, text) for k, _, text in rows]).withColumn("found", language.predicted(model)).select("doc_id", "found.*")
    got = rows_of(found, "doc_id", "lang_pred", "score")
    assert [got[k] for k in (300, 301, 302)] == [("und", 0.0)] * 3
    assert [got[k][0] for k in (303, 304, 305, 306)] == ["aa", "bb", "cc", "aa"]
    assert all(got[k][0] == lang for k, lang, _ in rows) and all(0 <= score <= 1 for _, score in got.values())


def test_language_of_words_kept_for_one_language_counts_in_all(spark):
    """A word beyond the cutoff in the large language, or met once there, keeps its count of it."""
    texts = [("aa", "common " * 1000 + "rare rare rare once"), ("bb", "rare rare once once")]
    df = spark.createDataFrame(texts, "lang string, text string")
    model = language.fit(df, words=3)
    for word, counted in (("rare", (3, 2)), ("once", (1, 2))):
        expected = [np.log((count + 0.5) / (total + 1)) for count, total in zip(counted, (1004, 4))]
        assert model.word_scores[model.words[word]].tolist() == pytest.approx(expected, rel=1e-5)


SENTENCE = "The quick fox is in the house and it was a good day for all of us, as they say in the old books of the town."


def test_main_text_drops_what_is_no_article():
    page = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head>
    <body class="has-sidebar"><header><a href=/>Home</a> Site name</header><nav><ul><li><a href=/a>A</a></ul></nav>
    <div id="cookieNotice"><p>{SENTENCE}</p></div><form><label>{SENTENCE}</label><input></form>
    <article><header><h1>A &amp; B&nbsp;&#8212; title</h1></header><p>{SENTENCE}</p><p>Short<br>one.
    <p>x &lt; y</p><!-- <p>gone</p> --><div class="share-buttons"><a>Share</a></div><ul><li><a>link one</a><li><a>link two</a></ul>
    <aside>{SENTENCE}</aside><section class="comments"><p>{SENTENCE}</p></section></article>
    <div class=sidebar><p>{SENTENCE}</p></div><footer>(c) {SENTENCE}</footer></body></html>"""
    assert main_text.main_text(page) == f"A & B — title\n\n{SENTENCE}\n\nShort one.\n\nx < y"


def test_main_text_by_densities_without_an_article():
    page = f"""<body><div>Menu <a>one</a> <a>two</a> <a>three</a></div><div><h2>Title</h2><p>{SENTENCE}</p><p>So it goes.</p>
    <p>{SENTENCE}</p></div><div><a>a link of the site</a> | <a>another link of the site that is long enough to be decided</a></div>"""
    assert main_text.main_text(page) == f"Title\n\n{SENTENCE}\n\nSo it goes.\n\n{SENTENCE}"


@given(st.one_of(st.none(), st.text(alphabet="<>/!-ab \"'=&;pdiv\n", max_size=120)))
@settings(max_examples=200, deadline=None)
def test_main_text_of_anything(page):
    assert isinstance(main_text.main_text(page), str)


def test_main_text_column(spark):
    df = spark.createDataFrame([(1, f"<article><p>{SENTENCE}"), (2, None), (3, ""), (4, "<p>" + "word and the " * 40_000)], "page_id long, html string")
    got = rows_of(df.withColumn("text", main_text.extracted()), "page_id", "text")
    assert got[1] == (SENTENCE,) and got[2] == got[3] == ("",) and len(got[4][0]) == 13 * 40_000 - 1


PARAGRAPH = "This is the text of a long paragraph that has many of the words that are so common in prose, and it goes on for a while so that it is decided. "


def test_main_text_keeps_a_body_outside_of_a_teaser():
    body = [f"{k} {PARAGRAPH * 2}".strip() for k in range(6)]
    page = "<html><body><div>" + "".join(f"<p>{x}</p>" for x in body) + f"</div><article><h3>More</h3><p>{PARAGRAPH}</p></article></body></html>"
    found = main_text.main_text(page)
    assert all(x in found for x in body)


@pytest.mark.parametrize("name", ["search-result", "cookie-article", "alert-level-story", "headerContent"])
def test_main_text_keeps_paragraphs_of_named_content(name):
    page = f"<article><p>{PARAGRAPH}</p><div class='{name}'><p>Second. {PARAGRAPH}</p></div><div class='cookie-notice'><p>Third. {PARAGRAPH}</p></div></article>"
    found = main_text.main_text(page)
    assert "Second." in found and "Third." not in found
    for dropped in ("post-comments", "comment-body", "article-footer", "main-nav", "content-sidebar"):
        assert "Second." not in main_text.main_text(page.replace(name, dropped))


def test_main_text_of_empty_tables_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert spark.createDataFrame([], schema).select("page_id", main_text.extracted().alias("text")).count() == 0
    row = (1, "u", f"<p>{PARAGRAPH}</p>", "other", 7)
    found = spark.createDataFrame([row, row, (2, None, None, None, None)], schema).withColumn("text", main_text.extracted()).collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in found] == [(1, PARAGRAPH.strip(), 7), (1, PARAGRAPH.strip(), 7), (2, "", None)]
