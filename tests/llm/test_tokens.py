"""Token counts against the library."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from daypanel.llm import tokens
from daypanel.llm.queries import op13_token_counts
from daypanel.sources.tables import load


@pytest.fixture(scope="module")
def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model_path):
    return SentencePieceProcessor(model_file=model_path)


ODD = [
    "", " ", "   ", "a", " a ", "a  b   c", "\n", "a\n\nb", "\t", "▁", "▁▁ ▁x", "<s> </s> <unk> <0x0A>", "…—“漢字” ÉÈ é", "a\0b",
    "don't 123,456.78 https://x.y/z?q=1", "x" * 5000, "ab " * 3000, " " * 1000, "🙂🙂 é", "​﻿ ", "#" * 999,
]


@pytest.mark.parametrize("text", ODD)
def test_pieces_of_the_parts_are_those_of_the_text(model_path, library, text):
    cutter = tokens.cutter(model_path)
    words = cutter.cut(text)
    assert "".join(words) == ("▁" + text.replace(" ", "▁") if text else "")
    assert sum(map(cutter.pieces, words)) == len(library.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abehortzABC 0129.,'\"-\n\t▁<>/sé漢—")), max_size=60))
def test_any_text_falls_apart_rightly(text):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    cutter = tokens.cutter(path)
    assert sum(map(cutter.pieces, cutter.cut(text))) == len(cutter.model.encode(text))


def test_a_text_is_cut_alike_in_segments(model_path, monkeypatch):
    text = "One two-three, four.\n" * 30 + "aaaa" * 40
    whole = tokens.cutter(model_path).cut(text)
    monkeypatch.setattr(tokens, "SEGMENT", 7)
    assert tokens.cutter(model_path).cut(text) == whole


def expected(rows, library):
    out = []
    for key, text in rows:
        n = len(library.encode(text or ""))
        out.append((key, len((text or "").encode()), n, n > 4096))
    return sorted(out, key=str)


@pytest.mark.parametrize(("words", "size"), [(1 << 18, 1 << 24), (5, 1 << 24), (1 << 18, 40), (0, 0)])
def test_whatever_the_table_holds(spark, odd_docs, model_path, library, words, size):
    odd = odd_docs.withColumnRenamed("key", "a.b").withColumnRenamed("chunk", "words")
    got = tokens.count_tokens(odd, model_path, table_words=words, table_bytes=size)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, library)


def test_empty_table_and_odd_names(spark, odd_docs, model_path):
    odd = odd_docs.withColumnRenamed("doc_id", "a.b").withColumnRenamed("text", "row")
    assert tokens.count_tokens(odd.filter("1 = 0"), model_path, "a.b", "row").collect() == []
    got = tokens.count_tokens(odd, model_path, "a.b", "row")
    assert got.count() == odd.count()
    assert got.columns[0] == "a.b"


def test_counts_are_whole(spark, odd_docs, model_path):
    table = tokens.piece_counts(tokens.pretoken_counts(odd_docs, model_path), model_path)
    total = table.selectExpr("sum(n * pieces) AS n").first()["n"]
    assert total == tokens.count_tokens(odd_docs, model_path).selectExpr("sum(n_tokens) AS n").first()["n"]
    assert table.count() == table.select("word").distinct().count()


def test_query_is_the_library(spark, small, library):
    rows = [(r["doc_id"], r["text"]) for r in load(spark, small, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op13_token_counts(spark, small).collect()), key=str) == expected(rows, library)


def test_models_that_fold_characters_are_refused(monkeypatch, model_path):
    import sentencepiece

    class Folding(sentencepiece.SentencePieceProcessor):
        def normalize(self, text, with_offsets=None):
            return "▁" + text.lower()

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Folding)
    with pytest.raises(ValueError, match="normaliser"):
        tokens.Cutter(model_path)
