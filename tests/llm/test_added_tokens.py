from __future__ import annotations

import zlib

import numpy as np
import pytest

import corpus_pipeline
from pageweave.llm import queries as q
from pageweave.llm.word_bpe import WordEncoder

TEXTS = ["one <|endoftext|> two", "<|startoftext|>É<|endoftext|><|endoftext|>", "a<|EndOfText|>b <|endoftext|", "<|endoftext|>", "plain Words, one.", "", None]


@pytest.fixture(scope="module")
def want():
    """Ids by the library with its defaults."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.tokenizer_file("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def test_added_tokens_are_found_in_texts(want):
    got = WordEncoder(q.tokenizer_file("word_bpe_49k.json")).encode(TEXTS)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert want[0] == [637, 49407, 1237]


def test_queries_find_added_tokens(spark, tmp_path, want):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for end, rows in (
        (2, q.op8_shortest_pack_first(spark, str(tmp_path)).collect()),
        (2, corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()),
        (1, q.op10_grammar_ids(spark, str(tmp_path)).collect()),
    ):
        crcs = {r["doc_id"]: r["ids_crc32"] for r in rows}
        assert crcs == {k: zlib.crc32(np.array([*x, end], "<u4").tobytes()) for k, x in enumerate(want)}
