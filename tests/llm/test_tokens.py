"""Token ids of whole texts against the tokenizer's own encoding."""

from __future__ import annotations

import random
from functools import lru_cache

import pytest
from tokenizers import Tokenizer

from skyloom.llm.tokens import count_texts, count_tokens, decode_ids, encode_corpus, encode_texts, tokenizer_path
from skyloom.session import local_session

PATH = tokenizer_path()


@lru_cache(maxsize=1)
def _tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _whole(text):
    return _tokenizer().encode(text, add_special_tokens=False).ids if text else []


@pytest.mark.parametrize("leaf", [8, 17, 64])
def test_the_tree_gives_the_ids_of_the_whole_text(leaf):
    draw = random.Random(leaf)
    parts = ["Satellite111 ", "it's ", "we're", "  ", "\n\n", "卫星过境", "ﬁne", "é̈", "12345", "!!!", "\t", "<|endoftext|>", "a" * 40, " ", "🛰️", "'", "s'll"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 200))) for _ in range(60)]
    texts += [" " * 500, "a" * 500, "'re" * 200, "\n" * 300, "1" * 400, "don't" * 100, "", None]
    found = encode_texts(texts, PATH, leaf)
    assert found == [_whole(t) for t in texts]
    assert [decode_ids(ids, PATH) for ids in found] == [t or "" for t in texts]


def test_the_quick_encoder_gives_the_same_ids():
    from skyloom.llm.tokens import _quick

    assert _quick(PATH) is not None and _quick(PATH.replace("byte_bpe_50k", "word_bpe_49k")) is None
    draw = random.Random(1)
    texts = ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(0x4E00, 0x9FFF), draw.randrange(0xA0, 0x2FF), draw.randrange(0x1F300, 0x1F6FF), 32, 10, 39, 9, 0x3000, 0x85])) for _ in range(draw.randrange(300))) for _ in range(300)]
    assert encode_texts(texts, PATH) == [_whole(t) for t in texts] and count_texts(texts, PATH) == [len(_whole(t)) for t in texts]


def test_most_texts_of_the_tree_are_longer_than_a_leaf_in_a_table_too():
    spark = local_session(4, 4)
    rows = [(1, None, "x"), (2, "", "x"), (3, " ", None), (4, "pass " * 3000, "x"), (4, "pass " * 3000, "x"), (None, "it's 5 卫星", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = sorted(((r["doc_id"] or 0), list(r["ids"])) for r in encode_corpus(table, "doc_id", "text", leaf_chars=16).collect())
    assert found == sorted(((k or 0), _whole(t)) for k, t, _ in rows)
    assert sorted(r["n_tokens"] for r in count_tokens(table, ["doc_id"], "text").collect()) == sorted(len(_whole(t)) for _, t, _ in rows)
    assert encode_corpus(table.limit(0), "doc_id", "text").collect() == []
