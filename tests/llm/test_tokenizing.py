import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm.tokenizing import LONG, PATTERN, VOCABULARY, byte_pairs, count_tokens, encode_texts



def own_tables():
    with open(VOCABULARY, "rb") as f:
        return byte_pairs(f.read())


pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
ODD = ["", "a" * (LONG * 5), " " * 700 + "x", "<|endoftext|> hi", "\n\n \t", "don't WE'LL 're", "日本語" * 200, "é" * 400, "🙂🙃" * 120, "x  ", "\x00\x01", "ab" * 300]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_odd_texts(library):
    assert own_tables().encode(ODD) == [library.encode_ordinary(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=120), max_size=12))
def test_any_texts(library, texts):
    assert own_tables().encode(texts) == [library.encode_ordinary(t) for t in texts]


def test_rows_of_their_own_and_matrix_agree():
    tables = own_tables()
    for t in ("internationalisation", "aaaaaaaabaaaa", "Überraschung", "aaa", "ab", "x"):
        assert tuple(tables.merge_long(t.encode())) == tables.merge_pieces([t])[t]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aabcdeinrst"), min_size=1, max_size=400), st.sampled_from("ab"))
def test_long_pieces(library, text, letter):
    for t in (text, text * 3, letter * len(text) + text):
        assert own_tables().merge_long(t.encode()) == library.encode_ordinary(t)


def test_very_long_piece(library):
    import random

    random.seed(1)
    t = "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=60_000))
    assert own_tables().merge_long(t.encode()) == library.encode_ordinary(t)


def test_frame(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 6), (3, "", 7), (1, "hello world", 5), (None, "a", 1)], "doc_id long, text string, ids int")
    rows = encode_texts(df, "doc_id", "text").collect()
    assert len(rows) == 5 and [r.ids for r in rows if r.doc_id in (2, 3)] == [[], []]
    assert sum(r.n_tokens for r in count_tokens(df, ["doc_id", "ids"], "text").collect()) == 5
    assert encode_texts(df.where("doc_id = 99"), "doc_id", "text").count() == 0
