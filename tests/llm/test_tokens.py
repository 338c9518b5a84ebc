import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.FOLDER), reason="no vocabulary files")


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    path = os.path.join(T.FOLDER, "byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return T.Encoder(os.path.join(T.FOLDER, "byte_bpe_50k.json")), tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "\n\n \t x", "<|endoftext|> stays text", "I'll we've DON'T don’t", "a" * 5000, "abab" * 900 + "c", "日本語のテキスト" * 50, "👩‍💻⚽ é à ﬁ", "x" + " " * 700, "==== ---- ....\r\n", "1234567890" * 40]


def test_hard_texts(pair):
    for t in TEXTS:
        assert pair[0].encode(t) == pair[1].encode_ordinary(t)
        assert pair[1].decode(pair[0].encode(t)) == t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdefghtheinou AB'.,-=\n0123é日", max_size=80))
def test_any_text(pair, text):
    assert pair[0].encode(text) == pair[1].encode_ordinary(text)


def test_table(spark, pair):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (None, " a", "x"), (1, "hello world", "x")]
    got = T.encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    want = sorted((str(i), pair[1].encode_ordinary(t or "")) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == want
    assert T.encode_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
