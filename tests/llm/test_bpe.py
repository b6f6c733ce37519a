import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import bpe

if not os.path.exists(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"):
    pytest.skip("the vocabularies are not here", allow_module_level=True)
RANKS = bpe.load_ranks()
ENCODER = bpe.Encoder(RANKS)
BYTES = {v: k for k, v in RANKS.items()}


tiktoken = pytest.importorskip("tiktoken")
OTHER = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text("ab \n'stve1", max_size=60))
def test_as_another_encoder_and_back(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = ENCODER.encode(text)
    assert ids == OTHER.encode_ordinary(text)
    assert b"".join(BYTES[i] for i in ids).decode() == text


def test_long_pieces_and_special_strings():
    for text in ("a" * 20_000, "ab" * 3000 + "é" * 500, "<|endoftext|><|im_start|>", " " * 3000, "1" * 2000):
        assert ENCODER.encode(text) == OTHER.encode_ordinary(text)


def test_operator(spark):
    rows = [(1, "Hello world", 5), (2, None, 5), (3, "", 5), (None, "x", 5), (5, "x" * 100_000, 5), (1, "Hello world", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id or 0, len(r.ids)) for r in bpe.encode(df, df.doc_id, df.text).collect()))
    assert [g for g in got if g[0] < 5] == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0)] and got[-1][1] > 10
    assert bpe.encode(df.limit(0), df.doc_id, df.text).count() == 0


def test_the_same_name_in_another_folder_is_another_vocabulary(spark, tmp_path):
    import base64

    (tmp_path / "byte_bpe_50k.tiktoken").write_bytes(b"".join(base64.b64encode(bytes([k])) + f" {255 - k}\n".encode() for k in range(256)))
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string").coalesce(1)
    one = bpe.encode(df, df.doc_id, df.text).first().ids
    two = bpe.encode(df, df.doc_id, df.text, folder=str(tmp_path)).first().ids
    assert two == [255 - 97, 255 - 98] and one != two and bpe.encode(df, df.doc_id, df.text).first().ids == one
