import base64
import hashlib

import tiktoken

import public_tokenizers
from furrow.llm import bpe_segments
from furrow.llm.pieces import pieces
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.helpers import AWKWARD, SF, documents

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = st.text(alphabet=st.sampled_from(list("abethn  \n\t\r\x1c\x85\xa0　'sdl019½éßñ中ひ🙂.,!?")), max_size=80)


def row(key, text):
    ids = LIBRARY.encode_ordinary(text or "")
    return key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode_bytes(ids)).hexdigest()


@settings(deadline=None)
@given(TEXTS)
def test_pieces_join_to_the_text(text):
    assert " ".join(pieces(text)) == text


@settings(deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_equals_the_library(texts):
    vocabulary, encode = bpe_segments.encoder(PATH, public_tokenizers.PATTERN)
    for text, raw in zip(texts, encode(texts)):
        ids = bpe_segments.np.frombuffer(raw, "<u4").tolist()
        assert ids == LIBRARY.encode_ordinary(text)
        assert bpe_segments.decode(ids, vocabulary) == text.encode()


def test_long_pieces():
    vocabulary, _ = bpe_segments.encoder(PATH, public_tokenizers.PATTERN)
    for raw in (b"ab" * 3000, b"the" * 100, b"\xc3\xa9" * 700, bytes(range(256)) * 4):
        alone = bpe_segments.merge_one(raw, vocabulary)
        assert b"".join(vocabulary.bytes_of[i] for i in alone) == raw
        assert alone == bpe_segments.merge_rows([raw], vocabulary)[0].tolist()


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD).withColumnRenamed("source", "ids_sha256")
    got = bpe_segments.encode(docs, PATH, public_tokenizers.PATTERN, keep=("doc_id",)).collect()
    assert sorted(map(repr, (tuple(r)[:4] for r in got))) == sorted(map(repr, (row(*r) for r in AWKWARD)))
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)
    assert bpe_segments.encode(documents(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_against_the_library(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, bpe_segments.op4(spark, SF).collect())) == sorted(row(*r) for r in rows)
