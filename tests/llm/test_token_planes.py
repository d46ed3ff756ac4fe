import json
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from furrow.llm import token_planes
from furrow.llm.token_planes import Layout
from tests.llm.helpers import AWKWARD, SF, documents, write_tables

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=200), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(ids, planes):
    layout = Layout(planes=planes)
    packed = token_planes.to_planes(np.array(ids, "<u4"), layout, zstandard.ZstdCompressor().compress)
    back = token_planes.from_planes(packed, len(ids), layout, zstandard.ZstdDecompressor().decompress)
    assert back.tolist() == ids


@pytest.mark.parametrize("layout", [Layout(block_ids=64, chunk_ids=200), Layout(planes="bit", block_ids=100, chunk_ids=1)])
def test_awkward_rows(spark, tmp_path, layout):
    path = str(tmp_path / "ids")
    token_planes.write(documents(spark, AWKWARD).withColumnRenamed("lang", "part"), path, PATH, layout=layout)
    got = [tuple(r) for r in token_planes.read_documents(spark, path, layout).orderBy("start").collect()]
    assert got == expected(AWKWARD)
    whole = token_planes.read_documents(spark, path, layout, with_ids=True).where("doc_id = 9").collect()
    assert [len(r["ids"]) for r in whole] == [r["n_tokens"] for r in whole]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_planes.write(documents(spark, []), path, PATH)
    assert token_planes.read_documents(spark, path).count() == 0


def test_query_against_plain_encoding(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in token_planes.op1(spark, SF).orderBy("start").collect()]
    assert got == expected(rows)


ADDED = ["a <|endoftext|> b<|endoftext|>", "x  <|endoftext|>  y", "<|endoftext|>", "<|endoftext|><|endoftext|> two", "<|endoftext| > not", "one <|endoftext|>\n\n 'll go", " <|endoftext|> "]


def test_query_encodes_added_tokens_as_the_library(spark, tmp_path):
    rows = [*AWKWARD, *((20 + i, t) for i, t in enumerate(ADDED))]
    tokenizer = Tokenizer.from_file(PATH)
    want, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_planes.op1(spark, write_tables(spark, tmp_path, documents=documents(spark, rows)))
    assert [tuple(r) for r in got.orderBy("start").collect()] == want


@pytest.mark.parametrize("flag", [None, "lstrip", "rstrip", "single_word"])
def test_added_tokens_of_any_kind(tmp_path, flag):
    with open(PATH, encoding="utf-8") as file:
        stated = json.load(file)
    if flag:
        stated["added_tokens"][0][flag] = True
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(stated), encoding="utf-8")
    tokenizer = Tokenizer.from_file(str(path))
    texts = [*ADDED, "word<|endoftext|>word"]
    got = token_planes.library_encoder(str(path), True)(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
