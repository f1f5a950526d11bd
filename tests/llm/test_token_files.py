"""Token files: order, offsets and checksums against a plain loop, and their indexes."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardlight.llm import token_files
from wardlight.llm.queries import LLM_QUERIES

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(docs):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_query_equals_plain_loop(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, LLM_QUERIES["op5_token_files"](spark, SMALL).collect()), key=str) == plain(docs)


def test_edge_rows(make):
    docs = [(3, "b"), (3, "a"), (3, "a"), (-1, None), (0, ""), (None, "n"), (9, "long " * 30000)]
    got = token_files.token_table(make([(*d, 1) for d in docs], "doc_id long, text string, part int"), PATH, 2).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs)
    assert token_files.token_table(make([]), PATH, 2).count() == 0


def test_files_hold_ranges_and_indexes(spark, tmp_path):
    orc = pytest.importorskip("pyarrow.orc")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    token_files.write_token_files(docs, f"{tmp_path}/t", PATH, 2, row_index_stride=1000)
    last = None
    for path in sorted((tmp_path / "t").glob("*.orc")):
        ids = orc.ORCFile(path).read(columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and (last is None or not ids or last < ids[0])
        last = ids[-1] if ids else last
        assert b"BLOOM" in path.read_bytes() or orc.ORCFile(path).nstripes >= 1
    one = token_files.read_token_files(spark, f"{tmp_path}/t").filter("doc_id = 17")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in one._jdf.queryExecution().toString() and one.count() == 1
