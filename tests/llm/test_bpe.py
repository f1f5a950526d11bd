"""Encoding against the tokenizers library, decoding against the texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wardlight.llm import bpe, token_files
from wardlight.llm.parts import PartTable
from wardlight.llm.queries import LLM_QUERIES

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "   ", "a", "a  b", "a \n b", "\n\n x\t\ty ", "it's we'll I'd 'tis ''s", "<|endoftext|>", "x <|endoftext|> y\n <|endoftext|>z  ",
    "日本語 текст ñandú 😀😀 é", "a\x1cb \x1c c d   e", "1234567 12 ½ Ⅷ ²", "!!!??? --- ...", "\r\n\r\n", "a\0b \0 c", "l1\nl2\n\nl3\n", "\nl", "x.\n.y\n!z it's?\n's", "é.é!\né", "x.\ny z.\n w\nv\n\nu ²3 a²3\n1", "It. it, It.. a1. é, '., .", "é" * 300, "ab" * 3000, " " * 2000 + "x",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def noise(seed):
    rng = random.Random(seed)
    pool = "abcdeT 's\n\t  .,!09é日😀 　\x85<|endoftext|>"
    return "".join(rng.choice(pool) for _ in range(rng.randint(0, 120)))


@pytest.mark.parametrize("make_encoder", [bpe.BytePairs, token_files.LibraryEncoder])
def test_ids_are_the_librarys(library, make_encoder):
    encoder = make_encoder(PATH)

    def encode(text):
        if make_encoder is bpe.BytePairs:
            return encoder.encode(text)
        ids, counts = encoder.encode_column(pa.array(["some other", text, None]), [2])
        assert counts.sum() == len(ids) and ids[-1] == 2 and counts[2] == 1
        return ids[counts[0] : counts[0] + counts[1] - 1].tobytes()

    for text in [*ODD, *map(noise, range(400))]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == want, text
        if make_encoder is bpe.BytePairs:
            assert encoder.decode(encoder.encode(text)) == library.decode(want, skip_special_tokens=False) == text


def test_part_table_forgets_old_generations():
    table, asked = PartTable(2), []

    def encode(parts):
        asked.extend(parts)
        return [p.encode() for p in parts]

    for part in ("a", "b", "a", "c", "d", "b", "x" * 100, "x" * 100):
        assert table.look_up([part, part], encode) == [part.encode()] * 2
    assert len(table.young) <= 2 and asked.count("x" * 100) == 2


def test_known_parts_survive_a_full_table(library):
    encoder = token_files.LibraryEncoder(PATH)
    encoder.known.limit = 40
    for seed in range(30):
        texts = [noise(seed * 7 + k).replace(" ", " w") for k in range(5)]
        ids, counts = encoder.encode_column(pa.array(texts), [])
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_broken_bytes_decode_to_replacements():
    pairs = bpe.BytePairs(PATH)
    assert pairs.decode(np.array([pairs.byte_id[0xFF]], "<u4").tobytes()) == "�"


def test_round_trip_query_matches_the_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = LLM_QUERIES["op4_bpe"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_edge_rows(make):
    docs = make([(1, None, 9), (2, "", 9), (3, "a b", 9), (3, "a b", 9), (None, "z" * 50000, 9)], "doc_id long, text string, n_tokens int")
    rows = bpe.round_trip(docs, PATH).collect()
    assert sorted((r.n_tokens for r in rows if r.doc_id is not None)) == [0, 0, 2, 2]
    assert len(rows) == 5 and bpe.round_trip(make([]), PATH).count() == 0


def test_columns_encode_and_decode(make):
    docs = make([(1, "hello there"), (2, None)])
    out = docs.withColumn("ids", bpe.encode_column(docs.text, PATH))
    back = out.withColumn("back", bpe.decode_column(out.ids, PATH)).orderBy("doc_id").collect()
    assert back[0].back == "hello there" and back[1].back == ""


def test_a_part_that_is_one_piece_is_looked_up_once():
    pairs, asked = bpe.BytePairs(PATH), []
    look_up = pairs.parts.look_up
    pairs.parts.look_up = lambda parts, encode: asked.append(list(parts)) or look_up(parts, encode)
    pairs.encode("plain words here, and")
    assert asked == [["plain", " words", " here,", " and"], [" here", ","]]
