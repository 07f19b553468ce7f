import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postprism.llm import token_files
from postprism.llm.wavelet import WaveletMatrix, from_bytes, to_bytes
from postprism.session import work_folder
from tests.llm.conftest import prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("size,bits", [(0, 4), (1, 1), (511, 3), (512, 16), (5_000, 16), (3_000, 20)])
def test_wavelet_matrix(size, bits):
    pick = np.random.default_rng(size)
    tokens = pick.integers(0, 1 << bits, size) // np.where(pick.random(size) < 0.5, 1, 1 << max(0, bits - 3))
    matrix, sections = from_bytes(to_bytes(WaveletMatrix.build(tokens, bits), {"more": np.arange(3)}))
    assert matrix.tokens().tolist() == tokens.tolist() and sections["more"].tolist() == [0, 1, 2]
    if size:
        places = pick.integers(0, size, 200)
        assert matrix.access(places).tolist() == tokens[places].tolist()
    for token in {*tokens[:5].tolist(), 0, (1 << bits) - 1, 1 << bits}:
        for begin, end in ((0, size), (size // 3, size // 2)):
            expected = begin + np.flatnonzero(tokens[begin:end] == token)
            assert matrix.count(token, begin, end) == len(expected)
            assert matrix.places(token, begin, end).tolist() == expected.tolist()


def check(spark, docs, file_bytes):
    library = Tokenizer.from_file(PATH)
    folder = work_folder(spark, "tokens")
    files = token_files.write_token_files(docs, PATH, folder, file_bytes=file_bytes)
    out = token_files.read_token_files(files, folder).orderBy("start").collect()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows.sort(key=lambda row: (row.doc_id is not None, row.doc_id or 0, row.h))
    at = 0
    assert len(out) == len(rows)
    for got, row in zip(out, rows, strict=True):
        ids = np.array([*library.encode(row.text, add_special_tokens=False).ids, 1], "<u4")
        assert (got.doc_id, got.start, zlib.crc32(bytes(got.ids))) == (row.doc_id, at, zlib.crc32(ids.tobytes()))
        at += len(ids)
    return files


def test_files_read_back(spark, odd_docs):
    check(spark, odd_docs, 16 << 20)
    many = odd_docs.select("doc_id", "text").union(
        spark.createDataFrame([(i, prose(i, 200)) for i in range(20, 90)], "doc_id long, text string")
    )
    assert check(spark, many, 20_000).count() > 3


def test_long_ranges_are_cut_and_strays_do_not_count(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(token_files, "_FILE_TOKENS", 500)
    folder = work_folder(spark, "tokens")
    files = token_files.write_token_files(odd_docs, PATH, folder)
    before = token_files.read_token_files(files, folder).count()
    token_files.write_token_files(odd_docs, PATH, folder)  # files of another attempt beside them
    assert token_files.read_token_files(files, folder).count() == before == odd_docs.count()


def test_no_rows(spark, no_docs):
    folder = work_folder(spark, "tokens")
    assert token_files.read_token_files(token_files.write_token_files(no_docs, PATH, folder), folder).count() == 0
