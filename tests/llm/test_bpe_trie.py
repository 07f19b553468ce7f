import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from postprism.llm import bpe_trie
from tests.llm.conftest import prose

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return bpe_trie.Encoder(file.read())


ODD = [
    "",
    " ",
    "\t\r\n\x0b\x0c\x85\xa0 　",
    "it's we'll I'VE 'd's ''s",
    "x<|endoftext|>y <|startoftext|><|endoftext|> <|EndOfText|> <|endoftext",
    "\x00\x1c\x1d a\x1fb",
    "ΑΣ ΣΑΣ İstanbul ﬁ ǅ ẞ",
    "é ́e ọ̈ Å `",
    "日本語のテキスト 한국어 العربية हिन्दी ไทย",
    "🙂👩‍👩‍👧 ½²³ Ⅷ ٣ 12345 3.14",
    "!!!??? --- *** a*b_c__d $$$%%%",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "antidisestablishmentarianism supercalifragilisticexpialidocious",
    "</w> the</w> <w>",
]


def test_equals_the_library(encoder):
    pick = random.Random(4)
    made = ["".join(pick.choice("abcdefghijklmnopqrstuvwxyzéß'0!. ") for _ in range(pick.randrange(60))) for _ in range(3_000)]
    texts = ODD + made + [prose(i, 50) for i in range(20)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        expected = LIBRARY.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected, text
        assert encoder.decode(ids) == LIBRARY.decode(expected, skip_special_tokens=False)


def test_trie_equals_plain_merges(encoder):
    pick, vocabulary = random.Random(8), encoder.vocabulary
    pieces = {bytes(pick.choice(b"theinganders") for _ in range(pick.randrange(1, 25))) for _ in range(4_000)}
    pieces |= {bytes(pick.randrange(256) for _ in range(pick.randrange(1, 9))) for _ in range(500)}
    found = vocabulary.encode_pieces(pieces)
    assert found == {piece: tuple(vocabulary.merged(piece, True)) for piece in pieces}


def test_a_full_cache_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(bpe_trie, "_CACHED", 10)
    monkeypatch.setattr(bpe_trie, "_INSERTED", 3)
    texts = [prose(i, 30) for i in range(12)]
    for text in texts:
        assert encoder.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_rows(spark, odd_docs, no_docs):
    out = bpe_trie.digests(bpe_trie.encode_and_decode(odd_docs, PATH), "doc_id", "ids").collect()
    expected = sorted(str((row.doc_id, LIBRARY.encode(row.text or "", add_special_tokens=False).ids)) for row in odd_docs.collect())
    assert sorted(str((row.doc_id, row.ids)) for row in out) == expected
    empty = next(row for row in out if row.doc_id == 3)
    assert (empty.n_tokens, empty.ids_sha256, empty.decoded_sha256) == (0, *[hashlib.sha256(b"").hexdigest()] * 2)
    assert bpe_trie.encode_and_decode(no_docs, PATH).count() == 0
