import hashlib
import random
import struct

import public_tokenizers
import tiktoken
from newsloom.llm import byte_bpe as B

from .fixtures import empty, messy

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _ranks():
    with open(PATH, "rb") as f:
        return B.parse_ranks(f.read())


def _oracle():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_ranks(), special_tokens={})


def _ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_same_ids_as_the_library():
    mine, theirs = B.Encoder(_ranks(), PATTERN), _oracle()
    random.seed(5)
    parts = ["a", "b", "the", " ", "  ", "ing", "é", "ß", "\n", "'s", "'ll", "0", "9", "!", "=", "-", "日本", "\t", "\x1c", "\u00a0", "AB",
             "tion", "😀", "\u0301", "<|endoftext|>", "\x00"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(1, 120))) for _ in range(800)]
    texts += ["a" * 5000, "ab" * 3000, " " * 4000, "-" * 5001, "xyzzy" * 1000]
    texts += ["a" + chr(c) + "b " + chr(c) + "1" for c in range(0, 0x3000) if not 0xD800 <= c < 0xE000]
    for t in texts:
        packed = mine.encode(t)
        assert _ids(packed) == theirs.encode_ordinary(t), repr(t[:80])
        assert mine.decode(packed) == t.encode()


def test_lazy_split_of_long_texts(monkeypatch):
    mine = B.Encoder(_ranks(), PATTERN)
    text = "Some words, and more words 123! " * 500
    whole = mine.encode(text)
    monkeypatch.setattr(B, "LONG_TEXT", 10)
    assert mine.encode(text) == whole


def test_digests(spark):
    theirs = _oracle()
    df = messy(spark)
    want = []
    for r in df.collect():
        ids = theirs.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [tuple(r) for r in B.round_trip(df).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(spark):
    assert B.round_trip(empty(spark)).collect() == []
