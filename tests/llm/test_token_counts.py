import json
import random

import public_tokenizers
from newsloom.llm import token_counts as T
from tokenizers import Tokenizer

from .fixtures import empty, messy

PATH = public_tokenizers.path("word_bpe_49k.json")


def _data():
    with open(PATH, "rb") as f:
        return f.read()


def _library():
    return Tokenizer.from_file(PATH)


def _same(counter, library, texts):
    for t in texts:
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t[:80])


def test_same_counts_as_the_library():
    data = _data()
    counter, library = T.Counter(data, T.prove(data)), _library()
    random.seed(11)
    parts = ["a", "B", "the", " ", "  ", "ing", "é", "ß", "\n", "'s", "'LL", "'", "0", "9", "!", "=", "-", "日本", "\t", "\x1c", "\x85",
             " ", "AB", "tion", "😀", "́", "İ", "Σ", "ς", "ŉ", "½", "_", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "\x00", "​"]
    _same(counter, library, ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(4000)])
    _same(counter, library, ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(1, 120))) for _ in range(500)])
    _same(counter, library, ["a" * 5000, "ab" * 3000, " " * 4000, "-" * 5001, "xyzzy" * 1000, "é" * 999, "1" * 300])
    _same(counter, library, ["a" + chr(c) + "b " + chr(c) + chr(c) + "1" + chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000])


def test_proven_words_are_those_that_the_library_encodes_as_one():
    data = _data()
    whole, library = set(T.prove(data)["whole"]), _library()
    words = T.Merges(json.loads(data)["model"]).words
    for word in words:
        alone = library.encode(word, add_special_tokens=False).ids == [words[word]]
        assert (word in whole) == (alone and T.pieces_by_library(library, word) == [word]), word
    assert len(whole) > 20_000


def test_slices_of_long_texts(monkeypatch):
    data = _data()
    counter, library = T.Counter(data, T.prove(data)), _library()
    text = "Some words, and é more <|endoftext|> words 123! " * 400
    monkeypatch.setattr(T, "SLICE", 10)
    _same(counter, library, [text, "x" * 100, "x" * 100 + " "])


def test_memo_generations(monkeypatch):
    data = _data()
    monkeypatch.setattr(T, "MEMO_PIECES", 3)
    counter, library = T.Counter(data, T.prove(data)), _library()
    _same(counter, library, ["thndinth oningon blendre ourehat " * 3, "blendre zzqj thndinth"] * 4)
    assert len(counter.young) <= 3 and len(counter.old) <= 3


def test_rows(spark):
    library, df = _library(), messy(spark)
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect()]
    got = [tuple(r) for r in T.count_tokens(df, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(spark):
    assert T.count_tokens(empty(spark), PATH).collect() == []


def test_given_documents(spark):
    library = _library()
    rows = {r.doc_id: r for r in T.op11_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n = len(library.encode(d.text or "", add_special_tokens=False).ids)
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].over_limit) == (n, n > T.LIMIT)
