"""Byte-level BPE: exact encoding by longest matches with backtracking, and decoding.

The bytes of a piece are read as Latin-1 characters, so one automaton (pyahocorasick) over all tokens
finds the longest token at a position.  A sequence of tokens is the BPE encoding exactly if every two
neighbours are what BPE makes of their joined bytes; that test is memoised per token pair.  The encoder
walks over a piece with longest matches, shortens a token that does not suit its left neighbour, and
steps back when no prefix is left.  A position given up is never entered again, so a piece takes linear
time however long it is.

The vocabulary is one file of a few hundred KB (its size is checked); it is read by the driver and
broadcast, so executors need no copy of it.

Defined cases: a null text counts as empty; an empty text has no ids; repeated rows and null ids are
encoded like any other row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import load, prepare, trimmed, worker_state

MAX_VOCABULARY_BYTES = 64 << 20   # broadcast bound
# Memo sizes of one worker.  Pieces are kept in two generations of this size: when the young one is full it
# becomes the old one, so frequent pieces stay; a full pair memo starts anew.
MEMO_PIECES, MEMO_PAIRS = 120_000, 200_000
LONG_TEXT = 1 << 20   # texts above this many characters are split into pieces lazily


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Rank file: one ``base64(token) rank`` line per token."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Encoder:
    """Exact byte pair encoder over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import ahocorasick
        import regex

        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.window = max(map(len, ranks), default=1)
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.split: dict[int, tuple[int, int]] = {}

    def parts_of(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token`` (a single byte: itself twice)."""
        parts = self.split.get(token)
        if parts is None:
            data = self.token[token]
            pieces = [data[i:i + 1] for i in range(len(data))]
            while len(pieces) > 2:   # merge the neighbours of lowest rank, leftmost first
                at = min(range(len(pieces) - 1), key=lambda i: self.ranks.get(pieces[i] + pieces[i + 1], 1 << 60))
                pieces[at:at + 2] = [pieces[at] + pieces[at + 1]]
            parts = (token, token) if len(pieces) < 2 else (self.ranks[pieces[0]], self.ranks[pieces[1]])
            self.split[token] = parts
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE keeps the border between two neighbouring tokens.

        The tokens are taken apart in the reverse order of their merges; the border goes if, at some moment,
        the two parts that touch it would have been merged before the merge that is being undone.
        """
        pair = (left, right)
        known = self.fits.get(pair)
        if known is not None:
            return known
        token, ranks, split = self.token, self.ranks, self.parts_of
        before, known = 1 << 60, True
        while True:
            joined = ranks.get(token[left] + token[right])
            if joined is not None and joined < before:
                known = False
                break
            # Undo the later of the two merges; a part that is a single byte can't be undone.
            undo_left = left > right
            if len(token[left if undo_left else right]) == 1:
                undo_left = not undo_left
                if len(token[left if undo_left else right]) == 1:
                    break
            if undo_left:
                before, left = left, split(left)[1]
            else:   # the merge on the right came after an equal one on the left
                before, right = right + 1, split(right)[0]
        if len(self.fits) >= MEMO_PAIRS:
            self.fits.clear()
        self.fits[pair] = known
        return known

    def next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self.shorter:
            data = self.token[token]
            self.shorter[token] = next((self.ranks[data[:k]] for k in range(len(data) - 1, 0, -1)
                                        if data[:k] in self.ranks), None)
        return self.shorter[token]

    def longest(self, chars: str, at: int) -> int:
        """The longest token at a position (every byte is a token, so there is one)."""
        return next(self.automaton.iter_long(chars[at:at + self.window]))[1]

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        chars, size = piece.decode("latin-1"), len(piece)
        open_at = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at = 0
        token = self.longest(chars, 0)
        while True:
            end = at + len(self.token[token])
            if open_at[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == size:
                    return out
                token = self.longest(chars, at)
                continue
            prefix = self.next_shorter(token)
            if prefix is not None:
                token = prefix
            else:
                open_at[at] = 0
                token = out.pop()
                at -= len(self.token[token])

    def _packed(self, piece: str) -> bytes:
        packed = self.old_pieces.get(piece)
        if packed is None:
            ids = self.encode_piece(piece.encode("utf-8"))
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self.pieces[piece] = packed
        return packed

    def _pack_all(self, pieces: list[str]) -> bytes:
        if len(self.pieces) >= MEMO_PIECES:
            self.old_pieces, self.pieces = self.pieces, {}
        known, packed = self.pieces.get, self._packed
        return b"".join([known(p) or packed(p) for p in pieces])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if len(text) <= LONG_TEXT:
            return self._pack_all(self.pattern.findall(text))
        found, out = self.pattern.finditer(text), []
        while block := [m.group() for m in islice(found, 100_000)]:
            out.append(self._pack_all(block))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return decode_ids(self.token, ids)


def decode_ids(token: dict[int, bytes], ids: bytes) -> bytes:
    """The bytes that packed ids stand for."""
    import numpy as np

    return b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoder(data: bytes, pattern: str) -> Encoder:
    """The encoder of this worker process."""
    return worker_state(("byte_bpe", hash(data), len(data), pattern), lambda: Encoder(parse_ranks(data), pattern))


def _vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary {path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id",
           decoded: bool = False) -> DataFrame:
    """``(doc_id, ids)`` per row; ``ids`` holds the token ids as little-endian unsigned 32-bit integers.

    With ``decoded`` a third column holds the bytes that :func:`decode_ids` makes of the ids, in the same pass.
    """
    prepare(docs.sparkSession)
    vocabulary = _vocabulary(docs.sparkSession, path)
    names = ["doc_id", "ids", "decoded"] if decoded else ["doc_id", "ids"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = _encoder(vocabulary.value, pattern)
        for batch in batches:
            ids = [encoder.encode(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([encoder.decode(i) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, ids binary" + (", decoded binary" if decoded else "")
    return rows.mapInArrow(lambda batches: trimmed(run(batches)), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: the bytes that stored ids stand for."""
    vocabulary = _vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        data = vocabulary.value
        token = worker_state(("byte_bpe tokens", hash(data), len(data)),
                             lambda: {rank: token for token, rank in parse_ranks(data).items()})
        for batch in batches:
            out = pa.array([decode_ids(token, i.as_py()) for i in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: trimmed(run(batches)), "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """Encode and decode every document; one row of digests per document."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return encode(docs, path, pattern, decoded=True).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "documents"))


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
