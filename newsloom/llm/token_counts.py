"""Token counts by the whole-token shortcut, for a word-piece BPE vocabulary file (``.json`` of ``tokenizers``).

Once per vocabulary, before any document is read, the driver proves which vocabulary strings encode alone as
one token: the string is left as it is by the normaliser, the pre-tokeniser keeps it in one piece, and the
merges of its own bytes end in that single token.  In a document every pre-token found in that proven set
counts one without any merge; only the rest is merged, and the lengths of those are memoised.

Texts whose characters all lie below U+0250 are normalised and split by Python; the driver takes the character
classes (letter, digit, blank, other) and the lower case from the tokenizer file's own normaliser and
pre-tokeniser, character by character.  All other texts pass through that normaliser and pre-tokeniser
themselves.  Strings of special tokens in a text count one each, as the library takes them by default.

The vocabulary (a few MB, size checked) is read by the driver and broadcast.

Defined cases: a null text counts as empty; an empty text has no tokens; repeated rows and null ids are counted
like any other row; an empty table gives an empty result; other columns are ignored; texts of any length are
read whole (long ones in slices that end at a blank, which is a border for every step).
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import load, prepare, trimmed, worker_state

MAX_VOCABULARY_BYTES = 64 << 20   # broadcast bound
LIMIT = 2048                      # tokens above which a document is marked over_limit
MEMO_PIECES = 150_000             # merged pre-tokens remembered by a worker, in two generations
SLICE = 1 << 20                   # characters of a text handled at once
PLAIN_END = 0x250                 # characters below need no composition; each is checked by the driver
SHORT = 48                        # symbols up to which pairs are scanned instead of queued


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}


class Merges:
    """Number of tokens of one pre-token, by ordered merges."""

    def __init__(self, model: dict) -> None:
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("a plain BPE model is needed")
        vocabulary = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        alphabet = _byte_alphabet()
        self.inner = [vocabulary[alphabet[b]] for b in range(256)]
        self.last = [vocabulary[alphabet[b] + end] for b in range(256)]
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rules.setdefault((vocabulary[left], vocabulary[right]), (rank, vocabulary[left + right]))
        of_char = {c: b for b, c in alphabet.items()}
        self.words: dict[str, int] = {}   # what a token that ends a word spells
        for token, number in vocabulary.items():
            if token.endswith(end) and len(token) > len(end):
                try:
                    spelled = bytes(of_char[c] for c in token[:len(token) - len(end)]).decode("utf-8")
                except (KeyError, UnicodeDecodeError):
                    continue   # not a whole string of its own
                self.words[spelled] = number

    def tokens(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        return self._scan(ids) if len(ids) <= SHORT else self._queue(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        rules = self.rules.get
        while len(ids) > 1:
            best, at = None, 0
            for k in range(len(ids) - 1):
                rule = rules((ids[k], ids[k + 1]))
                if rule is not None and (best is None or rule < best):
                    best, at = rule, k
            if best is None:
                break
            ids[at:at + 2] = [best[1]]
        return ids

    def _queue(self, ids: list[int]) -> list[int]:
        """The same merges for a long pre-token: a queue of pairs over a linked list."""
        rules, size = self.rules.get, len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        queue = [(rule[0], k, ids[k], ids[k + 1], rule[1]) for k in range(size - 1)
                 if (rule := rules((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, k, left, right, merged = heapq.heappop(queue)
            n = after[k]
            if ids[k] != left or n >= size or ids[n] != right:
                continue   # one side was merged since
            ids[k], ids[n] = merged, -1
            after[k] = after[n]
            if after[n] < size:
                before[after[n]] = k
            for a in (before[k], k):
                b = after[a] if a >= 0 else size
                if a >= 0 and b < size and (rule := rules((ids[a], ids[b]))) is not None:
                    heapq.heappush(queue, (rule[0], a, ids[a], ids[b], rule[1]))
        return [i for i in ids if i >= 0]


def _library(data: bytes):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(data.decode("utf-8"))


def pieces_by_library(tokenizer, text: str) -> list[str]:
    """Normalised pre-tokens of a text, by the file's own steps."""
    normal = tokenizer.normalizer.normalize_str(text)
    return [normal[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(normal)]


def prove(data: bytes) -> dict:
    """What the driver finds out about a vocabulary file: proven words, plain characters, special strings."""
    tokenizer, spec = _library(data), json.loads(data)
    special = []
    for token in spec.get("added_tokens") or []:
        if token["normalized"] or token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError("special tokens are taken as they are written")
        special.append(token["content"])
    merges = Merges(spec["model"])
    whole = sorted(word for word, number in merges.words.items()
                   if pieces_by_library(tokenizer, word) == [word] and merges.tokens(word) == [number])
    kinds: dict[str, list[str]] = {"letter": [], "digit": [], "other": []}
    lower, plain = {}, []
    for c in map(chr, range(PLAIN_END)):
        normal = tokenizer.normalizer.normalize_str(c)
        if not normal.strip() or normal.isspace():
            blank = pieces_by_library(tokenizer, "a" + c + "a") == ["a", "a"]
            if blank and c.isspace():
                plain.append(c)
                continue
        if len(normal) != 1 or tokenizer.normalizer.normalize_str(normal) != normal:
            continue
        doubled, after = pieces_by_library(tokenizer, c + c), pieces_by_library(tokenizer, "a" + c)
        if after == ["a" + normal]:
            kind = "letter"
        elif doubled == [normal, normal]:
            kind = "digit"
        elif doubled == [normal + normal] and after == ["a", normal]:
            kind = "other"
        else:
            continue
        kinds[kind].append(normal)
        plain.append(c)
        if normal != c:
            lower[ord(c)] = normal
    return {"whole": whole, "plain": "".join(plain), "lower": lower, "special": special,
            **{k: "".join(sorted(set(v))) for k, v in kinds.items()}}


def _ranges(chars: str) -> str:
    return "".join(f"\\U{ord(c):08x}" for c in chars)


class Counter:
    """Counts tokens of texts in one worker."""

    def __init__(self, data: bytes, proven: dict) -> None:
        self.data, self.tokenizer = data, None
        self.merges = Merges(json.loads(data)["model"])
        self.whole = frozenset(proven["whole"])
        self.lower = proven["lower"]
        self.strange = re.compile(f"[^{_ranges(proven['plain'])}]")
        # The classes of the file's pre-tokeniser, with the endings it cuts off first.
        self.split = re.compile("'s|'t|'re|'ve|'m|'ll|'d|" f"[{_ranges(proven['letter'])}]+|[{_ranges(proven['digit'])}]|"
                                f"[{_ranges(proven['other'])}]+").findall
        special = sorted(proven["special"], key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        if self.strange.search(text) is None:
            return self.split(text.translate(self.lower))
        if self.tokenizer is None:
            self.tokenizer = _library(self.data)
        return pieces_by_library(self.tokenizer, text)

    def _rest(self, piece: str) -> int:
        n = self.young.get(piece)
        if n is None:
            n = self.old.get(piece)
            if n is None:
                n = len(self.merges.tokens(piece))
            if len(piece) <= 64:
                if len(self.young) >= MEMO_PIECES:
                    self.old, self.young = self.young, {}
                self.young[piece] = n
        return n

    def _plain_count(self, text: str) -> int:
        whole, rest = self.whole, self._rest
        return sum([1 if p in whole else rest(p) for p in self.pieces(text)])

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE:
            end = text.find(" ", at + SLICE)
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:] if at else text

    def count(self, text: str) -> int:
        found, parts = 0, [text]
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            found = len(parts) - 1
        return found + sum(self._plain_count(s) for part in parts for s in self._slices(part))


def _counter(data: bytes, proven: dict) -> Counter:
    """The counter of this worker process."""
    return worker_state(("token_counts", hash(data), len(data)), lambda: Counter(data, proven))


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` per row for the vocabulary file at ``path``."""
    spark = docs.sparkSession
    prepare(spark)
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary {path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    shared = spark.sparkContext.broadcast((data, prove(data)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = _counter(*shared.value)
        for batch in batches:
            counts = pa.array([counter.count(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(lambda batches: trimmed(run(batches)), "doc_id long, n_bytes long, n_tokens long")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op11_token_counts": op11_token_counts}
