"""Language ID with a linear-chain conditional random field over words.

Every word gets a language from its affixes, its character n-grams and a learned lexicon, and learned
transitions tie neighbouring words, so code-switched text is labelled word by word with
forward-backward posteriors.  A document's prediction is the language with the largest posterior share
of its words; the share is the score.

Training uses a bounded, hash-picked sample of labelled rows (``SAMPLE_DOCS`` over all languages), and of each
``SNIPPETS`` snippets spread evenly over its whole text: snippets of documents of different languages are strung
together, so the transitions see switches as well as runs.  The fit is deterministic.  Inference reads every word
of every text as one chain.  For speed the chain is worked on in segments of ``SEGMENT`` words side by side: the
product of a segment's matrices carries the messages over it, so every segment gets the exact messages from the
words before and behind it, and its length changes nothing.

Defined cases: a null text or a text without a letter gets ``und`` with score 0; without any labelled row
every text gets ``und``; ties go to the language that sorts first; a null id is never held out; repeated
rows are predicted like any other; of rows that share an id and a language the smallest snippets train;
other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import load, prepare, trimmed, worker_state

SAMPLE_DOCS = 480     # labelled rows fetched for training, over all languages (at least 8 of each)
SNIPPETS, SNIPPET_WORDS = 12, 20   # snippets of each of them, spread over the whole text, and their length
MAX_FEATURES = 60_000  # most frequent features of the sample
LEXICON_WORDS = 8_000  # most frequent words of the sample
SEGMENT = 256          # words worked on side by side
MEMO_WORDS = 100_000   # words whose emission scores a worker remembers
SLICE_ROWS = 1_000     # texts labelled at once
UNKNOWN = "und"


def word_features(word: str) -> list[str]:
    """Affixes (marked by ^ and $, up to three letters) and character n-grams of one to three letters."""
    s = f"^{word}$"
    n = len(s)
    grams = [s[i:i + k] for k in (2, 3) for i in range(n - k + 1)]
    return [*word, *grams, s[:4], s[-4:], f" {word}"]


@dataclass
class Model:
    langs: list[str]
    index: dict[str, int]       # feature -> row of weights; lexicon entries start with a blank
    weights: np.ndarray         # features x languages
    transitions: np.ndarray     # from x to
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        get = self.index.get
        rows, sizes = [], []
        for w in words:
            found = [i for f in word_features(w) if (i := get(f)) is not None]
            rows.extend(found)
            sizes.append(len(found))
        return _sum_rows(self.weights, np.array(rows, np.int64), np.array(sizes))


def _sum_rows(weights: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sizes), weights.shape[1]))
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        out[full] = np.add.reduceat(weights[rows], starts, axis=0)
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray,
                     entry: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of padded chains and expected transition counts.

    ``scores`` is chains x steps x labels (log space), chains sorted by falling length.  A chain that is a part
    of a longer one has the message from the words before it in ``entry`` (in place of ``start``) and the one from
    the words behind it in ``leave``.
    """
    n, steps, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    t = np.exp(transitions - transitions.max())
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    if leave is not None:
        beta[np.arange(n), lengths - 1] = leave
    active = [int(np.searchsorted(-lengths, -s, side="left")) for s in range(steps + 1)]   # chains longer than s
    a = e[:, 0] * (np.exp(start - start.max()) if entry is None else entry)
    alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
    for s in range(1, steps):
        m = active[s]
        a = (alpha[:m, s - 1] @ t) * e[:m, s]
        alpha[:m, s] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((k, k))
    for s in range(steps - 2, -1, -1):
        m = active[s + 1]
        right = e[:m, s + 1] * beta[:m, s + 1]
        b = right @ t.T
        joint = alpha[:m, s]
        norm = (joint * b).sum(axis=1, keepdims=True)
        pairs += (joint / norm).T @ right * t
        beta[:m, s] = b / b.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    total = gamma.sum(axis=2, keepdims=True)
    gamma /= np.where(total > 0, total, 1)
    gamma[np.arange(steps)[None, :] >= lengths[:, None]] = 0
    return gamma, pairs


def segment_products(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """What each padded chain does to a message that enters at its first word: chains x labels x labels, scaled."""
    n, steps, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    t = np.exp(transitions - transitions.max())
    out = np.eye(k)[None] * e[:, 0][:, None, :]
    for s in range(1, steps):
        m = int(np.searchsorted(-lengths, -s, side="left"))
        p = (out[:m] @ t) * e[:m, s][:, None, :]
        out[:m] = p / p.max(axis=(1, 2), keepdims=True)
    return out


def fit(samples: list[tuple[str, list[str]]], rounds: int = 40, rate: float = 0.3, decay: float = 1e-4) -> Model | None:
    """Fit the field on ``(language, words)`` samples by full-batch gradient steps (Adam)."""
    langs = sorted({lang for lang, words in samples if words})
    if not langs:
        return None
    rng = np.random.default_rng(7)
    k = len(langs)
    label = {lang: i for i, lang in enumerate(langs)}
    # Chains of snippets from documents of all languages.
    snippets = []
    for lang, words in samples:
        at = 0
        while at < len(words):
            size = int(rng.integers(4, 25))
            snippets.append((label[lang], words[at:at + size]))
            at += size
    order = rng.permutation(len(snippets))
    chains = [[snippets[j] for j in order[i:i + 5]] for i in range(0, len(order), 5)]
    chains.sort(key=lambda c: -sum(len(w) for _, w in c))
    vocabulary: dict[str, int] = {}
    lengths = np.array([sum(len(w) for _, w in c) for c in chains])
    codes = np.zeros((len(chains), lengths[0]), np.int64)
    gold = np.zeros_like(codes)
    for i, c in enumerate(chains):
        flat = [vocabulary.setdefault(w, len(vocabulary)) for _, ws in c for w in ws]
        codes[i, :len(flat)] = flat
        gold[i, :len(flat)] = [y for y, ws in c for _ in ws]
    inside = np.arange(codes.shape[1])[None, :] < lengths[:, None]
    words = list(vocabulary)
    uses = np.bincount(codes[inside], minlength=len(words))
    lexicon = {words[i] for i in np.argsort(-uses, kind="stable")[:LEXICON_WORDS] if uses[i] > 2}
    seen: Counter = Counter()
    per_word = []
    for w, n in zip(words, uses):
        fs = [f for f in word_features(w) if f[0] != " " or w in lexicon]
        per_word.append(fs)
        for f in fs:
            seen[f] += int(n)
    index = {f: i for i, (f, n) in enumerate(seen.most_common(MAX_FEATURES)) if n > 1}
    found = [[index[f] for f in fs if f in index] for fs in per_word]
    rows = np.array([i for fs in found for i in fs], np.int64)
    sizes = np.array([len(fs) for fs in found])
    owner = np.repeat(np.arange(len(words)), sizes)

    # Empirical counts.
    flat_codes = codes[inside]
    gold_words = np.bincount(flat_codes * k + gold[inside], minlength=len(words) * k).reshape(-1, k).astype(float)
    pair_inside = inside[:, 1:]
    gold_pairs = np.bincount((gold[:, :-1] * k + gold[:, 1:])[pair_inside], minlength=k * k).reshape(k, k)
    gold_start = np.bincount(gold[:, 0], minlength=k)

    theta = [np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)]
    m1, m2 = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    n_words = max(1, int(lengths.sum()))
    for step in range(1, rounds + 1):
        scores = _sum_rows(theta[0], rows, sizes)[codes]
        gamma, pairs = forward_backward(scores, lengths, theta[1], theta[2])
        wanted = np.stack([np.bincount(flat_codes, gamma[inside][:, j], minlength=len(words)) for j in range(k)], axis=1)
        diff = (gold_words - wanted)[owner]
        grad = np.stack([np.bincount(rows, diff[:, j], minlength=len(index)) for j in range(k)], axis=1)
        grads = [grad, gold_pairs - pairs, gold_start - gamma[:, 0].sum(axis=0)]
        for x, g, a, b in zip(theta, grads, m1, m2):
            g = g / n_words - decay * x
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            x += rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8) * (1 - step / (rounds + 1))
    return Model(langs, index, theta[0].astype(np.float32), theta[1], theta[2])


def _words(text) -> F.Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", -1), "")


def _crc_mod(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % 5


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model | None:
    """Fit on a bounded sample of the labelled rows whose id is not held out."""
    labelled = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (_crc_mod(id_col) != 0))
    labelled = labelled.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    n_langs = labelled.select("lang").distinct().count()
    if n_langs == 0:
        return None
    per_lang = max(8, SAMPLE_DOCS // n_langs)
    # The row of smallest hash in each of ``per_lang`` buckets of a language: numbers only, combined map-side.
    h = F.xxhash64("doc_id", F.lit(11))
    picked = (labelled.select("lang", "doc_id", h.alias("h")).groupBy("lang", F.pmod("h", F.lit(per_lang)).alias("b"))
              .agg(F.min(F.struct("h", "doc_id")).alias("m")).select("m.doc_id").distinct())
    words = _words(F.col("text"))
    # Snippets begin at even distances; those of a text shorter than all of them together are its words.
    step = F.greatest(F.size("words") / float(SNIPPETS), F.lit(float(SNIPPET_WORDS)))
    snippets = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SNIPPETS - 1)), lambda i: F.when(
        i * step < F.size("words"), F.slice("words", F.floor(i * step).cast("int") + 1, F.lit(SNIPPET_WORDS)))
        .otherwise(F.array().cast("array<string>"))))
    rows = (labelled.join(F.broadcast(picked), "doc_id")   # at most max(SAMPLE_DOCS, 8 x languages) ids
            .select("doc_id", "lang", words.alias("words")).select("doc_id", "lang", snippets.alias("words"))
            .groupBy("doc_id", "lang").agg(F.min("words").alias("words")).collect())
    samples = sorted((r["lang"], r["doc_id"], list(r["words"])) for r in rows)
    return fit([(lang, words) for lang, _, words in samples])


class _Memo:
    """Emission scores of the words a worker has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.index = model, {}
        self.table = np.zeros((MEMO_WORDS, len(model.langs)), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        known = self.index
        at = np.array([known.get(w, -1) for w in words], np.int64)
        out = np.empty((len(words), self.table.shape[1]))
        old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        out[old] = self.table[at[old]]
        if len(new):
            fresh = [words[i] for i in new]
            out[new] = rows = self.model.emissions(fresh)
            if len(known) + len(fresh) > MEMO_WORDS:
                known.clear()
            for w, r in zip(fresh, rows):
                if len(w) <= 64 and len(known) < MEMO_WORDS:
                    self.table[len(known)] = r
                    known[w] = len(known)
        return out


def _shares(codes: np.ndarray, offsets: np.ndarray, table: np.ndarray, model: Model) -> np.ndarray:
    """Summed posteriors of each text's words, every text one chain."""
    texts, k = len(offsets) - 1, len(model.langs)
    out = np.zeros((texts, k))
    sizes = np.diff(offsets)
    per_text = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(texts), per_text)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    starts = offsets[:-1][owner] + nth * SEGMENT
    size = np.minimum(starts + SEGMENT, offsets[1:][owner]) - starts

    def parts(segments: np.ndarray):
        order = segments[np.argsort(-size[segments], kind="stable")]
        for at in range(0, len(order), 500):
            part = order[at:at + 500]
            place = np.minimum(starts[part][:, None] + np.arange(int(size[part[0]])), len(codes) - 1)
            yield part, table[codes[place]]

    t = np.exp(model.transitions - model.transitions.max())
    entry = np.tile(np.exp(model.start - model.start.max()), (len(owner), 1))
    leave = np.ones((len(owner), k))
    cut = np.flatnonzero(per_text[owner] > 1)
    if len(cut):   # messages over the borders: forward, then backward, all texts side by side
        products = np.zeros((len(owner), k, k))
        for part, scores in parts(cut):
            products[part] = segment_products(scores, size[part], model.transitions)
        last = per_text[owner] - 1
        for step in range(int(per_text.max()) - 1):
            at = cut[(nth[cut] == step) & (last[cut] > step)]
            message = np.einsum("ij,ijk->ik", entry[at], products[at]) @ t
            entry[at + 1] = message / message.sum(axis=1, keepdims=True)
        for step in range(int(per_text.max()) - 1, 0, -1):
            at = cut[nth[cut] == step]
            message = np.einsum("ijk,ik->ij", products[at], leave[at]) @ t.T
            leave[at - 1] = message / message.sum(axis=1, keepdims=True)
    for part, scores in parts(np.arange(len(owner))):
        gamma, _ = forward_backward(scores, size[part], model.transitions, model.start, entry[part], leave[part])
        np.add.at(out, owner[part], gamma.sum(axis=1))
    return out


def labels(docs: DataFrame, model: Model | None, text_col: str = "text") -> F.Column:
    """A struct column ``(lang_pred, score, n_words)`` for the rows of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    words = _words(F.col(text_col))
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.size(words).cast("long").alias("n_words"))
    shared = spark.sparkContext.broadcast(model)   # at most MAX_FEATURES rows of weights
    fitted = uuid.uuid4().hex

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        memo = worker_state(("language_id", fitted), lambda: _Memo(model))
        langs = np.array([*model.langs, UNKNOWN], dtype=object)
        for column in columns:
            found = []
            for at in range(0, len(column), SLICE_ROWS):
                part = column.slice(at, SLICE_ROWS)
                lengths = np.diff(part.offsets.to_numpy())
                coded = part.flatten().dictionary_encode()
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                sums = np.zeros((len(lengths), len(langs) - 1))
                if offsets[-1]:
                    sums = _shares(coded.indices.to_numpy(), offsets, memo.scores(coded.dictionary.to_pylist()), model)
                best = np.where(lengths > 0, sums.argmax(axis=1), len(langs) - 1)
                score = np.where(lengths > 0, sums.max(axis=1) / np.maximum(lengths, 1), 0.0).clip(0, 1)
                found.append(pa.StructArray.from_arrays(
                    [pa.array(langs[best], pa.string()), pa.array(score), pa.array(lengths.astype(np.int64))],
                    names=["lang_pred", "score", "n_words"]))
            yield pa.concat_arrays(found) if found else pa.array([], pa.struct(
                [("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64())]))

    def trim(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return trimmed(run(columns))

    # Marked as nondeterministic so that a filter on the labels is not pushed below them and labels twice.
    return F.arrow_udf(trim, "lang_pred string, score double, n_words long").asNondeterministic()(words)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, lang_pred, score, n_words)`` of every row."""
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), labels(docs, model, text_col).alias("found"))
    return found.select("doc_id", "found.*")


def keep_known(docs: DataFrame, model: Model | None, least: float, text_col: str = "text") -> DataFrame:
    """``docs`` (all columns) with the rows whose language is known and holds ``least`` of their words.

    Every row is decided by its own text in the pass that reads it, so nothing is shuffled.
    """
    found = docs.withColumn("__found", labels(docs, model, text_col))
    return found.filter((F.col("__found.lang_pred") != UNKNOWN) & (F.col("__found.score") >= least)).drop("__found")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", F.coalesce(_crc_mod("doc_id") == 0, F.lit(False)).alias("held_out"),
                        "lang_pred", "score", "n_words")


QUERIES = {"op5_language_id": op5_language_id}
