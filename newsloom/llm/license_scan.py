"""License scan: ordered signature rules with keyword gates and interval suppression.

A text is reduced to its words (bytes ``0-9``, ``a-z`` after lower-casing A-Z, and everything outside
ASCII), joined by single blanks.  One automaton over all keywords decides which of the hundreds of rule
patterns are tried at all.  Their detections are ordered by priority and length, and a detection whose
interval lies inside one that was kept before it is suppressed.  The base phrases are counted at all places
and are never suppressed.

Defined cases: a null or empty text has no words, no labels and score 0, first and last word are null;
repeated rows and null ids are scanned like any other; an empty table gives an empty result; other columns
are ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import load, prepare
from newsloom.llm.license_rules import BASE_PHRASES, Rule, all_rules

BASE_CONFIDENCE = 0.5
# Byte table: A-Z to a-z, digits and a-z and all bytes outside ASCII stay, the rest becomes a blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, detections array<struct<label:string,first_word:int,last_word:int,priority:int>>")


def suppress(found: list[tuple[int, int, int]]) -> list[int]:
    """Indices of the (priority, start, end) detections that no better one contains, best first.

    Better is a smaller priority, then a longer interval, then an earlier start.  A Fenwick tree over the
    start positions keeps the largest end so far, so k detections take k log k steps.
    """
    starts = sorted({s for _, s, _ in found})
    tree = [-1] * (len(starts) + 1)
    kept = []
    for i in sorted(range(len(found)), key=lambda j: (found[j][0], found[j][1] - found[j][2], found[j][1], j)):
        _, s, e = found[i]
        at = bisect_right(starts, s)
        k, reach = at, -1
        while k:
            reach = max(reach, tree[k])
            k &= k - 1
        if reach >= e:
            continue
        kept.append(i)
        k = at
        while k < len(tree):
            tree[k] = max(tree[k], e)
            k += k & -k
    return kept


class Scanner:
    def __init__(self, rules: list[Rule]) -> None:
        import ahocorasick

        self.rules = rules
        self.patterns = [re.compile(r"(?<![^ ])(?:" + r.pattern + r")(?![^ ])") for r in rules]
        self.base = [(label, re.compile(r"(?<![^ ])" + phrase + r"(?![^ ])")) for phrase, label in BASE_PHRASES.items()]
        by_keyword: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            by_keyword.setdefault(r.keyword, []).append(i)
        for phrase in BASE_PHRASES:
            by_keyword.setdefault(phrase, [])
        self.gate = ahocorasick.Automaton()
        for keyword, which in by_keyword.items():
            self.gate.add_word(keyword, which)
        self.gate.make_automaton()

    def scan(self, text: str) -> tuple:
        words = text.encode("utf-8").translate(_TABLE).split()
        # Latin-1 keeps one character per byte; rules are plain ASCII.
        line = b" ".join(words).decode("latin-1")
        tried = set()
        hit = False
        for _, which in self.gate.iter(line):
            hit = True
            tried.update(which)
        if not hit:
            return len(words), 0, None, None, "", "", 0.0, []
        spans = [(label, m.start(), m.end()) for label, rx in self.base for m in rx.finditer(line)]
        found = [(i, m.start(), m.end()) for i in sorted(tried) for m in self.patterns[i].finditer(line)]
        kept = [found[k] for k in suppress([(self.rules[i].priority, s, e) for i, s, e in found])]
        word_at = self._word_numbers(line, {p for _, s, e in spans + kept for p in (s, e)})
        base = sorted({label for label, _, _ in spans})
        places = [word_at[s] for _, s, _ in spans]
        labels = sorted({*base, *(self.rules[i].label for i, _, _ in kept)})
        score = max([BASE_CONFIDENCE] * bool(base) + [self.rules[i].confidence for i, _, _ in kept], default=0.0)
        detections = sorted((word_at[s], word_at[e], self.rules[i].label, self.rules[i].priority) for i, s, e in kept)
        return (len(words), len(spans), min(places, default=None), max(places, default=None), ",".join(base),
                ",".join(labels), score, [{"label": d[2], "first_word": d[0], "last_word": d[1], "priority": d[3]}
                                          for d in detections])

    @staticmethod
    def _word_numbers(line: str, positions: set[int]) -> dict[int, int]:
        """Number of the word at each character position, in one walk over the line."""
        out, at, word = {}, 0, 0
        for p in sorted(positions):
            word += line.count(" ", at, p)
            at = p
            out[p] = word
        return out


_SCANNERS: list[Scanner] = []   # one per worker process


def _run(batches: Iterator) -> Iterator:
    import pyarrow as pa

    if not _SCANNERS:
        _SCANNERS.append(Scanner(all_rules()))
    scanner = _SCANNERS[0]
    spans = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()),
                                ("priority", pa.int32())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), spans]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    for batch in batches:
        rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Word counts, base places, labels, score and the detections that were kept, one row per document."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_run, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents")).drop("detections")


QUERIES = {"op1_license_scan": op1_license_scan}
