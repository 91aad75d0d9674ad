"""Small messy tables for the operator tests."""

from __future__ import annotations

import regex

# Extra columns carry names that operators use inside.
DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
              "words string, node string, row long, shard int, kept boolean, text_sha256 string, value string, pid int")

LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(30_000))


def rows(texts: list[tuple], langs: tuple = ("en", "de", None)) -> list[tuple]:
    return [(i, t, langs[k % len(langs)], None if k % 5 == 4 else f"src{k % 3}", None if t is None else len(t),
             "w", "n", 7, 1, True, "s", "v", 3) for k, (i, t) in enumerate(texts)]


def documents(spark, texts: list[tuple], partitions: int = 3):
    return spark.createDataFrame(rows(texts), DOC_SCHEMA).repartition(partitions)


def messy(spark):
    base = [(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, None), (4, ""), (5, None), (5, "alpha beta gamma"),
            (6, LONG), (7, LONG), (8, "!!! 123 ..."), (9, "one"), (9, "one"), (None, "one"), (None, None),
            (10, "Zeta eta theta iota kappa lambda mu nu xi omicron"), (11, "日本語 のテキスト ß É")]
    return documents(spark, base)


def empty(spark):
    return documents(spark, [])


def words(text: str | None) -> list[str]:
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
