import itertools
import random
import re
from re import _constants, _parser

from newsloom.llm import license_scan as S
from newsloom.llm.license_rules import BASE_PHRASES, all_rules

from .fixtures import documents, empty, messy

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    w = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k:k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    "CC BY cc-by cc.by\ncc by", "all rights reserved all rights reserved", "Licensed under CC BY-NC 4.0.", "cc by É cc by ß",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.",
    "Released under the MIT License.", "xcc by ccby cc bye", "SPDX-License-Identifier: BSD-3-Clause", None, "", "İ CC BY ſ",
    "GENERAL PUBLIC LICENSE general public licenses", "All rights reserved. " * 2000,
]


def test_hundreds_of_rules():
    rules = all_rules()
    assert len(rules) > 200
    assert all(r.keyword for r in rules) and {r.priority for r in rules} == {1, 2, 3, 4}


def test_base_columns_against_brute_force():
    scanner = S.Scanner(all_rules())
    for t in TEXTS:
        got = scanner.scan(t or "")
        assert got[:5] == brute_base(t), t
        assert set(filter(None, got[4].split(","))) <= set(got[5].split(","))
        assert 0 <= got[6] <= 1


def test_labels():
    scan = S.Scanner(all_rules()).scan
    assert scan(TEXTS[2])[5] == "cc-by,cc-by-nc-4.0"
    assert scan(TEXTS[4])[5] == "gpl,gpl-3.0"
    assert scan(TEXTS[5])[5] == "apache-2.0"
    assert scan(TEXTS[6])[5] == "mit"
    assert scan(TEXTS[8])[5] == "bsd-3-clause"
    assert scan("Creative Commons Attribution-ShareAlike 4.0")[5] == "cc-by-sa-4.0"


def test_gates_change_nothing():
    """Trying every rule finds what the gated scan finds."""
    rules = all_rules()
    scanner = S.Scanner(rules)
    for t in TEXTS[:9]:
        line = b" ".join((t or "").encode().translate(S._TABLE).split()).decode("latin-1")
        for r, p in zip(rules, scanner.patterns):
            if p.search(line):
                assert r.keyword in line, (r, t)


def expand(parsed):
    """Strings that a parsed rule pattern matches: all branches, fewest and most (at most 3) repeats."""
    parts = []
    for op, arg in parsed:
        if op is _constants.LITERAL:
            parts.append({chr(arg)})
        elif op is _constants.NOT_LITERAL:
            parts.append({"x"})
        elif op is _constants.IN:
            if arg[0][0] is _constants.NEGATE:
                parts.append({"x"})
            else:
                parts.append({chr(v if o is _constants.LITERAL else v[0]) for o, v in arg})
        elif op is _constants.SUBPATTERN:
            parts.append(set(expand(arg[3])))
        elif op is _constants.BRANCH:
            parts.append({s for branch in arg[1] for s in expand(branch)})
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT):
            low, high, inner = arg
            inner = sorted(expand(inner))
            parts.append({"".join(p) for n in {low, min(high, max(low, 3))} for p in itertools.product(inner, repeat=n)})
        else:
            raise AssertionError(op)
    return ["".join(p) for p in itertools.product(*map(sorted, parts))]


def test_every_match_passes_its_gate():
    """Strings expanded from each rule's pattern contain its keyword."""
    rules = all_rules()
    for r, p in zip(rules, S.Scanner(rules).patterns):
        strings = expand(_parser.parse(r.pattern))
        assert strings
        for s in strings:
            if p.fullmatch(s):
                assert r.keyword in s, (r, s)
        assert any(p.fullmatch(s) for s in strings), r


def test_names_behind_wider_gates():
    scan = S.Scanner(all_rules()).scan
    assert scan("CreativeML Open RAIL-M")[5] == "openrail-m"
    assert scan("CreativeML OpenRAIL-M license")[5] == "openrail-m"
    assert scan("PostgreSQL Licence")[5] == "postgresql"
    assert scan("Sleepycat Software License")[5] == "sleepycat"
    assert scan("the zlib/libpng License")[5] == "zlib"


def test_suppression_against_brute_force():
    random.seed(1)
    for _ in range(1500):
        found = [(random.randint(1, 3), a := random.randint(0, 30), a + random.randint(1, 10)) for _ in range(random.randint(0, 25))]
        kept = []
        for i in sorted(range(len(found)), key=lambda j: (found[j][0], found[j][1] - found[j][2], found[j][1], j)):
            if not any(found[j][1] <= found[i][1] and found[j][2] >= found[i][2] for j in kept):
                kept.append(i)
        assert kept == S.suppress(found)


def test_spark_rows(spark):
    df = documents(spark, list(enumerate(TEXTS)))
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in S.scan_licenses(df).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(TEXTS)}
    assert S.scan_licenses(messy(spark)).count() == messy(spark).count()
    assert S.scan_licenses(empty(spark)).collect() == []
