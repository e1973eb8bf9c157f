"""Spelling variants against a plain version that compares all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from burdenframe.llm import spelling as S


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, times=5):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    out, forms = {}, {}
    for w, n in words.items():
        others = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= times * n:
            forms[w] = best
        out[w] = (n, len(others))
    result = []
    for w, (n, k) in out.items():
        root = w
        while root in forms:
            root = forms[root]
        result.append((w, forms.get(w), root, n, k, words[forms[w]] if w in forms else None))
    return sorted(result, key=str)


def results(docs, **options):
    return sorted((tuple(r) for r in S.variants(docs, **options).collect()), key=str)


def variants_of(rng, word):
    k, kind, c = rng.randrange(len(word)), rng.randrange(3), rng.choice("aeé×ß")
    return word[:k] + (c if kind else "") + word[k + (kind < 2) :]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = ["thingble", "andother", "keitlich", "ununun", "aaaaaa", "aaaaaab", "nación" * 2, "prefixword", "z" * 300, "wordword" * 20]
    pool = [w for b in base for w in [b] * 60 + [variants_of(rng, b) for _ in range(40)] for _ in range(rng.choice([1, 1, 5, 30]))]
    pool += [variants_of(rng, variants_of(rng, b)) for b in base for _ in range(300)]
    rng.shuffle(pool)
    texts = []
    for i in range(0, len(pool), 40):
        texts.append(rng.choice([" ", "\n", "1", ", ", "日"]).join(rng.choice([w, w, w.upper() if w.isascii() else w, w.capitalize()]) for w in pool[i : i + 40]))
    return [(3 * i, t) for i, t in enumerate(texts)] + [(None, "thingble thingblE"), (7, None), (8, ""), (9, "short Word"), (9, "short Word")]


@pytest.mark.parametrize("block", [4096, 7, 40])
def test_against_all_pairs(documents, corpus, block):
    want = brute(corpus)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] for r in want if r[1])
    assert results(documents(*corpus).repartition(4), block=block) == want


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert results(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_long_ways_to_the_root(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(21)], "word string, form string")
    assert {r.root for r in S.roots(forms).collect()} == {"w21"}


def test_empty_and_extra_columns(spark, documents):
    assert S.variants(documents()).collect() == []
    docs = spark.createDataFrame([(1, "abcdef " * 5, 1, "x")], "doc_id long, text string, n int, word string")
    assert [tuple(r) for r in S.variants(docs).collect()] == [("abcdef", None, "abcdef", 5, 0, None)]


def test_shared_ends():
    x = np.frombuffer(b"abcabdxbc", np.uint8).reshape(1, 3, 3)
    assert S.shared_ends(x, x)[0].tolist() == [[3, 2, 0], [2, 3, 0], [0, 0, 3]]
