"""Token alignment against a plain version over whole texts, and the perfect hash."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from burdenframe.llm import token_alignment as T

AWKWARD = ["Two words, one.Two", None, "", "  leading\n\n\nand  runs \n", "a" * 2000, "naïve é日本 \x85　\x1c end", "has▁mark", "same text", "same text",
           " ", "\n", "\n\nx", "<|endoftext|> <s> <0x41> <unk>", "tab\tand\r\nline ().\r", "².and 3.4,5", "\x00zero", "word " * 3000, "don't  stop", "Ġraw"]


@pytest.fixture(scope="module")
def plain():
    """Per text, A's and B's ids with their bytes, from whole texts."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path(T.BYTE_LEVEL))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path(T.PIECES))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}

    def tokens(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + text).encode()
        return (ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == whole == b"".join(bytes_b) else None

    return tokens


def brute(rows, tokens):
    found = [(key, tokens(text)) for key, text in rows]
    links, out = [], []
    for key, t in found:
        own, groups = [], []
        if t:
            ends_a, ends_b = (np.cumsum([len(x) for x in t[k]]).tolist() for k in (1, 3))
            own = [(t[0][i], t[2][j]) for i, x in enumerate(ends_a) for j in ([ends_b.index(x)] if x in set(ends_b) else [])]
            cuts = sorted(set(ends_a) & set(ends_b))
            for lo, hi in zip([0, *cuts], cuts):
                groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if lo < e <= hi) for ids, ends in ((t[0], ends_a), (t[2], ends_b))))
        links.append(own)
        out.append((key, len(t[0]) if t else 0, len(t[2]) if t else 0, len(groups), ";".join(groups)))
    count = Counter(x for own in links for x in own)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return [(key, a, b, g, len(own), sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own),
             hashlib.sha256(form.encode()).hexdigest() if form else "", form) for (key, a, b, g, form), own in zip(out, links)]


def results(docs, **options):
    rows = T.align(docs, with_groups=True, **options).collect()
    return sorted(tuple(r) for r in rows)


def test_awkward_texts(documents, plain):
    docs = documents(*AWKWARD)
    want = brute(list(enumerate(AWKWARD)), plain)
    assert results(docs.repartition(40)) == sorted(want)
    assert want[6][1:] == (0, 0, 0, 0, 0, 0, "", "") and want[1][1:] == want[6][1:]


def test_random_texts(documents, plain):
    rng = random.Random(3)
    parts = ["The", "thingble", "ünter", "3", ".", ",", " ", " ", " ", "\n", "\n", "'s", "x", "()", "\r", "\t", "é", "日", "²", "▁", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    assert results(documents(*texts).repartition(3)) == sorted(brute(list(enumerate(texts)), plain))


def test_real_documents(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert results(docs) == sorted(brute(rows, plain))


def test_empty_and_extra_columns(spark, documents):
    assert T.align(documents()).collect() == []
    docs = spark.createDataFrame([(1, "a b", 3, "x"), (None, "a b", 4, "y")], "doc_id long, text string, node int, data string")
    rows = T.align(docs).collect()
    assert sorted((r.doc_id or 0, r.n_links, r.n_best, r.count_sum) for r in rows) == [(0, 2, 2, 4), (1, 2, 2, 4)]


def test_pair_bound():
    bound = T.Aligner.at().pair_bound()
    assert 50_000 < bound < 1_000_000


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 62, n))
    h = T.PerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert (h.keys[h.slots(keys)] == keys).all()
    others = np.setdiff1d(np.random.default_rng(n + 1).integers(0, 1 << 62, 1000), keys)
    assert (h.slots(others) == -1).all()


def test_tree(spark):
    parts = spark.createDataFrame([(i, bytearray(np.array([1, i], np.int64).tobytes())) for i in range(45)], "node long, data binary")
    assert T.tree(parts, lambda xs: np.sum(xs, axis=0), fan_in=4).tolist() == [45, sum(range(45))]
