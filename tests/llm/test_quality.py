from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from burdenframe.llm import quality

GOOD = " ".join(f"Sentence{i} says a thing{i} about topic{i} of year{i}." for i in range(12))


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def judged(docs):
    return {r.doc_id: r for r in quality.assess(docs).select("doc.doc_id", "quality.*").collect()}


def test_counts(documents):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a a a a", "x y", "é ñ b\x0bc\x1cd", "a b c\na b c\n\na b c"]
    texts += [" ".join(rng.choice("abcdefgh#|") + rng.choice(["", "\n", "\t"]) for _ in range(n)) for n in (3, 10, 60, 400)]
    texts += [" ".join(str(rng.randint(0, 60)) for _ in range(900)), "word " * 30_000]
    found = judged(documents(*texts))
    for i, text in enumerate(texts):
        r = found[i]
        if i < len(texts) - 1:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text), i
    assert found[len(texts) - 1].n_repeat_words == 30_000


def test_lines_and_verdicts(documents):
    half = "\n".join(["Home | News | Sport | Login"] * 10)
    texts = [
        GOOD, GOOD + "\nLicensed under the Apache License, Version 2.0.", GOOD + "\nHome | News | Sport", GOOD[:200] + "\n" + half + "\n" + half,
        GOOD.upper(), " ".join(w + "###" for w in GOOD.split()), "short text.", GOOD + "\nspam spam spam spam spam spam spam spam spam", None,
    ]
    found = judged(documents(*texts))
    assert [found[i].kept for i in range(len(texts))] == [True, True, True, False, False, False, False, True, False]
    assert found[1].clean_text == GOOD and found[1].removed["boilerplate"] == 1
    assert found[2].clean_text == GOOD and found[2].removed["navigation"] == 1
    assert found[4].removed["shouting"] == 1 and found[5].removed["punctuation"] == 1 and found[7].removed["repetition"] == 1
    assert not found[3].base_failed or found[3].n_repeat_words


def test_filter_on_verdict_and_clashing_columns(documents):
    docs = documents(GOOD, "x", GOOD).withColumns({"quality": F.lit(1), "lines": F.lit("a"), "doc": F.lit(2)})
    kept = quality.assess(docs).filter("quality.kept AND quality.n_words > 10").select("doc.*")
    assert kept.columns == docs.columns and kept.count() == 2
    assert quality.assess(docs.limit(0)).count() == 0


def test_a_long_line_may_name_a_phrase(documents):
    long = " ".join(f"word{i}" for i in range(80)) + " and the terms of use apply here."
    rows = quality.assess(documents(long, long.replace(" and", "\nSee the terms of use.\nand"))).orderBy("doc.doc_id").select("quality.*").collect()
    assert rows[0].kept and rows[0].n_lines_removed == 0
    assert rows[1].kept and rows[1].removed["boilerplate"] == 2 and "See" not in rows[1].clean_text
