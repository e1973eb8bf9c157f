"""N-gram Jaccard join, components, exact top-k and URL filters against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from burdenframe.llm import jaccard_join, topk_search, url_filter
from burdenframe.llm.components import components
from burdenframe.llm.queries import ORACLE, QUERIES
from oracle import check


def smallest_of(pairs, keys):
    above = {k: k for k in keys}

    def top(k):
        while above[k] != k:
            k = above[k]
        return k

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        above[y] = x
    return {k: top(k) for k in keys}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 200)] + [(500, i) for i in range(501, 700)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(300)]
    keys = {k for p in pairs for k in p}
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {k for a, b in pairs if a != b for k in (a, b)}
    assert found == {k: v for k, v in smallest_of(pairs, keys).items() if k in linked}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingle_set(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def near_copies(rng, n):
    """Families of texts with a few words changed, some sharing a passage, and copies."""
    passage = [f"shared{k}" for k in range(60)]
    out = []
    for f in range(n):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([6, 20, 60, 150, 300]))]
        if rng.random() < 0.4:
            at = rng.randint(0, len(base))
            base[at:at] = passage
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 10**6)}"
            out.append(" ".join(own))
    return out + rng.sample(out, len(out) // 5)


@pytest.mark.parametrize("seed, chunk, frequent", [(0, 2_000_000, 64), (1, 3000, 3), (2, 500, 2), (3, 20_000, 8)])
def test_near_duplicates(spark, documents, monkeypatch, seed, chunk, frequent):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "BUCKET_CHARS", 20_000)
    rng = random.Random(seed)
    texts = near_copies(rng, 40) + [None, "", " \n", "one two", "ONE  two", "one two three", "Ä b c d e", "ä b c d e", "a b c d e f", "A B C D E F"]
    rng.shuffle(texts)
    sets = list(map(shingle_set, texts))
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for own in holders.values() for i, a in enumerate(own) for b in own[i + 1 :]}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = smallest_of(links, range(len(texts)))
    docs = documents(*texts).withColumns({"node": F.lit("clash"), "component": F.lit(1)})
    found = jaccard_join.near_duplicates(docs).collect()
    assert len(found) == len(texts)
    assert {r.doc_id: r.component_id for r in found} == expected
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(s) for i, s in enumerate(sets)}


def test_near_duplicates_of_odd_rows(documents):
    text = "this is a text of more than five words"
    rows = [(7, text), (7, text), (None, text), (3, text.upper()), (None, "alone here"), (5, "x y z " * 20_000), (5, None)]
    found = jaccard_join.near_duplicates(documents(*rows)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1) for r in found) == [
        (-1, -1), (-1, 3), (3, 3), (5, 5), (5, 5), (7, 3), (7, 3)]
    assert jaccard_join.near_duplicates(documents()).collect() == []


def vectors_table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in vectors], "vec_id long, embedding array<float>, score int")


@pytest.mark.parametrize("seed, scale", [(0, 1.0), (1, 0.05), (2, 3e6)])
def test_exact_top_k(spark, seed, scale):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=6) * scale).astype(np.float32)) for i in range(300)]
    rows += [(300, None), (301, [float("nan")] * 6), (302, [None] * 6), (303, []), (304, np.zeros(6)), (320, np.zeros(6)), (None, np.ones(6)), (5, rows[5][1])]
    table = vectors_table(spark, rows)
    whole = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v is not None and len(v) == 6 and v[0] is not None and np.isfinite(v).all()}
    expected = []
    for q in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:20]
            expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    found = topk_search.search(table, F.col("vec_id") % 20 == 0, block=50, query_block=4).collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_repeated_ids_keep_all_their_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32)) for i in range(60)]
    rows += [(k, rng.normal(size=6).astype(np.float32) * 3) for k in (7, 7, 20, 20, 33)]
    vectors_table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    problem, n = check(spark, con, str(tmp_path), "op3_exact_top_k", QUERIES["op3_exact_top_k"], ORACLE["op3_exact_top_k"])
    assert problem is None, problem
    assert n == 60
    found = topk_search.search(vectors_table(spark, rows), F.col("vec_id") % 20 == 0, block=16, query_block=2).collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(ORACLE["op3_exact_top_k"]).fetchall())


def test_scores_beyond_64_bits(spark):
    rows = [(20, [1e20, 1.0]), (1, [1e20, 0.0]), (2, [-1e20, 0.0]), (3, [1e19, 5.0]), (4, [0.0, 3.0]), (40, [1.0, 2.0])]
    found = topk_search.search(vectors_table(spark, rows), F.col("vec_id") % 20 == 0, block=2).collect()
    own = {r.vec_id: (r["rank"], r.score) for r in found if r.query_id == 20}
    assert own[1][1] == own[3][1] == 2**63 - 1 and own[2] == (5, -(2**63 - 1)) and own[4] == (4, 64 * 192) and own[40][1] > 2**62
    assert {r.vec_id: r.score for r in found if r.query_id == 40}[4] == 128 * 192


def test_a_floor_only_leaves_out_what_is_below(spark):
    rng = np.random.default_rng(3)
    vectors = np.floor(64 * rng.normal(size=(400, 6)) * [9, 3, 1, 1, 1, 1])
    lists = topk_search.Lists(np.arange(400), vectors)
    for q in range(30):
        every, _ = lists.top(vectors[q], q)
        exact = sorted(((-int(vectors[q] @ v), i) for i, v in enumerate(vectors) if i != q))[:20]
        assert every == [(i, -s) for s, i in exact]
        floor = every[7][1]
        some, scored = lists.top(vectors[q], q, floor=floor)
        assert some == [x for x in every if x[1] >= floor]
        assert lists.top(vectors[q], q, floor=every[0][1] * 50 + 10**9) == ([], 0)


def test_threshold_stops_early_and_small_tables(spark):
    rng = np.random.default_rng(7)
    vectors = np.floor(64 * rng.normal(size=(5000, 3)))
    lists = topk_search.Lists(np.arange(5000), vectors)
    best, scored = lists.top(np.array([50.0, 1.0, 0.0]), own=0)
    assert scored < 1000
    score = vectors @ np.array([50.0, 1.0, 0.0])
    assert best == [(int(i), int(score[i])) for i in np.lexsort((np.arange(5000), -score)) if i][:20]
    one = vectors_table(spark, [(0, [1.0, 2.0])])
    assert topk_search.search(one, F.col("vec_id") % 20 == 0).collect() == []
    assert topk_search.search(one.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_url_rules(spark):
    urls = ["https://WWW.Example.com/en/a?x", "http://example.com/en/", "http://example.com/fr/", "http://a.b.net/es/x", "net/es/", None, "", "http://x.com", "ftp://y.org?/en/",
            "http://example.comx/en/", "https://é.com/#/", "http://b.net/en/", "http:///en/x"]
    pages = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    rows = sorted(url_filter.judge(pages.union(pages.limit(1)), url_filter.rule_table(spark)).collect(), key=lambda r: r.page_id)[1:]
    assert [r.rule for r in rows] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None, None, None, None, "com/", None, None]
    assert [(r.host, r.path) for r in rows][0] == ("www.example.com", "/en/a") and (rows[8].host, rows[8].path) == ("y.org", "") and (rows[12].host, rows[12].path) == ("", "/en/x")
    assert [r.verdict for r in rows] == ["allow", "block", "allow", "block"] + ["allow"] * 9
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).collect() == []


def test_propagation(spark):
    rng = random.Random(9)
    edges = {(f"h{rng.randint(0, 12)}", f"h{rng.randint(0, 12)}"): rng.randint(1, 5) for _ in range(40)}
    edges = {k: n for k, n in edges.items() if k[0] != k[1]}
    seeds = {"h0": (1.0, 0.0), "h1": (1.0, 0.0), "h2": (0.0, 1.0)}
    links = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    table = spark.createDataFrame([(h, t, b) for h, (t, b) in seeds.items()], "host string, trusted double, blocked double")
    found = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(links, table, tolerance=1e-4).collect()}
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    for k, flip in ((0, False), (1, True)):
        ways = {(b, a) if flip else (a, b): n for (a, b), n in edges.items()}
        total = {h: sum(n for (a, _), n in ways.items() if a == h) for h in hosts}
        start = {h: seeds.get(h, (0, 0))[k] / sum(s[k] for s in seeds.values()) for h in hosts}
        rank = {h: 0.15 * start[h] for h in hosts}
        for _ in range(400):
            rank = {h: 0.15 * start[h] + 0.85 * sum(rank[a] * n / total[a] for (a, b), n in ways.items() if b == h) for h in hosts}
        assert all(abs(rank[h] - found.get(h, (0, 0))[k]) < 1e-4 * 0.85 / 0.15 for h in hosts)


def test_links_decide_where_no_rule_does(spark):
    html = {"good.com": "<a href='//fan.org/x'>", "bad.example.com": "", "spam.org": "<a href=https://BAD.example.com/en/>x</a><a href=/own>", "fan.org": "", "lone.org": None}
    rows = [(i, f"http://{h}/en/{i}", t) for i, (h, t) in enumerate(html.items())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.host: r for r in url_filter.judge(pages, url_filter.rule_table(spark)).collect()}
    assert {h: r.verdict for h, r in found.items()} == {"good.com": "allow", "bad.example.com": "block", "spam.org": "block", "fan.org": "allow", "lone.org": "allow"}
    assert found["fan.org"].trust > 0 and found["spam.org"].distrust > 0 and found["lone.org"].distrust == 0


def test_evenly_spread_lists_are_not_read_through(monkeypatch):
    """Where the bound falls slowly, reading on costs more than to score the rest at once; reading such a block through takes many rounds."""
    rng = np.random.default_rng(5)
    vectors = np.floor(64 * rng.normal(size=(4000, 64)))
    lists, calls = topk_search.Lists(np.arange(4000), vectors), []
    scores = topk_search.Lists.scores
    monkeypatch.setattr(topk_search.Lists, "scores", lambda self, at, query: calls.append(len(at)) or scores(self, at, query))
    best, _ = lists.top(vectors[7], own=7)
    products = vectors @ vectors[7]
    want = [i for i in np.lexsort((np.arange(4000), -products)) if i != 7][:20]
    assert best == [(i, int(products[i])) for i in want] and len(calls) <= 4
