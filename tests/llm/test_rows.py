"""Operators 3, 5 and 10: against brute force."""

import random
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hilbert_ann, segment_topk, url_rules

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/es/a", "allow"), ("a.example.org", "", "block"), ("com", "/fr/", "allow"), ("example.org", "/es/", "allow"), ("Example.COM", "/d", "block")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, path = rest[:k], rest[k:]
    for c in "?#":
        path = path.split(c)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judged(url):
    host, path = split(url)
    rules = {}
    for h, p, v in RULES:
        h = h.lower()
        rules[h, p] = "block" if "block" in (v, rules.get((h, p))) else v
    fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("few", [True, False, None])
def test_urls(spark, few):
    rnd = random.Random(3)
    urls = [None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://A.Example.ORG/es/a?x#y", "x://com/fr/", "http://example.org#/es/", "http://example.org:80/es/", "http://.org/", "a://b://c.org/", "http://ÄÉ.org/x", "http://org./"]
    urls += [f"http{rnd.choice(['', 's'])}://{rnd.choice(['', 'a.', 'b.a.', 'x'])}{rnd.choice(['example.org', 'org', 'example.com', 'com', 'net'])}{rnd.choice(['/', '/es/', '/es/ab', '/fr/x', '/d', '', '?q=/es/', '/\U0010ffff'])}" for _ in range(400)]
    pages = spark.createDataFrame([(k, u, 1, "x") for k, u in enumerate(urls)] + [(None, urls[6], 1, "x"), (3, urls[3], 1, "x")], "page_id long, url string, labels int, rule string")
    found = url_rules.judge(pages, url_rules.rule_table(spark, RULES), few=few).collect()
    assert len(found) == len(urls) + 2
    for r in found:
        url = urls[6] if r.page_id is None else urls[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == judged(url), url
    assert url_rules.judge(pages.limit(0), url_rules.rule_table(spark, RULES)).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, url_rules.rule_table(spark, []), default="block").collect()} == {"block"}


def vectors(spark, n, d, seed, extra=()):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in rng.normal(size=d)]) for k in range(n)]
    rows += [(n + k, rows[3][1]) for k in range(60)]  # copies
    return [*rows, *extra], spark.createDataFrame([(i, v, 7, 0.5) for i, v in [*rows, *extra]], "vec_id long, embedding array<double>, label int, score double")


def test_exact_search(spark, monkeypatch):
    monkeypatch.setattr(segment_topk, "CANDIDATES", 70)
    monkeypatch.setattr(segment_topk, "QUERIES", 3)
    odd = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 20), (903, [float("inf")] * 20), (904, [1.0, -1.0]), (905, []), (906, [0.0] * 20), (None, [1.0] * 20)]
    large = [(907, [1e300] * 20), (950, [-1e300] * 19 + [0.3]), (908, [3e8 + 0.25] * 20), (909, [2.0**60, *[0.1] * 19]), (2**53 + 1, [0.5] * 20), (2**53 + 2, [0.5] * 20)]
    rows, frame = vectors(spark, 150, 20, 1, odd + large)
    fits = [(i, v) for i, v in rows if i is not None and (i < 900 or i >= 904)]
    whole = {i: [floor(Fraction(x) * 256) for x in (v + [0.0] * 20)[:20]] for i, v in fits}
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], x)), i) for i, x in whole.items() if i != q)[:5]
        want |= {(q, k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best)}
    found = segment_topk.search(frame.union(frame.where("vec_id = 3")), F.col("vec_id") % 50 == 0, 5)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert segment_topk.search(frame.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_rows_of_one_id_count_once(spark):
    """More rows of one id at the top than there are places."""
    rows = [(0, [1.0, 0.0])] + [(1, [50.0 + k, 0.0]) for k in range(40)] + [(k, [float(k), 0.0]) for k in range(2, 10)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = segment_topk.search(frame, F.col("vec_id") == 0, 5, scale=1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 89), (9, 9), (8, 8), (7, 7), (6, 6)]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(20, 37)), rng.normal(size=(90, 37))
    turn = segment_topk.axes(x)
    assert np.allclose((q @ turn) @ (x @ turn).T, q @ x.T)
    for n in (16, 4, 2):
        assert (segment_topk.statistics(q, n) @ segment_topk.statistics(x, n).T >= q @ x.T - 1e-9).all()
        assert (segment_topk.statistics(q @ turn, n) @ segment_topk.statistics(x @ turn, n).T >= q @ x.T - 1e-9).all()


def survivors(x, k=5):
    """Shares of the pairs of queries and candidates that are left after each level; the results are those of brute force."""
    ids = np.arange(len(x))
    block, found = segment_topk.Block(ids, x), {}
    for query, vecs, scores in block.search(ids[::50], x[::50], k):
        found[query] = [(int(v), int(s)) for v, s in zip(vecs, scores)]
    for q in range(0, len(x), 50):
        scores = x @ x[q]
        assert found[q] == [(i, int(scores[i])) for i in np.lexsort((ids, -scores)) if i != q][:k]
    return block.alive[1:] / block.alive[0]


def test_bounds_prune():
    """Clusters and directions of unlike weight leave nearly nothing to compare in full; even spread leaves less than all."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(50, 64))
    clustered = survivors(np.floor(256 * (centres[rng.integers(0, 50, 6000)] + 0.1 * rng.normal(size=(6000, 64)))))
    assert clustered[1] < 0.5 and clustered[2] < 0.01
    unlike = survivors(np.floor(256 * (rng.normal(size=(6000, 64)) @ (rng.normal(size=(64, 64)) * 0.8 ** np.arange(64)[:, None]))))
    assert unlike[0] < 0.5 and unlike[2] < 0.02
    assert survivors(np.floor(256 * rng.normal(size=(6000, 64))))[2] < 0.5


@pytest.mark.parametrize("most", [(50_000, 20_000), (40, 2)])
def test_near_search_in_shares(spark, monkeypatch, most):
    """Blocks and their queries in one share, and in several."""
    monkeypatch.setattr(hilbert_ann, "BLOCK_ROWS", most[0])
    monkeypatch.setattr(hilbert_ann, "QUERY_ROWS", most[1])
    rows, frame = vectors(spark, 300, 12, 8)
    found = hilbert_ann.search(frame, F.col("vec_id") % 20 == 0, 5, blocks=2).collect()
    known = {i: np.array(v) for i, v in rows}
    for q in (i for i in known if i % 20 == 0):
        best = [i for _, i in sorted((-(known[q] @ x), i) for i, x in known.items() if i != q)[:5]]
        assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == best


def test_near_search(spark):
    odd = [(900, None), (901, [1.0, None]), (902, [0.0] * 24), (903, [float("inf")] * 24), (None, [1.0] * 24)]
    rows, frame = vectors(spark, 600, 24, 5, odd)
    known = {i: np.array(v) for i, v in rows if i is not None and i < 900}
    found = hilbert_ann.search(frame, F.col("vec_id") % 20 == 0, 20).collect()
    got: dict[int, list] = {}
    for r in sorted(found, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    assert set(got) == {i for i in known if i % 20 == 0}
    hits = []
    for q, rows in got.items():
        assert [x[2] for x in rows] == list(range(1, 21)) and [(-s, v) for v, s, _ in rows] == sorted((-s, v) for v, s, _ in rows)
        assert all(s == pytest.approx(known[q] @ known[v]) and v != q for v, s, _ in rows)
        best = {i for _, i in sorted((-(known[q] @ x), i) for i, x in known.items() if i != q)[:20]}
        hits.append(len(best & {v for v, _, _ in rows}) / 20)
    assert np.mean(hits) >= 0.9
    assert hilbert_ann.search(frame.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_hilbert_neighbours_touch():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert_ann.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    ordered = cells[np.argsort(keys)]
    assert (np.abs(np.diff(ordered, axis=0)).sum(axis=1) == 1).all()
