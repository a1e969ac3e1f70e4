"""Operators 2, 6, 7 and 8 and the pipeline: against brute force, by held-out accuracy, and on odd rows."""

import random
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from ledgerloom.llm import common, near_dups, pitman_yor, quality, shingles, suffix_dedup, word_bpe
from ledgerloom.llm.shingles import shingle_set, words_of

ODD = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (None, "null id"), (None, "null id"), (1006, "z" * 5000)]


def near_copies(prose):
    """Groups of edited copies of several sizes, copies of copies, and texts of their own."""
    rnd = random.Random(4)
    rows = list(enumerate(prose(60, 80, seed=1)))
    for g, (size, most) in enumerate(((40, 5), (15, 9), (3, 2), (2, 1))):
        base = prose(1, 70 + 10 * g, seed=50 + g)[0].split()
        texts = [base]
        for _ in range(size):
            t = list(rnd.choice(texts[-5:] if g == 1 else [base]))
            for _ in range(rnd.randint(0, most)):
                t[rnd.randrange(len(t))] = f"edit{rnd.randrange(10**6)}"
            texts.append(t)
        rows += [(len(rows) + k, " ".join(t)) for k, t in enumerate(texts)]
    rows += [(len(rows) + k, rows[3][1]) for k in range(20)]
    return rows


def components(rows, words, percent):
    sets = {d: set(shingle_set(t, words).tolist()) for d, t in rows if d is not None}
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, prose, words, percent, monkeypatch):
    monkeypatch.setattr(near_dups, "FEW", 3)
    rows = near_copies(prose) + ODD
    found = near_dups.near_duplicates(docs(rows), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == components(rows, words, percent)
    assert len(found) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)
    assert [r.kept for r in found if r.doc_id is None] == [True, True]


def test_near_duplicates_of_repeated_ids_and_of_nothing(docs, prose):
    a, b, c = prose(3, 40)
    found = near_dups.near_duplicates(docs([(5, a), (5, b), (7, b), (9, c), (9, c)]), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(5, 5), (5, 5), (7, 5), (9, 9), (9, 9)]
    assert near_dups.near_duplicates(docs([]), 3, 85).count() == 0


def test_batches_to_python_are_small(spark, docs):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([batch.nbytes], pa.int64())})

    before = spark.conf.get(key, None)
    long = docs([(k, "x" * 100_000) for k in range(200)]).coalesce(1).select("doc_id", "text")
    with common.small_batches(spark):
        found = common.written(long.mapInArrow(sizes, "bytes long"), "sizes").collect()
    assert sum(r.bytes for r in found) > 200 * 100_000 and max(r.bytes for r in found) <= common.BATCH_BYTES + 200_000
    assert spark.conf.get(key, None) == before


def test_near_duplicates_get_small_batches(docs, prose, monkeypatch):
    """All that goes to Python goes in small batches: the three steps are executed inside."""
    held, seen = [], []
    written, small = near_dups.written, near_dups.small_batches

    @contextmanager
    def watched(spark):
        with small(spark):
            held.append(1)
            yield
            held.pop()

    monkeypatch.setattr(near_dups, "small_batches", watched)
    monkeypatch.setattr(near_dups, "written", lambda df, what: (held and seen.append(what), written(df, what))[1])
    near_dups.near_duplicates(docs(near_copies(prose)), 3, 85).count()
    assert seen == ["scanned", "sets", "compared"]


def test_workers_drop_what_other_operators_keep():
    shingle_set("some words", 3)
    word_bpe.encoder(public_tokenizers.path("word_bpe_49k.json"))
    list(near_dups._scan(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words of text"]})]), 3))
    assert word_bpe.encoder.cache_info().currsize == 0 and shingles._hashes
    list(near_dups._compare(iter([]), 85))
    assert not shingles._hashes


def test_passages_that_repeat(docs, prose):
    own, tails = prose(12, 60, seed=9), prose(9, 60, seed=99)
    shared, other = prose(2, 55, seed=77)
    rows = [(k, f"{t} {shared} {tails[k]}" if k in (2, 5, 8) else f"{other}\n{t}" if k in (3, 6) else t) for k, t in enumerate(own[:9])]
    rows += [(20, "start " + "round and round " * 60), (21, rows[1][1])]
    out = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs(rows + ODD)).collect()}
    given = dict(rows)
    assert all(out[k] == given[k] for k in (0, 1, 2, 3, 4, 7))
    assert words_of(out[5]) == words_of(given[5].replace(shared, "")) and words_of(out[8]) == words_of(given[8].replace(shared, ""))
    assert out[6].split() == given[6].split()[55:] and out[21] == "" and out[20].startswith("start round and round")
    assert len(out[20]) < len(given[20]) / 2 and out[1001] == "" and out[1000] is None
    found = {(r.doc_id, r.first_doc_id) for r in suffix_dedup.passages(docs(rows)).collect()}
    assert {(5, 2), (8, 2), (6, 3), (21, 1)} <= found and {d for d, _ in found} <= {5, 6, 8, 20, 21}
    assert suffix_dedup.without_repeats(docs([])).count() == 0


def test_split_runs_keep_one_copy(docs, prose, monkeypatch):
    """A passage in 30 documents: the first one keeps it. Documents 13 and 28 happen to have the same word before it, so of
    document 28 the 121 words that 13 has too go; brute force says so as well."""
    monkeypatch.setattr(suffix_dedup, "STRETCH", 4)
    shared = prose(1, 120, seed=8)[0]
    rows = [(k, f"{t} {shared}") for k, t in enumerate(prose(30, 20, seed=3))]
    assert covered(suffix_dedup.passages(docs(rows)).collect()) == repeated_words(rows)
    out = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs(rows)).collect()}
    assert out[0] == rows[0][1] and all(out[k].split() == t.split()[: 19 if k == 28 else 20] for k, t in rows[1:])


def test_minimisers_of_equal_passages_agree(prose):
    a, b, c = (np.array([hash(w) & (1 << 64) - 1 for w in t.split()], np.uint64) for t in prose(3, 100))
    one, two = np.concatenate([a, c[:50], b]), np.concatenate([b[:30], c[:50], a])
    p, q = suffix_dedup.minimisers(one), suffix_dedup.minimisers(two)
    assert {int(k) - 100 for k in p[0] if 100 <= k <= 130} & {int(k) - 30 for k in q[0] if 30 <= k <= 60}


def repeated_words(rows):
    """By brute force: (doc_id, word) of all words in windows of 50 that an earlier place has too."""
    first, out = {}, set()
    for d, t in sorted((d, t) for d, t in rows if d is not None and t):
        w = words_of(t)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), (d, k)) != (d, k):
                out |= {(d, k + j) for j in range(50)}
    return out


def covered(found):
    return {(r.doc_id, r.start + k) for r in found for k in range(r.n)}


def test_circular_passages_in_other_contexts(docs, prose):
    rows = []
    for k, (period, n) in enumerate((p, n) for p in (1, 3, 8, 12, 40) for n in (50, 55, 60, 70, 130) for _ in range(4)):
        own = prose(5, 40, seed=1000 + k, vocabulary=4000)
        words = own[4].split()[:period]
        passage = " ".join((words * n)[:n])
        rows += [(2 * k, f"{own[0]} {passage} {own[1]}"), (2 * k + 1, f"{own[2]} {passage} {own[3]}")]
    assert covered(suffix_dedup.passages(docs(rows)).collect()) == repeated_words(rows)


@pytest.mark.parametrize("stretch", [3, 2000])
def test_overlapping_variants(docs, prose, monkeypatch, stretch):
    """A, C that repeats a part of A, and D that repeats a part of C, half of which is in A, too."""
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    rnd, rows = random.Random(5), []
    for k in range(60):
        a, c, d = (t.split() for t in prose(3, 90, seed=2000 + k, vocabulary=4000))
        at, n = rnd.randint(0, 30), rnd.choice((50, 55, 60, 70))
        c[:60] = a[30:90] if k % 2 else [*c[:60]]
        c = c if k % 2 else [*c[:30], *a[at : at + 50 + k % 10], *c[30:]]
        begin = rnd.randint(0, len(c) - n)
        rows += [(10 * k, " ".join(a)), (10 * k + 1, " ".join(c)), (10 * k + 2, " ".join([*d[:30], *c[begin : begin + n], *d[30:]]))]
        rows += [(10 * k + 3, " ".join([*d[30:40], *c[max(0, begin - 9) : begin + 41], *d[50:], *a[20:75]]))]
    found = suffix_dedup.passages(docs(rows)).collect()
    assert covered(found) == repeated_words(rows) and all(r.first_doc_id <= r.doc_id for r in found)


def test_language_model(docs):
    rnd = random.Random(6)
    follow = {f"w{k}": [f"w{rnd.randrange(50)}" for _ in range(2)] for k in range(50)}

    def text():
        w = f"w{rnd.randrange(50)}"
        out = [w]
        for _ in range(30):
            out.append(w := rnd.choice(follow[w]))
        return " ".join(out)

    rows = [(k, text()) for k in range(300)] + ODD + [(7777, "never met these")]
    found = pitman_yor.score(docs(rows)).collect()
    assert len(found) == len(rows) and len({r.train_tokens for r in found}) == 1
    counts, n = {}, 0
    for d, t in rows:
        if not pitman_yor.is_held_out(d):
            for w in [*words_of(t), "end"]:
                counts[w] = counts.get(w, 0) + 1
                n += 1
    assert found[0].train_tokens == n
    by_id = {r.doc_id: r for r in found}
    for d, t in rows:
        if d is not None:
            tokens = [*words_of(t), "end"]
            assert by_id[d].n_tokens == len(tokens) and by_id[d].n_known == sum(w in counts for w in tokens)
            assert by_id[d].base_score == pytest.approx(sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in tokens))
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)
    assert all(np.isfinite(r.score) and r.score < 0 for r in found) and pitman_yor.score(docs([])).count() == 0


def plain_scores(rows, sweeps, burn_in, seating):
    """The model in plain dictionaries, with exact contexts: {place of the row: log10 probability}."""
    texts = [[*words_of(t), b"\0end"] for _, t in rows]
    learnt = {}
    for (d, _), words in zip(rows, texts):
        if not pitman_yor.is_held_out(d):
            for c, w in zip([b"\0begin", *words], words):
                learnt[c, w] = learnt.get((c, w), 0) + 1
    words, one = {w for _, w in learnt}, lambda n, weight, discount: int(seating(np.array([n]), np.array([weight]), discount, None)[0])
    rate = lambda a, b: min(0.95, max(0.1, a / (a + 2 * b))) if a else 0.5
    tables, top = dict.fromkeys(learnt, 1), dict.fromkeys(words, 1)
    customers, totals = {}, {}
    for (c, _), n in learnt.items():
        totals[c] = totals.get(c, 0) + n

    def sums():
        parent, all_tables = dict.fromkeys(words, 0), {}
        for (c, w), t in tables.items():
            parent[w] += t
            all_tables[c] = all_tables.get(c, 0) + t
        return parent, all_tables

    customers, all_tables = sums()
    discount = rate(*(sum(n == k for n in learnt.values()) for k in (1, 2)))
    parent_discount = rate(*(sum(n == k for n in customers.values()) for k in (1, 2)))
    found = []
    for s in range(sweeps + 1):
        base = (1 + parent_discount * sum(top.values())) / (len(words) + 1)
        above = lambda w: (max(customers.get(w, 0) - parent_discount * top.get(w, 0), 0) + base) / (1 + sum(customers.values()))
        if s > burn_in or s == sweeps:
            known = {w: above(w) for w in words} | {None: above(None)}
            chance = lambda c, w: (max(learnt.get((c, w), 0) - discount * tables.get((c, w), 0), 0) + (1 + discount * all_tables.get(c, 0)) * known[w if w in words else None]) / (1 + totals.get(c, 0))
            found.append([[chance(c, w) for c, w in zip([b"\0begin", *t], t)] for t in texts])
        if s < sweeps:
            weights = {w: above(w) for w in words}
            tables = {(c, w): one(n, (1 + discount * all_tables[c]) * weights[w], discount) for (c, w), n in learnt.items()}
            customers, all_tables = sums()
            top = {w: one(n, base, parent_discount) for w, n in customers.items()}
    return [float(np.log10(np.mean(p, axis=0)).sum()) for p in zip(*found)]


@pytest.mark.parametrize(("share_tokens", "sweeps", "burn_in"), [(150, 3, 1), (10**6, 2, 0), (150, 0, 0)])
def test_language_model_against_plain_sums(docs, share_tokens, sweeps, burn_in):
    """With seating that depends on weights alone: many shares with frequent words dealt out, and few."""
    rnd = random.Random(9)
    known = [f"W{k}é" for k in range(120)]
    rows = [(k, " ".join(rnd.choices(known, [1 / (r + 1) for r in range(120)], k=rnd.randint(0, 40)))) for k in range(150)] + ODD

    def seating(customers, weight, discount, rng):
        return np.where(customers > 0, 1 + ((customers - 1) * (weight / (weight + 0.3 * customers))).astype(np.int64), 0)

    found = pitman_yor.score(docs(rows), sweeps=sweeps, burn_in=burn_in, share_tokens=share_tokens, bits=64, seating=seating).collect()
    want = {(d, round(x, 7)) for (d, _), x in zip(rows, plain_scores(rows, sweeps, burn_in, seating))}
    assert {(r.doc_id, round(r.score, 7)) for r in found} == want and len(found) == len(rows)


def test_seating_keeps_to_its_bounds():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 5, 100, 100_000])
    t = pitman_yor.seat(c, np.full(len(c), 0.5), 0.6, rng)
    assert t[0] == 0 and t[1] == 1 and (t[2:] >= 1).all() and (t <= c).all()
    assert (pitman_yor.seat(c, np.full(len(c), 1e15), 0.6, rng)[1:] == c[1:]).all()


def junk(t, k):
    return " ".join((w.upper() + "!!", w + "&&&", "| " + w, "same")[k % 4] for w in t.split())


def test_quality(spark, docs, prose):
    texts = prose(240, 50, seed=2)
    rows = [(k, junk(t, k // 3) if k % 3 == 0 else t) for k, t in enumerate(texts)]
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(240)] + [(3, 0, 0), (4, 0, 1), (None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.classify(docs(rows + ODD), labels).collect()
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert len(held) > 20 and np.mean([r.predicted == int(r.doc_id % 3 != 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found) and len(found) == 240 + len(ODD)
    assert {r.doc_id for r in quality.keep_good(docs(rows), labels).collect()} == {r.doc_id for r in found if r.predicted and r.doc_id is not None and r.doc_id < 240}
    assert {r.score for r in quality.classify(docs(rows[:5]), labels.where("false")).collect()} == {0.5}
    assert quality.classify(docs([]), labels).count() == 0


def test_features_read_whole_texts():
    clean = [f"w{k}" for k in range(400)]
    at = {n: k for k, n in enumerate(quality.FEATURES)}
    f = quality.features(" ".join(clean + ["junk", "text"] * 300))
    assert f[at["top"]] == 300 / 1000 and f[at["short_period"]] == (400 + 2 + 2) / 1000
    f = quality.features(" ".join(clean * 10 + ["late"] * 1000))
    assert f[at["top"]] == 1000 / 5000 and f[at["short_period"]] == (10 * 400 + 1 + 1 + 1) / 5000


def plain_features(text):
    """The features character by character and word by word; words end at ASCII white space, other letters count as letters."""
    raw = (text or "").encode()
    words, n = raw.split(), len(raw.split())
    if not n:
        return [0.0] * 12
    is_space = lambda b: b in b" \t\n\r\x0b\x0c"
    is_letter = lambda b: b > 127 or chr(b).isalpha()
    is_mark = lambda b: not (is_space(b) or is_letter(b) or chr(b).isdigit())
    dense = max(1, sum(not is_space(b) for b in raw))
    counts = {w: words.count(w) for w in set(words)}
    letters = max(1, sum(map(is_letter, raw)))
    stretches = sum(len(set(words[k : k + 400])) for k in range(0, n, 400))
    wordless = sum(not any(map(is_letter, w)) for w in words)
    upper, digits, marks = (sum(f(b) for b in raw) for f in (lambda b: b < 128 and chr(b).isupper(), lambda b: b < 128 and chr(b).isdigit(), is_mark))
    runs = sum(is_mark(b) and a == b for a, b in zip(raw, raw[1:]))
    return [len(counts) / n, max(counts.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n, stretches / n, (upper / letters) ** 0.5, (marks / dense) ** 0.5, (runs / dense) ** 0.5, (wordless / n) ** 0.5, digits / dense, min(dense / n, 40) / 10, np.log1p(n) / 10, min(1, raw.count(b"\n") / n)]


def test_features_by_brute_force(prose):
    rnd = random.Random(12)
    texts = [None, "", " \n ", "É", "a", *prose(5, 900, seed=31, vocabulary=30)]
    texts += ["".join(rnd.choice("aB é1!!  \n-\t$") for _ in range(rnd.randint(1, 3000))) for _ in range(60)]
    for t in texts:
        assert quality.features(t) == pytest.approx(plain_features(t), abs=1e-12)


def test_ranking_minimises_the_logistic_loss_of_pairs():
    """Weights are where the loss of the drawn pairs, with its ridge, has no slope; the cut makes the fewest errors."""
    rng = np.random.default_rng(4)
    good = rng.random(300) < 0.7
    x = rng.normal(size=(300, 12)) + good[:, None] * np.linspace(0, 1.5, 12)
    found = quality.learn(x, good)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    draw = np.random.default_rng(quality.SEED)
    n = 20 * len(x)
    pairs = z[draw.choice(np.flatnonzero(good), n)] - z[draw.choice(np.flatnonzero(~good), n)]

    def loss(w):
        return np.log1p(np.exp(-pairs @ w)).sum() + 0.5e-3 * n * w @ w

    least = loss(found.weights)
    for k in range(12):
        for step in (-1e-3, 1e-3):
            other = found.weights.copy()
            other[k] += step
            assert loss(other) > least
    strength = z @ found.weights
    errors = ((strength >= found.cut) != good).sum()
    assert errors == min(((strength >= c) != good).sum() for c in [*strength, strength.max() + 1])
    assert ((found.score(x) >= quality.THRESHOLD) == (strength >= found.cut)).all()


def test_classes_of_one_list_meet_though_far_from_its_pivot(docs, prose):
    """Chains of copies, each linked to the next: those far from a pivot find the ones near it, and the other way round."""
    rnd, rows = random.Random(21), []
    for g in range(6):
        t = prose(1, 90, seed=300 + g)[0].split()
        for _ in range(25):
            rows.append((len(rows), " ".join(t)))
            for _ in range(3):
                t[rnd.randrange(len(t))] = f"edit{rnd.randrange(10**6)}"
    for words, percent in ((5, 80), (2, 60)):
        found = near_dups.near_duplicates(docs(rows), words, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(rows, words, percent)


def test_lists_without_a_class_near_their_pivot(docs, prose, monkeypatch):
    """Rounds with two pivots and more."""
    monkeypatch.setattr(near_dups, "FEW", 2)
    monkeypatch.setattr(near_dups, "PIVOTS", 2)
    rows = near_copies(prose)
    found = near_dups.near_duplicates(docs(rows), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(rows, 3, 85)


def rows_of_difference_joins(spark, before=0):
    """Rows that the joins of differences made, by Spark's own metrics, in executions after so many."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, made = store.executionsList(), 0
    for i in range(before, runs.size()):
        run = runs.apply(i).executionId()
        values, each = {}, store.executionMetrics(run).iterator()
        while each.hasNext():
            pair = each.next()
            values[pair._1()] = pair._2()
        nodes = store.planGraph(run).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = [node.metrics().apply(k) for k in range(node.metrics().size())]
            if "Join" in node.name() and "b_pivot" in node.desc():
                made += sum(int(values[m.accumulatorId()].replace(",", "")) for m in metrics if m.name() == "number of output rows" and m.accumulatorId() in values)
    return made, runs.size()


def test_links_of_a_large_group_are_not_all_listed(spark, docs, prose):
    """Copies of one text, most of them linked to others than the pivot: a few rows of the joins for each class, however
    many links there are, and the components of brute force."""
    rnd, rows = random.Random(8), []
    base = prose(1, 90, seed=500)[0].split()
    for k in range(260):
        t = list(base)
        for j in rnd.sample(range(90), rnd.choice((1, 1, 1, 6))):
            t[j] = f"edit{rnd.randrange(2 if j % 2 else 10**6)}"
        rows.append((k, " ".join(t)))
    _, before = rows_of_difference_joins(spark)
    found = near_dups.near_duplicates(docs(rows), 5, 80).collect()
    made, _ = rows_of_difference_joins(spark, before)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(rows, 5, 80)
    assert made <= 10 * len(rows)


def test_rounds_of_shares(docs, prose, monkeypatch):
    """Rounds that take a share of the pairs come to the same components, with few pairs for each row as well."""
    monkeypatch.setattr(near_dups, "CROWD", 0.01)
    monkeypatch.setattr(near_dups, "SPREAD", 4)
    rounds, merged = [], near_dups._merged
    monkeypatch.setattr(near_dups, "_merged", lambda names, links: (rounds.append(1), merged(names, links))[1])
    rows = near_copies(prose)
    found = near_dups.near_duplicates(docs(rows), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(rows, 3, 85)
    assert rounds


CLASHING = "doc_id long, text string, copy string, spans string, of_doc int, `a.b` int, row int, cut string, component_id long, n_chars int, id int, features string, n int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "c", "s", 1, 2, 3, "x", 4, len(t or ""), 5, "f", 6) for i, t in rows], CLASHING)


def test_pipeline_stages_on_odd_tables(spark, prose):
    """Names that clash or hold a dot, null ids and texts, repeated rows, an empty table: each stage keeps all columns."""
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(60)], "doc_id long, quality int, toxic int")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/odd"
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    texts = prose(60, 80, seed=40)
    good = [(k, junk(t, k // 3) if k % 3 == 0 else t) for k, t in enumerate(texts)]
    shared, *own = prose(3, 60, seed=41)
    odd = [(100, None), (101, ""), (102, texts[1]), (103, f"{shared} {own[0]}"), (104, f"{own[1]} {shared}"), (None, texts[7]), (None, texts[7]), (105, texts[8] + " more"), (105, texts[8] + " more"), (106, "z" * 30000)]
    docs = clashing(spark, good + odd)
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, docs = docs, stage(spark, docs, folder)
        assert docs.columns == before.columns and docs.schema["text"].dataType == before.schema["text"].dataType, name
        docs = docs.cache()
        kept = [(r.doc_id, r.text, r["a.b"]) for r in docs.collect()]
        assert len(kept) <= before.count() and all(x == 2 for _, _, x in kept)
        ids = [i for i, _, _ in kept]
        if name == "near_copies":
            assert 102 not in ids and 1 in ids and ids.count(105) in (0, 2) and ids.count(None) == 2
    of = {r.doc_id: r for r in docs.collect()}
    assert of[103].text.startswith(shared) and words_of(of[104].text) == words_of(own[1]) and of[104].n_chars == len(of[104].text)
    packed = corpus_pipeline.STAGES[3][1](spark, docs, folder)
    assert packed.where("doc_id is null").count() > 0 and names[3] == "packing"
    empty = clashing(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
        assert empty.count() == 0


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_copies", "repeated_passages", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        docs = docs.cache()
        kept.append(docs.select("doc_id").distinct().count())
        if name != "packing":
            assert docs.columns == before.columns and docs.count() <= before.count()
    assert kept[0] < 200 and kept[1] < kept[0] and kept[2] == kept[1] == kept[3]
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
