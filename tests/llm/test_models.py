"""Whitening, the hidden Markov model and hard negatives against brute force."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from topicloom.llm import hmm, negatives, whitening

SF_DIR = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, rank int, x string"


# Whitening.


@pytest.mark.parametrize("shift", [-3.0, 0.0, 0.5, 2.0, 7.0])
def test_inertia_counts_eigenvalues_above_a_shift(shift):
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 30):
        a = rng.normal(size=(n, n))
        a = a + a.T
        assert whitening.above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    # Zero pivots on the diagonal need blocks of two rows.
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.above(np.zeros((3, 3)), 0.0) == 0


def spectra():
    rng = np.random.default_rng(2)
    even = np.linspace(1, 20, 24)
    close = np.concatenate([[9.0, 9.0 - 1e-9, 9.0 - 2e-9], np.linspace(0.1, 3, 21)])
    tied = np.concatenate([[5.0] * 4, [2.0] * 3, np.linspace(0.1, 1, 17)])
    for values in (even, close, tied, np.array([4.0]), np.array([1e8, 1.0, 1e-3])):
        q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
        yield np.sort(values)[::-1], (q * values) @ q.T


@pytest.mark.parametrize("values,matrix", list(spectra()))
def test_slicing_finds_the_leading_spectrum(values, matrix):
    matrix = (matrix + matrix.T) / 2
    found = whitening.leading(matrix, 16)
    k = min(16, len(values))
    scale = values[0]
    assert len(found.values) == k
    assert np.allclose(found.values, np.linalg.eigvalsh(matrix)[::-1][:k], rtol=0, atol=1e-13 * scale)
    assert np.abs(found.vectors.T @ found.vectors - np.eye(k)).max() < 1e-12
    assert np.abs(matrix @ found.vectors - found.vectors * found.values).max() < 1e-12 * scale


def test_slicing_stops_at_the_rank():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(12, 3))
    assert len(whitening.leading(a @ a.T, 16).values) == 3
    assert len(whitening.leading(np.zeros((4, 4)), 16).values) == 0
    assert len(whitening.leading(np.zeros((0, 0)), 16).values) == 0


def whitened_by_hand(vectors, k):
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    width = max(map(len, x))
    x = [v + [1_000_000] * (width - len(v)) for v in x]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit, float) - mean
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return n, deviation, (np.array(x, float) - mean) @ basis / np.sqrt(values), values / (centred**2).sum() * n


def test_whitening_equals_a_dense_computation(spark):
    rng = np.random.default_rng(4)
    spread = np.array([5.0, 4.0, 3.0, 2.5, 2.0, 1.5])
    good = [list(map(float, v)) for v in (rng.normal(size=(150, 6)) * spread + 100).astype(np.float32)]
    good += good[:3] * 20 + [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 0.0, 0.0, 0.0]]
    bad = [None, [NAN] * 6, [1.0, None, 3.0, 4.0, 5.0, 6.0], [INF] * 6]
    ids = [None if i == 5 else i // 2 for i in range(len(good))]
    rows = [(i, v, 1, 2, "x") for i, v in zip(ids, good)] + [(900 + i, v, 1, 2, "x") for i, v in enumerate(bad)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(5), 4).collect()
    n, deviation, want, explained = whitened_by_hand(good, 4)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r["vec_id"], int(r["deviation"])) for r in got], key=key) == sorted(zip(ids, deviation), key=key)
    assert {r["n"] for r in got} == {n} and {r["identity_error"] for r in got} == {got[0]["identity_error"]}
    assert got[0]["identity_error"] < 1e-10
    assert np.allclose(got[0]["explained"], explained, rtol=1e-9)
    by = {int(d): w for d, w in zip(deviation, want)}
    pairs = np.array([(r["whitened"], by[int(r["deviation"])]) for r in got])
    signs = np.sign((pairs[:, 0] * pairs[:, 1]).sum(0))
    assert np.abs(pairs[:, 0] - pairs[:, 1] * signs).max() < 1e-8


def test_whitening_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(empty).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 0, 0, "")] * 3, VECTORS)
    rows = whitening.whiten(one).collect()
    assert len(rows) == 3 and all(r["whitened"] == [] and r["deviation"] == 0 for r in rows)
    bare = spark.createDataFrame([(1, [], 0, 0, ""), (2, [], 0, 0, "")], VECTORS)
    assert whitening.whiten(bare).count() == 2
    huge = spark.createDataFrame([(1, [3e38, 1.0], 0, 0, ""), (2, [-3e38, 1.0], 0, 0, "")], VECTORS)
    rows = whitening.whiten(huge).collect()
    assert [len(r["whitened"]) for r in rows] == [1, 1] and {int(r["deviation"]) for r in rows} == {2**82}


def test_whitening_query(spark):
    rows = entry.queries()["op11_whiten"](spark, SF_DIR)
    assert rows.count() == 500 * 16
    parts = rows.groupBy("component").agg(F.avg("whitened").alias("m"), F.avg(F.col("whitened") ** 2).alias("s"))
    # The given vectors are distinct, so the rows are the fit list.
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in parts.collect())
    top = rows.agg(F.max("identity_error"), F.count("deviation")).first()
    assert top[0] < 1e-9 and top[1] == 8000


# Hidden Markov model.


def dense(model):
    return model.start, model.move, (model.ratio * model.prior[:, None]).T


def by_paths(model, ids):
    """Likelihood of a sequence as a sum over all paths of states."""
    start, move, emit = dense(model)
    total = 0.0
    for path in itertools.product(range(len(start)), repeat=len(ids)):
        p = start[path[0]] * emit[path[0], ids[0]]
        for a, b, c in zip(path, path[1:], ids[1:]):
            p *= move[a, b] * emit[b, c]
        total += p
    return total


def baum_welch(model, texts):
    """Expected counts by the plain recursions, one token at a time."""
    start, move, emit = dense(model)
    k = len(start)
    starts, moves, emitted, logs = np.zeros(k), np.zeros((k, k)), np.zeros((len(model.prior), k)), 0.0
    for ids in texts:
        forward = [start * emit[:, ids[0]]]
        for c in ids[1:]:
            forward.append((forward[-1] @ move) * emit[:, c])
        back = [np.ones(k)]
        for c in ids[:0:-1]:
            back.insert(0, move @ (emit[:, c] * back[0]))
        total = forward[-1].sum()
        logs += np.log(total) - np.log(model.prior[ids]).sum()
        starts += forward[0] * back[0] / total
        for t, c in enumerate(ids):
            emitted[c] += forward[t] * back[t] / total
            if t:
                moves += np.outer(forward[t - 1], emit[:, c] * back[t]) * move / total
    return starts, moves, emitted, logs


def model_of(classes, states, seed=0):
    rng = np.random.default_rng(seed)
    prior = rng.dirichlet(np.ones(classes))
    ratio = rng.gamma(1.0, size=(classes, states)) + 0.05
    return hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), ratio / (prior @ ratio), prior)


def packed(texts):
    return np.concatenate(texts).astype(np.int32), np.cumsum([0, *map(len, texts)])


@pytest.mark.parametrize("steps", [1, 2, 3, 128])
def test_recursions_equal_the_plain_ones(steps):
    model = model_of(7, 3)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 7, n) for n in (1, 5, 2, 9, 1, 7, 12, 3)]
    ids, ends = packed(texts)
    got = hmm.Lanes(model, ids, ends, steps).expected()
    for a, b in zip(got, baum_welch(model, texts)):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-12)
    lanes = hmm.Lanes(model, ids, ends, steps)
    logs = lanes.forward(False)[2] + lanes.by_text(np.log(model.prior)[lanes.ids])
    assert np.allclose(logs, [np.log(by_paths(model, t)) for t in texts])


def test_long_texts_neither_underflow_nor_depend_on_the_parts():
    model = model_of(50, 4)
    ids, ends = packed([np.random.default_rng(2).integers(0, 50, n) for n in (20_000, 3, 700)])
    one, other = [hmm.Lanes(model, ids, ends, s).expected() for s in (128, 20_000)]
    assert np.isfinite(one[3])
    for a, b in zip(one, other):
        assert np.allclose(a, b, rtol=1e-8)


DOCS = "doc_id long, text string, held_out int, spot string, word string"


def corpus(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)] + ["Été", "ÉTÉ", "x" * 5000]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \t\n"), (63, "unseen words ABC abc"), (63, "unseen words ABC abc"),
             (None, "w1 w2 nowhere"), (64, "w3 " * 9000)]
    return rows, spark.createDataFrame([(*r, 1, "s", "w") for r in rows], DOCS)


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_base_score_and_counts(spark):
    rows, docs = corpus(spark)
    assert any(out(i) for i, _ in rows)
    learned = [t for i, t in rows if i is not None and not out(i)]
    seen = Counter(w for t in learned for w in [*words_of(t), None])
    n, v = sum(seen.values()), len(seen)
    want = []
    for i, t in rows:
        tokens = [*words_of(t), None]
        base = sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in tokens)
        want.append((str(i), out(i), len(tokens), sum(seen[w] > 0 for w in tokens), n, round(base, 6)))
    for share in (hmm.SHARE, 50):  # with many and with few words of their own
        got = hmm.score(docs.repartition(3), 2, 1, share).collect()
        assert sorted((str(r[0]), *r[1:5], round(r[5], 6)) for r in got) == sorted(want)
        assert all(r["score"] < 0 for r in got)


def test_score_is_the_likelihood_of_the_whole_text(spark):
    """The score against a plain forward recursion over words, with the model the operator trains."""
    rows, docs = corpus(spark)
    # The plain recursion underflows on the longest texts, so only the short ones are learned from.
    short = docs.filter("text IS NULL OR length(text) < 4000")
    texts = [(i, t) for i, t in rows if t is None or len(t) < 4000]
    learned = [words_of(t) for i, t in texts if i is not None and not out(i)]
    counts = Counter(w for t in learned for w in t)
    n = sum(counts.values()) + len(learned)
    own = sorted(w for w, c in counts.items() if c >= 2 and c * 50 * 32 >= n * max(32, len(w.encode())))
    of = {w: i + 1 for i, w in enumerate(own)}
    assert 0 < len(own) < len(counts)

    def kind(w):
        return of[w] if w in of else 1 + len(own) + zlib.crc32(w[-2:].encode()) % hmm.RARE

    total, kinds = Counter(), Counter()
    for w in counts:
        if w not in of:
            r = zlib.crc32(w[-2:].encode()) % hmm.RARE
            total[r] += counts[w]
            kinds[r] += 1
    every = np.array([len(learned), *[counts[w] for w in own], *[total[r] for r in range(hmm.RARE)]])
    model = hmm.first_model((every + 1) / (every.sum() + len(every)), 2)
    for _ in range(2):
        model = hmm.improved(model, *baum_welch(model, [[*map(kind, t), 0] for t in learned])[:3])
    start, move, emit = dense(model)
    want = []
    for i, t in texts:
        ids = [*map(kind, words_of(t)), 0]
        state, log = start * emit[:, ids[0]], 0.0
        for c in ids[1:]:
            log += np.log10(state.sum())
            state = (state / state.sum() @ move) * emit[:, c]
        log += np.log10(state.sum())
        for w in words_of(t):
            if w not in of:
                r = zlib.crc32(w[-2:].encode()) % hmm.RARE
                log += np.log10((counts[w] + 1) / (total[r] + kinds[r] + 1))
        want.append((str(i), round(float(log), 5)))
    got = hmm.score(short, 2, 2, 50).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 5)) for r in got) == sorted(want)


def test_training_never_loses_likelihood(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    learn = docs.filter(~hmm.held_out(F.col("doc_id")))
    vocab = hmm.vocabulary(hmm.word_counts(learn.select("text")), learn.count())
    assert abs(vocab.prior.sum() - 1) < 1e-12
    rows = hmm.encode(docs, vocab).filter("learn")
    model, logs = hmm.first_model(vocab.prior, 4), []
    for _ in range(4):
        assert np.allclose(model.prior @ model.ratio, 1)
        *counts, log = hmm.expected_counts(rows.repartition(3), model)
        weight = max(1.0, hmm.PRIOR * counts[2].sum() / 4)
        # Baum-Welch raises the likelihood with the priors.
        logs.append(log + weight * (model.prior @ np.log(model.ratio)).sum() + np.log(model.move).sum() + np.log(model.start).sum())
        model = hmm.improved(model, *counts)
    assert logs == sorted(logs)


def test_held_out_texts_score_better_than_the_base(spark):
    rows = entry.queries()["op12_hidden_markov"](spark, SF_DIR)
    r = rows.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert rows.count() == 200 and (r["s"] - r["b"]) / r["n"] > 0.15


def test_language_model_of_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert hmm.score(empty).count() == 0
    unlearned = spark.createDataFrame([(None, "a b", 1, "s", "w")], DOCS)
    row = hmm.score(unlearned).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert row["score"] < 0


# Hard negatives.


def mined_by_hand(rows, every=10, positives=5, negatives_=10):
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        kept.append((i, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v), label))
    anchors = {}
    for i, v, label in kept:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (v, label)), (v, label))
    found = []
    for a, (q, label) in anchors.items():
        scored = sorted(((-sum(x * y for x, y in zip(q, v)), i, other) for i, v, other in kept if i != a), key=lambda s: s[:2])
        for p, (s, i, _) in enumerate([s for s in scored if s[2] == label][:positives], 1):
            fit = [(n, j) for n, j, other in scored if other != label and 30 * -s <= 100 * -n <= 90 * -s][:negatives_]
            found += [(a, i, r, j, -s, -n, p) for r, (n, j) in enumerate(fit, 1)]
    return found


@pytest.mark.parametrize("bucket,anchor_bytes", [(16, 200), (64, 1 << 20), (4096, 1 << 20)])
def test_negatives_equal_brute_force(spark, bucket, anchor_bytes):
    rng = np.random.default_rng(6)
    rows = []
    centres = rng.normal(size=(5, 4))
    for i in range(300):
        v = centres[rng.integers(5)] * rng.choice([0.1, 1.0, 3.0]) + rng.normal(size=4) * 0.3
        rows.append((i, [float(np.float32(c)) for c in v], int(rng.integers(0, 4))))
    rows += [(300 + i, rows[7][1], i % 2) for i in range(100)]  # copies, a quarter of all rows
    rows += [(50, rows[3][1], 2), (50, rows[3][1], 2), (60, rows[1][1], 3), (60, None, 1), (None, [1.0] * 4, 1),
             (700, [1.0] * 4, None), (710, [1.0, NAN, 1.0, 1.0], 1), (720, [1.0, None, 1.0, 1.0], 1),
             (730, [INF] * 4, 1), (740, [], 1), (750, [2.0], 0), (760, [0.0] * 4, 0)]
    table = spark.createDataFrame([(*r, 9, "x") for r in rows], VECTORS).repartition(3)
    got = negatives.mine(table, every=10, bucket=bucket, anchor_bytes=anchor_bytes).collect()
    assert sorted(map(tuple, got)) == sorted(mined_by_hand(rows))


def test_coordinate_lists_rule_rows_out():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 3)) * 100
    v = np.floor(x / np.linalg.norm(x, axis=1, keepdims=True) * 1000).astype(np.int64)
    lists = np.argsort(negatives._unit(v, negatives._lengths(v)), axis=0, kind="stable")
    small = negatives._packed(v)
    b = negatives.Bucket({
        "n": 500, "width": 3, "item": small.itemsize, "ids": np.arange(500).tobytes(), "labels": np.zeros(500, np.int64).tobytes(),
        "v": small.tobytes(), "lists": np.ascontiguousarray(lists.T.astype(np.uint16)).tobytes(),
    })
    for q in v[:20]:
        length = float(np.sqrt((q**2).sum()))
        scores = v @ q
        for least in (-5, 300_000, 900_000, 990_000, 2_000_000):
            rows = b.feasible(q / length, length, least)
            wanted = set(np.flatnonzero(scores >= least))
            assert wanted <= set(range(500) if rows is None else rows.tolist())
            if least >= 990_000:
                assert len(rows) < 50


def test_negatives_of_an_empty_table(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.mine(empty).count() == 0
    lone = spark.createDataFrame([(0, [1.0, 2.0], 1, 1, "")], VECTORS)
    assert negatives.mine(lone).count() == 0
