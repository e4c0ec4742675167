"""The two classifiers: held-out accuracy, whole texts, fairness, odd rows."""
from __future__ import annotations

import re

import numpy as np

from quillspark.llm import byte_network, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def rates(spark, name, label):
    rows = queries.QUERIES[name](spark, FOLDER).filter("held_out").join(
        spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").select(label, "predicted", "score").collect()
    scores, marks = np.array([r.score for r in rows]), np.array([r[label] for r in rows])
    ranks = scores.argsort().argsort()
    ones = marks.sum()
    area = (ranks[marks == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(marks) - ones))
    return np.mean([r.predicted == r[label] for r in rows]), area


def test_held_out_toxicity(spark):
    accuracy, area = rates(spark, "op4_counterfactual_toxicity", "toxic")
    assert accuracy > 0.9 and area > 0.9


def test_held_out_quality(spark):
    accuracy, area = rates(spark, "op10_byte_network", "quality")
    assert accuracy > 0.93 and area > 0.93


def test_swapping_terms_changes_scores_less():
    rng = np.random.default_rng(0)
    rows, marks = [], []
    for i in range(400):
        bad = i % 2
        term = "women" if rng.random() < (0.9 if bad else 0.1) else "men"
        noise = " ".join(f"w{rng.integers(300)}" for _ in range(12))
        rows.append(f"{noise} {term} {'vilest' if bad and rng.random() < 0.8 else 'fine'}".encode())
        marks.append(bad)
    features = [toxicity.features_of([r])[1] for r in rows]
    pairs = [d for r in rows for d in toxicity.differences(r, ("women", "men"))]

    def gap(fairness):
        weights, _ = toxicity.fit(features, np.array(marks, float), pairs, fairness=fairness, sparse=1e-3)
        of = [weights[toxicity.features_of([t.encode()])[1]].sum() for t in ("women", "men")]
        bad = weights[toxicity.features_of([b"vilest"])[1]].sum()
        return abs(of[0] - of[1]), bad

    free, fair = gap(0.0), gap(1.0)
    assert fair[0] < 0.2 * free[0] and fair[1] > 0.5


def test_terms_are_whole_words_and_each_is_swapped():
    terms = ("women", "men", "black")
    assert toxicity.counterfactuals(b"No term: blacklist omen men\xc3\xa9 womens", terms)[0][1].endswith(
        tuple(b" " + t.encode() for t in terms))
    for text, held in ((b"Women and MEN; women.", {b"women", b"men"}), (b"black-listed black", {b"black"})):
        pairs = toxicity.counterfactuals(text, terms)
        assert len(pairs) == len(held)
        gone = {w for one, two in pairs for w in held
                if w in re.findall(rb"[a-z]+", one) and w not in re.findall(rb"[a-z]+", two)}
        assert gone == held and all(one == text.lower() for one, _ in pairs)
    put, swap = toxicity.counterfactuals(b"nothing", terms)
    assert put[0] == b"nothing" and swap[0] == put[1] and swap[1] != put[1]
    assert toxicity.counterfactuals(b"x", ()) == []
    # what another word of the text still has, is not taken away
    text = b"black blackbird"
    (before, after), = toxicity.counterfactuals(text, terms)
    shared = set(toxicity.features_of([b"blackbird"])[1])
    assert not shared & {-d - 1 for d in toxicity.differences(text, terms)[0].tolist() if d < 0}
    assert b"blackbird" in after and before == text


def test_slopes_and_least_loss_of_the_fair_model():
    texts = [b"bad women here", b"bad thing here", b"good men there", b"good thing there", b"bad good men", b"there here"] * 3
    marks = np.array([1, 1, 0, 0, 1, 0] * 3, float)
    rows = [toxicity.features_of([t])[1] for t in texts]
    pairs = [d for t in texts for d in toxicity.differences(t, ("women", "men"))]
    used = sorted({*np.concatenate(rows).tolist(), *(np.abs(np.concatenate(pairs)) - 1).tolist()})
    dense, change = np.zeros((len(rows), len(used))), np.zeros((len(pairs), len(used)))
    for i, r in enumerate(rows):
        dense[i, np.searchsorted(used, r)] = 1
    for i, d in enumerate(pairs):
        change[i, np.searchsorted(used, np.abs(d) - 1)] = np.sign(d)

    def loss(w, b):
        z = dense @ w + b
        return np.mean(np.log1p(np.exp(z)) - marks * z) + 0.7 * ((change @ w) ** 2).sum() / len(rows)

    x = toxicity._Rows([np.searchsorted(used, r) for r in rows])
    pair_rows = toxicity._Rows([np.searchsorted(used, np.abs(d) - 1) for d in pairs], [np.sign(d) for d in pairs])
    w, b = np.random.default_rng(0).normal(size=len(used)), 0.3
    got, slopes, tilt = toxicity.loss_and_slopes(w, b, x, marks, pair_rows, 0.7)
    assert abs(got - loss(w, b)) < 1e-9
    for i in range(len(used)):
        step = np.eye(len(used))[i] * 1e-5
        assert abs((loss(w + step, b) - loss(w - step, b)) / 2e-5 - slopes[i]) < 1e-6
    assert abs((loss(w, b + 1e-5) - loss(w, b - 1e-5)) / 2e-5 - tilt) < 1e-6
    # fit() reaches what plain proximal steps on the dense rows reach; its weights are scaled at the end
    plain, offset = np.zeros(len(used)), float(np.log((marks.sum() + .5) / (len(marks) + 1 - marks.sum() - .5)))
    for _ in range(20_000):
        z = 1 / (1 + np.exp(-(dense @ plain + offset))) - marks
        to = plain - 0.3 * (dense.T @ z / len(rows) + 2 * 0.7 * change.T @ (change @ plain) / len(rows))
        plain, offset = np.sign(to) * np.maximum(np.abs(to) - 0.3 * 0.01, 0), offset - 0.3 * z.mean()
    full, shift = toxicity.fit(rows, marks, pairs, steps=3000, sparse=0.01, fairness=0.7)
    scale, extra = toxicity.rescaled(dense @ plain + offset, marks, (marks.sum() + .5) / (len(marks) + 1))
    assert np.allclose(dense @ full[used] + shift, scale * (dense @ plain + offset) + extra, atol=0.02)


ODD = [(1, None), (2, ""), (3, " \n"), (4, "plain words"), (4, "plain words"), (None, "no key"), (5, "x" * 50_000),
       (6, "IDIOT!! you utter idiot")]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(k, t, 9) for k, t in ODD], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 7)] + [(4, None, None), (None, 1, 1), (99, 0, 0)],
                                   "doc_id bigint, quality int, toxic int")
    for use in (labels, labels.limit(0), labels.filter("toxic = 1")):
        got = toxicity.scored(docs, use).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
        net = byte_network.fitted(docs, use)
        got = byte_network.scored(docs, net).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.scored(docs.limit(0), labels).count() == 0
    assert byte_network.scored(docs.limit(0), byte_network.fitted(docs, labels)).count() == 0


def test_chunks_cover_every_byte():
    for n in (0, 1, 31, 32, 33, 224, 255, 256, 257, 480, 481, 1000):
        text = bytes(i % 251 + 1 for i in range(n))
        chunks, owner = byte_network.chunks_of([b"abc", text])
        own = chunks[owner == 1]
        step = byte_network.CHUNK - byte_network.OVERLAP
        seen = bytearray(len(own) * step + byte_network.OVERLAP)
        for i, c in enumerate(own):
            seen[i * step:i * step + byte_network.CHUNK] = c.tobytes()
        assert bytes(seen[:n]) == text and not any(seen[n:])


def test_gradients():
    net = byte_network.Network(3)
    # Random bytes: places that tie for a maximum would have no gradient.
    texts = [np.random.default_rng(i).integers(32, 127, 150 * i).astype(np.uint8).tobytes() for i in (1, 2, 5)]
    marks = np.array([1.0, 0.0, 1.0])
    weights = np.full(3, 1 / 3)

    def loss():
        p = net.scores(texts)
        return -np.sum(weights * (marks * np.log(p) + (1 - marks) * np.log(1 - p)))

    grads = net.gradients(texts, marks, weights)
    rng = np.random.default_rng(0)
    for values, grad in zip(net.parameters(), grads):
        for i in rng.integers(0, values.size, 6):
            old, step = values.flat[i], 2e-3
            values.flat[i] = old + step
            up = loss()
            values.flat[i] = old - step
            down = loss()
            values.flat[i] = old
            assert abs((up - down) / (2 * step) - grad.flat[i]) < 2e-3
