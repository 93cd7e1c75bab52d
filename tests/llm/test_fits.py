"""What is fitted, against plain loops: votes, ordinal likelihood, pooled vectors, samples."""

import math
import random

import numpy as np
import pytest

from tarnwell.llm import quality_classifier, quality_rules, samples, toxicity


def _posterior_by_loops(patterns):
    """Expectation-maximisation over single texts, with the module's priors."""
    q = quality_rules
    votes = [[p // 3**i % 3 for i in range(len(q.RULES))] for p in patterns]
    good, right = q.PRIOR_GOOD, {kind: [q.PRIOR_ACCURACY] * len(q.RULES) for kind in (q.GOOD, q.BAD)}
    last = None
    for _ in range(q.ROUNDS):
        post = []
        for row in votes:
            chance = {}
            for kind, prior in ((q.GOOD, good), (q.BAD, 1 - good)):
                chance[kind] = prior
                for i, v in enumerate(row):
                    if v != q.ABSTAIN:
                        chance[kind] *= right[kind][i] if v == kind else 1 - right[kind][i]
            post.append(chance[q.GOOD] / (chance[q.GOOD] + chance[q.BAD]))
        if last and max(abs(a - b) for a, b in zip(post, last, strict=True)) < 1e-9:
            break
        last = post
        good = min(0.99, max(0.05, (sum(post) + q.PRIOR_TEXTS * q.PRIOR_GOOD) / (len(post) + q.PRIOR_TEXTS)))
        for kind in right:
            for i in range(len(q.RULES)):
                share = [p if kind == q.GOOD else 1 - p for p in post]
                hit = sum(s for s, row in zip(share, votes, strict=True) if row[i] == kind)
                said = sum(s for s, row in zip(share, votes, strict=True) if row[i] != q.ABSTAIN)
                right[kind][i] = min(0.995, max(q.LEAST_ACCURACY, (hit + q.PRIOR_TEXTS * q.PRIOR_ACCURACY) / (said + q.PRIOR_TEXTS)))
    return post


def test_posteriors_equal_plain_loops():
    draw = random.Random(3)
    kinds = [sum(draw.choice((0, 1, 2)) * 3**i for i in range(len(quality_rules.RULES))) for _ in range(12)]
    texts = [draw.choice(kinds) for _ in range(150)]
    found = quality_rules.posteriors({p: texts.count(p) for p in set(texts)})
    assert [found[p] for p in texts] == pytest.approx(_posterior_by_loops(texts), abs=1e-6)


def _ordinal_loss(rows, weights, thresholds):
    """Mean negative logarithm of the probability of each text's grade."""
    total = 0.0
    for features, grade, weight in rows:
        score = sum(weights.get(f, 0.0) for f in features)
        above = [1.0, *(1 / (1 + math.exp(c - score)) for c in thresholds), 0.0]
        total -= weight * math.log(above[grade] - above[grade + 1])
    return total + toxicity.RIDGE / 2 * sum(w * w for w in weights.values())


def test_ordinal_fit_is_at_the_least_loss():
    draw = random.Random(4)
    words = [f"{a}{b}ord" for a in "abcdefgh" for b in "xyz"]
    texts = []
    for i in range(400):
        grade = draw.choice((0, 0, 1, 2, 3))
        texts.append((" ".join(draw.choice(words[: 6 + 6 * grade]) if draw.random() < 0.8 else draw.choice(words) for _ in range(12)) + f" {i}", grade))
    model = toxicity.fit(texts, {})
    assert model.weights and list(model.thresholds) == sorted(model.thresholds)
    rows = [({f for w in t.split() for f in toxicity.features(w.encode())}, y, 1 / len(texts)) for t, y in texts]
    best = _ordinal_loss(rows, model.weights, model.thresholds)
    assert best < _ordinal_loss(rows, {}, model.thresholds)
    for _ in range(20):
        weights = {f: w + draw.choice((-0.3, 0.3)) for f, w in model.weights.items()}
        assert best <= _ordinal_loss(rows, weights, model.thresholds) + 1e-3
        assert best <= _ordinal_loss(rows, model.weights, [c + draw.choice((-0.2, 0.2)) for c in model.thresholds]) + 1e-3


def test_pooled_vectors_are_means_of_the_words():
    texts = ["The cat sat on the mat. " * 3, "A dog ran far \u001c away!"] * 5
    vectors = quality_classifier.learn_vectors(texts)
    for text in [*texts[:2], "never seen words", ""]:
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
        want = np.zeros(quality_classifier.DIMENSIONS)
        for w in words:
            for row in vectors.of_word(w.encode()):
                want += vectors.table[row]
        got = vectors.pooled(text)
        assert got[: quality_classifier.DIMENSIONS] == pytest.approx(want / max(1, len(words)), abs=1e-4)
    # Words are learned as they are scored: other kinds of space are no bounds.
    joined = quality_classifier.learn_vectors(["one\u00a0two"] * 5)
    assert all(v < len(joined.rows) for v in joined.of_word("one\u00a0two".encode()))


def test_samples_have_one_text_of_each_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b"), (3, None), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    rows, counts = samples.labelled_sample(docs, labels, "quality", 10)
    assert sorted((r["text"], r["label"]) for r in rows.collect()) == [("", 0), ("b", 0), ("text 0", 1)] and counts == {0: 2, 1: 2}


def _loss(layers, z, y, weight):
    """Weighted cross-entropy of one batch and the decay of both weight tables, row by row."""
    w1, b1, w2, b2 = layers
    total = 0.0
    for row, truth, w in zip(z, y, weight, strict=True):
        hidden = [max(0.0, sum(row[i] * w1[i][j] for i in range(len(row))) + b1[j]) for j in range(len(b1))]
        logit = sum(h * v for h, v in zip(hidden, w2, strict=True)) + float(b2)
        total += w * (math.log1p(math.exp(-abs(logit))) + max(logit, 0) - truth * logit)
    decay = quality_classifier.DECAY / 2
    return total / sum(weight) + decay * float((np.asarray(w1) ** 2).sum() + (np.asarray(w2) ** 2).sum())


def test_network_by_slopes_of_its_loss(monkeypatch):
    """The first step of training follows the loss's slopes, found by differences, and training ends with a smaller loss."""
    q = quality_classifier
    monkeypatch.setattr(q, "HIDDEN", 3)
    monkeypatch.setattr(q, "EPOCHS", 1)
    monkeypatch.setattr(q, "BATCH", 1000)
    draw = random.Random(3)
    words = {0: ["buy", "now", "cheap", "click"], 1: ["river", "stone", "quiet", "valley"]}
    rows = [(" ".join(draw.choices(words[i % 2] + ["and", "the"], k=12)), i % 2, i) for i in range(40)]
    share = {0: 2.0, 1: 1.0}
    model = q.fit(rows, share)
    x = np.array([model.vectors.pooled(t) for t, _, _ in rows], np.float64)
    z, y, weight = (x - model.mean) / model.scale, [v for _, v, _ in rows], [share[v] for _, v, _ in rows]
    rng = np.random.default_rng(q.SEED)
    d = x.shape[1]
    start = [rng.normal(0, np.sqrt(2 / d), (d, 3)), np.zeros(3), rng.normal(0, np.sqrt(1 / 3), 3), np.zeros(())]
    used = np.abs(z).sum(axis=0) > 1e-6
    for layer, (before, after) in enumerate(zip(start, model.layers, strict=True)):
        for place in list(np.ndindex(before.shape))[:: max(1, before.size // 12)]:
            if layer == 0 and not used[place[0]]:
                continue
            up, down = ([p.copy() for p in start] for _ in range(2))
            up[layer][place] += 1e-5
            down[layer][place] -= 1e-5
            slope = (_loss(up, z, y, weight) - _loss(down, z, y, weight)) / 2e-5
            # Adam's first step has the size of the rate, against the slope.
            assert float(after[place] - before[place]) == pytest.approx(-q.RATE * slope / (abs(slope) + 1e-8), rel=2e-2, abs=2e-6)
    monkeypatch.setattr(q, "EPOCHS", 60)
    assert _loss(q.fit(rows, share).layers, z, y, weight) < _loss(model.layers, z, y, weight)


def test_temperature_has_the_least_loss_on_the_fifth_that_calibrates():
    draw = random.Random(4)
    words = {0: ["buy", "now", "cheap", "click"], 1: ["river", "stone", "quiet", "valley"]}
    rows = [(" ".join(draw.choices(words[i % 2 if draw.random() < 0.8 else 1 - i % 2] + ["and", "the"], k=6)), i % 2, i // 2) for i in range(300)]
    model = quality_classifier.fit(rows, {0: 1.0, 1: 3.0})
    held = [(float(model.logits(model.vectors.pooled(t)[None, :])[0]), y) for t, y, k in rows if k % 5 == 0]

    def loss(t):
        return sum((3.0 if y else 1.0) * math.log1p(math.exp(min(700, (-v if y else v) / t))) for v, y in held)

    assert 0.5 < model.temperature < 10
    assert loss(model.temperature) <= min(loss(0.5 * 20 ** (i / 59)) for i in range(60)) + 1e-9
    assert loss(model.temperature) <= min(loss(0.5 + i / 100) for i in range(950)) * 1.001
