"""The fit against the likelihood as it is defined, worked out row by row."""

import math
import random

from grovetable.llm import toxicity


def clear(rows, feature):
    """Standard errors of a feature's log odds from zero, half a row added to each cell."""
    n = {(has, bad): 0.5 for has in (True, False) for bad in (True, False)}
    for grade, features in rows:
        n[feature in features, grade > 0] += 1
    odds = math.log(n[True, True] * n[False, False] / (n[True, False] * n[False, True]))
    return abs(odds) / math.sqrt(sum(1 / x for x in n.values()))


def loss(rows, weights, thresholds, share, ridge):
    """Weighted mean negative log likelihood and the penalty."""
    total = 0.0
    for grade, features in rows:
        score = sum(weights.get(f, 0.0) for f in features)
        upto = [0.0, *(1 / (1 + math.exp(score - t)) for t in thresholds), 1.0]
        total -= share[grade > 0] * math.log(max(1e-12, upto[grade + 1] - upto[grade]))
    return total + sum(ridge[f] * w * w / 2 for f, w in weights.items())


def test_no_step_from_the_fit_lowers_the_loss():
    draw = random.Random(4)
    rows = []
    for _ in range(600):
        bad = draw.random() < 0.2
        grade = (2 if draw.random() < 0.5 else 1) if bad else 0
        # 0 and 1 tell toxic rows apart, 50 does so weakly, 60 not at all
        features = [f for f, p in ((0, 0.1 + 0.5 * bad), (1, 0.05 + 0.25 * grade), (50, 0.2 + 0.07 * bad), (60, 0.3)) if draw.random() < p]
        rows.append((grade, features))
    n = sum(g > 0 for g, _ in rows)
    share = {True: 0.5 / n, False: 0.5 / (len(rows) - n)}  # both kinds count the same
    model = toxicity.fit_ordinal(rows, 3, rounds=1_500, penalty=0.01)
    sure = {f: clear(rows, f) for f in (0, 1, 50, 60)}
    ridge = {f: 0.01 if z >= toxicity.SURE else 0.01 * toxicity.HEAVY for f, z in sure.items()}
    assert set(model.weights) == {f for f, z in sure.items() if z >= toxicity.UNSURE} and set(ridge.values()) == {0.01, 0.01 * toxicity.HEAVY}
    assert model.thresholds == sorted(model.thresholds)
    at = loss(rows, model.weights, model.thresholds, share, ridge)
    for step in (-0.05, 0.05):
        for f in model.weights:
            assert loss(rows, {**model.weights, f: model.weights[f] + step}, model.thresholds, share, ridge) > at - 1e-6
        for k in range(2):
            moved = [t + step * (i == k) for i, t in enumerate(model.thresholds)]
            assert loss(rows, model.weights, moved, share, ridge) > at - 1e-6


def test_one_kind_of_rows_and_none():
    assert toxicity.fit_ordinal([], 3).thresholds == [0.0, 0.0]
    only = toxicity.fit_ordinal([(1, [3]), (2, [4])] * 20, 3)
    assert all(math.isfinite(x) for x in [*only.thresholds, *only.weights.values()])
