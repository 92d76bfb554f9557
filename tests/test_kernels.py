"""State machines and fits on arrays: values worked out by hand or by plain loops, and invariances."""

import math
from itertools import product

import numpy as np
import pytest

from tidemark.functions import kernels as K


def walk(n=240, seed=3, jump=1.0):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n) + np.repeat(rng.normal(0, 0.006, n // 40 + 1), 40)[:n] * jump))
    o = np.r_[c[0], c[:-1]]
    return {"open": o, "close": c, "high": np.maximum(o, c) * 1.004, "low": np.minimum(o, c) * 0.996, "volume": rng.uniform(1, 9, n)}


def hlc(b, n=None):
    return b["high"][:n], b["low"][:n], b["close"][:n]


def test_wilder():
    assert K.wilder(np.array([2.0, 4.0, 8.0]), 2).tolist() == [2.0, 3.0, 5.5]


def test_causal_pivots_of_a_prefix_are_a_prefix():
    b = walk()
    whole = K.causal_pivots(*hlc(b))
    assert len(whole) > 5
    for n in (2, 30, 77, 150, 239):
        part = K.causal_pivots(*hlc(b, n))
        assert part == [p for p in whole if p[2] < n]
    assert all(at <= conf for at, _, conf in whole)


def test_causal_machine_resumes_from_its_state():
    b = walk()
    a = K.CausalZigzag()
    out, state = [], None
    for i, bar in enumerate(zip(*hlc(b), strict=True)):
        m = K.CausalZigzag(state=state)
        found = m.step(*map(float, bar))
        assert found == a.step(*map(float, bar))
        out.append(found)
        state = m.state()
    assert any(out)


def test_zigzag_finds_the_turns_of_a_ramp():
    c = np.r_[np.linspace(100, 130, 30), np.linspace(129, 90, 30), np.linspace(91, 125, 30)]
    low = c - 0.5
    low[1] -= 10  # without a leg both extremes move with each bar, so only a wide bar starts the first one
    assert [p.index for p in K.zigzag(c + 0.5, low, c)] == [0, 1, 29, 59, 89]
    assert [p.index for p in K.zigzag(c + 0.5, c - 0.5, c)] == [0, 89]
    assert K.zigzag(c[:1], c[:1], c[:1]) == [K.Boundary(0, 1.0, "edge")]


def test_fusion():
    e = [K.Boundary(0, 1.0, "edge"), K.Boundary(49, 1.0, "edge")]
    two = [K.Boundary(20, 0.5, "a"), K.Boundary(22, 0.5, "b")]
    out = K.fuse([*e, *two], 50, 2, 4, 0.34, 2, 0.75)
    assert [(b.index, round(b.probability, 6), b.source) for b in out[1:-1]] == [(21, 0.75, "a+b")]
    assert len(K.fuse([*e, two[0]], 50, 2, 4, 0.34, 2, 0.75)) == 2  # one weak voice
    assert len(K.fuse([*e, K.Boundary(20, 0.8, "a")], 50, 2, 4, 0.34, 2, 0.75)) == 3  # one strong voice
    near = [K.Boundary(20, 0.8, "a"), K.Boundary(23, 0.9, "a")]
    assert [b.index for b in K.fuse([*e, *near], 50, 2, 4, 0.34, 2, 0.75)] == [0, 23, 49]  # the surer of two close ones
    assert [b.index for b in K.fuse([*e, K.Boundary(2, 0.9, "a")], 50, 1, 4, 0.34, 2, 0.75)] == [0, 49]


def test_matching_is_one_to_one():
    assert K.match([10, 11], [12], 3) == [(10, 12)]
    assert K.match([1, 10, 20], [2, 9, 30], 2) == [(1, 2), (10, 9)]


def plain_change(x, hazard, cap):
    x = np.asarray(x, float)
    m = np.median(x)
    x = (x - m) / (np.median(np.abs(x - m)) * 1.4826 + 1e-9)
    runs = {0: 1.0}
    out = []

    def density(v, past):
        k, a, b, mu = 0.25, 1.5, 1.0, 0.0
        for p in past:
            b, mu, k, a = b + k * (p - mu) ** 2 / (2 * (k + 1)), (k * mu + p) / (k + 1), k + 1, a + 0.5
        s2 = b * (k + 1) / (a * k)
        z = (v - mu) ** 2 / s2
        return math.exp(math.lgamma(a + 0.5) - math.lgamma(a)) / math.sqrt(2 * a * math.pi * s2) * (1 + z / (2 * a)) ** -(a + 0.5) + 1e-300

    for t, v in enumerate(x):
        new = {0: sum(runs.values()) * hazard * density(v, [])}
        for r, w in runs.items():
            if r + 1 <= cap:
                new[r + 1] = w * (1 - hazard) * density(v, x[t - r : t])
        total = sum(new.values())
        runs = {r: w / total for r, w in new.items()}
        out.append(runs[0])
    return np.array(out)


def test_change_probabilities_against_plain_recursion():
    x = np.r_[np.random.default_rng(0).normal(0, 1, 25), np.random.default_rng(1).normal(5, 1, 25)]
    assert np.allclose(K.change_probabilities(x, 0.04, 12), plain_change(x, 0.04, 12))


def test_detectors_find_a_regime_switch():
    r = np.r_[np.full(60, 0.003), np.full(60, -0.004)] + np.random.default_rng(2).normal(0, 2e-4, 120)
    c = 100 * np.exp(np.cumsum(r))
    found = K.structure(c * 1.001, c * 0.999, c, np.ones(120), 4)
    assert any(abs(b.index - 60) <= 3 for b in found)
    assert any(abs(b.index - 60) <= 3 for b in K.change_points(c, 0.04, 5, 0.3, 80))


def test_perturbation_is_keyed_and_valid():
    b = walk(50)
    one, two = (K.perturb(b, K.keyed_rng(7, "A", 1)) for _ in range(2))
    assert all((one[k] == two[k]).all() for k in one)
    assert (one["high"] >= np.maximum(one["open"], one["close"])).all() and (one["low"] <= np.minimum(one["open"], one["close"])).all()
    assert (K.perturb(b, K.keyed_rng(7, "A", 2))["close"] != one["close"]).any()


def test_hsmm_against_enumeration():
    rng = np.random.default_rng(4)
    prior = K.geometric_durations(["x", "y"], 3, 1, 0.5)
    d, t = np.array([prior["x"], prior["y"]]), K.transition_prior(2)
    for _ in range(10):
        e = rng.dirichlet([1, 1], 6)
        best = -np.inf
        for path in product((0, 1), repeat=6):
            cuts = [0, *[i for i in range(1, 6) if path[i] != path[i - 1]], 6]
            lengths = np.diff(cuts)
            if lengths.max() > 3:
                continue
            score = -math.log(2) + sum(math.log(e[i, s]) for i, s in enumerate(path)) + sum(math.log(d[path[c], n]) for c, n in zip(cuts, lengths, strict=False))
            if score > best:
                best, want = score, path
        got, score = K.hsmm_path(e, d, t)
        assert tuple(got) == want and abs(score - best) < 1e-9


def test_hsmm_removes_single_flips_but_keeps_blocks():
    prior = K.geometric_durations(["a", "b"], 8, 2)
    d = np.array([prior["a"], prior["b"]])
    p = np.array([[0.9, 0.1]] * 3 + [[0.45, 0.55]] + [[0.9, 0.1]] * 3)
    assert K.hsmm_path(p, d, K.transition_prior(2))[0].tolist() == [0] * 7


def test_dwell_holds_and_resets():
    out, state = K.dwell(["a", "b", "b", "b"], [False] * 4, [3, 3, 3, 3], 5)
    assert out == ["a", "a", "b", "b"] and state == ("b", 6)
    assert K.dwell(["a", "b"], [True, False], [9, 9], 5)[0] == ["UNKNOWN", "b"]
    head, state = K.dwell(["a", "b"], [False, False], [3, 3], 5)
    assert head + K.dwell(["b", "b"], [False, False], [3, 3], 5, state)[0] == out


@pytest.mark.parametrize("n", [3, 8, 9])
def test_assignment(n):
    from itertools import permutations

    cost = np.random.default_rng(n).normal(size=(n, n))
    got = K.assign(cost)
    assert sorted(got) == list(range(n))
    if n <= 8:
        assert abs(cost[range(n), got].sum() - min(cost[range(n), p].sum() for p in permutations(range(n)))) < 1e-9


def test_mixtures_find_separate_groups():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.3, (60, 2)) for m in (-4, 0, 4)])
    for m in (K.gaussian_mixture(x, 3, rng), K.process_mixture(x, 3, rng), K.full_mixture(x, 3, rng)):
        p = m.probabilities(x)
        assert m.converged and np.allclose(p.sum(axis=1), 1)
        assert len({tuple(np.unique(p[a : a + 60].argmax(axis=1))) for a in (0, 60, 120)}) == 3


def test_digamma():
    assert np.allclose(K._digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649, -1.9635100260, 2.2517525891])


def test_scaler_keeps_training_medians():
    s = K.RobustScaler(np.array([[1.0, np.inf], [3.0, np.nan], [5.0, np.nan]]))
    assert s(np.array([[np.nan, 7.0]])).tolist() == [[0.0, 7.0]]


def test_kernel_changes_are_the_optimum():
    """Against all ways to cut a short series on every fifth bar."""
    from itertools import combinations

    rng = np.random.default_rng(3)
    for n, shift in ((40, 20), (45, 25), (30, 0)):
        step = np.where(np.arange(n) < shift, 0.0, 0.05) + 0.01 * rng.normal(size=n)
        close, volume = 100 * np.exp(np.cumsum(step)), np.exp(np.where(np.arange(n) < shift, 5, 8) + 0.2 * rng.normal(size=n))
        x = np.stack([np.diff(np.log(close), prepend=np.log(close[0])), np.log1p(volume)], axis=1)
        x = (x - x.mean(axis=0)) / x.std(axis=0)
        gap = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        gram = np.exp(-np.clip(gap / np.median(gap[np.triu_indices(n, 1)]), 1e-2, 1e2))
        np.fill_diagonal(gram, 1)
        least = max(3, n // 30)

        def cost(cuts, gram=gram, n=n, least=least):
            ends = [0, *cuts, n]
            if any(b - a < least for a, b in zip(ends, ends[1:], strict=False)):
                return np.inf
            return sum(b - a - gram[a:b, a:b].sum() / (b - a) + 5.0 for a, b in zip(ends, ends[1:], strict=False))

        places = [t for t in range(5, n, 5) if t >= least]
        best = min((c for k in range(4) for c in combinations(places, k)), key=cost)
        assert [b.index + 1 for b in K.kernel_changes(close, volume)] == [t for t in best if t < n - 1]
        assert all(b.source == "ruptures" and b.probability == 0.58 for b in K.kernel_changes(close, volume))
    assert K.kernel_changes(close[:11], volume[:11]) == []


def test_density_clusters():
    from tidemark.functions.density import DensityClusters, core_distances, spanning_tree

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.3, (60, 2)), rng.normal(5, 0.3, (50, 2)), rng.normal((0, 6), 0.3, (40, 2)), rng.uniform(-20, 20, (15, 2))])
    core = core_distances(x, 5)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.allclose(core, np.sort(d, axis=1)[:, 5])
    reach = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    # Kruskal's tree has the same lengths
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    lengths = []
    for i, j in sorted(zip(*np.triu_indices(len(x), 1), strict=True), key=lambda e: reach[e]):
        if find(i) != find(j):
            root[find(i)] = find(j)
            lengths.append(reach[i, j])
    assert np.allclose(spanning_tree(x, core)[:, 2], lengths)
    c = DensityClusters(x, 5)
    blobs = [c.labels[a:b] for a, b in ((0, 60), (60, 110), (110, 150))]
    tops = [np.bincount(b[b >= 0]).argmax() for b in blobs]
    assert c.count == 3 and len(set(tops)) == 3 and all((b == t).mean() > 0.85 for b, t in zip(blobs, tops, strict=True))
    assert (c.labels[150:] < 0).mean() > 0.6 and ((c.strengths >= 0) & (c.strengths <= 1)).all() and (c.strengths[c.labels < 0] == 0).all()
    label, strength = c.predict(np.array([[0.0, 0.0], [5.0, 5.0], [0.0, 6.0], [100.0, -100.0]]))
    assert label.tolist() == [*tops, -1] and (strength[:3] > 0.3).all() and strength[3] == 0
