"""Baum-Welch counts against all state paths, and a likelihood that never falls."""

import itertools

import numpy as np
import pytest

from seqprep.llm import hmm_lm


def paths(symbols, lengths, model):
    """Expected emissions, transitions, starts and the log likelihood, by every path of every document."""
    a, b, start = model["move"], model["emit"], model["start"]
    k = len(a)
    emissions, moves, firsts, log = np.zeros_like(b), np.zeros_like(a), np.zeros((2, k)), 0.0
    for at, n in zip(np.cumsum(lengths) - lengths, lengths):
        seq = symbols[at : at + n]
        weights = {}
        for path in itertools.product(range(k), repeat=int(n)):
            p = start[0][path[0]] * b[seq[0], path[0]]
            for t in range(1, n):
                p *= a[path[t - 1], path[t]] * b[seq[t], path[t]]
            weights[path] = p
        total = sum(weights.values())
        log += np.log(total)
        for path, p in weights.items():
            firsts[0, path[0]] += p / total
            for t, state in enumerate(path):
                emissions[seq[t], state] += p / total
                if t:
                    moves[path[t - 1], state] += p / total
    return emissions, moves, firsts, log


@pytest.mark.parametrize("seed", range(4))
def test_expected_counts_against_all_paths(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 7, 5)
    symbols = r.integers(0, 6, lengths.sum())
    model = hmm_lm.first_model(6, 3, seed)
    got, want = hmm_lm.expected_counts(symbols, lengths, model), paths(symbols, lengths, model)
    for g, w in zip(got[:3], want[:3]):
        assert np.allclose(g, w)
    assert got[3] == pytest.approx(want[3])
    assert hmm_lm.likelihood(symbols, lengths, model).sum() == pytest.approx(want[3])


def test_likelihood_never_falls():
    r = np.random.default_rng(9)
    lengths = r.integers(1, 300, 30)
    symbols = np.concatenate([(np.arange(n) // 3 + r.integers(0, 2, n)) % 11 for n in lengths])
    model, last = hmm_lm.first_model(11, 4), -np.inf
    for _ in range(25):
        emissions, moves, firsts, log = hmm_lm.expected_counts(symbols, lengths, model)
        assert log >= last - 1e-9 * abs(log)
        last = log
        model = {"emit": emissions / emissions.sum(axis=0), "move": moves / moves.sum(axis=1, keepdims=True), "start": firsts / firsts.sum(axis=1, keepdims=True)}
