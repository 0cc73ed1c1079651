"""The network's figures by the plain formula, in two softmaxes a batch however many groups it has."""

from __future__ import annotations

import numpy as np

from pageweave.llm import scoring


def some(n=3000):
    rng = np.random.default_rng(4)
    return rng.integers(0, scoring.CLASSES + 1, (n, 2 * scoring.SIDE)), rng.integers(0, scoring.CLASSES, n)


def plain(net, around, target):
    h = np.tanh(sum(net.enter[k][around[:, k]].astype(float) for k in range(2 * scoring.SIDE)))
    g, m = np.divmod(target, scoring.GROUPS)
    z, y = h @ net.out + net.bias, np.einsum("nw,nwg->ng", h, net.inner[g]) + net.inner_bias[g]
    at = np.arange(len(target))
    return z[at, g] - np.log(np.exp(z).sum(1)) + y[at, m] - np.log(np.exp(y).sum(1))


def test_log_probability_by_the_plain_formula():
    around, target = some()
    net = scoring.Network()
    assert np.allclose(net.log_probability(around, target), plain(net, around, target), atol=1e-4)
    assert len(net.log_probability(around[:0], target[:0])) == 0


def test_training_lowers_the_loss_in_two_softmaxes_a_batch(monkeypatch):
    around, target = some()
    target = around[:, 0] % scoring.CLASSES
    net, calls, real = scoring.Network(), [], scoring.Network._exponentials
    before = plain(net, around, target).mean()
    monkeypatch.setattr(scoring.Network, "_exponentials", staticmethod(lambda z: calls.append(len(z)) or real(z)))
    net.train(around, target, 0.5)
    assert len(calls) == 2
    assert plain(net, around, target).mean() > before


def test_a_step_follows_the_gradient():
    around, target = some(40)
    net = scoring.Network()
    old, rng = scoring.Network(net.flat.copy()), np.random.default_rng(2)
    net.train(around, target, 1.0)
    step = old.flat.astype(float) - net.flat
    way = rng.normal(0, 1, len(step))
    ahead, behind = (scoring.Network((old.flat + s * 1e-3 * way).astype(np.float32)) for s in (1, -1))
    slope = (plain(behind, around, target).mean() - plain(ahead, around, target).mean()) / 2e-3
    assert np.isclose(step @ way, slope, rtol=0.02, atol=2e-3)
