"""Each gate's numbers lie together, and a whole window gives the states and gradients of a plain walk."""

import numpy as np
import pytest

from meridian.llm import gru_lm

H = gru_lm.HIDDEN


def test_gates_lie_apart():
    """Steps work on whole pieces of memory instead of a third of each row (training took about 1.6 times the CPU time)."""
    net = gru_lm.Network([1, 3, 2])
    gx, plain = net.inputs(), net.p["E"] @ net.p["Wx"] + net.p["b"]
    assert gx.shape == (3, net.n_codes, H) and gx.flags.c_contiguous
    for k, sign in enumerate((-1, -1, 1)):
        assert gx[k] == pytest.approx(sign * plain[:, k * H : (k + 1) * H], abs=1e-5)


def test_window_against_a_plain_walk():
    """Documents that begin amid the window, and codes that occur often and never."""
    net = gru_lm.Network([1, 3, 2, 40], seed=2)
    rng = np.random.default_rng(6)
    net.p = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.1 for k, v in net.p.items()}
    p, shape = net.p, (gru_lm.STEPS, 40)
    x = np.minimum(rng.geometric(0.15, shape), net.n_codes - 2)
    fresh, start = (rng.random(shape) < 0.1).astype(np.float64), rng.standard_normal((40, H)) * 0.3
    given, h, walk = start.copy(), start, []
    for t in range(len(x)):
        h = h * (1 - fresh[t])[:, None]
        a, u = p["E"][x[t]] @ p["Wx"] + p["b"], h @ p["Wh"]
        z, r = (1 / (1 + np.exp(-(a + u)[:, k * H : (k + 1) * H])) for k in (0, 1))
        n = np.tanh(a[:, 2 * H :] + r * u[:, 2 * H :])
        walk.append((h, z, r, n, u[:, 2 * H :]))
        h = (1 - z) * n + z * h
    s = net.states(x, given, fresh)
    assert s == pytest.approx(np.array([w[0] for w in walk]), abs=1e-9) and net.last == pytest.approx(h, abs=1e-9)
    _, ds, _ = net.logs(s.reshape(-1, H), x.ravel(), True)
    want, dh = {k: np.zeros_like(p[k]) for k in ("E", "Wx", "Wh", "b")}, np.zeros_like(h)
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, u = walk[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz, dr = dh * (h - n) * z * (1 - z), dn * u * r * (1 - r)
        da, du = np.hstack([dz, dr, dn]), np.hstack([dz, dr, dn * r])
        want["Wh"] += h.T @ du
        want["Wx"] += p["E"][x[t]].T @ da
        want["b"] += da.sum(0)
        np.add.at(want["E"], x[t], da @ p["Wx"].T)
        dh = (dh * z + du @ p["Wh"].T + ds.reshape(s.shape)[t]) * (1 - fresh[t])[:, None]
    got = net.gradients(x, x, fresh, given)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k
    assert (given == start).all()
