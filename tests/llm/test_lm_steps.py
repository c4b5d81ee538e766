"""The steps of the language model that take most time, against their plain forms."""

import numpy as np
import pyarrow as pa

from cuecraft.llm import lm


def _vocabulary(hashes, n=5):
    top = pa.table({"word": np.array(hashes, np.uint64).view(np.int64), "n": np.arange(len(hashes), 0, -1), "code": np.arange(len(hashes), dtype=np.int32)})
    endings = pa.table({"code": np.arange(64, dtype=np.int32), "n": np.full(64, 1000), "words": np.full(64, n)})
    return lm.Vocabulary(top, endings)


def test_words_are_looked_up_by_the_beginning_of_their_hash():
    crowded = [(7 << int(lm.SHIFT)) + k for k in (0, 1, 5, 9)]
    hashes = [3, *crowded, (1 << 63) + 17, (1 << 64) - 1]
    vocabulary = _vocabulary(hashes)
    assert len(vocabulary.start) == 1 << 64 - int(lm.SHIFT)
    asked = np.array([*hashes, 0, 4, crowded[0] + 2, crowded[-1] + 1, 1 << 62, (1 << 64) - 2], np.uint64)
    count, symbol = vocabulary.look_up(asked, np.zeros(len(asked), np.int32))
    assert count.tolist() == [*range(len(hashes), 0, -1), *[-1] * 6] and symbol[: len(hashes)].tolist() == list(range(len(hashes)))


def test_outputs_equal_a_plain_softmax():
    rng = np.random.default_rng(5)
    for scale in (1, 400):  # large weights too
        p = lm.initial(_vocabulary(range(1, 60)))
        p = {k: (v + scale * rng.normal(0, 0.2, v.shape)).astype(np.float64) for k, v in p.items()}
        symbol = rng.integers(0, lm.BEGIN, 300)
        h = np.tanh(rng.normal(0, 1, (300, lm.HIDDEN)))

        def plain(h):
            logs = np.zeros(len(h))
            for i, s in enumerate(symbol):
                kind, place = (s % lm.CLASSES, s // lm.CLASSES) if s < lm.CLASSES * lm.WORDS else (s - lm.CLASSES * lm.WORDS + lm.CLASSES, None)
                for w, b, at in [(p["c"], p["cb"], kind)] + ([(p["w"][kind], p["wb"][kind], place)] if place is not None else []):
                    a = h[i] @ w + b
                    logs[i] += a[at] - a.max() - np.log(np.exp(a - a.max()).sum())
            return logs

        grads = {k: np.zeros_like(v) for k, v in p.items()}
        found, back = lm.outputs(p, h, symbol, grads)
        assert np.allclose(found, plain(h)) and np.allclose(lm.outputs(p, h, symbol)[0], found)
        step = 1e-6 * rng.normal(0, 1, h.shape)
        assert np.allclose(plain(h) - plain(h + step), (back * step).sum(1), rtol=1e-3, atol=1e-8)  # the gradient is of the negative logarithm


def test_windows_of_states_equal_plain_steps():
    rng = np.random.default_rng(6)
    p = {k: (3 * v).astype(np.float32) for k, v in lm.initial(_vocabulary(range(1, 60))).items()}
    before, h = rng.integers(0, lm.BEGIN + 1, (9, 5)), rng.normal(0, 0.3, (5, lm.HIDDEN)).astype(np.float32)
    carried = (rng.random((9, 5, 1)) > 0.3).astype(np.float32)
    begins = (carried == 0).any((1, 2))
    states, z, r, n, by_state = lm.Recurrence(p).run(before, h, begins, carried)
    for t in range(9):
        h = h * carried[t]
        a, b = np.split(p["x"][before[t]], 3, axis=1), np.split(h @ p["u"], 3, axis=1)
        want_z, want_r = (1 / (1 + np.exp(-a[k] - b[k])) for k in (0, 1))
        want_n = np.tanh(a[2] + want_r * b[2])
        h = (1 - want_z) * want_n + want_z * h
        for got, want in ((z, want_z), (r, want_r), (n, want_n), (by_state, b[2]), (states, h)):
            assert np.allclose(got[t], want, atol=1e-5)
    assert not lm.Recurrence(p).run(before[:0], h, begins[:0], carried[:0])[0].size
