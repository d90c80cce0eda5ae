"""The language model's tokens are cut and looked up for a block of texts at once, each distinct token once."""

from itertools import chain

import numpy as np
import pyarrow as pa

from lodestrata.llm import language_model

TEXTS = [None, "", " ", "a", "\n A\x1cb É\xa0X  ", "end", " end", "x\t\n\x0b\x0c\r y", "ab " * 50, "ÀB ab AB Ab", " a  \x00 b"]


def batch(texts):
    return pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def test_cut_follows_the_token_rule():
    for texts in (TEXTS, TEXTS[3:4], TEXTS[:3], TEXTS[::-1]):
        distinct, tokens, sizes = language_model.cut(batch(texts).column(1))
        want = [[*language_model.words_of(t), language_model.END] for t in texts]
        assert [distinct[k] for k in tokens.tolist()] == list(chain.from_iterable(want))
        assert sizes.tolist() == list(map(len, want))
        assert len(set(distinct)) == len(distinct)


def test_blocks_keep_all_rows_and_bound_their_text():
    for most in (1, 40, 10**6):
        parts = list(language_model.text_blocks([batch(TEXTS[:4]), batch(TEXTS[4:]), batch([])], most))
        assert [t for p in parts for t in p.column(1).to_pylist()] == TEXTS
        assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= most for p in parts)
        cut = [[d[k] for k in t.tolist()] for d, t, _ in (language_model.cut(p.column(1)) for p in parts)]
        assert list(chain.from_iterable(cut)) == list(chain.from_iterable([*language_model.words_of(t), language_model.END] for t in TEXTS))


def test_gates_by_exp_equal_tanh():
    net = language_model.Network((np.random.default_rng(3).normal(size=language_model.Network.size()) * 30).astype(np.float64))
    n, w = language_model.HIDDEN, net.w
    x, first = np.array([[5, 9], [7, 2], [1, 1]]), np.array([[True, True], [False, True], [False, False]])
    states, _, _ = net.forward(x, first, np.ones((2, n)))
    h = np.ones((2, n))
    for t in range(3):
        h = np.where(first[t][:, None], 0, h)
        xw, hw = w["E"][x[t]] @ w["Wx"] + w["b"], h @ w["Wh"]
        z, r = ((1 + np.tanh((xw + hw)[:, k * n : (k + 1) * n] / 2)) / 2 for k in (0, 1))
        c = np.tanh(xw[:, 2 * n :] + r * hw[:, 2 * n :])
        h = c + z * (h - c)
        assert np.allclose(states[t], h, atol=1e-9)
