"""Texts whose words are looked up together are judged as one by one, and runs that the Viterbi pass takes in one step change no path."""

import numpy as np
import pytest

from lodestrata.llm import langid


def plain(scores, switch):
    """Word by word, without any short cut."""
    value, back = [0.0] * scores.shape[1], []
    for row in scores.tolist():
        top = max(value)
        back.append([k if v >= top - switch else value.index(top) for k, v in enumerate(value)])
        value = [max(v, top - switch) + s for v, s in zip(value, row, strict=True)]
    path = [value.index(max(value))]
    for source in reversed(back[1:]):
        path.append(source[path[-1]])
    return path[::-1]


def test_runs_in_one_step_change_no_path():
    rng = np.random.default_rng(7)
    for trial in range(400):
        tongues = int(rng.integers(2, 6))
        scores = rng.normal(-3, 4, size=(int(rng.integers(1, 80)), tongues))
        scores[: len(scores) // 2, trial % tongues] += 6
        scores[len(scores) // 2 :, (trial + 1) % tongues] += 6
        if trial % 2:
            scores = np.round(scores)  # ties
        best = scores.sum(axis=0).max()
        path = langid.viterbi(scores, 5.0)
        worth = lambda p, s=scores: s[np.arange(len(s)), p].sum() - 5.0 * (np.diff(p) != 0).sum()
        assert worth(path) == pytest.approx(worth(np.array(plain(scores, 5.0)))) and worth(path) >= best - 1e-9


def test_texts_together_as_one_by_one(monkeypatch):
    words = {"en": "the house and of this", "fr": "maison le dans être où", "ru": "дом и это вода где"}
    counts = [(lang, int(b), 9) for lang, text in words.items() for b in langid.trigrams(text.split())[0]]
    model = langid.Model(counts)
    odd = [None, "", "12 .", "the house", "дом " * 30 + "maison être " * 30, "the " * 300 + "вода " * 300 + "le " * 300, "x" * 90, "İstanbul the où", "the house"]
    alone = [langid.assess(t, langid.Words(model)) for t in odd]
    assert len(alone[4][3]) > 1 and alone[0][0] == alone[2][0] == "und"
    for most in (1, 200, 10**6):
        monkeypatch.setattr(langid, "TOGETHER", most)
        assert list(langid.assess_all(odd, langid.Words(model))) == alone
    assert list(langid.assess_all(odd, langid.Words(langid.Model([])))) == [("und", 0.0, 0.0, [])] * len(odd)
    assert langid.word_script("où") == "latin" and langid.word_script("ἀρχή") == "greek" and langid.word_script("вода") == "cyrillic"
