"""The choice of the toxicity model's start bias."""

import numpy as np

from loamline.llm import choose_start


class Fixed:
    def sentences(self, text):
        return np.array([{b"a": 0.25, b"b": 1.0}[text]])

    def score(self, each):
        return float(each[0])


def test_loss_is_the_mean_log_loss():
    assert np.isclose(choose_start.loss(Fixed(), [(b"a", 0), (b"a", 1)]), -(np.log(0.75) + np.log(0.25)) / 2)
    assert np.isclose(choose_start.loss(Fixed(), [(b"b", 0)]), -np.log(1e-6), rtol=1e-3)


def test_each_fold_is_scored_by_a_model_of_the_other():
    fold = [(b"you vile worm. good day here.", 1), (b"good day here. fine words.", 0)] * 20
    got = choose_start.losses([fold, fold], (-1.0, -3.0))
    assert set(got) == {-1.0, -3.0} and all(0 <= v < 0.7 for v in got.values())
