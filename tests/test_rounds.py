"""Choice of the boosting rounds: stubs in place of the fits, no Spark."""
import random
import threading
from dataclasses import dataclass, replace

import pytest

from tapcast.models import boosting
from tapcast.models.boosting import L1_DEPTH6, L2_DEPTH9, BoosterSpec


class Rows:
    def isEmpty(self):
        return False


@dataclass(frozen=True)
class Stub(BoosterSpec):
    """A preset whose fits know the error of every round beforehand."""
    curve: tuple = ()
    fits: tuple = ()

    def estimator(self, label, max_iter=None):
        cap = max_iter or self.max_iter
        self.fits[0].append(cap)

        class Fit:
            getNumTrees = cap

            def fit(_, rows):
                return _

            def evaluateEachIteration(_, rows, loss):
                return list(self.curve[:cap])
        return Fit()


def stub(curve, **options):
    return Stub(name="stub", curve=tuple(curve), fits=([],), **options)


def by_doubling(spec):
    """(rounds, error, caps): one fit at every doubling."""
    cap, caps = min(spec.max_iter, spec.max_rounds), []
    while True:
        caps.append(cap)
        errs = spec.curve[:cap]
        best = min(range(cap), key=lambda i: errs[i])
        if best + 1 < cap or cap >= spec.max_rounds:
            return best + 1, errs[best], caps
        cap = min(2 * cap, spec.max_rounds)


@pytest.fixture(autouse=True)
def no_trees(monkeypatch):
    monkeypatch.setattr(boosting, "prefix", lambda model, rounds: rounds)


@pytest.mark.parametrize("loss", ["absolute", "squared"])
def test_choice_is_that_of_a_fit_at_every_doubling(loss):
    rng = random.Random(7)
    for _ in range(300):
        most = rng.choice([1, 3, 20, 77, 160, 500])
        level, fall, noise = rng.choice([0.5, 5, 60]), rng.choice([0.0, 0.01, 0.1]), rng.choice([0.0, 0.001, 0.05])
        low = rng.randrange(1, 600)
        curve = [level - fall * min(i, low) + fall * max(i - low, 0) / 2 + noise * rng.random() for i in range(most)]
        spec = stub(curve, loss=loss, max_iter=rng.choice([1, 5, 20]), max_rounds=most)
        rounds, err, caps = by_doubling(spec)
        assert boosting.fit_best_rounds(spec, Rows(), Rows(), "y") == (rounds, err, rounds)
        assert spec.fits[0][0] == caps[0] and max(spec.fits[0]) <= most


def test_large_labels_do_not_take_a_fit_at_every_doubling():
    # Errors of counts around 30 fall by less than a step a round.
    spec = stub([30 - 0.04 * min(i, 500) + 0.01 * max(i - 500, 0) for i in range(10_000)])
    rounds, _, caps = by_doubling(spec)
    assert boosting.fit_best_rounds(spec, Rows(), Rows(), "y")[0] == rounds == 501
    assert sum(caps) == 1260 and spec.fits[0] == [20, 640]


def test_small_or_flattening_errors_double():
    assert boosting.next_rounds(L1_DEPTH6, [0.6 - 0.001 * i for i in range(20)]) == 40
    assert boosting.next_rounds(L1_DEPTH6, [30 + 9 * 0.5 ** i for i in range(20)]) == 40
    assert boosting.next_rounds(L2_DEPTH9, [30 - 0.01 * i for i in range(20)]) == 40
    assert boosting.next_rounds(replace(L1_DEPTH6, max_rounds=50), [30 - 0.01 * i for i in range(20)]) == 50
    assert boosting.next_rounds(L1_DEPTH6, [float("inf")]) == 2
    assert boosting.next_rounds(L1_DEPTH6, [30.0]) == 2


def test_a_refit_waits_for_its_own_origins_only(monkeypatch):
    begun = threading.Event()

    class Frame:
        pass

    class Spec(BoosterSpec):
        def estimator(self, label, max_iter=None):
            class Fit:
                def fit(_, rows):
                    if label == "a":
                        begun.set()
                    return (label, max_iter)
            return Fit()

    def choose(spec, train, valid, label):
        if label == "b":
            assert begun.wait(20), "the other target's refit has not begun"
        return {"a": 3, "b": 5}[label], 0.5, None

    monkeypatch.setattr(boosting, "fit_best_rounds", choose)
    monkeypatch.setattr(boosting, "fold", lambda rows, o: (rows, rows))
    monkeypatch.setattr(boosting, "prefix", lambda model, rounds: (*model, rounds))
    found = boosting.fit_fold_models([(Spec("s"), lab, o) for lab in "ab" for o in (1, 2)], Frame())
    assert found == {("s", lab, o): ((lab, n, n), n, 0.5) for lab, n in (("a", 3), ("b", 5)) for o in (1, 2)}
