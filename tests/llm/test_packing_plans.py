"""Plans of packing against bounds and, for few pieces, against the best packing of all."""

import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

pytest.importorskip("cytoplane.llm")

from cytoplane.llm import packing  # noqa: E402

RNG = np.random.default_rng(1)


def check(hist, configs, capacity):
    used = Counter()
    for c, k in configs:
        assert k > 0 and sum(n * m for n, m in c.items()) <= capacity
        for n, m in c.items():
            used[n] += m * k
    assert used == Counter({n: k for n, k in hist.items() if k})


@pytest.mark.parametrize("name, lengths, over", [
    ("long pieces", RNG.integers(600, 1400, 20_000), 1.006),
    ("all eighths", 8 * RNG.integers(1, 257, 20_000), 1.003),
    ("middling", RNG.integers(300, 900, 8_000), 1.002),
    ("three in one", RNG.integers(400, 700, 8_000), 1.015),
])
def test_plans_are_near_their_bounds(name, lengths, over):
    hist = dict(Counter(lengths.tolist()))
    configs, bound = packing.plan(hist)
    check(hist, configs, 2048)
    alone = {n: k for n, k in hist.items() if n < 2048}
    least = min(packing.number(f(alone, 2048)) for f in (packing.best_fit, packing.fill)) + hist.get(2048, 0)
    assert packing.number(configs) <= least and bound <= packing.number(configs) <= over * bound + 1


def best(pieces, capacity):
    """The least number of sequences, by trying everything."""

    @lru_cache(None)
    def least(left):
        if not left:
            return 0
        first, rest = left[-1], left[:-1]
        found = len(left)
        for mask in range(1 << len(rest)):
            own = [rest[k] for k in range(len(rest)) if mask >> k & 1]
            if first + sum(own) <= capacity:
                found = min(found, 1 + least(tuple(rest[k] for k in range(len(rest)) if not mask >> k & 1)))
        return found

    return least(tuple(sorted(pieces)))


def test_bounds_and_plans_of_few_pieces():
    rnd = random.Random(3)
    over = 0
    for _ in range(60):
        pieces = [rnd.randrange(1, 21) for _ in range(rnd.randrange(0, 8))]
        hist = dict(Counter(pieces))
        want = best(pieces, 20)
        configs, bound = packing.plan(hist, 20)
        check(hist, configs, 20)
        assert packing.size_bound(hist, 20) + hist.get(20, 0) <= want and bound <= want + 1e-9 and want <= packing.number(configs) <= want + 1
        for f in (packing.fill, packing.best_fit):
            check({n: k for n, k in hist.items() if n < 20}, f({n: k for n, k in hist.items() if n < 20}, 20), 20)
        over += packing.number(configs) > want
    assert over <= 2 and packing.plan({}) == ([], 0.0)


def test_the_program_is_solved_where_best_fit_would_do(monkeypatch):
    """Pieces over half a sequence leave nothing to choose; the plan comes from the program all the same."""
    from cytoplane.llm import packing

    solved, fractional = [], packing.fractional
    monkeypatch.setattr(packing, "fractional", lambda *a, **k: solved.append(1) or fractional(*a, **k))
    configs, bound = packing.plan({1200: 30, 1500: 20, 2048: 3}, 2048)
    assert solved and packing.number(configs) == 53 >= bound
