"""The exact split where totals are far over any grid."""

import itertools
import random

import pytest

from quadrat.operators import splitting


def test_large_totals():
    rng = random.Random(8)
    for k in (4, 6, 9):
        counts = [(f"g{i}", rng.randint(1, 9000)) for i in range(k)]
        chosen, objective = splitting.exact_groups(counts)
        best = min(
            splitting._objective(counts, dict(zip((v for v, _ in counts), s)), splitting.RATIOS)
            for s in itertools.product(splitting.SPLITS, repeat=k) if set(s) == set(splitting.SPLITS)
        )
        assert objective == pytest.approx(best) and set(chosen.values()) == set(splitting.SPLITS)


@pytest.mark.parametrize("k", [25, 60])
def test_no_sums_are_better(k):
    rng = random.Random(9)
    counts = [(i, rng.randint(300, 900)) for i in range(k)]
    total = sum(n for _, n in counts)
    _, objective = splitting.exact_groups(counts)
    near = [range(int(total * r) - 3, int(total * r) + 4) for r in splitting.RATIOS]
    held = [x for x in itertools.product(*near) if sum(x) == total]
    assert objective == pytest.approx(min(sum(w * abs(x - total * r) for w, x, r in zip(splitting.EXACT_WEIGHTS, h, splitting.RATIOS)) for h in held))
