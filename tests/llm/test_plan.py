"""Plans that need a filling fewer times than the counts allow."""

import collections

import pytest

from tidemark.llm import packing


@pytest.mark.parametrize(("counts", "capacity", "fewest"), [({16: 9, 7: 9, 10: 3, 13: 11}, 30, 13), ({2: 2, 9: 6, 7: 7, 11: 11, 3: 6, 10: 11}, 20, 18), ({8: 8, 17: 4, 18: 2, 10: 8}, 50, 5)])
def test_mixed_patterns_are_found(counts, capacity, fewest):
    plan, used = packing.plan_packing(counts, capacity), collections.Counter()
    for n, p in plan:
        assert sum(p) <= capacity
        for x in p:
            used[x] += n
    assert used == counts and sum(n for n, _ in plan) == fewest
