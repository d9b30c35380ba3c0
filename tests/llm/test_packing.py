"""Best-fit packing against bins that are filled one by one by trying all combinations."""

from __future__ import annotations

import random
from itertools import product

from sediment.llm import packing


def _fullest(lengths: list[int], capacity: int) -> int:
    """How full a bin with the largest length left can be."""
    sums = {max(lengths)}
    rest = sorted(lengths)[:-1]
    for n in rest:
        sums |= {s + n for s in sums if s + n <= capacity}
    return max(sums)


def test_each_bin_is_as_full_as_can_be():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.randrange(8, 40)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 40))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        left = sorted(lengths)
        for times, take in packing.minimum_bin_slack(dict(histogram), capacity):
            for _ in range(times):
                filled = sum(n * c for n, c in take.items())
                assert take[max(left)] and filled == _fullest(left, capacity) <= capacity
                for n, c in take.items():
                    for _ in range(c):
                        left.remove(n)
        assert not left


def test_ranks_fill_every_place_once():
    histogram = {7: 9, 5: 4, 3: 11, 2: 5, 1: 6}
    plan = packing.minimum_bin_slack(dict(histogram), 12)
    places = set()
    for length, rows in packing._segments(plan).items():
        for rank in range(histogram[length]):
            first, bin_, copies, begin = rows[rows[:, 0].searchsorted(rank, side="right") - 1]
            nth = rank - first
            offset = begin + nth % copies * length
            cells = set(product([bin_ + nth // copies], range(offset, offset + length)))
            assert not cells & places
            places |= cells
    bins = {b for b, _ in places}
    for b in bins:
        used = sorted(o for x, o in places if x == b)
        assert used == list(range(len(used))) and len(used) <= 12
