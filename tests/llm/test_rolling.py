"""Rolling hashes modulo a prime: exact arithmetic, and repetitive stretches that a power of two as modulus confuses."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sediment.llm import common, lines, substrings


def test_products_and_powers_are_exact():
    rng = random.Random(1)
    edge = [0, 1, 2, (1 << 31) - 1, 1 << 31, 1 << 60, common.PRIME - 2, common.PRIME - 1]
    x = [a for a in edge for _ in edge] + [rng.randrange(common.PRIME) for _ in range(2000)]
    y = edge * len(edge) + [rng.randrange(common.PRIME) for _ in range(2000)]
    assert common.times(np.array(x, np.uint64), np.array(y, np.uint64)).tolist() == [a * b % common.PRIME for a, b in zip(x, y, strict=True)]
    large = [0, common.PRIME, (1 << 64) - 1, (1 << 61) + 7, *(rng.randrange(1 << 64) for _ in range(2000))]
    assert common.folded(np.array(large, np.uint64)).tolist() == [a % common.PRIME for a in large]
    base = rng.randrange(common.PRIME)
    for n in (0, 1, 2, 3, 1000):
        assert common.prime_powers(n, base).tolist() == [pow(base, i, common.PRIME) for i in range(n)]


def test_a_stretch_has_one_hash_wherever_it_stands():
    rng = np.random.default_rng(2)
    for long in (40, 1_100_000):  # powers are kept up to 2 ** 20
        values = rng.integers(1, common.PRIME, long, dtype=np.uint64)
        values[-20:] = values[:20]
        hashed = common.rolling(values, 12345)
        begin = np.array([0, long - 20, 1, long - 19, 0])
        end = begin + np.array([20, 20, 19, 19, 0])
        found = hashed(begin, end).tolist()
        assert found[:3] == [sum(int(v) * pow(12345, i, common.PRIME) for i, v in enumerate(values[a:b])) % common.PRIME for a, b in ((0, 20), (long - 20, long), (1, 20))]
        assert found[0] == found[1] and found[2] == found[3] and found[4] == 0


def _swapped(n: int) -> list[int]:
    """0 1 1 0 1 0 0 1 ...: as polynomials, this and its opposite differ by a product of many even numbers."""
    return [i.bit_count() & 1 for i in range(n)]


@pytest.mark.parametrize("base", [3, 0x9E3779B97F4A7C15])
def test_alternating_stretches_stay_apart(base):
    one = np.array(_swapped(2048), np.uint64) + np.uint64(1)
    two = np.uint64(3) - one
    total = lambda v: int((v * common.powers(len(v), base)).sum())
    assert total(one) == total(two)  # modulo 2 ** 64 they are one
    hashed = common.rolling(np.concatenate([one, two]), base % common.PRIME)
    a, b = hashed(np.array([0, 2048]), np.array([2048, 4096])).tolist()
    assert a != b


def test_alternating_words_and_bytes_stay_apart():
    words = np.array([b"north", b"south"])[_swapped(4096)]
    text, other = b" ".join(words.tolist()), b" ".join(words[::-1].tolist())
    hashes = np.concatenate([lines.word_hashes(text), lines.word_hashes(other)])
    runs = lines.run_hashes(hashes, 2048)
    whole = [hashes[i : i + 2048].tobytes() for i in range(len(runs))]
    assert len(set(runs.tolist())) == len(set(whole))
    data = bytes(97 + b for b in _swapped(5000)) + bytes(98 - b for b in _swapped(5000))
    digests: dict[int, bytes] = {}
    for _, _, digest, begin, size in substrings.regions(data):
        for d, a, n in zip(digest.tolist(), begin.tolist(), size.tolist(), strict=True):
            assert digests.setdefault(d, data[a : a + n]) == data[a : a + n]
    assert len(digests) > 5
