"""Longest previous factors against brute force, and removal in long texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from sediment.llm import substrings


def test_longest_previous_factors_equal_brute_force():
    rng = random.Random(1)
    for alphabet, length in (("ab", 50), ("abc", 9), ("a", 50), ("abcdefgh", 12)):
        parts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(length, 3 * length))) for _ in range(6)]
        parts += [p[rng.randrange(len(p) - length + 1) :] + q for p, q in zip(parts, parts[1:], strict=False)]
        parts = [p.encode() for p in parts]
        owners = [rng.randrange(8) for _ in parts]
        at = np.cumsum([0, *map(len, parts)])
        starts = [(int(at[i]) + j, owners[i]) for i, p in enumerate(parts) for j in range(len(p) - length + 1)]
        text = b"".join(parts)
        found = substrings.longest_previous_factors(np.frombuffer(text, np.uint8), np.array([s for s, _ in starts]), np.array([o for _, o in starts]), length)

        def common(a: int, b: int) -> int:
            return next((i for i in range(length) if text[a + i] != text[b + i]), length)

        for (s, o), f in zip(starts, found.tolist(), strict=True):
            longest = max((common(s, x) for x, y in starts if y < o), default=0)
            assert (f >= length) == (longest >= length)
        order, shared = substrings.suffix_order(np.frombuffer(text, np.uint8), np.array([s for s, _ in starts]), np.array([o for _, o in starts]), length)
        names = [starts[i][0] for i in order]
        assert [text[s : s + length] for s in names] == sorted(text[s : s + length] for s, _ in starts)
        assert shared.tolist()[1:] == [common(a, b) for a, b in zip(names, names[1:], strict=False)]


def test_long_texts(spark):
    """Parts of a text are read one after the other: matches across their edges count, and a text of one letter has an end."""
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefgh ", k=2_500_000))
    edge = substrings._CHUNK
    rows = [(1, long), (2, "x" + long[edge - 40 : edge + 40] + "y"), (3, long[: 2 * edge] + "z"), (4, "q" * 1_200_000), (5, "r" + "q" * 60)]
    found = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=False).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == {1: (0, 0, sha(long)), 2: (80, 1, sha("xy")), 3: (2 * edge, 1, sha("z")), 4: (0, 0, sha("q" * 1_200_000)), 5: (60, 1, sha("r"))}
