"""Locally consistent parsing against a plain one-symbol-at-a-time version."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import bytesops as B
from inkwell.llm import fingerprint as P

M = (1 << 64) - 1


def mix(x: int, seed: int) -> int:
    x = (x + 0x9E3779B97F4A7C15 * (seed + 1)) & M
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def plain_level(x: list[int]) -> list[int]:
    runs: list[list[int]] = []
    for s in x:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    x = [s if n == 1 else mix(s ^ mix(n, 3), 5) for s, n in runs]
    y = x
    for _ in range(P.ROUNDS):
        z = []
        for i, v in enumerate(y):
            d = v ^ y[i - 1] if i else 1
            bit = (d & -d).bit_length() - 1
            z.append(2 * bit + (v >> bit & 1))
        y = z
    assert all(v < 6 for v in y) and all(a != b for a, b in zip(y, y[1:]))
    for big in (5, 4, 3):
        for i, v in enumerate(y):
            if v == big:
                y[i] = min({0, 1, 2} - {y[i - 1] if i else None, y[i + 1] if i + 1 < len(y) else None})
    n = len(y)
    top = [(i == 0 or y[i - 1] < y[i]) and (i == n - 1 or y[i + 1] < y[i]) for i in range(n)]
    low = [0 < i < n - 1 and y[i - 1] > y[i] < y[i + 1] and not top[i - 1] and not top[i + 1] for i in range(n)]
    begin = [i == 0 or (i != 1 and (top[i] or low[i])) for i in range(n)]
    names, k = [], 0
    while k < n:
        e = k + 1
        while e < n and not begin[e]:
            e += 1
        name = mix(e - k, 1)
        for s in x[k:e]:
            name = mix((name * 0xD6E8FEB86659FD93 + s) & M, 2)
        names.append(name)
        k = e
    return names


def plain(text: str, level: int) -> tuple[int, int, set[int]]:
    x, k, sig = [mix(b, 9) for b in text.encode()], 0, None
    if not x:
        return 0, 0, set()
    while True:
        if k == level:
            sig = set(x)
        if len(x) == 1:
            return k, x[0], sig if sig is not None else {x[0]}
        x, k = plain_level(x), k + 1


@pytest.mark.parametrize("level", [1, 2, 3, 5])
def test_equals_the_plain_version(level: int) -> None:
    rng = random.Random(level)
    texts = ["", "a", "ab", "aa", "aaaaaaaaaa", "abab" * 50, None, "é ß 漢字"] + ["".join(rng.choices("abc de\n", k=rng.randint(1, 300))) for _ in range(60)]
    buf, off = B.utf8(pa.array(texts))
    depth, root, value, o = P.fingerprint(buf, off, level)
    for i, t in enumerate(texts):
        want = plain(t or "", level)
        assert (int(depth[i]), int(root[i]), {int(v) for v in value[o[i] : o[i + 1]]}) == want, t


def test_equal_substrings_share_signatures_at_any_offset() -> None:
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefghij ", k=4000))
    texts = ["".join(rng.choices("abcdefghij ", k=rng.randint(0, 500))) + passage + "".join(rng.choices("xyz ", k=rng.randint(0, 500))) for _ in range(8)]
    buf, off = B.utf8(pa.array(texts))
    _, root, value, o = P.fingerprint(buf, off, 4)
    sets = [set(value[o[i] : o[i + 1]].tolist()) for i in range(8)]
    common = set.intersection(*sets)
    alone = set(P.fingerprint(*B.utf8(pa.array([passage])), 4)[2].tolist())
    assert len(common) > 0.8 * len(alone)
    assert len(set(root.tolist())) == 8


def test_phrases_have_two_to_four_symbols_inside() -> None:
    x = np.random.default_rng(0).integers(0, 1 << 62, 10_000).astype(np.uint64)
    names, _ = P.parse_level(x, np.array([0, len(x)]))
    assert 10_000 / 3.01 < len(names) <= 10_000 / 2 + 2
