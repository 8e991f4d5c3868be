"""Which strings of one minimiser go into the transform."""

from __future__ import annotations

import random

import numpy as np

from weftline.llm.bwt import _beside


def test_only_strings_without_a_shared_window_are_left_out():
    rng = random.Random(5)
    texts, at, window, mini = [], [], 20, 6
    for _ in range(300):
        left, right = (bytes(rng.choice(b"ab") if rng.random() < 0.15 else 97 for _ in range(rng.randint(0, 14))) for _ in range(2))
        if len(left) + len(right) >= window - mini:
            texts.append(left + b"MINIMI" + right)
            at.append(len(left))
    sizes = np.array([len(x) for x in texts])
    starts = np.cumsum(sizes) - sizes
    got = _beside(np.frombuffer(b"".join(texts), dtype=np.uint8), starts + np.array(at), starts, starts + sizes, window, mini)
    windows = [{x[k : k + window] for k in range(len(x) - window + 1)} for x in texts]
    share = np.array([any(a & b for j, b in enumerate(windows) if i != j) for i, a in enumerate(windows)])
    assert not (share & ~got).any() and not got.all()
