"""Plain versions of operators for small data."""

from __future__ import annotations

import hashlib

import numpy as np


def repeats(texts: list[str], least: int = 200) -> list[tuple[int, int, int, str]]:
    """The same by comparing all windows, for tests on a few texts."""
    data = [t.encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - least + 1):
            seen[d[i : i + least]] = seen.get(d[i : i + least], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - least + 1):
            if seen[d[i : i + least]] > 1:
                gone[i : i + least] = True
        rest = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        n = int((gone[:-1] & ~np.concatenate(([False], gone[:-2])) if len(d) else gone[:0]).sum())
        out.append((len(d), int(gone.sum()), n, hashlib.sha256(rest).hexdigest()))
    return out
