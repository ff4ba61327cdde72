"""Sign hyperplanes for cosine hashing (Charikar 2002), as a rule and not a table."""

from __future__ import annotations

import hashlib

import numpy as np


def sign_planes(n: int, dim: int) -> np.ndarray:
    """n x dim matrix of +1/-1; entry (p, j) is +1 when md5("p:j") starts with a digit 0-7."""
    return np.array(
        [
            [1.0 if hashlib.md5(f"{p}:{j}".encode()).hexdigest()[0] < "8" else -1.0 for j in range(dim)]
            for p in range(n)
        ]
    )
