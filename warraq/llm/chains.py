"""Two-state linear chains over padded batches."""

from __future__ import annotations

import numpy as np


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the second state and expected transitions for a padded batch of two-state chains; scaled at every step.

    ``emit`` holds the log-odds of the second state at each place, ``trans`` the logs of the transitions' weights.
    """
    n, width = emit.shape
    e = np.exp(np.clip(emit, -60, 60))
    pot = np.stack([np.ones_like(e), e], axis=2) / np.maximum(1.0, e)[:, :, None]
    t = np.exp(trans)
    a, b = np.zeros((n, width, 2)), np.ones((n, width, 2))
    a[:, 0] = pot[:, 0]
    a[:, 0] /= a[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, width):
        x = (a[:, i - 1] @ t) * pot[:, i]
        a[:, i] = x / x.sum(axis=1, keepdims=True)
    for i in range(width - 2, -1, -1):
        x = (pot[:, i + 1] * b[:, i + 1]) @ t.T
        b[:, i] = np.where(mask[:, i + 1, None], x / x.sum(axis=1, keepdims=True), 1.0)
    both = a * b
    marg = both[:, :, 1] / both.sum(axis=2) * mask
    pair = np.zeros((2, 2))
    if width > 1:
        x = a[:, :-1, :, None] * t * (pot[:, 1:] * b[:, 1:])[:, :, None, :]
        x /= x.sum(axis=(2, 3), keepdims=True)
        pair = (x * mask[:, 1:, None, None]).sum(axis=(0, 1))
    return marg, pair
