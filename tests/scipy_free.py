"""Plain versions of statistics, for small inputs."""

import numpy as np


def rank_scores(values, negative=False):
    """Clip to the 1st and 99th percentile, average ranks, scale to [0, 1]."""
    x = np.array(values, float)
    x = np.clip(x, np.percentile(x, 1), np.percentile(x, 99))
    rank = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    s = (rank - 1) / (len(x) - 1) if len(x) > 1 else np.full(len(x), 0.5)
    return 1 - s if negative else s
