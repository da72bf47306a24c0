"""Adaptive quadtree: split the least self-similar node until a budget of nodes is reached."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _split(pdf: pd.DataFrame, budget: int, least: int) -> list[tuple]:
    x, y = pdf["gx"].to_numpy(), pdf["gy"].to_numpy()
    v = np.array(pdf["embedding"].tolist(), np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
    side = 1 << int(max(int(x.max() - x.min()), int(y.max() - y.min()), 0) + 1 - 1).bit_length()

    def alike(rows: np.ndarray) -> float:
        """Mean cosine with the mean direction: 1 where all vectors agree."""
        return float(np.linalg.norm(v[rows].mean(0))) if len(rows) else 1.0

    nodes = [(0, -1, 0, int(x.min()), int(y.min()), side, np.arange(len(v)))]
    leaf = {0}
    queue = [(alike(nodes[0][6]), 0)]
    while queue and len(nodes) + 3 < budget:
        score, i = heapq.heappop(queue)
        _, _, depth, x0, y0, s, rows = nodes[i]
        if s <= least or len(rows) < 2:
            continue
        leaf.discard(i)
        half = s // 2
        for dy in (0, 1):
            for dx in (0, 1):
                a, b = x0 + dx * half, y0 + dy * half
                mine = rows[(x[rows] >= a) & (x[rows] < a + half) & (y[rows] >= b) & (y[rows] < b + half)]
                if len(mine):
                    k = len(nodes)
                    nodes.append((k, i, depth + 1, a, b, half, mine))
                    leaf.add(k)
                    heapq.heappush(queue, (alike(mine), k))
    return [(n, p, d, a, b, s, len(r), round(alike(r), 6), n in leaf) for n, p, d, a, b, s, r in nodes]


def quadtree(tiles: DataFrame, key: str, budget: int = 1024, least: int = 1) -> DataFrame:
    """key, node, parent, depth, x, y, side, n_tiles, similarity, is_leaf of each slide level's tree.

    tiles: key, gx, gy, embedding. A tree is grown greedily, so one task holds a slide level's tiles; slides are spread.
    """

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _split(pdf, budget, least)
        return pd.DataFrame([(int(pdf[key].iloc[0]), *r) for r in rows], columns=[key, "node", "parent", "depth", "x", "y", "side", "n_tiles", "similarity", "is_leaf"])

    return tiles.select(key, "gx", "gy", "embedding").groupBy(key).applyInPandas(grow, f"{key} long, node long, parent long, depth long, x long, y long, side long, n_tiles long, similarity double, is_leaf boolean")
