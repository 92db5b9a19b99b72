"""Plain versions that the operators are compared with."""

import heapq

import numpy as np


def nearest_seeds(ids: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, id) of the nearest seed by two chamfer passes (3 for sides, 4 for corners), first found wins; 1 << 30 and 0 where there is no seed."""
    far = 1 << 30
    dist, out = np.where(seed, 0, far), np.where(seed, ids, 0)
    rows, cols = ids.shape
    for flip, steps in ((1, [(0, -1, 3), (-1, -1, 4), (1, -1, 4), (-1, 0, 3)]), (-1, [(0, 1, 3), (-1, 1, 4), (1, 1, 4), (1, 0, 3)])):
        for r in range(rows)[::flip]:
            for c in range(cols)[::flip]:
                for dx, dy, w in steps:
                    i, j = r + dy, c + dx
                    if 0 <= i < rows and 0 <= j < cols and dist[i, j] + w < dist[r, c]:
                        dist[r, c], out[r, c] = dist[i, j] + w, out[i, j]
    return dist, out


def nearest_ids(ids: np.ndarray, seed: np.ndarray, limit: int) -> np.ndarray:
    """Cells of id 0 take the id of the nearest seed within the limit."""
    dist, out = nearest_seeds(ids, seed)
    return np.where((ids == 0) & (dist <= limit), out, ids)


def filled(heights):
    """Levels of standing water over a dict (x, y) -> height; water leaves wherever one of eight neighbours is missing."""
    around = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    near = lambda p: [(p[0] + dx, p[1] + dy) for dx, dy in around]
    heap = [(h, p) for p, h in heights.items() if any(q not in heights for q in near(p))]
    level = {p: h for h, p in heap}
    heapq.heapify(heap)
    while heap:
        here, p = heapq.heappop(heap)
        for q in near(p):
            if q in heights and q not in level:
                level[q] = max(heights[q], here)
                heapq.heappush(heap, (level[q], q))
    return level
