"""Maximum flow by shortest augmenting paths on edge arrays."""

from __future__ import annotations

from collections import deque

import numpy as np


def max_flow(n: int, src: np.ndarray, dst: np.ndarray, cap: np.ndarray, s: int, t: int, directed: bool = False) -> tuple[float, np.ndarray, list[int]]:
    """Value, flow of each edge from src to dst (negative: the other way), and the nodes on the source's side of a minimum cut."""
    m = len(src)
    head = np.concatenate([dst, src])  # arc e + m runs against arc e
    room = np.concatenate([cap, np.zeros(m) if directed else cap]).astype(float)
    tail = np.concatenate([src, dst])
    order = np.argsort(tail, kind="stable")
    ptr = np.searchsorted(tail[order], np.arange(n + 1))
    arcs_of = [order[ptr[i] : ptr[i + 1]].tolist() for i in range(n)]
    value = 0.0
    while True:
        via = {s: -1}
        queue = deque([s])
        while queue and t not in via:
            u = queue.popleft()
            for a in arcs_of[u]:
                v = int(head[a])
                if room[a] > 1e-12 and v not in via:
                    via[v] = a
                    queue.append(v)
        if t not in via or s == t:
            break
        path, x = [], t
        while x != s:
            path.append(via[x])
            x = int(tail[via[x]])
        push = min(room[a] for a in path)
        for a in path:
            room[a] -= push
            room[(a + m) % (2 * m)] += push
        value += push
    back = room[m:] - (0 if directed else cap)
    return value, back, sorted(via)
