"""Two-label minimum cut by max-flow (Dinic), for the small graphs of one text."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence


def min_cut(first: Sequence[float], second: Sequence[float], edges: Iterable[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost: true is the first label.

    ``first[i]`` and ``second[i]`` are the costs of giving node i the first or the
    second label; an edge (i, j, w) costs w if its ends differ.  Ties go to the
    second label.  Without disagreement among the nodes no flow is needed: the
    common preference has no smoothness cost and is the minimum.
    """
    n = len(first)
    want = [a < b for a, b in zip(first, second, strict=True)]
    if not n or all(want) or not any(want):
        return want
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def add(u: int, v: int, c: float, back: float = 0.0) -> None:
        head[u].append(len(to))
        to.append(v)
        cap.append(c)
        head[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in range(n):  # a node on the source's side has the first label, so its edge to the sink is cut
        if second[i] > 0:
            add(source, i, second[i])
        if first[i] > 0:
            add(i, sink, first[i])
    for i, j, w in edges:
        if i != j and w > 0:
            add(i, j, w, w)
    eps = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        q = deque([source])
        while q:
            u = q.popleft()
            for e in head[u]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    q.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                f = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= f
                    cap[e ^ 1] += f
                cut = next(k for k, e in enumerate(path) if cap[e] <= eps)
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[u] < len(head[u]) and not (cap[head[u][at[u]]] > eps and level[to[head[u][at[u]]]] == level[u] + 1):
                at[u] += 1
            if at[u] < len(head[u]):
                e = head[u][at[u]]
                path.append(e)
                u = to[e]
            elif path:
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                break
