"""Maximum flow and minimum cut on small graphs (blocks of one page)."""

from __future__ import annotations

from collections import deque

EPS = 1e-12


def source_side(net: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source side of the minimum cut that has the fewest of them.

    net[i] > 0 is a capacity from the source to node i, net[i] < 0 one to the
    sink; edges carry the same capacity both ways. Dinic's algorithm: shortest
    levels from all nodes with source capacity left, then a blocking flow.
    """
    n = len(net)
    excess = [max(x, 0.0) for x in net]
    room = [max(-x, 0.0) for x in net]
    head, left, near = [], [], [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append(len(head))
        head.append(b)
        left.append(w)
        near[b].append(len(head))
        head.append(a)
        left.append(w)
    while True:
        level = [0 if x > EPS else -1 for x in excess]
        queue = deque(i for i in range(n) if not level[i])
        found = False
        while queue:
            i = queue.popleft()
            found = found or room[i] > EPS
            for e in near[i]:
                if left[e] > EPS and level[head[e]] < 0:
                    level[head[e]] = level[i] + 1
                    queue.append(head[e])
        if not found:
            return [x >= 0 for x in level]
        turn = [0] * n
        for start in range(n):
            while excess[start] > EPS:
                path, at = [], start
                while room[at] <= EPS:
                    while turn[at] < len(near[at]):
                        e = near[at][turn[at]]
                        if left[e] > EPS and level[head[e]] == level[at] + 1:
                            break
                        turn[at] += 1
                    else:
                        if not path:
                            break
                        at = head[path.pop() ^ 1]
                        turn[at] += 1
                        continue
                    path.append(e)
                    at = head[e]
                if room[at] <= EPS:
                    break
                flow = min([excess[start], room[at], *(left[e] for e in path)])
                excess[start] -= flow
                room[at] -= flow
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
