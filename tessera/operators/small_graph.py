"""Measures and communities of graphs small enough to draw.

Path measures and Louvain walk the whole graph again and again; they serve the pictures of at most ``MOST`` edges and refuse larger graphs. For larger ones there are the
distributed operators of ``tessera.operators.graph``.
"""

from __future__ import annotations

import heapq
from collections import deque

from pyspark.sql import DataFrame

MOST = 200_000


def adjacency(edges: DataFrame) -> dict[str, dict[str, float]]:
    """The graph of ``src, dst, weight`` by neighbours."""
    rows = edges.select("src", "dst", "weight").where("src <> dst").orderBy("src", "dst").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"graphs of more than {MOST} edges have no path measures")
    near: dict[str, dict[str, float]] = {}
    for a, b, w in rows:
        near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0.0) + float(w)
        near.setdefault(b, {})[a] = near[a][b]
    return near


def path_measures(edges: DataFrame) -> DataFrame:
    """``node, betweenness, closeness, eccentricity`` on unweighted shortest paths; betweenness is normalised, closeness scaled by the reachable share."""
    near = adjacency(edges)
    n = len(near)
    between = dict.fromkeys(near, 0.0)
    rows = []
    for s in near:
        order, paths, dist, before = [], {s: 1.0}, {s: 0}, {s: []}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w], paths[w], before[w] = dist[v] + 1, 0.0, []
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                between[w] += share[w]
        total, reach = sum(dist.values()), len(order) - 1
        rows.append((s, reach / total * reach / (n - 1) if total and n > 1 else 0.0, max(dist.values())))
    scale = (n - 1) * (n - 2) if n > 2 else 1
    out = [(v, between[v] / scale, c, e) for v, c, e in rows]
    return edges.sparkSession.createDataFrame(out, "node string, betweenness double, closeness double, eccentricity int")


def eigenvector(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``node, score`` of eigenvector centrality by power iteration, of unit length."""
    near = adjacency(edges)
    x = dict.fromkeys(near, 1.0)
    for _ in range(rounds):
        y = {v: x[v] + sum(w * x[u] for u, w in near[v].items()) for v in near}
        size = sum(v * v for v in y.values()) ** 0.5 or 1.0
        y = {k: v / size for k, v in y.items()}
        if sum(abs(y[k] - x[k]) for k in x) < 1e-10:
            break
        x = y
    return edges.sparkSession.createDataFrame(list(x.items()), "node string, score double")


def louvain(edges: DataFrame, resolution: float = 1.0, smallest: int = 1) -> DataFrame:
    """``node, community`` by greedy modularity moves and merging, nodes in order of their names, so that it is deterministic; communities under ``smallest`` join the one
    they are tied to most. Communities are numbered by size, then first node."""
    near = adjacency(edges)
    owner = {v: v for v in near}  # node -> group of the current level
    level = {v: dict(ws) for v, ws in near.items()}
    loops = dict.fromkeys(near, 0.0)
    total = sum(sum(ws.values()) for ws in near.values()) or 1.0
    while True:
        group = {v: v for v in level}
        strength = {v: sum(ws.values()) + loops[v] for v, ws in level.items()}
        mass = dict(strength)
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in sorted(level):
                mass[group[v]] -= strength[v]
                ties: dict[str, float] = {}
                for u, w in level[v].items():
                    ties[group[u]] = ties.get(group[u], 0.0) + w
                gain = {g: w - resolution * strength[v] * mass[g] / total for g, w in ties.items()}
                best = max(gain, key=lambda g: (gain[g], g == group[v], g)) if gain else group[v]
                if gain and gain[best] <= gain.get(group[v], -resolution * strength[v] * mass[group[v]] / total) + 1e-12:
                    best = group[v]
                if best != group[v]:
                    group[v], moved, moved_any = best, True, True
                mass[best] = mass.get(best, 0.0) + strength[v]
        if not moved_any:
            break
        merged: dict[str, dict[str, float]] = {g: {} for g in set(group.values())}
        inner = dict.fromkeys(merged, 0.0)
        for v, ws in level.items():
            inner[group[v]] += loops[v]
            for u, w in ws.items():
                if group[u] == group[v]:
                    inner[group[v]] += w
                else:
                    merged[group[v]][group[u]] = merged[group[v]].get(group[u], 0.0) + w
        owner = {v: group[g] for v, g in owner.items()}
        level, loops = merged, inner
    members: dict[str, list[str]] = {}
    for v, g in owner.items():
        members.setdefault(g, []).append(v)
    return _numbered(edges, members, near, smallest)


def greedy_modularity(edges: DataFrame, smallest: int = 1) -> DataFrame:
    """``node, community`` by agglomeration: the two tied communities whose merger raises modularity most are merged until none does (ties by names)."""
    near = adjacency(edges)
    total = sum(sum(ws.values()) for ws in near.values()) or 1.0
    mass = {v: sum(ws.values()) / total for v, ws in near.items()}
    ties = {v: {u: w / total for u, w in ws.items() if u != v} for v, ws in near.items()}
    members = {v: [v] for v in near}
    queue = [(-2 * (w - mass[v] * mass[u]), v, u) for v, ws in ties.items() for u, w in ws.items() if v < u]
    heapq.heapify(queue)
    while queue:
        gain, a, b = heapq.heappop(queue)
        if gain >= -1e-12:
            break
        if a not in members or b not in members or abs(-2 * (ties[a].get(b, 0.0) - mass[a] * mass[b]) - gain) > 1e-12:
            continue  # of communities that have changed since
        members[a] += members.pop(b)
        mass[a] += mass.pop(b)
        for u, w in ties.pop(b).items():
            ties[u].pop(b)
            if u != a:
                ties[a][u] = ties[u][a] = ties[a].get(u, 0.0) + w
        for u, w in ties[a].items():
            heapq.heappush(queue, (-2 * (w - mass[a] * mass[u]), *sorted((a, u))))
    return _numbered(edges, members, near, smallest)


def girvan_newman(edges: DataFrame) -> DataFrame:
    """``node, community``: the first split by removing, again and again, the edge that most shortest paths use (ties by names)."""
    near = {v: dict(ws) for v, ws in adjacency(edges).items()}
    first = len(_parts(near))
    while len(parts := _parts(near)) == first and any(near.values()):
        a, b = max(_edge_betweenness(near).items(), key=lambda e: (round(e[1], 9), e[0]))[0]
        del near[a][b], near[b][a]
    return _numbered(edges, {min(p): p for p in parts}, near, 1)


def _parts(near: dict[str, dict[str, float]]) -> list[list[str]]:
    seen: set[str] = set()
    out = []
    for v in sorted(near):
        if v not in seen:
            seen.add(v)
            part = [v]
            for x in part:
                for u in near[x]:
                    if u not in seen:
                        seen.add(u)
                        part.append(u)
            out.append(part)
    return out


def _edge_betweenness(near: dict[str, dict[str, float]]) -> dict[tuple[str, str], float]:
    """Shortest paths, in steps, over each edge."""
    out: dict[tuple[str, str], float] = {}
    for s in near:
        order, far, paths, before = [s], {s: 0}, {s: 1.0}, {s: []}
        for v in order:
            for u in near[v]:
                if u not in far:
                    far[u], paths[u], before[u] = far[v] + 1, 0.0, []
                    order.append(u)
                if far[u] == far[v] + 1:
                    paths[u] += paths[v]
                    before[u].append(v)
        flow = dict.fromkeys(order, 1.0)
        for v in reversed(order):
            for u in before[v]:
                share = flow[v] * paths[u] / paths[v]
                flow[u] += share
                e = (u, v) if u < v else (v, u)
                out[e] = out.get(e, 0.0) + share / 2
    return out


def _numbered(edges: DataFrame, members: dict[str, list[str]], near: dict[str, dict[str, float]], smallest: int) -> DataFrame:
    """Communities numbered by size, then first node; those under ``smallest`` join the one they are tied to most."""
    owner = {v: g for g, vs in members.items() for v in vs}
    for g in sorted(members, key=lambda g: (len(members[g]), g)):
        if len(members[g]) < smallest and len(members) > 1:
            ties: dict[str, float] = {}
            for v in members[g]:
                for u, w in near[v].items():
                    if owner[u] != g:
                        ties[owner[u]] = ties.get(owner[u], 0.0) + w
            if ties:
                to = max(ties, key=lambda k: (ties[k], k))
                owner |= dict.fromkeys(members[g], to)
                members[to] += members.pop(g)
    names = {g: k for k, g in enumerate(sorted(members, key=lambda g: (-len(members[g]), min(members[g]))))}
    return edges.sparkSession.createDataFrame([(v, names[g]) for v, g in owner.items()], "node string, community int")
