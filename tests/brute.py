"""Brute force over dense matrices, independent of the engine."""

from __future__ import annotations

from collections import deque

import numpy as np


def ego_roles(a: np.ndarray, x: int) -> np.ndarray:
    """Role per node, -1 outside the ego network: neighbours 1, directed two-paths 2, the rest of distance two and x 0."""
    n = len(a)
    u = (a + a.T) > 0
    role = np.full(n, -1)
    near = set(np.flatnonzero(u[x]))
    far = {int(z) for y in near for z in np.flatnonzero(u[y])} - near - {x}
    out = {int(z) for y in np.flatnonzero(a[x]) for z in np.flatnonzero(a[y])}
    into = {int(z) for y in np.flatnonzero(a[:, x]) for z in np.flatnonzero(a[:, y])}
    for z in far:
        role[z] = 2 if z in out | into else 0
    for z in near:
        role[z] = 1
    role[x] = 0
    return role


def directed_measures(a: np.ndarray, x: int) -> dict[str, tuple[float, int]]:
    """The nine blocks from the ordered matrix (x first, then roles 0, 1, 2), with slices from minus the last size."""
    role = ego_roles(a, x)
    zeros = [x] + [z for z in np.flatnonzero(role == 0) if z != x]
    ones, twos = list(np.flatnonzero(role == 1)), list(np.flatnonzero(role == 2))
    order = zeros + ones + twos
    m = a[np.ix_(order, order)]
    s0, s1, s2 = len(zeros), len(ones), len(twos)
    rows = {"0": slice(0, s0), "1": slice(s0, s0 + s1), "2": slice(-s2, None)}
    columns = {"0": slice(0, s0), "1": slice(s0, s0 + s1), "2": slice(s0 + s1, None)}
    zero = {"00": s0 + 2 * (s0 - 1), "11": s1, "02": s2, "20": s2, "22": s2}
    out = {}
    for i in "012":
        for j in "012":
            cols = columns[j] if i != "2" or j != "2" else slice(-s2, None)
            block = m[rows[i], cols]
            size = block.size - zero.get(i + j, 0)
            out[i + j] = (block.sum() / size if size > 0 else float(i + j in ("01", "12")), size)
    return out


def undirected_measures(a: np.ndarray, x: int) -> dict[str, tuple[float, int]]:
    u = ((a + a.T) > 0).astype(int)
    near = set(np.flatnonzero(u[x]))
    far = sorted({int(z) for y in near for z in np.flatnonzero(u[y])} - near - {x})
    near = sorted(near)
    blocks = {
        "1": (u[np.ix_(far, far)].sum(), len(far) * (len(far) - 1), 0.0),
        "2": (u[np.ix_(near, far)].sum(), len(near) * len(far), 1.0),
        "3": (u[np.ix_(near, near)].sum(), len(near) * (len(near) - 1), 0.0),
    }
    return {k: (c / z if z > 0 else d, z) for k, (c, z, d) in blocks.items()}


def sequential_louvain(edges: list[tuple], weights: list[float], m: float, resolution: float, seed: int) -> dict:
    """Communities by sequential local moves and contraction."""
    names = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(names)}
    links: list[dict[int, float]] = [{} for _ in names]
    loops = [0.0] * len(names)
    for (a, b), w in zip(edges, weights, strict=True):
        i, j = at[a], at[b]
        links[i][j] = links[i].get(j, 0.0) + w
        links[j][i] = links[j].get(i, 0.0) + w
    member, random = list(range(len(names))), np.random.default_rng(seed)
    while True:
        k = [sum(x.values()) + 2 * loop for x, loop in zip(links, loops, strict=True)]
        place, total, any_move = list(range(len(links))), k[:], False
        # Nodes wait to be looked at; a move makes the neighbours outside the new community wait again.
        queue = deque(random.permutation(len(links)).tolist())
        waiting = [True] * len(links)
        while queue:
            i = queue.popleft()
            waiting[i] = False
            near: dict[int, float] = {}
            for j, w in links[i].items():
                near[place[j]] = near.get(place[j], 0.0) + w
            own, share = place[i], resolution * k[i] / (2 * m)
            total[own] -= k[i]
            best, most = own, near.get(own, 0.0) - share * total[own]
            for c, w in near.items():
                gain = w - share * total[c]
                if gain > most + 1e-12 * m:
                    best, most = c, gain
            total[best] += k[i]
            if best != own:
                place[i], any_move = best, True
                for j in links[i]:
                    if place[j] != best and not waiting[j]:
                        waiting[j] = True
                        queue.append(j)
        if not any_move:
            break
        fresh = {c: i for i, c in enumerate(sorted(set(place)))}
        member = [fresh[place[x]] for x in member]
        merged: list[dict[int, float]] = [{} for _ in fresh]
        inner = [0.0] * len(fresh)
        for i, near_ in enumerate(links):
            a = fresh[place[i]]
            inner[a] += loops[i]
            for j, w in near_.items():
                b = fresh[place[j]]
                if a == b:
                    inner[a] += w / 2
                else:
                    merged[a][b] = merged[a].get(b, 0.0) + w
        links, loops = merged, inner
    first: dict[int, object] = {}
    for x, c in zip(names, member, strict=True):
        first.setdefault(c, x)
    return {x: first[c] for x, c in zip(names, member, strict=True)}
