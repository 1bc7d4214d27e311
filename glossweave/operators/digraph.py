"""Small directed graphs inside one task: what grouped solvers are made of. Nothing here recurses."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from itertools import combinations

import numpy as np

Graph = dict[str, set[str]]


def graph_of(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> Graph:
    g: Graph = {v: set() for v in nodes}
    for a, b in edges:
        if a in g and b in g:
            g[a].add(b)
    return g


def without(g: Graph, gone: Iterable[str]) -> Graph:
    gone = set(gone)
    return {v: out - gone for v, out in g.items() if v not in gone}


def components(g: Graph) -> list[list[str]]:
    """Strongly connected components, each sorted, sinks first (Tarjan with an explicit stack)."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on, stack, found = set(), [], []
    for start in sorted(g):
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        work = [(start, iter(sorted(g[start])))]
        while work:
            v, children = work[-1]
            for w in children:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(sorted(g[w]))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    found.append(sorted(part))
    return found


def cyclic(g: Graph, part: list[str]) -> bool:
    return len(part) > 1 or part[0] in g[part[0]]


def cyclic_components(g: Graph) -> list[list[str]]:
    return [p for p in components(g) if cyclic(g, p)]


def acyclic(g: Graph) -> bool:
    """Kahn's sort takes every node."""
    into = dict.fromkeys(g, 0)
    for out in g.values():
        for w in out:
            into[w] += 1
    ready, n = deque(v for v, k in into.items() if not k), 0
    while ready:
        n += 1
        for w in g[ready.popleft()]:
            into[w] -= 1
            if not into[w]:
                ready.append(w)
    return n == len(g)


def hub(g: Graph, part: list[str]) -> str:
    """The node with the largest (degree, out-degree, in-degree, name) inside the component, loops aside."""
    inside = set(part)
    out = {v: len((g[v] & inside) - {v}) for v in part}
    into = dict.fromkeys(part, 0)
    for v in part:
        for w in (g[v] & inside) - {v}:
            into[w] += 1
    return max(part, key=lambda v: (out[v] + into[v], out[v], into[v], v))


def smallest_set(g: Graph, most: int | None = None) -> list[str] | None:
    """The first smallest set, in order of size and then of names, whose removal leaves no cycle."""
    names = sorted(g)
    for k in range(0, (len(names) if most is None else most) + 1):
        for some in combinations(names, k):
            if acyclic(without(g, some)):
                return list(some)
    return None


def bounded(g: Graph, passes: int = 8) -> dict:
    """One hub of every cyclic component a pass; what stays cyclic after the last one is the residual."""
    seed: list[str] = []
    for _ in range(passes):
        parts = cyclic_components(g)
        if not parts:
            break
        picked = [hub(g, p) for p in parts]
        seed += picked
        g = without(g, picked)
    return {"seed": seed, "exact": False, "residual": len(cyclic_components(g))}


class Arrows:
    """Edges between numbered nodes, by their start."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        self.n = n
        self.count = np.bincount(src, minlength=n)
        self.first = np.cumsum(self.count) - self.count
        key = src.astype(np.int64)
        key *= n
        key += dst
        key.sort()
        key %= max(n, 1)
        self.to = key.astype(np.int32)

    def to_of(self, v: int) -> np.ndarray:
        a = self.first[v]
        return self.to[a : a + self.count[v]]

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the edges of some nodes lead, and the place of each edge's start among the nodes."""
        k = self.count[nodes]
        at = np.repeat(self.first[nodes] - np.cumsum(k) + k, k) + np.arange(k.sum())
        return self.to[at], np.repeat(np.arange(len(nodes)), k)


def surviving(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Nodes that are left when those without an edge to one that is left are taken away, again and again."""
    back, left = Arrows(n, dst, src), np.bincount(src, minlength=n)
    gone = np.flatnonzero(left == 0)
    alive = left > 0
    while len(gone):
        np.subtract.at(left, back.of(gone)[0], 1)
        gone = np.flatnonzero(alive & (left == 0))
        alive[gone] = False
    return alive


def layered(n: int, src: np.ndarray, dst: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """0 for seeds; for a node, once all its predecessors have one, a layer above the highest (1 without any); -1 for those behind a cycle."""
    kept = ~seed[dst]
    src, dst = src[kept], dst[kept]
    out, left = Arrows(n, src, dst), np.bincount(dst, minlength=n)
    layer, high = np.where(seed, 0, -1), np.zeros(n, np.int64)
    new = np.flatnonzero(seed)
    while True:
        to, which = out.of(new)
        np.subtract.at(left, to, 1)
        np.maximum.at(high, to, layer[new][which])
        new = np.flatnonzero((layer < 0) & (left == 0))
        if not len(new):
            return layer
        layer[new] = high[new] + 1


#: Graphs of up to so many nodes are kept as one bit set a node, at most 50 MB.
BITS = 20_000


def _reach(v: int, inside: int, adjacent: list[int]) -> int:
    """Nodes of the bit set that a path within it leads to, with the start."""
    seen = todo = 1 << v
    while todo and seen != inside:
        low = todo & -todo
        new = adjacent[low.bit_length() - 1] & inside & ~seen
        seen |= new
        todo = (todo ^ low) | new
    return seen


def _bit_components(inside: int, out: list[int], into: list[int]) -> list[int]:
    """Strongly connected components by what one node reaches and what reaches it."""
    found, work = [], [inside]
    while work:
        part = work.pop()
        if not part:
            continue
        v = part.bit_length() - 1
        ahead, behind = _reach(v, part, out), _reach(v, part, into)
        found.append(ahead & behind)
        work += [ahead & ~behind, behind & ~ahead, part & ~(ahead | behind)]
    return found


def exact_small_greedy(g: Graph, limit: int = 12) -> dict:
    """Cyclic components of up to ``limit`` nodes are solved exactly; a larger one loses its hub and is looked at again.

    Nodes are numbered in the order of their names. While a component stays one
    without its hub, degrees are only counted down.
    """
    if len(g) > BITS:
        return _exact_small_greedy_sets(g, limit)
    names = sorted(g)
    number = {v: k for k, v in enumerate(names)}
    n, out, into = len(names), [0] * len(names), [0] * len(names)
    loops = 0
    for v, k in number.items():
        for w in g[v]:
            if w == v:
                loops |= 1 << k
            else:
                out[k] |= 1 << number[w]
                into[number[w]] |= 1 << k
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little", count=n).astype(np.int64)
    cyclic = lambda part: part & (part - 1) or part & loops
    seed: list[str] = []
    exact, work = True, [p for p in _bit_components((1 << n) - 1, out, into) if cyclic(p)] if n else []
    while work:
        part = work.pop()
        members = np.flatnonzero(bits(part))
        if len(members) <= limit:
            seed += smallest_set(graph_of([names[k] for k in members], ((names[k], w) for k in members for w in g[names[k]] if part >> number[w] & 1))) or []
            continue
        exact = False
        ahead, behind = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in members.tolist():
            ahead[k], behind[k] = (out[k] & part).bit_count(), (into[k] & part).bit_count()
        left = len(members)
        while left > limit:
            # the largest (degree, out-degree, in-degree, name)
            score = (((ahead[members] + behind[members]) * (n + 1) + ahead[members]) * (n + 1) + behind[members]) * (n + 1) + members
            v = int(members[score.argmax()])
            seed.append(names[v])
            part &= ~(1 << v)
            members = members[members != v]
            left -= 1
            start = int(members[0])
            if _reach(start, part, out) != part or _reach(start, part, into) != part:
                work += [p for p in _bit_components(part, out, into) if cyclic(p)]
                break
            behind -= bits(out[v])
            ahead -= bits(into[v])
        else:
            work.append(part)
    return {"seed": seed, "exact": exact, "residual": 0}


def _exact_small_greedy_sets(g: Graph, limit: int = 12) -> dict:
    """The same on adjacency sets, for graphs with too many nodes for bit sets."""
    seed: list[str] = []
    exact, work = True, cyclic_components(g)
    while work:
        part = work.pop()
        sub = graph_of(part, ((v, w) for v in part for w in g[v]))
        if len(part) <= limit:
            seed += smallest_set(sub) or []
        else:
            exact = False
            v = hub(sub, part)
            seed.append(v)
            work += cyclic_components(without(sub, [v]))
    return {"seed": seed, "exact": exact, "residual": 0}


def cycle_in(g: Graph) -> list[str] | None:
    """The nodes of some directed cycle."""
    done: set[str] = set()
    for start in sorted(g):
        path, at, work = [], {}, [(start, 0)]
        while work:
            v, stage = work.pop()
            if stage:
                path.pop()
                del at[v]
                done.add(v)
            elif v in at:
                return path[at[v] :]
            elif v not in done:
                at[v] = len(path)
                path.append(v)
                work.append((v, 1))
                for w in sorted(g[v], reverse=True):
                    if w in at:
                        return path[at[w] :]
                    if w not in done:
                        work.append((w, 0))
    return None


def branch_and_bound(g: Graph) -> list[str]:
    """A smallest set that meets every cycle: some node of any cycle found must go."""
    best = sorted(g)
    work: list[tuple[list[str], Graph]] = [([], g)]
    while work:
        gone, rest = work.pop()
        if len(gone) >= len(best):
            continue
        cycle = cycle_in(rest)
        if cycle is None:
            best = gone
            continue
        if len(gone) + 1 < len(best):
            work += [(gone + [v], without(rest, [v])) for v in sorted(cycle, reverse=True)]
    return sorted(best)


def exact_cutting(g: Graph, limit: int = 18) -> dict:
    """One pass over the cyclic components: up to ``limit`` nodes by branch and bound, of a larger one its hub alone."""
    seed: list[str] = []
    exact = True
    for part in cyclic_components(g):
        sub = graph_of(part, ((v, w) for v in part for w in g[v]))
        if len(part) <= limit:
            seed += branch_and_bound(sub)
        else:
            exact = False
            seed.append(hub(sub, part))
    return {"seed": seed, "exact": exact, "residual": len(cyclic_components(without(g, seed)))}


METHODS = {"bounded-scc": bounded, "exact-small-greedy": exact_small_greedy, "exact-cutting": exact_cutting}


def matching_size(left: dict[str, set[str]]) -> dict[str, str]:
    """A maximum matching head -> tail of a bipartite graph (Hopcroft and Karp, with explicit stacks)."""
    of: dict[str, str] = {}
    to: dict[str, str] = {}
    while True:
        depth = {a: 0 for a in left if a not in of}
        queue, reached = deque(depth), False
        while queue:
            a = queue.popleft()
            for b in left[a]:
                nxt = to.get(b)
                if nxt is None:
                    reached = True
                elif nxt not in depth:
                    depth[nxt] = depth[a] + 1
                    queue.append(nxt)
        if not reached:
            return to
        tried: set[str] = set()
        for root in sorted(a for a in left if a not in of):
            path, work = [], [(root, iter(sorted(left[root])))]
            while work:
                a, some = work[-1]
                for b in some:
                    if b in tried:
                        continue
                    nxt = to.get(b)
                    if nxt is None or depth.get(nxt) == depth[a] + 1:
                        tried.add(b)
                        path.append((a, b))
                        if nxt is None:
                            for x, y in path:
                                of[x], to[y] = y, x
                            work = []
                        else:
                            work.append((nxt, iter(sorted(left[nxt]))))
                        break
                else:
                    work.pop()
                    if path:
                        path.pop()
