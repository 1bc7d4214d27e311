"""Large directed graphs inside one task, on numbered nodes (in the order of their names): 16 bytes an edge at rest."""

from __future__ import annotations

import heapq

import numpy as np

from glossweave.operators import digraph
from glossweave.operators.digraph import Arrows

#: So many edges are looked at at once, and up to so many go to the plain search for components.
CHUNK, PLAIN = 4_000_000, 20_000
NOWHERE, FAR = -2, np.int32(2**31 - 1)


class Graph:
    """Nodes 0 to n - 1. Loops are kept apart. ``at`` tells the part a node is in; ``score`` orders hubs by (degree, out-degree) in it."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        own = src == dst
        self.n, self.loop = n, np.zeros(n, bool)
        self.loop[src[own]] = True
        if own.any():
            src, dst = src[~own], dst[~own]
        self.out, self.into = Arrows(n, src, dst), Arrows(n, dst, src)
        self.at, self.score, self.parts = np.full(n, NOWHERE, np.int32), np.zeros(n, np.int64), 0
        self.trees = [(self.out, self.into, np.zeros(n, np.int32), np.zeros(n, np.int32)), (self.into, self.out, np.zeros(n, np.int32), np.zeros(n, np.int32))]

    def place(self, members: np.ndarray) -> int:
        """Puts nodes into a part of their own."""
        self.parts += 1
        self.at[members] = self.parts
        return self.parts

    def inner(self, arrows: Arrows, members: np.ndarray, part: int) -> np.ndarray:
        """How many edges of each member stay within the part."""
        found = np.zeros(len(members), np.int64)
        for a, b in _pieces(arrows.count[members]):
            to, which = arrows.of(members[a:b])
            found[a:b] = np.bincount(which[self.at[to] == part], minlength=b - a)
        return found

    def reached(self, start: int, arrows: Arrows, part: int) -> np.ndarray:
        seen = np.zeros(self.n, bool)
        seen[start] = True
        new = np.array([start])
        while len(new):
            new = self._distinct(arrows.of(new[a:b])[0] for a, b in _pieces(arrows.count[new]))
            new = new[(self.at[new] == part) & ~seen[new]]
            seen[new] = True
        return seen

    def _distinct(self, some) -> np.ndarray:
        """Nodes once each: by sorting where they are few, so that long chains do not cost all nodes a step."""
        few, hit = [], None
        for nodes in some:
            if hit is None and len(nodes) + sum(map(len, few)) > self.n // 16:
                hit = np.zeros(self.n, bool)
            few.append(nodes)
            if hit is not None:
                for x in few:
                    hit[x] = True
                few = []
        if hit is not None:
            return np.flatnonzero(hit)
        return np.unique(np.concatenate(few)) if few else np.zeros(0, np.int32)

    def components(self, members: np.ndarray) -> np.ndarray:
        """The smallest node of each member's strongly connected component among the members, which end up in no part."""
        label, members = np.arange(self.n, dtype=np.int32), np.asarray(members)
        given, poor = members, 0
        part = self.place(members)
        ahead, behind = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        while len(members):
            ahead[members], behind[members] = self.inner(self.out, members, part), self.inner(self.into, members, part)
            gone = members[(ahead[members] == 0) | (behind[members] == 0)]
            while len(gone):  # nodes without an edge in or out are alone
                self.at[gone] = NOWHERE
                np.subtract.at(behind, self.out.of(gone)[0], 1)
                np.subtract.at(ahead, self.into.of(gone)[0], 1)
                near = self._distinct((self.out.of(gone)[0], self.into.of(gone)[0]))
                gone = near[(self.at[near] == part) & ((ahead[near] <= 0) | (behind[near] <= 0))]
            members = members[self.at[members] == part]
            if not len(members):
                break
            if ahead[members].sum() <= PLAIN or poor > 3:
                self._plain(members, part, label)
                break
            pivot = int(members[(ahead[members] * behind[members]).argmax()])
            both = np.flatnonzero(self.reached(pivot, self.out, part) & self.reached(pivot, self.into, part))
            label[both] = both[0]
            self.at[both] = NOWHERE
            poor += len(both) * 8 < len(members)
            members = members[self.at[members] == part]
        return label[given]

    def _plain(self, members: np.ndarray, part: int, label: np.ndarray) -> None:
        """Tarjan's search with an explicit stack."""
        index, low, on, stack = {}, {}, set(), []
        edges = lambda v: iter((t := self.out.to_of(v))[self.at[t] == part].tolist())
        for start in members.tolist():
            if start in index:
                continue
            index[start] = low[start] = len(index)
            stack.append(start)
            on.add(start)
            work = [(start, edges(start))]
            while work:
                v, children = work[-1]
                for w in children:
                    if w not in index:
                        index[w] = low[w] = len(index)
                        stack.append(w)
                        on.add(w)
                        work.append((w, edges(w)))
                        break
                    if w in on:
                        low[v] = min(low[v], index[w])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[v])
                    if low[v] == index[v]:
                        k = stack.index(v) if stack[-1] != v else len(stack) - 1
                        some = stack[k:]
                        del stack[k:]
                        on.difference_update(some)
                        label[some] = min(some)
        self.at[members] = NOWHERE

    def cyclic(self, members: np.ndarray) -> list[np.ndarray]:
        """The components with a cycle among the members."""
        if len(members) == 1:
            self.at[members] = NOWHERE
            return [members] if self.loop[members[0]] else []
        label = self.components(members)
        order = np.argsort(label, kind="stable")
        members, label = np.asarray(members)[order], label[order]
        first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]]) if len(label) else np.zeros(0, int)
        size = np.diff(np.r_[first, len(label)])
        kept = (size > 1) | self.loop[members[first]]
        return [members[a : a + k] for a, k in zip(first[kept].tolist(), size[kept].tolist())]

    def rate(self, members: np.ndarray, part: int) -> None:
        ahead, behind = self.inner(self.out, members, part), self.inner(self.into, members, part)
        self.score[members] = (ahead + behind) * (self.n + 1) + ahead

    def small(self, members: np.ndarray) -> digraph.Graph:
        inside = set(members.tolist())
        return {v: {w for w in self.out.to_of(v).tolist() if w in inside} | ({v} if self.loop[v] else set()) for v in members.tolist()}


class Whittled:
    """A strongly connected part that loses nodes one by one.

    Shortest-path trees from and to a root tell what stays connected; of a removed
    node only its children look for another parent, one that will last (of low degree).
    """

    def __init__(self, g: Graph, members: np.ndarray):
        self.g, self.members, self.left = g, np.sort(members), len(members)
        self.part = g.place(self.members)
        g.rate(self.members, self.part)
        self._root()

    def _root(self) -> None:
        g, alive = self.g, self.alive()
        self.root = int(alive[np.argsort(g.score[alive], kind="stable")[len(alive) * 3 // 4]]) if len(alive) else -1
        for ahead, _, depth, parent in g.trees:
            depth[alive] = FAR
            new, d = np.array([self.root]), 0
            depth[self.root], parent[self.root] = 0, -1
            while len(new):
                d += 1
                new = new[np.argsort(-g.score[new], kind="stable")]
                found = []
                for a, b in _pieces(ahead.count[new]):
                    to, which = ahead.of(new[a:b])
                    ok = (g.at[to] == self.part) & (depth[to] == FAR)
                    parent[to[ok]] = new[a:b][which[ok]]  # the last one stays
                    found.append(g._distinct([to[ok]]))
                new = g._distinct(found)
                depth[new] = d

    def alive(self) -> np.ndarray:
        if self.left < len(self.members) * 0.9:
            self.members = self.members[self.g.at[self.members] == self.part]
            return self.members
        return self.members[self.g.at[self.members] == self.part]

    def hub(self) -> int:
        g = self.g
        if self.left < len(self.members) * 0.9:
            self.members = self.members[g.at[self.members] == self.part]
        down = self.members[::-1]
        return int(down[g.score[down].argmax()])

    def _leave(self, v: int) -> tuple[np.ndarray, np.ndarray]:
        g = self.g
        g.at[v], g.score[v] = NOWHERE, -1
        self.left -= 1
        to, of = g.out.to_of(v), g.into.to_of(v)
        to, of = to[g.at[to] == self.part], of[g.at[of] == self.part]
        g.score[to] -= g.n + 1
        g.score[of] -= g.n + 2
        return to, of

    def remove(self, v: int) -> np.ndarray:
        """Takes a node away; the nodes that are not connected both ways any more fall off and are returned."""
        g = self.g
        near = self._leave(v)
        if v == self.root:
            rest = self.alive()
            g.at[rest], g.score[rest], self.left = NOWHERE, -1, 0
            return rest
        lost = {w for tree, some in zip(g.trees, near) for w in self._mend(*tree, v, some)}
        for w in lost:
            self._leave(w)
        return np.array(sorted(lost), np.int64)

    def _mend(self, ahead: Arrows, back: Arrows, depth: np.ndarray, parent: np.ndarray, v: int, near: np.ndarray) -> list[int]:
        """The nodes that the root does not reach any more."""
        g, part = self.g, self.part

        def above(w: int, d: int) -> bool:
            some = back.to_of(w)
            some = some[(g.at[some] == part) & (depth[some] == d - 1)]
            if len(some):
                parent[w] = some[g.score[some].argmin()]
            return bool(len(some))

        def below(w: int, some: np.ndarray) -> list[tuple[int, int]]:
            some = some[(g.at[some] == part) & (parent[some] == w) & (depth[some] != FAR)]
            return list(zip(depth[some].tolist(), some.tolist()))

        work, loose = below(v, near), []
        heapq.heapify(work)
        while work:
            d, w = heapq.heappop(work)
            if depth[w] != d or above(w, d):
                continue
            depth[w] = FAR
            loose.append(w)
            for x in below(w, ahead.to_of(w)):
                heapq.heappush(work, x)
        for w in loose:
            some = back.to_of(w)
            some = depth[some[g.at[some] == part]]
            if len(some) and (d := int(some.min())) != FAR:
                work.append((d + 1, w))
        heapq.heapify(work)
        while work:
            d, w = heapq.heappop(work)
            if depth[w] == FAR:
                above(w, d)
                depth[w] = d
                some = ahead.to_of(w)
                for x in some[(g.at[some] == part) & (depth[some] == FAR)].tolist():
                    heapq.heappush(work, (d + 1, x))
        return [w for w in loose if depth[w] == FAR]


def _pieces(count: np.ndarray) -> list[tuple[int, int]]:
    """Runs of nodes with some 4 million edges together."""
    if not len(count):
        return []
    block = np.cumsum(count) // CHUNK
    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist()
    return list(zip(cuts, [*cuts[1:], len(count)]))


def _hub(g: Graph, part: np.ndarray) -> int:
    g.rate(part, g.place(part))
    down = part[::-1]
    g.at[part] = NOWHERE
    return int(down[g.score[down].argmax()])


def exact_small_greedy(g: Graph, parts: list[np.ndarray], limit: int = 12) -> list[int]:
    """As ``digraph.exact_small_greedy``, of strongly connected parts."""
    seed: list[int] = []
    work = list(parts)
    while work:
        part = work.pop()
        if len(part) <= limit:
            seed += digraph.smallest_set(g.small(part)) or []
            continue
        w = Whittled(g, part)
        while w.left > limit:
            v = w.hub()
            seed.append(v)
            rest = w.remove(v)
            if len(rest):
                work += g.cyclic(rest)
        if w.left:
            work += g.cyclic(w.alive())
    return seed


def bounded(g: Graph, parts: list[np.ndarray], passes: int = 8) -> tuple[list[int], list[np.ndarray]]:
    """As ``digraph.bounded``: the seed, and the cyclic components that are left."""
    seed: list[int] = []
    for _ in range(passes):
        if not parts:
            break
        picked = [_hub(g, p) for p in parts]
        seed += picked
        parts = [q for p, v in zip(parts, picked) if len(p) > 1 for q in g.cyclic(p[p != v])]
    return seed, parts


def exact_cutting(g: Graph, parts: list[np.ndarray], limit: int = 18) -> tuple[list[int], list[np.ndarray]]:
    """As ``digraph.exact_cutting``: the seed, and the cyclic components that are left."""
    seed: list[int] = []
    left: list[np.ndarray] = []
    for p in parts:
        some = digraph.branch_and_bound(g.small(p)) if len(p) <= limit else [_hub(g, p)]
        seed += some
        rest = p[~np.isin(p, some)]
        if len(rest):
            left += g.cyclic(rest)
    return seed, left


#: method -> the solver, the name of its bound, and up to what size a component is solved exactly
METHODS = {"bounded-scc": (bounded, "passes", None), "exact-small-greedy": (lambda g, parts, **a: (exact_small_greedy(g, parts, **a), []), "limit", 12), "exact-cutting": (exact_cutting, "limit", 18)}


def staged(g: Graph, hubs: int, passes: int, small: int, max_stages: int | None) -> tuple[list[tuple[int, int]], list[tuple[int, str, int, int]]]:
    """As ``feedback.staged``: (node, stage) of the seed, and (stage, name, removed, edges left)."""
    seed: list[tuple[int, int]] = []
    metrics: list[tuple[int, str, int, int]] = []
    alive, edges = np.ones(g.n, bool), len(g.out.to) + int(g.loop.sum())

    def take(gone: list[int], name: str) -> int:
        nonlocal edges
        for v in gone:
            alive[v] = False
            edges -= int(alive[g.out.to_of(v)].sum()) + int(alive[g.into.to_of(v)].sum()) + int(g.loop[v])
        seed.extend((v, len(metrics)) for v in gone)
        metrics.append((len(metrics), name, len(gone), edges))
        return len(gone)

    def first(nodes: np.ndarray, degree: np.ndarray) -> list[int]:
        order = np.argsort(-degree, kind="stable")[:hubs]
        return nodes[order[degree[order] > 0]].tolist()

    def size(p: Whittled | np.ndarray) -> int:
        return p.left if isinstance(p, Whittled) else len(p)

    def largest(parts: list, name: str) -> list:
        """Hubs of the largest part; the parts after it."""
        best = max((p for p in parts if size(p) > 1), key=lambda p: (size(p), -int((p.alive() if isinstance(p, Whittled) else p).min())), default=None)
        if best is None:
            take([], name)
            return parts
        w = best if isinstance(best, Whittled) else Whittled(g, best)
        members = w.alive()
        gone = first(members, g.score[members] // (g.n + 1))
        take(gone, name)
        off = [w.remove(v) for v in gone if g.at[v] == w.part]
        off = np.concatenate([*off, np.zeros(0, np.int64)])
        off = off[~np.isin(off, gone)]
        out = [p for p in parts if p is not best]
        if len(off):
            out += g.cyclic(np.sort(off))
        if w.left > small:
            out.append(w)
        elif w.left:
            out += g.cyclic(w.alive())
        return out

    take(first(np.arange(g.n), g.out.count + g.into.count), "global hubs")
    parts = largest(g.cyclic(np.flatnonzero(alive)), "hubs of the largest component")
    seeds, parts = bounded(g, [p.alive() if isinstance(p, Whittled) else p for p in parts], passes)
    take(seeds, "bounded passes")
    done = 0
    while max_stages is None or done < max_stages:
        done += 1
        few = [p for p in parts if size(p) <= small]
        parts = [p for p in parts if size(p) > small]
        if take(exact_small_greedy(g, few, small), "exact small residuals") == 0 and not parts:
            break
        if parts:
            parts = largest(parts, "hubs of the largest residual")
    return seed, metrics


#: Bits of reached components that are held at once: a block of targets for every component.
BLOCK_BYTES = 64_000_000


def reach_counts(g: Graph) -> np.ndarray:
    """How many nodes a path of one edge or more leads to, from each node.

    Components first; what their acyclic graph reaches as bits, a block of targets
    at a time, level by level from the sinks.
    """
    label = g.components(np.arange(g.n))
    heads, at, size = np.unique(label, return_inverse=True, return_counts=True)
    n = len(heads)
    own = np.zeros(n, np.int64)
    own[size > 1] = size[size > 1]
    own[at[g.loop]] = size[at[g.loop]]
    keys = [np.zeros(0, np.int64)]
    for a, b in _pieces(g.out.count):
        to, which = g.out.of(np.arange(a, b))
        s, d = at[a:b][which], at[to]
        keys.append(np.unique(s[s != d].astype(np.int64) * n + d[s != d]))
    key = np.unique(np.concatenate(keys))
    src, dst = (key // n).astype(np.int32), (key % n).astype(np.int32)
    height = digraph.layered(n, dst, src, np.zeros(n, bool))  # 1 for sinks
    order = np.argsort(height[src], kind="stable")
    src, dst, level = src[order], dst[order], height[src[order]]
    starts = np.flatnonzero(np.r_[True, level[1:] != level[:-1]]).tolist() if len(src) else []
    runs = list(zip(starts, [*starts[1:], len(src)]))
    rank = np.empty(n, np.int64)
    rank[np.argsort(-size, kind="stable")] = np.arange(n)  # components of several nodes share the first blocks
    weight = np.sort(size)[::-1]
    width = max(64, min(BLOCK_BYTES * 8 // max(n, 1), n + 63) // 64 * 64)
    found = own.copy()
    for lo in range(0, n, width):
        bits = np.zeros((n, width // 8), np.uint8)
        for a, b in runs:
            step = max(1, BLOCK_BYTES * 8 // width)
            for c in range(a, b, step):
                s, d = src[c : min(c + step, b)], dst[c : min(c + step, b)]
                first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                bits[s[first]] |= np.bitwise_or.reduceat(bits[d], first, axis=0)
                inside = (rank[d] >= lo) & (rank[d] < lo + width)
                k = rank[d[inside]] - lo
                np.bitwise_or.at(bits, (s[inside], k >> 3), (1 << (k & 7)).astype(np.uint8))
        w = weight[lo : lo + width]
        if len(w) and w[0] > 1:
            for c in range(0, n, step := max(1, BLOCK_BYTES // width)):
                found[c : c + step] += np.unpackbits(bits[c : c + step], axis=1, bitorder="little", count=len(w)) @ w
        else:
            found += np.bitwise_count(bits).sum(1, dtype=np.int64)
    return found[at]
