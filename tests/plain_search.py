"""The searches as plain loops over one sentence: what the library's are held against."""

import heapq

import numpy as np

from latticework.functions.hashing import BOS_PATTERN, PREFIXES, mix_one
from latticework.operators.search import BEAM, OTHER_COST, WEIGHT_BITS, WORD_COST


def cheapest(n: int, edges, word: int = WORD_COST, other: int = OTHER_COST) -> list[tuple[int, int, bool]]:
    """The path of least cost from 0 to n over words and, at every character, one for any other
    sign; of equal costs the one with the longest last words. (start, end, is a word)."""
    cost, back = np.full(n + 1, 1 << 60, np.int64), [(-1, False)] * (n + 1)
    cost[0] = 0
    by_start: dict[int, list[int]] = {}
    for e in edges:
        by_start.setdefault(int(e["start"]), []).append(int(e["end"]))
    for s in range(n):
        for end, c, known in [(s + 1, other, False), *((e, word, True) for e in by_start.get(s, ()))]:
            if cost[s] + c < cost[end]:
                cost[end], back[end] = cost[s] + c, (s, known)
    path, at = [], n
    while at:
        s, known = back[at]
        path.append((s, at, known))
        at = s
    return path[::-1]


def node_code(surface: str) -> int:
    return (len(surface) * 65599 + sum(ord(c) * (i + 1) for i, c in enumerate(surface))) & 0x7FFFFFFF


def beam_paths(text: str, edges, weights, beam: int = BEAM, keep: int = 1, global_beam: int = 0, right_check: int = 0, right_beam: int = 0, bits: int = WEIGHT_BITS) -> list[tuple[int, list[tuple[int, int]]]]:
    """The `keep` best paths [(score, [(start, end)])] under unigram, bigram and trigram weights.

    Each node keeps its `beam` best connections, by score, then left node, then their place.
    With global_beam only so many of all connections that end at a boundary go on; with
    right_check right nodes are scored against that many of them first, and only the best
    right_beam against all."""
    n, mask = len(text), (1 << bits) - 1
    nodes: list[tuple[int, int, int]] = [(0, 0, BOS_PATTERN)]
    ends: dict[int, list[int]] = {0: [0]}
    starting: dict[int, list[int]] = {}
    for e in [*({"start": s, "end": s + 1} for s in range(n)), *edges]:
        s, t = int(e["start"]), int(e["end"])
        starting.setdefault(s, []).append(t)
    kept: dict[int, list[tuple[int, int, int, int]]] = {0: [(0, -1, -1, BOS_PATTERN)]}  # score, left node, its place, t2

    def scores(codes: list[int], lefts: list[tuple[int, int, int, int, int]]) -> list[list[int]]:
        """A row for each right node, a column for each left connection. What features share,
        their order's prefix and t0, is hashed once."""
        found = []
        for c in codes:
            uni, bi, tri = (mix_one(p, c) for p in PREFIXES)
            found += [(uni & mask, mix_one(bi, x[3]) & mask, mix_one(mix_one(tri, x[3]), x[4]) & mask) for x in lefts]
        sums = weights(np.array(found)).sum(axis=1).reshape(len(codes), len(lefts))
        return (sums + np.array([x[0] for x in lefts])).tolist()

    for s in range(n + 1):
        lefts = [(sc, node, k, nodes[node][2], t2) for node in ends.get(s, ()) for k, (sc, _, _, t2) in enumerate(kept[node])]
        if not lefts:
            continue
        if global_beam:
            lefts = heapq.nlargest(global_beam, lefts, key=lambda x: (x[0], x[1], -x[2]))
        rights = sorted(set(starting.get(s, ()))) if s < n else [n]
        codes = [node_code(text[s:t]) if s < n else 0 for t in rights]
        table, full = scores(codes, lefts), set(range(len(rights)))
        if right_check and right_beam and len(rights) > right_beam:
            full = set(heapq.nlargest(right_beam, full, key=lambda i: (max(table[i][:right_check]), i)))
        for i, (t, code) in enumerate(zip(rights, codes)):
            some = lefts if i in full else lefts[: max(1, right_check)]
            best = heapq.nlargest(max(beam, keep), [(sc, x[1], -x[2], x[3]) for sc, x in zip(table[i], some)])
            nodes.append((s, t, code))
            kept[len(nodes) - 1] = [(sc, left, -k, t1) for sc, left, k, t1 in best]
            ends.setdefault(t if s < n else n + 1, []).append(len(nodes) - 1)
    out = []
    last = ends[n + 1][-1] if n + 1 in ends else 0
    for k in range(min(keep, len(kept[last]))):
        score, node, at = kept[last][k][0], last, k
        path = []
        while node > 0:
            _, left, place, _ = kept[node][at]
            path.append(nodes[node][:2])
            node, at = left, place
        out.append((int(score), [p for p in path[::-1] if p[0] < p[1]]))
    return out
