"""Deep-shallow sorting of byte strings with long common prefixes.

Strings are split by multikey quicksort, eight bytes at a time, down to a
shallow depth; groups that still agree there go into a blind trie, which
branches on single bytes and compares a whole prefix once per string.
Both deliver the order together with the common prefix lengths of neighbours.
"""

from __future__ import annotations

from bisect import bisect_left

SHALLOW, STEP = 64, 8


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class _Node:
    __slots__ = ("depth", "children", "leaf")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.leaf = depth, leaf
        self.children: dict[int, _Node] = {}


class BlindTrie:
    """Inner nodes hold the depth at which their strings part; the byte there (-1: the end) picks the child."""

    def __init__(self, strings: list[bytes], members: list[int]):
        self.strings = strings
        self.same: dict[int, list[int]] = {members[0]: [members[0]]}
        self.root = _Node(len(strings[members[0]]) + 1, members[0])
        for m in members[1:]:
            self.insert(m)

    def byte(self, m: int, depth: int) -> int:
        s = self.strings[m]
        return s[depth] if depth < len(s) else -1

    def insert(self, m: int) -> None:
        path, node = [], self.root
        while node.children:
            path.append(node)
            child = node.children.get(self.byte(m, node.depth))
            if child is None:
                break
            node = child
        other = node.leaf
        shared = common_prefix(self.strings[m], self.strings[other])
        if shared == len(self.strings[m]) == len(self.strings[other]):
            self.same[other].append(m)
            return
        self.same[m] = [m]
        above = None
        node = self.root
        while node.children and node.depth < shared:
            above, node = node, node.children[self.byte(m, node.depth)]
        if node.children and node.depth == shared:
            node.children[self.byte(m, shared)] = _Node(len(self.strings[m]) + 1, m)
            return
        split = _Node(shared, node.leaf)
        split.children = {self.byte(node.leaf, shared): node, self.byte(m, shared): _Node(len(self.strings[m]) + 1, m)}
        if above is None:
            self.root = split
        else:
            above.children[self.byte(m, above.depth)] = split

    def ordered(self) -> tuple[list[int], list[int]]:
        """Members in order, and the common prefix of each with the one before (first: 0)."""
        order: list[int] = []
        shared: list[int] = []
        stack: list[tuple[_Node, int]] = [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if not node.children:
                for k, m in enumerate(self.same[node.leaf]):
                    order.append(m)
                    shared.append(len(self.strings[m]) if k else before)
                continue
            children = [node.children[c] for c in sorted(node.children)]
            for child in reversed(children[1:]):
                stack.append((child, node.depth))
            stack.append((children[0], before))
        return order, shared


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of ``strings`` and the common prefix of each with its predecessor (first: 0)."""
    order: list[int] = []
    shared: list[int] = []
    # (members, depth they share, common prefix with what comes before)
    stack: list[tuple[list[int], int, int]] = [(list(range(len(strings))), 0, 0)]
    while stack:
        members, depth, before = stack.pop()
        if len(members) == 1:
            order.append(members[0])
            shared.append(before)
            continue
        if depth >= SHALLOW:
            sub, inner = BlindTrie(strings, members).ordered()
            inner[0] = before
            order += sub
            shared += inner
            continue
        key = {m: strings[m][depth : depth + STEP] for m in members}
        pivot = sorted((key[members[0]], key[members[len(members) // 2]], key[members[-1]]))[1]
        parts: list[list[int]] = [[], [], []]
        for m in members:
            k = key[m]
            parts[(k > pivot) + (k >= pivot)].append(m)
        # Neighbours over a cut are judged when their places are known.
        todo = []
        for part, same in zip(parts, (False, True, False), strict=True):
            if part:
                if same and len(pivot) < STEP:  # all end here and are equal
                    todo.append((part, SHALLOW, -1))
                else:
                    todo.append((part, depth + STEP if same else depth, -1))
        first, *rest = todo
        for item in reversed(rest):
            stack.append(item)
        stack.append((first[0], first[1], before))
    for i in range(1, len(order)):
        if shared[i] < 0:
            shared[i] = common_prefix(strings[order[i - 1]], strings[order[i]])
    if shared:
        shared[0] = 0
    return order, shared


def repeated_spans(lefts: list[bytes], rights: list[bytes], counts: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For places given by what stands before (reversed) and from them on: how far repeats reach.

    A place's result lists (l, r): l bytes before it and r bytes from it stand
    as well around another place, with l + r >= length.  Pairs of places are
    never enumerated: going up the order of the left contexts, sets of places
    are merged, the smaller into the larger, and only neighbours in the order
    of the right contexts are compared, which are the ones that share most.
    """
    m = len(lefts)
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    best = [-1] * m

    def note(a: int, depth: int, reach: int) -> None:
        if reach > best[a]:
            best[a] = reach
            if depth + reach >= length:
                out[a].append((depth, reach))

    for a in range(m):
        if counts[a] > 1:
            note(a, len(lefts[a]), len(rights[a]))
    if m == 1:
        return out
    if m == 2:
        depth, reach = common_prefix(*lefts), common_prefix(*rights)
        note(0, depth, reach)
        note(1, depth, reach)
        return out
    order, _ = deep_shallow(rights)
    rank = [0] * m
    for i, a in enumerate(order):
        rank[a] = i
    left_order, shared = deep_shallow(lefts)
    home = list(range(m))
    sets: dict[int, list[int]] = {a: [rank[a]] for a in range(m)}
    for i in sorted(range(1, m), key=lambda i: -shared[i]):
        depth = shared[i]
        big, small = home[left_order[i - 1]], home[left_order[i]]
        if len(sets[big]) < len(sets[small]):
            big, small = small, big
        into = sets[big]
        for k in sets.pop(small):
            a = order[k]
            home[a] = big
            at = bisect_left(into, k)
            for j in (at - 1, at):
                if 0 <= j < len(into):
                    b = order[into[j]]
                    reach = common_prefix(rights[a], rights[b])
                    note(a, depth, reach)
                    note(b, depth, reach)
            into.insert(at, k)
    return out
