"""Sorted suffixes of one trie container, swept into nodes. Plain Python over rows of a task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass(slots=True)
class Node:
    depth: int
    before: int
    chars: int
    conv_id: int
    parent: Node | None
    of: tuple[int, int] | None
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    ends: list[int] = field(default_factory=list)


def digest(ids: list[int]) -> str:
    """SHA-256 of the ids in decimal, ascending, joined by commas."""
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def _closed(node: Node) -> Node:
    node.n_leaves = node.n_leaves or 1
    node.saved += (node.n_convs - 1) * node.chars
    if node.parent:
        node.parent.n_children += 1
        node.parent.n_leaves += node.n_leaves
        node.parent.saved += node.saved
    return node


def sweep(conv: list[int], depth: list[int], prefix: list[tuple[int, int]], above: list[tuple[int, int]], chars: list[int], total: list[int]) -> Iterator[Node]:
    """The nodes of a container, children before parents.

    A row for each turn of a suffix: its conversation, depth, prefix (of all turns up to it) and the prefix above it, the
    code points of its text, and of all turns up to it. The rows of a conversation stand together, by depth. The
    suffixes are sorted by their prefixes, so that suffixes with a common start are neighbours; what two neighbours share
    stays open, the rest is closed and added to what is above it.
    """
    first = [i for i in range(len(conv)) if not i or conv[i] != conv[i - 1]]
    suffixes = sorted((prefix[a:b], conv[a], a) for a, b in zip(first, [*first[1:], len(conv)], strict=True))
    path: list[Node] = []
    last: list[tuple[int, int]] = []
    for keys, c, at in suffixes:
        shared, most = 0, min(len(keys), len(last))
        while shared < most and keys[shared] == last[shared]:
            shared += 1
        while len(path) > shared:
            yield _closed(path.pop())
        for i in range(shared, len(keys)):
            j = at + i
            path.append(Node(depth[j], total[j] - chars[j], chars[j], c, path[-1] if path else None, None if path else above[j]))
        for node in path:
            node.n_convs += 1
            node.conv_id = min(node.conv_id, c)
        path[-1].ends.append(c)
        last = keys
    while path:
        yield _closed(path.pop())
