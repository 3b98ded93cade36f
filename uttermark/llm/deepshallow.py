"""Deep-shallow sorting of byte strings of one fixed length, many small sets at a time.

Shallow: multikey quicksort on eight bytes at a time, all groups in step; a group is parted by a
pivot into less, equal and greater, and the equal part goes on with the next eight bytes.  Deep:
groups that still agree at SHALLOW bytes are ordered by a blind trie, which branches only at bytes
where members differ.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 64


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a number that sorts like the bytes."""
    out = np.zeros(len(data), dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def sort_strings(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order the strings ``data[s : s + length]`` within each group.

    Returns the order of the strings and, in that order, the number of the run of equal strings
    that each belongs to.  ``length`` is a multiple of eight.
    """
    word = words_at(data)
    order = np.argsort(group, kind="stable")
    # ``part`` numbers the groups of the strings in order; each has the depth it agrees to.
    part = np.cumsum(np.diff(group[order], prepend=group[order[:1]]) != 0)
    size = np.bincount(part) if len(part) else np.zeros(0, dtype=np.int64)
    depth = np.zeros(len(size), dtype=np.int64)
    while True:
        active = (size > 1) & (depth < SHALLOW)
        if not active.any():
            break
        rows = np.flatnonzero(active[part])
        mine = part[rows]
        key = word[start[order[rows]] + depth[mine]]
        first = np.cumsum(size) - size
        pivot = word[start[order[first + size // 2]] + np.minimum(depth, length - 8)][mine]
        side = (key > pivot).astype(np.int64) - (key < pivot)
        move = np.argsort(mine * 3 + side + 1, kind="stable")
        order[rows] = order[rows[move]]
        side = side[move]
        fresh = np.zeros(len(part), dtype=np.int64)
        fresh[rows] = side
        change = np.diff(part, prepend=-1) != 0
        change[1:] |= np.diff(fresh) != 0
        was = part[change]
        equal = active[was] & (fresh[change] == 0)
        part = np.cumsum(change) - 1
        depth = depth[was] + 8 * equal
        size = np.bincount(part)

    # Deep: pairs and groups of equal strings are seen at once, the others go through a trie.
    first = np.cumsum(size) - size
    new_run = np.diff(part, prepend=-1) != 0
    rows = np.flatnonzero((size > 1)[part])
    if len(rows):
        lead = order[first[part[rows]]]
        same = np.ones(len(rows), dtype=bool)
        for d in range(SHALLOW, length, 8):
            same &= word[start[order[rows]] + d] == word[start[lead] + d]
        uneven = np.unique(part[rows[~same]])
        text = data.tobytes() if len(uneven) else b""
        for g in uneven:
            a, n = first[g], size[g]
            members = order[a : a + n].copy()
            leaves = blind_trie([text[s + SHALLOW : s + length] for s in start[members].tolist()])
            at = a
            for leaf in leaves:
                order[at : at + len(leaf)] = members[leaf]
                new_run[at] = True
                at += len(leaf)
    return order, np.cumsum(new_run) - 1


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Indices of equal strings together, in order of the strings.

    A node is [place, {byte: child}], a leaf a list of indices.  A string first walks down blindly
    by the bytes at the nodes' places, is then compared with one leaf of where it came out, and
    enters at the place where the two differ.
    """
    root: list = [0]
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while isinstance(node[-1], dict):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[0]]
        if other == s:
            node.append(i)
            continue
        at = _differ(s, other)
        node, up, key = root, None, None
        while isinstance(node[-1], dict) and node[0] < at:
            up, key, node = node, s[node[0]], node[1][s[node[0]]]
        if isinstance(node[-1], dict) and node[0] == at:
            node[1][s[at]] = [i]
            continue
        branch = [at, {s[at]: [i], other[at]: node}]
        if up is None:
            root = branch
        else:
            up[1][key] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node[-1], dict):
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            out.append(node)
    return out


def _differ(a: bytes, b: bytes) -> int:
    """The first place where two strings of one length differ."""
    low, high = 0, len(a)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low
