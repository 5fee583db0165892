"""Deep-shallow sorting of substrings.

Multikey quicksort, with eight bytes as a character and all groups of a level at once, orders the strings to a shallow depth. Groups that still share their beginning then go, one by one, into a blind trie: a string is led down by the branching bytes alone, compared once with the leaf it reaches, and put where they first differ.
"""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort looks at, bytes after them in which groups are told to be all one, and groups that are held as lists at a time.
SHALLOW, LOOK, GROUPS = 40, 64, 1 << 14


class BlindTrie:
    """Inner nodes: [depth, {byte: child}], with -1 for a string that ends there; leaves: (string, its members)."""

    def __init__(self, text: bytes, members: list[int]):
        self.root: list | tuple = (text, members)

    @staticmethod
    def _at(text: bytes, depth: int) -> int:
        return text[depth] if depth < len(text) else -1

    def add(self, text: bytes, added: list[int]) -> None:
        node, above, size = self.root, [], len(text)
        while type(node) is list:
            above.append(node)
            depth, children = node
            node = children.get(text[depth] if depth < size else -1)
            if node is None:  # any leaf below will do to find where they differ
                node = next(iter(children.values()))
        other, members = node
        if other == text:
            members.extend(added)
            return
        same, least = 0, min(size, len(other))
        while same < least and text[same] == other[same]:
            same += 1
        k = 0
        while k < len(above) and above[k][0] < same:
            k += 1
        leaf = (text, added)
        if k < len(above) and above[k][0] == same:
            above[k][1][self._at(text, same)] = leaf
            return
        below = above[k] if k < len(above) else node
        fork = [same, {self._at(other, same): below, self._at(text, same): leaf}]
        if k == 0:
            self.root = fork
        else:
            above[k - 1][1][self._at(text, above[k - 1][0])] = fork

    def leaves(self) -> list[list[int]]:
        """Members of each leaf, in the strings' order."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                out.append(node[1])
        return out


def _characters(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The eight bytes of each string from depth on, zeros after its end, and how many they are."""
    left = np.clip(lengths - depth, 0, 8)
    word = words[np.minimum(starts + depth, len(words) - 1)].astype(np.uint64)
    short = np.flatnonzero(left < 8)
    if len(short):
        away = (np.uint64(8) - np.maximum(left[short], 1).astype(np.uint64)) * np.uint64(8)
        word[short] = np.where(left[short] > 0, word[short] >> away << away, np.uint64(0))
    return word, left


def ranks(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """How many of the strings data[start : start + length] come before each one; equal strings get equal ranks."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))
    rank = np.zeros(len(starts), np.int64)
    active, begins = np.arange(len(starts)), np.zeros(1, np.int64)  # groups of equal beginnings, one after the other, and where each begins
    for depth in range(0, shallow, 8):
        if not len(active):
            return rank
        word, left = _characters(words, starts[active], lengths[active], depth)
        size = np.diff(np.append(begins, len(active)))
        head = np.repeat(begins, size)
        apart = np.repeat(np.logical_or.reduceat((word != word[head]) | (left != left[head]), begins), size)
        if apart.any():  # groups that are all one stay as they are
            at = np.flatnonzero(apart)
            keys = (*((left[at],) if (left[at] < 8).any() else ()), word[at], *((head[at],) if len(begins) > 1 else ()))
            order = at[np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0])]
            active[at], word[at], left[at] = active[order], word[order], left[order]
        split = np.zeros(len(active), bool)
        split[begins] = True
        split[1:] |= (word[1:] != word[:-1]) | (left[1:] != left[:-1])
        begins = np.flatnonzero(split)
        size = np.diff(np.append(begins, len(active)))
        rank[active] += np.repeat(begins, size) - head
        stays = (size > 1) & (left[begins] == 8)
        active, size = active[np.repeat(stays, size)], size[stays]
        begins = np.cumsum(size) - size
    if not len(active):
        return rank
    size = np.diff(np.append(begins, len(active)))
    head = np.repeat(active[begins], size)
    apart = lengths[active] != lengths[head]
    alike = np.flatnonzero(~apart & (lengths[active] > shallow))
    for depth in range(shallow, shallow + LOOK, 8):  # groups that are all one have their rank
        if not len(alike):
            break
        (word, left), (other, _) = (_characters(words, starts[x], lengths[x], depth) for x in (active[alike], head[alike]))
        apart[alike[word != other]] = True
        alike = alike[(word == other) & (left == 8)]
    apart[alike] = True
    groups = np.logical_or.reduceat(apart, begins)
    active, bounds = active[np.repeat(groups, size)], np.append(0, np.cumsum(size[groups]))
    text = data.tobytes() if len(active) else b""
    for g in range(0, len(bounds) - 1, GROUPS):  # so many at a time as lists
        _deep(text, starts, lengths, shallow, rank, active, bounds[g : g + GROUPS + 1])
    return rank


def _deep(text: bytes, starts: np.ndarray, lengths: np.ndarray, shallow: int, rank: np.ndarray, active: np.ndarray, bounds: np.ndarray) -> None:
    """Order groups that share their beginnings, one after the other."""
    here = active[bounds[0] : bounds[-1]]
    begins, ends, members = (starts[here] + shallow).tolist(), (starts[here] + lengths[here]).tolist(), here.tolist()
    cuts = (bounds - bounds[0]).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        different: dict[bytes, list[int]] = {}
        for k in range(a, b):
            different.setdefault(text[begins[k] : ends[k]], []).append(members[k])
        if len(different) == 1:
            continue
        leaves = iter(different.items())
        trie = BlindTrie(*next(leaves))
        for tail, same in leaves:
            trie.add(tail, same)
        before = int(rank[members[a]])
        for leaf in trie.leaves():
            rank[leaf] = before
            before += len(leaf)
