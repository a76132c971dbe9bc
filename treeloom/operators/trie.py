"""Nearest words by edit distance: names go down a trie of words together, as rows of numpy arrays.

A row stands for a name and a node and holds the distances between the node's letters and the name's beginnings,
of which only those within the bound of the diagonal count. Words with a common beginning share its rows; a node is left
out where no word below it can be as near as the best one found. Rows are dealt with a bounded number at a time.
"""

from __future__ import annotations

import numpy as np

#: Distances that are held at once, about.
CELLS = 1 << 21
FAR = 1 << 28


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


class Trie:
    """Words with their rank, the order among equally near ones."""

    def __init__(self, words: list[str], rank: list[int]):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.place, self.rank = np.array(order, np.int64), np.array(rank, np.int64)[order]
        text, size = _letters([words[i] for i in order])
        begin, alive, node, n = np.cumsum(size) - size, np.arange(len(order)), np.zeros(len(order), np.int64), 1
        self.levels = []  # first child of each node, word that ends there or -1, its words' fewest and most letters to come; the children's letters
        while len(alive):
            at, depth = np.searchsorted(node, np.arange(n)), len(self.levels)
            to_come = size[alive] - depth
            ended, word = to_come == 0, np.full(n, -1, np.int64)
            word[node[ended]] = alive[ended]
            low, high = np.minimum.reduceat(to_come, at), np.maximum.reduceat(to_come, at)
            alive, node = alive[~ended], node[~ended]
            letter = text[begin[alive] + depth]
            new = np.ones(len(alive), bool)
            new[1:] = (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])
            self.levels.append((np.searchsorted(node[new], np.arange(n + 1)), word, low, high, letter[new]))
            node, n = np.cumsum(new) - 1, int(new.sum())

    def nearest(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each name the distance and the number of its nearest word."""
        best, word, left, bound = np.zeros(len(names), np.int64), np.full(len(names), -1, np.int64), np.arange(len(names)), 0
        while len(left) and self.levels:
            best[left], word[left] = self.within([names[i] for i in left], bound)
            left, bound = left[word[left] < 0], max(bound + 1, bound * 3 // 2)
        return best, word

    def within(self, names: list[str], bound: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of up to `bound` edits; -1 for names that have none."""
        best, found = np.full(len(names), bound, np.int64), np.full(len(names), -1, np.int64)
        order = np.array(sorted(range(len(names)), key=lambda i: len(names[i])), np.int64)
        while len(order) and self.levels:  # names of like lengths, as many as fit
            longest = np.array([len(names[i]) for i in order]) + 2 * bound + 2
            n = max(1, int(np.searchsorted(longest * np.arange(1, len(order) + 1), CELLS, "right")))
            mine, order = order[:n], order[n:]
            best[mine], found[mine] = self._search([names[i] for i in mine], bound)
        return best, np.where(found >= 0, self.place[found] if len(self.place) else found, -1)

    def _search(self, names: list[str], bound: int) -> tuple[np.ndarray, np.ndarray]:
        text, size = _letters(names)
        k = min(bound, max(int(size.max()), len(self.levels)))
        width, limit = 2 * k + 1, max(1, CELLS // (2 * k + 1))
        padded = np.full((len(names), int(size.max()) + 2 * width + 1), 0xFFFFFFFF, np.uint32)
        row = np.repeat(np.arange(len(names)), size)
        padded[row, k + np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)] = text
        best, found, band = np.full(len(names), bound, np.int64), np.full(len(names), -1, np.int64), np.arange(width, dtype=np.int32)
        size = size.astype(np.int32)
        start = np.where(band >= k, band - k, FAR).astype(np.int32)
        todo = [(0, np.arange(len(names)), np.zeros(len(names), np.int64), np.tile(start, (len(names), 1)))]
        while todo:
            depth, who, node, cells = todo.pop()
            first, word, low, high, letter = self.levels[depth]
            # Letters that the name and the words have to come differ by so many at least.
            rest = (size[who] - np.int32(depth - k))[:, None] - band
            gap = np.maximum(rest - high[node].astype(np.int32)[:, None], low[node].astype(np.int32)[:, None] - rest)
            kept = np.where(rest >= 0, cells + np.maximum(gap, 0), FAR).min(1) <= best[who]
            who, node, cells = who[kept], node[kept], cells[kept]
            at = size[who] - depth + k
            ends = np.flatnonzero((word[node] >= 0) & (at >= 0) & (at < width))
            self._take(best, found, who[ends], word[node[ends]], cells[ends, at[ends]])
            many = first[node + 1] - first[node]
            inner = np.flatnonzero(many)
            if not len(inner):
                continue
            who, node, cells, total = who[inner], node[inner], cells[inner], np.cumsum(many[inner])
            part = (total - 1) // limit
            if part[-1]:  # more rows than are dealt with at once: the others wait
                own = max(1, int(np.searchsorted(part, 1)))
                if own < len(who):
                    todo.append((depth, who[own:], node[own:], cells[own:]))
                    # What ends here has been taken; to take it again changes nothing.
                who, node, cells, total = who[:own], node[:own], cells[:own], total[:own]
            many = np.diff(total, prepend=0)
            parent = np.repeat(np.arange(len(who)), many)
            child = np.arange(total[-1]) + np.repeat(first[node] - (total - many), many)
            who, cells = who[parent], cells[parent]
            new = cells + (padded[:, depth : depth + width][who] != letter[child][:, None])
            new[:, :-1] = np.minimum(new[:, :-1], cells[:, 1:] + 1)
            new = np.minimum.accumulate(new - band, axis=1) + band
            todo.append((depth + 1, who, child, np.minimum(new, FAR).astype(np.int32)))
        return best, found

    def _take(self, best: np.ndarray, found: np.ndarray, who: np.ndarray, word: np.ndarray, distance: np.ndarray) -> None:
        """Words at the end of their rows: the nearest of each name, of equally near ones the first by rank."""
        near = distance <= best[who]
        who, word, distance = who[near], word[near], distance[near]
        order = np.lexsort((self.rank[word], distance, who))
        order = order[np.flatnonzero(np.diff(who[order], prepend=-1))]
        who, word, distance = who[order], word[order], distance[order]
        better = (found[who] < 0) | (distance < best[who]) | (self.rank[word] < self.rank[found[who]])
        best[who[better]], found[who[better]] = distance[better], word[better]
