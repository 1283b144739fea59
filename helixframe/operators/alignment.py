"""Alignment kernels for Python workers: edit distance, paths, affine alignment, partial-order consensus.

These are the sequential programs that columns can't express. They take and return plain strings; array work is
numpy, a row of the table at a time.
"""

from __future__ import annotations

import numpy as np


class Pattern:
    """A text to take edit distances from: Myers' bit-parallel recurrence on one big integer, with its masks kept."""

    def __init__(self, text: str):
        self.text, self.where = text, {}
        for i, ch in enumerate(text):
            self.where[ch] = self.where.get(ch, 0) | 1 << i

    def distance(self, other: str, most: int | None = None) -> int:
        """Unit edit distance, -1 if above most. What both texts begin and end with costs nothing and is left out."""
        a, b = self.text, other
        if a == b:
            return 0
        shared, head, tail = min(len(a), len(b)), 0, 0
        while head < shared and a[head] == b[head]:
            head += 1
        shared -= head
        while tail < shared and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        n, rest = len(a) - head - tail, b[head : len(b) - tail]
        d = n
        if not n or not rest:
            d = max(n, len(rest))
        else:
            full, top = (1 << n) - 1, 1 << (n - 1)
            masks = {ch: (self.where.get(ch, 0) >> head) & full for ch in set(rest)}
            up, down = full, 0
            for ch in rest:
                eq = masks[ch]
                x = eq | down
                cross = (((eq & up) + up) ^ up) | eq
                right = down | (full & ~(cross | up))
                left = up & cross
                if right & top:
                    d += 1
                elif left & top:
                    d -= 1
                right = right << 1 | 1
                up = (left << 1 | ~(x | right)) & full
                down = right & x
        return -1 if most is not None and d > most else d


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Unit edit distance, -1 if above most."""
    return 0 if a == b else Pattern(a).distance(b, most)


def infix_distance(pattern: str, text: str) -> int:
    """Fewest edits of the pattern against any infix of the text."""
    if not pattern:
        return 0
    p = np.frombuffer(pattern.encode(), np.uint8)
    row = np.arange(len(p) + 1)
    best, steps = len(p), np.arange(len(p) + 1)
    for ch in text.encode():
        new = np.minimum(np.append(0, row[:-1] + (p != ch)), row + 1)
        new[0] = 0
        row = np.minimum.accumulate(new - steps) + steps
        best = min(best, int(row[-1]))
    return best


def path(query: str, target: str) -> tuple[int, str, str]:
    """(distance, gapped query, gapped target) of a global alignment.

    Going back from the end, a base of the query alone is preferred, then one of the target alone, then both. The
    recurrence of edit_distance() is run with its states kept: bit i of a state says whether row i + 1 of the table is one above
    the row before it (up), or the column before it (right).
    """
    if query == target:
        return 0, query, target
    where: dict[str, int] = {}
    for i, ch in enumerate(query):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(query)) - 1
    up, down = full, 0
    ups, rights = [full], [0]
    for ch in target:
        eq = where.get(ch, 0)
        cross = (((eq & up) + up) ^ up) | eq
        right = down | (full & ~(cross | up))
        rights.append(right)
        left = (up & cross) << 1 & full
        right = (right << 1 | 1) & full
        x = eq | down
        up, down = left | (full & ~(x | right)), right & x
        ups.append(up)
    i, j, d, q, t = len(query), len(target), 0, [], []
    while i and j:
        bit = 1 << (i - 1)
        if ups[j] & bit:
            i -= 1
            q.append(query[i])
            t.append("-")
            d += 1
        elif rights[j] & bit:
            j -= 1
            q.append("-")
            t.append(target[j])
            d += 1
        else:
            i, j = i - 1, j - 1
            q.append(query[i])
            t.append(target[j])
            d += query[i] != target[j]
    head, lead = "".join(reversed(q)), "".join(reversed(t))
    return d + i + j, query[:i] + "-" * j + head, "-" * i + target[:j] + lead


def cigar_of(query_aln: str, target_aln: str) -> str:
    """Extended CIGAR of two gapped strings."""
    out: list[list] = []
    for x, y in zip(query_aln, target_aln, strict=True):
        op = "I" if y == "-" else "D" if x == "-" else "=" if x == y else "X"
        if out and out[-1][1] == op:
            out[-1][0] += 1
        else:
            out.append([1, op])
    return "".join(f"{n}{op}" for n, op in out)


def affine(a: str, b: str, match: int = 4, mismatch: int = -8, opening: int = 12, extension: int = 1) -> tuple[int, str, str]:
    """(score, gapped a, gapped b) with affine gaps, from end to end. Ties as in semi_global()."""
    return semi_global(a, b, match, mismatch, opening, extension, free=False)


def semi_global(a: str, b: str, match: int = 4, mismatch: int = -8, opening: int = 12, extension: int = 1, free: bool = True) -> tuple[int, str, str]:
    """(score, gapped a, gapped b) with affine gaps and, if free, free ends in both.

    A gap of n costs opening + (n - 1) * extension. Ties: diagonal, then a base of a alone, then of b alone; a gap is
    extended rather than opened; of equal ends, the first in the last row, else the first in the last column.
    """
    n, m = len(a), len(b)
    edge = lambda k: 0 if free or not k else -opening - (k - 1) * extension
    if not n or not m:
        return edge(n + m), a + "-" * m, "-" * n + b
    y = np.frombuffer(b.encode(), np.uint8)
    gain = {ch: np.where(y == ord(ch), match, mismatch).astype(np.int64) for ch in set(a)}
    low = -(10**9)
    along = np.arange(m + 1, dtype=np.int64) * extension
    opened_at = opening + along[:-1]
    score = np.array([edge(k) for k in range(m + 1)], np.int64)
    gap_b = np.full(m + 1, low, np.int64)  # best with a base of a alone at the end
    gap_a, diagonal, base, now, room = (np.full(m + 1, low, np.int64) for _ in range(5))
    source = np.zeros((n + 1, m + 1), np.uint8)
    longer_a, longer_b = np.ones((n + 1, m + 1), bool), np.zeros((n + 1, m + 1), bool)
    last_column = np.zeros(n + 1, np.int64)
    for i, ch in enumerate(a, 1):
        np.subtract(score, opening, out=room)
        gap_b -= extension
        np.greater_equal(gap_b, room, out=longer_b[i])
        np.maximum(gap_b, room, out=gap_b)
        gap_b[0] = low
        diagonal[0] = edge(i)
        np.add(score[:-1], gain[ch], out=diagonal[1:])
        np.maximum(diagonal, gap_b, out=base)
        base[0] = edge(i)
        # Best gap in b's direction for every column: the best earlier cell, less what the gap costs from there.
        np.add(base, along, out=room)
        np.maximum.accumulate(room, out=room)
        np.subtract(room[:-1], opened_at, out=gap_a[1:])
        np.maximum(base, gap_a, out=now)
        np.subtract(now, opening - extension, out=room)
        np.greater_equal(gap_a[:-1], room[:-1], out=longer_a[i, 1:])
        source[i] = (diagonal != now) * (2 - (gap_b == now))
        score, now = now, score
        last_column[i] = score[-1]
    ends = [(int(score.max()), n, int(score.argmax())), (int(last_column.max()), int(last_column.argmax()), m)]
    best, i, j = (ends[0] if ends[0][0] >= ends[1][0] else ends[1]) if free else (int(score[-1]), n, m)
    q, t = [*reversed(a[i:])] if i < n else [], []
    t = ["-"] * len(q)
    if j < m:
        q, t = ["-"] * (m - j), [*reversed(b[j:])]
    state = 0
    while i and j:
        if state == 0:
            step = source[i, j]
            if step == 0:
                i, j = i - 1, j - 1
                q.append(a[i])
                t.append(b[j])
                continue
            state = int(step)
        if state == 1:
            state = 1 if longer_b[i, j] else 0
            i -= 1
            q.append(a[i])
            t.append("-")
        else:
            state = 2 if longer_a[i, j] else 0
            j -= 1
            q.append("-")
            t.append(b[j])
    q += [*reversed(a[:i])] + ["-"] * j
    t += ["-"] * i + [*reversed(b[:j])]
    return best, "".join(reversed(q)), "".join(reversed(t))


class Graph:
    """Partial-order graph: local alignment with linear gaps, nodes fused on equal bases, heaviest bundle.

    Nodes that are aligned with each other make a column. Columns are kept in an order in which every edge goes forward: a new
    column is put before the next one on its sequence's way, so nothing is ever sorted anew.
    """

    def __init__(self, match: int = 5, mismatch: int = -4, gap: int = -2):
        self.match, self.mismatch, self.gap = match, mismatch, gap
        self.base: list[str] = []
        self.into: list[dict[int, int]] = []
        self.columns: list[list[int]] = []
        self.ways: dict[str, list[int]] = {}

    @property
    def order(self) -> list[int]:
        return [v for column in self.columns for v in column]

    def _node(self, base: str) -> int:
        self.base.append(base)
        self.into.append({})
        return len(self.base) - 1

    def _align(self, seq: str) -> list[tuple[int | None, int | None]]:
        """Pairs (node, position in seq) of the best local alignment.

        Scores are kept with the cost of a gap along seq added back for each position, so that such a gap is a running maximum.
        """
        m, step, order = len(seq), -self.gap, self.order
        s = np.frombuffer(seq.encode(), np.uint8)
        floor = np.arange(m + 1, dtype=np.int32) * step
        gain = {ch: np.where(s == ord(ch), self.match, self.mismatch).astype(np.int32) + step for ch in set(self.base)}
        rank = dict(zip(order, range(1, len(order) + 1), strict=True))
        table = np.empty((len(order) + 1, m + 1), np.int32)
        table[0] = floor
        over = np.empty(m + 1, np.int32)
        for i, v in enumerate(order, 1):
            row, fit = table[i], gain[self.base[v]]
            first, *more = [rank[u] for u in self.into[v]] or [0]
            above = table[first]
            row[0] = 0
            np.add(above[:-1], fit, out=row[1:])
            np.subtract(above, step, out=over)
            np.maximum(row, over, out=row)
            for before in more:
                above = table[before]
                np.add(above[:-1], fit, out=over[1:])
                np.maximum(row[1:], over[1:], out=row[1:])
                np.subtract(above, step, out=over)
                np.maximum(row, over, out=row)
            np.maximum(row, floor, out=row)
            np.maximum.accumulate(row, out=row)
        table -= floor
        i, j = divmod(int(table.argmax()), m + 1)
        score = table.item  # only the cells of one way are looked at
        out: list[tuple[int | None, int | None]] = []
        while i and j and (here := score(i, j)) > 0:
            v = order[i - 1]
            befores = [rank[u] for u in self.into[v]] or [0]
            need = here - (self.match if self.base[v] == seq[j - 1] else self.mismatch)
            for before in befores:
                if score(before, j - 1) == need:
                    out.append((v, j - 1))
                    i, j = before, j - 1
                    break
            else:
                for before in befores:
                    if score(before, j) + self.gap == here:
                        out.append((v, None))
                        i = before
                        break
                else:
                    out.append((None, j - 1))
                    j -= 1
        return out[::-1]

    def add(self, seq: str, times: int = 1) -> None:
        """Add a sequence, or as many copies of it; one that was added before goes the same way again."""
        if not seq:
            return
        if seq not in self.ways:
            self.ways[seq] = self._way(seq)
        way = self.ways[seq]
        for before, v in zip(way, way[1:], strict=False):
            self.into[v][before] = self.into[v].get(before, 0) + 2 * times

    def _way(self, seq: str) -> list[int]:
        """The nodes of a sequence; those that it lacks are made."""
        at = {v: i for i, column in enumerate(self.columns) for v in column}
        where: list[int | None] = [None] * len(seq)
        if self.columns:
            for v, j in self._align(seq):
                if v is not None and j is not None:
                    where[j] = at[v]
        way, fresh, ahead = [], {}, len(self.columns)
        for j in range(len(seq) - 1, -1, -1):
            column = where[j]
            if column is None:
                fresh.setdefault(ahead, []).append(new := self._node(seq[j]))
                way.append(new)
                continue
            ahead = column
            same = [u for u in self.columns[column] if self.base[u] == seq[j]]
            if not same:
                same = [self._node(seq[j])]
                self.columns[column].append(same[0])
            way.append(same[0])
        if fresh:
            self.columns = [c for i in range(len(self.columns) + 1) for c in [*([v] for v in reversed(fresh.get(i, []))), *self.columns[i : i + 1]]]
        return way[::-1]

    def consensus(self) -> str:
        """The path of the heaviest edges, carried on from its best node to an end of the graph."""
        order = self.order
        score, back = [-1] * len(self.base), [-1] * len(self.base)
        out_of: list[list[int]] = [[] for _ in self.base]
        for v in order:
            for u, w in self.into[v].items():
                out_of[u].append(v)
                if back[v] < 0 or (w, score[u]) >= (self.into[v][back[v]], score[back[v]]):
                    score[v], back[v] = w, u
            if back[v] >= 0:
                score[v] += score[back[v]]
        if not order:
            return ""
        best = max(order, key=lambda v: score[v])
        while out_of[best]:
            # Carry on: only paths through the best node count from here.
            rank = {v: i for i, v in enumerate(order)}
            for v in order[: rank[best]]:
                score[v] = -1
            for v in order[rank[best] + 1 :]:
                score[v], back[v] = -1, -1
                for u, w in self.into[v].items():
                    if score[u] != -1 and (back[v] < 0 or (w, score[u]) >= (self.into[v][back[v]], score[back[v]])):
                        back[v] = u
                if back[v] >= 0:
                    score[v] = self.into[v][back[v]] + score[back[v]]
            best = max(order[rank[best] + 1 :], key=lambda v: score[v])
        out = []
        while best >= 0:
            out.append(self.base[best])
            best = back[best]
        return "".join(reversed(out))


def consensus(segments: list[str]) -> str:
    """Partial-order consensus of segments, in the order given."""
    graph = Graph()
    for s in segments:
        graph.add(s)
    return graph.consensus()
