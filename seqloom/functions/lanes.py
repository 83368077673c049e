"""Edit distances of many pairs at once: rows of a pair's table as bits of 64-bit words, words as lanes of arrays.

A pair's pattern is cut into blocks of 64 rows. Block b does text column t - b at step t, so that all blocks
of all pairs take a step together, each with what the block above gave out one step before. A step is a few operations on
whole arrays; nothing loops over letters of a single pair.

With a bound on the edits only part of a table is visited. A block takes part while its rows are within the
diagonals that the bound leaves, and while it, or the block above it, has a cell within the bound: every EPOCH steps blocks
are dropped and added by that, and pairs without a block left are at their end. A best place that is found lowers the bound.
What lies outside is taken for one edit more than its neighbour, never for less, so that distances within the bound are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GLOBAL, PREFIX, INFIX = "global", "prefix", "infix"
#: Rows of a block, steps between two looks at the bound (fewer than rows, so that a path crosses one border of blocks at most).
ROWS, EPOCH = 64, 32
#: The bound that is tried first; pairs beyond it are done again with a bound WIDER times as large, up to their own.
NARROW, WIDER = 64, 16
#: Blocks of the pairs that are done together, and bytes of their letters' masks.
TOGETHER, MASK_BYTES = 131_072, 128 << 20
FAR = np.int64(1) << 40
_ONE, _ALL = np.uint64(1), ~np.uint64(0)


def coded(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def groups(sizes: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    """Numbers of the pairs (pattern length, text length) that are done together, of similar text lengths."""
    now, blocks = [], 0
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i][1]):
        own = -(-sizes[i][0] // ROWS)
        if now and blocks + own > TOGETHER:
            yield np.array(now)
            now, blocks = [], 0
        now.append(i)
        blocks += own
    if now:
        yield np.array(now)


class Table:
    """The tables of several pairs, of non-empty patterns and texts, as blocks in a row: those of the first pair, then the next."""

    def __init__(self, patterns: list[np.ndarray], texts: list[np.ndarray], most: np.ndarray, mode: str, last: bool = False):
        self.mode, self.last, lanes = mode, last, len(patterns)
        self.m = np.array([len(x) for x in patterns], np.int64)
        self.n = np.array([len(x) for x in texts], np.int64)
        self.blocks = -(-self.m // ROWS)
        self.start = np.cumsum(self.blocks) - self.blocks
        self.size = size = int(self.blocks.sum())
        self.lane = np.repeat(np.arange(lanes), self.blocks)
        self.block = np.arange(size) - self.start[self.lane]
        self.end_cell = self.start + self.blocks - 1
        limit = np.maximum(self.m, self.n) if mode == GLOBAL else self.m
        self.most = np.minimum(most, limit)
        top = self.block * ROWS + 1
        bottom = np.minimum(top + ROWS - 1, self.m[self.lane])
        self.rows = bottom - top + 1
        longer = self.m - self.n
        low = longer - self.most if mode == INFIX else np.maximum(-self.most, longer - self.most)
        high = np.minimum(self.most, longer + self.most) if mode == GLOBAL else self.most
        self.first_column = np.maximum(1, top - high[self.lane])
        self.last_column = np.minimum(self.n[self.lane], bottom - low[self.lane])
        self.shift = np.full(size, ROWS - 1, np.uint64)
        self.shift[self.end_cell] = ((self.m - 1) % ROWS).astype(np.uint64)
        self.up, self.down = np.full(size, _ALL), np.zeros(size, np.uint64)  # rows one more, and one less, than the row above
        self.score = bottom.astype(np.int64)  # at a block's lowest row
        self.visited = 0
        self._masks(patterns, texts)

    def _masks(self, patterns: list[np.ndarray], texts: list[np.ndarray]) -> None:
        letters, every = np.concatenate(patterns), np.concatenate(texts)
        known = np.zeros(int(max(letters.max(), every.max())) + 1, np.int64)
        known[letters] = 1
        known = np.cumsum(known) * known  # 0: a letter of no pattern
        pair = np.repeat(np.arange(len(patterns)), self.m)
        row = np.arange(len(letters)) - (np.cumsum(self.m) - self.m)[pair]
        masks = np.zeros((int(known.max()) + 1) * self.size, np.uint64)
        np.bitwise_or.at(masks, known[letters] * self.size + self.start[pair] + row // ROWS, _ONE << (row % ROWS).astype(np.uint64))
        self.masks = masks
        # columns before and behind a text have no letter, and the first leave the table as it is
        margin = self.blocks + EPOCH + 1
        self.origin = np.cumsum(self.n + 2 * margin) - self.n - margin - 1
        self.text = np.zeros(int((self.n + 2 * margin).sum()), np.int64)
        at = np.repeat(self.origin + 1 - (np.cumsum(self.n) - self.n), self.n) + np.arange(len(every))
        self.text[at] = known[every] * self.size

    def run(self, record: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end) of each pair, -1 beyond its bound. With record, the bits of all steps are kept."""
        lanes = len(self.m)
        best = np.where(self.m <= self.most, self.m, FAR) if self.mode != GLOBAL else np.full(lanes, FAR)
        end = np.zeros(lanes, np.int64)
        most, steps = self.most.copy(), int((self.n + self.blocks).max()) - 1
        if record:
            self.kept = np.zeros((2, -(-steps // EPOCH) * EPOCH, self.size), np.uint64)
        used = _ALL >> (ROWS - self.rows).astype(np.uint64)
        live, cells = np.ones(self.size, bool), np.arange(self.size)
        given = np.zeros((2, self.size), np.uint64)  # what a block gave out last: one more, one less than the column before
        for t in range(0, steps, EPOCH):
            # blocks with a cell within the bound, and those below
            near = cells[self.score[cells] - np.bitwise_count(self.up[cells] & used[cells]) <= most[self.lane[cells]]]
            below = near[self.block[near] + 1 < self.blocks[self.lane[near]]] + 1
            near = np.unique(np.concatenate([near, below]))
            column = t - self.block[near] + 1
            took, cells = cells, near[(column + EPOCH > self.first_column[near]) & (column <= self.last_column[near])]
            if not len(cells):
                break
            new = cells[~live[cells] & (self.block[cells] > 0)]
            self.up[new], self.down[new] = _ALL, 0
            self.score[new] = self.score[new - 1] - given[0, new - 1].astype(np.int64) + given[1, new - 1].astype(np.int64) + self.rows[new]
            ends = np.flatnonzero(self.end_cell[self.lane[cells]] == cells)
            came = self._epoch(t, cells, given, live, ends, record)
            live[took] = False
            live[cells] = True
            if not len(ends):
                continue
            lane = self.lane[cells[ends]]
            at = t - self.block[cells[ends]] + 1 + np.arange(EPOCH)[:, None]
            ok = at == self.n[lane] if self.mode == GLOBAL else (at >= 1) & (at <= self.n[lane])
            came = np.where(ok, came, FAR)
            pick = EPOCH - 1 - came[::-1].argmin(axis=0) if self.last else came.argmin(axis=0)
            low = came[pick, np.arange(len(lane))]
            better = low <= best[lane] if self.last else low < best[lane]
            better &= low < FAR
            best[lane[better]], end[lane[better]] = low[better], at[pick, np.arange(len(lane))][better]
            if self.mode != GLOBAL:
                most = np.minimum(most, best if self.last else best - 1)
        return np.where(best <= self.most, best, -1), np.where(best <= self.most, end, -1)

    def _epoch(self, t: int, cells: np.ndarray, given: np.ndarray, live: np.ndarray, ends: np.ndarray, record: bool) -> np.ndarray:
        """EPOCH steps of some blocks; the scores in the lowest row of pairs, at the places `ends` of cells, after each."""
        self.visited += EPOCH * len(cells)
        size, lane, block = len(cells), self.lane[cells], self.block[cells]
        up, down, more, less = self.up[cells], self.down[cells], given[0, cells], given[1, cells]
        shift, at = self.shift[cells], self.origin[lane] + (t - block + 1)
        heads = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1] + 1)) | (block == 0))  # blocks without one above
        edge = np.where((block[heads] == 0) & (self.mode == INFIX), 0, 1).astype(np.uint64)
        # in the first step what the block above gave out counts where it took part before, later where it takes part now
        before = (block > 0) & live[cells - 1]
        first_more, first_less = np.where(before, given[0, cells - 1], np.where((block == 0) & (self.mode == INFIX), 0, 1).astype(np.uint64)), np.where(before, given[1, cells - 1], np.uint64(0))
        where, scores = np.empty(size, np.int64), np.zeros(size, np.int64)
        eq, x, plus, minus, rest, come_more, come_less = (np.empty(size, np.uint64) for _ in range(7))
        came = np.empty((EPOCH, len(ends)), np.int64)
        one = _ONE
        for e in range(EPOCH):
            if e:
                come_more[1:], come_less[1:] = more[:-1], less[:-1]
                come_more[heads], come_less[heads] = edge, 0
            else:
                come_more[:], come_less[:] = first_more, first_less
            np.take(self.text, at, out=where)
            at += 1
            where += cells
            np.take(self.masks, where, out=eq)
            np.bitwise_or(eq, down, out=rest)
            eq |= come_less
            np.bitwise_and(eq, up, out=x)
            x += up
            x ^= up
            x |= eq
            np.bitwise_or(x, up, out=plus)
            np.invert(plus, out=plus)
            plus |= down
            np.bitwise_and(up, x, out=minus)
            if record:
                self.kept[1, t + e, cells] = plus
            np.right_shift(plus, shift, out=more)
            more &= one
            np.right_shift(minus, shift, out=less)
            less &= one
            scores += more.view(np.int64)
            scores -= less.view(np.int64)
            plus <<= one
            plus |= come_more
            minus <<= one
            minus |= come_less
            np.bitwise_or(rest, plus, out=up)
            np.invert(up, out=up)
            up |= minus
            np.bitwise_and(plus, rest, out=down)
            if record:
                self.kept[0, t + e, cells] = up
            came[e] = scores[ends]
        came += self.score[cells[ends]]
        self.up[cells], self.down[cells] = up, down
        given[0, cells], given[1, cells] = more, less
        self.score[cells] += scores
        return came

    def paths(self, end: np.ndarray) -> list[str]:
        """After run(record=True), whose texts end at `end`: = and X for columns, I for a pattern letter alone, D for a text letter alone.

        Walked back from the lowest row, all pairs in step; an insertion comes before a deletion, that before a column.
        """
        i, j = self.m.copy(), end.copy()
        lanes, out = np.arange(len(i)), []
        while True:
            open_ = (i > 0) | ((j > 0) & (self.mode != INFIX))
            if not open_.any():
                break
            row = np.maximum(i - 1, 0)
            b, bit = row // ROWS, (row % ROWS).astype(np.uint64)
            t, cell = np.maximum(j + b - 1, 0), self.start + b
            above = (i > 0) & ((j == 0) | (self.kept[0, t, cell] >> bit & _ONE > 0))
            left = ~above & (j > 0) & ((i == 0) | (self.kept[1, t, cell] >> bit & _ONE > 0))
            equal = self.masks[self.text[self.origin + j] + cell] >> bit & _ONE > 0
            step = np.where(above, 73, np.where(left, 68, np.where(equal, 61, 88)))  # I, D, =, X
            out.append(np.where(open_, step, 0).astype(np.uint8))
            i -= open_ & ~left
            j -= open_ & ~above
        steps = np.array(out, np.uint8).reshape(-1, len(lanes))[::-1]
        return [steps[:, k][steps[:, k] > 0].tobytes().decode() for k in lanes]


def distances(patterns: list[np.ndarray], texts: list[np.ndarray], most: np.ndarray | None = None, mode: str = INFIX, last: bool = False, cells: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) of each pair: the least edits, and the first (or last) end in the text at which they are reached.

    (-1, -1) if more than `most` edits are needed. cells: the number of cells visited is added to it, as one more entry.
    """
    m, n = (np.array([len(x) for x in side], np.int64) for side in (patterns, texts))
    bound = np.full(len(m), FAR) if most is None else np.asarray(most, np.int64)
    plain = (m == 0) | (n == 0)
    edits = np.where(plain, np.maximum(m, n) if mode == GLOBAL else m, -1)
    end = np.where(plain & (mode == GLOBAL), n, 0)
    if last and mode != GLOBAL:
        end = np.where(m == 0, n if mode == INFIX else 0, end)
    fail = np.where(plain, edits > bound, (np.abs(m - n) if mode == GLOBAL else m - n) > bound)
    todo, visited = np.flatnonzero(~plain & ~fail), 0
    most, tried = np.minimum(bound, np.maximum(m, n)), NARROW
    while len(todo):
        for part in groups(list(zip(m[todo].tolist(), n[todo].tolist(), strict=True))):
            for some in _masked(patterns, todo[part]):
                table = Table([patterns[i] for i in some], [texts[i] for i in some], np.minimum(most[some], tried), mode, last)
                edits[some], end[some] = table.run()
                visited += table.visited
        todo = todo[(edits[todo] < 0) & (most[todo] > tried)]
        tried *= WIDER
    if cells is not None:
        cells.append(visited * ROWS)
    edits[fail] = -1
    end[edits < 0] = -1
    return edits, end


def _masked(patterns: list[np.ndarray], own: np.ndarray) -> Iterator[np.ndarray]:
    """own in parts whose letters' masks are within MASK_BYTES, or of one pair."""
    letters = len(np.unique(np.concatenate([patterns[i] for i in own]))) + 1
    blocks = np.cumsum([-(-len(patterns[i]) // ROWS) for i in own])
    parts = max(1, int(-(-letters * blocks[-1] * 8 // MASK_BYTES)))
    cuts = np.searchsorted(blocks, np.arange(1, parts) * blocks[-1] / parts)
    yield from (x for x in np.split(own, np.unique(cuts)) if len(x))


#: Bytes of bit columns that are kept for walking back.
KEPT_BYTES = 64 << 20


def kept_bytes(m: int, n: int) -> int:
    """Bytes of the bit columns of a pair."""
    blocks = -(-m // ROWS)
    return 16 * blocks * (n + blocks + EPOCH)


def traced(patterns: list[np.ndarray], texts: list[np.ndarray], most: list[int], mode: str) -> list[str]:
    """Paths of pairs with so many edits, whose texts end where their place does."""
    out, todo = [""] * len(patterns), []
    for i, (p, t) in enumerate(zip(patterns, texts, strict=True)):
        if len(p) and len(t):
            todo.append(i)
        else:
            out[i] = "I" * len(p) + ("D" * len(t) if mode != INFIX else "")
    at = 0
    todo.sort(key=lambda i: len(texts[i]))
    while at < len(todo):
        size, stop = 0, at
        while stop < len(todo):  # all have as many steps as the longest
            own = size + -(-len(patterns[todo[stop]]) // ROWS)
            if stop > at and own * (len(texts[todo[stop]]) + own + EPOCH) * 16 > KEPT_BYTES:
                break
            size, stop = own, stop + 1
        some = todo[at:stop]
        table = Table([patterns[i] for i in some], [texts[i] for i in some], np.array([most[i] for i in some]), mode)
        table.run(record=True)
        for i, path in zip(some, table.paths(table.n), strict=True):
            out[i] = path
        at = stop
    return out
