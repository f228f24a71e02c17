"""Cheapest edits of turn sequences to legal role orders: a rank-convergence parallel Viterbi.

Roles are legal if their initials read ``(s?(ua)+)?``: four states (nothing yet, after s,
after u, after a).  A turn may be kept, reroled to user or assistant, or deleted, and empty
turns inserted anywhere.  The recursion runs backward, from the costs of the end to those
of the start; only differences between the four costs matter for what is cheapest.

Many runs of turns are cut into chunks of bounded length, which all advance together, a turn
at a time, each from a speculative cost vector.  Fix-up passes run the chunks again whose
end turned out otherwise, until at some turn the new vector differs from the old one
only by a constant: everything before that turn holds already.  Passes end when no
chunk's end changes, so the result is that of one sequential run, whatever the chunks.

Vectors are kept less their minimum, and the minima apart, so vectors that differ by a
constant are equal and the absolute cost is a sum of minima.
"""
from __future__ import annotations

import numpy as np

#: Rows of a chunk.
CHUNK = 128
KEPT, REROLED, DELETED, INSERTED = 0, 1, 2, 5  # costs
TRUNCATED = 5  # more for a truncated turn that isn't deleted
_NEVER = 1 << 20

#: What is left to pay at the end in each state: inserted turns up to the next legal end.
TERMINAL = np.array([0, 2 * INSERTED, INSERTED, 0], np.int32)
#: State after an inserted or reroled turn.
_TURNED = np.array([2, 2, 3, 2])
#: State after a kept turn, by initial (s, u, a, other) and state; -1: not legal.
_KEPT_TO = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: Tables by code, 3 * initial + kind (0 sound, 1 truncated, 2 to be deleted), and state.
_KEEP_COST = np.array([[_NEVER if kind == 2 or to < 0 else KEPT + TRUNCATED * kind for to in row] for row in _KEPT_TO for kind in range(3)], np.int32)
_KEEP_NEXT = np.repeat(np.maximum(_KEPT_TO, 0), 3, axis=0)
_REROLE_COST = np.array([_NEVER if kind == 2 else REROLED + TRUNCATED * kind for _ in range(4) for kind in range(3)], np.int32)[:, None]
D, I, K, R = range(4)  # in ASCII order
LETTERS = np.frombuffer(b"DIKR", np.uint8)


def _step(after: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs before a turn from those after it ([m, 4]), and the ASCII-least cheapest way on in
    each state: next state, letter << 2, inserted turns before it << 4."""
    turned = after[:, _TURNED]
    delete, keep = after + DELETED, _KEEP_COST[code] + np.take_along_axis(after, _KEEP_NEXT[code], 1)
    cost = np.minimum(np.minimum(delete, keep), _REROLE_COST[code] + turned)
    u, a = np.minimum(cost[:, 2], cost[:, 3] + INSERTED), np.minimum(cost[:, 3], cost[:, 2] + INSERTED)
    before = np.stack([np.minimum(cost[:, 0], u + INSERTED), np.minimum(cost[:, 1], u + INSERTED), u, a], 1)
    letter = np.where(delete == before, D, np.where(before[:, _TURNED] + INSERTED == before, I, np.where(keep == before, K, R)))
    at, inserts, own = np.broadcast_to(np.arange(4), letter.shape), np.zeros_like(letter), letter
    for _ in range(2):
        more = own == I
        at, inserts = np.where(more, _TURNED[at], at), inserts + more
        own = np.take_along_axis(letter, at, 1)
    to = np.where(own == D, at, np.where(own == K, np.take_along_axis(_KEEP_NEXT[code], at, 1), _TURNED[at]))
    return before, (to | own << 2 | inserts << 4).astype(np.uint8)


class Runs:
    """Runs of turns, one after the other in ``codes``; ``ends`` are the costs behind each run."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, ends: np.ndarray, chunk: int = CHUNK):
        self.codes, self.lengths = codes, lengths
        self.first = np.cumsum(lengths) - lengths
        chunks = -(-lengths // chunk)
        self.run = np.repeat(np.arange(len(lengths)), chunks)
        self.chunk_of = np.cumsum(chunks) - chunks
        order = np.arange(len(self.run)) - self.chunk_of[self.run]
        self.order, self.chunks = order, chunks
        self.start = self.first[self.run] + order * chunk
        self.size = np.minimum(self.first[self.run] + lengths[self.run] - self.start, chunk)
        self.vectors = np.zeros((len(codes), 4), np.int32)
        self.minima = np.zeros(len(codes), np.int64)
        self.ways = np.zeros((len(codes), 4), np.uint8)
        low = ends.min(axis=1, initial=1 << 30)
        self.ends, self.low = (ends - low[:, None]).astype(np.int32), low
        self.passes = self._converge()

    def _converge(self) -> int:
        inner = self.order + 1 < self.chunks[self.run]  # another chunk of the run follows
        used = np.where(inner[:, None], 0, self.ends[self.run]).astype(np.int32)
        self._backward(np.arange(len(self.run)), used, first=True)
        passes, follow = 1, np.flatnonzero(inner)
        while True:
            true = self.vectors[self.start[follow + 1]] if len(follow) else np.zeros((0, 4), np.int32)
            wrong = (true != used[follow]).any(axis=1)
            if not wrong.any():
                return passes
            used[follow[wrong]] = true[wrong]
            self._backward(follow[wrong], used, first=False)
            passes += 1

    def _backward(self, which: np.ndarray, ends: np.ndarray, first: bool) -> None:
        which = which[np.argsort(-self.size[which], kind="stable")]
        now, t = ends[which], 0
        while len(which):
            rows = self.start[which] + self.size[which] - 1 - t
            before, ways = _step(now, self.codes[rows])
            low = before.min(axis=1)
            before -= low[:, None]
            same = (before == self.vectors[rows]).all(axis=1) & (not first)
            self.vectors[rows], self.ways[rows], self.minima[rows] = before, ways, low
            t += 1
            on = ~same & (self.size[which] > t)
            which, now = which[on], before[on]

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Cost vectors before each run, less their minimum, and these minima."""
        vectors, total = self.ends.copy(), np.concatenate([[0], np.cumsum(self.minima)])
        some = np.flatnonzero(self.lengths)
        vectors[some] = self.vectors[self.first[some]]
        return vectors, self.low + total[self.first + self.lengths] - total[self.first]

    def _forward(self, states: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
        """From the states before each chunk to those behind it; ``seen`` takes the states before each row."""
        order = np.argsort(-self.size, kind="stable")
        states, out, at = states[order], np.empty_like(states), order
        for t in range(int(self.size.max(initial=0))):
            n = int(np.searchsorted(-self.size[at], -t, "left"))  # chunks longer than t
            out[at[n:]] = states[n:]
            at, states = at[:n], states[:n]
            rows = self.start[at] + t
            if seen is not None:
                seen[rows] = states[:, 0]
            states = np.take_along_axis(self.ways[rows], states, 1).astype(np.int64) & 3
        out[at] = states
        return out

    def _through(self, states: np.ndarray, maps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States behind each run and before each chunk, from those before each run."""
        before = np.zeros((len(self.run), states.shape[1]), np.int64)
        states = states.copy()
        for k in range(int(self.chunks.max(initial=0))):
            at = np.flatnonzero(self.chunks > k)
            c = self.chunk_of[at] + k
            before[c] = states[at]
            states[at] = np.take_along_axis(maps[c], states[at], 1)
        return states, before

    def maps(self) -> np.ndarray:
        """State behind each run for each of the four states before it."""
        four = np.tile(np.arange(4), (len(self.run), 1))
        return self._through(np.tile(np.arange(4), (len(self.lengths), 1)), self._forward(four))[0]

    def trace(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Least cheapest edits from the state before each run: per row the state before it,
        inserted turns and letter, and per run the state behind it."""
        four = np.tile(np.arange(4), (len(self.run), 1))
        behind, before = self._through(states[:, None], self._forward(four))
        seen = np.zeros(len(self.codes), np.int64)
        self._forward(before, seen)
        ways = self.ways[np.arange(len(seen)), seen].astype(np.int64)
        return seen, ways >> 4, ways >> 2 & 3, behind[:, 0]


def refit(codes: np.ndarray, old: np.ndarray, new: np.ndarray, tail: int = 4096) -> tuple[np.ndarray | None, int]:
    """A run's end is now ``new``, not ``old``: the vector before it (None: the same as before)
    and what to add to the minimum (to 0 where the vector is new)."""
    n = len(codes)
    while True:
        size = np.array([min(tail, n)])
        part = codes[n - size[0]:]
        (was, was_low), (now, now_low) = (Runs(part, size, end[None]).starts() for end in (old, new))
        if (was == now).all():
            return None, int(now_low[0] - was_low[0])
        if size[0] == n:
            return now[0], int(now_low[0])
        tail *= 8


def audit(inserts: np.ndarray, letters: np.ndarray) -> bytes:
    """Letters of a run, each behind its inserted turns."""
    out = np.full(int(inserts.sum()) + len(letters), LETTERS[I], np.uint8)
    out[np.cumsum(inserts + 1) - 1] = LETTERS[letters]
    return out.tobytes()


#: Inserted turns behind the last row, by state.
CLOSING = (0, 2, 1, 0)


def next_role(state: int) -> tuple[str, int]:
    """Role of a turn inserted or reroled in a state, and the state after it."""
    return ("assistant", 3) if state == 2 else ("user", 2)
