"""Minimal acyclic transducer over byte strings with id sequences as output (used by operator 12).

`compile_lexicon` adds the words in sorted order and keeps one state for each distinct (final, outputs, arcs): equal
suffixes are shared.  The output of a word is the concatenation of its arcs' outputs and of its last state's; common
beginnings of the outputs are moved as near to the start as they go, so that what is left after the letters that tell
words apart is the same for many words.  The result is one block of bytes; `Transducer` maps it from a file and looks
up many words at once.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_PARTS = (("key", "<i8"), ("slot", "<i4"), ("target", "<u4"), ("out", "<u4"), ("out_end", "<u4"), ("final", "u1"), ("tail", "<u4"),
          ("tail_end", "<u4"), ("pool", "<u4"))


def hash_slots(keys: np.ndarray) -> np.ndarray:
    """Open-addressing table of distinct 64-bit `keys`: their positions, -1 in empty slots."""
    slots = np.full(1 << max(4 * len(keys), 4).bit_length(), -1, np.int32)
    rest = np.arange(len(keys), dtype=np.int32)
    at = _slot_of(keys, slots)
    while len(rest):
        free = slots[at] < 0
        slots[at[free]] = rest[free]  # of several that want one slot, one stays
        lost = slots[at] != rest
        rest, at = rest[lost], (at[lost] + 1) & (len(slots) - 1)
    return slots


def find(keys: np.ndarray, slots: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Positions of `want` among `keys`, -1 where absent."""
    at = _slot_of(want, slots)
    out = slots[at]
    go = np.flatnonzero((out >= 0) & (keys[out] != want)) if len(keys) else np.zeros(0, np.int64)
    while len(go):
        at[go] = (at[go] + 1) & (len(slots) - 1)
        out[go] = slots[at[go]]
        go = go[(out[go] >= 0) & (keys[out[go]] != want[go])]
    return out


def _slot_of(keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
    mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(65 - len(slots).bit_length())).view(np.int64)


class _State:
    __slots__ = ("arcs", "final", "tail")

    def __init__(self):
        self.arcs: list[list] = []  # [byte, target, output]
        self.final = False
        self.tail: tuple[int, ...] = ()


def _shared(a, b) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def compile_lexicon(items: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The automaton of (word, ids) pairs; words distinct and in byte order."""
    register: dict[tuple, int] = {}

    def settled(state: _State) -> int:
        form = (state.final, state.tail, tuple(map(tuple, state.arcs)))
        return register.setdefault(form, len(register))

    path, last = [_State()], b""
    for word, ids in items:
        p = _shared(last, word)
        for i in range(len(last), p, -1):
            path[i - 1].arcs[-1][1] = settled(path[i])
        del path[p + 1:]
        for i in range(p):  # what the two words' outputs share stays, the rest moves behind the next letter
            arc, below = path[i].arcs[-1], path[i + 1]
            n = _shared(arc[2], ids)
            if rest := arc[2][n:]:
                for a in below.arcs:
                    a[2] = rest + a[2]
                if below.final:
                    below.tail = rest + below.tail
                arc[2] = arc[2][:n]
            ids = ids[n:]
        for k, b in enumerate(word[p:]):
            path[-1].arcs.append([b, -1, ids if k == 0 else ()])
            path.append(_State())
        if p == len(word):  # only the empty word as the first one
            path[-1].tail = ids
        path[-1].final, last = True, word
    for i in range(len(last), 0, -1):
        path[i - 1].arcs[-1][1] = settled(path[i])
    root = settled(path[0])
    return _packed(register, root)


def _packed(register: dict[tuple, int], root: int) -> bytes:
    """Arrays of the states and arcs, the root as state 0."""
    number = {s: s for s in range(len(register))}
    number[0], number[root] = root, 0  # the root changes places with state 0
    if root == 0:
        number[0] = 0
    pool: list[int] = []
    place: dict[tuple, int] = {}

    def stored(ids: tuple) -> tuple[int, int]:
        if ids not in place:
            place[ids] = len(pool)
            pool.extend(ids)
        return place[ids], place[ids] + len(ids)

    final, tails, arcs = np.zeros(len(register), "u1"), np.zeros((len(register), 2), "<u4"), []
    for (is_final, tail, out), s in register.items():
        n = number[s]
        final[n], tails[n] = is_final, stored(tail)
        arcs += [(n << 8 | b, number[t], *stored(o)) for b, t, o in out]
    arcs.sort()
    col = lambda i, kind: np.array([a[i] for a in arcs], kind)
    key = col(0, "<i8")
    data = {"key": key, "slot": hash_slots(key), "target": col(1, "<u4"), "out": col(2, "<u4"), "out_end": col(3, "<u4"), "final": final,
            "tail": tails[:, 0].copy(), "tail_end": tails[:, 1].copy(), "pool": np.array(pool, "<u4")}
    sizes = np.array([len(data[name]) for name, _ in _PARTS], "<u8")
    return sizes.tobytes() + b"".join(data[name].tobytes() for name, _ in _PARTS)


class Transducer:
    """A compiled lexicon, memory-mapped: the workers of a machine share its pages."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        sizes = np.frombuffer(data[:8 * len(_PARTS)].tobytes(), "<u8")
        at = 8 * len(_PARTS)
        for (name, kind), n in zip(_PARTS, sizes):
            end = at + int(n) * np.dtype(kind).itemsize
            setattr(self, name, np.ndarray(int(n), kind, data, at) if n else np.zeros(0, kind))
            at = end

    def lookup(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word whether it is in the lexicon; the ids of those words one after another; their numbers of ids."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        buf = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        state = np.zeros(n, np.int64)
        known = np.zeros(n, bool)
        steps: list[np.ndarray] = []  # arc of each word at each step, -1 where it has none
        at = np.arange(n)
        while len(at):
            done = size[at] == len(steps)
            known[at[done]] = self.final[state[at[done]]] > 0
            at = at[~done]
            if not len(at) or not len(self.key):
                break
            pos = find(self.key, self.slot, state[at] << 8 | buf[first[at] + len(steps)])
            hit = pos >= 0
            at, pos = at[hit], pos[hit]
            arc = np.full(n, -1, np.int64)
            arc[at] = pos
            steps.append(arc)
            state[at] = self.target[pos]
        found = np.flatnonzero(known)
        arcs = np.stack([s[found] for s in steps], 1) if steps else np.zeros((len(found), 0), np.int64)
        ends = state[found]
        lo = np.concatenate([np.where(arcs < 0, 0, self.out[arcs] if len(self.out) else 0),
                             self.tail[ends][:, None]], 1).astype(np.int64)
        hi = np.concatenate([np.where(arcs < 0, 0, self.out_end[arcs] if len(self.out) else 0),
                             self.tail_end[ends][:, None]], 1).astype(np.int64)
        length = hi - lo
        flat = length.ravel()
        total = np.cumsum(flat)
        ids = self.pool[np.arange(total[-1] if len(total) else 0) + np.repeat(lo.ravel() - (total - flat), flat)]
        return known, ids, length.sum(1)
