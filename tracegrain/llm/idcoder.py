"""A range coder for token ids that mixes predictions of orders 0, 1 and 2, over many blocks at once.

Every block begins with an empty model, so blocks are coded side by side: lane k of each array belongs to block k, and
one step codes the next id of every block. An id is known by its rank, the place of its first occurrence in the block.

* Order 0 is a table of how often each rank occurred, made anew along the way; an id it lacks is escaped and written
  plainly among the vocabulary's ids.
* Orders 1 and 2 predict the rank that followed the last rank, or the last two, before.

Their shares are added up in one table of frequencies: a prediction's rank has its share of order 0 and, on top, what its
order has earned at this confidence in this block.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK, LANES, LEAST = 512, 4096, 128
PAIRS = 2048
FULL, LOW = 1 << 48, 1 << 32
#: Steps at which tables are made anew.
REBUILT = {32, 64, 128}
EVERY = 256
#: How likely a prediction is right by its confidence, before the block has shown it; counts as so many tries.
PRIOR, TRIES = np.array([0.0, 0.05, 0.2, 0.4, 0.6, 0.7, 0.8, 0.9]), 4


class _Model:
    """What all lanes have learned of their blocks. Encoder and decoder take the same steps. Ranks count from 1; 0 is none."""

    def __init__(self, lanes: int, block: int):
        self.block, self.size = block, block + 2
        self.lane = np.arange(lanes)
        self.ids = np.zeros(lanes * self.size, np.int32)
        self.history = np.zeros((block, lanes), np.int16)
        self.known, self.escape, self.total = np.zeros(lanes, np.int64), np.ones(lanes, np.int32), 0
        self.after1, self.after2 = np.zeros(lanes * self.size, np.int16), np.zeros(lanes * PAIRS, np.int16)
        self.below, self.sorted = np.zeros(lanes * (self.size + 1), np.int16), np.zeros((lanes, 1), np.int16)
        self.tries, self.hits = np.full((lanes, 16), TRIES, np.int64), np.tile(TRIES * PRIOR, (lanes, 2))
        self.seen = np.zeros((EVERY, 2, lanes), np.int16)
        self.fresh = 0
        self.last = [np.zeros(lanes, np.int64)] * 2
        self._aligned()

    def _aligned(self) -> None:
        n = self.lane
        self.first, self.pair, self.table = n * self.size, n * PAIRS, n * (self.size + 1)
        self.sure = np.stack([n * 16, n * 16 + 8])
        self.gain = np.minimum(49, self.hits / (self.tries - self.hits + 0.5))
        self.gain = (256 * self.gain).astype(np.int32).reshape(-1)
        self.k = np.empty((2, len(n)), np.int64)

    def predict(self, at: int) -> None:
        """Set both predictions (``c``), their shares (``e``) and the table's ``sum``."""
        if at in REBUILT or at and at % EVERY == 0:
            self._rebuild(at)
        np.add(self.first, self.last[0], out=self.k[0])
        np.add(self.pair, (self.last[1] * 2654435 + self.last[0]) & (PAIRS - 1), out=self.k[1])
        v = np.empty((2, len(self.lane)), np.int16)
        self.after1.take(self.k[0], out=v[0], mode="wrap")
        self.after2.take(self.k[1], out=v[1], mode="wrap")
        self.v, self.c = v, (v >> 3).astype(np.int32)
        base = self.escape + np.int32(self.total)
        self.e = (self.gain.take(self.sure + (v & 7)) * base) >> 8
        self.sum = base + self.e[0] + self.e[1]

    def interval(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) of ranks in the table; size 0 if it lacks them."""
        k = self.table + rank
        begin = self.below.take(k).astype(np.int32)
        size = self.below.take(k + 1) - begin
        more, same = (rank > self.c) * self.e, (rank == self.c) * self.e
        return begin + more[0] + more[1], size + same[0] + same[1]

    def find(self, t: np.ndarray) -> np.ndarray:
        """The rank at place ``t`` of the table, 0 in the escape's share."""
        (c0, c1), (e0, e1) = self.c, self.e
        swap = c0 > c1
        c = np.stack([np.minimum(c0, c1), np.maximum(c0, c1)])
        e = np.stack([np.where(swap, e1, e0), np.where(swap, e0, e1)])
        k = self.table + c
        begin, end = self.below.take(k), self.below.take(k + 1) + e
        past = t >= end[0]
        low = (t >= begin[0]) & ~past
        t = t - past * e[0]
        past = t >= end[1]
        high = (t >= begin[1]) & ~past
        t = t - past * e[1]
        width = self.sorted.shape[1]
        plain = self.sorted.reshape(-1).take(self.lane * width + np.minimum(t >> 1, width - 1))
        return np.where(low, c[0], np.where(high, c[1], np.where(t < self.total, plain, 0)))

    def update(self, at: int, rank: np.ndarray) -> None:
        v, sure, hit = self.v, self.v & 7, self.c == rank
        self.seen[self.fresh] = sure + (hit << 3)
        self.fresh += 1
        new = np.where(hit, v + (sure < 7), np.where(sure > 1, v - sure + 1, (rank.astype(np.int16) << 3) + 1))
        self.after1[self.k[0]] = new[0]
        self.after2[self.k[1]] = new[1]
        self.history[at] = rank
        self.last = [rank, self.last[0]]

    def add(self, lanes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """New ranks for ``ids`` of ``lanes``."""
        self.known[lanes] += 1
        rank = self.known[lanes]
        self.ids[self.first[lanes] + rank] = ids
        return rank

    def _rebuild(self, at: int) -> None:
        n, most = len(self.lane), int(self.known.max()) + 1
        past = self.history[:at].T.copy()
        counts = np.bincount((past + (self.lane * most)[:, None]).ravel(), minlength=n * most).reshape(n, most)
        below = self.below.reshape(n, self.size + 1)
        below[:, 1 : most + 1] = 2 * np.cumsum(counts, axis=1)
        below[:, most + 1 :] = 2 * at
        past.sort(axis=1, kind="stable")
        self.sorted, self.total, self.escape = past, 2 * at, (self.known + 1).astype(np.int32)
        seen = self.seen[: self.fresh]
        place = (seen & 7) + np.array([0, 8], np.int16)[:, None]
        for what, total in ((place, self.tries), (place[seen > 7], self.hits)):
            lanes = np.broadcast_to(self.lane * 16, seen.shape)
            total += np.bincount(((lanes if what is place else lanes[seen > 7]) + what).ravel(), minlength=n * 16).reshape(n, 16)
        self.tries[:, [0, 8]], self.hits[:, [0, 8]], self.fresh = TRIES, 0, 0
        self._aligned()

    def drop(self) -> None:
        """The last lane has come to its end; the others go on."""
        n = len(self.lane) - 1
        self.lane = self.lane[:n]
        self.history, self.sorted, self.seen = self.history[:, :n].copy(), self.sorted[:n], self.seen[:, :, :n].copy()
        self.known, self.escape, self.last = self.known[:n], self.escape[:n], [x[:n] for x in self.last]
        self.tries, self.hits = self.tries[:n], self.hits[:n]
        for name, width in (("ids", self.size), ("after1", self.size), ("after2", PAIRS), ("below", self.size + 1)):
            setattr(self, name, getattr(self, name)[: n * width])
        gain = self.gain[: n * 16]
        self._aligned()
        self.gain = gain


def _shares(range_: np.ndarray, total) -> np.ndarray:
    """range_ // total; both are below 2**48 and their quotient is exact in a double, which is faster."""
    return np.floor(range_ / total).astype(np.int64)


def _before(ids: np.ndarray) -> np.ndarray:
    """For each place (step, lane) the last step before it at which the lane had the same id, or -1."""
    steps = len(ids)
    small = int(ids.max(initial=0)) < (1 << 31) // steps - 1
    key = np.sort(ids.T.astype(np.int32 if small else np.int64) * steps + np.arange(steps, dtype=np.int32), axis=1)
    key, order = np.divmod(key, steps)
    before = np.full(key.shape, -1, np.int32)
    np.put_along_axis(before, order[:, 1:].astype(np.int64), np.where(key[:, 1:] == key[:, :-1], order[:, :-1], -1).astype(np.int32), axis=1)
    return np.ascontiguousarray(before.T)


def encode(ids: np.ndarray, vocabulary: int, block: int) -> list[bytes]:
    """Each block of ``block`` ids, coded; the last may be shorter."""
    n = len(ids)
    lanes = -(-n // block)
    if not lanes:
        return []
    if int(ids.max()) >= vocabulary or int(ids.min()) < 0:
        raise ValueError("an id lies outside the vocabulary")
    padded = np.full(lanes * block, -1, np.int32)
    padded[:n] = ids
    table = np.ascontiguousarray(padded.reshape(lanes, block).T)
    tail = n - (lanes - 1) * block
    before = _before(table)
    model = _Model(lanes, block)
    low, range_ = np.zeros(lanes, np.int64), np.full(lanes, FULL, np.int64)
    out, used = np.zeros((lanes, block * 2 + 64), np.uint16), np.zeros(lanes, np.int64)
    every = np.arange(lanes)

    def emit(at: np.ndarray) -> None:
        out[at, used[at]] = low[at] >> 32
        used[at] += 1
        low[at] = (low[at] & (LOW - 1)) << 16
        range_[at] <<= 16

    def carry() -> None:
        at = np.flatnonzero(low >= FULL)
        low[at] -= FULL
        place = used[at] - 1
        while len(at):
            out[at, place] += 1  # 16 bits: a full word turns to 0 and carries on
            more = out[at, place] == 0
            at, place = at[more], place[more] - 1

    for at in range(block if lanes > 1 else tail):
        if at == tail and len(every) == lanes:
            model.drop()
            every = every[:-1]
        m = len(every)
        model.predict(at)
        prior = before[at, :m]
        rank = np.where(prior >= 0, model.history.reshape(-1).take(prior * np.int64(m) + every, mode="wrap"), 0).astype(np.int64)
        begin, size = model.interval(rank)
        new = np.flatnonzero(size == 0)
        begin[new], size[new] = (model.sum - model.escape)[new], model.escape[new]
        part = _shares(range_[:m], model.sum)
        low[:m] += part * begin
        np.multiply(part, size, out=range_[:m])
        if low[:m].max() >= FULL:
            carry()
        if len(due := np.flatnonzero(range_[:m] < LOW)):
            emit(due)
        if len(new):
            x = table[at, new]
            part = range_[new] // vocabulary
            low[new] += part * x
            range_[new] = part
            if low[new].max() >= FULL:
                carry()
            while len(due := new[range_[new] < LOW]):
                emit(due)
            rank[new] = model.add(new, x)
        model.update(at, rank)
    every = np.arange(lanes)
    for _ in range(3):
        out[every, used] = low >> 32
        used += 1
        low = (low & (LOW - 1)) << 16
    return [out[k, : used[k]].astype("<u2").tobytes() for k in range(lanes)]


def decode(blocks: list[bytes], count: int, vocabulary: int, block: int) -> np.ndarray:
    """The ``count`` ids of consecutive blocks of ``block`` ids, of which the last may be shorter."""
    lanes = len(blocks)
    if not lanes:
        return np.zeros(0, np.int32)
    tail = count - (lanes - 1) * block
    words = np.zeros((lanes, max(map(len, blocks)) // 2 + 4), np.int64)
    for k, b in enumerate(blocks):
        words[k, : len(b) // 2] = np.frombuffer(b, "<u2")
    every, used = np.arange(lanes), np.full(lanes, 3)
    code, range_ = (words[:, 0] << 32) | (words[:, 1] << 16) | words[:, 2], np.full(lanes, FULL, np.int64)
    model, out, last = _Model(lanes, block), np.zeros((block, lanes), np.int32), words.shape[1] - 1

    def take(at: np.ndarray) -> None:
        code[at] = (code[at] << 16) | words[at, np.minimum(used[at], last)]
        used[at] += 1
        range_[at] <<= 16

    for at in range(block if lanes > 1 else tail):
        if at == tail and len(every) == lanes:
            model.drop()
            every = every[:-1]
        m = len(every)
        model.predict(at)
        part = _shares(range_[:m], model.sum)
        rank = model.find(np.minimum(_shares(code[:m], part), model.sum - 1)).astype(np.int64)
        begin, size = model.interval(rank)
        new = np.flatnonzero(rank == 0)
        begin[new], size[new] = (model.sum - model.escape)[new], model.escape[new]
        code[:m] -= part * begin
        np.multiply(part, size, out=range_[:m])
        if len(due := np.flatnonzero(range_[:m] < LOW)):
            take(due)
        if len(new):
            part = range_[new] // vocabulary
            x = np.minimum(code[new] // part, vocabulary - 1)
            code[new] -= part * x
            range_[new] = part
            while len(due := new[range_[new] < LOW]):
                take(due)
            rank[new] = model.add(new, x)
        out[at, :m] = model.ids.take(model.first + rank)
        model.update(at, rank)
    flat = out.T.reshape(-1)
    return flat[: (lanes - 1) * block + tail]


def block_length(n: int) -> int:
    """Ids a block of a group of ``n``: short groups have shorter blocks, so that as many as LANES go side by side."""
    return min(BLOCK, max(LEAST, -(-n // LANES)))


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
