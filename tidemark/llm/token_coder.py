"""Adaptive context-mixing range coder for token ids, in independent blocks that numpy codes side by side.

Every block starts from the same reset model, so that many blocks (lanes) go through the same step together.  For each
id three predictions are mixed into one distribution:

* order 2: the id that last followed the two previous ids in this block, with how often it was right,
* order 1: the id that most often follows the previous one, with how surely,
* order 0: one of up to eight distributions over all ids, at any time the one that would have coded the block's last ids best.

How much of the whole orders 2 and 1 get depends on hit rates that adapt in each block, by state.  The order-1 ids and the order-0
distributions that a reset model knows stand in the container's header: the distributions are clusters of runs
of ids, such as those of one language.  All arithmetic of the coding is on integers, so that any machine decodes what another one encoded.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"TMX4"
#: Ids of a block, bits of a lane's order-2 table, distributions of order 0, ids of a run that goes to one of them.
BLOCK, TABLE_BITS, MOST, RUN = 2048, 9, 8, 256
#: Parts of the whole; least share of order 0; bound of a hit rate and how fast it moves.
WHOLE, LEAST = 1 << 16, 1 << 12
HIGHEST, RATE = WHOLE - 2 * LEAST, 4
#: Costs are in eighths of a bit; after so many ids the distribution is chosen anew.
UNIT, DEAREST, TURN = 8, 255, 16
#: Ids for each distribution at least; ids that shares are counted over, and those that clusters and followers come from, at most (evenly
#: spaced runs and blocks; ids in none of them are coded by rank); levels of a follower's sureness.
SPARE, COUNTED, LEARN, LEVELS = 16_384, 1 << 20, 1 << 18, 8
U32, U64 = np.uint32, np.uint64
SETTLED = U64(1 << 32)


def _centres(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Centres of k clusters of rows: begin far apart, then move to the means."""
    at = x[:1]
    for _ in range(k - 1):
        far = ((x * x).sum(1)[:, None] - 2 * x @ at.T + (at * at).sum(1)).min(1)
        at = np.concatenate([at, x[far.argmax()][None]])
    for _ in range(rounds):
        own = ((at * at).sum(1) - 2 * x @ at.T).argmin(1)
        at = np.stack([x[own == j].mean(0) if (own == j).any() else at[j] for j in range(k)])
    return at


def _shares(counts: np.ndarray, total: int) -> np.ndarray:
    """Integer shares of total by counts; the last entry is for all that are too rare for one, and 1 at least."""
    part = counts / max(counts.sum(), 1) * total
    kept = (part >= 1) & (np.arange(len(part)) < total // 2)
    rest = int(min(max(1, round(float(part[~kept].sum()))), total // 2))
    scaled = np.where(kept, part, 0) * (total - rest) / max(part[kept].sum(), 1e-9)
    out = np.where(kept, np.maximum(scaled.astype(np.int64), 1), 0)
    spare = total - rest - int(out.sum())
    if spare > 0 and kept.any():
        first = np.argsort(np.floor(scaled) - scaled, kind="stable")[: int(kept.sum())]
        out[first] += spare // len(first)
        out[first[: spare % len(first)]] += 1
    while spare < 0:  # many ids at one part each: take from those with most
        most = np.argsort(-out, kind="stable")[:64]
        cut = np.minimum(out[most] - 1, -(-(-spare) // 64))
        cut = np.where(np.cumsum(cut) <= -spare, cut, np.maximum(0, -spare - (np.cumsum(cut) - cut)))
        out[most] -= cut
        spare += int(cut.sum())
    return np.append(out, total - int(out.sum()))


class _Reset:
    """What a reset model knows: the ids that occur, most frequent first (coding goes by their ranks), the shares of order 0 and the followers."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray, follower: np.ndarray) -> None:
        self.ids, self.shares, self.follower = ids, shares, follower
        self.v, self.k = len(ids), len(shares)
        self.bits = int(shares[0].sum()).bit_length() - 1
        self.raw = max(1, (self.v - 1).bit_length())
        share = shares[:, :-1].astype(U32)
        begin = np.concatenate([np.zeros((self.k, 1), U32), shares.cumsum(1, dtype=U32)[:, :-1]], 1)
        lost = begin[:, -1:] << U32(16) | shares[:, -1:].astype(U32) | U32(1 << 31)
        #: By distribution and rank (the last: the rest): where the share begins (15 bits), its size (16 bits), and whether it is the rest's.
        self.place = np.concatenate([np.where(share > 0, begin[:, :-1] << U32(16) | share, lost), lost], 1).ravel()
        self.slots = np.concatenate([np.repeat(np.arange(self.v + 1, dtype=np.uint16 if self.v < 1 << 16 else U32), s) for s in shares])
        bits = self.bits - np.log2(np.where(share > 0, share, shares[:, -1:]))
        cost = np.full((self.v, MOST), DEAREST, np.int16)
        cost[:, : self.k] = np.minimum(DEAREST, np.rint(UNIT * np.where(share > 0, bits, bits + self.raw))).T
        self.cost = np.ascontiguousarray(cost).view(np.complex128)[:, 0]  # eight small numbers at a time

    @classmethod
    def learned(cls, ids: np.ndarray) -> tuple[_Reset, np.ndarray]:
        """From ids, and the ranks of these."""
        if int(ids.max()) < 1 << 22:
            counts = np.bincount(ids)
            known = np.flatnonzero(counts)
            known = known[np.argsort(-counts[known], kind="stable")]
            rank = np.zeros(len(counts), U32)
            rank[known] = np.arange(len(known))
            ranks = rank.take(ids)
        else:
            known, ranks, counts = np.unique(ids, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            place = np.zeros(len(order), U32)
            place[order] = np.arange(len(order))
            known, ranks = known[order], place.take(ranks)
        v, n = len(known), len(ids)
        total = 1 << (14 if v <= 1 << 12 else 15)
        k = min(MOST, max(1, n // SPARE))
        if k > 1:
            head = ranks[: n // RUN * RUN].reshape(-1, RUN)[:: -(-n // COUNTED)].astype(np.int64)
            runs = len(head)
            low = (np.arange(runs)[:, None] * RUN + np.minimum(head, RUN - 1)).ravel()
            x = np.sqrt(np.bincount(low, minlength=runs * RUN).reshape(runs, RUN)[:, : RUN - 1].astype(np.float32))
            centres = _centres(x[:: -(-runs * RUN // LEARN)], k)
            own = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
            by = np.bincount((own[:, None] * v + head).ravel(), minlength=k * v).reshape(k, v).astype(float)
            by += by.sum(0) * 0.01 + 0.05  # a little of the others
            by = by[np.argsort(-by.sum(1), kind="stable")]
        else:
            by = np.bincount(ranks, minlength=v)[None].astype(float)
        some = ranks[: n // BLOCK * BLOCK].reshape(-1, BLOCK)[:: -(-n // LEARN)] if n >= BLOCK else ranks[None]
        pair, seen = np.unique(some[:, :-1].astype(U64).ravel() << U64(32) | some[:, 1:].ravel(), return_counts=True)
        before, after = (pair >> U64(32)).astype(np.int64), (pair & U64(0xFFFFFFFF)).astype(U32)
        order = np.lexsort((after, -seen, before))
        first = order[np.flatnonzero(np.diff(before[order], prepend=-1))]
        often = np.bincount(before, seen, v)
        sure = seen[first] / np.maximum(often[before[first]], 1)
        level = np.where(seen[first] >= 3, np.clip(np.floor(sure * LEVELS), 1, LEVELS - 1) * (sure >= 1 / 16), 0).astype(U32)
        follower = np.zeros(v, U32)
        follower[before[first]] = after[first] * U32(LEVELS) + level
        return cls(known.astype(U32), np.stack([_shares(b, total) for b in by]), follower), ranks

    def to_bytes(self) -> bytes:
        parts = [np.array([self.v, self.k], "<u4"), self.ids.astype("<u4"), self.shares.astype("<u4"), self.follower.astype("<u4")]
        return zlib.compress(b"".join(p.tobytes() for p in parts), 6)

    @classmethod
    def from_bytes(cls, data: bytes) -> _Reset:
        raw = np.frombuffer(zlib.decompress(data), "<u4")
        v, k = int(raw[0]), int(raw[1])
        ids, shares, follower = np.split(raw[2:], [v, v + k * (v + 1)])
        return cls(ids, shares.reshape(k, v + 1).astype(np.int64), follower.astype(U32))


class _Model:
    """The models of n lanes, over ranks.  Ranks in the order-2 table carry two bits of how often they were right."""

    def __init__(self, n: int, reset: _Reset) -> None:
        self.reset, self.n, self.step = reset, n, 0
        self.kind = kind = np.uint16 if reset.v <= 1 << 14 else U32
        self.three, self.two = kind(3), kind(2)
        self.next_id, self.next_level = (reset.follower >> U32(3)).astype(kind), (reset.follower & U32(7)).astype(np.int64)
        self.lane8 = np.arange(0, 8 * n, 8)
        self.row = np.arange(n) << TABLE_BITS
        self.slot2, self.before = self.row, np.zeros(n, U32)
        self.seen2 = np.zeros(n << TABLE_BITS, kind)
        self.rate1 = np.tile(np.array([64, *((2 * j + 1) * WHOLE // 20 for j in range(1, 8))], np.int32), n)
        self.rate2 = np.tile(np.array([1, 2, 6, 12, 18, 32, 44, 52], np.int32) * np.int32(WHOLE // 64), n)
        self.id1, self.at1 = np.full(n, self.next_id[0]), self.lane8 + self.next_level[0]
        self.score = np.zeros((n, MOST), np.int16)
        self.recent = np.zeros((n, MOST), np.int16)
        self.table = np.zeros(n, np.int64)
        self.base, self.first_slot = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def shrink(self, n: int) -> None:
        """Only the first n lanes go on."""
        self.n = n
        for name in ("lane8", "row", "slot2", "before", "id1", "at1", "score", "recent", "table", "base", "first_slot"):
            setattr(self, name, getattr(self, name)[:n])

    def predict(self) -> None:
        """id1, id2, part1, part2: what orders 1 and 2 predict, and their parts; order 1 gets none where it repeats order 2."""
        held = self.seen2.take(self.slot2)
        self.sure2, self.id2 = held & self.three, held >> self.two
        other = self.id1 != self.id2
        self.at2 = self.lane8 + (self.sure2 + (~other).view(np.uint8) * self.kind(4))
        self.part2, self.hope1 = self.rate2.take(self.at2), self.rate1.take(self.at1)
        self.part1 = ((U32(WHOLE - LEAST) - self.part2.view(U32)) * self.hope1.view(U32) >> U32(16) | U32(1)) * other
        self.both = self.part1 + self.part2.view(U32)

    def update(self, ranks: np.ndarray, hit2: np.ndarray, same1: np.ndarray) -> None:
        rise = np.int32(HIGHEST >> RATE)  # a rate tends to HIGHEST or, by rounding, to a little over 0
        self.rate2[self.at2] = self.part2 - (self.part2 >> RATE) + hit2 * rise
        self.rate1[self.at1] = self.hope1 - (self.hope1 >> RATE) + same1 * rise
        sure = np.minimum(self.sure2 + self.kind(1), self.three)
        self.seen2[self.slot2] = (ranks << self.two) + sure * hit2
        self.id1, self.at1 = self.next_id.take(ranks), self.lane8 + self.next_level.take(ranks)
        mixed = ranks * U32(0x9E3779B1)
        self.slot2 = self.row + (mixed + self.before >> U32(32 - TABLE_BITS))
        self.before = mixed * U32(0x85EBCA6B)
        self.step += 1
        if self.step & 1 or self.step < 2 * TURN:  # later every other id is enough
            self.recent += self.reset.cost.take(ranks).view(np.int16).reshape(-1, MOST)
        if self.step % TURN == 0 or self.step in (2, 4, 8):
            self.score = (self.score >> 1) + self.recent
            self.recent[:] = 0
            self.table = self.score.argmin(1)
            self.base, self.first_slot = self.table * (self.reset.v + 1), self.table << self.reset.bits


def _cut(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Widths after 32 bits are settled: an interval ends at the next multiple of 2**32 above its beginning, if it goes on."""
    edge = U64(0) - low
    edge &= SETTLED - U64(1)
    edge -= U64(1)  # on a multiple this is the largest number of all
    np.minimum(edge, width - U64(1), out=edge)
    edge += U64(1)
    edge <<= U64(32)
    return edge


class _Encoder:
    """Intervals [low, low + width) in 64 bits.  Where the width falls under 2**32, 32 bits are settled and written;
    an interval over a multiple of 2**32 is first cut off there, which leaves no carry."""

    def __init__(self, n: int, steps: int) -> None:
        self.low, self.width = np.zeros(n, U64), np.full(n, 2**64 - 1, U64)
        self.begin = np.arange(n) * (steps * 2 + 4)
        self.out, self.at = np.zeros(n * (steps * 2 + 4), U32), self.begin.copy()

    def put(self, cum: np.ndarray, part: np.ndarray, bits: np.ndarray, begin: np.ndarray, share: np.ndarray) -> None:
        """Narrow each lane to [cum, cum + part) of WHOLE, then to [begin, begin + share) of 2**bits."""
        n = len(cum)
        low, width = self.low[:n], self.width[:n]
        width >>= U64(16)
        low += width * cum
        width *= part
        width >>= bits
        low += width * begin
        width *= share
        self._settle(n)

    def put_raw(self, lanes: np.ndarray, value: np.ndarray, bits: int) -> None:
        """Narrow some lanes to number value of 2**bits."""
        width = self.width.take(lanes) >> U64(bits)
        low = self.low.take(lanes) + width * value
        go, at = width < SETTLED, self.at.take(lanes)
        self.out[at] = low >> U64(32)
        self.at[lanes] = at + go
        self.width[lanes] = np.where(go, _cut(low, width), width)
        self.low[lanes] = low << go * U64(32)

    def _settle(self, n: int) -> None:
        low, width, at = self.low[:n], self.width[:n], self.at[:n]
        go = width < SETTLED
        self.out[at] = low >> U64(32)  # where nothing is settled, a later one takes its place
        at += go
        np.copyto(width, _cut(low, width), where=go)
        low <<= go * U64(32)

    def finish(self) -> list[bytes]:
        for _ in range(2):
            self.out[self.at] = self.low >> U64(32)
            self.at += 1
            self.low <<= U64(32)
        return [self.out[a:b].astype("<u4").tobytes() for a, b in zip(self.begin, self.at, strict=True)]


class _Decoder:
    def __init__(self, streams: list[bytes]) -> None:
        n = len(streams)
        self.words = np.concatenate([np.frombuffer(s, "<u4") for s in streams] + [np.zeros(4, U32)]).astype(U32)
        self.at = np.cumsum([0, *(len(s) // 4 for s in streams)])[:n]
        self.low, self.width = np.zeros(n, U64), np.full(n, 2**64 - 1, U64)
        self.code = self.words[self.at].astype(U64) << U64(32) | self.words[self.at + 1]
        self.at = self.at + 2
        self.last = len(self.words) - 1

    def value(self, n: int) -> np.ndarray:
        """Where in WHOLE each lane's code lies."""
        self.width[:n] >>= U64(16)
        return np.minimum((self.code[:n] - self.low[:n]) // self.width[:n], U64(WHOLE - 1)).astype(np.int32)

    def take(self, cum: np.ndarray, part: np.ndarray) -> None:
        """Narrow to [cum, cum + part)."""
        n = len(cum)
        self.low[:n] += self.width[:n] * cum
        self.width[:n] *= part

    def slot(self, shift: np.ndarray, bits: int) -> np.ndarray:
        """Which of 2**bits follows; only where shift is bits and not 0 it is narrowed down to later."""
        n = len(shift)
        self.width[:n] >>= shift
        width = np.maximum(self.width[:n], U64(1))  # damaged data may leave nothing
        return np.minimum((self.code[:n] - self.low[:n]) // width, U64((1 << bits) - 1)).view(np.int64)

    def take_raw(self, lanes: np.ndarray, bits: int) -> np.ndarray:
        """Read a number below 2**bits in some lanes."""
        width, code, at, low = self.width.take(lanes) >> U64(bits), self.code.take(lanes), self.at.take(lanes), self.low.take(lanes)
        raw = np.minimum((code - low) // np.maximum(width, U64(1)), U64((1 << bits) - 1))
        low, go = low + width * raw, width < SETTLED
        self.code[lanes] = np.where(go, code << U64(32) | self.words.take(np.minimum(at, self.last)), code)
        self.at[lanes] = at + go
        self.width[lanes] = np.where(go, np.maximum(_cut(low, width), SETTLED), width)
        self.low[lanes] = low << go * U64(32)
        return raw

    def settle(self, n: int) -> None:
        """Read on where the width has fallen under 2**32."""
        low, width, code, at = self.low[:n], self.width[:n], self.code[:n], self.at[:n]
        go = width < SETTLED
        np.copyto(code, code << U64(32) | self.words.take(np.minimum(at, self.last)), where=go)
        at += go
        np.copyto(width, np.maximum(_cut(low, width), SETTLED), where=go)  # damaged data may leave nothing
        low <<= go * U64(32)


def encode(ids: np.ndarray) -> bytes:
    """Code any 32-bit ids into one container: header with checksum, reset model, length and checksum of each block, then the blocks."""
    ids = np.ascontiguousarray(ids, "<u4")
    total = len(ids)
    if not total:
        return MAGIC + np.array([BLOCK, 0, 0, 0, 0], "<u4").tobytes()
    n, whole = -(-total // BLOCK), total // BLOCK
    rest, steps = total - whole * BLOCK, min(total, BLOCK)
    reset, ranks = _Reset.learned(ids)
    model, coder = _Model(n, reset), _Encoder(n, steps)
    grid = np.zeros((steps, n), model.kind)
    if whole:
        grid[:, :whole] = ranks[: whole * BLOCK].reshape(whole, BLOCK).T
    if rest:
        grid[:rest, whole] = ranks[whole * BLOCK :]
    bits = np.array([0, reset.bits], U64)
    for step in range(steps):
        if rest and step == rest:
            model.shrink(whole)
        got = grid[step, : model.n]
        model.predict()
        same1, hit2 = got == model.id1, got == model.id2
        hit1 = same1 > hit2
        missed = ~(hit2 | hit1)
        part2 = model.part2.view(U32)
        place = reset.place.take(model.base + got) * missed
        # Each lane has one of three cases, so masked terms add up to the chosen one.
        cum = model.both * missed + part2 * hit1
        part = (U32(WHOLE) - model.both) * missed + part2 * hit2 + model.part1 * hit1
        share = (place & U32(0xFFFF)) + ~missed
        coder.put(cum.astype(U64), part.astype(U64), bits.take(missed.view(np.uint8)), (place >> U32(16) & U32(0x7FFF)).astype(U64), share.astype(U64))
        lost = np.flatnonzero(place.view(np.int32) < 0)
        if len(lost):
            coder.put_raw(lost, got.take(lost).astype(U64), reset.raw)
        model.update(got, hit2, same1)
    streams = coder.finish()
    sizes = np.array([[len(s), zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK])] for k, s in enumerate(streams)], "<u4").reshape(-1, 2)
    known = reset.to_bytes()
    head = np.array([BLOCK, n, total, len(known), zlib.crc32(known + sizes.tobytes())], "<u4")
    return MAGIC + head.tobytes() + known + sizes.tobytes() + b"".join(streams)


def decode(data: bytes) -> np.ndarray:
    """The ids of a container; raises ValueError if its header or a block's checksum is wrong."""
    if data[:4] != MAGIC or len(data) < 24:
        raise ValueError("not a container of coded ids")
    block, n, total, known, check = (int(v) for v in np.frombuffer(data, "<u4", 5, 4))
    if block != BLOCK or n != -(-total // BLOCK):
        raise ValueError("header of coded ids is damaged")
    if not n:
        return np.zeros(0, "<u4")
    at = 24 + known + 8 * n
    if len(data) < at or zlib.crc32(data[24:at]) != check:
        raise ValueError("header of coded ids is damaged")
    reset = _Reset.from_bytes(data[24 : 24 + known])
    sizes = np.frombuffer(data, "<u4", 2 * n, 24 + known).reshape(n, 2)
    ends = at + np.cumsum(sizes[:, 0], dtype=np.int64)
    if ends[-1] != len(data) or (sizes[:, 0] % 4 | (sizes[:, 0] < 8)).any():
        raise ValueError("coded ids are cut short")
    steps, whole = min(total, BLOCK), total // BLOCK
    rest = total - whole * BLOCK
    model, coder = _Model(n, reset), _Decoder([data[e - s : e] for e, s in zip(ends, sizes[:, 0].tolist(), strict=True)])
    grid, last = np.zeros((steps, n), model.kind), model.kind(reset.v - 1)
    for step in range(steps):
        if rest and step == rest:
            model.shrink(whole)
        model.predict()
        v, part2, both = coder.value(model.n), model.part2, model.both.view(np.int32)
        hit2, missed = v < part2, v >= both
        hit1 = hit2 == missed
        cum = both * missed + part2 * hit1
        part = (WHOLE - both) * missed + part2 * hit2 + model.part1.view(np.int32) * hit1
        coder.take(cum.astype(U64), part.astype(U64))
        rank = reset.slots.take(model.first_slot + coder.slot(missed * U64(reset.bits), reset.bits))
        place = reset.place.take(model.base + rank) * missed
        coder.take((place >> U32(16) & U32(0x7FFF)).astype(U64), ((place & U32(0xFFFF)) + ~missed).astype(U64))
        coder.settle(model.n)
        lost = np.flatnonzero(place.view(np.int32) < 0)
        if len(lost):
            rank[lost] = np.minimum(coder.take_raw(lost, reset.raw), U64(reset.v - 1))
        got = model.id2 * hit2 + model.id1 * hit1 + rank.astype(model.kind) * missed
        got = np.minimum(got, last)
        grid[step, : model.n] = got
        model.update(got, got == model.id2, got == model.id1)
    ranks = np.ascontiguousarray(grid.T).reshape(-1)[:total] if not rest or n > 1 else np.ascontiguousarray(grid[:, 0])
    ids = np.ascontiguousarray(reset.ids.take(ranks), "<u4")
    for k in range(n):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK]) != sizes[k, 1]:
            raise ValueError(f"checksum of block {k} is wrong")
    return ids
