"""Simulated orders as counts: how often each entry of an event takes each place in many draws, without a row per draw.

Who is next among those not yet placed depends on nothing but who they are. So draws that have the same entries left are one group,
whatever their order so far: the next place of all of them is one multinomial draw, and the counts by entry and place have the same
distribution as those of independent draws, at the price of the sets. Larger fields are drawn one by one, as a matrix of draws by
entries in blocks of bounded size, and the counts of blocks are added. Numbers come from a generator keyed by event and block, so
they do not depend on how rows lie."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LEAST = 1e-12
BY_SETS = 12  # entries of a field that is drawn by sets
_MASK = (1 << 64) - 1
CELLS = 1 << 19  # draws x entries that are held at once


@lru_cache(maxsize=None)
def sets(n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sets of a field of n by falling size: each as a number with a bit for each entry, its entries, and what is left of it
    without each of them."""
    every = np.arange(1 << n)
    inside = every[:, None] >> np.arange(n) & 1 == 1
    out = []
    for size in range(n, 0, -1):
        some = every[inside.sum(axis=1) == size]
        members = np.nonzero(inside[some])[1].reshape(-1, size)
        out.append((some, members, some[:, None] ^ 1 << members))
    return out


@lru_cache(maxsize=None)
def _flat(n: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For a field in which all finish: sets of two and more with what is left of them, the sets of one, and the cells (entry times n
    plus place) of every choice in that order."""
    steps = sets(n)
    cells = [(members * n + n - members.shape[1]).ravel() for _, members, _ in steps]
    return [(some, rest.ravel()) for some, _, rest in steps[:-1]], steps[-1][0], np.concatenate(cells)


@lru_cache(maxsize=None)
def retired_places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set of finishers, by (set, cell): where the others are, behind it in the order of the field; cells are entry times n
    plus place."""
    which, cells = [], []
    for some in range(1 << n):
        out = [e for e in range(n) if not some >> e & 1]
        which += [some] * len(out)
        cells += [e * n + n - len(out) + k for k, e in enumerate(out)]
    return np.array(which, np.int64), np.array(cells, np.int64)


class Numbers:
    """Random numbers keyed by event and block; one generator is set anew for each, which is much cheaper than a new one."""

    def __init__(self, seed: int):
        self.bits = np.random.Philox(key=np.array([seed & _MASK, 0], np.uint64))
        self.start = self.bits.state
        self.draw = np.random.Generator(self.bits)

    def of(self, event: int, block: int) -> np.random.Generator:
        self.start["state"]["key"][1] = event & _MASK
        self.start["state"]["counter"][:] = (0, 0, 0, block)
        self.bits.state = self.start
        return self.draw


def clean(strength: np.ndarray, out: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Strengths above 0, the greatest of a field being 1; a missing one is the least. Chances to retire from 0 to 1; a missing one
    is 0."""
    known = np.maximum(np.nan_to_num(strength, nan=LEAST, posinf=1e300), LEAST)
    return known / known.max(axis=-1, keepdims=True), None if out is None else np.clip(np.nan_to_num(out), 0.0, 1.0)


def by_sets(seed: int, events: np.ndarray, strength: np.ndarray, out: np.ndarray | None, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """For events of one small field size: counts by event, entry and place, and counts of the draws that an entry finishes in, by
    place too."""
    strength, out = clean(strength, out)
    n = strength.shape[1]
    every, ended = np.zeros((len(events), n * n), np.int64), np.zeros((len(events), n * n), np.int64)
    keyed, step = Numbers(seed), max(1, CELLS // (n << n))
    for start in range(0, len(events), step):
        some = slice(start, start + step)
        shares = []
        for _, members, _ in sets(n):
            share = strength[some][:, members]
            shares.append(share / share.sum(axis=2, keepdims=True))
        if out is not None:
            finishing = np.arange(1 << n)[:, None] >> np.arange(n) & 1 == 1
            finish = np.where(finishing, 1.0 - out[some][:, None, :], out[some][:, None, :]).prod(axis=2)
            finish /= finish.sum(axis=1, keepdims=True)
        if out is None:
            steps, single, cells = _flat(n)
            for e, event in enumerate(events[some].tolist()):
                numbers, left, chosen = keyed.of(event, 0) if n > 1 else None, np.zeros(1 << n, np.int64), []
                left[-1] = draws
                for (numbered, rest), share in zip(steps, shares[:-1], strict=True):
                    next_ = numbers.multinomial(left[numbered], share[e]).ravel()
                    left += np.bincount(rest, next_, 1 << n).astype(np.int64)
                    chosen.append(next_)
                chosen.append(left[single])
                ended[start + e] = np.bincount(cells, np.concatenate(chosen), n * n)
            continue
        for e, event in enumerate(events[some].tolist()):
            numbers = keyed.of(event, 0)
            left = np.zeros((n + 1, 1 << n), np.int64)  # draws by entries placed so far and set left
            left[0] = numbers.multinomial(draws, finish[e])
            which, cells = retired_places(n)
            every[start + e] += np.bincount(cells, left[0][which], n * n).astype(np.int64)
            for (numbered, members, rest), share in zip(sets(n), shares, strict=True):
                most = n - members.shape[1]
                next_ = numbers.multinomial(left[:most + 1, numbered], share[e])
                for k in range(most + 1):
                    weights = next_[k].ravel()
                    left[k + 1] += np.bincount(rest.ravel(), weights, 1 << n).astype(np.int64)
                    ended[start + e, k::n] += np.bincount(members.ravel(), weights, n).astype(np.int64)
    return (every + ended).reshape(-1, n, n), ended.reshape(-1, n, n)


def drawn(seed: int, event: int, block: int, strength: np.ndarray, out: np.ndarray | None, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one event, draw by draw: the strongest after a Gumbel number is first."""
    strength, out = clean(strength, out)
    n, numbers = len(strength), Numbers(seed).of(event, block)
    every, ended = np.zeros(n * n, np.int64), np.zeros(n * n, np.int64)
    step = max(1, CELLS // n)
    for start in range(0, draws, step):
        rows = min(step, draws - start)
        key = -np.log(strength) - numbers.gumbel(size=(rows, n))  # ascending
        gone = numbers.random((rows, n)) < out if out is not None else np.zeros((rows, n), bool)
        # Those who retire keep the order of the field, behind all others.
        order = np.lexsort((np.where(gone, 0.0, key), gone), axis=1)
        cell = order * n + np.arange(n)
        every += np.bincount(cell.ravel(), minlength=n * n)
        ended += np.bincount(cell[~np.take_along_axis(gone, order, axis=1)], minlength=n * n)
    return every.reshape(n, n), ended.reshape(n, n)
