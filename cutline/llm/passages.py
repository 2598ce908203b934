"""Passages that repeat across documents, also with small changes: collinear chaining of shared k-mers.

Every run of `k` words is a seed, with 16 bits of its surroundings: the least weighted hash among the 24 words before or behind
it. A seed of a document is matched with the first place of the earliest document (by id) that has the run, and of the earliest
that has it in the same surroundings, never with all others, so matches are at most two for each word. The second kind keeps a
changed passage together whose runs also stand in unrelated earlier documents: about two of three runs in text that is 80 % equal
have the same surroundings, and chance gives them to few others. Seeds are exchanged once, sorted and packed, about eight bytes a word.
A document's matches count where `share` of some `least` words are in matched runs. Matches of one pair of
documents on one diagonal make a fragment. Fragments are chained: a chain follows both documents forward and pays for the
words it skips on either side; the best predecessor of each fragment is found in a Fenwick tree over the anchor's places.
Pairs of documents with one match only have none. Chains, cut where they skip much, and each fragment of such a chain are aligned, but for what lies inside a run of
another that skips single words only: ends are extended while words are equal, and
the words in common (a longest common subsequence) must be at least `similarity` of the longer side. The parts of a stretch are
judged by themselves as well: those whose equal words outweigh the words skipped between them, along the fragment's diagonal and
along the common subsequence, and past changed words at their ends, so that an equal run is kept whatever stands near it. Aligned stretches of a document, whatever
their anchors, are joined where they touch; those of at least `least` words are its repeated passages.

An equal passage is always found, unless unrelated earlier documents have all its runs in the same surroundings. A changed one may be
lost where less than 30 % of its words are in equal runs of four, which takes changes that avoid longer runs on purpose.

Words are lower-cased runs of letters and digits. Null texts and null ids have no passages; shorter documents than `least`
words have none. Repeats inside one document don't count. If one id has several rows, the one with the greatest text counts.
Ties: the lowest place of the lowest id is the anchor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from cutline.llm.frames import among, arrow_type, few, lists, marked, not_among, per_batch, stored
from cutline.llm.words import Block, blocks, mix, shingles, utf8

_LONGEST = 1024  # words of a fragment that are aligned at once
_SKIP = 64  # words between two matches of one fragment, or two fragments of one stretch
_PRICE = 0.25  # of a skipped word, in matched words
_NEAR = 24  # words before or behind a seed that are its surroundings
_SALT = np.uint64(0x9E3779B97F4A7C15)
_HELD = 1 << 20  # seeds or matches that a task holds before it packs them
_PART = 1 << 20  # words for each part of the seeds
_OFTEN = 1024  # pairs for each copy of a document's words


def seeds_of(block: Block, k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, place and hash of each run of k words of the block's texts of at least `least` words."""
    found = shingles(block.hashes, k)
    owner, size = block.owners(), np.diff(block.offsets)
    first = owner[:len(found)]
    place = np.flatnonzero((first == owner[k - 1:k - 1 + len(found)]) & (size[first] >= least))
    return owner[place], place - block.offsets[owner[place]], found[place]


def contexts(block: Block, owner: np.ndarray, place: np.ndarray, seed: np.ndarray, k: int) -> np.ndarray:
    """16 bits for each seed that similar surroundings share: the least hash among the words before or behind it, which side
    and by which function depends on the seed. Long words are more likely to be the least, as they say more."""
    size = np.maximum(np.minimum(block.ends - block.starts, 12), 1).astype(np.float64)
    padded = np.arange(len(block.hashes)) + _NEAR * (block.owners() + 1)  # no window reaches into another text
    total = len(block.hashes) + _NEAR * (len(block) + 2)
    at = block.offsets[owner] + place + _NEAR * (owner + 1)
    at = np.where(seed & np.uint64(1), at + k, at - _NEAR)
    kind = (seed >> np.uint64(1)) & np.uint64(3)
    out = np.zeros(len(seed), np.uint64)
    for n in range(4):
        least = np.full(total, np.inf)
        draw = mix(block.hashes + np.uint64((n + 1) * int(_SALT) % (1 << 64)))
        least[padded] = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / size**2
        width = 1
        while width * 2 <= _NEAR:
            least = np.minimum(least, np.append(least[width:], np.full(width, np.inf)))
            width *= 2
        least = np.minimum(least, np.append(least[_NEAR - width:], np.full(_NEAR - width, np.inf)))
        of = np.flatnonzero(kind == n)
        out[of] = mix(least[at[of]].view(np.uint64)) & np.uint64(0xFFFF)
    return out


_PACKED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("packed", T.BinaryType())])


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of one length, of which the first ascends, as compressed planes of bytes."""
    columns = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    planes = [np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return np.array([len(columns[0])], "<i8").tobytes() + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpack(data: bytes, columns: int) -> np.ndarray:
    n = int(np.frombuffer(data[:8], "<i8")[0])
    planes = np.frombuffer(pa.decompress(data[8:], n * 8 * columns, codec="zstd", asbytes=True), np.uint8).reshape(columns, 8, n)
    out = np.ascontiguousarray(planes.transpose(2, 0, 1)).view("<i8").reshape(n, columns).astype(np.int64)
    out[:, 0] = np.cumsum(out[:, 0])
    return out


def _by_part(part: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Rows, sorted by part and first column, as one packed row for each part."""
    at = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    return pa.RecordBatch.from_arrays([pa.array(part[at[:-1]], pa.int32()), pa.array([pack(*rows[a:b].T) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=_PACKED.fieldNames())


def _parts(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, np.ndarray]]:
    """The packed rows of sorted parts one after the other."""
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield part, unpack(data.as_py(), columns)


def seeds(docs: DataFrame, k: int, least: int, bits: int, parts: int) -> DataFrame:
    """Every run of k words of the texts as (upper bits of its hash, id, place, surroundings), packed by ranges of the hash."""

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate([np.zeros((0, 4), np.int64), *held])
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        return _by_part((rows[:, 0] * parts) >> bits, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            for b in blocks(utf8(batch.column("text"))):
                owner, place, seed = seeds_of(b, k, least)
                if len(seed):
                    held.append(np.stack([(seed >> np.uint64(64 - bits)).astype(np.int64), ids[b.first + owner], place, contexts(b, owner, place, seed, k).astype(np.int64)], axis=1))
                    size += len(seed)
                if size >= _HELD:
                    yield emit(held)
                    held, size = [], 0
        yield emit(held)

    return docs.mapInArrow(run, _PACKED)


def meet(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches (id, of, diagonal, at) of seed rows (seed, id, place, surroundings): each with the first place of the earliest
    document that has the seed, and of the earliest one that has it in the same surroundings. Also returns these first places,
    which are all that later rows need to know."""
    seed = np.ascontiguousarray(rows[:, 0])
    order = np.argsort(seed, kind="stable")  # of a few sorted runs
    same = np.diff(seed[order]) == 0
    several = np.append(same, False) | np.append(False, same) if len(rows) else np.zeros(0, bool)
    alone, rows = rows[order[~several]], rows[order[several]]
    found, kept = [], [alone]
    for key in ((0,), (0, 3)):
        order = np.lexsort((rows[:, 2], rows[:, 1], *(rows[:, c] for c in key[::-1])))
        r = rows[order]
        new = np.zeros(len(r), bool)
        new[:1] = True
        for c in key:
            new[1:] |= r[1:, c] != r[:-1, c]
        first = r[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(r) else r
        on = r[:, 1] > first[:, 1]
        found.append(np.stack([r[on, 1], first[on, 1], r[on, 2] - first[on, 2], r[on, 2]], axis=1))
        kept.append(r[new])
    return np.concatenate(found), np.concatenate(kept)


def matches(found: DataFrame, parts: int) -> DataFrame:
    """Matches of the seeds, packed by ranges of hashed ids. A part is read in pieces of bounded size; between them only the
    first places are held."""

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate([np.zeros((0, 4), np.int64), *held])
        part = (mix(rows[:, 0].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0], part))
        rows, part = rows[order], part[order]
        new = np.append(True, (np.diff(rows, axis=0) != 0).any(axis=1))[:len(rows)]  # both kinds may give one match
        return _by_part(part[new], rows[new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, held, waiting, now = [], 0, [], 0, None
        for part, rows in _parts(batches, 4):
            if held and (part != now or waiting >= 2 * _HELD):
                got, firsts = meet(np.concatenate(held))
                out.append(got)
                size += len(got)
                held, waiting = ([firsts], 0) if part == now else ([], 0)
            if size >= _HELD:
                yield emit(out)
                out, size = [], 0
            now = part
            held.append(rows)
            waiting += len(rows)
        if held:
            out.append(meet(np.concatenate(held))[0])
        yield emit(out)

    return found.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, _PACKED)


def dense(rows: np.ndarray, k: int, least: int, share: float) -> np.ndarray:
    """Which of the matches (id, of, diagonal, at), sorted by id, lie in a window of `least` words of their document, `share`
    of which are in matched runs of k words."""
    order = np.lexsort((rows[:, 3], rows[:, 0]))
    ids, at = rows[order, 0], rows[order, 3]
    new = np.append(True, (ids[1:] != ids[:-1]) | (at[1:] != at[:-1]))[:len(ids)]
    which = np.cumsum(new) - 1
    ids, at = ids[new], at[new]
    # Places of all documents on one line, far enough apart.
    start = np.append(True, ids[1:] != ids[:-1])[:len(ids)]
    jump = np.where(start, 2 * least + k, np.diff(at, prepend=0))
    line = np.cumsum(jump)
    gain = np.minimum(np.diff(line, prepend=-k), k)  # words that a run adds
    total = np.append(0, np.cumsum(gain))
    last = np.searchsorted(line, line + least - k, side="right")
    full = total[last] - total[:-1] + (k - gain) >= share * least
    edge = np.zeros(len(line) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(full), 1)
    np.add.at(edge, last[full], -1)
    out = np.zeros(len(rows), bool)
    out[order] = (np.cumsum(edge[:-1]) > 0)[which]
    return out


class Fenwick:
    """Prefix maxima over places 0 to n - 1, with who holds each."""

    def __init__(self, n: int):
        self.best = [(-np.inf, -1)] * (n + 1)

    def put(self, place: int, score: float, who: int) -> None:
        place += 1
        while place < len(self.best):
            if score > self.best[place][0]:
                self.best[place] = (score, who)
            place += place & -place

    def below(self, place: int) -> tuple[float, int]:
        out = (-np.inf, -1)
        while place > 0:
            out = max(out, self.best[place])
            place -= place & -place
        return out


def chains(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, weight: np.ndarray, price: float) -> list[list[int]]:
    """Fragments, from (x0, y0) to (x1, y1) with a weight each, as chains of fragment numbers, best first; every fragment is
    in one chain. A fragment follows another if it begins behind its end on both sides, at the price of each word skipped."""
    n = len(x0)
    ranks = np.unique(y1)
    tree, score, parent = Fenwick(len(ranks)), np.zeros(n), np.full(n, -1)
    ending = np.argsort(x1, kind="stable")
    done = 0
    for i in np.argsort(x0, kind="stable"):
        while done < n and x1[ending[done]] < x0[i]:
            j = ending[done]
            tree.put(int(np.searchsorted(ranks, y1[j])), score[j] + price * (x1[j] + y1[j]), int(j))
            done += 1
        gain, j = tree.below(int(np.searchsorted(ranks, y0[i])))
        gain -= price * (x0[i] + y0[i])
        score[i] = weight[i] + max(0.0, gain)
        parent[i] = j if gain > 0 else -1
    used, out = np.zeros(n, bool), []
    for i in np.argsort(-score, kind="stable"):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(int(i))
            i = parent[i]
        if chain:
            out.append(chain[::-1])
    return out


_SIDES = ("start", "end", "low", "high"), ("there", "there_end", "there_low", "there_high")
_PAIR = T.StructType([T.StructField("id", T.LongType()), T.StructField("of", T.LongType()), *(T.StructField(n, T.ArrayType(T.IntegerType())) for side in _SIDES for n in side)])


def _stretches(rows: np.ndarray, k: int) -> np.ndarray:
    """Stretches to align, from whole groups of match rows (id, of, diagonal, at) in that order."""
    new = np.concatenate([[True], (np.diff(rows[:, :3], axis=0) != 0).any(axis=1) | (np.diff(rows[:, 3]) > _SKIP)
                          | (rows[1:, 3] // _LONGEST != rows[:-1, 3] // _LONGEST)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    fragments = np.stack([rows[first, 0], rows[first, 1], rows[first, 3], rows[last, 3], rows[first, 3] - rows[first, 2], rows[last, 3] - rows[first, 2]], axis=1)
    group = np.flatnonzero(np.concatenate([[True], (np.diff(fragments[:, :2], axis=0) != 0).any(axis=1)]))
    size = np.diff(np.append(group, len(fragments)))
    out = [fragments[group[size == 1]]]

    def alone(f: np.ndarray, merged: set[int]) -> list[np.ndarray]:
        """Fragments of a stretch of several are aligned by themselves too: each lies on a diagonal of its own."""
        return [f[sorted(merged)]] if len(merged) > 1 else []

    for g, n in zip(group[size > 1], size[size > 1], strict=True):
        f = fragments[g:g + n]
        for chain in chains(f[:, 2], f[:, 3], f[:, 4], f[:, 5], f[:, 3] - f[:, 2] + k, _PRICE):
            run, merged = f[chain[0]].copy(), {chain[0]}
            for i in chain[1:]:
                near = f[i, 2] - run[3] <= _SKIP and f[i, 4] - run[5] <= _SKIP
                if near and f[i, 3] - run[2] <= _LONGEST:
                    run[3], run[5] = f[i, 3], f[i, 5]
                    merged.add(i)
                else:
                    if near:  # cut for its length only: it ends where the next begins
                        run[3], run[5] = f[i, 2], f[i, 4]
                    out += [run[None], *alone(f, merged)]
                    run, merged = f[i].copy(), {i}
            out += [run[None], *alone(f, merged)]
    found = np.concatenate(out)
    return np.stack([found[:, 0], found[:, 1], found[:, 2], found[:, 3] + k, found[:, 4], found[:, 5] + k], axis=1)


def solid(rows: np.ndarray, k: int) -> np.ndarray:
    """(id, of, start, end) of the runs of matches (id, of, diagonal, at), sorted, that skip no more than single words and have
    at least 4k words: these are similar enough in any case."""
    new = np.append(True, (np.diff(rows[:, :3], axis=0) != 0).any(axis=1) | (np.diff(rows[:, 3]) > k + 1))[:len(rows)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows))[:len(first)] - 1
    out = np.stack([rows[first, 0], rows[first, 1], rows[first, 3], rows[last, 3] + k], axis=1)
    return out[out[:, 3] - out[:, 2] >= 4 * k]


def outer(found: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The stretches (id, of, start, end, ...) that don't lie inside a solid run of their document and
    another earlier one."""
    if not len(found) or not len(runs):
        return found
    runs = runs[np.lexsort((runs[:, 1], -runs[:, 3], runs[:, 2], runs[:, 0]))]
    docs = np.unique(runs[:, 0])
    far = np.searchsorted(docs, runs[:, 0]) << 40
    ends = far + runs[:, 3]
    best = np.maximum.accumulate(ends)
    holder = np.maximum.accumulate(np.where(ends > np.append(-1, best[:-1]), np.arange(len(runs)), 0))
    doc = np.minimum(np.searchsorted(docs, found[:, 0]), len(docs) - 1)
    at = np.searchsorted(far + runs[:, 2], (doc << 40) + found[:, 2], side="right") - 1  # the last run that begins no later
    by = runs[holder[np.maximum(at, 0)]]
    inside = (at >= 0) & (by[:, 0] == found[:, 0]) & (by[:, 3] >= found[:, 3])
    return found[~inside | (by[:, 1] == found[:, 1])]  # a long run is cut into several stretches


def pieces(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, low and high of the ranges [low, high) of each group, ascending groups, joined where they overlap or touch."""
    order = np.lexsort((low, group))
    group, low, high = group[order], low[order], high[order]
    reached = np.maximum.accumulate((group << 40) + high)
    new = np.append(True, (group[1:] << 40) + low[1:] > reached[:-1])[:len(low)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low))[:len(first)] - 1
    return group[first], low[first], reached[last] - (group[last] << 40)


def _pairs(found: np.ndarray, margin: int) -> pa.RecordBatch:
    """Stretches as one row for each pair of documents, with the ranges of words that they and their margins cover on either
    side: stretches of a pair overlap much, and each word is sent once."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.append(True, (np.diff(found[:, :2], axis=0) != 0).any(axis=1))[:len(found)]
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    columns = [pa.array(found[first, 0]), pa.array(found[first, 1])]
    at = np.append(first, len(found))
    for start in (2, 4):
        of, low, high = pieces(group, np.maximum(found[:, start] - margin, 0), found[:, start + 1] + margin)
        columns += [lists(found[:, c].astype(np.int32), at, pa.int32()) for c in (start, start + 1)]
        between = np.searchsorted(of, np.arange(len(first) + 1))
        columns += [lists(c.astype(np.int32), between, pa.int32()) for c in (low, high)]
    return pa.RecordBatch.from_arrays(columns, names=_PAIR.fieldNames())


def stretches(found: DataFrame, k: int, least: int, share: float, parts: int, margin: int) -> DataFrame:
    """Chained matches of the documents of a part, whose matches are at most two for each of their words, by pairs of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate([np.zeros((0, 4), np.int64), *held])
            rows = rows[dense(rows, k, least, share)]
            rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
            same = (np.diff(rows[:, :2], axis=0) == 0).all(axis=1)  # a pair of documents with one match has no chain
            rows = rows[(np.append(same, False) | np.append(False, same))[:len(rows)]]
            got = outer(_stretches(rows, k), solid(rows, k)) if len(rows) else np.zeros((0, 6), np.int64)
            return _pairs(got, margin)

        held, now = [], None
        for part, rows in _parts(batches, 4):
            if held and part != now:
                yield emit(held)
                held = []
            now = part
            held.append(rows)
        yield emit(held)

    return found.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, _PAIR)


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by one big-number step for each word of `a`."""
    at: dict[int, int] = {}
    for i, w in enumerate(b.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for w in a.tolist():
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def align(a: np.ndarray, b: np.ndarray, a0: int, a1: int, b0: int, b1: int, similarity: float) -> tuple[int, int, int, int, int]:
    """Extend the stretches a[a0:a1] and b[b0:b1] at both ends while words are equal; also return their common words (a lower
    bound of them, if that is enough for the similarity)."""
    back = min(a0, b0)
    unequal = np.flatnonzero(a[a0 - back:a0][::-1] != b[b0 - back:b0][::-1])
    step = int(unequal[0]) if len(unequal) else back
    ahead = min(len(a) - a1, len(b) - b1)
    unequal = np.flatnonzero(a[a1:a1 + ahead] != b[b1:b1 + ahead])
    a0, b0 = a0 - step, b0 - step
    step = int(unequal[0]) if len(unequal) else ahead
    a1, b1 = a1 + step, b1 + step
    p, q = a[a0:a1], b[b0:b1]
    if len(p) == len(q) and (same := int((p == q).sum())) >= similarity * len(p):
        return a0, a1, b0, b1, same
    return a0, a1, b0, b1, common_words(p, q)


def common_places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a longest common subsequence are in `a` and in `b`."""
    at: dict[int, int] = {}
    for i, w in enumerate(b.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    rows = [full]
    for w in a.tolist():
        row = rows[-1]
        hit = row & at.get(w, 0)
        rows.append((row + hit | row - hit) & full)
    x, y, found = len(a), len(b), []
    while x and y:
        if rows[x] >> y - 1 & 1:
            y -= 1
        else:
            x -= 1
            if rows[x] >> y - 1 & 1:  # not yet counted without this word
                y -= 1
                found.append((x, y))
    places = np.array(found[::-1], np.int64).reshape(-1, 2)
    return places[:, 0], places[:, 1]


def segments(x: np.ndarray, y: np.ndarray, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """The maximal scoring parts of an alignment of the words at `x` with those at `y`, both ascending: (x0, x1, y0, y1, words in
    common). A pair of words earns 1 - similarity, a skipped word of the longer side costs the similarity, so that a part's
    score is above 0 only if its share is enough, and every equal run lies whole in one part (Ruzzo and Tompa)."""
    if not len(x):
        return []
    skipped = np.maximum(x[1:] - x[:-1], y[1:] - y[:-1]) - 1
    cut = skipped.nonzero()[0]
    ends = cut.tolist()
    total, parts, tie = 0.0, [], 1e-9
    for f, n, price in zip([0, *(i + 1 for i in ends)], [*ends, len(x) - 1], [0.0, *(similarity * skipped[cut]).tolist()], strict=True):
        low = total - price
        total = low + (1 - similarity) * (n - f + 1)
        while True:
            before = len(parts) - 1
            while before >= 0 and parts[before][2] > low + tie:
                before -= 1
            if before < 0 or parts[before][3] > total + tie:
                break
            f, _, low, _ = parts[before]
            del parts[before:]
        parts.append((f, n, low, total))
    return [(int(x[f]), int(x[n]) + 1, int(y[f]), int(y[n]) + 1, n - f + 1) for f, n, _, _ in parts]


def _in_common(a: np.ndarray, b: np.ndarray) -> int:
    """How many words of `a` are in `b`, at whatever place."""
    return sum(map(set(b.tolist()).__contains__, a.tolist()))


def parts_of(a: np.ndarray, b: np.ndarray, a0: int, a1: int, b0: int, b1: int, similarity: float, shortest: int) -> list[tuple[int, int, int, int, float]]:
    """The similar enough parts near a stretch, not too short, with their similarity: the whole of it if it is, what is similar
    along its diagonals, and the best of these together with what can be aligned before and behind it."""
    found, near = [], []
    for d in {b0 - a0, b1 - a1}:
        low, high = max(0, -d), min(len(a), len(b) - d)
        x = (a[low:high] == b[low + d:high + d]).nonzero()[0]
        near.append(len(x))
        if len(x) == len(a) >= shortest:  # all of it is equal
            return [(0, len(a), d, len(a) + d, 1.0)]
        found += segments(x + low if low else x, x + (low + d), similarity)
        if len(a) >= shortest and (found and found[-1][:2] == (0, len(a))):  # all of it is similar enough
            x0, x1, y0, y1, same = found[-1]
            return [(x0, x1, y0, y1, same / max(x1 - x0, y1 - y0))]
    if max(near) < similarity * shortest and _in_common(a, b) < similarity * shortest:  # no part of that length can be similar enough
        return []
    a0, a1, b0, b1, same = align(a, b, a0, a1, b0, b1, similarity)
    if same >= similarity * max(a1 - a0, b1 - b0):
        found.append((a0, a1, b0, b1, same))
    if found:
        x0, x1, y0, y1, _ = max(found, key=lambda p: p[4])
        # Behind a skipped word, only words in common that outweigh it make a part longer.
        ends = [e for e in ((0, x0, 0, y0), (x1, len(a), y1, len(b)))
                if _in_common(a[e[0]:e[1]], b[e[2]:e[3]]) * (1 - similarity) > similarity - 1e-9]
        ends = sorted([*ends, (x0, x1, y0, y1)]) if ends else []
    else:
        ends = [(0, len(a), 0, len(b))]
    path = []
    for x0, x1, y0, y1 in ends:
        p, q = a[x0:x1], b[y0:y1]
        if len(p) == len(q) and (p == q).all():
            x = y = np.arange(len(p))
        else:
            x, y = common_places(p, q)
        path.append((x0 + x, y0 + y))
    if path:
        found += segments(np.concatenate([x for x, _ in path]), np.concatenate([y for _, y in path]), similarity)
    out, reached = [], -1
    for x0, x1, y0, y1, same in sorted(found, key=lambda p: (p[0], -p[1])):
        share = same / max(x1 - x0, y1 - y0)
        if share >= similarity and x1 - x0 >= shortest and x1 > reached:  # else it lies in one that is kept
            reached = x1
            out.append((x0, x1, y0, y1, share))
    return out


def _word_arrays(docs: DataFrame) -> DataFrame:
    """The words of each document as the upper halves of their hashes."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("words", T.ArrayType(T.IntegerType()))])

    def run(batch: pa.RecordBatch) -> dict:
        found = list(blocks(utf8(batch.column("text"))))
        sizes = np.concatenate([np.diff(b.offsets) for b in found])
        halves = (np.concatenate([b.hashes for b in found]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return {"id": batch.column("id"), "words": lists(halves, np.concatenate([[0], np.cumsum(sizes)]), pa.int32())}

    return per_batch(docs, run, schema, rows=500)


def _one_text(docs: DataFrame) -> DataFrame:
    """The greatest text of each id; texts are dealt out only for ids that have several rows."""
    several = stored(docs.groupBy("id").count().where("count > 1").select("id"), "several-rows")
    if several.isEmpty():
        return docs
    return not_among(docs, several, "id", "id").unionByName(among(docs, several, "id", "id").groupBy("id").agg(F.max("text").alias("text")))


def sliced(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Two rows for each pair, one for each side, with the words that its ranges cover. Each document's words are dealt out once,
    and once more for every `_OFTEN` pairs that it is in, so that an anchor of very many pairs is not read by one task."""
    sides = [F.struct(F.col(doc).alias("doc"), F.lit(i).alias("side"), *(F.col(n).alias(m) for n, m in zip(names, _SIDES[0], strict=True)))
             for i, (doc, names) in enumerate(zip(("id", "of"), _SIDES, strict=True))]
    wanted = found.select("id", "of", F.explode(F.array(*sides)).alias("row")).select("id", "of", "row.*")
    named = few(stored(wanted.groupBy("doc").agg(F.ceil(F.count("*") / _OFTEN).alias("copies")), "named"))
    often = few(stored(named.where("copies > 1"), "often"))
    words = _word_arrays(marked(_one_text(docs), named, "id", "doc").where("_may").select("id", "text")).withColumnRenamed("id", "doc")
    words = words.join(often, "doc", "left").select("doc", "words", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("copies"), F.lit(1)).cast("int"))).alias("copy"))
    wanted = wanted.join(often, "doc", "left").withColumn("copy", F.pmod(F.xxhash64("id", "of"), F.coalesce("copies", F.lit(1))).cast("int") + 1)
    covered = F.expr("flatten(transform(arrays_zip(low, high), r -> slice(words, r.low + 1, r.high - r.low)))")
    return wanted.join(words, ["doc", "copy"]).select("id", "of", "side", *_SIDES[0], covered.alias("words"))


def aligned(found: DataFrame, docs: DataFrame, margin: int, similarity: float, shortest: int) -> DataFrame:
    """The parts of the stretches, extended, that are similar enough and not too short, with their similarity."""
    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in ("id", "of", "start", "end", "there", "there_end")), T.StructField("similarity", T.DoubleType())])

    def near(side: dict) -> Iterator[tuple[np.ndarray, int, int, int]]:
        """The words of each stretch with its margins, where they begin in the document, and the stretch among them."""
        begins = np.append(0, np.cumsum(side["high"] - side["low"]))
        at = np.searchsorted(side["low"], side["start"], side="right") - 1
        low = np.maximum(side["start"] - margin, 0)
        first = begins[at] + low - side["low"][at]
        for f, n, base, s, e in zip(first.tolist(), (first + side["end"] + margin - low).tolist(), low.tolist(), (side["start"] - low).tolist(), (side["end"] - low).tolist(), strict=True):
            yield side["words"][f:n], base, s, e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for batch in batches:
            ids, ofs, sides = (batch.column(c).to_pylist() for c in ("id", "of", "side"))
            flat = {c: (batch.column(c).values.to_numpy(), batch.column(c).offsets.to_numpy()) for c in (*_SIDES[0], "words")}
            out = []
            for i, side in enumerate(sides):
                row = {c: values[at[i]:at[i + 1]] if c == "words" else values[at[i]:at[i + 1]].astype(np.int64) for c, (values, at) in flat.items()}
                if side == 0:
                    here = (ids[i], ofs[i], row)
                elif here and here[:2] == (ids[i], ofs[i]):
                    for (a, base, s, e), (b, there, t, u) in zip(near(here[2]), near(row), strict=True):
                        out += [(ids[i], ofs[i], a0 + base, a1 + base, b0 + there, b1 + there, share)
                                for a0, a1, b0, b1, share in parts_of(a, b, s, min(e, len(a)), t, min(u, len(b)), similarity, shortest)]
            if here:  # its other side may be in the next batch
                here = (*here[:2], {c: v.copy() for c, v in here[2].items()})
            yield pa.RecordBatch.from_pydict({f.name: [row[n] for row in out] for n, f in enumerate(schema.fields)}, schema=arrow)

    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema.fields])
    return sliced(found, docs).repartition("id", "of").sortWithinPartitions("id", "of", "side").mapInArrow(run, schema)


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 50, similarity: float = 0.8, k: int = 4,
             margin: int = 24, shortest: int = 12, gap: int = 3, share: float = 0.3) -> DataFrame:
    """One row per repeated passage: id, start and end (words), the ids of earlier documents that hold parts of it
    (`sources`), and the least similarity of its parts."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 4
    bits, parts = min(62, max(1, words).bit_length() + 12), min(1 << 16, max(1, -(-words // _PART)))  # about one seed of 4,096 meets another's hash
    bits = min(bits, 62 - parts.bit_length())
    packed = matches(seeds(docs, k, least, bits, parts), parts)
    chained = stored(stretches(packed, k, least, share, parts, margin), "stretches")
    parts = stored(aligned(chained, docs, margin, similarity, shortest), "aligned")
    before = Window.partitionBy("id").orderBy("start", "end")
    reached = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    islands = (parts.withColumn("new", F.when(F.col("start") <= reached + gap, 0).otherwise(1))
               .withColumn("island", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0))))
    return (islands.groupBy("id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                                                F.array_sort(F.collect_set("of")).alias("sources"), F.min("similarity").alias("similarity"))
            .where(F.col("end") - F.col("start") >= least).drop("island"))


def without(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their passages cut out of the text, from a passage's first word to the next word behind it."""
    cuts = found.groupBy(F.col("id").alias("_of")).agg(F.array_sort(F.collect_list(F.struct(F.col("start"), F.col("end")))).alias("_cuts"))
    @F.pandas_udf(T.StringType())
    def cut(texts, starts, ends):
        import pandas as pd

        return pd.Series([remove(t, s, e) for t, s, e in zip(texts, starts, ends, strict=True)], dtype=object)

    # Only documents that may have passages are dealt out, and only those that have go through Python.
    rows = marked(docs, found, doc_id, "id")
    joined = rows.where("_may").drop("_may").join(cuts, F.col(doc_id).cast("long") == F.col("_of"), "left").drop("_of")
    changed = cut(F.col(text), F.transform("_cuts", lambda c: c["start"]), F.transform("_cuts", lambda c: c["end"]))
    left = rows.where("NOT _may").drop("_may").unionByName(joined.where(F.col("_cuts").isNull()).drop("_cuts"))
    return left.unionByName(joined.where(F.col("_cuts").isNotNull()).withColumn(text, changed).drop("_cuts"))


def remove(text: str | None, starts, ends) -> str | None:
    """Cut stretches of words, given in ascending order, out of a text."""
    if text is None:
        return None
    data = text.encode()
    (block,) = list(blocks([data]))
    kept, at = [], 0
    for start, end in zip(starts, ends, strict=True):
        if start < len(block.starts):
            kept.append(data[at:block.starts[start]])
            at = block.starts[end] if end < len(block.starts) else len(data)
    return b"".join([*kept, data[at:]]).decode()


