"""Near-duplicate documents by DartMinHash.

A text is a weighted set: its shingles of five words, each with a weight (1, or how often it occurs). Each element throws
darts at a board of weight by time: a Poisson process that depends on the element alone, cut into bands of weight [0, 1),
[1, 2), [2, 4) and so on. A dart counts if it lands within the element's weight. Every dart belongs to one of k coordinates,
and a coordinate keeps the earliest dart. Two sets agree in a coordinate with the probability of their weighted Jaccard
similarity. Darts are thrown up to a time at which about k(ln k + 3) have landed on the whole set, later only for sets with a
coordinate still empty, so the cost is that of reading the set once plus k log k.

Texts with the same words are one text. Signatures are cut into bands; texts that agree in a whole band meet in a bucket. In
a bucket nothing is paired with everything: members are compared with the leader, the member that meets most others. A
comparison is exact (intersection of the shingle sets). Where a bucket holds members of several classes beside its leader,
those of different classes are compared with each other if they are few, or if all such pairs are a few for each document; else those that can still be similar
meet again in smaller buckets, by the shingles that they do not share with the leader (`_still_possible`). No link between texts that met is lost, and a group of n copies takes about n
comparisons. Classes are the connected components.

A text without words is near only to texts of the same bytes; a null text or a null id has no class (null). An id with
several texts joins their classes, and is compared by the greatest of them. Texts of fewer than five words are one shingle. Repeated rows give repeated results."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cutline.llm.components import components
from cutline.llm.frames import among, few, lists, per_batch, stored
from cutline.llm.words import Block, blocks, mix, shingles, signed, utf8

_SEED = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LATE = np.uint64(0x2545F4914F6CDD1D)
_SLACK = 1e-9  # of a comparison of counts
_FEW = 64  # members of a bucket that are compared with each other in any case
_PAIRS_EACH = 4  # pairs a document, up to which larger buckets are, too: that saves rounds, and work stays in proportion


def signatures(elements: np.ndarray, weights: np.ndarray, owners: np.ndarray, sets: int, k: int) -> np.ndarray:
    """DartMinHash signatures, one row of k numbers for each set, from flat arrays of distinct elements with positive
    weights and the set that each belongs to. The row of a set without elements is zero."""
    total = np.bincount(owners, weights, minlength=sets)
    rank, value = np.full(sets * k, np.inf), np.zeros(sets * k, np.uint64)
    # Elements by bands of weight.
    band = np.zeros(len(elements), np.int64)
    keys, low, width, reach, owner = [], [], [], [], []
    while True:
        bottom = np.where(band == 0, 0.0, np.exp2(band - 1.0))
        on = bottom < weights
        if not on.any():
            break
        n = int(band[0])
        keys.append(mix(elements[on] * _STEP + np.uint64((n * int(_LATE) + int(_SEED)) % (1 << 64))))
        low.append(bottom[on])
        width.append(np.full(on.sum(), 1.0 if n == 0 else 2.0 ** (n - 1)))
        reach.append(weights[on])
        owner.append(owners[on])
        band += 1
    if not keys:
        return value.reshape(sets, k)
    keys, low, width, reach, owner = (np.concatenate(x) for x in (keys, low, width, reach, owner))
    limit = np.where(total > 0, k * (np.log(k) + 3.0) / np.maximum(total, 1e-300), 0.0)
    open_sets = total > 0
    while open_sets.any():
        live = np.flatnonzero(open_sets[owner])
        key, lo, wide, top, of = keys[live], low[live], width[live], reach[live], owner[live]
        until, time, throw = limit[of], np.zeros(len(live)), 0
        while len(key):
            throw += 1
            draw = mix(key + np.uint64(throw * int(_STEP) % (1 << 64)))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / wide
            on = time < until
            if not on.all():
                key, lo, wide, top, of, until, time, draw = (x[on] for x in (key, lo, wide, top, of, until, time, draw))
            place = mix(draw ^ _LATE)
            lands = lo + wide * ((place >> np.uint64(32)).astype(np.float64) * 2.0**-32) < top
            cell = of * k + ((place & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
            better = np.flatnonzero(lands & (time < rank[cell]))
            if len(better):
                cell, when = cell[better], time[better]
                np.minimum.at(rank, cell, when)
                won = rank[cell] == when
                value[cell[won]] = draw[better][won]
        empty = np.isinf(rank).reshape(sets, k).any(axis=1)
        open_sets &= empty
        limit = limit * 2
    return value.reshape(sets, k)


def shingle_sets(block: Block, size: int, weighted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of the texts of a block, sorted within each text: elements, weights and owners."""
    owner = block.owners()
    found = shingles(block.hashes, size)
    inside = owner[: len(found)] == owner[size - 1:] if len(found) else np.zeros(0, bool)
    elements, of = found[inside], owner[: len(found)][inside]
    short = [(i, block.hashes[a:b]) for i, (a, b) in enumerate(zip(block.offsets[:-1], block.offsets[1:], strict=True)) if 0 < b - a < size]
    if short:
        elements = np.concatenate([elements, [shingles(h, len(h))[0] for _, h in short]])
        of = np.concatenate([of, [i for i, _ in short]])
    order = np.lexsort((elements, of))
    elements, of = elements[order], of[order]
    new = np.concatenate([[True], (elements[1:] != elements[:-1]) | (of[1:] != of[:-1])]) if len(elements) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(elements))).astype(np.float64)
    return elements[at], counts if weighted else np.ones(len(at)), of[at]


def signed_texts(docs: DataFrame, size: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """id, digest of the words, number of distinct shingles and a hash for each band."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("n", T.LongType()),
                           T.StructField("buckets", T.ArrayType(T.LongType()))])

    def run(batch: pa.RecordBatch) -> dict:
        texts = utf8(batch.column("text"))
        digests, sizes, found, lengths = [], [], [], []
        for block in blocks(texts):
            elements, weights, of = shingle_sets(block, size, weighted)
            n = np.bincount(of, minlength=len(block))
            sig = signatures(elements, weights, of, len(block), bands * rows).reshape(len(block), bands, rows)
            hashed = np.zeros((len(block), bands), np.uint64)
            for r in range(rows):
                hashed = mix(hashed * _STEP + sig[:, :, r])
            hashed = mix(hashed + np.arange(bands, dtype=np.uint64) * _LATE)
            found.append(hashed[n > 0].ravel())
            lengths += [bands if x else 0 for x in n]
            sizes += n.tolist()
            for i in range(len(block)):
                text = texts[block.first + i]
                whole = block.hashes[block.offsets[i]:block.offsets[i + 1]]
                digests.append(None if text is None else hashlib.blake2b(whole.tobytes() if len(whole) else b" " + text, digest_size=16).hexdigest())
        return {"id": batch.column("id"), "digest": digests, "n": sizes, "buckets": lists(signed(np.concatenate(found)), np.cumsum([0, *lengths]), pa.int64())}

    return per_batch(docs, run, schema)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("elements", T.ArrayType(T.LongType()))])

    def run(batch: pa.RecordBatch) -> dict:
        found, lengths = [np.zeros(0, np.uint64)], [0]
        for block in blocks(utf8(batch.column("text"))):
            elements, _, of = shingle_sets(block, size)
            found.append(elements)
            lengths += np.bincount(of, minlength=len(block)).tolist()
        return {"id": batch.column("id"), "elements": lists(signed(np.concatenate(found)), np.cumsum(lengths), pa.int64())}

    return per_batch(docs, run, schema)


def _beside(pairs: DataFrame, sets: DataFrame, salts: int = 32) -> DataFrame:
    """Pairs (a, b) with their shingle sets. b may be in very many pairs: they are dealt over `salts` copies of its set."""
    salt = F.pmod(F.xxhash64("a"), F.lit(salts)).alias("salt")
    left = pairs.select("*", salt).join(sets.select(F.col("id").alias("a"), F.col("elements").alias("of_a")), "a")
    right = pairs.select("b", salt).distinct().join(sets.select(F.col("id").alias("b"), F.col("elements").alias("of_b")), "b")
    return left.join(right, ["b", "salt"])


def _near(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs whose shingle sets have at least the similarity."""
    common = F.size(F.array_intersect("of_a", "of_b"))
    return (_beside(pairs, sets).withColumn("common", common)
            .where(F.col("common") >= similarity * (F.size("of_a") + F.size("of_b") - F.col("common")) - _SLACK).select("a", "b"))


def _still_possible(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Smaller buckets in which any two members of a bucket that are similar enough meet again, the leader left aside.

    Let a member have `shared` shingles in common with the leader and others of its own. A similar member holds at least
    similarity x size of its shingles. So either it needs `need` > 0 of the member's own shingles, and the two meet at one of
    the first (own - need + 1) of them in an order that all members of the leader share: those that the fewest of them have come
    first, and what only one has meets nobody. Or they may have none of those in common, and then the counts alone
    must allow it: min(shared) / (own + own + max(shared)) >= similarity. Such pairs of counts are few, and their members meet
    there. Everything else can't be similar, so nothing is lost; copies with independent changes no longer meet at all."""
    pairs = rest.select(F.col("id").alias("a"), F.col("leader").alias("b"), "n", "centre", "root").distinct()
    own = F.array_except("of_a", "of_b")
    edits = (_beside(pairs, sets).select("a", "b", "n", "centre", "root", own.alias("own")).withColumn("shared", F.col("n") - F.size("own"))
             .withColumn("need", F.ceil(similarity * F.col("n") - F.col("shared") - _SLACK)).withColumn("others", F.size("own")))
    edits = few(stored(edits.withColumn("own", F.when(F.col("others") >= F.col("need"), F.col("own"))), "edits"))
    kept = ("id", "n", "centre", "root")
    spelled = edits.select("a", "b", "n", "centre", "root", "need", F.explode("own").alias("shingle"))
    held = spelled.groupBy("b", "shingle").agg(F.count("*").alias("held")).where("held > 1")
    of_pair = Window.partitionBy("a", "b")
    # Shingles that only one member has are left out here; they take the first places, so as many fewer of these are asked.
    meeting = (spelled.join(held, ["b", "shingle"])
               .select("*", F.row_number().over(of_pair.orderBy("held", "shingle")).alias("place"), F.count("*").over(of_pair).alias("common"))
               .where(F.col("place") <= F.col("common") - F.greatest(F.lit(1), F.col("need")) + 1)
               .select(F.xxhash64("b", "shingle").alias("bucket"), F.col("a").alias("id"), "n", "centre", "root"))
    cells = edits.where("need <= 0").groupBy("b", "shared", "others").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    left, right = (cells.select("b", *[F.col(c).alias(f"{c}{i}") for c in ("shared", "others", "low", "high")]) for i in (1, 2))
    allowed = ((F.struct("shared1", "others1") <= F.struct("shared2", "others2")) & (F.least("low1", "low2") < F.greatest("high1", "high2"))
               & (F.least("shared1", "shared2") >= similarity * (F.col("others1") + F.col("others2") + F.greatest("shared1", "shared2")) - _SLACK))
    both = left.join(right, "b").where(allowed).select("b", F.xxhash64("b", "shared1", "others1", "shared2", "others2").alias("bucket"), F.explode(F.array(
        F.struct(F.col("shared1").alias("shared"), F.col("others1").alias("others")), F.struct(F.col("shared2").alias("shared"), F.col("others2").alias("others")))).alias("cell")).select("b", "bucket", "cell.*").distinct()
    counted = edits.where("need <= 0").join(both, ["b", "shared", "others"]).select("bucket", F.col("a").alias("id"), "n", "centre", "root")
    return meeting.unionByName(counted).select("bucket", *kept).distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, size: int = 5, bands: int = 24,
            rows: int = 5, weighted: bool = False) -> DataFrame:
    """One row per document: id and class_id, the smallest id among the documents it is connected with by links of at
    least `similarity` (set similarity of shingles; `weighted` makes signatures follow their counts).

    A pair of the least similarity meets in a bucket with probability 1 - (1 - similarity ** rows) ** bands: 0.9999."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    marked = stored(signed_texts(docs, size, bands, rows, weighted), "signatures")
    named = marked.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    # Size and buckets depend on the words alone: each different text has them once.
    texts = stored(named.groupBy("digest").agg(F.min("id").alias("text_id"), F.first("n").alias("n"), F.first("buckets").alias("buckets")), "texts")
    rows_ = texts.select(F.col("text_id").alias("id"), "n", F.explode("buckets").alias("bucket"))
    shared = rows_.groupBy("bucket").agg(F.count("*").alias("met")).where("met > 1")
    hits = stored(rows_.join(shared, "bucket"), "buckets")
    central = hits.groupBy("id").agg(F.sum("met").alias("centre"))
    state = few(stored(hits.join(central, "id").select("bucket", "id", "n", "centre", F.col("id").alias("root")), "members"))
    wanted = few(stored(state.select("id").distinct(), "candidates"))
    budget = _PAIRS_EACH * wanted.count()
    sets = stored(_sets(among(docs, wanted, "id", "id").groupBy("id").agg(F.max("text").alias("text")), size), "shingles")

    roots, links, small = None, _several_texts(named, texts), None
    while True:
        led, pairs = None, small
        if state is not None:
            best = F.struct("centre", F.xxhash64("id", "bucket").alias("tie"), F.col("id").alias("leader"), F.col("n").alias("leader_n"), F.col("root").alias("leader_root"))
            led = few(stored(state.groupBy("bucket").agg(F.max(best).alias("best")).select("bucket", "best.leader", "best.leader_n", "best.leader_root"), "leaders"))
            met = state.join(led, "bucket").where((F.col("root") != F.col("leader_root")) & _sizes_allow("n", "leader_n", similarity)).select(F.col("id").alias("a"), F.col("leader").alias("b"))
            pairs = met if small is None else met.unionByName(small)
        near = few(stored(_near(few(stored(pairs.distinct(), "pairs")), sets, similarity), "near"))
        if roots is None:
            roots = few(stored(components(near if links is None else near.unionByName(links)), "roots"))
        elif not near.isEmpty():
            roots = _joined(roots, near)
        if state is None:
            break
        # The leader is done with, and so is a bucket whose other members are all of one class.
        rest = (state.drop("root").join(led.select("bucket", "leader"), "bucket").where("id != leader")
                .join(roots.withColumnRenamed("vertex", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
        rest = few(stored(rest, "rest"))
        rest = few(stored(rest.join(_mixed(rest), "bucket"), "mixed"))
        if rest.isEmpty():
            break
        limit = _most_compared(rest, budget)
        small = few(stored(_pairs_of_few(rest.where(F.col("members") <= limit), similarity), "small-buckets"))
        small, state, large = None if small.isEmpty() else small, None, rest.where(F.col("members") > limit)
        if not large.isEmpty():
            state = few(stored(_still_possible(large, sets, similarity), "possible"))
            state = few(stored(state.join(_mixed(state), "bucket", "left_semi"), "members"))
            state = None if state.isEmpty() else state
        if state is None and small is None:
            break
    return (marked.join(texts.select("digest", "text_id"), "digest", "left").join(roots, F.col("text_id") == F.col("vertex"), "left")
            .select("id", F.when(F.col("id").isNotNull(), F.coalesce("root", "text_id")).alias("class_id")))


def _mixed(members: DataFrame) -> DataFrame:
    """Buckets with members of several classes, and how many members they have."""
    return members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).where("low != high").select("bucket", "members")


def _most_compared(members: DataFrame, budget: int) -> int:
    """The size up to which the members of buckets are compared with each other: the largest that keeps all those pairs within the
    budget, _FEW at least. One number per size of a bucket reaches the driver."""
    limit, pairs = _FEW, 0
    for r in members.groupBy("members").agg(F.count("*").alias("rows")).orderBy("members").collect():
        pairs += r["rows"] * (r["members"] - 1) // 2
        if pairs > budget:
            break
        limit = max(limit, r["members"])
    return limit


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Classes so far (vertex, root) with the classes of new links joined: only links between different classes are followed."""
    for side in ("a", "b"):
        of = roots.select(F.col("vertex").alias(side), F.col("root").alias("_root"))
        links = links.join(of, side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
    links = few(stored(links.where("a <> b"), "class-links"))
    if links.isEmpty():
        return roots
    new = few(stored(components(links), "joined-classes"))
    every = roots.unionByName(new.select("vertex", F.col("vertex").alias("root"))).groupBy("vertex").agg(F.min("root").alias("root"))
    joined = every.join(new.select(F.col("vertex").alias("root"), F.col("root").alias("_root")), "root", "left").select("vertex", F.coalesce("_root", "root").alias("root"))
    return few(stored(joined, "roots"))


def _sizes_allow(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= similarity * F.greatest(a, b) - _SLACK


def _pairs_of_few(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different classes inside buckets of few members."""
    left, right = (members.select("bucket", *[F.col(c).alias(f"{c}{i}") for c in ("id", "n", "root")]) for i in (1, 2))
    return (left.join(right, "bucket").where((F.col("id1") < F.col("id2")) & (F.col("root1") != F.col("root2")) & _sizes_allow("n1", "n2", similarity))
            .select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct())


def _several_texts(named: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links from ids that name several texts to the documents that stand for those texts; as a rule there are none."""
    several = stored(named.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high").select("id"), "several-texts")
    if several.isEmpty():
        return None
    return stored(named.join(several, "id", "left_semi").join(texts, "digest").select(F.col("id").alias("a"), F.col("text_id").alias("b")).distinct(), "own-links")
