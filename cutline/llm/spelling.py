"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced character, found by variable-length grams.

Words are counted first, in Python batches that add up their counts before anything is exchanged. A word is then written with a mark at
both ends. The dictionary of grams is a tree over the counted words: a gram of `shortest` characters is always in it, a longer one
only if the gram without its last character occurs in more than `frequent` places; so grams that are rare enough are not extended
(pruned), and the tree is known by its frequent inner grams alone. There are at most `inner` of these for each length (`frequent` is
raised to the number of places over `inner`), which bounds what is broadcast whatever the corpus.

The gram at a place of a word is the longest of the dictionary that begins there: the walk ends at the first gram that is not an
inner one. A word is decomposed into these, without those that lie inside the one before. An edit changes only grams that hold the
edited character, since a walk does not look behind its gram. The most grams of a word that one edit can hold is its bound of affected
grams; `most` grams of a word being at least one more, some stay as they are: a word that is near holds them too, at the same place or
one beside it, among the grams at all of its own places. `longest` is half the least length of a marked word, so that there is always
one such gram: an edit at a place leaves the first gram of the word, or one that reaches its end.

Of each word only the bound + 1 grams with the shortest lists go out (with more, `votes` of them must be found), matched with the
lists of all places by gram, place and length; lists found in common are merged and counted per pair, and what remains is verified by
edit distance. Every pair is met from its shorter word, so nothing is lost. No list is paired with itself, and long lists are chosen
last.

Null texts have no words; a null id is written as an empty text. Rows that repeat count each time. Ties of forms go to the first
word in code-point order. No rows give none."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F, types as T

from cutline.llm.frames import few, stored

_WORDS = re.compile(rb"[a-z\xc0-\xff]+")
_HELD = 200_000  # distinct words that a task adds up before it sends them on
_START, _END = "^", "$"  # marks of the ends of a word; not letters
_COUNTS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
_PLACES = T.StructType([T.StructField("word", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("gram", T.StringType()),
                        T.StructField("place", T.IntegerType()), T.StructField("own", T.BooleanType()), T.StructField("affected", T.IntegerType())])

Slip = Callable[[bytes, int, bytes], bytes]


def no_slip(word: bytes, seen: int, latin: bytes) -> bytes:
    """Words as they are."""
    return latin


def one_in(modulus: int) -> Slip:
    """Delete one character of a word whose crc32, after the id and a colon, is a multiple of `modulus`: the character at the crc32
    modulo the length."""

    def slip(word: bytes, seen: int, latin: bytes) -> bytes:
        h = zlib.crc32(word, seen)
        if h % modulus:
            return latin
        at = h % len(latin)
        return latin[:at] + latin[at + 1:]

    return slip


def counted(docs: DataFrame, doc_id: str, text: str, least: int, slip: Slip) -> DataFrame:
    """Words of at least `least` characters and how often each occurs. A word is a run of the letters A-Z, a-z (lower-cased) and the
    characters U+00C0 to U+00FF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=_COUNTS.fieldNames())
            held.clear()
            return out

        for batch in batches:
            for id_, value in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not value:
                    continue
                # One byte a character: what is beyond U+00FF becomes a question mark, which is no letter.
                runs = [w for w in _WORDS.findall(value.encode("latin-1", "replace").lower()) if len(w) >= least]
                seen = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
                held.update([slip(w if w.isascii() else w.decode("latin-1").encode(), seen, w) for w in runs])
                if len(held) >= _HELD:
                    yield emit()
        yield emit()

    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, _COUNTS).where(F.char_length("word") >= least).groupBy("word").agg(F.sum("n").alias("n"))


def gram_at(word: str, place: int, inner: frozenset[str] | set[str], shortest: int, longest: int) -> str:
    """The longest gram of the dictionary at a place of a marked word."""
    end = min(place + shortest, len(word))
    while end < len(word) and end - place < longest and word[place:end] in inner:
        end += 1
    return word[place:end]


def decomposed(word: str, inner: frozenset[str] | set[str], shortest: int, longest: int) -> list[tuple[int, str, bool]]:
    """(place, gram, whether it is no part of the one before) for each place of a marked word."""
    out, reached = [], 0
    for place in range(len(word) - shortest + 1):
        gram = gram_at(word, place, inner, shortest, longest)
        own = place + len(gram) > reached
        reached = max(reached, place + len(gram))
        out.append((place, gram, own))
    return out


def affected(grams: list[tuple[int, str, bool]]) -> int:
    """The most grams, of those that are no part of others, that one edit can change: those that hold one place."""
    ends = [(place, place + len(gram)) for place, gram, own in grams if own]
    return max(sum(a <= i < b for a, b in ends) for i in range(1, ends[-1][1]))


def _inner_grams(words: DataFrame, shortest: int, longest: int, frequent: int, inner: int) -> Broadcast:
    """The frequent grams, below the greatest length."""
    marked = F.concat(F.lit(_START), "word", F.lit(_END))
    found: set[str] = set()
    for size in range(shortest, longest):
        places = F.transform(F.sequence(F.lit(1), F.char_length("marked") - size + 1), lambda i: F.substring("marked", i, F.lit(size)))
        grams = words.select(marked.alias("marked")).select(F.explode(places).alias("gram")).groupBy("gram").count()
        grams = stored(grams, "grams")
        limit = max(frequent, (grams.agg(F.sum("count")).first()[0] or 0) // inner)
        found |= {r.gram for r in grams.where(F.col("count") > limit).collect()}  # fewer than `inner`
    return words.sparkSession.sparkContext.broadcast(frozenset(found))


def _grams(words: DataFrame, inner: Broadcast, shortest: int, longest: int) -> DataFrame:
    """The gram at each place of each word, with the bound of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = inner.value
        for batch in batches:
            out: list[tuple] = []
            for word in batch.column("word").to_pylist():
                grams = decomposed(_START + word + _END, known, shortest, longest)
                bound = affected(grams)
                out += [(word, len(word), gram, place, own, bound) for place, gram, own in grams]
            columns = zip(*out, strict=True) if out else [[]] * len(_PLACES)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=_PLACES.fieldNames())

    return words.select("word").mapInArrow(run, _PLACES)


def near_pairs(words: DataFrame, least: int, shortest: int = 2, longest: int = 4, frequent: int = 32, inner: int = 20_000, votes: int = 1) -> DataFrame:
    """(`a`, `b`): distinct words, of at least `least` characters, at an edit distance of exactly one; each pair once."""
    longest = min(longest, (least + 2) // 2)
    if longest < shortest:
        raise ValueError(f"words of {least} characters are too short for grams of {shortest}")
    places = stored(_grams(words, _inner_grams(words, shortest, longest, frequent, inner), shortest, longest), "gram-places")
    lists = stored(places.groupBy("gram", "place", "size").agg(F.count("*").alias("met")), "gram-lists")
    own = places.where("own").join(lists, ["gram", "place", "size"])
    rarest = Window.partitionBy("word").orderBy("met", "place")  # a word has few grams
    asked = (own.withColumn("no", F.row_number().over(rarest)).withColumn("grams", F.count("*").over(Window.partitionBy("word")))
             .withColumn("votes", F.least(F.lit(votes), F.col("grams") - F.col("affected"))).where(F.col("no") <= F.col("affected") + F.col("votes")))
    # A near word of the same length has the gram at its place, one longer by a character there or one further on.
    targets = F.explode(F.array(*[F.struct((F.col("place") + p).alias("place"), (F.col("size") + s).alias("size")) for p, s in ((0, 0), (0, 1), (1, 1))])).alias("t")
    asked = asked.select(F.col("word").alias("a"), "gram", "votes", F.col("place").alias("at"), targets).select("a", "gram", "votes", "at", "t.*")
    met = asked.join(places.select(F.col("word").alias("b"), "gram", "place", "size"), ["gram", "place", "size"]).where("a <> b")
    # Lists of one gram of the word count once for a pair.
    merged = met.groupBy("a", "b").agg(F.count_distinct("at").alias("found"), F.max("votes").alias("votes")) if votes > 1 else met.select("a", "b").distinct().withColumns({"found": F.lit(1), "votes": F.lit(1)})
    verified = merged.where(F.col("found") >= F.col("votes")).where(F.levenshtein("a", "b", 1) == 1)
    return verified.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(words: DataFrame) -> DataFrame:
    """word and root for words that have a form: forms followed to the last, twice as far in each round. A form is at least `ratio`
    times as frequent, so chains are short."""
    at = few(stored(words.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots"))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = few(stored(at.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots"))
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, seen: int = 5, ratio: int = 5, slip: Slip = no_slip, **grams) -> DataFrame:
    """One row per word of at least `least` characters that occurs at least `seen` times: word, n, n_near (how many words are at an
    edit distance of one), form and form_n (the most frequent of these, if at least `ratio` times as frequent as the word) and root
    (the end of the chain of forms, the word itself if it has none). `slip` may change a word in a document before it is counted."""
    words = few(stored(counted(docs, doc_id, text, least, slip).where(F.col("n") >= seen), "words"))
    pairs = stored(near_pairs(words, least, **grams), "near-words")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*")
    near = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    fits = -F.col("best.minus") >= ratio * F.col("n")
    found = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                            F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n")), "forms")
    return found.join(_roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
