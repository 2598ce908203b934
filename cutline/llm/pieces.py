"""SentencePiece BPE: whole texts to piece ids with the span of original bytes behind each piece, and ids back to text.

A text is normalised by the longest prefix of what is left that the model's compiled character map knows (a double-array trie
with the replacements behind it); characters that begin no entry are copied. Each normalised character remembers where the
characters it stands for begin in the text, so that every piece is projected to original bytes, also where a character was
replaced, removed or made up (the space put in front has no bytes). A piece of a character's bytes has the character's span if it
is the last of them, else none, as in the library.

The best-scored pair of neighbours is merged first, the leftmost of equals. Where no piece of the vocabulary has a space behind
another character, merges never cross from a word to the next space, so words are encoded one by one and those seen lately are
looked up; other models are encoded text by text.

A null text is an empty text: no pieces, and the end id if one is asked for. Bytes that are not UTF-8 count as U+FFFD each. Repeated
rows give repeated results; a null id is an id like any other. The model is public and small; its size is checked before it is sent."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cutline.llm.frames import lists
from cutline.llm.words import utf8

_LARGEST_MODEL = 64 << 20
_CACHE = 300_000  # words whose pieces a Python worker keeps, about
_TOGETHER = 2048  # words merged at once
_LONGEST_KEPT = 64  # characters of a word that is kept
_BATCH_BYTES = 1 << 20
_SPACE = "▁"
_UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 2, 3, 4, 5, 6  # types of pieces in the model file
_ID, _LENGTH = np.uint32(0xFFFFFF), np.uint32(24)
_loaded: dict[str, Codec] = {}


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("cutline-one-by-one", _one_by_one)


class CharacterMap:
    """The compiled map of a model: a length, a double-array trie of UTF-8 keys, then replacements, each with a null byte behind
    it. A unit of the trie holds a label in its low byte, whether a value follows in bit 8, and the offset to its children above;
    the unit of a value holds where the replacement begins."""

    def __init__(self, content: bytes):
        size = int.from_bytes(content[:4], "little") if content else 0
        self.units = np.frombuffer(content[4:4 + size], "<u4").tolist()
        self.texts = content[4 + size:]
        first = sorted(self._first_characters()) if self.units else []
        self.starts = re.compile("[" + "".join(map(re.escape, first)) + "]") if first else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _child(self, node: int, byte: int) -> int:
        """The unit below a node by one byte, or -1; a node is where its children are counted from."""
        at = node ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else -1

    def longest(self, key: bytes) -> tuple[str, int] | None:
        """The replacement for the longest entry that the bytes begin with, and the bytes it takes."""
        node, found = self._offset(self.units[0]), None
        for n, byte in enumerate(key, 1):
            at = self._child(node, byte)
            if at < 0:
                break
            node = at ^ self._offset(self.units[at])
            if self.units[at] >> 8 & 1:
                found = self.units[node] & 0x7FFFFFFF, n
        if found is None:
            return None
        start, n = found
        return self.texts[start:self.texts.index(b"\0", start)].decode(), n

    def _first_characters(self) -> Iterator[str]:
        """Characters that an entry begins with."""
        waiting = [(self._offset(self.units[0]), b"")]
        while waiting:
            node, key = waiting.pop()
            for byte in range(1, 256) if not key else range(0x80, 0xC0):
                at = self._child(node, byte)
                if at < 0:
                    continue
                longer = key + bytes([byte])
                if len(longer) == (1 if longer[0] < 0xC0 else 2 if longer[0] < 0xE0 else 3 if longer[0] < 0xF0 else 4):
                    yield longer.decode()
                else:
                    waiting.append((at ^ self._offset(self.units[at]), longer))

    def replaced(self, text: str) -> Iterator[tuple[str, int]]:
        """The text as (piece of normalised text, characters of the original): copied stretches, and one entry each."""
        at = 0
        while at < len(text):
            match = self.starts.search(text, at) if self.starts else None
            if match is None:
                yield text[at:], len(text) - at
                return
            start = match.start()
            if start > at:
                yield text[at:start], start - at
            # No key of such maps is near this long.
            found = self.longest(text[start:start + 64].encode())
            if found is None:
                yield text[start], 1
                at = start + 1
            else:
                taken = len(text[start:start + 64].encode()[:found[1]].decode())
                yield found[0], -taken
                at = start + taken


class Seen(dict):
    """The packed ids of words. Of what is no longer held here, the last half of the cache is still at hand, so frequent words are
    merged once."""

    def __init__(self, packed: Callable[[str], bytes]):
        super().__init__()
        self.packed, self.older = packed, {}

    def make_room(self, n: int) -> None:
        if len(self) + n > _CACHE // 2:
            self.older = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes:
        value = self.older.get(word)
        if value is None:
            value = self.packed(word)
        if len(word) <= _LONGEST_KEPT:
            self[word] = value
        return value


def _packed(ids: list[tuple[int, int]]) -> bytes:
    return np.array([i | n << 24 for i, n in ids], np.uint32).tobytes()


class Numbers(dict):
    """The packed ids of each piece; a character that is none is its bytes, the last of which stands for it, or unknown."""

    def __init__(self, known: dict[str, bytes], of_byte: dict[int, int], unknown: int):
        super().__init__(known)
        self.of_byte, self.unknown = of_byte, unknown

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        return _packed([(self.of_byte[b], n == len(data)) for n, b in enumerate(data, 1)] if self.of_byte else [(self.unknown, len(piece))])


class Codec:
    """A model as tables. Built once per Python worker."""

    def __init__(self, content: bytes):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(content)
        if model.trainer_spec.model_type != 2 or any(p.type == _USER for p in model.pieces) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models without symbols of the user's own and with spaces in front are supported")
        spec = model.normalizer_spec
        self.map, self.prefix, self.trimmed, self.escaped = CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.ids = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type not in (_UNKNOWN, _CONTROL, _BYTE)}
        self.unused = {p.piece for p in model.pieces if p.type == _UNUSED}
        scores = sorted({score for _, score in self.ids.values()}, reverse=True)
        ranks = {score: rank for rank, score in enumerate(scores)}
        self.order, self.last = {p: ranks[score] for p, (_, score) in self.ids.items()}, len(scores)
        self.unknown = self.types.index(_UNKNOWN)
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE} if model.trainer_spec.byte_fallback else {}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.surface = [model.trainer_spec.unk_surface if t == _UNKNOWN else "" if t in (_CONTROL, _BYTE) else p.replace(_SPACE, " ") for p, t in zip(self.pieces, self.types, strict=True)]
        self.end = next((i for i, p in enumerate(self.pieces) if p == model.trainer_spec.eos_piece), -1)
        self.by_words = not any(_SPACE in p.lstrip(_SPACE) for p in self.ids)
        self.is_byte = np.array([t == _BYTE for t in self.types])
        self.numbers = Numbers({p: _packed([(i, len(p))]) for p, (i, _) in self.ids.items()}, self.bytes, self.unknown)
        self.seen = Seen(self.packed)
        self.number_of = np.array([i | min(len(p), 255) << 24 for i, p in enumerate(self.pieces)], np.uint32)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for piece, (i, _) in self.ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        # Every way to put a piece together from two, by both ids: its rank and its id.
        pairs = sorted((self.ids[p[:k]][0] * len(self.pieces) + self.ids[p[k:]][0], self.order[p], i)
                       for p, (i, _) in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.pair, self.pair_rank, self.pair_piece = (np.array([x[k] for x in pairs] or [-1], kind) for k, kind in enumerate((np.int64, np.int32, np.int32)))

    # Normalisation

    def normalised(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text, and for each of its characters and the end the byte of the text where what it stands for begins;
        None if only spaces were replaced and one put in front."""
        if not text:
            return "", np.zeros(1, np.int32)
        if self.map.starts is None and not self.trimmed:
            text = text.replace(" ", _SPACE) if self.escaped else text
            return (_SPACE if self.escaped else " ") * self.prefix + text, None
        out, lengths = [], []
        for new, taken in self.map.replaced(text):
            if taken > 0:  # copied: a character at a time
                out.append(new)
                lengths.append(np.ones(taken, np.int32))
            else:  # the first character of an entry's replacement stands for all of it, and those behind it begin there too
                out.append(new)
                lengths.append((new, -taken))
        begins, at = [], 0
        edges = _edges(text)
        for some in lengths:
            if isinstance(some, tuple):
                begins.append(np.full(len(some[0]), edges[at], np.int32))
                at += some[1]
            else:
                begins.append(edges[at:at + len(some)])
                at += len(some)
        whole, begin = "".join(out), np.concatenate([*begins, edges[-1:]])
        if self.trimmed:
            # Runs of spaces become one, those at both ends none (at the end also characters that look like an escaped space).
            code = np.array([c == " " for c in whole], bool)
            stay = ~code | np.concatenate([[False], ~code[:-1]])[: len(code)]
            kept = len(whole.rstrip(" " + _SPACE * self.escaped))
            stay[kept:] = False
            end = begin[kept]
            whole = "".join(c for c, s in zip(whole, stay, strict=True) if s)
            begin = np.append(begin[:-1][stay], end)
            if not whole:
                return "", begin[-1:]
        space = _SPACE if self.escaped else " "
        if self.escaped:
            whole = whole.replace(" ", _SPACE)
        return (space + whole, np.concatenate([begin[:1], begin])) if self.prefix else (whole, begin)

    # Encoding

    def merged(self, word: str) -> list[str]:
        """Merge the best-scored pair of neighbours, the leftmost of equals, until none is a piece."""
        if self.unused or len(word) > _LONGEST_KEPT:
            return self._merged_long(word)
        part, none, order = list(word), self.last, self.order.get
        ranks = [order(a + b, none) for a, b in zip(part, part[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            part[i] += part.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = order(part[i] + part[i + 1], none)
            if i:
                ranks[i - 1] = order(part[i - 1] + part[i], none)
        return part

    def _merged_long(self, word: str) -> list[str]:
        """The same with a queue of pairs, for unbroken runs of any length; pieces that are not to be used are taken apart again."""
        part, n = list(word), len(word)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[int, int, int, str]] = []
        splits: dict[str, tuple[str, str]] = {}

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (rank := self.order.get(both := part[i] + part[j])) is not None:
                heapq.heappush(queue, (rank, i, j, both))
                if both in self.unused:
                    splits[both] = part[i], part[j]

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if not part[i] or not part[j] or after[i] != j or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])

        def whole(p: str) -> list[str]:
            return [x for half in splits[p] for x in whole(half)] if p in splits else [p]

        return [x for p in part if p for x in whole(p)]

    def _neighbours(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that two pieces make; the rank is the last where there is none."""
        key = a.astype(np.int64) * len(self.pieces) + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (a >= 0) & (b >= 0), self.pair_rank[at], np.int32(self.last)), self.pair_piece[at]

    def learn(self, words: set[str]) -> None:
        """Merge many words at once, one merge a word and step, and keep them. What is rare here (very long runs, characters that
        are no piece, models with pieces that are not to be used) is left to `merged`."""
        order = sorted((w for w in words if len(w) <= _LONGEST_KEPT), key=len) if not self.unused else []
        for start in range(0, len(order), _TOGETHER):
            some = order[start:start + _TOGETHER]
            n = np.array([len(w) for w in some])
            width = int(n[-1])
            inside = np.arange(width) < n[:, None]
            piece = np.full((len(some), width), -1, np.int32)
            piece[inside] = self.symbol_of[np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)]
            which = np.flatnonzero(((piece >= 0) | ~inside).all(axis=1))
            piece, n = piece[which], n[which]
            rank, into = self._neighbours(piece[:, :-1], piece[:, 1:])
            while len(which):
                j = rank.argmin(axis=1) if width > 1 else np.zeros(len(which), np.int64)
                live = rank[np.arange(len(which)), j] < self.last if width > 1 else np.zeros(len(which), bool)
                for row, k, size in zip(self.number_of[piece[~live]], which[~live].tolist(), n[~live].tolist(), strict=True):
                    self.seen[some[k]] = row[:size].tobytes()
                which, n, j, piece, rank, into = which[live], n[live] - 1, j[live], piece[live], rank[live], into[live]
                every, column = np.arange(len(which)), np.arange(width)
                piece[every, j] = into[every, j]
                piece = piece[column != j[:, None] + 1].reshape(len(which), width - 1)
                stay = column[:-1] != j[:, None]
                rank, into = rank[stay].reshape(len(which), width - 2) if width > 1 else rank, into[stay].reshape(len(which), width - 2) if width > 1 else into
                width -= 1
                for rows, left in ((np.flatnonzero(j < width - 1), 0), (np.flatnonzero(j > 0), 1)):
                    at = j[rows] - left
                    rank[rows, at], into[rows, at] = self._neighbours(piece[rows, at], piece[rows, at + 1])

    def packed(self, word: str) -> bytes:
        """The ids of a word with how many characters each takes above them, as unsigned 32-bit numbers."""
        return b"".join(map(self.numbers.__getitem__, self.merged(word)))

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text, and the bytes where their spans begin, with the end of the last behind them: spans follow each
        other."""
        read = [data.decode("utf-8", "cutline-one-by-one") for data in texts]
        normal = [self.normalised(text) for text in read]
        words = [_WORDS.findall(whole) if self.by_words else [whole] * bool(whole) for whole, _ in normal]
        distinct = set().union(*words)
        self.seen.make_room(len(distinct))
        self.learn({w for w in distinct if w not in self.seen and w not in self.seen.older})
        return [self._spans(data, text, some, begin) for data, text, some, (_, begin) in zip(texts, read, words, normal, strict=True)]

    def _spans(self, data: bytes, text: str, words: list[str], begin: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.int32), np.zeros(1, np.int32)
        if begin is None:
            begin = _edges(text, data)
            begin = np.concatenate([begin[:1], begin]) if self.prefix else begin
        found = b"".join(map(self.seen.__getitem__, words))
        numbers = np.frombuffer(found, np.uint32)
        ids, lengths = (numbers & _ID).view(np.int32), numbers >> _LENGTH
        if not self.bytes and self.unknown in ids:  # unknown neighbours are one piece
            same = np.concatenate([[False], (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)])
            at = np.flatnonzero(~same)
            ids, lengths = ids[at], np.add.reduceat(lengths, at)
        edges = np.zeros(len(ids) + 1, np.int32)
        np.cumsum(lengths, out=edges[1:])
        return ids, begin[edges]

    # Decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: control ids say nothing, bytes are read as UTF-8 (what is none becomes U+FFFD), and the space put
        in front goes."""
        bare = self.prefix or self.trimmed
        if len(ids) and not self.is_byte[ids].any() and self.types[ids[0]] not in (_CONTROL, _UNKNOWN):
            words = list(map(self.surface.__getitem__, ids.tolist()))
            alone = 0
            while self.trimmed and alone < len(words) and words[alone] == " ":
                alone += 1
            if not alone or alone < len(words) and self.types[ids[alone]] not in (_CONTROL, _UNKNOWN):
                out = "".join(words[alone:])
                return out.removeprefix(" ") if bare else out
        # A space is dropped from the first piece that says anything, of all if such spaces are trimmed.
        out, waiting, first, seen = [], bytearray(), True, False
        for i in ids.tolist():
            if self.types[i] == _BYTE:
                waiting.append(self.of_byte[i])
                continue
            if waiting:
                out.append(bytes(waiting).decode("utf-8", "cutline-one-by-one"))
                waiting.clear()
            if seen or any(out):
                first = False
            surface = self.surface[i]
            seen = False
            if first and bare and self.types[i] not in (_CONTROL, _UNKNOWN) and surface.startswith(" "):
                surface, seen = surface[1:], not self.trimmed
            out.append(surface)
        return "".join(out) + bytes(waiting).decode("utf-8", "cutline-one-by-one")


_WORDS = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")


def _edges(text: str, data: bytes | None = None) -> np.ndarray:
    """Where each character of a text begins in its bytes, and the end. A character that replaces a wrong byte takes one."""
    data = text.encode() if data is None else data
    if len(data) == len(text):
        return np.arange(len(data) + 1, dtype=np.int32)
    found = np.flatnonzero(np.frombuffer(data, np.int8) >= -64)  # all but the later bytes of a character
    if len(found) == len(text):
        return np.append(found, len(data)).astype(np.int32)
    # Wrong bytes: measure characters one by one.
    out, at = [], 0
    for c in text:
        out.append(at)
        at += len(c.encode()) if data.startswith(c.encode(), at) else 1
    return np.array([*out, at], np.int32)


class Model:
    """A model file, sent to the executors once."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            content = file.read()
        if len(content) > _LARGEST_MODEL:
            raise ValueError(f"{path} is larger than {_LARGEST_MODEL} bytes")
        self.shared: Broadcast = spark.sparkContext.broadcast((hashlib.sha256(content).hexdigest(), content))


def _codec(shared: Broadcast) -> Codec:
    name, content = shared.value
    if name not in _loaded:
        _loaded[name] = Codec(content)
    return _loaded[name]


_ENCODED = T.StructType([T.StructField("id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("edges", T.ArrayType(T.IntegerType()))])


def _by_size(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about _BATCH_BYTES of a column; a longer value is a part of its own."""
    values = batch.column(column)
    wide = pa.types.is_large_list(values.type) or pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    edges = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    unit = 4 if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else 1
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(edges, edges[start] + _BATCH_BYTES // unit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def encode(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", end: bool = False) -> DataFrame:
    """id, ids and edges, one row per document: piece i stands for the bytes edges[i] to edges[i + 1] of the text, so there is one
    edge more than ids. With `end` the end id is last; its span is empty. Whole texts are read; rows leave Python in parts of
    bounded size."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    shared = model.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        last = np.array([codec.end] * end, np.int32)
        for whole in batches:
            for batch in _by_size(whole, "text"):
                ids, edges = [], []
                for found, spans in codec.encode(utf8(batch.column("text"))):
                    ids += [found, last]
                    edges += [spans, spans[-1:]] if end else [spans]
                sizes = np.add.reduceat([len(x) for x in ids], np.arange(0, len(ids), 2))
                flat = np.concatenate(ids), np.concatenate(edges)
                columns = [lists(x, np.concatenate([[0], np.cumsum(sizes + more)]), pa.int32()) for more, x in enumerate(flat)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=_ENCODED.fieldNames())

    return docs.mapInArrow(run, _ENCODED)


_DECODED = T.StructType([T.StructField("id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """id, ids and the text that the ids stand for."""
    shared = model.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for whole in batches:
            for batch in _by_size(whole, "ids"):
                column = batch.column("ids")
                flat, edges = column.values.to_numpy(), column.offsets.to_numpy()
                texts = [codec.decode(flat[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists(flat[edges[0]:edges[-1]], edges - edges[0], pa.int32()), pa.array(texts, pa.string())], names=_DECODED.fieldNames())

    return encoded.select("id", "ids").mapInArrow(run, _DECODED)


def digests(encoded: DataFrame, model: Model) -> DataFrame:
    """doc_id, the number of ids, the digest of the ids and that of the text they are decoded to."""
    return decode(encoded, model).select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
