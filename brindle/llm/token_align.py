"""Alignment of two tokenizers: documents cut into groups of tokens that cover the same bytes, and how often ids of both meet."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._staging import bound_batches, staged
from ._words import rows

#: Fixed value: how byte-level BPE vocabularies of this kind split a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The regular expression above needs a stack in proportion to runs of blanks; longer runs go to the slower encoder.
LONG_BLANK = re.compile(r"\s{1000}")


@dataclass(frozen=True)
class Tokenizers:
    """a: a byte-level BPE file of the tokenizers library; b: a sentencepiece model with byte fallback. The files lie at
    these paths on every executor. hot: how many of the commonest short groups are sent to executors with their sums
    (about 40 bytes each); the others are joined."""

    a: str = "/opt/tokenizers/byte_bpe_50k.json"
    b: str = "/opt/tokenizers/piece_bpe_32k.model"
    hot: int = 200_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 for itself, then from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def strung(values: pa.Array, at: np.ndarray) -> bytes:
    """The values at these places one behind the other: what Arrow lays out for them."""
    data = values.take(pa.array(at)).buffers()[2]
    return data.to_pybytes() if data else b""


@dataclass
class Pair:
    """Both tokenizers, the bytes of their tokens and the texts of their ids. One for each Python worker."""

    how: Tokenizers
    lengths_a: np.ndarray = field(init=False)
    lengths_b: np.ndarray = field(init=False)

    def __post_init__(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(self.how.a)
        self.slow.encode_special_tokens = True
        special = set(self.slow.get_added_tokens_decoder())
        letters = byte_letters()
        size = self.slow.get_vocab_size()
        self.bytes_a = [b"" if i in special else bytes(letters[c] for c in self.slow.id_to_token(i)) for i in range(size)]
        ranks = {raw: i for i, raw in enumerate(self.bytes_a) if i not in special}
        self.fast = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=self.how.b)
        n = self.pieces.get_piece_size()
        if size > 1 << 16 or n > 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        self.bytes_b = [self._piece(i) for i in range(n)]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in b], dtype=np.int64) for b in (self.bytes_a, self.bytes_b))
        ids_a, ids_b = [str(i) for i in range(size)], [str(i) for i in range(n)]
        self.spelt = pa.array([i + "," for i in ids_a] + [i + "|" for i in ids_a] + [i + "," for i in ids_b] + [i + ";" for i in ids_b], pa.large_string())
        self.raw_a, self.raw_b = (pa.array(b, pa.large_binary()) for b in (self.bytes_a, self.bytes_b))

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return b"" if self.pieces.is_control(i) or self.pieces.is_unknown(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """A's ids of a space and text and B's of text; None unless both give back the bytes of a space and text."""
        whole = " " + text
        a = self.slow.encode_batch_fast([whole], add_special_tokens=False)[0].ids if LONG_BLANK.search(whole) else self.fast.encode_ordinary(whole)
        a, b = np.array(a, np.uint16), np.array(self.pieces.encode(text, num_threads=1), np.uint16)
        raw = whole.encode()
        return (a, b) if strung(self.raw_a, a) == raw and strung(self.raw_b, b) == raw else None

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the groups, counted in tokens of A and of B. Texts may be strung together."""
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        at = np.searchsorted(ends_b, ends_a)
        both = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a if len(b) else np.zeros(len(a), bool)
        return np.flatnonzero(both) + 1, at[both] + 1

    def spell(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
        """`a1,a2|b1;a3|b2,b3`."""
        shift_b = 2 * len(self.bytes_a)
        ids_a, ids_b = a.astype(np.int32), b.astype(np.int32) + np.int32(shift_b)
        ids_a[ends_a - 1] += len(self.bytes_a)
        ids_b[ends_b - 1] += len(self.bytes_b)
        size_a, size_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        out = np.empty(len(a) + len(b), np.int32)
        out[np.arange(len(a)) + np.repeat(ends_b - size_b, size_a)] = ids_a
        out[np.arange(len(b)) + np.repeat(ends_a, size_b)] = ids_b
        return strung(self.spelt, out)[:-1]

    def links(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The pairs of tokens of one group whose bytes overlap: n_a + n_b - 1, as no inner ends meet."""
        ends_a, ends_b = np.cumsum(self.lengths_a[a]).tolist(), np.cumsum(self.lengths_b[b]).tolist()
        i = j = 0
        out = []
        while i < len(a) and j < len(b):
            out.append((int(a[i]), int(b[j])))
            if ends_a[i] <= ends_b[j]:
                i += 1
            else:
                j += 1
        return out


_PAIRS: dict[Tokenizers, Pair] = {}


def pair_of(how: Tokenizers) -> Pair:
    if how not in _PAIRS:
        _PAIRS[how] = Pair(how)
    return _PAIRS[how]


def pack(a: np.ndarray, b: np.ndarray) -> bytes:
    """A group's key: how many ids of A as 32 bits, then the ids of A and of B as 16 bits each."""
    return np.uint32(len(a)).tobytes() + a.tobytes() + b.tobytes()


def unpack(key: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(key[:4], "little")
    ids = np.frombuffer(key, np.uint16, offset=4)
    return ids[:n], ids[n:]


#: Groups of up to so many ids are worked on as 64-bit values, by shape.
SHORT = 4


def by_shape(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> Iterator[tuple[tuple[int, int] | None, np.ndarray, np.ndarray | list[bytes]]]:
    """(shape, places of its groups, their ids packed into 64 bits) for short shapes; (None, places, keys) for the others."""
    size_a, size_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    start_a, start_b = ends_a - size_a, ends_b - size_b
    for x in range(1, SHORT):
        for y in range(1, SHORT + 1 - x):
            at = np.flatnonzero((size_a == x) & (size_b == y))
            if len(at):
                packed = np.zeros(len(at), np.uint64)
                for ids, start, n in ((a, start_a, x), (b, start_b, y)):
                    for k in range(n):
                        packed = (packed << np.uint64(16)) | ids[start[at] + k].astype(np.uint64)
                yield (x, y), at, packed
    at = np.flatnonzero(size_a + size_b > SHORT)
    if len(at):
        yield None, at, [pack(a[start_a[g] : ends_a[g]], b[start_b[g] : ends_b[g]]) for g in at.tolist()]


def keys_of(shape: tuple[int, int], packed: np.ndarray) -> pa.Array:
    """The binary keys of packed groups."""
    n = sum(shape)
    raw = np.empty((len(packed), 2 + n), np.uint16)
    raw[:, 0], raw[:, 1] = shape[0], 0
    for k in range(n):
        raw[:, 2 + k] = (packed >> np.uint64(16 * (n - 1 - k))).astype(np.uint16)
    return pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer((np.arange(len(packed) + 1) * 2 * (2 + n)).astype(np.int32)), pa.py_buffer(raw)])


TOKENS = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, a binary, b binary"


def _tokenize(how: Tokenizers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(how)
        for part in rows(batches, "row", "doc_id", "text", size=64):
            out = []
            for row, doc_id, text in part:
                found = pair.encode(text) if text else None
                if found is None:
                    out.append((row, doc_id, 0, 0, 0, "", b"", b""))
                else:
                    ends = pair.groups(*found)
                    digest = hashlib.sha256(pair.spell(*found, *ends)).hexdigest()
                    out.append((row, doc_id, len(found[0]), len(found[1]), len(ends[0]), digest, found[0].tobytes(), found[1].tobytes()))
            types = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in TOKENS.split(", ")])

    return run


def _strung(batches: Iterator[pa.RecordBatch], how: Tokenizers, most: int = 1_000_000) -> Iterator[tuple]:
    """Rows, the end of each in tokens of A, and tokens and group ends of texts strung together, up to `most` tokens of A or one text."""
    pair = pair_of(how)

    def joined(held):
        a, b = (np.frombuffer(b"".join(x[i] for x in held), np.uint16) for i in (1, 2))
        return np.array([x[0] for x in held], np.int64), np.cumsum([len(x[1]) // 2 for x in held]), a, b, *pair.groups(a, b)

    held, size = [], 0
    for part in rows(batches, "row", "a", "b"):
        for row, a, b in part:
            if held and size + len(a) // 2 > most:
                yield joined(held)
                held, size = [], 0
            if a:
                held.append((row, a, b))
                size += len(a) // 2
    if held:
        yield joined(held)


def _distinct(how: Tokenizers):
    """(key, n): the distinct groups of some texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, a, b, ends_a, ends_b in _strung(batches, how):
            for shape, _, keys in by_shape(a, b, ends_a, ends_b):
                if shape:
                    packed, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([keys_of(shape, packed), pa.array(n, pa.int64())], ["key", "n"])
                else:
                    counted = Counter(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], ["key", "n"])

    return run


def _expand(how: Tokenizers):
    """(id, a, b, n, m): each distinct group's links once, m times within the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(how)
        for part in rows(batches, "id", "key", "n", size=4096):
            out = []
            for i, key, n in part:
                found = Counter(pair.links(*unpack(key)))
                out.extend((i, a, b, n, m) for (a, b), m in found.items())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["id", "a", "b", "n", "m"])

    return run


def _hot_groups(sums: DataFrame, most: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The commonest short groups, at most `most`: by shape their packed ids in order, and their sums."""
    level = F.floor(16 * F.log2("n")).cast("int")
    short = sums.where(F.length("key") <= 4 + 2 * SHORT)
    left, least = most, None
    for r in sorted(short.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):  # at most 16 * 63 rows
        left -= r["count"]
        if left < 0:
            break
        least = r.level
    out = {}
    if least is not None:
        found = short.where(level >= least).select("key", "best", "total").toArrow()
        keys, best, total = found.column("key").to_pylist(), found.column("best").to_numpy(), found.column("total").to_numpy()
        shapes: dict[tuple[int, int], list[int]] = {}
        for i, key in enumerate(keys):
            n = int.from_bytes(key[:4], "little")
            shapes.setdefault((n, (len(key) - 4) // 2 - n), []).append(i)
        for shape, at in shapes.items():
            packed = np.zeros(len(at), np.uint64)
            ids = np.frombuffer(b"".join(keys[i][4:] for i in at), np.uint16).reshape(len(at), -1)
            for k in range(ids.shape[1]):
                packed = (packed << np.uint64(16)) | ids[:, k].astype(np.uint64)
            order = np.argsort(packed)
            out[shape] = (packed[order], best[at][order], total[at][order])
    return out


def _resolve(how: Tokenizers, hot):
    """(row, key, n, best, total): for each text a row without key, the sums of its hot groups, and a row for each other
    distinct group with how often it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ends, a, b, ends_a, ends_b in _strung(batches, how):
            text_of = np.searchsorted(ends, ends_a)  # of each group
            best, total = np.zeros(len(ends_a), np.int64), np.zeros(len(ends_a), np.int64)
            names = ["row", "key", "n", "best", "total"]
            for shape, at, keys in by_shape(a, b, ends_a, ends_b):
                if shape:
                    known, known_best, known_total = hot.value.get(shape, (np.zeros(0, np.uint64),) * 3)
                    place = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                    hit = known[place] == keys if len(known) else np.zeros(len(keys), bool)
                    best[at[hit]], total[at[hit]] = known_best[place[hit]], known_total[place[hit]]
                    text, rest = text_of[at[~hit]], keys[~hit]
                    order = np.lexsort((rest, text))
                    text, rest = text[order], rest[order]
                    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (rest[1:] != rest[:-1])))) if len(rest) else np.zeros(0, np.int64)
                    text, n, key = text[new], np.diff(new, append=len(rest)), keys_of(shape, rest[new])
                else:
                    counted = Counter(zip(text_of[at].tolist(), keys, strict=True))
                    text, n, key = np.array([t for t, _ in counted], np.int64), np.array(list(counted.values())), pa.array([k for _, k in counted], pa.binary())
                if len(text):
                    none = pa.nulls(len(text), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[text]), key, pa.array(n, pa.int64()), none, none], names)
            first = np.searchsorted(text_of, np.arange(len(ids)))
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.binary()), none, pa.array(np.add.reduceat(best, first)), pa.array(np.add.reduceat(total, first))], names)

    return run


def align(docs: DataFrame, how: Tokenizers = Tokenizers(), id_col: str = "doc_id", text_col: str = "text") -> dict[str, DataFrame]:
    """The staged tables of an alignment.

    tokens: row, doc_id, n_a, n_b, n_groups, groups_sha256, a, b (ids as 16-bit values), a row per document.
    groups: id, key, n, each distinct group once with how often it stands in all documents; unpack() reads a key.
    pairs: a, b, n, best, the id pairs that any link holds, in how many links, and whether no A id has more with that b.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = staged(texts.mapInArrow(_tokenize(how), TOKENS), "tokens", "zstd")
    groups = tokens.where("n_groups > 0").select("row", "a", "b").mapInArrow(_distinct(how), "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    groups = staged(groups.select(F.monotonically_increasing_id().alias("id"), "key", "n"), "groups")
    counted = staged(links_of(groups, how).groupBy("a", "b").agg(F.sum(F.col("n") * F.col("m")).alias("n")), "counted")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    pairs = staged(counted.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    return {"tokens": tokens, "groups": groups, "pairs": pairs}


def links_of(groups: DataFrame, how: Tokenizers = Tokenizers()) -> DataFrame:
    """(id, a, b, n, m) of align's groups: the id pairs that overlap in each, m times."""
    return groups.mapInArrow(_expand(how), "id long, a int, b int, n long, m long")


def align_documents(docs: DataFrame, how: Tokenizers = Tokenizers(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs.

    A encodes a space and the text, B the text, to which it adds a space; special tokens in a text are plain text. Byte
    places where tokens of both end cut the tokens into groups. Every A token and B token whose bytes overlap are a
    link; an id pair's count is the number of links of all documents that hold it. n_best: links whose count is the
    highest of their B id, ties included; count_sum: the sum of the counts of the document's links.

    1. Documents are encoded once, ids staged. 2. Distinct groups are interned with their frequency, combined before
    the shuffle. 3. A group's links are expanded once, whatever its frequency, and counted with it. 4. The counts are
    joined back to the groups' links and summed by group, 5. the groups' sums to the documents: those of the commonest
    short groups, at most how.hot, are sent to executors, so that a group in a third of all places isn't shuffled; all
    others go by a join on the group's key. Links are never expanded by document: a document has n_a + n_b - n_groups.

    Texts null or empty, or of which either tokenizer doesn't give back every byte (B normalises some), have no tokens:
    zeros and an empty groups_sha256. Each row of a repeated id is a document. A null id stays null. An empty table
    gives no rows. Other columns are ignored. A text is worked on whole, with some 100 bytes for each of its own.
    """
    found = align(docs, how, id_col, text_col)
    spark, tokens, groups, pairs = docs.sparkSession, found["tokens"], found["groups"], found["pairs"]
    met = links_of(groups, how).join(pairs.select("a", "b", F.col("n").alias("count"), "best"), ["a", "b"])
    sums = met.groupBy("id").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("best"), F.sum(F.col("m") * F.col("count")).alias("total"))
    sums = staged(groups.join(sums, "id").select("key", "n", "best", "total"), "sums")
    hot = spark.sparkContext.broadcast(_hot_groups(sums, how.hot))
    parts = tokens.where("n_groups > 0").select("row", "a", "b").mapInArrow(_resolve(how, hot), "row long, key binary, n long, best long, total long")
    parts = staged(parts, "parts")
    values = sums.select("key", F.col("best").alias("_best"), F.col("total").alias("_total"))
    rest = parts.where("key is not null").select("row", "key", "n").join(values, "key").select("row", (F.col("n") * F.col("_best")).alias("best"), (F.col("n") * F.col("_total")).alias("total"))
    each = parts.where("key is null").select("row", "best", "total").unionByName(rest).groupBy("row").agg(F.sum("best").alias("best"), F.sum("total").alias("total"))
    out = tokens.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(each, "row", "left")
    none = F.lit(0).cast("long")
    return out.select(
        F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"),
        F.coalesce("best", none).alias("n_best"), F.coalesce("total", none).alias("count_sum"), "groups_sha256",
    )
