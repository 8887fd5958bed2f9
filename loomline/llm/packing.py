"""Packing along a space-filling curve.

1. Every whole text is encoded; a document's vector, its hashed token counts, is projected to DIMENSIONS numbers, and their
   cell on a Hilbert curve is the document's key: documents with like words get near keys.
2. Documents are range-partitioned and sorted by (key, id), so equal texts lie together and a key that many share is still split.
3. Each partition cuts its run of tokens into sequences of `limit` tokens; what is left at its end is cut into sequences whose
   lengths are powers of two. So nothing is padded, and no total has to be known.

Ids are those of the library with add_special_tokens=False: a special token's own string in a text, as "<|endoftext|>", is that token.

A null text is empty: one end token only. Repeated rows are packed each. A null key is packed too. An empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import vocabulary
from .common import CACHE_ENTRIES, batch, buckets, kept, key_columns, mixed, scoped, written

LIMIT = 4096
DIMENSIONS, BITS = 4, 8

#: What the vocabulary's own splitter takes as one piece, in texts of the plain alphabet below.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: ASCII and Latin letters: normal forms keep these as they are, whatever stands beside them.
PLAIN = regex.compile("[!-~À-ÖØ-öø-įı-ſ]+")


#: Bytes of a text whose words are looked up at once, bytes of a column for which that is so, and pieces that one call of the tokenizer encodes.
SEGMENT, COLUMN, CALL = 1 << 20, 1 << 24, 4096
_SPACE = re.compile(rb"[ \t-\r]")


class WordEncoder:
    """Ids of whole texts by a `tokenizers` vocabulary that drops white space; encodings between white space are cached, and
    what the caches lack is given to the tokenizer many pieces at a time."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        #: Strings that are tokens as they stand, in small letters. Words that may hold one are encoded whole, as they are.
        self.added = sorted({t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.spaced = any(len(x.split()) != 1 or x != x.strip() for x in self.added)
        #: Ids of words and of their pieces: those of late, and the generation before them.
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        #: Words of the texts at hand that hold a token's own string.
        self.whole: set[bytes] = set()

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit integers of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        group, size = [], 0
        for i, text in enumerate(texts):
            if self.spaced and any(x in text.lower().encode("utf-8", "replace") for x in self.added):
                out[i].append(self._whole(text))
                continue
            for part in self._segments(text.encode("utf-8", "replace")):
                group.append((i, self._split(part)))
                size += len(part)
                if size >= SEGMENT:
                    self._flush(group, out)
                    group, size = [], 0
        self._flush(group, out)
        return [b"".join(x) for x in out]

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """encode_many() of a column without nulls. Texts up to a segment are split by Arrow, and each different word of a few of them is looked up once; long texts and
        those with combining marks or a token's own string take the other way."""
        out: list[bytes] = []
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        groups = np.cumsum(sizes) // COLUMN
        edges = [*np.flatnonzero(np.diff(groups, prepend=-1)).tolist(), len(texts)]
        for start, stop in zip(edges, edges[1:]):
            some = texts.slice(start, stop - start)
            low = pc.ascii_lower(some)
            slow = pc.or_(pc.match_substring_regex(some, "[\u0300-\u037f]"), pc.greater(pc.binary_length(some), SEGMENT))
            for x in self.added:
                slow = pc.or_(slow, pc.match_substring(low, x.decode()))
            plain = pc.invert(slow)
            words = pc.ascii_split_whitespace(low.filter(plain))
            coded = words.flatten().dictionary_encode()
            known = coded.dictionary.cast(pa.binary()).to_pylist()
            self._know(known)
            ids = pa.array(map(self.words.__getitem__, known), pa.large_binary(), size=len(known)).take(coded.indices)
            at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
            ends = at[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist() if len(words) else [0]
            data = memoryview(ids.buffers()[2]) if len(ids) and ids.buffers()[2] else b""
            found = [bytes(data[i:j]) for i, j in zip(ends, ends[1:])]
            if len(found) < len(some):
                slow_at = np.flatnonzero(slow.to_numpy(zero_copy_only=False)).tolist()
                for k, ids_of in zip(slow_at, self.encode_many([some[k].as_py() for k in slow_at])):
                    found.insert(k, ids_of)
            out += found
        return out

    @staticmethod
    def _segments(data: bytes) -> Iterator[bytes]:
        start = 0
        while len(data) - start > SEGMENT and (found := _SPACE.search(data, start + SEGMENT)):
            yield data[start : found.start()]
            start = found.start()
        yield data[start:]

    def _split(self, data: bytes) -> list[bytes]:
        """Words, in small letters unless they have combining marks, which could make one letter with a small one only, or a token's own string."""
        low = data.lower()
        own = [x for x in self.added if x in low]
        if own or b"\xcc" in data or b"\xcd" in data:
            words = [w if b"\xcc" in w or b"\xcd" in w or any(x in w.lower() for x in own) else w.lower() for w in data.split()]
            self.whole.update(w for w in set(words) if any(x in w.lower() for x in own))
            return words
        return low.split()

    def _know(self, words: Iterable[bytes]) -> None:
        """Let self.words have these, at least."""
        if len(self.words) >= CACHE_ENTRIES:
            self.before, self.words = self.words, {}
        self._learn(list(self._lacking(set(words))))
        self.whole.clear()

    def _lacking(self, keys: set[bytes]) -> set[bytes]:
        """Those of the keys that are not cached; what the generation before has, self.words takes over."""
        keys = keys.difference(self.words)
        held = self.before.keys() & keys
        self.words.update(zip(held, map(self.before.__getitem__, held)))
        return keys.difference(held)

    def _flush(self, group: list, out: list[list[bytes]]) -> None:
        self._know(set().union(*(words for _, words in group)))
        for i, words in group:
            out[i].append(b"".join(map(self.words.__getitem__, words)))

    def _learn(self, words: list[bytes]) -> None:
        """Most words are letters, which are one piece, or letters and one sign: these take no step of Python for each piece."""
        lacking, ended, heads, ends, several, parts = [], [], [], [], [], []
        # Words hold no space.
        for word, text in zip(words, b" ".join(words).decode().split(" ") if words else ()):
            if word in self.whole or not (text.isprintable() if text.isascii() else PLAIN.fullmatch(text)):
                self.words[word] = self._whole(text)
            elif text.isalpha():
                lacking.append(word)
            elif text[:-1].isalpha():
                ended.append(word)
                heads.append(word[:-1])
                ends.append(word[-1:])
            else:
                several.append(word)
                parts.append([x.encode() for x in PIECE.findall(text)])
        todo = sorted(self._lacking(set(lacking).union(heads, ends, *parts)))
        for at in range(0, len(todo), CALL):
            self._bulk(todo[at : at + CALL])
        ids = self.words.__getitem__
        self.words.update(zip(ended, map(add, map(ids, heads), map(ids, ends))))
        self.words.update([(word, b"".join(map(ids, x))) for word, x in zip(several, parts) if x != [word]])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _bulk(self, pieces: list[bytes]) -> None:
        """Pieces with spaces between them are the tokenizer's words, one by one."""
        found = self.tokenizer.encode(b" ".join(pieces).decode(), add_special_tokens=False)
        owner = np.array(found.word_ids)
        starts = np.searchsorted(owner, np.arange(len(pieces) + 1))
        if len(owner) and owner[-1] == len(pieces) - 1 and (np.diff(starts) > 0).all():
            data = np.array(found.ids, "<u4").tobytes()
            at = (4 * starts).tolist()
            self.words.update([(x, data[i:j]) for x, i, j in zip(pieces, at, at[1:])])
        else:
            self.words.update([(x, self._whole(x.decode())) for x in pieces])


def word_encoder(data: bytes) -> WordEncoder:
    """The worker's encoder for a vocabulary file: tasks that follow each other in a worker share its caches, whose size is bounded. One vocabulary at a time."""
    return kept(("word encoder", xxhash.xxh3_128_digest(data)), lambda: WordEncoder(data))


def directions(ids: int) -> np.ndarray:
    """For each id, DIMENSIONS signs from a hash of it."""
    bits = mixed(np.arange(1, ids + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([1.0 - 2.0 * ((bits >> np.uint64(k)) & np.uint64(1)) for k in range(DIMENSIONS)], 1).astype(np.float32)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell coordinates (below 2**bits): undo the curve's turns from the coarsest level on, then
    interleave the coordinates' bits in Gray code order."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        low = q - one
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        flip ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key.astype(np.int64)


def cells(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean directions, spread over the grid."""
    mean = sums / np.maximum(counts, 1)[:, None]
    return np.minimum((0.5 + 0.5 * np.tanh(4 * mean)) * (1 << BITS), (1 << BITS) - 1).astype(np.uint64)


PLACED = "hkey long, doc_id long, ids binary"


def placed(docs: DataFrame, path: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Curve key and ids (end id included; 16 bits each where all fit) of every document."""
    data = vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(data.value)
        size = encoder.tokenizer.get_vocab_size()
        toward, narrow = directions(size), np.dtype("<u2" if size <= 1 << 16 else "<u4")
        last = np.array([end], "<u4")
        for rows in batches:
            out, sums, counts = [], [], []
            for coded in encoder.encode_column(rows.column(1)):
                ids = np.frombuffer(coded, "<u4")
                total = np.zeros(DIMENSIONS, np.float64)
                for at in range(0, len(ids), 1 << 16):
                    total += toward[ids[at : at + (1 << 16)]].sum(0)
                sums.append(total)
                counts.append(len(ids))
                out.append(np.concatenate([ids, last]).astype(narrow).tobytes())
            if out:
                yield batch(PLACED, hkey=hilbert(cells(np.array(sums), np.array(counts))), doc_id=rows.column(0), ids=out)

    return key_columns(docs, key, text).mapInArrow(run, PLACED)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Sequences:
    """Cuts a run of documents into sequences; holds the open sequence only."""

    def __init__(self, limit: int, first: int):
        self.limit, self.next, self.open, self.filled = limit, first, [], 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(self.limit - self.filled, len(ids) - at)
            self.open.append((doc_id, at, ids[at : at + n], len(ids)))
            self.filled += n
            at += n
            if self.filled == self.limit:
                self._close(self.open)
                self.open, self.filled = [], 0

    def end(self) -> None:
        """What is open goes into sequences of power-of-two lengths, longest first."""
        left, self.open = self.open[::-1], []
        while self.filled:
            size, held, got = 1 << (self.filled.bit_length() - 1), [], 0
            while got < size:
                doc_id, start, ids, total = left.pop()
                n = min(size - got, len(ids))
                held.append((doc_id, start, ids[:n], total))
                if n < len(ids):
                    left.append((doc_id, start + n, ids[n:], total))
                got += n
            self._close(held)
            self.filled -= size

    def _close(self, held: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in held:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * 7
        self.rows = []
        return batch(PIECES, **dict(zip((f.split()[0] for f in PIECES.split(", ")), map(list, columns))))


@scoped
def pack(docs: DataFrame, path: str, end: int = 2, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    import json

    with open(path, encoding="utf-8") as f:
        wide = len(json.load(f)["model"]["vocab"]) > (1 << 16)
    sorted_docs = written(placed(docs, path, end, key, text), "placed").repartitionByRange(buckets(docs), "hkey", "doc_id").sortWithinPartitions("hkey", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = _Sequences(limit, TaskContext.get().partitionId() << 32)
        for rows in batches:
            for doc_id, ids in zip(rows.column(1).to_pylist(), rows.column(2)):
                sequences.add(doc_id, np.frombuffer(ids.as_py(), "<u4" if wide else "<u2"))
            yield sequences.taken()
        sequences.end()
        yield sequences.taken()

    return sorted_docs.mapInArrow(run, PIECES)
