"""Byte-level BPE by prefix dynamic programming.

The BPE encoding of a byte string has one last token, and dropping that token leaves the BPE encoding of the
shorter prefix. So one token id per prefix is enough: last[i] is the last token of the encoding of the first i
bytes. It is the token t ending at i for which (last[i - len(t)], t) may stand side by side, that is for which
no merge of lower rank would have crossed their border. Appending bytes leaves all earlier entries as they are,
and after an edit the table is recomputed only until it agrees with the old one again for as many positions as the
longest token has bytes.

Nulls count as empty texts; an empty text has no ids. Texts of any length are read in segments that end at
safe places, where white space follows something else; memory follows the segment and the ids, and a run without any such place is one segment, however long.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CACHE_ENTRIES, batch, key_columns

#: Code points that one segment has at least.
SEGMENT = 1 << 16


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a tiktoken vocabulary file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class PrefixBPE:
    """Encoder and decoder for one vocabulary; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        self.halves = {rank: self._halves(token, rank) for token, rank in ranks.items()}
        self.merges = {pair: rank for rank, pair in self.halves.items() if pair[0] != rank}
        #: Finds, for each position, the tokens that end there, longest first.
        self.endings = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.endings.add_word(token.decode("latin-1"), (len(token), rank))
        self.endings.make_automaton()
        self._beside: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self)
        self.chunks = _Chunks(self)

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge made this one; a token that no merge makes is its own half."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                found = self.ranks.get(parts[i] + parts[i + 1], rank)
                if found < best:
                    best, at = found, i
            if at < 0:
                return rank, rank
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (rank, rank)

    def beside(self, left: int, right: int) -> bool:
        """Whether the two tokens may be neighbours in an encoding."""
        known = self._beside.get((left, right))
        if known is None:
            if len(self._beside) >= 4 * CACHE_ENTRIES:
                self._beside.clear()
            known = self._beside[left, right] = self._may_touch(left, right)
        return known

    def _may_touch(self, left: int, right: int) -> bool:
        """Undo the later merge on either side of the border, step by step; a merge across it with a lower rank than those undone would have come first."""
        bound = len(self.ranks) + self.longest + (1 << 30)
        while True:
            across = self.merges.get((left, right))
            if across is not None and across < bound:
                return False
            undo_left = left > right
            for _ in range(2):
                half = self.halves[left][1] if undo_left else self.halves[right][0]
                whole = left if undo_left else right
                if half != whole:
                    bound = whole if undo_left else whole + 1
                    left, right = (half, right) if undo_left else (left, half)
                    break
                undo_left = not undo_left
            else:
                return True

    def prefixes(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """last[i]: last token of the encoding of data[:i]. Entries given are kept: exact appends."""
        last = [-1] if last is None else last
        known, done = self._beside, len(last) - 1
        first = max(0, done + 1 - self.longest)
        for at, (n, token) in self.endings.iter(data.decode("latin-1"), first):
            if at < done:
                continue
            if n <= at:
                pair = (last[at + 1 - n], token)
                ok = known.get(pair)
                if not (self.beside(*pair) if ok is None else ok):
                    continue
            last.append(token)
            done += 1
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The encoding that a prefix table stands for."""
        ids, at = [], len(last) - 1
        while at:
            ids.append(last[at])
            at -= len(self.tokens[last[at]])
        return ids[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        return self.walk(self.prefixes(data))

    def segments(self, text: str) -> Iterator[bytes]:
        """Ids of a text as little-endian 32-bit integers, a segment at a time."""
        for part in safe_segments(text):
            if _LOOSE.search(part):
                yield b"".join(map(self.pieces.__getitem__, self.pattern.findall(part)))
            else:
                head, *rest = part.split(" ")
                yield b"".join([self.chunk(head), *map(self.chunks.__getitem__, rest)])

    def chunk(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.segments(text)), "<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.asarray(ids).tolist()))


class _Pieces(dict):
    """Piece of text -> its ids as bytes."""

    def __init__(self, bpe: PrefixBPE):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= 2 * CACHE_ENTRIES:
            self.clear()
        ids = np.array(self.bpe.encode_piece(piece.encode("utf-8", "replace")), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class _Chunks(dict):
    """What stands between two spaces -> the ids of the first space and it."""

    def __init__(self, bpe: PrefixBPE):
        self.bpe = bpe

    def __missing__(self, text: str) -> bytes:
        if len(self) >= 2 * CACHE_ENTRIES:
            self.clear()
        ids = self.bpe.chunk(f" {text}")
        if len(text) <= 64:
            self[text] = ids
        return ids


#: A space amid white space or at the end. Without one, every space is either after a non-space or the last of its
#: run; the pattern gives a run's last space to what follows, so each space begins a piece.
_LOOSE = re.compile(r"\s \s|\s \Z")
_BREAK = regex.compile(r"(?<=\S)(?=\s)")


def safe_segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Cuts after a non-space that a space follows: no piece of the pattern spans such a place."""
    start = 0
    while len(text) - start > size:
        found = _BREAK.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    if start < len(text):
        yield text[start:]


class EncodedText:
    """A text with the prefix tables of its pieces: exact appends, and re-encoding near edits only."""

    def __init__(self, bpe: PrefixBPE, text: str = ""):
        self.bpe, self.text = bpe, ""
        self.pieces: list[str] = []
        self.tables: list[list[int]] = []
        #: Prefix entries computed so far; shows how little an edit costs.
        self.work = 0
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, put: str) -> None:
        """Replace text[start:end]. Pieces before the last safe place and after the first common border stay."""
        old_text, text = self.text, self.text[:start] + put + self.text[end:]
        keep, at = 0, 0
        for i, piece in enumerate(self.pieces):
            if at and at < start and old_text[at].isspace() and not old_text[at - 1].isspace():
                keep, kept_at = i, at
            if at >= start:
                break
            at += len(piece)
        begin = kept_at if keep else 0
        shift = len(text) - len(old_text)
        borders, at = {}, 0
        for i, piece in enumerate(self.pieces):
            if at >= end:
                borders[at + shift] = i
            at += len(piece)
        borders[at + shift] = len(self.pieces)
        pieces, tables, at, tail = [], [], begin, len(self.pieces)
        spare = self.pieces[keep:]
        for found in self.bpe.pattern.finditer(text, begin):
            if found.start() in borders and found.start() >= start + len(put):
                tail, at = borders[found.start()], found.start()
                break
            piece, old = found.group(), None
            i = len(pieces)
            if i < len(spare):
                old = (spare[i].encode("utf-8", "replace"), self.tables[keep + i])
            pieces.append(piece)
            tables.append(self._table(piece.encode("utf-8", "replace"), old))
        self.pieces[keep:tail], self.tables[keep:tail], self.text = pieces, tables, text

    def _table(self, data: bytes, old: tuple[bytes, list[int]] | None) -> list[int]:
        """Starts from the common prefix with what stood here before, stops when the old table is met again."""
        if not old:
            self.work += len(data)
            return self.bpe.prefixes(data)
        was, table = old
        if was == data:
            return table
        same = 0
        for a, b in zip(was, data):
            if a != b:
                break
            same += 1
        tail = 0
        while tail < min(len(was), len(data)) - same and was[-1 - tail] == data[-1 - tail]:
            tail += 1
        last, shift, agreed = table[: same + 1], len(was) - len(data), 0
        while len(last) <= len(data):
            at = len(last)
            self.bpe.prefixes(data[:at], last)
            self.work += 1
            agreed = agreed + 1 if at > len(data) - tail and last[at] == table[at + shift] else 0
            if agreed >= self.bpe.longest:
                last += table[at + shift + 1 :]
        return last

    def ids(self) -> list[int]:
        return [x for table in self.tables for x in self.bpe.walk(table)]


_built: dict[tuple[bytes, str], PrefixBPE] = {}


def encoder(data: bytes, pattern: str) -> PrefixBPE:
    """The encoder of a vocabulary file, built once in each worker."""
    key = hashlib.sha256(data).digest(), pattern
    if key not in _built:
        _built[key] = PrefixBPE(read_ranks(data), pattern)
    return _built[key]


#: A vocabulary is a fixed file; a larger one is not shipped to workers.
VOCABULARY_BYTES = 64 << 20


def vocabulary(df: DataFrame, path: str):
    """The vocabulary file as a broadcast of proven size."""
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is too large to ship")
    return df.sparkSession.sparkContext.broadcast(data)


ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and digest both; one row per input row, no shuffle.

    A null text is empty: no tokens, digests of nothing. Repeated rows give repeated rows; a null key stays null.
    """
    ranks = vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks.value, pattern)
        for rows in batches:
            counts, ids_hex, bytes_hex = [], [], []
            for value in rows.column(1):
                ids_sum, bytes_sum, n = hashlib.sha256(), hashlib.sha256(), 0
                for part in bpe.segments(value.as_py()):
                    n += len(part) >> 2
                    ids_sum.update(part)
                    bytes_sum.update(bpe.decode(np.frombuffer(part, "<u4")))
                counts.append(n)
                ids_hex.append(ids_sum.hexdigest())
                bytes_hex.append(bytes_sum.hexdigest())
            yield batch(ROUND_TRIP, doc_id=rows.column(0), n_tokens=counts, ids_sha256=ids_hex, decoded_sha256=bytes_hex)

    return key_columns(docs, key, text).mapInArrow(run, ROUND_TRIP)


ENCODED = "doc_id long, n_tokens long, ids binary"


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every text as little-endian 32-bit integers."""
    ranks = vocabulary(docs, path)

    def run(batches):
        bpe = encoder(ranks.value, pattern)
        for rows in batches:
            ids = [b"".join(bpe.segments(value.as_py())) for value in rows.column(1)]
            yield batch(ENCODED, doc_id=rows.column(0), n_tokens=[len(x) >> 2 for x in ids], ids=ids)

    return key_columns(docs, key, text).mapInArrow(run, ENCODED)


DECODED = "doc_id long, data binary"


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The bytes that encode()'s ids stand for."""
    ranks = vocabulary(encoded, path)

    def run(batches):
        bpe = encoder(ranks.value, pattern)
        for rows in batches:
            data = [bpe.decode(np.frombuffer(value.as_py() or b"", "<u4")) for value in rows.column(1)]
            yield batch(DECODED, doc_id=rows.column(0), data=data)

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)


LENGTHS = "doc_id long, n_tokens long"


def lengths(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encoded length of every whole text."""
    ranks = vocabulary(docs, path)

    def run(batches):
        bpe = encoder(ranks.value, pattern)
        for rows in batches:
            counts = [sum(len(part) >> 2 for part in bpe.segments(value.as_py())) for value in rows.column(1)]
            yield batch(LENGTHS, doc_id=rows.column(0), n_tokens=counts)

    return key_columns(docs, key, text).mapInArrow(run, LENGTHS)
