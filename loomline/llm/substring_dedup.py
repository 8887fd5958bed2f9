"""Substring deduplication with difference-cover anchors.

A word goes if a window of `WIDTH` consecutive words around it also starts in a document with a smaller id.

COVER is a difference cover modulo PERIOD: for any two places i and j there is a k < PERIOD such that both i + k and j + k
are cover places. So if two windows of WIDTH words are equal, they share an anchor, a shorter window of
WIDTH - PERIOD + 1 words that begins at a cover place in both. Only anchors, a fifth of all places, are hashed and dealt out.

1. Anchors. Each task finds those that several of its own documents have and deals the others out by hash, one per hash; a bucket tells
   the documents which of their anchors stand elsewhere too. An anchor that very many documents have is thus sent once per task.
2. Extension. In documents with such anchors, the whole windows around them are hashed with 80 bits and a bucket number, and dealt out in the
   same way; of equal windows the smallest id stays and the others are told.
3. Covered words are removed. Windows are judged on the input.

A null text has no words. A null id is larger than all others. Rows that repeat an id do not remove each other's words; rows that
repeat id and text get equal results. An empty table gives no rows. Texts of any length are read in segments.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batch, buckets, dropped, fresh, mixed, released, scoped, spans, window_hashes, word_hashes, word_segments, written

WIDTH = 50
#: A perfect difference set: every residue modulo 31 is a difference of two of its six members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
ANCHOR = WIDTH - PERIOD + 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: Hashes that a task holds before it deals them out.
HELD = 1 << 20
_NULL = (1 << 63) - 1


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and 48-bit + bucket hashes of the anchors of a text."""
    hashes = window_hashes(words, ANCHOR)
    at = np.flatnonzero(_IN_COVER[np.arange(len(hashes)) % PERIOD])
    return at, hashes[at]


_LOW = np.uint64((1 << 48) - 1)


def _second(words: np.ndarray) -> np.ndarray:
    """16 further bits of every window's hash, from other word hashes."""
    return (window_hashes(mixed(words + np.uint64(0x5851F42D4C957F2D)), WIDTH) >> np.uint64(48)).astype(np.uint16)


def candidates(marked: np.ndarray, n_words: int) -> np.ndarray:
    """Begins of the windows that hold a marked anchor."""
    last = n_words - WIDTH
    edge = np.zeros(last + 2, np.int32)
    np.add.at(edge, np.clip(marked - (WIDTH - ANCHOR), 0, last + 1), 1)
    np.add.at(edge, np.clip(marked, -1, last) + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: last + 1] > 0)


def _narrow(values: np.ndarray, size: int) -> bytes:
    """The low bytes of 64-bit integers."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _wide(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


class _Held:
    """Hashes of several documents; documents are numbered in the order they come."""

    def __init__(self):
        self.idents, self.marks, self.hashes, self.extra, self.owner, self.size = [], [], [], [], [], 0

    def add(self, ident: int, mark: int, hashes: np.ndarray, extra: np.ndarray | None = None) -> None:
        if len(hashes):
            self.owner.append(np.full(len(hashes), len(self.idents), np.int32))
            self.idents.append(ident)
            self.marks.append(mark)
            self.hashes.append(hashes)
            self.extra.append(np.zeros(len(hashes), np.uint16) if extra is None else extra)
            self.size += len(hashes)

    def taken(self):
        out = np.array(self.idents, np.int64), np.array(self.marks, np.int64), np.concatenate(self.hashes), np.concatenate(self.extra), np.concatenate(self.owner)
        self.__init__()
        return out


DEALT = "kind int, bucket int, data binary"
TOLD = "shard int, data binary"
FOUND = "ident long, mark long, found binary"


def _told(n_shards: int, idents: np.ndarray, marks: np.ndarray, owner: np.ndarray, values: np.ndarray, size: int) -> tuple[list[int], list[bytes]]:
    """Answers for documents, a row for each shard of documents: how many documents and values, idents, marks, counts, values."""
    shard = (mixed(idents.astype(np.uint64)) % np.uint64(n_shards)).astype(np.int64)[owner]
    order = np.lexsort((owner, shard))
    shard, owner, values = shard[order], owner[order], values[order]
    begins, _ = spans(shard)
    edges, data = [*begins.tolist(), len(shard)], []
    for a, b in zip(edges, edges[1:]):
        firsts, _ = spans(owner[a:b])
        who, counts = owner[a:b][firsts], np.diff([*firsts.tolist(), b - a]).astype("<u4")
        data.append(b"".join([struct.pack("<II", len(who), b - a), idents[who].astype("<i8").tobytes(), marks[who].astype("<i8").tobytes(), counts.tobytes(), _narrow(values[a:b], size)]))
    return shard[begins].tolist(), data


def _merged(size: int) -> Callable[[pa.Table], pa.Table]:
    """All answers of a shard, one row per document."""

    def merge(rows: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[], [], []]
        for value in rows.column("data"):
            data = value.as_py()
            n, m = struct.unpack_from("<II", data)
            idents, marks = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<i8", n, 8 + 8 * n)
            counts = np.frombuffer(data, "<u4", n, 8 + 16 * n)
            for held, x in zip(parts, (np.repeat(idents, counts), np.repeat(marks, counts), _wide(data[8 + 20 * n :], size))):
                held.append(x)
        idents, marks, values = map(np.concatenate, parts)
        order = np.lexsort((marks, idents))
        idents, marks, values = idents[order], marks[order], values[order]
        begins, _ = _runs(idents, marks)
        edges = [*begins.tolist(), len(idents)]
        return pa.Table.from_batches([batch(FOUND, ident=idents[begins], mark=marks[begins], found=[_narrow(values[a:b], size) for a, b in zip(edges, edges[1:])])])

    return merge


def _dealt(kind: int, n_buckets: int, idents, marks, hashes, extra, owner, size: int) -> pa.RecordBatch:
    """One row per bucket: documents, how many hashes each has, the hashes' low bytes, and the extra bits if there are any. Owner -1: no document needs an answer."""
    bucket = ((hashes >> np.uint64(48)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.lexsort((owner, bucket))
    bucket, hashes, extra, owner = bucket[order], hashes[order], extra[order], owner[order]
    begins, _ = spans(bucket)
    edges, data = [*begins.tolist(), len(bucket)], []
    for a, b in zip(edges, edges[1:]):
        own = owner[a:b]
        firsts, _ = spans(own)
        counts, who = np.diff([*firsts.tolist(), b - a]).astype("<u4"), own[firsts]
        silent = who < 0
        parts = [struct.pack("<II", len(who), b - a), np.where(silent, 0, idents[who]).astype("<i8").tobytes(), np.where(silent, 0, marks[who]).astype("<i8").tobytes(), silent.astype(np.uint8).tobytes(), counts.tobytes(), _narrow(hashes[a:b], size)]
        data.append(b"".join([*parts, extra[a:b].astype("<u2").tobytes()] if size == 8 else parts))
    n = len(data)
    return batch(DEALT, kind=[kind] * n, bucket=bucket[begins].astype(np.int32), data=data)


def _gathered(rows: pa.Table, size: int):
    """What _dealt() sent to a bucket: idents, marks, silent per document; owner, hash, extra per entry."""
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    base = 0
    for value in rows.column("data"):
        data = value.as_py()
        n, m = struct.unpack_from("<II", data)
        at = 8
        idents = np.frombuffer(data, "<i8", n, at)
        marks = np.frombuffer(data, "<i8", n, at := at + 8 * n)
        silent = np.frombuffer(data, np.uint8, n, at := at + 8 * n)
        counts = np.frombuffer(data, "<u4", n, at := at + n)
        at += 4 * n
        hashes = _wide(data[at : at + size * m], size)
        extra = np.frombuffer(data, "<u2", m, at + size * m) if size == 8 else np.zeros(m, np.uint16)
        for k, x in enumerate((idents, marks, silent.astype(bool), np.repeat(np.arange(base, base + n), counts), hashes, extra)):
            columns[k].append(x)
        base += n
    return [np.concatenate(x) for x in columns]


def _answers(n_shards: int, idents, marks, owner, values, size: int) -> pa.Table:
    shards, data = _told(n_shards, idents, marks, owner, values, size) if len(owner) else ([], [])
    return pa.Table.from_batches([batch(TOLD, shard=shards, data=data)])


def _shared_anchors(n_shards: int) -> Callable[[pa.Table], pa.Table]:
    """Anchors of a bucket that several tasks sent, for the documents that have them."""

    def reduce(rows: pa.Table) -> pa.Table:
        idents, marks, silent, owner, hashes, _ = _gathered(rows, 6)
        order = np.argsort(hashes, kind="stable")
        begins, run = spans(hashes[order])
        again = np.bincount(run, minlength=len(begins))[run] > 1
        owner, hashes = owner[order][again], hashes[order][again]
        asked = ~silent[owner]
        return _answers(n_shards, idents, marks, owner[asked], hashes[asked], 6)

    return reduce


def _later_windows(n_shards: int) -> Callable[[pa.Table], pa.Table]:
    """Windows of a bucket that a document with a smaller id has too, for the others that have them."""

    def reduce(rows: pa.Table) -> pa.Table:
        idents, marks, _, owner, hashes, extra = _gathered(rows, 8)
        order = np.lexsort((extra, hashes))
        hashes, extra, owner = hashes[order], extra[order], owner[order]
        begins, run = _runs(hashes, extra)
        least = np.minimum.reduceat(idents[owner], begins)[run]
        later = idents[owner] > least
        return _answers(n_shards, idents, marks, owner[later], hashes[later], 8)

    return reduce


def _runs(hashes: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (extra[1:] != extra[:-1])
    return np.flatnonzero(first), np.cumsum(first) - 1


def _flush_anchors(held: _Held, n_buckets: int) -> Iterator[pa.RecordBatch]:
    idents, marks, hashes, extra, owner = held.taken()
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    begins, run = spans(hashes)
    # Documents of one id but several texts are told here too: the bucket answers one document per hash.
    several = np.zeros(len(begins), bool)
    for values in (idents[owner], marks[owner]):
        several |= np.minimum.reduceat(values, begins) < np.maximum.reduceat(values, begins)
    here = several[run]
    if here.any():
        shards, data = _told(n_buckets, idents, marks, owner[here], hashes[here] & _LOW, 6)
        yield batch(DEALT, kind=[0] * len(data), bucket=shards, data=data)
    yield _dealt(1, n_buckets, idents, marks, hashes[begins], extra[begins], np.where(several, -1, owner[begins]), 6)


def _flush_windows(held: _Held, n_buckets: int) -> Iterator[pa.RecordBatch]:
    idents, marks, hashes, extra, owner = held.taken()
    order = np.lexsort((owner, extra, hashes))
    hashes, extra, owner = hashes[order], extra[order], owner[order]
    begins, run = _runs(hashes, extra)
    ids = idents[owner]
    later = ids > np.minimum.reduceat(ids, begins)[run]
    if later.any():
        shards, data = _told(n_buckets, idents, marks, owner[later], hashes[later], 8)
        yield batch(DEALT, kind=[0] * len(data), bucket=shards, data=data)
    once = ~later
    once[1:] &= (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    yield _dealt(1, n_buckets, idents, marks, hashes[once], extra[once], owner[once], 8)


def _all_told(dealt: DataFrame, reduce: Callable[[pa.Table], pa.Table], size: int) -> DataFrame:
    """ident, mark, found: what documents were told by their own tasks and by the buckets, one row per document. Answers travel by shards of documents, as many as there
    are buckets, so their rows do not multiply."""
    near = dealt.where("kind = 0").select(F.col("bucket").alias("shard"), "data")
    far = dealt.where("kind = 1").select("bucket", "data").groupBy("bucket").applyInArrow(reduce, TOLD)
    return near.unionByName(far).groupBy("shard").applyInArrow(_merged(size), FOUND)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL)).alias("ident"), F.xxhash64(body).alias("mark"), F.col(key).cast("long").alias("doc_id"), body.alias("text"))


MIXED = "kind int, bucket int, ident long, mark long, data binary, doc_id long, text string, n_words long, n_removed long, kept_sha256 string, kept string"
RESULT = "doc_id long, ident long, mark long, n_words long, n_removed long, kept_sha256 string, kept string"


def _mixed(part: pa.RecordBatch) -> pa.RecordBatch:
    """DEALT rows among the others."""
    n = part.num_rows
    return batch(MIXED, **{name: part.column(i) for i, name in enumerate(("kind", "bucket", "data"))}, **{k: [None] * n for k in ("ident", "mark", "doc_id", "text", "n_words", "n_removed", "kept_sha256", "kept")})


def _plain_digest(data: bytes) -> tuple[int, str]:
    """Words, and the digest of all of them joined by spaces."""
    total, digest = 0, hashlib.sha256()
    for words in word_segments(data):
        if words:
            digest.update((b" " if total else b"") + b" ".join(words))
            total += len(words)
    return total, digest.hexdigest()


@scoped
def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """Per row: doc_id, ident, mark, n_words, n_removed, kept_sha256, kept (the words left, joined by one space; with texts=True, where words went)."""
    n_buckets = buckets(docs)
    rows = _keyed(docs, key, text)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = WordHashes(), _Held()
        for some in batches:
            for ident, mark, value in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2)):
                words = word_hashes(value.as_py().encode("utf-8", "replace"), known)
                if len(words) >= WIDTH:
                    held.add(ident, mark, anchors(words)[1])
                if held.size >= HELD:
                    yield from _flush_anchors(held, n_buckets)
        if held.size:
            yield from _flush_anchors(held, n_buckets)

    dealt = written(rows.select("ident", "mark", "text").mapInArrow(first, DEALT), "anchors", "kind")
    joined = rows.join(_all_told(dealt, _shared_anchors(n_buckets), 6), ["ident", "mark"], "left").select("ident", "mark", "doc_id", "text", "found")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = WordHashes(), _Held()
        for some in batches:
            done, doubtful = [], []
            for ident, mark, doc_id, value, found in zip(*(some.column(i).to_pylist() for i in range(3)), some.column(3), some.column(4)):
                data, begins = value.as_py().encode("utf-8", "replace"), ()
                if found.is_valid:
                    words = word_hashes(data, known)
                    at, hashes = anchors(words)
                    marked = at[np.isin(hashes & _LOW, _wide(found.as_py(), 6))]
                    begins = candidates(marked, len(words))
                if len(begins):
                    held.add(ident, mark, window_hashes(words, WIDTH)[begins], _second(words)[begins])
                    doubtful.append((ident, mark, doc_id, value.as_py()))
                    if held.size >= HELD:
                        yield from map(_mixed, _flush_windows(held, n_buckets))
                else:
                    done.append((ident, mark, doc_id, *_plain_digest(data)))
            for kind, found_rows, names in ((2, done, ("ident", "mark", "doc_id", "n_words", "kept_sha256")), (3, doubtful, ("ident", "mark", "doc_id", "text"))):
                n = len(found_rows)
                if n:
                    given = dict(zip(names, map(list, zip(*found_rows)))) | {"kind": [kind] * n}
                    given |= {"n_removed": [0] * n} if kind == 2 else {}
                    yield batch(MIXED, **{f.split()[0]: given.get(f.split()[0], [None] * n) for f in MIXED.split(", ")})
        if held.size:
            yield from map(_mixed, _flush_windows(held, n_buckets))

    table = written(joined.mapInArrow(second, MIXED), "windows", "kind")
    dropped(dealt)
    del dealt, joined
    released(docs.sparkSession)
    doubtful = table.where("kind = 3").select("ident", "mark", "doc_id", "text")
    judged = doubtful.join(_all_told(table, _later_windows(n_buckets), 8), ["ident", "mark"], "left").select("ident", "mark", "doc_id", "text", "found")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for some in batches:
            out = []
            for ident, mark, doc_id, value, found in zip(*(some.column(i).to_pylist() for i in range(3)), some.column(3), some.column(4)):
                data = value.as_py().encode("utf-8", "replace")
                if not found.is_valid:
                    n, digest = _plain_digest(data)
                    out.append((doc_id, ident, mark, n, 0, digest, None))
                    continue
                hashes = word_hashes(data, known)
                gone = covered(np.flatnonzero(np.isin(window_hashes(hashes, WIDTH), np.frombuffer(found.as_py(), "<u8"))), len(hashes))
                kept = _left(data, gone)
                out.append((doc_id, ident, mark, len(hashes), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            if out:
                yield batch(RESULT, **dict(zip((f.split()[0] for f in RESULT.split(", ")), map(list, zip(*out)))))

    names = [f.split()[0] for f in RESULT.split(", ")]
    return table.where("kind = 2").select(*names).unionByName(judged.mapInArrow(last, RESULT))


def covered(begins: np.ndarray, n_words: int) -> np.ndarray:
    """Words that lie in a window with one of the begins."""
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + WIDTH, -1)
    return np.cumsum(edge)[:n_words] > 0


def _left(data: bytes, gone: np.ndarray) -> bytes:
    parts, at = [], 0
    for words in word_segments(data):
        parts += [w for w, g in zip(words, gone[at : at + len(words)].tolist()) if not g]
        at += len(words)
    return b" ".join(parts)


@scoped
def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with all their columns; where words went, the text is the words left, joined by one space, and its length is counted anew. Other columns may have any names."""
    ident, mark, kept = fresh(docs, "of_ident", "of_mark", "of_kept")
    changed = remove_repeats(docs, key, text, texts=True).where("n_removed > 0").select(F.col("ident").alias(ident), F.col("mark").alias(mark), F.col("kept").alias(kept))
    changed = written(changed.dropDuplicates([ident, mark]), "changed")
    same_row = (F.coalesce(docs[key].cast("long"), F.lit(_NULL)) == changed[ident]) & (F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) == changed[mark])
    joined = docs.join(changed, same_row, "left")
    columns = [F.coalesce(kept, text).alias(c) if c == text else F.when(F.col(kept).isNotNull(), F.char_length(kept).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == length else F.col(c) for c in docs.columns]
    return joined.select(*columns)
