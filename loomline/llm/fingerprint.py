"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last WINDOW bytes is taken at every byte; where its low bits are all ones, a chunk ends. How many bits
that are, the block size, follows from the length, so that a text has about 32 to 64 chunks. Each chunk gives one
character of the signature, MOST at the most: the last one stands for the rest of the text; a second signature at twice the block size makes texts of somewhat different
lengths comparable. Fingerprints look like "64:abc:ab". Two are compared by the edit distance of
their signatures at a common block size.

Equal texts have equal fingerprints. A null text counts as empty and has the fingerprint "4::"; two empty texts are
alike (1.0). Repeated rows are neighbours of each other, in order of their texts; a null key comes last. With one document
only, it is its own next. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MULTIPLIER, batch, buckets, key_columns, mixed, powers, scoped, written

WINDOW = 7
#: Smallest block size, as a power of two, and chunks that a text has at most on average.
LEAST, CHUNKS = 2, 64
#: Characters of a signature. A usual text has a quarter of that; the bound is for texts that repeat a few bytes.
MOST = 256
#: Bytes hashed at once.
SLICE = 1 << 20
#: Signatures without a common run of this length have nothing in common.
COMMON = 7
# The usual 64 characters.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(LETTERS.encode(), np.uint8)
_BYTES = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER)) >> np.uint64(32)).astype(np.uint32)


def block_bits(size: int) -> int:
    """log2 of the block size of a text of so many bytes."""
    return max(LEAST, (max(1, -(-size // CHUNKS)) - 1).bit_length())


def _rolled(data: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW bytes that end at each position from WINDOW - 1 on."""
    each, n = _BYTES[data], len(data) - WINDOW + 1
    out = np.zeros(n, np.uint32)
    for k in range(WINDOW):
        part = each[WINDOW - 1 - k : WINDOW - 1 - k + n]
        out ^= (part << np.uint32(k * 3)) | (part >> np.uint32(32 - k * 3)) if k else part
    return out


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprint of each text; short texts are hashed many at once, long ones a slice at a time."""
    out, group, size = [], [], 0
    for text in texts:
        if group and size + len(text) > SLICE:
            out += _many(group)
            group, size = [], 0
        group.append(text)
        size += len(text) + WINDOW
    return out + (_many(group) if group else [])


def _many(texts: list[bytes]) -> list[str]:
    sizes = np.array([len(t) for t in texts])
    bits = [block_bits(n) for n in sizes.tolist()]
    data = np.frombuffer(b"".join(x for t in texts for x in (b"\0" * WINDOW, t)), np.uint8)
    begins = np.cumsum(sizes + WINDOW) - sizes
    masks = np.repeat(np.array([(1 << b) - 1 for b in bits], np.uint32), sizes + WINDOW)
    cuts, sums = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    coarse = [np.empty(0, bool)]
    ends = begins + sizes
    wanted_sums = np.zeros(len(texts), np.uint64)
    base_sums = np.zeros(len(texts), np.uint64)
    total, scale = np.uint64(0), 1
    for at in range(0, len(data), SLICE):
        stop = min(len(data), at + SLICE)
        left = max(0, at - WINDOW + 1)
        part = data[left:stop]
        hashes = np.zeros(stop - at, np.uint32)
        if len(part) >= WINDOW:
            rolled = _rolled(part)
            hashes[-len(rolled) :] = rolled
        mask = masks[at:stop]
        here = np.nonzero((hashes & mask) == mask)[0]
        up, _ = powers(stop - at)
        running = np.cumsum((data[at:stop].astype(np.uint64) + np.uint64(1)) * up) * np.uint64(scale) + total
        cuts.append(here + at + 1)
        sums.append(running[here])
        double = (mask[here] << np.uint32(1)) | np.uint32(1)
        coarse.append((hashes[here] & double) == double)
        for edges, kept in ((ends, wanted_sums), (begins, base_sums)):
            inside = (edges > at) & (edges <= stop)
            kept[inside] = running[edges[inside] - at - 1]
        total = running[-1]
        scale = scale * pow(MULTIPLIER, stop - at, 1 << 64) % (1 << 64)
    cuts, sums, coarse = np.concatenate(cuts), np.concatenate(sums), np.concatenate(coarse)
    owner = np.searchsorted(begins, cuts, "right") - 1
    real = (owner >= 0) & (cuts > begins[owner]) & (cuts <= ends[owner])
    cuts, sums, coarse, owner = cuts[real], sums[real], coarse[real], owner[real]
    fine = _signatures(cuts, sums, owner, begins, ends, base_sums, wanted_sums)
    wide = _signatures(cuts[coarse], sums[coarse], owner[coarse], begins, ends, base_sums, wanted_sums)
    return [f"{1 << b}:{x}:{y}" for b, x, y in zip(bits, fine, wide)]


def _signatures(cuts, sums, owner, begins, ends, base, final) -> list[str]:
    """A character per chunk: the ends given, and each text's own end."""
    n = len(begins)
    firsts = np.searchsorted(owner, np.arange(n))
    fits = np.arange(len(owner)) - firsts[owner] < MOST - 1
    cuts, sums, owner = cuts[fits], sums[fits], owner[fits]
    all_cuts = np.concatenate([begins, cuts, ends])
    all_sums = np.concatenate([base, sums, final])
    all_owner = np.concatenate([np.arange(n), owner, np.arange(n)])
    rank = np.concatenate([np.zeros(n, np.int8), np.ones(len(cuts), np.int8), np.full(n, 2, np.int8)])
    order = np.lexsort((rank, all_cuts, all_owner))
    c, s, o = all_cuts[order], all_sums[order], all_owner[order]
    chunk = (o[1:] == o[:-1]) & (c[1:] > c[:-1])
    start = c[:-1][chunk]
    value = (s[1:] - s[:-1])[chunk] * _inverse_powers(start)
    letters = _LETTERS[(mixed(value + (c[1:] - c[:-1])[chunk].astype(np.uint64)) >> np.uint64(58)).astype(np.int64)]
    counts = np.bincount(o[1:][chunk], minlength=n)
    text, at, out = letters.tobytes().decode(), 0, []
    for k in counts.tolist():
        out.append(text[at : at + k])
        at += k
    return out


def _inverse_powers(exponents: np.ndarray) -> np.ndarray:
    """MULTIPLIER ** -e modulo 2**64, by squaring."""
    out, square, left = np.ones(len(exponents), np.uint64), pow(MULTIPLIER, -1, 1 << 64), exponents.astype(np.uint64).copy()
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square), out)
        square = square * square % (1 << 64)
        left >>= np.uint64(1)
    return out


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and changes from a to b: a column of the table at a time, as the bits of one integer."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rises, falls, distance = full, 0, len(a)
    for x in b:
        match = places.get(x, 0)
        level = (((match & rises) + rises) ^ rises) | match | falls
        up = (falls | ~(level | rises)) & full
        down = rises & level
        distance += bool(up & top) - bool(down & top)
        up = ((up << 1) | 1) & full
        rises = ((down << 1) | ~(level | up)) & full
        falls = up & level
    return distance


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    short = min(COMMON, len(a), len(b))
    runs = {a[i : i + short] for i in range(len(a) - short + 1)}
    if not any(b[i : i + short] in runs for i in range(len(b) - short + 1)):
        return 0.0
    return 1 - edit_distance(a, b) / max(len(a), len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 where the block sizes are not compatible."""
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    m, n = int(m), int(n)
    if m == n:
        return max(_alike(a1, b1), _alike(a2, b2))
    return _alike(a2, b1) if 2 * m == n else _alike(a1, b2) if m == 2 * n else 0.0


PRINTED = "doc_id long, n_chars long, fingerprint string"


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(1).to_pylist()
            yield batch(PRINTED, doc_id=rows.column(0), n_chars=[len(t) for t in texts], fingerprint=fingerprints([t.encode("utf-8", "replace") for t in texts]))

    return key_columns(docs, key, text).mapInArrow(run, PRINTED)


EDITED = "kind int, part int, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
RESULT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
#: Texts of a batch that are compared at once.
STEP = 256
#: Characters of a text that the range partitioning sees.
BEGINNING = 64


def _compared(ids: list, texts: list[str], following: list[str], kind: int, part: int) -> pa.RecordBatch:
    """Rows of kind 0 for documents and the texts that follow them."""
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following)]
    coded = [x.encode("utf-8", "replace") for x in edited]
    own = fingerprints([t.encode("utf-8", "replace") for t in [*texts, *following[-1:]]])
    other = fingerprints(coded)
    next_prints = own[1:]
    return batch(
        EDITED,
        kind=[kind] * len(ids),
        part=[part] * len(ids),
        doc_id=ids,
        text=[None] * len(ids),
        n_chars=[len(t) for t in texts],
        edited_sha256=[hashlib.sha256(x).hexdigest() for x in coded],
        fingerprint=own[:-1],
        edited_fingerprint=other,
        near_edited=[likeness(a, b) for a, b in zip(own, other)],
        near_next=[likeness(a, b) for a, b in zip(own, next_prints)],
    )


def _carried(kind: int, part: int, doc_id, text: str) -> pa.RecordBatch:
    return batch(EDITED, kind=[kind], part=[part], doc_id=[doc_id], text=[text], **{k: [None] for k in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")})


@scoped
def edit_probe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to it and to the next document's.

    The next document is the one with the next smaller id (after the last: the first). Documents are range-partitioned and sorted by
    id, so all but a partition's last document find the next one beside them; each partition's first and last text are
    written aside and joined in a second step, two rows per partition.
    """
    # Rows of one id or none are told apart by how their texts begin, which agrees with the order of the texts.
    rows = key_columns(docs, key, text).withColumn("beginning", F.substring("text", 1, BEGINNING))
    ordered = rows.repartitionByRange(buckets(docs), F.desc("doc_id"), "beginning").sortWithinPartitions(F.desc("doc_id"), "beginning", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for rows in batches:
            ids, texts = rows.column(0).to_pylist(), rows.column(1)
            for at in range(0, len(ids), STEP):
                some = [x.as_py() for x in texts[at : at + STEP]]
                if held is None:
                    yield _carried(1, part, ids[at], some[0])
                    known, names = some, ids[at : at + STEP]
                else:
                    known, names = [held[1], *some], [held[0], *ids[at : at + STEP]]
                if len(known) > 1:
                    yield _compared(names[:-1], known[:-1], known[1:], 0, part)
                held = names[-1], known[-1]
        if held is not None:
            yield _carried(2, part, *held)

    table = written(ordered.mapInArrow(run, EDITED), "edited")
    heads = table.where("kind = 1").select("part", F.col("text").alias("following"))
    tails = table.where("kind = 2").select("part", "doc_id", "text")
    order = Window.orderBy("part")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = table.where("kind = 1").select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(everything)).alias("after"))
    pairs = tails.join(after, "part").join(heads.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for doc_id, own, following in zip(*(c.to_pylist() for c in rows.columns)):
                yield _compared([doc_id], [own], [following], 0, 0)

    return table.where("kind = 0").select(*RESULT).unionByName(pairs.mapInArrow(finish, EDITED).select(*RESULT))
