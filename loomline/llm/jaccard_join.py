"""N-gram Jaccard join over count vectors, and the components of its links.

A document is the set of its distinct word shingles. Shingles are hashed into groups; a set is the point of its group counts, and the overlap of two sets is at
most the sum, over the groups, of the smaller of their two counts. Two sets of sizes m and n reach the threshold t if they share at least
t / (1 + t) * (m + n) shingles.

Boxes. The index is over the finest groups, one per shingle hash: a box holds the points that have a given group occupied. Groups are ordered
from rare to frequent, and a set enters only the boxes of its first
n - ceil(t n) + 1 groups: if two sets share none of these, the summed minima over the rest stay below the bound. In a box, the member at place p of its order can link with
sets of at most reach = (4 n - 7 p) / 3 shingles, as the minima over the groups from here on must suffice; two members may link only if each is within the other's reach. Members
that reach nobody leave. So does a box whose members all have the same group before it in their orders (told by 40 bits of its hash): that group's box has them with no less reach. A box of two is their pair; boxes of the same members are one. Pairs that are left are bounded by the summed minima of their counts in COARSE or more groups, and those that pass are verified on the sets themselves, made anew
from the texts. README has figures on a tree over coarse groups alone, which would open nearly all of its nodes.

The order of groups is the same for all sets; any gives the same result. What stands out among counts of all documents in LEVELS coarse groups comes last; the others are ordered by how often
their words occur in all documents, as if words were independent. A table of words keeps its meaning at any size of the data, where coarse groups of shingles all fill up: so few boxes
hold sets that have only one rare group in common.

Rounds keep large groups of near copies from becoming all their pairs. In the first, each set proposes one partner: the member with the furthest reach that it may link with, over all its boxes.
The links give components, and only boxes with several components go on; there the members outside the box's largest component look for partners. Where that is much work
(HEAVY), each proposes one partner of another component, drawn anew in each round, for as long as links are found; then all pairs that are left are judged, in blocks of BLOCK members, so no
link between components is lost and no group is gathered in one task.

Equal sets share one node. A null or empty text has no shingles, links with nothing and is its own component; a text with fewer words than a shingle is one shingle. A null id
counts as larger than all others; such rows' component may be null. Rows that repeat an id are nodes by their sets. An empty table gives no rows. Texts of any length are read in
segments. No column of the input can clash with those made here: only the key and the text are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, attach, batch, buckets, dropped, fresh, mixed, released, scoped, spans, window_hashes, word_hashes, written
from .components import components

WORDS = 5
#: The threshold as a fraction.
NUMERATOR, DENOMINATOR = 3, 4
#: Coarse groups of shingles, and of words, that give the order, as a power of two; and slices that their counts are summed in.
LEVELS, SLICES = 22, 16
#: Steps of a word's level between a count and its double.
STEPS = 7
#: Groups of a count vector, at least.
COARSE = 256
#: Members of a box that are compared in one task.
BLOCK = 2048
#: Pairs to judge per member of the boxes that are left, above which another round of single partners comes first.
HEAVY = 1024
#: A group with more than 2 ** HOT_LEVEL occurrences is dealt to several buckets.
HOT_LEVEL = 14
#: Hashes that a task holds before it deals them out.
HELD = 1 << 20
#: Pairs of one set that stay together when they meet its points or shingles.
TOGETHER = 1024
#: Bits of each of the two filters of documents to verify; their size does not depend on the data.
FILTER = 1 << 25
#: Bytes of a set's name.
NAME = 12
_NULL = (1 << 63) - 1


def lowered(text: str, known: WordHashes) -> np.ndarray:
    """Hashes of the words, in small letters."""
    return word_hashes(text.encode("utf-8", "replace").lower(), known)


def shingles(text: str, known: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = lowered(text, known)
    return np.unique(window_hashes(words, min(WORDS, len(words)))) if len(words) else np.empty(0, np.uint64)


def set_id(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())[:NAME]


def needed(m, n):
    """Shingles that sets of these sizes share at least if they link: 4 i >= 3 (m + n - i)."""
    both = NUMERATOR + DENOMINATOR
    return (NUMERATOR * (m + n) + both - 1) // both


def reach(n, place):
    """The largest set that one of n shingles may link with if the first group they share is at this place of its order: n - place >= needed(n, other). Two sets
    may link only if each is within the other's reach, which implies that their sizes differ by a factor of 4 / 3 at most."""
    return (DENOMINATOR * n - (NUMERATOR + DENOMINATOR) * place) // NUMERATOR


def groups(n: int) -> int:
    """Groups of the point of a set of n shingles: COARSE, for large sets a power of two between n / 8 and n / 4, so that points tell them apart as well."""
    return max(COARSE, 1 << max(0, n.bit_length() - 3))


def point(found: np.ndarray) -> bytes:
    """Counts per group of the hashes' first bits, in the fewest bytes that hold them; the first byte says how many."""
    g = groups(len(found))
    counts = np.bincount((found >> np.uint64(65 - g.bit_length())).astype(np.int64), minlength=g)
    size = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def counts_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def overlap_bound(x: np.ndarray, y: np.ndarray) -> int:
    """Sum of the minima of two points; the finer one is added up to the groups of the other."""
    least = min(len(x), len(y))
    return int(np.minimum(x.reshape(least, -1).sum(1), y.reshape(least, -1).sum(1)).sum())


SETS = "kind int, doc_id long, ident long, mark long, n long, sid binary, point binary, slice int, data binary"
SLICE = "slice int, part int, data binary"


class _Counts:
    """How often each coarse group occurs."""

    def __init__(self):
        self.counts, self.held, self.n = np.zeros(1 << LEVELS, np.uint32), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.held.append(hashes & np.uint64((1 << LEVELS) - 1))
        self.n += len(hashes)
        if self.n >= HELD:
            self.sum()

    def sum(self) -> np.ndarray:
        if self.held:
            self.counts += np.bincount(np.concatenate(self.held).astype(np.int64), minlength=1 << LEVELS).astype(np.uint32)
        self.held, self.n = [], 0
        return self.counts


def _sets(source: DataFrame) -> DataFrame:
    """Kind 0: each row with its set's size, name and point; kind 1: how often each coarse group of shingles, then of words, occurs, a slice of the counts a row, one of each slice a task."""
    step = (1 << LEVELS) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of_shingles, of_words = WordHashes(), _Counts(), _Counts()
        for some in batches:
            out = []
            for value in some.column(1):
                words = lowered(value.as_py(), known)
                found = np.unique(window_hashes(words, min(WORDS, len(words)))) if len(words) else words
                out.append((len(found), set_id(found), point(found)) if len(found) else (0, None, None))
                of_shingles.add(found)
                of_words.add(words)
            if k := len(out):
                none = [None] * k
                yield batch(SETS, kind=[0] * k, doc_id=some.column(2), ident=some.column(0), mark=some.column(3), n=[x[0] for x in out], sid=[x[1] for x in out], point=[x[2] for x in out], slice=none, data=none)
        pack, none = zstandard.ZstdCompressor(level=1).compress, [None] * SLICES
        for base, counts in ((0, of_shingles.sum()), (SLICES, of_words.sum())):
            data = [pack(counts[i * step : (i + 1) * step].astype("<u4").tobytes()) for i in range(SLICES)]
            yield batch(SETS, kind=[1] * SLICES, doc_id=[TaskContext.get().partitionId()] * SLICES, ident=none, mark=none, n=none, sid=none, point=none, slice=list(range(base, base + SLICES)), data=data)

    return source.select("ident", "text", "doc_id", "mark").mapInArrow(run, SETS)


def _levels(slices: DataFrame):
    """A broadcast of 2 * 2 ** LEVELS bytes: for each coarse group of shingles log2 of how far its count is above twice the mean, which other shingles may make up, else 0; then for
    each coarse group of words STEPS times log2 of its count. Counts of all tasks, summed in a tree."""
    size = 1 << LEVELS
    step = size // SLICES

    def total(table: pa.Table) -> pa.Table:
        unpack, out = zstandard.ZstdDecompressor().decompress, np.zeros(step, np.uint64)
        for x in table.column("data"):
            out += np.frombuffer(unpack(x.as_py()), "<u4")
        data = zstandard.ZstdCompressor(level=1).compress(np.minimum(out, 2**32 - 1).astype("<u4").tobytes())
        return pa.Table.from_batches([batch(SLICE, slice=[table.column("slice")[0].as_py()], part=[0], data=[data])])

    n_parts = int(np.ceil(np.sqrt(slices.count() / (2 * SLICES) + 1)))
    parts = slices.select("slice", F.pmod("doc_id", F.lit(n_parts)).cast("int").alias("part"), "data")
    summed = parts.groupBy("slice", "part").applyInArrow(total, SLICE).groupBy("slice").applyInArrow(total, SLICE)
    counts = np.zeros(2 * size, np.uint32)
    for r in summed.collect():
        counts[r.slice * step : (r.slice + 1) * step] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.data)), "<u4")
    above = np.maximum(counts[:size].astype(np.int64) - 2 * int(np.ceil(counts[:size].mean())), 1)
    heavy = np.floor(np.log2(above)).astype(np.uint8)
    words = np.round(STEPS * np.log2(np.maximum(counts[size:], 1))).astype(np.uint8)
    return slices.sparkSession.sparkContext.broadcast(heavy.tobytes() + words.tobytes())


ENTRIES = "bucket int, data binary"
#: Bytes of an entry: the hash's low 40 bits, those of the hash before it in the set's order, the set's size, the place in its order (65,535 stands for all later ones: a member is then given more reach
#: than it has), whether the box is spread, the set's name.
HASH, SIZE, PLACE = 5, 4, 2


_LOW = np.uint64((1 << 8 * HASH) - 1)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of each value, all first bytes before all second ones: mostly equal bytes come together and compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, m: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((m, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, width * m, at).reshape(width, m).T
    return out.view("<u8").ravel()


class _Entries:
    """Box entries of several sets, until they are dealt out."""

    def __init__(self):
        self.sids, self.sizes, self.hashes, self.levels, self.n = [], [], [], [], 0

    def add(self, sid: bytes, size: int, hashes: np.ndarray, levels: np.ndarray) -> None:
        self.sids.append(sid)
        self.sizes.append(size)
        self.hashes.append(hashes)
        self.levels.append(levels)
        self.n += len(hashes)

    def dealt(self, n_buckets: int, hot: int) -> pa.RecordBatch:
        lengths = np.array([len(x) for x in self.hashes])
        owner = np.repeat(np.arange(len(lengths)), lengths)
        places = np.minimum(np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths), 65535).astype(np.uint64)
        hashes, levels = np.concatenate(self.hashes), np.concatenate(self.levels)
        before = np.where(places > np.uint64(0), np.roll(hashes, 1), np.uint64(0)) & _LOW
        sizes, sids = np.array(self.sizes, np.uint64), np.frombuffer(b"".join(self.sids), np.uint8).reshape(-1, NAME)
        self.__init__()
        salts = np.uint64(1) << np.maximum(levels.astype(np.int64) - hot, 0).astype(np.uint64)
        salt = sids[owner, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        bucket = (((hashes >> np.uint64(48)) + salt % salts) % np.uint64(n_buckets)).astype(np.int64)
        low = hashes & _LOW
        order = np.lexsort((low, bucket))
        bucket, owner, low, before, places, spread = bucket[order], owner[order], low[order], before[order], places[order], (salts > np.uint64(1))[order]
        begins, _ = spans(bucket)
        data = []
        for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(bucket)]):
            who = owner[i:j]
            data.append(b"".join([struct.pack("<I", j - i), _planes(low[i:j], HASH), _planes(before[i:j], HASH), _planes(sizes[who], SIZE), _planes(places[i:j], PLACE), spread[i:j].tobytes(), sids[who].tobytes()]))
        return batch(ENTRIES, bucket=bucket[begins].astype(np.int32), data=data)


def _entries(source: DataFrame, levels, n_buckets: int, hot: int) -> DataFrame:
    """Entries of all sets, one row per bucket each time a task deals out; a set is dealt out once each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, done = WordHashes(), _Entries(), set()
        heavy, common = np.frombuffer(levels.value, np.uint8).reshape(2, -1)
        low = np.uint64((1 << LEVELS) - 1)
        for some in batches:
            for value in some.column(0):
                words = lowered(value.as_py(), known)
                if not len(words):
                    continue
                width = min(WORDS, len(words))
                found, at = np.unique(window_hashes(words, width), return_index=True)
                n, sid = len(found), set_id(found)
                if sid in done:
                    continue
                done.add(sid)
                own = heavy[(found & low).astype(np.int64)]
                sums = np.concatenate([[0], np.cumsum(common[(words & low).astype(np.int64)], dtype=np.int64)])
                score = (sums[at + width] - sums[at]).astype(np.uint64)
                # Level, words, hash: each of these is a function of the shingle alone.
                rank = own.astype(np.uint64) << np.uint64(58) | score << np.uint64(44) | found >> np.uint64(20)
                first = np.argsort(rank, kind="stable")[: n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1]
                held.add(sid, n, found[first], own[first])
                if held.n >= HELD:
                    yield held.dealt(n_buckets, hot)
                    done.clear()
        if held.n:
            yield held.dealt(n_buckets, hot)

    return source.select("text").mapInArrow(run, ENTRIES)


#: Kind 1: a member of a box of three or more that reaches another member. Kind 2: the pair that a box of two holds. b is a partner of a in this box, and other is the reach of b; null if none was found.
FOUND = "kind int, gid long, a binary, b binary, n long, reach long, other long"


def _boxes(table: pa.Table) -> pa.Table:
    """Of one bucket: the members of its boxes that may link with another one, each with a partner if one is found. Of a box that is spread over buckets all members stay, as their
    partners may be elsewhere. A box whose members all come from one other box is left out, so sets that go on alike are found where they begin to, not in every bucket."""
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    for value in table.column("data"):
        data = value.as_py()
        (m,), at = struct.unpack_from("<I", data), 4
        for part, width in zip(parts, (HASH, HASH, SIZE, PLACE)):
            part.append(_from_planes(data, m, width, at))
            at += width * m
        parts[4].append(np.frombuffer(data, bool, m, at))
        parts[5].append(np.frombuffer(data, np.uint8, NAME * m, at + m).reshape(-1, NAME))
    low, before, size, place, spread, sids = map(np.concatenate, parts)
    bucket = table.column("bucket")[0].as_py()
    box = low.astype(np.int64) << 1 | spread
    order = np.argsort(box, kind="stable")
    order = order[_needed_boxes(box[order], before[order], place[order])]
    # Equal sets of several tasks are one.
    names, rank = np.unique(np.ascontiguousarray(sids[order]).view(f"V{NAME}").ravel(), return_inverse=True)
    box, n, place = box[order], size[order].astype(np.int64), place[order].astype(np.int64)
    order = np.lexsort((place, rank, n, box))
    box, n, place, rank = box[order], n[order], place[order], rank[order]
    once = np.ones(len(box), bool)
    once[1:] = (box[1:] != box[:-1]) | (rank[1:] != rank[:-1])
    box, n, place, rank = box[once], n[once], place[once], rank[once]
    far = reach(n, place)
    i, partner, alive = _partners(box, n, far)
    chosen, other = np.full(len(box), -1, np.int64), np.full(len(box), -1, np.int64)
    chosen[i], other[i] = rank[partner], far[partner]
    kept = np.flatnonzero(alive | (box & 1 == 1))
    box, n, rank, far, chosen, other = (x[kept] for x in (box, n, rank, far, chosen, other))
    begins, run = spans(box)
    sizes = np.bincount(run, minlength=len(begins))
    two = begins[(sizes == 2) & (box[begins] & 1 == 0)]
    swap = rank[two] > rank[two + 1]
    one, two = np.where(swap, two + 1, two), np.where(swap, two, two + 1)
    # What each reaches, where they do reach each other.
    fits = (chosen[one] >= 0) | (chosen[two] >= 0)
    pairs, which = np.unique(rank[one].astype(np.int64) * len(names) + rank[two], return_inverse=True)
    of_one, of_two = np.full(len(pairs), -1, np.int64), np.full(len(pairs), -1, np.int64)
    np.maximum.at(of_one, which[fits], far[one][fits])
    np.maximum.at(of_two, which[fits], far[two][fits])
    many = ((sizes > 2) | (box[begins] & 1 == 1))[run]
    box, n, rank, far, chosen, other = (x[many] for x in (box, n, rank, far, chosen, other))
    # Of the boxes with the same members one stays, where each has its furthest reach. Spread boxes stay as they are.
    begins, run = spans(box)
    sums = np.add.reduceat(mixed(rank.astype(np.uint64) + np.uint64(1)), begins) if len(box) else np.zeros(0, np.uint64)
    spread = box[begins] & 1 == 1
    gid = np.where(spread, -(box[begins] >> 1) - 1, bucket << 8 * HASH | (sums & np.uint64((1 << 8 * HASH) - 1)).astype(np.int64))[run]
    order = np.lexsort((-other, rank, gid))
    chosen, other = chosen[order], other[order]
    order = np.lexsort((-far, rank, gid))
    gid, n, rank, far = gid[order], n[order], rank[order], far[order]
    once = np.ones(len(gid), bool)
    once[1:] = (gid[1:] != gid[:-1]) | (rank[1:] != rank[:-1])
    gid, n, rank, far, chosen, other = (x[once] for x in (gid, n, rank, far, chosen, other))
    raw = names.tobytes()
    pick = lambda at: [raw[NAME * k : NAME * k + NAME] if k >= 0 else None for k in at.tolist()]
    count = max(1, len(names))
    known = np.concatenate([other, of_two])
    columns = {"kind": [1] * len(gid) + [2] * len(pairs), "gid": gid.tolist() + [None] * len(pairs), "n": n.tolist() + [None] * len(pairs)}
    columns |= {"a": pick(np.concatenate([rank, pairs // count])), "b": pick(np.concatenate([chosen, pairs % count])), "reach": np.concatenate([far, of_one]), "other": pa.array(known, mask=known < 0)}
    return pa.Table.from_batches([batch(FOUND, **columns)])


def _partners(box: np.ndarray, n: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members (ordered by box, then size) with a partner, the partners, and which members may have one. A member's partner is, of the members within its reach, the one with the furthest
    reach: if that does not reach back, none does. Linear in the members but for a search."""
    places = np.arange(len(box))
    begins, run = spans(box)
    far = np.maximum(far, 0)
    key = run.astype(np.int64) << 32
    both = key + far
    record = np.maximum.accumulate(np.where(both >= np.maximum.accumulate(both), places, 0)) if len(box) else places
    last = np.searchsorted(key + n, both, "right") - 1
    inside = last >= begins[run] if len(box) else np.zeros(0, bool)
    last = np.maximum(last, 0)
    best = record[last]
    fits = lambda j: inside & (j >= 0) & (j != places) & (run[j] == run) & (n[j] <= far) & (n <= far[j])
    # Where a member is itself the furthest one within its reach: the furthest before it, or the next one.
    own = best == places
    before = record[np.maximum(places - 1, 0)]
    after = np.minimum(places + 1, len(box) - 1)
    second = np.where(fits(before), before, after)
    partner = np.where(own, second, best)
    found = fits(partner)
    # Of those, one whose two choices do not fit may still have a partner further on.
    alive = found | (inside & own & (last > places))
    return np.flatnonzero(found), partner[found], alive


def _needed_boxes(box: np.ndarray, before: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which entries (ordered by box) are in a box that the join needs: a spread one, or one of several entries that do not all have the same group before it in their sets' orders. If they do, that group's
    box has all of them one place earlier, where their reach is no less; and so on, down to a box that stays."""
    begins, run = spans(box)
    if not len(box):
        return np.zeros(0, bool)
    alike = (np.minimum.reduceat(before, begins) == np.maximum.reduceat(before, begins)) & (np.minimum.reduceat(place, begins) > 0)
    return ((np.bincount(run) > 1) & ~alike | (box[begins] & 1 == 1))[run]


PAIRS = "a binary, b binary"


def _several(found: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, int, int]:
    """Members of boxes that hold several components, with their component, the box's largest one and how many members it has in and outside that; rows, and pairs to judge."""
    members = found.where("kind = 1").select("gid", F.col("a").alias("sid"), "n", "reach")
    if labels is not None:
        members = members.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    else:
        members = members.withColumn("label", F.col("sid"))
    members = written(members.select("gid", "sid", "n", "reach", "label"), "members")
    parts = members.groupBy("gid", "label").agg(F.count(F.lit(1)).alias("c"))
    boxes = parts.groupBy("gid").agg(F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("most"))
    boxes = written(boxes.where("size > most.c").select("gid", "size", (F.col("size") - F.col("most.c")).alias("others"), F.col("most.label").alias("major")), "several")
    sums = boxes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("size") * F.col("others")), F.lit(0)).alias("pairs")).collect()[0]
    out = written(attach(members, boxes, "gid", "size", members.count()).where("size is not null"), "mixed")
    for t in (members, boxes):
        dropped(t)
    return out, sums["rows"], sums["pairs"]


MET = "gid long, i long, j long, asks boolean, sid binary, n long, reach long, label binary, other boolean"


def _meetings(several: DataFrame, n_parts: int, round_no: int | None, block: int) -> DataFrame:
    """Pairs of box members in different components that are within each other's reach: all of them, or with a round number one for each member outside the box's largest component
    (drawn from one block of the box).

    The members outside the largest component ask, all members answer. A box of several blocks is a table of blocks that ask and blocks that answer; each of its cells is a group of at most
    two blocks, and members are sent to the cells of their row or column.
    """
    cut = lambda size: F.ceil(F.col(size) / F.lit(block))
    seed = F.lit(round_no or 0)
    place = lambda *of, into: F.pmod(F.xxhash64(*of, seed), into)
    other = F.col("label") != F.col("major")
    rows = several.withColumns({"other": other, "asking": cut("others") if round_no is None else F.lit(1).cast("long"), "answering": cut("size")})
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = place("sid", into=F.col("answering"))
    asks = rows.where("other").withColumn("i", place("sid", into=F.col("asking")))
    asks = asks.withColumn("j", every(F.col("answering")) if round_no is None else place("sid", "gid", into=F.col("answering"))).withColumn("asks", F.lit(True))
    answers = rows.withColumn("j", own).withColumn("i", every(F.col("asking"))).withColumn("asks", F.lit(False))
    names = [x.split()[0] for x in MET.split(", ")]
    both = asks.select(*names).unionByName(answers.select(*names))
    dealt = both.repartition(n_parts, "gid", "i", "j").sortWithinPartitions("gid", "i", "j", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rng = None, np.random.default_rng(round_no or 0)
        for some in batches:
            table = pa.Table.from_batches([some])
            table = table if held is None else pa.concat_tables([held, table])
            keys = [table.column(k).to_numpy() for k in range(3)]
            n = table.num_rows
            if not n:
                continue
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            # The last group may go on in the next batch.
            start = n - int(np.argmin(same[::-1])) if not same.all() else 0
            held = table.slice(start)
            if start:
                yield from _compared(table.slice(0, start), round_no is not None, rng)
        if held is not None and held.num_rows:
            yield from _compared(held, round_no is not None, rng)

    return dealt.mapInArrow(run, PAIRS)


#: Pairs that are judged at once.
CHUNK = 1 << 21


def _compared(table: pa.Table, one: bool, rng: np.random.Generator) -> Iterator[pa.RecordBatch]:
    """Of complete groups, ordered by group with those that answer first."""
    gid, i, j, asks, n, far, other = (table.column(k).to_numpy() for k in (0, 1, 2, 3, 5, 6, 8))
    change = np.ones(len(gid), bool)
    change[1:] = (gid[1:] != gid[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    begins, run = np.flatnonzero(change), np.cumsum(change) - 1
    answer_counts = np.bincount(run, weights=~asks, minlength=len(begins)).astype(np.int64)
    names, rank = np.unique(np.array([x.as_py().ljust(NAME, b"\0") for x in table.column(4)], f"S{NAME}").view(f"V{NAME}"), return_inverse=True)
    _, label = np.unique(np.array([x.as_py().ljust(NAME, b"\0") for x in table.column(7)], f"S{NAME}").view(f"V{NAME}"), return_inverse=True)
    who = np.flatnonzero(asks)
    counts = answer_counts[run[who]]
    ends = np.cumsum(counts)
    raw, at = names.tobytes(), 0
    pick = lambda x: [raw[NAME * k : NAME * k + NAME] for k in x.tolist()]
    while at < len(who):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        k = counts[at:stop]
        x = np.repeat(who[at:stop], k)
        y = np.repeat(begins[run[who[at:stop]]], k) + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
        # Two that both ask meet twice.
        fits = (n[y] <= far[x]) & (n[x] <= far[y]) & (label[x] != label[y]) & (one | ~other[y] | (rank[x] < rank[y]))
        x, y = x[fits], y[fits]
        if one:
            drawn = np.lexsort((rng.random(len(x)), x))
            x, y = x[drawn], y[drawn]
            firsts, _ = spans(x)
            x, y = x[firsts], y[firsts]
            a, b = rank[x], rank[y]
        else:
            both = np.unique(np.minimum(rank[x], rank[y]).astype(np.int64) * len(names) + np.maximum(rank[x], rank[y]))
            a, b = both // len(names), both % len(names)
        if len(a):
            yield batch(PAIRS, a=pick(a), b=pick(b))
        at = stop


JUDGED = "hub binary, copy long, own boolean, sid binary, data binary"


def _judged(pairs: DataFrame, sets: DataFrame, passes: Callable[[bytes, bytes], bool]) -> DataFrame:
    """Pairs of which the data of both sets pass. sets: sid, data; read once.

    Of each pair the set with more pairs is the hub. The data go to the hub's group, which has the hub's own once and those of its partners; a hub with many partners has several groups, each with
    TOGETHER of them. So the data of every set are shuffled twice: to meet their pairs, and to meet the hub.
    """
    pairs = written(pairs, "pairs")
    total = pairs.count()
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))
    degrees = written(ends.groupBy("sid").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    known = pairs
    for end in ("a", "b"):
        known = written(attach(known, degrees.select(F.col("sid").alias(end), F.col("degree").alias(f"of_{end}"), F.col("degree").alias("size")), end, "size", 2 * total).drop("size"), "ends")
    swap = F.col("of_a") > F.col("of_b")
    known = known.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("sid"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("hub"), F.ceil(F.greatest("of_a", "of_b") / F.lit(TOGETHER)).alias("copies"))
    known = known.select("sid", "hub", F.pmod(F.xxhash64("sid"), F.col("copies")).alias("copy"))
    asked = known.withColumn("own", F.lit(False)).unionByName(known.select(F.col("hub").alias("sid"), "hub", "copy").distinct().withColumn("own", F.lit(True)))
    met = asked.join(sets, "sid").select("hub", "copy", "own", "sid", "data")
    dealt = met.repartition(F.col("hub"), F.col("copy")).sortWithinPartitions("hub", "copy", F.desc("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, b""
        for some in batches:
            found = []
            for hub, copy, own, sid, data in zip(*(some.column(k).to_pylist() for k in range(4)), some.column(4)):
                if own:
                    group, held = (hub, copy), data.as_py()
                elif group == (hub, copy) and passes(held, data.as_py()):
                    found.append((sid, hub))
            if found:
                yield batch(PAIRS, a=[min(x) for x in found], b=[max(x) for x in found])

    # A set that several tasks found passes several times.
    return dealt.mapInArrow(run, PAIRS).distinct()


def _may_overlap(x: bytes, y: bytes) -> bool:
    one, two = counts_of(x), counts_of(y)
    return overlap_bound(one, two) >= needed(int(one.sum()), int(two.sum()))


def _overlap(x: bytes, y: bytes) -> bool:
    one, two = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    return len(one) + len(two) - len(np.union1d(one, two)) >= needed(len(one), len(two))


@scoped
def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs whose points' summed minima reach the bound."""
    return written(_judged(pairs, points.select("sid", F.col("point").alias("data")), _may_overlap), "bounded")


def _bits(values: DataFrame, place: Column) -> bytes:
    """A filter of the values, one bit each at its place in 1 .. FILTER."""
    bits = np.zeros(FILTER // 8, np.uint8)
    for r in values.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect():
        bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits.tobytes()


LISTED = "sid binary, data binary"


@scoped
def _verified(pairs: DataFrame, points: DataFrame, source: DataFrame) -> DataFrame:
    """Pairs that do reach the threshold. The texts are read again through two filters of fixed size, of the ids and of the names of the sets in question; only the sets that pass both are
    shuffled. What the filters let pass by chance meets no pair."""
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = written(points.join(ends, "sid").select("sid", "ident"), "wanted")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER)) + 1
    mask = source.sparkSession.sparkContext.broadcast(_bits(wanted, place("ident")) + _bits(wanted, F.pmod(F.crc32("sid"), F.lit(FILTER)) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = WordHashes(), set()
        idents, names = np.frombuffer(mask.value, np.uint8).reshape(2, -1)
        for some in batches:
            at = some.column(1).to_numpy() - 1
            found = []
            for i in np.flatnonzero((idents[at >> 3] >> (at & 7).astype(np.uint8)) & 1).tolist():
                own = shingles(some.column(0)[i].as_py(), known)
                if len(own) and (sid := set_id(own)) not in done:
                    k = zlib.crc32(sid) % FILTER
                    if names[k >> 3] >> (k & 7) & 1:
                        done.add(sid)
                        found.append((sid, own.tobytes()))
            if found:
                yield batch(LISTED, sid=[x[0] for x in found], data=[x[1] for x in found])

    listed = source.select("text", place("ident").alias("place")).mapInArrow(run, LISTED)
    return written(_judged(pairs, listed, _overlap), "links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    return classes(docs, key, text).drop("mark")


@scoped
def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, heavy: int = HEAVY, hot: int = HOT_LEVEL) -> DataFrame:
    """near_duplicates() with `mark`, a hash of the text that tells rows of one id apart."""
    n_buckets = buckets(docs)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL)).alias("ident"), body.alias("text"), F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("mark"))
    table = written(_sets(source), "sets", "kind")
    rows = table.where("kind = 0").select("doc_id", "mark", "n", "sid")
    points = written(table.where("kind = 0 and sid is not null").groupBy("sid").agg(F.min("ident").alias("ident"), F.max("n").alias("n"), F.max("point").alias("point"), F.count(F.lit(1)).alias("same")), "points")
    levels = _levels(table.where("kind = 1"))
    found = written(_entries(source, levels, n_buckets, hot).groupBy("bucket").applyInArrow(_boxes, FOUND), "found", "kind")

    released(docs.sparkSession)
    partners = found.where("other is not null")
    partners = partners.select("a", "b", "other").unionByName(partners.where("kind = 2").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("reach").alias("other")))
    proposed = partners.groupBy("a").agg(F.max(F.struct("other", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    proposed = written(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "proposed")
    links = _verified(_bounded(proposed, points), points, source)
    labels = components(links)
    released(docs.sparkSession)
    several, n_rows, n_pairs = _several(found, labels)
    round_no = 0
    while n_pairs > heavy * n_rows:
        round_no += 1
        drawn = _meetings(several, n_buckets, round_no, block).groupBy("a").agg(F.min(F.struct(F.xxhash64("a", "b", F.lit(round_no)).alias("order"), "b")).alias("best")).select("a", F.col("best.b").alias("b"))
        new = _verified(_bounded(drawn, points), points, source)
        if not new.limit(1).count():
            break
        links = written(links.unionByName(new), "links")
        labels = components(links)
        several, n_rows, n_pairs = _several(found, labels)
    # All pairs that are left: those of the boxes of two and of larger ones, without those of the first round.
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}"))
    twos = found.where("kind = 2").select("a", "b").distinct().join(proposed, ["a", "b"], "left_anti")
    twos = twos.join(of("a"), "a", "left").join(of("b"), "b", "left").where("not (of_a <=> of_b) or of_a is null").select("a", "b")
    rest = twos.unionByName(_meetings(several, n_buckets, None, block).distinct().join(proposed, ["a", "b"], "left_anti")).distinct()
    rest = _verified(_bounded(rest, points), points, source)
    released(docs.sparkSession)
    if rest.limit(1).count():
        labels = components(links.unionByName(rest))

    sets = points.select("sid", "ident", "same").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    sets = written(sets, "classes")
    smallest = sets.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("ident").alias("component_id"))
    total = rows.count()
    of_set = written(attach(sets, smallest, "label", "size", total).select("sid", "same", "component_id"), "components")
    rows = written(rows, "rows")
    out = attach(rows, of_set, "sid", "same", total)
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.nullif("component_id", F.lit(_NULL)))
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), component.alias("component_id"))


@scoped
def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are the smallest id of their component, with all their columns. A row without an id goes if its component has a row with one; of a component without any id
    the rows with the smallest hash of their text stay. Rows that repeat both id and text stay together; exact dedup is for those.

    The texts are shuffled only if the rows to remove are too many for a broadcast, which Spark decides by their size.
    """
    found = classes(docs, key, text)
    gone = found.where("component_id <> doc_id or (component_id is not null and doc_id is null)").select("doc_id", "mark")
    nameless = found.where("component_id is null")
    if nameless.limit(1).count():
        # Without the ids, such rows' components are found anew with the hash of the text as the id.
        body = F.coalesce(F.col(text).cast("string"), F.lit(""))
        alone = docs.where(F.col(key).cast("long").isNull()).select(F.xxhash64(body).alias("mark"), body.alias("text"))
        alone = alone.join(nameless.select("mark").distinct(), "mark", "left_semi").dropDuplicates(["mark"])
        again = classes(alone, "mark", "text").where("n_shingles > 0 and component_id <> doc_id")
        gone = gone.unionByName(again.select(F.lit(None).cast("long").alias("doc_id"), F.col("doc_id").alias("mark")))
    ident, mark = fresh(docs, "gone_id", "gone_mark")
    gone = written(gone.select(F.col("doc_id").alias(ident), F.col("mark").alias(mark)).distinct(), "gone")
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.join(gone, docs[key].cast("long").eqNullSafe(gone[ident]) & (F.xxhash64(body) == gone[mark]), "left_anti")
