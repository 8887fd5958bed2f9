"""What the operators of this subpackage share: written tables, Arrow passes, cached word hashes."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path

#: The six ASCII white-space characters [\x20\x09-\x0D]; bytes.split() splits at exactly these.
SPACES = " \t\n\x0b\x0c\r"
#: Entries that a worker's caches hold before they start anew; bounds memory whatever the vocabulary.
CACHE_ENTRIES = 250_000


#: Tables written since the innermost scoped() call began.
_scratch: list[list[str]] = []


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs no recomputation. by: a column of few values that readers select on.
    In a scoped() operator the table is deleted when the operator's result does not read it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _scratch:
        _scratch[-1].append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> set[str]:
    """Folders that the plan of df reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            found |= {paths.apply(k).toString() for k in range(paths.size())}
    return found


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm = spark.sparkContext._jvm
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Delete a written() table that nothing will read again."""
    _delete(df.sparkSession, _folders(df))


def released(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nobody holds any more; it does so when the driver's JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scoped(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose written() tables live only as long as they are needed: those that its result does not read are deleted when it returns, and so are the shuffle files
    of its finished steps. What the result reads stays, for the caller's scope if there is one."""

    @wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        _scratch.append([])
        try:
            out = operator(*args, **kwargs)
        except BaseException:
            _scratch.pop()
            raise
        own = _scratch.pop()
        read = set(map(_name, _folders(out)))
        if _scratch:
            _scratch[-1].extend(path for path in own if _name(path) in read)
        _delete(out.sparkSession, [path for path in own if _name(path) not in read])
        released(out.sparkSession)
        return out

    return run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each lengthened until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def batch(schema: str, **columns) -> pa.RecordBatch:
    """A record batch of the named columns; schema is the flat DDL given to mapInArrow."""
    arrays, names = [], []
    for field in schema.split(","):
        name, kind = field.split()
        values, want = columns[name], _TYPES[kind]
        if isinstance(values, pa.Array):
            arrays.append(values if values.type == want else values.cast(want))
        else:
            arrays.append(pa.array(values, type=want))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


#: What tasks of a worker that follow each other share; one thing at a time.
_kept: dict = {}


def kept(key, make: Callable):
    """The worker's make() for this key, made again when another key or a WordHashes has taken its place."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


class WordHashes(dict):
    """Word -> 64-bit hash, cached; starts anew when it is full. A task that has one needs the worker's memory: what other operators' tasks kept there goes."""

    def __init__(self):
        super().__init__()
        _kept.clear()
        pa.default_memory_pool().release_unused()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: Multiplier of the window hashes: odd, so it can be inverted modulo 2**64.
MULTIPLIER = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of MULTIPLIER and of its inverse, modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << max(16, (n - 1).bit_length())

        def up_to(base: int) -> np.ndarray:
            steps = np.full(size, np.uint64(base), np.uint64)
            steps[0] = 1
            return np.cumprod(steps)

        _powers, _inverse = up_to(MULTIPLIER), up_to(pow(MULTIPLIER, -1, 1 << 64))
    return _powers[:n], _inverse[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a window hash depends on all words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of `width` consecutive word hashes; empty if there are fewer words."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * down[: n - width + 1])


#: Bytes of a text whose words are listed at once.
SEGMENT = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def word_segments(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a segment at a time: memory follows the segment, not the text."""
    start = 0
    while len(data) - start > SEGMENT and (found := _SPACE.search(data, start + SEGMENT)):
        yield data[start : found.start()].split()
        start = found.start()
    yield data[start:].split()


def word_hashes(data: bytes, known: WordHashes) -> np.ndarray:
    """64-bit hash of each word of a text."""
    parts = [np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) for words in word_segments(data)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def spans(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin of each run of equal keys, and the run that each place is in."""
    first = np.empty(len(sorted_keys), bool)
    first[:1] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=first[1:])
    return np.flatnonzero(first), np.cumsum(first) - 1


#: Bytes of input files for which one more bucket is made; what an operator sends of a text is no more than the text.
BUCKET_BYTES = 32 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, of all their columns; 0 where that is not known."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def buckets(df: DataFrame) -> int:
    """Parts that hashes of df's texts are dealt into: they follow the size of its files, so a part fits a task at any size; at least as many as the session's shuffles have."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // BUCKET_BYTES))


def key_columns(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text, under names that no other column can clash with."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


#: A group with over one in HOT of all rows is hot; there are fewer than HOT of those.
HOT = 1000


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left-joined to one row per key of groups, where groups[size] says how many rows have the key.

    The fewer than HOT hot groups are broadcast and their rows stay where they are; other keys are shuffled, each with at most one in HOT of
    the rows. Rows without a group skip the shuffle only if their key is null. `rows` is read three times: give a written() table.
    """
    groups = groups.withColumnRenamed(key, "_key")
    extra = [c for c in groups.columns if c != "_key"]
    hot = F.broadcast(groups.where(F.col(size) * HOT > total))
    cold = groups.where(F.col(size) * HOT <= total)
    first = rows.join(hot, rows[key] == hot["_key"], "left")
    done = first.where("_key is not null or " + f"{key} is null").drop("_key")
    rest = first.where(f"_key is null and {key} is not null").drop("_key", *extra)
    return done.unionByName(rest.join(cold, rest[key] == cold["_key"], "left").drop("_key"))
