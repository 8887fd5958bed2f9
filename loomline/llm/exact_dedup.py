"""Exact deduplication by progressive refinement, in DataFrame functions only.

1. A first scan counts rows by normalised length. Only lengths that two or more rows share go on.
2. A second scan takes the hash of a short normalised prefix, of rows of such lengths. (length, prefix hash) groups of two or more rows survive.
3. A third scan gives the full hash to rows of surviving groups.
4. Equal full hashes make a group. A group with over a thousandth of all rows is hot; there are fewer than a thousand
   of those, so they are broadcast; the others are joined by hash, each with less than a thousandth of the rows.

Which rows go on is told by a broadcast filter of BUCKETS buckets at most, of lengths and of (length, prefix hash): a row goes on if its bucket does, so a few more rows than
needed are hashed, never fewer, and results do not depend on it. Lengths below BUCKETS have buckets of their own. With far more surviving groups than buckets nearly every row gets
its full hash; what is grouped is still 32 bytes a row.

exact_groups() shuffles keys and hashes only, never texts. exact_dedup() joins the keys to drop back to the documents, which shuffles those unless Spark finds the keys
few enough to broadcast.

A null text counts as empty; texts of white space alone are all equal to it. Rows that repeat a key and text are
rows of their own in group_size, and one of them is kept: of those with the most code points any in exact_groups(), the one with the smallest text in exact_dedup(). A null key sorts
after all others. An empty table gives an empty result. Other columns are never touched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, fresh, scoped, written

#: Characters of the normalised text in the prefix hash.
PREFIX = 128
#: Buckets of the survivors' filter; at most this many broadcast rows.
BUCKETS = 1 << 16
#: A group is hot from this share of the rows on (1 / HOT), so there are fewer than HOT hot groups.
HOT = 1000


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


@scoped
def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False, prefix: int = PREFIX, buckets: int = BUCKETS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Of a group, the row with the most code points in its original text, then the smallest key, stays. text_sha256 is
    the lower-case hex digest of the normalised text in UTF-8, for rows that needed it; digests=True gives it for all.
    """
    source = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.char_length(source).alias("n_chars"), normalised(source).alias("body"))
    rows = rows.withColumn("n_body", F.char_length("body"))

    # Broadcast filters of at most `buckets` rows each.
    lengths = written(rows.groupBy("n_body").agg(F.count(F.lit(1)).alias("n")), "lengths")
    total = sum(r.n for r in lengths.agg(F.sum("n").alias("n")).collect() if r.n)
    by_length = F.pmod(F.col("n_body"), F.lit(buckets)).cast("int")
    shared = lengths.where("n > 1").select(by_length.alias("of_length")).distinct()
    rows = rows.withColumn("of_length", by_length).join(F.broadcast(shared.withColumn("shares", F.lit(True))), "of_length", "left")

    head = F.when(F.col("shares"), F.xxhash64(F.substring("body", 1, prefix)))
    bucket = F.pmod(F.xxhash64("n_body", "head"), F.lit(buckets)).cast("int")
    rows = rows.withColumn("head", head)
    sizes = rows.where("shares").groupBy("n_body", "head").agg(F.count(F.lit(1)).alias("n"))
    wanted = written(sizes.where("n > 1").select(bucket.alias("bucket")).distinct().withColumn("survives", F.lit(True)), "wanted")

    full = F.unhex(F.sha2(F.col("body").cast("binary"), 256))
    hashed = (
        rows.withColumn("bucket", F.when(F.col("shares"), bucket))
        .join(F.broadcast(wanted), "bucket", "left")
        .select("doc_id", "n_chars", F.monotonically_increasing_id().alias("row"), F.col("survives").isNotNull().alias("in_group"), full.alias("full") if digests else F.when(F.col("survives"), full).alias("full"))
    )
    hashed = written(hashed, "hashed")

    best = F.min(F.struct((-F.col("n_chars")).alias("size"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = (
        hashed.where("in_group")
        .groupBy("full")
        .agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
        .where("group_size > 1")
        .select("full", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    )
    hot = F.broadcast(groups.where(F.col("group_size") * HOT > total))
    cold = groups.where(F.col("group_size") * HOT <= total)

    alone = hashed.where("not in_group").withColumns({"group_size": F.lit(1).cast("long"), "keep_id": F.col("doc_id"), "keep_row": F.col("row")})
    grouped = hashed.where("in_group").join(hot, "full", "left")
    rest = grouped.where("group_size is null").drop("group_size", "keep_id", "keep_row").join(cold, "full", "left")
    rest = rest.withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), "keep_row": F.coalesce("keep_row", "row"), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    found = grouped.where("group_size is not null").unionByName(rest).unionByName(alone)
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("full")).alias("text_sha256"))


@scoped
def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. One of equal rows stays where a key is repeated with its text."""
    labels = exact_groups(docs, key, text)
    ident, sha, size, first = fresh(docs, "own_id", "own_sha", "own_size", "own_rank")
    own, body = docs[key].cast("long"), F.coalesce(docs[text].cast("string"), F.lit(""))
    # A key that is repeated needs the digest to tell its rows apart; keys are unique as a rule.
    repeated = bool(labels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())
    if not repeated:
        gone = labels.where("not kept").select(F.col("doc_id").alias(ident))
        return docs.join(gone, own.eqNullSafe(gone[ident]), "left_anti")
    alive = exact_groups(docs, key, text, digests=True).where("kept").select(F.col("doc_id").alias(ident), F.col("text_sha256").alias(sha)).distinct()
    staying = docs.join(alive, own.eqNullSafe(alive[ident]) & (F.sha2(normalised(body).cast("binary"), 256) == alive[sha]), "inner")
    rank = F.row_number().over(Window.partitionBy(ident, sha).orderBy(F.desc(size), text))
    return staying.withColumn(size, F.char_length(F.coalesce(F.col(text).cast("string"), F.lit("")))).withColumn(first, rank).where(F.col(first) == 1).select(*docs.columns)
