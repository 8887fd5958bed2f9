"""Evidence vault: alias resolution, evidence upserts, activity, merged characters.

Insertion order is part of the meaning: an alias belongs to the first that claimed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIVE_LINES = 80
RECENT_LINES = 5


def alias_owners(characters: DataFrame) -> DataFrame:
    """alias, owner: of characters (name, aliases, ord) that claim an alias, the first."""
    claims = characters.select("name", "ord", F.explode("aliases").alias("alias"))
    return claims.groupBy("alias").agg(F.min_by("name", "ord").alias("owner"))


def resolve(names: DataFrame, characters: DataFrame, name: str = "name", canonical_first: bool = True) -> DataFrame:
    """names with `resolved`: itself if it is a character, else the alias's owner, else unchanged; canonical_first=False asks aliases first."""
    known = characters.select(F.col("name").alias("_known")).distinct()
    owners = alias_owners(characters).select(F.col("alias").alias("_alias"), F.col("owner").alias("_owner"))
    joined = names.join(known, names[name] == F.col("_known"), "left").join(owners, names[name] == F.col("_alias"), "left")
    order = ("_known", "_owner") if canonical_first else ("_owner", "_known")
    return joined.withColumn("resolved", F.coalesce(*map(F.col, order), F.col(name))).drop("_known", "_alias", "_owner")


def fresh_evidence(evidence: DataFrame, keys: tuple[str, ...] = ("name", "line_no"), order: str = "ord") -> DataFrame:
    """The first evidence of each character and line; later ones add nothing."""
    return evidence.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def unseen_evidence(evidence: DataFrame, held: DataFrame, keys: tuple[str, ...] = ("name", "line_no")) -> DataFrame:
    return evidence.join(held.select(*keys).distinct(), list(keys), "left_anti")


def upsert(evidence: DataFrame) -> DataFrame:
    """One row per character of (name, alias, verified, line_no, introduces, ord): aliases in order of arrival and without the name itself,
    status (once verified, always), evidence lines, first introduction, last line seen (0 without evidence). Only a character's different aliases are gathered, not its rows."""
    first = evidence.where("alias is not null and alias <> name").groupBy("name", "alias").agg(F.min("ord").alias("ord"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "alias"))), lambda x: x["alias"])
    aliases = first.groupBy(F.col("name").alias("_name")).agg(ordered.alias("aliases"))
    facts = evidence.groupBy("name").agg(
        F.when(F.max("verified"), "verified").otherwise("candidate").alias("status"),
        F.count_distinct("line_no").alias("evidence"),
        F.min(F.when(F.col("introduces"), F.col("line_no"))).alias("introduction_line"),
        F.coalesce(F.max("line_no"), F.lit(0)).alias("last_seen_line"),
    )
    joined = facts.join(aliases, facts["name"].eqNullSafe(aliases["_name"]), "left")
    return joined.select("name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "status", "evidence", "introduction_line", "last_seen_line")


def update_last_seen(vault: DataFrame, mentions: DataFrame) -> DataFrame:
    """vault (upsert() rows) after mentions (name, line_no): a mention by an alias is its owner's (the first character by name that has it), one of nobody known makes a
    candidate without evidence."""
    owners = vault.select("name", F.explode("aliases").alias("alias")).groupBy("alias").agg(F.min("name").alias("owner"))
    known = vault.select(F.col("name").alias("_known"))
    found = mentions.groupBy("name").agg(F.max("line_no").alias("line_no"))
    found = found.join(known, found["name"] == F.col("_known"), "left").join(owners, found["name"] == owners["alias"], "left")
    seen = found.groupBy(F.coalesce("_known", "owner", "name").alias("name")).agg(F.max("line_no").alias("_seen"))
    merged = vault.join(seen, "name", "full")
    return merged.select(
        "name",
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        F.coalesce("status", F.lit("candidate")).alias("status"),
        F.coalesce("evidence", F.lit(0)).cast("bigint").alias("evidence"),
        "introduction_line",
        F.greatest(F.coalesce("last_seen_line", F.lit(0)), F.coalesce("_seen", F.lit(0))).alias("last_seen_line"),
    )


def newest(rows: DataFrame, key: str, line: str, text: str, keep: int = RECENT_LINES) -> DataFrame:
    """key, recent: the last `keep` of each key as array(struct(line, text)), newest first. Others leave before the shuffle."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(line)))).where(F.col("_n") <= keep)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(line).alias("line"), F.col(text).alias("text"))), False).alias("recent"))


def merge_vaults(held: DataFrame, new: DataFrame) -> DataFrame:
    """Two upsert() results as one; evidence counts add up, so `new` must hold unseen evidence only."""
    rows = held.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    aliases = F.transform(F.sort_array(F.collect_list(F.struct("_o", "aliases"))), lambda x: x["aliases"])
    return rows.groupBy("name").agg(
        F.array_distinct(F.flatten(aliases)).alias("aliases"),
        F.when(F.max(F.col("status") == "verified"), "verified").otherwise("candidate").alias("status"),
        F.sum("evidence").alias("evidence"),
        F.min("introduction_line").alias("introduction_line"),
        F.max("last_seen_line").alias("last_seen_line"),
    )


def seen_before(mentions: DataFrame, key: str, order: str, position: str) -> DataFrame:
    """mentions with `last_seen`: the greatest position of the same character in earlier mentions; null at the first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return mentions.withColumn("last_seen", F.max(position).over(w))


def active(current, last_seen, within: int = ACTIVE_LINES):
    """Seen fewer than `within` lines ago; never if not seen at all."""
    return F.coalesce(last_seen, F.lit(0)).cast("boolean") & (current - last_seen < within)


def extent(mentions: DataFrame, key: str, position: str) -> DataFrame:
    return mentions.groupBy(key).agg(F.min(position).alias("first_seen"), F.max(position).alias("last_seen"), F.count(F.lit(1)).alias("mentions"))


def merge_characters(states: DataFrame, reveals: DataFrame, keep: int = RECENT_LINES) -> DataFrame:
    """states (name, first_seen, last_seen, recent array(struct(line, text))) with each revealed name's state folded into its real one's (reveals: name, real)."""
    named = states.join(reveals, "name", "left").withColumn("_to", F.coalesce("real", "name"))
    recent = F.sort_array(F.flatten(F.collect_list("recent")))
    size = F.least(F.lit(keep), F.size("recent"))
    merged = named.groupBy(F.col("_to").alias("name")).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), recent.alias("recent"))
    return merged.withColumn("recent", F.when(F.size("recent") > 0, F.slice("recent", -size, keep)).otherwise(F.col("recent")))


def render(vault: DataFrame, current: int, within: int = ACTIVE_LINES, shown: int = 2, length: int = 60) -> DataFrame:
    """name, text of the active characters of (name, aliases, status, evidence array(struct(text, line)), last_seen_line)."""
    known = F.when(F.size("aliases") > 0, F.concat(F.lit(" (aka: "), F.array_join("aliases", ", "), F.lit(")"))).otherwise("")
    head = F.concat(F.lit("  ["), F.upper("status"), F.lit("] "), F.col("name"), known)
    facts = F.transform(F.slice("evidence", 1, shown), lambda e: F.concat(F.lit("     L"), e["line"].cast("string"), F.lit(": "), F.left(e["text"], F.lit(length))))
    last = F.concat(F.lit("     last seen: ~L"), F.col("last_seen_line").cast("string"))
    return vault.where(active(F.lit(current), F.col("last_seen_line"), within)).select("name", F.array_join(F.concat(F.array(head), facts, F.array(last)), "\n").alias("text"))
