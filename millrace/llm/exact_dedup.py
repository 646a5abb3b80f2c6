"""Exact deduplication by deterministic block naming (operator 3), in DataFrame functions only.

Texts are equal when identical after every character of [\\x20\\x09-\\x0D] is deleted.  The rest is cut
into fixed-size blocks; the distinct blocks are sorted and numbered, and adjacent pairs of numbers are
numbered again in the same way, level by level, until one number is left.  Two texts get the same
(block count, number) exactly if they are equal: numbers stand for strings one to one, nothing is hashed.

Every text is named by its blocks.  What is shuffled as a string is each distinct block, once, to be sorted; the
names come back by two 64-bit hashes of the block.  That is exact, as it is checked that no two distinct blocks have
the same pair of hashes; if two had, names would come back by the blocks themselves.

Scale.  Every grouping pre-aggregates, so a text held by a third of all rows is one row per task; the joins that
hand names and group sizes back read written tables, so adaptive execution can split a hot key.  The levels after the
first are numbers only.  Their number is the logarithm of the longest text.

Defined cases.  Null text counts as empty; empty texts are equal to each other.  Of equal texts the row
with the most code points stays, then the smallest id (null ids last).  Rows that repeat an id, or have
none, are documents of their own; among equal rows with the same id one stays.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free_name, plain, release, with_key, written

#: The white space that does not count, as SQL's translate() takes it.
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text's bytes without white space."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "").cast("binary")


def named(items: DataFrame, cols: list[str], **keep: Column) -> DataFrame:
    """The distinct values of cols, sorted where their hash deals them and numbered in that order: `keep` and `name`."""
    ranked = items.select(*cols).distinct().sortWithinPartitions(*cols)
    return ranked.select(*[c.alias(n) for n, c in keep.items()], F.monotonically_increasing_id().alias("name"))


def blocks_of(norm: Column, block: int) -> Column:
    """The blocks of a normalised text, `block` bytes each; the empty text is one empty block.  norm is a column, so that
    it is not made again for each block; a block of bytes is found without reading what is before it."""
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(norm) / F.lit(float(block))).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(norm, i * block + 1, F.lit(block)))


def _pair(block: Column) -> dict[str, Column]:
    return {"one": F.xxhash64(block), "two": F.xxhash64(F.lit(1), block)}


def identities(texts: DataFrame, block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(_key, n_blocks and name: equal for two rows exactly if their texts are; the other columns of texts, and _key).
    texts: _key, norm and further columns."""
    blocks = blocks_of(F.col("norm"), block)
    about = texts.select(*[c for c in texts.columns if c != "norm"], F.transform(blocks, lambda b: F.struct(*[c.alias(n) for n, c in _pair(b).items()])).alias("pairs"))
    about = written(about, "about")
    each = texts.select("_key", F.posexplode(blocks).alias("at", "block"))
    names = written(named(each, ["block"], **_pair(F.col("block"))), "block-names")
    if names.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        level = about.select("_key", F.posexplode("pairs").alias("at", "pair")).select("_key", "at", "pair.*").join(names, ["one", "two"])
    else:
        release(names)
        names = written(named(each, ["block"], block=F.col("block")), "block-names")
        level = each.join(names, "block")
    level = written(level.select("_key", "at", "name"), "level")
    release(names)
    return folded(level), about.drop("pairs")


def folded(level: DataFrame) -> DataFrame:
    """_key, n_blocks and name of every text, from the names of its blocks (_key, at, name)."""
    # A text of one block is done; for the others adjacent pairs are named, as long as any has more than one name left.
    counts = level.groupBy("_key").agg(F.count(F.lit(1)).alias("n_blocks"), F.max("name").alias("name"))
    counts = written(counts, "block-counts")
    done = counts.where("n_blocks = 1")
    level = written(level.join(counts.where("n_blocks > 1").select("_key", "n_blocks"), "_key"), "level")
    longest, width = counts.agg(F.max("n_blocks")).first()[0] or 1, 1
    while width < longest:
        # One row for each pair; a last name without a partner is paired with -1.
        pairs = level.groupBy("_key", "n_blocks", F.expr("at div 2").alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")
        )
        pairs = written(pairs, "pairs")
        names = written(named(pairs, ["left", "right"], left=F.col("left"), right=F.col("right")), "pair-names")
        after = written(pairs.join(names, ["left", "right"]).select("_key", "n_blocks", "at", "name"), "level")
        release(level, pairs, names)
        width *= 2
        done = done.unionByName(after.where(F.col("n_blocks") <= width).select("_key", "n_blocks", "name"))
        level = after.where(F.col("n_blocks") > width)
    return done


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_code_points, _key."""
    keyed = with_key(plain(docs, id_col, text_col).toDF("doc_id", "text"), "doc_id", "exact-dedup")
    text = F.col("text").cast("string")
    texts = keyed.select("_key", "doc_id", F.length(F.coalesce(text, F.lit(""))).alias("n_code_points"), normalised(text).alias("norm"))
    names, about = identities(texts.withColumn("text_sha256", F.sha2("norm", 256)))
    rows = written(about.join(names, "_key"), "identities")
    same = ["n_blocks", "name"]
    # The most code points stay, then the smallest key, which is in the order of the ids.
    best = F.max(F.struct(F.col("n_code_points").alias("n"), (-F.col("_key")).alias("k"), F.col("doc_id").alias("id")))
    # Written, so that the join has an exchange of its own on either side and a hot group can be split.
    groups = written(rows.groupBy(*same).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")
    out = rows.join(groups, same, "left")
    return out.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("best").isNull() | (F.col("best.k") == -F.col("_key"))).alias("kept"),
        "text_sha256",
        "n_code_points",
        "_key",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; all its columns stay."""
    key = free_name(docs.columns, "_key")
    keyed = with_key(docs, id_col, "exact-dedup-rows", key)
    found = exact_dedup(keyed.select(F.col(key).alias("_row"), F.col(f"`{text_col}`").alias("_text")), "_row", "_text")
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias(key))
    return keyed.join(dropped, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
