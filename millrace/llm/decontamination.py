"""Benchmark decontamination (operator 7): size-partitioned MinHash containment search, in DataFrame functions only.

Words are runs of letters and digits after lower-casing, shingles are five words.  A document is contaminated by an
item if it holds at least `containment` of the item's distinct shingles.

Items are partitioned by size, in powers of two.  An item's sketch is its bottom-s MinHash: the shingles with the
s smallest hashes, where s = floor((1 - containment) * n) + 1.  A document that holds enough of the item cannot
lack all s of them, so a document that holds none is no match: the search loses nothing.  Each size class has the
largest hash that any of its sketches holds as its bound, and a document's shingles only meet the sketches of
classes whose bound they reach, so long items cost a long document few shingles.  Documents are taken whole.

Candidates are verified by the exact shingles, as strings.

Scale.  One scan shingles all documents where they lie.  The sketches are written, so Spark knows their size and
broadcasts them only if it is under its threshold; otherwise the shingles are shuffled to them, and adaptive
execution splits a shingle that very many documents hold.  Matches are counted per (document, item) with
pre-aggregation: their number grows with the documents, not with the square of a group.

Defined cases: null texts are empty; items of fewer than five words have no shingles and match nothing; an item
that several rows repeat matches under each id; rows that repeat an id, or have none, are documents of their own.
Empty tables give no matches.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free_name, plain, with_key, written

GRAM = 5


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def _grams(words_col: str, make: str) -> Column:
    """make: SQL of a shingle from w and words[i+1] to words[i+4]."""
    later = ", ".join(f"{words_col}[i + {k}]" for k in range(1, GRAM))
    return F.expr(f"IF(size({words_col}) < {GRAM}, array(), transform(slice({words_col}, 1, size({words_col}) - {GRAM - 1}), (w, i) -> {make.format(later=later)}))")


def hashes(words_col: str) -> Column:
    return _grams(words_col, "xxhash64(w, {later})")


def strings(words_col: str) -> Column:
    return F.array_distinct(_grams(words_col, "concat_ws(' ', w, {later})"))


def sketches(items: DataFrame, containment: float) -> DataFrame:
    """(_item, h, bound): the sketch of every item and the bound of its size class. items: _item, shingles."""
    ranked = items.select("_item", F.size("shingles").alias("n"), F.expr("array_sort(transform(shingles, s -> xxhash64(split(s, ' ')[0], split(s, ' ')[1], split(s, ' ')[2], split(s, ' ')[3], split(s, ' ')[4])))").alias("all"))
    cut = ranked.where("n > 0").select(
        "_item",
        F.ceil(F.log2("n")).alias("class"),
        # A hair more than the exact share, so that rounding never shortens a sketch.
        F.expr(f"slice(all, 1, least(n, cast(floor({1 - containment + 1e-9}D * n) as int) + 1))").alias("least"),
    )
    bounds = cut.groupBy("class").agg(F.max(F.element_at("least", -1)).alias("bound"))
    return cut.join(bounds, "class").select("_item", "bound", F.explode("least").alias("h"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", containment: float = 0.8) -> DataFrame:
    """One row for each match: doc_id, item_id, n_shingles (the item's), n_shared, containment, _key."""
    keyed = with_key(plain(docs, id_col, text_col), id_col, "decontamination")
    texts = keyed.select("_key", F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    known = with_key(plain(items, item_col, item_text_col), item_col, "benchmark").select(F.col("_key").alias("_item"), F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("item_words"))
    known = written(known.select("_item", "item_id", strings("item_words").alias("shingles")), "items")
    sketch = written(sketches(known, containment), "sketches")
    # A document's shingles reach the sketches of every class whose bound is no smaller.
    largest = sketch.agg(F.max("bound")).first()[0]
    shingled = texts.select("_key", F.explode(hashes("words")).alias("h")).where(F.col("h") <= F.lit(largest if largest is not None else -(1 << 63)))
    candidates = written(shingled.join(sketch, (shingled["h"] == sketch["h"]) & (shingled["h"] <= sketch["bound"])).select("_key", "_item").distinct(), "candidates")
    by_doc = candidates.join(known, "_item").select("_key", "item_id", "shingles")
    # Few documents are candidates: their keys go to the texts, as a broadcast or a Bloom filter where Spark finds them small.
    asked = written(candidates.select("_key").distinct(), "candidate-keys")
    texts = keyed.join(asked, "_key", "left_semi").select("_key", F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    pairs = by_doc.join(texts, "_key").select("_key", "doc_id", "item_id", "shingles", strings("words").alias("own"))
    counted = pairs.select("_key", "doc_id", "item_id", F.size("shingles").alias("n_shingles"), F.size(F.array_intersect("shingles", "own")).alias("n_shared"))
    return counted.where(F.col("n_shared") >= F.lit(containment - 1e-9) * F.col("n_shingles")).select(
        "doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.col("n_shared").cast("long").alias("n_shared"), (F.col("n_shared") / F.col("n_shingles")).alias("containment"), "_key"
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs without contaminated rows; all its columns stay."""
    key = free_name(docs.columns, "_key")
    keyed = with_key(docs, id_col, "decontamination-rows", key)
    inner = keyed.select(F.col(key).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    found = contamination(inner, items, "_row", "_text", **settings).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(found, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
b AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS t(i)),
bs AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS g FROM b, unnest(range(1, len(w) - 3)) AS t(i)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT ds.doc_id, bs.item_id, n.n_shingles, count(*) AS n_shared, count(*)::DOUBLE / n.n_shingles AS containment
FROM ds JOIN bs USING (g) JOIN n ON n.item_id = bs.item_id
GROUP BY ds.doc_id, bs.item_id, n.n_shingles
HAVING count(*) >= 0.8 * n.n_shingles
"""
