"""Benchmark decontamination: short test items inside long documents, by MinHash containment.

Whole-text MinHash compares sets of very different size badly, so the search is on containment: the
items are partitioned by the size of their shingle sets, and a partition's sizes give the length of
its sketches, the smallest hashes of an item (a bottom-k MinHash). At a containment of t an item of n
shingles may miss ``floor((1 - t) n)`` of them, so a document that contains it must hold all but that
many of the sketch. Sketches are longer than that by a margin, hence no containing document is ever
missed; every candidate is then verified by counting shared shingles exactly. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.common import keep, same, table, whole

SHINGLE = 5
THRESHOLD = 0.8
#: Part of an item's shingles that a sketch holds beyond those that may be missing.
MARGIN = 0.2
#: Sketch rows (three numbers each) up to which they are broadcast; more are joined by shuffling.
BROADCAST_ROWS = 200_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingles(words: Column, size: int = SHINGLE) -> Column:
    """The word shingles of a text as text, repeats included; none for fewer words."""
    count = F.size(words) - size + 1
    return F.when(
        count > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.concat_ws(" ", *[F.element_at(words, i + j) for j in range(size)])),
    ).otherwise(F.array().cast("array<string>"))


def _missing(count: Column, threshold: float) -> Column:
    """How many of ``count`` shingles a containing document may lack."""
    return count - F.ceil(F.lit(threshold).cast("decimal(6,4)") * count).cast("int")


def items(benchmark: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """``(item_id, text_id, n, parts, k, spare)``: distinct shingles of every item, the length of its
    size partition's sketch and how many of its sketch a document may lack."""
    rows = same(benchmark, ["item_id", "text"]).select("item_id", _words(F.col("text")).alias("words"))
    rows = rows.select("item_id", F.array_distinct(shingles(F.col("words"), size)).alias("parts")).distinct().withColumn("n", F.size("parts")).where("n > 0")
    top = F.pow(F.lit(2), F.ceil(F.log2(F.col("n")))).cast("int")  # sizes in (top / 2, top]
    rows = rows.withColumn("spare", _missing(F.col("n"), threshold))
    sketch = F.least(F.col("n"), _missing(top, threshold) + 1 + F.floor(top * MARGIN).cast("int"))
    named = rows.select("item_id", F.xxhash64("item_id", "parts").alias("text_id"), "n", "parts", sketch.alias("k"), "spare")
    return named.dropDuplicates(["text_id"])


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)`` for every document and item of which
    at least ``threshold`` of the item's distinct word shingles occur in the document.

    Words are what lies between ASCII blanks, in lower case. Items of fewer than ``size`` words and
    null texts have no shingles and are never found. Rows that share a doc_id are one document with
    the shingles of each; null ids are an id like any other. Equal rows of either table count once,
    rows of one item_id with different texts are items of their own. Other columns are ignored; an
    empty table gives an empty result.
    """
    wanted = keep(items(benchmark, threshold, size), "items")
    hashes = F.array_sort(F.transform("parts", lambda p: F.xxhash64(p)))
    sketches = keep(wanted.select("text_id", F.explode(F.slice(hashes, F.lit(1), F.col("k"))).alias("h")), "sketches")
    total, highest = sketches.agg(F.count("*"), F.max("h")).first()
    rows = same(docs, ["doc_id", "text"]).select("doc_id", _words(F.col("text")).alias("words"))
    probes = rows.select("doc_id", F.explode(shingles(F.col("words"), size)).alias("part")).select("doc_id", F.xxhash64("part").alias("h"))
    if highest is not None:
        probes = probes.where(F.col("h") <= highest)
    known = F.broadcast(sketches) if total <= broadcast_rows else sketches
    hits = probes.join(known, "h").groupBy("doc_id", "text_id").agg(F.countDistinct("h").alias("hits"))
    need = wanted.select("text_id", "item_id", "n", "parts", (F.col("k") - F.col("spare")).alias("need"))
    likely = keep(hits.join(need.select("text_id", "need"), "text_id").where("hits >= need").select("doc_id", "text_id"), "candidates")
    chosen = likely.select(F.col("doc_id").alias("chosen")).distinct()
    texts = rows.join(chosen, F.expr("doc_id <=> chosen"), "left_semi")
    whole = texts.select("doc_id", F.array_distinct(shingles(F.col("words"), size)).alias("held"))
    checked = likely.join(need.drop("need"), "text_id").alias("c").join(whole.alias("w"), F.expr("c.doc_id <=> w.doc_id"))
    shared = checked.select("c.doc_id", "text_id", "item_id", "n", F.explode(F.array_intersect("parts", "held")).alias("part"))
    counted = shared.groupBy("doc_id", "text_id", "item_id", "n").agg(F.countDistinct("part").alias("n_shared"))
    found = counted.where(F.col("n_shared") >= F.ceil(F.lit(threshold).cast("decimal(6,4)") * F.col("n")))
    return found.select("doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that contain no test item, with all their columns, whatever their names.
    Rows that share a doc_id, or have none, are one document and go together; null and empty texts
    stay; no items or no rows leave ``docs`` as it is."""
    found = contained(docs, benchmark, **options).select("doc_id").distinct()
    return whole(docs).alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id"), "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = """
WITH w AS (
  SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item_id, hash(w) AS text_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS part
  FROM w WHERE len(w) >= 5
), n AS (
  SELECT item_id, text_id, count(*) AS n FROM i GROUP BY ALL
), d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS part
  FROM d WHERE len(w) >= 5
), c AS (
  SELECT doc_id, item_id, text_id, count(*) AS n_shared FROM i JOIN s USING (part) GROUP BY ALL
)
SELECT doc_id, item_id, n AS n_shingles, n_shared, n_shared / n AS containment
FROM c JOIN n USING (item_id, text_id) WHERE 5 * n_shared >= 4 * n
"""
