"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is 13 consecutive words of an item (an item of fewer words is one window). Windows and
documents are seen as sequences of word shingles. A document that holds a window holds all its
shingles, so of the shingles ordered by rarity in the corpus the first alone is a necessary
prefix. The prefixes are joined with the documents' shingles; place and length then leave one
possible stretch of words, which is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.llm.common import filter_bits, giving_back, map_text, passes
from tillworks.llm.hashing import WordHashes, shingles, word_bytes
from tillworks.session import settle

WINDOW = 13
SHINGLE = 5

def _window_rows(benchmark: DataFrame) -> DataFrame:
    """item_id, words (the window, joined by blanks), n, size of its shingles, their hashes."""
    schema = T.StructType([
        T.StructField("item_id", T.StringType()), T.StructField("words", T.StringType()),
        T.StructField("n", T.IntegerType()), T.StructField("k", T.IntegerType()),
        T.StructField("hashes", T.ArrayType(T.LongType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        known, letters, arrow = WordHashes(), word_bytes(), to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().translate(letters).split()
                for at in range(max(1, len(words) - WINDOW + 1) if words else 0):
                    part = words[at: at + WINDOW]
                    k = min(SHINGLE, len(part))
                    hashes = shingles(known.of(part), k).view(np.int64).tolist()
                    rows.append((item, b" ".join(part).decode(), len(part), k, hashes))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    named = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    return named.select(F.col("item_id").cast("string"), "text").mapInArrow(giving_back(run), schema)


def _hits(shared, sizes: list[int]):
    """A function from the words of a text to (place, shingle size, hash) that pass the filter."""
    kept, known = passes(shared.value), WordHashes()

    def find(words: list[bytes]) -> list[tuple[np.ndarray, int, np.ndarray]]:
        hashes = known.of(words)
        found = []
        for k in sizes:
            all_of = shingles(hashes, k)
            at = np.flatnonzero(kept(all_of))
            if len(at):
                found.append((at, k, all_of[at].view(np.int64)))
        return found

    return find


def _counts(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """How often each shingle that passes the filter occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        find, letters = _hits(shared, sizes), word_bytes()
        for batch in batches:
            found = [h for text in batch.column(0).cast(pa.binary()).to_pylist() if text
                     for _, _, h in find(text.translate(letters).split())]
            if found:
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), pa.array(n)], names=["hash", "n"])

    return docs.select("text").mapInArrow(giving_back(run), "hash long, n long").groupBy("hash").agg(
        F.sum("n").alias("n"))


def _candidates(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """Adds n_words and the places whose shingle passes, each with the words around it."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    place = T.StructType([
        T.StructField("hash", T.LongType()), T.StructField("at", T.IntegerType()),
        T.StructField("from", T.IntegerType()), T.StructField("around", T.StringType())])
    added = [T.StructField("n_words", T.LongType()),
             T.StructField("places", T.ArrayType(place))]

    def start():
        find, letters = _hits(shared, sizes), word_bytes()

        def around(words: list[bytes], at: int, k: int, value: int) -> dict:
            first = max(0, at - (WINDOW - k))
            near = b" ".join(words[first: at + WINDOW]).decode("utf-8", "replace")
            return {"hash": value, "at": at, "from": first, "around": near}

        def work(texts: list) -> dict:
            lengths, places = [], []
            for text in texts:
                words = text.translate(letters).split() if text else []
                lengths.append(len(words))
                places.append([
                    around(words, at, k, value) for ats, k, values in find(words)
                    for at, value in zip(ats.tolist(), values.tolist())])
            return {"n_words": lengths, "places": places}

        return work

    return map_text(docs, "text", added, start)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Documents with NULL or empty text have no words and are clean. Items with NULL id or without
    words have no window; rows that repeat an item count once. Each row of ``docs`` is judged for
    itself, repeated or NULL ids included. Of ``docs`` only doc_id and text are read.

    Neither side is broadcast but for the filter, whose size is fixed. The join's smaller side is
    written, so Spark knows its size, and it splits a shingle that very many documents share.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    windows = settle(_window_rows(benchmark), "windows")
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect())
    each = windows.select("words", "n", F.posexplode("hashes").alias("offset", "hash")).distinct()
    counts = settle(_counts(docs, filter_bits(each.select("hash")), sizes), "counts")
    # windows with a shingle that no document holds occur nowhere
    rarest = (
        each.join(counts.withColumnRenamed("n", "freq"), "hash", "left")
        .groupBy("words", "n")
        .agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "offset", "hash"))
             .alias("first"))
        .filter(F.col("first.freq") > 0))
    probes = settle(rarest.select("words", "n", "first.offset", "first.hash"), "probes")
    judged = settle(
        _candidates(texts, filter_bits(probes), sizes)
        .withColumn("row", F.monotonically_increasing_id()), "candidates")

    spots = judged.select("row", "n_words", F.inline("places"))
    first = F.col("at") - F.col("offset")
    stretch = F.slice(F.split("around", " "), first - F.col("from") + 1, F.col("n"))
    found = settle(
        spots.join(probes, "hash")
        .filter((first >= F.col("from")) & (first + F.col("n") <= F.col("n_words")))
        .filter(F.array_join(stretch, " ") == F.col("words"))
        .select("row", "words", first.alias("first"), (first + F.col("n")).alias("end"))
        .distinct(), "found")
    upto = F.max("end").over(
        Window.partitionBy("row").orderBy("first", "end")
        .rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("end") - F.greatest("first", F.least("end", F.coalesce(upto, F.lit(0))))
    hit = found.withColumn("new", F.greatest(new, F.lit(0))).groupBy("row").agg(
        F.sum("new").alias("n_hit"))
    items = (
        found.select("row", "words").distinct()
        .join(windows.select("words", "item_id").distinct(), "words")
        .groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    none = F.array().cast("array<string>")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        judged.drop("places").join(hit.join(items, "row"), "row", "left")
        .withColumn("items", F.coalesce("items", none))
        .select(
            "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"), "items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = settle(
        contamination(docs, benchmark).filter("contaminated")
        .select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct(), "bad")
    same: Column = docs["doc_id"].eqNullSafe(bad["_doc"]) & (
        F.xxhash64(docs["text"]) == bad["_hash"])
    return docs.join(bad, same, "left_anti")


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).drop("text_hash", "items")


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL
), starts AS (
  SELECT item_id, words, least(13, len(words)) AS n,
    unnest(range(1, greatest(1, len(words) - 12) + 1)) AS pos FROM items WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(words[pos : pos + n - 1], ' ') AS w FROM starts
), lengths AS (SELECT DISTINCT n FROM windows
), places AS (
  SELECT rn, words, n, unnest(range(1, len(words) - n + 2)) AS pos FROM docs, lengths
  WHERE len(words) >= n
), found AS (
  SELECT rn, pos, p.n, item_id FROM places p JOIN windows w
  ON p.n = w.n AND array_to_string(p.words[pos : pos + p.n - 1], ' ') = w.w
), hit AS (
  SELECT rn, count(DISTINCT spot) AS n_hit
  FROM (SELECT rn, unnest(range(pos, pos + n)) AS spot FROM found) GROUP BY rn
), named AS (
  SELECT rn, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rn, item_id FROM found) GROUP BY rn
)
SELECT doc_id, coalesce(len(words), 0) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(words), 0) AS contaminated
FROM docs LEFT JOIN hit USING (rn) LEFT JOIN named USING (rn)
"""
