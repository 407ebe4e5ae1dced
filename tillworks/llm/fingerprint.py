"""Document fingerprints: SimHash over word pairs, and a search by permuted block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.llm.common import fields, partitions
from tillworks.llm.hashing import WordHashes, word_set, shingles
from tillworks.session import settle

BITS = 64
TERM = 2  # words of a term
RADIUS = 3
BLOCKS = 5  # of which RADIUS changed bits leave two untouched
_LOT = 1 << 15
_QUERY_STEP = 50


def simhash(text: str, known: WordHashes) -> int:
    """Weighted term hashes vote on the sign of each bit.

    Terms are pairs of words (white space apart, A-Z lower-cased), a lone word is its own term; a
    term weighs 16 * (1 + ln of its occurrences), rounded, so all sums are exact. Ties and a text
    without words: bit 0.
    """
    hashes = known.of(text.encode("utf-8", "replace").lower().split())
    terms = shingles(hashes, TERM) if len(hashes) >= TERM else word_set(hashes, TERM)
    terms, n = np.unique(terms, return_counts=True)
    weights = np.rint(16 * (1 + np.log(n))).astype(np.float32)
    ones = np.zeros(BITS)
    for at in range(0, len(terms), _LOT):
        lot = np.unpackbits(terms[at: at + _LOT].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += weights[at: at + _LOT] @ lot.astype(np.float32)
    bits = ones * 2 > weights.sum(dtype=np.float64)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def _record(doc_id, text: str, print_: int, following: str, next_print: int, known) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    changed = simhash(edited, known)
    return (
        doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(),
        f"{print_:016x}", f"{changed:016x}", likeness(print_, changed),
        likeness(print_, next_print))


_RESULT = [
    T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document follows in descending doc_id (NULL ids last, equal ids by text), the first
    follows the last. NULL text: empty. Other columns are not read. Documents are laid out by
    ranges of doc_id, each range sorted, so a document's next one comes right after it; only the
    first and last document of each range are paired in a second step.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    laid = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(partitions(docs.sparkSession), order[0])
        .sortWithinPartitions(*order))
    result = T.StructType([*fields(docs, "doc_id"), *_RESULT])
    schema = T.StructType([
        *result, T.StructField("edge", T.IntegerType()), T.StructField("text", T.StringType())])

    def in_range(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, known, held = to_arrow_schema(schema), WordHashes(), None

        def out(rows: list[tuple]):
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        def edge(kind: int, row: tuple) -> tuple:
            return (row[0], *[None] * len(_RESULT), kind, row[1])

        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                now = doc_id, text, simhash(text, known)
                if held:
                    rows.append((*_record(*held, now[1], now[2], known), 0, None))
                else:
                    rows.append(edge(1, now))
                held = now
            if rows:
                yield out(rows)
        if held:
            yield out([edge(2, held)])

    def pair_edges(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(result)
        known, very_first, held = WordHashes(), None, None
        for batch in batches:
            rows = []
            for doc_id, kind, text in zip(*(c.to_pylist() for c in batch.columns)):
                now = doc_id, text, simhash(text, known)
                very_first = very_first or now
                if kind == 2:
                    held = now
                elif held:
                    rows.append(_record(*held, now[1], now[2], known))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        if held:
            last = [_record(*held, very_first[1], very_first[2], known)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*last), arrow)], schema=arrow)

    done = settle(laid.mapInArrow(in_range, schema), "fingerprints")
    edges = (
        done.filter("edge > 0").select("doc_id", "edge", "text")
        .coalesce(1).sortWithinPartitions(order[0], "edge")  # two rows of each range
        .mapInArrow(pair_edges, result))
    return done.filter("edge = 0").drop("edge", "text").unionByName(edges)


def _masks(radius: int) -> list[int]:
    """Bits that each table compares: every choice of so many blocks as must stay untouched."""
    edges = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, BLOCKS - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def near(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (print, other, distance) of distinct fingerprints within the radius.

    Takes a LONG column print on both sides. Each table holds all fingerprints by the bits of some
    blocks, as if these were permuted to the front. With more blocks than the radius some are
    untouched in any pair sought, so one table at least brings it together; the first that does
    so gives the pair.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(radius)])

    def entries(side: DataFrame, name: str) -> DataFrame:
        return side.select(F.col("print").alias(name)).distinct().select(
            name, F.posexplode(masks).alias("table", "mask")).select(
            name, "table", F.col(name).bitwiseAND(F.col("mask")).alias("key"))

    changed: Column = F.col("print").bitwiseXOR(F.col("other"))
    first = F.array_position(F.transform(masks, lambda m: changed.bitwiseAND(m) == 0), True) - 1
    a, b = entries(queries, "print"), entries(index, "other")
    return a.join(
        b, (a["table"] == b["table"]) & (a["key"] == b["key"])
        & (F.bit_count(changed) <= radius) & (first == a["table"]),
    ).select("print", "other", F.bit_count(changed).alias("distance"))


def fingerprint_all(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents; n_near counts, for ids divisible by 50, the other documents
    whose fingerprint differs in RADIUS bits at most (NULL for the rest)."""
    done = settle(fingerprints(docs), "prints")
    upper = F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("long")
    lower = F.conv(F.substring("fingerprint", 9, 8), 16, 10).cast("long")
    whole = done.withColumn("print", F.shiftleft(upper, 32).bitwiseOR(lower))
    asked = F.coalesce(F.col("doc_id") % _QUERY_STEP == 0, F.lit(False))
    copies = whole.groupBy(F.col("print").alias("other")).agg(F.count("*").alias("n"))
    counted = (
        near(whole.filter(asked).select("print"), whole.select("print"))
        .join(copies, "other").groupBy("print").agg((F.sum("n") - 1).alias("n_near")))
    return whole.join(counted, "print", "left").withColumn(
        "n_near", F.when(asked, F.col("n_near"))).drop("print")
