"""How five document filters interact, counted on a sparse document-term matrix."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.llm.common import giving_back, numbered, small_batches, table
from tillworks.llm.hashing import from_planes, planes
from tillworks.session import settle

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"
SHARD_WORDS = 1 << 20  # words of a shard, but for longer single texts
TERM_BITS = 63  # of a word's hash, which is its term unless another word has the same

_INTS = T.ArrayType(T.IntegerType(), False)
_LONGS = T.ArrayType(T.LongType(), False)


def _local_shards(
    docs: DataFrame, text: str, added: list[T.StructField], measure: Callable | None
) -> DataFrame:
    """Shards of rows: other columns, CSR with the shard's own word numbers, and its words.

    Numbers and counts are bytes, as `planes` makes them: Parquet takes long over lists of numbers.
    """
    kept = [c for c in docs.columns if c != text]
    at = len(kept)
    rows = T.ArrayType(T.StructType([*(docs.schema[c] for c in kept), *added]), False)
    schema = T.StructType([
        T.StructField("rows", rows, False), T.StructField("starts", _INTS, False),
        T.StructField("local", T.BinaryType(), False), T.StructField("counts", T.BinaryType(), False),
        T.StructField("words", T.ArrayType(T.StringType(), False), False)])

    def run(batches: Iterator) -> Iterator:
        from array import array
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        row = arrow.field("rows").type.value_type

        class Numbers(dict):
            def __missing__(self, word):
                number = self[word] = len(self)
                return number

        def one_list(values, kind):
            lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return lists.cast(kind)

        def packed(values):
            return pa.array([planes(np.array(values, np.int32))], pa.binary())

        def shard(pieces, starts, local, counts, words):
            held = pa.concat_arrays(pieces).cast(row)
            spelled = pa.array(list(words), pa.binary()).cast(pa.string())
            first, last = (one_list(x, arrow.field(n).type) for x, n in (
                (held, "rows"), (spelled, "words")))
            begins = one_list(pa.array(np.array(starts, np.int32)), arrow.field("starts").type)
            return pa.RecordBatch.from_arrays(
                [first, begins, packed(local), packed(counts), last], schema=arrow)

        def empty():
            return [], array("i", [0]), array("i"), array("i"), 0, Numbers()

        pieces, starts, local, counts, size, known = empty()
        for batch in batches:
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            made = measure(texts) if measure else []
            made = [pa.array(x, row.field(at + k).type) for k, x in enumerate(made)]
            carried = pa.StructArray.from_arrays(
                [*batch.columns[:at], *made],
                fields=[batch.schema.field(i) for i in range(at)]
                + [row.field(at + k) for k in range(len(made))])
            begin = 0
            for i, value in enumerate(texts):
                terms = Counter(value.split())
                local.extend(map(known.__getitem__, terms))
                counts.extend(terms.values())
                starts.append(len(local))
                size += terms.total() + 1
                if size >= SHARD_WORDS:
                    pieces.append(carried.slice(begin, i + 1 - begin))
                    yield shard(pieces, starts, local, counts, known)
                    begin = i + 1
                    pieces, starts, local, counts, size, known = empty()
            if begin < batch.num_rows:
                pieces.append(carried.slice(begin))
        if pieces:
            yield shard(pieces, starts, local, counts, known)

    return docs.select(*kept, text).mapInArrow(giving_back(run), schema)


def _dictionary(shards: DataFrame) -> DataFrame:
    """word and term of all distinct words of the shards; terms differ."""
    distinct = shards.select(F.explode("words").alias("word")).distinct()
    hashed = settle(distinct.withColumn(
        "term", F.shiftrightunsigned(F.xxhash64("word"), 64 - TERM_BITS)), "dictionary")
    shared = hashed.groupBy("term").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    clashing = settle(hashed.join(shared, "term").select("word"), "clashing")
    own = numbered(clashing, "word", "place", "clashing-words").select(
        "word", (-1 - F.col("place")).alias("own"))
    return hashed.join(own, "word", "left").select(
        "word", F.coalesce("own", "term").alias("term"))


def _encoded(
    docs: DataFrame, text: str, added: list[T.StructField] | tuple = (),
    measure: Callable | None = None,
):
    """Shards with the shard's own word numbers, the dictionary, and a function of Arrow batches
    that gives the shards their terms.

    A shard is some MB in one row, so each is a row group of its own: neither who writes a file of
    them nor who reads it holds more than one.
    """
    with small_batches(docs.sparkSession):
        local = settle(_local_shards(docs, text, added, measure), "shards",
                       **{"parquet.block.row.count.limit": 1})
    dictionary = settle(_dictionary(local), "terms")
    clashing = {w.encode(): t for w, t in dictionary.filter("term < 0").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(clashing)
    shift = 64 - TERM_BITS

    def encode(batches: Iterator) -> Iterator:
        """For each shard rows, starts, terms and counts as Arrow and numpy arrays."""
        import numpy as np
        import pyarrow as pa
        import xxhash

        own = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                rows, starts, words = (batch.column(j)[i].values for j in (0, 1, 4))
                numbers, counts = (batch.column(j)[i].as_py() for j in (2, 3))
                numbers, counts = (from_planes(x, 0, len(x) // 4) for x in (numbers, counts))
                terms = np.array([
                    own[w] if w in own else xxhash.xxh64_intdigest(w, 42) >> shift
                    for w in words.cast(pa.binary()).to_pylist()], np.int64)
                yield rows, starts.to_numpy(), terms[numbers], counts

    return local.select("rows", "starts", "local", "counts", "words"), dictionary, encode


def term_matrix(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The document-term matrix of the texts in shards of CSR, and its dictionary.

    The dictionary has word and term, one row per distinct word of all texts. A shard has rows (the
    other columns of its documents, in order), starts (of each row in terms and counts, and the end),
    terms and counts. Words are what white space (ASCII) separates, by case; NULL and empty texts make
    empty rows; ties and repeated rows are rows of their own.

    A word's term is its 63-bit hash, so that shards need not be joined with the dictionary. Words
    that share their hash are found in the dictionary, where all of them get terms -1, -2, ...;
    these few (of n distinct words about n^2 / 2^63: one among 3 thousand million) go to all tasks.
    A shard has about SHARD_WORDS words, or one longer text; it sends each of its words once.
    """
    local, dictionary, encode = _encoded(docs, text)
    schema = T.StructType([
        local.schema["rows"], local.schema["starts"], T.StructField("terms", _LONGS, False),
        T.StructField("counts", _INTS, False)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for parts in encode(batches):
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                     for x in parts]
            yield pa.RecordBatch.from_arrays(
                [x.cast(f.type) for x, f in zip(lists, arrow)], schema=arrow)

    return local.mapInArrow(giving_back(run), schema), dictionary


def row_sums(
    docs: DataFrame, text: str = "text", added: list[T.StructField] | tuple = (),
    measure: Callable[[list], list] | None = None,
) -> DataFrame:
    """The other columns with n_words and n_distinct: sums and nonzero counts of the matrix's rows.

    The matrix is summed up shard by shard where its terms are given, and not stored. ``measure``
    takes the texts of a batch (bytes in UTF-8; NULL ones are empty) and returns the columns
    ``added``, which come before the sums.
    """
    local, _, encode = _encoded(docs, text, added, measure)
    schema = T.StructType([
        *local.schema["rows"].dataType.elementType,
        *(T.StructField(n, T.LongType(), False) for n in ("n_words", "n_distinct"))])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for rows, starts, terms, counts in encode(batches):
            before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            held = np.concatenate([[0], np.cumsum(counts > 0, dtype=np.int64)])
            sums, nonzero = (x[starts[1:]] - x[starts[:-1]] for x in (before, held))
            made = [pa.array(sums), pa.array(nonzero)]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip([*rows.flatten(), *made], arrow)], schema=arrow)

    return local.mapInArrow(giving_back(run), schema)


def _measured(texts: list[bytes]) -> list[list]:
    """How many capitals A-Z each text has, whether it has a mark, and its SHA-256."""
    return [[len(t) - len(t.translate(None, CAPITALS)) for t in texts],
            [len(t.translate(None, MARKS)) < len(t) for t in texts],
            [hashlib.sha256(t).digest() for t in texts]]


def flags(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of each document: which of the five filters it fails, as bits.

    A (1): fewer than 50 words; B (2): 100 * distinct words below 65 * words; C (4): more than 5 %
    capitals A-Z of its code points; D (8): a mark of ``#$%&*|``; E (16): a smaller doc_id has the same
    text. NULL text is empty, and equal to empty ones; NULL source is the part ''. A row with
    NULL doc_id never fails E and is no copy's smaller one; rows with the same doc_id and text are no
    copies of each other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    prepared = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.length(text).alias("length"),
        text.alias("text"))
    added = [T.StructField(c, kind, False) for c, kind in (
        ("capitals", T.LongType()), ("marked", T.BooleanType()), ("digest", T.BinaryType()))]
    with small_batches(docs.sparkSession):
        rows = settle(row_sums(prepared, "text", added, _measured), "row-sums")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copied = settle(first.filter("n > 1").drop("n"), "copied")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    fails = [
        F.col("n_words") < 50, 100 * F.col("n_distinct") < 65 * F.col("n_words"),
        100 * F.col("capitals") > 5 * F.col("length").cast("long"), F.col("marked"), copy]
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    return rows.join(copied, "digest", "left").select("doc_id", "part", mask.alias("mask"))


def _by_mask(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, for each of the 32 masks: how many documents, good and toxic ones."""
    label = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic"))
    counted = marked.join(label, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return counted.groupBy("part").agg(F.collect_list(F.struct(
        "mask", "n", "good", "toxic")).alias("masks"))


def interactions(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what the filter of the step does there.

    From documents with doc_id, part and mask, and labels with doc_id, quality and toxic (of several
    labels of a document the greatest counts; documents without one are neither good nor toxic).
    Columns: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. The last sums up
    what the filter removes over all orders; a document that fails k filters is removed by
    each of them in 5! / k orders. A part has at most 32 masks, so orders and steps are looked at
    after all counting.
    """
    at = _by_mask(marked, labels).withColumn("filter_order", F.explode(F.lit(ORDERS)))
    at = at.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = "shiftleft(1, instr('{}', substr(filter_order, {}, 1)) - 1)".format
    at = at.withColumn("here", F.expr(bit(FILTERS, "step"))).withColumn("earlier", F.expr(
        f"aggregate(sequence(1, step), 0, (a, i) -> a + {bit(FILTERS, 'i')}) - here"))

    def total(when: str, what: str = "n") -> Column:
        return F.expr(f"aggregate(masks, 0L, (a, x) -> a + IF({when}, x.{what}, 0L))")

    fails, gone = "(x.mask & here) != 0", "(x.mask & earlier) != 0"
    removed = f"{fails} AND NOT {gone}"
    all_orders = factorial(len(FILTERS))
    return at.select(
        "part", "filter_order", "step",
        total(f"NOT ({fails}) AND NOT ({gone})").alias("kept"),
        total(removed).alias("removed"),
        total(f"{fails} AND {gone}").alias("redundant"),
        total("x.mask = here").alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        F.expr(f"aggregate(masks, 0L, (a, x) -> a + IF({fails}, "
               f"x.n * ({all_orders} div bit_count(x.mask)), 0L))").alias("shapley"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(
        flags(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), failing AS (
  SELECT doc_id, part, [
    len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f
  FROM words
), label AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), counted AS (
  SELECT part, f, len(list_filter(f, lambda x: x)) AS k, count(*) AS n,
    count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failing LEFT JOIN label USING (doc_id) GROUP BY part, f
), letters AS (SELECT unnest(range(1, 6)) AS i
), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT o, s.i AS step, o[s.i] AS h, o[1:s.i - 1] AS earlier FROM orders, letters s
), judged AS (
  SELECT *, f[h] AS fails, len(list_filter(earlier, lambda x: f[x])) > 0 AS gone FROM counted, steps
)
SELECT part, array_to_string(list_transform(o, lambda x: chr((64 + x)::INT)), '') AS filter_order,
  step::INT AS step,
  coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails AND k = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(k, 1))) FILTER (fails), 0)::BIGINT AS shapley
FROM judged GROUP BY part, o, h, step
"""
