"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.llm.common import SPACED_WORD, numbered
from tillworks.session import settle

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 17
LANES = 64  # a source's documents of about one size are numbered in so many lanes side by side


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("")).otherwise(
        F.concat(F.lit("="), F.col("source")))


def _small_hash(text: Column, below: int) -> Column:
    """A number from 0 to below - 1, from the first 16 bits of a digest."""
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int") % below


def _size_class(size: Column) -> Column:
    """Eight classes to each doubling: the number of bits and the three after the leading one."""
    bits = F.length(F.bin(size))
    return bits * 8 + F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0))) % 8


def targets(
    totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """Adds to source, source_size the target of each source.

    Sources in code point order, NULL last, take the weights in turn. ``share`` times all sizes is
    dealt by weight; a source stops at ``most`` times its size and the excess is dealt again. With
    a level L, targets are min(most * size, L * weight); L rises until it deals out everything.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = settle(
        numbered(totals, "source", "_rank", "sources").withColumn(
            "weight", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int"))),
        "weights")
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * most < level * F.col("weight")
        row = ranked.agg(
            F.sum("source_size"), F.count_if(full),
            F.sum(F.when(full, F.col("source_size") * most)),
            F.sum(F.when(~full, F.col("weight")))).first()
        total, now, taken, weight = (x or 0 for x in row)
        if now == capped or not weight:
            break
        level, capped = (total * share - taken) / weight, now
    return ranked.select(
        "source", "source_size",
        F.least(F.col("source_size") * float(most), F.col("weight") * level).alias("target"))


ADDED = ("source_size", "target", "copies")


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED
) -> DataFrame:
    """Adds source_size, target and copies to documents with doc_id, source and size.

    Columns of these names are replaced, all others kept, whatever they are called. Each document
    of a source expects target / source_size copies. Documents are ordered by about their size (so
    that the words taken come near the target), copies expected are summed up in that order from
    one random start per source, and a document is taken once for each whole number that its
    piece of the sum crosses.

    The order is (size class, lane, size, digest of doc_id): lanes by digest keep a source
    with much of the data from being numbered in one task. Reruns agree: nothing depends on the
    layout. Equal doc_ids are told apart by size; rows equal in both may swap their copies.
    NULL source is a source of its own; size must not be NULL. No sizes at all: no copies.

    All columns go through a sort; ``mixed_rows`` numbers wide documents without that.
    """
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # one column holds the rows as they are, so that no name of theirs can clash
    lanes = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "source", "size",
        _source_key().alias("source_key"), _size_class(F.col("size")).alias("class"),
        _small_hash(key, LANES).alias("lane"), F.md5(key).alias("tie"))
    lane = ["source_key", "class", "lane"]
    counted = settle(
        lanes.groupBy(*lane).agg(
            F.first("source").alias("source"), F.count("*").alias("n"),
            F.sum("size").alias("lane_size")), "lanes")
    totals = counted.groupBy("source_key").agg(
        F.first("source").alias("source"), F.sum("lane_size").alias("source_size")).drop(
        "source_key")
    start = _small_hash(F.concat(F.col("source_key"), F.lit(f"/{seed}")), 65536) / 65536.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per_source = targets(totals, weights, share, most).select(
        _source_key().alias("source_key"), "source_size", "target", rate.alias("rate"))
    before = Window.partitionBy("source_key").orderBy("class", "lane").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = settle(
        counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(per_source, "source_key")
        .select(*lane, "before", "source_size", "target", "rate", start.alias("start")),
        "starts")
    at = F.row_number().over(Window.partitionBy(*lane).orderBy("size", "tie"))
    crossed = (
        F.floor(F.col("place") * F.col("rate") + F.col("start"))
        - F.floor((F.col("place") - 1) * F.col("rate") + F.col("start")))
    return (
        lanes.withColumn("at", at).join(starts, lane)
        .withColumn("place", F.col("before") + F.col("at"))
        .select("row.*", "source_size", "target",
                F.least(crossed, F.lit(most)).cast("long").alias("copies")))


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy taken, numbered from 1 in the column copy."""
    taken = mixed.filter(F.col("copies") > 0)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed. Rows that share it by chance may swap copies."""
    plain = [f.name for f in docs.schema.fields
             if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def mixed_rows(docs: DataFrame, size: Column, most: int = MOST, **settings) -> DataFrame:
    """Documents with doc_id, source and any other columns as often as ``mix`` takes them.

    Copies are numbered from 1 in the last column, copy (copy_ where there is a column copy, and
    so on). Only doc_id, source, size and a hash of each row are sorted and numbered; the copies
    then meet the documents by that hash, in one shuffle without a sort. Rows equal in all columns
    are counted off among themselves, first within each partition and then over the partitions'
    counts, so many repeats of one row are not brought to one task.
    """
    numbers = settle(
        docs.select(_row_hash(docs).alias("row_hash"), "doc_id", "source", size.alias("size")),
        "sizes")
    per_row = settle(
        mix(numbers, most=most, **settings).groupBy("row_hash").agg(
            F.count("*").alias("n"),
            # how many of the equal rows are taken once at least, twice at least, ...
            F.array(*[F.count_if(F.col("copies") > k) for k in range(most)]).alias("taken")),
        "copies")
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        _row_hash(docs).alias("row_hash"))
    copies = F.aggregate(
        "taken", F.lit(0).cast("long"), lambda x, k: x + (F.col("nth") < k).cast("long"))
    single = per_row.filter((F.col("n") == 1) & (F.col("taken")[0] > 0)).hint("shuffle_hash")
    rows = wide.join(single, "row_hash").withColumn("nth", F.lit(0).cast("long"))
    repeated = per_row.filter(F.col("n") > 1)
    if not repeated.isEmpty():
        laid = settle(
            wide.join(repeated, "row_hash")
            .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}),
            "repeated")
        before = Window.partitionBy("row_hash").orderBy("part").rowsBetween(
            Window.unboundedPreceding, -1)
        parts = laid.groupBy("row_hash", "part").agg(F.count("*").alias("rows")).withColumn(
            "before", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
        within = F.row_number().over(Window.partitionBy("row_hash", "part").orderBy("at"))
        rows = rows.unionByName(
            laid.withColumn("within", within).join(parts, ["row_hash", "part"])
            .withColumn("nth", F.col("before") + F.col("within") - 1)
            .select(*rows.columns))
    name, names = "copy", {c.lower() for c in docs.columns}
    while name in names:
        name += "_"
    taken = rows.withColumn("copies", copies).filter(F.col("copies") > 0)
    return taken.select(
        "row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(name))


def taken_words(docs: DataFrame) -> DataFrame:
    sized = settle(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sized")
    return mix(sized).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies")


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(CASE WHEN source IS NULL THEN '' ELSE '=' || source END) AS skey,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS tie
  FROM documents
), lanes AS (
  SELECT *, bits * 8 + (size >> greatest(bits - 4, 0)) % 8 AS class,
    ('0x' || substr(tie, 1, 4))::INT % {LANES} AS lane
  FROM (SELECT *, length(CASE WHEN size = 0 THEN '0' ELSE ltrim(bin(size), '0') END) AS bits
    FROM sized)
), totals AS (
  SELECT skey, sum(size)::BIGINT AS source_size,
    [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY any_value(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE
      AS weight
  FROM sized GROUP BY skey
), ratios AS (
  SELECT *, source_size * 2 / weight AS ratio, (SELECT sum(source_size) FROM totals) * 1.5::DOUBLE
    AS deal FROM totals
), levels AS (
  SELECT *, (deal - coalesce(sum(source_size * 2) OVER (ORDER BY ratio
      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0))
    / sum(weight) OVER (ORDER BY ratio RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ratios
), chosen AS (
  SELECT min_by(level, ratio) AS level FROM levels WHERE level <= ratio
), targets AS (
  SELECT skey, source_size, least(source_size * 2.0::DOUBLE, weight * level) AS target
  FROM totals, chosen
), placed AS (
  SELECT l.*, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    (('0x' || substr(md5(l.skey || '/{SEED}'), 1, 4))::INT % 65536) / 65536.0::DOUBLE AS start,
    row_number() OVER (PARTITION BY l.skey ORDER BY class, lane, size, tie) AS place
  FROM lanes l JOIN targets t ON l.skey = t.skey
), crossed AS (
  SELECT *, least(floor(place * rate + start) - floor((place - 1) * rate + start), 2)::BIGINT
    AS copies FROM placed
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM crossed
"""
