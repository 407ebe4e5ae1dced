"""Exact dedup by deterministic block naming, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.session import settle

BLOCK = 2048  # code points of a block
#: a block of more than this share of all blocks is named apart; there are fewer than 1 / HOT such
HOT = 0.001
BLANK = r"[\x20\x09-\x0D]+"
_NONE = -1  # stands for the missing second of a last, odd name


def normalised(text: Column) -> Column:
    """The text without blanks; NULL becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def _blocks(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))


def _names(keyed: DataFrame, *key: str) -> DataFrame:
    """One integer per distinct key, rising with the sorted keys."""
    distinct = keyed.groupBy(*key).agg(F.lit(1).alias("_one")).drop("_one")
    ordered = distinct.repartitionByRange(*key).sortWithinPartitions(*key)
    return settle(ordered.withColumn("name", F.monotonically_increasing_id()), "names")


def _first_places(rows: DataFrame) -> DataFrame:
    """For each block of each row (columns row, blocks, hashes) the first place of its text.

    Blocks are sorted by hash and text, and the first of each text gives its (row, number) to
    all. The text of a block is shuffled once. Blocks whose hash makes up more than HOT of all
    would gather in one task: they are combined before the shuffle, and as there are fewer than
    1 / HOT hashes of them, their first places are a small table.
    """
    counts = rows.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(
        F.count("*").alias("n"))
    total = rows.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    hot = settle(counts.filter(F.col("n") > total * HOT).select("hash"), "hot-blocks")
    places = rows.select("row", F.posexplode(F.arrays_zip("blocks", "hashes")).alias("number", "b"))
    places = places.select(
        "row", "number", F.col("b.hashes").alias("hash"), F.col("b.blocks").alias("block"))

    place = F.struct("row", "number")
    cold = places.join(F.broadcast(hot), "hash", "left_anti").select(
        "row", "number",
        F.min(place).over(Window.partitionBy("hash", "block")).alias("first"))
    in_hot = places.join(F.broadcast(hot), "hash", "left_semi")
    firsts = settle(in_hot.groupBy("hash", "block").agg(F.min(place).alias("first")), "hot-firsts")
    warm = in_hot.join(firsts, ["hash", "block"]).select("row", "number", "first")
    return cold.unionByName(warm).select(
        "row", "number", F.col("first.row").alias("a"), F.col("first.number").cast("long").alias("b"))


def _sequences(places: DataFrame) -> DataFrame:
    """Replace the pairs (a, b) by names, and put the names of each row in order."""
    places = settle(places, "places")
    named = places.join(_names(places, "a", "b"), ["a", "b"])
    return settle(
        named.groupBy("row").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("number", "name"))),
                        lambda x: x["name"]).alias("names")), "sequences")


def identities(
    docs: DataFrame, text: str = "text", block: int = BLOCK, with_text: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The rows with a number each, and the identity of each row by its normalised text.

    The first has own (all columns of ``docs`` as a struct, without the text unless ``with_text``),
    n_chars (code points of the text), text_sha256 (of the normalised text) and row. The second has
    row, n_blocks and name: two rows have the same n_blocks and name if and only if their normalised
    texts are equal.

    Texts are cut into blocks of ``block`` code points. Equal blocks get equal integers by sorting, then
    adjacent pairs of integers are named again, until each text has one. Names come from sorted
    texts and pairs, never from hashes alone, so different texts cannot meet. Rounds: the logarithm of
    the longest text's blocks.
    """
    norm = normalised(F.col(text))
    kept = [F.col(f"`{c}`") for c in docs.columns if with_text or c != text]
    cut = docs.select(
        F.struct(*kept).alias("own"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(norm, 256).alias("text_sha256"), _blocks(norm, block).alias("blocks"))
    rows = settle(
        cut.withColumns({
            "hashes": F.transform("blocks", lambda b: F.xxhash64(b)),
            "row": F.monotonically_increasing_id()}), "blocks")
    sequences = _sequences(_first_places(rows))
    done = [rows.filter(F.size("blocks") == 0).select(
        "row", F.lit(0).alias("n_blocks"), F.lit(_NONE).cast("long").alias("name"))]
    sizes = rows.select("row", F.size("blocks").alias("n_blocks"))
    longest = sequences.agg(F.max(F.size("names"))).first()[0] or 0
    named = sequences.filter(F.size("names") == 1).select("row", "names")
    ended = [named]
    while longest > 1:
        pairs = sequences.filter(F.size("names") > 1).select("row", F.posexplode(F.transform(
            F.sequence(F.lit(1), F.size("names"), F.lit(2)),
            lambda i: F.struct(
                F.element_at("names", i).alias("a"),
                F.coalesce(F.try_element_at("names", i + 1), F.lit(_NONE).cast("long")).alias("b"),
            ))).alias("number", "pair"))
        sequences = _sequences(pairs.select("row", "number", "pair.a", "pair.b"))
        ended.append(sequences.filter(F.size("names") == 1).select("row", "names"))
        longest = (longest + 1) // 2
    whole = ended[0]
    for more in ended[1:]:
        whole = whole.unionByName(more)
    done.append(whole.join(sizes, "row").select(
        "row", "n_blocks", F.element_at("names", 1).alias("name")))
    return rows.drop("blocks", "hashes"), done[0].unionByName(done[1])


def mark_copies(
    docs: DataFrame, text: str = "text", id: str = "doc_id", with_text: bool = True
) -> DataFrame:
    """Adds keep_id, group_size, kept, n_chars and text_sha256 to the rows.

    Rows whose texts are equal without blanks (``[\\x20\\x09-\\x0D]``) form a group; NULL text is
    empty. The row with the most code points in its text stays, then that with the smallest id (NULL
    last); of rows equal in both exactly one stays. Old columns of these five names are replaced;
    all others pass (the text unless ``with_text`` is off). An empty table gives none.
    """
    rows, names = identities(docs, text, with_text=with_text)
    named = settle(rows.join(names, "row"), "identities")
    known = F.col("own")[id]
    order = F.struct(-F.col("n_chars"), known.isNull(), known.alias("id"), F.col("row"))
    groups = named.groupBy("n_blocks", "name").agg(
        F.count("*").alias("group_size"), F.min(order).alias("first"))
    groups = settle(groups.select(
        "n_blocks", "name", "group_size", F.col("first.id").alias("keep_id"),
        F.col("first.row").alias("stays")), "groups")
    added = ["keep_id", "group_size", "kept", "n_chars", "text_sha256"]
    old = [F.col("own")[c].alias(c) for c in named.schema["own"].dataType.names if c not in added]
    return named.join(groups, ["n_blocks", "name"]).withColumn(
        "kept", F.col("row") == F.col("stays")).select(*old, *added)


def without_copies(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows that stay, in their old columns, of which those that mark_copies replaces are new."""
    kept = mark_copies(docs, text, id).filter("kept")
    return kept.select(*[c for c in docs.columns if c in kept.columns])


def copy_groups(docs: DataFrame) -> DataFrame:
    return mark_copies(docs.select("doc_id", "text"), with_text=False).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), placed AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER w AS keep_id
  FROM docs WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM placed
"""
