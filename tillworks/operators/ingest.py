"""Bulk product upsert from a feed of text rows.

Rows apply in row order. A barcode belongs to the product that holds it as of the row: earlier rows
may have created its product, moved it there or freed it. A row that wants a barcode of another
product is refused. A product is found by id while it is active as of the row: earlier rows may have
switched it on or off. Everything per target is an aggregate ("last non-NULL by row number"), so a
product or barcode repeated very often in the feed is combined before the shuffle; only rows of
barcodes that some row moves, and of products that some row switches, are followed in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.functions.pricing import money_from_text, whole_from_text
from tillworks.operators.ids import with_new_ids
from tillworks.schemas import (
    CREATED,
    DEFAULT_UNIT,
    ERROR,
    FEED_TRUE,
    IMPORT_MESSAGES,
    MONEY,
    UPDATED,
)
from tillworks.session import settle

NULLABLE = ("description", "wholesale_price", "wholesale_min_qty")
_MONEY = ("cost_price", "retail_price", "wholesale_price")
_WHOLE = ("wholesale_min_qty", "stock", "min_stock")
VALUES = (
    "barcode", "product_name", "description", "category_id", "supplier_id", "cost_price",
    "retail_price", "wholesale_price", "wholesale_min_qty", "stock", "min_stock", "unit", "active",
)


def clean_feed(feed: DataFrame) -> DataFrame:
    """Rows with a product name; empty rows and nameless rows are skipped without a log entry."""
    return feed.filter(F.coalesce(F.col("product_name") != "", F.lit(False)))


def _present(col: str) -> Column:
    return F.col(col).isNotNull() & (F.col(col) != "")


def parse_feed_numbers(feed: DataFrame, missing: str = "default") -> DataFrame:
    """Number columns parsed; ``bad_number`` tells a text or a row number that is none.

    A missing price, cost or stock becomes 0, or stays NULL with ``missing="keep"``. A missing or
    zero wholesale price or minimum quantity is NULL.
    """
    bad = F.col("row_no").isNull()
    parsed: dict[str, Column] = {}
    for cols, parse in ((_MONEY, money_from_text), (_WHOLE, whole_from_text)):
        for c in cols:
            value = parse(F.col(c))
            bad = bad | (_present(c) & value.isNull())
            if c in NULLABLE:
                parsed[c] = F.when(value != 0, value)
            elif missing == "keep":
                parsed[c] = value
            else:
                parsed[c] = F.coalesce(value, F.lit(0)).cast(MONEY if c in _MONEY else "long")
    return feed.withColumns({"bad_number": bad, **parsed})


def parse_feed_flags(feed: DataFrame, missing: str = "default") -> DataFrame:
    """Active flag, unit and barcode; a missing flag is true and a missing unit the default."""
    active = F.lower("active").isin(*FEED_TRUE)
    unit = F.col("unit")
    if missing != "keep":
        active = F.coalesce(active, F.lit(True))
        unit = F.coalesce(unit, F.lit(DEFAULT_UNIT))
    barcode = F.when(F.col("barcode") != "", F.col("barcode"))
    return feed.withColumns({"active": active, "unit": unit, "barcode": barcode})


def resolve_names(feed: DataFrame, categories: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Category and supplier names to ids without regard to case; unknown names give NULL."""

    def folded(dim: DataFrame, name: str, target: str, key: str) -> DataFrame:
        place = F.struct(name, "id")
        return dim.groupBy(F.lower(name).alias(key)).agg(F.min_by("id", place).alias(target))

    cats = folded(categories, "category_name", "category_id", "_category")
    sups = folded(suppliers, "supplier_name", "supplier_id", "_supplier")
    return (
        feed.withColumn("_category", F.lower("category"))
        .withColumn("_supplier", F.lower("supplier"))
        .join(cats, "_category", "left")
        .join(sups, "_supplier", "left")
        .drop("_category", "_supplier", "category", "supplier")
    )


def match_target(feed: DataFrame, products: DataFrame) -> DataFrame:
    """Adds ``bad_id``, ``wanted`` (the product of the row's id), ``by_id`` (that, if active) and
    ``target``: by_id, else any product by barcode; all as before the feed."""
    asked = whole_from_text(F.col("id"))
    known = products.select(
        F.col("id").alias("wanted"), F.coalesce("active", F.lit(False)).alias("_on"))
    by_code = products.filter("barcode is not null").select(
        "barcode", F.col("id").alias("_by_code")
    )
    return (
        feed.withColumn("bad_id", _present("id") & asked.isNull())
        .withColumn("_asked", asked)
        .join(known, F.col("_asked") == F.col("wanted"), "left")
        .join(by_code, "barcode", "left")
        .withColumn("by_id", F.when(F.col("_on"), F.col("wanted")))
        .withColumn("target", F.coalesce("by_id", "_by_code"))
        .drop("_asked", "_by_code", "_on", "id")
    )


def _has_price() -> Column:
    return F.coalesce("retail_price", F.lit(0)) != 0


def _moved_barcodes(clean: DataFrame, owned: DataFrame) -> DataFrame:
    """Barcodes that a row asks for a product that held another or none before the feed, and those
    such products held."""
    held = owned.select(F.col("_owner").alias("wanted"), F.col("barcode").alias("_held"))
    moving = (
        clean.filter("wanted is not null and barcode is not null").select("wanted", "barcode")
        .join(held, "wanted", "left").filter(~F.col("barcode").eqNullSafe(F.col("_held")))
    )
    return moving.select("barcode").union(moving.select("_held").dropna()).distinct()


def _in_doubt(clean: DataFrame, products: DataFrame, owned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Barcodes and products whose rows must be followed in order.

    A product may be switched if a row that could reach it, by its id or by a barcode that it held or
    is asked for it, has another activity than it had before the feed. Its barcodes then join those
    that are moved: what its rows take or leave depends on whether it is found by id. Rows of all other
    barcodes and products neither see such a change nor cause one.
    """
    asked = clean.filter("wanted is not null and barcode is not null").select(
        "barcode", F.col("wanted").alias("product"))
    reach = asked.union(owned.select("barcode", F.col("_owner").alias("product"))).distinct()
    flags = [F.bool_or(F.col("active")).alias("_on"), F.bool_or(~F.col("active")).alias("_off")]
    by_code = clean.filter("barcode is not null").groupBy("barcode").agg(*flags)
    by_id = clean.filter("wanted is not null").groupBy(F.col("wanted").alias("product")).agg(*flags)
    seen = reach.join(by_code, "barcode").select("product", "_on", "_off").unionByName(by_id)
    opening = products.select(
        F.col("id").alias("product"), F.coalesce("active", F.lit(False)).alias("_was"))
    switched = settle(
        seen.groupBy("product").agg(F.bool_or("_on").alias("_on"), F.bool_or("_off").alias("_off"))
        .join(opening, "product").filter("(_was and _off) or (not _was and _on)")
        .select("product"), "feed-switched")
    moved = settle(
        _moved_barcodes(clean, owned).union(reach.join(switched, "product").select("barcode"))
        .distinct(), "feed-moved")
    return moved, switched


def _settled_outcomes(rows: DataFrame) -> DataFrame:
    """``outcome`` and ``made_by`` (the row that creates the product) of rows whose barcode stays
    with its product: the first row with a price creates the product of a new barcode."""
    new = F.col("target").isNull()
    starts = rows.filter(new & F.col("barcode").isNotNull() & _has_price()).groupBy("barcode").agg(
        F.min("row_no").alias("_start")
    )
    made_by = F.when(
        new, F.when(F.col("barcode").isNotNull(), F.col("_start"))
        .when(_has_price(), F.col("row_no")))
    placed = rows.join(starts, "barcode", "left").withColumn("made_by", made_by)
    # rows of a new barcode before the one that creates it have no price
    outcome = (
        F.when(~new, UPDATED)
        .when(F.col("made_by").isNull() | (F.col("row_no") < F.col("made_by")), "price_required")
        .when(F.col("row_no") == F.col("made_by"), CREATED)
        .otherwise(UPDATED)
    )
    return placed.withColumn("outcome", outcome).drop("_start")


def _moving_outcomes(rows: DataFrame, products: DataFrame, owned: DataFrame) -> DataFrame:
    """``outcome``, ``made_by`` and ``target`` of rows whose barcodes change hands or whose products
    are switched on or off.

    Rounds over all rows at once: from the outcomes assumed so far follows who holds each barcode and
    which product is active before each row (a product that takes a barcode frees the one it
    held), and from that the outcomes. Outcomes depend on earlier rows only, so each round settles at
    least one more link of every chain, and what no longer changes equals row-by-row processing. New
    products are numbered by minus the row that creates them.
    """
    none = F.lit(None).cast("long")
    asks = settle(
        rows.select("row_no", "barcode", "wanted", "active", "by_id",
                    _has_price().alias("priced")), "feed-asks")
    before_all = F.lit(-1).cast("long").alias("row_no")
    opening = settle(
        owned.select(before_all, "barcode", F.col("_owner").alias("product")), "feed-owned")
    switches = settle(
        products.join(asks.select(F.col("wanted").alias("id")).dropna().distinct(), "id")
        .select(before_all, F.col("id").alias("product"),
                F.coalesce("active", F.lit(False)).alias("_flag")), "feed-active")
    decided = asks.withColumns({"product": F.col("by_id"), "ok": F.col("by_id").isNotNull()})
    upto = (Window.unboundedPreceding, Window.currentRow)
    changed = 1
    while changed:
        # who is active: the last accepted row that says so
        flagged = switches.unionByName(decided.filter("ok and product >= 0 and active is not null")
                                       .select("row_no", "product", F.col("active").alias("_flag")))
        flags = flagged.select(
            F.col("product").alias("wanted"), "row_no", F.lit(1).alias("_kind"), "_flag")
        by_number = Window.partitionBy("wanted").orderBy("row_no", "_kind").rowsBetween(*upto)
        on = decided.filter("wanted is not null").withColumn("_kind", F.lit(0)).unionByName(
            flags, allowMissingColumns=True).withColumn(
            "_on", F.last("_flag", ignorenulls=True).over(by_number)).filter("_kind = 0")
        found = on.withColumn("by_id", F.when(F.col("_on"), F.col("wanted"))).select(
            *decided.columns).unionByName(
            decided.filter("wanted is null").withColumn("by_id", none))
        # who holds the barcode
        taken = opening.unionByName(
            decided.filter("ok and barcode is not null").select("row_no", "barcode", "product"))
        before = F.lag("barcode").over(Window.partitionBy("product").orderBy("row_no"))
        freed = taken.withColumn("_left", before).filter("_left <> barcode").select(
            "row_no", F.col("_left").alias("barcode"), none.alias("product"))
        events = taken.unionByName(freed).select(
            "barcode", "row_no", F.lit(1).alias("_kind"), F.struct("product").alias("_event"))
        by_code = Window.partitionBy("barcode").orderBy("row_no", "_kind").rowsBetween(*upto)
        seen = found.filter("barcode is not null").withColumn("_kind", F.lit(0)).unionByName(
            events, allowMissingColumns=True).withColumn(
            "_holder", F.last("_event", ignorenulls=True).over(by_code)["product"])
        seen = seen.filter("_kind = 0").drop("_kind", "_event").unionByName(
            found.filter("barcode is null").withColumn("_holder", none))
        new = F.when(F.col("priced"), -F.col("row_no"))
        product = F.coalesce("by_id", "_holder", new)
        ok = product.isNotNull() & F.coalesce(F.col("_holder") == product, F.lit(True))
        judged = settle(seen.select(
            "row_no", "barcode", "wanted", "active", "by_id", "priced", product.alias("product"),
            ok.alias("ok"),
            (~product.eqNullSafe(F.col("product")) | (ok != F.col("ok"))).alias("_changed"),
        ), "feed-round")
        changed = judged.filter("_changed").count()
        decided = judged.drop("_changed")
    outcome = (
        F.when(F.col("product").isNull(), "price_required")
        .when(~F.col("ok"), "duplicate")
        .when(F.col("product") == -F.col("row_no"), CREATED)
        .otherwise(UPDATED)
    )
    results = decided.select(
        "row_no", F.when(F.col("product") >= 0, F.col("product")).alias("target"),
        F.when(F.col("product") < 0, -F.col("product")).alias("made_by"),
        outcome.alias("outcome"))
    return rows.drop("target").join(results, "row_no")


@dataclass
class Import:
    products: DataFrame
    log: DataFrame


def upsert_products(
    products: DataFrame,
    feed: DataFrame,
    categories: DataFrame,
    suppliers: DataFrame,
    now: Column,
    missing: str = "default",
    last_id: int = 0,
) -> Import:
    """The catalogue after the feed, and one log row per named feed row.

    Update: non-NULL values overwrite, and of the nullable fields (description, wholesale price,
    minimum quantity) NULL overwrites too. Insert: needs a sale price other than zero. ``last_id``
    is the highest id that products ever had.
    """
    parsed = parse_feed_flags(parse_feed_numbers(clean_feed(feed), missing), missing)
    rows = settle(
        match_target(resolve_names(parsed, categories, suppliers), products), "feed-rows"
    )
    clean = rows.filter(~F.col("bad_number") & ~F.col("bad_id"))

    owned = products.select("barcode", F.col("id").alias("_owner")).dropna()
    moved, switched = _in_doubt(clean, products, owned)
    clean = clean.join(moved.withColumn("_moves", F.lit(True)), "barcode", "left").join(
        switched.select(F.col("product").alias("wanted"), F.lit(True).alias("_switches")),
        "wanted", "left").withColumn(
        "_follow", F.coalesce("_moves", "_switches", F.lit(False))).drop("_moves", "_switches")
    followed = clean.filter("_follow").drop("_follow")
    judged = settle(
        _settled_outcomes(clean.filter("not _follow").drop("_follow")).unionByName(
            _moving_outcomes(followed, products, owned.join(moved, "barcode"))),
        "feed-judged",
    )
    is_new = F.col("target").isNull()
    applied = judged.filter(F.col("outcome").isin(CREATED, UPDATED))

    row = F.col("row_no")
    folds = [
        (F.max_by(c, row) if c in NULLABLE
         else F.max_by(c, F.when(F.col(c).isNotNull(), row))).alias(f"_new_{c}")
        for c in VALUES
    ]
    updates = applied.filter(~is_new).groupBy(F.col("target").alias("id")).agg(*folds)
    updates = updates.withColumn("_hit", F.lit(True))

    def value(c: str) -> Column:
        if c in NULLABLE:
            return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        if c in VALUES:
            return F.coalesce(f"_new_{c}", c).alias(c)
        if c == "modified_at":
            return F.when(F.col("_hit"), now).otherwise(F.col(c)).alias(c)
        return F.col(c)

    updated = products.join(updates, "id", "left").select(*[value(c) for c in products.columns])

    created = applied.filter(is_new).groupBy(F.col("made_by").alias("_row")).agg(*folds)
    numbered = with_new_ids(created, products, ["_row"], last_id)
    defaults = {"cost_price": 0, "stock": 0, "min_stock": 0, "unit": DEFAULT_UNIT, "active": True}

    def created_value(field) -> Column:
        c = field.name
        if c == "id":
            return F.col("id")
        if c in ("created_at", "modified_at"):
            return now.alias(c)
        col = F.col(f"_new_{c}")
        if c in defaults:
            col = F.coalesce(col, F.lit(defaults[c]))
        return col.cast(field.dataType).alias(c)

    table = updated.unionByName(numbered.select(*[created_value(f) for f in products.schema]))
    return Import(table, import_log(rows, judged))


def import_log(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """(row_no, product_name, status, message) of every named row."""
    failed = rows.filter(F.col("bad_number") | F.col("bad_id")).withColumn(
        "outcome", F.when(F.col("bad_number"), "bad_number").otherwise("bad_id")
    )
    columns = ["row_no", "product_name", "outcome"]
    every = judged.select(*columns).unionByName(failed.select(*columns))
    message = F.lit(None).cast("string")
    for key, text in IMPORT_MESSAGES.items():
        message = F.when(F.col("outcome") == key, text).otherwise(message)
    done = F.col("outcome").isin(CREATED, UPDATED)
    return every.select(
        "row_no",
        "product_name",
        F.when(done, F.col("outcome")).otherwise(ERROR).alias("status"),
        message.alias("message"),
    )


def import_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))
