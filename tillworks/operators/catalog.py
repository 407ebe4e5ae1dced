"""Catalogue lookups, filters, paging and the till search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillworks.functions.text import contains_text, fold_ascii, yes_no
from tillworks.operators.paging import take_page
from tillworks.schemas import EXPORT_COLUMNS
from tillworks.session import settle


def list_categories(categories: DataFrame) -> DataFrame:
    return categories.orderBy("category_name", "id")


def list_suppliers(suppliers: DataFrame) -> DataFrame:
    return suppliers.orderBy("supplier_name", "id")


def list_users(users: DataFrame) -> DataFrame:
    """Users without their secrets."""
    return users.select("id", "username", "role")


def list_permissions(permissions: DataFrame) -> DataFrame:
    return permissions.select("permission").orderBy("permission")


def lookup(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``table`` whose ``column`` is among the keys; absent keys give no row."""
    return table.join(keys.select(column), column, "left_semi")


def enrich_products(
    products: DataFrame, categories: DataFrame, suppliers: DataFrame
) -> DataFrame:
    """Products with category and supplier name; a dangling or missing id gives NULL names.

    No broadcast hint: Spark broadcasts a dimension by itself while its measured size is below
    the threshold, and splits a hot category or supplier in the sort-merge join beyond it.
    """
    category_names = categories.select(F.col("id").alias("category_id"), "category_name")
    supplier_names = suppliers.select(F.col("id").alias("supplier_id"), "supplier_name")
    joined = products.join(category_names, "category_id", "left").join(
        supplier_names, "supplier_id", "left"
    )
    return joined.select(*products.columns, "category_name", "supplier_name")


def filter_products(
    products: DataFrame,
    name: str | None = None,
    category_id: int | None = None,
    supplier_id: int | None = None,
    low_stock: bool = False,
    only_active: bool = True,
) -> DataFrame:
    """All given conditions must hold; None means no condition."""
    found = products.filter("active") if only_active else products
    if name is not None:
        found = found.filter(contains_text("product_name", name))
    if category_id is not None:
        found = found.filter(F.col("category_id") == category_id)
    if supplier_id is not None:
        found = found.filter(F.col("supplier_id") == supplier_id)
    if low_stock:
        found = found.filter(F.col("stock") <= F.col("min_stock"))
    return found


def list_products(
    products: DataFrame,
    categories: DataFrame,
    suppliers: DataFrame,
    page: int = 1,
    limit: int | None = 25,
    after: tuple[str, int] | None = None,
    **filters,
) -> DataFrame:
    """One page of enriched products by name; names are joined to the page only.

    ``after`` = (product_name, id) of the last row seen continues from there without an offset, so a
    deep page costs no more than the first; ``page`` then does not count.
    """
    order = ["product_name", "id"]
    rows = filter_products(products, **filters)
    if after is not None:
        name, last = F.lit(after[0]), F.lit(after[1])
        rows = rows.filter(
            (F.col("product_name") > name) | ((F.col("product_name") == name) & (F.col("id") > last))
        )
        page = 1
    if limit:
        rows = take_page(rows, order, page, limit)
    return enrich_products(rows, categories, suppliers).orderBy(*order)


def low_stock(
    products: DataFrame, categories: DataFrame, suppliers: DataFrame,
    page: int = 1, limit: int | None = 25,
) -> DataFrame:
    return list_products(products, categories, suppliers, page, limit, low_stock=True)


def products_by_key(
    products: DataFrame, categories: DataFrame, suppliers: DataFrame,
    keys: DataFrame, column: str = "id",
) -> DataFrame:
    """Active enriched products whose id or barcode is among the keys."""
    return enrich_products(
        lookup(products.filter("active"), keys, column), categories, suppliers
    )


def search_products(
    terms: DataFrame, products: DataFrame, limit: int = 5, names_allowed: Column | None = None
) -> DataFrame:
    """Till search for many terms at once: (term, position, product id, name, barcode).

    ``names_allowed`` is one boolean value (``access.allowed``): a seller who may not read the
    catalogue finds products by barcode only.

    A term of six or more digits is tried as the barcode of an active product. Every other term,
    and a barcode that misses, is searched in the names; the first ``limit`` by name are kept.

    Terms and names never meet as a cross product. A name containing a pattern also contains all
    its pieces between wildcards, so names are cut into pieces of the lengths in use, of which those
    that some pattern has are kept. A pattern that is one piece takes the first names that hold it. Any
    other is joined with the names of its rarest piece, and LIKE then checks the whole pattern. Terms
    that differ by case only are searched once.
    """
    asked = (
        terms.select(F.regexp_replace("term", r"^\s+|\s+$", "").alias("term"))
        .filter(F.col("term") != "")
        .distinct()
    )
    active = products.filter("active").select("id", "product_name", "barcode")
    code = F.when(F.col("term").rlike("^[0-9]{6,}$"), F.col("term"))
    tried = settle(
        asked.withColumn("barcode", code).join(active, "barcode", "left"), "search-terms"
    )
    hits = tried.filter(F.col("id").isNotNull()).select(
        "term", F.lit(1).alias("position"), F.col("id").alias("product_id"),
        "product_name", "barcode",
    )
    missed = tried.filter(F.col("id").isNull()).select("term")
    if names_allowed is not None:
        missed = missed.filter(names_allowed)
    return hits.unionByName(_search_names(missed, active, limit))


def _first(df: DataFrame, by: str, limit: int) -> DataFrame:
    """The first ``limit`` rows per group by name; Spark trims each group before its shuffle."""
    window = W.partitionBy(by).orderBy("product_name", "id")
    return df.withColumn("position", F.row_number().over(window)).filter(
        F.col("position") <= limit
    )


def _search_names(terms: DataFrame, active: DataFrame, limit: int) -> DataFrame:
    spelled = settle(terms.withColumn("pattern", fold_ascii("term")), "search-patterns")
    patterns = spelled.select("pattern").distinct()
    pieces = settle(
        patterns.withColumn("piece", F.explode(F.array_distinct(F.split("pattern", "[%_]"))))
        .filter("piece <> ''"), "search-pieces")
    wanted = pieces.select("piece").distinct()
    lengths = (
        wanted.select(F.length("piece").alias("n"))
        .agg(F.coalesce(F.collect_set("n"), F.array().cast("array<int>")).alias("ns"))
        .scalar()
    )

    # a name can give at most `limit` rows to any term, so the rest of its copies can go
    names = _first(active, "product_name", limit).select(
        "id", "product_name", "barcode", fold_ascii("product_name").alias("folded")
    )
    starts = F.sequence(F.lit(1), F.length("folded") - F.col("n") + 1)
    cuts = F.transform(starts, lambda start: F.substr(F.col("folded"), start, F.col("n")))
    postings = settle(
        names.withColumn("n", F.explode(lengths))
        .filter(F.col("n") <= F.length("folded"))
        .withColumn("piece", F.explode(F.array_distinct(cuts)))
        .join(wanted, "piece", "left_semi"), "search-postings")

    # without wildcards the names that hold the piece are the matches; few of them are needed
    plain = pieces.filter("piece = pattern").select("piece")
    whole = _first(postings.join(plain, "piece", "left_semi"), "piece", limit).withColumn(
        "pattern", F.col("piece"))
    # with wildcards every piece must be in the name, so the rarest leads to the candidates
    rarest = (
        pieces.filter("piece <> pattern")
        .join(postings.groupBy("piece").agg(F.count(F.lit(1)).alias("n_names")), "piece", "left")
        .groupBy("pattern")
        .agg(F.min_by("piece", F.struct(F.coalesce("n_names", F.lit(0)), "piece")).alias("piece"))
    )
    matched = postings.join(rarest, "piece").filter(
        F.like("folded", F.concat(F.lit("%"), F.replace("pattern", F.lit("\\"), F.lit("\\\\")),
                                  F.lit("%")))
    )

    # wildcards only: what counts is the least number of characters
    only_wild = patterns.filter(F.regexp_replace("pattern", "[%_]", "") == "").select(
        "pattern", (F.length("pattern") - F.length(F.replace("pattern", F.lit("_"), F.lit(""))))
        .alias("least")
    )
    by_length = _first(names.withColumn("n", F.length("folded")), "n", limit)
    reach = by_length.withColumn("least", F.explode(F.sequence(F.lit(0), F.col("n"))))
    wild = reach.join(only_wild, "least")

    columns = ["pattern", "id", "product_name", "barcode"]
    found = whole.select(*columns).unionByName(matched.select(*columns)).unionByName(
        wild.select(*columns))
    return spelled.join(_first(found, "pattern", limit), "pattern").select(
        "term", "position", F.col("id").alias("product_id"), "product_name", "barcode"
    )


def export_catalogue(
    products: DataFrame, categories: DataFrame, suppliers: DataFrame
) -> DataFrame:
    """All products, active or not, under the 18 headers of the export file."""
    rows = enrich_products(products, categories, suppliers)
    special = {
        "active": yes_no(F.col("active")),
        "cost_price": F.coalesce("cost_price", F.lit(0)).cast("decimal(18,2)"),
        "retail_price": F.coalesce("retail_price", F.lit(0)).cast("decimal(18,2)"),
        "stock": F.coalesce("stock", F.lit(0)),
    }
    return rows.select(
        *[special.get(col, F.col(col)).alias(head) for head, col in EXPORT_COLUMNS.items()]
    )
