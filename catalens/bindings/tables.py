"""Order-grain frames over the star-schema tables.

`catalog` has the 26 clean columns, one row per order. `raw_catalog` is the
same data as text with junk mixed in, for the cleaning operators.

Each query names the columns it needs and only the joins behind those columns
are built: all joined keys are unique on the right side, so leaving a LEFT JOIN
out never changes the rows. No join is hinted. Spark broadcasts a side only
when its size is known to be small and AQE splits skewed sort-merge partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.functions import rules
from catalens.schema import CLEAN_COLUMNS, RAW_COLUMNS

_LINE_COLUMNS = {"budget", "runtime", "vote_average"}
_PART_COLUMNS = {"title", "genres", "keywords"}
_CUSTOMER_COLUMNS = {"original_language", "production_countries"}
_DOCUMENT_COLUMNS = {"overview", "spoken_languages"}
_DERIVED_FROM = {
    "original_title": {"title"},
    "release_year": {"release_date"},
    "release_decade": {"release_date"},
    "release_month": {"release_date"},
    "primary_genre": {"genres"},
    "profit": {"revenue", "budget"},
    "roi": {"revenue", "budget"},
    "profit_pct": {"revenue", "budget"},
    "has_financials": {"revenue", "budget"},
}
# Clean columns that the raw text columns of the same name are made from.
_RAW_SOURCES = (
    "id", "title", "status", "release_date", "revenue", "budget", "runtime", "vote_average",
    "vote_count", "popularity", "adult", "original_language", "genres", "production_countries",
    "spoken_languages", "keywords", "overview",
)

# How the flag is written, by the id's remainder.
ADULT_TEXTS = ("True", "1", "f", " TRUE ", "", "t", "no")

# Table layouts. A known schema saves one footer-reading job per scan.
_TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _tag_list(column: str):
    """Distinct values, sorted, as 'a, b, c'; NULL when there are none."""
    return F.nullif(F.array_join(F.sort_array(F.collect_set(column)), ", "), F.lit(""))


def _line_measures(spark: SparkSession, sf_dir: str, needed: set[str]) -> DataFrame:
    """One row per order with the wanted line and part aggregates."""
    lines = table(spark, sf_dir, "lineitem")
    if needed & _PART_COLUMNS:
        part = table(spark, sf_dir, "part")
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    measures = {
        # Prices are in cents: whole numbers add up to the same sum in any order.
        "budget": lambda: F.sum(F.rint(F.col("l_extendedprice") * 100).cast("bigint")) / 100,
        "runtime": lambda: F.sum("l_quantity"),
        "vote_average": lambda: F.sum("l_quantity") / F.count("*") / 5,
        "title": lambda: F.min("p_name"),
        "genres": lambda: _tag_list("p_type"),
        "keywords": lambda: _tag_list("p_brand"),
    }
    return lines.groupBy("l_orderkey").agg(
        *[build().alias(name) for name, build in measures.items() if name in needed]
    )


def catalog(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Clean-layout frame with the given columns (all 26 by default)."""
    wanted = columns or CLEAN_COLUMNS
    needed = set(wanted).union(*(_DERIVED_FROM.get(c, ()) for c in wanted))

    rows = table(spark, sf_dir, "orders")
    if needed & _CUSTOMER_COLUMNS:
        customer = table(spark, sf_dir, "customer")
        rows = rows.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    if "production_countries" in needed:
        nation = table(spark, sf_dir, "nation")
        rows = rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    if needed & (_LINE_COLUMNS | _PART_COLUMNS):
        rows = rows.join(
            _line_measures(spark, sf_dir, needed), F.col("o_orderkey") == F.col("l_orderkey"), "left"
        )
    if needed & _DOCUMENT_COLUMNS:
        documents = table(spark, sf_dir, "documents")
        rows = rows.join(documents, F.col("o_orderkey") == F.col("doc_id"), "left")

    key = F.col("o_orderkey")
    base = {
        "id": key,
        "title": F.concat(F.col("title"), F.lit(" "), key.cast("string")),
        "status": F.col("o_orderstatus"),
        "release_date": F.col("o_orderdate").cast("date"),
        "revenue": F.col("o_totalprice"),
        "budget": F.col("budget"),
        "runtime": F.col("runtime"),
        "vote_average": F.col("vote_average"),
        "vote_count": key * 7919 % 2000,
        "popularity": key * 104729 % 100000 / 100,
        "adult": F.lit(False),
        "original_language": F.col("c_mktsegment"),
        # Some tags with a tab before or a line break after them.
        "genres": F.when(key % 17 == 0, F.replace("genres", F.lit(", "), F.lit(",\t")))
        .when(key % 19 == 0, F.concat("genres", F.lit("\n")))
        .otherwise(F.col("genres")),
        "production_countries": F.col("n_name"),
        "spoken_languages": F.col("lang"),
        "keywords": F.col("keywords"),
        "overview": F.col("text"),
    }
    rows = rows.select(*[expr.alias(name) for name, expr in base.items() if name in needed])

    revenue, budget, year = F.col("revenue"), F.col("budget"), F.year("release_date")
    derived = {
        "original_title": F.col("title"),
        "release_year": year,
        "release_decade": rules.decade(year),
        "release_month": F.month("release_date"),
        "primary_genre": rules.first_token(F.col("genres")),
        "profit": rules.profit(revenue, budget),
        "roi": rules.return_on_budget(revenue, budget),
        "profit_pct": rules.profit_percent(revenue, budget),
        "has_financials": rules.both_known(revenue, budget),
    }
    return rows.select(*[derived.get(c, F.col(c)).alias(c) for c in wanted])


def raw_catalog(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """All-text frame (all 24 columns by default) with junk and duplicates mixed in."""
    wanted = columns or RAW_COLUMNS
    needed = {"id"} | ({"title"} if "original_title" in wanted else set()) | set(wanted)
    source = catalog(spark, sf_dir, *[c for c in _RAW_SOURCES if c in needed])
    # A row that has a second copy is written twice from one pass over the source.
    copies = F.when(F.col("id") % 20 == 0, F.array(F.lit(False), F.lit(True))).otherwise(
        F.array(F.lit(False))
    )
    rows = source.withColumn("is_copy", F.explode(copies))

    def every(n):
        return F.col("id") % n == 0

    def text(name):
        return F.col(name).cast("string")

    def money(name):
        return F.col(name).cast("decimal(18,2)").cast("string")

    title = (
        F.when(every(73), "call 555-123-4567")
        .when(every(71), F.concat(F.lit("visit www.spam "), text("id")))
        .when(every(31), "   ")
        .when(every(29), "X")
        .when(every(23), F.concat(F.lit("Unsubscribe from "), F.col("title")))
        .otherwise(F.col("title"))
    )
    votes = (
        F.when(F.col("is_copy") & every(100), F.lit(None).cast("bigint"))
        .when(F.col("is_copy"), F.col("vote_count") - 1)
        .otherwise(F.col("vote_count"))
    )
    values = {
        "id": F.when(every(79), "abc").otherwise(text("id")),
        "title": F.when(F.col("is_copy"), F.concat(title, F.lit(" dupe"))).otherwise(title),
        "vote_average": F.when(every(53) | (every(140) & ~F.col("is_copy")), "99").otherwise(
            text("vote_average")
        ),
        "vote_count": votes.cast("string"),
        "status": F.col("status"),
        "release_date": F.when(every(41), "not-a-date").when(every(37), "").when(every(83), "1700-01-01").otherwise(text("release_date")),
        "revenue": F.when(every(47), "0").when(every(43), "4999999999999").otherwise(money("revenue")),
        "runtime": F.when(every(59), "-5").when(every(89), "5000").otherwise(text("runtime")),
        "adult": F.get(F.array(*map(F.lit, ADULT_TEXTS)), (F.col("id") % len(ADULT_TEXTS)).cast("int")),
        "budget": F.when(every(47), "0").when(every(97), "9999999999999").otherwise(money("budget")),
        "original_language": F.when(every(67), "").otherwise(F.col("original_language")),
        "original_title": F.col("title"),
        "overview": F.col("overview"),
        "popularity": text("popularity"),
        "genres": F.when(every(61), "  ").otherwise(F.col("genres")),
        "production_countries": F.col("production_countries"),
        "spoken_languages": F.col("spoken_languages"),
        "keywords": F.col("keywords"),
    }
    absent = F.lit(None).cast("string")
    return rows.select(*[values.get(c, absent).alias(c) for c in wanted])
