"""A data cube behind the slice panels: cells are written once, slices read cells.

A cell is a combination of year, language, genre text and vote band. It keeps states that
merge: counts, sums, rows per rating bin and per runtime, and the first rows by rating and
by revenue. Grouping sets make the three kinds of states in one pass over the rows; cells
without the genre text, which most slices need, are merged from the full ones. A slice is
a union of cells, so every panel of `slices` comes out the same from them, the exact median
and the ordered lists included (a slice's first n rows are among its cells' first n).

The number of cells is bounded by the values of the dimensions, not by the rows. A slice
can be answered if its vote floor is one of the bands' (`answers`); others go to the table
itself. Sums of doubles are added in another order, which shows in their last digits only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.functions import buckets, rules
from catalens.operators.tags import explode_tags
from catalens.operators.topk import descending, top_n
from catalens.params import ReportRules, Slice
from catalens.plans import slices
from catalens.plans.summaries import DEFAULT, credible_financials
from catalens.schema import CLEAN_SCHEMA
from catalens.sources.files import exists, materialise

#: Vote floors that slices may ask for.
VOTE_BANDS = (0, 10, 50, 100, 250, 500, 1000, 2500, 5000, 10000)
DIMENSIONS = ("release_year", "original_language", "genres", "votes_from")
_WITHOUT_GENRES = tuple(d for d in DIMENSIONS if d != "genres")
_SUMS = ("movie_count", "rating_sum", "rating_count", "revenue_sum", "revenue_count", "budget_sum", "budget_count")
_LISTS = {
    "top_rated": ("vote_average", ("id", "title", "vote_average", "vote_count", "primary_genre")),
    "top_grossing": ("revenue", ("id", "title", "revenue", "budget", "profit")),
}


def _schema(*names: str) -> T.StructType:
    long = {*_SUMS} - {"rating_sum", "revenue_sum", "budget_sum"} | {"votes_from"}
    kinds = {"value": T.DoubleType()} | {c: T.LongType() if c in long else T.DoubleType() for c in [*_SUMS, "votes_from"]}
    return T.StructType([T.StructField(n, kinds[n] if n in kinds else CLEAN_SCHEMA[n].dataType) for n in names])


def _read(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """Of an empty table no cells were written."""
    schema = _schema(*names)
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _listed(kind: str) -> list[str]:
    return list(dict.fromkeys([*DIMENSIONS, *_LISTS[kind][1]]))


def vote_band(votes: Column, bands: tuple[int, ...]) -> Column:
    """The largest band floor that the votes reach; NULL below the first."""
    band = F.lit(None).cast("bigint")
    for floor in sorted(bands):
        band = F.when(votes >= floor, F.lit(floor).cast("bigint")).otherwise(band)
    return band


@dataclass(frozen=True)
class Cube:
    """The cells under `folder`."""

    spark: SparkSession
    folder: str
    bands: tuple[int, ...] = VOTE_BANDS
    listed: int = 15

    def answers(self, chosen: Slice) -> bool:
        return chosen.min_votes in self.bands

    def _cells(self, kind: str, chosen: Slice | None = None, genres: bool = False) -> DataFrame:
        """The cells of a slice; those with the genre text only where it is needed."""
        full = genres or bool(chosen and chosen.genres) or kind in _LISTS
        names = _listed(kind) if kind in _LISTS else [*(DIMENSIONS if full else _WITHOUT_GENRES), "value", *_SUMS]
        cells = _read(self.spark, f"{self.folder}/{'full' if full else 'plain'}/kind={kind}", *names)
        if chosen is None:
            return cells
        if not self.answers(chosen):
            raise ValueError(f"the cells have the vote floors {self.bands}, not {chosen.min_votes}")
        # Rows that are listed may have votes of their own, which are at least their band's.
        chosen_votes = cells if "vote_count" in names else cells.withColumn("vote_count", F.col("votes_from"))
        return slices.select(chosen_votes, chosen).select(*names)

    def bounds(self) -> DataFrame:
        return slices.bounds(self._cells("sums"))

    def genre_domain(self) -> DataFrame:
        return slices.genre_domain(self._cells("sums", genres=True))

    def language_domain(self, n: int = 20) -> DataFrame:
        known = self._cells("sums").filter(F.col("original_language").isNotNull())
        counts = known.groupBy("original_language").agg(F.sum("movie_count").alias("movie_count"))
        return top_n(counts, descending("movie_count", "original_language"), n).select("original_language")

    def kpis(self, chosen: Slice = Slice()) -> DataFrame:
        """As `slices.kpis`; the median is that of the rows per distinct runtime."""
        runtimes = self._cells("runtime", chosen).filter(F.col("value").isNotNull() & ~F.isnan("value"))
        median = runtimes.agg(F.percentile("value", F.lit(0.5), F.col("movie_count")).alias("median"))
        sums = self._cells("sums", chosen).agg(*[F.sum(c).alias(c) for c in _SUMS])
        return sums.select(
            F.coalesce("movie_count", F.lit(0).cast("bigint")).alias("movie_count"),
            F.round(_mean("rating"), 2).alias("avg_rating"),
            F.round(F.col("revenue_sum") / 1e9, 1).alias("total_revenue_b"),
            F.round(median.scalar(), 0).alias("median_runtime"),
        )

    def per_year(self, chosen: Slice = Slice()) -> DataFrame:
        known = self._cells("sums", chosen).filter(F.col("release_year").isNotNull())
        return known.groupBy("release_year").agg(F.sum("movie_count").alias("count")).orderBy("release_year")

    def rating_histogram(self, chosen: Slice = Slice()) -> DataFrame:
        width = (slices.RATING_HIGH - slices.RATING_LOW) / slices.RATING_BINS
        binned = self._cells("rating", chosen).filter(F.col("value").isNotNull())
        return (
            binned.groupBy(F.col("value").cast("bigint").alias("bin"))
            .agg(F.sum("movie_count").alias("count"))
            .select("bin", (slices.RATING_LOW + (F.col("bin") - 1) * width).alias("from_rating"), "count")
            .orderBy("bin")
        )

    def top_genres(self, chosen: Slice = Slice(), n: int = 12) -> DataFrame:
        texts = self._cells("sums", chosen, genres=True).groupBy("genres").agg(F.sum("movie_count").alias("rows"))
        counts = explode_tags(texts).groupBy("genre").agg(F.sum("rows").alias("count"))
        return top_n(counts, descending("count", "genre"), n)

    def money_trend(self, chosen: Slice = Slice()) -> DataFrame:
        known = self._cells("sums", chosen).filter(F.col("release_year").isNotNull())
        credible = known.groupBy("release_year").agg(*[F.sum(c).alias(c) for c in _SUMS]).filter(F.col("revenue_count") > 0)
        means = [_mean(money).alias(f"avg_{money}") for money in ("revenue", "budget")]
        return credible.select("release_year", *means).orderBy("release_year")

    def top_rated(self, chosen: Slice = Slice(), n: int = 15) -> DataFrame:
        return self._first("top_rated", chosen, n).select("title", "vote_average", "vote_count", "release_year", "primary_genre")

    def top_grossing(self, chosen: Slice = Slice(), n: int = 15) -> DataFrame:
        return self._first("top_grossing", chosen, n).select("title", "revenue", "budget", "profit", "release_year")

    def _first(self, kind: str, chosen: Slice, n: int) -> DataFrame:
        if n > self.listed:
            raise ValueError(f"the cells list {self.listed} rows")
        return top_n(self._cells(kind, chosen), descending(_LISTS[kind][0]), n)


def _mean(of: str) -> Column:
    return F.when(F.col(f"{of}_count") > 0, F.col(f"{of}_sum") / F.col(f"{of}_count"))


def build(
    rows: DataFrame, folder: str, bands: tuple[int, ...] = VOTE_BANDS, listed: int = 15, limits: ReportRules = DEFAULT
) -> Cube:
    """Write the cells of a clean table. A folder that has cells already is an error."""
    spark = rows.sparkSession
    votes_from = vote_band(F.col("vote_count"), bands)
    credible = rules.credible(limits.financial_votes)
    revenue, budget = F.when(credible, F.col("revenue")), F.when(credible, F.col("budget"))
    rating_bin = buckets.histogram_bin(F.col("vote_average"), slices.RATING_LOW, slices.RATING_HIGH, slices.RATING_BINS)
    narrow = rows.select(
        "release_year", "original_language", "genres", votes_from.alias("votes_from"), "vote_average",
        F.when(F.col("vote_average").isNotNull(), rating_bin).cast("double").alias("rating"), F.col("runtime").alias("runtime"), revenue.alias("revenue"), budget.alias("budget"),
    )
    dimensions = [F.col(d) for d in DIMENSIONS]
    states = narrow.groupingSets(
        [dimensions, [*dimensions, F.col("rating")], [*dimensions, F.col("runtime")]], *dimensions, F.col("rating"), F.col("runtime")
    ).agg(
        F.grouping("rating").alias("no_rating"), F.grouping("runtime").alias("no_runtime"),
        F.count("*").alias("movie_count"),
        F.sum("vote_average").alias("rating_sum"), F.count("vote_average").alias("rating_count"),
        F.sum("revenue").alias("revenue_sum"), F.count("revenue").alias("revenue_count"),
        F.sum("budget").alias("budget_sum"), F.count("budget").alias("budget_count"),
    )
    kind = F.when(F.col("no_rating") == 0, "rating").when(F.col("no_runtime") == 0, "runtime").otherwise("sums")
    value = F.when(kind == "rating", F.col("rating")).when(kind == "runtime", F.col("runtime"))
    full = states.select(*DIMENSIONS, kind.alias("kind"), value.alias("value"), *_SUMS)
    full.write.partitionBy("kind").parquet(f"{folder}/full")
    written = spark.read.schema(full.schema).parquet(f"{folder}/full")
    plain = written.groupBy("kind", *_WITHOUT_GENRES, "value").agg(*[F.sum(c).alias(c) for c in _SUMS])
    plain.write.partitionBy("kind").parquet(f"{folder}/plain")
    listings = {"top_rated": rows, "top_grossing": credible_financials(rows, limits)}
    for name, source in listings.items():
        by, _ = _LISTS[name]
        place = F.row_number().over(Window.partitionBy(*DIMENSIONS).orderBy(*descending(by)))
        first = source.withColumn("votes_from", votes_from).select(*_listed(name))
        materialise(first.withColumn("_place", place).filter(F.col("_place") <= listed).drop("_place"), f"{folder}/full/kind={name}")
    return Cube(spark, folder, tuple(bands), listed)
