"""Queries over a table of alignments: search, counts, facets, time series, groups, pages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.functions import text as T

LENGTH_BINS = ((1, 25), (26, 100), (101, 250), (251, 500), (501, 1000), (1001, 3000), (3001, None))
#: Columns that only navigation needs.
INTERNAL = ("source_context_before", "source_context_after", "target_context_before", "target_context_after", "source_passage_with_matches", "target_passage_with_matches", "source_passage", "target_passage")


@dataclass
class Search:
    """What a search asks for; fields as the columns they filter."""

    filters: dict[str, str] = field(default_factory=dict)
    classes: tuple[str, ...] = ()
    group: int | None = None
    banality: bool | None = None
    page: int = 1
    anchor: int = 0
    direction: str = "next"
    interval: int = 1


def time_bucket(year: Column, interval: int) -> Column:
    """The first year of an interval, towards zero for negative years."""
    return F.expr("CAST(NULL AS INT)") if interval < 1 else (year - year % interval)


class AlignmentStore:
    """A table of alignments with a dense ordinal ``rowid``."""

    def __init__(self, main: DataFrame, groups: DataFrame | None = None):
        self.main, self.groups = main, groups

    def condition(self, search: Search) -> Column:
        """All that a search asks for, as one predicate."""
        types = dict(self.main.dtypes)
        out = F.lit(True)
        for name, value in search.filters.items():
            column = F.col(name)
            kind = types[name]
            if kind == "string":
                out &= T.word_match(column, value)
            elif kind == "boolean":
                out &= column == (value.lower() == "true")
            else:
                out &= T.number_match(column, value)
        for value in search.classes:
            out &= (F.col("first_class") == value) | (F.col("second_class") == value) | (F.col("third_class") == value if "third_class" in types else F.lit(False))
        if search.group is not None:
            out &= F.array_contains("group_id", search.group) if types["group_id"].startswith("array") else F.col("group_id") == search.group
        if search.banality is not None:
            out &= F.col("banality") == search.banality
        return out

    def where(self, search: Search) -> DataFrame:
        return self.main.where(self.condition(search))

    def page(self, search: Search, size: int = 50) -> DataFrame:
        """Rows of a page after (or before) an anchor, in order of rowid."""
        found = self.where(search)
        if search.direction == "next":
            return found.where(F.col("rowid") > search.anchor).orderBy("rowid").limit(size)
        return found.where(F.col("rowid") < search.anchor).orderBy(F.desc("rowid")).limit(size).orderBy("rowid")

    def offset_page(self, search: Search, size: int = 50) -> DataFrame:
        return self.where(search).orderBy("rowid").offset(size * (search.page - 1)).limit(size)

    def count(self, search: Search) -> DataFrame:
        return self.where(search).agg(F.count("*").alias("count"))

    def facet(self, search: Search, name: str) -> DataFrame:
        return self.where(search).groupBy(F.col(name).alias("facet")).agg(F.count("*").alias("count"))

    def length_facet(self, search: Search, name: str) -> DataFrame:
        """Counts of passages by bins of their length."""
        bins = F.when(F.lit(False), "")
        for low, high in LENGTH_BINS:
            bins = bins.when(F.col(name).between(low, high) if high else F.col(name) >= low, f"{low}-{high or ''}")
        counts = self.where(search).groupBy(bins.alias("facet")).agg(F.count("*").alias("count"), F.max(F.col(name)).alias("_most"))
        # bins are from 1 on; a condition on the facet itself would be pushed down to the rows and measure each of them again for each bin
        return counts.where(F.col("_most") >= LENGTH_BINS[0][0]).drop("_most")

    def time_series(self, search: Search, name: str = "source_year", dense: bool = True) -> DataFrame:
        """Counts by intervals of years; with dense, intervals between the first and the last that have none, too."""
        years = self.where(search).select(time_bucket(F.col(name), search.interval).alias("year")).where("year IS NOT NULL")
        counts = years.groupBy("year").agg(F.count("*").alias("count"))
        if not dense:
            return counts
        span = counts.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a IS NOT NULL")
        every = span.select(F.explode(F.sequence("a", "b", F.lit(search.interval))).alias("year"))
        return every.join(counts, "year", "left").select("year", F.coalesce("count", F.lit(0)).cast("long").alias("count"))

    def documents(self, search: Search, side: str, keep: list[str]) -> DataFrame:
        """A row per document with its number of rows and the metadata of its first row."""
        first = F.min_by(F.struct(*keep), "rowid").alias("first") if keep else F.lit(None).alias("first")
        found = self.where(search).groupBy(f"{side}_doc_id").agg(F.count("*").alias("count"), first)
        return found.select(f"{side}_doc_id", "count", *(F.col(f"first.{c}").alias(c) for c in keep))

    def pairs(self, search: Search) -> DataFrame:
        """All rows of a search without the texts; every row where nothing is asked."""
        return self.where(search).drop(*INTERNAL)

    def columns(self) -> list[str]:
        return self.main.columns

    def types(self) -> dict[str, str]:
        return dict(self.main.dtypes)

    def sorted_groups(self, search: Search, most: int = 100) -> DataFrame:
        """The groups that rows of a search belong to, by how many rows of the whole table with the group's document they have."""
        wanted = self.where(search).select(F.explode("group_id").alias("group_id")).distinct()
        members = self.main.select(F.explode("group_id").alias("group_id"), "source_doc_id")
        docs = self.groups.select("group_id", "source_doc_id")
        return members.join(docs, ["group_id", "source_doc_id"]).join(wanted, "group_id", "left_semi").groupBy("group_id").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "group_id").limit(most)

    def group(self, number: int) -> DataFrame:
        """A group's rows by year of the target; within a year by title and start, descending. No year comes last."""
        rows = self.main.where(F.array_contains("group_id", number) if dict(self.main.dtypes)["group_id"].startswith("array") else F.col("group_id") == number)
        if self.groups is not None:
            rows = rows.join(self.groups.where(F.col("group_id") == number).select("source_doc_id"), "source_doc_id", "left_semi")
        year = F.coalesce(F.nullif("target_year", F.lit(0)), F.lit(9999)).alias("year")
        listed = F.sort_array(F.collect_list(F.struct("target_title", "target_start_byte", "rowid")), asc=False)
        return rows.groupBy(year).agg(listed.alias("passages")).orderBy("year")

    def within(self, filename: str, start: int, end: int, side: str = "source") -> DataFrame:
        """Rows whose passage lies within a range of bytes of a file."""
        return self.main.where((F.col(f"{side}_filename") == filename) & (F.col(f"{side}_start_byte") >= start) & (F.col(f"{side}_end_byte") <= end))

    def statistics(self) -> DataFrame:
        return self.main.agg(F.count("*").alias("pairs"), F.countDistinct("source_author").alias("authors"), F.countDistinct("source_title").alias("titles"))
