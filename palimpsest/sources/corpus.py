"""Corpora from files and tables: plain text, TEI, bibliographies, metadata, parsed words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Levels of text objects, outermost first; an object's id is the first numbers of a position.
LEVELS = ("doc", "div1", "div2", "div3", "para", "sent", "word")


def plain(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text) of plain text files, each whole."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("text"))


def tei(spark: SparkSession, path: str) -> DataFrame:
    """(filename, title, author, year, text) of TEI files; text is the markup within body, header fields the first found."""
    raw = plain(spark, path)

    def first(pattern: str) -> Column:
        return F.nullif(F.trim(F.regexp_replace(F.regexp_extract("text", pattern, 1), r"<[^>]+>|\s+", " ")), F.lit(""))

    return raw.select(
        "filename",
        first(r"(?s)<titleStmt>.*?<title[^>]*>(.*?)</title>").alias("title"),
        first(r"(?s)<titleStmt>.*?<author[^>]*>(.*?)</author>").alias("author"),
        F.regexp_extract(first(r"(?s)<date[^>]*>(.*?)</date>"), r"(\d{3,4})", 1).alias("year"),
        F.regexp_extract("text", r"(?s)<body[^>]*>(.*)</body>", 1).alias("text"),
    )


def bibliography(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """A table of metadata with a header, all values text."""
    return spark.read.csv(path, sep=separator, header=True)


def described(texts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Texts with the bibliography's fields in place of their own."""
    own = [c for c in texts.columns if c == "filename" or c not in metadata.columns]
    return texts.select(*own).join(metadata, "filename", "left")


def metadata_json(df: DataFrame, column: str = "value") -> DataFrame:
    """(doc_id, fields): documents' metadata from one JSON object of objects, white space in values squeezed."""
    parsed = df.select(F.explode(F.from_json(column, "map<string,map<string,string>>")).alias("doc_id", "raw"))
    return parsed.select("doc_id", F.transform_values("raw", lambda _, v: F.regexp_replace(v, r"\s+", " ")).alias("fields"))


def with_fields(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, with the union of their columns."""
    return a.unionByName(b, allowMissingColumns=True)


def sort_order(docs: DataFrame, by: str = "year", doc: str = "doc_id") -> list[Column]:
    """How documents are ordered for comparison: numeric field, then the others, ties by numeric id."""
    return [F.col(by).try_cast("int").asc_nulls_last(), F.col(doc).try_cast("bigint").asc_nulls_last()]


def object_id(position: Column, level: str) -> Column:
    """Id of the text object of a level that a position (numbers between spaces) lies in."""
    return F.array_join(F.slice(F.split(position, " "), 1, LEVELS.index(level) + 1), "_")


def parent_id(object_: Column) -> Column:
    """Id of the object above: all numbers but the last."""
    return F.regexp_replace(object_, r"_?[^_]*$", "")


def upper(level: str) -> str:
    return LEVELS[max(0, LEVELS.index(level) - 1)]


def objects(words: DataFrame, level: str) -> DataFrame:
    """(object, tokens): words (position, word) gathered by text object of a level, in order of position."""
    path = F.transform(F.split("position", " "), lambda x: x.cast("int"))
    listed = F.array_sort(F.collect_list(F.struct(path.alias("p"), F.col("word"))))
    return words.groupBy(object_id(F.col("position"), level).alias("object")).agg(F.transform(listed, lambda x: x["word"]).alias("tokens"))


def parsed_words(spark: SparkSession, path: str) -> DataFrame:
    """(position, word, start_byte, end_byte) of JSON lines that an earlier parse left."""
    return spark.read.schema("token string, position string, start_byte bigint, end_byte bigint, object_type string").json(path).where("object_type = 'word'").select("position", F.col("token").alias("word"), "start_byte", "end_byte")


def kept_words(tokens: DataFrame, keep: DataFrame, column: str = "word") -> DataFrame:
    """Rows whose word is in a list of any length."""
    return tokens.join(keep.select(column).distinct(), column, "left_semi")


def dropped_words(tokens: DataFrame, stop: DataFrame, column: str = "word") -> DataFrame:
    return tokens.join(stop.select(column).distinct(), column, "left_anti")


def lemmas(tokens: DataFrame, table: DataFrame, column: str = "word") -> DataFrame:
    """Words replaced by a table (word, lemma) of any length; others stay."""
    return tokens.join(table, column, "left").withColumn(column, F.coalesce("lemma", column)).drop("lemma")


def batches(docs: DataFrame, n: int, *order: Column) -> DataFrame:
    """docs in n contiguous batches of about equal size."""
    from palimpsest.plans.tables import ordinal

    numbered = ordinal(docs, *order, name="_nth")
    total = docs.count()
    return numbered.withColumn("batch", F.floor((F.col("_nth") - 1) / max(1, -(-total // n))).cast("int")).drop("_nth")
