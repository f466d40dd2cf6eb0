"""Hooks for models: scores of interest, classes, summaries of clusters, tags of words.

A model is a function over pandas columns that is passed in; the ones given here need no network and can be stated in
SQL, so that what is done around a model can be verified.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions import text as T

#: What a passage's interest is, from 1 to 100; -1 where the call failed, null where the answer can't be read.
Interest = Callable[[Column], Column]
INTERESTING = 40


def distinct_words(text: Column) -> Column:
    """Stands for a model: as many points as a passage has different words, at most 100."""
    return F.least(F.size(F.array_distinct(T.tokens(text))), F.lit(100)).cast("double")


def interest(rows: DataFrame, text: str = "source_passage", model: Interest = distinct_words, least: int = INTERESTING) -> DataFrame:
    """rows with a model's interest in a passage and whether that makes it banal.

    A score below ``least`` is banal. An answer that can't be read counts as -1 and banal, a failed call as -1 and not.
    """
    score = model(F.col(text))
    return rows.withColumn("interest", F.coalesce(score, F.lit(-1.0))).withColumn("banality", F.when(score.isNull(), F.lit(True)).otherwise((score >= 0) & (score < least)))


def scorer(function: Callable[[pd.Series], pd.Series]) -> Interest:
    """A pandas function of passages as a model of interest."""
    return lambda text: F.pandas_udf(function, "double")(text)


#: Scores of each label for a text, each between 0 and 1.
Classifier = Callable[[Column, dict[str, str]], dict[str, Column]]


def by_description(text: Column, labels: dict[str, str]) -> dict[str, Column]:
    """Stands for a zero-shot model: the share of a text's words that occur in a label's description."""
    words = T.tokens(text)
    inside = lambda said: F.size(F.filter(words, lambda w: w.isin(*said.lower().split())))
    return {name: F.when(F.size(words) > 0, inside(said) / F.size(words)).otherwise(F.lit(0.0)) for name, said in labels.items()}


def classified(rows: DataFrame, text: str, labels: dict[str, str], least: float = 0.3, k: int = 3, model: Classifier = by_description) -> DataFrame:
    """rows with the k best classes of at least a confidence (ties by name) and their scores; several may hold at once."""
    scores = F.array(*(F.struct((-score).alias("n"), F.lit(name).alias("label")) for name, score in model(F.col(text), labels).items()))
    best = F.slice(F.array_sort(F.filter(scores, lambda x: -x["n"] >= least)), 1, k)
    return rows.withColumns({"passage_categories": F.transform(best, lambda x: x["label"]), "category_scores": F.transform(best, lambda x: F.round(-x["n"], 3))})


def top_words(rows: DataFrame, cluster: str, text: str, k: int = 3, least: int = 4) -> DataFrame:
    """(cluster, label): stands for a model's summary; the k words of at least so many letters that most rows of a cluster have, ties by word."""
    words = rows.select(cluster, F.explode(F.array_distinct(T.min_length(T.tokens(F.col(text)), least))).alias("word"))
    counts = words.groupBy(cluster, "word").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), "word"))
    best = counts.withColumn("nth", nth).where(F.col("nth") <= k)
    return best.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "word"))), lambda x: x["word"]), ", ").alias("label"))


def summary_prompts(passages: DataFrame, cluster: str, rank: str, text: str, per: int = 20) -> DataFrame:
    """(cluster, batch, prompt): requests to sum up a cluster's representative passages, so many at a time, in order of rank."""
    batch = F.floor((F.col(rank) - 1) / per).cast("int").alias("batch")
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(text).alias("text"))))
    rows = passages.groupBy(cluster, batch).agg(listed.alias("p"))
    body = F.array_join(F.transform("p", lambda x: F.concat(F.lit("- "), x["text"])), "\n")
    return rows.select(cluster, "batch", F.concat(F.lit("What do these passages have in common? Answer in one sentence.\n"), body).alias("prompt"))


def label_prompts(summaries: DataFrame, cluster: str, order: str, summary: str) -> DataFrame:
    """(cluster, prompt): requests for one label from a cluster's summaries, in their order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(summary).alias("text"))))
    return summaries.groupBy(cluster).agg(F.concat(F.lit("Name the theme in at most five words.\n"), F.array_join(F.transform(listed, lambda x: x["text"]), "\n")).alias("prompt"))


def labelled_nodes(nodes: DataFrame, labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """nodes with the label of their cluster, empty where there is none."""
    return nodes.join(labels.select(cluster, F.col("label").alias("_label")), cluster, "left").withColumn("label", F.coalesce("_label", F.lit(""))).drop("_label")


def by_ending(word: Column) -> Column:
    """Stands for a tagger: a universal tag from a word's last letters."""
    return F.when(word.endswith("ly"), "ADV").when(word.endswith("ing") | word.endswith("ed"), "VERB").when(word.rlike(r"^\p{N}+$"), "NUM").otherwise("NOUN")


def kept_tags(words: DataFrame, keep: list[str], tagger: Callable[[Column], Column] = by_ending, word: str = "word") -> DataFrame:
    """Rows whose word has one of the tags; all rows where no tag is listed."""
    return words.where(tagger(F.col(word)).isin(*keep)) if keep else words
