"""What keeps queries in proportion to their input: plans without shuffles that aren't needed, hashes without collisions."""

import itertools

import numpy as np
import pytest

from palimpsest.operators import ngrams as N
from palimpsest.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_ngram_hashes_use_all_their_bits(spark):
    """half of the hash was a sum of bytes, which is the same for a third of all short n-grams."""
    words = ["".join(w) for w in itertools.product("abcdefghij", repeat=3)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(reversed(words)))], "doc_id long, text string")
    got = np.array([r["ngram"] for r in N.postings(docs).collect()], np.int64).view(np.uint64)
    assert len(set(got)) == len(got) == 2 * 998
    for shift in (0, 16, 32):
        assert len(set((got >> np.uint64(shift)) & np.uint64(0xFFFFFFFF))) > 1990


def test_order_of_words_counts_in_a_hash(spark):
    docs = spark.createDataFrame([(1, "ab cd ef ab cd Ef"), (2, "cd ab ef"), (3, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["pos"]): r["ngram"] for r in N.postings(docs).collect()}
    assert len(got) == 5 and got[1, 0] == got[1, 3] and len(set(got.values())) == 4


@pytest.mark.parametrize("name", ["gap_ngrams", "hashed_ngrams"])
def test_counts_of_a_row_need_no_shuffle(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF))


def test_each_different_word_is_hashed_once():
    words = np.array(["one", "two", "One", "one"] * 5, object)
    got = N.hash_of(words)
    assert got.dtype == np.uint64 and len(set(got.tolist())) == 2 and got[0] == got[2]


def test_lengths_are_measured_once_for_all_bins(spark):
    assert plan(QUERIES["passage_length_histogram"](spark, SF)).count("regexp_extract_all") == 1


def test_only_ngrams_of_both_corpora_are_written(spark, monkeypatch):
    from palimpsest.operators import candidates as C

    kept = []
    monkeypatch.setattr(C, "written", lambda df, name: kept.append(sorted(map(tuple, df.collect()))) or df)
    source = spark.createDataFrame([(d, g) for d in range(20) for g in (100 + d, d % 3, 7)], "doc_id long, ngram long")
    target = spark.createDataFrame([(1, 7), (1, 2), (2, 7)], "doc_id long, ngram long")
    got = {(r["s"], r["t"]): r["shared"] for r in C.across(source, target).collect()}
    assert got == {(d, t): 1 + (t == 1 and d % 3 == 2) for d in range(20) for t in (1, 2)}
    assert [len(rows) for rows in kept] == [20 + 6]


def test_intervals_are_sorted_in_more_partitions_where_there_are_more(spark, monkeypatch):
    from palimpsest.operators import grouping as G
    from palimpsest.plans import tables

    monkeypatch.setattr(tables, "SORTED_ROWS", 50)
    rows = spark.createDataFrame([(i % 40, 3 * i, 3 * i + 2) for i in range(1000)], "file long, start long, end long")
    found = G.islands(rows, "file", "start", "end")
    assert found.rdd.getNumPartitions() == 20 and found.count() == 1000


def test_words_are_sorted_without_a_comparator(spark):
    """array_sort calls an interpreted comparison for each two words; sort_array doesn't."""
    assert "array_sort(" not in plan(QUERIES["word_order_free_ngrams"](spark, SF))
