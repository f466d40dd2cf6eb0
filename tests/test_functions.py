import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.python import diff_parts
from palimpsest.operators import cleaning, network, vector_space
from palimpsest.sources import corpus, sinks


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("query, want", [("ÉTÉ", True), ("été NOT hiver", True), ("NOT été", False), ("hiver OR été", True), ('""', False), ('"Un été"', True), ("ét", False)])
def test_word_match(spark, query, want):
    assert value(spark, T.word_match(F.lit("Un été"), query)) is want


@pytest.mark.parametrize("query, want", [("5", True), ("1-5", True), ("6-", False), ("-5", True), ("(-3)-9", True), ("nonsense", True)])
def test_number_match(spark, query, want):
    assert value(spark, T.number_match(F.lit(5), query)) is want


@pytest.mark.parametrize("text, want", [("ca. 1789 or 1790", 1789), ("-44", -44), ("none", None), ("12.34", 12)])
def test_year(spark, text, want):
    assert value(spark, T.year(F.lit(text))) == want


def test_byte_slice_leaves_out_broken_characters(spark):
    assert value(spark, T.byte_slice(F.lit("aéb"), F.lit(2), F.lit(4))) == "b"
    assert value(spark, T.byte_slice(F.lit("aéb"), F.lit(-3), F.lit(3))) == "aé"


def test_truncate_passage(spark):
    text = "One two three. Four five six seven eight nine ten"
    assert value(spark, T.truncate_passage(F.lit(text), 20)) == "One two three."
    assert value(spark, T.truncate_passage(F.lit(text), 12)) == "One two..."
    assert value(spark, T.truncate_passage(F.lit("short"), 12)) == "short"


def test_gap_ngrams(spark):
    tokens = F.array(*map(F.lit, "abcd"))
    assert value(spark, T.gap_ngrams(tokens, 2, 1)) == ["a_b", "a_c", "b_c", "b_d", "c_d"]


def test_diff():
    assert diff_parts("a b  c", "a x c") == [{"op": "equal", "text": "a"}, {"op": "delete", "text": "b"}, {"op": "insert", "text": "x"}, {"op": "equal", "text": "c"}]


def test_character_diff_keeps_the_most_equal_characters(spark, monkeypatch):
    import random

    from palimpsest.functions import python as D

    rng = random.Random(4)
    for bits in (D.BITS, 30):
        monkeypatch.setattr(D, "BITS", bits)
        for _ in range(300):
            x, y = ("".join(rng.choice("abc é") for _ in range(rng.randrange(25))) for _ in range(2))
            best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i, c in enumerate(x):
                for j, d in enumerate(y):
                    best[i + 1][j + 1] = best[i][j] + 1 if c == d else max(best[i][j + 1], best[i + 1][j])
            raw = D.joined(D.edits(x, y))
            assert sum(len(t) for op, t in raw if op == "equal") == best[-1][-1]
            a, b = " ".join(x.split()), " ".join(y.split())
            for parts in (raw, [(p["op"], p["text"]) for p in D.character_parts(x, y)]):
                p, q = (x, y) if parts is raw else (a, b)
                assert "".join(t for op, t in parts if op != "insert") == p and "".join(t for op, t in parts if op != "delete") == q
    rows = spark.createDataFrame([("an honour", "an honor")], "a string, b string")
    got = rows.select(D.diff()("a", "b").alias("d")).first()["d"]
    assert [tuple(p) for p in got] == [("equal", "an hono"), ("delete", "u"), ("equal", "r")]


def test_phrases_by_expression_and_by_automaton_agree(spark):
    rows = spark.createDataFrame([(1, "Under the, License!"), (2, "nothing"), (3, None)], "id int, text string")
    few = {r["id"]: r["phrase_match"] for r in cleaning.phrase_matches(rows, ["the license"]).collect()}
    many = {r["id"]: r["phrase_match"] for r in cleaning.phrase_matches(rows, ["the license", *(f"zz{i}qq{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]).collect()}
    assert few == many == {1: True, 2: False, 3: False}


def test_centralities():
    links = pd.DataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "e", 5)], columns=["source", "target", "weight"])
    b = network.betweenness(links)
    assert b["b"] == pytest.approx(2 / 12) and b["c"] == pytest.approx(2 / 12) and b["a"] == 0
    ring = pd.DataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1)], columns=["source", "target", "weight"])
    assert np.allclose(network.eigenvector(ring), 1 / np.sqrt(3))
    assert network.communities(links)["b"] == network.communities(links)["c"]


def test_mmr_prefers_what_is_unlike():
    x = np.array([[1, 0.1], [1, 0.1001], [0.2, 1]])
    assert network.mmr(x, np.array([1.0, 0.3]), 2) == [0, 2] or network.mmr(x, np.array([1.0, 0.3]), 2) == [1, 2]


@pytest.mark.parametrize("parts", [{}, {"per": 700, "offer": 20}])
def test_representatives_of_a_large_cluster_are_those_of_all_its_members(spark, parts):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal([3, 1, 0, 0, 0, 0], 1, (2500, 6)), rng.normal(0, 1, (500, 6)), rng.normal(0, 1, (40, 6))])
    x[7] = x[3]
    label = np.repeat([0, 1], [3000, 40])
    rows = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x))], "id long, label int, v array<double>")
    got = {(r["label"], r["rank"]): r["id"] for r in network.representatives(rows, "label", "id", "v", **parts).collect()}
    want = {(c, k + 1): int(np.flatnonzero(label == c)[i]) for c in (0, 1) for k, i in enumerate(network.mmr(x[label == c], x[label == c].mean(0)))}
    assert got == want


def test_dense_similarity_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {(r["a"], r["b"]) for r in vector_space.dense_similarity(rows.where("id % 20 = 0"), rows, 2.0, block=7).collect()}
    assert got == {(i, j) for i in range(0, 60, 20) for j in range(60) if round(float(x[i] @ x[j]), 6) >= 2.0}


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo")
    assert [tuple(r) for r in corpus.plain(spark, str(tmp_path / "t")).collect()] == [("a.txt", "one\ntwo")]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "b.xml").write_text("<TEI><titleStmt><title>T</title><author>A</author></titleStmt><date>in 1762</date><body><p>hi</p></body></TEI>")
    assert tuple(corpus.tei(spark, str(tmp_path / "x")).first()) == ("b.xml", "T", "A", "1762", "<p>hi</p>")
    sinks.manifest(str(tmp_path / "m"), {"ngram": 3}, {"rows": 5})
    assert sinks.is_current(str(tmp_path / "m"), 5) and not sinks.is_current(str(tmp_path / "m"), 6)
    archive = sinks.back_up(str(tmp_path / "m"), str(tmp_path / "saved"))
    sinks.restore(archive, str(tmp_path / "back"))
    assert (tmp_path / "back" / "manifest.json").exists()


def test_object_ids(spark):
    p = F.lit("3 1 2 0 5 7 9")
    assert value(spark, corpus.object_id(p, "para")) == "3_1_2_0_5"
    assert value(spark, corpus.parent_id(F.lit("3_1_2"))) == "3_1"
    assert corpus.upper("doc") == "doc" and corpus.upper("sent") == "para"
