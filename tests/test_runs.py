"""Whole runs and hooks against plain Python versions."""

import collections
import random
import re

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from palimpsest import pipeline
from palimpsest.functions import text as T
from palimpsest.functions.python import porter
from palimpsest.operators import cleaning, evaluation, grouping, network, ngrams
from palimpsest.operators.matcher import MatchParams, chains, merged
from palimpsest.plans.catalog import QUERIES
from palimpsest.plans.tables import corpus, table

SF = "/root/testdata/sf0.001"


def grams_of(text):
    words, out = [(m[0].lower(), len(text[: m.start()].encode()), len(text[: m.end()].encode())) for m in regex.finditer(r"\p{L}+", text or "") if len(m[0]) >= 2], []
    for i in range(len(words) - 2):
        out.append((tuple(w for w, _, _ in words[i : i + 3]), i, words[i][1], words[i + 2][2]))
    return out


def aligned(source, target=None):
    """All alignments of documents {id: (year, text)}, pair by pair."""
    own = {d: grams_of(t) for d, (_, t) in source.items()}
    other = own if target is None else {d: grams_of(t) for d, (_, t) in target.items()}
    out = []
    for s, a in own.items():
        for t, b in other.items():
            if target is None and not (source[s][0], s) < (source[t][0], t):
                continue
            x, y = {g[0] for g in a}, {g[0] for g in b}
            if len(x & y) < 4 or len(x & y) * 100 / len(x) > 80:
                continue
            at = collections.defaultdict(list)
            for g in b:
                at[g[0]].append(g)
            points = sorted((g[1], h[1], g[2], g[3], h[2], h[3]) for g in a for h in at[g[0]])
            found = [[points[i][2], points[j][3], points[i][0], points[j][0], points[i][4], points[j][5], points[i][1], points[j][1], n] for i, j, n in chains([p[:2] for p in points])]
            out += [(s, t, *m) for m in merged(found, MatchParams())]
    return sorted(out)


def texts(spark):
    return {r["doc_id"]: (r["year"], r["text"]) for r in corpus(spark, SF).collect()}


def test_alignments_are_those_of_all_pairs(spark):
    got = sorted(map(tuple, QUERIES["alignments"](spark, SF).collect()))
    assert got == aligned(texts(spark)) and len(got) > 50


def test_alignments_across_corpora_are_those_of_all_pairs(spark):
    target = {r["item_id"]: (None, r["text"]) for r in table(spark, SF, "benchmark").collect()}
    got = sorted(map(tuple, QUERIES["cross_corpus_alignments"](spark, SF).collect()))
    assert got == aligned(texts(spark), target) and got


def test_hot_ngrams_meet_once_in_parts(spark):
    from palimpsest.operators import candidates as C

    rows = [(d, g, d % 7, 10 * d, 10 * d + 5) for d in range(40) for g in range(3) if (d + g) % 2]
    postings = spark.createDataFrame(rows, "doc_id long, ngram long, pos int, start_byte int, end_byte int")
    want = sorted((a[0], b[0], a[2], b[2]) for a in rows for b in rows if a[1] == b[1] and a[0] < b[0])
    for size in (3, 1000):
        assert sorted((r["s"], r["t"], r["s_idx"], r["t_idx"]) for r in C.matches(postings, list_size=size).collect()) == want
    grams = postings.select("doc_id", "ngram")
    crossed = collections.Counter((a[0], b[0]) for a in rows for b in rows if a[1] == b[1])
    assert {(r["s"], r["t"]): r["shared"] for r in C.across(grams, grams, 3).collect()} == crossed


def groups_of(rows):
    """The three passes over (id, file, start, end, t_file, t_start, t_end), one after the other."""
    head = {}
    for f in {r[1] for r in rows}:
        reach, now = None, None
        for r in sorted((r for r in rows if r[1] == f), key=lambda r: (r[2], -r[3])):
            if reach is None or r[2] >= reach:
                now, reach = [], r[3]
            reach = max(reach, r[3])
            now.append(r[0])
            head[r[0]] = now
    root = {i: i for i in head}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for i, members in head.items():
        join(i, members[0])
    for a in rows:
        for b in rows:
            if a[1] == b[4] and a[2] >= b[5] and a[3] <= b[6]:
                join(a[0], b[0])
    broad = {i: find(i) for i in head}
    by = collections.defaultdict(list)
    for r in rows:
        by[broad[r[0]], r[1]].append((r[0], r[2], r[3]))
    groups = {min(ids): (f, a, b, g) for (g, f), own in by.items() for a, b, ids in grouping.strict(own)}
    members = {r[0]: sorted(k for k, (f, a, b, _) in groups.items() if f == r[1] and r[2] < b and r[3] > a) for r in rows}
    counts = collections.Counter(k for ids in members.values() for k in ids)
    return broad, members, {k: (f, a, b, counts[k], g) for k, (f, a, b, g) in groups.items()}


@pytest.mark.parametrize("seed", range(3))
def test_grouping_run(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        a, b = rng.randrange(1500), rng.randrange(1500)
        rows.append((i, rng.randrange(4), a, a + rng.randrange(1, 120), rng.randrange(4), b, b + rng.randrange(1, 400)))
    df = spark.createDataFrame(rows, "id long, s_file long, s_start long, s_end long, t_file long, t_start long, t_end long")
    broad, members, groups = groups_of(rows)
    assert {r["id"]: r["group_id"] for r in grouping.initial_groups(df).collect()} == broad
    m, g = grouping.grouped(df)
    assert {r["id"]: r["group_ids"] for r in m.collect()} == members
    assert {r["group_id"]: tuple(r[c] for c in ("file", "start", "end", "count", "representative")) for r in g.collect()} == groups
    docs = spark.createDataFrame([(k, f"{'é' if k else 'x'}" * 2000, f"title {k}") for k in range(4)], "doc_id long, text string, title string")
    out = {r["group_id"]: r for r in grouping.group_sources(g, df, docs).collect()}
    assert out.keys() == groups.keys()
    for k, (f, a, b, _, first) in groups.items():
        assert out[k]["source_title"] == f"title {rows[first][1]}" and out[k]["source_passage"] == (docs_text := ("é" if f else "x") * 2000).encode()[a:b].decode("utf-8", "ignore") and docs_text


def test_grouping_queries_over_the_table(spark):
    members = {r["id"]: r["group_ids"] for r in QUERIES["passage_memberships"](spark, SF).collect()}
    groups = {r["group_id"]: r for r in QUERIES["passage_groups"](spark, SF).collect()}
    counts = collections.Counter(k for ids in members.values() for k in ids)
    assert members and {k: r["count"] for k, r in groups.items()} == counts and all(r["source_title"] == f"doc_{r['file']}" for r in groups.values() if r["representative"] == r["group_id"])


def test_strict_passage_groups_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    got = QUERIES["strict_passage_groups"](spark, SF).collect()
    assert sum(r["n"] for r in got) == rows and all(r["start"] < r["end"] for r in got) and len({(r["group"], r["file"], r["nth"]) for r in got}) == len(got)


PORTER = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic", "vileli": "vile", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is", "generalizations": "gener",
}


def test_porter_stems_of_the_paper():
    assert {w: porter(w) for w in PORTER} == PORTER


def test_porter_query_keeps_all_words(spark):
    got = {r["stem"]: r["n"] for r in QUERIES["porter_stems"](spark, SF).collect()}
    want = collections.Counter(porter(w.lower()) for _, t in texts(spark).values() for w in regex.findall(r"\p{L}+", t or ""))
    assert got == want


def two_cliques():
    edges = [(a, b, 3) for side in ("abcde", "vwxyz") for i, a in enumerate(side) for b in side[i + 1 :]] + [("e", "v", 1)]
    return pd.DataFrame(edges, columns=["source", "target", "weight"])


def test_louvain_communities():
    found = network.communities(two_cliques())
    assert found.groupby(found).groups.keys() == {0, 1} and len({found[c] for c in "abcde"}) == 1 == len({found[c] for c in "vwxyz"})
    rng = random.Random(3)
    for _ in range(5):
        names = [f"n{k}" for k in range(30)]
        links = pd.DataFrame([(a, b, rng.randrange(1, 9)) for a in names for b in names if a < b and rng.random() < (0.5 if int(a[1:]) % 3 == int(b[1:]) % 3 else 0.05)], columns=["source", "target", "weight"])
        best, planted = network.communities(links), pd.Series({n: int(n[1:]) % 3 for n in names})
        value = network.modularity(links, best)
        assert value >= network.modularity(links, planted[sorted({*links.source, *links.target})]) - 0.02
        for a in set(best):  # no two communities can join and gain
            for b in set(best):
                assert network.modularity(links, best.replace(a, b)) <= value + 1e-9
    assert network.communities(two_cliques().iloc[:0]).empty


def links_of(spark):
    return QUERIES["network_edges"](spark, SF).toPandas()


def test_centralities_of_the_table(spark):
    links = links_of(spark)
    names = sorted({*links.source, *links.target})
    at, n = {x: i for i, x in enumerate(names)}, len(names)
    w, d = np.zeros((n, n)), np.full((n, n), np.inf)
    for s, t, x in links[["source", "target", "weight"]].itertuples(index=False):
        w[at[s], at[t]] = d[at[s], at[t]] = x
    got = {r["node"]: r["centrality"] for r in QUERIES["eigenvector_centrality"](spark, SF).collect()}
    values, vectors = np.linalg.eig(w.T + np.eye(n))
    lead = np.abs(vectors[:, np.argmax(values.real)].real)
    assert np.allclose([got[x] for x in names], lead / np.linalg.norm(lead), atol=1e-3)
    np.fill_diagonal(d, 0)
    direct = d.copy()
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[[k], :])
    count = np.zeros((n, n))  # shortest paths
    for i in range(n):
        for j in sorted(range(n), key=lambda j: d[i, j]):
            count[i, j] = 1 if i == j else sum(count[i, k] for k in range(n) if k != j and np.isfinite(direct[k, j]) and np.isfinite(d[i, k]) and d[i, k] + direct[k, j] == d[i, j])
    between = np.zeros(n)
    for v in range(n):
        for s in range(n):
            for t in range(n):
                if len({s, t, v}) == 3 and np.isfinite(d[s, t]) and d[s, v] + d[v, t] == d[s, t]:
                    between[v] += count[s, v] * count[v, t] / count[s, t]
    got = {r["node"]: r["centrality"] for r in QUERIES["betweenness_centrality"](spark, SF).collect()}
    assert np.allclose([got[x] for x in names], between / ((n - 1) * (n - 2)))
    own = network.communities(links)
    assert {r["node"]: r["community"] for r in QUERIES["network_communities"](spark, SF).collect()} == own.astype(float).to_dict()


def test_truncation_query(spark):
    delimiters = T.DELIMITERS

    def cut(text, limit=600):
        if text is None or len(text) <= limit:
            return text
        head = text[:limit]
        for mark in delimiters:
            at = head.rfind(mark)
            if at > limit / 2:
                return head[: at + 1]
        return re.sub(" [^ ]*$", "", head) + "..."

    rows = QUERIES["passage_truncation"](spark, SF).collect()
    whole = {d: t for d, (_, t) in texts(spark).items()}
    assert all(r["passage"] == cut(whole[r["doc_id"]]) for r in rows) and any((r["passage"] or "") != (whole[r["doc_id"]] or "") for r in rows)


def test_score_and_embedding_queries(spark):
    said = {(r["conv_id"], r["turn"]): r["text"] for r in table(spark, SF, "conversations").collect()}
    for r in QUERIES["llm_scores_stub"](spark, SF).collect():
        a, b = (set((said[r["conv_id"], r["turn"] + k] or "").lower().split()) for k in (0, 1))
        assert r["llm_similarity"] == (1.0 + round(4.0 * len(a & b) / len(a | b)) if a | b else 1.0)
    for name in ("hashed_embeddings", "word2vec_embeddings"):
        for r in QUERIES[name](spark, SF).limit(50).collect():
            assert abs(np.linalg.norm(r["embedding"]) - 1) < 1e-6 or not any(r["embedding"])
    vectors = {r["vec_id"]: np.array(r["embedding"]) for r in table(spark, SF, "embeddings").collect()}
    placed = {r["vec_id"]: np.array(r["place"]) for r in QUERIES["reduced_dimensions"](spark, SF).collect()}
    x = np.stack([vectors[k] for k in sorted(vectors)]).astype(float)
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(np.stack([placed[k] for k in sorted(vectors)])), np.abs(x @ axes[:2].T), atol=1e-5)
    cluster = {r["vec_id"]: r["cluster"] for r in QUERIES["kmeans_clusters"](spark, SF).collect()}
    labels = np.array([cluster[k] for k in sorted(vectors)])
    means = np.stack([x[labels == c].mean(0) for c in range(labels.max() + 1)])
    nearest = ((x[:, None] - means[None]) ** 2).sum(2).argmin(1)
    assert cluster.keys() == vectors.keys() and np.mean(nearest == labels) > 0.9


def test_phrases_of_a_table(spark):
    rng = random.Random(7)
    word = lambda: rng.choice("ab abc bca c ca bb été".split())
    rows = [(i, " ".join(word() for _ in range(rng.randrange(12)))) for i in range(150)] + [(900, None), (901, ""), (902, "A,b  C! 7")]
    said = [" ".join(word() for _ in range(k)) for k in (1, 2, 3, 4, 5, 6) for _ in range(3)]
    clean = lambda t: re.sub(" +", " ", regex.sub(r"[\p{P}\p{S}\p{N}]+", "", t.lower())).strip()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for some in (said, said[:3], said[3:9], said[9:], ["zz"]):
        got = [r["doc_id"] for r in cleaning.phrases_within(docs, spark.createDataFrame([(s,) for s in some], "text string")).collect()]
        assert sorted(got) == [i for i, t in rows if t is not None and any(clean(s) in clean(t) for s in some)]


def test_words_with_their_bytes(spark):
    rows = [(1, "Été, l'hiver 7 x"), (2, None), (3, ""), (4, "1 2"), (5, "ab")]
    got = [tuple(r) for r in ngrams.words_at(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(d, i, m[0].lower(), len(t[: m.start()].encode()), len(t[: m.end()].encode())) for d, t in rows for i, m in enumerate(regex.finditer(r"\p{L}+", t or ""))]
    assert sorted(got) == want


def test_interest_of_unread_and_failed_answers(spark):
    rows = spark.createDataFrame([("a", 12.0), ("b", 40.0), ("c", None), ("d", -1.0)], "source_passage string, answer double")
    got = evaluation.interest(rows, model=lambda _: F.col("answer"))
    assert {r["source_passage"]: (r["interest"], r["banality"]) for r in got.collect()} == {"a": (12.0, True), "b": (40.0, False), "c": (-1.0, True), "d": (-1.0, False)}
    length = evaluation.interest(rows, model=evaluation.scorer(lambda s: s.str.len().astype(float)))
    assert {r["interest"] for r in length.collect()} == {1.0}


def test_expanded_passage_falls_back_where_offsets_are_missing(spark):
    from palimpsest.operators.passages import expanded

    docs = spark.createDataFrame([(1, "aaaa bbbb cccc dddd")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, 5, 9, "bbbb"), (2, None, None, "lost")], "source_doc_id long, source_start_byte int, source_end_byte int, source_passage string")
    got = {r["source_doc_id"]: r["expanded_passage"] for r in expanded(rows, docs, around=5).collect()}
    assert got == {1: "aaaa bbbb cccc", 2: "lost"}


def test_widened_matches_follow_the_scores(spark):
    from palimpsest.operators.cleaning import stub_scorer

    said = {(r["conv_id"], r["turn"]): r["text"] for r in table(spark, SF, "conversations").collect() if r["text"] is not None}
    score = lambda a, b: stub_scorer(pd.Series([a]), pd.Series([b]))[0]
    text = lambda c, a, b: " ".join(said[c, k] for k in range(a, b + 1) if (c, k) in said)
    want = {}
    for c, k in said:
        if (c + 1, k) not in said:
            continue
        s, t = [k, k], [k, k]
        for _ in range(2):
            if want.get((c, k)):
                break
            back = [(x[0] - ((d, x[0] - 1) in said), x[1]) for d, x in ((c, s), (c + 1, t))]
            on = [(x[0], x[1] + ((d, x[1] + 1) in said)) for d, x in ((c, s), (c + 1, t))]
            o, p, f = (score(text(c, *x), text(c + 1, *y)) for x, y in ((s, t), back, on))
            way = "both" if p >= o and f >= o and abs(p - f) < 0.001 else "previous" if p >= o and (f < o or p > f) else "following" if f >= o else "none"
            if way == "none":
                break
            if way in ("both", "previous"):
                s, t = [back[0][0], s[1]], [back[1][0], t[1]]
            if way in ("both", "following"):
                s, t = [s[0], on[0][1]], [t[0], on[1][1]]
        want[c, k] = (*s, *t)
    got = {(r["conv_id"], r["turn"]): (r["s_first"], r["s_last"], r["t_first"], r["t_last"]) for r in QUERIES["widened_matches"](spark, SF).collect()}
    assert got == want and any(v[1] > v[0] for v in want.values())
