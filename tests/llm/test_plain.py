"""Queries over the whole small table against plain versions that share no code with the operators' own."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from palimpsest.llm import language, secrets, toxicity
from palimpsest.llm.common import stash, table
from palimpsest.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()


def near(rows, share=0.65):
    """(smallest id, its row) of each row's group, and its number of links, by comparing all pairs of (id, text)."""
    sets = [shingles(t) for _, t in rows]
    holders = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    shared = collections.Counter()
    for ks in holders.values():
        shared.update((a, b) for i, a in enumerate(ks) for b in ks[i + 1 :])
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if n >= share * max(len(sets[a]), len(sets[b])) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[find(k)] = min(best.get(find(k), (i, k)), (i, k))
    return [best[find(k)] for k in range(len(rows))], links


def test_near_documents_of_the_table(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect())
    groups, links = near(rows)
    got = {r["doc_id"]: (r["group_id"], r["n_links"], r["kept"]) for r in QUERIES["op2_near_documents"](spark, SF).collect()}
    assert got == {i: (g[0], n, g[0] == i) for (i, _), g, n in zip(rows, groups, links)} and sum(links)


def terms(text):
    return {zlib.crc32(w.encode()) % toxicity.PLACES for w in re.findall(r"[^\W\d_]+", (text or "").lower())}


def plain_score(machine, text):
    """The machine's formula, pair by pair."""
    at = sorted(machine.terms[t] for t in terms(text) if t in machine.terms)
    raw = machine.bias + sum(machine.weights[i] for i in at)
    v = machine.vectors[at]
    pairs = v @ v.T
    raw += sum(float(pairs[i, i + 1 :].sum()) for i in range(len(at)))
    return 1 / (1 + math.exp(-max(-30, min(30, raw))))


def test_toxicity_scores_are_the_sum_over_pairs(spark):
    machine = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    got = QUERIES["op3_toxicity"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_score(machine, texts[r["doc_id"]])
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_a_rare_toxic_label_is_learned(spark, monkeypatch):
    """One label in a hundred: a sample by hash alone would hold next to none of it."""
    monkeypatch.setattr(toxicity, "TRAINING_ROWS", 150)
    monkeypatch.setattr(toxicity, "TOXIC_ROWS", 60)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{chr(97 + x % 26)}{chr(97 + x // 26)}" for x in rng.integers(0, 200, 12)) + (" you idiot" if i % 100 == 0 else "")) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 100 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert sum(r["predicted"] for r in got if r["doc_id"] % 100 == 0) >= 55 and not any(r["predicted"] for r in got if r["doc_id"] % 100)


def test_a_rare_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "TRAINING_ROWS", 20)
    monkeypatch.setattr(language, "LANGUAGE_ROWS", 10)
    rows = [(i, "the quick brown fox and the lazy dog " * 3, "en") for i in range(900)] + [(2000 + i, "быстрая лиса и ленивая собака " * 3, "ru") for i in range(6)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r["lang_pred"] == ("ru" if r["doc_id"] >= 2000 else "en") for r in got)


def mixed_gram(codes):
    """The hash of a run of one to three code points."""
    m = (1 << 32) - 1
    if len(codes) == 1:
        x = codes[0] * 2654435761
    else:
        x = codes[0] * 0x9E3779B1 + codes[1] * 0x85EBCA6B + 1
    if len(codes) == 3:
        x = (x & m) * 0xC2B2AE35 + codes[2] * 0x27D4EB2F + 2
    x &= m
    x ^= x >> 15
    return (x * 0x2C1B3C6D & m) >> 16


def plain_grams(text):
    import unicodedata

    chars = [c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower() + " "]
    kept = [ord(c) for k, c in enumerate(chars) if c != " " or k and chars[k - 1] != " "]
    out = collections.Counter(mixed_gram([c]) for c in kept if c != 32)
    for n in (2, 3):
        out.update(mixed_gram(kept[k : k + n]) for k in range(len(kept) - n + 1))
    return out


def test_language_scores_are_those_of_a_plain_model(spark):
    docs = table(spark, SF, "documents")
    model = language.train(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in QUERIES["op10_language_id"](spark, SF).collect():
        text = texts[r["doc_id"]] or ""
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        grams = plain_grams(text)
        n = sum(grams.values())
        raw = [(sum(c * float(model.weights[g, k]) for g, c in grams.items()) * language.SCALE / n + model.bias[k]) / model.temperature for k in range(len(model.languages))]
        e = [math.exp(x - max(raw)) for x in raw]
        assert r["lang_pred"] == model.languages[raw.index(max(raw))] and abs(r["score"] - max(e) / sum(e)) < 1e-6


def test_document_frequencies_are_those_of_all_learned_texts(spark):
    docs = table(spark, SF, "documents").where("lang IS NOT NULL AND text IS NOT NULL")
    df, n = language.frequencies(docs)
    texts = [r["text"] for r in docs.select("text").collect()]
    want = collections.Counter(g for t in texts for g in plain_grams(t))
    assert n == len(texts) and {k: int(v) for k, v in enumerate(df) if v} == dict(want)


def test_weights_follow_the_regularised_leader():
    """Against the update rule coordinate by coordinate."""
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(30, 5, replace=False)), rng.dirichlet(np.ones(5))) for _ in range(30)]
    names = [("a", "b", "c")[int(r[0][0]) % 3] for r in rows]
    model = language.fit(rows, names)
    df = collections.Counter(int(p) for r in rows for p in r[0])
    idf = {p: math.log((1 + len(rows)) / (1 + n)) + 1 for p, n in df.items()}
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(key):
        if abs(z[key]) <= language.L1:
            return 0.0
        return -(z[key] - math.copysign(language.L1, z[key])) / ((language.BETA + math.sqrt(n[key])) / language.ALPHA + language.L2)

    order = np.random.default_rng(11)
    for _ in range(language.EPOCHS):
        for i in order.permutation(len(rows)):
            x = {int(p): s * idf[int(p)] * language.SCALE for p, s in zip(*rows[i])} | {"bias": 1.0}
            w = {(f, k): weight((f, k)) for f in x for k in "abc"}
            raw = [sum(x[f] * w[f, k] for f in x) for k in "abc"]
            e = [math.exp(r - max(raw)) for r in raw]
            for k, p in zip("abc", e):
                error = p / sum(e) - (names[i] == k)
                for f, value in x.items():
                    g = value * error
                    z[f, k] += g - (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / language.ALPHA * w[f, k]
                    n[f, k] += g * g
    for j, k in enumerate("abc"):
        assert abs(model.bias[j] - weight(("bias", k))) < 1e-6
        assert all(abs(model.weights[p, j] - weight((p, k)) * idf[p]) < 1e-4 for p in idf)
    assert (model.weights == 0).mean() > 0.9


def without_blanks(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_pipeline_stage_by_stage(spark):
    """Each stage's rows from its actual input, by plain Python."""
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    names, stages = docs.columns, dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    at, text = names.index("doc_id"), names.index("text")

    machine = toxicity.train(docs, table(spark, SF, "labels"))
    kept = stash(stages["toxicity"](spark, docs, SF), "plain")
    assert rows(kept) == [r for r in rows(docs) if plain_score(machine, r[text]) < 0.7]

    before, kept = kept, stash(stages["exact dedup"](spark, kept, SF), "plain")
    best = {}
    for r in rows(before):
        k = without_blanks(r[text])
        best[k] = min([best[k], r] if k in best else [r], key=lambda r: (-len(r[text] or ""), r[at]))
    assert rows(kept) == sorted(best.values(), key=repr)

    before, kept = kept, stash(stages["near dedup"](spark, kept, SF), "plain")
    pairs = sorted((r[at], r[text]) for r in rows(before))
    stay = {g[0] for g in near(pairs)[0]}
    assert rows(kept) == [r for r in rows(before) if r[at] in stay]

    before, kept = kept, stash(stages["secret scan"](spark, kept, SF), "plain")
    owners = collections.defaultdict(set)
    for r in rows(before):
        for *_, value in secrets.candidates(r[text] or ""):
            owners[value].add(r[names.index("source")] or "")
    want = []
    for r in rows(before):
        spans = [(a, b) for a, _, b, v in secrets.candidates(r[text] or "") if len(owners[v]) < secrets.COPIED_OWNERS and secrets.looks_random(v)]
        hide = [any(a <= k < b for a, b in spans) for k in range(len(r[text] or ""))]
        out = "".join(c if not hide[k] else "[SECRET]" if not k or not hide[k - 1] or any(a == k for a, b in spans) and not any(a < k < b for a, b in spans) else "" for k, c in enumerate(r[text] or ""))
        new = list(r)
        if spans:
            new[text], new[names.index("n_chars")] = out, len(out)
        want.append(tuple(new))
    assert rows(kept) == sorted(want, key=repr)

    packed = stages["packing"](spark, kept, SF).collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == collections.Counter(r[at] for r in rows(kept))
    run = corpus_pipeline.run(spark, SF).collect()
    digest = lambda found: hashlib.sha256(repr(sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)).encode()).hexdigest()
    assert digest(run) == digest(packed)


@pytest.mark.parametrize("hot", [1, 10**9])
def test_repeated_passages_of_the_table(spark, monkeypatch, hot):
    """By counting all windows; whether minimisers count as hot makes no difference."""
    from palimpsest.llm import substrings

    monkeypatch.setattr(substrings, "HOT", hot)
    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in table(spark, SF, "documents").collect()}
    seen = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    want = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = True
        want[i] = (len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op7_repeated_passages"](spark, SF).collect()}
    assert got == want and any(n for _, n, _ in want.values())
