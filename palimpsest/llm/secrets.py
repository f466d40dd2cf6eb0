"""Secret scan with corpus-wide ownership frequency.

Each text is searched for base kinds (assignments, access keys, hex strings) and for further kinds with a format of
their own. A value is hashed; over the corpus the hash's distinct repositories and owners are counted. A value that many
owners hold is a widely copied example, one that belongs to few owners and looks random is taken for live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import common

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of at least 16 is what is left of all runs
#: Kinds that the method adds; they count as secrets only where ownership says live.
FURTHER = {
    "github": re.compile(r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"),
}
HINTS = {"github": "gh", "slack": "xox", "google": "AIza", "jwt": "eyJ", "pem": "-----BEGIN"}
KINDS = ["assign", "access", "hex", *FURTHER]
BASE = 3
#: A text without this has no candidate of any kind.
ANY = r"(?i)password|passwd|secret|token|api_?key|akia|[0-9a-f]{16}|gh[oprsu]_|xox[abprs]-|aiza|eyj|private key"

#: A value that at least so many distinct owners hold is a widely copied example.
COPIED_OWNERS = 3
#: Bits a character that a live value has at least.
LIVE_ENTROPY = 2.5

SCHEMA = "{id} long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, cands array<struct<start:long,rank:int,end:long,hash:string,random:boolean>>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_random(value: str) -> bool:
    """Letters and digits mixed, and many different ones: not a word, a number or a placeholder."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= LIVE_ENTROPY


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of kind, end, value) in order of start, then rank. Offsets count code points."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    for rank, (kind, pattern) in enumerate(FURTHER.items(), BASE):
        if HINTS[kind] in text:
            found += [(m.start(), rank, m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(found)


def written(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def _scanner(name: str):
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, base, cands = ([], [], []), [], []
        for text in batch.column("text").to_pylist():
            found = candidates(text or "")
            own = [x for x in found if x[1] < BASE]
            for rank in range(BASE):
                counts[rank].append(sum(x[1] == rank for x in own))
            base.append(hashlib.sha256(written(own).encode()).hexdigest())
            cands.append([{"start": s, "rank": k, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()[:32], "random": looks_random(v)} for s, k, e, v in found])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("hash", pa.string()), ("random", pa.bool_())]))
        return pa.RecordBatch.from_arrays([batch.column(name), batch.column("owner"), batch.column("repo"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(cands, kind)], names=[name, "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "cands"])

    return each


def ownership(cands: DataFrame) -> DataFrame:
    """(hash, seen, repos, owners) of (hash, owner, repo) rows, pre-aggregated level by level so that no hot value meets one task."""
    by_repo = cands.groupBy("hash", "owner", "repo").agg(F.count("*").alias("seen"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("seen").alias("seen"), F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("seen").alias("seen"), F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def _found(docs: DataFrame, name: str, owner: Column | None, repo: Column | None) -> DataFrame:
    """Candidates of each row of docs (``name``, text and what owner and repo read), with ``name`` passed on."""
    owner = F.coalesce(F.col("source").cast("string"), F.lit("")) if owner is None else owner
    repo = F.coalesce(F.col("doc_id").cast("string"), F.lit("")) if repo is None else repo
    return common.scan(docs.select(name, "text", owner.alias("owner"), repo.alias("repo")), lambda: _scanner(name), SCHEMA.format(id=name))


def judged(rows: DataFrame) -> DataFrame:
    """(row, all, live, n_live, n_copied) of rows (row, owner, repo, cands) with candidates: what ownership says of each."""
    each = rows.where(F.size("cands") > 0).select("row", "owner", "repo", F.inline("cands"))
    held = common.stash(ownership(each), "secret-owners")
    met = common.attach(each.select("row", "start", "rank", "end", "random", "hash"), held, "hash", "seen")
    met = met.select("row", "start", "rank", "end", (F.col("random") & (F.col("owners") < COPIED_OWNERS)).alias("is_live"), (F.col("owners") >= COPIED_OWNERS).alias("is_copied"))
    span = F.struct("start", "rank", "end")
    return met.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when((F.col("rank") < BASE) | F.col("is_live"), span))).alias("all"),
        F.array_sort(F.collect_list(F.when(F.col("is_live"), F.struct("start", "end")))).alias("live"),
        F.sum(F.col("is_live").cast("long")).alias("n_live"),
        F.sum(F.col("is_copied").cast("long")).alias("n_copied"),
    )


def scan(docs: DataFrame, owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text, source): base counts and digest, all spans, and what ownership says.

    owner and repo are columns of docs; by default the source owns each of its documents, and a document is a
    repository. Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, live (spans taken for
    live: start, end). Null and empty texts have no spans; a null owner counts as one owner of that name, a null id as
    one repository. Rows are judged one by one, so repeated rows and rows of one id don't mix; an empty table gives an
    empty result.
    """
    rows = common.stash(_found(docs, "doc_id", owner, repo).withColumn("row", F.monotonically_increasing_id()), "secrets")
    per_row = judged(rows)
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform("all", lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"], x["end"])), ",")
    nothing = F.expr("array()").cast("array<struct<start:long,end:long>>")
    return rows.join(per_row, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(spans, F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"), F.coalesce("live", nothing).alias("live"),
    )


def redacted(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """text with each union of overlapping spans replaced by mark."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


@F.arrow_udf(returnType=T.BooleanType())
def may_hold(texts: pa.Array) -> pa.Array:
    """Whether a text may hold a candidate; never null."""
    return pc.fill_null(pc.match_substring_regex(texts, ANY), False)


@F.arrow_udf(returnType=T.StringType())
def cut(texts: pa.Array, lives: pa.Array) -> pa.Array:
    return pa.array([t if not live else redacted(t, [(x["start"], x["end"]) for x in live]) for t, live in zip(texts.to_pylist(), lives.to_pylist())], pa.string())


def redact(docs: DataFrame, owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """docs with live-looking secrets replaced by a mark and n_chars, where there is one, counted anew; no document goes.

    Only rows that may hold a candidate are written, each under a number of its own, and meet their verdicts by that
    number, so rows that share an id (or have none) and repeated rows are cut each by its own spans. Null and empty
    texts stay as they are; an empty table gives an empty result. The columns are those of docs, whatever their names.
    """
    kept, names = common.boxed(docs)
    text = F.col(names["text"])
    some = common.stash(kept.where(may_hold(text)).withColumn("row", F.monotonically_increasing_id()), "secret-rows")
    named = some.select("row", *(F.col(box).alias(c) for c, box in names.items() if c != "row"))
    rows = common.stash(_found(named, "row", owner, repo).select("row", "owner", "repo", "cands"), "secrets")
    live = judged(rows).where("n_live > 0").select("row", "live")
    met = some.join(live, "row", "left").withColumn("now", cut(text, "live"))
    new = {"text": F.col("now")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("live").isNotNull(), F.char_length("now").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(names["n_chars"]))
    return common.unboxed(kept.where(~may_hold(text)), names).union(common.unboxed(met, names, new))
