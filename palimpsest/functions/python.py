"""Functions that need Python, in Arrow batches."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Beyond so many bits of rows kept for the way back, a diff is cut in two where its halves have the most in common.
BITS = 1 << 28


def diff_parts(a: str | None, b: str | None) -> list[dict]:
    """What two passages share and where they differ, as pieces: equal, delete or insert. White space is squeezed first."""
    x, y = " ".join((a or "").split()), " ".join((b or "").split())
    # whole words, so that long passages stay affordable
    p, q = x.split(" "), y.split(" ")
    out = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, p, q, autojunk=False).get_opcodes():
        if op in ("equal", "delete", "replace") and j > i:
            out.append({"op": "equal" if op == "equal" else "delete", "text": " ".join(p[i:j])})
        if op in ("insert", "replace") and m > k:
            out.append({"op": "insert", "text": " ".join(q[k:m])})
    return out


def _rows(x: str, y: str):
    """After each character of x, an integer whose zero bits are where the longest common subsequence with y grows."""
    full = (1 << len(y)) - 1
    masks: dict[str, int] = {}
    for k, c in enumerate(y):
        masks[c] = masks.get(c, 0) | 1 << k
    v = full
    for c in x:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(x: str, y: str) -> np.ndarray:
    """Length of the longest common subsequence of x with each prefix of y."""
    v = (1 << len(y)) - 1
    for v in _rows(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def edits(x: str, y: str) -> list[tuple[str, str]]:
    """(op, text) with the most equal characters there can be; runs of one op may follow each other."""
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    if k:
        return [("equal", x[:k]), *edits(x[k:], y[k:])]
    while k < min(len(x), len(y)) and x[-1 - k] == y[-1 - k]:
        k += 1
    if k:
        return [*edits(x[:-k], y[:-k]), ("equal", x[-k:])]
    if not x or not y:
        return [("delete", x)] * bool(x) + [("insert", y)] * bool(y)
    if len(x) > 1 and len(x) * len(y) > BITS:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        return [*edits(x[:half], y[:cut]), *edits(x[half:], y[cut:])]
    rows = list(_rows(x, y))
    out, i, j = [], len(x), len(y)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1  # this character of y adds nothing
            out.append(("insert", y[j]))
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
            out.append(("delete", x[i]))
        else:
            i, j = i - 1, j - 1
            out.append(("equal", x[i]))
    out += [("delete", c) for c in reversed(x[:i])] + [("insert", c) for c in reversed(y[:j])]
    return out[::-1]


def joined(parts: list[tuple[str, str]]) -> list[list[str]]:
    """Pieces with neighbours of one op put together: between two equal ones at most a delete and then an insert."""
    out: list[list[str]] = []
    gone = new = ""
    for op, text in [*parts, ("equal", "")]:
        if op == "delete":
            gone += text
        elif op == "insert":
            new += text
        else:
            if gone:
                out.append(["delete", gone])
            if new:
                out.append(["insert", new])
            if text and out and out[-1][0] == "equal":
                out[-1][1] += text
            elif text:
                out.append(["equal", text])
            gone = new = ""
    return out


def cleaned(parts: list[list[str]]) -> list[list[str]]:
    """Pieces without equal ones that are no longer than the edits on either side; those count as deleted and inserted."""
    kept: list[list] = [[0, 0, ""]]  # deleted and inserted before an equal piece, and it
    texts: list[list[str]] = [["", "", ""]]
    for op, text in [*parts, ["equal", ""]]:
        if op != "equal":
            k = int(op == "insert")
            kept[-1][k] += len(text)
            texts[-1][k] += text
            while len(kept) > 1 and (same := texts[-2][2]) and len(same) <= max(kept[-2][:2]) and len(same) <= max(kept[-1][:2]):
                d, i, _ = texts.pop()
                kept.pop()
                texts[-1] = [texts[-1][0] + same + d, texts[-1][1] + same + i, ""]
                kept[-1] = [len(texts[-1][0]), len(texts[-1][1]), ""]
        else:
            texts[-1][2] = text
            texts.append(["", "", ""])
            kept.append([0, 0, ""])
    return joined([x for d, i, same in texts for x in (("delete", d), ("insert", i), ("equal", same)) if x[1]])


def character_parts(a: str | None, b: str | None) -> list[dict]:
    """The pieces of two passages by character, white space squeezed: equal and delete make up a, equal and insert b."""
    x, y = " ".join((a or "").split()), " ".join((b or "").split())
    return [{"op": op, "text": text} for op, text in cleaned(joined(edits(x, y)))]


def diff():
    @F.pandas_udf("array<struct<op:string,text:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([character_parts(x, y) for x, y in zip(a, b)])

    return run


VOWELS = set("aeiou")


def _consonants(word: str) -> list[bool]:
    """Whether each letter is a consonant: y is one at the beginning and after a vowel."""
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in VOWELS and not (c == "y" and i and out[-1]))
    return out


def _measure(stem: str) -> int:
    """How often a run of vowels is followed by one of consonants."""
    kinds = _consonants(stem)
    return sum(not a and b for a, b in zip(kinds, kinds[1:]))


def _has_vowel(stem: str) -> bool:
    return not all(_consonants(stem))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1]


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return len(word) > 2 and _consonants(word)[-3:] == [True, False, True] and word[-1] not in "wxy"


STEP_2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """The stem of a lower-case English word by Porter's algorithm of 1980, with the rule order of its paper."""
    if len(word) < 3:
        return word

    def swap(rules: dict[str, str], least: int) -> str:
        for end in sorted(rules, key=len, reverse=True):
            if word.endswith(end):
                stem = word[: len(word) - len(end)]
                return stem + rules[end] if _measure(stem) > least else word
        return word

    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                if _has_vowel(word[: -len(end)]):
                    word = word[: -len(end)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _double(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short_end(word):
                        word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = swap(dict(zip(STEP_2[::2], STEP_2[1::2])), 0)
    word = swap(STEP_3, 0)
    for end in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short_end(stem):
            word = stem
    return word[:-1] if _measure(word) > 1 and _double(word) and word.endswith("l") else word


def stems(words, column: str = "word"):
    """(column, stem) of each distinct word of a table: the stemmer sees a word once, however often it occurs."""
    from pyspark.sql import functions as F

    def of(batch):
        return batch.map(porter)

    return words.select(column).distinct().withColumn("stem", F.pandas_udf(of, "string")(column))
