"""Byte-level BPE by backtracking, and decoding by an offset table.

A piece is encoded without running its merges: an Aho-Corasick automaton gives the longest token at each byte; a token
may follow the last one only if no merge would cross the seam between them, which a table of pair compatibility
remembers; where neither a token nor any shorter one fits, the last token is taken back. The first sequence found is the
one that the merges give. Tokens' bytes lie in one string, and a table of offsets says where each begins.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: How byte-level pre-tokenisation splits a text.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A worker forgets encoded pieces beyond so many.
PIECES = 400_000


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, to that byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {bytes(chars[c] for c in t): i for t, i in vocab.items()}
        # bytes rank below all merges; a merged token ranks as its merge does
        of = {t: self.ids[bytes(chars[c] for c in t)] for t in vocab}
        self.rank, self.split, self.merge = {}, {}, {}
        for i, token in ((i, t) for t, i in self.ids.items()):
            if len(token) == 1:
                self.rank[i], self.split[i] = -1, (i, i)
        for r, (a, b) in enumerate(merges):
            left, right, whole = of[a], of[b], of[a + b]
            self.merge[left, right] = r
            self.rank[whole], self.split[whole] = r, (left, right)
        self.fits: dict[tuple[int, int], bool] = {}
        # a token that its own bytes don't merge to never occurs
        self.automaton = ahocorasick.Automaton()
        live = {}
        self.length = {}
        for token, i in self.ids.items():
            self.length[i] = len(token)
            if i in self.rank and (len(token) == 1 or self._reached(token, i)):
                live[token] = i
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.shorter = {}
        for token, i in live.items():
            self.shorter[i] = next((live[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in live), None)
        size = max([*self.ids.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in self.ids.items():
            pieces[i] = token
        for text, i in self.special.items():
            pieces[i] = text.encode()
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.spaced: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _reached(self, token: bytes, i: int) -> bool:
        left, right = self.split[i]
        parts = [self.ids[bytes([b])] for b in token]
        while len(parts) > 1:
            r, k = min(((self.merge.get(p, 1 << 40), k) for k, p in enumerate(zip(parts, parts[1:]))))
            if r == 1 << 40:
                return False
            a, b = parts[k], parts[k + 1]
            parts[k : k + 2] = [self.ids[self._text(a) + self._text(b)]]
        return parts == [i]

    def _text(self, i: int) -> bytes:
        if not hasattr(self, "_texts"):
            self._texts = {i: t for t, i in self.ids.items()}
        return self._texts[i]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart: no merge across their seam comes before the merges that made them."""
        found = self.fits.get((left, right))
        if found is None:
            found = self.fits[left, right] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the merges of both sides from the last to the first; at each moment the tokens that meet at the seam must
        # not have a merge that would have come before the merge undone next.
        rank, split, merge = self.rank, self.split, self.merge
        bound = 1 << 40
        while True:
            if merge.get((left, right), 1 << 40) < bound:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                # a merge of equal rank further left is done first
                bound, left = min(bound, a), split[left][1]
            else:
                bound, right = min(bound, b + 1), split[right][0]

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ids.get(data)
        if whole is not None and whole in self.shorter:
            return whole.to_bytes(4, "little")
        n = len(data)
        longest = [-1] * n
        reach = [0] * n
        for end, (i, size) in self.automaton.iter(data.decode("latin-1")):
            start = end + 1 - size
            if size > reach[start]:
                reach[start], longest[start] = size, i
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        length, shorter = self.length, self.shorter
        while at < n:
            last = out[-1] if out else -1
            while token is not None:
                end = at + length[token]
                if not dead[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                # the same token ends at a dead place now, so a shorter one is tried
        return np.array(out, "<u4").tobytes()

    def _split(self, text: str) -> bytes:
        known, out = self.pieces, []
        for piece in SPLIT.findall(text):
            got = known.get(piece)
            if got is None:
                if len(known) > PIECES:
                    known.clear()
                got = known[piece] = self.encode_piece(piece)
            out.append(got)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        """A text without special tokens. A single space between two other characters always begins a piece."""
        if not text:
            return b""
        words = text.split(" ")
        for bad in ("  ", " \n", "\n ", "\t", "\r"):
            if bad in text:
                return self._split(text)
        if not words[0] or not words[-1] or not text.isascii() and any(c.isspace() and c not in " \n" for c in set(text)) or any(c in text for c in "\x0b\x0c\x1c\x1d\x1e\x1f"):
            return self._split(text)
        known = self.spaced
        out = [self._split(words[0])]
        for word in words[1:]:
            got = known.get(word)
            if got is None:
                if len(known) > PIECES:
                    known.clear()
                got = known[word] = self._split(" " + word)
            out.append(got)
        return b"".join(out)

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; strings of special tokens become those tokens."""
        if self.cuts is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.cuts.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if k % 2 else self._plain(p) for k, p in enumerate(parts))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, gathered by the offset table."""
        ids = ids.astype(np.int64)
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        at = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        return self.bytes[at].tobytes()

    def decode(self, ids) -> str:
        """Text of ids; bytes that aren't UTF-8 become replacement characters."""
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text); null counts as empty."""

    def make():
        tool = codec(path)

        def each(batch):
            n, a, b = [], [], []
            for text in batch.column("text").to_pylist():
                data = tool.encode_bytes(text or "")
                n.append(len(data) // 4)
                a.append(hashlib.sha256(data).hexdigest())
                b.append(hashlib.sha256(tool.decode(np.frombuffer(data, "<u4")).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    return common.scan(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 256)
