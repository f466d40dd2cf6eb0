"""Best-fit packing by bin completion.

Pieces of equal length are alike, so the whole problem is a table of lengths and counts, with at most as many rows as a
sequence has tokens however many documents there are. Over that table a depth-first search completes the sequence of the
largest piece left: its undominated fillings are enumerated in order of waste, a branch ends where the waste so far is
more than a better packing can have, and best fit is the first incumbent. Pieces then find their place by their number
within their length.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common

LENGTH = 2048
#: Fillings that the search looks at, dominated ones included, before the best packing found so far stands. Bin packing
#: is NP-hard, so some end is needed; it limits the search only, every piece is placed in any case.
NODES = 50_000
#: Pieces of one length are numbered in so many parts.
PARTS = 64
#: A worker forgets encoded words beyond so many.
WORDS = 500_000

#: Distinct lengths of a sequence's pieces, largest first, and how many of each.
Filling = list[tuple[int, int]]


def best_fit(room: int, lengths: list[int], left: dict[int, int]) -> Filling:
    """Greedy filling: again and again the longest piece that still fits, as often as it does. lengths ascend."""
    out: Filling = []
    k = bisect_right(lengths, room) - 1
    while k >= 0 and room > 0:
        size = lengths[k]
        if n := min(left[size], room // size):
            out.append((size, n))
            room -= n * size
        k = min(k, bisect_right(lengths, room)) - 1
    return out


def reachable(room: int, lengths: list[int], left: dict[int, int]) -> list[int]:
    """For each k a bit set of the sums up to room that pieces of the first k lengths can have."""
    out, sums, mask = [1], 1, (1 << room + 1) - 1
    for size in lengths:
        n, step = min(left[size], room // size), 1
        while n > 0:
            step = min(step, n)
            sums |= sums << step * size & mask
            n -= step
            step *= 2
        out.append(sums)
    return out


def dominated(filling: Filling, waste: int, lengths: list[int], left: dict[int, int]) -> bool:
    """Whether one piece that is left over could join the filling, or stand in for some of it: no shorter, and it still fits.

    The pieces that it replaces are then free for other sequences, where they fit wherever it did.
    """
    used = dict(filling)
    over = 0
    for size in lengths:
        if left[size] > used.get(size, 0):
            over |= 1 << size
    if over & (1 << waste + 1) - 1:
        return True
    one, more = 0, 0  # sums of exactly one piece, and of several
    for size, n in filling:
        for _ in range(n):
            grown = more | more << size | one << size
            if grown == more and one >> size & 1:
                break
            more, one = grown, one | 1 << size
    return any((more | one if w else more) << w & over for w in range(waste + 1))


def fillings(room: int, lengths: list[int], left: dict[int, int], most: int) -> Iterator[tuple[int, Filling | None]]:
    """(waste, filling) of every undominated filling of room that wastes at most ``most``, least waste first.

    Each step of the enumeration leads to a filling, for sums that can't be reached are known beforehand; a dominated
    one is given as None, so that the caller can count it.
    """
    reach = reachable(room, lengths, left)

    def exact(k: int, rest: int) -> Iterator[Filling]:
        """Fillings of exactly rest by the first k lengths. Lengths in a filling differ, so this is at most about 2 x sqrt(rest) deep."""
        if not rest:
            yield []
            return
        k = min(k, bisect_right(lengths, rest))
        while k and reach[k] >> rest & 1:
            size = lengths[k - 1]
            for n in range(min(left[size], rest // size), 0, -1):
                if reach[k - 1] >> rest - n * size & 1:
                    for tail in exact(k - 1, rest - n * size):
                        yield [(size, n), *tail]
            k -= 1

    for waste in range(min(most, room) + 1):
        if reach[-1] >> room - waste & 1:
            for filling in exact(len(lengths), room - waste):
                yield waste, None if dominated(filling, waste, lengths, left) else filling


def bound(counts: dict[int, int], length: int) -> int:
    """Sequences needed at least: that of all tokens, and for each alpha that of pieces which longer ones leave no room for."""
    number, tokens = np.zeros(length + 2, np.int64), np.zeros(length + 2, np.int64)
    for size, n in counts.items():
        number[size + 1], tokens[size + 1] = n, size * n
    number, tokens = np.cumsum(number), np.cumsum(tokens)  # of pieces shorter than the index
    half = length // 2 + 1
    best = -(-int(tokens[-1]) // length)
    for alpha in range(half):
        large = int(number[-1] - number[length - alpha + 1])
        middle, room = int(number[length - alpha + 1] - number[half]), int(tokens[length - alpha + 1] - tokens[half])
        small = int(tokens[half] - tokens[alpha])
        best = max(best, large + middle + max(0, -(-(small - (middle * length - room)) // length)))
    return best


def _use(left: dict[int, int], lengths: list[int], filling: Filling, times: int) -> None:
    for size, n in filling:
        left[size] -= n * times
        if not left[size]:
            del left[size], lengths[bisect_right(lengths, size) - 1]


def _undo(left: dict[int, int], lengths: list[int], filling: Filling, times: int) -> None:
    for size, n in filling:
        if size not in left:
            left[size] = 0
            lengths.insert(bisect_right(lengths, size), size)
        left[size] += n * times


def greedy(counts: dict[int, int], length: int) -> list[tuple[int, Filling]]:
    """Best fit around the largest piece left, each filling as often as the counts allow."""
    left = {s: n for s, n in counts.items() if s > 0 and n > 0}
    lengths, out = sorted(left), []
    while lengths:
        top = lengths[-1]
        _use(left, lengths, [(top, 1)], 1)
        filling = _with(top, best_fit(length - top, lengths, left))
        _undo(left, lengths, [(top, 1)], 1)
        times = min(left[s] // n for s, n in filling)
        out.append((times, filling))
        _use(left, lengths, filling, times)
    return out


def _with(top: int, rest: Filling) -> Filling:
    return [(top, rest[0][1] + 1), *rest[1:]] if rest and rest[0][0] == top else [(top, 1), *rest]


def plan(counts: dict[int, int], length: int = LENGTH, nodes: int = NODES) -> list[tuple[int, Filling]]:
    """(times, filling) so that every piece is placed. A length of zero takes no room and no place.

    Best fit is the first incumbent. The search goes depth first; at each step a filling is used as often as the counts
    allow or, as another branch, once. It ends with a packing that meets the bound, with every branch closed, or after
    so many nodes.
    """
    best = greedy(counts, length)
    most, tokens = sum(t for t, _ in best), sum(s * n for s, n in counts.items())
    least = bound(counts, length)
    left = {s: n for s, n in counts.items() if s > 0 and n > 0}
    lengths = sorted(left)
    path: list[tuple[int, int, Filling, int]] = []  # option, times, filling, waste of one
    wasted = used = 0

    def options() -> Iterator[tuple[int, Filling, int]]:
        """(times, filling, waste) for the largest piece left; None counts as a node without a branch."""
        top = lengths[-1]
        allowed = (most - 1) * length - tokens - wasted
        _use(left, lengths, [(top, 1)], 1)
        first = _with(top, best_fit(length - top, lengths, left))
        others = fillings(length - top, lengths.copy(), left.copy(), allowed)
        _undo(left, lengths, [(top, 1)], 1)
        waste = length - sum(s * n for s, n in first)

        def branches(waste: int, filling: Filling):
            times = min(left[s] // n for s, n in filling)
            times = min(times, allowed // waste) if waste else times
            if times:
                yield times, filling, waste
            if times > 1:
                yield 1, filling, waste

        if not waste:
            yield from branches(0, first)
        for waste, rest in others:
            if rest is None:
                yield 0, [], 0
            elif (filling := _with(top, rest)) != first or waste:
                yield from branches(waste, filling)

    skip = 0
    while most > least and nodes > 0:
        chosen = None
        if lengths:
            for option, (times, filling, waste) in enumerate(options()):
                nodes -= option >= skip
                if option >= skip and times:
                    chosen = option, times, filling, waste
                    break
                if nodes <= 0:
                    break
        elif used < most:
            best, most = [(times, filling) for _, times, filling, _ in path], used
        if chosen:
            path.append(chosen)
            _use(left, lengths, chosen[2], chosen[1])
            wasted, used, skip = wasted + chosen[1] * chosen[3], used + chosen[1], 0
        elif path:
            option, times, filling, waste = path.pop()
            _undo(left, lengths, filling, times)
            wasted, used, skip = wasted - times * waste, used - times, option + 1
        else:
            break
    return best


def places(made: list[tuple[int, Filling]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, numbers, first sequence, offset): pieces of a length, by number, to their places."""
    seen: dict[int, int] = {}
    out, sequence = [], 0
    for times, filling in made:
        offset = 0
        for size, n in filling:
            for _ in range(n):
                out.append((size, seen.get(size, 0), times, sequence, offset))
                seen[size] = seen.get(size, 0) + times
                offset += size
        sequence += times
    return out


class Tokens(dict):
    """Ids of whole texts by a vocabulary file of the tokenizers library, word by word: known words to their ids' bytes.

    The vocabulary drops white space, so a text is the words between ASCII blanks, each encoded on its own.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        self.parts: dict[str, bytes] = {}
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+").findall
        self.tokenize = self.tool.model.tokenize
        self.chars = {b: c for b, c in enumerate(self._byte_chars())}

    @staticmethod
    def _byte_chars() -> list[str]:
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        extra = iter(range(256, 512))
        return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]

    def _part(self, part: str) -> bytes:
        if (got := self.parts.get(part)) is None:
            if len(self.parts) > WORDS:
                self.parts.clear()
            shown = part if part.isascii() and part.isprintable() else "".join([self.chars[b] for b in part.encode()])
            got = self.parts[part] = array("I", [t.id for t in self.tokenize(shown)]).tobytes()
        return got

    def _word(self, word: str) -> bytes:
        if word.isascii():
            if "<|" not in word:
                low = word.lower()
                return self._part(low) if low.isalpha() else b"".join([self._part(p) for p in self.ascii(low)])
        elif "<|" not in word and ord(max(word)) < 256:
            # within Latin-1 normalisation is lower case alone, so parts can be stored one by one
            return b"".join([self._part(p) for p in self.split(word.lower())])
        return array("I", self.tool.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        got = self[word] = self._word(word) if word else b""
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self) > WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = 0) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text, row): ids of the text, then the id end, cut at length."""
    closing = end.to_bytes(4, "little")

    def run(batches):
        tools = Tokens(path)
        for batch in common.slices(batches, 256):
            out: list[list] = [[] for _ in range(6)]
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
                data = tools.encode(text or "") + closing
                for k, at in enumerate(range(0, len(data), 4 * length)):
                    part = data[at : at + 4 * length]
                    for column, value in zip(out, (doc, row, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = 0) -> DataFrame:
    """Pieces of docs (doc_id, text) with their places: sequence_id and offset, in as few sequences as the search finds.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts count as empty: one piece of the
    closing id. Texts longer than a sequence are cut at its length, all others stay whole. Repeated rows are packed
    each on its own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    made = common.stash(pieces(docs.withColumn("row", F.monotonically_increasing_id()), path, length, end), "pieces")
    made = made.withColumn("part", F.expr(f"int(pmod(xxhash64(row, piece), {PARTS}))"))
    # at most length x PARTS rows
    counts = made.groupBy("length", "part").agg(F.count("*").alias("n")).collect()
    totals: dict[int, int] = {}
    before = []
    for r in sorted(counts):
        before.append((r["length"], r["part"], totals.get(r["length"], 0)))
        totals[r["length"]] = totals.get(r["length"], 0) + r["n"]
    slots = places(plan(totals, length))
    by_length: dict[int, tuple[list, list, list]] = {}
    for size, first, _, sequence, offset in slots:
        firsts, sequences, offsets = by_length.setdefault(size, ([], [], []))
        firsts.append(first)
        sequences.append(sequence)
        offsets.append(offset)
    table = {size: tuple(np.array(c, np.int64) for c in columns) for size, columns in by_length.items()}

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(sizes: pa.Array, numbers: pa.Array) -> pa.Array:
        size, number = (np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (sizes, numbers))
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size):
            here = size == s
            first, start, at = table[int(s)]
            k = np.searchsorted(first, number[here], "right") - 1
            sequence[here], offset[here] = start[k] + number[here] - first[k], at[k]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    begins = F.broadcast(spark.createDataFrame(before, "length long, part int, begin long"))
    within = Window.partitionBy("length", "part").orderBy("row", "piece")
    numbered = made.withColumn("nth", F.row_number().over(within) - 1).join(begins, ["length", "part"])
    placed = numbered.withColumn("at", place("length", (F.col("nth") + F.col("begin")).cast("long")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
