"""Runs of words that repeat with a period, found by a suffix automaton.

A run is a stretch of words with smallest period q, at least ``times`` periods
and ``least`` words long, that can't be extended on either side.

The automaton's states stand for classes of word sequences, and a state's end
positions are those of the states that link to it, merged the smaller into the
larger set. Where two end positions x < y become neighbours in a state, the
longest sequence of that state, n words long, ends at both: at a distance of at
most n that is a square of period y - x, which is extended to its run. No end
position lies between them, so the period is the smallest; and the last two
periods of a run of k words are such neighbours in a state of k - q words, so no
run is missed, nor is one of ``times`` periods if only distances up to
n / (times - 1) are looked at.

An automaton is only built for stretches that can hold a run. Any four words of a
run of six words and four periods occur in it twice, so words that aren't in
such fours within their stretch split it, until nothing changes. That is exact,
and plain prose falls apart at once.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodeline.functions.text import let
from lodeline.llm.arrow import by_text
from lodeline.llm.kernels import SPACE, Block, combine, hash_runs

#: A run has so many periods and words at least.
TIMES, LEAST = 4, 6
#: Words of a gram that a run holds twice, whatever its period.
GRAM = 4
#: End positions in one list; longer sets are lists of lists.
PART = 2048


class Ends:
    """An ordered set of end positions; inserting moves at most PART of them."""

    __slots__ = ("last", "parts", "size")

    def __init__(self, x: int):
        self.parts, self.last, self.size = [[x]], [x], 1

    def add(self, x: int) -> None:
        i = min(bisect_left(self.last, x), len(self.parts) - 1)
        part = self.parts[i]
        insort(part, x)
        self.size += 1
        if len(part) > PART:
            self.parts[i : i + 1] = [part[: PART // 2], part[PART // 2 :]]
            self.last.insert(i, part[PART // 2 - 1])
            i += 1
            part = self.parts[i]
        self.last[i] = part[-1]

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The neighbours of a member."""
        i = bisect_left(self.last, x)
        part = self.parts[i]
        k = bisect_left(part, x)
        before = part[k - 1] if k else self.parts[i - 1][-1] if i else None
        after = part[k + 1] if k + 1 < len(part) else self.parts[i + 1][0] if i + 1 < len(self.parts) else None
        return before, after


def automaton(s: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and own end position (-1 for clones and the start, which is state 0) of each state."""
    length, link, own, follow = [0], [-1], [-1], [{}]
    last = 0
    for at, c in enumerate(s):
        now = len(length)
        length.append(length[last] + 1)
        link.append(0)
        own.append(at)
        follow.append({})
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                own.append(-1)
                follow.append(follow[q].copy())
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return length, link, own


def seeds(s: list[int], times: int):
    """(x, y, n): neighbouring end positions of a sequence of n words whose distance is at most n / (times - 1)."""
    length, link, own = automaton(s)
    ends: list[Ends | None] = [Ends(x) if x >= 0 else None for x in own]
    fresh: list[list[int]] = [[] for _ in own]
    for v in np.argsort(-np.array(length), kind="stable").tolist()[:-1]:
        held, n = ends[v], length[v]
        for x in fresh[v]:
            before, after = held.around(x)
            if before is not None and (x - before) * (times - 1) <= n:
                yield before, x, n
            if after is not None and (after - x) * (times - 1) <= n:
                yield x, after, n
        up = link[v]
        if up:
            other = ends[up]
            if other is None:
                ends[up] = held
            else:
                small, large = (held, other) if held.size <= other.size else (other, held)
                joined = [x for part in small.parts for x in part]
                for x in joined:
                    large.add(x)
                # a pair of the larger set that stays a pair was looked at where it became one
                fresh[up] = joined if small is other else fresh[up] + joined
                ends[up] = large
        ends[v], fresh[v] = None, ()


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first elements agree."""
    at, step = 0, 16
    while at < len(a):
        differ = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return len(a)


def runs_of(words: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers, by start and period."""
    found: dict[int, list[tuple[int, int]]] = {}
    for x, y, n in seeds(words.tolist(), times):
        d = y - x
        held = found.setdefault(d, [])
        if any(start <= x - n + 1 and y < end for start, end in held):
            continue
        end = y + 1 + _agreeing(words[y + 1 :], words[y + 1 - d : len(words) - d])
        first = x - n + 1
        first -= _agreeing(words[:first][::-1], words[d : first + d][::-1])
        # what was seen of this run from shorter sequences lies within it
        held[:] = [r for r in held if not (first <= r[0] and r[1] <= end)] + [(first, end)]
    return sorted((start, end - start, d) for d, held in found.items() for start, end in held if end - start >= max(least, times * d))


def stretches(hashes: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """(first word, word after the last) of the stretches that can hold a run, for hashes of words and the texts they are in, in order."""
    if len(hashes) < LEAST:
        return []
    gram = combine([hashes[i : len(hashes) - GRAM + 1 + i] for i in range(GRAM)])
    at = np.flatnonzero(owner[: len(gram)] == owner[GRAM - 1 :])
    part = owner[at].astype(np.uint64)
    while len(at):
        key = combine([gram[at], part])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        fresh_at, fresh_part = at[twice], part[twice]
        begins = np.concatenate(([True], (np.diff(fresh_at) > 1) | (fresh_part[1:] != fresh_part[:-1]))) if len(fresh_at) else np.zeros(0, bool)
        number = np.cumsum(begins)
        long = np.bincount(number)[number] > LEAST - GRAM if len(number) else begins
        if long.all() and len(fresh_at) == len(at):
            break
        at, part = fresh_at[long], number[long].astype(np.uint64)
    if not len(at):
        return []
    begins = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    lasts = np.append(begins[1:], len(at)) - 1
    return list(zip(at[begins].tolist(), (at[lasts] + GRAM).tolist(), strict=True))


def _numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal ones alike."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def runs_of_texts(texts: list[bytes | None]) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """The words and the runs of each text."""
    block = Block(texts)
    starts, ends = block.runs(~SPACE)
    words = [(t or b"").split() for t in texts]
    owner = block.owner(starts)
    first = np.searchsorted(owner, np.arange(len(texts)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for low, high in stretches(hash_runs(block.data, starts, ends), owner):
        text = int(owner[low])
        base = int(first[text])
        found[text] += [(low - base + s, n, q) for s, n, q in runs_of(_numbered(words[text][low - base : high - base]))]
    return words, [sorted(r, key=lambda x: (x[0], x[2])) for r in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, runs, collapsed): all runs of each whole text, and the text with one period of each.

    ``runs`` is an array of (start, length, period) in words, by start, then
    period; runs of other periods may overlap, and then a word goes if any run
    drops it. Words are separated by white space and compared as they are. Null,
    empty and blank texts have no word, no run and an empty ``collapsed``; each
    row has its own result, repeated ids included; an empty table gives an empty
    result, and other columns aren't read. A long text is treated in one task, in
    memory in proportion to its length.
    """

    def run(columns: list[pa.Array], texts: list[bytes | None]) -> list[pa.Array]:
        words, found = runs_of_texts(texts)
        row = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        flat = [r for rs in found for r in rs]
        each = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], fields=list(row))
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
        short = [collapsed(w, r).decode() for w, r in zip(words, found, strict=True)]
        return [columns[0], pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), each), pa.array(short, pa.string())]

    kind = docs.schema[id_col].dataType.simpleString()
    return by_text(docs, [id_col], text_col, f"{id_col} {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string", run)


def repeated(text: Column, number: Column) -> Column:
    """The text, or for a number divisible by ten its words with a tail that repeats: from word a on, p words again and again up to the old number of words.

    With g = floor(number / 10) and n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null text or number leaves the text as it is.
    """
    g = F.floor(number / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n == 0, text).otherwise(F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n), " "))

    return F.when(number % 10 == 0, let(F.regexp_extract_all(text, F.lit(r"[^ \t-\r]+"), F.lit(0)), tail)).otherwise(text)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of find()'s rows: the longest run (ties: smallest start, then period) or nulls, and the digests of all runs and of the shortened text."""
    best = F.when(F.size("runs") > 0, F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(F.col(id_col), F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), hashed(lines).alias("runs_sha256"), hashed(F.col("collapsed")).alias("collapsed_sha256")).select(
        id_col,
        "n_runs",
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.p")).cast("bigint").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
