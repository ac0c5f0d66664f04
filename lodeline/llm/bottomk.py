"""Near-duplicates by bottom-k sketches from one hash function.

A text's set is that of its distinct four-word shingles; two texts are linked if
their sets have a Jaccard similarity of 0.8 or more. A set's sketch is its K
smallest hashes, or the whole set if it has no more.

* Inverted lists. Sketches of linked sets share at least ``needed`` values: all of
  the intersection if the sets are small, and otherwise fewer than NEED of the K
  smallest values of the union would have to lie in it, which happens to one pair
  in 10^9. So in an order of all values, the rarest first, both have one of their
  first s - needed + 1 values in common, s being the sketch's size. Values that
  one set alone has come first and need no list.
* Leaders. In each list the set whose values are the commonest is likely what the
  others were made from. Each set is compared with the leader of most of its lists.
* The rest. Lists that still hold different components are gone through pair by
  pair: not the pairs of one component, nor those that met in a list before. Long
  lists are dealt in blocks over tasks, the largest component apart.
* A pair counts only if the sketch of the union (the K smallest of both) leaves it
  possible, and is a link only if the whole sets agree, by exact counts.

Tasks return links that join two of their trees, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodeline.llm.arrow import Scratch, bound_batches, by_text, materialise
from lodeline.llm.components import smallest_reachable
from lodeline.llm.kernels import LOWER, SPACE, Block, combine, hash_runs

#: Words of a shingle, and the least similarity as a fraction.
WORDS, OVER, UNDER = 4, 4, 5
#: Values of a sketch, and how many of a union's K smallest values linked sets share (a binomial variable of K and 0.8 is less once in 10^9).
K, NEED = 64, 30
#: Sets of one list, or of each side of a part of one, that meet in a task; and shingles that meet with a leader there.
ROWS, WEIGHT = 1500, 1 << 20
#: Columns of an incidence matrix at a time.
COLUMNS = 4096
#: Sets that a task remembers in order not to repeat their sketches.
SEEN = 200_000


def sets_of(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a text of fewer words is one shingle, one without words has none."""
    block = Block(texts)
    starts, ends = block.runs(~SPACE)
    hashes = hash_runs(LOWER[block.data], starts, ends)
    held = np.concatenate(([0], np.cumsum(np.bincount(block.owner(starts), minlength=len(texts))))) if len(texts) else [0]
    grams = combine([hashes[i : len(hashes) - WORDS + 1 + i] for i in range(WORDS)]).view(np.int64) if len(hashes) >= WORDS else hashes.view(np.int64)
    out = []
    for low, high in zip(held[:-1], held[1:], strict=True):
        if high - low >= WORDS:
            out.append(np.unique(grams[low : high - WORDS + 1]))
        elif high > low:
            # the number of words tells a short text from the start of a longer one
            out.append(combine([np.uint64(high - low) + np.zeros(1, np.uint64), *(hashes[i : i + 1] for i in range(low, high))]).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def set_id(held: np.ndarray) -> int:
    """A number for a set."""
    if not len(held):
        return 0
    at = np.arange(1, len(held) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = combine([held.view(np.uint64), at])
        return int(combine([mixed.sum(keepdims=True), at[-1:]]).view(np.int64)[0])


def near_size(n, other_n):
    """Whether sets of these sizes can be linked; for columns and arrays."""
    return (other_n * UNDER >= n * OVER) & (n * UNDER >= other_n * OVER)


def linked(both, n, other_n):
    """Whether sets of these sizes with so many shingles in common are linked."""
    return both * UNDER >= (n + other_n - both) * OVER


def needed(n: Column) -> Column:
    """The values that a sketch of a set of size n shares with that of any linked set."""
    return F.when(n * UNDER < K * OVER, F.ceil(n * OVER / UNDER)).otherwise(NEED).cast("int")


def overlaps(lists: list[np.ndarray]) -> np.ndarray:
    """How many values each two of some lists of distinct values have in common, as a square matrix."""
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values, column, often = np.unique(np.concatenate(lists) if lists else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    shared = often > 1
    number = np.cumsum(shared) - 1
    ok = shared[column]
    rows, column, width = rows[ok], number[column[ok]], int(shared.sum())
    out = np.zeros((len(lists), len(lists)), np.float32)
    for at in range(0, width, COLUMNS):
        some = (column >= at) & (column < at + COLUMNS)
        held = np.zeros((len(lists), min(COLUMNS, width - at)), np.float32)
        held[rows[some], column[some] - at] = 1
        out += held @ held.T
    return out.astype(np.int64)


def possible(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sketches leave it possible that their sets are linked, by the sketch of the union."""
    union = np.union1d(a, b)[:K]
    both = np.count_nonzero(np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True))
    return both >= NEED if len(union) == K else both * UNDER >= len(union) * OVER


class Trees:
    """Union-find over numbers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        """Join two trees; False if they are one already."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _pairs(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []
    make = lambda: pa.RecordBatch.from_arrays([pa.array([p[k] for p in held], pa.int64()) for k in (0, 1)], ["a", "b"])
    for pair in found:
        held.append(pair)
        if len(held) == 10_000:
            yield make()
            held = []
    if held:
        yield make()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one part after the other; the first column has the part, and rows are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(0).to_numpy(zero_copy_only=False)
        if held and held[0].column(0)[0].as_py() != part[0]:
            yield pa.concat_batches(held)
            held = []
        edges = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if low:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.concat_batches(held)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The elements of each list of an array."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[low:high] for low, high in zip(at[:-1], at[1:], strict=True)]


def _led(batches):
    """Links between each part's leader, its first row, and the others; rows are (part, follows, set, t)."""

    def found():
        for part in _parts(batches):
            nodes, texts, lead, n = part.column(2).to_pylist(), part.column(3), None, 0
            for at in range(0, len(nodes), 64):
                for node, held in zip(nodes[at : at + 64], sets_of(texts.slice(at, 64).to_pylist()), strict=True):
                    if lead is None:
                        lead, n, first = held, len(held), node
                    elif node != first and linked(np.count_nonzero(lead[np.minimum(np.searchsorted(lead, held), n - 1)] == held), n, len(held)):
                        yield node, first

    yield from _pairs(found())


#: A row of a part of a list: which side and group it is of, its set, the set's size, the keys before this one, and the sketch.
ROW_TYPES = "part bigint, side int, comp bigint, set bigint, n int, before array<bigint>, sketch array<bigint>"
HOPEFUL_TYPES = "part bigint, comp bigint, set bigint, n int"


def _hopeful(batches):
    """The rows of each part with a partner of another component, on the other side if there are two, that met in no list before and may be linked."""
    for part in _parts(batches):
        if part.num_rows < 2:
            continue
        side, comp, n = (_numbers(part.column(i)).astype(np.int64) for i in (1, 2, 4))
        met = (comp[:, None] != comp[None, :]) & near_size(n[:, None], n[None, :])
        if side.min() != side.max():
            met &= side[:, None] != side[None, :]
        if not met.any():
            continue
        sketches = _lists(part.column(6))
        least = np.where(n * UNDER < K * OVER, -(-n * OVER // UNDER), NEED)
        met &= overlaps(sketches) >= np.maximum(least[:, None], least[None, :])
        if met.any():
            met &= overlaps(_lists(part.column(5))) == 0
        stay = np.zeros(len(n), bool)
        for i in np.flatnonzero(met.any(axis=1)):
            # of a row's partners only those are looked at that tell something new
            for j in np.flatnonzero(met[i]):
                if (not stay[i] or not stay[j]) and possible(sketches[i], sketches[j]):
                    stay[i] = stay[j] = True
        if stay.any():
            yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(stay)) for i in (0, 2, 3, 4)], ["part", "comp", "set", "n"])


def _compared(batches):
    """Links between rows (part, comp, set, n, t) of different components of each part, by the whole sets."""

    def found():
        trees = Trees()
        for part in _parts(batches):
            comp, nodes = part.column(1).to_pylist(), part.column(2).to_pylist()
            held = [x for at in range(0, len(nodes), 64) for x in sets_of(part.column(4).slice(at, 64).to_pylist())]
            n = np.array([len(x) for x in held])
            ok = np.triu(linked(overlaps(held), n[:, None], n[None, :]), 1)
            for i, j in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
                if trees.join(comp[i], comp[j]):
                    yield nodes[i], nodes[j]

    yield from _pairs(found())


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (key, comp, set, ...) of lists with several components, as (part, side, comp, set, key) in which all sets of different components meet.

    A list's largest component meets the others only, not itself; either is dealt in blocks of ROWS.
    """
    crowds = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    mixed = crowds.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max_by("comp", F.struct("m", "comp")).alias("big"), F.sum("m").alias("all"), F.max("m").alias("most")).where("c > 1")
    few, many = F.ceil((F.col("all") - F.col("most")) / ROWS).cast("int"), F.ceil(F.col("most") / ROWS).cast("int")
    joined = rows.join(mixed, "key").withColumn("few", few).withColumn("many", many).withColumn("large", F.col("comp") == F.col("big"))
    joined = joined.withColumn("own", F.pmod(F.xxhash64("set"), F.when(F.col("large"), F.col("many")).otherwise(F.col("few"))).cast("int"))
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    own, zero, one = F.col("own"), F.lit(0), F.lit(1)
    among = F.transform(F.sequence(zero, F.col("few") - 1), lambda x: place(0, F.least(own, x), F.greatest(own, x), F.when(own > x, 1).otherwise(0)))
    to_large = F.transform(F.sequence(zero, F.col("many") - 1), lambda x: place(1, own, x, zero))
    to_small = F.transform(F.sequence(zero, F.col("few") - 1), lambda x: place(1, x, own, one))
    parts = F.when((F.col("few") == 1) & (F.col("many") == 1), F.array(place(0, zero, zero, zero))).when(F.col("large"), to_small).otherwise(F.concat(among, to_large))
    return joined.select("key", "comp", "set", F.explode(parts).alias("p")).select(F.xxhash64("key", "p.kind", "p.i", "p.j").alias("part"), F.col("p.side").alias("side"), "comp", "set", "key")


def _texts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(set, t) for rows (set, node): the text whose number is ``node``, as UTF-8, once each."""
    numbered = docs.select(F.xxhash64(F.col(text_col)).alias("node"), F.col(text_col).alias("t"))
    return numbered.join(wanted, "node").groupBy("set").agg(F.first("t").cast("binary").alias("t"))


def _led_links(docs: DataFrame, text_col: str, sets: DataFrame, index: DataFrame) -> DataFrame:
    """(a, b): links between sets and the leaders of most of their lists."""
    lists = index.select("set", "n", "score", F.explode("keys").alias("key"))
    leads = lists.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("score", "set", "n")).alias("lead")).where("m > 1").select("key", "lead")
    met = lists.join(leads, "key").where((F.col("set") != F.col("lead.set")) & near_size(F.col("n"), F.col("lead.n")))
    best = met.groupBy("set", F.col("lead.set").alias("lead")).agg(F.count(F.lit(1)).alias("m")).groupBy("set").agg(F.max(F.struct("m", "lead")).alias("best")).select("set", F.col("best.lead").alias("lead"))
    own, other = sets.select("set", "n", "node", F.col("sketch").alias("x")), sets.select(F.col("set").alias("lead"), F.col("sketch").alias("y"))
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, K)
    both, size = F.size(F.array_intersect(F.array_intersect(union, F.col("x")), F.col("y"))), F.size(union)
    hopeful = best.join(own, "set").join(other, "lead").where(F.when(size == K, both >= NEED).otherwise(both * UNDER >= size * OVER)).select("set", "lead", "n", "node")
    blocks = hopeful.groupBy("lead").agg(F.ceil(F.sum("n") / WEIGHT).cast("int").alias("blocks"))
    follow = hopeful.join(blocks, "lead").select("lead", "set", F.pmod(F.xxhash64("set"), "blocks").cast("int").alias("block"), F.lit(1).alias("follows"))
    first = blocks.select("lead", F.col("lead").alias("set"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("follows"))
    rows = follow.unionByName(first)
    told = _texts(docs, text_col, rows.select("set").distinct().join(sets.select("set", "node"), "set"))
    dealt = rows.join(told, "set").select(F.xxhash64("lead", "block").alias("part"), "follows", "set", "t").repartition("part").sortWithinPartitions("part", "follows")
    return dealt.mapInArrow(_led, "a bigint, b bigint")


def _late_links(docs: DataFrame, text_col: str, sets: DataFrame, index: DataFrame, grouped: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links between sets of different components, from the lists that hold several."""
    lists = index.select("set", F.explode("keys").alias("key"))
    comp = grouped.select(F.col("a").alias("set"), F.col("b").alias("root"))
    dealt = _dealt(lists.join(comp, "set", "left").withColumn("comp", F.coalesce("root", "set")).drop("root"))
    before = F.slice("keys", F.lit(1), F.array_position("keys", F.col("key")).cast("int") - 1)
    whole = dealt.join(index.select("set", "n", "keys"), "set").join(sets.select("set", "sketch"), "set").select("part", "side", "comp", "set", "n", before.alias("before"), "sketch")
    hopeful = scratch.keep(whole.repartition("part").sortWithinPartitions("part").mapInArrow(_hopeful, HOPEFUL_TYPES))
    told = _texts(docs, text_col, hopeful.select("set").distinct().join(sets.select("set", "node"), "set"))
    met = hopeful.join(told, "set").select("part", "comp", "set", "n", "t").repartition("part").sortWithinPartitions("part", "set")
    return met.mapInArrow(_compared, "a bigint, b bigint")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept): each row's set size, the smallest id that links lead to, and whether it is its own.

    Shingles are of words in lower case (A-Z alone); texts of fewer than WORDS
    words are one shingle. Texts without words, null ones included, have no
    shingle and are linked with nothing: each is its own component. Rows that
    repeat an id or a text each get a row, and equal texts are linked. A null id
    never names a component that has another id; a row without an id is kept only
    if its component has none. An empty table gives an empty result; other
    columns aren't read. Sets and texts are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    seen: set[int] = set()

    def run(columns: list[pa.Array], texts: list[bytes | None]) -> list[pa.Array]:
        held = sets_of(texts)
        numbers, sketches = [set_id(h) for h in held], []
        for number, h in zip(numbers, held, strict=True):
            # one sketch a task will do for equal sets
            sketches.append(None if number in seen or not len(h) else h[:K].tolist())
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(number)
        return [*columns, pa.array(numbers, pa.int64()), pa.array([len(h) for h in held], pa.int32()), pa.array(sketches, pa.list_(pa.int64()))]

    bound_batches(spark)
    with Scratch(spark) as scratch:
        named = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("node"), F.col(text_col).alias("t"))
        drawn = scratch.keep(by_text(named, ["id", "node"], "t", f"id {kind}, node bigint, set bigint, n int, sketch array<bigint>", run))
        sets = scratch.keep(drawn.where("sketch IS NOT NULL").groupBy("set").agg(F.min("node").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
        values = sets.select("set", "n", F.explode("sketch").alias("v"))
        counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        shared = values.join(counts, "v").groupBy("set", "n").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("held"), F.sum(F.log2("c")).alias("score"))
        long = F.size("held") - needed(F.col("n")) + 1
        index = scratch.keep(shared.where(long > 0).select("set", "n", "score", F.slice(F.transform("held", lambda x: x["v"]), F.lit(1), long).alias("keys")))
        early = scratch.keep(_led_links(docs, text_col, sets, index))
        late = _late_links(docs, text_col, sets, index, smallest_reachable(early), scratch)
        joined = smallest_reachable(early.unionByName(late))
        member = drawn.where("n > 0").groupBy("set").agg(F.min("id").alias("low")).join(joined.select(F.col("a").alias("set"), F.col("b").alias("root")), "set", "left").withColumn("root", F.coalesce("root", "set"))
        member = scratch.keep(member)
        least = member.groupBy("root").agg(F.min("low").alias("least"))
        of_set = member.join(least, "root").select("set", "least")
        alone = drawn.where("n = 0").select("id", "n", F.col("id").alias("least"))
        found = drawn.where("n > 0").join(of_set, "set").select("id", "n", "least").unionByName(alone)
        result = found.select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.col("least").alias("component_id"), F.col("id").eqNullSafe(F.col("least")).alias("kept"))
        return materialise(result)
