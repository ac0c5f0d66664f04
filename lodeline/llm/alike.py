"""Near-copies by the exact similarity of their sets of five-word shingles, found through fingerprints first.

Two texts are linked if the Jaccard similarity of their sets is at least 0.8;
groups are the components. Links are verified on the whole sets and found in
three steps, each of which treats what the ones before it left apart:

1. Texts whose fingerprints share a Golay key (simhash.keys_of) are compared
   with the likeliest leader of the most and of the least crowded of these keys.
2. Shingles have one order for all texts, the commoner of a sample last. Two
   sets at the least similarity share one of the first shingles of both, a fifth
   of each set, whatever the order: these are a text's keys. Again a text is
   compared with a leader of the most and of the least crowded of them.
3. In every key that still holds more than one group, all pairs of texts of
   different groups are compared that size, place and a parity map don't rule
   out; none of these bounds can lose a link. A crowded key is dealt in blocks.

Steps 1 and 2 only spare work: step 3 meets every pair that they have left
apart. Comparisons are made where the texts of a block meet, and only links that
join two trees of a task are returned, so that no step returns more rows than it
reads, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeline.llm.arrow import Scratch, bound_batches, by_text, materialise
from lodeline.llm.bitmaps import bitmap, in_bitmap, modulo
from lodeline.llm.components import smallest_reachable

#: Words of a shingle, the seed of its hash, and the least similarity as a fraction.
WORDS, SEED, OVER, UNDER = 5, 42, 4, 5
#: Shingles and texts that meet in one task at a time: a text weighs its shingles and so many more.
BLOCK, EXTRA = 1 << 21, 500
#: Leaders that a text is compared with in steps 1 and 2; step 3 treats what further ones would have linked.
LEADERS = 32
#: Bits of the map that leaves most other texts out of a shuffle.
BITS = 1 << 25
#: For the order of the shingles: texts counted, how often a common shingle occurs there at least, and how many are told apart.
COUNTED, COMMON, MOST_COMMON = 10_000, 4, 200_000
#: Parts of step 3 with so many rows are treated together.
SMALL = 32
#: Texts that a task remembers in order not to repeat their keys, and tasks over which a common key is dealt.
SEEN, SALTS = 200_000, 256
#: The least and the most bits of a text's parity map; a shorter map only rules out less.
PARITY = 256, 8192


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.int64)
    parts = [b" ".join(found)] if len(found) < WORDS else map(b" ".join, zip(*[found[i:] for i in range(WORDS)], strict=False))
    digest = xxhash.xxh64_intdigest
    held = np.fromiter([digest(s, SEED) for s in parts], np.uint64).view(np.int64)
    held.sort()
    return held[np.concatenate(([True], held[1:] != held[:-1]))]


def fingerprint(held: np.ndarray) -> int:
    """The signed 64-bit fingerprint of a set: a bit is 1 if it is 1 in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(held), 8192):
        counts += np.unpackbits(held[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(held), bitorder="little").view(np.int64)[0])


def parity(held: np.ndarray) -> np.ndarray:
    """A bit for each number that shingles have modulo the bits: whether they are odd in count, as 64-bit words.

    There are about as many bits as shingles, a power of two within PARITY. Two
    maps of one length differ in at most as many bits as the sets have shingles
    that only one of them holds; a map's halves joined by XOR are the map of half the length.
    """
    bits = min(max(1 << int(np.ceil(np.log2(max(0.7 * len(held), 1)))), PARITY[0]), PARITY[1])
    odd = np.bincount((held.view(np.uint64) >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Maps (along the last axis) at a length that isn't greater."""
    while bits.shape[-1] > words:
        bits = bits[..., : bits.shape[-1] // 2] ^ bits[..., bits.shape[-1] // 2 :]
    return bits


def node_of(text: Column) -> Column:
    """A number for a text; texts without words have one."""
    return F.when(text.rlike(r"[^ \t\n\x0B\f\r]"), F.xxhash64(text)).otherwise(F.lit(0))


def level(held: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How often the sample has each shingle, 0 if it isn't common there."""
    known, counts = common
    if not len(known):
        return np.zeros(len(held), np.int64)
    at = np.minimum(np.searchsorted(known, held), len(known) - 1)
    return np.where(known[at] == held, counts[at], 0)


def keys(held: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set in the order by how common and by hash: any set at the least similarity has one of them among its own."""
    n = len(held)
    if not n:
        return held
    often = level(held, common)
    if often.any():
        held = held[np.argsort(often, kind="stable")]
    return held[: n - -(-OVER * n // UNDER) + 1]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the least similarity."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return not len(b)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[at] == a))
    return both * (OVER + UNDER) >= OVER * (len(a) + len(b))


def near_size(n, other_n):
    """Whether sets of these sizes can be alike; for columns and arrays."""
    return (other_n * UNDER >= n * OVER) & (n * UNDER >= other_n * OVER)


def possible(n, place, other_n, other_place):
    """Whether sets of these sizes whose first common shingle has these places can be alike."""
    return ((other_n - other_place) * (OVER + UNDER) >= OVER * (n + other_n)) & ((n - place) * (OVER + UNDER) >= OVER * (n + other_n))


def few_odd(n, other_n, differ):
    """Whether maps that differ in so many bits leave it possible that sets of these sizes are alike."""
    return differ * (OVER + UNDER) <= (n + other_n) * (UNDER - OVER)


class Maps:
    """The parity maps of a part's rows, by length; each map is also held at half its length, since alike sets may need it there."""

    def __init__(self, maps: list[bytes]):
        self.words = np.array([len(m) // 8 for m in maps])
        self.held = {}
        for words in np.unique(self.words).tolist():
            own, longer = np.flatnonzero(self.words == words), np.flatnonzero(self.words == 2 * words)
            place = np.full(len(maps), -1)
            place[own], place[longer] = np.arange(len(own)), len(own) + np.arange(len(longer))
            table = np.frombuffer(b"".join([maps[i] for i in own]), np.uint64).reshape(-1, words)
            if len(longer):
                more = np.frombuffer(b"".join([maps[i] for i in longer]), np.uint64).reshape(-1, 2 * words)
                table = np.concatenate((table, _folded(more, words)))
            self.held[words] = table, place

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The bits in which the maps of rows i and j differ, pair by pair; their lengths are equal or one is twice the other."""
        least, out = np.minimum(self.words[i], self.words[j]), np.zeros(len(i), np.int64)
        for words in np.unique(least).tolist():
            table, place = self.held[words]
            some = np.flatnonzero(least == words)
            for at in range(0, len(some), 1 << 16):
                own = some[at : at + (1 << 16)]
                out[own] = np.bitwise_count(table[place[i[own]]] ^ table[place[j[own]]]).sum(axis=1, dtype=np.int64)
        return out


class Trees:
    """Union-find over numbers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        held = self.up
        while (y := held.get(x, x)) != x:
            held[x] = held.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        """Join two trees; False if they are one already."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _common(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles of about COUNTED distinct texts, sorted, and their counts."""
    texts = docs.select(F.col(text_col).alias("t"))
    total = texts.agg(F.approx_count_distinct("t")).first()[0]
    picked = texts.where(F.pmod(F.xxhash64("t"), F.lit(max(total // COUNTED, 1))) == 0)

    def run(columns: list[pa.Array], texts: list[bytes | None]) -> list[pa.Array]:
        held = [shingles(t or b"") for t in texts]
        nodes = [np.full(len(h), i, np.int64) for h, i in zip(held, columns[0].to_pylist(), strict=True)]
        return [pa.array(np.concatenate(held)), pa.array(np.concatenate(nodes))]

    # copies of one text count once, or a copied text would make all its shingles common
    found = by_text(picked.withColumn("node", node_of(F.col("t"))), ["node"], "t", "s bigint, node bigint", run).distinct()
    counted = found.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    table = counted.orderBy(F.desc("n"), "s").limit(MOST_COMMON).toArrow()
    s, n = (table.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(s)
    return s[order], n[order]


def _pairs_out(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    make = lambda: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    for x, y in found:
        a.append(x)
        b.append(y)
        if len(a) == 10_000:
            yield make()
            a, b = [], []
    if a:
        yield make()


def _sketched(batches):
    """For each row (part, follows, node, n, map), sorted by part: the leader of its part whose map is nearest, as (g, node), if alike sets could have such maps.

    Rows without such a leader become leaders, up to LEADERS of them; none is held but these.
    """
    last, lead = None, []
    for batch in batches:
        out = []
        columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 4)]
        for part, node, n, raw in zip(*columns, strict=True):
            if part != last:
                last, lead = part, []
            bits, found = np.frombuffer(raw, np.uint64), None
            for other_node, other_n, other in lead:
                if other_node != node and near_size(n, other_n):
                    words = min(len(bits), len(other))
                    differ = int(np.bitwise_count(_folded(bits, words) ^ _folded(other, words)).sum())
                    if few_odd(n, other_n, differ) and (found is None or differ < found[0]):
                        found = differ, other_node
            if found:
                out.append((found[1], node))
            elif len(lead) < LEADERS:
                lead.append((node, n, bits))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["g", "node"])


def _led(batches):
    """Links (a, b) between the texts of each part and its leader, which comes first; rows (part, follows, node, t) are sorted by part."""

    def found():
        last, lead, own = None, None, np.zeros(0, np.int64)
        for batch in batches:
            part, follows, nodes, texts = *(batch.column(i).to_pylist() for i in range(3)), batch.column(3)
            for i, node in enumerate(nodes):
                held = shingles(texts[i].as_py())
                if part[i] != last:
                    last, lead, own = part[i], None, held
                if not follows[i]:
                    lead, own = node, held
                elif lead is not None and alike(held, own):
                    yield node, lead

    yield from _pairs_out(found())


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, t): the text of each wanted node (column node) once, as UTF-8, from rows (node, t)."""
    # most other texts are left out before the shuffle
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(wanted.select(modulo(F.col("node"), BITS)), BITS))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(shared.value, batch.column(0).to_numpy(zero_copy_only=False) % BITS)))

    bound_batches(rows.sparkSession)
    told = rows.select("node", F.col("t").cast("binary").alias("t")).mapInArrow(run, "node bigint, t binary")
    return told.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("t").alias("t"))


def _blocks(rows: DataFrame, sizes: DataFrame, first: Column) -> DataFrame:
    """(part, follows, ...) for rows with a group g and the weights w of groups: a group is dealt in blocks, and its first rows are in all of them."""
    joined = rows.join(sizes, "g")
    blocks = F.ceil(F.col("w") / BLOCK).cast("int")
    own = F.when(first, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("g", "node"), blocks).cast("int")))
    return joined.withColumn("follows", ~first).withColumn("own", F.explode(own)).withColumn("part", F.xxhash64("g", "own")).drop("own", "w")


def _with_leaders(rows: DataFrame, drawn: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between texts of one group, for rows (g, node, n): each is compared with the likeliest of its block's leaders.

    Leaders are chosen by the maps of ``drawn`` alone; only texts that have a
    likely leader are moved, to where the leader's is. The least and the greatest
    node of a group are in all its blocks, and first.
    """
    weight = F.sum(F.col("n") + EXTRA).cast("bigint").alias("w")
    sizes = rows.groupBy("g").agg(weight, F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    dealt = _blocks(rows, sizes, F.col("node").isin(F.col("low"), F.col("high"))).join(drawn.select("node", "map"), "node")
    likely = dealt.select("part", "follows", "node", "n", "map").repartition("part").sortWithinPartitions("part", "follows", "node").mapInArrow(_sketched, "g bigint, node bigint")
    likely = scratch.keep(likely.distinct().join(drawn.select("node", "n"), "node"))
    led = likely.unionByName(likely.select("g").distinct().select("g", F.col("g").alias("node"), F.lit(0).alias("n")))
    met = _blocks(led, led.groupBy("g").agg(weight), F.col("g") == F.col("node")).select("part", "follows", "node")
    told = texts_of(texts, met.select("node"))
    return met.join(told, "node").select("part", "follows", "node", "t").repartition("part").sortWithinPartitions("part", "follows", "node").mapInArrow(_led, "a bigint, b bigint")


def _picked(rows: DataFrame) -> DataFrame:
    """(g, node, n): the most and the least crowded key of each node, for rows (key, node, n, m) with m texts in a key."""
    crowd = F.shiftleft(F.least("m", F.lit((1 << 22) - 1)).cast("bigint"), 40).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << 40) - 1)))
    picked = rows.groupBy("node", "n").agg(F.max(crowd).alias("x"), F.min(crowd).alias("y"))
    return picked.select("node", "n", F.explode(F.array_distinct(F.array("x", "y"))).alias("g"))


#: Columns of a row of step 3.
ROW = ["side", "comp", "node", "n", "place", "map", "key"]
ROW_TYPES = "part bigint, side int, comp bigint, node bigint, n int, place int, map binary, key bigint"


def _pairs(part: np.ndarray, columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j), j before i, of one part that may be alike: of different groups, on different sides if the part has two, and not ruled out.

    Rows are sorted by part. Small parts are treated together, one distance
    between rows after the other; of a large part one row after the other.
    """
    side, comp, n, place = (columns[i].to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 3, 4))
    start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    size = np.diff(np.append(start, len(part)))
    sided = np.maximum.reduceat(side, start) != np.minimum.reduceat(side, start)
    group = np.repeat(np.arange(len(start)), size)
    within = np.arange(len(part)) - start[group]

    def met(i, j):
        ok = (comp[i] != comp[j]) & possible(n[i], place[i], n[j], place[j]) & (~sided[group[i]] | (side[i] != side[j]))
        return i[ok], j[ok]

    small = size[group] <= SMALL
    found = []
    for back in range(1, min(int(size.max()), SMALL)):
        i = np.flatnonzero(small & (within >= back))
        found.append(met(i, i - back))
    for k in np.flatnonzero(size > SMALL):
        for i in range(start[k] + 1, start[k] + size[k]):
            j = np.arange(start[k], i)
            found.append(met(np.full(len(j), i), j))
            if sum(len(x) for x, _ in found) > 1 << 20:
                yield from _unlike(found, n, columns[5])
                found = []
    yield from _unlike(found, n, columns[5])


def _unlike(found: list[tuple[np.ndarray, np.ndarray]], n: np.ndarray, maps: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs that their maps don't rule out."""
    i, j = (np.concatenate([x[k] for x in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
    if not len(i):
        return
    rows = np.unique(np.concatenate((i, j)))
    held = Maps(maps.take(pa.array(rows)).to_pylist())
    ok = few_odd(n[i], n[j], held.differ(np.searchsorted(rows, i), np.searchsorted(rows, j)))
    if ok.any():
        yield i[ok], j[ok]


def _parts(batches, least: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Batches of whole parts, with about ``least`` rows or one part; the first column has the part, and rows are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < least or not batch.num_rows:
            continue
        whole = pa.concat_batches(held)
        part = whole.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(part, part[-1], "left"))
        if last:
            yield whole.slice(0, last)
        held = [whole.slice(last)]
    if held:
        yield pa.concat_batches(held)


def _hopeful(batches):
    """The rows of each part that have a candidate there."""
    for batch in _parts(batches):
        stay = np.zeros(batch.num_rows, bool)
        for i, j in _pairs(batch.column(0).to_numpy(zero_copy_only=False), batch.columns[1:]):
            stay[i] = True
            stay[j] = True
        if stay.any():
            yield batch.filter(pa.array(stay))


def _firsts(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """The candidates (i, j) of whole parts that have no key in common before their part's; the column after ROW has each row's keys before it."""
    before = None
    for some, others in _pairs(batch.column(0).to_numpy(zero_copy_only=False), batch.columns[1:]):
        before = before or [frozenset(k) for k in batch.column(1 + len(ROW)).to_pylist()]
        for i, j in zip(some.tolist(), others.tolist(), strict=True):
            if before[i].isdisjoint(before[j]):
                yield i, j


def _first_met(batches):
    """The rows of each part that have a candidate not met in an earlier key of both."""
    for batch in _parts(batches):
        stay = np.zeros(batch.num_rows, bool)
        for i, j in _firsts(batch):
            stay[i] = stay[j] = True
        if stay.any():
            yield batch.filter(pa.array(stay))


def _compared(batches):
    """Links between the rows (part, *ROW, before, t) of each part, by comparing the whole sets; a pair is compared in the first of its common keys only."""

    def found():
        trees = Trees()
        for batch in _parts(batches, 1):
            comp, node = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            held: dict[int, np.ndarray] = {}
            for i, j in _firsts(batch):
                if trees.root(comp[i]) != trees.root(comp[j]):
                    for k in (i, j):
                        if k not in held:
                            held[k] = shingles(batch.column(batch.num_columns - 1)[k].as_py())
                    if alike(held[i], held[j]):
                        trees.join(comp[i], comp[j])
                        yield node[i], node[j]

    yield from _pairs_out(found())


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (key, comp, node, n, place) of keys with several groups, in parts that hold every pair of different groups once or more.

    Texts of a key's largest group are met by the others only, not by one another.
    """
    weight = F.col("n") + EXTRA
    by_comp = rows.groupBy("key", "comp").agg(F.sum(weight).alias("w"))
    mixed = by_comp.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max_by("comp", "w").alias("big"), F.sum("w").alias("all"), F.max("w").alias("most")).where("c > 1")
    joined = rows.join(mixed, "key")
    joined = joined.withColumn("bl", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")).withColumn("bb", F.ceil(F.col("most") / BLOCK).cast("int"))
    joined = joined.withColumn("large", F.col("comp") == F.col("big"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("large"), F.col("bb")).otherwise(F.col("bl"))).cast("int")
    joined = joined.withColumn("own", own)
    place = lambda kind, i, j, side: F.struct(kind.alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    zero, one = F.lit(0), F.lit(1)
    among = F.transform(F.sequence(zero, F.col("bl") - 1), lambda x: place(zero, F.least(F.col("own"), x), F.greatest(F.col("own"), x), F.when(F.col("own") > x, 1).otherwise(0)))
    to_large = F.transform(F.sequence(zero, F.col("bb") - 1), lambda x: place(one, F.col("own"), x, zero))
    to_small = F.transform(F.sequence(zero, F.col("bl") - 1), lambda x: place(one, x, F.col("own"), one))
    single = F.array(place(zero, zero, zero, zero))
    parts = F.when((F.col("bl") == 1) & (F.col("bb") == 1), single).when(F.col("large"), to_small).otherwise(F.concat(among, to_large))
    return joined.select("key", "comp", "node", "n", "place", F.explode(parts).alias("p")).select(
        F.xxhash64("key", "p.kind", "p.i", "p.j").alias("part"), F.col("p.side").alias("side"), "comp", "node", "n", "place", "key"
    )


def links(docs: DataFrame, fuzzy: Callable, text_col: str = "text") -> DataFrame:
    """(a, b): the number of each text that isn't the smallest of its group, and that smallest one.

    ``fuzzy`` gives the Arrow batches (key, node) of the Golay keys for batches
    (node, fp). Groups are the components of all pairs with a similarity of 0.8 or more.
    """
    with Scratch(docs.sparkSession) as scratch:
        return _links(docs, fuzzy, text_col, scratch)


def _links(docs: DataFrame, fuzzy: Callable, text_col: str, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(_common(docs, text_col))
    numbered = docs.select(node_of(F.col(text_col)).alias("node"), F.col(text_col).alias("t"))

    def sketch(columns: list[pa.Array], texts: list[bytes | None]) -> list[pa.Array]:
        held = [shingles(t or b"") for t in texts]
        return [columns[0], pa.array([len(h) for h in held], pa.int32()), pa.array([fingerprint(h) for h in held], pa.int64()), pa.array([parity(h).tobytes() for h in held], pa.binary())]

    drawn = by_text(numbered, ["node"], "t", "node bigint, n int, fp bigint, map binary", sketch)
    drawn = scratch.keep(drawn.groupBy("node").agg(*[F.first(x).alias(x) for x in ("n", "fp", "map")]))

    # 1. fingerprints
    near = drawn.select("node", "fp").mapInArrow(fuzzy, "key bigint, node bigint")
    crowds = near.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    near = near.join(crowds, "key").join(drawn.select("node", "n"), "node")
    early = scratch.keep(_with_leaders(_picked(near), drawn, numbered, scratch))
    grouped = smallest_reachable(early)

    # 2. the most and the least crowded of a text's keys
    seen: set[int] = set()

    def keyed(columns: list[pa.Array], texts: list[bytes | None]) -> list[pa.Array]:
        out = [(np.zeros(0, np.int64),) * 4]
        for t, node in zip(texts, columns[0].to_pylist(), strict=True):
            # a text's copies have equal rows: within a task one will do
            if node in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(node)
            held = shingles(t or b"")
            own = keys(held, common.value)
            out.append((own, np.full(len(own), node), np.int64(len(held)) << 32 | np.arange(len(own)), level(own, common.value)))
        return [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)]

    each = by_text(numbered, ["node"], "t", "key bigint, node bigint, at bigint, hot bigint", keyed)
    # a common key, known by the sample to be in several texts, is dealt over many tasks; any other one is counted in one
    each = each.withColumn("salt", F.when(F.col("hot") > 0, F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).repartition("key", "salt")
    each = each.groupBy("key", "salt", "node").agg(F.first("at").alias("at"), F.first("hot").alias("hot"))
    crowd = F.when(F.col("hot") > 0, F.col("hot") * 1000).otherwise(F.count(F.lit(1)).over(Window.partitionBy("key", "salt")))
    shared = each.withColumn("m", crowd).where("m > 1")
    shared = scratch.keep(shared.select("key", "node", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("place"), "m"))

    def apart(rows: DataFrame, grouped: DataFrame) -> DataFrame:
        rows = rows.join(grouped.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        return rows.join(rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key"), "key", "left_semi")

    left = apart(shared, grouped)
    early = scratch.keep(early.unionByName(_with_leaders(_picked(left), drawn, numbered, scratch)))
    grouped = smallest_reachable(early)

    # 3. all pairs that are left
    left = apart(shared, grouped)
    dealt = _dealt(scratch.keep(left)).join(drawn.select("node", "map"), "node").select("part", *ROW)
    hopeful = scratch.keep(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_hopeful, ROW_TYPES))
    held = hopeful.groupBy("node").agg(F.collect_set(F.struct("place", "key")).alias("held"))
    before = F.transform(F.filter("held", lambda x: x["place"] < F.col("place")), lambda x: x["key"]).alias("before")
    told_apart = hopeful.join(held, "node").select("part", *ROW, before).repartition("part").sortWithinPartitions("part")
    few = scratch.keep(told_apart.mapInArrow(_first_met, ROW_TYPES + ", before array<bigint>"))
    met = few.join(texts_of(numbered, few.select("node")), "node").select("part", *ROW, "before", "t")
    late = met.repartition("part").sortWithinPartitions("part", "node").mapInArrow(_compared, "a bigint, b bigint")
    return smallest_reachable(early.unionByName(late))


def groups(docs: DataFrame, fuzzy: Callable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, component_id) of groups of near-copies: the smallest id of all texts that links() connects.

    Null, empty and blank texts are one group; a null id never names a group with
    other ids; rows that repeat an id stay; an empty table gives an empty result.
    """
    marked = materialise(docs.select(F.col(id_col).alias("id"), node_of(F.col(text_col)).alias("node")))
    nodes = marked.groupBy("node").agg(F.min("id").alias("low"))
    joined = links(docs, fuzzy, text_col)
    member = materialise(nodes.join(joined, nodes["node"] == joined["a"], "left").select("node", "low", F.coalesce("b", "node").alias("root")))
    least = member.groupBy("root").agg(F.min("low").alias("component_id"))
    named = member.join(least, "root").select("node", "component_id")
    return marked.join(named, "node").select(F.col("id").alias(id_col), "component_id")
