"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. Two
fingerprints that differ in at most two bits agree wholly in one segment and
differ in at most one bit of the segment before it (cyclically): the errors
are (2,0,0), (1,1,0) or fewer, and one of the three neighbouring pairs fits. A
key is therefore an exact segment joined with a Golay codeword index near its
neighbour, 33 or 34 bits in all; a fingerprint has at most 18 keys. Fingerprints that share a key are joined and verified.

A key that many fingerprints share is not joined with itself. Its fingerprints
instead name all words within one bit of them: two fingerprints differ in at
most two bits exactly if they name a common word, and all that name one word
are linked to the smallest. This gives the same components from 65 rows a
fingerprint, whatever the size of the group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodeline.llm import alike, golay
from lodeline.llm.arrow import bound_batches, by_text, free, materialise
from lodeline.llm.components import smallest_reachable

#: The XXH64 seed of a shingle.
SEED = 42
#: Segments as (lowest bit, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Keys with up to so many fingerprints are joined pair by pair; the fingerprints of others are linked through their balls, as exactly.
PAIRWISE = 8


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of one UTF-8 text: bit i is 1 if it is 1 in over half of the hashes of its shingles."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*[found[i:] for i in range(words)], strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp): the signed 64-bit fingerprint of each whole text; null and blank texts get 0."""

    def run(columns: list[pa.Array], texts: list[bytes | None]) -> list[pa.Array]:
        found = np.array([fingerprint(t or b"", words) for t in texts], np.uint64)
        return [columns[0], pa.array(found.view(np.int64))]

    kind = docs.schema[id_col].dataType.simpleString()
    return by_text(docs, [id_col], text_col, f"{id_col} {kind}, fp bigint", run)


def keys_of(fps: np.ndarray) -> list[np.ndarray]:
    """For each segment pair, the keys of each fingerprint, one row a fingerprint; repeats stay."""
    raw = fps.view(np.uint64)
    part = [((raw >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    out = []
    for i in range(3):
        exact, fuzzy = part[i], part[i - 1]
        near = golay.nearby(fuzzy, SEGMENTS[i - 1][1])
        out.append((np.int64(i) << 40) | (exact[:, None] << 12) | near)
    return out


def emit_keys(batches):
    """The distinct keys of rows (node, fp) as rows (key, node)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 10_000):
            part = batch.slice(at, 10_000)
            keys = np.sort(np.concatenate(keys_of(part.column(1).to_numpy(zero_copy_only=False)), axis=1), axis=1)
            fresh = np.ones(keys.shape, bool)
            fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
            rows = np.nonzero(fresh)
            yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), part.column(0).take(pa.array(rows[0]))], ["key", "node"])


def _emit_ball(batches):
    flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)))
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        words = (fps.view(np.uint64)[:, None] ^ flips[None, :]).view(np.int64).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.repeat(fps, 65))], ["word", "fp"])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) of distinct fingerprints (column fp) whose components are those of all pairs at two or fewer differing bits."""
    bound_batches(distinct.sparkSession)
    keyed = materialise(distinct.select("fp", F.col("fp").alias("same")).mapInArrow(emit_keys, "key bigint, node bigint").withColumnRenamed("node", "fp"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(keyed.join(sizes, "key"))
    few = shared.where(F.col("n") <= PAIRWISE)
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 2
    pairs = (
        few.alias("x")
        .join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & near)
        .select(F.col("y.fp").alias("a"), F.col("x.fp").alias("b"))
    )
    crowded = shared.where(F.col("n") > PAIRWISE).select("fp").distinct()
    named = materialise(crowded.mapInArrow(_emit_ball, "word bigint, fp bigint"))
    least = named.groupBy("word").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    through = named.join(least, "word").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(through).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Each document's fingerprint and component: (id_col, fingerprint, component_id).

    Documents link if their fingerprints differ in two bits or fewer;
    ``component_id`` is the smallest id reachable, the document's own included.
    Whole texts count. Null, empty and blank texts have fingerprint zero and
    link like any other. Rows that repeat an id stay, one result row each. A row
    with a null id gets its component too, and is never the smallest unless all
    are null. An empty table gives an empty result; further columns are ignored.
    """
    marked = materialise(fingerprints(docs, id_col, text_col, words))
    first = materialise(marked.groupBy("fp").agg(F.min(id_col).alias("low")))
    joined = smallest_reachable(links(first.select("fp")))
    # the smallest fingerprint names a component; its smallest document is what the contract asks for
    member = first.join(joined, first["fp"] == joined["a"], "left").select("fp", "low", F.coalesce("b", "fp").alias("root"))
    member = materialise(member)
    root = member.where("fp <> root").groupBy("root").agg(F.min("low").alias("least"))
    named = (
        member.join(root, "root", "left")
        .join(first.select(F.col("fp").alias("root"), F.col("low").alias("own")), "root")
        .select("fp", F.least("least", "own", "low").alias("component_id"))
    )
    return marked.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-copies: of each group that alike.groups() finds the row with the smallest id.

    Groups are the components of all pairs whose sets of five-word shingles have
    a similarity of 0.8 or more; the Golay keys of the sets' fingerprints lead to
    most of them, and no other pair is left out. All columns stay. Null, empty
    and blank texts are one group. Of rows that repeat the kept id one stays.
    Rows with a null id can't be told apart: they stay if one of them is in a
    component without ids. An empty table stays empty.
    """
    kind = docs.schema[id_col].dataType
    found = materialise(alike.groups(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), emit_keys, "id", "text"))
    kept = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    kept = materialise(kept.select(F.col("id").cast(kind).alias(free("kept_id", docs)), F.col("rows").alias(free("rows", docs))))
    at, rows = kept.columns
    stay = docs.join(kept, docs[id_col].eqNullSafe(kept[at]), "left_semi")
    twice = kept.where((F.col(rows) > 1) & F.col(at).isNotNull())
    if twice.isEmpty():
        return stay
    repeated = stay.join(twice, stay[id_col] == twice[at], "left_semi").dropDuplicates([id_col])
    return stay.join(twice, stay[id_col] == twice[at], "left_anti").unionByName(repeated)
