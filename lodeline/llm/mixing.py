"""Mixing sources to target weights by Poisson replication, in DataFrame operations alone.

A source's target rate is the mean number of times that one of its documents
should appear. Each document draws its number of copies from the Poisson
distribution with that mean, by inverting it at a uniform number hashed from its
id and the seed, and is exploded into so many rows. All copies are then dealt to
partitions and ordered by another hash: a global shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from lodeline.llm.arrow import free

SEED = 10
#: Sources whose rates are broadcast; with more of them the rates are joined by a shuffle, whose hot keys Spark splits.
BROADCAST_SOURCES = 20_000
#: The weight of a source without a weight of its own grows as its rows to this power.
TEMPERATURE = 0.5


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 12 hex digits of the MD5 of the parts joined by colons."""
    joined = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def rates(docs: DataFrame, source_col: str = "source", weights: Mapping[str, float] | None = None, size: float = 1.0, temperature: float = TEMPERATURE) -> DataFrame:
    """(source_col, n, rate): each source's rows and its mean repetitions.

    Rates are such that the expected rows of a source are its share of all
    weights times ``size`` times the rows of the input. A source that ``weights``
    doesn't name has its rows to the power ``temperature`` as weight; null is a
    source of its own.
    """
    counted = docs.groupBy(source_col).agg(F.count(F.lit(1)).alias("n"))
    weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    for name, value in (weights or {}).items():
        weight = F.when(F.col(source_col) == name, F.lit(float(value))).otherwise(weight)
    weighted = counted.withColumn("w", weight)
    total = weighted.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    if not total["w"]:
        return weighted.select(source_col, "n", F.lit(0.0).alias("rate"))
    return weighted.select(source_col, "n", (F.col("w") / F.lit(total["w"]) * F.lit(float(size)) * F.lit(float(total["n"])) / F.col("n")).alias("rate"))


#: A mean is split into equal parts of at most this, drawn apart and added, so that no probability underflows.
PART = 32.0


def poisson_table(rate: Column) -> Column:
    """The distribution function of a Poisson number with mean ``rate`` at 0, 1, 2 and so on, past the point where doubles tell it from 1."""
    none = F.struct(F.array(F.exp(-rate)).alias("c"), F.exp(-rate).alias("p"), F.exp(-rate).alias("last"))
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int"))

    def step(state: Column, i: Column) -> Column:
        p = state["p"] * rate / i
        last = state["last"] + p
        return F.struct(F.concat(state["c"], F.array(last)).alias("c"), p.alias("p"), last.alias("last"))

    return F.aggregate(steps, none, step, lambda state: state["c"])


def replicate(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """``docs`` with columns copy (from 1) and shuffle_key, each row as often as its Poisson draw says, in shuffled order.

    ``found`` is what rates() returns. Rows that repeat an id are drawn alike.
    Copies are dealt to partitions by the hash of their shuffle_key and sorted by
    it there, so neither sources nor copies of a row stay together.
    """
    named, parts, table, drawn = (free(x, docs) for x in ("mixed_source", "parts", "table", "drawn"))
    part = F.greatest(F.lit(1.0), F.ceil(F.col("rate") / PART).cast("double"))
    tables = found.select(F.col(source_col).alias(named), part.cast("int").alias(parts), poisson_table(F.col("rate") / part).alias(table))
    if found.count() <= BROADCAST_SOURCES:
        tables = F.broadcast(tables)
    times = F.aggregate(
        F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda total, j: total + F.size(F.filter(table, lambda c: c <= unit(F.lit(f"mix:{seed}"), id_col, j.cast("string"))))
    )
    joined = docs.join(tables, docs[source_col].eqNullSafe(tables[named])).withColumn(drawn, times).where(F.col(drawn) > 0)
    copies = joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(drawn).cast("bigint"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"order:{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy").cast("string")))
    return copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: Mapping[str, float] | None = None, size: float = 1.0, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """Documents replicated to the target weights of their sources and shuffled; see rates() and replicate().

    All columns stay, ``copy`` and ``shuffle_key`` are added (and replace columns
    of these names). Null and empty texts are mixed like others, an empty table
    gives an empty result.
    """
    plain = docs.drop("copy", "shuffle_key")
    return replicate(plain, rates(plain, source_col, weights, size, temperature), id_col, source_col, seed)


def oracle(table: str = "documents", size: float = 1.0, temperature: float = TEMPERATURE, seed: int = SEED) -> str:
    """DuckDB SQL for mix() with weights by temperature."""
    return f"""
WITH RECURSIVE counted AS (SELECT source, count(*) AS n FROM {table} GROUP BY source),
total AS (SELECT sum(pow(n::DOUBLE, {temperature!r})) AS w, sum(n)::DOUBLE AS n FROM counted),
rated AS (SELECT source, pow(counted.n::DOUBLE, {temperature!r}) / total.w * {size!r}::DOUBLE * total.n / counted.n AS rate FROM counted, total),
parted AS (SELECT source, rate, greatest(1, ceil(rate / {PART!r}))::INT AS parts FROM rated),
steps AS (
  SELECT source, parts, rate / parts AS r, 0 AS i, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS c FROM parted
  UNION ALL
  SELECT source, parts, r, i + 1, p * r / (i + 1), c + p * r / (i + 1) FROM steps WHERE i + 1 <= ceil(r + 12 * sqrt(r) + 24)
),
tables AS (SELECT source, any_value(parts) AS parts, list(c ORDER BY i) AS cs FROM steps GROUP BY source),
numbered AS (SELECT d.*, t.cs, unnest(generate_series(1, t.parts)) AS j FROM (SELECT row_number() OVER () AS rid, * FROM {table}) d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
drawn AS (
  SELECT rid, sum(len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('mix:{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || j), 1, 12))::BIGINT::DOUBLE / 281474976710656.0)))::BIGINT AS k
  FROM numbered GROUP BY rid
),
copies AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, unnest(generate_series(1, k)) AS copy FROM (SELECT row_number() OVER () AS rid, * FROM {table}) d JOIN drawn USING (rid) WHERE k > 0)
SELECT doc_id, text, lang, source, n_chars, copy, md5('order:{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key FROM copies
"""
