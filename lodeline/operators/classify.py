"""Centroid classification by character n-grams, metrics, voting, and a trainable pipeline."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from lodeline.functions.rules import small
from lodeline.functions.text import WORD, compact, features, let, normalise, tokens
from lodeline.operators.ordinals import numbered, within_key
from lodeline.session import bounded_batches, checkpointed, scratch


def gram_counts(docs: DataFrame, id_col: str, text_col: str, word: str = WORD) -> DataFrame:
    """(id_col, gram, n): character n-grams, and every token twice more."""
    return docs.select(id_col, F.explode(features(F.col(text_col), word)).alias("gram")).groupBy(id_col, "gram").agg(F.count(F.lit(1)).alias("n"))


#: Characters whose grams a task sorts at once.
BLOCK = 1 << 22


def gram_totals(texts: list[str], shortest: int = 2, longest: int = 4) -> Iterator[tuple[list[str], np.ndarray]]:
    """Grams and how often they occur in all of some texts, for each length; grams don't cross texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    known = np.zeros(0x110000, bool)
    known[codes] = True
    letters = np.flatnonzero(known).astype("<u4")
    if not len(letters) or len(letters) ** longest >= 1 << 62:  # too many letters for one number a gram
        for n in range(shortest, longest + 1):
            held = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
            yield list(held), np.array(list(held.values()), np.int64)
        return
    place = np.zeros(0x110000, np.int64)
    place[letters] = np.arange(len(letters))
    own = place[codes]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    keys = own
    for n in range(2, longest + 1):
        keys = keys[:-1] * len(letters) + own[n - 1 :]
        if n < shortest or not len(keys):
            continue
        found, counts = np.unique(keys[left[: len(keys)] >= n], return_counts=True)
        digits = np.stack([found // len(letters) ** (n - 1 - k) % len(letters) for k in range(n)], axis=1) if len(found) else np.zeros((0, n), np.int64)
        yield [b.decode("utf-32-le", "surrogatepass") for b in np.ascontiguousarray(letters[digits]).view(f"V{4 * n}").ravel().tolist()] if len(found) else [], counts


def _label_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    size, kind = 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        for label, texts in held.items():
            for grams, counts in gram_totals(texts):
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(grams), kind), pa.array(grams, pa.string()), pa.array(counts, pa.float64())], ["label", "gram", "w"])
        held.clear()

    for batch in batches:
        kind = batch.schema.field(0).type
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(label, []).append(text)
            size += len(text)
            if size >= BLOCK:
                yield from flush()
                size = 0
    yield from flush()


def profiles(examples: DataFrame, label: str, id_col: str, text_col: str, lexicon: DataFrame | None = None, word: str = WORD) -> DataFrame:
    """(label, gram, weight): the grams of a label's examples and, by weight, of its keywords (label, keyword, weight).

    The n-grams of blocks of texts are counted before a row is made of them; tokens, which count twice, are one row each.
    """
    kind = dict(examples.dtypes)[label]
    texts = examples.select(F.col(label).alias("label"), compact(F.col(text_col)).alias("t")).where("t <> ''")
    counted = texts.mapInArrow(_label_grams, f"label {kind}, gram string, w double")
    words = examples.select(F.col(label).alias("label"), F.explode(tokens(normalise(F.col(text_col)), 1, word)).alias("gram"), F.lit(2.0).alias("w"))
    own = counted.unionByName(words)
    if lexicon is not None:
        own = own.unionByName(lexicon.select("label", F.explode(features(F.col("keyword"), word)).alias("gram"), F.col("weight").alias("w")))
    return own.groupBy("label", "gram").agg(F.sum("w").alias("weight"))


def similarity(grams: DataFrame, centroids: DataFrame, id_col: str) -> DataFrame:
    """(id_col, label, cosine) of documents' grams (id_col, gram, n) and profiles (label, gram, weight); pairs without a common gram are left out."""
    centroids = checkpointed(centroids)
    own = grams.groupBy(id_col).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("__a"))
    norm = centroids.groupBy("label").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("__b"))
    dot = small(grams).join(centroids, "gram").groupBy(id_col, "label").agg(F.sum(F.col("n") * F.col("weight")).alias("dot"))
    return dot.join(own, id_col).join(F.broadcast(norm), "label").select(id_col, "label", (F.col("dot") / (F.col("__a") * F.col("__b"))).alias("cosine"))


def class_distribution(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, largest): rows by label, and the size of the largest class."""
    n = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("largest", F.expr("max(n) over ()"))


def macro_f1(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1) by label, from one pass of confusion counts."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    parts = cells.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("said"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit")))).alias("x")).select("x.*")
    by = parts.groupBy("label").agg(F.sum("actual").alias("actual"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return by.select("label", ratio(F.col("hit"), F.col("said")).alias("precision"), ratio(F.col("hit"), F.col("actual")).alias("recall"), ratio(2 * F.col("hit"), F.col("actual") + F.col("said")).alias("f1"))


def soft_vote(votes: DataFrame, id_col: str, probabilities: str) -> DataFrame:
    """(id_col, label, probability): the class with the highest mean over several probability arrays, the lowest of equals."""
    means = votes.select(id_col, F.posexplode(probabilities).alias("label", "p")).groupBy(id_col, "label").agg(F.round(F.avg("p"), 9).alias("p"))
    best = means.groupBy(id_col).agg(F.max(F.struct("p", (-F.col("label")).alias("l"))).alias("b"))
    return best.select(id_col, (-F.col("b.l")).alias("label"), F.col("b.p").alias("probability"))


def balanced_weight(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with a column weight: all rows over classes times the rows of the class."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = n.agg(F.sum("__n"), F.count(F.lit(1))).first()
    return rows.join(F.broadcast(n), label).withColumn("weight", F.lit(float(total[0] or 0)) / (F.lit(total[1]) * F.col("__n"))).drop("__n")


def bounded_grams(text: Column, shortest: int = 2, longest: int = 5) -> Column:
    """The substrings with ``shortest`` to ``longest`` characters of each word between two spaces, repeats included; they never cross words."""

    def of(held: Column, n: int) -> Column:
        gram = lambda i: F.concat(*[F.get(held, i + k) for k in range(n)])
        return F.when(F.size(held) >= n, F.transform(F.sequence(F.lit(0), F.size(held) - n), gram)).otherwise(F.array().cast("array<string>"))

    def of_word(word: Column) -> Column:
        letters = F.filter(F.split(word, ""), lambda c: c != "")
        return let(F.concat(F.array(F.lit(" ")), letters, F.array(F.lit(" "))), lambda held: F.concat(*[of(held, n) for n in range(shortest, longest + 1)]))

    words = F.filter(F.split(normalise(text), " "), lambda w: w != "")
    return F.flatten(F.transform(words, of_word))


@lru_cache(1 << 15)
def word_grams(word: str, shortest: int = 2, longest: int = 5) -> tuple[str, ...]:
    """The substrings with ``shortest`` to ``longest`` characters of a word between two spaces, repeats included."""
    held = f" {word} "
    return tuple(held[i : i + n] for n in range(shortest, longest + 1) for i in range(len(held) - n + 1))


def grams_of(text: str) -> dict[str, int]:
    """How often a normalised text holds each gram of its words; grams never cross words."""
    found: dict[str, int] = {}
    for word, times in Counter(text.split(" ")).items():
        for gram in word_grams(word) if word else ():
            found[gram] = found.get(gram, 0) + times
    return found


#: Characters of whole texts whose word-bounded grams a task sorts at once.
SORTED = 1 << 19


def _blocks(texts: Iterable[str]) -> Iterator[list[str]]:
    """Consecutive texts, of SORTED characters or a little more in all."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= SORTED:
            yield held
            held, size = [], 0
    if held:
        yield held


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts, each between two spaces, and the number of the text of each."""
    codes = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le"), "<u4")
    return codes, np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])


def text_frequencies(texts: list[str], shortest: int = 2, longest: int = 5) -> Iterator[tuple[list[str], np.ndarray]]:
    """Word-bounded grams and in how many of some normalised texts each is, for each length."""
    codes, of = _codes([" ".join(set(t.split(" "))) for t in texts])
    letters, own = np.unique(codes, return_inverse=True)
    base = len(letters)
    if base**longest >= 1 << 62:  # too many letters for one number a gram
        held = Counter(g for t in texts for g in grams_of(t))
        yield list(held), np.array(list(held.values()), np.int64)
        return
    space = codes == 32
    keys, within = own, np.ones(len(codes), bool)
    for n in range(2, longest + 1):
        keys = keys[:-1] * base + own[n - 1 :]
        # spaces are at a gram's ends alone, and not at both of two characters
        within = within[:-1] & (~space[n - 2 : -1] if n > 2 else ~(space[:-1] & space[1:]))
        if n < shortest or not within.any():
            continue
        grams, at = keys[within], of[: len(keys)][within]
        names = None
        if base**n * len(texts) >= 1 << 62:  # nor for one number a gram and text
            names, grams = np.unique(grams, return_inverse=True)
        pairs = np.sort(grams * len(texts) + at)
        found, counts = np.unique(pairs[np.diff(pairs, prepend=-1) > 0] // len(texts), return_counts=True)
        if names is not None:
            found = names[found]
        digits = np.stack([found // base ** (n - 1 - k) % base for k in range(n)], axis=1)
        joined = letters[digits].tobytes().decode("utf-32-le")
        yield [joined[i : i + n] for i in range(0, len(joined), n)], counts


#: Beginnings of grams by letters that a table has a place each for; in a larger one they are searched.
PLACES = 1 << 22


@dataclass(frozen=True)
class GramTable:
    """A vocabulary in which all grams of texts are looked up at once, letter by letter.

    ``letters`` are its code points in order. Of each length from two on,
    ``keys`` has the beginnings of grams, as the number of the beginning that is
    a letter shorter by the letters plus the last letter, and ``grams`` the number
    of the gram that a beginning is, -1 if it is none.
    """

    letters: np.ndarray
    keys: list[np.ndarray]
    grams: list[np.ndarray]

    @staticmethod
    def of(numbers: dict[str, int]) -> GramTable:
        letters = sorted(set("".join(numbers)))
        place = {c: k for k, c in enumerate(letters)}
        table, before = GramTable(np.array([ord(c) for c in letters], "<u4"), [], []), place
        for n in range(2, max(map(len, numbers), default=0) + 1):
            held = sorted((before[g[:-1]] * len(letters) + place[g[-1]], g) for g in {g[:n] for g in numbers if len(g) >= n})
            table.keys.append(np.array([k for k, _ in held], np.int64))
            table.grams.append(np.array([numbers.get(g, -1) for _, g in held], np.int64))
            before = {g: k for k, (_, g) in enumerate(held)}
        return table

    def counter(self, size: int) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A function that says of texts where the grams of each begin and the last ones end, the grams' numbers (below ``size``) in order, and how often the text holds each."""
        place, base = np.full(0x110000, -1, np.int32), len(self.letters)
        place[self.letters] = np.arange(base)
        above, places = base, []
        for keys in self.keys:
            places.append(np.full(above * base, -1, np.int32) if above * base <= PLACES else None)
            if places[-1] is not None:
                places[-1][keys] = np.arange(len(keys))
            above = len(keys)

        def found(keys: np.ndarray, direct: np.ndarray | None, key: np.ndarray) -> np.ndarray:
            if direct is not None:
                return direct[key]
            node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[node] == key, node, -1)

        def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            codes, of = _codes(texts)
            own = place[codes]
            at = np.flatnonzero(own >= 0)
            node, held = own[at].astype(np.int64), [np.zeros(0, np.int64)]
            # no gram has a space inside, so none is found across words or texts
            for n, (keys, grams, direct) in enumerate(zip(self.keys, self.grams, places, strict=True), 2):
                letter = own[np.minimum(at + n - 1, len(codes) - 1)]
                on = (letter >= 0) & (at < len(codes) - n + 1)
                at, node = at[on], found(keys, direct, node[on] * base + letter[on])
                at, node = at[node >= 0], node[node >= 0].astype(np.int64)
                gram = grams[node]
                held.append((of[at] * size + gram)[gram >= 0])
            ids, n = np.unique(np.concatenate(held), return_counts=True)
            return np.searchsorted(ids, np.arange(len(texts) + 1) * size), ids % size, n

        return counts


#: Entries in an Arrow batch.
ENTRIES = 200_000


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(id_col, normalise(F.col(text_col)).alias("t")).where("t IS NOT NULL")


def _rows(batches: Iterator[pa.RecordBatch], entries, names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
    """Each text's id beside its entries: ``entries`` of its counts gives a list for each further column."""
    ids, columns, kind = [], [[] for _ in kinds], None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    for batch in batches:
        kind = batch.schema.field(0).type
        for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = entries(grams_of(text))
            ids += [one] * len(found[0])
            for column, values in zip(columns, found, strict=True):
                column += values
            if len(ids) >= ENTRIES:
                yield out()
                ids, columns = [], [[] for _ in kinds]
    if ids:
        yield out()


def bounded_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, gram, n): how often each text holds each gram; ids are unique, so a text's grams are counted where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(batches, lambda c: (list(c), list(c.values())), [id_col, "gram", "n"], [pa.string(), pa.int64()])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, gram string, n bigint")


def document_frequencies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(gram, df): in how many texts each gram is; each task adds up blocks of its own texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _blocks(text for batch in batches for text in batch.column(1).to_pylist()):
            for grams, counts in text_frequencies(texts):
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(counts, pa.int64())], ["gram", "n"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("df"))


def inverse_frequencies(counts: DataFrame, documents: int) -> DataFrame:
    """(gram, df, idf) of counts (id, gram, n) or of frequencies (gram, df): the smoothed logarithm of documents over those with the gram, plus one."""
    df = counts if "df" in counts.columns else counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log((1.0 + F.lit(documents)) / (1.0 + F.col("df"))) + 1.0)


def gram_weights(counts: DataFrame, idf: DataFrame, id_col: str) -> DataFrame:
    """(id_col, gram, weight): dampened counts by inverse frequency, of length one for each text; grams without a frequency are left out."""
    raw = counts.join(idf, "gram").withColumn("raw", (1.0 + F.log("n")) * F.col("idf"))
    size = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("__size"))
    return raw.join(size, id_col).withColumn("weight", F.col("raw") / F.col("__size")).drop("raw", "n", "df", "idf", "__size")


#: Grams of a vocabulary that each task may hold; the texts of a larger one meet it by joins.
HELD = 1 << 19


def text_weights(docs: DataFrame, id_col: str, text_col: str, idf: DataFrame) -> DataFrame:
    """As gram_weights() of the texts' counts, but of a vocabulary of at most HELD grams in one pass over the texts, without a shuffle."""
    idf = checkpointed(idf.select("gram", "idf"))
    if idf.count() > HELD:
        return gram_weights(checkpointed(bounded_counts(docs, id_col, text_col)), idf, id_col)
    known = docs.sparkSession.sparkContext.broadcast({r.gram: r.idf for r in idf.collect()})

    def weighed(counts: dict[str, int]) -> tuple[list, list]:
        grams = [g for g in counts if g in known.value]
        raw = (1.0 + np.log([counts[g] for g in grams])) * np.array([known.value[g] for g in grams])
        return grams, (raw / np.sqrt((raw * raw).sum())).tolist() if grams else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(batches, weighed, [id_col, "gram", "weight"], [pa.string(), pa.float64()])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, gram string, weight double")


@dataclass(frozen=True)
class TextModel:
    """A vocabulary (gram, i, idf), its size, and a fitted regression over it."""

    vocabulary: DataFrame
    size: int
    regression: LogisticRegressionModel


#: Grams of a vocabulary at most, the commonest: the regression's coefficients are in the driver, one for each and a class.
VOCABULARY = 1 << 18
#: Partitions of the regression's rows at most, for each core.
ROUND_TASKS = 2


def _vectors(rows: DataFrame, text_col: str, vocabulary: DataFrame, size: int) -> DataFrame:
    """``rows`` with x: the weights of each text's grams as a sparse vector; a text without a known gram has a zero vector.

    The vocabulary, which is bounded as the coefficients are, goes to every task, and a text's vector is made where it lies.
    """
    bounded_batches(rows.sparkSession)
    held = vocabulary.select("gram", "i", "idf").collect()
    idf = np.zeros(size)
    idf[[r.i for r in held]] = [r.idf for r in held]
    known = rows.sparkSession.sparkContext.broadcast((GramTable.of({r.gram: r.i for r in held}), idf))

    @F.arrow_udf(VectorUDT())
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, idf = known.value
        counts = table.counter(size)
        for batch in batches:
            sizes, numbers, weights = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for texts in _blocks(text or "" for text in batch.to_pylist()):
                ends, grams, n = counts(texts)
                raw = (1.0 + np.log(n)) * idf[grams]
                for i, j in pairwise(ends):
                    raw[i:j] /= np.sqrt((raw[i:j] * raw[i:j]).sum())
                sizes.append(np.diff(ends))
                numbers.append(grams)
                weights.append(raw)
            ends = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), kind)) for x, kind in ((numbers, pa.int32()), (weights, pa.float64()))]
            # sparse vectors as their type's columns
            yield pa.StructArray.from_arrays([pa.array(np.zeros(len(batch)), pa.int8()), pa.array(np.full(len(batch), size), pa.int32()), *lists], VectorUDT.sqlType().names)

    return rows.withColumn("x", vectors(normalise(F.col(text_col))))


def text_pipeline(rows: DataFrame, label: str, id_col: str, text_col: str, c: float = 4.0, rounds: int = 1000, vocabulary: int = VOCABULARY) -> TextModel:
    """Word-bounded n-grams weighed exactly, and a class-balanced logistic regression whose penalty is that of parameter ``c``.

    The vocabulary is every gram of the rows, or the ``vocabulary`` commonest
    (equals by name). The loss is summed over rows by class weight and half the
    coefficients' squares added once over ``c``; the intercept isn't penalised and
    nothing is scaled, so the optimum is that of the plain formula.
    """
    data = balanced_weight(rows.where(F.col(label).isNotNull()), label)
    count = data.count()
    idf = checkpointed(inverse_frequencies(document_frequencies(data, id_col, text_col), count))
    distinct = idf.count()
    if distinct > vocabulary:
        idf = idf.orderBy(F.desc("df"), "gram").limit(vocabulary)
    held = numbered(idf.select("gram", "idf"), ["gram"], "i").withColumn("i", F.col("i").cast("int"))
    size = max(min(distinct, vocabulary), 1)
    # the regression holds the vectors itself, so they aren't written
    x = _vectors(data.select(F.col(label).cast("double").alias("label"), "weight", F.col(text_col).alias("__text")), "__text", held, size).select("label", "weight", "x")
    # every round moves the coefficients once a partition
    x = x.coalesce(ROUND_TASKS * rows.sparkSession.sparkContext.defaultParallelism)
    fit = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", maxIter=rounds, tol=1e-8, regParam=1.0 / (c * max(count, 1)), standardization=False)
    # the fitted object holds a summary and through it the session, which tasks can't be sent once it has observed metrics; what is saved and read again doesn't
    with scratch(rows.sparkSession) as path:
        fit.fit(x).save(path)
        regression = LogisticRegressionModel.load(path)
        return TextModel(held, size, regression)


def text_predict(model: TextModel, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rows``, whose ids are unique, with the columns probability and prediction."""
    return model.regression.transform(_vectors(rows, text_col, model.vocabulary, model.size)).select(*rows.columns, "probability", "prediction")


def grid_search(rows: DataFrame, label: str, id_col: str, text_col: str, choices: Sequence[float], held_out: float = 0.1, seed: int = 42, **fit) -> tuple[float, dict[float, float]]:
    """The penalty parameter with the best macro F1 on rows held out by hash, and the F1 of each."""
    rows = rows.withColumn("__u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) * F.lit(2.0**-53))
    told, asked = rows.where(F.col("__u") >= held_out), rows.where(F.col("__u") < held_out)
    found = {}
    for c in choices:
        said = text_predict(text_pipeline(told, label, id_col, text_col, c=c, **fit), asked, id_col, text_col)
        found[c] = macro_f1(said, label, "prediction").agg(F.avg("f1")).first()[0] or 0.0
    return max(found, key=lambda c: (found[c], -choices.index(c))), found


def ensemble(rows: DataFrame, asked: DataFrame, label: str, id_col: str, text_col: str, seeds: Sequence[int] = (42, 43, 44), share: float = 0.9, **fit) -> DataFrame:
    """(id_col, label, probability) by the mean of models trained on as many hashed samples of the rows."""
    votes = None
    for seed in seeds:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) * F.lit(2.0**-53)
        said = text_predict(text_pipeline(rows.where(u < share), label, id_col, text_col, **fit), asked, id_col, text_col)
        part = said.select(id_col, vector_to_array("probability").alias("p"))
        votes = part if votes is None else votes.unionByName(part)
    return soft_vote(votes, id_col, "p")


def augment(rows: DataFrame, label: str, id_col: str, text_col: str, seed: int = 42) -> DataFrame:
    """Rows of the smaller classes again, with two words swapped or one dropped, until each class is exactly as large as the largest.

    Each row is repeated equally often, and what then lacks is made from the rows
    of the class with the smallest hashes, ranked without gathering a class in a
    task. Copies and their words are drawn by hash, so the result can be repeated;
    copies have a column copy from 1, the rows themselves 0. A text of fewer than
    two words is copied as it is; a null class is a class.
    """
    n = rows.groupBy(F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    # a row for each class
    sizes = n.crossJoin(F.broadcast(n.agg(F.max("__n").alias("__most")))).select("__label", "__n", (F.col("__most") - F.col("__n")).alias("__need"))
    drawn = rows.withColumn("__u", F.xxhash64(F.lit(seed), F.col(id_col)))
    placed = within_key(drawn, label, ["__u", id_col], "__place")
    held = placed.join(sizes, F.col(label).eqNullSafe(F.col("__label")))
    times = F.floor(F.col("__need") / F.col("__n")).cast("int") + F.when(F.col("__place") < F.col("__need") % F.col("__n"), 1).otherwise(0)
    words = F.split(text_col, " ")
    size = F.size(words)
    at = lambda salt, below: (F.pmod(F.xxhash64(F.lit(seed + salt), F.col(id_col), F.col("copy")), below) + 1).cast("int")
    i, j = at(1, size), at(2, size)
    swapped = F.transform(words, lambda w, k: F.when(k + 1 == i, F.element_at(words, j)).when(k + 1 == j, F.element_at(words, i)).otherwise(w))
    dropped = F.filter(words, lambda w, k: k + 1 != i)
    changed = F.when(size < 2, words).when(at(3, F.lit(2)) == 1, swapped).otherwise(dropped)
    copies = held.withColumn("copy", F.explode(F.sequence(F.lit(0), times)))
    text = F.when(F.col("copy") == 0, F.col(text_col)).otherwise(F.array_join(changed, " "))
    return copies.withColumn(text_col, text).drop("__n", "__need", "__label", "__u", "__place")
