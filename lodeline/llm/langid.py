"""Language identification by unigrams over subword pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability is the sum, over all ways to cut it into pieces, of the
products of their probabilities: the forward algorithm over the lattice of
pieces. The piece probabilities are learned by expectation maximisation over the
same lattices. Words are maximal runs of letters, lower-cased, each opened by
the vocabulary's word mark; the vocabulary's pieces don't cross words, so a
text's likelihood is the product of those of its words and each distinct word
is scored once a block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeline.llm.arrow import bound_batches, by_text, map_rows
from lodeline.llm.kernels import mix
from lodeline.llm.sampling import in_training, least_by_hash, only_ids

#: A public vocabulary; any sentencepiece model file with the same word mark will do.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Documents of each language from which the probabilities are learned, at most.
DOCS_PER_LANGUAGE = 400
SEED = 5
#: A longer run of letters is scored whole, but apart from the others, and teaches by its pieces of so many letters; up to FAR letters such runs are scored in step.
LONGEST, FAR = 40, 4096
#: Letters after which numbers that grow ever smaller are scaled.
SCALED = 16
#: Words whose scores a worker keeps; the memory is cleared beyond it.
MEMORY = 400_000
#: Probability of a letter that no piece covers.
UNKNOWN = 1e-7
_WORD = re.compile(r"[^\W\d_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Lower-cased maximal runs of letters, which are the characters of Unicode's category L."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # the pattern also takes number signs such as fractions and Roman numerals
    return [run for w in found for run in (w if w.isalpha() else "".join(c if c.isalpha() else " " for c in w)).split(" ") if run]


class Lattice:
    """Pieces by the hash of their letters: an open table of all prefixes of pieces."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        prefixes: dict[str, int] = {}
        for number, piece in enumerate(pieces):
            for n in range(1, len(piece)):
                prefixes.setdefault(piece[:n], -1)
            prefixes[piece] = number
        self.longest = max(map(len, pieces), default=1)
        keys = np.fromiter((self._hash(p) for p in prefixes), np.uint64, len(prefixes))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.fromiter(prefixes.values(), np.int64, len(prefixes))[order]
        self.bits = np.uint64(64 - 20)
        self.first = np.searchsorted(self.keys, np.arange(1 << 20, dtype=np.uint64) << self.bits)

    @staticmethod
    def _hash(piece: str) -> int:
        h = np.zeros(1, np.uint64)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * _MULTIPLIER + np.uint64(ord(c))
            return int(mix(h)[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """For each hash its piece, -1 if it only begins pieces, -2 if none begins so."""
        at = self.first[(h >> self.bits).astype(np.int64)]
        out = np.full(len(h), -2, np.int64)
        left = np.arange(len(h))
        last = len(self.keys) - 1
        while len(left):
            k = self.keys[np.minimum(at, last)]
            hit = k == h[left]
            out[left[hit]] = self.ids[at[hit]]
            on = (k < h[left]) & (at < last)
            left, at = left[on], at[on] + 1
        return out

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Nodes before each word and at its end, and groups of arcs (from, to, piece) in an order in which every arc into a node comes before those out of it.

        Within a group no two arcs share their end. Piece len(pieces) is the
        unknown letter.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        flat = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le"), np.uint32).astype(np.uint64)
        letters = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        nodes = letters + np.arange(len(words))  # a word of n letters has n + 1 nodes
        word = np.repeat(np.arange(len(words)), sizes)
        depth = np.arange(len(flat)) - letters[word]
        room = sizes[word] - depth
        node = nodes[word] + depth
        h = np.zeros(len(flat), np.uint64)
        live = keep = np.arange(len(flat))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        with np.errstate(over="ignore"):
            for n in range(1, self.longest + 1):
                enough = room[live] >= n
                live = live[enough]
                if not len(live):
                    break
                keep = keep[enough] if n > 1 else keep
                h = h[keep] if n > 1 else h
                h = h * _MULTIPLIER + flat[live + n - 1]
                piece = self.find(mix(h))
                if n == 1:
                    piece = np.where(piece < 0, np.where(piece == -1, -3, -4), piece)
                    known = np.where(piece < 0, len(self.pieces), piece)
                    found.append((live, np.full(len(live), n), known))
                    keep = np.flatnonzero(piece != -4)
                else:
                    whole = piece >= 0
                    found.append((live[whole], np.full(int(whole.sum()), n), piece[whole]))
                    keep = np.flatnonzero(piece > -2)
                live = live[keep]
        at, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        group = depth[at] * (self.longest + 1) + length
        order = np.argsort(group.astype(np.int16) if self.longest < 256 and len(group) and group.max() < 2**15 else group, kind="stable")
        at, length, piece, group = at[order], length[order], piece[order], group[order]
        cuts = np.flatnonzero(np.diff(group)) + 1
        start, end = node[at], node[at] + length
        return nodes, nodes + sizes, list(zip(np.split(start, cuts), np.split(end, cuts), np.split(piece, cuts), strict=True))


@dataclass
class Model:
    """Languages in order, and the probability of each piece (the last: the unknown letter) in each."""

    languages: list[str]
    pieces: list[str]
    table: np.ndarray

    def lattice(self) -> Lattice:
        if not hasattr(self, "_lattice"):
            self._lattice = Lattice(self.pieces)
        return self._lattice

    def score_long(self, word: str) -> np.ndarray:
        """score() of one word of any length, letter by letter, with a running factor instead of ever smaller numbers."""
        lattice = self.lattice()
        _, _, groups = lattice.arcs([word])
        start, end, piece = (np.concatenate(x) for x in zip(*groups, strict=True))
        order = np.argsort(start, kind="stable")
        end, piece = end[order], piece[order]
        n = len(word) + 1
        cut = np.searchsorted(start[order], np.arange(n + 1)).tolist()
        reach = lattice.longest + 1
        alpha, factor = np.zeros((n + 1 + reach, len(self.languages))), np.zeros(len(self.languages))
        alpha[0] = 1
        for i in range(n):
            arcs = slice(cut[i], cut[i + 1])
            alpha[end[arcs]] += alpha[i] * self.table[piece[arcs]]  # the arcs out of a node have different ends
            if i % 16 == 15:
                ahead = alpha[i + 1 : i + 1 + reach]
                most = ahead.max(axis=0)
                ahead /= most
                factor += np.log(most)
        return np.log(np.maximum(alpha[n], 1e-300)) + factor

    def score_far(self, words: list[str]) -> np.ndarray:
        """score() of long words: those up to FAR letters all in step, with a running factor for each, longer ones one by one."""
        out = np.zeros((len(words), len(self.languages)))
        near = [i for i, w in enumerate(words) if len(w) <= FAR]
        for i in sorted(set(range(len(words))) - set(near)):
            out[i] = self.score_long(words[i])
        if not near:
            return out
        lattice = self.lattice()
        nodes, ends, groups = lattice.arcs([words[i] for i in near])
        reach = np.arange(lattice.longest + 1)
        alpha, factor, scaled = np.zeros((int(ends[-1]) + 1, len(self.languages))), np.zeros((len(near), len(self.languages))), 0
        alpha[nodes] = 1
        for start, end, piece in groups:
            depth = int(start[0] - nodes[np.searchsorted(nodes, start[0], "right") - 1])
            if depth >= scaled + SCALED:
                # all arcs from nodes before this depth are in, and none has gone further than the longest piece
                live = np.flatnonzero(nodes + depth <= ends)
                at = nodes[live][:, None] + depth + reach[None, :]
                inside = at <= ends[live][:, None]
                ahead = alpha[np.minimum(at, ends[live][:, None])]
                most = np.maximum(np.where(inside[:, :, None], ahead, 0).max(axis=1), 1e-300)
                alpha[at[inside]] = (ahead / most[:, None, :])[inside]
                factor[live] += np.log(most)
                scaled = depth
            alpha[end] += alpha[start] * self.table[piece]
        out[near] = np.log(np.maximum(alpha[ends], 1e-300)) + factor
        return out

    def score(self, words: list[str]) -> np.ndarray:
        """The logarithm of each word's probability in each language, over all its segmentations."""
        far = [i for i, w in enumerate(words) if len(w) > LONGEST]
        if far:
            out = np.zeros((len(words), len(self.languages)))
            near = np.ones(len(words), bool)
            near[far] = False
            out[near] = self.score([w for w in words if len(w) <= LONGEST])
            out[far] = self.score_far([words[i] for i in far])
            return out
        if not words:
            return np.zeros((0, len(self.languages)))
        nodes, ends, groups = self.lattice().arcs(words)
        alpha = np.zeros((int(ends[-1]) + 1, len(self.languages)))
        alpha[nodes] = 1
        for start, end, piece in groups:
            alpha[end] += alpha[start] * self.table[piece]
        return np.log(np.maximum(alpha[ends], 1e-300))


def learn(counts: dict[str, Counter], pieces: list[str], rounds: int = 4, smooth: float = 0.02) -> Model:
    """Piece probabilities of each language by expectation maximisation over its word counts."""
    languages = sorted(counts)
    lattice = Lattice(pieces)
    n = len(pieces)
    table = np.full((n + 1, len(languages)), 1.0 / max(n, 1))
    table[n] = UNKNOWN
    for k, language in enumerate(languages):
        words = sorted(counts[language])
        if not words:
            continue
        times = np.array([counts[language][w] for w in words], float)
        nodes, ends, groups = lattice.arcs(words)
        owner = np.zeros(int(ends[-1]) + 1, np.int64)
        owner[nodes] = 1
        owner = np.cumsum(owner) - 1
        p = table[:, k].copy()
        for _ in range(rounds):
            alpha, beta = np.zeros(len(owner)), np.zeros(len(owner))
            alpha[nodes], beta[ends] = 1, 1
            for start, end, piece in groups:
                alpha[end] += alpha[start] * p[piece]
            for start, end, piece in reversed(groups):
                beta[start] += p[piece] * beta[end]
            weight = times / np.maximum(alpha[ends], 1e-300)
            expected = np.zeros(n + 1)
            for start, end, piece in groups:
                expected += np.bincount(piece, alpha[start] * p[piece] * beta[end] * weight[owner[start]], n + 1)
            p[:n] = (expected[:n] + smooth) / (expected[:n].sum() + smooth * n)
        table[:, k] = p
    return Model(languages, pieces, table)


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """The ordinary pieces of a sentencepiece model, byte and control pieces left out."""
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(held.get_piece_size())
    return [held.id_to_piece(i) for i in ids if not (held.is_control(i) or held.is_unknown(i) or held.is_byte(i))]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learn from at most ``per_language`` documents of each language, held-out ids and null languages left out.

    The words of the sample are counted in the cluster; the driver gets the
    distinct words of that bounded sample and their counts.
    """
    rows = docs.where(in_training(id_col) & F.col(lang_col).isNotNull())
    picked = least_by_hash(rows, lang_col, id_col, per_language, SEED)
    pieces = read_pieces(vocabulary)
    if not picked:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)))
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(w[i : i + LONGEST] for w in words_of(text or "") for i in range(0, len(w), LONGEST))
        out = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    sample = only_ids(rows, id_col, [i for i, _ in picked]).select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"))
    found = sample.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, Counter] = {str(lang): Counter() for _, lang in picked}
    for lang, word, n in zip(*(found.column(i).to_pylist() for i in range(3)), strict=True):
        counts[lang][word] = n
    return learn(counts, pieces)


class Scorer:
    """Scores texts and remembers the words met so far, up to MEMORY of them."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def texts(self, texts: list[bytes | None]) -> list[tuple[str, float, float]]:
        """(language, posterior, log-probability a letter) of each text; ``und`` if it has no letter or no language is known."""
        found = [words_of(t.decode("utf-8", "replace")) if t else [] for t in texts]
        if not self.model.languages:
            return [("und", 0.0, 0.0)] * len(found)
        far = sorted({w for words in found for w in words if len(w) > LONGEST})
        long = dict(zip(far, self.model.score_far(far), strict=True))
        if long:
            rest = [[w for w in words if len(w) <= LONGEST] for words in found]
            more = [sum((long[w] for w in words if len(w) > LONGEST), np.zeros(len(self.model.languages))) for words in found]
        else:
            rest, more = found, [0.0] * len(found)
        fresh = list(set().union(*rest).difference(self.known))
        if len(self.known) + len(fresh) > MEMORY:
            self.known, self.scores = {}, np.zeros((0, len(self.model.languages)))
            fresh = list(set().union(*rest))
        if fresh:
            fresh.sort(key=len)
            base = len(self.known)
            self.known.update(zip(fresh, range(base, base + len(fresh)), strict=True))
            parts = [self.model.score(fresh[i : i + 20_000]) for i in range(0, len(fresh), 20_000)]
            self._put(base, np.concatenate(parts))
        out = []
        for words, short, extra in zip(found, rest, more, strict=True):
            if not words:
                out.append(("und", 0.0, 0.0))
                continue
            at = np.fromiter(map(self.known.__getitem__, short), np.int64, len(short))
            total = self.scores[at].sum(axis=0) + extra
            best = int(total.argmax())
            share = float(1 / np.exp(total - total[best]).sum())
            out.append((self.model.languages[best], share, float(total[best]) / sum(map(len, words))))
        return out

    def _put(self, base: int, rows: np.ndarray) -> None:
        need = base + len(rows)
        if need > len(self.scores):
            grown = np.zeros((max(need, 2 * len(self.scores)), rows.shape[1]))
            grown[:base] = self.scores[:base]
            self.scores = grown
        self.scores[base:need] = rows


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, letter_logp) for every whole text.

    ``lang_pred`` is one of the model's languages, of equally likely ones the
    first in order, or ``und`` with score 0 if the text is null or has no
    letter. ``score`` is the posterior probability under equal priors. Rows that
    repeat, null ids and further columns make no difference to other rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: list[Scorer] = []

    def run(columns: list[pa.Array], texts: list[bytes | None]) -> list[pa.Array]:
        if not held:
            held.append(Scorer(shared.value))
        out = held[0].texts(texts)
        return [columns[0], *(pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64())))]

    kind = docs.schema[id_col].dataType.simpleString()
    return by_text(docs, [id_col], text_col, f"{id_col} {kind}, lang_pred string, score double, letter_logp double", run)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents whose language is recognised with a posterior of at least ``least``, all columns kept; null and letterless texts go.

    Rows are judged one by one: repeated rows and null ids share their text's
    fate, and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: list[Scorer] = []

    def run(texts: list[bytes | None]) -> tuple[list[bool], None]:
        if not held:
            held.append(Scorer(shared.value))
        return [lang != "und" and score >= least for lang, score, _ in held[0].texts(texts)], None

    return map_rows(docs, text_col, run)
