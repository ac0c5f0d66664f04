"""Secrets: fixed patterns, and a linear-chain conditional random field for what they miss.

The field tags each token as the begin of a secret, inside one or outside, from
its shape, its neighbours and features of the whole text, and is decoded by
Viterbi. It learns from the spans that the patterns find in a bounded sample of
documents and from lines made up by rule, which also show formats that the
patterns don't know.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeline.llm.arrow import by_text, map_rows
from lodeline.llm.kernels import LOWER, Block, hash_runs
from lodeline.llm.sampling import least_by_hash, only_ids

#: The patterns of the base, in the order of kinds, with the least length of the match or group that counts.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "crf")

#: Words before a value that speak for a secret, and beginnings of issued keys.
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "key", "auth", "authorization", "bearer", "credential", "private_key", "access_key", "access_token")
ISSUED = (b"AKIA", b"ghp_", b"sk-", b"sk_", b"xox", b"eyJ", b"AIza")
#: Documents from which the field learns, at most.
DOCS = 1500
SEED = 7
#: Tokens in a training window.
STEPS = 40
#: Training windows of a sampled text, at most: around its secrets, and from anywhere in it. More are drawn by a fixed seed.
AROUND, ANYWHERE = 20, 3

_MEMBER = np.zeros(256, bool)
_MEMBER[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-", *range(128, 256)]] = True
_CLASS = np.zeros(256, np.uint8)
for _bit, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b"+/_-", range(128, 256))):
    _CLASS[list(_bytes)] = 1 << _bit
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_keyword_hashes = np.sort(np.concatenate([hash_runs(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)])) for w in KEYWORDS]))


def base(text: bytes) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, value start, value end) in bytes, by start and then kind."""
    found = []
    if b"=" in text or b":" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                found.append(("assign", m.start(), m.end(), m.start(2), m.end(2)))
    if b"AKIA" in text:
        found += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a maximal run of at least n hex digits is what the pattern finds and the length keeps
    found += [("hex", *m.span(), *m.span()) for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_LONG_HEX = re.compile(rb"[0-9a-f]{%d,}" % LEAST["hex"])

#: Kinds of token features with their numbers of values; a token has one value of each.
SIZES = {"length": 8, "classes": 32, "digits": 5, "hex": 2, "switches": 4, "before": 4, "before2": 2, "after": 2, "quoted": 2, "issued": 2, "symbols": 4, "density": 4, "dot": 2}
OFFSETS = np.concatenate(([0], np.cumsum(list(SIZES.values()))[:-1]))
FEATURES = sum(SIZES.values())


@dataclass
class Tokens:
    """Tokens of a block: bytes, texts and, for each, the numbers of its features."""

    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    features: np.ndarray


def read(block: Block) -> Tokens:
    """Tokens are runs of ASCII letters, digits, +/_- and non-ASCII characters."""
    data = block.data
    starts, ends = block.runs(_MEMBER)
    n = len(starts)
    if not n:
        return Tokens(starts, ends, starts, np.zeros((len(SIZES), 0), np.int64))
    owner = block.owner(starts)
    length = ends - starts
    kind = _CLASS[data]

    def total(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.uint8), bounds, dtype=np.int32)[::2]

    bounds = np.stack((starts, ends), axis=1).ravel()
    if bounds[-1] == len(data):
        bounds = bounds[:-1]

    digits = total(kind == 4)
    classes = np.bitwise_or.reduceat(kind, bounds)[::2].astype(np.int64)
    switch = np.concatenate(([False], (kind[1:] == 4) != (kind[:-1] == 4)))
    switches = total(switch) - switch[starts]
    hexed = (total(_HEX[data]) == length) & (digits > 0) & (digits < length) & (length >= 8)
    word = hash_runs(LOWER[data], starts, ends)
    at = np.minimum(np.searchsorted(_keyword_hashes, word), len(_keyword_hashes) - 1)
    keyword = _keyword_hashes[at] == word
    same = np.concatenate(([False], owner[1:] == owner[:-1]))
    previous = np.concatenate(([False], keyword[:-1])) & same
    earlier = np.concatenate(([False, False], keyword[:-2]))[:n] & same & np.concatenate(([False], same[:-1]))
    after = np.concatenate((keyword[1:], [False])) & np.concatenate((same[1:], [False]))
    signs = np.concatenate(([0], np.cumsum((data == 61) | (data == 58))))
    gap = np.concatenate(([0], ends[:-1]))
    assigned = (signs[starts] > signs[np.where(same, gap, starts)])
    left = np.where(starts > 0, data[np.maximum(starts - 1, 0)], 10)
    four = np.zeros(n, bool)
    for prefix in ISSUED:
        hit = length > len(prefix) + 8
        for i, c in enumerate(prefix):
            hit[hit] = data[starts[hit] + i] == c
        four |= hit
    ranks = lambda x, *cuts: np.searchsorted(np.array(cuts), x, "right")
    size = np.maximum(block.ends - block.starts, 1)
    signs_all = np.concatenate(([0], np.cumsum((kind == 0) & (data > 32))))
    digits_all = np.concatenate(([0], np.cumsum(kind == 4)))
    symbols = ranks((signs_all[block.ends] - signs_all[block.starts]) / size, 0.03, 0.06, 0.12)[owner]
    density = ranks((digits_all[block.ends] - digits_all[block.starts]) / size, 0.01, 0.05, 0.2)[owner]
    values = (
        ranks(length, 4, 8, 12, 16, 20, 32, 40), classes, ranks(digits / length, 1e-9, 0.2, 0.5, 0.999), hexed, ranks(switches, 1, 3, 6),
        previous * 2 + assigned, earlier, after, (left == 34) | (left == 39), four, symbols, density, left == 46,
    )
    return Tokens(starts, ends, owner, np.stack([v.astype(np.int64) + o for v, o in zip(values, OFFSETS, strict=True)]))


OUT, BEGIN, IN = 0, 1, 2
_NEVER = -1e4
#: The longest stretches of a block are decoded one by one.
APART = 12
#: The features of Tokens.features in two groups; a token's values of a group are one row of a table of summed weights.
HALVES = (slice(0, 5), slice(5, len(SIZES)))


def _tables(weights: np.ndarray) -> list[np.ndarray]:
    """For each group of features the summed weights of every combination of their values."""
    out = []
    for half in HALVES:
        table = np.zeros((1, weights.shape[1]))
        for size, first in zip(list(SIZES.values())[half], OFFSETS[half], strict=True):
            table = (table[:, None, :] + weights[None, first : first + size, :]).reshape(-1, weights.shape[1])
        out.append(table)
    return out


@dataclass
class Model:
    """Weights of features by tag, and of one tag after another; outside to inside never happens, and texts begin and end outside."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """The score of each tag for each token."""
        if not hasattr(self, "_summed"):
            self._summed = _tables(self.weights)
        e = np.zeros((features.shape[1], 3))
        for half, table in zip(HALVES, self._summed, strict=True):
            code = np.zeros(features.shape[1], np.int64)
            for row, size, first in zip(features[half], list(SIZES.values())[half], OFFSETS[half], strict=True):
                code = code * size + (row - first)
            e += table[code]
        return e

    def _alone(self, e: np.ndarray) -> list[int]:
        """The tags of one stretch between outside tokens by the best path."""
        (a, b, c), (d, f, g), (h, i, j) = self.moves.tolist()
        x, y, z = 0.0, _NEVER, _NEVER
        back = []
        for p, q, r in e.tolist():
            x0, y0, z0 = x + a, y + d, z + h
            x1, y1, z1 = x + b, y + f, z + i
            x2, y2, z2 = x + c, y + g, z + j
            k0, x = (0, x0) if x0 >= y0 and x0 >= z0 else (1, y0) if y0 >= z0 else (2, z0)
            k1, y = (0, x1) if x1 >= y1 and x1 >= z1 else (1, y1) if y1 >= z1 else (2, z1)
            k2, z = (0, x2) if x2 >= y2 and x2 >= z2 else (1, y2) if y2 >= z2 else (2, z2)
            x, y, z = x + p, y + q, z + r
            back.append((k0, k1, k2))
        x, y, z = x + a, y + d, z + h
        now = 0 if x >= y and x >= z else 1 if y >= z else 2
        out = []
        for held in reversed(back):
            out.append(now)
            now = held[now]
        return out[::-1]

    def decode(self, tokens: Tokens) -> list[tuple[int, int]]:
        """Spans of tokens (first, last plus one) tagged as secrets by the best path.

        A token whose outside score leads by more than any two moves could make
        good is outside on every best path, so the stretches between such tokens
        are decoded apart, most of them in step.
        """
        n = tokens.features.shape[1]
        if not n:
            return []
        e = self.emissions(tokens.features)
        t = self.moves
        gain = max(t[a, y] + t[y, b] - t[a, OUT] - t[OUT, b] for y in (BEGIN, IN) for a in range(3) for b in range(3))
        open_ = e[:, OUT] - np.maximum(e[:, BEGIN], e[:, IN]) <= gain
        if not open_.any():
            return []
        fresh = open_ & ~np.concatenate(([False], open_[:-1] & (tokens.owner[1:] == tokens.owner[:-1])))
        first = np.flatnonzero(fresh)
        stop = np.flatnonzero(open_ & ~np.concatenate((open_[1:] & (tokens.owner[1:] == tokens.owner[:-1]), [False])))
        size = stop - first + 1
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        tag = np.zeros(n, np.int64)
        # in step only where many stretches go on; the few longest are decoded one by one
        for a, k in zip(first[:APART].tolist(), size[:APART].tolist(), strict=True):
            tag[a : a + k] = self._alone(e[a : a + k])
        first, size = first[APART:], size[APART:]
        score = np.full((len(first), 3), _NEVER)
        score[:, OUT] = 0
        back = []
        steps = int(size[0]) if len(size) else 0
        for step in range(steps):
            live = int(np.searchsorted(-size, -step, "left"))
            options = score[:live, :, None] + t[None]
            back.append(options.argmax(axis=1))
            score[:live] = options.max(axis=1) + e[first[:live] + step]
        now = (score + t[:, OUT]).argmax(axis=1)
        for step in range(steps - 1, -1, -1):
            live = len(back[step])
            tag[first[:live] + step] = now[:live]
            now[:live] = back[step][np.arange(live), now[:live]]
        begins = np.flatnonzero(tag == BEGIN)
        inside = tag == IN
        spans = []
        for b in begins:
            end = b + 1
            while end < n and inside[end] and tokens.owner[end] == tokens.owner[b]:
                end += 1
            spans.append((int(b), int(end)))
        return spans


def made_up(n: int = 500, seed: int = SEED) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Lines with secrets in many formats, and lines with look-alikes that are none, with the secrets' bytes."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    word = lambda: pick("abcdefghijklmnopqrstuvwxyz", r.randint(2, 11))
    out = []
    for i in range(n):
        before, after = " ".join(word() for _ in range(r.randint(0, 9))), " ".join(word() for _ in range(r.randint(0, 9)))
        kind = i % 10
        value = [
            pick("0123456789abcdef", r.choice((32, 40, 64))), "AKIA" + pick(letters[26:], 16), "ghp_" + pick(letters, 36), "sk-" + pick(letters, r.randint(24, 48)), pick(letters + "+/", r.randint(24, 60)),
            "eyJ" + pick(letters, 17) + "." + pick(letters, 30) + "." + pick(letters + "_-", 27), "xoxb-" + pick("0123456789", 12) + "-" + pick(letters, 24), word() + pick("0123456789", 4) if i % 20 < 10 else f"{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}", f"{word()}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", f"+1 ({pick('0123456789', 3)}) 555-{pick('0123456789', 4)}" if i % 20 < 10 else pick("0123456789", r.choice((8, 10, 16))),
        ][kind]
        secret = kind < 7
        lead = r.choice(("password", "secret", "token", "api_key", "auth", "bearer", "key")) + r.choice((" = ", ": ", "=", " : ", " ")) + r.choice(('"', "'", "")) if secret and (r.random() < 0.7 or kind in (0, 4)) else ""
        text = f"{before} {lead}".lstrip() if before else lead
        line = text + value + ('"' if lead.endswith('"') else "'" if lead.endswith("'") else "") + (" " + after if after else "")
        start = len(text.encode())
        out.append((line.encode(), [(start, start + len(value.encode()))] if secret else []))
    return out


def windows(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training windows (features, tags) of one text: around its secrets, and its first tokens."""
    tokens = read(Block([text]))
    n = len(tokens.starts)
    tag = np.zeros(n, np.int64)
    for a, b in spans:
        own = np.flatnonzero((tokens.starts >= a) & (tokens.ends <= b))
        tag[own], tag[own[:1]] = IN, BEGIN
    at = {max(0, int(i) - STEPS // 2) for i in np.flatnonzero(tag == BEGIN)} | ({0} if n else set())
    return [(tokens.features[:, a : a + STEPS], tag[a : a + STEPS]) for a in sorted(at)]


def drawn_windows(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training windows of a text drawn over the whole of it: at most AROUND around its secrets and ANYWHERE of all."""
    r = random.Random(SEED)
    tokens = read(Block([text]))
    n = len(tokens.starts)
    tag = np.zeros(n, np.int64)
    for a, b in spans:
        own = np.flatnonzero((tokens.starts >= a) & (tokens.ends <= b))
        tag[own], tag[own[:1]] = IN, BEGIN
    around = sorted({max(0, int(i) - STEPS // 2) for i in np.flatnonzero(tag == BEGIN)})
    tiles = range(0, n, STEPS)
    at = set(r.sample(around, min(AROUND, len(around)))) | set(r.sample(tiles, min(ANYWHERE, len(tiles))))
    return [(tokens.features[:, a : a + STEPS], tag[a : a + STEPS]) for a in sorted(at)]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Maximise the likelihood of the windows' tags by Adam; forward-backward runs over all windows in step."""
    n = len(rows)
    weights, moves = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    moves[OUT, IN] = _NEVER
    if not n:
        weights[:, OUT] = 1
        return Model(weights, moves)
    x = np.full((STEPS, len(SIZES), n), FEATURES, np.int64)
    y = np.zeros((STEPS, n), np.int64)
    live = np.zeros((STEPS, n), bool)
    for i, (features, tag) in enumerate(rows):
        k = features.shape[1]
        x[:k, :, i], y[:k, i], live[:k, i] = features.T, tag, True
    theta = np.zeros(FEATURES * 3 + 9)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    free = np.ones((3, 3))
    free[OUT, IN] = 0
    for step in range(1, rounds + 1):
        w = np.vstack((theta[: FEATURES * 3].reshape(-1, 3), np.zeros(3)))
        t = theta[FEATURES * 3 :].reshape(3, 3) * free + _NEVER * (1 - free)
        e = w[x].sum(axis=1)  # steps, windows, tags
        big, back = np.exp(np.clip(e - e.max(axis=2, keepdims=True), -50, 0)), np.zeros((STEPS + 1, n, 3))
        move = np.exp(t)
        ahead = np.zeros((STEPS, n, 3))
        state = np.zeros((n, 3))
        state[:, OUT] = 1
        for s in range(STEPS):
            fresh = (state @ move) * big[s]
            fresh /= np.maximum(fresh.sum(axis=1, keepdims=True), 1e-300)
            state = np.where(live[s][:, None], fresh, state)
            ahead[s] = state
        # behind a window everything may follow, so that a cut secret is no evidence
        back[STEPS] = 1
        for s in range(STEPS - 1, -1, -1):
            fresh = (big[s] * back[s + 1]) @ move.T
            fresh /= np.maximum(fresh.sum(axis=1, keepdims=True), 1e-300)
            back[s] = np.where(live[s][:, None], fresh, back[s + 1])
        p = ahead * back[1:]
        p /= np.maximum(p.sum(axis=2, keepdims=True), 1e-300)
        gap = (p - (y[:, :, None] == np.arange(3))) * live[:, :, None]
        grad_w = np.stack([np.bincount(x.transpose(0, 2, 1).ravel(), np.repeat(gap[:, :, k].ravel(), len(SIZES)), FEATURES + 1)[:FEATURES] for k in range(3)], axis=1)
        grad_t = np.zeros((3, 3))
        state = np.zeros((n, 3))
        state[:, OUT] = 1
        last = np.zeros(n, np.int64)
        for s in range(STEPS):
            joint = state[:, :, None] * move[None] * (big[s] * back[s + 1])[:, None, :]
            joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
            grad_t += joint[live[s]].sum(axis=0)
            np.subtract.at(grad_t, (last[live[s]], y[s][live[s]]), 1)
            state, last = ahead[s], np.where(live[s], y[s], last)
        grad = np.concatenate((grad_w.ravel(), (grad_t * free).ravel())) / n + decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    moves = theta[FEATURES * 3 :].reshape(3, 3) * free + _NEVER * (1 - free)
    return Model(theta[: FEATURES * 3].reshape(-1, 3), moves)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = DOCS) -> Model:
    """Learn from the patterns' spans in at most ``most`` documents, drawn by the hash of their ids, and from made-up lines.

    Of each sampled text the driver gets the windows of drawn_windows(), as
    feature numbers.
    """
    picked = least_by_hash(docs.select(id_col).withColumn("__one", F.lit(1)), "__one", id_col, most, SEED)

    def run(columns: list[pa.Array], texts: list[bytes | None]) -> list[pa.Array]:
        ids, features, tags = [], [], []
        for i, t in enumerate(texts):
            for f, tag in drawn_windows(t or b"", [(a, b) for _, _, _, a, b in base(t or b"")]):
                ids.append(i)
                features.append(f.astype(np.int16).tobytes())
                tags.append(tag.astype(np.int8).tobytes())
        return [columns[0].take(pa.array(ids, pa.int64())), pa.array(features, pa.binary()), pa.array(tags, pa.binary())]

    kind = docs.schema[id_col].dataType.simpleString()
    found = by_text(only_ids(docs, id_col, [i for i, _ in picked]), [id_col], text_col, f"{id_col} {kind}, x binary, y binary", run).toArrow()
    held = sorted(zip(*(found.column(c).to_pylist() for c in (1, 2)), strict=True))
    rows = [(np.frombuffer(x, np.int16).reshape(len(SIZES), -1).astype(np.int64), np.frombuffer(y, np.int8).astype(np.int64)) for x, y in held]
    for line, spans in made_up():
        rows += windows(line, spans)
    return fit(rows)


def uncovered(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches of a run of tokens between spans (sorted by start), from the first to the last byte of tokens that no span covers."""
    last = int(ends[-1])
    out, at = [], int(starts[0])
    for a, b in [*spans, (last, last)]:
        if a > at:
            # the tokens that reach into the stretch from at to a
            i, j = int(np.searchsorted(ends, at, "right")), int(np.searchsorted(starts, a, "left"))
            if i < j:
                out.append((max(int(starts[i]), at), min(int(ends[j - 1]), a)))
        at = max(at, b)
    return out


def _found(texts: list[bytes | None], model: Model) -> tuple[Block, list[list[tuple[str, int, int, int, int]]]]:
    """The texts' block and what find() returns; each text's spans are passed once."""
    block = Block(texts)
    found = [base(t or b"") for t in texts]
    # the end of the furthest span so far: once it lies before a token, so do all spans up to here
    reaches = [np.maximum.accumulate([x[2] for x in f]).tolist() if f else [] for f in found]
    tokens = read(block)
    fields: list[list[tuple[str, int, int, int, int]]] = [[] for _ in texts]
    last, passed = -1, 0
    for a, b in model.decode(tokens):
        i = int(tokens.owner[a])
        if i != last:
            last, passed = i, 0
        own, starts, ends = found[i], tokens.starts[a:b] - block.starts[i], tokens.ends[a:b] - block.starts[i]
        while passed < len(own) and reaches[i][passed] <= starts[0]:
            passed += 1
        reach = passed
        while reach < len(own) and own[reach][1] < ends[-1]:
            reach += 1
        fields[i] += [("crf", x, y, x, y) for x, y in uncovered(starts, ends, [(x, y) for _, x, y, _, _ in own[passed:reach]])]
    return block, [sorted(f + g, key=lambda x: (x[1], KINDS.index(x[0]))) if g else f for f, g in zip(found, fields, strict=True)]


def find(texts: list[bytes | None], model: Model) -> list[list[tuple[str, int, int, int, int]]]:
    """For each text all spans (kind, start, end, value start, value end) in bytes, by start and then kind: the patterns', and of the field's what those don't cover."""
    return _found(texts, model)[1]


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, n_crf, base_spans, spans) for every whole text.

    Spans read kind:start:end in code points, end exclusive, joined by commas in
    the order of starts and then kinds; ``base_spans`` has the patterns' alone. A
    null text counts as empty and has none. Rows are scanned one by one;
    repeats, null ids and further columns make no difference.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: list[pa.Array], texts: list[bytes | None]) -> list[pa.Array]:
        block, found = _found(texts, shared.value)
        said: list[list[tuple[str, str]]] = [[] for _ in texts]
        points = block.code_points()
        for i, f in enumerate(found):
            first = block.starts[i] if f else 0
            said[i] = [(k, f"{k}:{points[first + a] - points[first]}:{points[first + b] - points[first]}") for k, a, b, _, _ in f]
        counts = [pa.array([sum(k == kind for k, *_ in f) for f in found], pa.int64()) for kind in KINDS]
        plain = pa.array([",".join(s for k, s in x if k != "crf") for x in said], pa.string())
        return [columns[0], *counts, plain, pa.array([",".join(s for _, s in x) for x in said], pa.string())]

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_crf bigint, base_spans string, spans string"
    return by_text(docs, [id_col], text_col, schema, run)


def digest(spans: str) -> str:
    """The lowercase hex SHA-256 of joined spans."""
    return hashlib.sha256(spans.encode()).hexdigest()


def redact(docs: DataFrame, model: Model, text_col: str = "text", mark: bytes = b"[SECRET]") -> DataFrame:
    """The documents with the value of every secret replaced by ``mark``, all columns and rows kept.

    Null stays null and empty texts empty; rows that repeat are treated alike, an
    empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[bytes | None]) -> tuple[None, list[bytes | None]]:
        out: list[bytes | None] = []
        for t, found in zip(texts, find(texts, shared.value), strict=True):
            if found:
                parts, at = [], 0
                for a, b in sorted((a, b) for *_, a, b in found):
                    if b > at:
                        parts += [t[at : max(a, at)], mark] if a >= at else []
                        at = b
                t = b"".join([*parts, t[at:]])
            out.append(t)
        return None, out

    return map_rows(docs, text_col, run)
