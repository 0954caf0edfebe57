"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

Strings are words with their borders marked, freed of inner punctuation (i.d.i.o.t is read as idiot), runs of
single letters (i d i o t) as one word more, and some neighbouring words joined: two short ones that aren't both
common (id iot), and those of which one belongs to a learned phrase. The kernel counts common subsequences of ORDERS
letters whose gaps are bounded, each weighted by DECAY for every letter skipped, so an inserted or dropped
character costs a little and not everything.

Training: sentences carry the label of their document, and each toxic document holds at least one word that
made it so. Which words these are is found by turns: train, then take the words of toxic documents that
score highest as the next positives (a multiple-instance machine). Toxic documents that no word explains may
hold a phrase: neighbouring words that stand together in several of them and in hardly a clean one, whatever
each means alone. The kernel is approximated on LANDMARKS
words; as it is a sum over subsequences, the trained machine is written out as one weight for each
subsequence, so scoring a word needs no landmark. A text's score is a logistic function of its highest
word, fitted on labelled documents kept out of the training.

Only texts enter a score. The model is fitted on a bounded sample of labelled rows, those with the smallest
seeded hash: SAMPLE rows of each class at most, and SAMPLE_CHARS characters of each class.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm._text import NOT_SPACE, Words, give_back, shingle_sets, texts
from chronoloom.llm.neardup import embedding

ORDERS, SPAN, DECAY = (3, 4), 6, 0.5
LANDMARKS, COST, ROUNDS = 480, 4.0, 4
SOFT = 8.0
EVIDENCE = 2.0  # how much oftener in other toxic documents a run of a word's letters must stand, as count times log odds
SAMPLE, SAMPLE_CHARS = 3_000, 12_000_000
PIECE = 5  # letters of a word that may be a piece of a split one
PHRASE = 3  # toxic documents without an insulting word in which a phrase must stand to be learned
THRESHOLD = 0.3
LONGEST = 32  # letters of a word scored at once; longer words are scored in overlapping parts
JOINED = 20  # characters up to which a string with inner punctuation or digits is read as one word alone
_BITS = 21
_SHAPES = [(n, offs, DECAY ** (offs[-1] - n + 1)) for n in ORDERS for rest in combinations(range(1, SPAN), n - 1) for offs in [(0, *rest)]]
_MULT = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]

# Characters often written for letters.
_ALIKE = str.maketrans("013457@$", "oieastas")
_NOT_LETTER = re.compile(r"[\W_]+")
_KEY = re.compile(r"(?=[a-f]*[0-9])[0-9a-f]{16,}")


def normal(word: str) -> list[str]:
    """What is scored of a string: lower case, borders stripped, look-alikes inside read as letters, inner punctuation out.

    A string of more than JOINED characters with punctuation inside, which may be a whole sentence, gives its runs
    of letters and all of them joined. Only keys and hashes, 16 hexadecimal digits or more, are no words.
    """
    word = word.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    if word.isalpha():
        return [word]
    if not any(c.isalpha() for c in word):  # numbers aren't disguised words
        return []
    if len(word) <= JOINED:
        return [_NOT_LETTER.sub("", word.translate(_ALIKE))]
    runs = [r for r in _NOT_LETTER.split(_KEY.sub(" ", word).translate(_ALIKE)) if any(c.isalpha() for c in r)]
    return list(dict.fromkeys([r for r in runs if len(r) > 1] + (["".join(runs)] if len(runs) > 1 else [])))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as small numbers, 0 at both borders; and where each word starts."""
    flat = np.frombuffer(("\0" + "\0\0".join(words) + "\0").encode("utf-32-le", "replace"), dtype=np.uint32)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    return flat, np.concatenate([[0], np.cumsum(lengths)])


def _features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape: the feature at each letter, whether it lies in one word, and its weight."""
    flat, at = _codes(words)
    room = np.repeat(at[1:], np.diff(at)) - np.arange(len(flat))  # letters left in the word, this one included
    padded = np.concatenate([flat, np.zeros(SPAN, np.uint32)])
    for n, offs, weight in _SHAPES:
        h = np.full(len(flat), n * 0x51ED27, dtype=np.uint32)
        for i, o in enumerate(offs):
            h = (h ^ padded[o : o + len(flat)]) * _MULT[i]
            h ^= h >> np.uint32(15)
        yield h & np.uint32((1 << _BITS) - 1), room > offs[-1], weight


def _norms(words: list[str]) -> np.ndarray:
    """Root of the sum of squared weights of a word's subsequences and SOFT, which keeps very short words small."""
    longest = LONGEST + 3
    table = np.full(longest, SOFT)
    for _, offs, weight in _SHAPES:
        table += weight**2 * np.maximum(np.arange(longest) - offs[-1], 0)
    return np.sqrt(table[np.fromiter((min(len(w), LONGEST) + 2 for w in words), dtype=np.int64, count=len(words))])


def parts(word: str) -> list[str]:
    """A word, or overlapping parts of a longer one."""
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - SPAN, LONGEST - SPAN)]


@dataclass
class Model:
    weights: np.ndarray  # by hashed subsequence
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    common: frozenset[str] = field(default_factory=frozenset)  # short words of clean documents, no pieces of split ones
    halves: frozenset[str] = field(default_factory=frozenset)  # words of learned phrases

    def margins(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word of at most LONGEST letters."""
        if not words:
            return np.zeros(0)
        _, at = _codes(words)
        total = np.zeros(at[-1], dtype=np.float64)
        for feature, valid, weight in _features(words):
            total += self.weights[feature] * (valid * weight)
        return np.add.reduceat(total, at[:-1]) / _norms(words) + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def word_list(text: str) -> set[str]:
    """The strings of a text that are scored."""
    raw = [normal(w) for w in text.split()]
    out = {sys.intern(p) for found in raw for w in found if len(w) > 1 for p in parts(w)}  # documents share most of their words
    for run in _single_runs(raw):
        out.update(parts(run))
    return out


def _single_runs(words: list[list[str]]) -> Iterator[str]:
    """Letters that stand by themselves, three or more in a row, joined. Strings without letters between them don't count."""
    run: list[str] = []
    for found in [*words, ["  "]]:
        if len(found) == 1 and len(found[0]) == 1:
            run.append(found[0])
        elif found:
            if len(run) >= 3:
                yield "".join(run)
            run = []


def may_join(a: str, b: str, common: frozenset[str] | set[str], halves: frozenset[str] | set[str]) -> bool:
    """Whether two neighbouring words are scored as one as well."""
    split = len(a) <= PIECE and len(b) <= PIECE and len(a) + len(b) >= 4 and not (a in common and b in common)
    return split or a in halves or b in halves


def _neighbours(text: str) -> Iterator[tuple[str, str]]:
    """Neighbouring words of a text, strings without letters between them left out; a string of several words has none."""
    found = [w for w in map(normal, text.split()) if w]
    for a, b in zip(found, found[1:], strict=False):
        if len(a) == len(b) == 1:
            yield a[0], b[0]


def joined(text: str, common: frozenset[str] | set[str], halves: frozenset[str] | set[str]) -> set[str]:
    """The neighbouring words of a text that are scored joined, in parts where they are long."""
    return {p for a, b in set(_neighbours(text)) if may_join(a, b, common, halves) for p in parts(a + b)}


def _phrases(unexplained: list[str], clean: list[str]) -> dict[tuple[str, str], int]:
    """Neighbouring words by how many unexplained toxic texts hold them, where these are PHRASE at least and far more than clean ones."""
    toxic = Counter(pair for text in unexplained for pair in set(_neighbours(text)) if pair[0] != pair[1])
    often = {pair: n for pair, n in toxic.items() if n >= PHRASE}
    if not often:
        return {}
    calm = Counter(pair for text in clean for pair in set(_neighbours(text)) if pair in often)
    a, b = len(unexplained) + 1, len(clean) + 1
    return {pair: n for pair, n in often.items() if (n - 1) * (np.log((n - 0.9) / a) - np.log((calm[pair] + 0.5) / b)) >= EVIDENCE * PHRASE and calm[pair] * a < n * b / 10}


def _kernel_features(words: list[str], columns: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums over each word's subsequences of their landmark rows, over the word's norm: the kernel with every landmark."""
    _, at = _codes(words)
    owner = np.repeat(np.arange(len(words)), np.diff(at))
    out = np.zeros((len(words), rows.shape[1]))
    for feature, valid, weight in _features(words):
        place = np.searchsorted(columns, feature)
        place[place == len(columns)] = 0
        hit = np.flatnonzero(valid & (columns[place] == feature))
        if len(hit):
            own, first = np.unique(owner[hit], return_index=True)
            out[own] += weight * np.add.reduceat(rows[place[hit]], first)
    return out / _norms(words)[:, None]


def _landmark_table(marks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    _, at = _codes(marks)
    owner = np.repeat(np.arange(len(marks)), np.diff(at))
    found = [(f[v], owner[v], np.full(v.sum(), w)) for f, v, w in _features(marks)]
    feature, of, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    columns, place = np.unique(feature, return_inverse=True)
    rows = np.zeros((len(columns), len(marks)))
    np.add.at(rows, (place, of), weight)
    return columns, rows / _norms(marks)[None, :]


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3

    def loss(v):
        return 0.5 * (ridge * v * v).sum() + cost * (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()

    for _ in range(30):
        slack = 1 - y * (x @ w)
        a = slack > 0
        grad = ridge * w - 2 * cost * ((weight * y * slack)[a] @ x[a])
        hess = np.diag(ridge) + 2 * cost * (x[a] * weight[a, None]).T @ x[a]
        step = np.linalg.solve(hess, grad)
        rate, now = 1.0, loss(w)
        while loss(w - rate * step) > now and rate > 1e-4:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train_words(positive: dict[str, int], negative: dict[str, int], hard: list[str] = (), seed: int = 0) -> Model:
    """The kernel machine for words and how many documents chose them, and other words and how many hold them.

    A word weighs as the root of its documents, so that neither class's common words are given up for rare ones.

    hard: negatives, the hardest first; they are the first of the landmarks.
    """
    counts, others = (np.sqrt(np.array(list(x.values()), dtype=np.float64)) for x in (positive, negative))
    positive, negative = list(positive), list(negative)
    rng = np.random.default_rng(seed)
    third = LANDMARKS // 3
    pick = lambda words, n: [words[i] for i in sorted(rng.choice(len(words), min(n, len(words)), replace=False))]
    marks = list(dict.fromkeys(pick(positive, third) + list(hard[:third]) + pick(negative, third)))
    columns, rows = _landmark_table(marks)
    gram = _kernel_features(marks, columns, rows)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    words = positive + negative
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    weight = np.concatenate([3.0 * counts, others])
    x = np.vstack([(_kernel_features(words[i : i + 500], columns, rows) @ root).astype(np.float32) for i in range(0, len(words), 500)])
    w, bias = _machine(x, y, weight, COST)
    weights = np.zeros(1 << _BITS, dtype=np.float32)
    weights[columns] = rows @ (root @ w)
    return Model(weights, bias)


def _first_guess(toxic: list[tuple[str, ...]], clean: list[tuple[str, ...]]) -> dict[str, float]:
    """Words of toxic documents by how much more often their best run of five letters stands in other toxic documents."""

    def grams(words):
        return {g for w in words for b in [f"^{w}$"] for i in range(max(1, len(b) - 4)) for g in [b[i : i + 5]]}

    t, n = Counter(), Counter()
    for words in toxic:
        t.update(grams(words))
    for words in clean:
        n.update(grams(words))
    a, b = len(toxic) + 1, len(clean) + 1
    gain = {g: (c - 1) * max(0.0, np.log((c - 0.9) / a) - np.log((n[g] + 0.5) / b)) for g, c in t.items()}
    return {w: max(gain[g] for g in grams([w])) for words in toxic for w in words}


def distinct(documents: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The documents without later near copies, whose shared words would count as often as they are copied."""
    seen: dict[int, set[int]] = {0: set(), 1: set()}
    out = []
    for text, y in documents:
        for _, shingles in shingle_sets(pa.array([text], pa.large_string())):
            marks = embedding(shingles)[:16].astype(np.int64) * 16 + np.arange(16) if len(shingles) else np.zeros(0, np.int64)
            known = seen[int(y == 1)]
            if sum(m in known for m in marks.tolist()) < 4:
                out.append((text, y))
            known.update(marks.tolist())
    return out


def train(documents: list[tuple[str, int]], seed: int = 0) -> Model:
    """A model from whole texts and their labels; a constant one where a class is missing."""
    said = distinct(documents)
    bags = [(tuple(sorted(word_list(text))), y) for text, y in said]
    rng = np.random.default_rng(seed)
    held = rng.random(len(bags)) < 0.2
    toxic_texts = [text for (text, _), (b, y), h in zip(said, bags, held, strict=True) if y == 1 and b and not h]
    clean_texts = [text for (text, y), h in zip(said, held, strict=True) if y != 1 and not h]
    toxic = [b for (b, y), h in zip(bags, held, strict=True) if y == 1 and b and not h]
    clean = [b for (b, y), h in zip(bags, held, strict=True) if y != 1 and not h]
    share = (sum(y == 1 for _, y in bags) + 0.5) / (len(bags) + 5)
    plain = Model(np.zeros(1 << _BITS, dtype=np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    if len(toxic) < 2 or not any(clean):
        return plain
    known = Counter(w for words in clean for w in words)
    ordinary = sorted(known)
    common = [w for w, _ in known.most_common(1_500)]
    strange = [[w for w in b if w not in known] or list(b) for b in toxic]
    guess = _first_guess(toxic, clean)
    # Each toxic document's words, chosen by a machine that hasn't seen that document, so that words which
    # only happen to stand there aren't learned by heart.
    chosen = [[w for w in sorted(words, key=lambda w: (-guess[w], w))[:3] if guess[w] >= EVIDENCE] for words in strange]
    phrases: dict[tuple[str, str], int] = {}
    if not any(chosen):
        phrases = _phrases(toxic_texts, clean_texts)
        if not phrases:
            return plain
    hard: list[str] = []
    joins: Counter = Counter()  # clean documents' words that are scored joined

    def values(model: Model, words: list[str]) -> np.ndarray:
        return np.concatenate([model.margins(words[i : i + 20_000]) for i in range(0, len(words), 20_000)] or [np.zeros(0)])

    def gapped(words: list[str]) -> list[str]:
        """Each word twice with a letter put in, as writers do who evade word lists."""
        return [w[:i] + "aeioulrnstxzqwy"[rng.integers(15)] + w[i:] for w in words for i in rng.integers(2, max(3, len(w) - 1), 2).tolist()]

    def machine(of: list[list[str]], variants: bool = False) -> Model:
        best = dict(Counter(w for words in of for w in words).most_common(2_000))
        best |= {p: n for (a, b), n in phrases.items() for p in parts(a + b)}
        if variants:
            best = {w: 1 for w in gapped(list(best)) if w not in known and w not in joins} | best
        easy = [ordinary[i] for i in sorted(rng.choice(len(ordinary), min(3_000, len(ordinary)), replace=False))]
        seen = known | joins if joins else known
        return train_words(best, {w: seen[w] for w in sorted({*easy, *common, *hard})}, hard, seed)

    for _ in range(ROUNDS if any(chosen) else 0):
        models = []
        for fold in (0, 1):
            seen = [words for i, words in enumerate(chosen) if i % 2 != fold]
            models.append(machine(seen if any(seen) else chosen))
        for fold, model in enumerate(models):
            flat = sorted({w for words in strange[fold::2] for w in words})
            value = dict(zip(flat, values(model, flat).tolist(), strict=True))
            for i in range(fold, len(strange), 2):
                chosen[i] = [w for w in sorted(strange[i], key=lambda w: (-value[w], w))[:8] if value[w] > 0.2 and guess[w] >= EVIDENCE]
        if not any(chosen):
            break
        worst = np.maximum(values(models[0], ordinary), values(models[1], ordinary))
        hard = list(dict.fromkeys([ordinary[i] for i in np.argsort(-worst, kind="stable")[:1_500]] + hard))[:5_000]
    phrases = _phrases([text for text, words in zip(toxic_texts, chosen, strict=True) if not words], clean_texts)
    if not any(chosen) and not phrases:
        return plain
    # Clean documents' joined words are told apart as their words are.
    pieces = frozenset(w for w, n in known.items() if n >= 2 and len(w) <= PIECE)
    halves = frozenset(w for pair in phrases for w in pair)
    for text in clean_texts:
        joins.update(joined(text, pieces, halves) - known.keys())
    strings = sorted(joins)
    worst = values(machine(chosen), strings)
    hard = list(dict.fromkeys(hard + [strings[i] for i in np.argsort(-worst, kind="stable")[:1_500]]))  # words stay the landmarks
    model = machine(chosen, variants=True)
    model.common, model.halves = pieces, halves
    # The logistic function: on documents kept out, and those trained on where they are too few.
    bags = [((*b, *joined(text, pieces, halves)), y) for (text, _), (b, y) in zip(said, bags, strict=True)]
    calibration = [(b, y) for (b, y), h in zip(bags, held, strict=True) if h]
    if len({y for _, y in calibration}) < 2 or sum(y == 1 for _, y in calibration) < 5:
        calibration = bags
    top = np.array([max(model.margins(list(b)), default=-2.0) if b else -2.0 for b, _ in calibration])
    y = np.array([float(y == 1) for _, y in calibration])
    model.slope, model.offset = _logistic(np.clip(top, -3, 3), y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset with smoothed targets and a small ridge, by Newton steps."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.array([1.0, 0.0])
    z = np.column_stack([x, np.ones(len(x))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - target) + 1e-3 * w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + 1e-3 * np.eye(2), grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def sampled(docs: DataFrame, known: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, text, toxic of the bounded sample. known: _id, toxic (0 or 1) of the rows that may be learned from.

    Ids and lengths are sampled first; only the texts of the sample are read.
    """
    chosen: list[tuple[int, int]] = []
    sized = docs.filter("text IS NOT NULL").select("doc_id", F.char_length("text").alias("size")).join(known, F.col("doc_id") == F.col("_id"))
    for label in (1, 0):
        left = SAMPLE_CHARS
        for row in sized.filter(F.col("toxic") == label).select("doc_id", "size").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(SAMPLE).collect():
            if row.size <= left:
                left -= row.size
                chosen.append((row.doc_id, label))
    ids = docs.sparkSession.createDataFrame(chosen, "_id long, toxic int").dropDuplicates(["_id"])
    return docs.filter("text IS NOT NULL").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")


TRAINED = "weights binary, bias double, slope double, offset double, common array<string>, halves array<string>"


def _train_task(seed: int):
    """Trains on all rows of a partition, the bounded sample, and gives the model as a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents: list[tuple[str, int]] = []
        for b in batches:
            documents += zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True)
        m = train(documents, seed)
        documents.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias]), pa.array([m.slope]), pa.array([m.offset]), *[pa.array([sorted(w)], pa.list_(pa.string())) for w in (m.common, m.halves)]], names=["weights", "bias", "slope", "offset", "common", "halves"])

    return run


def _tops(model: Model, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The highest margin of each text."""
    words = Words(data, bounds, NOT_SPACE)
    n = len(bounds) - 1
    out = np.full(n, -2.0)
    if len(words.hashes) == 0:
        return out
    _, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
    raw = [normal(data[s:e].tobytes().decode("utf-8", "replace")) for s, e in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
    strings, owner = [], []
    for i, found in enumerate(raw):
        for w in found:
            if len(w) > 1:
                for p in parts(w):
                    strings.append(p)
                    owner.append(i)
    value = np.full(len(raw), -2.0)
    for i in range(0, len(strings), 50_000):
        np.maximum.at(value, owner[i : i + 50_000], model.margins(strings[i : i + 50_000]))
    each = value[back]
    full = np.flatnonzero(words.of[1:] > words.of[:-1])
    out[full] = np.maximum.reduceat(each, words.of[full])
    # Neighbouring words that are scored joined, whatever without letters stands between them.
    said = np.flatnonzero(np.array([len(found) > 0 for found in raw])[back])
    of = np.searchsorted(words.of, said, side="right") - 1
    alone = np.array([found[0] if len(found) == 1 else "" for found in raw], dtype=object)
    size = np.array([len(w) for w in alone])
    short, half = (size > 0) & (size <= PIECE), np.array([w in model.halves for w in alone], dtype=bool)
    rare = short & ~np.array([w in model.common for w in alone], dtype=bool)
    a, b = back[said[:-1]], back[said[1:]]
    pair = np.flatnonzero((of[:-1] == of[1:]) & (size[a] > 0) & (size[b] > 0) & (short[a] & short[b] & (rare[a] | rare[b]) & (size[a] + size[b] >= 4) | half[a] | half[b]))
    both, at = np.unique(a[pair].astype(np.int64) * len(raw) + b[pair], return_inverse=True)
    for i in range(0, len(both), 50_000):
        strings, owner = [], []
        for j, code in enumerate(both[i : i + 50_000].tolist()):
            for p in parts(alone[code // len(raw)] + alone[code % len(raw)]):
                strings.append(p)
                owner.append(j)
        best = np.full(min(50_000, len(both) - i), -2.0)
        np.maximum.at(best, owner, model.margins(strings))
        here = np.flatnonzero((at >= i) & (at < i + 50_000))
        np.maximum.at(out, of[pair[here]], best[at[here] - i])
    # Runs of at least three single letters.
    single = np.array([len(found) == 1 and len(found[0]) == 1 for found in raw])[back][said]
    for doc in np.unique(np.searchsorted(words.of, said[np.flatnonzero(single[:-2] & single[1:-1] & single[2:])], side="right") - 1).tolist():
        a, b = words.of[doc], words.of[doc + 1]
        runs = [p for run in _single_runs([raw[j] for j in back[a:b]]) for p in parts(run)]
        if runs:
            out[doc] = max(out[doc], model.margins(runs).max())
    return out


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from THRESHOLD on). Null, empty and wordless texts get the lowest score.

    Whole texts are read. Repeated rows get equal scores, an empty table gives an empty one; other columns are
    kept as they are, those called score and predicted replaced.
    """
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, bounds in texts(b.column(at)):
                part = b.slice(row, len(bounds) - 1)
                score = sent.value.probability(np.clip(_tops(sent.value, data, bounds), -3, 3))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])
        give_back()

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def held_out(key):
    """Rows whose labels are never learned: crc32 of the key as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fitted(docs: DataFrame, labels: DataFrame, seed: int = 0) -> Model:
    """Trains on the labelled rows of docs that aren't held out, in one task on the bounded sample."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic")).filter(F.col("toxic").isNotNull() & F.col("_id").isNotNull())
    known = known.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    sample = sampled(docs.select("doc_id", "text"), known, seed).repartition(1).sortWithinPartitions("doc_id", "text")
    row = sample.mapInArrow(_train_task(seed), TRAINED).first()
    if row is None:  # nothing to learn from
        return train([], seed)
    return Model(np.frombuffer(row.weights, dtype=np.float32), row.bias, row.slope, row.offset, frozenset(row.common), frozenset(row.halves))
