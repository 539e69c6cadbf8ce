"""Toxicity scores on text that a noisy-channel decoder has restored.

1. The character language model counts letter trigrams of every document, in Spark; it has 28 symbols: a to z, one for all
   other letters, one for a word's border.
2. Words that look disguised (digits or signs among letters, a letter three times in a row, letters set apart) become a
   lattice of what each character may stand for: itself, a letter it looks like, a repetition, a separator or a border.
   Viterbi decoding finds the most likely reading under the model. Plain words stay as they are. Signs at the edges of a word
   have two readings, noise or letters, and so have words of digits and signs alone: a number or noise, or letters; the costs
   decide. In a trigram model that depends on the signs and the two letters next to them, so it is worked out once for those.
   Masks (``*#%``) in runs at an edge, exclamation marks at the end, and words of one repeated sign are noise: any letter costs more.
3. Words and their beginnings are features. A feature's weight is the log odds of the lower Wilson bound, ``Z`` standard errors
   down, of the share of toxic documents among those that have it, with both kinds of document counted as equally many; so a
   rare word that only chance brought into toxic texts weighs nothing. Beginnings are counted over words that do not weigh
   anything themselves, so that one bad word does not speak against all words that begin like it.
4. A document's figures are the sum of its words' weights, that sum by the number of words, and the largest weight; a
   logistic curve over them, fitted on the training rows, gives the score.

The classifier is fitted on at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash of the id; the caller says
which labels may be used. At most ``FEATURES`` features, the heaviest first, make up the model. Everything else covers all documents.

Defined results: a null or empty text has no words and the score that both figures zero give; without training rows of both
kinds every score is the share of toxic rows, or 0; rows are scored each, null ids too; extra columns are left out; of several
labels of one id the row counts with each; null labels are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import CACHED_BYTES, documents, in_arrow, make_room, slices, written

TRAIN_ROWS = 10_000
FEATURES = 50_000
Z = 2.5
#: Documents in which a feature is found at least, to count.
SUPPORT = 4
PREFIXES = (4, 5, 6)
#: Symbols of the model: 0 is a border, 1 to 26 are letters, 27 any other letter.
SYMBOLS, OTHER = 28, 27
#: Letters that digits and signs stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
MASKS = "*#%"
#: Costs of the channel in nats.
LOOK, MASK, DROP, REPEAT, DOUBLE, GAP, BORDER, ODD = 0.7, 4.0, 2.0, 0.3, 1.5, 0.1, 2.0, 6.0
#: A sign at an edge as noise, if it is punctuation or one of a run of equal signs; a digit as itself.
NOISE, DIGIT = 0.5, 2.3
_EDGE = ".,;:?\"'()[]{}<>|-_/\\=~`^&"
#: Punctuation that is no letter in any reading, signs that may be one, and those of them that are punctuation too.
_MARKS = "".join(c for c in _EDGE if c not in LOOKS)
_LETTERS = "".join(c for c in LOOKS if not c.isdigit())
_PUNCTUATION = "".join(c for c in _EDGE if c in LOOKS)
#: Three or more single characters, each set apart.
_APART = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+])(?:[ .\-_*]{1,2}(?:[^\W_]|[@$!|+])(?!\w)){2,}(?!\S)")
_RUN = re.compile(r"([^\W\d_])\1\1")
_MASKED = re.compile(r"([*#%])\1+$|^([*#%])\2+")


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER


# --- the language model ----------------------------------------------------------------------------


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of (symbol, symbol, symbol) over the plain words of all documents: at most 28^3 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        table = np.full(0x10000, OTHER, np.uint8)
        table[ord("a") : ord("z") + 1] = np.arange(1, 27)
        table[0] = 0
        for batch in batches:
            for _, texts in slices(batch):
                words: Counter = Counter()
                for t in texts:
                    if t:
                        words.update(t.lower().split())
                plain = [(w, n) for w, n in ((b.decode().strip(_EDGE + "!"), n) for b, n in words.items()) if w.isalpha()]
                if not plain:
                    continue
                line = "\0" + "\0\0".join(w for w, _ in plain) + "\0"
                codes = table[np.minimum(np.frombuffer(line.encode("utf-32-le"), "<u4"), 0xFFFF)].astype(np.int64)
                weight = np.repeat([n for _, n in plain], [len(w) + 2 for w, _ in plain])
                key = (codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:]
                inside = (codes[1:-1] > 0) & (weight[:-2] > 0)
                total += np.bincount(key[inside], weight[1:-1][inside], SYMBOLS**3).astype(np.int64)
                start = np.flatnonzero((codes[:-1] == 0) & (codes[1:] > 0))  # a word's first letter after two borders
                total += np.bincount(codes[start + 1], weight[start + 1], SYMBOLS**3).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["key", "n"])

    found = in_arrow(documents(docs), run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3)
    for row in found:
        out[row["key"]] = row["n"]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs, minus log probabilities, of a symbol after two: trigrams backed by bigrams, single symbols and a floor."""
    one = counts.sum(axis=(0, 1)) + 1.0
    two = counts.sum(axis=0)
    p1 = one / one.sum()
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (counts + 20 * p2[None]) / (counts.sum(axis=2, keepdims=True) + 20)
    return -np.log(p3)


# --- the channel ---------------------------------------------------------------------------------------


class Decoder:
    """The likeliest reading of disguised words."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    def options(self, text: str, at: int) -> list[tuple[str, float]]:
        """What a character may stand for: a letter, nothing, or a border (a space)."""
        c = text[at]
        if c.isalpha():
            out = [(c, 0.0)]
            if at and text[at - 1] == c:
                tripled = (at > 1 and text[at - 2] == c) or (at + 1 < len(text) and text[at + 1] == c)
                out.append(("", REPEAT if tripled else DOUBLE))
            return out
        if c in " .-_":
            return [("", GAP), (" ", BORDER)]
        out = [(x, LOOK) for x in LOOKS.get(c, "")]
        if c in MASKS:
            out += [(chr(97 + k), MASK) for k in range(26)]
        if at and text[at - 1] == c and out:
            out.append(("", DOUBLE))
        out.append(("", ODD if c.isdigit() else DROP))
        return out

    def noisy(self, text: str, at: int) -> list[tuple[str, float]]:
        """The same for a sign at an edge, which may be noise."""
        c = text[at]
        run = text[at - 1 : at] == c or text[at + 1 : at + 2] == c
        return [*((x, LOOK) for x in LOOKS.get(c, "")), ("", NOISE if run or c in _PUNCTUATION or c not in LOOKS else DROP)]

    def alone(self, text: str, at: int) -> list[tuple[str, float]]:
        """The same in a word without letters, where a digit may be itself."""
        c = text[at]
        itself = (c, DIGIT) if c.isdigit() else ("", DROP if any(map(str.isdigit, text)) else ODD)
        return [*((x, LOOK) for x in LOOKS.get(c, "")), itself]

    def read(self, text: str, inner: range | None = None, start: tuple[int, int] = (0, 0), ends: bool = True, digits: bool = False) -> list[str]:
        """The words of the likeliest path through the lattice of a lower-case text.

        Signs outside ``inner`` may be noise. ``start`` is what comes before the text, ``ends`` whether a border follows it.
        """
        costs = self.costs
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {start: (0.0, None)}
        for at in range(len(text)):
            found = self.alone if digits else self.options if inner is None or at in inner else self.noisy
            choices = [(x, symbol(x) if x.strip() else 0, price) for x, price in found(text, at)]
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in best.items():
                for x, s, price in choices:
                    if not x:
                        state, now, way = (a, b), cost + price, path
                    elif x == " ":
                        if not b:
                            continue
                        state, now, way = (0, 0), cost + price + costs[a][b][0], (x, path)
                    elif x.isdigit():
                        state, now, way = (b, OTHER), cost + price, (x, path)
                    else:
                        state, now, way = (b, s), cost + price + costs[a][b][s], (x, path)
                    if state not in after or now < after[state][0]:
                        after[state] = (now, way)
            best = after
        # after a digit the border is free, as the digit was priced without the model
        last = lambda a, b, path: costs[a][b][0] if ends and not (path and path[0].isdigit()) else 0.0
        _, path = min(((cost + last(a, b, path), path) for (a, b), (cost, path) in best.items()), key=lambda x: x[0])
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out)).split()


def disguised(word: str) -> bool:
    """Whether a lower-case word mixes letters with what may stand for letters, or repeats a letter three times."""
    if word.isalpha():
        return bool(_RUN.search(word))
    return sum(map(str.isalpha, word)) >= 1 and len(word) >= 3


class Restorer:
    """The words of a text as they were meant, remembered by the words as they stand."""

    def __init__(self, costs: np.ndarray):
        self.decoder = Decoder(costs)
        self.known: dict[bytes, list[str]] = {}
        self.edges: dict[tuple[str, str, bool], str] = {}

    def edge(self, signs: str, beside: str, lead: bool) -> str:
        """The letters that signs stand for before (``lead``) or after at most two letters of a word."""
        if not signs:
            return ""
        key = (signs, beside, lead)
        found = self.edges.get(key)
        if found is None:
            if lead:
                out = "".join(self.decoder.read(signs + beside, range(len(signs), len(signs) + len(beside)), ends=False))
                found = out[: len(out) - len(beside)] if out.endswith(beside) else ""
            else:
                before = (0, 0, *map(symbol, beside))[-2:]
                found = "".join(self.decoder.read(signs, range(0), before))
            if len(signs) <= CACHED_BYTES:
                make_room(self.edges, 1)
                self.edges[key] = found
        return found

    def reading(self, chunk: bytes) -> list[str]:
        """The words that a chunk of lower-case text without blanks was meant to be."""
        text = chunk.decode()
        if not text.isalpha():
            text = text.strip(_MARKS).rstrip("!" + _MARKS)
            if not text.isalpha():
                return self.signs(_MASKED.sub("", text).strip(_MARKS))
        return self.decoder.read(text) if _RUN.search(text) else [text]

    def signs(self, text: str) -> list[str]:
        """The same for text that holds more than letters."""
        core = text.strip(_LETTERS + _MARKS)
        if not core or all(c in LOOKS for c in text):  # no letters
            return self.decoder.read(text, digits=True) if len(set(text)) > 1 and all(c in LOOKS for c in text) else [core] if core else []
        at = text.index(core)
        lead, trail = text[:at], text[at + len(core) :]
        if not core.isalpha() or _RUN.search(core):
            if not disguised(core):
                return [core]
            return self.decoder.read(text, range(at, at + len(core)))
        return [self.edge(lead, core[:2], True) + core + self.edge(trail, core[-2:], False)]

    def word(self, chunk: bytes) -> list[str]:
        found = self.known.get(chunk)
        if found is None:
            found = self.reading(chunk)
            if len(chunk) <= CACHED_BYTES:
                make_room(self.known, 1)
                self.known[chunk] = found
        return found

    def apart(self, text: bytes) -> tuple[bytes, list[str]]:
        """The text without words whose letters are set apart, and those words."""
        words: list[str] = []

        def take(m: re.Match) -> str:
            words.extend(self.decoder.read(m[0]))
            return " "

        low = text.decode().lower()
        return _APART.sub(take, low).encode(), words

    def words(self, text: bytes | None) -> list[str]:
        if not text:
            return []
        rest, out = self.apart(text)
        for chunk in rest.split():
            out += self.word(chunk)
        return out


def restore(docs: DataFrame, costs: np.ndarray) -> DataFrame:
    """doc_id and the restored words of each document, joined by spaces."""
    sent = docs.sparkSession.sparkContext.broadcast(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(sent.value)
        for batch in batches:
            for at, texts in slices(batch):
                out = [" ".join(own.words(t)) for t in texts]
                yield pa.record_batch([batch.column("doc_id").slice(at, len(texts)), pa.array(out, pa.string())], ["doc_id", "restored"])

    return in_arrow(documents(docs), run, "doc_id long, restored string")


# --- the classifier ------------------------------------------------------------------------------------


def features(word: str) -> list[int]:
    """A word and its beginnings, the longest first, as signed 64-bit hashes."""
    names = [f"{word}$", *(word[:n] for n in reversed(PREFIXES) if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in names]


def weight(sizes: dict[int, int]) -> Column:
    """The weight of a feature that ``n1`` of the toxic and ``n0`` of the other documents have."""
    toxic, clean = F.col("n1") / sizes[1], F.col("n0") / sizes[0]
    p, n = toxic / (toxic + clean), F.col("n0") + F.col("n1")
    low = (p + Z * Z / 2 / n - Z * F.sqrt(p * (1 - p) / n + Z * Z / 4 / n / n)) / (1 + Z * Z / n)
    return F.log(F.greatest(low, F.lit(1e-9)) / (1 - F.least(low, F.lit(1 - 1e-9))))


def root_of(word: str) -> str:
    """What all features of a word that weighs anything have in common: its shortest beginning, or the word if it is shorter."""
    return word[: PREFIXES[0]] if len(word) >= PREFIXES[0] else f"{word}$"


def train_weights(training: DataFrame, costs: np.ndarray) -> tuple[dict[int, float], set[int]]:
    """Feature to weight, from (doc_id, text, toxic) rows, and the features' roots; a negative weight says that the word is known
    to be harmless."""
    sent = training.sparkSession.sparkContext.broadcast(costs)
    begin = [f"p{n}" for n in PREFIXES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = Restorer(sent.value), (Counter(), Counter())
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            for at, texts in slices(batch):
                for label, text in zip(toxic[at:], texts):
                    counts[label].update(set(own.words(text)))
        words = list(counts[0].keys() | counts[1].keys())
        hashes = [features(w) for w in words]
        columns = [[h[0] for h in hashes], *([h[-k] if len(h) > k else None for h in hashes] for k in range(1, len(PREFIXES) + 1))]
        columns += [[c[w] for w in words] for c in counts]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["f", *begin, "n0", "n1"])

    sizes = dict.fromkeys((0, 1), 0) | {r["toxic"]: r["n"] for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes[0] or not sizes[1]:
        return {}, set()
    shape = ", ".join(f"{c} long" for c in ("f", *begin, "n0", "n1"))
    sums = [F.sum("n0").alias("n0"), F.sum("n1").alias("n1")]
    enough, of = F.col("n0") + F.col("n1") >= SUPPORT, weight(sizes)
    root = F.coalesce(begin[0], "f").alias("root")
    words = in_arrow(training.select("doc_id", "text", "toxic"), run, shape).groupBy("f", *begin).agg(*sums)
    words = written(words.withColumn("w", F.when(enough, of)), "words")
    light = words.where(F.coalesce(F.col("w") <= 0, F.lit(True)))
    each = light.select(F.explode(F.array(*begin)).alias("f"), root, "n0", "n1").where("f is not null")
    found = words.where("w is not null").select("f", root, "n0", "n1", "w").unionByName(
        each.groupBy("f", "root").agg(*sums).where(enough).withColumn("w", of)
    )
    near = found.join(found.where("w > 0").select("root").distinct(), "root", "left_semi").where("w > 0 or n0 > 0")
    kept = near.orderBy(F.desc("w"), "f").limit(FEATURES).collect()  # at most FEATURES
    return {r["f"]: max(r["w"], -1.0) for r in kept}, {r["root"] for r in kept}


class Figures:
    """The figures of a text."""

    def __init__(self, costs: np.ndarray, weights: dict[int, float], roots: set[int]):
        self.restorer, self.weights, self.roots = Restorer(costs), weights, roots
        self.near: dict[str, bool] = {}
        self.known: dict[bytes, tuple[float, float, int]] = {}

    def weight(self, word: str) -> float:
        """The largest of a word's features, or none if the most special one that is known speaks against it."""
        root = root_of(word)
        near = self.near.get(root)
        if near is None:
            make_room(self.near, 1)
            near = self.near[root] = xxhash.xxh3_64_intdigest(root) - (1 << 63) in self.roots
        if not near:
            return 0.0
        found = [self.weights[f] for f in features(word) if f in self.weights]
        return 0.0 if not found or found[0] <= 0 else max(found)

    def chunk(self, words: list[str]) -> tuple[float, float, int]:
        each = [self.weight(w) for w in words]
        return sum(each), max(each, default=0.0), len(each)

    def of(self, text: bytes | None) -> tuple[float, float, int]:
        """Sum of the weights, the largest one, and the number of words."""
        if not text:
            return 0.0, 0.0, 0
        rest, apart = self.restorer.apart(text)
        known = self.known
        total, most, n = self.chunk(apart)
        for chunk in rest.split():
            found = known.get(chunk)
            if found is None:
                found = self.chunk(self.restorer.reading(chunk))
                if len(chunk) <= CACHED_BYTES:
                    make_room(known, 1)
                    known[chunk] = found
            n += found[2]
            if found[1]:
                total += found[0]
                most = max(most, found[1])
        return total, most, n


def figures(docs: DataFrame, costs: np.ndarray, weights: tuple[dict[int, float], set[int]], *keep: str) -> DataFrame:
    """doc_id, ``keep``, and the figures x1 to x3 of each row."""
    sent = docs.sparkSession.sparkContext.broadcast((costs, *weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Figures(*sent.value)
        for batch in batches:
            for at, texts in slices(batch):
                total, most, n = (np.array(c, float) for c in zip(*(own.of(t) for t in texts)))
                kept = [batch.column(c).slice(at, len(texts)) for c in ("doc_id", *keep)]
                shown = [pa.array(x) for x in (np.log1p(total), np.log((total + 0.1) / (n + 10)), most)]
                yield pa.record_batch([*kept, *shown], ["doc_id", *keep, "x1", "x2", "x3"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    shape = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *keep))
    return in_arrow(docs.select("doc_id", "text", *keep), run, f"{shape}, x1 double, x2 double, x3 double")


def fit_curve(rows: list[tuple[float, float, float, int]]) -> np.ndarray:
    """Logistic coefficients for (x1, x2, x3, label) rows, with a slight pull towards zero; Newton's method."""
    x = np.array([(1.0, *r[:3]) for r in rows]).reshape(-1, 4)
    y = np.array([r[3] for r in rows], float)
    if not y.any() or y.all():
        return np.array([50.0 if len(y) and y.all() else -50.0, 0.0, 0.0, 0.0])
    beta, pull = np.zeros(4), np.diag([1e-3, 1e-2, 1e-2, 1e-2])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def score(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """doc_id and score of each document; ``labels`` has doc_id and toxic, ``usable`` says over doc_id which may be learned from."""
    rows = documents(docs)
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(TRAIN_ROWS)
    training = rows.join(F.broadcast(chosen), "doc_id")  # TRAIN_ROWS rows at most
    costs = language_model(trigram_counts(docs))
    weights = train_weights(training, costs)
    seen = figures(training, costs, weights, "toxic").select("x1", "x2", "x3", "toxic")
    seen = seen.orderBy(F.xxhash64("x1", "x2", "x3"), "toxic").limit(2 * TRAIN_ROWS).collect()  # more only if ids repeat
    beta = fit_curve([tuple(r) for r in seen]).tolist()
    line = F.lit(beta[0]) + sum(F.lit(b) * F.col(f"x{k}") for k, b in enumerate(beta[1:], 1))
    return figures(rows, costs, weights).select("doc_id", (1 / (1 + F.exp(-line))).alias("score"))
