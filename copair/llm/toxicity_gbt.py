"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by
isotonic regression.

1. Lexicon: over the labelled sample (copies merged) Spark counts, per word and per
   word start of 4 to 6 letters, the toxic and clean documents that hold it; units
   whose share in toxic documents cannot be chance get their log odds as weight.
   Words are read twice, as written and with look-alike characters undone, so a
   disguised word is found and its disguise is a feature.
2. Features (``features``), per whole text: lexicon densities and counts, second
   persons near lexicon words, capitals, punctuation, obfuscation rates.
3. Boosted trees of logistic loss on binned features, fitted with numpy on the
   bounded sample; a held-back fold calibrates the margin to a probability.
4. Scoring is one map-only pass over whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copair.llm.common import hash_sample, written

#: Second persons of the languages covered (fixed values).
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vosotros".split())
#: Look-alike characters (fixed values).
LOOK_ALIKE = str.maketrans("013457@$!|+", "oieastasiit")
_WORD = re.compile(r"[^\W_]+(?:['’\-*.@$!|+][^\W_]+)*", re.UNICODE)
_INNER = re.compile(r"['’\-*._]")
_JOINT = re.compile(r"['’\-*.@$!|+]")
#: Scripts without spaces: a run of these is read as its pairs of characters.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
_UPPER = bytes(range(65, 91))
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
_STARTS = (4, 5, 6)
_NEAR = 5
FEATURES = ("lexicon_density", "lexicon_weight_density", "lexicon_hits", "lexicon_kinds", "lexicon_max", "start_density",
            "start_hits", "disguised_density", "near_second_person", "second_person_density", "capital_rate",
            "shouted_words", "exclamations", "questions", "punctuation", "symbols", "digits_in_words", "stretched_words",
            "distinct_words", "log_words", "mean_word")


def plain_form(word: str) -> str:
    """A lower-case word with look-alikes and inner marks undone; unchanged if it is only digits."""
    if word.isalpha():
        return word
    if not any(c.isalpha() for c in word):
        return word
    return _INNER.sub("", word).translate(LOOK_ALIKE)


def _split(raw: str) -> tuple[str, ...]:
    words = _WORD.findall(raw.lower())
    if raw.isascii() or not _UNSPACED.search(raw):
        return tuple(words)
    out: list[str] = []
    for w in words:
        at = 0
        for m in _UNSPACED.finditer(w):
            out += _WORD.findall(w[at:m.start()])
            out += [m[0][i:i + 2] for i in range(max(1, len(m[0]) - 1))]
            at = m.end()
        out += _WORD.findall(w[at:])
    return tuple(out)


_split_short = lru_cache(1 << 16)(_split)


def words_of(raw: str) -> tuple[str, ...]:
    """Lower-case words of a text without white space, for learning and scoring alike."""
    return _split_short(raw) if len(raw) <= 40 else _split(raw)


def capital_letters(text: str) -> int:
    if text.isascii():
        return len(text) - len(text.encode().translate(None, _UPPER))
    plain = text.encode("ascii", "ignore")
    return len(plain) - len(plain.translate(None, _UPPER)) + sum(map(str.isupper, _NOT_ASCII.findall(text)))


def units(text: str | None) -> set[str]:
    """Words of a text and their starts (marked by ``*``)."""
    words = {plain_form(w) for raw in set((text or "").split()) for w in words_of(raw)}
    return words | {f"{w[:k]}*" for w in words for k in _STARTS if len(w) > k}


@dataclass
class Lexicon:
    words: dict[str, float]
    starts: dict[str, float]


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """One value per name in ``FEATURES``; all 0 for a null text or one without words."""
    text = text or ""
    written = text.split()
    if not written:
        return [0.0] * len(FEATURES)
    tokens = [w for raw in written for w in words_of(raw)]
    words, starts = lexicon.words, lexicon.starts
    kinds = set(tokens)
    glued = {}  # "you.idiot": no word as a whole, but its parts are
    for w in kinds:
        if not w.isalpha() and plain_form(w) not in words:
            parts = _JOINT.split(w)
            if len(parts) > 1 and any(plain_form(x) in words for x in parts):
                glued[w] = parts
    if glued:
        tokens = [x for w in tokens for x in glued.get(w, (w,))]
        kinds = set(tokens)
    n = max(len(written), len(tokens))
    odd = {}  # disguised spellings are few: undo them once per distinct word
    for w in kinds:
        if not w.isalpha():
            p = plain_form(w)
            if p != w:
                odd[w] = p
    flagged = {}
    started = set()
    disguised = set()
    for w in kinds:
        p = odd.get(w, w)
        v = words.get(p)
        if v is not None:
            flagged[w] = v
            if w in odd:
                disguised.add(w)
        elif any(p[:k] in starts for k in _STARTS if len(p) > k):
            started.add(w)
    at = [i for i, w in enumerate(tokens) if w in flagged] if flagged else []
    n_start = sum(w in started for w in tokens) if started else 0
    weight = sum(flagged[tokens[i]] for i in at)
    near = sum(any(w in SECOND_PERSON for w in tokens[max(0, i - _NEAR):i + _NEAR + 1]) for i in at)
    second = sum(w in SECOND_PERSON for w in tokens) if not kinds.isdisjoint(SECOND_PERSON) else 0
    chars = len(text)
    shouted = sum(len(w) > 2 and w.isupper() for w in written)
    capitals = capital_letters(text)
    marked = [w for w in written if not w.isalpha()]
    bang, ask = text.count("!"), text.count("?")
    symbols = sum(text.count(c) for c in "*#%&$@^~")
    digits = sum(not w.isdigit() and any(c.isdigit() for c in w) and any(c.isalpha() for c in w) for w in marked)
    stretched = sum(bool(_STRETCH.search(w)) for w in kinds)
    return [len(at) / n, weight / n, float(np.log1p(len(at))), float(len(flagged)), max(flagged.values(), default=0.0),
            n_start / n, float(np.log1p(n_start)), sum(tokens[i] in disguised for i in at) / n, near / (len(at) or 1),
            second / n, capitals / chars, shouted / n, bang / n, ask / n, len(marked) / n, symbols / chars, digits / n,
            stretched / (len(kinds) or 1), len(kinds) / n, float(np.log1p(n)), chars / n]


_STRETCH = re.compile(r"(\w)\1\1")


# ---------------------------------------------------------------------------
# boosted trees and calibration, on the bounded sample
# ---------------------------------------------------------------------------

@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)  # go left if value <= threshold
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for column, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.append(v)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right, value = map(np.array, (self.feature, self.threshold, self.left, self.right, self.value))
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                return value[node]
            at = node[inner]
            goes = x[inner, feature[at]] <= threshold[at]
            node[inner] = np.where(goes, left[at], right[at])


def _bins(x: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, most + 1)[1:-1])) for j in range(x.shape[1])]
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1), edges


def _grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int,
          ridge: float, least: float) -> Tree:
    tree, width = Tree(), max(len(e) for e in edges) + 1
    todo = [(tree.add(), np.arange(len(grad)), 0)]
    while todo:
        node, rows, level = todo.pop()
        g, h = grad[rows].sum(), hess[rows].sum()
        tree.value[node] = float(-g / (h + ridge))
        best = (1e-6, -1, 0)
        if level < depth:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, grad[rows], width))[:len(e)]
                hl = np.cumsum(np.bincount(b, hess[rows], width))[:len(e)]
                gain = gl ** 2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge)
                gain[(hl < least) | (h - hl < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        if best[1] < 0:
            if not level:
                tree.value[node] = 0.0  # nothing learned: the base margin stands
            continue
        j, k = best[1], best[2]
        goes = binned[rows, j] <= k
        tree.feature[node], tree.threshold[node] = j, float(edges[j][k])
        tree.left[node], tree.right[node] = tree.add(), tree.add()
        todo += [(tree.left[node], rows[goes], level + 1), (tree.right[node], rows[~goes], level + 1)]
    return tree


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64,
              ridge: float = 1.0, least: float = 1.0) -> tuple[float, list[Tree], float]:
    """Newton boosting of the logistic loss: ``(base margin, trees, rate)``."""
    # ten clean rows more, so that a handful of labels rejects nothing
    p = np.clip(y.sum() / (len(y) + 10), 1e-6, 1 - 1e-6)
    base = float(np.log(p / (1 - p)))
    binned, edges = _bins(x, bins)
    margin, grown = np.full(len(y), base), []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        tree = _grow(binned, edges, prob - y, prob * (1 - prob), depth, ridge, least)
        grown.append(tree)
        margin += rate * tree.predict(x)
    return base, grown, rate


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing map from margin to probability."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, sum of margins
    for m, v in zip(margin[order].tolist(), y[order].tolist()):
        blocks.append([v, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, m2 = blocks.pop()
            v1, w1, m1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, m1 + m2])
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    base: float
    trees: list[Tree]
    rate: float
    knots: tuple[np.ndarray, np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * tree.predict(x)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability, 0 to 1; rows of equal calibration keep the margin's order."""
        margin = self.margin(x)
        raw = 1 / (1 + np.exp(-margin))
        at, prob = self.knots
        if not len(at):
            return raw
        return np.clip(0.98 * np.interp(margin, at, prob) + 0.02 * raw, 0, 1)


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------

def _sketch(words: list[str], seed: int, width: int = 5) -> int:
    """Smallest hash over the shingles: equal for copies and most near copies."""
    shingles = (" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))
    return min(zlib.crc32(s.encode("utf-8", "surrogatepass"), seed) for s in shingles)


def learn_lexicon(sample: DataFrame, evidence: float = 16.0, odds: float = 8.0, most: int = 4000) -> Lexicon:
    """``sample(text, label)`` -> the units whose toxic share is ``odds`` times the clean share.

    ``evidence`` is the least log-likelihood ratio (nats) against the base rate.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t or "").lower().split() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([_sketch(w, k) for w in words], pa.int64()) for k in (1, 2))],
                names=["text", "label", "s1", "s2"])

    # a text that was copied often must not make all its words telling
    sample = sample.select("text", F.col("label").cast("int")).mapInArrow(sketch, "text string, label int, s1 long, s2 long")
    sample = written(sample.dropDuplicates(["s1"]).dropDuplicates(["s2"]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [(u, y) for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for u in units(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                                  pa.array([r[1] for r in rows], pa.int64())], names=["unit", "label"])

    n1, n0 = sample.select(F.sum("label"), F.sum(1 - F.col("label"))).first()
    if not n1 or not n0:
        return Lexicon({}, {})
    found = sample.select("text", F.col("label").cast("long")).mapInArrow(spread, "unit string, label long")
    counts = found.groupBy("unit").agg(F.sum("label").alias("k1"), F.sum(1 - F.col("label")).alias("k0"))
    weight = F.log((F.col("k1") + 0.25) / (n1 + 0.5)) - F.log((F.col("k0") + 0.25) / (n0 + 0.5))
    n, base = F.col("k1") + F.col("k0"), n1 / (n1 + n0)
    term = lambda k, share: F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
    ratio = term(F.col("k1"), base) + term(F.col("k0"), 1 - base)
    kept = (counts.withColumns({"w": weight, "g": ratio}).where((F.col("w") >= float(np.log(odds))) & (F.col("g") >= evidence))
            .orderBy(F.col("g").desc(), "unit").limit(most).collect())
    words = {r.unit: float(r.w) for r in kept if not r.unit.endswith("*")}
    return Lexicon(words, {r.unit[:-1]: float(r.w) for r in kept if r.unit.endswith("*")})


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id",
          sample: int = 12_000) -> Model:
    """Fit on a hash sample of about ``sample`` rows with a label (0 or 1).

    A fourth of it calibrates.  Without both labels the model is the base rate.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label"))
    rows = hash_sample(rows, sample, "id").withColumn("fold", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(4)))
    lexicon = learn_lexicon(rows.where("fold != 0"))
    # out-of-fold lexicons would cost more passes; the calibration fold is unseen by lexicon and trees

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3),
                                              pa.array(x, pa.list_(pa.float64()))], names=["id", "label", "fold", "x"])

    id_type = rows.schema["id"].dataType.simpleString()
    seen = rows.select("text", "id", "label", "fold").mapInArrow(
        describe, f"id {id_type}, label int, fold long, x array<double>").toPandas()
    seen = seen.sort_values("id", ignore_index=True)
    if not len(seen):
        return Model(lexicon, -20.0, [], 0.0, (np.empty(0), np.empty(0)))
    x, y = np.array(seen["x"].tolist()).reshape(len(seen), len(FEATURES)), seen["label"].to_numpy(dtype=float)
    train = seen["fold"].to_numpy() != 0
    train = train if train.any() else np.ones(len(seen), dtype=bool)
    model = Model(lexicon, *fit_trees(x[train], y[train]), (np.empty(0), np.empty(0)))
    held = ~train
    if held.any() and 0 < y[held].sum() < held.sum():
        model.knots = fit_isotonic(model.margin(x[held]), y[held])
    return model


def score_column(text: str, model: Model) -> Column:
    """Score of a text column, 0 to 1; null and empty texts are scored like any other."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t, model.lexicon) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.score(x))

    return score(F.col(text))
