"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector (drawn from a hash of its code point, so
no alphabet is fixed).  An n-gram's vector binds the permuted vectors of its
letters; a document bundles the vectors of all its n-grams, words padded by a
boundary symbol; a language prototype bundles its documents.  A document takes
the language whose prototype has the largest cosine.

Bundling is linear, so a document's vector is its n-gram counts times the
n-gram vectors: whole texts are counted in numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copair.llm.common import hash_sample

UNKNOWN = "und"
_CODES = 0x110000
_GRAMS_KEPT = 20_000
_BLOCK_CHARS = 400_000


class Grams:
    """N-gram counts of texts, and vectors of n-grams.  One per Python worker and parameter set."""

    _kept: dict[tuple[int, int, int], "Grams"] = {}

    def __init__(self, n: int, dims: int, seed: int):
        self.n, self.dims, self.seed = n, dims, seed
        self.letter = np.full(_CODES, -1, dtype=np.int32)  # -1: not seen yet
        self.alphabet = [0]  # code points of letter numbers; 0 is the boundary
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[tuple[int, ...], int] = {}
        self.vectors = np.empty((0, dims), dtype=np.float32)

    @classmethod
    def at(cls, n: int, dims: int, seed: int) -> "Grams":
        key = (n, dims, seed)
        if key not in cls._kept:
            cls._kept[key] = cls(n, dims, seed)
        return cls._kept[key]

    def _letter_vector(self, code: int) -> np.ndarray:
        if code not in self.letters:
            draw = np.random.default_rng([self.seed, code]).integers(0, 2, self.dims)
            self.letters[code] = (2 * draw - 1).astype(np.int8)
        return self.letters[code]

    def _vector(self, letters: tuple[int, ...]) -> np.ndarray:
        """Bound vector of an n-gram given by its code points, last first (0: boundary)."""
        out = np.ones(self.dims, dtype=np.int8)
        for k, code in enumerate(letters):
            out = out * np.roll(self._letter_vector(code), k)
        return out.astype(np.float32)

    def matrix(self, names: np.ndarray) -> np.ndarray:
        """Row numbers into ``vectors`` of distinct n-grams."""
        grams = list(map(tuple, names.tolist()))
        new = [g for g in grams if g not in self.rows]
        if len(self.rows) + len(new) > _GRAMS_KEPT:
            self.rows.clear()
            new = grams
        start = len(self.rows)
        if start + len(new) > len(self.vectors):
            grown = np.empty((max(1024, 2 * (start + len(new))), self.dims), dtype=np.float32)
            grown[:start] = self.vectors[:start]
            self.vectors = grown
        for i, g in enumerate(new):
            self.vectors[start + i] = self._vector(g)
            self.rows[g] = start + i
        return np.array([self.rows[g] for g in grams], dtype=np.int64)

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(texts, dims)`` vectors, and whether each text has a letter."""
        out, some, at = np.zeros((len(texts), self.dims), dtype=np.float32), np.zeros(len(texts), dtype=bool), 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= _BLOCK_CHARS):
                chars += len(texts[end] or "")
                end += 1
            self._block([t or "" for t in texts[at:end]], out[at:end], some[at:end])
            at = end
        return out, some

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        """Dense letter numbers of code points; 0 for what is no letter."""
        number = self.letter[codes]
        if (number < 0).any():
            for code in np.unique(codes[number < 0]).tolist():
                self.letter[code] = len(self.alphabet) if chr(code).isalpha() else 0
                if self.letter[code]:
                    self.alphabet.append(code)
            number = self.letter[codes]
        return number

    def _block(self, texts: list[str], out: np.ndarray, some: np.ndarray) -> None:
        lowered = [f" {t.lower()} " for t in texts]
        sizes = np.array([len(t) for t in lowered])
        number = self._letters(np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4"))
        letter = number > 0
        # runs of other characters become one boundary; each text starts with one
        first = np.zeros(len(number), dtype=bool)
        first[np.cumsum(sizes) - sizes] = True
        keep = letter | first
        keep[1:] |= letter[:-1]
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[keep]
        number = number[keep].astype(np.int64)
        some[:] = np.bincount(owner, weights=number > 0, minlength=len(texts)) > 0
        base = len(self.alphabet)
        gram = number
        for k in range(1, self.n):
            gram = gram[:-1] * base + number[k:]
        same = owner[:len(gram)] == owner[self.n - 1:]
        gram, owner = gram[same], owner[:len(same)][same]
        if not len(gram):
            return
        if base ** self.n <= 1 << 22:
            grams = np.flatnonzero(np.bincount(gram, minlength=1))
            place = np.empty(int(grams[-1]) + 1, dtype=np.int32)
            place[grams] = np.arange(len(grams), dtype=np.int32)
            where = place[gram]
        else:
            grams, where = np.unique(gram, return_inverse=True)
        names, rest = [], grams
        for _ in range(self.n):  # letters of each n-gram, last first
            names.append(rest % base)
            rest = rest // base
        codes = np.array(self.alphabet)
        names = np.stack([codes[x] for x in names], axis=1)
        for start in range(0, len(grams), _GRAMS_KEPT):  # a block of unusual texts may hold more
            rows = self.matrix(names[start:start + _GRAMS_KEPT])
            chosen = (where >= start) & (where < start + _GRAMS_KEPT)
            flat = owner[chosen].astype(np.int64) * len(rows) + (where[chosen] - start)
            counts = np.bincount(flat, minlength=len(texts) * len(rows)).reshape(len(texts), len(rows))
            out += counts.astype(np.float32) @ self.vectors[rows]


@dataclass
class Profiles:
    langs: list[str]
    prototypes: np.ndarray  # unit rows
    n: int
    dims: int
    seed: int


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", n: int = 3, dims: int = 512,
          seed: int = 8, sample: int = 20_000, id_col: str = "doc_id") -> Profiles:
    """Prototypes from rows with a language, a hash sample of about ``sample`` rows."""
    rows = hash_sample(labelled.where(F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col), sample, id_col)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                vectors, _ = Grams.at(n, dims, seed).bundles(part.column(0).to_pylist())
                norm = np.linalg.norm(vectors, axis=1, keepdims=True)
                # integers, so that sums do not depend on the order of tasks
                unit = np.rint(1e6 * vectors / np.where(norm > 0, norm, 1)).astype(np.int64)
                for lang, v in zip(part.column(1).to_pylist(), unit):
                    total[lang] = total[lang] + v if lang in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()),
                                          pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))],
                                         names=["lang", "v"])

    parts = rows.select(F.col(text_col), F.col(lang_col).cast("string")).mapInArrow(bundle, "lang string, v array<long>")
    sums = parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x")).toPandas()
    table = sums.pivot(index="lang", columns="d", values="x").sort_index() if len(sums) else pd.DataFrame()
    vectors = table.to_numpy(dtype=np.float64).reshape(len(table), dims)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Profiles([str(x) for x in table.index], vectors / np.where(norm > 0, norm, 1), n, dims, seed)


def predicted(text: str, profiles: Profiles) -> Column:
    """Struct ``(lang_pred, score)`` of a text column.

    ``und`` with score 0 for null, texts without a letter, or no profiles; ties go
    to the first language by code point; the score is the cosine, at least 0.
    """
    spark_langs = np.array(profiles.langs, dtype=object)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = Grams.at(profiles.n, profiles.dims, profiles.seed)
        for texts in batches:
            lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            if len(spark_langs):
                for at in range(0, len(texts), 256):
                    part = slice(at, min(at + 256, len(texts)))
                    vectors, some = grams.bundles(texts.iloc[part].tolist())
                    norm = np.linalg.norm(vectors, axis=1)
                    some &= norm > 0
                    cosine = vectors.astype(np.float64) @ profiles.prototypes.T / np.where(some, norm, 1)[:, None]
                    best = cosine.argmax(axis=1)
                    lang[part] = np.where(some, spark_langs[best], UNKNOWN)
                    score[part] = np.where(some, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return predict(F.col(text))
