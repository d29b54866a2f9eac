"""Language identification by hierarchical discrimination.

Character n-grams of letters decide on a language family first; then one-versus-one
linear support vector machines separate the languages of that family.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import CHUNK_BYTES
from feedloom.llm.words import chunks, code_points, folded, mix

UNKNOWN = "und"
DIMENSIONS = 4096
#: The classifier is fitted on at most this many labelled rows of a language.
PER_LANGUAGE = 600
#: And on so many rows in all; a language can't have less than a hundred of them.
FIT_ROWS, MAX_LANGUAGES = 24_000, 240
#: Families of closely related languages; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indic": "bn gu hi mr ne pa si ur",
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], f"only {lang}")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (1 to 3 letters; other characters act as one space), and letters.

    Returns a row of DIMENSIONS counts and the number of letters for each text.
    """
    n = len(texts)
    points = code_points(texts)
    text = np.repeat(np.arange(n), [len(t) + 1 for t in texts])
    letter = folded(points)
    n_letters = np.bincount(text[letter > 0], minlength=n)
    keep = letter > 0
    keep[1:] |= letter[:-1] > 0
    letter, text = letter[keep].astype(np.uint64), text[keep]
    gram, found = letter + np.uint64(1), []
    for size in (1, 2, 3):
        if size > 1:
            gram = gram[:-1] * np.uint64(0x110001) + letter[size - 1 :]
        same = text[: len(gram)] == text[len(text) - len(gram) :]
        hashed = (mix(gram) >> np.uint64(52)).astype(np.int64)  # 12 bits
        found.append((text[: len(gram)] * DIMENSIONS + hashed)[same])
        if not len(gram):
            break
    counts = np.bincount(np.concatenate(found), minlength=n * DIMENSIONS)
    return counts.reshape(n, DIMENSIONS), n_letters


def scaled(counts: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear support vector machine (squared hinge), y in -1, 1.

    Accelerated gradient descent; classes count alike whatever their numbers.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * c
    w = v = np.zeros(x.shape[1], np.float32)
    rate = 1 / (1 + 4 * c)
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        ahead = v - rate * (v - 2 * (x.T @ (share * y * slack)).astype(np.float32))
        v = ahead + (step / (step + 3)) * (ahead - w)
        w = ahead
    return w


@dataclass
class Votes:
    """One-versus-one machines between ``names``."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Votes:
        names = sorted(set(labels.tolist()))
        pairs = list(combinations(range(len(names)), 2))
        found = []
        for a, b in pairs:
            rows = (labels == names[a]) | (labels == names[b])
            found.append(fit_svm(x[rows], np.where(labels[rows] == names[a], 1.0, -1.0)))
        return cls(names, pairs, np.array(found, np.float32).reshape(len(pairs), x.shape[1] + 1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner and its chance (0 to 1), from its narrowest margin; ties: the first name."""
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        least = np.full((len(x), len(self.names)), np.inf)
        won = np.zeros((len(x), len(self.names)))
        for k, (a, b) in enumerate(self.pairs):
            least[:, a] = np.minimum(least[:, a], margins[:, k])
            least[:, b] = np.minimum(least[:, b], -margins[:, k])
            won[:, a] += margins[:, k] >= 0
            won[:, b] += margins[:, k] < 0
        best = np.argmax(won + 1e-3 * np.tanh(np.where(np.isinf(least), 1, least)), axis=1)
        margin = least[np.arange(len(x)), best]
        return best, 1 / (1 + np.exp(-3 * np.clip(margin, -50, 50)))


@dataclass
class Model:
    families: Votes
    within: dict[str, Votes]

    @classmethod
    def fit(cls, counts: np.ndarray, langs: np.ndarray) -> Model:
        x = scaled(counts)
        family = np.array([family_of(lang) for lang in langs.tolist()], object)
        within = {f: Votes.fit(x[family == f], langs[family == f]) for f in set(family.tolist())}
        return cls(Votes.fit(x, family), within)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 without letters."""
        counts, n_letters = features([t or "" for t in texts])
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        x = scaled(counts)
        family, chance = self.families.predict(x)
        for k, name in enumerate(self.families.names):
            rows = np.flatnonzero((family == k) & (n_letters > 0))
            if len(rows):
                votes = self.within[name]
                best, sure = votes.predict(x[rows])
                lang[rows] = np.array(votes.names, object)[best]
                score[rows] = chance[rows] * sure
        return lang.tolist(), score


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null doc_id isn't held out but not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _fit_rows(known: DataFrame, most: int) -> DataFrame:
    """doc_id, lang, text and h (a hash of both) of at most ``most`` rows of each language.

    Those of the least hashes; rows with the same doc_id and text count once. The least are
    found in parts first, so a language with most rows is no single task.
    """
    hashed = known.select("doc_id", "lang", F.xxhash64("doc_id", "text").alias("h"))
    part = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "doc_id")
    whole = Window.partitionBy("lang").orderBy("h", "doc_id")
    few = hashed.distinct().withColumn("n", F.row_number().over(part)).where(F.col("n") <= most)
    few = few.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= most).drop("n")
    rows = known.withColumn("h", F.xxhash64("doc_id", "text")).join(few, ["doc_id", "lang", "h"], "left_semi")
    return rows.groupBy("doc_id", "lang", "h").agg(F.first("text").alias("text"))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on whole texts of at most ``per_language`` labelled rows of each language.

    With many languages it is fewer of each, ``FIT_ROWS`` in all. Which rows is settled by a
    hash of doc_id and text, so reruns agree. Rows without lang, text or doc_id, and
    those held out, aren't used. None if no row is left. More than ``MAX_LANGUAGES``
    languages are refused.
    """
    known = docs.where(
        "lang is not null and text is not null and doc_id is not null"
    ).where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    n_languages = known.select("lang").distinct().count()
    if n_languages > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = _fit_rows(known, min(per_language, FIT_ROWS // max(n_languages, 1)))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in _text_chunks(batch):
                counts, _ = features(texts)
                at = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("h").slice(lo, hi - lo),
                        batch.column("lang").slice(lo, hi - lo),
                        pa.array([i.astype(np.uint16).tobytes() for i in at], pa.binary()),
                        pa.array(
                            [c[i].astype(np.uint32).tobytes() for c, i in zip(counts, at, strict=True)],
                            pa.binary(),
                        ),
                    ],
                    ["h", "lang", "at", "n"],
                )

    got = rows.mapInArrow(sparse, "h long, lang string, at binary, n binary").collect()  # FIT_ROWS at most
    if not got:
        return None
    got.sort(key=lambda r: (r.lang, r.h, bytes(r.at), bytes(r.n)))
    counts = np.zeros((len(got), DIMENSIONS), np.float32)
    for row, r in zip(counts, got, strict=True):
        row[np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.n, np.uint32)
    return Model.fit(counts, np.array([r.lang for r in got], object))


def _text_chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    texts = [t or "" for t in batch.column("text").to_pylist()]
    ends = np.cumsum([0, *map(len, texts)])
    for lo, hi in chunks(ends, CHUNK_BYTES // 2):
        for at in range(lo, hi, 200):  # 200 rows of features at a time
            yield at, min(at + 200, hi), texts[at : min(at + 200, hi)]


def identify(docs: DataFrame, model: Model | None, keep: float | None = None) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score``; with ``keep``, a filter instead.

    With ``keep`` only rows whose language is found with at least that score stay, with
    the columns they had. Null texts and texts without letters (or any text, if nothing
    could be learned) are ``und`` with score 0. Columns of the same names are replaced.
    Rows never meet, so repeated rows get the same answer.
    """
    docs = docs.drop("lang_pred", "score") if keep is None else docs
    extra = [] if keep is not None else [("lang_pred", "string"), ("score", "double")]
    shape = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{a} {b}" for a, b in extra]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in _text_chunks(batch):
                if model is None:
                    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    lang, score = model.predict(texts)
                part = batch.slice(lo, hi - lo)
                if keep is not None:
                    ok = (np.array(lang, object) != UNKNOWN) & (score >= keep)
                    yield part.filter(pa.array(ok))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                        [*part.schema.names, "lang_pred", "score"],
                    )

    return docs.mapInArrow(run, shape)
