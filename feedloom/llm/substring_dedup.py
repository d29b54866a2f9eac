"""Removal of repeated passages by recompression.

Rounds replace runs of one symbol, then pairs of neighbours, by new symbols whose names
are hashes of what they replace, so equal passages get equal symbols everywhere but at
their ends, on any machine and without a dictionary. Of each symbol it is known which
words settle that it is there. A window of words is looked up under a symbol of the
highest level that its own words settle: equal windows have equal ones. Only symbols that occur again
are looked into, and there windows are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stored
from feedloom.llm.words import chunks, hash_words, mix, split_words, text_bytes

WINDOW = 20
#: Texts are worked on in chunks of so many bytes, whose arrays fit a core's cache.
TEXT_BYTES = 150_000
#: A round replaces runs, then pairs. After two, a symbol is mostly three to five words.
ROUNDS = 2
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_FAR = np.int64(1) << 40


def _names(*parts: np.ndarray, salt: int) -> np.ndarray:
    """The name of a symbol made of ``parts``."""
    out = np.full(len(parts[0]), salt * 0x9E3779B9 + 1, np.uint64)
    for part in parts:
        out = mix(out * np.uint64(_BASE) + part)
    return out


class Symbols:
    """A level of all texts: symbols in order, and the words from ``lo`` to before ``hi`` that settle each."""

    def __init__(self, name: np.ndarray, text: np.ndarray):
        place = np.arange(len(name), dtype=np.int64)
        self.name, self.text, self.lo, self.hi = name, text, place, place + 1
        self.n_words = np.ones(len(name), np.int64)

    def _merge(self, first: np.ndarray, name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        last = np.r_[first[1:], len(self.name)] - 1
        if len(first):
            self.n_words = np.add.reduceat(self.n_words, first)
        self.name, self.text = name, self.text[first]
        self.lo, self.hi = lo[first], hi[last]

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """What settles each symbol's neighbours; nothing settles what lies beyond a text."""
        same = self.text[1:] == self.text[:-1]
        lo = np.r_[-_FAR, np.where(same, self.lo[:-1], -_FAR)]
        hi = np.r_[np.where(same, self.hi[1:], _FAR), _FAR]
        return lo, hi

    def runs(self, salt: int) -> np.ndarray:
        """Replace runs; true for symbols that are new. That a run ends is settled by its neighbours."""
        name = self.name
        begins = np.r_[True, (name[1:] != name[:-1]) | (self.text[1:] != self.text[:-1])]
        first = np.flatnonzero(begins)
        n = np.diff(np.r_[first, len(name)])
        lo, hi = self._neighbours()
        new = n > 1
        names = name[first]
        names[new] = _names(names[new], n[new].astype(np.uint64), salt=salt)
        self._merge(first, names, np.minimum(self.lo, lo), np.maximum(self.hi, hi))
        return new

    def pairs(self, salt: int) -> np.ndarray:
        """Replace each pair of a left and a right symbol; sides are a bit of the name."""
        name = self.name
        right = (mix(name + np.uint64(salt)) >> np.uint64(63)).astype(bool)
        joined = np.zeros(len(name) + 1, bool)  # with the symbol before
        joined[1:-1] = ~right[:-1] & right[1:] & (self.text[1:] == self.text[:-1])
        first = np.flatnonzero(~joined[:-1])
        new = joined[first + 1]
        names = name[first]
        names[new] = _names(names[new], name[first[new] + 1], salt=salt)
        lo, hi = self._neighbours()
        alone = ~joined[:-1] & ~joined[1:]
        lo = np.where(alone & right, np.minimum(self.lo, lo), self.lo)
        hi = np.where(alone & ~right, np.maximum(self.hi, hi), self.hi)
        self._merge(first, names, lo, hi)
        return new


def anchored(
    words: np.ndarray, text: np.ndarray, begin: np.ndarray, window: int = WINDOW
) -> tuple[np.ndarray, ...]:
    """First word of each window, its symbol's name, a number of that symbol's occurrence, and a hash.

    Of the symbols of one level that a window settles, the one of most words counts, which
    is the least likely to occur again by chance; then the one of the least hash, so that
    neighbouring windows mostly share it. ``begin`` has the first word of each
    text and the number of words at its end.
    """
    n = len(words)
    n_windows = np.maximum(np.diff(begin) - window + 1, 0)
    start = np.repeat(begin[:-1] - (np.cumsum(n_windows) - n_windows), n_windows)
    start = start + np.arange(int(n_windows.sum()))
    name, occurrence = words[start].copy(), start.copy()
    if not len(start):
        return start, name, occurrence, words[:0]
    symbols, taken = Symbols(words, text), n
    for level in range(1, 2 * ROUNDS + 1):
        new = (symbols.runs if level % 2 else symbols.pairs)(level)
        new &= (symbols.hi - symbols.lo <= window) & (symbols.lo >= 0)
        at = np.flatnonzero(new)
        if len(at):
            first = np.zeros(n + 1, np.int64)  # settled symbols that begin before a word
            first[1:] = np.cumsum(np.bincount(symbols.lo[at], minlength=n))
            upto = np.cumsum(np.bincount(symbols.hi[at], minlength=n + 1))  # that end by it
            k, last = first[start], upto[start + window]
            shortness = np.uint64(15) - np.minimum(symbols.n_words[at], 15).astype(np.uint64)
            rank = (mix(symbols.name[at]) >> np.uint64(4)) | (shortness << np.uint64(60))
            best, least = np.full(len(start), -1), np.full(len(start), ~np.uint64(0))
            todo = np.flatnonzero(k < last)
            k = k[todo]
            while len(todo):
                better = rank[k] < least[todo]
                rows = todo[better]
                least[rows], best[rows] = rank[k[better]], k[better]
                k = k + 1
                more = k < last[todo]
                todo, k = todo[more], k[more]
            ok = best >= 0
            name[ok] = _names(symbols.name[at[best[ok]]], salt=100 + level)
            occurrence[ok] = taken + best[ok]
        taken += len(at)
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[:1] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    inverse = np.full(n + 1, _INVERSE, np.uint64)
    inverse[:1] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers[:-1], out=total[1:])
    value = mix((total[start + window] - total[start]) * inverse[start])
    return start, name, occurrence, value


def _text_print(words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of each text's words, to tell rows of one doc_id apart."""
    n = np.diff(begin)
    place = (np.arange(len(words)) - np.repeat(begin[:-1], n)).astype(np.uint64)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(mix(words + mix(place)), begin[:-1][some])
    return mix(out).view(np.int64)


def _word_hashes(batch: pa.RecordBatch):
    data, offsets = text_bytes(batch.column("text"))
    for lo, hi in chunks(offsets, TEXT_BYTES):
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, text = split_words(part, own)
        begin = np.searchsorted(text, np.arange(hi - lo + 1))
        yield lo, hi, hash_words(part, starts, ends), text, begin


def _printed(docs: DataFrame, repeated_ids: bool) -> DataFrame:
    """doc_id, text and print: a hash of the words that tells rows of one doc_id apart.

    It is 0 where no doc_id is repeated. With it, a doc_id that most rows share, or none, is
    as many groups as it has texts.
    """
    if not repeated_ids:
        return docs.select("doc_id", "text", F.lit(0).cast("long").alias("print"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_text_print(words, begin) for _, _, words, _, begin in _word_hashes(batch)]
            prints = np.concatenate([*prints, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], [*batch.schema.names, "print"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, text string, print long")


def _same_row(left: str, right: str) -> Column:
    ids = F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id"))
    return ids & (F.col(f"{left}.print") == F.col(f"{right}.print"))


def _rows(words: np.ndarray, text: np.ndarray, begin: np.ndarray, window: int):
    """Of each stretch of windows with one symbol: its first window, and all windows' hashes."""
    start, name, occurrence, value = anchored(words, text, begin, window)
    change = (occurrence[1:] != occurrence[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(np.r_[True, change]) if len(start) else np.zeros(0, np.int64)
    return start, name[first], first, value


def _symbol_counts(docs: DataFrame, window: int) -> DataFrame:
    """Symbols that are looked up more than once; a task counts its own before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["symbol", "n"])

        for batch in batches:
            for _, _, words, text, begin in _word_hashes(batch):
                held.append(_rows(words, text, begin, window)[1])
                if sum(map(len, held)) >= 1_000_000:
                    yield flush()
                    held = []
        if held:
            yield flush()

    rows = docs.select("text").mapInArrow(run, "symbol long, n long")
    return rows.groupBy("symbol").agg(F.sum("n").alias("n")).where("n > 1").select("symbol")


def _digests(name: np.ndarray, first: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch: of its symbol and all its windows in order."""
    if not len(first):
        return name
    n = np.diff(np.r_[first, len(value)])
    place = (np.arange(len(value)) - np.repeat(first, n)).astype(np.uint64)
    return mix(np.add.reduceat(mix(value + mix(place)), first) ^ mix(name))


def _at(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of a batch's row and a place in its text."""
    return mix((row.astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64))


def _stretches(docs: DataFrame, window: int, repeated_ids: bool) -> DataFrame:
    """(symbol, digest, doc_id, print, at, n): stretches of n windows that are looked up under one symbol."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, words, text, begin in _word_hashes(batch):
                start, name, first, value = _rows(words, text, begin, window)
                of = text[start[first]]
                at = start[first] - begin[of]
                n = np.diff(np.r_[first, len(start)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(name.view(np.int64)),
                        pa.array(_digests(name, first, value).view(np.int64)),
                        batch.column("doc_id").take(pa.array(lo + of)),
                        pa.array(_text_print(words, begin)[of] if repeated_ids else np.zeros(len(of), np.int64)),
                        pa.array(at.astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    ["symbol", "digest", "doc_id", "print", "at", "n"],
                )

    shape = f"symbol long, digest long, doc_id {id_type}, print long, at int, n int"
    return docs.select("doc_id", "text").mapInArrow(run, shape)


def _windows(docs: DataFrame, wanted: DataFrame, window: int, repeated_ids: bool) -> DataFrame:
    """(symbol, value, doc_id, print, at): all windows of the stretches ``wanted`` (doc_id, print, at, digest).

    They are found again in the texts, so that no table carries the windows of all stretches.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    lists = wanted.groupBy("doc_id", "print").agg(F.collect_list(F.struct("at", "digest")).alias("wanted"))
    rows = _printed(docs, repeated_ids).alias("d").join(lists.alias("w"), _same_row("d", "w"))
    rows = rows.select("d.*", "w.wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("wanted")
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            wanted = flat.field("digest").to_numpy(zero_copy_only=False).view(np.uint64)
            wanted = wanted + _at(row, flat.field("at").to_numpy(zero_copy_only=False))
            for lo, hi, words, text, begin in _word_hashes(batch):
                start, name, first, value = _rows(words, text, begin, window)
                of = text[start[first]]
                key = _digests(name, first, value) + _at(lo + of, start[first] - begin[of])
                n = np.diff(np.r_[first, len(start)])
                at = np.flatnonzero(np.repeat(np.isin(key, wanted[ends[lo] : ends[hi]]), n))
                of = text[start[at]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(name, n)[at].view(np.int64)),
                        pa.array(value[at].view(np.int64)),
                        batch.column("doc_id").take(pa.array(lo + of)),
                        batch.column("print").take(pa.array(lo + of)),
                        pa.array((start[at] - begin[of]).astype(np.int32)),
                    ],
                    ["symbol", "value", "doc_id", "print", "at"],
                )

    shape = f"symbol long, value long, doc_id {id_type}, print long, at int"
    return rows.mapInArrow(run, shape)


def repeats(docs: DataFrame, window: int, repeated_ids: bool) -> DataFrame:
    """(doc_id, print, first, last): words in windows that also start earlier.

    Earlier is a smaller doc_id, or the same and an earlier start. ``last`` is not in it.
    """
    again = stored(_symbol_counts(docs, window), "repeat-symbols")
    found = _stretches(docs, window, repeated_ids).join(again, "symbol", "left_semi")
    found = stored(found, "repeat-stretches")
    place = F.struct("doc_id", "at")
    first_place = F.struct("p.doc_id", "p.at")
    # Of stretches that are equal throughout, all but the first are repeats as a whole.
    firsts = stored(
        found.groupBy("symbol", "digest").agg(F.min(F.struct("doc_id", "at", "print")).alias("p")), "repeat-firsts"
    )
    whole = stored(
        found.join(firsts, ["symbol", "digest"])
        .where(~place.eqNullSafe(first_place))
        .select("doc_id", "print", F.col("at").alias("first"), (F.col("at") + F.col("n") - 1 + window).alias("last")),
        "repeat-whole",
    )
    # Windows of different stretches under one symbol are compared one by one.
    several = firsts.groupBy("symbol").count().where("count > 1").select("symbol")
    wanted = stored(
        firsts.join(several, "symbol", "left_semi").select("p.doc_id", "p.print", "p.at", "digest"), "repeat-several"
    )
    single = stored(_windows(docs, wanted, window, repeated_ids), "repeat-windows")
    least = stored(
        single.groupBy("symbol", "value").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n"),
        "repeat-least",
    )
    one = stored(
        single.join(least, ["symbol", "value"])
        .where(~place.eqNullSafe(F.col("least")))
        .select("doc_id", "print", F.col("at").alias("first"), (F.col("at") + window).alias("last")),
        "repeat-single",
    )
    return whole.unionByName(one)


def _repeated_ids(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (the words left, joined by one space).

    A word is removed if a window of ``window`` words that covers it also starts earlier
    in the input. Null texts, and texts with fewer words, lose nothing; null doc_ids
    count as the least. Rows that share a doc_id are one document for what is earlier, so
    rows that repeat whole are treated alike. Other columns are not looked at.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    repeated_ids = _repeated_ids(docs)
    spans = repeats(docs, window, repeated_ids).groupBy("doc_id", "print").agg(
        F.collect_set(F.struct("first", "last")).alias("spans")
    )
    spans = stored(spans, "repeat-spans")
    rows = _printed(docs, repeated_ids).alias("d").join(spans.alias("s"), _same_row("d", "s"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            flat = lists.flatten()
            first, last = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            n_words, n_removed, kept = [], [], []
            for i, t in enumerate(texts):
                words = (t or b"").split()
                a, b = ends[i], ends[i + 1]
                if a < b:
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, first[a:b], 1)
                    np.add.at(step, last[a:b], -1)
                    gone = np.cumsum(step)[:-1] > 0
                    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return rows.select("d.doc_id", "d.text", "s.spans").mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept string")


def digest(texts: DataFrame) -> DataFrame:
    """Instead of the kept text, its SHA-256."""
    return texts.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
