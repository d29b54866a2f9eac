"""Language-model scores by Brown's class-based n-grams.

Words belong to classes that exchange clustering forms. A token's probability is that
of a move from the class before it to its own class, times that of the word in its
class. All counts come from all training documents.

Clustering has two steps. Exchange moves the few most frequent words and the endings of
all others, one at a time, to the class that raises the likelihood most. Then whole sweeps
of exchange, as Spark aggregations over all training documents, take every other word that
is looked up (up to ``LOOKED_UP``): how often each class comes before and after the word
is counted, and all words move to the class under which their neighbours are likeliest.
The more such words there are, the more classes. Rarer words keep their ending's class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stored
from feedloom.llm.words import LOWER, chunks, counted, hash_words, mix, split_words, text_bytes

#: Words that are units of their own in the first step, and units of endings.
OWN_UNITS, ENDING_UNITS = 512, 192
#: Classes: one for so many looked-up words, but no fewer and no more than these.
WORDS_PER_CLASS, LEAST_CLASSES, MOST_CLASSES = 2_000, 32, 128
#: Sweeps over all looked-up words but those of the first step.
SWEEPS = 1
#: At most this many frequent words are looked up in memory; rarer ones are joined.
LOOKED_UP = 200_000
#: Share of a class move's probability that is the class's own frequency.
BACK_OFF = 0.1
_END = np.uint64(0x656E64)  # hash of the token that ends a text
_TOKENS_AT_ONCE = 1_000_000
#: Looked-up words whose classes are chosen together.
WORDS_PER_BLOCK = 4_096


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; a null doc_id is not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Hash, ending and text number of all tokens of some texts; an end after each text."""
    data, offsets = text_bytes(batch.column("text"))
    data = LOWER[data]
    for lo, hi in chunks(offsets):
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, text = split_words(part, own)
        word = hash_words(part, starts, ends)
        before = np.where(ends - starts > 1, part[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        ending = mix(before * np.uint64(256) + part[ends - 1]) % np.uint64(ENDING_UNITS)
        n = hi - lo
        at = np.searchsorted(text, np.arange(n), "right")
        yield (
            lo,
            hi,
            np.insert(word, at, _END),
            np.insert(ending.astype(np.int64), at, 0),
            np.insert(text, at, np.arange(n)),
        )


def count_words(docs: DataFrame) -> DataFrame:
    """(word, ending, n) over all tokens of ``docs``, ends included; word is a 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, endings, held = [], [], 0

        def flush() -> pa.RecordBatch:
            every, ending = np.concatenate(words), np.concatenate(endings)
            word, n, order = counted(every)
            first = order[np.cumsum(n) - n]
            return pa.RecordBatch.from_arrays(
                [pa.array(word.view(np.int64)), pa.array(ending[first].astype(np.int16)), pa.array(n)],
                ["word", "ending", "n"],
            )

        for batch in batches:
            for _, _, word, ending, _ in _tokens(batch):
                words.append(word)
                endings.append(ending)
                held += len(word)
                if held >= _TOKENS_AT_ONCE:
                    yield flush()
                    words, endings, held = [], [], 0
        if held:
            yield flush()

    partial = docs.select("text").mapInArrow(run, "word long, ending short, n long")
    return partial.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Classes:
    """The class of each token: looked-up words have their own, others that of their ending."""

    words: np.ndarray  # sorted hashes of the looked-up words
    of_word: np.ndarray
    of_ending: np.ndarray

    def find(self, word: np.ndarray) -> np.ndarray:
        """The place of each word among the looked-up ones, or -1."""
        if not len(self.words):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, at, -1)

    def of(self, place: np.ndarray, word: np.ndarray, ending: np.ndarray) -> np.ndarray:
        if len(self.words):
            out = np.where(place >= 0, self.of_word[place], self.of_ending[ending])
        else:
            out = self.of_ending[ending]
        return np.where(word == _END, 0, out)


@dataclass
class Units:
    """Which unit a token is in: 0 the end, then words of their own, then endings."""

    words: np.ndarray  # sorted hashes
    numbers: np.ndarray

    @property
    def size(self) -> int:
        return 1 + OWN_UNITS + ENDING_UNITS

    def of(self, word: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = 1 + OWN_UNITS + ending
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            out = np.where(self.words[at] == word, self.numbers[at], out)
        return np.where(word == _END, 0, out)


def count_moves(docs: DataFrame, units: Units) -> np.ndarray:
    """How often each unit follows each other in ``docs``; a text begins after an end."""
    size = units.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for batch in batches:
            for _, _, word, ending, _ in _tokens(batch):
                unit = units.of(word, ending)
                before = np.r_[0, unit[:-1]]  # the token before a text's first is an end
                table += np.bincount(before * size + unit, minlength=size * size)
        cell = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell.astype(np.int32)), pa.array(table[cell])], ["cell", "n"]
        )

    rows = docs.select("text").mapInArrow(run, "cell int, n long")
    got = rows.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(size * size, np.int64)
    table[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return table.reshape(size, size)


def _at_once(cells: list[np.ndarray]) -> pa.RecordBatch:
    cell, n, _ = counted(np.concatenate(cells))
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n, pa.int64())], ["cell", "n"])


def count_neighbours(
    docs: DataFrame, classes: Classes, n_classes: int, settled: np.ndarray | None = None
) -> DataFrame:
    """(cell, n): how often each class follows and precedes each looked-up word that isn't ``settled``.

    The cell is the word's place times twice the number of classes, plus the class that
    follows, or the number of classes plus the one that precedes.
    """
    wide = 2 * n_classes
    settled = np.zeros(len(classes.words), bool) if settled is None else settled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held = [], 0
        for batch in batches:
            for _, _, word, ending, _ in _tokens(batch):
                place = classes.find(word)
                c = classes.of(place, word, ending)
                at = np.flatnonzero(place >= 0)
                at = at[~settled[place[at]]]
                own = place[at] * wide  # an end, which is never one of these last, follows
                cells.append(own + np.r_[c[1:], 0][at])
                cells.append(own + n_classes + np.r_[0, c[:-1]][at])
                held += len(word)
                if held >= 2 * _TOKENS_AT_ONCE:
                    yield _at_once(cells)
                    cells, held = [], 0
        if held:
            yield _at_once(cells)

    return docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def count_class_moves(docs: DataFrame, classes: Classes, n_classes: int) -> np.ndarray:
    """How often each class follows each other in ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(n_classes * n_classes, np.int64)
        for batch in batches:
            for _, _, word, ending, _ in _tokens(batch):
                c = classes.of(classes.find(word), word, ending)
                table += np.bincount(np.r_[0, c[:-1]] * n_classes + c, minlength=n_classes * n_classes)
        cell = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(table[cell])], ["cell", "n"])

    got = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros(n_classes * n_classes, np.int64)
    for r in got.collect():  # a row for each pair of classes at most
        table[r["cell"]] = r["n"]
    return table.reshape(n_classes, n_classes)


def sweep(docs: DataFrame, classes: Classes, moves: np.ndarray, settled: np.ndarray | None = None) -> Classes:
    """All looked-up words but the ``settled`` at once in the class that makes their neighbours' likeliest.

    ``moves`` are the class moves under the classes so far. Words are dealt out in blocks,
    and only each one's new class comes to the driver. Ties: the lowest class.
    """
    n_classes = len(moves)
    wide = 2 * n_classes
    smooth = moves + 0.1
    # of neighbours after and before, given the class of the word between them
    likely = np.concatenate(
        [np.log(smooth / smooth.sum(1, keepdims=True)), np.log(smooth / smooth.sum(0, keepdims=True)).T], 1
    )
    likely[0] = -np.inf  # the end's class takes no word

    def choose(rows: pa.Table) -> pa.Table:
        cell, n = rows["cell"].to_numpy(), rows["n"].to_numpy()
        place, row = np.unique(cell // wide, return_inverse=True)
        counts = np.zeros((len(place), wide))
        counts[row, cell % wide] = n
        found = np.argmax(np.round(counts @ np.maximum(likely, -1e9).T, 6), 1)
        return pa.table({"place": pa.array(place), "class": pa.array(found.astype(np.int16))})

    counts = stored(count_neighbours(docs, classes, n_classes, settled), "lm-neighbours")
    block = F.floor(F.col("cell") / (wide * WORDS_PER_BLOCK)).alias("block")
    rows = counts.groupBy(block).applyInArrow(choose, "place long, class short").toPandas()
    of_word = classes.of_word.copy()
    of_word[rows["place"].to_numpy()] = rows["class"].to_numpy()
    return Classes(classes.words, of_word, classes.of_ending)


def exchange(moves: np.ndarray, classes: int = LEAST_CLASSES, sweeps: int = 8) -> np.ndarray:
    """The class of each unit: units move to the class that raises the likelihood most.

    Unit 0, the end, is class 0 alone. Others start in classes by falling frequency and
    are moved in that order until a sweep moves none. Ties: the lowest class.
    """
    n_units = len(moves)
    freq = moves.sum(0)
    order = 1 + np.argsort(-freq[1:], kind="stable")
    cls = np.zeros(n_units, np.int64)
    cls[order] = 1 + np.arange(n_units - 1) % (classes - 1)
    members = np.eye(classes)[cls]
    between = members.T @ moves @ members

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(sweeps):
        moved = False
        for u in order[freq[order] > 0]:
            old = cls[u]
            members[u] = 0
            right, left, own = moves[u] @ members, moves[:, u] @ members, float(moves[u, u])
            between[old] -= right
            between[:, old] -= left
            between[old, old] -= own
            np.maximum(between, 0, out=between)
            # what each class's row, column and totals would gain from having u
            gain = (f(between + right[None, :]) - f(between)).sum(1)
            gain += (f(between + left[:, None]) - f(between)).sum(0)
            corner = np.diag(between)
            gain += f(corner + right + left + own) - f(corner + right) - f(corner + left) + f(corner)
            out, into = between.sum(1), between.sum(0)
            gain -= f(out + right.sum() + own) - f(out) + f(into + left.sum() + own) - f(into)
            gain[0] = -np.inf
            new = int(np.argmax(np.round(gain, 6)))
            cls[u] = new
            members[u, new] = 1
            between[new] += right
            between[:, new] += left
            between[new, new] += own
            moved |= new != old
        if not moved:
            break
    return cls


@dataclass
class Model:
    classes: Classes
    move: np.ndarray  # log10 probability of a class after a class
    spread: np.ndarray  # log10 of tokens + words + 1 of each class
    counts: np.ndarray  # of the looked-up words
    vocabulary: DataFrame  # all other words: word, n
    n_tokens: int
    n_words: int


def _step(n: Column) -> Column:
    """Counts on a coarse logarithmic scale."""
    return F.floor(F.log2(n) * 8)


def _least_step(words: DataFrame, most: int) -> int:
    """The least step that at most ``most`` words have or exceed."""
    rows = words.groupBy(_step(F.col("n")).alias("step")).count().collect()
    least, total = max((r.step for r in rows), default=0) + 1, 0
    for r in sorted(rows, key=lambda r: -r.step):
        total += r["count"]
        if total > most:
            break
        least = r.step
    return least


def likelihood(moves: np.ndarray) -> float:
    """The part of the training log likelihood that classes decide."""
    n = moves[moves > 0].astype(float)
    ends = moves.sum(0)[moves.sum(0) > 0].astype(float), moves.sum(1)[moves.sum(1) > 0].astype(float)
    return float((n * np.log(n)).sum() - sum((x * np.log(x)).sum() for x in ends))


def train(docs: DataFrame) -> Model:
    """Count, cluster and count again; ``docs`` are the training documents."""
    words = stored(count_words(docs), "lm-words")
    n_tokens, n_words = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    ).first()
    frequent = _step(F.col("n")) >= _least_step(words, LOOKED_UP)
    common = words.where(frequent).toPandas().sort_values(
        ["n", "word"], ascending=[False, True]
    )
    hashes = common["word"].to_numpy(np.int64).view(np.uint64)
    own = hashes[hashes != _END][:OWN_UNITS]
    by_hash = np.argsort(own)
    units = Units(own[by_hash], 1 + by_hash)
    n_classes = min(MOST_CLASSES, max(LEAST_CLASSES, len(hashes) // WORDS_PER_CLASS))
    moves = count_moves(docs, units)
    cls = exchange(moves, n_classes)
    order = np.argsort(hashes)
    endings = common["ending"].to_numpy(np.int64)
    start = cls[units.of(hashes, endings)]
    classes = Classes(hashes[order], start[order], cls[1 + OWN_UNITS :])
    table = np.zeros((n_classes, n_classes), np.int64)  # every word has its unit's class as yet
    np.add.at(table, (cls[:, None], cls[None, :]), moves)
    settled = np.isin(classes.words, np.r_[own, _END])
    for _ in range(SWEEPS if len(hashes) else 0):
        moved = sweep(docs, classes, table, settled)
        after_it = count_class_moves(docs, moved, n_classes)
        if likelihood(after_it) <= likelihood(table):
            break
        classes, table = moved, after_it
    table = table.astype(float)
    total = table.sum(0)
    share = (total + 1) / (total.sum() + n_classes)
    after = (table + share[None, :]) / (table.sum(1, keepdims=True) + 1)
    move = np.log10((1 - BACK_OFF) * after + BACK_OFF * share[None, :])
    # distinct words of each class: looked-up ones one by one, the rest by ending
    rest = words.where(~frequent & (F.col("word") != int(_END)))
    in_class = np.bincount(classes.of_word[classes.words != _END], minlength=n_classes)
    in_class[0] += 1
    for r in rest.groupBy("ending").count().collect():  # a row for each ending
        in_class[classes.of_ending[r.ending]] += r["count"]
    return Model(
        classes, move, np.log10(total + in_class + 1),
        common["n"].to_numpy(np.int64)[order],
        words.where(~frequent).select("word", "n"), int(n_tokens), int(n_words),
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the scores of each text of ``docs`` (doc_id, text).

    n_tokens, n_known (tokens that were counted in training), train_tokens, base_score
    (the unigram model with one added to each count) and score (this model), both log10
    probabilities of the text and its end. A null text is an empty one. Rows that repeat
    give repeated rows. A word that was never counted has its ending's class and the
    probability of a word counted zero times; with no training documents at all, all are.
    """
    m, n_classes = model, len(model.move)
    parts = (m.classes, m.move, m.spread, m.counts)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shape = (
        f"doc_id {id_type}, text_hash long, n_tokens long, n_known long, logs double, "
        "moves double, rare array<long>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, move, spread, counts = parts
        logs = np.log10(counts + 1.0)
        for batch in batches:
            for lo, hi, word, ending, text in _tokens(batch):
                n = hi - lo
                place = classes.find(word)
                c = classes.of(place, word, ending)
                before = np.r_[0, c[:-1]]
                gain = move.ravel()[before * n_classes + c] - spread[c]
                known = place >= 0
                log = np.where(known, logs[place], 0.0) if len(logs) else np.zeros(len(word))
                rare, in_text = word[~known], text[~known]
                seat = np.arange(len(word)).astype(np.uint64)
                print_ = np.add.reduceat(
                    mix(word ^ mix(seat - np.repeat(seat[np.searchsorted(text, np.arange(n))],
                                                    np.bincount(text, minlength=n)))),
                    np.searchsorted(text, np.arange(n)),
                )
                ends = np.searchsorted(in_text, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, n),
                        pa.array(print_.view(np.int64)),
                        pa.array(np.bincount(text, minlength=n)),
                        pa.array(np.bincount(text, known, n).astype(np.int64)),
                        pa.array(np.bincount(text, log, n)),
                        pa.array(np.bincount(text, gain, n)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(rare.view(np.int64))),
                    ],
                    ["doc_id", "text_hash", "n_tokens", "n_known", "logs", "moves", "rare"],
                )

    rows = stored(docs.select("doc_id", "text").mapInArrow(run, shape), "lm-rows")
    key = ["doc_id", "text_hash"]
    # Rows with one id and one text have the same rare words, so they are counted once.
    once = rows.dropDuplicates(key)
    rare = (
        once.select(*key, F.explode("rare").alias("word"))
        .join(m.vocabulary, "word")
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("rare_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("rare_logs"))
    )
    found = rare.select(F.struct(*key).alias("of"), "rare_known", "rare_logs")
    out = rows.drop("rare").join(found, F.struct(*key).eqNullSafe(F.col("of")), "left")
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    per_token = F.log10(F.lit(float(m.n_tokens + m.n_words + 1)))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(m.n_tokens).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * per_token).alias("base_score"),
        (logs + F.col("moves")).alias("score"),
    )
