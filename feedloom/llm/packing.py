"""Best-fit packing of tokenized documents into sequences of a fixed length.

A document is its token ids and an end id; longer ones are cut into pieces of the
sequence length. Pieces go into sequences by the linear grouping scheme, worked out on
the numbers of pieces of each length, which are at most as many as the sequence has
tokens, however many documents there are:

1. Large pieces (over a third of a sequence) are put in order of length and dealt into
   groups of equal cardinality; all of a group count as long as its longest.
2. For these few sizes, the least number of sequences is a linear programme over
   configurations (how many pieces of each group a sequence holds), solved by column
   generation; a knapsack over the sequence's tokens proposes configurations. Each is used
   as often as the solution's whole part says.
3. The actual pieces take the places of their group's size, which leaves gaps.
4. All other pieces, small ones and the few large ones left by rounding, go into the gaps
   by best fit, longest first.

The result is a table of slots: the so-manieth pieces of a length go to these sequences.
Spark numbers the pieces of each length and looks their slots up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import stored
from feedloom.llm.words import LOWER, chunks, text_bytes

SEQUENCE = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Large pieces are longer than this share of a sequence, and dealt into so many groups.
LARGE, GROUPS = 1 / 3, 128
#: Words of which a worker remembers the ids; it forgets all of them beyond that.
REMEMBERED = 600_000
#: Texts are encoded in chunks of so many bytes.
TEXT_BYTES = 2_000_000

# Bytes by what ends a word of the vocabulary's splitting rule: white space, and any
# change between letters (or digits) and other signs of ASCII. An apostrophe and most
# of what lies beyond ASCII may belong to either side, so nothing is cut next to it.
_BLANK, _SIGN, _LETTER, _EITHER = range(4)
_KIND = np.full(256, _EITHER, np.uint8)
_KIND[:128] = _SIGN
for _first, _last in ((48, 57), (65, 90), (97, 122)):
    _KIND[_first : _last + 1] = _LETTER
_KIND[[0x20, *range(0x09, 0x0E)]] = _BLANK
_KIND[39] = _EITHER
# The vocabulary knows small letters only. A great I stays, as it may join a dot above.
_SMALL = LOWER.copy()
_SMALL[73] = 73


def _kinds(data: np.ndarray) -> np.ndarray:
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # two bytes: U+00C0 to U+00FF, letters but for two
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


class Tokens:
    """Token ids of many texts: words are looked up, and encoded only when first seen.

    The vocabulary splits texts at white space and between letters and signs before it
    merges anything, so a text's ids are those of its parts one after another. Words of
    letters up to U+00FF are merged many at a time: no rule but the merges applies to
    them, and the last token of each is known by its end mark. Texts that hold a special
    token's string are encoded whole.
    """

    _PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content.encode() for t in special]
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many of them each text has."""
        lists = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        n = np.array([len(x) for x in lists], np.int64)
        return np.fromiter((i for x in lists for i in x), np.uint32, int(n.sum())), n

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``_encoded`` for plain words."""
        joined = self.merges.encode_batch_fast([" ".join(words).lower()], add_special_tokens=False)
        ids = np.array(joined[0].ids, np.uint32)
        end = np.flatnonzero(self.last[ids])
        return ids, np.diff(end, prepend=-1)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The number of each of the distinct ``words``."""
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [w for w in words if w not in self.known]
        plain = [w for w in new if self._PLAIN(w)]
        other = [w for w in new if not self._PLAIN(w)]
        for encode, some in ((self._merged, plain), (self._encoded, other)):
            for at in range(0, len(some), 20_000):
                part = some[at : at + 20_000]
                ids, n = encode(part)
                self.known.update(zip(part, range(len(self.n), len(self.n) + len(part)), strict=True))
                self.ids, self.n = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 and where each begins), and where each text's begin."""
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            ids, n = self._encoded(texts)
            return ids, np.r_[0, np.cumsum(n)]
        n_texts = len(offsets) - 1
        kind = _kinds(data)
        change = np.ones(len(data) + 1, bool)
        a, b = kind[:-1], kind[1:]
        change[1:-1] = (a != b) & ((a == _BLANK) | (b == _BLANK) | (a + b == _SIGN + _LETTER))
        change[offsets] = True
        at = np.flatnonzero(change)
        starts, ends = at[:-1], at[1:]
        word = kind[starts] != _BLANK if len(starts) else np.zeros(0, bool)
        starts, ends = starts[word], ends[word]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n_texts + 1, np.int64)
        lens = ends - starts
        place = np.r_[0, np.cumsum(lens)]
        inside = kind != _BLANK
        joined = _SMALL[data[inside]]
        words = pa.StringArray.from_buffers(
            len(starts), pa.py_buffer(place.astype(np.int32)), pa.py_buffer(joined)
        ).dictionary_encode()
        number = self._numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
        first, n = (np.cumsum(self.n) - self.n)[number], self.n[number]
        before = np.cumsum(n) - n
        ids = self.ids[np.repeat(first - before, n) + np.arange(int(n.sum()))]
        text = np.searchsorted(offsets, starts, "right") - 1
        per_text = np.bincount(text, n, n_texts).astype(np.int64)
        return ids, np.r_[0, np.cumsum(per_text)]


_tokens: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """One for a worker, which so remembers words from task to task."""
    if path not in _tokens:
        _tokens.clear()
        _tokens[path] = Tokens(path)
    return _tokens[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, sequence: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian 32 bits), part and seat, stored.

    ``seat`` counts the pieces of one length that a task (``part``) has met, from 0.
    ``path`` is the vocabulary's file on the executors, the public one if left out.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tokens = tokens_of(path or vocabulary_path())
        seats = np.zeros(sequence + 1, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in chunks(offsets, TEXT_BYTES):
                own = offsets[lo : hi + 1] - offsets[lo]
                ids, begin = tokens.of(data[offsets[lo] : offsets[hi]], own)
                ids = np.insert(ids, begin[1:], END).astype("<u4")
                begin += np.arange(len(begin))
                n = np.diff(begin)
                of = -(-n // sequence)
                doc = np.repeat(np.arange(hi - lo), of)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(of) - of, of)
                start = piece * sequence
                length = np.minimum(n[doc] - start, sequence)
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                place = np.arange(len(order)) - np.searchsorted(ordered, ordered)
                seat = np.empty(len(order), np.int64)
                seat[order] = place + seats[ordered]
                seats += np.bincount(length, minlength=sequence + 1)
                ends = np.r_[0, np.cumsum(length) * 4]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo).take(pa.array(doc)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        pa.LargeBinaryArray.from_buffers(
                            pa.large_binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]
                        ).cast(pa.binary()),
                        pa.array(np.full(len(doc), part, np.int32)),
                        pa.array(seat),
                    ],
                    ["doc_id", "piece", "start", "length", "ids", "part", "seat"],
                )

    shape = f"doc_id {id_type}, piece int, start long, length long, ids binary, part int, seat long"
    return stored(docs.select("doc_id", "text").mapInArrow(run, shape), "pack-pieces")


# --- the scheme, on numbers of pieces of each length


def _knapsack(sizes: np.ndarray, worth: np.ndarray, room: int) -> np.ndarray:
    """How often to take each size for the greatest worth in ``room``."""
    best = np.zeros(room + 1)
    taken = np.zeros((len(sizes), room + 1), np.int16)
    for i, (size, value) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
        if value <= 0:
            continue
        before = best.copy()
        for times in range(1, room // size + 1):
            with_it = before[: room + 1 - times * size] + times * value
            place = best[times * size :]
            better = with_it > place + 1e-12
            place[better] = with_it[better]
            taken[i, times * size :][better] = times
    out, left = np.zeros(len(sizes), np.int64), int(np.argmax(best))
    for i in range(len(sizes) - 1, -1, -1):
        out[i] = taken[i, left]
        left -= int(out[i] * sizes[i])
    return out


def configurations(sizes: np.ndarray, wanted: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (a row each: how many of each size) and how often to use each.

    The linear programme that covers ``wanted`` with the least number of sequences, by
    column generation from the trivial configurations; the whole parts of a solution.
    """
    k = len(sizes)
    basis = np.diag(room // sizes).astype(float)  # a column for each configuration in use
    used = np.linalg.solve(basis, wanted.astype(float))
    for _ in range(40 * k):
        worth = np.linalg.solve(basis.T, np.ones(k))
        column = _knapsack(sizes, worth, room).astype(float)
        if column @ worth <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, column)
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.full(k, np.inf)
        ratio[up] = np.maximum(used[up], 0) / direction[up]
        out = int(np.argmin(ratio))
        basis[:, out] = column
        used = np.linalg.solve(basis, wanted.astype(float))
    times = np.floor(np.maximum(used, 0) + 1e-9).astype(np.int64)
    rows = np.rint(basis.T).astype(np.int64)
    # rounding may ask for a few more than there are
    for i in np.flatnonzero(times):
        left = wanted - rows.T @ times
        while times[i] > 0 and (left[rows[i] > 0] < 0).any():
            times[i] -= 1
            left += rows[i]
    some = times > 0
    return rows[some], times[some]


@dataclass
class Slots:
    """Pieces ``rank`` to ``rank + n - 1`` of a length lie ``each`` to a sequence, from ``sequence`` on."""

    rows: list[tuple[int, int, int, int, int, int]]
    n_sequences: int


def slots(counts: np.ndarray, large: float = LARGE, groups: int = GROUPS) -> Slots:
    """Where the pieces go, given how many there are of each length (0 to a full sequence)."""
    room = len(counts) - 1
    rows: list[tuple[int, int, int, int, int, int]] = []
    n_sequences = 0
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(room + 1)]  # by gap: first sequence, number
    some = np.zeros(room + 1, bool)

    def leave(gap: int, first: int, n: int) -> None:
        if n and gap:
            gaps[gap].append((first, n))
            some[gap] = True

    if counts[room]:
        rows.append((room, 0, int(counts[room]), 1, 0, 0))
        n_sequences = int(counts[room])

    # large pieces by falling length: the p-th is of length[i] where begin[i] <= p < begin[i + 1]
    least = int(room * large) + 1
    length = np.array([s for s in range(room - 1, least - 1, -1) if counts[s]], np.int64)
    begin = np.r_[0, np.cumsum(counts[length])] if len(length) else np.zeros(1, np.int64)
    total = int(begin[-1])
    rest: list[tuple[int, int, int]] = []  # length, first rank, number
    if total:
        edge = np.unique(np.arange(groups + 1) * total // groups)
        of = np.searchsorted(begin, edge[:-1], "right") - 1
        size = length[of]  # of a group: that of its longest
        first = np.r_[True, size[1:] != size[:-1]]  # groups of one size are one
        edge, size = np.r_[edge[:-1][first], total], size[first]
        config, times = configurations(size, np.diff(edge), room)
        next_of = edge[:-1].copy()
        for row, m in zip(config, times.tolist(), strict=True):
            starts = []
            for g in np.repeat(np.arange(len(size)), row).tolist():
                starts.append(int(next_of[g]))
                next_of[g] += m
            # stretches of sequences in which no place changes its length
            cut = {0, m}
            for p in starts:
                inside = begin[np.searchsorted(begin, p, "right") : np.searchsorted(begin, p + m, "left")]
                cut.update((inside - p).tolist())
            steps = sorted(cut)
            for lo, hi in zip(steps[:-1], steps[1:], strict=True):
                offset = 0
                for p in starts:
                    i = int(np.searchsorted(begin, p + lo, "right")) - 1
                    rows.append((int(length[i]), int(p + lo - begin[i]), hi - lo, 1, n_sequences + lo, offset))
                    offset += int(length[i])
                leave(room - offset, n_sequences + lo, hi - lo)
            n_sequences += m
        for p, end in zip(next_of.tolist(), edge[1:].tolist(), strict=True):
            while p < end:
                i = int(np.searchsorted(begin, p, "right")) - 1
                to = min(end, int(begin[i + 1]))
                rest.append((int(length[i]), int(p - begin[i]), to - p))
                p = to
    rest.sort(key=lambda r: (-r[0], r[1]))
    rest += [(s, 0, int(counts[s])) for s in range(min(least, room) - 1, 0, -1) if counts[s]]

    for size, rank, n in rest:
        while n:
            found = size + int(np.argmax(some[size:])) if some[size:].any() else 0
            if found:
                first, m = gaps[found].pop()
                some[found] = bool(gaps[found])
            else:
                found, first = room, n_sequences
                m = -(-n // (room // size))
                n_sequences += m
            each = min(found // size, n)
            full = min(m, n // each)
            rows.append((size, rank, full * each, each, first, room - found))
            leave(found - each * size, first, full)
            leave(found, first + full, m - full)
            rank, n = rank + full * each, n - full * each
    return Slots(rows, n_sequences)


def pack(docs: DataFrame, sequence: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id and offset for each piece of ``docs`` (doc_id, text).

    Every document has at least its end id, so null and empty texts are pieces of one
    token. Rows that repeat a doc_id are documents of their own; a null doc_id stays null.
    Texts of any length are encoded whole. Of equally long pieces, which goes where
    depends on how Spark splits the table; the number of sequences does not.
    An empty table gives no row. Other columns are not looked at.
    """
    spark = docs.sparkSession
    cut = pieces(docs, sequence, path)
    of_part = stored(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "pack-parts")
    counts = np.zeros(sequence + 1, np.int64)
    for r in of_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length
        counts[r["length"]] = r["n"]
    found = np.array(slots(counts).rows, np.int64).reshape(-1, 6)
    names = ["length", "rank", "n", "each", "first", "from"]
    places = spark.createDataFrame(
        pa.table({name: found[:, i] for i, name in enumerate(names)})
    )  # its size is bounded by the sequence's length, as are the histogram and the gaps
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = of_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = cut.join(base, ["length", "part"]).withColumn("at", F.col("base") + F.col("seat"))
    own = own.alias("p").join(F.broadcast(places).alias("s"), on=(
        (F.col("p.length") == F.col("s.length"))
        & (F.col("at") >= F.col("rank")) & (F.col("at") < F.col("rank") + F.col("n"))
    ))
    nth = F.col("at") - F.col("rank")
    return own.select(
        "doc_id", "piece", "start", "p.length", "ids",
        (F.col("first") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("from") + nth % F.col("each") * F.col("p.length")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (little-endian 32 bits) and members (doc_id, piece, start, length, offset)."""
    member = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    of = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(member)).alias("m"))
    joined = F.aggregate("m", F.lit(b""), lambda a, m: F.concat(a, m["ids"]))
    return of.select("sequence_id", joined.alias("ids"), F.transform("m", lambda m: m.dropFields("ids")).alias("members"))


def digest(packed: DataFrame) -> DataFrame:
    """``packed`` with the crc32 of each piece's ids in place of them."""
    crc: Column = F.crc32("ids").alias("ids_crc32")
    return packed.select("doc_id", "piece", "start", "length", crc, "sequence_id", "offset")
