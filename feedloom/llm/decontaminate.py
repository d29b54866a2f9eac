"""Benchmark decontamination by q-gram lemma filtering.

A passage within k edits of an item of m characters shares at least
``m - q + 1 - k * q`` character q-grams with it, all in a band of diagonals (place in
the text minus place in the item). Bands of 2(k + 1) diagonals that overlap by half
hold every such passage whole. Bands with enough shared q-grams are verified by banded
alignment. Items too short for their edits at one q have a smaller one, and items shorter than
that are looked up as whole words.

A small benchmark (``INDEX_CHARS``) is an index in every task. A larger one is a table: its
q-grams meet those of the documents in a join, bands are counted by grouping, and
only the bands that have enough meet their texts and items again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from feedloom.llm.common import CHUNK_BYTES, stored
from feedloom.llm.words import chunks, code_points, folded, mix

Q = 8
#: For items too short for Q; those with fewer characters than Q are matched as words.
SHORT_Q = 4
#: Edits allowed, as a share of an item's characters.
EDIT_BUDGET = 0.1
#: Characters of benchmark texts that are an index in memory; more are joined.
INDEX_CHARS = 500_000
#: Bits that tell most q-grams that no item has, before the join.
_JOIN_BITS = 27
_HITS_AT_ONCE = 2_000_000
_FILTER_BITS = 22
_BASE = 0x9E3779B97F4A7C15
_NOTHING = np.uint32(0xFFFFFFFF)


def normalized(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Small letters and digits; what lies between becomes one 0.

    Also the number of the text and the place in it of each character.
    """
    points = code_points(texts)
    lens = np.array([len(t) + 1 for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), lens)
    place = np.arange(len(points)) - np.repeat(np.cumsum(lens) - lens, lens)
    chars = folded(points, digits=True)
    keep = chars > 0
    keep[1:] |= chars[:-1] > 0
    return chars[keep], text[keep], place[keep]


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q-gram that begins at each character, from those of its halves."""
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    if q == 1:
        return chars.astype(np.uint64)
    half = q // 2
    part = grams(chars, half)
    n = len(chars) - q + 1
    out = part[:n] * np.uint64(pow(_BASE, q - half, 1 << 64))
    out += part[q - half : q - half + n] if q % 2 == 0 else grams(chars, q - half)[half : half + n]
    return out


def _slot(gram: np.ndarray) -> np.ndarray:
    return ((gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(
        64 - _FILTER_BITS
    )


def q_of(m: int, q: int, share: float) -> int:
    """The length of q-grams for an item of ``m`` characters: ``q`` if that allows all its edits."""
    return q if (m - q) // q >= int(share * m) and m >= q else SHORT_Q


def words_in(chars: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all runs of ``size`` characters that are whole words of one text."""
    bounded = np.r_[np.uint32(0), chars, np.uint32(0)]
    of = np.r_[-1, text, -1]
    n = len(chars) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    inside = (text[at] == text[at + size - 1]) & (chars[at] > 0) & (chars[at + size - 1] > 0)
    before = (bounded[at] == 0) | (of[at] != text[at])
    behind = (bounded[at + size + 1] == 0) | (of[at + size + 1] != text[at])
    at = at[inside & before & behind]
    return at, grams(chars, size)[at]


def item_chars(text: str) -> np.ndarray:
    """An item as it is compared: normalized, without a space at its ends."""
    chars = normalized([text])[0]
    return chars[:-1] if len(chars) and not chars[-1] else chars


@dataclass
class Words:
    """Distinct normalized items shorter than any q-gram, by length."""

    ids: list[list]
    items: list[np.ndarray]

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, 0, start, end) of the first place where an item is whole words of a text."""
        if not self.items:
            return []
        chars, text, place = normalized(texts)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for size in {len(x) for x in self.items}:
            at, gram = words_in(chars, text, size)
            of = [i for i, x in enumerate(self.items) if len(x) == size]
            keys = np.array([grams(self.items[i], size)[0] for i in of], np.uint64)
            order = np.argsort(keys)
            k = np.minimum(np.searchsorted(keys[order], gram), len(of) - 1)
            same = keys[order][k] == gram
            for a, i in zip(at[same].tolist(), order[k[same]].tolist(), strict=True):
                if (chars[a : a + size] == self.items[of[i]]).all():
                    found.setdefault((int(text[a]), of[i]), (int(place[a]), int(place[a + size - 1]) + 1))
        return [(t, i, 0, *span) for (t, i), span in sorted(found.items())]


@dataclass
class Searches:
    """The whole benchmark in memory: indexes by length of q-grams, and words."""

    parts: list

    @classmethod
    def build(cls, rows: list[tuple[object, str]], q: int = Q, share: float = EDIT_BUDGET) -> Searches:
        by_q: dict[int, dict[bytes, list]] = {q: {}, SHORT_Q: {}, 0: {}}
        for item_id, text in rows:
            chars = item_chars(text)
            if len(chars):
                kind = 0 if len(chars) < 2 * SHORT_Q else q_of(len(chars), q, share)
                by_q[kind].setdefault(chars.tobytes(), []).append(item_id)
        parts: list = [Index.of(items, size, share) for size, items in by_q.items() if size and items]
        if by_q[0]:
            parts.append(Words(list(by_q[0].values()), [np.frombuffer(b, np.uint32) for b in by_q[0]]))
        return cls(parts)

    def search(self, texts: list[str]) -> list[tuple]:
        """(text, item ids, edits, start, end) of all items found, text by text."""
        found = [(t, part.ids[i], *span) for part in self.parts for t, i, *span in part.search(texts)]
        return sorted(found, key=lambda r: r[0])


@dataclass
class Index:
    """Distinct normalized items with their q-grams and edit budgets."""

    ids: list[list]
    items: list[np.ndarray]
    budget: np.ndarray
    least: np.ndarray
    known: np.ndarray
    first: np.ndarray
    n: np.ndarray
    item: np.ndarray
    place: np.ndarray
    q: int
    _filter: np.ndarray | None = None

    @classmethod
    def build(cls, rows: list[tuple[object, str]], q: int = Q, share: float = EDIT_BUDGET) -> Index:
        by_chars: dict[bytes, list] = {}
        for item_id, text in rows:
            by_chars.setdefault(item_chars(text).tobytes(), []).append(item_id)
        return cls.of(by_chars, q, share)

    @classmethod
    def of(cls, by_chars: dict[bytes, list], q: int, share: float) -> Index:
        items = [np.frombuffer(b, np.uint32) for b in by_chars]
        lens = np.array([len(x) for x in items], np.int64)
        budget = (share * lens).astype(np.int64)
        all_grams = [grams(x, q) for x in items]
        flat = np.concatenate([*all_grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(g) for g in all_grams])
        place = np.concatenate([np.arange(len(g)) for g in all_grams] or [np.zeros(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        known, first, n = np.unique(flat[order], return_index=True, return_counts=True)
        least = lens - q + 1 - budget * q
        return cls(
            list(by_chars.values()), items, budget, least, known, first, n,
            item[order].astype(np.int64), place[order].astype(np.int64), q,
        )

    def hits(self, chars: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(place in ``chars``, item, place in the item) of shared q-grams, some at a time."""
        if self._filter is None:
            self._filter = np.zeros(1 << _FILTER_BITS, bool)
            self._filter[_slot(self.known)] = True
        found = grams(chars, self.q)
        at = np.flatnonzero(
            self._filter[_slot(found)] & (text[: len(found)] == text[len(text) - len(found) :])
        )
        k = np.minimum(np.searchsorted(self.known, found[at]), len(self.known) - 1)
        same = self.known[k] == found[at]
        at, k = at[same], k[same]
        ends = np.cumsum(self.n[k])
        lo = 0
        while lo < len(at):
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _HITS_AT_ONCE, "right"))
            hi = max(hi, lo + 1)
            n, first = self.n[k[lo:hi]], self.first[k[lo:hi]]
            total = int(n.sum())
            post = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)
            yield np.repeat(at[lo:hi], n), self.item[post], self.place[post]
            lo = hi

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of the best passage of each item in each text.

        Start and end are places in the text as given. Fewest edits, then the first.
        """
        chars, text, place = normalized(texts)
        n_items = len(self.items)
        if not n_items or len(chars) < self.q:
            return []
        pairs = np.zeros(len(texts) * n_items, np.int64)
        for at, item, _ in self.hits(chars, text):
            pairs += np.bincount(text[at] * n_items + item, minlength=len(pairs))
        enough = pairs >= np.tile(self.least, len(texts))
        if not enough.any():
            return []
        keys, lines = [], []
        for at, item, inside in self.hits(chars, text):
            pair = text[at] * n_items + item
            keep = enough[pair]
            at, item, inside, pair = at[keep], item[keep], inside[keep], pair[keep]
            band = (at - inside) // (self.budget[item] + 1) + 2**30
            keys += [(pair << 32) + band, (pair << 32) + band - 1]
            lines.append((pair << 32) + at - inside + 2**30)
        best = self._whole(np.concatenate(lines), chars)
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        pair, band = key >> 32, (key & 0xFFFFFFFF) - 2**30
        kept = (n >= self.least[pair % n_items]) & ~np.isin(pair, list(best))
        pair, band = pair[kept], band[kept]
        of, item = pair // n_items, pair % n_items
        begins = np.searchsorted(text, np.arange(len(texts) + 1))
        order = np.argsort([len(self.items[i]) for i in item], kind="stable")
        for lo in range(0, len(order), 256):
            rows = order[lo : lo + 256]
            found = aligned(
                chars, [self.items[i] for i in item[rows]], self.budget[item[rows]],
                first_diagonal(band[rows], self.budget[item[rows]]), begins[of[rows]], begins[of[rows] + 1],
            )
            for r, edits, start, end in zip(rows, *found, strict=True):
                if edits <= self.budget[item[r]]:
                    got = (int(edits), int(start), int(end))
                    best[int(pair[r])] = min(best.get(int(pair[r]), got), got)
        return [
            (p // n_items, p % n_items, e, int(place[s]), int(place[t - 1]) + 1)
            for p, (e, s, t) in sorted(best.items())
        ]


    def _whole(self, lines: np.ndarray, chars: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Pairs of a text and an item that it holds unchanged, with the first such passage.

        ``lines`` are shared q-grams by pair and diagonal. Where a diagonal has all of the
        item's, nothing is left to align.
        """
        line, n = np.unique(lines, return_counts=True)
        pair = line >> 32
        sizes = np.array([len(x) for x in self.items])
        best: dict[int, tuple[int, int, int]] = {}
        for p, at in zip(*(x[n == sizes[pair % len(sizes)] - self.q + 1].tolist() for x in (pair, line)), strict=True):
            start, item = (at & 0xFFFFFFFF) - 2**30, self.items[p % len(sizes)]
            if p not in best and (chars[start : start + len(item)] == item).all():
                best[p] = (0, start, start + len(item))
        return best


def first_diagonal(band: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Where the passages that a band can hold begin at the earliest."""
    return band * (budget + 1) - budget


def aligned(
    chars: np.ndarray, items: list[np.ndarray], k: np.ndarray, base: np.ndarray, begin: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Fewest edits between an item and any passage in its band, and the passage."""
    lens = np.array([len(x) for x in items])
    width = 4 * k + 2
    most = int(width.max())
    step = np.int64(1) << 32
    ramp = np.arange(most) * step
    far = np.int64(1) << 60
    wanted = np.zeros((len(items), int(lens.max())), np.uint32)
    for row, x in zip(wanted, items, strict=True):
        row[: len(x)] = x
    within = np.arange(most)[None, :] < width[:, None]
    # edits and first diagonal in one number, so that the least has the fewest edits
    now = np.where(within, np.arange(most, dtype=np.int64)[None, :], far)
    # a passage can't start before its text
    now = np.where(base[:, None] + np.arange(most) < begin[:, None], far, now)
    out = np.full((3, len(items)), far)
    rows = np.arange(len(items))
    for i in range(1, int(lens.max()) + 1):
        at = base[:, None] + np.arange(most) + (i - 1)
        inside = (at >= begin[:, None]) & (at < end[:, None])
        there = np.where(inside, chars[np.clip(at, 0, len(chars) - 1)], _NOTHING)
        other = there != wanted[:, i - 1 : i]
        new = np.where(inside, now + other * step, far)
        new[:, :-1] = np.minimum(new[:, :-1], now[:, 1:] + step)
        new = np.where(within & (at + 1 <= end[:, None]), new, far)
        new = np.minimum.accumulate(new - ramp, axis=1) + ramp
        now = np.where(within & (at + 1 <= end[:, None]), np.minimum(new, far), far)
        done = np.flatnonzero(lens == i)
        if len(done):
            x = np.argmin(now[done], axis=1)
            value = now[done, x]
            out[0, rows[done]] = value >> 32
            out[1, rows[done]] = base[done] + (value & 0xFFFFFFFF)
            out[2, rows[done]] = base[done] + x + i
        if i % 16 == 0:  # edits only grow: rows over their budget, and those that are done, go
            on = ((now.min(1) >> 32) <= k) & (lens > i)
            if not on.any():
                break
            if on.sum() < 0.75 * len(on):
                now, base, begin, end, wanted, within, lens, k, rows = (
                    x[on] for x in (now, base, begin, end, wanted, within, lens, k, rows)
                )
    return tuple(out)


# --- a benchmark that is joined


def _hash(chars: np.ndarray, size: int, words: bool = False) -> np.ndarray:
    """Hashes of the runs of ``size`` characters, other ones for each size and for whole words."""
    return mix(grams(chars, size) ^ mix(np.array([size + 1000 * words], np.uint64))[0])


def _item_table(benchmark: DataFrame, q: int, share: float) -> DataFrame:
    """chars (normalized, 32 bits each), item_ids and item (its number) of each distinct item, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = [item_chars(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(chars, pa.binary())], ["item_id", "chars"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.where("text is not null").select("item_id", "text").mapInArrow(run, f"item_id {kind}, chars binary")
    distinct = rows.where("octet_length(chars) > 0").select("chars").distinct()
    numbered = stored(distinct.withColumn("item", F.monotonically_increasing_id()), "bench-items")
    return stored(rows.join(numbered, "chars"), "bench-rows")


def _item_grams(items: DataFrame, q: int, share: float) -> DataFrame:
    """gram, item, place, budget and least (shared q-grams that a band needs) of each item's q-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for item, raw in zip(batch.column("item").to_pylist(), batch.column("chars").to_pylist(), strict=True):
                chars = np.frombuffer(raw, np.uint32)
                m = len(chars)
                whole = m < 2 * SHORT_Q
                size, budget = (m, 0) if whole else (q_of(m, q, share), int(share * m))
                gram = _hash(chars, size, whole)
                least = max(m - size + 1 - budget * size, 1)
                for column, value in zip(columns, (gram.view(np.int64), item, np.arange(len(gram)), budget, least), strict=True):
                    column.append(np.broadcast_to(np.asarray(value, np.int64), len(gram)))
            arrays = [pa.array(np.concatenate([*c, np.zeros(0, np.int64)])) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, ["gram", "item", "place", "budget", "least"])

    shape = "gram long, item long, place long, budget long, least long"
    return stored(items.select("item", "chars").distinct().mapInArrow(run, shape), "bench-grams")


def _gram_filter(item_grams: DataFrame) -> bytes:
    """A bit for each of 2 ** _JOIN_BITS hash values: whether an item's q-gram has it. 16 MB at any size."""
    of_chunk = 1 << 17

    def pack(rows: pa.Table) -> pa.Table:
        bits = np.zeros(of_chunk, bool)
        bits[rows["slot"].to_numpy() % of_chunk] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"chunk": pa.array([rows["chunk"][0].as_py()], pa.int64()), "bits": pa.array([packed], pa.binary())})

    slots = item_grams.select(F.shiftrightunsigned("gram", 64 - _JOIN_BITS).alias("slot")).distinct()
    chunk = F.call_function("div", F.col("slot"), F.lit(of_chunk).cast("long")).alias("chunk")
    chunks_ = slots.select("slot", chunk).groupBy("chunk").applyInArrow(pack, "chunk long, bits binary")
    out = bytearray((1 << _JOIN_BITS) // 8)
    for r in chunks_.collect():  # a thousand rows of 16 KB at most
        out[r["chunk"] * of_chunk // 8 : (r["chunk"] + 1) * of_chunk // 8] = r["bits"]
    return bytes(out)


def _joined(docs: DataFrame, benchmark: DataFrame, q: int, share: float) -> DataFrame:
    """doc_id, h (a hash of the text), item_id, edits, start and end: the items found in each distinct row."""
    items = _item_table(benchmark, q, share)
    of_items = _item_grams(items, q, share)
    lengths = items.select((F.octet_length("chars") / 4).cast("int").alias("m")).where(F.col("m") < 2 * SHORT_Q)
    word_sizes = sorted(r["m"] for r in lengths.distinct().collect())  # 1 to 7
    packed = _gram_filter(of_items)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(packed, np.uint8)
        for batch in batches:
            for lo, hi, texts in _text_chunks(batch):
                chars, text, _ = normalized(texts)
                begins = np.searchsorted(text, np.arange(hi - lo))
                at, gram = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for size in (q, SHORT_Q):
                    n = max(len(chars) - size + 1, 0)
                    here = np.flatnonzero(text[:n] == text[len(text) - n :])
                    at.append(here)
                    gram.append(_hash(chars, size)[here])
                for size in word_sizes:
                    here, _ = words_in(chars, text, size)
                    at.append(here)
                    gram.append(_hash(chars, size, words=True)[here])
                at, gram = np.concatenate(at), np.concatenate(gram)
                slot = (gram >> np.uint64(64 - _JOIN_BITS)).astype(np.int64)
                some = (known[slot >> 3] >> (slot & 7) & 1).astype(bool)
                at, gram = at[some], gram[some]
                row = text[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo).take(pa.array(row)),
                        batch.column("h").slice(lo, hi - lo).take(pa.array(row)),
                        pa.array(at - begins[row]),
                        pa.array(gram.view(np.int64)),
                    ],
                    ["doc_id", "h", "at", "gram"],
                )

    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").where("text is not null")
    shared = hashed.mapInArrow(find, f"doc_id {id_type}, h long, at long, gram long").join(of_items, "gram")
    band = F.floor((F.col("at") - F.col("place")) / (F.col("budget") + 1))
    hits = shared.select("doc_id", "h", "item", "at", "place", "budget", "least", band.alias("band")).distinct()
    bands = stored(
        hits.withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
        .groupBy("doc_id", "h", "item", "band", "budget").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least"))
        .where("n >= least").select("doc_id", "h", "item", "band", "budget"),
        "bench-bands",
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            wanted = [np.frombuffer(b, np.uint32) for b in batch.column("chars").to_pylist()]
            budget, band = batch.column("budget").to_numpy(), batch.column("band").to_numpy()
            out = np.full((3, n), -1, np.int64)
            texts = batch.column("text").to_pylist()
            for lo, hi in chunks(np.cumsum([0, *map(len, texts)]), CHUNK_BYTES):
                for at in range(lo, hi, 64):
                    some = slice(at, min(at + 64, hi))
                    chars, text, place = normalized(texts[some])
                    begins = np.searchsorted(text, np.arange(some.stop - some.start + 1))
                    base = first_diagonal(band[some], budget[some]) + begins[:-1]
                    edits, start, end = aligned(chars, wanted[some], budget[some], base, begins[:-1], begins[1:])
                    good = np.flatnonzero(edits <= budget[some])
                    out[0, at + good] = edits[good]
                    out[1, at + good] = place[start[good]]
                    out[2, at + good] = place[end[good] - 1] + 1
            good = pa.array(out[0] >= 0)
            kept = batch.filter(good).select(["doc_id", "h", "item"])
            spans = [pa.array(x[out[0] >= 0].astype(np.int32)) for x in out]
            yield pa.RecordBatch.from_arrays([*kept.columns, *spans], ["doc_id", "h", "item", "edits", "start", "end"])

    texts = hashed.alias("t").join(
        bands.select("doc_id", "h").distinct().alias("b"), _same_row("t", "b"), "left_semi"
    ).groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    wanted = bands.alias("b").join(texts.alias("t"), _same_row("b", "t")).select("b.*", "t.text")
    wanted = wanted.join(items.select("item", "chars").distinct(), "item").select(
        "doc_id", "h", "item", "band", "budget", "text", "chars"
    )
    found = wanted.mapInArrow(verify, f"doc_id {id_type}, h long, item long, edits int, start int, `end` int")
    best = found.groupBy("doc_id", "h", "item").agg(F.min(F.struct("edits", "start", "end")).alias("best"))
    return best.join(items.select("item", "item_id"), "item").select("doc_id", "h", "item_id", "best.*")


def _same_row(left: str, right: str) -> Column:
    """Rows with one doc_id, which may be null, and one text."""
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.h") == F.col(f"{right}.h"))


# --- both


def _in_memory(benchmark: DataFrame, q: int, share: float, index_chars: int) -> Searches | None:
    """The benchmark as indexes, if it has at most ``index_chars`` characters."""
    known = benchmark.where("text is not null").select("item_id", "text")
    total = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if total > index_chars:
        return None
    rows = sorted(known.collect(), key=lambda r: (r.item_id is None, r.item_id, r.text))
    return Searches.build([(r.item_id, r.text) for r in rows], q, share)


def _text_chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    texts = [t or "" for t in batch.column("text").to_pylist()]
    for lo, hi in chunks(np.cumsum([0, *map(len, texts)]), CHUNK_BYTES):
        yield lo, hi, texts[lo:hi]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    q: int = Q,
    share: float = EDIT_BUDGET,
    index_chars: int = INDEX_CHARS,
) -> DataFrame:
    """One row for each item of ``benchmark`` (item_id, text) found in a row of ``docs``.

    Returns doc_id, item_id, edits, start, end: the best passage, in code points of the
    text, end exclusive. Letters and digits are compared, in lower case, with one space
    for anything between them. An item is found where at most ``share`` of its
    characters are edited; one with fewer than ``2 * SHORT_Q`` characters where it is whole
    words, and one without any nowhere. Null or empty texts hold
    nothing. Items with one text are all reported. Rows of ``docs`` that repeat give
    repeated rows. Whole texts are searched, of any length.
    """
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {id_type}, item_id {item_type}, edits int, start int, `end` int"
    searches = _in_memory(benchmark, q, share, index_chars)
    if searches is None:
        found = stored(_joined(docs, benchmark, q, share), "bench-found")
        rows = docs.select("doc_id", F.xxhash64("text").alias("h"))
        columns = ["item_id", "edits", "start", "end"]
        return rows.alias("d").join(found.alias("f"), _same_row("d", "f")).select("d.doc_id", *columns)
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], shape).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            rows: list[tuple] = []
            for lo, _, texts in _text_chunks(batch):
                for t, item_ids, *span in searches.search(texts):
                    rows += [(ids[lo + t].as_py(), item_id, *span) for item_id in item_ids]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema
            )

    return docs.select("doc_id", "text").mapInArrow(run, shape)


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    q: int = Q,
    share: float = EDIT_BUDGET,
    index_chars: int = INDEX_CHARS,
) -> DataFrame:
    """``docs`` without the rows in which any item is found; with a small benchmark nothing is shuffled."""
    searches = _in_memory(benchmark, q, share, index_chars)
    if searches is None:
        found = stored(_joined(docs, benchmark, q, share).select("doc_id", "h").distinct(), "bench-found")
        same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64("d.text") == F.col("f.h"))
        return docs.alias("d").join(found.alias("f"), same, "left_anti").select(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for lo, _, texts in _text_chunks(batch):
                clean[[lo + t for t, *_ in searches.search(texts)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
