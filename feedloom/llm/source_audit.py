"""Source divergence audit: how far the sources of a language stand apart, and by which terms.

The counts of a language's terms in its sources are a matrix with a row for each group
(language and source) and a column for each kept term, mostly zeros. It is cut into tiles
of 64 groups by a block of terms. A tile's zeros are kept as a quadtree (k² with
k = 2): bitmaps that say, for squares of 64, 32, 16, 8 and 4 cells, which hold a count.
For two tiles of the same terms, the trees are walked together. Where both groups'
squares are all zero, every cell has the same price, so it is priced once and multiplied
by the columns it spans, and nothing below it is visited. Leaves with a count in either
are worked out cell by cell for all their pairs of groups at once. Terms that no tile of
a pair holds are one more square of zeros.

All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import stored
from feedloom.llm.words import LOWER, chunks, text_bytes

#: Kept terms occur in at least so many documents of their language.
LEAST_DOCS = 3
#: Terms reported for a group.
TOP = 200
#: Counts are shares of so many parts.
PARTS = 1_000_000_000
LEAF = 4


@dataclass(frozen=True)
class Sizes:
    """How the work is cut; none of it changes a result."""

    rows: int = 64  # groups of a tile: a power of two, 4 at least
    cells: int = 50_000  # counts of a tile, about
    strips: int = 64  # largest squares walked together
    leaves: int = 16_384  # leaves worked out at once
    counted_bytes: int = 16_000_000  # text counted together before Spark adds the counts up


_LETTER = np.ones(256, bool)
_LETTER[:128] = False
_LETTER[65:91] = _LETTER[97:123] = True


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of the texts in order, A-Z in lower case, and the number of each one's text."""
    letter = _LETTER[data]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = letter[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = letter[at]
    starts = np.flatnonzero(first)
    lens = np.flatnonzero(last) + 1 - starts
    place = np.r_[0, np.cumsum(lens)].astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(place), pa.py_buffer(LOWER[data[letter]]))
    return words.dictionary_encode(), np.searchsorted(offsets, starts, "right") - 1


def _counted(rows: pa.Table, sizes: Sizes) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    group = pc.binary_join_element_wise(rows["lang"], rows["source"], "\0").combine_chunks().dictionary_encode()
    own = pc.index_in(pa.array(np.arange(len(group.dictionary)), pa.int32()), group.indices).to_numpy()
    text = rows["text"].combine_chunks()
    data, offsets = text_bytes(text)
    for lo, hi in chunks(offsets, sizes.counted_bytes):
        words, doc = _terms(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        n_words = max(len(words.dictionary), 1)
        # once for each document, then for each group
        pair, n = np.unique(doc * n_words + words.indices.to_numpy(), return_counts=True)
        cell = group.indices.to_numpy()[lo + pair // n_words].astype(np.int64) * n_words + pair % n_words
        order = np.argsort(cell, kind="stable")
        cell, n = cell[order], n[order]
        begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else cell
        at = own[cell[begin] // n_words]
        yield pa.RecordBatch.from_arrays(
            [
                rows["lang"].combine_chunks().take(pa.array(at)),
                rows["source"].combine_chunks().take(pa.array(at)),
                words.dictionary.take(pa.array(cell[begin] % n_words)),
                pa.array(np.add.reduceat(n, begin) if len(begin) else n, pa.int64()),
                pa.array(np.diff(np.r_[begin, len(cell)]), pa.int64()),
            ],
            ["lang", "source", "term", "n", "docs"],
        )


def term_counts(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """lang, source, term, n (occurrences) and docs, in several rows that add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= sizes.counted_bytes:
                yield from _counted(pa.Table.from_batches(held), sizes)
                held, size = [], 0
        if held:
            yield from _counted(pa.Table.from_batches(held), sizes)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


# --- tiles


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(PARTS * (n + 1) / total), for totals up to 9e15."""
    whole, left = np.divmod(n + 1, total)
    for _ in range(3):
        digits, left = np.divmod(left * 1000, total)
        whole = whole * 1000 + digits
    return 1 + whole


def _prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _bitmaps(some: np.ndarray) -> list[np.ndarray]:
    """Which squares hold a count, from squares as high as the tile down to leaves."""
    rows, cols = some.shape
    level = some.reshape(rows // LEAF, LEAF, cols // LEAF, LEAF).any((1, 3))
    out = [level]
    while level.shape[0] > 1:
        r, c = level.shape
        level = level.reshape(r // 2, 2, c // 2, 2).any((1, 3))
        out.append(level)
    return out[::-1]


def _blocks(p: np.ndarray) -> np.ndarray:
    rows, cols = p.shape
    return p.reshape(rows // LEAF, LEAF, cols // LEAF, LEAF).transpose(0, 2, 1, 3)


def divergence(a: tuple, b: tuple, one_tile: bool, sizes: Sizes = Sizes()) -> np.ndarray:
    """For all groups i of tile ``a`` and j of ``b``: the sum of prices of i against j, and of j against i.

    A tile is its shares (rows by columns), where it has counts, the share of a zero in
    each row, and the number of its rows that are groups.
    """
    (pa_, some_a, zero_a, n_a), (pb, some_b, zero_b, n_b) = a, b
    maps_a, maps_b = _bitmaps(some_a), _bitmaps(some_b)
    blocks_a, blocks_b = _blocks(pa_), _blocks(pb)
    rows = len(pa_)
    leaves = rows // LEAF
    out = np.zeros((2, leaves, leaves, LEAF, LEAF), np.int64)
    empty = np.zeros((leaves, leaves), np.int64)  # columns in which both are zero, of leaves' rows
    n_strips = maps_a[0].shape[1]
    for strip in range(0, n_strips, sizes.strips):
        c = np.arange(strip, min(strip + sizes.strips, n_strips))
        r, s = np.zeros_like(c), np.zeros_like(c)
        for level in range(len(maps_a)):
            side = rows >> level  # cells of a square
            if level:
                half = np.arange(8)
                r = (r[:, None] * 2 + (half >> 2)).ravel()
                s = (s[:, None] * 2 + (half >> 1 & 1)).ravel()
                c = (c[:, None] * 2 + (half & 1)).ravel()
                real = (r * side < n_a) & (s * side < n_b)
                r, s, c = r[real], s[real], c[real]
            some = maps_a[level][r, c] | maps_b[level][s, c]
            zeros = np.zeros((1 << level, 1 << level), np.int64)
            np.add.at(zeros, (r[~some], s[~some]), side)
            empty += zeros.repeat(leaves >> level, 0).repeat(leaves >> level, 1)
            r, s, c = r[some], s[some], c[some]
        for at in range(0, len(r), sizes.leaves):
            i, j, k = (x[at : at + sizes.leaves] for x in (r, s, c))
            p, q = blocks_a[i, k][:, :, None, :], blocks_b[j, k][:, None, :, :]
            np.add.at(out[0], (i, j), _prices(p, q).sum(3))
            if not one_tile:
                np.add.at(out[1], (i, j), _prices(q, p).sum(3))
    spans = empty.repeat(LEAF, 0).repeat(LEAF, 1)
    full = out.transpose(0, 1, 3, 2, 4).reshape(2, rows, rows)
    full[0] += spans * _prices(zero_a[:, None], zero_b[None, :])
    full[1] += spans * _prices(zero_b[None, :], zero_a[:, None])
    return full


_SHAPE = "lang string, g int, o int, term string, value long, width long"


def _tile(rows: pa.Table, sizes: Sizes, top: int) -> pa.Table:
    """Sums of prices for the groups of two tiles, and the terms that stand out in each group."""
    lang, a, b = (rows[c][0].as_py() for c in ("lang", "a", "b"))
    heads = rows.filter(pc.is_null(rows["term"]))
    cells = rows.filter(pc.is_valid(rows["term"])).combine_chunks()
    none = pa.table([pa.array([], t) for t in (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())],
                    names=["lang", "g", "o", "term", "value", "width"])
    if not len(cells):
        return none
    term = cells["term"].combine_chunks().dictionary_encode()
    row, n = cells["g"].to_numpy(), cells["n"].to_numpy()
    total = cells["total"].to_numpy()  # the lang's count of the term
    column = term.indices.to_numpy()
    n_columns = len(term.dictionary)
    # columns with the same groups stand together, so that zeros do too
    mask = np.zeros(n_columns, np.uint64)
    np.bitwise_or.at(mask, column, np.uint64(1) << (row % 64).astype(np.uint64))
    place = np.empty(n_columns, np.int64)
    place[np.lexsort((mask, np.bitwise_count(mask)))] = np.arange(n_columns)
    width = -(-n_columns // sizes.rows) * sizes.rows
    kept_terms, lang_sum = int(heads["v"][0].as_py()), int(heads["lang_n"][0].as_py())
    for block in {a, b}:
        own = heads.filter(pc.equal(pc.divide(heads["g"], sizes.rows), block))
        sums = np.zeros(sizes.rows, np.int64)
        sums[own["g"].to_numpy() % sizes.rows] = own["sum_n"].to_numpy()
        inside = row // sizes.rows == block
        i, j = row[inside] % sizes.rows, place[column[inside]]
        some = np.zeros((sizes.rows, width), bool)
        some[i, j] = True
        zero = shares(np.zeros(sizes.rows, np.int64), sums + kept_terms)
        p = np.repeat(zero[:, None], width, 1)
        p[i, j] = shares(n[inside], (sums + kept_terms)[i])
        tile = (p, some, zero, len(own))
        if block == a:
            first = tile
        if block == b:
            second = tile
    found = divergence(first, second, a == b, sizes)
    out = []
    for turned, (x, y, x_rows, y_rows) in enumerate(((a, b, first[3], second[3]), (b, a, second[3], first[3]))):
        if turned and a == b:
            break
        value = found[turned].T if turned else found[turned]
        i, j = np.meshgrid(np.arange(x_rows), np.arange(y_rows), indexing="ij")
        i, j = i.ravel(), j.ravel()
        out.append(pa.table({
            "lang": pa.array([lang] * len(i), pa.string()),
            "g": pa.array((i + x * sizes.rows).astype(np.int32)), "o": pa.array((j + y * sizes.rows).astype(np.int32)),
            "term": pa.nulls(len(i), pa.string()),
            "value": pa.array(value[i, j]), "width": pa.array(np.full(len(i), width)),
        }))
    if a == b:  # the leaves of each group with the language's own row
        p = first[0][row % sizes.rows, place[column]]
        q = shares(total, np.int64(lang_sum + kept_terms))
        above = np.flatnonzero(p > q)
        names = pc.rank(term.dictionary.cast(pa.binary()), "ascending").to_numpy().astype(np.int64)
        value = _prices(p[above], q[above])
        order = np.lexsort((names[column[above]], -value, row[above]))
        above, value = above[order], value[order]
        g = row[above]
        begin = np.searchsorted(g, g)
        first_ones = np.arange(len(g)) - begin < top
        above, value, g = above[first_ones], value[first_ones], g[first_ones]
        out.append(pa.table({
            "lang": pa.array([lang] * len(g), pa.string()),
            "g": pa.array(g.astype(np.int32)), "o": pa.nulls(len(g), pa.int32()),
            "term": term.dictionary.take(pa.array(column[above])),
            "value": pa.array(value), "width": pa.nulls(len(g), pa.int64()),
        }))
    return pa.concat_tables(out)


def audit(docs: DataFrame, top: int = TOP, sizes: Sizes = Sizes()) -> DataFrame:
    """lang, source, part, item, value and rank for ``docs`` (lang, source, text).

    Part ``pair``: each other source of the language and the sum of prices against it;
    part ``term``: the terms the source uses more than its language does, the first
    ``top``. A null lang, source or text is empty. Rows are documents, so a repeated one
    counts again. Ties go by the item's bytes. A group without terms, or of a language
    without kept terms, still has its pairs; an empty table gives no row. Other columns
    are not looked at.
    """
    filled = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    of_term = Window.partitionBy("lang", "term")
    kept = stored(
        term_counts(filled, sizes).repartition("lang", "term")
        .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumn("in_docs", F.sum("docs").over(of_term)).withColumn("total", F.sum("n").over(of_term))
        .where(F.col("in_docs") >= LEAST_DOCS).select("lang", "term", "source", "n", "total"),
        "audit-cells",
    )
    of_lang = kept.groupBy("lang", "source").agg(F.sum("n").alias("sum_n"), F.count(F.lit(1)).alias("cells"))
    distinct = kept.groupBy("lang").agg(F.countDistinct("term").alias("v"))
    every = Window.partitionBy("lang")
    groups = stored(
        filled.select("lang", "source").distinct()
        .join(of_lang, ["lang", "source"], "left").join(distinct, "lang", "left")
        .fillna(0, ["sum_n", "cells", "v"])
        .withColumn("lang_n", F.sum("sum_n").over(every))
        .withColumn("blocks", F.ceil(F.sum("cells").over(every) / sizes.cells).cast("int"))
        .withColumn("g", F.row_number().over(every.orderBy("source")) - 1)
        .withColumn("row_blocks", F.floor((F.count(F.lit(1)).over(every) - 1) / sizes.rows).cast("int")),
        "audit-groups",
    )

    def dealt(rows: DataFrame) -> DataFrame:
        """Every tile meets those of the same terms: (a, b) with a <= b."""
        own = F.floor(F.col("g") / sizes.rows).cast("int")
        return (
            rows.withColumn("other", F.explode(F.sequence(F.lit(0), "row_blocks")))
            .withColumn("a", F.least(own, "other")).withColumn("b", F.greatest(own, "other"))
            .select("lang", "block", "a", "b", "g", "sum_n", "v", "lang_n", "term", "n", "total")
        )

    # a row for each group of a tile, and one for each count
    heads = groups.where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    heads = heads.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("term", "string"), ("n", "long"), ("total", "long"))))
    cells = kept.join(groups, ["lang", "source"]).withColumn(
        "block", F.pmod(F.xxhash64("term"), "blocks").cast("int")
    )
    tiles = stored(
        dealt(heads).unionByName(dealt(cells)).groupBy("lang", "block", "a", "b").applyInArrow(lambda rows: _tile(rows, sizes, top), _SHAPE),
        "audit-tiles",
    )
    named = groups.select("lang", "g", "source")

    # pairs: what the tiles found, and the zeros of all other columns
    x = groups.select("lang", "g", "source", "sum_n", "v")
    y = groups.select("lang", F.col("g").alias("o"), F.col("source").alias("item"), F.col("sum_n").alias("other_n"))
    sums = tiles.where("term is null").groupBy("lang", "g", "o").agg(
        F.sum("value").alias("value"), F.sum("width").alias("width")
    )
    share = lambda n: f"1 + {PARTS}L div greatest({n} + v, 1)"
    pairs = (
        x.join(y, "lang").where("g <> o").join(sums, ["lang", "g", "o"], "left").fillna(0, ["value", "width"])
        .withColumn("p", F.expr(share("sum_n"))).withColumn("q", F.expr(share("other_n")))
        .withColumn("value", F.expr("if(v = 0, 0, value + (v - width) * (((p - q) * (p - q)) div q))"))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    terms = tiles.where("term is not null").join(named, ["lang", "g"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value"
    )
    by_value = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(by_value))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))
