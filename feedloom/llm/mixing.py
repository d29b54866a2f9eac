"""Mixing sources to target weights.

Each source's words form one stream that is cut into blocks of a fixed number of
words. Multinomial draws say how many blocks of each source an output shard holds.
A source's slots are numbered through and mapped to its blocks by a pseudorandom
permutation per pass over the source, and slots and blocks meet by block number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stored
from feedloom.llm.words import WORD, mix
from feedloom.operators.prefix import carry_in

#: One row per source comes to the driver; more sources than this are refused.
MAX_SOURCES = 20_000
CHUNK_DOCS = 10_000
SLOTS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class Mix:
    block_words: int = 64
    n_shards: int = 64
    max_repeats: int = 3
    seed: int = 7


def targets(sizes: list[int], weights: list[float], total: float, most: int) -> list[float]:
    """Shares of ``total`` by weight; none above ``most`` times its size, the rest is reshared."""
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        by_weight = sum(weights[i] for i in free)
        share = {i: rest * weights[i] / by_weight for i in sorted(free)}
        over = [i for i, x in share.items() if x > most * sizes[i]]
        for i in over or sorted(free):
            out[i] = float(most * sizes[i]) if over else share[i]
        if not over:
            break
        free -= set(over)
        rest -= sum(out[i] for i in over)
    return out


def draw(quota: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Blocks by shard and source: multinomial per shard, given what is left of each source.

    Shards hold equal numbers of blocks. A draw beyond what is left of a source goes to
    the others, so a source's blocks add up to its quota exactly.
    """
    rng = np.random.default_rng(seed)
    left, out = quota.astype(np.int64).copy(), np.zeros((n_shards, len(quota)), np.int64)
    total = int(left.sum())
    for k in range(n_shards):
        need = total * (k + 1) // n_shards - total * k // n_shards
        while need:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[k] += got
            left -= got
            need -= int(got.sum())
    return out


def permuted(
    x: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 6
) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key, at x: Feistel, walking cycles."""
    bits = np.maximum(np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64), np.uint64(2))
    half = (bits + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.astype(np.uint64).copy(), np.arange(len(x))
    size = size.astype(np.uint64)
    while len(todo):
        h, m, k, v = half[todo], mask[todo], key[todo], out[todo]
        left, right = v >> h, v & m
        for r in range(rounds):
            left, right = right, left ^ (mix(mix(right + np.uint64(r << 48)) ^ k) & m)
        v = (left << h) | right
        out[todo] = v
        todo = todo[v >= size[todo]]
    return out.astype(np.int64)


@dataclass
class Mixture:
    """``docs`` with their place in a source's stream; ``sources``; ``slots`` of the mix."""

    docs: DataFrame
    sources: DataFrame
    slots: DataFrame
    plan: Mix

    def written(self, docs: DataFrame) -> DataFrame:
        """The mixture itself, stored: shard, slot, source_no, block, its text and its members.

        ``docs`` are the mixed documents. A member is what a document has in the block:
        its place in the source (``start``), and ``n_words``. A block's text is its
        members' words joined by spaces. Texts that are equal under one doc_id are
        fetched once.
        """
        b = self.plan.block_words
        texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").where("text is not null")
        if not self.docs.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
            texts = texts.groupBy("doc_id", "h").agg(F.first("text").alias("text"))
        placed = self.docs.where("size > 0").select("source_no", "start", "size", "doc_id", "h").alias("p")
        same = F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("p.h") == F.col("t.h"))
        words = placed.join(texts.alias("t"), same).select(
            "source_no", "start", "size", F.regexp_extract_all("t.text", F.lit(WORD), 0).alias("words")
        )
        # the part of the text in each block that it has words in
        block = F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block")
        first = F.greatest(F.col("start"), F.col("block") * b)
        n_words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - first
        at = (first - F.col("start") + 1).cast("int")
        parts = words.select("source_no", "start", "size", "words", block).select(
            "source_no", "block",
            F.struct(
                "start", n_words.alias("n_words"),
                F.array_join(F.slice("words", at, n_words.cast("int")), " ").alias("text"),
            ).alias("part"),
        )
        # stored, so that the texts' shuffle is gone before the next one
        parts = stored(parts, "mix-parts", compression="zstd")
        # a member has a word at least, so a block has at most as many members as words
        whole = parts.groupBy("source_no", "block").agg(F.sort_array(F.collect_list("part")).alias("parts"))
        mixed = self.slots.join(whole, ["source_no", "block"]).select(
            "shard", "slot", "source_no", "block",
            F.array_join(F.col("parts")["text"], " ").alias("text"),
            F.transform("parts", lambda x: x.dropFields("text")).alias("members"),
        )
        return stored(mixed, "mix-blocks", compression="zstd")

    def taken(self, written: DataFrame) -> DataFrame:
        """doc_id, source, size, taken and the source's size and target, a row per document.

        ``taken`` is counted in the written mixture.
        """
        used = (
            written.select("source_no", F.explode("members").alias("m"))
            .groupBy("source_no", F.col("m.start").alias("start"))
            .agg(F.sum("m.n_words").alias("taken"))
        )
        # no two documents with words begin at one place of a source
        some = self.docs.where("size > 0").join(used, ["source_no", "start"], "left")
        none = self.docs.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
        every = some.withColumn("taken", F.coalesce("taken", F.lit(0))).unionByName(none)
        return every.join(self.sources, "source_no").drop("start", "h")


def mixture(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), plan: Mix | None = None
) -> Mixture:
    """Mix all of ``docs`` (doc_id, text, source).

    Sources in the order of their code points, null last, have ``weights`` in turn and
    share as many words as there are. A target stops at ``max_repeats`` times the
    source's size and what is above is shared anew. No block, so no document, is taken
    more often than that. Null and empty texts have size 0 and are never taken. Rows that
    repeat are documents of their own. An empty table gives an empty mixture.
    """
    plan = plan or Mix()
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    hashed = F.xxhash64("text").alias("h")
    sized = stored(docs.select("doc_id", "source", size.alias("size"), hashed), "mix-sizes")
    per_source = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    rows = per_source.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.source_size) for r in rows]
    share = targets(
        sizes, [weights[i % len(weights)] for i in range(len(rows))], sum(sizes), plan.max_repeats
    )
    n_blocks = np.array([-(-s // plan.block_words) for s in sizes], np.int64)
    quota = np.array(
        [
            min(round(t * n / s), plan.max_repeats * int(n)) if s else 0
            for t, n, s in zip(share, n_blocks, sizes, strict=True)
        ],
        np.int64,
    )
    sources = spark.createDataFrame(
        [(i, r.source, s, t) for i, (r, s, t) in enumerate(zip(rows, sizes, share, strict=True))],
        "source_no int, source string, source_size long, target double",
    )
    # Any order will do that comes out the same each time; hashed chunks bound the windows.
    n_chunks = max(1, sum(int(r.n_docs) for r in rows) // CHUNK_DOCS)
    numbered = sized.join(
        sources.select("source_no", F.col("source").alias("of")), F.col("source").eqNullSafe(F.col("of"))
    ).select(
        "source_no", "doc_id", "size", "h",
        F.pmod(F.xxhash64("doc_id", "h"), F.lit(n_chunks)).alias("chunk"),
    )
    before = carry_in(numbered, ["source_no"], "chunk", F.sum("size"), F.sum, "before")
    inside = (
        F.sum("size").over(
            _window("source_no", "chunk").orderBy("doc_id", "size", "h").rowsBetween(_ALL, 0)
        )
        - F.col("size")
    )
    start = F.coalesce("before", F.lit(0)) + inside
    placed = stored(before.withColumn("start", start).drop("before", "chunk"), "mix-docs")
    return Mixture(placed, sources, _slots(spark, quota, n_blocks, plan), plan)


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


_ALL = -(2**63)


def _slots(spark, quota: np.ndarray, n_blocks: np.ndarray, plan: Mix) -> DataFrame:
    """shard, slot (its number in the source), source_no and block of every slot."""
    shape = "shard int, slot long, source_no int, block long"
    total = int(quota.sum())
    if not total:
        return spark.createDataFrame([], shape)
    counts = draw(quota, plan.n_shards, plan.seed)
    first = np.cumsum(counts, axis=0) - counts
    ends = np.cumsum(counts.ravel())
    n_sources, seed = len(quota), plan.seed

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            i = batch["id"].to_numpy()
            cell = np.searchsorted(ends, i, "right")
            shard, source = cell // n_sources, cell % n_sources
            slot = first.ravel()[cell] + i - (ends - counts.ravel())[cell]
            n = n_blocks[source]
            key = mix(mix(source.astype(np.uint64) + np.uint64(seed << 32)) ^ (slot // n).astype(np.uint64))
            yield pd.DataFrame(
                {
                    "shard": shard.astype(np.int32),
                    "slot": slot,
                    "source_no": source.astype(np.int32),
                    "block": permuted(slot % n, n, key),
                }
            )

    tasks = -(-total // SLOTS_PER_TASK)
    return spark.range(0, total, 1, tasks).mapInPandas(expand, shape)
