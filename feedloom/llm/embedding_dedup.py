"""Near-duplicate vectors: spherical k-means cells and blocked cosine products.

A pair in two cells isn't lost: a vector also visits each cell of a lower number whose
border with its own cell lies within the angle of the threshold, and any vector within
that angle on the other side of the border is compared with it there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stored
from feedloom.llm.components import components

THRESHOLD = 0.93
#: k-means is fitted on a sample of at most about this many rows or bytes.
FIT_ROWS, FIT_BYTES = 20_000, 32_000_000
#: A cell for so many vectors of the largest label, up to 16 million; beyond that cells grow.
CELL_ROWS, MAX_CELLS = 4_000, 4_096
#: Rows of one side of a blocked product.
BLOCK_ROWS = 1_500

Centroids = dict[int, np.ndarray]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Unit centroids of unit rows. A cell that runs empty keeps its centroid."""
    k = min(k, len(x))
    centers = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        cell = np.concatenate([(x[at : at + 2_000] @ centers.T).argmax(1) for at in range(0, len(x), 2_000)])
        total = np.zeros_like(centers)
        np.add.at(total, cell, x)
        norm = np.sqrt((total * total).sum(1))
        good = norm > 1e-9
        centers[good] = total[good] / norm[good, None]
    return np.unique(centers, axis=0)


def usable(embedding: Column, label: Column) -> Column:
    """Vectors that can link: labelled, not empty, all components finite, not all zero."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    ok = label.isNotNull() & embedding.isNotNull() & ~odd & some
    return F.coalesce(ok, F.lit(False))


def fit_centroids(vectors: DataFrame) -> Centroids:
    """Centroids by dimension, from a bounded sample chosen by a hash of ``rep``.

    Vectors only meet inside their label, so the largest label settles how many cells
    there are.
    """
    per_label = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim"))
    n, widest, largest = per_label.agg(F.sum("n"), F.max("dim"), F.max("n")).first()
    if not n:
        return {}
    rows = min(FIT_ROWS, max(1, FIT_BYTES // (4 * widest)))
    share = min(1.0, rows / n)
    chosen = F.pmod(F.xxhash64("rep", "label"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    sample = vectors.where(chosen).select("rep", "dim", "embedding").toPandas()
    out = {}
    for dim, part in sample.sort_values("rep").groupby("dim"):
        x = unit(np.stack(part["embedding"].to_numpy()))
        out[int(dim)] = spherical_kmeans(x, min(MAX_CELLS, max(1, round(largest / CELL_ROWS))))
    return out


def _cells(vectors: DataFrame, centroids: Centroids, threshold: float) -> DataFrame:
    """Each vector in its own cell, and as a visitor in those it must be compared in."""
    reach = np.sin(np.arccos(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            begin = np.cumsum(dims) - dims
            rows, cells, home = [], [], []
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                centers = centroids.get(int(dim))
                if centers is None or len(centers) == 1:
                    near, visits = np.zeros(len(own), np.int64), np.zeros((len(own), 1), bool)
                else:
                    x = unit(flat[begin[own][:, None] + np.arange(dim)])
                    likeness = x @ centers.T
                    near = likeness.argmax(1)
                    apart = np.sqrt(np.maximum(0, 2 - 2 * (centers[near] @ centers.T)))
                    gap = likeness[np.arange(len(own)), near][:, None] - likeness
                    visits = gap <= apart * reach + 1e-9
                    visits &= np.arange(len(centers))[None, :] < near[:, None]
                r, c = np.nonzero(visits)
                rows += [own, own[r]]
                cells += [near, c]
                home += [np.ones(len(own), bool), np.zeros(len(r), bool)]
            out = batch.take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays(
                [
                    *out.columns,
                    pa.array(np.concatenate(cells).astype(np.int32)),
                    pa.array(np.concatenate(home)),
                ],
                [*out.schema.names, "cell", "home"],
            )

    kinds = dict(vectors.dtypes)
    shape = ", ".join(f"{c} {kinds[c]}" for c in vectors.columns) + ", cell int, home boolean"
    return vectors.mapInArrow(run, shape)


def _blocked(cells: DataFrame) -> DataFrame:
    """Rows dealt out to block products: key columns, ``side`` and the row.

    A cell's own rows form blocks that meet each other once; visitors form blocks that
    meet every block of own rows.
    """
    key = ["label", "dim", "cell"]
    sizes = cells.groupBy(*key).agg(
        F.count_if("home").alias("n_home"), F.count_if(~F.col("home")).alias("n_visit")
    )
    blocks = stored(
        sizes.where("n_home > 0").select(
            *key,
            F.ceil(F.col("n_home") / BLOCK_ROWS).cast("int").alias("homes"),
            F.ceil(F.col("n_visit") / BLOCK_ROWS).cast("int").alias("guests"),
        ),
        "vector-blocks",
    )
    rows = cells.join(blocks, key)
    spread = F.xxhash64("rep", "label")
    own = F.pmod(spread, F.col("homes")).cast("int")
    guest = F.pmod(spread, F.col("guests")).cast("int")

    def pair(a: Column, b: Column, side: int, kind: str) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), F.lit(side).alias("side")
        )

    def upto(first: Column, last: Column, make) -> Column:
        numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, make)

    last_home, last_guest, zero = F.col("homes") - 1, F.col("guests") - 1, F.lit(0)
    of_home = F.concat(
        upto(own, last_home, lambda j: pair(own, j, 0, "own")),
        upto(zero, own - 1, lambda i: pair(i, own, 1, "own")),
        upto(zero, last_guest, lambda j: pair(own, j, 0, "guest")),
    )
    of_guest = upto(zero, last_home, lambda i: pair(i, guest, 1, "guest"))
    return rows.select(
        *key, "rep", "n", "embedding",
        F.explode(F.when(F.col("home"), of_home).otherwise(of_guest)).alias("p"),
    ).select(*key, "p.kind", "p.a", "p.b", "p.side", "rep", "n", "embedding")


def _product(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, a, b = key[3], key[4], key[5]
        rows = rows.sort_values(["side", "rep"])
        x = unit(np.stack(rows["embedding"].to_numpy()))
        left = (rows["side"] == 0).to_numpy()
        same = kind == "own" and a == b
        ids, n = rows["rep"].to_numpy(), rows["n"].to_numpy()
        i, j = np.flatnonzero(left), np.flatnonzero(left if same else ~left)
        near = (x[i] @ x[j].T) >= threshold
        if same:
            np.fill_diagonal(near, False)
        links = np.zeros(len(ids), np.int64)
        links[i] += near @ n[j]
        if not same:
            links[j] += near.T @ n[i]
        # least id among those reachable inside this product
        ordered = np.sort(ids)  # ids of any type, as numbers in their order
        root, some = np.searchsorted(ordered, ids), np.zeros(len(ids), bool)
        r, c = np.nonzero(near)
        r, c = i[r], j[c]
        some[r] = some[c] = True
        while len(r):
            least = np.minimum(root[r], root[c])
            new = root.copy()
            np.minimum.at(new, r, least)
            np.minimum.at(new, c, least)
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({"rep": ids[some], "links": links[some], "root": ordered[root[some]]})

    return run


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of (vec_id, embedding, label).

    Rows of one label (not null) and one dimension link when their cosine, in double
    precision, is at least ``threshold``. Null, empty or zero vectors, vectors with a null
    or non-finite component, and rows without vec_id or label link with nothing and are
    their own component (null for a null vec_id, which isn't kept). Equal vectors of a
    label are compared as one and count as linked with each other; rows that repeat are
    vectors of their own, so they link, and as they have one vec_id all or none are kept.
    Other columns are not looked at.
    """
    id_type = embeddings.schema["vec_id"].dataType.simpleString()
    value = F.col("embedding")
    ok = usable(value, F.col("label")) & F.col("vec_id").isNotNull()
    rows = stored(
        embeddings.select(
            "vec_id", "label",
            F.when(ok, F.xxhash64("embedding")).alias("h1"),
            F.when(ok, F.hash("embedding", F.lit(1))).alias("h2"),
        ),
        "vector-rows",
    )
    with_hash = embeddings.where(ok).select(
        "vec_id", "label", "embedding",
        F.xxhash64("embedding").alias("h1"), F.hash("embedding", F.lit(1)).alias("h2"),
    )
    reps = stored(
        with_hash.groupBy("label", "h1", "h2").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")
        ).withColumn("dim", F.size("embedding")),
        "vector-reps",
    )
    vectors = reps.select("label", "dim", "rep", "n", "embedding")
    cells = stored(_cells(vectors, fit_centroids(vectors), threshold), "vector-cells")
    found = stored(
        _blocked(cells)
        .groupBy("label", "dim", "cell", "kind", "a", "b")
        .applyInPandas(_product(threshold), f"rep {id_type}, links long, root {id_type}"),
        "vector-links",
    )
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    classes = stored(
        reps.select("label", "h1", "h2", "rep", "n")
        .join(linked, "rep", "left")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select(
            "label", "h1", "h2",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        ),
        "vector-classes",
    )
    out = rows.join(classes, ["label", "h1", "h2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return out.withColumn("kept", kept)
