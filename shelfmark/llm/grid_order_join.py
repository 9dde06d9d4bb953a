"""Near-duplicate vectors by an epsilon grid order join.

Vectors of one label that are near in angle are near as unit vectors.  Unit vectors are rotated onto their principal axes
and sorted by the cells of a grid with sides epsilon on the leading axes: any two within epsilon lie in equal or adjacent
cells of every axis.  The sorted sequence is cut into runs; pairs of runs whose boxes are further apart than epsilon on the
leading axes are skipped, the others are joined by halving both sequences until they are small or provably distant.  The
rotation keeps distances, so nothing is lost; found pairs are checked by their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.base import stored
from shelfmark.llm.components import Forest, components

THRESHOLD = 0.93
#: Leading axes that order and prune; vectors the axes are fitted on, at most; vectors of a run; and of a compared block.
AXES, SAMPLE, RUN, BLOCK = 6, 5_000, 1_000, 256


def epsilon(threshold: float) -> float:
    """Distance of unit vectors with this cosine, widened by more than rounding can take."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-9)


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal leading axes (rows) of the sample's scatter; any orthonormal axes are right, these separate best."""
    if not len(sample):
        return np.zeros((0, 0))
    centred = sample - sample.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred)
    return vectors[:, np.argsort(-values)[:AXES]].T


def _apart(a: np.ndarray, b: np.ndarray, reach: float) -> bool:
    """Whether the boxes around two sets of projected points are further apart than ``reach``."""
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(gap @ gap) > reach * reach


def joined(
    left: np.ndarray, right: np.ndarray | None, left_at: np.ndarray, right_at: np.ndarray | None, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= threshold between two sequences of vectors (``right`` None: within one), block by block.

    ``left_at`` and ``right_at`` are the projections, in grid order.  The vectors need not be of unit length.
    """
    same = right is None
    if same:
        right, right_at = left, left_at
    reach = epsilon(threshold)
    norms = np.sqrt(np.einsum("ij,ij->i", left, left)), np.sqrt(np.einsum("ij,ij->i", right, right))
    todo = [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or same and c >= b or _apart(left_at[a:b], right_at[c:d], reach):
            continue
        if max(b - a, d - c) > BLOCK:
            if b - a >= d - c:
                todo += [(a, (a + b) // 2, c, d), ((a + b) // 2, b, c, d)]
            else:
                todo += [(a, b, c, (c + d) // 2), (a, b, (c + d) // 2, d)]
            continue
        cosine = (left[a:b] @ right[c:d].T) / norms[0][a:b, None] / norms[1][None, c:d]
        i, j = np.nonzero(cosine >= threshold)
        i, j = i + a, j + c
        if same:  # each pair of the sequence once
            i, j = i[j < i], j[j < i]
        if len(i):
            yield i, j


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding (doubles) of the rows that can link."""
    x = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = vectors.select("vec_id", "label", x.alias("embedding")).where("label IS NOT NULL AND embedding IS NOT NULL")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda v: v != 0.0))


def _sequences(classes: DataFrame, threshold: float) -> DataFrame:
    """Classes in grid order: label, dims, the run they are in, place, projections and embedding."""
    total = classes.count()
    share = min(1.0, SAMPLE / max(1, total))
    chosen = classes.where(F.pmod(F.xxhash64("class"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("embedding", "dims").collect()
    by_size: dict[int, list] = {}
    for r in chosen:
        by_size.setdefault(r["dims"], []).append(r["embedding"])
    axes = {}
    for dims, rows in by_size.items():
        x = np.array(rows)
        axes[dims] = principal_axes(x / np.abs(x).max(1, keepdims=True) / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True))
    side = epsilon(threshold)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells = [], []
            for row in batch.column(3).to_pylist():
                x = np.array(row)
                x /= np.abs(x).max()
                own = axes.get(len(x))
                y = own @ (x / np.linalg.norm(x)) if own is not None else np.zeros(1)
                at.append(y.tolist())
                cells.append(np.floor(y / side).astype(int).tolist())
            columns = [*batch.columns, pa.array(at, pa.list_(pa.float64())), pa.array(cells, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["class", "label", "dims", "embedding", "at", "cells"])

    rows = classes.select("class", "label", "dims", "embedding").mapInArrow(
        projected, "class long, label int, dims int, embedding array<double>, at array<double>, cells array<int>"
    )
    order = ["label", "dims", "cells", "at", "class"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    return stored(ranged.withColumn("place", place).withColumn("run", F.floor(place / RUN).cast("long")), "grid_order")


def links(classes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Partners of every class, and links that give the components, from distinct vectors.

    ``classes`` has class (a number), label, dims, embedding and copies.  The first result is class and partners: the summed
    copies of the classes it links with.  The second is a and b.  Runs end at a label's end; a run meets the runs of its label
    that its box does not rule out, so the largest task holds two runs, however many rows a label has.
    """
    rows = _sequences(classes.drop("copies"), threshold).join(classes.select("class", "copies"), "class")
    rows = stored(rows, "runs")
    # boxes: a run has RUN rows at most, so boxes are few; they meet by label and by adjacent slabs of the first axis
    box = rows.groupBy("label", "dims", "run").agg(
        *[f(F.get("at", F.lit(k))).alias(f"{n}{k}") for k in range(AXES) for f, n in ((F.min, "low"), (F.max, "high"))]
    )
    side = epsilon(threshold)
    slab = lambda c: F.floor(F.coalesce(F.col(c), F.lit(0.0)) / side)
    box = box.withColumn("slabs", F.sequence(slab("low0"), slab("high0")))
    near = box.select("*", F.explode(F.array_distinct(F.flatten(F.transform("slabs", lambda s: F.array(s - 1, s, s + 1))))).alias("slab"))
    other = box.select(*[F.col(c).alias(f"o_{c}") for c in box.columns], F.explode("slabs").alias("slab"))
    gaps = [
        F.greatest(F.lit(0.0), F.col(f"low{k}") - F.col(f"o_high{k}"), F.col(f"o_low{k}") - F.col(f"high{k}")) for k in range(AXES)
    ]
    distance = sum((F.coalesce(g * g, F.lit(0.0)) for g in gaps), F.lit(0.0))
    pairs = near.join(other, (F.col("label") == F.col("o_label")) & (F.col("dims") == F.col("o_dims")) & (near["slab"] == other["slab"]))
    pairs = pairs.where((F.col("run") <= F.col("o_run")) & (distance <= side * side))
    pairs = stored(pairs.select("label", "dims", F.col("run").alias("one"), F.col("o_run").alias("two")).distinct(), "run_pairs")
    sides = pairs.select("label", "dims", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("run"))
    met = sides.join(rows, ["label", "dims", "run"])

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        x, at = np.vstack(group["embedding"]), np.vstack(group["at"])
        x /= np.abs(x).max(1, keepdims=True)
        first = (group["run"] == group["one"]).to_numpy()
        names, copies = group["class"].to_numpy(), group["copies"].to_numpy()
        left = np.flatnonzero(first)
        right = left if first.all() else np.flatnonzero(~first)
        found = joined(x[left], None if first.all() else x[right], at[left], None if first.all() else at[right], threshold)
        partners, forest = np.zeros(len(group), np.int64), Forest()
        for i, j in found:
            i, j = left[i], right[j]
            np.add.at(partners, i, copies[j])
            np.add.at(partners, j, copies[i])
            for a, b in zip(names[i].tolist(), names[j].tolist(), strict=True):
                forest.join(a, b)
        stars = np.array(forest.stars(), np.int64).reshape(-1, 2)
        linked = np.flatnonzero(partners)
        return pd.DataFrame({
            "a": np.concatenate([names[linked], stars[:, 0]]),
            "b": np.concatenate([np.full(len(linked), -1), stars[:, 1]]),
            "partners": np.concatenate([partners[linked], np.zeros(len(stars), np.int64)]),
        })

    found = stored(met.groupBy("label", "dims", "one", "two").applyInPandas(compared, "a long, b long, partners long"), "grid_links")
    partners = found.where("b = -1").groupBy(F.col("a").alias("class")).agg(F.sum("partners").alias("partners"))
    return partners, found.where("b >= 0").select("a", "b")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows are compared only within a label that is not null and with vectors of their own length.  Null and zero vectors and those
    with null or non-finite parts link with nothing and are their own component.  Equal vectors of a label are one class before
    anything is compared, each linked with its copies.  Repeated ids are rows of their own and share their component.
    """
    usable = _usable(vectors)
    dealt = usable.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
    dealt = dealt.withColumn("dims", F.size("embedding")).withColumn("class", F.monotonically_increasing_id())
    classes = stored(dealt, "vector_classes")
    partners, pairs = links(classes.drop("first"), threshold)
    groups = components(pairs).toDF("class", "component")
    named = classes.join(groups, "class", "left").join(partners, "class", "left")
    named = named.select(
        "label", "embedding", "first", F.coalesce("component", "class").alias("component"),
        (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(firsts, "component").select("label", "embedding", "n_links", "component_id")
    own = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))
    rows = vectors.select("vec_id", "label", own.alias("embedding")).join(named, ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
