"""Merkle manifest of a dataset: a leaf for each row, a tree of digests for each source, one over the sources, and proofs.

A leaf digests a row's fields. A source's leaves ascend by id; every ``FAN`` consecutive nodes become one until one is left, the
subroot; the subroots, ordered by source, become the root the same way. A row's proof is what its leaf needs to give the root:
the other nodes of its run at each level.

Leaves are numbered within their source by a range sort over (source, id), so that a source with a third of all rows is dealt over
many tasks. ``FAN ** LEVELS`` consecutive nodes are a superblock, which one task reduces to one node; the nodes of all
superblocks are numbered by their superblock and so are the next tree, that much smaller. Once the root is known, the way back
down is a cogroup of nodes and of the outer siblings of their superblock: at the bottom, leaves and the required outer nodes of each
superblock meet in ``applyInPandas``, which reduces them once more, joins the proofs and folds the leaves found in the data
to check against the root. Only digests travel; a group has at most ``FAN ** LEVELS`` rows.

Defined results: a null field counts as ``-``. Null sources come first, null ids first within a source; rows that share an id
are ordered by their leaf. Repeated rows are leaves of their own. An empty table gives no rows. Columns other than the fields are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ownerscope.llm.common import materialize

FAN, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATHS = "lefts array<string>, rights array<string>, subroot string, root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values: Sequence[Column]) -> Column:
    """The digest of a row's fields, each with its length in bytes."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in values]), 256)


def tree_of(nodes: list[str], whole: bool, height: int) -> list[list[str]]:
    """The levels of a superblock from its nodes up: to one node if it is the first of its tree, else ``height`` of them."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= height:
        below = levels[-1]
        levels.append([digest("".join(below[k:k + FAN])) for k in range(0, len(below), FAN)])
    return levels


def siblings(levels: list[list[str]], k: int) -> tuple[list[str], list[str]]:
    """Of the k-th node of the lowest level: what stands left and right of its ancestors in their runs, level by level."""
    lefts, rights = [], []
    for level in levels[:-1]:
        run = k // FAN * FAN
        lefts.append("".join(level[run:k]))
        rights.append("".join(level[k + 1:run + FAN]))
        k //= FAN
    return lefts, rights


def folded(node: str, lefts: Sequence[str], rights: Sequence[str]) -> str:
    for left, right in zip(lefts, rights):
        node = digest(left + node + right)
    return node


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``pos``, their place from 0 within ``g`` by ``order``."""
    names, schema = rows.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, last, at, head = TaskContext.get().partitionId(), None, None, 0, 0
        schema_of = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            schema_of = batch.schema
            g = batch.column("g").to_numpy(zero_copy_only=False)
            new = np.append(g[0] != last, g[1:] != g[:-1])
            begins = np.flatnonzero(new)
            pos = np.arange(n)
            pos[begins[0] if len(begins) else n:] -= np.maximum.accumulate(np.where(new, np.arange(n), 0))[begins[0] if len(begins) else n:]
            pos[:begins[0] if len(begins) else n] += at
            if first is None:
                first = g[0]
            head += int((g == first).sum())
            last, at = g[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pos), pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, np.int64))], names=[*names, "at", "part", "n"])
        if first is not None:  # how many rows of its first and of its last group the task holds
            for g, n in {first: head, last: at}.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g], f.type) if f.name == "g" else pa.nulls(1, f.type) for f in schema_of]
                    + [pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.array([n], pa.int64())], names=[*names, "at", "part", "n"])

    by = ["g", *order]
    placed = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(number, f"{schema}, at long, part int, n long"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.where("n > 0").select("g", "part", F.sum("n").over(before).alias("base")).where("base > 0")
    return placed.where("n = 0").join(bases, ["g", "part"], "left").select(*names, (F.col("at") + F.coalesce("base", F.lit(0))).alias("pos"))


def block(height: int) -> Column:
    return F.expr(f"pos div {FAN ** height}").alias("block")


def reduced(level: DataFrame, height: int) -> DataFrame:
    """The nodes (g, pos, node) of the next tree: one for each superblock of this one."""
    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows.sort_values("pos")["node"].tolist()
        return pd.DataFrame({"g": [key[0]], "pos": [key[1]], "node": [tree_of(nodes, key[1] == 0, height)[-1][0]]})

    return level.select("g", "pos", "node", block(height)).groupBy("g", "block").applyInPandas(one, "g string, pos long, node string")


def trees(leaves: DataFrame, height: int) -> list[DataFrame]:
    """The trees from the given nodes (g, pos, node) up; in the last, each group has one node."""
    out = [leaves]
    while True:
        out.append(materialize(reduced(out[-1], height)))
        if out[-1].where("pos > 0").isEmpty():
            return out


PATHS_OF = ["lefts", "rights", "subroot", "root"]


def descended(level: DataFrame, outer: DataFrame, height: int) -> DataFrame:
    """Of each node (g, pos, node) of a tree: its siblings up to the root, given those of its superblock (g, pos, lefts, rights, ...)."""
    def one(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        levels = tree_of(rows["node"].tolist(), key[1] == 0, height)
        lefts, rights = list(above["lefts"].iloc[0]), list(above["rights"].iloc[0])
        own = [siblings(levels, k) for k in range(len(rows))]
        return pd.DataFrame({"g": rows["g"], "pos": rows["pos"], "node": rows["node"], "lefts": [x + lefts for x, _ in own],
                             "rights": [x + rights for _, x in own], "subroot": above["subroot"].iloc[0], "root": above["root"].iloc[0]})

    return level.select("g", "pos", "node", block(height)).groupBy("g", "block").cogroup(
        outer.select("g", F.col("pos").alias("block"), *PATHS_OF).groupBy("g", "block")).applyInPandas(one, f"g string, pos long, node string, {PATHS}")


def proved(leaves: DataFrame, outer: DataFrame, id_type: str, height: int) -> DataFrame:
    """Of each leaf: the proof's digest and the root that the leaf found in the data folds to."""
    def one(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        levels = tree_of(rows["node"].tolist(), key[1] == 0, height)
        lefts, rights = list(above["lefts"].iloc[0]), list(above["rights"].iloc[0])
        outside = "".join(x + y for x, y in zip(lefts, rights))
        proofs, roots = [], []
        for k, found in enumerate(rows["found"]):
            x, y = siblings(levels, k)
            proofs.append(digest("".join(a + b for a, b in zip(x, y)) + outside))
            roots.append(folded(folded(found, x, y), lefts, rights))
        return pd.DataFrame({"doc": rows["doc"], "leaf": rows["node"], "subroot": above["subroot"].iloc[0], "root": above["root"].iloc[0],
                             "proof_sha256": proofs, "folded_root": roots})

    # a null id stays null on its way through pandas as text
    return leaves.select("g", "pos", "node", "found", F.col("doc").cast("string").alias("doc"), block(height)).groupBy("g", "block").cogroup(
        outer.select("g", F.col("pos").alias("block"), *PATHS_OF).groupBy("g", "block")).applyInPandas(
        one, "doc string, leaf string, subroot string, root string, proof_sha256 string, folded_root string").withColumn(
        "doc", F.col("doc").cast(id_type))


def manifest(docs: DataFrame, found: Column | None = None, fields: Sequence[str] = FIELDS, source_col: str = "source",
             id_col: str = "doc_id", levels: int = LEVELS) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``found`` is the leaf of the data to be verified, a Column over ``docs``; by default the row's own.
    """
    leaf = leaf_of([F.col(c) for c in fields])
    id_type = docs.schema[id_col].dataType.simpleString()
    # a group's name keeps the order of the sources, null before all others
    rows = docs.select(F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("0")).alias("g"), F.col(id_col).alias("doc"),
                       leaf.alias("node"), (leaf if found is None else found).alias("found"))
    leaves = materialize(numbered(rows, ["doc", "node", "found"]))
    inner = trees(leaves, levels)
    subroots = numbered(inner[-1].select(F.lit("").alias("g"), F.col("g").alias("source"), "node"), ["source"])
    subroots = materialize(subroots)
    upper = trees(subroots, levels)
    none = F.array().cast("array<string>")
    paths = upper[-1].select("g", "pos", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    for level in upper[-2::-1]:
        paths = descended(level, paths, levels)
    named = subroots.select("pos", F.col("source").alias("g"))
    paths = paths.drop("g").join(named, "pos").select("g", F.lit(0).cast("long").alias("pos"), "lefts", "rights", F.col("node").alias("subroot"), "root")
    for level in inner[-2:0:-1]:
        paths = descended(level, paths, levels)
    out = proved(leaves, materialize(paths.select("g", "pos", *PATHS_OF)), id_type, levels)
    return out.select(F.col("doc").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def without_line_ends(docs: DataFrame, fields: Sequence[str] = FIELDS, text_col: str = "text", id_col: str = "doc_id") -> Column:
    """The leaves of data in which half the rows, by the crc32 of their id, have lost their line ends; a null id keeps them."""
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.translate(text_col, "\n", "")).otherwise(F.col(text_col))
    return leaf_of([text if c == text_col else F.col(c) for c in fields])
