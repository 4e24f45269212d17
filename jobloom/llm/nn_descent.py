"""Near-duplicate vectors by NN-descent, with an audit of the recall and exact link counts.

A graph of neighbour lists starts from random projections: the vectors, sorted by the signs of
their projections, are cut into leaves, and each vector takes the nearest ones of its leaves.
Then every vector joins its neighbours with each other: neighbours of a neighbour are compared
and the lists keep the nearest, round by round until hardly an entry is new. A list starts with
room for ``ROOM`` entries; one that is full of vectors within the threshold is saturated. It needs
no further rounds to be linked, but gets twice the room and is joined anew for as long as that
finds links between components. Lists hold no vector farther off than twice the threshold's angle: two
vectors linked to a third are no farther apart. Entries within the threshold are the edges.

An audit compares a bounded number of probes (``PROBES``) with all vectors in blocks, and asks
which of their links lie inside a component. Below ``RECALL`` another pass adds trees of leaves
twice as large. Last, the vectors of a component are compared in blocks, so that every link
inside it is counted, however short the lists were.

Defined cases: vectors that are null, empty, zero or hold null, infinite or NaN components link
with nothing; so do vectors of different length with each other. Equal vectors are one node with
a number of copies, and count as links of each other; rows that share an id are rows of their
own. ``component_id`` is the smallest id of the component, null if none has one; ``kept`` is
null-safe, so a row without id is kept only where no row has one. An empty table gives no rows.
Columns of the input other than id and vector are not carried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from jobloom.llm.components import components
from jobloom.session import shared_folder

THRESHOLD = 0.95
ROOM = 12
TREES = 6
LEAF = 512
#: Bits of a projection code.
BITS = 48
RECALL = 0.99
PROBES = 512
#: A pass ends its rounds when so small a share of the entries is new.
SETTLED = 0.002
#: Vectors in a block of the exact count.
BLOCK = 1_024
#: Parts in which the vectors of a component are told its number of blocks.
SALTS = 64

ENTRY = "node bigint, other bigint, sim double"


def usable(vector: str) -> Column:
    """Whether a vector can link: every component finite, one of them not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(vectors) -> np.ndarray:
    """Unit rows in double precision; scaled by the largest component first, so that none overflows."""
    out = np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _nearest(sims: np.ndarray, nodes: np.ndarray, room: int, floor: float) -> list[np.ndarray]:
    """(node, other, sim): of each row the ``room`` largest entries of at least ``floor``."""
    if sims.shape[1] > room:
        best = np.argpartition(-sims, room - 1, axis=1)[:, :room]
    else:
        best = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    value = np.take_along_axis(sims, best, axis=1)
    row, at = np.nonzero(value >= floor)
    return [nodes[row], nodes[best[row, at]], value[row, at]]


def _entries(parts: list[list[np.ndarray]]) -> pd.DataFrame:
    columns = [np.concatenate(c) if c else np.empty(0) for c in (zip(*parts, strict=True) if parts else ([], [], []))]
    out = pd.DataFrame(dict(zip(["node", "other", "sim"], columns, strict=True)))
    return out.astype({"node": "int64", "other": "int64", "sim": "float64"})


def _codes(trees: int, seed: int, dim: int):
    """Per vector and tree the signs of random projections, as one number."""
    planes = np.random.default_rng(seed).normal(size=(dim, trees * BITS))
    weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def run(frames):
        for frame in frames:
            if frame.empty:
                continue
            signs = (_matrix(frame["vec"]) @ planes > 0).reshape(len(frame), trees, BITS)
            out = frame.loc[frame.index.repeat(trees), ["node", "vec"]]
            out.insert(0, "tree", np.tile(np.arange(trees, dtype=np.int32), len(frame)))
            out.insert(1, "code", (signs @ weight).reshape(-1))
            yield out

    return run


def _leaves(leaf: int, room: int, floor: float):
    """Cuts sorted rows into leaves and gives the nearest vectors inside each."""

    def joined(frame: pd.DataFrame) -> list[np.ndarray]:
        unit, nodes = _matrix(frame["vec"]), frame["node"].to_numpy()
        sims = unit @ unit.T
        # Where one tree ends and the next begins, a vector can be in a leaf twice.
        sims[nodes[:, None] == nodes[None, :]] = -2
        return _nearest(sims, nodes, room, floor)

    def run(frames):
        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            cuts = len(rest) // leaf
            if cuts > 1:
                yield _entries([joined(rest[i * leaf : (i + 1) * leaf]) for i in range(cuts - 1)])
                rest = rest[(cuts - 1) * leaf :].reset_index(drop=True)
        if rest is not None and len(rest) > 1:
            # The last two leaves are cut in the middle, so that none is small.
            half = len(rest) if len(rest) <= leaf else (len(rest) + 1) // 2
            yield _entries([joined(p) for p in (rest[:half], rest[half:]) if len(p) > 1])

    return run


def _local_join(room: int, floor: float):
    """Compares the neighbours of each vector with each other where one of the two is new."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, near in frame.groupby("at", sort=False):
            if len(near) < 2 or not near["new"].any():
                continue
            unit, new = _matrix(near["vec"]), near["new"].to_numpy()
            sims = unit @ unit.T
            sims[~(new[:, None] | new[None, :])] = -2
            np.fill_diagonal(sims, -2)
            parts.append(_nearest(sims, near["member"].to_numpy(), room, floor))
        out = _entries(parts)
        return out.sort_values("sim").drop_duplicates(["node", "other"], keep="last")

    return run


def _kept(entries: DataFrame, room: int, threshold: float) -> DataFrame:
    """One entry per pair; of each list the nearest that it has room for, and whether it is saturated."""
    once = entries.groupBy("node", "other").agg(
        F.max("sim").alias("sim"), F.min("new").alias("new"), F.max("room").alias("room")
    )
    of = Window.partitionBy("node")
    return (
        once.withColumn("room", F.coalesce(F.max("room").over(of), F.lit(room)))
        .withColumn("__place", F.row_number().over(of.orderBy(F.desc("sim"), "other")))
        .where("__place <= room")
        .withColumn("full", (F.count("*").over(of) == F.col("room")) & (F.min("sim").over(of) >= threshold))
        .drop("__place")
    )


def _round(lists: DataFrame, points: DataFrame, room: int, floor: float, threshold: float, seed: int, tasks: int) -> DataFrame:
    """The lists after every vector joined its neighbours, in both directions, with each other.

    A vector that many lists hold is drawn into a bounded number of joins, others each round.
    """
    draw = Window.partitionBy("other").orderBy(F.xxhash64("node", "other", F.lit(seed)))
    drawn = lists.withColumn("__place", F.row_number().over(draw)).where(F.col("__place") <= room)
    near = (
        drawn.select(F.col("node").alias("at"), F.col("other").alias("member"), "new")
        .union(drawn.select("other", "node", "new"))
        .groupBy("at", "member")
        .agg(F.max("new").alias("new"))
    )
    found = (
        near.join(points.withColumnRenamed("node", "member"), "member")
        .withColumn("task", F.pmod(F.xxhash64("at"), F.lit(tasks)))
        .groupBy("task")
        .applyInPandas(_local_join(room, floor), ENTRY)
        .select("*", F.lit(True).alias("new"), F.lit(None).cast("int").alias("room"))
    )
    older = lists.select("node", "other", "sim", F.lit(False).alias("new"), "room")
    return _kept(older.union(found), room, threshold).checkpoint()


def _settle(lists: DataFrame, points: DataFrame, room: int, floor: float, threshold: float, seed: int, tasks: int) -> DataFrame:
    """Rounds until hardly an entry of a list that is not saturated is new."""
    while True:
        count = lists.agg(F.count("*").alias("n"), F.count_if(F.col("new") & ~F.col("full")).alias("new")).head()
        if count["new"] <= SETTLED * count["n"]:
            return lists
        seed += 1
        lists = _round(lists, points, room, floor, threshold, seed, tasks)


def _edges(lists: DataFrame, threshold: float) -> DataFrame:
    return lists.where(F.col("sim") >= threshold).select("node", "other")


def _united(
    lists: DataFrame, points: DataFrame, room: int, floor: float, threshold: float, seed: int, tasks: int
) -> tuple[DataFrame, DataFrame]:
    """(node, root) of every vector with an edge, after saturated lists had room for all that unites; and the lists."""
    roots = components(_edges(lists, threshold), "node", "other")
    while lists.where("full").head(1):
        seed += 1
        wider = lists.withColumns({"new": F.col("full"), "room": F.when(F.col("full"), F.col("room") * 2).otherwise(F.col("room"))})
        lists = _round(wider, points, room, floor, threshold, seed, tasks)
        placed = _edges(lists, threshold).join(roots.select("node", F.col("root").alias("from")), "node", "left")
        placed = placed.join(roots.select(F.col("node").alias("other"), F.col("root").alias("to")), "other", "left")
        if not placed.where("NOT (from <=> to) OR from IS NULL").head(1):
            break
        roots = components(_edges(lists, threshold), "node", "other")
    return roots, lists


def _audit(points: DataFrame, roots: DataFrame, threshold: float, probes: int) -> float:
    """The share of the probes' links, by comparison with all vectors, that lie inside a component."""
    placed = points.join(roots, "node", "left").select("node", "vec", F.coalesce("root", "node").alias("root"))
    chosen = placed.orderBy(F.xxhash64("node")).limit(probes).toPandas()
    if chosen.empty:
        return 1.0
    unit, node, root = _matrix(chosen["vec"]), chosen["node"].to_numpy(), chosen["root"].to_numpy()

    def run(frames):
        for frame in frames:
            if frame.empty:
                continue
            other, at = frame["node"].to_numpy(), frame["root"].to_numpy()
            true = found = 0
            for begin in range(0, len(frame), BLOCK):
                part = slice(begin, begin + BLOCK)
                linked = (_matrix(frame["vec"].iloc[part]) @ unit.T >= threshold) & (other[part, None] != node)
                true += int(linked.sum())
                found += int((linked & (at[part, None] == root)).sum())
            yield pd.DataFrame({"true": [true], "found": [found]})

    total = placed.mapInPandas(run, "true bigint, found bigint").agg(F.sum("true"), F.sum("found")).head()
    return total[1] / total[0] if total[0] else 1.0


def _counted(threshold: float):
    """Per vector of a task the rows it is linked to there; between blocks only, if the task has two."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, some in frame.groupby("root", sort=False):
            unit, copies = _matrix(some["vec"]), some["copies"].to_numpy()
            linked = unit @ unit.T >= threshold
            if some["low"].iloc[0] != some["high"].iloc[0]:
                side = (some["block"] == some["high"]).to_numpy()
                linked &= side[:, None] != side[None, :]
            np.fill_diagonal(linked, False)
            parts.append(pd.DataFrame({"node": some["node"], "links": linked @ copies}))
        return pd.concat(parts)

    return run


def _count_links(classes: DataFrame, roots: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(node, links): the rows linked to each vector, by comparison inside its component."""
    sizes = roots.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    several = sizes.where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(4 * parts)).cast("string")).otherwise(
        F.concat_ws("/", "root", "low", "high")
    )
    return (
        roots.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        .join(several, ["root", "salt"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
        .join(classes.select("node", "copies", "vec"), "node")
        .select("*", other.alias("other"))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .select(task.alias("task"), "node", "root", "copies", "block", "low", "high", "vec")
        .groupBy("task")
        .applyInPandas(_counted(threshold), "node bigint, links bigint")
        .groupBy("node")
        .agg(F.sum("links").alias("links"))
    )


def _linked(
    classes: DataFrame, dim: int, threshold: float, room: int, trees: int, leaf: int, recall: float, probes: int
) -> DataFrame:
    """(node, root, links) of the vectors of one length."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    floor = float(np.cos(min(np.pi, 2 * np.arccos(threshold))))
    points = classes.select("node", "vec")
    rows = classes.count()
    lists = None
    drawn = 0
    while True:
        fresh = (
            points.mapInPandas(_codes(trees, drawn, dim), f"tree int, code bigint, node bigint, {_vec(classes)}")
            # The last key parts equal codes, so that a hot one is no one task.
            .repartitionByRange(parts, "tree", "code", F.xxhash64("node"))
            .sortWithinPartitions("tree", "code")
            .mapInPandas(_leaves(leaf, room, floor), ENTRY)
            .select("*", F.lit(True).alias("new"), F.lit(None).cast("int").alias("room"))
        )
        if lists is not None:
            fresh = lists.select(fresh.columns).union(fresh)
        lists = _kept(fresh, room, threshold).checkpoint()
        drawn += trees
        lists = _settle(lists, points, room, floor, threshold, drawn * 1000, 4 * parts)
        roots, lists = _united(lists, points, room, floor, threshold, drawn * 1000 + 500, 4 * parts)
        if leaf >= rows or _audit(points, roots, threshold, probes) >= recall:
            break
        leaf *= 2
    return roots.join(_count_links(classes, roots, threshold, parts), "node", "left")


def _vec(df: DataFrame) -> str:
    return f"vec {df.schema['vec'].dataType.simpleString()}"


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD,
    room: int = ROOM, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, probes: int = PROBES,
) -> DataFrame:
    """Per row: ``vec_id``, ``n_links``, ``component_id`` and ``kept``."""
    spark = vectors.sparkSession
    shared_folder(spark)
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("vec"))
    rows = rows.select("vec_id", F.when(usable("vec"), F.col("vec")).alias("vec"))
    # Numbers of rows hold once they are written.
    classes = (
        rows.where("vec IS NOT NULL")
        .groupBy("vec")
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
        .select(F.monotonically_increasing_id().alias("node"), "vec", "first", "copies")
        .checkpoint()
    )
    dims = [r[0] for r in classes.select(F.size("vec")).distinct().collect()]
    found = spark.createDataFrame([], "node bigint, root bigint, links bigint")
    for dim in sorted(dims):
        same = classes.where(F.size("vec") == dim) if len(dims) > 1 else classes
        found = found.union(_linked(same, dim, threshold, room, trees, leaf, recall, probes))
    named = classes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("root").agg(F.min("first").alias("component_id"))
    told = named.join(heads, "root").select(
        "vec", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = rows.join(told, "vec", "left")
    head = F.when(F.col("vec").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), head.alias("component_id"),
        F.col("vec_id").eqNullSafe(head).alias("kept"),
    )
