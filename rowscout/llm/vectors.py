"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one vector kept of a group.

Spherical k-means, fitted on a bounded sample, assigns every vector to its cell. A pair whose cosine is at least the
threshold is at most a chord apart; if its two cells differ, one of the two vectors lies within half that chord of the
plane between the two centroids. So a vector also visits each cell whose plane with its own is that near, and every
pair over the threshold meets in a cell: the cells lose no link. How many cells a vector visits depends on how well the
data cluster (on noise without structure in 64 dimensions, with few cells, most of them).

Equal vectors are one node with a weight. A cell with more than `cell_rows` vectors of its own is cut into slices, and
each slice is a task of its own, so a task holds one slice and streams the rest past it in blocks. The number of cells
grows with the number of vectors, up to MOST_CELLS. Link counts are summed from each task; for components a task gives
the edges of a spanning forest only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .frames import bound_batches, durable, looked_up, partitions, pick, position

BLOCK = 512
MOST_CELLS = 32_768
BROADCAST_NUMBERS = 2_000_000  # of all vectors of a broadcast


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array of equal widths as unit vectors in double precision."""
    flat = np.asarray(column.flatten()).astype(np.float64).reshape(-1, width)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # against under- and overflow of the squares
    return flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """k unit centroids of unit rows, by Lloyd rounds from distinct rows; an empty cell takes the worst-placed row. Many
    are fitted in two levels: about sqrt(k) cells first, then the share of each by its rows."""
    if k > 1024:
        top = spherical_kmeans(x, math.isqrt(k), rounds, seed)
        home = np.concatenate([(x[a : a + 8192] @ top.T).argmax(axis=1) for a in range(0, len(x), 8192)])
        groups = [g for c in range(len(top)) if len(g := np.flatnonzero(home == c))]
        shares = [min(len(g), max(1, round(k * len(g) / len(x)))) for g in groups]
        return np.concatenate([spherical_kmeans(x[g], n, rounds, seed) for g, n in zip(groups, shares, strict=True)])
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        dots = x @ centers.T
        home = dots.argmax(axis=1)
        best = dots[np.arange(len(x)), home]
        sums = np.zeros_like(centers)
        np.add.at(sums, home, x)
        norms = np.sqrt((sums**2).sum(axis=1))
        poor = np.flatnonzero(norms < 1e-9)
        sums[poor] = x[np.argsort(best)[: len(poor)]]
        norms[poor] = np.sqrt((sums[poor] ** 2).sum(axis=1))
        centers = sums / norms[:, None]
    return centers


def visits(x: np.ndarray, centers: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, and a matrix of the other cells it visits."""
    home, near = np.empty(len(x), np.int64), np.empty((len(x), len(centers)), bool)
    half = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2
    step = max(16, 4_000_000 // len(centers))
    for a in range(0, len(x), step):
        dots = x[a : a + step] @ centers.T
        mine = home[a : a + step] = dots.argmax(axis=1)
        homes, which = np.unique(mine, return_inverse=True)
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * np.clip(centers[homes] @ centers.T, -1, 1)))
        rows = np.arange(len(mine))
        near[a : a + step] = dots[rows, mine][:, None] - dots <= half * apart[which] + 1e-9
        near[a + rows, mine] = False
    return home, near


class Forest:
    """Union-find whose labels are kept flat, so that what is already joined is seen at once."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Joins pairs; returns those that joined two trees."""
        made = []
        while len(a):
            apart = self.label[a] != self.label[b]
            a, b = a[apart], b[apart]
            if not len(a):
                break
            i, j = int(a[0]), int(b[0])
            made.append((i, j))
            x, y = self.label[i], self.label[j]
            self.label[self.label == max(x, y)] = min(x, y)
        return made


def cell_links(batches: Iterator[pa.RecordBatch], threshold: float, width: int, cells: int) -> Iterator[pa.RecordBatch]:
    """Link counts and forest edges of tasks (cell, slice) that lie side by side, the slice's own vectors first.

    Columns: task, cell, role (0 own, 1 own to an earlier slice, 2 visitor), home, nid, weight, v, near (bits).
    """
    task = None
    own: list = []
    ready = None

    def emit(ids, counts, edges):
        """Counts as rows (nid, null, n), edges as rows (nid, nid, null)."""
        a = [*map(int, ids), *(x for x, _ in edges)]
        b = [None] * len(ids) + [y for _, y in edges]
        n = [*map(int, counts)] + [None] * len(edges)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "n"])

    def prepare():
        x = np.concatenate([o[0] for o in own])
        ids, weight = (np.concatenate([o[k] for o in own]) for k in (1, 2))
        near = np.concatenate([o[3] for o in own])
        return {"x": x, "ids": ids, "w": weight, "near": near, "count": np.zeros(len(x), np.int64), "f": Forest(len(x)), "edges": []}

    def compare(y, ids, weight, home, cell, start=None):
        """Block y against the slice. start: y are the slice's own rows from there on, each to meet later ones only."""
        hit = y @ ready["x"].T >= threshold
        if start is not None:
            hit &= np.arange(hit.shape[1]) > np.arange(start, start + len(y))[:, None]
        for c in np.unique(home[home < cell]):  # a pair that also meets in an earlier cell counts there
            rows = np.flatnonzero(home == c)
            both = (ready["near"][:, c >> 3] >> (c & 7) & 1).astype(bool)
            hit[np.ix_(rows, np.flatnonzero(both))] = False
        r, c = np.nonzero(hit)
        if not len(r):
            return None
        ready["count"] += np.bincount(c, weight[r], len(ready["x"])).astype(np.int64)
        mine = np.bincount(r, ready["w"][c], len(y)).astype(np.int64)
        if start is not None:
            ready["count"][start : start + len(y)] += mine
            pairs = ready["f"].join(start + r, c)
            ready["edges"] += [(int(ready["ids"][i]), int(ready["ids"][j])) for i, j in pairs]
            return None
        first = np.r_[True, r[1:] != r[:-1]]
        anchor = np.repeat(c[first], np.diff(np.r_[np.flatnonzero(first), len(r)]))
        code = np.unique(anchor * len(ready["x"]) + c)
        pairs = ready["f"].join(code // len(ready["x"]), code % len(ready["x"]))
        ready["edges"] += [(int(ready["ids"][i]), int(ready["ids"][j])) for i, j in pairs]
        linked = np.flatnonzero(mine)
        edges = list(zip(ids[r[first]].tolist(), ready["ids"][c[first]].tolist(), strict=True))
        return emit(ids[linked], mine[linked], edges)

    def start_task(cell):
        nonlocal ready
        ready = prepare()
        for a in range(0, len(ready["x"]), BLOCK):
            b = min(a + BLOCK, len(ready["x"]))
            compare(ready["x"][a:b], ready["ids"][a:b], ready["w"][a:b], np.full(b - a, cell), cell, a)

    def end_task():
        if ready is not None:
            linked = np.flatnonzero(ready["count"])
            if len(linked) or ready["edges"]:
                yield emit(ready["ids"][linked], ready["count"][linked], ready["edges"])

    last_cell = None
    for batch in batches:
        tasks = np.asarray(batch.column(0))
        cell, role, home, nid, weight = (np.asarray(batch.column(k)) for k in range(1, 6))
        x = unit_rows(batch.column(6), width)
        near = np.zeros((len(x), -(-cells // 8)), np.uint8)
        for i in np.flatnonzero(role == 0):
            near[i] = np.frombuffer(batch.column(7)[int(i)].as_py(), np.uint8)
        edges = np.flatnonzero(np.r_[True, (tasks[1:] != tasks[:-1]) | (cell[1:] != cell[:-1])])
        for a, b in zip(edges, np.r_[edges[1:], len(tasks)], strict=True):
            if (tasks[a], cell[a]) != task:
                if own:
                    if ready is None:
                        start_task(last_cell)
                    yield from end_task()
                task, own, ready, last_cell = (tasks[a], cell[a]), [], None, int(cell[a])
            mine = a + int((role[a:b] == 0).sum())
            if mine > a:
                own.append((x[a:mine], nid[a:mine], weight[a:mine], near[a:mine]))
            if mine < b and own:
                if ready is None:
                    start_task(last_cell)
                for s in range(mine, b, BLOCK):
                    e = min(b, s + BLOCK)
                    visiting = np.where(role[s:e] == 2, home[s:e], last_cell)
                    out = compare(x[s:e], nid[s:e], weight[s:e], visiting, last_cell)
                    if out is not None:
                        yield out
    if own:
        if ready is None:
            start_task(last_cell)
        yield from end_task()


def near_duplicate_vectors(
    df: DataFrame,
    threshold: float = 0.9,
    cell_rows: int = 8192,
    fit_rows: int = 16384,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """id, n_links (other rows at cosine >= threshold), component_id (least id reachable), kept, for every row.

    The centroids come from fit_rows rows, or eight for each cell where there are more cells, and there are at most
    MOST_CELLS of them, which bounds the sample and the broadcast; the fit changes how much work there is, never which
    links are found.

    Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id, link with
    nothing: n_links 0, the row's own id as component, kept. Vectors link only with others of their width; each width is
    a pass of its own. Equal vectors link, also under one id. Other columns are ignored. Empty in, empty out.
    """
    bound_batches(df.sparkSession)
    kind = df.schema.fields[position(df.columns, vec_col)].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    base = pick(df, **{id_col: "long", vec_col: "array<float>" if single else "array<double>"})
    base = base.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    base = base.withColumn("sound", F.coalesce(sound, F.lit(False)))
    widths = sorted(r["w"] for r in base.where("sound").select(F.size("v").alias("w")).distinct().collect())  # as a rule one
    alone = base.where(~F.col("sound")).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
    )
    out = alone.withColumnRenamed("id", id_col)
    for width in widths:
        good = base.where(F.col("sound") & (F.size("v") == width)).select("id", "v")
        out = _of_width(good, width, single, threshold, cell_rows, fit_rows).withColumnRenamed("id", id_col).unionByName(out)
    return out


def _of_width(good: DataFrame, width: int, single: bool, threshold: float, cell_rows: int, fit_rows: int) -> DataFrame:
    """id, n_links, component_id, kept of sound vectors (id, v) of one width."""
    spark = good.sparkSession
    nodes = durable(
        good.groupBy("v")
        .agg(F.min("id").alias("least"), F.count("*").alias("weight"))
        .withColumn("nid", F.monotonically_increasing_id())
    )
    n = nodes.count()
    cells = min(-(-n // cell_rows), MOST_CELLS)
    fit = nodes.orderBy(F.xxhash64("v")).limit(max(fit_rows, 8 * cells)).select("v").toArrow().column(0).combine_chunks()
    x = unit_rows(fit, width)
    cells = max(1, min(cells, len(x) // 8))
    centers = spark.sparkContext.broadcast(spherical_kmeans(x, cells))
    cells = len(centers.value)

    def homes(batches):
        for batch in batches:
            if batch.num_rows:
                home, _ = visits(unit_rows(batch.column(0), width), centers.value, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32())], ["cell"])

    sizes = nodes.select("v").mapInArrow(homes, "cell int").groupBy("cell").count().collect()  # a row for each cell
    slices = spark.sparkContext.broadcast({r["cell"]: -(-r["count"] // cell_rows) for r in sizes})

    def deal(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                v, nid = part.column(0), np.asarray(part.column(1))
                home, near = visits(unit_rows(v, width), centers.value, threshold)
                bits = np.packbits(near, axis=1, bitorder="little")
                rows, task, cell, role = [], [], [], []
                for i in range(len(home)):
                    of = slices.value[int(home[i])]
                    mine = int(nid[i]) * 2654435761 % (1 << 32) * of >> 32
                    for s in range(mine, of):
                        rows.append(i), task.append(s), cell.append(home[i]), role.append(0 if s == mine else 1)
                    for c in np.flatnonzero(near[i]).tolist():
                        for s in range(slices.value.get(c, 0)):
                            rows.append(i), task.append(s), cell.append(c), role.append(2)
                at = pa.array(rows)
                role = np.array(role)
                near_col = pa.array([bits[i].tobytes() if r == 0 else None for i, r in zip(rows, role, strict=True)], pa.binary())
                cols = [pa.array(task, pa.int32()), pa.array(np.array(cell), pa.int32()), pa.array(role, pa.int32())]
                cols += [pa.array(home[rows], pa.int32()), part.column(1).take(at), part.column(2).take(at), v.take(at), near_col]
                names = ["task", "cell", "role", "home", "nid", "weight", "v", "near"]
                for a in range(0, len(rows), 8192):
                    yield pa.RecordBatch.from_arrays([c.slice(a, 8192) for c in cols], names)

    vector = "array<float>" if single else "array<double>"
    dealt = nodes.select("v", "nid", "weight").mapInArrow(
        deal, f"task int, cell int, role int, home int, nid long, weight long, v {vector}, near binary"
    )
    dealt = dealt.repartition(partitions(spark), "cell", "task").sortWithinPartitions("cell", "task", "role")
    found = durable(dealt.mapInArrow(lambda rows: cell_links(rows, threshold, width, cells), "a long, b long, n long"), few=True)
    counts = found.where("b is null").groupBy(F.col("a").alias("nid")).agg(F.sum("n").alias("links"))
    labels = components(found.where("b is not null").select("a", "b"))
    known = nodes.join(counts, "nid", "left").select("v", "least", "weight", F.col("nid").alias("node"), F.coalesce("links", F.lit(0)).alias("links"))
    known = durable(looked_up(durable(known), labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    least = durable(known.groupBy("label").agg(F.min("least").alias("component_id")))
    named = durable(looked_up(known, least, "label").select("v", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id"))
    linked = looked_up(durable(good), named, "v", most=BROADCAST_NUMBERS // width)
    return linked.select("id", "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
