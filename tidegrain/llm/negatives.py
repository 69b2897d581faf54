"""Hard negatives by an exact nearest-neighbour join over Voronoi cells.

Inner products become distances: each row gets one more component that brings
all rows to the largest norm, anchors get 0 there, so the largest product is
the smallest distance.  Rows belong to the cell of their nearest pivot.

A join has two steps.  At home, anchors meet the rows of their own cell, which
gives each query a score that its k-th row has at least.  Then every other row
goes to those groups of anchors that it might still serve: by its distance to
the anchors' pivot and by the plane between both pivots it must be able to come
as near as the group's worst query needs.  Both steps compare exactly and keep
k rows for each query; what they found is merged.

The join runs twice: rows of the anchor's label without bounds (positives), then
rows of other labels, with a window of scores for each positive (negatives).
Groups hold a bounded number of anchors, and their rows are dealt over parts, so
neither a large cell nor a frequent label is one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.llm.common import need, stored
from tidegrain.llm.vectors import finite, matrix, products, whole

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Pivots, anchors of a group, rows of a part, and sets of labels that groups of the first join are split by.
LEAST_PIVOTS, MOST_PIVOTS, GROUP_ANCHORS, PART_ROWS, LABEL_SETS = 16, 512, 2048, 250_000, 16
#: Groups that anchors are split into even if they are few.
LEAST_BUNDLES = 2
#: Scores that a task holds at once.
BLOCK = 1 << 21
LOWEST, HIGHEST = -(1 << 62), 1 << 62

ROWS = "grp int, part int, is_row boolean, vec_id long, label int, cell int, q array<int>, lo array<long>, hi array<long>"
FOUND = "anchor_id long, slot int, vec_id long, score long"


@dataclass(frozen=True)
class Space:
    """Pivots with their added component, the largest squared norm, and how the joins are dealt."""

    pivots: np.ndarray
    norm2: float
    width: int
    rows: int
    bundle: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows with the component that brings them to the largest norm."""
        rest = np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        """Distance of each lifted row to each pivot."""
        square = (lifted * lifted).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)[None] - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))


def participants(vectors: DataFrame, relabel: Column | None = None) -> DataFrame:
    """vec_id, label and q (whole components) of rows that have an id, a label and a finite vector."""
    need(vectors, "vec_id", "embedding", "label")
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    label = F.col("label") if relabel is None else relabel
    return rows.select(F.col("vec_id").cast("long"), label.cast("int").alias("label"), whole(F.col("embedding"), SCALE).alias("q"))


def _bundles(pivots: np.ndarray, n: int) -> np.ndarray:
    """Number of each pivot's bundle: n pivots far from each other, and the rest with the nearest of them that has room."""
    n = min(n, len(pivots))
    d = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2), 0))
    heads = [0]
    while len(heads) < n:
        heads.append(int(d[:, heads].min(axis=1).argmax()))
    room, out = np.full(n, -(-len(pivots) // n)), np.zeros(len(pivots), np.int64)
    for p in np.argsort(d[:, heads].min(axis=1), kind="stable"):
        near = d[p, heads] + np.where(room > 0, 0, np.inf)
        out[p] = near.argmin()
        room[out[p]] -= 1
    return out


def space(rows: DataFrame, anchors: Column, n_pivots: int | None = None, group_anchors: int = GROUP_ANCHORS) -> Space | None:
    """Pivots are the rows whose ids hash lowest: about a quarter of the square root of the rows, within bounds."""
    norm = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    seen = rows.agg(F.count("*").alias("n"), F.max(norm).alias("norm2"), F.max(F.size("q")).alias("width"), F.count_if(anchors).alias("anchors")).first()
    if not seen["n"] or not seen["width"]:
        return None
    wanted = n_pivots or int(min(MOST_PIVOTS, max(LEAST_PIVOTS, seen["n"] ** 0.5 / 4)))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(wanted).select("q").collect()
    x = np.zeros((len(chosen), seen["width"]))
    for i, r in enumerate(chosen):
        x[i, : len(r["q"])] = r["q"]
    x = np.unique(x, axis=0)
    bare = Space(x, float(seen["norm2"]), seen["width"], seen["n"], np.zeros(len(x), np.int64))
    pivots = bare.lifted(x)
    return Space(pivots, bare.norm2, bare.width, bare.rows, _bundles(pivots, max(LEAST_BUNDLES, -(-seen["anchors"] // group_anchors))))


def in_cells(rows: DataFrame, s: Space, is_anchor: bool) -> DataFrame:
    """rows with cell, the number of the nearest pivot, and near, the distance to it; an anchor's added component is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("q"), s.width)
            d = s.distances(np.hstack([x, np.zeros((len(x), 1))]) if is_anchor else s.lifted(x))
            cell = d.argmin(axis=1) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell])], names=[*b.schema.names, "cell", "near"])

    return rows.mapInArrow(run, f"{_ddl(rows)}, cell int, near double")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


class _Best:
    """The k best rows of each query of one group of anchors so far."""

    def __init__(self, anchors: list[dict], s: Space, k: int, same: bool, home: bool):
        self.ids = np.array([a["vec_id"] for a in anchors], np.int64)
        self.labels = np.array([a["label"] for a in anchors], np.int64)
        self.cells = np.array([a["cell"] for a in anchors], np.int64)
        self.x = np.zeros((len(anchors), s.width))
        for i, a in enumerate(anchors):
            self.x[i, : len(a["q"])] = a["q"]
        slots = max((len(a["lo"]) for a in anchors), default=0)
        self.lo = np.full((len(anchors), slots), HIGHEST, np.int64)
        self.hi = np.full((len(anchors), slots), LOWEST, np.int64)
        for i, a in enumerate(anchors):
            self.lo[i, : len(a["lo"])], self.hi[i, : len(a["hi"])] = a["lo"], a["hi"]
        self.k, self.same, self.home = k, same, home
        self.query = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.row = np.empty(0, np.int64)

    def add(self, ids: np.ndarray, labels: np.ndarray, cells: np.ndarray, x: np.ndarray) -> None:
        step = max(1, BLOCK // max(1, len(self.ids)))
        for at in range(0, len(ids), step):
            cut = slice(at, at + step)
            score = products(self.x, x[cut])
            fits = (self.labels[:, None] == labels[None, cut]) == self.same
            fits &= (self.cells[:, None] == cells[None, cut]) == self.home
            fits &= self.ids[:, None] != ids[None, cut]
            for slot in range(self.lo.shape[1]):
                q, r = np.nonzero(fits & (score >= self.lo[:, slot, None]) & (score <= self.hi[:, slot, None]))
                if len(q):
                    self._keep(q * self.lo.shape[1] + slot, score[q, r], ids[cut][r])

    def _keep(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        query, score, row = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.row, row])
        order = np.lexsort((row, -score, query))
        query, score, row = query[order], score[order], row[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        inside = rank < self.k
        self.query, self.score, self.row = query[inside], score[inside], row[inside]
        # From now on a row must reach the k-th score.
        full = rank[inside] == self.k - 1
        a, slot = np.divmod(self.query[full], self.lo.shape[1])
        self.lo[a, slot] = np.maximum(self.lo[a, slot], self.score[full])

    def rows(self) -> pa.RecordBatch:
        slots = max(1, self.lo.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query // slots] if len(self.query) else self.query), pa.array((self.query % slots).astype(np.int32)), pa.array(self.row), pa.array(self.score)], names=["anchor_id", "slot", "vec_id", "score"])


def _local(mixed: DataFrame, s: Space, k: int, same: bool, home: bool) -> DataFrame:
    """Joins the anchors of each (grp, part) with its rows; anchors come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, best = None, [], None
        for b in batches:
            grp, part, is_row = (b.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "part", "is_row"))
            edge = np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (part[1:] != part[:-1]) | (is_row[1:] != is_row[:-1])]) if len(grp) else []
            for at, end in zip(edge, [*edge[1:], len(grp)], strict=True):
                piece = b.slice(at, end - at)
                if key != (grp[at], part[at]):
                    if best is not None:
                        yield best.rows()
                    key, anchors, best = (grp[at], part[at]), [], None
                if not is_row[at]:
                    anchors += piece.select(["vec_id", "label", "cell", "q", "lo", "hi"]).to_pylist()
                elif anchors:
                    best = best or _Best(anchors, s, k, same, home)
                    best.add(*(piece.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "cell")), matrix(piece.column("q"), s.width))
        if best is not None:
            yield best.rows()

    return mixed.repartition("grp", "part").sortWithinPartitions("grp", "part", "is_row").mapInArrow(run, FOUND)


def _best_rows(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, from parts that hold at most k each."""
    ranked = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    first = found.withColumn("rank", ranked).filter(F.col("rank") <= k)
    one = F.struct((-F.col("score")).alias("minus"), "vec_id")
    return first.groupBy("anchor_id", "slot").agg(F.array_sort(F.collect_list(one)).alias("best"))


def _dealt(queries: DataFrame, rows: DataFrame, parts: Column) -> DataFrame:
    """Queries (with grp) copied to every part of their group, and rows (with grp) dealt over them."""
    copies = queries.select("grp", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(False).alias("is_row"), F.col("anchor_id").alias("vec_id"), "label", "cell", "q", "lo", "hi")
    none = F.array().cast("array<long>")
    dealt = rows.select("grp", F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"), F.lit(True).alias("is_row"), "vec_id", "label", "cell", "q", none.alias("lo"), none.alias("hi"))
    return copies.unionByName(dealt)


def _served(rows: DataFrame, s: Space, needs: np.ndarray, far: np.ndarray, close: np.ndarray, chunks: np.ndarray, sets: int) -> DataFrame:
    """Rows once for each group (chunk, bundle, set of labels) with an anchor that they might serve, outside their own cell.

    needs, far and close are, by set of labels and cell, the largest distance
    that a query there still accepts (-1: no anchor) and the largest and
    smallest distance of its anchors to the pivot.
    """
    n_bundles = int(s.bundle.max()) + 1
    between = np.sqrt(np.maximum(((s.pivots[:, None] - s.pivots[None]) ** 2).sum(axis=2), 0))
    slack = 1e-6 * (1 + s.norm2**0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = s.distances(s.lifted(matrix(b.column("q"), s.width)))
            cells, label = (b.column(c).to_numpy().astype(np.int64) for c in ("cell", "label"))
            for label_set in np.unique(label % sets):
                own = np.flatnonzero(label % sets == label_set)
                d, cell, at = every[own], cells[own], np.arange(len(own))
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d**2 - (d[at, cell] ** 2)[:, None]) / (2 * between[cell])
                plane = np.where(between[cell] > 0, plane, 0)
                least = np.maximum(np.maximum(d - far[label_set], close[label_set] - d), plane)
                may = (needs[label_set] >= 0) & (least <= needs[label_set] + slack)
                may[at, cell] = False
                for bundle in range(n_bundles):
                    hit = own[may[:, s.bundle == bundle].any(axis=1)]
                    for chunk in range(int(chunks[label_set, bundle]) if len(hit) else 0):
                        grp = np.full(len(hit), (chunk * n_bundles + bundle) * sets + int(label_set), np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(grp), *(b.column(c).take(pa.array(hit)) for c in ("vec_id", "label", "cell", "q"))], names=["grp", "vec_id", "label", "cell", "q"])

    return rows.select("vec_id", "label", "cell", "q").mapInArrow(run, "grp int, vec_id long, label int, cell int, q array<int>")


def join(rows: DataFrame, queries: DataFrame, s: Space, k: int, same: bool, group_anchors: int = GROUP_ANCHORS, part_rows: int = PART_ROWS) -> DataFrame:
    """anchor_id, slot and best (its k rows as minus, the score negated, and vec_id) of every query that has one.

    rows and queries are in cells; queries have an anchor_id and, for each
    slot, the lowest and highest score that counts.  same asks for rows of the
    anchor's label, else of others; a row with the anchor's id never counts.
    """
    # At home: a cell's rows are dealt over parts by how many there are, and its anchors over chunks.
    load = rows.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    chunk = lambda n: F.pmod(F.xxhash64(F.col("anchor_id"), F.lit(7)), F.greatest(n, F.lit(1))).cast("int")
    by_cell = queries.groupBy("cell").agg(F.ceil(F.count("*") / group_anchors).cast("int").alias("chunks"))
    both = F.broadcast(load.join(by_cell, "cell"))  # a row for each pivot
    name = lambda c: (c * F.lit(len(s.pivots)) + F.col("cell")).cast("int").alias("grp")
    asked = queries.join(both, "cell").select(name(chunk(F.col("chunks"))), "parts", "anchor_id", "label", "cell", "q", "lo", "hi")
    at_home = rows.join(both, "cell").select(F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"), "parts", "vec_id", "label", "cell", "q").withColumn("grp", name(F.col("c")))
    home = stored(_best_rows(_local(_dealt(asked, at_home, F.col("parts")), s, k, same, True), k))

    # What each query still needs: the score of its k-th row, or the lowest that counts.
    kth = F.when(F.size("best") >= k, -F.element_at("best", k)["minus"])
    reached = home.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", kth.alias("score")))).alias("reached"))
    norm = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    score = F.array_min(F.transform("lo", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("reached", i), x))))
    wide = F.when(F.col("least") <= LOWEST, F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(F.lit(0.0), norm + F.lit(s.norm2) - 2.0 * F.col("least"))))
    sets = LABEL_SETS if same else 1
    open_ = F.exists(F.arrays_zip("lo", "hi"), lambda w: w["lo"] <= w["hi"])
    asking = queries.filter(open_).join(reached, "anchor_id", "left").withColumn("least", score).select("anchor_id", "label", "cell", "near", "q", "lo", "hi", wide.alias("needs"), F.pmod("label", F.lit(sets)).alias("label_set"))
    needs, far, close = np.full((sets, len(s.pivots)), -1.0), np.zeros((sets, len(s.pivots))), np.zeros((sets, len(s.pivots)))
    chunks = np.zeros((sets, int(s.bundle.max()) + 1), np.int64)
    for r in asking.groupBy("label_set", "cell").agg(F.max("needs").alias("needs"), F.max("near").alias("far"), F.min("near").alias("close"), F.count("*").alias("n")).collect():  # a row for each pivot and set
        needs[r["label_set"], r["cell"]], far[r["label_set"], r["cell"]], close[r["label_set"], r["cell"]] = r["needs"], r["far"], r["close"]
        chunks[r["label_set"], s.bundle[r["cell"]]] += r["n"]
    chunks = -(-chunks // group_anchors)
    of = queries.sparkSession.createDataFrame([(int(c), int(s.bundle[c]), k_, int(chunks[k_, s.bundle[c]])) for c in range(len(s.pivots)) for k_ in range(sets)], "cell int, bundle int, label_set int, chunks int")
    grp = ((chunk(F.col("chunks")) * F.lit(chunks.shape[1]) + F.col("bundle")) * F.lit(sets) + F.col("label_set")).cast("int")
    groups = asking.join(F.broadcast(of), ["cell", "label_set"]).withColumn("grp", grp)
    parts = F.lit(max(1, -(-s.rows // part_rows)))
    away = _local(_dealt(groups, _served(rows, s, needs, far, close, chunks, sets), parts), s, k, same, False)
    at = home.select("anchor_id", "slot", F.explode("best").alias("b")).select("anchor_id", "slot", "b.vec_id", (-F.col("b.minus")).alias("score"))
    return _best_rows(away.unionByName(at), k)


def mine(vectors: DataFrame, anchors: Column, relabel: Column | None = None, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = 30, high: int = 90, n_pivots: int | None = None, group_anchors: int = GROUP_ANCHORS, part_rows: int = PART_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    anchors is a condition on vec_id.  A score is the inner product of whole
    components (256 times each, rounded down); ties go to the smaller vec_id.
    A negative has between low and high percent of its positive's score, so a
    negative score of the positive leaves none.

    Rows with a null vec_id, label or vector, or with null or non-finite
    components, take no part.  Shorter vectors count as if filled with 0.  A
    row with the anchor's vec_id is not another row; of rows that share an
    anchor's id the smallest (label, vector) is the anchor, while as candidates
    repeated rows count each.  Anchors without positives or negatives give no
    rows, an empty table none; other columns are not read.
    """
    spark = vectors.sparkSession
    chosen = participants(vectors, relabel)
    s = space(chosen, anchors, n_pivots, group_anchors)
    if s is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = stored(in_cells(chosen, s, False))
    one = chosen.filter(anchors).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "q")).alias("own")).select("anchor_id", "own.label", "own.q")
    asked = stored(in_cells(one, s, True))
    any_score = asked.withColumns({"lo": F.array(F.lit(LOWEST)), "hi": F.array(F.lit(HIGHEST))})
    near = stored(join(rows, any_score, s, n_positives, True, group_anchors, part_rows).select("anchor_id", F.col("best").alias("positives")))
    times = lambda x, percent, up: F.floor((-x["minus"] * percent + (99 if up else 0)).cast("decimal(38,0)") / 100)
    window = lambda percent, up: F.transform("positives", lambda x: times(x, percent, up).cast("long"))
    bounded = stored(asked.join(near, "anchor_id").withColumns({"lo": window(low, True), "hi": window(high, False)}))
    found = join(rows, bounded.drop("positives"), s, n_negatives, False, group_anchors, part_rows)
    both = found.join(near, "anchor_id").select("anchor_id", F.element_at("positives", F.col("slot") + 1).alias("p"), F.posexplode("best").alias("at", "b"))
    return both.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("negative_id"), (-F.col("p.minus")).alias("positive_score"), (-F.col("b.minus")).alias("negative_score"))
