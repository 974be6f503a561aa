"""Hard negatives from similarity windows, found with multiway hyperplane trees."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codetally.llm.storage import file_system, new_path

SCALE = 256
# Split points of an inner node, and rows of a leaf at most.
FANOUT, LEAF_ROWS = 16, 512
MAX_DEPTH = 24
# Split points of the top node are chosen from a sample of this many rows.
TOP_CELLS, TOP_SAMPLE = 32, 512
# Vectors of one stored tree, and anchors that are searched for together.
TREE_BYTES = 32 << 20
ANCHORS_PER_LOT = 8_192
# Trees that one piece of work searches, and scores computed at once.
TREES_PER_WORK = 16
SCORE_CELLS = 1 << 21
NONE = -(1 << 62)
# Distances are rounded: ranges are widened by this share of the largest norm.
SLACK = 1e-6
# Sums of products below this are exact in double precision in any order.
EXACT = float(1 << 53)


def inner_products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of rows of whole numbers, as 64-bit integers."""
    if exact:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return (whole(a) @ whole(b).T).astype(np.int64)


class Space:
    """Vectors with one more coordinate that makes all of them equally long.

    The distance of a query, whose additional coordinate is zero, to such a vector
    falls with their inner product alone, so that a window of inner products is an
    annulus of distances.
    """

    def __init__(self, largest: float):
        self.m2, self.exact = largest, largest < EXACT
        self.slack = SLACK * np.sqrt(largest) + 1e-9

    def extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.m2 - (x * x).sum(axis=1)))

    def between(self, p: np.ndarray, x: np.ndarray) -> np.ndarray:
        squared = 2 * (self.m2 - p @ x.T - np.outer(self.extra(p), self.extra(x)))
        return np.sqrt(np.maximum(0.0, squared))

    def to_queries(self, q: np.ndarray, products: np.ndarray) -> np.ndarray:
        squared = ((q * q).sum(axis=1) + self.m2)[:, None] - 2.0 * products
        return np.sqrt(np.maximum(0.0, squared))


def split_points(space: Space, x: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``x`` that are far apart, each the farthest from those before; fewer if they repeat."""
    chosen = [0]
    nearest = space.between(x[:1], x)[0]
    while len(chosen) < min(count, len(x)):
        far = int(nearest.argmax())
        if nearest[far] <= 10 * space.slack:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, space.between(x[far : far + 1], x)[0])
    return x[chosen]


def surviving(
    to_splits: np.ndarray, near: np.ndarray, far: np.ndarray, least: np.ndarray, most: np.ndarray, slack: float
) -> np.ndarray:
    """Which subtrees can hold a point of each query's annulus.

    ``least[i, j]`` and ``most[i, j]`` bound the distances of split point i to the
    points of subtree j. By the triangle inequality a point at a distance from
    ``near`` to ``far`` of the query lies in a range of distances of each split
    point; a subtree goes if its range of any split point misses that one.
    """
    low = np.maximum(to_splits - far[:, None], near[:, None] - to_splits) - slack
    high = to_splits + far[:, None] + slack
    return ((most[None] >= low[:, :, None]) & (least[None] <= high[:, :, None])).all(axis=1)


class Tree:
    """A multiway hyperplane tree over rows; each row goes to its closest split point.

    A node stores for each pair of a split point and a subtree, siblings included,
    the range of distances between them.
    """

    def __init__(self, space: Space, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.nodes: list[tuple] = []
        self._build(space, np.arange(len(ids)), 0)

    def _build(self, space: Space, rows: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append(("leaf", rows))
        if len(rows) <= LEAF_ROWS or depth >= MAX_DEPTH:
            return at
        x = self.x[rows]
        splits = split_points(space, x[:: max(1, len(x) // (8 * FANOUT))], FANOUT)
        distances = space.between(splits, x)
        closest = distances.argmin(axis=0)
        parts = [np.flatnonzero(closest == j) for j in range(len(splits))]
        if max(map(len, parts)) == len(rows):
            return at
        splits = splits[[j for j, part in enumerate(parts) if len(part)]]
        distances = distances[[j for j, part in enumerate(parts) if len(part)]]
        parts = [part for part in parts if len(part)]
        least = np.stack([distances[:, part].min(axis=1) for part in parts], axis=1)
        most = np.stack([distances[:, part].max(axis=1) for part in parts], axis=1)
        children = [self._build(space, rows[part], depth + 1) for part in parts]
        labels = [np.unique(self.labels[rows[part]]) for part in parts]
        self.nodes[at] = ("split", splits, least, most, children, labels)
        return at

    def search(self, space: Space, search: Search, active: np.ndarray) -> None:
        """Lets the active anchors of a search see every row that they may need."""
        stack = [(0, active)]
        while stack:
            at, active = stack.pop()
            active, near, far = search.annuli(space, active)
            if not len(active):
                continue
            node = self.nodes[at]
            if node[0] == "leaf":
                rows = node[1]
                search.see(space, active, self.ids[rows], self.labels[rows], self.x[rows])
                continue
            _, splits, least, most, children, labels = node
            q = search.x[active]
            distances = space.to_queries(q, q @ splits.T)
            keep = surviving(distances, near, far, least, most, space.slack)
            for j in np.argsort(-distances.mean(axis=0)):
                some = active[keep[:, j]]
                stack.append((children[j], some[search.wants(some, labels[j])]))


class Search:
    """For each anchor and window, the ``count`` best rows seen so far.

    Best are higher scores, then smaller ids. A window ``low, high`` is closed and
    narrows to the scores that can still be among the best.
    """

    def __init__(self, ids, labels, x, low, high, count: int, same_label: bool):
        self.ids, self.labels, self.x = ids, labels, x
        self.low, self.high, self.count, self.same = low, high, count, same_label
        self.scores = np.full((*low.shape, count), NONE, np.int64)
        self.found = np.zeros((*low.shape, count), np.int64)

    def floor(self, active: np.ndarray) -> np.ndarray:
        return np.maximum(self.low[active], self.scores[active, :, -1])

    def annuli(self, space: Space, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchors with open windows, and the distances between which they still look."""
        low, high = self.floor(active), self.high[active]
        open_ = low <= high
        some = open_.any(axis=1)
        active, low, high, open_ = active[some], low[some], high[some], open_[some]
        if not len(active):
            return active, np.zeros(0), np.zeros(0)
        least = np.where(open_, low, -NONE).min(axis=1).astype(np.float64)
        most = np.where(open_, high, NONE).max(axis=1).astype(np.float64)
        distances = space.to_queries(self.x[active], np.stack([most, least], axis=1))
        return active, distances[:, 0], distances[:, 1]

    def wants(self, active: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Which anchors can use rows that have these labels."""
        if self.same:
            return np.isin(self.labels[active], labels)
        return (len(labels) > 1) | (self.labels[active] != labels[0])

    def see(self, space: Space, active, ids, labels, x) -> None:
        step = max(1, SCORE_CELLS // max(1, len(ids)))
        for start in range(0, len(active), step):
            part = active[start : start + step]
            scores = inner_products(self.x[part], x, space.exact)
            fits = self.labels[part][:, None] == labels
            if self.same:
                fits &= self.ids[part][:, None] != ids
            else:
                fits = ~fits
            scores = np.where(fits, scores, NONE)
            floor, high = self.floor(part), self.high[part]
            for w in range(floor.shape[1]):
                inside = (scores >= floor[:, w : w + 1]) & (scores <= high[:, w : w + 1]) & fits
                some = np.flatnonzero(inside.any(axis=1))
                if len(some):
                    self._keep(part[some], w, np.where(inside[some], scores[some], NONE), ids)

    def _keep(self, rows: np.ndarray, w: int, scores: np.ndarray, ids: np.ndarray) -> None:
        at = np.arange(len(rows))
        best, best_ids = [self.scores[rows, w]], [self.found[rows, w]]
        for _ in range(min(self.count, scores.shape[1])):
            column = scores.argmax(axis=1)  # ids rise: the first of equal ones has the smallest
            best.append(scores[at, column][:, None])
            best_ids.append(ids[column][:, None])
            scores[at, column] = NONE
        best, best_ids = np.hstack(best), np.hstack(best_ids)
        order = np.lexsort((best_ids, -best), axis=1)[:, : self.count]
        self.scores[rows, w] = np.take_along_axis(best, order, 1)
        self.found[rows, w] = np.take_along_axis(best_ids, order, 1)

    def results(self) -> tuple[np.ndarray, ...]:
        """Anchor, window, score and id of all that was found."""
        anchor, window, at = np.nonzero(self.scores > NONE)
        return anchor, window, self.scores[anchor, window, at], self.found[anchor, window, at]


def _seed(space: Space, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, count: int) -> np.ndarray:
    """A score that ``count`` others of each anchor's label reach for certain: that of anchors beside it."""
    low = np.full(len(ids), NONE, np.int64)
    step = max(1, SCORE_CELLS // max(1, len(ids)))
    _, first = np.unique(ids, return_index=True)
    for start in range(0, len(ids), step):
        part = slice(start, start + step)
        scores = inner_products(x[part], x[first], space.exact)
        fits = (labels[part][:, None] == labels[first]) & (ids[part][:, None] != ids[first])
        scores = np.where(fits, scores, NONE)
        if scores.shape[1] >= count:
            low[part] = -np.partition(-scores, count - 1, axis=1)[:, count - 1]
    return low


def _store(folder: str, name: str, value: object) -> None:
    """A file in the shared folder, whole or not there at all."""
    system, base = file_system(folder)
    system.create_dir(base, recursive=True)
    written = f"{base}/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(written, compression=None) as target:
        target.write(pickle.dumps(value, protocol=5))
    system.move(written, f"{base}/{name}")


def _fetch(folder: str, name: str):
    system, base = file_system(folder)
    with system.open_input_file(f"{base}/{name}") as source:
        return pickle.loads(source.read())


def _exists(folder: str, name: str) -> bool:
    system, base = file_system(folder)
    return system.get_file_info(f"{base}/{name}").is_file


def _pieces(counts: list[int], size: int) -> list[int]:
    """Into how many pieces of about ``size`` rows each cell is cut."""
    return [-(-n // size) for n in counts]


def _shared_lots(counts: list[int], size: int) -> list[tuple[int, int]]:
    """First lot and number of lots of each cell; cells with few anchors share a lot."""
    lots, lot, room = [], -1, 0
    for n in counts:
        pieces = -(-n // size)
        if pieces > 1:
            lots.append((lot + 1, pieces))
            lot, room = lot + pieces, 0
        else:
            if n > room:
                lot, room = lot + 1, size
            lots.append((max(lot, 0), 1))
            room -= n
    return lots


def _spread(ids: np.ndarray) -> np.ndarray:
    """Non-negative numbers that are spread evenly whatever the ids are."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ (mixed >> np.uint64(31))).astype(np.int64) & ((1 << 62) - 1)


def _whole(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors in whole numbers, shorter ones filled with zeros."""
    out = np.zeros((len(column), dim))
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = np.diff(column.offsets.to_numpy())
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _group_rows(pdf: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of a group in a fixed order, exact repeats once."""
    kept = sorted(set(zip(pdf["id"].tolist(), pdf["label"].tolist(), pdf["vec"].tolist())))
    ids = np.array([r[0] for r in kept], np.int64)
    labels = np.array([r[1] for r in kept], np.int64)
    return ids, labels, np.frombuffer(b"".join(r[2] for r in kept), np.float64).reshape(len(kept), dim)


class Forest:
    """The stored trees below the top node, and lots of anchors to search them for."""

    def __init__(self, folder: str, space: Space, dim: int, splits: np.ndarray):
        self.folder, self.space, self.dim, self.splits = folder, space, dim, splits

    def cells_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distances = self.space.between(self.splits, x)
        return distances.argmin(axis=0), distances

    def rank_ranges(self, rows: DataFrame, tree_rows: int, anchors_per_lot: int) -> None:
        """Ranges of distances and numbers of rows and anchors by top cell, over all rows."""
        dim, cells_of = self.dim, self.cells_of

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, distances = cells_of(_whole(batch.column(2), dim))
                anchor = batch.column(3).to_numpy(zero_copy_only=False)
                out = []
                for c in np.unique(cell).tolist():
                    mine = cell == c
                    for split, d in enumerate(distances[:, mine]):
                        n = (int(mine.sum()), int((anchor & mine).sum())) if split == 0 else (0, 0)
                        out.append({"cell": c, "split": split, "least": d.min(), "most": d.max(), "n": n[0], "anchors": n[1]})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=fields)

        fields = pa.schema([
            ("cell", pa.int32()), ("split", pa.int32()), ("least", pa.float64()), ("most", pa.float64()),
            ("n", pa.int64()), ("anchors", pa.int64()),
        ])
        found = (
            rows.mapInArrow(ranges, "cell int, split int, least double, most double, n long, anchors long")
            .groupBy("cell", "split")
            .agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"), F.sum("anchors").alias("anchors"))
            .collect()
        )
        m = len(self.splits)
        self.least, self.most = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        counts, anchors = [0] * m, [0] * m
        for r in found:
            self.least[r["split"], r["cell"]], self.most[r["split"], r["cell"]] = r["least"], r["most"]
            counts[r["cell"]] += r["n"]
            anchors[r["cell"]] += r["anchors"]
        self.pieces = _pieces(counts, tree_rows)
        self.lots = _shared_lots(anchors, anchors_per_lot)
        self.n_lots = max((first + n for first, n in self.lots), default=0) if sum(anchors) else 0
        self.trees = [(c, p) for c, n in enumerate(self.pieces) for p in range(n)]

    def store(self, rows: DataFrame) -> None:
        """Builds and stores all trees, and all lots of anchors."""
        dim, cells_of, folder, space = self.dim, self.cells_of, self.folder, self.space
        pieces, lots = np.maximum(1, self.pieces), np.array(self.lots)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _whole(batch.column(2), dim)
                cell, _ = cells_of(x)
                spread = _spread(batch.column(0).to_numpy())
                places = [
                    ("tree", cell, spread % pieces[cell], np.ones(len(cell), bool)),
                    ("lot", lots[cell, 0] + spread % lots[cell, 1], np.zeros(len(cell), np.int64),
                     batch.column(3).to_numpy(zero_copy_only=False)),
                ]
                vec = pa.array([v.tobytes() for v in x], pa.binary())
                for kind, a, b, mask in places:
                    arrays = [
                        pa.array([kind] * len(cell)), pa.array(a, pa.int32()), pa.array(b, pa.int32()),
                        batch.column(0), batch.column(1), vec,
                    ]
                    names = ["kind", "a", "b", "id", "label", "vec"]
                    yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(mask))

        def keep(pdf: pd.DataFrame) -> pd.DataFrame:
            kind, a, b = pdf["kind"].iloc[0], int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
            group = _group_rows(pdf, dim)
            _store(folder, f"{kind}-{a}-{b}", vars(Tree(space, *group)) if kind == "tree" else group)
            return pd.DataFrame({"n": [len(group[0])]})

        dealt = rows.mapInArrow(deal, "kind string, a int, b int, id long, label long, vec binary")
        dealt.groupBy("kind", "a", "b").applyInPandas(keep, "n long").agg(F.sum("n")).collect()

    def work(self, start_search, schema: str, spark) -> DataFrame:
        """Every lot searched for in every tree that its anchors may need.

        ``start_search(lot)`` gives a search and the columns that its results begin
        with, or None. A task takes groups of trees for one lot after the other, so
        that windows narrow from tree to tree.
        """
        trees, space, folder = self.trees, self.space, self.folder
        splits, least, most = self.splits, self.least, self.most
        size = max(1, min(TREES_PER_WORK, self.n_lots * len(trees) // (2 * spark.sparkContext.defaultParallelism)))
        groups = -(-len(trees) // size)
        total = self.n_lots * groups

        def search_group(search: Search, group: int) -> None:
            for c, p in trees[group * size : (group + 1) * size]:
                active, near, far = search.annuli(space, np.arange(len(search.ids)))
                if not len(active):
                    return
                q = search.x[active]
                keep = surviving(space.to_queries(q, q @ splits.T), near, far, least[:, c : c + 1], most[:, c : c + 1], space.slack)
                active = active[keep[:, 0]]
                if len(active):
                    tree = Tree.__new__(Tree)
                    vars(tree).update(_fetch(folder, f"tree-{c}-{p}"))
                    tree.search(space, search, active)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lot = started = None
            for pdf in batches:
                for piece in pdf["id"].tolist():
                    if lot != piece // groups:
                        if started:
                            yield started[1](started[0])
                        lot = piece // groups
                        started = start_search(lot)
                    if started:
                        search_group(started[0], piece % groups)
            if started:
                yield started[1](started[0])

        return spark.range(0, total, 1, max(1, min(total, max(64, total // 16)))).mapInPandas(run, schema)


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    top_cells: int = TOP_CELLS,
    tree_bytes: int = TREE_BYTES,
    anchors_per_lot: int = ANCHORS_PER_LOT,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A component x counts as floor(256 x), a score is an inner product of whole
    numbers, exact as long as it fits a long. Anchors are the rows for which
    ``is_anchor`` holds. An anchor's positives are the ``positives`` other rows
    of its label with the highest scores; its negatives for a positive are the
    ``negatives`` best rows of other labels with scores of ``window`` percent of
    the positive's, ends included. Of equal scores the smaller id comes first.

    Rows with a null id, label or vector, or with a null or non-finite component,
    take no part. Missing components of shorter vectors count as zero. Exact repeats
    of a row count once; different rows of one id are rows of their own, but never
    each other's positives. Empty tables give an empty table, other columns are not
    read.

    The top node of a multiway hyperplane tree has split points from a bounded
    sample; its cells, cut into pieces of bounded size, are trees that tasks build
    and store in the shared folder. Lots of anchors meet groups of trees as pieces
    of work. The ranges of the top node decide which trees a lot needs, those
    within a tree which of its leaves; leaves are compared in whole numbers.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = (
        vectors.select(
            F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
            F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        )
        .where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
        .where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    )

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dim = int(np.diff(batch.column(0).offsets.to_numpy()).max())
                x = _whole(batch.column(0), dim)
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "norm": [float((x * x).sum(axis=1).max())]})

    dim, norm = rows.select("v").mapInArrow(norms, "dim int, norm double").agg(F.max("dim"), F.max("norm")).first()
    if dim is None:
        return spark.createDataFrame([], schema)
    space = Space(norm)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(TOP_SAMPLE).select("v").toArrow()
    splits = split_points(space, _whole(drawn["v"].combine_chunks(), dim), top_cells)
    forest = Forest(new_path(spark, "trees"), space, dim, splits)
    forest.rank_ranges(rows, max(LEAF_ROWS, tree_bytes // (8 * max(dim, 1))), anchors_per_lot)
    if not forest.n_lots:
        return spark.createDataFrame([], schema)
    forest.store(rows)
    folder = forest.folder

    def find_positives(lot: int):
        ids, labels, x = _fetch(folder, f"lot-{lot}-0")
        low = _seed(space, ids, labels, x, positives)[:, None]

        def rows_of(search: Search) -> pd.DataFrame:
            anchor, _, score, found = search.results()
            return pd.DataFrame({"lot": lot, "anchor": anchor, "score": score, "id": found})

        return Search(ids, labels, x, low, np.full_like(low, -NONE), positives, True), rows_of

    found = forest.work(find_positives, "lot int, anchor int, score long, id long", spark)
    best = Window.partitionBy("lot", "anchor").orderBy(F.desc("score"), "id")
    chosen = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)

    def store_windows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["anchor", "rank"])
        _store(folder, f"windows-{pdf['lot'].iloc[0]}", {c: pdf[c].to_numpy(np.int64) for c in ("anchor", "rank", "score", "id")})
        return pd.DataFrame({"n": [len(pdf)]})

    chosen.groupBy("lot").applyInPandas(store_windows, "n long").agg(F.sum("n")).collect()

    def find_negatives(lot: int):
        if not _exists(folder, f"windows-{lot}"):
            return None
        ids, labels, x = _fetch(folder, f"lot-{lot}-0")
        wanted = _fetch(folder, f"windows-{lot}")
        at = wanted["anchor"], wanted["rank"] - 1
        low, high = np.zeros((len(ids), positives), np.int64), np.full((len(ids), positives), -1)
        score, positive = np.zeros_like(low), np.zeros_like(low)
        score[at], positive[at] = wanted["score"], wanted["id"]
        whole = wanted["score"].astype(object)
        low[at] = (-(-window[0] * whole // 100)).astype(np.int64)
        high[at] = (window[1] * whole // 100).astype(np.int64)

        def rows_of(search: Search) -> pd.DataFrame:
            anchor, which, scores, found = search.results()
            return pd.DataFrame({
                "lot": lot, "anchor": anchor, "which": which, "anchor_id": ids[anchor],
                "positive_id": positive[anchor, which], "positive_score": score[anchor, which],
                "negative_id": found, "negative_score": scores,
            })

        return Search(ids, labels, x, low, high, negatives, False), rows_of

    fields = "lot int, anchor int, which int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = forest.work(find_negatives, fields, spark)
    best = Window.partitionBy("lot", "anchor", "which").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
