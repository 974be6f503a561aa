"""Near-duplicate vectors by navigable small-world graphs, one per shard."""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetally.llm.components import connected_components
from codetally.llm.storage import file_system, new_path, stage

MIN_COSINE = 0.9
# Numbers in the vectors of a shard, about 130 MB of doubles; there are MIN_SHARDS at least.
SHARD_NUMBERS = 16_000_000
MIN_SHARDS = 4
QUERY_ROWS = 4_096
# A node's links: half are its own choice, half come from later nodes.
LINKS = 32
FIRST_BEAM = 32
# A query that this does not do for is compared with all nodes.
LAST_BEAM = 512
# In a graph of fewer nodes than this for an entry of the beam, comparing all is cheaper.
BEAM_NODES = 16
# A beam whose entries are all within this of the limit is widened.
NEAR_MARGIN = 0.1
AUDIT_QUERIES = 1024
# A sample with fewer vectors of a length is filled up with nodes of the shard.
AUDIT_LEAST = 256
AUDIT_RECALL = 0.99
# The search is in single precision: what is below the limit by less is looked at.
SLACK = 1e-4
# Numbers in the table of visited nodes.
SEEN_CELLS = 1 << 24
EXACT_CELLS = 1 << 24


def unit_vectors(rows: list) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Graph:
    """A hierarchical navigable small-world graph over unit vectors.

    Nodes are numbered so that those of level l are the first ``sizes[l]``; each
    level is built from the one above it. Nodes are inserted in batches, which are
    searched together; nodes of a batch see each other by direct comparison.
    """

    def __init__(self, vectors: np.ndarray):
        self.exact = vectors
        self.x = vectors.astype(np.float32)
        n = len(vectors)
        levels = max(0, int(math.log(max(n, 1), LINKS / 2)) - 1)
        self.sizes = [max(1, int(n / (LINKS / 2) ** level)) if level else n for level in range(levels + 1)]
        self.links = [None] * len(self.sizes)
        for level in reversed(range(len(self.sizes))):
            self._build(level)

    def _build(self, level: int) -> None:
        n, half = self.sizes[level], LINKS // 2
        links = np.full((n, LINKS), -1, np.int32)
        near = np.full((n, half), -np.inf, np.float32)
        self.links[level] = links
        start = 0
        while start < n:
            stop = min(n, start + (min(1024, max(128, start // 2)) if start else 256))
            batch = self.x[start:stop]
            own = batch @ batch.T
            np.fill_diagonal(own, -np.inf)
            keep = min(LINKS, stop - start)
            ids = np.argpartition(-own, keep - 1, axis=1)[:, :keep]
            sims = np.take_along_axis(own, ids, axis=1)
            ids = ids + start
            if start:
                entry = self._descend(batch, level, start)
                found, close = self._beam(batch, entry, level, LINKS, start)
                ids, sims = np.hstack([ids, found]), np.hstack([sims, close])
            chosen, sims = self._choose(ids, sims, half)
            links[start:stop, :half] = chosen
            self._link_back(links, near, start, chosen, sims)
            start = stop

    def _choose(self, ids: np.ndarray, sims: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Close candidates that are closer to the node than to one another, then the closest."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * count]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        valid = (ids >= 0) & np.isfinite(sims)
        vectors = self.x[np.where(valid, ids, 0)]
        among = np.einsum("bid,bjd->bij", vectors, vectors, optimize=True)
        diverse = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            worse = (among[:, j, :j] > sims[:, j : j + 1]) & diverse[:, :j]
            diverse[:, j] = valid[:, j] & ~worse.any(axis=1)
        rank = np.where(valid, np.where(diverse, 0, 1), 2)
        order = np.argsort(rank, axis=1, kind="stable")[:, :count]
        ids, sims, valid = (np.take_along_axis(a, order, 1) for a in (ids, sims, valid))
        ids, sims = np.where(valid, ids, -1), np.where(valid, sims, -np.inf)
        short = count - ids.shape[1]
        return np.pad(ids, ((0, 0), (0, max(0, short))), constant_values=-1), np.pad(
            sims, ((0, 0), (0, max(0, short))), constant_values=-np.inf
        )

    @staticmethod
    def _link_back(links: np.ndarray, near: np.ndarray, start: int, chosen: np.ndarray, sims: np.ndarray) -> None:
        """Give the chosen nodes links back, the closest of which they keep."""
        half = near.shape[1]
        rows, columns = np.nonzero(chosen >= 0)
        if not len(rows):
            return
        to, source, sim = chosen[rows, columns], rows + start, sims[rows, columns]
        order = np.lexsort((-sim, to))
        to, source, sim = to[order], source[order], sim[order]
        nodes, first = np.unique(to, return_index=True)
        rank = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        take = rank < half
        row = np.searchsorted(nodes, to[take])
        new_ids = np.full((len(nodes), half), -1, np.int32)
        new_sims = np.full((len(nodes), half), -np.inf, np.float32)
        new_ids[row, rank[take]] = source[take]
        new_sims[row, rank[take]] = sim[take]
        ids = np.hstack([links[nodes, half:], new_ids])
        both = np.hstack([near[nodes], new_sims])
        best = np.argpartition(-both, half - 1, axis=1)[:, :half]
        links[nodes, half:] = np.take_along_axis(ids, best, 1)
        near[nodes] = np.take_along_axis(both, best, 1)

    def _descend(self, queries: np.ndarray, level: int, limit: int) -> np.ndarray:
        """Entry nodes of a level, below ``limit``, by searches through the levels above."""
        entry = np.zeros((len(queries), 1), np.int32)
        for above in range(len(self.sizes) - 1, level, -1):
            entry, _ = self._beam(queries, entry, above, 8, self.sizes[above])
        entry = np.where(entry < limit, entry, -1)
        entry[(entry < 0).all(axis=1), 0] = 0
        return entry

    def _beam(
        self, queries: np.ndarray, entry: np.ndarray, level: int, width: int, limit: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` closest nodes that each query reaches, and their cosines; -1 fills up."""
        size = max(16, SEEN_CELLS // max(1, limit))
        if len(queries) > size:
            parts = [
                self._beam(queries[i : i + size], entry[i : i + size], level, width, limit)
                for i in range(0, len(queries), size)
            ]
            return np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])
        links, n = self.links[level], len(queries)
        seen = np.full((n, limit), -1, np.int16)
        ids = np.full((n, width), -1, np.int32)
        sims = np.full((n, width), -np.inf, np.float32)
        done = np.zeros((n, width), bool)
        self._merge(queries, np.arange(n), entry, seen, ids, sims, done)
        steps = max(1, width // 16)
        active = np.arange(n)
        while len(active):
            open_sims = np.where(done[active], -np.inf, sims[active])
            pick = np.argpartition(-open_sims, min(steps, width) - 1, axis=1)[:, :steps]
            live = np.isfinite(np.take_along_axis(open_sims, pick, 1))
            some = live.any(axis=1)
            active, pick, live = active[some], pick[some], live[some]
            if not len(active):
                break
            done[active[:, None], pick] = True
            nodes = np.where(live, ids[active[:, None], pick], -1)
            nearby = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(active), -1)
            self._merge(queries, active, nearby, seen, ids, sims, done)
        return ids, sims

    def _merge(self, queries, active, nodes, seen, ids, sims, done) -> None:
        """Put nodes that were not seen before into the beams of the active queries."""
        rows = active[:, None]
        valid = (nodes >= 0) & (nodes < seen.shape[1])
        safe = np.where(valid, nodes, 0)
        new = valid & (seen[rows, safe] < 0)
        at = np.broadcast_to(np.arange(nodes.shape[1], dtype=np.int16), nodes.shape)
        r, c = np.nonzero(new)
        seen[active[r], safe[r, c]] = at[r, c]
        new[r, c] = seen[active[r], safe[r, c]] == at[r, c]
        r, c = np.nonzero(new)
        close = np.full(nodes.shape, -np.inf, np.float32)
        close[r, c] = np.einsum("ij,ij->i", queries[active[r]], self.x[safe[r, c]])
        width = ids.shape[1]
        all_sims = np.hstack([sims[active], close])
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[active] = np.take_along_axis(np.hstack([ids[active], safe]), best, 1)
        done[active] = np.take_along_axis(np.hstack([done[active], np.zeros(nodes.shape, bool)]), best, 1)
        sims[active] = np.take_along_axis(all_sims, best, 1)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        q = queries.astype(np.float32)
        return self._beam(q, self._descend(q, 0, len(self.x)), 0, min(width, len(self.x)), len(self.x))

    def links_of(self, queries: np.ndarray, width: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) with a cosine of ``limit`` or more in double precision.

        A beam that holds nothing but links and near links may have missed some: such
        queries are searched again with twice the width. If links alone fill the last
        beam, or the width is more than that or too much for the graph, the query is
        compared with all nodes.
        """
        rows, nodes = [], []
        left = np.arange(len(queries))
        while len(left) and width <= min(LAST_BEAM, len(self.x) // BEAM_NODES):
            ids, sims = self.search(queries[left], width)
            margin = NEAR_MARGIN if width * 2 <= LAST_BEAM else SLACK
            full = sims.min(axis=1) >= limit - margin
            r, c = np.nonzero((sims >= limit - SLACK) & ~full[:, None])
            rows.append(left[r])
            nodes.append(ids[r, c])
            left, width = left[full], width * 2
        for start in range(0, len(left), size := max(1, EXACT_CELLS // max(1, len(self.x)))):
            part = left[start : start + size]
            r, c = np.nonzero(queries[part].astype(np.float32) @ self.x.T >= limit - SLACK)
            rows.append(part[r])
            nodes.append(c)
        r = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        c = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        sure = np.zeros(len(r), bool)
        for start in range(0, len(r), 1 << 16):
            part = slice(start, start + (1 << 16))
            sure[part] = np.einsum("ij,ij->i", queries[r[part]], self.exact[c[part]]) >= limit
        return r[sure], c[sure]

    def audited_width(
        self, limit: float, queries: np.ndarray | None = None, own: np.ndarray | None = None
    ) -> int:
        """The beam width at which :meth:`links_of` finds the links of sampled vectors.

        ``own`` is the node that each query is, or -1: a query finding itself does not
        count. If queries are few, nodes of the graph are added. The width is doubled
        from ``FIRST_BEAM`` until the share found of the links that a full comparison
        gives passes ``AUDIT_RECALL``, both of all links and on average over the queries
        with links, so that those with very many do not hide the others. If no
        beam does, the width is one that compares all.
        """
        n = len(self.x)
        if queries is None or len(queries) < AUDIT_LEAST:
            nodes = np.unique(np.linspace(0, n - 1, min(n, AUDIT_LEAST)).astype(int))
            if queries is not None:
                nodes = np.setdiff1d(nodes, own)
            added = self.exact[nodes]
            queries = added if queries is None else np.vstack([queries, added])
            own = nodes if own is None else np.concatenate([own, nodes])

        def links(width: int) -> np.ndarray:
            r, c = self.links_of(queries, width, limit)
            other = own[r] != c
            return np.unique(r[other] * n + c[other])

        width = FIRST_BEAM
        wanted = links(n + LAST_BEAM)
        of = wanted // n
        each = np.bincount(of, minlength=len(queries))
        while width <= min(LAST_BEAM, n // BEAM_NODES):
            hit = np.isin(wanted, links(width))
            per_query = np.bincount(of, hit, len(queries))[each > 0] / each[each > 0]
            if not len(wanted) or min(hit.mean(), per_query.mean()) >= AUDIT_RECALL:
                return width
            width *= 2
        return n + LAST_BEAM


_GRAPHS: dict[str, dict] = {}


def _load(path: str) -> dict:
    """The graphs of a shard by dimension; a worker keeps the last shard."""
    if path not in _GRAPHS:
        _GRAPHS.clear()
        system, place = file_system(path)
        with system.open_input_file(place) as source:
            stored = np.load(io.BytesIO(source.read()))
        graphs = {}
        for dim in stored["dims"]:
            graph = Graph.__new__(Graph)
            graph.exact = stored[f"{dim}-exact"]
            graph.x = graph.exact.astype(np.float32)
            graph.sizes = stored[f"{dim}-sizes"].tolist()
            graph.links = [stored[f"{dim}-links-{i}"] for i in range(len(graph.sizes))]
            graphs[int(dim)] = (stored[f"{dim}-ids"], graph, int(stored[f"{dim}-width"]))
        _GRAPHS[path] = graphs
    return _GRAPHS[path]


def _by_dimension(pdf: pd.DataFrame):
    for dim, part in pdf.groupby(pdf["vector"].map(len)):
        yield int(dim), part["id"].to_numpy(np.int64), unit_vectors(part["vector"].tolist())


def _usable(vector: str) -> str:
    """SQL: neither null nor empty nor zero, and all components finite numbers."""
    finite = "x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')"
    return (
        f"coalesce(size({vector}) > 0 AND forall({vector}, x -> {finite}) AND exists({vector}, x -> x <> 0), false)"
    )


def similar_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = MIN_COSINE
) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row of ``vectors``.

    Two vectors link if their cosine in double precision is ``limit`` or more.
    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do vectors of different lengths. ``n_links`` counts the other
    rows that are linked directly, ``component_id`` is the smallest id that can be
    reached, the row's own included, and ``kept`` says whether it is the row's. A
    row with a null id has null results. Empty tables give an empty table, other
    columns are not read.

    Equal vectors are one node with a number of copies. Distinct ones are dealt to
    shards of bounded size; a task builds each shard's graph, audits the beam width
    with vectors drawn from all shards and stores the graph in the shared folder. Every vector then queries every
    shard, in blocks, and pairs found from either side are joined to components. A
    vector whose links fill the widest beam, or all if the audit fails with every
    beam, are compared with the whole shard.
    """
    spark = vectors.sparkSession
    usable = vectors.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.expr(f"if({_usable(vector_col)}, {vector_col}, null)").alias("vector"),
    )
    nodes = stage(
        usable.where("vector IS NOT NULL").groupBy("vector")
        .agg(F.min("id").alias("node"), F.count("*").alias("copies")),
        "distinct-vectors",
    )
    n, numbers = nodes.agg(F.count("*"), F.sum(F.size("vector").cast("long"))).first()
    shards = max(MIN_SHARDS, -(-(numbers or 0) // SHARD_NUMBERS))
    blocks = -(-n // QUERY_ROWS) or 1
    folder = new_path(spark, "graphs")
    plain = nodes.select(F.col("node").alias("id"), "vector")
    drawn = plain.orderBy(F.xxhash64(F.lit(2), "id")).limit(AUDIT_QUERIES).toPandas()
    audits = {dim: (ids, x) for dim, ids, x in _by_dimension(drawn)}

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        stored = {"dims": []}
        for dim, ids, x in _by_dimension(pdf):
            graph = Graph(x)
            stored["dims"].append(dim)
            stored |= {f"{dim}-ids": ids, f"{dim}-exact": x, f"{dim}-sizes": np.array(graph.sizes)}
            stored |= {f"{dim}-links-{i}": links for i, links in enumerate(graph.links)}
            drawn_ids, queries = audits.get(dim, (ids[:0], x[:0]))
            node_of = {i: k for k, i in enumerate(ids.tolist())}
            own = np.array([node_of.get(i, -1) for i in drawn_ids.tolist()], np.int64)
            stored[f"{dim}-width"] = np.array(graph.audited_width(limit, queries, own))
        out = io.BytesIO()
        np.savez(out, **{k: np.asarray(v) for k, v in stored.items()})
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.npz"
        with system.open_output_stream(f"{base}/{name}", compression=None) as target:
            target.write(out.getvalue())
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "file": [f"{folder}/{name}"]})

    home = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    built = plain.select("id", "vector", home).groupBy("shard").applyInPandas(build, "shard int, file string")
    files = {r[0]: r[1] for r in stage(built, "graph-files").collect()}

    def query(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _load(files[int(pdf["shard"].iloc[0])])
        pairs = [np.zeros((0, 2), np.int64)]
        for dim, ids, x in _by_dimension(pdf):
            if dim in found:
                node_ids, graph, width = found[dim]
                rows, columns = graph.links_of(x, width, limit)
                pair = np.stack([ids[rows], node_ids[columns]], axis=1)
                pairs.append(np.sort(pair[pair[:, 0] != pair[:, 1]], axis=1))
        return pd.DataFrame(np.unique(np.concatenate(pairs), axis=0), columns=["a", "b"])

    everywhere = plain.select(
        "id", "vector", F.explode(F.array(*(F.lit(s) for s in sorted(files)))).alias("shard"),
        F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int").alias("block"),
    ) if files else plain.select("id", "vector", F.lit(0).alias("shard"), F.lit(0).alias("block")).limit(0)
    pairs = stage(
        everywhere.groupBy("shard", "block").applyInPandas(query, "a long, b long").distinct(), "vector-pairs"
    )
    labels = connected_components(pairs, "a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = nodes.select("node", "copies")
    linked = (
        both.join(copies.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    )
    result = (
        nodes.join(linked, F.col("node") == F.col("a"), "left")
        .join(labels.withColumnRenamed("node", "l"), F.col("node") == F.col("l"), "left")
        .select(
            "vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    rows = vectors.select(
        F.col(id_col).alias("id"), F.expr(f"if({_usable(vector_col)}, {vector_col}, null)").alias("vector")
    )
    id_type = vectors.schema[id_col].dataType
    component = F.coalesce("component_id", "id")
    return rows.join(result, "vector", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0)).cast("long")).alias("n_links"),
        F.when(F.col("id").isNotNull(), component.cast(id_type)).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
