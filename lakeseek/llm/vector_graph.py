"""Embedding near-dedup over a robust-pruned flat graph.

1. Equal vectors of a label collapse to one. Each label is cut into cells around centroids, fitted on a bounded sample; every vector
   belongs to its nearest OVERLAP cells, so the cells overlap; cells that are close to each other overlap in a joint cell too.
2. Every cell builds a graph of its vectors by robust pruning: a vector keeps a near neighbour only if none it has kept is closer to
   that neighbour by the factor ALPHA. A spanning tree of the largest cosines joins crowds that pruning leaves apart. The cells' adjacency lists are joined into one list for each vector.
3. Every vector searches its cells: greedily from the cell's medoid with a beam, then expanding its range, over all neighbours of
   itself and what lies within the threshold plus SLACK, until nothing new is found. Pairs are verified by cosine in double precision.
4. audit() measures recall against brute force.

Cells are cut so that they hold about CELL vectors whatever the label's size; one that comes out larger than 4 * CELL is dealt into
chunks whose pairs are cells. No label is ever in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import components, saved

CELL, OVERLAP, SAMPLE = 600, 2, 32
#: Centroids at least this close to each other make a joint cell.
CLOSE = 0.75
#: Centroids in all, unless there are more labels: this bounds the sample and the broadcast. Larger cells than these make are dealt into chunks.
MOST_CENTROIDS = 4096
DEGREE, ALPHA, BEAM, SLACK = 20, 1.15, 12, 0.05


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def _matrix(column) -> np.ndarray:
    values = column.values.to_numpy(zero_copy_only=False) if hasattr(column, "values") else np.array(column.to_pylist())
    offsets = column.offsets.to_numpy()
    return values[offsets[0] : offsets[-1]].reshape(len(column), -1).astype(np.float64)


def centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k unit centroids of unit vectors, by spherical k-means from evenly chosen starts."""
    at = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        near = (sample @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, sample)
        full = np.linalg.norm(sums, axis=1) > 1e-9
        at[full] = _unit(sums[full])
    return at


def robust_prune(sims: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours [n, degree] (-1: none) of each vector, from all cosines [n, n]."""
    n = len(sims)
    far = np.sqrt(np.maximum(0, 2 - 2 * sims)).astype(np.float32)
    order = np.argsort(far + np.eye(n, dtype=np.float32) * 9, axis=1)[:, : min(n - 1, 6 * degree)]
    out, filled = np.full((n, degree), -1, np.int64), np.zeros(n, np.int64)
    alive = np.ones(order.shape, bool)
    rows = np.arange(n)
    for j in range(order.shape[1]):
        take = alive[:, j] & (filled < degree)
        r, c = rows[take], order[take, j]
        if not len(r):
            continue
        out[r, filled[r]] = c
        filled[r] += 1
        rest = order[r, j + 1 :]
        alive[r, j + 1 :] &= alpha * far[c[:, None], rest] > far[r[:, None], rest]
    return out


def bridges(sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of the spanning tree of largest cosines: pruning sees near candidates only, so crowds would be parts of their own."""
    best, near, out = sims[0].copy(), np.zeros(len(sims), np.int64), np.zeros((2, len(sims) - 1), np.int64)
    best[0] = -9
    used = best < -8
    for i in range(len(sims) - 1):
        j = int(best.argmax())
        out[:, i] = near[j], j
        used[j], best[j] = True, -9
        closer = (sims[j] > best) & ~used
        best[closer], near[closer] = sims[j, closer], j
    return out[0], out[1]


def adjacency(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the vectors of a cell: pruned neighbours, and bridges between what they leave apart."""
    if len(vecs) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sims = np.clip(vecs @ vecs.T, -1, 1)
    near = robust_prune(sims)
    a, b = np.nonzero(near >= 0)
    c, d = bridges(sims)
    return np.concatenate((a, c)), np.concatenate((near[a, b], d))


def _built(batches):
    """Rows (cell, id, vec) sorted by cell -> (id, near): each cell's adjacency lists, both ways."""
    for _, ids, vecs in _by_cell(batches):
        a, b = adjacency(vecs)
        a, b = ids[a], ids[b]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, b))), pa.array(np.concatenate((b, a)))], names=["id", "near"])


def _by_cell(batches):
    """(cell, ids, unit vectors) of rows sorted by cell, of which a cell's rows may span batches."""
    at, ids, vecs = None, [], []
    for batch in batches:
        cell, own, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _unit(_matrix(batch.column(2))) if batch.num_rows else None
        if v is None:
            continue
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if at is not None and cell[s] != at:
                yield at, np.concatenate(ids), np.concatenate(vecs)
                ids, vecs = [], []
            at = cell[s]
            ids.append(own[s:e])
            vecs.append(v[s:e])
    if at is not None:
        yield at, np.concatenate(ids), np.concatenate(vecs)


#: Numbers that a step of the search gathers at once.
GATHER = 1_500_000


def search(vecs: np.ndarray, near: list[np.ndarray], threshold: float, beam: int = BEAM, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, found) of rows with cosine of at least threshold - 1e-9, each row a query, over adjacency lists."""
    n = len(vecs)
    table = np.full((n, max(1, max((len(x) for x in near), default=0))), -1, np.int32)
    for i, x in enumerate(near):
        table[i, : len(x)] = x
    medoid = int((vecs @ _unit(vecs.sum(0) + 1e-12)).argmax())
    step = max(1, GATHER // (table.shape[1] * vecs.shape[1]))
    found = [_search_block(vecs, table, np.arange(s, min(n, s + step)), medoid, threshold, beam, slack) for s in range(0, n, step)]
    return tuple(np.concatenate([f[j] for f in found]) for j in range(2))


def _cosines(vecs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = max(1, GATHER // vecs.shape[1])
    return np.concatenate([np.einsum("id,id->i", vecs[a[s : s + step]], vecs[b[s : s + step]]) for s in range(0, len(a), step)] or [np.empty(0)])


def _search_block(vecs, table, rows, medoid, threshold, beam, slack):
    m, n = len(rows), len(vecs)
    pool, sims = np.full((m, 1), medoid), (vecs[rows] @ vecs[medoid])[:, None]
    done = np.zeros((m, 1), bool)
    live = np.arange(m)
    while len(live):
        # Each live query expands the best of its pool that isn't expanded yet.
        score = np.where(done[live], -9.0, sims[live])
        best = score.argmax(1)
        open_ = score[np.arange(len(live)), best] > -9
        live, best = live[open_], best[open_]
        if not len(live):
            break
        done[live, best] = True
        new = table[pool[live, best]]
        fresh = new >= 0
        for j in range(pool.shape[1]):
            fresh &= new != pool[live, j][:, None]
        got = np.where(fresh, np.einsum("qd,qkd->qk", vecs[rows[live]], vecs[new]), -9.0)
        every, ids = np.concatenate((sims[live], got), 1), np.concatenate((pool[live], new), 1)
        seen = np.concatenate((done[live], ~fresh), 1)
        top = np.argsort(-every, axis=1, kind="stable")[:, :beam]
        grow = min(beam, every.shape[1]) - pool.shape[1]
        if grow > 0:
            pool = np.concatenate((pool, np.zeros((m, grow), pool.dtype)), 1)
            sims = np.concatenate((sims, np.full((m, grow), -9.0)), 1)
            done = np.concatenate((done, np.ones((m, grow), bool)), 1)
        pool[live, : top.shape[1]], sims[live, : top.shape[1]], done[live, : top.shape[1]] = (np.take_along_axis(x, top, 1) for x in (ids, every, seen))
    # From all that lies near enough, and the query itself, the range grows over neighbours.
    q, c = np.nonzero(sims >= threshold - slack)
    known = frontier = np.unique(np.concatenate((q * n + pool[q, c], np.arange(m) * n + rows)))
    while len(frontier):
        grown = []
        for s in range(0, len(frontier), step := max(1, GATHER // table.shape[1])):
            part = frontier[s : s + step]
            new = table[part % n]
            code = (np.repeat(part // n, new.shape[1]) * n + new.ravel())[new.ravel() >= 0]
            code = np.setdiff1d(code, known)
            grown.append(code[_cosines(vecs, rows[code // n], code % n) >= threshold - slack])
        frontier = np.unique(np.concatenate(grown))
        known = np.union1d(known, frontier)
    q, at = rows[known // n], known % n
    fits = (_cosines(vecs, q, at) >= threshold - 1e-9) & (q != at)
    return q[fits], at[fits]


def _searched(threshold: float):
    """Rows (cell, id, vec, near) sorted by cell -> links (a, b), a < b, verified."""

    def run(batches):
        lists: dict = {}

        def kept(batches):
            for batch in batches:
                for c, i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                    lists[c, i] = np.array(x.values.to_numpy() if x.is_valid else [], np.int64)
                yield batch

        for cell, ids, vecs in _by_cell(kept(batches)):
            order = np.argsort(ids)
            ids, vecs = ids[order], vecs[order]
            near = []
            for i in ids.tolist():
                x = lists.pop((cell, i))
                at = np.searchsorted(ids, x)
                near.append(np.unique(at[ids[np.minimum(at, len(ids) - 1)] == x]))
            q, at = search(vecs, near, threshold)
            a, b = np.minimum(q, at), np.maximum(q, at)
            pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], names=["a", "b"])

    return run


def _cells(spec, n_cells: int):
    """(id, label, vec) -> (cell, id, vec): each vector in its nearest cells, and in the joint cells of its nearest one with each cell close to that.

    spec: label -> (number of its first cell, centroids, for each the numbers of those close to it). Joint cells are numbered from n_cells on.
    """

    def run(batches):
        for batch in batches:
            vecs, labels = _unit(_matrix(batch.column(2))) if batch.num_rows else np.empty((0, 1)), batch.column(1).to_pylist()
            cell, row = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for label in set(labels):
                mine = np.flatnonzero([x == label for x in labels])
                first, at, close = spec.value[label]
                sims = vecs[mine] @ at.T
                k = min(OVERLAP, len(at))
                near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                cell.append((first + near).ravel())
                row.append(np.repeat(mine, k))
                own = sims.argmax(1)
                for c in np.unique(own).tolist():
                    if len(close[c]):
                        who = mine[own == c]
                        joint = n_cells + (first + np.minimum(c, close[c])) * n_cells + first + np.maximum(c, close[c])
                        cell.append(np.tile(joint, len(who)))
                        row.append(np.repeat(who, len(joint)))
            cell, row = np.concatenate(cell), pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0).take(row), batch.column(2).take(row)], names=["cell", "id", "vec"])

    return run


def _usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    v = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), v.alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    # Lengths that differ can't be compared: a vector links only with those of its own length.
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("label", F.struct("label", F.size("vec").alias("n")))


def graph_links(distinct: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Links (a, b), a < b, between rows (id, label, vec) of distinct vectors."""
    spark = distinct.sparkSession
    sizes = distinct.groupBy("label").agg(F.count(F.lit(1)).alias("m")).select(F.to_json("label").alias("label"), "m").collect()
    n_cells = {r[0]: max(1, -(-r[1] * OVERLAP // CELL)) for r in sizes}
    wanted = sum(n_cells.values())
    if wanted > MOST_CENTROIDS:
        n_cells = {k: max(1, c * MOST_CENTROIDS // wanted) for k, c in n_cells.items()}
    rows = distinct.select("id", F.to_json("label").alias("label"), "vec")
    # A centroid is fitted on about SAMPLE vectors, chosen by hash.
    rate = spark.createDataFrame([(k, min(1.0, SAMPLE * c / m)) for (k, m), c in zip(sizes, n_cells.values(), strict=True)], "label string, rate double")
    drawn = rows.join(F.broadcast(rate), "label").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("rate") * 1_000_000).select("label", "id", "vec").toPandas().sort_values("id")
    spec, first = {}, 0
    for label, c in n_cells.items():
        own = drawn["vec"][drawn["label"] == label]
        sample = _unit(np.stack([np.asarray(x, np.float64) for x in own])) if len(own) else None
        at = centroids(sample, min(c, len(sample))) if sample is not None else None
        spec[label] = first, at if at is not None else np.zeros((1, 1))
        first += len(spec[label][1])
    empty = [k for k, (_, at) in spec.items() if at.shape == (1, 1)]
    if empty:  # no sample: one cell, any direction
        wide = dict(rows.where(F.col("label").isin(empty)).groupBy("label").agg(F.max(F.size("vec"))).collect())
        spec |= {k: (spec[k][0], np.ones((1, wide[k]))) for k in empty}
    # Where vectors crowd, several centroids lie in one crowd, and a vector's neighbours in more cells than it has itself.
    near = {k: [np.flatnonzero((x >= CLOSE) & (np.arange(len(x)) != i)) for i, x in enumerate(at @ _unit(at).T)] for k, (_, at) in spec.items()}
    shared = spark.sparkContext.broadcast({k: (*v, near[k]) for k, v in spec.items()})
    dealt = saved(rows.mapInArrow(_cells(shared, first), "cell long, id long, vec array<double>"))
    # A cell that came out far too large is dealt into chunks, and every two chunks make a cell.
    large = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 4 * CELL).select("cell", F.ceil(F.col("m") / CELL).cast("long").alias("chunks"))
    if large.take(1):
        own = F.pmod(F.xxhash64("id"), F.col("chunks"))
        pair = F.expr("explode(sequence(0L, coalesce(chunks, 1L) - 1))")
        dealt = dealt.join(large, "cell", "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", pair)
        dealt = saved(dealt.select(F.when(F.col("chunks").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))).alias("cell"), "id", "vec"))
    built = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_built, "id long, near long")
    graph = built.groupBy("id").agg(F.collect_set("near").alias("near"))  # at most OVERLAP * 2 lists of a vector, none beyond its cells
    placed = dealt.join(graph, "id", "left").select("cell", "id", "vec", "near").repartition("cell").sortWithinPartitions("cell")
    return placed.mapInArrow(_searched(threshold), "a long, b long").distinct()


def near_vectors(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null and their cosine, in double precision, is at least the threshold. Vectors that are null, empty,
    zero or hold null or non-finite components, or whose id is null, link with nothing: n_links 0, their own component, kept (null id: component and kept null).
    Equal vectors are one node of the graph, and count each other as links. Rows that repeat a vec_id are taken as the vectors of one id. An empty table gives no rows.
    """
    usable = _usable(vectors, vec_id, embedding, label)
    copies = saved(usable.select("id", "label", "vec").distinct())  # a repeated row is no other vector
    classes = saved(copies.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m")))
    member = copies.select("id", "label", "vec").join(classes, ["label", "vec"]).select("id", "rep", "m")
    links = saved(graph_links(classes.select(F.col("rep").alias("id"), "label", "vec"), threshold)) if classes.take(1) else None
    if links is None:
        out = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"))
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.when(F.col("vec_id").isNotNull(), True).alias("kept"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = classes.groupBy("rep").agg(F.sum("m").alias("m"))
    n = both.join(size, both["b"] == size["rep"]).groupBy("a").agg(F.sum("m").alias("others"))
    labels = components(links).withColumnsRenamed({"node": "_n", "label": "_c"})
    # One row for each id, whatever repeats.
    known = member.join(n, member["rep"] == n["a"], "left").join(labels, member["rep"] == labels["_n"], "left").groupBy("id").agg(F.max(F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.min(F.coalesce("_c", "rep")).alias("component_id"))
    out = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id")).join(known.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def audit(vectors: DataFrame, links: DataFrame, threshold: float = 0.93, queries: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> float:
    """Recall of links (a, b) over the distinct vectors: `queries` of them, chosen by hash, against all by brute force, in blocks. 1.0 without pairs."""
    rows = _usable(vectors, vec_id, embedding, label)
    rows = rows.groupBy("label", "vec").agg(F.min("id").alias("id")).select("id", F.to_json("label").alias("label"), "vec")
    asked = rows.orderBy(F.xxhash64("id")).limit(queries).toPandas()
    held = rows.sparkSession.sparkContext.broadcast({k: (g["id"].to_numpy(np.int64), _unit(np.stack([np.asarray(x, float) for x in g["vec"]]))) for k, g in asked.groupby("label")})

    def run(batches):
        for batch in batches:
            ids, labels, vecs = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist()), _matrix(batch.column(2)) if batch.num_rows else None
            out = [np.empty((0, 2), np.int64)]
            for k, (q, at) in held.value.items() if vecs is not None else ():
                mine = np.flatnonzero(labels == k)
                if len(mine):
                    i, j = np.nonzero(at @ _unit(vecs[mine]).T >= threshold)
                    out.append(np.stack([q[i], ids[mine[j]]], 1))
            pairs = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["q", "v"])

    true = rows.mapInArrow(run, "q long, v long").where("q <> v").select(F.least("q", "v").alias("a"), F.greatest("q", "v").alias("b")).distinct()
    all_, hit = true.join(links.withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(F.count(F.lit(1)), F.coalesce(F.sum("hit"), F.lit(0))).first()
    return hit / all_ if all_ else 1.0
