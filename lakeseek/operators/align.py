"""Column alignment: which column of a table each query entity belongs to."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_similarities(query: DataFrame, linked: DataFrame, similarity) -> DataFrame:
    """(q, uri, sim) of each distinct query entity and each distinct linked entity.

    similarity(pairs) gets (q, uri) and adds sim. The query's side is a stated query, small against the corpus, and pairs are made once for each
    distinct corpus entity, not for each cell.
    """
    q = query.select(F.col("uri").alias("q")).distinct()
    return similarity(linked.select("uri").distinct().join(F.broadcast(q)))


#: Query entities whose similarities stand in one row, side by side.
LANES = 16


def column_scores(query: DataFrame, linked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(table_id, tuple_id, pos, col_id, score): sum of similarities of a query entity and a column's cells; pairs has each query entity with each linked one.

    A cell is a row for each LANES query entities, and cells are summed before they are shuffled. The query's entities, a stated query, are broadcast.
    """
    place = F.row_number().over(Window.orderBy("q")) - 1
    lanes = query.select(F.col("uri").alias("q")).distinct().select("q", F.floor(place / LANES).alias("block"), (place % LANES).alias("lane"))
    each = [F.max(F.when(F.col("lane") == i, F.col("sim"))).alias(f"s{i}") for i in range(LANES)]
    wide = pairs.join(F.broadcast(lanes), "q").groupBy("uri", "block").agg(*each)
    sums = linked.join(wide, "uri").groupBy("table_id", "col_id", "block").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(LANES)))
    long = sums.select("table_id", "col_id", "block", F.inline(F.array(*(F.struct(F.lit(i).alias("lane"), F.col(f"s{i}").alias("score")) for i in range(LANES)))))
    asked = query.select("tuple_id", "pos", F.col("uri").alias("q")).join(F.broadcast(lanes), "q")
    return long.join(F.broadcast(asked), ["block", "lane"]).select("table_id", "tuple_id", "pos", "col_id", "score")


def _best_sums(scores: np.ndarray) -> np.ndarray:
    """Largest sum of each matrix [matrix, row, column], from potentials: row by row, a cheapest path to a free column. All matrices take a step together."""
    n, rows, cols = scores.shape
    u, v, owner = np.zeros((n, rows + 1)), np.zeros((n, cols + 1)), np.zeros((n, cols + 1), np.int64)
    for r in range(1, rows + 1):
        owner[:, 0], at = r, np.zeros(n, np.int64)
        reach, way, used = np.full((n, cols + 1), np.inf), np.zeros((n, cols + 1), np.int64), np.zeros((n, cols + 1), bool)
        live = np.arange(n)
        while len(live):
            now = at[live]
            used[live, now] = True
            row = owner[live, now]
            d = -scores[live, row - 1] - u[live, row][:, None] - v[live, 1:]
            taken, far, back = used[live], reach[live], way[live]
            near = ~taken[:, 1:] & (d < far[:, 1:])
            far[:, 1:], back[:, 1:] = np.where(near, d, far[:, 1:]), np.where(near, now[:, None], back[:, 1:])
            free = np.where(taken[:, 1:], np.inf, far[:, 1:])
            nxt = free.argmin(1) + 1
            low = free[np.arange(len(live)), nxt - 1]
            i, j = np.nonzero(taken)
            u[live[i], owner[live[i], j]] += low[i]
            v[live[i], j] -= low[i]
            reach[live], way[live], at[live] = np.where(taken, far, far - low[:, None]), back, nxt
            live = live[owner[live, nxt] > 0]
        live = np.arange(n)
        while len(live):
            now = at[live]
            prior = way[live, now]
            owner[live, now], at[live] = owner[live, prior], prior
            live = live[prior > 0]
    held = owner[:, 1:]
    of = np.take_along_axis(scores, np.maximum(held - 1, 0)[:, None, :], 1)[:, 0] if rows else np.zeros(held.shape)
    return np.where(held > 0, of, 0.0).sum(1)


def best_assignments(scores: np.ndarray) -> np.ndarray:
    """Of each matrix [matrix, row, column] the columns of an assignment of rows to distinct columns with the largest sum, by shortest augmenting paths; -1 for all if rows outnumber columns.

    Of assignments with equal sums the lexicographically smallest is taken: rows are fixed one by one to their smallest column that keeps the best sum.
    """
    n, rows, width = scores.shape
    out = np.full((n, rows), -1, np.int64)
    if rows > width or not n:
        return out
    cols, total = np.tile(np.arange(width), (n, 1)), _best_sums(scores)
    for i in range(rows):
        left, kept, sums = np.arange(n), cols[:, :-1].copy(), total.copy()
        for x in range(cols.shape[1]):
            if not len(left):
                break
            c, rest = cols[left, x], np.delete(cols[left], x, 1)
            sub = _best_sums(np.take_along_axis(scores[left, i + 1 :], rest[:, None, :], 2))
            fits = np.abs(scores[left, i, c] + sub - total[left]) <= 1e-9 * np.maximum(1.0, np.abs(total[left]))
            at = left[fits]
            out[at, i], kept[at], sums[at] = c[fits], rest[fits], sub[fits]
            left = left[~fits]
        cols, total = kept, sums
    return out


def best_assignment(scores: list[list[float]]) -> list[int]:
    """The same of one matrix."""
    return best_assignments(np.array([scores], float))[0].tolist() if scores else []


#: Tuples and tables up to this width are assigned by enumeration.
NARROW = 3


def assignments(scores: np.ndarray) -> np.ndarray:
    """The same, but that of NARROW rows and columns at most all assignments are summed, and sums equal to nine places tie."""
    n, rows, width = scores.shape
    if rows > min(width, NARROW) or width > NARROW or not n:
        return best_assignments(scores)
    options = list(itertools.permutations(range(width), rows))
    total = np.stack([sum(scores[:, p, c] for p, c in enumerate(o)) for o in options], 1)
    return np.array(options, np.int64)[np.round(total, 9).argmax(1)]


def _with_width(scores: DataFrame, query: DataFrame) -> DataFrame:
    return scores.join(F.broadcast(query.groupBy("tuple_id").agg((F.max("pos") + 1).alias("w"))), "tuple_id")  # a row for each of the query's tuples


def _solved(batches):
    """(table_id, tuple_id, w, n_cols, cells) -> (table_id, tuple_id, pos, col_id): a batch's matrices of one shape are solved together."""
    for batch in batches:
        table, tup, w, n, cells = batch.columns
        w, n, of = w.to_numpy().astype(np.int64), n.to_numpy().astype(np.int64), np.repeat(np.arange(batch.num_rows), np.diff(cells.offsets.to_numpy()))
        pos, col, score = cells.flatten().flatten()
        pos, col, score = pos.to_numpy(), col.to_numpy(), pc.fill_null(score, 0.0).to_numpy()
        for width, n_cols in sorted(set(zip(w.tolist(), n.tolist(), strict=True))):
            at = np.flatnonzero((w == width) & (n == n_cols))
            place = np.full(batch.num_rows, -1)
            place[at] = np.arange(len(at))
            own = place[of] >= 0
            matrix = np.zeros((len(at), width, n_cols))
            matrix[place[of[own]], pos[own], col[own]] = score[own]
            each = pa.array(np.repeat(at, width))
            yield pa.RecordBatch.from_arrays([table.take(each), tup.take(each), pa.array(np.tile(np.arange(width), len(at))), pa.array(best_assignments(matrix).ravel())], names=["table_id", "tuple_id", "pos", "col_id"])


def _wide(held: DataFrame) -> DataFrame:
    kind = dict(held.dtypes)
    cell = F.struct(F.col("pos").cast("long").alias("pos"), F.col("col_id").cast("long").alias("col_id"), F.col("score").cast("double").alias("score"))
    rows = held.groupBy("table_id", "tuple_id").agg(F.first("w").cast("long").alias("w"), F.first("n_cols").cast("long").alias("n_cols"), F.collect_list(cell).alias("cells"))
    return rows.mapInArrow(_solved, f"table_id {kind['table_id']}, tuple_id {kind['tuple_id']}, pos long, col_id long")


def _narrow(held: DataFrame) -> DataFrame:
    cell = F.struct((F.col("pos") * NARROW + F.col("col_id")).cast("long").alias("k"), F.col("score"))
    held = held.groupBy("table_id", "tuple_id", "n_cols", "w").agg(F.map_from_entries(F.collect_list(cell)).alias("s"))
    options = [o for w in range(1, NARROW + 1) for o in itertools.permutations(range(NARROW), w)]
    total = lambda o: sum((F.coalesce(F.col("s")[F.lit(p * NARROW + c).cast("long")], F.lit(0.0)) for p, c in enumerate(o)), F.lit(0.0))
    entry = lambda o: F.when(F.col("n_cols") > max(o), F.struct((-F.round(total(o), 9)).alias("by"), F.array(*(F.lit(c).cast("long") for c in o)).alias("cols")))
    chosen = F.lit(None)
    for w in range(1, NARROW + 1):
        chosen = F.when(F.col("w") == w, F.array_min(F.array(*(entry(o) for o in options if len(o) == w)))["cols"]).otherwise(chosen)
    none = F.transform(F.sequence(F.lit(1), F.col("w")), lambda x: F.lit(-1).cast("long"))
    return held.select("table_id", "tuple_id", F.posexplode(F.coalesce(chosen, none)).alias("pos", "col_id"))


def assign(scores: DataFrame, query: DataFrame, widths: DataFrame) -> DataFrame:
    """(table_id, tuple_id, pos, col_id): the best assignment of each tuple's entities to distinct columns of each table, -1 where a tuple is wider than the table.

    widths: table_id, n_cols. Tuples and tables of NARROW places at most are enumerated in SQL; the others' score matrices, as small as a table is wide, are solved in Python.
    """
    held = _with_width(scores, query).join(widths, "table_id")
    fits = (F.col("w") <= NARROW) & (F.col("n_cols") <= NARROW)
    return _narrow(held.where(fits)).select("table_id", "tuple_id", F.col("pos").cast("long").alias("pos"), "col_id").unionByName(_wide(held.where(~fits)))


def assign_columns(scores: DataFrame, widths: DataFrame, query: DataFrame) -> DataFrame:
    """The same by score matrices alone, for any width."""
    return _wide(_with_width(scores, query).join(widths, "table_id"))


def assign_narrow(scores: DataFrame, query: DataFrame, n_cols: int) -> DataFrame:
    """The same for tuples and tables of at most three places, all n_cols wide, by enumeration in SQL: no Python. A wider tuple gets -1."""
    if n_cols > NARROW:
        raise ValueError("enumeration is for three columns at most")
    return _narrow(_with_width(scores, query).withColumn("n_cols", F.lit(n_cols)))
