"""Item recommendation (R1-R16): temporal split, popularity, category-based
content scoring, truncated-SVD collaborative filtering with exact inner-product
search, reciprocal rank fusion, ranking metrics and serving tables.

Ranked lists are long tables ``(visitor_id, rank, item_id)`` with rank 1..k;
arrays appear only at the serving sink. Every per-visitor structure is bounded
by k, by the 200 popular items or by the 50-candidate pool.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.numeric import RANDOM_SEED
from shelfwise.functions.positions import dense_position, exact_quantile
from shelfwise.session import materialize, written

# Fixed values from the reference.
TEST_FRACTION = 0.2
TOP_K = 10
POPULAR_POOL = 200
CATEGORY_TOP_N = 50
UNINTERACTED_ITEM_WEIGHT = 0.01
N_COMPONENTS = 50
CANDIDATE_POOL = 50
RRF_K = 60

V, I = "visitor_id", "item_id"


# ---------------------------------------------------------------- R1 split
def split_cutoff_us(interactions: DataFrame, test_fraction: float = TEST_FRACTION) -> Column:
    """Scalar: interpolated (1 - f) quantile of event time, in microseconds."""
    us = interactions.select(F.unix_micros(F.col("event_time").cast("timestamp")).alias("_us"))
    return exact_quantile(us, "_us", 1 - test_fraction, out="_cut").select("_cut").scalar()


def temporal_split(interactions: DataFrame, test_fraction: float = TEST_FRACTION) -> DataFrame:
    """One global cutoff; ``is_test`` = event_time >= cutoff (train is
    strictly before)."""
    cut = split_cutoff_us(interactions, test_fraction)
    return interactions.withColumn("is_test", F.unix_micros(F.col("event_time").cast("timestamp")) >= cut)


def train_test(interactions: DataFrame, test_fraction: float = TEST_FRACTION) -> tuple[DataFrame, DataFrame]:
    marked = temporal_split(interactions, test_fraction)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where(F.col("is_test")).drop("is_test")


# ---------------------------------------------------------------- R2 / R3
def most_popular(train: DataFrame, top_k: int = POPULAR_POOL) -> DataFrame:
    """R2: items by summed weight, top ``top_k`` (ties by item id) with rank."""
    scores = train.groupBy(I).agg(F.sum("weight").alias("score"))
    top = scores.orderBy(F.desc("score"), I).limit(top_k)
    # at most top_k rows: a global window over them is bounded
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), I)))


def _popular_array(popular: DataFrame) -> Column:
    """Scalar ARRAY<item_id> of the (bounded) popular list in rank order."""
    return popular.select(F.transform(F.sort_array(F.collect_list(F.struct("rank", I))),
                                      lambda s: s[I])).scalar()


def recommend_popular(visitors: DataFrame, train: DataFrame, popular: DataFrame, k: int = TOP_K) -> DataFrame:
    """The first k popular items the visitor has not seen in train.

    Only seen ∩ popular matters (<= 200 items per visitor), found by an equi
    join against the bounded popular list; the filtering happens in the row."""
    pool = _popular_array(popular)
    seen = (train.select(V, I).join(F.broadcast(popular.select(I)), I).distinct()
            .groupBy(V).agg(F.collect_list(I).alias("_seen")))
    recs = (visitors.select(V).distinct().join(seen, V, "left")
            .withColumn("_pool", pool)  # subqueries may not sit inside a lambda
            .select(V, F.slice(F.filter("_pool", lambda x: ~F.array_contains(
                F.coalesce(F.col("_seen"), F.array().cast("array<string>")), x)), 1, k).alias("_items")))
    return recs.select(V, F.posexplode("_items").alias("_pos", I)).select(
        V, (F.col("_pos") + 1).alias("rank"), I)


# ---------------------------------------------------------------- R4-R7
def category_item_popularity(train: DataFrame, item_categories: DataFrame) -> DataFrame:
    """Every catalogued item with its summed train weight (0.01 if never
    interacted)."""
    w = train.groupBy(I).agg(F.sum("weight").alias("_w"))
    return (item_categories.join(w, I, "left")
            .select(I, "category_id", F.coalesce("_w", F.lit(UNINTERACTED_ITEM_WEIGHT)).alias("weight")))


def top_items_per_category(popularity: DataFrame, n: int = CATEGORY_TOP_N) -> DataFrame:
    """Top n items of each category (ties by item id). Spark plans this as
    a WindowGroupLimit, so each task keeps only n rows per category before the
    shuffle."""
    w = Window.partitionBy("category_id").orderBy(F.desc("weight"), I)
    return popularity.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def visitor_category_affinity(train: DataFrame, item_categories: DataFrame) -> DataFrame:
    """Summed weight per visitor and category of the items interacted with."""
    return (train.select(V, I, "weight").join(item_categories, I)
            .groupBy(V, "category_id").agg(F.sum("weight").alias("affinity")))


def recommend_content(train: DataFrame, item_categories: DataFrame, visitors: DataFrame | None = None,
                      k: int = TOP_K, top_n: int = CATEGORY_TOP_N) -> DataFrame:
    """score(item) = sum over the visitor's categories of affinity x item
    weight, over the category top lists, unseen items only, top k (ties by
    item id). Fan-out per (visitor, category) is bounded by ``top_n``."""
    aff = visitor_category_affinity(train, item_categories)
    if visitors is not None:
        aff = aff.join(visitors.select(V).distinct(), V, "left_semi")
    tops = top_items_per_category(category_item_popularity(train, item_categories), top_n)
    contrib = (aff.join(tops.select("category_id", I, "weight"), "category_id")
               .select(V, I, (F.col("affinity") * F.col("weight")).alias("_s")))
    unseen = contrib.join(train.select(V, I).distinct(), [V, I], "left_anti")
    scored = unseen.groupBy(V, I).agg(F.sum("_s").alias("score"))
    return top_k_per_visitor(scored, "score", k)


def top_k_per_visitor(scored: DataFrame, score: str, k: int) -> DataFrame:
    """Rank 1..k per visitor by score desc then item id (WindowGroupLimit)."""
    w = Window.partitionBy(V).orderBy(F.desc(score), I)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---------------------------------------------------------------- R8-R11
def interaction_matrix(train: DataFrame) -> DataFrame:
    """Summed weight per (visitor, item) with dense 0-based codes in
    sorted id order (U2 on the distinct ids)."""
    cells = train.groupBy(V, I).agg(F.sum("weight").alias("weight"))
    vix = dense_position(train.select(V).distinct(), [V], out="visitor_ix")
    iix = dense_position(train.select(I).distinct(), [I], out="item_ix")
    return cells.join(vix, V).join(iix, I).select(V, I, "visitor_ix", "item_ix", "weight")


# Directions followed beyond the asked ones, so that these settle quickly.
OVERSAMPLE = 10


#: Cells that a block of visitors holds, about. A block is one unit of work: its cells and the vectors of their items.
BLOCK_CELLS = 200_000


def _visitor_blocks(cells: DataFrame, n_cells: int) -> tuple[DataFrame, DataFrame]:
    """The cells as (block, visitors, items, weights), one row per block of whole visitors, dealt by hash; and the items that
    each block has, (block, item_ix). Both are written once and read by every product."""
    import numpy as np
    spark = cells.sparkSession
    n = max(-(-n_cells // BLOCK_CELLS), min(spark.sparkContext.defaultParallelism, -(-n_cells // 1000)))

    def pack(table):
        import pyarrow as pa
        v, i, w = (table.column(c).to_numpy() for c in ("visitor_ix", "item_ix", "weight"))
        order = np.lexsort((i, v))
        return pa.table({"block": table.column("block")[:1], "visitors": pa.array([v[order].tobytes()], pa.binary()),
                         "items": pa.array([i[order].tobytes()], pa.binary()),
                         "weights": pa.array([w[order].tobytes()], pa.binary())})

    dealt = cells.withColumn("block", F.pmod(F.xxhash64("visitor_ix"), F.lit(n)).cast("long"))
    packed = dealt.groupBy("block").applyInArrow(pack, "block long, visitors binary, items binary, weights binary")
    return written(packed, "visitor-blocks"), written(dealt.select("block", "item_ix").distinct(), "block-items")


def _sums(at, weights, along, vectors):
    """(keys, sums): for each value of ``at``, which ascends, the sum of weights x vectors[along]; a bounded number of cells at
    a time."""
    import numpy as np
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    sums = np.zeros((len(starts), vectors.shape[1]))
    for lo in range(0, len(at), 16384):
        hi = min(lo + 16384, len(at))
        first = np.searchsorted(starts, lo, side="right") - 1  # the key that the piece begins in
        last = np.searchsorted(starts, hi, side="left")
        cuts = np.maximum(starts[first:last], lo) - lo
        sums[first:last] += np.add.reduceat(vectors[along[lo:hi]] * weights[lo:hi, None], cuts, axis=0)
    return at[starts], sums


def _times_cells(blocks: tuple[DataFrame, DataFrame], vectors: DataFrame, width: int, back: bool) -> DataFrame:
    """The sparse matrix A times ``vectors`` (ix, vec), which have a row per item: one row (ix, vec) per visitor, or with
    ``back`` one per item of A'A times the vectors.

    Every block gets the vectors of its items by a join. A block has all cells of its visitors, so their rows of the product
    are whole there and need not leave the task on the way back; sums by item are combined before the last shuffle."""
    import numpy as np
    packed, wanted = blocks

    def product(left, right):
        import pyarrow as pa
        empty = pa.table({"ix": pa.array([], pa.int64()), "vec": pa.array([], pa.list_(pa.float64()))})
        if not left.num_rows or not right.num_rows:
            return empty
        v, i, w = (np.frombuffer(left.column(c)[0].as_py(), t) for c, t in
                   (("visitors", np.int64), ("items", np.int64), ("weights", np.float64)))
        ids = right.column("item_ix").to_numpy()
        vecs = right.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        order = np.argsort(ids)
        keys, sums = _sums(v, w, order[np.searchsorted(ids, i, sorter=order)], vecs)
        if back:
            by_item = np.argsort(i, kind="stable")
            keys, sums = _sums(i[by_item], w[by_item], np.searchsorted(keys, v)[by_item], sums)
        offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * width, pa.int32())
        return pa.table({"ix": pa.array(keys), "vec": pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))})

    near = wanted.join(vectors.select(F.col("ix").alias("item_ix"), "vec"), "item_ix")
    out = packed.groupBy("block").cogroup(near.groupBy("block")).applyInArrow(product, "ix long, vec array<double>")
    if not back:
        return out
    sums = out.groupBy("ix").agg(*[F.sum(F.col("vec")[k]).alias(f"c{k}") for k in range(width)])
    return sums.select("ix", F.array(*[F.col(f"c{k}") for k in range(width)]).alias("vec"))


def _gram(vectors: DataFrame, width: int, left: int | None = None):
    """The inner products of the first ``left`` columns (all, if None) with all ``width``; the one thing that comes to the
    driver, and its size does not depend on the data."""
    import numpy as np
    left = width if left is None else left

    def part(batches):
        import pyarrow as pa
        total, rows = np.zeros((left, width)), 0
        for b in batches:
            x = np.asarray(b.column("vec").flatten(), dtype=np.float64).reshape(-1, width)
            total += x[:, :left].T @ x
            rows += b.num_rows
        if not rows:  # a partition without rows adds nothing
            return
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(left * width)), pa.array(total.ravel())], names=["at", "v"])

    out = np.zeros(left * width)
    for r in vectors.select("vec").mapInArrow(part, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(left, width)


def _rotated(vectors: DataFrame, matrix) -> DataFrame:
    """Every vector times a small matrix."""
    import numpy as np

    def run(batches):
        import pyarrow as pa
        for b in batches:
            x = np.asarray(b.column("vec").flatten(), dtype=np.float64).reshape(-1, matrix.shape[0]) @ matrix
            yield pa.RecordBatch.from_arrays([b.column("ix"), pa.array(list(x), pa.list_(pa.float64()))], names=["ix", "vec"])

    return vectors.mapInArrow(run, "ix long, vec array<double>")


def _columns(vectors: DataFrame, first: int, n: int) -> DataFrame:
    """``n`` columns of the vectors from column ``first``."""
    return vectors.select("ix", F.slice("vec", first + 1, n).alias("vec"))


def _independent(gram):
    """Coefficients of orthonormal directions that span the same space as columns with this Gram matrix; directions that are
    there by rounding only are left out."""
    import numpy as np
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    values, q = np.linalg.eigh(gram / np.outer(scale, scale))
    keep = values > 1e-12 * max(values.max(), 1e-300)
    return (q[:, keep] / np.sqrt(values[keep])) / scale[:, None]


def truncated_svd(matrix: DataFrame, n_components: int = N_COMPONENTS, tolerance: float = 1e-6, max_rounds: int = 60):
    """Rank r = min(n, min(shape) - 1) truncated SVD of the sparse matrix A.

    Returns (visitor_factors, item_factors) DataFrames with ``(visitor_ix, vec)`` = rows of U·Σ and
    ``(item_ix, vec)`` = rows of V; the largest entry of each column of V is positive, so the signs are fixed.

    Locally optimal block iteration on A'A: a round looks for the best r + OVERSAMPLE directions in the span of the
    directions so far, their residuals s (A'u - sv) and the last step, by Rayleigh and Ritz on two small Gram matrices. It ends
    when every triple's residual |A'u - sv| is at most ``tolerance`` times the largest singular value, which bounds the error
    of each value; a triple that is that good already is locked and asks for no new direction. A matrix that does not get
    there in ``max_rounds`` raises an error.

    The iteration holds one row per item, the directions and beside them A'A times each; only new directions are multiplied,
    the others turn along, and the end is checked on a product made anew. Visitors get vectors once, at the end. The driver
    sees Gram matrices of three times the block's width only. Each round is written to the shared folder as Parquet: a
    checkpoint would hand on the planner's estimate of its size, a product over all joins before, whose digits double with
    every round.
    """
    import numpy as np

    cells = written(matrix.select("visitor_ix", "item_ix", F.col("weight").cast("double").alias("weight")), "cells")
    shape = cells.agg((F.max("visitor_ix") + 1).alias("m"), (F.max("item_ix") + 1).alias("n"), F.count(F.lit(1)).alias("c")).first()
    if not shape["m"] or min(shape["m"], shape["n"]) < 2:
        raise ValueError("interaction matrix too small for a factorisation")
    r = min(n_components, min(shape["m"], shape["n"]) - 1)
    width = min(r + OVERSAMPLE, min(shape["m"], shape["n"]))
    blocks = _visitor_blocks(cells, shape["c"])

    def with_images(vectors, had, new):
        """Rows (ix, the ``had`` directions, their images, ``new`` directions) as (ix, all directions, all images)."""
        fresh = _columns(vectors, 2 * had, new)
        images = _times_cells(blocks, fresh, new, back=True).withColumnRenamed("vec", "_image")
        vec = F.concat(F.slice("vec", 1, had), F.slice("vec", 2 * had + 1, new), F.slice("vec", had + 1, had), "_image")
        return written(vectors.join(images, "ix").select("ix", vec.alias("vec")), "svd-round")

    start = F.array(*[F.xxhash64(F.col("item_ix"), F.lit(i)) / F.lit(2.0 ** 63) for i in range(width)])
    items = with_images(written(cells.select("item_ix").distinct().select(F.col("item_ix").alias("ix"), start.alias("vec")),
                                "svd-start"), 0, width)
    kept = had = width  # columns of the table of items: the directions first, then the last step, then residuals
    for _ in range(max_rounds):
        gram = _gram(items, 2 * had, had)
        basis = _independent(gram[:, :had])
        small = basis.T @ gram[:, had:] @ basis
        values, q = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(-values)[:width]
        values, z = np.maximum(values[top], 0), basis @ q[:, top]
        sigma = np.sqrt(values)
        step = z.copy()
        step[:kept] = 0  # the part that the old directions had not
        moves = np.linalg.norm(step, axis=0) > 0
        turn = np.hstack([z, step[:, moves]])
        kept, had = z.shape[1], turn.shape[1]
        # residuals of the normal equations, A'(Av) - s^2 v = s (A'u - sv)
        none = np.zeros_like(turn)
        items = written(_rotated(items, np.block([[turn, none, -z * values], [none, turn, z]])), "svd-turned")
        residual = _columns(items, 2 * had, kept)

        def norms_of(residual):
            norms = np.sqrt(np.maximum(np.diag(_gram(residual, kept)), 0)) / np.maximum(sigma, 1e-300)
            norms[sigma <= 1e-12 * sigma[0]] = 0.0  # no triple: the matrix has a lower rank
            return norms

        norms = norms_of(residual)
        if (norms[:r] <= tolerance * sigma[0]).all():
            # images turned along carry rounding errors: the answer rests on a product made anew
            items = with_images(written(_columns(items, 0, kept), "svd-last"), 0, kept)
            norms = norms_of(_rotated(items, np.vstack([-np.diag(values), np.eye(kept)])))
            if (norms[:r] <= tolerance * sigma[0]).all():
                break
            had = kept
            items = written(_rotated(items, np.block([[np.eye(kept), np.zeros((kept, kept)), -np.diag(values)],
                                                      [np.zeros((kept, kept)), np.eye(kept), np.eye(kept)]])), "svd-turned")
        open_ = np.flatnonzero(norms > 0.1 * tolerance * sigma[0])
        asked = F.transform(F.array(*[F.lit(int(k) + 2 * had) for k in open_]), lambda k: F.col("vec")[k])
        items = with_images(items.select("ix", F.concat(F.slice("vec", 1, 2 * had), asked).alias("vec")), had, len(open_))
        had += len(open_)
    else:
        raise RuntimeError(f"singular vectors not found to {tolerance} in {max_rounds} rounds, at {norms[:r].max() / sigma[0]:.1e}")
    v = written(_columns(items, 0, r), "svd-items")
    peaks = v.agg(*[F.max(F.struct(F.abs(F.col("vec")[i]).alias("a"), F.col("vec")[i].alias("x"))).alias(f"p{i}")
                    for i in range(r)]).first()
    sign = np.array([-1.0 if peaks[f"p{i}"]["x"] < 0 else 1.0 for i in range(r)])
    v = written(_rotated(v, np.diag(sign)), "svd-items")
    u = written(_times_cells(blocks, v, r, back=False), "svd-visitors")
    return u.withColumnRenamed("ix", "visitor_ix"), v.withColumnRenamed("ix", "item_ix")


def _norm_blocks(rows: DataFrame, block_rows: int, name: str) -> DataFrame:
    """One row per block of about ``block_rows`` vectors: <name> (the block's number), <name>_top (its greatest norm),
    <name>_ids, <name>_vecs. Blocks hold vectors of like norms, in order: block 0 has the longest. Rows are dealt by
    position, so that equal norms are no matter."""
    import numpy as np
    import pandas as pd

    def pack(pdf):
        pdf = pdf.sort_values("_id")
        vecs = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf["_vec"]])
        return pd.DataFrame({name: [pdf["_block"].iloc[0]], f"{name}_top": [pdf["_norm"].max()],
                             f"{name}_ids": [pdf["_id"].to_numpy(np.int64).tobytes()], f"{name}_vecs": [vecs.tobytes()]})

    norm = F.sqrt(F.aggregate("_vec", F.lit(0.0), lambda a, x: a + x * x))
    placed = dense_position(rows.withColumn("_norm", norm), [F.desc("_norm"), F.col("_id")], out="_position")
    dealt = placed.withColumn("_block", F.floor(F.col("_position") / F.lit(block_rows)))
    packed = dealt.groupBy("_block").applyInPandas(
        pack, f"{name} long, {name}_top double, {name}_ids binary, {name}_vecs binary")
    return materialize(packed)


def _best(scores, ids, k: int):
    """(ids, scores) of the k best of each row of ``scores``, best first, equal ones by the smaller id; ``ids`` ascend. Columns
    below the k-th score are put aside by a partition, so that only those that may be among the best are sorted."""
    import numpy as np
    n, m = scores.shape
    if m > k:
        kth = np.partition(scores, m - k, axis=1)[:, m - k]
        most = int((scores >= kth[:, None]).sum(1).max())  # more than k where the k-th score is shared
        at = np.argpartition(-scores, most - 1, axis=1)[:, :most] if most < m else np.tile(np.arange(m), (n, 1))
        at.sort(axis=1)
        scores = np.take_along_axis(scores, at, axis=1)
    else:
        at = np.tile(np.arange(m), (n, 1))
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return ids[np.take_along_axis(at, order, axis=1)], np.take_along_axis(scores, order, axis=1)


def _merged(one, two, k: int):
    """The k best of two lists of (ids, scores) per row, in the order of :func:`_best`."""
    import numpy as np
    if one is None:
        return two
    ids, scores = (np.concatenate(x, axis=1) for x in zip(one, two, strict=True))
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def _pair_scores(part: dict):
    """(query ids, item ids, query vectors, item vectors) of one pair of blocks."""
    import numpy as np
    ids, asked = (np.frombuffer(part[f"{c}_ids"], np.int64) for c in ("item", "query"))
    x, q = (np.frombuffer(part[f"{c}_vecs"], np.float64).reshape(len(i), -1) for c, i in (("item", ids), ("query", asked)))
    return asked, ids, q, x


#: Item blocks that a partition holds, so that a task has that many at most in memory.
ITEM_BLOCKS = 8

#: Room for rounding when a bound is compared with a score.
_BOUND_SLACK = 1 + 1e-9


def exact_top_k_inner_product(queries: DataFrame, items: DataFrame, k: int = CANDIDATE_POOL,
                              qid: str = "visitor_ix", iid: str = "item_ix", vec: str = "vec",
                              block_rows: int = 4096, skipped: list | None = None) -> DataFrame:
    """Exact maximum-inner-product top k of every query vector against
    all item vectors (the brute-force 'flat' search), in float64.

    Queries and items are packed into blocks of ``block_rows`` vectors of like norms. Every query block first meets item
    block 0, the longest vectors; the k-th score that a query has there is the least that another item must reach. No item
    scores above |query| times the greatest norm of its block, so a query block needs only the first so many item blocks.
    These pairs are found from one number per block before any vector moves; a pair is one unit of work of a fixed size, a
    matrix product and a local top k (ties: smaller item id). A query block meets its item blocks one after the other in one
    task, which merges the lists as it goes, so the work is quadratic but what is shuffled is not.
    Output: (qid, rank 1..k, iid, score). ``skipped``: gets (pairs of blocks, pairs not looked at).
    """
    import numpy as np

    def prepared(df, key):
        return df.select(F.col(key).cast("long").alias("_id"), F.col(vec).cast("array<double>").alias("_vec"))

    item_blocks = _norm_blocks(prepared(items, iid), block_rows, "item")
    query_blocks = _norm_blocks(prepared(queries, qid), block_rows, "query")

    def pilot(batches):
        import pyarrow as pa
        for batch in batches:
            for row in range(batch.num_rows):
                part = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                asked, ids, q, x = _pair_scores(part)
                need = np.inf
                for at in range(0, len(asked), 256):
                    scores, norms = q[at:at + 256] @ x.T, np.sqrt((q[at:at + 256] ** 2).sum(1))
                    if len(ids) < k:
                        need = -np.inf
                    else:
                        kth = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                        with np.errstate(divide="ignore", invalid="ignore"):
                            need = min(need, np.where(norms > 0, kth / norms, -np.inf).min())
                yield pa.RecordBatch.from_arrays([pa.array([part["query"]]), pa.array([need])], names=["query", "need"])

    longest = F.broadcast(item_blocks.where("item = 0").drop("item_top"))  # one block
    first = query_blocks.drop("query_top").withColumn("item", F.lit(0).cast("long")).join(longest, "item")
    needs = materialize(first.mapInArrow(pilot, "query long, need double"))
    # one number per item block, 8 bytes for block_rows vectors, stands beside each query block's need
    tops = item_blocks.agg(F.collect_list("item_top").alias("tops")).withColumn("item", F.lit(0))
    needs_tops = needs.withColumn("item", F.lit(0)).join(F.broadcast(tops), "item")
    n_wanted = F.size(F.filter("tops", lambda t: t * F.lit(_BOUND_SLACK) >= F.col("need")))
    wanted = materialize(needs_tops.select("query", n_wanted.cast("long").alias("n")).where("n > 0"))
    if skipped is not None:
        total = needs.count() * item_blocks.count()
        skipped.append((total, total - (wanted.agg(F.sum("n")).first()[0] or 0)))
    # Every query block is a partition, which walks past the item blocks that it needs: they are read from the shared folder by
    # a product of partitions, so no vector is shuffled, and only the k best of each query leave a task.
    asking = query_blocks.drop("query_top").join(F.broadcast(wanted), "query")
    n_blocks = max(1, needs.count())
    laid_out = materialize(asking.repartitionByRange(n_blocks, "query"))
    stock = materialize(item_blocks.drop("item_top").repartitionByRange(max(1, -(-item_blocks.count() // ITEM_BLOCKS)), "item"))
    pairs = (laid_out.hint("shuffle_replicate_nl").join(stock, F.col("item") < F.col("n"))
             .coalesce(laid_out.rdd.getNumPartitions()))

    def search(batches):
        import pyarrow as pa
        best: dict = {}  # by query block; there is one, or a few where a partition has several
        for batch in batches:
            for row in range(batch.num_rows):
                part = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                asked, ids, q, x = _pair_scores(part)
                lists = best.setdefault(part["query"], (asked, [None] * -(-len(asked) // 256)))[1]
                for no, at in enumerate(range(0, len(asked), 256)):
                    lists[no] = _merged(lists[no], _best(q[at:at + 256] @ x.T, ids, k), k)
        for asked, lists in best.values():
            for no, (ids, scores) in enumerate(lists):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(asked[no * 256:no * 256 + 256], ids.shape[1])), pa.array(ids.ravel()),
                     pa.array(scores.ravel())], names=[qid, iid, "score"])

    found = pairs.mapInArrow(search, f"{qid} long, {iid} long, score double")
    w = Window.partitionBy(qid).orderBy(F.desc("score"), iid)
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(qid, F.col("rank").cast("int").alias("rank"), iid, "score"))


def recommend_collaborative(candidates: DataFrame, matrix: DataFrame, train: DataFrame,
                            k: int = TOP_K) -> DataFrame:
    """Map the top-50 candidate codes back to ids, drop items seen in
    train AFTER the cut, re-rank, keep k."""
    vmap = matrix.select(V, "visitor_ix").distinct()
    imap = matrix.select(I, "item_ix").distinct()
    c = (candidates.join(vmap, "visitor_ix").join(imap, "item_ix")
         .select(V, I, F.col("rank").alias("_cand_rank"), "score"))
    unseen = c.join(train.select(V, I).distinct(), [V, I], "left_anti")
    w = Window.partitionBy(V).orderBy("_cand_rank")
    return (unseen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(V, "rank", I, "score"))


# ---------------------------------------------------------------- R12
def reciprocal_rank_fusion(lists: list[DataFrame], k: int = TOP_K, rrf_k: int = RRF_K) -> DataFrame:
    """score(item) = sum 1 / (rrf_k + rank) over the lists (rank 1-based);
    ties keep the first appearance (earlier list, then better rank)."""
    tagged = None
    for no, lst in enumerate(lists):
        t = lst.select(V, I, "rank", F.lit(no).alias("_list"))
        tagged = t if tagged is None else tagged.unionByName(t)
    fused = tagged.groupBy(V, I).agg(
        F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("rrf_score"),
        F.min(F.struct("_list", "rank")).alias("_first"))
    w = Window.partitionBy(V).orderBy(F.desc("rrf_score"), F.col("_first"))
    return (fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(V, "rank", I, "rrf_score"))


# ---------------------------------------------------------------- R13 / R14
def evaluation_visitors(train: DataFrame, test: DataFrame, max_visitors: int | None = None,
                        seed: int = RANDOM_SEED) -> DataFrame:
    """Visitors present in train AND test (INTERSECT). The reference
    evaluates a seeded sample of 5000; by default everyone is evaluated here,
    ``max_visitors`` restores the sample (seeded hash order)."""
    both = train.select(V).intersect(test.select(V))
    if max_visitors is None:
        return both
    return (both.withColumn("_h", F.md5(F.concat_ws("#", V, F.lit(str(seed)))))
            .orderBy("_h", V).limit(max_visitors).drop("_h"))


def ranking_metrics(recs: DataFrame, test: DataFrame, visitors: DataFrame, k: int = TOP_K) -> DataFrame:
    """Mean precision@k (hits / k), recall@k (hits / |relevant|) and
    MAP@k (AP divided by min(|relevant|, k)) over ``visitors``; a visitor
    without recommendations scores 0. Relevant = all test items of the
    visitor."""
    rel = test.select(V, I).distinct()
    n_rel = rel.groupBy(V).agg(F.count(F.lit(1)).alias("_nrel"))
    r = recs.where(F.col("rank") <= k).select(V, "rank", I)
    hit = r.join(rel.withColumn("_hit", F.lit(1)), [V, I], "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    w = Window.partitionBy(V).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("_cum", F.sum("_hit").over(w))
    per = hit.groupBy(V).agg(F.sum("_hit").alias("_h"),
                             F.sum(F.when(F.col("_hit") == 1, F.col("_cum") / F.col("rank"))).alias("_apn"))
    ev = visitors.select(V).distinct().join(n_rel, V, "left").join(per, V, "left")
    h = F.coalesce(F.col("_h"), F.lit(0))
    p = h / F.lit(k)
    rc = F.when(F.col("_nrel") > 0, h / F.col("_nrel")).otherwise(F.lit(0.0))
    ap = F.when(F.col("_nrel") > 0, F.coalesce(F.col("_apn"), F.lit(0.0)) / F.least(F.col("_nrel"), F.lit(k))) \
          .otherwise(F.lit(0.0))
    return ev.agg(F.avg(p).alias(f"precision_at_{k}"), F.avg(rc).alias(f"recall_at_{k}"),
                  F.avg(ap).alias(f"map_at_{k}"), F.count(F.lit(1)).alias("n_visitors_evaluated"))


# ---------------------------------------------------------------- R15 / R16
def visitor_lookup(recs: DataFrame) -> DataFrame:
    """Visitor -> ordered item list (non-empty lists only; bounded by k)."""
    return recs.groupBy(V).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", I))),
                                           lambda s: s[I]).alias("recommended_items"))


# Serving reasons.
REASON_MODEL = "hybrid recommendation (content-based + collaborative filtering)"
REASON_FALLBACK = "unknown visitor: most-popular fallback"


def serve_recommendations(requests: DataFrame, lookup: DataFrame, popular: DataFrame, k: int = TOP_K) -> DataFrame:
    """Known visitor -> its list; unknown -> popular top k (no seen
    filter); long form with 1-based rank, fallback flag and reason."""
    pool = F.slice(_popular_array(popular), 1, k)
    df = requests.select(V).distinct().join(lookup, V, "left")
    known = F.col("recommended_items").isNotNull()
    items = F.when(known, F.slice("recommended_items", 1, k)).otherwise(pool)
    out = df.select(V, (~known).alias("is_cold_start_fallback"),
                    F.when(known, F.lit(REASON_MODEL)).otherwise(F.lit(REASON_FALLBACK)).alias("reason"),
                    F.posexplode(items).alias("_pos", I))
    return out.select(V, "is_cold_start_fallback", (F.col("_pos") + 1).alias("score_rank"), I, "reason")
