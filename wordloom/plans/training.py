"""Fitting word and context vectors to co-occurrence by weighted least squares with AdaGrad.

For a pair (i, j, x): diff = w_i.c_j + b_i + b_j - ln x, weight f(x) = min(1, (x / x_max) ^ alpha), cost
f diff^2 / 2. Vector gradients are clipped and scaled by eta, bias gradients are neither; steps are
divided by the roots of the accumulated squares before the record.

Parameters are rows (side w or c, id, v, b, g, gb). Three modes: exact takes records one by one in
the shuffled order, on one task, for tests; stratified deals words and contexts to P parts of like weight
and trains the P pairs of parts that share nothing at the same time, so each epoch equals some serial order;
fullbatch sums all gradients, by cells of two parts, and makes one step; as eta doesn't scale bias steps, its first steps
overshoot, so it serves to check the formula rather than to fit vectors.

The records are written once, before the first iteration, for stratified training by the pair of parts
that they belong to; an iteration reads them where they are, and its cost is a row of the costs table.
"""

from __future__ import annotations

from dataclasses import replace
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.config import TrainOptions
from wordloom.operators.cooccur import CorpusPairs, as_table
from wordloom.plans.cells import CELL_RECORDS, COST, EPOCH_BYTES, MOST_TASKS, block_sums, full_batch, heavy_parts, laid, laid_cells, laid_path, part_of, remainder, sub_epoch, sum_parts
from wordloom.plans.checkpoint import Checkpoints

PARAMS = "side string, id int, v array<double>, b double, g array<double>, gb double"
PARAM_COLUMNS = ("side", "id", "v", "b", "g", "gb")


def start_value(id_: Column, dim: Column, side: Column, seed: int, size: int) -> Column:
    """Uniform in (-0.5, 0.5) / size, from whole-number arithmetic that any SQL engine repeats."""
    mixed = id_.cast("long") * 7919 + dim.cast("long") * 104729 + side.cast("long") * 1299709 + F.lit(seed).cast("long") * 15485863
    return ((mixed % 1000003) / F.lit(1000003.0) - 0.5) / F.lit(float(size))


def initial(ids: DataFrame, options: TrainOptions) -> DataFrame:
    """Parameters for each id: dimension 0 is the bias; accumulators are one."""
    d = options.vector_size
    sides = ids.select(F.col("id").cast("int").alias("id"), F.explode(F.array(F.lit("w"), F.lit("c"))).alias("side"))
    at = F.when(F.col("side") == "w", 0).otherwise(1)
    value = lambda dim: start_value(F.col("id"), dim, at, options.seed, d)
    return sides.select(
        "side", "id", F.transform(F.sequence(F.lit(1), F.lit(d)), value).alias("v"), value(F.lit(0)).alias("b"), F.array_repeat(F.lit(1.0), d).alias("g"), F.lit(1.0).alias("gb")
    )


def usable(pairs: DataFrame) -> DataFrame:
    """Pairs of valid ids; others are left out of the updates."""
    return pairs.where("word1 >= 1 and word2 >= 1 and val > 0")


def _records(pairs: DataFrame | CorpusPairs) -> tuple[DataFrame | CorpusPairs, int]:
    """What full_batch() takes, and the number of pairs, of a corpus's pairs about. A count of a table runs while this is called."""
    if isinstance(pairs, CorpusPairs) and pairs.options.symmetric:
        return pairs, pairs.met
    table = as_table(pairs)
    return usable(table), table.count()


def measured(pairs: DataFrame | CorpusPairs, params: DataFrame, options: TrainOptions) -> DataFrame:
    """One row: cost, the mean over all pairs, skipped ones stay in the denominator, and pairs, their number. A count of a table's pairs runs, and the parameters are written, while this is called."""
    records, n = _records(pairs)
    rows = block_sums(records, params, options, n, costs_only=True).where(F.col("side") == COST)
    total = rows.agg(F.sum("fd").alias("s"), F.sum(F.col("t")[0]).cast("long").alias("n"))
    whole = F.col("n") if isinstance(records, CorpusPairs) else F.lit(n).cast("long")
    return total.select(F.coalesce(F.try_divide("s", whole.cast("double")), F.lit(0.0)).alias("cost"), whole.alias("pairs"))


def cost(pairs: DataFrame | CorpusPairs, params: DataFrame, options: TrainOptions) -> DataFrame:
    """One row, the cost of measured()."""
    return measured(pairs, params, options).select("cost")


def fullbatch_step(pairs: DataFrame | CorpusPairs, params: DataFrame, options: TrainOptions) -> DataFrame:
    """Parameters after one step along the summed gradients of all pairs. A count of a table's pairs runs, and the parameters are written, while this is called."""
    records, n = _records(pairs)
    parts = sum_parts(params, options.vector_size, n)
    return full_batch(records, laid_path(params, parts), parts, options, "step").where(F.col("side") != COST).select(*PARAM_COLUMNS)


def run_records(w, c, i, j, x, options: TrainOptions, batch: int) -> float:
    """Updates both sides' arrays (v, b, g, gb) in place, batch records at a time; the cost's sum.

    Repeated rows within a batch all see the values from before it, and their steps add up.
    """
    total, f = 0.0, np.minimum(1.0, (x / options.x_max) ** options.alpha)
    log_x, d, clip = np.log(x), w[0].shape[1], options.grad_clip
    lanes, most = np.arange(d), min(batch, len(i))
    # Vectors and their accumulators entry by entry: numpy adds up by one index several times faster than by rows.
    entries = [(side[0].reshape(-1), side[2].reshape(-1)) for side in (w, c)]
    # Arrays that every batch uses again, as making them takes time too.
    held, places = np.empty((5, most, d)), np.empty((most, d), np.int64)
    for k in range(0, len(i), batch):
        a, b, s = i[k : k + batch], j[k : k + batch], slice(k, k + batch)
        wv, cv = held[0, : len(a)], held[1, : len(a)]
        np.take(w[0], a, axis=0, out=wv, mode="clip")
        np.take(c[0], b, axis=0, out=cv, mode="clip")
        diff = np.einsum("nd,nd->n", wv, cv) + w[1][a] + c[1][b] - log_x[s]
        fd = f[s] * diff
        good = np.isfinite(diff) & np.isfinite(fd)
        if not good.all():
            a, b, wv, cv, diff, fd = (q[good] for q in (a, b, wv, cv, diff, fd))
        total += 0.5 * float(fd @ diff)
        t, root, step = held[2:, : len(a)]
        own = places[: len(a)]
        for side, (v, g), at, other in ((w, entries[0], a, cv), (c, entries[1], b, wv)):
            np.multiply(fd[:, None], other, out=t)
            np.clip(t, -clip, clip, out=t)
            t *= options.eta
            np.take(side[2], at, axis=0, out=root, mode="clip")
            np.divide(t, np.sqrt(root, out=root), out=step)
            bias = fd / np.sqrt(side[3][at])
            finite = np.isfinite(step.sum(axis=1))
            if not finite.all():
                step[~finite] = 0
            np.add(at[:, None] * d, lanes, out=own)
            np.subtract.at(v, own.reshape(-1), step.reshape(-1))
            np.subtract.at(side[1], at, np.where(np.isfinite(bias), bias, 0))
            np.multiply(t, t, out=t)
            np.add.at(g, own.reshape(-1), t.reshape(-1))
            np.add.at(side[3], at, fd * fd)
    return total


def _arrays(p: pd.DataFrame) -> tuple[np.ndarray, list]:
    ids = p["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, p = ids[order], p.iloc[order]
    return ids, [np.array(p["v"].tolist(), float), p["b"].to_numpy(float).copy(), np.array(p["g"].tolist(), float), p["gb"].to_numpy(float).copy()]


def _frame(side: str, ids: np.ndarray, x: list) -> pd.DataFrame:
    return pd.DataFrame({"side": side, "id": ids.astype("int32"), "v": list(x[0]), "b": x[1], "g": list(x[2]), "gb": x[3]})


def _order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "word1", "word2")


def _cost_row(total: float) -> pd.DataFrame:
    """Travels with the parameters, as a side of its own."""
    return pd.DataFrame({"side": [COST], "id": [0], "v": [[]], "b": [total], "g": [[]], "gb": [0.0]})


def _group(both: pd.DataFrame, records: pd.DataFrame, options: TrainOptions, batch: int) -> pd.DataFrame:
    sides = {s: _arrays(both[both["side"] == s]) for s in ("w", "c")}
    r = records.sort_values(["k", "word1", "word2"], kind="stable")
    i, j = (np.searchsorted(sides[s][0], r[k].to_numpy()) for s, k in (("w", "word1"), ("c", "word2")))
    total = run_records(sides["w"][1], sides["c"][1], i, j, r["val"].to_numpy(float), options, batch) if len(r) else 0.0
    return pd.concat([_frame(s, *sides[s]) for s in ("w", "c")] + [_cost_row(total)])


def _split(trained: DataFrame) -> tuple[DataFrame, float]:
    """Parameters, and the sum of the costs that came with them."""
    total = trained.where(F.col("side") == COST).agg(F.sum("b")).first()[0]
    return trained.where(F.col("side") != COST), total or 0.0


def exact_epoch(pairs: DataFrame, params: DataFrame, options: TrainOptions) -> DataFrame:
    """All records one after another in the shuffled order, on one task: for small tables and tests. The cost comes as a row of its own side."""
    p, r = params.withColumn("one", F.lit(1)), usable(pairs).select("word1", "word2", "val", _order(options.seed).alias("k"), F.lit(1).alias("one"))
    return p.groupBy("one").cogroup(r.groupBy("one")).applyInPandas(lambda a, b: _group(a, b, options, 1), PARAMS)


def _parts(n: int, params: DataFrame, options: TrainOptions) -> int:
    """Parts of stratified training: options.blocks is the least; more for larger tables, up to the cores, as an epoch writes all parameters once a part, or as a part's parameters need them."""
    cores = params.sparkSession.sparkContext.defaultParallelism
    size = params.count() * (2 * options.vector_size + 3) * 8 / 2
    return max(options.blocks or 2, min(ceil(sqrt(n / CELL_RECORDS)), max(8, cores)), ceil(size / EPOCH_BYTES))


def _stratified_tables(whole: DataFrame, n: int, params: DataFrame, options: TrainOptions, kept: Checkpoints) -> tuple[str, DataFrame, TrainOptions]:
    """Folder of the usable records laid out by sub-epoch and word part, parameters with their part, and options with blocks.

    Parts follow from the records' counts, so that no cell is a multiple of another.
    """
    parts = _parts(n, params, options)
    heavy = heavy_parts(usable(whole), parts)
    dealt = part_of(part_of(usable(whole), heavy, "w", "word1", "p", parts), heavy, "c", "word2", "q", parts)
    laid = dealt.withColumn("s", F.pmod(F.col("q") - F.col("p"), F.lit(parts))).drop("q").repartition(min(2 * parts * parts, MOST_TASKS), "s", "p")
    laid = laid.withColumn("k", _order(options.seed)).sortWithinPartitions("s", "p", "k", "word1", "word2")
    return kept.table_path(laid, "s", "p"), part_of(params, heavy, F.col("side"), "id", "part", parts), replace(options, blocks=parts)


def stratified_epoch(kept: Checkpoints, records: str, params: str, options: TrainOptions, k: int) -> tuple[DataFrame, float]:
    """options.blocks sub-epochs; in each, cells (p, p + s) train in parallel, and the last one's parameters are iteration k.

    Neither records nor parameters are shuffled: tasks read their parts and cell from the tables, and write their parts.
    """
    spark, n, total = kept.spark, options.blocks, 0.0
    update = lambda w, c, i, j, x: run_records(w, c, i, j, x, options, options.batch)
    for s in range(n):
        trained = sub_epoch(spark, records, params, s, n, options, update)
        params = kept.scratch_path(trained, "side", "part") if s < n - 1 else kept.save_path(k, trained, ("side", "part"))
        kept.drop_scratch(but=params)
        total += spark.read.schema(trained.schema).parquet(params).where(F.col("side") == COST).agg(F.sum("b")).first()[0] or 0.0
    return kept.load(k), total


def started(ids: DataFrame, options: TrainOptions, start: DataFrame | None) -> DataFrame:
    """Initial parameters; those given in start (side, id, v, b and perhaps g, gb) take the place of the generated ones."""
    own = initial(ids, options)
    if start is None:
        return own
    has = [c for c in ("v", "b", "g", "gb") if c in start.columns]
    given = start.select("side", F.col("id").cast("int").alias("id"), *[F.col(c).alias(f"own_{c}") for c in has])
    both = own.join(given, ["side", "id"], "left")
    return both.select("side", "id", *[(F.coalesce(f"own_{c}", c).alias(c) if c in has else F.col(c)) for c in ("v", "b", "g", "gb")])


def train(pairs: DataFrame | CorpusPairs, ids: DataFrame, options: TrainOptions, folder: str, resume: bool = False, start: DataFrame | None = None) -> DataFrame:
    """Final parameters; checkpoints of each kept iteration, the initial one (0) too, and costs are in folder.

    resume: go on from the last checkpoint. start: parameters, and accumulators, to begin with, as
    parameter files give them. costs() reads the mean cost of each iteration. A corpus's pairs go to their cells at once; others are
    written as a table first.
    """
    spark: SparkSession = ids.sparkSession
    kept = Checkpoints(spark, folder)
    begin = kept.last() if resume else 0
    params = kept.load(begin) if begin else kept.save(0, started(ids, options, start))
    own = isinstance(pairs, CorpusPairs) and pairs.options.symmetric and options.mode != "exact"
    whole = pairs if own else kept.table(as_table(pairs).select("word1", "word2", "val"))
    n, records, at, parts = pairs.met if own else whole.count(), "", "", 0
    if options.mode == "stratified":
        if own:
            options = replace(options, blocks=_parts(n, params, options))
            records, dealt = kept.table_folder(), params.withColumn("part", remainder("id", options.blocks))
            n = laid_cells(pairs, options.blocks, options.seed, records)
        else:
            records, dealt, options = _stratified_tables(whole, n, params, options, kept)
        at = kept.table_path(dealt.select("side", "part", *PARAM_COLUMNS[1:]).repartition("side", "part"), "side", "part")
    elif options.mode == "fullbatch":
        parts = sum_parts(params, options.vector_size, n)
        at = kept.table_path(laid(params, parts), "side", "part")
    for k in range(begin + 1, options.iterations + 1):
        if options.mode == "exact":
            params, total = _split(kept.scratch(exact_epoch(whole, params, options)))
            params = kept.save(k, params)
        elif options.mode == "fullbatch":
            moved = full_batch(whole if own else usable(whole), at, parts, options, "step")
            at = kept.save_path(k, moved, ("side", "part"))
            total, met = spark.read.schema(moved.schema).parquet(at).where(F.col("side") == COST).agg(F.sum("b"), F.sum(F.col("v")[0])).first()
            params, n = kept.load(k), met if own else n
        else:
            params, total = stratified_epoch(kept, records, at, options, k)
            at = kept.path(k)
        spark.createDataFrame([(k, (total or 0.0) / n if n else 0.0)], "iteration int, cost double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/costs/k{k:03d}")
        kept.prune(k, options.checkpoint_every)
    kept.drop_tables()
    return params


def costs(spark: SparkSession, folder: str) -> DataFrame:
    """iteration, cost: the mean over all pairs, as met during the iteration; in full-batch mode before its step."""
    return spark.read.parquet(f"{folder.rstrip('/')}/costs/*").orderBy("iteration")
