"""Correlation and rank agreement, per group, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.draws import hash_grid, hash_index, hash_long, hash_range
from evalspark.scaling import GROUP_ROWS, group_rank, largest_group, setting, stable

# Rows per piece when inversions are counted over tasks, and rows of small groups that are counted at once.
PIECE = 65_536
COUNT_ROWS = 262_144


def _no_keys(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Groupings need at least one column; an ungrouped call gets a constant one."""
    return (df, by) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def ordinal_rank(df: DataFrame, by: list[str], value: str, id_col: str, out: str) -> DataFrame:
    """0-based rank by value; equal values are ranked by id."""
    return group_rank(df, by, [value, id_col], out).withColumn(out, F.col(out) - 1)


def pearson(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson r, 0 when either side is constant."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    constant = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return df.groupBy(*by).agg(F.when(constant, 0.0).otherwise(F.coalesce(r, F.lit(0.0))).alias("value"))


def spearman(df: DataFrame, by: list[str], x: str, y: str, id_col: str, ties: str = "ordinal") -> DataFrame:
    """Pearson r of the ranks. Equal values rank by id, or share their mean rank with ``ties="average"``."""
    df, keys = _no_keys(df, by)
    ranked = df.select(*keys, id_col, F.col(x).alias("_x"), F.col(y).alias("_y"))
    for side in ("_x", "_y"):
        ranked = ordinal_rank(ranked, keys, side, id_col, f"{side}_r")
        if ties == "average":
            mean = ranked.groupBy(*keys, side).agg(F.avg(f"{side}_r").alias(f"{side}_m"))
            ranked = ranked.join(mean, [*keys, side]).drop(f"{side}_r").withColumnRenamed(f"{side}_m", f"{side}_r")
    return pearson(ranked, keys, "_x_r", "_y_r").select(*by, "value")


def _tied_pairs(df: DataFrame, keys: list[str], cols: list[str], out: str) -> DataFrame:
    sizes = df.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("_c"))
    return sizes.groupBy(*keys).agg((F.sum(F.col("_c") * (F.col("_c") - 1)) / 2).alias(out))


def discordant_pairs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of pairs per group that ``_x`` and ``_y`` order in opposite ways.

    Rows are numbered in (x, y) order and y becomes an integer code. Two codes differ
    first at one binary digit; so for each digit, rows that share the higher digits
    are scanned in x order and every 0 counts the 1s before it. Each row enters one
    scan per digit, and scans run over pieces of bounded length whose totals are
    carried forward, so the work is n log n and no group meets in one task.
    """
    largest = largest_group(df, keys)
    codes = group_rank(df.select(*keys, "_y").distinct(), keys, ["_y"], "_code", largest=largest)
    rows = group_rank(df.join(codes, [*keys, "_y"]), keys, ["_x", "_y", "_id"], "_i", size="_n", largest=largest)
    digits = F.length(F.bin("_n"))
    scans = rows.select(
        *keys,
        "_i",
        "_code",
        F.floor((F.col("_i") - 1) / PIECE).alias("_piece"),
        F.explode(F.sequence(F.lit(0), digits - 1)).alias("_digit"),
    ).select(
        *keys,
        "_i",
        "_piece",
        "_digit",
        F.expr("shiftright(_code, _digit + 1)").alias("_high"),
        F.expr("shiftright(_code, _digit) & 1").alias("_bit"),
    )
    scan = [*keys, "_digit", "_high"]
    within = Window.partitionBy(*scan, "_piece").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        scans.withColumn("_ones", F.coalesce(F.sum("_bit").over(within), F.lit(0)))
        .groupBy(*scan, "_piece")
        .agg(
            F.sum(F.when(F.col("_bit") == 0, F.col("_ones")).otherwise(0)).alias("_inside"),
            F.sum("_bit").alias("_n1"),
            F.sum(1 - F.col("_bit")).alias("_n0"),
        )
    )
    carried = Window.partitionBy(*scan).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_n1").over(carried), F.lit(0))
    return (
        pieces.withColumn("_across", earlier * F.col("_n0"))
        .groupBy(*keys)
        .agg(F.sum(F.col("_inside") + F.col("_across")).cast("double").alias("discordant"))
    )


def _counted_groups(table: pa.Table, keys: list[str]) -> pa.Table:
    """Pair counts of whole groups that lie one after another: pairs, ties of x, of y and of both, and discordant pairs."""
    n = table.num_rows
    changed = np.zeros(n, bool)
    changed[0] = True
    for key in keys:
        code = table.column(key).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        changed[1:] |= code[1:] != code[:-1]
    group = np.cumsum(changed) - 1
    groups = int(group[-1]) + 1
    x, y = (table.column(c).to_numpy() for c in ("_x", "_y"))

    def ties(*columns: np.ndarray) -> np.ndarray:
        order = np.lexsort([*columns, group])
        same = np.ones(n, bool)
        for c in (group, *columns):
            same[1:] &= c[order][1:] == c[order][:-1]
        same[0] = False
        start = np.flatnonzero(~same)
        size = np.diff(np.append(start, n)).astype(float)
        return np.bincount(group[order[start]], size * (size - 1) / 2, minlength=groups)

    by_y = np.lexsort([y, group])
    rise = np.zeros(n, bool)
    rise[1:] = (y[by_y][1:] != y[by_y][:-1]) | (group[by_y][1:] != group[by_y][:-1])
    dense = np.cumsum(rise)
    code = np.empty(n, np.int64)
    code[by_y] = dense - dense[np.searchsorted(group, np.arange(groups))][group[by_y]]
    # Rows in order of x, then y; two codes differ first at one digit, where a 0 counts the 1s before it.
    row = np.lexsort([y, x, group])
    block, crossed = group.copy(), np.zeros(groups)
    for digit in range(int(code.max()).bit_length() - 1, -1, -1):
        bit = (code[row] >> digit) & 1
        before = np.cumsum(bit) - bit
        first = np.searchsorted(block, np.arange(int(block[-1]) + 1))
        before -= before[first][block]
        crossed += np.bincount(group[row], np.where(bit == 0, before, 0), minlength=groups)
        order = np.argsort(2 * block + bit, kind="stable")
        row, block = row[order], (2 * block + bit)[order]
        block = np.cumsum(np.concatenate([[False], block[1:] != block[:-1]]))
    size = np.bincount(group).astype(float)
    found = {"_pairs": size * (size - 1) / 2, "_tx": ties(x), "_ty": ties(y), "_txy": ties(x, y), "discordant": crossed}
    heads = table.select(keys).take(pa.array(np.flatnonzero(changed)))
    for name, values in found.items():
        heads = heads.append_column(name, pa.array(values))
    return heads


def _pair_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pair counts per group where every group fits a task; a task counts all groups of a batch together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            # The last group may go on in the next batch.
            last = held.slice(held.num_rows - 1)
            same = np.ones(held.num_rows, bool)
            for key in keys:
                code = pa.concat_tables([held.select([key]), last.select([key])]).column(key).combine_chunks().dictionary_encode()
                code = code.indices.fill_null(-1).to_numpy()
                same &= code[:-1] == code[-1]
            start = int(np.flatnonzero(same)[0])
            if start and held.num_rows >= COUNT_ROWS:
                yield from _counted_groups(held.slice(0, start), keys).to_batches()
                held = held.slice(start)
        if held is not None and held.num_rows:
            yield from _counted_groups(held, keys).to_batches()

    names = ("_pairs", "_tx", "_ty", "_txy", "discordant")
    schema = df.select(*keys, *[F.lit(0.0).alias(c) for c in names]).schema
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = df.select(*keys, F.col("_x").cast("double").alias("_x"), F.col("_y").cast("double").alias("_y"))
    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def kendall_tau(df: DataFrame, by: list[str], x: str, y: str, id_col: str) -> DataFrame:
    """Kendall tau-b per group; null when a side is constant. Rows with a null on either side take no part.

    Groups that fit a task are counted there, many at once; if one does not, all pairs are counted digit by digit in
    pieces over tasks.
    """
    df, keys = _no_keys(df, by)
    df = df.select(*keys, F.col(id_col).alias("_id"), F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    # Read by the group sizes, and by the pair count, the tie counts and the scan.
    df = stable(df)
    if largest_group(df, keys) <= setting(df.sparkSession, "groupRows", GROUP_ROWS):
        out = _pair_counts(df, keys)
    else:
        n = F.count(F.lit(1)).cast("double")
        out = df.groupBy(*keys).agg((n * (n - 1) / 2).alias("_pairs"))
        out = out.join(_tied_pairs(df, keys, ["_x"], "_tx"), keys)
        out = out.join(_tied_pairs(df, keys, ["_y"], "_ty"), keys)
        out = out.join(_tied_pairs(df, keys, ["_x", "_y"], "_txy"), keys)
        out = out.join(discordant_pairs(df, keys), keys)
    ordered = F.col("_pairs") - F.col("_tx") - F.col("_ty") + F.col("_txy")
    free_x, free_y = F.col("_pairs") - F.col("_tx"), F.col("_pairs") - F.col("_ty")
    tau = (ordered - 2 * F.col("discordant")) / (F.sqrt(free_x) * F.sqrt(free_y))
    return out.select(*by, F.when((free_x > 0) & (free_y > 0), tau).alias("value"))


STATISTICS: dict[str, Callable[..., DataFrame]] = {"tau": kendall_tau, "rho": spearman}


def resampled(df: DataFrame, by: list[str], cols: list[str], id_col: str, b: int, seed: int) -> DataFrame:
    """b draws with replacement of whole rows per group: ``(by…, replicate, slot, cols…)``."""
    placed = group_rank(df.select(*by, id_col, *cols), by, [id_col], "_i", size="_n")
    slots = placed.select(*by, (F.col("_i") - 1).alias("slot"), "_n", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("replicate"))
    tag = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]
    slots = slots.withColumn("_p", hash_index(F.col("_n"), seed, *tag, F.col("replicate"), F.col("slot"))).drop("_n")
    # Spark takes the slots, which are b times the rows, for few and would broadcast them.
    rows = placed.select(*by, (F.col("_i") - 1).alias("_p"), *cols).hint("merge")
    return slots.join(rows, [*by, "_p"]).drop("_p")


def _codes(column: pa.Array) -> np.ndarray:
    """Whole numbers in the order of the values; -1 for a null."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    out = np.full(len(column), -1, np.int64)
    out[known] = np.unique(column.drop_null().to_numpy(), return_inverse=True)[1]
    return out


def _order(codes: np.ndarray) -> np.ndarray:
    """Stable order of codes; short ones are sorted by counting."""
    return np.argsort(codes.astype(np.uint16) if len(codes) and codes.max() < 2**16 else codes, kind="stable")


def _inversions(seq: np.ndarray) -> int:
    """Pairs of a permutation in falling order, by merging blocks of doubling length, all of one length at once."""
    total, width, most = 0, 1, len(seq)
    size = 1 << max(most - 1, 0).bit_length()
    held = np.concatenate([seq, np.arange(most, size)])
    while width < size:
        # The last digit tells the halves of a block; each of the left half has the ones before it below itself.
        held <<= 1
        held.reshape(-1, 2 * width)[:, width:] |= 1
        held.reshape(-1, 2 * width).sort(axis=1)
        right = held & 1
        blocks = size // (2 * width)
        total += int(np.cumsum(right) @ (1 - right)) - width * width * (blocks * (blocks - 1) // 2)
        held >>= 1
        width *= 2
    return total


def _tau(x: np.ndarray, y: np.ndarray) -> float | None:
    """Kendall tau-b of codes."""
    known = (x >= 0) & (y >= 0)
    x, y = x[known], y[known]
    n = len(x)

    def ties(sizes: np.ndarray) -> int:
        return int((sizes * (sizes - 1) // 2).sum())

    if n < 2:
        return None
    both = x * (int(y.max()) + 1) + y
    order = _order(both)
    runs = np.flatnonzero(np.diff(both[order], prepend=-1))
    pairs, tx, ty, txy = n * (n - 1) // 2, ties(np.bincount(x)), ties(np.bincount(y)), ties(np.diff(runs, append=n))
    if pairs == tx or pairs == ty:
        return None
    ordered = float(pairs - tx - ty + txy)
    return (ordered - 2 * _inversions(_order(y[order]))) / (np.sqrt(float(pairs - tx)) * np.sqrt(float(pairs - ty)))


def _rho(x: np.ndarray, y: np.ndarray) -> float:
    """Spearman rho of codes with ordinal ranks: equal ones rank by place, nulls first."""
    n = len(x)
    if n < 2:
        return 0.0
    rank = np.empty(n, np.int64)
    rank[_order(x + 1)] = np.arange(n)
    common = int(rank[_order(y + 1)] @ np.arange(n))
    return (12 * common - 3 * n * (n - 1) ** 2) / (n * (n * n - 1))


PLAIN: dict[str, Callable[[np.ndarray, np.ndarray], float | None]] = {"tau": _tau, "rho": _rho}
# Numbers that doubles tell apart.
EXACT = ("double", "float", "int", "smallint", "tinyint")


def _fits(df: DataFrame, keys: list[str], x: str, y: str) -> bool:
    """Whether every group fits a task and its values are numbers."""
    kinds = dict(df.dtypes)
    return {kinds[x], kinds[y]} <= set(EXACT) and largest_group(df, keys) <= setting(df.sparkSession, "groupRows", GROUP_ROWS)


def _replicates(
    df: DataFrame, keys: list[str], id_col: str, b: int, compute: Callable[[str, list | None, np.ndarray, np.ndarray, int], float | None], ids: bool = False
) -> DataFrame:
    """``(keys…, replicate, value)`` of ``compute(tag, ids, x, y, replicate)`` from columns ``_x`` and ``_y``.

    Every group fits a task (``_fits``). Its rows travel as one array in id order, once for each run of replicates, and
    the rows of a replicate exist only inside a step.
    """
    spark = df.sparkSession
    tag = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys])
    row = F.struct(F.col(id_col).alias("id"), F.col("_x").cast("double").alias("x"), F.col("_y").cast("double").alias("y"))
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    named = F.col("_rows.id").cast("array<string>") if ids else F.lit(None).cast("array<string>")
    packed = stable(packed.select(*keys, tag.alias("_tag"), named.alias("_ids"), F.col("_rows.x").alias("_x"), F.col("_rows.y").alias("_y")))
    pieces = max(4 * spark.sparkContext.defaultParallelism, 64)
    step = max(1, -(-b // pieces))
    work = packed.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(b - 1), F.lit(step)))).repartition(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tagged, named, first = (batch.column(c)[k].as_py() for c in ("_tag", "_ids", "_first"))
                left, right = (_codes(batch.column(c)[k].values) for c in ("_x", "_y"))
                numbers = range(first, min(first + step, b))
                values = [compute(tagged, named, left, right, r) for r in numbers]
                same = batch.select(keys).take(pa.array([k] * len(numbers)))
                yield pa.RecordBatch.from_arrays(
                    [*same.columns, pa.array(numbers, pa.int32()), pa.array(values, pa.float64())], [*keys, "replicate", "value"]
                )

    schema = df.select(*keys, F.lit(0).alias("replicate"), F.lit(None).cast("double").alias("value")).schema
    return work.mapInArrow(run, schema)


def bootstrap_rank(
    df: DataFrame, by: list[str], x: str, y: str, id_col: str, b: int, seed: int, statistic: str = "tau"
) -> DataFrame:
    """Replicates of a rank statistic. Groups that fit a task are drawn and ranked there, without rows per replicate."""
    df, keys = _no_keys(df, by)
    df = stable(df.select(*keys, id_col, F.col(x).alias("_x"), F.col(y).alias("_y")))
    if _fits(df, keys, "_x", "_y"):
        plain = PLAIN[statistic]

        def drawn(tag: str, ids: list | None, left: np.ndarray, right: np.ndarray, replicate: int) -> float | None:
            place = hash_range(f"{seed}-{tag}-{replicate}", 0, len(left)) % len(left)
            return plain(left[place], right[place])

        return _replicates(df, keys, id_col, b, drawn).select(*by, "replicate", "value")
    df = df.select(*keys, id_col, F.col("_x").alias(x), F.col("_y").alias(y))
    rows = resampled(df, keys, list(dict.fromkeys([x, y])), id_col, b, seed)
    return STATISTICS[statistic](rows, [*keys, "replicate"], x, y, "slot").select(*by, "replicate", "value")


def percentile_band(replicates: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    """Lower and upper percentile of the replicates."""
    tail = (1 - level) / 2
    band = F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail)))
    return replicates.groupBy(*by).agg(band.alias("_b")).select(
        *by, F.get("_b", F.lit(0)).alias("ci_low"), F.get("_b", F.lit(1)).alias("ci_high")
    )


def permuted(df: DataFrame, x: str, y: str, id_col: str, b: int, seed: int) -> DataFrame:
    """b copies of the rows in which x is shuffled against y: ``(replicate, position, x, y)``."""
    fixed = group_rank(df.select(id_col, F.col(y).alias("y")), [], [id_col], "position").drop(id_col)
    copies = df.select(id_col, F.col(x).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("replicate"))
    copies = copies.withColumn("_h", hash_long(seed, F.col("replicate"), F.col(id_col)))
    mixed = group_rank(copies, ["replicate"], ["_h", id_col], "position")
    # As in ``resampled``, the copies are far more than Spark takes them for.
    return mixed.select("replicate", "position", "x").join(fixed.hint("merge"), "position")


def permutation_p(
    df: DataFrame, x: str, y: str, id_col: str, b: int, seed: int, statistic: str = "tau"
) -> DataFrame:
    """(1 + number of shuffles that reach the observed value) / (b + 1)."""
    stat = STATISTICS[statistic]
    df = stable(df.select(id_col, x, y))
    observed = stat(df, [], x, y, id_col).select(F.round("value", 12).alias("v")).scalar()
    keyed, keys = _no_keys(df.select(id_col, F.col(x).alias("_x"), F.col(y).alias("_y")), [])
    if _fits(keyed, keys, "_x", "_y"):
        plain = PLAIN[statistic]

        def mixed(tag: str, ids: list | None, left: np.ndarray, right: np.ndarray, replicate: int) -> float | None:
            order = np.argsort(hash_grid([f"{seed}-{replicate}"], ids)[0], kind="stable")
            return plain(left[order], right)

        shuffled = _replicates(keyed, keys, id_col, b, mixed, ids=True)
    else:
        shuffled = stat(permuted(df, x, y, id_col, b, seed), ["replicate"], "x", "y", "position")
    reached = F.count_if(F.round("value", 12) >= observed)
    return shuffled.agg(((reached + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def internal_agreement(
    wide: DataFrame, model: str, tasks: list[str], top: int | None = None, statistic: str = "tau"
) -> DataFrame:
    """Mean over tasks of the statistic between a model's mean and its score on the task.

    ``top`` keeps the models with the highest means.
    """
    mean = sum((F.col(t) for t in tasks[1:]), F.col(tasks[0])) / len(tasks)
    scored = stable(wide.select(model, *tasks, mean.alias("_mean")))
    if top is not None:
        scored = scored.orderBy(F.desc("_mean"), model).limit(top)
    long = scored.unpivot([model, "_mean"], tasks, "task_name", "score")
    per_task = STATISTICS[statistic](long, ["task_name"], "_mean", "score", model)
    return per_task.agg(F.avg("value").alias("value"))


def threshold_sweep(df: DataFrame, x: str, thresholds: list[float], min_models: int) -> DataFrame:
    """Rows repeated for every threshold they reach; thresholds with too few rows are dropped.

    Each row carries only the thresholds at or below its own value.
    """
    reached = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col(x))
    rows = df.withColumn("threshold", F.explode(reached))
    kept = rows.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_models")).where(F.col("n_models") >= min_models)
    return rows.join(kept, "threshold")


def hook_curve(
    df: DataFrame, x: str, y: str, id_col: str, thresholds: list[float], min_models: int, b: int, seed: int
) -> DataFrame:
    """Kendall tau above each threshold with a 95 % bootstrap band."""
    rows = stable(threshold_sweep(df.select(id_col, x, y), x, thresholds, min_models))
    point = kendall_tau(rows, ["threshold"], x, y, id_col).withColumnRenamed("value", "tau")
    band = percentile_band(bootstrap_rank(rows, ["threshold"], x, y, id_col, b, seed), ["threshold"])
    return point.join(band, "threshold")


def linear_fit(df: DataFrame, by: list[str], x: str | Column, y: str | Column) -> DataFrame:
    """Least-squares line with its coefficient of determination and x range."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    both = df.select(*by, x.cast("double").alias("_x"), y.cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    return both.groupBy(*by).agg(
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("r2"),
        F.min("_x").alias("x_min"),
        F.max("_x").alias("x_max"),
        F.count(F.lit(1)).alias("n"),
    )
