"""Relational operators on keyed tables: selection, merging, reciprocity, outliers, joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A

PAIR = ["t", "r"]


def backscatter(waves: DataFrame) -> DataFrame:
    return waves.where("t = r")


def extract_pairs(waves: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of wanted pairs; wanted maps r to an array of t."""
    pairs = wanted.select("r", F.explode("ts").alias("t")).distinct()
    return waves.join(pairs, PAIR, "left_semi")


def exclude_pairs(waves: DataFrame, unwanted: DataFrame) -> DataFrame:
    pairs = unwanted.select("r", F.explode("ts").alias("t")).distinct()
    return waves.join(pairs, PAIR, "left_anti")


#: Bins of a histogram in a selection by rank, and rows that may come to the driver.
BINS, FEW = 1024, 4096


def values_at(rows: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """The values of some ranks (0 first) among all that are not null, exactly, without one task that sees them all.

    Histograms between the least and the largest value of a bin narrow the place of each rank
    until few rows are left there, or equal ones only.  The rows are read a few times.
    """
    v = F.col(value).cast("double")
    rows = rows.where(v.isNotNull()).select(v.alias("v"))
    n, lo, hi = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n or any(not 0 <= k < n for k in ranks):
        raise ValueError("a rank is outside the rows")
    found: dict[int, float] = {}
    todo = [(lo, hi, 0, n, sorted(set(ranks)))]
    while todo:
        lo, hi, below, n, wanted = todo.pop()
        part = rows.where(F.col("v").between(lo, hi))
        if lo == hi or n <= FEW:
            held = [lo] * n if lo == hi else sorted(r.v for r in part.collect())
            found |= {k: held[k - below] for k in wanted}
            continue
        step = F.floor((F.col("v") - lo) / ((hi - lo) / BINS))
        bins = part.groupBy(step.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # BINS + 1 rows
        if len(bins) == 1:  # too close for their difference to tell them apart
            bins = part.groupBy("v").agg(F.count("*").alias("n")).select("n", F.col("v").alias("lo"), F.col("v").alias("hi")).collect()
        for b in sorted(bins, key=lambda b: b.lo):
            if own := [k for k in wanted if below <= k < below + b.n]:
                todo.append((b.lo, b.hi, below, b.n, own))
            below += b.n
    return [found[k] for k in ranks]


def exact_quantiles(rows: DataFrame, value: str, shares: list[float]) -> list[float] | None:
    """Quantiles with linear interpolation; None without rows."""
    n = rows.where(F.col(value).isNotNull()).count()
    if not n:
        return None
    at = [q * (n - 1) for q in shares]
    ends = values_at(rows, value, [k for x in at for k in (int(x), min(int(x) + 1, n - 1))])
    return [a + (x - int(x)) * (b - a) for x, a, b in zip(at, ends[::2], ends[1::2], strict=True)]


def random_pairs(waves: DataFrame, share: float, seed: int) -> DataFrame:
    """A share (at most 1), or a number of rows, drawn without replacement, the same for the same seed: those of the smallest hashes."""
    from .tomography import written

    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *PAIR), 11)  # as many bits as a double holds
    keyed = written(waves.withColumn("_draw", draw), "drawn")
    total = keyed.count()
    n = min(total, int(share) if share > 1 else int(total * share))
    if not n:
        return waves.limit(0)
    last = int(values_at(keyed, "_draw", [n - 1])[0])
    sure = keyed.where(F.col("_draw") < last)
    ties = keyed.where(F.col("_draw") == last).orderBy(*PAIR).limit(n - sure.count())  # rows of one hash
    return sure.unionByName(ties).drop("_draw")


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.lit(seed), *rows.columns))


def exclude_groups(arrivals: DataFrame, groups: list[int], size: int, key: str = "t") -> DataFrame:
    """Rows of elements outside the groups."""
    return arrivals.where(~F.floor(F.col(key) / size).isin(groups))


def merge_last(*tables: DataFrame, keys=PAIR) -> DataFrame:
    """All rows; of equal keys that of the last table stays."""
    rows = reduce(DataFrame.unionByName, [t.withColumn("_o", F.lit(k)) for k, t in enumerate(tables)])
    rest = [c for c in rows.columns if c not in (*keys, "_o")]
    held = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_o").alias("_v"))
    return held.select(*keys, "_v.*")


def merge_largest(*tables: DataFrame, keys=PAIR, value: str = "time") -> DataFrame:
    """All keys in order; of equal keys the largest value stays."""
    rows = reduce(DataFrame.unionByName, tables)
    return rows.groupBy(*keys).agg(F.max(value).alias(value)).orderBy(*keys)


def reciprocal_pairs(waves: DataFrame, value: Column | str = "data") -> DataFrame:
    """t < r with values of both directions: fwd and rev; rows without a partner and t = r are left out."""
    rows = waves.select(*PAIR, (F.col(value) if isinstance(value, str) else value).alias("fwd"))
    back = rows.select(F.col("t").alias("r"), F.col("r").alias("t"), F.col("fwd").alias("rev"))
    return rows.where("t < r").join(back, PAIR)


def reciprocal_average(waves: DataFrame) -> DataFrame:
    """Mean of both directions over the union of their windows."""
    rows = reciprocal_pairs(waves, F.struct("dstart", "data"))
    start, data = A.add(F.col("fwd.data"), F.col("fwd.dstart"), F.col("rev.data"), F.col("rev.dstart"))
    return rows.select(*PAIR, start.alias("dstart"), A.scale(data, 0.5).alias("data"))


def aligned_average(waves: DataFrame, osamp: int, clip: bool = False) -> DataFrame:
    """t, r, nsamp, dstart, data: mean of both directions, each moved half of their delay towards the other; clip: cut to the union of their windows."""
    from ..functions import kernels as K
    from ..functions import spectral as S

    rows = reciprocal_pairs(waves, F.struct("nsamp", "dstart", "data"))
    rows = rows.select(*PAIR, F.greatest("fwd.nsamp", "rev.nsamp").alias("nsamp"), *(F.col(f"{w}.{c}").alias(f"{w}_{c}") for w in ("fwd", "rev") for c in ("dstart", "data")))

    def kernel(n, a0, a, b0, b):
        half = K.find_delay(a, a0, b, b0, osamp)[0] / 2
        mean = (K.delay_by(a, a0, n, -half) + K.delay_by(b, b0, n, half)) / 2
        lo, hi = (max(0, min(a0, b0)), min(n, max(a0 + len(a), b0 + len(b)))) if clip else (0, n)
        return n, lo, mean[lo:hi]

    return S.apply(rows, ["nsamp", "fwd_dstart", "fwd_data", "rev_dstart", "rev_data"], {"nsamp": "long", "dstart": "long", "data": "array<double>"}, kernel)


def common_arrivals(tables: list[DataFrame]) -> DataFrame:
    """t, r, times: the keys that all targets have, values in target order."""
    rows = reduce(lambda a, b: a.join(b, PAIR), [t.select(*PAIR, F.col("time").alias(f"_{k}")) for k, t in enumerate(tables)])
    return rows.select(*PAIR, F.array(*(f"_{k}" for k in range(len(tables)))).alias("times"))


def with_default(rows: DataFrame, known: DataFrame, default: dict, keys=PAIR) -> DataFrame:
    """Columns of known by key, or the defaults."""
    out = rows.join(known, list(keys), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in default.items()})


def uncached(rows: DataFrame, cache: DataFrame, keys=PAIR) -> DataFrame:
    return rows.join(cache, list(keys), "left_anti")


def distance(a: str = "t", b: str = "r") -> Column:
    return F.sqrt(sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) ** 2 for c in "xyz"), F.lit(0.0)))


def with_endpoints(arrivals: DataFrame, senders: DataFrame, receivers: DataFrame) -> DataFrame:
    """Rows of which both elements are known, with tx, ty, tz, rx, ry, rz."""
    named = lambda d, k: d.select(F.col("e").alias(k), *(F.col(c).alias(f"{k}{c}") for c in "xyz"))
    return arrivals.join(named(senders, "t"), "t").join(named(receivers, "r"), "r")


def within_quartiles(rows: DataFrame, value: str, by: list | None = None, reach: float = 1.5, of: DataFrame | None = None) -> DataFrame:
    """Rows of which value lies within reach inter-quartile ranges of the quartiles.

    The quartiles are exact, by group or of all rows (of another table if given).
    """
    base = of if of is not None else rows
    if not by:
        # numbers, found without one task that sees all rows
        found = exact_quantiles(base, value, [0.25, 0.75])
        if found is None:
            return rows.limit(0)
        lo, hi = found
        return rows.where(F.col(value).between(lo - reach * (hi - lo), hi + reach * (hi - lo)))
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q")
    names = [f"_g{k}" for k in range(len(by))]
    keyed = lambda d: d.withColumns(dict(zip(names, by, strict=True)))
    rows = keyed(rows).join(keyed(base).groupBy(*names).agg(q), names)
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    return rows.where((F.col(value) >= lo - reach * (hi - lo)) & (F.col(value) <= hi + reach * (hi - lo))).drop("_q", *names)


def clean_arrivals(arrivals: DataFrame, senders: DataFrame, receivers: DataFrame, speeds: tuple[float, float] | None = None, with_backscatter: bool = False, reach: float | None = 1.5, start: int = 0, stride: int = 1) -> DataFrame:
    """t, r, time, speed of usable arrivals.

    Both elements known; backscatter rows only on request and not held to the speed range;
    every stride-th valid row; outliers of speed against the quartiles of all valid rows.
    """
    from .rolling import every_nth
    from .tomography import written

    rows = arrivals if with_backscatter else arrivals.where("t <> r")
    rows = with_endpoints(rows, senders, receivers).withColumn("speed", distance() / F.col("time"))
    if speeds:
        rows = rows.where((F.col("t") == F.col("r")) | F.col("speed").between(*speeds))
    valid = rows.select(*PAIR, "time", "speed")
    if reach is not None:
        valid = written(valid, "valid")  # read for the quartiles and for the rows
    taken = valid if stride == 1 and not start else every_nth(valid, PAIR, start, stride)
    return taken if reach is None else within_quartiles(taken, "speed", reach=reach, of=valid)


def neighbours(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """t, r, nt, nr: the existing pairs in the neighbourhoods of both elements (near: e, n); each element is its own."""
    near = near.select("e", "n").unionByName(near.select("e", F.col("e").alias("n"))).distinct()
    near = near.unionByName(pairs.select(F.col("t").alias("e")).unionByName(pairs.select(F.col("r").alias("e"))).distinct().select("e", F.col("e").alias("n"))).distinct()
    rows = pairs.select(*PAIR).join(near.select(F.col("e").alias("t"), F.col("n").alias("nt")), "t").join(near.select(F.col("e").alias("r"), F.col("n").alias("nr")), "r")
    return rows.join(pairs.select(F.col("t").alias("nt"), F.col("r").alias("nr")), ["nt", "nr"]).distinct()


def neighbourhood_outliers(rows: DataFrame, near: DataFrame, value: str, reach: float = 1.5) -> DataFrame:
    """Rows with keep: whether value is within the quartiles of its neighbourhood."""
    around = neighbours(rows, near).join(rows.select(F.col("t").alias("nt"), F.col("r").alias("nr"), F.col(value).alias("_v")), ["nt", "nr"])
    q = around.groupBy(*PAIR).agg(F.percentile("_v", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"), F.count("*").alias("n"))
    out = rows.join(q, PAIR)
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    return out.withColumn("keep", F.col(value).between(lo - reach * (hi - lo), hi + reach * (hi - lo))).drop("_q")


def status_counts(rows: DataFrame, rules: list[tuple[str, Column]], otherwise: str = "valid") -> DataFrame:
    """status, n: the first rule that holds names a row's outcome."""
    status = F.lit(otherwise)
    for name, rule in reversed(rules):
        status = F.when(rule, name).otherwise(status)
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def longest_groups(rows: DataFrame, keys=PAIR, order: str = "file", value: str = "data") -> DataFrame:
    """Values by key in file order, of the keys that have the most."""
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_m"))
    most = held.agg(F.max(F.size("_m")).alias("_n"))
    return held.join(F.broadcast(most), F.size("_m") == F.col("_n")).select(*keys, F.transform("_m", lambda m: m[value]).alias("members"))


def equalize(waves: DataFrame, by=PAIR, level: str = "peak", individual: bool = False) -> DataFrame:
    """Data over the largest level of its group (or its own); left alone where that is negligible against the largest of all."""
    top = waves.agg(F.max(level).alias("_all"))
    group = F.max(level).over(W.partitionBy(*by)) if not individual else F.col(level)
    rows = waves.withColumn("_g", group).crossJoin(F.broadcast(top))  # one row
    return rows.withColumn("data", F.when(F.col("_g") >= 1.4901161193847656e-08 * F.col("_all"), A.divide(F.col("data"), F.col("_g"))).otherwise(F.col("data"))).drop("_g", "_all")


def round_trip_times(elements: DataFrame, reflectors: DataFrame, speed: float, radius: float = 0.0, offset: float = 0.0) -> DataFrame:
    """e, times: 2 * (distance - radius) / speed + offset to each reflector in order; a reflector's own c and radius stand first.

    Reflectors are few: their number is checked against 100,000 and they are then broadcast.
    """
    n = reflectors.count()
    if n > 100_000:
        raise ValueError("too many reflectors")
    c = F.coalesce("c", F.lit(speed)) if "c" in reflectors.columns else F.lit(speed)
    rad = F.coalesce("radius", F.lit(radius)) if "radius" in reflectors.columns else F.lit(radius)
    far = reflectors.select(F.col("e").alias("f"), *(F.col(x).alias(f"f{x}") for x in "xyz"), c.alias("_c"), rad.alias("_r"))
    rows = elements.join(F.broadcast(far))
    d = F.sqrt(sum(((F.col(x) - F.col(f"f{x}")) ** 2 for x in "xyz"), F.lit(0.0)))
    rows = rows.select("e", "f", (2 * (d - F.col("_r")) / F.col("_c") + offset).alias("time"))
    return rows.groupBy("e").agg(F.array_sort(F.collect_list(F.struct("f", "time"))).alias("p")).select("e", F.transform("p", lambda p: p["time"]).alias("times"))


def near_equal_batches(rows: DataFrame, n: int, group: list[str], order: str) -> DataFrame:
    """batch: the part of each group, of n contiguous parts as equal as can be (the first ones larger)."""
    return rows.withColumn("batch", F.ntile(n).over(W.partitionBy(*group).orderBy(order)) - 1)


def content_owners(files: DataFrame) -> DataFrame:
    """path, hash, place, holders: files of equal content share a hash; place is a file's index among them."""
    by = W.partitionBy("hash")
    return files.withColumn("place", F.row_number().over(by.orderBy("path")) - 1).withColumn("holders", F.count("*").over(by))


def content_hash(files: DataFrame, size: int = 10 << 20, chunks: int = 1) -> DataFrame:
    """path, hash of a file's first chunks."""
    return files.select("path", F.sha2(F.substring("content", 1, size * max(chunks, 1)), 512).alias("hash"))


def regroup(reps: DataFrame) -> DataFrame:
    """Spectral records of sources by group as records of groups by source: one shuffle, then order within each group."""
    return reps.repartition("grp").sortWithinPartitions("grp", "src", "pos")


def merge_batches(reps: DataFrame) -> DataFrame:
    """src, grp, pos, ... of batched groups (src, grp, batch, pos) put together again; positions follow the batches."""
    sizes = reps.groupBy("src", "grp", "batch").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("src", "grp").orderBy("batch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_o", before).drop("_n")
    return reps.join(offsets, ["src", "grp", "batch"]).withColumn("pos", F.col("pos") + F.col("_o")).drop("batch", "_o")


def group_sizes(reps: DataFrame) -> DataFrame:
    return reps.groupBy("src", "grp").agg(F.count("*").alias("n"))


def shifted_members(groups: DataFrame, arrivals: DataFrame, keep_unmatched: bool = True, keys=PAIR) -> DataFrame:
    """keys, member, shift: how far each member moves so that all arrive with the first (members in order; times array in arrivals)."""
    rows = groups.select(*keys, F.posexplode("members").alias("member", "data")).join(arrivals.select(*keys, "times"), list(keys), "left")
    known = F.size("times") > F.col("member")
    rows = rows.withColumn("shift", F.when(known, F.get("times", F.lit(0)) - F.get("times", F.col("member"))))
    return rows.withColumn("shift", F.coalesce("shift", F.lit(0.0))).drop("times") if keep_unmatched else rows.where("shift is not null").drop("times")
