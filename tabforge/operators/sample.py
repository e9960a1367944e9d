"""Deterministic hash-ordered selection: random / stratified splits, undersampling, samples.

Row order is ``md5(key|seed)``: reproducible in any engine and independent of partitioning.
"Take the k first rows of each group in that order" is done without a global sort or a
window: histograms of the uniform hash prefix locate the k-th row, then one filter keeps
exactly k rows (the cut inside the final bucket is made on the full hash).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from ..functions.exprs import seeded_hash

_HBITS_HEX = 13  # hash prefix used for bucketing: 52 bits


_PREFIX_BITS = _HBITS_HEX * 4
_BUCKET_BITS = 12  # 4096 buckets on the hash prefix per refinement pass
COLLECT_LIMIT = 200_000


def _hash_histogram(hd: DataFrame, gcols: list[str], lo: int, shift: int, extra=None):
    """Counts per (group, bucket) of rows whose prefix lies in [lo, lo + 2^(shift+12))."""
    first = extra is None
    # all rows: the bucket is the first hex digits as they are
    b = F.substring("__key", 1, _BUCKET_BITS // 4) if first else F.shiftright(_prefix() - F.lit(lo), shift).cast("int")
    d = hd if first else hd.where(extra)
    rows = d.groupBy(*gcols, b.alias("__b")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for r in rows:
        out.setdefault(tuple(r[g] for g in gcols), {})[int(r["__b"], 16) if first else r["__b"]] = r["n"]
    return out


def _prefix():
    """The hash prefix as a number."""
    return F.conv(F.substring("__key", 1, _HBITS_HEX), 16, 10).cast("long")


def _between(lo: int, hi: int):
    """Rows whose prefix lies in [lo, hi), by its hex digits."""
    digits = F.substring("__key", 1, _HBITS_HEX)
    below = digits < F.lit(f"{hi:0{_HBITS_HEX}x}") if hi < 1 << _PREFIX_BITS else F.lit(True)
    return (digits >= F.lit(f"{lo:0{_HBITS_HEX}x}")) & below


def select_first_k(df: DataFrame, key_cols: list[str], k, group_col: str | None = None,
                   seed: int = 42, flag: str = "__sel") -> DataFrame:
    """Adds boolean ``flag``: row is among the first ``k`` rows of its group in md5(key|seed) order.

    ``k`` is an int, a dict {group: k}, or a callable {group: n} -> {group: k} evaluated on the
    group sizes found by the first pass. The hash prefix is uniform on a known range, so pass 1
    is a histogram (4096 buckets per group, partial-aggregated: its size does not grow with the
    data) that also yields the group sizes; the bucket holding the k-th row is refined the same
    way until it is small, then its (bounded) hashes are fetched and the exact cut is read off.
    Typically 2 passes, whatever the table size.
    """
    # rows with one key are told apart by a hash of the whole row; only rows alike in all columns tie
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    row_hash = F.lpad(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in plain])), 16, "0")
    hd = df.withColumn("__key", seeded_hash(key_cols, seed))
    gcols = [group_col] if group_col else []
    shift = _PREFIX_BITS - _BUCKET_BITS
    hist = _hash_histogram(hd, gcols, 0, shift)
    sizes = {g: sum(b.values()) for g, b in hist.items()}
    if callable(k):
        ks = k({(g[0] if group_col else None): n for g, n in sizes.items()})
        ks = {g: ks.get(g[0] if group_col else None, 0) for g in sizes}
    elif isinstance(k, dict):
        ks = {g: k.get(g[0] if group_col else None, 0) for g in sizes}
    else:
        ks = {g: int(k) for g in sizes}
    # per group: rows with prefix < lo are all in; the k-th row lies in [lo, lo + width)
    state = {}
    for g, n in sizes.items():
        kk = ks[g]
        if 0 < kk < n:
            state[g] = {"lo": 0, "shift": shift, "need": kk, "buckets": hist[g]}
    cuts = {}
    while state:
        fetch, refine = {}, {}
        for g, st in state.items():
            cum = 0
            for b in sorted(st["buckets"]):
                c = st["buckets"][b]
                if cum + c >= st["need"]:
                    lo = st["lo"] + (b << st["shift"])
                    width = 1 << st["shift"]
                    need = st["need"] - cum
                    if c <= COLLECT_LIMIT or st["shift"] == 0:
                        fetch[g] = (lo, lo + width, need)
                    else:
                        refine[g] = {"lo": lo, "shift": max(st["shift"] - _BUCKET_BITS, 0), "need": need}
                    break
                cum += c
        if fetch:
            cond = F.lit(False)
            for g, (lo, hi, _need) in fetch.items():
                c = _between(lo, hi)
                if group_col:
                    c = c & F.col(group_col).eqNullSafe(F.lit(g[0]))
                cond = cond | c
            got = {}
            for r in hd.where(cond).select(*gcols, F.concat("__key", row_hash).alias("__h")).collect():  # bounded by COLLECT_LIMIT per group
                got.setdefault(tuple(r[x] for x in gcols), []).append(r["__h"])
            for g, (lo, _hi, need) in fetch.items():
                cuts[g] = sorted(got[g])[need - 1]
                del state[g]
        for g, st in refine.items():
            extra = _between(st["lo"], st["lo"] + (1 << (st["shift"] + _BUCKET_BITS)))
            if group_col:
                extra = extra & F.col(group_col).eqNullSafe(F.lit(g[0]))
            st["buckets"] = _hash_histogram(hd, gcols, st["lo"], st["shift"], extra).get(g, {})
            state[g] = st
    sel = F.lit(False)
    for g, n in sizes.items():
        kk = ks[g]
        gc = F.col(group_col).eqNullSafe(F.lit(g[0])) if group_col else F.lit(True)
        if kk >= n:
            sel = sel | gc
        elif kk > 0:
            key_cut, row_cut = cuts[g][:32], cuts[g][32:]
            sel = sel | (gc & ((F.col("__key") < F.lit(key_cut)) | ((F.col("__key") == F.lit(key_cut)) & (row_hash <= F.lit(row_cut)))))
    return hd.withColumn(flag, sel).drop("__key")


def split_random(df: DataFrame, key_cols, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` = 'test' for exactly ceil(test_size * n) rows (first in hash order), else 'train'."""
    key_cols = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    out = select_first_k(df, key_cols, lambda sizes: {g: int(math.ceil(test_size * n)) for g, n in sizes.items()},
                         None, seed)
    return out.withColumn("split", F.when(F.col("__sel"), "test").otherwise("train")).drop("__sel")


def stratified_counts(class_counts: dict, test_size: float) -> dict:
    """Largest-remainder allocation of ceil(test_size * n) test rows over classes
    (ties: larger class first, then smaller class value)."""
    n = sum(class_counts.values())
    n_test = int(math.ceil(test_size * n))
    base = {c: int(math.floor(test_size * m)) for c, m in class_counts.items()}
    rest = n_test - sum(base.values())
    order = sorted(class_counts, key=lambda c: (-(test_size * class_counts[c] - base[c]), -class_counts[c], str(c)))
    for c in order[:max(rest, 0)]:
        base[c] += 1
    return base


def split_stratified(df: DataFrame, key_cols, target: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Per-class test counts by largest remainder; falls back to a random split when the
    smallest class has fewer than 2 rows."""
    key_cols = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    counts = {r[0]: r[1] for r in df.groupBy(target).count().collect()}
    if not counts or min(counts.values()) < 2:
        return split_random(df, key_cols, test_size, seed)
    alloc = stratified_counts(counts, test_size)
    out = select_first_k(df, key_cols, alloc, target, seed)
    return out.withColumn("split", F.when(F.col("__sel"), "test").otherwise("train")).drop("__sel")


def train_test(df_with_split: DataFrame):
    return (df_with_split.where(F.col("split") == "train").drop("split"),
            df_with_split.where(F.col("split") == "test").drop("split"))


def undersample(df: DataFrame, key_cols, target: str, seed: int = 42) -> DataFrame:
    """Every class cut to the minority class size (first rows in hash order)."""
    key_cols = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    counts = {r[0]: r[1] for r in df.where(F.col(target).isNotNull()).groupBy(target).count().collect()}
    if len(counts) < 2:
        raise ValueError("balancing needs a target with two or more classes")
    m = min(counts.values())
    out = select_first_k(df.where(F.col(target).isNotNull()), key_cols, {c: m for c in counts}, target, seed)
    return out.where(F.col("__sel")).drop("__sel")



def class_sizes(df: DataFrame, target: str, limit: int = 10_000) -> dict:
    """Rows of each class that is not NULL, for at most ``limit`` classes."""
    found = df.where(F.col(target).isNotNull()).groupBy(target).count().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{target!r} has more than {limit} classes")
    return {r[0]: r[1] for r in found}


def smote(df: DataFrame, key: str, target: str, features: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Every class raised to the size of the largest by rows between a row and one of its nearest
    neighbours of the same class: (``features`` as doubles, ``target``), given rows first to last.

    ``k`` neighbours, or one less than the smallest class has rows. A class of ``n`` rows that lacks ``m``
    gets ``m // n`` new rows from each, and one more from the first ``m % n`` in the order of
    md5(key|seed). The ``j``-th new row of a row takes its bits from md5(key|seed|j): the first eight hex digits
    choose the neighbour, the next eight the place u in [0, 1) between the two. Rows without a class or
    with a missing feature are left out; fewer than two classes is an error."""
    from ..functions.exprs import number
    from .neighbors import nearest
    whole = F.col(target).isNotNull()
    for c in features:
        whole = whole & number(c).isNotNull()
    rows = df.where(whole).select(F.col(key).alias(key), *[number(c).alias(c) for c in features], target)
    sizes = class_sizes(rows, target)
    if len(sizes) < 2:
        raise ValueError("balancing needs a target with two or more classes")
    most, k = max(sizes.values()), min(k, max(1, min(sizes.values()) - 1))
    short = {c: most - n for c, n in sizes.items() if n < most}
    single = [c for c in short if sizes[c] < 2]
    if single:
        raise ValueError(f"class {single[0]!r} has one row, which has no neighbour")
    given = rows.select(*features, target)
    if not short:
        return given
    # one search for all classes: a further feature sets them farther apart than any rows of one class are
    r = rows.agg(*[(F.max(c) - F.min(c)).alias(f"r{i}") for i, c in enumerate(features)]).first()
    apart = 2.0 * (1.0 + math.sqrt(sum(v * v for v in r)))
    number_of = F.create_map(*[x for i, c in enumerate(sorted(short)) for x in (F.lit(c), F.lit(i * apart))])
    lacks = F.create_map(*[x for c, m in short.items() for x in (F.lit(c), F.lit(m // sizes[c]))])
    own = rows.where(F.col(target).isin(list(short))).withColumn("__values", F.array(*features)).withColumn("__class", number_of[F.col(target)])
    own = select_first_k(own, [key], {c: m % sizes[c] for c, m in short.items()}, target, seed)
    own = own.withColumn("__times", lacks[F.col(target)] + F.col("__sel").cast("int"))
    near = nearest(own.where("__times > 0").select(key, *features, "__class"), own, [*features, "__class"], k, key, key, "__values", exclude_self=True)
    near = near.withColumnRenamed("id", "__near_id")
    base = own.join(near, F.col(key) == F.col("__near_id")).withColumn("__j", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    base = base.withColumn("__bits", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)), F.col("__j").cast("string"))))
    pick = F.pmod(F.conv(F.substring("__bits", 1, 8), 16, 10).cast("long"), F.size("neighbors")).cast("int")
    u = F.conv(F.substring("__bits", 9, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    base = base.withColumn("__other", F.get("neighbors", pick)["value"]).withColumn("__u", u)
    new = base.select(*[(F.col(f) + F.col("__u") * (F.get("__other", F.lit(i)) - F.col(f))).alias(f) for i, f in enumerate(features)], target)
    return given.union(new)


def balance_table(df: DataFrame, target: str, features: list[str] | None = None, exclude=()) -> DataFrame:
    """What balancing works on: the numeric features (all of them, or ``features``) and the target, rows
    without a class left out."""
    from ..functions.roles import numeric_columns
    features = features or [c for c in numeric_columns(df, exclude) if c != target]
    return df.where(F.col(target).isNotNull()).select(*features, target)
