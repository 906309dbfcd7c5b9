"""Leakage-safe splits and samples, all by rank of a keyed hash: the same whatever the row order.

The hash is md5 of seed and key, which other engines can reproduce.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from .prefix import number_rows


def hash_rank_key(seed: int, *columns: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in columns)).cast("binary"))


def patient_split(sessions: DataFrame, patient: str, positive: str, test: float = 0.2, val: float = 0.1, seed: int = DEFAULT.seed) -> DataFrame:
    """(patient, stratum, split): patients held out whole, stratified by whether any session is positive.

    A stratum of n patients gives round(n test) patients to test if n >= 3 and round(n val) to val if n >= 4,
    at least one each (halves to even); if these would leave none to train, one each is taken.
    """
    strata = sessions.groupBy(patient).agg(F.max(F.col(positive).cast("int")).alias("stratum"))
    by = Window.partitionBy("stratum")
    ranked = strata.withColumns({"n": F.count(F.lit(1)).over(by), "rn": F.row_number().over(by.orderBy(hash_rank_key(seed, F.col(patient)), patient))})
    n = F.col("n")
    n_test = F.when(n >= 3, F.greatest(F.lit(1), F.bround(n * float(test), 0).cast("int"))).otherwise(0)
    n_val = F.when(n >= 4, F.greatest(F.lit(1), F.bround(n * float(val), 0).cast("int"))).otherwise(0)
    over = n_test + n_val >= n
    ranked = ranked.withColumns({"n_test": F.when(over & (n_test > 0), 1).otherwise(n_test), "n_val": F.when(over & (n_val > 0), 1).otherwise(n_val)})
    split = F.when(F.col("rn") <= F.col("n_test"), "test").when(F.col("rn") <= F.col("n_test") + F.col("n_val"), "val").otherwise("train")
    return ranked.select(patient, "stratum", split.alias("split"))


def session_split(sessions: DataFrame, session: str, positive: str, val: float = 0.25, seed: int = DEFAULT.seed) -> DataFrame:
    """(session, stratum, split): each stratum of at least two sessions gives max(1, round(n val)) to val."""
    s = sessions.select(session, F.col(positive).cast("int").alias("stratum"))
    by = Window.partitionBy("stratum")
    ranked = s.withColumns({"n": F.count(F.lit(1)).over(by), "rn": F.row_number().over(by.orderBy(hash_rank_key(seed, F.col(session)), session))})
    k = F.when(F.col("n") >= 2, F.greatest(F.lit(1), F.bround(F.col("n") * float(val), 0).cast("int"))).otherwise(0)
    return ranked.select(session, "stratum", F.when(F.col("rn") <= k, "val").otherwise("train").alias("split"))


def select_sessions(sessions: DataFrame, session: str, positive: str, most: int, share: float = DEFAULT.session_fraction, seed: int = DEFAULT.seed) -> DataFrame:
    """At most ``most`` sessions: a share of positive ones, then negative ones, then whatever is left of either.

    The two stages are one ranking: rank within the stratum, quota, then top-up by rank.
    """
    s = sessions.withColumn("__y", F.col(positive).cast("int"))
    key = hash_rank_key(seed, F.col(session))
    s = s.withColumn("__rn", F.row_number().over(Window.partitionBy("__y").orderBy(key, session)))
    quota = F.when(F.col("__y") == 1, F.lit(int(most * share))).otherwise(F.lit(most - int(most * share)))
    s = s.withColumn("__late", (F.col("__rn") > quota).cast("int"))
    return s.orderBy("__late", F.desc("__y"), "__rn", session).limit(most).drop("__y", "__rn", "__late")


def positive_first(sessions: DataFrame, positive: str, path: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """``sessions`` with ``place``, from 0: positive sessions first, then by path."""
    return number_rows(sessions, [], [F.col(positive).cast("int").desc(), F.col(path)], "place", config=config)


def downsample_negatives(rows: DataFrame, label: str, keys: Sequence[str], ratio: float = DEFAULT.negative_ratio, most: int = DEFAULT.max_train_windows, seed: int = DEFAULT.seed) -> DataFrame:
    """All positives and min(negatives, positives ratio, most - positives, at least 1) negatives by hash rank.

    One class alone is returned whole.  The k least hashes are found by a cut, not by one global sort:
    counts of hash prefixes give the prefix that holds the k-th, and only its rows are ranked.
    """
    pos, neg = rows.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    if not pos or not neg:
        return rows
    k = max(1, min(neg, int(pos * ratio), most - pos))
    return rows.where(F.col(label) == 1).unionByName(least_by_hash(rows.where(F.col(label) == 0), keys, k, seed))


def least_by_hash(rows: DataFrame, keys: Sequence[str], k: int, seed: int = DEFAULT.seed) -> DataFrame:
    """The k rows of least md5 of their keys."""
    hashed = rows.withColumn("__h", hash_rank_key(seed, *(F.col(c) for c in keys)))
    hashed = hashed.withColumn("__p", F.substring("__h", 1, 3))
    prefixes = hashed.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("__p")))
    edge = prefixes.where(F.col("upto") >= k).orderBy("__p").first()
    if edge is None:
        return hashed.drop("__h", "__p")
    need = k - (edge["upto"] - edge["n"])
    last = hashed.where(F.col("__p") == edge["__p"]).orderBy("__h", *keys).limit(need)
    return hashed.where(F.col("__p") < edge["__p"]).unionByName(last).drop("__h", "__p")


def any_horizon(labels: Sequence[str]) -> Column:
    """1 where any horizon's label is."""
    return F.greatest(*(F.col(c) for c in labels)) if len(labels) > 1 else F.col(labels[0])


def multi_horizon_subset(rows: DataFrame, labels: Sequence[str], keys: Sequence[str], most: int, seed: int = DEFAULT.seed) -> DataFrame:
    """At most ``most`` rows: positives of any horizon first, then negatives; positives are sampled if too many."""
    y = rows.withColumn("__any", any_horizon(labels))
    pos = y.where(F.col("__any") == 1)
    n = pos.count()
    if n >= most:
        return least_by_hash(pos, keys, most, seed).drop("__any")
    return pos.unionByName(least_by_hash(y.where(F.col("__any") == 0), keys, most - n, seed)).drop("__any")


def normal_sample(rows: DataFrame, label: str, keys: Sequence[str], most: int = 250_000, seed: int = DEFAULT.seed) -> DataFrame:
    return least_by_hash(rows.where(F.col(label) == 0), keys, most, seed)


def experiment_grid(bases: DataFrame, seeds: Sequence[int], durations: Sequence[float]) -> DataFrame:
    """(base columns, name, seed, event_seconds): each base run once per seed and once per duration."""
    runs = F.array(
        *(F.struct(F.lit(f"robust_seed{s}_").alias("prefix"), F.lit(s).alias("seed"), F.lit(300.0).alias("event_seconds")) for s in seeds),
        *(F.struct(F.lit(f"robust_label{int(d)}s_").alias("prefix"), F.lit(42).alias("seed"), F.lit(float(d)).alias("event_seconds")) for d in durations),
    )
    g = bases.select("*", F.explode(runs).alias("__r"))
    return g.select(*bases.columns, F.concat("__r.prefix", "base").alias("name"), "__r.seed", "__r.event_seconds")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, count, weight): n / (classes * count)."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy()
    return counts.withColumn("weight", F.sum("count").over(whole).cast("double") / (F.count(F.lit(1)).over(whole) * F.col("count")))
