"""Splits by time, provenance, fidelity and party."""

from __future__ import annotations

import re
import warnings
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sunder.errors import ColumnError, ConfigurationError, EmptyPartitionError, MissingSourceWarning, ScalabilityError
from sunder.functions.hashing import uniform
from sunder.functions.sizes import resolve_sizes
from sunder.plans.groups import assign_groups
from sunder.plans.rank import value_rank
from sunder.plans.scratch import Scratch

DAYS = {"D": 1, "W": 7, "M": 30, "Y": 365}
MISSING = "__MISSING__"
MAX_PARTIES = 10_000


def offset_days(offset: str | int) -> int:
    """Days of ``"3M"`` and the like; a month is 30 days, a year 365."""
    if isinstance(offset, int) and not isinstance(offset, bool):
        return offset
    m = re.fullmatch(r"(\d+)([DWMY])", str(offset))
    if not m:
        raise ConfigurationError(f"no offset: {offset!r}")
    return int(m[1]) * DAYS[m[2]]


def _dated(df: DataFrame, id_col: str, date: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.to_date(date).alias("d"))
    if rows.where("d is null").take(1):
        raise ColumnError(f"{date}: every record has a date")
    return rows


def temporal(df: DataFrame, id_col: str, date: str, cut_date=None, valid_cut_date=None, embargo="0D", tie_policy: str = "train", **sizes) -> DataFrame:
    """``id, partition``: before the cut trains, after it tests; an embargo after the cut is discarded."""
    rows = Scratch(df.sparkSession, "dates").keep(_dated(df, id_col, date))
    n = rows.count()
    resolved = resolve_sizes(n, **sizes)
    day = F.datediff("d", F.lit("1970-01-01"))
    if cut_date is None:
        at = min(max(resolved.train + resolved.valid - 1, 0), n - 1)
        cut_date = value_rank(rows, day, "id").where(F.col("pos") == at).first().d
    cut = F.lit(cut_date).cast("date")
    end = F.date_add(cut, offset_days(embargo))
    d = F.col("d")
    trains = (d < cut) | ((d == cut) if tie_policy == "train" else F.lit(False))
    eligible = (d > cut) | ((d == cut) if tie_policy == "test" else F.lit(False))
    gone = ((d == cut) if tie_policy == "discard" else F.lit(False)) | (eligible & (d < end))
    part = F.when(trains, "train").when(gone, "discard").otherwise("test")
    rows = rows.withColumn("p", part)
    if valid_cut_date is not None:
        part = F.when((F.col("p") == "train") & (d >= F.lit(valid_cut_date).cast("date")), "valid").otherwise(F.col("p"))
        return rows.select("id", part.alias("partition"))
    if resolved.valid:
        # The latest of the train rows; of one day, those with the smallest ids.
        back = value_rank(rows.where("p = 'train'"), day, "id", descending=True).select("id", "pos")
        rows = rows.join(back, "id", "left").withColumn("p", F.when(F.col("pos") < resolved.valid, "valid").otherwise(F.col("p")))
    return rows.select("id", F.col("p").alias("partition"))


def deposition_date(df: DataFrame, id_col: str, date: str, cut_date, edges: DataFrame | None = None) -> DataFrame:
    """``id, partition``: up to the cut trains, after it tests; train records with an edge to a test record are pruned.

    ``edges``: the pairs above the similarity or identity ceiling; sizes follow the date.
    """
    rows = Scratch(df.sparkSession, "deposited").keep(_dated(df, id_col, date).select("id", F.when(F.col("d") <= F.lit(cut_date).cast("date"), "train").otherwise("test").alias("partition")))
    if edges is None:
        return rows
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = lambda p, c: rows.where(F.col("partition") == p).select(F.col("id").alias(c))
    gone = both.join(side("train", "a"), "a", "left_semi").join(side("test", "b"), "b", "left_semi").select(F.col("a").alias("id")).distinct()
    out = rows.join(gone.withColumn("gone", F.lit(True)), "id", "left")
    return out.select("id", F.when(F.col("gone"), "discard").otherwise(F.col("partition")).alias("partition"))


def temporal_windows(df: DataFrame, id_col: str, date: str, mode: str = "rolling", n_windows: int = 5, window="365D") -> DataFrame:
    """``id, window, partition``: back-to-back test windows that end at the last date; others of a window are discarded."""
    if mode not in ("rolling", "expanding"):
        raise ConfigurationError(f"unknown mode {mode!r}")
    rows, days = _dated(df, id_col, date), offset_days(window)
    last = rows.agg(F.max("d")).first()[0]
    w = F.col("window")
    rows = rows.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))))
    start = F.date_sub(F.lit(last), (F.lit(n_windows) - w) * days)
    end = F.date_sub(F.lit(last), (F.lit(n_windows) - w - 1) * days)
    d = F.col("d")
    tests = (d >= start) & ((d < end) | ((w == n_windows - 1) & (d <= end)))
    trains = (d < start) & (d >= F.date_sub(start, days) if mode == "rolling" else F.lit(True))
    rows = rows.select("id", "window", F.when(tests, "test").when(trains, "train").otherwise("discard").alias("partition"))
    full = rows.where("partition <> 'discard'").groupBy("window").agg(F.count_distinct("partition").alias("k")).where("k = 2").select("window")
    if not full.take(1):
        raise EmptyPartitionError("no window has both train and test records")
    return rows.join(F.broadcast(full), "window", "left_semi").select("id", "window", "partition")


def source_key(*columns: str) -> Column:
    """Provenance, a level or a hierarchy of them; missing ones are one source."""
    return F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns])


def source_split(df: DataFrame, id_col: str, *columns: str, min_source_size: int = 1, small_source_policy: str = "own_group", mode: str = "greedy_desc", **sizes) -> DataFrame:
    """``id, partition, group``: sources are never split."""
    if small_source_policy not in ("own_group", "pool", "discard"):
        raise ConfigurationError(f"unknown policy {small_source_policy!r}")
    if df.where(F.col(columns[0]).isNull()).take(1):
        warnings.warn(MissingSourceWarning("some records have no source"), stacklevel=2)
    rows = df.select(F.col(id_col).alias("id"), source_key(*columns).alias("key"))
    if min_source_size > 1 and small_source_policy != "own_group":
        counts = rows.groupBy("key").count()
        rows = rows.join(counts, "key")
        small = F.col("count") < min_source_size
        if small_source_policy == "pool":
            rows = rows.withColumn("key", F.when(small, "__POOLED__").otherwise(F.col("key")))
        else:
            kept = assign_groups(rows.where(~small), "id", F.col("key"), mode, **sizes)
            gone = rows.where(small).select("id", F.lit("discard").alias("partition"), F.lit(None).cast("long").alias("group"))
            return kept.unionByName(gone)
    return assign_groups(rows, "id", F.col("key"), mode, **sizes)


def fidelity_split(df: DataFrame, id_col: str, fidelity: str, structure: str, levels: list[str], structure_leakage: str = "discard", **sizes) -> DataFrame:
    """``id, partition``: the highest levels test, the next ones validate, the lowest trains.

    ``levels`` go from lowest to highest.  A train record whose structure is held
    out, and a valid one whose structure is tested, is discarded.
    """
    rows = Scratch(df.sparkSession, "fidelity").keep(df.select(F.col(id_col).alias("id"), F.col(fidelity).alias("level"), F.col(structure).alias("s")))
    resolved = resolve_sizes(rows.count(), **sizes)
    counts = {r.level: r["count"] for r in rows.where(F.col("level").isin(levels)).groupBy("level").count().collect()}
    place, filled = {}, {"test": 0, "valid": 0}
    present = [x for x in levels if counts.get(x)]
    for level in reversed(present[1:]):
        if filled["test"] < resolved.test or not filled["test"]:
            place[level] = "test"
        elif filled["valid"] < resolved.valid:
            place[level] = "valid"
        else:
            place[level] = "train"
            continue
        filled[place[level]] += counts[level]
    if not present:
        raise EmptyPartitionError("no record has one of the levels")
    place[present[0]] = "train"
    part = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])[F.col("level")]
    rows = rows.withColumn("p", F.coalesce(part, F.lit("discard")))
    if structure_leakage != "discard":
        return rows.select("id", F.col("p").alias("partition"))
    held = rows.where("p in ('valid', 'test')").groupBy("s").agg(F.max(F.when(F.col("p") == "test", 2).otherwise(1)).alias("held"))
    rows = rows.join(held, "s", "left")
    leak = ((F.col("p") == "train") & (F.col("held") >= 1)) | ((F.col("p") == "valid") & (F.col("held") == 2))
    return rows.select("id", F.when(F.coalesce(leak, F.lit(False)), "discard").otherwise(F.col("p")).alias("partition"))


def party_split(df: DataFrame, id_col: str, party: str) -> DataFrame:
    """``id, held_out, partition``: each party is held out in turn."""
    rows = df.select(F.col(id_col).alias("id"), F.col(party).cast("string").alias("party"))
    parties = rows.select(F.col("party").alias("held_out")).distinct()
    # Every record is there once for each party, so these are few.
    if parties.limit(MAX_PARTIES + 1).count() > MAX_PARTIES:
        raise ScalabilityError(f"more than {MAX_PARTIES} parties")
    out = rows.crossJoin(F.broadcast(parties))
    return out.select("id", "held_out", F.when(F.col("party").eqNullSafe(F.col("held_out")), "test").otherwise("train").alias("partition"))


def synthetic_parties(df: DataFrame, id_col: str, n_parties: int, level: str | None = None, alpha: float = 0.5, seed: int = 0) -> DataFrame:
    """``id, party``: every level of a label or cluster is dealt to parties in shares of its own Dirichlet draw.

    Without ``level`` all records share one draw.  A smaller ``alpha`` makes
    parties less alike.  Draws are repeated, ten times at most, until no party is empty.
    """
    if n_parties < 2 or alpha <= 0:
        raise ConfigurationError("two parties or more, and a positive alpha")
    key = F.lit("") if level is None else F.coalesce(F.col(level).cast("string"), F.lit(MISSING))
    scratch = Scratch(df.sparkSession, "parties")
    rows = scratch.keep(df.select(F.col(id_col).alias("id"), key.alias("level")))
    for attempt in range(10):

        def draw(batches, attempt=attempt):
            for pdf in batches:
                rng = [np.random.default_rng([seed, attempt, zlib.crc32(x.encode())]) for x in pdf["level"]]
                yield pd.DataFrame({"level": pdf["level"], "upto": [np.cumsum(r.dirichlet(np.full(n_parties, alpha)))[:-1] for r in rng]})

        shares = rows.select("level").distinct().mapInPandas(draw, "level string, upto array<double>")
        u = uniform(seed, "party.dirichlet", attempt, "id")
        dealt = rows.join(shares, "level").withColumn("u", u)
        out = scratch.keep(dealt.select("id", F.size(F.filter("upto", lambda x: x <= F.col("u"))).alias("party")))
        if out.agg(F.count_distinct("party")).first()[0] == n_parties:
            return out
        scratch.drop(out)
    raise EmptyPartitionError(f"no draw gave {n_parties} parties a record each")
