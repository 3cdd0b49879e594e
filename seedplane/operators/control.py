"""Control-plane rules as column expressions and frames: lease terms, sweeps, job progress, upserts, names."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phases of a job and their shares of its progress.
PHASES = [("QUEUED", 0), ("INTROSPECTING", 6), ("PLANNING", 4), ("PROVISIONING", 12), ("APPLYING_DDL", 8), ("GENERATING", 30), ("SEEDING", 26), ("VERIFYING", 6), ("SNAPSHOTTING", 5), ("LEASING", 3), ("DONE", 0)]
MOST_RENEWALS = 6


@dataclass(frozen=True)
class Terms:
    default: timedelta = timedelta(hours=4)
    longest: timedelta = timedelta(hours=24)
    renewal: timedelta = timedelta(hours=4)

    def granted(self, minutes: Column) -> Column:
        """Minutes that a request for so many gets: the default for none, the longest at most."""
        default, longest = (int(t.total_seconds() // 60) for t in (self.default, self.longest))
        return F.when(minutes.isNull() | (minutes <= 0), F.lit(default)).otherwise(F.least(minutes, F.lit(longest)))

    def renewed(self, issued: Column, expires: Column) -> Column:
        """The new expiry: renewals never carry a lease past its longest life plus one renewal."""
        step, ceiling = F.expr(f"interval {int(self.renewal.total_seconds())} seconds"), F.expr(f"interval {int((self.longest + self.renewal).total_seconds())} seconds")
        return F.least(expires + step, issued + ceiling)


def may_renew(state: Column, renewals: Column) -> Column:
    return (state == "ACTIVE") & (renewals < MOST_RENEWALS)


def reapable(leases: DataFrame, cutoff: Column, limit: int = 50) -> DataFrame:
    """Active leases that expired before cutoff, the oldest first."""
    return leases.filter((F.col("state") == "ACTIVE") & (F.col("expires_at") < cutoff)).orderBy("expires_at", "lease_id").limit(limit)


def orphaned(found: DataFrame, accounted: DataFrame, name: str, seen: str, before: Column) -> DataFrame:
    """What exists, is in no lease, and was first seen long enough ago."""
    return found.join(accounted.select(name).distinct(), name, "left_anti").filter(F.col(seen) <= before)


def closed(leases: DataFrame, ids: DataFrame, state: str) -> DataFrame:
    """Compare and swap: only leases that are still active change their state."""
    hit = ids.select("lease_id", F.lit(True).alias("__hit")).distinct()
    return leases.join(hit, "lease_id", "left").withColumn("state", F.when(F.col("__hit") & (F.col("state") == "ACTIVE"), F.lit(state)).otherwise(F.col("state"))).drop("__hit")


def overall_percent(phase: Column, fraction: Column) -> Column:
    """Progress of a whole job from its phase and the share of that phase that is done."""
    total, done = sum(w for _, w in PHASES), 0
    out = F.lit(None).cast("int")
    for name, weight in PHASES:
        part = (F.lit(done) + weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction))) * 100 / total
        out = F.when(phase == name, F.floor(F.least(F.lit(100.0), part) + 0.5).cast("int")).otherwise(out)
        done += weight
    return out


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: the new one where there is one."""
    columns = [c for c in old.columns if c not in key]
    renamed = new.select(*key, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in columns])
    return old.join(renamed, key, "full_outer").select(*key, *[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def inserted_if_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def slug(name: Column, joiner: str, most: int, default: str) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", joiner), f"^{joiner}+|{joiner}+$", "")
    return F.when(name.isNull() | (plain == ""), F.lit(default)).otherwise(F.substring(plain, 1, most))


def file_name(path: Column, default: str = "snapshot.zip") -> Column:
    """The last part of a path, so that a name can't leave its folder."""
    base = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.when(F.trim(base) == "", F.lit(default)).otherwise(base)
