"""Keyed lookups, upserts and latest-row choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")


def in_order(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows of the given ids in the order asked for. ids: key, position; what is missing is skipped."""
    return ids.join(rows, key).orderBy("position")


def two_key_match(new: DataFrame, old: DataFrame, first: str, second: str, id_: str) -> DataFrame:
    """new with found: the old row with the same first key, or else with the same second. Two equi-joins, no disjunction."""
    lookup = lambda key: old.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_).alias(f"by_{key}"))
    out = new.join(lookup(first), first, "left").join(lookup(second), second, "left")
    return out.withColumn("found", F.coalesce(f"by_{first}", f"by_{second}")).drop(f"by_{first}", f"by_{second}")


def latest_of(rows: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
    """One row per key, columns as they came: the greatest by a column, then by all of them in turn. Combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    first = [F.col(by).isNotNull().alias("__some"), F.col(by).alias("__by")] if by else []
    best = rows.groupBy(*keys).agg(F.max(F.struct(*first, *rest)).alias("__x"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__x.{c}").alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: list[str] = (), latest: list[str] = (), by: str | None = None) -> DataFrame:
    """Rows of both by key. keep_old: filled only where null; latest: advance only; other columns: the new value.

    Of rows of new with one key the latest_of them by a column counts, so a key has one row.
    """
    o = old.select(F.col(key), F.lit(True).alias("__old"), *[F.col(c).alias(f"__o_{c}") for c in old.columns if c != key])
    n = latest_of(new.select(*old.columns, *([by] if by and by not in old.columns else [])), [key], by)
    n = n.select(F.col(key), F.lit(True).alias("__new"), *[F.col(c).alias(f"__n_{c}") for c in old.columns if c != key])
    both = o.join(n, key, "full_outer")

    def value(c: str) -> Column:
        was, now = F.col(f"__o_{c}"), F.col(f"__n_{c}")
        if c in keep_old:
            return F.coalesce(was, now)
        if c in latest:
            return F.greatest(was, now)
        return F.when(F.col("__new"), now).otherwise(was)

    return both.select(key, *[value(c).alias(c) for c in old.columns if c != key], F.when(F.col("__old").isNull(), "inserted").when(F.col("__new"), "updated").otherwise("kept").alias("action"))


def split_valid(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejects with their reason."""
    marked = rows.withColumn("reject_reason", reason)
    return marked.filter("reject_reason IS NULL").drop("reject_reason"), marked.filter("reject_reason IS NOT NULL")


def cached_or_missing(jobs: DataFrame, cache: DataFrame, keys: list[str], versions: list[str], newest: list[str], stored: list[str] = ()) -> DataFrame:
    """jobs with hit, and the stored columns of the cache where it is one.

    Only the newest cached row of all the keys counts (by the columns of newest, then by all columns), and it is a hit if every
    version is equal, null-safely. A row of other keys, or an older one with the right versions, never is.
    """
    best = cache.groupBy(*keys).agg(F.max(F.struct(*newest, *versions, *stored)).alias("__x"))
    names = {c: f"__{c}" for c in keys}
    c = best.select(*[F.col(k).alias(names[k]) for k in keys], *[F.col(f"__x.{v}").alias(f"__{v}") for v in versions], F.struct(*[F.col(f"__x.{x}").alias(x) for x in stored]).alias("__stored") if stored else F.lit(True).alias("__stored"))
    on, same = F.lit(True), F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(names[k]))
    for v in versions:
        same = same & F.col(v).eqNullSafe(F.col(f"__{v}"))
    out = jobs.join(c, on, "left").withColumn("hit", F.coalesce(F.col("__stored").isNotNull() & same, F.lit(False)))
    return out.withColumns({x: F.when(F.col("hit"), F.col(f"__stored.{x}")) for x in stored}).drop("__stored", *names.values(), *[f"__{v}" for v in versions])


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_info(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def rank_order(score: str = "overall_score") -> list[Column]:
    """Score, quality, newest first, then id: a total order."""
    return [F.desc_nulls_last(score), F.desc_nulls_last("quality_score"), F.desc_nulls_last("posted_at"), F.asc("job_id")]


def backfill(rows: DataFrame, column: str, fresh: Column, unknown: str = "Unknown") -> DataFrame:
    """rows with the column recomputed where the new value is known and differs, and changed."""
    changed = F.coalesce(fresh != unknown, F.lit(False)) & ~fresh.eqNullSafe(F.col(column))
    return rows.withColumn("changed", changed).withColumn(column, F.when(F.col("changed"), fresh).otherwise(F.col(column)))


def fill_null(rows: DataFrame, found: DataFrame, key: str, columns: list[str], payload: str = "payload") -> DataFrame:
    """rows with null columns filled from found (one row per key at most), and all that was found as JSON under one name."""
    f = found.select(F.col(key).alias("__key"), F.struct(*columns).alias("__found"))
    out = rows.join(f, F.col(key) == F.col("__key"), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__found.{c}")) for c in columns} | {payload: F.to_json("__found")}).drop("__key", "__found")


def first_choice(rows: DataFrame, keys: list[str], value: str, *tests: Column) -> DataFrame:
    """keys and chosen: the largest value among rows that meet the first test that any row of the key meets, else of all."""
    return rows.groupBy(*keys).agg(F.coalesce(*[F.max(F.when(t, F.col(value))) for t in tests], F.max(value)).alias("chosen"))


def upsert_two_keys(old: DataFrame, new: DataFrame, first: str, second: str, id_: str, fill: list[str], replace: list[str], newest: str, with_newest: list[str]) -> DataFrame:
    """old brought up to date by new, matched on the first key or else the second.

    fill: set only where null; replace: the latest that is not null; newest advances only, and with_newest follow it; on a
    hit the row is active. Rows of new apply in the order of their id. Unmatched ones are inserted, one per first key.
    """
    found = two_key_match(new, old, first, second, id_)
    some = lambda c: F.when(F.col(c).isNotNull(), F.col(id_))
    last = F.when(F.col(newest).isNotNull(), F.struct(F.col(newest), -F.col(id_)))
    told = found.filter("found IS NOT NULL").groupBy("found").agg(
        *[F.min_by(c, some(c)).alias(f"__{c}") for c in fill],
        *[F.max_by(c, some(c)).alias(f"__{c}") for c in replace],
        *[F.max_by(c, last).alias(f"__{c}") for c in (newest, *with_newest)],
    )
    both = old.join(told, F.col(id_) == F.col("found"), "left")
    later = F.coalesce(F.col(f"__{newest}") > F.col(newest), F.col(f"__{newest}").isNotNull() & F.col(newest).isNull())

    def value(c: str) -> Column:
        if c in fill:
            return F.coalesce(c, f"__{c}")
        if c in replace:
            return F.coalesce(f"__{c}", c)
        if c == newest or c in with_newest:
            return F.when(later, F.col(f"__{c}")).otherwise(F.col(c))
        if c == "is_active":
            return F.col(c) | F.col("found").isNotNull()
        return F.col(c)

    kept = both.select(*[value(c).alias(c) for c in old.columns], F.when(F.col("found").isNotNull(), "updated").otherwise("kept").alias("action"))
    fresh = best_per(found.filter("found IS NULL"), [first], F.asc(id_))
    return kept.unionByName(fresh.select(*old.columns, F.lit("inserted").alias("action")))


def get_or_create(known: DataFrame, names: DataFrame, name: str, logo: str) -> DataFrame:
    """known (normalized_name, name, logo) with missing logos filled and unknown names added, from names."""
    low = names.filter(F.col(name).isNotNull()).groupBy(F.lower(name).alias("normalized_name")).agg(F.min(name).alias("__name"), F.min(logo).alias("__logo"))
    both = known.join(low, "normalized_name", "full_outer")
    return both.select("normalized_name", F.coalesce("name", "__name").alias("name"), F.coalesce("logo", "__logo").alias("logo"), F.col("name").isNull().alias("created"))


def active_latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """rows with is_active: only the first of each key in the order."""
    return rows.withColumn("is_active", F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1)


def status_upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str, allowed: list[str], gone: str | None = None) -> DataFrame:
    """keys, status: the stored status, replaced by the latest allowed one of new; a key whose status becomes ``gone`` is deleted."""
    valid = best_per(new.filter(F.col("status").isin(allowed)), keys, F.desc(at)).select(*keys, F.col("status").alias("told"))
    both = old.select(*keys, "status").join(valid, keys, "full_outer").select(*keys, F.coalesce("told", "status").alias("status"))
    return both.filter(F.col("status") != gone) if gone else both


def bounded(limit: int | None, default: int, most: int) -> int:
    """A row limit within 1 and most."""
    return max(1, min(most, default if limit is None else limit))
