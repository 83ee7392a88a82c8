"""The slug store: which boards exist, which source says so, and what probing found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

col = F.col
# Site names that say nothing about who owns them.
ANONYMOUS_SITES = [
    "external", "externalcareers", "external_careers", "external-careers", "careers", "career", "jobs", "job", "externalsite",
    "external_site", "externaljobs", "external_jobs", "campus", "internal", "corporate", "externalcareersite",
    "external_career_site", "externalcareer",
]
MAX_GUESSES = 5
KEY = ["ats", "slug"]
EMPTY = "array<string>"


def merge_slug_store(previous: DataFrame, observed: DataFrame, carried: DataFrame, now, incremental: list[str] = (),
                     prune_after_days: int | None = None) -> DataFrame:
    """Previous store and today's observations.

    A source's claim stands if the source was carried over (``carried``: ats,
    source), reads incrementally, or listed the slug again; ``last_seen`` moves
    while any claim stands. Slugs nobody claims stay, unless pruned by age.
    """
    now = F.lit(now).cast("timestamp")
    carry = carried.groupBy("ats").agg(F.collect_set("source").alias("_carried"))  # at most one entry per source
    prev = previous.join(F.broadcast(carry), "ats", "left").select(
        *KEY, F.struct("sources", "first_seen", "last_seen", F.coalesce("_carried", F.array().cast(EMPTY)).alias("carried")).alias("p"))
    j = prev.join(observed.select(*KEY, col("sources").alias("_obs")), KEY, "full_outer")
    seen = F.coalesce("_obs", F.array().cast(EMPTY))
    always = F.array(*[F.lit(s) for s in incremental]) if incremental else F.array().cast(EMPTY)
    kept = F.filter(F.coalesce("p.sources", F.array().cast(EMPTY)), lambda s: (
        F.array_contains(col("p.carried"), s) | F.array_contains(always, s) | F.array_contains(seen, s)))
    j = j.withColumn("sources", F.when(col("_obs").isNull(), kept).otherwise(F.array_sort(F.array_union(kept, seen))))
    j = j.select(*KEY, "sources", F.coalesce("p.first_seen", now).alias("first_seen"),
                 F.when(F.size("sources") > 0, now).otherwise(F.coalesce("p.last_seen", now)).alias("last_seen"))
    if prune_after_days is not None:
        stale = (F.size("sources") == 0) & (col("last_seen") < now - F.make_dt_interval(F.lit(prune_after_days)))
        j = j.where(~stale)
    return j


def unread_source_carry(enabled: DataFrame, read: DataFrame) -> DataFrame:
    """(ats, source) of enabled sources (source, ats) that were not read today."""
    return enabled.where(col("ats").isNotNull()).join(read.select("source").distinct(), "source", "left_anti").select("ats", "source").distinct()


def active(store: DataFrame) -> DataFrame:
    return store.where(F.size("sources") > 0)


def diff_slug_store(previous: DataFrame, following: DataFrame) -> DataFrame:
    """(ats, slug, change): slugs that became active or stopped being so."""
    before, after = active(previous).select(*KEY), active(following).select(*KEY)
    added = after.join(before, KEY, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(before.join(after, KEY, "left_anti").withColumn("change", F.lit("removed")))


def store_totals(store: DataFrame) -> DataFrame:
    return store.groupBy("ats").agg(F.count_if(F.size("sources") > 0).alias("active"), F.count(F.lit(1)).alias("total"))


def source_contribution(store: DataFrame) -> DataFrame:
    """Per source: slugs it lists, and those only it lists."""
    each = store.select("ats", F.explode("sources").alias("source"), (F.size("sources") == 1).alias("alone"))
    return each.groupBy("ats", "source").agg(F.count(F.lit(1)).alias("total"), F.count_if("alone").alias("unique"))


def merge_verdicts(verdicts: DataFrame, probed: DataFrame, now) -> DataFrame:
    """Probe results (ats, slug, status, error, and name fields when fetched) into the verdict table.

    An error keeps what was known and notes itself; a result replaces the status
    and clears the error. Names survive a probe that fetched none.
    """
    now = F.lit(now).cast("timestamp")
    names = ["name", "website", "careers_url", "allow_indexing", "hosted_disabled"]
    given = [c for c in names if c in probed.columns]
    p = probed.select(*KEY, F.struct("status", "error", *given).alias("p"))
    v = verdicts.select(*KEY, F.struct(*[c for c in verdicts.columns if c not in KEY]).alias("v"))
    j = v.join(p, KEY, "full_outer")
    error = F.coalesce(col("p.status") == "error", F.lit(False))
    result = col("p").isNotNull() & ~error
    fetched = F.lit(False)
    for c in given:
        fetched = fetched | col(f"p.{c}").isNotNull()
    out = {
        "status": F.when(result, col("p.status")).otherwise(col("v.status")),
        "checked_at": F.when(result, now).otherwise(col("v.checked_at")),
        "last_error": F.when(error, col("p.error")).when(~result, col("v.last_error")),
        "last_error_at": F.when(error, now).when(~result, col("v.last_error_at")),
    }
    for c in given:  # a fetched record replaces all name fields together
        out[c] = F.when(result & fetched, col(f"p.{c}")).otherwise(col(f"v.{c}"))
    return j.select(*KEY, *[out.get(c, col(f"v.{c}")).alias(c) for c in verdicts.columns if c not in KEY])


def unresolved_candidates(store: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Active slugs no probe has decided."""
    decided = verdicts.where(col("status").isNotNull()).select(*KEY)
    return active(store).select(*KEY).join(decided, KEY, "left_anti")


def source_quality(store: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per source: live, dead and unprobed slugs, slugs only it has that are not dead, and the dead share."""
    status = verdicts.select(*KEY, "status")
    rows = active(store).join(status, KEY, "left").select(
        "ats", F.explode("sources").alias("source"), (F.size("sources") == 1).alias("alone"), F.coalesce("status", F.lit("unprobed")).alias("status"))
    dead, live = col("status") == "dead", col("status") == "exists"
    out = rows.groupBy("ats", "source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(live).alias("live"), F.count_if(dead).alias("dead"),
        F.count_if(~live & ~dead).alias("unprobed"), F.count_if(col("alone") & ~dead).alias("only"))
    probed = col("live") + col("dead")
    return out.withColumn("dead_percent", F.when(probed > 0, F.floor(100.0 * col("dead") / probed + 0.5)))


def origin_coverage(store: DataFrame, verdicts: DataFrame, web_sources: list[str], neither: list[str] = ("manual",)) -> DataFrame:
    """Live slugs by kind of origin: all of each kind, those found nowhere else, and the union."""
    live = active(store).join(verdicts.where(col("status") == "exists").select(*KEY), KEY, "left_semi")
    web = F.exists("sources", lambda s: s.isin(list(web_sources)))
    repo = F.exists("sources", lambda s: ~s.isin([*web_sources, *neither]))
    return live.groupBy("ats").agg(
        F.count_if(repo).alias("repos"), F.count_if(repo & ~web).alias("repos_only"), F.count_if(web).alias("web"),
        F.count_if(web & ~repo).alias("web_only"), F.count_if(web | repo).alias("union"))


def tenant_guesses(site: Column) -> Column:
    """Up to five tenant names a careers-site name suggests, in order of promise."""
    tries = [
        site, F.regexp_replace(site, "(?i)[-_]?(external[-_]?)?careers?$", ""), F.regexp_replace(site, "(?i)^external[-_]?", ""),
        F.regexp_replace(F.regexp_replace(site, "(?i)^external[-_]?", ""), "(?i)[-_]?careers?$", ""),
        F.split(site, "[-_]")[0], F.regexp_replace(site, "[-_]", ""),
    ]
    clean = F.filter(F.transform(F.array(*tries), lambda t: F.lower(F.trim(t))), lambda t: F.length(t) > 1)
    return F.slice(F.array_distinct(clean), 1, MAX_GUESSES)


def repair_targets(store: DataFrame, attempts: DataFrame, retry_failed: bool = False) -> DataFrame:
    """(dc, site) of slugs whose tenant field holds the data centre, that are guessable and not settled."""
    parts = F.split("slug", "[|]")
    damaged = store.where((F.size(parts) == 3) & parts[0].rlike("(?i)^wd\\d+$")).select(F.lower(parts[0]).alias("dc"), F.lower(parts[2]).alias("site"))
    settled = attempts.where(col("verdict") == "live") if retry_failed else attempts
    key = F.concat_ws("|", "dc", F.lit("wd1"), "site").alias("slug")
    return damaged.where(~col("site").isin(ANONYMOUS_SITES)).select("dc", "site", key).join(
        settled.select("slug").distinct(), "slug", "left_anti").select("dc", "site").distinct()


def recover_tenants(targets: DataFrame, probes: DataFrame) -> DataFrame:
    """(slug, dc, site, tenant, rank): the earliest guess that a probe found live.

    ``probes`` has tenant, dc, site, live.
    """
    guesses = targets.select("dc", "site", F.posexplode(tenant_guesses(col("site"))).alias("at", "tenant"))
    hits = guesses.join(probes.where("live").select("tenant", "dc", "site").distinct(), ["tenant", "dc", "site"])
    best = hits.groupBy("dc", "site").agg(F.min_by("tenant", "at").alias("tenant"), (F.min("at") + 1).alias("rank"))
    return best.select(F.concat_ws("|", "tenant", "dc", "site").alias("slug"), "dc", "site", "tenant", "rank")


def hits_per_rank(recovered: DataFrame) -> DataFrame:
    return recovered.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
