"""Landed board payloads of four applicant tracking systems to snapshot rows.

Each reader takes a frame (slug, body) of raw JSON, one row per board and page,
parses it with an explicit schema, explodes the postings and maps them with
column expressions: a narrow job, parallel over files, with no shuffle except
Workday's join of details.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.text import decode_entities, html_to_text, let, norm_text, trim_space, trimmed
from ..schemas import SNAPSHOT, columns

col = F.col
POSTAL = "struct<addressLocality:string,addressRegion:string,addressCountry:string,postalCode:string>"
ASHBY = (
    "struct<name:string,jobs:array<struct<id:string,jobId:string,title:string,department:string,team:string,employmentType:string,"
    f"location:string,secondaryLocations:array<struct<location:string,address:struct<postalAddress:{POSTAL}>>>,"
    f"address:struct<postalAddress:{POSTAL}>,jobUrl:string,applyUrl:string,publishedAt:string,workplaceType:string,isRemote:boolean,"
    "compensation:struct<compensationTierSummary:string,summaryComponents:array<struct<compensationType:string,minValue:double,"
    "maxValue:double,currencyCode:string,interval:string>>>,compensationTierSummary:string,descriptionPlain:string>>>"
)
GREENHOUSE = (
    "struct<jobs:array<struct<id:string,title:string,company_name:string,departments:array<struct<name:string>>,"
    "offices:array<struct<name:string,location:string>>,location:struct<name:string>,first_published:string,updated_at:string,"
    "absolute_url:string,pay_input_ranges:array<struct<title:string,min_cents:double,max_cents:double,currency_type:string>>,content:string>>>"
)
LEVER = (
    "array<struct<id:string,text:string,categories:struct<commitment:string,department:string,team:string,location:string,"
    "allLocations:array<string>>,country:string,workplaceType:string,createdAt:bigint,hostedUrl:string,applyUrl:string,description:string,"
    "lists:array<struct<text:string,content:string>>,additional:string,salaryRange:struct<min:double,max:double,currency:string,interval:string>,"
    "salaryDescriptionPlain:string,salaryDescription:string>>"
)
WORKDAY_LISTING = "struct<total:bigint,jobPostings:array<struct<title:string,externalPath:string,locationsText:string,postedOn:string>>>"
WORKDAY_DETAIL = (
    "struct<jobPostingInfo:struct<title:string,jobDescription:string,location:string,additionalLocations:array<string>,startDate:string,"
    "timeType:string,remoteType:string,externalUrl:string,country:struct<descriptor:string>,"
    "jobRequisitionLocation:struct<country:struct<descriptor:string>>>>"
)
# Pay-range titles that are not salary, are on-target figures, or are hourly; Workday's page limits.
NOT_SALARY = "(?i)\\b(?:bonus|equity|commission|sign[-\\s]?on|signing|relocation|stipend|rsu|stock)\\b"
ON_TARGET = "(?i)\\b(?:ote|on[-\\s]?target)\\b"
HOURLY = "(?i)\\b(?:hour|hourly|per\\s?hr|/hr)\\b"
PAGE_SIZE, MAX_PAGES = 20, 100


def snapshot_rows(df: DataFrame, ats: str, made: dict[str, Column]) -> DataFrame:
    """Complete mapped columns to the snapshot schema; rows without id or title are dropped."""
    made = {"ats": F.lit(ats), "company_slug": col("slug"), "has_text": F.lit(True), "has_place": F.lit(True), **made}
    native, title = made["native_id"], trim_space(made["title"])
    made["id"] = S.job_id(F.lit(ats), col("slug"), native)
    made["title"], made["title_norm"] = title, norm_text(title)
    types = dict(zip(columns(SNAPSHOT), (f.dataType for f in _schema(df).fields)))
    keep = native.isNotNull() & (native != "") & (native != "undefined") & title.isNotNull() & (title != "")
    return df.where(keep).select(*[
        made.get(c, F.lit(None)).cast(types[c]).alias(c) for c in columns(SNAPSHOT)])


def _schema(df: DataFrame):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SNAPSHOT)


def _first(items: Column, test=None) -> Column:
    return F.try_element_at(F.filter(items, test) if test else items, F.lit(1))


def _array(c: Column, kind: str = "string") -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def postal_text(p: Column) -> Column:
    parts = F.array(*[F.nullif(p[k], F.lit("")) for k in ("addressLocality", "addressRegion", "addressCountry")])
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), ", ")


def ashby_salary(components: Column) -> Column:
    """First salary component with a figure; a missing top equals the bottom."""
    part = _first(components, lambda c: (c["compensationType"] == "Salary") & (
        S.positive(c["minValue"]).isNotNull() | S.positive(c["maxValue"]).isNotNull()))
    low, high = S.positive(part["minValue"]), S.positive(part["maxValue"])
    return F.when(part.isNotNull(), F.struct(
        low.alias("min"), F.coalesce(high, low).alias("max"), part["currencyCode"].alias("currency"),
        S.pay_interval_words(part["interval"]).alias("interval")))


def has_equity(components: Column) -> Column:
    """True when some component is equity, NULL otherwise: silence is not a no."""
    return F.when(F.exists(components, lambda c: c["compensationType"].isin("EquityPercentage", "Equity")), True)


def ashby_postings(payloads: DataFrame) -> DataFrame:
    df = payloads.withColumn("b", F.from_json("body", ASHBY))
    df = df.select("slug", col("b.name").alias("board_name"), F.explode("b.jobs").alias("j"))
    postal = col("j.address.postalAddress")
    secondary = F.transform("j.secondaryLocations", lambda s: F.when(
        F.coalesce(s["location"], F.lit("")) != "", s["location"]).otherwise(postal_text(s["address"]["postalAddress"])))
    places = F.array_distinct(F.filter(
        F.concat(F.array(col("j.location")), _array(secondary), F.array(F.when(postal.isNotNull(), postal_text(postal)))),
        lambda p: p.isNotNull() & (p != "")))
    df = df.withColumn("_pay", ashby_salary(col("j.compensation.summaryComponents")))
    board = F.concat(F.lit("https://jobs.ashbyhq.com/"), F.url_encode("slug"))
    return snapshot_rows(df, "ashby", {
        "company_name": col("board_name"), "native_id": F.coalesce("j.id", "j.jobId"), "title": col("j.title"),
        "department": col("j.department"), "team": col("j.team"), "employment_type": col("j.employmentType"),
        "location_raw": col("j.location"), "locations_all": places, "city": trimmed(postal["addressLocality"]),
        "region": trimmed(postal["addressRegion"]), "country": trimmed(postal["addressCountry"]),
        "postal_code": trimmed(postal["postalCode"]), "posted_at": S.to_epoch(col("j.publishedAt")),
        "url": F.coalesce("j.jobUrl", board), "apply_url": F.coalesce("j.applyUrl", "j.jobUrl"),
        "raw_workplace": col("j.workplaceType"), "raw_remote": col("j.isRemote"), "comp_min": col("_pay.min"), "comp_max": col("_pay.max"),
        "comp_currency": col("_pay.currency"), "comp_interval": col("_pay.interval"),
        "comp_text": F.coalesce("j.compensationTierSummary", "j.compensation.compensationTierSummary"),
        "has_equity": has_equity(col("j.compensation.summaryComponents")), "description_text": col("j.descriptionPlain"),
    })


def greenhouse_salary(ranges: Column) -> Column:
    """First usable range that is not an on-target figure, else the first usable one; cents to units."""
    def low(r):
        return S.positive(r["min_cents"]) / 100

    def high(r):
        return S.positive(r["max_cents"]) / 100

    def title(r):
        return F.coalesce(r["title"], F.lit(""))

    usable = F.filter(ranges, lambda r: ~title(r).rlike(NOT_SALARY) & (low(r).isNotNull() | high(r).isNotNull()))
    best = F.coalesce(_first(usable, lambda r: ~title(r).rlike(ON_TARGET)), _first(usable))
    return let(best, lambda r: F.when(r.isNotNull(), F.struct(
        low(r).alias("min"), F.coalesce(high(r), low(r)).alias("max"), F.upper(F.coalesce(r["currency_type"], F.lit("USD"))).alias("currency"),
        F.when(title(r).rlike(HOURLY), "HOUR").otherwise("YEAR").alias("interval"), trimmed(r["title"]).alias("text"))))


def greenhouse_postings(payloads: DataFrame) -> DataFrame:
    df = payloads.withColumn("b", F.from_json("body", GREENHOUSE))
    name = _first(col("b.jobs"), lambda j: F.coalesce(j["company_name"], F.lit("")) != "")["company_name"]
    df = df.withColumn("board_name", name).select("slug", "board_name", F.explode("b.jobs").alias("j"))
    offices = F.flatten(F.transform("j.offices", lambda o: F.array(o["name"], o["location"])))
    department = _first(F.transform("j.departments", lambda d: trimmed(d["name"])), lambda n: n.isNotNull())
    df = df.withColumn("_pay", greenhouse_salary(col("j.pay_input_ranges")))
    board = F.concat(F.lit("https://job-boards.greenhouse.io/"), F.url_encode("slug"))
    # The content is escaped once on top of its own entities: decode once, then read as markup.
    text = let(F.coalesce("j.content", F.lit("")), lambda c: html_to_text(decode_entities(c)))
    return snapshot_rows(df, "greenhouse", {
        "company_name": F.coalesce("j.company_name", "board_name"), "native_id": col("j.id"), "title": col("j.title"),
        "department": department, "location_raw": trimmed(col("j.location.name")),
        "locations_all": S.distinct_places(F.array(col("j.location.name")), _array(offices)),
        "posted_at": F.coalesce(S.to_epoch(col("j.first_published")), S.to_epoch(col("j.updated_at"))),
        "source_updated_at": S.to_epoch(col("j.updated_at")), "url": F.coalesce("j.absolute_url", board),
        "apply_url": F.coalesce(col("j.absolute_url"), F.concat(board, F.lit("/jobs/"), col("j.id"))),
        "comp_min": col("_pay.min"), "comp_max": col("_pay.max"), "comp_currency": col("_pay.currency"),
        "comp_interval": col("_pay.interval"), "comp_text": col("_pay.text"), "description_text": F.nullif(text, F.lit("")),
    })


def lever_html(j: Column) -> Column:
    """Opening, each titled list, closing, in page order."""
    def piece(entry: Column) -> Column:
        head, body = trimmed(entry["text"]), trimmed(entry["content"])
        return F.nullif(F.concat(
            F.coalesce(F.concat(F.lit("<h3>"), head, F.lit("</h3>")), F.lit("")),
            F.coalesce(F.concat(F.lit("<ul>"), body, F.lit("</ul>")), F.lit(""))), F.lit(""))

    parts = F.concat(F.array(trimmed(j["description"])), _array(F.transform(j["lists"], piece)), F.array(trimmed(j["additional"])))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n")


def lever_postings(payloads: DataFrame) -> DataFrame:
    df = payloads.select("slug", F.explode(F.from_json("body", LEVER)).alias("j"))
    c = col("j.categories")
    low, high = S.positive(col("j.salaryRange.min")), S.positive(col("j.salaryRange.max"))
    paid = low.isNotNull() | high.isNotNull()
    place = F.lower(trimmed(col("j.workplaceType")))
    url = F.coalesce(col("j.hostedUrl"), F.concat(F.lit("https://jobs.lever.co/"), F.url_encode("slug"), F.lit("/"), col("j.id")))
    return snapshot_rows(df, "lever", {
        "native_id": col("j.id"), "title": col("j.text"), "department": trimmed(c["department"]), "team": trimmed(c["team"]),
        "employment_type": S.employment_type_from_commitment(c["commitment"]), "location_raw": trimmed(c["location"]),
        "locations_all": S.distinct_places(F.array(c["location"]), _array(c["allLocations"])),
        "country": S.country_name(col("j.country")), "raw_workplace": F.when(place.isin("onsite", "hybrid", "remote"), place),
        "posted_at": F.timestamp_millis("j.createdAt"), "url": url, "apply_url": F.coalesce(col("j.applyUrl"), F.concat(url, F.lit("/apply"))),
        "comp_min": low, "comp_max": F.coalesce(high, low), "comp_currency": F.when(paid, F.upper(F.coalesce("j.salaryRange.currency", F.lit("USD")))),
        "comp_interval": F.when(paid, S.pay_interval_code(col("j.salaryRange.interval"))),
        "comp_text": F.coalesce(trimmed(col("j.salaryDescriptionPlain")), trimmed(col("j.salaryDescription"))),
        "description_text": F.nullif(let(lever_html(col("j")), html_to_text), F.lit("")),
    })


def workday_listing(pages: DataFrame) -> DataFrame:
    """(slug, page, row): listing rows, the first of each path on its board."""
    df = pages.select("slug", "page", F.posexplode(F.from_json("body", WORKDAY_LISTING)["jobPostings"]).alias("at", "row"))
    df = df.where(col("row.externalPath").isNotNull())
    return df.groupBy("slug", col("row.externalPath").alias("path")).agg(F.min_by("row", F.struct("page", "at")).alias("row"))


def workday_truncated(pages: DataFrame) -> DataFrame:
    """Boards that fill every page the source will give: partial, so they must not close postings. Of the listing rows only paths are read."""
    paths = F.from_json("body", "jobPostings array<struct<externalPath string>>")["jobPostings"]["externalPath"]
    counts = pages.select("slug", F.explode(F.array_distinct(paths)).alias("path")).groupBy("slug").agg(F.count_distinct("path").alias("n"))
    read = pages.groupBy("slug").agg(F.countDistinct("page").alias("pages"))
    return counts.join(read, "slug").where((col("pages") == MAX_PAGES) & (col("n") == MAX_PAGES * PAGE_SIZE)).select("slug")


def workday_postings(pages: DataFrame, details: DataFrame) -> DataFrame:
    """Listing rows with their details (slug, path, body) where one was fetched.

    Without a detail the text was not read (``has_text`` false), and without a
    real place the place was not (``has_place`` false).
    """
    listing = workday_listing(pages).join(workday_truncated(pages), "slug", "left_anti")
    d = details.select("slug", "path", F.from_json("body", WORKDAY_DETAIL)["jobPostingInfo"].alias("d"))
    df = listing.join(d, ["slug", "path"], "left")
    board = S.parse_board_slug(col("slug"))
    host = F.concat(F.lit("https://"), board["tenant"], F.lit("."), board["dc"], F.lit(".myworkdayjobs.com"))
    primary = F.coalesce(S.real_place(col("d.location")), S.real_place(col("row.locationsText")))
    extra = F.transform("d.additionalLocations", S.real_place)
    url = F.coalesce(col("d.externalUrl"), F.concat(host, F.lit("/"), board["site"], col("path")))
    return snapshot_rows(df, "workday", {
        "native_id": S.native_id_from_path(col("path")), "title": F.coalesce("d.title", "row.title"), "location_raw": primary,
        "locations_all": S.distinct_places(F.array(primary), F.array(S.real_place(col("row.locationsText"))), _array(extra)),
        "country": trimmed(F.coalesce("d.country.descriptor", "d.jobRequisitionLocation.country.descriptor")),
        "employment_type": S.employment_type_from_time_type(col("d.timeType")), "raw_workplace": col("d.remoteType"),
        "posted_at": S.to_epoch(col("d.startDate")), "url": url, "apply_url": url,
        "description_text": F.nullif(let(col("d.jobDescription"), html_to_text), F.lit("")),
        "has_text": col("d").isNotNull(), "has_place": primary.isNotNull(),
    })


def workday_board_names(details: DataFrame) -> DataFrame:
    """(slug, name): the first readable name in path order."""
    d = details.select("slug", "path", S.company_name_from_url(F.from_json("body", WORKDAY_DETAIL)["jobPostingInfo"]["externalUrl"]).alias("name"))
    return d.where(col("name").isNotNull()).groupBy("slug").agg(F.min_by("name", "path").alias("name"))
