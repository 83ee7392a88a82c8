"""One saved search over the corpus: pages, set-aside list, facets and funnel."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import GUESSED_ONSITE
from ..functions.scalar import age_days
from ..functions.text import fold, let, term_hits
from ..operators import criteria, facets as facet_ops, rank, textindex
from ..session import materialize
from .profile import normalize_profile

col = F.col


def search_view(postings: DataFrame, companies: DataFrame | None = None, as_of=None) -> DataFrame:
    """Derived postings in the shape criteria read.

    Age is computed from ``posted_at`` at query time, so it never goes stale.
    Open roles are counted per company slug and joined back; the counts are one
    row per company and Spark broadcasts them when they are small.
    """
    roles = facet_ops.open_roles(postings)
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    df = postings.join(roles, "company_slug", "left")
    if companies is not None:
        sector = companies.where(col("sector").isNotNull()).select(col("id").alias("company_id"), "sector")
        df = df.withColumn("company_id", F.concat_ws(":", "ats", "company_slug")).join(sector, "company_id", "left")
    else:
        df = df.withColumn("sector", F.lit(None).cast("string"))
    count = F.coalesce("open_roles", F.lit(1))
    empty = F.array().cast("array<string>")
    return df.select(
        "id", "ats", col("is_open").alias("listed"), "title", "title_norm", fold(col("title")).alias("title_folded"),
        "company_name", "company_slug", facet_ops.company_size_band(count).alias("company_size"),
        count.alias("company_open_roles"), "sector", "department", "employment_type",
        col("d_workplace").alias("workplace"), F.coalesce(col("d_workplace_src") == GUESSED_ONSITE, F.lit(False)).alias("workplace_guessed"),
        col("d_remote_scope").alias("remote_scope"), F.coalesce("d_metros", empty).alias("metros"),
        F.coalesce("d_countries", empty).alias("countries"), col("d_salary_min").alias("salary_min"),
        col("d_salary_max").alias("salary_max"), F.coalesce("d_salary_known", F.lit(False)).alias("salary_known"),
        col("d_salary_src").alias("salary_src"), col("comp_interval").alias("pay_period"), col("comp_currency").alias("currency"),
        col("has_equity").alias("equity"), col("d_min_years").alias("min_years"), col("d_max_years").alias("max_years"),
        F.coalesce("d_years_known", F.lit(False)).alias("years_known"), col("d_seniority").alias("seniority"),
        col("d_job_function").alias("job_function"), F.coalesce("d_skills", empty).alias("skills"), col("d_visa").alias("visa"),
        col("d_clearance").alias("clearance"), col("d_degree").alias("degree"), age_days(col("posted_at"), now).alias("age_days"),
        col("d_quality").alias("quality"), "posted_at", "first_seen", "last_seen",
    )


class Search:
    """One profile over one view. Each frame is built when asked for, from the view down.

    ``texts`` has id, title, company, body; ``index`` is its token table, optional;
    ``restrict_to``, ``hidden`` and ``applied`` have id.
    """

    def __init__(self, view: DataFrame, raw_profile: dict, *, texts: DataFrame | None = None, index: DataFrame | None = None,
                 restrict_to: DataFrame | None = None, hidden: DataFrame | None = None, applied: DataFrame | None = None,
                 limit: int | None = None, offset: int = 0, labels: DataFrame | None = None):
        self.view, self.texts, self.labels, self.offset = view, texts, labels, offset
        self.profile, self.warnings = normalize_profile(raw_profile)
        self.limit = self.profile["limit"] if limit is None else limit
        self.restrict_to, self.hidden, self.applied = restrict_to, hidden, applied
        p = self.profile
        self.keywords = criteria.searchable(p["description_keywords"])
        if len(self.keywords) < len(p["description_keywords"]):
            lost = [t for t in p["description_keywords"] if t not in self.keywords]
            self.warnings.append(f"description keywords: nothing to search for in {', '.join(lost)}; ignored")
        asks_text = p["text"] or self.keywords or p["exclude_description_keywords"]
        if asks_text and index is None and texts is None:
            raise ValueError("this profile searches text: pass texts or index")
        self.index = index

    def _matching(self, terms: list[str], mode: str) -> DataFrame:
        """Ids whose body holds the terms: from the index when there is one, else by a narrow scan of the texts."""
        if self.index is not None:
            return textindex.match_terms(self.index, terms, mode)
        return self.texts.where(textindex.match_terms_scan(col("body"), terms, mode)).select("id")

    @staticmethod
    def _flag(df: DataFrame, ids: DataFrame | None, name: str) -> DataFrame:
        if ids is None:
            return df.withColumn(name, F.lit(False))
        marked = ids.select("id").distinct().withColumn(name, F.lit(True))
        return df.join(marked, "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))

    @cached_property
    def _text_hits(self) -> DataFrame | None:
        """(id, text_field, text_spec) of the free-text search; its rarity comes from two one-row counts."""
        if not self.profile["text"]:
            return None
        words = self.profile["text"]
        hits = textindex.text_query(self.index, words) if self.index is not None else textindex.text_query_scan(self.texts, words)
        hits = materialize(hits, "hits")  # narrow; counted here and joined later
        corpus = self.view.agg(F.count(F.lit(1)).alias("corpus")).withColumn("_one", F.lit(1))
        matches = hits.agg(F.count(F.lit(1)).alias("matches")).withColumn("_one", F.lit(1))
        spec = corpus.join(F.broadcast(matches), "_one").select(
            "_one", rank.text_specificity(col("matches"), col("corpus")).alias("text_spec"))
        return hits.withColumn("_one", F.lit(1)).join(F.broadcast(spec), "_one").drop("_one")

    @cached_property
    def _excluded(self) -> DataFrame | None:
        terms = self.profile["exclude_description_keywords"]
        return self._matching(terms, "any") if terms else None

    @property
    def _missing(self) -> DataFrame:
        """Ids of postings without text: by the texts, else by the stored length, else those with no word of a body in the index."""
        if self.texts is not None:
            return textindex.missing_text(self.view, self.texts, "body")
        if "text_length" in self.view.columns:
            return self.view.where(F.coalesce("text_length", F.lit(0)) == 0).select("id")
        return self.view.select("id").join(self.index.where(col("field") == "body").select("id"), "id", "left_anti")

    def _index_hits(self, terms: list[str]) -> DataFrame:
        """(id, _hits): the keywords the index finds in a posting's body, in the profile's order."""
        each = [textindex.match_terms(self.index, [t], "any").withColumn("_t", F.lit(t)) for t in terms]
        found = reduce(DataFrame.unionByName, each).groupBy("id").agg(F.collect_set("_t").alias("_found"))
        return found.select("id", F.array_intersect(F.array(*[F.lit(t) for t in terms]), "_found").alias("_hits"))

    def _keyword_flags(self, df: DataFrame) -> DataFrame:
        """Adds text_missing, text_hit and description_hits where the profile has keywords."""
        if not self.keywords:
            return df
        none = F.array().cast("array<string>")
        if self.index is None:
            # One narrow scan folds each text once and says whether it is there, passes the gate, and holds which keywords.
            p, body = self.profile, F.coalesce(col("body"), F.lit(""))
            said = let(fold(body), lambda t: F.struct(textindex.holds_phrases(t, self.keywords, p["description_match"]).alias("hit"), term_hits(t, p["description_keywords"]).alias("hits")))
            found = self.texts.select("id", (body != "").alias("_has"), said.alias("_said"))
            joined = df.join(found, "id", "left")
            flags = {"text_hit": F.coalesce("_said.hit", F.lit(False)), "text_missing": ~F.coalesce("_has", F.lit(False)), "description_hits": F.coalesce("_said.hits", none)}
            return joined.withColumns(flags).drop("_has", "_said")
        gate = self._matching(self.keywords, self.profile["description_match"])
        flagged = self._flag(self._flag(df, gate, "text_hit"), self._missing, "text_missing")
        return flagged.join(self._index_hits(self.keywords), "id", "left").withColumn("description_hits", F.coalesce("_hits", none)).drop("_hits")

    @cached_property
    def gated(self) -> DataFrame:
        """Rows past the restriction, the text gates and the title gate."""
        df = self.view.where(criteria.title_gate(self.profile))
        if self.restrict_to is not None:
            df = df.join(self.restrict_to.select("id"), "id", "left_semi")
        if self._excluded is not None:
            df = df.join(self._excluded, "id", "left_anti")
        if self._text_hits is not None:
            df = df.join(self._text_hits, "id")
        return self._keyword_flags(df)

    @cached_property
    def visible(self) -> DataFrame:
        """Gated rows the user has neither hidden nor acted on."""
        df = self.gated
        for ids in (self.hidden, self.applied):
            if ids is not None:
                df = df.join(ids.select("id"), "id", "left_anti")
        return df

    def _ranked(self, bucket: str, k: int, offset: int) -> DataFrame:
        p = self.profile
        kept = criteria.keep_bucket(self.visible, p, bucket)
        scored = rank.score(kept, p)
        if p["collapse_duplicates"]:
            scored = rank.collapse_duplicates(scored, p["sort"])
        return rank.top_rows(scored, p["sort"], k, offset)

    @cached_property
    def results(self) -> DataFrame:
        return self._ranked("in", self.limit, self.offset)

    @cached_property
    def aside(self) -> DataFrame:
        return self._ranked("aside", self.limit, 0)

    @cached_property
    def facets(self) -> DataFrame:
        return facet_ops.facets(criteria.screen(self.visible, self.profile), self.profile, self.labels)

    @cached_property
    def flagged(self) -> DataFrame:
        """Every posting with its gates and marks as flags instead of filters."""
        df = self._keyword_flags(self.view)
        considered = F.lit(True)
        if self.restrict_to is not None:
            df, considered = self._flag(df, self.restrict_to, "_restricted"), considered & col("_restricted")
        if self._excluded is not None:
            df, considered = self._flag(df, self._excluded, "_excluded"), considered & ~col("_excluded")
        if self._text_hits is not None:
            df, considered = self._flag(df, self._text_hits, "_texted"), considered & col("_texted")
        df = df.withColumn("considered", considered).withColumn("titled", criteria.title_gate(self.profile))
        return self._flag(self._flag(criteria.screen(df, self.profile), self.hidden, "hidden"), self.applied, "applied")

    @cached_property
    def funnel(self) -> DataFrame:
        return facet_ops.funnel(self.flagged, self.profile)


def search(view: DataFrame, raw_profile: dict, **options) -> Search:
    """Run a profile: ``results``, ``aside``, ``facets`` and ``funnel`` of the returned search."""
    return Search(view, raw_profile, **options)
