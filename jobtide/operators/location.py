"""Free-text places to metros, countries and remote reach.

Postings repeat a small set of place strings, so each distinct string is read
once. Its word runs (n-grams) are exploded and joined to the gazetteer; the few
that hit come back as a small map beside the string, and the rules that weigh
them are array expressions over that map. A string that a third of all postings
share (``Remote``) is one row on the parsed side; its many rows on the posting
side are combined before the distinct and split by AQE in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gazetteer import DEFAULT, Gazetteer
from ..functions.text import fold, let, slugify_folded

# Separators, decorations and word lists of written places.
SEPARATORS = "\\s*(?:,|\\||/|;|>|:|·|•|\\bor\\b|\\band\\b|\\+)\\s*"
DECORATIONS = (
    "\\s*\\b(?:office|offices|hq|headquarters|based|based in|area|metro|metro area|metropolitan area|"
    "region|greater|downtown|city center|city centre|campus|site|location|onsite|on-site|in person|"
    "in-person|hybrid|flexible|preferred|optional|only|usa office)\\b\\s*"
)
REMOTE = (
    "\\b(?:remote|remotely|work from home|wfh|distributed|anywhere|virtual|telecommute|"
    "home[- ]based|fully remote)\\b"
)
STREET = (
    "\\b(?:floor|suite|road|street|avenue|boulevard|parkway|po box|plaza|ave|av|blvd|rd|pkwy|hwy|ln|"
    "dr|route|rue|calle|avenida|paseo|strasse|str)\\b"
)
NOT_A_PLACE = (
    "\\b(?:center|centre|tower|building|floor|suite|plaza|complex|road|street|avenue|boulevard|"
    "parkway|po box|department|division|team|remote|various|multiple|tbd|none|worldwide|global)\\b"
)
VENUE_WORDS = [
    "hotel", "motel", "resort", "casino", "hospital", "medical", "clinic", "health", "healthcare",
    "university", "college", "school", "academy", "campus", "institute", "laboratory", "lab", "inc",
    "llc", "corp", "ltd", "gmbh", "group", "holdings", "bank", "store", "shop", "branch",
    "warehouse", "plant", "factory", "depot", "terminal", "garage", "headquarters", "hq", "office",
    "facility", "center", "centre", "tower", "building", "bldg", "plaza", "complex", "department",
    "division", "team", "unit", "district", "region", "site",
]
NAME_PARTICLES = ["st", "mt", "ft"]
QUALIFIER_WORDS = 3
CITY_WORDS = 4
TITLE_DASHES = "\\s+-\\s*|\\s*-\\s+"
TITLE_CLAUSES = "\\s*(?:\\||/|;|>|:|·|•|\\bor\\b|\\band\\b|\\+)\\s*"
BARE_PLACE_CODES = ["us", "uk", "eu"]
TITLE_NOT_A_QUALIFIER = ["pe"]


def clean_component(c: Column) -> Column:
    c = F.regexp_replace(c, "\\.", "")
    c = F.regexp_replace(c, "^(?:in|at|near|from)\\s+", "")
    return F.trim(F.regexp_replace(c, "^[\\s'-]+|[\\s'-]+$", ""))


def plausible_city(c: Column) -> Column:
    """Could this component be a city nobody listed?"""
    return (
        F.length(c).between(3, 40)
        & ~c.rlike("\\d")
        & ~c.rlike("^(?:full|part)[- ]time$")
        & ~c.rlike(NOT_A_PLACE)
        & (F.size(F.split(c, " ")) <= 4)
        & c.rlike("[a-z]")
    )


def _first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def _present(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull())


def _words(c: Column) -> Column:
    return F.filter(F.split(c, "[-\\s]+"), lambda w: w != "")


def _text(words: Column, start: Column, count: Column) -> Column:
    """``count`` words from zero-based ``start`` as one string."""
    return F.array_join(F.slice(words, start + 1, count), " ")


def with_hits(df: DataFrame, key: str, parts: Column, places: Gazetteer) -> DataFrame:
    """Add ``hits``: token -> gazetteer row, for every word run of ``parts`` that is listed.

    ``key`` is unique. The explode and the join keep the partitioning by key, so
    a frame that comes out of ``distinct`` is grouped without another shuffle.
    """
    def runs(words: Column) -> Column:
        n = F.size(words)
        return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(places.max_words)), lambda k: F.when(
            k <= n, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: _text(words, i, k))
        ).otherwise(F.array().cast("array<string>"))))

    grams = F.array_distinct(F.flatten(F.transform(parts, lambda p: F.concat(runs(F.split(p, " ")), runs(_words(p))))))
    table = places.frame(df.sparkSession)
    row = F.struct(*[F.col(c) for c in ("country", "region", "metro", "listed", "supra")])
    hits = (
        df.select(key, F.explode_outer(grams).alias("token")).join(table, "token", "left")
        .groupBy(key).agg(F.map_from_entries(F.collect_list(
            F.when(F.col("supra").isNotNull(), F.struct("token", row)))).alias("hits"))
    )
    return df.join(hits, key)


METRO_TYPE = "struct<id:string,country:string,region:string>"


class _Reader:
    """Expression builders over one map of gazetteer hits.

    A metro is carried as struct(id, country, region); a qualifier, the state
    or country beside a city, as struct(token, region, country).
    """

    def __init__(self, hits: Column):
        self.hits = hits

    def row(self, token: Column) -> Column:
        return F.try_element_at(self.hits, token)

    def metro(self, token: Column) -> Column:
        return self.row(token)["metro"]

    def qualifier(self, token: Column) -> Column:
        return let(self.row(token), lambda r: F.when(
            r["region"].isNotNull() | r["country"].isNotNull(),
            F.struct(token.alias("token"), r["region"].alias("region"), r["country"].alias("country"))))

    @staticmethod
    def agrees(metro: Column, q: Column) -> Column:
        """Is the metro inside the qualifier's state or country?"""
        in_region = F.when(metro["region"].isNotNull(), metro["region"] == q["region"]["code"]).otherwise(
            metro["country"] == q["region"]["country"])
        same = [in_region, metro["country"] == q["country"], metro["country"] == q["token"]]
        return F.coalesce(same[0], F.lit(False)) | F.coalesce(same[1], F.lit(False)) | F.coalesce(same[2], F.lit(False))

    @staticmethod
    def listed_metro(row: Column, code: Column) -> Column:
        return _first(F.filter(row["listed"], lambda x: x["code"] == code))["metro"]

    def qualified_metro(self, city: Column, q: Column, inner=None) -> Column:
        """Metro of ``city`` given a qualifier that must vouch for it."""
        def weigh(r: Column) -> Column:
            plain = r["metro"] if inner is None else F.coalesce(r["metro"], inner(city))
            return F.coalesce(self.listed_metro(r, q["region"]["code"]), let(plain, lambda m: F.when(self.agrees(m, q), m)))
        return let(self.row(city), weigh)

    # -- glued components: `Dallas TX`, `us-ny-new-york` ----------------------

    def _split_qualifier(self, words: Column, inner) -> Column:
        """First of the six (end, length) splits whose qualifier vouches for the rest."""
        n = F.size(words)
        shapes = F.array(*[
            F.struct(F.lit(at_end).alias("at_end"), F.lit(take).alias("take"))
            for at_end in (True, False) for take in range(QUALIFIER_WORDS, 0, -1)
        ])

        def attempt(shape: Column) -> Column:
            take, rest = shape["take"], n - shape["take"]
            token = F.when(shape["at_end"], _text(words, rest, take)).otherwise(_text(words, F.lit(0), take))
            city = F.when(shape["at_end"], _text(words, F.lit(0), rest)).otherwise(_text(words, take, rest))
            return let(
                F.when(n > take, let(token, self.qualifier)),
                lambda q: F.when(q.isNotNull(), let(city, lambda c: self.qualified_metro(c, q, inner))),
            )

        return _first(_present(F.transform(shapes, attempt)))

    def glued_metro(self, part: Column, depth: int = 0) -> Column:
        inner = (lambda rest: self.glued_metro(rest, depth + 1)) if depth == 0 else None
        variants = F.array(F.split(part, " "), F.when(part.contains("-"), _words(part)))
        return _first(_present(F.transform(_present(variants), lambda w: self._split_qualifier(w, inner))))

    # -- embedded names: a city inside an office code -------------------------

    def hard_boundary(self, word: Column) -> Column:
        return ~word.isin(NAME_PARTICLES) & (word.rlike("\\d") | ~word.rlike("[aeiou]"))

    def opaque(self, word: Column) -> Column:
        """A word that cannot be part of a city's name."""
        known = let(self.row(word), lambda r: r["region"].isNotNull() | r["country"].isNotNull())
        return self.hard_boundary(word) | word.isin(VENUE_WORDS) | F.coalesce(known, F.lit(False))

    def qualifier_runs(self, words: Column) -> Column:
        """Maximal runs of qualifier words, left to right, longest reading first."""
        n = F.size(words)

        def reading(i: Column) -> Column:
            takes = F.array(*[F.lit(k) for k in range(QUALIFIER_WORDS, 0, -1)])
            return _first(_present(F.transform(takes, lambda take: F.when(
                i + take <= n, let(let(_text(words, i, take), self.qualifier), lambda q: F.when(q.isNotNull(), F.struct(
                    i.alias("start"), (i + take).alias("end"), q["token"].alias("token"),
                    q["region"].alias("region"), q["country"].alias("country"))))))))

        def absorb(runs: Column, found: Column) -> Column:
            last = _last(runs)
            newer = found["region"].isNotNull() | last["region"].isNull()
            joined = F.struct(
                last["start"].alias("start"), found["end"].alias("end"),
                F.when(newer, found["token"]).otherwise(last["token"]).alias("token"),
                F.when(newer, found["region"]).otherwise(last["region"]).alias("region"),
                F.when(newer, found["country"]).otherwise(last["country"]).alias("country"),
            )
            return (
                F.when(F.coalesce(last["end"] > found["start"], F.lit(False)), runs)
                .when(last["end"] == found["start"], F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(joined)))
                .otherwise(F.concat(runs, F.array(found)))
            )

        found = _present(F.transform(F.sequence(F.lit(0), n - 1), reading))
        empty = F.array().cast(
            "array<struct<start:int,end:int,token:string,region:struct<code:string,country:string>,country:string>>"
        )
        return F.aggregate(found, empty, absorb)

    def _name_span(self, words: Column) -> Column:
        """Where the words without house or room numbers begin and end."""
        plain = F.transform(words, lambda w: ~w.rlike("\\d"))
        n = F.size(words)
        first, last = F.array_position(plain, True).cast("int"), F.array_position(F.reverse(plain), True).cast("int")
        return F.struct(
            F.when(first > 0, first - 1).otherwise(n).alias("start"), F.when(last > 0, n - last + 1).otherwise(n).alias("end")
        )

    def _lift(self, x: Column, outer: Column, country: Column) -> Column:
        """A listed city of up to four words, set off from its neighbours."""
        words, runs, span = x["words"], x["runs"], x["span"]
        n = F.size(words)
        spots = F.flatten(F.transform(
            F.array(*[F.lit(k) for k in range(CITY_WORDS, 0, -1)]),
            lambda k: F.when(k <= n, F.transform(
                F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))),
                lambda i: F.struct(i.alias("at"), k.alias("len")))).otherwise(
                F.array().cast("array<struct<at:int,len:int>>")),
        ))

        def stands_alone(s: Column) -> Column:
            end = s["at"] + s["len"]
            left = F.when(s["at"] > 0, F.element_at(words, s["at"]))
            right = F.when(end < n, F.element_at(words, end + 1))
            return (
                ~((s["at"] == 0) & (s["len"] == n))
                & ((s["at"] == span["start"]) | (end == span["end"]))
                & ~F.exists(runs, lambda r: (r["start"] < end) & (r["end"] > s["at"]))
                & F.coalesce(self.opaque(left), F.lit(True))
                & F.coalesce(self.opaque(right), F.lit(True))
            )

        def nearest(s: Column) -> Column:
            end = s["at"] + s["len"]
            ranked = F.transform(runs, lambda r: F.struct(
                F.when(r["end"] <= s["at"], s["at"] - r["end"]).otherwise(r["start"] - end).alias("gap"),
                r["start"].alias("start"), r["token"].alias("token"), r["region"].alias("region"), r["country"].alias("country")))
            best = F.array_min(ranked)
            return F.when(F.size(runs) > 0, F.struct(
                best["token"].alias("token"), best["region"].alias("region"), best["country"].alias("country"))).otherwise(outer)

        def known(s: Column) -> Column:
            end = s["at"] + s["len"]
            city = _text(words, s["at"], s["len"])
            hard = F.coalesce(F.when(s["at"] > 0, self.hard_boundary(F.element_at(words, s["at"]))), F.lit(False)) | F.coalesce(
                F.when(end < n, self.hard_boundary(F.element_at(words, end + 1))), F.lit(False)
            )
            metro = let(nearest(s), lambda q: F.when(q.isNotNull(), self.qualified_metro(city, q)).when(
                hard, self.metro(city)))
            return let(metro, lambda m: F.when(
                m.isNotNull() & F.coalesce(m["country"] == country, F.lit(True)),
                F.struct(m["id"].alias("metro"), city.alias("city"), F.lit(False).alias("minted"), m["country"].alias("country")),
            ))

        return _first(_present(F.transform(F.filter(spots, stands_alone), known)))

    def _mint_beside(self, x: Column) -> Column:
        """A new city named directly beside the only state in the string."""
        words, runs, span = x["words"], x["runs"], x["span"]
        n, run = F.size(words), _first(runs)

        def clear(side: Column) -> Column:
            """Leading words up to the first opaque one, at most four."""
            side = F.slice(side, F.lit(1), F.lit(CITY_WORDS))
            stop = F.array_position(F.transform(side, self.opaque), True).cast("int")
            return F.when(stop == 0, side).otherwise(F.slice(side, F.lit(1), stop - 1))

        after = clear(F.slice(words, run["end"] + 1, n))
        before = F.reverse(clear(F.reverse(F.slice(words, F.lit(1), run["start"]))))

        def mint(side: Column, touches) -> Column:
            return let(side, lambda w: F.when(
                (F.size(w) > 0) & touches(F.size(w)) & (run["end"] - run["start"] + F.size(w) < n),
                let(F.array_join(w, " "), lambda city: F.when(
                    self.metro(city).isNull() & plausible_city(city),
                    F.struct(slugify_folded(city).alias("metro"), city.alias("city"), F.lit(True).alias("minted"),
                             run["region"]["country"].alias("country")),
                )),
            ))

        return F.when(
            (F.size(runs) == 1) & run["region"].isNotNull(),
            F.coalesce(
                mint(after, lambda k: run["end"] + k == span["end"]),
                mint(before, lambda k: run["start"] - k == span["start"]),
            ),
        )

    def embedded(self, part: Column, region: Column, country: Column) -> Column:
        outer = F.when(region.isNotNull(), F.struct(
            region["code"].alias("token"), region.alias("region"), F.lit(None).cast("string").alias("country")))
        scene = let(_words(part), lambda w: F.when(F.size(w) >= 2, F.struct(
            w.alias("words"), self.qualifier_runs(w).alias("runs"), self._name_span(w).alias("span"))))
        found = let(scene, lambda x: F.when(x.isNotNull(), F.coalesce(
            self._lift(x, outer, country), F.when(~plausible_city(part), self._mint_beside(x)))))
        return F.when(~part.rlike(STREET), found)


def split_fragment(fragment: Column) -> Column:
    """Cleaned components of one written place (remote words already removed)."""
    text = F.regexp_replace(fragment, REMOTE, " ")
    text = F.regexp_replace(text, DECORATIONS, " ")
    text = F.regexp_replace(text, "\\s+-\\s+", ", ")
    text = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.filter(F.transform(F.split(text, SEPARATORS), clean_component), lambda p: p != "")


def parse_fragments(fragments: DataFrame, places: Gazetteer = DEFAULT) -> DataFrame:
    """Add metros, countries, supra, remote, cities, unmatched to a ``fragment`` column.

    Row-local, so run it on distinct fragments.
    """
    read = _Reader(F.col("hits"))
    df = fragments.withColumn("_text", F.regexp_replace(fold(F.col("fragment")), "[_()\\[\\]{}]", " "))
    df = df.withColumn("remote", F.col("_text").rlike(REMOTE)).withColumn("_parts", split_fragment(F.col("_text")))
    df = with_hits(df, "fragment", F.col("_parts"), places)
    df = df.withColumn("_info", F.transform("_parts", lambda p: let(read.row(p), lambda r: F.struct(
        p.alias("part"), r["country"].alias("country"), r["metro"].alias("metro"), r["region"].alias("region"),
        F.coalesce(r["supra"], F.lit(False)).alias("supra"), r["listed"].alias("listed"),
    ))))
    # A country name is spent unless it is also a city (Singapore).
    df = df.withColumn("_left", F.filter("_info", lambda x: x["country"].isNull() | x["metro"].isNotNull()))
    df = df.withColumn("supra", F.array_distinct(F.transform(F.filter("_left", lambda x: x["supra"]), lambda x: x["part"])))
    df = df.withColumn("_left", F.filter("_left", lambda x: ~x["supra"]))
    df = df.withColumn("_regions", F.transform(
        F.filter("_left", lambda x: x["metro"].isNull() & x["region"].isNotNull()), lambda x: x["region"]))
    df = df.withColumn("_left", F.filter("_left", lambda x: x["metro"].isNotNull() | x["region"].isNull()))
    df = df.withColumn("_named", F.transform(F.filter("_info", lambda x: x["country"].isNotNull()), lambda x: x["country"]))
    df = df.withColumn("_region", _last(F.col("_regions")))
    df = df.withColumn("_country", F.coalesce(_last(F.col("_named")), _first(F.col("_regions"))["country"]))

    region, country = F.col("_region"), F.col("_country")
    none = F.lit(None).cast("string")

    def outcome(metro, city, minted, own_country, adds, unmatched=none) -> Column:
        return F.struct(
            metro.alias("metro"), city.alias("city"), minted.alias("minted"), own_country.alias("country"),
            adds.alias("adds"), unmatched.alias("unmatched"),
        )

    def resolve(x: Column) -> Column:
        part = x["part"]
        direct = F.coalesce(read.listed_metro(x, region["code"]), x["metro"])

        def listed(m: Column) -> Column:
            return F.when(m.isNotNull(), outcome(m["id"], part, F.lit(False), none, m["country"]))

        inside = let(read.embedded(part, region, country), lambda e: F.when(e.isNotNull(), outcome(
            e["metro"], e["city"], e["minted"], none, F.coalesce(e["country"], country))))
        minted = F.when(plausible_city(part), outcome(slugify_folded(part), part, F.lit(True), country, country))
        nothing = outcome(none, none, F.lit(False), none, none, part)
        return F.coalesce(let(direct, listed), let(read.glued_metro(part), listed), inside, minted, nothing)

    df = df.withColumn("_resolved", F.transform("_left", resolve))
    df = df.withColumn("metros", F.array_distinct(_present(F.transform("_resolved", lambda r: r["metro"]))))
    df = df.withColumn("countries", F.array_distinct(F.concat(
        F.col("_named"), F.when(F.size("_named") == 0, _present(F.array(country))).otherwise(F.array().cast("array<string>")),
        _present(F.transform("_resolved", lambda r: r["adds"])),
    )))
    df = df.withColumn("cities", F.transform(
        F.filter("_resolved", lambda r: r["metro"].isNotNull()),
        lambda r: F.struct(r["city"].alias("city"), r["metro"].alias("metro"), r["minted"].alias("minted"), r["country"].alias("country")),
    ))
    df = df.withColumn("unmatched", _present(F.transform("_resolved", lambda r: r["unmatched"])))
    return df.select("fragment", "metros", "countries", "supra", "remote", "cities", "unmatched")


def title_places(titles: DataFrame, places: Gazetteer = DEFAULT) -> DataFrame:
    """Add struct ``place`` (metros, countries, supra, cities) to a unique ``title`` column.

    Only listed places count and nothing is minted: a title is mostly not a place.
    """
    read = _Reader(F.col("hits"))
    none = F.lit(None).cast("string")

    def clauses(text: Column) -> Column:
        inside = F.regexp_extract_all(text, F.lit("\\(([^()]*)\\)"), F.lit(1))
        outside = F.regexp_replace(text, "\\([^()]*\\)", " ")
        pieces = F.flatten(F.transform(F.concat(inside, F.array(outside)), lambda s: F.split(s, TITLE_DASHES)))
        bare = F.transform(pieces, lambda p: F.trim(F.regexp_replace(
            F.regexp_replace(F.regexp_replace(p, REMOTE, " "), DECORATIONS, " "), "\\s+", " ")))
        return F.flatten(F.transform(F.filter(bare, lambda p: p != ""), lambda p: F.split(p, TITLE_CLAUSES)))

    def components(clause: Column) -> Column:
        return F.filter(F.transform(F.split(clause, "\\s*,\\s*"), clean_component), lambda p: p != "")

    def read_part(part: Column, after: Column) -> Column:
        spelled = (F.length(part) > 2) | part.isin(BARE_PLACE_CODES)

        def found(metro=None, also=none, supra=none) -> Column:
            metro = F.lit(None).cast(METRO_TYPE) if metro is None else metro
            return F.struct(metro.alias("metro"), also.alias("country"), supra.alias("supra"), part.alias("city"))

        q = F.when(~after.isin(TITLE_NOT_A_QUALIFIER) & ((F.length(after) > 2) | after.isin(BARE_PLACE_CODES)), read.qualifier(after))
        state = F.when(~after.isin(TITLE_NOT_A_QUALIFIER), let(read.qualifier(after), lambda q: F.when(q["region"].isNotNull(), q)))

        def weigh(r: Column) -> Column:
            metro, country, region = r["metro"], r["country"], r["region"]
            qualified = let(F.coalesce(state, q), lambda q: F.when(
                q.isNotNull() & (metro.isNotNull() | plausible_city(part)),
                found(read.qualified_metro(part, q), F.coalesce(q["region"]["country"], q["country"]))))
            return (
                F.when(country.isNotNull() & metro.isNull(), F.when(spelled, found(also=country)))
                .when(r["supra"], F.when(spelled, found(supra=part)))
                .when(F.length(part) <= 2, F.lit(None))
                .otherwise(F.coalesce(
                    qualified,
                    F.when(region.isNotNull() & metro.isNull(), found(also=region["country"])),
                    F.when(metro.isNotNull(), found(metro, country)),
                ))
            )

        return let(read.row(part), weigh)

    def read_clause(parts: Column) -> Column:
        return F.transform(parts, lambda p, i: read_part(p, F.get(parts, i + 1)))

    def collect(h: Column) -> Column:
        placed = F.filter(h, lambda x: x["metro"].isNotNull())
        return F.struct(
            F.array_distinct(F.transform(placed, lambda x: x["metro"]["id"])).alias("metros"),
            F.array_distinct(_present(F.concat(
                F.transform(h, lambda x: x["country"]), F.transform(placed, lambda x: x["metro"]["country"])))).alias("countries"),
            F.array_distinct(_present(F.transform(h, lambda x: x["supra"]))).alias("supra"),
            F.transform(placed, lambda x: F.struct(
                x["city"].alias("city"), x["metro"]["id"].alias("metro"), F.lit(False).alias("minted"), none.alias("country"))).alias("cities"),
        )

    df = titles.withColumn("_clauses", F.transform(let(fold(F.col("title")), clauses), components))
    df = with_hits(df, "title", F.flatten("_clauses"), places)
    found = _present(F.flatten(F.transform("_clauses", read_clause)))
    return df.select(*titles.columns, let(found, collect).alias("place"))


def _written_places() -> Column:
    """Every distinct non-blank place string of a posting."""
    pair = F.when((F.col("city") != "") & (F.col("region") != ""), F.concat_ws(", ", "city", "region")).otherwise(F.col("city"))
    written = F.concat(
        F.coalesce(F.col("locations_all"), F.array().cast("array<string>")), F.array("location_raw", pair, "country"))
    return F.array_distinct(F.filter(F.transform(written, lambda w: F.trim(w)), lambda f: f.isNotNull() & (f != "")))


def location_fragments(df: DataFrame) -> DataFrame:
    """(id, fragment): every distinct non-blank place string of each posting."""
    return df.select("id", F.explode(_written_places()).alias("fragment"))


def derive_location(df: DataFrame, places: Gazetteer = DEFAULT, memory=None) -> DataFrame:
    """id, d_metros, d_countries, d_supra, remote_hint, cities, unmatched for every posting.

    With a ``memory`` of places read before, only strings it does not hold are read.
    """
    wanted = location_fragments(df).select("fragment").distinct()
    parsed = parse_fragments(wanted, places) if memory is None else memory.fragments(wanted)
    # Titles travel with the fragments, so postings need no join back; one without a fragment has a key of its own.
    pieces = df.select("id", "title", F.explode_outer(_written_places()).alias("fragment")).withColumn("_key", F.coalesce("fragment", F.concat(F.lit("\0"), "id")))
    out = pieces.join(parsed.withColumnRenamed("fragment", "_key"), "_key", "left").groupBy("id").agg(
        F.any_value("title").alias("title"),
        F.array_distinct(F.flatten(F.collect_list("metros"))).alias("metros"),
        F.array_distinct(F.flatten(F.collect_list("countries"))).alias("countries"),
        F.array_distinct(F.flatten(F.collect_list("supra"))).alias("supra"),
        F.bool_or("remote").alias("remote_hint"),
        F.flatten(F.collect_list("cities")).alias("cities"),
        F.flatten(F.collect_list("unmatched")).alias("unmatched"),
    )
    # The title is read only where the location fields named no country.
    silent = F.coalesce(F.size("countries"), F.lit(0)) <= 0
    titles = out.where(silent & F.col("title").isNotNull()).select("title").distinct()
    named = title_places(titles, places) if memory is None else memory.titles(titles)
    # A posting that needs no title, or has none, joins on a key of its own that no title has, so such rows are spread evenly.
    out = out.withColumn("_title", F.coalesce(F.when(silent, F.col("title")), F.concat(F.lit("\0"), F.col("id")))).join(
        named.select(F.col("title").alias("_title"), F.col("place").alias("_t")), "_title", "left")

    def both(name: str) -> Column:
        empty = F.array().cast("array<string>")
        return F.array_sort(F.array_distinct(F.concat(F.coalesce(F.col(name), empty), F.coalesce(F.col("_t")[name], empty))))

    cities = F.array().cast("array<struct<city:string,metro:string,minted:boolean,country:string>>")
    return out.select(
        "id", both("metros").alias("d_metros"), both("countries").alias("d_countries"), both("supra").alias("d_supra"),
        F.coalesce("remote_hint", F.lit(False)).alias("remote_hint"),
        F.concat(F.coalesce("cities", cities), F.coalesce(F.col("_t")["cities"], cities)).alias("cities"),
        F.coalesce("unmatched", F.array().cast("array<string>")).alias("unmatched"),
    )


def remote_scope(countries: Column, supra: Column) -> Column:
    """How far a remote posting reaches, NULL when it does not say."""
    world = F.arrays_overlap(supra, F.array(F.lit("worldwide"), F.lit("anywhere"), F.lit("global")))
    return (
        F.when(F.size(supra) > 0, F.when(world, "worldwide").otherwise("region"))
        .when(F.size(countries) == 1, "country")
        .when(F.size(countries) > 1, "region")
    )
