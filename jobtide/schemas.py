"""Table schemas as DDL. Derived columns carry the prefix ``d_`` and are written by the derive plan only."""

POSTINGS_RAW = (
    "id string, ats string, company_id string, company_slug string, company_name string, native_id string, "
    "title string, title_norm string, department string, team string, employment_type string, "
    "location_raw string, locations_all array<string>, country string, region string, city string, postal_code string, "
    "raw_workplace string, raw_remote boolean, posted_at timestamp, source_updated_at timestamp, "
    "first_seen timestamp, last_seen timestamp, is_open boolean, content_hash string, text_length int, "
    "url string, apply_url string, comp_min double, comp_max double, comp_currency string, comp_interval string, "
    "comp_text string, has_equity boolean, d_derived_at timestamp"
)
# What a source mapper gives: a snapshot row. has_text / has_place are false when that part was not read.
SNAPSHOT = (
    "id string, ats string, company_slug string, company_name string, native_id string, title string, title_norm string, "
    "department string, team string, employment_type string, location_raw string, locations_all array<string>, "
    "country string, region string, city string, postal_code string, raw_workplace string, raw_remote boolean, "
    "posted_at timestamp, source_updated_at timestamp, url string, apply_url string, comp_min double, comp_max double, "
    "comp_currency string, comp_interval string, comp_text string, has_equity boolean, description_text string, "
    "has_text boolean, has_place boolean"
)
POSTING_TEXT = "id string, text string"
COMPANIES = (
    "id string, ats string, slug string, name string, name_source string, board_url string, website string, job_count long, "
    "sector string, blurb string, sector_src string, sector_at timestamp, first_seen timestamp, last_seen timestamp, "
    "last_swept timestamp, last_etag string, status string, discovery string"
)
# One row per board read today. outcome: swept, unchanged, dead or error.
BOARDS = "ats string, slug string, outcome string, name string, name_source string, url string, etag string, discovery string"
EVENTS = "id string, day date, event string"
ATTEMPTS = "ats string, slug string, status int, verdict string, strategy string, seed string, rank int, tried_at timestamp"
SLUG_STORE = "ats string, slug string, sources array<string>, first_seen timestamp, last_seen timestamp"
VERDICTS = (
    "ats string, slug string, status string, checked_at timestamp, name string, website string, careers_url string, "
    "allow_indexing boolean, hosted_disabled boolean, last_error string, last_error_at timestamp"
)
SAVED = (
    "user_id string, id string, status string, note string, saved_at timestamp, updated_at timestamp, applied_at timestamp, "
    "title string, company string, url string"
)
HIDDEN = "user_id string, id string, hidden_at timestamp, title string, company string, url string"
LISTS = "list_id string, user_id string, name string, created_at timestamp"
LIST_ITEMS = "list_id string, id string, added_at timestamp"
METROS = "id string, label string, country string, region string, job_count long"
SWEEPS = (
    "ats string, boards long, live long, empty long, dead long, errors long, unchanged long, jobs long, added long, "
    "changed long, closed long"
)


def columns(ddl: str) -> list[str]:
    """Column names of a DDL string whose types hold no commas outside brackets."""
    out, depth, word = [], 0, ""
    for char in ddl + ",":
        depth += (char in "<(") - (char in ">)")
        if char == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += char
    return out
