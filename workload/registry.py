"""Every registered query and its check."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.functions import payload as P
from postloom.functions import text as X
from postloom.operators import filters, geo, packing, paging, ranking, search_index
from postloom.operators.assembly import assemble, companies, recruiters
from postloom.operators.counts import default_scope, labelled_counts, scope_catalog
from postloom.operators.dedup import latest_postings
from postloom.operators.facets import facet_values, ordered_facets
from postloom.operators.skills import explode_skills
from postloom.operators.typing import clean, typed
from postloom.plans import context, display, distinct, incremental, search, serving
from postloom.plans import statistics as stats
from postloom.plans.warehouse import to_detail
from postloom.sources.snapshot import read_snapshot, write_snapshot
from workload.adapter import cte, new_buckets, new_folder, new_store, postings, raw_postings, serving_postings, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

STAMP = "2024-01-01 00:00:00"


def query(sql: str | None = None, name: str | None = None):
    """Register a query; `sql` may use the CTEs named in `_CTE`."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = f"{_CTE}\n{sql}" if _uses_cte(sql) else sql
        return fn

    return register


def _uses_cte(sql: str) -> bool:
    return any(f" {t}" in sql for t in ("postings", "raw", "valid", "typed", "detail", "counts", "cats", "skill_rows"))


_AMOUNT = "TRY_CAST(NULLIF(regexp_replace(trim({c}), '万$', ''), '') AS DECIMAL(10,2))"
_AMOUNT_ANY = "TRY_CAST(NULLIF(replace({c}, '万', ''), '') AS DECIMAL(10,2))"
_TYPED = f"""* REPLACE (TRY_CAST(raw_id AS BIGINT) AS raw_id),
    {_AMOUNT.format(c='salary_low')} AS salary_low_wan,
    {_AMOUNT.format(c='salary_high')} AS salary_high_wan,
    TRY_CAST(substr(publish_time, 1, 10) AS DATE) AS publish_date"""
_BUCKET = (
    "CASE "
    + " ".join(
        f"WHEN salary_low_wan + salary_high_wan < {2 * b} THEN '{n}'" for b, n in S.SALARY_BUCKETS if b is not None
    )
    + f" WHEN salary_low_wan + salary_high_wan IS NOT NULL THEN '{S.SALARY_BUCKETS[-1][1]}' END"
)
_AVG = (
    "CASE WHEN count(salary_low_wan + salary_high_wan) > 0 THEN"
    " CAST(sum(salary_low_wan + salary_high_wan) AS DOUBLE) / (2 * count(salary_low_wan + salary_high_wan)) END"
)


def _label(column: str) -> str:
    return f"CASE WHEN trim({column}) <> '' THEN {column} ELSE '{S.UNKNOWN}' END"


_PAIRS = "\n    UNION ALL ".join(
    [
        f"SELECT scope_id, '{t}' AS stat_type, {_label(c)} AS category, salary_low_wan, salary_high_wan FROM typed"
        for t, c in S.CATEGORY_COLUMN.items()
    ]
    + [f"SELECT scope_id, 'salary', {_BUCKET}, salary_low_wan, salary_high_wan FROM typed"]
)

# raw -> valid -> detail are the warehouse layers; typed is every posting, typed, not deduplicated;
# cats holds the statistics as rows, top limits applied.
_CTE = f"""{cte()},
valid AS (
    SELECT * FROM raw
    WHERE regexp_matches(raw_id, '^[0-9]+$') AND trim(keyword) = upper(scope_id) AND scope_code = scope_id
),
detail AS (
    SELECT {_TYPED} FROM (
        SELECT *, row_number() OVER (PARTITION BY scope_code, job_uid ORDER BY CAST(raw_id AS BIGINT) DESC) AS rn
        FROM valid WHERE trim(job_uid) <> ''
    ) WHERE rn = 1
),
typed AS (SELECT {_TYPED} FROM postings),
skill_rows AS (
    SELECT raw_id, scope_id, trim(seg) AS skill, CAST(pos AS INTEGER) AS skill_pos FROM (
        SELECT raw_id, scope_id, unnest(segs) AS seg, generate_subscripts(segs, 1) AS pos FROM (
            SELECT raw_id, scope_id, regexp_split_to_array(coalesce(skills, ''), '\\s*\\|\\s*') AS segs FROM typed
        )
    ) WHERE trim(seg) <> ''
),
counts AS (
    SELECT scope_id, stat_type, category, count(*) AS value,
           CASE WHEN stat_type = 'city' THEN {_AVG} END AS average_salary_wan
    FROM ({_PAIRS}) WHERE category IS NOT NULL GROUP BY scope_id, stat_type, category
    UNION ALL
    SELECT scope_id, 'skills', skill, count(*), NULL FROM skill_rows GROUP BY ALL
),
newest AS (SELECT scope_id, max(publish_date) AS last FROM typed GROUP BY scope_id HAVING last IS NOT NULL),
spine AS (
    SELECT scope_id, CAST(unnest(generate_series(last - INTERVAL 29 DAY, CAST(last AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
    FROM newest
),
cats AS (
    SELECT scope_id, stat_type, category, value, average_salary_wan FROM (
        SELECT *, row_number() OVER (PARTITION BY scope_id, stat_type ORDER BY value DESC, category) AS rn FROM counts
    ) WHERE rn <= CASE stat_type WHEN 'top_companies' THEN 15 WHEN 'industry' THEN 15 WHEN 'skills' THEN 20
                  ELSE 1000000000 END
    UNION ALL
    SELECT s.scope_id, 'publish_trend', CAST(s.day AS VARCHAR), count(t.raw_id), NULL
    FROM spine s LEFT JOIN typed t ON t.scope_id = s.scope_id AND t.publish_date = s.day GROUP BY ALL
)"""


def typed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(postings(spark, sf_dir))


def valid_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = filters.valid_row(F.upper("scope_id"), F.col("scope_id"))
    return raw_postings(spark, sf_dir).filter(expected)


# Warehouse load


@query("SELECT raw_id, scope_id, job_uid, keyword FROM valid WHERE trim(job_uid) <> ''")
def validity_filter(spark, sf_dir):
    rows = valid_postings(spark, sf_dir).filter(filters.has_uid())
    return rows.select("raw_id", "scope_id", "job_uid", "keyword")


@query("SELECT CAST(raw_id AS VARCHAR) AS raw_id, scope_id, job_uid FROM detail")
def dedup_latest(spark, sf_dir):
    rows = latest_postings(valid_postings(spark, sf_dir).filter(filters.has_uid()))
    return rows.select("raw_id", "scope_id", "job_uid")


@query("SELECT CAST(raw_id AS VARCHAR) AS raw_id, scope_id, job_uid FROM detail")
def merge_latest(spark, sf_dir):
    """Two snapshots: a third of the rows comes after the others and is merged with the stored buckets."""
    rows = valid_postings(spark, sf_dir)
    late = F.pmod(F.col("raw_id").cast("long"), F.lit(3)) == 0
    stored = new_buckets(spark, "merge_latest")
    stored.merge(rows.filter(~late))
    return stored.merge(rows.filter(late)).select("raw_id", "scope_id", "job_uid")


@query(
    """SELECT raw_id, scope_id, job_uid, job_name || chr(10) || '"' || company || '"' || chr(10) || ', \\' AS description
       FROM postings WHERE scope_id = 'building'"""
)
def snapshot_csv(spark, sf_dir):
    """One scope's snapshot is written as CSV and read back; its descriptions hold quotes and line breaks."""
    text = F.concat("job_name", F.lit('\n"'), "company", F.lit('"\n, \\'))
    rows = postings(spark, sf_dir).withColumn("description", text)
    path = write_snapshot(rows, new_folder(spark, "snapshots"), S.Scope("BUILDING", "building"))
    return read_snapshot(spark, path).select("raw_id", "scope_id", "job_uid", "description")


# Salaries as crawlers deliver them: by month, in thousands or yuan, by day, as a range in one field.
_SALARY_FORMS = {
    "salary_low": """CASE TRY_CAST(raw_id AS BIGINT) % 5 WHEN 0 THEN replace(salary_low, '万', '千/月')
        WHEN 1 THEN replace(salary_low, '万', '') || '.5-60万/年' WHEN 2 THEN ' ' || replace(salary_low, '万', '35元/天 ')
        WHEN 3 THEN replace(salary_low, '万', 'K·面议') ELSE salary_low END""",
    "salary_high": """CASE TRY_CAST(raw_id AS BIGINT) % 5 WHEN 0 THEN replace(salary_high, '万', 'k/月')
        WHEN 1 THEN '' WHEN 2 THEN replace(salary_high, '万', '') || '~99' ELSE salary_high END""",
}
_NUMBER, _MEASURE = r"([0-9]+(?:\.[0-9]+)?)", r"\s*(万|千|[kK]|元)?\s*/?\s*(年|月|天|日)?$"
_SPAN, _SINGLE = rf"^{_NUMBER}\s*[-–~]\s*{_NUMBER}{_MEASURE}", rf"^{_NUMBER}{_MEASURE}"


def _yearly(column: str, pattern: str, number: int, unit: int) -> str:
    at = lambda k: f"regexp_extract({column}, '{pattern}', {k})"
    unit_case = " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.SALARY_UNITS.items())
    period_case = " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.SALARY_PERIODS.items())
    amount = f"""CAST({at(number)} AS DECIMAL(14,4)) * CAST(CASE lower({at(unit)}) {unit_case} ELSE 1 END AS DECIMAL(8,4))
                 * CASE {at(unit + 1)} {period_case} ELSE 1 END"""
    return f"regexp_replace(CAST(CAST({amount} AS DECIMAL(20,2)) AS VARCHAR), '\\.?0+$', '') || '万'"


def _normal(column: str, group: int) -> str:
    return f"""CASE WHEN regexp_matches({column}, '{_SPAN}') THEN {_yearly(column, _SPAN, group, 3)}
               WHEN regexp_matches({column}, '{_SINGLE}') THEN {_yearly(column, _SINGLE, 1, 2)} ELSE {column} END"""


_CLEANED = ", ".join(f"NULLIF(trim({c}), '') AS {c}" for c in S.SNAPSHOT.names if not c.startswith("salary"))


@query(
    f"""SELECT * REPLACE ({_normal("salary_low", 1)} AS salary_low,
               CASE WHEN salary_high IS NULL AND regexp_matches(salary_low, '{_SPAN}') THEN {_yearly("salary_low", _SPAN, 2, 3)}
               ELSE {_normal("salary_high", 2)} END AS salary_high)
        FROM (SELECT {_CLEANED}, NULLIF(trim(salary_low), '') AS salary_low, NULLIF(trim(salary_high), '') AS salary_high
              FROM (SELECT * REPLACE ({", ".join(f"{v} AS {c}" for c, v in _SALARY_FORMS.items())}) FROM raw)
              WHERE regexp_matches(raw_id, '^[0-9]+$'))"""
)
def clean_postings(spark, sf_dir):
    """Trimmed fields and salaries in 万 a year, from the forms that crawlers deliver."""
    source = raw_postings(spark, sf_dir).filter(F.col("raw_id").rlike("^[0-9]+$")).select(*S.SNAPSHOT.names)
    forms = source.selectExpr(*[f"{_SALARY_FORMS[c]} AS {c}" if c in _SALARY_FORMS else c for c in source.columns])
    return clean(forms)


@query("SELECT CAST(raw_id AS VARCHAR) AS raw_id, scope_id, job_uid FROM detail")
def clean_dedup(spark, sf_dir):
    """The newest row per job of cleaned postings."""
    rows = latest_postings(clean(valid_postings(spark, sf_dir)).filter(filters.has_uid()))
    return rows.select("raw_id", "scope_id", "job_uid")


_TYPED_COLUMNS = [c for c in S.DETAIL.names]


@query(f"SELECT {', '.join(_TYPED_COLUMNS)} FROM detail")
def typed_detail(spark, sf_dir):
    return to_detail(valid_postings(spark, sf_dir)).select(*_TYPED_COLUMNS)


_SKILL_COLUMNS = [c for c in S.SKILL.names if c not in ("skill", "skill_pos")]


@query(
    f"""SELECT {", ".join(f"t.{c}" for c in _SKILL_COLUMNS)}, s.skill, s.skill_pos
        FROM skill_rows s JOIN typed t USING (raw_id, scope_id)"""
)
def skills_exploded(spark, sf_dir):
    return explode_skills(typed_postings(spark, sf_dir)).select(*_SKILL_COLUMNS, "skill", "skill_pos")


@query(
    """SELECT 'snapshot_raw' AS table_name, count(*) AS row_count FROM valid
       UNION ALL SELECT 'posting_detail', count(*) FROM detail
       UNION ALL SELECT 'posting_skill', count(*) FROM (
           SELECT unnest(regexp_split_to_array(coalesce(skills, ''), '\\s*\\|\\s*')) AS seg FROM detail
       ) WHERE trim(seg) <> ''"""
)
def layer_counts(spark, sf_dir):
    valid = valid_postings(spark, sf_dir)
    detail = to_detail(valid)
    return labelled_counts(
        {"snapshot_raw": valid, "posting_detail": detail, "posting_skill": explode_skills(detail)}
    )


# Search


_CATALOG = """SELECT scope_id, max(keyword) AS keyword, max(city_list) AS cities, count(*) AS job_count,
                     max(created_at) AS updated_at
              FROM postings GROUP BY scope_id"""


@query(_CATALOG, name="scope_catalog")
def scope_catalog_query(spark, sf_dir):
    return scope_catalog(postings(spark, sf_dir))


@query(f"{_CATALOG} ORDER BY updated_at DESC, scope_id LIMIT 1", name="default_scope")
def default_scope_query(spark, sf_dir):
    return default_scope(postings(spark, sf_dir))


_LIST = ", ".join(f"{c} AS {n}" for c, n in S.LIST_FIELDS.items())
_DETAIL = ", ".join(f"{c} AS {n}" for c, n in S.DETAIL_FIELDS.items() if c != "description")
_NEWEST = "TRY_CAST(publish_time AS TIMESTAMP) DESC NULLS LAST, CAST(raw_id AS BIGINT) DESC"
_SEARCH = "(job_name ILIKE '{k}' OR company ILIKE '{k}' OR skills ILIKE '{k}' OR description ILIKE '{k}')"


@query(
    f"""SELECT {_LIST} FROM postings
        WHERE scope_id = 'building' AND education = 'O' AND {_SEARCH.format(k='%WIDGET%')}
          AND {_AMOUNT_ANY.format(c='salary_high')} >= 10.5 AND {_AMOUNT_ANY.format(c='salary_low')} <= 40"""
)
def job_search(spark, sf_dir):
    wanted = filters.JobQuery("building", education="O", keyword="WIDGET", salary_min=10.5, salary_max=40.0)
    return filters.renamed(postings(spark, sf_dir).filter(wanted.predicate()), S.LIST_FIELDS)


@query(
    f"""SELECT {_LIST} FROM postings
        WHERE scope_id = 'building' AND city = 'NATION_13' AND education = 'O' AND experience = '3-MEDIUM'
          AND company_size = '100人以上' AND industry = 'new widget' AND {_SEARCH.format(k='%WIDGET%')}
          AND {_AMOUNT_ANY.format(c='salary_high')} >= 1.5 AND {_AMOUNT_ANY.format(c='salary_low')} <= 60"""
)
def job_search_faceted(spark, sf_dir):
    """The same with all five facets set."""
    facets = {"city": "NATION_13", "education": "O", "experience": "3-MEDIUM", "company_size": "100人以上"}
    wanted = filters.JobQuery(
        "building", **facets, industry="new widget", keyword="WIDGET", salary_min=1.5, salary_max=60.0
    )
    return filters.renamed(postings(spark, sf_dir).filter(wanted.predicate()), S.LIST_FIELDS)


@query(f"SELECT raw_id, scope_id, job_uid FROM postings WHERE {_SEARCH.format(k='%r_d%1%')}")
def keyword_search(spark, sf_dir):
    rows = postings(spark, sf_dir).filter(filters.matches_keyword("r_d%1"))
    return rows.select("raw_id", "scope_id", "job_uid")


#: Two runs with wildcards, one common word, a word that is in no posting, and one character, which no bigram serves.
_KEYWORDS = ["Widget%000001", "ustomer#00000012_", "standard", "no such word", "9"]


@query(
    "\nUNION ALL ".join(
        f"SELECT '{k}' AS keyword, raw_id, scope_id, job_uid FROM postings WHERE {_SEARCH.format(k=f'%{k}%')}" for k in _KEYWORDS
    )
)
def keyword_search_indexed(spark, sf_dir):
    """The search index of all postings is written, and every keyword looked up in it."""
    store = new_store(spark)
    search_index.build(store, serving_postings(spark, sf_dir))
    found = [search_index.find(store, k).select(F.lit(k).alias("keyword"), "raw_id", "scope_id", "job_uid") for k in _KEYWORDS]
    return reduce(DataFrame.unionByName, found)


@query(
    f"""SELECT {_LIST} FROM postings WHERE scope_id = 'machinery'
        ORDER BY {_NEWEST} LIMIT 20 OFFSET 40"""
)
def job_page(spark, sf_dir):
    return search.list_jobs(postings(spark, sf_dir), filters.JobQuery("machinery", page=3, page_size=20))[0]


@query(f"SELECT raw_id, {_LIST} FROM postings ORDER BY {_NEWEST} LIMIT 40 OFFSET 12000")
def job_page_deep(spark, sf_dir):
    """A deep page, located by days and, as the bound is low here, by seconds."""
    rows = paging.page(postings(spark, sf_dir), 301, 40, day_rows=20)
    return rows.select("raw_id", *[F.col(c).alias(n) for c, n in S.LIST_FIELDS.items()])


@query(
    f"""SELECT count(*) AS total, CAST(3 AS BIGINT) AS page, CAST(20 AS BIGINT) AS page_size,
               CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages
        FROM postings WHERE scope_id = 'machinery' AND education = 'F' AND {_SEARCH.format(k='%STEEL%')}"""
)
def page_meta_filtered(spark, sf_dir):
    wanted = filters.JobQuery("machinery", education="F", keyword="STEEL")
    return paging.page_meta(postings(spark, sf_dir).filter(wanted.predicate()), 3, 20)


@query(
    "SELECT facet, value, row_number() OVER (ORDER BY facet, value) AS position FROM ("
    + "\nUNION ALL ".join(
        f"(SELECT DISTINCT '{f}' AS facet, {c} AS value FROM postings WHERE scope_id = 'building' AND trim({c}) <> '')"
        for f, c in S.FACETS.items()
    )
    + ")"
)
def facets_in_order(spark, sf_dir):
    """The filter values of one scope with their place in the list, so that the order is checked."""
    rows = ordered_facets(postings(spark, sf_dir), "building").select("facet", "value")
    return rows.withColumn("position", F.monotonically_increasing_id()).groupBy("facet", "value").agg(
        F.max("position").alias("position")
    ).withColumn("position", F.row_number().over(Window.orderBy("position")).cast("long"))


@query(
    """SELECT scope_id, count(*) AS total, CAST(2 AS BIGINT) AS page, CAST(10 AS BIGINT) AS page_size,
              CAST(greatest(1, ceil(count(*) / 10.0)) AS BIGINT) AS pages
       FROM postings GROUP BY scope_id"""
)
def page_meta(spark, sf_dir):
    return paging.page_meta_by_scope(postings(spark, sf_dir), 2, 10)


_PLAIN_DESCRIPTION = """trim(replace(replace(replace(replace(description, '<p>', chr(10)), '</p><br/>', chr(10)),
    '&amp;', '&'), chr(10) || chr(10), chr(10)), chr(10)) AS description"""


@query(
    f"""SELECT {_DETAIL}, {_PLAIN_DESCRIPTION} FROM postings WHERE job_uid = '5-7'
        ORDER BY CAST(raw_id AS BIGINT) DESC LIMIT 1"""
)
def job_detail(spark, sf_dir):
    return filters.job_detail(postings(spark, sf_dir), "5-7")


@query(ORACLES["job_detail"].removeprefix(f"{_CTE}\n"))
def job_detail_bucketed(spark, sf_dir):
    """The same from the bucketed table, of which one bucket is read."""
    stored = new_buckets(spark, "job_detail")
    stored.merge(postings(spark, sf_dir))
    return stored.detail("5-7")


@query(
    "\nUNION ALL ".join(
        f"(SELECT DISTINCT scope_id, '{f}' AS facet, {c} AS value FROM postings WHERE trim({c}) <> '')"
        for f, c in S.FACETS.items()
    ),
    name="facet_values",
)
def facet_values_query(spark, sf_dir):
    return facet_values(postings(spark, sf_dir))


@query(
    f"""SELECT raw_id, scope_id, salary_low, salary_high FROM postings
        WHERE {_AMOUNT_ANY.format(c='salary_high')} >= 20 AND {_AMOUNT_ANY.format(c='salary_low')} <= 30"""
)
def salary_overlap(spark, sf_dir):
    low, high = (X.wan_amount_anywhere(F.col(c)) for c in ("salary_low", "salary_high"))
    rows = postings(spark, sf_dir).filter(filters.overlaps_salary(low, high, 20.0, 30.0))
    return rows.select("raw_id", "scope_id", "salary_low", "salary_high")


# Statistics


@query(
    f"""SELECT scope_id, count(*) AS job_count,
               count(DISTINCT CASE WHEN trim(company) <> '' THEN company END) AS company_count,
               count(DISTINCT CASE WHEN trim(city) <> '' THEN city END) AS city_count,
               {_AVG} AS average_annual_salary_wan,
               count(salary_low_wan + salary_high_wan) AS salary_job_count, '{STAMP}' AS data_updated_at
        FROM typed GROUP BY scope_id"""
)
def stat_summary(spark, sf_dir):
    return stats.summary(typed_postings(spark, sf_dir)).withColumn("data_updated_at", F.lit(STAMP))


@query(
    f"""SELECT scope_id, format('{{:,}}', count(*)) AS job_count,
               format('{{:,}}', count(DISTINCT CASE WHEN trim(company) <> '' THEN company END)) AS company_count,
               format('{{:,}}', count(DISTINCT CASE WHEN trim(city) <> '' THEN city END)) AS city_count,
               format('{{:,}}', count(salary_low_wan + salary_high_wan)) AS salary_job_count,
               coalesce(CAST({_AVG} AS VARCHAR), '{S.ABSENT}') AS average_annual_salary_wan,
               '{S.ABSENT}' AS data_updated_at
        FROM typed GROUP BY scope_id"""
)
def display_summary(spark, sf_dir):
    summary = stats.summary(typed_postings(spark, sf_dir)).withColumn("data_updated_at", F.lit(""))
    return display.key_figures(summary)


@query("SELECT scope_id, category, value, average_salary_wan FROM cats WHERE stat_type = 'city'")
def stat_city(spark, sf_dir):
    return stats.city(typed_postings(spark, sf_dir))


def _register_distribution(stat_type: str, compute) -> None:
    sql = f"SELECT scope_id, category, value FROM cats WHERE stat_type = '{stat_type}'"
    query(sql, name=f"stat_{stat_type}")(lambda spark, sf_dir: compute(typed_postings(spark, sf_dir), stat_type))


for _type in ("salary", "education", "experience", "company_size", "company_type", "financing"):
    _register_distribution(_type, stats.distribution)
for _type in ("top_companies", "industry"):
    _register_distribution(_type, stats.ranked)
_register_distribution("publish_trend", lambda detail, _: stats.publish_trend(detail))
_register_distribution("skills", lambda detail, _: stats.skills(explode_skills(detail)))


@query(
    """WITH days AS (SELECT event_type AS scope_id, CAST(ts AS DATE) AS day, count(*) AS value FROM events GROUP BY ALL),
       newest AS (SELECT scope_id, max(day) AS last FROM days GROUP BY scope_id),
       span AS (SELECT scope_id, CAST(unnest(generate_series(last - INTERVAL 29 DAY, CAST(last AS TIMESTAMP),
                INTERVAL 1 DAY)) AS DATE) AS day FROM newest)
       SELECT s.scope_id, CAST(s.day AS VARCHAR) AS category, coalesce(d.value, 0) AS value
       FROM span s LEFT JOIN days d ON d.scope_id = s.scope_id AND d.day = s.day"""
)
def event_trend(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("scope_id"), F.col("ts").cast("date").alias("day")
    )
    return stats.publish_trend(events, "day")


_BUCKET_ORDER = "list_position([" + ", ".join(f"'{n}'" for _, n in S.SALARY_BUCKETS) + "], category)"


@query(
    f"""SELECT scope_id, CASE WHEN rn <= 6 THEN category ELSE '{S.OTHER}' END AS category,
               CAST(sum(value) AS BIGINT) AS value
        FROM (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY value DESC, category) AS rn
              FROM counts WHERE stat_type = 'financing')
        GROUP BY ALL"""
)
def topn_other(spark, sf_dir):
    return ranking.top_with_other(stats.distribution(typed_postings(spark, sf_dir), "financing"))


def _top_sql(stat_type: str, limit: int) -> str:
    return f"""SELECT scope_id, category, value FROM (
                   SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY value DESC, category) AS rn
                   FROM counts WHERE stat_type = '{stat_type}') WHERE rn <= {limit}"""


@query(_top_sql("top_companies", 15))
def topn_companies(spark, sf_dir):
    return ranking.top(stats.distribution(typed_postings(spark, sf_dir), "top_companies"), 15)


@query(_top_sql("city", 10))
def topn_cities(spark, sf_dir):
    return ranking.top(stats.distribution(typed_postings(spark, sf_dir), "city"), 10)


@query(
    f"""SELECT raw_id, scope_id, {_LIST} FROM (
            SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY {_NEWEST}) AS rn FROM postings
        ) WHERE rn <= 5"""
)
def sample_recent(spark, sf_dir):
    rows = paging.recent(postings(spark, sf_dir))
    return rows.select("raw_id", "scope_id", *[F.col(c).alias(n) for c, n in S.LIST_FIELDS.items()])


_CITIES = list(S.CITY_COORDINATES)
_CITY_VALUES = ", ".join(f"({i}, '{c}', {x}, {y})" for i, (c, (x, y)) in enumerate(S.CITY_COORDINATES.items()))


@query(
    f"""SELECT scope_id, name, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat, value,
               5 + 12 * sqrt(value / greatest(1, max(value) OVER (PARTITION BY scope_id))) AS symbol_size
        FROM (SELECT scope_id, nation_key, count(*) AS value FROM postings GROUP BY ALL)
        JOIN (VALUES {_CITY_VALUES}) AS c(idx, name, lon, lat) ON c.idx = nation_key"""
)
def city_geo(spark, sf_dir):
    """The first 24 nations stand for the known cities; the last one is unknown and drops out."""
    names = F.array(*[F.lit(c) for c in _CITIES])
    rows = typed_postings(spark, sf_dir).withColumn("city", F.get(names, F.col("nation_key")))
    return geo.city_points(stats.distribution(rows, "city"))


@query(
    f"""SELECT scope_id, CASE WHEN rn <= 6 THEN category ELSE '{S.OTHER}' END AS category,
               CAST(sum(value) AS BIGINT) AS value
        FROM (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY value DESC, {_BUCKET_ORDER}) AS rn
              FROM counts WHERE stat_type = 'salary')
        GROUP BY ALL"""
)
def topn_salary(spark, sf_dir):
    """Ties of the salary roll-up go by bucket, as in the stored order."""
    rows = stats.distribution(typed_postings(spark, sf_dir), "salary").withColumn("stat_type", F.lit("salary"))
    return ranking.top_with_other(rows, tie=packing.stored_order())


def _payloads(spark, sf_dir) -> DataFrame:
    detail = typed_postings(spark, sf_dir)
    return stats.statistics(detail, explode_skills(detail), STAMP)


_STORED = f"""CASE stat_type WHEN 'publish_trend' THEN 0 WHEN 'salary' THEN {_BUCKET_ORDER} ELSE -value END, category"""
_DATA = f"""{{'categories': list(category ORDER BY {_STORED}), 'values': list(value ORDER BY {_STORED})}}"""
_CITY_DATA = f"""{{'categories': list(category ORDER BY {_STORED}), 'job_counts': list(value ORDER BY {_STORED}),
                  'average_salary_wan': list(average_salary_wan ORDER BY {_STORED})}}"""
_SUMMARY_COLUMNS = f"""count(*) AS job_count,
               count(DISTINCT CASE WHEN trim(company) <> '' THEN company END) AS company_count,
               count(DISTINCT CASE WHEN trim(city) <> '' THEN city END) AS city_count,
               {_AVG} AS average_annual_salary_wan,
               count(salary_low_wan + salary_high_wan) AS salary_job_count, '{STAMP}' AS data_updated_at"""


def _packed_part(data: str, source: str, stat_type: str = "stat_type", part: str = "0", parts: str = "1") -> str:
    return f"""SELECT scope_id, {stat_type} AS stat_type, CAST({part} AS INTEGER) AS part,
                      CAST({parts} AS INTEGER) AS parts,
                      CAST(to_json({{'data': {data}, 'updated_at': '{STAMP}'}}) AS VARCHAR) AS payload
               FROM {source}"""


_MADE = "[" + ", ".join(f"'{t}'" for t in S.STAT_TYPES if t != "summary") + "]"
_NOTHING = f"""(SELECT scope_id, stat_type FROM (SELECT DISTINCT scope_id, unnest({_MADE}) AS stat_type FROM postings)
               ANTI JOIN cats USING (scope_id, stat_type)) AS lacking"""
_PACKED = "\nUNION ALL ".join(
    [
        _packed_part(_DATA, "cats WHERE stat_type <> 'city' GROUP BY scope_id, stat_type"),
        _packed_part(_CITY_DATA, "cats WHERE stat_type = 'city' GROUP BY scope_id, stat_type"),
        _packed_part("summed", f"(SELECT scope_id, struct_pack(job_count, company_count, city_count, average_annual_salary_wan,"
                     f" salary_job_count, data_updated_at) AS summed FROM (SELECT scope_id, {_SUMMARY_COLUMNS} FROM typed"
                     " GROUP BY scope_id)) AS s", "'summary'"),
        _packed_part("{'categories': [], 'values': []}", f"{_NOTHING} WHERE stat_type <> 'city'"),
        _packed_part(
            "{'categories': [], 'job_counts': [], 'average_salary_wan': []}", f"{_NOTHING} WHERE stat_type = 'city'"
        ),
    ]
)


@query(_PACKED)
def stat_packed(spark, sf_dir):
    """Payload text of all statistics."""
    return _payloads(spark, sf_dir)


# One scope without skills, readable dates and salaries.
_THIN = {"skills": "CAST(NULL AS STRING)", "salary_low": "'面议'", "salary_high": "'面议'", "publish_time": "'未知'"}
_THIN = {c: f"CASE WHEN scope_id = 'furniture' THEN {v} ELSE {c} END" for c, v in _THIN.items()}


@query()
def stat_thin(spark, sf_dir):
    """A scope that lacks whole statistics gets empty ones."""
    source = postings(spark, sf_dir)
    detail = typed(source.selectExpr(*[f"{_THIN[c]} AS {c}" if c in _THIN else c for c in source.columns]))
    return stats.statistics(detail, explode_skills(detail), STAMP)


ORACLES["stat_thin"] = (
    _CTE.replace("WITH postings AS (", "WITH whole AS (", 1).replace(
        "),\nraw AS (",
        f"),\npostings AS (SELECT * REPLACE ({', '.join(f'{v} AS {c}' for c, v in _THIN.items())}) FROM whole),\nraw AS (",
        1,
    )
    + f"\n{_PACKED}"
)

_PART_CATS = f"""(SELECT *, (row_number() OVER (PARTITION BY scope_id, stat_type ORDER BY {_STORED}) - 1) // 4 AS part,
                  ceil(count(*) OVER (PARTITION BY scope_id, stat_type) / 4) AS parts FROM cats WHERE stat_type <> 'city')"""


@query(_packed_part(_DATA, f"{_PART_CATS} GROUP BY scope_id, stat_type, part, parts", part="part", parts="parts"))
def stat_parts(spark, sf_dir):
    """Payload rows of at most four categories: part 0 holds the first ones of the stored order."""
    detail = typed_postings(spark, sf_dir)
    rows = stats.statistic_rows(stats.category_counts(detail), explode_skills(detail))
    return packing.pack(rows, STAMP, part_size=4).filter("stat_type <> 'city'")


@query("SELECT scope_id, stat_type, category, value, average_salary_wan FROM cats")
def stat_unpacked(spark, sf_dir):
    """All statistics packed to JSON and read back as rows."""
    return packing.unpack(_payloads(spark, sf_dir))


@query(
    f"""SELECT scope_id, part, {", ".join(f"max(CASE WHEN stat_type = '{t}' THEN payload END) AS {t}" for t in S.COMPANY_TYPES)}
        FROM ({_PACKED}) GROUP BY scope_id, part"""
)
def company_bundle(spark, sf_dir):
    return packing.bundle(_payloads(spark, sf_dir), S.COMPANY_TYPES)


# Text


# The markup steps of the page text, restated.
@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
              regexp_replace(replace(replace(replace(html, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;?', '&', 'g'),
              '<\s*br\s*/?\s*>', chr(10), 'gi'),
              '<\s*/?\s*(div|p|li|ul|ol)\b[^>]*>', chr(10), 'gi'),
              '<[^>]+>', '', 'g'), '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS content
       FROM pages"""
)
def plain_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.plain_text(F.col("html")).alias("content"))


@query(
    """SELECT raw_id, CASE WHEN coalesce(salary_low, '') = '' AND coalesce(salary_high, '') = '' THEN '面议'
                      ELSE coalesce(NULLIF(salary_low, ''), '—') || '–' || coalesce(NULLIF(salary_high, ''), '—') END
                      AS label FROM postings"""
)
def salary_label(spark, sf_dir):
    label = X.salary_label(F.col("salary_low"), F.col("salary_high"))
    return postings(spark, sf_dir).select("raw_id", label.alias("label"))


def _labelled(labels: dict[str, str]) -> str:
    return ", ".join(f"coalesce(NULLIF({c}, ''), '{d}') AS {c}" for c, d in labels.items())


_SALARY_LABEL = """CASE WHEN coalesce(salary_low, '') = '' AND coalesce(salary_high, '') = '' THEN '面议'
    ELSE coalesce(NULLIF(salary_low, ''), '—') || '–' || coalesce(NULLIF(salary_high, ''), '—') END AS salary"""
_PLAIN_LIST_FIELDS = ["job_uid", "job_name", "city", "company", "publish_time"]


@query(
    f"""SELECT {", ".join(f"{c} AS {S.LIST_FIELDS[c]}" for c in _PLAIN_LIST_FIELDS)},
               {_SALARY_LABEL}, {_labelled(S.LIST_LABELS)} FROM postings"""
)
def display_list(spark, sf_dir):
    return display.listing(filters.renamed(postings(spark, sf_dir), S.LIST_FIELDS))


@query(f"SELECT raw_id, {_labelled(S.DETAIL_LABELS)} FROM postings")
def default_labels(spark, sf_dir):
    return display.labelled(postings(spark, sf_dir), S.DETAIL_LABELS).select("raw_id", *S.DETAIL_LABELS)


@query(
    """SELECT raw_id, array_to_string(listed[1:12], '/') AS skills, listed[1] AS first_skill FROM (
           SELECT raw_id, [trim(x) FOR x IN string_split(skills, '|') IF trim(x) <> ''] AS listed FROM postings
       )"""
)
def skill_list(spark, sf_dir):
    listed = X.skill_list(F.col("skills"))
    return postings(spark, sf_dir).select(
        "raw_id", F.array_join(listed, "/").alias("skills"), F.get(listed, 0).alias("first_skill")
    )


@query(
    f"""SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '{S.TRUNCATED}' ELSE text END AS text
        FROM documents"""
)
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate(F.col("text"), 500).alias("text"))


@query(
    """SELECT doc_id, lang || ':' || source || ':' || sha256(text) AS cache_key FROM documents"""
)
def text_fingerprint(spark, sf_dir):
    key = X.key(F.col("lang"), F.col("source"), X.text_fingerprint(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("cache_key"))


@query(
    """SELECT raw_id, sha256(CAST(to_json({'city': city, 'company_type': company_type, 'education': education,
              'keyword': keyword, 'raw_id': raw_id}) AS VARCHAR)) AS fingerprint FROM postings"""
)
def row_fingerprint(spark, sf_dir):
    hashed = X.row_fingerprint("raw_id", "city", "education", "keyword", "company_type")
    return postings(spark, sf_dir).select("raw_id", hashed.alias("fingerprint"))


@query(
    """SELECT raw_id, sha256(CAST(to_json({'facets': [{'name': 'city', 'values': [city]}, {'name': 'education', 'values': [education]}],
              'keyword': keyword, 'page': {'number': CAST(raw_id AS BIGINT), 'size': 20}}) AS VARCHAR)) AS fingerprint FROM postings"""
)
def json_fingerprint(spark, sf_dir):
    """Nested parameters, their keys out of order, as a request brings them."""
    facet = lambda c: F.struct(F.array(c).alias("values"), F.lit(c).alias("name"))
    page = F.struct(F.lit(20).alias("size"), F.col("raw_id").cast("bigint").alias("number"))
    params = F.struct(page.alias("page"), F.col("keyword"), F.array(facet("city"), facet("education")).alias("facets"))
    return postings(spark, sf_dir).select("raw_id", X.json_fingerprint(F.to_json(params, P.KEEP_NULLS)).alias("fingerprint"))


# Serving


_HOT_FAULTS = {"education": "'{bad'", "experience": "'[1]'", "skills": "NULL"}
_DURABLE_FAULTS = {"financing": "'{bad'", "company_type": "NULL"}


def _with_faults(payloads: DataFrame, faults: dict[str, str]) -> DataFrame:
    cases = " ".join(f"WHEN stat_type = '{t}' THEN {v}" for t, v in faults.items())
    return payloads.withColumn("payload", F.expr(f"CASE {cases} ELSE payload END"))


def _tiers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(hot, durable) tiers with broken payloads; the hot one is newer and lacks some types."""
    store = new_store(spark)
    store.replace("statistic", _payloads(spark, sf_dir))
    payloads = store.read("statistic")
    newer = payloads.withColumn("payload", F.replace("payload", F.lit(STAMP), F.lit("2024-02-02 00:00:00")))
    hot = newer.filter(~F.col("stat_type").isin("industry", "company_type"))
    return _with_faults(hot, _HOT_FAULTS), _with_faults(payloads, _DURABLE_FAULTS)


def _fault_sql(source: str, faults: dict[str, str]) -> str:
    cases = " ".join(f"WHEN stat_type = '{t}' THEN {v}" for t, v in faults.items())
    return f"SELECT * REPLACE (CASE {cases} ELSE payload END AS payload) FROM ({source})"


_NEWER = f"""SELECT * REPLACE (replace(payload, '{STAMP}', '2024-02-02 00:00:00') AS payload) FROM ({_PACKED})
             WHERE stat_type NOT IN ('industry', 'company_type')"""
_SERVED = f"""SELECT coalesce(h.scope_id, d.scope_id) AS scope_id, coalesce(h.stat_type, d.stat_type) AS stat_type,
                     coalesce(h.part, d.part) AS part, coalesce(h.parts, d.parts) AS parts,
                     coalesce(h.payload, d.payload) AS payload
              FROM (SELECT * FROM ({_fault_sql(_NEWER, _HOT_FAULTS)})
                    WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE FALSE END) h
              FULL JOIN (SELECT * FROM ({_fault_sql(_PACKED, _DURABLE_FAULTS)}) WHERE json_valid(payload)) d
                ON h.scope_id = d.scope_id AND h.stat_type = d.stat_type"""


@query(_SERVED)
def serve_merge(spark, sf_dir):
    return serving.serve(*_tiers(spark, sf_dir))


_ASKED = "[" + ", ".join(f"'{t}'" for t in S.STAT_TYPES) + "]"


@query(
    f"""SELECT scope_id, stat_type FROM (SELECT DISTINCT scope_id, unnest({_ASKED}) AS stat_type FROM postings)
        ANTI JOIN ({_SERVED}) USING (scope_id, stat_type)"""
)
def coverage_gap(spark, sf_dir):
    scopes = postings(spark, sf_dir).select("scope_id").distinct()
    return serving.coverage_gap(scopes, serving.serve(*_tiers(spark, sf_dir)))


@query(
    f"""SELECT scope_id, max(NULLIF(json_extract_string(payload, '$.updated_at'), '')) AS updated_at
        FROM ({_SERVED}) GROUP BY scope_id"""
)
def latest_update(spark, sf_dir):
    return serving.latest_update(serving.serve(*_tiers(spark, sf_dir)))


_SUMMARY_FIELDS = [
    "job_count", "company_count", "city_count", "average_annual_salary_wan", "salary_job_count"
]


def _sorted_members(names: list[str]) -> str:
    """Spark writes the members of a parsed object in the order of their names, and whole numbers without `.0`."""
    return "json_object(" + ", ".join(f"'{n}', json_extract(data, '$.{n}')" for n in sorted(names)) + ")"


@query(
    f"""SELECT scope_id, stat_type, part, parts, regexp_replace(CAST(CASE stat_type
               WHEN 'city' THEN {_sorted_members(["categories", "job_counts", "average_salary_wan"])}
               WHEN 'summary' THEN {_sorted_members([*_SUMMARY_FIELDS, "data_updated_at"])}
               ELSE data END AS VARCHAR), '(\\d)\\.0([,}}\\]])', '\\1\\2', 'g') AS payload
        FROM (SELECT *, json_extract(payload, '$.data') AS data FROM ({_PACKED}))"""
)
def unwrap_payload(spark, sf_dir):
    return serving.unwrapped(_payloads(spark, sf_dir))


@query(
    """SELECT event_id, json_valid(doc) AS valid,
              CASE WHEN json_valid(doc) THEN json_type(doc) = 'OBJECT' ELSE FALSE END AS is_object
       FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN substr(props, 2)
                                   WHEN event_id % 7 = 0 THEN '[' || props || ']' ELSE props END AS doc FROM events)"""
)
def json_decode(spark, sf_dir):
    doc = F.expr(
        "CASE WHEN event_id % 5 = 0 THEN substr(props, 2) WHEN event_id % 7 = 0 THEN '[' || props || ']' ELSE props END"
    )
    docs = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    return docs.select(
        "event_id", P.is_json(F.col("doc")).alias("valid"), P.is_json_object(F.col("doc")).alias("is_object")
    )


# Context


def _json_members(fields: list[str], depth: int = 0) -> str:
    pad, end = "  " * (depth + 1), "  " * depth
    joined = f" || ',' || chr(10) || '{pad}' || ".join(fields)
    return f"'{{' || chr(10) || '{pad}' || {joined} || chr(10) || '{end}}}'"


def _json_items(items: str, depth: int, brackets: str = "[]") -> str:
    pad, end = "  " * (depth + 1), "  " * depth
    return (
        f"'{brackets[0]}' || chr(10) || '{pad}' || array_to_string({items}, ',' || chr(10) || '{pad}')"
        f" || chr(10) || '{end}{brackets[1]}'"
    )


def _first(expr: str) -> str:
    return f"list({expr} ORDER BY {_STORED})[1:30]"


_NAMES = f"""'"categories": ' || {_json_items(_first("CAST(to_json(category) AS VARCHAR)"), 3)}"""
_VALUES = _json_items(_first("CAST(value AS VARCHAR)"), 3)
_AVERAGES = _json_items(_first("coalesce(CAST(average_salary_wan AS VARCHAR), 'null')"), 3)
_SUMMARY = f"""SELECT scope_id, count(*) AS job_count,
               count(DISTINCT CASE WHEN trim(company) <> '' THEN company END) AS company_count,
               count(DISTINCT CASE WHEN trim(city) <> '' THEN city END) AS city_count,
               {_AVG} AS average_annual_salary_wan,
               count(salary_low_wan + salary_high_wan) AS salary_job_count
        FROM typed GROUP BY scope_id"""
_SUMMARY_BLOCK = _json_members(
    [f"""'"{c}": ' || coalesce(CAST({c} AS VARCHAR), 'null')""" for c in _SUMMARY_FIELDS]
    + [f"""'"data_updated_at": "{STAMP}"'"""],
    2,
)
_SAMPLE_BLOCK = _json_members(
    [f"""'"{n}": ' || coalesce(CAST(to_json({c}) AS VARCHAR), 'null')""" for c, n in S.LIST_FIELDS.items()], 2
)
_TYPE_ORDER = "list_position([" + ", ".join(f"'{t}'" for t in S.STAT_TYPES) + "], stat_type)"
_CONTEXT = _json_members(
    [
        """'"scope_id": "' || scope_id || '"'""",
        "'\"statistics\": ' || statistics",
        "'\"job_samples\": ' || samples",
    ]
)


@query(
    f"""SELECT scope_id, CASE WHEN length(t) > {S.CONTEXT_LIMIT}
               THEN substr(t, 1, {S.CONTEXT_LIMIT}) || '{S.CONTEXT_TRUNCATED}' ELSE t END AS context
        FROM (SELECT scope_id, {_CONTEXT} AS t FROM (
            SELECT scope_id, {_json_items(f"list('\"' || stat_type || '\": ' || block ORDER BY {_TYPE_ORDER})", 1, "{}")} AS statistics
            FROM (
                SELECT scope_id, stat_type, CASE WHEN stat_type = 'city'
                       THEN {_json_members([_NAMES, f"""'"job_counts": ' || {_VALUES}""", f"""'"average_salary_wan": ' || {_AVERAGES}"""], 2)}
                       ELSE {_json_members([_NAMES, f"""'"values": ' || {_VALUES}"""], 2)} END AS block
                FROM cats GROUP BY scope_id, stat_type
                UNION ALL SELECT scope_id, 'summary', {_SUMMARY_BLOCK} FROM ({_SUMMARY})
            ) GROUP BY scope_id
        ) JOIN (
            SELECT scope_id, {_json_items("list(block ORDER BY rn)", 1)} AS samples FROM (
                SELECT scope_id, rn, {_SAMPLE_BLOCK} AS block FROM (
                    SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY {_NEWEST}) AS rn FROM postings
                ) WHERE rn <= 5
            ) GROUP BY scope_id
        ) USING (scope_id))"""
)
def context_pack(spark, sf_dir):
    """Contexts from payloads; those of one statistic have no envelope."""
    bare = F.when(F.col("stat_type") == "education", F.to_json(P.unwrap(F.col("payload")))).otherwise(F.col("payload"))
    served = _payloads(spark, sf_dir).withColumn("payload", bare)
    return context.scope_context(
        context.statistic_blocks(served), context.sample_blocks(postings(spark, sf_dir))
    )


_JOB_FIELDS = [
    f"""'"{n}": ' || coalesce(CAST(to_json({c}) AS VARCHAR), 'null')""" for c, n in S.DETAIL_FIELDS.items()
]


@query(
    f"""SELECT job_uid AS job_id, {_json_members(_JOB_FIELDS)} AS context
        FROM (SELECT * REPLACE ({_PLAIN_DESCRIPTION}) FROM postings)"""
)
def job_context(spark, sf_dir):
    return context.detail_context(postings(spark, sf_dir))


# Entity assembly


_OF_COMPANY = ["company_size", "company_type", "financing", "industry"]
_OF_RECRUITER = ["recruiter_status", "recruiter_activity"]
_OF_POSTING = [c for c in S.SNAPSHOT.names if c not in _OF_COMPANY + _OF_RECRUITER]


@query(
    f"""SELECT {', '.join(f'p.{c}' for c in _OF_POSTING)}, {', '.join(f'c.{c}' for c in _OF_COMPANY)},
              r.recruiter_status, r.recruiter_activity
       FROM (SELECT *, CAST(raw_id AS BIGINT) % 150 AS recruiter_id FROM postings) p
       LEFT JOIN (SELECT * FROM postings QUALIFY row_number() OVER (
                      PARTITION BY company ORDER BY CAST(raw_id AS BIGINT) DESC) = 1) c ON c.company = p.company
       LEFT JOIN (SELECT l_suppkey, l_linestatus AS recruiter_status, l_returnflag AS recruiter_activity FROM lineitem
                  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 100 + l_linenumber DESC) = 1) r
              ON r.l_suppkey = p.recruiter_id"""
)
def wide_assembly(spark, sf_dir):
    """All columns of a snapshot. Every posting also is one version of its company; every line item is one of a recruiter."""
    source = postings(spark, sf_dir)
    posting = source.select(*_OF_POSTING, F.expr("CAST(raw_id AS BIGINT) % 150").alias("recruiter_id"))
    company = source.select("raw_id", "company", *_OF_COMPANY)
    recruiter = table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey * 100 + l_linenumber").alias("raw_id"),
        F.col("l_suppkey").alias("recruiter_id"),
        F.col("l_linestatus").alias("recruiter_status"),
        F.col("l_returnflag").alias("recruiter_activity"),
    )
    return assemble(posting, company, recruiter).select(*S.SNAPSHOT.names)


_CLEANED = ", ".join(f"NULLIF(trim({c}), '') AS {c}" for c in ["company", *_OF_COMPANY])


@query(
    f"""SELECT scope_id, {_CLEANED} FROM detail WHERE trim(company) <> ''
        QUALIFY row_number() OVER (PARTITION BY scope_id, trim(company) ORDER BY CAST(raw_id AS BIGINT) DESC) = 1"""
)
def clean_companies(spark, sf_dir):
    """The company table, made from the cleaned postings, written and read back."""
    store = new_store(spark)
    cleaned = latest_postings(clean(valid_postings(spark, sf_dir)).filter(filters.has_uid()))
    store.replace("clean_company", companies(cleaned))
    return store.read("clean_company").select("scope_id", "company", *_OF_COMPANY)


@query(
    """SELECT scope_id, job_uid, NULLIF(trim(recruiter_status), '') AS recruiter_status,
              NULLIF(trim(recruiter_activity), '') AS recruiter_activity FROM detail
       WHERE trim(recruiter_status) <> '' OR trim(recruiter_activity) <> ''"""
)
def clean_recruiters(spark, sf_dir):
    """The recruiter table, made from the cleaned postings, written and read back."""
    store = new_store(spark)
    cleaned = latest_postings(clean(valid_postings(spark, sf_dir)).filter(filters.has_uid()))
    store.replace("clean_recruiter", recruiters(cleaned))
    return store.read("clean_recruiter").select("scope_id", "job_uid", *_OF_RECRUITER)


# Incremental statistics


@query(ORACLES["stat_unpacked"].removeprefix(f"{_CTE}\n"))
def stat_incremental(spark, sf_dir):
    """Counts of a first state, in which postings are missing, moved or to be removed, and one update to all postings."""
    rows = typed_postings(spark, sf_dir)
    late, moved = F.col("raw_id") % 5 == 0, F.col("raw_id") % 7 == 0
    before = rows.filter(~late & moved).withColumns({"city": F.lit("elsewhere"), "salary_low_wan": F.lit(None).cast("decimal(10,2)")})
    extra = rows.filter(F.col("raw_id") % 11 == 0).withColumn("company", F.lit("closed"))
    store = new_store(spark)
    incremental.update(store, rows.filter(~late & ~moved).unionByName(before).unionByName(extra))
    incremental.update(store, rows.filter(late | moved), before.unionByName(extra))
    return packing.unpack(incremental.payloads(store.read("statistic_count"), STAMP))


@query(
    """SELECT scope_id, count(DISTINCT CASE WHEN trim(company) <> '' THEN company END) AS company_count,
              count(DISTINCT CASE WHEN trim(city) <> '' THEN city END) AS city_count FROM typed GROUP BY scope_id"""
)
def distinct_merged(spark, sf_dir):
    """Two loads of months, then those of the first once more; the counts come from the stored bitmaps of all months."""
    rows = typed_postings(spark, sf_dir).withColumn("publish_date", F.trunc("publish_date", "month"))
    odd = F.coalesce(F.month("publish_date") % 2 == 1, F.lit(False))
    store = new_store(spark)
    distinct.update(store, rows.filter(odd).withColumn("company", F.lit("replaced")))
    distinct.update(store, rows.filter(~odd))
    distinct.update(store, rows.filter(odd))
    return distinct.counted(distinct.bitmaps(store), "scope_id")
