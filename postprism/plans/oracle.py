"""The same questions as plain SQL over the order tables, for checking results in another engine.

Each text states its query in full and independently of the DataFrame code: natural SQL where the library
uses a form made for scale.
"""

from __future__ import annotations

# Fixed values, stated here apart from the library's own: white space by code, and terms that are also ordinary words.
SPACES = (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ORDINARY = "r c go ai bi word flow sheets access express unify sas swift ruby julia dart crystal chef puppet".split()

ROLE = "1-URGENT"
FACT = """
job_postings_fact AS (
  SELECT o_orderkey AS job_id, o_custkey AS company_id, o_orderpriority AS job_title_short,
    o_orderpriority || ' ' || CAST(year(o_orderdate) AS VARCHAR) AS job_title,
    CASE WHEN o_orderstatus = 'O' THEN 'Anywhere' WHEN isodow(o_orderdate) = 7 THEN NULL
         WHEN o_orderstatus = 'F' THEN 'New York, NY' ELSE 'Chicago, IL' END AS job_location,
    'board ' || o_orderstatus AS job_via,
    CASE WHEN month(o_orderdate) = 1 THEN NULL WHEN month(o_orderdate) <= 5 THEN 'Full-time'
         WHEN month(o_orderdate) <= 8 THEN 'Internship' WHEN month(o_orderdate) <= 11 THEN 'Contractor'
         ELSE 'Part-time' END AS job_schedule_type,
    o_orderstatus = 'O' AS job_work_from_home,
    CASE WHEN o_orderstatus = 'F' THEN 'New York, NY' ELSE 'Chicago, IL' END AS search_location,
    o_orderdate AS job_posted_date, o_totalprice < 100000 AS job_no_degree_mention,
    o_totalprice > 300000 AS job_health_insurance,
    CASE WHEN isodow(o_orderdate) <> 7 THEN 'United States' END AS job_country,
    CASE WHEN isodow(o_orderdate) <= 2 THEN 'year' WHEN isodow(o_orderdate) = 3 THEN 'hour' END AS salary_rate,
    CASE WHEN isodow(o_orderdate) <= 2 THEN CAST(o_totalprice AS DECIMAL(12,2)) END AS salary_year_avg,
    CASE WHEN isodow(o_orderdate) = 3
         THEN CAST(CAST(round(o_totalprice) AS BIGINT) / 100.0 AS DECIMAL(10,2)) END AS salary_hour_avg
  FROM orders)"""
COMPANY = """
company_dim AS (SELECT c_custkey AS company_id, c_name AS name FROM customer)"""
PART_SKILL = """
part_skill AS (
  SELECT p_partkey, p_brand || ' ' || p_type AS skills,
    CAST(substr(p_brand, 7) AS BIGINT) * 10
    + CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4
                  WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END AS skill_id
  FROM part)"""
SKILL = """
skills_dim AS (SELECT DISTINCT skill_id, skills FROM part_skill)"""
BRIDGE = """
skills_job_dim AS (
  SELECT DISTINCT l_orderkey AS job_id, skill_id FROM lineitem JOIN part_skill ON p_partkey = l_partkey)"""
TABLES = ",".join([FACT, COMPANY, PART_SKILL, SKILL, BRIDGE])


def _population(name: str, fact: str) -> str:
    return f"""
{name} AS (SELECT * FROM {fact} WHERE job_title_short = '{ROLE}' AND job_work_from_home)"""


PAID = """
paid AS (SELECT *, CAST(salary_year_avg * 100 AS DOUBLE) AS cents FROM remote WHERE salary_year_avg IS NOT NULL)"""
PEOPLE = ",".join([FACT, _population("remote", "job_postings_fact"), PAID])


def _listed(name: str, postings: str, columns: str) -> str:
    return f"""
{name} AS (
  SELECT {columns}, skills AS skill FROM {postings} JOIN skills_job_dim USING (job_id) JOIN skills_dim USING (skill_id))"""


# All tables, and the skills of remote postings, of paid ones and of the ten best-paid.
STAR = ",".join(
    [
        TABLES,
        _population("remote", "job_postings_fact"),
        PAID,
        _listed("remote_skill", "remote", "job_id"),
        _listed("paid_skill", "paid", "cents"),
        "best AS (FROM paid ORDER BY cents DESC, job_id LIMIT 10)",
        _listed("best_skill", "best", "job_id"),
    ]
)


def _shares(hits: str, share: str) -> str:
    """Postings per skill of (job_id, skill) pairs and their share of the postings among the pairs."""
    return f"""
    SELECT skill, COUNT(*) AS postings,
      ROUND(100.0 * COUNT(*) / (SELECT COUNT(DISTINCT job_id) FROM {hits}), 1) AS {share}
    FROM {hits} GROUP BY skill"""


MEDIAN = "ROUND(quantile_cont(cents, 0.5) / 100, 0)"


def _skill_pay(floor: int) -> str:
    return f"""
    SELECT skill, COUNT(*) AS postings, ROUND(SUM(cents) / COUNT(*) / 100, 0) AS avg_salary, {MEDIAN} AS med_salary
    FROM paid_skill GROUP BY skill HAVING COUNT(*) >= {floor}"""


def _demand_and_pay() -> str:
    return f"""
    SELECT skill, postings, ROUND(100.0 * postings / (SELECT COUNT(*) FROM paid), 1) AS demand_pct, avg_salary, med_salary
    FROM ({_skill_pay(10)}) ORDER BY postings DESC, avg_salary DESC, skill LIMIT 20"""


def _near(alike: str) -> str:
    return f"""WITH {TABLES},
    listed AS (SELECT job_id, LIST(skill_id ORDER BY skill_id) AS ids FROM skills_job_dim GROUP BY job_id),
    alike AS (
      SELECT COUNT(*) AS n, COUNT(DISTINCT COALESCE(ids, [])) > 1 AS differ
      FROM job_postings_fact LEFT JOIN listed USING (job_id) GROUP BY {alike} HAVING COUNT(*) > 1)
    SELECT COUNT(*) AS near_duplicate_groups, CAST(SUM(n) AS BIGINT) AS near_duplicate_postings,
      COUNT(CASE WHEN differ THEN 1 END) AS groups_with_differing_skills,
      CAST(SUM(CASE WHEN differ THEN n END) AS BIGINT) AS postings_with_differing_skills
    FROM alike"""


def _integrity(prefix: str = "", more: str = "") -> str:
    """``prefix``: of the names of the tables to check; ``more``: their definitions."""
    keys = [
        ("company_dim", "company_id"),
        ("skills_dim", "skill_id"),
        ("job_postings_fact", "job_id"),
        ("skills_job_dim", "job_id, skill_id"),
    ]
    refs = [
        ("job_postings_fact", "company_id", "company_dim"),
        ("skills_job_dim", "job_id", "job_postings_fact"),
        ("skills_job_dim", "skill_id", "skills_dim"),
    ]
    required = [
        ("company_dim", "company_id"), ("company_dim", "name"), ("skills_dim", "skill_id"), ("skills_dim", "skills"),
        ("job_postings_fact", "job_id"), ("job_postings_fact", "company_id"),
        ("skills_job_dim", "job_id"), ("skills_job_dim", "skill_id"),
    ]
    parts = [
        f"SELECT 'primary key' AS \"check\", '{t}' AS table_name, '{k}' AS column_name, COUNT(*) AS violations "
        f"FROM (SELECT {k} FROM {prefix}{t} GROUP BY {k} HAVING COUNT(*) > 1)"
        for t, k in keys
    ]
    parts += [
        f"SELECT 'foreign key', '{t}', '{c}', COUNT(*) FROM {prefix}{t} a WHERE a.{c} IS NOT NULL "
        f"AND NOT EXISTS (SELECT 1 FROM {prefix}{r} b WHERE b.{c} = a.{c})"
        for t, c, r in refs
    ]
    parts += [f"SELECT 'not null', '{t}', '{c}', COUNT(*) FROM {prefix}{t} WHERE {c} IS NULL" for t, c in required]
    return f"WITH {TABLES}{more} " + " UNION ALL ".join(parts)


POSTING_COLUMNS = """job_title_short, job_title, job_location, job_via, job_schedule_type, job_work_from_home,
  search_location, job_posted_date, job_no_degree_mention, job_health_insurance, job_country, salary_rate,
  salary_year_avg, salary_hour_avg"""
POSTING_DOUBLES = POSTING_COLUMNS.replace("salary_year_avg", "CAST(salary_year_avg AS DOUBLE) AS salary_year_avg").replace(
    "salary_hour_avg", "CAST(salary_hour_avg AS DOUBLE) AS salary_hour_avg"
)
_YEAR = "CAST(salary_year_avg AS DOUBLE) AS salary_year_avg"
_DAMAGED = "(job_health_insurance AND salary_year_avg IS NOT NULL)"
_DAMAGED_YEAR = "CASE WHEN NOT job_health_insurance THEN CAST(salary_year_avg AS DOUBLE) END AS salary_year_avg"
WIDE = f"""{FACT}, {PART_SKILL},
lists AS (
  SELECT l_orderkey AS job_id, '[''' || string_agg(skills, ''', ''' ORDER BY skills) || ''']' AS job_skills
  FROM lineitem JOIN part_skill ON p_partkey = l_partkey GROUP BY 1),
named AS (
  SELECT {POSTING_COLUMNS}, CASE WHEN c_acctbal >= -900 THEN c_name END AS company_name, l.job_skills
  FROM job_postings_fact f JOIN customer ON c_custkey = f.company_id LEFT JOIN lists l ON l.job_id = f.job_id),
wide AS (SELECT * FROM named UNION ALL SELECT * FROM named WHERE job_schedule_type = 'Part-time')"""
KEYED = f"""{WIDE}, staged AS (SELECT DISTINCT * FROM wide),
postings AS (
  SELECT ROW_NUMBER() OVER (
    ORDER BY job_posted_date, job_title_short, job_title, company_name, job_location, job_via, salary_year_avg,
      job_skills, job_schedule_type, job_work_from_home, search_location, job_no_degree_mention,
      job_health_insurance, job_country, salary_rate, salary_hour_avg) AS job_id, *
  FROM staged)"""
PREPARED = f"""{KEYED},
company_dim AS (
  SELECT ROW_NUMBER() OVER (ORDER BY name) AS company_id, name
  FROM (SELECT DISTINCT company_name AS name FROM postings WHERE company_name IS NOT NULL)),
pairs AS (
  SELECT job_id, trim(item) AS skills
  FROM (SELECT job_id, unnest(string_split(translate(job_skills, '[]''', ''), ',')) AS item FROM postings)
  WHERE trim(item) <> ''),
skills_dim AS (
  SELECT ROW_NUMBER() OVER (ORDER BY skills) AS skill_id, skills FROM (SELECT DISTINCT skills FROM pairs)),
fact AS (
  SELECT p.job_id, c.company_id, {POSTING_COLUMNS} FROM postings p JOIN company_dim c ON c.name = p.company_name),
bridge AS (
  SELECT DISTINCT p.job_id, s.skill_id FROM pairs p JOIN skills_dim s ON s.skills = p.skills
  JOIN fact f ON f.job_id = p.job_id)"""

_SPACE = " || ".join(f"chr({code})" for code in SPACES)


def _plain(column: str) -> str:
    """Markup to text; the entities that occur in the tables are decoded, ampersand last."""
    text = f"regexp_replace({column}, '<[^>]+>', ' ', 'g')"
    for entity, sign in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"')):
        text = f"replace({text}, '{entity}', '{sign}')"
    return f"trim(regexp_replace({text}, '&amp;?', '&', 'g'), {_SPACE})"


TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
PAGES = f"""
records AS (
  SELECT page_id AS arrival, 'pages' AS source, nullif({_plain(TITLE)}, '') AS title,
    nullif(regexp_extract(url, '^https?://([^/]+)/', 1), '') AS company,
    nullif(regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1), '') AS location,
    url LIKE 'https:%' AS remote, CAST(NULL AS VARCHAR) AS schedule, CAST(NULL AS VARCHAR) AS posted,
    {_plain("html")} AS text, url
  FROM pages)"""
TITLE_WORDS = ("the", "nicht", "de", "and", "el")
ROLE_MATCH = r"regexp_matches(title, '(?i)(^|[^\pL\pN_])(the|nicht|de|and|el)($|[^\pL\pN_])')"
# Rules for the test titles, with the roles they give.
PAGE_RULES = (("nicht", "German"), ("the", "English"), ("que", "Romance"), ("de", "Romance"))
PART_RULES = (("small", "Small thing"), ("red", "Red thing"), ("ring", "Ring"), ("g", "Thing with g"))


def _classified(title: str, rules: tuple[tuple[str, str], ...], other: str) -> str:
    cases = " ".join(f"WHEN contains(lower({title}), '{phrase}') THEN '{name}'" for phrase, name in rules)
    return f"CASE {cases} ELSE '{other}' END"


CONFORMED = f"""{PAGES},
matched AS (SELECT * FROM records WHERE title IS NOT NULL AND {ROLE_MATCH}),
uniques AS (
  SELECT * FROM matched
  QUALIFY ROW_NUMBER() OVER (PARTITION BY lower(COALESCE(company, '')), lower(title) ORDER BY arrival) = 1),
numbered AS (SELECT ROW_NUMBER() OVER (ORDER BY arrival) AS job_id, * FROM uniques),
seen AS (SELECT COALESCE(company, 'Unknown') AS name, MIN(job_id) AS first FROM numbered GROUP BY 1),
companies AS (SELECT ROW_NUMBER() OVER (ORDER BY first) AS company_id, name FROM seen),
fact AS (
  SELECT n.job_id, c.company_id, {_classified("title", PAGE_RULES, "Other")} AS job_title_short, title AS job_title,
    CASE WHEN remote THEN 'Anywhere' ELSE location END AS job_location, source AS job_via,
    schedule AS job_schedule_type, remote AS job_work_from_home, location AS search_location,
    TIMESTAMP '2024-02-01 12:00:00' AS job_posted_date, CAST(NULL AS BOOLEAN) AS job_no_degree_mention,
    CAST(NULL AS BOOLEAN) AS job_health_insurance, CAST(NULL AS VARCHAR) AS job_country,
    CAST(NULL AS VARCHAR) AS salary_rate, CAST(NULL AS DOUBLE) AS salary_year_avg,
    CAST(NULL AS DOUBLE) AS salary_hour_avg
  FROM numbered n JOIN companies c ON c.name = COALESCE(n.company, 'Unknown'))"""
_AMBIGUOUS = ", ".join(f"'{word}'" for word in ORDINARY)
VOCABULARY = f"""
vocabulary AS (
  SELECT ROW_NUMBER() OVER (ORDER BY skills) AS skill_id, skills FROM (
    SELECT DISTINCT unnest(string_split_regex(lower(text), '[\\s.,]+')) AS skills FROM benchmark) WHERE skills <> ''),
usable AS (
  SELECT * FROM vocabulary
  WHERE skills NOT IN ({_AMBIGUOUS}) AND NOT (length(skills) < 3 AND regexp_matches(skills, '^\\pL+$')))"""


def _marked(text: str) -> str:
    """Text with chr(1) where a term may start and chr(2) where one may end, judged by the neighbouring sign."""
    outside = f"regexp_replace(lower({text}), '([^a-z0-9+#.])', chr(2) || '\\1' || chr(1), 'g')"
    return f"chr(1) || replace({outside}, '.', chr(2) || '.') || chr(2)"


def _found(texts: str, key: str) -> str:
    """Every text against every term: a marked text holds the marked term."""
    return f"""
    SELECT t.{key}, u.skill_id FROM (SELECT {key}, {_marked("text")} AS marked FROM {texts}) t
    JOIN (SELECT skill_id, {_marked("skills")} AS marked FROM usable) u ON contains(t.marked, u.marked)"""


_PAGE_FIELDS = f"""nullif(trim({TITLE}, {_SPACE}), '') AS title, nullif(regexp_extract(url, '^https?://([^/]+)/', 1), '') AS company,
  nullif(regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1), '') AS location"""


def oracle_sql() -> dict[str, str]:
    cut = "TIMESTAMP '1998-04-15 00:00:00'"
    halves = f"""older AS (FROM job_postings_fact WHERE job_posted_date < {cut}),
      newer AS (FROM job_postings_fact WHERE job_posted_date >= {cut}),
      {_population("older_remote", "older")}, {_population("newer_remote", "newer")},
      {_listed("older_skill", "older_remote", "job_id")}, {_listed("newer_skill", "newer_remote", "job_id")},
      b AS ({_shares("older_skill", "share")}), n AS ({_shares("newer_skill", "share")})"""
    top_paying = """
      SELECT job_id, job_title, name AS company_name, job_schedule_type, cents / 100 AS salary_year_avg,
        CAST(job_posted_date AS DATE) AS job_posted_date
      FROM best JOIN company_dim USING (company_id)"""
    skills_in_top = f"{_shares('best_skill', 'coverage_pct')} ORDER BY postings DESC, skill LIMIT 15"
    return {
        "top_paying": f"WITH {STAR} {top_paying}",
        "top_paying_marked": f"""WITH {STAR}, t AS ({top_paying})
            SELECT *, salary_year_avg = MAX(salary_year_avg) OVER () AS is_top FROM t""",
        "skills_in_top": f"WITH {STAR} {skills_in_top}",
        "skills_in_top_marked": f"WITH {STAR} SELECT *, postings >= 2 AS is_common FROM ({skills_in_top})",
        "skill_demand_top": f"WITH {STAR} {_shares('remote_skill', 'share_of_pct')} ORDER BY postings DESC, skill LIMIT 10",
        "skill_demand_all": f"WITH {STAR} {_shares('remote_skill', 'share_of_pct')}",
        "remote_skill_count": f"""WITH {STAR}
            SELECT skill_id, skill AS skill_name, COUNT(*) AS skill_count
            FROM remote_skill JOIN skills_dim ON skills = skill GROUP BY ALL ORDER BY skill_count DESC, skill_id LIMIT 5""",
        "demand_leaders": f"""WITH {STAR}, d AS ({_shares('remote_skill', 'share_of_pct')})
            SELECT skill, postings, share_of_pct, share_of_pct >= 3.0 AS is_leader,
              postings = MAX(postings) OVER () AS is_top,
              (SELECT COUNT(*) FROM d WHERE share_of_pct >= 3.0) AS leaders FROM d""",
        "pay_by_skill": f"WITH {STAR} {_skill_pay(10)} ORDER BY avg_salary DESC, skill LIMIT 10",
        "demand_and_pay": f"WITH {STAR} {_demand_and_pay()}",
        "pay_unguarded": f"""WITH {STAR}
            SELECT skill, postings, avg_salary FROM ({_skill_pay(1)}) ORDER BY avg_salary DESC, skill LIMIT 10""",
        "quadrants": f"""WITH {STAR}, t AS ({_demand_and_pay()}),
            m AS (SELECT MEDIAN(postings) AS demand_split, MEDIAN(avg_salary) AS pay_split FROM t)
            SELECT skill, postings, avg_salary, CAST(demand_split AS DOUBLE) AS demand_split, pay_split,
              CASE WHEN postings >= demand_split AND avg_salary >= pay_split THEN 'High demand, high pay'
                   WHEN postings >= demand_split THEN 'High demand, lower pay'
                   WHEN avg_salary >= pay_split THEN 'Niche, high pay' ELSE 'Niche, lower pay' END AS quadrant
            FROM t CROSS JOIN m""",
        "pay_distribution": f"""WITH {PEOPLE}
            SELECT COUNT(*) AS postings, MIN(cents) / 100 AS min_salary, quantile_cont(cents, 0.25) / 100 AS q1_salary,
              quantile_cont(cents, 0.5) / 100 AS median_salary, quantile_cont(cents, 0.75) / 100 AS q3_salary,
              MAX(cents) / 100 AS max_salary
            FROM paid""",
        "salary_outliers": f"""WITH {STAR}
            SELECT DISTINCT job_title, name AS company_name, job_via, cents / 100 AS salary_year_avg,
              ROUND(cents / (SELECT quantile_cont(cents, 0.5) FROM paid), 1) AS multiple_of_median
            FROM paid JOIN company_dim USING (company_id)
            ORDER BY salary_year_avg DESC, job_title, company_name, job_via LIMIT 5""",
        "outlier_effect": f"""WITH {PEOPLE}, marked AS (SELECT cents, cents = MAX(cents) OVER () AS is_top FROM paid)
            SELECT COUNT(*) AS postings, ROUND(SUM(cents) / COUNT(*) / 100, 0) AS avg_all, {MEDIAN} AS median_all,
              ROUND(SUM(CASE WHEN NOT is_top THEN cents END) / COUNT_IF(NOT is_top) / 100, 0) AS avg_excl_top,
              ROUND(MAX(cents) / 100, 0) AS max_salary
            FROM marked""",
        "population_funnel": f"""WITH {STAR}, flagged AS (
              SELECT job_title_short = '{ROLE}' AS is_role, job_id IN (SELECT job_id FROM remote) AS is_remote,
                salary_year_avg IS NOT NULL AS is_paid, job_id IN (SELECT job_id FROM skills_job_dim) AS is_listed
              FROM job_postings_fact),
            sizes AS (
              SELECT COUNT(*) AS "all postings", COUNT_IF(is_role) AS "1-urgent", COUNT_IF(is_remote) AS "1-urgent, remote",
                COUNT_IF(is_remote AND is_paid) AS "1-urgent, remote, salaried",
                COUNT_IF(is_remote AND is_listed) AS "1-urgent, remote, with skills",
                COUNT_IF(is_remote AND is_paid AND is_listed) AS "1-urgent, remote, salaried, with skills"
              FROM flagged)
            SELECT step, CAST(postings AS BIGINT) AS postings
            FROM (UNPIVOT sizes ON COLUMNS(*) INTO NAME step VALUE postings)""",
        "flag_equivalence": f"""WITH {FACT}, t AS (
              SELECT job_work_from_home, job_location = 'Anywhere' AS location_is_anywhere FROM job_postings_fact)
            SELECT *, COUNT(*) AS postings FROM t GROUP BY ALL""",
        "top_without_skills": f"""WITH {STAR}
            SELECT job_title, cents / 100 AS salary_year_avg,
              (SELECT COUNT(*) FROM skills_job_dim s WHERE s.job_id = best.job_id) AS skills_listed
            FROM best""",
        "near_duplicates": _near("job_title, company_id, job_location, job_via, job_posted_date"),
        "near_duplicates_by_role": _near("company_id, job_title_short, job_location"),
        "integrity_report": _integrity(),
        "integrity_report_damaged": _integrity(
            "d_",
            """,
            d_company_dim AS (SELECT c_custkey AS company_id, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS name
              FROM customer WHERE c_acctbal >= -900),
            d_skills_dim AS (SELECT * FROM skills_dim WHERE skills NOT LIKE '%BRASS'
              UNION ALL SELECT * FROM skills_dim WHERE skills LIKE 'Brand#1 %'),
            d_job_postings_fact AS (SELECT * FROM job_postings_fact
              UNION ALL SELECT * FROM job_postings_fact WHERE job_schedule_type = 'Part-time'),
            d_skills_job_dim AS (SELECT * FROM skills_job_dim UNION ALL SELECT * FROM skills_job_dim WHERE skill_id < 20
              UNION ALL SELECT job_id, NULL FROM job_postings_fact WHERE job_schedule_type = 'Part-time')""",
        ),
        "location_buckets": f"""WITH {FACT}, t AS (
              SELECT CASE job_location WHEN 'Anywhere' THEN 'Remote' WHEN 'New York, NY' THEN 'Local' ELSE 'Onsite' END
                AS location_category
              FROM job_postings_fact WHERE job_title_short = '{ROLE}')
            SELECT location_category, COUNT(*) AS number_of_jobs FROM t GROUP BY ALL""",
        "companies_without_degree": f"""WITH {FACT}, {COMPANY}
            SELECT company_id, name AS company_name FROM company_dim
            SEMI JOIN (FROM job_postings_fact WHERE job_no_degree_mention) USING (company_id)""",
        "company_counts": f"""WITH {FACT}, {COMPANY}
            SELECT name AS company_name, NULLIF(COUNT(job_id), 0) AS total_jobs
            FROM company_dim LEFT JOIN job_postings_fact USING (company_id) GROUP BY company_id, name""",
        "insured_in_quarter": f"""WITH {FACT}, {COMPANY}
            SELECT name, job_health_insurance, quarter(job_posted_date) AS job_posted_quarter
            FROM job_postings_fact JOIN company_dim USING (company_id)
            WHERE job_health_insurance AND month(job_posted_date) BETWEEN 4 AND 6""",
        "insured_by_company": f"""WITH {FACT}, {COMPANY}
            SELECT name, COUNT(*) AS job_count, CAST(2 AS BIGINT) AS job_posted_quarter
            FROM job_postings_fact JOIN company_dim USING (company_id)
            WHERE job_health_insurance AND month(job_posted_date) BETWEEN 4 AND 6 GROUP BY name""",
        "avg_by_schedule": f"""WITH {FACT}
            SELECT job_schedule_type,
              CAST(SUM(CAST(salary_year_avg * 100 AS BIGINT)) AS DOUBLE) / COUNT(salary_year_avg) / 100 AS avg_salary_year,
              CAST(SUM(CAST(salary_hour_avg * 100 AS BIGINT)) AS DOUBLE) / COUNT(salary_hour_avg) / 100 AS avg_salary_hour
            FROM job_postings_fact WHERE job_posted_date > '1996-06-01' GROUP BY job_schedule_type""",
        "postings_per_month": """
            SELECT EXTRACT(MONTH FROM ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS job_posted_month,
              COUNT(event_id) AS job_count FROM events GROUP BY 1""",
        "first_rows": "SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 10",
        "date_parts": """
            SELECT event_id, ts, ts AT TIME ZONE 'UTC' AT TIME ZONE 'EST' AS date_time, EXTRACT(WEEK FROM ts) AS date_week,
              EXTRACT(MONTH FROM ts) AS date_month, EXTRACT(YEAR FROM ts) AS date_year FROM events""",
        "month_partition": f"""WITH {FACT}
            SELECT job_id, company_id, {POSTING_DOUBLES}, EXTRACT(MONTH FROM job_posted_date) AS posted_month
            FROM job_postings_fact WHERE EXTRACT(MONTH FROM job_posted_date) = 2""",
        "month_union": f"""WITH {FACT}
            SELECT job_title_short, company_id, job_location FROM job_postings_fact WHERE quarter(job_posted_date) = 1""",
        "quarter_top": f"""WITH {FACT}
            SELECT job_title_short, job_location, job_via, CAST(job_posted_date AS DATE) AS job_posted_date,
              CAST(salary_year_avg AS DOUBLE) AS salary_year_avg
            FROM job_postings_fact
            WHERE quarter(job_posted_date) = 1 AND job_title_short = '{ROLE}' AND salary_year_avg > 70000""",
        "full_row_dedup": "SELECT DISTINCT text, lang FROM documents",
        "full_row_dedup_lines": "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem",
        "read_postings_csv": f"WITH {WIDE} SELECT {POSTING_DOUBLES}, company_name, job_skills FROM wide",
        "read_postings_csv_parts": f"""WITH {WIDE}
            SELECT {POSTING_DOUBLES}, company_name, job_skills
            FROM (SELECT * REPLACE ('"' || job_title || '", noted' || chr(10) || job_via AS job_title) FROM wide)""",
        "read_postings_csv_extra": f"""WITH {WIDE}
            SELECT {POSTING_DOUBLES.replace(_YEAR, _DAMAGED_YEAR)}, company_name, job_skills, job_title || ' noted' AS note,
              CASE WHEN {_DAMAGED} THEN '{{"salary_year_avg":"$' || CAST(salary_year_avg AS VARCHAR) || '"}}' END AS _rejected
            FROM wide""",
        "load_audit_csv": f"""WITH {PREPARED}
            SELECT 'source rows' AS metric, COUNT(*) AS rows FROM wide
            UNION ALL SELECT 'with rejected values', COUNT(*) FROM wide WHERE {_DAMAGED}
            UNION ALL SELECT 'duplicates removed', (SELECT COUNT(*) FROM wide) - (SELECT COUNT(*) FROM staged)
            UNION ALL SELECT 'no company, dropped', COUNT(*) FROM staged WHERE company_name IS NULL
            UNION ALL SELECT 'company_dim', COUNT(*) FROM company_dim
            UNION ALL SELECT 'skills_dim', COUNT(*) FROM skills_dim
            UNION ALL SELECT 'job_postings_fact', COUNT(*) FROM fact
            UNION ALL SELECT 'skills_job_dim', COUNT(*) FROM bridge""",
        "write_star": f"""WITH {TABLES}
            SELECT job_id, name AS company_name, skills AS skill, CAST(salary_year_avg AS DOUBLE) AS salary_year_avg
            FROM job_postings_fact JOIN company_dim USING (company_id) LEFT JOIN skills_job_dim USING (job_id)
            LEFT JOIN skills_dim USING (skill_id)""",
        "surrogate_key": f"WITH {KEYED} SELECT job_id, {POSTING_DOUBLES}, company_name, job_skills FROM postings",
        "company_dimension": f"WITH {PREPARED} SELECT company_id, name FROM company_dim",
        "skill_dimension": f"WITH {PREPARED} SELECT skill_id, skills FROM skills_dim",
        "explode_skills": f"WITH {PREPARED} SELECT job_id, skills FROM pairs",
        "build_fact": f"WITH {PREPARED} SELECT job_id, company_id, {POSTING_DOUBLES} FROM fact",
        "build_bridge": f"WITH {PREPARED} SELECT job_id, skill_id FROM bridge",
        "load_audit": f"""WITH {PREPARED}
            SELECT 'source rows' AS metric, COUNT(*) AS rows FROM wide
            UNION ALL SELECT 'with rejected values', 0
            UNION ALL SELECT 'duplicates removed', (SELECT COUNT(*) FROM wide) - (SELECT COUNT(*) FROM staged)
            UNION ALL SELECT 'no company, dropped', COUNT(*) FROM staged WHERE company_name IS NULL
            UNION ALL SELECT 'company_dim', COUNT(*) FROM company_dim
            UNION ALL SELECT 'skills_dim', COUNT(*) FROM skills_dim
            UNION ALL SELECT 'job_postings_fact', COUNT(*) FROM fact
            UNION ALL SELECT 'skills_job_dim', COUNT(*) FROM bridge""",
        "load_audit_tables": f"""WITH {PREPARED}
            SELECT 'source rows' AS metric, COUNT(*) AS rows FROM wide
            UNION ALL SELECT 'with rejected values', 0
            UNION ALL SELECT 'duplicates removed', (SELECT COUNT(*) FROM wide) - (SELECT COUNT(*) FROM staged)
            UNION ALL SELECT 'no company, dropped', COUNT(*) FROM staged WHERE company_name IS NULL
            UNION ALL SELECT 'company_dim', COUNT(*) FROM company_dim
            UNION ALL SELECT 'skills_dim', COUNT(*) FROM skills_dim
            UNION ALL SELECT 'job_postings_fact', COUNT(*) FROM fact
            UNION ALL SELECT 'skills_job_dim', COUNT(*) FROM bridge""",
        "date_span": f"""WITH {PREPARED}
            SELECT CAST(MIN(job_posted_date) AS DATE) AS first_date, CAST(MAX(job_posted_date) AS DATE) AS last_date FROM fact""",
        "clean_text": f"""
            SELECT page_id, nullif(trim(regexp_replace(html, '<[^>]+>', ' ', 'g'), {_SPACE}), '') AS cleaned FROM pages""",
        "strip_markup": f"SELECT page_id, {_plain('html')} AS text FROM pages",
        "conform_feed": f"""
            SELECT 'arbeitnow' AS source, {_PAGE_FIELDS}, url LIKE 'https:%' AS remote, 'full|' || page_id AS schedule,
              CAST(page_id AS VARCHAR) AS posted, {_plain("html")} AS text, url FROM pages
            UNION ALL
            SELECT 'jobicy', nullif(trim(text, {_SPACE}), ''), source, lang, TRUE,
              CASE WHEN lang = 'en' THEN source || '|' || lang END, CAST(n_chars AS VARCHAR), {_plain("text")},
              'doc:' || doc_id FROM documents
            UNION ALL
            SELECT 'remoteok', title, company, location, TRUE, NULL, '2024-01-05T00:00:00', text, url
            FROM (SELECT {_PAGE_FIELDS}, {_plain("html")} AS text, url FROM pages)
            UNION ALL
            SELECT 'himalayas', lang, source, CASE WHEN lang = 'en' THEN lang || '|' || source END, TRUE, NULL,
              CAST(n_chars AS VARCHAR), {_plain("text")}, 'doc:' || doc_id FROM documents""",
        "feed_audit": """
            SELECT s.source, n.files, CAST(0 AS BIGINT) AS unreadable, n.records, CAST(NULL AS VARCHAR) AS problem
            FROM (VALUES ('arbeitnow', 'pages'), ('jobicy', 'documents'), ('remoteok', 'pages'), ('himalayas', 'documents'))
              s(source, rows_from)
            JOIN (SELECT 'pages' AS rows_from, COUNT(DISTINCT page_id // 500) AS files, COUNT(*) AS records FROM pages
                  UNION ALL SELECT 'documents', COUNT(DISTINCT doc_id // 500), COUNT(*) FROM documents) n
              ON n.rows_from = s.rows_from""",
        "role_filter": f"WITH {PAGES} SELECT arrival, title FROM records WHERE title IS NOT NULL AND {ROLE_MATCH}",
        "classify_title": f"""
            SELECT p_partkey, p_name, {_classified("p_name", PART_RULES, "Other")} AS role FROM part""",
        "keep_first_dedup": """
            SELECT doc_id, lang, text FROM documents
            QUALIFY ROW_NUMBER() OVER (PARTITION BY lower(COALESCE(lang, '')), lower(text) ORDER BY doc_id) = 1""",
        "conform_funnel": f"""WITH {CONFORMED}
            SELECT 'fetched' AS stage, COUNT(*) AS postings FROM records
            UNION ALL SELECT 'role-matched', COUNT(*) FROM matched
            UNION ALL SELECT 'unique', COUNT(*) FROM uniques""",
        "extract_terms_shuffled": f"WITH {VOCABULARY} {_found('documents', 'doc_id')}",
        "posting_dates": """
            SELECT o_orderpriority AS source, COUNT(*) AS stated, COUNT(*) FILTER (WHERE o_orderstatus <> 'P') AS readable,
              COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS unreadable, CAST(0 AS BIGINT) AS missing
            FROM orders GROUP BY 1""",
        "posting_times": """
            SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS posted FROM orders""",
        "extract_terms": f"WITH {VOCABULARY} {_found('documents', 'doc_id')}",
        "first_seen_dimension": """
            SELECT ROW_NUMBER() OVER (ORDER BY first) AS company_id, name
            FROM (SELECT COALESCE(source, 'Unknown') AS name, MIN(doc_id) AS first FROM documents GROUP BY 1)""",
        "conform_fact": f"WITH {CONFORMED} SELECT * FROM fact",
        "coverage_report": f"""WITH {CONFORMED}, {VOCABULARY}, hits AS ({_found('numbered', 'job_id')}),
            n AS (SELECT (SELECT COUNT(*) FROM fact) AS a, (SELECT COUNT(DISTINCT job_id) FROM hits) AS l,
                         (SELECT COUNT(salary_year_avg) FROM fact) AS p)
            SELECT 'postings' AS metric, a AS postings, CAST(NULL AS DOUBLE) AS pct FROM n
            UNION ALL SELECT 'with skills', l, ROUND(100.0 * l / a, 0) FROM n
            UNION ALL SELECT 'with salary', p, ROUND(100.0 * p / a, 0) FROM n
            UNION ALL SELECT 'source ' || job_via, COUNT(*), NULL FROM fact GROUP BY job_via""",
        "append_history": """
            SELECT 1 AS collection_id, event_id, ts, user_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00'
            UNION ALL
            SELECT 2, event_id, ts, user_id FROM events
            WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND event_id NOT IN (
              SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00')""",
        "append_history_indexed": """
            SELECT 1 AS collection_id, event_id, ts, user_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00'
            UNION ALL
            SELECT 2, event_id, ts, user_id FROM events
            WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND event_id NOT IN (
              SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00')""",
        "update_by_month": """
            SELECT o_orderkey AS job_id, month(o_orderdate) AS posted_month,
              CASE WHEN month(o_orderdate) <= 3 AND o_totalprice > 300000 THEN 'board X' ELSE 'board ' || o_orderstatus END AS job_via
            FROM orders""",
        "compare_demand": f"""WITH {TABLES}, {halves}
            SELECT skill, b.postings AS postings_base, n.postings AS postings_new, COALESCE(b.share, 0) AS share_base,
              COALESCE(n.share, 0) AS share_new, GREATEST(share_base, share_new) AS rank_on,
              (SELECT COUNT(DISTINCT job_id) FROM older_skill) AS n_base,
              (SELECT COUNT(DISTINCT job_id) FROM newer_skill) AS n_new
            FROM b FULL JOIN n USING (skill) WHERE skill NOT IN ('Brand#1 LARGE', 'Brand#2 SMALL')
            ORDER BY rank_on DESC, skill LIMIT 10""",
        "table_changes": """
            SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice,
              CAST(o_orderdate AS DATE) AS o_orderdate,
              CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END AS contact_name
            FROM orders JOIN customer ON c_custkey = o_custkey""",
        "stream_intake": "SELECT 1 AS collection_id, event_id, ts, user_id, event_type FROM events",
        "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
        "stream_dedup_history": """
            SELECT MIN(event_id) AS event_id, user_id, event_type FROM events
            GROUP BY user_id, event_type HAVING COUNT(*) FILTER (ts < TIMESTAMP '2024-01-10 00:00:00') = 0""",
        "stream_trend": """WITH c AS (
              SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01 00:00:00') AS window_start, event_type AS item,
                COUNT(*) AS postings FROM events GROUP BY 1, 2)
            SELECT window_start, item, postings,
              ROUND(100.0 * postings / SUM(postings) OVER (PARTITION BY window_start), 1) AS share_of_pct FROM c""",
        "demand_trend": f"""WITH {STAR}, dated AS (
              SELECT time_bucket(INTERVAL '7 days', job_posted_date, TIMESTAMP '1970-01-01 00:00:00') AS window_start,
                job_id, skill
              FROM remote_skill JOIN remote USING (job_id)),
            whole AS (SELECT window_start, COUNT(DISTINCT job_id) AS n FROM dated GROUP BY 1)
            SELECT window_start, skill, COUNT(*) AS postings, ROUND(100.0 * COUNT(*) / MAX(n), 1) AS share_of_pct
            FROM dated JOIN whole USING (window_start) GROUP BY window_start, skill""",
    }
