"""SQL that the queries must equal, for DuckDB on the same Parquet tables."""

from __future__ import annotations

# -- roles, as common table expressions ----------------------------------------

CUSTOMER_NAME = "'Customer#' || lpad(CAST({0} AS VARCHAR), 9, '0')"

CODES = """codes AS (
  SELECT c_custkey AS pos, c_name AS name, '+' || c_nationkey AS dial_code,
         'C-' || c_custkey AS iso2, 'C-' || c_custkey AS code,
         CASE c_nationkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'abc'
              WHEN 2 THEN ' ' || c_nationkey || chr(9) WHEN 3 THEN '0x10'
              WHEN 5 THEN c_nationkey || '.5' END AS latitude,
         c_acctbal AS longitude
  FROM customer)"""

MASTER = """master AS (
  SELECT c_custkey AS pos, 'C-' || c_custkey AS iso2, c_name AS name, 'CUS' || c_custkey AS iso3,
         'U+' || c_nationkey AS unicode_flag,
         CASE c_nationkey WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE '+' || c_nationkey END AS dial_code,
         CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS currency,
         CASE WHEN c_acctbal < 0 THEN '' ELSE 'Capital ' || c_nationkey END AS capital,
         c_mktsegment AS continent
  FROM customer)"""

FLAGS = f"""flags AS (
  SELECT s_suppkey AS pos,
         CASE WHEN s_nationkey < 12 THEN ' ' || upper({CUSTOMER_NAME.format("s_suppkey * 20")}) || ' '
              ELSE lower({CUSTOMER_NAME.format("s_suppkey * 20")}) END AS name,
         CASE WHEN s_nationkey = 13 THEN '' ELSE 'https://flags.example/' || s_suppkey || '.svg' END AS flag,
         CAST(s_suppkey AS VARCHAR) AS number
  FROM supplier)"""

# Names are unique among customers, so a plain left join is a first match.
RICH_FLAGS = f"""{MASTER}, {FLAGS}, rich_flags AS (
  SELECT f.pos, f.name, f.flag, m.iso2, m.iso3
  FROM flags f LEFT JOIN master m ON lower(trim(f.name)) = lower(m.name))"""

REQUESTS = f"""requests AS (
  SELECT o_orderkey AS req_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN ''
              WHEN '3-MEDIUM' THEN chr(9) || upper({CUSTOMER_NAME.format("o_custkey")}) || ' '
              WHEN '4-NOT SPECIFIED' THEN 'Nowhere'
              WHEN '5-LOW' THEN {CUSTOMER_NAME.format("o_custkey")} END AS country,
         CASE WHEN o_orderstatus = 'F' THEN ' c-' || o_custkey
              WHEN o_orderstatus = 'O' THEN ''
              WHEN o_orderpriority = '5-LOW' THEN 'zz' END AS iso2
  FROM orders)"""

SERIES_REQUESTS = """requests AS (
  SELECT c_custkey AS req_id,
         CASE c_mktsegment WHEN 'BUILDING' THEN '' WHEN 'HOUSEHOLD' THEN chr(9) || upper(c_name) || ' '
              WHEN 'FURNITURE' THEN 'Nowhere' WHEN 'AUTOMOBILE' THEN c_name END AS country,
         CASE WHEN c_nationkey % 3 = 0 THEN ' c-' || c_custkey WHEN c_nationkey % 3 = 1 THEN ''
              WHEN c_mktsegment = 'AUTOMOBILE' THEN 'zz' END AS iso3
  FROM customer)"""

ORDER_FACTS = f"""facts AS (
  SELECT o_orderkey AS pos, {CUSTOMER_NAME.format("o_custkey")} AS country, 'C-' || o_custkey AS code,
         CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS value
  FROM orders)"""

ORDER_CITY_FACTS = f"""facts AS (
  SELECT o_orderkey AS pos, {CUSTOMER_NAME.format("o_custkey")} AS city, o_orderpriority AS country,
         CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS value, o_orderstatus AS sex,
         'R' || o_orderpriority AS reliabilty
  FROM orders)"""

NATION_FACTS = """facts AS (
  SELECT CAST(n_nationkey * 10000 + year(o_orderdate) AS BIGINT) AS pos, n_name AS country,
         'N' || n_nationkey AS code, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_nationkey, n_name, year(o_orderdate))"""

DOC_LINES = """lines AS (
  SELECT doc_id, lang, source, CAST(i - 1 AS INTEGER) AS idx, line
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(line, i))"""

# A country's states, each as code where there is one, and name; and with the id before.
CODED_LINES = "md5(string_agg(CASE WHEN line <> '' THEN 'L' || idx || ':' ELSE '' END || line, '|' ORDER BY idx))"
STATE_ROWS = "md5(string_agg(idx || ':' || CASE WHEN line <> '' THEN 'L' || idx || ':' ELSE '' END || line, '|' ORDER BY idx))"

DOC_WORDS = f"""{DOC_LINES}, words AS (
  SELECT doc_id, idx, j, word
  FROM lines, unnest(string_split(line, ' ')) WITH ORDINALITY AS t(word, j))"""

DOC_REQUESTS = """requests AS (
  SELECT doc_id AS req_id,
         CASE WHEN lang = 'de' THEN '' WHEN lang = 'en' THEN 'DOC ' || doc_id
              WHEN source = 'src0' THEN 'Doc ' || doc_id || ' ' WHEN source = 'src1' THEN 'Nowhere'
              ELSE 'Doc ' || doc_id END AS country,
         CASE WHEN lang = 'fr' THEN ' d-' || doc_id WHEN lang = 'es' AND source = 'src2' THEN 'zz' END AS iso2,
         CASE source WHEN 'src3' THEN '' WHEN 'src4' THEN 'LINE 1' WHEN 'src5' THEN 'line 0'
              ELSE 'Line 0 STATE' END AS state
  FROM documents)"""

HOT_PLACES = """requests AS (
  SELECT o_orderkey AS req_id, o_custkey % 8 AS kind, 'Line 0 STATE' AS state,
         CASE WHEN o_custkey % 8 < 4 THEN 'DOC ' || o_custkey % 8 WHEN o_custkey % 8 = 4 THEN 'Doc 4'
              WHEN o_custkey % 8 = 5 THEN 'Nowhere' END AS country,
         CASE WHEN o_custkey % 8 < 5 THEN o_custkey % 8 WHEN o_custkey % 8 = 7 THEN 3 END AS doc
  FROM orders)"""

HOT_CITIES = """requests AS (
  SELECT p.p_partkey AS req_id, CASE WHEN p.p_partkey % 7 = 6 THEN 'nowhere' ELSE s.p_name END AS asked
  FROM part p LEFT JOIN part s ON s.p_partkey = p.p_partkey % 7 AND s.p_partkey <= 5)"""

EVENT_REQUESTS = f"""requests AS (
  SELECT event_id AS req_id,
         CASE event_type WHEN 'click' THEN upper({CUSTOMER_NAME.format("user_id")})
              WHEN 'view' THEN {CUSTOMER_NAME.format("user_id")} END AS country,
         CASE event_type WHEN 'error' THEN 'zz' WHEN 'purchase' THEN 'c-' || user_id END AS iso2
  FROM events)"""


REPEATED_PLACES = """WITH firsts AS (SELECT c_mktsegment AS k, min(c_custkey) AS id FROM customer GROUP BY 1),
first_states AS (SELECT o_custkey AS id, lower(o_orderpriority) AS k, min(o_orderkey) AS state_id FROM orders GROUP BY 1, 2),
asked AS (
  SELECT c_custkey AS req_id, upper(c_mktsegment) AS country, c_mktsegment,
         CASE c_nationkey % 6 WHEN 0 THEN '1-urgent' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-medium'
              WHEN 3 THEN '4-NOT SPECIFIED' WHEN 4 THEN '5-LOW' ELSE 'none' END AS state
  FROM customer),
found AS (
  SELECT asked.*, s.state_id FROM asked JOIN firsts f ON f.k = c_mktsegment
  LEFT JOIN first_states s ON s.id = f.id AND s.k = lower(state))"""

HOT_REQUESTS = f"""requests AS (
  SELECT o_orderkey AS req_id, CASE WHEN o_custkey % 7 < 6 THEN {CUSTOMER_NAME.format("(o_custkey % 7 + 1)")} END AS name
  FROM orders)"""


def part_city_facts(null_name: str | None = None) -> str:
    city = f"CASE WHEN p_name <> '{null_name}' THEN p_name ELSE 'null' END" if null_name else "p_name"
    return f"""facts AS (
  SELECT p_partkey AS pos, {city} AS city, p_brand AS country, p_size AS year, p_retailprice AS value,
         p_type AS sex, 'R' || p_type AS reliabilty
  FROM part)"""


# -- shapes shared by several queries ------------------------------------------


def key(column: str) -> str:
    return f"lower(trim({column}, ' ' || chr(9)))"


def lookup(roles: str, dim: str, iso2: str, columns: str, found: str, not_found: str = "country not found",
           by_iso2: bool = True) -> str:
    """One left join per key on the first row of each key, then a choice by the given key."""
    first = "SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY pos) AS rn FROM {1}"
    given_iso2 = "coalesce(r.iso2, '') <> ''" if by_iso2 else "false"
    missing = "missing param (country or iso2)" if by_iso2 else "missing param (country)"
    names = [c.strip() for c in columns.split(",")]
    picked = ", ".join(
        f"CASE WHEN {given_iso2} THEN b.{c} WHEN coalesce(r.country, '') <> '' THEN a.{c} END AS {c}" for c in names
    )
    hit = f"CASE WHEN {given_iso2} THEN b.pos WHEN coalesce(r.country, '') <> '' THEN a.pos END"
    second = (
        f"LEFT JOIN ({first.format(key(iso2), dim)}) b ON {key('b.' + iso2)} = {key('r.iso2')} AND b.rn = 1"
        if by_iso2
        else f"LEFT JOIN {dim} b ON false"
    )
    return f"""WITH {roles}, hits AS (
  SELECT r.req_id, {given_iso2} OR coalesce(r.country, '') <> '' AS asked, {hit} AS hit, {picked}
  FROM requests r
  LEFT JOIN ({first.format(key("name"), dim)}) a ON {key("a.name")} = {key("r.country")} AND a.rn = 1
  {second})
SELECT req_id, CASE WHEN NOT asked THEN 400 WHEN hit IS NULL THEN 404 ELSE 200 END AS status,
       CASE WHEN NOT asked THEN '{missing}' WHEN hit IS NULL THEN '{not_found}' ELSE {found} END AS msg,
       {columns}
FROM hits"""


DIAL_FOUND = "name || ' dial code retrieved'"


def series_lookup(facts: str, name: str, other: str, fields: str, by_code: bool, missing: str, not_found: str,
                  found: str) -> str:
    asked = "coalesce(r.country, '') <> ''" + (" OR coalesce(r.iso3, '') <> ''" if by_code else "")
    by_name = f"{key('f.' + name)} = {key('r.country')}"
    body = f"""SELECT r.req_id, f.* FROM requests r JOIN facts f ON {by_name}
    WHERE coalesce(r.country, '') <> ''"""
    if by_code:
        body = f"""SELECT r.req_id, f.* FROM requests r JOIN facts f ON {key('f.code')} = {key('r.iso3')}
    WHERE coalesce(r.iso3, '') <> ''
    UNION ALL {body} AND coalesce(r.iso3, '') = ''"""
    return f"""WITH {SERIES_REQUESTS}, {facts},
heads AS (SELECT {name} AS entity, arg_min({other}, pos) AS first_other FROM facts GROUP BY {name}),
hits AS ({body})
SELECT r.req_id,
       CASE WHEN NOT ({asked}) THEN 400 WHEN h.req_id IS NULL THEN 404 ELSE 200 END AS status,
       CASE WHEN NOT ({asked}) THEN '{missing}' WHEN h.req_id IS NULL THEN '{not_found}' ELSE {found} END AS msg,
       h.{name}, heads.first_other AS {other}, h.pos, {", ".join("h." + f for f in fields.split(","))}
FROM requests r LEFT JOIN hits h ON r.req_id = h.req_id LEFT JOIN heads ON h.{name} = heads.entity"""


def city_report(facts: str, fields: str, order: str, where: str = "true", limit: str = "") -> str:
    """Heads per city, filtered, ordered, without a leading 'null', cut; then all their facts."""
    return f"""WITH {facts},
heads AS (SELECT city, arg_min(country, pos) AS country, arg_min(value, pos) AS first_value, min(pos) AS pos
          FROM facts GROUP BY city),
kept AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM heads WHERE {where}),
rest AS (SELECT * FROM kept WHERE NOT (place = 1 AND city = 'null')),
top AS (SELECT * FROM rest ORDER BY place {limit})
SELECT f.city, top.country, row_number() OVER (PARTITION BY f.city ORDER BY f.pos) - 1 AS idx, {fields}
FROM facts f JOIN top ON f.city = top.city"""


def merged(suppressed: str = "") -> str:
    skip = f"WHERE n_name NOT IN ({suppressed})" if suppressed else ""
    return f"""WITH both_sources AS (
  SELECT n_name AS country, c_mktsegment AS city, 1 AS source, c_custkey AS pos
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT n_name, CASE WHEN s_acctbal > 5000 THEN 'BUILDING' ELSE s_name END, 2, s_suppkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey {skip}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY country, city ORDER BY source, pos) AS rn FROM both_sources)
SELECT country, city, source, pos FROM ranked WHERE rn = 1"""


CUSTOMERS = "SELECT c_custkey AS pos, c_mktsegment AS country, c_acctbal AS value FROM customer"

POSITIONS = "SELECT pos, name, iso2, longitude AS long, latitude AS lat FROM codes"

NUMBER = """CASE WHEN trim(latitude, ' ' || chr(9)) = '' THEN 0 WHEN latitude = '0x10' THEN 16
     ELSE try_cast(trim(latitude, ' ' || chr(9)) AS DOUBLE) END"""


def cities_of(first_source: str = "true", suppressed: str = "false") -> str:
    """Lines of the document first, then its words, each once, in that order."""
    return f"""WITH {DOC_WORDS}, {DOC_REQUESTS},
found AS (
  SELECT r.*, d.doc_id FROM requests r LEFT JOIN documents d
  ON CASE WHEN coalesce(r.iso2, '') <> '' THEN lower(trim(r.iso2)) = 'd-' || d.doc_id
          ELSE lower(r.country) = 'doc ' || d.doc_id END
  AND r.req_id = d.doc_id),
members AS (
  SELECT doc_id, 1 AS source, idx AS a, 0 AS b, line AS city FROM lines WHERE {first_source}
  UNION ALL SELECT doc_id, 2, idx, j, word FROM words),
asked AS (
  SELECT f.req_id, m.city, m.source, m.a, m.b FROM found f JOIN members m ON f.doc_id = m.doc_id
  WHERE NOT (m.source = 2 AND ({suppressed}))),
once AS (
  SELECT *, row_number() OVER (PARTITION BY req_id, city ORDER BY source, a, b) AS rn FROM asked),
lists AS (
  SELECT req_id, CAST(count(*) AS INTEGER) AS n_cities, md5(string_agg(city, '|' ORDER BY source, a, b)) AS cities_md5
  FROM once WHERE rn = 1 GROUP BY req_id)
SELECT f.req_id,
       CASE WHEN coalesce(iso2, '') = '' AND coalesce(country, '') = '' THEN 400
            WHEN doc_id IS NULL THEN 404 ELSE 200 END AS status,
       CASE WHEN coalesce(iso2, '') = '' AND coalesce(country, '') = '' THEN 'missing param (country or iso2)'
            WHEN doc_id IS NULL THEN 'country not found'
            ELSE 'cities in Doc ' || doc_id || ' retrieved' END AS msg,
       CASE WHEN doc_id IS NOT NULL THEN coalesce(n_cities, 0) END AS n_cities,
       CASE WHEN doc_id IS NOT NULL THEN coalesce(cities_md5, md5('')) END AS cities_md5
FROM found f LEFT JOIN lists USING (req_id)"""


def rate() -> str:
    return """SELECT user_id AS client, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, count(*) - 5 AS rejected
FROM events GROUP BY 1, 2 HAVING count(*) > 5"""


STATE_CITIES_DIGEST = f"""WITH {DOC_WORDS}
SELECT doc_id AS pos, 'Doc ' || doc_id AS name, 'D-' || doc_id AS iso2, max(lang) AS iso3,
       CAST(count(DISTINCT idx) AS INTEGER) AS n_states, CAST(count(*) AS INTEGER) AS n_cities,
       md5(string_agg(word, '|' ORDER BY idx, j)) AS cities_md5
FROM words JOIN documents USING (doc_id) GROUP BY doc_id"""

ENRICHED_PARTS = """WITH firsts AS (
  SELECT p_name, min(p_partkey) AS k, arg_min(p_brand, p_partkey) AS iso3 FROM part GROUP BY p_name)
SELECT p.p_partkey, {iso2}{rest} FROM part p LEFT JOIN firsts f ON p.p_name = f.p_name"""

COUNTRY_SERIES = """SELECT country, first_value(code) OVER w AS code, first_value(code) OVER w AS iso3,
  row_number() OVER w - 1 AS idx, year, value FROM facts WINDOW w AS (PARTITION BY country ORDER BY pos)"""

CITY_SERIES = f"""WITH {part_city_facts()}
SELECT city, first_value(country) OVER w AS country, row_number() OVER w - 1 AS idx, year, value, sex, reliabilty
FROM facts WINDOW w AS (PARTITION BY city ORDER BY pos)"""


def year_report(year: str, where: str = "true") -> str:
    """First fact of the year per country; code and place from the first of any year."""
    return f"""WITH {ORDER_FACTS},
heads AS (SELECT country, arg_min(code, pos) AS code, min(pos) AS pos FROM facts GROUP BY country),
ranked AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY pos) AS rn FROM facts WHERE year = {year})
SELECT h.pos, h.country, h.code, r.year, r.value FROM heads h JOIN ranked r ON h.country = r.country AND rn = 1
WHERE r.value <> -1 AND {where}"""


DEFAULT_YEAR = "(SELECT arg_max(year, pos) FROM facts WHERE country = (SELECT arg_min(country, pos) FROM facts))"

SQL: dict[str, str] = {
    "project_positions": f"WITH {CODES} {POSITIONS}",
    "project_codes": f"WITH {CODES} SELECT pos, name, code, dial_code FROM codes",
    "project_currency": f"WITH {MASTER} SELECT pos, name, currency, iso2, iso3 FROM master",
    "project_unicode_flags": (
        f"WITH {MASTER} SELECT pos, name, iso2, iso3, unicode_flag AS unicodeFlag FROM master"
    ),
    "project_flag_images": f"WITH {RICH_FLAGS} SELECT pos, name, flag, iso2, iso3 FROM rich_flags",
    "project_iso": f"WITH {RICH_FLAGS} SELECT pos, name, iso2 AS iso_a2, iso3 AS iso_a3 FROM rich_flags",
    "project_rename": """SELECT s_suppkey AS pos, s_name AS name, s_nationkey AS code FROM supplier
UNION ALL SELECT CAST(-n_nationkey - 1 AS BIGINT), n_name, n_regionkey FROM nation""",
    "project_countries_and_cities": f"""WITH {DOC_LINES}
SELECT l.doc_id AS pos, 'Doc ' || l.doc_id AS country,
       CASE WHEN max(b.doc_id) IS NOT NULL THEN 'D-' || l.doc_id END AS iso2,
       'Q' || max(b.quality) AS iso3, CAST(count(*) AS INTEGER) AS n_cities,
       md5(string_agg(line, '|' ORDER BY idx)) AS cities_md5
FROM lines l LEFT JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id) b
  ON l.doc_id = b.doc_id GROUP BY l.doc_id""",
    "nested_projection": f"""WITH {DOC_LINES}
SELECT 'Doc ' || doc_id AS name, 'D-' || doc_id AS iso2, lang AS iso3, idx, md5(line) AS state_md5,
       CASE WHEN line <> '' THEN 'L' || idx END AS state_code FROM lines""",
    "project_state_cities": STATE_CITIES_DIGEST,
    "country_series": f"WITH {ORDER_FACTS} {COUNTRY_SERIES}",
    "country_series_totals": f"WITH {NATION_FACTS} {COUNTRY_SERIES}",
    "city_series_homonyms": CITY_SERIES,
    "city_series_in_parts": CITY_SERIES,
    "enrich_first_match": """SELECT c_custkey, ' nation_' || (c_custkey % 30) || ' ' AS country,
       n_nationkey AS nationkey, n_regionkey AS regionkey
FROM customer LEFT JOIN nation ON 'nation_' || (c_custkey % 30) = lower(trim(n_name))""",
    "enrich_duplicate_keys": ENRICHED_PARTS.format(iso2="'P-' || f.k AS iso2", rest=", f.iso3"),
    "enrich_from_placed": ENRICHED_PARTS.format(iso2="'P-' || f.k AS iso2", rest=", f.iso3"),
    "enrich_keeps_existing": ENRICHED_PARTS.format(
        iso2="CASE WHEN p_size > 25 THEN p_type END AS iso2", rest=", f.iso3"
    ),
    "enrich_stored_keys": ENRICHED_PARTS.format(iso2="'P-' || f.k AS iso2", rest=""),
    "lookup_dial_code": lookup(f"{CODES}, {REQUESTS}", "codes", "code", "name, code, dial_code", DIAL_FOUND),
    "lookup_position": lookup(
        f"{CODES}, {REQUESTS}, places AS ({POSITIONS})", "places", "iso2", "name, iso2, long, lat",
        "'country position retrieved'", not_found="Country not found",
    ),
    "lookup_currency": lookup(
        f"{MASTER}, {REQUESTS}", "master", "iso2", "name, currency, iso2, iso3", "name || ' and currency retrieved'"
    ),
    "lookup_iso": lookup(
        f"{RICH_FLAGS}, {REQUESTS}, iso AS (SELECT pos, name, iso2 AS iso_a2, iso3 AS iso_a3 FROM rich_flags)",
        "iso", "iso_a2", "name, iso_a2, iso_a3", "'country''s ISO code retrieved'", by_iso2=False,
    ),
    "lookup_capital": lookup(
        f"{MASTER}, {REQUESTS}", "master", "iso2", "name, capital, iso2, iso3", "'country and capitals retrieved'"
    ),
    "lookup_flag_image": lookup(
        f"{RICH_FLAGS}, {REQUESTS}", "rich_flags", "iso2", "name, flag, iso2, iso3", "name || ' and flag retrieved'"
    ),
    "lookup_unicode_flag": lookup(
        f"{MASTER}, {REQUESTS}, signs AS (SELECT pos, name, iso2, iso3, unicode_flag AS unicodeFlag FROM master)",
        "signs", "iso2", "name, iso2, iso3, unicodeFlag", "name || ' and unicode flag retrieved'",
    ),
    "lookup_states": lookup(
        f"""{DOC_LINES}, {DOC_REQUESTS}, docs AS (
  SELECT doc_id AS pos, 'Doc ' || doc_id AS name, 'D-' || doc_id AS iso2, max(lang) AS iso3,
         CAST(count(*) AS INTEGER) AS n_states, {CODED_LINES} AS states_md5
  FROM lines GROUP BY doc_id)""",
        "docs", "iso2", "name, iso2, iso3, n_states, states_md5", "'states in ' || name || ' retrieved'",
    ),
    "lookup_population": series_lookup(
        ORDER_FACTS, "country", "code", "year,value", True, "missing param (country or iso3)",
        "country data not found", "h.country || ' with population'",
    ),
    "lookup_city_population": series_lookup(
        ORDER_CITY_FACTS, "city", "country", "year,value,sex,reliabilty", False, "missing param (city)",
        "city data not found", "r.country || ' with population'",
    ),
    "lookup_population_answers": f"""WITH {ORDER_FACTS}, {HOT_REQUESTS},
heads AS (SELECT country, arg_min(code, pos) AS code FROM facts GROUP BY country)
SELECT req_id, CASE WHEN name IS NULL THEN 400 WHEN country IS NULL THEN 404 ELSE 200 END AS status,
       CASE WHEN name IS NULL THEN 'missing param (country or iso3)' WHEN country IS NULL THEN 'country data not found'
            ELSE country || ' with population' END AS msg, country, code
FROM requests LEFT JOIN heads ON name = country""",
    "lookup_population_facts": f"""WITH {ORDER_FACTS}, {HOT_REQUESTS}
SELECT country, pos, year, value FROM facts WHERE country IN (SELECT name FROM requests)""",
    "lookup_any_column": f"""WITH {CODES}, asked AS (
  SELECT o_orderkey AS req_id, CASE o_orderstatus WHEN 'F' THEN {CUSTOMER_NAME.format("o_custkey")}
    WHEN 'O' THEN upper({CUSTOMER_NAME.format("o_custkey")}) || ' '
    ELSE upper({CUSTOMER_NAME.format("o_custkey")}) END AS country FROM orders)
SELECT req_id, CASE WHEN name IS NULL THEN 404 ELSE 200 END AS status,
       CASE WHEN name IS NULL THEN 'country not found' ELSE 'successs' END AS msg, name, dial_code
FROM asked LEFT JOIN codes ON lower(name) = lower(country)""",
    "lookup_duplicate_names": """WITH firsts AS (
  SELECT p_name, min(p_partkey) AS k, arg_min(p_brand, p_partkey) AS brand FROM part GROUP BY p_name)
SELECT p_partkey AS req_id, 200 AS status, 'P-' || CASE WHEN p_size <= 10 THEN p_partkey ELSE k END || ' found' AS msg, 'P-' || CASE WHEN p_size <= 10 THEN p_partkey ELSE k END AS iso_a2,
       CASE WHEN p_size <= 10 THEN p_brand ELSE brand END AS iso_a3
FROM part JOIN firsts USING (p_name)""",
    "lookup_two_level": """WITH asked AS (
  SELECT CAST(n_nationkey AS BIGINT) AS req_id, lower(r_name) AS country, lower(n_name) AS state
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 1000 + r_regionkey, '', 'x' FROM region
  UNION ALL SELECT 2000 + r_regionkey, r_name, NULL FROM region
  UNION ALL SELECT 3000 + r_regionkey, r_name || ' ', 'nation_0' FROM region
  UNION ALL SELECT 4000 + r_regionkey, r_name, 'nation_99' FROM region),
found AS (
  SELECT a.*, r_regionkey, n_nationkey FROM asked a LEFT JOIN region ON lower(r_name) = lower(a.country)
  LEFT JOIN nation ON n_regionkey = r_regionkey AND lower(n_name) = lower(a.state))
SELECT req_id,
       CASE WHEN country = '' OR coalesce(state, '') = '' THEN 400 WHEN n_nationkey IS NULL THEN 404 ELSE 200 END AS status,
       CASE WHEN country = '' THEN 'missing param (country)' WHEN coalesce(state, '') = '' THEN 'missing param (state)'
            WHEN r_regionkey IS NULL THEN 'country not found' WHEN n_nationkey IS NULL THEN 'state not found'
            ELSE 'cities in state ' || state || ' of country ' || country || ' retrieved' END AS msg,
       c_custkey AS pos, c_name AS city
FROM found LEFT JOIN customer ON c_nationkey = n_nationkey""",
    "cities_in_state": f"""WITH {DOC_WORDS}, {DOC_REQUESTS},
states AS (
  SELECT doc_id, idx, CASE WHEN idx % 2 = 0 THEN 'line ' || idx || ' state' ELSE 'line ' || idx END AS state_key,
         CAST(count(*) AS INTEGER) AS n_cities, md5(string_agg(word, '|' ORDER BY j)) AS cities_md5
  FROM words GROUP BY doc_id, idx),
found AS (
  SELECT r.*, d.doc_id, s.idx, s.n_cities, s.cities_md5
  FROM requests r LEFT JOIN documents d ON lower(r.country) = 'doc ' || d.doc_id AND r.req_id = d.doc_id
  LEFT JOIN states s ON s.doc_id = d.doc_id AND s.state_key = lower(r.state))
SELECT req_id,
       CASE WHEN country = '' OR state = '' THEN 400 WHEN idx IS NULL THEN 404 ELSE 200 END AS status,
       CASE WHEN country = '' THEN 'missing param (country)' WHEN state = '' THEN 'missing param (state)'
            WHEN doc_id IS NULL THEN 'country not found' WHEN idx IS NULL THEN 'state not found'
            ELSE 'cities in state ' || state || ' of country ' || country || ' retrieved' END AS msg,
       CASE WHEN country <> '' AND state <> '' THEN n_cities END AS n_cities,
       CASE WHEN country <> '' AND state <> '' THEN cities_md5 END AS cities_md5
FROM found""",
    "lookup_two_level_duplicates": REPEATED_PLACES + """
SELECT req_id, CASE WHEN state_id IS NULL THEN 404 ELSE 200 END AS status,
       CASE WHEN state_id IS NULL THEN 'state not found'
            ELSE 'cities in state ' || state || ' of country ' || country || ' retrieved' END AS msg, state_id
FROM found""",
    "lookup_two_level_cities": REPEATED_PLACES + """
SELECT l_orderkey AS state_id, l_linenumber AS pos, l_partkey AS city FROM lineitem
WHERE l_orderkey IN (SELECT state_id FROM found)""",
    "cities_of_duplicates": f"""WITH {DOC_WORDS},
members AS (
  SELECT doc_id, 1 AS source, idx AS a, 0 AS b, line AS city FROM lines WHERE doc_id < 50
  UNION ALL SELECT doc_id, 2, idx, j, word FROM words WHERE doc_id < 50),
once AS (SELECT *, row_number() OVER (PARTITION BY doc_id, city ORDER BY source, a, b) AS rn FROM members),
lists AS (
  SELECT doc_id AS k, CAST(count(*) AS INTEGER) AS n_cities, md5(string_agg(city, '|' ORDER BY source, a, b)) AS cities_md5
  FROM once WHERE rn = 1 GROUP BY doc_id)
SELECT doc_id AS req_id, CASE WHEN k IS NULL THEN 404 ELSE 200 END AS status,
       CASE WHEN k IS NULL THEN 'country not found' ELSE 'cities in Doc ' || k || ' retrieved' END AS msg, n_cities, cities_md5
FROM documents LEFT JOIN lists ON k = doc_id % 60""",
    "cities_of": cities_of(),
    "cities_of_two_sources": cities_of(
        "doc_id IN (SELECT doc_id FROM labels)", "coalesce(f.country, '') IN ('Doc 7', 'Doc 8')"
    ),
    "states_answers": f"""WITH {HOT_PLACES}
SELECT req_id, CASE WHEN kind = 6 THEN 400 WHEN doc IS NULL THEN 404 ELSE 200 END AS status,
       CASE WHEN kind = 6 THEN 'missing param (country or iso2)' WHEN doc IS NULL THEN 'country not found'
            ELSE 'states in Doc ' || doc || ' retrieved' END AS msg,
       'Doc ' || doc AS name, lang AS iso3, 'D-' || doc AS iso2, doc AS list_id
FROM requests LEFT JOIN documents ON doc_id = doc""",
    "asked_states": f"""WITH {DOC_LINES}, {HOT_PLACES}
SELECT doc_id AS list_id, CAST(count(*) AS INTEGER) AS n_states, {CODED_LINES} AS states_md5
FROM lines WHERE doc_id IN (SELECT doc FROM requests) GROUP BY doc_id""",
    "state_answers": f"""WITH {HOT_PLACES}
SELECT req_id, CASE WHEN country IS NULL THEN 400 WHEN doc IS NULL THEN 404 ELSE 200 END AS status,
       CASE WHEN country IS NULL THEN 'missing param (country)' WHEN doc IS NULL THEN 'country not found'
            ELSE 'cities in state ' || state || ' of country ' || country || ' retrieved' END AS msg,
       CASE WHEN country IS NOT NULL THEN doc END AS row,
       CASE WHEN country IS NOT NULL AND doc IS NOT NULL THEN CAST(0 AS INTEGER) END AS nth
FROM requests""",
    "asked_state_cities": f"""WITH {DOC_WORDS}, {HOT_PLACES}
SELECT doc_id AS row, idx AS nth, CAST(count(*) AS INTEGER) AS n_cities, md5(string_agg(word, '|' ORDER BY j)) AS cities_md5
FROM words WHERE idx = 0 AND doc_id IN (SELECT doc FROM requests WHERE country IS NOT NULL) GROUP BY doc_id, idx""",
    "cities_answers": f"""WITH {HOT_PLACES}
SELECT req_id, CASE WHEN kind = 6 THEN 400 WHEN doc IS NULL THEN 404 ELSE 200 END AS status,
       CASE WHEN kind = 6 THEN 'missing param (country or iso2)' WHEN doc IS NULL THEN 'country not found'
            ELSE 'cities in Doc ' || doc || ' retrieved' END AS msg,
       doc AS one, CASE WHEN kind <> 4 THEN doc END AS two
FROM requests""",
    "asked_city_lists": f"""WITH {DOC_WORDS}, {HOT_PLACES},
asked AS (SELECT DISTINCT doc AS one, CASE WHEN kind <> 4 THEN doc END AS two FROM requests WHERE doc IS NOT NULL),
members AS (
  SELECT one, two, 1 AS source, idx AS a, 0 AS b, line AS city FROM asked JOIN lines ON doc_id = one
  UNION ALL SELECT one, two, 2, idx, j, word FROM asked JOIN words ON doc_id = two),
once AS (SELECT *, row_number() OVER (PARTITION BY one, two, city ORDER BY source, a, b) AS rn FROM members)
SELECT one, two, CAST(count(*) AS INTEGER) AS n_cities, md5(string_agg(city, '|' ORDER BY source, a, b)) AS cities_md5
FROM once WHERE rn = 1 GROUP BY one, two""",
    "lookup_city_answers": f"""WITH {part_city_facts()}, {HOT_CITIES},
heads AS (SELECT lower(city) AS k, arg_min(city, pos) AS city, arg_min(country, pos) AS country FROM facts GROUP BY lower(city))
SELECT req_id, CASE WHEN asked IS NULL THEN 400 WHEN city IS NULL THEN 404 ELSE 200 END AS status,
       CASE WHEN asked IS NULL THEN 'missing param (city)' WHEN city IS NULL THEN 'city data not found'
            ELSE upper(asked) || ' with population' END AS msg, city, country
FROM requests LEFT JOIN heads ON lower(asked) = k""",
    "lookup_city_facts": f"""WITH {part_city_facts()}, {HOT_CITIES}
SELECT city, pos, year, value, sex, reliabilty FROM facts WHERE city IN (SELECT asked FROM requests)""",
    "merge_nested_lists": """WITH words AS (
  SELECT conv_id, turn, 1 AS source, i, word
  FROM conversations, unnest(string_split(text, ' ')) WITH ORDINALITY AS t(word, i)
  UNION ALL
  SELECT conv_id, turn, 2, i, word
  FROM conversations, unnest(string_split(lower(text), ' ')) WITH ORDINALITY AS t(word, i)),
once AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, word ORDER BY source, i) AS rn FROM words)
SELECT conv_id, turn, CAST(count(*) AS INTEGER) AS n, md5(string_agg(word, '|' ORDER BY source, i)) AS merged_md5
FROM once WHERE rn = 1 GROUP BY conv_id, turn""",
    "range_inclusive": f"WITH {CODES} {POSITIONS} WHERE longitude BETWEEN 1000 AND 5000",
    "range_text_numbers": f"WITH {CODES} {POSITIONS} WHERE {NUMBER} BETWEEN 0 AND 16",
    "range_other_type": f"WITH {CODES} {POSITIONS}",
    "range_reversed": f"WITH {CODES} {POSITIONS} WHERE longitude BETWEEN 5000 AND 1000",
    "bounds_gt": f"WITH {ORDER_FACTS} SELECT * FROM facts WHERE value > 400000",
    "bounds_lt": f"WITH {ORDER_FACTS} SELECT * FROM facts WHERE value < 50000",
    "bounds_both": f"WITH {NATION_FACTS} SELECT * FROM facts WHERE value > 0 AND value < 25000000",
    "bounds_on_amounts": (
        "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_custkey < 1000"
    ),
    "name_contains": f"WITH {part_city_facts()} SELECT * FROM facts WHERE contains(lower(country), 'brand#1')",
    "drop_leading_null": city_report(part_city_facts("blue bolt"), "f.year, f.value", "upper(city) DESC, pos"),
    "drop_leading_null_by_value": city_report(part_city_facts("small ring"), "f.year, f.value", "first_value, pos"),
    "order_name_asc": CUSTOMERS,
    "order_name_dsc": CUSTOMERS,
    "order_name_other_word": CUSTOMERS,
    "order_value_asc": CUSTOMERS,
    "order_value_dsc": CUSTOMERS,
    "order_top": f"{CUSTOMERS} ORDER BY upper(country) DESC, pos LIMIT 100",
    "order_capitals": f"WITH {MASTER} SELECT pos, name, capital, iso2, iso3 FROM master",
    "limit_edge": f"""WITH ranked AS (SELECT *, row_number() OVER (ORDER BY value DESC, pos) AS place FROM ({CUSTOMERS}))
SELECT pos, country, value, 'none' AS kind FROM ranked
UNION ALL SELECT pos, country, value, 'huge' FROM ranked
UNION ALL SELECT pos, country, value, 'fraction' FROM ranked WHERE place <= 2
UNION ALL SELECT pos, country, value, 'blanks' FROM ranked WHERE place <= 3
UNION ALL SELECT pos, country, value, 'hex' FROM ranked WHERE place <= 4""",
    "limit_beyond_top_k": f"WITH {ORDER_FACTS} SELECT pos, country, value FROM facts ORDER BY value DESC, pos LIMIT 12000",
    "sample_rows": f"""WITH {CODES} SELECT name, dial_code, iso2, code, latitude, longitude FROM codes
ORDER BY md5('7:' || pos), pos LIMIT 10""",
    "merge_lists": merged(),
    "suppress_source": merged("'NATION_3', 'nation_4'"),
    "filter_population": f"""WITH {NATION_FACTS},
heads AS (SELECT country, min(pos) AS first, arg_min(code, pos) AS first_code FROM facts GROUP BY country)
SELECT first AS pos, country, first_code AS code, year, value FROM facts JOIN heads USING (country)
WHERE year = 1997 AND value > 0 AND value < 1000000000000 ORDER BY value DESC, first LIMIT 10""",
    "filter_population_all_years": year_report("1998", "r.value > 1000 AND r.value < 400000"),
    "filter_population_default_year": year_report(DEFAULT_YEAR),
    "filter_population_nested": (
        f"SELECT country, code, year, value FROM ({year_report('1996', 'r.value < 200000')})"
    ),
    "filter_population_no_figure": f"""WITH {ORDER_FACTS},
figures AS (
  SELECT facts.* REPLACE (CASE WHEN o_orderpriority = '1-URGENT' THEN -1.0 ELSE value END AS value)
  FROM facts JOIN orders ON pos = o_orderkey),
ranked AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY pos) AS rn FROM figures WHERE year = 1997),
heads AS (SELECT country, min(pos) AS first, arg_min(code, pos) AS first_code FROM facts GROUP BY country)
SELECT first AS pos, country, first_code AS code, year, value FROM ranked JOIN heads USING (country)
WHERE rn = 1 AND value <> -1""",
    "filter_population_by_folder": year_report("1999"),
    "latest_year": f"WITH {ORDER_FACTS} SELECT {DEFAULT_YEAR} AS year",
    "greatest_year": f"WITH {ORDER_FACTS} SELECT max(year) AS year FROM facts",
    "filter_city_population": city_report(
        part_city_facts(), "f.year, f.value, f.sex, f.reliabilty", "first_value DESC, pos",
        "contains(lower(country), 'brand#2')", "LIMIT 20",
    ),
    "filter_city_population_by_name": city_report(
        ORDER_CITY_FACTS, "f.year, f.value, f.sex, f.reliabilty", "upper(city) DESC, pos", limit="LIMIT 200"
    ),
    "country_info": f"""WITH {MASTER}, {FLAGS},
firsts AS (SELECT lower(name) AS k, arg_min(flag, pos) AS flag FROM flags GROUP BY 1)
SELECT pos, name, nullif(currency, '') AS currency, nullif(unicode_flag, '') AS unicode_flag,
       nullif(capital, '') AS capital, nullif(dial_code, '') AS dial_code, nullif(iso2, '') AS iso2,
       nullif(iso3, '') AS iso3, nullif(flag, '') AS flag
FROM master LEFT JOIN firsts ON lower(name) = k""",
    "country_info_lists": f"""WITH {DOC_LINES}
SELECT doc_id AS pos, CASE WHEN lang = 'en' THEN 'Doc ' ELSE 'DOC ' END || doc_id AS name,
       CASE WHEN lang = 'en' THEN CAST(count(*) AS INTEGER) END AS n_cities,
       CASE WHEN lang = 'en' THEN md5(string_agg(line, '|' ORDER BY idx)) END AS cities_md5,
       {STATE_ROWS} AS states_md5
FROM lines GROUP BY doc_id, lang""",
    "json_round_trip": f"""WITH {CODES} SELECT pos, name, dial_code, iso2, code, latitude,
       CAST(longitude AS VARCHAR) AS longitude FROM codes""",
    "facts_round_trip": f"WITH {ORDER_FACTS} SELECT * FROM facts",
    "city_facts_round_trip": f"WITH {ORDER_CITY_FACTS} SELECT * FROM facts",
    "nested_round_trip": STATE_CITIES_DIGEST,
    "flags_round_trip": f"WITH {FLAGS} SELECT pos, name, flag, number FROM flags",
    "master_round_trip": f"""WITH {MASTER}
SELECT pos, name, iso2, iso3, unicode_flag AS unicode, dial_code AS dial, currency, capital, continent FROM master""",
    "states_round_trip": f"""WITH {DOC_LINES}
SELECT doc_id AS pos, 'Doc ' || doc_id AS name, CAST(count(*) AS INTEGER) AS n_states, {STATE_ROWS} AS states_md5
FROM lines GROUP BY doc_id""",
    "lists_round_trip": f"""WITH {DOC_LINES}
SELECT doc_id AS pos, 'Doc ' || doc_id AS country, CAST(count(*) AS INTEGER) AS n_cities,
       md5(string_agg(line, '|' ORDER BY idx)) AS cities_md5
FROM lines GROUP BY doc_id""",
    "documents_round_trip": f"""WITH {CODES}
SELECT pos, name, dial_code, iso2, code, latitude, CAST(longitude AS DOUBLE) AS longitude FROM codes""",
    "file_order_round_trip": f"WITH {CODES} SELECT row_number() OVER (ORDER BY pos) - 1 AS nth, name FROM codes",
    "lookup_kept_answers": lookup(f"{CODES}, {REQUESTS}", "codes", "code", "name, code, dial_code", DIAL_FOUND),
    "rate_breaches": rate(),
    "rate_breaches_stream": rate(),
    "lookup_stream": lookup(f"{CODES}, {EVENT_REQUESTS}", "codes", "code", "name, code, dial_code", DIAL_FOUND),
    "lookup_stream_as_batch": lookup(
        f"{CODES}, {EVENT_REQUESTS}", "codes", "code", "name, code, dial_code", DIAL_FOUND
    ),
}

SQL["lookup_status"] = f"SELECT status, count(*) AS n FROM ({SQL['lookup_dial_code']}) GROUP BY status"
SQL["response_envelope"] = f"""SELECT req_id, status, status <> 200 AS error, msg, name, currency, iso2 AS iso_a2, iso3 AS iso_a3
FROM ({SQL['lookup_currency']})"""
