"""DuckDB SQL of the core queries, built from the same rule tables."""

from __future__ import annotations

from rankloom.functions import rules as R
from rankloom.functions.rules import lit_sql, quote
from rankloom.functions.text import squeeze_sql as squeeze
from rankloom.functions.text import strip_sql as strip

def missing(x: str) -> str:
    return f"CASE WHEN coalesce(lower({strip(x)}), '') IN ('', 'nan', 'none', 'null') THEN NULL ELSE {strip(x)} END"


PEOPLE = f"""
WITH people AS (
  SELECT 'p' || row_id AS id, row_id AS ord, CASE WHEN nm = '' THEN 'Unknown' ELSE nm END AS full_name,
         regexp_replace(coalesce({missing('"Designation"')}, ''), '(?i)\\s+at\\s+\\S.*$', '') AS designation,
         coalesce({missing('"Company"')}, '') AS company, coalesce({missing('"LinkedInURL"')}, '') AS linkedin_url,
         coalesce({missing('"Location"')}, '') AS location,
         {strip(f"regexp_extract(coalesce({missing(chr(34) + 'Location' + chr(34))}, ''), '[^,/]*$')")} AS country,
         coalesce({missing('"Industry_Hint"')}, '') AS industry_hint
  FROM (SELECT *, {squeeze(f"concat_ws(' ', {missing(chr(34) + 'FirstName' + chr(34))}, {missing(chr(34) + 'LastName' + chr(34))})")} AS nm FROM test_data)
)"""

CURRENT = PEOPLE + f""",
cur AS (SELECT * FROM people WHERE NOT regexp_matches(lower(designation), {quote(R.FORMER)}) AND NOT (full_name = 'Unknown' AND designation = ''))"""


def acronym(title: str, table: R.Lookup) -> str:
    t = f"lower({strip(title)})"
    for _ in range(3):
        t = f"regexp_replace(regexp_replace({t}, {quote(R.ACRONYM_SUFFIX)}, ''), '^[ ,|–-]+|[ ,|–-]+$', '', 'g')"
    return table.sql(t)


def layer(title: str, financial: bool = False) -> str:
    low = f"regexp_replace(lower({strip(title)}), {quote(R.OFFICE_OF)}, ' ', 'g')"
    rules, acr = (R.FINANCIAL_LAYERS, R.FINANCIAL_ACRONYMS) if financial else (R.CORPORATE_LAYERS, R.ACRONYMS)
    return f"CASE WHEN {low} = '' THEN 10 ELSE coalesce({acronym(title, acr)}, {rules.sql(low, 10)}) END"


KEYWORDS = ", ".join(f"({i}, {quote(d)}, {quote(w)}, {n})" for i, (d, ws) in enumerate(R.DEPARTMENTS) for w, n in ws)

SCORES = CURRENT + f""",
kw AS (SELECT * FROM (VALUES {KEYWORDS}) k(nth, dept, word, weight)),
depts AS (SELECT DISTINCT nth, dept FROM kw),
titles AS (SELECT DISTINCT designation FROM cur),
scored AS (
  SELECT t.designation, d.nth, d.dept, coalesce(sum(CASE WHEN contains(lower(t.designation), k.word) THEN k.weight END), 0)::INT AS score
  FROM titles t CROSS JOIN depts d JOIN kw k USING (nth) GROUP BY ALL
),
ranked AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM scored WINDOW w AS (PARTITION BY designation ORDER BY score DESC, nth)),
best AS (SELECT designation, dept, score, score - second AS gap FROM ranked WHERE rn = 1)"""

_BARE = f"CASE WHEN NOT regexp_matches(lower({strip('designation')}), {quote(R.SENIORITY_WORDS)}) THEN {R.BARE_DEPTS.sql(f'lower({strip("designation")})')} END"
_SUB = "CASE " + " ".join(f"WHEN dept_primary = {quote(d)} THEN {r.sql('lower(designation)', '')}" for d, r in R.SUB_DEPARTMENTS) + " ELSE '' END"

CLASSIFIED = SCORES + f""",
c0 AS (SELECT cur.*, best.dept AS bdept, best.score, best.gap, {_BARE.replace('designation', 'cur.designation')} AS bare, {layer('cur.designation')} AS layer0 FROM cur JOIN best USING (designation)),
c1 AS (
  SELECT *, CASE WHEN bare IS NOT NULL THEN bare WHEN designation = '' THEN 'Operations' WHEN layer0 = 0 THEN 'Board of Management' WHEN score = 0 THEN 'Operations' ELSE bdept END AS dept_primary,
         CASE WHEN designation = '' THEN 0.1 WHEN layer0 = 0 THEN 1.0 WHEN score = 0 THEN 0.3 WHEN gap >= 60 THEN 0.95 WHEN gap >= 30 THEN 0.80 WHEN gap >= 10 THEN 0.65 ELSE 0.60 END::DOUBLE AS confidence,
         CASE WHEN bare IS NOT NULL THEN greatest(layer0, 8) ELSE layer0 END AS layer,
         {R.SECTORS.sql("lower(concat_ws(' ', company, designation, industry_hint))", 'General')} AS sector,
         CASE WHEN country = '' THEN 'Global' ELSE {R.REGIONS.sql('lower(country)', 'Global')} END AS region
  FROM c0
),
classified AS (SELECT *, {_SUB} AS dept_secondary FROM c1)"""


def flags(title: str) -> dict[str, str]:
    t = f"lower({strip(title)})"
    m = lambda p: f"regexp_matches({t}, {quote(p)})"
    out = {k: "(" + " AND ".join([*map(m, r["all"]), *(f"NOT {m(p)}" for p in r["none"])]) + ")" for k, r in R.FLAGS.items()}
    by_committee = " ".join(f"WHEN {out['is_committee_chair']} AND {m(p)} THEN {quote(k)}" for k, p in R.COMMITTEES)
    out["board_sub_role"] = f"CASE WHEN {out['is_chairman']} THEN 'chairman' WHEN {out['is_vice_chair']} THEN 'vice_chair' WHEN {m(R.LEAD_DIRECTOR)} THEN 'lead_director' {by_committee} WHEN {out['is_committee_chair']} THEN 'committee_chair' ELSE 'director' END"
    out["exec_region"] = f"CASE WHEN {m(R.HEAD_OFFICE_TITLE)} THEN 'Global HQ' ELSE {R.EXEC_REGIONS.sql(t, 'Global HQ')} END"
    return out


_F = flags("designation")
PLACED = CLASSIFIED + f""",
f0 AS (SELECT *, {_F['is_csuite']} AS is_csuite, {_F['is_regional']} AS is_regional FROM classified),
f1 AS (SELECT *, (layer = 0 OR (layer <= 2 AND dept_primary = 'Board of Management')) OR (layer = 1 AND NOT is_csuite) AS outsider FROM f0),
f2 AS (
  SELECT * EXCLUDE (outsider), CASE WHEN outsider THEN CASE WHEN dept_primary IN ('Board of Management', '') THEN 'Strategy & Corporate Development' ELSE dept_primary END WHEN layer = 1 THEN 'Executive Management' WHEN dept_primary = '' THEN 'Operations' ELSE dept_primary END AS dept,
         CASE WHEN outsider THEN 3 WHEN layer = 1 AND is_regional THEN 2 ELSE layer END AS at_layer
  FROM f1
),
placed AS (SELECT *, CASE WHEN at_layer > 2 AND lower(dept_secondary) <> lower(dept) THEN dept_secondary ELSE '' END AS sub_dept FROM f2)"""


def node_id(*parts: str) -> str:
    return "concat_ws('__', " + ", ".join(f"CASE WHEN coalesce({p}, '') <> '' THEN regexp_replace(lower(trim({p})), '[^a-z0-9_]', '_', 'g') END" for p in parts) + ")"


def _chain() -> str:
    out = f""",
px AS (SELECT *, dept_primary AS rp, dept_secondary AS rs, CASE WHEN sub_dept = '' THEN {node_id("'dept'", 'dept')} ELSE {node_id("'dept'", 'dept', 'sub_dept')} END AS leaf FROM placed),
cur4 AS (SELECT leaf, rp, rs, max(at_layer) AS deepest, arg_min(sector, at_layer * 1000000000000 + ord) AS sector, leaf AS fin FROM px WHERE at_layer > 4 GROUP BY ALL)"""
    for n in range(4, 10):
        at = f"SELECT px.*, leaf AS parent FROM px WHERE at_layer = {n}" if n == 4 else f"SELECT px.*, c.fin AS parent FROM px JOIN cur{n} c USING (leaf, rp, rs) WHERE at_layer = {n}"
        out += f""",
at{n} AS ({at}),
real{n} AS (SELECT parent AS fin, arg_min(id, ord) AS real_id FROM at{n} WHERE NOT regexp_matches(lower(designation), {quote(R.STAFF_TITLES)}) GROUP BY ALL),
step{n} AS (SELECT c.*, real_id, CASE WHEN real_id IS NULL THEN {node_id("'ghost'", 'leaf', 'rp', 'rs', f"'{n}'")} END AS ghost FROM cur{n} c LEFT JOIN real{n} USING (fin) WHERE deepest > {n}),
cur{n + 1} AS (SELECT leaf, rp, rs, deepest, sector, coalesce(real_id, ghost) AS fin FROM step{n})"""
    parents = " UNION ALL ".join(["SELECT id, leaf AS parent FROM px WHERE at_layer <= 4", *(f"SELECT id, parent FROM at{n}" for n in range(5, 10)), "SELECT id, fin AS parent FROM px JOIN cur10 USING (leaf, rp, rs) WHERE at_layer = 10"])
    ghosts = " UNION ALL ".join(f"SELECT ghost AS node_id, fin AS parent, {n} AS layer, sector FROM step{n} WHERE ghost IS NOT NULL" for n in range(4, 10))
    return out + f",\nparents AS ({parents}),\nghosts AS ({ghosts})"


GRAPH = PLACED + _chain() + f""",
has_em AS (SELECT count(*) > 0 AS x FROM placed WHERE dept = 'Executive Management'),
depts0 AS (SELECT DISTINCT dept FROM placed),
subs0 AS (SELECT DISTINCT dept, sub_dept FROM placed WHERE sub_dept <> ''),
nodes AS (
  SELECT 'root_global' AS node_id, 'global' AS node_type, 'Organization' AS label, -1 AS layer, 'All' AS sector, false AS is_ghost
  UNION ALL SELECT {node_id("'dept'", 'dept')}, 'dept_primary', dept, 1, '', false FROM depts0
  UNION ALL SELECT {node_id("'dept'", 'dept', 'sub_dept')}, 'dept_secondary', sub_dept, 2, '', false FROM subs0
  UNION ALL SELECT id, 'person', arg_min(full_name, ord), arg_min(at_layer, ord), arg_min(sector, ord), false FROM placed GROUP BY id
  UNION ALL SELECT node_id, 'ghost', {R.GHOST_LABELS.sql('layer')} || ' ✦', layer, sector, true FROM ghosts
),
edges AS (
  SELECT CASE WHEN dept NOT IN ('Board of Management', 'Executive Management') AND (SELECT x FROM has_em) THEN {node_id("'dept'", "'Executive Management'")} ELSE 'root_global' END AS parent_id, {node_id("'dept'", 'dept')} AS child_id FROM depts0
  UNION SELECT {node_id("'dept'", 'dept')}, {node_id("'dept'", 'dept', 'sub_dept')} FROM subs0
  UNION SELECT parent, id FROM parents
  UNION SELECT parent, node_id FROM ghosts
)"""
RECURSIVE = GRAPH.replace("WITH people", "WITH RECURSIVE people", 1)

DOWN = """,
tree(node_id, depth) AS (SELECT 'root_global', 0 UNION SELECT e.child_id, t.depth + 1 FROM tree t JOIN edges e ON e.parent_id = t.node_id WHERE t.depth < 20),
depth AS (SELECT node_id, min(depth) AS depth FROM tree GROUP BY node_id)"""

OV = f"""
WITH o AS (
  SELECT lower({strip('title_raw')}) AS raw, lower({strip('title_native')}) AS nat, region AS o_region, archetype_id AS o_arch, coalesce(sub_industry, '') AS o_sub, level, normalized_title, function FROM region_overlay
)"""


def overlay(mode: str) -> str:
    free = "true" if mode == "v2" else "o_sub = ''"
    keys = "SELECT raw AS key, * FROM o WHERE raw <> '' UNION SELECT nat AS key, * FROM o WHERE nat <> ''" if mode == "v2" else "SELECT raw AS key, * FROM o WHERE raw <> ''"
    return OV + f""",
k AS ({keys}),
p AS (SELECT 'v' || person_id AS id, lower({strip('title')}) AS key, coalesce(job_country, 'Global') AS region, 'maker' AS archetype, 'regional' AS sub FROM person_records),
h AS (
  SELECT p.id, k.*, CASE WHEN o_region = region AND o_arch = archetype AND sub <> '' AND o_sub = sub THEN 1 WHEN o_region = region AND o_arch = archetype AND {free} THEN 2 WHEN o_region = region AND o_arch = 'any' AND {free} THEN 3
                        WHEN o_region = 'Global' AND o_arch = archetype AND {free} THEN 4 WHEN o_region = 'Global' AND o_arch = 'any' AND {free} THEN 5 END AS pass
  FROM p JOIN k USING (key) WHERE p.key <> ''
),
ruled AS (
  SELECT id, level, function, normalized_title, pass FROM h WHERE pass IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY pass, raw, coalesce(nat, ''), o_region, o_arch, o_sub, level, normalized_title) = 1
)"""


_PERSONA = f"lower({strip('coalesce(vendor_persona, ' + chr(39) * 2 + ')')})"
_FN = R.VENDOR_FUNCTIONS.sql(f"lower({strip('vendor_function')})")
_LOW = "lower(coalesce(title, ''))"
_WITHIN = "CASE " + " ".join(f"WHEN contains({_PERSONA}, {quote(k)}) THEN {n}" for k, n in R.VENDOR_LEVELS.rows) + " END"
VENDOR = f"""
vendor AS (
  SELECT id, CASE WHEN f = 'Operations' THEN {R.OPERATIONS_BY_TITLE.sql(_LOW, 'Operations')} WHEN f IN ('Engineering', 'Information Technology') AND regexp_matches({_LOW}, {quote(R.PROPERTY_TITLES)}) THEN 'Facilities, Real Estate & Workplace' ELSE f END AS v_function,
         coalesce({R.VENDOR_LEVELS.sql(f"lower({strip('vendor_level')})")}, {R.VENDOR_LEVELS.sql(_PERSONA)}, {_WITHIN}) AS v_level
  FROM (SELECT 'v' || person_id AS id, *, {_FN} AS f FROM person_records)
)"""
_GENERIC = "manager|director|engineer|analyst|associate|specialist|coordinator|lead|senior manager|senior director".split("|")
RECONCILED = overlay("v2") + "," + VENDOR + f""",
j AS (SELECT 'v' || r.person_id AS id, r.title, u.function AS r_function, u.level AS r_level, v_function, v_level FROM person_records r LEFT JOIN ruled u ON u.id = 'v' || r.person_id LEFT JOIN vendor v ON v.id = 'v' || r.person_id),
reconciled AS (
  SELECT id, coalesce(r_function, v_function, 'Unclassified') AS function,
         CASE WHEN r_function IS NOT NULL AND r_level IS NOT NULL THEN r_level WHEN r_function IS NOT NULL OR r_level IS NOT NULL THEN coalesce(nullif(r_level, 0), nullif(v_level, 0), 99) WHEN v_function IS NOT NULL AND v_level IS NOT NULL THEN v_level ELSE coalesce(nullif(v_level, 0), 99) END AS level,
         CASE WHEN r_function IS NOT NULL AND r_level IS NOT NULL THEN 'rule' WHEN r_function IS NOT NULL OR r_level IS NOT NULL THEN 'rule+vendor' WHEN v_function IS NOT NULL AND v_level IS NOT NULL THEN 'vendor' WHEN v_function IS NOT NULL OR nullif(v_level, 0) IS NOT NULL THEN 'vendor-partial' ELSE 'none' END AS source,
         (r_function IS NOT NULL AND r_level IS NOT NULL AND (coalesce(v_function <> r_function, false) OR coalesce(v_level <> 0 AND abs(v_level - r_level) >= 2, false))) AS conflict
  FROM j
),
staff AS (
  SELECT c.id, c.function, c.level, coalesce({missing('r.job_country')}, 'Global') AS region, {missing('r.job_country')} AS country, r.person_id AS ord, r.name, r.title, r.subsidiary AS legal_entity
  FROM reconciled c JOIN person_records r ON c.id = 'v' || r.person_id
)"""


def _up(region: str) -> str:
    return f"(SELECT s.id FROM staff s WHERE s.function = p.function AND s.level < p.level AND s.level >= 1 AND {region} ORDER BY s.level DESC, s.ord LIMIT 1)"


PARENTS = RECONCILED + f""",
seat AS (SELECT function, region, level, arg_min(id, ord) AS id, min(ord) AS ord FROM staff WHERE level >= 1 GROUP BY ALL),
need AS (SELECT DISTINCT function, region, level FROM staff),
tiers AS (
  SELECT n.function, n.region, n.level, arg_max(s.id, (s.level, -s.ord)) FILTER (s.region = n.region) AS a, arg_max(s.id, (s.level, -s.ord)) FILTER (s.region = 'Global') AS b, arg_max(s.id, (s.level, -s.ord)) AS c
  FROM need n LEFT JOIN seat s ON s.function = n.function AND s.level < n.level GROUP BY ALL
),
up AS (SELECT p.id, CASE WHEN p.level > 1 THEN coalesce(t.a, t.b, t.c) END AS parent_id FROM staff p JOIN tiers t USING (function, region, level))"""

LEDGER = f"WITH k AS (SELECT *, lower({strip('original_title_native')}) AS title_l, coalesce(sub_industry, '') AS sub FROM corrections)"


def verdicts(threshold: int) -> str:
    return LEDGER + f""",
outc AS (SELECT archetype, region, sub, title_l, corrected_level, corrected_function, count(*) AS c, min(correction_id) AS f FROM k GROUP BY ALL),
v AS (SELECT archetype, region, sub, title_l, sum(c)::BIGINT AS corrections, count(*) AS outcomes, arg_min(corrected_level, f) AS corrected_level, arg_min(corrected_function, f) AS corrected_function FROM outc GROUP BY ALL HAVING sum(c) >= {threshold}),
an AS (SELECT archetype, region, sub, title_l, count(DISTINCT analyst_id)::INT AS n_analysts FROM k GROUP BY ALL),
va AS (SELECT v.*, n_analysts FROM v JOIN an ON an.archetype IS NOT DISTINCT FROM v.archetype AND an.region IS NOT DISTINCT FROM v.region AND an.sub = v.sub AND an.title_l IS NOT DISTINCT FROM v.title_l)"""
