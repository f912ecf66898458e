"""Further core queries and their SQL: titles, places, cascades, departments, trees, leadership, reports and page texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import markup, misc, places
from rankloom.functions import rules as R
from rankloom.functions import titles as T
from rankloom.functions.rules import quote
from rankloom.functions.text import missing_to_null
from rankloom.operators import cascade, departments, directory, layout, leadership, ledger, people, reports, taxonomy, tree
from rankloom.operators.graph import ROOT
from rankloom.plans import catalog, sql
from rankloom.session import cut
from rankloom.sources import library
from rankloom.tables import table

THRESHOLD = 20
STAFF_LEVELS = 4


def _leaders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "authoritative_leaders").withColumn("ord", F.col("leader_id"))


def _chart_people(s: SparkSession, d: str) -> DataFrame:
    return catalog._current(s, d).withColumn("ord", F.substring("id", 2, 20).cast("long"))


def _classified(s: SparkSession, d: str) -> DataFrame:
    return cut(catalog._classified(s, d).withColumn("ord", F.substring("id", 2, 20).cast("long")))  # evaluated once: filters on its columns would repeat their rules


def _entries(s: SparkSession, d: str) -> DataFrame:
    """The overlay's rows for any archetype as one ladder, in order of level and title."""
    o = table(s, d, "region_overlay").filter("archetype_id = 'any' and region = 'Global'").select(F.lit("any").alias("archetype"), "function", "level", F.col("normalized_title").alias("entry"))
    return o.withColumn("pos", F.dense_rank().over(_by("level", "entry")).cast("long"))


def _by(*cols):
    from pyspark.sql.window import Window

    return Window.partitionBy("archetype").orderBy(*cols)  # a ladder is a dimension of a few hundred entries


def _directory(s: SparkSession, d: str) -> directory.Directory:
    o = table(s, d, "region_overlay").filter("archetype_id <> 'any'")
    kw = o.select(F.col("archetype_id").alias("industry"), F.col("function").alias("dept"), F.lower("function").alias("keyword")).unionByName(o.select(F.col("archetype_id").alias("industry"), F.col("function").alias("dept"), F.lower(F.element_at(F.split("normalized_title", "(?:, | of )"), -1)).alias("keyword"))).distinct()
    det = o.select(F.col("archetype_id").alias("industry"), F.lit("designation").alias("kind"), F.lower("normalized_title").alias("keyword")).distinct()
    det = det.unionByName(o.select("archetype_id").distinct().select(F.col("archetype_id").alias("industry"), F.lit("industry_hint").alias("kind"), F.col("archetype_id").alias("keyword")))
    return directory.Directory(det, o.select(F.col("archetype_id").alias("industry"), "level", F.col("normalized_title").alias("name")).withColumnRenamed("level", "layer").distinct(), kw)


def _panel_people(s: SparkSession, d: str) -> DataFrame:
    """Leaders as people of two panels per firm."""
    i = leadership.injected(_leaders(s, d), _chart_people(s, d))
    return i.select(F.concat_ws("/", "dept", F.lower(F.translate(F.substring("full_name", 1, 1), "İ", "I"))).alias("panel"), "id", F.col("at_layer").alias("layer"), F.col("full_name").alias("label"), F.col("designation").alias("title"))


def _method_nodes(s: SparkSession, d: str) -> DataFrame:
    """Chart persons, every third a model's leader."""
    return _chart_people(s, d).select("id", "ord", "full_name", F.when(F.col("ord") % 3 == 0, "llm_leadership_ai").otherwise("csv").alias("method"), "linkedin_url")


def _purge_input(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = _classified(s, d).filter("layer <= 3").select(F.col("id").alias("node_id"), F.lit("person").alias("node_type"), F.when(F.col("ord") % 2 == 0, leadership.BOARD).otherwise(leadership.EXECUTIVE).alias("dept"), F.when(F.col("ord") % 5 == 0, "llm_leadership_web").otherwise("csv").alias("method"))
    depts = s.createDataFrame([("dept__b", "dept_primary", leadership.BOARD, ""), ("dept__e", "dept_primary", leadership.EXECUTIVE, ""), ("dept__x", "dept_primary", "Operations", "")], "node_id string, node_type string, dept string, method string")
    under = F.when(F.col("dept") == leadership.BOARD, "dept__b").otherwise("dept__e")
    edges = p.select(under.alias("parent_id"), F.col("node_id").alias("child_id")).unionByName(p.filter("substring(node_id, 2, 20) % 7 = 0").select(F.lit("dept__x").alias("parent_id"), F.col("node_id").alias("child_id")))
    return cut(p.unionByName(depts)), cut(edges)


def _staff(s: SparkSession, d: str) -> DataFrame:
    return cut(catalog._staff(s, d))


def _tree_rows(s: SparkSession, d: str, most: int) -> DataFrame:
    n, e = catalog._graph(s, d)
    return tree.subtree(n, e, ROOT, most).select(F.concat_ws("/", "path").alias("path"), "node_id", "parent_id", "depth", "place", "place_label", "has_more")


def _dept_tree(s: SparkSession, d: str, most: int) -> DataFrame:
    n, e = catalog._graph(s, d)
    return tree.department_tree(n, e, ROOT, most).select(F.concat_ws("/", "path").alias("path"), "node_id", "depth", "headcount", "has_more")


def _corrected_people(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "corrections").select(F.concat(F.lit("v"), F.col("correction_id").cast("string")).alias("id"), F.col("original_title_native").alias("title"), "region", "archetype", "sub_industry")


def _by_function(s: SparkSession, d: str) -> DataFrame:
    """Corrections spoken of by their function alone, so that patterns reach the threshold of the service."""
    return table(s, d, "corrections").withColumn("original_title_native", F.col("original_function")).withColumn("sub_industry", F.lit("")).withColumn("region", F.lit("Global"))


def _scores_input(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    kw = cut(departments.keywords_from_titles(table(s, d, "region_overlay").select(F.col("normalized_title").alias("title"), "function").distinct()))
    people = _classified(s, d).select(F.col("designation").alias("title"), F.lower("industry_hint").alias("industry"), F.lit("").alias("job_function"))
    boosts = s.createDataFrame([("banking", "Finance", 40), ("retail", "Sales", 40), ("energy", "Engineering", 25)], "industry string, dept string, points int")
    return people, kw, boosts


_RAW = "SELECT row_id, \"Designation\" AS t FROM test_data WHERE \"Designation\" IS NOT NULL"
_NAMES = f"(SELECT *, leader_id AS ord, {sql.missing('name')} AS nm, {sql.missing('title')} AS ti FROM authoritative_leaders)"
_KEY = lambda c: f"array_to_string(list_slice(regexp_split_to_array(trim(regexp_replace(lower({c}), '[^a-z ]', '', 'g')), ' +'), 1, 2), ' ')"
_LF = sql.flags("ti")
INJECTED = sql.CURRENT + f""",
ppl AS (SELECT *, {_KEY('full_name')} AS key FROM cur),
ld AS (SELECT ord, nm AS name, ti AS title, coalesce(is_board, false) AS b, {_KEY('nm')} AS key,
       CASE WHEN coalesce(is_board, false) THEN CASE WHEN {_LF['is_chairman']} THEN 0 WHEN {_LF['is_vice_chair']} OR {_LF['is_committee_chair']} THEN 1 ELSE 2 END WHEN {_LF['is_regional']} THEN 2 ELSE 1 END AS layer,
       CASE WHEN coalesce(is_board, false) THEN {_LF['board_sub_role']} END AS board_sub_role, CASE WHEN coalesce(is_board, false) THEN 'Global HQ' ELSE {_LF['exec_region']} END AS region
       FROM {_NAMES} WHERE nm IS NOT NULL AND ti IS NOT NULL AND len(regexp_split_to_array(nm, '\\s+')) >= 2),
seats AS (SELECT *, row_number() OVER (PARTITION BY key, b ORDER BY ord) AS rn, count(*) OVER (PARTITION BY key) <> count(*) OVER (PARTITION BY key, b) AS dual FROM ld WHERE key <> ''),
kn AS (SELECT key, arg_max(linkedin_url, ord) FILTER (linkedin_url <> '') AS url FROM ppl WHERE key <> '' GROUP BY key),
injected AS (
  SELECT 'lead_' || CASE WHEN b THEN 'b' ELSE 'e' END || ord AS id, s.name AS full_name, s.title AS designation, CASE WHEN b THEN 'Board of Management' ELSE 'Executive Management' END AS dept, s.layer AS at_layer, board_sub_role, s.region, coalesce(kn.url, '') AS linkedin_url
  FROM seats s LEFT JOIN kn USING (key) WHERE rn = 1 AND (dual OR kn.key IS NULL)
)"""
_PANELS = INJECTED + ", pan AS (SELECT dept || '/' || lower(substr(full_name, 1, 1)) AS panel, id, at_layer AS layer, full_name AS label, designation AS ti FROM injected)"
_LAYERED = """,
lay AS (SELECT panel, layer, dense_rank() OVER (PARTITION BY panel ORDER BY layer) - 1 AS rank FROM (SELECT DISTINCT panel, layer FROM {src})),
num AS (SELECT p.*, rank, row_number() OVER (PARTITION BY p.panel, p.layer ORDER BY label, id) - 1 AS j, count(*) OVER (PARTITION BY p.panel, p.layer) AS m FROM {src} p JOIN lay ON lay.panel = p.panel AND lay.layer = p.layer),
hd AS (SELECT panel, rank + 1 AS rank, j AS i, id AS parent_id FROM num),
ab AS (SELECT DISTINCT panel, rank + 1 AS rank, layer AS la, m AS nh FROM num),
laid AS (SELECT num.panel, num.id, hd.parent_id, num.rank, coalesce(num.layer - ab.la > 1, false) AS skipped FROM num LEFT JOIN ab ON ab.panel = num.panel AND ab.rank = num.rank LEFT JOIN hd ON hd.panel = num.panel AND hd.rank = num.rank AND hd.i = num.j // ceil(num.m / ab.nh)::BIGINT)"""
_STAFF = sql.RECONCILED
_DEPT_RANK = "CASE lower(label) " + " ".join(f"WHEN {quote(k)} THEN {v}" for k, v in tree.DEPARTMENT_ORDER.items()) + " ELSE 50 END"
_PLACE = f"CASE WHEN is_ghost THEN 900 WHEN node_type = 'dept_primary' THEN {_DEPT_RANK} WHEN node_type IN ('dept_secondary', 'dept_tertiary') THEN 50 WHEN node_type = 'person' THEN 100 + coalesce(layer, 99) ELSE 500 END"
_PATHS = """,
pth(path, node_id, parent_id, depth) AS (
  SELECT 'root_global', 'root_global', NULL::VARCHAR, 0 UNION ALL
  SELECT path || '/' || e.child_id, e.child_id, p.node_id, depth + 1 FROM pth p JOIN edges e ON e.parent_id = p.node_id WHERE depth < {most} {stop}
)"""
_NOT_PERSON = "AND p.node_id NOT IN (SELECT node_id FROM nodes WHERE node_type = 'person')"


def _tree_sql(most: int) -> str:
    return sql.RECURSIVE + _PATHS.format(most=most, stop="") + f""" SELECT path, p.node_id, parent_id, depth, {_PLACE} AS place, regexp_replace(lower(label), ' *✦$', '') AS place_label,
      depth = {most} AND p.node_id IN (SELECT parent_id FROM edges) AS has_more FROM pth p LEFT JOIN nodes n ON n.node_id = p.node_id"""


def _dept_sql(most: int) -> str:
    return sql.RECURSIVE + _PATHS.format(most=most + 1, stop=_NOT_PERSON) + f""",
    w AS (SELECT p.*, node_type FROM pth p JOIN nodes USING (node_id)),
    anc AS (SELECT s.path, count(*) AS headcount FROM w x JOIN w s ON starts_with(x.path, s.path || '/') WHERE x.node_type = 'person' AND s.node_type <> 'person' GROUP BY ALL)
    SELECT s.path, s.node_id, s.depth, coalesce(headcount, 0) AS headcount, EXISTS (SELECT 1 FROM w k WHERE k.parent_id = s.node_id AND s.depth = {most} AND k.depth = {most + 1} AND starts_with(k.path, s.path || '/') AND k.node_type IN ('global', 'dept_primary', 'dept_secondary', 'dept_tertiary')) AS has_more
    FROM w s LEFT JOIN anc ON anc.path = s.path WHERE s.node_type <> 'person' AND s.depth <= {most}"""


_WORDS = lambda c: f"list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[/—-]', ' ', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN ('the','a','an','of','and','&'))))"
_EDGE = r"[ \t\-/().,]"
_RANK = "CASE " + " ".join(f"WHEN regexp_matches(low, {quote(rf'(?:^|{_EDGE}){w}(?:$|{_EDGE})')}) THEN {quote(w)}" for w in cascade.SENIORITY) + " END"
_LADDER = "SELECT function, level, entry, dense_rank() OVER (ORDER BY level, entry) AS pos FROM (SELECT DISTINCT function, level, normalized_title AS entry FROM region_overlay WHERE archetype_id = 'any' AND region = 'Global')"


def _cascade_sql(asked: str) -> str:
    return f"""
WITH asked AS ({asked}), e AS (SELECT *, lower(entry) AS norm, list_transform(string_split(lower(entry), '/'), lambda x: trim(x)) AS parts, {_WORDS('entry')} AS ew FROM ({_LADDER})),
t0 AS (SELECT DISTINCT title, lower({sql.strip('title')}) AS low FROM asked WHERE {sql.strip('title')} <> ''), t AS (SELECT *, {_WORDS('title')} AS tw, {_RANK} AS rk FROM t0),
j AS (SELECT t.*, e.*, low = norm OR list_contains(parts, low) AS ex, tw = ew OR len(list_filter(parts, lambda p: {_WORDS('p')} = tw)) > 0 AS eq, contains(norm, low) AND length(low) >= 6 AS inside, contains(low, norm) AND length(norm) >= 10 AS around
      FROM t, e WHERE rk IS NULL OR regexp_matches(norm, '(?:^|{_EDGE})' || rk || '(?:$|{_EDGE})')),
c AS (SELECT *, len(ew) >= 2 AND len(list_intersect(ew, tw)) = len(ew) AND NOT eq AS cov FROM j),
h AS (SELECT title, arg_min((entry, function, level), pos) FILTER (ex) AS xa, min(pos) FILTER (eq) AS fe, arg_min((entry, function, level), length(entry) * 100000 + pos) FILTER (eq) AS ea, arg_min((entry, function, level), pos) FILTER (cov) AS ca, min(pos) FILTER (cov) AS cp,
      arg_min((entry, function, level), length(entry) * 100000 + pos) FILTER (inside) AS ia, arg_min((entry, function, level), -length(entry) * 100000 + pos) FILTER (around) AS ra FROM c GROUP BY title),
g AS (SELECT title, CASE WHEN xa IS NOT NULL THEN xa WHEN ca IS NOT NULL AND (fe IS NULL OR cp < fe) AND NOT coalesce(length(ea[1]) < length(ca[1]), false) THEN ca WHEN ea IS NOT NULL THEN ea WHEN ia IS NOT NULL THEN ia ELSE ra END AS v,
      CASE WHEN xa IS NOT NULL THEN 1 WHEN ca IS NOT NULL OR ea IS NOT NULL THEN 2 WHEN ia IS NOT NULL THEN 3 WHEN ra IS NOT NULL THEN 4 END AS tier FROM h)
SELECT title, v[1] AS entry, v[2] AS function, v[3] AS level, tier FROM g WHERE tier IS NOT NULL"""


_KW = r"""
ow AS (SELECT DISTINCT normalized_title AS title, function FROM region_overlay WHERE normalized_title IS NOT NULL AND function IS NOT NULL),
wd AS (SELECT function AS dept, unnest(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS keyword FROM ow),
wc AS (SELECT dept, keyword, count(*) AS n FROM wd WHERE length(keyword) > 3 GROUP BY ALL),
wt AS (SELECT *, sum(n) OVER (PARTITION BY keyword) AS total FROM wc),
lk AS (SELECT dept, keyword, round(100.0 * n / total)::INT AS weight, dense_rank() OVER (ORDER BY dept) - 1 AS nth FROM wt WHERE total >= 3 AND n >= 0.5 * total)"""
_BOOSTS = "bo(industry, dept, points) AS (VALUES ('banking', 'Finance', 40), ('retail', 'Sales', 40), ('energy', 'Engineering', 25))"
SCORED = sql.CLASSIFIED + "," + _KW + f""", {_BOOSTS},
tt AS (SELECT DISTINCT designation AS title, lower(industry_hint) AS industry FROM classified),
kd AS (SELECT DISTINCT dept, nth FROM lk),
sc AS (
  SELECT title, industry, dept, nth, sum(p)::BIGINT AS score FROM (
    SELECT title, industry, dept, nth, weight AS p FROM tt JOIN lk ON contains(lower(title), keyword)
    UNION ALL SELECT title, tt.industry, bo.dept, nth, points FROM tt JOIN bo USING (industry) JOIN kd ON kd.dept = bo.dept)
  GROUP BY ALL
)"""
_REGION = places.region_of_record_sql("job_country_code", "job_country", "geography", "title", "company")
_MAPPED = f"""WITH m AS (
  SELECT person_id, coalesce({sql.missing('name')}, '') AS name, coalesce({sql.missing('title')}, '') AS title, {sql.missing('job_country')} AS job_country, coalesce({sql.missing('job_country')}, {sql.missing('geography')}) AS geography, {sql.missing('company')} AS c,
         regexp_extract(regexp_replace({sql.missing('job_org_linkedin_url')}, '/+$', ''), '([^/]+)$', 1) AS slug, string_split({sql.missing('email_domain')}, '.')[1] AS dom FROM person_records
)"""
_CAP = lambda x: f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_EVIDENCE_PARTS = r"list_filter(regexp_split_to_array(n, '\s+'), lambda p: length(p) >= 2)"


def _evidence(n: str, s: str) -> str:
    parts = rf"list_filter(regexp_split_to_array({n}, '\s+'), lambda p: length(p) >= 2)"
    last = rf"regexp_split_to_array(trim({n}), '\s+')[-1]"
    return f"(contains({s}, {n}) OR (len({parts}) >= 2 AND len(list_filter({parts}, lambda p: contains({s}, p))) = len({parts})) OR (length({last}) >= 4 AND contains({s}, {last})))"


def _q() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    raw = lambda s, d: table(s, d, "test_data").filter("Designation is not null").select("row_id", F.col("Designation").alias("t"))
    recs = lambda s, d: table(s, d, "person_records")
    return {
        # titles
        "titles_translated": (lambda s, d: raw(s, d).select("row_id", T.translate("t").alias("title")), f"SELECT row_id, {T.translate_sql('t')} AS title FROM ({_RAW})"),
        "titles_folded": (lambda s, d: raw(s, d).select("row_id", T.fold("t").alias("title")), f"SELECT row_id, {T.fold_sql('t')} AS title FROM ({_RAW})"),
        "titles_expanded": (lambda s, d: raw(s, d).select("row_id", T.expand("t").alias("title")), f"SELECT row_id, {T.expand_sql('t')} AS title FROM ({_RAW})"),
        "titles_unmodified": (lambda s, d: raw(s, d).select("row_id", T.without_modifiers(T.fold("t")).alias("title")), f"SELECT row_id, {T.without_modifiers_sql(T.fold_sql('t'))} AS title FROM ({_RAW})"),
        "quick_layers": (lambda s, d: _leaders(s, d).filter("title is not null").select("leader_id", T.quick_layer(T.fold("title")).alias("layer")), f"SELECT leader_id, {T.quick_layer_sql(T.fold_sql('title'))} AS layer FROM authoritative_leaders WHERE title IS NOT NULL"),
        "leader_functions": (lambda s, d: _leaders(s, d).filter("title is not null").select("leader_id", T.leader_function("title").alias("function")), f"SELECT leader_id, {T.leader_function_sql('title')} AS function FROM authoritative_leaders WHERE title IS NOT NULL"),
        "leader_lists": (
            lambda s, d: _leaders(s, d).select("leader_id", T.looks_executive("title").alias("executive"), T.on_board("title").alias("board"), T.is_retired(T.fold("title"), T.fold("name")).alias("retired")),
            f"SELECT leader_id, coalesce(regexp_matches(lower(title), {quote(T.any_of(T.EXECUTIVE_WORDS))}), false) AS executive, coalesce(regexp_matches(lower(title), {quote(T.any_of(T.BOARD_WORDS))}), false) AS board, coalesce(regexp_matches(lower({T.fold_sql('title')}), {quote(T.RETIRED)}), false) OR coalesce(regexp_matches(lower({T.fold_sql('name')}), {quote(T.RETIRED)}), false) AS retired FROM authoritative_leaders",
        ),
        "group_chiefs": (lambda s, d: _leaders(s, d).select("leader_id", T.is_group_ceo("title").alias("chief")), None),
        "name_parts": (
            lambda s, d: _leaders(s, d).filter("name is not null").select("leader_id", T.split_name("name").alias("n")).select("leader_id", "n.first", "n.rest"),
            f"WITH x AS (SELECT leader_id, {sql.strip('name')} AS n FROM authoritative_leaders WHERE name IS NOT NULL) SELECT leader_id, regexp_extract(n, '^\\S*') AS first, regexp_replace(regexp_extract(n, '\\s+(?s:.*)$'), '^\\s+', '') AS rest FROM x",
        ),
        "slug_companies": (
            lambda s, d: recs(s, d).filter("job_org_linkedin_url is not null").select("person_id", T.slug_company("job_org_linkedin_url").alias("company")),
            f"SELECT person_id, {_CAP(chr(10).join(['replace(regexp_extract(lower(job_org_linkedin_url), ' + quote('/company/([a-z0-9-]+)') + ', 1), ' + quote('-') + ', ' + quote(' ') + ')']))} AS company FROM person_records WHERE job_org_linkedin_url IS NOT NULL",
        ),
        "not_current_rows": (lambda s, d: _classified(s, d).select("id", F.when(F.col("ord") % 4 == 0, " No ").when(F.col("ord") % 4 == 1, "0").when(F.col("ord") % 4 == 2, "yes").alias("flag")).filter(~T.not_current("flag")).select("id"), sql.CLASSIFIED + " SELECT id FROM classified WHERE ord % 4 > 1"),
        # places
        "record_regions": (lambda s, d: reports.located(recs(s, d)).select("person_id", "region"), f"SELECT person_id, {_REGION} AS region FROM person_records"),
        "record_countries": (lambda s, d: reports.located(recs(s, d)).select("person_id", "country"), f"SELECT person_id, {places.country_tag_sql('job_country', _REGION)} AS country FROM person_records"),
        "overlay_regions": (lambda s, d: catalog._people(s, d).select("id", places.overlay_region(T.fold("location")).alias("region")), sql.PEOPLE + f" SELECT id, {places.overlay_region_sql(T.fold_sql('location'))} AS region FROM people"),
        "archetypes": (
            lambda s, d: catalog._people(s, d).select("id", places.archetype(F.lower("industry_hint"), F.col("industry_hint"), F.col("company")).alias("archetype")),
            sql.PEOPLE + f" SELECT id, {places.archetype_sql('lower(industry_hint)', 'industry_hint', 'company')} AS archetype FROM people",
        ),
        "last_places": (lambda s, d: catalog._people(s, d).select("id", places.last_place(F.col("location")).alias("place")), sql.PEOPLE + " SELECT id, trim(string_split(location, ',')[-1]) AS place FROM people"),
        # rule libraries
        "cascade_tiers": (lambda s, d: cascade.match(recs(s, d).select(F.lit("any").alias("archetype"), "title"), _entries(s, d)).drop("archetype"), _cascade_sql("SELECT title FROM person_records")),
        "overlay_by_archetype_v2": (lambda s, d: taxonomy.lookup_overlay(_corrected_people(s, d), table(s, d, "region_overlay"), "v2"), _overlay_sql("v2") + " SELECT * FROM ruled"),
        "overlay_by_archetype_nlp": (lambda s, d: taxonomy.lookup_overlay(_corrected_people(s, d), table(s, d, "region_overlay"), "nlp"), _overlay_sql("nlp") + " SELECT * FROM ruled"),
        "titles_normalized": (lambda s, d: cascade.normalize_titles(_corrected_people(s, d).withColumn("archetype", F.lit("any")), table(s, d, "region_overlay"), _entries(s, d)), None),
        # departments
        "learned_keywords": (lambda s, d: _scores_input(s, d)[1], "WITH" + _KW + " SELECT * FROM lk"),
        "dept_points": (lambda s, d: (lambda p, k, b: departments.score(p, k, b))(*_scores_input(s, d)), SCORED + " SELECT * FROM sc"),
        "dept_by_points": (
            lambda s, d: (lambda p, k, b: departments.classify(p.withColumn("job_function", F.element_at(F.array(F.lit("finance"), F.lit("HR"), F.lit("sales"), F.lit("")), (F.length("title") % 4 + 1).cast("int"))), k, b))(*_scores_input(s, d)),
            SCORED + f""",
            rk AS (SELECT *, row_number() OVER (PARTITION BY title, industry ORDER BY score DESC, nth) AS rn FROM sc WHERE score <> 0),
            q AS (SELECT t.title, t.industry, ['finance', 'HR', 'sales', ''][length(t.title) % 4 + 1] AS job_function, a.dept AS d1, a.score AS s1, b.dept AS d2, coalesce(b.score, 0) AS s2 FROM tt t LEFT JOIN rk a ON a.title = t.title AND a.industry = t.industry AND a.rn = 1 LEFT JOIN rk b ON b.title = t.title AND b.industry = t.industry AND b.rn = 2),
            r AS (SELECT *, {departments.HINT_OF.sql('lower(job_function)')} AS hint, s1 - s2 AS lead FROM q),
            w AS (SELECT *, CASE WHEN coalesce(s1, 0) <= 0 THEN 'job_function_fallback' WHEN lead >= 60 THEN 'title_keyword_high' WHEN lead >= 30 THEN 'title_keyword' WHEN lead >= 10 THEN 'title_keyword_moderate' WHEN coalesce(hint = d1, false) THEN 'title_keyword+job_function' WHEN coalesce(hint = d2, false) AND s2 > 0 THEN 'job_function_tiebreak' ELSE 'title_keyword_weak' END AS how FROM r)
            SELECT title, industry, job_function, CASE how WHEN 'job_function_fallback' THEN coalesce(hint, 'Operations') WHEN 'job_function_tiebreak' THEN d2 ELSE d1 END AS dept,
                   CASE how WHEN 'job_function_fallback' THEN 0.3 WHEN 'title_keyword_high' THEN 0.95 WHEN 'title_keyword' THEN 0.8 WHEN 'title_keyword_moderate' THEN 0.65 WHEN 'title_keyword+job_function' THEN 0.72 WHEN 'job_function_tiebreak' THEN 0.6 ELSE 0.55 END::DOUBLE AS confidence, how FROM w""",
        ),
        "canonical_departments": (
            lambda s, d: _classified(s, d).select("id", departments.canonical_department(F.col("dept_primary"), F.col("layer")).alias("dept"), departments.canonical_sub_department(F.col("dept_secondary")).alias("sub_dept")),
            sql.CLASSIFIED + f" SELECT id, {departments.canonical_department_sql('dept_primary', 'layer')} AS dept, {departments.canonical_sub_department_sql('dept_secondary')} AS sub_dept FROM classified",
        ),
        "extra_departments": (
            lambda s, d: departments.extra_departments(table(s, d, "region_overlay").select(F.col("function").alias("dept"))),
            f"SELECT DISTINCT trim(function) AS dept FROM region_overlay WHERE trim(function) <> '' AND {departments.PRIMARY_OF.sql('lower(trim(function))')} IS NULL",
        ),
        # the industry directory
        "industry_best": (lambda s, d: directory.best_industry(_classified(s, d).select("id", "designation", "company", "industry_hint"), _directory(s, d).detection), None),
        "directory_layers": (lambda s, d: directory.layers(recs(s, d).filter("title is not null").select(F.col("person_id").alias("id"), F.col("title").alias("designation"), F.lit(None).cast("string").alias("industry")), _directory(s, d)), None),
        "directory_departments": (
            lambda s, d: directory.departments(recs(s, d).select(F.col("person_id").alias("id"), F.col("title").alias("designation"), F.lit("bank").alias("industry")), _directory(s, d)),
            r"""WITH k AS (SELECT DISTINCT archetype_id AS o, function AS dept, kw FROM (SELECT archetype_id, function, lower(function) AS kw FROM region_overlay WHERE archetype_id <> 'any' UNION ALL SELECT archetype_id, function, lower(regexp_split_to_array(normalized_title, '(?:, | of )')[-1]) FROM region_overlay WHERE archetype_id <> 'any')),
            t AS (SELECT DISTINCT lower(coalesce(title, '')) AS t FROM person_records), tw AS (SELECT t, list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM t),
            kf AS (SELECT *, list_filter(regexp_split_to_array(kw, '[^\p{L}\p{N}]+'), lambda x: x <> '')[1] AS w FROM k),
            m AS (SELECT t, o, dept, kw FROM tw JOIN kf ON list_contains(ws, w) AND CASE WHEN regexp_matches(kw, '[ &/-]') THEN contains(t, kw) ELSE list_contains(ws, kw) END),
            ow AS (SELECT t, arg_min(dept, (-n, dept)) AS own FROM (SELECT t, dept, sum(CASE WHEN regexp_matches(kw, '[ &/-]') THEN len(regexp_split_to_array(kw, ' +')) ELSE 1 END) AS n FROM m WHERE o = 'bank' GROUP BY ALL) GROUP BY t),
            wi AS (SELECT t, arg_min(dept, (-length(kw), kw, dept)) AS wide FROM m GROUP BY t)
            SELECT person_id AS id, coalesce(own, wide, 'Operations') AS dept, CASE WHEN own IS NOT NULL THEN 'industry' WHEN wide IS NOT NULL THEN 'any' ELSE 'default' END AS how FROM person_records p LEFT JOIN ow ON ow.t = lower(coalesce(p.title, '')) LEFT JOIN wi ON wi.t = lower(coalesce(p.title, ''))""",
        ),
        # trees
        "tree_rows": (lambda s, d: _tree_rows(s, d, tree.MOST_DEPTH), _tree_sql(tree.MOST_DEPTH)),
        "tree_cut": (lambda s, d: _tree_rows(s, d, 3), _tree_sql(3)),
        "dept_tree": (lambda s, d: _dept_tree(s, d, 2), _dept_sql(2)),
        "dept_nodes": (lambda s, d: tree.department_nodes(*catalog._graph(s, d)), sql.GRAPH + " SELECT node_id, node_type, label, node_id IN (SELECT parent_id FROM edges) AS has_more FROM nodes WHERE node_type IN ('global', 'dept_primary', 'dept_secondary', 'dept_tertiary')"),
        "dept_visit_order": (
            lambda s, d: tree.visit_order(*catalog._graph(s, d), ROOT).select("node_id", "depth"),
            sql.RECURSIVE + _PATHS.format(most=20, stop=_NOT_PERSON) + " SELECT node_id, min(depth) AS depth FROM pth JOIN nodes USING (node_id) WHERE node_type = 'dept_primary' GROUP BY ALL",
        ),
        "people_by_dept": (
            lambda s, d: (lambda g: tree.people_under(*g, g[0].filter("node_type = 'dept_primary'").select("node_id"), True))(catalog._graph(s, d)),
            sql.RECURSIVE + """, dp AS (SELECT node_id FROM nodes WHERE node_type = 'dept_primary'), pe AS (SELECT node_id FROM nodes WHERE node_type = 'person'),
            w(start_id, node_id) AS (SELECT node_id, node_id FROM dp UNION SELECT w.start_id, e.child_id FROM w JOIN edges e ON e.parent_id = w.node_id WHERE w.node_id NOT IN (SELECT node_id FROM pe) AND e.child_id NOT IN (SELECT node_id FROM dp))
            SELECT DISTINCT start_id, node_id FROM w WHERE node_id IN (SELECT node_id FROM pe)""",
        ),
        "tree_collapsed": (
            lambda s, d: (lambda g: tree.visible(g[1], g[0].filter(F.col("node_id") == ROOT).select("node_id"), g[0].filter("node_type = 'person'").select("node_id")))(catalog._graph(s, d)),
            sql.RECURSIVE + _PATHS.format(most=20, stop=_NOT_PERSON) + " SELECT node_id, min(depth) AS depth FROM pth GROUP BY ALL",
        ),
        "panel_tree": (lambda s, d: tree.layer_tree(_panel_people(s, d)), _PANELS + _LAYERED.format(src="pan") + " SELECT * FROM laid"),
        "board_tree": (
            lambda s, d: tree.board_tree(_panel_people(s, d).filter("panel like 'Board%'")),
            _PANELS + ", ch AS (SELECT panel, arg_min(id, (label, id)) AS chair FROM pan WHERE layer = 0 GROUP BY panel) SELECT panel, id, CASE WHEN layer <> 0 THEN chair END AS parent_id FROM pan LEFT JOIN ch USING (panel) WHERE panel LIKE 'Board%'",
        ),
        "executive_tree": (
            lambda s, d: tree.executive_tree(_panel_people(s, d).filter("panel like 'Exec%'")),
            _PANELS + f""", ep AS (SELECT *, min(layer) OVER (PARTITION BY panel) AS top FROM pan WHERE panel LIKE 'Exec%'),
            fa AS (SELECT panel, count(*) AS nt, arg_min(id, (label, id)) FILTER ({_LF['is_ceo']}) AS ceo FROM ep WHERE layer = top GROUP BY panel),
            jj AS (SELECT ep.*, CASE WHEN nt <= 1 THEN 'layers' WHEN ceo IS NOT NULL THEN 'led' ELSE 'flat' END AS mode, ceo FROM ep JOIN fa USING (panel)),
            rest AS (SELECT * FROM jj WHERE mode = 'layers' OR (mode = 'led' AND id <> ceo))""" + _LAYERED.format(src="rest") + """
            SELECT panel, id, NULL AS parent_id FROM jj WHERE mode = 'flat' OR (mode = 'led' AND id = ceo)
            UNION ALL SELECT l.panel, l.id, coalesce(l.parent_id, CASE WHEN r.mode = 'led' THEN r.ceo END) FROM laid l JOIN rest r ON r.panel = l.panel AND r.id = l.id""",
        ),
        # leadership
        "leaders_injected": (lambda s, d: leadership.injected(_leaders(s, d), _chart_people(s, d)).drop("method", "confidence"), INJECTED + " SELECT * FROM injected"),
        "leaders_upgraded": (
            lambda s, d: leadership.upgraded(_method_nodes(s, d), _leaders(s, d)).select("id", "method"),
            INJECTED + ", f AS (SELECT arg_min(id, ord) AS id FROM ppl WHERE ord % 3 = 0 AND key IN (SELECT key FROM ld WHERE key <> '') GROUP BY key) SELECT id, CASE WHEN id IN (SELECT id FROM f) THEN 'llm_leadership_web' WHEN ord % 3 = 0 THEN 'llm_leadership_ai' ELSE 'csv' END AS method FROM ppl",
        ),
        "panels_purged": (
            lambda s, d: (lambda r: r[0].select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.lit("").alias("b")).unionByName(r[1].select(F.lit("edge").alias("kind"), F.col("parent_id").alias("a"), F.col("child_id").alias("b"))))(leadership.purge(*_purge_input(s, d))),
            sql.CLASSIFIED + """, p AS (SELECT id, ord, ord % 5 = 0 AS web, CASE WHEN ord % 2 = 0 THEN 'dept__b' ELSE 'dept__e' END AS panel FROM classified WHERE layer <= 3), anyweb AS (SELECT count(*) > 0 AS x FROM p WHERE web),
            keep AS (SELECT panel AS a, id AS b FROM p WHERE web OR NOT (SELECT x FROM anyweb) UNION ALL SELECT 'dept__x', id FROM p WHERE ord % 7 = 0)
            SELECT 'edge' AS kind, a, b FROM keep UNION ALL SELECT 'node', id, '' FROM p WHERE id IN (SELECT b FROM keep) UNION ALL SELECT 'node', x, '' FROM (VALUES ('dept__b'), ('dept__e'), ('dept__x')) v(x)""",
        ),
        "people_promoted": (
            lambda s, d: leadership.promoted(_classified(s, d)).select("id", "dept", "at_layer"),
            sql.CLASSIFIED + f""", p AS (SELECT *, lower(designation) AS t, {_KEY('full_name')} AS key, {sql.flags('designation')['is_ceo']} AS ceo FROM classified WHERE full_name <> ''),
            c AS (SELECT *, regexp_matches(t, {quote(leadership.BOARD_CHAIR)}) AND NOT regexp_matches(t, '\\bcommittee\\b') AS chair, regexp_matches(t, {quote(leadership.BOARD_SEAT)}) OR contains(lower(dept_primary), 'board') AS seat FROM p WHERE key <> ''),
            b0 AS (SELECT *, 0 AS rk FROM (SELECT * FROM c WHERE chair ORDER BY layer, full_name, ord LIMIT 1) UNION ALL SELECT *, 1 FROM c WHERE NOT chair AND seat),
            b AS (SELECT * FROM (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY rk, layer, full_name, ord) = 1) ORDER BY rk, layer, full_name, ord LIMIT 20),
            ce AS (SELECT * FROM c WHERE ceo ORDER BY layer, full_name, ord LIMIT 1),
            hd AS (SELECT * FROM c WHERE ord NOT IN (SELECT ord FROM ce) AND lower(trim(dept_primary)) NOT IN ('', 'executive management', 'board of management', 'board of directors', 'board') QUALIFY row_number() OVER (PARTITION BY dept_primary ORDER BY layer, full_name, ord) = 1),
            e0 AS (SELECT *, 0 AS rk FROM ce UNION ALL SELECT *, 1 FROM hd WHERE (SELECT count(*) FROM ce) > 0 UNION ALL SELECT *, 2 FROM c WHERE layer <= 2 AND (SELECT count(*) FROM ce) = 0),
            e AS (SELECT * FROM e0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY rk, layer, full_name, ord) = 1)
            SELECT id, 'Board of Management' AS dept, CASE WHEN rk = 0 THEN 0 WHEN contains(t, 'independent') THEN 1 ELSE 2 END AS at_layer FROM b
            UNION ALL SELECT id, 'Executive Management', CASE rk WHEN 0 THEN 1 WHEN 1 THEN least(greatest(layer, 2), 4) ELSE layer END FROM e""",
        ),
        "enriched_panels": (lambda s, d: leadership.enrich(_classified(s, d), _leaders(s, d)).select("id", "dept", "at_layer", "method"), INJECTED + " SELECT id, dept, at_layer, 'llm_leadership_web' AS method FROM injected"),
        "leadership_ready": (
            lambda s, d: leadership.readiness(leadership.injected(_leaders(s, d), _chart_people(s, d))),
            INJECTED + " SELECT count(*) FILTER (contains(dept, 'Board')) AS board, count(*) FILTER (NOT contains(dept, 'Board')) AS executives, count(*) > 0 AS ready FROM injected",
        ),
        "public_people": (
            lambda s, d: leadership.merged_people(_leaders(s, d).filter("name is not null"), table(s, d, "person_candidates").filter("name is not null").select("name", "title", F.col("candidate_id").alias("ord"))).select("key", "name", "title", "source"),
            r"""WITH b AS (SELECT name, title, 0 AS source, leader_id AS ord FROM authoritative_leaders WHERE name IS NOT NULL UNION ALL SELECT name, title, 1, candidate_id FROM person_candidates WHERE name IS NOT NULL),
            k AS (SELECT *, array_to_string(list_slice(regexp_split_to_array(trim(regexp_replace(lower(name), '[^\p{L}\p{N}\s]', '', 'g')), '\s+'), 1, 3), ' ') AS key FROM b)
            SELECT key, name, title, source FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY source, ord) = 1""",
        ),
        "chief_first": (
            lambda s, d: leadership.chief_first(_leaders(s, d).filter("name is not null and title is not null"), "x"),
            f"""WITH l AS (SELECT *, coalesce(is_board, false) AS b FROM authoritative_leaders WHERE name IS NOT NULL AND title IS NOT NULL), r AS (SELECT * FROM l WHERE NOT b AND (regexp_matches(lower(title), 'ceo|chief executive|directeur général') OR starts_with(lower(title), 'president') OR contains(title, '代表取締役')) ORDER BY leader_id LIMIT 1)
            SELECT 'L' || leader_id AS id, name, title, 'Strategy' AS function, 1 AS level, NULL AS reports_to FROM r UNION ALL SELECT 'L' || leader_id, name, title, {T.leader_function_sql('title')}, CASE WHEN b THEN 1 ELSE 2 END, CASE WHEN NOT b THEN 'L' || (SELECT leader_id FROM r) END FROM l WHERE name NOT IN (SELECT name FROM r)""",
        ),
        "unassigned_branches": (
            lambda s, d: (lambda st: leadership.with_unassigned(st, taxonomy.find_parents(st), "root")[0])(_staff(s, d)),
            sql.PARENTS + """, x AS (SELECT s.*, u.parent_id, s.function = 'Unclassified' OR s.level >= 99 AS lost FROM staff s LEFT JOIN up u USING (id))
            SELECT DISTINCT 'unassigned__' || regexp_replace(lower(concat_ws('__', CASE WHEN lost THEN 'Unclassified' ELSE function END, region)), '[^a-z0-9_]', '_', 'g') AS id, CASE WHEN lost THEN 'Unclassified' ELSE function END || ' — Unassigned' AS name, CASE WHEN lost THEN 'Unclassified' ELSE function END AS function, region, 2 AS level, 'root' AS parent_id
            FROM x WHERE lost OR (parent_id IS NULL AND level > 1)""",
        ),
        "company_contexts": (lambda s, d: leadership.companies(_classified(s, d)), sql.CLASSIFIED + " SELECT company, arg_min(sector, ord) AS sector, arg_min(region, ord) AS region, count(*) AS n FROM classified WHERE company <> '' GROUP BY company"),
        "insert_order": (lambda s, d: leadership.insert_order(_classified(s, d).withColumn("at_layer", F.col("layer"))).select("id", "n"), sql.CLASSIFIED + " SELECT id, row_number() OVER (ORDER BY layer, ord) AS n FROM classified"),
        # reports
        "mapped_records": (
            lambda s, d: reports.complete(reports.map_records(recs(s, d))).select("person_id", "name", "title", "company", "geography"),
            _MAPPED + f" SELECT person_id, name, title, coalesce(c, nullif({_CAP('replace(slug, ' + quote('-') + ', ' + quote(' ') + ')')}, ''), {_CAP('dom')}, '') AS company, geography FROM m WHERE name <> '' AND title <> ''",
        ),
        "reporting_titles": (
            lambda s, d: (lambda st: reports.chains(st, taxonomy.find_parents(st)))(_staff(s, d)),
            sql.PARENTS.replace("WITH o AS", "WITH RECURSIVE o AS", 1) + """,
            walk(id, at_id, chain, depth) AS (SELECT id, id, coalesce(title, ''), 0 FROM staff UNION ALL SELECT w.id, u.parent_id, coalesce(b.name, '') || ' (' || coalesce(b.title, '') || ') > ' || w.chain, depth + 1 FROM walk w JOIN up u ON u.id = w.at_id JOIN staff b ON b.id = u.parent_id WHERE u.parent_id IS NOT NULL AND depth < 20)
            SELECT id, arg_max(chain, depth) AS chain FROM walk GROUP BY id""",
        ),
        "long_sheet": (
            lambda s, d: (lambda st: reports.sheet(st, taxonomy.find_parents(st)).select("id", "function", "level", "reports_to_name", "n_reports"))(_staff(s, d)),
            sql.PARENTS + ", n AS (SELECT parent_id, count(*) AS c FROM up GROUP BY ALL) SELECT s.id, s.function, s.level, b.name AS reports_to_name, coalesce(n.c, 0) AS n_reports FROM staff s LEFT JOIN up u ON u.id = s.id LEFT JOIN staff b ON b.id = u.parent_id LEFT JOIN n ON n.parent_id = s.id",
        ),
        "canonical_json": (lambda s, d: (lambda st: reports.canonical_json(st, taxonomy.find_parents(st)))(_staff(s, d)), None),
        "country_members": (lambda s, d: reports.members(_staff(s, d).withColumn("country", F.coalesce("country", F.lit("Unknown"))), "country"), sql.RECONCILED + " SELECT coalesce(country, 'Unknown') AS country, level, id, row_number() OVER (PARTITION BY coalesce(country, 'Unknown') ORDER BY level, ord, id) - 1 AS nth FROM staff"),
        "entity_members": (
            lambda s, d: reports.members(_staff(s, d).withColumn("entity", F.coalesce(missing_to_null("legal_entity"), F.lit(catalog.FIRM))), "entity").select("entity", "id"),
            sql.RECONCILED + f" SELECT coalesce({sql.missing('legal_entity')}, '{catalog.FIRM}') AS entity, id FROM staff",
        ),
        "geographic_tree": (
            lambda s, d: reports.geographic_tree(_staff(s, d)),
            sql.RECONCILED + f""", x AS (SELECT *, coalesce(regexp_matches(lower(title), '{taxonomy.COUNTRY_LEADER}'), false) AS ex FROM staff)
            SELECT 'Global' AS country, arg_min(id, ord) AS id FROM x WHERE level = 1 HAVING arg_min(id, ord) IS NOT NULL
            UNION ALL SELECT country, id FROM (SELECT country, id FROM x WHERE country IS NOT NULL AND (ex OR level < 99) QUALIFY row_number() OVER (PARTITION BY country ORDER BY NOT ex, level, ord) = 1)""",
        ),
        "functional_roots": (lambda s, d: (lambda st: reports.functional_roots(st, taxonomy.find_parents(st)).select("id"))(_staff(s, d)), sql.PARENTS + " SELECT id FROM staff WHERE level = 1 AND id NOT IN (SELECT id FROM up WHERE parent_id IS NOT NULL)"),
        "classified_count": (lambda s, d: reports.classified_count(_staff(s, d)), sql.RECONCILED + " SELECT count(*) AS total, count(*) FILTER (function <> 'Unclassified') AS classified FROM staff"),
        "managers_by_name": (
            lambda s, d: reports.managers_by_name(recs(s, d).withColumn("id", F.col("person_id")).withColumn("ord", F.col("person_id"))),
            "WITH n AS (SELECT lower(trim(name)) AS k, company, min(person_id) AS m FROM person_records WHERE name IS NOT NULL GROUP BY ALL) SELECT person_id AS id, CASE WHEN m <> person_id THEN m END AS manager_id FROM person_records r LEFT JOIN n ON n.k = lower(trim(r.reports_to_name)) AND n.company = r.company WHERE trim(coalesce(reports_to_name, '')) <> ''",
        ),
        "mermaid_footer": (lambda s, d: reports.mermaid_footer(_staff(s, d), STAFF_LEVELS), sql.RECONCILED + f" SELECT '%% ' || count(*) FILTER (level <= {STAFF_LEVELS}) || ' of ' || count(*) || ' people, levels up to {STAFF_LEVELS}' AS line FROM staff"),
        "panel_export": (
            lambda s, d: reports.panel_rows(leadership.injected(_leaders(s, d), _chart_people(s, d)).withColumn("location", F.lit(""))),
            INJECTED + " SELECT full_name AS \"Name\", designation AS \"Title\", dept AS \"Panel\", at_layer::VARCHAR AS \"Layer\", region AS \"Region\", '' AS \"Location\", linkedin_url AS \"LinkedIn\", 'llm_leadership_web' AS \"Source\" FROM injected",
        ),
        "promote_at_threshold": (
            lambda s, d: ledger.verdicts(_by_function(s, d), THRESHOLD).select("archetype", "title_l", "corrections", "outcomes"),
            f"WITH k AS (SELECT archetype, lower({sql.strip('original_function')}) AS t, corrected_level, corrected_function FROM corrections) SELECT archetype, t AS title_l, count(*) AS corrections, count(DISTINCT (corrected_level, corrected_function)) AS outcomes FROM k GROUP BY ALL HAVING count(*) >= {THRESHOLD}",
        ),
        "overlay_appended": (
            lambda s, d: reports.append_overlay(table(s, d, "region_overlay"), ledger.promotions(table(s, d, "corrections"), table(s, d, "region_overlay"), catalog.PROMOTE)).groupBy("archetype_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("notes").startswith("promoted")).alias("promoted")),
            "WITH p AS (" + catalog.oracle_sql()["promote_consensus"] + "), o AS (SELECT archetype_id, false AS x FROM region_overlay UNION ALL SELECT archetype, true FROM p) SELECT archetype_id, count(*) AS n, count(*) FILTER (x) AS promoted FROM o GROUP BY ALL",
        ),
        "versions_bumped": (
            lambda s, d: reports.bump_versions(table(s, d, "region_overlay").select("archetype_id").distinct().withColumn("version", F.lit(1)), ledger.promotions(table(s, d, "corrections"), table(s, d, "region_overlay"), catalog.PROMOTE)),
            "WITH p AS (" + catalog.oracle_sql()["promote_consensus"] + ") SELECT DISTINCT archetype_id, 1 + (archetype_id IN (SELECT archetype FROM p))::INT AS version FROM region_overlay",
        ),
        "corrections_checked": (
            lambda s, d: library.valid_corrections(table(s, d, "corrections")).groupBy(F.size("missing").alias("lacking")).agg(F.count(F.lit(1)).alias("n")),
            "SELECT " + " + ".join(f"({f} IS NULL)::INT" for f in library.REQUIRED_CORRECTION) + " AS lacking, count(*) AS n FROM corrections GROUP BY ALL",
        ),
        "industry_lists": (lambda s, d: reports.industries(s), "SELECT * FROM (VALUES " + ", ".join(f"({quote(k)}, {quote(x)}, {i})" for k, xs in reports.INDUSTRY_DEPARTMENTS.items() for i, x in enumerate(xs)) + ") v(kind, dept, nth)"),
        "pages_to_try": (
            lambda s, d: library.ranked_addresses(_leaders(s, d).select(F.regexp_replace(library.host_of("source_url"), "^www\\.", "").alias("domain")).distinct().withColumn("firm", F.col("domain"))).groupBy("firm").agg(F.count(F.lit(1)).alias("n"), F.min_by("url", "rank").alias("best")),
            rf"WITH f AS (SELECT DISTINCT regexp_replace(regexp_extract(lower(source_url), '^\s*[a-z][a-z0-9+.-]*://([^/?#:\s]+)', 1), '^www\.', '') AS firm FROM authoritative_leaders) SELECT firm, {2 * len(library.LEADER_PATHS)}::BIGINT AS n, 'https://www.' || firm || '{library.LEADER_PATHS[0]}' AS best FROM f WHERE firm <> ''",
        ),
        "slides_with_heads": (
            lambda s, d: layout.slides(catalog._placed(s, d)).select("dept", "id", "is_head", "is_orphan"),
            sql.PLACED + " SELECT dept, id, id = first_value(id) OVER (PARTITION BY dept ORDER BY at_layer, full_name, id) AS is_head, sub_dept = '' AND bool_or(sub_dept <> '') OVER (PARTITION BY dept) AS is_orphan FROM placed",
        ),
        "panel_labels": (
            lambda s, d: layout.panel_labels(leadership.injected(_leaders(s, d), _chart_people(s, d))).select("id", "label", "role_label"),
            INJECTED + f" SELECT id, CASE WHEN contains(dept, 'Board') THEN coalesce({R.BOARD_LABELS.sql('at_layer')}, {R.PANEL_LABELS.sql('at_layer')}) ELSE {R.PANEL_LABELS.sql('at_layer')} END AS label, coalesce({R.BOARD_ROLE_LABELS.sql('board_sub_role')}, '') AS role_label FROM injected",
        ),
        "executives_with_total": (
            lambda s, d: reports.page_with_total(_classified(s, d).filter("layer <= 3").select("id", "layer"), ["layer", "id"], 5, 50),
            sql.CLASSIFIED + " SELECT id, layer, count(*) OVER () AS total FROM classified WHERE layer <= 3 ORDER BY layer, id LIMIT 50 OFFSET 5",
        ),
        "wire_nodes": (
            lambda s, d: reports.wire_nodes(recs(s, d).withColumn("id", F.col("person_id"))),
            f"SELECT person_id::VARCHAR AS node_id, coalesce({sql.strip('name')}, '') AS label, 10 AS layer, coalesce({sql.strip('title')}, '') AS designation, coalesce({sql.strip('department')}, '') AS department, '' AS sector, '' AS linkedin_url FROM person_records",
        ),
        "metadata_round_trip": (
            lambda s, d: recs(s, d).select("person_id", misc.unpack_metadata(misc.pack_metadata("name", "title"), "name string, title string").alias("m")).select("person_id", "m.name", "m.title"),
            "SELECT person_id, name, title FROM person_records",
        ),
        "layers_by_level": (
            lambda s, d: recs(s, d).select("person_id", people.layer(F.coalesce("title", F.lit("")), job_level=F.col("vendor_level")).alias("layer")),
            f"WITH r AS (SELECT person_id, coalesce(title, '') AS t, {R.JOB_LEVELS.sql('lower(' + sql.strip('vendor_level') + ')')} AS jl FROM person_records) SELECT person_id, CASE WHEN regexp_replace(lower({sql.strip('t')}), {quote(R.OFFICE_OF)}, ' ', 'g') = '' THEN coalesce(jl, 10) ELSE coalesce({sql.acronym('t', R.ACRONYMS)}, {R.CORPORATE_LAYERS.sql('regexp_replace(lower(' + sql.strip('t') + '), ' + quote(R.OFFICE_OF) + ', ' + quote(' ') + ', ' + quote('g') + ')')}, jl, 10) END AS layer FROM r",
        ),
        # page texts
        "js_shells": (
            lambda s, d: table(s, d, "provenance").select("entry_id", markup.is_js_shell("raw_evidence").alias("shell")),
            r"SELECT entry_id, length(coalesce(trim(regexp_replace(regexp_replace(regexp_replace(raw_evidence, '(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '')) < 300 AS shell FROM provenance",
        ),
        "marker_slices": (
            lambda s, d: table(s, d, "provenance").select("entry_id", markup.marker_slice(T.fold("raw_evidence"), "board of directors").alias("slice")).filter("slice is not null"),
            f"WITH x AS (SELECT entry_id, {T.fold_sql('raw_evidence')} AS t, strpos(upper({T.fold_sql('raw_evidence')}), 'BOARD OF DIRECTORS') AS p FROM provenance) SELECT entry_id, substr(t, greatest(p - 200, 1), p + 4000 - greatest(p - 200, 1)) AS slice FROM x WHERE p > 0",
        ),
        "item_sections": (
            lambda s, d: table(s, d, "provenance").filter("raw_evidence is not null").select("entry_id", F.length(markup.between_markers("raw_evidence", ("BOARD OF DIRECTORS",), "COMMITTEE")).alias("n")),
            None,
        ),
        "leader_sections": (
            lambda s, d: markup.carve_sections(table(s, d, "provenance").filter("raw_evidence is not null"), "entry_id", "raw_evidence").select("id", "line_no"),
            rf"""WITH l AS (SELECT entry_id AS id, unnest(range(1, len(string_split(raw_evidence, chr(10))) + 1))::INT AS line_no, trim(unnest(string_split(raw_evidence, chr(10)))) AS line FROM provenance WHERE raw_evidence IS NOT NULL),
            t AS (SELECT *, CASE WHEN regexp_matches(line, {quote(markup.SECTION_OPENS)}) THEN true WHEN regexp_matches(line, {quote(markup.SECTION_ENDS)}) AND length(line) < 60 THEN false END AS turn FROM l WHERE line <> '')
            SELECT id, line_no FROM (SELECT id, line_no, last_value(turn IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS inside FROM t) WHERE inside""",
        ),
        "name_evidence": (
            lambda s, d: table(s, d, "provenance").select("entry_id", markup.name_evidence("name", "raw_evidence").alias("named")),
            f"""WITH x AS (SELECT entry_id, name, lower(name) AS n, coalesce(lower(raw_evidence), '') AS s FROM provenance), y AS (SELECT *, {T.fold_sql('n')} AS nf, {T.fold_sql('s')} AS sf FROM x)
            SELECT entry_id, CASE WHEN length(s) < 200 THEN true ELSE coalesce(trim(name), '') <> '' AND coalesce({_evidence('n', 's')} OR {_evidence('nf', 'sf')}, false) END AS named FROM y""",
        ),
    }


def _overlay_sql(mode: str) -> str:
    text = sql.overlay(mode)
    a = text.index("p AS (SELECT 'v' || person_id")
    b = text.index("\n", a)
    return text[:a] + f"p AS (SELECT 'v' || correction_id AS id, lower({sql.strip('original_title_native')}) AS key, coalesce(region, 'Global') AS region, coalesce(archetype, 'any') AS archetype, coalesce(sub_industry, '') AS sub FROM corrections)," + text[b:]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _q().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for k, (_, q) in _q().items() if q}
