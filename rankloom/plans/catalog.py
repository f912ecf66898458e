"""The core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import rules as R
from rankloom.functions import web
from rankloom.functions.text import missing_to_null, strip
from rankloom.operators import graph, layout, ledger, people, schema_drift, taxonomy
from rankloom.plans import sql
from rankloom.session import cut
from rankloom.tables import table

FIRM = "Krölevo Ceramics Corp."
PROMOTE = 2  #: threshold of the promotion queries: on these tables patterns repeat but a few times


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.report_changes(spark.read.parquet(f"{d}/raw_uploads.parquet"))


def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.unify(table(spark, d, "raw_uploads"))


def p6_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.alternatives(table(spark, d, "raw_uploads"))


_ALTERNATIVES_SQL = """
WITH u AS (SELECT DISTINCT feed, file_no, line_no, payload FROM raw_uploads WHERE feed IS NOT NULL AND file_no IS NOT NULL AND json_valid(payload)),
o AS (SELECT * FROM u WHERE json_type(payload) = 'OBJECT'),
t AS (SELECT feed, file_no, unnest(list_filter((SELECT list((fullkey, type)) FROM json_tree(o.payload)), lambda x: x[1] <> '$')) AS x FROM o),
k AS (SELECT feed, file_no, replace(substr(regexp_replace(x[1], '\\[\\d+\\]', '[]', 'g'), 3), '"', '') AS path, CASE WHEN x[2] = 'VARCHAR' THEN 'text' WHEN x[2] IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' WHEN x[2] = 'BOOLEAN' THEN 'boolean' WHEN x[2] = 'ARRAY' THEN 'list' WHEN x[2] = 'OBJECT' THEN 'object' END AS kind FROM t),
f AS (SELECT feed, file_no, path, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL)
SELECT f.*, EXISTS (SELECT 1 FROM f p WHERE p.feed = f.feed AND p.file_no = f.file_no - 1) AND NOT EXISTS (SELECT 1 FROM f p WHERE p.feed = f.feed AND p.file_no = f.file_no - 1 AND p.path = f.path AND p.kind = f.kind) AS appears FROM f"""


def _people(s: SparkSession, d: str) -> DataFrame:
    return people.normalize(table(s, d, "test_data"))


def _current(s: SparkSession, d: str) -> DataFrame:
    return people.current(_people(s, d))


def _classified(s: SparkSession, d: str) -> DataFrame:
    return people.classify(_current(s, d))


def _placed(s: SparkSession, d: str) -> DataFrame:
    return cut(people.place(_classified(s, d)).withColumn("ord", F.substring("id", 2, 20).cast("long")))  # evaluated once, read by every table made of it


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = graph.build(_placed(s, d))
    return cut(nodes), cut(edges)


def _records(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "person_records").withColumn("id", F.concat(F.lit("v"), F.col("person_id").cast("string")))


def _overlay(s: SparkSession, d: str, mode: str) -> DataFrame:
    p = _records(s, d).select("id", "title", F.col("job_country").alias("region"), F.lit("maker").alias("archetype"), F.lit("regional").alias("sub_industry"))
    return taxonomy.lookup_overlay(p, table(s, d, "region_overlay"), mode)


def _reconciled(s: SparkSession, d: str) -> DataFrame:
    hits = _overlay(s, d, "v2").select("id", F.col("function").alias("r_function"), F.col("level").alias("r_level"))
    rule = _records(s, d).select("id", "title").join(hits, "id", "left").withColumn("cascade_only", F.lit(False))
    return taxonomy.reconcile(rule, taxonomy.vendor_classes(_records(s, d)))


def _staff(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d).select("id", missing_to_null("job_country").alias("country"), F.col("person_id").alias("ord"), "name", "title", F.col("subsidiary").alias("legal_entity"))
    return _reconciled(s, d).select("id", "function", "level").join(r, "id").withColumn("region", F.coalesce("country", F.lit("Global")))


def _kg(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    st = _staff(s, d)
    return taxonomy.knowledge_graph(st, taxonomy.find_parents(st), FIRM)


def _below(s: SparkSession, d: str, dept: str) -> DataFrame:
    nodes, edges = _graph(s, d)
    walls = F.col("node_id").isin([r["node_id"] for r in nodes.filter("node_type = 'dept_primary'").select("node_id").collect()])  # as many as departments
    start = nodes.filter(F.col("node_id") == dept).select("node_id")
    return graph.descend(edges, start, until=walls).join(nodes.filter("node_type = 'person'"), "node_id").select("node_id", "label", "layer")


_FLAG_COLS = ("is_chairman", "is_vice_chair", "is_committee_chair", "is_ceo", "is_csuite", "is_regional", "board_sub_role", "exec_region")
_DEPT = "dept__human_resources"
_RECORD_TITLES = f"SELECT leader_id, {', '.join(f'{v} AS {k}' for k, v in sql.flags('title').items())} FROM authoritative_leaders WHERE title IS NOT NULL"


def _flags(s: SparkSession, d: str) -> DataFrame:
    f = people.exec_flags(F.col("title"))
    return table(s, d, "authoritative_leaders").filter("title is not null").select("leader_id", *[f[k].alias(k) for k in _FLAG_COLS])


def _dual_roles(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "person_candidates").filter("name is not null").select(F.regexp_replace(F.lower("name"), "[^a-z]", "").alias("k"), "firm", "is_board")
    return c.filter("is_board").select("k", "firm").intersect(c.filter("not is_board").select("k", "firm"))


def _search(text: str):
    return lambda s, d: graph.search(_graph(s, d)[0], text).select("node_id", "label")


def _q() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    P, C, K, L, G = sql.PEOPLE, sql.CURRENT, sql.CLASSIFIED, sql.PLACED, sql.GRAPH
    low = "lower(title)"
    return {
        "people_normalized": (lambda s, d: _people(s, d), P + " SELECT * EXCLUDE (ord) FROM people"),
        "current_people": (lambda s, d: _current(s, d).select("id", "full_name", "designation"), C + " SELECT id, full_name, designation FROM cur"),
        "compound_title_fanout": (
            lambda s, d: people.fan_out(_current(s, d)).select("id", "part", "designation"),
            C + ", " + _fan_sql() + " SELECT id, part, designation FROM fan",
        ),
        "layer_corporate": (lambda s, d: _current(s, d).select("id", people.layer(F.col("designation")).alias("layer")), C + f" SELECT id, {sql.layer('designation')} AS layer FROM cur"),
        "layer_financial": (lambda s, d: _current(s, d).select("id", people.layer(F.col("designation"), True).alias("layer")), C + f" SELECT id, {sql.layer('designation', True)} AS layer FROM cur"),
        "layer_acronym": (
            lambda s, d: table(s, d, "authoritative_leaders").filter("title is not null").select("leader_id", people.acronym_layer(F.col("title")).alias("layer")),
            f"SELECT leader_id, {sql.acronym('title', R.ACRONYMS)} AS layer FROM authoritative_leaders WHERE title IS NOT NULL",
        ),
        "dept_scores": (
            lambda s, d: _current(s, d).select("designation").distinct().select("designation", F.explode(people.department_scores(F.col("designation"))).alias("x")).select("designation", "x.dept", "x.score"),
            sql.SCORES + " SELECT designation, dept, score FROM scored",
        ),
        "dept_top_gap": (
            lambda s, d: _current(s, d).select("designation").distinct().withColumn("s", people.department_scores(F.col("designation"))).select("designation", F.col("s")[0]["dept"].alias("dept"), F.col("s")[0]["score"].alias("score"), (F.col("s")[0]["score"] - F.col("s")[1]["score"]).alias("gap")),
            sql.SCORES + " SELECT designation, dept, score, gap FROM best",
        ),
        "classified_people": (
            lambda s, d: _classified(s, d).select("id", "layer", "dept_primary", "dept_secondary", "confidence", "sector", "region"),
            K + " SELECT id, layer, dept_primary, dept_secondary, confidence, sector, region FROM classified",
        ),
        "bare_department": (lambda s, d: _current(s, d).select("id", people.bare_department(F.col("designation")).alias("dept")), C + f" SELECT id, {sql._BARE} AS dept FROM cur"),
        "sector_counts": (lambda s, d: _classified(s, d).groupBy("sector").count().withColumnRenamed("count", "n"), K + " SELECT sector, count(*) AS n FROM classified GROUP BY ALL"),
        "region_counts": (lambda s, d: _classified(s, d).groupBy("region").count().withColumnRenamed("count", "n"), K + " SELECT region, count(*) AS n FROM classified GROUP BY ALL"),
        "script_detect": (
            lambda s, d: table(s, d, "test_data").filter("Designation is not null").select("row_id", R.SCRIPTS.column(F.col("Designation"), "plain").alias("script")),
            f"SELECT row_id, {R.SCRIPTS.sql(chr(34) + 'Designation' + chr(34), 'plain')} AS script FROM test_data WHERE \"Designation\" IS NOT NULL",
        ),
        "leader_predicates": (_flags, _RECORD_TITLES),
        "placed_people": (lambda s, d: _placed(s, d).select("id", "dept", "sub_dept", "at_layer"), L + " SELECT id, dept, sub_dept, at_layer FROM placed"),
        "org_nodes": (lambda s, d: _graph(s, d)[0], G + " SELECT * FROM nodes"),
        "org_edges": (lambda s, d: _graph(s, d)[1], G + " SELECT * FROM edges"),
        "ghost_chain": (lambda s, d: graph.chains(_placed(s, d))[1].select("node_id", "parent", "layer"), G + " SELECT node_id, parent, layer FROM ghosts"),
        "governance_repair": (lambda s, d: graph.repair(*_graph(s, d)), G + " SELECT * FROM edges"),
        "subtree": (lambda s, d: (lambda g: graph.depths(*g).join(g[0], "node_id").select("node_id", "label", "depth"))(_graph(s, d)), sql.RECURSIVE + sql.DOWN + " SELECT node_id, label, depth FROM depth JOIN nodes USING (node_id)"),
        "graph_stats": (
            lambda s, d: graph.stats(*_graph(s, d)),
            sql.RECURSIVE + sql.DOWN + " SELECT count(*) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, count(*) FILTER (node_type = 'person') AS total_people, count(*) FILTER (is_ghost) AS total_ghosts, (SELECT max(depth)::BIGINT FROM depth) AS max_depth FROM nodes",
        ),
        "dept_headcount": (
            lambda s, d: graph.headcount(*_graph(s, d)),
            sql.RECURSIVE + """,
            inner_e AS (SELECT * FROM edges WHERE parent_id NOT IN (SELECT node_id FROM nodes WHERE node_type = 'person')),
            walk(start_id, node_id) AS (SELECT node_id, node_id FROM nodes WHERE node_type LIKE 'dept%' UNION SELECT w.start_id, e.child_id FROM walk w JOIN inner_e e ON e.parent_id = w.node_id)
            SELECT start_id AS node_id, count(*) FILTER (n.node_type = 'person') AS headcount FROM walk w JOIN nodes n ON n.node_id = w.node_id GROUP BY ALL""",
        ),
        "executives": (
            lambda s, d: _below(s, d, _DEPT),
            sql.RECURSIVE + f""",
            walk(node_id) AS (SELECT '{_DEPT}' UNION SELECT e.child_id FROM walk w JOIN edges e ON e.parent_id = w.node_id WHERE e.child_id NOT IN (SELECT node_id FROM nodes WHERE node_type = 'dept_primary'))
            SELECT node_id, label, layer FROM walk JOIN nodes USING (node_id) WHERE node_type = 'person'""",
        ),
        "executives_page": (
            lambda s, d: graph.paged(_below(s, d, _DEPT), ["layer", "label", "node_id"], 5, 50),
            sql.RECURSIVE + f""",
            walk(node_id) AS (SELECT '{_DEPT}' UNION SELECT e.child_id FROM walk w JOIN edges e ON e.parent_id = w.node_id WHERE e.child_id NOT IN (SELECT node_id FROM nodes WHERE node_type = 'dept_primary'))
            SELECT node_id, label, layer FROM walk JOIN nodes USING (node_id) WHERE node_type = 'person' ORDER BY layer, label, node_id LIMIT 50 OFFSET 5""",
        ),
        "search_nodes": (_search("ma%ge"), G + " SELECT node_id, label FROM nodes WHERE lower(label) LIKE '%ma%ge%' OR lower(sector) LIKE '%ma%ge%' OR lower(node_type) LIKE '%ma%ge%'"),
        "reporting_chain": (
            lambda s, d: graph.reporting_chain(*_graph(s, d)),
            sql.RECURSIVE + """,
            upw AS (SELECT child_id, min(parent_id) AS parent_id FROM edges GROUP BY child_id),
            ppl AS (SELECT node_id, label FROM nodes WHERE node_type = 'person'),
            walk(node_id, at_id, chain) AS (
              SELECT node_id, node_id, '' FROM ppl
              UNION ALL SELECT w.node_id, u.parent_id, CASE WHEN p.label IS NULL THEN w.chain WHEN w.chain = '' THEN p.label ELSE p.label || ' > ' || w.chain END
              FROM walk w JOIN upw u ON u.child_id = w.at_id LEFT JOIN ppl p ON p.node_id = u.parent_id
            )
            SELECT node_id, chain FROM walk WHERE at_id NOT IN (SELECT child_id FROM upw)""",
        ),
        "export_people": (
            lambda s, d: layout.export(_placed(s, d)),
            L + f" SELECT full_name AS name, designation AS title, CASE WHEN contains(dept, 'Board') THEN 'Board of Directors' WHEN contains(dept, 'Executive') THEN 'Executive Management' WHEN dept = '' THEN 'Other' ELSE dept END AS category, dept AS department, {R.SENIORITY_LABELS.sql('at_layer')} AS seniority, region, location, linkedin_url, 'Uploaded Data' AS source, id FROM placed WHERE at_layer <= 8",
        ),
        "layer_histogram": (lambda s, d: layout.histogram(_placed(s, d)), L + f" SELECT at_layer, {R.SENIORITY_LABELS.sql('at_layer')} AS label, count(*) AS n FROM placed GROUP BY ALL"),
        "slide_layout": (
            lambda s, d: layout.columns_of_four(_placed(s, d)),
            L + """,
            r AS (SELECT *, row_number() OVER (PARTITION BY dept, sub_dept ORDER BY at_layer, full_name, id) - 1 AS rn FROM placed),
            c AS (SELECT dept, sub_dept, ceil(count(*) / 4.0)::BIGINT AS n_cols FROM placed GROUP BY ALL),
            b AS (SELECT dept, sub_dept, coalesce(sum(n_cols) OVER (PARTITION BY dept ORDER BY sub_dept ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_col FROM c)
            SELECT r.dept, r.sub_dept, id, first_col + rn // 4 AS col, rn % 4 AS row, (first_col + rn // 4) // 6 AS slide FROM r JOIN b ON b.dept = r.dept AND b.sub_dept = r.sub_dept""",
        ),
        "spread_under_heads": (
            lambda s, d: (lambda p: layout.spread_under(p.filter("at_layer = 5"), p.filter("at_layer = 7"), "dept"))(_placed(s, d)),
            L + """,
            h AS (SELECT dept, id AS head_id, row_number() OVER (PARTITION BY dept ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY dept) AS n FROM placed WHERE at_layer = 5),
            m AS (SELECT dept, id, row_number() OVER (PARTITION BY dept ORDER BY ord) - 1 AS j, count(*) OVER (PARTITION BY dept) AS m FROM placed WHERE at_layer = 7)
            SELECT id, head_id FROM m JOIN h ON h.dept = m.dept AND j >= i * m // n AND j < (i + 1) * m // n""",
        ),
        "department_heads": (lambda s, d: layout.department_heads(_placed(s, d)), L + " SELECT dept, id, full_name, at_layer FROM placed QUALIFY row_number() OVER (PARTITION BY dept ORDER BY at_layer, full_name, ord) = 1"),
        "mode_company": (
            lambda s, d: layout.most_common(table(s, d, "test_data").select(F.coalesce(missing_to_null("Company"), F.lit("")).alias("company"), "row_id"), "company", "row_id"),
            P + " SELECT company AS value, count(*) AS n FROM people WHERE company <> '' GROUP BY ALL ORDER BY n DESC, min(ord) LIMIT 1",
        ),
        "region_groups": (
            lambda s, d: layout.region_groups(_placed(s, d)),
            L + ", g AS (SELECT region, count(*) AS n, min(at_layer) AS top FROM placed GROUP BY ALL) SELECT region, n, top <= 1 AS apex, row_number() OVER (ORDER BY top > 1, n DESC, region) AS rank FROM g",
        ),
        "overlay_5pass_v2": (lambda s, d: _overlay(s, d, "v2"), sql.overlay("v2") + " SELECT * FROM ruled"),
        "overlay_5pass_nlp": (lambda s, d: _overlay(s, d, "nlp"), sql.overlay("nlp") + " SELECT * FROM ruled"),
        "cascade_lookup": (lambda s, d: taxonomy.cascade(_records(s, d), table(s, d, "region_overlay").select(F.col("normalized_title").alias("entry"))), _CASCADE_SQL),
        "vendor_map": (lambda s, d: taxonomy.vendor_classes(_records(s, d)), "WITH" + sql.VENDOR + " SELECT * FROM vendor"),
        "rule_vendor_reconcile": (_reconciled, sql.RECONCILED + " SELECT * FROM reconciled"),
        "find_parent": (lambda s, d: taxonomy.find_parents(_staff(s, d)), sql.PARENTS + " SELECT * FROM up"),
        "geographic_roots": (
            lambda s, d: taxonomy.geographic_roots(_staff(s, d)),
            sql.RECONCILED + f", e AS (SELECT *, coalesce(regexp_matches(lower(title), '{taxonomy.COUNTRY_LEADER}'), false) AS x FROM staff WHERE country IS NOT NULL) SELECT country, id FROM e WHERE x OR level < 99 QUALIFY row_number() OVER (PARTITION BY country ORDER BY NOT x, level, ord) = 1",
        ),
        "geographic_pivot": (lambda s, d: _staff(s, d).groupBy(F.coalesce("country", F.lit("Unknown")).alias("country")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")), sql.RECONCILED + " SELECT coalesce(country, 'Unknown') AS country, count(*) AS n, min(id) AS first_id FROM staff GROUP BY 1"),
        "legal_entity_graph": (
            lambda s, d: taxonomy.legal_entities(_staff(s, d), FIRM),
            sql.RECONCILED + f", e AS (SELECT coalesce({sql.missing('legal_entity')}, '{FIRM}') AS entity, id FROM staff) SELECT entity, CASE WHEN entity <> '{FIRM}' THEN '{FIRM}' END AS parent, count(DISTINCT id) AS n_people FROM e GROUP BY entity",
        ),
        "kg_nodes": (
            lambda s, d: _kg(s, d)[0],
            sql.RECONCILED + f" SELECT 'Person' AS kind, id AS key FROM staff UNION SELECT 'Function', function FROM staff UNION SELECT 'Region', region FROM staff UNION SELECT 'LegalEntity', coalesce({sql.missing('legal_entity')}, '{FIRM}') FROM staff",
        ),
        "kg_edges": (
            lambda s, d: _kg(s, d)[1],
            sql.PARENTS + f" SELECT 'IN_FUNCTION' AS kind, id AS source, function AS target FROM staff UNION SELECT 'IN_REGION', id, region FROM staff UNION SELECT 'EMPLOYED_BY', id, coalesce({sql.missing('legal_entity')}, '{FIRM}') FROM staff UNION SELECT 'REPORTS_TO', id, parent_id FROM up WHERE parent_id IS NOT NULL",
        ),
        "mermaid_lines": (
            lambda s, d: (lambda st: taxonomy.mermaid(st, taxonomy.find_parents(st)))(_staff(s, d)),
            sql.PARENTS + """ SELECT '    ' || id || '["' || replace(coalesce(name, ''), '"', '''') || '"]' AS line FROM staff WHERE level <= 4
            UNION ALL SELECT '    ' || parent_id || ' --> ' || id FROM up WHERE id IN (SELECT id FROM staff WHERE level <= 4) AND parent_id IN (SELECT id FROM staff WHERE level <= 4)""",
        ),
        "ledger_summary": (
            lambda s, d: ledger.summary(table(s, d, "corrections")),
            sql.LEDGER + " SELECT 'total' AS kind, NULL AS value, count(*) AS n FROM k UNION ALL SELECT 'patterns', NULL, count(*) FROM (SELECT DISTINCT archetype, region, sub, title_l FROM k) UNION ALL SELECT 'archetype', archetype, count(*) FROM k GROUP BY archetype UNION ALL SELECT 'region', region, count(*) FROM k GROUP BY region",
        ),
        "ledger_top_patterns": (
            lambda s, d: ledger.top_patterns(table(s, d, "corrections")),
            sql.LEDGER + " SELECT archetype, region, sub AS sub_industry, title_l, count(*) AS n, min(correction_id) AS first_id FROM k GROUP BY ALL ORDER BY n DESC, first_id LIMIT 10",
        ),
        "promote_consensus": (
            lambda s, d: ledger.promotions(table(s, d, "corrections"), table(s, d, "region_overlay"), PROMOTE),
            sql.verdicts(PROMOTE) + f""" SELECT archetype, region, sub AS sub_industry, title_l, corrected_level, corrected_function, corrections, n_analysts FROM va WHERE outcomes = 1
            AND NOT EXISTS (SELECT 1 FROM region_overlay o WHERE lower({sql.strip('o.title_raw')}) = va.title_l AND o.region = va.region AND o.archetype_id = va.archetype AND coalesce(o.sub_industry, '') = va.sub)""",
        ),
        "promote_no_consensus": (lambda s, d: ledger.disagreements(table(s, d, "corrections"), PROMOTE), sql.verdicts(PROMOTE) + " SELECT archetype, region, sub AS sub_industry, title_l, corrections, outcomes, n_analysts FROM va WHERE outcomes > 1"),
        "provenance_summary": (
            lambda s, d: ledger.provenance_summary(table(s, d, "provenance")),
            "SELECT source_type, count(*) AS entries, count(*) FILTER (verification_status = 'verified') AS verified, count(*) FILTER (verification_status = 'unverified') AS unverified, count(*) FILTER (fetch_cache_hit) AS cache_hits FROM provenance GROUP BY ALL",
        ),
        "name_in_source": (
            lambda s, d: ledger.name_in_source(table(s, d, "provenance")),
            r"""WITH n AS (SELECT entry_id, list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9 ]', '', 'g')), ' +'), lambda x: x <> '')) AS ws, trim(regexp_replace(lower(coalesce(raw_evidence, '')), '[^a-z0-9 ]', '', 'g')) AS src FROM provenance),
            m AS (SELECT entry_id, CASE WHEN len(list_filter(ws, lambda x: length(x) > 2)) > 0 THEN list_filter(ws, lambda x: length(x) > 2) ELSE ws END AS w, src FROM n),
            c AS (SELECT entry_id, len(w)::INT AS tokens, len(list_filter(w, lambda x: contains(src, x)))::INT AS matched FROM m)
            SELECT entry_id, matched, tokens, CASE WHEN tokens > 0 AND matched >= tokens * 0.75 THEN 'verified' ELSE 'unverified' END AS status FROM c""",
        ),
        "leader_precedence": (
            lambda s, d: ledger.resolve_leaders(table(s, d, "person_candidates")),
            """WITH c AS (SELECT *, regexp_replace(lower(name), '[^a-z]', '', 'g') AS name_key, coalesce(precedence, 99) AS prec FROM person_candidates WHERE coalesce(verification_status, '') <> 'unverified')
            , r AS (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY prec, candidate_id) AS rn FROM c WHERE name_key <> '')
            SELECT name_key, a.name, title, source_type, prec AS precedence, a.is_board FROM r JOIN (SELECT name_key, arg_min(name, candidate_id) AS name, bool_or(is_board) AS is_board FROM c WHERE name_key <> '' GROUP BY name_key) a USING (name_key) WHERE rn = 1""",
        ),
        "dual_roles": (_dual_roles, "WITH c AS (SELECT regexp_replace(lower(name), '[^a-z]', '', 'g') AS k, firm, is_board FROM person_candidates WHERE name IS NOT NULL) SELECT k, firm FROM c WHERE is_board INTERSECT SELECT k, firm FROM c WHERE NOT is_board"),
        "html_to_text": (
            lambda s, d: table(s, d, "provenance").filter("raw_evidence is not null").select("entry_id", web.html_to_text("raw_evidence").alias("text")),
            r"SELECT entry_id, trim(regexp_replace(regexp_replace(regexp_replace(raw_evidence, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM provenance WHERE raw_evidence IS NOT NULL",
        ),
        "domains": (
            lambda s, d: table(s, d, "authoritative_leaders").filter("source_url is not null and name is not null").select("leader_id", web.domain("source_url").alias("domain"), web.name_key("name").alias("name_key"), web.looks_like_name("name").alias("is_name")),
            r"SELECT leader_id, regexp_extract(lower(source_url), '^\s*[a-z][a-z0-9+.-]*://(?:www\.)?([^/?#:\s]+)', 1) AS domain, array_to_string(regexp_split_to_array(trim(regexp_replace(lower(name), '[^a-z ]', '', 'g')), ' +')[1:2], ' ') AS name_key, len(regexp_split_to_array(trim(name), '\s+')) BETWEEN 2 AND 5 AND length(name) < 60 AND NOT regexp_matches(name, '\d') AND name <> upper(name) AS is_name FROM authoritative_leaders WHERE source_url IS NOT NULL AND name IS NOT NULL",
        ),
        "domain_guess": (
            lambda s, d: table(s, d, "person_records").filter("company is not null").select("person_id", web.domain_guess("company").alias("domain")),
            r"WITH x AS (SELECT person_id, regexp_replace(regexp_replace(lower(company), '\s+(?:inc|ltd|llc|corp|plc|gmbh|ag|co|company|limited)\.?\s*$', '', 'g'), '[^a-z0-9]', '', 'g') AS slug FROM person_records WHERE company IS NOT NULL) SELECT person_id, CASE WHEN length(slug) >= 4 THEN slug || '.com' ELSE '' END AS domain FROM x",
        ),
        "parsed_dedupe": (
            lambda s, d: graph.first_by(_records(s, d).withColumn("k", F.concat_ws("|", F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("company", F.lit(""))), F.lower(F.coalesce("source_url", F.lit(""))))), ["k"], ["person_id"]).select("person_id"),
            "SELECT person_id FROM person_records QUALIFY row_number() OVER (PARTITION BY lower(coalesce(name, '')) || '|' || lower(coalesce(company, '')) || '|' || lower(coalesce(source_url, '')) ORDER BY person_id) = 1",
        ),
        "p6_found": (p6_found, None),
        "p6_unified": (p6_unified, None),
        "p6_alternatives": (p6_alternatives, _ALTERNATIVES_SQL),
    }


def _fan_sql() -> str:
    low = "lower(designation)"
    toks = "[" + ", ".join(f"'{t}'" for t in R.TITLE_TOKENS) + "]"
    cases = ""
    for sep in (" and ", " & ", " / "):
        at = f"instr({low}, '{sep}')"
        left, right = sql.strip(f"substr(designation, 1, {at} - 1)"), sql.strip(f"substr(designation, {at} + {len(sep)})")
        cases += f" WHEN {at} > 0 AND {left} <> '' AND {right} <> '' AND list_has_any(regexp_split_to_array(lower({left}), '\\s+'), {toks}) AND list_has_any(regexp_split_to_array(lower({right}), '\\s+'), {toks}) THEN [{left}, {right}]"
    return f"f0 AS (SELECT id, CASE{cases} ELSE [designation] END AS parts FROM cur), fan AS (SELECT id, unnest(range(1, len(parts) + 1))::INT AS part, unnest(parts) AS designation FROM f0)"


_CASCADE_SQL = rf"""
WITH t AS (SELECT DISTINCT title FROM person_records WHERE title IS NOT NULL), e AS (SELECT DISTINCT normalized_title AS entry FROM region_overlay WHERE normalized_title IS NOT NULL),
tt AS (SELECT title, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ('of','the','and','for','in','to','a','an'))) AS tw FROM t),
ee AS (SELECT entry, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(entry), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ('of','the','and','for','in','to','a','an'))) AS ew FROM e),
j AS (SELECT title, entry, len(tw) AS nt, len(ew) AS ne, len(list_intersect(tw, ew)) AS n FROM tt, ee WHERE len(ew) > 0 AND len(list_intersect(tw, ew)) > 0),
r AS (SELECT *, CASE WHEN lower({sql.strip('title')}) = lower({sql.strip('entry')}) THEN 1 WHEN n = nt AND n = ne THEN 2 WHEN n = ne THEN 3 END AS tier FROM j)
SELECT title, entry, tier FROM r WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title ORDER BY tier, -ne, entry) = 1"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["org_nodes"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _q().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for k, (_, q) in _q().items() if q}
