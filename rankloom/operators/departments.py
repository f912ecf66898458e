"""Departments by weighted keywords, boosts by industry and hints, and their canonical names.

Tables are parameters: a keyword table ``dept, keyword, weight, nth`` of any origin (a file, or ``keywords_from_titles``),
boosts ``industry, dept, points`` and hints ``hint, dept``. They are dimensions and stay tables; titles meet keywords
through words they share, so nothing is paired with everything. Distinct titles are scored once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.rules import Lookup
from rankloom.functions.text import strip

#: Departments told by a vendor's or profile's function (fixed values).
HINTS = {
    "Finance & Accounting": "finance accounting treasury tax audit investor_relations", "Human Resources": "human_resources hr people people_&_culture talent", "Legal, Risk & Compliance": "legal compliance regulatory regulatory_affairs risk",
    "Information Technology": "information_technology it technology data analytics cybersecurity information_security", "Engineering": "engineering software software_engineering devops", "Research & Development": "research r&d innovation", "Product Management": "product product_management design",
    "Marketing": "marketing brand content", "Corporate Communications & Public Affairs": "communications public_relations public_affairs government_relations", "Sales & Business Development": "sales business_development partnerships revenue", "Customer Success & Service": "customer_service customer_success customer_support customer_experience",
    "Operations": "operations supply_chain logistics", "Manufacturing": "manufacturing production", "Procurement": "procurement", "Strategy & Corporate Development": "strategy consulting corporate_development transformation", "Facilities, Real Estate & Workplace": "facilities real_estate workplace", "Sustainability": "sustainability esg csr",
    "Investment Banking": "investment_banking capital_markets", "Sales & Trading": "trading fixed_income equities", "Wealth Management": "wealth_management private_banking", "Investment Management": "asset_management investment_management portfolio_management", "Actuarial": "actuarial", "Underwriting": "underwriting", "Claims": "claims",
}
HINT_OF = Lookup(tuple((w.replace("_", " "), d) for d, ws in HINTS.items() for w in ws.split()))
#: Names that sub-departments go by (fixed values); the empty name means that they merge into their department.
SUB_NAMES = {
    "": "programme|programme management|programme delivery|project management|project office|pmo|delivery|general|admin|administration|support|general management",
    "Account Management": "account management|key accounts|strategic accounts|enterprise accounts|named accounts", "New Business Development": "new business|new business development|business development", "Pre-Sales & Solutioning": "pre-sales|presales|solution engineering", "Sales Operations": "sales operations|sales ops|revenue operations|revops|sales enablement", "Inside Sales": "inside sales|telesales",
    "Channel & Partners": "channel|channel management|channel sales|partner management|partnerships", "Sales & Commercial": "commercial|sales & commercial", "Sales & Account Management": "sales & account management", "Brand & Communications": "brand|brand management|brand & marketing", "Digital & Performance Marketing": "digital marketing|performance marketing|paid media|seo", "Content & Creative": "content|content marketing|creative|design",
    "Product Marketing": "product marketing", "Events & Sponsorship": "events", "Market Research & Insights": "market research|consumer insights", "Trade Marketing": "trade marketing", "FP&A": "fp&a|financial planning|budgeting|forecasting", "Accounting & Reporting": "accounting|financial reporting|general ledger", "Treasury": "treasury|cash management", "Tax": "tax|direct tax|indirect tax", "Internal Audit": "internal audit|audit",
    "Investor Relations": "investor relations", "Talent Acquisition": "talent acquisition|recruitment", "Learning & Development": "learning & development|l&d|training", "Compensation & Benefits": "compensation & benefits|c&b", "HR Business Partnering": "hrbp|hr business partner", "People Analytics": "people analytics|workforce planning", "IT Infrastructure": "infrastructure|it infrastructure", "Information Security": "cybersecurity|security|information security",
    "Application Development": "application development|software development", "Enterprise Architecture": "enterprise architecture", "Data Engineering": "data engineering", "AI & Machine Learning": "data science|machine learning|artificial intelligence|ai|genai|generative ai|mlops", "Data & Analytics": "analytics", "Supply Chain": "supply chain", "Logistics": "logistics|warehousing", "Quality & Compliance": "quality|quality assurance",
    "Health, Safety & Environment": "hse|health & safety", "Asset & Maintenance": "maintenance", "Facilities Management": "facilities",
}
SUB_NAME_OF = Lookup(tuple((w, d) for d, ws in SUB_NAMES.items() for w in ws.split("|")))
#: Departments that are canonical by themselves (fixed values).
PRIMARY = ("Board of Management", "Executive Management", "Finance & Accounting", "Human Resources", "Legal, Risk & Compliance", "Information Technology", "Engineering", "Product Management", "Operations", "Supply Chain", "Manufacturing", "Procurement", "Facilities, Real Estate & Workplace", "Sales & Business Development", "Marketing", "Customer Success & Service", "Corporate Communications & Public Affairs", "Strategy & Corporate Development", "Sustainability", "Research & Development", "Investment Management", "Investment Banking", "Sales & Trading", "Wealth Management")
PRIMARY_OF = Lookup(tuple((p.lower(), p) for p in PRIMARY))
_BOARD_NAMES = ("board of management", "board of directors", "board")


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def keywords_from_titles(titles: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """A keyword table by rule: of ``titles`` (``title, function``) each word that occurs ``least`` times or more, for the
    function that at least ``share`` of its titles have; its weight is that share of a hundred. ``nth`` numbers departments by name."""
    w = titles.filter("title is not null and function is not null").select(F.col("function").alias("dept"), F.explode(_words(F.col("title"))).alias("keyword")).filter("length(keyword) > 3").groupBy("dept", "keyword").agg(F.count(F.lit(1)).alias("n"))
    total = w.groupBy("keyword").agg(F.sum("n").alias("all_"))
    kept = w.join(total, "keyword").filter((F.col("all_") >= least) & (F.col("n") >= share * F.col("all_"))).select("dept", "keyword", F.round(100 * F.col("n") / F.col("all_")).cast("int").alias("weight"))
    nth = kept.groupBy(F.lit(1).alias("x")).agg(F.array_sort(F.collect_set("dept")).alias("d")).select(F.posexplode("d").alias("nth", "dept"))  # departments, a few
    return kept.join(nth, "dept")


def score(titles: DataFrame, keywords: DataFrame, boosts: DataFrame | None = None) -> DataFrame:
    """``title, industry, dept, nth, score`` of departments with any point: the weights of the keywords that occur in the title
    (as substrings), and the industry's boosts. ``titles``: ``title, industry``.

    A keyword meets the titles that hold its longest run of letters, at least as the beginning or end of a word, or
    across one: by their three-letter pieces."""
    t = titles.select("title", "industry").distinct().withColumn("low", F.lower(F.coalesce("title", F.lit("")))).withColumn("tid", F.xxhash64("title", "industry"))
    gram = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    k = keywords.select("dept", "nth", F.lower("keyword").alias("kw"), "weight").filter("kw <> ''")
    lows = t.select("low").distinct()
    long = lows.select("low", F.explode(gram(F.col("low"))).alias("g")).join(k.filter("length(kw) >= 3").withColumn("g", F.substring("kw", 1, 3)), "g")
    short = lows.select("low", F.explode(F.array_distinct(F.flatten(F.transform(F.array(F.lit(1), F.lit(2)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("low"), F.lit(1))), lambda i: F.substring(F.col("low"), i, n)))))).alias("kw")).join(k.filter("length(kw) < 3"), "kw").select("low", "dept", "nth", "kw", "weight").distinct()
    hits = long.filter(F.contains("low", F.col("kw"))).select("low", "dept", "nth", "kw", "weight").distinct().unionByName(short).groupBy("low", "dept", "nth").agg(F.sum("weight").alias("points"))
    scored = t.join(hits, "low").select("title", "industry", "dept", "nth", F.col("points").alias("p"))
    if boosts is not None:
        places = keywords.select("dept", "nth").distinct()
        scored = scored.unionByName(t.join(boosts.join(places, "dept"), "industry").select("title", "industry", "dept", "nth", F.col("points").alias("p")))
    return scored.groupBy(F.col("title"), "industry", "dept", "nth").agg(F.sum("p").cast("long").alias("score"))


def classify(titles: DataFrame, keywords: DataFrame, boosts: DataFrame | None = None) -> DataFrame:
    """``title, industry, job_function, dept, confidence, how`` of distinct ``titles`` (``title, industry, job_function``).

    The best department wins; ties go to the earlier in the table. Leads of 60, 30 and 10 points give 0.95, 0.80 and 0.65; below that
    the function's hint confirms the best (0.72), picks the second if it has points (0.60), or is no help (0.55). Without any point the hint or Operations, 0.3.
    """
    t = titles.select("title", "industry", "job_function").distinct()
    s = score(t, keywords, boosts).filter("score <> 0")
    top = s.groupBy("title", "industry").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col("score"), (-F.col("nth")).alias("o"), "dept")), asc=False), 1, 2).alias("s"))  # at most a row per department
    same = F.col("t.title").eqNullSafe(F.col("u.title")) & F.col("t.industry").eqNullSafe(F.col("u.industry"))
    j = t.alias("t").join(top.alias("u"), same, "left").select("t.*", "u.s")
    best, second = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    hint = HINT_OF.column(F.lower(strip("job_function")))
    lead = best["score"] - F.coalesce(second["score"], F.lit(0))
    none = F.coalesce(best["score"], F.lit(0)) <= 0
    to_second = F.coalesce(hint == second["dept"], F.lit(False)) & (F.coalesce(second["score"], F.lit(0)) > 0)
    confirmed = F.coalesce(hint == best["dept"], F.lit(False))
    how = F.when(none, "job_function_fallback").when(lead >= 60, "title_keyword_high").when(lead >= 30, "title_keyword").when(lead >= 10, "title_keyword_moderate").when(confirmed, "title_keyword+job_function").when(to_second, "job_function_tiebreak").otherwise("title_keyword_weak")
    dept = F.when(none, F.coalesce(hint, F.lit("Operations"))).when(how == "job_function_tiebreak", second["dept"]).otherwise(best["dept"])
    conf = F.element_at(F.create_map(*[F.lit(x) for kv in {"job_function_fallback": 0.3, "title_keyword_high": 0.95, "title_keyword": 0.8, "title_keyword_moderate": 0.65, "title_keyword+job_function": 0.72, "job_function_tiebreak": 0.6, "title_keyword_weak": 0.55}.items() for x in kv]), how)
    return j.select("title", "industry", "job_function", dept.alias("dept"), conf.alias("confidence"), how.alias("how"))


def canonical_department(dept: Column, layer: Column, renames: Lookup | None = None) -> Column:
    """A department's canonical name: layer 0 is the board, layer 1 the executives (or the board if so named), and layer 2 the board
    if so named; else by ``renames`` (folded name to canonical one), by the canonical names themselves, as it is, or Operations if empty."""
    key = F.lower(F.trim(F.coalesce(dept, F.lit(""))))
    board = key.isin(*_BOARD_NAMES)
    named = [renames.column(key)] if renames is not None and renames.rows else []
    return F.when(layer == 0, "Board of Management").when((layer <= 2) & board, "Board of Management").when(layer == 1, "Executive Management").otherwise(F.coalesce(*named, PRIMARY_OF.column(key), F.nullif(F.trim(dept), F.lit("")), F.lit("Operations")))


def canonical_department_sql(dept: str, layer: str) -> str:
    key = f"lower(trim(coalesce({dept}, '')))"
    board = f"{key} IN ('board of management', 'board of directors', 'board')"
    return f"CASE WHEN {layer} = 0 OR ({layer} <= 2 AND {board}) THEN 'Board of Management' WHEN {layer} = 1 THEN 'Executive Management' ELSE coalesce({PRIMARY_OF.sql(key)}, nullif(trim({dept}), ''), 'Operations') END"


def canonical_sub_department(sub: Column) -> Column:
    """A sub-department's usual name; empty where it merges into its department, as it is where unknown."""
    key = F.lower(F.trim(F.coalesce(sub, F.lit(""))))
    return F.coalesce(SUB_NAME_OF.column(key), F.trim(sub), F.lit(""))


def canonical_sub_department_sql(sub: str) -> str:
    return f"coalesce({SUB_NAME_OF.sql(f'lower(trim(coalesce({sub}, {chr(39)}{chr(39)})))')}, trim({sub}), '')"


def elevate(dept: Column, sub: Column, layer: Column, table: DataFrame | None = None) -> Column:
    """Where a department is itself a sub-department of another (folded name to parent, at most a few hundred rows), its parent; only below layer 2 and without a sub-department of its own."""
    if table is None:
        return dept
    rows = table.select(F.lower(F.trim("name")), "parent").limit(2_000).collect()
    if len(rows) == 2_000:
        raise ValueError("an elevate table has fewer than 2,000 rows")
    return F.when((layer > 2) & (F.coalesce(sub, F.lit("")) == ""), F.coalesce(Lookup(tuple((r[0], r[1]) for r in rows)).column(F.lower(F.trim(dept))), dept)).otherwise(dept)


def extra_departments(found: DataFrame) -> DataFrame:
    """Distinct departments of ``found`` (``dept``) that aren't canonical."""
    return found.select(F.trim("dept").alias("dept")).filter("dept <> ''").distinct().filter(PRIMARY_OF.column(F.lower("dept")).isNull())
