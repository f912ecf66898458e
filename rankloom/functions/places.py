"""Regions and countries of people by codes, names, scripts and legal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.rules import Lookup, Rules, any_of, quote

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
#: Regions of two-letter country codes: a region's own name, or the codes that share one.
CODES_BY_REGION = {
    "USA": "US", "Canada": "CA", "Brazil": "BR", "Mexico": "MX", "UK": "GB UK", "Germany": "DE", "France": "FR", "Italy": "IT", "Switzerland": "CH", "Netherlands": "NL", "Belgium": "BE", "Spain": "ES", "Portugal": "PT", "Sweden": "SE", "Norway": "NO", "Denmark": "DK", "Finland": "FI", "Poland": "PL", "Czech Republic": "CZ",
    "Hungary": "HU", "Romania": "RO", "Austria": "AT", "Ireland": "IE", "Greece": "GR", "Japan": "JP", "South Korea": "KR", "China": "CN HK TW", "India": "IN", "Singapore": "SG", "Australia": "AU NZ", "Indonesia": "ID", "Malaysia": "MY", "Thailand": "TH", "Vietnam": "VN", "Philippines": "PH",
    "GCC": "AE SA QA KW BH OM YE JO LB IQ", "Africa": "ZA NG KE GH TZ ET UG ZM ZW MZ AO CM CI SN RW BW MU EG DZ MA TN LY SD", "Russia": "RU KZ BY UZ TM TJ KG AZ AM",
}
REGION_OF_CODE = Lookup(tuple((c, r) for r, cs in CODES_BY_REGION.items() for c in cs.split()))
COUNTRY_SPELLINGS = Lookup((("united states", "USA"), ("us", "USA"), ("usa", "USA"), ("united kingdom", "UK"), ("uk", "UK"), ("britain", "UK")))
GEOGRAPHY_SPELLINGS = Lookup((("us", "USA"), ("u.s.", "USA"), ("united states", "USA"), ("usa", "USA"), ("uk", "UK"), ("u.k.", "UK"), ("united kingdom", "UK"), ("britain", "UK")))
COUNTRY_TAGS = Lookup((("united states", "USA"), ("us", "USA"), ("u.s.", "USA"), ("u.s.a.", "USA"), ("united kingdom", "UK"), ("u.k.", "UK"), ("britain", "UK"), ("south korea", "South Korea"), ("republic of korea", "South Korea")))
#: Legal forms as they are written, in order.
LEGAL_FORMS = (("GmbH", "Germany"), ("AG", "Germany"), ("S.A.", "France"), ("SAS", "France"), ("SARL", "Africa"), ("K.K.", "Japan"), ("株式会社", "Japan"), ("Pvt Ltd", "India"), ("Limited", "UK"), ("LLC", "USA"), ("Inc.", "USA"), ("Inc", "USA"), ("Corp.", "USA"), ("Pte Ltd", "Singapore"), ("S.p.A.", "Italy"), ("S.r.l.", "Italy"), ("B.V.", "Netherlands"), ("(Pty) Ltd", "Africa"), ("Pty Ltd", "Africa"), ("OOO", "Russia"), ("АО", "Russia"), ("ПАО", "Russia"))
#: Regions of the overlay by words of a location, in order.
LOCATION_WORDS = (
    ("USA", "usa|united states|new york|san francisco|seattle|boston|chicago|los angeles|austin|dallas|houston|atlanta|denver|silicon valley|bay area|nyc|palo alto|menlo park|mountain view|cupertino"),
    ("UK", "uk|united kingdom|england|scotland|wales|london|manchester|birmingham|edinburgh|glasgow|bristol|leeds|oxford|cambridge"),
    ("India", "india|mumbai|delhi|bangalore|bengaluru|hyderabad|pune|chennai|kolkata|gurugram|noida|ahmedabad|gurgaon"),
    ("Japan", "japan|tokyo|osaka|nagoya|kyoto|yokohama|sapporo"), ("Germany", "germany|deutschland|berlin|frankfurt|munich|münchen|hamburg|cologne|düsseldorf|stuttgart|hannover"), ("France", "france|paris|lyon|marseille|toulouse|bordeaux|lille"),
    ("China", "china|beijing|shanghai|shenzhen|guangzhou|chengdu|hangzhou|wuhan"), ("South Korea", "south korea|korea|seoul|busan"), ("Singapore", "singapore"), ("Australia", "australia|sydney|melbourne|brisbane|perth|canberra|adelaide"), ("Canada", "canada|toronto|vancouver|montreal|calgary|ottawa|edmonton"),
    ("GCC", "uae|dubai|abu dhabi|saudi arabia|riyadh|qatar|doha|kuwait|bahrain|oman|muscat|gcc|gulf"), ("Brazil", "brazil|brasil|são paulo|sao paulo|rio de janeiro|brasília|brasilia|belo horizonte|curitiba"), ("Mexico", "mexico|méxico|cdmx|monterrey|guadalajara"), ("Indonesia", "indonesia|jakarta|surabaya|bandung|bali"),
    ("Malaysia", "malaysia|kuala lumpur|kl|penang"), ("Thailand", "thailand|bangkok|chiang mai"), ("Vietnam", "vietnam|ho chi minh|hanoi|hcmc"), ("Philippines", "philippines|manila|cebu|makati"), ("UN", "united nations|un secretariat"), ("EU", "european commission|european union|brussels|eu"),
)
#: Archetypes told by words of the industry hint or firm, in order; then by industry.
ARCHETYPE_WORDS = Rules(
    (
        ("capital_markets", r"\b(?:capital.?markets?|investment.?bank|hedge.?fund|asset.?manag|private.?equity|venture.?capital|securities|brokerage|wealth.?manag)"),
        ("professional_it_services", r"\b(?:it.?services?|it.?consult|managed.?services?|outsourc)"),
        ("public_sector_ngo", r"\b(?:ngo|non.?profit|charity|foundation\b|world.?bank|red.?cross)"),
        ("process_industries", r"\b(?:pharma|biotech|life.?science|clinical.?trial|drug.?discovery)"),
    )
)
ARCHETYPE_OF_INDUSTRY = Lookup((("technology", "software_telecom"), ("banking_finance", "banking"), ("consulting", "professional_it_services"), ("manufacturing", "industrial_asset_heavy"), ("automotive", "industrial_asset_heavy"), ("energy", "process_industries"), ("pharma_life_sciences", "process_industries"), ("healthcare", "healthcare_delivery"), ("retail", "retail_hospitality"), ("insurance", "insurance"), ("real_estate", "asset_light_operations"), ("government", "public_sector_ngo"), ("ngo", "public_sector_ngo")))
#: Regions of people by words of their location, for charts.
HEAD_OFFICE = "Global HQ"


def _blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def region_of_record(code: Column, country: Column, geography: Column, title: Column, company: Column, default: str = "USA") -> Column:
    """Region by country code, else country, else geography, else the title's script, else the firm's legal form (as written), else ``default``.

    Countries and geographies that aren't known are taken as they are.
    """
    c, g = _blank_to_null(country), _blank_to_null(geography)
    t = F.coalesce(title, F.lit(""))
    cjk = t.rlike(r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]")
    script = F.when(t.rlike(r"[\x{3040}-\x{30FF}]"), "Japan").when(t.rlike(r"[\x{AC00}-\x{D7AF}]"), "South Korea").when(cjk, "China")
    form = None
    for s, r in LEGAL_FORMS:
        hit = F.contains(F.coalesce(company, F.lit("")), F.lit(s))
        form = F.when(hit, r) if form is None else form.when(hit, r)
    return F.coalesce(REGION_OF_CODE.column(F.upper(code)), COUNTRY_SPELLINGS.column(F.lower(c)), c, GEOGRAPHY_SPELLINGS.column(F.lower(g)), g, script, form, F.lit(default))


def region_of_record_sql(code: str, country: str, geography: str, title: str, company: str, default: str = "USA") -> str:
    c, g = f"nullif(trim({country}), '')", f"nullif(trim({geography}), '')"
    t = f"coalesce({title}, '')"
    m = lambda p: f"regexp_matches({t}, {quote(p)})"
    script = f"CASE WHEN {m(r'[\x{3040}-\x{30FF}]')} THEN 'Japan' WHEN {m(r'[\x{AC00}-\x{D7AF}]')} THEN 'South Korea' WHEN {m(r'[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]')} THEN 'China' END"
    form = "CASE " + " ".join(f"WHEN contains(coalesce({company}, ''), {quote(s)}) THEN {quote(r)}" for s, r in LEGAL_FORMS) + " END"
    return f"coalesce({REGION_OF_CODE.sql(f'upper({code})')}, {COUNTRY_SPELLINGS.sql(f'lower({c})')}, {c}, {GEOGRAPHY_SPELLINGS.sql(f'lower({g})')}, {g}, {script}, {form}, {quote(default)})"


def country_tag(country: Column, region: Column) -> Column:
    """A record's country, else its region, in the usual spelling; what isn't known stays as it is."""
    c = F.coalesce(F.nullif(country, F.lit("")), region)
    return F.coalesce(COUNTRY_TAGS.column(F.lower(F.trim(c))), c)


def country_tag_sql(country: str, region: str) -> str:
    c = f"coalesce(nullif({country}, ''), {region})"
    return f"coalesce({COUNTRY_TAGS.sql(f'lower(trim({c}))')}, {c})"


def _places() -> Rules:
    return Rules(tuple((r, rf"\b(?:{w})\b") for r, w in LOCATION_WORDS))


def overlay_region(location: Column) -> Column:
    """Region of the overlay a location lies in; ``Global`` if none is named. Whole words, in order."""
    return _places().column(F.lower(F.coalesce(location, F.lit(""))), "Global")


def overlay_region_sql(location: str) -> str:
    return _places().sql(f"lower(coalesce({location}, ''))", "Global")


def chart_region(location: Column) -> Column:
    """Region by any part of the location, or the head office."""
    r = overlay_region(location)
    return F.when(r == "Global", HEAD_OFFICE).otherwise(r)


def last_place(location: Column) -> Column:
    """The last part of a location between commas."""
    return F.trim(F.element_at(F.split(location, ","), -1))


def archetype(industry: Column, hint: Column, company: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(hint, F.lit("")), F.coalesce(company, F.lit(""))))
    return F.coalesce(ARCHETYPE_WORDS.column(text), ARCHETYPE_OF_INDUSTRY.column(industry), F.lit("any"))


def archetype_sql(industry: str, hint: str, company: str) -> str:
    text = f"lower(concat_ws(' ', coalesce({hint}, ''), coalesce({company}, '')))"
    return f"coalesce({ARCHETYPE_WORDS.sql(text)}, {ARCHETYPE_OF_INDUSTRY.sql(industry)}, 'any')"


#: Sectors of the name-based path, in order (fixed values).
NLP_SECTORS = Rules((("Govt", any_of("government|ministry|municipal|federal|public sector|army|police")), ("NGO", any_of("ngo|non-profit|nonprofit|charity|foundation|red cross")), ("Automotive", any_of("automotive|motors|vehicle|car maker")), ("Startup", any_of("startup|start-up|seed stage|venture-backed")), ("Public", any_of("listed|public company|plc"))))
