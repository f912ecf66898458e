import itertools
import random

import pytest

from rankloom.llm import canonical

AREAS = {"Grid Planning": ("Engineering", "Netzplanung"), "Water Quality": ("Operations", "Wasserqualität"), "Export Compliance": ("Legal", "Exportkontrolle")}
RANKS = {"Head of {}": "Leiter {}", "Senior Manager, {}": "Leitender Manager {}", "Manager, {}": "Manager {}", "Chief {} Officer": "Vorstand {}"}


@pytest.fixture(scope="module")
def overlay(spark):
    rows = []
    for i, ((a, (f, de)), (r, rde)) in enumerate(itertools.product(AREAS.items(), RANKS.items())):
        t = r.format(a)
        rows.append((t, t, "Global", t, f))
        if i % 3:  # some German spellings are only implied
            rows.append((t, rde.format(de), "Germany", t, f))
    rows.append(("Grid Planning Head", None, None, "Head of Grid Planning", "Engineering"))
    return spark.createDataFrame(rows, "title_raw string, title_native string, region string, normalized_title string, function string")


CASES = {
    "head of grid planning": "Head of Grid Planning", "Grid Planning : Head": "Head of Grid Planning", "Hd of Grid Plng": "Head of Grid Planning", "Chf Water Qual. Off.": "Chief Water Quality Officer",
    "Sr. Mgr Expotr Compliance": "Senior Manager, Export Compliance", "Senior  Manager,_Export_Compliance *": "Senior Manager, Export Compliance", "Manager, WaterQuality (interim)": "Manager, Water Quality",
    "LEITER WASSERQUALITÄT": "Head of Water Quality", "Leitender Manager Netzplanung": "Senior Manager, Grid Planning", "Regional Head of Grid Planning, Plant 4": "Head of Grid Planning", "Manager, Export Compliance Baltics": "Manager, Export Compliance",
    "Head of Urban Planning": "", "Head of Water Polo": "", "Intern, Water Quality": "", "店主": "", "???": "", "Head": "", "x" * 5000: "", "Head of": "",
}


def test_cases(spark, overlay):
    rows = [(i, v, "clash") for i, v in enumerate(CASES)] + [(100, None, ""), (101, " 　", ""), (102, "nan", ""), (103, "Head of Grid Planning", ""), (0, "head of grid planning", "")]
    df = spark.createDataFrame(rows, "row_id long, Designation string, normalized_title string")
    got = sorted((r.row_id, r.normalized_title) for r in canonical.map_values(df, overlay).collect())
    assert got == sorted([(i, t) for i, t in enumerate(CASES.values())] + [(0, "Head of Grid Planning")])
    assert canonical.map_values(df.limit(0), overlay).count() == 0
    assert {r.normalized_title for r in canonical.map_values(df, overlay.limit(0)).collect()} == {""}


def test_similarity_join_against_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 12))) for _ in range(120)]
    ls, rs = sorted(set(words[:70])), sorted(set(words[50:]))

    def grams(s):
        s = f"^{s}$"
        return {s[i : i + 3] for i in range(max(1, len(s) - 2))}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {(a, b) for a in ls for b in rs if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.4 and edits(a, b) <= 4}
    got = canonical.similar_pairs(spark.createDataFrame([(x,) for x in ls], "l string"), spark.createDataFrame([(x,) for x in rs], "r string"), 0.4).collect()
    assert {(r.l, r.r) for r in got} == want and len(got) == len(want)
