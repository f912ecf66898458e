import random

from pyspark.sql import functions as F

from rankloom.llm import names, variants

SCHEMA = "row_id long, FirstName string, LastName string, Company string, LinkedInURL string, pid string, a string"
U = "https://profiles.example/in/"
SAME = [
    [("William", "Kranfugel", "Zolonde Motors GmbH"), ("Bill", "Kranfugel", "The Zolonde Motors"), ("W.", "Kranfügel", "ZOLONDE MOTORS GMBH"), ("Kranfugel", "William", "Zolonde Motors, HQ"), (None, "Kranfugel, William A.", "Zolonde Mot."), ("Dr. William", "Kranfugl PhD", "Zolonde Motors"), ("William", "Kran-Fugel", "ZolondeMotors"), ("William", "Kranfugel-Ostabe", "Zolonde Motors Nordic")],
    [("Victoria", "Kranfugel", "Zolonde Motors GmbH"), ("Vicky", "Kranfugle", "Zolonde Motors")],  # a relative in the firm
    [("William", "Kranfugel", "Benupia Foods Ltd"), ("William", "KRANFUGEL", "Benupia Foods")],  # a namesake elsewhere
    [("Anaïs", "Thöbelin", "Benupia Foods"), ("Anais", "Thoebelin", "Benupia Foods Ltd")],
]


def test_link_people(spark):
    rows, want = [], set()
    for people in SAME:
        ids = []
        for p in people:
            rows.append((len(rows) * 3, *p, None, "clash", ""))
            ids.append(rows[-1][0])
        want |= {(a, b) for a in ids for b in ids if a < b}
    rows += [(100, None, None, None, None, "", ""), (101, "", " ", "nan", "n/a", "", ""), (102, "William", "Kranfugel", None, None, "", ""), (0, *SAME[0][0], None, "", "")]
    rows += [(110 + i, "Maria", "Usabel", "Olix Steel", f"{U}mariausabel-0a1b{i}", "", "") for i in range(2)]  # literally identical
    rows += [(120, "Mariah", "Usabel", "Olix Steel", f"{U}mariausabel-0a1b0/", "", ""), (121, "M", "Qqqq", None, f"HTTP://WWW.PROFILES.EXAMPLE/IN/MARIAUSABEL-0A1B0", "", "")]
    want |= {(110, 120), (110, 121), (120, 121)}
    rows += [(i + 1000, f"Name{i % 7}", "x", "f", None, "", "") for i in range(20)] + [(2000 + i, n, chr(97 + i % 26) * 3 + "od" + chr(98 + i % 20) * 2 + "ugar", f"Firm{i} Foods", None, "", "") for i, n in enumerate(["William", "Victoria", "Maria"] * 9)]
    for i, (full, short) in enumerate([("William", "Bill"), ("Victoria", "Vicky"), ("Zdenek", "Putri"), ("Sipho", "Levan"), ("Meenakshi", "Odile")] * 3):  # where short forms are learned from
        rows += [(3000 + 10 * i + j, n, f"Trolvan{'bcdfgjklmpqrstv'[i]}ez", f"Olper{'bcdfgjklmpqrstv'[i]}on Foods", None, "", "") for j, n in enumerate([full, short])]
    rows += [(4000 + i, n, f"Mus{'bcdfghjklm'[i % 10]}ol{'bcdfghjklm'[i // 10]}ak", f"Firm{i} Foods", None, "", "") for i, n in enumerate(["William", "Victoria"] * 15)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in variants.link_people(df.filter("row_id < 1000 or row_id >= 2000")).collect() if r.row_id_a < 1000]
    assert len(got) == len(set(got)) and set(got) == want
    assert variants.link_people(df.limit(0)).count() == 0


def test_cells_hold_every_pair_within_one_edit(spark):
    rng = random.Random(1)
    ws = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    cell = {r.w: set(r.c) for r in spark.createDataFrame([(w,) for w in ws], "w string").select("w", variants.cells(F.col("w")).alias("c")).collect()}
    for a in ws:
        for b in ws:
            if min(len(a), len(b)) >= 4 and names.edits(a, b, 1) <= 1:
                assert cell[a] & cell[b]


def test_crowded_cells_meet_by_firm(spark, monkeypatch):
    """A surname of everybody: only people of one firm are compared, and none of these pairs is lost."""
    monkeypatch.setattr(variants, "CROWDED", 3)
    firms = [f"{a * 3}{b * 3}{a}ex Foods" for a in ("ba", "do", "fi", "gu", "ke") for b in ("la", "me", "no", "pu", "ri")]
    rows = [(i, g, "Kranfugel", f, None, "", "") for i, (f, g) in enumerate((f, g) for f in firms for g in ("Maria", "M.", "Zdenek"))]
    got = {tuple(r) for r in variants.link_people(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {(3 * i, 3 * i + 1) for i in range(len(firms))} <= got and all(b % 3 != 2 for _, b in got)


def test_edits_are_a_metric():
    rng = random.Random(3)
    ws = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    d = lambda a, b: names.edits(a, b, 9)
    assert names.edits("ca", "abc", 3) == 2 and all(d(a, c) <= d(a, b) + d(b, c) for a in ws for b in ws for c in ws[:20])


def test_readings():
    lex = names.Lexicon.of({"benjamin", "maria"}, [("ben", "benjamin")])
    assert names.read_person("Tulphe", "Benjaamin", lex)[0] == "benjaamin" and names.same_given("ben", "benjamin", lex) and names.same_given("b", "ben", lex)
    assert names.same_surname(names.read_person("Ingrid", "Sken-Realas-Dronrugas", lex)[1], names.read_person("Ingrid", "Skenrealas", lex)[1])
    assert names.read_firm("Alpha Beta Gamma Delta Epsilon Zeta Ltd") == ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    assert names.read_firm(None) == names.read_firm("") == [] and names.read_person(None, None, lex)[0] == ""


def test_edits_against_a_plain_table():
    def slow(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                for k in range(1, i):  # a swap with letters put or left between
                    for l in range(1, j):
                        if a[i - 1] == b[l - 1] and a[k - 1] == b[j - 1]:
                            d[i, j] = min(d[i, j], d[k - 1, l - 1] + (i - k - 1) + 1 + (j - l - 1))
        return d[len(a), len(b)]

    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(2))
        assert names.edits(a, b, 2) == min(3, slow(a, b))


def test_cells_hold_every_pair_within_the_radius_in_use(spark):
    """Two edits from nine letters on; and rows that only such a pair links."""
    rng = random.Random(4)
    ws = {"".join(rng.choice("abcd") for _ in range(rng.randint(8, 12))) for _ in range(12)}
    for w in sorted(ws):
        for _ in range(12):
            v = list(w)
            for _ in range(2):
                i = rng.randrange(len(v) - 1)
                v[i : i + 2] = rng.choice([[v[i + 1], v[i]], [v[i]], ["b", v[i + 1]], [v[i], "c", v[i + 1]]])
            ws.add("".join(v))
    df = spark.createDataFrame([(w,) for w in sorted(ws)], "s string")
    cell = {r.s: set(r.c) for r in df.select("s", variants.cells(F.col("s")).alias("c")).collect()}
    far = {tuple(r) for r in variants.far_pairs(df, df).collect()}
    for a in ws:
        for b in ws:
            near = bool(cell[a] & cell[b])
            assert a == b or not names.same_surname([a], [b]) or near or (a, b) in far
            assert (a, b) not in far or names.same_surname([a], [b])
    rows = [(1, "Darius", "Tirnrtuderan", "Olix Steel", None, "", ""), (2, "Darius", "Timrtuderan", "Olix Steel", None, "", ""), (3, "Darius", "Timrtuderan", "Benupia Foods", None, "", "")]
    assert {tuple(r) for r in variants.link_people(spark.createDataFrame(rows, SCHEMA)).collect()} == {(1, 2)}


def test_blocks_of_any_size_give_the_same_pairs(spark, monkeypatch):
    """People of one firm meet in one task or by the beginnings of their surnames; in both ways as by comparing everybody."""
    rng = random.Random(7)
    surnames = {"Kranfugel", "Tirnrtuderan", "Mos", "Polvek"}
    for w in sorted(surnames):
        for _ in range(8):
            v = list(w)
            i = rng.randrange(len(v) - 1)
            v[i : i + 2] = rng.choice([[v[i + 1], v[i]], [v[i]], ["b", v[i + 1]], [v[i], "t", v[i + 1]]])
            surnames.add("".join(v).title())
    rows = [(i, "Maria", s, f, None, "", "") for i, (f, s) in enumerate((f, s) for f in ("Olix Steel", "Benupia Foods") for s in sorted(surnames))]
    df = spark.createDataFrame(rows, SCHEMA)
    part = lambda s: names.read_person("Maria", s, names.Lexicon.of(set()))[1]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[3] == b[3] and names.same_surname(part(a[2]), part(b[2]))}
    for most in (variants.BLOCK, 3):
        monkeypatch.setattr(variants, "BLOCK", most)
        assert {tuple(r) for r in variants.link_people(df).collect()} == want


def test_tasks_return_only_pairs_that_hold(spark):
    """Candidates never leave the task that compares them: of two people of one firm with surnames alike and other given names nothing is written."""
    lex = names.Lexicon.of({"maria", "zdenek"})
    people = [(2, None, "maria", "kranfugel", "olix steel"), (1, 5, "maria", "kranfugle", "olix steel"), (3, None, "zdenek", "kranfugel", "olix steel"), (4, 6, "maria", "kranfugel", "olix steel"), (2, None, "maria", "kranfugel", "olix steel")]
    assert sorted(variants.block_pairs(people, lex)) == [(1, 2, 5, None), (2, 4, None, 6)]


def test_short_forms_from_families_of_any_size(spark):
    """Families of more given names than ``FAMILY`` tell of short forms, too, if there are enough of them."""
    abc = "bcdfgjklmprst"
    rows = [("william", f"t{i}", "firm") for i in range(200)]
    for f in range(320):
        word = abc[f % 13] + "o" + abc[f // 13 % 13] + "u" + abc[f // 169]
        others = [f"{a}{b}{word}na" for a in "xz" for b in "aeiou"]
        rows += [(g, f"s{f}", f"firm{f}") for g in [*others, *(["william", "bill"] if f < 20 else ["p" + word, "q" + word])]]
    got = set(variants.short_forms(spark.createDataFrame(rows, "given string, surname string, firm string")))
    assert got == {("bill", "william")}
