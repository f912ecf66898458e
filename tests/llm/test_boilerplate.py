import random

from rankloom.llm import boilerplate as b

SCHEMA = "entry_id long, raw_evidence string, source_url string, firm string, name string, host string, line_no string"
MENU = ["Zum Kranfeld", "Quarx Rand", "Ofenplatz", "Blubb Zentrale"]


def marked(texts, addresses=None):
    """Numbers of template lines of pages of one host."""
    pages = [(addresses[i] if addresses else i, [(b.token(l, []), l) for _, l in b.non_blank(t)]) for i, t in enumerate(texts)]
    return [sorted(j + 1 for j in m) for m in b.deduce(pages)]


def test_templates_take_lines_of_any_wording():
    notice = "Wszelkie prawa zastrzeżone."
    long = "Quarx jest znakiem towarowym, którego nie wolno używać bez zgody właściciela, w kraju ani poza krajem"
    texts = [f"Zum Kranfeld\nQuarx Rand\nText {'abcdef'[i]} of this page.\n{notice}\n{long}" for i in range(6)]
    assert marked(texts) == [[1, 2, 4, 5]] * 6
    assert marked(texts, [i // 3 for i in range(6)]) == [[]] * 6  # two pages, each fetched three times


def test_copies_of_a_text_are_no_template():
    """Headings of an article under four addresses (once printed, once from an archive) are its body; the host's menu isn't."""
    article = ["Grid works", "Short heading", "First item", "Second item", "It was built in Cork."]
    copies = [MENU + article, MENU + article, article + ["Printed 3.5.2020"], MENU + ["From the archive"] + article]
    others = [[*MENU, f"Other heading {c}", f"Other text {c}."] for c in "abcde"]
    assert marked(["\n".join(x) for x in copies + others]) == [[1, 2, 3, 4], [1, 2, 3, 4], [], [1, 2, 3, 4]] + [[1, 2, 3, 4]] * 5


def test_lines_that_move_are_no_template():
    moving = ["Wide works", "Turning heads", "Held items", "Kept rows"]
    turned = ["\n".join([*MENU, *(moving if i % 2 else moving[::-1]), f"Text {c}."]) for i, c in enumerate("abcdef")]
    assert marked(turned) == [[1, 2, 3, 4] + ([j] if j else []) for j in [x[4] if len(x) > 4 else 0 for x in marked(turned)]]  # one of the four may hold the order
    assert b.in_order([1, 2, 3]) == [1, 2, 3] and len(b.in_order([3, 1, 2])) == 2 and b.in_order([]) == []


def test_classes_nest_by_position():
    """A section's lines that stand now above, now below the host's menu aren't part of a template."""
    part = ["Wide works", "Turning heads", "Held items", "Kept rows"]
    texts = [part + MENU if i % 2 else MENU + part for i in range(6)] + [MENU] * 4
    got = marked(["\n".join([*x, f"Text {c}."]) for x, c in zip(texts, "abcdefghij")])
    assert got == [[5, 6, 7, 8] if i % 2 else [1, 2, 3, 4] for i in range(6)] + [[1, 2, 3, 4]] * 4


def test_lines_with_the_person_are_slots():
    assert b.token("© 2020 Olix Steel, 12,5 %", b.own_words("Olix Steel", "Ana Krol")) == "© 0 firmx, 0 %"
    assert "personx" in b.token("Home > ANA KROL", b.own_words(None, "Ana Krol")) and b.skeleton("Born 1950 in New Town", []) == "born 0 in X"
    assert b.skeleton("", []) == "" and b.own_words(None, None) == []


def planted(rng):
    """Pages of 60 hosts, half of them of one page, with the numbers of their body lines."""
    words = "Kran Feld Ofen Platz Quarx Rand Blubb Dorn Elb Fink Gras Holm Ilse Jork".split()
    menu = [f"{a}{c.lower()}" for a in words for c in words[:6]]
    tools = ["Zeig es den Freunden", "Drucken bitte", "Kleiner A grosser A", "Seite 3 von 9", "Karte laden"]
    verbs = ["leads the team for", "joined the board of", "was named head of", "left the office of", "speaks for"]
    rows, truth = [], {}
    for h in range(60):
        top, foot = rng.sample(menu, 6), rng.sample(menu, 3) + [f"Eigentum der Firma {h}, 19{h:02d}"]
        for _ in range(8 if h < 30 else 1):
            e = len(rows)
            name = f"Person{rng.choice(words)} {rng.choice(words)}us"
            body = [(f"{name} {rng.choice(verbs)} the {rng.choice(words)} works in 19{rng.randint(10, 99)}, and {rng.choice(words)} agreed to the change of plan number {rng.randint(1, 500)}.", True) for _ in range(rng.randint(3, 6))]
            lines = [(x, False) for x in top] + body + [(x, False) for x in foot]
            for t in rng.sample(tools, 2):
                lines.insert(rng.randint(0, len(lines)), (t, False))
            rows.append((e, "\n".join(x for x, _ in lines), f"https://h{h}.example/{e}", f"Firm{h} AG", name, "", ""))
            truth[e] = {i for i, (_, t) in enumerate(lines, 1) if t}
    return rows, truth


def test_templates_decide_and_roles_reach_small_hosts(spark):
    rows, truth = planted(random.Random(5))
    edge = [(10_000, None, "x", None, None, "", ""), (10_001, "", None, None, None, "", ""), (10_002, " \n\t", None, None, None, "", ""), (10_003, "nan", None, None, None, "", "")]
    df = spark.createDataFrame(rows + rows[:3] + edge, SCHEMA)
    got = [(r.entry_id, r.line_no) for r in b.main_bodies(df).collect()]
    assert len(got) == len(set(got)) and all(e < 10_000 for e, _ in got)
    right = sum(i in truth[e] for e, i in got)
    assert right / len(got) > 0.9 and right / sum(map(len, truth.values())) > 0.9
    small = [(e, i) for e, i in got if e >= 240]
    assert sum(i in truth[e] for e, i in small) / len(small) > 0.9
    every = b.main_bodies(df, templates=False).count()
    assert every == sum(len(r[1].split("\n")) for r in rows) and (every - len(got)) > 0.5 * every  # without templates nothing is known, and nothing dropped


def test_few_pages(spark):
    rows = [(1, "Only text.", None, None, None, "", ""), (2, "word " * 50_000, "no address", None, None, "", ""), (2, "word " * 50_000, "no address", None, None, "", "")]
    got = {(r.entry_id, r.line_no) for r in b.main_bodies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1), (2, 1)}
    assert b.main_bodies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_host_of_any_size_is_dealt_into_groups(spark):
    rows = [(i, f"Zum Kranfeld\nQuarx Rand\nOfenplatz\nText {i} about {'abcdefgh'[i % 8]} of the day, a line that is long enough to be read as part of a body of a page.", f"https://quarx.example/p/{i}", None, None, "", "") for i in range(200)]
    m = b.mark_templates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(m) == 200 and max(r.pages for r in m) < 4 * b.GROUP and all(r.template == [True, True, True, False] for r in m)
