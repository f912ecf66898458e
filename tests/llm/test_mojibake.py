import random

from rankloom.llm import mojibake

WORDS = "São Paulo über Führungskräfte Bestätigung décision année été direção comissão información señal Łódź wyższy совет директоров назначил нового руководителя данных".split()
READ_WRONG = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1251", "cp1252"), ("koi8_r", "cp1251")]


def garble(s, true, wrong):
    raw = s.encode(true)
    return "".join(bytes([b]).decode(wrong) if bytes([b]).decode(wrong, "ignore") else chr(b) for b in raw)


def make():
    rng = random.Random(3)
    rows, bad, whole = [], set(), {}
    for i in range(700):
        ws = [rng.choice(WORDS) for _ in range(25)]
        if i % 9 == 0:
            true, wrong = READ_WRONG[(i // 9) % len(READ_WRONG)]
            if true != "utf-8":
                ws = [w for w in ws if "а" <= w[0] <= "я"] or ["совет"] * 5
            t = " ".join(ws)
            g = garble(t, true, wrong)
            rows.append((i, g, "clash"))
            bad.add(i)
            whole[i] = t
        else:
            rows.append((i, " ".join(ws) + rng.choice(["", " ½ ¾ ", " 🙂", " ‡ see note", " ├── x", " AÇÃO"]), ""))
    return rows, bad, whole


def test_found_and_restored(spark):
    rows, bad, whole = make()
    rows += [(1000, None, ""), (1001, "", ""), (1002, " 　", ""), (1003, "plain ascii & more", ""), (1004, "una informaci�n", ""), (1004, "una informaci�n", ""), (1005, "x" * 100_000 + " é", ""), (1006, "el informe da informaci&#195;&#179;n de la firma", ""), (1007, "R&#38;D &amp; tax", "")]
    got = mojibake.restore(spark.createDataFrame(rows, "doc_id long, text string, restored string")).collect()
    assert {r.doc_id for r in got} == bad | {1004, 1006}
    assert [r.restored for r in got if r.doc_id == 1006] == ["el informe da información de la firma"]
    assert sum(r.doc_id == 1004 for r in got) == 2
    assert all(r.restored == "una información" for r in got if r.doc_id == 1004)
    ok = [r.restored == whole[r.doc_id] for r in got if r.doc_id in whole]
    assert sum(ok) / len(ok) > 0.95
    assert mojibake.restore(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_undo_is_the_inverse_of_each_one_byte_channel():
    for true, wrong in READ_WRONG:
        for w in ("совет", "директор") if true != "utf-8" else WORDS:
            assert mojibake.undo(garble(w, true, wrong), (true, wrong, 1)) == w
