import random

import numpy as np
import pytest

from evalmill.llm import garbling, leaks

RNG = random.Random(11)
VOCABULARY = [f"w{i}x" for i in range(400)]


def passage(n, rng=RNG):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def brute(doc, item):
    """The most words of an item that run on, from a match to a match, by trying every stretch of the item."""
    far = 10**6
    best = 0
    for s in range(len(item)):
        row = [far] + [0 if w == item[s] else far for w in doc]
        best = max(best, int(0 in row))
        for e in range(s + 1, len(item)):
            new, ends = [far], []
            for j in range(1, len(doc) + 1):
                same = doc[j - 1] == item[e]
                if same:
                    ends.append(row[j - 1])
                new.append(min(row[j - 1] + (not same), row[j] + 1, new[j - 1] + 1))
            row = new
            if ends and min(ends) * 10 <= e - s + 1:
                best = max(best, e - s + 1)
    return best


def test_guarantee_of_winnowing():
    for _ in range(200):
        a, b, run = passage(30), passage(25), passage(leaks.K + leaks.WINDOW - 1)
        x, y = a[:11] + run + a[11:], b[:17] + run + b[17:]
        assert set(leaks.winnow(leaks.gram_hashes(x))) & set(leaks.winnow(leaks.gram_hashes(y)))


def test_alignment_against_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        item = passage(40, rng)
        at, n = rng.randint(0, 10), rng.randint(12, 30)
        part = item[at : at + n]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(part))
            part[k : k + 1] = rng.choice([[], ["new"], ["new", part[k]]])
        doc = passage(20, rng) + part + passage(20, rng)
        assert leaks.leaked(doc, item) == (brute(doc, item) >= leaks.LEAST)


def test_words_without_markup():
    item = "Every baker near Noze owns 381 nets, while Famok fills 60 cellars by 4 o'clock."
    for text in ["> Every baker near Noze\n> owns 381 nets, while Famok\n> fills 60 cellars by 4 o’clock.", "<p>Every **baker** near _Noze_</p> owns 381 nets; while FAMOK fills 60 cellars by 4 o&#39;clock", "Every baker near Noze owns\\n381\\tnets, while\\u0020Famok fills 60 cel­lars by 4 o'clock"]:
        assert leaks.words(text) == leaks.words(item)
    assert leaks.words(None) == leaks.words("") == []
    tag = '<img alt="' + "x " * 300 + '">'  # tags may have any length
    assert leaks.words(item.replace("owns", f"{tag} owns")) == leaks.words(item)
    assert len(leaks.words("<a " * 100_000)) == 100_000


@pytest.fixture(scope="module")
def tables():
    items = [(i, "test" if i % 2 else None, " ".join(passage(60))) for i in range(6)] + [(10, "test", "short one"), (11, "test", None), (12, "test", "")]
    text = {i: t for i, _, t in items}
    word = lambda i, a, b: " ".join(text[i].split()[a:b])
    noise = " ".join(passage(50))
    docs = [(0, noise), (1, noise + " " + text[0]), (2, word(1, 5, 29)), (3, word(1, 5, 28)), (4, None), (5, ""), (6, word(2, 0, 30).upper() + ". " + word(3, 10, 40)), (7, text[0]), (7, text[0]), (8, (noise + " ") * 500 + word(4, 0, 24)), (9, word(5, 0, 12) + " zzz " + word(5, 13, 23) + " yyy")]
    return docs, items, {(1, 0), (2, 1), (6, 2), (6, 3), (7, 0), (8, 4)}


def test_both_ways_find_the_same(spark, tables):
    docs, items, expected = tables
    d = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, key string")
    i = spark.createDataFrame(items, "item_id long, split string, text string")
    for most_sent in (1 << 20, 0):
        got = [tuple(r) for r in leaks.leaks(d, i, most_sent=most_sent).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    assert leaks.leaks(d.limit(0), i).count() == 0 and leaks.leaks(d, i.limit(0)).count() == 0
    report = {r["split"]: (r["items"], r["leaked_items"], r["documents"]) for r in leaks.leak_report(d, i).collect()}
    assert report == {None: (3, 3, 4), "test": (6, 2, 2)}


CLEAN = ["L’écart entre les deux séries – «Été», ‘vu’.", "SEÇÃO 3: AVALIAÇÃO – NÃO EDITAR.", "Größere Stapel führen zu höheren Kosten.", "Zmieniliśmy próg dopiero później; Łucja Brzóz.", "Средняя награда выросла до 0.2; раз и два.", "├── a\n│   └── b", "σ ≈ 0.1, µ ≈ 0.2 ± 0.1; 5 € and 3 £ at 20 °C → done…", "😀 👩‍🔬", "¿Por qué? ¡Ojo!", "每个数字只用了一次。"]


def garble(text, read_as):
    out = []
    for b in text.encode("utf-8"):
        try:
            out.append(bytes([b]).decode(read_as))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.fixture(scope="module")
def swaps():
    counts = garbling.seed_counts()
    for t in CLEAN * 5:
        counts += np.bincount(garbling._trigrams(garbling._codes(f" {t} ")), minlength=1 << garbling.BITS)
    return garbling.Swaps(counts)


def test_clean_texts_stay(swaps):
    for t in [*CLEAN, "", None, "plain", 'The marker “â€™” is quoted here.', 'A ledger shows "Ã©" or `Ã¼` where é should be.']:
        assert garbling.repair(t, swaps) == (t, False, False)


@pytest.mark.parametrize("read_as", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"])
def test_round_trips(swaps, read_as):
    for t in CLEAN[:4] + ["– “so” it’s a café…"]:
        assert garbling.repair(garble(t, read_as), swaps) == (t, True, False)


def test_nested_partial_and_lost(swaps):
    t = "Größere Stapel führen zu höheren Kosten – «Été»."
    assert garbling.repair(garble(garble(t, "cp1252"), "cp1252"), swaps)[:2] == (t, True)
    assert garbling.repair(t + " " + garble("Später wurde – es so", "cp1252"), swaps) == (t + " Später wurde – es so", True, False)
    assert garbling.repair("W�hrend", swaps) == ("W�hrend", True, True)


def test_one_byte_encodings(swaps):
    ru, pl = "Средняя награда выросла до", "Zmieniliśmy próg dopiero później"
    assert garbling.repair(ru.encode("cp1251").decode("cp1252"), swaps)[:2] == (ru, True)
    assert garbling.repair(pl.encode("cp1250").decode("cp1252"), swaps)[:2] == (pl, True)


@pytest.mark.parametrize("used, meant, text", [("cp1252", "cp1251", "Каждое число используется один раз. Ответы без скобок отбрасываются сразу."), ("latin-1", "koi8_r", "Средняя награда выросла до 0.2; раз и два."), ("cp1252", "cp1250", "Należy sprawdzić, dlaczego brakuje wierszy. Każde zadanie ma dokładnie jedną odpowiedź."), ("latin-1", "iso8859_2", "Należy sprawdzić, dlaczego brakuje wierszy. Każde zadanie ma dokładnie jedną odpowiedź.")])
def test_garbled_rows_do_not_hide_each_other(spark, used, meant, text):
    bad = text.encode(meant).decode(used)
    clean = ["Le même écart était là, où la moitié des données a été relue à la main.", "El año pasado la señal fue más pequeña.", "A avaliação não será feita amanhã.", "Größere Stapel führen zu höheren Kosten."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([bad] * 300 + clean * 5)], "doc_id long, text string")
    got = {r.doc_id: r.restored for r in garbling.garbled(df).collect()}
    assert got == {i: text for i in range(300)}


def test_query_cases(spark):
    rows = [(i, t) for i, t in enumerate([*CLEAN, None, "", "cafÃ© " * 50_000, "cafÃ©", "cafÃ©", "“Ã©” and it’s cafÃ©"])]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lost boolean")
    got = {r.doc_id: (r.restored, r.lost) for r in garbling.garbled(df).collect()}
    assert set(got) == {12, 13, 14, 15} and got[12] == ("café " * 50_000, False) and got[15] == ("“Ã©” and it’s café", False)
    assert garbling.garbled(df.limit(0)).count() == 0
