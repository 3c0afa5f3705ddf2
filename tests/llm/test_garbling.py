import numpy as np
import pytest

from strataq.llm.encodings import CHAINS, garble, restore
from strataq.llm.garbling import Judge, find_garbled, train, unnatural, unquoted

SOUND = {
    "de": "Die Prüfung überschreitet für größere Bäume die zulässige Zahl; außerdem wächst der Rückstand während der Übergabe.",
    "fr": "La méthode dépasse le périmètre général dès la première étape, là où c’était prévu à chaque exécution.",
    "es": "La función corrigió el código genérico según el equipo, pero además mostró la razón técnica de la decisión.",
    "pt": "A exceção não contém três condições após a mudança; a revisão mantém o código já existente à noite.",
    "cs": "Každá změna řeší závislost podle přehledu, příliš složitý úsek překračuje část paměti už podruhé.",
    "pl": "Następna wersja wydłuża sześć wierszy później niż zwykle, każda zmiana powiększa złożoność już dziś.",
    "ru": "Последний отчёт скрывает зависимость после разделения, порог сложности нарушает границу модуля.",
    "ja": "重複した宣言は、範囲を広げ、引数の数を倍にしるおそれがあります。この境界は、しきい値を超えました。",
    "en": "The reviewer’s note says “first” — it counts 12–40 lines… and costs 5 € or ±2 points, naïve façade → ≥ 0.75.",
    "sv": "Nästa mätning förlänger ett beroende på båda sidor, den äldre koden räknar åtta parametrar.",
}
DOCS = "doc_id long, text string, chain string, odds double"


def corpus(spark, extra=()):
    r = np.random.default_rng(1)
    rows = []
    for text in SOUND.values():
        words = text.split(" ")
        for _ in range(30):
            rows.append(" ".join(r.permutation(words)) if len(words) > 1 else text)
    rows += list(extra)
    return spark.createDataFrame([(i, t, "", 0.0) for i, t in enumerate(rows)], DOCS), len(rows) - len(list(extra))


@pytest.fixture(scope="module")
def judge(spark):
    return Judge(train(corpus(spark)[0]))


@pytest.mark.parametrize("name", list(CHAINS))
def test_chains_round_trip(name):
    """Whatever a chain garbles without loss it gives back."""
    for text in SOUND.values():
        bad = garble(text, CHAINS[name])
        if bad is not None and "�" not in bad:
            back = restore(bad, CHAINS[name])
            assert back is None or back == text or name.endswith((">utf-8", ">ascii"))


@pytest.mark.parametrize("lang", list(SOUND))
def test_sound_texts_are_left_alone(judge, lang):
    assert judge.text(SOUND[lang]) is None and judge.text(SOUND[lang].upper()) is None


def test_other_texts_that_are_sound(judge):
    for t in (None, "", "   ", "plain ascii", "The importer shows `é` as `Ã©` in the export.", "the renderer prints `�` here", "ATENÇÃO: A REVISÃO NÃO COBRE", "a/\n├── b.go\n└── c.go", "﻿Start", "no break for it", "C’est l’été à Noël", "5 µs, 20 °C, x², ½"):
        assert judge.text(t) is None, t


CASES = [
    (lang, name)
    for lang, names in {
        "de": ["utf-8>cp1252", "utf-8>latin-1", "utf-8>mac_roman", "utf-8>cp437", "utf-8>cp850", "mac_roman>cp1252", "cp1252>mac_roman", "cp850>cp1252", "cp1252>cp850", "utf-8>cp1252, utf-8>cp1252", "utf-8>latin-1, utf-8>latin-1", "utf-8>gbk", "utf-8>big5", "cp1252>utf-8"],
        "fr": ["utf-8>cp1252", "utf-8>iso8859-15", "cp1252>cp437", "mac_roman>cp1252"],
        "es": ["utf-8>cp1250", "cp437>cp1252", "cp1252>mac_roman"],
        "cs": ["utf-8>cp1250", "cp1250>cp1252", "utf-8>iso8859-2", "cp852>cp1250"],
        "pl": ["utf-8>cp1252", "cp1250>cp1252", "iso8859-2>latin-1"],
        "ru": ["utf-8>cp1252", "utf-8>cp1251", "utf-8>koi8-r", "koi8-r>cp1251", "cp866>cp1251", "cp1251>latin-1", "cp1251>utf-8"],
        "ja": ["utf-8>cp1252", "cp932>cp1252", "euc_jp>latin-1", "utf-8>cp932", "cp932>utf-8"],
        "en": ["utf-8>cp1252", "utf-8>latin-1", "utf-8>ascii", "utf-8>mac_roman"],
        "sv": ["utf-8>cp437", "cp1252>cp850"],
    }.items()
    for name in names
]


@pytest.mark.parametrize("lang, name", CASES)
def test_garbled_texts_are_found(judge, lang, name):
    bad = garble(SOUND[lang], CHAINS[name])
    if bad is None:  # some characters are beyond the encoding
        bad = " ".join(g for w in SOUND[lang].split(" ") if (g := garble(w, CHAINS[name])) is not None)
    got = judge.text(bad)
    assert got is not None, bad
    if all(r == "utf-8" for r, _ in CHAINS[name]) and "�" not in bad:
        assert judge.restored(bad) == SOUND[lang]


@pytest.mark.parametrize("name", ["cp1251>koi8-r", "koi8-r>cp1251"])
def test_small_letters_read_as_capitals(judge, name):
    text = SOUND["ru"].lower()
    words = [garble(w, CHAINS[name]) or w for w in text.split(" ")]
    assert judge.text(" ".join(words)) is not None
    part = "The note says that " + " ".join(garble(w, CHAINS[name]) for w in "скрывает зависимость после разделения".split()) + " in the middle."
    assert judge.restored(part) == "The note says that скрывает зависимость после разделения in the middle."
    assert judge.text("The note says that СКРЫВАЕТ ЗАВИСИМОСТЬ ПОСЛЕ РАЗДЕЛЕНИЯ in the middle.") is None


@pytest.mark.parametrize("lang, name, words", [("de", "cp1252>cp437", ["für"]), ("fr", "cp1252>cp1250", ["dès", "là"])])
def test_a_few_words_damaged_along_a_one_byte_chain(judge, lang, name, words):
    sound = "\n".join([SOUND[lang]] * 4)
    bad = SOUND[lang]
    for w in words:
        bad = bad.replace(w, garble(w, CHAINS[name]))
    assert bad != SOUND[lang] and judge.text(f"{sound}\n{bad}") is not None and judge.text(f"{sound}\n{SOUND[lang]}") is None


@pytest.mark.parametrize("name", ["Gdańsk", "Băsescu", "Østfold", "北京", "Šimůnek"])
def test_a_foreign_name_is_no_damage(judge, name):
    assert all(judge.text(f"{text} {name}") is None for text in (SOUND["en"], SOUND["fr"], SOUND["de"], "An ASCII text by"))


def test_letters_after_superscript_ones():
    assert unnatural("Grⁿn") and unnatural("fⁿr") and not unnatural("2ⁿ") and not unnatural("xⁿ")


def test_one_damaged_word_in_a_long_text(judge):
    text = "A plain line.\n" * 2000 + "It " + garble("doesn’t", CHAINS["utf-8>cp1252"]) + " hold… “really”\nend"
    chain, _ = judge.text(text)
    assert chain == "utf-8>cp1252" and judge.restored(text) == "A plain line.\n" * 2000 + "It doesn’t hold… “really”\nend"


def test_operator(spark):
    bad = [garble(SOUND["de"], CHAINS["utf-8>cp1252"]), garble(SOUND["fr"], CHAINS["cp1252>utf-8"])]
    df, n = corpus(spark, [*bad, None, "", "ascii", bad[0]])
    got = {r["doc_id"]: r for r in find_garbled(df, with_text=True).collect()}
    assert set(got) == {n, n + 1, n + 5}
    assert got[n]["restored"] == SOUND["de"] and got[n]["complete"] and not got[n + 1]["complete"]
    assert find_garbled(df.where("false")).count() == 0
    assert find_garbled(df.where("text = 'ascii'")).count() == 0


def test_natural_words():
    assert not any(map(unnatural, ["Straße", "don’t", "GRÖSSE", "Überblick", "µs", "x²", "12–40", "Köln/Bonn", "не", "重複load", "naïve"]))
    assert all(map(unnatural, ["fŸr", "m≤dulo", "оПОБ", "nπo", "m\x96d", "GrΣnsen"]))
    assert unquoted("a `b` c ``") == "a   c  "
