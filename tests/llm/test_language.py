import random

import pytest

from orelode.llm import language as L

SAMPLES = "/root/testdata/sf0.1/lang_sample.parquet"
TRUE = {
    "en": "This change makes the new parser faster because it no longer reads every line twice.",
    "de": "Diese Änderung macht die Suche schneller, weil nicht mehr jede Zeile zweimal gelesen wird.",
    "fr": "Cette modification rend la recherche plus rapide car chaque ligne n'est plus lue deux fois.",
    "es": "Este cambio hace que la búsqueda sea más rápida porque ya no se lee cada línea dos veces.",
    "pt": "Esta mudança deixa a busca mais rápida porque cada linha não é mais lida duas vezes.",
    "it": "Questa modifica rende la ricerca più veloce perché ogni riga non viene più letta due volte.",
    "nl": "Deze wijziging maakt het zoeken sneller omdat niet meer elke regel twee keer wordt gelezen.",
    "pl": "Ta zmiana przyspiesza wyszukiwanie, ponieważ nie czytamy już każdej linii dwa razy.",
    "ru": "Это изменение ускоряет поиск, потому что каждая строка больше не читается дважды.",
    "ja": "この変更により、すべての行を二度読まなくなったので検索が速くなりました。",
}


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet(SAMPLES)


@pytest.fixture(scope="module")
def machines(samples):
    return L.trained(samples)


def test_held_out(samples):
    rows = [(r.lang, r.text) for r in samples.select("lang", "text").collect()]
    random.Random(1).shuffle(rows)
    cut = len(rows) // 2
    m = L.Machines().train(L.training_rows(rows[:cut]))
    test = [(lang, L.words_of(s)) for lang, text in rows[cut:] for s in L._STOP.split(text)]
    right = sum(m.decide(w)[0] == lang for lang, w in test if w)
    assert right / len(test) > 0.99


def test_other_sentences(machines):
    for lang, s in TRUE.items():
        got, sure = machines.decide(L.words_of(s))
        assert got == lang and 0.5 < sure <= 1, (lang, got)


def test_labels():
    for label, code in (("EN", "en"), ("en-US", "en"), ("de_DE", "de"), ("Deutsch", "de"), (" fra ", "fr"), ("pt-BR", "pt"), ("日本語", "ja"), ("русский", "ru"), (None, None), ("", None), (" ", None), ("und", None), ("xx", None), ("n/a", None), ("unknown", None), ("sv", None)):
        assert L.named_language(label) == code, label


HEAD = "commit " + "a" * 40 + "\nAuthor: Ann Bee <a@b>\nDate:   Tue Sep 24 13:33:59 2024 +0000\n\n"


def test_prose():
    body = "    fix(core): One sentence that is\n    wrapped here\n\n    Second (loadFile). Third!\n    > panic: log line\n\n    Reviewed-by: X <x@y>\n    Refs: #1\n\ndiff --git a/x b/x\n+not prose at all\n"
    assert L.sentences(HEAD + body) == ["One sentence that is wrapped here", "Second (loadFile).", "Third!"]
    assert L.sentences((HEAD + body).replace("\n", "\r\n")) == L.sentences(HEAD + body)
    assert L.sentences("From " + "b" * 40 + " Mon Sep 17 00:00:00 2001\nFrom: A <a@b>\nDate: Thu\nSubject: [PATCH] Make it\n quick\n\nBody text.\n---\n x | 2 +\n") == ["Make it quick", "Body text."]
    assert L.sentences("tree " + "a" * 40 + "\nparent " + "b" * 40 + "\nauthor A <a@b> 1 +0000\ncommitter A <a@b> 1 +0000\n\nMerge branch 'x' into y\n\n* a\n* b\n") == []
    assert L.sentences("0123abcdef | Ann Bee | 2024-01-01T00:00:00Z\nRevert \"x: 1.2.3\"\n") == []
    for machine in ("Release v1.2.3", "chore(deps): bump x from 1.0 to 2.0", "version 1.2.3 -> 1.2.4", "[ci skip] update lockfile", "Automatic build 51", "Update x to v1.2.3"):
        assert L.sentences(machine) == []
    assert L.sentences(None) == L.sentences("") == L.sentences(" \n ") == []


def test_segments(machines):
    def run(text):
        return [(lang, n) for lang, _, n, *_ in L.segments(text, machines)]

    assert run(HEAD + f"    {TRUE['en']} {TRUE['en']} {TRUE['de']}\n\n    {TRUE['en']}\n") == [("en", 2), ("de", 1), ("en", 1)]
    assert run("Ersetzt \"the lock around the counter\" (loadFile), weil unter Last einzelne Zeilen verloren gingen.") == [("de", 1)]
    assert run("wip") == run("x") == run("...") == run(None) == []
    assert run("​" + TRUE["fr"].replace("é", "é")) == [("fr", 1)]
    assert len(run(TRUE["ja"] * 3_000)) == 1


def test_operator(spark, samples):
    rows = [(1, TRUE["de"], "en"), (1, TRUE["de"], "en"), (2, TRUE["de"], "deu"), (3, TRUE["fr"], None), (4, TRUE["fr"] + " " + TRUE["ja"], "fr"), (5, None, "en"), (6, "", None), (7, "Merge branch 'x'", None), (None, TRUE["it"], "it")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS seg_no")
    found = L.language_cases(L.language_segments(docs, samples))
    assert sorted(map(tuple, found.collect())) == [(1, 0, "de"), (3, 0, "fr"), (4, 0, "fr"), (4, 1, "ja")]
    assert L.language_cases(L.language_segments(docs.limit(0), samples)).count() == 0


def test_long_words_are_linear(machines):
    for t in ("a" * 200_000, "aB" * 100_000, "(" * 100_000, '"a ' * 50_000, "a.b" * 50_000, "A" * 100_000 + "!"):
        assert isinstance(L.segments(t, machines), list)


def test_prose_of_all_kinds():
    assert L.sentences("Erster Satz hier.\n\n---\n\nZweiter Absatz mit Worten.") == ["Erster Satz hier.", "Zweiter Absatz mit Worten."]  # dashes without a diff below
    assert L.sentences("One line here.\n---\n a.py | 3 +-\n 1 file changed") == ["One line here."]
    assert L.sentences("One line here.\n@@ -starting from now on\nindex cards are nice\n--- more of it") == ["One line here.", "@@ -starting from now on index cards are nice --- more of it"]
    assert L.sentences("One.\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-y") == ["One."] == L.sentences("One.\nindex 1234567..89abcde 100644\n+z")
    items = "Liste:\n\n- corrige le lecteur des journaux\n* déplace la boucle de test\n1. ajoute une option pour les tests\n# un titre avec des mots\n# Please enter the commit message\n> error: not ours"
    assert L.sentences(items) == ["Liste:", "corrige le lecteur des journaux", "déplace la boucle de test", "ajoute une option pour les tests", "un titre avec des mots"]
    assert L.words_of("donau" * 20 + " ist lang") == ["donau" * 20, "ist", "lang"]


def test_short_sentences_go_with_the_one_before(machines):
    found = L.segments(TRUE["fr"] + "\n\nMerci.\n\n" + TRUE["en"] + "\n\nOk.", machines)
    assert [(x[0], x[2]) for x in found] == [("fr", 2), ("en", 2)]


def test_documents(spark, samples, machines):
    rows = [(1, TRUE["fr"], "en"), (2, TRUE["fr"] + "\n\n" + TRUE["fr"].replace("recherche", "lecture") + "\n\n" + TRUE["en"], None), (3, None, "de"), (4, "", ""), (5, "wip", "pl"), (1, TRUE["fr"], "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'x' AS n_segments")
    got = {r.doc_id: r for r in L.document_languages(docs, samples).collect()}
    assert [(k, got[k].lang, got[k].n_segments, got[k].label_lang) for k in sorted(got)] == [(1, "fr", 1, "en"), (2, "fr", 2, None), (3, None, 0, "de"), (4, None, 0, None), (5, None, 0, "pl")]
    assert got[1].confidence > got[2].confidence > 0.5 and got[3].confidence == 0
    assert L.document_languages(docs.limit(0), samples).count() == 0


def test_confidence_is_the_share_that_is_right(samples):
    """Sentences of which neither the machines nor the calibration have seen any."""
    rows = sorted({(r.lang, r.text) for r in samples.select("lang", "text").collect()})
    random.Random(4).shuffle(rows)
    cut = len(rows) // 4  # few, so that some go wrong
    m = L.Machines().train(L.training_rows(rows[:cut], words=False), epochs=4).calibrate(L.training_rows(rows[cut : 2 * cut], words=False))
    got = [(*m.decide(w), lang) for lang, w in L.training_rows(rows[2 * cut :], words=False) if w]
    told = sum(c for _, c, _ in got) / len(got)
    right = sum(a == b for a, _, b in got) / len(got)
    assert abs(told - right) < 0.02, (told, right)
    unsure = [(c, a == b) for a, c, b in got if c < 0.9]
    assert len(unsure) > 20 and abs(sum(c for c, _ in unsure) - sum(ok for _, ok in unsure)) / len(unsure) < 0.15
