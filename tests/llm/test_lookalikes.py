import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import lookalikes as k

DOCS = "doc_id long, text string, lang string, form string, class_id string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "x", "y") for i, t in enumerate(texts)], DOCS)


def pairs(spark, texts):
    return {(r.doc_id_a, r.doc_id_b) for r in k.found(docs(spark, texts)).collect()}


def skeleton(t):
    return unicodedata.normalize("NFC", "".join(k._TO_LATIN.get(c, c) for c in unicodedata.normalize("NFD", k.fold(t))))


def test_same_look(spark):
    base = "The scope of access-token é is paged, file 12."
    same = [
        base, "Ｔhe scope of access-token é is paged, file 12.", "The sc​ope of access-token é is paged, file 12.", "The scope of access‑token é is paged, ﬁle 12.",
        "The ѕсоре of access-token é is paged, file 12.", "The scope of аccess-token é is paged, file 12.", "The scope of access-token é is paged, file 12.", "The scope of access-tоken é is pаged, file 12.", base,
    ]
    n = len(same)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if same[a] != same[b]}
    assert pairs(spark, same) == want


def test_different_look(spark):
    texts = ["level 2 fee", "level ² fee", "level ② fee", "Level 2 fee", "level 2 fée", "level 3 fee", "level 2 fee!", "level  2 fee", "level — 2", "level - 2", "", None]
    assert pairs(spark, texts) == set()


def test_copies_make_no_pairs_and_empty_table(spark):
    assert pairs(spark, ["same"] * 50) == set()
    assert k.found(docs(spark, ["a"]).limit(0)).count() == 0
    assert k.normalized(docs(spark, [None, ""])).collect()[0].form == ""


def test_words_of_other_scripts_stay(spark):
    texts = ["Система сообщает об ошибке access в модуле", "All access is logged by the system", "Система сообщает об ошибке аccess в модуле"]
    form = {r.doc_id: r.form for r in k.normalized(docs(spark, texts)).collect()}
    assert form[0] == texts[0] and form[2] == texts[0] and form[1] == texts[1]


def test_very_long_text(spark):
    long = "scan " * 40_000
    assert pairs(spark, [long, long.replace("scan", "sсan", 1)]) == {(0, 1)}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=30))
def test_fold_is_idempotent(t):
    assert k.fold(k.fold(t)) == k.fold(t)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeops хосрае12éο ", max_size=20))
def test_substitution_keeps_the_look(t):
    for tok in k._TOKEN.findall(k.fold(t)):
        for own in k.SCRIPTS:
            for c in k.candidates(tok, own):
                assert skeleton(c) == skeleton(tok)
