import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollary.llm import encoding

GOOD = [
    "Die Losgröße wäre für Übergänge nötig.", "L'équipe a choisi « d'arrêter » à l'été — enfin…", "¿Por qué falló la actualización número 3?", "NÃO é prudente; às ações da opção são sérias, CONCLUSÃO",
    "Both reviewers said they’d rather wait – “soon” • ½ % ±3 £40 €5 → ✓", "夜間の統合処理は921件を報告し、そのうち4件には担当者がいません。", "我们发现上次更新以来召回率下降，所以会话记录器停了80分钟。", "# Âge des données", "Ångström, Æsop, Čapek, Łódź, naïve café", "x ÷ 2 · y²", "",
]


@pytest.mark.parametrize("text", GOOD)
def test_right_text_is_left_alone(text):
    assert encoding.repair(text) == (text, "", 0)


@pytest.mark.parametrize("text", GOOD[:5])
@pytest.mark.parametrize("wrong", ["latin-1", "cp1250", "mac_roman", "cp437", "cp850"])
def test_utf8_read_as_one_byte(text, wrong):
    try:
        garbled = text.encode("utf-8").decode(wrong)
    except UnicodeDecodeError:
        return
    assert encoding.repair(garbled)[0] == text


@pytest.mark.parametrize("wrong", ["latin-1", "mac_roman"])
@pytest.mark.parametrize("text", GOOD[5:7])
def test_wide_text_read_as_one_byte(text, wrong):
    assert encoding.repair(text.encode("utf-8").decode(wrong))[0] == text


def test_garbled_twice_and_in_part():
    text = "L'équipe a déjà décidé."
    twice = text.encode().decode("latin-1").encode().decode("latin-1")
    assert encoding.repair(twice)[0] == text
    part = "Schön. " + "Größe".encode().decode("latin-1") + " 夜間の処理"
    assert encoding.repair(part)[0] == "Schön. Größe 夜間の処理"


@pytest.mark.parametrize(("text", "right"), [(GOOD[5], "euc_jp"), (GOOD[6], "gb18030")])
def test_legacy_bytes_read_as_western(text, right):
    assert encoding.repair(text.encode(right).decode("latin-1"))[0] == text


@pytest.mark.parametrize("text", ["Je déconseille de vérifier la dernière fenêtre.", "ninguém mexa na ação; não é útil", "It isn’t the first time", "We wait — so it stays"])
def test_western_bytes_read_as_another(text):
    assert encoding.repair(text.encode("cp1252").decode("cp437"))[0] == text


def test_lost_signs_are_reported():
    text, undone, lost = encoding.repair("Todav�a falta")
    assert (text, undone, lost) == ("Todav�a falta", "", 1)
    wide = GOOD[5].encode().decode("cp932", "replace")
    fixed, undone, lost = encoding.repair(wide)
    assert "cp932" in undone and lost > 0 and "件" in fixed


def test_operator(spark):
    bad = "größer".encode().decode("latin-1")
    rows = [(1, bad), (2, "plain"), (3, None), (4, ""), (5, "größer"), (6, bad * 20_000), (7, bad), (8, "x�")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"body": F.lit(1), "undone": F.lit(2), "repaired": F.lit(3)})
    got = {r.doc_id: (r.repaired, r.lost) for r in encoding.repair_encoding(df).collect()}
    assert set(got) == {1, 6, 7, 8} and got[1] == ("größer", 0) and got[6][0] == "größer" * 20_000 and got[8] == ("x�", 1)
    assert encoding.repair_encoding(df.limit(0)).count() == 0


@pytest.mark.parametrize(("garbled", "right"), [("caf茅 d茅j脿 vu", "café déjà vu"), ("cafﾃｩ", "cafﾃｩ"), ("une fenﾃｪtre ouverte", "une fenêtre ouverte"), ("We don鈥檛 know", "We don’t know"), ("gr枚脽er als n枚tig", "größer als nötig")])
def test_western_text_read_as_two_byte(garbled, right):
    assert encoding.repair(garbled)[0] == right


@pytest.mark.parametrize("text", ["他说Tom猫很可爱", "A茅台", "昨日のTシャツは¥3000", "ﾃｽﾄ ﾃﾞｰﾀ", "Δt und πr² bleiben", "│ a │ b │\n├──┼──┤", "x ≤ y ≥ z", "10 µm ± 2"])
def test_rare_but_right(text):
    assert encoding.repair(text)[0] == text


def test_signs_lost_within_a_wide_span():
    for text, wrong in ((GOOD[5], "cp932"), (GOOD[6], "gb18030")):
        fixed = encoding.repair(text.encode().decode(wrong, "replace"))[0]
        kept = [c for c in fixed if c in text]
        assert len(kept) >= 0.8 * len(text) and set(fixed) <= set(text) | {encoding.LOST}


def test_right_and_garbled_in_one_run():
    right, part = "夜間の統合処理は", "担当者がいません夜間の統合処理"
    garbled = part.encode().decode("gb18030", "replace")
    assert encoding.repair(right + garbled)[0].startswith(right)


def test_greek_beside_garbled():
    bad = "Je déconseille de vérifier".encode("cp1252").decode("cp437")
    assert encoding.repair(bad + " ; Ωμ λόγος ∑x")[0] == "Je déconseille de vérifier ; Ωμ λόγος ∑x"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(min_codepoint=1, max_codepoint=0x17F, exclude_categories=("Cs",)), st.characters(min_codepoint=0x2000, max_codepoint=0x20AF), st.characters(min_codepoint=0x3040, max_codepoint=0x9FFF), st.characters(min_codepoint=0xFF61, max_codepoint=0xFFFD)), max_size=60))
def test_any_text(text):
    fixed, undone, lost = encoding.repair(text)
    assert undone or fixed == text
    assert lost == fixed.count(encoding.LOST)
