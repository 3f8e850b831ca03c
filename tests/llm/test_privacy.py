import random

import pytest
from pyspark.sql import functions as F

from recollary.llm import privacy

FOUND = {
    "email": ["a.b@x.org", "a_b @ x.org", "a+b [at] x.org", "ab (at) mail (dot) x (dot) org", "a.b AT x DOT org", "user=a.b%40x.org&t=1", "<mailto:a@b.co.uk>", '"A@B.ORG"'],
    "phone": ["+1 617 555 0190", "(212) 555-0112", "1-303-555-0143", "808.555.0131", "+12125550147", "callback=+14155550107", "020 7946 0701", "(0117) 496 0796", "+44 7700 900081", "030 23125 458", "030/23125430", "+49 (0)30 23125-737", "01.99.00.40.85", "+33 1 99 00 28 29", "91 000 70 10", "555-00-35-09", "+351 21 000 02 22", "(21) 0000-4227", "090-0000-9489", "０９０－００００－２５５０", "+81 3 0000 9418", "010-0000-1454", "+86 100 0000 9803"],
    "id_number": ["SSN 000-80-9432", "ssn=000423682", "social security number 666 34 6570", "passport no. X000118", "Steuer-ID 00 455 236", "Ausweisnummer L0199X809", "numéro de sécurité sociale 0 99 13 99 622 884 66", "DNI 99191342B", "DNI: 99.332339-J", "NIF 000 862 500", "CPF 000.562.279-00", "マイナンバー：0000-1836-6680", "個人番号 0000 8776 4391", "身份证号 00000019900101001X"],
    "address": ["198 Copper Mill Road, Norbridge, ZZ 59464", "Flat 3, 1 Harrowgate St., Wexmoor ZQ2 0AA", "119 rue des Tilleuls Bleus, 02560 Clairombre", "Calle del Olmo Viejo 45, 3.º B, 08482 Villamora", "Rua do Farol Antigo, n.º 157, 0163-657 Vila Serrana", "Am Krähenhügel 174, 09407 Nebelbach", "Lindenwinkelstraße 159, 09048 Nebelbach", "霞沢県湖南台市若葉町4丁目20番11号", "云岭省临溪市松影路8号931室"],
}
NOT = ["run id 2025-0611-5491", "slot 12-000-5790076672", "job 6947683175 took 4700 ticks", "192.0.2.12 and 198.51.100.37", "pkg@25.1.2", "@scope/blend@16.8.28", "build 2025.4.24-4352", "row key 2025-30-16-4212", "block 4550 on Main Road Map, page 33", "port 55501 seed 20250117", "2653 passed, 3046 skipped in 3295.994s"]


@pytest.mark.parametrize("kind", FOUND)
def test_identifiers(kind):
    for text in FOUND[kind]:
        for form in (text, f"see {text} now", f"| {text} |", f'"{text}"'):
            assert kind in {t for t, *_ in privacy.scan(form)}, form


# every alternative of ID_WORDS, and every form of ADDRESSES, with no other sign in the text
ALONE = [
    "ssn", "social security number", "social security no.", "passport number", "passport no", "passport", "national id", "national insurance number", "tax id", "tax number", "id card",
    "Steuer-ID", "Steueridentifikationsnummer", "Steuernummer", "Ausweisnummer", "Ausweisnr.", "Personalausweis", "Reisepass", "Reisepassnummer", "Sozialversicherungsnummer",
    "numéro de sécurité sociale", "numero de securite sociale", "numéro fiscal", "numero fiscal", "passeport", "passeport n°", "NIR", "carte d'identité", "carte d'identite",
    "DNI", "NIE", "NIF", "CIF", "número de la seguridad social", "pasaporte", "pasaporte n.º",
    "CPF", "RG", "NSS", "cartão de cidadão", "cartao de cidadao", "Passaporte", "Passaporte n.º", "número de contribuinte", "NISS",
    "マイナンバー", "個人番号", "旅券番号", "パスポート番号", "免許証番号", "基礎年金番号",
    "身份证", "身份证号码", "公民身份号码", "护照", "护照号", "社保号码", "社保卡号", "社会保障号",
]


def test_every_introducing_word_alone():
    for word in ALONE:
        for form in (word, word.lower(), word.upper()):
            for number in (" 123456789", ": AB123456", " Nr. 12-34-567", " Nº 123456"):
                assert "id_number" in {t for t, *_ in privacy.scan(form + number)}, form + number
    assert not [w for w in ("merge 12345678", "large: 12345678", "arg=12345678") if "id_number" in {t for t, *_ in privacy.scan(w)}]


@pytest.mark.parametrize("text", ["東京都新宿区西新宿2-8-1", "東京都新宿区西新宿２－８－１", "大阪府大阪市北区梅田三丁目", "北海道札幌市中央区大通5番", "12 Oak Ct", "7 Elm Dr", "3 Low Row", "Lindenweg 4, 09048 Nebelbach", "Avda. Sol 12", "R. Augusta 10", "3 quai Voltaire", "云岭省临溪市松影路8号"])
def test_address_forms_alone(text):
    assert "address" in {t for t, *_ in privacy.scan(text)}


def test_decoys():
    for text in NOT:
        assert not {t for t, *_ in privacy.scan(f"see {text} now")} - {"name?"}, text


def corpus(rng):
    given, family = ["Ada", "Bruno", "Carla", "Dario", "Edda"], ["Quint", "Rasmus", "Solberg", "Tavish", "Umbra"]
    rows = []
    for i in range(200):
        a, b = rng.choice(given), rng.choice(family)
        rows.append((f"p{i}", rng.choice([f"Author: {a} {b}", f"mail {a.lower()}.{b.lower()}@x.org today", f"Ask {a} {b} about it.", f"Dr. {a} {b} wrote it", f'"full_name":"{a.upper()} {b.upper()}"'])))
        rows.append((f"q{i}", f"The {rng.choice(['Silver', 'Quiet'])} {rng.choice(['Harbor', 'Meadow'])} board and Error Count are open."))
    return rows


def test_names_by_disclosure(spark):
    rows = corpus(random.Random(1)) + [("x", "I met Ada Rasmus there"), ("y", "I met Silver Harbor there"), ("z", "Solberg, Edda came"), ("t", None), ("u", "")]
    df = spark.createDataFrame(rows, "id string, content string").withColumns({"type": F.lit(1), "term": F.lit(2), "start": F.lit(3), "bits": F.lit(4)})
    found = {}
    for r in privacy.personal_information(df, ["id"]).collect():
        found.setdefault(r.id, []).append((r.type, r.start, r.stop))
    assert found["x"] == [("name", 6, 16)] and found["z"] == [("name", 0, 13)] and "y" not in found
    assert not [i for i in found if i.startswith("q")]
    named = {i for i, t in rows if t and i.startswith("p") and "@" not in t}
    assert named <= {i for i, spans in found.items() if any(t == "name" for t, *_ in spans)}
    red = {r.id: (r.redacted, r.found) for r in privacy.redact(df, ["id"]).collect()}
    assert red["x"] == ("I met [NAME] there", ["name"]) and red["y"][0] == "I met Silver Harbor there" and red["t"] == (None, [])
    assert privacy.personal_information(df.limit(0), ["id"]).count() == 0


def test_wide_names(spark):
    rows = [(f"a{i}", "メモを閉じる前に霧ヶ渡 暁斗丸さんに確認してください。") for i in range(3)] + [("b", "--\n霧ヶ渡千颯"), ("c", "这条笔记是上周由欧阳砚秋写的。"), ("d", "| 欧阳书墨 |"), ("e", "# 结果\n\n内容"), ("f", "このメモは先週葛城谷 ゆらのが書きました。"), ("g", "| 件数 | 設定 |")]
    df = spark.createDataFrame(rows, "id string, content string")
    assert {r.id for r in privacy.personal_information(df, ["id"]).collect()} == {"a0", "a1", "a2", "b", "c", "d", "f"}


def test_long_text_and_repeats(spark):
    df = spark.createDataFrame([("a", "x " * 200_000 + "a@b.org"), ("a", "x " * 200_000 + "a@b.org"), ("r", "Call 808.555.0131, not 808.555.0132")], "id string, content string")
    got = privacy.personal_information(df, ["id"]).collect()
    assert sorted((r.id, r.type) for r in got) == [("a", "email"), ("r", "phone"), ("r", "phone")]


def test_wide_names_in_any_sentence(spark):
    rows = [(f"p{i}", f"会議の前に田中太{c}さんに聞く。") for i, c in enumerate("郎一次")] + [(f"q{i}", f"请联系欧阳砚{c}先生") for i, c in enumerate("秋书墨")]
    rows += [("a", "それは田中太郎に確認した"), ("b", "昨日、田中 花子が来た"), ("c", "后来欧阳书墨已经确认"), ("d", "田中の件"), ("e", "昨日は東京に行った"), ("f", "他去了北京")]
    found = {(r.id, r.type) for r in privacy.personal_information(spark.createDataFrame(rows, "id string, content string"), ["id"]).collect()}
    assert {i for i, t in found if t == "name"} == {f"{x}{i}" for x in "pq" for i in range(3)} | {"a", "b", "c"}


def test_common_words_are_no_surnames(spark):
    # in a protected context once, everywhere else in the corpus as a plain word
    rows = [("x", "请联系系统管理先生")] + [(f"n{i}", f"系统管理页面第{i}次更新，系统管理已经关闭") for i in range(20)]
    found = privacy.personal_information(spark.createDataFrame(rows, "id string, content string"), ["id"])
    assert found.count() == 0


def test_names_with_particles_and_long_addresses(spark):
    rows = [(f"p{i}", "Author: Ana Silva") for i in range(3)] + [("a", "falei com Ana da Silva ontem"), ("b", "x" * 60 + "@" + ".".join(["d" * 60] * 3) + ".org")]
    found = {(r.id, r.type, r.start, r.stop) for r in privacy.personal_information(spark.createDataFrame(rows, "id string, content string"), ["id"]).collect()}
    assert ("a", "name", 10, 22) in found and ("b", "email", 0, 247) in found


def test_lone_words_are_generalised(spark):
    rows = [(f"p{i}", "Author: Edda Solberg") for i in range(4)] + [("a", "ask solberg, then Solberg's host"), ("b", "The Count said count 1 to count 9"), ("c", "Dr. Count Error"), ("d", "Dr. Count Error")]
    got = {r.id: (r.redacted, r.generalised) for r in privacy.redact(spark.createDataFrame(rows, "id string, content string"), ["id"]).collect()}
    assert got["a"] == ("ask [PERSON], then [PERSON]'s host", ["solberg"]) and got["b"][0] == rows[5][1] and got["p0"][0].endswith("[NAME]")
