import random

import pytest
from pyspark.sql import functions as F

from recollary.llm import language

TEMPLATES = {
    "en": ["The {a} was restarted before the {b} and it did not help.", "We should check whether the {a} still writes to the {b}.", "Nobody knows why the {b} stopped after the {a}."],
    "es": ["El {a} se reinició antes que el {b} y no sirvió de nada.", "Deberíamos comprobar si el {a} todavía escribe en el {b}.", "Nadie sabe por qué se detuvo el {b} después del {a}."],
    "de": ["Der {a} wurde vor dem {b} neu gestartet und es half nicht.", "Wir sollten prüfen, ob der {a} noch in den {b} schreibt.", "Niemand weiß, warum der {b} nach dem {a} stehen blieb."],
    "fr": ["Le {a} a été redémarré avant le {b} et cela n'a pas aidé.", "Nous devrions vérifier si le {a} écrit encore dans le {b}.", "Personne ne sait pourquoi le {b} s'est arrêté après le {a}."],
    "pt": ["O {a} foi reiniciado antes do {b} e não ajudou em nada.", "Devíamos verificar se o {a} ainda escreve no {b}.", "Ninguém sabe por que razão o {b} parou depois do {a}."],
    "ja": ["{a}は{b}の前に再起動されましたが、役に立ちませんでした。", "{a}がまだ{b}に書き込むかどうかを確認しましょう。", "{a}の後に{b}が止まった理由は誰も知りません。"],
    "zh": ["{a}在{b}之前重启了，但是没有帮助。", "我们应该检查{a}是否还在写入{b}。", "没有人知道为什么{b}在{a}之后停了。"],
}
NOUNS = ["index", "cache", "server", "monitor", "pool", "router", "archive", "gateway", "token", "module"]


def sentence(rng, code):
    return rng.choice(TEMPLATES[code]).format(a=rng.choice(NOUNS), b=rng.choice(NOUNS))


@pytest.fixture(scope="module")
def network():
    rng = random.Random(1)
    texts, labels = [], []
    for code in language.LANGUAGES:
        for i in range(60):
            texts.append(" ".join(sentence(rng, code) for _ in range(4)))
            labels.append(code if i % 8 else rng.choice(language.LANGUAGES))  # some labels are wrong
    return language.fit(texts, labels, steps=600)


def test_held_out_accuracy(network):
    rng = random.Random(99)
    reader = language.Reader(network)
    cases = [(code, sentence(rng, code)) for code in language.LANGUAGES for _ in range(40)]
    right = sum(found[0] == [code] for (code, _), found in zip(cases, reader.read([t for _, t in cases])))
    assert right >= 0.97 * len(cases)


def test_mixed_and_code(network):
    rng = random.Random(5)
    en, ja = sentence(rng, "en"), sentence(rng, "ja")
    text = f"**User:**\n{en}\n\n**Assistant:**\n{en} {en}\n\n```\nEl servidor se reinició ayer.\n```\n\n- {ja}\n{ja}"
    found, segments = language.Reader(network).read([text])[0]
    assert found == ["en", "ja"] and [s["language"] for s in segments] == ["en", "ja"] and [s["sentences"] for s in segments] == [3, 2]
    assert all(0.5 < s["confidence"] <= 1 for s in segments)


def test_edges(spark, network):
    rng = random.Random(7)
    rows = [("a", sentence(rng, "fr")), ("a", sentence(rng, "fr")), ("b", None), ("c", ""), ("d", "12345 !!"), (None, sentence(rng, "de")), ("long", sentence(rng, "es") * 2000), ("short", "hello world")]
    df = spark.createDataFrame(rows, "id string, content string").withColumns({"languages": F.lit(1), "body": F.lit(2), "c0": F.lit(3)})
    got = [(r.id, r.languages) for r in language.detect(df, network, ["id"]).collect()]
    assert len(got) == 8
    by = dict(got)
    assert by["b"] == by["c"] == by["d"] == [] and by["a"] == ["fr"] and by[None] == ["de"] and by["long"] == ["es"] and len(by["short"]) == 1


def test_labels(spark):
    df = spark.createDataFrame([("EN-us",), ("Japanese",), ("por",), (" zh_CN ",), ("und",), ("",), (None,), ("français",)], "x string")
    assert [r.v for r in df.select(language.canonical(F.col("x")).alias("v")).collect()] == ["en", "ja", "pt", "zh", None, None, None, "fr"]


def test_windows_cover_long_text():
    text = "x" * 1000
    parts = language.windows(text)
    assert all(len(p) <= language.WINDOW for p in parts) and len(parts) >= 1000 // language.WINDOW


def test_training_sample_is_bounded(spark):
    rows = [(f"m{i}", "text.", ["en", "English", "de", None, "??"][i % 5]) for i in range(100)]
    df = spark.createDataFrame(rows, "memory_id string, content string, language string")
    got = [r.label for r in language.labelled_sample(df, "memory_id", "content", "language", per_label=7).collect()]
    assert sorted(got) == ["de"] * 7 + ["en"] * 7


def test_untrained_network_without_labels():
    assert language.Reader(language.fit([], [])).read(["Some text here."])[0][0]
