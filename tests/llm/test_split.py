import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollary.llm import split


def check(text, max_tokens=512, max_chars=3500, overlap=200):
    made = split.pieces(text, max_tokens, max_chars, overlap)
    assert "".join(text[a + back : b] for a, b, back in made) == text  # nothing lost or repeated but the overlaps
    for a, b, back in made:
        assert b - a <= max_chars and split.tokens(text[a:b]) <= max_tokens and 0 <= back <= overlap
    return made


def prose(rng, n):
    words = ["queue", "index", "restart", "a", "cache", "naïve", "記録", "gateway"]
    return " ".join(" ".join(rng.choices(words, k=rng.randint(3, 15))) + "." for _ in range(n))


def test_round_trip_and_limits():
    rng = random.Random(1)
    for k in range(40):
        parts = []
        for _ in range(rng.randint(1, 30)):
            parts.append(rng.choice([prose(rng, rng.randint(1, 9)), "# Heading", "```\n" + "x = 1\n\n" * rng.randint(1, 80) + "```", "- item\n- item", "日本語の文です。" * rng.randint(1, 90), "y" * rng.randint(1, 9000)]))
        check("\n\n".join(parts))
        check("\n".join(parts), 60, 400, 50)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#`。　x", max_size=400), st.integers(4, 40), st.integers(10, 120), st.integers(0, 60))
def test_any_text(text, max_tokens, max_chars, overlap):
    check(text, max_tokens, max_chars, min(overlap, max_chars // 2))


def test_limits_of_few_tokens():
    for text in ("` ` ` `", "a b c d e f g h", "a  b. c\n\nd e f"):
        for max_tokens in range(1, 12):
            check(text, max_tokens, 10, 1)


def test_cuts_at_headings_and_topics():
    a = "The queue stalls when the worker restarts. " * 30
    b = "Bread needs flour and water and salt. " * 30
    made = check(f"# Queue\n\n{a}\n\n# Bread\n\n{b}", 512, 1900)
    text = f"# Queue\n\n{a}\n\n# Bread\n\n{b}"
    assert any(text[s + back :].startswith("# Bread") for s, _, back in made)


def test_fences_stay_whole_if_they_fit():
    fence = "```\n" + "line of code\n" * 30 + "```\n"
    text = prose(random.Random(2), 40) + "\n\n" + fence + "\n" + prose(random.Random(3), 40)
    assert any(fence.strip() in text[a:b] for a, b, _ in check(text, 512, 2500))


def test_operator_edges(spark):
    long = "word " * 385
    rows = [("m", "fits", "word " * 384), ("m", "tokens", long), ("m", "tokens", long), ("m", "chars", "x" * 3501), ("m", "edge", "x" * 3500), ("m", "none", None), ("m", "empty", ""), ("m", "space", "　" * 3501), (None, None, long), ("c", "nbsp", "w " * 385)]
    df = spark.createDataFrame(rows, "item_kind string, item_id string, content string").withColumns({"piece": F.lit(1), "key_0": F.lit(2), "body": F.lit(3), "tokens": F.lit(0)})
    got = split.split_oversized(df, ["item_kind", "item_id"]).collect()
    assert {r.item_id for r in got} == {"tokens", "chars", "space", None, "nbsp"}
    assert all(r.length <= 3500 and r.tokens <= 512 for r in got)
    for key in ("tokens", "chars"):
        own = sorted((r for r in got if r.item_id == key), key=lambda r: r.piece_index)
        assert "".join(r.piece[r.overlap :] for r in own) == (long if key == "tokens" else "x" * 3501)
    assert split.split_oversized(df.limit(0), ["item_kind", "item_id"]).count() == 0


def test_equal_keys_of_different_texts(spark):
    long = "word " * 600
    rows = [(None, long), (None, long + "other"), ("a", long), ("a", long), ("a", long + "more")]
    got = split.split_oversized(spark.createDataFrame(rows, "item_id string, content string"), ["item_id"])
    assert got.where("piece_index = 0 and item_id is null").count() == 2 and got.where("piece_index = 0 and item_id = 'a'").count() == 2
