"""Literal cases of the layout, text, decoding and status expressions."""

from __future__ import annotations

import difflib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirelight.functions import text as tx
from quirelight.operators import decode, frames, layout, metrics, paragraphs, placement, status
from quirelight.sources import files, sinks


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (_, t) in values.items()) or "x int"
    row = tuple(v for v, _ in values.values()) or (0,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


BLOCKS = "array<struct<x0:int,y0:int,x1:int,y1:int,text:string>>"


def page(spark, blocks):
    df = spark.createDataFrame([(blocks,)], f"blocks {BLOCKS}").withColumn("g", layout.find_gutter(F.col("blocks")))
    r = df.select("g", layout.reading_order(F.col("blocks"), F.col("g")).alias("o")).first()
    return r["g"], [b["text"] for b in r["o"]]


def test_two_columns_are_read_one_after_the_other(spark):
    blocks = [(60, 40, 540, 70, "Title")]
    for i, y in enumerate((100, 140, 180, 220), 1):
        blocks += [(60, y, 280, y + 30, f"L{i}"), (320, y, 540, y + 30, f"R{i}")]
    gutter, order = page(spark, blocks)
    assert 280 <= gutter <= 320
    assert order == "Title L1 L2 L3 L4 R1 R2 R3 R4".split()


def test_one_column_stays_as_it_is(spark):
    gutter, order = page(spark, [(60, y, 540, y + 30, f"P{i}") for i, y in enumerate((200, 40, 120))])
    assert gutter is None and order == ["P0", "P1", "P2"]


def paras(spark, lines):
    rows = [(left, top, right, top + 40, text) for text, top, left, right in lines]
    df = spark.createDataFrame([(rows,)], f"b {BLOCKS}")
    out = df.select(paragraphs.paragraphs(F.col("b"), paragraphs.line_stats(F.col("b"))).alias("p")).first()["p"]
    return [(p["text"], p["first_line_indent"]) for p in out]


@pytest.mark.parametrize(
    ("lines", "expected"),
    [
        ([("a", 100, 50, 950), ("b", 145, 50, 950), ("c", 190, 50, 940)], [("a b c", False)]),
        ([("a", 100, 50, 900), ("b", 220, 50, 780)], [("a", False), ("b", False)]),
        ([("a", 100, 50, 400), ("b", 145, 50, 900)], [("a", False), ("b", False)]),
        ([("a", 100, 50, 950), ("  b ", 145, 140, 950)], [("a", False), ("b", True)]),
        ([("中文", 100, 50, 950), ("日本", 145, 50, 950)], [("中文日本", False)]),
        ([], []),
        ([("  ", 100, 50, 900)], []),
    ],
)
def test_paragraphs(spark, lines, expected):
    assert paras(spark, lines) == expected


def test_sample_page_has_four_paragraphs(spark):
    lines = [(100, 80, 900), (145, 80, 900), (190, 80, 860), (280, 140, 900), (325, 80, 880), (420, 80, 890), (500, 80, 900)]
    assert [i for _, i in paras(spark, [(f"l{k}", *x) for k, x in enumerate(lines)])] == [False, True, False, False]


def test_native_paragraphs(spark):
    c = paragraphs.native_paragraphs(F.col("t"))
    assert one(spark, c, t=("line one\nline two\n\nline three\n", "string")) == ["line one line two", "line three"]
    assert one(spark, c, t=("   \n\n", "string")) == []


def test_white_space_is_unicode_white_space(spark):
    assert one(spark, tx.normalise(F.col("t")), t=("a b \x1c c　d", "string")) == "abcd"
    assert one(spark, tx.words(F.col("t")), t=(" a b\n", "string")) == ["a", "b"]
    assert one(spark, tx.utf16_hex(F.col("t")), t=("A\U0001f600", "string")) == "0041D83DDE00"


def test_char_f1_equals_the_counter_form(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choices("abcdé ", k=rng.randint(0, 20))), "".join(rng.choices("abcdé ", k=rng.randint(0, 20)))) for _ in range(200)]
    out = spark.createDataFrame(rows, "t string, g string").select("t", "g", tx.char_f1(F.col("t"), F.col("g")).alias("f")).collect()
    for r in out:
        both = sum((Counter(r["t"]) & Counter(r["g"])).values())
        if not r["t"]:
            assert r["f"] != r["f"]
        else:
            p, q = both / max(len(r["g"]), 1), both / len(r["t"])
            assert r["f"] == pytest.approx(2 * p * q / (p + q) if both else 0.0)


def test_upper_median_and_low_percentile(spark):
    assert one(spark, tx.upper_median(F.col("v")), v=([4, 1, 3, 2], "array<int>")) == 3
    assert one(spark, tx.low_percentile(F.col("v"), 0.1), v=(list(range(10)), "array<int>")) == 1
    assert one(spark, tx.upper_median(F.col("v")), v=([], "array<int>")) is None


def test_greedy_decode_takes_the_last_of_equals_and_drops_repeats(spark):
    steps = [[0.1, 0.9, 0.0], [0.1, 0.9, 0.0], [0.9, 0.1, 0.0], [0.0, 0.9, 0.0], [0.0, 0.5, 0.5]]
    c = decode.greedy_decode(F.col("s"), F.array(F.lit(""), F.lit("a"), F.lit("b")))
    r = one(spark, c, s=(steps, "array<array<double>>"))
    assert (r["text"], r["selection"]) == ("aab", [0, 3, 4]) and r["score"] == pytest.approx((0.9 + 0.9 + 0.5) / 3)


def test_word_groups_split_on_script_and_gap(spark):
    c = decode.word_groups(F.col("c"), F.col("s"))
    r = one(spark, c, c=(list("ab中c"), "array<string>"), s=([1, 2, 3, 9], "array<int>"))
    assert [(g["text"], g["cols"], g["state"]) for g in r] == [("ab", [1, 2], "en&num"), ("中", [3], "cn"), ("c", [9], "en&num")]


def test_overlaps_are_shared_from_left_to_right(spark):
    boxes = [(0.0, 10.0, "a"), (6.0, 20.0, "b"), (9.0, 30.0, "c")]
    r = one(spark, decode.share_overlaps(F.col("b")), b=(boxes, "array<struct<x0:double,x1:double,text:string>>"))
    assert [(x["x0"], x["x1"]) for x in r] == [(0.0, 8.0), (8.0, 14.5), (14.5, 30.0)]


def test_rounding_to_32_goes_to_even(spark):
    assert one(spark, frames.to_32(F.col("v")), v=(2000, "int")) == 1984
    assert one(spark, frames.to_32(F.col("v")), v=(2064, "int")) == 2048


def test_letterbox_pads_both_sides(spark):
    r = one(spark, frames.letterbox(F.col("w"), F.col("h")), w=(900, "int"), h=(40, "int"))
    assert (r["height"], r["pad_top"]) == (224, 92)


def test_graphics_state_stack(spark):
    unit = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    ops = [("cm", [2.0, 0.0, 0.0, 3.0, 0.0, 0.0], False), ("q", unit, False), ("cm", [5.0, 0.0, 0.0, 1.0, 0.0, 0.0], False), ("Do", unit, True), ("Q", unit, False), ("Do", unit, True), ("Q", unit, False), ("Do", unit, True)]
    assert one(spark, frames.scan_cover(F.col("o")), o=(ops, "array<struct<op:string,m:array<double>,image:boolean>>")) == 30 + 6 + 1


def test_status(spark):
    day = 86400
    cases = [(0, "trialing", 7), (6, "trialing", 1), (7, "expired", None), (99, "expired", None), (-1, "trialing", 7)]
    for days, name, left in cases:
        r = one(spark, status.status(F.lit(False), F.col("s"), F.col("n")), s=(1000, "long"), n=(1000 + days * day, "long"))
        assert (r["status"], r["days_left"]) == (name, left)
    assert one(spark, status.status(F.lit(False), F.col("s"), F.lit(5)), s=(None, "long"))["status"] == "expired"
    assert one(spark, status.status(F.lit(True), F.col("s"), F.lit(99 * day)), s=(0, "long"))["status"] == "licensed"
    assert one(spark, status.parse_record(F.col("t")), t=("1700000000", "string")) == (1700000000, "")
    assert one(spark, status.parse_record(F.col("t")), t=("12|ab|c", "string")) == (12, "ab|c")
    assert one(spark, status.parse_record(F.col("t")), t=("x|ab", "string")) is None
    assert one(spark, status.same_machine(F.col("a"), F.col("b")), a=("", "string"), b=("x", "string")) is True
    assert one(spark, status.same_machine(F.col("a"), F.col("b")), a=("y", "string"), b=("x", "string")) is False


def test_versions(spark):
    c = tx.version_newer(F.col("a"), F.col("b"))
    for a, b, newer in [("v1.10", "1.9.9", True), ("1.0", "1", False), ("2.x", "2.0.1", False)]:
        assert one(spark, c, a=(a, "string"), b=(b, "string")) is newer


def test_files(spark):
    assert one(spark, tx.is_supported(F.col("p")), p=("/a/B.JPeG", "string")) is True
    assert one(spark, tx.base_name(F.col("p")), p=("a\\b/c.pdf", "string")) == "c.pdf"
    assert one(spark, files.info_field(F.col("t"), "Pages"), t=("Title: x\nPages:   12\n", "string")) == "12"
    cache = '[{"box":[[0,0],[2,0],[2,1],[0,1]],"text":"a","score":0.5}]\x00 \n\x00[]'
    pages = one(spark, files.cache_pages(F.col("t")), t=(cache, "string"))
    assert [len(p) for p in pages] == [1, 0] and pages[0][0]["text"] == "a" and pages[0][0]["words"] is None
    with pytest.raises(Exception):
        one(spark, files.parse_blocks(F.col("t")), t=('[{"box":"no","text":"a"}]', "string"))


def test_nearest_right_takes_the_closest_on_the_line(spark):
    words = [(0.0, 0.0, 10.0, 10.0), (30.0, 2.0, 40.0, 12.0), (14.0, 5.0, 20.0, 15.0), (12.0, 50.0, 20.0, 60.0)]
    r = one(spark, layout.nearest_right(F.col("w")), w=(words, "array<struct<x0:double,y0:double,x1:double,y1:double>>"))
    assert [(x["index"], round(x["gap"], 6)) for x in r] == [(0, 0.4), (2, 1.0)]


def test_words_never_move_left_and_small_overlaps_are_cleared(spark):
    placed = placement.Page(800.0)
    words = [{"text": "ab", "x0": 10.0, "y0": 0.0, "x1": 30.0, "y1": 10.0}, {"text": "cd", "x0": 28.0, "y0": 1.0, "x1": 50.0, "y1": 11.0}, {"text": "far", "x0": 5.0, "y0": 0.0, "x1": 9.0, "y1": 10.0}]
    runs = placed.block("ab cd far", 0.0, 0.0, 60.0, 10.0, words)
    assert [round(r.x0, 3) for r in runs] == [10.0, 33.12, 5.0]
    assert all(r.x0 >= w["x0"] for r, w in zip(runs, words))
    assert placement.operators(runs).startswith("BT\n3 Tr\n") and "<00610062> Tj" in placement.operators(runs)


def test_sequence_ratio_keeps_the_junk_rule(spark):
    a, b = "ab" * 150, "ba" * 150
    r = spark.createDataFrame([(a, b), ("", "x")], "t string, g string").select(metrics.sequence_ratio(F.col("t"), F.col("g")).alias("r")).collect()
    assert r[0]["r"] == difflib.SequenceMatcher(None, a, b).ratio() and r[1]["r"] != r[1]["r"]


def test_a_word_meets_only_what_ends_behind_its_start():
    rng, plain = random.Random(3), []
    found = placement.Extents()
    for _ in range(400):
        start, low, gap, cap = rng.uniform(0, 300), rng.choice([0.0, 40.0, rng.uniform(-50, 3000)]), rng.uniform(0.3, 9), rng.uniform(1, 60)
        high, inside = low + rng.choice([-5.0, 10.0, 2500.0, float("inf")]), rng.random() < 0.5
        expected = start
        for a, b, end in plain:
            if low < b - placement.TOUCH and high > a + placement.TOUCH and 0 < end + gap - expected <= cap and (expected < end or not inside):
                expected = end + gap
        assert found.clear(start, low, high, gap, cap, inside) == expected
        plain.append((low, high, expected + 20))
        found.add(low, high, expected + 20)


def test_totals_of_no_pages_are_zero(spark):
    none = spark.createDataFrame([], "chars int, delta double")
    assert metrics.delta_totals(none, []).first().asDict() == {"pages": 0, "better": 0, "worse": 0, "mean_delta": 0.0}


def test_caches_and_scores_are_read_back(spark, tmp_path):
    blocks = spark.createDataFrame([("a", 200, "x", "text"), ("b", 150, "x", None)], "doc string, dpi int, engine string, text string")
    sinks.write_cache(blocks, str(tmp_path / "cache"), ["doc", "dpi", "engine"])
    sinks.write_scores(blocks.select("doc", "dpi"), str(tmp_path / "scores"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "cache")).select("doc", "dpi", "text").collect())) == [("a", 200, "text"), ("b", 150, None)]
    assert spark.read.json(str(tmp_path / "scores")).count() == 2
