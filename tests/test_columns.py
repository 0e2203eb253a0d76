"""Parsers and paths against golden tables."""

import pytest
from pyspark.sql import functions as F

from lumenary.functions import columns as C, fixed
from lumenary.plans import process as P

SIZES = [
    ("ig-post", 1080, 1080), ("IG-POST", 1080, 1080), ("Ig-Story", 1080, 1920), ("4x6", 1800, 1200), ("1920x1080", 1920, 1080),
    ("1920,1080", 1920, 1080), (" 800 x 600 ", 800, 600), ("4 x 6", 4, 6), ("4,6", 4, 6), ("04x6", 4, 6), ("-5x+10", -5, 10),
    ("invalid", None, None), ("", None, None), ("1920", None, None), ("axb", None, None), ("1,2x3", None, None), ("1x2x3", None, None),
    ("1x2x3,4", None, None), ("+-1x2", None, None), ("1_0x2", None, None), ("9223372036854775808x1", None, None), (None, None, None),
]


def test_sizes(spark):
    rows = spark.createDataFrame(SIZES, "s string, w long, h long").select("*", C.size(F.col("s")).alias("got")).collect()
    assert [(r["s"], r["got"]["width"], r["got"]["height"]) for r in rows] == SIZES
    assert all((r["got"]["error"] is None) == (r["w"] is not None) for r in rows)
    errors = {r["s"]: r["got"]["error"] for r in rows}
    assert errors["1,2x3"] == "invalid width: 1,2" and errors["1x2x3,4"] == "invalid width: 1x2x3"


def test_sizes_on_the_driver():
    for s, w, h in SIZES:
        if s is None:
            continue
        if w is None:
            with pytest.raises(ValueError):
                P.parse_size(s)
        else:
            assert P.parse_size(s) == (w, h)


def test_presets():
    assert len(fixed.SIZES) == 15 and all(w > 0 and h > 0 for w, h in fixed.SIZES.values())
    assert len(fixed.COLOURS) == 22 and len(fixed.CONTENT_TYPES) == 31


PATHS = [
    ("image.png", "", "image_v0.jpg"), ("photo_v9.jpg", "", "photo_v10.jpg"), ("./photo.jpg", "", "photo_v0.jpg"),
    ("photo_v0_edited.jpg", "", "photo_v0_edited_v0.jpg"), ("/path/to/photo.jpg", "/output", "/output/photo_v0.jpg"),
    ("a_v1_v2.jpg", "", "a_v1_v3.jpg"), ("p_v007.jpg", "", "p_v8.jpg"), ("_v0.jpg", "", "_v0_v0.jpg"), (".hidden", "", "_v0.jpg"),
    ("a.tar.gz", "", "a.tar_v0.jpg"), ("a//b/../c.jpg", "", "a/c_v0.jpg"), ("../x.jpg", "", "../x_v0.jpg"), ("/../x.jpg", "", "/x_v0.jpg"),
    ("/a/b.c/d", None, "/a/b.c/d_v0.jpg"), ("x.jpg", "out/", "out/x_v0.jpg"), ("a_v99999999999999999999.jpg", "", None), ("a_v9223372036854775807.jpg", "", None),
]


def test_output_paths(spark):
    rows = spark.createDataFrame(PATHS, "p string, d string, want string").select("*", C.output_path(F.col("p"), F.col("d")).alias("got")).collect()
    assert [r["got"]["path"] for r in rows] == [r["want"] for r in rows]
    assert all((r["got"]["error"] is None) == (r["want"] is not None) for r in rows)


def test_clean_path(spark):
    cases = [("", "."), ("/", "/"), ("a/..", "."), ("../..", "../.."), ("/..", "/"), ("a/./b//c", "a/b/c"), ("a/../../b", "../b")]
    rows = spark.createDataFrame(cases, "p string, want string").select("want", C.clean_path(F.col("p")).alias("got")).collect()
    assert [r["got"] for r in rows] == [w for _, w in cases]


COLOURS = [
    ("white", (255, 255, 255, 255)), ("BLACK", (0, 0, 0, 255)), (" navy ", (0, 0, 128, 255)), ("#fff", (255, 255, 255, 255)), ("#a1B2c3", (161, 178, 195, 255)),
    ("#11223344", (17, 34, 51, 68)), ("bad", (187, 170, 221, 255)), ("decade", (222, 202, 222, 255)), ("grey", (128, 128, 128, 255)),
    ("#abcd", None), ("#ggg", None), ("", None), ("##fff", None), ("nocolour", None), (None, None),
]


def test_colours(spark):
    rows = spark.createDataFrame([(s,) for s, _ in COLOURS], "s string").select(C.colour(F.col("s")).alias("c")).collect()
    for (s, want), r in zip(COLOURS, rows):
        got = tuple(r["c"][:4])
        assert got == (want or (None,) * 4), s
        assert (r["c"]["error"] is None) == (want is not None)
        if s is not None and want:
            assert P.parse_color(s) == want
        elif s is not None:
            with pytest.raises(ValueError):
                P.parse_color(s)


def test_filters(spark):
    cases = [(x, n) for n, xs in fixed.FILTERS.items() for x in xs] + [("LANCZOS", None), (" linear", None), ("box", None), (None, None)]
    rows = spark.createDataFrame([(s,) for s, _ in cases], "s string").select(C.filter_name(F.col("s")).alias("n"), C.filter_label(F.col("s")).alias("l")).collect()
    assert [r["n"] for r in rows] == [n for _, n in cases]
    assert [r["l"] for r in rows] == [n or "unknown" for _, n in cases]


def test_small_functions(spark):
    row = spark.range(1).select(
        C.content_type(F.lit("a/B.HTML")).alias("html"), C.content_type(F.lit("x.y/z")).alias("none"), C.image_format(F.lit("a.JPeG")).alias("jpeg"),
        C.zone_id(F.lit("/hostedzone/Z/hostedzone/")).alias("zone"), C.zone_name(F.lit("a.com..")).alias("name"), C.bare_etag(F.lit('""x""')).alias("etag"),
        C.object_key(F.lit("/b/c/d.html"), "/b").alias("key"), C.random_id(F.unhex(F.lit("00012324ff19f0fb"))).alias("id"), C.log_level(F.lit("WARN")).alias("level"),
        C.headline(F.lit('x contentHeadline\t= "One", contentHeadline = "Two"')).alias("headline"), C.headline(F.lit('contentHeadline = ""')).alias("empty"),
        C.is_missing_stack(F.lit("Stack x does not exist")).alias("missing"), C.is_no_update(F.lit(None).cast("string")).alias("idle"),
    ).first()
    assert row["html"] == "text/html; charset=utf-8" and row["none"] == "application/octet-stream" and row["jpeg"] == "jpeg"
    assert (row["zone"], row["name"], row["etag"], row["key"]) == ("Z/hostedzone/", "a.com.", "x", "c/d.html")
    assert row["id"] == "".join(fixed.ID_LETTERS[b % 36] for b in bytes.fromhex("00012324ff19f0fb"))
    assert row["level"] == "warning" and row["headline"] == "One" and row["empty"] is None and row["missing"] and not row["idle"]
