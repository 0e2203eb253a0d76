"""Geometry, kernels, codecs, headlines and the image plan, on pictures made here."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lumenary import cli
from lumenary.functions import geometry as G
from lumenary.operators import codecs, metadata, pixels
from lumenary.plans import process as P
from lumenary.sources import files


def picture(h=40, w=60):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([x * 4 % 256, y * 6 % 256, (x + y) * 2 % 256], 2).astype(np.uint8)


@pytest.mark.parametrize("name", pixels.RADIUS)
def test_kernels(name):
    for a, b in ((64, 24), (24, 64), (5, 5), (1, 9), (9, 1)):
        assert np.allclose(pixels.weights(a, b, name).sum(1), 1)
    assert (pixels.resize(np.full((9, 7, 3), 77, np.uint8), 20, 31, name) == 77).all()
    assert pixels.resize_to_fit(picture(), 30, 30, name).shape[:2] == (20, 30)
    shifted = sum(pixels.kernel(name, np.array([0.3 + k]))[0] for k in range(-6, 7))
    assert abs(shifted - 1) < (0.02 if name == "lanczos" else 1e-9)


def test_linear_light_brightens_mixes():
    x = np.zeros((2, 64, 3), np.uint8)
    x[:, ::2] = 255
    assert pixels.resize(x, 8, 1, "bilinear", True)[0, 3, 0] > pixels.resize(x, 8, 1, "bilinear")[0, 3, 0] + 30


def test_frame_and_fill():
    out = pixels.add_frame(picture(), 10, 20, 30, 40, (1, 2, 3))
    assert out.shape == (80, 120, 3) and (out[0, 0] == (1, 2, 3)).all() and (out[10:50, 40:100] == picture()).all()
    assert (pixels.fill(out, 0, 0, 5, 5, (9, 9, 9))[:5, :5] == 9).all()


def test_label_draws_white_box_and_black_text():
    x = np.full((80, 200, 3), 120, np.uint8)
    out = pixels.add_label(x.copy(), "Ab 1", 18, 10, 40, 2)
    g = pixels.label_geometry("Ab 1", 18, 200, 80, 10, 40, 2)
    box = out[g["box_top"] : g["box_top"] + g["box_height"], g["box_left"] : g["box_left"] + g["box_width"]]
    assert set(np.unique(box)) == {0, 255} and (pixels.add_label(x.copy(), "", 18, 10, 40, 2) == x).all()
    assert (pixels.add_label(x.copy(), "x", 18, 10, 400, 2) == x).all()  # no room


def decoded(spark, folder):
    return {r["path"].rsplit("/", 1)[1]: r["image"] for r in files.images(spark, str(folder)).collect()}


def array(image):
    return np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])[..., ::-1]


def test_encoders_are_read_back(spark, tmp_path):
    x = picture(33, 47)
    for name, data in (("a.png", codecs.png(x)), ("a.tiff", codecs.tiff(x)), ("g.png", codecs.png(x[..., :1])), ("h.jpg", codecs.jpeg(x, 95)), ("l.jpg", codecs.jpeg(x, 20)), ("g.jpg", codecs.jpeg(x[..., :1], 90)), ("flat.jpg", codecs.jpeg(np.full((8, 8, 3), 200, np.uint8))), ("bad.png", b"no"), ("a+b c.png", codecs.encode(x, ".PNG"))):
        (tmp_path / name).write_bytes(data)
    got = decoded(spark, tmp_path)
    assert got["bad.png"]["height"] == -1
    assert all((array(got[n]) == x).all() for n in ("a.png", "a.tiff", "a+b c.png")) and (array(got["g.png"]) == x[..., :1]).all()
    error = lambda n, y: np.abs(array(got[n]).astype(int) - y).mean()
    assert error("h.jpg", x) < 3 and error("l.jpg", x) < 15 and error("g.jpg", x[..., :1]) < 2 and error("flat.jpg", 200) < 2
    with pytest.raises(ValueError):
        codecs.encode(x, ".gif")
    with pytest.raises(ValueError):
        codecs.jpeg(x, 0)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5000), st.integers(1, 5000), st.integers(1, 3000), st.integers(1, 3000))
def test_fit_stays_in_its_box(w, h, bw, bh):
    rw, rh = pixels.fit_size(w, h, bw, bh)
    assert 1 <= rw <= max(1, bw) and 1 <= rh <= max(1, bh) and (rw == bw or rh == bh)


def test_placement(spark):
    rows = spark.range(1, 400).selectExpr("id * 37 % 911 + 1 AS w", "id * 53 % 677 + 1 AS h", "id * 7 % 500 + 1 AS ow", "id * 11 % 400 + 1 AS oh", "id % 30 AS f")
    cols = [F.col(c) for c in ("w", "h", "ow", "oh", "f")]
    names = ("width", "height", "left", "top", "right", "bottom", "image_bottom", "canvas_width", "canvas_height", "error")
    placed = G.expand(rows.withColumn("v", G.wrap(*cols)), "w", "h", "ow", "oh", "f")
    for r in placed.collect():
        e, v = {n: r[n] for n in names}, r["v"]
        if r["ow"] <= 2 * r["f"] or r["oh"] <= 2 * r["f"]:
            assert e["error"] and e["width"] is None
        else:
            assert (e["width"], e["height"]) == pixels.fit_size(r["w"], r["h"], r["ow"] - 2 * r["f"], r["oh"] - 2 * r["f"])
            assert e["left"] + e["width"] + e["right"] == r["ow"] and e["top"] + e["height"] + e["bottom"] == r["oh"]
            assert 0 <= e["right"] - e["left"] <= 1 and 0 <= e["bottom"] - e["top"] <= 1 and e["left"] >= r["f"]
        assert v["canvas_width"] == v["width"] + 2 * r["f"] and v["image_bottom"] == r["f"] + v["height"]


def test_label_box_agrees_with_the_drawing_side(spark):
    rows = spark.range(1, 200).selectExpr("repeat('é', cast(id % 9 AS int)) AS t", "id % 50 + 8 AS font", "id * 13 % 300 + 1 AS w", "id * 17 % 200 + 1 AS h", "id % 40 - 5 AS l", "id * 3 % 250 AS b", "id % 7 AS p")
    for r in rows.select("*", G.label_box(*[F.col(c) for c in ("t", "font", "w", "h", "l", "b", "p")]).alias("g")).collect():
        want = pixels.label_geometry(*[r[c] for c in ("t", "font", "w", "h", "l", "b", "p")])
        assert {k: r["g"][k] for k in want} == want and r["g"]["drawable"] == (want["box_width"] > 0 and want["box_height"] > 0)


def iim(*values):
    return b"".join(b"\x1c\x02\x69" + struct.pack(">H", len(v)) + v for v in values)


def with_headline(data, text):
    block = iim(b"first", text)
    resource = b"Photoshop 3.0\0" + b"8BIM" + struct.pack(">HBB", 0x0404, 0, 0) + struct.pack(">I", len(block)) + block + b"\0" * (len(block) % 2)
    return data[:2] + b"\xff\xed" + struct.pack(">H", len(resource) + 2) + resource + data[2:]


def test_embedded_headlines():
    plain = codecs.jpeg(picture())
    assert metadata.embedded_headline(with_headline(plain, "Höhe".encode()), "jpeg") == "Höhe"
    assert metadata.embedded_headline(with_headline(plain, "H\xf6he".encode("latin-1")), "jpeg") == "Höhe"
    assert metadata.embedded_headline(plain, "jpeg") == "" and metadata.embedded_headline(None, "jpeg") == "" and metadata.embedded_headline(plain, None) == ""
    assert metadata.embedded_headline(with_headline(plain, b"x")[:40], "jpeg") == ""
    block = iim(b"tiff")
    tif = b"II*\0" + struct.pack("<I", 8) + struct.pack("<HHHII", 1, 33723, 1, len(block), 26) + struct.pack("<I", 0) + block
    assert metadata.embedded_headline(tif, "tiff") == "tiff"


def test_letters_with_accents_are_drawn_without():
    draw = lambda text: pixels.draw_text(np.full((20, 60, 3), 255, np.uint8), text, 2, 2, 18)
    assert (draw("é") == draw("E")).all() and (draw("a") == draw("A")).all() and (draw("(") != draw(")")).any() and (draw("語") == draw("→")).all()
    assert all(g.shape == (7, 5) and g.any() for g in pixels.GLYPHS.values())


def test_webp_headlines():
    block = iim(b"webp")
    tif = b"II*\0" + struct.pack("<I", 8) + struct.pack("<HHHII", 1, 33723, 1, len(block), 26) + struct.pack("<I", 0) + block
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    for exif in (tif, b"Exif\0\0" + tif):
        body = b"WEBP" + chunk(b"VP8X", bytes(10)) + chunk(b"EXIF", exif) + chunk(b"XMP ", b"x")
        data = b"RIFF" + struct.pack("<I", len(body)) + body
        assert metadata.embedded_headline(data, "webp") == "webp"
    assert metadata.embedded_headline(b"RIFF", "webp") == "" and metadata.embedded_headline(b"RIFF\0\0\0\0WEBPEXIF\x05\0\0\0II*", "webp") == ""


def test_taps_are_the_matrix():
    x = picture(31, 43)
    for name in pixels.RADIUS:
        for h, w in ((7, 9), (64, 80), (31, 43), (1, 1)):
            whole = np.einsum("hi,wj,ijc->hwc", pixels.weights(31, h, name), pixels.weights(43, w, name), x.astype(float))
            assert np.abs(pixels.resize(x, w, h, name).astype(float) - np.clip(whole, 0, 255)).max() <= 0.5 + 1e-9


def test_pictures_are_rendered_once(spark, tmp_path, monkeypatch):
    for n in ("a.png", "a.tiff.png", "b.png"):
        (tmp_path / n).write_bytes(codecs.png(picture()))
    paths = [str(tmp_path / n) for n in ("a.png", "b.png", "a.png", "gone.png")]
    done = P.process(spark, paths, P.Settings("40x30", outdir=f"file://{tmp_path}/out", format=".png"))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3  # drawn, written, settled
    rows = sorted((r["ordinal"], r["error"] is None) for r in done.collect())
    assert rows == [(1, True), (2, True), (3, False)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a_v0.png", "b_v0.png"]
    assert array(decoded(spark, tmp_path / "out")["b_v0.png"]).shape == (30, 40, 3)
    with pytest.raises(ValueError, match="format"):
        P.plan(spark, paths, P.Settings("1x1", format=".gif"))


def test_paths_of_any_store(spark, monkeypatch):
    from lumenary.sources import stores

    inputs = files.arguments(spark, ["s3a://bucket/in/x_v3.png", "/in/y.png", "hdfs://host:1/z.jpg"])
    own = [r["output"] for r in P.named(inputs, P.Settings("1x1")).orderBy("ordinal").collect()]
    assert own == ["s3a://bucket/in/x_v4.jpg", "/in/y_v0.jpg", "hdfs://host:1/z_v0.jpg"]
    there = [r["output"] for r in P.named(inputs, P.Settings("1x1", outdir="s3a://other/out", format=".tiff")).orderBy("ordinal").collect()]
    assert there == ["s3a://other/out/x_v4.tiff", "s3a://other/out/y_v0.tiff", "s3a://other/out/z_v0.tiff"]
    assert stores.whole_path("s3a://b/x") == "s3a://b/x" and stores.local_path("file:///a/b") == "/a/b" and stores.local_path("s3a://b/x") is None
    monkeypatch.setattr(stores, "fs", type("Arrow", (), {"FileSystem": type("Any", (), {"from_uri": staticmethod(lambda uri: uri)})}))
    assert [stores.open_store(x) for x in ("s3a://b/x", "s3n://b/x", "hdfs://h:1/x", "gcs://b/x")] == ["s3://b/x", "s3://b/x", "hdfs://h:1/x", "gs://b/x"]


def test_process_end_to_end(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(codecs.png(picture()))
    (tmp_path / "a.jpg").write_bytes(with_headline(codecs.jpeg(picture(30, 30)), b"Inside"))
    (tmp_path / "b.jpg").write_bytes(with_headline(codecs.jpeg(picture(30, 30)), b"Inside"))
    (tmp_path / "b.jpg.dop").write_text('{ contentHeadline = "Side", }')
    (tmp_path / "bad.png").write_bytes(b"no picture")
    out = tmp_path / "out"
    paths = [str(tmp_path / n) for n in ("a.png", "a.jpg", "b.jpg", "bad.png", "none.jpg")]
    rows = P.process(spark, paths, P.Settings("120x90", color="teal", label=True, outdir=str(out))).collect()
    by = {r["path"].rsplit("/", 1)[1]: r for r in rows}
    assert set(by) == {"a.jpg", "b.jpg", "bad.png", "none.jpg"}  # of a.png and a.jpg, the last
    assert by["a.jpg"]["error"] is None and by["bad.png"]["error"].startswith("failed to load") and by["none.jpg"]["error"].startswith("failed to load")
    assert {p.name for p in out.iterdir()} == {"a_v0.jpg", "b_v0.jpg"}
    got = decoded(spark, out)
    assert (got["a_v0.jpg"]["width"], got["a_v0.jpg"]["height"]) == (120, 90)
    assert np.abs(array(got["a_v0.jpg"])[2, 2].astype(int) - (0, 128, 128)).max() < 12
    heads = P.headlines(spark, files.arguments(spark, paths[:4]), [str(tmp_path)])
    assert {r["path"].rsplit("/", 1)[1]: r["headline"] for r in heads.collect()} == {"a.png": None, "a.jpg": "Inside", "b.jpg": "Side", "bad.png": None}
    wrapped = P.plan(spark, paths[:1], P.Settings("120x90", fit="wrap", frame=10)).first()
    assert (wrapped["out_w"], wrapped["out_h"]) == (120 + 18, 80 + 18)
    assert P.plan(spark, paths[:1], P.Settings("120x90", frame=60)).first()["error"] == "frame too large for output size"
    assert "unknown fit" in P.plan(spark, paths[:1], P.Settings("120x90", fit="x")).first()["error"]
    for wrong in ({"size": "x"}, {"size": "1x1", "filter": "x"}, {"size": "1x1", "color": "x"}, {"size": "1x1", "quality": 101}):
        with pytest.raises(ValueError):
            P.plan(spark, paths, P.Settings(**wrong))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.png").write_bytes(codecs.png(picture()))
    assert cli.main(["process", "--size", "50x50", "-o", str(tmp_path / "o"), str(tmp_path / "a.png"), str(tmp_path / "no.png")]) == 0
    said = capsys.readouterr().err
    assert "60x40 ->" in said and "(50x50)" in said and "failed to load" in said
    assert cli.main(["process", "--size", "bad", str(tmp_path / "a.png")]) == 1
    monkeypatch.chdir(tmp_path)
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "index.html").write_text("hi")
    (tmp_path / "zones.json").write_text('{"ordinal": 1, "id": "/hostedzone/Z1", "name": "a.org.", "private": false}\n')
    assert cli.main(["publish", "--subdomain", "s", "--zones", str(tmp_path / "zones.json")]) == 0
    said = capsys.readouterr().out
    assert "https://s.a.org" in said and '"upload"' in said and '"invalidate"' in said
    assert files.load_config(str(tmp_path)) == {"subdomain": "s", "hosted_zone_id": "Z1", "domain_name": "a.org"}
    assert cli.main(["publish", "--build-dir", "nowhere"]) == 1
