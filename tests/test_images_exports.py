"""Line scores against a closed formula, resampling and PNG files against plain code, exports that resume."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.functions import images
from winnow.operators import gates
from winnow.sources import exports


def drawn(width, bright=200.0, size=256, angle=0.0):
    """A bright line of Gaussian profile through the middle."""
    y, x = np.mgrid[:size, :size] - size // 2
    across = x * np.cos(angle) + y * np.sin(angle)
    return bright * np.exp(-0.5 * (across / width) ** 2)


@pytest.mark.parametrize("width", [0.8, 1.5, 3.0, 6.0])
def test_ridges_on_a_line_equal_the_formula(width):
    """Across its middle a line of width w bends by w s^2 / (w^2 + s^2)^1.5 at scale s; a scale too many fails this for wide lines."""
    want = max(200 / 255 * width * s**2 / (width**2 + s**2) ** 1.5 for s in (1, 2))
    for angle in (0.0, 0.6):
        at = images.ridges(drawn(width, angle=angle))[128, 128]
        assert at == pytest.approx(want, rel={0.8: 0.06, 1.5: 0.01}.get(width, 2e-3))  # taps at whole pixels are coarse for thin lines
    assert images.SCALES == (1.0, 2.0) and images.ridges(255 - drawn(width))[128, 128] < 0.1 * want


def test_line_scores_are_taken_in_a_frame_of_256():
    line = drawn(1.5).astype(np.uint8)
    strength = np.sort(images.ridges(line).ravel())
    assert images.line_score(line) == pytest.approx(strength[int(0.98 * 65536) :].mean(), rel=1e-12)
    assert images.line_coverage(line) == pytest.approx(strength.mean(), rel=1e-12)
    large = np.kron(line, np.ones((2, 2), np.uint8))
    assert images.line_score(large) == pytest.approx(images.line_score(images.resized(large, 256, 256, "bicubic")), rel=1e-12)
    assert images.line_score(large) == pytest.approx(images.line_score(line), rel=0.15)
    assert images.line_score(np.full((40, 30), 9, np.uint8)) == pytest.approx(0, abs=1e-12)


def plain_resize(image, size, shape, support):
    """Each new pixel as the weighted mean of the old ones under a filter as wide as a new pixel."""
    def one(row):
        scale, out = len(row) / size, []
        wide = max(1.0, scale)
        for i in range(size):
            centre = (i + 0.5) * scale
            lo, hi = max(0, int(centre - support * wide + 0.5)), min(len(row), int(centre + support * wide + 0.5))
            w = [shape((j + 0.5 - centre) / wide) for j in range(lo, hi)]
            out.append(min(255, max(0, int(np.floor(sum(a * float(b) for a, b in zip(w, row[lo:hi])) / sum(w) + 0.5)))))
        return out
    across = np.array([one(r) for r in image])
    return np.array([one(c) for c in across.T]).T


@pytest.mark.parametrize("size", [7, 16, 33])
def test_resampling_equals_a_plain_loop(size):
    image = np.random.default_rng(1).integers(0, 256, (20, 26)).astype(np.uint8)
    sinc = lambda v: 1.0 if v == 0 else np.sin(np.pi * v) / (np.pi * v)
    lanczos = lambda v: sinc(v) * sinc(v / 3) if abs(v) < 3 else 0.0
    cubic = lambda v: 1.5 * abs(v) ** 3 - 2.5 * v * v + 1 if abs(v) < 1 else -0.5 * abs(v) ** 3 + 2.5 * v * v - 4 * abs(v) + 2 if abs(v) < 2 else 0.0
    assert np.abs(images.resized(image, size, size).astype(int) - plain_resize(image, size, lanczos, 3)).max() <= 1
    assert np.abs(images.resized(image, size, size, "bicubic").astype(int) - plain_resize(image, size, cubic, 2)).max() <= 1
    assert (images.resized(np.full((9, 5), 77, np.uint8), size, size) == 77).all()
    assert images.resized(image, 20, 26).tolist() == image.tolist()


def decoded(data):
    """A PNG reader as the format's text describes it."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, {}
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        parts[kind], at = body, at + 12 + n
    width, height, depth, colour = struct.unpack(">IIBB", parts[b"IHDR"][:10])
    step = 1 if colour == 0 else 3
    raw, line = zlib.decompress(parts[b"IDAT"]), width * step
    out, kinds = np.zeros((height + 1, line + step), int), set()
    for y in range(height):
        kind, row = raw[y * (line + 1)], raw[y * (line + 1) + 1 : (y + 1) * (line + 1)]
        kinds.add(kind)
        for i in range(line):
            a, b, c = out[y + 1, i], out[y, i + step], out[y, i]
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y + 1, i + step] = (row[i] + [0, a, b, (a + b) // 2, near][kind]) & 255
    assert depth == 8
    image = out[1:, step:].astype(np.uint8)
    return (image if step == 1 else image.reshape(height, width, 3)), kinds


def test_png_files_decode_to_what_was_written():
    rng = np.random.default_rng(2)
    smooth = np.add.outer(np.arange(50) * 3, np.arange(41) * 2).astype(np.uint8)
    seen = set()
    for image in (smooth, smooth.T, rng.integers(0, 256, (30, 17)).astype(np.uint8), drawn(2.0, size=64).astype(np.uint8), rng.integers(0, 256, (9, 8, 3)).astype(np.uint8), np.zeros((1, 1), np.uint8)):
        back, kinds = decoded(images.png(image))
        assert back.tolist() == image.tolist()
        seen |= kinds
    assert len(seen) >= 4 and len(images.png(smooth)) < smooth.size // 3


def image_rows(spark, n=6):
    rows = [(f"c{i % 2}", f"{i}.png", [(i * 7 + j) % 256 for j in range(12)], 3, 4) for i in range(n)] + [("c0", "none.png", None, None, None)]
    return spark.createDataFrame(rows, "cls string, name string, px array<short>, height int, width int")


def test_images_are_written_once_and_a_broken_run_resumes(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = image_rows(spark)
    made = exports.write_images(rows.where("name < '3'"), f"file://{root}")
    assert sorted((r["cls"], r["name"], r["made"]) for r in made.collect()) == [("c0", "0.png", True), ("c0", "2.png", True), ("c1", "1.png", True)]
    times = {f: os.stat(f"{root}/{f}").st_mtime_ns for f in ("c0/0.png", "c0/2.png", "c1/1.png")}
    bad = rows.withColumn("height", F.when(F.col("name") == "5.png", 5).otherwise(F.col("height")))  # pixels that don't fit
    with pytest.raises(Exception):
        exports.write_images(bad, root).count()
    assert not os.path.exists(f"{root}/c1/5.png")
    again = {r["name"]: r["made"] for r in exports.write_images(rows, root).collect()}
    assert again["5.png"] and not again["0.png"] and len(again) == 6
    assert {f: os.stat(f"{root}/{f}").st_mtime_ns for f in times} == times
    assert sorted(f for d in ("c0", "c1") for f in os.listdir(f"{root}/{d}")) == [f"{i}.png" for i in range(6)] or not [f for d in ("c0", "c1") for f in os.listdir(f"{root}/{d}") if f.endswith(".png") and f.startswith(".")]
    assert decoded(open(f"{root}/c1/3.png", "rb").read())[0].ravel().tolist() == [(21 + j) % 256 for j in range(12)]


def test_files_are_copied_by_class(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.bin").write_bytes(bytes([i] * 10))
    rows = spark.createDataFrame([("a", f"{tmp_path}/0.bin"), ("b", f"file:{tmp_path}/1.bin")], "cls string, path string")
    assert exports.copy_files(rows, f"{tmp_path}/to").where("made").count() == 2
    assert exports.copy_files(rows, f"{tmp_path}/to").where("made").count() == 0
    assert (tmp_path / "to/b/1.bin").read_bytes() == bytes([1] * 10)


def test_a_generated_pool_goes_on_at_the_right_chunk_and_seed(spark, tmp_path):
    root, calls = str(tmp_path / "pool"), []

    def make(cls, seeds, fail=None):
        first = seeds.agg(F.min("seed")).first()[0]
        calls.append((cls, first))
        if (cls, first) == fail:
            raise RuntimeError("lost")
        return seeds.withColumn("x", F.col("seed") * (1 if cls == "a" else -1))

    with pytest.raises(RuntimeError):
        exports.generated_pool(spark, root, {"a": 25, "b": 12}, 10, lambda c, s: make(c, s, ("a", 20)))
    assert calls == [("a", 0), ("a", 10), ("a", 20)]
    assert sorted(tuple(r) for r in exports.chunk_log(spark, root).collect()) == [("a", 0, 10), ("a", 1, 10)]
    calls.clear()
    rows = exports.generated_pool(spark, root, {"a": 25, "b": 12}, 10, make)
    assert calls == [("a", 20), ("b", 0), ("b", 10)]
    assert sorted((r["cls"], r["seed"], r["x"]) for r in rows.collect()) == [("a", i, i) for i in range(25)] + [("b", i, -i) for i in range(12)]
    calls.clear()
    assert exports.generated_pool(spark, root, {"a": 28, "b": 12}, 10, make).count() == 40 and calls == [("a", 20)]


def test_result_documents_hold_config_ranking_and_notes(spark, tmp_path):
    ranking = spark.createDataFrame([("x", 0.5, 2), ("y", 0.9, 1)], "name string, coverage double, rank int")
    exports.write_report(spark, str(tmp_path / "r"), {"n": 5, "selector": "herding"}, ranking, ["as planned"])
    r = spark.read.json(str(tmp_path / "r")).first()
    assert r["config"].asDict() == {"n": "5", "selector": "herding"} and r["notes"] == ["as planned"] and [x["name"] for x in r["ranking"]] == ["y", "x"]
    exports.write_report(spark, str(tmp_path / "r"), {}, ranking.limit(0))
    assert spark.read.schema("notes array<string>, ranking array<struct<name:string>>").json(str(tmp_path / "r")).first() == ([], [])


def test_score_gates_and_udfs_of_images(spark):
    scores = spark.createDataFrame([(i, float(i)) for i in range(21)], "id long, score double")
    assert gates.score_gate(scores, "score", 0.05).where("keep").count() == 19
    assert gates.max_score_gate(scores, "score", 7.0).where("keep").count() == 8
    df = spark.createDataFrame([(1, [int(v) for v in drawn(1.5, size=32).astype(int).ravel()], 32, 32), (2, None, None, None)], "id long, px array<short>, height int, width int")
    got = {r["id"]: r["s"] for r in df.select("id", images.scorer(images.line_score)("px", "height", "width").alias("s")).collect()}
    assert got[1] == pytest.approx(images.line_score(drawn(1.5, size=32).astype(int)), rel=1e-9) and got[2] is None
    r = df.select(images.resized_udf(16)("px", "height", "width").alias("r")).collect()
    assert len(r[0]["r"]["px"]) == 256 and r[1]["r"]["px"] is None
    c = df.select(images.crop_udf("px", "height", "width").alias("r")).first()["r"]
    assert len(c["px"]) == c["height"] * c["width"]
