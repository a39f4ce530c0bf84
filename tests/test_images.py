"""Image files and the array form of the pixel metrics."""

import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.operators import pixel_arrays
from siftwell.sources import images

from . import pixel_relations as pixels


def bmp(rgb):
    height, width = rgb.shape[:2]
    pad = -width * 3 % 4
    rows = b"".join(rgb[y, :, ::-1].tobytes() + b"\0" * pad for y in reversed(range(height)))
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def exif(order="<", time=b"2024:05:06 07:08:09\0", zone=b"+02:00\0", before=b"\xff\xe0\0\4ab"):
    entries, at = [], 8 + 2 + 12 + 4
    body = struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0x8769, 4, 1, at) + struct.pack(order + "I", 0)
    tags = [(0x9003, time), (0x9011, zone)]
    data_at, data = at + 2 + 12 * len(tags) + 4, b""
    for tag, value in tags:
        entries.append(struct.pack(order + "HHII", tag, 2, len(value), data_at + len(data)))
        data += value
    body += struct.pack(order + "H", len(tags)) + b"".join(entries) + struct.pack(order + "I", 0) + data
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + body
    block = b"Exif\0\0" + tiff
    return b"\xff\xd8" + before + b"\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xda"


def drawn(width, height, seed):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3), np.uint8)


def test_capture_times(spark):
    rows = [("little", exif()), ("big", exif(">")), ("utc", exif(zone=b"\0")), ("none", b"\xff\xd8\xff\xda"), ("no jpeg", b"GIF89a"), ("cut", exif()[:40]), ("empty", b""), ("null", None), ("bad", exif(time=b"yesterday\0"))]
    got = {r.path: r.taken_at_ms for r in images.capture_times(spark.createDataFrame(rows, "path string, content binary")).collect()}
    noon = 1714979289000
    assert got == {"little": noon - 7_200_000, "big": noon - 7_200_000, "utc": noon, **dict.fromkeys(("none", "no jpeg", "cut", "empty", "null", "bad"))}


def test_files_are_measured(spark, tmp_path):
    folder = tmp_path / "trip"
    folder.mkdir()
    small, large = drawn(40, 30, 1), drawn(1200, 700, 2)
    for name, data in (("a.bmp", bmp(small)), ("b.bmp", bmp(large)), ("c.jpg", b"no image"), ("d.jpg", exif())):
        (folder / name).write_bytes(data)
    rows = images.analyse(spark, str(tmp_path)).orderBy("upload_idx").collect()
    assert [(r.session_id, r.id, r.name, r.type) for r in rows] == [("trip", f"p{i:04d}", n, t) for i, (n, t) in enumerate((("a.bmp", "image/bmp"), ("b.bmp", "image/bmp"), ("c.jpg", "image/jpeg"), ("d.jpg", "image/jpeg")))]
    assert rows[0].error is rows[1].error is None and rows[2].error and rows[3].error and rows[3].taken_at_ms == 1714972089000
    assert rows[0].hash == pixel_arrays.measure_one(small.astype(float))[-2]
    sizes = {r.path.rsplit("/", 1)[-1]: (r.width, r.height) for r in images.pixels(spark, str(tmp_path)).collect()}
    assert sizes["a.bmp"] == (40, 30) and sizes["b.bmp"] == (512, 299)
    assert abs(rows[1].brightness - pixel_arrays.luma(large.astype(float)).mean()) < 0.5


@pytest.mark.parametrize(("width", "height"), [(48, 40), (17, 16), (33, 21), (5, 4), (3, 3), (1, 1), (2, 7)])
def test_array_form_equals_relational_form(spark, width, height):
    pics = {k: drawn(width, height, k) for k in range(3)}
    rows = [(k, width, height, p.tobytes()) for k, p in pics.items()]
    one = {r.photo_id: r for r in pixel_arrays.measure(spark.createDataFrame(rows, "photo_id long, width int, height int, data binary")).collect()}
    px = spark.createDataFrame([(k, width, height, x, y, *map(float, p[y, x])) for k, p in pics.items() for y in range(height) for x in range(width)], "photo_id long, width int, height int, x int, y int, r double, g double, b double").cache()
    parts = (pixels.luma_stats(px), pixels.focus_metrics(px), pixels.colorfulness(px), pixels.difference_hash(px), pixels.chroma_signature(px))
    for part in parts:
        for r in part.collect():
            for name, value in r.asDict().items():
                other = one[r.photo_id][name]
                assert other == value or abs(other - value) < 1e-6 * max(1, abs(value)), (name, other, value)
    px.unpersist()


def test_embedding_with_an_injected_model(spark):
    pics = spark.createDataFrame([(1, 40, 30, drawn(40, 30, 1).tobytes()), (2, 40, 30, b"short"), (3, 8, 8, bytes(192)), *((k, 20, 20, drawn(20, 20, k).tobytes()) for k in range(4, 12))], "photo_id long, width int, height int, data binary").coalesce(1)

    def load():
        def model(stack):
            if stack.shape[1:] != (3, 16, 16):
                raise ValueError("shape")
            if any(abs(x.mean() - mean7) < 1e-9 for x in stack):
                raise RuntimeError("seven")
            return stack.mean(axis=(2, 3))

        mean7 = pixel_arrays.model_input(drawn(20, 20, 7).astype(float), 16).mean()
        return model

    for batch_mb in (32, 0.01, 0.03):
        got = {r.photo_id: r for r in pixel_arrays.embed(pics, load, side=16, batch_mb=batch_mb).collect()}
        assert len(got) == 11 and abs(sum(x * x for x in got[1].embedding) - 1) < 1e-9 and got[1].error is None
        assert got[2].embedding is None and got[2].error and got[3].embedding == [0, 0, 0]
        assert got[7].error == "seven" and all(got[k].error is None for k in got if k not in (2, 7))
        want = pixel_arrays.model_input(drawn(20, 20, 5).astype(float), 16).mean(axis=(1, 2)).astype(float)
        assert np.allclose(got[5].embedding, want / np.sqrt((want * want).sum()))
    assert all("shape" in r.error for r in pixel_arrays.embed(pics.where("photo_id <> 2"), load, side=8).collect())


def test_models_of_another_shape_are_errors(spark):
    pics = spark.createDataFrame([(1, 8, 8, bytes(192)), (2, 8, 8, bytes(192))], "photo_id long, width int, height int, data binary")
    got = pixel_arrays.embed(pics, lambda: lambda stack: stack.mean(), side=8).collect()
    assert all(r.embedding is None and "shape" in r.error for r in got)


def test_heads_are_read_as_ranges(spark, tmp_path):
    """Partitions by bytes of heads; a file beyond the head is not read whole; a file that goes away is an error."""
    from siftwell.sources.headers import EXIF_BYTES, Files, PhotoHeaders

    (tmp_path / "trip").mkdir()
    (tmp_path / "trip" / "a.jpg").write_bytes(exif())
    (tmp_path / "trip" / "b.jpg").write_bytes(exif(before=b"\xff\xe2" + struct.pack(">H", 60000) + bytes(59998)) + bytes(3 * EXIF_BYTES))
    (tmp_path / "trip" / "_hidden").write_bytes(b"x")
    reader = PhotoHeaders({"path": str(tmp_path), "partition_mb": "0.00001"}).reader(None)
    parts = reader.partitions()
    assert [len(p.files) for p in parts] == [1, 1]
    assert [r[4] is not None for r in reader.read(Files([(str(tmp_path / "none.jpg"), 5)]))] == [True]
    for path in (str(tmp_path), f"file://{tmp_path}"):
        got = {r.name: r for r in images.header_files(spark, path, 0.00001).collect()}
        assert got.keys() == {"a.jpg", "b.jpg"} and all(r.taken_at_ms == 1714972089000 and r.session_id == "trip" and r.error is None for r in got.values())
        assert {r.path for r in got.values()} == {r.path for r in images.photo_files(spark, path).collect()}


def test_every_image_is_decoded_once(spark, tmp_path):
    (tmp_path / "trip").mkdir()
    (tmp_path / "trip" / "a.bmp").write_bytes(bmp(drawn(40, 30, 1)))
    plan = images.analyse(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan image") == 1 and "FileScan binaryFile" not in plan


def test_nothing_to_measure(spark):
    none = spark.createDataFrame([], "photo_id long, width int, height int, data binary")
    assert pixel_arrays.measure(none).count() == 0
    odd = spark.createDataFrame([(1, None, 3, b"abc"), (2, 1, 1, None)], none.schema)
    assert pixel_arrays.measure(odd).where(F.col("error").isNotNull()).count() == 2


def test_images_cross_to_python_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    got = images.generated_images(spark, spark.range(0, 4000, 1, 1)).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 4000 and max(r.size for r in got) < 10 << 20
