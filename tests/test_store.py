"""Stored tables: buckets, commits, failed writes; budgets in rounds; session files."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import state, store
from siftwell.sources import session_files

PHOTOS = "session_id long, position int, id string, name string, type string, size long"


def photos(spark, rows):
    return spark.createDataFrame([(s, i, f"p{i}", "n", "t", size) for s, i, size in rows], PHOTOS)


def data_folders(path):
    return sorted(x for x in os.listdir(path) if x.startswith("data-"))


def test_a_change_writes_its_buckets_only(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), buckets=8)
    s.write("photos", photos(spark, [(k, 0, k) for k in range(40)]))
    (first,) = data_folders(tmp_path / "photos")
    s.upsert("photos", photos(spark, [(7, 0, 70), (7, 1, 71)]))
    (second,) = set(data_folders(tmp_path / "photos")) - {first}
    assert len([x for x in os.listdir(tmp_path / "photos" / second) if x.startswith("bucket=")]) == 1
    rows = {(r.session_id, r.position): r["size"] for r in s.read("photos").collect()}
    assert rows == {(k, 0): k for k in range(40) if k != 7} | {(7, 0): 70, (7, 1): 71}
    s.update("photos", spark.createDataFrame([(7,), (8,)], "session_id long"), lambda old: old.where("session_id <> 8"))
    assert s.read("photos").count() == 40 and s.read("photos").where("session_id = 8").isEmpty()
    s.update("photos", spark.createDataFrame([(k,) for k in range(40)], "session_id long"), lambda old: old.limit(0))
    assert s.read("photos").isEmpty()
    s.upsert("photos", photos(spark, [(1, 0, 5)]))
    s.clear("photos")
    assert s.read("photos").isEmpty() and s._commits("photos")


def test_a_failed_write_loses_nothing(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), buckets=4)
    s.write("photos", photos(spark, [(k, 0, k) for k in range(10)]))
    bad = photos(spark, [(3, 0, 1)]).withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        s.upsert("photos", bad)
    assert s.read("photos").count() == 10
    # A commit that was not finished doesn't count, and its number is used again.
    os.makedirs(tmp_path / "photos" / "commits" / "000000000001")
    assert s.read("photos").count() == 10
    s.upsert("photos", photos(spark, [(3, 0, 99)]))
    assert s.read("photos").where("session_id = 3").first()["size"] == 99 and s.read("photos").count() == 10


def test_what_cannot_be_read_is_an_error(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), buckets=2)
    assert s.read("preferences").isEmpty() and s.read("preferences").columns == ["session_id", "updated_at", "liked", "rejected"]
    s.write("photos", photos(spark, [(1, 0, 1)]))
    folder = tmp_path / "photos" / data_folders(tmp_path / "photos")[0]
    os.rename(folder, f"{folder}-gone")
    with pytest.raises(Exception, match="(?i)path"):
        s.read("photos").count()


def walked(files, budget):
    out, left = [], budget
    for _, size, photo in sorted(files):
        if size <= left:
            left -= size
            out.append(photo)
    return sorted(out)


@pytest.mark.parametrize("files_per_task", [4, 40, 10**6])
def test_budget_equals_the_walk(spark, files_per_task):
    """Sizes that fit, that never fit, equal picks, zeros, and falling sizes that stop a run again and again."""
    r = random.Random(6)
    sets = {1: [r.randint(0, 60) for _ in range(70)], 2: [x for i in range(15) for x in (1, 100 - i)], 3: [500] * 9, 4: [0] * 12 + [3], 5: [1] * 50, 6: [9]}
    sets = {s: [(i // 2 if s == 1 else i, size, 1000 * s + i) for i, size in enumerate(v)] for s, v in sets.items()}
    df = spark.createDataFrame([(s, photo, pick, size) for s, v in sets.items() for pick, size, photo in v], "session_id long, photo_id long, pick int, size long").repartition(3)
    got = {}
    for x in state.budgeted(df, F.lit(100), files_per_task=files_per_task).collect():
        got.setdefault(x.session_id, []).append(x.photo_id)
    assert {s: sorted(v) for s, v in got.items()} == {s: w for s, v in sets.items() if (w := walked(v, 100))}


def test_originals_by_key(spark):
    rows = spark.createDataFrame([("1:a", 5), ("1:b:c", 6), ("12:a", 7)], store.TABLES["originals"])
    assert {(r.photo_id, r["size"]) for r in store.originals_of(rows, 1).collect()} == {("a", 5), ("b:c", 6)}
    assert {(r.session_id, r.photo_id) for r in store.originals_by_session(rows).collect()} == {(1, "a"), (1, "b:c"), (12, "a")}
    kept = store.replaced_originals(rows, spark.createDataFrame([("1:a", 9), ("2:x", 1)], store.TABLES["originals"]))
    assert {(r.key, r["size"]) for r in kept.collect()} == {("1:a", 9), ("2:x", 1)}


def test_session_files(spark, tmp_path):
    photo = {"id": "p0000_ab", "name": "a.jpg", "type": "image/jpeg", "size": 7}
    whole = {"sessionId": "s1", "createdAt": "2024-05-06T07:08:09.123Z", "photos": [photo, photo | {"id": "p0001_cd"}], "finalized": True}
    files = {"a": json.dumps(whole, indent=2), "b": '{"sessionId": "s2", "photos": [', "c": "", "d": json.dumps({"sessionId": "s4", "photos": "none"}), "e": json.dumps({"sessionId": "s5", "photos": []}), "f": "[1, 2]", "g": json.dumps({"photos": []})}
    for name, text in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.json").write_text(text)
    rows = session_files.read_session_files(spark, str(tmp_path))
    got = {r.path.split("/")[-2]: r for r in rows.collect()}
    assert {k for k, r in got.items() if not r.broken} == {"a", "e"} and all(got[k].session_id is None and got[k].photos is None for k in got if got[k].broken)
    assert set(got) >= set("abdefg") and got["a"].finalized and not got["e"].finalized and got["a"].created_at.isoformat() == "2024-05-06T07:08:09.123000"
    assert [(r.session_id, r.position, r.id, r.size if isinstance(r.size, int) else r["size"]) for r in session_files.session_photos(rows).orderBy("position").collect()] == [("s1", 0, "p0000_ab", 7), ("s1", 1, "p0001_cd", 7)]
    assert sorted(r.session_id for r in session_files.sessions_of(rows).collect()) == ["s1", "s5"]


def test_answers(spark):
    stored = photos(spark, [(1, 0, 5), (1, 1, 6), (2, 0, 7)])
    asked = spark.createDataFrame([(1, "p1"), (1, "p9"), (3, "p0"), (None, "p0")], "session_id long, id string")
    assert {(r.session_id, r.id): (r.status, r["size"]) for r in store.looked_up(asked, stored).collect()} == {(1, "p1"): ("ok", 6), (1, "p9"): ("not found", None), (3, "p0"): ("not found", None), (None, "p0"): ("missing session id", None)}
    sessions = spark.createDataFrame([(1, 0, True, [], [], []), (4, 0, False, [], [], [])], store.TABLES["sessions"])
    got = store.session_answers(spark.createDataFrame([(1,), (4,), (5,), (None,)], "session_id long"), sessions, stored)
    assert {r.session_id: (r.status, r.total, r.finalized) for r in got.collect()} == {1: ("ok", 2, True), 4: ("ok", 0, False), 5: ("unknown session", None, None), None: ("missing session id", None, None)}
