"""Golden rows, edge cases and invariants."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.functions import columns as C
from shutterlake.functions import images
from shutterlake.operators import faces, mutations, robust, rules, selection, sequences
from shutterlake.sources import tables
from shutterlake.streaming import limits


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names_and_numbers(spark):
    rows = [("IMG_1234_edited.JPG", "img_1234", 1234), ("Photo (2).jpg", "photo", None), ("a7.png", "a7", 7), ("DSC_00123_copy.nef", "dsc_00123", 123)]
    df = spark.createDataFrame([(r[0],) for r in rows], "f string").select(C.stem(F.col("f")), C.sequence_number(F.col("f")))
    assert [tuple(r) for r in df.collect()] == [r[1:] for r in rows]


def test_phone_secret_url_exif(spark):
    assert one(spark, C.phone_key(F.lit("+91 98765-43210"))) == "9876543210"
    assert one(spark, C.phone_key(F.lit("123"))) == ""
    assert one(spark, C.masked(F.lit("abcd1234wxyz"))) == "abcd…wxyz"
    assert one(spark, C.normal_url(F.lit("example.com/a/?q=1"))) == "https://example.com/a"
    assert one(spark, C.exif_time(F.lit("broken"))) is None


def test_vectors_guard_zero_and_unequal(spark):
    arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, C.cosine(arr([0, 0]), arr([1, 2]))) == 0.0
    assert one(spark, C.cosine(arr([1]), arr([1, 2]))) == 0.0
    assert one(spark, C.cosine(arr([1, 0]), arr([2, 0]))) == pytest.approx(1)
    assert one(spark, C.centred(arr([3, 3, 3]))) == [0.0, 0.0, 0.0]
    assert one(spark, C.hamming(F.lit(None).cast("long"), F.lit(1))) == 999


def test_money(spark):
    assert one(spark, C.discount(F.lit(999.0), F.lit(15), F.lit("INR"))) == 150
    assert one(spark, C.discount(F.lit(9.99), F.lit(15), F.lit("USD"))) == 1.5
    assert one(spark, C.commission(F.lit(10.05), F.lit(10))) == 1.01


CULL = {"faces": 0, "face_sharp": 0.0, "face_hires": -1.0, "brightness": -1.0, "sharpness": 50.0, "focus": -1.0, "mean": 120.0, "exposure": "GOOD", "eyes": "OPEN", "candid": False, "group_id": None, "is_best": None}


@pytest.mark.parametrize(
    "change,label,confidence",
    [
        ({}, "BEST", 95.0),
        ({"exposure": "UNDER_EXPOSED", "mean": 80.0}, "BEST", 90.0),
        ({"sharpness": 42.0}, "BEST", 95.0),
        ({"sharpness": 41.9}, "REVIEW", 70.0),
        ({"sharpness": 33.9}, "REJECT", 88.0),
        ({"sharpness": 29.9}, "REJECT", 95.0),
        ({"sharpness": 10.0, "focus": 60.0}, "BEST", 95.0),
        ({"faces": 1, "face_sharp": 48.0}, "BEST", 95.0),
        ({"faces": 1, "face_sharp": 47.9}, "REVIEW", 70.0),
        ({"faces": 1, "face_sharp": 40.0, "face_hires": 36.0}, "BEST", 95.0),
        ({"faces": 1, "face_sharp": 40.0, "face_hires": 24.0}, "REJECT", 95.0),
        ({"faces": 1, "face_sharp": 60.0, "brightness": 17.0, "mean": 29.0}, "REJECT", 88.0),
        ({"faces": 1, "face_sharp": 60.0, "brightness": 0.0, "mean": 29.0}, "BEST", 95.0),
        ({"faces": 1, "face_sharp": 60.0, "brightness": 44.0}, "REVIEW", 68.0),
        ({"faces": 1, "face_sharp": 60.0, "eyes": "CLOSED"}, "REVIEW", 72.0),
        ({"faces": 1, "face_sharp": 60.0, "eyes": "CLOSED", "candid": True}, "BEST", 95.0),
        ({"group_id": "Group 01", "is_best": False}, "SIMILAR", 92.0),
        ({"group_id": "Group 01", "is_best": True}, "BEST", 96.0),
        ({"group_id": "Group 01", "is_best": True, "sharpness": 40.0}, "REVIEW", 74.0),
    ],
)
def test_cull_branches(spark, change, label, confidence):
    values = {k: F.lit(v).cast("string" if k == "group_id" else "boolean" if k == "is_best" else "double" if isinstance(v, float) else "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "int") for k, v in (CULL | change).items()}
    assert tuple(one(spark, rules.cull(values))) == (label, confidence)


def test_not_in_with_null_keys(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,)], "k int")
    assert [r.k for r in selection.not_in(left, right, "k").collect()] == [2]
    assert selection.not_in(left, right.unionByName(spark.createDataFrame([(None,)], "k int")), "k").count() == 0
    assert selection.not_in(left, right.limit(0), "k").count() == 3


def test_winner_ties(spark):
    rows = [(2, "g", "UNRATED", "BEST", 5.0), (1, "g", "UNRATED", "BEST", 5.0), (3, "g", "BEST", "REJECT", 1.0), (4, "h", "REJECT", "REJECT", None)]
    df = spark.createDataFrame(rows, "photo_id long, group_id string, user_selection string, ai_recommendation string, ai_score double")
    assert {r.group_id: r.photo_id for r in selection.group_winner(df, "group_id").collect()} == {"g": 3, "h": 4}
    assert {r.group_id: r.photo_id for r in selection.group_winner(df.where("photo_id < 3"), "group_id").collect()} == {"g": 1}


def burst(spark, n, **columns):
    rows = [(1, i, columns.get("ts", lambda i: float(i))(i), i, f"IMG_{i:04d}.JPG", f"img_{i:04d}", columns.get("faces", lambda i: 1)(i), 0, [1.0, 0.0], [0.8, 0.6]) for i in range(n)]
    df = spark.createDataFrame(rows, "project int, id long, ts double, seq long, filename string, stem string, faces int, dhash long, hist array<double>, feature array<double>")
    return {r.id: r.anchor for r in sequences.burst_segments(df).collect()}


def test_bursts_are_runs_of_at_most_thirteen(spark):
    assert burst(spark, 14) == {i: 0 if i < 13 else 13 for i in range(14)}


def test_bursts_break_at_gaps_and_crowds(spark):
    assert burst(spark, 4, ts=lambda i: i * 9.0) == {i: i for i in range(4)}
    assert burst(spark, 2, faces=lambda i: 4 * i) == {0: 0, 1: 1}
    assert burst(spark, 3, ts=lambda i: None) == {0: 0, 1: 0, 2: 0}


def test_suppression_keeps_the_better_box(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 1.0, 1.0, 10.0, 10.0), (1, 3, 0.7, 50.0, 50.0, 10.0, 10.0)], "image int, id int, score double, x double, y double, w double, h double")
    assert sorted(r.id for r in sequences.suppress(df, "image").collect()) == [1, 3]


def limits_by_hand(rows, most, seconds):
    out, state = {}, {}
    for bucket, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        start, n = state.get(bucket, (None, 0))
        if start is None or t - start >= seconds:
            start, n = t, 0
        state[bucket] = (start, n + 1)
        out[i] = (start, n + 1, n + 1 <= most)
    return out


def test_fixed_window_batch_equals_stream_and_loop(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f"b{rng.integers(0, 3)}", i, int(t)) for i, t in enumerate(sorted(rng.integers(0, 500, 120)))]
    want = limits_by_hand(rows, 4, 60)
    df = spark.createDataFrame(rows, "bucket string, id long, t long")
    batch = {r.id: (r.window_start, r.hits, r.allowed) for r in sequences.fixed_window(df, "bucket", "t", 4, 60).collect()}
    assert batch == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limits.fixed_window_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 4, 60)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.id: (r.window_start, r.hits, r.allowed) for r in spark.table("limited").collect()} == want


def test_harmonize_leaves_singletons_and_locked_rows(spark):
    df = spark.createDataFrame([(1, "a", 10.0, False), (2, "a", 20.0, False), (3, "a", 90.0, True), (4, "b", 7.0, False), (5, None, 1.0, False), (6, None, 3.0, False)], "id int, scene string, t double, locked boolean")
    got = {r.id: r.t for r in robust.harmonize(df, ["scene"], ["t"], F.col("locked")).collect()}
    assert got == {1: 13.5, 2: 20.0, 3: 90.0, 4: 7.0, 5: 1.4, 6: 2.7}


def test_files_and_documents(spark, tmp_path):
    for name in ("a.JPG", ".hidden.jpg", "~$x.jpg", "notes.txt", "sub/b.nef"):
        p = tmp_path / "photos" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    assert sorted(r.filename for r in tables.photo_files(spark, str(tmp_path / "photos")).collect()) == ["a.JPG", "b.nef"]
    (tmp_path / "s.json").write_text(json.dumps({"gallery_uuid": "u", "items": {"7": {"status": "SELECTED", "note": "n", "updated_at": "t"}}}, indent=1))
    row = tables.selections(spark, str(tmp_path / "s.json")).first()
    assert row["items"]["7"].status == "SELECTED"


def test_pixels(spark):
    grey = bytes(range(72))
    df = spark.createDataFrame([(grey,), (None,)], "g binary")
    assert [r[0] for r in df.select(images.difference_hash(F.col("g"))).collect()] == [-1, None]
    assert bytes(df.select(images.with_exposure(F.col("g"), 0.0)).first()[0]) == grey
    lut = images.exposure_lut(1.0)
    assert (np.diff(lut.astype(int)) >= 0).all() and (lut[0], lut[10], lut[255]) == (0, 22, 255)  # 255 (1 - e^(-20/255)) / (1 - e^-2) = 22.2


def test_tone_and_blend_tables():
    assert images.tone_lut().tolist() == list(range(256))
    assert images.exposure_lut(-1.0)[[0, 101, 255]].tolist() == [0, 50, 127]
    up = images.tone_lut(shadows=50.0)
    assert up[0] == 0 and up[50] == 54 and up[100] == 100  # 50 + 0.5 ** 1.8 * 16
    assert images.tone_lut(blacks=-40.0)[[0, 30, 60]].tolist() == [0, 25, 60]  # 30 - 0.5 * 8.8
    assert images.tone_lut(contrast=10.0)[[0, 128, 228]].tolist() == [0, 128, 238]
    left, right = images.blend_weights(64, 16, first=True), images.blend_weights(64, 16, last=True)
    assert left[:48].tolist() == [1.0] * 48 and right[16:].tolist() == [1.0] * 48
    assert (left >= 0).all() and (left <= 1).all() and left[-1] == 0 == right[0]


def test_import_known_by_path_or_name(spark):
    old = spark.createDataFrame([(1, 10, "a.jpg", "/x/a.jpg", 5), (1, 11, "b.jpg", "/x/b.jpg", 6), (2, 12, "a.jpg", "/y/a.jpg", 7)], "project long, id long, filename string, path string, size long")
    new = spark.createDataFrame([(1, "a.jpg", "/moved/a.jpg", 50), (1, "new.jpg", "/x/new.jpg", 1), (1, "new.jpg", "/z/new.jpg", 2), (None, "a.jpg", "/x/a.jpg", 9)], "project long, filename string, path string, size long")
    got = sorted([tuple(r) for r in mutations.import_photos(old, new).collect()], key=repr)
    assert got == sorted([(1, 10, "a.jpg", "/moved/a.jpg", 50), (1, 11, "b.jpg", "/x/b.jpg", 6), (2, 12, "a.jpg", "/y/a.jpg", 7), (1, None, "new.jpg", "/z/new.jpg", 2), (None, None, "a.jpg", "/x/a.jpg", 9)], key=repr)


def test_pull_passes_over_bad_keys_and_unknown_choices(spark):
    entries = spark.createDataFrame([("g", 1, 7, "UNRATED", "old"), ("g", 2, None, "SELECTED", "old"), ("h", 1, None, "REJECTED", "old")], "gallery string, photo_id long, remote_id long, selection string, note string")
    items = spark.createDataFrame([("g", "7", "selected", None), ("g", "1", "rejected", "lost"), ("g", "2", "perhaps", "n"), ("h", "x", "SELECTED", "n")], "gallery string, key string, status string, note string")
    got = {(r.gallery, r.photo_id): (r.selection, r.note) for r in mutations.pull_selections(entries, items).collect()}
    assert got == {("g", 1): ("SELECTED", ""), ("g", 2): ("UNRATED", "n"), ("h", 1): ("REJECTED", "old")}


def test_payments_told_twice_count_once(spark):
    orders = spark.createDataFrame([(1, "CREATED", 5, 100.05, "C"), (2, "PAID", 5, 100.0, "C"), (3, "CREATED", 5, 0.0, "C"), (4, "CREATED", None, 10.0, "")], "order_id long, status string, agent long, amount double, coupon string")
    paid = mutations.newly_paid(orders, spark.createDataFrame([(1,), (1,), (2,), (3,), (4,)], "order_id long"))
    assert sorted(r.order_id for r in paid.collect()) == [1, 3, 4]
    rows = mutations.commission_rows(paid, spark.createDataFrame([(5, 10.0)], "agent long, rate double")).collect()
    assert [(r.order_id, r.earned) for r in rows] == [(1, 10.01)]
    used = mutations.coupon_use(spark.createDataFrame([("C", 4), ("D", 0)], "coupon string, used long"), paid)
    assert {r.coupon: r.used for r in used.collect()} == {"C": 6, "D": 0}


def test_seats_go_to_the_first_machines(spark):
    asks = spark.createDataFrame([("L", "a", 1, 1), ("L", "b", 2, 2), ("L", "a", 3, 3), ("L", "c", 4, 4), ("M", "a", 1, 5)], "license string, machine string, at long, id long")
    seats = spark.createDataFrame([("L", 2)], "license string, max_devices int")
    assert {r.id: r.ok for r in mutations.activate(asks, seats).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_manifest_numbers_all_and_lists_the_copied(spark):
    rows = spark.createDataFrame([("g", 3, "c.jpg", "crop", True), ("g", 1, "a.jpg", None, True), ("g", 2, "b.jpg", "", False)], "g string, photo_id long, filename string, note string, copied boolean")
    assert sorted(r.line for r in mutations.manifest(rows, "g").collect()) == ["[001] a.jpg", "[003] c.jpg | Note: crop"]


def test_small_faces_do_not_count(spark):
    rows = [(1, 1, 100.0, 40.0, 90.0, 0, False, False), (1, 2, 24.0, 99.0, 10.0, 0, False, False), (1, 3, 25.0, 50.0, 80.0, 1, False, False), (2, 1, 10.0, 30.0, 0.0, 0, True, False), (3, 1, 10.0, 30.0, 0.0, 0, False, False), (4, 1, 10.0, 30.0, 5.0, 3, False, False)]
    df = spark.createDataFrame(rows, "photo long, at long, area double, sharpness double, luma double, eyes int, smile boolean, large boolean")
    got = {r.photo: (r.faces, r.sharpness, r.luma, r.eyes, r.confidence) for r in faces.face_metrics(df).collect()}
    assert got == {1: (3, 50.0, 80.0, "PARTIAL", 0.80), 2: (1, 30.0, 0.0, "OPEN", 0.85), 3: (1, 30.0, 0.0, "CLOSED", 0.82), 4: (1, 30.0, 5.0, "OPEN", 0.92)}


def test_face_matches_equal_a_greedy_loop(spark):
    rng = np.random.default_rng(5)
    point = lambda n: [(p, int(k), float(x), float(y)) for p in range(30) for k, (x, y) in enumerate(rng.random((int(rng.integers(0, n)), 2)).round(2) / 2)]
    targets, donors = point(7), point(7)
    kind = "pair long, at long, x double, y double"
    got = sorted((r.pair, r.target, r.donor) for r in faces.match_faces(spark.createDataFrame(targets, kind), spark.createDataFrame(donors, kind)).collect())
    want, taken = [], set()
    for p, k, x, y in targets:
        near = min(((np.hypot(x - u, y - v), j) for q, j, u, v in donors if q == p and (p, j) not in taken), default=(9, 0))
        if near[0] < 0.12:
            taken.add((p, near[1]))
            want.append((p, k, near[1]))
    assert got == sorted(want) and len(want) > 20


def test_payment_notices_pass_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (1, 90)], "order_id long, s long").select("order_id", F.timestamp_seconds("s").alias("at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limits.payments_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("paid").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.order_id for r in spark.table("paid").collect()) == [1, 2]


def test_albums_expire_once_and_only_when_due(spark):
    day = 86400
    rows = [("a", "SUBMITTED", 1 * day, None), ("b", "SUBMITTED", 1 * day + 1, None), ("c", "SELECTING", 0, None), ("d", "SUBMITTED", 0, 5), ("e", "SUBMITTED", None, None)]
    df = spark.createDataFrame(rows, "gallery string, status string, submitted_at long, expired_at long")
    assert {r.gallery: r.expired_at for r in mutations.retire_albums(df, F.lit(8 * day)).collect()} == {"a": 8 * day, "b": None, "c": None, "d": 5, "e": None}


def test_projects_meet_their_folder_in_any_case(spark):
    old = spark.createDataFrame([(1, "one", "/A/x"), (2, "two", "/a/X"), (3, "three", "/b")], "id long, name string, folder string")
    new = spark.createDataFrame([("uno", "/a/x"), ("four", "/c")], "name string, folder string")
    got = sorted([tuple(r) for r in mutations.upsert_projects(old, new).collect()], key=repr)
    assert got == sorted([(1, "uno", "/a/x"), (2, "two", "/a/X"), (3, "three", "/b"), (None, "four", "/c")], key=repr)
