"""Album re-linking against a loop over all projects, and edge cases of whole culls and colour operators."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from shutterlake.functions import pixels as P
from shutterlake.operators import albums


def relinked_by_hand(album_rows, entry_rows, project_rows, photo_rows):
    """Every orphan against every project."""
    living = {p for p, _ in project_rows}
    first = {}
    for project, photo, name in photo_rows:
        if name:
            k = project, name.lower()
            first[k] = min(photo, first.get(k, photo))
    out = set()
    for gallery, project, folder in album_rows:
        if project in living:
            continue
        own = {}
        for g, photo, remote, name, choice, note in entry_rows:
            if g == gallery:
                k = remote if remote is not None else photo
                own[k] = max((name, choice, note), own.get(k, (name, choice, note)))
        best = None
        for p, home in project_rows:
            met = {k: e for k, e in own.items() if (p, e[0].lower()) in first}
            same = bool(folder) and folder.lower() == home.lower()
            if met and (same or len(met) >= max(1, math.floor(0.6 * len(own) + 0.999))):
                rank = (not same, -len(met), p)
                best = min((rank, p), best or (rank, p))
        if best:
            p, chosen = best[1], {}
            for k, (name, choice, note) in sorted(own.items()):
                if (p, name.lower()) in first:
                    chosen[first[p, name.lower()]] = (choice or "UNRATED", note or "", name, k)
            out |= {(gallery, p, photo, *c) for photo, c in chosen.items()}
    return out


def relinked(spark, album_rows, entry_rows, project_rows, photo_rows):
    df = albums.relink(
        spark.createDataFrame(album_rows, "gallery string, project long, folder string"),
        spark.createDataFrame(entry_rows, "gallery string, photo_id long, remote_id long, filename string, selection string, note string"),
        spark.createDataFrame(project_rows, "project long, folder string"),
        spark.createDataFrame(photo_rows, "project long, photo_id long, filename string"),
    )
    return {(r.gallery, r.project, r.photo_id, r.selection, r.note, r.filename, r.remote_id) for r in df.collect()}


def test_relink_of_random_albums(spark):
    """Names that stand in every project, shares around 60 %, folders, repeated names and entries without a remote id."""
    rng = random.Random(7)
    project_rows = [(p, rng.choice(["", f"/Home/{p}", "/shared"])) for p in range(12)]
    photo_rows, photo = [], 0
    for p, _ in project_rows:
        for name in [f"IMG_{i:04d}.JPG" for i in range(4)] + [f"dsc{rng.randint(0, 25)}.jpg" for _ in range(15)] + ["", None]:
            photo_rows.append((p, photo := photo + 1, name))
    album_rows, entry_rows = [], []
    for a in range(30):
        album_rows.append((f"g{a}", rng.choice([3, 100, 101]), rng.choice(["", "/HOME/5", "/Shared", "/gone"])))
        pool = [f"img_{i:04d}.jpg" for i in range(4)] + [f"DSC{i}.jpg" for i in range(26)] + ["lost.jpg"]
        for i in range(rng.choice([0, 1, 3, 5, 10])):
            entry_rows.append((f"g{a}", 1000 * a + i, rng.choice([None, 7000 + i, 7000]), rng.choice(pool), rng.choice(["SELECTED", "", "UNRATED"]), rng.choice(["", "n"])))
    got = relinked(spark, album_rows, entry_rows, project_rows, photo_rows)
    assert got == relinked_by_hand(album_rows, entry_rows, project_rows, photo_rows) and len(got) > 20


def test_relink_takes_sixty_percent_and_no_less(spark):
    photos = [(1, i, f"a{i}.jpg") for i in range(6)]
    entries = lambda n, held: [("g", i, None, f"a{i}.jpg" if i < held else f"x{i}.jpg", "SELECTED", "") for i in range(n)]
    for n, held, found in ((10, 6, 6), (10, 5, 0), (5, 3, 3), (5, 2, 0), (1, 1, 1), (1, 0, 0)):
        assert len(relinked(spark, [("g", 9, "")], entries(n, held), [(1, "")], photos)) == found, (n, held)


def test_relink_joins_rare_names_only(spark):
    """One name stands in all 400 projects: the albums meet their own project, not all."""
    projects = [(p, "") for p in range(400)]
    photos = [(p, 10 * p + i, n) for p in range(400) for i, n in enumerate(["IMG_0001.JPG", f"p{p}a.jpg", f"p{p}b.jpg"])]
    rows = [(f"g{a}", 1000 + a, "") for a in range(200)]
    entries = [(f"g{a}", i, i, n, "SELECTED", "") for a in range(200) for i, n in enumerate(["img_0001.jpg", f"p{a}a.jpg", f"p{a}b.jpg"])]
    got = relinked(spark, rows, entries, projects, photos)
    assert len(got) == 600 and all(g == f"g{p}" for g, p, *_ in got)


def test_relighting_without_any_mask(spark):
    df = spark.createDataFrame([("dark", 10.0, 10.0, 10.0, 0.0), ("dark", 12.0, 12.0, 12.0, 0.0), ("lit", 100.0, 100.0, 100.0, 0.0), ("all", 100.0, 100.0, 100.0, 1.0)], "image string, r double, g double, b double, mask double")
    got = {}
    for r in P.relit(df, "image").collect():
        got.setdefault(r.image, []).append(round(r.r, 3))
    assert sorted(got["dark"]) == [10.0, 12.0]  # a dark background is left
    assert got["lit"][0] > 100 and got["all"][0] >= 100
    assert P.relit(df.limit(0), "image").count() == 0


def test_skin_needs_its_share(spark):
    rows = [("s", 200.0, 150.0, 120.0)] * 3 + [("s", 0.0, 0.0, 255.0)] * 97 + [("n", 0.0, 0.0, 255.0)] * 100 + [("e", 200.0, 150.0, 120.0)] * 2 + [("e", 0.0, 0.0, 255.0)] * 98
    got = {r.image: r for r in P.skin_chroma(spark.createDataFrame(rows, "image string, r double, g double, b double"), "image").collect()}
    assert got["s"].has_skin and got["s"].coverage == 0.03
    assert not got["n"].has_skin and (got["n"].cr, got["n"].cb) == P.NO_SKIN
    assert not got["e"].has_skin  # exactly two percent is too little


def test_light_and_vignette_at_their_ends(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0), (255.0, 1.0, 1.0), (128.0, 0.0, 2.0), (128.0, 1.0, 0.0), (0.0, 1.0, -1.0), (255.0, 5.0, -1.0)], "y double, mask double, ev double")
    got = [r[0] for r in df.select(P.subject_light(F.col("y"), F.col("mask"), F.col("ev"))).collect()]
    assert got[0] == 2.0 and abs(got[1] - 1.35) < 1e-9 and got[2] == 1.0 and got[3] == 1.0
    assert abs(got[4] - (1 - 0.35 / 2)) < 1e-9 and got[5] == 0.5  # a mask above one counts as one
    ends = spark.createDataFrame([(0.0,), (0.55,), (1.0,)], "d double").select(P.vignette(F.col("d"), F.lit(1.0))).collect()
    assert [round(r[0], 6) for r in ends] == [1.0, 1.0, 0.82]
