"""Albums over their life: created, moved, re-linked to a shoot that came back, shown on the board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.operators.selection import band_join

#: Share of an album's names that a shoot must hold to take it over.
RELINK_SHARE = 0.6


def create_albums(photos: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """photos(project, photo_id, filename, rejected), requests(project, gallery, days) -> one row per entry: gallery, project, photo_id, filename, remote_id, selection, note, total, expires_at.

    An album takes the photos that are not rejected, and all if each is. It
    expires days after now (seconds), never where days is null or below one. A
    project without photos gets no album; photos of a null project none.
    """
    size = photos.groupBy("project").agg(F.count(F.lit(1)).alias("__all"), F.count_if(~F.col("rejected")).alias("__good"))
    total = F.when(F.col("__good") > 0, F.col("__good")).otherwise(F.col("__all"))
    album = requests.join(size, "project").select("project", "gallery", "__good", total.alias("total"), F.when(F.col("days") > 0, now + F.col("days") * 86400).alias("expires_at"))
    entries = photos.join(album, "project").where(~F.col("rejected") | (F.col("__good") == 0))
    return entries.select("gallery", "project", "photo_id", F.coalesce("filename", F.lit("")).alias("filename"), F.col("photo_id").alias("remote_id"), F.lit("UNRATED").alias("selection"), F.lit("").alias("note"), "total", "expires_at")


def moved_albums(albums: DataFrame, old_addresses: tuple[str, ...], message: str) -> DataFrame:
    """albums(url, status, hosting_status, hosting_error, ...): open albums at an old address (LIKE patterns) must be uploaded again, with this message; told once."""
    there = F.lit(False)
    for pattern in old_addresses:
        there |= F.col("url").like(pattern)
    due = F.coalesce(there, F.lit(False)) & (F.coalesce("status", F.lit("ACTIVE")) != "SUBMITTED") & ~F.coalesce("hosting_error", F.lit("")).startswith(message)
    return albums.withColumns({"hosting_status": F.when(due, "FAILED").otherwise(F.col("hosting_status")), "hosting_error": F.when(due, message).otherwise(F.col("hosting_error"))})


def relink(albums: DataFrame, entries: DataFrame, projects: DataFrame, photos: DataFrame) -> DataFrame:
    """Entries of albums whose project is gone, under a project that holds their photos: gallery, project, photo_id, selection, note, filename, remote_id.

    albums(gallery, project, folder), entries(gallery, photo_id, remote_id,
    filename, selection, note), projects(project, folder), photos(project,
    photo_id, filename). Names meet without regard to case; of photos of one
    name the least id counts. A project takes an album if it holds a name of it
    and lies in the same folder, or holds RELINK_SHARE of the names. Of several
    that do, one in the same folder goes first, then the most names, then the
    least project. Entries without a photo go; of entries that meet one photo
    the one with the greatest remote_id stays, of those of one number the
    greatest (filename, selection, note).
    """
    living = projects.select("project").distinct()
    orphans = albums.join(living, "project", "left_anti").select("gallery", F.lower("folder").alias("__f"))
    own = entries.join(orphans, "gallery").groupBy("gallery", "__f", F.coalesce("remote_id", "photo_id").alias("remote_id")).agg(F.max(F.struct("filename", "selection", "note")).alias("__e")).select("gallery", "__f", "remote_id", "__e.*")
    own = own.withColumn("__k", F.lower("filename"))
    sizes = own.groupBy("gallery").agg(F.count(F.lit(1)).alias("__n"))
    needed = F.greatest(F.lit(1), F.floor(RELINK_SHARE * F.col("__n") + 0.999))
    names = photos.where(F.coalesce("filename", F.lit("")) != "").groupBy("project", F.lower("filename").alias("__k")).agg(F.min("photo_id").alias("__new"))
    # A project that holds `needed` of n entries holds one of any n - needed + 1: of those with the rarest names. Names that every camera gives meet few projects so.
    often = names.groupBy("__k").agg(F.count(F.lit(1)).alias("__often"))
    rare = F.row_number().over(Window.partitionBy("gallery").orderBy(F.coalesce("__often", F.lit(0)), "__k", "remote_id"))
    ranked = own.join(often, "__k", "left").withColumn("__rank", rare).join(sizes, "gallery")
    by_name = ranked.where(F.col("__often").isNotNull() & (F.col("__rank") <= F.col("__n") - needed + 1)).select("gallery", "__k").join(names.select("project", "__k"), "__k").select("gallery", "project")
    homes = projects.select("project", F.lower("folder").alias("__pf"))
    by_folder = orphans.where("__f != ''").join(homes, F.col("__f") == F.col("__pf")).select("gallery", "project")
    candidates = by_name.unionByName(by_folder).distinct()
    met = own.join(candidates, "gallery").join(names, ["project", "__k"])
    counted = met.groupBy("gallery", "project", "__f").agg(F.count(F.lit(1)).alias("__m")).join(sizes, "gallery").join(homes, "project")
    same = F.coalesce((F.col("__f") != "") & (F.col("__f") == F.col("__pf")), F.lit(False))
    fits = counted.where(same | (F.col("__m") >= needed))
    chosen = fits.groupBy("gallery").agg(F.min_by("project", F.struct(~same, -F.col("__m"), "project")).alias("project"))
    carried = F.struct(F.coalesce(F.nullif("selection", F.lit("")), F.lit("UNRATED")).alias("selection"), F.coalesce("note", F.lit("")).alias("note"), "filename", "remote_id")
    return met.join(chosen, ["gallery", "project"]).groupBy("gallery", "project", F.col("__new").alias("photo_id")).agg(F.max_by(carried, "remote_id").alias("r")).select("gallery", "project", "photo_id", "r.*")


def carried_choices(photos: DataFrame, relinked: DataFrame) -> DataFrame:
    """photos(project, photo_id, client_selection, ...) with the choices of relink(): an entry that is UNRATED and without a note changes nothing; of several albums the greatest (choice, note) counts."""
    told = relinked.where((F.col("selection") != "UNRATED") | (F.col("note") != "")).groupBy("project", "photo_id").agg(F.max(F.struct("selection", "note")).alias("__c"))
    joined = photos.join(told, ["project", "photo_id"], "left")
    return joined.withColumns({"client_selection": F.coalesce("__c.selection", "client_selection"), "client_note": F.coalesce("__c.note", "client_note")}).drop("__c")


def eye_donors(targets: DataFrame, photos: DataFrame, enough: int = 3, reach: int = 10, most: int = 8) -> DataFrame:
    """targets(photo, project, burst), photos(donor, project, burst, opened, score) -> photo, donor, same_burst, place, is_best.

    Donors of the same burst come first, open eyes before score; where they are
    fewer than `enough`, up to `most` of the numbers within `reach` follow, open
    eyes before nearness, those seen left out. The best donor is the first of
    the burst with open eyes, else the first. A burst has a dozen photos at
    most, so pairs within one are few.
    """
    burst = targets.where(F.col("burst").isNotNull()).join(photos.drop("project"), "burst").where("photo <> donor")
    of_photo = Window.partitionBy("photo")
    burst = burst.select("photo", "donor", "opened", F.lit(True).alias("same_burst"), F.row_number().over(of_photo.orderBy(F.desc("opened"), F.desc("score"), "donor")).alias("at"))
    served = burst.where(F.col("at") >= enough).select("photo").distinct()
    rest = targets.join(served, "photo", "left_anti").select("photo", F.col("project").alias("__p"))
    near = band_join(rest, photos.select("donor", "project", "opened"), "photo", "donor", reach).where("photo <> donor and project = __p")
    near = near.withColumn("at", F.row_number().over(of_photo.orderBy(F.desc("opened"), F.abs(F.col("photo") - F.col("donor")), "donor"))).where(F.col("at") <= most)
    fresh = near.join(burst.select("photo", "donor"), ["photo", "donor"], "left_anti").select("photo", "donor", "opened", F.lit(False).alias("same_burst"), "at")
    both = burst.unionByName(fresh).withColumn("place", F.row_number().over(of_photo.orderBy(F.desc("same_burst"), "at")))
    best = F.coalesce(F.min(F.when(F.col("same_burst") & F.col("opened"), F.col("place"))).over(of_photo), F.lit(1))
    return both.select("photo", "donor", "same_burst", "place", (F.col("place") == best).alias("is_best"))


def album_board(albums: DataFrame, photos: DataFrame, selections: DataFrame, keep_days: int = 7) -> DataFrame:
    """albums(gallery, title, client, created_at), photos(gallery, size), selections(gallery, status, submitted_at, updated_at, selected) -> one row per album with what the board shows.

    Missing titles, clients, states and times have the board's words. clean_on:
    the day on which a submitted album is cleaned. Photos are counted and added
    up before the join.
    """
    held = photos.groupBy("gallery").agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__size"))
    rows = albums.join(held, "gallery", "left").join(selections, "gallery", "left")
    clean = F.when((F.col("status") == "SUBMITTED") & F.col("submitted_at").isNotNull(), F.date_format(F.col("submitted_at") + F.make_dt_interval(F.lit(keep_days)), "dd MMM yyyy"))
    return rows.select(
        "gallery",
        F.coalesce("title", F.lit("Untitled Shoot")).alias("title"),
        F.coalesce("client", F.lit("Client")).alias("client"),
        F.coalesce("__n", F.lit(0).cast("long")).alias("total"),
        F.coalesce("selected", F.lit(0).cast("long")).alias("selected"),
        F.coalesce("status", F.lit("SELECTING")).alias("status"),
        F.coalesce("updated_at", "created_at", F.lit("Recently")).alias("updated_at"),
        clean.alias("clean_on"),
        F.coalesce("__size", F.lit(0).cast("long")).alias("size"),
    )


def with_edits(photos: DataFrame, edits: DataFrame, resets: DataFrame) -> DataFrame:
    """photos(photo_id, params, manual_override, is_edited, ...) after edits(photo_id, at, params), the latest of each photo, and resets(photo_id): a reset goes back to the original, and wins."""
    last = edits.groupBy("photo_id").agg(F.max_by("params", F.struct("at", "params")).alias("__e"))
    gone = resets.select("photo_id").distinct().withColumn("__r", F.lit(True))
    joined = photos.join(last, "photo_id", "left").join(gone, "photo_id", "left")
    reset, edited = F.coalesce("__r", F.lit(False)), F.col("__e").isNotNull()
    flag = lambda c: F.when(reset, False).when(edited, True).otherwise(F.col(c))
    return joined.withColumns({"params": F.when(reset, "{}").otherwise(F.coalesce("__e", "params")), "manual_override": flag("manual_override"), "is_edited": flag("is_edited")}).drop("__e", "__r")


def gallery_documents(albums: DataFrame, photos: DataFrame) -> DataFrame:
    """albums(gallery, title), photos(gallery, id, name) -> gallery, document: the album as JSON with its photos by id. One document is one row, so an album must fit in a task."""
    held = photos.groupBy("gallery").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("photos"))
    rows = albums.join(held, "gallery", "left")
    empty = F.array().cast("array<struct<id:bigint,name:string>>")
    return rows.select("gallery", F.to_json(F.struct("title", F.coalesce("photos", empty).alias("photos")), {"ignoreNullFields": "false"}).alias("document"))
