"""Imports, album updates, orders and licences: old tables and changes in, new tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a client may choose.
CHOICES = ("SELECTED", "REJECTED", "UNRATED")


def import_photos(photos: DataFrame, files: DataFrame) -> DataFrame:
    """photos(project, id, filename, path, size) after files(project, filename, path, size) were imported; new photos have a null id.

    A file is known if its project has a photo of its path or of its name: then
    the photo with the least id takes the file's path and size. Of several files
    that meet one photo, or share a name that is new, the last path stays. Two
    equi-joins, never an OR join. Null paths, names and projects match nothing.
    """
    by_path = photos.groupBy("project", "path").agg(F.min("id").alias("__p"))
    by_name = photos.groupBy("project", "filename").agg(F.min("id").alias("__n"))
    met = files.join(by_path, ["project", "path"], "left").join(by_name, ["project", "filename"], "left").withColumn("id", F.least("__p", "__n"))
    last = F.max_by(F.struct("path", "size"), F.struct("path", "size")).alias("__f")
    fresh = met.where("id is not null").groupBy("id").agg(last)
    kept = photos.join(fresh, "id", "left").select("project", "id", "filename", F.coalesce("__f.path", "path").alias("path"), F.coalesce("__f.size", "size").alias("size"))
    new = met.where("id is null").groupBy("project", "filename").agg(last)
    return kept.unionByName(new.select("project", F.lit(None).cast(photos.schema["id"].dataType).alias("id"), "filename", "__f.path", "__f.size"))


def upsert_projects(projects: DataFrame, scans: DataFrame) -> DataFrame:
    """projects(id, name, folder) after scans(name, folder): the project with the least id among those of a folder, whatever its case, takes the scan's name and spelling; other folders become projects with a null id.

    Of several scans of a folder the greatest (folder, name) stays. Null folders match nothing.
    """
    last = scans.groupBy(F.lower("folder").alias("__k")).agg(F.max(F.struct("folder", "name")).alias("__s"))
    first = projects.groupBy(F.lower("folder").alias("__k")).agg(F.min("id").alias("__id"))
    met = last.join(first, "__k", "left")
    kept = projects.join(met.where("__id is not null").select(F.col("__id").alias("id"), "__s"), "id", "left").select("id", F.coalesce("__s.name", "name").alias("name"), F.coalesce("__s.folder", "folder").alias("folder"))
    return kept.unionByName(met.where("__id is null").select(F.lit(None).cast(projects.schema["id"].dataType).alias("id"), "__s.name", "__s.folder"))


def pull_selections(entries: DataFrame, items: DataFrame) -> DataFrame:
    """entries(gallery, photo_id, remote_id, selection, note) with the choices of items(gallery, key, status, note).

    A key is the photo's number on the album server, else its own; keys that are
    no number are passed over, unknown choices count as UNRATED, a null note is
    empty. Of repeated keys the greatest choice and note stay.
    """
    status = F.upper(F.coalesce("status", F.lit("UNRATED")))
    clean = items.select("gallery", F.col("key").try_cast("long").alias("__key"), F.when(status.isin(*CHOICES), status).otherwise("UNRATED").alias("__s"), F.coalesce("note", F.lit("")).alias("__note"))
    latest = clean.where("__key is not null").groupBy("gallery", "__key").agg(F.max(F.struct("__s", "__note")).alias("__i"))
    joined = entries.withColumn("__key", F.coalesce("remote_id", "photo_id")).join(latest, ["gallery", "__key"], "left")
    return joined.select("gallery", "photo_id", "remote_id", F.coalesce("__i.__s", "selection").alias("selection"), F.coalesce("__i.__note", "note").alias("note"))


def submit(galleries: DataFrame, entries: DataFrame, submitted: Column, now: Column) -> DataFrame:
    """galleries(gallery, status, submitted_at, ...) with their selected count; where `submitted`, the status is SUBMITTED and the first time of submission stays."""
    counts = entries.groupBy("gallery").agg(F.count_if(F.col("selection") == "SELECTED").alias("__n"))
    joined = galleries.join(counts, "gallery", "left")
    at = F.when(submitted, F.coalesce("submitted_at", now)).otherwise(F.col("submitted_at"))
    return joined.withColumns({"selected": F.coalesce("__n", F.lit(0).cast("long")), "status": F.when(submitted, "SUBMITTED").otherwise(F.col("status")), "submitted_at": at}).drop("__n")


def keep_albums(entries: DataFrame, photos: DataFrame) -> DataFrame:
    """entries(photo_id, filename, remote_id, ...) that outlive photos(photo_id, filename): each remembers its photo's name and number."""
    names = photos.select("photo_id", F.col("filename").alias("__f"))
    return entries.join(names, "photo_id", "left").withColumns({"filename": F.coalesce(F.nullif("filename", F.lit("")), "__f"), "remote_id": F.coalesce("remote_id", "photo_id")}).drop("__f").select(*entries.columns)


def toggle_deblur(edits: DataFrame) -> DataFrame:
    """edits(unblur, sharpness, noise_reduction, ...): restoration goes off at 50 or more, else on at 70 with sharpness within 32 to 50 and noise reduction of 12 or more."""
    on = F.coalesce("unblur", F.lit(0.0)) < 50
    return edits.withColumns(
        {
            "unblur": F.when(on, 70.0).otherwise(0.0),
            "sharpness": F.when(on, F.least(F.lit(50.0), F.greatest("sharpness", F.lit(32.0)))).otherwise(F.col("sharpness")),
            "noise_reduction": F.when(on, F.greatest("noise_reduction", F.lit(12.0))).otherwise(F.col("noise_reduction")),
        }
    )


def recover_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that a crash left running or paused are cancelled."""
    return jobs.withColumn("status", F.when(F.col("status").isin("RUNNING", "PAUSED"), "CANCELLED").otherwise(F.col("status")))


def newly_paid(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders that payments(order_id) name and that are not PAID yet, each once however often its payment is told."""
    return orders.where("status <> 'PAID'").join(payments.select("order_id").distinct(), "order_id", "left_semi")


def commission_rows(paid: DataFrame, agents: DataFrame) -> DataFrame:
    """A commission of each paid order(order_id, agent, amount) with a known agent(agent, rate in percent) and an amount above 0."""
    earned = F.round((F.col("amount") * F.col("rate") / 100).cast("decimal(20,8)"), 2).cast("double")
    return paid.where("amount > 0").join(agents, "agent").select("order_id", "agent", F.col("amount").alias("sale"), "rate", earned.alias("earned"))


def coupon_use(coupons: DataFrame, paid: DataFrame) -> DataFrame:
    """coupons(coupon, used, ...) with one more use for each paid order that names them; counted before the join."""
    uses = paid.where("coupon <> ''").groupBy("coupon").agg(F.count(F.lit(1)).alias("__n"))
    return coupons.join(uses, "coupon", "left").withColumn("used", F.col("used") + F.coalesce("__n", F.lit(0))).drop("__n")


def activate(requests: DataFrame, seats: DataFrame) -> DataFrame:
    """requests(license, machine, at, id) with ok: a machine is let in if it is among the first seats(license, max_devices) machines that asked.

    Machines are reduced to their first request before they are ranked, and
    ranks beyond the most seats are cut early. Licences without a row have no seat.
    """
    first = requests.groupBy("license", "machine").agg(F.min(F.struct("at", "id")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("license").orderBy("first"))
    seated = first.withColumn("rank", rank).join(seats, "license").where("rank <= max_devices").select("license", "machine", F.lit(True).alias("__ok"))
    return requests.join(seated, ["license", "machine"], "left").withColumn("ok", F.coalesce("__ok", F.lit(False))).drop("__ok")


def extended(expires: Column, now: Column, days: Column) -> Column:
    """Seconds at which a licence ends that is extended by days: from its end, or from now if that is past. Null never ends."""
    return F.when(expires.isNotNull(), F.greatest(expires, now) + days * 86400)


def manifest(photos: DataFrame, *keys: str) -> DataFrame:
    """photos(keys, photo_id, filename, note, copied) -> keys, line: `[001] name | Note: text`. All are numbered, the copied are listed."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("photo_id"))
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" | Note: "), "note")).otherwise("")
    return photos.withColumn("__n", number).where("copied").select(*keys, F.format_string("[%03d] %s%s", F.col("__n"), F.col("filename"), note).alias("line"))


def retire_albums(albums: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """albums(status, submitted_at, expired_at, ...), times in seconds: those submitted `days` ago or earlier and not yet expired expire now. Null times never do."""
    due = (F.col("status") == "SUBMITTED") & F.col("expired_at").isNull() & (F.col("submitted_at") <= now - days * 86400)
    return albums.withColumn("expired_at", F.when(due, now).otherwise(F.col("expired_at")))
