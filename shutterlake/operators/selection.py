"""Filters, group winners, facets, joins and table-in table-out mutations of the photo catalog."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective() -> Column:
    """The user's choice, or the recommendation where the user made none."""
    return F.when(F.col("user_selection") != "UNRATED", F.col("user_selection")).otherwise(F.col("ai_recommendation"))


def photo_filter(category: str = "ALL", star_rating: int | None = None, scene: str | None = None) -> Column:
    """Row predicate of a gallery list; BEST and SIMILAR as lists need group_winner and similar_members besides."""
    keep = F.lit(True)
    if category == "CLIENT_SELECTED":
        keep &= F.upper("client_selection") == "SELECTED"
    elif category != "ALL":
        keep &= effective() == category
    if star_rating:
        keep &= F.col("star_rating") == star_rating
    if scene and scene != "ALL":
        keep &= F.col("scene") == scene
    return keep


def winner_rank() -> Column:
    """Smallest for the first by: user BEST, recommended BEST, score, id."""
    return F.struct((F.col("user_selection") != "BEST").alias("a"), (F.col("ai_recommendation") != "BEST").alias("b"), F.coalesce(-F.col("ai_score"), F.lit(float("inf"))).alias("c"), F.col("photo_id").alias("d"))


def group_winner(photos: DataFrame, *keys: str) -> DataFrame:
    """One row per group, all columns: the winner. An aggregate with partial results, so a hot group needs no sort."""
    row = F.struct(*[F.col(c) for c in photos.columns])
    best = photos.groupBy(*keys).agg(F.min_by(row, winner_rank()).alias("w"))
    return best.select("w.*")


def group_meta(photos: DataFrame, *keys: str) -> DataFrame:
    """Each row with its group's size, best id and best score. Best: first by effective BEST, then score, then id."""
    rank = F.struct((effective() != "BEST").alias("a"), (-F.col("ai_score")).alias("b"), F.col("photo_id").alias("c"))
    meta = photos.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), F.min_by(F.struct("photo_id", "ai_score"), rank).alias("w"))
    return photos.join(meta, list(keys)).select(*photos.columns, "group_size", F.col("w.photo_id").alias("best_id"), F.col("w.ai_score").alias("best_score"), (F.col("w.photo_id") == F.col("photo_id")).alias("is_best"))


def facets(photos: DataFrame, *keys: str) -> DataFrame:
    """Counts per category in one pass; a group counts once among the best."""
    mine = effective()
    unit = F.coalesce("group_id", F.col("photo_id").cast("string"))
    return photos.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct(F.when(mine == "BEST", unit)).alias("best"),
        *[F.count_if(mine == c).alias(c.lower()) for c in ("SELECTED", "REVIEW", "REJECT", "SIMILAR")],
        F.countDistinct("group_id").alias("groups"),
    )


def similar_members(photos: DataFrame, key: str = "group_id") -> DataFrame:
    """Rows of groups that hold a SIMILAR photo."""
    return photos.join(photos.where(effective() == "SIMILAR").select(key).distinct(), key, "left_semi")


def exists_flag(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """left with a flag whether right has the key: usable under OR and in CASE."""
    marks = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__hit", F.lit(True))
    return left.join(marks, key, "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__hit")


def not_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """SQL's NOT IN: nothing if right holds a null key; rows with a null key only if right is empty."""
    keys = right.select(F.col(key).alias("__k"))
    nulls = keys.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__k").isNull()).alias("nulls"))
    kept = left.join(keys.distinct(), F.col(key) == F.col("__k"), "left_anti")
    # One row of counts, of a fixed size.
    return kept.crossJoin(F.broadcast(nulls)).where((F.col("n") == 0) | (F.col("nulls") == 0) & F.col(key).isNotNull()).drop("n", "nulls")


def or_match(left: DataFrame, right: DataFrame, keys: dict[str, str], left_id: str, right_id: str) -> DataFrame:
    """Distinct pairs of ids whose rows agree on any key; empty and null keys agree with nothing. One equi-join per key, never an OR join.

    Pairs are not shuffled to become distinct: each side is one row per id with
    the set of its keys, and a pair comes from the first key that both agree on,
    by its least common value.
    """
    def side(rows: DataFrame, id_: str, names: Iterable[str], one: str) -> DataFrame:
        return rows.groupBy(F.col(id_).alias(one)).agg(*[F.collect_set(F.when(F.col(c) != "", F.col(c))).alias(f"__{one}{i}") for i, c in enumerate(names)])

    x, y = side(left, left_id, keys.keys(), "l"), side(right, right_id, keys.values(), "r")
    parts = []
    for i in range(len(keys)):
        both = x.withColumn("__k", F.explode(f"__l{i}")).join(y.withColumn("__k", F.explode(f"__r{i}")), "__k")
        first = (F.size(f"__l{i}") == 1) | (F.size(f"__r{i}") == 1) | (F.col("__k") == F.array_min(F.array_intersect(f"__l{i}", f"__r{i}")))
        for before in range(i):
            first &= ~F.arrays_overlap(f"__l{before}", f"__r{before}")
        parts.append(both.where(first).select("l", "r"))
    return reduce(DataFrame.unionByName, parts)


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """Pairs with |a - b| <= width. Right rows go to their bucket and the two beside it, so the join is an equi-join."""
    size = width + 1
    l = left.withColumn("__b", F.floor(F.col(a) / size))  # noqa: E741
    r = right.withColumn("__b", F.explode(F.array(*[F.floor(F.col(b) / size) + d for d in (-1, 0, 1)])))
    return l.join(r, "__b").where(F.abs(F.col(a) - F.col(b)) <= width).drop("__b")


def sort_order(name: str) -> list[Column]:
    """Sort keys of a gallery list: score, name, rating, similar (within groups), else id; ties by id."""
    by_score = [F.desc("ai_score"), F.col("photo_id")]
    orders = {"score": by_score, "name": [F.col("filename"), F.col("photo_id")], "rating": [F.desc("star_rating"), *by_score], "similar": [F.col("group_id"), effective() != "BEST", *by_score]}
    return orders.get(name, [F.col("photo_id")])


def file_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """left and right(id, name, width) -> base, left_id, right_id: files of one base name and one width. Of files of one base name the least (id, width) counts; null names match nothing."""
    base = F.regexp_replace("name", r"\.[^.]*$", "").alias("base")
    first = lambda d, side: d.groupBy(base).agg(F.min(F.struct("id", "width")).alias(side))
    both = first(left, "l").join(first(right, "r"), "base").where("l.width = r.width")
    return both.select("base", F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"))


# --- mutations --------------------------------------------------------------


def semi_update(rows: DataFrame, keys: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """column set to value in the rows whose key is among the keys."""
    flagged = exists_flag(rows, keys, key, "__in")
    return flagged.withColumn(column, F.when(F.col("__in"), F.lit(value)).otherwise(F.col(column))).drop("__in").select(*rows.columns)


def promote(photos: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen(group_id, photo_id) become the user's BEST; other BEST photos of their groups become SIMILAR and unrated. One choice per group: the smallest id."""
    pick = chosen.groupBy("group_id").agg(F.min("photo_id").alias("__pick"))
    j = photos.join(pick, "group_id", "left")
    mine, other = F.col("photo_id") == F.col("__pick"), F.col("__pick").isNotNull() & (F.col("photo_id") != F.col("__pick")) & (effective() == "BEST")
    return j.select(
        *[
            F.when(mine, "BEST").when(other, "UNRATED").otherwise(F.col(c)).alias(c) if c == "user_selection" else F.when(other, "SIMILAR").otherwise(F.col(c)).alias(c) if c == "ai_recommendation" else F.col(c)
            for c in photos.columns
        ]
    )


def reset_groups(photos: DataFrame) -> DataFrame:
    """In each group the photo with the best score becomes BEST if unrated; other unrated photos become SIMILAR."""
    top = photos.groupBy("group_id").agg(F.min_by("photo_id", F.struct(-F.col("ai_score"), F.col("photo_id"))).alias("__top"))
    j = photos.join(top, "group_id", "left")
    label = F.when(F.col("user_selection") != "UNRATED", F.col("ai_recommendation")).when(F.col("photo_id") == F.col("__top"), "BEST").otherwise("SIMILAR")
    return j.select(*[label.alias(c) if c == "ai_recommendation" else F.col(c) for c in photos.columns])


def recode(rows: DataFrame, columns: tuple[str, ...], words: dict[str, str]) -> DataFrame:
    """rows with the words of some columns replaced by others."""
    pairs = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return rows.withColumns({c: F.coalesce(F.try_element_at(pairs, F.col(c)), F.col(c)) for c in columns})


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """ON CONFLICT DO UPDATE: new rows replace old ones of the same key; columns that are null in new keep the old value. Keys are unique in new."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, key, "full_outer").select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns if c != key])


def last_write(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The latest row of each key, by an aggregate with partial results."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(at)).alias("r")).select(*keys, "r.*")
