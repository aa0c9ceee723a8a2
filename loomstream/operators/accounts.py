"""What readers keep, follow and own: favourites, interests, devices, contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstream.operators.joins import conflict_anti_join, first_wins


def favourites(users: DataFrame, key: str, array: str, articles: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """(key, url_id, create_time, rank): the articles of each reader's favourites array<struct<url_id, create_time>>, newest first.

    Favourites without an article are left out, and a favourite set twice counts from its first time.
    """
    each = users.select(key, F.inline(array)).groupBy(key, "url_id").agg(F.min("create_time").alias("create_time"))
    kept = each.join(articles.select("url_id").distinct(), "url_id", "left_semi")
    kept = kept if skip is None else kept.join(skip.select("url_id").distinct(), "url_id", "left_anti")
    order = Window.partitionBy(key).orderBy(F.desc("create_time"), "url_id")
    return kept.withColumn("rank", F.row_number().over(order)).select(key, "url_id", "create_time", "rank")


def toggled(have: Column, item: Column, on: Column) -> Column:
    """An array with the item appended where `on` and it is not there yet, or without it."""
    have = F.coalesce(have, F.array().cast("array<string>"))
    added = F.when(F.array_contains(have, item), have).otherwise(F.concat(have, F.array(item)))
    return F.when(on, added).otherwise(F.array_remove(have, item))


def follow(interests: DataFrame, changes: DataFrame, group: str, key: str, kind: str, closure: DataFrame) -> DataFrame:
    """Interests after changes that follow or unfollow: a change replaces the reader's interests that conflict with it.

    Both have group, key, kind, source and create_time; a change of source 'TOMBSTONE' unfollows. Conflicts are equal
    keys with kinds one of which is the other's ancestor. Of several changes that conflict with each other the newest
    stays (ties by kind).
    """
    newest = first_wins(changes, [group, key], [F.desc("create_time"), F.asc(kind)])
    kept = conflict_anti_join(interests, newest, group, F.col(key), F.col(kind), closure)
    return kept.select(*interests.columns).unionByName(newest.select(*interests.columns))


def live_interests(interests: DataFrame, group: str, key: str, kind: str, closure: DataFrame) -> DataFrame:
    """Interests without tombstones and what they rule out."""
    dead = F.col("source") == "TOMBSTONE"
    return conflict_anti_join(interests.filter(~F.coalesce(dead, F.lit(False))), interests.filter(dead), group, F.col(key), F.col(kind), closure)


def devices(registrations: DataFrame, device: str = "device_id", time: str = "create_time") -> DataFrame:
    """One registration per device, the newest, with its beta flag."""
    return first_wins(registrations.filter(F.col(device).isNotNull()), [device], [F.desc(time), F.asc("user_id")])


def contacts(book: Column) -> Column:
    """array<string>: full names of an address book's JSON, first and last joined; those without both are left out."""
    parsed = F.from_json(book, "array<struct<firstName string, lastName string>>")
    names = F.transform(parsed, lambda c: F.trim(F.concat_ws(" ", c["firstName"], c["lastName"])))
    return F.array_distinct(F.filter(names, lambda n: n.contains(" ")))


def session_key(millis: Column, user: Column, salt: str) -> Column:
    """URL-safe base64 of millis/user/SHA-1 of the salted front: whoever has the salt can tell that the front is genuine."""
    front = F.concat_ws("/", millis.cast("string"), user)
    whole = F.concat_ws("/", front, F.sha1(F.concat(F.lit(salt), front)))
    return F.rtrim(F.translate(F.base64(F.encode(whole, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def session_user(key: Column, salt: str) -> Column:
    """The user of a genuine session key, else null."""
    text = F.try_to_binary(F.translate(key, "-_", "+/"), F.lit("base64")).cast("string")
    parts = F.split(text, "/", 3)
    front = F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    good = (F.size(parts) == 3) & (F.sha1(F.concat(F.lit(salt), front)) == F.get(parts, F.lit(2))) & F.get(parts, F.lit(0)).rlike("^[0-9]+$")
    return F.when(good, F.get(parts, F.lit(1)))


def clicked(notifications: DataFrame, clicks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notifications, log of actions): the first click of its own reader sets a notification's click_time once; each such click is an EMAIL_CLICK action.

    clicks: notification_id, user_id, time. Clicks of other readers, of unknown notifications and later ones change nothing.
    """
    mine = clicks.join(notifications.select(F.col("id").alias("notification_id"), "user_id", F.col("click_time").alias("__was"), "url_id"), ["notification_id", "user_id"])
    first = mine.filter("__was is null").groupBy(F.col("notification_id").alias("id")).agg(F.min("time").alias("__at"))
    changed = notifications.join(first, "id", "left").withColumn("click_time", F.coalesce("click_time", "__at")).drop("__at").select(*notifications.columns)
    log = mine.select("notification_id", "user_id", "url_id", F.lit("EMAIL_CLICK").alias("action_type"), F.col("time").alias("create_time"))
    return changed, log
