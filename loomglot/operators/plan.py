"""Planning translation work and applying its results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import languages as L
from ..schema import CatalogError, value_key
from .select import latest

REASONS = ("do_not_translate", "plural", "empty_source", "target_do_not_translate", "status")
AUTO_MARK = "(auto-generated)"


def blank(kind: Column, text: Column) -> Column:
    return (kind == "empty") | ((kind == "singular") & (F.trim(F.coalesce(text, F.lit(""))) == ""))


def translation_plan(source: DataFrame, target: DataFrame, targets: list[str], statuses: tuple[str, ...] = ("new", "stale"), keep_status: bool = True) -> DataFrame:
    """``id, language, reason, text, source_comment, target_comment`` for every source entry and target language; a job where ``reason`` is null.

    An entry is skipped as not to be translated, as plural, for want of a source text, because the target is not to be translated, or by
    status, in this order. A missing target is new. Without ``keep_status`` a target's status follows its text. ``targets`` is a list given by hand.
    """
    wanted = source.select("id", "kind", "text", "status", F.col("comment").alias("source_comment"), F.explode(F.array(*map(F.lit, targets))).alias("language"))
    wanted = wanted.withColumn("lang", L.normalized(F.col("language")))
    have = latest(target.withColumn("lang", L.normalized(F.col("language"))), "lang", "id", newest=False)
    own = F.col("status") if keep_status else F.when(F.col("status") == "do_not_translate", F.col("status")).when(blank(F.col("kind"), F.col("text")), "new").otherwise("translated")
    have = have.select("lang", "id", own.alias("target_status"), F.col("comment").alias("target_comment"))
    rows = wanted.join(have, ["lang", "id"], "left").withColumn("target_status", F.coalesce("target_status", F.lit("new")))
    reason = (
        F.when(F.col("status") == "do_not_translate", REASONS[0])
        .when(F.col("kind") == "plural", REASONS[1])
        .when(blank(F.col("kind"), F.col("text")), REASONS[2])
        .when(F.col("target_status") == "do_not_translate", REASONS[3])
        .when(~F.col("target_status").isin(*statuses), REASONS[4])
    )
    return rows.select("id", "language", reason.alias("reason"), "text", "source_comment", "target_comment")


def run_jobs(jobs: DataFrame, backend: Callable[[str, str], str], workers: int = 4) -> DataFrame:
    """``id, language, text, error``: each job through ``backend(text, language)``, in ``workers`` tasks. A failing call gives an error and no text."""
    if workers < 1:
        raise CatalogError("invalid_concurrency", "there must be a worker at least")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                try:
                    rows.append((row.id, row.language, backend(row.text, row.language), None))
                except Exception as e:  # the backend's own failures are results
                    rows.append((row.id, row.language, None, str(e)))
            yield pd.DataFrame(rows, columns=["id", "language", "text", "error"])

    return jobs.filter("reason is null").select("id", "language", "text").repartition(workers).mapInPandas(run, "id string, language string, text string, error string")


def apply_results(target: DataFrame, results: DataFrame, plan: DataFrame | None = None, status: str = "needs_review") -> DataFrame:
    """The target with the results' texts: existing entries updated, missing ones added (with the plan's comment) at the end.

    All or nothing: a result with an error raises.
    """
    if "error" in results.columns:
        if failed := results.filter("error is not null").count():
            raise CatalogError("translation_failed", f"{failed} jobs failed", count=failed)
        results = results.drop("error")
    new = results.select(L.normalized(F.col("language")).alias("lang"), F.col("id").alias("__id"), F.col("text").alias("new_text"), F.col("language").alias("new_language"))
    rows = target.withColumn("lang", L.normalized(F.col("language")))
    joined = rows.join(new, (rows["id"] == new["__id"]) & (rows["lang"] == new["lang"]), "left").drop(new["lang"])
    hit = F.col("new_text").isNotNull()
    updated = joined
    for c, value in (("text", F.col("new_text")), ("kind", F.lit("singular")), ("status", F.lit(status)), ("forms", F.lit(None).cast("map<string,string>"))):
        if c in target.columns:
            updated = updated.withColumn(c, F.when(hit, value).otherwise(F.col(c)))
    updated = updated.select(target.columns)
    fresh = new.join(rows.select(F.col("id").alias("__id"), "lang").distinct(), ["__id", "lang"], "left_anti")
    if plan is not None:
        notes = plan.select(F.col("id").alias("__id"), L.normalized(F.col("language")).alias("lang"), F.coalesce("target_comment", "source_comment").alias("note"))
        fresh = fresh.join(notes, ["__id", "lang"], "left")
    homes = rows.groupBy("lang").agg(F.min("resource_ord").alias("home"), F.max("entry_ord").alias("last"))
    # A language that the target lacks becomes a resource of its own, behind the others.
    after = rows.agg((F.coalesce(F.max("resource_ord"), F.lit(-1)) + 1).alias("next"))  # one row
    places = fresh.select("lang").distinct().join(homes, "lang", "left_anti").withColumn("place", F.row_number().over(Window.orderBy("lang")) - 1).crossJoin(F.broadcast(after))  # languages alone
    fresh = fresh.join(homes, "lang", "left").join(places.select("lang", (F.col("place") + F.col("next")).alias("__own")), "lang", "left")
    values = {
        "resource_ord": F.coalesce("home", "__own"),
        "entry_ord": F.coalesce("last", F.lit(0)) + 1,
        "language": F.col("new_language"),
        "id": F.col("__id"),
        "kind": F.lit("singular"),
        "text": F.col("new_text"),
        "status": F.lit(status),
        "comment": F.col("note") if plan is not None else F.lit(None),
    }
    added = fresh.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema))
    return updated.unionByName(added)


def _allowed(remote: DataFrame, languages: list[str] | None) -> DataFrame:
    if languages is None:
        return remote
    allowed = F.lit(False)
    for x in languages:
        allowed = allowed | L.matches(F.col("language"), F.lit(x))
    return remote.filter(allowed)


def pull(local: DataFrame, remote: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """What a pulled catalog does to a local one: ``id, language, action, text, status, comment`` for each pulled entry.

    Keys that no local language has are ``unknown``; empty values are ``empty``; entries equal in value, status and comment are ``same``; the others
    ``update`` an entry or ``insert`` one for a new language. An entry is one of the same key and exactly the same language. ``languages`` keeps matching
    ones. Of an entry that is pulled repeatedly the last counts.
    """
    pulled = latest(_allowed(remote, languages), "language", "id").withColumn("vkey", value_key())
    mine = latest(local, "language", "id", newest=False)
    mine = mine.select("language", "id", value_key().alias("my_vkey"), F.col("status").alias("my_status"), F.coalesce("comment", F.lit("")).alias("my_comment"), F.lit(True).alias("here"))
    known = local.select("id").distinct().withColumn("known", F.lit(True))
    rows = pulled.join(known, "id", "left").join(mine, ["language", "id"], "left")
    same = (F.col("vkey") == F.col("my_vkey")) & F.col("status").eqNullSafe(F.col("my_status")) & (F.coalesce("comment", F.lit("")) == F.col("my_comment"))
    action = F.when(F.col("known").isNull(), "unknown").when(blank(F.col("kind"), F.col("text")), "empty").when(F.col("here").isNull(), "insert").when(same, "same").otherwise("update")
    return rows.select("id", "language", action.alias("action"), "text", "status", "comment")


def merge_pulled(local: DataFrame, remote: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """The local entries after a pull, with the column ``action`` (null where nothing was done): updated ones in their place with the pulled value,
    status and comment, inserted ones at the end of their language's first resource or of a new one. Keys that no local language has are
    left out."""
    remote = _allowed(remote, languages)
    taken = latest(remote.filter(~blank(F.col("kind"), F.col("text"))), "language", "id")
    names = ("kind", "text", "plural_id", "forms", "comment", "status")
    given = taken.select("language", "id", F.struct(*names).alias("__new"), value_key().alias("__vkey"))
    first = Window.partitionBy("language", "id").orderBy("resource_ord", "entry_ord")
    rows = local.withColumn("__n", F.row_number().over(first)).join(given, ["language", "id"], "left")
    differs = (F.col("__vkey") != value_key()) | ~F.col("status").eqNullSafe(F.col("__new.status")) | ~F.col("comment").eqNullSafe(F.col("__new.comment"))
    rows = rows.withColumn("action", F.when((F.col("__n") == 1) & F.col("__new").isNotNull() & differs, "update"))
    own = rows.select(*(F.when(F.col("action").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in local.columns), "action")
    homes = local.groupBy("language").agg(F.min("resource_ord").alias("__home"))
    after = local.agg((F.coalesce(F.max("resource_ord"), F.lit(-1)) + 1).alias("__next"), (F.coalesce(F.max("entry_ord"), F.lit(-1)) + 1).alias("__last"))
    fresh = taken.join(local.select("language", "id").distinct(), ["language", "id"], "left_anti").join(local.select("id").distinct(), "id", "left_semi")
    fresh = fresh.join(homes, "language", "left").crossJoin(F.broadcast(after))  # one row
    place = {"resource_ord": F.coalesce("__home", F.col("__next") + F.col("resource_ord")), "entry_ord": F.col("__last") + F.col("entry_ord")}
    return own.unionByName(fresh.select(*(place.get(c, F.col(c)).alias(c) for c in local.columns), F.lit("insert").alias("action")))


def pull_report(local: DataFrame, remote: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """One row: ``merged`` entries and ``skipped_new_keys``."""
    actions = pull(local, remote.filter(~blank(F.col("kind"), F.col("text"))), languages)
    lost = _allowed(remote, languages).join(local.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("skipped_new_keys"))
    return actions.agg(F.count_if(F.col("action").isin("insert", "update")).alias("merged")).crossJoin(F.broadcast(lost))  # one row


def annotation_targets(entries: DataFrame, source_language: str = "en") -> DataFrame:
    """``id, text, comment`` of keys that no entry has a comment by hand for. The text is the source language's, else the key; the comment is the
    first that is not empty. A generated comment says so in ``custom``."""
    auto = F.coalesce(F.try_element_at("custom", F.lit("is_comment_auto_generated")), F.lit("false")) == "true"
    has = F.coalesce(F.trim("comment"), F.lit("")) != ""
    order = F.struct("resource_ord", "entry_ord")
    text = F.when((L.normalized(F.col("language")) == L.normalized(F.lit(source_language))) & ~blank(F.col("kind"), F.col("text")), F.col("text"))
    rows = entries.select("id", (has & ~auto).alias("manual"), F.when(has, F.col("comment")).alias("c"), text.alias("t"), order.alias("o"))
    out = rows.groupBy("id").agg(F.bool_or("manual").alias("manual"), F.min_by("c", F.when(F.col("c").isNotNull(), F.col("o"))).alias("comment"), F.min_by("t", F.when(F.col("t").isNotNull(), F.col("o"))).alias("t"))
    return out.filter("not manual").select("id", F.coalesce("t", "id").alias("text"), "comment")


def apply_annotations(entries: DataFrame, notes: DataFrame) -> DataFrame:
    """Every entry of a key gets the key's new comment, marked as generated; a comment for no key raises."""
    if lost := notes.join(entries.select("id").distinct(), "id", "left_anti").count():
        raise CatalogError("unknown_key", f"{lost} comments are for keys that do not exist", count=lost)
    new = notes.select("id", F.col("comment").alias("__note"))
    rows = entries.join(new, "id", "left")
    kept = F.map_filter(F.coalesce("custom", F.create_map().cast("map<string,string>")), lambda k, _: k != "is_comment_auto_generated")
    marked = F.map_concat(kept, F.create_map(F.lit("is_comment_auto_generated"), F.lit("true")))
    hit = F.col("__note").isNotNull()
    return rows.withColumn("comment", F.coalesce("__note", "comment")).withColumn("custom", F.when(hit, marked).otherwise(F.col("custom"))).select(entries.columns)
