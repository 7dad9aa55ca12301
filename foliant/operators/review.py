"""What people do to documents: reviews, extensions, owners, types, dates, archiving, findings; with the events that record it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions.freshness import DAY
from foliant.operators.ingest import merge_people

ACTIONS = ("reviewed", "extended", "owner_assigned", "archived", "type_set", "effective_set")
RECORDED = ("reviewed", "extended", "owner_assigned", "archived")
FINDING_STATUSES = ("open", "resolved", "dismissed")


def _latest(action: str) -> tuple[Column, Column]:
    """(when, value) of a document's last change of a kind."""
    hit = F.col("action") == action
    return F.max(F.when(hit, F.col("at"))).alias(f"{action}_at"), F.max_by(F.when(hit, F.col("value")), F.when(hit, F.col("at"))).alias(f"{action}_value")


def apply(documents: DataFrame, people: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, people, new events) after a batch of changes (document_id, action, value, at).

    `reviewed` sets the time of the last review and drops a stated review date; `extended` states one, `value` days ahead; `owner_assigned` names a
    person, who is added if nobody has the name; `type_set` and `effective_set` (a time or null) set a field; `archived` puts a document away.
    The last change of a kind counts, and of a review and an extension the later one decides on the date. Changes of unknown documents and
    unknown actions are left out. Documents are in the newest schema. The id of an event follows from what it records, so a repeated batch adds the same ones.
    """
    known = changes.where(F.col("action").isin(*ACTIONS)).select("document_id", "action", F.col("value").cast("string").alias("value"), F.col("at").cast("long").alias("at"))
    known = known.where("document_id is not null and at is not null").join(documents.select("document_id"), "document_id", "left_semi")
    last = known.groupBy("document_id").agg(*(c for a in ACTIONS for c in _latest(a)), F.max("at").alias("changed_at"))
    names = known.where("action = 'owner_assigned'").select(F.col("value").alias("display_name"))
    everybody = merge_people(people, names)
    by_name = everybody.groupBy(F.trim("display_name").alias("name")).agg(F.min("person_id").alias("new_owner"))
    x = documents.join(last, "document_id", "left").withColumn("name", F.trim("owner_assigned_value")).join(by_name, "name", "left")
    reviewed, extended = F.col("reviewed_at"), F.col("extended_at")
    due = F.when(extended.isNotNull() & (reviewed.isNull() | (extended >= reviewed)), extended + F.col("extended_value").cast("long") * DAY).when(reviewed.isNull(), F.col("review_due_at"))
    out = x.withColumns({
        "last_reviewed_at": F.greatest("last_reviewed_at", reviewed), "review_due_at": due, "owner_person_id": F.coalesce("new_owner", "owner_person_id"), "doc_type": F.coalesce("type_set_value", "doc_type"),
        "effective_date": F.when(F.col("effective_set_at").isNotNull(), F.col("effective_set_value").cast("long")).otherwise(F.col("effective_date")),
        "status": F.when(F.col("archived_at").isNotNull(), "archived").otherwise(F.col("status")), "updated_at": F.greatest("updated_at", "changed_at"),
    })
    key = F.substring(F.sha2(F.concat_ws("|", "document_id", "action", F.col("at").cast("string"), F.coalesce("value", F.lit(""))), 256), 1, 26)
    events = known.where(F.col("action").isin(*RECORDED)).select(key.alias("id"), "document_id", F.lit(None).cast("string").alias("person_id"), "action", F.col("value").alias("note"), "at").distinct()
    return out.select(*documents.columns), everybody, events


def resolve_findings(findings: DataFrame, ids: list[str], status: str, now: int) -> DataFrame:
    """Findings with another status for some; the time is kept when they are resolved or dismissed and dropped when they are open again."""
    if status not in FINDING_STATUSES:
        raise ValueError(f"status {status!r} is none of {FINDING_STATUSES}")
    mine = F.col("id").isin(ids)
    when = F.lit(None if status == "open" else now).cast("long")
    return findings.withColumns({"status": F.when(mine, F.lit(status)).otherwise(F.col("status")), "resolved_at": F.when(mine, when).otherwise(F.col("resolved_at"))})


def lookup(table: DataFrame, key: str, value: str) -> DataFrame:
    """The row of a key, once; none for an unknown one. The comparison reaches the scan."""
    return table.where(F.col(key) == value).limit(1)
