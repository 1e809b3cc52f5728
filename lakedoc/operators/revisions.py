"""Revisions of documents: leaves, winners, conflicts, and batches of writes.

A table of revisions has ``_id``, ``_rev`` (``generation-hash``), ``_deleted``, ``_rev_history`` (newest first, itself included)
and the columns of the documents. Nothing is updated in place: operators return the new table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REVS_LIMIT = 1000


def generation(rev) -> Column:
    rev = F.col(rev) if isinstance(rev, str) else rev
    return F.coalesce(F.regexp_extract(rev, r"^(\d+)-", 1).try_cast("int"), F.lit(0))


def rev_hash(rev) -> Column:
    rev = F.col(rev) if isinstance(rev, str) else rev
    return F.regexp_replace(rev, r"^\d+-", "")


def rank(rev="_rev") -> Column:
    """Revisions compare by generation as a number, then by hash as a string; deletion does not count."""
    return F.struct(generation(rev).alias("generation"), rev_hash(rev).alias("hash"))


def winners(leaves: DataFrame) -> DataFrame:
    """The leaf of each id with the highest rank; partial aggregation, whatever the number of branches."""
    row = F.struct(*[F.col(f"`{c}`") for c in leaves.columns])
    return leaves.groupBy("_id").agg(F.max_by(row, rank()).alias("w")).select("w.*")


def leaves_of(revisions: DataFrame) -> DataFrame:
    """Revisions that are no other revision's ancestor; equal ones once.

    One shuffle by id and no row per ancestor: the line of the winner takes most revisions away, and the few that are
    left of each id are held against each other's lines.
    """
    one = Window.partitionBy("_id")
    rows = revisions.repartition("_id").withColumn("_copy", F.row_number().over(Window.partitionBy("_id", "_rev").orderBy("_rev"))).where("_copy = 1")
    rows = rows.withColumn("_line", F.max_by("_rev_history", rank()).over(one)).where(~F.array_contains(F.slice("_line", 2, REVS_LIMIT), F.col("_rev")))
    older = F.slice("_rev_history", 2, REVS_LIMIT)
    rows = rows.withColumn("_lines", F.collect_list(F.when(F.size(older) > 0, older)).over(one))
    return rows.where(~F.exists("_lines", lambda line: F.array_contains(line, F.col("_rev")))).select(*[F.col(f"`{c}`") for c in revisions.columns])


def conflicts(leaves: DataFrame, deleted: bool | None = None) -> DataFrame:
    """``_id, winner, conflicts``: the other leaves of each id, highest first; ``deleted`` keeps only leaves of that state."""
    best = F.max_by(F.col("_rev"), rank())
    state = F.coalesce("_deleted", F.lit(False)) if "_deleted" in leaves.columns else F.lit(False)
    kept = F.lit(True) if deleted is None else state == deleted
    ranked = F.array_sort(F.collect_list(F.when(kept, F.struct(generation("_rev").alias("g"), F.col("_rev").alias("r")))))
    found = leaves.groupBy("_id").agg(best.alias("winner"), F.reverse(ranked)["r"].alias("all"))
    return found.select("_id", "winner", F.filter("all", lambda r: r != F.col("winner")).alias("conflicts"))


conflicts_of = conflicts


def revisions_field(history="_rev_history") -> Column:
    """``{start, ids}`` of a history."""
    h = F.col(history) if isinstance(history, str) else history
    return F.struct(generation(F.try_element_at(h, F.lit(1))).alias("start"), F.transform(h, rev_hash).alias("ids"))


def history_of(start, ids) -> Column:
    """The history that ``{start, ids}`` stands for."""
    return F.transform(ids, lambda x, i: F.concat_ws("-", (start - i).cast("string"), x))


def missing_revisions(requested: DataFrame, revisions: DataFrame) -> DataFrame:
    """``_id, _rev`` of ``requested`` that the table neither holds nor has in a history."""
    return lacking(requested.select("_id", "_rev").distinct(), revisions)


def lacking(rows: DataFrame, revisions: DataFrame) -> DataFrame:
    """Those of ``rows`` (_id, _rev, ...) whose revision stands in no history of the table; an anti-join by id that explodes nothing."""
    held = revisions.select(F.col("_id").alias("_held_id"), F.col("_rev_history").alias("_held"))
    return rows.join(held, (F.col("_id") == F.col("_held_id")) & F.array_contains("_held", F.col("_rev")), "left_anti")


def revs_diff(requested: DataFrame, revisions: DataFrame) -> DataFrame:
    """``_id, missing, possible_ancestors``: what to send, and known leaves of lower generation to send it against."""
    missing = missing_revisions(requested, revisions).groupBy("_id").agg(F.sort_array(F.collect_set("_rev")).alias("missing"), F.max(generation("_rev")).alias("g"))
    ours = leaves_of(revisions.join(missing.select("_id"), "_id", "left_semi")).groupBy("_id").agg(F.collect_set("_rev").alias("leaves"))
    lower = F.filter(F.coalesce("leaves", F.array().cast("array<string>")), lambda r: generation(r) < F.col("g"))
    return missing.join(ours, "_id", "left").select("_id", "missing", F.sort_array(lower).alias("possible_ancestors"))


def open_revs(leaves: DataFrame, doc_id: str, revs: Sequence[str] | None = None) -> DataFrame:
    """All leaves of a document, or those of the revisions named."""
    found = leaves.where(F.col("_id") == doc_id)
    return found if revs is None else found.where(F.col("_rev").isin(list(revs)))


def read_document(revisions: DataFrame, doc_id: str, *, rev: str | None = None, revs: bool = False, revs_info: bool = False, conflicts: bool = False, deleted_conflicts: bool = False, local_seq: bool = False) -> DataFrame:
    """One row: the winner of a document, or the revision named (also an ancestor that is still stored), with what is asked about its revisions.

    ``revs``: ``_revisions`` as ``{start, ids}``. ``revs_info``: each revision of its line with ``available``, ``deleted`` or ``missing``.
    ``conflicts``, ``deleted_conflicts``: the other leaves that live or do not, highest first. ``local_seq``: its sequence number.
    """
    held = revisions.where(F.col("_id") == doc_id)
    deleted = F.coalesce("_deleted", F.lit(False)) if "_deleted" in revisions.columns else F.lit(False)
    row = winners(held) if rev is None else held.where(F.col("_rev") == rev).limit(1)
    body = [F.col(f"`{c}`") for c in revisions.columns if c not in ("_rev_history", "_seq")]
    out = row.select(*body, *[F.col("_rev_history")] * (revs or revs_info), *[F.col("_seq").alias("_local_seq")] * local_seq)
    if revs:
        out = out.withColumn("_revisions", revisions_field())
    if revs_info:
        state = held.groupBy("_id").agg(F.map_from_entries(F.collect_set(F.struct("_rev", F.when(deleted, "deleted").otherwise("available").alias("state")))).alias("_state"))
        out = out.join(state, "_id").withColumn("_revs_info", F.transform("_rev_history", lambda r: F.struct(r.alias("rev"), F.coalesce(F.try_element_at("_state", r), F.lit("missing")).alias("status")))).drop("_state")
    for wanted, name, state in ((conflicts, "_conflicts", False), (deleted_conflicts, "_deleted_conflicts", True)):
        if wanted:
            out = out.join(conflicts_of(leaves_of(held), deleted=state).select("_id", F.col("conflicts").alias(name)), "_id", "left")
    return out.drop("_rev_history")


def put_local(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Results of writing local documents, which have no history: ``incoming`` with ``status`` and ``new_rev`` (``0-1``, ``0-2``, ...).

    A document is written if its revision is the current one, or if there is none and it names none.
    """
    held = current.select(F.col("_id").alias("_cid"), F.col("_rev").alias("_crev"))
    rows = incoming.join(held, F.col("_id") == F.col("_cid"), "left")
    count = F.coalesce(F.regexp_extract("_crev", r"^0-(\d+)$", 1).try_cast("long"), F.lit(0))
    rows = rows.withColumn("status", F.when(F.col("_rev").eqNullSafe(F.col("_crev")), "ok").otherwise("conflict"))
    return rows.withColumn("new_rev", F.when(F.col("status") == "ok", F.concat(F.lit("0-"), (count + 1).cast("string")))).drop("_cid", "_crev")


def delete_leaves(leaves: DataFrame, gone: DataFrame) -> DataFrame:
    """Results of deleting leaves, winners or not: rows of ``gone`` (_id, _rev) with ``status``, ``new_rev`` and ``_rev_history``, for ``apply_writes``.

    The tombstone follows the leaf it deletes, so other branches stay and the winner is found anew.
    """
    deleted = F.coalesce("_deleted", F.lit(False)) if "_deleted" in leaves.columns else F.lit(False)
    held = leaves.select("_id", "_rev", deleted.alias("_was"), "_rev_history", F.lit(True).alias("_found"))
    rows = gone.select("_id", "_rev").distinct().join(held, ["_id", "_rev"], "left").withColumn("_deleted", F.lit(True))
    rows = rows.withColumn("status", F.when(F.col("_found").isNull() | F.col("_was"), "conflict").otherwise("ok"))
    rows = rows.withColumn("new_rev", F.when(F.col("status") == "ok", next_rev(F.col("_rev"), [], F.col("_deleted"))))
    return rows.withColumn("_rev_history", F.when(F.col("status") == "ok", F.slice(F.concat(F.array("new_rev"), F.col("_rev_history")), 1, REVS_LIMIT))).drop("_was", "_found")


def next_rev(current: Column, body: Sequence[str], deleted: Column) -> Column:
    """One generation up, with a digest of the body, the state, and the revision it follows."""
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in body])) if body else F.lit("")
    return F.concat_ws("-", (generation(F.coalesce(current, F.lit("0-"))) + 1).cast("string"), F.md5(F.concat_ws("|", F.coalesce(current, F.lit("")), deleted.cast("string"), content)))


def bulk_docs(current: DataFrame, incoming: DataFrame, invalid: Column | None = None) -> DataFrame:
    """Results of writing a batch with optimistic concurrency: the rows of ``incoming`` with ``status`` and ``new_rev``.

    ``current``: winners. ``incoming``: ``_id``, ``_rev`` (what it replaces, null for a new document), ``pos`` (place in the batch),
    ``_deleted`` and the body. A document is written if its revision is the current one, or is null and there is none or a
    deleted one; of several in a batch the first. ``invalid``: a validation message or null. Failures do not stop others.
    """
    body = [c for c in incoming.columns if c not in ("_id", "_rev", "_deleted", "_rev_history", "pos")]
    first = F.row_number().over(Window.partitionBy("_id").orderBy("pos")) == 1
    gone = F.coalesce(F.col("_deleted"), F.lit(False)) if "_deleted" in current.columns else F.lit(False)
    held = current.select(F.col("_id").alias("_cid"), F.col("_rev").alias("_crev"), gone.alias("_cgone"), (F.col("_rev_history") if "_rev_history" in current.columns else F.array(F.col("_rev"))).alias("_chistory"))
    deleted = F.coalesce(F.col("_deleted"), F.lit(False)) if "_deleted" in incoming.columns else F.lit(False)
    rows = incoming.withColumn("_first", first).join(held, F.col("_id") == F.col("_cid"), "left").withColumn("_deleted", deleted)
    fits = (F.col("_rev").isNull() & (F.col("_cid").isNull() | F.col("_cgone"))) | F.coalesce(F.col("_rev") == F.col("_crev"), F.lit(False))
    status = F.when(F.col("_deleted") & F.col("_cid").isNull(), "not_found").when(~fits | ~F.col("_first"), "conflict")
    if invalid is not None:
        status = status.when(invalid.isNotNull(), "forbidden")
    rows = rows.withColumn("status", status.otherwise("ok"))
    rows = rows.withColumn("new_rev", F.when(F.col("status") == "ok", next_rev(F.col("_crev"), body, F.col("_deleted"))))
    history = F.slice(F.concat(F.array("new_rev"), F.coalesce("_chistory", F.array().cast("array<string>"))), 1, REVS_LIMIT)
    return rows.withColumn("_rev_history", F.when(F.col("status") == "ok", history)).drop("_cid", "_crev", "_cgone", "_chistory", "_first")


def apply_writes(revisions: DataFrame, results: DataFrame) -> DataFrame:
    """The table of leaves after the written rows of ``bulk_docs``."""
    written = results.where("status = 'ok'").withColumn("_rev", F.col("new_rev"))
    return leaves_of(revisions.unionByName(written.select(*[c for c in revisions.columns if c in written.columns]), allowMissingColumns=True))


def merge_revisions(leaves: DataFrame, given: DataFrame) -> DataFrame:
    """Writes with given revisions (replication): both branches live on as leaves unless one descends from the other."""
    return leaves_of(leaves.unionByName(given.select(*leaves.columns)))


def compact(revisions: DataFrame, limit: int = REVS_LIMIT) -> DataFrame:
    return revisions.withColumn("_rev_history", F.slice("_rev_history", 1, limit))


def purge(revisions: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the given ``_id, _rev``: an extension, as nothing but a rewrite removes rows."""
    return revisions.join(gone.select("_id", "_rev"), ["_id", "_rev"], "left_anti")


def copy_document(current: DataFrame, source: str, target: str) -> DataFrame:
    """A document under another id as a row to write."""
    return current.where(F.col("_id") == source).drop("_rev", "_rev_history", "_seq").withColumn("_id", F.lit(target)).withColumn("_rev", F.lit(None).cast("string"))


def with_new_ids(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_id", F.coalesce("_id", F.replace(F.uuid(), F.lit("-"), F.lit(""))) if "_id" in docs.columns else F.replace(F.uuid(), F.lit("-"), F.lit("")))


def first_failure(rules: Sequence[tuple[Column, str]]) -> Column:
    """The message of the first rule (condition that must hold, message) that fails; null if all hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), message) for ok, message in rules]) if rules else F.lit(None).cast("string")
