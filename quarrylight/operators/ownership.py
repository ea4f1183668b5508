"""Who to contact today: bounded succession walks, resolved once per employee."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.config import MAX_HOPS
from quarrylight.sources.catalog import Catalog, assets


def department_heads(catalog: Catalog) -> DataFrame:
    """department -> head_id; the lowest ID where a department names several."""
    return (
        catalog.employees.where("is_department_head")
        .groupBy("department")
        .agg(F.min("employee_id").alias("head_id"))
    )


def _people(catalog: Catalog) -> DataFrame:
    """Each person with the one pointer a walk follows from them (successor before manager)."""
    return catalog.employees.select(
        "employee_id", "full_name", "department", "status",
        F.coalesce("successor_id", "manager_id").alias("next_id"),
        F.when(F.col("successor_id").isNotNull(), "successor").otherwise("manager").alias("via"),
    )


def _step(name: str, status: str, person: str, via) -> F.Column:
    return F.struct(
        F.col(person).alias("employee_id"), F.col(name).alias("full_name"),
        F.col(status).alias("status"), via.alias("via"),
    )


def build_walks(catalog: Catalog) -> DataFrame:
    """employee_id -> resolved, contact, hops, path and reason of the walk starting there.

    At most three joins of the person table with itself. People whose walk is over carry a key
    nobody has (their own), so they spread over all tasks instead of meeting on one NULL key.
    The order of checks is depth limit, dead end, cycle.
    """
    people = _people(catalog)
    walk = people.select(
        "employee_id", "department", "status", F.lit(0).alias("hops"),
        F.array(_step("full_name", "status", "employee_id", F.lit("owner"))).alias("path"),
        F.col("employee_id").alias("cur_id"), F.col("status").alias("cur_status"),
        "next_id", "via",
    )
    walk = walk.withColumn("reason", F.lit(None).cast("string"))
    for hop in range(MAX_HOPS + 1):
        ended = (
            F.when(F.col("reason").isNotNull(), F.col("reason"))
            .when(
                F.col("cur_status") != "left",
                F.when(F.col("hops") == 0, "active_owner").otherwise("resolved_via_chain"),
            )
            .when(F.lit(hop == MAX_HOPS), "depth_limit")
            .when(F.col("next_id").isNull(), "dead_end")
            .when(
                F.exists("path", lambda p: p["employee_id"] == F.col("next_id")), "cycle"
            )
        )
        walk = walk.withColumn("reason", ended)
        if hop == MAX_HOPS:
            break
        walk = walk.withColumn(
            "key",
            F.when(F.col("reason").isNull(), F.col("next_id")).otherwise(
                F.concat(F.lit("ended "), F.col("employee_id"))
            ),
        )
        ahead = people.select(
            F.col("employee_id").alias("key"), F.col("full_name").alias("a_name"),
            F.col("status").alias("a_status"), F.col("next_id").alias("a_next"),
            F.col("via").alias("a_via"),
        )
        moved = F.col("reason").isNull() & F.col("a_status").isNotNull()
        walk = walk.join(ahead, "key", "left").select(
            "employee_id", "department", "status",
            F.when(moved, F.col("hops") + 1).otherwise(F.col("hops")).alias("hops"),
            F.when(
                moved, F.concat("path", F.array(_step("a_name", "a_status", "key", F.col("via"))))
            ).otherwise(F.col("path")).alias("path"),
            F.when(moved, F.col("key")).otherwise(F.col("cur_id")).alias("cur_id"),
            F.when(moved, F.col("a_status")).otherwise(F.col("cur_status")).alias("cur_status"),
            F.when(moved, F.col("a_next")).otherwise(F.col("next_id")).alias("next_id"),
            F.when(moved, F.col("a_via")).otherwise(F.col("via")).alias("via"),
            # A pointer to nobody is an inconsistency of the records, not a dead end.
            F.when(F.col("reason").isNull() & F.col("a_status").isNull(), "inconsistent")
            .otherwise(F.col("reason")).alias("reason"),
        )
    resolved = F.col("reason").isin("active_owner", "resolved_via_chain")
    # One head per department: the table has as many rows as the department enum has values.
    heads = F.broadcast(department_heads(catalog))
    return walk.join(heads, "department", "left").select(
        "employee_id", "department", "status", resolved.alias("resolved"),
        F.when(resolved, F.col("cur_id")).alias("resolved_owner_id"),
        F.when(~resolved & (F.col("reason") != "inconsistent"), F.col("head_id"))
        .alias("fallback_contact_id"),
        F.when(resolved, F.col("cur_id"))
        .when(F.col("reason") != "inconsistent", F.col("head_id")).alias("contact_id"),
        "hops", "path", "reason",
    )


def contacts(catalog: Catalog) -> DataFrame:
    """build_walks, written once per session."""
    return catalog.once("contacts", lambda: build_walks(catalog))


def resolve_owner(catalog: Catalog, requests: DataFrame | None = None) -> DataFrame:
    """Every asset (or the asked ones) with its walk. Unknown IDs come back as error rows.

    An owner who does not exist is an inconsistency of the records: no walk, INTERNAL when asked for.
    """
    owned = assets(catalog).select("asset_id", "owner_id")
    walks = contacts(catalog).withColumnRenamed("employee_id", "owner_id")
    answered = owned.join(walks, "owner_id", "left").select(
        "asset_id", F.col("owner_id").alias("original_owner_id"),
        F.coalesce("resolved", F.lit(False)).alias("resolved"),
        "resolved_owner_id", "hops", "path", "fallback_contact_id",
        F.coalesce("reason", F.lit("inconsistent")).alias("reason"),
    )
    if requests is None:
        return answered
    wrong_kind = ~F.col("asset_id").rlike("^(RPT|TBL|MET)-[0-9]{3,}$")
    return requests.join(answered, "asset_id", "left").withColumn(
        "error",
        F.when(wrong_kind, "INVALID_ARGUMENT")
        .when(F.col("reason").isNull(), "NOT_FOUND")
        .when(F.col("reason") == "inconsistent", "INTERNAL"),
    )


def succession_structures(catalog: Catalog) -> DataFrame:
    """Departed employees counted by the shape of their walk: reason, hops, links followed."""
    shape = F.array_join(
        F.transform(F.slice("path", 2, MAX_HOPS), lambda p: p["via"]), ">"
    )
    return (
        contacts(catalog).where("status = 'left'")
        .groupBy("reason", F.col("hops").cast("bigint").alias("hops"), shape.alias("vias"))
        .agg(F.count("*").alias("people"))
    )
