"""Trees given as parent links, and membership through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.functions.text import strip
from facetlake.functions.paths import path_prefixes
from facetlake.session import lay_down

PATH = "array<string>"


def ancestor_paths(nodes: DataFrame, include_trashed: bool = False) -> DataFrame:
    """``key, path`` from root to node for every node whose ancestors all exist and live.

    ``nodes`` has ``key, parent, trashed``. Pointers are doubled: after r rounds a node knows its
    nearest 2^r ancestors, so a tree of any depth takes the logarithm of it in joins. Each round
    is checkpointed. Levels have no gaps: once a round brings no node to its root, the nodes that
    are left lie on or below a cycle or a missing or trashed node, and are never reached.
    """
    alive = nodes.select("key", "parent", "trashed")
    if not include_trashed:
        alive = alive.filter(live(F.col("trashed")))
    # ``above``: the next ancestor that the path does not hold yet; NULL at the root.
    known = lay_down(alive.select(
        "key", F.nullif(F.col("parent"), F.lit("")).alias("above"), F.array("key").alias("path")
    ))
    reached = known.filter(F.col("above").isNull()).select("key", "path")
    climbing = known.filter(F.col("above").isNotNull())
    while not climbing.isEmpty():
        upper = known.select(F.col("key").alias("above"), F.col("above").alias("next"),
                             F.col("path").alias("head"))
        stepped = lay_down(climbing.join(upper, "above").select(
            "key", F.col("next").alias("above"), F.concat("head", "path").alias("path")))
        arrived = stepped.filter(F.col("above").isNull()).select("key", "path")
        if arrived.isEmpty():
            break
        reached = lay_down(reached.unionByName(arrived))
        climbing = stepped.filter(F.col("above").isNotNull())
        known = reached.select("key", F.lit(None).cast("string").alias("above"), "path").unionByName(
            climbing)
    return reached


def collection_paths(membership: DataFrame, nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Paths of the live collections of every item: ``id, path``."""
    live = nodes.filter(~F.coalesce(F.col("trashed"), F.lit(False))).select("key")
    return (
        membership.select("id", "key")
        .join(live, "key", "left_semi")
        .join(closure, "key")
        .select("id", "path")
    )


def collection_facet_paths(
    item_paths: DataFrame, nodes: DataFrame, root: str
) -> DataFrame:
    """Distinct ``id, path, label`` below one root, every prefix included."""
    below = item_paths.filter((F.get("path", F.lit(0)) == root) & (F.size("path") > 1)).select(
        "id", F.slice("path", F.lit(2), F.size("path")).alias("below")
    )
    prefixes = below.select("id", F.explode(path_prefixes(F.col("below"))).alias("path"))
    names = nodes.select(
        F.col("key").alias("node"), strip(F.coalesce("name", F.lit(""))).alias("label")
    )
    return (
        prefixes.distinct()
        .withColumn("node", F.element_at("path", -1))
        .join(names, "node", "left")
        .select("id", "path", F.coalesce("label", F.lit("")).alias("label"))
    )


def in_collection(
    items: DataFrame, membership: DataFrame, nodes: DataFrame, closure: DataFrame, key: str,
    true_only: bool = True, check_subcollections: bool = True,
) -> DataFrame:
    """``id, member``: whether an item belongs to a collection or to one below it."""
    if check_subcollections:
        members = collection_paths(membership, nodes, closure).filter(
            F.array_contains("path", key)
        )
    else:
        live = nodes.filter(~F.coalesce(F.col("trashed"), F.lit(False)))
        members = membership.filter(F.col("key") == key).join(live, "key", "left_semi")
    flagged = members.select("id").distinct().withColumn("member", F.lit(True))
    out = items.select("id").join(flagged, "id", "left")
    return out if true_only else out.withColumn("member", F.coalesce("member", F.lit(False)))


def collection_dependencies(membership: DataFrame, closure_all: DataFrame) -> DataFrame:
    """Collections of an item and all their ancestors, trashed ones included."""
    return (
        membership.select("id", "key").join(closure_all, "key")
        .select("id", F.explode("path").alias("dep")).distinct()
    )


def live(trashed: Column) -> Column:
    """NULL means live."""
    return ~F.coalesce(trashed, F.lit(False))
