"""Replication state and topology as transformations of metadata tables.

Tables are as large as a cluster's metadata: one row for a replica, partition or node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import TP

MAX_REPLICAS = 8


def commit_mark(replicas: DataFrame) -> DataFrame:
    """High-water mark of each partition: the least position of followers in the in-sync set that have reported one."""
    tracked = replicas.where("in_isr and not is_leader and last_lsn > 0")
    return tracked.groupBy(*TP).agg(F.min("last_lsn").alias("high_water_mark"))


def required_acks(asked: Column, rf: Column, isr: Column) -> Column:
    """Followers that must have a message: 0 is all in sync, 255 a majority, else the number itself."""
    peers = F.least(rf, isr) - 1
    return F.when(asked == 0, peers).when(asked == 255, F.floor(peers / 2) + 1).otherwise(asked).cast("int")


def confirmed(lsns: Column, needed: Column, seq: Column, mode: str = "least") -> Column:
    """Whether ``needed`` followers have ``seq``; more than there are counts as yes and none as no.

    ``least``: the ``needed`` positions furthest behind must all have reached it. ``any``: any ``needed`` of them.
    """
    ordered = F.sort_array(lsns, asc=mode == "least")
    reached = F.forall(F.slice(ordered, F.lit(1), needed), lambda x: x >= seq)
    return F.when(needed > F.size(lsns), True).when(needed == 0, False).otherwise(reached)


def insufficient_replicas(acks: Column, rf: Column, isr: Column) -> Column:
    return (acks > 200) | (acks + 1 > rf) | (acks + 1 > isr)


def join_isr(isr: DataFrame, requests: DataFrame, marks: DataFrame) -> DataFrame:
    """In-sync sets after followers have asked from ``seq``: one that asks beyond the last message is in sync."""
    ahead = requests.join(marks.select(*TP, "high_water_mark"), TP).where("seq > high_water_mark").select(*TP, "node_id")
    return isr.select(*TP, "node_id").unionByName(ahead).distinct()


def leave_isr(isr: DataFrame, gone: DataFrame) -> DataFrame:
    return isr.join(gone, "node_id", "left_anti")


def valid_isr(isr: DataFrame, replicas: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of in-sync sets that are replicas and available."""
    return isr.join(replicas.select(*TP, "node_id"), [*TP, "node_id"], "left_semi").join(nodes.where("available").select(F.col("id").alias("node_id")), "node_id", "left_semi").select(*TP, "node_id")


def repair_isr(isr: DataFrame, replicas: DataFrame, nodes: DataFrame, leaders: DataFrame, enabled: DataFrame, self_id: int) -> DataFrame:
    """:func:`valid_isr`, with this node where it leads and is a replica; empty for a partition that isn't enabled."""
    own = leaders.where(F.col("leader") == self_id).join(replicas.where(F.col("node_id") == self_id).select(*TP), TP, "left_semi").select(*TP, F.lit(self_id).alias("node_id"))
    return valid_isr(isr, replicas, nodes).unionByName(own).distinct().join(enabled.where("enabled").select(*TP), TP, "left_semi")


def invariant_violations(partitions: DataFrame, replicas: DataFrame) -> DataFrame:
    """Broken invariants of each partition; ``partitions`` has ``leader`` (or null).

    The in-sync set is within the replica set and no larger, and the leader is in both.
    """
    sets = replicas.groupBy(*TP).agg(F.collect_set(F.when(F.col("is_replica"), F.col("node_id"))).alias("rs"), F.collect_set(F.when(F.col("in_isr"), F.col("node_id"))).alias("isr"))
    checks = {
        "isr_not_in_rs": F.size(F.array_except("isr", "rs")) > 0,
        "isr_larger_than_rs": F.size("isr") > F.size("rs"),
        "leader_not_in_rs": F.col("leader").isNotNull() & ~F.array_contains("rs", F.col("leader")),
        "leader_not_in_isr": F.col("leader").isNotNull() & ~F.array_contains("isr", F.col("leader")),
    }
    found = partitions.join(sets, TP)
    rows = F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()))))
    return found.select(*TP, rows.alias("violation"))


def choose_replicas(nodes: DataFrame, partitions: DataFrame) -> DataFrame:
    """The ``rf`` available nodes with the fewest replicas and leaderships for each partition, in one round for all.

    ``nodes`` has ``replica_for`` and ``leader_for``; the node list is as long as the cluster is large and is ranked once.
    """
    ranked = nodes.where("available").select(F.col("id").alias("node_id"), F.row_number().over(Window.orderBy("replica_for", "leader_for", "id")).alias("_rank"))
    wanted = partitions.select(*TP, F.explode(F.sequence(F.lit(1), F.col("rf"))).alias("_rank"))
    return wanted.join(ranked, "_rank").select(*TP, "node_id")


def shrink_replicas(replicas: DataFrame, rf: int) -> DataFrame:
    """Replica sets of at most ``rf`` nodes; the leader and then the lowest ids stay."""
    w = Window.partitionBy(*TP).orderBy(F.col("is_leader").desc(), "node_id")
    return replicas.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rf).drop("_n")


def elect_leaders(replicas: DataFrame, nodes: DataFrame, leaders: DataFrame) -> DataFrame:
    """The available candidate with the fewest leaderships, then replicas, then the lowest id.

    Candidates are the in-sync set, or all replicas where there is no leader or it is no replica.
    """
    known = leaders.join(replicas.select(*TP, F.col("node_id").alias("leader"), F.lit(True).alias("_known")), [*TP, "leader"], "left").select(*TP, F.coalesce("_known", F.lit(False)).alias("_known"))
    able = nodes.where("available").select(F.col("id").alias("node_id"), "leader_for", "replica_for")
    candidates = replicas.join(known, TP, "left").where(F.col("in_isr") | ~F.coalesce("_known", F.lit(False))).join(able, "node_id")
    return candidates.groupBy(*TP).agg(F.min_by("node_id", F.struct("leader_for", "replica_for", "node_id")).alias("leader"))


def update_kind(rs_changes: Column, leader_changes: Column) -> Column:
    """A round updates either replica sets or the leader of a partition; replica sets go first."""
    return F.when(rs_changes, "replicas").when(leader_changes, "leader").otherwise("none")


def diff_replicas(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """``keep``, ``drop`` or ``add`` of each node of the current or the wanted replica sets."""
    a = current.select(*TP, "node_id", F.lit(True).alias("_a"))
    b = wanted.select(*TP, "node_id", F.lit(True).alias("_b"))
    action = F.when(F.col("_a").isNull(), "add").when(F.col("_b").isNull(), "drop").otherwise("keep")
    return a.join(b, [*TP, "node_id"], "full_outer").select(*TP, "node_id", action.alias("action"))


def diff_topology(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """``create``, ``grow``, ``shrink``, ``same`` or ``disable`` of each topic (``name``, ``partitions``); none is ever deleted."""
    b = wanted.select("name", F.col("partitions").alias("_w"))
    action = F.when(F.col("partitions").isNull(), "create").when(F.col("_w").isNull(), "disable").when(F.col("_w") > F.col("partitions"), "grow").when(F.col("_w") < F.col("partitions"), "shrink").otherwise("same")
    return known.select("name", "partitions").join(b, "name", "full_outer").select("name", action.alias("action"), F.coalesce("_w", "partitions").cast("long").alias("partitions"))


def unavailable_nodes(known: DataFrame, update: DataFrame) -> DataFrame:
    """Nodes that an update doesn't name."""
    return known.join(update.select("id"), "id", "left_anti")


def routing(partitions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoint of each partition's leader, or of the lowest reachable node where it has none or that is unknown."""
    any_ = nodes.where("available and not blocked").agg(F.min_by("endpoint", "id").alias("_any"))
    found = partitions.join(nodes.select(F.col("id").alias("leader"), F.col("endpoint").alias("_leader")), "leader", "left")
    return found.join(F.broadcast(any_)).select(*TP, F.coalesce("_leader", "_any").alias("endpoint"))  # one row


def topology_prefix(partitions: DataFrame) -> DataFrame:
    """Number of partitions of each topic before the first missing id."""
    nth = F.row_number().over(Window.partitionBy("topic").orderBy("partition")) - 1
    return partitions.withColumn("_nth", nth).groupBy("topic").agg(F.count_if(F.col("_nth") == F.col("partition")).alias("partitions"))


def replica_list(ids: Column) -> Column:
    """At most eight ids as they come, then sorted and without repeats."""
    return F.array_sort(F.array_distinct(F.slice(ids, 1, MAX_REPLICAS)))


def isr_list(ids: Column) -> Column:
    return F.array_sort(F.slice(ids, 1, MAX_REPLICAS))


def parse_ids(text: Column) -> Column:
    """Ids of a comma-separated list in its order; entries that aren't digits alone or no number from 1 to 65535 are none."""
    numbers = F.transform(F.split(text, ","), lambda x: F.when(F.rlike(x, F.lit(r"^[0-9]+\z")), x.try_cast("int")))
    return F.filter(numbers, lambda x: x.isNotNull() & (x > 0) & (x <= 65535))


def valid_leader(replicas: Column, leader: Column) -> Column:
    return F.when(F.array_contains(replicas, leader), leader)


def replication_source(enabled: Column, leader: Column, leader_available: Column, replicas: Column, self_id: Column) -> Column:
    """The leader to copy from: of an enabled partition, another available node, and this one is a replica."""
    return F.when(enabled & (leader != self_id) & leader_available & F.array_contains(replicas, self_id), leader)


def dirty_partitions(isr: DataFrame, leaders: DataFrame, gone: DataFrame, self_id: int) -> DataFrame:
    """Partitions led by this node whose in-sync set loses a node that is gone."""
    led = leaders.where(F.col("leader") == self_id).select(*TP)
    return isr.join(gone, "node_id", "left_semi").join(led, TP, "left_semi").select(*TP).distinct()


def decode_topology(kv: DataFrame) -> DataFrame:
    """``topic``, ``partition`` and replica list of topology entries: key ``<prefix>/<topic>/<partition>``, value a JSON object with ``replicas``.

    The list of ids is in base64; what can't be decoded is no list.
    """
    parts = F.split("key", "/")
    value = F.from_json("value", "replicas STRING, rf INT")
    return kv.select(F.element_at(parts, -2).alias("topic"), F.element_at(parts, -1).try_cast("int").alias("partition"), F.coalesce(replica_list(parse_ids(F.try_to_binary(value["replicas"], F.lit("base64")).cast("string"))), F.array().cast("array<int>")).alias("replicas"), value["rf"].alias("rf"))


def kv_changes(kv: DataFrame, prefix: str, after: int) -> DataFrame:
    """Entries below a prefix with a name of 1 to 64 characters that changed after an index."""
    name = F.substring("key", len(prefix) + 1, 1 << 20)
    return kv.where(F.startswith("key", F.lit(prefix)) & F.length(name).between(1, 64) & (F.col("modify_index") > after))
