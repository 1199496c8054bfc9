"""A Merkle manifest of a table, as a tree of SHA-256 midstates.

A leaf is the digest of one record's fields; per group the leaves, in their order, are hashed run by run until one
node remains, and the groups' nodes likewise to the root. A parent retains a copy of its hash state before each child
slot. To check a record against the root, folding resumes the state of its slot with the replacement and the siblings
to its right alone; what stands to the left is in the state.

Digests as hex text are one block each, so states are whole and can be stored (``sha.py``). A run of ``CHUNK`` leaves
is hashed in one task: stages go up over chunks, so a group with most of the records is many tasks, and steps (slot,
state, siblings) come down the same way, one list a chunk. Records never move, only their digests do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.llm import sha
from evidex.session import spread, stored

FAN_OUT, CHUNK_LEVELS = 2, 12
_STEP = "struct<slot:int,state:binary,left:binary,right:binary>"
_ARROW_STEPS = pa.list_(pa.struct([("slot", pa.int32()), ("state", pa.binary()), ("left", pa.binary()), ("right", pa.binary())]))
#: The fields of a snapshot, in the order in which they are hashed.
SNAPSHOT_FIELDS = ("id", "url", "maker_id", "fetched_s", "status", "body")


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of fields in order: each is its UTF-8 byte count, a colon and its text, or a dash if null."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


class _Level(NamedTuple):
    """The nodes of one level under their parents: digests, children of each parent, and its state before each slot."""

    nodes: np.ndarray
    counts: np.ndarray
    states: list[np.ndarray]


def _tree(digests: np.ndarray, fan_out: int, levels: int | None) -> tuple[list[_Level], np.ndarray]:
    """The levels over the digests and the top node; without ``levels``, as many as leave one node."""
    out: list[_Level] = []
    while digests.shape[1] > 1 if levels is None else len(out) < levels:
        n = digests.shape[1]
        parents = -(-n // fan_out)
        counts = np.minimum(fan_out, n - fan_out * np.arange(parents))
        state, states = sha.start(parents), []
        for slot in range(fan_out):
            states.append(state.copy())
            own = np.flatnonzero(counts > slot)
            state[:, own] = sha.compress(state[:, own], sha.hex_block(digests[:, own * fan_out + slot]))
        out.append(_Level(digests, counts, states))
        digests = sha.finish(state, counts)
    return out, digests


def _steps(levels: list[_Level], k: int, fan_out: int) -> list[dict]:
    """How node ``k`` of the lowest level is folded up to the top."""
    out = []
    for level in levels:
        parent, slot = divmod(k, fan_out)
        family = sha.to_bytes(level.nodes[:, parent * fan_out:(parent + 1) * fan_out])
        out.append({"slot": slot, "state": sha.to_bytes(level.states[slot][:, parent:parent + 1])[0], "left": b"".join(family[:slot]), "right": b"".join(family[slot + 1:])})
        k = parent
    return out


def _folded(levels: list[_Level], seen: np.ndarray, fan_out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every leaf folded up by itself: (its top node, the state of its proof, blocks in it)."""
    n = seen.shape[1]
    at, proof, blocks = np.arange(n), sha.start(n), np.zeros(n, np.int64)
    for level in levels:
        parent, slot = at // fan_out, at % fan_out
        counts = level.counts[parent]
        state = np.ascontiguousarray(np.stack(level.states)[slot, :, parent].T)
        for s in range(fan_out):
            mine = slot == s
            right = np.flatnonzero((slot <= s) & (counts > s))
            family = sha.hex_block(level.nodes[:, np.minimum(parent * fan_out + s, level.nodes.shape[1] - 1)])
            block = np.where(mine, sha.hex_block(seen), family)
            state[:, right] = sha.compress(state[:, right], block[:, right])
            other = np.flatnonzero(~mine & (counts > s))
            proof[:, other] = sha.compress(proof[:, other], family[:, other])
            blocks[other] += 1
        seen, at = sha.finish(state, counts), parent
    return seen, proof, blocks


def _resumed(steps: list[dict], seen: np.ndarray, proof: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from a chunk's node on, by the chunk's own steps."""
    n = seen.shape[1]
    wide = lambda raw: np.repeat(sha.hex_block(sha.of_bytes([raw])), n, axis=1)
    cut = lambda raw: [raw[k:k + 32] for k in range(0, len(raw), 32)]
    for step in steps:
        left, right = cut(step["left"]), cut(step["right"])
        state = sha.compress(np.repeat(sha.of_bytes([step["state"]]), n, axis=1), sha.hex_block(seen))
        for sibling in right:
            state = sha.compress(state, wide(sibling))
        for sibling in left + right:
            proof = sha.compress(proof, wide(sibling))
        blocks = blocks + len(left) + len(right)
        seen = sha.finish(state, np.full(n, len(left) + 1 + len(right)))
    return seen, proof, blocks


def _numbered(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, their place in their group, and ``total``, its size; no group is one task's.

    Rows are dealt to ranges of (group, order); the size of a group in each range before gives where a range starts.
    """
    ranged = stored(rows.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id()), name)
    before = Window.partitionBy(group).orderBy("part")
    sizes = ranged.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n")).select(
        group, "part", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy(group)).alias("total"))
    nth = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)) - 1
    return ranged.withColumn("nth", nth).join(sizes, [group, "part"]).withColumn("pos", F.col("nth") + F.col("ahead")).drop("nth", "ahead", "part")


def _climbed(nodes: DataFrame, fan_out: int, levels: int) -> list[DataFrame]:
    """``g, pos, total, digest`` stage by stage, each of the chunk nodes of the one before, to one node a group."""
    chunk, stages = fan_out**levels, [nodes]

    def top(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        total, pos = table.column("total")[0].as_py(), table.column("pos")[0].as_py()
        node = _tree(sha.of_bytes(table.column("digest").to_pylist()), fan_out, None if total <= chunk else levels)[1]
        return pa.table({"g": table.column("g")[:1], "pos": pa.array([pos // chunk], pa.int64()), "total": pa.array([-(-total // chunk)], pa.int64()), "digest": pa.array(sha.to_bytes(node), pa.binary())})

    while (nodes.agg(F.max("total")).first()[0] or 0) > 1:
        split = spread(nodes.select("g", "pos", "total", "digest").withColumn("chunk", F.floor(F.col("pos") / chunk)), "g", "chunk")
        nodes = stored(split.groupBy("g", "chunk").applyInArrow(top, "g string, pos long, total long, digest binary"), "manifest-nodes")
        stages.append(nodes)
    return stages


def _steps_down(stages: list[DataFrame], top: DataFrame, fan_out: int, levels: int) -> DataFrame:
    """``g, pos, steps, subroot, root`` of every node of ``stages[0]``, from those of the groups (``top``, at place 0)."""
    chunk = fan_out**levels

    def down(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        n = nodes.num_rows
        built, _ = _tree(sha.of_bytes(nodes.column("digest").to_pylist()), fan_out, None if nodes.column("total")[0].as_py() <= chunk else levels)
        upper = above.column("steps")[0].as_py()
        steps = [_steps(built, k, fan_out) + upper for k in range(n)]
        one = lambda c: pa.array([above.column(c)[0].as_py()] * n, pa.binary())
        return pa.table({"g": nodes.column("g"), "pos": nodes.column("pos"), "steps": pa.array(steps, _ARROW_STEPS), "subroot": one("subroot"), "root": one("root")})

    for nodes in reversed(stages[:-1]):
        split = nodes.select("g", "pos", "total", "digest").withColumn("chunk", F.floor(F.col("pos") / chunk))
        top = stored(split.groupBy("g", "chunk").cogroup(top.withColumnRenamed("pos", "chunk").groupBy("g", "chunk"))
                     .applyInArrow(down, f"g string, pos long, steps array<{_STEP}>, subroot binary, root binary"), "manifest-steps")
    return top


def manifest(records: DataFrame, fields: Sequence[str] = SNAPSHOT_FIELDS, group: str = "maker_id", order: str = "id", seen: Mapping[str, Column] | None = None,
             fan_out: int = FAN_OUT, chunk_levels: int = CHUNK_LEVELS) -> DataFrame:
    """The ``order`` column and ``leaf, subroot, root, proof_sha256, folded_root, verified`` of every record; by default of snapshots.

    A leaf is the digest of ``fields``. Per ``group`` the leaves ascend by ``order`` (nulls first; equal ones by leaf); while several nodes
    remain, every ``fan_out`` in a row become the digest of their hex texts. What remains is the group's ``subroot``; groups ascend by
    their value as UTF-8 text, null first, and give ``root`` likewise. ``proof_sha256`` is the digest of all siblings on a record's way to the root,
    level by level, left to right. ``seen`` holds fields as they are met when records are checked (by default as they are): ``folded_root``
    is what the leaf of these folds to, ``verified`` whether that is the root. Digests are lower-case hex.

    Nulls in any field, empty and long texts are hashed as written; repeated rows are leaves of their own; an empty table has no rows and no
    root. Other columns are not looked at.
    """
    known, met = leaf([F.col(f) for f in fields]), leaf([(seen or {}).get(f, F.col(f)) for f in fields])
    differs = reduce(Column.__or__, [~F.col(f).eqNullSafe(c) for f, c in (seen or {}).items()], F.lit(False))
    rows = records.select(F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("g"), F.col(order).alias("id"), known.alias("digest"), F.when(differs, met).alias("seen"))
    leaves = stored(_numbered(rows, "g", ["id", "digest"], "manifest-leaves"), "manifest-places")
    stages = _climbed(leaves, fan_out, chunk_levels)
    subroots = stages[-1].filter("pos = 0").select("g", "digest")

    groups = stored(_numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"), "g", ["of"], "manifest-groups"), "manifest-groups")
    upper = _climbed(groups.select("g", "pos", "total", "digest"), fan_out, chunk_levels)
    nothing = F.array().cast(f"array<{_STEP}>")
    root = upper[-1].select("g", F.lit(0).cast("long").alias("pos"), nothing.alias("steps"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    ways = _steps_down(upper, root, fan_out, chunk_levels)
    top = groups.join(ways.select("pos", "steps", "root"), "pos").select(F.col("of").alias("g"), F.lit(0).cast("long").alias("pos"), "steps", F.col("digest").alias("subroot"), "root")
    above = _steps_down(stages[1:], top, fan_out, chunk_levels) if len(stages) > 1 else top
    return _verified(leaves, above, fan_out, chunk_levels).withColumnRenamed("id", order)


def _verified(leaves: DataFrame, above: DataFrame, fan_out: int, levels: int) -> DataFrame:
    chunk = fan_out**levels

    def fold(nodes: pa.Table, way: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        n = nodes.num_rows
        raw = nodes.column("digest").to_pylist()
        own = sha.of_bytes(raw)
        met = sha.of_bytes([s or r for s, r in zip(nodes.column("seen").to_pylist(), raw, strict=True)])
        built, _ = _tree(own, fan_out, None if nodes.column("total")[0].as_py() <= chunk else levels)
        done, proof, blocks = _resumed(way.column("steps")[0].as_py(), *_folded(built, met, fan_out))
        root = way.column("root")[0].as_py()
        folded = sha.to_bytes(done)
        one = lambda v: pa.array([v] * n, pa.binary())
        return pa.table({"id": nodes.column("id"), "leaf": pa.array(raw, pa.binary()), "subroot": one(way.column("subroot")[0].as_py()), "root": one(root),
                         "proof": pa.array(sha.to_bytes(sha.finish(proof, blocks)), pa.binary()), "folded": pa.array(folded, pa.binary()), "verified": pa.array([f == root for f in folded])})

    kind = leaves.schema["id"].dataType.simpleString()
    split = spread(leaves.withColumn("chunk", F.floor(F.col("pos") / chunk)), "g", "chunk")
    out = split.groupBy("g", "chunk").cogroup(above.withColumnRenamed("pos", "chunk").groupBy("g", "chunk")).applyInArrow(
        fold, f"id {kind}, leaf binary, subroot binary, root binary, proof binary, folded binary, verified boolean")
    text = lambda c: F.lower(F.hex(c))
    return out.select("id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), "verified")
