"""Merkle manifest of a dataset: a tree per source over its documents, a tree over the sources, a proof per document.

A node's rank in base 16 gives its place at every level. Rows are dealt by (group, rank / 256), so a block holds at most
256 nodes. Inside a block the digit columns are grouped away one after the other, and each time the children go as
structs into their parent: 256 nodes become one row of 16 runs of 16 structs. Block roots are the nodes of the next
round, until every group has one. On the way back the rows of a round get the path of their block by one grouping, and
``explode`` over ``transform`` hands every child the digests that stand left and right of it. No join takes part, a source
that holds most rows has many blocks, and no row holds more than 256 nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.llm import base

#: Children of a node, and nodes of a block (two digits).
RUN = 16
BLOCK = RUN * RUN
#: Documents whose unsigned crc32(doc_id) this divides are tampered with in the self-check.
TAMPER = 5
PATH = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest of a document row with the given text."""
    return F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256)


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case only: the tampering of the self-check."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0, F.lit(False))


def joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def nested(nodes: DataFrame) -> DataFrame:
    """Blocks of ``nodes`` (grp, n, rank, digest, payload): (grp, n, block, digest, runs); n counts the nodes of the group.

    A level is hashed only while its group still has several nodes there.
    """
    rows = nodes.select(
        "grp", "n", F.floor(F.col("rank") / BLOCK).alias("block"), F.pmod(F.floor(F.col("rank") / RUN), F.lit(RUN)).alias("d1"),
        F.pmod("rank", F.lit(RUN)).alias("d0"), "digest", "payload",
    ).repartition("grp", "block")
    runs = rows.groupBy("grp", "n", "block", "d1").agg(F.array_sort(F.collect_list(F.struct("d0", "digest", "payload"))).alias("kids"))
    root = F.when(F.col("n") > 1, joined(F.col("kids.digest"))).otherwise(F.col("kids")[0]["digest"])
    runs = runs.withColumn("digest", root)
    blocks = runs.groupBy("grp", "n", "block").agg(F.array_sort(F.collect_list(F.struct("d1", "digest", "kids"))).alias("runs"))
    root = F.when(F.col("n") > RUN, joined(F.col("runs.digest"))).otherwise(F.col("runs")[0]["digest"])
    return blocks.select("grp", "n", "block", root.alias("digest"), "runs")


def with_sides(items: Column) -> Column:
    """(left, right, item) for each struct of a run: the digests before and after it, joined."""
    digests = items["digest"]
    return F.transform(
        items,
        lambda x, i: F.struct(
            F.array_join(F.slice(digests, F.lit(1), i), "").alias("left"),
            F.array_join(F.slice(digests, i + 2, F.lit(RUN)), "").alias("right"),
            x.alias("item"),
        ),
    )


def unfolded(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes of ``blocks`` again, with their paths to the root: (grp, rank, digest, payload, path, crown).

    ``above`` has one row per block: (grp, block, path, crown), the path of the block root and whatever it hands down.
    Both tables meet by one grouping on the block.
    """
    some = F.col("runs").isNotNull()
    rows = blocks.select("grp", "block", F.struct("n", "runs").alias("own"), F.lit(None).cast(above.schema["path"].dataType).alias("path"),
                         F.lit(None).cast(above.schema["crown"].dataType).alias("crown"))
    rows = rows.unionByName(above.select("grp", "block", F.lit(None).cast(rows.schema["own"].dataType).alias("own"), "path", "crown"))
    met = rows.groupBy("grp", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("own", "path", "crown")))
    met = met.select("grp", "block", "path", "crown", "own.n", "own.runs").filter(some)
    met = met.select("grp", "n", "block", "path", "crown", F.explode(with_sides(F.col("runs"))).alias("run"))
    step = F.when(F.col("n") > RUN, F.array(F.struct("run.left", "run.right"))).otherwise(F.array().cast(PATH))
    met = met.select("grp", "n", F.col("block"), F.col("run.item.d1").alias("d1"), F.concat(step, "path").alias("path"), "crown",
                     F.col("run.item.kids").alias("kids"))
    met = met.select("grp", "n", "block", "d1", "path", "crown", F.explode(with_sides(F.col("kids"))).alias("kid"))
    step = F.when(F.col("n") > 1, F.array(F.struct("kid.left", "kid.right"))).otherwise(F.array().cast(PATH))
    rank = F.col("block") * BLOCK + F.col("d1") * RUN + F.col("kid.item.d0")
    return met.select("grp", rank.alias("rank"), F.col("kid.item.digest").alias("digest"), F.col("kid.item.payload").alias("payload"),
                      F.concat(step, "path").alias("path"), "crown")


@dataclass
class Tree:
    """Nested blocks of every round, leaves first, and the root of every group: (grp, digest)."""

    rounds: list[DataFrame]
    roots: DataFrame


def grown(leaves: DataFrame, name: str) -> Tree:
    """Trees of all groups of ``leaves`` (grp, n, rank, digest, payload). Every round is a written table."""
    rounds, nodes = [], leaves
    while True:
        rounds.append(base.stage(nested(nodes), f"{name}{len(rounds)}"))
        up = rounds[-1].select("grp", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("rank"), "digest", F.lit(None).cast("string").alias("payload"))
        if (up.agg(F.max("n")).first()[0] or 1) == 1:
            return Tree(rounds, up.select("grp", "digest"))
        nodes = up


def paths(tree: Tree, crowns: DataFrame) -> DataFrame:
    """Every leaf with its path to the root of its group and on: ``crowns`` has (grp, path, crown) for every group."""
    above = crowns.select("grp", F.lit(0).cast("long").alias("block"), "path", "crown")
    for blocks in reversed(tree.rounds):
        nodes = unfolded(blocks, above)
        above = nodes.select("grp", F.col("rank").alias("block"), "path", "crown")
    return nodes


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest and the digests beside its path give."""
    return F.aggregate(path, digest, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, forged, path, subroot, root) for every row of ``docs``.

    ``path`` lists the digests left and right of each step from the leaf to the root; ``forged`` is the digest of the
    row after tampering, null where it is not tampered with. Null columns enter a leaf as ``-``; a null source is a group
    of its own, before all others. Null ids come first in their source, rows with equal ids stand in the order of their leaves, equal
    rows are separate leaves. Empty texts and texts of any length are hashed whole. No rows give no rows. Other columns of
    ``docs`` take no part, whatever their names.
    """
    plain = leaf(F.col("text"))
    forged = F.when(tampered(), leaf(lowered(F.col("text"))))
    slim = base.stage(docs.select("doc_id", F.col("source").alias("grp"), plain.alias("digest"), forged.alias("forged")), "leaves")
    rows = base.ranked(slim, ["grp"], ["doc_id", "digest"], "ranks")
    leaves = rows.select("grp", F.col("n_ranked").alias("n"), "rank", "digest", F.struct("doc_id", "forged").alias("payload"))
    tree = grown(leaves, "blocks")
    subroots = base.stage(tree.roots.withColumnRenamed("grp", "source"), "subroots")
    rows = base.ranked(subroots, [], ["source"], "sources")
    top = grown(rows.select(F.lit(0).alias("grp"), F.col("n_ranked").alias("n"), "rank", "digest", F.struct("source").alias("payload")), "tops")
    root = top.roots.select("grp", F.array().cast(PATH).alias("path"), F.col("digest").alias("crown"))
    sources = paths(top, root).select(F.col("payload.source").alias("grp"), "path", F.struct(F.col("digest").alias("subroot"), F.col("crown").alias("root")).alias("crown"))
    return paths(tree, sources).select(
        "payload.doc_id", F.col("grp").alias("source"), F.col("digest").alias("leaf"), "payload.forged", "path", "crown.subroot", "crown.root")


def verified(rows: DataFrame) -> DataFrame:
    """Digest columns of a manifest: the hash of each proof, and the root that the (tampered) row leads to."""
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    reached = folded(F.coalesce("forged", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), reached.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
