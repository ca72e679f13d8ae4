"""Merkle manifest of a dataset by nested-interval labels.

Every row is a leaf; leaves of one group (``lang``) are ranked and form a tree in which two neighbouring nodes, or
the last one alone, have one parent, until a single node is left. A node is labelled with the interval [lo, hi) of
leaf ranks that it covers. Nodes are made ``BAND`` levels at a time, from at most 2**BAND children that stand
together. Ancestors are attached by containment of intervals, in buckets of one level: a node meets the nodes of a
level whose interval begins in the same stretch of 2**level ranks. A node's sibling is what its parent's interval
covers besides its own. Paths are attached band by band, from the top down, so that no ancestor meets more than
2**BAND nodes; a group that holds most rows only has more blocks. The roots of all groups are the leaves of one
more tree.

Defined results: leaf order is doc_id (null first), then the leaf's hash; leaves equal in both are equal rows, which
get the group's consecutive places in any order. Groups are ordered by their UTF-8 bytes, null first. A null value is
written ``-``, an empty text ``0:``. The proof of a lone leaf in a lone group is that of no siblings. An empty table
has no nodes. Rows with a null doc_id are not tampered with; a null n_chars stays null. Columns that are not
fields are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointgrid.stages import cut, measured, ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BAND = 8
STEP = "array<struct<left: boolean, sibling: string>>"


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def written(value: Column) -> Column:
    """A value as it is hashed: byte count, colon, text; ``-`` for null."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(**instead: Column) -> Column:
    return digest(F.concat(*(written(instead.get(f, F.col(f))) for f in FIELDS)))


def ranked_leaves(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Add lo (rank in the tree from 0), n (leaves of the tree) and height to leaves with a column ``tree``; stored."""
    numbered = ranked(leaves, order, ["tree"], "lo").withColumn("lo", F.col("lo") - 1)
    sizes = measured(leaves.groupBy("tree").agg(F.count("*").alias("n")))
    return cut(numbered.join(sizes, "tree").withColumn("height", F.expr("if(n = 1, 0, length(bin(n - 1)))")), "leaves")


def parents_of(hashes: Column) -> Column:
    """Hashes of the parents of neighbouring nodes."""
    pair = lambda i: digest(F.concat(F.get(hashes, 2 * i), F.coalesce(F.get(hashes, 2 * i + 1), F.lit(""))))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) + 1) / 2).cast("int") - 1), pair)


def nodes(leaves: DataFrame) -> DataFrame:
    """tree, n, height, level, lo, hi, hash of all nodes above and at ``leaves`` (tree, n, height, lo, hash)."""
    at = leaves.select("tree", "n", "height", F.lit(0).alias("level"), "lo", (F.col("lo") + 1).alias("hi"), "hash")
    found = [at]
    highest = leaves.agg(F.max("height")).first()[0] or 0
    for base in range(0, highest, BAND):
        children = at.where(F.col("height") > base).withColumn("block", F.shiftright("lo", base + BAND))
        made = children.groupBy("tree", "n", "height", "block").agg(F.array_sort(F.collect_list(F.struct("lo", "hash"))).alias("c"))
        made = made.withColumn("h0", F.transform("c", lambda x: x["hash"]))
        for k in range(1, BAND + 1):
            made = made.withColumn(f"h{k}", parents_of(F.col(f"h{k - 1}")))
        levels = F.array(*(F.struct(F.lit(base + k).alias("level"), F.col(f"h{k}").alias("hashes")) for k in range(1, BAND + 1)))
        each = made.select("tree", "n", "height", "block", F.explode(levels).alias("x")).where("x.level <= height")
        each = each.select("tree", "n", "height", "block", F.col("x.level").alias("level"), F.posexplode("x.hashes").alias("i", "hash"))
        lo = F.expr(f"shiftleft(block, {base + BAND}) + shiftleft(bigint(i), level)")
        hi = F.expr("least(lo + shiftleft(1L, level), n)")
        made = cut(each.withColumn("lo", lo).withColumn("hi", hi).select(at.columns), "nodes")
        found.append(made)
        at = made.where(f"level = {base + BAND}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def with_siblings(every: DataFrame) -> DataFrame:
    """tree, level, lo, hi, left, sibling of every node that has a parent.

    The parent is the node one level up whose interval contains the node's; what is left of that interval is the
    sibling's, to the ``left`` or to the right. Without any the sibling is null.
    """
    child = every.select("tree", "level", "lo", "hi", F.expr("shiftright(lo, level + 1)").alias("bucket"))
    parent = every.where("level > 0").select("tree", (F.col("level") - 1).alias("level"), F.expr("shiftright(lo, level)").alias("bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"))
    own = child.join(parent, ["tree", "level", "bucket"]).where("p_lo <= lo AND hi <= p_hi")
    rest = F.when(F.col("p_lo") < F.col("lo"), F.col("p_lo")).when(F.col("hi") < F.col("p_hi"), F.col("hi"))
    own = own.select("tree", "level", "lo", "hi", (F.col("p_lo") < F.col("lo")).alias("left"), rest.alias("s_lo"))
    other = every.select("tree", "level", F.col("lo").alias("s_lo"), F.col("hash").alias("sibling"))
    return own.join(other, ["tree", "level", "s_lo"], "left").select("tree", "level", "lo", "hi", "left", "sibling")


def paths(leaves: DataFrame, every: DataFrame, above: DataFrame) -> DataFrame:
    """The columns of ``leaves`` with path (steps from the leaf upwards) and what else ``above`` (tree, path, ...) says of the tree."""
    known = cut(with_siblings(every), "siblings")
    extra = [c for c in above.columns if c not in ("tree", "path")]
    roots = measured(every.where("level = height").select("tree", "height").join(above, "tree"))
    payload = [c for c in leaves.columns if c not in ("tree", "lo", "n", "height")]
    highest = leaves.agg(F.max("height")).first()[0] or 0
    upper = None
    step = "struct<level: int, left: boolean, sibling: string>"
    for base in reversed(range(0, max(highest, 1), BAND)):
        carried = [] if base else payload
        own = leaves.select("tree", "lo", (F.col("lo") + 1).alias("hi"), *carried) if not base else every.where(f"level = {base}").select("tree", "lo", "hi")
        bucket = F.expr("shiftright(lo, level)")
        wanted = own.select("tree", "lo", "hi", F.explode(F.sequence(F.lit(base), F.lit(base + BAND - 1))).alias("level")).withColumn("bucket", bucket)
        wanted = wanted.withColumnsRenamed({"lo": "c_lo", "hi": "c_hi"})
        in_band = known.where(f"level >= {base} AND level < {base + BAND}").withColumn("bucket", bucket)
        steps = wanted.join(in_band, ["tree", "level", "bucket"]).where("lo <= c_lo AND c_hi <= hi")
        blank = [F.lit(None).cast(leaves.schema[c].dataType).alias(c) for c in carried]
        rows = own.select("tree", "lo", *carried, F.lit(None).cast(step).alias("step"))
        rows = rows.unionAll(steps.select("tree", F.col("c_lo").alias("lo"), *blank, F.struct("level", "left", "sibling").alias("step")))
        got = rows.groupBy("tree", "lo").agg(*(F.max(c).alias(c) for c in carried), F.array_sort(F.collect_list("step")).alias("path"))
        got = got.withColumn("path", F.transform("path", lambda x: F.struct(x["left"], x["sibling"]))).withColumn("top", F.shiftright("lo", base + BAND))
        # The root of a tree that ends in this band stands above all its nodes.
        ends = roots.where(f"height <= {base + BAND}" + (f" AND height > {base}" if base else ""))
        tops = ends.select("tree", F.lit(0).cast("long").alias("top"), F.col("path").alias("more"), *extra)
        if upper is not None:
            tops = tops.unionByName(upper.select("tree", F.shiftright("lo", base + BAND).alias("top"), F.col("path").alias("more"), *extra))
        got = got.join(tops, ["tree", "top"]).withColumn("path", F.concat("path", "more")).drop("top", "more")
        upper = cut(got, "paths") if base else got
    return upper


def folded(start: str) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate("path", F.col(start), lambda acc, x: digest(F.when(x["left"], F.concat(x["sibling"], acc)).otherwise(F.concat(acc, F.coalesce(x["sibling"], F.lit(""))))))


def hashed(docs: DataFrame) -> DataFrame:
    """tree, doc_id, hash, tampered (the leaf with n_chars + 1, where 7 divides the crc32 of doc_id), _row of every row; stored."""
    touched = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return cut(
        docs.select(
            F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "lang")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash().alias("hash"),
            F.when(touched, leaf_hash(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)).alias("tampered"), F.monotonically_increasing_id().alias("_row"),
        ),
        "hashed",
    )


@dataclass
class Manifest:
    """Leaves and nodes of the groups' trees, and leaves (with ``group``) and nodes of the tree over their roots."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    over: DataFrame


def manifest(docs: DataFrame) -> Manifest:
    leaves = ranked_leaves(hashed(docs), ["doc_id", "hash", "_row"]).drop("_row")
    every = nodes(leaves)
    subroots = cut(every.where("level = height").select(F.lit("").alias("tree"), F.col("tree").alias("group"), "hash"), "subroots")
    roots = ranked_leaves(subroots, ["group"])
    return Manifest(leaves, every, roots, nodes(roots))


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, hash (the leaf), tampered, path, subroot, root of every row."""
    m = manifest(docs)
    end = m.over.where("level = height").select("tree", F.array().cast(STEP).alias("path"), F.col("hash").alias("root"))
    tops = cut(paths(m.roots, m.over, end).select(F.col("group").alias("tree"), "path", F.col("hash").alias("subroot"), "root"), "tops")
    return paths(m.leaves, m.nodes, tops).select("doc_id", "hash", "tampered", "path", "subroot", "root")


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each row's proof, and the root that the tampered rows lead to."""
    rows = proofs(docs).withColumn("_start", F.coalesce("tampered", "hash"))
    proof = digest(F.array_join(F.transform("path", lambda x: x["sibling"]), ""))
    rows = rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded("_start").alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
