"""Document fingerprints from spot signatures.

A spot is a common word (an anchor) followed by a content word; its signature is the anchor with the
chain of the next ``CHAIN`` content words, anchors in between left out. The fingerprint of a text is the
set of its signatures, each as 8 hex digits of a hash, sorted. Likeness of two fingerprints is the Jaccard
similarity of the sets. A search partitions fingerprints by the length of the set, since sets of similarity
t have lengths within a factor t, lets only those meet that share one of their rarest signatures, and
compares them exactly.

Defined results: words are split at white space, lower-cased, without ``. , ; : ! ? " ( )``. A text without
a full chain has one signature made of all its words (of none, if it is empty or null), so equal texts
always have equal fingerprints. The next document is the next by doc_id (null first), then by text; after
the last comes the first. Rows that repeat a doc_id are documents of their own. Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointgrid.llm.arrow_text import NO_ID
from pointgrid.stages import cut

#: Common words of four languages.
ANCHORS = (
    "the of and to in is it that for was on are as with he be at by this had have from or a an "
    "der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch es "
    "de la le et les en un du une que est pour qui dans par plus pas au sur ne "
    "el y los se del las por con no su para al lo como"
).split()
CHAIN = 3
DROPPED = '.,;:!?"()'
ROWS_PER_BLOCK = 128
MOST_BLOCKS = 65536


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sorted set of signatures of column ``text`` as ``name``."""
    common = lambda c: c.isin(ANCHORS)
    plain = F.translate(F.lower(text), "\t\n\x0b\x0c\r" + DROPPED, " " * 5)
    df = df.withColumn("_w", F.filter(F.split(plain, " "), lambda x: x != ""))
    prior = F.concat(F.array(F.lit("")), F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))))
    df = df.withColumn("_c", F.arrays_zip(F.col("_w").alias("w"), prior.alias("before")))
    df = df.withColumn("_c", F.filter("_c", lambda x: ~common(x["w"])))
    n = F.size("_c")
    later = [F.slice(F.transform("_c", lambda x: x["w"]), i + 1, F.greatest(n - i, F.lit(0))).alias(f"w{i}") for i in range(1, CHAIN)]
    df = df.withColumn("_z", F.arrays_zip(F.col("_c").alias("c"), *later))
    spots = F.filter("_z", lambda x: common(x["c"]["before"]) & x[f"w{CHAIN - 1}"].isNotNull())
    signature = lambda *words: F.substring(F.md5(F.concat_ws(" ", *words)), 1, 8)
    df = df.withColumn("_z", F.transform(spots, lambda x: signature(x["c"]["before"], x["c"]["w"], *(x[f"w{i}"] for i in range(1, CHAIN)))))
    whole = F.array(signature(F.lit("="), F.array_join("_w", " ")))
    return df.withColumn(name, F.when(F.size("_z") > 0, F.array_sort(F.array_distinct("_z"))).otherwise(whole)).drop("_w", "_c", "_z")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two signature columns."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, signatures, fingerprint of every text."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_signatures(base, "text", "signatures").select("doc_id", "signatures", F.array_join("signatures", " ").alias("fingerprint"))


def in_blocks(docs: DataFrame) -> DataFrame:
    """Documents dealt into blocks of neighbouring doc_ids; _tail marks the copy that begins the next block.

    Block borders are doc_ids at even ranks, at most MOST_BLOCKS of them. The rows of a border stand in
    their block and, as its tail, in the block before; those of the first border also end the last block.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    base = docs.select(own.alias("_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    blocks = max(1, min(MOST_BLOCKS, ceil(n / ROWS_PER_BLOCK)))
    ranks = F.lit([i / blocks for i in range(blocks)])
    found = base.agg(F.percentile_approx("_id", ranks, 10 * blocks)).first()[0] or []
    least = base.agg(F.min("_id")).first()[0]
    borders = sorted({*found, NO_ID if least is None else least})
    step = isqrt(len(borders)) + 1
    listed = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
    groups = F.transform(
        F.split(F.lit(";".join(",".join(map(str, borders[i : i + step])) for i in range(0, len(borders), step))), ";"),
        lambda g: F.split(g, ",").cast("array<bigint>"),
    )
    upto = lambda x: F.filter(x, lambda b: b <= F.col("_id"))
    placed = base.withColumn("_group", F.size(upto(listed(borders[::step]))))
    placed = placed.withColumn("_inner", upto(F.element_at(groups, F.col("_group"))))
    placed = placed.withColumn("_block", (F.col("_group") - 1) * step + F.size("_inner"))
    place = lambda block, tail: F.struct(block.alias("block"), F.lit(tail).alias("tail"))
    before = F.when(F.col("_block") == 1, len(borders)).otherwise(F.col("_block") - 1)
    places = F.when(
        F.element_at("_inner", -1) == F.col("_id"), F.array(place(F.col("_block"), False), place(before, True))
    ).otherwise(F.array(place(F.col("_block"), False)))
    return placed.withColumn("_p", F.explode(places)).select("_id", "doc_id", "text", F.col("_p.block").alias("_block"), F.col("_p.tail").alias("_tail"))


def beside_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next text's.

    In the edited text the last floor(n/2) of n characters are replaced by the first as many of the next document.
    """
    order = W.partitionBy("_block").orderBy("_tail", "_id", "text")
    df = with_signatures(in_blocks(docs), "text", "_own")
    df = df.withColumn("_next_text", F.lead("text").over(order)).withColumn("_next", F.lead("_own").over(order)).where("NOT _tail")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, int(n_chars - n_chars div 2)), substring(_next_text, 1, int(n_chars div 2)))")
    df = with_signatures(df.withColumn("_edited", edited), "_edited", "_other")
    return df.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        F.array_join("_own", " ").alias("fingerprint"), F.array_join("_other", " ").alias("edited_fingerprint"),
        likeness("_own", "_other").alias("near_edited"), likeness("_own", "_next").alias("near_next"),
    )


def similar(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """a, b, likeness: pairs of different fingerprints at least ``least`` alike, smaller one first.

    Each fingerprint is listed under its rarest signatures: a set of n that is t alike to another shares
    one of its n - ceil(t * n) + 1 rarest with it. Lists are split by length.
    """
    sets = cut(fingerprints(docs).select("fingerprint", "signatures").distinct(), "prints")
    each = sets.select("fingerprint", F.explode("signatures").alias("sig"))
    seen = cut(each.groupBy("sig").agg(F.count("*").alias("n")), "seen")
    ranked = each.join(seen, "sig").groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("n", "sig"))).alias("rare"))
    size = F.size("rare")
    # One unit of this logarithm is a factor of 1 / least in length.
    length = F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / least)))
    listed = cut(
        ranked.select(
            "fingerprint", F.transform("rare", lambda x: x["sig"]).alias("sigs"), size.alias("size"), length.alias("part"),
            F.explode(F.slice("rare", 1, (size - F.ceil(size * least - 1e-9) + 1).cast("int"))).alias("_r"),
        ).select("fingerprint", "sigs", "size", "part", F.col("_r.sig").alias("sig")),
        "listed",
    )
    one = listed.select("sig", "part", F.col("fingerprint").alias("a"), F.col("sigs").alias("sa"), F.col("size").alias("na"))
    two = listed.select(
        "sig", F.explode(F.array(F.col("part"), F.col("part") - 1, F.col("part") + 1)).alias("part"),
        F.col("fingerprint").alias("b"), F.col("sigs").alias("sb"), F.col("size").alias("nb"),
    )
    close = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * (least - 1e-9))
    pairs = one.join(two, ["sig", "part"]).where(close).withColumn("likeness", likeness("sa", "sb")).where(F.col("likeness") >= least)
    return pairs.select("a", "b", "likeness").distinct()
