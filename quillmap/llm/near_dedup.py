"""Near-duplicates by tensored MinHash banding, every link confirmed on full shingle sets.

Two small collections of minhash groups are made per document. A table key combines one group
of each collection, so ``GROUPS`` squared tables of ``2 * WIDTH`` minhashes each cost only
``2 * GROUPS * WIDTH`` minhashes. At a similarity of 0.8 two documents share no key with a
chance of 2 * (1 - 0.8 ** WIDTH) ** GROUPS, below one in two thousand as set here, and at 0.9
of below one in ten million.

Groups that only one document has cannot be part of a shared key and are dropped before keys
are formed. Equal sets are one class from the start. In each bucket the documents are
compared with one centre, the one that shares most; what is still in another component
than the centre is then compared with the bucket, unless what both share with the centre
and beyond it rules a link out. So no link within a bucket is lost, and a large group of
copies costs one comparison for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.llm.common import fresh, query, small_side, table, written
from quillmap.llm.components import components
from quillmap.llm.shingles import mixed, set_digest, shingle_sets

GROUPS = 12
WIDTH = 3

#: Texts of a batch are hashed in portions of about so many bytes.
PORTION = 512 << 10

_rng = np.random.default_rng(20240301)
_XOR = _rng.integers(0, 1 << 63, (2 * GROUPS * WIDTH), dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, (2 * GROUPS * WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

Batches = Iterator[pa.RecordBatch]


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    texts = batch.column("text").cast(pa.large_binary())
    start, held = 0, []
    size = 0
    for i, value in enumerate(texts):
        held.append(value.as_py() or b"")
        size += len(held[-1])
        if size >= PORTION or i + 1 == len(texts):
            yield start, held
            start, held, size = i + 1, [], 0


def _group_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """The minhash groups of non-empty sets, both collections side by side."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.zeros((len(sets), 2 * GROUPS), np.uint64)
    for i in range(2 * GROUPS * WIDTH):
        least = np.minimum.reduceat((flat ^ _XOR[i]) * _ODD[i], starts)
        at = i // WIDTH
        out[:, at] = mixed(out[:, at] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(i))
    return out.view(np.int64)


def _sketcher(size: int) -> Callable[[Batches], Batches]:
    schema = pa.schema([("n", pa.int64()), ("digest", pa.binary()), ("groups", pa.list_(pa.int64()))])

    def sketch(batches: Batches) -> Batches:
        for batch in batches:
            kept = [c for c in batch.schema.names if c != "text"]
            for start, texts in _portions(batch):
                sets = list(shingle_sets(texts, size))
                full = [s for s in sets if len(s)]
                groups = iter(_group_hashes(full).tolist() if full else [])
                columns = [batch.column(c).slice(start, len(texts)) for c in kept] + [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(groups) if len(s) else None for s in sets], schema.field("groups").type),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *schema.names])

    return sketch


def _setter(size: int) -> Callable[[Batches], Batches]:
    def sets(batches: Batches) -> Batches:
        for batch in batches:
            for start, texts in _portions(batch):
                values = [s.view(np.int64) for s in shingle_sets(texts, size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(start, len(texts)), pa.array(values, pa.list_(pa.int64()))],
                    names=["node", "shingles"],
                )

    return sets


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, v, shared, all, own`` of each pair from the full sets: the sizes of intersection and
    union, and the shingles of ``u`` that ``v`` lacks."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(left, "u").join(right, "v")
    shared = F.size(F.array_intersect("a", "b")).cast("bigint")
    return both.select(
        "u", "v", shared.alias("shared"), (F.size("a") + F.size("b") - shared).alias("all"), F.array_except("a", "b").alias("own")
    )


def _linked(percent: int) -> Column:
    return F.col("shared") * 100 >= F.col("all") * percent


def _near_sizes(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _keys(nodes: DataFrame) -> DataFrame:
    """``key, i, j, node, n, shares``: keys of group i of one collection and group j of the other,
    where another node has each of the two groups too."""
    parts = nodes.select("node", "n", F.posexplode("groups").alias("i", "group"))
    shared = written(parts.groupBy("i", "group").agg(F.count(F.lit(1)).alias("shares")).where("shares > 1"), "shared-groups")
    held = parts.join(shared, ["i", "group"])
    # At most 2 * GROUPS entries for each node.
    entry = F.struct("i", "group")
    lists = held.groupBy("node", "n").agg(
        F.collect_list(F.when(F.col("i") < GROUPS, entry)).alias("first"),
        F.collect_list(F.when(F.col("i") >= GROUPS, entry)).alias("second"),
        F.sum("shares").alias("shares"),
    )
    combined = lists.select("node", "n", "shares", "second", F.explode("first").alias("a"))
    combined = combined.select("node", "n", "shares", "a", F.explode("second").alias("b"))
    return written(combined.select(
        F.xxhash64("a.group", "b.group").alias("key"), F.col("a.i").alias("i"), (F.col("b.i") - GROUPS).alias("j"),
        "node", "n", "shares",
    ), "table-keys")


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of ``docs``: ``id, hash, n_shingles, component_id, kept``.

    Texts are linked when their sets of ``size``-word shingles share at least ``percent`` of
    their union. ``component_id`` is the least identifier that links reach. A text without
    words (or null) has an empty set and no links; its component is itself. Rows with a
    null identifier take part in links, never name a component of others, and have a null
    component if they have no named neighbour. Repeated rows are one class; ``kept`` is whether
    identifier and component agree. ``hash`` is the text's, to tell repeated identifiers
    apart. An empty table gives an empty table; other columns are not read.
    """
    out = _in_components(docs, text, doc_id, size, percent)
    return out.select("id", "hash", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _in_components(docs: DataFrame, text: str, doc_id: str, size: int, percent: int) -> DataFrame:
    """``id, hash, n_shingles, component_id``, and ``component``: one value for all rows of a component, NULL for empty sets."""
    given = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    id_type = given.schema["id"].dataType.simpleString()
    rows = given.mapInArrow(
        _sketcher(size), f"id {id_type}, hash bigint, n bigint, digest binary, groups array<bigint>"
    )
    sketches = written(rows, "sketches")
    classes = sketches.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("first"), F.min(F.struct("id", "hash")).alias("at"), F.max("n").alias("n"),
        F.first("groups").alias("groups"), F.count(F.lit(1)).alias("rows"),
    )
    nodes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    keys = _keys(nodes)
    buckets = keys.groupBy("key").agg(F.max(F.struct("shares", "node")).alias("c"), F.count(F.lit(1)).alias("members"))
    buckets = written(
        buckets.where("members > 1").select("key", F.col("c.node").alias("centre")), "buckets"
    )
    members = keys.join(buckets, "key").where("node <> centre")
    stars = written(members.select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct(), "stars")

    in_buckets = keys.join(buckets.select("key"), "key", "left_semi").select("node").distinct()
    wanted = written(nodes.join(in_buckets, "node").select("node", "at"), "candidates")
    keyed = _once(given.select(F.struct("id", "hash").alias("at"), "text"), "at", _repeated(sketches)).join(small_side(wanted), "at")
    sets = written(keyed.select("node", "text").mapInArrow(_setter(size), "node bigint, shingles array<bigint>"), "sets")

    measured = written(_confirmed(stars, sets).distinct(), "measured")
    links = measured.where(_linked(percent)).select("u", "v")
    roots = written(components(links), "star-components")

    rest = _rest(keys, nodes, buckets, measured, roots, percent)
    more = _confirmed(rest, sets).where(_linked(percent)).select("u", "v").distinct()
    more = written(more, "more-links")
    if not more.isEmpty():
        roots = written(components(links.union(more)), "all-components")

    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("rows").alias("size"))
    least = written(least.where("size > 1").select("root", "component_id"), "component-names")
    answers = written(named.join(least, "root").select("digest", "root", "component_id"), "components")
    out = sketches.select("id", "hash", F.col("n").alias("n_shingles"), "digest")
    out = out.join(small_side(answers.withColumn("met", F.lit(True))), "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce(F.col("root").cast("string"), F.hex("digest")))
    name = F.when(F.col("met"), F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "hash", "n_shingles", name.alias("component_id"), component.alias("component"))


def _repeated(rows: DataFrame) -> DataFrame:
    """Identifier and hash that several rows share."""
    return written(rows.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.struct("id", "hash").alias("at")), "repeated-rows")


def _once(rows: DataFrame, key: str, repeated: DataFrame) -> DataFrame:
    """One row for each ``key`` that ``repeated`` (``at``) lists, and all others as they are."""
    if repeated.isEmpty():
        return rows
    listed = small_side(repeated.withColumnRenamed("at", key))
    return rows.join(listed, key, "left_anti").unionByName(rows.join(listed, key, "left_semi").dropDuplicates([key]))


def _rest(
    keys: DataFrame, nodes: DataFrame, buckets: DataFrame, measured: DataFrame, roots: DataFrame, percent: int
) -> DataFrame:
    """Pairs of a bucket that no component joins yet and that may still be linked.

    Only members in another component than their centre are paired, with the other members,
    and each pair in its first common bucket alone. Exact bounds rule pairs out: the sizes of
    the sets, and their overlap, which is at most what the one that shares less with the centre
    shares with it, and the shingles that both have and the centre lacks.
    """
    rooted = keys.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = rooted.join(buckets, "key").where("node <> centre")
    centres = roots.select(F.col("node").alias("centre"), F.col("root").alias("centre_root"))
    rooted = rooted.join(centres, "centre", "left").withColumn("centre_root", F.coalesce("centre_root", "centre"))
    members = rooted.select("key", "i", "j", "node", "n", "root", "centre", "centre_root")
    busy = written(members.where("root <> centre_root").select("key").distinct(), "stray-buckets")
    held = written(members.join(busy, "key", "left_semi"), "stray-members")
    known = measured.select(F.col("u").alias("node"), F.col("v").alias("centre"), "shared", "own")
    held = held.join(known, ["node", "centre"]).join(nodes.select("node", "groups"), "node")
    held = written(held, "stray-facts")
    others = held.select(
        "key", F.col("node").alias("v"), F.col("n").alias("n2"), F.col("root").alias("root2"),
        F.col("shared").alias("shared2"), F.col("own").alias("own2"), (F.col("root") == F.col("centre_root")).alias("inner"),
        F.col("groups").alias("groups2"),
    )
    strays = held.where("root <> centre_root").withColumnRenamed("node", "u")

    def earlier(start: int, count: str) -> Column:
        part = [F.slice(g, F.lit(start), F.col(count)) for g in ("groups", "groups2")]
        return F.arrays_overlap(*part)

    overlap = F.least("shared", "shared2") + F.size(F.array_intersect("own", "own2"))
    pairs = strays.join(others, "key").where(
        (F.col("root") != F.col("root2")) & (F.col("inner") | (F.col("u") < F.col("v")))
        & _near_sizes("n", "n2", percent)
        & ~earlier(1, "i") & ~earlier(GROUPS + 1, "j")
        & (overlap * (100 + percent) >= (F.col("n") + F.col("n2")) * percent)
    )
    return written(pairs.select("u", "v").distinct(), "rest")


def without_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, with all columns: that of the least identifier, rows without one last.

    Of several rows that share the identifier the one of the least hash stays, of rows that share the text too
    any one. Rows whose text has no words are in no component and all stay.
    """
    (content,) = fresh(docs.columns, "near_key")
    found = written(_in_components(docs, text, doc_id, size, percent).where("component is not null").select("id", "hash", "component"), "near-rows")
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "hash")
    stays = found.groupBy("component").agg(F.min(place).alias("stays"), F.count(F.lit(1)).alias("size"))
    stays = written(stays.where("size > 1").select("component", "stays"), "near-components")
    gone = found.join(small_side(stays), "component").where(~place.eqNullSafe(F.col("stays")))
    gone = written(gone.select(F.struct("id", "hash").alias(content)).distinct(), "near-dropped")
    keyed = docs.withColumn(content, F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("hash")))
    return _once(keyed.join(small_side(gone), content, "left_anti"), content, _repeated(found)).drop(content)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
ORACLE = f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])
                                 WHEN len(w) = 1 THEN w ELSE [] END AS s FROM w),
    parts AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    frequent AS (SELECT x, count(*) AS c FROM parts GROUP BY x),
    ranked AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY c, x) AS r FROM parts JOIN frequent USING (x)),
    prefix AS (SELECT doc_id, n, x FROM ranked WHERE r <= n - CAST(ceil(n * 0.8 - 1e-9) AS BIGINT) + 1),
    cand AS (SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM prefix a JOIN prefix b USING (x)
             WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
    links AS (SELECT u, v FROM cand JOIN sets a ON a.doc_id = u JOIN sets b ON b.doc_id = v
              WHERE 100 * len(list_intersect(a.s, b.s)) >= 80 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
    edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
    reach(doc_id, other) AS (SELECT u, v FROM edges UNION SELECT r.doc_id, e.v FROM reach r JOIN edges e ON e.u = r.other),
    least_id AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
           doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
    FROM sets LEFT JOIN least_id USING (doc_id)"""


@query("op10_near_dedup", ORACLE)
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), size=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
