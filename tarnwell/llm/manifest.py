"""Merkle dataset manifest (operator 13): trees of digests over the rows of a table.

A row is a leaf, the digest of its fields. The leaves of a group stand by id, and level
by level every FANOUT consecutive nodes become the digest of their digests, until one
node of the group, its subroot, remains. Subroots stand by group and give the root the
same way. Levels are DataFrames: indices by row_number, floor-divided by the fan-out,
children as sorted arrays of at most FANOUT, hashed into parents.

Proofs go down by a join for each level: a run's children get the siblings beside them
and what their parent got. So only parents' proofs move, and a leaf's is put together
where its run is. Indices of a group are counted in ranges of ids, so that no group is
one task: row_number within (range, group) and the sizes of a group's ranges before.

Defined results: a null field is "-", so null and empty texts differ; a null group is a
group of its own and comes first; null ids come first; rows of one id stand by their
leaf, equal rows in any order; an only leaf is its group's subroot, an only subroot the
root; very long texts are hashed whole; an empty table gives an empty result; further
columns are neither hashed nor in the way, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, own, partitions, read, temporary

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One row in so many, by crc32 of the id, is tampered with by the query.
TAMPERED = 5

ID, GROUP, LEAF, CHANGED, PART, AT, N, KIDS, PATH, HASH, TOP, ROOT, BEFORE, AFTER = (own(c) for c in ("id", "group", "leaf", "changed", "part", "at", "n", "kids", "path", "hash", "top", "root", "before", "after"))


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row's fields: each as its UTF-8 length, a colon and its value, or a hyphen."""
    texts = [v.cast("string") for v in values]
    return _hash(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _indexed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with AT, the place from 0 in its GROUP by the columns of order, and N, the group's size; no group is one task."""
    ranges = rows.repartitionByRange(4 * partitions(rows.sparkSession), GROUP, *order).withColumn(PART, F.spark_partition_id())
    inside = Window.partitionBy(PART, GROUP)
    placed = materialise(ranges.withColumn(AT, F.row_number().over(inside.orderBy(*order)).cast("long") - 1), "manifest")
    sizes = placed.groupBy(PART, GROUP).agg(F.count(F.lit(1)).alias(N))
    # A row for each range of a group: as many as there are partitions for the largest group.
    group = Window.partitionBy(GROUP)
    earlier = F.coalesce(F.sum(N).over(group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = materialise(sizes.select(PART, GROUP, earlier.alias(BEFORE), F.sum(N).over(group).alias(N)), "manifest")
    return placed.join(spans, [PART, GROUP]).withColumn(AT, F.col(AT) + F.col(BEFORE)).drop(PART, BEFORE)


def _levels(nodes: DataFrame, extra: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level (GROUP, AT, N of the children's level, KIDS sorted) and the nodes that remain, one (GROUP, HASH) a group.

    A node that is alone in its group stays as it is, level by level, until the largest group has come to one.
    """
    most = nodes.agg(F.max(N)).first()[0] or 0
    depth = next(k for k in range(1, 64) if FANOUT**k >= most)
    found: list[DataFrame] = []
    for k in range(depth):
        own_extra = extra if k == 0 else ()
        kid = F.struct(F.col(AT).alias("at"), F.col(HASH).alias("hash"), *[F.col(c).alias(c) for c in own_extra])
        runs = nodes.groupBy(GROUP, F.floor(F.col(AT) / FANOUT).cast("long").alias(AT), N).agg(F.array_sort(F.collect_list(kid)).alias(KIDS))
        found.append(materialise(runs, "manifest"))
        parent = F.when(F.col(N) == 1, F.col(KIDS)[0]["hash"]).otherwise(F.sha2(F.array_join(F.col(KIDS)["hash"], ""), 256))
        nodes = found[-1].select(GROUP, AT, F.ceil(F.col(N) / FANOUT).cast("long").alias(N), parent.alias(HASH))
    return found, nodes.select(GROUP, HASH)


def _down(levels: Sequence[DataFrame], top: DataFrame) -> DataFrame:
    """The children of the lowest level, each with its PATH of (before, after) up to the root, and the other columns of its group's row in top (GROUP, PATH, ...)."""
    carried = [c for c in top.columns if c not in (GROUP, PATH)]
    up = top.withColumn(AT, F.lit(0).cast("long"))
    for runs in reversed(levels):
        digests = F.col(KIDS)["hash"]
        beside = F.transform(
            KIDS,
            lambda kid, i: F.struct(kid.alias("kid"), F.struct(F.array_join(F.slice(digests, 1, i), "").alias("before"), F.array_join(F.slice(digests, i + 2, F.lit(FANOUT)), "").alias("after")).alias("side")),
        )
        children = runs.join(up, [GROUP, AT]).select(GROUP, N, PATH, *carried, F.explode(beside).alias("c"))
        path = F.when(F.col(N) == 1, F.col(PATH)).otherwise(F.concat(F.array("c.side"), F.col(PATH)))
        up = children.select(GROUP, F.col("c.kid.at").alias(AT), F.col("c.kid").alias(own("kid")), path.alias(PATH), *carried)
        below = up
        up = up.drop(own("kid"))
    return below.select(GROUP, own("kid"), PATH, *carried)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", changed: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: its id, leaf, subroot, root, proof_sha256, folded_root and verified.

    changed has other values of some fields, as they are met at verification: folded_root
    is folded up from the leaf of these, where they differ, with the original siblings.
    The result is a table in the shared folder; the levels are removed.
    """
    now = leaf([(changed or {}).get(c, F.col(c)) for c in fields])
    group = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    rows = docs.select(F.col(id_col).alias(ID), group.alias(GROUP), leaf([F.col(c) for c in fields]).alias(HASH), (now if changed else F.lit(None).cast("string")).alias(CHANGED))
    with temporary():
        leaves = _indexed(materialise(rows, "manifest"), [ID, HASH])
        levels, subroots = _levels(leaves, [ID, CHANGED])
        lone = F.lit("").alias(GROUP)
        subroots = subroots.select(lone, F.col(GROUP).alias(TOP), HASH)
        upper, root = _levels(_indexed(subroots, [TOP]), [TOP])
        empty = F.array().cast("array<struct<before: string, after: string>>").alias(PATH)
        groups = _down(upper, root.select(GROUP, empty, F.col(HASH).alias(ROOT)))
        tops = groups.select(F.col(f"{own('kid')}.{TOP}").alias(GROUP), PATH, F.col(f"{own('kid')}.hash").alias(TOP), ROOT)
        proofs = _down(levels, tops).select(F.col(f"{own('kid')}.*"), PATH, TOP, ROOT)
        proof = F.sha2(F.aggregate(PATH, F.lit(""), lambda all_, side: F.concat(all_, side["before"], side["after"])), 256)
        folded = F.aggregate(PATH, F.coalesce(F.col(CHANGED), F.col("hash")), lambda node, side: _hash(side["before"], node, side["after"]))
        result = proofs.select(F.col(ID).alias(id_col), F.col("hash").alias("leaf"), F.col(TOP).alias("subroot"), F.col(ROOT).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
        return materialise(result.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest-rows", keep=True)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    changed = {"text": F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))}
    return manifest(read(spark, sf_dir, "documents"), changed=changed)


def _sql(deep: int = 6, wide: int = 4) -> str:
    """The rows by windows over deep levels of leaves and wide levels of subroots."""
    field = "coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    cells = " || ".join(field.format(c=c) for c in FIELDS[:-1])
    crc = "list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"
    steps = [
        f"t AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) % {TAMPERED} = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS other FROM documents)",
        f"h AS (SELECT doc_id, source AS g, sha256({cells} || {field.format(c='text')}) AS leaf, sha256({cells} || {field.format(c='other')}) AS changed FROM t)",
        "l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS c FROM h)",
        "n0 AS (SELECT g, i, c, leaf AS h FROM l)",
    ]
    side = "coalesce(string_agg(h, '') OVER (PARTITION BY {by}i // {f} ORDER BY i ROWS BETWEEN {rows}), '') AS {name}"
    sides = lambda by: ", ".join(side.format(by=by, f=FANOUT, rows=r, name=n) for r, n in (("UNBOUNDED PRECEDING AND 1 PRECEDING", "b"), ("1 FOLLOWING AND UNBOUNDED FOLLOWING", "a")))
    folded = f"CASE WHEN c = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (c + {FANOUT - 1}) // {FANOUT} AS c"
    for k in range(deep):
        steps.append(f"n{k + 1} AS (SELECT g, i // {FANOUT} AS i, {folded} FROM n{k} GROUP BY g, i // {FANOUT}, n{k}.c)")
        steps.append(f"s{k} AS (SELECT g, i, c, {sides('g, ')} FROM n{k})")
    steps.append(f"m0 AS (SELECT g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS c, h FROM n{deep})")
    for k in range(wide):
        steps.append(f"m{k + 1} AS (SELECT i // {FANOUT} AS i, {folded} FROM m{k} GROUP BY i // {FANOUT}, m{k}.c)")
        steps.append(f"u{k} AS (SELECT i, c, {sides('')} FROM m{k})")
    joins = " ".join(f"JOIN s{k} ON s{k}.g IS NOT DISTINCT FROM l.g AND s{k}.i = l.i // {prod([FANOUT] * k)}" for k in range(deep))
    joins += " JOIN m0 ON m0.g IS NOT DISTINCT FROM l.g " + " ".join(f"JOIN u{k} ON u{k}.i = m0.i // {prod([FANOUT] * k)}" for k in range(wide)) + f" CROSS JOIN m{wide} r"
    names = [f"s{k}" for k in range(deep)] + [f"u{k}" for k in range(wide)]
    steps.append(f"f0 AS (SELECT l.doc_id, l.leaf, m0.h AS subroot, r.h AS root, sha256({' || '.join(f'{x}.b || {x}.a' for x in names)}) AS proof_sha256, l.changed AS v, " + ", ".join(f"{x}.c AS c{k}, {x}.b AS b{k}, {x}.a AS a{k}" for k, x in enumerate(names)) + f" FROM l {joins})")
    for k in range(len(names)):
        steps.append(f"f{k + 1} AS (SELECT * REPLACE (CASE WHEN c{k} = 1 THEN v ELSE sha256(b{k} || v || a{k}) END AS v) FROM f{k})")
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, v AS folded_root, v = root AS verified FROM f{len(names)}"


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLES = {"op13_merkle_manifest": _sql()}
