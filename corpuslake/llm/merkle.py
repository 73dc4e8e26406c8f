"""Merkle manifest of a table: a digest for each row, a tree over each group's rows, a proof for each row.

Rows of a group are ranked by id. A rank in base ``fanout`` has a digit for each level of the tree,
and the digits are grouped away one after another: rows alike in all higher digits become one
row that nests them in order of the digit, with the digest of their digests. This is done within
blocks of ``fanout ** BLOCK_LEVELS`` consecutive ranks, so no row holds more than a block. All
groupings of a block share the one shuffle that brought it together. Block digests, one row a
block, are leaves of the next round, until each group has one block; the digests of groups are
the leaves of a last tree, whose top is the root.

Proofs come from the nested rows: a transform gives each child what stands before and after it
in its run, an explode opens the run, level by level. Leaves are never joined with anything;
a block meets its own path to the root, one row each.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FANOUT = 8
#: Levels of the tree within a block: 512 leaves, about 100 KB.
BLOCK_LEVELS = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as it enters a digest: ``-`` for null, else its length in UTF-8 bytes, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values' fields, one after another."""
    return F.sha2(F.concat(*map(field, values)), 256)


def together(digests: Column) -> Column:
    """Digest of an array of digests."""
    return F.sha2(F.array_join(digests, ""), 256)


def levels_of(count: Column, fanout: int) -> Column:
    """Levels that a tree over so many leaves has: the least power of ``fanout`` that holds them."""
    powers = [p for p in (fanout**k for k in range(63)) if p < 1 << 63]
    return sum(((F.lit(p) < count).cast("int") for p in powers[1:]), (F.lit(1) < count).cast("int"))


def ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """A stored table (grp, ...) with ``rank`` from 0 within its ``grp`` by ``order``, and ``n``, the group's rows.

    Rows are dealt by ranges of (grp, order, own place), so neither a large group nor rows alike
    meet in one task; a row's place is that in its range, counted on from the ranges before.
    """
    keys = [F.col("grp").asc_nulls_first(), *order, F.col("_row")]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    placed = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    ranges = placed.groupBy(F.col("grp").alias("_grp"), F.col("_range").alias("_r")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("_grp")  # a row for each range that the group touches
    before = F.coalesce(F.sum("_n").over(group.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("_grp", "_r", "_first", before.alias("_before"), F.sum("_n").over(group).alias("n"))
    joined = placed.join(starts, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("_range") == F.col("_r")))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("rank"), "n")


def nested(nodes: DataFrame, fanout: int) -> DataFrame:
    """(grp, left, block, node, kids) of nodes (grp, left, rank, node, item): ``left`` is the number of levels above a node, ``kids`` the nested runs below the block's digest."""
    digits = [F.expr(f"rank div {fanout**i} % {fanout}").cast("int").alias(f"digit_{i}") for i in range(BLOCK_LEVELS)]
    rows = nodes.select("grp", "left", F.expr(f"rank div {fanout**BLOCK_LEVELS}").alias("block"), *digits, "node", F.col("item").alias("kids"))
    rows = rows.repartition("grp", "block")  # each grouping below is of finer keys
    for i in range(BLOCK_LEVELS):
        higher = [f"digit_{j}" for j in range(i + 1, BLOCK_LEVELS)]
        run = F.array_sort(F.collect_list(F.struct(F.col(f"digit_{i}").alias("digit"), "node", "kids")))
        rows = rows.groupBy("grp", "left", "block", *higher).agg(run.alias("kids"))
        # above a group's top a run has one node, which stays as it is
        rows = rows.withColumn("node", F.when(F.col("left") > i, together(F.col("kids.node"))).otherwise(F.col("kids")[0]["node"]))
    return rows


def proofs(nodes: DataFrame, most: int, fanout: int, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(grp, item, node, path, subroot, root) of nodes (grp, left, rank, node, item), no group of more than ``most``.

    ``path`` lists, from the node's run upwards, the digests ``before`` and ``after`` it, joined.
    ``above`` gives (grp, path, subroot, root) of the tops (grp, node) of all groups.
    """
    blocks, size = stored(nested(nodes, fanout), "blocks"), fanout**BLOCK_LEVELS
    if most <= size:
        tops = above(blocks.select("grp", "node")).withColumn("block", F.lit(0).cast("long"))
    else:
        next_nodes = blocks.select("grp", F.greatest(F.col("left") - BLOCK_LEVELS, F.lit(0)).alias("left"), F.col("block").alias("rank"), "node", F.struct("block").alias("item"))
        tops = proofs(next_nodes, -(-most // size), fanout, above).withColumn("block", F.col("item.block"))
    tops = tops.select(F.col("grp").alias("_grp"), F.col("block").alias("_block"), "path", "subroot", "root")
    rows = blocks.join(tops, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_block")))
    for i in reversed(range(BLOCK_LEVELS)):
        others = F.col("kids.node")

        def child(kid: Column, at: Column) -> Column:
            before, after = F.slice(others, F.lit(1), at), F.slice(others, at + 2, F.size(others))
            return F.struct(kid["node"].alias("node"), kid["kids"].alias("kids"), F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))

        rows = rows.select("grp", "left", "path", "subroot", "root", F.explode(F.transform("kids", child)).alias("kid"))
        step = F.struct("kid.before", "kid.after")
        path = F.when(F.col("left") > i, F.concat(F.array(step), "path")).otherwise(F.col("path"))
        rows = rows.select("grp", "left", path.alias("path"), "subroot", "root", "kid.node", "kid.kids")
    return rows.select("grp", F.col("kids").alias("item"), "node", "path", "subroot", "root")


def tree(nodes: DataFrame, order: Sequence[Column], fanout: int, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """:func:`proofs` of a stored table (grp, node, item), ranked within grp by ``order``."""
    placed = ranked(nodes, order)
    most = placed.agg(F.max("n")).first()[0] or 0
    return proofs(placed.select("grp", levels_of(F.col("n"), fanout).alias("left"), "rank", "node", "item"), most, fanout, above)


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "lang", id_col: str = "doc_id", carry: Mapping[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``docs``: (doc_id, leaf, path, subroot, root), and the columns ``carry`` computed from ``docs``.

    ``leaf`` is the digest of ``columns``. Within a group leaves ascend by id, and every ``fanout``
    consecutive nodes become their digest until one is left, the subroot; subroots, by group,
    likewise give the root. ``path`` is the proof, for :func:`folded` and :func:`siblings`.

    Defined cases: a null group is a group of its own and comes first; a null id comes before all
    others; rows of one id are ordered by leaf, so rows alike all count, each at a place of its own;
    a lone leaf is its subroot and has an empty path if its group is alone; whole texts are read
    whatever their length; an empty table gives no rows; columns not named are ignored, and those of
    ``carry`` may have any names but those above.
    """
    carry = carry or {}
    item = F.struct(F.col(id_col).alias("id"), *(c.alias(f"carry_{i}") for i, c in enumerate(carry.values())))
    leaves = stored(docs.select(F.col(group).alias("grp"), digest(*map(F.col, columns)).alias("node"), item.alias("item")), "leaves")

    def over_groups(tops: DataFrame) -> DataFrame:
        """Path, subroot and root of each group's top, from the tree over all groups."""
        one = stored(tops.select(F.lit(0).alias("grp"), "node", F.struct(F.col("grp").alias("own")).alias("item")), "groups")
        found = tree(one, [F.col("item.own").asc_nulls_first()], fanout, lambda top: top.select("grp", F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root")))
        return found.select(F.col("item.own").alias("grp"), "path", F.col("node").alias("subroot"), "root")

    rows = tree(leaves, [F.col("item.id").asc_nulls_first(), F.col("node")], fanout, over_groups)
    return rows.select(F.col("item.id").alias(id_col), F.col("node").alias("leaf"), "path", "subroot", "root", *(F.col(f"item.carry_{i}").alias(name) for i, name in enumerate(carry)))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def siblings(path: Column) -> Column:
    """Digest of all digests of a path, level by level, left to right."""
    return together(F.transform(path, lambda step: F.concat(step["before"], step["after"])))


def tampered_leaf(columns: Sequence[str] = COLUMNS) -> Column:
    """The leaf of a row whose text has been lower-cased (A-Z), where 3 divides the CRC-32 of its id; null elsewhere."""
    upper = "".join(map(chr, range(65, 91)))
    changed = {"text": F.translate("text", upper, upper.lower())}
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, digest(*(changed.get(c, F.col(c)) for c in columns)))


def checked(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, checked against a copy in which a third of the texts were lower-cased.

    One row per row: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the copy's leaf), verified.
    A null doc_id is never tampered with; see :func:`manifest` for all other cases.
    """
    rows = manifest(docs, carry={"tampered": tampered_leaf()})
    again = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    found = rows.select("doc_id", "leaf", "subroot", "root", siblings(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(fanout: int = FANOUT, levels: int = 5) -> str:
    """DuckDB SQL for the rows of :func:`checked`, for groups of up to ``fanout ** levels`` rows and as many groups; ids are told apart."""
    from .sharding import _crc_table

    def leaf(text: str) -> str:
        parts = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"

    crc = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
        lambda c, x: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)"""

    def climb(name: str, start: str) -> tuple[list[str], str, list[str]]:
        """CTEs of the levels over ``start`` (grp, rank, node), with what stands before and after each node; the last one's name; the names of the levels."""
        ctes, last, steps = [], start, []
        for i in range(levels):
            w = f"PARTITION BY grp, rank // {fanout} ORDER BY rank"
            ctes.append(f"""{name}s{i} AS (SELECT grp, rank, node, count(*) OVER (PARTITION BY grp) > 1 AS real,
                coalesce(string_agg(node, '') OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
                coalesce(string_agg(node, '') OVER ({w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM {last})""")
            last = f"{name}{i + 1}"
            ctes.append(f"{last} AS (SELECT grp, rank // {fanout} AS rank, CASE WHEN bool_or(real) THEN sha256(string_agg(node, '' ORDER BY rank)) ELSE any_value(node) END AS node FROM {name}s{i} GROUP BY grp, rank // {fanout})")
            steps.append(f"{name}s{i}")
        return ctes, last, steps

    low, top, low_steps = climb("l", "l0")
    high, root, high_steps = climb("g", "g0")
    joins = [f"JOIN {s} ON {s}.grp IS NOT DISTINCT FROM l0.grp AND {s}.rank = l0.rank // {fanout**i}" for i, s in enumerate(low_steps)]
    joins += ["JOIN g0 ON g0.own IS NOT DISTINCT FROM l0.grp", *(f"JOIN {s} ON {s}.rank = g0.rank // {fanout**i}" for i, s in enumerate(high_steps))]
    steps = [*low_steps, *high_steps]
    proof = " || ".join(f"{s}.pre || {s}.post" for s in steps)
    # folded one level a CTE, since each level names the one below twice
    folds, before = [], "w"
    for i, s in enumerate(steps):
        folds.append(f"f{i} AS (SELECT * EXCLUDE (x), CASE WHEN real_{i} THEN sha256(pre_{i} || x || post_{i}) ELSE x END AS x FROM {before})")
        before = f"f{i}"
    wide = ", ".join(f"{s}.real AS real_{i}, {s}.pre AS pre_{i}, {s}.post AS post_{i}" for i, s in enumerate(steps))
    changed = leaf(f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')")
    return f"""
    WITH l0 AS (SELECT lang AS grp, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rank, {leaf("text")} AS node,
        CASE WHEN {crc} % 3 = 0 THEN {changed} END AS changed FROM documents),
    {", ".join(low)},
    g0 AS (SELECT 0 AS grp, grp AS own, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS rank, node FROM {top}),
    {", ".join(high)},
    w AS (SELECT l0.doc_id, l0.node AS leaf, g0.node AS subroot, t.node AS root, sha256({proof}) AS proof_sha256, {wide}, coalesce(l0.changed, l0.node) AS x
        FROM l0 {" ".join(joins)} CROSS JOIN {root} t),
    {", ".join(folds)}
    SELECT doc_id, leaf, subroot, root, proof_sha256, x AS folded_root, x = root AS verified FROM {before}"""
