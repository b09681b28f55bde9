"""Merkle manifest of a dataset: a persistent hash tree whose versions copy paths and share the rest.

A row's leaf is the digest of its columns.  The leaves of one source, by ascending
id, are hashed in runs of 16 until one node remains, its *subroot*; the subroots,
by source, are hashed likewise into the *root*.

The tree is kept as *aligned blocks*: a block holds 256 consecutive nodes of one
level and the two levels above them, so that a tree of any size is a table of
blocks of bounded size, with a next table of blocks over their tops, and so on.
Nothing sees more than one block at a time.

A changed leaf makes a version of the tree.  It owns copies of the changed leaf's
ancestors only: those inside the leaf's block first, then, along the *path* of
the block (the siblings on its way to the root, which all of its leaves share), the
upper ones.  All other nodes of the version are those of the base tree.

Everything is DataFrame code: one sort by (source, id), one aggregate per two
levels, one join per two levels on the way down.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions.binding import let
from pagesift.llm.common import column
from pagesift.sources.scratch import cut

#: Nodes that make one node of the next level (fixed value of the contract).
FAN_OUT = 16
#: Levels above its lowest one that a block holds, and its width there.
LEVELS = 2
WIDTH = FAN_OUT**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def item(value: Column) -> Column:
    """A value in a digest's input: byte count, colon, value; a dash for null.  Whole numbers are decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*map(item, values)))


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


# --- leaves and their places ------------------------------------------------------


def leaves(docs: DataFrame, columns=COLUMNS, id_col="doc_id", source_col="source", edits=None, where: Column | None = None) -> DataFrame:
    """``id, source, leaf, changed``: the digest of each row and, where ``where`` holds, of the row after ``edits``.

    ``edits`` maps column names to expressions; ``changed`` is null for rows that are not edited.
    """
    edits = edits or {}
    before = [column(c) for c in columns]
    after = [edits.get(c, column(c)) for c in columns]
    changed = F.when(where, leaf(after)) if where is not None else F.lit(None).cast("string")
    return docs.select(column(id_col).alias("id"), column(source_col).alias("source"), leaf(before).alias("leaf"), changed.alias("changed"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``tree`` (number of the source), ``height`` of that tree, and ``pos`` of the leaf in it.

    Sources ascend by bytes, null first; so do ids within a source, ties by leaf.  A
    range partitioning sorts all rows (equal rows are told apart by their place in the
    input, so that a crowd of them is split too); each task counts its rows, and the
    counts, a few numbers per task and source, give the places.
    """
    order = [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf").asc(), F.col("nth").asc()]
    told_apart = cut(rows.withColumn("nth", F.monotonically_increasing_id()))
    ranged = told_apart.repartitionByRange(*order).sortWithinPartitions(*order).drop("nth")
    ranged = cut(ranged.withColumn("line", F.monotonically_increasing_id()).withColumn("part", F.shiftright("line", 33)))
    counts = cut(ranged.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first")))
    trees = counts.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("leaves"))
    trees = trees.select("s", height_of(F.col("leaves")).alias("height"), (F.row_number().over(Window.orderBy(F.col("s").asc_nulls_first())) - 1).cast("long").alias("tree"))
    so_far = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    starts = counts.withColumn("before", so_far - F.col("n")).join(trees, F.col("source").eqNullSafe(F.col("s")))
    starts = starts.select(F.col("part").alias("p"), "s", "first", "before", "tree", "height")
    at = ranged.join(starts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return at.select("id", "leaf", "changed", "tree", "height", (F.col("before") + F.col("line") - F.col("first")).alias("pos"))


def height_of(nodes: Column) -> Column:
    """Levels above so many leaves: the least h with 16^h >= nodes."""
    powers = F.array(*[F.lit(FAN_OUT**h).cast("long") for h in range(16)])
    return F.size(F.filter(powers, lambda p: p < nodes))


# --- the tree as blocks -----------------------------------------------------------


def runs(nodes: Column) -> Column:
    """The next level: the digest of each 16 consecutive nodes, the last run shorter."""
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(FAN_OUT))
    return F.transform(starts, lambda at: digest(F.array_join(F.slice(nodes, at, FAN_OUT), "")))


def blocks(nodes: DataFrame, level: int, payload: tuple[str, ...] = ()) -> DataFrame:
    """Aligned blocks over the nodes of one level: ``tree, height, block, members, levels``.

    ``members`` are the nodes in order, with their payload, 256 at most; ``levels``
    their digests, then those of the levels above them, up to the block's one top.
    """
    members = F.sort_array(F.collect_list(F.struct("pos", "digest", *payload)))
    grouped = nodes.groupBy("tree", "height", F.floor(F.col("pos") / WIDTH).alias("block")).agg(members.alias("members"))
    up = F.least(F.col("height") - level, F.lit(LEVELS))
    steps = F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), up)
    grown = F.aggregate(steps, F.array(F.col("members.digest")), lambda found, _: F.concat(found, F.array(runs(F.element_at(found, -1)))))
    return grouped.withColumn("levels", grown)


@dataclass(frozen=True)
class Forest:
    """Trees over numbered leaves: ``stages[k]`` are the blocks that start at level 2k, ``roots`` is ``tree, digest``."""

    stages: list[DataFrame]
    roots: DataFrame


def grow(nodes: DataFrame, payload: tuple[str, ...] = ()) -> Forest:
    """All trees over ``nodes`` (``tree, height, pos, digest`` and the payload of the leaves), two levels a round."""
    stages, roots, level = [], [], 0
    highest = None
    while True:
        stage = cut(blocks(nodes, level, payload if level == 0 else ()))
        stages.append(stage)
        tops = stage.select("tree", "height", F.col("block").alias("pos"), F.element_at(F.element_at("levels", -1), 1).alias("digest"))
        level += LEVELS
        roots.append(tops.filter(F.col("height") <= level).select("tree", "digest"))
        highest = stage.agg(F.max("height")).first()[0] if highest is None else highest
        if (highest or 0) <= level:
            break
        nodes = tops.filter(F.col("height") > level)
    done = roots[0]
    for more in roots[1:]:
        done = done.unionByName(more)
    return Forest(stages, done)


# --- paths and versions -----------------------------------------------------------


def siblings(levels: Column, index: Column) -> Column:
    """For each level of a block but its top: the digests before and after a member's ancestor in its run of 16."""

    def around(nodes: Column, level: Column) -> Column:
        place = F.floor(index / F.pow(F.lit(float(FAN_OUT)), level)).cast("int")

        def of(p: Column) -> Column:
            at = p % FAN_OUT
            return F.struct(
                F.array_join(F.slice(nodes, p - at + 1, at), "").alias("before"),
                F.array_join(F.slice(nodes, p + 2, F.lit(FAN_OUT - 1) - at), "").alias("after"),
            )

        return let(place, of)

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), around)


def descend(forest: Forest, above: DataFrame) -> DataFrame:
    """The lowest blocks with ``path``: the siblings on the way from a block's top to the root.

    ``above`` is ``tree, path`` and what else belongs to a tree; a tree's path is that of its root.
    """
    extra = [c for c in above.columns if c not in ("tree", "path")]
    paths = None
    for k in range(len(forest.stages) - 1, -1, -1):
        stage = forest.stages[k]
        # Trees whose top lies in this stage: one block each.
        ends = F.col("height") <= LEVELS * (k + 1)
        tops = stage.filter(ends).join(above, "tree")
        if paths is not None:
            # A path is long and compresses well: the size of its file would have it broadcast.
            tops = tops.unionByName(stage.filter(~ends).join(paths.hint("merge"), ["tree", "block"]))
        if k == 0:
            return tops
        each = tops.select("tree", "levels", "path", *extra, F.posexplode("members").alias("i", "member"))
        paths = cut(each.select(
            "tree", F.col("member.pos").alias("block"), F.concat(siblings(F.col("levels"), F.col("i")), F.col("path")).alias("path"), *extra
        ))


def folded(own: Column, path: Column) -> Column:
    """The nodes from a leaf's parent to the root, recomputed from the leaf and its siblings: the copies that a version owns."""
    return F.slice(
        F.aggregate(
            path, F.array(own), lambda found, step: F.concat(found, F.array(digest(F.concat(step["before"], F.element_at(found, -1), step["after"]))))
        ),
        F.lit(2),
        F.size(path),
    )


#: Type of a path, for the one of the root, which is empty.
PATH = "array<struct<before:string,after:string>>"


@dataclass(frozen=True)
class Manifest:
    """The base tree (``sources``, ``top``: trees over the leaves of each source, and over the subroots) and its root.

    ``rows`` has one row per leaf: ``id, tree, pos, leaf, changed, subroot, path``.  All but
    ``rows``, which is derived on reading, are written tables.
    """

    sources: Forest
    top: Forest
    root: str | None
    rows: DataFrame


def manifest(marked: DataFrame) -> Manifest:
    """The tree over ``leaves``; an empty table has no root and no rows."""
    nodes = placed(marked).withColumnRenamed("leaf", "digest")
    sources = grow(nodes, ("id", "changed"))
    every = Window.partitionBy()
    subroots = cut(sources.roots.withColumn("height", height_of(F.count(F.lit(1)).over(every))))
    top = grow(subroots.select(F.lit(0).cast("long").alias("tree"), "height", F.col("tree").alias("pos"), "digest"))
    root = top.roots.first()
    nothing = top.roots.select("tree", F.from_json(F.lit("[]"), PATH).alias("path"))
    upper = descend(top, nothing).select("levels", "path", F.posexplode("members").alias("i", "member"))
    above = cut(upper.select(
        F.col("member.pos").alias("tree"),
        F.concat(siblings(F.col("levels"), F.col("i")), F.col("path")).alias("path"),
        F.col("member.digest").alias("subroot"),
    ))
    lowest = descend(sources, above).select("tree", "levels", "path", "subroot", F.posexplode("members").alias("i", "member"))
    rows = lowest.select(
        F.col("member.id").alias("id"),
        "tree",
        F.col("member.pos").alias("pos"),
        F.col("member.digest").alias("leaf"),
        F.col("member.changed").alias("changed"),
        "subroot",
        F.concat(siblings(F.col("levels"), F.col("i")), F.col("path")).alias("path"),
    )
    return Manifest(sources, top, root.digest if root else None, rows)


def versions(built: Manifest) -> DataFrame:
    """The nodes that versions own: ``tree, pos`` (of the changed leaf, which names the version), ``level, digest``.

    Level 0 is the changed leaf; levels go on from the tree's subroot into the upper
    tree.  A node of a version that is not here is the base tree's.
    """
    changed = built.rows.filter("changed is not null")
    copies = F.concat(F.array("changed"), folded(F.col("changed"), F.col("path")))
    return changed.select("tree", "pos", F.posexplode(copies).alias("level", "digest"))


def verification(built: Manifest) -> DataFrame:
    """One row per leaf: ``doc_id, leaf, subroot, root, proof_sha256`` of the base tree, and of the leaf's own
    version (the base tree, if it was not changed) ``folded_root, verified, levels``.

    ``proof_sha256`` is the digest of all siblings on the way up; ``levels`` the number of ancestors.
    """
    rows = built.rows
    proof = digest(F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), ""))
    # A lone leaf of a lone source is the root itself.
    copies = F.concat(F.array(F.coalesce("changed", "leaf")), folded(F.coalesce("changed", "leaf"), F.col("path")))
    out = rows.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        F.lit(built.root).cast("string").alias("root"),
        proof.alias("proof_sha256"),
        F.element_at(copies, -1).alias("folded_root"),
        F.size("path").alias("levels"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The check of a manifest against rows that were changed behind its back: see ``verification``.

    Rows whose id's CRC-32 is divisible by five have A-Z in their text lower-cased (a text
    without capitals, or a null one, stays, and verifies).  Null ids come first in
    their source and are not changed; equal ids are ordered by leaf; repeated rows are
    leaves of their own; a null source comes first.  An empty table gives no rows.  Columns
    other than those of ``COLUMNS`` are not looked at.
    """
    hit = F.coalesce(F.crc32(column(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return verification(manifest(leaves(docs, edits={text_col: lower_ascii(column(text_col))}, where=hit, id_col=id_col)))


def oracle(tree_levels: int = 7, top_levels: int = 4) -> str:
    """SQL of the query, for up to 16^7 leaves a source and 16^4 sources."""

    def sql_leaf(text: str) -> str:
        parts = [f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    def tree(name: str, many: int) -> list[str]:
        steps = []
        for k in range(many):
            steps.append(f"""{name}_s{k} as (select t, pos, n > 1 as more, n,
  coalesce(string_agg(h, '') over (partition by t, pos // 16 order by pos rows between unbounded preceding and 1 preceding), '') as before,
  coalesce(string_agg(h, '') over (partition by t, pos // 16 order by pos rows between 1 following and unbounded following), '') as after
  from {name}{k})""")
            steps.append(f"""{name}{k + 1} as (select t, pos // 16 as pos, sha256(string_agg(h, '' order by pos)) as h, (max(n) + 15) // 16 as n
  from {name}{k} where n > 1 group by t, pos // 16 union all select t, pos, h, n from {name}{k} where n = 1)""")
        return steps

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "flatten(list_transform(range(1, strlen(doc_id::varchar) + 1), lambda i: [ascii(substr(doc_id::varchar, i, 1)), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce({bits}::bigint[], lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::bigint), 4294967295)"
    steps = [
        f"l as (select doc_id, source, {sql_leaf('text')} as leaf, case when {crc} % 5 = 0 then {sql_leaf(lower)} end as changed from documents)",
        """p as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
  count(*) over (partition by source) as n, dense_rank() over (order by source nulls first) - 1 as t from l)""",
        "a0 as (select t, pos, leaf as h, n from p)",
        *tree("a", tree_levels),
        f"b0 as (select 0 as t, t as pos, h, count(*) over () as n from a{tree_levels})",
        *tree("b", top_levels),
    ]
    places = [(f"a_s{k}", f"x{k}", f"x{k}.t = p.t and x{k}.pos = p.pos // {16**k}") for k in range(tree_levels)]
    places += [(f"b_s{k}", f"y{k}", f"y{k}.pos = p.t // {16**k}") for k in range(top_levels)]
    folds = ["f0 as (select p.*, coalesce(p.changed, p.leaf) as f, '' as proof, 0 as levels from p)"]
    for i, (name, alias, on) in enumerate(places):
        folds.append(f"""f{i + 1} as (select p.* exclude (f, proof, levels),
  case when {alias}.more then sha256({alias}.before || p.f || {alias}.after) else p.f end as f,
  p.proof || case when {alias}.more then {alias}.before || {alias}.after else '' end as proof,
  p.levels + {alias}.more::int as levels from f{i} p join {name} {alias} on {on})""")
    last = f"f{len(places)}"
    return f"""with {", ".join([*steps, *folds])}
select p.doc_id, p.leaf, a.h as subroot, b.h as root, sha256(p.proof) as proof_sha256, p.f as folded_root, p.f = b.h as verified, p.levels
from {last} p join a{tree_levels} a on a.t = p.t join b{top_levels} b on true"""


ORACLE = oracle()
