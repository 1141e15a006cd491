"""Merkle manifest of a table of documents, and a proof for each of them checked by climbing.

Every document is a leaf, each source a tree of runs of 16, and the sources' subroots another such tree. The levels are
built bottom up, each from the one below, and kept as node rows linked to their parents, with the digests that stand
before and after a node in its run. A recursive query then climbs from the leaves: at each step it looks up the parent,
appends the siblings to the proof, and folds the (possibly tampered) digest with them. The leaves of one run share every
sibling above them, so they climb together: one row a run carries one proof and a folded digest for each leaf.

Only digests are shuffled, never texts. Leaves are numbered within their source without a task that sees a whole source:
rows are dealt by range, counted per partition and source, and numbered by partition from the sums of the counts.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.shared import settled

RUN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of subroots; trees of sources are named by ``s`` and the source, or ``n`` for null.
TOP = ""
_ROWS = "spark.sql.cteRecursionRowLimit"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """Digest of a document's fields, with ``text`` in place of its own."""
    return digest(*(_field(F.col(c) if c != "text" or text is None else text) for c in COLUMNS))


def tampered(text: Column) -> Column:
    """The text that an audit finds in place of ``text``: A-Z in lower case where 5 divides the crc32 of the id."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate(text, upper, upper.lower())).otherwise(text)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their place by ``order`` among those of one ``group`` from 0, and ``n``, that group's rows.

    Rows that agree in all of these are told apart at random, so that copies of one row spread over partitions too.
    """
    dealt = settled(rows.withColumn("_tie", F.rand(16)).repartitionByRange(F.col(group), *order, "_tie").withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part", group).count()
    parts = Window.partitionBy(group)
    counts = counts.select("_part", group, (F.sum("count").over(parts.orderBy("_part")) - F.col("count")).alias("_before"), F.sum("count").over(parts).alias("n"))
    own = Window.partitionBy("_part", group).orderBy(*order, "_tie")
    placed = dealt.withColumn("_own", F.row_number().over(own)).join(counts, ["_part", group])
    return placed.withColumn("idx", F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before", "_tie")


def _others(digests: Column, i: Column) -> tuple[Column, Column]:
    """What stands before and after place ``i`` of a run, joined."""
    return F.array_join(F.slice(digests, F.lit(1), i), ""), F.array_join(F.slice(digests, i + 2, F.lit(RUN)), "")


def _name(tree: Column, level: Column, idx: Column) -> Column:
    return F.concat_ws("|", level.cast("string"), idx.cast("string"), tree)


def _runs(nodes: DataFrame, level: int, *extra: str) -> DataFrame:
    """The level above ``nodes``: ``tree, idx, n, hash, kids``; trees of one node are done and have none."""
    up = nodes.where("n > 1").groupBy("tree", F.floor(F.col("idx") / RUN).alias("up"), F.ceil(F.col("n") / RUN).alias("of"))
    up = up.agg(F.array_sort(F.collect_list(F.struct("idx", "hash", "name", *extra))).alias("kids"))  # at most RUN of them
    up = up.select("tree", F.col("up").alias("idx"), F.col("of").alias("n"), digest(F.array_join("kids.hash", "")).alias("hash"), "kids")
    return up.withColumn("name", _name(F.col("tree"), F.lit(level), F.col("idx")))


def _links(runs: DataFrame, subroots: bool) -> DataFrame:
    """Node rows of a level: ``node, parent, place, hash, before, after, subroot``."""
    rows = runs.select(F.col("name").alias("parent"), "kids.hash", F.posexplode("kids").alias("place", "kid"))
    before, after = _others(F.col("hash"), F.col("place"))
    return rows.select(F.col("kid.name").alias("node"), "parent", "place", F.col("kid.hash").alias("hash"), before.alias("before"), after.alias("after"), F.when(F.lit(subroots), F.col("kid.hash")).alias("subroot"))


def _height(nodes: DataFrame) -> int:
    n, levels = nodes.agg(F.max("n")).first()[0] or 0, 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


def build(docs: DataFrame, extra: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame, str | None, str | None]:
    """The manifest of ``docs``: its runs of leaves, its other nodes, and the name and digest of the root.

    Runs of leaves are ``name, kids``: the node above them, and ``idx, hash, name, doc_id`` and ``extra`` of each leaf; a
    lone leaf is its own node. Other nodes are rows of ``node, parent, place, hash, before, after, subroot``. Repeated
    rows are a leaf each. Rows without id come first, those without source are a source of their own, before all others.
    An empty table has no root.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("tree")
    rows = docs.select(tree, F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("hash"), *(c.alias(n) for n, c in (extra or {}).items()))
    leaves = settled(numbered(rows, "tree", ["doc_id", "hash"]).withColumn("name", _name(F.col("tree"), F.lit(0), F.col("idx"))))
    kids = ["doc_id", *(extra or {})]
    single = leaves.where("n = 1").select("name", F.array(F.struct("idx", "hash", "name", *kids)).alias("kids"))
    starts, links, ends, level = single, [], [leaves.where("n = 1").select("tree", "hash", "name")], leaves
    for i in range(1, _height(leaves) + 1):
        level = settled(_runs(level, i, *(kids if i == 1 else ())))
        if i == 1:
            starts = single.unionByName(level.select("name", "kids"))
        else:
            links.append(_links(level, False))
        ends.append(level.where("n = 1").select("tree", "hash", "name"))
        level = level.drop("kids")
    subroots = ends[0]
    for e in ends[1:]:
        subroots = subroots.unionByName(e)
    # The tree of subroots, in order of the sources' names.
    level = settled(numbered(subroots.withColumn("top", F.lit(TOP)), "top", ["tree"]).select(F.lit(TOP).alias("tree"), "idx", "n", "hash", "name"))
    for i in range(1, _height(level) + 1):
        runs = settled(_runs(level, i))
        links.append(_links(runs, i == 1))
        level = runs.drop("kids")
    root = level.select("name", "hash").first() or (None, None)
    nodes = starts.sparkSession.createDataFrame([], "node string, parent string, place int, hash string, before string, after string, subroot string")
    for link in links:
        nodes = nodes.unionByName(link)
    return starts, nodes, *root


CLIMB = """
    WITH RECURSIVE climb(start, node, folded, proof, subroot) AS (
        SELECT name, name, folded, '', CAST(NULL AS STRING) FROM {starts}
        UNION ALL
        SELECT c.start, n.parent, transform(c.folded, f -> sha2(concat(n.before, f, n.after), 256)), concat(c.proof, n.before, n.after), coalesce(c.subroot, n.subroot)
        FROM climb c JOIN {nodes} n ON c.node = n.node
    )
    SELECT start AS name, folded, proof, subroot FROM climb WHERE node = :root"""


def climbed(starts: DataFrame, nodes: DataFrame, root: str) -> DataFrame:
    """``name, folded, proof, subroot`` of every run at node ``root``; ``starts`` has ``name`` and the digests ``folded``.

    The recursion is as deep as the trees are high. Its limit of rows is lifted while it runs.
    """
    spark = starts.sparkSession
    limit = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, "-1")
    try:
        return settled(spark.sql(CLIMB, args={"root": root}, starts=starts, nodes=nodes))
    finally:
        spark.conf.set(_ROWS, limit)


def verify(docs: DataFrame, found: Column) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row, with ``found`` for its text.

    The manifest is that of ``docs``; ``found`` is the text an audit finds, null included. See :func:`build` for rows
    without id or source, repeated rows and empty tables. Only the five columns of a leaf matter, others may have any names.
    """
    starts, nodes, name, root = build(docs.select(*COLUMNS), {"found": leaf(found)})
    nodes = settled(nodes)
    own = F.transform("kids", lambda kid, i: F.concat(*_others(F.col("kids.hash"), i)))
    alone = F.size("kids") == 1
    # A run of one leaf has a node above it, unless the leaf is its tree.
    whole = alone & (F.element_at("kids", 1)["name"] == F.col("name"))
    fold = F.transform("kids", lambda kid, i: F.when(whole, kid["found"]).otherwise(digest(_others(F.col("kids.hash"), i)[0], kid["found"], _others(F.col("kids.hash"), i)[1])))
    up = climbed(starts.select("name", fold.alias("folded")), nodes, name or "")
    rows = starts.withColumn("own", own).join(up, "name").select("subroot", "proof", F.explode(F.arrays_zip("kids", "own", "folded")).alias("x"))
    out = rows.select(
        F.col("x.kids.doc_id").alias("doc_id"), F.col("x.kids.hash").alias("leaf"), F.coalesce("subroot", F.lit(root).cast("string")).alias("subroot"), F.lit(root).cast("string").alias("root"),
        digest(F.col("x.own"), F.col("proof")).alias("proof_sha256"), F.col("x.folded").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_report(docs: DataFrame) -> DataFrame:
    """The report of an audit that finds every fifth text, about, in lower case."""
    return verify(docs, tampered(F.col("text")))


def _oracle(levels: int = 8, tops: int = 4) -> str:
    """DuckDB SQL for ``manifest_report``'s rows, for sources of at most 16 ** levels rows and 16 ** tops sources."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    hashed = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in COLUMNS) + ")"
    upper = "".join(map(chr, range(65, 91)))
    # crc32 by its definition: eight shifts a byte.
    shift = "list_reduce(range(8), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)), xor(c, CAST(ord(ch) AS BIGINT)))"
    crc = f"xor(list_reduce(string_split(CAST(doc_id AS VARCHAR), ''), lambda c, ch: {shift}, CAST(4294967295 AS BIGINT)), 4294967295)"
    parts = [f"""
        d AS (
            SELECT CAST(doc_id AS BIGINT) doc_id, coalesce('s' || source, 'n') tree, {hashed('text')} leaf,
                CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {hashed(f"translate(text, '{upper}', '{upper.lower()}')")} ELSE {hashed('text')} END found
            FROM documents
        ), l0 AS (SELECT row_number() OVER () r, doc_id, tree, leaf, leaf h, found f, '' proof, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 i FROM d)"""]

    def climb(before: str, after: str, tree: str) -> str:
        """One level up: nodes without company stay as they are; of a node's rows, the first stands for it."""
        return f"""
        n{after} AS (SELECT {tree} tree, i, any_value(h) h, max(max(i)) OVER (PARTITION BY {tree}) most FROM {before} GROUP BY {tree}, i),
        r{after} AS (SELECT tree, i // {RUN} i, string_agg(h, '' ORDER BY i) s FROM n{after} GROUP BY tree, i // {RUN}),
        {after} AS (
            SELECT l.* EXCLUDE (h, f, proof, i), CASE WHEN most = 0 THEN l.h ELSE sha256(s) END h,
                CASE WHEN most = 0 THEN f ELSE sha256(s[:(l.i % {RUN}) * 64] || f || s[(l.i % {RUN}) * 64 + 65:]) END f,
                CASE WHEN most = 0 THEN proof ELSE proof || s[:(l.i % {RUN}) * 64] || s[(l.i % {RUN}) * 64 + 65:] END proof, l.i // {RUN} i
            FROM {before} l JOIN n{after} n ON n.tree = l.{tree} AND n.i = l.i JOIN r{after} r ON r.tree = l.{tree} AND r.i = l.i // {RUN})"""

    parts += [climb(f"l{k}", f"l{k + 1}", "tree") for k in range(levels)]
    parts.append(f"t0 AS (SELECT * EXCLUDE (i), h subroot, '' top, dense_rank() OVER (ORDER BY tree) - 1 i FROM l{levels})")
    parts += [climb(f"t{k}", f"t{k + 1}", "top") for k in range(tops)]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h root, sha256(proof) proof_sha256, f folded_root, f = h verified FROM t{tops}"


ORACLE = _oracle()
