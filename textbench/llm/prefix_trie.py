"""Prefix trie of conversations by halves, after van Emde Boas.

Sequences of turns are cut at half their depth, and again and again, down to single
turns. On the way up equal pieces get equal names, a piece's name following from those of
its halves. On the way down the distinct pieces of one trie are cut: their upper halves,
each once, are the upper trie; every distinct upper half names a cut prefix, by its
smallest member, and the lower halves below it are a forest of that name. The upper trie
and all lower forests, of all pieces of a size, are cut in one step, so a trie of depth L
takes log2(L) steps. Pieces of one turn are the nodes. Then totals are grafted upward: a
node's total over its first 2^k levels and those of the nodes 2^k levels below it make
its total over twice as many levels.

What moves are names and counts, never texts; equal sequences are one row from the top
on, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.llm.streams import digests
from textbench.operators.rows import sorted_numbers
from textbench.session import materialize

#: Conversations of one hundred share first turns with the first of them, fewer than so many.
SHARED = 6
HUNDRED = 100
#: Range of ids whose digest parts are joined by one task ahead of the digest.
PART = 1024
NODES = "conv_id bigint, depth bigint, parent bigint, n bigint, points bigint, ending bigint"
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _null_safe(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, turn): the turns of each conversation from 0 on, by a hash of role
    and text with the text's code points after a colon.

    NULL turns come first; rows of one turn stand in the order of that hash. Rows
    without a conv_id belong to no conversation. All rows are numbered in sorted ranges,
    so that a conversation of very many turns is many tasks' work.
    """
    role, text = _null_safe(F.col("role")), _null_safe(F.col("text"))
    name = F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), F.lit(":"), F.length(text).cast("string"))
    rows = conversations.filter(F.col("conv_id").isNotNull())
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("order"), name.alias("turn"))
    order = ["conv_id", F.col("order").asc_nulls_first(), "turn"]
    numbered = sorted_numbers(rows, order)
    first = numbered.groupBy("conv_id").agg(F.min("number").alias("first"))
    return numbered.join(first, "conv_id").select("conv_id", (F.col("number") - F.col("first")).alias("at"), "turn")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, at, turn) and sizes (conv_id, length) of rebuilt conversations.

    The first h turns of conversation c - c % 100 come in place of the first h of c,
    h = crc32(c) % 6; one that is not there has none.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("source"))
    # of a source only the size matters
    bases = sizes.filter("conv_id = source").select("source", F.col("n").alias("base"))
    sizes = sizes.join(bases, "source", "left").withColumn("head", F.least("h", F.coalesce("base", F.lit(0))))
    sizes = materialize(sizes.select("conv_id", "source", "n", "h", "head"))
    heads = rows.filter(F.col("at") < SHARED - 1).toDF("source", "at", "turn")
    heads = heads.join(sizes.filter("head > 0").select("source", "conv_id", "head"), "source").filter("at < head")
    # a conversation's own first h turns go, the others move up or down to the end of the head
    own = rows.withColumn("h", h).filter("at >= h")
    own = own.join(sizes.select("conv_id", "head"), "conv_id").withColumn("at", F.col("at") - F.col("h") + F.col("head"))
    length = F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    both = heads.select("conv_id", "at", "turn").unionByName(own.select("conv_id", "at", "turn"))
    return both, sizes.select("conv_id", length.alias("length"))


def named_pieces(rows: DataFrame, levels: int) -> list[DataFrame]:
    """Of each level k, its pieces of 2^k turns (conv_id, at, name, left, right): piece ``at``
    of a conversation is named after its halves, the right of which may be missing."""
    pieces = [rows.select("conv_id", "at", F.col("turn").alias("name"))]
    for _ in range(levels):
        even = F.col("at") % 2 == 0
        halves = pieces[-1].groupBy("conv_id", F.floor(F.col("at") / 2).alias("at")).agg(
            F.max(F.when(even, F.col("name"))).alias("left"), F.max(F.when(~even, F.col("name"))).alias("right")
        )
        name = F.md5(F.concat("left", F.lit("|"), _null_safe(F.col("right"))))
        pieces.append(materialize(halves.select("conv_id", "at", name.alias("name"), "left", "right")))
    return pieces


def _merged(rows: DataFrame) -> DataFrame:
    """Equal pieces below equal prefixes as one, with their conversations counted. At most
    one of them ends a conversation, because such ones have been equal throughout."""
    return rows.groupBy("depth", "prefix", "name").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("ending").alias("ending")
    )


def cut_tries(pieces: list[DataFrame], root: int) -> tuple[DataFrame, DataFrame]:
    """The nodes below the root, and the ends of conversations.

    Nodes: depth, prefix (the parent's smallest member), name (of the turn), n, least and
    ending, a number of the sequence that ends there, else NULL. Ends: (conv_id, ending)
    of all conversations that have turns.
    """
    levels = len(pieces) - 1
    # levels count from the top: a whole sequence is piece 0 of the highest level
    whole = materialize(pieces[levels].groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")))
    ends = pieces[levels].select("conv_id", "name").join(whole.select("name", F.col("least").alias("ending")), "name")
    rows = whole.select(
        F.lit(0).cast("bigint").alias("depth"), F.lit(root).cast("bigint").alias("prefix"), "name", "n", "least", F.col("least").alias("ending")
    )
    for level in range(levels, 0, -1):
        halves = pieces[level].select("name", "left", "right").distinct()
        cut = materialize(rows.join(halves, "name"))
        ends_above = F.when(F.col("right").isNull(), F.col("ending"))
        upper = materialize(_merged(cut.select("depth", "prefix", F.col("left").alias("name"), "n", "least", ends_above.alias("ending"))))
        cut_prefixes = upper.select("depth", "prefix", F.col("name").alias("left"), F.col("least").alias("cut"))
        lower = cut.filter("right is not null").join(cut_prefixes, ["depth", "prefix", "left"])
        lower = lower.select(
            (F.col("depth") + 2 ** (level - 1)).alias("depth"), F.col("cut").alias("prefix"), F.col("right").alias("name"), "n", "least", "ending"
        )
        rows = upper.unionByName(_merged(lower))
    nodes = rows.select((F.col("depth") + 1).alias("depth"), "prefix", "name", "n", "least", "ending")
    return nodes, ends.select("conv_id", "ending")


def grafted(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (conv_id, depth, parent, totals...) with totals over whole subtrees.

    ``levels`` is such that no node is 2^levels below another.
    """
    up = F.when(F.col("parent").isNotNull(), F.col("depth") - 1)
    rows = materialize(nodes.select("conv_id", "depth", F.col("parent").alias("top"), up.alias("top_depth"), "leaves", "saved"))
    for _ in range(levels):
        below = rows.filter("top is not null").groupBy("top", "top_depth").agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
        below = below.toDF("conv_id", "depth", "more", "more_saved")
        above = rows.filter("top is not null").select("conv_id", "depth", "top", "top_depth").toDF("top", "top_depth", "next", "next_depth")
        joined = rows.join(below, ["conv_id", "depth"], "left").join(above, ["top", "top_depth"], "left")
        rows = materialize(
            joined.select(
                "conv_id",
                "depth",
                F.col("next").alias("top"),
                F.col("next_depth").alias("top_depth"),
                (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            )
        )
    return rows.select("conv_id", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(ending, ends_sha256) of ``ends`` (conv_id, ending): the conversations' ids in
    ascending order, comma-joined. Ranges of ids are joined first, each in its own task."""
    part = F.floor(F.col("conv_id") / PART).alias("part")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    parts = ends.groupBy("ending", part).agg(ids.alias("ids"))
    return digests(parts, "ending", "part", "ids", ",").withColumnRenamed("sha256", "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations; see ``rebuilt``.

    Per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256; conv_id and depth tell nodes apart. NULL roles
    and texts are empty ones; rows without a conv_id belong to none; rows of one turn
    stand in the order of a hash of role and text, and repeated rows are turns of their
    own. Empty texts are turns, long ones only cost their hash. Other columns are ignored;
    a table without conversations has no nodes, not even a root.
    """
    rows = materialize(turns(conversations))
    rebuilt_rows, sizes = rebuilt(rows)
    turnless = F.when(F.col("length") == 0, F.col("conv_id"))
    root, total, longest, without = sizes.agg(F.min("conv_id"), F.count(F.lit(1)), F.max("length"), F.min(turnless)).first()
    if root is None:
        root = longest = 0
    levels = (longest - 1).bit_length() if longest else 0
    nodes, ends = cut_tries(named_pieces(materialize(rebuilt_rows), levels), root)
    points = F.substring_index("name", ":", -1).cast("bigint")
    nodes = nodes.select(F.col("least").alias("conv_id"), "depth", F.col("prefix").alias("parent"), "n", points.alias("points"), "ending")
    top = [(root, 0, None, total, 0, without)] if total else []
    nodes = materialize(nodes.unionByName(sizes.sparkSession.createDataFrame(top, NODES)))
    ends = ends.unionByName(sizes.filter("length = 0").select("conv_id", F.lit(without).cast("bigint").alias("ending")))

    children = nodes.filter("parent is not null").groupBy("parent", (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("children"))
    nodes = nodes.join(children.withColumnRenamed("parent", "conv_id"), ["conv_id", "depth"], "left")
    nodes = nodes.withColumn("children", F.coalesce("children", F.lit(0)))
    leaves, saved = F.when(F.col("children") == 0, 1).otherwise(0).cast("bigint"), (F.col("n") - 1) * F.col("points")
    nodes = materialize(nodes.withColumns({"leaves": leaves, "saved": saved}))
    totals = grafted(nodes, longest.bit_length())
    out = nodes.join(totals, ["conv_id", "depth"]).join(end_digests(ends), "ending", "left")
    return out.select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# CRC-32 of the decimal id, bit by bit
_BITS = """flatten(list_transform(range(1, length(c::varchar) + 1), lambda i: list_transform(range(8), lambda k: (ascii((c::varchar)[i]) >> k) & 1)))"""
_CRC = f"""xor(4294967295, list_reduce(list_concat([4294967295], {_BITS}),
  lambda crc, bit: xor(crc >> 1, (xor(crc, bit) & 1) * 3988292384)))"""
_TURN = "coalesce(\"role\", '') AS ro, coalesce(\"text\", '') AS te"
OP13_SQL = f"""
WITH t AS (SELECT conv_id AS c, turn, {_TURN} FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, ro, te, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(ro) || ':' || ro || te)) AS pos FROM t
),
conv AS (SELECT c, c - c % {HUNDRED} AS source, ({_CRC})::BIGINT % {SHARED} AS h FROM (SELECT DISTINCT c FROM t)),
back AS (
  SELECT conv.c, own.pos, ro, te FROM conv JOIN own ON own.c = source AND own.pos <= h
  UNION ALL SELECT c, 1000000000 + own.pos, ro, te FROM conv JOIN own USING (c) WHERE own.pos > h
),
-- a turn is its role and text, a node the list of the turns to it
seq AS (
  SELECT c, row_number() OVER w AS depth, length(te) AS points, list(struct_pack(ro := ro, te := te)) OVER w AS path
  FROM back WINDOW w AS (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING)
),
member AS (
  SELECT c, depth, points, md5(path::varchar) AS path FROM seq
  UNION ALL SELECT c, 0, 0, '' FROM conv
),
node AS (
  SELECT depth, path, min(c) AS conv_id, count(*) AS n, min(points) AS points FROM member GROUP BY depth, path
),
-- each conversation's node at each depth, and where it ends
place AS (SELECT member.c, member.depth, node.conv_id, node.n, node.points FROM member JOIN node USING (depth, path)),
last AS (SELECT c, max(depth) AS depth FROM member GROUP BY c),
ends AS (SELECT place.conv_id, depth, string_agg(c::varchar, ',' ORDER BY c) AS ids FROM last JOIN place USING (c, depth) GROUP BY ALL),
up AS (SELECT node.conv_id, node.depth, parent.conv_id AS parent FROM node JOIN place parent ON parent.c = node.conv_id AND parent.depth = node.depth - 1),
children AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL),
own_values AS (
  SELECT node.conv_id, node.depth, (n - 1) * points AS saved, (n_children IS NULL)::INT AS leaf
  FROM node LEFT JOIN children USING (conv_id, depth)
),
total AS (
  SELECT above.conv_id, above.depth, sum(saved) AS saved, sum(leaf) AS leaves
  FROM own_values v JOIN place above ON above.c = v.conv_id AND above.depth <= v.depth GROUP BY ALL
)
SELECT conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN total USING (conv_id, depth) LEFT JOIN up USING (conv_id, depth)
LEFT JOIN children USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)
"""
