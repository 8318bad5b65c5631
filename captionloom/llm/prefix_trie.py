"""The prefix trie of conversations, with subtree totals rolled up in depth bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import depth_for, ordered_scan
from ..session import materialize
from .common import WORD, column, join_frequent

#: A node: its depth and 128 bits that stand for the turns on the way to it.
NODE = ["depth", "d1", "d2"]
#: Height of a band, and conversations whose ids are joined to one text at a time.
BAND, IDS = 16, 256
HALF = 0xFFFFFFFF


def numbered(conversations: DataFrame) -> DataFrame:
    """``(c, k, h1, h2, words)``: every turn with its place 1, 2, ... in its conversation.

    One range sort of (conversation, turn, content) numbers all rows: a row's place among all is the size of the
    partitions before its own plus its place there, and a conversation starts at its least. A conversation of
    any length so spreads over partitions, and nothing but hashes and word counts leaves the scan.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = materialize(conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("c"), F.col("turn"), F.xxhash64(role, text).alias("h1"), F.xxhash64(text, F.lit(1), role).alias("h2"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"), F.monotonically_increasing_id().alias("tie")), "turns")
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2"), F.col("tie")]
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed.select("c", "h1", "h2", "words", F.expr("at >> 33").alias("part"), "at"), "sorted-turns")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition of the sort
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    place = F.col("skip") + F.expr("at & 8589934591")
    return placed.join(F.broadcast(parts), "part").select("c", place.alias("place"), "h1", "h2", "words")


def rebuilt(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """``(c, depth, h1, h2, words, last)``: the turns of the rebuilt conversations, and a row of depth 0 for each.

    ``h`` = crc32 of the id's decimal text mod ``heads``. The first ``h`` turns are those of conversation
    ``c - c % group``, the rest are the conversation's own after its first ``h``.
    """
    turns = materialize(numbered(conversations), "numbered-turns")
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(heads))
    convs = turns.groupBy("c").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    convs = materialize(convs.withColumns({"h": h, "b": F.col("c") - F.col("c") % group}), "convs")
    base = convs.select(F.col("c").alias("b"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = materialize(convs.join(base, "b", "left").withColumn("taken", taken)
                        .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conv-plans")
    own = join_frequent(turns, convs, ["c"], "n", turns.count()).withColumn("k", F.col("place") - F.col("start") + 1)
    first = own.where((F.col("c") % group == 0) & (F.col("k") < heads)).select(F.col("c").alias("b"), "k", "h1", "h2", "words")
    borrowed = convs.where("taken > 0").join(first, "b").where("k <= taken")
    columns = ["c", "depth", "h1", "h2", "words", (F.col("depth") == F.col("length")).alias("last")]
    none = F.lit(0).cast("bigint")
    return (
        own.where("k > h").withColumn("depth", F.col("k") - F.col("h") + F.col("taken")).select(*columns)
        .unionByName(borrowed.withColumn("depth", F.col("k")).select(*columns))
        .unionByName(convs.withColumns({"depth": none, "h1": none, "h2": none, "words": none}).select(*columns))
    )


def _pack(high: Column, low: Column) -> Column:
    return F.shiftleft(high.bitwiseAND(F.lit(HALF)), 32).bitwiseOR(low.bitwiseAND(F.lit(HALF)))


def prefixes(turns: DataFrame) -> DataFrame:
    """``(c, depth, d1, d2, p1, p2, words, last)``: for each turn the node it leads to, and that node's parent.

    A prefix is known by the sum of its turns' hashes, each taken with its depth: four sums of 32 bits. Sums run
    along a conversation in blocks where one is long.
    """
    inner = materialize(turns.where("depth > 0"), "rebuilt")
    one, two = F.xxhash64("depth", "h1", "h2"), F.xxhash64("h2", "depth", F.lit(1), "h1")
    parts = [F.shiftrightunsigned(one, 32), one.bitwiseAND(F.lit(HALF)), F.shiftrightunsigned(two, 32), two.bitwiseAND(F.lit(HALF))]
    inner = inner.withColumns({f"v{i}": v for i, v in enumerate(parts)})
    summed = ordered_scan(inner, ["c"], ["depth"], sums={f"s{i}": F.col(f"v{i}") for i in range(4)}, depth=depth_for(inner, "depth"))
    s, t = [F.col(f"s{i}") for i in range(4)], [F.col(f"s{i}") + F.col(f"v{i}") for i in range(4)]
    named = summed.select("c", "depth", _pack(t[0], t[1]).alias("d1"), _pack(t[2], t[3]).alias("d2"), _pack(s[0], s[1]).alias("p1"),
                          _pack(s[2], s[3]).alias("p2"), "words", "last")
    none = F.lit(0).cast("bigint")
    roots = turns.where("depth = 0").select("c", "depth", *[none.alias(x) for x in ("d1", "d2", "p1", "p2")], "words", "last")
    return named.unionByName(roots)


def _ways(rows: DataFrame, nodes: DataFrame, unit: int, band: int) -> DataFrame:
    """``(depth, d1, d2, guest, top, way)`` of the nodes at multiples of ``unit``: the way down to a node inside its band.

    A band holds ``band`` such nodes of a way, from depth ``top`` on. Ways are read off the smallest conversation
    of a node, band by band, so a window never holds more than ``band`` + 1 rows. The first node of a band is
    also a guest of the band above, with the whole way through that one.
    """
    mine = rows.where(F.col("depth") % unit == 0).select("c", *NODE)
    nodes = nodes.where(F.col("depth") % unit == 0).select(F.col("conv_id").alias("c"), "depth", F.lit(True).alias("mine"))
    mine = mine.join(nodes, ["c", "depth"], "left")
    own = F.expr(f"depth div {unit * band}")
    first = (F.col("depth") % (unit * band) == 0) & (F.col("depth") > 0)
    dealt = mine.withColumn("in", F.explode(F.when(first, F.array(own, own - 1)).otherwise(F.array(own))))
    way = F.collect_list(F.struct("d1", "d2")).over(Window.partitionBy("c", "in").orderBy("depth"))
    found = dealt.withColumn("way", way).where("mine").withColumn("guest", F.col("in") != own)
    return found.select(*NODE, "guest", (F.col("in") * (unit * band)).alias("top"), F.slice("way", 1, band).alias("way"))


def _up(ways: DataFrame, unit: int, totals: list[str]) -> DataFrame:
    """Adds each row's totals to all nodes of its way."""
    each = ways.select("top", F.posexplode("way").alias("i", "node"), *totals)
    return each.groupBy((F.col("top") + F.col("i") * unit).alias("depth"), F.col("node.d1").alias("d1"), F.col("node.d2").alias("d2")).agg(
        *[F.sum(x).alias(x) for x in totals])


def rollup(rows: DataFrame, nodes: DataFrame, totals: list[str], band: int = BAND) -> DataFrame:
    """``(depth, d1, d2, *totals)``: every node's sums over its subtree, itself included.

    Depths are cut into bands of ``band`` levels. A node adds its own numbers to its ancestors in its band alone, at most
    ``band`` of them; that completes the lowest bands and leaves, at the first node of each, what its band holds.
    These first nodes form a tree of a ``band``-th of the depth, which is rolled up in the same way; then
    their completed totals are added to their ancestors in the band above. So for a depth of D there are
    about 2 log D / log band rounds, and no row ever gives more than ``band``. Sums are partial before each shuffle.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    levels, own, unit = [], nodes.select(*NODE, *totals), 1
    while True:
        ways = materialize(_ways(rows, nodes, unit, band), "ways")
        local = materialize(_up(ways.where("not guest").join(own, NODE), unit, totals), "band-totals")
        levels.append((unit, ways, local))
        unit *= band
        if deepest < unit:
            break
        own = local.where(F.col("depth") % unit == 0)
    done = local
    for unit, ways, local in levels[-2::-1]:
        more = _up(ways.where("guest").join(done, NODE), unit, totals)
        more = more.select(*NODE, *[F.col(x).alias(f"more_{x}") for x in totals])
        done = materialize(local.join(more, NODE, "left").select(
            *NODE, *[(F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in totals]), "subtree-totals")
    return done


def ends(rows: DataFrame) -> DataFrame:
    """``(depth, d1, d2, ends_sha256)``: digest of the ids of the conversations that end at a node, ascending, by commas.

    Ids are sorted and joined to texts in ranges of ``IDS`` of them; a node's texts then go through its digest in order,
    one at a time, so that a node at which a third of all conversations end is a short stream, never a list.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",")
    parts = rows.where("last").groupBy(*NODE, F.expr(f"cast(floor(c / {IDS}.0bd) as bigint)").alias("range")).agg(text.alias("ids"))
    parts = parts.repartition(*NODE).sortWithinPartitions(*NODE, "range")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = digest = None
        for batch in batches:
            out = []
            for *key, ids in zip(*[column(batch, x).to_pylist() for x in (*NODE, "ids")], strict=True):
                if key == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*node, digest.hexdigest()), strict=True))], schema=schema)

    schema = pa.schema([*[(x, pa.int64()) for x in NODE], ("ends_sha256", pa.string())])
    return parts.mapInArrow(run, "depth bigint, d1 bigint, d2 bigint, ends_sha256 string")


def trie(conversations: DataFrame, group: int = 20, heads: int = 4, band: int = BAND) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: ``(conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256)``; the contract of the query states them.

    Turns are ordered by ``turn``, null first; turns of equal number by a hash of role and text, and a row that
    repeats is a turn of its own. Null roles and texts are empty. Rows without a conversation id are left out. An empty
    table has no node, not even a root. Columns other than ``conv_id, turn, role, text`` are not read. Turns are told
    apart by 128 bits of hash, prefixes by 128 bits of sums.
    """
    rows = materialize(prefixes(materialize(rebuilt(conversations, group, heads), "rebuilt-turns")), "prefixes")
    nodes = rows.groupBy(*NODE).agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.max(x).alias(x) for x in ("words", "p1", "p2")])
    nodes = materialize(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, NODE, "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)),
        "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
    }), "trie-nodes")
    totals = rollup(rows, nodes, ["n_leaves", "saved_tokens"], band)
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"),
                      F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = nodes.where("depth > 0").select(*NODE, "p1", "p2", "conv_id", "n_convs", "n_children")
    top = nodes.where("depth = 0").select(*NODE, "p1", "p2", "conv_id", "n_convs", "n_children").withColumns(
        {"parent_conv_id": F.lit(None).cast("bigint"), "n": F.lit(0).cast("bigint")})
    named = join_frequent(below, up.where("n > 0"), ["depth", "p1", "p2"], "n", nodes.count()).unionByName(top)
    return named.join(totals, NODE).join(ends(rows), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


SQL = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT c, list(x ORDER BY k) AS turns FROM t GROUP BY c
), h AS (
  SELECT *, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda y: CAST(ascii(y) AS BIGINT))),
      lambda a, y: list_reduce(list_prepend(xor(a, y), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: xor(s >> 1, 3988292384 * (s & 1))))) % 4 AS h
  FROM o
), r AS (
  SELECT h.c, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS way FROM h LEFT JOIN o AS b ON b.c = h.c - h.c % 20
), p AS (
  SELECT c, u.d AS depth, way[1:u.d] AS node, len(way) = u.d AS last FROM r, unnest(range(0, len(way) + 1)) AS u(d)
), n AS (
  SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
  FROM p GROUP BY node, depth
), k AS (
  SELECT node[1:depth - 1] AS up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0
    ELSE (n_convs - 1) * len(regexp_extract_all(node[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM n LEFT JOIN k ON k.up = n.node
), s AS (
  SELECT node[1:u.d] AS top, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM v, unnest(range(0, depth + 1)) AS u(d) GROUP BY 1
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, w.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s ON s.top = v.node LEFT JOIN n AS w ON v.depth > 0 AND w.node = v.node[1:v.depth - 1]
"""
