"""WARC fixity audit: Merkle trees over records and offset ranges, compared between replicas.

A record is hashed where it is read; from there on only its place, length and
digest move. Records lie in archives, one after another. A leaf of an archive's tree is a range of
neighbouring records, its hash covers them in their order, with their offsets from the range's begin. Ranges are cut by content: after a
record whose digest begins with a zero digit (every sixteenth on average), and wherever ``MOST`` records of the archive are full. The levels above are ranges of ranges, cut
by the hashes of those in the same way, up to one root an archive.

So a record that is lost, added or cut short changes the range it lies in, and maybe the next one, and moves all others without changing their hashes. The audit compares
roots; below a node that differs it looks at the children of both replicas and goes on only with those whose hash the other side does not have as often, level by
level, down to records. What it looks at is some nodes a level for each difference (see ``visits``). In the leaves that are left, records are matched by id and
digest, wherever they lie, and only those without a match are told.

Archives hold ``PER_ARCHIVE`` ids, and may hold any number of
rows: running sums (of offsets, of cuts, of ranks) are made over range partitions, equal rows dealt too, summed inside each part, and the parts' sums give the
beginnings. Records inside leaves are counted by id and digest before they meet, and a root is a sum over its children. So no key gathers its rows in one task.

Defined results: null url or html is read as empty; rows with a null id form an archive of their own (-1), in order of
url and digest, and are never told as corrupt, only as missing or extra; repeated rows are records each, and equal ones that
differ in number are one row with ``copies``; an empty replica makes every record of the other one missing or extra;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.llm.shared import materialize
from meterlake.sources.tables import table

#: Ids of an archive; children of a node on average, and records or children of one at most.
PER_ARCHIVE, FAN, MOST = 1000, 16, 1024
CRLF = "\r\n"


def record(page_id: Column, url: Column, html: Column, date: str = "2024-01-01T00:00:00Z") -> Column:
    """A WARC 1.1 response record as text."""
    name = F.md5(F.coalesce(page_id.cast("string"), F.lit("")).cast("binary"))
    uuid = F.concat_ws("-", *(F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    html = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:uuid:"),
        uuid,
        F.lit(f">{CRLF}WARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}Content-Type: text/html{CRLF}Content-Length: "),
        F.octet_length(html).cast("string"),
        F.lit(CRLF + CRLF),
        html,
        F.lit(CRLF + CRLF),
    )


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """``rows`` with sums over the rows before, in ``order`` (ties in any order, but a fixed one) among those of equal ``keys``.

    Rows lie in range partitions, so one key may fill many of them; a part's own sums are carried to the parts after it.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = materialize(tied.repartitionByRange(*keys, *order, "__tie").withColumn("__part", F.spark_partition_id()), "dealt")
    own = dealt.groupBy(*keys, "__part").agg(*(F.sum(x).alias(f"__{c}") for c, x in sums.items()))  # mostly a row a key
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.select(*keys, "__part", *(F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in sums))
    before = Window.partitionBy(*keys, "__part").orderBy(*order, "__tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumns({c: F.coalesce(F.sum(x).over(before), F.lit(0)) for c, x in sums.items()}).join(starts, [*keys, "__part"])
    return inside.withColumns({c: (F.col(c) + F.col(f"__{c}")).cast("bigint") for c in sums}).drop("__tie", "__part", *(f"__{c}" for c in sums))


def _ends(digest: str) -> Column:
    """1 where a range ends by content."""
    return (F.substring(F.hex(digest), 1, 1) == "0").cast("bigint")


def _range() -> Column:
    return F.col("cuts") + F.floor(F.col("ordinal") / MOST)


def index_of(pages: DataFrame) -> DataFrame:
    """One row per record: ``archive_id``, ``page_id``, ``offset``, ``length``, ``sha256`` (binary), ``leaf`` (the number of its range)."""
    text = record(pages["page_id"], pages["url"], pages["html"])
    rows = pages.select(
        F.coalesce(F.floor(pages["page_id"] / PER_ARCHIVE), F.lit(-1)).cast("bigint").alias("archive_id"),
        pages["page_id"].cast("bigint").alias("page_id"),
        pages["url"].alias("url"),
        F.octet_length(text).cast("bigint").alias("length"),
        F.unhex(F.sha2(text, 256)).alias("sha256"),
    )
    order = [F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first(), F.col("sha256")]
    placed = running(rows, ["archive_id"], order, {"offset": F.col("length"), "ordinal": F.lit(1), "cuts": _ends("sha256")})
    return placed.select("archive_id", "page_id", "offset", "length", "sha256", _range().alias("leaf"))


#: A tree's name: replica (0 or 1) and archive. Both replicas go through every step together.
_TREE = ["side", "archive_id"]


def _above(rows: DataFrame) -> DataFrame:
    """Nodes (``side``, ``archive_id``, ``node``) over rows with ``at``, ``size``, ``hash``: hash of the rows in order, by their places from the first one's."""
    grouped = rows.groupBy(*_TREE, "node").agg(F.sort_array(F.collect_list(F.struct("at", "size", "hash"))).alias("parts"), F.min("at").alias("first"), F.sum("size").alias("all"))
    said = F.transform("parts", lambda x: F.concat_ws(":", (x["at"] - F.col("first")).cast("string"), x["size"].cast("string"), F.hex(x["hash"])))
    return grouped.select(*_TREE, "node", F.col("first").alias("at"), F.col("all").alias("size"), F.unhex(F.sha2(F.concat_ws(",", said), 256)).alias("hash"))


@dataclass(frozen=True)
class Trees:
    """The index of two replicas (``side`` 0 and 1), their levels of nodes from the leaves up: ``side``, ``archive_id``, ``node``, ``above`` (the node that it lies in), ``at``, ``size``, ``hash``; and the roots."""

    index: DataFrame
    levels: list[DataFrame]
    roots: DataFrame


def levels_for(leaves: int) -> int:
    """Levels between the roots and the records, for archives of so many leaves at most: a root has about ``FAN`` children or fewer."""
    n = 1
    while leaves > FAN:
        n, leaves = n + 1, -(-leaves // FAN)
    return n


def trees(one: DataFrame, other: DataFrame) -> Trees:
    """The trees of two indexes (as of ``index_of``), of as many levels."""
    index = materialize(one.withColumn("side", F.lit(0)).unionByName(other.withColumn("side", F.lit(1))), "index")
    nodes = _above(index.select(*_TREE, F.col("leaf").alias("node"), F.col("offset").alias("at"), F.col("length").alias("size"), F.col("sha256").alias("hash")))
    nodes = materialize(nodes, "nodes")
    most = nodes.groupBy(*_TREE).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    found = []
    for _ in range(levels_for(most) - 1):
        placed = running(nodes, _TREE, [F.col("node")], {"ordinal": F.lit(1), "cuts": _ends("hash")}).withColumn("above", _range())
        found.append(materialize(placed.select(*_TREE, "node", "above", "at", "size", "hash"), "nodes"))
        nodes = _above(found[-1].drop("node").withColumnRenamed("above", "node"))
    found.append(materialize(nodes.withColumn("above", F.lit(0).cast("bigint")), "nodes"))
    # an archive may have any number of children: a sum takes the place of a list
    sums = found[-1].groupBy(*_TREE).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum(F.xxhash64("hash", "size").cast("decimal(38,0)")).alias("sum"))
    return Trees(index, found, materialize(sums.select(*_TREE, "size", F.sha2(F.concat_ws(":", "n", "size", "sum"), 256).alias("hash")), "roots"))


def _unlike(nodes: DataFrame) -> DataFrame:
    """Nodes whose hash the other replica's archive does not have as often among ``nodes``."""
    counted = nodes.groupBy("archive_id", "hash").agg(*(F.count_if(F.col("side") == n).alias(f"n{n}") for n in (0, 1)))
    return nodes.join(counted.filter("n0 <> n1"), ["archive_id", "hash"], "left_semi")


def descend(t: Trees) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame, DataFrame]]]:
    """Leaves (``side``, ``archive_id``, ``node``) that the other replica does not have; and for each level, the roots first: its nodes, those looked at, those that differ."""
    bad = materialize(_unlike(t.roots).select(*_TREE, F.lit(0).cast("bigint").alias("node")), "differing")
    seen = [(t.roots, t.roots, bad)]
    for nodes in reversed(t.levels):
        below = nodes.join(bad.withColumnRenamed("node", "above"), [*_TREE, "above"], "left_semi").select(*_TREE, "node", "hash")
        bad = materialize(_unlike(below).select(*_TREE, "node"), "differing")
        seen.append((nodes, below, bad))
    return bad, seen


def mismatches(t: Trees) -> DataFrame:
    """Records that differ: ``archive_id``, ``page_id``, ``offset`` and ``length`` (in the replica that has it, the first one first), both digests in hex, ``status`` (corrupt, missing, extra) and ``copies``."""
    leaves, _ = descend(t)
    rows = t.index.join(leaves.withColumnRenamed("node", "leaf"), [*_TREE, "leaf"], "left_semi")
    sides = {"expected": F.col("side") == 0, "found": F.col("side") == 1}
    counted = rows.groupBy("archive_id", "page_id", "sha256", "length").agg(
        *(F.count_if(x).alias(c) for c, x in sides.items()), *(F.min(F.when(x, F.col("offset"))).alias(f"{c}_at") for c, x in sides.items())
    )
    differ = counted.filter("expected <> found").withColumn("more", F.col("expected") > F.col("found"))
    # versions of one id that one side alone has: the first of them meets the first of the other side
    ranked = running(differ.filter("page_id IS NOT NULL"), ["archive_id", "page_id", "more"], [F.col("sha256"), F.col("length")], {"rank": F.lit(1)})
    ranked = ranked.unionByName(differ.filter("page_id IS NULL").withColumn("rank", F.lit(None).cast("bigint")))
    lost, new = ranked.filter("more").alias("a"), ranked.filter("NOT more").alias("b")
    met = lost.join(new, (F.col("a.archive_id") == F.col("b.archive_id")) & (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.rank") == F.col("b.rank")), "full")
    either = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    status = F.when(F.col("b.sha256").isNull(), "missing").when(F.col("a.sha256").isNull(), "extra").otherwise("corrupt")
    more = F.greatest(F.coalesce(F.col("a.expected") - F.col("a.found"), F.lit(0)), F.coalesce(F.col("b.found") - F.col("b.expected"), F.lit(0)))
    return met.select(
        either("archive_id"),
        either("page_id"),
        F.coalesce("a.expected_at", "b.found_at").alias("offset"),
        either("length"),
        F.lower(F.hex("a.sha256")).alias("expected_sha256"),
        F.lower(F.hex("b.sha256")).alias("found_sha256"),
        status.alias("status"),
        more.alias("copies"),
    )


def visits(one: DataFrame, other: DataFrame) -> DataFrame:
    """How many nodes of two indexes' trees an audit looks at, by level, leaves are level 1: ``level``, ``nodes``, ``visited``, ``differing``."""
    _, seen = descend(trees(one, other))
    rows = []
    for n, parts in enumerate(seen):
        counts = [df.agg(F.count(F.lit(1)).alias(c)) for df, c in zip(parts, ("nodes", "visited", "differing"))]  # one row each
        rows.append(counts[0].crossJoin(counts[1]).crossJoin(counts[2]).select(F.lit(len(seen) - n).alias("level"), "nodes", "visited", "differing"))
    return reduce(DataFrame.unionByName, rows)


def audit(one: DataFrame, other: DataFrame) -> DataFrame:
    """Mismatches of two indexes (as of ``index_of``)."""
    return mismatches(trees(one, other))


def _mark(page_id: Column) -> Column:
    return F.substring(F.md5(page_id.cast("string").cast("binary")), 1, 2)


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of ``pages`` as bad media would leave it: about one page in 256 has its last character replaced."""
    hit = (_mark(F.col("page_id")) == "3f") & F.col("html").rlike(r"[\x20-\x7D]\z")
    return pages.withColumn("html", F.when(hit, F.concat(F.expr("left(html, length(html) - 1)"), F.lit("~"))).otherwise(F.col("html")))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archives, against a replica that was written anew with changed characters and without about one record in 256."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    lost = F.coalesce(_mark(F.col("page_id")) == "a1", F.lit(False))
    return audit(index_of(pages), index_of(damaged(pages).filter(~lost)))


_SQL = r"""
WITH p AS (
  SELECT coalesce(floor(page_id / 1000), -1)::BIGINT AS archive_id, page_id, url, coalesce(html, '') AS html,
    md5(coalesce(page_id::VARCHAR, '')) AS m, coalesce(substr(md5(page_id::VARCHAR), 1, 2), '') AS mark FROM pages
), r AS (
  SELECT *, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:uuid:',
      substr(m, 1, 8), '-', substr(m, 9, 4), '-', substr(m, 13, 4), '-', substr(m, 17, 4), '-', substr(m, 21, 12), '>', chr(13), chr(10),
      'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'WARC-Date: 2024-01-01T00:00:00Z', chr(13), chr(10),
      'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(html)::VARCHAR, chr(13), chr(10), chr(13), chr(10)) AS head,
    concat(chr(13), chr(10), chr(13), chr(10)) AS tail,
    CASE WHEN mark = '3f' AND regexp_matches(html, '[\x20-\x7D]\z') THEN left(html, length(html) - 1) || '~' ELSE html END AS other
  FROM p
), o AS (
  SELECT *, strlen(head) + strlen(html) + 4 AS size, sha256(concat(head, html, tail)) AS a, sha256(concat(head, other, tail)) AS b FROM r
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY archive_id ORDER BY page_id NULLS FIRST, url NULLS FIRST, a ROWS UNBOUNDED PRECEDING) - size AS place FROM o
)
SELECT archive_id, page_id, place::BIGINT AS "offset", size::BIGINT AS length, a AS expected_sha256,
  CASE WHEN mark <> 'a1' THEN b END AS found_sha256, CASE WHEN mark = 'a1' THEN 'missing' ELSE 'corrupt' END AS status, 1::BIGINT AS copies
FROM placed WHERE mark = 'a1' OR a <> b
"""

QUERIES = {"op9_warc_fixity": op9_warc_fixity}
ORACLE_SQL = {"op9_warc_fixity": _SQL}
