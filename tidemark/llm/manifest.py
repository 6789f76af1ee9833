"""A Merkle manifest of a dataset: leaves by source, subroots, one root, and a proof for each document.

A leaf is the SHA-256 of a row's fields. Per source, leaves ascend by doc_id; WAY consecutive nodes (the last run: fewer) become
the digest of their texts until one remains, the subroot; subroots in order of their source become the root in the same way.

Spark hashes the rows, ranks the leaves and cuts each source into aligned buckets of WAY ** DEPTH consecutive nodes, so that a bucket is a
whole subtree. Tasks get sorted runs of whole buckets as Arrow batches, about BATCH rows at a time, and DuckDB works them out level by level:
string_agg in order, then sha256. The bucket roots are the nodes of the next layer, which is cut into buckets again, until every source
has one node; the sources' subroots are a further group of nodes. Then, from the top down, each layer's nodes get the siblings on
their way to the root: those within the bucket from DuckDB, those above from a join with the layer above. No task sees more than a
run of buckets, however many rows a source has; texts never leave the task that reads them.

Ranks come from a sort by ranges of (source, doc_id, leaf): a row's place within its range and source, plus the source's rows in
the ranges before. Null doc_ids come after all others of their source, repeated doc_ids in order of their leaves; rows that are equal in all
fields are leaves of their own. A null field is "-". An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.common import CRC_TABLE, Scratch, crc32_sql, kept

#: Nodes that become one, levels of a bucket, rows that a task hands to DuckDB at once (one bucket at least), and the memory of that.
WAY, DEPTH, BATCH, MEMORY = 3, 7, 8192, "256MB"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A value with its length in bytes before it; `-` if null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a row whose text is the given one."""
    return F.sha2(F.concat(*(field(text if c == "text" else F.col(c)) for c in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, grp (the source after an s; empty, thus first, for null), h (leaf) and other (leaf of the tampered row; null where the row is not tampered with)."""
    struck = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("grp"), leaf(F.col("text")).alias("h"), F.when(struck & F.contains("text", F.lit("\n")), leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("other"))


def placed(nodes: DataFrame, scratch: Scratch, *order: str) -> DataFrame:
    """nodes with pos, the rank within grp by the order, and n, the nodes of the grp. The written order of ranges fixes the ranks, so lost tasks change nothing."""
    by = [F.asc_nulls_last(c) for c in order]
    rows = scratch.keep(nodes.repartitionByRange("grp", *by).sortWithinPartitions("grp", *by).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = scratch.keep(rows.groupBy("grp", part.alias("_part")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n")))
    # A source has as many rows here as ranges hold some of it.
    by_part = W.partitionBy("grp").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("grp", "_part", "_first", F.coalesce(F.sum("_n").over(by_part), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy("grp")).alias("n"))
    out = rows.withColumn("_part", part).join(starts, ["grp", "_part"])
    return out.withColumn("pos", F.col("_before") + F.col("_id") - F.col("_first")).drop("_id", "_part", "_first", "_before")


def bucketed(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes with their bucket, and levels: how many of the bucket are above its nodes."""
    levels = F.when(F.col("n") > WAY**depth, depth).otherwise(sum((F.when(F.col("n") > WAY**i, 1).otherwise(0) for i in range(depth)), F.lit(0)))
    return nodes.withColumn("bucket", F.floor(F.col("pos") / WAY**depth)).withColumn("levels", levels.cast("int"))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole buckets, each of about BATCH rows."""
    have: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        have.append(b)
        if sum(x.num_rows for x in have) < BATCH:
            continue
        rows = pa.Table.from_batches(have).combine_chunks()
        last = pc.and_(pc.equal(rows["grp"], rows["grp"][-1]), pc.equal(rows["bucket"], rows["bucket"][-1]))
        done = rows.num_rows - pc.sum(last).as_py()
        if done:
            yield rows.slice(0, done)
        have = rows.slice(done).combine_chunks().to_batches()
    if have:
        yield pa.Table.from_batches(have)


class Engine:
    """DuckDB over the nodes of some buckets: a table n0, n1, ... for each level."""

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})

    def climb(self, rows: pa.Table) -> None:
        """Makes the levels. Nodes whose bucket has no more of them go up unchanged."""
        self.con.register("given", rows)
        self.con.execute("CREATE OR REPLACE TEMP TABLE n0 AS SELECT grp, bucket, levels, pos, h FROM given")
        for i in range(self.depth):
            # A bucket holds one node where its levels are done.
            self.con.execute(
                f"CREATE OR REPLACE TEMP TABLE n{i + 1} AS SELECT grp, bucket, levels, pos // {WAY} AS pos, "
                f"CASE WHEN levels > {i} THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM n{i} GROUP BY grp, bucket, levels, pos // {WAY}"
            )

    def roots(self, rows: pa.Table) -> pa.Table:
        self.climb(rows)
        return self.con.execute(f"SELECT grp, bucket AS pos, h FROM n{self.depth} WHERE h IS NOT NULL").to_arrow_table()

    def ways(self, rows: pa.Table) -> None:
        """Makes `ways`: for each given node, `way`: for each level up to the root, what stands before (l) and after (r) the node there."""
        self.climb(rows)
        side = ", ".join(f"lag(h, {k}) OVER w AS b{k}, lead(h, {k}) OVER w AS a{k}" for k in range(1, WAY))
        before = " || ".join(f"coalesce(b{k}, '')" for k in range(WAY - 1, 0, -1))
        after = " || ".join(f"coalesce(a{k}, '')" for k in range(1, WAY))
        for i in range(self.depth):
            self.con.execute(
                f"CREATE OR REPLACE TEMP TABLE s{i} AS SELECT grp, bucket, pos, {before} AS l, {after} AS r FROM "
                f"(SELECT grp, bucket, pos, {side} FROM n{i} WHERE levels > {i} WINDOW w AS (PARTITION BY grp, bucket, pos // {WAY} ORDER BY pos))"
            )
        joins = " ".join(f"LEFT JOIN s{i} ON s{i}.grp = g.grp AND s{i}.bucket = g.bucket AND s{i}.pos = g.pos // {WAY**i}" for i in range(self.depth))
        steps = ", ".join(f"CASE WHEN s{i}.l IS NOT NULL THEN {{'l': s{i}.l, 'r': s{i}.r}} END" for i in range(self.depth))
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE ways AS SELECT g.*, list_concat(list_filter([{steps}], lambda x: x IS NOT NULL), o.above) AS way FROM given g JOIN (SELECT grp, bucket, above FROM given WHERE above IS NOT NULL) o USING (grp, bucket) {joins}")

    def passed(self, rows: pa.Table) -> pa.Table:
        """grp, pos and the whole way to the root of each node."""
        self.ways(rows)
        return self.con.execute("SELECT grp, pos, way FROM ways").to_arrow_table()

    def proven(self, rows: pa.Table) -> pa.Table:
        """What the manifest says of each leaf."""
        self.ways(rows)
        return self.con.execute(
            "SELECT doc_id, h AS leaf, grp, bucket, sha256(coalesce(list_aggregate(list_transform(way, lambda x: x.l || x.r), 'string_agg', ''), '')) AS proof_sha256, "
            "list_reduce(way, lambda a, b: sha256(b.l || a || b.r), coalesce(other, h)) AS folded_root FROM ways"
        ).to_arrow_table()


def worked(rows: DataFrame, what: str, schema: str, depth: int) -> DataFrame:
    """The Engine's method on runs of whole buckets, each in one task and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Engine(depth)
        for own in runs(batches):
            yield from getattr(engine, what)(own).cast(shape).to_batches()

    shape = to_arrow_schema(StructType.fromDDL(schema))
    return rows.sortWithinPartitions("grp", "bucket", "pos").mapInArrow(run, schema)


WAY_TYPE = "array<struct<l:string,r:string>>"


def layers(nodes: DataFrame, scratch: Scratch, depth: int) -> list[DataFrame]:
    """nodes (grp, pos, n, h and others), then the bucket roots of each layer before, until every grp has one node."""
    out = [scratch.keep(bucketed(nodes, depth))]
    while not out[-1].where("n > 1").isEmpty():
        last = out[-1]
        roots = worked(last.select("grp", "bucket", "levels", "pos", "h").repartition("grp", "bucket"), "roots", "grp string, pos long, h string", depth)
        sizes = last.groupBy("grp").agg(F.ceil(F.max("n") / WAY**depth).alias("n"))
        out.append(scratch.keep(bucketed(roots.join(sizes, "grp"), depth)))
    return out


def below(layer: DataFrame, above: DataFrame) -> DataFrame:
    """A layer with the way of its buckets (above: grp, pos, way) on each bucket's first row, rows of a bucket together."""
    ways = above.select("grp", F.col("pos").alias("bucket"), F.col("way").alias("above"))
    # The window needs whole buckets in order, so no skewed partition of the join is cut within one.
    both = layer.join(ways.hint("merge"), ["grp", "bucket"]).withColumn("_i", F.row_number().over(W.partitionBy("grp", "bucket").orderBy("pos")))
    return both.withColumn("above", F.when(F.col("_i") == 1, F.col("above"))).drop("_i")


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row."""
    with Scratch(docs.sparkSession) as scratch:
        return kept(_manifest(docs, scratch, depth))


def _manifest(docs: DataFrame, scratch: Scratch, depth: int) -> DataFrame:
    hashed = scratch.keep(leaves(docs))
    inner = layers(placed(hashed, scratch, "doc_id", "h"), scratch, depth)
    subroots = inner[-1].select("grp", F.col("h").alias("subroot"))
    # The sources' subroots are the nodes of a group of their own, whose node is the root.
    outer = layers(placed(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.col("subroot").alias("h")), scratch, "of"), scratch, depth)
    root = outer[-1].select(F.col("h").alias("root"))

    def ways(stack: list[DataFrame], top: DataFrame) -> DataFrame:
        """The way to the root of each node of the layer after the first; top: that of the nodes of the last layer."""
        for layer in stack[-2:0:-1]:
            top = scratch.keep(worked(below(layer.drop("of"), top), "passed", f"grp string, pos long, way {WAY_TYPE}", depth))
        return top

    one = docs.sparkSession.range(1)
    nothing = one.select(F.lit("").alias("grp"), F.lit(0).cast("long").alias("pos"), F.expr(f"CAST(array() AS {WAY_TYPE})").alias("way"))
    by_pos = scratch.keep(worked(below(outer[0].drop("of"), ways(outer, nothing)), "passed", f"grp string, pos long, way {WAY_TYPE}", depth))
    top = outer[0].select("of", "pos").join(by_pos.select("pos", "way"), "pos").select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("pos"), "way")
    found = worked(below(inner[0], ways(inner, top)), "proven", "doc_id long, leaf string, grp string, bucket long, proof_sha256 string, folded_root string", depth)
    # One row for each source: Spark sends the table along if it is small by its size settings, and joins by shuffle if not.
    full = found.join(subroots, "grp").crossJoin(F.broadcast(root))
    return full.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


def _levels_sql(name: str, start: str) -> str:
    """Levels of nodes (s, pos, h, cnt) from l = 0 until one is left."""
    return f"""{name} AS (SELECT 0 AS l, s, pos, h, cnt FROM {start}
  UNION ALL SELECT * FROM (SELECT l + 1 AS l, s, pos // {WAY} AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, count(*) OVER (PARTITION BY s) AS cnt FROM {name} WHERE cnt > 1 GROUP BY l, s, pos // {WAY})),
{name}_side AS (SELECT l, s, pos, coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h, 1) OVER w, '') AS a, coalesce(lead(h, 1) OVER w, '') || coalesce(lead(h, 2) OVER w, '') AS b FROM {name} WHERE cnt > 1 WINDOW w AS (PARTITION BY l, s, pos // {WAY} ORDER BY pos))"""


#: The same in DuckDB's SQL.
SQL = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, coalesce('s' || source, '') AS s, sha256({" || ".join(map(_field_sql, FIELDS))}) AS h,
  CASE WHEN {crc32_sql("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 THEN sha256({" || ".join(_field_sql("replace(text, chr(10), '')" if c == "text" else c) for c in FIELDS)}) END AS other FROM documents, crc_table),
p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS LAST, h) - 1 AS pos, count(*) OVER (PARTITION BY s) AS cnt FROM d),
{_levels_sql("t", "p")},
sub AS (SELECT s, h AS subroot FROM t WHERE cnt = 1),
q AS (SELECT 0 AS s, s AS src, subroot AS h, row_number() OVER (ORDER BY encode(s)) - 1 AS pos, count(*) OVER () AS cnt FROM sub),
{_levels_sql("u", "q")},
top AS (SELECT h AS root FROM u WHERE cnt = 1),
ways AS (SELECT s, pos, l, a, b FROM t_side),
steps AS (SELECT p.s, p.pos, t_side.l, t_side.a, t_side.b FROM p JOIN t_side ON t_side.s = p.s AND t_side.pos = p.pos // CAST(pow({WAY}, t_side.l) AS BIGINT)
  UNION ALL SELECT p.s, p.pos, 100 + u_side.l, u_side.a, u_side.b FROM p JOIN q ON q.src = p.s JOIN u_side ON u_side.pos = q.pos // CAST(pow({WAY}, u_side.l) AS BIGINT)),
way AS (SELECT s, pos, string_agg(a || b, '' ORDER BY l) AS proof, list({{'a': a, 'b': b}} ORDER BY l) AS w FROM steps GROUP BY s, pos)
SELECT p.doc_id, p.h AS leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256,
  coalesce(list_reduce(w, lambda x, y: sha256(y.a || x || y.b), coalesce(other, p.h)), coalesce(other, p.h)) AS folded_root,
  coalesce(list_reduce(w, lambda x, y: sha256(y.a || x || y.b), coalesce(other, p.h)), coalesce(other, p.h)) = root AS verified
FROM p JOIN sub USING (s) LEFT JOIN way ON way.s = p.s AND way.pos = p.pos, top
"""
