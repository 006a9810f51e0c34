"""A Merkle manifest of a table: leaves of rows, a tree for each source, a tree over the sources, and proofs.

Leaves are hashed by Spark where the rows lie; only their digests move. The leaves of a source are cut into
aligned buckets of ARITY ** LEVELS, so each bucket is a whole subtree. Executors climb the levels of a bucket in
DuckDB, by ordered string_agg and sha256 over its Arrow table; Spark climbs from the roots of the buckets to the
root and hands each bucket the siblings on its way, with which the executors finish every leaf's proof.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize

#: Nodes of a run, and levels inside a bucket (2,187 leaves).
ARITY, LEVELS = 3, 7
BUCKET = ARITY**LEVELS
#: Rows up to which a table of groups is sent to every task; a larger one is joined as Spark sees fit.
BROADCAST_ROWS = 100_000
STEP = "array<struct<left:string,right:string>>"


def heights(n: int) -> int:
    """Levels above n leaves until one node remains."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def _part(c: Column) -> Column:
    """- for null, else the number of UTF-8 bytes, a colon and the value."""
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def _leaf(df: DataFrame, text: Column) -> Column:
    head = [_part(df[c].cast("string")) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*head, _part(text)).cast("binary"), 256)


def leaves(df: DataFrame) -> DataFrame:
    """doc_id, g (the source's key; a null source comes first), leaf, and altered, the leaf of a tampered text that differs."""
    text = df["text"].cast("string")
    chosen = F.crc32(df["doc_id"].cast("string").cast("binary")) % 2 == 0
    return df.select(
        df["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("1"), df["source"].cast("string")), F.lit("0")).alias("g"),
        _leaf(df, text).alias("leaf"), F.when(chosen & F.contains(text, F.lit("\n")), _leaf(df, F.replace(text, F.lit("\n"), F.lit("")))).alias("altered"),
    )


def small(df: DataFrame) -> DataFrame:
    """The table of known size, with a hint to broadcast it if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def numbered(df: DataFrame, order: list[str], rows: int | None = None) -> DataFrame:
    """df with i, the place in its group g by `order` from 0, and n, the size of the group.

    Rows are dealt to ranges of (g, order), so a large group takes many tasks; a row's place is its number in
    its range, shifted by what the ranges before hold of its group. `order` has to end with all that tells rows apart.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, "g", *order).sortWithinPartitions("g", *order).withColumn("_m", F.monotonically_increasing_id())
    dealt = materialize(dealt, rows)
    own = dealt.groupBy("g", F.shiftright("_m", 33).alias("_p")).agg(F.min("_m").alias("_first"), F.count("*").alias("_c"))
    group = Window.partitionBy("g")
    before = own.select("g", "_p", "_first", F.coalesce(F.sum("_c").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(group).alias("n"))
    placed = dealt.withColumn("_p", F.shiftright("_m", 33)).join(small(materialize(before)), ["g", "_p"])
    return placed.withColumn("i", F.col("_m") - F.col("_first") + F.col("_before")).drop("_m", "_p", "_first", "_before")


def _connect(table: pa.Table, levels: int):
    """DuckDB with the nodes of every level of a bucket, as level0, level1, ...: (i, node), i from 0."""
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    con.register("bucket", table)
    con.execute(f"create table leaves as select * replace (i % {BUCKET} as i) from bucket")
    con.execute("create view level0 as select i, leaf as node from leaves")
    for k in range(levels):
        con.execute(f"create table level{k + 1} as select i // {ARITY} as i, sha256(string_agg(node, '' order by i)) as node from level{k} group by i // {ARITY}")
    return con


def bucket_root(table: pa.Table) -> pa.Table:
    """One row (g, n, i, node): the root of a bucket's leaves; n counts the buckets of its source."""
    n, first = table["n"][0].as_py(), table["i"][0].as_py()
    levels = min(LEVELS, heights(n))
    with _connect(table, levels) as con:
        node = con.execute(f"select node from level{levels}").fetchone()[0]
    return pa.table({"g": pa.array([table["g"][0].as_py()]), "n": pa.array([-(-n // BUCKET)], pa.int64()), "i": pa.array([first // BUCKET], pa.int64()), "node": pa.array([node])})


PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def prove(table: pa.Table, way: pa.Table) -> pa.Table:
    """Every leaf's proof: siblings inside the bucket, then those on the bucket's way to the root; and the root from the altered leaf."""
    levels = min(LEVELS, heights(table["n"][0].as_py()))
    steps = way["steps"][0].as_py()
    above = "".join(s["left"] + s["right"] for s in steps)
    with _connect(table, levels) as con:
        con.execute("create table docs as select doc_id, leaf, i, coalesce(altered, leaf) as folded, '' as proof from leaves")
        for k in range(levels):
            side = lambda sign: f"coalesce(string_agg(b.node, '' order by b.i) filter (where b.i {sign} a.i), '')"
            con.execute(f"create or replace table sides as select a.i, {side('<')} as l, {side('>')} as r from level{k} a join level{k} b on a.i // {ARITY} = b.i // {ARITY} group by a.i")
            con.execute(f"create or replace table docs as select doc_id, leaf, i // {ARITY} as i, sha256(l || folded || r) as folded, proof || l || r as proof from docs join sides using (i)")
        for s in steps:
            con.execute("create or replace table docs as select * replace (sha256($1 || folded || $2) as folded) from docs", [s["left"], s["right"]])
        out = con.sql(
            "select doc_id, leaf, $2::varchar as subroot, $3::varchar as root, sha256(proof || $1) as proof_sha256, folded as folded_root from docs", params=[above, way["subroot"][0].as_py(), way["root"][0].as_py()]
        ).to_arrow_table()
    return out.cast(pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in out.column_names[1:])]))


def _runs(level: DataFrame) -> DataFrame:
    """The runs of the levels that go on: g, up (the run's number), n and its nodes in order, ARITY at most."""
    return level.where("n > 1").groupBy("g", "n", F.expr(f"i div {ARITY}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("i", "node"))).alias("run"))


def _text(run: Column) -> Column:
    return F.array_join(F.transform(run, lambda x: x["node"]), "")


def climb(nodes: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(g, node) with the root of each group, and (g, i, steps) with every node's siblings up to it.

    nodes: g, n (the group's nodes), i, node; `rows` of them. A level is a group-by of runs; each is a third of the
    one below and is written to the shared folder. Groups with one node left stay as they are.
    """
    levels = [materialize(nodes, rows, 128)]
    while not levels[-1].where("n > 1").isEmpty():
        rows = max(1, rows * 2 // 3)
        up = _runs(levels[-1]).select("g", F.ceil(F.col("n") / ARITY).alias("n"), F.col("up").alias("i"), F.sha2(_text(F.col("run")).cast("binary"), 256).alias("node"))
        levels.append(materialize(up.unionByName(levels[-1].where("n = 1")), rows, 128))
    ways = levels[-1].select("g", "i", F.array().cast(STEP).alias("steps"))
    for level in reversed(levels[:-1]):
        above = ways.select("g", F.col("i").alias("up"), "steps")
        member = _runs(level).join(above, ["g", "up"]).select("g", "run", "steps", F.explode("run").alias("own"))
        side = lambda before: _text(F.filter("run", lambda x: x["i"] < F.col("own.i") if before else x["i"] > F.col("own.i")))
        step = F.array(F.struct(side(True).alias("left"), side(False).alias("right"))).cast(STEP)
        done = level.where("n = 1").select("g", "i").join(ways.select("g", "steps"), "g")
        ways = member.select("g", F.col("own.i").alias("i"), F.concat(step, "steps").alias("steps")).unionByName(done)
    return levels[-1].select("g", "node"), ways


def manifest(df: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    df: doc_id, source, lang, n_chars, text. Leaves of a source ascend by doc_id (nulls first; rows that share one by
    their leaf, so that equal rows are leaves of their own and interchangeable). Nulls of any column are hashed as
    `-`; a null source is a source of its own, before the others; empty and very long texts are hashed whole. Rows
    without an id are never tampered with. A tree of one leaf has that leaf as its root and an empty proof. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = numbered(leaves(df), ["doc_id", "leaf", "altered"]).withColumn("bucket", F.expr(f"i div {BUCKET}"))
    roots = materialize(rows.select("g", "n", "i", "leaf", "bucket").groupBy("g", "bucket").applyInArrow(lambda t: bucket_root(t), "g string, n long, i long, node string"))
    tops, ways = climb(roots, roots.count())
    sources = tops.count()
    ordered = materialize(numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("source"), "node"), ["source", "node"], sources), sources, 128)
    top, above = climb(ordered.select("g", "n", "i", "node"), sources)
    each = ordered.select(F.col("source").alias("g"), F.col("node").alias("subroot"), "i").join(above.select("i", F.col("steps").alias("above")), "i").crossJoin(F.broadcast(top.select(F.col("node").alias("root"))))  # one row
    each = materialize(each.drop("i"), sources, 2048)
    ways = ways.join(small(each), "g").select("g", F.col("i").alias("bucket"), F.concat("steps", "above").alias("steps"), "subroot", "root")
    out = rows.groupBy("g", "bucket").cogroup(ways.groupBy("g", "bucket")).applyInArrow(lambda t, w: prove(t, w), PROVED)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 12, tops: int = 8) -> str:
    """The query op13_merkle_manifest for DuckDB, over documents of up to 3 ** levels a source and 3 ** tops sources."""
    part = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    byte = "list_transform(range(1, length(doc_id::varchar) + 1), lambda i: unicode((doc_id::varchar)[i])::bigint)"
    shift = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end))"
    crc = f"xor(list_reduce([4294967295] || {byte}, lambda c, b: {shift}), 4294967295)"
    sides = lambda sign: f"coalesce(string_agg(b.node, '' order by b.i) filter (where b.i {sign} a.i), '')"

    def tree(name: str, top: int) -> str:
        out = []
        for k in range(top):
            out.append(f"{name}{k + 1} as materialized (select g, (n + 2) // 3 n, i // 3 i, case when n > 1 then sha256(string_agg(node, '' order by i)) else any_value(node) end node from {name}{k} group by g, n, i // 3)")
            out.append(f"{name}s{k} as materialized (select a.g, a.i, {sides('<')} l, {sides('>')} r from {name}{k} a join {name}{k} b on a.g = b.g and a.i // 3 = b.i // 3 where a.n > 1 group by a.g, a.i)")
        return ", ".join(out)

    def fold(name: str, start: str, g: str, i: str, top: int) -> str:
        step = lambda k: f"{name}f{k + 1} as materialized (select d.* replace (coalesce(sha256(l || folded || r), folded) as folded, proof || coalesce(l || r, '') as proof, d.{i} // 3 as {i}) from {start if k == 0 else f'{name}f{k}'} d left join {name}s{k} s on d.{g} = s.g and d.{i} = s.i)"
        return ", ".join(step(k) for k in range(top))

    return f"""
with e as (select doc_id, coalesce('1' || source, '0') g, {part('doc_id')} || {part('source')} || {part('lang')} || {part('n_chars')} head, text from documents),
h as (select doc_id, g, sha256(head || {part('text')}) leaf, case when {crc} % 2 = 0 then sha256(head || {part("replace(text, chr(10), '')")}) end altered from e),
d as materialized (select *, count(*) over (partition by g) n, row_number() over (partition by g order by doc_id nulls first, leaf, altered) - 1 i from h),
t0 as (select g, n, i, leaf node from d), {tree('t', levels)},
top as materialized (select '' g, count(*) over () n, row_number() over (order by g) - 1 i, node, g source from t{levels}),
r0 as (select g, n, i, node from top), {tree('r', tops)},
start as (select doc_id, leaf, d.g, d.i, top.g z, top.i j, top.node subroot, coalesce(altered, leaf) folded, '' proof from d join top on d.g = top.source),
{fold('t', 'start', 'g', 'i', levels)}, {fold('r', f'tf{levels}', 'z', 'j', tops)}
select doc_id, leaf, subroot, node root, sha256(proof) proof_sha256, folded folded_root, folded = node verified from rf{tops}, r{tops}"""
