"""Train, validation and test splits in which tied records stay together.

Companies and tickers are the nodes of a graph, a row that names both is an edge. Components are
found by breadth-first search from many seeds at once: every node whose hash is the smallest among
its neighbours is a seed, frontiers grow along hash-partitioned adjacency lists, and where two
frontiers meet the labels become an edge of a smaller graph, which is solved the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.runtime import cut, cut_path

# Names of exchanges, and words that stand for a missing ticker.
EXCHANGES = ("HOSE", "HNX", "UPCOM")
PLACEHOLDERS = ("NULL", "NONE", "NIL", "NAN", "TBD", "TBA", "VOID", "EMPTY", "UNKNOWN")
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c) for c in range(0x21, 0x7F))
BUCKETS = 1 << 14


def ticker_key(ticker: Column) -> Column:
    """The three to five letters of a ticker, in upper case; null for exchanges, placeholders and all else.

    Width, case, padding, a leading ``$`` and the name of an exchange before or after do not matter.
    """
    plain = F.upper(F.translate(ticker, *WIDE))
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[\p{Cf}\p{Cc}]+", ""), r"[\p{Z}\s]+", " "))
    names = "|".join(EXCHANGES)
    bare = F.regexp_replace(plain, rf"^(?:{names}) ?[:.\-/|_ ] ?(?=[A-Z])|(?<=[A-Z]) ?[:.\-/|_ ] ?(?:{names})$|(?<=[A-Z]) ?[(\[](?:{names})[)\]]$", "")
    bare = F.regexp_replace(bare, r"^[$(\[] ?| ?[)\]]$", "")
    return F.when(bare.rlike(r"^[A-Z]{3,5}$") & ~bare.isin(*EXCHANGES, *PLACEHOLDERS), bare)


def _key(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind), value)


def edges(*tables: DataFrame) -> DataFrame:
    """(company_id, ticker) to distinct (a, b) node names; a row without a ticker ties its company to itself."""
    # the spellings in use are few: they are made distinct before they are read
    spelt = reduce(DataFrame.unionByName, [t.select("company_id", "ticker").distinct() for t in tables]).distinct()
    both = spelt.select(F.when(F.trim("company_id") != "", F.trim("company_id")).alias("c"), ticker_key(F.col("ticker")).alias("t"))
    a, b = _key("c", F.col("c")), _key("t", F.col("t"))
    return both.where("c is not null or t is not null").select(F.coalesce(a, b).alias("a"), F.coalesce(b, a).alias("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(a, b) edges to (node, component), where the component is named by one of its nodes.

    Nodes are compared by a hash of their name, so the order of names makes no long chains. Null ends
    are left out, a self-loop keeps a node alone. Every round writes its table to the shared folder.
    """
    whole = pairs.select("a", "b").where("a is not null and b is not null")
    nodes = cut(whole.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    graph = cut(whole.where("a <> b").distinct())
    labels: list[DataFrame] = []
    while not graph.isEmpty():
        label = _search(graph)
        labels.append(label)
        x, y = label.select(F.col("node").alias("a"), F.col("label").alias("la")), label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        met = graph.join(x, "a").join(y, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
        graph = cut(met.distinct(), drop=cut_path(graph))
    out = nodes.withColumn("component", F.col("node"))
    for label in labels:
        step = label.select(F.col("node").alias("component"), F.col("label").alias("next"))
        out = out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return out


def _search(graph: DataFrame) -> DataFrame:
    """(node, label) of each node of a graph without self-loops: the seed whose frontier reached it first."""
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    near = cut(graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lowest = near.groupBy("a").agg(F.min(rank("b")).alias("low"))
    seeded = cut(lowest.select(F.col("a").alias("node"), F.when(rank("a") < F.col("low"), F.col("a")).alias("label")))
    done = [seeded.where("label is not null")]
    frontier, rest = done[0], cut(seeded.where("label is null").select("node"))
    left = rest.count()
    while left:
        reach = frontier.join(near, F.col("node") == F.col("a")).groupBy("b").agg(F.min("label").alias("label"))
        hit = cut(rest.join(reach, F.col("node") == F.col("b")).select("node", "label"))
        done.append(hit)
        rest = cut(rest.join(hit, "node", "left_anti"), drop=cut_path(rest))
        left, frontier = rest.count(), hit
    return cut(reduce(DataFrame.unionByName, done))


def tied_companies(*tables: DataFrame) -> DataFrame:
    """Pairs (company_id_a, company_id_b), a < b, of companies in one component of company and ticker."""
    parts = components(cut(edges(*tables))).where(F.col("node").startswith("c")).select(F.substring("node", 2, 1 << 30).alias("c"), "component")
    many = parts.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    parts = cut(parts.join(many, "component"))
    a, b = parts.select(F.col("c").alias("company_id_a"), "component"), parts.select(F.col("c").alias("company_id_b"), "component")
    return a.join(b, "component").where("company_id_a < company_id_b").select("company_id_a", "company_id_b")


def assign(groups: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(group, size) to (group, split) so that each split holds about its share of the total size.

    Groups of a twentieth of the smallest share or more (few, whatever the data) go one by one, largest
    first, to the split with most room. The rest follow in the order of their hash: a histogram over
    ``BUCKETS`` hash buckets gives each group its place, and the place gives the split.
    """
    names = list(shares)
    spark = groups.sparkSession
    groups = groups.select("group", "size", F.pmod(F.xxhash64("group"), F.lit(BUCKETS)).alias("bucket"))
    total = groups.agg(F.sum("size")).first()[0] or 0
    least = max(1.0, min(s for s in shares.values() if s > 0) * total / 20)
    big = groups.where(F.col("size") >= least).select("group", "size").orderBy(F.desc("size"), "group").collect()  # at most 20 / the smallest share
    room = {n: shares[n] * total for n in names}
    placed = []
    for r in big:
        best = max(names, key=lambda n: room[n])
        room[best] -= r["size"]
        placed.append((r["group"], best))
    rest = groups.where(F.col("size") < least)
    hist = dict(rest.groupBy("bucket").agg(F.sum("size")).collect())  # at most BUCKETS rows
    left = sum(hist.values())
    want = {n: max(0.0, room[n]) for n in names}
    scale = left / sum(want.values()) if sum(want.values()) else 0
    edge, limits = 0.0, []
    for n in names:
        edge += want[n] * scale
        limits.append((n, edge))
    before, run = [], 0
    for k in range(BUCKETS):
        before.append(run)
        run += hist.get(k, 0)
    starts = spark.createDataFrame([(k, int(v)) for k, v in enumerate(before) if k in hist], "bucket long, before long")
    order = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(1), "group"), "group")
    at = rest.join(F.broadcast(starts), "bucket").withColumn("at", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2)
    split = reduce(lambda c, x: F.when(F.col("at") < x[1], x[0]).otherwise(c), reversed(limits[:-1]), F.lit(names[-1]))
    small = at.select("group", split.alias("split"))
    return small.unionByName(spark.createDataFrame(placed, "group string, split string"))


def split_rows(tables: dict[str, tuple[DataFrame, str]], shares: dict[str, float] | None = None) -> DataFrame:
    """(table, row_id, company_id, component, split) of every distinct row of the given {name: (rows, id column)}.

    All rows tied by company_id or ticker, directly or through other rows, get the same split; a row
    without either is a group of its own, named by its table and id, so that its repeated copies stay
    together. Shares are by row count, the default 0.8, 0.1 and 0.1. Rows that are repeated whole count
    once each and come out as often as they stand in the table.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    part = components(edges(*(t for t, _ in tables.values())))
    rows = [
        t.select(
            F.lit(name).alias("table"), F.col(key).cast("string").alias("row_id"), "company_id",
            F.coalesce(_key("c", F.when(F.trim("company_id") != "", F.trim("company_id"))), _key("t", ticker_key(F.col("ticker")))).alias("node"),
        )
        for name, (t, key) in tables.items()
    ]
    rows = reduce(DataFrame.unionByName, rows)
    # many rows share a node: sizes are counted by node before any join
    alone = F.concat_ws(":", F.lit("r"), "table", F.coalesce("row_id", F.lit("")))
    counts = rows.groupBy("node", F.when(F.col("node").isNull(), alone).alias("alone")).agg(F.count("*").alias("n"))
    sized = counts.join(part, "node", "left").groupBy(F.coalesce("component", "node", "alone").alias("group")).agg(F.sum("n").alias("size"))
    split = assign(cut(sized), shares)
    by_node = part.join(split, part["component"] == split["group"]).select("node", "component", "split")
    named = rows.where("node is not null").join(by_node, "node").select("table", "row_id", "company_id", "component", "split")
    single = rows.where("node is null").withColumn("component", alone)
    single = single.join(split, single["component"] == split["group"]).select("table", "row_id", "company_id", "component", "split")
    return named.unionByName(single)
