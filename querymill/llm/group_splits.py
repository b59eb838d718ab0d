"""Problem 3: new splits that keep related records together.

Records of one database, or with one question in whichever database, must share a split. Databases that share
a question are linked to the smallest of them; components come from alternating large-star and small-star
rounds, each a join written to the checkpoint folder, so that neither links nor components leave the cluster.

Placement is grouped iterative stratification over label vectors: the rarest outstanding label first, its
items by falling count, each to the split that needs the label most. Every component is placed by that rule.
Components that hold at least 1/HEAVY of a label (at most HEAVY for each label) are placed first, against the
proportions of all records. What the splits then still need is shared out to shards of about SHARD of the other
components, in proportion to the labels that a shard has, and every shard is placed in a task of its own. So what
the driver and a task hold is bounded, and a shard's rounding, less than one light component for each label and
split, is below 1/HEAVY of the shard.

Defined results: a database counts without letter case and outer blanks, a question by its letters and digits
without letter case. A null or blank database ties nothing; such a record follows its question, and stands
alone without one. Questions without letters and digits tie nothing. Null labels are a label of their own. Labels
are classes to balance by: more than MAX_LABELS of them are an error. Ties go to the split named first. An empty
table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut

HEAVY = 1000
#: Light components that a task places together, and labels there may be.
SHARD = 20_000
MAX_LABELS = 1000
MAX_ROUNDS = 60
_LONE = "\x00"


def normal_name(col: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(col, r"^\s+|\s+$", "")), F.lit(""))


def question_key(col: Column) -> Column:
    """A digest of the letters and digits; null where there are none."""
    kept = F.nullif(F.lower(F.regexp_replace(col, r"[^\p{L}\p{Nd}]", "")), F.lit(""))
    return F.md5(kept)


def _nodes(df: DataFrame, record: str, database: str, question: str) -> DataFrame:
    rows = df.select(F.col(record).cast("string").alias("rid"), normal_name(F.col(database)).alias("db"),
                     question_key(F.col(question)).alias("q"))
    lone = F.concat(F.lit(_LONE), F.coalesce("q", F.concat(F.lit("row"), F.coalesce("rid", F.lit("")))))
    return rows.select("rid", F.coalesce("db", lone).alias("node"), "q")


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b: every node that shares a question with a smaller one, linked to the smallest."""
    uses = nodes.filter("q IS NOT NULL").select("q", "node").distinct()
    roots = uses.groupBy("q").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").select("q", "a")
    return uses.join(roots, "q").filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest node of its component."""
    cur = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        large = cut(large)
        # small star: every smaller neighbour of a node, and the node, go to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        star = large.join(least, "b")
        cur = cut(
            star.select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a <> b")
            .union(least.select(F.col("m").alias("a"), "b")).distinct()
        )
        # one row: the number of edges and an order-free digest of them
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        cur.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def tied_databases(df: DataFrame, catalog: DataFrame, record: str = "idx", database: str = "db_id",
                   question: str = "question", name: str = "db_id") -> DataFrame:
    """(<database>_a, <database>_b): all pairs of databases that must share a split, in the catalog's spelling."""
    parts = components(links(_nodes(df, record, database, question))).filter(~F.col("node").startswith(_LONE))
    spelt = catalog.select(normal_name(F.col(name)).alias("node"), F.col(name).alias("spelt")).dropDuplicates(["node"])
    named = parts.join(spelt, "node", "left").select("root", F.coalesce("spelt", "node").alias("db"))
    return named.select("root", F.col("db").alias(f"{database}_a")).join(
        named.select("root", F.col("db").alias(f"{database}_b")), "root"
    ).filter(F.col(f"{database}_a") < F.col(f"{database}_b")).drop("root")


def component_members(df: DataFrame, record: str = "idx", database: str = "db_id", question: str = "question") -> DataFrame:
    """(root, <database>): the databases that share a component with others, one row for each, without their pairs."""
    named = components(links(_nodes(df, record, database, question))).filter(~F.col("node").startswith(_LONE))
    first = named.groupBy("root").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return named.join(first, "root").select(F.col("first").alias("root"), F.col("node").alias(database))


Vector = Mapping[int, int]


def stratify(items: Iterable[tuple[object, Vector]], want: list[dict[int, float]]) -> dict[object, int]:
    """Iterative stratification of a bounded number of items with label vectors; the split's number for each.

    ``want`` has what every split still needs of every label, and is lessened by what is placed.
    """
    open_items = dict(items)
    having: dict[int, list[object]] = {}
    left: dict[int, int] = {}
    for key, vector in open_items.items():
        for label, n in vector.items():
            having.setdefault(label, []).append(key)
            left[label] = left.get(label, 0) + n
    total = [sum(w.values()) for w in want]
    splits = range(len(want))
    placed: dict[object, int] = {}
    while outstanding := [label for label, n in left.items() if n > 0]:
        label = min(outstanding, key=lambda k: (left[k], k))
        for key in sorted((k for k in having[label] if k in open_items), key=lambda k: (-open_items[k][label], str(k))):
            vector = open_items.pop(key)
            best = max(splits, key=lambda s: (want[s].get(label, 0.0), total[s], -s))
            placed[key] = best
            for k, n in vector.items():
                left[k] -= n
                want[best][k] = want[best].get(k, 0.0) - n
                total[best] -= n
    return placed


def assign(df: DataFrame, splits: Mapping[str, float], record: str = "idx", database: str = "db_id",
           question: str = "question", label: str = "source", out: str = "new_split") -> DataFrame:
    """(record, label, <out>): every record with its new split; proportions are scaled to one."""
    nodes = _nodes(df, record, database, question)
    parts = components(links(nodes))
    rows = df.select(F.col(record).alias("record"), F.col(record).cast("string").alias("rid"), normal_name(F.col(database)).alias("db"),
                     question_key(F.col(question)).alias("q"), F.coalesce(F.col(label).cast("string"), F.lit("(none)")).alias("label"))
    lone = F.concat(F.lit(_LONE), F.coalesce("q", F.concat(F.lit("row"), F.coalesce("rid", F.lit("")))))
    rows = rows.select("record", F.coalesce("db", lone).alias("node"), "label")
    by_node = rows.groupBy("node", "label").agg(F.count("*").alias("n"))
    counts = cut(by_node.join(parts, "node", "left").withColumn("grp", F.coalesce("root", "node")).drop("root"))
    by_group = counts.groupBy("grp", "label").agg(F.sum("n").alias("n"))
    whole = {r.label: r.n for r in by_group.groupBy("label").agg(F.sum("n").alias("n")).orderBy("label").limit(MAX_LABELS + 1).collect()}
    if len(whole) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    number = {name: i for i, name in enumerate(whole)}
    # one row for each label, at most MAX_LABELS
    labels = F.broadcast(df.sparkSession.createDataFrame([(name, i, n / HEAVY) for name, i, n in zip(whole, number.values(), whole.values())], "label string, k int, least double"))
    listed = by_group.join(labels, "label").groupBy("grp").agg(F.max(F.col("n") >= F.col("least")).alias("heavy"), F.collect_list(F.struct("k", "n")).alias("x"))
    grouped = cut(listed.select("grp", "heavy", F.col("x.k").alias("ks"), F.col("x.n").alias("ns")))
    scale = sum(splits.values())
    want = [{number[name]: share * n / scale for name, n in whole.items()} for share in splits.values()]
    heavy = [(r.grp, dict(zip(r.ks, r.ns))) for r in grouped.filter("heavy").orderBy("grp").collect()]  # at most HEAVY for each label
    chosen = stratify(heavy, want)
    rest = dict(enumerate(whole.values()))  # what the light components have of every label
    for _, vector in heavy:
        for k, n in vector.items():
            rest[k] -= n
    light = grouped.filter("NOT heavy")
    shards = max(1, -(-light.count() // SHARD))

    def place(frames: pd.DataFrame) -> pd.DataFrame:
        items = [(g, dict(zip(map(int, ks), map(int, ns)))) for g, ks, ns in sorted(zip(frames["grp"], frames["ks"], frames["ns"]), key=lambda x: x[0])]
        own: dict[int, int] = {}
        for _, vector in items:
            for k, n in vector.items():
                own[k] = own.get(k, 0) + n
        needs = [{k: w.get(k, 0.0) * n / rest[k] for k, n in own.items()} for w in want]
        placed = stratify(items, needs)
        return pd.DataFrame({"grp": list(placed), "split": pd.array(list(placed.values()), "int32")})

    spark, kinds = df.sparkSession, list(splits)
    placed = light.withColumn("shard", F.pmod(F.xxhash64("grp"), F.lit(shards))).groupBy("shard").applyInPandas(place, "grp string, split int")
    placed = placed.union(spark.createDataFrame(list(chosen.items()), "grp string, split int"))
    name = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("split") + 1)
    per_node = counts.select("node", "grp").distinct().join(placed, "grp").select("node", name.alias(out))
    return rows.join(per_node, "node").select(F.col("record").alias(record), F.col("label").alias(label), out)
