"""Problem 2: splits that keep related records together.

A component table ``(node, component, split, stands)`` is kept from batch to
batch, as versions in a shared folder that outlive the session (``component_store``);
a version is published whole or not at all and holds only the rows that changed.
A batch of new links is first contracted to components already known, of which
only those it touches are worked on; what then remains is merged by pointer jumping: every component points to its
smallest neighbour, pointers are doubled until each shows to a root, links are
redrawn between roots, and so on until no link is left.

Components of earlier batches keep their split. A merged component that holds
parts of one split takes it; one that holds parts of several splits is a
conflict: the part in the split of the largest share stands, the pairs of all
other parts, whatever is new, and every pair whose ends disagree go to
``quarantine``, so no component has pairs in two splits. The table still says
in ``split`` which split a node was given; ``stands`` is the one its pairs may
be used in. As that order of splits is fixed, a pair in quarantine never comes
back; pairs of earlier batches can go there, so ``split_pairs`` of the newest
table holds for them too. Components without any known part are new; they fill
the splits that are furthest below their share of all pairs, earlier ones too.

Edge cases: null and blank ids link nothing; a pair with one id belongs to that
id's component; a pair with neither is left out; redelivered pairs count once;
empty tables give empty results; proportions must be positive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import case_key, trial_key
from ..operators.scratch import Scratch
from ..operators.skew import HOT_ROWS, lookup_join
from ..operators.store import VersionedTable
from .components import link_edges

PROPORTIONS = {"train": 0.6, "dev": 0.2, "test": 0.2}
QUARANTINE = "quarantine"
BINS = 4096
TABLE_SCHEMA = "node string, component string, split string, stands string"


def _relabel(rows: DataFrame, column: str, pointers: DataFrame, hot_rows: int) -> DataFrame:
    """``column`` replaced by the pointer of its value, where there is one."""
    target = pointers.select(F.col("node").alias(column), F.col("parent").alias("__to"))
    joined = lookup_join(rows, target, column, "left", hot_rows)
    return joined.withColumn(column, F.coalesce("__to", column)).drop("__to")


def merge_by_jumping(edges: DataFrame, scratch: Scratch, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(node, root)`` of every node of ``(a, b)``; the root is a node of its component."""
    edges = scratch.save(edges.where("a is not null and b is not null").select("a", "b").distinct())
    known = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    edges = edges.where("a != b")
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        pointers = scratch.save(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
            .select("node", F.least("node", "least").alias("parent"))
        )
        while True:
            step = pointers.select("node", "parent", F.col("parent").alias("via"))
            ahead = pointers.select(F.col("node").alias("via"), F.col("parent").alias("far"))
            jumped = scratch.save(
                lookup_join(step, ahead, "via", "left", hot_rows)
                .select("node", F.coalesce("far", "parent").alias("parent"), (F.coalesce("far", "parent") != F.col("parent")).alias("moved"))
            )
            moved = jumped.where("moved").limit(1).count()
            scratch.drop(pointers)
            pointers = jumped
            if not moved:
                break
        following = scratch.save(_relabel(known, "root", pointers, hot_rows))
        redrawn = _relabel(_relabel(edges, "a", pointers, hot_rows), "b", pointers, hot_rows)
        redrawn = scratch.save(redrawn.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        scratch.drop(known, edges, pointers)
        known, edges = following, redrawn
    return scratch.save(known) if not hasattr(known, "_scratch_path") else known


def pair_ends(pairs: DataFrame) -> DataFrame:
    """``(pair_id, c, t)``: one row per pair with its canonical ends, marked by kind."""
    return (
        pairs.select(
            "pair_id",
            F.concat(F.lit("c|"), case_key("case_id")).alias("c"),
            F.concat(F.lit("t|"), trial_key("trial_id")).alias("t"),
        )
        .where("pair_id is not null")
        .groupBy("pair_id")
        .agg(F.min("c").alias("c"), F.min("t").alias("t"))
        .where("c is not null or t is not null")
    )


def batch_edges(ends: DataFrame, matches: DataFrame | None) -> DataFrame:
    """Links of a batch; a lone end links to itself so that it gets a component."""
    edges = ends.select(F.coalesce("c", "t").alias("a"), F.coalesce("t", "c").alias("b"))
    if matches is not None:
        for kind, mark in (("case", "c|"), ("trial", "t|")):
            links = link_edges(matches.where(F.lower(F.trim("kind")) == kind))
            edges = edges.union(links.select(F.concat(F.lit(mark), "a").alias("a"), F.concat(F.lit(mark), "b").alias("b")))
    return edges


def component_store(spark, path: str) -> VersionedTable:
    """The component table kept at a path."""
    return VersionedTable(spark, path, TABLE_SCHEMA, "node")


def touched(table: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of components that a batch of links has a node of."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    met = table.join(nodes, "node", "left_semi").select("component").distinct()
    return table.join(met, "component", "left_semi").select("node", "component", "split", "stands")


def update_components(
    table: DataFrame | None, edges: DataFrame, scratch: Scratch, hot_rows: int = HOT_ROWS, proportions: dict[str, float] | None = None,
) -> DataFrame:
    """The component table after a batch of links; ``split`` is null where none is given yet.

    Returns ``(node, component, split, stands)``: every node known before or
    new, its component after all merges, its split: its own from before if it
    had one, else the one its merged component holds, else ``quarantine`` where
    that component holds several; and the same with ``quarantine`` for all
    splits of a component but one, that of the largest share.
    """
    if table is None:
        nodes = merge_by_jumping(edges.select("a", "b"), scratch, hot_rows).select("node", F.col("root").alias("component"), F.lit(None).cast("string").alias("split"))
        return nodes.withColumn("stands", F.lit(None).cast("string"))
    known = table.select("node", F.col("component").alias("parent"))
    drawn = _relabel(_relabel(edges.select("a", "b"), "a", known, hot_rows), "b", known, hot_rows)
    merged = merge_by_jumping(drawn, scratch, hot_rows)
    nodes = (
        edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        .join(table.select("node", "component", "split"), "node", "full")
        .withColumn("component", F.coalesce("component", "node"))
    )
    nodes = _relabel(nodes, "component", merged.select("node", F.col("root").alias("parent")), hot_rows)
    nodes = scratch.save(nodes.select("node", "component", "split"))
    shares = proportions or PROPORTIONS
    order = F.array(*(F.lit(s) for s in sorted(shares, key=lambda s: (-shares[s], s))))
    place = F.array_position(order, F.col("split"))
    held = (
        nodes.where(f"split is not null and split != '{QUARANTINE}'").groupBy("component")
        .agg(
            F.min("split").alias("low"), F.max("split").alias("high"),
            F.min(F.struct(F.when(place > 0, place).otherwise(F.size(order) + 1), "split")).getField("split").alias("first"),
        )
        .select("component", "first", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit(QUARANTINE)).alias("held"))
    )
    given = F.coalesce("split", "held")
    return lookup_join(nodes, held, "component", "left", hot_rows).select(
        "node", "component", given.alias("split"), F.when(given != F.col("first"), F.lit(QUARANTINE)).otherwise(given).alias("stands")
    )


def filling(placed: DataFrame, proportions: dict[str, float]):
    """How new components are placed: a function that fills null splits of rows with a ``component``.

    ``placed`` are all pairs that count for the shares, ``(component, split)``.
    New components of more than a ``BINS``-th of all pairs (at most ``BINS``)
    are placed one by one, largest first; the others by the bin of their hash.
    Each goes to the split furthest below its share, so the driver handles at
    most twice ``BINS`` rows whatever the data size.
    """
    if not proportions or any(p <= 0 for p in proportions.values()):
        raise ValueError("proportions must be positive")
    total_share = sum(proportions.values())
    sized = placed.groupBy("component", "split").agg(F.count(F.lit(1)).alias("n"))
    have = {r["split"]: r["n"] for r in sized.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    total = sum(n for s, n in have.items() if s != QUARANTINE)
    bin_of = F.pmod(F.xxhash64("component"), F.lit(BINS))
    open_ = sized.where("split is null").select("component", "n", bin_of.alias("bin"))
    limit = max(1, total // BINS)
    # Large components by name, all others as one row per bin.
    name = F.when(F.col("n") > limit, F.col("component"))
    rows = open_.groupBy(name.alias("component"), F.when(name.isNull(), F.col("bin")).alias("bin")).agg(F.sum("n").alias("n")).collect()
    large = sorted((r for r in rows if r["component"] is not None), key=lambda r: (-r["n"], r["component"]))
    bins = sorted((r for r in rows if r["component"] is None), key=lambda r: (-r["n"], r["bin"]))
    filled = {s: have.get(s, 0) for s in proportions}

    def place(n: int) -> str:
        best = max(proportions, key=lambda s: (proportions[s] / total_share * total - filled[s], s))
        filled[best] += n
        return best

    spark = placed.sparkSession
    of_large = spark.createDataFrame([(r["component"], place(r["n"])) for r in large], "component string, given string")
    of_bin = spark.createDataFrame([(r["bin"], place(r["n"])) for r in bins], "bin long, by_bin string")
    rest = min(proportions, key=lambda s: (-proportions[s], s))

    def fill(frame: DataFrame, columns: list[str]) -> DataFrame:
        names = frame.columns
        new = F.coalesce("given", "by_bin", F.lit(rest))
        joined = frame.withColumn("bin", bin_of).join(F.broadcast(of_large), "component", "left").join(F.broadcast(of_bin), "bin", "left")
        return joined.withColumns({c: F.coalesce(c, new) for c in columns}).select(*names)

    return fill


def assign_splits(
    pairs: DataFrame, matches: DataFrame | None, scratch: Scratch, table: DataFrame | None = None,
    proportions: dict[str, float] | None = None, hot_rows: int = HOT_ROWS, earlier: DataFrame | None = None,
    store: VersionedTable | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Split one batch; returns ``(component table, pairs with component and split)``.

    The table of earlier batches is that of the ``store``, or ``table`` where there
    is none. With a store the rows that changed are published as its next
    version. Pass the pairs of the batches before as ``earlier``, so that the
    shares are those of all pairs; a pair delivered in both counts once.
    """
    shares = proportions or PROPORTIONS
    held = store.latest() if store is not None else table
    ends = scratch.save(pair_ends(pairs))
    columns = ("pair_id", "case_id", "trial_id")
    every = ends if earlier is None else scratch.save(pair_ends(earlier.select(*columns).union(pairs.select(*columns))))
    edges = batch_edges(ends, matches)
    if held is not None:
        edges = scratch.save(edges)
    part = scratch.save(touched(held, edges)) if held is not None else None
    grown = scratch.save(update_components(part, edges, scratch, hot_rows, shares)) if part is not None else update_components(None, edges, scratch, hot_rows, shares)

    def with_untouched(rows: DataFrame) -> DataFrame:
        return rows if held is None else held.join(rows.select("node"), "node", "left_anti").unionByName(rows)

    open_pairs = scratch.save(split_pairs(every, with_untouched(grown), hot_rows))
    fill = filling(open_pairs.select("component", "split"), shares)
    filled = fill(grown, ["split", "stands"])
    if store is None:
        table = with_untouched(scratch.save(filled))
        table = table if held is None else scratch.save(table)
    else:
        store.publish(filled if part is None else filled.join(part, ["node", "component", "split", "stands"], "left_anti"))
        table = store.latest()
    out = fill(open_pairs, ["split"])
    return table, out if earlier is None else out.join(ends.select("pair_id"), "pair_id", "left_semi")


def split_pairs(ends: DataFrame, table: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(pair_id, c, t, component, split)``; pairs whose ends disagree, and all of a component outside the split that stands, are in quarantine."""
    of_c = table.select(F.col("node").alias("c"), F.col("component").alias("cc"), F.col("stands").alias("cs"))
    of_t = table.select(F.col("node").alias("t"), F.col("component").alias("tc"), F.col("stands").alias("ts"))
    both = lookup_join(lookup_join(ends, of_c, "c", "left", hot_rows), of_t, "t", "left", hot_rows)
    agree = F.coalesce(F.col("cs") == F.col("ts"), F.lit(True))
    return both.select(
        "pair_id", "c", "t", F.coalesce("cc", "tc").alias("component"),
        F.when(agree, F.coalesce("cs", "ts")).otherwise(F.lit(QUARANTINE)).alias("split"),
    )


def bundles(split: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(pair_id, bundle_id, split)``; the bundle is named by its smallest case, and has none without a case."""
    name = split.where("c is not null").groupBy("component").agg(F.min(F.substring("c", 3, 1 << 30)).alias("bundle_id"))
    return lookup_join(split, name, "component", "inner", hot_rows).select("pair_id", "bundle_id", "split")
