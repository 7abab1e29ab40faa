"""Graph measures on undirected edge tables (src, dst[, weight]), one row per edge.

Edges may have a column ``run``: then the table holds several graphs, nodes are told apart by (run, node), every result has the
column too, and all graphs advance in the same rounds; a run leaves when it has converged. Without it there is one graph.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, dense_index, lookup, spread

DAMPING = 0.85
# All-source searches keep one row per (source, node); sources are taken in batches of at most this many rows.
SEARCH_ROWS = 200_000_000
# Sources whose searches share the bits of one number.
WORD = 64
# Graphs with at most this many nodes and links (both directions, all runs) are handed to every task as numbers, at most 8 bytes each;
# each task searches from its own sources. Larger ones advance by joins, level by level.
TASK_LINKS = 4_000_000
# Nodes whose steps to all others say which nodes are near each other.
LANDMARKS = 4
# Nodes of the small components that a task searches together.
PACK = 4096
# Bytes; the greatest block that glibc's allocator will keep.
KEPT = 31 << 20
# Nodes and links whose moves a task works out at once in a sweep of Louvain.
SWEEP_LINKS = 32_000


def _keyed(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, bool]:
    """Edges and nodes with a run, and whether it was added."""
    single = "run" not in edges.columns
    if single:
        edges = edges.withColumn("run", F.lit(""))
        nodes = nodes.withColumn("run", F.lit("")) if nodes is not None else None
    return edges, nodes, single


def _unkeyed(result: DataFrame, single: bool) -> DataFrame:
    return result.drop("run") if single else result


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def undirected(edges: DataFrame) -> DataFrame:
    """One row per edge whatever its direction or repetition, smaller id first."""
    keep = ["run"] if "run" in edges.columns else []
    return edges.select(*keep, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).dropDuplicates()


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, with weight; a loop appears once."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    keep = ["run"] if "run" in edges.columns else []
    forth = edges.select(*keep, "src", "dst", weight.cast("double").alias("weight"))
    back = forth.filter(F.col("src") != F.col("dst")).select(
        *keep, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"
    )
    return forth.unionByName(back)


def graph_nodes(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The nodes of the edges and, if given, of a node table (node), which may have nodes without an edge."""
    keep = ["run"] if "run" in edges.columns else []
    found = edges.select(*keep, F.col("src").alias("node")).union(edges.select(*keep, "dst"))
    return (found if nodes is None else found.union(nodes.select(*keep, "node"))).distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    keep = ["run"] if "run" in edges.columns else []
    found = symmetric(edges).groupBy(*keep, F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    if nodes is None:
        return found
    return graph_nodes(edges, nodes).join(found, [*keep, "node"], "left").select(*keep, "node", F.coalesce("degree", F.lit(0)).alias("degree"))


def _per_run(rows: DataFrame, *measures) -> DataFrame:
    """One row per run, small by construction."""
    return rows.groupBy("run").agg(*measures)


def degree_centrality(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    edges, nodes, single = _keyed(edges, nodes)
    found = degrees(edges, nodes)
    others = _per_run(found, (F.count("*") - 1).cast("double").alias("others"))
    return _unkeyed(found.join(F.broadcast(others), "run").select("run", "node", (F.col("degree") / F.col("others")).alias("cent_degree")), single)


def modularity(edges: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (per run): modularity of a partition (node, community), and the number of communities."""
    edges, partition, single = _keyed(edges, partition)
    sides = (
        symmetric(edges).join(partition.select("run", F.col("node").alias("src"), F.col("community").alias("c_src")), ["run", "src"])
        .join(partition.select("run", F.col("node").alias("dst"), F.col("community").alias("c_dst")), ["run", "dst"])
    )
    per = sides.groupBy("run", "c_src").agg(
        F.sum("weight").alias("total"),
        F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("weight")).otherwise(0.0)).alias("inside"),
    )
    # sum over communities of inside/2m - resolution * (total/2m)^2, with 2m = sum of totals
    sums = _per_run(
        per, F.sum("inside").alias("i"), F.sum(F.col("total") * F.col("total")).alias("t2"), F.sum("total").alias("m2"),
        F.count("*").alias("num_communities"),
    )
    expected = F.lit(float(resolution)) * F.col("t2") / (F.col("m2") * F.col("m2"))
    return _unkeyed(sums.select("run", (F.col("i") / F.col("m2") - expected).alias("modularity"), "num_communities"), single)


def pagerank(
    edges: DataFrame, alpha: float = DAMPING, tol: float = 1e-6, max_rounds: int = 1000, block: int = 10, nodes: DataFrame | None = None
) -> DataFrame:
    """PageRank with uniform teleport, ended when the summed change falls below ``n * tol``; an error if ``max_rounds`` come first.

    ``block`` rounds run as one job; then the ranks are written and the change of the last round is checked. ``nodes`` (node) may
    name nodes without edges: their rank goes to all nodes alike. Ranks start from the degrees, near the result. Graphs within
    ``TASK_LINKS`` go through the same rounds as numbers (``_ranked``).
    """
    edges, nodes, single = _keyed(edges, nodes)
    limit = max_rounds
    adjacency = symmetric(edges)
    out = cut(adjacency.groupBy("run", "src").agg(F.sum("weight").alias("out")))
    # A plain table, not partitioned by node: a hub's links may be split over tasks by the skew join.
    links = cut(adjacency.join(out, ["run", "src"]).select("run", "src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    every = cut(graph_nodes(edges, nodes).join(out.withColumnRenamed("src", "node"), ["run", "node"], "left"))
    kind = every.schema["run"].dataType.simpleString()
    session, open_, done = edges.sparkSession, {}, []
    # One row per run. Nodes without edges get nothing but what all get, so they share one rank, which a number follows.
    for row in _per_run(every, F.count("*").alias("n"), F.count("out").alias("linked"), F.sum("out").alias("total")).collect():
        open_[row["run"]] = {"n": row["n"], "alone": row["n"] - row["linked"], "rank": 1.0 / row["n"], "total": row["total"], "linked": row["linked"]}

    def table(columns: str, values) -> DataFrame:
        return F.broadcast(session.createDataFrame([(run, *values(of)) for run, of in open_.items()], f"run {kind}, {columns}"))

    state = links.agg(F.count("*").alias("links"), F.count_if(F.expr("share IS NULL OR dst IS NULL")).alias("odd")).first()
    if open_ and not state["odd"] and state["links"] + sum(of["linked"] for of in open_.values()) <= TASK_LINKS:
        done, open_ = _ranked(links, every, open_, kind, alpha, tol, max_rounds, block)
        max_rounds = 0
    start = table("total double, linked bigint, n bigint", lambda of: (of["total"], of["linked"], of["n"])) if open_ else None
    ranks = None if not open_ or not max_rounds else cut(
        every.filter("out IS NOT NULL").join(start, "run").select("run", "node", (F.col("out") / F.col("total") * F.col("linked") / F.col("n")).alias("rank"))
    )
    for at in range(0, max_rounds, block):
        if not open_:
            break
        rounds = min(block, max_rounds - at)
        for of in open_.values():
            of["given"] = []
            for _ in range(rounds):
                of["given"].append(of["alone"] * of["rank"] / of["n"])
                of["before"], of["rank"] = of["rank"], alpha * of["given"][-1] + (1.0 - alpha) / of["n"]
        given = table("n bigint, given array<double>", lambda of: (of["n"], of["given"]))
        for i in range(rounds):
            old = ranks
            got = links.join(old.select("run", F.col("node").alias("src"), "rank"), ["run", "src"]).groupBy("run", F.col("dst").alias("node")).agg(
                F.sum(F.col("rank") * F.col("share")).alias("got")
            )
            ranks = got.join(given, "run").select("run", "node", ((F.col("got") + F.col("given")[i]) * alpha + (1.0 - alpha) / F.col("n")).alias("rank"))
        ranks = cut(ranks.join(old.select("run", "node", F.col("rank").alias("old")), ["run", "node"]))
        changes = {r["run"]: r["change"] for r in _per_run(ranks, F.sum(F.abs(F.col("rank") - F.col("old"))).alias("change")).collect()}
        settled = {r: of for r, of in open_.items() if changes.get(r, 0.0) + of["alone"] * abs(of["rank"] - of["before"]) < of["n"] * tol}
        if settled:
            done.append(ranks.filter(F.col("run").isin(list(settled))).select("run", "node", F.col("rank").alias("cent_pagerank")))
            lone = session.createDataFrame([(r, of["rank"]) for r, of in settled.items()], f"run {kind}, cent_pagerank double")
            done.append(every.filter("out IS NULL").join(F.broadcast(lone), "run").select("run", "node", "cent_pagerank"))
            open_ = {r: of for r, of in open_.items() if r not in settled}
            links, ranks = (x.filter(F.col("run").isin(list(open_))) for x in (links, ranks))
        ranks = ranks.select("run", "node", "rank")
    if open_:
        raise RuntimeError("PageRank did not converge in {} rounds".format(limit) + ("" if single else f": {sorted(map(str, open_))}"))
    if not done:
        return _unkeyed(every.select("run", "node", F.lit(0.0).alias("cent_pagerank")), single)
    return _unkeyed(_union(done), single)


def _ranked(
    links: DataFrame, every: DataFrame, runs: dict, kind: str, alpha: float, tol: float, max_rounds: int, block: int
) -> tuple[list[DataFrame], dict]:
    """The rounds of ``pagerank`` on the links (run, src, dst, share) of a graph of at most ``TASK_LINKS``; ranks, and the runs not done."""
    session = links.sparkSession
    linked = cut(dense_index(every.filter("out IS NOT NULL").select("run", "node", "out"), ["run", "node"], "number"))
    spans = sorted(_per_run(linked, F.min("number").alias("low"), F.count("*").alias("n")).collect(), key=lambda r: r["low"])
    table = linked.select("number", "out").toArrow().sort_by("number")
    start = linked.select("run", F.col("node").alias("src"), F.col("number").alias("from"))
    end = linked.select("run", F.col("node").alias("dst"), F.col("number").alias("to"))
    pairs = links.join(start, ["run", "src"]).join(end, ["run", "dst"]).select("from", "to", "share").toArrow()
    order = np.lexsort((pairs["from"].to_numpy(), pairs["to"].to_numpy()))
    origin, target, share = (pairs[c].to_numpy()[order] for c in ("from", "to", "share"))
    rows, of = table.num_rows, np.repeat(np.arange(len(spans)), [r["n"] for r in spans])
    states = [dict(runs[r["run"]]) for r in spans]
    total, linked_n, n = (np.array([x[c] for x in states], dtype=np.float64) for c in ("total", "linked", "n"))
    rank = table["out"].to_numpy() / total[of] * linked_n[of] / n[of]
    lone = {run: dict(x) for run, x in runs.items()}
    open_, found, settled = set(lone), rank.copy(), {}
    for at in range(0, max_rounds, block):
        if not open_:
            break
        for _ in range(min(block, max_rounds - at)):
            given = np.array([lone[r["run"]]["alone"] * lone[r["run"]]["rank"] / lone[r["run"]]["n"] for r in spans])
            for x in lone.values():
                x["before"], x["rank"] = x["rank"], alpha * (x["alone"] * x["rank"] / x["n"]) + (1.0 - alpha) / x["n"]
            old, got = rank, np.bincount(target, rank[origin] * share, rows)
            rank = (got + given[of]) * alpha + ((1.0 - alpha) / n)[of]
        changes = dict(zip([r["run"] for r in spans], np.bincount(of, np.abs(rank - old), len(spans)).tolist(), strict=True))
        for run in list(open_):
            x = lone[run]
            if changes.get(run, 0.0) + x["alone"] * abs(x["rank"] - x["before"]) < x["n"] * tol:
                settled[run] = x["rank"]
                open_.discard(run)
                for r in spans:
                    if r["run"] == run:
                        found[r["low"] : r["low"] + r["n"]] = rank[r["low"] : r["low"] + r["n"]]
    if not settled:
        return [], {run: runs[run] for run in open_}
    ranks = session.createDataFrame(pa.table({"number": pa.array(np.arange(rows)), "cent_pagerank": pa.array(found)}))
    lonely = session.createDataFrame(list(settled.items()), f"run {kind}, cent_pagerank double")
    done = [
        linked.filter(F.col("run").isin(list(settled))).join(ranks, "number").select("run", "node", "cent_pagerank"),
        every.filter("out IS NULL").join(F.broadcast(lonely), "run").select("run", "node", "cent_pagerank"),
    ]
    return done, {run: runs[run] for run in open_}


def closeness(edges: DataFrame, nodes: DataFrame | None = None, batches: int | None = None) -> DataFrame:
    """Closeness (scaled by the reachable share) of every node: exact, from all sources, without path counts.

    Graphs within ``TASK_LINKS`` are searched inside tasks (``_searched``), unless ``batches`` is given. Beyond,
    sixty-four sources are the bits of one number: a row (node, word) says which of them have just reached the node, a level is one
    join with the edges and a bitwise or, and what the two levels before had is masked out. So a search of all sources
    has a sixty-fourth of the rows of one per (source, node). Distances are symmetric, so counting bits per level is enough.
    """
    edges, nodes, single = _keyed(edges, nodes)
    adjacency = cut(symmetric(edges).filter(F.col("src") != F.col("dst")).select("run", "src", "dst"))
    every = cut(dense_index(graph_nodes(edges, nodes), ["run", "node"], "number"))
    sizes = _per_run(every, F.count("*").alias("n"))
    rows = every.count()
    if batches is None and rows + adjacency.count() <= TASK_LINKS:
        measured = _searched(adjacency, every, rows, False)
        share = F.col("reached") / F.col("total") * F.col("reached") / F.greatest(F.col("n") - 1, F.lit(1))
        result = measured.join(F.broadcast(sizes), "run")
        return _unkeyed(cut(result.select("run", "node", F.coalesce(F.when(F.col("total") > 0, share), F.lit(0.0)).alias("cent_closeness"))), single)
    batches = batches or max(1, -(-rows * rows // WORD // SEARCH_ROWS))
    keys, sums = ["run", "node", "word"], []
    for batch in range(batches):
        bit = F.expr(f"shiftleft(1L, CAST(number % {WORD} AS int))")
        sources = every.select("run", "node", F.expr(f"number div {WORD}").alias("word"), bit.alias("bits"))
        frontier, before, level = cut(sources.filter(F.col("word") % batches == batch)), None, 0
        while True:
            level += 1
            step = (
                frontier.join(adjacency, (F.col("node") == F.col("src")) & (frontier["run"] == adjacency["run"]))
                .groupBy(frontier["run"], F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("reached"))
            )
            # In an undirected graph a neighbour of a level lies in it, one above or one below.
            seen = frontier if before is None else frontier.unionByName(before).groupBy(*keys).agg(F.bit_or("bits").alias("bits"))
            new = step.join(seen, keys, "left").select(*keys, F.expr("reached & ~coalesce(bits, 0L)").alias("bits")).filter("bits <> 0")
            frontier, before = cut(new), frontier
            if frontier.isEmpty():
                break
            sums.append(frontier.groupBy("run", "node").agg(F.sum(F.bit_count("bits")).alias("reached")).withColumn("total", F.col("reached") * level))
    if sums:
        measured = _union(sums).groupBy("run", "node").agg(F.sum("reached").alias("reached"), F.sum("total").alias("total"))
    else:
        measured = every.select("run", "node", F.lit(0).alias("reached"), F.lit(0).alias("total"))
    share = F.col("reached") / F.col("total") * F.col("reached") / F.greatest(F.col("n") - 1, F.lit(1))
    result = every.select("run", "node").join(measured, ["run", "node"], "left").join(F.broadcast(sizes), "run")
    return _unkeyed(cut(result.select("run", "node", F.coalesce(F.when(F.col("total") > 0, share), F.lit(0.0)).alias("cent_closeness"))), single)


def path_centralities(edges: DataFrame, batches: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Betweenness (normalised) and closeness (scaled by the reachable share) of every node: exact, all sources.

    Graphs within ``TASK_LINKS`` are searched inside tasks (``_searched``), unless ``batches`` is given. Beyond, breadth-first levels
    of all sources of a batch advance together, one frontier join per level; dependencies flow back level by level. Frontier rows
    carry the number of shortest paths.
    """
    edges, nodes, single = _keyed(edges, nodes)
    adjacency = cut(symmetric(edges).filter(F.col("src") != F.col("dst")).select("run", "src", "dst"))
    every = cut(dense_index(graph_nodes(edges, nodes), ["run", "node"], "number"))
    sizes = cut(_per_run(every, F.count("*").alias("n")))
    if batches is None and (count := every.count()) + adjacency.count() <= TASK_LINKS:
        per_node = _searched(adjacency, every, count, True)
    else:
        rows = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0]
        batches = batches or max(1, -(-rows // SEARCH_ROWS))
        parts = []
        for batch in range(batches):
            sources = every.filter(F.pmod(F.xxhash64("node"), F.lit(batches)) == batch)
            parts.append(cut(_paths_from(adjacency, sources)))
        per_node = every.select("run", "node").join(
            _union(parts).groupBy("run", "node").agg(*[F.sum(c).alias(c) for c in ("between", "total", "reached")]), ["run", "node"], "left"
        )
    n = F.col("n").cast("double")
    scale = F.when(n > 2, 1.0 / ((n - 1) * (n - 2))).otherwise(1.0)
    closeness = F.when(F.col("total") > 0, F.col("reached") / F.col("total") * F.col("reached") / F.greatest(n - 1, F.lit(1.0))).otherwise(0.0)
    result = per_node.join(F.broadcast(sizes), "run").select(
        "run", "node",
        (F.coalesce("between", F.lit(0.0)) * scale).alias("cent_betweenness"),
        F.coalesce(closeness, F.lit(0.0)).alias("cent_closeness"),
    )
    return _unkeyed(cut(result), single)


def _searched(adjacency: DataFrame, every: DataFrame, rows: int, paths: bool) -> DataFrame:
    """(run, node, between, total, reached) of the nodes (run, node, number), searched from each of them inside tasks.

    Nodes get other numbers, by which near ones are neighbours in every array (``_near_order``). A batch of a task is up to ``WORD`` near
    sources of a component, or all sources of some small ones; its arrays are as long as these components. Nodes of different runs
    never meet. ``between`` needs ``paths``, else it is 0.
    """
    start = every.select("run", F.col("node").alias("src"), F.col("number").alias("from"))
    end = every.select("run", F.col("node").alias("dst"), F.col("number").alias("to"))
    table = adjacency.join(start, ["run", "src"]).join(end, ["run", "dst"]).select("from", "to").toArrow()
    origin, target = (table.column(c).to_numpy() for c in ("from", "to"))
    order, borders = _near_order(origin, target, rows)
    place = np.empty(rows, dtype=np.int64)
    place[order] = np.arange(rows)
    origin, target = place[origin], place[target]
    starts = np.concatenate([[0], np.cumsum(np.bincount(origin, minlength=rows))])
    targets = target[np.lexsort((target, origin))].astype(np.int32)
    batches = _batches(borders)
    cost = np.cumsum(starts[batches[:, 1]] - starts[batches[:, 0]] + batches[:, 1] - batches[:, 0]) if len(batches) else np.zeros(0)
    parts = max(1, min(2 * int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(batches)))
    dealt = np.searchsorted(cost, np.linspace(0, cost[-1] if len(cost) else 0, parts + 1)[1:-1])
    shipped = every.sparkSession.sparkContext.broadcast((starts, targets, order, borders, np.split(batches, dealt)))

    def run(tasks):
        starts, targets, order, borders, shares = shipped.value
        between, total, reached = np.zeros(rows if paths else 0), np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
        np.ones(KEPT // 8)  # once a block of this size is free again, the allocator keeps smaller ones for the next arrays
        for task in tasks:
            for number in task.column(0).to_pylist():
                for low, high, first in shares[number].tolist():
                    here = slice(low, high)
                    of = borders[np.searchsorted(borders, low) : np.searchsorted(borders, high) + 1] - low
                    links = targets[starts[low] : starts[high]] - low
                    _search(starts[low : high + 1] - starts[low], links, of, first - low, total[here], reached[here], between[here] if paths else None)
        some = np.flatnonzero(reached)
        measured = between[some] if paths else np.zeros(len(some))
        yield pa.RecordBatch.from_arrays([pa.array(order[some]), pa.array(measured), pa.array(total[some]), pa.array(reached[some])], names=names)

    names = ["number", "between", "total", "reached"]
    found = every.sparkSession.range(0, parts, 1, parts).mapInArrow(run, "number bigint, between double, total bigint, reached bigint")
    return every.join(found.groupBy("number").agg(*[F.sum(c).alias(c) for c in names[1:]]), "number", "left").drop("number")


def _links_of(starts: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the links of the nodes lie, node by node, and where each node's begin among them."""
    sizes = starts[nodes + 1] - starts[nodes]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[nodes] - (ends - sizes), sizes), ends - sizes


def _near_order(origin: np.ndarray, target: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes 0 to ``rows`` in an order that has near ones together, and where in it the components begin (and the last ends).

    Components go by size. Inside one, the steps from ``LANDMARKS`` nodes far from each other serve as coordinates; nodes are halved
    along the widest one again and again, down to blocks of ``WORD``.
    """
    order = np.argsort(origin, kind="stable")
    starts, targets = np.concatenate([[0], np.cumsum(np.bincount(origin, minlength=rows))]), target[order]
    label = np.arange(rows)
    while True:
        least = label.copy()
        np.minimum.at(least, origin, label[target])
        least = least[least]
        if (least == label).all():
            break
        label = least
    _, label, sizes = np.unique(label, return_inverse=True, return_counts=True)
    label = np.argsort(np.argsort(sizes, kind="stable"), kind="stable")[label]  # components by size
    sizes = np.sort(sizes)
    borders = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(label, kind="stable")
    if not rows or sizes[-1] <= WORD:
        return order, borders
    coordinates, nearest = [], np.full(rows, rows)
    begin = order[borders[:-1]]
    for at in range(LANDMARKS + 1):
        steps, front, level = np.full(rows, -1), begin, 0
        steps[front] = 0
        while len(front):
            level += 1
            to = targets[_links_of(starts, front)[0]]
            front = np.unique(to[steps[to] < 0])
            steps[front] = level
        if at:
            coordinates.append(steps)
            nearest = np.minimum(nearest, steps)
        else:
            nearest = np.minimum(nearest, steps)  # the first one only finds a far node
        far = np.lexsort((nearest, label))
        begin = far[borders[1:] - 1]
        if not at:
            nearest = np.full(rows, rows)
    group = borders
    while (wide := np.diff(group)).max() > WORD:
        # Every group in halves of whole blocks, along its widest coordinate.
        spreads = np.stack([np.maximum.reduceat(c[order], group[:-1]) - np.minimum.reduceat(c[order], group[:-1]) for c in coordinates])
        of = np.repeat(np.arange(len(wide)), wide)
        along = np.stack(coordinates)[spreads.argmax(axis=0)[of], order]
        order = order[np.lexsort((along, of))]
        half = group[:-1] + -(-(-(-wide // WORD)) // 2) * WORD
        group = np.unique(np.concatenate([group, half[wide > WORD]]))
    return order, borders


def _batches(borders: np.ndarray) -> np.ndarray:
    """(low, high, first) of the batches: nodes ``low`` to ``high`` are whole components, sources go from ``first`` on.

    Small components, as many as have ``PACK`` nodes together, are one batch: each bit is a source in every component then.
    """
    sizes, batches, low = np.diff(borders), [], 0
    small = int(np.searchsorted(sizes, WORD, side="right"))
    while low < small:
        high = max(low + 1, min(small, int(np.searchsorted(borders, borders[low] + PACK, side="right")) - 1))
        if sizes[high - 1] > 1:
            batches.append(np.array([[borders[low], borders[high], borders[low]]]))
        low = high
    for low, high in zip(borders[small:-1].tolist(), borders[small + 1 :].tolist(), strict=True):
        first = np.arange(low, high, WORD)
        batches.append(np.column_stack([np.full(len(first), low), np.full(len(first), high), first]))
    return np.concatenate(batches) if batches else np.zeros((0, 3), dtype=np.int64)


def _search(
    starts: np.ndarray, targets: np.ndarray, borders: np.ndarray, first: int, total: np.ndarray, reached: np.ndarray, between: np.ndarray | None
) -> None:
    """Add to each node its distances from the sources, the number of those that reach it, and their dependencies (Brandes).

    Node i's neighbours are ``targets[starts[i]:starts[i + 1]]``; components lie between ``borders``, and the sources of each are
    its nodes from ``first`` on, ``WORD`` at most, every one a bit. A node's word says which sources have reached it, so near sources share
    their steps; only nodes beside reached ones that miss a source are looked at. The bits of a level's number are
    kept for every (node, source), which the dependencies need.
    """
    n, sizes = len(starts) - 1, np.diff(borders)
    width = np.minimum(sizes if len(sizes) > 1 else sizes - first, WORD)
    bit = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    source = np.repeat(borders[:-1] + (first if len(sizes) == 1 else 0), width) + bit
    seen, front = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    seen[source] = np.uint64(1) << bit.astype(np.uint64)
    full = np.repeat(np.uint64(0xFFFFFFFFFFFFFFFF) >> (WORD - width).astype(np.uint64), sizes)
    front[source] = seen[source]
    rows = fresh = source
    met, near = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    met[rows] = True
    open_, level, planes = np.zeros(0, dtype=np.int64), 0, []
    while True:
        level += 1
        to = targets[_links_of(starts, fresh)[0]]
        to = np.unique(to[~near[to]])
        near[to] = True
        open_ = np.concatenate([open_, to])
        open_ = open_[seen[open_] != full[open_]]
        if not len(open_):
            break
        links, begin = _links_of(starts, open_)
        got = np.bitwise_or.reduceat(front[targets[links]], begin) & ~seen[open_]
        front[rows] = 0
        hit = np.flatnonzero(got)
        if not len(hit):
            break
        rows, new = open_[hit], got[hit]
        fresh = rows[~met[rows]]
        met[fresh] = True
        seen[rows] |= new
        front[rows] = new
        count = np.bitwise_count(new).astype(np.int64)
        total[rows] += level * count
        reached[rows] += count
        if between is not None:
            while level >> len(planes):
                planes.append(np.zeros(n, dtype=np.uint64))
            for i, plane in enumerate(planes):
                if level >> i & 1:
                    plane[rows] |= new
    if between is None or not planes:
        return
    own = np.repeat(np.arange(n), np.diff(starts))
    one = np.flatnonzero(own < targets)  # every link once, as often as it is repeated
    ends = own[one], targets[one].astype(np.int64)
    for byte in range(0, int(width.max()), 8):
        parts = []  # the bits of eight planes at a time, for eight sources
        for low in range(0, len(planes), 8):
            part = np.zeros((n, 8), dtype=np.uint8)
            for i, plane in enumerate(planes[low : low + 8]):
                part |= np.unpackbits((plane >> np.uint64(byte)).astype(np.uint8), bitorder="little").reshape(n, 8) << np.uint8(i)
            parts.append(part)
        for at in range(byte, min(byte + 8, int(width.max()))):
            depth = np.zeros(n, dtype=np.int16 if len(planes) < 16 else np.int64)
            for i, part in enumerate(parts):
                depth |= part[:, at - byte].astype(depth.dtype) << (8 * i)
            _depend(*ends, depth, source[bit == at], between)


def _depend(one: np.ndarray, two: np.ndarray, depth: np.ndarray, sources: np.ndarray, between: np.ndarray) -> None:
    """Add the dependencies on a source (one in each component); ``one`` and ``two``: the ends of the links, ``depth``: steps to the nodes.

    The links between different depths, in order of the greater one, make up all shortest paths. Along them counts go forth, and back the
    sum of (1 + dependency) / count of what follows.
    """
    left, right = depth[one], depth[two]
    at = np.flatnonzero(left != right)
    a, b, left, right = one[at], two[at], left[at], right[at]
    after = np.where(left > right, a, b)
    level = np.maximum(left, right)
    order = np.argsort(level, kind="stable")
    after = after[order]
    before = (a + b)[order] - after
    ends = np.cumsum(np.bincount(level)).tolist()
    counts, back = np.zeros(len(depth)), np.zeros(len(depth))
    counts[sources] = 1.0
    spans = list(zip(ends[:-1], ends[1:], strict=True))
    for low, high in spans:
        np.add.at(counts, after[low:high], counts[before[low:high]])
    shares = 1.0 / counts[after]
    for low, high in reversed(spans):
        np.add.at(back, before[low:high], shares[low:high] + back[after[low:high]])
    back *= counts
    back[sources] = 0.0
    between += back


def _paths_from(adjacency: DataFrame, sources: DataFrame) -> DataFrame:
    """Per node: summed dependencies, summed distances and count of the sources that reach it."""
    frontier = cut(sources.select("run", F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")))
    levels = [frontier]
    while True:
        # In an undirected graph a neighbour of a level lies in it, one above or one below.
        seen = levels[-1].select("run", "source", "node")
        if len(levels) > 1:
            seen = seen.union(levels[-2].select("run", "source", "node"))
        step = (
            levels[-1].withColumnRenamed("node", "src").join(adjacency, ["run", "src"])
            .groupBy("run", "source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
            .join(seen, ["run", "source", "node"], "left_anti")
        )
        step = cut(step)
        if step.isEmpty():
            break
        levels.append(step)
    back = levels[-1].withColumn("depends", F.lit(0.0))
    measured = []
    for depth in range(len(levels) - 1, 0, -1):
        measured.append(_level_sums(back, depth))
        share = back.select(
            "run", "source", F.col("node").alias("src"), ((F.col("depends") + 1.0) / F.col("paths")).alias("share")
        )
        flow = (
            share.join(adjacency, ["run", "src"])
            .select("run", "source", F.col("dst").alias("node"), "share")
            .join(levels[depth - 1], ["run", "source", "node"])
            .groupBy("run", "source", "node").agg((F.first("paths") * F.sum("share")).alias("depends"))
        )
        back = cut(levels[depth - 1].join(flow, ["run", "source", "node"], "left").na.fill(0.0, ["depends"]))
    if not measured:
        return sources.select("run", "node", F.lit(0.0).alias("between"), F.lit(0).alias("total"), F.lit(0).alias("reached"))
    return _union(measured).groupBy("run", "node").agg(*[F.sum(c).alias(c) for c in ("between", "total", "reached")])


def _level_sums(level: DataFrame, depth: int) -> DataFrame:
    return level.groupBy("run", "node").agg(
        F.sum("depends").alias("between"), (F.count("*") * depth).alias("total"), F.count("*").alias("reached")
    )


def louvain(edges: DataFrame, resolution: float = 1.0, nodes: DataFrame | None = None) -> DataFrame:
    """Louvain communities: (node, community), communities numbered from 0 by size, then by smallest node.

    A level ends when no node has a move that raises the modularity; then communities become the nodes of the next level. After the
    last level the single nodes get their turn again, and if one moves, the levels begin anew from there. So at the end no move of a
    node and no merger of two communities raises the modularity. There is no limit of sweeps or levels: modularity rises with every
    sweep that is kept. ``nodes`` may name nodes without edges, which stay alone. Of several runs each goes the way it would go
    alone: a run that has ended a level waits for the others, one without a move leaves.
    """
    edges, nodes, single = _keyed(edges, nodes)
    links = cut(symmetric(edges))
    mapping = cut(graph_nodes(edges).withColumn("community", F.col("node")))
    adjacency, again = links, None
    while True:
        partition, moved = _move_nodes(adjacency, resolution, again)
        if not moved:
            if again is not None:
                break
            adjacency, again = links, mapping
            continue
        partition = partition.filter(F.col("run").isin(moved))
        step = partition.select("run", F.col("node").alias("from"), F.col("community").alias("parent"))
        at = "community" if again is None else "node"
        mapping = cut(
            mapping.join(step.withColumnRenamed("from", at), ["run", at], "left").select("run", "node", F.coalesce("parent", "community").alias("community"))
        )
        if again is not None:  # runs in which nothing moved have ended
            links, again = links.filter(F.col("run").isin(moved)), None
        side = partition.select("run", F.col("node").alias("src"), F.col("community").alias("c_src"))
        other = partition.select("run", F.col("node").alias("dst"), F.col("community").alias("c_dst"))
        adjacency = cut(
            adjacency.join(side, ["run", "src"]).join(other, ["run", "dst"])
            .groupBy("run", F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("weight").alias("weight"))
        )
    if nodes is not None:
        alone = nodes.select("run", "node").distinct().join(mapping, ["run", "node"], "left_anti")
        mapping = mapping.unionByName(alone.withColumn("community", F.col("node")))
    sizes = mapping.groupBy("run", "community").agg(F.count("*").alias("size"), F.min("node").alias("first"))
    numbered = dense_index(sizes, [F.col("run"), F.col("size").desc(), F.col("first")], "number")
    firsts = _per_run(numbered, F.min("number").alias("from"))
    named = mapping.join(numbered, ["run", "community"]).join(F.broadcast(firsts), "run")
    return _unkeyed(cut(named.select("run", "node", (F.col("number") - F.col("from")).alias("community"))), single)


def best_moves(adjacency: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Each node (run, node, k, community, m2) with its best neighbouring community: (run, node, k, m2, own, to, better, inside, tot).

    ``m2`` is the total weight of the run's graph, both directions. ``better``: what the move adds to the modularity, times half of
    that; null or below zero if no move does.
    """
    totals = partition.groupBy("run", "community").agg(F.sum("k").alias("tot"))
    near = (
        adjacency.filter(F.col("src") != F.col("dst"))
        .join(partition.select("run", F.col("node").alias("dst"), "community"), ["run", "dst"])
        .groupBy("run", F.col("src").alias("node"), "community").agg(F.sum("weight").alias("w"))
    )
    stay = partition.select("run", "node", "community", F.lit(0.0).alias("w"))
    own = partition.select("run", "node", "k", "m2", F.col("community").alias("own"))
    options = (
        near.unionByName(stay).groupBy("run", "node", "community").agg(F.sum("w").alias("w")).join(own, ["run", "node"]).join(totals, ["run", "community"])
    )
    mine = F.col("community") == F.col("own")
    rest = F.col("tot") - F.when(mine, F.col("k")).otherwise(0.0)
    ranked = options.withColumn("gain", F.col("w") - F.lit(float(resolution)) / F.col("m2") * rest * F.col("k")).groupBy("run", "node").agg(
        F.first("k").alias("k"), F.first("m2").alias("m2"), F.first("own").alias("own"), F.max(F.when(mine, F.col("gain"))).alias("now"),
        # Largest gain; among equal gains the smallest community.
        F.min(F.when(~mine, F.struct((-F.round("gain", 9)).alias("cost"), "community"))).alias("top"),
        F.max(F.when(~mine, F.col("gain"))).alias("gain"),
        F.sum(F.when(mine, F.col("w"))).alias("inside"), F.max(F.when(mine, F.col("tot"))).alias("tot"),
    )
    return ranked.select("run", "node", "k", "m2", "own", F.col("top.community").alias("to"), (F.col("gain") - F.col("now")).alias("better"), "inside", "tot")


def with_strength(adjacency: DataFrame) -> DataFrame:
    """(run, node, k, m2): the weight at every node and in its run's whole graph."""
    strength = adjacency.groupBy("run", F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
    return strength.join(F.broadcast(_per_run(strength, F.sum("k").alias("m2"))), "run")


def _move_nodes(adjacency: DataFrame, resolution: float, start: DataFrame | None = None) -> tuple[DataFrame, list]:
    """Local moving on one level, from ``start`` or from single nodes, until no node has a positive move; the runs in which any moved.

    First the nodes of one hash half move at once, halves alternating, as long as each sweep raises the modularity. From the best
    partition on, only moves that share no community with one of smaller hash go through: their gains are exact, so every
    sweep raises it, and the end is a local optimum. All runs sweep together, each in its own state; one row per run is collected.
    Graphs within ``TASK_LINKS`` are swept by ``_swept``, with the same moves.
    """
    nodes = with_strength(adjacency).filter("m2 > 0")
    links = adjacency.count()
    if links <= TASK_LINKS:  # no node without a link
        every = cut(dense_index(nodes.filter("run IS NOT NULL AND node IS NOT NULL"), ["run", "node"], "number"))
        if (rows := every.count()) + links <= TASK_LINKS:
            return _swept(adjacency, every, rows, resolution, start)
    current = cut(nodes.withColumn("community", F.col("node")) if start is None else nodes.join(start, ["run", "node"]))
    runs = [r["run"] for r in current.select("run").distinct().collect()]
    sweep, exact, quality_of, moved, ended = dict.fromkeys(runs, 0), dict.fromkeys(runs, False), {}, [], []
    previous = None
    kind = current.schema["run"].dataType.simpleString()
    while runs:
        control = current.sparkSession.createDataFrame([(r, sweep[r], exact[r]) for r in runs], f"run {kind}, sweep int, exact boolean")
        found = best_moves(adjacency, current, resolution)
        found = lookup(found, control, "run", len(runs)).withColumn("hash", F.xxhash64("node", F.expr("sweep div 2").cast("int")))
        wants = F.coalesce(F.col("better") > 1e-9 * F.col("m2"), F.lit(False))
        found = cut(found.withColumn("wants", wants))
        rows = _per_run(
            found, F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("tot")).alias("t2"), F.count_if("wants").alias("wants"), F.first("m2").alias("m2")
        ).collect()
        back, go = [], []
        for row in rows:
            run = row["run"]
            # Loops are the same in every partition of the level.
            quality = row["inside"] / row["m2"] - resolution * row["t2"] / (row["m2"] * row["m2"])
            if not exact[run] and run in quality_of and quality <= quality_of[run] + 1e-12:
                back.append(run)  # the last sweep did not pay: back, and on with exact moves
                exact[run] = True
            else:
                quality_of[run] = quality
                if row["wants"]:
                    go.append(run)
                    moved += [run] if run not in moved else []
                else:
                    ended.append(current.filter(F.col("run") == F.lit(run)))
            sweep[run] += 1
        steps = []
        if go:
            going = found.filter(F.col("run").isin(go))
            movers = going.filter("exact AND wants").select("run", "node", "own", "to", "hash")
            first = movers.select("run", "hash", F.explode(F.array("own", "to")).alias("at")).groupBy("run", "at").agg(F.min("hash").alias("first"))
            free = (
                movers.join(first.select("run", F.col("at").alias("own"), F.col("first").alias("at_own")), ["run", "own"])
                .join(first.select("run", F.col("at").alias("to"), F.col("first").alias("at_to")), ["run", "to"])
                .filter("hash = at_own AND hash = at_to").select("run", "node", F.col("to").alias("target"))
            )
            turn = F.expr("NOT exact AND wants AND pmod(hash, 2) = sweep % 2")
            after = going.join(free, ["run", "node"], "left") if any(exact[r] for r in go) else going.withColumn("target", F.lit(None).cast(going.schema["own"].dataType))
            steps.append(after.select("run", "node", "k", "m2", F.coalesce("target", F.when(turn, F.col("to")), "own").alias("community")))
        if back:
            steps.append(previous.filter(F.col("run").isin(back)))
        runs = [*go, *back]
        if runs:
            previous, current = current, cut(_union(steps))
            adjacency = adjacency if len(runs) == len(rows) else cut(adjacency.filter(F.col("run").isin(runs)))
    return (cut(_union(ended)) if ended else current), moved


def _swept(adjacency: DataFrame, every: DataFrame, rows: int, resolution: float, start: DataFrame | None) -> tuple[DataFrame, list]:
    """``_move_nodes`` of a graph of at most ``TASK_LINKS``: links go to every task once, the communities in every sweep; each task
    works out the best moves of its own nodes, and only the moves come back. ``every``: nodes numbered from 0 in order of run and node."""
    context = every.sparkSession.sparkContext
    numbers = every.select("run", "node", "number")
    table = every.select("number", "k", "m2", F.xxhash64("node").alias("hash")).toArrow().sort_by("number")
    k, m2, hashes = (table.column(c).to_numpy() for c in ("k", "m2", "hash"))
    community = np.arange(rows)
    if start is not None:
        own = numbers.withColumnsRenamed({"node": "community", "number": "at"})
        begun = start.join(numbers, ["run", "node"]).join(own, ["run", "community"]).select("number", "at").toArrow()
        community[begun.column("number").to_numpy()] = begun.column("at").to_numpy()
    spans = sorted(_per_run(every, F.min("number").alias("low"), F.count("*").alias("n")).collect(), key=lambda r: r["low"])
    of = np.repeat(np.arange(len(spans)), [r["n"] for r in spans])  # the run of each node
    origin = numbers.select("run", F.col("node").alias("src"), F.col("number").alias("from"))
    target = numbers.select("run", F.col("node").alias("dst"), F.col("number").alias("to"))
    table = adjacency.filter(F.col("src") != F.col("dst")).join(origin, ["run", "src"]).join(target, ["run", "dst"]).select("from", "to", "weight").toArrow()
    sources = table.column("from").to_numpy()
    order = np.argsort(sources, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(sources, minlength=rows))])
    shipped = context.broadcast((starts, table.column("to").to_numpy()[order], table.column("weight").to_numpy()[order], k, m2, of))
    parts = max(1, min(int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")), (rows + len(order)) // SWEEP_LINKS))
    borders = np.searchsorted(starts + np.arange(rows + 1), np.linspace(0, rows + len(order), parts + 1)).tolist()

    n = len(spans)
    sweep, exact, open_, quality_of, moved = np.zeros(n, dtype=int), np.zeros(n, dtype=bool), np.ones(n, dtype=bool), {}, []
    previous = community
    while open_.any():
        state = context.broadcast((community, open_))

        def moves(part: int) -> tuple:
            return _moves_of(*shipped.value, *state.value, borders[part], borders[part + 1], resolution)

        found = context.parallelize(range(parts), parts).map(moves).collect()
        state.destroy()
        movers, to = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        inside, squares = (np.sum([f[i] for f in found], axis=0) for i in (2, 3))
        wants = np.bincount(of[movers], minlength=n)
        after, going = community.copy(), np.zeros(n, dtype=bool)
        for run in np.flatnonzero(open_).tolist():
            here = slice(spans[run]["low"], spans[run]["low"] + spans[run]["n"])
            total = m2[spans[run]["low"]]
            quality = inside[run] / total - resolution * squares[run] / (total * total)
            if not exact[run] and run in quality_of and quality <= quality_of[run] + 1e-12:
                exact[run] = True  # the last sweep did not pay: back, and on with exact moves
                after[here] = previous[here]
                continue
            quality_of[run] = quality
            if wants[run]:
                going[run] = True
                moved += [run] if run not in moved else []
            else:
                open_[run] = False
        some = going[of[movers]]
        movers, to = movers[some], to[some]
        turn = sweep[of[movers]]
        steps = [int(x).to_bytes(4, "little") for x in range(int(turn.max(initial=0)) // 2 + 1)]
        # What xxhash64(node, sweep div 2) is.
        drawn = [xxhash.xxh64_intdigest(steps[t // 2], h & 0xFFFFFFFFFFFFFFFF) for t, h in zip(turn.tolist(), hashes[movers].tolist(), strict=True)]
        drawn = np.array(drawn, dtype=np.uint64).view(np.int64)
        own = community[movers]
        first = np.full(rows, np.iinfo(np.int64).max)
        np.minimum.at(first, own, drawn)
        np.minimum.at(first, to, drawn)
        free = np.where(exact[of[movers]], (first[own] == drawn) & (first[to] == drawn), (drawn & 1) == turn % 2)
        after[movers[free]] = to[free]
        previous, community = community, after
        sweep += 1
    shipped.destroy()
    ended = every.sparkSession.createDataFrame(pa.table({"number": pa.array(np.arange(rows)), "at": pa.array(community)}))
    names = numbers.select("run", F.col("number").alias("at"), F.col("node").alias("community"))
    partition = every.join(ended, "number").join(names, ["run", "at"]).select("run", "node", "k", "m2", "community")
    return cut(partition), [spans[run]["run"] for run in moved]


def _moves_of(
    starts: np.ndarray, targets: np.ndarray, weights: np.ndarray, k: np.ndarray, m2: np.ndarray, of: np.ndarray, community: np.ndarray, open_: np.ndarray, low: int, high: int, resolution: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes from ``low`` to ``high`` of open runs that have a move that pays, and their best communities; for each run the weight inside
    communities and the strengths times those of the communities. The rules are those of ``best_moves``."""
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(open_)), np.zeros(len(open_))
    if low == high or not open_[of[low] : of[high - 1] + 1].any():
        return none
    totals = np.bincount(community, k, len(k))
    own, size = community[low:high], high - low
    node = np.concatenate([np.repeat(np.arange(size), np.diff(starts[low : high + 1])), np.arange(size)])
    to = np.concatenate([community[targets[starts[low] : starts[high]]], own])
    w = np.concatenate([weights[starts[low] : starts[high]], np.zeros(size)])
    order = np.argsort(node * len(k) + to, kind="stable")
    node, to = node[order], to[order]
    first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (to[1:] != to[:-1])]))
    node, to, w = node[first], to[first], np.add.reduceat(w[order], first)
    mine, strength = to == own[node], k[low:high][node]
    gain = w - resolution / m2[low:high][node] * (totals[to] - np.where(mine, strength, 0.0)) * strength
    now = gain[mine]  # each node once, in order
    inside = np.bincount(of[low:high], w[mine], len(open_))
    squares = np.bincount(of[low:high], k[low:high] * totals[own], len(open_))
    node, to, gain = node[~mine], to[~mine], gain[~mine]
    if not len(node):
        return *none[:2], inside, squares
    order = np.lexsort((to, -np.round(gain, 9), node))  # largest gain; among equal gains the smallest community
    node, to, gain = node[order], to[order], gain[order]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    better = np.maximum.reduceat(gain, first) - now[node[first]]
    wants = (better > 1e-9 * m2[low:high][node[first]]) & open_[of[low:high][node[first]]]
    return node[first][wants] + low, to[first][wants], inside, squares
