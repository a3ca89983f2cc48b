"""Nearest neighbours by largest inner product, with an HNSW graph per shard (operator 1).

Vectors are dealt to shards of bounded size by a hash of their id. Each shard is a hierarchy of
navigable small-world graphs, kept as flat arrays: vectors, and for each level the neighbours
of its nodes, padded with -1. Every query searches every shard, and the shards' results are
merged. Links are made between vectors extended by one component that gives all of them the
same length; against a query extended by 0 their inner products are the original ones.

Searches run in lockstep: for many queries at once, the best candidates not yet expanded are
expanded together.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.llm.shipping import ship
from newsloom.workspace import write_through

NEAREST = 20
#: Vectors of a shard, and queries that search it in one task.
SHARD = 8_192
QUERIES = 20_000
#: Links of a node, candidates while building and while searching.
LINKS = 32
BUILD_WIDTH = 96
SEARCH_WIDTH = 192
#: Candidates of a query expanded together; queries searched together.
EXPANDED = 4
TOGETHER = 256


class Level:
    """The nodes of one level (positions among the shard's vectors) and their neighbours."""

    def __init__(self, nodes, links):
        self.nodes, self.links = nodes, links


def search_level(vectors, links, queries, entries, width):
    """The ``width`` best nodes found for each query: ``(nodes, scores)``, best first, -1 for none.

    ``entries`` are the nodes to start from, one row for each query.
    """
    n, b = len(vectors), len(queries)
    seen = np.zeros((b, n), bool)
    rows = np.arange(b)[:, None]
    entries = _without_repeats(entries)
    seen[np.broadcast_to(rows, entries.shape)[entries >= 0], entries[entries >= 0]] = True
    scores = _scores(vectors, queries, entries)
    pad = width - entries.shape[1]
    if pad > 0:
        entries = np.pad(entries, ((0, 0), (0, pad)), constant_values=-1)
        scores = np.pad(scores, ((0, 0), (0, pad)), constant_values=-np.inf)
    nodes, scores, open_ = _best(entries, scores, entries >= 0, width)
    active = np.arange(b)
    while len(active):
        waiting = open_[active]
        going = waiting.any(axis=1)
        active = active[going]
        if not len(active):
            break
        # the first few open candidates of each row; rows are best first
        turn = np.argsort(~waiting[going], axis=1, kind="stable")[:, :EXPANDED]
        live = np.take_along_axis(waiting[going], turn, 1)
        at = np.take_along_axis(nodes[active], turn, 1)
        own = open_[active]
        np.put_along_axis(own, turn, False, 1)
        open_[active] = own
        reached = np.where(live[:, :, None], links[at], -1).reshape(len(active), -1)
        known = seen[active[:, None], reached] | (reached < 0)
        reached = _without_repeats(np.where(known, -1, reached))
        r, c = np.nonzero(reached >= 0)
        seen[active[r], reached[r, c]] = True
        new = np.full(reached.shape, -np.inf, np.float32)
        new[r, c] = np.einsum("kd,kd->k", queries[active[r]], vectors[reached[r, c]])
        merged = _best(
            np.hstack([nodes[active], reached]),
            np.hstack([scores[active], new]),
            np.hstack([own, reached >= 0]),
            width,
        )
        nodes[active], scores[active], open_[active] = merged
    return nodes, scores


def _scores(vectors, queries, nodes):
    found = np.einsum("bd,bkd->bk", queries, vectors[np.maximum(nodes, 0)])
    return np.where(nodes >= 0, found, -np.inf).astype(np.float32)


def _best(nodes, scores, open_, width):
    order = np.argsort(-scores, axis=1, kind="stable")[:, :width]
    take = lambda x: np.take_along_axis(x, order, 1)
    return take(nodes), take(scores), take(open_)


def _without_repeats(nodes):
    """Keeps one of equal entries of a row; the others become -1."""
    out = np.sort(nodes, axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return out


def choose(vectors, nodes, scores, links):
    """Up to ``links`` of each row's candidates (best first): those nearer to the row than to any
    taken before, then the best of the others."""
    own = vectors[np.maximum(nodes, 0)]
    between = np.einsum("bkd,bjd->bkj", own, own)
    taken = np.zeros(nodes.shape, bool)
    closest = np.full(nodes.shape, -np.inf, np.float32)
    for k in range(nodes.shape[1]):
        fits = (nodes[:, k] >= 0) & (scores[:, k] > closest[:, k]) & (taken.sum(axis=1) < links)
        taken[:, k] = fits
        closest[fits] = np.maximum(closest[fits], between[fits, k])
    order = np.argsort(np.where(nodes >= 0, ~taken, 2), axis=1, kind="stable")[:, :links]
    out = np.take_along_axis(nodes, order, 1)
    return np.pad(out, ((0, 0), (0, links - out.shape[1])), constant_values=-1)


def _link_back(vectors, links, counts, sources, targets):
    """Adds each source to the list of its target; a list that overflows is chosen anew."""
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    first = np.flatnonzero(np.concatenate([[True], targets[1:] != targets[:-1]]))
    nodes = targets[first]
    extra = np.diff(np.concatenate([first, [len(targets)]]))
    room = links.shape[1]
    fits = counts[nodes] + extra <= room
    place = np.arange(len(targets)) - np.repeat(first, extra)
    simple = np.repeat(fits, extra)
    links[targets[simple], counts[targets[simple]] + place[simple]] = sources[simple]
    counts[nodes[fits]] += extra[fits]
    full = np.flatnonzero(~fits)
    for part in np.array_split(full, max(1, len(full) // 512)):
        if not len(part):
            continue
        own = nodes[part]
        most = int(extra[part].max())
        wide = np.full((len(part), most), -1, links.dtype)
        for row, k in enumerate(part.tolist()):
            wide[row, : extra[k]] = sources[first[k] : first[k] + extra[k]]
        candidates = np.hstack([links[own], wide])
        scores = _scores(vectors, vectors[own], candidates)
        # as many candidates as the choice needs at most
        candidates, scores, _ = _best(candidates, scores, candidates >= 0, 2 * room)
        kept = choose(vectors, candidates, scores, room * 2 // 3)
        links[own] = -1
        links[own[:, None], np.arange(kept.shape[1])] = kept
        counts[own] = (kept >= 0).sum(axis=1)


def build(vectors, heights, links=LINKS, width=BUILD_WIDTH):
    """Levels, top first; ``heights`` is the highest level of each vector."""
    levels = []
    for level in range(int(heights.max()), -1, -1):
        # nodes of the level above come first: searches enter through them
        nodes = np.flatnonzero(heights >= level)
        nodes = nodes[np.argsort(-heights[nodes], kind="stable")]
        own = vectors[nodes]
        above = levels[-1] if levels else None
        room = links * 3 // 2
        table = np.full((len(nodes), room), -1, np.int32)
        counts = np.zeros(len(nodes), np.int64)
        done, size = 0, 64
        while done < len(nodes):
            new = np.arange(done, min(done + size, len(nodes)))
            near = own[new] @ own[new].T
            near[np.arange(len(new)), np.arange(len(new))] = -np.inf
            beside = np.argsort(-near, axis=1)[:, : min(links, len(new) - 1)]
            candidates = new[beside]
            if done:
                if above is not None and new[0] >= len(above.nodes):
                    entries = descend(vectors, levels, own[new], 8)
                else:
                    entries = np.tile(np.arange(min(8, done)), (len(new), 1))
                found, _ = search_level(own[:done], table[:done], own[new], entries, width)
                candidates = np.hstack([found, candidates])
            scores = _scores(own, own[new], candidates)
            candidates, scores, _ = _best(candidates, scores, candidates >= 0, width)
            kept = choose(own, candidates, scores, links)
            table[new, : kept.shape[1]] = kept
            counts[new] = (kept >= 0).sum(axis=1)
            r, c = np.nonzero(kept >= 0)
            back = kept[r, c] < done  # within the batch both ends choose for themselves
            if back.any():
                _link_back(own, table, counts, new[r[back]].astype(np.int32), kept[r, c][back])
            done += len(new)
            size = min(2 * size, TOGETHER)
        levels.append(Level(nodes, table))
    return levels


def descend(vectors, levels, queries, width):
    """The best nodes of the last of ``levels`` for each query, as positions on that level.

    A level lists the nodes of the level above first and in the same order, so positions on the
    level above hold on the next one, too.
    """
    entries = np.zeros((len(queries), 1), np.int64)
    for level in levels:
        found, _ = search_level(vectors[level.nodes], level.links, queries, entries, width)
        entries = found[:, :width]
    return entries


def heights(ids):
    """The highest level of each vector: drawn from its id, a 16th of a level also on the next."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    uniform = ((x >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
    return np.floor(-np.log(uniform) / math.log(16)).astype(np.int64)


# ---- the shards ----------------------------------------------------------------------------------

INDEX_SCHEMA = "shard long, n int, ids binary, vectors binary, levels array<struct<nodes: binary, links: binary>>"


def usable(vectors, id_col="vec_id", vector_col="embedding"):
    """``id, vector`` (array of double) of the vectors that take part, each with its squared length.

    Null, zero or non-finite vectors, vectors with null components and rows without id take no
    part, nor do vectors of another length than most (of several such lengths, the longest).
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).where("id is not null and vector is not null")
    rows = rows.where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return rows.where(F.size("vector") == d).withColumn("square", square)


def _extended(vectors, longest):
    square = (vectors**2).sum(axis=1)
    more = np.sqrt(np.maximum(longest - square, 0.0))
    return np.hstack([vectors, more[:, None]]).astype(np.float32)


def index(rows, longest, shards):
    """One row per shard: ids, original vectors and the levels' flat arrays."""

    def built(table):
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        ids = table["id"].to_numpy()[order]
        vectors = _matrix(table["vector"])[order]
        levels = build(_extended(vectors, longest), heights(ids))
        return pa.table(
            {
                "shard": pa.array([table["shard"][0].as_py()], pa.int64()),
                "n": pa.array([len(ids)], pa.int32()),
                "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                "vectors": pa.array([vectors.astype("<f8").tobytes()], pa.binary()),
                "levels": pa.array(
                    [[{"nodes": v.nodes.astype("<i4").tobytes(), "links": v.links.astype("<i4").tobytes()} for v in levels]],
                    pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary())])),
                ),
            }
        )

    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")
    # a range of shards each, so that building is not coalesced into few tasks
    dealt = rows.select("id", "vector", shard).repartitionByRange(shards, "shard")
    return dealt.groupBy("shard").applyInArrow(built, INDEX_SCHEMA)


def _matrix(column):
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


RESULT_SCHEMA = "query_id long, vec_id long, score double"


def _searched(graphs, asked, longest, k, width):
    """The ``k`` nearest of one shard for a block of queries."""
    names = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
    if not graphs.num_rows or not asked.num_rows:
        return pa.table({c: pa.array([], t) for c, t in zip(names, (pa.int64(), pa.int64(), pa.float64()))})
    g = graphs.slice(0, 1).to_pylist()[0]
    ids = np.frombuffer(g["ids"], "<i8")
    vectors = np.frombuffer(g["vectors"], "<f8").reshape(g["n"], -1)
    extended = _extended(vectors, longest)
    levels = []
    for level in g["levels"]:
        nodes = np.frombuffer(level["nodes"], "<i4")
        levels.append(Level(nodes, np.frombuffer(level["links"], "<i4").reshape(len(nodes), -1)))
    low = levels[-1]
    ground = extended[low.nodes]
    query_ids, queries = asked["id"].to_numpy(), _matrix(asked["vector"])
    out = []
    for part in np.array_split(np.arange(len(queries)), -(-len(queries) // TOGETHER)):
        asked_for = np.hstack([queries[part], np.zeros((len(part), 1))]).astype(np.float32)
        entries = descend(extended, levels[:-1], asked_for, 8)
        found, _ = search_level(ground, low.links, asked_for, entries, width)
        r, c = np.nonzero(found >= 0)
        at = low.nodes[found[r, c]]
        score = np.einsum("kd,kd->k", queries[part][r], vectors[at])
        order = np.lexsort((ids[at], -score, r))
        r, at, score = r[order], at[order], score[order]
        first = np.searchsorted(r, r, "left")
        keep = np.arange(len(r)) - first < k
        out.append((query_ids[part][r[keep]], ids[at[keep]], score[keep]))
    return pa.table({c: pa.array(np.concatenate([x[j] for x in out])) for j, c in enumerate(names)})


def folded(rows, k):
    """Each different vector once, under its smallest id, and the ids of those that have several.

    ``nodes``: ``id, vector, square``; ``same``: ``node`` and its ``k + 1`` smallest ids. An answer has ``k`` rows
    and never the query's own, so further ids of a vector cannot be in one.
    """
    coded = rows.withColumns({"a": F.xxhash64("vector"), "b": F.xxhash64("vector", F.lit(1))})
    nodes = coded.groupBy("a", "b").agg(
        F.min_by(F.struct("id", "vector", "square"), "id").alias("row"), F.count("*").alias("n")
    )
    nodes = write_through(nodes.select("row.*", "a", "b", "n"), "nodes")
    several = nodes.where("n > 1").select("a", "b", F.col("id").alias("node"))
    # tasks send the first ids of a vector only
    order = Window.partitionBy("a", "b").orderBy("id")
    first = coded.select("a", "b", "id").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k + 1)
    same = first.join(several, ["a", "b"]).groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return nodes.select("id", "vector", "square"), write_through(same, "same")


def nearest(vectors, is_query, id_col="vec_id", vector_col="embedding", k=NEAREST, width=SEARCH_WIDTH):
    """Each query's ``k`` nearest found: ``query_id, rank, vec_id, score``; ties to smaller ids.

    ``is_query`` is a condition on the column ``id``. A query does not find rows with its own
    id; equal vectors under other ids count, and the smallest of their ids come first. Of rows that repeat
    an id the one with the smallest vector counts. With fewer candidates than ``k`` all are returned.
    """
    ship(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col).groupBy("id").agg(F.min(F.struct("vector", "square")).alias("row"))
    rows = write_through(rows.select("id", "row.*"), "vectors")
    nodes, same = folded(rows, k)
    n, longest = nodes.agg(F.count("*"), F.max("square")).first()
    longest = longest or 0.0
    shards = max(1, round(n / SHARD))
    graphs = write_through(index(nodes, longest, shards), "index")
    asked = rows.where(is_query).select("id", "vector")
    blocks = max(1, -(-asked.count() // QUERIES))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("block")
    asked = asked.select("id", "vector", block).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    )
    graphs = graphs.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    )
    # the query's own vector is among them
    found = (
        graphs.groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInArrow(lambda left, right: _searched(left, right, longest, k + 1, width), RESULT_SCHEMA)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k + 1)
    every = found.join(same, F.col("vec_id") == F.col("node"), "left").select(
        "query_id", "score", F.explode(F.coalesce("ids", F.array("vec_id"))).alias("vec_id")
    )
    ranked = every.where("vec_id <> query_id").withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
