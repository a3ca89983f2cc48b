"""Near-duplicate headlines: token-set similarity, leader clustering, similar coverage.

The similarity of two headlines depends on their word sets only. Equal word sets collapse
first, to one node ranked by its earliest row, so copies are never paired with each other.
"""

import math
from functools import reduce

from pyspark.sql import functions as F

from newsloom.functions.once import computed_once
from newsloom.functions.text import title_key
from newsloom.functions.tiles import ALIGNED, aligned_in_tile
from newsloom.functions.titles import joined_length, token_set
from newsloom.operators.skew import attach
from newsloom.schemas import SIMILARITY_THRESHOLD
from newsloom.workspace import write_through

# Rows of one side of a comparison tile, and its characters.
_TILE_LEAST, _TILE_MOST, _TILE_TEXT = 2048, 8192, 1 << 22
# Word sets whose leaders are found first; each further batch is as large as all before.
FIRST_BATCH = 1 << 14


def _cutoff(threshold):
    # scores are rounded to whole numbers before they are compared
    return threshold - 0.5


def _band_width(cutoff):
    # bands of lengths so wide that similar titles are at most one band apart
    return -math.log(cutoff / (200 - cutoff) - 1e-6)


def title_nodes(rows, threshold=SIMILARITY_THRESHOLD):
    """Distinct word sets with the features that bound their similarity.

    ``node`` is the earliest seq, ``n`` the number of rows. Titles without a word are similar
    to nothing, not even each other, and have no node.
    """
    return nodes_of(keyed_titles(rows), threshold)


def keyed_titles(rows):
    """Distinct titles with the key of their words: ``title, key, seq, n``, the earliest row and how many. Each is taken apart once."""
    titles = rows.groupBy("title").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    return computed_once(titles, key=word_set_key(F.col("title")))


def nodes_of(titles, threshold=SIMILARITY_THRESHOLD):
    """``title_nodes`` of keyed titles."""
    nodes = titles.where(F.col("key") != "").groupBy("key").agg(
        F.min("seq").alias("node"), F.sum("n").alias("n")
    )
    return with_features(nodes, threshold)


def word_set_key(title):
    """The distinct words of a title in order, as one text; empty where there is none."""
    return F.array_join(token_set(title), " ")


def with_features(nodes, threshold=SIMILARITY_THRESHOLD):
    """``key, node, n`` with the features that bound the similarity of word sets."""
    width = _band_width(_cutoff(threshold))
    measured = nodes.selectExpr("node", "n", "key", "split(key, ' ') as tokens", "length(key) as len")
    return measured.withColumn("band", F.expr(f"int(floor(ln(len) / {width}D))"))


def _listed(nodes):
    return nodes.select("node", F.explode("tokens").alias("token"))


def _frequencies(*sides):
    """How often each word occurs in the word sets of all sides."""
    every = reduce(lambda a, b: a.union(b), map(_listed, sides))
    return every.groupBy("token").agg(F.count("*").alias("df"))


def _contained_pairs(inner, outer, frequency, words, cutoff):
    """Pairs where most of the text of a title in ``inner`` is made of words of one in ``outer``.

    For titles with common words S, a score of ``cutoff`` or more from S against one title A
    means ``|S| >= share * |A|``. The words of A are ordered rarest first and cut where the
    remaining ones are too short for that, so S must hold one of the leading words. Leading
    words meet all words on equality, and the first common one emits the pair.
    """
    share = cutoff / (200 - cutoff)
    ranked = attach(_listed(inner), frequency, "token", "df", words, "node", "merge")
    order = (
        ranked.groupBy(F.col("node").alias("a"))
        .agg(F.expr("sort_array(collect_list(struct(df, -length(token) as neg, token)))").alias("order"))
        .selectExpr("a", "order", "order.token as ta", "aggregate(order, -1, (s, t) -> s + 1 - t.neg) as la")
        .selectExpr("a", "ta", "la", f"""transform(filter(order, (_, k) ->
            aggregate(slice(order, k + 1, size(order)), -1, (s, t) -> s + 1 - t.neg) >= {share}D * la - 1e-9D
            ), t -> t.token) as lead""")
        .selectExpr("a", "ta", "la", "lead", "explode(lead) as token")
    )
    others = outer.selectExpr("node as b", "tokens as tb", "explode(tokens) as token")
    # Spark takes a table as small as before its rows are exploded, and would broadcast it
    met = order.hint("merge").join(others, "token").where(
        "a <> b and token = try_element_at(array_intersect(lead, tb), 1)"
    )
    scored = met.withColumn("shared", joined_length(F.array_intersect("ta", "tb")))
    return scored.selectExpr(
        "least(a, b) as i",
        "greatest(a, b) as j",
        "if(shared = la, 100D, 200D * shared / (shared + la)) as score",
    ).where(F.col("score") >= cutoff)


def _blocks(nodes, counts, rows, width):
    """A row per block of ``nodes`` with all of it, blocks per band, and the SQL of those.

    A block has about ``rows`` titles of a band, or fewer where they are long.
    """
    most = lambda band: max(1, min(rows, int(_TILE_TEXT / math.exp(min(30, (band + 1) * width)))))
    blocks = {band: -(-n // most(band)) for band, n in counts.items()}
    listed = f"map({', '.join(f'{band}, {n}' for band, n in blocks.items())})"
    # a block is few bytes but is sent to many tiles, so blocks must not be coalesced by size
    dealt = nodes.select(
        "node", "key", "band", F.expr(f"cast(pmod(xxhash64(node), {listed}[band]) as int)").alias("block")
    ).repartition(_parts(nodes, sum(blocks.values())), "band", "block")
    packed = dealt.groupBy("band", "block").agg(F.collect_list(F.struct("node", "key")).alias("titles"))
    return packed, blocks, listed


def _parts(df, most, times=1):
    return max(1, min(most, times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _span(start, stop, tile):
    stop = f"coalesce({stop}, 0)"
    return f"transform(if({start} < {stop}, sequence({start}, {stop} - 1), array()), x -> {tile})"


_TILE = "named_struct('ba', {}, 'xa', {}, 'bb', {}, 'xb', {})".format


def _in_tiles(packed, tiles):
    return packed.selectExpr("titles", f"inline(concat({', '.join(tiles)}))")


def _tiles(nodes, counts, rows, width):
    """Both sides of the comparison tiles of one table, and how many tiles there are.

    Only titles in the same or in neighbouring length bands can be similar. A band is cut into
    blocks, and each pair of blocks is a tile of bounded size, however full the band is.
    """
    packed, blocks, listed = _blocks(nodes, counts, rows, width)
    left = [
        _span("block", f"{listed}[band]", _TILE("band", "block", "band", "x")),
        _span("0", f"{listed}[band + 1]", _TILE("band", "block", "band + 1", "x")),
    ]
    right = [
        _span("0", "block + 1", _TILE("band", "x", "band", "block")),
        _span("0", f"{listed}[band - 1]", _TILE("band - 1", "x", "band", "block")),
    ]
    tiles = sum(n * (n + 1) // 2 + n * blocks.get(band + 1, 0) for band, n in blocks.items())
    return _in_tiles(packed, left), _in_tiles(packed, right), tiles


def _cross_tiles(one, other, ones, others, rows, width):
    """Both sides of the tiles that compare two tables, and how many tiles there are."""
    left, xs, of_left = _blocks(one, ones, rows, width)
    right, ys, of_right = _blocks(other, others, rows, width)
    near = [-1, 0, 1]
    lefts = [_span("0", f"{of_right}[band + {d}]", _TILE("band", "block", f"band + {d}", "x")) for d in near]
    rights = [_span("0", f"{of_left}[band - {d}]", _TILE(f"band - {d}", "x", "band", "block")) for d in near]
    tiles = sum(n * ys.get(band + d, 0) for band, n in xs.items() for d in near)
    return _in_tiles(left, lefts), _in_tiles(right, rights), tiles


def _aligned_pairs(left, right, tiles, cutoff, one_table=False):
    """Pairs whose full texts align: common words first, then the other words of each.

    A tile is a row with both blocks and is compared as arrays. With ``one_table`` a block that meets
    itself is not compared twice.
    """
    # tiles are few bytes but much work, so their partitions must not be coalesced by size, and hold few tiles each
    count = _parts(left, tiles, times=4)
    tile = ["ba", "xa", "bb", "xb"]
    # a side of the tiles is many times its table, and is not to be broadcast
    met = left.repartition(count, *tile).withColumnRenamed("titles", "a").hint("merge").join(
        right.repartition(count, *tile).withColumnRenamed("titles", "b"), tile
    )
    # one tile is sent at a time
    found = met.groupBy(*tile).applyInArrow(aligned_in_tile(cutoff, one_table), ALIGNED)
    return found.selectExpr("least(x, y) as i", "greatest(x, y) as j", "200D * matched / total as score").where(
        F.col("score") >= cutoff
    )


def _tile_rows(rows):
    return min(_TILE_MOST, max(_TILE_LEAST, rows // 16))


def _bands(nodes):
    """Word sets per length band, and words of all."""
    # lengths below 2^31 make fewer than 60 bands
    bands = nodes.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("w")).collect()
    return {b.band: b.n for b in bands}, sum(b.w for b in bands)


def _best(pairs):
    return pairs.groupBy("i", "j").agg(F.max("score").alias("score"))


def node_pairs(nodes, threshold=SIMILARITY_THRESHOLD):
    """Every pair of written nodes with a rounded score of ``threshold`` or more: ``i < j, score``.

    No pair is dropped: the score is the best of three, and each join covers its own kind.
    """
    counts, words = _bands(nodes)
    cutoff = _cutoff(threshold)
    pairs = _contained_pairs(nodes, nodes, _frequencies(nodes), words, cutoff)
    if counts:
        tiles = _tiles(nodes, counts, _tile_rows(sum(counts.values())), _band_width(cutoff))
        pairs = pairs.union(_aligned_pairs(*tiles, cutoff, one_table=True))
    return _best(pairs)


def cross_pairs(one, other, threshold=SIMILARITY_THRESHOLD):
    """Every pair of a written node of ``one`` with a written node of ``other``, as in ``node_pairs``.

    No node is in both. Nodes of the same table are not compared.
    """
    (ones, words), (others, more) = _bands(one), _bands(other)
    cutoff, frequency = _cutoff(threshold), _frequencies(one, other)
    pairs = _contained_pairs(one, other, frequency, words + more, cutoff).union(
        _contained_pairs(other, one, frequency, words + more, cutoff)
    )
    if ones and others:
        rows = _tile_rows(max(sum(ones.values()), sum(others.values())))
        tiles = _cross_tiles(one, other, ones, others, rows, _band_width(cutoff))
        pairs = pairs.union(_aligned_pairs(*tiles, cutoff))
    return _best(pairs)


def leaders(pairs, max_rounds=None):
    """The leader of every node that is not its own: ``node, leader``.

    Going through the nodes in order, each undecided one becomes a leader and takes all
    undecided neighbours. That is the lexicographically first maximal independent set, which
    rounds find in parallel: an undecided node without a smaller undecided neighbour leads,
    its neighbours are members, and edges of decided nodes drop out.
    """
    edges = write_through(pairs.select("i", "j"), "edges")
    left, taken, rounds = edges, [], 0
    # what grows with the edges is joined by merging, so that no round sends a table through the driver
    while not left.isEmpty():
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"clustering is not done after {max_rounds} rounds")
        follows = left.select(F.col("j").alias("i")).distinct().withColumn("follows", F.lit(True))
        seen = left.join(follows.hint("merge"), "i", "left")
        # a node with a leading neighbour is a member
        members = seen.where("follows is null").select(F.col("j").alias("node")).distinct()
        of = lambda end: members.select(F.col("node").alias(end), F.lit(True).alias(f"{end}_in"))
        marked = write_through(
            left.join(of("j").hint("merge"), "j", "left").join(of("i").hint("merge"), "i", "left"), "round"
        )
        taken.append(marked.where("j_in").select(F.col("j").alias("i")))
        left = marked.where("j_in is null and i_in is null").select("i", "j")
        rounds += 1
    # a smaller neighbour that is no member leads
    by_leader = edges
    if taken:
        by_leader = edges.join(reduce(lambda a, b: a.union(b), taken).hint("merge"), "i", "left_anti")
    return by_leader.groupBy(F.col("j").alias("node")).agg(F.min("i").alias("leader"))


def follow(nodes, leading=None, threshold=SIMILARITY_THRESHOLD):
    """The leader of every written node, its own included: ``node, leader``.

    ``leading`` are written nodes that lead already, all of them earlier. A node follows the first
    leader it is similar to; only nodes that meet none are compared with each other. So a story of
    many word sets costs one comparison of each set with its leader, not one of each pair of sets.
    """
    rest, met = nodes, None
    if leading is not None:
        pairs = cross_pairs(leading, nodes, threshold)
        met = write_through(pairs.groupBy(F.col("j").alias("node")).agg(F.min("i").alias("leader")), "met")
        rest = write_through(nodes.join(met.hint("merge"), "node", "left_anti"), "rest")
    led = leaders(node_pairs(rest, threshold))
    found = rest.select("node").join(led.hint("merge"), "node", "left").select("node", F.coalesce("leader", "node").alias("leader"))
    return found if met is None else found.unionByName(met)


def follow_in_order(nodes, leading=None, threshold=SIMILARITY_THRESHOLD):
    """``follow`` for any number of written nodes: each batch is about as large as all before it.

    The sequential rule asks only for the leaders before a node, so batches give the same result.
    """
    count = nodes.count()
    # leaders are fewer than the word sets they came from
    ends, size = [], max(FIRST_BATCH, leading.count() if leading is not None else 0)
    while size < count:
        ends.append(size / count)
        size *= 2
    # where exactly a batch ends changes nothing
    bounds = sorted(set(nodes.approxQuantile("node", ends, 0.001))) if ends else []
    found, low = None, None
    for high in [*map(int, bounds), None]:
        batch = nodes
        if low is not None:
            batch = batch.where(F.col("node") > low)
        if high is not None:
            batch = batch.where(F.col("node") <= high)
        led = follow(batch, leading, threshold)
        if high is not None:
            led = write_through(led, "led")
            leads = batch.join(led.where("node = leader").select("node").hint("merge"), "node", "left_semi")
            more = write_through(leads.select(*nodes.columns), "leading")
            leading = more if leading is None else leading.select(*nodes.columns).union(more)
        found = led if found is None else found.union(led)
        low = high
    return found


def fuzzy_clusters(titles, threshold=SIMILARITY_THRESHOLD):
    """``key, leader, size``: cluster of each word set of keyed titles. Titles without a word have none."""
    nodes = write_through(nodes_of(titles, threshold), "nodes")
    led = follow_in_order(nodes, threshold=threshold)
    return with_sizes(nodes.hint("merge").join(led, "node").select("key", "n", "leader"))


def with_sizes(sets):
    """``key, n, leader`` of each word set with ``size``, the rows of its cluster."""
    placed = write_through(sets.select("key", "n", F.col("leader").cast("string").alias("_leader")), "placed")
    # a big story has many word sets
    sizes = placed.groupBy("_leader").agg(F.sum("n").alias("size"), F.count("*").alias("sets"))
    sets = placed.count()
    found = attach(placed, sizes, "_leader", "sets", sets, "key", "merge")
    return found.select("key", "n", F.col("_leader").cast("bigint").alias("leader"), "size")


def exact_clusters(rows):
    """``key, leader, size``: rows whose titles are equal up to case and punctuation."""
    keyed = computed_once(rows.select("seq", "title"), key=title_key(F.col("title")))
    return keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("seq").alias("leader"), F.count("*").alias("size")
    )


METHODS = ("fuzzy", "exact")


def _checked(method):
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}, not {method!r}")
    return method


def similar_coverage(rows, threshold=SIMILARITY_THRESHOLD, method="fuzzy"):
    """Add ``leader`` and ``similar``, the number of other rows in the same cluster.

    ``method`` is the caller's choice and never depends on the number of rows: ``fuzzy``
    compares titles, ``exact`` takes rows as alike when their normalised titles are equal,
    which is one aggregation and a join back on the key.
    """
    if _checked(method) == "exact":
        return covered_by(rows, title_key(F.col("title")), exact_clusters(rows))
    titles = write_through(keyed_titles(rows), "titles")
    return covered_by_titles(rows, titles, fuzzy_clusters(titles, threshold))


def covered_by(rows, key, clusters):
    """``rows`` with ``leader`` and ``similar`` from the clusters ``key, n, leader, size`` of their ``key``."""
    shared, total = _shared(clusters)
    return _covered(rows, attach(computed_once(rows, _key=key), shared, "_key", "n", total, "seq", "merge"))


def covered_by_titles(rows, titles, clusters):
    """The same from ``titles``, the keyed titles of ``rows``: a title of many rows is found in the clusters once."""
    shared, total = _shared(clusters)
    keyed = titles.select("title", F.col("key").alias("_key"), F.col("n").alias("_rows"))
    found = attach(keyed, shared, "_key", "n", total, "title", "merge").where("size is not null")
    found = write_through(found.select("title", "_rows", "leader", "size"), "found")
    held = found.agg(F.sum("_rows")).first()[0] or 0
    return _covered(rows, attach(rows, found, "title", "_rows", held, "seq", "merge"))


def _shared(clusters):
    """The clusters that need a lookup, of more than one row, and the rows of all."""
    shared = clusters.where(F.col("size") > 1).withColumnRenamed("key", "_key")
    shared = write_through(shared, "clusters")
    return shared, shared.agg(F.sum("n")).first()[0] or 0


def _covered(rows, found):
    return found.withColumns({
        "leader": F.coalesce("leader", "seq"),
        "similar": F.coalesce(F.col("size") - 1, F.lit(0)).cast("int"),
    }).select(*rows.columns, "leader", "similar")


def similar_groups(rows, threshold=SIMILARITY_THRESHOLD, method="fuzzy"):
    """The similarity of titles by classes: ``(titles, links)``.

    ``titles`` has a row per distinct title, by its earliest row: ``seq, class, class_size``. All titles
    of a class are similar with a score of 100; it is named by its earliest title. ``links`` has the pairs
    of similar classes, ``i < j`` and ``score``, which is that of all their titles. So a class of k
    titles takes k rows, not k * k. ``exact`` classes have no links; a ``fuzzy`` title without a word no class.
    """
    exact = _checked(method) == "exact"
    key = title_key(F.col("title")) if exact else word_set_key(F.col("title"))
    titles = rows.groupBy("title").agg(F.min("seq").alias("seq"))
    titles = computed_once(titles, key=key)
    titles = write_through(titles if exact else titles.where(F.col("key") != ""), "titles")
    classes = titles.groupBy("key").agg(F.min("seq").alias("class"), F.count("*").alias("class_size"))
    members = attach(titles, classes, "key", "class_size", titles.count(), "seq")
    links = None if exact else node_pairs(write_through(title_nodes(rows, threshold), "nodes"), threshold)
    if exact:
        links = rows.sparkSession.createDataFrame([], "i long, j long, score double")
    return write_through(members.select("seq", "class", "class_size"), "members"), links


def expanded(titles, links):
    """All pairs of similar titles from their classes: ``i < j, score``."""
    one, other = titles.select("class", F.col("seq").alias("i")), titles.select("class", F.col("seq").alias("j"))
    alike = one.join(other, "class").where("i < j").select("i", "j", F.lit(100.0).alias("score"))
    named = titles.select("class", "seq")
    near = links.toDF("a", "b", "score").join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b")
    return alike.unionByName(
        near.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "score")
    )


def similar_pairs(rows, threshold=SIMILARITY_THRESHOLD, method="fuzzy"):
    """All pairs ``i < j`` of similar distinct titles, by their earliest rows, with their score.

    ``fuzzy`` pairs score ``threshold`` or more; ``exact`` pairs have equal normalised titles
    and score 100. Titles are compared by word set; here each set's titles are put in again, so
    there are as many rows as pairs: ``similar_groups`` says the same in fewer.
    """
    return expanded(*similar_groups(rows, threshold, method))
