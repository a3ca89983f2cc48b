"""How filters overlap, whatever the order they are applied in (operator 11).

For each part, filter and range of ids there is a sorted list of the documents that fail. Merging some
of these lists gives the number of documents that fail any of those filters; sums of these sizes over
the ranges are all that is needed: what a filter removes after others is a difference of two unions.

A merge never looks at single documents where it can gallop: from the smallest head it jumps, with
doubling steps, to the place where the next list's head would stand, and counts what it passed.

Rows without an id are documents, too, but no text counts as repeated because of them. A null text is
an empty one, a null part the empty string, a missing label neither good nor toxic; of repeated labels
the larger one holds. Rows that repeat an id are documents of their own. Empty tables give no rows.
"""

import hashlib
import re
from bisect import bisect_left
from itertools import permutations

import pyarrow as pa
from pyspark.sql import functions as F

from newsloom.llm.shipping import ship
from newsloom.operators.skew import attach
from newsloom.workspace import write_through

FILTERS = "ABCDE"
#: Documents of a range of ids at most.
RANGE = 1 << 16

# ---- fixed values: the conditions under which a text fails -------------------
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 3
MARKS = re.compile(rb"[#$%&*|]")
# ------------------------------------------------------------------------------
_CAPITALS = bytes(range(65, 91))


def fails(raw, n_chars):
    """Which of the filters A to D a text of ``n_chars`` characters fails; ``raw`` is its UTF-8."""
    words = raw.split()  # at the six ASCII blanks
    return (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words),
        100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > MOST_CAPITALS_PERCENT * n_chars,
        MARKS.search(raw) is not None,
    )


def _judged(docs):
    """``doc_id, part, A, B, C, D, digest`` from one pass over the texts."""

    def judge(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            raws = [t.encode("utf-8", "surrogatepass") for t in texts]
            found = [fails(raw, len(text)) for raw, text in zip(raws, texts)]
            columns = [pa.array([f[k] for f in found], pa.bool_()) for k in range(4)]
            digests = pa.array([hashlib.sha256(raw).hexdigest() for raw in raws], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["part"], *columns, digests],
                names=["doc_id", "part", *FILTERS[:4], "digest"],
            )

    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    flags = ", ".join(f"{f} boolean" for f in FILTERS[:4])
    return read.mapInArrow(judge, f"doc_id long, part string, {flags}, digest string")


def failures(docs, labels):
    """One row per document: ``doc_id, part``, a boolean for each filter, ``good`` and ``toxic``."""
    ship(docs.sparkSession)
    judged = write_through(_judged(docs), "judged")
    # the first document of each text that occurs again
    copies = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    rows = attach(judged, copies.where("n > 1"), "digest", "n", judged.count(), "doc_id")
    repeated = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1)).alias("good"), F.max((F.col("toxic") == 1)).alias("toxic")
    )
    no = F.lit(False)
    return rows.select("doc_id", "part", *FILTERS[:4], repeated.alias("E")).join(marked, "doc_id", "left").select(
        "doc_id", "part", *FILTERS, F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")
    )


def postings(found, filters=FILTERS):
    """The posting lists of ``failures``, one row per part and range of ids.

    ``ids`` has the range's documents in order; ``lists[k]`` the positions therein of those that fail
    filter k, and the last two lists those of the good and the toxic ones.
    """
    lists = [*filters, "good", "toxic"]

    def closed(part, ids, held):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.string()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([held], pa.list_(pa.list_(pa.int32()))),
            ],
            names=["part", "ids", "lists"],
        )

    def gather(batches):
        part, ids, held = None, [], []
        for batch in batches:
            flags = [batch[name].to_pylist() for name in lists]
            for row, (doc_id, of) in enumerate(zip(batch["doc_id"].to_pylist(), batch["part"].to_pylist())):
                if of != part or len(ids) == RANGE:
                    if ids:
                        yield closed(part, ids, held)
                    part, ids, held = of, [], [[] for _ in lists]
                for k, flag in enumerate(flags):
                    if flag[row]:
                        held[k].append(len(ids))
                ids.append(doc_id)
        if ids:
            yield closed(part, ids, held)

    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = found.repartitionByRange(tasks, "part", "doc_id").sortWithinPartitions("part", "doc_id")
    chunks = in_order.mapInArrow(gather, "part string, ids array<long>, lists array<array<int>>")
    return write_through(chunks, "postings")


def gallop(items, value, start):
    """The first place from ``start`` on whose item is not below ``value``."""
    step, low, high = 1, start, start
    while high < len(items) and items[high] < value:
        low, high, step = high + 1, high + step, 2 * step
    return bisect_left(items, value, low, min(high, len(items)))


def union_size(lists):
    """How many different items the sorted lists hold; no list repeats one."""
    heads = sorted([items[0], 0, items] for items in lists if items)
    size = 0
    while len(heads) > 1:
        value, at, items = heads[0]
        if value == heads[1][0]:
            # counted with the list that has it next
            passed = at + 1
        else:
            passed = gallop(items, heads[1][0], at)
            size += passed - at
        if passed == len(items):
            del heads[0]
            continue
        # put the list back in the order of the heads
        moved, k = [items[passed], passed, items], 1
        while k < len(heads) and heads[k][0] < moved[0]:
            heads[k - 1] = heads[k]
            k += 1
        heads[k - 1] = moved
    return size + sum(len(items) - at for _, at, items in heads)


def common(one, other):
    """The items of both sorted lists."""
    found, a, b = [], 0, 0
    while a < len(one) and b < len(other):
        if one[a] == other[b]:
            found.append(one[a])
            a, b = a + 1, b + 1
        elif one[a] < other[b]:
            a = gallop(one, other[b], a)
        else:
            b = gallop(other, one[a], b)
    return found


def union_sizes(chunks, n_filters):
    """``part, any_of, docs, n, good, toxic`` for each range and set of filters.

    ``any_of`` has a bit for each filter; ``n`` documents fail one of them at least.
    """

    def merge(batches):
        for batch in batches:
            for part, ids, lists in zip(*(batch[c].to_pylist() for c in ("part", "ids", "lists"))):
                failing, (good, toxic) = lists[:n_filters], lists[n_filters:]
                kinds = [failing, [common(f, good) for f in failing], [common(f, toxic) for f in failing]]
                sets = range(1 << n_filters)
                sizes = [
                    [union_size([f for k, f in enumerate(kind) if s >> k & 1]) for s in sets] for kind in kinds
                ]
                columns = [
                    pa.array([part] * len(sets), pa.string()),
                    pa.array(sets, pa.int32()),
                    pa.array([len(ids)] * len(sets), pa.int64()),
                    *(pa.array(s, pa.int64()) for s in sizes),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "any_of", "docs", "n", "good", "toxic"])

    return chunks.mapInArrow(merge, "part string, any_of int, docs long, n long, good long, toxic long")


def interactions(chunks, filters=FILTERS):
    """One row per part, order of all filters and step.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``:
    documents left after the step, removed by it, failing its filter but removed before, failing no
    other filter; good and toxic ones removed; and what the filter removes summed over all orders.
    """
    k = len(filters)
    everything = (1 << k) - 1
    orders = ["".join(o) for o in permutations(filters)]
    sizes = union_sizes(chunks, k).groupBy("part", "any_of").agg(
        *(F.sum(c).alias(c) for c in ("docs", "n", "good", "toxic"))
    )
    # 2 ** k sums per part
    parts = sizes.groupBy("part").agg(
        F.max("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("any_of", "n", "good", "toxic"))).alias("u")
    )
    steps = (
        parts.select("*", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
        .withColumn("bit", F.expr(f"shiftleft(1, instr('{filters}', substring(filter_order, step, 1)) - 1)"))
        .withColumn("before", F.expr(f"""aggregate(sequence(1, {k}), 0, (m, x) -> if(x < step,
            m | shiftleft(1, instr('{filters}', substring(filter_order, x, 1)) - 1), m))"""))
        .withColumn("after", F.expr("before | bit"))
    )
    # the orders in which exactly the filters of a set come before this one
    times = "element_at(array({}), 1 + bit_count(s))".format(
        ", ".join(str(_factorial(m) * _factorial(k - 1 - m)) for m in range(k))
    )
    return steps.selectExpr(
        "part",
        "filter_order",
        "step",
        "docs - u[after].n as kept",
        "u[after].n - u[before].n as removed",
        "u[bit].n - (u[after].n - u[before].n) as redundant",
        f"u[{everything}].n - u[{everything} ^ bit].n as unique_fails",
        "u[after].good - u[before].good as good_lost",
        "u[after].toxic - u[before].toxic as toxic_lost",
        f"""aggregate(filter(sequence(0, {everything}), s -> s & bit = 0), 0L,
            (total, s) -> total + {times} * (u[s | bit].n - u[s].n)) as shapley""",
    )


def _factorial(n):
    return 1 if n < 2 else n * _factorial(n - 1)


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
marks AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
counted AS (SELECT *, {_WORDS} AS words FROM texts),
judged AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           (len(words) < 200)::INT
         + (100 * len(list_distinct(words)) < 50 * len(words))::INT * 2
         + (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT * 4
         + regexp_matches(text, '[#$%&*|]')::INT * 8
         + (doc_id > first)::INT * 16 AS failed
    FROM counted JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
cells AS (
    SELECT part, failed, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic
    FROM judged GROUP BY part, failed),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(letter, bit)),
orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
    SELECT filter_order, step, l.bit,
           (SELECT coalesce(sum(p.bit), 0)::INT FROM letters p
            WHERE instr(filter_order, p.letter) < step) AS before
    FROM orders, range(1, 6) r(step), letters l WHERE l.letter = filter_order[step]),
applied AS (
    SELECT part, filter_order, step, bit,
           sum(n) - sum(CASE WHEN failed & (before | bit) <> 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN failed & bit <> 0 AND failed & before = 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN failed & bit <> 0 AND failed & before <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN failed & bit <> 0 AND failed & before = 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN failed & bit <> 0 AND failed & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM applied"""
