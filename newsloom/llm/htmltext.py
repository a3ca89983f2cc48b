"""Main text of web pages with a suffix array per host (operator 5).

A page is split at its tags into blocks of text, which the page's own markup tells apart:
inside ``article`` or ``main`` everything may be text but menus, forms, adverts, notices, comments
and the like; where a page has such an element, what lies outside of it is not main text.

Of that text the host decides. The token streams of a host's pages are joined, and every suffix that
starts at a token is sorted by its first ``RUN`` tokens, as is every shorter block as a whole: tasks sort
runs, which are sent front coded and merged by their common prefixes. Equal neighbours from enough
distinct pages are boilerplate. As every long repeated string is made of repeated strings of ``RUN``
tokens, the tokens these cover are all that longer ones cover; they are removed and all else is kept.

Pages without an article and articles are sorted and counted apart. Outside of articles a string must be
on ``PAGES`` pages and a ``SHARE`` of the host's. Articles repeat each other's text, which is to stay, so in them
only what nearly all have in common goes: strings in ``ARTICLES`` distinct articles of the host and in
an ``ARTICLE_SHARE`` of all, and only where they are no more than half of the article, for one of which
more is repeated is a copy. Few strings are so frequent. Each string of ``RUN`` tokens is told by the least
hash of its ``GRAM``-token strings, as each short block by its own; these marks of all articles are
counted first, and only suffixes whose mark is frequent enough are sorted, so none that counts is missed.
"""

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from newsloom.llm.runs import front_code, front_decode, merge
from newsloom.llm.shipping import ship
from newsloom.operators.membership import key_filter, mark_members, members
from newsloom.operators.skew import attach
from newsloom.workspace import write_through

#: Tokens of a repeated string; shorter ones count as whole blocks only.
RUN = 24
#: Distinct pages of the host that must hold it, and share of all its pages.
PAGES = 3
SHARE = 0.1
#: Distinct articles of the host that must hold it, and share of them all, for it to go inside of articles.
ARTICLES = 10
ARTICLE_SHARE = 0.9
#: Tokens of the strings that mark a longer one.
GRAM = 8
#: Suffixes a task sorts at once, and about as many merged at once.
SORTED = 200_000
MERGED = 100_000

PIECE = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|template|noscript|svg|iframe|textarea|select)\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<",
    re.S | re.I,
)
BLOCK = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold other blocks; only these and marked ones are followed to their ends.
NESTED = frozenset(
    "article aside body button dialog div fieldset footer form head header main menu nav ol section table ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never main text; a header only outside of the article.
DROPPED = frozenset("aside button dialog footer form head menu nav title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MARK = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Words of a class or id that mark an element as something else than main text.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments "
    "commentlist consent cookie cookies copyright disqus discussion feedback footer gdpr header infobar login masthead "
    "menu modal nav navbar navigation newsletter notice notices overlay paywall popup promo promotion promoted "
    "recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tags teaser toolbar topbar widget".split()
)
#: Those of them that say nothing inside of an article: its own heading may be marked so.
OUTSIDE_ONLY = frozenset(["header"])
#: Those of them that mark an article element as something else than the page's article.
OTHER_ARTICLE = frozenset("comment comments promoted recommended related replies reply sponsored teaser".split())
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _is_marked(attributes, marked=MARKED):
    """Whether the attributes say that an element is not main text."""
    for name, value in MARK.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            if value.lower() in ROLES:
                return True
        elif name == "hidden":
            return True
        elif name == "aria-hidden":
            if value.lower() == "true":
                return True
        elif not marked.isdisjoint(SPLIT.split(CAMEL.sub(" ", value).lower())):
            return True
    return False


def blocks(page):
    """The page's blocks in order: ``(text, article, dropped)``.

    ``article``: 0 outside, else the number of the outermost ``article`` or ``main`` around it;
    ``dropped``: whether the markup says that it is something else than main text.
    """
    out, words = [], []
    stack = []  # (tag, dropped, article) of the elements that are open
    dropped, article, articles = False, 0, 0

    def close():
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text:
            out.append((text, article, dropped))

    last = 0
    for m in PIECE.finditer(page):
        start = m.start()
        if m.group() == "<":
            continue  # no tag: a character of the text
        if start > last:
            words.append(page[last:start])
        last = m.end()
        if not m.group(3):
            continue
        tag, closing = m.group(3).lower(), m.group(2)
        if tag in BLOCK:
            close()
        if closing:
            if tag in NESTED or any(s[0] == tag for s in stack):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        close()
                        _, dropped, article = stack[k]
                        del stack[k:]
                        break
            continue
        if tag in BLOCK and stack and stack[-1][0] == "p":
            _, dropped, article = stack.pop()
        if tag in VOID or m.group(4).endswith("/"):
            continue
        marks = MARKED - OUTSIDE_ONLY if article else MARKED
        marked = bool(m.group(4)) and tag not in ("html", "body", "article", "main") and _is_marked(m.group(4), marks)
        if tag in NESTED or marked:
            close()
            stack.append((tag, dropped, article))
            if tag == "article" and _is_marked(m.group(4), OTHER_ARTICLE):
                dropped = True
            if tag in ("article", "main") and not article and not dropped:
                articles += 1
                article = articles
            dropped = dropped or marked or tag in DROPPED or (tag == "header" and not article)
    if last < len(page):
        words.append(page[last:])
    close()
    return out


def _split(page):
    """``(text, outside)``: the text of the articles or None, and the blocks outside of any article.

    A page may have several; those that are marked as comments, teasers and the like are none.
    """
    found = blocks(page)
    inside = [text for text, article, dropped in found if article and not dropped]
    return "\n".join(inside) if inside else None, [(t, d) for t, a, d in found if not a]


def host_of(url):
    """The host of an address, in lower case; empty if there is none."""
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").lower()).split("/")[0].split("?")[0].split("#")[0]


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hashes(tokens):
    """A 64-bit hash of each token."""
    found = np.fromiter((zlib.crc32(t) for t in tokens), np.uint64, len(tokens))
    found = (found + np.uint64(1)) * _FACTOR
    return (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _run_marks(tokens, run):
    """The mark of the ``run`` tokens from each place on, 32 bits: it depends on these tokens alone."""
    if len(tokens) < run:
        return np.zeros(0, np.int64)
    own, gram = _hashes(tokens), min(GRAM, run)
    strings = np.zeros(len(tokens) - gram + 1, np.uint64)
    for k in range(gram):
        strings = strings * _FACTOR + own[k : k + len(strings)]
    return np.lib.stride_tricks.sliding_window_view(strings >> np.uint64(32), run - gram + 1).min(axis=1).astype(np.int64) - (1 << 31)


def _block_mark(tokens):
    return int.from_bytes(hashlib.blake2b(b" ".join(tokens), digest_size=4).digest(), "big") - (1 << 31)


def _marks(text, run):
    """The different marks of an article's suffixes and short blocks."""
    tokens, found = [], set()
    for line in text.split("\n"):
        own = [_token(w) for w in line.split()]
        if len(own) < run:
            found.add(_block_mark(own))
        tokens += own
    found.update(_run_marks(tokens, run).tolist())
    return sorted(found)


SPLIT_SCHEMA = (
    "row long, page_id long, url string, key long, host string, text string, "
    "outside array<struct<text: string, dropped: boolean>>, marks array<int>"
)


def _split_rows(batches, run):
    for batch in batches:
        columns = [[] for _ in range(8)]
        rows = zip(*(batch[c].to_pylist() for c in ("row", "page_id", "url", "key", "html")))
        for row, page_id, url, key, page in rows:
            text, outside = _split(page)
            outside = [{"text": t, "dropped": d} for t, d in outside]
            marks = None if text is None else _marks(text, run)
            for c, v in zip(columns, (row, page_id, url, key, host_of(url), text, outside, marks)):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(),
                 pa.list_(pa.struct([("text", pa.string()), ("dropped", pa.bool_())])), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)],
            names=["row", "page_id", "url", "key", "host", "text", "outside", "marks"],
        )


def _token(word):
    raw = word.encode("utf-8", "surrogatepass")
    return raw if len(raw) <= 64 else b"\0" + hashlib.blake2b(raw, digest_size=16).digest()


def _items(outside, run, marks=None):
    """``(place, string)`` of what may be repeated: runs of tokens, and shorter blocks as a whole.

    The place of a run is its first token; that of block k is ``-1 - k``. Only those with one of
    the ``marks``, if there are such.
    """
    tokens = []
    for k, block in enumerate(outside):
        own = [_token(w) for w in block["text"].split()]
        if len(own) < run and (marks is None or _block_mark(own) in marks):
            yield -1 - k, b"\1" + b" ".join(own) + b"\1"
        tokens += own
    places = range(len(tokens) - run + 1)
    if marks is not None:
        places = [k for k, mark in enumerate(_run_marks(tokens, run).tolist()) if mark in marks]
    for place in places:
        yield place, b" ".join(tokens[place : place + run])


RUN_SCHEMA = (
    "part int, shared binary, lengths binary, rests binary, pages binary, first_item long, "
    "item long, key long, place int"
)


def _run_rows(batches, parts, run):
    """Sorted runs for each part and the places (of pages without an article) of their suffixes."""
    task = TaskContext.get().partitionId()
    turn, held, size = 0, {}, 0
    names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]

    def told():
        nonlocal turn, held, size
        base = (task << 40) + (turn << 24)
        order = sorted(held)
        rows, cut = [], 0
        while cut < len(order):
            end = cut
            while end < len(order) and order[end][0] == order[cut][0]:
                end += 1
            own = order[cut:end]
            pages = np.array([len(held[k][0]) for k in own], "<u4").tobytes()
            rows.append((own[0][0], *front_code([k[1] for k in own]), pages, base + cut))
            cut = end
        kinds = [pa.int32()] + [pa.binary()] * 4 + [pa.int64()]
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        columns += [pa.nulls(len(rows), t) for t in (pa.int64(), pa.int64(), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=names)
        places = [(base + k, *p) for k, o in enumerate(order) for p in held[o][1]]
        columns = [pa.nulls(len(places), t) for t in kinds]
        columns += [
            pa.array([p[k] for p in places], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)
        turn, held, size = turn + 1, {}, 0

    for batch in batches:
        rows = zip(*(batch[c].to_pylist() for c in ("row", "counts", "key", "host", "wanted", "outside", "marks")))
        for row, counts, key, host, wanted, outside, marks in rows:
            lead = host.encode("utf-8", "surrogatepass") + b"\n"
            for place, string in _items(outside, run, marks and set(marks)):
                suffix = lead + string
                part = int.from_bytes(hashlib.blake2b(suffix, digest_size=6).digest(), "big") % parts
                pages, places = held.setdefault((part, suffix), (set(), []))
                if counts:
                    pages.add(row)
                if wanted:
                    places.append((key, place))
                    size += 1
            if len(held) + size >= SORTED:
                yield from told()
    if held:
        yield from told()


def _merged(table, least):
    """Items of one part whose string is on at least ``least`` distinct pages, with their host and that number."""
    columns = {c: table[c].to_pylist() for c in table.column_names}
    runs = [front_decode(*x) for x in zip(columns["shared"], columns["lengths"], columns["rests"])]
    pages = [np.frombuffer(x, "<u4").tolist() for x in columns["pages"]]
    out, hosts, totals = [], [], []
    group, total, size, host = [], 0, -1, ""

    def told():
        if total >= least:
            out.extend(group)
            hosts.extend([host] * len(group))
            totals.extend([total] * len(group))

    for r, index, n in merge(runs):
        string = runs[r][0][index]
        if not (n == len(string) == size):
            told()
            group, total, size = [], 0, len(string)
            host = string[: string.index(b"\n")].decode("utf-8", "surrogatepass")
        group.append(columns["first_item"][r] + index)
        total += pages[r][index]
    told()
    kinds = (pa.int64(), pa.string(), pa.int64())
    return pa.table({c: pa.array(v, t) for c, v, t in zip(("item", "host", "pages"), (out, hosts, totals), kinds)})


def _kept(outside, places, run):
    """The blocks' text without covered tokens; blocks dropped by the markup are left out."""
    count = sum(len(b["text"].split()) for b in outside)
    covered = np.zeros(count + 1, np.int64)
    for p in places or ():
        if p >= 0:
            covered[p] += 1
            covered[min(count, p + run)] -= 1
    covered = np.cumsum(covered) > 0
    whole = {-1 - p for p in places or () if p < 0}
    lines, at = [], 0
    for number, block in enumerate(outside):
        words = block["text"].split()
        if not block["dropped"] and number not in whole:
            left = [w for k, w in enumerate(words) if not covered[at + k]]
            if left:
                lines.append(" ".join(left))
        at += len(words)
    return "\n".join(lines)


def _kept_article(text, places, run):
    """An article without covered tokens; whole where more than half of it is covered."""
    kept = _kept([{"text": line, "dropped": False} for line in text.split("\n")], places, run)
    return kept if 2 * len(kept.split()) >= len(text.split()) else text


def _of_articles(host):
    """The name under which a host's articles are sorted and counted."""
    return F.concat(F.lit("\x02"), host)


def _again(rows, key):
    """``_again``: the ``row`` of all but the first of each ``key``."""
    repeated = rows.groupBy(key).agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = repeated.withColumnRenamed(key, "_key")
    again = rows.select("row", key).join(repeated, F.col(key).eqNullSafe(F.col("_key"))).where("row <> first")
    return write_through(again.select(F.col("row").alias("_again")), "again")


def _firsts(rows, key):
    """One row of each ``key``. Few are shuffled: those that may be others."""
    again = _again(rows, key)
    marked = mark_members(rows, key_filter(again, "xxhash64(_again)"), "xxhash64(row)", "maybe")
    other = marked.where("maybe").join(again, F.col("row") == F.col("_again"), "left_anti")
    return marked.where("not maybe").drop("maybe").unionByName(other.drop("maybe"))


def _frequent(split, least, share):
    """``(streams, hosts)``: distinct articles with the marks that enough articles of their host hold.

    ``hosts`` has how many distinct articles each host has.
    """
    inside = split.where("text is not null")
    articles = _firsts(inside.select("row", "article", "host", "marks"), "article").select("article", "host", "marks")
    hosts = articles.groupBy("host").agg(F.count("*").alias("of"))
    listed = articles.select("article", "host", F.explode("marks").alias("mark"))
    hashed = "xxhash64(host, mark)"
    # most marks are of one article, so they are counted by a number first
    counted = listed.groupBy(F.expr(hashed).alias("at")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    counted = write_through(counted.select("at"), "counted")
    often = members(listed, key_filter(counted, "at"), hashed).groupBy("host", "mark").agg(F.count("*").alias("n"))
    often = often.where(F.col("n") >= least).join(hosts, "host").where(F.col("n") >= share * F.col("of"))
    often = write_through(often.select("host", "mark"), "often")
    held = members(listed, key_filter(often, hashed), hashed).join(often, ["host", "mark"])
    held = write_through(held.groupBy("article").agg(F.collect_list("mark").alias("marks")), "held")
    texts = members(inside.select("article", "host", "text"), key_filter(held, "xxhash64(article)"), "xxhash64(article)")
    line = lambda x: F.struct(x.alias("text"), F.lit(False).alias("dropped"))
    streams = texts.dropDuplicates(["article"]).join(held, "article").select(
        F.col("article").alias("row"), F.col("article").alias("key"), _of_articles(F.col("host")).alias("host"),
        F.lit(True).alias("wanted"), F.transform(F.split("text", "\n"), line).alias("outside"), F.lit(True).alias("counts"),
        "marks",
    )
    return streams, hosts.select(_of_articles(F.col("host")).alias("host"), "of")


def _counting(split):
    """The streams outside articles of hosts with a page that has none.

    ``counts`` is true for one row of each ``page_id``.
    """
    again = _again(split.select("row", "page_id"), "page_id")
    streams = split.select("row", "key", "host", F.col("text").isNull().alias("wanted"), "outside").where(
        F.size("outside") > 0
    )
    # what other hosts repeat decides on nothing
    bare = write_through(split.where("text is null").select("host").distinct(), "hosts")
    streams = members(streams, key_filter(bare, "xxhash64(host)"), "xxhash64(host)")
    # few streams are shuffled: those that may be a repeated page's
    marked = mark_members(streams, key_filter(again, "xxhash64(_again)"), "xxhash64(row)", "maybe")
    sure = marked.where("not maybe").drop("maybe").withColumn("counts", F.lit(True))
    other = marked.where("maybe").drop("maybe").join(again, F.col("row") == F.col("_again"), "left")
    return sure.unionByName(other.withColumn("counts", F.col("_again").isNull()).drop("_again"))


def extract(pages, run=RUN, least=PAGES, share=SHARE, articles=ARTICLES, article_share=ARTICLE_SHARE):
    """``page_id, url, text, n_chars`` for every page; text is empty where there is none.

    A null page is an empty one, a null address has the empty host. Rows that repeat a page_id
    count as one page of the host, by one of them; an empty table gives no rows.
    """
    ship(pages.sparkSession)
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    keyed = source.withColumn("key", F.xxhash64("page_id", "url", "html"))
    keyed = keyed.withColumn("row", F.monotonically_increasing_id())
    split = write_through(keyed.mapInArrow(lambda b: _split_rows(b, run), SPLIT_SCHEMA), "pages")
    split = split.withColumn("article", F.xxhash64("host", "text"))
    frequent, of_articles = _frequent(split, articles, article_share)
    streams = _counting(split).withColumn("marks", F.lit(None).cast("array<int>")).unionByName(frequent)
    words = split.agg(F.sum(F.aggregate("outside", F.lit(0), lambda n, b: n + F.length(b["text"])))).first()[0]
    parts = max(1, (words or 0) // (6 * MERGED))
    runs = write_through(streams.mapInArrow(lambda b: _run_rows(b, parts, run), RUN_SCHEMA), "runs")
    merged = (
        runs.where("part is not null")
        .select("part", "shared", "lengths", "rests", "pages", "first_item")
        .groupBy("part")
        .applyInArrow(lambda table: _merged(table, least), "item long, host string, pages long")
    )
    merged = write_through(merged, "merged")
    hosts = split.groupBy("host").agg(F.count_distinct(F.struct("page_id")).alias("of"))
    bars = hosts.withColumn("bar", share * F.col("of")).unionByName(
        of_articles.withColumn("bar", F.greatest(F.lit(float(articles)), article_share * F.col("of")))
    )
    hosts = bars.drop("of").join(merged.groupBy("host").agg(F.count("*").alias("items")), "host")
    repeated = attach(merged, hosts, "host", "items", merged.count(), "item").where(
        F.col("pages") >= F.col("bar")
    )
    covered = (
        runs.where("item is not null").select("item", "key", "place").join(repeated.select("item"), "item")
        .groupBy("key").agg(F.collect_set("place").alias("places"))
    )
    covered = write_through(covered, "covered")
    bare = split.where("text is null").join(covered, "key", "left")

    def assembled(batches):
        for batch in batches:
            texts = [
                _kept(o, p, run) for o, p in zip(batch["outside"].to_pylist(), batch["places"].to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    rest = bare.select("page_id", "url", "outside", "places").mapInArrow(
        assembled, "page_id long, url string, text string"
    )

    def cut(batches):
        for batch in batches:
            texts = [
                _kept_article(t, p, run) for t, p in zip(batch["text"].to_pylist(), batch["places"].to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    # only articles that may hold boilerplate are moved
    inside = split.where("text is not null").select("page_id", "url", "text", "article")
    inside = mark_members(inside, key_filter(covered, "xxhash64(key)"), "xxhash64(article)", "maybe")
    some = inside.where("maybe").join(covered.withColumnRenamed("key", "article"), "article", "left")
    some = some.select("page_id", "url", "text", "places").mapInArrow(cut, "page_id long, url string, text string")
    whole = inside.where("not maybe").select("page_id", "url", "text").unionByName(some).unionByName(rest)
    return whole.withColumn("n_chars", F.length("text").cast("long"))
