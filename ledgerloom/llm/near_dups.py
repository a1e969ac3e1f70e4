"""Operator 2: near duplicates by an inverted join over MinHash coordinates, confirmed on full shingle sets.

1. A scan gives each document's shingle set, its hash and a signature of COORDINATES minima. Documents of equal sets are
   one class, whatever their number; the rest works on classes.
2. Each class is posted under its coordinate-value pairs. Links at similarity t agree in about t of the coordinates; at
   least `threshold_matches` (five standard deviations below) are asked for. Pairs of values are ranked by how many
   classes hold them; two classes with so many in common meet within their rarest COORDINATES - threshold + 1 (prefix
   filter), so the others aren't posted, nor are values that only one class has (skipped in merging).
3. In each posting list a pivot stands for the rest: of its classes the one whose values are the most common. Classes
   whose matches with it reach the threshold (core) need no other pivot of the list: a class that matches one of them
   has 2 * threshold - COORDINATES matches with the pivot at least, and all that have so many are compared with the
   pivot, on full sets. The others go on to next pivots, four times as many in each round. In lists of at most FEW the
   pairs are taken themselves, if their signatures match.
4. Two classes a, b of a pivot p that are not both linked to it, and of which one reaches the threshold with it, may be
   linked to each other. With e(x) the symmetric
   difference of x and p, |a - b| + |b - a| = |e(a)| + |e(b)| - 2 |e(a) and e(b)|, so they must share many of their
   differences from p, and these are rare even in a large group of near copies. So classes are joined on a prefix of
   their differences, as long as the bounds ask for, and confirmed on all of them. Only classes that no links found so far
   connect are joined: first those of step 3; then, where tokens are held by many, those of rounds that take a share of the
   pairs by hash, growing to all in the last one. Between parts that a share p of the links leaves apart, n / p of them are
   left for n classes, so no group's links are all listed.
5. Links give components; the smallest doc_id names one and is the document kept.

A text with fewer words than a shingle has is one shingle; null and empty texts and those without words have none and
link with nothing. Rows with a null doc_id link with nothing and are kept. Repeated rows are equal sets; of a repeated
doc_id each row has its own set, and all its rows get the smallest component of them. Texts are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, importable, in_slices, keep_only, small_batches, written
from ledgerloom.llm.shingles import permutations, shingle_set, signature
from ledgerloom.operators.graph import components

COORDINATES = 40
#: Lists of at most so many classes are taken pair by pair; round k takes PIVOTS to the power of k pivots of a longer one.
FEW, PIVOTS = 6, 4
#: Sets that Python holds at once, beside the Arrow batch that brings them.
SLICE = 200
#: Rounds of `_within` start with a share of the pairs that gives at most CROWD for each posted row; SPREAD times as many in the next.
CROWD, SPREAD = 4, 16


def threshold_matches(percent: int, k: int = COORDINATES) -> int:
    t = percent / 100
    return max(1, math.floor(k * t - 5 * math.sqrt(k * t * (1 - t))))


def linked(a: int, b: int, differ: int, percent: int) -> bool:
    """Whether sets of sizes a and b that differ in so many elements have 100 * intersection >= percent * union."""
    return (100 - percent) * (a + b) >= (100 + percent) * differ


def _scan(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    keep_only("word hashes")
    factors = permutations(COORDINATES)
    for batch in batches:
        rows = {"doc_id": batch.column("doc_id"), "n": [], "h1": [], "h2": [], "sig": []}
        for text in batch.column("text"):
            s = shingle_set(text.as_py(), words)
            raw = s.tobytes()
            rows["n"].append(len(s))
            rows["h1"].append(xxhash.xxh64_intdigest(raw, 1) - (1 << 63))
            rows["h2"].append(xxhash.xxh64_intdigest(raw, 2) - (1 << 63))
            rows["sig"].append(signature(s, factors).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(rows["n"], pa.int64()), pa.array(rows["h1"], pa.int64()), pa.array(rows["h2"], pa.int64()), pa.array(rows["sig"], pa.binary())], schema=pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary())]))


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The sets of classes, from the texts of documents that have them; a row of another set is left out."""
    keep_only("word hashes")
    for batch in in_slices(batches, SLICE):
        nodes, sets = [], []
        for node, h1, h2, text in zip(*(batch.column(c).to_pylist() for c in ("node", "h1", "h2", "text"))):
            raw = shingle_set(text, words).tobytes()
            if h1 == xxhash.xxh64_intdigest(raw, 1) - (1 << 63) and h2 == xxhash.xxh64_intdigest(raw, 2) - (1 << 63):
                nodes.append(node)
                sets.append(raw)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], schema=pa.schema([("node", pa.int64()), ("shingles", pa.binary())]))


COMPARED = "pivot long, node long, pivot_n long, n long, core boolean, linked boolean, differences array<long>"
_COMPARED = pa.schema([("pivot", pa.int64()), ("node", pa.int64()), ("pivot_n", pa.int64()), ("n", pa.int64()), ("core", pa.bool_()), ("linked", pa.bool_()), ("differences", pa.list_(pa.int64()))])


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Differences of classes from their pivots: first what only the class has, then what only the pivot has, each by hash."""
    keep_only()
    for batch in in_slices(batches, SLICE):
        rows = []
        for pivot, node, ours, theirs, grouped, core in zip(*(batch.column(c).to_pylist() for c in ("pivot", "node", "pivot_set", "node_set", "grouped", "core"))):
            p, x = np.frombuffer(ours, np.uint64), np.frombuffer(theirs, np.uint64)
            more = x[~np.isin(x, p, assume_unique=True)]
            less_n = len(p) - (len(x) - len(more))
            near = linked(len(p), len(x), len(more) + less_n, percent)
            differences = None
            if grouped:
                differences = np.concatenate([more, p[~np.isin(p, x, assume_unique=True)]]).view(np.int64)
            rows.append({"pivot": pivot, "node": node, "pivot_n": len(p), "n": len(x), "core": core, "linked": near, "differences": differences})
        yield pa.RecordBatch.from_pylist(rows, schema=_COMPARED)


def _matches(a: str, b: str) -> Column:
    """In how many coordinates two signatures agree."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)")


def _postings(classes: DataFrame, prefix: int) -> DataFrame:
    """(token, node, common): each class under its rarest values that another class has too."""
    token = F.expr("transform(sequence(0, %d), i -> shiftleft(cast(i as bigint), 32) + 2147483648 + sig[i])" % (COORDINATES - 1))
    tokens = classes.select("node", F.explode(token).alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    ranked = tokens.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("all"))
    ranked = ranked.select("node", F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["held"]).alias("common"), F.expr(f"slice(all, 1, greatest(0, {prefix} - ({COORDINATES} - size(all))))").alias("first"))
    return ranked.select("node", "common", F.explode("first.token").alias("token"))


def _candidates(classes: DataFrame, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """(pivot, node, grouped, core) to compare on full sets; grouped: the pair is one of a list with a pivot; core: its
    signatures match, so the node needs no other pivot of that list. Also the tables that it comes from."""
    near = max(1, 2 * least - COORDINATES)
    left = written(_postings(classes, COORDINATES - least + 1), "postings")
    sig = written(classes.join(left.select("node").distinct(), "node", "left_semi").select("node", "sig"), "signatures")
    used, found, at = [sig, left], [], 0
    while True:
        lists = written(left.groupBy("token").agg(F.max(F.struct("common", (-F.col("node")).alias("less"))).alias("top"), F.count("*").alias("held")).where("held > 1"), "lists")
        used.append(lists)
        small = left.join(lists.where(F.col("held") <= FEW).select("token"), "token").select("token", "node")
        other = small.select(F.col("token").alias("other_token"), F.col("node").alias("other"))
        direct = small.join(other, (F.col("token") == F.col("other_token")) & (F.col("node") < F.col("other"))).select(F.col("node").alias("pivot"), F.col("other").alias("node"), F.lit(False).alias("grouped"))
        large = lists.where(F.col("held") > FEW).select("token", (-F.col("top.less")).alias("pivot"))
        if at:
            order = Window.partitionBy("token").orderBy(F.desc("common"), "node")
            large = left.join(large.select("token"), "token").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= PIVOTS**at).select("token", F.col("node").alias("pivot"))
        stars = written(left.join(large, "token").where("node <> pivot"), "stars")
        pairs = direct.union(stars.select("pivot", "node", F.lit(True))).groupBy("pivot", "node").agg(F.max("grouped").alias("grouped"))
        pairs = pairs.join(sig, "node").join(sig.select(F.col("node").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")
        pairs = written(pairs.select("pivot", "node", "grouped", _matches("sig", "pivot_sig").alias("matches")), "matches")
        rest = stars.join(pairs.select("pivot", "node", "matches"), ["pivot", "node"])
        # a pivot without a core class in a list has nothing there to stand for
        cores = rest.where(F.col("matches") >= least).select("token", "pivot").distinct()
        useful = rest.where(F.col("matches") >= near).join(cores, ["token", "pivot"], "left_semi").select("pivot", "node", F.lit(True).alias("grouped"), "matches")
        found.append(written(useful.distinct().union(pairs.where(~F.col("grouped") & (F.col("matches") >= least))), "found"))
        used += [stars, pairs, found[-1]]
        if at:
            rest = rest.groupBy("token", "node", "common").agg(F.max("matches").alias("matches")).join(large.select("token", F.col("pivot").alias("node")), ["token", "node"], "left_anti")
        rest = rest.where(F.col("matches") < least).select("node", "common", "token")
        left, at = written(rest, "postings"), at + 1
        used.append(left)
        if left.isEmpty():
            every = reduce(DataFrame.union, found)
            return every.groupBy("pivot", "node").agg(F.max("grouped").alias("grouped"), F.bool_or(F.col("matches") >= least).alias("core")), used


_BITS = tuple(f"bits{k}" for k in range(4))


def _bits(tokens: str, part: int) -> Column:
    """The tokens of one quarter as a set of 64 bits."""
    return F.expr(f"aggregate({tokens}, 0L, (s, x) -> if(x & 3 = {part}, s | shiftleft(1L, cast((x >> 2) & 63 as int)), s))")


def _merged(names: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of names, after links (part, b_part) between components; a class that is in no row is its own."""
    merged = written(components(links.select(F.col("part").alias("a"), F.col("b_part").alias("b")), local=0), "merged")
    into = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    known = names.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return written(known.union(merged.join(names, "node", "left_anti").select("node", "component")), "names")


def _within(compared: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that connect what all links do: those to pivots and, by their differences from a pivot, those between
    classes of it that are not both linked to it."""
    names = written(components(compared.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b")), local=0), "names")

    def placed(rows: DataFrame) -> DataFrame:
        """With part, the component of the class, and out: whether its pivot is in another one."""
        homes = names.select(F.col("node").alias("pivot"), F.col("component").alias("home"))
        rows = rows.join(names, "node", "left").join(homes, "pivot", "left").withColumn("part", F.coalesce("component", "node"))
        return rows.withColumn("out", F.col("part") != F.coalesce("home", "pivot")).drop("component", "home")

    r = (100 - percent) / (100 + percent)
    # d: differences; most: how much a class and any partner may differ; far: how much an unlinked partner differs from the pivot at least
    most = r * F.col("n") * (1 + 100 / percent)
    far = r * (percent / 100 * F.col("n") + F.col("pivot_n"))
    group = compared.where("differences is not null").withColumn("d", F.size("differences"))
    sized = placed(group.select("pivot", "node", "n", "core", "d"))
    # a row a pivot, first, so that the join with its many rows is one that Spark can split or broadcast
    pivots = sized.groupBy("pivot").agg(F.max(F.when(F.col("core"), F.col("d"))).alias("widest"), F.min(F.when(F.col("out"), F.when(F.col("core"), float("-inf")).otherwise(F.col("d") - most))).alias("closest"))
    pivots = written(pivots.where("closest <= widest + 1e-6").select("pivot", "widest"), "pivots")
    group = written(group.join(pivots, "pivot").where(F.col("core") | (F.col("d") - most <= F.col("widest") + 1e-6)), "groups")
    # differences that a single class has are shared with none; the others are posted, the rarest first
    each = group.select("pivot", "node", F.explode("differences").alias("token"))
    shared = each.groupBy("pivot", "token").agg(F.count("*").alias("held")).where("held > 1")
    ranked = each.join(shared, ["pivot", "token"]).groupBy("pivot", "node").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("shared"))
    bound = lambda partner: F.greatest(F.lit(1), F.ceil((F.col("d") + F.greatest(partner, F.col("d") - most) - most) / 2 - 1e-6))
    base = group.drop("differences").join(ranked, ["pivot", "node"]).withColumn("usable", F.size("shared"))
    # 256 bits of the shared differences: what the bits of two classes don't agree on, their differences don't either
    base = base.withColumns({f"bits{k}": _bits("shared.token", k) for k in range(4)})
    skipped = F.col("d") - F.col("usable")
    base = base.withColumns({"long": F.col("d") - bound(F.lit(0.0)) + 1 - skipped, "short": F.col("d") - bound(far) + 1 - skipped})
    base = written(base.where("long > 0").select("pivot", "node", "n", "d", "usable", *_BITS, "core", "linked", "long", "short", F.slice("shared.token", 1, F.greatest("long", "short").cast("int")).alias("first")), "posted")
    sides = ("pivot", "node", "n", "d", "usable", *_BITS, "core", "part", "out")
    posted = lambda rows, length: rows.select(*sides, F.explode(F.slice("first", 1, F.greatest(F.lit(0), F.col(length)).cast("int"))).alias("token"))
    fits = lambda differ: (100 - percent) * (F.col("n") + F.col("b_n")) >= (100 + percent) * differ

    def met(x: DataFrame, y: DataFrame, once: Column, share: int) -> DataFrame:
        y = y.select(*(F.col(c).alias(f"b_{c}") for c in (*sides, "token")))
        hit = (F.col("pivot") == F.col("b_pivot")) & (F.col("token") == F.col("b_token")) & once & (F.col("part") != F.col("b_part")) & (F.col("core") | F.col("b_core"))
        if share > 1:
            hit = hit & (F.pmod(F.xxhash64("pivot", "token", "node", "b_node"), F.lit(share)) == 0)
        hit = hit & fits(F.abs(F.col("d") - F.col("b_d"))) & fits(F.col("d") + F.col("b_d") - 2 * F.least("usable", "b_usable"))
        unlike = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"b_{c}"))) for c in _BITS)
        hit = hit & fits(F.col("d") + F.col("b_d") - F.col("usable") - F.col("b_usable") + unlike)
        return x.join(y, hit).select("pivot", F.col("node").alias("a"), F.col("b_node").alias("b"), "part", "b_part")

    held = posted(placed(base), "long").groupBy("pivot", "token").agg(F.count("*").alias("held"), F.count_if("out").alias("out"))
    total = held.agg(F.sum("held").alias("rows"), F.sum(F.col("held") * F.col("out")).alias("pairs")).first()
    share = 1
    while (total["pairs"] or 0) > CROWD * (total["rows"] or 0) * share:
        share *= SPREAD
    sets = group.select("pivot", "node", "n", "differences")
    while True:
        rows = placed(base)
        out, apart, close = rows.where("out"), rows.where("not linked"), rows.where("linked")
        both = met(posted(out, "short"), posted(apart, "short"), ~F.col("b_out") | (F.col("node") < F.col("b_node")), share).union(met(posted(out, "long"), posted(close, "short"), F.lit(True), share)).distinct()
        both = both.join(sets.select("pivot", F.col("node").alias("a"), "n", "differences"), ["pivot", "a"])
        both = both.join(sets.select("pivot", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("differences").alias("b_differences")), ["pivot", "b"])
        common = F.size(F.array_intersect("differences", "b_differences"))
        links = written(both.where(fits(F.size("differences") + F.size("b_differences") - 2 * common)).select("a", "b", "part", "b_part").distinct(), "links")
        if share == 1:
            return links.select("a", "b").union(names.select("node", "component"))
        names, share = _merged(names, links), share // SPREAD


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """`documents` (doc_id, text): rows (doc_id, n_shingles, component_id, kept), one for each row."""
    importable(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = documents.sparkSession
    with small_batches(spark):
        scanned = written(docs.mapInArrow(lambda b: _scan(b, words), "doc_id long, n long, h1 long, h2 long, sig binary"), "scanned")
    sig = F.expr("transform(sequence(0, %d), i -> cast(cast(conv(hex(substring(sig, 4 * i + 1, 4)), 16, 10) as bigint) - 2147483648 as int))" % (COORDINATES - 1))
    with_id = scanned.where("doc_id is not null and n > 0")
    classes = with_id.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("sig", sig), "classes")
    least = threshold_matches(percent)
    found, used = _candidates(classes, least)
    pairs = written(found, "pairs")
    discard(*used)
    involved = pairs.select(F.explode(F.array("pivot", "node")).alias("node")).distinct().join(classes.select("node", "first_doc", "h1", "h2"), "node")
    texts = docs.join(involved, docs["doc_id"] == involved["first_doc"]).select("node", "h1", "h2", "text")
    with small_batches(spark):
        sets = written(texts.mapInArrow(lambda b: _sets(b, words), "node long, shingles binary").dropDuplicates(["node"]), "sets")
    two = pairs.join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("pivot_set")), "pivot").join(sets.select("node", F.col("shingles").alias("node_set")), "node")
    with small_batches(spark):
        compared = written(two.select("pivot", "node", "pivot_set", "node_set", "grouped", "core").mapInArrow(lambda b: _compare(b, percent), COMPARED), "compared")
    discard(sets, pairs)
    links = _within(compared, percent)
    # of a doc_id that comes with several sets, all classes belong together
    several = with_id.groupBy("doc_id").agg(F.count_distinct("h1", "h2").alias("sets")).where("sets > 1").select("doc_id")
    theirs = with_id.join(several, "doc_id").join(classes.select("h1", "h2", "node"), ["h1", "h2"])
    repeats = theirs.groupBy("doc_id").agg(F.min("node").alias("a")).join(theirs.select("doc_id", F.col("node").alias("b")), "doc_id").select("a", "b")
    found = components(links.union(repeats), local=0)
    named = found.join(classes.select("node", "first_doc"), "node")
    named = named.join(named.groupBy("component").agg(F.min("first_doc").alias("component_id")), "component").select("node", "component_id")
    by_class = classes.select("h1", "h2", "node", "first_doc").join(named, "node", "left").select("h1", "h2", F.coalesce("component_id", "first_doc").alias("component_id"))
    whole = scanned.select("doc_id", "n", "h1", "h2").join(by_class, ["h1", "h2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
