"""N-gram Jaccard join by adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles. All sets are ordered by one global
order: shingles in few documents first, by hash, and the heavy ones last, by their count over
all documents. Of a set of n shingles, the first n - ceil(t n) + e form its prefix of extension
e; two sets of Jaccard similarity t share at least min(e, e') shingles of their prefixes. Each
document picks the e from 1 to MAX_EXTENSION of least estimated cost: the shingles it has to
send, and the candidates, at most (sum of the prefix's document counts) / e of them.

Equal sets are one class from the start (a 64-bit hash of the set with its size); copies only
meet their class again at the end. Prefixes are gathered by shingle, each list in order of how
many candidates its members expect. The first member of each size band leads the list, and each
class is verified against the leader that most of its lists name.
What that joins needs no more pairs. Lists of CLUSTER members or more that still hold several
labels are compared whole, block against block. Then all classes that still have different
labels, were not compared in a cluster and share enough prefix shingles are paired. So copies
of one document cost a pair each and not a square, while every link between labels is looked
at. Between these steps a label is the leader that a class leads to within a few links: equal
labels mean one component, unequal ones nothing, which is all that the pruning needs; the exact
components are worked out once, at the end. Verification gathers the texts of a leader and of
at most FOLLOWERS classes and counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm._common import discard, text_or_empty, written
from tidemark.llm.components import components
from tidemark.llm.textbytes import chunks, shingles, words
from tidemark.llm.window_dedup import SharedStream

MAX_EXTENSION = 8
LIGHT = 0.002  # other documents expected to hold a shingle outside the table
HEAVY = 1 << 15  # heavy shingles kept in the global order; others are ordered by hash
LOCAL_HEAVY = 12  # documents of one Arrow batch that make a shingle worth reporting
FOLLOWERS = 256
CLUSTER = 16  # members from which an unsettled list is compared as a whole
PICKS = 2  # such lists for each set
BLOCK = 512
HOT = 4096  # parts of all rows; a class above one part meets its copies by a broadcast
_U = np.uint64


def document_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; empty for a text without words."""
    for c in chunks(texts):
        found, bounds = shingles(words(c), k)
        for d in range(c.n):
            yield c.first + d, np.unique(found[bounds[d] : bounds[d + 1]])


def _signature(s: np.ndarray) -> int:
    """A 64-bit hash of a set, from the sum and xor of its mixed elements."""
    if not len(s):
        return 0
    x = s * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(31)
    x *= _U(0xC2B2AE3D27D4EB4F)
    both = np.array([x.sum(), np.bitwise_xor.reduce(s)], dtype=np.uint64)
    both *= np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], dtype=np.uint64)
    both ^= both >> _U(29)
    return int((both[:1] ^ both[1:]).view(np.int64)[0])


def _local_counts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Shingles that LOCAL_HEAVY distinct sets of a batch hold, with their number."""
    for batch in batches:
        seen, parts = set(), []
        for _, s in document_sets(batch["text"], k):
            g = (_signature(s), len(s))
            if g not in seen:
                seen.add(g)
                parts.append(s)
        if parts:
            tokens, n = np.unique(np.concatenate(parts), return_counts=True)
            keep = n >= LOCAL_HEAVY
            yield pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["token", "n"])


def heavy_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order of hash, their counts), at most HEAVY of them: the largest counts over all documents.

    A shingle is counted where LOCAL_HEAVY sets of a batch hold it. The table only sets the
    order and the cost estimate; the join is exact with any table.
    """
    found = docs.select(text_or_empty().alias("text")).mapInArrow(lambda x: _local_counts(x, k), "token long, n long")
    rows = found.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(HEAVY).collect()  # bounded by HEAVY
    tokens = np.array([r["token"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r["n"] for r in rows], dtype=np.int64)[order]


def choose_prefix(s: np.ndarray, heavy: np.ndarray, counts: np.ndarray, percent: int, per_candidate: float = 30.0) -> tuple[np.ndarray, int, int]:
    """(prefix, extension, expected candidates) of a set: the extension with the least cost of shingles sent plus candidates met."""
    n = len(s)
    base = n - -(-percent * n // 100)
    at = np.searchsorted(heavy, s)
    known = (at < len(heavy)) & (heavy[np.minimum(at, len(heavy) - 1)] == s) if len(heavy) else np.zeros(n, bool)
    weight = np.full(n, LIGHT)
    weight[known] = counts[at[known]]
    ordered = np.lexsort((s, weight))
    weight = weight[ordered]
    most = min(MAX_EXTENSION, n - base)
    met = np.cumsum(weight)
    cost = [base + e + per_candidate * met[base + e - 1] / e for e in range(1, most + 1)]
    e = int(np.argmin(cost)) + 1
    return s[ordered[: base + e]], e, int(met[base + e - 1])


_SETS = "token long, member long, packed long, doc_id long"
WEIGHT_BITS = 20


def _pack(size: np.ndarray, extension: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One long that sorts the greatest weight first, then by size and extension."""
    most = (1 << WEIGHT_BITS) - 1
    return (most - np.minimum(weight, most)) << 40 | size << 8 | extension


def _emit_prefixes(batches: Iterator[pa.RecordBatch], k: int, percent: int, heavy: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each prefix shingle of the batch's distinct sets, and (token null) one for each document."""
    for batch in batches:
        ids = batch["doc_id"]
        rows, members, sizes, seen, parts = [], [], [], set(), []
        for row, s in document_sets(batch["text"], k):
            g = _signature(s)
            rows.append(row)
            members.append(g)
            sizes.append(len(s))
            if len(s) and (g, len(s)) not in seen:
                seen.add((g, len(s)))
                parts.append((g, len(s), *choose_prefix(s, heavy, counts, percent)))
        n, names = len(rows), [x.split()[0] for x in _SETS.split(", ")]
        none = np.zeros(n, np.int64)
        packed = _pack(np.array(sizes, dtype=np.int64), none, none)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(members, pa.int64()), pa.array(packed), ids.take(pa.array(rows, pa.int64()))], names=names)
        for i in range(0, len(parts), 512):
            some = parts[i : i + 512]
            each = [len(p[2]) for p in some]
            tokens = np.concatenate([p[2] for p in some])
            member, size, e, weight = (np.array([p[j] for p in some], dtype=np.int64) for j in (0, 1, 3, 4))
            packed = np.repeat(_pack(size, e, weight), each)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(np.repeat(member, each)), pa.array(packed), pa.nulls(len(tokens), pa.int64())], names=names)


def _verify(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, the leader's first: the links of its followers."""
    group, leader, leader_set = None, 0, np.zeros(0, np.uint64)
    for batch in batches:
        groups, ids, heads = (batch[c].to_pylist() for c in ("grp", "doc_id", "head"))
        a, b = [], []
        for row, s in document_sets(batch["text"], k):
            if heads[row]:
                group, leader, leader_set = groups[row], ids[row], s
            elif groups[row] == group:
                both = len(np.intersect1d(s, leader_set, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(leader_set) - both) and both:
                    a.append(leader)
                    b.append(ids[row])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_id whose texts link; written."""
    number = F.row_number().over(Window.partitionBy("a", "part").orderBy("b"))
    # Followers of a hot leader are cut up by hash before they are numbered.
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(64))).withColumn("part", F.col("part") * 1_000_000 + F.floor(number / FOLLOWERS))
    grouped = written(dealt.select("a", "b", F.xxhash64("a", "part").alias("grp")), "join-pairs", merged=True)
    members = grouped.select("grp", F.col("b").alias("doc_id"), F.lit(False).alias("head")).unionAll(
        grouped.select("grp", F.col("a").alias("doc_id"), F.lit(True).alias("head")).distinct()
    )
    shown = docs.select("doc_id", text_or_empty().alias("text")).join(members.hint("merge"), "doc_id")
    # of repeated rows of one doc_id any will do as a leader: the group keeps the last one read
    links = shown.repartition("grp").sortWithinPartitions("grp", F.desc("head"), "doc_id").select("grp", "doc_id", "head", "text")
    out = written(links.mapInArrow(lambda x: _verify(x, k, percent), "a long, b long"), "join-links", merged=True)
    discard(grouped)
    return out


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id): the least doc_id that links lead to.

    Documents link when 100 * |intersection| >= percent * |union| of their sets of k-word
    shingles; words are [^\\x20\\x09-\\x0D]+ with A-Z lowered. With fewer than k words the
    whole sequence is the one shingle; without words (or null) the set is empty and links with
    nothing. Rows with a null doc_id are left out, as they cannot be named; extra columns are not read. Rows of one doc_id
    with different texts are linked through their id, and each has its own n_shingles.

    This gives components, not links: pairs already in one component are not compared, so there
    is no list of links and no number of links of a document. The counts that steer the prefixes
    are of shingles that stand out in an Arrow batch, others get a constant; they change the cost only.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    heavy, counts = heavy_shingles(texts, k)
    emitted = texts.mapInArrow(lambda x: _emit_prefixes(x, k, percent, heavy, counts), _SETS)
    # One shuffle for both kinds of rows: shingles by their hash, documents by their own id, so that no set gathers its copies.
    key = F.coalesce("token", F.xxhash64("doc_id")).alias("key")
    dealt = emitted.select(key, F.col("token").isNotNull().alias("listed"), "packed", "member", "doc_id")
    ordered = dealt.repartition("key").sortWithinPartitions("listed", "key", "doc_id", "packed", "member")
    lists = written(ordered.mapInArrow(_shared_lists, _LISTS), "join-lists")
    sets = lists.where("token IS NULL").select("doc_id", "member", "size", (F.col("extension") == 1).alias("again"))
    classes = written(sets.where("size > 0").groupBy("member", "size").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "join-classes", merged=True)
    posted = lists.where("token IS NOT NULL")
    stars = _verified(texts, _stars(posted, classes, percent), k, percent)
    labels = _labels(stars).toDF("id", "component")
    placed = written(classes.join(labels, "id", "left").select("member", "size", "id", F.coalesce("component", "id").alias("component")), "join-labels", merged=True)
    known = posted.select("token", "member", "size", "extension").join(placed, ["member", "size"])
    rest = written(_mixed_lists(known).select("id", "token", "size", "extension", "component"), "join-rest", merged=True)
    discard(placed)
    picks = written(_picks(rest), "join-picks", merged=True)
    links, left = stars, rest
    if not picks.isEmpty():
        links = stars.unionAll(_verified_clusters(texts, picks, k, percent))
        labels = components(links).toDF("id", "component")
        known = rest.drop("component").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        left = written(_mixed_lists(known), "join-rest", merged=True)
        discard(rest)
    left = left.join(picks, "id", "left")
    # What is left: pairs of two labels that no cluster has compared, by size and shared shingles.
    sides = [left.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "size", "extension", "component", "picks")]) for side in "xy"]
    close = (
        (F.col("x_id") < F.col("y_id"))
        & (F.col("x_component") != F.col("y_component"))
        & (100 * F.least("x_size", "y_size") >= percent * F.greatest("x_size", "y_size"))
        & ~F.coalesce(F.arrays_overlap("x_picks", "y_picks"), F.lit(False))
    )
    shared = sides[0].join(sides[1], "token").where(close).groupBy("x_id", "y_id")
    met = shared.agg(F.count("*").alias("n"), F.min(F.least("x_extension", "y_extension")).alias("e")).where("n >= e")
    more = _verified(texts, met.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")), k, percent)
    links = links.unionAll(more)
    if not sets.where("again").isEmpty():  # rows of one doc_id with different texts
        twice = sets.join(sets.where("again").select("doc_id").distinct(), "doc_id", "left_semi").join(classes, ["member", "size"])
        links = links.unionAll(twice.groupBy("doc_id").agg(F.min("id").alias("a"), F.collect_set("id").alias("b")).select("a", F.explode("b").alias("b")))
    final = components(links)
    placed = classes.join(final.hint("merge"), classes["id"] == final["node"], "left").select("member", "size", "n", F.coalesce("component", "id").alias("component_id"))
    return _spread(sets, placed).select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _spread(sets: DataFrame, placed: DataFrame) -> DataFrame:
    """sets with the component_id of their class. A class of more than a 4096th of all rows is broadcast: there are fewer than 4096 of them."""
    on = ["member", "size"]
    hot = F.broadcast(placed.where(F.col("n") > F.lit(placed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] / HOT)).drop("n"))
    rows = sets.select("doc_id", *on)
    few = rows.join(hot, on, "left_anti").join(placed.drop("n").hint("merge"), on, "left")
    return rows.join(hot, on).select("doc_id", "size", "component_id").unionAll(few.select("doc_id", "size", "component_id"))


def _labels(stars: DataFrame) -> DataFrame:
    """(node, component) of stars (a, b), where b has one leader a: where five steps of leaders' leaders lead to.

    Of two that lead each other the lesser follows no one. Nodes without a leader are left out.
    """
    up = stars.groupBy("b").agg(F.min("a").alias("a"))
    back = up.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("back"))
    up = written(up.join(back, ["a", "b"], "left").where("back IS NULL OR b > a").select("b", "a"), "join-leaders", merged=True)
    onward = written(up.join(up.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select(F.col("b").alias("top"), F.col("a").alias("next")), "join-leaders", merged=True)  # leaders' leaders
    led = up.select(F.col("b").alias("node"), F.col("a").alias("top"))
    for _ in range(4):
        led = led.join(onward, "top", "left").select("node", F.coalesce("next", "top").alias("top"))
    return led.select("node", F.col("top").alias("component"))


def _mixed_lists(known: DataFrame) -> DataFrame:
    """The rows of those lists whose members do not all have one label."""
    dealt = known.repartition("token")  # read twice, computed and shuffled once
    mixed = dealt.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("token")
    return dealt.join(mixed, "token")


def _stars(posted: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class b with the leader a that most of its lists name, by the least doc_id of either.

    A list is led by the member that expects the most candidates: what copies were made from
    shares more with them than they share with each other. Members that share too few lists
    with their leader wait for the clusters and the pairing.
    """
    led = posted.where("leader <> member OR leader_size <> size").groupBy("member", "size", "extension", "leader", "leader_size").agg(F.count("*").alias("n"))
    enough = F.greatest(F.lit(2), (F.col("size") * (100 - percent) / 100 + F.col("extension")) / 10)
    best = led.where((F.col("n") >= enough) | (F.col("size") < 20)).groupBy("member", "size").agg(F.max_by(F.struct("leader", "leader_size"), F.struct("n", "leader", "leader_size")).alias("to"))
    a = classes.select(F.col("member").alias("leader"), F.col("size").alias("leader_size"), F.col("id").alias("a"))
    named = best.select("member", "size", "to.*").join(a, ["leader", "leader_size"]).join(classes, ["member", "size"])
    return named.select("a", F.col("id").alias("b")).where("a <> b")


def _picks(rest: DataFrame) -> DataFrame:
    """(id, picks): up to PICKS of the longest lists of each unsettled set, of CLUSTER members or more."""
    lengths = rest.groupBy("token").agg(F.count("*").alias("members")).where(F.col("members") >= CLUSTER)
    order = Window.partitionBy("id").orderBy(F.desc("members"), "token")
    top = rest.join(lengths, "token").withColumn("n", F.row_number().over(order)).where(F.col("n") <= PICKS)
    return top.groupBy("id").agg(F.collect_list("token").alias("picks"))


def _verified_clusters(docs: DataFrame, picks: DataFrame, k: int, percent: int) -> DataFrame:
    """Links that join what all links between the sets of a picked list join; written.

    A list is cut by hash into blocks of about BLOCK sets and each two blocks meet in one group,
    so a set travels once for each block of its list, not once for each pair.
    """
    members = picks.select("id", F.explode("picks").alias("token"))
    # Lists of one block need no number; longer ones are at most one for BLOCK rows, so the longest is not gathered by its key.
    long = members.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1")
    numbered = members.join(F.broadcast(long), "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    cut = numbered.select("id", "token", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    grouped = cut.select(F.col("id").alias("doc_id"), F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("grp"))
    shown = docs.select("doc_id", text_or_empty().alias("text")).join(grouped.hint("merge"), "doc_id")
    rows = shown.repartition("grp").sortWithinPartitions("grp", "doc_id").select("grp", "doc_id", "text")
    return written(rows.mapInArrow(lambda x: _verify_groups(x, k, percent), "a long, b long"), "join-links", merged=True)


def _verify_groups(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: what the links inside each group of two blocks join, each tied to its first row."""
    group, ids, sets = None, [], []
    for batch in batches:
        groups, doc_ids = batch["grp"].to_numpy(), batch["doc_id"].to_numpy()
        for row, s in document_sets(batch["text"], k):
            if groups[row] != group:
                yield _forest(ids, sets, percent)
                group, ids, sets = groups[row], [], []
            ids.append(int(doc_ids[row]))
            sets.append(s)
    yield _forest(ids, sets, percent)


def _forest(ids: list[int], sets: list[np.ndarray], percent: int) -> pa.RecordBatch:
    n = len(ids)
    both, sizes = np.zeros((n, n), np.float32), np.array([len(s) for s in sets], np.float32)
    if n > 1:
        _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(n), sizes.astype(int))
        column = np.cumsum(count > 1) - 1  # only shingles of two sets matter
        keep = count[token] > 1
        doc, token = doc[keep], column[token[keep]]
        order = np.argsort(token, kind="stable")
        doc, token = doc[order], token[order]
        for at in range(0, int(column[-1]) + 1, 4096):
            lo, hi = np.searchsorted(token, [at, at + 4096])
            m = np.zeros((n, 4096), np.float32)
            m[doc[lo:hi], token[lo:hi] - at] = 1
            both += m @ m.T
    both, sizes = np.rint(both).astype(np.int64), sizes.astype(np.int64)
    linked = (100 * both >= percent * (sizes[:, None] + sizes[None] - both)) & (both > 0)
    linked |= np.eye(n, dtype=bool)
    first = np.arange(n)
    while n:  # the least row that links lead to
        after = np.where(linked, first[None], n).min(axis=1)
        after = after[after]
        if (after == first).all():
            break
        first = after
    ids = np.array(ids, dtype=np.int64)
    tied = np.flatnonzero(first != np.arange(n))
    return pa.RecordBatch.from_arrays([pa.array(ids[first[tied]]), pa.array(ids[tied])], names=["a", "b"])


_LISTS = "token long, member long, size int, extension int, doc_id long, leader long, leader_size int"


def _leaders(token: np.ndarray, member: np.ndarray, size: np.ndarray, carried: tuple) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Of rows sorted by list, the first member of each size band leads. carried: the last list of the rows before and its leaders by band."""
    band = (np.log(size) / math.log(4 / 3)).astype(np.int64)
    run = np.cumsum(np.append(False, token[1:] != token[:-1]))
    _, first, of = np.unique(run << 8 | band, return_index=True, return_inverse=True)
    leader, leader_size = member[first][of], size[first][of]
    last, by_band = carried
    if last == int(token[0]):
        for b, (m, n) in by_band.items():
            here = (run == 0) & (band == b)
            leader[here], leader_size[here] = m, n
    else:
        by_band = {}
    if run[-1] > 0:
        by_band = {}
    for i in first[run[first] == run[-1]].tolist():
        by_band.setdefault(int(band[i]), (int(leader[i]), int(leader_size[i])))
    return leader, leader_size, (int(token[-1]), by_band)


def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (extension 1: another set of this doc_id came before); of the sorted lists, those with at least two sets, each set once and with its leader."""
    last, last_doc, shared, carried = None, None, SharedStream(), (None, {})
    for batch in batches:
        listed = batch["listed"].to_numpy(zero_copy_only=False)
        docs = np.flatnonzero(~listed)
        if len(docs):
            d = batch.take(pa.array(docs))
            ids, sets = d["doc_id"].to_numpy(), d["member"].to_numpy()
            again = np.append(last_doc is not None and ids[0] == last_doc[0] and sets[0] != last_doc[1], (ids[1:] == ids[:-1]) & (sets[1:] != sets[:-1]))
            last_doc = (int(ids[-1]), int(sets[-1]))
            size = d["packed"].to_numpy() >> 8 & 0xFFFFFFFF
            none = pa.nulls(len(docs), pa.int64())
            yield _list_rows(none, d["member"], pa.array(size.astype(np.int32)), pa.array(again.astype(np.int32)), d["doc_id"], none, none.cast(pa.int32()))
        rows = np.flatnonzero(listed)
        if not len(rows):
            continue
        key, member, packed = (batch[c].to_numpy(zero_copy_only=False)[rows].astype(np.int64) for c in ("key", "member", "packed"))
        again = np.append(last == (int(key[0]), int(member[0]), int(packed[0])), (key[1:] == key[:-1]) & (member[1:] == member[:-1]) & (packed[1:] == packed[:-1]))
        last = (int(key[-1]), int(member[-1]), int(packed[-1]))
        key, member, packed = (x[~again] for x in (key, member, packed))
        if not len(key):
            continue
        size, ext = packed >> 8 & 0xFFFFFFFF, packed & 0xFF
        leader, leader_size, carried = _leaders(key, member, size, carried)
        key, member, size, ext, leader, leader_size = shared.step(key, (key, member, size, ext, leader, leader_size))
        if len(key):
            small = lambda x: pa.array(x.astype(np.int32))
            yield _list_rows(pa.array(key), pa.array(member), small(size), small(ext), pa.nulls(len(key), pa.int64()), pa.array(leader), small(leader_size))


def _list_rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=[x.split()[0] for x in _LISTS.split(", ")])
