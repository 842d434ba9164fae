"""Near-duplicate documents by a grouped prefix join on word shingles (operator 5).

A document's set are the hashes of its distinct five-word windows. All sets are ordered alike: by how frequent a sample shows a
shingle to be (in classes of powers of two), and by hash within a class. Two sets of size n and m with Jaccard similarity t share
one of the first n - ceil(t n) + 1 shingles of the order (their prefixes); the first one that they share leaves enough
shingles behind it in both (the place test). Steps:

1. Documents with equal sets become a class, classes with equal size and prefix a group. Only a group's prefix is expanded.
2. Groups meet at shared prefix shingles. Each is verified against one leader, the one that it meets most
   often as the first of a shingle's groups in a random order, and the members of a group against its least class. This
   is done in some rounds. These links, at most one a round for each class, give provisional components, in which
   clusters of copies, however large, already hang together.
3. Pairs of classes that share a prefix shingle and are in different components are all taken, all members of
   groups expanded. Shingles that the same classes have (a passage gives hundreds) become one list first. Pairs are
   made only where sizes, components and places allow. Members of one group that are still apart meet in the same way at
   the next shingles of the order. No link between different components can be missed, and links inside a component change nothing.
4. Components of both kinds of links.

Before whole sets are compared, parity bitmaps as long as the sets drop pairs that differ too much. Verification intersects
whole sets, which are made again from the texts of the documents that occur in pairs, with a hash that is independent of
the one that proposed them. Sets of hot leaders are salted. Frequencies only steer the order; any sample gives the same result.

Defined cases: null and empty texts and those without words have no shingles and link with nothing. One to four words are one
shingle. Rows with equal doc_id are one document. A row without doc_id gets the component of documents with an equal
set, or null. An empty table gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .arrowmap import arrow_map, trimmed
from .components import connected
from .shared import discard, quoted, stored


#: 64-bit words of the folded bitmap that is compared inside a join.
WORDS = 4


@dataclass(frozen=True)
class Params:
    """Threshold in percent, shingle width, the sample that the order is from, and bounds of what is broadcast.

    ``most_frequent`` bounds the table of frequent shingles: where there are more, only the more frequent half, quarter and so
    on is told apart. That costs work, never a link.
    """

    percent: int = 80
    width: int = 5
    sample_share: float = 0.2
    frequent: int = 4
    most_frequent: int = 1 << 22
    broadcast_ids: int = 400_000
    salt_rows: int = 256
    rounds: int = 5


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, family: int = 0) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, at = K.word_hashes(data, offsets, True, family)
    return _distinct(words, at, width, family)


def _distinct(words: np.ndarray, at: np.ndarray, width: int, family: int) -> list[np.ndarray]:
    grams, starts = K.windows(words, at, width, family)
    out = []
    for i in range(len(at) - 1):
        n = at[i + 1] - at[i]
        if n >= width:
            s = np.sort(grams[starts[i] : starts[i + 1]])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            out.append(K.mix((words[at[i] : at[i + 1]] * K.PLACES[64 * family : 64 * family + n]).sum(keepdims=True) + K.PLACES[64 * family + 40 + n]))
        else:
            out.append(grams[:0])
    return out


def _batches(batch: pa.RecordBatch, width: int, family: int = 0):
    data, offsets = K.column(batch.column("text"))
    for lo, hi in K.groups(offsets):
        yield shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width, family)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def frequency_classes(docs: DataFrame, p: Params) -> np.ndarray:
    """A table of one byte a bucket: a shingle's class is that of the bucket of its hash, 0 for those that aren't frequent.

    The table has four buckets for each frequent shingle and at most ``4 * most_frequent`` in all.
    """

    def make(batch: pa.RecordBatch) -> dict | None:
        sets = [s for many in _batches(batch, p.width) for s in many]
        h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return {"h": h.view(np.int64), "n": n}

    sampled = docs.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 20)) < int(p.sample_share * (1 << 20)))
    some = arrow_map(sampled, make, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= p.frequent)
    some = stored(some.select("h", F.floor(F.log2("n")).cast("tinyint").alias("c")), "frequent-shingles")
    sizes = {r["c"]: r["n"] for r in some.groupBy("c").agg(F.count("*").alias("n")).collect()}
    total, least = sum(sizes.values()), 0
    for c in sorted(sizes):
        if total > p.most_frequent:
            total, least = total - sizes[c], c + 1
    size = 1 << max(10, (4 * total - 1).bit_length() if total else 0)
    bucket = F.col("h").bitwiseAND(F.lit(size - 1)).cast("int")
    told = some.where(F.col("c") >= least).groupBy(bucket.alias("b")).agg(F.max("c").alias("c")).toArrow()
    discard(some)
    classes = np.zeros(size, np.uint8)
    classes[told.column("b").to_numpy()] = told.column("c").to_numpy() - least + 1
    return classes


def _ordered(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A sorted set in the common order."""
    late = classes[s & np.uint64(len(classes) - 1)]
    return s[np.argsort(late, kind="stable")] if late.any() else s


def prefix_size(n, percent: int):
    """Of n shingles in order, so many that a similar set has one of them in its own prefix."""
    return n - (percent * n + 99) // 100 + (n > 0)


def next_size(n: int, percent: int) -> int:
    """How many of the shingles behind equal prefixes must hold one that two similar sets of n share, if they share any more than needed."""
    shared = (2 * percent * n + 99 + percent) // (100 + percent)
    return max(0, n - max(shared, prefix_size(n, percent)) + 1)


def parity(s: np.ndarray) -> bytes:
    """One bit for each of a power of two of buckets, at least as many as shingles: whether it holds an odd number of them."""
    size = 1 << max(6, (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool), bitorder="little").tobytes()


def sketched(docs: DataFrame, classes: np.ndarray, p: Params) -> DataFrame:
    """doc_id, n, a 128-bit signature of the set, one of the prefix, the prefix in order, and the parity bitmap of the set."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def make(batch: pa.RecordBatch) -> dict:
        table = sent.value
        n, marks, prefixes, bits, words = [], [], [], [], []
        data, offsets = K.column(batch.column("text"))
        for lo, hi in K.groups(offsets):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            for s, other in zip(shingle_sets(part, at, p.width), shingle_sets(part, at, p.width, 1), strict=True):
                head = _ordered(s, table)[: prefix_size(len(s), p.percent)]
                n.append(len(s))
                marks.append([K.mix(s ^ K.PLACES[50]).sum(dtype=np.uint64), K.mix(other ^ K.PLACES[51]).sum(dtype=np.uint64), *[K.mix(head ^ K.PLACES[k]).sum(dtype=np.uint64) for k in (52, 53)]])
                prefixes.append(head)
                bits.append(parity(s))
                words.append(np.packbits((np.bincount((s & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1).astype(bool)).view(np.int64))
        marks = np.array(marks, np.uint64).reshape(-1, 4).view(np.int64)
        return {"doc_id": batch.column("doc_id"), "n": n, "s1": marks[:, 0], "s2": marks[:, 1], "p1": marks[:, 2], "p2": marks[:, 3], "prefix": _lists(prefixes), "bits": pa.array(bits, pa.binary()), **{f"w{k}": x for k, x in enumerate(np.array(words, np.int64).reshape(-1, WORDS).T)}}

    return arrow_map(docs, make, "doc_id long, n long, s1 long, s2 long, p1 long, p2 long, prefix array<long>, bits binary, " + ", ".join(f"w{k} long" for k in range(WORDS)))


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def _places_fit(n: Column, m: Column, i: Column, j: Column, percent: int) -> Column:
    """Whether two sets whose first shared shingle is at places i and j (from 0) can share as many as the threshold needs."""
    return F.lit(100 + percent) * F.least(n - i, m - j) >= F.lit(percent) * (n + m)


def bitmaps_fit(n: int, m: int, x: bytes, y: bytes, percent: int) -> bool:
    """Whether the parity bitmaps of two sets of n and m shingles allow the similarity.

    A shingle in one set alone flips one bit, so that the sets differ by at least as many shingles as the bitmaps by bits
    (Sandes and others, 2020). The longer one is folded to the length of the other.
    """
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    if len(a) < len(b):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    differ = int(np.bitwise_count(a ^ b).sum())
    return (100 + percent) * (n + m - differ) >= 2 * percent * (n + m)


def _words_fit(n: Column, m: Column, bits: list[tuple[Column, Column]], percent: int) -> Column:
    """``bitmaps_fit`` of bitmaps folded to some words, inside a join."""
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in bits), F.lit(0))
    return F.lit(100 + percent) * (n + m - differ) >= F.lit(2 * percent) * (n + m)


def plausible(pairs: DataFrame, bitmaps: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose bitmaps (node, n, bits) allow the similarity."""

    def make(batch: pa.RecordBatch) -> dict:
        columns = [batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")]
        good = pa.array([bitmaps_fit(*x, p.percent) for x in zip(*columns, strict=True)], pa.bool_())
        return {c: batch.column(c).filter(good) for c in ("a", "b")}

    sides = [bitmaps.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab"]
    return arrow_map(pairs.join(sides[0], "a").join(sides[1], "b"), make, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) of documents whose whole sets are similar enough; a may be in very many pairs.

    Sets go from the texts straight to the tasks that compare them, in one shuffle: the set of b once for each of its
    pairs, that of a once for each salt. A task streams through sorted rows, a's set before those of its partners.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / p.salt_rows).cast("long").alias("salts"))
    ours = pairs.join(salts, "a").select(F.col("b").alias("i"), F.col("a").alias("key"), F.pmod(F.xxhash64("b"), "salts").alias("salt"), F.lit(1).alias("role"))
    theirs = salts.select(F.col("a").alias("i"), F.col("a").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    roles = stored(ours.unionByName(theirs), "pair-roles")
    ids = roles.select(F.col("i").alias("doc_id")).distinct()
    small = roles.count() <= p.broadcast_ids

    def make(batch: pa.RecordBatch) -> dict:
        return {"i": batch.column("doc_id"), "s": _lists([s for many in _batches(batch, p.width, 1) for s in many])}

    chosen = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    sets = arrow_map(chosen, make, "i long, s array<long>").join(F.broadcast(roles) if small else roles, "i")

    def compare(batches):
        with trimmed():
            at, leaders = None, []
            for batch in batches:
                key, salt, role, name = (batch.column(c).to_numpy() for c in ("key", "salt", "role", "i"))
                lists = batch.column("s")
                ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
                a, b = [], []
                for r in range(batch.num_rows):
                    if (key[r], salt[r]) != at:
                        at, leaders = (key[r], salt[r]), []
                    own = flat[ends[r] : ends[r + 1]]
                    if role[r] == 0:
                        leaders.append(own.copy())
                    elif any(_overlaps(x, own, p.percent) for x in leaders):
                        a.append(key[r])
                        b.append(name[r])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    met = sets.repartition("key", "salt").sortWithinPartitions("key", "salt", "role").select("key", "salt", "role", "i", "s")
    return met.mapInArrow(compare, "a long, b long").distinct()


def _overlaps(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have the similarity."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def next_shingles(docs: DataFrame, members: DataFrame, classes: np.ndarray, p: Params) -> DataFrame:
    """(key, node, n, place, component) of the shingles behind the prefix of each of ``members`` (node, gid, n, component).

    Two members of a group have their prefixes in common, and are similar only if they share enough behind them. Places count
    from the end of the prefix, as what comes before it is shared.
    """
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def make(batch: pa.RecordBatch) -> dict:
        keys = []
        for s in (s for many in _batches(batch, p.width) for s in many):
            begin = prefix_size(len(s), p.percent)
            keys.append(_ordered(s, sent.value)[begin : begin + next_size(len(s), p.percent)])
        return {"node": batch.column("doc_id"), "next": _lists(keys)}

    chosen = docs.join(members.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    found = arrow_map(chosen, make, "node long, next array<long>").join(members, "node")
    found = found.select("node", "gid", "n", "component", F.posexplode("next").alias("at", "key")).distinct()
    return found.select(F.xxhash64("gid", "key").alias("key"), "node", "n", F.col("at").cast("long").alias("place"), "component")


def open_pairs(entries: DataFrame, bitmaps: DataFrame, p: Params) -> DataFrame:
    """(a, b): nodes of different components that share a key which can be their first; ``entries`` are (key, node, n, place, component).

    Keys that the same nodes have become one, told by 128 bits that are summed over a key's nodes.
    """
    marks = entries.groupBy("key").agg(*[F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"l{i}") for i in (1, 2)])
    lists = entries.join(marks, "key").groupBy("l1", "l2", "node", "n", "component").agg(F.min("place").alias("place"))
    names = [f"w{k}" for k in range(WORDS)]
    lists = stored(lists.join(bitmaps.select("node", "n", *names), ["node", "n"]), "open-lists")
    one, two = (lists.select("l1", "l2", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "component", "place", *names)]) for k in "ab")
    fit = (F.col("component_a") < F.col("component_b")) & _sizes_fit(F.col("n_a"), F.col("n_b"), p.percent) & _places_fit(F.col("n_a"), F.col("n_b"), F.col("place_a"), F.col("place_b"), p.percent)
    fit &= _words_fit(F.col("n_a"), F.col("n_b"), [(F.col(f"{c}_a"), F.col(f"{c}_b")) for c in names], p.percent)
    pairs = one.join(two, ["l1", "l2"]).where(fit)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = frequency_classes(docs, p)
    rows = stored(sketched(docs, order, p), "sketches")
    named = rows.where("n > 0 and doc_id is not null")
    classes = named.groupBy("n", "s1", "s2", "p1", "p2").agg(F.min("doc_id").alias("cls"), F.count("*").alias("copies"))
    classes = stored(classes, "classes")
    group = classes.groupBy("n", "p1", "p2").agg(F.min("cls").alias("gid"), F.count("*").alias("members"), F.sum("copies").alias("rows"))
    many = group.where("members > 1").select("n", "p1", "p2", "gid")
    members = stored(classes.join(many, ["n", "p1", "p2"]).where("cls <> gid").select("cls", "gid", "n"), "group-members")
    # Prefixes are not moved to find a group's least class; the others are taken out where they are.
    of = ["doc_id", "n", "p1", "p2"]
    rest = named.select(*of).join(group.where("rows > 1").select("n", "p1", "p2", "gid"), ["n", "p1", "p2"]).where("doc_id <> gid").select(*of).distinct()
    leaders = named.join(_small(stored(rest, "not-leading"), p), of, "left_anti").select(*of, "prefix")
    bitmaps = named.select(F.col("doc_id").alias("node"), "n", "bits", *[f"w{k}" for k in range(WORDS)])
    if named.count() != named.select("doc_id").distinct().count():  # repeated doc_ids: one row of each text
        leaders = leaders.groupBy(*of).agg(F.min("prefix").alias("prefix"))
        bitmaps = bitmaps.distinct()
    entries = leaders.select("n", F.col("doc_id").alias("gid"), F.posexplode("prefix").alias("place", "key"))
    # A key's groups are counted and led before they are joined, so that no task needs all groups of a key. Of two similar
    # sets the smaller has its first shared shingle at a place where a set of the same size could also have it.
    early = _places_fit(F.col("n"), F.col("n"), F.col("place"), F.col("place"), p.percent)
    heads = entries.groupBy("key").agg(*_least("gid", "n", "place", seed=1), F.count("*").alias("groups"), F.max(early).alias("early")).where("groups > 1 and early")
    shared = entries.join(heads.drop("groups", "early"), "key").select("key", "gid", "n", F.col("place").cast("long").alias("place"), F.col("l_gid").alias("lead"), F.col("l_n").alias("lead_n"), F.col("l_place").alias("lead_place"))
    shared = stored(shared, "shared-shingles")

    def component(df: DataFrame, node: str, loose: DataFrame) -> DataFrame:
        return df.join(loose.select(F.col("id").alias(node), "component"), node, "left").withColumn("component", F.coalesce("component", node))

    def best(meets: DataFrame, tried: list[DataFrame]) -> DataFrame:
        """(a, b): for each group the leader that it meets most often, of those not tried that it can be similar to at all."""
        fit = _sizes_fit(F.col("n"), F.col("lead_n"), p.percent)
        first = F.max(_places_fit(F.col("n"), F.col("lead_n"), F.col("place"), F.col("lead_place"), p.percent))
        meets = meets.where(fit).groupBy(F.col("gid").alias("b"), F.col("lead").alias("a")).agg(F.count("*").alias("times"), first.alias("first")).where("first")
        for old in tried:
            meets = meets.join(old, ["a", "b"], "left_anti")
        return meets.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a")).select("a", "b")

    met = best(shared.where("lead <> gid"), []).unionByName(members.select(F.col("gid").alias("a"), F.col("cls").alias("b"))).distinct()
    tried = [stored(met, "lead-pairs")]
    links = stored(verified(docs, stored(plausible(tried[0], bitmaps, p), "lead-pairs"), p), "lead-links")
    for seed in range(2, p.rounds + 1):
        loose = stored(connected(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "provisional")
        # Once more with other leaders for those that meet a stranger: in turn one at random and the one with the most
        # links so far, which is the most central of a cluster. Members of groups that are apart from it are led like groups.
        strays = component(members.select(F.col("cls").alias("node"), "gid", "n"), "node", loose).join(component(members.select("gid").distinct(), "gid", loose).withColumnRenamed("component", "of"), "gid").where("component <> of")
        known = component(shared.select("key", "gid", F.col("gid").alias("node"), "n", "place"), "node", loose)
        known = known.unionByName(shared.select("key", "gid", "place").join(strays.drop("of"), "gid").select(*known.columns))
        ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        known = stored(known.join(ends, "node", "left").drop("gid").withColumnRenamed("node", "gid").withColumn("degree", F.coalesce("degree", F.lit(0))), "known")
        others = known.groupBy("key").agg(*_least("gid", "n", "place", "component", seed=seed, first=-F.col("degree") if seed % 2 else None))
        again = known.join(others, "key").where("component <> l_component").select("gid", "n", "place", F.col("l_gid").alias("lead"), F.col("l_n").alias("lead_n"), F.col("l_place").alias("lead_place"))
        new = stored(best(again, tried), "lead-pairs")
        tried.append(new)
        found = stored(verified(docs, stored(plausible(new, bitmaps, p), "lead-pairs"), p), "lead-links")
        discard(known)
        if not found.limit(1).count():
            break
        links = stored(links.unionByName(found), "lead-links")
    loose = stored(connected(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "provisional")

    own = component(shared.select("key", F.col("gid").alias("node"), "gid", "n", "place"), "node", loose)
    inside = component(members.select(F.col("cls").alias("node"), "gid", "n"), "node", loose).join(component(members.select("gid").distinct(), "gid", loose).withColumnRenamed("component", "of"), "gid")
    inside = stored(inside.select("node", "gid", "n", "component", "of"), "members")
    strays = inside.where("component <> of")
    met = own.select("key", "component").unionByName(shared.select("key", "gid").join(strays.select("gid", "component").distinct(), "gid").select("key", "component"))
    mixed = met.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("key")
    # A member may be similar to what its group's least class is not similar to, so that all members take part.
    own = own.join(mixed, "key")
    expanded = own.select("key", "node", "n", "place", "component").unionByName(own.select("key", "gid", "place").join(inside.drop("of"), "gid").select("key", "node", "n", "place", "component"))
    expanded = stored(expanded, "open-shingles")
    pairs = open_pairs(expanded, bitmaps, p)
    # Members of one group that are still apart; the group's least class has been compared with all of them.
    torn = stored(inside.join(strays.select("gid").distinct(), "gid", "left_semi").drop("of"), "torn-groups")
    if torn.limit(1).count():
        pairs = pairs.unionByName(open_pairs(next_shingles(docs, torn, order, p), bitmaps, p)).distinct()
    third = stored(plausible(pairs, bitmaps, p), "open-pairs")
    more = verified(docs, third, p) if third.limit(1).count() else links.limit(0)
    final = connected(links.unionByName(more).select(F.col("b").alias("u"), F.col("a").alias("v")))
    told = classes.join(final.select(F.col("id").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    # Only classes with copies or links change anything; hot ones are salted, as one may hold a third of all rows.
    salts = 16
    if not rows.where("doc_id is null").limit(1).count():
        told = told.where("copies > 1 or component <> cls")
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("n", "s1", "s2", "salt", "component")
    lone = rows.select("doc_id", "n", "s1", "s2").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(salts)).cast("int"))
    out = lone.join(told, ["n", "s1", "s2", "salt"], "left")
    result = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    discard(members, shared, expanded, inside, torn, third, *tried)
    return result


def _least(*columns: str, seed: int, first: Column | None = None) -> list[Column]:
    """Values l_... of a key's first group, by ``first`` and at random, as aggregates of plain numbers, which are hashed and not sorted."""
    order = F.xxhash64(F.lit(seed), "key", "gid") if seed > 1 else F.xxhash64(F.lit(seed), "gid")
    if first is not None:
        order = first * F.lit(1 << 40) + F.pmod(order, F.lit(1 << 40))
    return [F.min_by(c, order).alias(f"l_{c}") for c in columns]


def _small(df: DataFrame, p: Params) -> DataFrame:
    """Broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= p.broadcast_ids else df


def representatives(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that are the least document of their component, one of each.

    Of rows with equal doc_id and text one stays; equal doc_ids with different texts stay. A row without doc_id stays
    unless a document with doc_id has an equal set, whose component it then has.
    """
    names = [F.col(quoted(c)) for c in docs.columns]
    found = stored(near_duplicates(docs, p), "near-duplicates")
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    if gone.count() <= p.broadcast_ids:
        gone = F.broadcast(gone)
    kept = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(*names)
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    n = again.count()
    if n:
        again = F.broadcast(again) if n <= p.broadcast_ids else again
        once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*names)
        kept = kept.join(again, "doc_id", "left_anti").select(*names).unionByName(once)
    nameless = docs.where("doc_id is null")
    if nameless.limit(1).count():
        nameless = stored(nameless.withColumn("row of nameless", F.monotonically_increasing_id()), "nameless")
        ids = F.col("doc_id").cast("long").alias("doc_id")
        sets = lambda df: sketched(df, np.zeros(1, np.uint8), p).where("n > 0").select("doc_id", "n", "s1", "s2")
        known = sets(docs.where("doc_id is not null").select(ids, "text")).select("n", "s1", "s2").distinct()
        same = sets(nameless.select(F.col("row of nameless").alias("doc_id"), "text")).join(known, ["n", "s1", "s2"], "left_semi")
        kept = kept.unionByName(nameless.join(same.select(F.col("doc_id").alias("row of nameless")), "row of nameless", "left_anti").select(*names))
    return kept


def oracle(docs: str = "documents", percent: int = 80) -> str:
    """DuckDB SQL: all pairs that share a shingle, by plain words; for small tables."""
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM {docs}),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS ss FROM w),
    e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS x FROM s),
    links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
    reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
    low AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
    SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, CAST(least(doc_id, coalesce(m, doc_id)) AS BIGINT) AS component_id FROM s LEFT JOIN low ON doc_id = u"""
