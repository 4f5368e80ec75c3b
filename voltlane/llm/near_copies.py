"""Near copies by exact similarity of their five-word shingles.

Two texts are linked if their sets of shingles have a Jaccard similarity of at least
SHARE. Links are found in three steps, each of which compares whole texts:

1. SimHash of five-word shingles, by the blocks of `simhash`: each text with the first of
   its class. This joins nearly equal texts.
2. Sets are put into one order for all texts. Of two linked sets the first fifth (and one
   more) of each holds a common shingle, so under these shingles all linked texts meet.
   Sizes, places and sketches (a bound on the sets' difference) rule pairs out; of the rest
   each key gives a spanning forest, and then each text the nearest one of the key's largest
   group: fewer pairs than texts.
3. Texts that meet and may be linked but are not yet in one group: all pairs. So no link
   between groups is lost, and a large group of near copies, which is one group by now,
   costs no pairs.

The order puts shingles first that a sample did not find in several texts. It decides how
many texts meet under one shingle, never which links are found.

Null and empty texts have no shingle and are one class. Texts with fewer words than a
shingle give one shingle. Equal word sequences are one node, of whichever row has the
smallest doc_id. Very long texts are blocks of their own. An empty table gives an empty
result; other columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlane.llm import simhash
from voltlane.llm.common import SPACE, RollingHash, by_key, lean, mix, runs, shingle_hash, small, text_blocks, utf8, written
from voltlane.llm.simhash import components, first_rows

SIZE = 5
#: The least similarity of a link, as a ratio of whole numbers.
SHARE = (4, 5)
#: Texts whose shingles are counted for the order, about; a shingle in COMMON of them or more comes late.
SAMPLE, COMMON = 8_000, 3

#: Bits of a sketch.
BITS = 512
#: Sketches that are broadcast, at most (13 MB); more are joined by a shuffle.
BROADCAST_SKETCHES = 200_000
#: Keys with at most so many texts are compared all at once.
FEW = 16
#: Bytes of text that one numpy pass looks at; its arrays are many times as large.
BLOCK = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's lower-cased words (ASCII, as bytes.lower and bytes.split), and where each text's begin."""
    buf, offsets = utf8(texts)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    buf = LOWER[buf]
    starts, ends = runs(~SPACE[buf], offsets)
    return RollingHash(buf).of(starts, ends), np.searchsorted(starts, offsets)


def forms(texts: pa.Array) -> np.ndarray:
    """One number for each text's sequence of words."""
    out = np.zeros(len(texts), np.uint64)
    at = 0
    for block in text_blocks(texts, BLOCK):
        h, first = words(block)
        n = np.diff(first)
        place = np.arange(len(h), dtype=np.uint64) - np.repeat(first[:-1], n).astype(np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + mix(place + np.uint64(1))), dtype=np.uint64)])
        out[at : at + len(block)] = mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64))
        at += len(block)
    return out.view(np.int64)


@F.arrow_udf(T.LongType())
def form(texts: pa.Array) -> pa.Array:
    return pa.array(forms(texts))


def sets(texts: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Text (position) and hash of the distinct shingles of a block, sorted by both."""
    h, first = words(texts)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    d, s = [], []
    for k in range(1, size + 1):
        hashed = shingle_hash(h, k)
        own = doc[: len(hashed)]
        fits = (own == doc[k - 1 : k - 1 + len(own)]) & ((n[own] == k) | (k == size))
        d.append(own[fits])
        s.append(hashed[fits])
    d, s = np.concatenate(d), np.concatenate(s)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    return d[new], s[new]


def common_shingles(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that COMMON texts or more of a sample hold, and in how many."""
    part = -(-nodes.count() // SAMPLE) or 1
    sample = nodes.where(F.pmod(F.xxhash64("id"), F.lit(part)) == 0)

    def deal(batches):
        for batch in batches:
            for block in text_blocks(batch.column("text"), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array(sets(block)[1].view(np.int64))], names=["key"])

    found = sample.select("text").mapInArrow(lean(deal), "key long").groupBy("key").count().where(F.col("count") >= COMMON)
    top = found.orderBy(F.desc("count"), "key").limit(200_000).toArrow()
    key, n = top.column("key").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def prefixes(nodes: DataFrame) -> DataFrame:
    """key, id, n (shingles of the text) and place for the shingles under which texts meet. nodes: id, text."""
    shared = nodes.sparkSession.sparkContext.broadcast(common_shingles(nodes))
    up, down = SHARE

    def deal(batches):
        known, count = shared.value
        for batch in batches:
            ids, at = batch.column("id").to_numpy(zero_copy_only=False), 0
            for block in text_blocks(batch.column("text"), BLOCK):
                d, s = sets(block)
                if len(known):
                    i = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    order = np.lexsort((s, np.where(known[i] == s, count[i], 0), d))
                    d, s = d[order], s[order]
                n = np.bincount(d, minlength=len(block))
                place = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
                meets = place <= n[d] - -(-up * n[d] // down)
                d, s, place = d[meets], s[meets], place[meets]
                # 48 bits of a shingle's hash are enough for a meeting; pairs are compared whole later
                yield pa.RecordBatch.from_arrays([pa.array((s >> np.uint64(16)).view(np.int64)), pa.array(ids[at + d]), pa.array(n[d].astype(np.int32)), pa.array(place.astype(np.int32))], names=["key", "id", "n", "place"])
                at += len(block)

    return nodes.select("id", "text").mapInArrow(lean(deal), "key long, id long, n int, place int")


def met(nodes: DataFrame) -> DataFrame:
    """The rows of `prefixes` whose key several nodes have."""
    dealt = prefixes(nodes).repartition("key").sortWithinPartitions("key", "n", "id")

    def meet(batches):
        for rows in by_key(batches, ("key", "id", "n", "place")):
            key, node = rows[:2]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            rows = [x[new] for x in rows]
            bucket = np.cumsum(np.append(False, rows[0][1:] != rows[0][:-1]))
            shared = np.bincount(bucket)[bucket] > 1
            if shared.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[shared]) for x in rows], names=["key", "id", "n", "place"])

    return dealt.mapInArrow(lean(meet), "key long, id long, n int, place int")


def sketches(nodes: DataFrame) -> DataFrame:
    """id and, for each of BITS classes of shingles, whether the text has an odd number of them, as bytes.

    Two sets differ in at least as many shingles as their sketches differ in bits."""

    def deal(batches):
        for batch in batches:
            at = 0
            for block in text_blocks(batch.column("text"), BLOCK):
                d, s = sets(block)
                odd = np.bincount(d * BITS + (s >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=len(block) * BITS) & 1
                packed = np.packbits(odd.astype(np.uint8).reshape(len(block), BITS), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(block)), pa.array([r.tobytes() for r in packed], pa.binary())], names=["id", "sketch"])
                at += len(block)

    return nodes.select("id", "text").mapInArrow(lean(deal), "id long, sketch binary")


def allowed(n, place, sketch, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (positions) under one key sizes, places and sketches leave open, and their sketches' distances."""
    up, down = SHARE
    most = np.minimum(n[i] - place[i], n[j] - place[j])  # right for the first shingle that both hold
    good = np.flatnonzero((down * np.minimum(n[i], n[j]) >= up * np.maximum(n[i], n[j])) & ((up + down) * most >= up * (n[i] + n[j])))
    apart = np.bitwise_count(sketch[j[good]] ^ sketch[i[good]]).sum(1, dtype=np.int64)
    fits = (up + down) * apart <= (down - up) * (n[i[good]] + n[j[good]])
    return good[fits], apart[fits]


def strangers(group, n, place, sketch, which: str):
    """Pairs (position, positions) of one key's rows that are in different groups and may be linked.

    Rows are sorted by n. Rows of the largest group are met by the others only, so a key whose
    texts are one group costs nothing. For a `forest`, rows that a pair joins count as one group
    from then on; `nearest` gives each row the row of the largest group whose sketch is nearest;
    so both give fewer pairs than rows. `all` gives all pairs."""
    up, down = SHARE
    _, of = np.unique(group, return_inverse=True)
    largest = np.bincount(of).argmax()
    rank = np.where(of == largest, len(of), np.arange(len(of)))
    for i in np.flatnonzero(of != largest).tolist():
        low, high = np.searchsorted(n, [-(-up * n[i] // down), down * n[i] // up + 1])
        j = low + np.flatnonzero((of[low:high] != of[i]) & (rank[low:high] > i))
        good, apart = allowed(n, place, sketch, np.full(len(j), i), j)
        j = j[good]
        if which == "nearest":
            good = np.flatnonzero(of[j] == largest)
            j = j[good[np.argmin(apart[good])]][None] if len(good) else good
        if which == "forest" and len(j):
            j = j[np.argsort(apart, kind="stable")]  # of each group the row that is nearest
            joined, first = np.unique(of[j], return_index=True)
            j = j[first]
            of[np.isin(of, joined)] = of[i]
        if len(j):
            yield i, j


def pairs_of(key, group, n, place, sketch, which: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions) of rows under equal keys that are in different groups and may be linked. Rows are sorted by key and n."""
    cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    sizes = np.diff(cuts)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
    for gap in range(1, FEW):
        few = few[few + gap < len(key)]
        few = few[key[few] == key[few + gap]]
        i = few[group[few] != group[few + gap]]
        i = i[allowed(n, place, sketch, i, i + gap)[0]]
        a.append(i)
        b.append(i + gap)
    for at, size in zip(cuts[:-1][sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        part = slice(at, at + size)
        for i, other in strangers(group[part], n[part], place[part], sketch[part], which):
            a.append(np.full(len(other), at + i))
            b.append(at + other)
    return np.concatenate(a), np.concatenate(b)


def crossing(rows: DataFrame, groups: DataFrame, drawn: DataFrame, which: str) -> DataFrame:
    """Distinct pairs (src, dst) of nodes of different groups that meet and may be linked, `which` of them as in `strangers`.

    rows: key, id, n, place; groups: node, component, for the nodes that are not a group of their own; drawn: id, sketch."""
    named = rows.join(small(groups.select(F.col("node").alias("id"), "component"), "groups"), "id", "left").select(*rows.columns, F.coalesce("component", "id").alias("group"))
    under = Window.partitionBy("key")
    # most keys hold one group by now
    open_rows = named.repartition("key").withColumns({"low": F.min("group").over(under), "high": F.max("group").over(under)}).where("low <> high").drop("low", "high")
    dealt = open_rows.join(drawn, "id").select("key", "id", "n", "place", "group", "sketch").repartition("key").sortWithinPartitions("key", "n", "id")

    def meet(batches):
        for key, node, n, place, group, sketch in by_key(batches, ("key", "id", "n", "place", "group", "sketch")):
            bits = np.frombuffer(b"".join(sketch.tolist()), np.uint64).reshape(len(key), -1)
            i, j = pairs_of(key, group, n.astype(np.int64), place.astype(np.int64), bits, which)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["src", "dst"])

    return dealt.mapInArrow(lean(meet), "src long, dst long").distinct()


def similar(left: pa.Array, right: pa.Array) -> np.ndarray:
    """True where the two texts' sets have a similarity of SHARE or more."""
    up, down = SHARE
    out = np.zeros(len(left), bool)
    at = 0
    for block in text_blocks(left, BLOCK):
        (d, s), parts, to = sets(block), [], 0
        for other in text_blocks(right.slice(at, len(block)), BLOCK):
            e, t = sets(other)
            parts.append((e + to, t))
            to += len(other)
        e, t = (np.concatenate(x) for x in zip(*parts, strict=True))
        both, met_ = np.concatenate([d, e]), np.concatenate([s, t])
        order = np.lexsort((met_, both))
        both, met_ = both[order], met_[order]
        same = both[1:][(both[1:] == both[:-1]) & (met_[1:] == met_[:-1])]
        k = np.bincount(same, minlength=len(block))
        out[at : at + len(block)] = down * k >= up * (np.bincount(both, minlength=len(block)) - k)
        at += len(block)
    return out


def wide_sketches(nodes: DataFrame) -> DataFrame:
    """id and sketch: the number of the text's shingles, and as `sketches` but with two bits for each shingle, or BITS.

    A number of bits is a power of two, so a long sketch folds to the length of a shorter one."""

    def deal(batches):
        for batch in batches:
            at = 0
            for block in text_blocks(batch.column("text"), BLOCK):
                d, s = sets(block)
                first = np.searchsorted(d, np.arange(len(block) + 1))
                drawn = []
                for a, b in zip(first, first[1:], strict=False):
                    bits = max(BITS.bit_length() - 1, int(2 * (b - a) - 1).bit_length())
                    odd = np.bincount((s[a:b] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
                    drawn.append(int(b - a).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8)).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(block)), pa.array(drawn, pa.binary())], names=["id", "sketch"])
                at += len(block)

    return nodes.select("id", "text").mapInArrow(lean(deal), "id long, sketch binary")


def may_be_similar(left: pa.Array, right: pa.Array) -> np.ndarray:
    """False where the sets' sizes, or the bits in which their wide sketches differ, leave no similarity of SHARE."""
    up, down = SHARE
    out = np.zeros(len(left), bool)
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        x, y = sorted((x.as_py(), y.as_py()), key=len)
        less, more = sorted(int.from_bytes(z[:8], "little") for z in (x, y))
        if down * less < up * more:
            continue  # one set is too small for the other
        a, b = np.unpackbits(np.frombuffer(x, np.uint8, offset=8)), np.unpackbits(np.frombuffer(y, np.uint8, offset=8))
        b = np.bitwise_xor.reduce(b.reshape(len(a), -1), axis=1)
        out[k] = (up + down) * int((a != b).sum()) <= (down - up) * (less + more)
    return out


def kept_pairs(pairs: DataFrame, nodes: DataFrame, column: str, good) -> DataFrame:
    """The pairs (src, dst) whose two values of `column` are `good`; both sides meet by pair, so a node in many pairs is no hot key."""
    side = lambda end, name: nodes.join(pairs, F.col("id") == F.col(end)).select("src", "dst", F.col(column).alias(name))
    both = side("src", "a").join(side("dst", "b"), ["src", "dst"])

    def judge(batches):
        for batch in batches:
            yield batch.select(["src", "dst"]).filter(pa.array(good(batch.column("a"), batch.column("b"))))

    return both.select("src", "dst", "a", "b").mapInArrow(lean(judge), "src long, dst long")


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose texts are similar, as a table in the shared folder.

    Most pairs are ruled out by wide sketches, a twentieth of the texts' size; whole texts are moved for the rest only."""
    pairs = small(pairs, "candidates")
    ends = small(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "ends")
    drawn = written(wide_sketches(nodes.join(ends, "id", "left_semi")), "wide-sketches")
    likely = small(kept_pairs(pairs, drawn, "sketch", may_be_similar), "likely")
    return written(kept_pairs(likely, nodes, "text", similar), "links")


def groups_of(nodes: DataFrame) -> DataFrame:
    """node, component for all nodes that are linked; component is the smallest node reachable. nodes: id, text."""
    blocks = simhash.classes(nodes.select(F.col("id").alias("doc_id"), "text"), SIZE)
    found = verified(blocks.where("component_id <> doc_id").select(F.col("component_id").alias("src"), F.col("doc_id").alias("dst")), nodes)
    # these links are stars around the classes' first nodes, so they are groups as they stand
    groups = found.select(F.col("dst").alias("node"), F.col("src").alias("component"))
    rows = written(met(nodes), "met")
    drawn = small(sketches(nodes.join(small(rows.select("id").distinct(), "wanted"), "id", "left_semi")), "sketches", BROADCAST_SKETCHES)
    for which in ("forest", "nearest", "all"):
        found = found.unionByName(verified(crossing(rows, groups, drawn, which), nodes))
        groups = components(found)
    return groups


def dedup(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each class of linked texts, one of its smallest doc_id; a row with null doc_id stays."""
    own = docs.where("doc_id is not null").select("doc_id", "text", form("text").alias("form"))
    forms = written(own.select("doc_id", "form"), "forms")
    firsts = forms.groupBy("form").agg(F.min("doc_id").alias("first"))
    more = small(forms.join(firsts, "form").where("doc_id <> first").select("doc_id", "form").distinct(), "copies")
    once = own.join(more, ["doc_id", "form"], "left_anti")
    nodes = written(once.select(F.monotonically_increasing_id().alias("id"), "form", "text"), "nodes")
    ids = nodes.groupBy("form").agg(F.min("id").alias("id"))
    named = forms.join(ids, "form").join(groups_of(nodes).withColumnRenamed("node", "id"), "id", "left")
    return first_rows(docs, named.select("doc_id", F.col("form").alias("fp"), F.coalesce("component", "id").alias("class")), form)
