"""Operator 2, n-gram Jaccard join: universe partition and pigeonhole.

A document's set has its distinct 5-word shingles as 64-bit hashes. Sets of
sizes a <= c with a Jaccard similarity of 0.75 differ in at most (a + c) // 7
shingles, and c <= 4a/3; so a set needs ``need(a)`` chances.

*Segments.* Sizes are cut into bands [2^k, 2^(k+1)). Band k hashes the
universe of shingles into m segments; a set's subset in a segment is one
signature (empty subsets have none). The first d segments also have the
signatures of their one-deletion neighbourhoods, so two subsets that differ by
one shingle meet too. A differing shingle spoils one segment (two chances in
the first d), so two similar sets share a signature of the smaller one's band as
soon as its chances are ``need`` or more. A set has signatures in its own band
and, if a smaller partner may be there, in the band below. ``allocate`` picks
m and d of each band at the least expected number of signatures; a set that
still lacks chances is found while signing, and its band is signed again finer.

*Cost-based allocation.* After one shuffle by signature, those that no other
set has cost nothing, so a set spends its spare chances on skipping its most
frequent ones; it probes only the cheapest of the rest, and a set whose unshared
signatures suffice probes none: ordinary texts, also those with a passage in
common, end here. A signature that many sets of one slice have is known to
be shared, so those rows are salted and only one is counted with the others.

*Verification.* The sets of the probing documents and their partners are cut
to single shingles, the finest universe partition, with the same allocation:
the smaller set probes its rarest a // 7 + 1 shingles, unshared ones for free.
A shingle's documents are first compared, exactly, with its hub, the one of them
that shares the largest part of itself. What is then already connected needs no
further pair: only probes of shingles whose documents still belong to several components
meet, if a link is possible: the shingles that two sets share lie inside a hub
or outside, and are at most the smaller number of either's on each side.
These pairs are verified exactly too.
So a group of many copies costs links to its hub, not all its pairs, and no link between
different components is lost.

Exact copies of a text are one node throughout (its 64-bit hash).

Defined results: null, empty and blank texts have no shingles and are linked
with nothing, each a component of its own; repeated ids and rows keep their
rows; null ids are linked like others, and a component without any id has a
null component_id; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkflow.llm.common import hold, mapped, sliced, small, utf8, written
from linkflow.llm.decontaminate import hashed, mix, shingles
from linkflow.llm.graph import components

SIZE = 5
#: Rows of a slice that share a signature before they are salted; rows of a slice; salts.
HOT, SLICE, SALTS = 32, 1024, 64
OWN, MUST, INDEX, META, SHORT, GHOST = range(6)
ROWS = "sig long, node long, info int, kind byte, salt byte"


def text_set(text: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes; bytes.lower and bytes.split know ASCII only."""
    return np.unique(shingles(hashed(text.lower().split()), SIZE))


def need(a: int) -> int:
    """Chances of which differences to any set at least as large leave one."""
    return (a + 4 * a // 3) // 7 + 1


@lru_cache(maxsize=256)
def allocate(band: int, finer: int = 0) -> tuple[int, int]:
    """(segments, segments with deletions) of a band: the least expected
    signatures for which chances exceed the need by five deviations."""
    low, high = 1 << band, (2 << band) - 1
    if high < 64 or finer > 3:
        return 1 << 20, 0  # nearly every shingle alone
    sizes = {low, (low + high) // 2, high}
    best = None
    for m in np.unique(np.geomspace(need(high), 8 * high, 160).astype(int)):
        cost, deletions = 0.0, 0
        for a in sizes:
            x = a / m
            empty = math.exp(-x)
            several = 1 - empty * (1 + x)
            spare = m * (1 - empty) - need(a) - 5 * math.sqrt(m * empty * (1 - (1 + x) * empty))
            if spare < 0:
                deletions = max(deletions, math.ceil(-spare / max(several, 1e-9) * 1.2) + 3)
            cost += m * (1 - empty) / len(sizes)
        if deletions <= m:
            cost += deletions * ((low + high) / 2 / m)
            if best is None or cost < best[0]:
                best = (cost, int(m), deletions)
    return best[1] << finer, best[2]


def signatures(h: np.ndarray, band: int, finer: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(signatures, which are of deletion segments, chances) of a set in a band."""
    m, d = allocate(band, finer)
    tag = np.array([band << 8 | finer], np.uint64)
    segment = (mix(h + mix(tag + np.uint64(1))) % np.uint64(m)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    segment, value = segment[order], mix(h + np.uint64(77))[order]
    starts = np.flatnonzero(np.diff(segment, prepend=-1))
    sums, ids, sizes = np.add.reduceat(value, starts), segment[starts], np.diff(starts, append=len(h))
    place = mix(ids.astype(np.uint64) + (tag << np.uint64(40)))
    must = (ids < d) & (sizes > 1)
    whole, chances = mix(sums ^ place), len(ids) + int(must.sum())
    if not must.any():
        return whole, must, chances
    cut = np.repeat(must, sizes)
    rest = mix((np.repeat(sums, sizes) - value)[cut] ^ np.repeat(place, sizes)[cut])
    return np.concatenate([whole, rest]), np.concatenate([must, np.ones(len(rest), bool)]), chances


def signed(texts: DataFrame, finer: dict[int, int] | None = None) -> DataFrame:
    """ROWS of each (node, text). ``finer``: only these bands, so much finer."""
    def run(batches):
        hold()
        for b in sliced(batches, SLICE):
            parts = []
            for node, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                h = text_set(text)
                n = len(h)
                if finer is None:
                    parts.append((mix(np.array([node], np.int64).astype(np.uint64)), node, n, [META]))
                own = n.bit_length() - 1
                below = own - 1 if own > 0 and -(-3 * n // 4) < 1 << own else None
                for band in (own, below) if n else ():
                    if band is None or finer is not None and band not in finer:
                        continue
                    sig, must, chances = signatures(h, band, (finer or {}).get(band, 0))
                    if band == below:
                        parts.append((sig, node, 0, np.full(len(sig), INDEX)))
                    elif chances < need(n):
                        parts.append((np.concatenate([sig, mix(sig[:1])]), node, band, np.append(np.full(len(sig), INDEX), SHORT)))
                    else:
                        parts.append((sig, node, chances - need(n), np.where(must, MUST, OWN)))
            sig = np.concatenate([p[0] for p in parts] or [np.array([], np.uint64)])
            many = [len(p[0]) for p in parts]
            node = np.repeat(np.array([p[1] for p in parts], np.int64), many)
            info = np.repeat(np.array([p[2] for p in parts], np.int32), many)
            kind = np.concatenate([p[3] for p in parts] or [[]]).astype(np.int8)
            salt = np.zeros(len(sig), np.int8)
            _, first, inverse, count = np.unique(sig, return_index=True, return_inverse=True, return_counts=True)
            if (count >= HOT).any():
                often = count[inverse] >= HOT
                salt[often] = 1 + np.flatnonzero(often) % SALTS
                lead = first[count >= HOT]
                salt[lead] = 0
                sig, node, info = (np.append(x, x[lead]) for x in (sig, node, info))
                kind, salt = np.append(kind, np.full(len(lead), GHOST, np.int8)), np.append(salt, np.zeros(len(lead), np.int8))
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node), pa.array(info), pa.array(kind), pa.array(salt)], ["sig", "node", "info", "kind", "salt"])

    return mapped(texts.select("node", "text"), run, ROWS)


def sets_of(texts: DataFrame) -> DataFrame:
    """(node, set array<long>) of each (node, text)."""
    def run(batches):
        hold()
        for b in sliced(batches):
            sets = [text_set(t).view(np.int64) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    return mapped(texts.select("node", "text"), run, "node long, set array<long>")


def shared_signatures(texts: DataFrame) -> DataFrame:
    """The rows whose signature another set has, with ``cnt``, and the META rows."""
    def counted(rows: DataFrame) -> DataFrame:
        cnt = F.when(F.col("salt") > 0, F.lit(1 << 30).cast("long")).otherwise(F.count("*").over(Window.partitionBy("sig", "salt")))
        return rows.withColumn("cnt", cnt).where(f"kind <> {GHOST} AND (cnt > 1 OR kind IN ({META}, {SHORT}))").drop("salt")

    found, tries = written(counted(signed(texts)), "jaccard-signatures"), 0
    last = found
    while bands := [r["info"] for r in last.where(f"kind = {SHORT}").select("info").distinct().collect()]:  # few bands
        tries += 1
        last = written(counted(signed(texts, {b: 2 * tries for b in bands})), "jaccard-signatures")
        found = found.unionByName(last)
    return found


def candidates(shared: DataFrame) -> DataFrame:
    """(node) of the sets that probe a signature and of those they may meet."""
    own = shared.where(f"kind IN ({OWN}, {MUST})")
    spare = own.groupBy("node").agg(F.count(F.when(F.col("kind") == OWN, 1)).alias("open"), F.count(F.when(F.col("kind") == MUST, 1)).alias("must"), F.max("info").alias("slack")).where("must > 0 OR open > slack")
    cheapest = F.row_number().over(Window.partitionBy("node", "kind").orderBy("cnt", "sig"))
    probes = own.join(spare, "node").withColumn("rank", cheapest).where(f"kind = {MUST} OR rank <= open - slack")
    sigs = probes.select("sig").distinct()
    return shared.where(f"kind <= {INDEX}").join(sigs, "sig", "left_semi").select("node").distinct()


def counted_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with the sizes of both sets and of their intersection."""
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select(*pairs.columns, F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))


def similar(counted: DataFrame) -> DataFrame:
    return counted.where("100 * common >= 75 * (na + nb - common)").select("a", "b")


def links(sets: DataFrame) -> DataFrame:
    """(a, b): verified links that connect all that is connected among ``sets``."""
    single = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("gram"))
    grams = written(single.withColumn("df", F.count("*").over(Window.partitionBy("gram"))).where("df > 1"), "jaccard-grams")
    full = grams.groupBy("node").agg(F.count("*").alias("avail"), F.first("n").alias("n")).where("avail >= ceil(0.75 * n)")
    full = written(full, "jaccard-full")
    rarest = F.row_number().over(Window.partitionBy("node").orderBy("df", "gram"))
    probing = full.where("n - avail <= n div 7")
    probes = grams.drop("n").join(probing, "node").withColumn("rank", rarest).where("rank <= n div 7 + 1 - (n - avail)").select("gram", "node", "n", "avail")
    probes = written(probes, "jaccard-probes")
    index = grams.drop("n").join(full, "node").join(probes.select("gram").distinct(), "gram", "left_semi").select("gram", "node", "n", "avail")
    index = written(index, "jaccard-index")

    share = F.struct((F.col("avail") / F.col("n")).alias("share"), "node")
    index = written(index.join(index.groupBy("gram").agg(F.max(share)["node"].alias("hub")), "gram"), "jaccard-index")
    to_hub = written(counted_pairs(index.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), sets), "jaccard-hubs")
    first = similar(to_hub).where("a <> b")

    comp = components(first)
    common = to_hub.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.col("common").alias("inside"))
    members = index.join(common, ["node", "hub"]).join(comp, "node", "left").withColumns({"comp": F.coalesce("comp", "node"), "outside": F.col("avail") - F.col("inside")})
    members = written(members, "jaccard-members")
    mixed = members.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram")
    members = members.join(mixed, "gram", "left_semi")
    p = members.join(probes.select("gram", "node"), ["gram", "node"], "left_semi").alias("p")
    larger = "struct(m.n, m.avail, m.node) > struct(p.n, p.avail, p.node)"  # of equal sizes the one with fewer probes probes
    possible = "7 * (least(p.inside, m.inside) + least(p.outside, m.outside)) >= 3 * (p.n + m.n)"
    may = f"p.gram = m.gram AND p.comp <> m.comp AND {larger} AND 3 * m.n <= 4 * p.n AND {possible}"
    rest = p.join(members.alias("m"), F.expr(may)).select(F.col("p.node").alias("a"), F.col("m.node").alias("b")).distinct()
    return first.unionByName(written(similar(counted_pairs(rest, sets)), "jaccard-links"))


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, n_shingles, component_id, node, comp) of each row of ``docs``;
    ``comp`` tells components apart, which ``component_id`` does not when an id
    is the least of several."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # each step's shuffle files go with it
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("node"), F.col(text_col).alias("text"))
    rows = written(texts.select("id", "node"), "jaccard-rows")
    copies = written(rows.groupBy("node").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n"), "jaccard-copies")
    single = texts.join(small(copies), "node", "left").where("lead IS NULL OR id = lead").select("node", "text")

    shared = shared_signatures(single)
    sizes = shared.where(f"kind = {META}").groupBy("node").agg(F.max("info").cast("long").alias("n_shingles"))
    chosen = written(candidates(shared), "jaccard-candidates")
    sets = written(sets_of(single.join(small(chosen), "node", "left_semi")).dropDuplicates(["node"]), "jaccard-sets")
    comp = components(links(sets))

    nodes = rows.groupBy("node").agg(F.min("id").alias("least")).join(sizes, "node", "left").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    nodes = written(nodes, "jaccard-nodes")
    lead = nodes.groupBy("comp").agg(F.min("least").alias("component"))
    of_node = nodes.join(lead, "comp").select("node", "n_shingles", "component", "comp")
    out = rows.join(of_node, "node")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id"), "node", "comp")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, node) of each row of ``docs``."""
    return grouped(docs, id_col, text_col).drop("comp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: that of the least doc_id (one
    of several rows with it). Rows without an id stay."""
    found = written(grouped(docs, "doc_id", "text"), "jaccard-groups")
    out = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node")).distinct()
    node = F.xxhash64(F.coalesce("text", F.lit("")))
    same = F.expr("doc_id = __id AND __key = __node")
    left = docs.withColumn("__key", node).join(small(out), same, "left_anti")
    leads = found.where("doc_id = component_id AND n_shingles > 0").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node"), F.col("comp").alias("__comp"))
    again = written(leads.groupBy("__comp").count().where("count > 1").drop("count"), "jaccard-again")
    if again.isEmpty():
        return left.drop("__key")
    twice = written(leads.join(small(again), "__comp", "left_semi").distinct(), "jaccard-twice")
    once = left.join(small(twice), same).dropDuplicates(["__comp"]).select(left.columns)
    return left.join(small(twice), same, "left_anti").unionByName(once).drop("__key")
