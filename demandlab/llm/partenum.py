"""Jaccard join of word-shingle sets by PartEnum signatures, and its components.

Sets are cut into size bands so that two sets above the threshold lie in the
same band or in neighbouring ones.  For a band, the shingle domain is hashed
into ``groups`` first-level partitions of three parts each; every two of the
three parts of a group give one signature (band, group, which two, content).
Two sets whose symmetric difference is at most k miss at most
``k // 2`` groups by two or more shingles, so some group differs in one
part at most and the pair shares a signature.  ``slack`` further groups leave
more than one such group: signatures of empty parts can then be left out by
every set that has no more than ``slack`` groups with empty pairs of parts,
and no pair is lost.

Copies (equal sets) are one node.  Signature groups are resolved without
listing their pairs: each member is first compared with the smallest and the
largest member of the group it shares most with; only members that are still
in different components are paired, and the exact test decides every link.

Signatures are dealt in ``SIGN_PARTS`` rounds, each of which signs all sets
anew and keeps its part of the signatures; texts meet in ``TEXT_PARTS`` squared
rounds.  A round's shuffle files go before the next one, so the disk holds a
part of what is dealt in all.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages, mix, set_sums, shingle_sets, text_chunks
from .graph import connected_components, spanning_forest

SIGN_BITS = 2
SIGN_PARTS = 1 << SIGN_BITS  # rounds of signatures, by their first bits
TEXT_PARTS = 2  # parts of the sets, by a hash of their keys; each pair of parts is a round of texts that meet


def size_bands(largest: int, percent: int) -> np.ndarray:
    """Upper ends of the size bands 1, 2, ...: each is the last one's next size
    divided by the threshold."""
    ends = [0]
    while ends[-1] < largest:
        ends.append((ends[-1] + 1) * 100 // percent)
    return np.array(ends + [(ends[-1] + 1) * 100 // percent])


def instance_shape(band_end: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the band that ends there: the largest symmetric difference of two
    similar sets, the number of groups and the slack."""
    k = (100 - percent) * 2 * band_end // (100 + percent)
    need = k // 2 + 1
    slack = need // 10 + (need >= 3)
    return k, need + slack, slack


def signatures(sets: np.ndarray, sizes: np.ndarray, percent: int, band_shift: int):
    """Signatures of every set for its band (shift 0) or the next one (shift 1):
    (signature, row of the set), and how many of them each set shares with any
    similar set in that band at least.  A signature's last bit is its band's."""
    ends = size_bands(int(sizes.max(initial=1)), percent)
    band = np.searchsorted(ends, sizes) + band_shift
    k, groups, slack = instance_shape(ends[np.minimum(band, len(ends) - 1)], percent)
    groups = np.where((sizes > 0) & (k > 0), groups, 0)  # k = 0: only equal sets are similar
    base = np.r_[0, np.cumsum(groups * 3)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keep = groups[owner] > 0
    owner, h = owner[keep], mix(sets[keep])
    part = ((h >> np.uint64(32)) * (groups[owner] * 3).astype(np.uint64)) >> np.uint64(32)
    slot = base[owner] + part.astype(np.int64)
    total = int(base[-1])
    if total == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.ones(len(sizes), np.int64)
    content = set_sums(mix(h), slot, total).reshape(-1, 3)
    filled = (np.bincount(slot, minlength=total) > 0).reshape(-1, 3)
    who = np.repeat(np.arange(len(sizes)), groups)
    place = np.arange(len(who)) - (base[:-1] // 3)[who]
    out, rows = [], []
    pair_empty = np.stack([~(filled[:, i] | filled[:, j]) for i, j in ((0, 1), (0, 2), (1, 2))], 1)
    risky = np.bincount(who, pair_empty.any(1), len(sizes))
    drop_empty = (risky <= slack)[who]
    with np.errstate(over="ignore"):
        seed = mix(band[who].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + place.astype(np.uint64))
        for c, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            ok = ~(pair_empty[:, c] & drop_empty)
            sig = mix(seed + np.uint64(c + 1) * content[:, i] + mix(content[:, j] + np.uint64(c)))
            out.append(((sig & ~np.uint64(1)) | (band[who] & 1).astype(np.uint64))[ok])
            rows.append(who[ok])
    return np.concatenate(out), np.concatenate(rows), np.maximum(1, 1 + slack - risky.astype(np.int64))


def _set_keys(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        return mix(set_sums(mix(sets), owner, len(sizes)) + sizes.astype(np.uint64)).view(np.int64)


def _describe(size: int):
    def run(batches):
        for b in batches:
            for a, buf, off in text_chunks(b.column("text")):
                sets, sizes = shingle_sets(buf, off, size)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(a, len(sizes)), pa.array(sizes.astype(np.int64)),
                     pa.array(_set_keys(sets, sizes))], ["doc_id", "n_shingles", "set_key"])
    return run


def _sign(size: int, percent: int, part: int):
    """The signatures of a round and the sets that have them."""
    def run(batches):
        seen: set[int] = set()  # copies within the task's own rows sign once
        for b in batches:
            for _, buf, off in text_chunks(b.column("text")):
                sets, sizes = shingle_sets(buf, off, size)
                keys = _set_keys(sets, sizes)
                fresh = np.array([not (k in seen or seen.add(k)) for k in keys.tolist()], bool)
                sets, keys, sizes = sets[np.repeat(fresh, sizes)], keys[fresh], sizes[fresh]
                for shift in (0, 1):
                    sig, row, _ = signatures(sets, sizes, percent, shift)
                    own = sig >> np.uint64(64 - SIGN_BITS) == part
                    yield pa.RecordBatch.from_arrays([pa.array(sig[own].view(np.int64)), pa.array(keys[row[own]])],
                                                     ["sig", "set_key"])
    return run


def _test(size: int, percent: int):
    """Exact Jaccard test of the pairs (a, b) with both texts."""
    def run(batches):
        for b in batches:
            n = b.num_rows
            linked = np.zeros(n, bool)
            sides = [[], []]
            for side, name in enumerate(("text_a", "text_b")):
                for _, buf, off in text_chunks(b.column(name)):
                    sets, sizes = shingle_sets(buf, off, size)
                    sides[side] += np.split(sets, np.cumsum(sizes)[:-1])
            for done in range(n):
                x, y = sides[0][done], sides[1][done]
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked[done] = both * 100 >= percent * (len(x) + len(y) - both) and both > 0
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(keep)
    return run


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int, stages: Stages) -> DataFrame:
    """The pairs (a, b) that pass the exact test."""
    def part(key: str):
        return F.pmod(F.xxhash64(key), F.lit(TEXT_PARTS))

    rounds = []
    for i, j in product(range(TEXT_PARTS), repeat=2):
        one = texts.where(part("set_key") == i).select(F.col("set_key").alias("a"), F.col("text").alias("text_a"))
        two = texts.where(part("set_key") == j).select(F.col("set_key").alias("b"), F.col("text").alias("text_b"))
        meet = pairs.where((part("a") == i) & (part("b") == j)).join(two, "b").join(one, "a")
        rounds.append(stages.table(meet.select("a", "b", "text_a", "text_b").mapInArrow(_test(size, percent), "a long, b long"),
                                   f"links-{i}-{j}"))
    return reduce(DataFrame.unionByName, rounds)


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_shingles, component_id.

    Texts are lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; two
    rows link when 100 * |intersection| >= percent * |union| of their distinct
    ``size``-word shingles (a shorter text: its whole word sequence).

    Null or blank texts have the empty set and link with nothing.  Rows with a
    null doc_id are returned with component_id null and link with nothing.
    Repeated rows are copies of one another.  Other columns are ignored.
    Sets are compared by 52-bit shingle hashes, equal sets found by 64-bit
    hashes of the whole set.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id IS NOT NULL")
    stages = Stages(docs.sparkSession)
    facts = stages.table(docs.mapInArrow(_describe(size), "doc_id long, n_shingles long, set_key long"), "sets")
    nodes = facts.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))

    # signature groups with more than one distinct set
    by_sig = Window.partitionBy("sig")
    rounds = []
    for part in range(SIGN_PARTS):
        signed = known.mapInArrow(_sign(size, percent, part), "sig long, set_key long")
        crowded = signed.select("sig", "set_key", F.min("set_key").over(by_sig).alias("low"),
                                F.max("set_key").over(by_sig).alias("high")).where("low <> high").distinct()
        rounds.append(stages.table(crowded, f"groups-{part}"))
    groups = reduce(DataFrame.unionByName, rounds)

    def best(center: str) -> DataFrame:
        n = groups.where(F.col(center) != F.col("set_key")).groupBy("set_key", center).agg(F.count("*").alias("n"))
        top = n.groupBy("set_key").agg(F.max_by(center, F.struct("n", center)).alias("c"))
        return top.select(F.least("set_key", "c").alias("a"), F.greatest("set_key", "c").alias("b"))

    tried = stages.table(best("low").unionByName(best("high")).distinct(), "pairs")
    wanted = tried.select(F.col("a").alias("set_key")).unionByName(groups.select("set_key")).distinct().join(nodes, "set_key")
    texts = stages.table(_texts(known, wanted, size, percent), "texts")
    links = _links(tried, texts, size, percent, stages)
    comp = connected_components(links)

    more = stages.table(_resolve(groups, comp, texts, size, percent, stages), "links")
    final = connected_components(links.unionByName(more))

    ids = nodes.join(final.withColumnRenamed("node", "set_key"), "set_key")
    least = ids.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = ids.join(least, "component").select("set_key", "component_id")
    alone = nodes.join(named, "set_key", "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"))
    out = facts.join(stages.table(alone, "components"), "set_key", "left")
    stages.close(keep=("sets", "components"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None).cast("long"))
                      .when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without near-duplicates: of
    each component of rows one stays, that with the smallest doc_id (of several
    texts under it, the one with the smallest hash).  Rows count by doc_id and
    text, so different texts under one doc_id stand for themselves; equal rows
    of one doc_id and text stay once; texts without words, and rows without a
    doc_id, link with nothing.  Whole rows are shuffled once, by the hash that
    names them; equal rows meet there as well."""
    stages = Stages(docs.sparkSession)
    own = F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")))
    known = docs.where("doc_id IS NOT NULL")
    parts = jaccard_components(known.select(own.alias("doc_id"), "text"), size, percent).select(F.col("doc_id").alias("row"), "component_id")
    kept = (known.select("doc_id", own.alias("row")).join(parts.distinct(), "row")
            .groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("least")).select(F.col("least.row").alias("row")))
    kept = stages.table(kept.distinct(), "kept")
    name = "row" + "_" * max(len(c) for c in docs.columns)  # no other column's name
    dealt = known.withColumn(name, own).join(kept.withColumnRenamed("row", name), name, "left_semi")
    found = dealt.dropDuplicates([name, "doc_id", "text"]).select(*docs.columns)
    return found.unionByName(docs.where("doc_id IS NULL").dropDuplicates(["text"]))


CELL_ROWS = 256  # members of a family that meet in one task at a time (twice as many in a cell of two blocks)
CROWD_BITS = 18  # of a shingle hash, by which shingles are counted


def _crowds(size: int):
    """How many shingles of the task's sets start with the same bits."""
    def run(batches):
        n = np.zeros(1 << CROWD_BITS, np.int64)
        for b in batches:
            for _, buf, off in text_chunks(b.column("text")):
                n += np.bincount((shingle_sets(buf, off, size)[0] >> np.uint64(52 - CROWD_BITS)).astype(np.int64), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["crowd", "n"])
    return run


def _rare(size: int, percent: int, level: np.ndarray):
    """The rarest shingles of each set, so many that two similar sets have one in
    common: the rarest of all they share is among them in both.  Any order of
    all shingles serves; ``level`` has that of their first bits, then comes the hash."""
    def run(batches):
        for b in batches:
            for a, buf, off in text_chunks(b.column("text")):
                sets, sizes = shingle_sets(buf, off, size)
                most = sizes + -sizes * percent // 100 + 1  # percent of each set at least is common
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.argsort(owner * 64 + level[(sets >> np.uint64(52 - CROWD_BITS)).astype(np.int64)], kind="stable")
                place = np.arange(len(sets)) - (np.cumsum(sizes) - sizes)[owner]
                own = place < most[owner]
                part = b.select(["family", "node", "comp"]).slice(a, len(sizes)).take(pa.array(owner[own]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sets[order[own]].view(np.int64))],
                                                 ["family", "node", "comp", "shingle"])
    return run


def _families(edges: DataFrame, members: DataFrame, texts: DataFrame, size: int, percent: int, stages: Stages) -> DataFrame:
    """(node, component): components of the nodes that share signatures; one of
    more than CELL_ROWS nodes is cut into those that share a rare shingle, as
    texts with a common passage, more of them the larger the input, hang
    together by its signatures."""
    family = connected_components(edges)
    sizes = family.groupBy("component").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > CELL_ROWS).select(F.col("component").alias("family"))
    with stages.cleaning():
        if large.isEmpty():
            return family
    named = members.join(family.select("node", F.col("component").alias("family")), "node").join(large, "family")
    crowd = stages.table(named.join(texts.select("set_key", "text"), "set_key").select("family", "node", "comp", "text"), "crowd")
    counts = stages.table(crowd.select("text").mapInArrow(_crowds(size), "crowd long, n long").groupBy("crowd").agg(F.sum("n").alias("n")), "crowds")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / (1 << CROWD_BITS)
    level = np.zeros(1 << CROWD_BITS, np.uint8)
    for at, n in counts.where(F.col("n") > 4 * mean).collect():  # at most a quarter
        level[at] = min(63, int(np.log2(n / mean)))
    rare = crowd.mapInArrow(_rare(size, percent, level), "family long, node long, comp long, shingle long")
    by_shingle = Window.partitionBy("met")
    met = rare.select(F.xxhash64("family", "shingle").alias("met"), "node", "comp")
    met = met.select("node", F.min("node").over(by_shingle).alias("first"), F.min("comp").over(by_shingle).alias("c0"),
                     F.max("comp").over(by_shingle).alias("c1")).where("c0 <> c1").select(F.col("first").alias("a"), F.col("node").alias("b"))
    parts = connected_components(stages.table(met.distinct(), "met"))
    stages.drop("crowd", "crowds", "met")
    return family.join(large.withColumnRenamed("family", "component"), "component", "left_anti").select("node", "component") \
        .unionByName(parts)


def _resolve(groups: DataFrame, comp: DataFrame, texts: DataFrame, size: int, percent: int, stages: Stages) -> DataFrame:
    """Links between members of one signature group that lie in different
    components.  Such members form families (they share groups of
    one band, directly or in chains).  Members with fewer contested signatures
    of a band than they share with any similar set (``least``) are settled, and
    each member's ``least`` - 1 most frequent ones aren't needed.  Families are cut into blocks;
    each pair of blocks is one cell, tested in one task with one matrix product
    of memberships.  Cells return a spanning forest of what they link."""
    by_sig = Window.partitionBy("sig")

    def contested(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.min("comp").over(by_sig).alias("c0"), F.max("comp").over(by_sig).alias("c1")) \
            .where("c0 <> c1").drop("c0", "c1")

    lab = groups.select("sig", "set_key").join(
        comp.select(F.col("node").alias("set_key"), F.col("component").alias("comp")), "set_key", "left") \
        .withColumn("comp", F.coalesce("comp", "set_key")).withColumn("odd", F.col("sig").bitwiseAND(1))
    apart = stages.table(contested(lab), "apart")
    stages.drop(*[f"groups-{part}" for part in range(SIGN_PARTS)])
    for turn in range(2):  # rows that go may settle others
        shared = apart.groupBy("set_key", "odd").agg(F.count("*").alias("shared")) \
            .join(texts.select("set_key", "least_even", "least_odd"), "set_key") \
            .withColumn("least", F.when(F.col("odd") == 1, F.col("least_odd")).otherwise(F.col("least_even"))) \
            .where("shared >= least").select("set_key", "odd", "least", "shared")
        apart = stages.table(contested(apart.select("sig", "set_key", "comp", "odd").join(shared, ["set_key", "odd"])), f"apart-{turn}")
    # of two similar sets, the rarest common signature is not among the last least - 1 of either
    rare = Window.partitionBy("set_key", "odd").orderBy("crowd", "sig")
    apart = apart.withColumn("crowd", F.count("*").over(by_sig)).withColumn("place", F.row_number().over(rare)) \
        .withColumn("shared", F.count("*").over(Window.partitionBy("set_key", "odd"))).where("place <= shared - least + 1")
    apart = stages.table(contested(apart.select("sig", "comp", "set_key", "odd")).withColumn("node", F.xxhash64("set_key", "odd"))
                         .withColumn("first", F.min("node").over(by_sig)), "apart-rare")
    stages.drop("apart", "apart-0", "apart-1")
    members = apart.select("node", "set_key", "comp").distinct()
    family = stages.table(_families(apart.select(F.col("first").alias("a"), F.col("node").alias("b")), members, texts, size, percent, stages), "families")
    members = family.join(members, "node")
    blocks = family.groupBy("component").agg(F.ceil(F.count("*") / CELL_ROWS).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    cells = (members.join(blocks, "component").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
                     "set_key", "comp"))
    rows = cells.join(texts, "set_key").repartition("cell").sortWithinPartitions("cell")
    return rows.select("cell", "comp", "text").mapInArrow(_cell_links(size, percent), "a long, b long")


def _cell_links(size: int, percent: int):
    def test(sets: list[np.ndarray], comp: np.ndarray) -> list[tuple[int, int]]:
        m, n = len(sets), np.array([len(s) for s in sets])
        if m < 2:
            return []
        _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times > 1
        place = np.cumsum(shared) - 1
        use = shared[col]
        who, col = np.repeat(np.arange(m), n)[use], place[col[use]]
        both = np.zeros((m, m), np.float64)
        order = np.argsort(col, kind="stable")
        who, col = who[order], col[order]
        for c in range(0, int(shared.sum()), 4096):
            i, j = np.searchsorted(col, (c, c + 4096))
            has = np.zeros((m, 4096), np.float32)
            has[who[i:j], col[i:j] - c] = 1
            both += has @ has.T
        linked = np.triu(both * 100 >= percent * (n[:, None] + n[None, :] - both), 1) & (comp[:, None] != comp[None, :])
        x, y = np.nonzero(linked & (both > 0))
        return spanning_forest(comp[x], comp[y])

    def run(batches):
        cell, sets, comps = None, [], []
        for b in batches:
            keys = b.column("cell").to_numpy()
            comp = b.column("comp").to_numpy()
            for a, buf, off in text_chunks(b.column("text")):
                got, sizes = shingle_sets(buf, off, size)
                for k, s in enumerate(np.split(got, np.cumsum(sizes)[:-1])):
                    if keys[a + k] != cell:
                        found = test(sets, np.array(comps))
                        if found:
                            yield _pairs(found)
                        cell, sets, comps = keys[a + k], [], []
                    sets.append(s)
                    comps.append(comp[a + k])
        found = test(sets, np.array(comps))
        if found:
            yield _pairs(found)

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())],
                                      ["a", "b"])


def _texts(known: DataFrame, wanted: DataFrame, size: int, percent: int) -> DataFrame:
    """One text for each wanted set, taken from its smallest document, and the
    fewest signatures it shares with a similar one.  Rows that merely repeat
    the document's id with another text are left out."""
    rows = known.join(wanted.select(F.col("rep").alias("doc_id"), "set_key"), "doc_id").select("set_key", "text")

    def run(batches):
        for b in batches:
            for a, buf, off in text_chunks(b.column("text")):
                sets, sizes = shingle_sets(buf, off, size)
                part = b.slice(a, len(sizes))
                same = _set_keys(sets, sizes) == part.column("set_key").to_numpy()
                own, following = (signatures(sets, sizes, percent, shift)[2] for shift in (0, 1))
                odd = np.searchsorted(size_bands(int(sizes.max(initial=1)), percent), sizes) % 2 == 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("set_key"), part.column("text"), pa.array(np.where(odd, following, own)),
                     pa.array(np.where(odd, own, following))], ["set_key", "text", "least_even", "least_odd"]).filter(pa.array(same))

    return rows.mapInArrow(run, "set_key long, text string, least_even long, least_odd long")
