"""Near-duplicate documents by b-bit MinHash.

1. One pass hashes every document's shingles and, per document, keeps the minima of
   `BANDS * ROWS` permutations: the keys of `BANDS` bands and the low `BITS` bits of all minima,
   packed into bytes.  Documents with equal shingle sets fall together first, so only one of a
   group of copies goes on.
2. Band buckets with two documents or more yield candidates as stars: every member against the
   bucket's hub, never all pairs.  Packed signatures are compared by counting equal fields of
   their XOR, the agreement is corrected for the 2**-BITS of chance collisions, and pairs clearly
   below the threshold go.  The rest are confirmed on full shingle sets.
3. Buckets that still hold more than one component may hide links between two members that are
   not the hub.  Their documents are dealt into blocks of bounded size, and the members outside
   each cluster's largest component meet every block, again on full sets, skipping what is
   connected by then.  Nothing is capped: a large cluster is more blocks.

The chance that a pair at the threshold shares no band is (1 - 0.8**5)**40, about 1e-7.

Edge cases: null or empty texts have an empty set, are linked with nothing and are kept; fewer
words than a shingle are one shingle; rows that repeat a doc_id are one document, which is linked
with whatever one of its texts is linked with; a row with a null doc_id belongs to the documents with
an equal set, or else is kept with a null component; other columns pass through in `near_dedup`,
whatever their names, and are ignored in `near_groups`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .staging import read_table, ship_code, staged
from .wordhash import U64, mix, pieces, random_odd, signed, split_words, window_hashes

ROWS, BANDS, BITS = 5, 40, 8
N = ROWS * BANDS
#: Standard deviations of the estimate by which a pair may fall short and still be confirmed.
SLACK = 4.5
#: Shingles of one side of a block of full sets.
BLOCK_SHINGLES = 250_000


def shingles(texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after the other, and their offsets."""
    words = split_words(texts, lower=True)
    out, at = [], [0]
    windows = window_hashes(words.hashes, k) if k > 1 else words.hashes
    for a, z in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if z - a >= k:
            own = np.unique(windows[a : z - k + 1])
        elif z > a:
            own = mix(np.bitwise_xor.reduce(mix(words.hashes[a:z] + np.arange(1, z - a + 1, dtype=U64)), keepdims=True) ^ U64(z - a))
        else:
            own = windows[:0]
        out.append(own)
        at.append(at[-1] + len(own))
    return np.concatenate(out) if out else np.zeros(0, U64), np.array(at)


_A = (random_odd(N, 3) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = random_odd(N, 5).astype(np.uint32)


def signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets, at = shingles(batch.column(1), k)
            n = batch.num_rows
            size = np.diff(at)
            full = np.flatnonzero(size)
            low = mix(sets).astype(np.uint32)
            minima = np.zeros((N, len(full)), np.uint32)
            if len(full):
                starts, value = at[full], np.empty_like(low)
                for j in range(N):
                    np.multiply(low, _A[j], out=value)
                    np.add(value, _B[j], out=value)
                    minima[j] = np.minimum.reduceat(value, starts)
            keys = np.zeros((BANDS, len(full)), U64)
            for b in range(BANDS):
                key = np.full(len(full), b + 1, U64)
                for j in range(b * ROWS, b * ROWS + ROWS):
                    key = mix(key * U64(0x9E3779B97F4A7C15) + minima[j])
                keys[b] = key
            packed = (minima & np.uint32(2**BITS - 1)).astype(np.uint8).T.copy()
            total = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets ^ U64(s)), dtype=U64)]) for s in (1, 2)]
            set1, set2 = (mix(t[at[1:]] - t[at[:-1]] + size.astype(U64)) for t in total)
            bands, sign = [None] * n, [None] * n
            for i, d in enumerate(full.tolist()):
                bands[d], sign[d] = signed(keys[:, i].copy()), packed[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size.astype(np.int64)), pa.array(signed(set1)), pa.array(signed(set2)), pa.array(bands, pa.list_(pa.int64())), pa.array(sign, pa.binary())], names=["doc_id", "of_text", "n_shingles", "set1", "set2", "bands", "packed"])

    return run


def estimate(packed_a: pa.Array, packed_b: pa.Array) -> np.ndarray:
    """Similarity of packed signatures: agreeing fields, less the share that agrees by chance."""
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), N) for x in (packed_a, packed_b))
    same = np.count_nonzero((a ^ b) == 0, axis=1) / N
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(estimate(batch.column(2), batch.column(3)))], names=["a", "b", "similarity"])


def confirm_pairs(k: int, percent: int):
    """Rows a, b, text_a, text_b: those whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text_a"):
            (sa, ia), (sb, ib) = shingles(batch.column(2), k), shingles(batch.column(3), k)
            both = np.concatenate([sa, sb])
            doc = np.concatenate([np.repeat(np.arange(len(ia) - 1), np.diff(ia)), np.repeat(np.arange(len(ib) - 1), np.diff(ib))])
            order = np.lexsort((both, doc))
            both, doc = both[order], doc[order]
            twice = (both[1:] == both[:-1]) & (doc[1:] == doc[:-1])
            common = np.bincount(doc[1:][twice], minlength=batch.num_rows)
            ok = 100 * common >= percent * (np.diff(ia) + np.diff(ib) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return run


def link_block(k: int, percent: int):
    """One group: queries (side 0) against candidates (side 1) of one cluster; spanning links only."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table["side"].to_numpy()
        sets, at = [], [0]
        for batch in pieces(table.select(["doc", "text"]).to_batches()):
            own, cut = shingles(batch.column(1), k)
            sets.append(own)
            at.extend((cut[1:] + at[-1]).tolist())
        sets, at = np.concatenate(sets), np.array(at)
        doc, part = table["doc"].to_numpy(), table["part"].to_numpy()
        size = np.diff(at)
        root = {int(p): int(p) for p in np.unique(part)}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        other = np.flatnonzero(side == 1)
        _, code = np.unique(sets, return_inverse=True)
        owner = np.repeat(np.arange(len(doc)), size)
        of_other = side[owner] == 1
        order = np.argsort(code[of_other], kind="stable")
        posting = owner[of_other][order]
        begin = np.searchsorted(code[of_other][order], np.arange(code.max() + 2 if len(code) else 1))
        a, b = [], []
        for q in np.flatnonzero(side == 0).tolist():
            mine = code[at[q] : at[q + 1]]
            low, long = begin[mine], begin[mine + 1] - begin[mine]
            total = int(long.sum())
            if not total:
                continue
            where = np.arange(total) - np.repeat(np.cumsum(long) - long, long) + np.repeat(low, long)
            common = np.bincount(posting[where], minlength=len(doc))[other]
            for x in other[(100 * common >= percent * (size[q] + size[other] - common)) & (part[other] != part[q])].tolist():
                p, r = find(int(part[q])), find(int(part[x]))
                if p != r:
                    root[max(p, r)] = min(p, r)
                    a.append(int(doc[q]))
                    b.append(int(doc[x]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for every input row."""
    ship_code(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("of_text"))
    signs = staged(rows.mapInArrow(signatures(k), "doc_id long, of_text long, n_shingles long, set1 long, set2 long, bands array<long>, packed binary"), "op2-signs")
    # every set is a node, whatever documents hold it; its text is that of one row, its signature that of all of them
    sets = signs.where("doc_id is not null and n_shingles > 0").groupBy("set1", "set2")
    one = sets.agg(F.min(F.struct("doc_id", "of_text")).alias("x"), F.max("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("packed").alias("packed"))
    one = staged(one.select("set1", "set2", F.col("x.doc_id").alias("first"), F.col("x.of_text").alias("of_text"), "size", "bands", "packed", F.monotonically_increasing_id().alias("doc")), "op2-sets")  # joined from an exchange of its own, so that a hot set can be split
    classes = staged(signs.select("doc_id", "n_shingles", "set1", "set2").join(one.select("set1", "set2", "doc"), ["set1", "set2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("doc")).alias("doc")), "op2-classes")
    nodes = one.select(F.col("first").alias("doc_id"), "of_text", "doc")
    # the texts of a repeated id are one document
    several = classes.where("doc_id is not null and doc is not null").groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z")
    same_id = classes.where("doc is not null").join(several.select("doc_id", "a"), "doc_id").where("a < doc").select("a", F.col("doc").alias("b")).distinct()

    members = one.select("doc", F.explode("bands").alias("key"))
    hubs = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc", "key").alias("h"), F.col("doc").alias("hub"))).alias("low"), F.min("doc").alias("d0"), F.max("doc").alias("d1")).where("d0 < d1")
    member_hub = staged(members.join(hubs.select("key", "low.hub"), "key").select("key", "doc", "hub"), "op2-hubs")

    # Texts of the candidates only, from one exchange of the table.
    wanted = nodes.join(member_hub.select("doc").distinct(), "doc")
    candidates = staged(rows.where("doc_id is not null and text is not null").join(wanted, ["doc_id", "of_text"]).groupBy("doc").agg(F.min("text").alias("text")), "op2-texts")
    pairs = member_hub.where("doc <> hub").select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()
    pairs = pairs.join(one.select(F.col("doc").alias("a"), F.col("packed").alias("pa")), "a").join(one.select(F.col("doc").alias("b"), F.col("packed").alias("pb")), "b")
    s = percent / 100
    least = s - SLACK * (s * (1 - s) / N) ** 0.5
    likely = pairs.select("a", "b", "pa", "pb").mapInArrow(estimates, "a long, b long, similarity double").where(F.col("similarity") >= least).select("a", "b")
    text = lambda x: candidates.select(F.col("doc").alias(x), F.col("text").alias(f"text_{x}"))
    links = staged(likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(confirm_pairs(k, percent), "a long, b long"), "op2-links")

    found = components(links)
    labelled = staged(member_hub.select("key", "doc").join(found.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("part")), "op2-parts")
    more = _links_between_parts(labelled, candidates, one.select("doc", "size"), k, percent)
    found = components(links.unionByName(more).unionByName(same_id))
    # a component is named by the least id in it
    least = found.join(one.select(F.col("doc").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    linked = found.join(least, "component").select(F.col("node").alias("doc"), "least")
    named = staged(one.select("doc", "first").join(linked, "doc", "left").select("doc", F.coalesce("least", "first").alias("name")), "op2-names")
    out = classes.join(named, "doc", "left")
    component = F.coalesce("name", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _links_between_parts(labelled: DataFrame, candidates: DataFrame, sizes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components that share a bucket, from blocks of full sets."""
    split = labelled.groupBy("key").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 < p1")
    touching = labelled.join(split.select("key", "p0"), "key").where("part <> p0").select(F.col("part").alias("a"), F.col("p0").alias("b")).distinct()
    cluster = components(touching).select(F.col("node").alias("part"), F.col("component").alias("cluster"))
    docs = labelled.select("doc", "part").distinct().join(cluster, "part")
    docs = docs.join(sizes, "doc")
    by_part = docs.groupBy("cluster", "part").agg(F.sum("size").alias("size"))
    by_cluster = by_part.groupBy("cluster").agg(F.max(F.struct("size", "part")).alias("most"), F.sum("size").alias("all"))
    plan = by_cluster.select("cluster", F.col("most.part").alias("main"), F.ceil(F.col("all") / BLOCK_SHINGLES).cast("int").alias("n_all"), F.ceil((F.col("all") - F.col("most.size")) / BLOCK_SHINGLES).cast("int").alias("n_few"))
    placed = staged(docs.join(plan, "cluster").select("cluster", "doc", "part", "n_all", "n_few", (F.col("part") != F.col("main")).alias("few"), F.pmod(F.xxhash64("doc"), "n_all").cast("int").alias("block"), F.expr("if(part = main, -1, cast(pmod(xxhash64(doc, 7), n_few) as int))").alias("few_block")), "op2-blocks")
    queries = placed.where("few").select("cluster", "doc", "part", F.lit(0).alias("side"), F.col("few_block").alias("i"), F.explode(F.expr("sequence(0, n_all - 1)")).alias("j"))
    others = placed.select("cluster", "doc", "part", F.lit(1).alias("side"), F.explode(F.expr("sequence(0, n_few - 1)")).alias("i"), F.col("block").alias("j"))
    sides = queries.unionByName(others).join(candidates, "doc").select("cluster", "i", "j", "side", "doc", "part", "text")
    return staged(sides.groupBy("cluster", "i", "j").applyInArrow(link_block(k, percent), "a long, b long"), "op2-more")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The input rows (all columns) of one document of each group: the smallest doc_id; of rows that repeat it, all.

    A row whose component is named by another document goes, so a copy of a document that stays never does.
    """
    name = next(n for n in (f"__kept{i}" for i in range(len(docs.columns) + 1)) if n not in {c.lower() for c in docs.columns})
    kept = near_groups(docs, k, percent).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col(name)), "left_semi")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, four-word shingles, similarity 0.8."""
    return near_groups(read_table(spark, sf_dir, "documents"), k=4, percent=80)
