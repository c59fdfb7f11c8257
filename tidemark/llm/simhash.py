"""SimHash near-dedup by covering locality-sensitive hashing.

Every position of a sketch gets a code of r + 1 bits, spread evenly over the codes that aren't zero. For each non-zero
v of r + 1 bits, mask v holds the positions whose code has an odd inner product with v. Any r positions have codes that
some v is orthogonal to, so the sketches of every pair that differ in at most r positions agree on some mask: no such
pair is missed.

``near_groups`` covers the 64 bits of a SimHash with radius 2. Distinct fingerprints that agree on a mask form a bucket.
Buckets of up to ``SMALL`` are compared pair by pair in memory and give a forest of their links. Larger ones are never
paired: two fingerprints are within 2 bits exactly if some value is within 1 bit of both, so each is listed under itself
and its neighbours of one bit (outside the mask); a listing has 65 members at most. The rows grow in proportion to the
fingerprints.

``without_near_copies`` has a similarity of shingle sets to meet instead. Two texts with a Jaccard similarity of 0.8
differ in about 10 of 64 SimHash bits, and covering that radius would take 2,047 tables. So its sketches are groups of
``POSITIONS`` minwise hashes, of which such texts differ in 1.4 of 7: the same masks with radius 2 then hold four of the
seven, and seven tables a group find a pair that differs in up to two positions, and some of the others. All pairs that
share a bucket are compared by their whole shingle sets, and only those that are alike are linked.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_schema, blank_words, map_rows, schema_of, values, written
from tidemark.llm.components import components

BITS = 64
RADIUS = 2
SMALL = 64
SEED = 42
#: Up to so many numbers of rows that go are sent to every task (some 30 MB there); more are joined.
SENT_ROWS = 1_000_000
BUCKET = ["t", "key"]
EDGE = "u bigint, v bigint"
#: Minwise hashes of a group, and groups of a sketch: at a similarity of 0.8 one group finds 87 % of pairs, two 98 %.
POSITIONS, GROUPS = 7, 2
ALIKE = 0.8
#: Members of a bucket, and bytes of their shingle sets, that one task compares with each other; larger buckets are cut
#: into blocks of about so many, and any two blocks meet in a task of their own (a member of a bucket of m goes to
#: m / BLOCK tasks).
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Small buckets are handed to a task in packs of about so many members and bytes.
PACK, PACK_BYTES = 2048, 4 << 20


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(words: list[bytes], shingle: int) -> list[int]:
    """XXH64 of each run of ``shingle`` words, joined by blanks; of the whole sequence if it is shorter; none without words."""
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(b" ".join(words), SEED)]
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    return [digest(text[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)]


def remixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of each hash: the finalizer of splitmix64, with wrap-around arithmetic; seed 0 leaves them."""
    if not seed:
        return h
    with np.errstate(over="ignore"):
        h = h + np.uint64((0x9E3779B97F4A7C15 * seed) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes (repeats count); zero for none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # the unpacked bits of a very long text stay small
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, keep: list[str], text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The columns ``keep`` with ``fp``, the fingerprint as a long. Null and empty texts have zero."""
    out = schema_of(docs, *keep, more="fp bigint")
    read = text_col if text_col in keep else "__text"

    def make():
        def fn(batch):
            fps = []
            for text in values(batch.column(read), binary=True):
                fps.append(signed(majority(np.array(shingle_hashes(blank_words(text), shingle), dtype=np.uint64))))
            return {k: batch.column(k) for k in keep} | {"fp": fps}

        return fn

    return map_rows(docs.select(*keep, *([] if read in keep else [F.col(text_col).cast("string").alias(read)])), make, out)


def bucket_forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (by index) that connect what pairs within ``radius`` connect."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    root, out = list(range(len(fps))), []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True):
        while root[i] != i:
            i = root[i]
        while root[j] != j:
            j = root[j]
        if i != j:
            root[max(i, j)] = min(i, j)
            out.append((i, j))
    return out


def buckets(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints ``fp`` with an ``id``, once for each table ``t`` in which they share their bucket ``key``:
    with ``n``, the bucket's size."""
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks())]))
    placed = nodes.select("fp", "id", table.alias("b")).select("fp", "id", "b.t", "b.key")
    counts = placed.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return written(placed.join(counts, BUCKET), "simhash-buckets")


def links(placed: DataFrame) -> DataFrame:
    """Edges ``u, v`` of ids whose components are those of all pairs within ``RADIUS`` bits, of fingerprints in ``buckets``."""
    spark, own = placed.sparkSession, masks()
    small = placed.where(F.col("n") <= SMALL).groupBy(BUCKET).agg(F.collect_list(F.struct("fp", "id")).alias("m"))
    small = small.select(F.col("m.fp").alias("fps"), F.col("m.id").alias("ids"))

    def make():
        import pyarrow as pa

        def fn(batch):
            u, v = [], []
            for fps, ids in zip(values(batch.column("fps")), values(batch.column("ids")), strict=True):
                for i, j in bucket_forest(np.array(fps, dtype=np.int64).view(np.uint64), RADIUS):
                    u.append(ids[i])
                    v.append(ids[j])
            return {"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())}

        return fn

    in_small = map_rows(small, make, T._parse_datatype_string(EDGE))
    free = spark.createDataFrame([(t, [signed(1 << i) for i in range(BITS) if not m >> i & 1]) for t, m in enumerate(own)], "t int, flips array<bigint>")
    listed = placed.where(F.col("n") > SMALL).join(F.broadcast(free), "t")  # one row a mask
    listed = listed.select("t", "fp", "id", F.explode(F.concat(F.array(F.lit(0).cast("bigint")), "flips")).alias("flip"))
    listed = listed.select("id", "t", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    in_large = listed.select(F.col("id").alias("u"), F.min("id").over(Window.partitionBy("t", "z")).alias("v")).where("u != v").distinct()
    return in_small.unionByName(in_large)


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id_col, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links of at most 2 bits.

    Null and texts without words have fingerprint zero and are linked like any other. Rows with a null id belong to
    their group and don't name it (a group of only such rows has a null component). Repeated rows share a group. Very
    long texts are hashed whole. An empty table gives no rows.
    """
    rows = written(fingerprints(docs.select(F.col(id_col), F.col(text_col)), keep=[id_col], text_col=text_col, shingle=shingle), "simhash-rows")
    # a node stands for the rows with the same fingerprint
    nodes = written(rows.groupBy("fp").agg(F.min(id_col).alias("least")).withColumn("id", F.col("fp")), "simhash-nodes")
    of_node = _components(nodes, links(buckets(nodes.select("fp", "id"))), ["fp"])
    out = rows.join(of_node, "fp", "left")
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _components(nodes: DataFrame, edges: DataFrame, same: list[str]) -> DataFrame:
    """``same`` of each node (``id``) and ``component_id``, the smallest ``least`` of the nodes that edges reach."""
    found = components(edges)
    least = nodes.join(found.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(least.join(of_root, "root").select(*same, "component_id"), "simhash-components")


# --- by the similarity of shingle sets


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    return np.unique(np.array(shingle_hashes(blank_words(text), shingle), dtype=np.uint64))


def minwise(hashes: list[np.ndarray], positions: int) -> np.ndarray:
    """The smallest of each set's hashes under each of ``positions`` remixings; sets must not be empty."""
    every, starts = np.concatenate(hashes), np.cumsum([0, *(len(h) for h in hashes[:-1])])
    return np.stack([np.minimum.reduceat(remixed(every, k + 1), starts) for k in range(positions)], axis=1)


def covering_keys(sketches: np.ndarray) -> np.ndarray:
    """For each row of minwise hashes, a key for each group and mask: a hash of the positions that the mask holds."""
    keys = []
    for group in range(sketches.shape[1] // POSITIONS):
        own = sketches[:, group * POSITIONS : (group + 1) * POSITIONS]
        for t, mask in enumerate(masks(RADIUS, POSITIONS)):
            key = np.full(len(own), group * 64 + t + 1, dtype=np.uint64)
            for i in range(POSITIONS):
                if mask >> i & 1:
                    key = remixed(key ^ own[:, i], i + 1)
            keys.append(key)
    return np.stack(keys, axis=1)


def sketched(docs: DataFrame, *, keep: list[str], text_col: str, shingle: int) -> DataFrame:
    """The columns ``keep`` with ``s1, s2`` (128 bits that name the shingle set) and ``keys`` (none without words)."""
    out = schema_of(docs, *keep, more="s1 bigint, s2 bigint, keys array<bigint>")
    read = text_col if text_col in keep else "__text"

    def make():
        def fn(batch):
            n = batch.num_rows
            names, keys, sets, of = np.zeros((n, 2), dtype=np.int64), [[] for _ in range(n)], [], []

            def flush():
                if sets:
                    for k, own in zip(of, covering_keys(minwise(sets, GROUPS * POSITIONS)).view(np.int64).tolist(), strict=True):
                        keys[k] = own
                    sets.clear()
                    of.clear()

            held = 0
            for k, text in enumerate(values(batch.column(read), binary=True)):
                own = shingle_set(text, shingle)
                names[k] = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype=np.int64)
                if len(own):
                    sets.append(own)
                    of.append(k)
                    held += len(own)
                if held > 1 << 17:
                    flush()
                    held = 0
            flush()
            return {k: batch.column(k) for k in keep} | {"s1": names[:, 0].tolist(), "s2": names[:, 1].tolist(), "keys": keys}

        return fn

    return map_rows(docs.select(*keep, *([] if read in keep else [F.col(text_col).cast("string").alias(read)])), make, out)


def with_sets(docs: DataFrame, *, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id_col``, ``set`` (32 bits of the hashes of the distinct shingles, sorted) and its ``bytes``."""
    out = schema_of(docs, id_col, more="set binary, bytes bigint")

    def make():
        def fn(batch):
            sets = [np.unique((shingle_set(t, shingle) >> np.uint64(32)).astype("<u4")).tobytes() for t in values(batch.column(text_col), binary=True)]
            return {id_col: batch.column(id_col), "set": sets, "bytes": [len(x) for x in sets]}

        return fn

    return map_rows(docs.select(id_col, text_col), make, out)


def alike_forest(sets: list[np.ndarray], least: float = ALIKE) -> list[tuple[int, int]]:
    """Links (by index) that connect what pairs with a Jaccard similarity of ``least`` or more connect: each set that is
    reached is compared with all that aren't yet."""
    sizes = np.array([len(s) for s in sets])
    out, left = [], np.arange(len(sets))
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            i = reached.pop()
            n, own = sizes[i], sets[i]
            may = left[(sizes[left] >= least * n) & (n >= least * sizes[left])]
            if not len(may):
                continue
            every = np.concatenate([sets[j] for j in may])
            place = np.minimum(np.searchsorted(own, every), n - 1)
            shared = np.add.reduceat(own[place] == every, np.cumsum(sizes[may]) - sizes[may], dtype=np.int64)
            new = may[shared >= least * (n + sizes[may] - shared)]
            out += [(i, j) for j in new.tolist()]
            reached += new.tolist()
            left = left[~np.isin(left, new, assume_unique=True)]
    return out


def candidates(nodes: DataFrame) -> DataFrame:
    """``key, id`` of nodes ``(id, keys)`` that share a bucket; of buckets with the same members one is kept."""
    placed = nodes.select("id", F.explode("keys").alias("key"))
    h = F.xxhash64("id")
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("a"), F.bit_xor(h).alias("b")).where("n > 1")
    kept = written(shared.groupBy("n", "a", "b").agg(F.min("key").alias("key")).select("key"), "near-buckets")
    return written(placed.join(kept, "key"), "near-members")


def alike(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges ``u, v`` of bucket members ``(key, id)`` with ``sets (id, set, bytes)``, whose components are those of all
    pairs that share a bucket and have a similarity of ``least`` or more."""
    import pyarrow as pa

    arrow = arrow_schema(EDGE)
    sizes = members.join(sets.select("id", "bytes"), "id").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    few = (F.col("n") <= SMALL) & (F.col("bytes") <= PACK_BYTES)
    sizes = written(sizes.select("key", "n", "bytes", F.when(~few, blocks).alias("blocks")), "near-sizes")
    total = sizes.where("blocks IS NULL").agg(F.sum("n"), F.sum("bytes")).first()
    packs = max((total[0] or 0) // PACK, (total[1] or 0) // PACK_BYTES) + 1
    own = F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.lit(0))
    pack = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("key"), F.lit(packs))).otherwise(F.col("key"))
    dealt = members.join(sizes.select("key", "blocks"), "key").select("id", "key", pack.alias("pack"), F.col("blocks").isNull().alias("few"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other"))
    dealt = dealt.join(sets.select("id", "set"), "id").select("few", "pack", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "key", "id", "set")

    def run(group):
        group = group.sort_by("key")
        keys, ids = group.column("key").to_numpy(), group.column("id").to_numpy()
        every = [np.frombuffer(x, dtype="<u4") for x in group.column("set").to_pylist()]
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        pairs = [(a + i, a + j) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) for i, j in alike_forest(every[a:b], least)]
        pairs = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return pa.table([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], schema=arrow)

    return dealt.groupBy("few", "pack", "p", "q").applyInArrow(run, EDGE)


def without_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = ALIKE) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id (rows without one come last).

    Two texts are linked if their sets of ``shingle``-word shingles have a Jaccard similarity of ``least`` or more and
    their sketches share a bucket; links are transitive, so texts that aren't alike themselves may be in one group.
    A text of fewer words is one shingle, rows without words (null, empty, blank) form one group, equal texts share
    theirs. Very long texts count whole. Extra columns pass through; an empty table stays empty.
    """
    own = [f"k_{c}" for c in docs.columns]
    text, name = f"k_{text_col}", F.col(f"k_{id_col}")
    numbered = docs.toDF(*own).withColumn("__rid", F.monotonically_increasing_id())
    rows = written(sketched(numbered, keep=[*own, "__rid"], text_col=text, shingle=shingle), "near-texts")
    order = F.struct(name.isNull().alias("none"), name.alias("id"), F.col("__rid").alias("rid"))
    # a node stands for the rows with the same set of shingles
    same = ["s1", "s2"]
    nodes = rows.select(*same, "keys", order.alias("__order")).groupBy(*same, "keys").agg(F.min("__order").alias("least"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "near-nodes")
    members = candidates(nodes.select("id", "keys"))
    asked = written(nodes.join(members.select("id").distinct(), "id", "left_semi").select("id", F.col("least.rid").alias("__rid")), "near-asked")
    texts = rows.select("__rid", text).join(_sent(asked), "__rid").select("id", text)
    sets = written(with_sets(texts, id_col="id", text_col=text, shingle=shingle), "near-sets")
    edges = alike(members.select("key", "id"), sets, least)
    of_node = _components(nodes, edges, same)
    gone = rows.join(of_node, same).where(order != F.col("component_id")).select("__rid")
    return rows.join(_sent(written(gone, "near-gone")), "__rid", "left_anti").select(*own).toDF(*docs.columns)


def _sent(few: DataFrame) -> DataFrame:
    """Row numbers, of which few are sent to every task: then the texts needn't be shuffled."""
    return F.broadcast(few) if few.count() <= SENT_ROWS else few


def op4_covering(docs: DataFrame) -> DataFrame:
    return near_groups(docs)
