"""MinHash near-dedup by a multi-index Hamming join.

1. A document becomes a set of 5-word shingles and, of it, a signature of CHUNKS * CHUNK b-bit MinHash values. Documents with
   equal sets form a class; one of a class, its smallest id, goes on.
2. The signature distance is the number of differing values. By the pigeonhole rule, two signatures at distance at most
   CHUNKS * (ERRORS + 1) - 1 have a chunk with at most ERRORS differing values. All ways to have them are enumerated: for each
   chunk and each choice of ERRORS positions left out, the remaining values are a key. So every pair within that distance
   shares a key. At similarity 0.85 a pair is beyond it, in all chunks, with probability 0.224 ** 8 = 6e-6.
3. The smallest node in a key's bucket leads it. All documents that share a leader form a family: two documents of one bucket
   are in the family of its leader. Rows grow with links to leaders, not with pairs.
4. Each member of a family is first compared with the leader, on full sets. Members that pass are joined by that alone, so they
   are not compared with each other. The rest is dealt into blocks of bounded size, and every pair of blocks of which one is of
   the rest goes to one group, which counts the intersections of full sets (a matrix product for shingles that many hold,
   posting lists for the rest) and emits a spanning forest of the pairs that pass. So no pair is written out, and none that may
   join two trees is left unchecked.
5. Components of the forests, then back to classes and rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix, shingle_set, stored, task_count, text_hashes
from .components import components

WORDS = 5
CHUNKS, CHUNK, ERRORS = 8, 6, 1
BITS = 16
#: Links need PER_CENT_A * intersection >= PER_CENT_B * union.
SIMILARITY = (100, 85)
#: A block of a family: so many documents and shingles at most (a longer document is a block of its own).
BLOCK_DOCS, BLOCK_SHINGLES = 768, 400_000
#: 64-bit words of the filter that keeps texts that nothing compares out of the shuffle.
FILTER_WORDS = 1 << 20

SKETCH = "doc_id long, tie long, n_shingles long, set_id binary, signature binary"


def _permutations(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))[:, None]


def signature(shingles: np.ndarray, values: int = CHUNKS * CHUNK) -> np.ndarray:
    """The low BITS bits of the MinHash of each of `values` hash functions (a multiply and xor of the 64-bit shingle hashes)."""
    keys = _permutations(values)
    low = np.full(values, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = (shingles[None, at : at + 2048] ^ keys) * np.uint64(0x9FB21C651E98DF25)
        part ^= part >> np.uint64(32)
        low = np.minimum(low, part.min(axis=1))
    return (mix(low) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def set_id(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set: a sum and an xor of mixed members, with the size mixed in."""
    m = mix(shingles + np.uint64(0x632BE59BD9B4E019))
    return (m.sum(dtype=np.uint64) + np.uint64(len(m))).tobytes() + np.bitwise_xor.reduce(mix(m)).tobytes()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hash_words()
    for batch in batches:
        sizes, names, signatures = [], [], []
        for text in batch.column(2):
            shingles = shingle_set(text_hashes(text.as_py()), WORDS)
            sizes.append(len(shingles))
            names.append(set_id(shingles) if len(shingles) else None)
            signatures.append(signature(shingles).tobytes() if len(shingles) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "tie", "n_shingles", "set_id", "signature"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, signature) -> (key, doc_id): for each chunk, each choice of values left out."""
    kept = [[p for p in range(CHUNK) if p not in out] for out in combinations(range(CHUNK), ERRORS)]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, CHUNKS, CHUNK).astype(np.uint64)
        ids = np.asarray(batch.column(0))
        keys = []
        for c in range(CHUNKS):
            for k, places in enumerate(kept):
                h = np.full(n, c * len(kept) + k + 1, np.uint64)
                for p in places:
                    h = mix(h * np.uint64(0x2545F4914F6CDD1D) + values[:, c, p])
                keys.append(h)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(ids, len(keys)))], ["key", "doc_id"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, as a symmetric matrix."""
    n = len(sets)
    member, owner = np.concatenate(sets), np.repeat(np.arange(n, dtype=np.int64), [len(s) for s in sets])
    _, member, often = np.unique(member, return_inverse=True, return_counts=True)
    total = np.zeros((n, n), np.float32)
    common = often >= max(8, n // 64)
    column, at = np.cumsum(common) - 1, common[member]
    columns, owners = column[member[at]], owner[at]
    order = np.argsort(columns, kind="stable")
    columns, owners = columns[order], owners[order]
    for left in range(0, int(common.sum()), 2048):
        a, b = np.searchsorted(columns, (left, left + 2048))
        part = np.zeros((n, 2048), np.float32)
        part[owners[a:b], columns[a:b] - left] = 1
        total += part @ part.T
    rare = ~at & (often[member] > 1)
    order = np.argsort(member[rare], kind="stable")
    m, d = member[rare][order], owner[rare][order]
    for step in range(1, len(m)):  # holders of a rare member stand together; at most max(8, n // 64) of them
        same = m[step:] == m[:-step]
        if not same.any():
            break
        np.add.at(total, (d[:-step][same], d[step:][same]), 1)
        np.add.at(total, (d[step:][same], d[:-step][same]), 1)
    return total


def forest(ids: np.ndarray, sets: list[np.ndarray], sides: np.ndarray) -> list[tuple[int, int]]:
    """Links (smallest id of its tree, id) of a spanning forest over the pairs that reach SIMILARITY. Pairs of one side are left out where there are two."""
    total = intersections(sets)
    size = np.array([len(s) for s in sets], np.float64)
    a, b = SIMILARITY
    linked = a * total.astype(np.float64) >= b * (size[:, None] + size[None, :] - total)
    if sides.any() and not sides.all():
        linked &= sides[:, None] != sides[None, :]
    np.fill_diagonal(linked, False)
    todo = np.ones(len(ids), bool)
    out = []
    for start in range(len(ids)):
        if not todo[start]:
            continue
        tree, edge = [start], np.zeros(len(ids), bool)
        edge[start] = True
        todo[start] = False
        while edge.any():
            reached = linked[edge].any(axis=0) & todo
            todo &= ~reached
            tree += np.flatnonzero(reached).tolist()
            edge = reached
        if len(tree) > 1:
            low = int(ids[tree].min())
            out += [(low, int(ids[t])) for t in tree if ids[t] != low]
    return out


def alike(common: int, a: int, b: int) -> bool:
    """Whether sets of these sizes, with so many members in common, reach SIMILARITY."""
    return SIMILARITY[0] * common >= SIMILARITY[1] * (a + b - common)


def _against_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (leader, salt), the leader's own first -> (leader, node, linked) for each other row."""
    hash_words()
    group, lead = None, np.empty(0, np.uint64)
    for batch in batches:
        out: list[tuple[int, int, bool]] = []
        for leader, salt, node, text in zip(*(batch.column(k) for k in range(4)), strict=True):
            shingles = shingle_set(text_hashes(text.as_py()), WORDS)
            leader, salt, node = leader.as_py(), salt.as_py(), node.as_py()
            if (leader, salt) != group:
                group, lead = (leader, salt), shingles
            else:
                common = len(np.intersect1d(lead, shingles, assume_unique=True))
                out.append((leader, node, alike(common, len(lead), len(shingles))))
        kinds = (pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[k]) for k in range(3)], ["leader", "node", "linked"])


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (leader, left, right) -> links. A group holds two blocks at most."""
    hash_words()
    group, ids, texts, sides = None, [], [], []
    links: list[tuple[int, int]] = []

    def close():
        if len(ids) > 1:
            links.extend(forest(np.array(ids, np.int64), [shingle_set(text_hashes(t), WORDS) for t in texts], np.array(sides)))

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for leader, left, right, node, own, text in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if (leader, left, right) != group:
                close()
                group, ids, texts, sides = (leader, left, right), [], [], []
                if len(links) > 10_000:
                    yield batch_of()
                    links.clear()
            ids.append(node)
            texts.append(text)
            sides.append(own == right and left != right)
    close()
    yield batch_of()


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text, which tells rows of one doc_id apart) and text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    return _texts(docs).mapInArrow(_sketch, SKETCH)


def families(signed: DataFrame) -> DataFrame:
    """(node, signature) of distinct sets -> (leader, node): each with each leader of its buckets, itself included."""
    keyed = signed.select(F.col("node").alias("doc_id"), "signature").mapInArrow(_keys, "key long, doc_id long").withColumnRenamed("doc_id", "node")
    buckets = stored(keyed.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("_last")).where("leader <> _last").select("key", "leader"), "buckets")
    return stored(keyed.join(buckets, "key").select("leader", "node").distinct(), "families")


def _passing(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of texts whose (doc_id, tie) may be in wanted: a bit set of FILTER_WORDS rows at most, whatever the input, is broadcast.
    Rows that pass by chance are left to the join that follows; a full filter lets all pass."""

    def hashed(rows: DataFrame) -> DataFrame:
        h = F.xxhash64("doc_id", "tie")
        return rows.withColumn("_slot", F.pmod(h, F.lit(FILTER_WORDS))).withColumn("_bit", F.expr("shiftleft(1L, cast(pmod(shiftright(xxhash64(doc_id, tie), 20), 64) as int))"))

    bits = hashed(wanted).groupBy(F.col("_slot").alias("_at")).agg(F.bit_or("_bit").alias("_bits"))
    return hashed(texts).join(F.broadcast(bits), F.col("_slot") == F.col("_at")).where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).drop("_slot", "_bit", "_at", "_bits")


def near_links(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of distinct sets that reach SIMILARITY, enough of them to span every component."""
    parts = task_count(docs.sparkSession)
    size = signed.select(F.col("node").alias("_node"), F.col("n_shingles").alias("_size"))
    members = families(signed)
    members = members.join(size, F.col("node") == F.col("_node")).withColumnRenamed("_size", "size").drop("_node")
    members = members.join(size, F.col("leader") == F.col("_node")).withColumnRenamed("_size", "lead").drop("_node")
    members = stored(members, "members")
    wanted = stored(members.where("leader <> node").select(F.explode(F.array("leader", "node")).alias("node")).distinct().join(signed.select("node", "doc_id", "tie"), "node"), "candidates")
    texts = _passing(_texts(docs), wanted).join(wanted.select("node", F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")), [F.col("doc_id") == F.col("_id"), F.col("tie") == F.col("_tie")])
    # rows that repeat wholly have one text
    texts = stored(texts.select("node", "text").dropDuplicates(["node"]), "texts")

    def with_text(rows: DataFrame) -> DataFrame:
        return rows.join(texts.select(F.col("node").alias("_node"), "text"), F.col("node") == F.col("_node")).drop("_node")

    # sizes that are too far apart need no comparison
    near = SIMILARITY[0] * F.least("size", "lead") >= SIMILARITY[1] * F.greatest("size", "lead")
    close = members.where("leader <> node").where(near)
    salts = stored(close.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("_salts")), "salts")
    leads = salts.select("leader", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("salt"), F.col("leader").alias("node"))
    rows = close.join(salts, "leader").select("leader", F.pmod(F.xxhash64("node"), "_salts").cast("int").alias("salt"), "node").unionByName(leads)
    rows = with_text(rows).withColumn("_follows", F.col("node") != F.col("leader"))
    rows = rows.repartition(4 * parts, "leader", "salt").sortWithinPartitions("leader", "salt", "_follows", "node")
    checked = stored(rows.select("leader", "salt", "node", "text").mapInArrow(_against_leader, "leader long, node long, linked boolean"), "checked")
    links = checked.where("linked").select(F.col("leader").alias("a"), F.col("node").alias("b"))

    passed = checked.where("linked").select("leader", "node")
    others = members.where("leader <> node").join(passed.withColumn("_linked", F.lit(True)), ["leader", "node"], "left").select("leader", "node", "size", F.col("_linked").isNull().alias("rest"))
    blocks = lambda own: F.greatest(F.ceil(F.sum(F.when(own, 1).otherwise(0)) / BLOCK_DOCS), F.ceil(F.sum(F.when(own, F.col("size")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    many = others.groupBy("leader").agg(F.count("*").alias("_n"), blocks(F.col("rest")).alias("_rest"), blocks(~F.col("rest")).alias("_passed")).where("_n > 1 and _rest > 0")
    place = F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("_rest")).otherwise(F.col("_passed")))
    own = (place + F.when(F.col("rest"), 0).otherwise(F.col("_rest"))).cast("int")
    dealt = others.join(stored(many, "blocks"), "leader").select("leader", "node", own.alias("own"), (F.when(F.col("rest"), F.col("_rest") + F.col("_passed")).otherwise(F.col("_rest")) - 1).alias("_last"))
    pairs = dealt.select("leader", "node", "own", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_other")).select("leader", F.least("own", "_other").alias("left"), F.greatest("own", "_other").alias("right"), "own", "node")
    rows = with_text(pairs).select("leader", "left", "right", "node", "own", "text")
    rows = rows.repartition(4 * parts, "leader", "left", "right").sortWithinPartitions("leader", "left", "right")
    return links.union(rows.mapInArrow(_link_blocks, "a long, b long"))


def _judged(docs: DataFrame) -> DataFrame:
    """near_dedup, and tie of each row."""
    sketched = stored(sketches(docs), "sketches")
    named = sketched.where("doc_id is not null and set_id is not null")
    first = F.min(F.struct("doc_id", "tie"))
    classes = named.groupBy("set_id").agg(first.alias("_first"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    # a node is a distinct set; its number has no meaning, and is fixed by the table
    signed = stored(classes.select(F.monotonically_increasing_id().alias("node"), "_first.doc_id", "_first.tie", "n_shingles", "set_id", "signature"), "signed")
    joined = components(near_links(docs, signed)).withColumnRenamed("node", "_node")
    rooted = stored(signed.join(joined, F.col("node") == F.col("_node"), "left").select("set_id", "doc_id", "node", F.coalesce("component", "node").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    roots = rooted.join(smallest, "root").select(F.col("set_id").alias("_set"), "component_id")
    out = sketched.join(roots, sketched.set_id == F.col("_set"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "tie")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but white space, A-Z lower-cased. Null and empty texts have no shingles and link with nothing;
    texts of one to four words are one shingle. Equal sets are linked whatever their number. Rows without a doc_id take no
    part: component_id null, kept true. Rows that repeat a doc_id are judged each by its own text, and kept holds for all that
    carry the smallest id of their component (near_distinct leaves one). An empty table gives none; other columns are not read.
    """
    return _judged(docs).drop("tie")


def near_distinct(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, all columns: that of the smallest doc_id, and of rows that share it the one whose
    text has the smallest hash. Rows without a doc_id and rows without words stay."""
    judged = stored(_judged(docs).where("doc_id is not null and n_shingles > 0").groupBy("doc_id", "tie").agg(F.min("component_id").alias("component_id"), F.count("*").alias("_n")), "judged")
    one = judged.where("doc_id = component_id").groupBy("doc_id").agg(F.min("tie").alias("_one"))
    judged = judged.join(one.withColumnRenamed("doc_id", "_first"), F.col("doc_id") == F.col("_first"), "left")
    gone = judged.where("_one is null or tie <> _one").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"))
    again = judged.where("_n > 1 and tie = _one").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"))
    key = (docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string")))
    on = lambda other: [key[0] == other["_id"], key[1] == other["_tie"]]
    stays = docs.join(gone, on(gone), "left_anti")
    alone = stays.join(again, on(again), "left_anti")
    # rows that repeat wholly are few; each as one column, so that its own columns may have any names
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), key[0].alias("_doc"), key[1].alias("_hash"))
    rows = rows.join(again, [F.col("_doc") == F.col("_id"), F.col("_hash") == F.col("_tie")], "left_semi").dropDuplicates(["_doc", "_hash"])
    return alone.unionByName(rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))
