"""Prefix trie of conversations by truncation peeling.

Every conversation becomes the chain of digests of its prefixes (128 bits of SHA-256 each, which
stand for the sequence of turns). Peeling starts at the greatest depth: conversations that end
there merge with the nodes that survive from below, each merged group is a node, and the node
without its last turn goes on to the next depth. Counts, leaves and savings are carried along, so a
node is complete as soon as it is found.

Depths are peeled in bands (0-8, 8-16, 16-32, ...). The first band goes one depth a round: a round
is one aggregation with partial sums, so a first turn that many conversations share is one row for
each task. In deeper bands the rows that agree up to the band's top are peeled in one task while they
have at most GROUP_TURNS turns together; larger groups go one depth a round too. A few very long
conversations therefore cost a round for each band, not for each turn.

Turns are ordered by number, nulls first, ties by the digest of role and text; a null role or text
counts as empty, repeated rows are repeated turns. Rows of null conv_id belong to no conversation.
Very long texts are hashed where they are read and never moved. No conversations give no nodes, not
even the root. Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import joined_by_key, shared_root, shared_table

#: Bytes of a digest; depth of the first band; turns of a group that one task peels; bytes of ids joined at once.
WIDTH, FIRST_BAND, GROUP_TURNS, CHUNK = 16, 8, 200_000, 1 << 16
#: A part of a node: a conversation's end, or a surviving child without its last turn. `sizes` holds the bytes of each text.
PART = "depth long, path binary, sizes array<long>, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE = f"key binary, parent binary, {PART}"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def digest(*parts) -> F.Column:
    """WIDTH bytes of the SHA-256 of the parts."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 2 * WIDTH))


def turns(conversations: DataFrame) -> DataFrame:
    """Turns numbered from 1 in each conversation -> conv_id, rank, digest, size (bytes of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", digest(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("digest"), F.octet_length(text).cast("long").alias("size")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest", "size")
    return own.select("conv_id", F.row_number().over(order).alias("rank"), "digest", "size")


def own_turns(numbered: DataFrame) -> DataFrame:
    """Every conversation as it is -> conv_id, rank, digest, size; a row of rank 0 opens each conversation."""
    return numbered.unionByName(_opened(numbered))


def _opened(numbered: DataFrame) -> DataFrame:
    return numbered.where("rank = 1").select("conv_id", F.lit(0).alias("rank"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("size"))


def rebuilt_turns(numbered: DataFrame, most: int = 8, family: int = 5) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % family; its own follow from turn h + 1.

    h = crc32(c as decimal text) % (most + 1). A donor lends at most `most` rows to at most
    2 * family conversations, so no key of the join is large.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    taker = numbered.where("rank = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("donor"), h.alias("h"))
    lent = numbered.where((F.col("rank") <= most) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "donor")
    lent = taker.join(lent, "donor").where("rank <= h").select("conv_id", "rank", "digest", "size")
    return numbered.where(F.col("rank") > h).unionByName(lent).unionByName(_opened(numbered))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order -> one row for each conversation: the digests of its prefixes and the sizes of its texts."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("path", pa.binary()), ("sizes", pa.list_(pa.int64()))])
    conv, key, path, sizes, done, held = None, b"", bytearray(), [], [], 0
    for batch in batches:
        for c, rank, part, size in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "rank", "digest", "size")), strict=True):
            if rank == 0:
                if conv is not None:
                    done.append((conv, len(sizes), key, bytes(path), sizes))
                    held += len(path)
                    if len(done) >= 10_000 or held > CHUNK * 16:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
                        done, held = [], 0
                conv, key, path, sizes = c, b"", bytearray(), []
            else:
                key = hashlib.sha256(key + part).digest()[:WIDTH]
                path += key
                sizes.append(size)
    if conv is not None:
        done.append((conv, len(sizes), key, bytes(path), sizes))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, conv_id) in order -> ids joined by commas in pieces of at most CHUNK bytes or so: key, first id, number, text."""
    key, ids, length, out = None, [], 0, []

    def flushed():
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["key", "first", "n", "ids"])

    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (k != key or length > CHUNK):
                out.append((key, ids[0], len(ids), ",".join(map(str, ids))))
                ids, length = [], 0
                if len(out) >= 5000 or len(out[-1][3]) > CHUNK:
                    yield flushed()
                    out = []
            key = k
            ids.append(c)
            length += 20
    if ids:
        out.append((key, ids[0], len(ids), ",".join(map(str, ids))))
    if out:
        yield flushed()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order -> key, smallest id, number of ids, SHA-256 of all ids: one running hash, no list."""
    key, first, n, sha, out = None, None, 0, None, []

    def flushed():
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["key", "conv_id", "n_convs", "ends_sha256"])

    for batch in batches:
        for k, f, m, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "first", "n", "ids")), strict=True):
            if sha is not None and k == key:
                sha.update(b"," + ids.encode())
                n += m
                continue
            if sha is not None:
                out.append((key, first, n, sha.hexdigest()))
            if len(out) >= 10_000:
                yield flushed()
                out = []
            key, first, n, sha = k, f, m, hashlib.sha256(ids.encode())
    if sha is not None:
        out.append((key, first, n, sha.hexdigest()))
    if out:
        yield flushed()


def sequences(chains: DataFrame) -> DataFrame:
    """One part for each distinct whole conversation, with the digest of the ids that end there."""
    ids = chains.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = ids.mapInArrow(_id_chunks, "key binary, first long, n long, ids string")
    ends = chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_ends, "key binary, conv_id long, n_convs long, ends_sha256 string")
    zero = F.lit(0).cast("long")
    joined = ends.join(chains, ["key", "conv_id"])  # the smallest id's row stands for all copies
    return joined.select("depth", "path", "sizes", "conv_id", "n_convs", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends_sha256")


def _cut(depth: F.Column) -> F.Column:
    """The digest of the prefix of `depth` turns, empty for the root."""
    return F.when(depth > 0, F.substring(F.col("path"), (depth - 1).cast("int") * WIDTH + 1, F.lit(WIDTH))).otherwise(F.lit(b""))


def merged(parts: DataFrame) -> DataFrame:
    """Parts of one depth -> nodes."""
    keyed = parts.withColumn("key", _cut(F.col("depth")))
    n = keyed.groupBy("key").agg(
        F.first("depth").alias("depth"),
        F.first("path").alias("path"),
        F.first("sizes").alias("sizes"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"),
    )
    own = F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.element_at("sizes", -1)).otherwise(0)
    n = n.withColumns({"n_leaves": F.greatest("n_leaves", F.lit(1)), "saved_tokens": F.col("saved_tokens") + own, "parent": F.when(F.col("depth") > 0, _cut(F.col("depth") - 1))})
    return n.select("key", "parent", *[c.split()[0] for c in PART.split(", ")])


def stripped(nodes: DataFrame) -> DataFrame:
    """Nodes without their last turn: parts of the depth above."""
    d = F.col("depth") - 1
    return nodes.select(
        d.alias("depth"), F.substring(F.col("path"), F.lit(1), (d * WIDTH).cast("int")).alias("path"), F.slice("sizes", F.lit(1), d.cast("int")).alias("sizes"),
        "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"),
    )


def _peel(rows: list[dict], top: int) -> Iterator[dict]:
    """All nodes deeper than `top` of one group; only those just below `top` keep their path."""
    at: dict[int, list[dict]] = {}
    for r in rows:
        at.setdefault(r["depth"], []).append(r)
    for depth in range(max(at), top, -1):
        found: dict[bytes, dict] = {}
        for r in at.pop(depth, ()):
            key = r["path"][WIDTH * (depth - 1) : WIDTH * depth]
            if (n := found.get(key)) is None:
                found[key] = dict(r)
                continue
            n["conv_id"] = min(n["conv_id"], r["conv_id"])
            for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                n[c] += r[c]
            n["ends_sha256"] = n["ends_sha256"] or r["ends_sha256"]
        for key, n in found.items():
            n["n_leaves"] = max(1, n["n_leaves"])
            n["saved_tokens"] += (n["n_convs"] - 1) * n["sizes"][depth - 1]
            last = depth == top + 1
            yield {**n, "depth": depth, "key": key, "parent": n["path"][WIDTH * (depth - 2) : WIDTH * (depth - 1)], "path": n["path"][: WIDTH * depth] if last else None, "sizes": n["sizes"][:depth] if last else None}
            at.setdefault(depth - 1, []).append({**n, "n_children": 1, "ends_sha256": None})


def _peeler(top: int):
    """Parts sorted by their digest at depth `top` -> nodes below it, a group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, out, schema = None, [], [], None
        types = {"key": pa.binary(), "parent": pa.binary(), "path": pa.binary(), "sizes": pa.list_(pa.int64()), "ends_sha256": pa.string()}
        names = [c.split()[0] for c in NODE.split(", ")]
        schema = pa.schema([(c, types.get(c, pa.int64())) for c in names])
        for batch in batches:
            for r in batch.to_pylist():
                if rows and r["top"] != group:
                    out.extend(_peel(rows, top))
                    rows = []
                    if len(out) > 10_000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                group = r.pop("top")
                rows.append(r)
        if rows:
            out.extend(_peel(rows, top))
        for a in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_pylist(out[a : a + 20_000], schema)

    return run


def build_trie(rows: DataFrame, group_turns: int = GROUP_TURNS) -> DataFrame:
    """Every node of the trie of the conversations in `rows` (conv_id, rank, digest, size; rank 0 opens one).

    -> conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    """
    spark = rows.sparkSession
    chains = rows.repartition("conv_id").sortWithinPartitions("conv_id", "rank").mapInArrow(_chains, "conv_id long, depth long, key binary, path binary, sizes array<long>")
    chains = shared_table(chains, "chains")
    path = f"{shared_root(spark)}/sequences-{uuid.uuid4().hex}"
    whole = sequences(chains).withColumn("band", F.least("depth", F.lit(FIRST_BAND + 1)).cast("int"))
    whole.write.option("compression", "zstd").partitionBy("band").parquet(path)
    whole = spark.read.schema(f"{PART}, band int").parquet(path)
    top, nodes, survivors = FIRST_BAND, [], None
    deep = whole.where(F.col("band") > FIRST_BAND).drop("band")
    deepest = deep.agg(F.max("depth")).first()[0] or 0
    while top * 2 < deepest:
        top *= 2
    ends_at = lambda d, source: source.where(F.col("depth") == d)

    def by_rounds(parts: DataFrame, low: int, high: int) -> DataFrame:
        """Nodes of depths low + 1 to high, one depth a round; those of depth low + 1 are returned."""
        found = None
        for d in range(high, low, -1):
            here = ends_at(d, parts)
            found = shared_table(merged(here if found is None else here.unionByName(stripped(found))), "trie-level")
            nodes.append(found)
        return found

    while top >= FIRST_BAND and deepest > FIRST_BAND:
        parts = deep.where((F.col("depth") > top) & (F.col("depth") <= 2 * top))
        parts = parts if survivors is None else parts.unionByName(survivors)
        parts = parts.withColumn("top", _cut(F.lit(top)))
        size = parts.groupBy("top").agg(F.sum("depth").alias("turns"), F.count("*").alias("rows"))
        total = size.agg(F.sum("rows")).first()[0] or 0
        parts = joined_by_key(parts, size, "top", "rows", total)
        small = parts.where(F.col("turns") <= group_turns).drop("turns", "rows")
        peeled = shared_table(small.repartition("top").sortWithinPartitions("top").mapInArrow(_peeler(top), NODE), "trie-band")
        nodes.append(peeled)
        survivors = stripped(peeled.where(F.col("depth") == top + 1))
        hot = parts.where(F.col("turns") > group_turns).drop("turns", "rows", "top")
        if not size.where(F.col("turns") > group_turns).isEmpty():
            survivors = survivors.unionByName(stripped(by_rounds(shared_table(hot, "trie-hot"), top, 2 * top)))
        top //= 2
    shallow = []
    for d in range(FIRST_BAND, -1, -1):
        here = whole.where(F.col("band") == d).drop("band")
        survivors = shared_table(merged(here if survivors is None else here.unionByName(survivors)), "trie-level")
        shallow.append(survivors)
        survivors = stripped(survivors) if d else None
    found = None
    for n in [*nodes, *shallow]:
        n = n.drop("path", "sizes")
        found = n if found is None else found.unionByName(n)
    found = shared_table(found, "trie-nodes")  # read several times by the join
    parents = found.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__children"))
    inner = joined_by_key(found.where("depth > 0"), parents, "parent", "__children", found.count())
    root = found.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")]
    return inner.select(*out).unionByName(root.select(*out))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations (see rebuilt_turns)."""
    return build_trie(rebuilt_turns(shared_table(turns(conversations), "turns")))
