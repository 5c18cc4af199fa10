"""The chunk store: manifests, offsets, hashes, ranges, references, marking and sweeping, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRACE_MS = 30_000


def manifest(chunks: DataFrame) -> DataFrame:
    """Per file: its chunks in order, their bytes, and the file hash: SHA-256 over the joined hexadecimal hashes."""
    a = chunks.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_hash", "chunk_size"))).alias("c"))
    hashes = F.array_join(F.transform("c", lambda x: x["chunk_hash"]), "")
    return a.select("file_id", F.size("c").cast("long").alias("chunks"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x["chunk_size"]).alias("bytes"), F.sha2(hashes, 256).alias("file_hash"), F.col("c").alias("manifest"))


def offsets(chunks: DataFrame) -> DataFrame:
    """Each chunk's first byte in its file."""
    w = Window.partitionBy("file_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.select("file_id", "chunk_index", "chunk_size", F.coalesce(F.sum("chunk_size").over(w), F.lit(0)).alias("offset"))


def range_parts(chunks: DataFrame, start: int, end: int) -> DataFrame:
    """The chunks that bytes ``start`` to ``end`` (exclusive) of each file touch, with the part of each."""
    o = offsets(chunks).withColumn("until", F.col("offset") + F.col("chunk_size"))
    touched = o.where((F.col("until") > start) & (F.col("offset") < end))
    return touched.select("file_id", "chunk_index", F.greatest(F.lit(start) - F.col("offset"), F.lit(0)).alias("from"), (F.least(F.lit(end), F.col("until")) - F.col("offset")).alias("to"))


def split(bodies: DataFrame, size: int, key: str = "file_id", data: str = "data") -> DataFrame:
    """Bodies as chunks of ``size`` bytes with their hashes; each row leaves the generator with its own bytes only."""
    n = F.greatest(F.floor((F.octet_length(data) + size - 1) / size), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(data), i * size + 1, F.lit(size)))
    each = bodies.select(key, F.posexplode(parts).alias("chunk_index", "data"))
    return each.select(key, "chunk_index", F.sha2("data", 256).alias("chunk_hash"), F.octet_length("data").cast("long").alias("chunk_size"), "data")


def read(chunks: DataFrame, key: str = "file_id", data: str = "data") -> DataFrame:
    """Chunks put together in order."""
    return chunks.groupBy(key).agg(F.expr(f"listagg({data}) WITHIN GROUP (ORDER BY chunk_index)").alias(data))


def read_files(files: DataFrame, chunks: DataFrame, most: int = 100 << 20) -> DataFrame:
    """``file_id, data, error_code`` of files (file_id, file_size, inline_data): the inline bytes, else the chunks that are there, cut to the file's size.

    ENOENT: neither; EFBIG: more bytes than ``most``, which are not read.
    """
    small = files.where(F.col("file_size") <= most)
    own = read(chunks.join(small.where("inline_data is null").select("file_id"), "file_id", "left_semi").select("file_id", "chunk_index", "data"))
    out = files.join(own, "file_id", "left")
    code = F.when(F.col("file_size") > most, "EFBIG").when(F.col("inline_data").isNull() & F.col("data").isNull() & (F.col("file_size") > 0), "ENOENT")
    data = F.substring(F.coalesce("inline_data", "data", F.lit(b"")), F.lit(1), F.col("file_size").cast("int"))
    return out.select("file_id", F.when(code.isNull(), data).alias("data"), code.alias("error_code"))


def many_chunks(asked: DataFrame, store: DataFrame) -> DataFrame:
    """For (pos, chunk_hash): the stored bytes and size, null for missing ones; order and repeats are kept by ``pos``."""
    return asked.join(store.select("chunk_hash", "size", "data"), "chunk_hash", "left").select("pos", "chunk_hash", "size", "data")


def chunk_at(asked: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """For (file_id, chunk_index): hash and size of that chunk; a file with inline bytes has chunk 0 only, of all of them.  ENOENT: no such file; EINVAL: no such chunk."""
    f = files.select("file_id", F.sha2("inline_data", 256).alias("inline_hash"), F.octet_length("inline_data").cast("long").alias("inline_size"), F.lit(True).alias("there"))
    out = asked.join(f, "file_id", "left").join(chunks.select("file_id", "chunk_index", "chunk_hash", "chunk_size"), ["file_id", "chunk_index"], "left")
    first = F.col("chunk_index") == 0
    inline = F.col("inline_hash").isNotNull()
    hashed = F.when(inline, F.when(first, F.col("inline_hash"))).otherwise(F.col("chunk_hash"))
    size = F.when(inline, F.when(first, F.col("inline_size"))).otherwise(F.col("chunk_size"))
    code = F.when(F.col("there").isNull(), "ENOENT").when(hashed.isNull(), "EINVAL")
    return out.select("file_id", "chunk_index", hashed.alias("chunk_hash"), size.alias("chunk_size"), code.alias("error_code"))


def manifests(asked: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """For (pos, file_id): the manifest's hash and chunks, or ENOENT."""
    m = manifest(chunks.join(asked.select("file_id").distinct(), "file_id", "left_semi"))
    f = files.select("file_id", F.lit(True).alias("there"))
    out = asked.join(f, "file_id", "left").join(m, "file_id", "left")
    ok = lambda c, none: F.when(F.col("there"), F.coalesce(c, none)).alias(c)
    return out.select("pos", "file_id", ok("chunks", F.lit(0).cast("long")), ok("bytes", F.lit(0).cast("long")), ok("file_hash", F.lit(None).cast("string")), F.when(F.col("there").isNull(), "ENOENT").alias("error_code"))


def with_bytes(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """A manifest's rows with their stored bytes, joined within shards; a chunk that is gone has none."""
    return chunks.join(store.select("shard_index", "chunk_hash", "data"), ["shard_index", "chunk_hash"], "left")


def alive(store: DataFrame) -> DataFrame:
    """Chunks that are not marked and that something refers to."""
    return store.where(F.col("deleted_at").isNull() & (F.col("ref_count") >= 1))


#: The hash of no bytes (fixed value).
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def packed(hashed: Column) -> Column:
    """A hash as bytes: 32 for 64 small hexadecimal digits, more for any other text; no two are alike.  Joins and groups move half as much of them."""
    return F.when(hashed.rlike(r"^[0-9a-f]{64}\z"), F.unhex(hashed)).otherwise(F.concat(F.lit(bytes(33)), hashed.cast("binary")))


def unpacked(data: Column) -> Column:
    """The text of a packed hash."""
    return F.when(F.octet_length(data) == 32, F.lower(F.hex(data))).otherwise(F.substring(data, F.lit(34), F.octet_length(data)).cast("string"))


def _empty(chunks: DataFrame) -> Column:
    """The hash of no bytes, in the form of the table's hashes."""
    return F.lit(EMPTY if chunks.schema["chunk_hash"].dataType.typeName() == "string" else bytes.fromhex(EMPTY))


def put(store: DataFrame, refs: DataFrame, new: DataFrame, order: tuple[str, ...] = ("file_id", "chunk_index")) -> tuple[DataFrame, DataFrame]:
    """The store after chunks are put, and each put with its outcome.

    The first put of a hash that is not stored, by ``order`` (unique for a hash),
    is ``created``, all others ``deduplicated``; no bytes under another hash than
    theirs are ``EINVAL`` if the hash is not stored, and change nothing.  Only
    references (hash, file, index) that are not in ``refs`` are counted, each once.
    A put unmarks its chunk.  Hashes may be packed, in all three tables.

    References are counted where the files are: tables dealt by ``file_id`` move
    only counts of each hash.
    """
    # No bytes under another hash: to be refused unless the hash is stored.
    void = F.coalesce((F.col("chunk_size") == 0) & (F.col("chunk_hash") != _empty(new)), F.lit(False))
    known = store.select("chunk_hash", F.lit(True).alias("__known"))
    first = new.where(~void).groupBy("chunk_hash").agg(F.min(F.struct(*order)).alias("__first"))
    puts = new.join(known, "chunk_hash", "left").join(first, "chunk_hash", "left")
    lacking = F.col("__known").isNull()
    outcome = F.when(lacking & void, "EINVAL").when(lacking & (F.struct(*order) == F.col("__first")), "created").otherwise("deduplicated")
    puts = puts.withColumn("outcome", outcome).drop("__first", "__known")
    keys = ["chunk_hash", "file_id", "chunk_index"]
    marked = new.select(*keys, F.when(~void, F.col("chunk_size")).alias("size"), void.alias("void"), F.lit(False).alias("was"))
    there = refs.select(*keys, F.lit(None).cast("long").alias("size"), F.lit(None).cast("boolean").alias("void"), F.lit(True).alias("was"))
    # ``void`` is null where nothing was put, true where only nothing was.
    one = marked.unionByName(there).groupBy(*keys).agg(F.max("size").alias("size"), F.min("void").alias("void"), F.max("was").alias("was")).where("void is not null")
    count_if = lambda c: F.sum(F.when(c, 1).otherwise(0))
    fresh = ~F.col("was")
    touched = one.groupBy("chunk_hash").agg(F.max("size").alias("put_size"), F.min("void").alias("void"), count_if(fresh & ~F.col("void")).alias("more"), count_if(fresh & F.col("void")).alias("more_void"))
    both = store.select("chunk_hash", "size", "ref_count", "deleted_at", F.lit(True).alias("__known")).join(touched, "chunk_hash", "full")
    is_known = F.col("__known").isNotNull()
    new_size = F.coalesce("put_size", F.when(is_known & F.col("void"), F.lit(0).cast("long")))
    both = both.withColumn("new_size", new_size).where(is_known | ~F.col("void"))
    count = F.coalesce("ref_count", F.lit(0)) + F.coalesce("more", F.lit(0)) + F.when(is_known, F.coalesce("more_void", F.lit(0))).otherwise(0)
    after = both.select("chunk_hash", F.coalesce("size", "new_size").alias("size"), count.alias("ref_count"), F.when(F.col("new_size").isNull(), F.col("deleted_at")).alias("deleted_at"))
    return after, puts


def put_parts(landed: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts of uploads after new ones, and each new part's outcome: ``created``, ``deduplicated``, or ``superseded`` where the place held another hash.

    Both have one row a place (upload_id, chunk_index); tables dealt by
    ``upload_id`` meet where they are.  Hashes may be packed, in both.
    """
    place, none = ["upload_id", "chunk_index"], F.lit(None).cast(new.schema["chunk_hash"].dataType)
    known = landed.select("chunk_hash").distinct().withColumn("known", F.lit(True))
    rows = new.select(*place, "chunk_hash", none.alias("was"), F.lit(True).alias("put")).unionByName(landed.select(*place, none.alias("chunk_hash"), F.col("chunk_hash").alias("was"), F.lit(False).alias("put")))
    out = rows.groupBy(*place).agg(F.max("chunk_hash").alias("chunk_hash"), F.max("was").alias("was"), F.max("put").alias("put")).where("put")
    out = out.select(*place, "chunk_hash", (F.col("was") != F.col("chunk_hash")).alias("other")).join(known, "chunk_hash", "left")
    outcome = F.when(F.col("other"), "superseded").when(F.col("known"), "deduplicated").otherwise("created")
    after = landed.join(new.select("upload_id", "chunk_index"), ["upload_id", "chunk_index"], "left_anti").unionByName(new.select(landed.columns))
    return after, out.select("upload_id", "chunk_index", outcome.alias("outcome"))


def restored_refs(store: DataFrame, refs: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References after asked ones (hash, file, index) are restored, and each one's outcome: ``gone`` where the chunk is not alive, ``kept`` where it was there, else ``added``.

    Tables dealt by ``file_id`` meet where they are.  Hashes may be packed, in all three.
    """
    keys = ["chunk_hash", "file_id", "chunk_index"]
    live = alive(store).select("chunk_hash", F.lit(True).alias("live"))
    rows = asked.select(*keys, F.lit(True).alias("asked"), F.lit(False).alias("was")).unionByName(refs.select(*keys, F.lit(False).alias("asked"), F.lit(True).alias("was")))
    out = rows.groupBy(*keys).agg(F.max("asked").alias("asked"), F.max("was").alias("was")).where("asked").join(live, "chunk_hash", "left")
    out = out.withColumn("outcome", F.when(F.col("live").isNull(), "gone").when(F.col("was"), "kept").otherwise("added"))
    return refs.select(*keys).unionByName(out.where("outcome = 'added'").select(*keys)), out.select(*keys, "outcome")


def dropped_refs(store: DataFrame, refs: DataFrame, files: DataFrame, now_ms: int) -> DataFrame:
    """The store after all references of ``files`` are gone: counts fall, unreferenced chunks are marked."""
    gone = refs.join(files, "file_id", "left_semi").groupBy("chunk_hash").agg(F.count("*").alias("gone"))
    left = F.greatest(F.col("ref_count") - F.coalesce("gone", F.lit(0)), F.lit(0))
    rows = store.join(gone, "chunk_hash", "left").withColumn("left", left)
    return rows.select("chunk_hash", "size", F.col("left").alias("ref_count"), F.when((F.col("left") == 0) & F.col("gone").isNotNull(), F.coalesce("deleted_at", F.lit(now_ms).cast("long"))).otherwise(F.col("deleted_at")).alias("deleted_at"))


def sweep(store: DataFrame, now_ms: int) -> DataFrame:
    """What a sweep does to each marked chunk past its grace: delete, or unmark if it is referenced again; others are kept."""
    due = F.col("deleted_at").isNotNull() & (F.col("deleted_at") < now_ms - GRACE_MS)
    return store.withColumn("action", F.when(due & (F.col("ref_count") == 0), "delete").when(due, "unmark").otherwise("keep"))


def verified(expected: DataFrame, landed: DataFrame) -> DataFrame:
    """Each expected or landed chunk of an upload with its code: ENOENT missing, EBADF another hash, EXTRA not expected."""
    e, l = expected.withColumnRenamed("chunk_hash", "expected"), landed.withColumnRenamed("chunk_hash", "landed")  # noqa: E741
    both = e.join(l, ["upload_id", "chunk_index"], "full")
    code = F.when(F.col("expected").isNull(), "EXTRA").when(F.col("landed").isNull(), "ENOENT").when(F.col("expected") != F.col("landed"), "EBADF").otherwise("OK")
    return both.select("upload_id", "chunk_index", code.alias("code"))


def landed(parts: DataFrame) -> DataFrame:
    """Per upload: distinct indexes that landed, and bytes of all rows."""
    return parts.groupBy("upload_id").agg(F.count_distinct("chunk_index").alias("indexes"), F.sum("chunk_size").alias("bytes"))


def shard_of(chunks: DataFrame, known: DataFrame, fallback: Column) -> DataFrame:
    """Chunks placed where their hash already is (the lowest shard), else by ``fallback``."""
    where = known.groupBy("chunk_hash").agg(F.min("shard_index").alias("__known"))
    return chunks.join(where, "chunk_hash", "left").withColumn("shard_index", F.coalesce("__known", fallback)).drop("__known")


def finalized(expected: DataFrame, there: DataFrame) -> DataFrame:
    """Per upload what finalizing it gives: ENOENT with a chunk missing, EBADF with another hash, else OK with the file's hash and bytes; chunks beyond the expected ones are left out.

    Both have one row a place (upload_id, chunk_index); tables dealt by ``upload_id`` meet where they are.
    """
    place, none = ["upload_id", "chunk_index"], F.lit(None)
    e = expected.select(*place, F.col("chunk_hash").alias("expected"), none.cast("string").alias("landed"), "chunk_size", F.lit(True).alias("due"))
    l = there.select(*place, none.cast("string").alias("expected"), F.col("chunk_hash").alias("landed"), none.cast("long").alias("chunk_size"), F.lit(False).alias("due"))  # noqa: E741
    rows = e.unionByName(l).groupBy(*place).agg(*(F.max(c).alias(c) for c in ("expected", "landed", "chunk_size", "due"))).where("due")
    rows = rows.withColumn("code", F.when(F.col("landed").isNull(), 2).when(F.col("landed") != F.col("expected"), 1).otherwise(0))
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "expected"))), lambda x: x["expected"])
    out = rows.groupBy("upload_id").agg(F.max("code").alias("code"), F.sum("chunk_size").alias("bytes"), F.sha2(F.array_join(hashes, ""), 256).alias("file_hash"))
    ok = lambda c: F.when(F.col("code") == 0, F.col(c)).alias(c)
    return out.select("upload_id", F.when(F.col("code") == 2, "ENOENT").when(F.col("code") == 1, "EBADF").otherwise("OK").alias("code"), ok("bytes"), ok("file_hash"))


def pulled(chunks: DataFrame, file: int, after: int, limit: int) -> DataFrame:
    """A file's next chunks after an index: a reader's cursor; the file is one version's, so that later writes do not show."""
    return chunks.where((F.col("file_id") == file) & (F.col("chunk_index") > after)).orderBy("chunk_index").limit(limit)
