"""Queries and operators over whole tables, against Python."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalith import plans
from catalith.adapters import catalog
from catalith.functions import scalars
from catalith.operators import chunks, folds, history, listing, mutations, tree

DIR = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def follow(links, path, most=40):
    target, hops = links[path], 1
    while target in links and hops <= most:
        target, hops = links[target], hops + 1
    return (None, most, "ELOOP") if hops > most else (target, hops, None)


def test_links_are_followed_to_their_limit(spark):
    links = {f"a{k}": f"a{k + 1}" for k in range(45)} | {"s": "s", "x": "y", "y": "x", "n": None, "to": "n"}
    got = {r.path: (r.target, r.hops, r.error_code) for r in tree.resolve_links(spark.createDataFrame(list(links.items()), "path string, target string")).collect()}
    assert got == {p: follow(links, p) for p in links}


@tables
def test_all_links_are_resolved(spark):
    keys = [r.p_partkey for r in spark.read.parquet(f"{DIR}/part.parquet").select("p_partkey").collect()]
    links = {f"l{k}": f"file{k}" if k % 60 == 0 else f"l{k}" if k % 601 == 1 else f"l{k + 1}" for k in keys}
    got = {r.path: (r.target, r.hops, r.error_code) for r in plans.QUERIES["symlink_resolve_all"](spark, DIR).collect()}
    assert len(keys) > 700 and got == {p: follow(links, p) for p in links}


def fnv(text):
    h, data = 2166136261, text.encode("utf-16-be")
    for k in range(0, len(data), 2):
        h = (h ^ int.from_bytes(data[k : k + 2])) * 16777619 % 2**32
    return h - 2**32 if h >= 2**31 else h


def test_fnv_beyond_ascii(spark):
    texts = ["", "a", "http://b.net/é?q", "日本", "x😀y", "Straße/ñ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.h for r in df.select("t", scalars.fnv(df["t"]).alias("h")).collect()} == {t: None if t is None else fnv(t) for t in texts}


def test_whole_urls_are_hashed(spark, tmp_path):
    pages = [(1, "http://a.com/x"), (2, "http://b.net/é"), (3, "http://c.org/😀")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.page_id: r.h for r in plans.QUERIES["fnv_hash_all"](spark, str(tmp_path)).collect()} == {i: fnv(u) for i, u in pages}


@tables
def test_all_texts_are_split(spark):
    want = {}
    rows = spark.read.parquet(f"{DIR}/benchmark.parquet").collect()
    for r in rows:
        data = r.text.encode()
        for k in range(max(1, -(-len(data) // 64))):
            part = data[64 * k : 64 * k + 64]
            want[r.item_id, k] = (hashlib.sha256(part).hexdigest(), len(part))
    got = {(r.item_id, r.chunk_index): (r.chunk_hash, r.chunk_size) for r in plans.QUERIES["chunk_split_all"](spark, DIR).collect()}
    assert any(not r.text.isascii() for r in rows) and got == want


@tables
def test_every_file_is_put_and_swept(spark):
    rows = catalog(spark, DIR, "file_chunks").select("chunk_hash", "file_id", "chunk_index", "chunk_size").collect()
    run = lambda name: plans.QUERIES[name](spark, DIR).collect()
    refs, size, kept, old_size = Counter(), {}, Counter(), {}
    for r in rows:
        refs[r.chunk_hash] += 1
        kept[r.chunk_hash] += r.file_id % 4 != 0
        size[r.chunk_hash] = max(size.get(r.chunk_hash, 0), r.chunk_size)
        if r.file_id % 2 == 0:
            old_size[r.chunk_hash] = max(old_size.get(r.chunk_hash, 0), r.chunk_size)
    mark = lambda of, h: 1000 if of[h] % 7 == 0 else None
    # One put after the other.
    store = {h: [n, 0, mark(old_size, h)] for h, n in old_size.items()}
    known = {(r.chunk_hash, r.file_id, r.chunk_index) for r in rows if r.file_id % 2 == 0}
    for h, _, _ in known:
        store[h][1] += 1
    want = {}
    for r in sorted((r for r in rows if r.file_id % 2 or r.file_id % 4 == 0), key=lambda r: (r.file_id, r.chunk_index)):
        want[r.file_id, r.chunk_index] = "deduplicated" if r.chunk_hash in store else "created"
        of = store.setdefault(r.chunk_hash, [r.chunk_size, 0, None])
        if (key := (r.chunk_hash, r.file_id, r.chunk_index)) not in known:
            known.add(key)
            of[1] += 1
        of[2] = None
    assert {(r.file_id, r.chunk_index): r.outcome for r in run("put_outcome_all")} == want
    got = {r.chunk_hash: (r.size, r.ref_count, r.deleted_at) for r in run("dedup_put_all")}
    assert {h: x[1:] for h, x in got.items()} == {h: (x[1], x[2]) for h, x in store.items()} and all(got[h][0] == n for h, n in old_size.items())
    at = {h: mark(size, h) or (None if kept[h] else 5000) for h in refs}
    assert {r.chunk_hash: (r.ref_count, r.deleted_at) for r in run("refcount_drop_all")} == {h: (kept[h], at[h]) for h in refs}
    act = lambda h: "keep" if at[h] is None or at[h] >= 3000 else "unmark" if kept[h] else "delete"
    assert {r.chunk_hash: r.action for r in run("gc_mark_sweep_all")} == {h: act(h) for h in refs}


def test_folders_with_children_are_skipped(spark):
    rows = [("a", "u", None, "x", 3), ("b", "u", "", "x", 2), ("c", "u", None, "x", 1), ("d", "v", None, "x", 0)]
    df = spark.createDataFrame(rows, "id string, user_id string, parent_id string, name string, updated_at long")
    got = mutations.deduplicated(df, spark.createDataFrame([("b",), ("a",)], "parent_id string")).collect()
    assert {r.id: r.action for r in got} == {"a": "keep", "b": "skip", "c": "drop", "d": "keep"}
    states = spark.createDataFrame([("complete",), ("deleted",)], "status string")
    assert {(r.id, r.status): r.action for r in mutations.deduplicated(df.where("id = 'a'").crossJoin(states)).collect()} == {("a", "complete"): "keep", ("a", "deleted"): "keep"}


def test_retention_protects_the_pointer(spark):
    v = spark.createDataFrame([("p", f"v{k}", k * 1000, 5, False) for k in range(1, 5)], "path_id string, version_id string, mtime_ms long, size long, deleted boolean")
    heads = lambda h: spark.createDataFrame([("p", h)], "path_id string, head_version_id string")
    gone = lambda h, **k: sorted(r.version_id for r in history.dropped(v, heads(h), **k).collect())
    assert gone("v4", keep_last=2, keep=["v3"]) == ["v1"]  # v3 takes no place
    assert gone("v2", keep_last=1) == ["v1", "v3", "v4"] and gone(None, keep_last=1) == ["v1", "v2", "v3"]
    assert gone("v4", older_than=2500) == ["v1", "v2"] and gone("v4") == ["v1", "v2", "v3"]


def test_puts_without_bytes_and_first_writers(spark):
    store = spark.createDataFrame([("h", 5, 1, 9)], "chunk_hash string, size long, ref_count long, deleted_at long")
    refs = spark.createDataFrame([("h", 1, 0)], "chunk_hash string, file_id long, chunk_index long")
    new = spark.createDataFrame([("h", 1, 0, 5), ("h", 2, 0, 0), ("x", 3, 0, 0), ("y", 4, 0, 7), ("y", 5, 0, 7), (chunks.EMPTY, 6, 0, 0)], "chunk_hash string, file_id long, chunk_index long, chunk_size long")
    after, puts = chunks.put(store, refs, new)
    assert {r.file_id: r.outcome for r in puts.collect()} == {1: "deduplicated", 2: "deduplicated", 3: "EINVAL", 4: "created", 5: "deduplicated", 6: "created"}
    assert {r.chunk_hash: (r.size, r.ref_count, r.deleted_at) for r in after.collect()} == {"h": (5, 2, None), "y": (7, 2, None), chunks.EMPTY: (0, 1, None)}


def test_trees_of_any_depth(spark):
    chain = [(f"f{k}", f"f{k - 1}" if k else None, f"n{k}") for k in range(1300)]
    odd = [("x", "y", "x"), ("y", "x", "y"), ("z", "y", "z"), ("orphan", "gone", "o"), ("self", "self", "s")]
    df = spark.createDataFrame(chain + odd, "folder_id string, parent_id string, name string")
    got = {r.folder_id: (r.path, r.depth) for r in tree.absolute_paths(df).collect()}
    assert len(got) == 1301 and got["f1299"] == ("".join(f"/n{k}" for k in range(1300)), 1299) and got["orphan"] == ("/o", 0)
    assert {r.folder_id: r.depth for r in tree.subtree(df, "f1290").collect()} == {f"f{1290 + k}": k for k in range(10)}
    crumbs = tree.breadcrumbs(df, df.where("folder_id IN ('f3', 'z', 'orphan')")).collect()
    assert sorted((r.leaf, r.up, r.folder_id) for r in crumbs) == [("f3", k, f"f{3 - k}") for k in range(4)] + [("orphan", 0, "orphan")]


def test_folds_against_plain_python(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(3)}", n, float(rng.choice([10, 11, 12, 40])), rng.random() < 0.9, rng.randrange(-9, 9)) for n in range(1500)]
    df = spark.createDataFrame(rows, "key string, seq long, ms double, ok boolean, delta long").repartition(5)
    counters, lanes = {}, {}
    for key, _, ms, ok, delta in rows:
        now, peak = counters.get(key, (0, 0))
        now = max(0, now + delta)
        counters[key] = now, max(peak, now)
        n, times, done = lanes.get(key, (8, [], 0))
        if ok:
            times, done = [*times, ms][-32:], done + 1
            if n < 64 and done >= 8:
                s = sorted(times)
                n, done = (min(64, n + 4) if s[min(len(s) - 1, int(0.95 * len(s)))] < 1.2 * max(s[int(0.5 * len(s))], 1) else n), 0
        else:
            n = max(1, n // 2)
        lanes[key] = n, times, done
    assert {r.key: (r.used, r.peak) for r in folds.usage(df, "key", "seq", "delta").collect()} == counters
    assert {r.key: r.lanes for r in folds.concurrency(df, "key", "seq", "ms", "ok").collect()} == {k: v[0] for k, v in lanes.items()}


def test_justified_rows(spark):
    df = spark.createDataFrame([("a", k, 1.0) for k in range(5)] + [("b", 0, 2.0)], "album string, id long, aspect double")
    got = {(r.album, r.id): (r.row, round(r.row_height, 6)) for r in folds.justified(df, "album", "id", "aspect", 400.0, 200.0).collect()}
    assert got == {("a", 0): (0, 200), ("a", 1): (0, 200), ("a", 2): (1, 200), ("a", 3): (1, 200), ("a", 4): (2, 200), ("b", 0): (0, 200)}


def test_metadata_keys_of_any_kind(spark):
    df = spark.createDataFrame([('{"a.b":1,"it\'s":{"x y":[1,"z"]}}',)], "m string")
    ok = lambda f: df.where(listing.metadata_matches(F.col("m"), f)).count() == 1
    assert ok({"a.b": 1}) and ok({"it's": {"x y": [1, "z"]}}) and not ok({"a": {"b": 1}}) and not ok({"a.b": "1"}) and not ok({"a.b": 2})
    with pytest.raises(listing.CatalogError):
        listing.metadata_matches(F.col("m"), {"'\"": 1})


def test_photos_whatever_the_case(spark):
    df = spark.createDataFrame([("complete", "IMAGE/PNG"), ("complete", "image/GIF"), ("deleted", "image/png")], "status string, mime_type string")
    assert [r.mime_type for r in listing.photos(df).collect()] == ["IMAGE/PNG"]


def test_first_writer_is_the_least(spark):
    old = spark.createDataFrame([("a", 9)], "k string, v long")
    new = spark.createDataFrame([("a", 1), ("b", 5), ("b", 2)], "k string, v long")
    assert sorted(mutations.insert_or_ignore(old, new, ["k"], "v").collect()) == [("a", 9), ("b", 2)]


def test_no_plan_puts_all_rows_in_one_task(spark):
    plan = lambda name: plans.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan("quota_shares").split("Subquery")[0]
    assert "ObjectHashAggregate" not in plan("token_bucket") and "MapInArrow" in plan("token_bucket")
    page = plan("list_files_tags_and")
    assert "BroadcastHashJoin" in page and "LocalTableScan" in page and page.count("FileScan") == 3  # tags only, the page is there


@tables
def test_files_and_waveforms_as_rows(spark):
    got = {r.name: r["size"] for r in plans.QUERIES["binary_files"](spark, DIR).collect()}
    assert got == {n: os.path.getsize(f"{DIR}/{n}") for n in os.listdir(DIR) if n.endswith(".parquet")}
    texts = {r.item_id: r.text.encode() for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    for r in plans.QUERIES["waveforms"](spark, DIR).collect():
        data = texts[r.item_id]
        edges = [int(k * (len(data) / 16)) for k in range(17)]
        want = [sum(abs(b - 128) / 128 for b in data[a:e]) / max(1, e - a) for a, e in zip(edges, edges[1:], strict=False)]
        assert r.peaks == pytest.approx(want)


def test_every_page_in_turn(spark):
    files = spark.createDataFrame([(f"{k:03}", f"/f{k % 7}.txt", "u", None, k % 5, 0, "text/plain", "complete", False, None) for k in range(100)], "file_id string, file_name string, user_id string, parent_id string, file_size long, updated_at long, mime_type string, status string, archived boolean, head_version_id string")
    versions = spark.createDataFrame([], "path_id string, version_id string, deleted boolean, size long, mtime_ms long")
    tags = spark.createDataFrame([("003", "b"), ("003", "a")], "path_id string, tag string")
    cursor, seen, pages = None, [], []
    while True:
        page = listing.list_files(files, versions, tags, any_parent=True, order="size", limit=30, cursor=cursor, secret=b"s")
        rows = page.collect()
        seen += rows
        pages.append(len(rows))
        cursor = listing.next_cursor(page, b"s", "size", None, 30, files)
        if cursor is None:
            break
    assert pages == [30, 30, 30, 10] and [r.file_id for r in seen] == [f"{k:03}" for s in (4, 3, 2, 1, 0) for k in range(100) if k % 5 == s]
    assert [r.tags for r in seen if r.file_id == "003"] == ["a,b"]
    with pytest.raises(listing.CatalogError):
        listing.list_files(files, versions, tags, order="name", cursor=listing.encode_cursor(b"s", "size", "desc", 1, "x"), secret=b"s")


def test_packed_hashes_come_back(spark):
    texts = ["a" * 64, hashlib.sha256(b"").hexdigest(), "A" * 64, "a" * 63, "a" * 64 + "\n", "new1", "", "é", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", chunks.packed(F.col("t")))
    got = df.select("t", "p", chunks.unpacked(F.col("p")).alias("back")).collect()
    assert all(r.t == r.back for r in got) and len({bytes(r.p) for r in got if r.p is not None}) == len(texts) - 1
    store = spark.createDataFrame([("h", 5, 1, 9), ("q", 4, 1, 9)], "chunk_hash string, size long, ref_count long, deleted_at long")
    refs = spark.createDataFrame([("h", 1, 0)], "chunk_hash string, file_id long, chunk_index long")
    new = spark.createDataFrame([("h", 1, 0, 5), ("h", 2, 0, 0), ("q", 8, 0, 0), ("x", 3, 0, 0), ("y", 4, 0, 7), ("y", 5, 0, 0), (chunks.EMPTY, 6, 0, 0)], "chunk_hash string, file_id long, chunk_index long, chunk_size long")
    pack = lambda df: df.withColumn("chunk_hash", chunks.packed(F.col("chunk_hash")))
    text = lambda df: sorted(map(tuple, df.withColumn("chunk_hash", chunks.unpacked(F.col("chunk_hash"))).select("chunk_hash", *df.drop("chunk_hash").columns).collect()), key=str)
    plain, moved = chunks.put(store, refs, new), chunks.put(pack(store), pack(refs), pack(new))
    assert [text(df) for df in moved] == [sorted(map(tuple, df.select("chunk_hash", *df.drop("chunk_hash").columns).collect()), key=str) for df in plain]
    assert {r.chunk_hash: (r.size, r.ref_count, r.deleted_at) for r in plain[0].collect()} == {"h": (5, 2, None), "q": (4, 2, None), "y": (7, 1, None), chunks.EMPTY: (0, 1, None)}


#: Queries on the chunks of files, and whether their rows were dealt by file and index once more, or their hashes moved as text.
MOVED = {
    "dedup_put": "chunk_index",
    "put_outcome_all": "text",
    "put_outcome": "text",
    "manifest_with_store": "text",
    "copy_files": "text",
    "finalize_uploads": "chunk_index",
    "put_parts_outcome": "chunk_index",
    "restore_refs": "chunk_index",
    "dedup_put_all": "chunk_index",
}


@tables
@pytest.mark.parametrize("name", MOVED)
def test_chunks_move_once_by_file_and_with_packed_hashes(spark, name):
    plan = plans.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    if "chunk_index" in MOVED[name]:
        assert dealt and not any("chunk_index" in line for line in dealt)
    if "text" in MOVED[name]:
        assert "unhex(" in plan


@tables
@pytest.mark.parametrize("name", ["dedup_put_all", "restore_refs", "put_parts_outcome", "finalize_uploads", "manifest_with_store", "put_outcome", "put_outcome_all"])
def test_hashes_are_made_where_files_are(spark, name):
    lines = plans.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString().splitlines()
    under = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning(file_id#" in line]
    assert under and all("l_extendedprice" in line and "sha2(" not in line for line in under)


def test_copies_meet_the_store_first(spark):
    refs = [("h", 1, 0), ("x", 2, 0), ("h", 2, 1), ("y", 3, 0), ("x", 4, 0), (None, 5, 0), ("h", None, 0)]
    c = spark.createDataFrame(refs, "chunk_hash string, file_id long, chunk_index long")
    store = spark.createDataFrame([("h", 3, None), ("x", 2, 7)], "chunk_hash string, ref_count long, deleted_at long")
    files = spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 6)], "file_id long")
    pairs = spark.createDataFrame([(1, 11), (1, 12), (2, 13), (3, 14), (4, 15), (5, 16), (6, 17)], "source long, copy long")
    after, out = mutations.copied(files, c, store, pairs)
    codes = {11: "OK", 12: "OK", 13: "ENOCHUNK", 14: "ENOCHUNK", 15: "ENOENT", 16: "ENOCHUNK", 17: "OK"}
    assert {r["copy"]: r.code for r in out.collect()} == codes
    assert sorted(map(tuple, after.collect()), key=str) == sorted([*refs, ("h", 11, 0), ("h", 12, 0)], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" not in plan
