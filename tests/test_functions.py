from __future__ import annotations

import base64
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from catalith import plans
from catalith.functions import arrow, scalars
from catalith.operators import chunks, folds, listing, mutations, search


def test_murmur3_known_values():
    keys = ["", "hello", "hello, world", "The quick brown fox jumps over the lazy dog", "aaaa", "abc"]
    want = [0, 0x248BFA47, 0x149BBB7F, 0x2E4FF723, None, 0xB3DD93FA]
    for got, w in zip(arrow.murmur3(keys).tolist(), want, strict=True):
        assert w is None or got == w
    assert arrow.murmur3([""], 1).tolist() == [0x514E28B7]


def test_placement_skips_full_and_ties_go_low():
    assert arrow.placed(["f"], [0], ["u"], 4, frozenset(range(4))).tolist() == [-1]
    best = arrow.placed(["f"], [0], ["u"], 8).tolist()[0]
    assert arrow.placed(["f"], [0], ["u"], 8, frozenset({best})).tolist()[0] != best


@pytest.mark.parametrize(("base", "patch", "want"), [({"a": 1}, {"a": None}, {}), ({"a": [1, 2]}, {"a": [3]}, {"a": [3]}), ({"a": {"b": 1}}, {"a": {"c": 2}}, {"a": {"b": 1, "c": 2}}), ({}, {"a": {"b": None}}, {"a": {"b": None}})])
def test_deep_merge(base, patch, want):
    assert arrow.merged(base, patch) == want


def test_metadata_limits():
    deep = 1
    for _ in range(12):
        deep = {"x": deep}
    assert arrow.invalid_metadata(deep) == "depth"
    assert arrow.invalid_metadata({"a": list(range(1025))}) == "array"
    assert arrow.invalid_metadata({"a": float("nan")}) == "number"
    assert arrow.invalid_metadata({"a": [1, "x", None, True]}) is None


def test_peaks():
    assert arrow.peaks(b"") == [0.0] * 96
    assert arrow.peaks(bytes([0]) * 960) == [1.0] * 96


def test_paths(spark):
    cases = {"/a//b/./c": "/a/b/c", "/a/../b": "/b", "/": "/", "/../a": None, "a/b": None, "/a/b/../../c/": "/c", "/a\0b": None, "/a/../../b/c": None}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", scalars.normalize(F.col("p")).alias("n"))
    assert {r.p: r.n for r in df.collect()} == cases
    row = spark.range(1).select(scalars.link_target(F.lit("/a/b/l"), F.lit("../x")).alias("t"), scalars.link_target(F.lit("/a/l"), F.lit("/z")).alias("u")).first()
    assert (row.t, row.u) == ("/a/x", "/z")


def test_ranges(spark):
    cases = {"bytes=0-4": (0, 4, 206), "bytes=5-": (5, 9, 206), "bytes=-3": (7, 9, 206), "bytes=20-": (None, None, 416), "bytes=-0": (None, None, 416), "bytes=1-2,3-4": (None, None, 200), "x": (None, None, 200), "bytes=4-2": (None, None, 200), "bytes=-30": (0, 9, 206)}
    df = spark.createDataFrame([(k,) for k in cases], "h string").select("h", scalars.byte_range(F.col("h"), F.lit(10).cast("long")).alias("r"))
    assert {r.h: tuple(r.r) for r in df.collect()} == cases


def test_cursor():
    c = listing.encode_cursor(b"k", "mtime", "desc", 5, "f1")
    assert listing.decode_cursor(b"k", c, "mtime", "desc")["pid"] == "f1"
    for bad in (c[:-1] + ("A" if c[-1] != "A" else "B"), "x"):
        with pytest.raises(listing.CatalogError):
            listing.decode_cursor(b"k", bad, "mtime", "desc")
    with pytest.raises(listing.CatalogError):
        listing.decode_cursor(b"k", c, "name", "desc")
    for n in (0, 1001, "5"):
        with pytest.raises(listing.CatalogError):
            listing.limit_of(n)


def test_metadata_filter_is_strict(spark):
    rows = ['{"a":1,"b":{"c":[1,2]}}', '{"a":"1"}', '{"a":true}', '{"a":1.0}', "not json", None, '{"b":{"c":[2,1]}}']
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, m string")
    ids = lambda f: sorted(r.k for r in df.where(listing.metadata_matches(F.col("m"), f)).collect())
    assert ids({"a": 1}) == [0, 3]
    assert ids({"a": "1"}) == [1]
    assert ids({"a": True}) == [2]
    assert ids({"b": {"c": [1, 2]}}) == [0]
    assert ids({"b": {"c": [{"x": 1}]}}) == []


def test_pages_are_disjoint_and_whole(spark):
    files = spark.createDataFrame([(f"f{k:03}", "u", None if k % 2 else "", f"n{k}", k, "h", "t/x", "complete", 0, k // 7, False, None) for k in range(100)], "file_id string, user_id string, parent_id string, file_name string, file_size long, file_hash string, mime_type string, status string, created_at long, updated_at long, archived boolean, head_version_id string")
    versions = spark.createDataFrame([], "path_id string, version_id string, deleted boolean, size long, mtime_ms long")
    tags = spark.createDataFrame([], "path_id string, tag string")
    seen, place = [], None
    while True:
        page = listing.list_files(files, versions, tags, limit=30, after_row=place).collect()
        if not page:
            break
        seen += [r.file_id for r in page]
        place = (page[-1].mtime, page[-1].file_id)
    assert seen == [f"f{k:03}" for k in sorted(range(100), key=lambda k: (-(k // 7), k))]


def test_split_and_read(spark):
    data = {"a": b"", "b": b"x" * 16, "c": bytes(range(200))}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "file_id string, data binary")
    got = {r.file_id: bytes(r.data) for r in chunks.read(chunks.split(df, 16)).collect()}
    assert got == data


def test_token_bucket_against_python(spark):
    rng = random.Random(3)
    rows = [(u, t) for u in ("a", "b") for t in sorted(rng.sample(range(10_000), 60))]
    want = {}
    for u, t in rows:
        tokens, last, ok, no = want.get(u, (3.0, t, 0, 0))
        tokens = min(3.0, tokens + (t - last) / 1000 * 2.0)
        want[u] = (tokens - 1, t, ok + 1, no) if tokens >= 1 else (tokens, t, ok, no + 1)
    got = folds.token_bucket(spark.createDataFrame(rows, "user_id string, ts long"), rate=2.0, burst=3.0)
    assert {r.user_id: (r.granted, r.refused) for r in got.collect()} == {u: w[2:] for u, w in want.items()}


def test_usage_clamps(spark):
    df = spark.createDataFrame([("a", 1, -5), ("a", 2, 3), ("a", 3, -10), ("a", 4, 2)], "k string, o int, d long")
    assert tuple(folds.usage(df, "k", "o", "d").first()) == ("a", 2, 3)


def test_compare_and_set_tells_null_from_empty(spark):
    rows = spark.createDataFrame([("a", None), ("b", ""), ("c", "v1")], "file_id string, head_version_id string")
    commands = spark.createDataFrame([("a", None, "n"), ("b", None, "n"), ("c", "v1", "n")], "file_id string, expected string, new string")
    assert {r.file_id: r.patched for r in mutations.compare_and_set(rows, commands).collect()} == {"a": True, "b": False, "c": True}


def test_zero_query_gives_nothing(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    assert search.top_k(v, [0.0, 0.0]).count() == 0
    assert [tuple(r) for r in search.top_k(v, [1.0, 0.0]).collect()] == [(1, 1.0), (2, 0.0)]


def murmur_in_python(text, seed):
    """The public 32-bit hash, byte by byte."""
    h, data = seed, text.encode()
    rotated = lambda x, r: (x << r | x >> (32 - r)) & 0xFFFFFFFF
    for k in range(0, len(data) // 4 * 4, 4):
        x = rotated(int.from_bytes(data[k : k + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h = (rotated(h ^ x, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    if rest := data[len(data) // 4 * 4 :]:
        h ^= rotated(int.from_bytes(rest, "little") * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def test_inodes_owners_and_places(spark):
    ids = ["", "a", "01J8XYZ", "000000000012", "longer than sixteen bytes"]
    want = [(murmur_in_python(i, 0x12345678) & 0x1FFFFF) << 32 | murmur_in_python(i, 0x9ABCDEF0) for i in ids]
    df = spark.createDataFrame([(i,) for i in ids], "i string")
    rows = df.select("i", arrow.inode(F.col("i")).alias("n"), arrow.user_number(F.col("i")).alias("u"), arrow.group_number(F.col("i")).alias("g")).collect()
    assert {r.i: (r.n, r.u, r.g) for r in rows} == {i: (w, murmur_in_python(i, 0x55534552), murmur_in_python(i, 0x47525550)) for i, w in zip(ids, want, strict=True)}
    best = max(range(32), key=lambda s: (murmur_in_python(f"f1:3:shard:u1:{s}", 0), -s))
    assert arrow.placed(["f1"], [3], ["u1"], 32).tolist() == [best]


def test_links_need_a_target_and_a_place(spark):
    files = spark.createDataFrame([("f", None, "a", "complete", None)], "file_id string, parent_id string, file_name string, status string, link_target string")
    folders = spark.createDataFrame([("d", None, "b")], "folder_id string, parent_id string, name string")
    asked = spark.createDataFrame([("1", "", "a", "t"), ("2", "", "b", "t"), ("3", "", "c", ""), ("4", "", "d", "t")], "file_id string, parent_id string, file_name string, link_target string")
    assert {r.file_id: r.code for r in mutations.linked(files, asked, folders)[1].collect()} == {"1": "EEXIST", "2": "EEXIST", "3": "EINVAL", "4": "OK"}


def long_addresses(spark, tmp_path):
    """Beyond 57 bytes Spark's base64 has several lines."""
    urls = ["http://a.net/" + "x" * n for n in (43, 44, 45, 46, 101, 102, 103, 400)] + ["http://é.net/?" + "日>" * 40, "", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    return urls


def test_long_addresses_come_back_from_base64(spark, tmp_path):
    urls = long_addresses(spark, tmp_path)
    assert {r.page_id: r.back for r in plans.QUERIES["encodings"](spark, str(tmp_path)).collect()} == dict(enumerate(urls))


def test_parts_of_long_addresses_are_in_one_line(spark, tmp_path):
    urls = long_addresses(spark, tmp_path)
    want = {k: None if u is None else base64.urlsafe_b64encode(u.encode()).decode().rstrip("=") for k, u in enumerate(urls)}
    assert {r.page_id: r.b64 for r in plans.QUERIES["path_parts"](spark, str(tmp_path)).collect()} == want


def test_places_of_many_chunks_are_found_at_once():
    r = random.Random(3)
    file, index, user = (["".join(r.choices("01aé日😀", k=r.randint(0, 12))) for _ in range(60)], [r.randint(0, 10 ** r.randint(1, 9)) for _ in range(60)], [r.choice(["", "u1", "ß"]) for _ in range(60)])
    low = lambda f, i, u, s: f"{f}:{i}:shard:{u}:{s}".encode("utf-16-le")[::2].decode("latin-1")
    hashes = [[int(arrow.murmur3([low(f, i, u, s)])[0]) for s in range(130)] for f, i, u in zip(file, index, user, strict=True)]
    for pool, full in ((1, frozenset()), (32, frozenset({0, 7})), (130, frozenset()), (3, frozenset(range(3)))):
        want = [max((s for s in range(pool) if s not in full), key=lambda s: (h[s], -s), default=-1) for h in hashes]
        assert arrow.placed(file, index, user, pool, full).tolist() == want
    start = time.monotonic()
    arrow.placed([str(k) for k in range(50_000)], [k % 7 for k in range(50_000)], ["u1"] * 50_000, 32)
    assert time.monotonic() - start < 2.5  # a string for each shard took 5 s


def test_sizes_of_metadata_are_told_without_writing_it_again(monkeypatch):
    most = arrow.BYTES
    texts = ['{"a":"' + "x" * n + '"}' for n in (5, most - 9, most - 8, most - 7, most)]
    texts += ['{"a":"' + "\\u00e9" * (most // 2 - 10) + '"}', '{"a":"' + "é" * (most // 2 - 3) + '"}', '{"a":' + " " * most + "1}", '{"a":[' + ",".join(["[" + ",".join(["1e5"] * 900) + "]"] * 12) + "]}", '{"a":"' + '\\"' * (most // 2) + '"}', '{"' + "k" * 1000 + '":"' + "x" * most + '"}']
    want = [len(json.dumps(json.loads(t), separators=(",", ":"), ensure_ascii=False).encode()) > most for t in texts]
    assert [arrow._too_large(t, json.loads(t)) for t in texts] == want and True in want and False in want
    def written(*a, **k):
        raise AssertionError("written again")
    monkeypatch.setattr(arrow.json, "dumps", written)
    assert arrow._too_large(texts[4], json.loads(texts[4])) and not arrow._too_large(texts[0], json.loads(texts[0]))


def test_path_parts_of_odd_urls_against_sql(spark, tmp_path, monkeypatch):
    import oracle

    urls = ["http://a/b\rc/d", "http://a /x", "http://a\u0085b/y", "a\nb/c", "a/b\n", "a/b\r", "a/b\n/", "\n/", "a/\n", "/", "", "x", None, "/a", "a//", "é/ü", "http://x/" + "y" * 300]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(oracle, "TABLES", [])
    sql = plans.ORACLE_SQL["path_parts"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert oracle.compare(plans.QUERIES["path_parts"](spark, str(tmp_path)), sql, "") == len(urls)
