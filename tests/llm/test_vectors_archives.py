import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionloom.llm import embedding_dedup, warc
from captionloom.session import new_shared_path


def plain_links(rows, cosine):
    """``rows``: (id, vector or None, label)."""
    ok, units = [], []
    for _, v, label in rows:
        x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(0)
        good = label is not None and len(x) > 0 and np.isfinite(x).all() and x.any()
        ok.append(good)
        units.append(x / np.linalg.norm(x) if good else None)
    n = len(rows)
    linked = [[a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine for b in range(n)] for a in range(n)]
    label = [r[0] for r in rows]
    while True:
        new = [min([label[a]] + [label[b] for b in range(n) if linked[a][b]]) for a in range(n)]
        if new == label:
            break
        label = new
    return Counter((rows[a][0], sum(linked[a]), label[a], label[a] == rows[a][0]) for a in range(n))


def found(df, **params):
    return Counter(tuple(r) for r in embedding_dedup.near_dedup(df, **params).select("vec_id", "n_links", "component_id", "kept").collect())


@pytest.mark.parametrize("leaf,dim", [(8, 16), (40, 24), (1024, 13)])
def test_links_match_brute_force(spark, leaf, dim):
    rng = np.random.default_rng(leaf)
    centres = rng.standard_normal((12, dim))
    rows = []
    for i in range(260):
        v = centres[rng.integers(12)] + rng.standard_normal(dim) * rng.choice([0.02, 0.15, 0.3, 2.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.choice([0, 0, 0, 1]))))
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert found(df, leaf=leaf) == plain_links(rows, 0.93)
    assert found(df.repartition(3), leaf=leaf, cosine=0.8) == plain_links(rows, 0.8)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (1, v, 0), (2, v, 0), (3, v, None), (4, None, 0), (5, [], 0), (6, [0.0] * 4, 0), (7, [1.0, None, 3.0, 4.0], 0), (8, [1.0, float("nan"), 1.0, 1.0], 0),
        (9, [float("inf"), 1.0, 1.0, 1.0], 0), (10, [x * 1e-3 for x in v], 0), (11, [1.0, 2.0], 0), (12, [-x for x in v], 0), (13, v, 1), (14, [2.0, 4.0], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("id", F.lit("x")).withColumn("vec", F.lit("y"))
    assert found(df) == plain_links(rows, 0.93)
    more = df.union(df.where("vec_id = 1").withColumn("vec_id", F.lit(None).cast("bigint")))
    assert found(more) == plain_links(rows, 0.93) + Counter({(None, 0, None, True): 1})
    assert found(df.where("false")) == Counter() and embedding_dedup.near_dedup(df.where("vec_id = 4")).first()["kept"]


def test_one_leaf_of_many_equal_blocks_is_split(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0] * 8 + list(map(float, rng.standard_normal(8) * 0.4)), 0) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert found(df, leaf=10) == plain_links(rows, 0.93)


# ------------------------------------------------------------------ archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("id", F.lit(1)).withColumn("payload", F.lit("q"))


def resolved(spark, df, **params):
    path = new_shared_path(spark, "warc-test")
    warc.write_archives(warc.mark_revisits(warc.payloads(df), **params), path)
    records = warc.read_archives(spark, path)
    return path, records, Counter(tuple(r) for r in warc.resolve(records).collect())


def plain(rows, min_bytes=0):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= min_bytes:
            first[b] = min(i, first.get(b, i))
    out = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        other = first.get(b) if first.get(b) != i else None
        out[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if other is None else "revisit", other)] += 1
    return out


ODD = [
    (5, "http://a/x y\r\n", "same"), (3, "http://b", "same"), (9, None, "same"), (4, "http://c", None), (6, "http://d", ""), (7, "u", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\n"),
    (8, "u", "ünï\r\n\r\ncode 😀"), (None, "u", "lonely"), (None, "u", "same"), (10, "u", "z" * 300_000), (3, "http://b", "same"),
]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_archives_round_trip(spark, min_bytes):
    path, records, got = resolved(spark, pages(spark, ODD), min_bytes=min_bytes)
    assert got == plain(ODD, min_bytes)
    bodies = Counter((r["id"], bytes(r["payload"]).decode()) for r in records.where("record_type = 'response'").collect())
    assert bodies == Counter((i, h or "") for i, _, h in ODD if any(k[0] == i and k[3] == "response" and k[1] == len((h or "").encode()) for k in plain(ODD, min_bytes)))


def test_archives_of_the_pages_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    double = rows + [(i + 100_000, u, h) for i, u, h in rows[::3]]
    _, records, got = resolved(spark, pages(spark, double))
    assert got == plain(double) and records.where("record_type = 'revisit'").count() == len(rows[::3])
    digests = {r["id"]: (r["digest"], r["payload"]) for r in records.where("record_type = 'response'").collect()}
    assert all(d == base64.b32encode(hashlib.sha1(bytes(p)).digest()).decode() for d, p in digests.values())


def test_archives_of_nothing(spark):
    path = new_shared_path(spark, "warc-test")
    warc.write_archives(warc.mark_revisits(warc.payloads(pages(spark, ODD).where("false"))), path)
    assert warc.resolve(warc.read_archives(spark, path)).count() == 0


def test_parser_reads_any_pieces_and_refuses_cut_records():
    def rec(body):
        return b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"

    bodies = [b"", b"a\r\n\r\nb", b"x" * 5000, b"WARC/1.1\r\n"]
    data = b"".join(map(rec, bodies))
    for step in (1, 7, 4096):
        assert [b for _, b in warc.parse(data[k : k + step] for k in range(0, len(data), step))] == bodies
    zipped = b"".join(zlib.compress(rec(b), wbits=31) for b in bodies)
    assert [b for _, b in warc.parse(warc._unzipped(zipped, 100))] == bodies
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse([data[:-10]]))


def test_unzipping_grows_with_the_length_alone():
    import os
    import time

    def seconds(n):
        data = zlib.compress(os.urandom(n), 1, wbits=31)
        start = time.perf_counter()
        assert sum(map(len, warc._unzipped(data))) == n
        return time.perf_counter() - start

    small = min(seconds(8 << 20) for _ in range(3))
    assert seconds(64 << 20) < 8 * 3 * small + 0.2
    parts = [os.urandom(k) for k in (0, 1, 70_000, 0, 3 << 20)]
    data = b"".join(zlib.compress(p, wbits=31) for p in parts)
    assert all(b"".join(warc._unzipped(data, step)) == b"".join(parts) for step in (100, 4096, 1 << 20))
    bomb = zlib.compress(b"\0" * (50 << 20), wbits=31)
    assert max(map(len, warc._unzipped(bomb, 1 << 16))) <= 4 << 16
    with pytest.raises(ValueError, match="cut off"):
        list(warc._unzipped(data[:-5], 100))


def test_headers_of_records(spark):
    import datetime as dt

    path = new_shared_path(spark, "warc-heads")
    warc.write_archives(warc.mark_revisits(warc.payloads(pages(spark, [(2, "http://x/a b\r\nc\td", "same"), (1, "http://first/\x07", "same"), (3, None, "other")]))), path)
    raw = b"".join(b"".join(warc._unzipped(bytes(r.content))) for r in spark.read.format("binaryFile").load(path).collect())
    heads = {h["warc-record-id"]: h for h, _ in warc.parse([raw])}
    assert heads["<urn:record:2>"]["warc-target-uri"] == "http://x/a%20b%0D%0Ac%09d"
    assert heads["<urn:record:2>"]["warc-refers-to-target-uri"] == "http://first/_" and "warc-target-uri" not in heads["<urn:record:3>"]
    age = dt.datetime.now(dt.timezone.utc) - dt.datetime.fromisoformat(heads["<urn:record:1>"]["warc-date"].replace("Z", "+00:00"))
    assert dt.timedelta(0) <= age < dt.timedelta(minutes=10)
