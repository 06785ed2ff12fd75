import base64
import gzip
import hashlib
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vendorscope.llm.warc import NULL_BLOCK, block_runs, read_warc, warc_round_trip, write_warc

PAGES = "page_id long, url string, html string"
ROWS = [(5, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://c/\r\nX: y", ""),
        (9, "u", "é\U0001F600"), (7, "u", "y" * 200_000), (1030, "v", "<p>x</p>"), (8, "w", "q\r\n\r\nq"), (8, "w", "q\r\n\r\nq")]


def expected(rows):
    first = defaultdict(lambda: 1 << 60)
    for i, _, h in rows:
        first[h or ""] = min(first[h or ""], i)
    out, seen = [], set()
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        body = (h or "").encode()
        response = i == first[h or ""] and (h or "") not in seen
        seen.add(h or "")
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "response" if response else "revisit", None if response else first[h or ""]))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(4)
    assert sorted((tuple(r) for r in warc_round_trip(pages).collect()), key=str) == expected(ROWS)


def test_equal_rows_give_equal_files_and_rolls(spark, tmp_dir):
    import random
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdef") for _ in range(3000))) for i in range(60)]
    sums = []
    for n, parts in enumerate((2, 5)):
        pages = spark.createDataFrame(rows, PAGES).repartition(parts)
        root = os.path.join(tmp_dir, str(n))
        manifest = write_warc(pages, root, block_ids=16, roll_bytes=6000, run_bytes=40_000)
        sums.append(sorted(tuple(r) for r in manifest.collect()))
        assert sorted(f for f in os.listdir(root) if not f.startswith(".")) == [r[0] for r in sums[-1]]   # no temporary names stay
        back = {r.page_id: r for r in read_warc(spark, root, manifest).collect()}
        assert {i: bytes(r.payload).decode() for i, r in back.items()} == {i: h for i, _, h in rows}
        assert all(back[i].url == u for i, u, _ in rows)
    assert sums[0] == sums[1] and len(sums[0]) > 4
    assert all(r[1] < 6000 + 3000 for r in sums[0])


def test_readers_open_only_what_the_manifest_lists(spark, tmp_dir):
    root = os.path.join(tmp_dir, "w")
    manifest = write_warc(spark.createDataFrame(ROWS, PAGES), root)
    listed = manifest.collect()
    with open(os.path.join(root, listed[0].file), "rb") as f, open(os.path.join(root, "stray.warc.gz"), "wb") as out:
        out.write(f.read())
    assert read_warc(spark, root, manifest).count() == len(ROWS)


def test_members_are_plain_gzip(spark, tmp_dir):
    root = os.path.join(tmp_dir, "w")
    manifest = write_warc(spark.createDataFrame([(1, "u", "body")], PAGES), root).collect()
    with gzip.open(os.path.join(root, manifest[0].file)) as f:
        raw = f.read()
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"body\r\n\r\n")


def test_null_ids_empty_and_clashing_columns(spark):
    pages = spark.createDataFrame([(None, "u", "a", 1), (3, "u", "a", 2), (None, None, "b", 3)],
                                  PAGES + ", payload int")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc_round_trip(pages).collect() if r.page_id)
    assert got == [(3, "revisit", None)]                                  # the null id is smallest: it is the response
    assert warc_round_trip(pages).count() == 3
    assert warc_round_trip(pages.filter("false")).count() == 0


@pytest.mark.parametrize("fault", ["missing", "altered", "cut", "count"])
def test_files_must_be_what_the_manifest_says(spark, tmp_dir, fault):
    root = os.path.join(tmp_dir, "w")
    manifest = write_warc(spark.createDataFrame(ROWS, PAGES), root, block_ids=4, run_bytes=1)
    name = sorted(r.file for r in manifest.collect())[1]
    path = os.path.join(root, name)
    with open(path, "rb") as f:
        data = f.read()
    if fault == "missing":
        os.rename(path, os.path.join(root, "elsewhere"))
    elif fault == "count":
        manifest = manifest.withColumn("records", F.col("records") + 1)
    else:
        with open(path, "wb") as f:
            f.write(data[:-1] if fault == "cut" else data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(Exception, match="No such file|manifest"):
        read_warc(spark, root, manifest).count()


def test_small_blocks_share_files_up_to_the_roll_size(spark, tmp_dir):
    import random
    rng = random.Random(2)
    rows = [(i * 50, "u", "".join(rng.choice("abcdefgh") for _ in range(800))) for i in range(400)]
    manifest = write_warc(spark.createDataFrame(rows, PAGES).repartition(3), os.path.join(tmp_dir, "w"), block_ids=100,
                          roll_bytes=20_000, run_bytes=200_000).collect()
    blocks = len({i * 50 // 100 for i in range(400)})
    assert sum(r.records for r in manifest) == 400 and len(manifest) < blocks / 4
    assert all(r.bytes < 20_000 + 2_000 for r in manifest)
    assert sum(r.bytes >= 20_000 for r in manifest) >= len(manifest) * 0.6


def test_runs_are_prefix_sums_of_block_sizes(spark):
    sizes = [(b, 1 + b * 7 % 13) for b in (*range(-3, 9000, 37), NULL_BLOCK, NULL_BLOCK + 5)]
    want, total, first = {}, 0, {}
    for b, size in sorted(sizes):
        want[b] = first.setdefault(total // 50, b)
        total += size
    got = block_runs(spark.createDataFrame(sizes, "block long, size long").repartition(5), 50).collect()
    assert {r.block: r.run for r in got} == want


def test_many_null_ids_spread_over_runs(spark, tmp_dir):
    rows = [(None, "u", f"text {i % 90}") for i in range(180)]
    root = os.path.join(tmp_dir, "w")
    manifest = write_warc(spark.createDataFrame(rows, PAGES), root, run_bytes=5000)
    assert manifest.count() > 10
    back = read_warc(spark, root, manifest).collect()
    assert sorted(r.record_type for r in back) == ["response"] * 90 + ["revisit"] * 90
