"""Vector codes against plain loops, WARC archives by round trips."""

import gzip
import hashlib
import math
import subprocess
import sys
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import codes, warc


def plain_codes(rows, parts, entries, rounds):
    """(id, label, code, error) per usable row and the books, in Python integers."""
    kept = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    width = len(kept[0][2]) // parts
    cut = [[tuple(v[k * width : (k + 1) * width]) for k in range(parts)] for _, _, v in kept]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]

    def nearest(k, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[k]))

    for _ in range(rounds):
        after = []
        for k in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[nearest(k, c[k])[1]].append(c[k])
            after.append([tuple(sum(col) // len(own[j]) for col in zip(*own[j])) if j in own else e for j, e in enumerate(books[k])])
        books = after
    out = []
    for (i, l, _), c in zip(kept, cut):
        found = [nearest(k, c[k]) for k in range(parts)]
        out.append((i, l, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return out, books


def vector_rows(n, size, seed, step=0.01):
    rng = np.random.default_rng(seed)
    grid = np.round(rng.normal(scale=0.2, size=(n, size)) / step) * step  # many equal parts and distances
    return [(int(i), None if i % 11 == 0 else int(i % 4), v.tolist()) for i, v in zip(rng.permutation(n), grid)]


@pytest.mark.parametrize("n, size, parts, entries, step", [(700, 16, 4, 16, 0.01), (300, 8, 8, 64, 0.05), (40, 6, 2, 64, 0.1), (1, 4, 2, 8, 0.1), (200, 4, 1, 5, 0.2)])
def test_codes_equal_plain_rounds(spark, n, size, parts, entries, step):
    rows = vector_rows(n, size, n, step)
    rows += [rows[0], (None, 1, [0.5] * size), (9_001, 2, None), (9_002, None, [0.1] * (size - 1) + [float("nan")]), (9_003, 1, [float("inf")] * size), (9_004, 1, [None] * size)]
    want, books = plain_codes(rows, parts, entries, 2)
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    frame = frame.withColumns({c: F.lit("clash") for c in ("id", "code", "error", "part", "entry", "n", "vector")})
    coded, got = codes.vector_codes(frame, parts=parts, entries=entries)
    assert got.tolist() == [[list(e) for e in b] for b in books]
    assert sorted(map(tuple, coded.collect()), key=str) == sorted(want, key=str)
    sums = defaultdict(int)
    for _, label, _, error in want:
        sums[label] += error
    marked = codes.with_label_error(coded).collect()
    assert len(marked) == len(want) and all(r["label_error"] == sums[r["label"]] for r in marked)
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert codes.codebooks_digest(got) == hashlib.sha256(text.encode()).hexdigest()


def test_blocks_and_leaves_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK_COMPONENTS", 16 * 40)
    rows = vector_rows(500, 16, 3)
    want, _ = plain_codes(rows, 4, 16, 2)
    coded, _ = codes.vector_codes(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), parts=4, entries=16)
    assert sorted(map(tuple, coded.collect()), key=str) == sorted(want, key=str)


def test_whole_nodes_are_assigned():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-5, 5, (500, 3)) + c for c in ([0, 0, 0], [1000, 0, 0], [0, 1000, 1000])])
    tree, book = codes.Boxes(points, codes.LEAF), np.array([[0, 0, 0], [1000, 0, 0], [0, 1000, 1000], [0, 0, 0]])
    entry, whole = codes.assign(tree, book, codes.Boxes(book, 1))
    want = ((tree.points[:, None] - book) ** 2).sum(axis=2).argmin(axis=1)
    assert (entry == want).all() and sum(b - a for a, b, _ in whole) >= 900


def test_codes_of_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    coded, books = codes.vector_codes(none)
    assert coded.count() == 0 and books.size == 0 and codes.with_label_error(coded).count() == 0
    mixed = spark.createDataFrame([(1, 0, [0.1] * 4), (2, 0, [0.2] * 8), (3, 0, []), (4, 0, [0.3] * 4), (5, 0, [1e30] * 4)], "vec_id long, label int, embedding array<float>")
    assert sorted(r["id"] for r in codes.vector_codes(mixed, parts=2)[0].collect()) == [1, 4]


PAGES = [
    (5, "http://a/5", "p" * 150), (3, "http://a/3", "p" * 150), (3, "http://a/3", "p" * 150), (None, None, "p" * 150), (8, None, None), (9, "http://a/9", ""),
    (10, "http://b/ä ö\r\nInjected: 1", "é" * 60), (11, "http://b/11", "é" * 49), (12, "http://b/12", "é" * 49), (13, "http://b/13", "WARC/1.1\r\n\r\n" * 9000), (14, "u", "é" * 60), (None, None, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return frame.withColumns({c: F.lit("clash") for c in ("id", "digest", "bytes", "n", "type", "archive", "offset", "copy", "body")})


@pytest.fixture(scope="module")
def index(pages):
    return warc.write_archives(pages, archive_bytes=500)


def test_records_of_pages(index):
    got = sorted(((r["page_id"], r["type"], r["bytes"], r["digest"], r["refers_to_page"]) for r in warc.read_records(index, bodies=False).collect()), key=str)
    firsts = {"p" * 150: 3, "é" * 60: 10, PAGES[9][2]: 13}
    want, responded = [], set()
    for page, _, html in PAGES:
        html = html or ""
        data = html.encode()
        first = firsts.get(html)
        revisit = first is not None and (page != first or first in responded)
        if first is not None and page == first:
            responded.add(first)
        want.append((None if page is None else str(page), "revisit" if revisit else "response", len(data), hashlib.sha256(data).hexdigest(), str(first) if revisit else None))
    assert got == sorted(want, key=str)


def test_index_names_every_record(index, tmp_path):
    rows = index.collect()
    assert len(rows) == len(PAGES) and len({r["record_id"] for r in rows}) == len(PAGES) and len({r["archive"] for r in rows}) > 1
    by_archive = defaultdict(list)
    for r in rows:
        by_archive[r["archive"].removeprefix("file://")].append(r)
    for name, records in by_archive.items():
        data = open(name, "rb").read()
        records.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in records] == [sum(x["length"] for x in records[:k]) for k in range(len(records))]
        assert sum(r["length"] for r in records) == len(data)
        assert gzip.decompress(data) == b"".join(gzip.decompress(data[r["offset"] : r["offset"] + r["length"]]) for r in records)
        for r in records:
            one = gzip.decompress(data[r["offset"] : r["offset"] + r["length"]])
            assert one.startswith(b"WARC/1.1\r\nWARC-Type: " + r["type"].encode()) and one.endswith(b"\r\n\r\n")
            assert b"\r\nInjected: 1" not in one
    urls = sorted((str(r["url"]) for r in rows))
    assert urls == sorted(str(u) for _, u, _ in PAGES)


def test_selected_records_and_bodies(index):
    chosen = warc.read_records(index.filter("url = 'http://b/13'")).collect()
    assert [r["body"] for r in chosen] == [PAGES[9][2]]
    whole = warc.resolve(index, warc.read_records(index)).collect()
    bodies = sorted((str(r["page_id"]), r["body"]) for r in whole)
    assert bodies == sorted((str(p), h or "") for p, _, h in PAGES)


def test_damage_is_noticed(pages):
    index = warc.write_archives(pages.filter("page_id = 13"))
    row = index.first()
    path = row["archive"].removeprefix("file://")
    data = gzip.decompress(open(path, "rb").read()).replace(b"WARC/1.1\r\n\r\nWARC", b"WARC/1.1\r\n\r\nWARX", 1)
    open(path, "wb").write(gzip.compress(data))
    with pytest.raises(Exception, match="damaged record"):
        warc.read_records(index.withColumn("length", F.lit(len(gzip.compress(data))).cast("long"))).collect()


def test_ranges_are_coalesced():
    places = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 200, 10), ("b", 0, 10), ("b", 5, 500)]
    got = [(n, s, l, len(r)) for n, s, l, r in warc.coalesced(iter(places), gap=30, most=100)]
    assert got == [("a", 0, 45, 3), ("a", 200, 10, 1), ("b", 0, 10, 1), ("b", 5, 500, 1)]


def test_many_copies_of_a_row_and_no_rows(spark):
    many = spark.range(2500).select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.when(F.col("id") % 2 == 0, F.lit("y" * 200)).alias("html"))
    read = warc.read_records(warc.write_archives(many), bodies=False)
    assert sorted(tuple(r) for r in read.groupBy("type", "bytes").count().collect()) == [("response", 0, 1250), ("response", 200, 1), ("revisit", 200, 1249)]
    assert read.select("record_id").distinct().count() == 2500
    empty = warc.write_archives(many.filter("false"))
    assert empty.count() == 0 and warc.read_records(empty).count() == 0


def test_package_need_not_be_on_the_executors(tmp_path):
    """The three queries from a foreign folder, with the package on the driver's path only."""
    script = tmp_path / "run.py"
    script.write_text(
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from tidewater.session import build_session\n"
        "from tidewater.llm import queries\n"
        "s = build_session('foreign', 'local[2]', **{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'})\n"
        "print('rows', [queries.QUERIES[q](s, '/root/testdata/sf0.001').count() for q in ('op11_variants', 'op12_codes', 'op13_warc')])\n"
    )
    repo = __file__.rsplit("/tests/", 1)[0]
    done = subprocess.run([sys.executable, str(script), repo], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows [" in done.stdout, done.stderr[-2000:]
