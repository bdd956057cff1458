"""Sharding, Merkle fingerprints and mixing against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewater.llm import merkle, mixing, sharding


def check_shards(frame, docs, shards):
    got = frame.toPandas()
    assert len(got) == docs.count()
    sizes = got.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    want = Counter((None if d is None else int(d), 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t in docs.select("doc_id", "text").collect())
    have = Counter((None if x.id != x.id or x.id is None else int(x.id), x.size_, x.text_crc32) for x in got.rename(columns={"size": "size_"}).itertuples())
    assert have == want


def test_shards_hold_their_law(documents, odd):
    check_shards(sharding.shard_rows(documents, 40), documents, 40)
    check_shards(sharding.shard_rows(odd, 4, replicas=8, cells=64), odd, 4)


def test_only_overflow_leaves_its_home_shard(spark, documents):
    placed = sharding.shard_rows(documents, 8, replicas=32, cells=1024)
    home = sharding.ring(spark, 8, 32, 1024).select("cell", "owner")
    both = placed.withColumn("cell", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(1024))).join(home, "cell").toPandas()
    load = both.groupby("owner").size()
    cap = {s: len(both) // 8 + (s < len(both) % 8) for s in range(8)}
    assert (both["shard"] != both["owner"]).sum() == sum(max(0, n - cap[s]) for s, n in load.items())


def test_ring_owner_is_next_node_clockwise(spark):
    rows = sharding.ring(spark, 5, 4, 64).orderBy("cell").toPandas()
    nodes = {}
    for s, r, c in spark.range(20).select((F.col("id") / 4).cast("int").alias("s"), (F.col("id") % 4).alias("r")).select("s", "r", F.pmod(F.xxhash64("s", "r"), F.lit(64))).collect():
        nodes[c] = min(s, nodes.get(c, 99))
    for cell, owner in zip(rows["cell"], rows["owner"]):
        at = next(c % 64 for c in range(cell, cell + 64) if c % 64 in nodes)
        assert owner == nodes[at]


def test_empty_table_has_no_shards(empty):
    assert sharding.shard_rows(empty, 4, replicas=4, cells=64).count() == 0


def brute_edits(rows):
    order = sorted({d for d, _ in rows if d is not None})
    first = {}
    for d, t in rows:
        first.setdefault(d, t or "")
    out = []
    for d, t in rows:
        t = t or ""
        cut = len(t) // 4
        head = first[order[(order.index(d) + 1) % len(order)]] if d is not None else ""
        out.append((d, len(t), hashlib.sha256((t[: len(t) - cut] + head[:cut]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_edits_match_plain_python(request, name):
    docs = request.getfixturevalue(name)
    got = merkle.compare_edits(docs).toPandas()
    rows = [(d, t) for d, t in docs.select("doc_id", "text").collect()]
    have = sorted(((None if d != d else int(d), n, s) for d, n, s in zip(got["id"], got["n_chars"], got["edited_sha256"])), key=str)
    assert have == brute_edits(rows)
    assert got["near_edited"].between(0, 1).all() and got["near_next"].between(0, 1).all()
    if name == "documents":
        assert got["near_edited"].median() > 0.7 and got["near_next"].median() < 0.2


def test_fingerprints_are_equal_exactly_for_equal_texts(documents, odd):
    for docs in (documents, odd):
        rows = merkle.fingerprints(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("text", "fingerprint").collect()
        assert len({t for t, _ in rows}) == len({f for _, f in rows}) == len(set(rows))


def test_fingerprint_counts_its_branches(spark):
    text = "a b c d e\nsecond line\n\nnew section"
    frame = spark.createDataFrame([(text,), (text.replace("second", "other"),)], "text string")
    (a,), (b,) = merkle.fingerprints(frame).select("fingerprint").collect()
    root, sections, paragraphs, leaves = a.split("/")
    assert [s.split("x")[1] for s in sections.split(",")] == ["2", "1"]
    assert [p.split("x")[1] for p in paragraphs.split(",")] == ["2", "1", "1"]
    assert len(leaves.split(",")) == 4
    changed = [i for i, (x, y) in enumerate(zip(paragraphs.split(","), b.split("/")[2].split(","))) if x != y]
    assert changed == [1] and root != b.split("/")[0]


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > cap * sizes[s]]
        if not above:
            return {**fixed, **share}
        fixed.update({s: cap * sizes[s] for s in above})


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_mix_meets_targets(request, name):
    docs = request.getfixturevalue(name)
    rows = mixing.mix(docs).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    want = brute_targets(dict(sizes))
    words = sorted(len((t or "").encode().split()) for (t,) in docs.select("text").collect())
    assert words == sorted(r["size"] for r in rows)
    for s in want:
        assert target[s] == pytest.approx(want[s])
        if name == "documents":
            assert abs(taken[s] - want[s]) <= max(r["size"] for r in rows if r["source"] == s)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_copies_follow_their_expectation(spark):
    units = spark.range(300).select(
        F.lit("s").alias("source"), "id", F.xxhash64("id").alias("h"), (F.col("id") % 9 + 5).alias("size"), F.lit(0.3).alias("p")
    )
    totals = Counter()
    for seed in range(8):
        got = mixing.round_copies(units, seed=10 * seed).collect()
        assert len(got) == 300 and sum(r["extra"] for r in got) in (89, 90, 91)
        totals.update(r["id"] for r in got if r["extra"])
    assert max(totals.values()) <= 8 and len(totals) > 200


def test_mixed_rows_repeat_whole_rows(documents, empty):
    out = mixing.mixed_rows(documents)
    assert out.columns == documents.columns
    want = sum(r["copies"] for r in mixing.mix(documents).collect())
    assert out.count() == want
    assert mixing.mixed_rows(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_merkle_of_empty_table(empty):
    assert merkle.compare_edits(empty).count() == 0


def counted_blocks(text):
    return Counter(b for line in text.split("\n") for b in re.findall(r"\s*(?:\S+\s*){1,4}|\s+", line))


def test_likeness_counts_repeats_and_descends(spark):
    line = "one two three four five six seven eight\n"
    first = "\n\n".join(f"{k}a b c d {k}e f g h\nnext {k} of it" for k in range(6))
    pairs = [
        (line * 1000, line), (line * 953 + "a b c d", line * 700 + "e f g h"), (first, first.replace("3e f", "3e x")), (first, "new words come first\n\n" + first),
        (first, "\n\n".join(reversed(first.split("\n\n")))), ("", "a b c"), (first, first), (first, first.replace("1a", "1z").replace("4e", "4z")),
    ]
    frame = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pairs)], "k int, x string, y string")
    prints = merkle.fingerprints(merkle.fingerprints(frame, "x", "p"), "y", "q")
    rows = prints.select("k", merkle.likeness(F.col("p"), F.col("q")).alias("near"), merkle.differing(F.col("p"), F.col("q")).alias("d")).orderBy("k").collect()
    for row, (x, y) in zip(rows, pairs):
        a, b = counted_blocks(x), counted_blocks(y)
        want = 1.0 if x == y else (a & b).total() / max(a.total(), b.total())
        assert row["near"] == pytest.approx(want, abs=1e-9), row["k"]
    got = [{level: (part["was"], part["now"]) for level, part in row["d"].asDict().items()} for row in rows]
    assert got[2] == {"sections": ([3], [3]), "paragraphs": ([6], [6]), "blocks": ([10], [10])}
    assert got[3] == {"sections": ([], [0]), "paragraphs": ([], [0]), "blocks": ([], [0])}
    assert got[4]["sections"] == ([0, 1, 2, 3, 4, 5], [0, 1, 2, 3, 4, 5])
    assert all(not was and not now for was, now in got[6].values())
    assert got[7]["sections"] == ([1, 4], [1, 4]) and got[7]["blocks"] == ([3, 13], [3, 13])
