"""SimHash groups, vector groups and license scans against brute force."""

import numpy as np
import pytest
import xxhash

from tidewater.llm import licenses, neardup_vectors, simhash
from tidewater.llm.common import components


def plain_components(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_print(text, width=4):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_simhash_groups(request, name):
    docs = request.getfixturevalue(name)
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_print(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    label = plain_components(len(rows), links)
    low = {}
    for (doc, _), c in zip(rows, label):
        if doc is not None:
            low[c] = min(doc, low.get(c, doc))
    want = sorted(((d, p, low.get(c)) for (d, _), p, c in zip(rows, prints, label)), key=str)
    got = simhash.simhash_groups(docs).collect()
    assert sorted(((r["id"], r["fp"] % 2**64, r["component"]) for r in got), key=str) == want


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base.copy()
    for k in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, near, [np.uint64(0), np.uint64(15), np.uint64(2**64 - 1)]]))
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    n = len(prints)
    i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]) <= 4)
    want = plain_components(n, zip(i.tolist(), j.tolist()))
    at = {int(x): k for k, x in enumerate(prints.view(np.int64))}
    found = simhash.links(frame, 4).collect()
    assert plain_components(n, [(at[r["u"]], at[r["v"]]) for r in found]) == want


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(200)] + [(500, 300), (300, 900)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert all(got[k] == 0 for k in range(201)) and got[500] == got[900] == got[300] == 300


def test_neardup_of_empty_tables(spark, empty):
    assert simhash.simhash_groups(empty).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neardup_vectors.vector_groups(none).count() == 0
    assert licenses.scan(empty).count() == 0


def brute_vectors(rows, threshold=0.9):
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None for (_, v), ok in zip(rows, usable)]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if usable[i] and usable[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold
    ]
    return links


def test_vector_groups_on_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    links = brute_vectors(rows)
    label = plain_components(len(rows), links)
    got = {r["id"]: r for r in neardup_vectors.vector_groups(frame).collect()}
    n = np.bincount(np.array(links, int).ravel(), minlength=len(rows)) if links else np.zeros(len(rows), int)
    low = {}
    for (v, _), c in zip(rows, label):
        low[c] = min(v, low.get(c, v))
    for (v, _), count, c in zip(rows, n, label):
        assert (got[v]["n_links"], got[v]["component"], got[v]["kept"]) == (count, low[c], low[c] == v)


def test_hot_bucket_is_tiled_and_counted_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    hot = centre + 0.02 * rng.normal(size=(2500, 16))
    rest = rng.normal(size=(200, 16))
    data = [(k, v.tolist()) for k, v in enumerate(np.concatenate([hot, rest]))]
    got = {r["id"]: r for r in neardup_vectors.vector_groups(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert all(got[k]["n_links"] >= 2499 and got[k]["component"] == 0 for k in range(2500))
    assert sum(got[k]["n_links"] for k in range(2500)) == 2500 * 2499 or max(got[k]["n_links"] for k in range(2500)) < 2520


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v), (2, v), (2, v), (3, [2.0, 4.0, 6.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 2.0]),
        (8, [float("nan"), 1.0, 1.0]), (9, [float("inf"), 1.0, 1.0]), (10, [1.0, 2.0]), (None, v), (None, None), (11, [-1.0, -2.0, -3.0]),
        (12, [1e200, 2e200, 3e200]),
    ]
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, id string, cid int")
    got = sorted(((r["id"], r["n_links"], r["component"], r["kept"]) for r in neardup_vectors.vector_groups(frame).collect()), key=str)
    linked = [(1, 5, 1, True), (2, 5, 1, False), (2, 5, 1, False), (3, 5, 1, False), (12, 5, 1, False), (None, 5, 1, False)]
    alone = [(k, 0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11, None)]
    assert got == sorted(linked + alone, key=str)


def test_planted_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * side
    k, tables = neardup_vectors.settings(50_000, 0.9)
    met = (neardup_vectors.table_keys(a, k, tables, 2.0, 7) == neardup_vectors.table_keys(b, k, tables, 2.0, 7)).any(axis=1)
    assert met.mean() > 0.985


def brute_licenses(rows, known):
    out = set()
    for key, text in rows:
        have = licenses._shingle_set(licenses.license_words(text))
        out |= {(key, known.names[i]) for i, want in enumerate(known.sets) if len(have & want) >= 0.8 * len(want)}
    return out


def test_licenses_in_documents(documents):
    known = licenses.Templates(licenses.TEMPLATES)
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert {(r["id"], r["license"]) for r in licenses.scan(documents).collect()} == brute_licenses(rows, known)


def test_licenses_at_any_offset_and_with_changes(spark):
    known = licenses.Templates(licenses.TEMPLATES)
    rng = np.random.default_rng(3)
    rows = []
    for name in known.names:
        words = licenses.TEMPLATES[name].split()
        for k in range(40):
            own = list(words)
            if len(own) > 40 and k % 2:
                own[int(rng.integers(len(own)))] = "changed"
            before = [f"w{x}" for x in rng.integers(0, 9999, rng.integers(0, 400))]
            rows.append((len(rows), " ".join([*before, *own, "after", "it"])))
    got = {(r["id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_licenses(rows, known)


def test_license_scan_of_odd_rows(odd):
    assert licenses.scan(odd).count() == 0


def best_names(spark, texts, **more):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [set() for _ in texts]
    for r in licenses.scan(rows, **more).where("best").collect():
        out[r["id"]].add(r["license"])
    return out


def test_siblings_are_told_apart(spark):
    """Every template, alone and inside other words, is named as itself and not as its siblings."""
    known = licenses.Templates(licenses.TEMPLATES)
    texts = [f"{'before it ' * k} {licenses.TEMPLATES[n]} {'and after ' * k}" for n in known.names for k in (0, 7, 90)]
    got = best_names(spark, texts)
    assert got == [{n} for n in known.names for _ in range(3)]
    alike = {n: {known.names[j] for j in known.siblings[i]} for i, n in enumerate(known.names)}
    assert "AGPL-3.0 header" in alike["GPL-3.0 header"] and "MPL-2.0 header" not in alike["MIT grant"]


def test_both_of_two_licenses_in_one_text_are_best(spark):
    both = " ".join(licenses.TEMPLATES[n] for n in ("MIT grant", "Apache-2.0 header"))
    far = licenses.TEMPLATES["GPL-3.0 header"] + " word" * 400 + " " + licenses.TEMPLATES["AGPL-3.0 header"]
    assert best_names(spark, [both, far]) == [{"MIT grant", "Apache-2.0 header"}, {"GPL-3.0 header", "AGPL-3.0 header"}]


def test_short_notices_word_by_word(spark, odd, empty):
    texts = ["x. All rights\nreserved.", "cc by-sa 4.0", "CC BY 4.0 and CC-BY-NC-ND-3.0", "all rights are reserved", "", None, "ISC", "isc license; ISC License"]
    got = best_names(spark, texts, notices=licenses.SHORT_NOTICES)
    assert got == [{"All rights reserved"}, {"CC BY-SA 4.0 name"}, {"CC BY 4.0 name", "CC BY-NC-ND 3.0 name"}, set(), set(), set(), set(), {"ISC name"}]
    for frame in (odd, empty):
        assert licenses.scan(frame, notices=licenses.SHORT_NOTICES).count() == 0
