"""Spelling variants against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewater.llm import variants

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@pytest.fixture
def uncoalesced(spark):
    """Small tables in as many partitions as large ones have."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, before)


def plain_counts(rows, slip):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if slip and h % slip == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                out[word] += 1
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k:] == b[k + 1 :]


def plain_variants(counts, near):
    n = {w: c for w, c in counts.items() if c >= 3}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def all_pairs(words):
    return {w: {x for x in words if one_edit(w, x)} for w in words}


def by_masks(words):
    """Neighbours through all texts at one deletion or wildcard."""
    masks = defaultdict(set)
    for w in words:
        masks[w].add(w)
        for i in range(len(w)):
            masks[w[:i] + "*" + w[i + 1 :]].add(w)
            masks[w[:i] + w[i + 1 :]].add(w)
    return {w: {x for m in [w, *(w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in ("*", ""))] for x in masks[m] if one_edit(w, x)} for w in words}


def collected(frame):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in frame.collect())


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_variants_of_documents(request, name):
    docs = request.getfixturevalue(name)
    want = plain_counts([tuple(r) for r in docs.select("doc_id", "text").collect()], 97)
    counts = variants.word_counts(docs, slip=97)
    assert {r["word"]: r["n"] for r in counts.collect()} == want
    words = [w for w, c in want.items() if c >= 3]
    assert collected(variants.spelling_variants(counts)) == plain_variants(want, by_masks(words))


def test_variants_of_close_words_in_many_partitions(uncoalesced):
    words = ["aaaaa", "aaaaaa", "aaaab", "aaaba", "aabaa", "baaaa", "aaaaab", "baaaaa", "aabbaa", "aabba", "abbaa", "àbbaa", "Àbbaa", "xbbaa"]
    words += ["".join(x) for x in zip("ababa" * 8, "bbbbb" * 8, "aabba" * 8)] + ["abc" * k for k in range(2, 40)] + ["abc" * k + "d" for k in range(2, 40)]
    counts = {w: 3 + (7 * i) % 40 for i, w in enumerate(dict.fromkeys(words))} | {"tooseldom": 2}
    frame = uncoalesced.createDataFrame(list(counts.items()), "word string, n long")
    assert collected(variants.spelling_variants(frame)) == plain_variants(counts, all_pairs([w for w in counts if counts[w] >= 3]))


def test_nodes_are_one_to_one_with_prefixes(uncoalesced):
    words = sorted({"ab" * k + "c" * (j % 3) for k in range(1, 30) for j in range(6)} | {"ab" * 20 + c for c in "abcdefghij"})
    frame = uncoalesced.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, extra int").repartition(7)
    rows = variants.trie_nodes(frame, "word").collect()
    assert len({r["at"] >> variants.SCAN_BITS for r in rows}) > 1
    prefix_of, node_of = {}, {}
    for r in rows:
        assert len(r["nodes"]) == len(r["word"]) + 1 and words[r["extra"]] == r["word"]
        for k, node in enumerate(r["nodes"]):
            assert prefix_of.setdefault(node, r["word"][:k]) == r["word"][:k]
            assert node_of.setdefault(r["word"][:k], node) == node
    assert [r["word"] for r in sorted(rows, key=lambda r: r["at"])] == words


def test_long_words_and_long_chains(spark):
    long = [("x" * 50_000, 40), ("x" * 49_999, 20), ("x" * 25_000 + "y" + "x" * 24_999, 5)]
    chain = [("chain" + "abcdefgh"[:k], 3 * 2**k) for k in range(9)]
    got = {r["word"]: r for r in variants.spelling_variants(spark.createDataFrame(long + chain + [(None, 9)], "word string, n long")).collect()}
    assert got["x" * 49_999]["form"] == "x" * 50_000 and got["x" * 50_000]["n_near"] == 2
    assert got["x" * 25_000 + "y" + "x" * 24_999]["root"] == "x" * 50_000
    assert {got[w]["root"] for w, _ in chain} == {"chainabcdefgh"} and got["chainabcdefgh"]["form"] is None


def test_no_words(empty, spark):
    assert variants.spelling_variants(variants.word_counts(empty)).count() == 0
    none = spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string").withColumn("word", F.lit("clash"))
    assert variants.spelling_variants(variants.word_counts(none)).count() == 0
