"""Spelling variants: words one edit apart, found by joining integer pairs of trie nodes.

The words of the dictionary are sorted, and one ordered scan numbers the nodes of their trie: a word
opens a new node for every prefix that it doesn't share with the word before it. The same scan over
the reversed words numbers the suffixes. A word with one position skipped is then the pair (node of
what stands before, node of what stands after), and so is a word with a gap between two positions.
Two words differ in one replaced code point if they share a skip pair, and in one inserted code point
if a skip pair of the longer is a gap pair of the shorter. Both are equalities of two integers, so the
neighbours are exact. A skip pair is shared by at most as many words as the alphabet has letters, a gap
pair belongs to one word: no group grows with the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import cut_lineage

LETTERS = "A-Za-zÀ-ÿ"
# Words a task holds before it hands their counts on, and the bytes these may have.
HELD_WORDS, HELD_BYTES = 1 << 17, 1 << 24
# Node numbers a task holds before it writes them.
HELD_NODES = 1 << 20
# Texts above this many characters give their words one by one instead of as a list.
LONG_TEXT = 1 << 22
# Node numbers: the partition of the scan above this bit, its own count of nodes below.
SCAN_BITS = 40
GAP, SKIP_FIRST, SKIP = 0, 1, 2


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, slip: int | None = None) -> DataFrame:
    """``word, n``: maximal runs of letters of at least ``shortest`` code points, A-Z lower-cased, and their occurrences.

    With ``slip``, an occurrence whose hash ``h`` (crc32 of "<id>:<run>") is divisible by it loses code
    point ``h mod length``; the result counts as the word if it is still long enough. A null id counts
    as an empty one, a null text has no words; repeated rows count again. Every document is counted by
    itself first, so the work on a word is once per document. Other columns are not read.
    """
    letters = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def run(batches):
        held, size = Counter(), 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                runs = letters.findall(text) if len(text) < LONG_TEXT else (m.group() for m in letters.finditer(text))
                start = zlib.crc32(f"{key}:".encode())
                for found, n in Counter(runs).items():
                    plain = found.encode().lower()  # bytes: A-Z only
                    if slip and (h := zlib.crc32(plain, start)) % slip == 0:
                        word = plain.decode()
                        at = h % len(word)
                        plain = (word[:at] + word[at + 1 :]).encode()
                        if len(word) <= shortest:
                            continue
                    held[plain] += n
                    size += len(plain)
                if len(held) > HELD_WORDS or size > HELD_BYTES:
                    yield flush()
                    held, size = Counter(), 0
        if held:
            yield flush()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shared_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving: long words cost a few slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def trie_nodes(words: DataFrame, word_col: str) -> DataFrame:
    """``words`` (distinct in ``word_col``) with ``at``, its rank in code-point order (with gaps), and ``nodes``,
    the numbers of the trie nodes of its prefixes of length 0, 1, and so on.

    The scan runs over range partitions. The first words of a partition may share prefixes with words of
    earlier ones, which the scan of the partition can't know; the first and last word of every partition
    say which of its nodes those are, and they get the numbers of the earlier partition. That
    correction holds a number for each letter that two neighbouring partitions share.
    """
    rest = [f for f in words.schema if f.name != word_col]
    added = [T.StructField("at", T.LongType()), T.StructField("nodes", T.ArrayType(T.LongType())), T.StructField("edge", T.BooleanType())]
    schema = T.StructType([words.schema[word_col], *rest, *added])

    def run(batches):
        base = TaskContext.get().partitionId() << SCAN_BITS
        made, seen, last, stack = 0, 0, "", [0]
        held = None  # the newest rows go out one slice later: the last of them may be the end of the partition
        for batch in batches:
            begin, nodes, total = 0, [], 0
            for k, word in enumerate(batch.column(word_col).to_pylist()):
                common = shared_prefix(last, word)
                fresh = len(word) - common
                stack = stack[: common + 1] + list(range(base + made + 1, base + made + fresh + 1))
                made, last = made + fresh, word
                nodes.append(stack)
                total += len(stack)
                if total > HELD_NODES or k + 1 == batch.num_rows:
                    at = pa.array(range(base + seen, base + seen + len(nodes)), pa.int64())
                    edge = pa.array([seen + i == 0 for i in range(len(nodes))])
                    columns = [*batch.slice(begin, len(nodes)).columns, at, pa.array(nodes, pa.list_(pa.int64())), edge]
                    if held is not None:
                        yield held
                    held = pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "at", "nodes", "edge"])
                    seen, begin, nodes, total = seen + len(nodes), k + 1, [], 0
        if held is not None:
            edge = held.column("edge").to_pylist()
            edge[-1] = True
            yield held.set_column(held.schema.get_field_index("edge"), "edge", pa.array(edge))

    ordered = words.select(word_col, *[f.name for f in rest]).repartitionByRange(word_col).sortWithinPartitions(word_col)
    scanned = cut_lineage(ordered.mapInArrow(run, schema))
    fixes = _carried(scanned.filter("edge").select("at", F.col(word_col).alias("word"), "nodes").orderBy("at").collect())
    table = words.sparkSession.createDataFrame(fixes, "scan long, fix array<long>")
    # one row per scan partition
    joined = scanned.withColumn("scan", F.shiftright("at", SCAN_BITS)).join(F.broadcast(table), "scan", "left")
    own = F.col("scan") * F.lit(1 << SCAN_BITS)
    carried = F.transform("nodes", lambda x: F.when((x > own) & (x - own <= F.size("fix")), F.get("fix", (x - own - 1).cast("int"))).otherwise(x))
    return joined.withColumn("nodes", F.when(F.col("fix").isNull(), F.col("nodes")).otherwise(carried)).drop("scan", "fix", "edge")


def _carried(edges: list) -> list[tuple[int, list[int]]]:
    """Per scan partition, the numbers that its first nodes have in earlier partitions."""
    by_scan: dict[int, list] = {}
    for row in edges:
        by_scan.setdefault(row["at"] >> SCAN_BITS, []).append(row)
    fixes, last, stack = [], "", [0]
    for scan, rows in sorted(by_scan.items()):
        first, end = rows[0], rows[-1]
        known = stack[1 : shared_prefix(last, first["word"]) + 1]
        if known:
            fixes.append((scan, known))
        kept = min(len(known), shared_prefix(first["word"], end["word"]))
        last, stack = end["word"], stack[: kept + 1] + list(end["nodes"][kept + 1 :])
    return fixes


def near_words(words: DataFrame) -> DataFrame:
    """``at, word, n, n_near, best_n, best_at`` for a dictionary ``word, n`` of distinct words.

    ``n_near`` counts the words at one inserted, deleted or replaced code point, ``best`` is the one of
    largest n, the smallest in code-point order among equals (``at`` follows that order).
    """
    forward = cut_lineage(trie_nodes(words, "word"))
    backward = trie_nodes(forward.select(F.reverse("word").alias("reversed"), F.col("at").alias("id")), "reversed")
    both = forward.withColumnRenamed("nodes", "before").join(backward.select(F.col("id").alias("at"), F.col("nodes").alias("after")), "at")
    size = F.size("before") - 1
    letter = F.split("word", "")

    def pair(i, behind, kind):
        return F.struct(F.get("before", i).alias("before"), F.get("after", behind).alias("after"), kind.alias("kind"))

    # Deleting any letter of a run of equal letters gives one word: only the first of the run counts as its deletion.
    first = lambda i: (i == 0) | (F.get("letters", i) != F.get("letters", i - 1))
    skips = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: pair(i, F.col("size") - 1 - i, F.when(first(i), SKIP_FIRST).otherwise(SKIP)))
    gaps = F.transform(F.sequence(F.lit(0), F.col("size")), lambda i: pair(i, F.col("size") - i, F.lit(GAP)))
    pairs = both.select("at", "n", "before", "after", size.alias("size"), letter.alias("letters")).select("at", "n", F.explode(F.concat(skips, gaps)).alias("pair"))
    member = F.struct((-F.col("n")).alias("less"), "at", F.col("pair.kind").alias("kind"))
    groups = pairs.groupBy("pair.before", "pair.after").agg(F.sort_array(F.collect_list(member)).alias("members")).filter(F.size("members") > 1)

    def partners(x):
        skips_too = lambda y: (x["kind"] != GAP) & (y["kind"] != GAP) & (y["at"] != x["at"])
        deletion = lambda y: ((x["kind"] == GAP) & (y["kind"] == SKIP_FIRST)) | ((x["kind"] == SKIP_FIRST) & (y["kind"] == GAP))
        return F.filter("members", lambda y: skips_too(y) | deletion(y))

    seen = groups.select("members", F.explode("members").alias("x")).select(F.col("x.at").alias("at"), partners(F.col("x")).alias("found")).filter(F.size("found") > 0)
    best = F.min(F.struct(F.col("found")[0]["less"].alias("less"), F.col("found")[0]["at"].alias("at")))
    near = seen.groupBy("at").agg(F.sum(F.size("found").cast("long")).alias("n_near"), best.alias("best"))
    return forward.select("at", "word", "n").join(near, "at", "left").select(
        "at", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.less")).alias("best_n"), F.col("best.at").alias("best_at")
    )


def last_forms(links: DataFrame) -> DataFrame:
    """``at, root`` for links ``at, root`` to a form each, followed to the end by doubling: a few joins even for long chains."""
    hops = cut_lineage(links)
    while True:
        on = hops.select(F.col("at").alias("root"), F.col("root").alias("far"))
        hops = cut_lineage(hops.join(on, "root", "left").select("at", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if hops.filter("moved").isEmpty():
            return hops.select("at", "root")
        hops = hops.select("at", "root")


def spelling_variants(counts: DataFrame, least: int = 3, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``counts`` (``word, n``) with at least ``least`` occurrences.

    A word's form is its near word of largest n, if that is at least ``ratio`` (2 or more) times its own; else
    null. Its root is where its chain of forms ends, the word itself where there is none; n grows along a
    chain, so chains end. Words of any length are taken whole. Null words are left out; an empty table gives
    no rows.
    """
    words = cut_lineage(counts.filter(F.col("word").isNotNull() & (F.col("n") >= least)).select("word", "n"))
    near = near_words(words)
    formed = F.col("best_n") >= ratio * F.col("n")
    table = cut_lineage(near.select("at", "word", "n", "n_near", F.when(formed, F.col("best_at")).alias("form_at"), F.when(formed, F.col("best_n")).alias("form_n")))
    roots = last_forms(table.filter("form_at is not null").select("at", F.col("form_at").alias("root")))
    names = table.select(F.col("at").alias("named"), F.col("word").alias("name"))
    formal = table.join(names.withColumnsRenamed({"named": "form_at", "name": "form"}), "form_at", "left")
    rooted = roots.join(names.withColumnsRenamed({"named": "root", "name": "root_word"}), "root").select("at", "root_word")
    return formal.join(rooted, "at", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
