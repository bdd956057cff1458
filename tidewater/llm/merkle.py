"""Document fingerprints: Merkle trees over sections, paragraphs and blocks of words, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import cut_lineage

BLOCK_WORDS = 4


def tree(text: Column) -> Column:
    """Nodes of the Merkle tree of a text, bottom up: leaves, paragraphs, sections, root.

    Sections end at a blank line, paragraphs at a line end, and leaves are blocks of four words with
    their white space, so the leaves in order are the whole text. A node is the MD5 of its children.
    """
    block = rf"\s*+(?:\S++\s*+){{1,{BLOCK_WORDS}}}+|\s++"

    def paragraph(part):
        leaves = F.transform(F.regexp_extract_all(part, F.lit(block), F.lit(0)), lambda b: F.md5(b))
        return leaves

    def section(part):
        return F.transform(F.split(part, "\n", -1), paragraph)

    return F.transform(F.split(text, "\n\n", -1), section)


def fingerprint(nodes: Column) -> Column:
    """The tree as a string ``root/sections/paragraphs/leaves``.

    The root is a whole MD5 and tests equality. Sections and paragraphs carry 8 digits and ``x`` with
    their number of children, leaves 6 digits, so differing branches can be followed down to a block.
    """
    def par_hash(leaves):
        return F.md5(F.concat(F.lit("p"), F.array_join(leaves, "")))

    def sec_hash(pars):
        return F.md5(F.concat(F.lit("s"), F.array_join(pars, "")))

    hashed = F.transform(nodes, lambda sec: F.transform(sec, lambda leaves: F.struct(
        par_hash(leaves).alias("h"), F.size(leaves).alias("n"), F.transform(leaves, lambda x: F.substring(x, 1, 6)).alias("short")
    )))
    sections = F.transform(hashed, lambda pars: F.struct(
        sec_hash(F.transform(pars, lambda p: p["h"])).alias("h"), F.size(pars).alias("n"),
        F.transform(pars, lambda p: F.concat(F.substring(p["h"], 1, 8), F.lit("x"), p["n"].cast("string"))).alias("pars"),
        F.flatten(F.transform(pars, lambda p: p["short"])).alias("leaves"),
    ))
    # The struct array is bound once by transforming a one-element array.
    bound = F.transform(F.array(sections), lambda secs: F.concat_ws(
        "/", F.md5(F.concat(F.lit("r"), F.array_join(F.transform(secs, lambda s: s["h"]), ""))),
        F.array_join(F.transform(secs, lambda s: F.concat(F.substring(s["h"], 1, 8), F.lit("x"), s["n"].cast("string"))), ","),
        F.array_join(F.flatten(F.transform(secs, lambda s: s["pars"])), ","),
        F.array_join(F.flatten(F.transform(secs, lambda s: s["leaves"])), ","),
    ))
    return F.element_at(bound, 1)


def _span(x: Column, y: Column, front: Column, back: Column) -> Column:
    """``front, back``: equal nodes at both ends of two lists, given how many the level above has settled."""
    def equal(p, q, known):
        rest = F.array_position(F.zip_with(F.slice(p, known + 1, F.size(p)), F.slice(q, known + 1, F.size(q)), lambda m, n: m.eqNullSafe(n)), False)
        return known + F.when(rest == 0, F.greatest(F.size(p) - known, F.lit(0))).otherwise(rest.cast("int") - 1)

    least = F.least(F.size(x), F.size(y))
    ends = F.struct(equal(x, y, front).alias("front"), equal(F.reverse(x), F.reverse(y), back).alias("back"))
    return _bind(ends, lambda e: F.struct(e["front"].alias("front"), F.least(e["back"], least - e["front"]).alias("back")))


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a one-element array is transformed."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _children(nodes: Column, count: Column) -> Column:
    """How many children the first ``count`` nodes have."""
    return F.aggregate(F.slice(nodes, 1, count), F.lit(0), lambda n, node: n + F.substring_index(node, "x", -1).cast("int"))


def _descend(a: Column, b: Column, use) -> Column:
    """``use`` of the levels ``sections, paragraphs, blocks`` of two fingerprints: lists ``x, y`` and their ``span``.

    Branches whose nodes are equal at either end of a level are not entered: their children are taken
    as equal, and the level below is compared between them only.
    """
    def lists(k):
        return F.struct(*[F.split(F.split_part(s, F.lit("/"), F.lit(k)), ",").alias(n) for s, n in ((a, "x"), (b, "y"))])

    def below(level, span, lower):
        front = _children(level["x"], span["front"])
        back = _children(F.reverse(level["x"]), span["back"])
        return _span(lower["x"], lower["y"], front, back)

    def with_span(level, span):
        return F.struct(level["x"].alias("x"), level["y"].alias("y"), span.alias("span"))

    none = F.lit(0)
    return _bind(F.struct(lists(2).alias("s"), lists(3).alias("p"), lists(4).alias("l")), lambda t: _bind(
        _span(t["s"]["x"], t["s"]["y"], none, none), lambda s: _bind(
            below(t["s"], s, t["p"]), lambda p: _bind(
                below(t["p"], p, t["l"]), lambda l: use(with_span(t["s"], s), with_span(t["p"], p), with_span(t["l"], l))
            ))))


def differing(a: Column, b: Column) -> Column:
    """Branches in which two fingerprints differ: ``sections, paragraphs, blocks``, each with positions ``was`` and ``now``.

    Positions count from 0 over the whole text, ``was`` in ``a`` and ``now`` in ``b``. Nodes are aligned
    from both ends of a level; between, equally many nodes are aligned one to one and equal ones left
    out, otherwise all of them differ. Equal fingerprints have no positions.
    """
    def positions(level):
        span, nx, ny = level["span"], F.size(level["x"]), F.size(level["y"])

        def run(n):
            end = n - span["back"]
            return F.when(end > span["front"], F.sequence(span["front"], end - 1)).otherwise(F.array().cast("array<int>"))

        def kept(n):
            return F.filter(run(n), lambda i: (nx != ny) | (F.get(level["x"], i) != F.get(level["y"], i)))

        return F.struct(kept(nx).alias("was"), kept(ny).alias("now"))

    return _descend(a, b, lambda s, p, l: F.struct(
        _bind(s, positions).alias("sections"), _bind(p, positions).alias("paragraphs"), _bind(l, positions).alias("blocks")
    ))


def _common(x: Column, y: Column) -> Column:
    """How many entries two lists have in common, repeats counted: both are sorted and walked once."""
    def walk(both):
        def step(at):
            return _bind(F.struct(F.get(both["x"], at["i"]).alias("p"), F.get(both["y"], at["j"]).alias("q")), lambda e: F.struct(
                (at["i"] + (e["p"] <= e["q"]).cast("int")).alias("i"), (at["j"] + (e["q"] <= e["p"]).cast("int")).alias("j"),
                (at["n"] + (e["p"] == e["q"]).cast("int")).alias("n"),
            ))

        nx, ny, start = F.size(both["x"]), F.size(both["y"]), F.struct(*[F.lit(0).alias(c) for c in "ijn"])
        return F.aggregate(
            F.sequence(F.lit(1), nx + ny), start, lambda at, _: F.when((at["i"] < nx) & (at["j"] < ny), step(at)).otherwise(at), lambda at: at["n"]
        )

    walked = _bind(F.struct(F.sort_array(x).alias("x"), F.sort_array(y).alias("y")), walk)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0).otherwise(walked)


def likeness(a: Column, b: Column) -> Column:
    """Share of blocks, repeats counted, that two fingerprints have in common, of the larger one; 1 for equal roots.

    Blocks outside the differing span that the descent finds are common as they are; those inside are
    matched in any order.
    """
    def share(s, p, l):
        def middle(x):
            return F.slice(x, l["span"]["front"] + 1, F.size(x) - l["span"]["front"] - l["span"]["back"])

        return (l["span"]["front"] + l["span"]["back"] + _common(middle(l["x"]), middle(l["y"]))) / F.greatest(F.size(l["x"]), F.size(l["y"]))

    return F.when(F.substring_index(a, "/", 1) == F.substring_index(b, "/", 1), 1.0).otherwise(
        _descend(a, b, lambda s, p, l: _bind(l, lambda bound: share(s, p, bound)))
    )


def fingerprints(docs: DataFrame, text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every whole text; null counts as empty."""
    return docs.withColumn(into, fingerprint(tree(F.coalesce(F.col(text_col), F.lit("")))))


def _order(docs: DataFrame) -> DataFrame:
    """``id, prev, need``: for every id the id before it (the last before the first) and the length of its cut."""
    ids = docs.groupBy("id").agg(F.max(F.length("text")).alias("n"))
    ranged = cut_lineage(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.max(F.struct("id", "n")).alias("last"))
    later = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("part", F.last("last").over(later).alias("before"))  # a row per partition
    final = ranged.agg(F.max(F.struct("id", "n")).alias("final"))
    prior = F.lag(F.struct("id", "n")).over(Window.partitionBy("part").orderBy("id"))
    found = ranged.withColumn("prior", prior).join(F.broadcast(ends), "part").join(F.broadcast(final))
    found = found.withColumn("prior", F.coalesce("prior", "before", "final"))
    return found.select("id", F.col("prior.id").alias("prev"), F.floor(F.col("prior.n") / 4).cast("int").alias("need"))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, one row per input row.

    The last quarter of the code points is replaced by the first as many of the next document in
    ascending id order, the first one after the last. Of several rows with one id, the one with the
    smallest text hash is the next document. ``edited_branches`` are the branches that the edit changed. A null text is empty. A row without an id has no next
    document: its last quarter is cut, and ``near_next`` is 0. Repeated rows give equal results; an
    empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    known = docs.filter("id is not null")
    order = cut_lineage(_order(known))
    # The text hash is taken above the join, so that both uses of the text ask for the same exchange.
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text"))) == 1
    sent = (
        known.join(order, "id").withColumn("first", first).filter("first")
        .select(F.col("prev").alias("id"), F.expr("left(text, need)").alias("head"), fingerprint(tree(F.col("text"))).alias("next_print"))
    )
    joined = known.join(sent, "id").unionByName(
        docs.filter("id is null").select("id", "text", F.lit("").alias("head"), F.lit(None).cast("string").alias("next_print"))
    )
    cut = F.floor(F.col("n_chars") / 4)
    edited = (
        joined.withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn("cut", cut.cast("int"))
        .withColumn("edited", F.concat(F.expr("left(text, cast(n_chars as int) - cut)"), F.expr("left(head, cut)")))
        .select(
            "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(tree(F.col("text"))).alias("fingerprint"),
            fingerprint(tree(F.col("edited"))).alias("edited_fingerprint"), "next_print",
        )
    )
    return edited.select(
        "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        F.coalesce(likeness(F.col("fingerprint"), F.col("next_print")), F.lit(0.0)).alias("near_next"),
        differing(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edited_branches"),
    )
