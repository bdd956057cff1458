"""Quality classifier, language mixtures, piece encoding and the pipeline."""

import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from tidewater.llm import langid, pieces, quality, queries, simhash

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def larger(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_on_held_out_ratings(spark, larger):
    rated = quality.graded(spark.read.parquet(f"{SF}/labels.parquet")).withColumn("part", F.col("doc_id") % 4)
    model = quality.fit_quality(larger, rated.filter("part != 0").drop("part"))
    got = quality.score_quality(larger, model).join(rated.filter("part = 0"), "doc_id").select("grade", "_tw_quality.*").toPandas()
    assert (np.diff(model.thresholds) >= 0).all()
    assert got.loc[got["grade"] == 2, "tail"].ge(quality.LEAST).mean() > 0.95
    assert got.loc[got["grade"] == 0, "tail"].lt(quality.LEAST).mean() > 0.9
    means = got.groupby("grade")["expected_grade"].mean()
    assert means[0] < means[1] <= means[2]


def test_ordinal_gradient_by_differences():
    rng = np.random.default_rng(0)
    rows = [rng.choice(60, 8, replace=False) for _ in range(600)]
    truth = rng.normal(size=60)
    score = np.array([truth[r].sum() for r in rows])
    grades = np.digitize(score + rng.logistic(size=600) * 0.3, [-1.0, 1.5])
    model = quality.fit_ordinal(rows, grades, 3)
    fitted = np.array([model.weights[r].sum() for r in rows])
    assert np.corrcoef(fitted, score)[0, 1] > 0.95
    tails = model.tails(fitted)
    assert (tails[:, 0] >= tails[:, 1]).all() and ((tails > 0.5).sum(axis=1) == grades).mean() > 0.85


def test_quality_without_ratings_and_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(odd, quality.graded(none))
    assert [r["tail"] for r in quality.score_quality(odd, model).select("_tw_quality.tail").collect()] == [0.5] * odd.count()
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 0), (2, None, 1), (3, 1, 1)], none.schema)
    assert {r["doc_id"]: r["grade"] for r in quality.graded(labels).collect()} == {1: 0, 2: 0, 3: 1}
    fitted = quality.fit_quality(odd, quality.graded(labels))
    assert quality.score_quality(odd, fitted).count() == odd.count()
    assert quality.select_quality(empty, quality.graded(labels)).columns == empty.columns


def brute_mixture(words, model, steps=6, penalty=2.0):
    """The same definition for one document, word by word."""
    logs = np.array([[model.logs[langid.word_ngrams([w])[0], j].sum(dtype=float) for j in range(len(model.languages))] for w in words])
    p = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -60))

    def em(share):
        for _ in range(steps):
            joint = p * share
            share = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        return share, np.log((p * share).sum(axis=1)).sum()

    k = len(model.languages)
    ranked, _ = em(np.full(k, 1 / k))
    order = np.argsort(-ranked, kind="stable")
    best, reached = np.eye(k)[order[0]], np.log(p[:, order[0]]).sum()
    for m in range(2, k + 1):
        begin = np.zeros(k)
        begin[order[:m]] = np.maximum(ranked[order[:m]], 1e-3)
        share, now = em(begin / begin.sum())
        if now - reached <= penalty * np.log(len(words) + 1):
            break
        best, reached = share, now
    return best


def test_mixtures_match_plain_em(larger):
    model = langid.fit_languages(larger)
    texts = [r["text"] for r in larger.orderBy("doc_id").limit(60).collect()]
    docs = [langid.letter_words(t) for t in texts]
    docs += [docs[0][:30] + docs[1][:30], []]
    got = langid.mixtures(docs, model)
    for words, share in zip(docs[:-1], got):
        np.testing.assert_allclose(share, brute_mixture(words, model), atol=1e-4)
    assert (got[-2] > 0).sum() == 2 and not got[-1].any()


def test_language_held_out(spark):
    got = queries.op8_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got["doc_id"], got["held_out"]))


def test_language_of_odd_rows(odd, empty, larger):
    model = langid.fit_languages(larger)
    found = {r["doc_id"]: (r["lang"], r["score"]) for r in langid.identify(odd, model).select("doc_id", "_tw_language.*").collect()}
    for gone in (3, 4, 10, 11):
        assert found[gone] == ("und", 0.0)
    nothing = langid.fit_languages(empty)
    assert nothing.languages == [] and {r[0] for r in langid.identify(odd, nothing).select("_tw_language.lang").collect()} == {"und"}
    assert langid.select_identified(empty, model).count() == 0


UNLEARNED = [
    "Съешь же ещё этих мягких французских булок, да выпей чаю.", "日本語の文章です いろはにほへとちりぬるを", "Η γρήγορη καφέ αλεπού πηδάει πάνω",
    "Zażółć gęślą jaźń i wszystko będzie dobrze", "pvcd lrtcbvltb hvpdjb nxkglbgl qwrtz kkjhgf zxcvb",
]


def test_unlearned_languages_and_random_letters_go(spark, larger):
    model = langid.fit_languages(larger)
    odd = spark.createDataFrame([(t,) for t in UNLEARNED], "text string")
    found = langid.identify(odd, model).select("_tw_language.*").collect()
    assert all(r["lang"] in model.languages and r["known"] < 0.01 for r in found)
    assert langid.select_identified(odd, model).count() == 0
    assert langid.select_identified(larger, model).count() >= 0.98 * larger.filter(r"text rlike '\\p{L}'").count()


def test_known_share_of_a_mixed_text(larger):
    """Half learned and half random words: the background takes the random half, as plain EM does."""
    model = langid.fit_languages(larger)
    words = langid.letter_words(larger.orderBy("doc_id").first()["text"])[:40]
    mixed = words + langid.letter_words(" ".join(UNLEARNED) * 5)[:40]
    shares, known = langid.fit_mixtures([mixed, words, []], model)
    logs = np.array([[model.logs[langid.word_ngrams([w])[0], j].sum(dtype=float) for j in range(len(model.languages))] for w in mixed])
    spoken = np.logaddexp.reduce(np.where(shares[0] > 0, np.log(np.maximum(shares[0], 1e-300)) + logs, -np.inf), axis=1)
    noise = np.array([-np.log(langid.SLOTS) * len(langid.word_ngrams([w])[0]) for w in mixed])
    share = 0.5
    for _ in range(24):
        share = np.mean(1 / (1 + np.exp(np.clip(noise - spoken, -60, 60)) * (1 - share) / share))
    assert known[0] == pytest.approx(share, abs=1e-3) and 0.4 < known[0] < 0.62 and known[1] > 0.95 and known[2] == 0


def brute_viterbi(text, known, model):
    """Best score of a text by plain dynamic programming, and one best segmentation."""
    if not text:
        return 0.0, []
    text = pieces.SPACE + text.replace(" ", pieces.SPACE)
    best = [(0.0, 0, None)]
    for e in range(1, len(text) + 1):
        options = []
        for k in range(max(0, e - model.longest), e):
            if text[k:e] in known:
                score, own = known[text[k:e]]
                options.append((best[k][0] + score, -k, [own]))
            elif k == e - 1:
                options.append((best[k][0] + model.unknown_score, -k, [int(model.byte_ids[b]) for b in text[k:e].encode()]))
        score, k, own = max(options)
        best.append((score, -k, own))
    e, ids = len(text), []
    while e:
        ids, e = best[e][2] + ids, best[e][1]
    return best[-1][0], ids


def test_pieces_match_plain_viterbi_and_round_trip(spark, documents, odd):
    model = pieces.load_pieces()
    reader = sentencepiece.SentencePieceProcessor(model_file=pieces.PIECE_FILE)
    plain = [i for i in range(reader.get_piece_size()) if not (reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i))]
    known = {reader.id_to_piece(i): (reader.get_score(i), i) for i in plain}
    for docs in (documents, odd):
        both = pieces.decode(pieces.encode(docs.select("text")), F.col("_tw_pieces.ids")).collect()
        for r in both:
            assert r["decoded"] == r["text"] and r["_tw_pieces"]["round_trip"]
            if r["text"] is None:
                assert r["_tw_pieces"]["ids"] is None
            elif len(r["text"]) < 6000:
                score, ids = brute_viterbi(r["text"], known, model)
                assert r["_tw_pieces"]["score"] == pytest.approx(score) and r["_tw_pieces"]["ids"] == ids


def test_decoding_agrees_with_the_library():
    model = pieces.load_pieces()
    reader = sentencepiece.SentencePieceProcessor(model_file=pieces.PIECE_FILE)
    rng = np.random.default_rng(4)
    for _ in range(200):
        text = "".join(chr(c) for c in rng.choice([32, 10, 97, 233, 0x4E2D, 0x1F600, 46], 12))
        assert pieces.decode_ids(np.array(reader.encode(text)), model) == text
    assert pieces.decode_ids(np.array([1, 2, 3 + 0xC3, -5, 10**6]), model).count("�") == 1


def test_pieces_of_empty_table(empty):
    assert pieces.decode(pieces.encode(empty), F.col("_tw_pieces.ids")).count() == 0


def test_drop_copies_keeps_one_of_each_group(documents, odd):
    for docs in (documents, odd):
        groups = simhash.simhash_groups(docs).toPandas()
        kept = simhash.drop_copies(docs)
        assert kept.columns == docs.columns
        rows = kept.select("doc_id").toPandas()["doc_id"]
        assert len(rows) == groups["root"].nunique()
        want = sorted(x for x in groups["component"].unique() if x == x)
        assert sorted(x for x in rows if x == x) == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = corpus_pipeline.cut_lineage(docs)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[1] < seen[0] and seen[2] <= seen[1] and seen[3] < seen[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.filter("not round_trip").count() == 0 and last.count() == seen[-1]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    clean = labels.filter("quality = 1 and toxic = 0")
    assert clean.join(first, "doc_id").count() > 0.98 * clean.count()


def test_pipeline_of_odd_and_empty_rows(spark, odd, empty):
    for start in (odd, empty):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
        docs.collect()


def test_registry_holds_the_queries():
    names = entry_points.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_copies_do_not_crowd_out_a_language(spark):
    own = [(f"{a}{b}{c}" * 3, "xx") for a in "abcdefg" for b in "hijklm" for c in "nopqrst"]
    docs = spark.createDataFrame(own + [("copied words", "xx")] * 5000 + [("other words", "yy")] * 5, "text string, lang string")
    model = langid.fit_languages(docs, sample=400)
    logs = model.logs[:, model.languages.index("xx")]
    learned = [logs[langid.word_ngrams([t])[0]].min() > logs.min() for t, _ in own]
    assert len(own) == 294 and all(learned)
    once = langid.fit_languages(docs.distinct(), sample=400)
    assert once.languages == model.languages and (once.logs == model.logs).all()
