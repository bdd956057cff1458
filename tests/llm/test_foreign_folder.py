"""Operators run where only the driver can import the package."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
JOB = """
import sys
sys.path.insert(0, {root!r})
from tidewater.session import build_session
from tidewater.llm import langid, lm, pieces, quality
from pyspark.sql import functions as F
spark = build_session("foreign", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 20")
ratings = docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade"))
n = docs.count()
assert quality.score_quality(docs, quality.fit_quality(docs, ratings)).where("_tw_quality.tail between 0 and 1").count() == n
assert langid.identify(docs, langid.fit_languages(docs)).where("_tw_language.known > 0.5").count() == n
coded = pieces.encode(docs)
assert pieces.decode(coded, F.col("_tw_pieces.ids")).where("decoded = text").count() == n
assert lm.score(docs, F.col("doc_id") % 5 != 1).where("score < 0").count() == n
print("all ran", n)
"""


def test_operators_run_without_the_package_on_the_executors(tmp_path):
    ran = subprocess.run([sys.executable, "-c", JOB.format(root=str(ROOT))], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0 and "all ran" in ran.stdout, ran.stderr[-3000:]
