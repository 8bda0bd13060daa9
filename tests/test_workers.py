"""Python workers must not need the package on their own path."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
PROGRAM = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from custodia.session import local_session
from custodia.operators import batching, retrieval, annotate, mail
from custodia.sources import files
spark = local_session(2)
df = spark.createDataFrame([("a", 5), ("b", 6)], "relative_path string, size_bytes bigint")
assert [r["batch"] for r in batching.plan_batches(df, 10, 5).orderBy("relative_path").collect()] == [0, 1]
vectors = spark.createDataFrame([(1, [1.0, 0.0], "Records", ["a@x"], "E1")], "chunk_id bigint, embedding array<float>, category string, entitled_emails array<string>, extracted_employee_id string")
asked = spark.createDataFrame([(7, [1.0, 0.1], "a@x", "E2", ["g"])], "query_id bigint, embedding array<float>, email string, employee_id string, groups array<string>")
assert retrieval.vector_search(vectors, asked, 3, secured=True).count() == 1
words = spark.createDataFrame([("x", "hel")], "annotator string, keyword string")
docs = spark.createDataFrame([(1, "Hello")], "doc_id int, text string")
assert annotate.annotate(docs, words).count() == 1
assert retrieval.embed(docs, lambda texts: [[1.0] for _ in texts], text="text").count() == 1
assert mail.extract_attachments(spark.createDataFrame([("m", bytearray(b"x"))], "path string, content binary")).count() == 0
assert files.list_files(spark, {str(REPO / "custodia")!r}, "plans").filter("relative_path like '%.py'").count() == 2
print("fine")
"""


def test_workers_without_the_package(tmp_path):
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-3000:]
