import json
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import json, re, sys

sys.path.insert(0, sys.argv[1])
import pyarrow as pa
from pyspark.sql import SparkSession

from pairloom import ship
from pairloom.llm import decontam, quality, simhash

spark = ship(SparkSession.builder.master("local[1]").config("spark.ui.enabled", False).config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
docs = spark.range(0, 20_000, 1, 1).selectExpr("id as doc_id", "array_join(transform(sequence(1, 300), i -> hex(hash(id, i))), ' ') as text")
items = docs.limit(20).selectExpr("doc_id as item_id", "text")


def held(batches):
    from pairloom.llm import decontam, quality, simhash  # noqa: F401

    n = sum(batch.num_rows for batch in batches)
    found = int(re.search("RssAnon:\\\\s+([0-9]+)", open("/proc/self/status").read())[1]) >> 10
    yield pa.RecordBatch.from_pydict({"mb": [found]})


def now():
    return spark.range(0, 1, 1, 1).mapInArrow(held, "mb long").first()["mb"]


found = {"start": now()}
for name, made in {
    "keep_good": lambda: quality.keep_good(docs, quality.AttentionModel()),
    "describe": lambda: simhash.describe(docs),
    "decontaminate": lambda: decontam.decontaminate(docs, items),
}.items():
    made().write.format("noop").mode("overwrite").save()
    found[name] = now()
print("held", json.dumps(found))
"""


def test_idle_workers_hold_little(tmp_path):
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(Path(__file__).parents[2]), str(tmp_path)], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert run.returncode == 0, run.stderr[-2000:]
    found = json.loads(run.stdout.rpartition("held ")[2])
    start = found.pop("start")
    assert max(found.values()) < start + 50, (start, found)
