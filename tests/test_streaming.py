from __future__ import annotations

from lodestone.streaming.running import running_pairs, running_twu
from tests.golden import TEXT


def drain(spark, frame, name):
    query = frame.writeStream.outputMode("complete").format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_running_bounds(spark, tmp_path):
    for k, line in enumerate(TEXT.splitlines()):
        (tmp_path / f"{k}.txt").write_text(line + "\n")
    stream = spark.readStream.option("maxFilesPerTrigger", 2).text(str(tmp_path))
    assert {r["item"]: r["twu"] for r in drain(spark, running_twu(stream), "twu")} == {1: 49, 2: 61, 3: 61, 4: 44, 5: 61, 6: 18, 7: 1}
    pairs = {(r["a"], r["b"]): r["twu"] for r in drain(spark, running_pairs(stream), "pairs")}
    assert pairs[2, 5] == 61 and pairs[1, 3] == 49
