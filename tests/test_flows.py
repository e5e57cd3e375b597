import json
import time

from skywave.sources import lines
from skywave.streaming import flows


def test_single_sentences_are_streamed(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [(0.0, "!AIVDM,1,1,,A,13u?etPv2;0n:dDPwUM1U1Cb069D,0*00"), (1.0, "!AIVDM,2,1,3,A,abc,0*00"), (2.0, "!AIVDM,2,2,3,A,def,2*00"), (3.0, "!AIVDM,1,1,,B,15M,2*00")]
    (src / "a.json").write_text("\n".join(json.dumps({"at": a, "line": x}) for a, x in rows))
    stream = spark.readStream.schema("at double, line string").json(str(src))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        q = flows.assembled(lines.nmea_fields(stream)).writeStream.format("memory").queryName("singles").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        end = time.time() + 40  # the timeout of its state keeps the query going
        while spark.table("singles").count() < 3 and time.time() < end:
            time.sleep(0.5)
        q.stop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    batch = lines.assemble(lines.nmea_fields(spark.createDataFrame(rows, "at double, line string")), "at")
    want = [(0.0, "13u?etPv2;0n:dDPwUM1U1Cb069D", 0), (2.0, "abcdef", 2), (3.0, "15M", 2)]
    assert sorted(tuple(r) for r in spark.table("singles").collect()) == sorted(tuple(r) for r in batch.collect()) == want
