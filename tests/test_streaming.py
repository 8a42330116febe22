"""Chunks in any order fold to the windows that a whole read gives; caps and ends."""

import pytest

from tabscout.streaming import rolling


def test_fold_is_bounded():
    s = {"head": b"", "tail": b"", "seen": 0}
    for k in range(100):
        s = rolling.fold(s, bytes([k]) * 50, 120, 30)
    whole = b"".join(bytes([k]) * 50 for k in range(100))
    assert s == {"head": whole[:120], "tail": whole[-30:], "seen": 5000}


@pytest.mark.parametrize("limit, cap, size, error", [(10**6, None, 900, None), (100, None, None, None), (10**6, 500, 900, "BodyTooLargeError: more than 500 bytes")])
def test_streams(spark, tmp_path, limit, cap, size, error):
    data = bytes(i % 256 for i in range(900))
    rows = [("s", k, bytearray(data[k * 100 : k * 100 + 100]), False) for k in (3, 1, 0, 2, 8, 7, 6, 5, 4)] + [("s", 9, None, True)] + [("open", 0, bytearray(b"x"), False), ("empty", 0, None, True)]
    spark.createDataFrame(rows, "stream string, seq long, chunk binary, eof boolean").write.parquet(str(tmp_path / "in"))
    stream = rolling.rolling_windows(spark.readStream.schema("stream string, seq long, chunk binary, eof boolean").parquet(str(tmp_path / "in")), 64, 32, limit, cap)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {r["stream"]: r for r in spark.read.schema(rolling.OUTPUT).parquet(str(tmp_path / "out")).collect()}
    r = got["s"]
    assert (r["size"], r["read_error"]) == (size, error)
    assert set(got) == {"s", "empty"} and got["empty"]["size"] == 0
    if error is None:
        assert bytes(r["head"]) == data[:64] and (r["tail"] and bytes(r["tail"])) == (data[-32:] if size else None)
