import gzip
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlens.llm import warc
from spanlens.llm.storage import new_folder, open_store
from spanlens.llm.warc import archive, base32_sha1, read_warc

PAGES = [
    (5, "http://a.net/", "<p>same</p>"), (3, "http://b.net/", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "http://b.net/", "<p>same</p>"),
    (1, "http://c.net/x\r\nWARC-Type: forged", "é\r\n\r\nWARC/1.1\r\n"), (2, "http://ü.net/", None), (4, "u", ""), (None, "n", "alone"),
    (None, "n", "<p>same</p>"), (7, "big", "long text \0 " * 200_000),
]


def frame(spark):
    return spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, record_type string, refers_to int")


def slow():
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in PAGES:
        data, least = (h or "").encode(), first.get(h or "")
        again = least is not None and i != least
        out.append((i, len(data), base32_sha1(data), "revisit" if again else "response", least if again else None))
    return sorted(out, key=str)


def digest(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark):
    path = new_folder(spark, "warc")
    assert digest(archive(frame(spark), path)) == slow()
    full = read_warc(spark, path, split_bytes=200).where("record_type = 'response' AND page_id = 7").collect()
    assert [r.payload.decode() for r in full] == [PAGES[-1][2]]
    uris = {r.page_id: r.target_uri for r in read_warc(spark, path, payload=False).collect()}
    assert uris[2] == "http://ü.net/" and uris[1] == "http://c.net/x%0D%0AWARC-Type: forged" and uris[9] is None


def test_small_payloads_are_all_responses(spark):
    got = archive(frame(spark), new_folder(spark, "warc"), least_bytes=5)
    assert [r.record_type for r in got.where("payload_bytes < 5").collect()] == ["response"] * 2


def test_unwanted_payloads_are_not_decoded(spark, monkeypatch):
    path = new_folder(spark, "warc")
    archive(frame(spark), path).collect()
    reader = warc.WarcReader({"path": path}, ["page_id", "payload"])
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.GreaterThan(("page_id",), 5), warc.EqualTo(("payload",), b"")]))
    assert len(left) == 1 and len(reader.tests) == 2
    decoded = []
    whole = warc._Member.block
    monkeypatch.setattr(warc._Member, "block", lambda self, n: decoded.append(n) or whole(self, n))
    rows = [r for span in reader.partitions() for b in reader.read(span) for r in b.to_pylist()]
    assert [r["page_id"] for r in rows] == [9] and len(decoded) == 1
    plan = read_warc(spark, path).where(F.col("record_type") == "revisit")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("isnotnull", "")


@pytest.mark.parametrize("packed", [True, False])
def test_files_without_index(spark, packed):
    path = new_folder(spark, "warc")
    archive(frame(spark), path).collect()
    store, inner = open_store(path)
    other = new_folder(spark, "warc")
    _, target = open_store(other)
    store.create_dir(target)
    for k, f in enumerate(store.get_file_info(warc.pafs.FileSelector(inner))):
        if f.path.endswith(".warc.gz"):
            data = open(f.path, "rb").read()
            open(f"{target}/{k}.warc" + ".gz" * packed, "wb").write(data if packed else gzip.decompress(data))
    assert digest(read_warc(spark, other, payload=False, verify=True)) == slow()
    assert read_warc(spark, other).where("page_id = 5").count() == 1


def test_time_without_index_grows_with_the_file(tmp_path):
    rng = np.random.default_rng(5)
    took = []
    for mb in (16, 64):
        data = [warc.write_record(i, "u", rng.bytes(32 << 10), "d", "response", None, "d") for i in range(mb * 32)]
        (tmp_path / "a.warc.gz").write_bytes(b"".join(data))
        reader = warc.WarcReader({"path": str(tmp_path)}, ["page_id"])
        start = time.process_time()
        assert sum(b.num_rows for span in reader.partitions() for b in reader.read(span)) == mb * 32
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 1


def test_one_member_of_many_records_and_pieces_of_any_size(tmp_path, monkeypatch):
    records = [gzip.decompress(warc.write_record(i, "u", b"x" * (i * 37 % 500), base32_sha1(b"x" * (i * 37 % 500)), "response", None, "d")) for i in range(200)]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(records[:100])) + gzip.compress(b"".join(records[100:])))
    for size in (1, 7, 4096):
        monkeypatch.setattr(warc, "_FLOW", size)
        reader = warc.WarcReader({"path": str(tmp_path), "verify": "true"}, ["page_id", "payload_bytes", "payload"])
        reader.tests = [warc.GreaterThan(("page_id",), 3)]
        rows = [r for span in reader.partitions() for b in reader.read(span) for r in b.to_pylist()]
        assert [(r["page_id"], r["payload"]) for r in rows] == [(i, b"x" * (i * 37 % 500)) for i in range(4, 200)]


def test_attempts_that_fail_leave_nothing(tmp_path):
    def batches(fail):
        rows = [{"page_id": 1, "url": "u", "payload": b"p", "payload_digest": "d", "record_type": "response", "refers_to": None}]
        yield warc.pa.RecordBatch.from_pylist(rows)
        if fail:
            raise OSError("lost")

    writer = warc.WarcWriter({"path": str(tmp_path)})
    (tmp_path / "other.part").write_bytes(b"of another job")
    with pytest.raises(OSError):
        writer.write(batches(True))
    repeated = writer.write(batches(False))
    writer.commit([writer.write(batches(False)), None])
    assert repeated.part not in {str(f) for f in tmp_path.iterdir()}
    assert len(list(tmp_path.iterdir())) == 3
    with pytest.raises(OSError):
        writer.write(batches(True))
    writer.abort([])
    assert len(list(tmp_path.iterdir())) == 3


def test_damage_is_found(spark):
    path = new_folder(spark, "warc")
    store, inner = open_store(path)
    store.create_dir(inner)
    open(inner + "/a.warc.gz", "wb").write(warc.write_record(1, "u", b"text", base32_sha1(b"other"), "response", None, "d"))
    with pytest.raises(Exception, match="does not match"):
        read_warc(spark, path, verify=True).collect()


def test_no_rows(spark):
    assert archive(frame(spark).limit(0), new_folder(spark, "warc")).collect() == []
