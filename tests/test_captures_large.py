"""Capture files of many packets: writing takes time in proportion to the packets, and a file has a bounded number of them."""

import glob
import io
import os
import time

import duckdb
import pyarrow as pa

from tapline.operators import extract
from tapline.parsers import capture
from tapline.plans import parser_queries as Q
from tapline.session import shared_folder
from tapline.sinks.capturebytes import classic, frame, udp

FOLDER = "/root/testdata/sf0.001"


def test_classic_in_proportion():
    one = frame("10.0.0.1", "1.2.3.4", udp(b"x" * 60, 5, 53))
    began = time.thread_time()
    data = classic([(k, one) for k in range(40_000)], nano=True)
    assert time.thread_time() - began < 5
    assert [p.ts_ns for p in capture.packets(io.BytesIO(data))] == list(range(40_000))


def test_files_are_bounded(spark, monkeypatch):
    """As small as a file may be, all packets of all files come back."""
    monkeypatch.setattr(Q, "PER_FILE", 7)
    before = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/captures-*"))
    got = Q.pcap_read(spark, FOLDER).toPandas()
    (place,) = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/captures-*")) - before
    sizes = []
    for name in os.listdir(place):
        if name.endswith(".pcap"):
            with open(f"{place}/{name}", "rb") as f:
                sizes.append(len(list(capture.packets(f))))
    assert max(sizes) == 7 and sum(sizes) == len(got)
    assert not glob.glob(f"{place}/*.part")
    c = duckdb.connect()
    for name in ("dns_tx", "dns_tx_ip"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    want = c.execute(Q.SQL["pcap_read"]).df()
    assert sorted(got[want.columns].itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


def test_rows_of():
    big = 2**60 + 1  # no float holds it
    columns = {"a": [big, None], "b": [1, 2], "c": [True, False], "d": [None, True], "e": ["x", None], "f": [b"\0", None], "g": [None, None]}
    batch = pa.RecordBatch.from_pydict(columns)
    got = list(extract.rows_of(batch))
    assert got == batch.to_pylist() and [type(v) for r in got for v in r.values()] == [type(v) for r in batch.to_pylist() for v in r.values()]
    assert list(extract.rows_of(batch.slice(0, 0))) == []
    assert list(extract.rows_of(batch.slice(1))) == batch.slice(1).to_pylist()
