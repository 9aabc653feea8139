import base64
import gzip
import hashlib

import pytest

from recordmill.llm.warc import archived, lookup, open_folder, parse_record, read_records, url_key, write_archives, write_index

SCHEMA = "page_id long, url string, html string, file string, offset long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a clashing name", 7) for r in rows], SCHEMA)


ROWS = [
    (5, "https://a.example.com/x?y#z", "<p>one</p>"), (3, "https://b.example.com/", "<p>one</p>"),
    (9, "http://a.example.com/x?y", "<p>one</p>"), (1, None, ""), (2, "no host", None), (4, "https://ä.de/ü\r\nX: y", "ü" * 9),
    (7, "https://a.example.com/x?y", "two"), (7, "https://a.example.com/x?y", "two"), (7, "https://z.org", "two"),
    (None, "https://n.org", "two"), (None, "https://n.org", "alone"), (None, None, "alone"), (8, "https://l.org", "<p>" * 90_000),
    *[(100 + k, "https://hot.example.com/same", f"<i>{k % 40}</i>") for k in range(120)],
]


def expected(rows, least=0):
    holder = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= least and i is not None:
            holder[data] = min(holder.get(data, i), i)
    out, taken = [], set()
    for i, _, h in rows:
        data = (h or "").encode()
        first = holder.get(data)
        revisit = first is not None and (i != first or data in taken)
        if first is not None and i == first:
            taken.add(data)
        out.append((repr(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", repr(first if revisit else None)))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 4])
def test_round_trip(spark, least):
    rows = archived(pages(spark, ROWS), least_bytes=least).collect()
    assert sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, repr(r.refers_to))
                  for r in rows) == expected(ROWS, least)
    html = {r.payload for r in rows if r.record_type == "response"}
    assert html == {(h or "").encode() for _, _, h in ROWS}


def test_files_index_and_lookups(spark, tmp_path):
    folder = f"file://{tmp_path}/archive"
    entries = write_archives(pages(spark, ROWS), folder)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shards = write_index(entries, f"{folder}/index", block=4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.count() > 1 and sorted(r["first"] for r in shards.collect())[0] <= "com,example"
    found = lookup(spark.createDataFrame([("https://a.example.com/x?y#other",), ("https://hot.example.com/same",),
                                          ("https://not.there/",)], "url string"), shards, f"{folder}/index")
    keys = sorted(r.key for r in found.collect())
    assert keys == ["com,example,a)/x?y"] * 4 + ["com,example,hot)/same"] * 120
    assert read_records(found, folder).where("record_type = 'response'").count() == 40 + 1
    # the archives are ordinary gzip files of records, one after another
    system, base = open_folder(folder)
    records = 0
    for info in {r.file for r in entries.collect()}:
        with system.open_input_file(f"{base}/{info}") as file:
            records += gzip.decompress(file.read()).count(b"WARC/1.1\r\nWARC-Type: ")
    assert records == len(ROWS)
    row = entries.where("page_id = 4").first()
    with system.open_input_file(f"{base}/{row.file}") as file:
        file.seek(row.offset)
        warc, http, payload = parse_record(file.read(row.length))
    assert warc["warc-target-uri"] == "https://ä.de/ü%0D%0AX:%20y" and payload == ("ü" * 9).encode()


def test_url_keys():
    assert [url_key(u) for u in ["HTTPS://A.b.ORG/P q?x#f", "http://a.org", "a/b", None, "x://"]] == [
        "org,b,a)/P%20q?x", "org,a)/", ")a/b", ")", ")/"]


def test_empty(spark):
    assert archived(pages(spark, [])).collect() == []
