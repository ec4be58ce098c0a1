"""Archives and chats: round trips, brute force, malformed input."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from readsearch.llm import chat, warc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(version):
    blocks = [b"", b"\n\n", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>x</p>", bytes(range(256))]
    data = warc.arc_file_header(version) + b"\n".join(warc.arc_record(version, f"http://a/{i} b", "2001", "text/html", b) for i, b in enumerate(blocks)) + b"\n"
    got = list(warc.read_arc(data))
    assert [r.block for r in got] == blocks and got[1].header["url"] == "http://a/1%20b" and set(got[0].header) == set(warc.FIELDS[version])
    for bad in (data[:-20], data.replace(b"filedesc", b"filedisc"), data.replace(f"\n{version} 0".encode(), b"\n7 0"), data + b"http://x 1.2.3.4\n"):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_arc(bad))


def test_arc_to_warc():
    rec = next(warc.read_arc(warc.arc_file_header(2) + warc.arc_record(2, "http://a/", "20030405060708", "text/html", warc.http_message("é".encode()))))
    one = warc.to_warc(rec, "4")
    assert one == warc.to_warc(rec, "4")
    ((headers, block),) = warc.read_warc(one + b"\r\n\r\n")
    assert headers["warc-date"] == "2003-04-05T06:07:08Z" and headers["warc-type"] == "response" and headers["warc-record-id"].startswith("<urn:uuid:")
    assert headers["warc-payload-digest"] == "sha1:" + hashlib.sha1("é".encode()).hexdigest() and warc.split_http(block)[1] == "é".encode()
    ((again, head),) = warc.read_warc(warc.to_warc(rec, "4", "urn:page:9") + b"\r\n\r\n")
    assert again["warc-type"] == "revisit" and again["warc-payload-digest"] == headers["warc-payload-digest"] and warc.split_http(head)[1] == b""
    plain = next(warc.read_arc(warc.arc_file_header(1) + warc.arc_record(1, "dns:a", "199", "text/dns", b"x")))
    assert b"WARC-Type: resource" in warc.to_warc(plain) and b"2000-01-01T00:00:00Z" in warc.to_warc(plain)
    for bad in (one, one + b"\r\n", b"junk\r\n\r\n"):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_warc(bad))


@pytest.mark.parametrize("version", [1, 2])
def test_archives(spark, tmp_path, version):
    big, tricky = "é" * 500, "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 40
    rows = [(1, "u 1\r\nX: y", big), (2, "u2", big), (3, "u3", tricky), (4, None, None), (5, "u5", ""), (6, "u6", "é" * 499), (7, "u7", "é" * 499), (8, "u8", tricky), (9, "u9", big), (9, "u9", big), (None, "n", big), (10, "l", "x" * 3_000_000)]
    given = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, refers_to string")
    path = str(tmp_path / "a")
    warc.write_archives(given, path, version)
    got = warc.read_archives(spark, path).collect()
    last = {big: 9, tricky: 8, "x" * 3_000_000: 10}
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        again = last[h] if p is not None and h in last and p < last[h] else None
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "response" if again is None else "revisit", again))
    assert sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == sorted(map(repr, want))
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")
    warc.write_archives(given.limit(0), str(tmp_path / "none"), version)
    assert warc.read_archives(spark, str(tmp_path / "none")).isEmpty()


def test_files_roll_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(i, f"u{i}", "x" * (60_000 if i == 7 else 3000) + str(i)) for i in range(40)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), str(tmp_path / "a"))
    sizes = [p.stat().st_size for p in (tmp_path / "a").glob("part-*")]
    assert len(sizes) >= 8 and sum(n > 20_010 for n in sizes) == 1
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == 40


def test_convert_arc_files(spark, tmp_path):
    import gzip

    binary = bytes(range(256)) * 40
    blocks = [b"", b"\n\nx", warc.http_message(b"<p>a</p>"), b"HTTP/1.0 200 OK\r\n\r\n" + binary, binary]
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for version, name in ((1, "one.arc"), (2, "deep/two.arc.gz"), (1, "three.arc.gz")):
        records = [warc.arc_file_header(version)] + [warc.arc_record(version, f"http://{version}/{i}", "20010203040506", "image/x", b) + b"\n" for i, b in enumerate(blocks)]
        data = b"".join(records)
        if name.startswith("deep"):
            data = b"".join(map(gzip.compress, records))
        elif name.endswith("gz"):
            data = gzip.compress(data)
        (tmp_path / "in" / name).write_bytes(data)
    (tmp_path / "in" / "other.txt").write_text("no archive")
    warc.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = warc.read_archives(spark, str(tmp_path / "out")).collect()
    kinds = ["resource", "resource", "response", "response", "resource"]
    want = [(f"http://{v}/{i}", k, warc.split_http(b)[1], "2001-02-03T04:05:06Z") for v in (1, 2, 1) for i, (b, k) in enumerate(zip(blocks, kinds))]
    assert sorted((r["uri"], r["record_type"], bytes(r["payload"]), r["date"]) for r in got) == sorted(want)
    assert len({r["record_id"] for r in got}) == 15 and all(r["page_id"] is None for r in got)
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "cut.arc.gz").write_bytes(data[:-300])
    with pytest.raises(Exception, match="ArchiveError"):
        warc.convert(spark, str(bad), str(tmp_path / "out2"))


def test_chats(spark):
    rng = random.Random(1)
    bits = ["</s>", "<s>", "[INST] ", " [/INST]", "<<SYS>>\n", "[ROLE=a]", "[/ROLE]", "&lt;", "&amp;", "&", "]", "a", " ", "\n", "é", "\\", "$1"]
    convs = {i: [(rng.choice(["system", "user", "assistant", "tool", "=x]", "", None]), "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(1, 7))] for i in range(150)}
    convs[200] = [("user", None), ("assistant", "x[" * 50000)]
    rows = [(i, k, r, t, 0) for i, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int"))
    back = {r["conv_id"]: r for r in chat.read_chats(made).collect()}
    for i, turns in convs.items():
        assert [(x["role"], x["text"]) for x in back[i]["turns"]] == [(r, t or "") for r, t in turns]
        assert [x["loss"] for x in back[i]["turns"]] == [r == "assistant" for r, _ in turns]
    for r in made.collect():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert all(s["kind"] == "text" for s in r["segments"] if s["loss"])


def test_chat_machine(spark):
    orders = {0: "sua", 1: "u", 2: "uau", 3: "s", 4: "au", 5: "uu", 6: "sa", 7: "uaa", 8: "usa", 9: "ux"}
    name = {"s": "system", "u": "user", "a": "assistant", "x": None}
    rows = [(i, k, name[c], "t") for i, o in orders.items() for k, c in enumerate(o)]
    got = {r["conv_id"]: r["broken_at"] for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: None, 2: None, 3: 1, 4: 0, 5: 1, 6: 1, 7: 2, 8: 1, 9: 1}
    alone = spark.createDataFrame([(None, 0, "user", "a")] * 3 + [(1, 5, "user", "b")] * 2 + [(1, 5, "assistant", "c"), (1, None, None, None)], "conv_id long, turn long, role string, text string")
    got = sorted((r["conv_id"] or 0, r["n_turns"], [(t["role"], t["text"]) for t in r["turns"]]) for r in chat.read_chats(chat.format_chats(alone)).collect())
    assert got == [(0, 1, [("user", "a")])] * 3 + [(1, 4, [(None, ""), ("assistant", "c"), ("user", "b"), ("user", "b")])]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(empty).isEmpty() and chat.read_chats(chat.format_chats(empty)).isEmpty()
    plan = chat.read_chats(chat.format_chats(empty))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_op10_runs_its_machine(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "x"), (3, 0, "system", "s")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    made = chat.op10_chat(spark, str(tmp_path))
    assert {r["conv_id"]: r["broken_at"] for r in made.collect()} == {1: None, 2: 0, 3: 1, -7: None}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert all(state in plan for state in chat.MACHINE) and "Python" not in plan
