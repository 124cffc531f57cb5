"""Chat formatting and WARC archives."""

import io
import random

from pyspark.sql import functions as F

from placewright.llm import op07_chat as op7
from placewright.llm import op09_warc as op9

from .test_simple_ops import oracle, same

SF = "/root/testdata/sf0.01"
CONV = "conv_id long, turn long, role string, text string"


def test_chat_oracle(spark):
    same(op7.op7_chat(spark, SF), oracle(op7.ORACLE, SF))


def test_chat_round_trip(spark):
    rng = random.Random(5)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "\\", " ", "\n", "<", "[", "/", "s>", "]", "x", "é😀", "$1"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "[ROLE]", "a\\[/ROLE]"]), rng.choice([None, "", *["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(9)]])) for c in range(150) for t in range(rng.randint(1, 6))]
    out = op7.format_chats(spark.createDataFrame(rows, CONV)).withColumn("back", op7.read_turns(F.col("formatted")))
    for r in out.collect():
        want = [(role or "", text or "") for c, _, role, text in rows if c == r.conv_id]
        assert [tuple(t) for t in r.back] == want
        assert [s.loss for s in r.segments].count(True) == sum(role == "assistant" for role, _ in want)


def test_chat_machine_and_odd(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "b"), (3, 0, "system", "s"), (3, 1, "user", "u"), (4, 0, "user", "a"), (4, 0, "user", "a"), (None, None, None, None), (5, 0, "system", ""), (5, 1, "user", ""), (5, 2, "assistant", "")]
    df = spark.createDataFrame(rows, CONV).withColumn("valid", F.lit(1)).withColumn("segments", F.lit(2))
    got = {r.conv_id: r.valid for r in op7.format_chats(df).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True, None: False}
    assert op7.format_chats(df.limit(0)).count() == 0


def test_warc_oracle(spark):
    same(op9.op9_warc(spark, SF), oracle(op9.ORACLE, SF))


def test_warc_archives(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * (300 if i % 2 else 3)) for i in range(400)]
    rows += [(None, None, None), (900, "a\nb é", ""), (901, "u", "é" * 500), (902, "u", "é" * 500), (902, "u", "é" * 500), (None, "u", "é" * 500), (903, "u", "é" * 499 + "x"), (904, "u", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("x")).repartition(2)
    for archive, train in ((op9.ARCHIVE_BYTES, op9.TRAIN_BYTES), (40_000, 10_000)):
        monkeypatch.setattr(op9, "ARCHIVE_BYTES", archive)
        monkeypatch.setattr(op9, "TRAIN_BYTES", train)
        folder = str(tmp_path / f"w{archive}")
        manifest = op9.write(op9.dealt(df), folder)
        assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
        got = op9.read(manifest, folder).collect()
        by = {}
        for i, _, h in rows:
            by.setdefault(h or "", []).append(i)
        want = []
        for i, _, h in rows:
            group = by[h or ""]
            top = max((x for x in group if x is not None), default=None)
            again = len((h or "").encode()) >= 1000 and len(group) > 1 and i != top
            want.append((i, len((h or "").encode()), "revisit" if again else "response", top if again else None))
        assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)


def test_warc_dictionary_leads():
    out = io.BytesIO()
    out.close = lambda: None
    archive = op9.Archive(out)
    for i in range(400):
        archive.add(op9.record({"page_id": i, "url": f"http://x/{i}", "html": f"<p>hello {i} " * 40, "record_type": "response", "refers_to": None, "payload_digest": "0"}))
    archive.close()
    assert out.getvalue()[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert sum(1 for _ in op9.records(io.BytesIO(out.getvalue()))) == 400


def test_warc_dictionary_of_few_records():
    """An archive of one record or of very long ones has a dictionary too."""
    rng = random.Random(3)
    for n, length in ((1, 0), (1, 40), (2, 300), (6, 60_000), (5, 900_000)):
        out = io.BytesIO()
        out.close = lambda: None
        archive = op9.Archive(out)
        texts = ["".join(rng.choices("abc <>/p", k=length)) for _ in range(n)]
        for i, t in enumerate(texts):
            archive.add(op9.record({"page_id": i, "url": None, "html": t, "record_type": "response", "refers_to": None, "payload_digest": "0"}))
        archive.close()
        assert out.getvalue()[:4] == (0x184D2A5D).to_bytes(4, "little")
        assert [block.partition(b"\r\n\r\n")[2].decode() for _, block in op9.records(io.BytesIO(out.getvalue()))] == texts


def test_warc_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    from placewright.llm.common import shared_folder

    folder = f"{shared_folder(spark)}/placewright/empty"
    assert op9.read(op9.write(op9.dealt(df), folder), folder).count() == 0


def test_warc_ways(spark, monkeypatch):
    """Repeated payloads are broadcast or joined with the same result."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted(map(tuple, op9.dealt(pages).collect()))
    monkeypatch.setattr(op9, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, op9.dealt(pages).collect())) == want
