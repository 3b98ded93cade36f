"""Readers on files written by hand."""

import json
import random
import re
import struct
import time

from pyspark.sql import functions as F

from uttermark.functions.util import running_sum
from uttermark.operators import labels
from uttermark.session import literal_table
from uttermark.sources import readers, writers


def test_bio_blank_policies(spark, tmp_path):
    d = tmp_path / "en" / "train"
    d.mkdir(parents=True)
    (d / "seq.in").write_text("a b\n\nc\n\n")
    (d / "seq.out").write_text("O B-x\n\nO O O\n")
    (d / "label").write_text("one\n\ntwo\n\n")
    keep = readers.read_bio(spark, str(tmp_path), blank="keep").orderBy("line_no").collect()
    assert [(r.line_no, r.tokens, r.tags, r.intent) for r in keep] == [(1, ["a", "b"], ["O", "B-x"], "one"), (3, ["c"], ["O"], "two")]
    drop = readers.read_bio(spark, str(tmp_path), blank="drop").orderBy("line_no").collect()
    assert [(r.line_no, r.intent) for r in drop] == [(1, "one"), (2, "two")]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    (tmp_path / "f.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        d = readers.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 1
        assert d.where("value <> concat('line ', line_no - 1)").count() == 0 and d.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_conll(spark, tmp_path):
    (tmp_path / "x.conll").write_text("the O O\nhall B-room I-room\n\n\nbad line\nred B-c B-c\n")
    got = readers.read_conll(spark, str(tmp_path)).orderBy("sent_no").collect()
    assert [(r.tokens, r.gold, r.pred) for r in got] == [(["the", "hall"], ["O", "B-room"], ["O", "I-room"]), (["red"], ["B-c"], ["B-c"])]


def test_nested_document(spark, tmp_path):
    doc = {
        "language": "en",
        "intents": {"Dim": {"utterances": [{"data": [{"text": "dim the "}, {"text": "hall", "slot_name": "room", "entity": "r"}]}, {"data": []}]}},
        "entities": {"r": {"data": [{"value": "hall", "synonyms": ["lobby"]}]}},
    }
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    p = str(tmp_path)
    for how, want in (("space", "dim the  hall"), ("concat", "dim the hall"), ("tokens", "dim the hall")):
        rows = readers.read_nested_nlu(spark, p, how).orderBy("utt_no").collect()
        assert [r.text for r in rows] == [want, ""]
    assert [tuple(r) for r in readers.read_entities(spark, p).collect()] == [("r", 0, "hall", ["lobby"])]


def test_audio_header(spark, tmp_path):
    head = b"RIFF" + struct.pack("<I", 36 + 32) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", 32)
    df = spark.createDataFrame([(bytearray(head + b"\0" * 32), "a.wav"), (bytearray(b"oops"), "b.wav")], "b binary, n string")
    writers.unpack_binary(df, "b", "n", str(tmp_path / "out"))
    got = {r.file: r for r in readers.file_inventory(spark, str(tmp_path / "out")).collect()}
    a, b = got["a.wav"], got["b.wav"]
    assert (a.valid, a.channels, a.sample_width, a.sample_rate, a.n_frames, a.duration, a.size) == (True, 2, 2, 8000, 8, 0.001, 76)
    assert (b.valid, b.n_frames, b.size) == (False, None, 4)


def test_json_answers(spark):
    rows = [
        '{"intent": "a", "slots": []}', '```json\n{"intent": "b"}\n```', 'Sure {oops} {"intent": "c", "slots": [{"slot_type": "s", "value": "v"}]} bye',
        '["intent"]', "nothing", '{"slots": {"x": {"y": 1}}, "intent": "d"}', 'x {"a": {"intent": "no"}} y', '{"intent": "e", "slots": "none"}',
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, r string")
    got = [(r.pred_intent, len(r.pred_slots), r.parse_failed) for r in labels.parse_json_response(df, "r").orderBy("i").collect()]
    assert got == [
        ("a", 0, False), ("b", 0, False), ("c", 1, False), ("UNK", 0, True), ("UNK", 0, True), ("d", 0, False), ("UNK", 0, False), ("e", 0, False),
    ]


def test_inventory_reads_headers_only(spark, tmp_path):
    """A sparse file of 5 GB with its note before the data, and names with blanks and marks."""
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16)
    note = b"LIST" + struct.pack("<I", 3 << 30)
    big = tmp_path / "a b#%20é.wav"
    with open(big, "wb") as f:
        f.write(b"RIFF" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + fmt + note)
        f.seek(44 + (3 << 30))
        f.write(b"data" + struct.pack("<I", 1 << 30))
        f.truncate(5 << 30)
    (tmp_path / "short.wav").write_bytes(b"RIFF")
    got = {r.file: r for r in readers.file_inventory(spark, str(tmp_path)).collect()}
    assert (got[big.name].size, got[big.name].n_frames, got[big.name].valid) == (5 << 30, 1 << 29, True)
    assert not got["short.wav"].valid and readers.file_inventory(spark, str(tmp_path), "*.none").count() == 0


def test_unpacked_files_are_whole_or_absent(spark, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / ".a.bin.7").write_bytes(b"half")  # what a dead attempt leaves
    (out / "b.bin").write_bytes(b"older")
    df = spark.createDataFrame([(bytearray(b"A"), "a.bin"), (bytearray(b"B"), "b.bin"), (None, "c.bin"), (bytearray(b"D"), None)], "b binary, n string")
    writers.unpack_binary(df, "b", "n", str(out))
    writers.unpack_binary(df, "b", "n", out.as_uri())
    seen = {p.name: p.read_bytes() for p in out.iterdir() if not p.name.startswith(".")}
    assert seen == {"a.bin": b"A", "b.bin": b"B"}


def test_brace_blocks_equal_a_plain_scan(spark):
    rng = random.Random(4)
    pieces = ["{", "}", "{", "}", '"a": 1', "x", '{"k": ', "é", " ", "{}", '"b": "c"']
    rows = ["".join(rng.choices(pieces, k=rng.randrange(60))) for _ in range(300)] + ["", "}}{", '{"a": ' * 300 + "1" + "}" * 300]

    def plain(t):
        out = []
        for i, c in enumerate(t):
            depth = 0
            for j in range(i, len(t)) if c == "{" else ():
                depth += (t[j] == "{") - (t[j] == "}")
                if depth == 0:
                    if re.match(r'\{\s*["}]', t[i : j + 1]):
                        out.append((i + 1, j + 1))
                    break
        return out

    df = spark.createDataFrame(list(enumerate(rows)), "i int, r string")
    got = df.select("i", labels.brace_blocks(F.col("r")).alias("b"), running_sum(F.array(F.lit(1), F.col("i"), F.lit(-2)), 2).alias("s")).collect()
    for r in got:
        assert [tuple(b) for b in r.b] == plain(rows[r.i]), rows[r.i]
        assert r.s == [1, 1 + r.i, r.i - 1]


def test_json_answer_after_many_braces(spark):
    """20,000 braces, nested and in a row, before the object: sorted once, not walked for each."""
    rows = ["{" * 5000 + "x" + "}" * 5000 + "{x} " * 5000 + '{"intent": "far", "slots": []} end', "{" * 20_000, "}" * 20_000]
    df = spark.createDataFrame([(r,) for r in rows], "r string")
    start = time.time()
    got = [(r.pred_intent, r.parse_failed) for r in labels.parse_json_response(df, "r").collect()]
    assert got == [("far", False), ("UNK", True), ("UNK", True)] and time.time() - start < 30


def test_lexicon_forbidden_beats_expected(spark):
    rules = literal_table(spark, "intent string, expected array<string>, forbidden array<string>", [("on", ["allume"], ["éteins"]), ("set", ["règle"], [])])
    df = spark.createDataFrame([("on", "Allume puis eteins"), ("on", "ouvre"), ("set", "REGLE ça"), ("x", "?")], "intent string, t string")
    got = {(r.intent, r.t): (r.verb_ok, r.verb_reason) for r in labels.validate_lexicon(df, "t", "intent", rules).collect()}
    assert got[("on", "Allume puis eteins")] == (False, "banned=éteins") and got[("on", "ouvre")] == (False, "none-listed")
    assert got[("set", "REGLE ça")] == (True, "règle") and got[("x", "?")] == (True, "unruled")


def test_csv_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,command\n1,go\nx,go\n3,\n4,go,extra\n")
    d = readers.read_csv_records(spark, str(tmp_path / "a.csv"), "id bigint, command string", ["command"]).cache()
    assert sorted((r.id or 0, r.bad) for r in d.select("id", "bad").collect())[-1] == (4, True)
    assert d.where("NOT bad").count() == 1 and d.where(F.col("bad")).count() == 3


def test_inventory_of_files_with_further_chunks(spark, tmp_path):
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    fmt = lambda tag=1, more=b"": chunk(b"fmt ", struct.pack("<HHIIHH", tag, 2, 8000, 32000, 4, 16) + more)
    data = chunk(b"data", b"\0" * 64)
    files = {
        "list": chunk(b"LIST", b"INFOx") + fmt() + data,
        "after": fmt() + chunk(b"LIST", b"y" * 301) + data,
        "long": fmt(0xFFFE, struct.pack("<HHI", 22, 16, 3) + b"\1" + b"\0" * 15) + data,
        "fact": fmt(3, b"\0\0") + chunk(b"fact", struct.pack("<I", 16)) + data,
        "block": fmt(2, b"\0\0") + chunk(b"fact", struct.pack("<I", 99)) + data,
        "none": fmt() + chunk(b"LIST", b"z" * 40),
        "early": data + fmt(),
    }
    for name, body in files.items():
        (tmp_path / f"{name}.wav").write_bytes(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)
    got = {x["file"][:-4]: x for x in readers.file_inventory(spark, str(tmp_path)).collect()}
    assert {n for n, x in got.items() if not x["valid"]} == {"none", "early"}
    for name in ("list", "after", "long", "fact", "block"):
        x = got[name]
        assert (x["channels"], x["sample_width"], x["sample_rate"]) == (2, 2, 8000)
        assert x["n_frames"] == (99 if name == "block" else 16) and x["duration"] == x["n_frames"] / 8000


def test_json_arrays_are_split_among_tasks(spark, tmp_path):
    rng = random.Random(4)
    bits = ['a', ',', '"', "\\", "[", "]", "{", "}", "\n", "é", ",,", '\\"', " "]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    want = [{"i": i, "s": text(), "l": [text() for _ in range(rng.randint(0, 3))], "m": {text(): text()}} for i in range(300)]
    (tmp_path / "a.json").write_text("  \n" + json.dumps(want[:120], indent=1) + "\n")
    (tmp_path / "b.json").write_text(json.dumps(want[120:299], ensure_ascii=False))
    (tmp_path / "c.json").write_text(json.dumps(want[299]))
    (tmp_path / "d.json").write_text("[ \n ]")
    (tmp_path / "e.json").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1000")  # many blocks a file
        schema = "i bigint, s string, l array<string>, m map<string,string>"
        got = readers.read_json_records(spark, str(tmp_path), schema).collect()
        elements = readers.json_elements(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.asDict() for r in got), key=lambda r: r["i"]) == want
    numbers = sorted((r["file"][-6:], r["element_no"]) for r in elements)
    assert numbers == [("a.json", i) for i in range(120)] + [("b.json", i) for i in range(179)] + [("c.json", 0)]


def test_lines_of_one_block_are_ordered_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "LINES", 50)
    words = [f"w{i} O O" if i % 7 else "" for i in range(3000)]
    (tmp_path / "one.txt").write_text("\n".join(words))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        lines = readers.numbered_lines(spark, str(tmp_path))
        assert [r.value for r in lines.orderBy("line_no").collect()] == words
        tasks = [r.task for r in lines.select("line_no", F.spark_partition_id().alias("task")).collect()]
        assert max(map(tasks.count, set(tasks))) < 1500
        sentences = readers.read_conll(spark, str(tmp_path)).orderBy("sent_no").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.tokens for r in sentences] == [[f"w{i}" for i in range(a + 1, min(a + 7, 3000))] for a in range(0, 3000, 7)]


def test_pieces_of_an_array_are_shuffled_few_times(spark, tmp_path):
    rng = random.Random(6)
    rows = [{"i": i, "s": "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)), "l": [i, str(i)]} for i in range(20000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))

    def shuffled():
        all_ = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(all_.apply(i).totalShuffleWrite() for i in range(all_.size()))

    before = shuffled()
    got = readers.read_json_records(spark, str(tmp_path), "i bigint, s string, l array<string>")
    assert got.agg(F.sum("i"), F.count_distinct("s")).first() == (sum(range(20000)), 20000)
    assert shuffled() - before < 7.5 * (tmp_path / "a.json").stat().st_size
