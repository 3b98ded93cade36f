"""Tag algebra against plain loops written from the rules."""

import random

from pyspark.sql import functions as F

from uttermark.functions import tags as B
from uttermark.operators import audit, bio, filters, metrics

LANG_TYPES = ["O", "B-x", "I-x", "B-y", "I-y", "PAD"]


def loop_spans(tags):
    out, start, kind = [], None, None
    for i, t in enumerate([*tags, "O"]):
        ty = t[2:] if t[:2] in ("B-", "I-") else None
        if kind is not None and (ty != kind or t.startswith("B-")):
            out.append((start, i, kind))
            kind = None
        if ty is not None and kind is None:
            start, kind = i, ty
    return out


def random_tags(n=400):
    rng = random.Random(3)
    return [[rng.choice(LANG_TYPES) for _ in range(rng.randint(0, 9))] for _ in range(n)]


def test_spans(spark):
    seqs = random_tags()
    df = spark.createDataFrame(list(enumerate(seqs)), "i int, t array<string>")
    got = df.select("i", B.spans(F.col("t")).alias("s")).orderBy("i").collect()
    assert [[tuple(x) for x in r.s] for r in got] == [loop_spans(s) for s in seqs]


def test_span_f1(spark):
    a, b = random_tags(200), random_tags(400)[200:]
    rows = [(i, x, (y + ["O"] * len(x))[: len(x)]) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "i int, g array<string>, p array<string>")
    tp = fp = fn = 0
    for _, g, p in rows:
        sg, sp = set(loop_spans(g)), set(loop_spans(p))
        tp, fp, fn = tp + len(sg & sp), fp + len(sp - sg), fn + len(sg - sp)
    whole = metrics.span_f1(df, "g", "p").where("is_total").first()
    assert (whole.tp, whole.fp, whole.fn) == (tp, fp, fn)
    assert abs(whole.f1 - 2 * tp / (2 * tp + fp + fn)) < 1e-12 and whole.support == tp + fn


def test_bio_check(spark):
    rows = [
        (0, ["a", "b"], ["B-x", "I-x"]), (1, ["a"], ["I-x"]), (2, ["a", "b"], ["B-x", "I-y"]), (3, ["a"], ["O", "O"]), (4, [], []),
    ]
    df = spark.createDataFrame(rows, "i int, k array<string>, t array<string>")
    got = [r.bio_reason for r in filters.check_bio(df, "k", "t").orderBy("i").collect()]
    assert got == ["", "opens-inside:I-x", "opens-inside:I-y", "lengths:1/2", ""]


def greedy(tokens, slots, wait):
    tags = ["O"] * len(tokens)
    for name, value in slots:
        v = value.lower().split()
        for i in range(len(tokens) - len(v) + 1):
            if v and tokens[i : i + len(v)] == v:
                if all(t == "O" for t in tags[i : i + len(v)]):
                    tags[i : i + len(v)] = ["B-" + name] + ["I-" + name] * (len(v) - 1)
                    break
                if not wait:
                    break
    return tags


def test_place_slots(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        toks = [rng.choice("abc") for _ in range(rng.randint(0, 8))]
        slots = [(f"s{j}", " ".join(rng.choice("abcA") for _ in range(rng.randint(0, 3)))) for j in range(4)]
        rows.append((i, toks, slots))
    df = spark.createDataFrame(rows, "i int, k array<string>, s array<struct<slot_type:string,value:string>>")
    for mode, wait in (("next", True), ("skip", False)):
        got = bio.slots_to_bio(df, "k", "s", mode).orderBy("i").collect()
        assert [r.bio for r in got] == [greedy(k, s, wait) for _, k, s in rows]


def test_source_bio_left_to_right(spark):
    rows = [("fly from new york to york", [("to", "york"), ("from", "New York")])]
    df = spark.createDataFrame(rows, "t string, s array<struct<slot_type:string,value:string>>")
    r = bio.source_bio(df, "t", "s").first()
    # The first occurrence of 'york' lies inside 'new york', so it is left out.
    assert r.bio == ["O", "O", "B-from", "I-from", "O", "O"]


UTT = "lang string, t string, s array<struct<slot_type:string,value:string>>, tr array<struct<slot_type:string,original:string,translated:string>>"


def test_projection_by_word_and_character(spark):
    rows = [
        ("fr", "allume la cuisine et le salonbleu", [("room", "kitchen"), ("room", "salon"), ("x", "none")], [("q", "Kitchen", "cuisine")]),
        ("zh", "打开 Kitchen灯", [("room", "kitchen")], []),
    ]
    df = spark.createDataFrame(rows, UTT)
    got = bio.project_slots(df, "t", "s", "tr", F.col("lang") == "zh").collect()
    assert got[0].bio == ["O", "O", "B-room", "O", "O", "B-room"]
    assert got[1].bio == ["O", "O"] + ["B-room"] + ["I-room"] * 6 + ["O"]
    strict = bio.project_slots(df, "t", "s", "tr", F.col("lang") == "zh", substring=False).first()
    assert strict.bio == ["O", "O", "B-room", "O", "O", "O"]


def test_projection_without_accents(spark):
    rows = [("fr", "eteins l'entree et l'arriere cour", [("room", "entry"), ("room", "Backyard")], [("q", "entry", "entrée"), ("q", "backyard", "cour-arrière")])]
    df = spark.createDataFrame(rows, UTT)
    assert bio.project_slots_folded(df, "t", "s", "tr").first().bio == ["O", "B-room", "O", "O", "O"]
    rows = [("fr", "dans la cour arrière", [("room", "Backyard")], [("q", "backyard", "arriere-cour")])]
    df = spark.createDataFrame(rows, UTT)
    assert bio.project_slots_folded(df, "t", "s", "tr").first().bio == ["O"] * 4
    assert bio.project_slots_folded(df, "t", "s", "tr", True).first().bio == ["O", "O", "B-room", "I-room"]


def test_reprojection_takes_the_next_place(spark):
    rows = [
        ("tr", "detroit'den detroit'e uçuş", [], [("from", "x", "detroit"), ("to", "y", "Detroit")]),
        ("zh", "从A到a", [], [("from", "x", "A"), ("to", "y", "A")]),
    ]
    df = spark.createDataFrame(rows, UTT)
    got = bio.reproject(df, "t", "tr", "lang", F.col("lang") == "zh").collect()
    assert got[0].bio == ["B-from", "B-to", "O"]
    assert got[1].bio == ["O", "B-from", "O", "B-to"]


def test_chunks_round_trip(spark):
    rows = [(0, "set the big room to red".split(), ["O", "O", "B-room", "I-room", "O", "B-color"]), (1, [], []), (2, ["a", "b"], ["B-x", "B-y"])]
    df = spark.createDataFrame(rows, "i int, k array<string>, t array<string>")
    c = bio.bio_to_chunks(df, "k", "t")
    got = {r.i: [tuple(x) for x in r.chunks] for r in c.collect()}
    assert got[0] == [("set the ", None), ("big room", "room"), (" to ", None), ("red", "color")]
    assert got[1] == [] and got[2] == [("a", "x"), ("b", "y")]
    back = {r.i: (r.tokens, r.bio, r.text) for r in bio.chunks_to_bio(c.select("i", "chunks"), "chunks").collect()}
    assert back[0] == (rows[0][1], rows[0][2], "set the big room to red")


def test_demoted_slot_merges_with_its_neighbours(spark):
    rows = [([("in the ", None), ("Room", "room"), (" now", None), ("red", "color")],), ([("hall", "room")],)]
    df = spark.createDataFrame(rows, "c array<struct<text:string,slot_name:string>>")
    got = bio.demote_slot(df, "c", "room", "room").collect()
    assert [tuple(x) for x in got[0].c] == [("in the Room now", None), ("red", "color")] and got[0].demoted
    assert [tuple(x) for x in got[1].c] == [("hall", "room")] and not got[1].demoted


def test_label_vocab_adds_inside_tags(spark):
    df = spark.createDataFrame([("i1", ["O", "B-a", "B-b", "I-b"]), ("i0", ["O"])], "intent string, t array<string>")
    got = {(r.kind, r.label): r.idx for r in audit.label_vocab(df, "intent", "t").collect()}
    assert got == {("intent", "i0"): 0, ("intent", "i1"): 1, ("tag", "B-a"): 0, ("tag", "B-b"): 1, ("tag", "I-b"): 2, ("tag", "O"): 3, ("tag", "I-a"): 4, ("tag", "PAD"): 5}
