"""Near-duplicates, repeated bytes, fuzzy passages and components against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, docs, empty
from uttermark.llm import chaining, components, deepshallow, minhash, substrings
from uttermark.llm.common import sifted


def words(r, n, size=3000):
    return [f"w{r.randrange(size)}" for _ in range(n)]


def edited(r, ws, every):
    return [f"e{r.randrange(10**6)}" if i % every == every - 1 else w for i, w in enumerate(ws)]


@pytest.fixture(scope="module")
def copies():
    r = random.Random(3)
    base = [words(r, r.randint(5, 200)) for _ in range(12)]
    out = [" ".join(b) for b in base]
    for b in base:
        out += [" ".join(edited(r, b, k)) for k in (25, 40, 60, 90)]
    out += [out[0], out[0].upper(), "one two", "ONE  two", "one", "", None, " \t", "a b c d e"]
    line = " ".join(words(r, 30))
    return out + [line + " " + " ".join(words(r, 25)) for _ in range(40)]


def near(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        n = len(w)
        sets.append({tuple(w)} if 0 < n < 5 else {tuple(w[i : i + 5]) for i in range(n - 4)})
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return [(len(s), c) for s, c in zip(sets, root)]


def test_groups_are_those_of_all_pairs(spark, copies):
    got = {r["doc_id"]: r for r in minhash.groups(docs(spark, copies)).collect()}
    for i, (n, c) in enumerate(near(copies)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, i == c), i


def test_sql_twin(spark, copies):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(copies)))
    want = sorted((r[0], r[1], r[2]) for r in con.execute(minhash.NEAR_SQL).fetchall())
    assert [(n, c) for _, n, c in want] == near(copies)


def test_signatures_estimate_and_early_stop():
    r = np.random.default_rng(1)
    for size, share in ((400, 0.75), (60, 0.5)):
        both = r.integers(0, 2**63, int(size * share), dtype=np.uint64)
        a, b = (np.append(both, r.integers(0, 2**63, size - len(both), dtype=np.uint64)) for _ in range(2))
        s = minhash.signatures([a, b], 881)
        true = len(both) / (2 * size - len(both))
        assert (s[0] == s[1]).mean() == pytest.approx(true, abs=0.06)
        # Stopping early leaves nothing out: all ranks of all shingles give the same least values.
        full = np.full((1, 131), np.iinfo(np.uint64).max, dtype=np.uint64)
        step = 1 + minhash.mix(a ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(130)
        place = minhash.mix(a ^ np.uint64(0x14057B7EF767814F)) % np.uint64(131)
        for rank in range(131):
            v = (np.uint64(rank) << np.uint64(52)) | (minhash.mix(a + minhash._golden[rank]) >> np.uint64(12))
            np.minimum.at(full[0], ((place + np.uint64(rank) * step) % np.uint64(131)).astype(int), v)
        assert (full == minhash.signatures([a], 131)).all()


def test_components(spark):
    r = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(150)]
    links += [(5, 5), (400, 401), (401, 400)]
    d = spark.createDataFrame(links, "u long, v long").repartition(7)
    root = {x: x for p in links for x in p}
    for a, b in links * 2:
        ra, rb = root[a], root[b]
        root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    got = {x["node"]: x["root"] for x in components.components(d).collect()}
    assert got == {k: v for k, v in root.items()}
    assert components.components(d.limit(0)).count() == 0


def test_few_links_take_no_rounds_and_give_the_components_of_the_rounds(spark, monkeypatch):
    r = random.Random(8)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    d = spark.createDataFrame(links, "u long, v long").repartition(7)
    made, keep = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: made.append(name) or keep(df, name))
    short = {tuple(x) for x in components.components(d).collect()}
    assert made == ["links", "forest"]
    monkeypatch.setattr(components, "FEW", 10)
    assert {tuple(x) for x in components.components(d).collect()} == short
    assert made.count("stars") > 1



@pytest.mark.parametrize("block", [512, 7])
def test_a_bucket_of_near_copies_makes_no_row_for_a_pair(spark, monkeypatch, block):
    """120 texts around the limit: many pairs that signatures allow, of which some are links."""
    r = random.Random(12)
    base = words(r, 150)
    texts = [" ".join(edited(random.Random(k), base, 40 + k % 17)) for k in range(120)]
    sets = [minhash.shingle_set(t) for t in texts]
    made = minhash.signatures(sets, minhash.FINE[0])
    few = (made[:, : minhash.NIBBLES] & np.uint64(15)).astype(np.uint64)
    short = (few[:, ::2] << np.uint64(4) | few[:, 1::2]).astype(np.uint8).view(np.int64)
    nodes = [minhash.fingerprint(s) for s in sets]
    assert len(set(nodes)) == len(nodes)
    known = [(n, n, len(s), x.tolist(), s.view(np.int64).tolist()) for n, s, x in zip(nodes, sets, short, strict=True)]
    known = spark.createDataFrame(known, "node binary, root binary, n_shingles long, nibbles array<long>, items array<long>")
    pieces = -(-len(nodes) // block)
    rows = known.drop("items").selectExpr("*", f"{pieces}L AS pieces", "explode(array(1L, 2L, 3L)) AS bucket")

    met = minhash.alike(rows).distinct().collect()
    links = minhash.forests(spark.createDataFrame(met, "part binary, side int, node binary").join(known, "node")).collect()
    want = {}
    pairs = 0
    for i, a in enumerate(sets):
        for j in range(i):
            k = len(np.intersect1d(a, sets[j]))
            pairs += 100 * k >= 65 * (len(a) + len(sets[j]) - k)
            if 100 * k >= 75 * (len(a) + len(sets[j]) - k):
                want.setdefault(nodes[i], set()).add(nodes[j])
    assert pairs > 2000 and want
    assert len(met) <= rows.count() * pieces
    if pieces == 1:
        assert len(met) <= len(nodes)  # the same part in three buckets is one
        assert len(links) < len(nodes)
    assert _roots(nodes, [(x["u"], x["v"]) for x in links]) == _roots(nodes, [(u, v) for u in want for v in want[u]])


def _roots(nodes, links):
    root = {n: n for n in nodes}
    for u, v in links:
        a, b = sorted((root[u], root[v]))
        if a != b:
            root = {n: a if x == b else x for n, x in root.items()}
    return root


def test_first_of_each_group_reads_texts_without_shuffling_them(spark, copies):
    kept = minhash.keep_first(docs(spark, copies))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in near(copies)}


def test_first_of_each_group_shuffles_marked_texts_only(spark, copies, monkeypatch):
    """Also where the marked ids are too many to broadcast: a filter of bounded size goes first."""
    monkeypatch.setattr(minhash, "FEW", 0)
    d = docs(spark, [*copies, *[f"a text of its own, number {i} of them" for i in range(300)]])
    d = d.unionByName(d.where("doc_id % 10 = 0")).withColumn("a.b", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = minhash.keep_first(d)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        rows = kept.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1
    assert kept.columns == d.columns
    want = sorted({c for _, c in near(copies)} | set(range(len(copies), len(copies) + 300)))
    assert sorted(r["doc_id"] for r in rows) == want


def test_sifted_keeps_every_row_and_all_with_a_key(spark):
    rows = spark.range(50_000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("k"), "id")
    keys = spark.range(0, 50_000, 11).select(F.col("id").alias("k"))
    maybe, no = sifted(rows, keys)
    assert maybe.columns == no.columns == ["k", "id"]
    assert maybe.count() + no.count() == 50_000
    assert no.join(keys, "k").count() == 0 and no.where("k IS NULL").count() == rows.where("k IS NULL").count()
    assert maybe.count() < 1.1 * keys.count()


def test_groups_of_awkward_rows(spark):
    d = awkward(spark)
    rows = minhash.groups(d).collect()
    assert len(rows) == d.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[1]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    kept = minhash.keep_first(d)
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "None", "3", "4", "5"])
    assert minhash.groups(empty(spark)).count() == 0 and minhash.keep_first(empty(spark)).count() == 0


def test_deep_shallow_order():
    r = random.Random(1)
    for _ in range(60):
        base = [bytes(r.choice(b"ab") for _ in range(300)) for _ in range(2)]
        data, start, group = b"", [], []
        for _ in range(r.randint(1, 40)):
            x = bytearray(r.choice(base)[: 200 + r.randint(0, 50)].ljust(250, b"x"))
            if r.random() < 0.5:
                x[r.randrange(200)] ^= 3
            for k in range(r.randint(1, 6)):
                start.append(len(data) + k)
                group.append(k * 7 + r.randint(0, 1))
            data += bytes(x)
        order, run = deepshallow.sort_strings(np.frombuffer(data, np.uint8), np.array(start), np.array(group), 200)
        key = lambda i: (group[i], data[start[i] : start[i] + 200])
        assert [key(i) for i in order] == sorted(map(key, range(len(start))))
        same = [key(order[i]) == key(order[i + 1]) for i in range(len(order) - 1)]
        assert same == (run[1:] == run[:-1]).tolist()


def removed_plainly(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        left = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("together", [substrings.STRETCHES, 2])
def test_bytes_removed_are_those_of_all_strings(spark, together):
    r = random.Random(4)
    w = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    p = w(400)
    texts = [p, p, w(50) + p[100:350] + w(70), w(9) + p[:150], p[30:229] + "Z", p[30:230] + "Q", "ab" * 300, "x" * 500]
    texts += [None, "", w(300) + p + w(20) + p[10:390], "y" * 199, "z" * 40_000]
    texts += [w(r.randint(0, 80)) + p[r.randint(0, 60) : r.randint(240, 400)] + w(30) for _ in range(40)]
    rows = substrings.removed(docs(spark, texts), together).collect()
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(x["kept"]).hexdigest()) for x in rows}
    assert [got[i] for i in range(len(texts))] == removed_plainly(texts)


def test_bytes_of_awkward_rows(spark):
    d = awkward(spark, [(9, "q" * 150, "en", "a", 1), (9, "long " * 60, "en", "a", 1), (9, "long " * 60, "en", "a", 1)])
    rows = substrings.removed(d).collect()
    assert len(rows) == d.count()
    by = sorted((x["doc_id"] or 0, x["n_removed"]) for x in rows if x["n_removed"])
    assert [x for x in by if x[0] != 4] == [(9, 300), (9, 300)] and len(by) == 3  # 4 repeats itself
    assert substrings.removed(empty(spark)).count() == 0


def best_chain(anchors):
    """Score of the best chain, over all predecessors."""
    anchors = sorted(set(anchors))
    score = []
    for x, y in anchors:
        before = [s - chaining.GAP * (x - a + y - b) for (a, b), s in zip(anchors, score) if a < x and b < y]
        score.append(chaining.WEIGHT + max([0, *before]))
    return max(score)


def test_chains_are_the_best():
    r = random.Random(6)
    for _ in range(100):
        anchors = [(r.randrange(120), r.randrange(120)) for _ in range(r.randint(1, 40))]
        chain = chaining.chains(anchors)[0]
        assert all(a < c and b < d for (a, b), (c, d) in zip(chain, chain[1:]))
        cost = sum(c - a + d - b for (a, b), (c, d) in zip(chain, chain[1:])) * chaining.GAP
        assert len(chain) * chaining.WEIGHT - cost == pytest.approx(best_chain(anchors))
        assert sorted(a for c in chaining.chains(anchors) for a in c) == sorted(set(anchors))


def test_longest_common_subsequence():
    r = np.random.default_rng(2)
    for _ in range(50):
        a, b = r.integers(0, 4, 12), r.integers(0, 4, 9)
        t = np.zeros((13, 10), int)
        for i in range(12):
            for j in range(9):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert chaining.common(a, b) == t[-1, -1]


def test_passages_are_found_and_others_left(spark):
    r = random.Random(5)
    p, q = words(r, 80), words(r, 400)
    texts = [words(r, 100) + p + words(r, 100), words(r, 50) + edited(r, p, 15) + words(r, 60)]
    texts += [words(r, 300), words(r, 40) + q + words(r, 20), edited(r, q, 9), words(r, 30) + p[:30] + words(r, 200)]
    texts = [" ".join(t) for t in texts]
    texts += ["", None, "a few words", texts[2]]
    rows = {x["doc_id"]: x for x in chaining.repeated_passages(docs(spark, texts)).collect()}
    assert set(rows) == {0, 1, 2, 3, 4, 9}
    assert (rows[0]["start_word"], rows[0]["end_word"]) == (100, 180) and rows[0]["first_doc_id"] == 1
    assert rows[1]["start_word"] == 50 and 125 <= rows[1]["end_word"] <= 130
    assert (rows[2]["n_words"], rows[2]["n_copies"], rows[2]["first_doc_id"]) == (300, 2, 9)
    assert rows[3]["start_word"] == 40 and rows[3]["end_word"] >= 435
    assert texts[0][rows[0]["start_char"] : rows[0]["end_char"]] == " ".join(p)


def test_passages_of_awkward_rows(spark):
    d = awkward(spark)
    assert chaining.repeated_passages(d).count() == 0
    assert chaining.repeated_passages(empty(spark)).count() == 0


def test_passages_are_whole_in_one_partner(spark):
    r = random.Random(8)
    lines = [words(r, 22, 10**6) for _ in range(3)]
    texts = [words(r, 60, 10**6) + sum(lines, []) + words(r, 60, 10**6)]
    texts += [words(r, 40, 10**6) + line + words(r, 40, 10**6) for line in lines]
    assert chaining.repeated_passages(docs(spark, [" ".join(t) for t in texts])).count() == 0
    swapped = [lines[0] + lines[1] + lines[2], lines[2] + words(r, 99, 10**6) + lines[1] + words(r, 99, 10**6) + lines[0]]
    assert chaining.repeated_passages(docs(spark, [" ".join(t) for t in swapped])).count() == 0


def replaced(r, ws, p):
    return [f"e{r.randrange(10**9)}" if r.random() < p else w for w in ws]


def test_share_of_fuzzy_passages_without_a_common_seed():
    r = random.Random(9)
    lost = 0
    for _ in range(2000):
        a = words(r, 70, 10**6)
        b = replaced(r, a, 0.1)
        a, b = (words(r, 30, 10**6) + x + words(r, 30, 10**6) for x in (a, b))
        of = [set(chaining.seeds(chaining.word_hashes(" ".join(x).encode()))[0].tolist()) for x in (a, b)]
        lost += not of[0] & of[1]
    assert lost / 2000 < 0.02


def test_lone_seed_of_another_partner_is_chained(spark):
    a = [(1, 0, 2, 0, x, x) for x in (0, 20, 40, 60, 80)] + [(1, 0, 3, 0, 50, 7)]
    rows = [(1, 0, [{"prid": p, "psub": q, "x": x, "y": y} for _, _, p, q, x, y in a])]
    d = spark.createDataFrame(rows, "rid long, sub int, a array<struct<prid: long, psub: int, x: int, y: int>>")
    assert {x["prid"] for x in chaining.chained(d).collect()} == {2, 3}


def test_passages_behind_frequent_phrases(spark):
    r = random.Random(11)
    fresh = lambda n: words(r, n, 10**7)
    phrases = [fresh(8) for _ in range(6)]

    def passage():
        gaps = [fresh(3) for _ in range(6)]
        first = sum((p + g for p, g in zip(phrases, gaps)), [])
        second = sum((p + [f"e{g[0]}", g[1], g[2]] for p, g in zip(phrases, gaps)), [])
        return first, second

    texts = []
    for _ in range(10):
        for x in passage():
            texts.append(fresh(30) + x + fresh(30))
    for _ in range(60):  # the same phrases in other places, also before the passage in the texts above
        texts.append(sum((fresh(12) + p for p in r.sample(phrases, 3)), []) + fresh(20))
    texts[0] = phrases[0] + fresh(40) + phrases[3] + texts[0]
    rows = {x["doc_id"]: x for x in chaining.repeated_passages(docs(spark, [" ".join(t) for t in texts])).collect()}
    assert set(rows) == set(range(20))
    assert all(rows[i]["first_doc_id"] == i ^ 1 and rows[i]["n_words"] >= 60 for i in rows)


def test_surroundings_are_compared_alike_in_small_and_large_groups():
    r = random.Random(12)
    seed = list(range(5))
    kin = [([r.randrange(256) for _ in range(48)], [r.randrange(256) for _ in range(48)]) for _ in range(7)]
    ctx = []
    for k in range(35):  # five versions of seven surroundings
        a, b = ([w if r.random() > 0.08 else r.randrange(256) for w in x] for x in kin[k % 7])
        ctx.append(np.array([48, *a, *seed, *b], dtype=np.uint8).tobytes())
    found = chaining.alike(ctx, list(range(35)), [0] * 35)
    assert {i for i, _ in found} == set(range(35)) and all(i % 7 == j % 7 and i != j for i, j in found)
    few = chaining.alike(ctx[:14], list(range(14)), [0] * 14)
    assert sorted(few) == sorted((i, j) for i in range(14) for j in range(14) if i != j and i % 7 == j % 7)
    across = chaining.alike(ctx, list(range(35)), [int(k >= 21) for k in range(35)])
    assert across and all((i >= 21) != (j >= 21) for i, j in across)


@pytest.mark.parametrize("asking", [range(0, 35, 5), range(35), [3]])
def test_blocks_compare_every_open_kind_with_all(spark, monkeypatch, asking):
    monkeypatch.setattr(chaining, "BLOCK", 4)
    r = random.Random(14)
    kin = [[r.randrange(256) for _ in range(101)] for _ in range(7)]
    ctx = [bytes((48, *kin[k % 7][:48], 1, 2, 3, 4, 5, *kin[k % 7][53:])) for k in range(35)]
    rows = [(9, k, k, False, k in asking, len(asking), 35, k, bytearray(c)) for k, c in enumerate(ctx)]
    kinds = spark.createDataFrame(
        rows, "h long, ck long, at long, again boolean, open boolean, u long, m long, rid long, ctx binary"
    )
    found = [(x["rid"], x["prid"]) for x in chaining.compared(kinds).collect()]
    assert set(found) == {(i, j) for i in asking for j in range(35) if i != j and i % 7 == j % 7}


def test_runs_of_frequent_seeds(spark):
    rows = [(h, 1, (2 << 32) | x, 0) for h, x in ((11, 3), (12, 10), (13, 20), (14, 30), (15, 300))]
    rows += [(h, 5, x, 0) for h, x in ((11, 100), (12, 108), (13, 115), (14, 125))]
    d = spark.createDataFrame(rows, "h long, rid long, at long, ck long")
    by = {}
    for x in chaining.runs(d).collect():
        by.setdefault(x["run"], set()).add((x["rid"], x["at"] & 0xFFFFFFFF))
    pairs = [{(1, a), (5, b)} for a, b in ((3, 100), (10, 108), (20, 115))]
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, [*pairs, pairs[0]]))  # twos, and the run of four


def test_open_kinds_are_those_outside_passages(spark):
    d = spark.createDataFrame([(1, 7, 10, 1), (1, 7, 58, 2), (2, 7, 20, 3), (1, 8, 10, 1)], "h long, rid long, at long, ck long")
    p = spark.createDataFrame([(7, 0, 5, 60)], "rid long, sub int, start int, end int")
    assert {(x["h"], x["ck"]) for x in chaining.open_kinds(d, p).collect()} == {(1, 1), (1, 2)}


def test_hash_of_surroundings_is_that_of_the_words_alone():
    r = random.Random(13)
    shared = words(r, 120, 10**6)
    a, b = (chaining.word_hashes(" ".join(words(r, n, 10**6) + shared).encode()) for n in (7, 900))
    x, y = (chaining.surrounded(w, np.array([p + 50, p + 10, p + 70])) for w, p in ((a, 7), (b, 900)))
    assert x[0] == y[0] and x[1] != y[1] and x[2] == y[2] and x[0] != x[2]


def test_stretches_of_one_word_are_compared_at_few_places(spark, monkeypatch):
    r = random.Random(11)
    texts = [[x for w in words(r, 6, 3) for x in [w] * r.randint(20, 40) + words(r, 30, 10**6)] for _ in range(8)]
    shared = words(r, 30, 10**6) + ["w1"] * 30
    for t in texts[:2]:
        t[0:0] = shared
    seen, compared = [], chaining.compared
    monkeypatch.setattr(chaining, "compared", lambda kinds: seen.append(kinds.count()) or compared(kinds))
    rows = chaining.repeated_passages(docs(spark, [" ".join(t) for t in texts])).collect()
    assert 0 < sum(seen) < 500  # 652 without stand-ins
    assert {x["doc_id"] for x in rows if x["start_word"] == 0 and x["n_words"] >= 60} == {0, 1}


def test_one_seed_in_step_with_either_end_stands_for_a_stretch():
    h = np.array([7] * 100 + [1, 2, 3] + [7] * 3, dtype=np.uint64)
    place = np.array([*range(50, 150), 160, 162, 200, *range(400, 403)])
    by = chaining.stand_ins(h, place)
    own = np.flatnonzero(by == np.arange(len(h)))
    assert {0, 99, 100, 101, 102, 103, 105} <= set(own.tolist()) and len(own) < 25
    assert (h[by] == h).all() and (by[by] == by).all() and (place[own][1:] - place[own][:-1])[:16].max() < chaining.SAMPLED


def test_seeds_of_several_texts_are_those_of_each():
    r = random.Random(2)
    for _ in range(50):
        texts = [chaining.word_hashes(" ".join(words(r, r.choice([0, 1, 5, 19, 20, 21, 90]), r.choice([1, 3, 999]))).encode()) for _ in range(r.randint(1, 8))]
        start = np.cumsum([0, *map(len, texts)])
        h, place = chaining.seeds_of(texts)
        each = [chaining.seeds(w) for w in texts]
        assert h.tolist() == [x for one, _ in each for x in one.tolist()]
        assert place.tolist() == [x + a for (_, at), a in zip(each, start) for x in at.tolist()]


def extended(a, b):
    i = j = hits = 0
    end = (0, 0, 0)
    while i < len(a) and j < len(b):
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j, hits = i + 1, j + 1, hits + 1
            end = (i, j, hits)
        for di, dj in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2)):
            if a[i + di : i + di + 2] == b[j + dj : j + dj + 2] and len(a) > i + di + 1 and len(b) > j + dj + 1:
                i, j = i + di, j + dj
                break
        else:
            break
    return end


def test_many_pairs_are_extended_as_one_by_one():
    r = random.Random(4)
    pairs = []
    for _ in range(200):
        a = [r.randrange(4) for _ in range(r.randrange(60))]
        b = [w if r.random() < 0.9 else 9 for w in a if r.random() < 0.95]
        pairs.append((a, b))
    x, y = (np.array([w for p in pairs for w in p[k]] + [0]) for k in (0, 1))
    na, nb = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    a, b = np.cumsum(na) - na, np.cumsum(nb) - nb
    on = chaining.extend(x, y, a, b, na, nb, np.ones(len(pairs), dtype=int))
    back = chaining.extend(x, y, a + na - 1, b + nb - 1, na, nb, np.full(len(pairs), -1))
    for k, (p, q) in enumerate(pairs):
        assert tuple(on[:, k].tolist()) == extended(p, q)
        assert tuple(back[:, k].tolist()) == extended(p[::-1], q[::-1])
