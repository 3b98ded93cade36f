"""Vector codes, filter interactions and secret scans against plain versions."""

import hashlib
import itertools
import math
import random
import re
import string

import numpy as np
import pytest

from tests.llm.helpers import awkward, docs, empty
from uttermark.llm import interactions, secret_scan, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int"


def coded_plainly(rows, parts=4, entries=256, rounds=4):
    """Codes, errors and codebooks by a full scan in every round."""
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = sorted((i, [math.floor(1024 * x) for x in np.array(v, dtype=np.float32).tolist()], lab) for i, v, lab in rows if fine(v))
    m = len(kept[0][1]) // parts
    cut = [[v[j * m : (j + 1) * m] for j in range(parts)] for _, v, _ in kept]
    books = [[c[j] for c in cut[:entries]] for j in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, book: min((far(p, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for j in range(parts):
            of = [near(c[j], books[j])[1] for c in cut]
            for e in set(of):
                mine = [c[j] for c, x in zip(cut, of) if x == e]
                books[j][e] = [sum(x) // len(mine) for x in zip(*mine)]
    out = {}
    for (i, _, lab), c in zip(kept, cut):
        best = [near(c[j], books[j]) for j in range(parts)]
        out[i] = ("".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), lab)
    flat = ",".join(str(x) for b in books for c in b for x in c)
    return out, hashlib.sha256(flat.encode()).hexdigest()


@pytest.mark.parametrize("entries, spread", [(256, 1.0), (5, 0.004), (5, 9000.0)])
def test_codes_are_those_of_full_scans(spark, entries, spread):
    r = random.Random(3)
    # Few values: many ties and many entries that stay where they are.
    rows = [(7 * i, [r.randint(-3, 3) * spread / 3 for _ in range(8)], r.choice([0, 1, None])) for i in range(120)]
    rows += [(5000, None, 1), (5001, [math.nan] + [0.0] * 7, 1), (5002, [None] + [0.0] * 7, 0), (5003, [math.inf] * 8, 0)]
    want, sha = coded_plainly(rows, entries=entries)
    got = vector_codes.report(spark.createDataFrame(rows, VECTORS).repartition(5), entries=entries).collect()
    assert {g["vec_id"]: (g["code"], g["error"]) for g in got} == {i: w[:2] for i, w in want.items()}
    assert {g["codebooks_sha256"] for g in got} == {sha}
    sums = {lab: sum(w[1] for w in want.values() if w[2] == lab) for lab in (0, 1, None)}
    assert all(g["label_error"] == sums[want[g["vec_id"]][2]] for g in got)


def test_active_entries_give_what_a_full_scan_gives():
    r = np.random.default_rng(5)
    for _ in range(200):
        books = r.integers(-3, 4, (9, 2))
        parts = r.integers(-4, 5, (40, 2))
        code, dist = vector_codes.nearest_entries(parts, books)
        moved = r.random(9) < r.choice([0, 0.3, 1])
        after = np.where(moved[:, None], r.integers(-3, 4, books.shape), books)
        got = vector_codes.reassigned(parts, after, moved, code, dist)
        want = vector_codes.nearest_entries(parts, after)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_distances_are_exact_for_large_numbers():
    r = np.random.default_rng(6)
    for top in (1000, 1 << 24):
        p, c = r.integers(-top, top + 1, (20, 64)), r.integers(-top, top + 1, (7, 64))
        want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(a, b)) for b in c] for a in p]
        assert vector_codes.distances(p, c).tolist() == want


def test_codes_of_awkward_vectors(spark):
    rows = [(None, [0.5] * 8, None), (3, [0.25] * 8, 1), (3, [0.25] * 8, 1), (4, [1.0] * 7, 1), (5, [], 1), (6, None, None)]
    rows += [(9, [1e38] * 8, 2), (8, [-0.0001] * 8, 1), (10, [1.0] * 12, 1)]
    d = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS code", "2 AS error", "3 AS _code", "4 AS _id")
    got = sorted((str(x["vec_id"]), x["code"], x["error"], x["label_error"]) for x in vector_codes.report(d).collect())
    assert [g[0] for g in got] == ["3", "3", "8", "9", "None"]
    assert all(g[2] == 0 and g[3] == 0 for g in got) and len({g[1] for g in got}) == 4
    assert vector_codes.report(spark.createDataFrame([], VECTORS)).count() == 0


def test_popcounts():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 100, 4097):
        words = r.integers(0, 2**32, n, dtype=np.uint32)
        want = [int(((words >> b) & 1).sum()) for b in range(32)]
        assert interactions.positional_popcount(words).tolist() == want


def audited_plainly(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    seen = []
    for i, t, source in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        fails = "".join(
            x
            for x, bad in zip(
                "ABCDE",
                (
                    len(w) < 50,
                    100 * len(set(w)) < 65 * len(w),
                    100 * len(re.findall("[A-Z]", t or "")) > 5 * len(t or ""),
                    re.search("[#$%&*|]", t or ""),
                    i is not None and first[t or ""] < i,
                ),
            )
            if bad
        )
        seen.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {s[0] for s in seen}:
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [s for s in seen if s[0] == part]
            for step, x in enumerate(order, 1):
                gone = [s for s in left if x in s[1]]
                failing = [s for s in seen if s[0] == part and x in s[1]]
                left = [s for s in left if x not in s[1]]
                total[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(s[1] == x for s in failing), sum(s[2] for s in gone), sum(s[3] for s in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def test_audit_is_that_of_walking_all_orders(spark):
    r = random.Random(4)
    rows = []
    for i in range(150):
        w = [r.choice("abcdefgh") * r.randint(1, 6) + str(r.randrange(r.choice([3, 900]))) for _ in range(r.choice([10, 49, 50, 80]))]
        t = " ".join(w).upper() if r.random() < 0.2 else "é\x1c ".join(w) if r.random() < 0.2 else "\n".join(w)
        rows.append((i, t + r.choice(["", "", " 5% #"]), r.choice(["a", "b", "", None])))
    rows += [(200 + i, rows[i % 7][1], "a") for i in range(20)] + [(300, None, "b"), (301, "", None), (302, None, "b")]
    rows += [(None, rows[0][1], "a"), (None, None, None), (5, rows[5][1], rows[5][2])]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 220, 2)] + [(4, 1, 1), (4, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS part", "2 AS failed", "3 AS good")
    got = interactions.audit(d.repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert {(g["part"], g["filter_order"], g["step"]): [g[n] for n in names] for g in got.collect()} == audited_plainly(rows, labels)


def test_audit_of_awkward_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = interactions.audit(awkward(spark), labels)
    assert {g["part"]: g["n"] for g in got.groupBy("part").count().withColumnRenamed("count", "n").collect()} == {"": 600, "a": 600, "b": 600}
    assert interactions.audit(empty(spark), labels).count() == 0


def secrets_plainly(text):
    out = []
    for m in secret_scan.ASSIGN.finditer(text or ""):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m.group()) >= 32]
    out = sorted(out)
    return [",".join(f"{secret_scan.KINDS[r]}:{s}:{e}" for s, r, e in out), *[sum(r == k for _, r, _ in out) for k in range(3)]]


PIECES = ["password", "PASSWD", "api_key", "apiKey", "token", "secret", '"', "'", " ", ":", "=", "AKIA", "0af9", "deadbeef0123", "XYZ0", "ſ", "é", "\n", "a.b", "/+", "-", "G"]


def test_base_spans_are_those_of_the_patterns(spark):
    r = random.Random(7)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(1, 60))) for _ in range(400)]
    texts += ["token:secret:abcdefghij", "TOKEN = 'abcdefgh'", "é" * 9 + " AKIA" + "A" * 12, "toKen=abcdefgh K", None, ""]
    got = {x["doc_id"]: x for x in secret_scan.report(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base, *counts = secrets_plainly(t)
        assert [got[i][f"n_{k}"] for k in secret_scan.KINDS] == counts, t
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))


def test_tests_accept_random_draws_and_reject_patterns():
    r = random.Random(1)
    for name in ("hex", "base32", "base62", "base64"):
        symbols = secret_scan.ENCODINGS[name]
        for n in (16, 24, 40, 200):
            fails = [0, 0, 0]
            for _ in range(2000):
                v = np.array([r.randrange(len(symbols)) for _ in range(n)])
                for i, test in enumerate((secret_scan.uniformity, secret_scan.runs, secret_scan.serial)):
                    fails[i] += test(v, len(symbols)) < 0.01
            assert max(fails) / 2000 < 0.025, (name, n, fails)
    for t in (b"0123456789abcdef0123456789abcdef", b"aaaaaaaaaaaaaaaaaaaaaaaa", b"abababababababababab", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"1234567890123456"):
        assert not secret_scan.looks_random(t)[1], t


def test_random_strings_are_found_and_words_left(spark):
    r = random.Random(2)
    common = "the of and information government international department through between because development".split()
    names = [f"{a}_{b}_{c}" for a in common[3:] for b in common[3:] for c in ("id", "list", "2019")]
    texts = [" ".join([r.choice(common) for _ in range(150)] + [r.choice(names), r.choice(common) + "/" + r.choice(names)]) for _ in range(300)]
    texts += ["counterrevolutionaries Internationalization 4111111111111111 20190304T101112Z-20190304T101113Z a/b/c/d/e/f/g/h/i/j/k"]
    symbols = string.ascii_letters + string.digits
    keys = {i: "".join(r.choice(symbols) for _ in range(n)) for i, n in zip(range(0, 300, 10), itertools.cycle([20, 32, 44]))}
    planted = [t if i not in keys else f"{t[:200]} é {keys[i]}== {t[200:]}" for i, t in enumerate(texts)]
    got = {x["doc_id"]: x["spans"] for x in secret_scan.report(docs(spark, planted)).collect()}
    found = 0
    for i, t in enumerate(planted):
        if i in keys:
            at = t.index(keys[i])
            found += got[i] == f"random:{at}:{at + len(keys[i]) + 2}"
        else:
            assert got[i] == "", (t, got[i])
    assert found >= 28


def test_thresholds_by_hand():
    counts = {("a", 0): 90, ("a", 35): 8, ("a", 60): 2, ("b", 10): 5, ("c", 21): 1}
    assert secret_scan.thresholds(counts) == {"a": 35, "c": 21}


def test_secrets_of_awkward_rows(spark):
    d = awkward(spark, [(9, "x" * 200_000, "en", "a", 1), (9, "token=" + "k" * 50, "en", "a", 1)])
    rows = secret_scan.report(d).collect()
    assert len(rows) == d.count()
    assert sorted((x["doc_id"], x["n_assign"]) for x in rows if x["spans"]) == [(9, 1)]
    assert secret_scan.report(empty(spark)).count() == 0
