"""The corpus operators against brute force, on a fixture with awkward rows."""

import hashlib
import random
import re
import string
import time
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import edit_lsh, fast_sketch, gumbel_pieces, language_id, line_runs, pii, pq_index, quality_fm, secrets, suffix_family
from docloom.llm.common import Scratch, connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long, h string, a long, component string, spans string"


def soup(rng, n, words=None):
    words = words or ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 7))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def texts():
    rng = random.Random(3)
    base, passage = soup(rng, 220), soup(rng, 90)
    out = [None, "", " \n\t ", "one", "one", "two words", "é ﬁ ▁ 漢字 \U0001f600", base, base, base.upper(), base.replace(base.split()[5], "zz", 1), base + " tail"]
    out += [soup(rng, 60) + "\n" + passage + "\n" + soup(rng, 30) for _ in range(3)] + ["\n".join(["x"] * 300), "De " * 700, soup(rng, 9000), "q" * 5000]
    out += ["pre " + passage[:500] + " post", "token: abc\nSECRET='abcdef12' AKIA" + "A1" * 9 + " " + "0123456789abcdef" * 2 + " secret: token: abcdefgh"]
    return out


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i, t, "en", "s", len(t) if t is not None else None, "h", i, "c", "s") for i, t in enumerate(rows)]
    return spark.createDataFrame(data, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


def components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_paths_stars_and_cycles(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(300, 301), (301, 302), (302, 300), (500, 500)]
    random.Random(1).shuffle(pairs)
    df = spark.createDataFrame(pairs, "a long, b long")
    got = dict(connected_components(df, Scratch(spark, "t")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and {got[300], got[301], got[302]} == {300} and 500 not in got
    assert connected_components(df.limit(0), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_equals_brute_force(spark, width):
    rows = texts()
    rng = random.Random(9)
    words = soup(rng, 150).split()
    for _ in range(25):  # near copies around the threshold, so that stars alone would not do
        w = list(words)
        for _ in range(rng.randint(0, 16)):
            w[rng.randrange(len(w))] = "n%d" % rng.randrange(10**6)
        rows.append(" ".join(w))

    def shingled(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = [shingled(t) for t in rows]
    want = components(len(rows), lambda i, j: bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    got = {r.doc_id: r for r in fast_sketch.near_duplicates(docs(spark, rows), width=width).collect()}
    assert [got[i].component_id for i in range(len(rows))] == want
    assert [got[i].n_shingles for i in range(len(rows))] == [len(s) for s in sets] and all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert fast_sketch.near_duplicates(empty(spark)).count() == 0


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 5000):
        v = rng.integers(1, 1 << 62, n).astype(np.uint64)
        t = fast_sketch.sketch(np.concatenate([v, v]), np.array([0, n, 2 * n]))
        assert (t != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (t[0] == t[1]).all()
    a = rng.integers(1, 1 << 62, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(1, 1 << 62, 100).astype(np.uint64)])
    t = fast_sketch.sketch(np.concatenate([a, b]), np.array([0, 1000, 2000]))
    assert abs((t[0] == t[1]).mean() - 900 / 1100) < 0.15


def test_pq_links(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 16))
    near = [x[0] + 0.15 * rng.normal(size=16) for _ in range(30)]
    rows = [v.tolist() for v in np.concatenate([x, near])] + [x[1].tolist()] * 3 + [(2 * x[1]).tolist(), [0.0] * 16, [float("nan")] * 16, None, [], [1.0] * 3, [None] * 16]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int, probe string")
    v32 = [None if v is None else np.array(v, dtype=np.float32).astype(float) for v in rows]
    fine = [v is not None and len(v) in (3, 16) and np.isfinite(v).all() and (v != 0).any() for v in v32]

    def linked(i, j):
        return fine[i] and fine[j] and len(v32[i]) == len(v32[j]) and v32[i] @ v32[j] / np.linalg.norm(v32[i]) / np.linalg.norm(v32[j]) >= 0.9

    want = components(len(rows), linked)
    links = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    got = {r.vec_id: r for r in pq_index.near_duplicates(df).collect()}
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= links[i] for i in got) and found >= 0.9 * sum(links)
    if found == sum(links):
        assert [got[i].component_id for i in range(len(rows))] == want
    assert pq_index.near_duplicates(df.limit(0)).count() == 0
    assert {r.n_links for r in pq_index.near_duplicates(df.where("embedding is null or size(embedding) = 0")).collect()} == {0}


def test_pq_of_rare_lengths_and_clashing_columns(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [rng.normal(size=8) for _ in range(60)] + [np.array([1.0, 2, 3, 4]) * k for k in (1, 2, 3)] + [np.array([1.0])] * 2 + [np.array([-1.0])]
    rows += [rows[5] + 0.1 * rng.normal(size=8) for _ in range(10)]
    df = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, k1 string").withColumns({c: F.lit("c") for c in ("a", "fine", "dim", "v", "n")})
    linked = lambda i, j: len(rows[i]) == len(rows[j]) and rows[i] @ rows[j] / np.linalg.norm(rows[i]) / np.linalg.norm(rows[j]) >= 0.9
    links = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    for members in (4096, 20):  # the second gives the 8-vectors an index of their own
        monkeypatch.setattr(pq_index, "MEMBERS", members)
        got = {r.vec_id: r for r in pq_index.near_duplicates(df).collect()}
        assert [got[i].n_links for i in range(len(rows))] == links and links[60] == 2
        assert [got[i].component_id for i in range(len(rows))] == components(len(rows), linked)


def test_pq_loses_no_pair_of_a_dense_group(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 24))
    x[:300] = x[0] + 0.3 * rng.normal(size=(300, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    near = x @ x.T >= 0.9
    got = {r.vec_id: r for r in pq_index.near_duplicates(df, probes=1).collect()}
    assert [got[i].n_links for i in range(len(x))] == (near.sum(1) - 1).tolist() and near.sum() > 20_000
    assert [got[i].component_id for i in range(len(x))] == components(len(x), lambda i, j: near[i, j])


def test_language_id(spark):
    rng = random.Random(4)
    pool = {"en": "the of and that with which".split(), "de": "der die und nicht ist für".split(), "fr": "le la et que dans être".split(), "es": "el que y los está año".split()}
    rows = [(i, soup(rng, 40, pool[k]), k) for i, k in enumerate(list(pool) * 30)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !", "en"), (902, "", None), (903, "10² ½ ①", None), (0, rows[0][1], "en")], "doc_id long, text string, lang string")
    model = language_id.train(df.where("doc_id % 3 <> 1"))
    assert sorted(model.families) == ["germanic", "romance"] and ("de", "en") in model.columns and ("es", "fr") in model.columns
    got = language_id.identify(df, model).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert sum(by[i] == k for i, _, k in rows) >= 118 and by[900] == by[901] == by[902] == by[903] == "und"
    assert language_id.identify(df.limit(0), model).count() == 0
    none = language_id.train(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}
    assert {r.lang_pred for r in language_id.identify(df.where("doc_id < 3"), language_id.train(df.where("lang = 'de'"))).collect()} == {"de"}


def test_quality(spark):
    rng = random.Random(6)
    rows = [(i, soup(rng, 50) if i % 3 else "spam!! " * 40, None if i == 5 else 300) for i in range(150)] + [(900, None, None), (901, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, None if i == 7 else int(i % 3 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    model = quality_fm.train(df, labels)
    got = {r.doc_id: r.score for r in quality_fm.score(df, model).collect()}
    assert len(got) == 152 and all(0 <= s <= 1 for s in got.values()) and sum((got[i] >= 0.5) == (i % 3 > 0) for i in range(150)) >= 147
    assert {r.score for r in quality_fm.score(df, quality_fm.train(df, labels.limit(0))).collect()} == {0.5}
    assert quality_fm.score(df.limit(0), model).count() == 0


def test_fm_identity():
    rng = np.random.default_rng(1)
    m = quality_fm.Model(np.zeros((1, 1)), 0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    i, x = np.array([3, 7, 20, 41]), rng.normal(size=4)
    slow = 0.3 + m.weight[i] @ x + sum(m.factor[i[a]] @ m.factor[i[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert np.isclose(quality_fm.raw_score(m, i, x, np.array([0, 4]))[0][0], slow)


def test_line_runs_by_brute_force(spark):
    rng = random.Random(8)
    lines = ["l%d" % i * rng.randint(1, 12) for i in range(12)] + [""]
    rows = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14))) for _ in range(40)] + [None, "", "a\n" * 30, "a\n" * 25]
    least = 40
    split = [(t or "").split("\n") for t in rows]
    seen, where = {}, []
    for d, ls in enumerate(split):
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if sum(map(len, ls[a:b])) + b - a >= least:
                    key = tuple(ls[a:b])
                    if key in seen:
                        where.append((d, a, b))
                    seen.setdefault(key, (d, a))
    gone = [set() for _ in rows]
    for d, a, b in where:
        gone[d] |= set(range(a, b))
    got = {r.doc_id: r for r in line_runs.dedup(docs(spark, rows), min_chars=least).collect()}
    for d, t in enumerate(rows):
        want = t if not gone[d] else "\n".join(x for i, x in enumerate(split[d]) if i not in gone[d])
        assert (got[d].text, got[d].n_removed, got[d].n_lines) == (want, len(gone[d]), len(split[d])), d
        assert got[d].emptied == (bool(gone[d]) and not (want or "").strip()) and got[d].h == "h"
    assert line_runs.dedup(empty(spark)).count() == 0
    twice = docs(spark, ["z" * 300]).union(docs(spark, ["z" * 300]))
    assert [r.n_removed for r in line_runs.dedup(twice).collect()] == [0, 0]
    clash = docs(spark, ["a\n" * 30, "a\n" * 30]).withColumns({"doc_id": F.expr("nullif(doc_id, 0)"), "n_lines": F.lit("x"), "emptied": F.lit("y"), "row": F.lit("z")})
    got = {r.doc_id: r for r in line_runs.dedup(clash, min_chars=least).collect()}
    assert (got[None].n_lines, got[None].emptied, got[None].row, got[1].text, got[1].emptied) == (31, False, "z", "", True) and got[None].n_removed < 31


def test_cgk_lsh_finds_edited_items(spark):
    rng = random.Random(12)
    items = [soup(rng, n) for n in (12, 25, 40, 60)] + [None, "", "ab cd"]
    rows, want = [], set()
    for k, t in enumerate(items[:4]):
        for e in range(0, int(0.2 * len(t.split())) + 1, 2):
            w = t.upper().split()
            for _ in range(e):
                p = rng.randrange(len(w))
                w[p : p + 1] = rng.choice([[], ["new"], [w[p], "more"]])
            rows.append(soup(rng, 30) + " " + "!! ".join(w) + " " + soup(rng, 20))
            want.add((len(rows) - 1, k))
    rows += [soup(rng, 200) for _ in range(10)] + [None, "", "x ab cd y", items[2][: len(items[2]) // 3]]
    bench = spark.createDataFrame([*enumerate(items), (0, items[0]), (None, "z")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in edit_lsh.contaminated(docs(spark, rows), bench).collect()}
    assert not want - got and got - want == {(len(rows) - 2, 6)}
    assert edit_lsh.contaminated(empty(spark), bench).count() == 0 and edit_lsh.contaminated(docs(spark), bench.limit(0)).count() == 0


def test_lsh_recall_by_item_length_against_brute_force(spark):
    rng = np.random.default_rng(9)
    items, rows, owner = [], [], []
    for n in (1, 3, 5, 8, 10, 15, 20, 40, 59, 100, 180, 400):
        w = [f"w{x}" for x in rng.integers(1, 1 << 40, n)]
        items.append(" ".join(w))
        d = n // 5 if n >= 5 else 0
        for k in range(40):  # substitutions, insertions, deletions, a mixture, and all edits at one end
            out = list(w)
            for _ in range(d):
                p, do = int(rng.integers(len(out))) if k % 5 < 4 else 0, k % 4 if k % 4 < 3 else int(rng.integers(3))
                out[p : p + (do != 1)] = [f"v{rng.integers(1 << 40)}"] if do < 2 else []
            fill = lambda: [f"u{x}" for x in rng.integers(1, 1 << 40, 30)]
            rows.append(" ".join(fill() + out + fill()))
            owner.append(len(items) - 1)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in edit_lsh.contaminated(docs(spark, rows), bench).collect()}
    words = lambda t: edit_lsh.Words(edit_lsh.lowered(pd.Series([t], dtype=object)), edit_lsh.GAP).hash
    want = {(i, k): edit_lsh.distance_in(words(items[k]), words(rows[i])) for i, k in enumerate(owner)}
    assert all(d <= len(items[k].split()) // 5 for (_, k), d in want.items()) and set(got) <= set(want)
    assert all(got[x] == want[x] for x in got)
    for k in range(len(items)):  # each length by itself
        assert sum((i, k) in got for i, o in enumerate(owner) if o == k) >= 38, (k, len(items[k].split()))
    assert len(got) >= 0.99 * len(want), sorted(set(want) - set(got))


def test_word_pairs_of_a_match_are_a_lower_bound():
    for n in range(1, 120):
        c = edit_lsh.fitted(*edit_lsh.class_of(n), 0.8, 5, 2, 0.9, 40)
        d = n // 5 if n >= 5 else 0
        assert c.lo <= n <= c.hi and c.far >= d and c.pairs <= n - 1 - 2 * d and c.least <= n - d and (n < 2 or c.pairs > 0)


def test_edit_distance_in_text():
    a = lambda s: np.array([ord(c) for c in s], np.uint64)
    assert [edit_lsh.distance_in(a("abcd"), a(t)) for t in ("xxabcdyy", "xxabdyy", "axbxcxd", "zz")] == [0, 1, 3, 4]


def test_secrets_base_and_entropy(spark):
    rows = [*texts(), "key " + "aB3dE5gH7jK9mN1pQ4sT6vW8" + " end", "id 123e4567-e89b-12d3-a456-426614174000", "x" * 40, "thisIsAVeryLongIdentifierName"]
    assign = re.compile(secrets.ASSIGN)
    got = {r.doc_id: r for r in secrets.report(docs(spark, rows)).collect()}
    for d, t in enumerate(rows):
        t = t or ""
        s = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        s += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{k}:{a}:{e}" for a, _, k, e in sorted(s))
        assert got[d].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (d, base, got[d].spans)
        assert {x for x in base.split(",") if x} <= set(got[d].spans.split(","))
    n = len(rows)
    assert "alnum:4:28" in got[n - 4].spans and got[n - 3].spans == got[n - 2].spans == got[n - 1].spans == ""
    assert secrets.report(empty(spark)).count() == 0


def test_secrets_of_very_many_and_very_long_candidates(spark):
    rng = random.Random(2)
    long = "".join(rng.choices(secrets.ALPHABET[:64], k=200_000))
    rows = [" ".join(f"token=abc{i:07d}" for i in range(20_000)), long, "pad " + "A" * 9 + "bK3xQ9zR7mW2vT8pL5nJ" + " end"]
    began = time.time()
    got = {r.doc_id: r for r in secrets.report(docs(spark, rows)).collect()}
    assert time.time() - began < 90
    assert got[0].n_assign == 20_000 and got[0].spans.endswith(f"assign:{len(rows[0]) - 16}:{len(rows[0])}")
    assert got[1].spans == "base64:0:200000" and "alnum:4:33" in got[2].spans


def test_window_entropy(spark):
    word = "aB3dE5gH7jK9mN1pQ4sT6vW8aaaa"
    best = max(-sum(c / 20 * np.log2(c / 20) for c in map(word[i : i + 20].count, set(word[i : i + 20]))) for i in range(len(word) - 19))
    got = spark.createDataFrame([(word,)], "w string").select(secrets.entropy(F.col("w"), 20).alias("e")).first().e
    assert abs(got - best) < 1e-9


def test_pii_round_trip_and_links(spark):
    rows = ["mail a.b@x1.example.com and a.b@x1.example.com", "card 4111 1111 1111 1111, 4111-1111-1111-1112", "on 2024-02-29 or 30.02.2024", "ip 10.0.0.1 and 999.1.1.1", "+1 (407) 555-7710", "ssn 123-45-6789 000-12-3456", "DE89 3704 0044 0532 0130 00", None, "", "no value 12", "a.b@x1.example.com"]
    df = docs(spark, rows).withColumn("pii_counts", F.lit("clash"))
    out = pii.pseudonymize(df, b"k")
    got = {r.doc_id: r for r in out.collect()}
    mails = re.findall(r"\S+@\S+", got[0].text)
    assert mails[0] == mails[1] == got[10].text and mails[0] != "a.b@x1.example.com" and got[7].text is None and got[9].text == rows[9]
    card = re.sub(r"\D", "", got[1].text.split(",")[0])
    assert pii.luhn(card) and card != "4111111111111111" and got[2].text.endswith("30.02.2024") and "999.1.1.1" in got[3].text and "000-12-3456" in got[5].text
    assert got[4].text.startswith("+1 (") and pii._mod97(got[6].text.replace(" ", "")) == 1
    assert {r.doc_id: r.text for r in pii.restore(out, b"k").collect()} == dict(enumerate(rows))
    assert pii.pseudonymize(df, b"other").where("doc_id = 10").first().text != got[10].text and pii.report(empty(spark), b"k").count() == 0


def test_pii_of_single_digits_alone_in_a_text(spark):
    rows = ["8.8.8.8", "card 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "dns 8.8.8.8 in 24"]
    out = pii.pseudonymize(docs(spark, rows), b"k")
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].pii_counts == got[2].pii_counts == {"ipv4": 1} and got[1].pii_counts == {"card": 1}
    assert got[0].text != rows[0] and got[0].text in got[2].text and {r.doc_id: r.text for r in pii.restore(out, b"k").collect()} == dict(enumerate(rows))


def test_pii_random_round_trips_of_every_kind():
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    luhn = lambda b: b + next(c for c in "0123456789" if pii.luhn(b + c))
    spaced = lambda s: " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def iban():
        body = "".join(rng.choices("0123456789ABCDEFGH", k=rng.randint(11, 30)))
        return f"DE{98 - pii._mod97('DE00' + body):02d}{body}"

    def day(form):
        d = pii.FIRST_DAY + timedelta(rng.randrange(pii.DAYS))
        name = pii.MONTHS[d.month - 1].title()
        return form.format(d=d.day, m=d.month, y=d.year, name=name, short=name[:3].upper())

    forms = ("{d}/{m}/{y}", "{d:02d}/{m:02d}/{y}", "{m}/{d}/{y}", "{y}-{m:02d}-{d:02d}", "{y}/{m:02d}/{d:02d}", "{d} {short} {y}", "{name} {d}, {y}", "{d}.{m}.{y}")
    made = [lambda f=f: day(f) for f in forms] + [
        lambda: "".join(rng.choices("abXY019._", k=rng.randint(1, 9))) + "a@b1.example.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), iban,
        lambda: luhn(digits(rng.randint(12, 18))), lambda: spaced(luhn(digits(15))), lambda: digits(rng.randint(9, 19)), lambda: f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        lambda: f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: " ".join(digits(n) for n in rng.choice([(4, 4, 4), (4, 3, 3, 3), (2, 3, 3, 2)])), lambda: "+" + digits(rng.randint(10, 15)),
    ]
    for make in made:
        for _ in range(300):
            text = f"x {make()} y"
            spans = pii.found(text, b"k")
            new = pii.replaced(text, spans)
            assert spans and len(new) == len(text) and pii.replaced(new, pii.found(new, b"k", True)) == text, (text, new)
    many = " ".join(f"{i}.{j}.1.1" for i in range(100, 250) for j in range(100))
    assert len(pii.found(many, b"k")) == 15_000


def test_permutation_is_one():
    for size in (1, 2, 3, 10, 997):
        image = [pii.permute(i, size, b"k", "t") for i in range(size)]
        assert sorted(image) == list(range(size)) and [pii.permute(v, size, b"k", "t", True) for v in image] == list(range(size))


def suffix_brute(rows, length):
    raw = [(t or "").encode() for t in rows]
    count = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((bytes(np.frombuffer(b, np.uint8)[~gone]), int(gone.sum())))
    return out


def test_suffix_dedup_by_brute_force(spark, monkeypatch):
    rows = [t for t in texts() if t is None or len(t) < 6000]
    rows += [rows[12], rows[12]]
    want = suffix_brute(rows, 100)
    for crowd in (suffix_family.CROWD, 1):  # the second sends all strings through the shuffle
        monkeypatch.setattr(suffix_family, "CROWD", crowd)
        got = {r.doc_id: r for r in suffix_family.dedup(docs(spark, rows), 100).collect()}
        for d, (kept, n) in enumerate(want):
            assert bytes(got[d].kept) == kept and got[d].n_removed == n and got[d].n_spans == len(got[d].spans), d
    assert suffix_family.report(empty(spark)).count() == 0


def test_batches_added_one_by_one_equal_one_run(spark, tmp_path):
    rng = random.Random(5)
    shared = [soup(rng, 40) for _ in range(6)]
    rows = [" ".join([soup(rng, 10), *rng.sample(shared, 2), soup(rng, 10)]) for _ in range(24)] + [None, "", shared[0]]
    want, base, sizes = suffix_brute(rows, 100), f"file://{tmp_path}/family", []
    df = docs(spark, rows)
    df = df.withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))  # a null id
    for b in range(5):
        family = suffix_family.IndexFamily(spark, base, 100, 32)  # opened anew for each batch
        family.add(df.where(F.col("a") % 5 == b))
        sizes.append(family.sizes)
        seen = [i for i in range(len(rows)) if i % 5 <= b]
        if b in (1, 4):
            part = suffix_brute([rows[i] for i in seen], 100)
            out = suffix_family.removed(df.where(F.col("a") % 5 <= b), suffix_family.IndexFamily(spark, base), Scratch(spark, "t"))
            got = {3 if r.doc_id is None else r.doc_id: (bytes(r.kept), r.n_removed) for r in out.collect()}
            assert got == dict(zip(seen, part, strict=True))
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]] and sum(n for _, n in want) > 0
    level = spark.read.parquet(suffix_family.IndexFamily(spark, base).state["levels"][0][1]).orderBy("key").collect()
    keys = [bytes(r.key) for r in level]
    assert keys == sorted(set(keys)) and all(len(k) == 32 for k in keys)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    assert all(r.lcp in (0, common(a, b)) for r, a, b in zip(level[1:], keys, keys[1:]))


def test_window_minima_and_pieces(monkeypatch):
    x = np.random.default_rng(0).integers(0, 50, 200).astype(np.uint64)
    for w in (1, 2, 7, 200):
        assert (suffix_family.window_min(x, w) == [x[i : i + w].min() for i in range(len(x) - w + 1)]).all()
    monkeypatch.setattr(suffix_family, "PIECE", 64)
    data = bytes(range(200))
    got = [lo + i for lo, p in suffix_family.pieces(data, 30) for i in range(len(p) - 29)]
    assert got == list(range(171))


def test_gumbel_samples_match_the_distribution():
    pieces = gumbel_pieces.Pieces.load(gumbel_pieces.MODEL)
    known = {t: i for i, t in enumerate(pieces.text)}

    def all_of(s):
        if not s:
            yield ()
        for n in range(1, len(s) + 1):
            if s[:n] in known:
                for rest in all_of(s[n:]):
                    yield (known[s[:n]], *rest)

    every = [a + b for a in all_of("▁the") for b in all_of("▁cat")]
    p = np.exp([sum(pieces.weight[i] for i in s) for s in every])
    p = dict(zip(every, p / p.sum(), strict=True))
    got = gumbel_pieces.sample_batch(["the cat"] * 1500, np.arange(1500), 3, 1, pieces)
    assert all(len({tuple(s[3]) for s in g}) == 3 for g in got) and all(abs(s[0] - np.log(p[tuple(s[3].tolist())])) < 1e-5 for g in got for s in g)
    top = max(p, key=p.get)
    assert abs(sum(tuple(g[0][3].tolist()) == top for g in got) / 1500 - p[top]) < 0.05
    weight = np.mean([sum(np.exp(s[0]) / s[2] for s in g[:-1] or g) for g in got])
    assert 0.8 < weight < 1.2


def test_piece_table_finds_every_piece():
    pieces = gumbel_pieces.Pieces.load(gumbel_pieces.MODEL)
    shared = pieces.slot[pieces.spot(pieces.keys)] < 0
    assert shared.any() and not shared.all()  # both ways of finding are met
    assert (pieces.at(pieces.keys) == np.arange(len(pieces.keys))).all()
    other = pieces.keys ^ np.uint64(1)
    assert ((pieces.keys[pieces.at(other)] == other) == np.isin(other, pieces.keys)).all()
    ids = np.concatenate([pieces.ids[:500], pieces.byte[[0, 65, 255]]])
    want = "".join(pieces.text[i] for i in pieces.ids[:500]).replace("▁", " ").encode() + b"\x00A\xff"
    assert pieces.raw(ids) == want and pieces.raw(ids[:0]) == b""


def test_lattice_grows_by_what_it_lacks():
    pieces = gumbel_pieces.Pieces.load(gumbel_pieces.MODEL)
    lattice, words = gumbel_pieces.Lattice(pieces), [f"word{i}ing" for i in range(300)]
    lattice.reset(8000)
    lattice.room(10)
    for lo in (0, 100, 200):
        lattice.words([words[lo : lo + 100]])
        assert lattice.arcs <= len(lattice.key) <= lattice.arcs + 2000
    whole = gumbel_pieces.Lattice(pieces)
    whole.words([words[:100]])
    assert (whole.key[: whole.arcs] == lattice.key[: whole.arcs]).all()


def test_segmentation_round_trip_and_edges(spark):
    rows = [*texts(), "a", " ", "▁▁ x", "tab\t\nnew  line"]
    df = docs(spark, rows)
    got = {}
    for r in sorted(gumbel_pieces.segment(df, k=3, seed=5).collect(), key=lambda r: r.rank):
        got.setdefault(r.doc_id, []).append(r)
    assert all(s.text_ok for r in got.values() for s in r) and len(got) == len(rows)
    assert len(got[0]) == len(got[1]) == 1 and got[1][0].inclusion == 1.0 and got[1][0].n_pieces == 0
    assert all(len({tuple(s.ids) for s in r}) == len(r) for r in got.values())
    assert all(a.perturbed >= b.perturbed for r in got.values() for a, b in zip(r, r[1:]))
    ids = spark.createDataFrame([(d, s.ids) for d, r in got.items() for s in r] + [(-1, None)], "doc_id long, ids array<int>")
    assert all(r.text == (None if r.doc_id < 0 else rows[r.doc_id] or "") for r in gumbel_pieces.decode(ids).collect())
    again = {(r.doc_id, r.rank): r.ids_sha256 for r in gumbel_pieces.segment(df.repartition(3), k=3, seed=5).collect()}
    assert again == {(d, s.rank): s.ids_sha256 for d, r in got.items() for s in r}
    assert gumbel_pieces.report(empty(spark)).count() == 0


def test_pipeline_bounds_the_bytes_of_a_batch(spark):
    key, session = "spark.sql.execution.arrow.maxBytesPerBatch", spark.newSession()

    def largest():
        def sizes(frames):
            for x in frames:
                yield pd.DataFrame({"n": [int(x["text"].str.len().sum())]})

        texts = session.range(0, 3000, numPartitions=1).select(F.expr("repeat('a b ', 1500) as text"))
        return max(r.n for r in texts.mapInPandas(sizes, "n long").collect())

    assert largest() == 18_000_000
    corpus_pipeline.pieces(session, session.createDataFrame([(1, "a")], "doc_id long, text string"), "")
    assert largest() < 6_000_000
    session.conf.set(key, "9000000")  # a bound of the session's own stays
    corpus_pipeline.pieces(session, session.createDataFrame([(1, "a")], "doc_id long, text string"), "")
    assert session.conf.get(key) == "9000000" or session.conf.get(key) == "9000000b"


def test_pipeline_stages_by_brute_force(spark):
    """Each stage on what its predecessor kept, with a null text, an empty one, repeated rows and clashing columns added."""
    import corpus_pipeline
    import duckdb

    sf = "/root/testdata/sf0.001"
    stage = dict(corpus_pipeline.STAGES)
    given = spark.read.parquet(f"{sf}/documents.parquet")
    odd = given.limit(1).select((F.col("doc_id") + 100_000).alias("doc_id"), F.lit(None).cast("string").alias("text"), *corpus_pipeline.COLUMNS[2:])
    odd = odd.union(odd.select(F.col("doc_id") + 1, F.lit(""), *corpus_pipeline.COLUMNS[2:]))
    held = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    fixed = lambda df: spark.createDataFrame(df.collect(), df.schema)

    model = quality_fm.train(given, corpus_pipeline.held_out(spark.read.parquet(f"{sf}/labels.parquet")).where("not held_out"))
    good = {r.doc_id for r in quality_fm.score(given, model).where("score >= 0.5").collect()}
    one = fixed(stage["quality"](spark, given, sf))
    assert set(held(one)) == good and one.columns == corpus_pipeline.COLUMNS

    two_in = one.unionByName(odd).withColumns({"gone": F.lit(1), "d": F.lit("x"), "h": F.lit("y")})
    two = fixed(stage["lines"](spark, two_in, sf))
    db = duckdb.connect()
    db.register("documents", two_in.select("doc_id", "text").toPandas())
    want = db.sql(line_runs.SQL.format(min_chars=200) + " select c.doc_id, string_agg(c.line, chr(10) order by c.p) filter (g.p is null), count(g.p) from c left join g on c.doc_id = g.doc_id and c.p = g.p group by 1").fetchall()
    want = {d: (x, n) for d, x, n in want}
    got, before = held(two), held(two_in)
    assert set(got) == {d for d, (x, n) in want.items() if not n or (x or "").strip()}
    assert all(got[d] == (want[d][0] if want[d][1] else before[d]) for d in got) and two.columns == corpus_pipeline.COLUMNS

    three_in = two.unionByName(two.where("doc_id % 9 = 0"))  # repeated rows
    three = fixed(stage["near_copies"](spark, three_in, sf))
    ids = sorted(held(two))
    words = [(held_ or "").encode().lower().split() for held_ in (got[d] for d in ids)]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []) for w in words]
    comp = components(len(ids), lambda i, j: bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    assert set(held(three)) == {d for i, d in enumerate(ids) if comp[i] == i}

    four = fixed(stage["leaks"](spark, three, sf))
    hashes = lambda x: edit_lsh.Words(edit_lsh.lowered(pd.Series([x], dtype=object)), edit_lsh.GAP).hash
    items = [hashes(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = set()
    for d, x in held(three).items():
        h = hashes(x)
        for item in items:
            far = len(item) // 5 if len(item) >= 5 else 0
            if len(item) and len(h) and np.isin(item, h).sum() >= len(item) - far and edit_lsh.distance_in(item, h) <= far:
                gone.add(d)
    assert set(held(three)) - set(held(four)) == gone and gone

    five = stage["pieces"](spark, four, sf).collect()
    texts_ = held(four)
    pieces = gumbel_pieces.Pieces.load(gumbel_pieces.MODEL)
    assert {r.doc_id for r in five} == set(texts_)
    assert all(r.text_ok and pieces.decode(np.array(r.ids, np.int32)) == (texts_[r.doc_id] or "") for r in five)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 0 < len(ids) < d.count() and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "leaks", "pieces"]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [r.text for r in d.collect() if r.doc_id in ids]
    assert len(left) == len(set(left)) and not any(i in t for t in left for i in items)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.limit(0), sf).count() == 0, name
