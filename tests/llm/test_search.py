"""Secrets, periodic runs and ranked search against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import lexical, registry
from cellweave.llm.lexical import lexical_search
from cellweave.llm.ownership import secrets
from cellweave.llm.runs import periodic_runs, planted, runs_of, strongest

D = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, source string, row int, size string, term string, repo string, n int, runs string, slot int, "
          "found string, spans string, hash string")
OTHER = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
TOKEN = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "z", "t", "r", 2, "x", 3, "f", "p", "h") for i, t, s in rows], SCHEMA)


def brute_runs(w, shortest=24, periods=3):
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            own = w[i:j + q]
            if j > i and len(own) >= max(shortest, periods * q) and not any(own[k:] == own[:-k] for k in range(1, q)):
                out.append((i, len(own), q))
            i = max(i + 1, j + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return b" ".join(x for k, x in enumerate(w) if k not in gone).decode()


def repetitive(rng):
    texts = [None, "", " \n ", "a", "a " * 23, "a " * 24, "x y " * 12, "x y " * 11 + "x", "é ü 漢 " * 9, "\x1f \x0b\x0c" * 30]
    for _ in range(120):
        k, w = int(rng.integers(1, 6)), []
        while len(w) < 150:
            root = rng.integers(0, k, int(rng.integers(1, 40))).tolist()
            w += (root * 7)[:int(rng.integers(1, 6 * len(root) + 1))] if rng.random() < 0.6 else rng.integers(0, 99, 9).tolist()
        texts.append(" ".join(map(str, w)))
    long = [str(v) for v in rng.integers(0, 900, 3000)]
    return [*texts, " ".join(long * 4), " ".join(map(str, rng.integers(0, 30, 9000))), "ha " * 8000]


def test_runs_of_short_words():
    assert runs_of(np.array([0] * 24)) == [(0, 24, 1)] and runs_of(np.array([0] * 23)) == [] and runs_of(np.zeros(0, np.int64)) == []
    # two runs of one period that share words, and a long period that only blocks find
    w = [0, 1] * 13 + [1, 0] * 13
    assert runs_of(np.array(w)) == brute_runs(w)
    w = list(range(50)) * 3 + [7] + list(range(50)) * 2
    assert runs_of(np.array(w)) == brute_runs(w) == [(0, 150, 50)]


def test_periodic_runs(spark):
    rows = list(enumerate(repetitive(np.random.default_rng(2))))
    rows += [rows[20], (None, "x y " * 20), (None, None)]
    got = periodic_runs(table_of(spark, [(i, t, None) for i, t in rows]).repartition(3)).withColumn("best", strongest()).collect()
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        # the long texts are known: four times 3000 words, none in the random one, one word
        runs = brute_runs(w) if len(w) < 2000 else [(0, 12000, 3000)] if len(w) == 12000 else [] if len(w) == 9000 else [(0, 8000, 1)]
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        want.append((i, tuple(runs), collapse(w, runs), best))
    seen = [(r.doc_id, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed, r.best and tuple(r.best)) for r in got]
    assert sorted(seen, key=str) == sorted(want, key=str) and sum(len(w[1]) for w in want) > 100
    assert periodic_runs(table_of(spark, [])).count() == 0


def test_planted(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 67))) for i in range(400)] + [(-3, "a b"), (None, "a  b"), (None, None)]
    got = planted(table_of(spark, [(i, t, None) for i, t in rows])).collect()
    changed = 0
    for (i, t), r in zip(rows, got):
        h = 1 if i is None else zlib.crc32(str(i).encode())
        w, g = (t or "").split(), h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(len(w))]
            changed += 1
        assert r.text.split() == w and r.doc_id == i
    assert changed > 20


def test_runs_query_against_sql(spark):
    compare(spark, "op12_frequency_split_runs")


def compare(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = con.execute(registry.SQL[name])
    names = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    rows = [tuple(r[i] for i in order) for r in want.fetchall()]
    got = [tuple(r) for r in registry.QUERIES[name](spark, D).select(*names).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str) and got


ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute_base(text):
    out = [("assign", m) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 12]
    out += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    place = {"assign": 0, "access": 1, "hex": 2}
    return [(k, m.start(), m.end()) for k, m in sorted(out, key=lambda x: (x[1].start(), place[x[0]]))]


def test_secrets(spark):
    live, copied, key = "k9Xq27LmPz81RtVw", "Zt5Bn8Qw3Er7Yu1Io", "ghp_" + "a1B2c3D4e5F6g7H8i9J0"
    rows = [None, "", " ", "token", f'é🙂 token = "{TOKEN}" end', f"TOKEN: {OTHER}", "token = short", "ſecret=abcdefghijklmnop",
            "AKIA" + "B" * 14, "AKIAAKIA" + "C" * 9, "deadbeef" * 2, "deadbeef" * 3 + "G", "api_key='abc.def/ghi+jkl=='", "apikey:=aaaaaaaaaaaaaaa",
            "PassWord:    \"abcdefghijkl\" secret=abcdefghijkl token=x", f"pwd => {live}", "pwd => aaaaaaaaaaaaaaaa", "pwd => example12AB34cd",
            f"my key {key} here", "123e4567-e89b-42d3-a456-426614174000", "secret=" * 5 + "x" * 20,
            "x" * 40000 + f" token={TOKEN} " + "ab " * 9000 + f"token={TOKEN}"]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(rows)]
    rows += [(100 + i, f"auth = {copied} in text {i}", f"s{i}") for i in range(5)]
    # mirrored copies of one text are one repository, and one owner's many texts are one owner
    rows += [(200 + i, "bearer: Qm4Xw9Lk2Pz7Vt1B", f"s{i}") for i in range(5)]
    rows += [(300 + i, f"bearer: Hn3Yc8Ud5Rb6Jf0S in text {i}", "s1") for i in range(5)]
    rows += [rows[4], (None, f"token={TOKEN}", None), (None, None, None)]
    got = secrets(table_of(spark, rows).repartition(3)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _, _ in rows)
    texts = collections.defaultdict(set)
    for i, t, _ in rows:
        texts[i].add(t or "")
    added, spans = collections.defaultdict(list), {}
    for r in got:
        base = [(x.kind, x.start, x.end) for x in r.spans if x.base]
        assert any(base == brute_base(t) for t in texts[r.doc_id])
        assert [(x.start, x.kind) for x in r.spans] == sorted(((x.start, x.kind) for x in r.spans), key=lambda x: (x[0], ("assign", "access", "hex").index(x[1])))
        added[r.doc_id] += [x.value for x in r.spans if not x.base]
        spans[r.doc_id] = r.spans
    assert added[15] == [live] and added[16] == [] and added[17] == [] and added[18] == [key] and added[19] == ["123e4567-e89b-42d3-a456-426614174000"]
    assert added[5] == [OTHER] and (spans[4][0].repos, spans[4][0].owners) == (3, 3)
    assert all(added[100 + i] == [] for i in range(5)) and all(added[200 + i] == ["Qm4Xw9Lk2Pz7Vt1B"] and added[300 + i] == ["Hn3Yc8Ud5Rb6Jf0S"] for i in range(5))
    assert all(x.copied and not x.live for x in spans[4])
    assert secrets(table_of(spark, [])).count() == 0
    # a value that holds most spans goes by broadcast, the others by shuffle; the result is the same
    again = secrets(table_of(spark, rows), support=0.3).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_secrets_query_against_sql(spark):
    compare(spark, "op11_ownership_secrets")
    row = registry.QUERIES["op11_ownership_secrets"](spark, D).filter("n_hex > 0").first()
    text = spark.read.parquet(f"{D}/documents.parquet").filter(F.col("doc_id") == row.doc_id).first().text
    assert hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in brute_base(text)).encode()).hexdigest() == row.base_sha256


def brute_search(docs, items, k=10):
    folded = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

    def split(t):
        return [x.decode() for x in re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(folded))]
    own = [(i, split(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    df = collections.Counter(t for _, w in own for t in set(w))
    out = []
    for item, text in items:
        asked, found = collections.Counter(split(text)), []
        for i, w in own:
            tf, score = collections.Counter(w), 0
            for t, times in asked.items():
                if t in tf:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * weight * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * (25 + 75 * len(w) * n_docs // total)))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("shard", [8192, 7])
def test_lexical_search(spark, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD", shard)
    rng = np.random.default_rng(4)
    words = [f"W{i}" for i in range(300)] + ["Été", "漢字", "ſ", "K"]
    pick = 1 / np.arange(1, len(words) + 1)
    docs = [None, "", "...", "w0", "W0-w0_w1"] + [" ".join(rng.choice(words, int(n), p=pick / pick.sum())) for n in rng.integers(1, 200, 150)]
    docs += ["w1 w2 w3 copied text"] * 40 + [" ".join(rng.choice(words, 30_000))]
    docs = [(i, t) for i, t in enumerate(docs)] + [(7, docs[7]), (None, "w1 w2 w3"), (None, "w250 w251"), (None, None)]
    docs = [docs[i] for i in rng.permutation(len(docs))]
    items = [(i, " ".join(rng.choice(words, int(n), p=pick / pick.sum()))) for i, n in enumerate(rng.integers(1, 60, 12))]
    items += [(50, None), (51, ""), (52, "nowhere at all"), (53, "w1 w2 w3 copied text"), (53, "w250"), (None, "w1 W1 w1")]
    given = table_of(spark, [(i, t, None) for i, t in docs]).repartition(4)
    asked = spark.createDataFrame([(i, t, 1, 1, "d") for i, t in items], "item_id long, text string, rank int, score int, doc_id string")
    want = sorted(brute_search(docs, items), key=str)
    for pairs in (400_000, 60):
        got = lexical_search(given, asked, block_pairs=pairs)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert lexical_search(given.limit(0), asked).count() == 0 and lexical_search(given, asked.limit(0)).count() == 0


def test_lexical_search_opens_few_documents():
    """The bounds work: with one document that holds the rare terms, most others are never scored."""
    rng = np.random.default_rng(1)
    n, terms = 4000, 8
    term = np.concatenate([np.repeat(np.arange(4), n), np.full(12, 4), np.full(12, 5)])
    doc = np.concatenate([np.tile(np.arange(n), 4), np.arange(12) * 300, np.arange(12) * 300])
    impact = np.concatenate([rng.integers(1, 100, 4 * n), rng.integers(10_000, 20_000, 24)])
    shard, best = lexical.Shard(term, doc, impact, terms, n), lexical.Best(10)
    opened = lexical.search_shard(shard, np.arange(n), np.arange(terms), np.ones(terms, np.int64), best)
    want = np.zeros(n, np.int64)
    np.add.at(want, doc, impact)
    order = np.lexsort((np.arange(n), -want))[:10]
    assert best.ids.tolist() == order.tolist() and best.score.tolist() == want[order].tolist() and opened < 200


def test_search_query_against_sql(spark):
    compare(spark, "op13_interval_search")
