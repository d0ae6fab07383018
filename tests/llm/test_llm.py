"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import html
import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweave.llm import postings, registry
from cellweave.llm.brown import brown_scores, exchange
from cellweave.llm.components import components
from cellweave.llm.exact_dedup import exact_dedup, keep_first
from cellweave.llm.html_text import extract_text
from cellweave.llm.mixing import min_cost_flow, mix, mixed, targets
from cellweave.llm.near_dedup import keep_representatives, near_dedup
from cellweave.llm.packing import Encoder, pack, pack_lengths
from cellweave.llm.pii import personal_data
from cellweave.llm.postings import nearest_neighbours
from cellweave.llm.sharding import kd_shards, shard_documents
from cellweave.llm.toxicity import reject_toxic, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
D = "/root/testdata/sf0.001"
#: extra columns with names that the operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, row int, size string, id string, digest string, n int, component string, doc string"


def documents(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words, 6000))
    base = " ".join(rng.choice(words, 200)).split()
    near = base[:100] + ["x"] + base[101:]
    texts = [None, "", " \t ", "one", "One  two", "one\ttwo", "one two", "a b c d e", "A B C D E", "a b c d f", long, long,
             " ".join(base), " ".join(near), " ".join(near + ["tail"]), " ".join(base[:120] + list(rng.choice(words, 80))),
             "é ü 🙂 <|endoftext|> 漢字", "x" * 5000, "mail me a.b@c.de now or call +1 (017) 555-7713"]
    texts += [" ".join(rng.choice(words, int(k))) for k in rng.integers(1, 300, 60)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None) for i, t in enumerate(texts)]
    rows += [rows[12], rows[3], (None, "one two", "en", "s1"), (None, None, None, None)]
    return spark.createDataFrame([(*r, 1, "z", "q", "d", 2, "c", "y") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    documents(spark).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def words_of(text):
    return (text or "").encode().lower().split()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (200, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}


def test_exact_dedup(docs, empty):
    want = collections.defaultdict(list)
    for i, t in rows_of(docs):
        want[re.sub(r"[ \t-\r]+", " ", t or "")].append(i)
    got = exact_dedup(docs).collect()
    assert len(got) == docs.count()
    for text, ids in want.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        own = [r for r in got if r.text_sha256 == sha]
        low = min((i for i in ids if i is not None), default=None)
        assert sorted(str(r.doc_id) for r in own) == sorted(map(str, ids))
        assert {r.keep_id for r in own} == {low} and {r.group_size for r in own} == {len(ids)}
        assert [r.doc_id for r in own if r.kept] == [low]
    kept = keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)
    assert exact_dedup(empty).count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        if i is not None:
            sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return sets, label


def test_near_dedup(docs, empty, spark):
    sets, label = brute_components(rows_of(docs))
    got = near_dedup(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)
    kept = keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({v for v in label.values()})
    assert near_dedup(empty).count() == 0


def test_near_dedup_links_through_others(spark):
    """Chains of copies, and a bucket full of texts that share a passage and are no copies."""
    rng, words = np.random.default_rng(1), [f"v{i}" for i in range(5000)]
    passage, rows, text = list(rng.choice(words, 60)), [], list(rng.choice(words, 150))
    for i in range(12):
        text = text[:10 * i] + list(rng.choice(words, 4)) + text[10 * i + 4:]
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(passage + list(rng.choice(words, 40)))) for i in range(60)]
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)[1]


def test_packing(docs, empty):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(PATH)
    ids = collections.defaultdict(list)
    for i, t in rows_of(docs):
        ids[i].append(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4"))
    got = pack(docs, PATH).collect()
    found = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want = collections.Counter()
    for i, many in ids.items():
        for own in many:
            cuts = [0, *range(len(own) % 2048 or 2048, len(own) + 1, 2048)]
            want.update((i, k, a, b - a, zlib.crc32(own[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert found == want
    for _, own in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        end = 0
        for r in own:
            assert r.offset == end
            end += r.length
        assert end <= 2048
    assert pack(empty, PATH).count() == 0


def test_pack_lengths_fills_exactly():
    rng = np.random.default_rng(3)
    counts = dict(collections.Counter(rng.integers(1, 2049, 30_000).tolist()))
    plan = pack_lengths(counts, 2048)
    used = collections.Counter()
    for own, times in plan:
        assert sum(own) <= 2048 and times > 0
        for n in own:
            used[n] += times
    assert used == counts
    bins, large = sum(t for _, t in plan), sum(c for n, c in counts.items() if n > 1024)
    assert bins <= 1.02 * max(large, math.ceil(sum(n * c for n, c in counts.items()) / 2048))
    assert pack_lengths({1000: 3, 48: 1}, 2048) == [((1000, 1000, 48), 1), ((1000,), 1)] and pack_lengths({}, 2048) == []


def test_encoder_equals_the_tokenizer():
    encode = Encoder(open(PATH, encoding="utf-8").read(), bound=50)
    texts = ["", " ", "a  b", "I'll  don't\n\n x's ", "¼½² 12abc é ü", "tab\t\tx \r\n", "<|endoftext|> a", "日本 x", "a\u0085b", "Ĳſµªº×÷", "…—!!%%% a&&&", "\x00\x1f"]
    texts += [t for t in texts[::-1]] + ["word" * 1000]
    want = [np.array(e.ids, "<u4").tobytes() for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert list(encode(texts)) == want and list(encode(texts, block=1)) == want


PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
        "<header><h1>Site</h1></header><nav><ul><li><a href='/x'>Menu</a></ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><header><h1>Title {k}</h1></header><p>First &amp; <b>bold {k}</b><br>line\n two<p>Second&nbsp;&#x41;{k}</p>"
        "<div>Share this page</div><form>Mail <input></form><section class='comments'><p>nice!</p></section></article>"
        "<aside>Side</aside><footer>&copy; me</footer></body></html>")


def test_templates_alone_find_the_article(spark):
    """No markup names the parts: menus of a site's few kinds go, as they stand beside different articles; copied articles stay."""
    rng = np.random.default_rng(12)
    words = [f"word{i}" for i in range(500)]

    def prose(n):
        return [" ".join(rng.choice(words, 12)) for _ in range(n)]

    menus = [f"<div><ul><li>Home {i}<li>News {i}</ul></div>" for i in range(4)]
    ends = [f"<div>Imprint {i} <span>of the site</span></div>" for i in range(3)]
    copied, bodies = prose(4), {}
    rows = []
    for k in range(60):
        body = copied if k % 12 == 0 else prose(int(rng.integers(2, 6)))
        shared = ["Read on below."] if k % 3 else []  # a line of two thirds of all articles
        text = "".join(f"<p>{t}</p>" for t in body[:1] + shared + body[1:])
        rows.append((k, f"https://site.example/{k}", f"<body>{menus[k % 4]}<div>{text}</div>{ends[k % 3]}</body>"))
        bodies[k] = "\n\n".join(body)
    # a small host: nothing recurs beside three different articles, so nothing is deleted
    rows += [(100 + k, f"https://few.example/{k}", f"<body><div><ul><li>Menu</ul></div><div><p>{'same text' if k else 'other text'}</p></div></body>") for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for broadcast in (1000, 0):
        got = {r.page_id: r.text for r in extract_text(pages, broadcast=broadcast).collect()}
        assert all(got[k] == bodies[k] for k in bodies) and all(got[100 + k].startswith("Menu\n\n") for k in range(9))


def test_html(spark):
    rows = [(k, f"https://a.example/{k}", PAGE.format(k=k), "h", "t") for k in range(8)]
    rows += [(20, None, PAGE.format(k=20), "h", "t"), (21, "nonsense", None, "h", "t"), (22, "http://b.example", "", "h", "t"),
             (23, "http://b.example/x", "plain a &lt; b <i>text", "h", "t"), (24, "http://b.example/y", "<p>cut <b", "h", "t"),
             (25, "http://b.example/z", "<div>" * 3000 + "deep" + "</div>" * 10, "h", "t"), (0, "https://a.example/0", PAGE.format(k=0), "h", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, template string")
    got = collections.defaultdict(list)
    for r in extract_text(pages).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append(r.text)
    body = "Title {k}\n\nFirst & bold {k} line two\n\nSecond A{k}"
    for k in range(8):
        assert got[k] == [body.format(k=k)] * (2 if k == 0 else 1)  # the repeated block went with the site's template
    assert got[20] == [body.format(k=20) + "\n\nShare this page"]
    assert (got[21], got[22], got[23], got[24], got[25]) == ([""], [""], ["plain a < b text"], ["cut"], ["deep"])
    assert extract_text(spark.createDataFrame([], pages.schema)).count() == 0


def test_html_on_the_given_pages(spark):
    def plain(source):
        inner = source.split("<article>", 1)[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"<p>|</p>|</h1>", inner)]
        return "\n\n".join(b for b in blocks if b)
    want = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{D}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in registry.QUERIES["op2_template_removal"](spark, D).collect()} == want


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def luhn(s):
        return sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(s))) % 10 == 0
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or \
                    kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def test_personal_data(spark, docs, empty):
    hard = ["a@b.c_x@d.e f", "..@x.y a@@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.4 1.2.3.999", "4111 1111 1111 1111, 4111-1111-1111-1112",
            "4111  1111 1111 1111", "+1 (017) 555-7713+49 30 12345678 +1", "🙂é a@b.co 🙂 10.0.0.1", "9" * 30_000, "a" * 50_000 + "@", "1 " * 20_000,
            "x@" * 5_000, "+" * 1000 + "1" * 500, "1." * 4_000, "a@b.c" * 300, "john (at) example (dot) com, 0049 30 1234567"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(hard)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(more)
    texts = collections.defaultdict(list)
    for i, t in rows_of(table):
        texts[i].append(brute_spans(t))
    for r in personal_data(table).collect():
        base = next(b for b in texts[r.doc_id] if hashlib.sha256(",".join(b).encode()).hexdigest() == r.base_sha256)
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in PATTERNS]
    assert personal_data(empty).count() == 0


def test_trees_add_other_shapes_and_refuse_numbers(spark):
    """Taught by base matches and plain numbers only, the trees find shapes that no base pattern matches."""
    rng = np.random.default_rng(9)

    def digits(n):
        return "".join(map(str, rng.integers(0, 10, n)))

    def card():
        while True:
            d = digits(16)
            if sum(int(x) if i % 2 else (2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) for i, x in enumerate(d)) % 10 == 0:
                return " ".join(d[i:i + 4] for i in range(0, 16, 4))

    texts = []
    for i in range(1500):
        name, site = f"user{digits(3)}", f"site{digits(2)}.org"
        ip = ".".join(map(str, rng.integers(0, 256, 4)))
        texts.append([f"please write to {name}@{site} today", f"call us +{digits(2)} {digits(3)} {digits(7)} now", f"the host {ip} was up",
                      f"my card {card()} is new", f"order {digits(16)} came", f"id {digits(12)} and id {digits(10)}",
                      f"commit a{digits(10)}f{digits(3)}", f"version 300.400.{digits(3)}.900 of it"][i % 8])
    hidden = {5000: ("email", "jane (at) places (dot) org"), 5001: ("email", "bob[at]things.net"), 5002: ("ip", "10[.]20[.]30[.]40"),
              5003: ("card", "4111.1111.1111.1111"), 5004: ("phone", "0049 301 2345678")}
    clean = {6000: "order 9807915762804490 came", 6001: "commit a5723915241f370", 6002: "version 300.400.512.900 of it", 6003: "id 572391524123"}
    rows = list(enumerate(texts)) + [(i, f"please call {t} for it") for i, (_, t) in hidden.items()] + list(clean.items())
    table = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, row int, kind string, start int")
    got = {r.doc_id: r for r in personal_data(table).collect()}
    for i, (kind, t) in hidden.items():
        assert got[i].spans == f"{kind}:12:{12 + len(t)}" and got[i].n_added == 1, (i, got[i])
    assert all(got[i].spans == "" for i in clean) and sum(r.n_added for r in got.values()) == len(hidden)


def test_personal_data_on_the_given_documents(spark):
    want = {r.doc_id: brute_spans(r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    for r in registry.QUERIES["op4_boosted_pii"](spark, D).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(want[r.doc_id]).encode()).hexdigest()


def test_brown_scores(docs, empty):
    rows = rows_of(docs)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    count = collections.Counter(w for i, t in rows if not held[i] for w in [*words_of(t), b" "])
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for i, t in rows:
        w = [*words_of(t), b" "]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[i, held[i], len(w), sum(count[x] > 0 for x in w), n, round(base, 6)] += 1
    got = brown_scores(docs).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert brown_scores(empty).count() == 0


def test_brown_model_beats_single_words_on_unseen_texts(spark):
    rows = registry.QUERIES["op5_brown_scores"](spark, D).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_brown_batches_are_small():
    """A task hands on every count, but never more than ROWS of them at once."""
    from cellweave.llm import brown

    texts = [" ".join(f"w{n}" for n in range(i, i + 400)).encode() for i in range(0, 160_000, 400)]
    given = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])
    counted = list(brown._count_batches(iter([given])))
    assert max(b.num_rows for b in counted) <= brown.ROWS < sum(b.num_rows for b in counted)
    assert sum(pa.Table.from_batches(counted).column("n").to_pylist()) == 160_000 + len(texts)

    keys = np.arange(200_000)
    codes = [np.arange(i, i + 500, dtype=np.int32).tobytes() for i in range(1000, 150_000, 500)]
    given = pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array([[]] * len(codes), pa.list_(pa.int64()))], ["codes", "rare"])
    beside = list(brown._neighbour_batches(iter([given]), keys, keys % 128, keys % 32, np.arange(128) % 32))
    assert max(b.num_rows for b in beside) <= brown.ROWS
    assert sum(pa.Table.from_batches(beside).column("n").to_pylist()) == 2 * 500 * len(codes)


def test_brown_classes_of_words_outside_the_units(spark):
    """Two words with one count and ending, beyond the 600 most frequent: each fits the words that it stands between."""
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0]
    taught = [i for i in range(2000) if i not in set(held)]
    sets = [[f"even{n}" for n in range(0, 700, 2)], [f"odd{n}" for n in range(1, 701, 2)]]
    rng = np.random.default_rng(5)
    rows = []
    for n, i in enumerate(taught[:400]):
        words = [str(w) for w in rng.choice(sets[n % 2], 60)]
        if n < 20:
            words[30] = ("firstxyz", "otherxyz")[n % 2]
        rows.append((i, " ".join(words)))
    rows += [(held[0], "even2 firstxyz even4"), (held[1], "even2 otherxyz even4"), (held[2], "odd1 firstxyz odd3"), (held[3], "odd1 otherxyz odd3")]
    got = {r.doc_id: r for r in brown_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert abs(got[held[0]].base_score - got[held[1]].base_score) < 1e-9
    assert got[held[0]].score > got[held[1]].score + 0.5 and got[held[3]].score > got[held[2]].score + 0.5


def test_exchange_finds_alternating_classes():
    bigrams = np.zeros((9, 9))
    bigrams[1:5, 5:] = np.random.default_rng(2).integers(1, 40, (4, 4))
    bigrams[5:, 1:5] = np.random.default_rng(3).integers(1, 40, (4, 4))
    bigrams[0, 1] = bigrams[8, 0] = 1.0
    label = exchange(bigrams, 0, 3)
    assert label[0] == 0 and len(set(label[1:5])) == 1 and len(set(label[5:])) == 1 and label[1] != label[5]


def test_sharding(docs, empty):
    got = shard_documents(docs).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows_of(docs))
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.law for r in got} == {"bytes"} and {r.shard for r in got} <= set(range(16)) and shard_documents(empty).count() == 0


def test_shards_are_balanced(spark):
    rows = registry.QUERIES["op6_kd_sharding"](spark, "/root/testdata/sf0.01").collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert len(sizes) == 16 and max(sizes.values()) < 1.1 * min(sizes.values())
    # every node is cut along metadata, the same for all its rows, and different nodes along different dimensions
    ways = collections.defaultdict(set)
    for r in rows:
        for level, name in enumerate(r.cuts.split("/")):
            ways[r.shard >> (4 - level), level].add(name)
    assert len(ways) == 15 and all(len(names) == 1 for names in ways.values())
    assert set().union(*ways.values()) <= {"length", "script", "words", "marks"} and len(set().union(*ways.values())) >= 3


def test_widest_dimension_is_cut(spark):
    """Dimensions of different scales, one tied at its median: the tree follows relative widths, worked out by hand."""
    rng = np.random.default_rng(3)
    # a: even; b: even but of a far larger scale; c: nine tenths are zero
    rows = [(1, int(h), i, int(a), int(b), int(c)) for i, (h, a, b, c) in enumerate(zip(
        rng.integers(0, 2**62, 2000), rng.permutation(2000), rng.permutation(2000) * 1_000_000, np.where(rng.random(2000) < .9, 0, rng.integers(1, 9**9, 2000))))]
    given = spark.createDataFrame(rows, "size long, id_hash long, checksum long, a long, b long, c long")
    got = kd_shards(given, ["c", "a", "b"], leaves=4).collect()
    assert {r.cuts for r in got} == {"a/b"} and sorted(collections.Counter(r.shard for r in got).values()) == [500] * 4
    assert all((r.a >= 1000) == (r.shard >= 2) for r in got)
    same = kd_shards(given.withColumns({n: F.lit(5) for n in ("a", "b", "c", "checksum")}), ["a", "b"], leaves=2).collect()
    assert sorted(collections.Counter(r.shard for r in same).values()) == [1000, 1000]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    data = [(i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(400, 8)).astype(np.float32).astype(float))]
    data += [(400 + i, data[7][1], 1) for i in range(150)]
    data += [(700, None, 1), (800, [0.0] * 8, 1), (900, [1.0, None] + [0.0] * 6, 1), (1000, [float("nan")] * 8, 1), (1100, [1.0], 1),
             (1200, [float("inf")] * 8, 1), (None, data[0][1], 1), data[3]]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, list int")
    got = nearest_neighbours(table, F.col("vec_id") % 100 == 0).collect()
    ids = np.array([d[0] for d in data[:550]])
    x = np.array([d[1] for d in data[:550]])
    hits = total = 0
    for q in range(0, 550, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in own)
        d[q] = np.inf
        best = ids[np.lexsort((ids, d))][:10]
        hits, total = hits + len(set(best) & {r.vec_id for r in own}), total + 10
    assert hits >= 0.9 * total and {r.query_id for r in got} == set(range(0, 550, 100))
    few = spark.createDataFrame(data[:3], table.schema)
    assert [r.vec_id for r in nearest_neighbours(few, F.col("vec_id") == 0).orderBy("rank").collect()] != [] and nearest_neighbours(few, F.col("vec_id") == 0).count() == 2
    assert nearest_neighbours(spark.createDataFrame([], table.schema), F.col("vec_id") == 0).count() == 0


def test_recall_with_over_a_thousand_lists(spark, monkeypatch):
    monkeypatch.setattr(postings, "LIST_SIZE", 20)
    monkeypatch.setattr(postings, "TRIALS", 64)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(10, 64))[rng.integers(0, 10, 22_000)] * 0.35 + rng.normal(size=(22_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}))
    got = collections.defaultdict(set)
    for r in nearest_neighbours(table, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert len(got[q]) == 10
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(range(0, len(x), 100))


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet(f"{D}/embeddings.parquet").orderBy("vec_id").collect()
    x, got = np.array([r.embedding for r in rows], float), collections.defaultdict(set)
    for r in registry.QUERIES["op7_posting_lists"](spark, D).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & got[q])
    assert hits >= 9 * len(range(0, len(x), 100))


def test_toxicity(spark, docs, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = toxicity(given, labels).join(labels, "doc_id").filter("held_out").collect()
    clean, toxic = [r for r in found if not r.toxic], [r for r in found if r.toxic]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean) and sum(r.predicted for r in toxic) >= 0.5 * len(toxic)
    # clashing columns, nulls and repeats; labels of one class only, or none, teach nothing
    got = toxicity(docs, labels, training_docs=given).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.score for r in toxicity(docs, labels.filter("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in toxicity(docs, labels.filter("false")).collect()} == {0.0}
    assert reject_toxic(docs, labels.filter("false")).columns == docs.columns and toxicity(empty, labels).count() == 0


def brute_targets(sizes, weights):
    """Water level by bisection: shares are weight times one level, but at most three sizes."""
    total, low, high = sum(sizes.values()), 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * sizes[s], level * weights[s]) for s in sizes) < total else (low, level)
    return {s: min(3 * sizes[s], low * weights[s]) for s in sizes}


def test_targets():
    sizes, weights = {"a": 10, "b": 1000, "c": 5, None: 300}, {"a": 1.0, "b": 2.0, "c": 3.0, None: 1.0}
    assert targets(sizes, weights) == pytest.approx(brute_targets(sizes, weights))
    assert targets({}, {}) == {} and targets({"a": 0}, {"a": 1.0}) == {"a": 0.0}


def test_flow_moves_words_to_the_source_that_lacks_them():
    flow = min_cost_flow({("a",): 10.0, ("a", "b"): 10.0, ("b",): 2.0}, {"a": 12.0, "b": 10.0})
    assert sum(flow.values()) == pytest.approx(22.0) and max(flow[("a",)] - 10, flow[("a", "b")] - 10, flow[("b",)] - 2) < 1e-6
    assert min_cost_flow({("a",): 5.0}, {"a": 100.0}) == {("a",): pytest.approx(15.0)} and min_cost_flow({}, {}) == {}


def test_mixing(docs, empty):
    got = mix(docs).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    size = collections.Counter((r.doc_id, len(words_of(r.text))) for r in rows)
    assert collections.Counter((r.doc_id, r.size) for r in got) == size
    total = collections.Counter()
    for r in rows:
        total[r.source] += len(words_of(r.text))
    order = sorted(total, key=lambda s: (s is None, s or ""))
    goal = brute_targets(dict(total), {s: i % 3 + 1 for i, s in enumerate(order)})
    for s in order:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {total[s]} and own[0].target == pytest.approx(goal[s])
        assert abs(sum(r.taken for r in own) - goal[s]) <= 0.05 * goal[s] + 3
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.uses * r.size for r in got)
    again = mix(docs.repartition(5)).collect()
    assert collections.Counter((r.doc_id, r.taken) for r in again) == collections.Counter((r.doc_id, r.taken) for r in got)
    rows_out = mixed(docs)
    assert rows_out.columns == docs.columns and rows_out.count() == sum(r.uses for r in got)
    assert mix(empty).count() == 0


def test_mixing_of_overlapping_sources(docs):
    members = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    got = mix(docs, members=members, weights={"a": 1.0, "b": 1.0}).collect()
    assert sum(r.taken for r in got) == pytest.approx(sum(r.size for r in got), rel=0.05)
