"""Every operator against brute force, and its defined results for odd rows."""

import hashlib
import html
import itertools
import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stockweave.llm import decontaminate, htmltext, langid, minhash, packing, queries, secretscan, sharding, urlfilter, vectors, warc
from stockweave.llm.common import ship
from stockweave.llm.components import UnionFind, components
from stockweave.llm.shingles import mix, shingle_set

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def odd_rows():
    long = " ".join(f"word{i % 977} and." for i in range(30_000))
    plain = "one two three four five six seven eight nine ten"
    rows = [(1, plain, "en"), (2, plain, "en"), (3, plain.upper(), None), (4, None, "en"), (5, "", None), (6, "  \n\t ", "en"),
            (7, "tiny text", "en"), (8, "TINY  text", "en"), (None, plain, "en"), (None, None, None), (9, long, "en"), (9, long, "en"),
            (10, long + " tail", "en"), (11, "12345 -- 678", "en"), (12, "ßäö é 漢字 \U0001f600 <|endoftext|> x  y", "de")]
    return [(i, t, lang, None, len(t) if t else None) for i, t, lang in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).withColumns({c: F.lit("clash") for c in (
        "words", "kept", "spans", "score", "lang_pred", "slot", "part", "ids", "start", "shard", "component_id", "text_hash", "bands")})


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k=5):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


# --- 1: packing ------------------------------------------------------------------------------------------


def check_packing(rows, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for k, t in texts.items()}
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for seq in sequences.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) // 4 > 0
            at += r.length
        assert at <= 1024
    for doc, own in pieces.items():
        if doc in want:
            ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(own, key=lambda r: r.start)]).tolist()
            assert ids == want[doc] and all(r.doc_tokens == len(ids) for r in own)
    return [sum(r.length for r in s) for s in sequences.values()]


def test_packing_holds_every_id_once(docs, texts):
    lengths = check_packing(packing.pack(docs.coalesce(1)).collect(), texts)
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in lengths)
    assert padding < 0.02 * sum(lengths)


def test_packing_of_odd_rows(odd, spark):
    rows = packing.pack(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1)).collect()
    check_packing(rows, {i: t for i, t, *_ in odd_rows() if i is not None})
    assert sum(r.doc_tokens == 1 for r in packing.pack(odd).collect()) == 3  # two nulls and an empty text
    assert packing.pack(odd.limit(0)).count() == 0


def test_cut_points_are_the_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(40):
        points = np.concatenate(([0], np.cumsum(rng.integers(1, 9, 12))))
        prices = np.concatenate(([0.0], rng.integers(0, 3, 12).astype(float)))

        def cost(ends):
            total, low = 0.0, 0
            for e in ends:
                assert 0 < e - low <= 10
                at = np.flatnonzero(points == e)
                total += 10 - (e - low) + (prices[at[0]] if len(at) else 2.0)
                low = e
            return total

        best = [0.0] + [np.inf] * int(points[-1])
        full = {(a + 10 * k) for a in points.tolist() for k in range(1, 4)}
        for e in range(1, len(best)):  # states: points, and ends of runs of full sequences that began at a point
            if e in set(points.tolist()):
                j = points.tolist().index(e)
                for i in range(j):
                    m = (e - points[i] - 1) // 10
                    if m <= 3:
                        best[e] = min(best[e], best[points[i]] + m * 2.0 + (m + 1) * 10 - (e - points[i]) + prices[j])
        got = packing.cut_points(points, prices, 10, 2.0, 3)
        assert got[-1] == points[-1] and cost(got) == pytest.approx(best[-1]) and full is not None


def test_any_number_of_full_sequences_in_a_row():
    assert packing.cut_points(np.array([0, 81]), np.zeros(2), 10, 0.05) == [*range(10, 81, 10), 81]
    points = np.append(np.arange(0, 72, 9), 80)  # sequences of 9 leave a place empty each, eight full ones none
    assert packing.cut_points(points, np.zeros(len(points)), 10, 0.05) == list(range(10, 81, 10))


def test_every_sentence_end_is_a_cut_point():
    rng = np.random.default_rng(8)
    enc = SimpleNamespace(ends_sentence=np.array([True, False, True]), starts_gap=np.ones(3, bool))
    for _ in range(5):
        docs = [np.append(rng.choice([1, 2], n, p=[0.9, 0.1]), 0) for n in (3, 400, 0, 150, 700, 20)]
        stream = packing._Stream(50, 1.0, 6.0)
        for k, ids in enumerate(docs):
            stream.add(k, ids)
        lengths = [sum(len(p[2]) for p in pieces) for pieces in stream.take(enc, True)]
        ids, ends = np.concatenate(docs), set(np.cumsum([len(d) for d in docs]).tolist())
        price = [0.0 if i in ends else 1.0 if ids[i - 1] == 2 else 6.0 for i in range(len(ids) + 1)]
        best = [0.0]
        for e in range(1, len(ids) + 1):  # a cut may fall anywhere
            best.append(price[e] + min(best[b] + 50 - (e - b) for b in range(max(0, e - 50), e)))
        cuts = np.cumsum(lengths)
        assert cuts[-1] == len(ids) and max(lengths) <= 50
        assert sum(50 - n for n in lengths) + sum(price[c] for c in cuts.tolist()) == pytest.approx(best[-1])


# --- 2: decontamination ------------------------------------------------------------------------------------


def brute_matches(docs, items, threshold=0.8):
    split = lambda t: (t or "").lower().strip(" \t\n\x0b\f\r").split()
    bag = lambda w, k: Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    item_bags = {}
    for i, t in items:
        w = split(t)
        if w:
            item_bags[i] = (min(5, len(w)), len(w), bag(w, min(5, len(w))))
    seen = Counter((k, h) for k, _, b in item_bags.values() for h in b)
    weight = lambda k, h: int(16 * np.log2(1 + len(item_bags) / max(1, seen[k, h])) + 0.5)
    out = {}
    for d, t in docs:
        w = split(t)
        for i, (k, n, b) in item_bags.items():
            if not any(tuple(w[p:p + k]) in b for p in range(len(w) - k + 1)):
                continue
            total = sum(c * weight(k, h) for h, c in b.items())
            for s in range(-(n - k), len(w) - k + 1):
                own = bag(w[max(0, s):max(0, s + n)], k)
                both = sum(min(c, b[h]) * weight(k, h) for h, c in own.items() if h in b)
                union = sum(c * weight(k, h) for h, c in own.items()) + total - both
                if both and both >= threshold * union:
                    out[d, i] = max(out.get((d, i), 0), both / union)
    return out


def test_decontamination_equals_brute_force(spark, docs, texts):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(docs, items).collect()}
    want = brute_matches(texts.items(), [(r.item_id, r.text) for r in items.collect()])
    assert got.keys() == want.keys() and got and all(got[k] == pytest.approx(want[k]) for k in got)


def test_decontamination_of_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "seven eight nine"), (2, None), (3, ""), (4, "three four five six seven eight"), (None, "tiny text"), (4, "three four five six seven eight")],
                                  "item_id long, text string").withColumn("size", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(odd, items).collect()}
    assert got == {(i, j) for i in (1, 2, 3, None) for j in (1, 4)} | {(7, None), (8, None)}
    kept = decontaminate.decontaminate(odd, items)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [4, 5, 6, 9, 9, 10, 11, 12]
    assert decontaminate.matches(odd.limit(0), items).count() == 0
    assert decontaminate.matches(odd, items.limit(0)).count() == 0


# --- 3: main text ------------------------------------------------------------------------------------------


def test_main_text_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html or "", re.S)
        blocks = [html.unescape(re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner[1])] if inner else []
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_main_text_leaves_the_rest_out():
    page = """<body><header><p>Site, with a slogan, long enough to look like text.</p></header><nav><ul><li>Menu</ul></nav><main><article><h1>Title &amp; more</h1>
      <p>First paragraph, which is long enough, as articles go.<p>Second  <b>bold</b><br>one, also long; really &lt;b&gt;.</article>
      <section class="comments"><p>A reader thinks that, on the whole, this is a very good text, thanks.</p></section></main>
      <aside><p>Read also this, and that, and many more things, every day.</p></aside><form><p>Your mail, please, for more of this.</p></form>
      <div class="cookie-notice">We use cookies, as everybody does, all the time.</div><script>var x = "<p>no</p>";</script><footer>End.</footer></body>"""
    assert htmltext.main_text(page) == "Title & more\n\nFirst paragraph, which is long enough, as articles go.\n\nSecond bold one, also long; really <b>."


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("<p>", ""), ("plain", "plain"), ("<p>a<p>a", "a\n\na"), ("<script>x", ""), ("a < b & c", "a < b & c")])
def test_main_text_of_odd_pages(page, text):
    assert htmltext.main_text(page) == text


LEAD, BODY, END = "A lead of one long sentence, by our own reporter, who was there when it all began and saw it to its end.", "A long sentence of the body, with commas, words and more of it, as articles have. " * 4, "The last section ends here, with few words, none of which can be left out without loss of some meaning."


@pytest.mark.parametrize("page, text", [
    # lead and body are siblings, no article around them; the menu of links goes
    (f"<body><div><div><a href=x>Home</a> <a href=y>About us</a></div><div><p>{LEAD}</p></div><div>{f'<p>{BODY}</p>' * 12}</div></div></body>", [LEAD, *[BODY] * 12]),
    (f"<body><div><div class=top>{LEAD}</div><div>{f'<p>{BODY}</p>' * 12}</div><section><h2>End</h2><p>{END}</p></section></div><div>Imprint</div></body>",
     [LEAD, *[BODY] * 12, "End", END]),
    # a second, shorter article beside the first
    (f"<body><ul><li><a href=x>Home</a></ul><article>{f'<p>{BODY}</p>' * 12}</article><article><h2>End</h2><p>{END}</p></article></body>", [*[BODY] * 12, "End", END]),
    # paths choose: what is short, without marks and outside the text is left out though the region holds it
    (f"<body><div><div>Home About</div><div><h1>Title</h1></div><div><p>{BODY}</p></div><div>Figure</div><div><p>{BODY}</p></div><div>To the top</div></div></body>",
     ["Title", BODY, "Figure", BODY])])
def test_main_text_holds_all_content(page, text):
    assert htmltext.main_text(page) == "\n\n".join(t.strip() for t in text)


@pytest.mark.parametrize("name", ["class='layout has-sidebar'", "class=no-sidebar", "class='content-with-comments'", "class=post-share", "class='no-ads'",
                                  "class='header-large'", "id=page-banner", "class=sidebar"])
def test_names_do_not_empty_a_page(name):
    other = "<div class='sidebar-left'><p>Read also this, and that, and many more things, every day.</p></div>"
    page = f"<body><div {name}><h1>Title</h1><p>{BODY}</p><p>{BODY}</p></div>{other}</body>"
    assert htmltext.main_text(page) == "\n\n".join(["Title", BODY.strip(), BODY.strip()])
    parts = "".join(f"<div class=social><p>{BODY}</p></div>" for _ in range(3))
    assert htmltext.main_text(f"<body>{parts}</body>") == "\n\n".join([BODY.strip()] * 3)  # the list would leave nothing


def test_extract_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, None, None, "clash"), (None, "u", "<p>x</p>" * 20_000, "clash")], "page_id long, url string, html string, text string")
    got = htmltext.extract(pages)
    assert got.columns == ["page_id", "url", "text"] and sorted(len(r.text) for r in got.collect()) == [0, 3 * 20_000 - 2]
    assert htmltext.extract(pages.limit(0)).count() == 0


# --- 4: sharding -------------------------------------------------------------------------------------------


def test_shards_are_even_and_gapless(docs, texts):
    placed, shard_map = sharding.shard(docs, 8)
    rows = placed.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_shard = {k: sorted(r.position for r in rows if r.shard == k) for k in range(8)}
    assert all(v == list(range(len(v))) for v in by_shard.values())
    for r in rows:
        data = texts[r.doc_id].encode()
        assert r["size"] == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
    sums = [sum(r["size"] for r in rows if r.shard == k) for k in range(8)]
    assert max(sums) - min(sums) < 0.02 * sum(sums)
    assert shard_map.count() == sharding.SLOTS


def test_growing_moves_only_into_the_new_shard(spark, docs, tmp_path):
    placed, first = sharding.shard(docs, 4)
    used = sharding.slot_bytes(placed.select("slot", "size"))
    grown = sharding.edit_map(used, 5, first, only_new=True)
    was, now = ({r.slot: r.shard for r in m.collect()} for m in (first, grown))
    assert {now[s] for s in now if now[s] != was[s]} == {4}
    loads = Counter()
    for r in grown.collect():
        loads[r.shard] += r["bytes"]
    assert max(loads.values()) - min(loads.values()) < 0.05 * sum(loads.values())
    same = {r.slot: r.shard for r in sharding.edit_map(used, 4, first).collect()}
    assert sum(same[s] != was[s] for s in same) < 20  # an even map is hardly edited
    for m in (first, grown):
        sharding.store_map(m, f"{tmp_path}/map")
    assert {r.slot: r.shard for r in sharding.load_map(spark, f"{tmp_path}/map").collect()} == now
    assert {r.slot: r.shard for r in sharding.load_map(spark, f"{tmp_path}/map", 1).collect()} == was


def test_sharding_of_odd_rows(odd):
    rows = sharding.shard(odd, 3)[0].collect()
    assert len(rows) == len(odd_rows()) and sum(r["size"] == 1 for r in rows) == 3
    assert sharding.shard(odd.limit(0), 3)[0].count() == 0


# --- 5: URL filter ---------------------------------------------------------------------------------------


def test_url_rules_and_parts(spark):
    urls = ["http://A.Example.ORG/es/1?x#y", "https://example.org/en/1", "https://example.org/en/2", "ftp://x.com/fr/", "x.com/fr/", None, "", "http://com/de/",
            "http://notexample.org", "https://example.org", "http://x.com?/fr/", "a://b.org/#", "http://ÄB.com/fr/"]
    got = [tuple(r) for r in urlfilter.with_rules(spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string"),
                                                   queries.RULES).orderBy("page_id").select("host", "path", "rule", "rule_verdict").collect()]
    assert got == [("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/1", "example.org/en/1", "block"),
                   ("example.org", "/en/2", "org/", "allow"), ("x.com", "/fr/", "com/fr/", "allow"), ("", "", None, None), ("", "", None, None),
                   ("", "", None, None), ("com", "/de/", "com/de/", "block"), ("notexample.org", "", None, None), ("example.org", "", None, None),
                   ("x.com", "", None, None), ("b.org", "/", "org/", "allow"), ("Äb.com", "/fr/", "com/fr/", "allow")]


def test_url_models_learn_from_rules(spark):
    good, bad = ("river lake garden flower meadow".split(), "casino poker pills jackpot bonus".split())
    pairs = [(w, v) for v, words_ in (("allow", good), ("block", bad)) for w in words_]
    rows = [(i, f"http://{w}{i}.example.{'org' if v == 'allow' else 'biz'}/{w}/{i}") for i, (w, v) in enumerate(pairs * 40)]
    rows += [(1000 + i, f"http://{w}.example.info/{w}") for i, (w, _) in enumerate(pairs)]
    rules = [urlfilter.Rule("allow", "org/"), urlfilter.Rule("block", "biz/")]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert [got[1000 + i] for i in range(len(pairs))] == [v for _, v in pairs]
    alone = urlfilter.judge(spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id long, url string"), rules)
    assert [r.verdict for r in alone.collect()] == ["allow", "allow"]
    assert urlfilter.judge(alone.select("page_id", F.lit("u").alias("url")).limit(0), rules).count() == 0


def test_markov_chances_add_up():
    model = urlfilter.Markov(2)
    for text in ("abab", "abc"):
        grams = urlfilter._grams(text, 2)
        for k in range(3):
            c, g = urlfilter._slots(grams[2 * k]), urlfilter._slots(grams[2 * k + 1])
            np.add.at(model.contexts, c, 1)
            model.followers[c[model.grams[g] == 0]] += 1
            np.add.at(model.grams, g, 1)
    assert model.log_likelihood(urlfilter._grams("abab", 2)) > model.log_likelihood(urlfilter._grams("bzzb", 2))


class ExactMarkov:
    """Witten-Bell chances from dictionaries of strings."""

    def __init__(self, texts, order=urlfilter.ORDER):
        self.order, self.grams, self.followers = order, Counter(), Counter()
        for text in texts:
            self.grams.update(g for gs in self.of(text) for g in gs)
        self.contexts = Counter()
        for g, n in self.grams.items():
            self.contexts[g[:-1]] += n
            self.followers[g[:-1]] += 1

    def of(self, text):
        padded = chr(2) * self.order + text + chr(3)
        return [[padded[i - k: i + 1] for k in range(self.order + 1)] for i in range(self.order, len(padded))]

    def log_likelihood(self, text):
        out = 0.0
        for gs in self.of(text):
            p = 1 / 256
            for g in gs:
                seen, kinds = self.contexts[g[:-1]], self.followers[g[:-1]]
                p = (self.grams[g] + kinds * p) / (seen + kinds) if seen else p
            out += np.log(p)
        return out


def test_url_scores_are_exact_beyond_any_number_of_ngrams(spark):
    draw = np.random.default_rng(5)
    hosts = ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 45)) for _ in range(3000)]
    rows = [(i, f"http://{h}.{('org', 'biz', 'info')[i % 3]}/{h[:7]}\U0001f600{h[:3]}") for i, h in enumerate(hosts)] + [(9000, "http://twice.org/"), (9001, "http://twice.org/?a")]
    rules = [urlfilter.Rule("allow", "org/"), urlfilter.Rule("block", "biz/")]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert len(got) == len(rows)
    allow, block = (ExactMarkov([r.host + r.path for r in got if r.rule == rule]) for rule in ("org/", "biz/"))
    assert len(allow.grams) + len(block.grams) > 1 << urlfilter.SLOT_BITS
    for r in got:
        if r.rule is None:
            text = r.host + r.path
            assert r.score == pytest.approx((allow.log_likelihood(text) - block.log_likelihood(text)) / (len(text) + 1), abs=1e-8)


# --- 6: near-duplicates ------------------------------------------------------------------------------------


def brute_groups(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    joined = UnionFind()
    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[1]], 2):
        if a != b and 100 * len(x & y) >= percent * len(x | y):
            joined.union(a, b)
    return {i: (len(s), joined.find(i)) for i, s in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(docs, texts, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, percent / 100).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute_groups(texts.items(), percent).items()}


def test_near_duplicates_of_odd_rows(odd):
    rows = minhash.near_duplicates(odd, 0.85).collect()
    assert len(rows) == len(odd_rows())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert got == brute_groups([(i, t) for i, t, *_ in odd_rows() if i is not None], 85)
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    kept = minhash.keep_one(odd, 0.85)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 6, 7, 9, 11, 12]
    assert kept.filter("doc_id is null").count() == 2
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_a_large_group_is_found_in_blocks(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        own = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            own[at] = f"x{i}_{at}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.85, block_rows=64).collect()}
    assert got == {i: c for i, (_, c) in brute_groups(rows, 85).items()}


def test_signatures_estimate_similarity():
    a, b = mix(np.arange(900, dtype=np.uint64)), mix(np.arange(100, 1000, dtype=np.uint64))
    hits = [np.mean(minhash.signature(mix(a + np.uint64(k)), 144) == minhash.signature(mix(b + np.uint64(k)), 144)) for k in range(60)]
    assert abs(np.mean(hits) - 0.8) < 0.02 and np.std(hits) < 0.045
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("\xa0a\x1cb c")) == 1


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + i) for i in range(1, 100)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (None, 3), (7, 6)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 100)}
    assert components(edges.limit(0), "a", "b").count() == 0


# --- 7: vectors ----------------------------------------------------------------------------------------------


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((12, 24))
    rows = [(i, (base[i % 12] + rng.standard_normal(24) * rng.choice([0.02, 0.12, 0.2])).tolist(), int(i % 12 % 5)) for i in range(300)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(20)] + [(400, (np.array(rows[0][1]) * 3).tolist(), rows[0][2])]
    odd = [(500, None, 1), (501, [], 1), (502, [0.0] * 24, 1), (503, [None] + [1.0] * 23, 1), (504, [float("nan")] * 24, 1),
           (505, rows[0][1], None), (None, rows[0][1], 9), (506, [float("inf")] * 24, 1), (507, [1.0, 2.0], 1), (508, [2.0, 4.0], 1)]
    frame = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("clash"))
    got = {r.vec_id: r for r in vectors.near_duplicates(frame, block_rows=16).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    close = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(close, False)
    joined = UnionFind()
    for i, j in zip(*np.nonzero(close)):
        joined.union(rows[i][0], rows[j][0])
    assert close.sum() > 500
    for r, n in zip(rows, close.sum(1)):
        own = got[r[0]]
        assert (own.n_links, own.component_id, own.kept) == (n, joined.find(r[0]), joined.find(r[0]) == r[0])
    for r in odd:
        assert (got[r[0]].n_links, got[r[0]].component_id) == ((1, 507) if r[0] in (507, 508) else (0, r[0]))
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_tables_follow_the_bits():
    for bits in (1, 8, 14, 24, 40):
        n = vectors.table_count(bits, 0.98, vectors.MISS)
        met = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - met) ** n <= vectors.MISS < (1 - met) ** (n - 1 if n > 1 else 0)
    assert vectors.table_count(20, 1.0, vectors.MISS) == 1
    assert vectors.table_count(24, 0.98, vectors.MISS) < 5 * vectors.table_count(8, 0.98, vectors.MISS)


def test_buckets_hold_few_strangers_at_any_size():
    rng = np.random.default_rng(4)
    for n in (500, 4000):
        bits = int(np.ceil(np.log2(n))) + vectors.SPARE_BITS
        got = vectors.codes(rng.standard_normal((n, 32)), 4, bits)
        pairs = [sum(c * (c - 1) / 2 for c in Counter(column.tolist()).values()) for column in got.T]
        assert max(pairs) < n / 2  # of n * (n - 1) / 2


# --- 8: language -----------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = langid.with_language(docs.withColumns({"score": F.lit("clash"), "_judged": F.lit(1)}))
    rows = judged.filter(langid.held_out()).filter("lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_sample_is_drawn_among_different_texts(spark):
    rows = [("de", "gleich")] * 20_000 + [("de", f"Text {i}") for i in range(300)] + [("en", f"text {i}") for i in range(5000)]
    got = Counter(r.lang for r in langid._sampled(spark.createDataFrame(rows, "lang string, text string"), 400).collect())
    assert got["de"] == 301 and 300 < got["en"] <= 600
    few = Counter(r.lang for r in langid._sampled(spark.createDataFrame(rows, "lang string, text string"), 1).collect())
    assert all(n <= 1 for n in few.values())  # 1.5 times 1, in whole texts


def test_language_of_odd_rows(odd):
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.with_language(odd).collect()]
    assert {i for i, lang, s in got if lang == "und" and s == 0} == {4, 5, 6, 11, None} and len(got) == len(odd_rows())
    assert {lang for _, lang, _ in got} <= {"en", "de", "und"}
    nothing = langid.with_language(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert langid.with_language(odd.limit(0)).count() == 0


# --- 9: secrets ------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secretscan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_equal_regular_expressions(spark, texts):
    made = {-1: "token=secret: abcdefghij", -2: "é\U0001f600 API_KEY='AKIA" + "A1" * 8 + "' " + "ab" * 20, -3: "password = short, secret:longenough=" * 3,
            -4: "XAKIAAKIA" + "B2" * 7, -5: "apikey:" + "0f" * 16, -6: "", -7: "tokentoken=12345678 passwd:\t12345678"}
    every = texts | made
    frame = spark.createDataFrame([*every.items(), (-8, None)], "doc_id long, text string")
    for r in secretscan.scan(frame).collect():
        text = every.get(r.doc_id) or ""
        spans = [(s.kind, s.start, s.end) for s in r.spans]
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k != "random") == base_spans(text)
        assert all(0 <= a < b <= len(text) for _, a, b in spans)


def test_battery_tells_random_runs_from_written_ones(spark):
    rng = np.random.default_rng(2)
    letters = np.array(list(secretscan.ALPHABETS["base62"]))
    rows = [(i, "key " + "".join(rng.choice(letters, 40)) + " end") for i in range(200)]
    written = ["HelloWorld2HelloWorld2HelloWorld2", "aaaaBBBB1111aaaaBBBB1111aaaaBBBB1111", "path/To/Some/Index/File1/path/To/Some/Index/File1"]
    rows += [(1000 + i, w) for i, w in enumerate(written)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secretscan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == ["random"] for i in range(200)) > 185
    assert all(got[1000 + i] == [] for i in range(len(written)))


def brute_p(run, alphabet):
    """The battery written with numpy."""
    x, k, n = np.array([alphabet.index(c) for c in run], float), len(alphabet), len(run)
    tail = lambda z: 1 / (1 + math.exp(1.5976 * (z := min(max(z, -8), 8)) + 0.07056 * z**3))
    chi, shape = sum(c * c for c in Counter(run).values()) * k / n - n, (k - 1) * n / (2 * (n - 1))
    uniform = tail(((chi / (k - 1)) ** (1 / 3) - 1 + 1 / (9 * shape)) * 3 * shape**0.5)
    high = x >= k / 2
    mean = 2 * high.sum() * (n - high.sum()) / n + 1
    runs = 1 + (high[1:] != high[:-1]).sum()
    ordered = 1e-9 if mean <= 1 else 2 * tail(abs(runs - mean) / max((mean - 1) * (mean - 2) / (n - 1), 1e-9) ** 0.5)
    d = x - x.mean()
    serial = 1e-9 if not d.any() else 2 * tail(abs((d[1:] * d[:-1]).sum() / (d * d).sum() + 1 / n) * n**0.5)
    h = -sum(math.log(min(max(p, 1e-12), 1)) for p in (uniform, ordered, serial))
    return math.exp(-h) * (1 + h + h * h / 2)


def drawn(rng, name, size):
    if name == "hex22":
        return "".join(c.upper() if rng.random() < 0.5 else c for c in rng.choice(list(secretscan.ALPHABETS["hex"]), size))
    return "".join(rng.choice(list(secretscan.ALPHABETS[name]), size))


def test_battery_by_alphabet_and_length(spark):
    rng = np.random.default_rng(6)
    made = [(name, size, drawn(rng, name, size)) for name in secretscan.ALPHABETS for size in (20, 24, 32, 64) for _ in range(100)]
    frame = spark.createDataFrame(made, "name string, size int, run string")
    got = frame.select("*", secretscan.encoding(F.col("run")).alias("kind"), secretscan.battery(F.col("run")).alias("p")).collect()
    for r in got:
        if r.kind:
            plain = r.run.translate(str.maketrans("-_", "+/"))
            readings = [(r.run.lower(), "hex"), (r.run, "hex22")] if r.kind == "hex22" else [(plain.lower() if r.kind in ("hex", "base36") else plain, r.kind)]
            assert r.p == pytest.approx(max(brute_p(t, secretscan.ALPHABETS[k]) for t, k in readings), rel=1e-9)
    for name, size in itertools.product(secretscan.ALPHABETS, (20, 24, 32, 64)):
        own = [r for r in got if (r.name, r.size) == (name, size)]
        assert sum(r.kind is not None for r in own) >= 88  # short ones may lack a digit or a case
        assert sum(r.kind is not None and r.p < 0.05 for r in own) <= 15


def test_random_runs_of_every_alphabet_are_found(spark):
    rng = np.random.default_rng(8)
    made = [(name, size, drawn(rng, name, size)) for name in secretscan.ALPHABETS for size in (20, 24, 32, 48) for _ in range(40)]
    around = ["see https://host.example/some/path/{}?x", "id-of_{}, then", "{}"]
    rows = [(i, around[i % 3].format(run)) for i, (_, _, run) in enumerate(made)]
    texts = {i: t for i, t in rows}
    found = secretscan.scan(spark.createDataFrame([*rows, (-1, "a/b " * 50_000 + made[-1][2])], "doc_id long, text string"))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found.collect()}
    for name, size in itertools.product(secretscan.ALPHABETS, (20, 24, 32, 48)):
        at = [i for i, m in enumerate(made) if m[:2] == (name, size)]
        hit = 0
        for i in at:
            a = texts[i].index(made[i][2])
            hit += any(s <= a and a + size <= e for _, s, e in got[i])
        assert hit >= 0.8 * len(at), (name, size, hit)
    assert got[-1] and got[-1][0][1] >= 200_000


def test_redacting(spark, odd):
    frame = spark.createDataFrame([(1, 'ä token = "' + "0a" * 20 + '" é', 1), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in secretscan.redact(frame).collect()}
    assert got == {1: ('ä [SECRET]" é', 13), 2: ("clean", 5), 3: (None, None)}
    assert secretscan.redact(odd).columns == odd.columns and secretscan.scan(odd.limit(0)).count() == 0
    assert secretscan.scan(odd).filter("size(spans) > 0").count() == 0


# --- 10: WARC ----------------------------------------------------------------------------------------------------


def test_derived_records_are_linked(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r for r in warc.responses_of(pages).collect()}
    rows = warc.derive(warc.responses_of(pages), key="page_id").withColumn("raw", warc.serialised()).collect()
    assert len(rows) == 2 * len(source)
    for r in rows:
        (fields, block), = warc.parse(bytes(r.raw))
        head = dict(fields)
        assert block == bytes(r.block) and head["WARC-Refers-To"] == source[r.page_id].record_id == r.refers_to
        assert head["WARC-Block-Digest"] == warc.digest(block) and head["WARC-Type"] == r.warc_type and int(head["Content-Length"]) == len(block)
        if r.warc_type == "metadata":
            assert f"source-block-digest: {warc.digest(bytes(source[r.page_id].block))}".encode() in block
            assert b"http-header-Content-Type: text/html; charset=utf-8" in block


def test_warc_of_odd_responses(spark, tmp_path):
    packed = zlib.compressobj(wbits=31)
    body = packed.compress(b"<p>caf\xe9</p><script>x</script>") + packed.flush()
    chunked = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + b"%x\r\n" % len(body) + body + b"\r\n0\r\n\r\n"
    rows = [("<a>", "u", "d", bytearray(chunked), "response"), ("<b>", None, None, None, "response"), (None, "u", "d", bytearray(b"no head <b>here</b>"), "response"),
            ("<c>", "u", "d", bytearray(b"HTTP/1.0 200\nContent-Type: image/png\n\n\x89PNG"), "response"), ("<d>", "u", "d", bytearray(b"x"), "request")]
    frame = spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, block binary, warc_type string").withColumn("headers", F.lit(1))
    got = {(r.refers_to, r.warc_type): bytes(r.block) for r in warc.derive(frame).collect()}
    assert got.keys() == {("<a>", "metadata"), ("<a>", "conversion"), ("<b>", "metadata"), ("<b>", "conversion"), (None, "metadata"), (None, "conversion"), ("<c>", "metadata")}
    assert got["<a>", "conversion"] == "café".encode() and got["<b>", "conversion"] == b"" and got[None, "conversion"] == b"no head here"
    assert warc.derive(frame.limit(0)).count() == 0
    data = b"".join(warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>"), ("Content-Length", str(len(b)))], b) for i, b in enumerate((b"x", b"", chunked)))
    (tmp_path / "a.warc").write_bytes(data)
    assert sorted(bytes(r.block) for r in warc.read_warc(spark, f"{tmp_path}/a.warc").collect()) == sorted((b"x", b"", chunked))


# --- queries and pipeline ------------------------------------------------------------------------------------


def test_query_columns(spark):
    made = {name: q(spark, SF) for name, q in queries.QUERIES.items() if name.startswith(("op1_", "op3_", "op4_", "op5_"))}
    assert [n.split("_")[0] for n in queries.QUERIES] and {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    for name, df in made.items():
        assert df.count() > 0, name


def test_pipeline_stages(spark, docs, texts, odd):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "secret_scan", "packing"]
    rows = corpus_pipeline.run(spark, SF).collect()
    groups = brute_groups(texts.items(), 80)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    spelled = {i for i, t in texts.items() if re.search(r"[^\W\d_]", t)}
    kept = {i for i in spelled if groups[i][1] == i}
    kept -= {d for d, _ in brute_matches([(i, texts[i]) for i in kept], items)}
    assert {r.doc_id for r in rows} == kept
    frame = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == odd.columns
    assert frame.count() > 0 and corpus_pipeline.pack(spark, frame, SF).count() > 0
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert hashlib.sha256(b"").hexdigest() == queries.QUERIES["op9_randomness_battery"](spark, SF).filter("spans = ''").first().base_sha256
