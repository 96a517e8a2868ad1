"""Operators 11 to 13 against brute force, and their defined results for odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stockweave.llm import alignment, blocks, nra, ppm, queries, warc
from stockweave.llm.common import ship

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


ODD = [None, "", " ", "  ", "a", "▁ x", " lead", "trail ", "a  b", "a\nb c\n\nd", "a \n b", "<|endoftext|> x</s> <0x0A>", "x y z", "漢字 かな",
       "é" * 50, "é z", "a\x1c b \x85 c", "tab\t tab", "x" * 5000, "I'm we'll 123 4567 ...!!", "ﬁ Å ﻿ q", "\x00 a \x00", "TWO words", "two WORDS"]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 977} and." for i in range(60_000))
    rows = [(i, t, "en", None, None) for i, t in enumerate(ODD)] + [(500, long, None, "s", 1), (501, long, None, "s", 1), (501, long, None, "s", 1), (None, "no key", None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in (
        "key", "block", "held", "texts", "keys", "gram", "place", "score", "rank", "pairs", "n", "terms", "item", "counts", "kind")})


class Matching:
    """The model by its definition, one byte at a time."""

    def __init__(self, texts, order):
        self.order, self.after = order, [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            b = b"\xff" * order + t + b"\xff"
            for p in range(order, len(b)):
                for j in range(order + 1):
                    self.after[j][b[p - j : p]][b[p]] += 1

    def p(self, context, byte):
        out, p = set(), 1.0
        for j in range(self.order, -1, -1):
            seen = {s: c for s, c in self.after[j].get(context[self.order - j :], {}).items() if s not in out}
            n = sum(seen.values())
            if byte in seen:
                return p * (2 * seen[byte] - 1) / (2 * n)
            if n:
                p *= len(seen) / (2 * n)
                out |= set(seen)
        return p / (256 - len(out))

    def log10(self, text):
        b = b"\xff" * self.order + text + b"\xff"
        return sum(math.log10(self.p(b[p - self.order : p], b[p])) for p in range(self.order, len(b)))


def scored_by_hand(rows, order):
    """rows: (key, text) in any order."""
    held = [k is not None and zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows]
    low = [(t or "").encode().lower() for _, t in rows]
    counts = Counter(w for t, h in zip(low, held) if not h for w in WORD.findall(t))
    ends = held.count(False)
    total, different = sum(counts.values()) + ends, len(counts) + (ends > 0)
    model = Matching([t for t, h in zip(low, held) if not h], order)
    known = {}
    out = []
    for (k, _), t, h in zip(rows, low, held):
        words = [*WORD.findall(t), None]
        c = [ends if w is None else counts[w] for w in words]
        base = sum(math.log10((x + 0.1) / (total + 0.1 * (different + 1))) for x in c)
        if t not in known:
            known[t] = model.log10(t)
        out.append((k, h, len(words), sum(x > 0 for x in c), total, base, known[t]))
    return out


def same_scores(got, want):
    key = lambda r: (r[0] is None, r[0] or 0)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:7] for r in got], [r[5:] for r in want], rtol=1e-7, atol=1e-7)


def test_partial_matching_equals_definition(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(60).collect()]
    part = docs.filter(F.col("doc_id").isin([k for k, _ in rows]))
    for order in (2, 5):
        same_scores(ppm.score(part, order=order).collect(), scored_by_hand(rows, order))


def test_partial_matching_odd_rows(odd):
    short = odd.filter("coalesce(doc_id, 0) < 500")
    rows = [(r.doc_id, r.text) for r in short.select("doc_id", "text").collect()]
    got = ppm.score(short).collect()
    same_scores(got, scored_by_hand(rows, ppm.ORDER))
    whole = ppm.score(odd).collect()
    assert len(whole) == odd.count() and all(math.isfinite(r.score) and r.score < 0 for r in whole)
    assert sorted(map(str, whole)) == sorted(map(str, ppm.score(odd).collect()))


def test_partial_matching_without_training(odd):
    one = ppm.score(odd.filter("doc_id = 4"), held=F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in one] == [(2, 0, 0, 0.0)]
    assert one[0].score == pytest.approx(2 * math.log10(1 / 256), rel=1e-6)
    assert ppm.score(odd.limit(0)).collect() == []


def test_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(5)
    grams = {int(a) << 16 | int(b) << 8 | int(c): int(n) for a, b, c, n in rng.integers(0, 6, (60, 4))}
    asked = [a << 16 | b << 8 | c for a, b in {(g >> 16, g >> 8 & 255) for g in grams} | {(9, 0), (9, 9)} for c in range(256)]
    rows = spark.createDataFrame([(g, grams.get(g, 0)) for g in asked], "gram long, c long")
    sums = ppm.probabilities(rows, 2).groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum(F.pow(F.lit(10.0), "log10_p")).alias("p")).collect()
    assert len(sums) > 10 and all(r.p == pytest.approx(1, abs=1e-9) for r in sums)


def test_lookup_and_steps():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        keys = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        assert (blocks.unstepped(blocks.steps(keys)) == keys).all() if n else blocks.steps(keys) == b""
        if n:
            asked = rng.choice(keys, 1000)
            assert (blocks.Lookup(keys, keys * np.uint64(3))(asked) == asked * np.uint64(3)).all()
    sums = blocks.Sums(at_most=10)
    for _ in range(9):
        sums.add(np.array([1, 2, 3], np.uint64), np.array([1, 2, 3]))
    keys, counts = sums.take()
    assert keys.tolist() == [1, 2, 3] and counts.tolist() == [9, 18, 27]


A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def _alphabet():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


ALPHABET = _alphabet()


def spelt(text):
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    bytes_a = [bytes(ALPHABET[c] for c in A.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(B.id_to_piece, b)]
    return a, b, bytes_a, bytes_b


def aligned_by_hand(rows):
    linked, made = Counter(), []
    for key, text in rows:
        a, b, bytes_a, bytes_b = spelt(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            made.append((key, [], [], [], []))
            continue
        ends_a, ends_b = {}, {}
        for ends, tokens in ((ends_a, bytes_a), (ends_b, bytes_b)):
            at = 0
            for i, t in enumerate(tokens):
                at += len(t)
                ends[at] = i
        shared, groups, i, j = sorted(ends_a.keys() & ends_b.keys()), [], 0, 0
        for at in shared:
            m, n = ends_a[at] + 1, ends_b[at] + 1
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            i, j = m, n
        pairs = [(a[ends_a[at]], b[ends_b[at]]) for at in shared]
        linked.update(pairs)
        made.append((key, a, b, groups, pairs))
    highest = Counter()
    for (_, second), n in linked.items():
        highest[second] = max(highest[second], n)
    rows = [(key, len(a), len(b), len(groups), len(pairs), sum(linked[p] == highest[p[1]] for p in pairs), sum(linked[p] for p in pairs),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for key, a, b, groups, pairs in made]
    return rows, linked, highest


def test_shared_cuts_equal_brute_force(docs, odd):
    both = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    want, linked, highest = aligned_by_hand([(r.doc_id, r.text) for r in both.collect()])
    got = [tuple(r) for r in alignment.compare(both.withColumn("pairs", F.lit(1))).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    pairs = {(r.a, r.b): (r.links, r.best) for r in alignment.links(both).collect()}
    assert pairs == {p: (n, n == highest[p[1]]) for p, n in linked.items()}


def test_align_finds_every_shared_cut():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a, b = (sorted({*rng.choice(np.arange(1, n + 1), int(rng.integers(0, n)), replace=False).tolist(), n}) for _ in range(2))
        cuts = alignment.align(a, b)
        assert [a[i - 1] for i, _ in cuts] == [b[j - 1] for _, j in cuts] == sorted({*a} & {*b})


def test_shared_cuts_of_an_empty_table(odd):
    assert alignment.compare(odd.limit(0)).collect() == []
    assert alignment.links(odd.limit(0)).collect() == []


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ranked_by_hand(rows, items, k=50):
    tfs = [(key, Counter(TERM.findall(low(t)))) for key, t in rows]
    docs, length = sum(bool(c) for _, c in tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(TERM.findall(low(text)))
    out = []
    for item, terms in asked.items():
        scores = []
        for key, c in tfs:
            n = sum(c.values())
            score = 0
            for t in terms:
                if c[t]:
                    m = 100 - 50 + 50 * n * docs // length
                    score += math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, key is not None, key or 0, key))
        out += [(item, i, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_ranked_search_equals_brute_force(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = ranked_by_hand([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted((tuple(r) for r in nra.rank(docs, items).collect()), key=str) == want


def test_ranked_search_in_parts_and_blocks(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(map(str, nra.rank(docs, items, k=7).collect()))
    monkeypatch.setattr(nra, "PART_TERMS", 300)
    monkeypatch.setattr(nra, "BLOCK_POSTINGS", 500)
    assert sorted(map(str, nra.rank(docs.repartition(3), items, k=7).collect())) == want


def test_ranked_search_odd_rows(spark, odd):
    asked = [(1, "word5 AND nothing"), (1, "two"), (2, None), (3, " .,"), (None, "and"), (4, "absent"), (5, "漢字 é"), (5, "漢字 é"), (6, "no x a b")]
    items = spark.createDataFrame(asked, "item_id int, text string").withColumn("row", F.lit(0))
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    for k in (3, 50):
        assert sorted((tuple(r) for r in nra.rank(odd, items, k=k).collect()), key=str) == ranked_by_hand(rows, asked, k)
    assert nra.rank(odd.limit(0), items).collect() == [] == nra.rank(odd, items.limit(0)).collect()


def test_interval_search_equals_sorting():
    rng = np.random.default_rng(9)
    for _ in range(200):
        n, k = int(rng.integers(1, 80)), int(rng.integers(1, 12))
        total, lists = np.zeros(n, np.int64), []
        for _ in range(int(rng.integers(1, 70))):
            docs = rng.choice(n, int(rng.integers(1, n + 1)), replace=False)
            gains = np.sort(rng.integers(1, 8, len(docs)))[::-1]
            total[docs] += gains
            lists.append((docs, gains))
        rank = rng.permutation(n)
        best = sorted((i for i in range(n) if total[i]), key=lambda i: (-total[i], rank[i]))[:k]
        found, scores = nra.search(lists, rank, k, step=int(rng.integers(1, 5)))
        assert found.tolist() == best and scores.tolist() == total[best].tolist()


def test_registered():
    assert {"op11_partial_matching", "op12_shared_cuts", "op13_no_random_access"} <= set(queries.QUERIES)


def test_bands_follow_the_threshold():
    from stockweave.llm import minhash

    assert [minhash.bands_for(t) for t in (0.8, 0.85)] == [38, 24]
    for t in (0.5, 0.7, 0.8, 0.85, 0.9, 0.95):
        assert (1 - t**minhash.ROWS) ** minhash.bands_for(t) <= minhash.MISSED


def test_plain_text_joins_any_white_space_of_a_block():
    page = "<ul><li>a   b\t\r\nc \x1c d</ul></foo><p>e<p>  f<br>g<script> x </script></p></bar> h"
    assert warc.plain_text(page) == "a b c d\ne\nf g\nh"
