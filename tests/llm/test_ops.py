"""Operators against brute force, and the cases that every operator must stand."""

import hashlib
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import bpe, langid, licenses, media, near, packing, pii, quality, repeats, sais, sketch, topk
from tokenloom.llm.common import byte_view, table
from tokenloom.llm.queries import tokenizer_path

HARD = [(1, ""), (2, None), (3, "a b c"), (3, "a b c"), (4, "word " * 4000), (5, " \n\t "), (6, "é" * 700), (None, "a lone text"), (7, "word " * 4000 + "end")]


def hard(spark, rows=HARD):
    """Nulls, empty and long texts, repeated rows, and columns with names that operators use inside."""
    d = spark.createDataFrame(rows, "doc_id long, text string")
    extra = {c: F.lit(1) for c in ("h1", "s1", "node", "bucket", "n", "lang2")}
    return d.withColumns(extra).withColumn("lang", F.lit("en"))


# --- 1 ---


def brute_pii(t):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15],
    }


def test_pii_base_spans():
    rng = random.Random(2)
    for _ in range(20000):
        t = "".join(rng.choice("0123456789..--  +@@ab()x\né") for _ in range(rng.randint(0, 70)))
        assert brute_pii(t) == pii.base_spans(t)


@pytest.mark.parametrize(
    "text, found",
    [
        ("write to jane dot doe at example dot com please", "jane dot doe at example dot com"),
        ("jane[at]example[dot]com", "jane[at]example[dot]com"),
        ("mail jоhn@exаmple.com now", "jоhn@exаmple.com"),
        ("call plus one five five five two three four five six seven", "plus one five five five two three four five six seven"),
        ("host 192 dot 168 dot 0 dot 1 is up", "192 dot 168 dot 0 dot 1"),
        ("look at example.com for it", None),
        ("he was at the dot com boom", None),
    ],
)
def test_pii_disguises(text, found):
    _, spans = pii.find(text)
    assert [text[a:b] for k in pii.KINDS for a, b in spans[k]] == ([found] if found else [])


def disguises():
    """Texts with every alternative in every bracket, and spelled numbers in several languages and separators."""
    ats = [o + s + w + s + c for w in pii._AT_IN.split("|") for o in "[({<" for c in "])}>" for s in ("", " ")] + ["&#64;", " @ "]
    dots = [o + s + w.replace("\\", "") + s + c for w in pii._DOT_IN.split("|") for o in "[({<" for c in "])}>" for s in ("", " ")] + [f" {w} " for w in pii._DOT_SPACED.split("|")]
    out = [(f"jean{a}exemple.fr", "email") for a in ats]
    out += [(f"jean{a}exemple{d}fr", "email") for a in ("@", " at ", "[at]") for d in dots]
    out += [(d.join(("192", "168", "0", "1")), "ip") for d in dots]
    names: dict = {}
    for w, v in pii._NUMBER.items():
        names.setdefault(v, []).append(w)
    rng = random.Random(3)
    for sep in (" ", "-", ",", ", "):
        for plus in ("plus ", "plus-", "+"):
            for _ in range(40):
                digits = [rng.randint(1, 9)] + [rng.randint(0, 9) for _ in range(9)]
                spelled = [rng.choice([str(d), *names[d]]) for d in digits]
                if sum(not w.isdigit() and w not in pii._DOUBTFUL for w in spelled) > 1:
                    out.append((plus + sep.join(spelled), "phone"))
    return out


def test_pii_gates_hide_no_disguise(monkeypatch):
    texts = [t for t, _ in disguises()]
    for t, kind in disguises():
        assert pii.find(t)[1][kind], t
    texts += ["oh " * 20, "null," * 16, "look at the dot", "5 plus 3 is eight", "one two", "at (the) dot"]
    gated = [pii.find(t) for t in texts]
    monkeypatch.setattr(pii, "_RUN", re.compile(""))
    monkeypatch.setattr(pii, "_disguises", lambda t: True)
    assert gated == [pii.find(t) for t in texts]


@pytest.mark.parametrize("part", ["a dot ", "a.", "x at ", "x (at) ", "one ", "one, 2-", "1.2.", "+1 (", "double ", "plus ", "[dot]", "1 ", "é dot ", "@", "a@b.", "one two x "])
def test_pii_is_linear(part):
    import time

    text = part * (200_000 // len(part))
    began = time.perf_counter()
    pii.find(text)
    assert time.perf_counter() - began < 8  # a quadratic step takes minutes


def test_pii_spans_of_planted_disguises():
    """Recall and exact spans over identifiers at known places in prose."""
    rng = random.Random(11)
    filler = "the report of last week was sent to all and read by none of them".split()
    said, exact, n = 0, 0, 0
    for t, kind in disguises():
        before, after = " ".join(rng.choices(filler, k=9)) + ": ", "; " + " ".join(rng.choices(filler, k=9))
        spans = pii.find(before + t + after)[1][kind]
        a, b = len(before), len(before) + len(t)
        n += 1
        said += any(x < b and y > a for x, y in spans)
        exact += (a, b) in spans
    assert said / n >= 0.97 and exact / n >= 0.9


def test_pii_words_that_are_digits_only_among_others():
    assert not any(pii.find("oh " * 16)[1].values()) and not any(pii.find("null," * 16)[1].values())


def test_pii_rows(spark):
    got = pii.find_pii(hard(spark)).collect()
    assert len(got) == len(HARD) and all(r["spans"] == "" for r in got)
    kept = pii.redact_column(hard(spark, [(1, "a b@c.de x"), (2, None)])).collect()
    assert [r["text"] for r in kept] == ["a <email> x", None] and kept[0]["h1"] == 1


# --- 2 ---


def test_suffix_arrays(monkeypatch):
    rng = np.random.default_rng(0)
    for trial in range(900):
        if trial == 100:
            monkeypatch.setattr(sais, "_SHORT", 1)  # induced sorting down to the end
        if trial == 500:
            monkeypatch.setattr(sais, "_SMALL", 2)  # names as two digits
        t = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 80))).astype(np.uint8)
        if trial % 3 == 0:
            t = np.tile(t[: max(1, len(t) // 5)], 5)
        b = t.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        sa = sais.suffix_array(t)
        assert sa.tolist() == want
        if len(b):
            p = sais.common_prefixes(t, sa, 1000, np.zeros(0, np.int64))
            for x, y in zip(want, want[1:]):
                assert p[y] == len(os.path.commonprefix([b[x:], b[y:]]))


def brute_repeats(texts, length=400):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                hit[i : i + length] = True
        edges = np.diff(np.concatenate([[0], hit.astype(int)]))
        out.append((len(t), int(hit.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~hit])).hexdigest()))
    return out


def brute_passages(texts, length=50):
    """Bytes and runs of words in passages that start at two places."""
    found = [list(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", t)) for t in texts]
    tokens = [[m[0].lower() for m in f] for f in found]
    count = Counter(tuple(w[i : i + length]) for w in tokens for i in range(len(w) - length + 1))
    out = []
    for f, w in zip(found, tokens):
        hit = np.zeros(len(w) + 2, int)
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                hit[i + 1 : i + 1 + length] = 1
        a, b = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
        out.append((sum(f[y - 1].end() - f[x].start() for x, y in zip(a, b)), len(a)))
    return out


@pytest.mark.parametrize("grain", [repeats.BYTES, repeats.PASSAGE])
def test_runs_of_a_batch(grain):
    """As of its texts one by one; nulls and empty lists have none, and runs may overlap and touch."""
    rng = random.Random(8)
    texts = ["", None, "ab, cé d", *(" ".join("xyé"[: rng.randint(1, 3)] for _ in range(rng.randint(1, 60))) for _ in range(40))]
    spans = []
    for t in texts:
        size = len((t or "").encode()) if grain.unit == "bytes" else len(grain.raw((t or "").encode())) // 8
        cuts = [sorted((rng.randint(0, size), rng.randint(0, size))) for _ in range(rng.randint(0, 4))]
        spans.append(rng.choice([None, [{"a": a, "b": b} for a, b in cuts if a < b]]) if size else None)
    data, off = byte_view(pa.array(texts))
    got = repeats.runs_in_bytes(pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), data, off, grain)
    want = [(i, *r) for i, (t, s) in enumerate(zip(texts, spans)) for r in repeats.in_bytes((t or "").encode(), s, grain)]
    assert list(zip(*(x.tolist() for x in got))) == want and len(want) > 20


def test_anchors_are_found_in_small_blocks(monkeypatch):
    """A block's hashes (8 bytes a symbol, a few at once) fit a core's cache, and anchors don't depend on blocks."""
    assert 4 * 8 * repeats.BYTES.block <= 1 << 20
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 399, 400, 401, 5000, 300, 900)]

    def found(texts):
        data, off = byte_view(pa.array(texts, pa.binary()))
        return list(zip(*(x.tolist() for x in repeats.anchors(*repeats.BYTES.symbols(data, off), repeats.BYTES))))

    got = found(texts)
    assert got == [(i, *x[1:]) for i, t in enumerate(texts) for x in found([t])]
    for i, t in enumerate(texts):  # every string has one anchor, inside it
        runs = [x[1:4] for x in got if x[0] == i]
        assert [k for a, b, _ in runs for k in range(a, b + 1)] == list(range(max(0, len(t) - 399)))
        assert all(b <= at and at + 256 <= a + 400 for a, b, at in runs)


@pytest.mark.parametrize("many", [2000, 1])
def test_repeats(spark, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)  # few: anchors are split by what comes next, down to whole strings
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(7))
    base = "".join(word() for _ in range(300))
    texts = ["".join(word() for _ in range(200)) for _ in range(6)] + [base, base, base[100:900], "x" + base[:450] + "".join(word() for _ in range(99)) + base[700:1200], "z" * 1000, "ab" * 600, "q" * 399, "q" * 400]
    texts += [base[:n] + "!" + base[n:] for n in range(300, 1500, 37)]
    rows = [*HARD, *((100 + i, t) for i, t in enumerate(texts))]
    got = repeats.remove_repeats(hard(spark, rows)).collect()
    raw = [(t or "").encode() for _, t in rows]
    assert Counter(tuple(r)[1:] for r in got) == Counter(x + y for x, y in zip(brute_repeats(raw), brute_passages(raw)))
    cut = repeats.cut_repeats(hard(spark, rows))
    assert cut.count() == len(rows) and cut.columns == hard(spark, rows).columns
    assert repeats.remove_repeats(hard(spark, [])).count() == 0


# --- 3 ---


def test_ogg():
    for n in (0, 1, 191, 192, 193, 5000, 12288, 65025, 200000):
        raw = os.urandom(n)
        p = media.payload_of(raw)
        assert len(p) % 192 == 0 and len(p) > 0 and p.startswith(raw)
        s = media.demux(media.mux(p, n))
        assert b"".join(s[media.AUDIO].packets[1:]) == p and struct.unpack("<Q", s[media.TAGS].packets[1])[0] == n
        assert round(s[media.AUDIO].seconds() * media.RATE) == len(p)
    for size in (0, 254, 255, 256, 65024, 65025, 65026, 200000):
        packets = [(b"h", 0), (os.urandom(size), 5), (b"end", 9)]
        assert media.demux(b"".join(media._stream(7, packets)))[7].packets == [x for x, _ in packets]
    whole = bytearray(media.mux(media.payload_of(b"abc"), 3))
    whole[-1] ^= 1
    with pytest.raises(media.OggError):
        media.demux(bytes(whole))


def test_ogg_rows(spark):
    for r in media.read_media(media.to_media(hard(spark))).collect():
        t = next((x or "").encode() for i, x in HARD if i == r["doc_id"])
        p = media.payload_of(t)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))


# --- 4 ---


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_VALUES", 200 * 8)
    monkeypatch.setattr(topk, "BLOCK_VALUES", 40 * 8)
    monkeypatch.setattr(topk, "LEAF", 16)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(900, 8)) * 0.2, 1).astype(np.float32)  # many ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)] + [(2000, None), (2020, [float("nan")] * 8), (2040, [None] + [0.0] * 7)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit(1))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(d).collect()}
    q = np.floor(64 * x.astype(float)).astype(np.int64)
    s = q @ q.T
    want = {}
    for i in range(0, 900, 20):
        best = sorted((-int(s[i, j]), j) for j in range(900) if j != i)[:20]
        want |= {(i, k + 1): (j, -v) for k, (v, j) in enumerate(best)}
    assert got == want
    assert topk.top_k(d.where("false")).count() == 0


def test_top_k_of_large_components(spark):
    """Every finite vector takes part, with exact scores."""
    from fractions import Fraction
    from math import floor

    rng = random.Random(7)
    x = [[rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.choice(e) for _ in range(3)] for e in ([0], [20, 24], [26, 31], [40, 70], [300], [600], [1000]) for _ in range(30)]
    x += [[3e7, 1.0, 0.0], [1e300, -1e300, 1.0], [1e300, -1e300, 2.0], [1.7e308, 1.7e308, 1.7e308]]
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>"), every=3).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    v = [[floor(64 * Fraction(c)) for c in row] for row in x]
    for i in range(0, len(x), 3):
        best = sorted((-sum(a * b for a, b in zip(v[i], v[j])), j) for j in range(len(x)) if j != i)[:20]
        assert sorted(got[i]) == [(n + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, j) in enumerate(best)]


def test_top_k_like_sql(spark, sf):
    import duckdb

    from tokenloom.llm.queries import ORACLE, op4_topk

    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    assert sorted(map(tuple, op4_topk(spark, sf).collect())) == sorted(c.execute(ORACLE["op4_topk"]).fetchall())


# --- 5 ---


def test_bpe_like_the_library(spark):
    from tokenizers import Tokenizer

    t, a = Tokenizer.from_file(tokenizer_path()), bpe.automaton(tokenizer_path())
    rng = random.Random(1)
    letters = "abcdefghie tnsrlo  \n\t'.-_0129é日本🙂\x1c\x85\xa0́²"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    parts = ["th", "er", "ing", "an", "in", "re", "Th", "the", "tion", " ", "s", "aa", "a", "aaa", "oo"]
    texts += ["".join(rng.choice(parts) for _ in range(12)) for _ in range(3000)]
    texts += ["a" * n for n in range(80)] + [" " * n for n in range(9)] + ["x<|endoftext|>y", "we'll I'M\n\n  x  ", ""]
    for s in texts:
        ids = t.encode(s, add_special_tokens=False).ids
        raw = a.encode(s)
        assert np.frombuffer(raw, "<u4").tolist() == ids, s
        assert a.decode(raw) == t.decode(ids, skip_special_tokens=False).encode()
    got = bpe.encode_texts(hard(spark), tokenizer_path()).collect()
    assert len(got) == len(HARD) and next(r for r in got if r["doc_id"] == 2)["n_tokens"] == 0


# --- 6 ---


def test_language(spark, sf):
    docs = table(spark, sf, "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    rows = {r["doc_id"]: r for r in langid.identify(hard(spark)).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[5]["lang_pred"] == "und"
    assert rows[3]["lang_pred"] == "en" and 0 <= rows[3]["score"] <= 1
    none = langid.identify(hard(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_character_grams():
    texts = ["Ein Baum, größer 日本語の🙂 x", "ab", "", "日本", "naïve café", "AbC1 2"]
    data, off = byte_view(pa.array(texts))
    d, h = langid.grams(data, off)
    plain = [re.sub(r"[\x00-\x40\x5b-\x60\x7b-\x7f]", " ", t.lower() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]

    def bucket(gram):
        data, off = byte_view(pa.array([gram]))
        return langid.grams(data, off)[1][-1]  # that of the whole, which comes last

    want = Counter((i, bucket(t[j : j + n])) for i, t in enumerate(plain) for n in (3, 4) for j in range(len(t) - n + 1))
    assert Counter(zip(d.tolist(), h.tolist())) == want


def test_language_like_brute_force(spark, monkeypatch):
    """Predictions of a plain naive Bayes in Python, for languages in one part and in several."""
    from math import exp, log

    rng = random.Random(4)
    sounds = {k: [rng.choice("bdfgklmnprstvz") + rng.choice("aeiouéüñ") for _ in range(6)] for k in ("aa", "bb", "cc", "dd", "ee")}
    say = lambda k, n: " ".join("".join(rng.choice(sounds[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, say(k, rng.randint(1, 12)), k) for i, k in enumerate(rng.choice(list(sounds)) for _ in range(160))] + [(900, None, "aa"), (901, "12 .", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    count, total, n = defaultdict(Counter), Counter(), Counter()
    grams = lambda t: langid.grams(*byte_view(pa.array([t])))[1].tolist()
    for i, t, k in rows:
        if i not in held and t is not None:
            count[k].update(grams(t))
            total[k] += len(grams(t))
            n[k] += 1
    want = {}
    for i, t, _ in rows:
        s = {k: log(n[k] / sum(n.values())) + sum(log((count[k][g] + 0.5) / (total[k] + 0.5 * langid.BUCKETS)) for g in grams(t)) for k in n} if t and re.search("[^\\W\\d_]", t) else {}
        top = max(s.values(), default=0)
        want[i] = (min((k for k in s if s[k] == top), default="und"), 1 / sum(exp(v - top) for v in s.values()) if s else 0.0)
    for langs in (500, 2):
        monkeypatch.setattr(langid, "LANGS", langs)
        got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
        assert {i: r["lang_pred"] for i, r in got.items()} == {i: x[0] for i, x in want.items()}
        assert all(abs(r["score"] - want[i][1]) < 1e-9 and r["held_out"] == (i in held) for i, r in got.items())


# --- 7 ---


def brute_near(rows, k, percent):
    sets, where = {}, defaultdict(list)
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        for x in sets[i]:
            where[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size", [24 << 20, 40000])
def test_near_duplicates(spark, monkeypatch, size):
    monkeypatch.setattr(near, "CLUSTER_BYTES", size)  # the smaller: clusters in several blocks
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(4):
        base = [rng.choice(vocab) for _ in range(300)]
        for _ in range(60):
            t = base[:]
            for _ in range(rng.randint(0, 12)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(t)))
    rows += [(1000, ""), (1001, None), (1002, "one"), (1003, "ONE"), (1004, " two words"), (1005, "two words")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(hard(spark, rows), 3, 85).collect()}
    assert got == brute_near(rows, 3, 85)


def test_near_links_of_all_texts_of_one_id(spark):
    rng = random.Random(8)
    base = [" ".join(f"{g}{rng.randrange(10**6)}" for _ in range(100)) for g in "abcd"]
    near_copy = [t + " end" for t in base]
    rows = [(1, base[0]), (1, base[1]), (1, base[2]), (11, near_copy[0]), (12, near_copy[1]), (13, near_copy[2])]
    rows += [(20, base[3]), (21, base[3]), (21, "one more text of twenty one")]  # 21 is not the least id of its first text
    for order in (rows, rows[::-1]):
        got = near.near_duplicates(hard(spark, order)).collect()
        assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (11, 1), (12, 1), (13, 1), (20, 20), (21, 20)}


def test_near_stage_keeps_one_row_of_a_group(spark):
    from tokenloom.llm import corpus

    a, b, c, d = (" ".join(f"{g}{i}" for i in range(120)) for g in "abcd")
    rows = [(5, a), (5, a), (9, a + " end"), (None, a), (None, b), (None, b), (7, c), (7, c), (8, d), (8, "another text"), (10, "lone"), (None, None)]
    got = corpus.near_dedup_stage(spark, hard(spark, rows), "").select("doc_id", "text").collect()
    want = [(5, a), (None, b), (7, c), (8, d), (8, "another text"), (10, "lone"), (None, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_near_rows(spark):
    got = near.near_duplicates(hard(spark)).collect()
    assert len(got) == len(HARD) and all(r["kept"] for r in got if r["doc_id"] in (1, 2, 3, 5))
    assert near.near_duplicates(hard(spark, [])).count() == 0


def test_sketch_agreement():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    x = sketch.sketch(np.concatenate([a[:300], a[100:]]), np.array([0, 300, 600]), 256)
    assert (x != sketch.EMPTY).all() and abs((x[0] == x[1]).mean() - 0.5) < 0.12
    one = sketch.sketch(a[:1], np.array([0, 1]), 64)
    assert (one != sketch.EMPTY).all()


# --- 8 ---


def test_licenses(spark):
    rows = [(1, "foo bar. Licensed under CC BY-NC 4.0. And so on"), (2, "x " * 500 + "\nThis work is licensed under the GNU General Public License, version 3.\n" + "y " * 300),
            (3, "licensed as you like under the sun"), (4, "RELEASED under the mit license"), (5, "Licensed under the Apache License, Version 2.0.")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(hard(spark, rows)).collect()}
    assert got == {1: "CC-BY-NC-4.0", 2: "GPL-3.0", 3: "", 4: "MIT", 5: "Apache-2.0"}
    assert len(licenses.scan_licenses(hard(spark)).collect()) == len(HARD)


def test_license_bodies_without_their_notices(spark):
    from tokenloom.llm.license_texts import PASSAGES

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    zlib_ = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
    bsd = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n{}\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
    third = "Neither the name of Foo nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    want = {mit: "MIT", "x " * 300 + mit + " y" * 300: "MIT", zlib_: "zlib", bsd.format(""): "BSD-2-Clause", bsd.format(third): "BSD-3-Clause"}
    want |= {"\n".join(PASSAGES[n]): n for n in PASSAGES if n != "GNU"}  # those of GNU come from several texts
    texts = list(want)
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(hard(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == list(want.values())
    version3 = "\n".join([*PASSAGES["GNU"][:5], *PASSAGES["AGPL-3.0"]])
    assert [r["licenses"] for r in licenses.scan_licenses(hard(spark, [(1, version3)])).collect()] == ["AGPL-3.0"]


def test_license_windows_find_what_containment_finds():
    rng, scanner = random.Random(6), licenses.Scanner(licenses.TEMPLATES)
    for _ in range(200):
        name, t = rng.choice(licenses.TEMPLATES)
        text = " ".join(f"a{rng.randrange(99)}" for _ in range(rng.randint(0, 60))) + " " + t + " " + "b " * rng.randint(0, 60)
        data, off = byte_view(pa.array([text]))
        assert name in scanner.scan(data, off)[0]


# --- 9 ---


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(2)
    for _ in range(60):
        x = np.unique(rng.integers(1, 40, 9))
        c = rng.integers(1, 9, len(x))
        for k in (1, 2, 3, 20):
            pad = lambda b: sum(int(n) * (min(v for v in b if v >= y) - y) for y, n in zip(x, c))
            best = min(pad([*s, x[-1]]) for m in range(min(k, len(x))) for s in combinations(x[:-1], m))
            got = packing.boundaries(x, c, k)
            assert len(got) <= k and got[-1] == x[-1] and pad(got) == best


def test_packing(spark):
    rows = packing.pack(hard(spark), max_len=100, buckets=3, budget=500).collect()
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
        assert r["n_tokens"] + r["pad"] == r["bucket"] <= 100
    assert total[4] == 4000 and total[7] == 4001 and total[3] == 6 and total[1] == 0 and total[None] == 3
    for (bucket, _), n in Counter((r["bucket"], r["batch"]) for r in rows).items():
        assert not bucket or n * bucket <= 500
    assert packing.pack(hard(spark, [])).count() == 0


# --- 10 ---


def test_quality(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.train(docs, labels)
    assert model.thresholds[0] < model.thresholds[1]
    got = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    for r in got:
        assert 0 <= r["p_good"] <= r["p_not_toxic"] <= 1 and abs(r["expected_grade"] - r["p_good"] - r["p_not_toxic"]) < 1e-12
    assert np.mean([(r["p_good"] < 0.5) == (r["toxic"] == 1 or r["quality"] == 0) for r in got]) > 0.9
    assert quality.train(docs, labels.where("false")) is None
    assert all(r["p_good"] == 1 for r in quality.score(hard(spark), None).collect())
    assert len(quality.score(hard(spark), model).collect()) == len(HARD)


def test_quality_gradient():
    rng = np.random.default_rng(3)
    d, c, x = np.repeat(np.arange(6), 4), rng.integers(0, 5, 24), rng.normal(size=24)
    y, weight = np.array([0, 1, 2, 2, 1, 0]), rng.random(6) + 0.5
    w, theta = rng.normal(size=5), np.array([-0.3, 0.2])
    _, gw, gt = quality.gradient(w, theta, d, c, x, y, weight)
    step = 1e-6
    for par, got in ((w, gw), (theta, gt)):
        for i in range(len(par)):
            up, down = par.copy(), par.copy()
            up[i] += step
            down[i] -= step
            f = lambda p: quality.gradient(*(p if q is par else q for q in (w, theta)), d, c, x, y, weight)[0]  # noqa: B023, E731
            assert abs((f(up) - f(down)) / (2 * step) - got[i]) < 1e-6


def test_quality_held_out(spark, monkeypatch):
    """Trained on labels of three quarters of the documents; the others are told well."""
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 4 <> 1"))
    got = quality.score(docs.select("doc_id", "text"), model).join(labels.where("doc_id % 4 = 1"), "doc_id").collect()
    bad = [r["toxic"] == 1 or r["quality"] == 0 for r in got]
    assert np.mean([(r["p_good"] < 0.5) == b for r, b in zip(got, bad)]) > 0.85
    clash = docs.select("doc_id", "text").withColumns({n: F.lit("mine") for n in quality.NAMES})
    assert quality.score(clash, model).columns == ["doc_id", "text", *quality.NAMES]
    good = quality.select_good(clash, model)
    assert good.columns == clash.columns and 0 < good.count() < docs.count()
    monkeypatch.setattr(quality, "SAMPLE", 1)
    assert quality.train(docs, labels.where("doc_id < 0").union(labels)) is not None


# --- pipeline ---


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
