"""Operators against brute force on small tables with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from vanefold.llm import bwt, fingerprints, html_text, jpeg, media, ngram_join, packing, pieces, quality, secret_scan, suffix_dedup, token_counts  # noqa: E402
from vanefold.llm.shingles import words_of  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, key string, n_tokens string"


def sample(seed=1):
    r = random.Random(seed)
    vocabulary = ["the", "of", "strasse", "élan", "Ñandú", "x1", "don't", "it's", "<|endoftext|>", "日本", "a_b", "²", "42", "  ", "\n", "tok"]
    out = [" ".join(r.choice(vocabulary) + str(r.randrange(50)) for _ in range(r.randrange(1, 120))) for _ in range(24)]
    base = " ".join(f"w{r.randrange(1000)}" for _ in range(90))
    words = base.split()
    out += [base, base, " ".join([*words[:-2], "other", "end"]), " ".join(words[:60]) + " " + out[0], base.upper(), "AKIA" + "Q" * 20 + " password: hunter2hunter2 " + "0123456789abcdef" * 3]
    out += [None, "", " ", "one two", "▁ mark ", "x" * 5000]
    return [(i, t, "en", "k", "clash") for i, t in enumerate(out)] + [(3, out[3], "en", "k", "clash"), (None, "no id here at all", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def text_of(t):
    return t or ""


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    got = token_counts.token_counts(docs, path).collect()
    want = Counter((r[0], len(text_of(r[1]).encode()), len(theirs.encode(text_of(r[1]), add_special_tokens=False).ids)) for r in sample())
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts.token_counts(empty, path).count() == 0


def test_pre_tokens_agree_on_every_letter():
    c = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"a{chr(k)}{chr(k)} 1{chr(k)}!" for k in range(0x3000) if not 0xD800 <= k < 0xE000]
    assert c.counts(texts) == [len(e.ids) for e in c.library.encode_batch(texts, add_special_tokens=False)]


def shingles(t):
    w = words_of(text_of(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    """By (id, text): rows of one id are joined."""
    sets = {(i, text_of(t)): shingles(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, _), a in sets.items():
        for (j, _), b in sets.items():
            if i < j and a and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return Counter((i, len(sets[i, text_of(t)]), find(i)) for i, t in rows)


def test_near_duplicates(docs, empty):
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect() if r[0] is not None)
    assert got == brute_components([(r[0], r[1]) for r in sample() if r[0] is not None])
    assert ngram_join.near_duplicates(empty).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({c for _, _, c in got}) and ids.count(None) == 1


def near_copies(seed, n):
    """Groups of near copies about the threshold, passages that many share, ids with several texts and repeated rows."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    bases = [[r.choice(words) for _ in range(r.randrange(5, 150))] for _ in range(8)]
    out = []
    for i in range(n):
        t = list(r.choice(bases))
        for _ in range(r.randrange(0, max(2, len(t) // 25))):
            t[r.randrange(len(t))] = r.choice(words)
        if r.random() < 0.4:
            t = passage[: r.randrange(20, 60)] + [r.choice(words) for _ in range(r.randrange(5, 40))]
        out.append((i, " ".join(t)))
    out += [(r.randrange(n), r.choice(out)[1]) for _ in range(n // 5)]
    return out


def test_near_duplicates_of_ids_with_several_texts(spark):
    rows = near_copies(1, 150)
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)
    b, a = " ".join(f"b{i}" for i in range(30)), " ".join(f"a{i}" for i in range(60))
    rows = [(1, b), (3, a), (3, b), (7, a + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()} == {1: 1, 3: 1, 7: 1}
    assert [r["doc_id"] for r in ngram_join.one_of_each(docs).collect()] == [1]


def test_rare_shingles_find_every_link(spark):
    """The second key alone, without the stars before it."""
    rows = near_copies(5, 80)[:80]
    reps = spark.createDataFrame(rows, "node long, text string")
    near = [(r["key"], r["node"]) for r in ngram_join.sharing(ngram_join.by_shingle(reps)).collect()]
    by = {}
    for k, i in near:
        by.setdefault(k, set()).add(i)
    met = {(i, j) for v in by.values() for i in v for j in v if i < j}
    sets = {i: shingles(t) for i, t in rows}
    linked = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert linked and linked <= met and len(met) < len(sets) * (len(sets) - 1) / 4


@pytest.mark.parametrize("size", [4, 5, 6, 9, 15, 16, 40, 200])
def test_linked_sets_share_a_key(size):
    r = np.random.default_rng(size)
    for _ in range(40):
        a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        drop = r.integers(0, size // 5 + 1)
        b = np.unique(np.concatenate([a[r.permutation(len(a))[drop:]], r.integers(0, 2**63, r.integers(0, size // 5 + 1)).astype(np.uint64)]))
        if ngram_join.linked(a, b):
            assert np.intersect1d(*(np.concatenate([k for k, _ in ngram_join.keys_of(s)]) for s in (a, b))).size


def brute_repeats(rows, window):
    raws = [(i, text_of(t).encode()) for i, t in rows]
    seen = Counter(r[p : p + window] for _, r in raws for p in range(len(r) - window + 1))
    out = []
    for i, r in raws:
        hit = bytearray(len(r))
        for p in range(len(r) - window + 1):
            if seen[r[p : p + window]] > 1:
                hit[p : p + window] = b"\1" * window
        kept = bytes(x for x, y in zip(r, hit, strict=True) if not y)
        out.append((i, len(r), len(r) - len(kept), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_suffix_dedup(docs, empty):
    want = brute_repeats([(r[0], r[1]) for r in sample()], 200)
    for split in (2, 2000):
        assert Counter(tuple(r) for r in suffix_dedup.dedup_report(docs, split=split).collect()) == want
    assert suffix_dedup.dedup_report(empty).count() == 0
    clash = docs.selectExpr("doc_id", "text", "lang as _id", "key as _th", "n_tokens as _raw", "lang as _runs", "key as _0")
    got = suffix_dedup.deduplicated(clash)
    assert got.columns == clash.columns and {r["_raw"] for r in got.collect()} == {"clash", None}


@pytest.mark.parametrize("split", [3, 2000])
def test_suffix_dedup_of_a_shared_passage(spark, split):
    r = random.Random(8)
    passage = "".join(r.choice("abcdefg ") for _ in range(330))
    near = passage[:150] + "#" + passage[151:]
    rows = [(i, "".join(r.choice("xyz ") for _ in range(r.randrange(300))) + (near if i % 3 == 0 else passage[i % 7 :]) + "".join(r.choice("uvw ") for _ in range(r.randrange(300)))) for i in range(40)]
    rows += [(90, "ab" * 400), (91, "z" + "ab" * 200), (92, None)]
    got = suffix_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string"), split=split)
    assert Counter(tuple(x) for x in got.collect()) == brute_repeats(rows, 200)


def test_merged_transforms(monkeypatch):
    monkeypatch.setattr(bwt, "SHARD", 100)
    r = random.Random(5)
    base = bytes(r.choice(b"ab ") for _ in range(60))
    strings = [base[r.randrange(50) :][: r.randrange(30)] + bytes(r.choice(b"abc\0\xff") for _ in range(r.randrange(20))) for _ in range(30)]
    seen = Counter(s[i : i + 12] for s in strings for i in range(len(s) - 11))
    want = [[i for i in range(len(s) - 11) if seen[s[i : i + 12]] > 1] for s in strings]
    assert [x.tolist() for x in bwt.repeated_starts(strings, 12, [1] * 30)] == want


def test_quality(spark, docs, empty):
    r = random.Random(2)
    good = [(100 + i, " ".join(r.choice(["the", "cat", "sat", "on", "mat", "and", "ran"]) for _ in range(60)), "en", "k", "c") for i in range(80)]
    bad = [(500, "@@## $$%% " * 30, "en", "k", "c"), (501, None, "en", "k", "c")]
    table = spark.createDataFrame(good + bad, SCHEMA)
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(70)], "doc_id long, quality int, toxic int")
    kept = {x["doc_id"] for x in quality.good_documents(table, labels).collect()}
    assert kept >= set(range(100, 180)) and not kept & {500, 501}
    assert quality.good_documents(empty, labels).count() == 0
    for some in (labels, labels.limit(0)):  # with a model and without one
        told = quality.quality_report(docs, some).collect()
        assert len(told) == len(sample()) and not any(x["kept"] for x in told if x["doc_id"] in (30, 31))
        kept = quality.good_documents(docs, some)
        assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {x["doc_id"] for x in told if x["kept"]}


def brute_kneser_ney(texts, order=quality.ORDER, symbols=quality.SYMBOLS):
    """Log probability of a symbol after a context, from counts in dictionaries."""
    def coded(t):
        return tuple("\n" * (order - 1) + t)

    grams = {order: Counter(s[i : i + order] for s in map(coded, texts) for i in range(len(s) - order + 1))}
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    discounts = {}
    for k, c in grams.items():
        n = Counter(min(x, 4) for x in c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        raw = (1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5)
        discounts[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw)]
    def p(gram):
        if not gram:
            return 1 / symbols
        c, d = grams[len(gram)], discounts[len(gram)]
        after = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        total, off = sum(after.values()), sum(d[min(n, 3) - 1] for n in after.values())
        own = after.get(gram, 0)
        return (own - d[min(own, 3) - 1] if own else 0) / total + off / total * p(gram[1:])

    def perplexity(t):
        s = coded(t)
        return float(np.exp(-np.mean([np.log(p(s[i : i + order])) for i in range(len(s) - order + 1)])))

    return perplexity


def test_perplexities_are_those_of_kneser_ney(spark, monkeypatch):
    texts = ["The cat sat on the mat, and ran.", "Élan: 12 cats!\nThe dog sat.", "and the cat ran on"]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, "zz 日本 top cat"])], "doc_id long, text string, lang string")
    want = brute_kneser_ney(texts)
    for most in ("10m", "-1"):  # tables of the model and costs broadcast, and shuffled
        monkeypatch.setattr(quality, "COSTS", 0 if most == "-1" else 1_000_000)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            found = quality.judged(docs, labels).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert len(found) == 4
        for r in found:
            assert abs(r["perplexity"] / want(r["text"]) - 1) < 1e-4


def test_ngram_counts_survive_encoding():
    r = random.Random(4)
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 20_000)))
    for texts in (["", "a", "\0b\0", "aaaa" * 300, "zz 日本😀"], [many, "ab", many[::-1], "", *["x"] * 100], ["".join(map(chr, range(0x10000, 0x1F000)))], ["".join(r.choice("ab c") for _ in range(r.randrange(90))) for _ in range(300)]):
        got = [Counter() for _ in texts]
        for grams, starts, who, n in quality._grams(texts):
            for g, a, z in zip(grams, starts, [*starts[1:], len(who)]):
                for w, k in zip(who[a:z], n[a:z]):
                    got[w][g] += int(k)
        for t, c in zip(texts, got):
            s = quality._PAD + t.replace("\0", "\ufffd")
            assert c == Counter(s[i : i + quality.ORDER] for i in range(len(t)))
    values = np.array([0, 1, 127, 128, 300, 2**14 - 1, 2**14, 2**31, 5])
    data, size = quality._varints(values)
    assert quality._values(data)[0].tolist() == values.tolist() and size.sum() == len(data)


def test_ngram_counts_take_little_memory():
    """Two tasks and the workers they feed share what an executor's heap leaves."""
    r = random.Random(5)
    texts = ["".join(r.choice("etaoin shrdlu") for _ in range(4000)) for _ in range(250)]
    tracemalloc.start()
    try:
        for _ in quality._grams(texts):
            pass
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 32 * 1_000_000


def test_thresholds_move_smoothly(spark):
    """One trusted text more or less of a rare language moves its threshold a little, at any number of them."""
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the", "cat", "sat", "on", "mat"]) for _ in range(60)), "en") for i in range(200)]
    rows += [(1000 + i, " ".join(r.choice(["zug", "wolf", "quark", "jux", "typ", "vlies"]) for _ in range(r.randrange(20, 80))), "de") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def threshold(n):
        labels = spark.createDataFrame([(i, 1, 0) for i, *_ in rows if i < 1000 + n], "doc_id long, quality int, toxic int")
        return quality.quality_report(table, labels).filter("doc_id = 1059").first()["threshold"]

    few, fewer, more = threshold(10), threshold(49), threshold(50)
    assert abs(np.log(more / fewer)) < 0.02
    whole = spark.createDataFrame([(i, 1, 0) for i, *_ in rows if i < 1010], "doc_id long, quality int, toxic int")
    pooled = quality.quality_report(table.withColumn("lang", F.lit(None).cast("string")), whole).filter("doc_id = 1059").first()["threshold"]
    assert few != pooled


def test_media(docs, empty):
    got = media.media_features(media.media_files(docs)).collect()
    want = Counter()
    for i, t, *_ in sample():
        raw = text_of(t).encode()
        p = media.pad(raw)
        want[i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert media.media_features(media.media_files(empty)).count() == 0


def test_broken_media_have_nulls(spark):
    a, b = jpeg.write_files([media.pad(b"first text " * 40), media.pad(b"second")])
    files = [a, a[: len(a) // 2], None, b"no picture", b, a.replace(b"\xff\xc0", b"\xff\xc2")]
    table = spark.createDataFrame([(i, 0, bytearray(f) if f is not None else None) for i, f in enumerate(files)], "doc_id long, n_bytes long, media binary").coalesce(1)
    got = {r["doc_id"]: r for r in media.media_features(table).collect()}
    assert [got[i]["feature"] is None for i in range(6)] == [False, True, True, True, False, True]
    assert [got[i]["payload_sha256"] is None for i in range(6)] == [False, True, True, True, False, True]
    assert got[0]["payload_sha256"] == hashlib.sha256(media.pad(b"first text " * 40)).hexdigest() and got[1]["media_bytes"] == len(a) // 2


def test_jpeg_runs_of_zeros():
    payloads = [b"\x80" * 320, b"\x80" * 20 + b"a" + b"\x80" * 43, b"\x80" * 63 + b"z", bytes(64), bytes(range(256)) * 3, b"\xff" * 128]
    assert [jpeg.payload(*x) for x in jpeg.read_files(jpeg.write_files(payloads))] == payloads


def test_pieces(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert pieces.parity([text_of(r[1]) for r in sample()], path) == []
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(pieces.encoded(docs, path), path).collect()}
    assert all(back[r[0]] == text_of(r[1]).replace("▁", " ") for r in sample())
    theirs = pieces.original(path)
    got = pieces.report(docs, path).collect()
    want = Counter((r[0], len(theirs.encode(text_of(r[1]))), zlib.crc32(np.array(theirs.encode(text_of(r[1])), dtype="<u4").tobytes())) for r in sample())
    assert Counter((r["doc_id"], r["n_pieces"], r["ids_crc32"]) for r in got) == want and all(r["parity"] for r in got)
    assert pieces.report(empty, path).count() == pieces.encoded(empty, path).count() == 0


def test_unseen_words_are_encoded_together():
    r = random.Random(6)
    words = list({"".join(r.choice("abcdeéñ日😀-1") for _ in range(r.randrange(1, 12))) for _ in range(5000)})
    texts = [" ".join(words), "  two   marks " + "\nline\n\n x" * 3, "▁", " ", "\n", "a\n" + words[0], "\0\ud7ff " * 3, "y" * 3000 + " z"]
    path = public_tokenizers.path("piece_bpe_32k.model")
    c, sent = pieces.Codec(path), []

    class Spy:
        def __getattr__(self, name):
            def call(batch, **kw):
                sent.extend(batch)
                return getattr(library, name)(batch, **kw)

            return call

    library, c.marked = c.marked, Spy()
    assert c.encode(texts) == [np.array(x, dtype="<u4").tobytes() for x in pieces.original(path).encode(texts, num_threads=1)]
    assert len(sent) < len(words) / 20


PAGE = "<html><head><title>t</title></head><body><nav>menu</nav><div>{m}</div><div><p>Body &amp; text{i} that is the longest <b>bl</b>ock.<br>x<p>second{i}</div><div class='cookie-notice'>c</div><footer>f"


def test_html(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(m="Shared menu", i=i)) for i in range(4)] + [(9, None, None), (10, "http://[", "<article><h1>T</h1>plain</article><p>out</p>"), (11, "x", "<p>only<script>var a='<p>'</script> this</p><form>no</form>")]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Body & text0 that is the longest block. x second0"
    assert got[9] == "" and got[10] == "T plain" and got[11] == "only this"


def test_html_chrome_inside_articles(spark):
    """A container that recurs inside the articles of a host goes; copied bodies, paragraphs and headings stay."""
    page = "<main><article><div>Get our letter</div><h2 id='related-work'>Work</h2><p class='notice-board'>Board</p><section id='sharing-data'>Data {i}</section><div class='comments'>Me {i}</div><div><p>A longest block of its own on page {i}, with words.</p><p>Copied line</p></div></article></main>"
    rows = [(i, f"http://h.example/{i}", page.format(i=i)) for i in range(4)]
    rows += [(10 + i, f"http://g.example/{i}", "<article><div><p>One body that several pages copy whole</p></div></article>") for i in range(4)]
    rows += [(20, "http://q.example", '<p class="open>first</p><p>second</p>')]
    got = {r["page_id"]: (r["text"], r["n_template"]) for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == ("Work Board Data 2 A longest block of its own on page 2, with words. Copied line", 1)
    assert got[11] == ("One body that several pages copy whole", 0)
    assert got[20][0] == "first second"


def test_html_templates_without_articles(spark):
    """Pages of plain containers, against a count in dictionaries; with repeated rows, a long page, no rows and other columns."""
    r = random.Random(4)
    bars = ["Home News About", "All rights reserved", "Follow us today"]
    rows, parts = [], {}
    for i in range(60):
        own = [f"Paragraph {i} {j} " + " ".join(r.choice(["of", "text", "that", "is", "its", "own"]) for _ in range(12)) for j in range(3 if i else 4000)]
        mine = [b for b in bars if r.random() < 0.5] + ["Seen twice"] * (i in (5, 25))
        parts[i] = (f"host{i % 2}", mine, own)
        rows.append((i, f"http://host{i % 2}.example/{i}", "".join(f"<div><span>{b}</span></div>" for b in mine) + "".join(f"<div>{p}</div>" for p in own), "clash", "clash"))
    pages = spark.createDataFrame([*rows, rows[7]], "page_id long, url string, html string, text string, page string")
    seen = Counter((h, b) for h, mine, _ in parts.values() for b in mine)
    got = html_text.main_text(pages).collect()
    assert len(got) == 61
    for x in got:
        h, mine, own = parts[x["page_id"]]
        stay = [b for b in mine if seen[h, b] < html_text.TEMPLATE_PAGES]
        assert x["text"] == " ".join([*stay, *own]) and x["n_template"] == len(mine) - len(stay) and x["n_chars"] == len(x["text"])
    counted = {(t["host"], t["n_pages"]) for t in html_text.templates(html_text.subtrees(pages)).collect()}
    assert counted == {(f"{h}.example", n) for (h, _), n in seen.items() if n >= html_text.TEMPLATE_PAGES}
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_secrets(docs):
    a = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rows = docs.sparkSession.createDataFrame([(1, 'é token="abc" secret: token: abcdefghij'), (2, "API_KEY=ABCDEFGH12 AKIAAKIA AKIA" + "Z9" * 8), (3, None), (4, "id " + "0af3" * 9 + " q8Zr+Lw2/Xc7Vb9Nm4Kj6Hg1Fd5Ss3")], "doc_id long, text string")
    for r in secret_scan.secret_report(rows).collect():
        t = {x["doc_id"]: text_of(x["text"]) for x in rows.collect()}[r["doc_id"]]
        s = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[1]) >= 8]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        want = ",".join(f"{('assign', 'access', 'hex')[k]}:{x}:{y}" for x, k, y in sorted(s))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["doc_id"] != 4 or r["n_entropy"] == 1
    assert secret_scan.redacted(rows).filter("doc_id = 2").first()["text"] == "[secret] AKIAAKIA [secret]"


def test_short_and_prefixed_keys(spark):
    key = "q8Zr+Lw2/Xc7Vb9Nm4Kj6H"
    rows = [(1, f"id {key} end"), (2, f"see example_key={key}"), (3, f"in /examples/{key}"), (4, "example-0123456789-abcdefgh-xxxxxxxx")]
    got = {r["doc_id"]: r["text"] for r in secret_scan.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(key in got[i] for i in (1, 2, 3)) and got[4] == rows[3][1]


def brute_entropy(t, base):
    """Spans of runs by a fresh count of every window."""
    masked = t
    for word in secret_scan.ALLOWED:
        masked = re.sub(word, " " * len(word), masked, flags=re.I)
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", masked):
        x = m[0]
        if not re.search("[0-9]", x) or not re.search("[A-Za-z]", x) or any(a <= m.start() and m.end() <= b for a, b in base):
            continue
        least = secret_scan.THRESHOLDS["hex" if re.fullmatch("[0-9a-fA-F]+", x) else "alnum" if re.fullmatch("[0-9A-Za-z]+", x) else "base64"]
        hits = [i for i in range(len(x) - 19) if -sum(n / 20 * np.log2(n / 20) for n in Counter(x[i : i + 20]).values()) >= least - 1e-9]
        if hits and not any(a <= m.start() + hits[0] and m.start() + hits[-1] + 20 <= b for a, b in base):
            out.append((m.start() + hits[0], m.start() + hits[-1] + 20))
    return out


def test_entropy_spans(spark, empty):
    r = random.Random(9)
    letters = secret_scan.ALPHABET
    rows = [(i, " ".join("".join(r.choice(letters[: r.choice([4, 8, 16, 62, 67])]) for _ in range(r.randrange(10, 90))) for _ in range(6))) for i in range(60)]
    rows += [(100, "AB" * 30 + "1"), (101, "example" + "q8Zr+Lw2/Xc7Vb9Nm4Kj6H" + "0123456789"), (102, "\U0001f600 q8Zr+Lw2/Xc7Vb9Nm4Kj6Hg1 \U0001f600"), (103, None), (103, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {i: text_of(t) for i, t in rows}
    for x in secret_scan.secret_report(docs).collect():
        spans = [s.split(":") for s in x["spans"].split(",") if s]
        base = [(int(a), int(b)) for k, a, b in spans if k != "entropy"]
        assert [(int(a), int(b)) for k, a, b in spans if k == "entropy"] == brute_entropy(texts[x["doc_id"]], base)
    assert secret_scan.secret_report(empty).count() == secret_scan.redacted(empty).count() == 0


def test_secrets_in_very_long_texts_and_clashing_columns(spark):
    key = "q8Zr+Lw2/Xc7Vb9Nm4Kj6H"
    long = ["/a" * 500_000 + "/9b", "z" * 1_000_000, "y1" * 200_000, " " * 500_000 + f"id {key}", "/a" * 5000 + "/9b"]
    docs = spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in enumerate(long)], "doc_id long, text string, base_spans string, all_spans string, spans string, _1 string")
    got = secret_scan.redacted(docs)
    assert got.columns == docs.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[3]["text"].endswith("id [secret]") and rows[1]["text"] == long[1]
    assert all((r["base_spans"], r["all_spans"], r["spans"], r["_1"]) == ("x", "y", "z", "w") for r in rows.values())


def test_packing(docs, empty):
    """Every piece holds the library's ids from its start on; pieces part each document and fill sequences gaplessly."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    long = [(1000 + i, " ".join(f"w{j}" for j in range(n)), "en", "k", "c") for i, n in enumerate((700, 1365, 2000, 4000, 9000))]
    table = docs.unionByName(docs.sparkSession.createDataFrame(long, SCHEMA)).repartition(3)
    want: dict = {}
    for i, t, *_ in [*sample(), *long]:
        want.setdefault(i, []).append([*theirs.encode(text_of(t), add_special_tokens=False).ids, 1])
    rows = packing.packed(table, path).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    left = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert any(crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] and len(ids) == r["doc_tokens"] for ids in want[r["doc_id"]])
    for i, all_ids in want.items():
        for ids in all_ids:  # rows of one id follow one another from 0 to their end
            at = 0
            while at < len(ids):
                piece = next(p for p in left if p[0] == i and p[1] == at and p[4] == len(ids) and p[3] == crc(ids[at : at + p[2]]) and left[p] > 0)
                left[piece] -= 1
                at += piece[2]
            assert at == len(ids)
    assert not sum(left.values())
    fills = []
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        fills.append(at)
    assert sum(x < 2048 for x in fills) <= 1 and max(fills) <= 2048
    assert packing.packed(empty, path).count() == 0


def test_words_are_remembered_within_bytes():
    from vanefold.llm.word_ids import Remembered

    made = []
    r = Remembered(lambda w: made.append(w) or w.encode(), limit=3000)
    for _ in range(3):
        assert [r[f"w{i}"] for i in range(40)] == [f"w{i}".encode() for i in range(40)]
    assert len(r) <= 25 and len(made) > 40


@pytest.mark.parametrize("range_bytes", [300, fingerprints.RANGE_BYTES])
def test_fingerprints(docs, empty, range_bytes):
    rows = fingerprints.edited_fingerprints(docs, range_bytes).collect()
    order = sorted(sample(), key=lambda r: (r[0] is None, -(r[0] or 0), text_of(r[1])))
    want = Counter()
    for i, r in enumerate(order):
        t, n = text_of(r[1]), text_of(order[(i + 1) % len(order)][1])
        want[r[0], len(t), hashlib.sha256(fingerprints.edited(t, n).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    assert all(abs(fingerprints.fingerprint_likeness(r["fingerprint"], r["edited_fingerprint"]) - r["near_edited"]) < 1e-9 for r in rows)
    assert fingerprints.edited_fingerprints(empty, range_bytes).count() == 0


def test_likeness_is_near_the_true_similarity():
    r = random.Random(6)
    errors = []
    for _ in range(150):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randrange(40, 400))]
        other = [w if r.random() < 0.97 else "x" + w for w in words]
        a, b = " ".join(words), " ".join(other)
        low, some = fingerprints.bins_of([a, b])
        near = fingerprints.likeness(low[:1], some[:1], low[1:], some[1:])[0]
        errors.append(abs(near - len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))))
    assert np.mean(errors) < 0.03 and max(errors) < 0.12
