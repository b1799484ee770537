"""Each operator against brute force or a round trip, and on odd tables."""

import hashlib
import os
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import arrow, decontam, html, keybits, licenses, lines, mixing, quality, rules, simjoin, tokens, toxicity, wrappers
from tessera.llm.components import connected_components
from tests.llm.scans import reference_scan
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "this line is long enough to count as a repeated line in many documents"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], DOC)


ODD = [(None, "a text without an id that is long enough to have some words in it"), (1, None), (2, ""), (3, " \n\t\n"), (4, "x"), (5, "word " * 30_000), (6, "same text here\nand more"), (6, "same text here\nand more"), (7, "日本語 テキスト ☃ é x"), (8, "z" * 100_000)]


def odd(spark):
    """Nulls, empty, very long and repeated rows, and columns called like outputs."""
    base = docs_of(spark, ODD)
    for name in ("score", "predicted", "n_words", "kept", "items", "spans", "n_lines", "keep", "Tag", "doc", "component_id", "license", "bucket", "epochs"):
        base = base.withColumn(name, F.lit("clash"))
    return base


def empty(spark):
    return spark.createDataFrame([], DOC)


BENCH = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


# 1


def test_extraction_of_varied_pages():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1><nav>menu</nav></header><div id="cookie-banner">We use cookies</div><main><article><h1>Real &amp; title</h1><p>First <b>bold</b> para &lt;x&gt;.<p>Second&nbsp;para
      <ul><li>one<li>two</ul><aside>Related</aside><form>Subscribe</form><div class="comments"><p>reader</p></div></article></main><div class="sidebar">side</div><footer>foot</footer><script>var x="<p>no</p>";</script></body></html>"""
    assert wrappers.extract(page, None) == "Real & title First bold para <x>. Second para one two"
    assert wrappers.extract(None, None) == wrappers.extract("", None) == ""
    assert wrappers.extract("plain a < b", None) == "plain a < b"


def test_anchors_and_deep_nesting_stay():
    page = '<article><h2 id="related-work">Related work</h2><p>We compare.</p><section id="search-algorithms"><p>Binary search halves.</p></section><div id="related-posts">More</div><div id="comments">c</div></article>'
    assert wrappers.extract(page, None) == "Related work We compare. Binary search halves."
    for depth in (50, 250, 3000):
        page = "<body><article><p>one</p>" + "<div>" * depth + "deep" + "</div>" * depth + "<p>after</p></article><footer>f</footer></body>"
        assert wrappers.extract(page, None) == "one deep after"
    page = "<article>" + "<div>" * 20_000 + "x" + "</b>" * 20_000 + "</article>"
    assert wrappers.extract(page, None) == "x"


def test_helper_columns_may_clash(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", "<article><p>one</p></article>")], "page_id long, url string, html string")
    for name in ("__wrapper", "__host", "__salt", "__text"):
        pages = pages.withColumn(name, F.lit("mine"))
    got = html.extract_text(pages).first()
    assert got.text == "one" and got["__host"] == got["__wrapper"] == got["__salt"] == got["__text"] == "mine"
    docs = docs_of(spark, [(i, f"{LONG}\nown {i}") for i in range(6)])
    for name in ("__doc", "__tag", "__keep", "__tag2", "__other", "__text", "__spans0"):
        docs = docs.withColumn(name, F.lit("mine"))
    got = lines.apply_bitmaps(docs, lines.dedup_lines(docs)).collect()
    assert sum(r.n_dropped for r in got) == 5 and all(r["__keep"] == r["__doc"] == r["__text"] == "mine" for r in got)
    got = decontam.decontaminate(docs, spark.createDataFrame([(1, "own 3")], BENCH)).where("n_hit > 0").collect()
    assert [r.doc_id for r in got] == [3] and got[0]["__spans0"] == "mine"


def test_wrapper_inference():
    pages = [f"<body><div class='menu'><a>Home</a><a>About</a></div><div id=post><h1>Title {i}</h1>" + "".join(f"<p>text {i} {j}</p>" for j in range(2 + i)) + ("<blockquote>only here</blockquote>" if i == 2 else "") + "<p>Share this</p></div></body>" for i in range(4)]
    known = wrappers.learn(pages)
    kinds = {n[0] for n in known["wrapper"]}
    assert {"plus", "opt"} <= kinds
    assert known["region"].endswith("/div") or known["region"].endswith("/body")
    assert "text 1 0" in wrappers.extract(pages[1], known)
    assert "Home" not in wrappers.extract(pages[1], known)


def test_extract_text_on_odd_pages(spark):
    rows = [(1, "http://a.example/x", "<article><p>one</p></article>"), (2, None, "<p>two</p>"), (3, "http://a.example/y", None), (4, "", ""), (5, "http://a.example/x", "<article>" + "<p>w w</p>" * 20_000), (None, "http://b.example", "<div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract_text(pages).collect()}
    assert got[1] == ("one", 3) and got[2] == ("two", 3) and got[3] == ("", 0) and got[4] == ("", 0) and got[None] == ("", 0)
    assert got[5][1] == 20_000 * 4 - 1
    assert html.extract_text(pages.limit(0)).count() == 0


def test_constants_are_counted_over_all_pages(spark):
    """Only texts on nearly all pages of a host go, whatever the sampled pages show."""

    def page(i):
        lone = "<h2>Intr</h2><p>more of %d</p>" % i if i % 3 == 0 else ""
        return f"<body><div id=post><h1>Title {i}</h1><p>text one {i}</p>{lone}<p>Share this page</p></div></body>"

    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(40)] + [(100 + i, "http://b.example/x", page(3)) for i in range(5)]
    got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i} text one {i}" + (f" Intr more of {i}" if i % 3 == 0 else "") for i in range(40))
    assert got[100] == "Title 3 text one 3 Intr more of 3 Share this page"  # copies are one page
    known = wrappers.learn([page(i) for i in range(4)])
    assert "Intr" in wrappers.extract(page(3), known) and "Share this" not in wrappers.extract(page(3), known)


def test_alignment_chooses_region_and_constants(spark):
    """A long text equal on all pages is neither the region nor part of the article."""
    notice = " ".join(f"word{k}" for k in range(300))
    pages = [f"<body><section><p>{notice}</p></section><div><h1>Title {i}</h1><p>article text {i} " + "more words " * 5 + f"</p><blockquote>{notice[:200]}</blockquote><p>end {i}</p></div></body>" for i in range(5)]
    known = wrappers.learn(pages)
    assert known["region"].endswith("/div")
    rows = [(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == wrappers.extract(p, known) == f"Title {i} article text {i} " + "more words " * 5 + f"end {i}" for i, p in enumerate(pages))


def test_wrapper_of_all_pages():
    """Layouts add up in any cut, read pages of any length and don't grow with their number."""
    rng = random.Random(4)

    def page(i):
        body = "".join(f"<{t}>{t} {i} {k}</{t}>" for k, t in enumerate(rng.choices(["p", "h2", "h3", "blockquote", "pre"], k=rng.randrange(2, 40))))
        return f"<body><div><p>menu of the site {'word ' * 30}</p></div><section><h1>T {i}</h1>{body}</section><div><p>legal</p></div></body>"

    pages = [wrappers.page_blocks(page(i)) for i in range(300)]

    def total(some):
        out = wrappers.Layout.of(some[0])
        for p in some[1:]:
            out.add(wrappers.Layout.of(p))
        return out

    whole, half = total(pages), total(pages[:150])
    assert whole.region().endswith("/section") and len(whole.nodes) < 60 and whole.size <= half.size + 20
    parts = [wrappers.Layout.loaded(total(pages[i::7]).dumped()) for i in range(7)]
    for p in parts[1:]:
        parts[0].add(p)
    assert parts[0].region() == whole.region() and parts[0].mass == whole.mass and parts[0].held == whole.held
    long = wrappers.page_blocks("<body><article>" + "".join(f"<{t}>x {k}</{t}>" for k, t in enumerate(rng.choices(["p", "h2", "pre", "ul"], k=20_000))) + "</article></body>")
    layout = total([long, long[::-1], pages[0]])
    assert layout.region().endswith("/article") and sum(layout.mass.values()) == sum(len(t) for p in (long, long, pages[0]) for _, t, _, bad in p if not bad)


# 2


def reference_lines(rows, min_chars=40, min_docs=5):
    have = defaultdict(set)
    for i, t in rows:
        for line in (t or "").encode().split(b"\n"):
            if (k := lines.line_key(line, min_chars)) is not None:
                have[k].add(lines.NO_ID if i is None else i)
    out = []
    for i, t in rows:
        me = lines.NO_ID if i is None else i
        all_ = (t or "").encode().split(b"\n")
        keep = [x for x in all_ if (k := lines.line_key(x, min_chars)) is None or len(have[k]) < min_docs or max(have[k]) == me]
        out.append((i, len(all_), len(all_) - len(keep), hashlib.sha256(b"\n".join(keep)).hexdigest()))
    return sorted(out, key=str)


def made_lines(n):
    g = random.Random(3)
    pool = [f"{LONG} number {k}" for k in range(12)] + ["short", "", "é" * 39, "é" * 40, "  " + LONG.upper() + "\t", LONG]
    return [(i, "\n".join(g.choice(pool) for _ in range(g.randrange(1, 9)))) for i in range(n)]


@pytest.mark.parametrize("rows", [made_lines(120), ODD + [(100 + k, LONG + "\n" + LONG) for k in range(6)], [(1, LONG)]])
def test_line_dedup(spark, rows):
    d = docs_of(spark, rows).withColumn("n_lines", F.lit("clash"))
    got = lines.apply_bitmaps(d, lines.dedup_lines(d)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == reference_lines(rows)


def test_line_stream_across_partitions():
    """Any cut of the sorted rows into partitions and batches decides alike."""
    import pyarrow as pa

    g = random.Random(5)
    rows = sorted(((g.randrange(4), 0, -g.randrange(30)) for _ in range(300)), key=lambda r: r)
    rows = sorted({(h, lo, d) for h, lo, d in rows})
    table = pa.table([[r[0] for r in rows], [0] * len(rows), [-r[2] for r in rows], [0] * len(rows), [b"p"] * len(rows)], schema=lines.KEY_ARROW)
    docs = defaultdict(set)
    for h, _, d in rows:
        docs[h].add(-d)
    want = {(h, d) for h, ds in docs.items() if len(ds) >= 5 for d in ds if d != max(ds)}
    for cuts in range(20):
        at = sorted(g.randrange(len(rows)) for _ in range(cuts))
        drop, pending, ends = set(), [], defaultdict(list)
        for a, b in zip([0, *at], [*at, len(rows)], strict=True):
            s = lines.Stream(5)
            out = []
            for batch in table.slice(a, b - a).to_batches(max_chunksize=g.randrange(1, 40)):
                out += list(s.batch(batch))
            if s.key is not None:
                out += list(s.close(last=True))
            for o in out:
                for kind, hi, _, doc, tag, _ in zip(*(c.to_pylist() for c in o.columns), strict=True):
                    if kind == lines.DROP:
                        drop.add((hi, doc))
                    elif kind == lines.PENDING:
                        pending.append((hi, doc))
                    else:
                        ends[hi].append((doc, tag))
        for hi, doc in pending:
            if sum(n for _, n in ends[hi]) >= 5 and doc != max(d for d, _ in ends[hi]):
                drop.add((hi, doc))
        assert drop == want


# 3 and 7


def labelled(spark, sf_dir, name):
    return spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")


@pytest.mark.parametrize(("module", "label", "modulus", "held", "threshold", "least"), [(quality, "quality", 4, 2, 0.7, 0.95), (toxicity, "toxic", 5, 0, 0.5, 0.93)])
def test_held_out_accuracy(spark, sf_dir, module, label, modulus, held, threshold, least):
    docs, labels = labelled(spark, sf_dir, "documents"), labelled(spark, sf_dir, "labels")
    score = quality.score_quality if module is quality else toxicity.score_toxicity
    model = module.train(docs, labels)
    rows = score(docs, model, threshold, keep=["doc_id"]).join(labels, "doc_id").collect()
    test = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % modulus == held]
    assert len(test) > 500 and all(0 <= r.score <= 1 for r in test)
    assert sum(r.predicted == r[label] for r in test) / len(test) > least
    one, zero = ([r.score for r in test if r[label] == v] for v in (1, 0))
    assert np.mean([np.mean(np.array(zero) < s) + 0.5 * np.mean(np.array(zero) == s) for s in one]) > (0.97 if module is quality else 0.85)


def test_classifiers_on_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, None), (6, 1, 0), (6, 1, 0)], LABELS)
    for module, score in ((quality, quality.score_quality), (toxicity, toxicity.score_toxicity)):
        for lab in (labels, labels.limit(0)):
            model = module.train(odd(spark), lab)
            rows = score(odd(spark), model).collect()
            assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert score(empty(spark), module.train(empty(spark), labels)).count() == 0
    good = [f"a fine sentence number {i} about the weather".encode() for i in range(40)]
    bad = [f"### $$$ {i} %%% &&&".encode() for i in range(40)]
    m = quality.fit(good, bad)
    s = m.score(m.machine(), [good[0], bad[0], b"", None])
    assert s[0] > 0.7 > s[1] and s[2] == s[3] == 0.5


# 4


def reference_mix(docs, mix):
    """docs: (id, path, tokens). Budgets by repeated water-filling, then the seeded prefix."""
    total = sum(t for *_, t in docs)
    out = {}

    def fill(path, budget, depth):
        kids = defaultdict(int)
        for _, p, t in docs:
            if p[:depth] == path:
                kids[p[depth]] += t
        names = sorted(kids)
        w = {n: mix.weights.get(mixing.LEVELS[depth], {}).get(n, 1) for n in names}
        open_, left, got = set(names), budget, {}
        while True:
            full = [n for n in open_ if kids[n] * mix.max_epochs * sum(w[m] for m in open_) <= left * w[n]]
            if not full:
                break
            n = min(full, key=lambda m: (kids[m] * mix.max_epochs / w[m], m))
            got[n] = kids[n] * mix.max_epochs
            left -= got[n]
            open_.remove(n)
        all_w, up = sum(w[m] for m in open_), 0
        for n in names:
            if n in open_:
                got[n] = left * (up + w[n]) // all_w - left * up // all_w
                up += w[n]
            if depth + 1 < len(mixing.LEVELS):
                fill((*path, n), got[n], depth + 1)
            else:
                out[(*path, n)] = (got[n], kids[n])

    fill((), total * mix.share[0] // mix.share[1], 0)
    rows = []
    for path, (budget, available) in out.items():
        if not available:
            continue
        epochs, rest = divmod(budget, available)
        mine = [(hashlib.md5(":".join([str(mix.seed), *path, str(epochs), str(i)]).encode()).hexdigest(), str(i), t, i) for i, p, t in docs if p == path and t]
        for _, _, t, i in sorted(mine):
            last = max(0, min(t, rest))
            rest -= last
            if epochs * t + last:
                rows.append((i, *path, t, epochs, last, epochs * t + last))
    return sorted(rows, key=str)


@pytest.mark.parametrize("share", [(1, 3), (3, 5), (7, 2), (99, 1), (0, 1)])
def test_mixing(spark, share):
    g = random.Random(share[0])
    docs = [(i, (g.choice("ab"), g.choice(["en", "de", "fr"]), g.choice(["s1", "s2", "s3"]) if i % 3 else "s1"), g.choice([0, 1, 5, 40])) for i in range(400)]
    mix = mixing.Mix({"domain": {"a": 3}, "lang": {"en": 5, "de": 2}}, share, 3, 9)
    d = spark.createDataFrame([(i, "w " * t, p[0], p[1], p[2]) for i, p, t in docs], "doc_id long, text string, dom string, lang string, source string")
    got = mixing.mix_sources(d, mix, F.col("dom"), digits=1).collect()
    assert sorted(map(tuple, got), key=str) == reference_mix(docs, mix)
    total = sum(t for *_, t in docs)
    assert sum(r.taken_tokens for r in got) == min(total * share[0] // share[1], 3 * total)


def test_mixing_on_odd_tables(spark):
    mix = mixing.Mix(share=(1, 1))
    got = mixing.mix_sources(odd(spark).withColumn("lang", F.lit(None).cast("string")), mix, F.lit(None)).collect()
    assert sum(r.taken_tokens for r in got) == sum(len((t or "").split()) - (i == 7) for i, t in ODD)
    assert mixing.mix_sources(empty(spark), mix, F.lit("d")).count() == 0


def test_mixing_stays_native(spark):
    plan = mixing.mix_sources(docs_of(spark, [(1, "a b c")]), mixing.Mix(), F.lit("d"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 5


def test_license_scan(spark):
    mit = licenses.LICENSES["MIT"]
    changed = "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + mit.upper().replace('"', "“").replace(",", " ,").replace("\n", "\r\n\t")
    rows = [(1, mit), (2, changed), (3, mit + " extra"), (4, "text\nReleased under the MIT Licence!\nmore"), (5, "SPDX-License-Identifier: Apache-2.0\nLicensed under CC BY-NC 4.0."), *ODD]
    got = {}
    for r in licenses.scan_licenses(docs_of(spark, rows).withColumn("license", F.lit("clash"))).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.notices))
    assert got[1][0] == ("MIT", []) or ("MIT", []) in got[1]
    assert ("MIT", []) in got[2] and (None, []) in got[3] and (None, ["MIT"]) in got[4] and (None, ["Apache-2.0", "CC-BY-NC-4.0"]) in got[5]
    assert sum(map(len, got.values())) == len(rows)
    assert licenses.scan_licenses(empty(spark)).count() == 0
    assert licenses.scan_licenses(docs_of(spark, rows), licenses.license_table(spark, [])).where("license is not null or size(notices) > 0").count() == 0


def test_whole_license_files(spark):
    """Titles, wrapped lines and long licences."""
    wrap = lambda t, n: "\n".join("\n".join(textwrap.wrap(x, n)) for x in t.split("\n"))
    files = {i: f"{licenses.TITLES[i][0]}\n\nCopyright (c) 2020 Somebody\n\n" for i in licenses.TITLES}
    rows = [(k, files[i] + wrap(licenses.LICENSES[i], n)) for k, (i, n) in enumerate((i, n) for i in files for n in (40, 70, 78))]
    want = [i for i in files for _ in range(3)]
    got = {r.doc_id: r.license for r in licenses.scan_licenses(docs_of(spark, rows)).collect()}
    assert [got[k] for k in range(len(rows))] == want
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSD-3-Clause"} <= {i for _, i, kind, _ in licenses.known_licenses() if kind == "text"}
    if os.path.exists("/usr/share/common-licenses/Apache-2.0"):
        known = {d: i for d, i, kind, _ in licenses.known_licenses() if kind == "text"}
        for name, i in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0")):
            with open(f"/usr/share/common-licenses/{name}", "rb") as f:
                assert known[licenses.digest(f.read())] == i


# 6


def reference_components(rows, k, num, den):
    """Sets by all pairs; ids and texts as in the operator's definition."""
    up = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = []
    for i, t in rows:
        w = (t or "").encode().translate(up).split()
        sets.append((simjoin.NO_ID if i is None else i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and den * len(s & u) >= num * len(s | u):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    shown = lambda i: None if i == simjoin.NO_ID else i
    return sorted(((shown(i), len(s), shown(find(i)) if s else shown(i)) for i, s in sets), key=str)


def near_copies(seed, n=140):
    g = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    bases = [[g.choice(vocabulary) for _ in range(g.choice([2, 6, 30, 80]))] for _ in range(10)]
    for i in range(n):
        w = list(g.choice(bases))
        for _ in range(g.randrange(4)):
            w[g.randrange(len(w))] = g.choice([*vocabulary, "New"])
        if g.random() < 0.3:
            w = w[: g.randrange(1, len(w) + 1)]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "k", "num", "den", "block"), [(1, 3, 90, 100, 4096), (2, 5, 80, 100, 4096), (3, 2, 80, 100, 5), (4, 1, 80, 100, 3)])
def test_jaccard_join(spark, monkeypatch, seed, k, num, den, block):
    monkeypatch.setattr(simjoin, "BLOCK", block)
    rows = near_copies(seed)
    got = simjoin.similar_documents(docs_of(spark, rows), k, num, den).collect()
    assert sorted(map(tuple, got), key=str) == reference_components(rows, k, num, den)


@pytest.mark.parametrize(("bits", "lists"), [(8, 1), (8, 3), (256, 64)])
def test_jaccard_join_of_long_near_copies(spark, monkeypatch, bits, lists):
    """Folded bits and the least lists only, in place of all of them, lose no link."""
    monkeypatch.setattr(simjoin, "POSTED_BITS", bits)
    monkeypatch.setattr(simjoin, "POSTED_FINE", bits)
    monkeypatch.setattr(simjoin, "POSTED_LISTS", lists)
    rnd = random.Random(7)
    rows = []
    for base in range(12):
        words = [f"w{rnd.randrange(5000)}" for _ in range(600)]
        for each in (0, 95, 50, 40, 35, 20):
            new = list(words)
            for at in range(rnd.randrange(each) if each else len(new), len(new), each or 1):
                new[at] = f"new{rnd.random()}"
            rows.append((len(rows), " ".join(new)))
    got = simjoin.similar_documents(docs_of(spark, rows), 5, 80, 100).collect()
    assert sorted(tuple(r) for r in got) == sorted(reference_components(rows, 5, 80, 100))


def test_long_documents_send_short_entries(spark, monkeypatch):
    """Of a document of 6,000 words, each of 1,200 entries carried all its lists and 16 kB of bits."""
    rnd = random.Random(8)
    words = [f"w{rnd.random()}" for _ in range(6000)]
    other = [f"v{rnd.random()}" if at % 30 == 7 else w for at, w in enumerate(words)]  # alike, but no link
    sent, real = [], simjoin.group_pairs

    def seen(entries, like):
        sent.extend(entries.collect())
        return real(entries, like)

    monkeypatch.setattr(simjoin, "group_pairs", seen)
    got = simjoin.similar_documents(docs_of(spark, [(0, " ".join(words)), (1, " ".join(other))]), 5, 80, 100).collect()
    assert sorted(r.component_id for r in got) == [0, 1]
    assert len(sent) > 500
    assert max(len(r["bits"] or b"") + 8 * len(r["lists"]) for r in sent) <= simjoin.POSTED_FINE + 8 * simjoin.POSTED_LISTS


def test_hot_lists_are_cut_before_bits_are_attached(spark):
    """Lists of near copies have very many entries: what is dealt by list and range has no parity bits."""
    like = simjoin.Similarity(80, 100)
    groups = [(g, 100 + g % 40, 0 if g < 50 else g, 0 if g < 50 else g, bytes([g]) * 8) for g in range(60)]
    posted = [(t, g, 100 + g % 40, 3, 0, True) for t in range(4) for g in range(60 if t < 2 else 50)] + [(9, g, 100 + g % 40, 3, 0, False) for g in (50, 51)]
    groups = spark.createDataFrame(groups, "gid long, n int, c1 long, c2 long, bits binary")
    out = simjoin.listed(spark.createDataFrame(posted, "list long, gid long, n int, pos int, leader long, hot boolean"), groups, like)
    assert out.columns == simjoin.UNIT

    def exchanges(node):
        if node.nodeName() == "Exchange":
            yield node.outputPartitioning().toString(), node.output().mkString(" ")
        for k in range(node.children().size()):
            yield from exchanges(node.children().apply(k))

    dealt = [x for x in exchanges(out._jdf.queryExecution().executedPlan().initialPlan()) if x[0].startswith("hashpartitioning(list")]
    assert dealt
    assert not [x for x in dealt if "bits#" in x[1]]

    # Lists 2 and 3 are of one component; in the others each pair of sizes near enough meets in one block at least.
    rows = out.collect()
    assert {r.list for r in rows} == {0, 1, 9}
    assert all(r.bits == bytes([r.gid]) * 8 for r in rows)
    for t in (0, 1):
        units: dict = {}
        for r in rows:
            if r.list == t:
                units.setdefault(r.block, set()).add(r.gid)
        for a in range(60):
            for b in range(max(a + 1, 50), 60):
                x, y = sorted((100 + a % 40, 100 + b % 40))
                assert 100 * x < 80 * y or any({a, b} <= u for u in units.values())


def test_jaccard_join_on_odd_tables(spark):
    got = simjoin.similar_documents(odd(spark), 3, 90, 100).collect()
    assert sorted(map(tuple, got), key=str) == reference_components(ODD, 3, 90, 100)
    assert simjoin.similar_documents(empty(spark)).count() == 0


def test_bounds_lose_no_pair():
    """The parity bound never exceeds the symmetric difference, and is of use."""
    g = np.random.default_rng(0)
    like = simjoin.Similarity(80, 100)
    sets = [np.unique(g.integers(0, 2**63, n).astype(np.uint64)) for n in (5, 40, 41, 200, 1500)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.95)], g.integers(0, 2**63, 3).astype(np.uint64)])) for s in sets]
    bits = [simjoin.parity(s, like) for s in sets]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a)]
    truth = np.array([len(set(sets[a].tolist()) ^ set(sets[b].tolist())) for a, b in pairs])
    found = simjoin.differences([bits[a] for a, _ in pairs], [bits[b] for _, b in pairs])
    assert (found <= truth).all()
    assert simjoin.differences([simjoin.parity(g.integers(0, 2**63, 500).astype(np.uint64), like)], [simjoin.parity(g.integers(0, 2**63, 500).astype(np.uint64), like)])[0] > like.apart(1000)


def test_packed_numbers_come_back():
    g = np.random.default_rng(0)
    x, y = np.sort(g.integers(0, 2**63, 1000).astype(np.uint64)), g.integers(-5, 5, (1000, 3)).astype(np.int32)
    assert (simjoin.unpacked(simjoin.packed(x), np.uint64) == x).all()
    assert (simjoin.unpacked(simjoin.packed(y), np.int32, 3).reshape(-1, 3) == y).all()


def test_key_table_never_misses(spark):
    keys = np.random.default_rng(0).integers(-(2**63), 2**63, 2000)
    table = keybits.key_table(spark.createDataFrame([(int(k),) for k in keys], "h long"), "h")
    assert keybits.maybe(table, keys).all()
    assert keybits.maybe(table, keys + 1).sum() < 5


def test_jaccard_join_ties_one_ids_texts(spark):
    """Rows that share an id are one document; a null id ties nothing."""
    a, b = "one two three four five six seven", "uno dos tres cuatro cinco seis siete"
    rows = [(1, a), (5, a), (5, b), (9, b), (None, "x y z w v u"), (None, "p q r s t u v"), (12, "p q r s t u v")]
    got = simjoin.similar_documents(docs_of(spark, rows), 3, 90, 100).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(1, 1), (5, 1), (5, 1), (9, 1), (None, None), (None, None), (12, None)], key=str)


def test_keep_one_loses_no_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(7, a), (7, b), (8, a), (None, c), (None, b + " more"), (9, c), (3, None), (3, None), (4, ""), (11, "lone words here"), (11, "lone words here")]
    docs = docs_of(spark, rows).withColumn("key", F.lit("clash")).withColumn("perhaps", F.lit(1))
    got = simjoin.keep_one(docs, 5, 80, 100)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(7, a), (None, c), (None, b + " more"), (3, None), (4, ""), (11, "lone words here")], key=str)
    assert simjoin.keep_one(empty(spark)).count() == 0


def test_mixing_leaves_out_weight_zero(spark):
    """Nothing of weight 0 is taken, and what it can't give goes to others at every level."""
    rows = [(i, "a b c d", "en" if i % 2 else "de", f"src{i % 3}", 7) for i in range(60)]
    d = spark.createDataFrame(rows, DOC).withColumn("dom", F.when(F.col("doc_id") < 30, "a").otherwise("b"))
    mix = mixing.Mix({"domain": {"a": 1, "b": 1}, "lang": {"de": 0}, "source": {"src1": 0}}, (1, 2), 2, 3)
    got = mixing.mix_sources(d, mix, F.col("dom")).collect()
    assert {(r.lang, r.source) for r in got} == {("en", "src0"), ("en", "src2")}
    assert sum(r.taken_tokens for r in got) == 120
    with pytest.raises(ValueError, match="weight"):
        mixing.Mix({"lang": {"en": -1}})


def test_coverage_limit(spark):
    item = " ".join(f"b{i}" for i in range(12))
    docs = docs_of(spark, [(1, f"{item} x y z"), (2, item + " " + " ".join(f"o{i}" for i in range(40)))])
    bench = spark.createDataFrame([(1, item)], BENCH)
    clean = lambda **k: {r.doc_id: r.clean_text.split() for r in decontam.decontaminate(docs, bench, 10, **k).collect()}
    assert {i: len(w) for i, w in clean(max_span=20).items()} == {1: 15, 2: 52}
    assert {i: len(w) for i, w in clean(max_span=20, max_coverage=0.5).items()} == {1: 3, 2: 52}
    assert {i: len(w) for i, w in clean().items()} == {1: 3, 2: 40}


def test_components(spark):
    g = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (200, 150), (150, 200)] + [(300, 300 + g.randrange(1, 50)) for _ in range(60)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[150] == 150 and 100 not in got and set(v for k, v in got.items() if k >= 300) == {300}


def test_marks_have_neither_cap_nor_share_of_the_strongest():
    rng = random.Random(5)
    words = [f"w{k:03d}x" for k in range(400)]
    plain = lambda k: [rng.choice(words) for _ in range(k)]
    ordinary = [" ".join(plain(30)).encode() for _ in range(900)]
    rude = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}rude" for k in range(40)]
    common = [" ".join(w for x in plain(30) for w in (x, "idiot")) for _ in range(60)]
    toxic = common + [" ".join(w for x in plain(12) for w in (x, r)) for r in rude for _ in range(2)]
    got = toxicity.marks([t.encode() for t in toxic], ordinary)
    assert any(b"idiot" in g for g in got)
    assert all(any(r.encode() in g for g in got) for r in rude)
    assert not any(w.encode() in got for w in words)


def test_quality_dictionary_reads_whole_samples():
    texts = [bytes(random.Random(k).randbytes(6000)) for k in range(3)]
    assert b"".join(quality.segments(texts)) == b"".join(texts)


# 8


def test_decontamination(spark):
    g = random.Random(2)
    words = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(g.choice(words) for _ in range(g.choice([1, 3, 9, 10, 11, 25])))) for i in range(30)] + [(30, None), (31, ""), (None, "alpha beta"), (5, "w1 w2 w1")]
    rows = [(i, " ".join(g.choice(words) for _ in range(g.randrange(0, 400)))) for i in range(60)] + ODD + [(900, "Alpha, BETA!"), (901, items[4][1].upper())]
    bench = spark.createDataFrame(items, BENCH)
    named = [(str(i) if i is not None else "null", t.encode() if t is not None else None) for i, t in items]
    for block in (1 << 20, 60):
        for size in (1, 16):
            decontam.PASS_BLOCKS = size
            if block == 60 and size == 1:
                continue
            got = decontam.decontaminate(docs_of(spark, rows).withColumn("items", F.lit(0)), bench, 10, block_bytes=block).select("doc_id", "n_words", "n_hit", decontam.items_digest(F.col("items")).alias("d")).collect()
            want = reference_scan([t.encode() if t is not None else None for _, t in rows], named, 10)
            assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=str)
    decontam.PASS_BLOCKS = 16


def test_decontamination_in_passes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PASS_BLOCKS", 2)
    items = [(i, f"one{i} two{i} three{i}") for i in range(9)]
    rows = [(i, f"before one{i} two{i} three{i} after") for i in range(9)]
    got = decontam.decontaminate(docs_of(spark, rows), spark.createDataFrame(items, BENCH), 10, block_bytes=30).orderBy("doc_id").collect()
    assert [(r.n_hit, r["items"], r.clean_text) for r in got] == [(3, [str(i)], "before  after") for i in range(9)]


def test_decontamination_cuts_spans(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], BENCH)
    rows = [(1, "x a b c d e f g h i j k y"), (2, "x a b c d e f g h i y"), (3, None)]
    got = {r.doc_id: r.clean_text for r in decontam.decontaminate(docs_of(spark, rows), bench).collect()}
    assert got == {1: "x  y", 2: rows[1][1], 3: None}
    assert decontam.decontaminate(docs_of(spark, rows), spark.createDataFrame([], BENCH)).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(empty(spark), bench).count() == 0


# 9


def reference_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    full = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(full) - len(set(full)), len(hit)


def test_rule_counts(spark):
    g = random.Random(1)
    rows = ODD + [(100 + i, "".join(g.choice(["a ", "b ", "é ", "# ", "\n", "\x0b", "c d ", "a b c "]) for _ in range(g.randrange(200)))) for i in range(60)]
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(60)], LABELS)
    got = rules.apply_rules(docs_of(spark, rows).withColumn("kept", F.lit(0)), labels).collect()
    want = sorted(((i, *reference_rules(t)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert rules.apply_rules(empty(spark), labels.limit(0)).count() == 0


def test_binomial_bounds():
    import math

    for n, k, p in ((10, 0, 0.1), (50, 3, 0.1), (400, 9, 0.05), (30, 30, 0.5)):
        direct = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(rules.binomial_tail(k, n, p) - direct) < 1e-12


def test_steps_limit_false_rejections():
    n = rules.STEPS
    assert rules.choose_steps({0: (10, [0] * n)}) == {}  # too few to say anything
    assert rules.choose_steps({s: (100_000, [0] * n) for s in range(3)}) == dict.fromkeys(range(3), n - 1)
    assert rules.choose_steps({1: (100_000, [0, 0, 4000] + [99_999] * (n - 3))}) == dict.fromkeys(range(3), 2)
    assert rules.pools([10, 10, 500], 80) == [[0, 1, 2]] and rules.pools([90, 10, 70, 30], 80) == [[0], [1, 2, 3]] and rules.pools([90, 90, 1], 80) == [[0], [1, 2]]
    # In repeated trials the chosen step exceeds its limit no more often than the level.
    g = np.random.default_rng(0)
    over = 0
    for _ in range(300):
        true = np.sort(g.random(n)) * 4 * rules.MAX_FALSE
        draws = g.random(3000)
        chosen = rules.choose_steps({0: (3000, [int((draws < t).sum()) for t in true])})
        over += 0 in chosen and true[chosen[0]] > rules.MAX_FALSE
    assert over <= 300 * rules.LEVEL


def test_kept_against_brute_force(spark):
    """Steps and verdicts, counted text by text; odd rows and clashing columns ride along."""
    g = random.Random(4)
    word = lambda: "".join(g.choice("abcdefgh") for _ in range(g.randrange(2, 9)))
    rows = []
    for i in range(700):
        w = [word() for _ in range(g.choice([60, 120, 300]))]
        for _ in range(g.choice([0, 0, 0, 5, 40])):
            w[g.randrange(len(w))] = g.choice(["##", "SHOUT", "$$$"])
        rows.append((100 + i, " ".join(w)))
    labelled = [(100 + i, int(i % 3 > 0), 0) for i in range(600)]
    docs = odd(spark).unionByName(docs_of(spark, rows), allowMissingColumns=True)
    got = {r.doc_id: r.kept for r in rules.apply_rules(docs, spark.createDataFrame(labelled, LABELS)).collect()}

    def stats(t):
        n, chars, symbols, dup, repeat, upper, lines = rules.text_counts((t or "").encode())
        share = lambda x, y: x / y if y else 0.0
        return n, {"symbol_share": share(symbols, chars), "dup_line_share": share(dup, lines), "repeat_share": share(repeat, n), "upper_share": share(upper, chars), "word_length": share(chars, n)}, n < 50 or 100 * repeat > 50 * n

    def bad(values, step):
        return any(v > rules.CUTOFFS[r][min(step, len(rules.CUTOFFS[r]) - 1)] for r, v in values.items())

    stratum = lambda n: sum(n >= e for e in rules.STRATA)
    good = {i for i, q, _ in labelled if q}
    held = [stats(t) for i, t in rows if i in good]
    counts = {s: [v for n, v, failed in held if not failed and stratum(n) == s] for s in range(3)}
    steps = rules.choose_steps({s: (len(v), [sum(bad(x, k) for x in v) for k in range(rules.STEPS)]) for s, v in counts.items() if v})
    assert steps
    for i, t in [*ODD, *rows]:
        n, values, failed = stats(t)
        s = stratum(n)
        assert got[i] == (not failed and not (s in steps and bad(values, steps[s])))


def test_token_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    g = random.Random(4)
    pieces = [("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -4.5), ("▁a", -5.0), ("ba", -4.5), ("aba", -6.5), ("bb", -1.0), ("é", -2.0), ("abab", -9.0), ("▁ab", -7.0)]
    hf = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, False))
    hf.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
    v = tokens.Vocabulary(pieces)
    texts = ["".join(g.choice("aabbb é☃x") for _ in range(g.randrange(60))) for _ in range(400)] + ["ab" * 2000, "☃☃ ☃a☃☃", "", "   "]
    c = tokens.Counter(v)
    assert [c.text(t)[1] for t in texts] == [len(hf.encode(t).ids) for t in texts]
    rows = list(enumerate(texts)) + [(9000, None)]
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs_of(spark, rows).withColumn("n_tokens", F.lit(0)), v).collect()}
    assert got[9000] == 0 and [got[i] for i in range(len(texts))] == [c.text(t)[1] for t in texts]
    assert tokens.count_tokens(empty(spark), v).count() == 0
    assert tokens.Counter(tokens.Vocabulary([])).text("ab cd")[0] == 2


def test_public_vocabulary_counts():
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = tokens.sentencepiece_vocabulary(str(public_tokenizers.path("piece_bpe_32k.model")))
    hf = Tokenizer(models.Unigram([("<unk>", 0.0), *v.pieces], 0, False))
    hf.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
    texts = ["The quick brown fox jumps over the lazy dog.", "Ungewöhnliche Zusammensetzungen überall", "naïve café", "12345 67.89", "thnterble onthtionhent"]
    c = tokens.Counter(v)
    assert [c.text(t)[1] for t in texts] == [len(hf.encode(t).ids) for t in texts]


# Plumbing


def test_map_text_replaces_clashing_columns(spark):
    import pyarrow as pa
    from pyspark.sql import types as T

    d = spark.createDataFrame([(1, "ab", "x")], "doc_id long, text string, N string")
    got = arrow.map_text(d, lambda: lambda ts: [pa.array([len(t) for t in ts], pa.int64())], [("n", T.LongType())])
    assert got.columns == ["doc_id", "text", "n"] and got.first().n == 2


def test_extraction_equals_the_article_on_the_pages_table(spark, sf_dir):
    """The table's pages hold one <article>; its text by plain string cutting."""
    import html as entities

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract_text(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"</?(?:p|br|h1)[^>]*>", "\n", re.search(r"<article>(.*?)(?:</article>|<footer|$)", r.html, re.S)[1])
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in body.split("\n"))
        assert got[r.page_id] == " ".join(b for b in blocks if b)
