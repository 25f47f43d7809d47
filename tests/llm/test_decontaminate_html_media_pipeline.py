import hashlib
import itertools
import math
import random
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelog.llm import decontaminate as D
from framelog.llm import html_extract as H
from framelog.llm import jpeg, media

from .helpers import ODD, docs

DATA = Path("/root/testdata/sf0.001")


def brute_overlaps(text, item, least=13):
    """Most matches of a run with four matches to a substitution at least, over all alignments."""
    a, b = D.tokens(text), D.tokens(item)
    best = 0
    if len(b) < 7:
        return 0
    for shift in range(-len(b), len(a)):
        score = low = matches = low_matches = 0
        top = (0, 0)
        for j, w in enumerate(b):
            if 0 <= j + shift < len(a):
                same = a[j + shift] == w
                score += 1 if same else -D.PENALTY
                matches += same
                if score < low:
                    low, low_matches = score, matches
                top = max(top, (score - low, matches - low_matches))
        best = max(best, top[1])
    return best if best >= min(least, len(b)) else 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([6, 7, 14, 15, 20, 25, 40, 60] * 2)] + [(50, None), (51, "")]
    texts = []
    for k in range(60):
        words = [word() for _ in range(rng.randint(0, 80))]
        if k % 2:
            leak = D.tokens(rng.choice(items)[1])
            for _ in range(k % 4):
                if leak:
                    leak[rng.randrange(len(leak))] = "other"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in leak[rng.choice([0, 0, 2]) :]]
        texts.append((k, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matches for r in D.contaminated(docs(spark, texts), bench).collect()}
    want = {(i, k): n for i, t in texts for k, item in items if item and (n := brute_overlaps(t, item))}
    assert len(want) > 8
    assert got == want
    kept = {r.doc_id for r in D.decontaminated(docs(spark, texts), bench).collect()}
    assert kept == {i for i, _ in texts} - {i for i, _ in want}


def test_substitutions_are_tolerated():
    item = [f"t{k}" for k in range(15)]
    block = D.Block([(1, item)])
    for k in range(1, 14):
        leak = ["x"] * 5 + [*item[:k], "other", *item[k + 1 :]] + ["y"] * 3
        found = D._best(block, iter([" ".join(leak)]), 10)
        assert found and found[0][2] >= 10, k


def test_every_run_that_meets_the_rule_is_found():
    """Against all (start, stop) pairs: 14 tokens with the second replaced, and others whose best-scoring part is too short."""
    rng = random.Random(4)
    cases = [(n, c) for n, s in ((14, 1), (15, 1), (16, 3)) for c in itertools.combinations(range(n), s)]
    cases += [(n, tuple(rng.sample(range(n), s))) for n, s in ((18, 2), (20, 2), (20, 3), (20, 4), (25, 5), (30, 6)) for _ in range(150)]
    for n, c in cases:
        same = [k not in c for k in range(n)]
        want = any((m := sum(same[a:b])) >= 13 and m >= 4 * (b - a - m) for a in range(n) for b in range(a + 1, n + 1))
        item = [f"t{k}" for k in range(n)]
        leak = ["x"] * 5 + [w if ok else "other" for w, ok in zip(item, same)] + ["y"] * 3
        found = D._best(D.Block([(1, item)]), iter([" ".join(leak)]), 13)
        assert bool(found) == want, (n, c)
        for _, _, matches, length, at, item_at in found:
            run = [a == b for a, b in zip(leak[at : at + length], item[item_at : item_at + length], strict=True)]
            assert sum(run) == matches >= 13 and matches >= 4 * (length - matches) and run[0] and run[-1]


def test_leaks_odd_rows(spark):
    bench = spark.createDataFrame([(1, D.LONG if hasattr(D, "LONG") else "lorem ipsum dolor sit amet " * 4), (None, "lorem ipsum dolor sit amet " * 4), (2, None)], "item_id long, text string")
    got = D.contaminated(docs(spark, ODD), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(6, 1), (7, 1), (6, None), (7, None)}
    assert D.contaminated(docs(spark, []), bench).count() == 0 and D.contaminated(docs(spark, ODD), bench.limit(0)).count() == 0
    assert {r.doc_id for r in D.decontaminated(docs(spark, ODD), bench).collect()} == {1, 2, 3, 4, 5, None}


def test_the_join_gives_what_one_block_gives(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, " ".join(f"b{k}x{i}" for i in range(20))) for k in range(6)] + [(6, "too short"), (7, None), (None, "b0x1 " * 15), (9, " ".join(f"b{0}x{i}" for i in range(20)))]
    texts = [(k, items[k][1]) for k in range(6)] + [(20 + k, "x " * rng.randint(0, 9) + " ".join(w if rng.random() > 0.05 else "y" for w in items[k % 6][1].split())) for k in range(20)]
    texts += [(None, items[2][1]), (50, None), (51, "clean text " * 40), (3, items[3][1]), (60, "word " * 150_000 + items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    of = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    one, kept = of(D.contaminated(docs(spark, texts), bench)), of(D.decontaminated(docs(spark, texts), bench).drop("key", "blob"))
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    assert D.single_block(bench) is None
    assert of(D.contaminated(docs(spark, texts), bench)) == one and of(D.decontaminated(docs(spark, texts), bench).drop("key", "blob")) == kept
    assert len(one) > 20 and {r.item_id for r in D.short_items(bench).collect()} == {6, 7}


def test_hot_seeds_take_no_time():
    """Many equal and many periodic items against a text that repeats one phrase."""
    phrase = "lorem ipsum dolor sit amet consetetur"
    block = D.Block([(k, (phrase.split() * 6)) for k in range(200)] + [(200 + k, phrase.split() * 5 + [f"w{k}"] + phrase.split()) for k in range(20)])
    began = time.perf_counter()
    found = D._best(block, iter([" ".join([phrase] * 750)]), 13)
    assert time.perf_counter() - began < 1.5
    assert len(found) == 21 and (0, 0, 36, 36, 0, 0) in found
    began = time.perf_counter()
    assert len(D._best(D.Block([(k, phrase.split() * 6) for k in range(200)]), iter([" ".join([phrase] * 750)]), 13)) == 1
    assert time.perf_counter() - began < 0.5
    assert D._best(D.Block([]), iter(["a b c " * 1000]), 13) == [] == D._best(D.Block([(1, ["a"])]), iter(["a b c " * 1000]), 13)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<!-- ad --><div class="ad">Buy</div><article><h1>Head &amp; more</h1><p>One
two&nbsp;three <b>bold</b></p><p><b>open<br><p>last &lt;x&gt;</article><div id="comments"><p>first!</p></div><footer>&copy; x</footer></body></html>"""


def test_article():
    assert H.extract(PAGE) == "Head & more\nOne two three bold\nopen\nlast <x>"
    assert H.extract(None) == H.extract("") == H.extract("<html><body></body></html>") == ""
    assert H.extract("just text &amp; more") == "just text & more"
    assert H.extract("<main><header><h1>H</h1><span>by x</span></header><p>b</p><form>f</form><aside>s</aside></main><p>out</p>") == "H\nb"
    assert H.extract("<body><div class='content'><p>a</p></div><div class='cookie-notice'>c</div><div class=\"sidebar\">s</div></body>") == "a"
    assert H.extract("<ul><li>a<li>b <b>c</ul></i><p>d</p>") == "a\nb c\nd"
    assert H.extract("<article><p>a</p>" + "<div>" * 5000 + "deep") == "a\ndeep"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")


@pytest.mark.parametrize("limit", [50_000, 0])
def test_template_branches_go(spark, monkeypatch, limit):
    monkeypatch.setattr(H, "BROADCAST_NODES", limit)
    site = [(k, f"https://a.example/{k}", f"<html><body><div class='top'>Welcome to the site</div><div class='text'><p>own text {k}</p></div></body></html>") for k in range(12)]
    other = [(100, "https://b.example/1", site[0][2]), (101, None, site[1][2]), (102, "http://[bad", None), (None, "", "")]
    got = {r.page_id: r.text for r in H.extract_pages(pages(spark, site + other)).collect()}
    assert {got[k] for k in range(12)} == {f"own text {k}" for k in range(12)}
    assert got[100] == "Welcome to the site\nown text 0" and got[102] == got[None] == ""
    assert H.extract_pages(pages(spark, [])).count() == 0


def test_names_and_markup_that_once_lost_text():
    for page in (
        '<body><svg class="i"/><p>text</p>', '<article class="post comments-open"><p>text</p></article>', '<main class="with-sidebar"><p>text</p></main>',
        '<div class="no-sidebar content"><p>text</p></div>', '<p data-id="share">text</p>', '<p title=" class=ad">text</p>', '<div class="widget"><p>text</p></div>',
    ):
        assert H.extract(page) == "text", page
    assert H.extract("<body><div class='c'><p>The long main text of this page.</p></div><article><p>Teaser</p></article>") == "The long main text of this page.\nTeaser"
    assert H.extract("<article><header><h1>H</h1><p>Stand-first.</p></header><p>Let <math><mi>x</mi></math> be.</p></article>") == "H\nStand-first.\nLet x be."
    assert H.extract("<article><p>a</p></article><div class='reader-comments'><p>c</p></div><div class='cookie-notice open-now'>x</div>" ) == "a"


def test_a_very_long_page():
    paragraphs = [f"Paragraph {k} of a very long page &amp; more." for k in range(60_000)]
    page = "<body><nav>m</nav><div><div><div>" + "".join(f"<p>{x}" for x in paragraphs) + "</div></div></div><footer>f</footer>"
    assert H.extract(page) == "\n".join(paragraphs).replace("&amp;", "&")
    assert len(list(H.site_nodes(page))) == 6


def site_of(host, n, seed):
    """Pages without article elements: menu, notice and legal text are the template's, the rest is their own. (url, page, text)"""
    rng = random.Random(seed)
    words = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    menu, notice, legal = (words(k) for k in (8, 20, 15))
    out = []
    for k in range(n):
        own = [words(rng.randint(5, 40)) for _ in range(rng.randint(1, 6))]
        body = "".join(f"<p>{x}</p>" for x in own)
        page = f"<html><body><div class='m'><ul><li>{menu}</li><li>home</li></ul></div><div class='n'>{notice}</div><div class='t'>{body}<div class='u'>{legal}</div></div><div class='z'>{legal}</div></body></html>"
        out.append((f"https://{host}/{k}", page, "\n".join(own)))
    return out


def test_the_tree_alone_extracts_sites_without_names(spark, monkeypatch):
    monkeypatch.setattr(H, "NOISE", H.RAW)
    monkeypatch.setattr(H, "NOISE_WORDS", frozenset())
    sites = [p for k in range(4) for p in site_of(f"s{k}.example", 12, k)]
    cuts = {r.host: frozenset(r.cut) for r in H.low_importance(pages(spark, [(k, u, p) for k, (u, p, _) in enumerate(sites)])).collect()}
    assert [H.extract(p, cuts[H.host(u)]) for u, p, _ in sites] == [text for _, _, text in sites]


def test_tree_against_brute_force(spark):
    """Another tree: whole paths and texts as keys, entropies from lists."""
    rng = random.Random(11)
    rows = []
    for h in range(12):
        for u, p, _ in site_of(f"h{h}.example", rng.choice([1, 1, 2, 3, 6, 15]), rng.choice([1, 2, 3, h])):
            rows.append((len(rows), u, p))
    rows += [(900 + k, f"https://x{k}.example/", "<body><div class='b'>the same in all hosts</div><p>own %d</p></body>" % k) for k in range(9)]

    def text(n):
        parts = [text(c) if isinstance(c, H.Node) else " ".join(c.split()) for c in n.children]
        return "\x01".join(x for x in parts if x)

    seen = {}
    for _, u, p in rows:
        root = H.parse(p)
        whole, per_path = text(root), {}
        todo = [(root, ())]
        while todo:
            n, path = todo.pop()
            path = (*path, (n.tag, "".join("#" if c.isdigit() else c for c in n.names)))
            if n.tag in H.BLOCK and n.tag not in ("html", "body"):
                per_path.setdefault((path, n.path), []).append((tuple(c.tag for c in n.children if isinstance(c, H.Node)), text(n)))
            todo += [(c, path) for c in reversed(n.children) if isinstance(c, H.Node)]
        for key, elements in per_path.items():
            seen.setdefault(key, {}).setdefault(H.host(u), {})[whole] = ([e[0] for e in elements], [e[1] for e in elements])

    def entropy(values):
        values = list(map(repr, values))
        n = len(values)
        return 1.0 if n == 1 else -sum(values.count(v) / n * math.log(values.count(v) / n, n) for v in set(values))

    both = lambda looks: max(entropy([s for s, _ in looks]), entropy([c for _, c in looks]))
    want = {}
    for (_, node), hosts in seen.items():
        common = both([x for pages_ in hosts.values() for x in pages_.values()]) if len(hosts) >= 5 else 1.0
        for host, looks in hosts.items():
            m = len(looks)
            if (common if m == 1 else (m * both(list(looks.values())) + 2 * common) / (m + 2)) < 0.3 - 1e-9:
                want.setdefault(host, set()).add(node)
    got = {r.host: set(r.cut) for r in H.low_importance(pages(spark, rows)).collect()}
    assert got == want and len(want) > 10


def test_repeated_articles_stay(spark):
    same = [(k, f"https://c.example/{k}", PAGE) for k in range(20)]
    assert {(r.text, r.n_chars) for r in H.extract_pages(pages(spark, same)).collect()} == {(H.extract(PAGE), len(H.extract(PAGE)))}


def test_all_elements_of_a_path_are_judged_together(spark):
    rows = [(k, f"https://d.example/{k}", f"<body><div class='content'><p>By the staff</p><p>text {k}</p><p>more {k}</p></div></body>") for k in range(8)]
    wrapped = "<body><div id='wrap'><article><p>one</p></article></div></body>"
    rows += [(k, f"https://e.example/{k}", wrapped) for k in range(10, 18)]
    # the same article in pages that differ elsewhere, and one wrapper around different articles
    rows += [(k, f"https://f.example/{k}", f"<body><div class='x'>{k}</div><div id='wrap'><article><div class='body'><p>one</p></div></article></div></body>") for k in range(20, 28)]
    got = {r.page_id: r.text for r in H.extract_pages(pages(spark, rows)).collect()}
    assert all(got[k] == f"By the staff\ntext {k}\nmore {k}" for k in range(8))
    assert all(got[k] == "one" for k in (*range(10, 18), *range(20, 28)))


def test_template_branches_inside_articles_go(spark):
    rows = [(k, f"https://g.example/{k}", f"<body><article><p>own {k}</p><div class='box'>Read our other pages</div></article></body>") for k in range(8)]
    assert {r.page_id: r.text for r in H.extract_pages(pages(spark, rows)).collect()} == {k: f"own {k}" for k in range(8)}


def test_payloads_survive():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 6, 7, 100, 6 * 256 + 1):
        for payload in (rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes(), b"\0" * 64 * n, b"\xff" * 64 * n):
            file = jpeg.store(payload)
            d = jpeg.Decoder(file)
            assert jpeg.load(d) == payload and d.scans == 11
            assert d.rgb().shape == (d.height, d.width, 3)
    for bad in (b"", b"x" * 63):
        with pytest.raises(ValueError, match="multiple of 64"):
            jpeg.store(bad)


def test_fast_and_slow_decoding_agree(monkeypatch):
    file = jpeg.store(np.random.default_rng(2).integers(0, 256, 64 * 9, dtype=np.uint8).tobytes())
    fast = jpeg.Decoder(file)
    monkeypatch.setattr(jpeg, "_uniform", lambda *a: None)  # symbol by symbol
    slow = jpeg.Decoder(file)
    assert all((a.coef == b.coef).all() for a, b in zip(fast.components, slow.components))


def java_image(spark, pixels, grey, q):
    """A progressive file of the JVM's own encoder, and what its decoder makes of it."""
    j = spark._jvm
    h, w = pixels.shape[:2]
    image = j.java.awt.image.BufferedImage(w, h, 10 if grey else 1)
    raster = image.getRaster()
    for y in range(h):
        for x in range(w):
            if grey:
                raster.setSample(x, y, 0, int(pixels[y, x]))
            else:
                image.setRGB(x, y, int(pixels[y, x, 0]) << 16 | int(pixels[y, x, 1]) << 8 | int(pixels[y, x, 2]))
    writer = j.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    p = writer.getDefaultWriteParam()
    p.setProgressiveMode(1)
    p.setCompressionMode(2)
    p.setCompressionQuality(q)
    out = j.java.io.ByteArrayOutputStream()
    stream = j.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, j.javax.imageio.IIOImage(image, None, None), p)
    stream.flush()
    data = bytes(out.toByteArray())
    back = j.javax.imageio.ImageIO.read(j.java.io.ByteArrayInputStream(data))
    got = np.array([[back.getRaster().getSample(x, y, 0) if grey else back.getRGB(x, y) & 0xFFFFFF for x in range(w)] for y in range(h)])
    return data, got


@pytest.mark.parametrize("q", [0.3, 0.75, 0.97])
def test_foreign_progressive_files(spark, q):
    y, x = np.mgrid[0:29, 0:43]
    grey = ((np.sin(x / 3) + np.cos(y / 5)) * 60 + 128 + (x * y) % 7).astype(np.uint8)
    data, want = java_image(spark, grey, True, q)
    d = jpeg.Decoder(data)
    assert d.scans > 1 and np.abs(d.rgb()[:, :, 0].astype(int) - want).max() <= 1
    smooth = np.stack([x * 5, y * 8, 255 - x * 3], axis=2).clip(0, 255).astype(np.uint8)
    data, want = java_image(spark, smooth, False, q)
    got = jpeg.Decoder(data).rgb().astype(int)
    theirs = np.stack([want >> 16, want >> 8 & 255, want & 255], axis=2)
    assert np.abs(got - theirs).mean() < 6  # they smooth chroma, here samples are repeated


def test_media_rows(spark):
    got = media.round_trip(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    texts = dict(ODD)
    for r in got:
        n, payload = media.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    by = {r.doc_id: r for r in got}
    assert by[6].media_sha256 == by[7].media_sha256 and by[1].feature == by[2].feature
    assert media.round_trip(docs(spark, [])).count() == 0
    tensors = media.decode_rgb(media.encode_media(docs(spark, [(1, "abc"), (2, None)]))).collect()
    assert all(len(r.rgb) == r.width * r.height * 3 and r.error is None for r in tensors)
    junk = spark.createDataFrame([(1, bytearray(b"junk")), (2, None), (3, bytearray(b"\xff\xd8\xff\xc2\x00"))], "doc_id long, media binary")
    assert [(r.rgb, r.error is None) for r in media.decode_rgb(junk).orderBy("doc_id").collect()] == [(None, False), (None, True), (None, False)]


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")
def test_pipeline(spark):
    """Each stage against the operator on its input, and the whole against the stages."""
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = d.columns, [d.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(DATA))
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == columns
        d = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(d.count())
    assert sizes[0] > sizes[1] == sizes[2] >= sizes[3] > sizes[4] == sizes[5] > 0
    whole = corpus_pipeline.run(spark, str(DATA))
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, d.collect()), key=repr)


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns, and no rows at all go through every stage."""
    spark.createDataFrame([(3, 1, 0), (6, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "lorem ipsum dolor sit amet " * 4), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, h1 string, blob string, taken long"
    full = [(i, t, "en", None if k % 3 else "s", len(t or ""), "x", None, k) for k, (i, t) in enumerate(ODD)]
    for rows in (full, []):
        d = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, str(tmp_path))
            got = out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == d.columns
            assert len(got) <= len(rows), name
            if name == "near-duplicates":  # of equal texts the smallest id stays, and every row of it
                by = [r.doc_id for r in got]
                assert 7 not in by or 6 not in by
            d = spark.createDataFrame(got, out.schema)


def test_the_pipeline_keeps_what_a_plain_model_keeps(spark, tmp_path):
    """Line dedup, near copies and decontamination over clean documents, against sets and dictionaries."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, shared = prose(30), "This line of the licence stands in very many of the documents, word for word."
    texts = [prose(rng.randint(60, 120)) for _ in range(40)]
    texts += [t.replace(t.split()[20], "changed", 1) for t in texts[:6]] + [f"{prose(50)} {item} {prose(20)}" for _ in range(4)]
    texts = [f"{shared}\n{t}" if k % 4 == 0 else t for k, t in enumerate(texts)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    holders = [k for k, t in enumerate(texts) if t.startswith(shared)]
    model = {k: t.removeprefix(f"{shared}\n") if k != max(holders) else t for k, t in enumerate(texts)}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in model.items() for w in [t.lower().split()]}
    near = {k for k in model if any(5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j]) for j in range(k))}
    want = {k: t for k, t in model.items() if k not in near and item not in t}
    out = d.withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, out, str(tmp_path))
    assert {r.doc_id: r.text for r in out.collect()} == want and len(near) == 6 and len(want) == 40
