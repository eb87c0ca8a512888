"""Duplicates, joins, shards, archives, pages and the pipeline against brute force."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from roamer.llm import components, exact_dedup, html_text, jaccard, sharding, store, warc


def test_dedup_cases(odd):
    got = exact_dedup.mark_duplicates(odd).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1][0].kept and not by[2][0].kept and by[2][0].keep_id == 1 and by[2][0].group_size == 2
    assert sorted(r.kept for r in by[3]) == [False, True]
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert exact_dedup.mark_duplicates(odd.limit(0)).count() == 0 and exact_dedup.deduplicate(odd.limit(0)).count() == 0


def test_a_full_filter_changes_nothing(docs, monkeypatch):
    want = sorted(map(str, exact_dedup.mark_duplicates(docs).collect()))
    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "repeat_words", lambda n: 2)
        assert sorted(map(str, exact_dedup.mark_duplicates(docs).collect())) == want
    monkeypatch.setattr(exact_dedup, "repeat_parts", lambda n: 3)  # parts by hash, one filter after the other
    assert sorted(map(str, exact_dedup.mark_duplicates(docs).collect())) == want
    assert store.repeat_parts(0) == store.repeat_parts(1 << 30) == 1 and store.repeat_parts(10**10) == 10


def test_only_possibly_repeated_rows_are_compared(spark):
    rows = spark.range(20_000).selectExpr("id", "sha2(cast(if(id % 100 = 0, 7, id) as string), 256) AS digest")
    prints = store.written(rows, "test-prints")
    maybe = exact_dedup.possibly_repeated(prints, prints).where("maybe")
    assert maybe.where("id % 100 = 0 or id = 7").count() == 201 and 201 <= maybe.count() < 201 + 200
    # What pass 1 shuffles are words, a hot key's once a task.
    hot = store.written(spark.range(0, 100_000, 1, 4).selectExpr("'same' AS digest"), "test-hot")
    plan = store.repeat_filter(hot, "digest", store.repeat_words(100_000))[0]
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in text and text.index("partial_bit_or") > text.index("Exchange hashpartitioning(word")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 10, 150])
def test_shards(docs, n):
    got = sharding.shard(docs.limit(n)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == n and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_do_not_depend_on_the_layout(docs, odd):
    a = sorted(map(str, sharding.shard(docs).collect()))
    assert sorted(map(str, sharding.shard(docs.repartition(7)).collect())) == a
    assert sharding.shard(odd).count() == odd.count()


def brute_components(rows, k, num, den):
    sets = {}
    for d, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("k", "num", "den", "block", "hot"), [(3, 90, 100, 512, 128), (3, 90, 100, 8, 4), (5, 4, 5, 512, 8), (2, 1, 2, 2, 2), (2, 1, 2, 3, 1000)])
def test_join_equals_all_pairs(spark, docs, monkeypatch, k, num, den, block, hot):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # few: groups are dealt out as pairs of blocks
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    base = "one two three four five six seven eight nine ten " * 3
    rows += [(10_000 + i, base + " ".join(f"w{j}" for j in range(60) if j != i) + (" x" if i % 3 else "")) for i in range(40)]
    rows += [(11_000 + i, " ".join(f"v{j}" for j in range(i, i + 40))) for i in range(0, 60, 2)]  # a chain
    rows += [(20_001, None), (20_002, ""), (20_003, "a b"), (20_004, "A  B"), (20_005, "c")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()}
    assert got == brute_components(rows, k, num, den)


def test_documents_that_only_share_rare_shingles_form_no_group(spark, monkeypatch):
    rnd = random.Random(4)
    shared = [[f"s{i}_{j}" for j in range(12)] for i in range(60)]
    rows = [(i, " ".join(shared[i] + [f"w{rnd.randrange(10**9)}" for _ in range(150)] + shared[(i + 1) % 60])) for i in range(60)]
    rows.append((100, rows[7][1] + " more"))
    seen, blocks = [], jaccard._blocks
    monkeypatch.setattr(jaccard, "_blocks", lambda groups: seen.append(groups.count()) or blocks(groups))
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(60)} | {100: 7} and seen == [2]


def test_sketches_and_parts_of_lists_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for n in (1, 7, 100, 3000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        for cut in (0, 1, n // 20):
            b = np.concatenate([a[cut:], rng.integers(0, 2**63, n // 2).astype(np.uint64)[: cut * 2]])
            x, y = (np.frombuffer(jaccard.sketch(s, 90, 100), "<u8")[None, :] for s in (a, b))
            least = min(x.shape[1], y.shape[1])
            assert np.bitwise_count(jaccard.folded(x, least) ^ jaccard.folded(y, least)).sum() <= len(np.setxor1d(a, b))
    monkeypatch.setattr(jaccard, "PART", 2)
    monkeypatch.setattr(jaccard, "HOT", 1000)
    rows = [(i, " ".join(f"v{j}" for j in range(i, i + 60))) for i in range(0, 60, 2)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 3, 90, 100)


def test_lists_hand_on_fewer_links_than_documents():
    rng = np.random.default_rng(8)
    sets, cells = [], []
    for family in range(30):
        base = rng.integers(0, 2**63, 400).astype(np.uint64)
        for _ in range(rng.integers(1, 40)):
            sets.append(np.unique(np.concatenate([base[rng.integers(0, 30) :], rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)])))
            cells.append(family // 3)
    comp = [i if i % 4 else 0 for i in range(len(sets))]  # a known component: its members aren't compared with each other
    sketches = [jaccard.sketch(s, 90, 100) for s in sets]
    columns = {"num": pa.array(range(len(sets)), pa.int64()), "home": pa.array([i % 5 > 0 for i in range(len(sets))]), "part": pa.array([i % 2 for i in range(len(sets))], pa.int32()), "cross": pa.array([c % 2 == 0 for c in cells])}
    columns |= {"cell": pa.array(cells, pa.int64()), "n": pa.array(map(len, sets), pa.int64()), "sketch": pa.array(sketches, pa.binary()), "comp": pa.array(comp, pa.int64())}
    rows = pa.record_batch(columns)
    got = [(a, b) for batch in jaccard._near(90, 100)(iter([rows])) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]

    def roots(pairs):
        root = list(range(len(sets)))

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return [find(a) for a in range(len(sets))]

    want = []
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if cells[a] == cells[b] and comp[a] != comp[b] and (a % 5 or b % 5) and (cells[a] % 2 or a % 2 != b % 2):
                x, y = (np.frombuffer(sketches[i], "<u8")[None, :] for i in (a, b))
                least, (n, m) = min(x.shape[1], y.shape[1]), sorted((len(sets[a]), len(sets[b])))
                apart = int(np.bitwise_count(jaccard.folded(x, least) ^ jaccard.folded(y, least)).sum())
                if n * 100 >= m * 90 and apart * 190 <= (n + m) * 10:
                    want.append((a, b))
    assert roots(got) == roots(want) and len(want) > 2 * len(sets) > 2 * len(got) > 0


def test_ids_of_another_type_and_null_ids(spark):
    near = "a b c d e f g h i j k l m n o p q r s t"
    rows = [("x", near), ("m", near + " u"), (None, near + " v"), (None, "all alone here"), (None, "two of us"), (None, "two of us"), ("k", "other words entirely")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.join(df, 3, 4, 5).collect()), key=str)
    assert got == sorted([("x", "m"), ("m", "m"), (None, "m"), (None, None), (None, None), (None, None), ("k", "k")], key=str)
    assert sorted((r.doc_id for r in jaccard.representatives(df, 3, 4, 5).collect()), key=str) == sorted(["m", None, None, None, "k"], key=str)


def test_values_in_many_lists_are_merged_with_skips():
    rnd = random.Random(5)
    for _ in range(300):
        lists = [sorted(rnd.sample(range(60), rnd.randint(0, 30))) for _ in range(rnd.randint(0, 12))]
        times = Counter(v for m in lists for v in m)
        for least in (1, 2, 3, 6):
            assert list(jaccard.merge_skip(lists, least)) == sorted((v, n) for v, n in times.items() if n >= least)


def test_each_list_is_merged_or_probed():
    rnd = random.Random(6)
    sets = [np.unique(np.array(rnd.sample(range(400), 100) + rnd.sample(range(400, 420), 18), np.uint64)) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[:-3], np.array([1000 + i], np.uint64)])) for i, s in enumerate(sets[:20])]
    group = jaccard.Group(sets, 9, 10)
    for x, s in enumerate(sets):
        t = jaccard.required(len(s), 9, 10)
        short, long, least = group.divided(x)
        assert len(short) + len(long) == len(s) and least == t - len(long) >= 1
        assert len(long) == jaccard.long_lists(t, int(group.length[long].max())) and group.length[short].max() <= group.length[long].min()
        want = [y for y, o in enumerate(sets) if 10 * len(np.intersect1d(s, o)) >= 9 * len(np.union1d(s, o))]
        assert sorted(group.partners(x)) == want
    pairs = group.links()
    assert len(pairs) == 20 and {b % 60 if b >= 60 else b for _, b in pairs} == set(range(20))


def test_representatives(odd):
    kept = jaccard.representatives(odd, 3, 9, 10)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not {8, 9} & set(ids) and {1, 2, 3, None} <= set(ids)
    assert jaccard.join(odd.limit(0)).count() == 0


def test_components(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 70)] + [(200 + i, 200) for i in range(1, 30)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {**{i: 0 for i in range(41)}, 50: 50, 70: 50, 100: 50, **{200 + i: 200 for i in range(30)}}
    assert {r.node: r.root for r in components.components(df).collect()} == want
    monkeypatch.setattr(components, "SMALL", 0)
    assert {r.node: r.root for r in components.components(df).collect()} == want
    assert components.components(df.limit(0)).count() == 0


def test_membership_filter(spark):
    from pyspark.sql import functions as F

    keys = store.written(spark.range(1000).selectExpr("id AS key"), "test-keys")
    seen = store.filtered(spark.range(5000), F.col("id"), keys, "key", "hit")
    assert seen.where("hit and id < 1000").count() == 1000 and seen.where("hit").count() < 1100
    store.dropped(keys)
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(keys.cut_point).count()


def test_a_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    with pytest.raises(ValueError, match="checkpoint"):
        store.shared_dir(type("S", (), {"conf": Conf()})())


def brute_captures(rows, least=0):
    """page_id, size, digest, type and refers_to of each row, sorted."""
    out, groups = [], defaultdict(list)
    for i, u, h in rows:
        groups[h or ""].append((i, u or ""))
    for h, members in groups.items():
        data = h.encode()
        last = max(members, key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        rest = sorted(members, key=lambda m: m == last)
        rest.pop()
        apart = len(data) < least
        out += [(last[0], len(data), sha, "response", None)] + [(i, len(data), sha, "response" if apart else "revisit", None if apart else last[0]) for i, _ in rest]
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1, 5])
def test_archives(spark, least):
    rows = [(1, "http://a/b", "x\r\n\r\nWARC/1.1\r\nfoo"), (2, None, None), (3, "u", ""), (4, "http://h/?q#f", "é🙂"), (5, "http://h", "é🙂"), (5, "http://h", "é🙂"), (5, "http://g", "é🙂"), (6, "http://h", "\n\n")]
    rows += [(7, "http://h/\r\n\r\nX-Injected: 1", "ctl"), (8, " \t", "ctl"), (None, "n", "lone"), (None, "n", "two"), (9, "m", "two")]
    rows += [(100 + i, f"http://hot/{i}", "the same page") for i in range(300)] + [(500 + i // 2, "http://twice/", f"page {i // 2}") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    whole = store.written(warc.round_trip(df, least=least), "test-captures")
    assert sorted(map(tuple, warc.summary(whole).collect()), key=str) == brute_captures(rows, least)
    got = whole.collect()
    assert sorted(r.url for r in got) == sorted(u or "" for _, u, _ in rows) and len({r.capture_id for r in got}) == len(rows)
    assert all(r.request and r.metadata and not re.search(r"[\x00-\x20\x7f]", r.uri) for r in got)
    sent = defaultdict(set)
    for r in got:
        if r.answer.type == "response":
            sent[bytes(r.answer.payload).decode()].add(r.capture_id)
    assert set(sent) == {h or "" for _, _, h in rows}
    assert all(r.answer.refers_to in {c for s in sent.values() for c in s} for r in got if r.answer.type == "revisit")
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archives_of_string_ids_and_records_on_their_own(spark):
    df = spark.createDataFrame([("b", "u", "x"), ("a", "u", "x")], "page_id string, url string, html string")
    assert sorted(tuple(r)[::3] for r in warc.summary(warc.round_trip(df), kind="string").collect()) == [("a", "revisit"), ("b", "response")]
    some = spark.createDataFrame([("response", "<1>", None), ("request", "<2>", "<0>"), ("response", "<3>", None), ("request", "<4>", "<3>")], "type string, id string, concurrent_to string")
    empty = spark.createDataFrame([], warc.RECORD)
    got = {r.capture_id: (r.request and r.request.id, r.metadata) for r in warc.assemble(empty.unionByName(some, allowMissingColumns=True)).collect()}
    assert got == {"<1>": (None, None), "<3>": ("<4>", None)}


def test_archive_parser_reads_gzip_members_and_plain_files():
    import gzip

    rec = lambda t, i, b: f"WARC/1.1\r\nWARC-Type: {t}\r\nWARC-Record-ID: {i}\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n"
    a, b = rec("response", "<a>", b"payload"), rec("warcinfo", "<b>", b"")
    for data in (a + b, gzip.compress(a) + gzip.compress(b)):
        assert [(r["type"], r["payload"]) for r in warc.parse(data)] == [("response", b"payload"), ("warcinfo", None)]
    for broken in (a[:-8], a.replace(b"Content-Length", b"Length"), b"junk" + a):
        with pytest.raises(ValueError, match="record"):
            list(warc.parse(broken))


def test_pages_equal_their_articles(spark, sf):
    import html

    def expected(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        return "\n".join(b for b in blocks if b)

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: expected(r.html) for r in pages.collect()}
    assert {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()} == {k: (v, len(v)) for k, v in want.items()}


def test_page_cases():
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><div class="wrap"><div class="sidebar"><p>side</p></div><div class="post-content"><h2>Title &amp; more</h2>
    <p>One <b>two</b><br>three</p><div>loose <span>inline</span></div><ul><li>a<li>b</ul><div class="ad-slot">buy</div><form><p>mail</p></form></div><section id="comments"><article class="comment"><p>troll</p></article></section></div><footer>f</footer></body>"""
    assert html_text.main_text(page, set()) == "Title & more\nOne two three\nloose inline\na\nb"
    assert html_text.main_text(None, set()) == html_text.main_text("", set()) == ""
    assert html_text.main_text("plain &lt; text <p>p1<p>p2<script>x<y", set()) == "plain < text\np1\np2"


def test_whole_names_regions_and_formulas():
    story = "<p>A story that goes on for a good while, line by line.</p>"
    inside = '<article><h1>T</h1><section id="related-work"><p>Older work.</p></section><div class="form-factor"><p>Small.</p></div><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>.</p>{}</article>'
    gone = '<div class="comments"><p>First!</p></div><div class="ad-slot">Buy</div><aside>a</aside><div id="comment-list"><ul><li>me too</li></ul></div><div class="cookie-notice">c</div><div class="siteFooter">f</div>'
    for more in ("", gone):
        assert html_text.main_text(f"<body>{inside.format(more)}</body>", set()) == "T\nOlder work.\nSmall.\nSo x=2."
    assert html_text.main_text(f"<body><main><h1>Head</h1>{story}<article><h3>card one</h3></article></main></body>", set()) == "Head\nA story that goes on for a good while, line by line."
    teaser = '<article class="card"><a href="/x"><h3>Another story</h3></a></article>'
    assert html_text.main_text(f"<body><article>{story}</article>{teaser * 3}</body>", set()) == "A story that goes on for a good while, line by line."
    assert html_text.main_text("<body><main><article><p>one two</p></article><article><p>three four</p></article></main></body>", set()) == "one two\nthree four"
    assert html_text.main_text('<body><article><div class="article-header"><h1>Title</h1></div><p>x</p></article></body>', set()) == "Title\nx"


def test_templates_equal_counting_by_hand(spark):
    rnd = random.Random(4)
    parts = ["<div class='x{0}'><p>Welcome to part {0}</p></div>", "<ul><li>Menu {0}</li><li>Home</li></ul>", "<div><span>Shop {0}</span> <a>Top</a></div>", "<p>Notice {0}</p>"]
    rows = []
    for host, size in (("hot", 150), ("mid", 20), ("few", 4), ("one", 1)):
        for i in range(size):
            own = [rnd.choice(parts).format(rnd.randrange(8)) for _ in range(rnd.randrange(4))] + [f"<p>Own text {host} {i}</p>"]
            rnd.shuffle(own)
            rows.append((len(rows), f"https://user@{host.upper()}:80/{i}", "<body>" + "".join(own) + "</body>"))
    rows += [(5000 + i, "http://mid/", rows[150][2]) for i in range(50)]  # copies count once
    held = defaultdict(lambda: defaultdict(set))
    for _, u, h in rows:
        name = re.search(r"//(?:user@)?([A-Za-z]+)", u)[1].lower()
        for key, shown in html_text.subtrees(h).items():
            held[name][key].add((h, shown))
    want = {}
    for i, u, h in rows:
        name = re.search(r"//(?:user@)?([A-Za-z]+)", u)[1].lower()
        want[i] = html_text.main_text(h, {k for k, pages in held[name].items() if len({x for x, _ in pages}) >= html_text.PAGES and any(s for _, s in pages)})
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want and any("Welcome" in t for t in got.values()) and got[3].startswith("Own text") and "Menu" not in got[3]


def test_templates_of_a_host_go(spark):
    def page(i):
        return f"<body><div><span>Our shop</span></div><div><p>Text {i} of its own, long enough to tell.</p></div><div><a>Top</a> <a>Home</a></div></body>"

    rows = [(i, "http://h/x", page(i)) for i in range(20)] + [(100 + i, f"http://other{i}/", page(500 + i)) for i in range(3)]
    rows += [(200, None, None), (201, "http://h/y", ""), (202, "http://copy/", page(7)), (202, "http://copy/", page(7))]
    got = [(r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    text = dict(got)
    assert len(got) == len(rows) and text[3] == "Text 3 of its own, long enough to tell."
    assert text[101].startswith("Our shop\nText 501") and text[200] == text[201] == "" and text[202].startswith("Our shop")
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, sf, docs):
    whole = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = store.written(stage(spark, kept, sf), "test-stage")
        assert kept.columns == docs.columns, name
    left = {r.doc_id for r in kept.collect()}
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", whole[d]) for d in left]
    assert len(texts) == len(set(texts)) and left <= set(whole)
    joined = brute_components([(d, whole[d]) for d in left], 5, 4, 5)
    assert all(c == d for d, (_, c) in joined.items())
    out = corpus_pipeline.run(spark, sf)
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == left and all(got[d].decoded_sha256 == hashlib.sha256(whole[d].encode()).hexdigest() and len(got[d].ids) == got[d].n_tokens for d in left)


def test_pipeline_of_odd_and_empty_tables(spark, sf, odd, tmp_path):
    for name, table in (("odd", odd), ("empty", odd.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        items = spark.read.parquet(f"{sf}/benchmark.parquet")
        (items if name == "odd" else items.limit(0)).write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()]
    assert sorted(got, key=str) == sorted([3, 4, 5, 6, 7, None], key=str)  # the words of 8 and 9 are those of 3
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_templates_of_any_kind_and_share_go(spark):
    def main(i):
        return f'<body><main><div class="x1"><p>Site notice</p></div><p>Own text {i}.</p></main></body>'

    def bare(i):
        return f'<body><p>Welcome to us</p><a>Top</a><span>Menu</span><p>Own text {i} with an <a>Top</a> in it.</p><table><tr><td>Red</td><td>{i}</td></tr></table><ul><li>Login<li>Item {i}</ul></body>'

    def rare(i):  # five of two hundred pages of a host
        return f"<body><p>Own text {i}.</p>" + ("<div>Section links</div>" if i < 5 else "") + "</body>"

    def article(i):
        return f'<body><article><p>A passage that recurs</p><section id="related-work"><h2>Related work</h2><p>Own text {i}.</p></section><ul><li>Salt<li>Item {i}</ul></article></body>'

    rows = [(n * 1000 + i, f"http://h{n}/{i}", f(i)) for n, (f, size) in enumerate(((main, 8), (bare, 8), (rare, 200), (article, 8))) for i in range(size)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own text 3."
    assert got[1003] == "Own text 3 with an Top in it.\nRed\n3\nItem 3"
    assert got[2003] == "Own text 3."
    assert got[3003] == "A passage that recurs\nRelated work\nOwn text 3.\nSalt\nItem 3"
