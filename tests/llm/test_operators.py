"""The training-data operators on small tables: nulls, empties, ties, repeated rows, clashing columns, brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from umbra.llm import common, merge_dropout, token_counts
from umbra.llm.common import shared_dir
from umbra.llm.components import connected_components
from umbra.llm.exact_dedup import build_index, digests, drop_exact_copies, exact_dedup, update_index
from umbra.llm.html_extract import extract_pages
from umbra.llm.near_dedup import drop_near_copies, near_dedup
from umbra.llm.packing import pack_documents
from umbra.llm.quality_rules import judge_documents, keep_good_documents
from umbra.llm.sharding import shard_by_bytes
from umbra.llm.url_filters import filter_urls
from umbra.llm.warc import build_derivatives, response_records

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, uid long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), False, 5) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(60):
        rows.append((i, " ".join(word() for _ in range(rng.randint(40, 160))), f"s{i % 3}"))
    for i in range(60, 130):  # chains: each a few words off the one before
        base = rows[rng.randrange(40) if i < 75 else i - 1][1].split()
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = word()
        rows.append((i, " ".join(base), "s0"))
    rows += [(130, None, None), (131, "", "s0"), (132, "a b", "s1"), (133, "A  b", "s1"), (134, "x " * 30_000, "s1"), (135, rows[3][1].upper(), "s0")]
    rng.shuffle(rows)
    return rows


def linked(rows, k, percent):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_exact_dedup(spark, corpus):
    lower = lambda t: (t or "").encode().lower()
    groups = defaultdict(list)
    for i, t, _ in corpus:
        groups[lower(t)].append(i)
    got = {r.doc_id: r for r in exact_dedup(table(spark, corpus)).collect()}
    for i, t, _ in corpus:
        own = groups[lower(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(own), len(own), i == max(own), hashlib.sha256(lower(t)).hexdigest())


def test_exact_dedup_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a", "s"), (1, "a", "s"), (None, "A", "s"), (None, "z", "s"), (2, None, "s"), (3, "", "s")]
    got = exact_dedup(table(spark, rows)).collect()
    assert sorted((r.keep_id if r.keep_id is not None else -1, r.group_size) for r in got) == [(-1, 1), (1, 3), (1, 3), (1, 3), (3, 2), (3, 2)]
    assert sum(r.kept for r in got) == 3
    kept = drop_exact_copies(table(spark, rows))
    assert kept.columns == table(spark, rows).columns and kept.count() == 3
    assert exact_dedup(table(spark, [])).count() == 0


def test_index_inserts_and_deletes(spark):
    rows = digests(table(spark, [(1, "a", "s"), (2, "a", "s"), (3, "b", "s")]))
    index = build_index(rows)
    state = lambda df: sorted((r.n, r.keep_id) for r in df.collect())
    assert state(index) == [(1, 3), (2, 2)]
    more = digests(table(spark, [(4, "c", "s"), (5, "A", "s")]))
    after, content = update_index(index, rows, inserts=more, deletes=digests(table(spark, [(3, "b", "s"), (9, "never", "s")])))
    assert state(after) == [(1, 4), (3, 5)]
    # The row that stays goes: the next largest id names the group.
    after, content = update_index(after, content, deletes=digests(table(spark, [(5, "A", "s")])))
    assert state(after) == [(1, 4), (2, 2)]
    after, content = update_index(after, content, deletes=digests(table(spark, [(1, "a", "s"), (2, "a", "s"), (2, "a", "s")])))
    assert state(after) == [(1, 4)] and content.count() == 1
    after, content = update_index(after, content, deletes=digests(table(spark, [(None, "c", "s"), (4, "d", "s")])))
    assert state(after) == [(1, 4)]
    after, content = update_index(after, content, inserts=digests(table(spark, [])), deletes=digests(table(spark, [(4, "C", "s")])))
    assert state(after) == [] and content.count() == 0
    assert state(update_index(after, content, inserts=rows)[0]) == [(1, 3), (2, 2)]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_dedup_against_brute_force(spark, corpus, k, percent):
    want = linked(corpus, k, percent)
    got = {r.doc_id: r for r in near_dedup(table(spark, corpus), k=k, percent=percent).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_dedup_of_a_large_family_just_below_the_limit(spark):
    """2,000 variants of one text, most pairs at 70 to 90 %: every link counts, and few pairs are compared at the end."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(2000):
        words = list(base)
        for j in range(rng.randint(0, 6)):
            words[rng.randrange(150)] = f"x{i}y{j}"
        rows.append((i, " ".join(words), "s"))
    df = table(spark, rows).repartition(8)
    sets = [frozenset(hash(tuple(t.split()[j : j + 3])) for j in range(148)) for _, t, _ in rows]
    up = list(range(2000))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(2000):
        for b in range(a):
            x, y = top(a), top(b)
            if x != y and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_dedup(df, k=3, percent=85).collect()}
    assert got == {i: top(i) for i in range(2000)}


def test_names_of_columns_may_clash(spark, corpus):
    docs = table(spark, corpus).selectExpr("*", "'keepme' AS __uid", "'gone' AS __GONE", "'k' AS __kept", "'d' AS __doc", "'t' AS touched")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.select("__uid", "__GONE", "__kept", "__doc", "touched").collect()} == {("keepme", "gone", "k", "d", "t")}, name


def test_ids_other_than_whole_numbers_are_refused(spark):
    docs = spark.createDataFrame([("a", "text", "s")], "doc_id string, text string, source string")
    for refuses in (near_dedup, exact_dedup, drop_near_copies, drop_exact_copies, judge_documents):
        with pytest.raises(TypeError, match="whole numbers"):
            refuses(docs)


@pytest.mark.parametrize("most", [1 << 28, 1 << 15, 64])
def test_parting_by_ids_loses_and_doubles_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BITS", most)
    monkeypatch.setattr(common, "_MAP", min(most, 32_768))
    df = spark.range(-3000, 3000).selectExpr("id", "id AS bucket", "'x' AS bitmap").unionAll(spark.createDataFrame([(None, 1, "x")], "id long, bucket long, bitmap string"))
    for ids in (set(), {5}, set(range(0, 3000, 7)), set(range(-3000, 3000))):
        held = common.materialise(spark.createDataFrame([(i,) for i in ids], "id long"), "test")
        maybe, no = common.split_by_ids(df, "id", held)
        parts = [[r.id for r in x.collect()] for x in (maybe, no) if x is not None]
        assert sorted(str(x) for p in parts for x in p) == sorted(str(r.id) for r in df.collect())
        assert ids <= set(parts[0]) and (no is None) == (2 * len(ids) > max(min(most, 32_768), min(most, 1 << (16 * len(ids)).bit_length())))
        assert no is None or len(parts[0]) <= len(ids) * 1.2 + 200 * (most < 1 << 20) * len(ids)
        assert sorted(str(r.id) for r in common.without_ids(df, "id", held).collect()) == sorted(str(i) for i in [None, *range(-3000, 3000)] if i not in ids)
        assert common.without_ids(df, "id", held).columns == df.columns


def test_shared_folder_is_never_this_machine_on_a_cluster(spark):
    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://head:7077"

            @staticmethod
            def getConf():
                return {}

        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Elsewhere)
    assert shared_dir(spark)


def test_near_dedup_repeated_rows_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(50))
    got = near_dedup(table(spark, [(1, text, "s"), (1, text, "s"), (None, text, "s"), (None, None, "s")])).collect()
    assert sum(r.kept for r in got) == 2 and [r.component_id for r in got if r.n_shingles] == [1, 1, 1]
    assert near_dedup(table(spark, [])).count() == 0
    assert drop_near_copies(table(spark, [(1, text, "s"), (2, text + " more", "s")])).collect()[0].doc_id == 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 140)}


def test_sharding(spark, corpus):
    got = shard_by_bytes(table(spark, corpus), 4).orderBy("doc_id").collect()
    size = {i: len((t or "").encode()) + 1 for i, t, _ in corpus}
    total, at, slots = sum(size.values()), 0, Counter()
    for r in got:
        assert (r.size, r.shard) == (size[r.doc_id], min(3, (2 * at + r.size) * 4 // (2 * total)))
        assert r.slot == slots[r.shard] and r.law == "bytes" and r.grown_shard is None
        slots[r.shard] += 1
        at += r.size
    assert shard_by_bytes(table(spark, [])).count() == 0
    assert sorted(r.slot for r in shard_by_bytes(table(spark, [(1, "a", "s")] * 3 + [(None, None, "s")]), 1).collect()) == [0, 1, 2, 3]


def test_packing_loses_no_token(spark, corpus):
    rows = pack_documents(table(spark, corpus), capacities=(512, 1024, 4096)).collect()
    parts = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        parts[r.doc_id].append((r.start, r.length))
        bins[r.block, r.part, r.bin].append((r["at"], r.length, r.capacity))
    for i, t, _ in corpus:
        at = 0
        for start, length in sorted(parts[i]):
            assert start == at
            at += length
        assert at == len((t or "").encode()) + 1
    for items in bins.values():
        at = 0
        for start, length, capacity in sorted(items):
            assert start == at and capacity == items[0][2]
            at += length
        assert at <= capacity and all(c < at for c in (512, 1024, 4096) if c < capacity)
    assert pack_documents(table(spark, [])).count() == 0


def test_token_histogram(spark, corpus):
    n = {r.doc_id: r.n_tokens for r in token_counts.token_lengths(table(spark, corpus)).collect()}
    assert n[130] == n[131] == 0 and len(n) == len(corpus)
    hist = token_counts.length_histogram(token_counts.token_lengths(table(spark, corpus)))
    lengths = sorted(n.values())
    for r in hist.collect():
        assert (r.n_docs, r.n_docs_le, r.total_tokens) == (lengths.count(r.length), sum(x <= r.length for x in lengths), sum(lengths))
        assert r.truncated_total == sum(min(x, r.length) for x in lengths) and r.tokens_gt == sum(x for x in lengths if x > r.length)
    assert token_counts.truncated_total(hist, 77) == sum(min(x, 77) for x in lengths)
    assert token_counts.length_quantile(hist, 0.5) == lengths[(len(lengths) + 1) // 2 - 1]


def test_merge_dropout_round_trip(spark, corpus):
    df = table(spark, corpus)
    ids = merge_dropout.encode(df, rate=0.2, seed=5)
    back = {r.doc_id: r.text for r in merge_dropout.decode(ids).collect()}
    assert back == {i: t or "" for i, t, _ in corpus}
    assert merge_dropout.encode_and_check(df).where("not lossless").count() == 0


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.net/x?q=1#f", link.format("http://b.com/de/1")),
        (2, "http://b.com/de/1", None),
        (3, "https://C.org/p", link.format("http://a.net/x")),
        (4, "http://d.net/", '<meta http-equiv="refresh" content="0; url=/e">'),
        (5, "http://d.net/e", ""),
        (6, "http://sub.example.org/en/15", ""),
        (7, "http://notexample.org/es/1", ""),
        (8, None, "x"),
        (9, "no scheme", "x"),
        (10, "http://z.net/q", ""),
        (2, "http://b.com/de/1", None),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, rule string, verdict string")
    got = {r.page_id: r for r in filter_urls(df).collect()}
    assert filter_urls(df).count() == len(rows)
    assert {i: (r.rule, r.verdict) for i, r in got.items()} == {
        1: (None, "block"), 2: ("com/de/", "block"), 3: ("org/", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("example.org/en/1", "block"), 7: ("org/", "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"),
    }
    assert (got[3].host, got[3].path, got[8].host, got[9].path) == ("c.org", "/p", "", "")
    logged = spark.createDataFrame([("http://z.net/q", "http://b.com/de/9")], "u string, v string")
    assert {r.page_id: r.verdict for r in filter_urls(df, redirects=logged).collect()}[10] == "block"


def test_url_aliases_tell_queries_apart(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [(1, "http://f.net/view?id=1", link.format("http://b.com/de/1?x=y")), (2, "http://F.net/view?id=2#top", ""), (3, "http://f.net/view", ""), (4, "http://g.net/?a", link.format("/view?id=1")), (5, "http://g.net/view?id=1", link.format("//f.net/view?id=1")), (6, "http://f.net/view?id=6", link.format("?id=1"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in filter_urls(df).collect()} == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block"}
    logged = spark.createDataFrame([("http://f.net/view?id=2", "http://b.com/de/9#z")], "u string, v string")
    assert {r.page_id: r.verdict for r in filter_urls(df, redirects=logged).collect()} == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "block"}


def test_url_components_against_brute_force_and_sql(spark, tmp_path):
    """Chains, stars, cycles and 10,000 random edges; rules inside components; queries; links that hold URLs; markup that is none."""
    import duckdb

    from umbra.llm.sql import OP8

    rng = random.Random(6)
    url = lambda i: f"http://h{i % 50}.net/p{i // 50}?q={i}"
    link = '<link rel="canonical" href="{}">'
    rows = [(i, url(i), link.format(url(i + 1)) if i % 40 else "") for i in range(400)]  # chains
    rows += [(i, url(i), link.format(url(400))) for i in range(401, 600)]  # a star
    rows += [(600 + i, url(600 + i), link.format(url(600 + (i + 1) % 30))) for i in range(30)]  # a cycle
    rows += [(700, "http://x.com/de/1", link.format(url(17))), (701, "http://y.org/a", link.format("http://z.com/de/2")), (702, "http://y.net/b", link.format("http://y.org/a")), (703, "http://a.com/fr/1", link.format(url(405)))]
    rows += [(710, "http://c.net/p", link.format("/go?u=http://b.com/de/7")), (711, "http://c.net/q", f"<!-- {link.format('http://b.com/de/7')} -->"), (712, "http://c.net/r", f"<script>{link.format('http://b.com/de/7')}</script>")]
    rows += [(713, "http://c.net/s", link.format("mailto:x@b.com/de/7")), (714, "http://c.net/t", link.format("#http://b.com/de/7")), (715, "http://c.net/u", link.format("//b.com/de/7#x"))]
    rows += [(716, "http://c.net/v", "<link " * 20_000 + "canonical"), (717, "http://b.com/de/7", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in filter_urls(df).collect()}
    assert {i for i, v in got.items() if v == "block" and i < 700} == set(range(1, 41)), "the chain of the page that a block rule names"
    assert {i: got[i] for i in range(700, 718)if i in got} == {700: "block", 701: "allow", 702: "block", 703: "allow", 710: "allow", 711: "allow", 712: "allow", 713: "allow", 714: "allow", 715: "block", 716: "allow", 717: "block"}
    con = duckdb.connect()
    con.execute("create table pages as select unnest($1) as page_id, unnest($2) as url, unnest($3) as html", [[list(x) for x in zip(*rows)][i] for i in range(3)])
    assert dict(con.execute(f"select page_id, verdict from ({OP8})").fetchall()) == got

    nodes = [f"http://n{rng.randrange(9000)}.net/{rng.randrange(2)}" for _ in range(8000)] + [f"http://n.com/de/{i}" for i in range(40)] + [f"http://n.org/{i}" for i in range(40)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(10_000)]
    up = {n: n for n in nodes}

    def top(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in edges:
        up[top(a)] = top(b)
    bad = {top(n) for n in nodes if "/de/" in n}
    seen = {n for e in edges for n in e}
    want = {n: "allow" if ".org/" in n else "block" if "/de/" in n or (n in seen and top(n) in bad) else "allow" for n in nodes}
    df = spark.createDataFrame([(i, n, None) for i, n in enumerate(nodes)], "page_id long, url string, html string")
    got = filter_urls(df, redirects=spark.createDataFrame(edges, "u string, v string")).select("page_id", "verdict").collect()
    assert {nodes[r.page_id]: r.verdict for r in got} == want and "block" in {v for n, v in want.items() if ".net/" in n}


def brute_stats(t):
    w = [x for x in (t or "").replace("\x1c", "\x1c").encode().split()]
    w = [x.decode() for x in w]
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + d for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, corpus):
    letters = lambda n: "".join(chr(97 + int(d)) for d in str(n))  # noqa: E731  runs of digits count as one in lines
    clean = lambda i: "\n".join(" ".join(f"w{letters(i)}x{letters(j)}y{letters(k)}" for k in range(12)) for j in range(8))
    menu = "home about contact us today for all of our offers and news\n"
    rows = list(corpus) + [(200 + i, menu + clean(i), "site") for i in range(60)]
    rows += [(300, menu * 9, "site"), (301, (menu + "tail one two\n") * 3 + "e f g h " * 2, "site"), (400, "é # ü * a\n\x0b b\x1cc $", "site"), (200, menu + clean(0), "site")]
    got = defaultdict(list)
    for r in judge_documents(table(spark, rows)).collect():
        got[r.doc_id].append(r)
    for i, t, _ in rows:
        r = got[i][0]
        want = brute_stats(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert len(got[200]) == 2 and all(got[200 + i][0].kept and got[200 + i][0].n_line_words_removed == 12 for i in range(60))
    assert judge_documents(table(spark, [])).count() == 0
    depleted = [(500 + i, (menu + "other line of the same page with many more words in it for all\n") + " ".join(f"q{i}z{j}" for j in range(20)) + "\nlast common line " + "word and more " * 5, "deep") for i in range(40)]
    assert not any(r.kept for r in judge_documents(table(spark, depleted)).collect())
    good = keep_good_documents(table(spark, rows))
    assert good.columns == table(spark, rows).columns and good.where("doc_id >= 200 and doc_id < 260").count() == 61


def test_quality_stage_removes_frequent_lines(spark):
    body = lambda i: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(60))
    rows = [(i, f"Home  About 2024\n\n{body(i)}\nhome about {i}", "site") for i in range(60)]
    rows += [(100, f"home about 1\n{body(70)}", "other"), (101, body(71), "site"), (102, None, "site")]
    got = {r.doc_id: r for r in keep_good_documents(table(spark, rows)).collect()}
    assert set(got) == set(range(60)) | {100, 101}
    for i in range(60):
        assert (got[i].text, got[i].n_chars) == (f"\n{body(i)}", len(body(i)) + 1)
    assert got[100].text == f"home about 1\n{body(70)}" and got[101].text == body(71) and got[101].n_chars == len(body(71))


def test_quality_rejects_documents_of_which_too_little_is_left(spark):
    body = lambda i, n: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(n))
    menu = "one menu line of this host with ten words in\n"
    rows = [(i, menu + body(i, 60), "site") for i in range(25)] + [(100, menu + body(100, 45), "site"), (101, menu + body(101, 50), "site")]
    rows += [(200 + i, body(150, 60) + "\nsame text many times", "other") for i in range(30)]
    got = {r.doc_id: r for r in judge_documents(table(spark, rows)).collect()}
    assert (got[100].base_failed, got[100].kept, got[100].n_words_left) == (False, False, 45) and got[101].kept and got[101].n_words_left == 50
    line = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    assert got[0].lines_left_digest == line(body(0, 60)) and got[0].n_line_words_removed == 10
    # Copies of a text are one document, or, if asked for, as many as there are.
    assert all(got[200 + i].kept for i in range(30))
    assert not any(r.kept for r in judge_documents(table(spark, rows), count_copies=True).collect() if r.doc_id >= 200)


def test_quality_stage_catches_lines_of_a_large_host(spark):
    body = lambda i: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(60))
    rows = [(i, body(i) + "\nall rights reserved" * (i < 25), "hot") for i in range(400)]
    assert {r.text for r in keep_good_documents(table(spark, rows)).collect()} == {body(i) for i in range(400)}


def test_pages_and_warc(spark):
    rows = [(1, "http://a/", "<article><p>One, two.</p><p>x</p></article><footer>f</footer>"), (2, None, None), (1, "http://a/", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract_pages(df).collect())
    assert got == [(1, "", 0), (1, "One, two.\n\nx", 12), (2, "", 0)]
    made = build_derivatives(response_records(df)).collect()
    assert Counter(r.warc_type for r in made) == {"metadata": 3, "conversion": 3}
    assert all(r.refers_to.startswith("<urn:uuid:") and r.content_length >= 0 for r in made)


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 120)))
    rows = [(i, text(), "s") for i in range(30)]
    rows += [(30, rows[2][1].upper(), "s"), (31, rows[3][1] + " extra", "s"), (32, "too short", "s"), (33, None, "s")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Short and empty ones fail, of exact copies the largest id stays, of near copies the smallest.
    assert {r.doc_id for r in got} == (set(range(31)) - {2})
    sizes = {i: len(t.encode()) + 1 for i, t, _ in rows if t}
    assert {r.doc_id: r.length for r in got} == {i: sizes[i] for i in set(range(31)) - {2}}


LONG_TEXT = "one two three, four five. " * 40_000
EDGES = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, None), (3, "", "s"), (None, "a B c", "s"), (4, LONG_TEXT, "s"), (5, " \n\t", "s"), (6, "x" * 300_000, "s"), (7, "tie", "s"), (8, "tie", "t")]
ON_DOCUMENTS = {
    "op1": lambda d: exact_dedup(d),
    "op2": lambda d: pack_documents(d).dropDuplicates(["block", "part", "bin", "at"]).where("start = 0"),
    "op3": lambda d: merge_dropout.encode_and_check(d),
    "op4": lambda d: near_dedup(d),
    "op6": lambda d: shard_by_bytes(d, 3),
    "op7": lambda d: token_counts.token_lengths(d),
    "op9": lambda d: judge_documents(d),
}
ON_PAGES = {"op5": lambda d: build_derivatives(response_records(d)).where("warc_type = 'conversion'"), "op8": lambda d: filter_urls(d), "op10": lambda d: extract_pages(d)}


@pytest.mark.parametrize("name", [*ON_DOCUMENTS, *ON_PAGES])
def test_every_operator_takes_nulls_empties_long_texts_ties_and_repeats(spark, name):
    """One row per input row, from an empty table none; other columns, whatever they are called, change nothing."""
    if name in ON_DOCUMENTS:
        run, docs = ON_DOCUMENTS[name], table(spark, EDGES)
        plain = docs.select("doc_id", "text", "source")
        clash = plain.selectExpr("*", *(f"'x' AS {c}" for c in ("uid", "kept", "n_words", "digest", "label", "rep", "size", "shard", "block", "n_tokens", "ids", "h", "host", "lines", "n", "row", "nr", "tokens", "__uid")))
    else:
        page = lambda t: None if t is None else f"<p>{t}</p>"
        rows = [(i, None if i == 3 else f"http://a.net/{i}", page(t)) for i, t, _ in EDGES]
        run, plain = ON_PAGES[name], spark.createDataFrame(rows, "page_id long, url string, html string")
        clash = plain.selectExpr("*", *(f"'x' AS {c}" for c in ("host", "path", "rule", "verdict", "key", "hit", "text", "record", "warc_type", "n_chars", "u", "v", "node", "__uid")))
    got = run(plain).collect()
    assert len(got) == len(EDGES)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, run(clash).collect()))
    assert run(plain.limit(0)).count() == 0


def test_stages_take_nulls_empties_long_texts_and_empty_tables(spark):
    docs = table(spark, EDGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name
    ids = lambda df: sorted(r.doc_id if r.doc_id is not None else -1 for r in df.collect())
    assert ids(corpus_pipeline.quality(spark, docs, "")) == []
    assert ids(corpus_pipeline.exact(spark, docs, "")) == [1, 3, 4, 5, 6, 8]
    assert ids(corpus_pipeline.near(spark, docs, "")) == [1, 2, 3, 4, 5, 6, 7]
    packed = corpus_pipeline.pack(spark, docs, "").groupBy().sum("length").first()[0]
    assert packed == sum(len((t or "").encode()) + 1 for _, t, _ in EDGES)


def brute_bpe(pairs, word, skip):
    """Merges of lowest rank first (leftmost on ties), those that ``skip`` names never; ends of the pieces."""
    parts, dropped = [(i, i + 1) for i in range(len(word))], set()
    while True:
        open_ = [(pairs[word[a:b], word[b:c]], a, c) for (a, b), (_, c) in zip(parts, parts[1:]) if (word[a:b], word[b:c]) in pairs and (a, c) not in dropped]
        if not open_:
            return [b for _, b in parts]
        _, a, c = min(open_)
        if skip(a, c):
            dropped.add((a, c))
        else:
            at = next(i for i, p in enumerate(parts) if p[0] == a)
            parts[at : at + 2] = [(a, c)]


def test_merge_dropout_against_brute_force():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=open(merge_dropout.MODEL, "rb").read())
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    rank = {p: n for n, p in enumerate(sorted(score, key=lambda p: -score[p]))}
    pairs = {(p[:i], p[i:]): rank[p] for p in score for i in range(1, len(p)) if p[:i] in score and p[i:] in score}
    codec = merge_dropout.load(open(merge_dropout.MODEL, "rb").read())
    text = "the understanding of segmentations, and internationalisation of words in 2024 naïve " * 3
    for rate in (0.0, 0.1, 0.4, 1.0):
        enc = merge_dropout.Encoder(codec, rate, 11)
        words = ["\u2581" + w for w in text.split(" ")]
        bases = merge_dropout._bases(len(words), (5 ^ enc.salt) & ((1 << 64) - 1), 0)
        want = []
        for w, base in zip(words, bases.tolist()):
            ends = brute_bpe(pairs, w, lambda a, c, base=base: enc.bar and merge_dropout._skipped(base, a, c, enc.bar))
            want += [w[a:b] for a, b in zip([0, *ends], ends)]
        assert [sp.id_to_piece(i) for i in enc.encode(text, 5).tolist()] == want, rate


def test_token_lengths_against_brute_force(spark, corpus):
    import base64

    import regex

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(token_counts.RANKS, "rb").read().splitlines() if line)}
    pairs = lambda w: {(w[a:b], w[b:c]): ranks[w[a:c]] for a in range(len(w)) for c in range(a + 2, len(w) + 1) for b in range(a + 1, c) if w[a:c] in ranks}
    rows = [(i, t[:300] if t else t, s) for i, t, s in corpus[:40]] + [(900, "Über naïve 12345 'll  \n\n x🎉  ", "s")]
    want = {i: sum(len(brute_bpe(pairs(w.encode()), w.encode(), lambda a, c: False)) for w in regex.findall(token_counts.PATTERN, t or "")) for i, t, _ in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_lengths(table(spark, rows)).collect()} == want


def test_rules_of_one_length_tie_in_a_fixed_order(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", None)], "page_id long, url string, html string")
    for rules in ((("block", "a.net", "/"), ("allow", "a.net", "/")), (("allow", "a.net", "/"), ("block", "a.net", "/"))):
        assert filter_urls(df, rules).first().verdict == "allow"


def test_stages_keep_columns(spark, corpus):
    docs = table(spark, corpus)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
