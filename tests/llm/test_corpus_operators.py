"""URL filter, near-dedup, HTML extraction, line dedup, quality rules and the pipeline against SQL or brute force."""
import itertools
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from arrearscope.llm import htmltext, linededup, neardup, quality, urlfilter
from arrearscope.llm.components import components
from arrearscope.llm.queries import QUERIES, WORD_TOKENIZER
from conftest import SF_SMALL
from llm.conftest import ODD
from llm.test_whole_dedup import every_character


def table(spark, name):
    return spark.read.parquet(f"{SF_SMALL}/{name}.parquet")


def sql_rows(sql, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toPandas() if df.columns else None)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()), key=str)


def spark_rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


def test_registered():
    keys = E.queries()
    assert [k for k in keys if re.match(r"op\d+_", k)] and all(any(k.startswith(f"op{n}_") for k in keys) for n in range(1, 14)) and "pipeline" in keys
    assert set(QUERIES) <= set(keys)


# union-find

def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 302), (302, 300)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r.root].add(r.node)
    assert got == {0: set(range(61)), 100: set(range(100, 140)), 300: {300, 301, 302}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# op3

LINKED = [
    (1, "http://good.org/a", '<a href="http://mid.net/x">m</a><a HREF=//hub.net>h</a>'), (2, "http://good.org/b", '<a href="https://mid.net/y">m</a>'),
    (3, "https://bad.com/de/1", ""), (4, "https://bad.com/de/2", "<a href='http://other.net/'>o</a>"), (5, "http://farm.net/1", '<a href="http://bad.com/x">b</a>'),
    (6, "http://farm2.net/1", '<a href="http://farm.net/x">b</a>'), (7, "http://mid.net/p", '<a href="http://bad.com">b</a><a href="http://hub.net">h</a>'),
    (8, "http://hub.net/p", ""), (9, "http://other.net/", None), (10, None, None), (11, "no scheme", "x"), (12, "HTTP://WWW.Example.ORG/es/x?q#f", ""),
    (13, "x://a.example.org/en/12", ""), (14, "x://example.org", ""), (15, "x://sub.com/fr/", ""), (15, "x://sub.com/fr/", ""), (None, "x://notorg/", ""), (16, "://", ""),
]


def test_urls_equal_sql(spark, pages):
    want = sql_rows(urlfilter.oracle_sql(), pages=table(spark, "pages"))
    assert spark_rows(urlfilter.judge_pages(table(spark, "pages"))) == want
    odd = pages(LINKED, clashes=True)
    assert spark_rows(urlfilter.judge_pages(odd)) == sql_rows(urlfilter.oracle_sql(), pages=odd)


def test_urls_spread(pages):
    got = {r.page_id: r for r in urlfilter.judge_pages(pages(LINKED)).collect()}
    assert (got[12].host, got[12].path, got[12].rule, got[12].verdict) == ("www.example.org", "/es/x", "example.org/es/", "block")
    assert got[13].rule == "example.org/en/1" and got[14].rule is None and got[15].verdict == "allow"
    # hosts that link towards the blocked seed are blocked, unless trust reaches them too
    assert [got[i].verdict for i in (5, 6, 8, 9)] == ["block", "block", "allow", "allow"]
    assert (got[10].host, got[10].path, got[10].verdict) == ("", "", "allow")
    assert urlfilter.judge_pages(pages([])).count() == 0


def test_page_rank_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    edges = sorted({(f"h{a}", f"h{b}") for a, b in rng.integers(0, 30, (150, 2)) if a != b})
    seed = [("h0", 10 ** 14, 0), ("h1", 5 * 10 ** 13, 0), ("h2", 0, 10 ** 14)]
    got = {r.host: (r.t, r.d) for r in urlfilter.spread(spark.createDataFrame(seed, "host string, t long, d long"),
                                                       spark.createDataFrame(edges, "src string, dst string")).collect()}
    t, d = {h: a for h, a, _ in seed}, {h: b for h, _, b in seed}
    out, into = defaultdict(int), defaultdict(int)
    for a, b in edges:
        out[a] += 1
        into[b] += 1
    for _ in range(urlfilter.ROUNDS):
        t2, d2 = defaultdict(int), defaultdict(int)
        for h, x, y in seed:
            t2[h] += x
            d2[h] += y
        for a, b in edges:
            t2[b] += t.get(a, 0) * 85 // (100 * out[a])
            d2[a] += d.get(b, 0) * 85 // (100 * into[b])
        t, d = t2, d2
    assert got == {h: (t.get(h, 0), d.get(h, 0)) for h in got} and set(got) >= {h for h in t if t[h]} | {h for h in d if d[h]}


# op4

def near_reference(rows):
    """doc_id -> smallest doc_id of its class, by all pairs."""
    sh = neardup.Shingler()
    texts = [t or "" for _, t in rows]
    doc, s, count = sh.shingles(texts)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    sets = [neardup.unpack_set(neardup.pack_set(s[i:j], count[i:j])) for i, j in zip(cut, cut[1:])]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if texts[i] == texts[j] or neardup.probability_jaccard(*sets[i], *sets[j]) >= neardup.THRESHOLD - 1e-12:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[find(i)].append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], min(ids) if ids else None, len(g)) for i in g]
    return sorted(out, key=str)


def chained_texts():
    """A chain in which neighbours are similar and far ones are not, copies, and unrelated texts."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(4000)]
    base = list(rng.choice(words, 120))
    rows, n = [], 0
    for k in range(25):
        rows.append((n, " ".join(base)))
        if k % 5 == 0:
            rows.append((n + 1000, " ".join(base)))
        n += 1
        base[rng.integers(0, 120)] = f"new{k}"
    rows += [(500 + i, " ".join(rng.choice(words, 60))) for i in range(20)]
    return rows


@pytest.mark.parametrize("kind", ["small", "odd", "chain"])
def test_near_classes_equal_brute_force(spark, documents, kind):
    df = {"small": lambda: table(spark, "documents"), "odd": lambda: documents(ODD, True), "chain": lambda: documents(chained_texts())}[kind]()
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = neardup.classes(df).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str) == near_reference(rows)
    assert sum(r.keep for r in got) == len({(r.class_id, r.class_size, r.n_links if r.class_id is None else 0) for r in got}) or kind == "odd"
    left = neardup.kept_documents(df)
    assert left.columns == df.columns and left.count() == sum(r.keep for r in got)


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    a, b = rng.integers(1, 2 ** 62, 300, dtype=np.uint64), None
    b = np.r_[a[:200], rng.integers(1, 2 ** 62, 80, dtype=np.uint64)]
    wa, wb = rng.integers(1, 5, len(a)).astype(float), rng.integers(1, 5, len(b)).astype(float)
    doc = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
    sig = neardup.signatures(doc, np.r_[a, b], np.r_[wa, wb], 2, 4096)
    ia, ib = np.argsort(a), np.argsort(b)
    want = neardup.probability_jaccard(a[ia], wa[ia], b[ib], wb[ib])
    # the definition, key by key
    x, y = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    slow = sum(1 / sum(max(x.get(k, 0) / x[d], y.get(k, 0) / y[d]) for k in x.keys() | y.keys()) for d in x.keys() & y.keys())
    assert want == pytest.approx(slow) and abs((sig[0] == sig[1]).mean() - want) < 0.03


# op6

def article(page):
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    import html
    parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(p for p in parts if p)


def test_html_equals_article(spark):
    df = table(spark, "pages")
    got = {r.page_id: r for r in htmltext.main_text(df).collect()}
    for r in df.collect():
        assert got[r.page_id].text == article(r.html) and got[r.page_id].n_chars == len(article(r.html)) and got[r.page_id].url == r.url


def page(i, text, extra=""):
    return (f"<html><head><title>t{i}</title></head><body><div class=top><a href=/>Home</a><a href=/x>News of today</a></div>"
            f"<div id=content><h1>Title {i}</h1><p>{text} &amp; more</p><p>Printed with love</p>{extra}</div>"
            f"<ul><li><a href=/1>first link {i}</a><li><a href=/2>second link</a></ul><div class='reader-comments'>nice {i}</div></body></html>")


def test_html_template_of_a_host(pages):
    rows = [(i, f"http://h.com/{i}", page(i, f"words number {i} " * 8)) for i in range(30)]
    rows += [(100, "http://other.com/", "<p>alone"), (101, None, None), (102, "http://h.com/z", ""), (103, "http://h.com/w", "<b>no template"), (104, "http://x.com", "a" * 100_000)]
    got = {r.page_id: r for r in htmltext.main_text(pages(rows, clashes=True)).collect()}
    for i in range(30):
        # link lists are menus, and a block that every page repeats is template text
        assert got[i].text == f"Title {i}\n" + ("words number %d " % i * 8).strip() + " & more", got[i]
    assert [got[i].text for i in (100, 101, 102, 103)] == ["alone", "", "", "no template"] and got[104].n_chars == 100_000
    assert htmltext.main_text(pages([])).count() == 0


def test_html_blocks():
    def text(h):
        return "\n".join(b[0] for b in htmltext.Parser().blocks(h)[0] if not b[3])
    assert text("<p>One<br>two <a href=x>l</a>.<p>b<div>c</div>d<ul><li>e<li>f</ul>") == "One two l.\nb\nc\nd\ne\nf"
    assert text("<main><header><h1>H</h1></header><form>f</form><p>x</p></main><footer>z") == "H\nx"
    assert text("a<!-- x --><script>if(a<b){'</p>'}</script>b &lt;i&gt; &#8212;<p title='>'>q") == "a\nb <i> —\nq"
    assert text("<p>cut <b") == "cut" and text("") == "" and text("a < b") == "a < b"


# op8

@pytest.mark.parametrize("kind", ["small", "odd", "fuzzy"])
def test_lines_equal_brute_force(spark, documents, kind):
    rng = np.random.default_rng(2)
    base = "the quick brown fox jumps over the lazy dog while forty two sleepy cats look on from the wall".split()
    fuzzy = []
    for i in range(60):
        w = list(base)
        w[rng.integers(0, len(w))] = f"new{i}"
        fuzzy.append((i, " ".join(w) + f"\nown line number {i} of its kind {i * 7}\n\n" + " ".join(base[:4])))
    df = {"small": lambda: table(spark, "documents"), "odd": lambda: documents(ODD, True), "fuzzy": lambda: documents(fuzzy)}[kind]()
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = every_character(rows)
    out = linededup.dedup_documents(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(((d, want[(d, t)]) for d, t in rows), key=str)
    assert linededup.dedup_report(df).count() == len(rows)


def test_lines_empty_table(documents):
    assert linededup.dedup_report(documents([])).count() == 0


# op10

def test_quality_equals_sql(spark, documents):
    df = table(spark, "documents")
    assert spark_rows(quality.judge(df)) == sql_rows(quality.oracle_sql(), documents=df)
    odd = documents([(d, None if t is None else t.replace("\x00", "")) for d, t in ODD], True)
    assert spark_rows(quality.judge(odd)) == sql_rows(quality.oracle_sql(), documents=odd)
    assert quality.judge(documents([])).count() == 0


def hosted():
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"Sign up now for our letter\n{words} {i}", "a") for i in range(40)]
    rows += [(100 + i, "Sign up now for our  LETTER\n" + " ".join(f"x{i}.{k}" for k in range(47)), "a") for i in range(5)]
    rows += [(200 + i, "one text that is copied " + words, "b") for i in range(40)]
    return rows


def test_quality_removes_lines_and_rejects_depleted(documents):
    df = documents(hosted(), clashes=True)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert all(got[i].kept and got[i].removed_lines == 1 for i in range(40))
    assert all(not got[100 + i].kept and not got[100 + i].base_failed and got[100 + i].words_left == 47 for i in range(5))
    assert all(got[200 + i].kept and got[200 + i].removed_lines == 0 for i in range(40))  # copies of one text count once
    left = {r.doc_id: r for r in quality.kept_documents(df).collect()}
    assert quality.kept_documents(df).columns == df.columns and set(left) == set(range(40)) | set(range(200, 240))
    assert left[3].text.startswith("w0 w1") and left[3].n_chars == len(left[3].text)
    assert spark_equal(df, quality.oracle_sql())


def spark_equal(df, sql):
    return spark_rows(quality.judge(df)) == sql_rows(sql, documents=df)


def test_repeated_words(spark):
    texts = ["a b c a b c", "a b c d", "a a a a a", "x a b c y a b c z", "a b", "p q r s p q r s p q"]
    got = {r.doc_id: r.n_repeat_words for r in quality.judge(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()}

    def slow(t):
        w = t.split()
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        return len({p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)})

    assert [got[i] for i in range(len(texts))] == [slow(t) for t in texts]


# pipeline

BLANK = " \t\n\x0b\f\r"


def quality_reference(rows, share=0.1, least=2):
    """(doc_id, text, source) -> the kept documents with the lines that stay, document by document."""
    def norm(x):
        return re.sub(r"[\x20\x09-\x0D]+", " ", x.strip(BLANK)).lower()

    def lines(t):
        return [x for x in (t or "").split("\n") if norm(x)]

    texts, held = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        texts[s or ""].add(t or "")
        for x in lines(t):
            held[s or "", norm(x)].add(t or "")
    frequent = {k for k, v in held.items() if len(v) > least and len(v) > share * len(texts[k[0]])}
    out = []
    for d, t, s in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        count = defaultdict(int)
        for g in grams:
            count[g] += 1
        again = len({p for i, g in enumerate(grams) if count[g] > 1 for p in (i, i + 1, i + 2)})
        gone = [x for x in lines(t) if (s or "", norm(x)) in frequent]
        left = len(words) - sum(len(norm(x).split(" ")) for x in gone)
        if len(words) >= 50 and 100 * again <= 50 * len(words) and left >= 50 and left >= 0.2 * len(words):
            out.append((d, "\n".join(x for x in t.split("\n") if (s or "", norm(x)) not in frequent) if gone else t))
    return out, len(frequent)


def pipeline_reference(rows):
    kept, frequent = quality_reference(rows)
    lines = every_character(kept)
    after = [(d, lines[(d, t)]) for d, t in kept]
    first = {d: c for d, c, _ in near_reference(after)}
    final = sorted({(d, t) for d, t in after if first[d] == d}, key=str)  # equal rows: one stays
    return final, frequent


def odd_corpus():
    """Texts that survive the rules, and every odd row beside them."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(5000)]

    def text(n):
        return "\n".join(" ".join(rng.choice(words, 12)) for _ in range(n))

    rows = [(i, f"Share this page with friends\n{text(8)}", "a") for i in range(12)]
    base = text(10)
    rows += [(100, base, "b"), (101, base, "b"), (102, base.replace("w1", "v1", 1), "c"), (103, base + "\nand one line more of its own here", None)]
    rows += [(200, text(300), "long"), (200, text(9), "twin"), (201, "x" * 30_000 + "\n" + text(6), "")]
    rows += [(300, text(7), "r")] * 3 + [(None, text(7), "n"), (301, None, "n"), (302, "", None), (303, " \n\t", "n"), (304, "too short", "n"), (305, "rep " * 500, "n")]
    return rows


@pytest.mark.parametrize("kind", ["small", "odd", "empty"])
def test_pipeline_equals_brute_force(spark, documents, tmp_path, kind):
    """run() stage by stage against plain versions: the small table, odd rows with clashing columns, and no rows."""
    from llm.test_text_operators import check_packing
    if kind == "small":
        folder, df = SF_SMALL, table(spark, "documents")
    else:
        folder, df = str(tmp_path), documents(odd_corpus() if kind == "odd" else [], clashes=True)
        df.write.parquet(f"{folder}/documents.parquet")
    final, frequent = pipeline_reference([(r.doc_id, r.text, r.source) for r in df.collect()])
    assert frequent or kind == "empty"
    check_packing(corpus_pipeline.run(spark, folder).collect(), final)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "best_fit_packing"] and WORD_TOKENIZER
