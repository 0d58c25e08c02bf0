"""Null and repeated ids, rows repeated many times, wrappers of pages, long and deep inputs."""

import random

import pyarrow as pa
import pytest
import public_tokenizers as P
from tokenizers import Tokenizer

from panelwise.llm import catalog, common, html_text, minhash, packing, suffixes, token_counts

from . import brute
from .test_operators import LINKS, PAGE, prose, rows_of


def test_near_duplicates_with_null_and_repeated_ids(spark):
    """500 null ids in 250 pairs, one id on 60 texts, one row 300 times: the work stays linear."""
    rows = []
    for i in range(250):
        t = prose(40, 1000 + i)
        rows += [(None, t), (None, t + " end")]
    rows += [(7, prose(40, 2000 + i % 30) + (" x" if i >= 30 else "")) for i in range(60)] + [(9, prose(50, 3000))] * 300
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    out = minhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    groups = {}
    for r in out:
        groups.setdefault(r.component, []).append(r.doc_id)
    sizes = sorted(len(g) for g in groups.values())
    assert sizes == [2] * 280 + [300]
    docs = common.text_rows(df, "doc_id", "text", "doc_id").selectExpr("*", "xxhash64(text) as version")
    wanted = docs.distinct().selectExpr("monotonically_increasing_id() as cid", "0L as c1", "0L as c2",
                                        "doc_id as at_id", "version as at_version")
    joined = docs.alias("d").join(wanted.alias("w"), docs.version == wanted.at_version)
    assert joined.count() == len(rows)  # a row meets one class
    one = minhash.one_of_each(df).collect()
    assert len(one) == 281


def test_passages_of_one_row_repeated_many_times(spark):
    """One row 2,000 times: its span list is that of one document."""
    text = " ".join(prose(20, s) for s in range(8))
    rows = [(5, text)] * 2000 + [(6, prose(60, 50)), (7, "head " + text[100:700])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    spans = suffixes.cut_spans(df).where("doc_id = 5").selectExpr("size(spans) as n").distinct().collect()
    assert max(r.n for r in spans) <= len(text)
    docs = common.text_rows(df, "doc_id", "text", "doc_id").selectExpr("*", "xxhash64(text) as version")
    assert max(r.n for r in spans) == suffixes.duplicate_spans(docs, 200).where("doc_id = 5").select("first", "end").distinct().count()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.without_repeats(df).collect()}
    assert got[5] == (len(text), len(text), 1) and got[6][1] == 0 and got[7] == (605, 600, 1)


NAMES = ["content-sidebar-wrap", "has-sidebar", "page-with-nav", "l-form-page", "social-science", "related-content article-body", "widget-area"]


@pytest.mark.parametrize("open_, close", [(f'<div class="{n}">', "</div>") for n in NAMES] + [
    ("<form action=/page>", "</form>"), ('<div class="content no-sidebar"><article>', "</article></div>"),
    ('<div class="page sidebar"><article>', "</article></div>"), ('<div role=form><div class="sidebar-layout">', "</div></div>"),
    ('<section id="social-page"><div class="body">', "</div></section>")])
def test_a_wrapper_keeps_its_article(open_, close):
    paras = [prose(30, 70 + i) for i in range(6)]
    body = "<h1>Title of it</h1>" + "".join(f"<p>{p}</p>" for p in paras) + "<div class='ad-box'><p>Buy now</p></div>"
    want = " ".join(["Title of it", *paras])
    assert html_text.main_text(PAGE % (open_ + body + close)) == want


def test_boxes_beside_an_article_stay_out():
    a, comments = prose(150, 80), "".join(f"<p>{prose(40, 90 + i)}</p>" for i in range(6))
    page = PAGE % f"<div class=text><h1>T</h1><p>{a}</p></div><div class=comments-area>{comments}</div><div class=sidebar>{LINKS}<p>{prose(30, 99)}</p></div>"
    assert html_text.main_text(page) == f"T {a}"
    assert html_text.main_text("<div class=cookie-notice><p>We use cookies.</p></div>") == ""


def test_long_and_deep_pages():
    paras = [prose(40, 200 + i) for i in range(3000)]
    assert html_text.main_text(PAGE % ("<div>" + "".join(f"<p>{p}</p>" for p in paras) + "</div>")) == " ".join(paras)
    deep = PAGE % ("<div class=wrap>" * 3000 + f"<p>{paras[0]}</p><p>{paras[1]}</p>" + "</div>" * 3000)
    assert html_text.main_text(deep) == f"{paras[0]} {paras[1]}"


def test_long_texts_and_small_tables():
    """Texts longer than any batch, and look-up tables that are emptied all the time."""
    r = random.Random(9)
    words = ["it's", "don't", "naïve", "中文", "Ελλάς", "x1y2", "...", "<|endoftext|>", "A", "supercalifragilistic", "\t", "é", ""]
    texts = [" ".join(r.choice(words) + r.choice(["", "\n", ",", " "]) for _ in range(n)) for n in (0, 1, 2, 50, 30_000)]
    arrow = pa.array(texts)
    ids = packing.ChunkIds(catalog.WORD_JSON, limit=6)
    tk = Tokenizer.from_file(catalog.WORD_JSON)
    assert ids.encode(arrow) == [b"".join(i.to_bytes(4, "little") for i in tk.encode(t, add_special_tokens=False).ids) for t in texts]
    c = token_counts.PrefixCounter(catalog.BYTE_JSON, P.PATTERN)
    c.whole._limit = c.counted._limit = 3
    tb = Tokenizer.from_file(catalog.BYTE_JSON)
    n_bytes, n_tokens, cuts = c.of_texts(arrow, 40)
    assert n_tokens.tolist() == [len(tb.encode(t, add_special_tokens=False).ids) for t in texts]
    assert n_bytes.tolist() == [len(t.encode()) for t in texts]
    assert cuts.tolist() == [len(t.encode()) if n <= 40 else c.cut(t, 40) for t, n in zip(texts, n_tokens)]


def test_memo_keeps_frequent_keys():
    calls = []
    memo = common.BoundedMemo(lambda k: calls.append(k) or k * 2, limit=8)
    for i in range(100):
        assert memo["hot"] == "hothot" and memo[str(i)] == str(i) * 2
        assert len(memo) + len(memo._old) <= 8
    assert calls.count("hot") == 1


def test_components_edges(spark):
    from panelwise.llm.components import components
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert components(none).count() == 0
    links = spark.createDataFrame([(1, 1), (2, None), (None, None), (3, 4), (4, 3), (5, 4)] + [(9, 8)] * 50, "a bigint, b bigint")
    assert rows_of(components(links), "node", "component") == [(3, 3), (4, 3), (5, 3), (8, 8), (9, 8)]


def test_packing_and_brute_agree_on_repeated_rows(spark):
    rows = [(1, "same words here")] * 500 + [(None, None)] * 20
    out = packing.packed(spark.createDataFrame(rows, "doc_id bigint, text string"), catalog.WORD_JSON, capacity=16).collect()
    assert len(out) == 520 and len({(r.sequence_id, r.offset) for r in out}) == 520
    assert brute.words("Same") == ["same"]


def test_pipeline_on_hard_rows(spark, tmp_path):
    """The whole chain with nulls, repeated rows, ties, clashing extra columns, and an empty table."""
    import corpus_pipeline

    good = [prose(90, 500 + i) + ". The end of the text is here, and it has the words of it." for i in range(6)]
    passage = prose(60, 700)
    rows = [(1, good[0]), (1, good[0]), (2, good[0]), (None, good[1]), (None, good[1] + " more"), (None, None), (3, None), (4, ""), (5, "short"),
            (6, good[2] + " " + passage), (7, good[3] + " " + passage), (8, good[4]), (8, good[5]), (9, good[4] + " x y")]
    frame = spark.createDataFrame([(d, t, "en", "src", len(t or ""), "r", 1, True) for d, t in rows],
                                  "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, version bigint, kept boolean")
    frame.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    docs, seen = frame, {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == frame.columns
        seen[name] = sorted(((r.doc_id, r.text, r.n_chars, r.row, r.version) for r in docs.collect()), key=repr)
    verdict = brute_good(rows)
    assert [r[:2] for r in seen["quality_rules"]] == sorted(verdict, key=repr)
    first = seen["minhash_near_dedup"]
    assert len(first) == len({t for _, t, *_ in first}) == 6 and {r[0] for r in first} == {1, None, 6, 7, 8}
    cut = {r[0]: r[1] for r in seen["suffix_array_dedup"] if r[0] in (6, 7)}
    assert all(passage[20:-20] not in t and len(t) < 800 for t in cut.values())
    assert all(r[2] == len(r[1]) for r in seen["suffix_array_dedup"])
    out = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert {r.doc_id for r in out} == {1, None, 6, 7, 8} and len(out) == 6
    frame.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def brute_good(rows):
    from panelwise.llm.quality import STOP_WORDS
    stops = {w for ws in STOP_WORDS.values() for w in ws}
    out = []
    for d, t in rows:
        w = (t or "").split()
        if len(w) >= 50 and 2 <= sum(map(len, w)) / len(w) <= 15 and sum(x in stops for x in w) / len(w) >= 0.02:
            out.append((d, t))
    return out


def plain_scores(rows, flat, vocabulary):
    """Scores token by token from the parameters, without tables."""
    import math
    import zlib

    import numpy as np

    from panelwise.llm import lm
    r, t, pos, bias = (x.astype(np.float64) for x in lm.split_parameters(flat))
    head, n_head = vocabulary.head, len(vocabulary.head)
    out = []
    for doc, text in rows:
        words = [*brute.words(text), ""]
        words = [w.encode() for w in words]
        sym = [head.get(w, n_head + zlib.crc32(w[-3:]) % lm.CLASSES) for w in words]
        total, start = 0.0, len(bias)
        for i, (w, k) in enumerate(zip(words, sym)):
            q = r[sym[i - 1] if i > 0 else start] * pos[0] + r[sym[i - 2] if i > 1 else start] * pos[1]
            s = t @ q + bias
            total += (s[k] - s.max() - math.log(np.exp(s - s.max()).sum())) / math.log(10)
            if k >= n_head:
                c = zlib.crc32(w[-3:]) % lm.CLASSES
                total += math.log10((vocabulary.counts.get(w, 0) + 1) / (vocabulary.class_n[c] + vocabulary.class_v[c] + 1))
        out.append((doc, total))
    return out


def test_scores_equal_a_plain_version_and_not_the_partitioning(spark, monkeypatch):
    from panelwise.llm import lm
    from .test_operators import small_docs
    rows = small_docs(spark)[:60] + [(900, None), (901, ""), (902, "  \n"), (903, "Zyx " * 50 + "unseenword"), (None, "the end")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    seen = {}
    real = lm.trained

    def spy(docs, vocabulary):
        seen["v"], seen["flat"] = vocabulary, real(docs, vocabulary)
        vocabulary.counts = {bytes(r["word"]): r["c"] for r in lm.word_counts(docs).collect()}
        return seen["flat"]

    monkeypatch.setattr(lm, "trained", spy)
    monkeypatch.setattr(lm, "SHARE", 400)  # few words have a symbol of their own here, many are in classes
    got = sorted(((r.doc_id, r.score) for r in lm.scores(df).collect()), key=repr)
    assert 2 < len(seen["v"].head) < 400
    for (d, x), (e, y) in zip(got, sorted(plain_scores(rows, seen["flat"], seen["v"]), key=repr)):
        assert d == e and abs(x - y) < 1e-3 * max(1, abs(y))
    again = sorted(((r.doc_id, r.score) for r in lm.scores(df.repartition(7)).collect()), key=repr)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 * max(1, abs(b[1])) for a, b in zip(again, got))


def test_numbered_tokens():
    from panelwise.llm import lm
    texts = ["A b  a", "", " \t x\x0b", "É é\x85z", "end\n"]
    bounds, codes, words = lm.numbered(pa.array(texts))
    assert [[words[c] for c in codes[i:j]] for i, j in zip(bounds, bounds[1:])] == [lm.tokens(t) for t in texts]


def plain_article(html):
    """The outermost unmarked <article> elements of a page as a tree walk: what the ratio has to confirm."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.root = ("root", {}, [])
            self.open = [self.root]

        def handle_starttag(self, tag, attrs):
            if tag in html_text.BLOCK and self.open[-1][0] == "p":
                self.open.pop()
            node = (tag, dict(attrs), [])
            self.open[-1][2].append(node)
            if tag not in html_text.VOID:
                self.open.append(node)

        def handle_endtag(self, tag):
            if any(n[0] == tag for n in self.open):
                while self.open.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            self.open[-1][2].append(data)

    t = Tree()
    t.feed(html)
    t.close()
    marked = html_text._Lines()._marked
    found = []

    def seek(node):
        if node[0] == "article" and not marked(list(node[1].items())):
            found.append(node)
        else:
            for c in node[2]:
                if isinstance(c, tuple) and c[0] not in html_text.NEVER:
                    seek(c)

    def text(node, blocks):
        for c in node[2]:
            if isinstance(c, str):
                blocks[-1] += c
            elif c[0] in html_text.NEVER or c[0] in html_text.FORMS or marked(list(c[1].items())):
                blocks.append("")
            else:
                if c[0] in html_text.BLOCK:
                    blocks.append("")
                text(c, blocks)
                if c[0] in html_text.BLOCK:
                    blocks.append("")
        return blocks

    seek(t.root)
    return " ".join(" ".join(b.split()) for a in found for b in text(a, [""]) if b.split())


def test_given_pages_equal_a_tree_walk(spark):
    from tests.conftest import SF_SMALL
    rows = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r.text for r in catalog.op7(spark, SF_SMALL).collect()}
    assert rows and all(got[r.page_id] == plain_article(r.html or "") for r in rows)


def test_units_by_line_and_paragraph(spark):
    from panelwise.llm import units
    rows = [(1, "Alpha beta gamma.\nshort\nOne two three"), (2, "one two THREE\nAlpha  beta gamma."), (3, None), (None, "short\nshort")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_units, r.n_removed, r.spans, r.kept_text) for r in units.deduplicated(df, "line").collect()}
    # a null id is the smallest: its lines come first
    assert got == {1: (3, 0, "", rows[0][1]), 2: (2, 2, "0-13,14-32", ""), 3: (1, 0, "", ""), None: (2, 0, "", "short\nshort")}
    rows = [(1, "a b c\n\nd e f\ng h i"), (2, "d e f\ng h i\n\nq r s"), (2, "d e f\ng h i\n\nq r s")]
    out = units.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), "paragraph").collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_text) for r in out) == [(1, 0, rows[0][1]), (2, 1, "\nq r s"), (2, 1, "\nq r s")]
