"""Each operator against brute force, exact round trips or held-out accuracy, and on the edge cases it defines."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from callweave.llm import decontaminate, html_text, language, licenses, lm, neardup, packing, quality, token_counts, warc
from callweave.llm.recurrent import Gru

SF = "/root/testdata/sf0.001"
ODD = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (4, " \t\n "), (5, "word " * 30_000), (6, "ünïcödé 中文 😀\n\nx\n"), (7, "a" * 100_000), (8, "1 2 3 !!")]


def frame(spark, rows=ODD):
    """Documents with a null, empty, blank, long, repeated and odd text, and further columns with clashing names."""
    return spark.createDataFrame([(i, t, None, "s", "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, i string, n long")


def texts(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")


@pytest.mark.parametrize("kind", ["line_ends", "sentence_ends"])
def test_token_counts_match_offsets(spark, kind):
    import re

    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = [(r.doc_id, r.text) for r in texts(spark).limit(40).collect()] + [(900, "ab\n\n\ncd  \n é中\n"), (901, ""), (902, None), (903, "no newline"), (904, " A. B?! C\n\nD.  E.\n"), (905, " \n ")]
    got = {}
    split = getattr(token_counts, kind)
    for r in token_counts.section_counts(spark.createDataFrame(rows, "doc_id long, text string"), token_counts.default_path(), split=split).collect():
        got.setdefault(r.doc_id, []).append(r)
    crossed = 0
    for i, t in rows:
        t = t or ""
        cut = r"(?<=\n)(?!$)" if kind == "line_ends" else r"(?:(?<=[.!?])[ \t-\r]+|[ \t\x0b-\r]*\n[ \t-\r]*)(?=[^ \t-\r])"
        if kind == "line_ends":
            ends = [m.start() for m in re.finditer(r"(?<=\n)(?!\Z)", t)] + [len(t)]
        else:
            ends = [m.end() for m in re.finditer(cut, t) if re.search(r"[^ \t-\r]", t[: m.start() + 1])] + [len(t)]
        starts, want = [0, *ends[:-1]], [0] * len(ends)
        e = tok.encode(t, add_special_tokens=False)
        for a, b in e.offsets:
            parts = [min(b, y) - max(a, x) for x, y in zip(starts, ends)]
            crossed += sum(x > 0 for x in parts) > 1
            want[max(range(len(ends)), key=lambda k: (parts[k], -k))] += 1
        mine = sorted(got[i], key=lambda r: r.section)
        assert [r.char_end for r in mine] == ends, t
        assert [r.n_tokens for r in mine] == want, t
        assert {r.doc_tokens for r in mine} == {len(e.ids)}
    assert crossed > (kind == "sentence_ends") * 100


def test_token_that_crosses_goes_to_the_larger_part():
    raw, sizes = b"abcde", np.array([0, 5])
    own, crossing = token_counts.attribute(raw, np.array([1]), sizes, np.array([2, 5]))
    assert own.tolist() == [0, 1] and crossing.tolist() == [0, 1]
    own, _ = token_counts.attribute(b"abcd", np.array([1]), np.array([0, 4]), np.array([2, 4]))
    assert own.tolist() == [1, 0]  # of equals the first


def test_token_counts_of_fields(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(1, "title", "body text")], "doc_id long, a string, b string").withColumn("text", F.concat("a", "b"))
    ends = F.array(F.length("a"), F.length("a") + F.length("b"))
    got = token_counts.section_counts(d, token_counts.default_path(), ends=ends).collect()
    assert [r.char_end for r in got] == [5, 14] and sum(r.n_tokens for r in got) == got[0].doc_tokens


def _out_of_place(text, profiles):
    codes, counts = language.ngrams(text)
    own = [c for c, _ in sorted(zip(codes.tolist(), counts.tolist()), key=lambda x: (-x[1], x[0]))][: language.PROFILE]
    if not own:
        return "und"
    far = {lang: sum(abs(k - p.index(c)) if c in p else language.PROFILE for k, c in enumerate(own)) for lang, p in profiles.items()}
    return min(sorted(far), key=far.get)


def test_language_accuracy_and_brute_force(spark):
    docs = texts(spark, "/root/testdata/sf0.01")
    got = {r.doc_id: r for r in language.digest(docs).collect()}
    rows = docs.collect()
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= got[r.doc_id].score <= 1 for r in rows)
    p = language.fit(language.train_fold(docs))
    lists = {lang: [int(c) for _, c in sorted((r, c) for c, r in zip(p.codes.tolist(), p.ranks[:-1, k].tolist()) if r >= 0)] for k, lang in enumerate(p.langs)}
    assert all(_out_of_place(r.text, lists) == got[r.doc_id].lang_pred for r in rows if r.text is None or len(r.text) < 3000)


def test_language_edges(spark):
    got = language.digest(frame(spark)).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got} == {"und"} and {r.score for r in got} == {0.0}
    assert language.digest(frame(spark, [])).count() == 0
    p = language.Profiles({"en": language.ranked(*language.ngrams("the cat and the dog")).tolist()})
    assert p.predict(None) == ("und", 0.0) and p.predict("12 !?") == ("und", 0.0) and p.predict("the")[0] == "en"
    kept = language.keep(frame(spark), p).collect()
    assert {2, 3, 4, 8}.isdisjoint(r.doc_id for r in kept) and len(kept[0]) == 6


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href=/a>the menu of the site</a></li></ul></nav><div class="cookie-notice">We use the cookies that are needed for all of the pages on this site and that is it.</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First   line<br>goes on.</p><p>Be.<p>Caf&eacute; &lt;b&gt;<b>bold</b></p><form><input><label>Your name</label></form>
<section id="comments"><p>I think that the author of this is right and that it is good for all.</p></section></article></main><aside>more</aside><footer>&copy; x</footer>"""


def test_html_text():
    assert html_text.main_text(PAGE) == "Title & more\nFirst line goes on.\nBe.\nCafé <b>bold"
    for p, want in ((None, ""), ("", ""), ("<!-- open", ""), ("<script>x", ""), ("plain", "plain"), ("a < b &amp; c", "a < b & c"), ("<nav>menu</nav>", "")):
        assert html_text.main_text(p) == want
    long = "It was the best of times and it was the worst of times for all of us in the city. " * 4
    assert html_text.main_text(f"<div>{long}</div><div>Yes.</div><div>{long}</div><div class=ads>{long}</div>") == f"{long.strip()}\nYes.\n{long.strip()}"


def test_html_wrappers():
    p = "The story of the day is that it was as good as it can be for all of them. " * 3
    page = f"<div class='layout has-sidebar'><div class=sidebar><p>{p}</p></div><article class=post><p>Hi.</p><p>{p}</p></article><section class=replies><article class=comment><p>{p}</p></article></section></div>"
    assert html_text.main_text(page) == f"Hi.\n{p.strip()}"
    assert html_text.main_text(f"<div id=content><p>Hi.</p><p>Xyzzy plugh.</p></div><div>{p}</div><p hidden>{p}</p><p class='cookie-banner'>{p}</p>").startswith("Hi.\nXyzzy plugh.")


def test_html_text_on_pages(spark):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.digest(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        parts = (" ".join(unescape(re.sub("<[^>]*>", "", q)).split()) for q in re.split(r"</?(?:p|h1)>|<br>(?=<p>)", inner))
        assert got[r.page_id].text == "\n".join(x for x in parts if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def _counts(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, at, seen, dup = Counter(win), set(), set(), 0
    for i, k in enumerate(win):
        at |= {i, i + 1, i + 2} if c[k] > 1 else set()
    for x in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(at)


def test_quality_counts(spark):
    rows = [(r.doc_id, r.text) for r in texts(spark).collect()] + [(i + 1000, t) for i, t in ODD]
    got = quality.digest(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((i, *_counts(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.digest(frame(spark, [])).count() == 0


def test_quality_order_changes_no_verdict(spark):
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in texts(spark).collect()] + [(i + 10_000 + 100 * k, t) for k, (i, t) in enumerate(ODD)], "doc_id long, text string")
    rules = [*quality.base_rules(), *quality.standard_rules()]
    w = quality.Work(docs).add([n for r in rules for n in r.needs])
    every = {r[0]: {rules[k].name for k in range(len(rules)) if r[k + 1]} for r in w.df.select("doc_id", *(r.rejects(w) for r in rules)).collect()}
    for order in (rules, rules[::-1]):
        v = quality.Work(docs).judge(order)
        for r in v.df.select("doc_id", v("by").alias("by")).collect():  # the first of the order that rejects by itself
            assert r.by == next((x.name for x in order if x.name in every[r.doc_id]), None)
    figures = [{"name": "x", "seconds": 1.0, "rejected": 5}, {"name": "y", "seconds": 0.1, "rejected": 2}]
    assert [r.name for r in quality.ordered([quality.Rule("x", (), None), quality.Rule("y", (), None)], figures)] == ["y", "x"]


def test_quality_costs_are_measured(spark):
    """From the raw text, a rule that hashes windows costs more than one that looks for signs."""
    docs = spark.createDataFrame([(None, " ".join(f"w{(i * k) % 977}" for k in range(600))) for i in range(1500)], "doc_id long, text string")
    rules = [*quality.base_rules(), *quality.standard_rules()]
    figures = {f["name"]: f["seconds"] for f in quality.estimate(docs, rules)}
    assert figures["repeated_windows"] > figures["digits"] and figures["repeated_windows"] >= max(figures.values())


def test_quality_leaves_columns_alone(spark):
    good = " ".join("word" + "abcdefghij"[i % 10] + "klmnopqr"[i // 10] for i in range(80))
    docs = spark.createDataFrame([(1, good, "mine", "a", "b"), (2, "short", "mine", "a", "b")], "doc_id long, text string, rejected_by string, _q_words string, _Q_by string")
    assert [tuple(r) for r in quality.keep(docs).collect()] == [(1, good, "mine", "a", "b")]
    out = quality.cascade(docs)
    assert out.columns == [*docs.columns, "rejected_by_"] and {r.doc_id: r.rejected_by_ for r in out.collect()} == {1: None, 2: "few_words"}
    assert {r.rejected_by for r in out.collect()} == {"mine"}


@pytest.mark.parametrize("group", [4096, 16])
def test_near_duplicates_brute_force(spark, group):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [base[:12] ^ np.uint64(1 << int(b)) for b in rng.integers(0, 64, 9)]
    ball = np.array([base[0] ^ np.uint64((1 << int(a)) | (1 << int(b))) for a, b in rng.integers(0, 64, (60, 2))], np.uint64)
    codes = np.concatenate([base, *near, ball])
    codes = np.unique(codes)
    fps = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    from callweave.plans.graph import connected_components

    comp = {r.node: r.component for r in connected_components(neardup.links(neardup.blocked(fps, len(codes), group=group), group=group)).collect()}
    labels = np.arange(len(codes))
    for i in range(len(codes)):
        j = np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= 3) + i + 1
        neardup._joined(labels, np.full(len(j), i), j)
    mine = [comp.get(int(x), int(x)) for x in codes.view(np.int64)]
    assert len({*zip(mine, labels.tolist())}) == len(set(mine)) == len(set(labels.tolist()))


def test_more_blocks_link_the_same():
    for count in (10**3, 10**8, 10**10, 10**13):
        for order, width in neardup.choices(count):
            assert sum(w for _, w in order) == 64 and sorted(s for s, _ in order) == sorted({s for s, _ in order}) and 16 <= width < 64


def test_simhash_contract(spark):
    import xxhash

    def slow(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    rows = [(r.doc_id, r.text) for r in texts(spark).limit(30).collect()] + [(i + 1000, t) for i, t in ODD[:5]]
    for i, t in rows:
        assert neardup.simhash(None if t is None else t.encode()) == slow(t)
    got = neardup.digest(frame(spark)).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2} and {r.fingerprint for r in got if r.doc_id == 2} == {"0" * 16}
    assert neardup.digest(frame(spark, [])).count() == 0
    assert sorted(r.doc_id for r in neardup.keep_one(frame(spark)).collect())[:3] == [1, 1, 2]


def test_simhash_components_brute_force(spark):
    """component_id of whole real texts, over all pairs; and with groups so small that hot ones are split both ways."""
    docs = texts(spark, "/root/testdata/sf0.01")
    rows = docs.collect()
    fps = np.array([neardup.simhash(None if r.text is None else r.text.encode()) for r in rows], np.uint64)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in (np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1).tolist():
            x, y = top(i), top(j)
            root[max(x, y)] = min(x, y)
    low = {}
    for i, r in enumerate(rows):
        low[top(i)] = min(low.get(top(i), r.doc_id), r.doc_id)
    want = {r.doc_id: low[top(i)] for i, r in enumerate(rows)}
    assert {r.doc_id: r.component_id for r in neardup.digest(docs).collect()} == want
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, group=4).collect()} == want


def test_near_copies_in_small_chunks(spark):
    """Clusters and groups dealt out as pairs of chunks give the same components."""
    docs = texts(spark, "/root/testdata/sf0.01")
    whole = sorted(map(tuple, neardup.near_copies(docs).collect()))
    assert sorted(map(tuple, neardup.near_copies(docs, group=4, held_bytes=4096).collect())) == whole and len({c for _, c in whole}) < len(whole)


def test_pipeline_near_duplicates_brute_force(spark):
    import corpus_pipeline

    docs = texts(spark, "/root/testdata/sf0.01").union(spark.createDataFrame([(9000, None, None), (9001, " ", None), (9002, "one two", None), (9003, "One  two", None)], "doc_id long, text string, lang string"))
    sets = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a == b or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    want = [i for i in ids if root[i] == i]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()) == want


def _slow_tiling(t, p, least):
    mt, mp, total = [0] * len(t), [0] * len(p), 0
    while True:
        best, found = least - 1, []
        for b in range(len(p)):
            for a in range(len(t)):
                n = 0
                while a + n < len(t) and b + n < len(p) and t[a + n] == p[b + n] and not mt[a + n] and not mp[b + n]:
                    n += 1
                if n > best:
                    best, found = n, [(a, b)]
                elif n == best and n >= least:
                    found.append((a, b))
        if best < least:
            return total
        for a, b in found:
            if not any(mt[a : a + best]) and not any(mp[b : b + best]):
                mt[a : a + best] = mp[b : b + best] = [1] * best
                total += best


def test_tiling_matches_slow_tiling():
    rng = np.random.default_rng(0)
    for _ in range(120):
        p, t = rng.integers(0, 4, rng.integers(5, 40)), rng.integers(0, 4, rng.integers(5, 60))
        assert sum(n for _, _, n in decontaminate.tiles(t, p, 3)) == _slow_tiling(list(t), list(p), 3)


def test_decontamination_catches_reordered_passages(spark):
    item = " ".join(f"w{i}" for i in range(30))
    w = item.split()
    rows = [(1, "x y z " + item.upper() + " end"), (2, " ".join(w[20:] + ["mid"] + w[10:20] + ["gap"] + w[:10])), (3, " ".join(w[:8])), (4, "clean text " * 40), (5, None), (6, "")]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "w1 w2"), (10, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.matches(frame(spark, rows), bench).collect()}
    assert set(got) == {1, 2} and got[1].n_tiles == 1 and got[2].n_tiles == 3 and got[2].coverage == 1
    assert sorted(r.doc_id for r in decontaminate.clean(frame(spark, rows), bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.matches(frame(spark, rows), bench.where("false")).count() == 0 and decontaminate.matches(frame(spark, []), bench).count() == 0
    assert len(list(decontaminate.blocks(bench, 5, 0.5, block_bytes=20))) > 1


def test_decontamination_brute_force(spark):
    """All pairs of short documents and items against the slow tiling."""
    docs = [(r.doc_id, r.text) for r in texts(spark, "/root/testdata/sf0.01").collect() if r.text and len(r.text) < 1200]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    w = {i: t.lower().split() for i, t in bench}
    cut = " ".join(w[bench[0][0]][3:] + ["x"] + w[bench[0][0]][:3])
    docs += [(90_001, cut), (90_002, "first " + bench[1][1] + " and " + bench[2][1]), (90_003, " ".join(w[bench[3][0]][: len(w[bench[3][0]]) // 2 - 1]))]
    want = set()
    grams = lambda x: {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
    seeds = {i: grams(decontaminate.words(t)) for i, t in bench}
    for d, t in docs:
        x = decontaminate.words(t)
        mine = grams(x)
        for i, text in bench:
            if mine & seeds[i]:
                y = decontaminate.words(text)
                got = _slow_tiling(x, y, 5)
                if got * 2 >= len(y):
                    want.add((d, i, got))
    assert len(want) > 3
    items = {i: len(decontaminate.words(t)) for i, t in bench}
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, round(r.coverage * items[r.item_id])) for r in got} == want


def test_decontamination_of_long_and_short():
    import time

    items = decontaminate.Items([(1, "a " * 60), (2, "what now then"), (3, "two words"), (4, "一二三四五六七八"), (5, "b c " * 30)])
    began = time.perf_counter()
    assert [m[0] for m in items.matches("a " * 500_000)] == [1] and [m[0] for m in items.matches("x b c " * 20 + "b c " * 300_000)] == [5]
    assert time.perf_counter() - began < 20
    assert [m[0] for m in items.matches("So: what now, then? Two words.")] == [2] and items.matches("what then now") == []
    assert [m[0] for m in items.matches("零一二三四五六七八九")] == [4]


def test_html_time_is_linear():
    import time

    hostile = ["<a " * 200_000, "<div>" * 80_000 + "</span>" * 80_000, "<b>" * 80_000 + "<p>" * 80_000, "<title>" * 100_000, "<a '>" + "<a \"x' >" * 80_001, "<a " + "a" * 500_000 + " b=c>", "<p>" + "!" * 400_000 + "a" + "!" * 400_000]
    began = time.perf_counter()
    for page in hostile:
        html_text.main_text(page)
    assert time.perf_counter() - began < 30
    assert html_text.main_text("<p>" + "It is the one of the day. " * 12 + "</p><!-- never ends <p>hidden</p>").endswith("day.")


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", "é" * 100_000), (5, "u", ""), (6, "u", "x" * 70_000), (7, "u", "tiny"), (7, "u", "tiny")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(pages.repartition(3), folder, segment_bytes=20_000, file_bytes=50_000)
    got = warc.read(manifest, folder).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    by = {r.page_id: r for r in got}
    for i, _, h in rows:
        payload = (h or "").encode()
        assert by[i].payload_bytes == len(payload) and by[i].payload_digest == warc.digest32(payload)
    assert (by[1].record_type, by[1].refers_to) == ("revisit", 2) and by[2].record_type == "response" and by[3].refers_to == 5 and by[7].record_type == "response"
    assert sum(r.records for r in manifest.collect()) > len(rows)  # segments
    small = {r.page_id: r for r in warc.read(warc.write(pages, folder + "2", min_bytes=5), folder + "2").collect()}
    assert small[1].record_type == "response"
    assert warc.digest(pages.where("false")).count() == 0


def test_chunks():
    for p in (b"", b"x", b"ab\r\n" * 30_000):
        assert warc.dechunked(warc.chunked(p)) == p
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")


def test_word_tokenizer_is_exact():
    from tokenizers import Tokenizer

    tok, mine = Tokenizer.from_file(packing.default_path()), packing.WordTokenizer(packing.default_path(), cache_words=200)
    rng = np.random.default_rng(5)
    parts = ["a", "B", "é", "É", "İ", "ß", "Σ", "ς", ",", ".", "..", ".,", "'s", "'ll", "1", "42", "²", "\x1c", "\x85", "\xa0", " ", "  ", "\n", "क़", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "中文", "-", "_", "K", "́", "\x00"]
    for _ in range(1500):
        s = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert np.frombuffer(next(mine.encode([s.encode()])), "<u4").tolist() == tok.encode(s, add_special_tokens=False).ids, s


def test_packing_is_exact_and_tight(spark):
    from tokenizers import Tokenizer

    docs = texts(spark).union(frame(spark).select("doc_id", "text", "lang").where("doc_id > 1").selectExpr("doc_id + 10000", "text", "lang"))
    got = packing.digest(docs).toPandas()
    tok = Tokenizer.from_file(packing.default_path())
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = got[got.doc_id == r.doc_id].sort_values("start")
        assert mine.length.sum() == len(ids) == mine.doc_tokens.iloc[0] and (mine.start.to_numpy() == np.cumsum(mine.length) - mine.length).all()
        assert all(zlib.crc32(ids[x.start : x.start + x.length].tobytes()) == x.ids_crc32 for x in mine.itertuples())
    g = got.sort_values(["sequence_id", "offset"])
    assert ((g.offset + g.length).groupby(g.sequence_id).shift(1).fillna(0) == g.offset).all()
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() <= 4096 and (4096 - fill).sum() <= 4096 * 2
    assert packing.digest(docs.where("false")).count() == 0


def test_plan_holds_every_piece():
    rng = np.random.default_rng(1)
    for capacity in (16, 100, 4096):
        h = Counter(rng.integers(1, capacity + 1, 3000).tolist())
        used = Counter()
        for times, parts in packing.plan(dict(h), capacity):
            assert sum(n * k for n, k in parts) <= capacity
            used.update({n: k * times for n, k in parts})
        assert used == h


def test_fill_is_the_best_subset():
    from itertools import product

    rng = np.random.default_rng(2)
    for _ in range(60):
        counts = {int(n): int(k) for n, k in zip(rng.integers(2, 30, 4), rng.integers(1, 4, 4))}
        free = int(rng.integers(1, 80))
        best = max(s for c in product(*(range(k + 1) for k in counts.values())) if (s := sum(n * x for n, x in zip(counts, c))) <= free)
        used = packing.fill(counts, sorted(counts, reverse=True), free)
        assert sum(n * k for n, k in used.items()) == best and all(k <= counts[n] for n, k in used.items())


def test_recurrent_gradients():
    import callweave.llm.recurrent as R

    rng, kept, clip, real = np.random.default_rng(1), [], np.clip, R.F
    try:
        R.F = np.float64
        net = Gru(np.full(140, 1 / 140), 130, hidden=5)
        for k in net.NAMES:
            setattr(net, k, rng.normal(0, 0.5, getattr(net, k).shape))
        docs = [rng.integers(0, 140, n) for n in (7, 3, 9, 5)]
        R.np.clip = lambda a, lo, hi: (kept.append(a.copy()), a * 0)[1]
        net.train(docs, lanes=2, window=64)
        R.np.clip = clip
        scale = max(1, sum(map(len, docs))) / 64
        read = np.zeros(net.wx.shape)  # only rows of symbols that were read are touched
        read[np.unique(np.concatenate([[0], *(d[:-1] for d in docs)]))] = kept[0]
        kept[0] = read
        for w, g in zip(net.weights(), kept):
            for _ in range(6):
                i = tuple(rng.integers(0, s) for s in w.shape)
                old, e = w[i], 1e-5
                w[i] = old + e
                up = -net.score(docs, lanes=2).sum()
                w[i] = old - e
                down = -net.score(docs, lanes=2).sum()
                w[i] = old
                assert abs((up - down) / 2 / e - g[i] * scale) < 1e-5
    finally:
        R.F, R.np.clip = real, clip


def test_recurrent_state_and_sum():
    net = Gru(np.full(70, 1 / 70), 66, hidden=4)
    doc = np.random.default_rng(0).integers(0, 70, 50)
    alone = net.score([doc])[0]
    assert np.isclose(net.score([doc, doc[:7], doc])[2], alone, rtol=1e-4) and np.isclose(net.score([doc], window=5)[0], alone, rtol=1e-4)
    s = np.append(np.random.default_rng(1).normal(size=4), 1).astype(np.float32)[None].repeat(70, 0)
    assert np.isclose(np.exp(net.log_probabilities(s, np.arange(70))).sum(), 1, atol=1e-4)


def words_of(text):
    return [*(text or "").encode().lower().split(), b""]


def test_lm_tokens():
    import pyarrow as pa

    rows = ["a B  a\tÀ", None, "", " \n", " x ", "y\x1cz\u0085\u00a0 \x0b\x0c\r q", "a" * 5000]
    for part in (rows, rows[:1], rows[4:5], rows[:0]):
        v, ids, cuts = lm.tokens(pa.array(part, pa.string()))
        assert [[v[k] for k in ids[a:b]] for a, b in zip(cuts, cuts[1:])] == [words_of(t) for t in part]


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lm.dictionary, "__defaults__", (3000,))  # so that words lie beyond the dictionary
    docs = texts(spark, "/root/testdata/sf0.01").select("doc_id", "text").union(spark.createDataFrame([(100_000, None), (100_001, "")], "doc_id long, text string"))
    got = {r.doc_id: r for r in lm.digest(docs).collect()}
    c, every = Counter(), {r.doc_id: words_of(r.text) for r in docs.collect()}
    for i, w in every.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update(w)
    total, distinct = sum(c.values()), len(c)
    for i, w in every.items():
        want = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        r = got[i]
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.n_known == sum(c[x] > 0 for x in w) and r.n_tokens == len(w) and r.train_tokens == total
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_learns_from_every_document(spark):
    rows = [(i, f"a{i % 7} b{i % 5} c{i % 3} d{i % 2} e") for i in range(1100)]
    count = Counter(w for _, t in rows for w in words_of(t))
    words = lm.Dictionary(list(count.items()), sum(count.values()), len(count))

    def weights(rows):
        from pyspark.sql import functions as F

        return lm.trained(lm.encoded(spark.createDataFrame(rows, "doc_id long, text string"), words, F.lit(True)), words)

    whole = weights(rows)
    assert np.array_equal(whole, weights(rows))
    # the order of the words of one document tells whether it was learned from
    for i in (0, 500, 1099):
        other = [(k, " ".join(reversed(t.split())) if k == i else t) for k, t in rows]
        assert not np.array_equal(whole, weights(other))


def test_lm_edges(spark):
    assert lm.digest(frame(spark, [])).count() == 0
    got = lm.digest(frame(spark)).collect()
    assert len(got) == len(ODD) and all(r.n_tokens == 1 for r in got if r.doc_id in (2, 3, 4)) and all(math.isfinite(r.score) for r in got)
    only_held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    for r in lm.digest(frame(spark, [(i, "some text") for i in only_held])).collect():
        assert r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score


def test_licenses(spark):
    s = licenses.Scanner(licenses.TEMPLATES)
    assert [x[0] for x in s.scan("Intro. Released under the MIT License. More.")] == ["MIT-notice"]
    assert [x[2:] for x in s.scan("Released under the MIT License.\n" * 5)] == [(5 * k, 5 * k + 5) for k in range(5)]
    assert len(s.scan("Released under the MIT License. " * 20_000)) == 20_000
    assert [x[0] for x in s.scan(licenses.TEMPLATES["BSD-3-Clause"])] == ["BSD-3-Clause"] and [x[0] for x in s.scan(licenses.TEMPLATES["BSD-2-Clause"])] == ["BSD-2-Clause"]
    for name, t in licenses.TEMPLATES.items():
        got = s.scan(f"before all {t} between them {t} after")
        n = len(licenses.words(t))
        assert [(x[0], x[1], x[3] - x[2]) for x in got] == [(name, 1.0, n)] * 2, name
    changed = licenses.TEMPLATES["BSD-2-Clause"].replace("binary", "object").replace("disclaimer", "note", 1)
    name, coverage, first, end = s.scan("x " * 500 + changed + " y" * 500)[0]
    assert name == "BSD-2-Clause" and 0.9 < coverage < 1 and first == 500
    assert s.scan("software license copyright " * 2000) == [] and s.scan(None) == [] and s.scan("") == []
    got = licenses.scan(frame(spark, [*ODD, (9, "Licensed under CC BY-NC 4.0.")])).collect()
    assert [(r.doc_id, r.license) for r in got] == [(9, "CC-BY-NC-4.0-notice")]
    assert licenses.scan(frame(spark, [])).count() == 0


def test_alignment_against_longest_common_subsequence():
    """No alignment is longer than the longest common subsequence, and edits of a template are aligned nearly as well."""

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for k, y in enumerate(b):
                row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
        return row[-1]

    rng = np.random.default_rng(5)
    for name, t in licenses.TEMPLATES.items():
        w = licenses.words(t)
        for _ in range(6):
            edited = [x for x in w if rng.random() > 0.05]
            for _ in range(len(w) // 20):
                edited.insert(int(rng.integers(0, len(edited))), f"new{rng.integers(9)}")
            n, best = len(licenses.align(edited, w)), longest(edited, w)
            assert n <= best and n >= 0.9 * best - 1, name
            found = [x for x in licenses.Scanner({name: t}).scan("x y " + " ".join(edited) + " z")]
            assert bool(found) == (n >= 0.8 * len(w))


def test_alignment_keeps_order():
    pairs = licenses.align("b a c d x e".split(), "a b c d e".split())
    assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:])) and len(pairs) >= 4
    seq = [(i, b) for i, b in enumerate([3, 1, 2, 5, 4, 6])]
    assert len(licenses._rising(seq)) == 4


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.01")
        assert out.columns == columns, name
        kept = {r.doc_id for r in out.collect()}
        assert kept <= ids
        docs, ids = out, kept
    last = c.run(spark, "/root/testdata/sf0.01")
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == ids
    empty = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("false")
    for _, stage in c.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.01").count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as c

    odd = frame(spark)
    for name, stage in c.STAGES[:-1]:
        got = stage(spark, odd, "/root/testdata/sf0.001")
        assert got.columns == odd.columns and got.count() <= len(ODD), name


def test_null_ids(spark):
    rows = [(None, "released under the MIT License. " + "w%d " * 60 % tuple(range(60))), (None, None), (5, "w%d " * 60 % tuple(range(60)))]
    docs = frame(spark, rows)
    bench = spark.createDataFrame([(None, "w%d " * 20 % tuple(range(20))), (1, "w%d " * 20 % tuple(range(20)))], "item_id long, text string")
    assert token_counts.digest(docs).count() >= 3 and len(language.digest(docs).collect()) == 3 and quality.digest(docs).count() == 3
    assert neardup.digest(docs).count() == 3 and neardup.keep_one(docs).count() == 3
    assert decontaminate.matches(docs, bench).count() == 4 and licenses.digest(docs).count() == 1
    assert packing.digest(docs).count() == 3 and lm.digest(docs).count() == 3
    pages = spark.createDataFrame([(None, None, None), (None, "u", "x"), (3, "u", "x")], "page_id long, url string, html string")
    assert sorted((r.page_id is None, r.record_type, r.intact) for r in warc.digest(pages).collect()) == [(False, "response", True), (True, "response", True), (True, "response", True)]
    assert html_text.digest(pages).count() == 3
